"""Runs over services that answer out of fixed rules, with the SQL that gives the same rows; ``test_services`` holds one against the other."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import texts, times
from tidemark.operators import markets, news, pages, trades
from tidemark.plans import runs
from tidemark.plans.registry import folder, r6, read
from tidemark.sources import http, lake, remote

QUERIES, ORACLES = {}, {}


def query(oracle):
    def put(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, oracle
        return f

    return put


REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
#: Markets of a region, fills of a token, and news items of a sport that the services hold.
MARKETS, FILLS, ITEMS = 300, 2_500, 250


def _market(tag: str, i: int) -> dict:
    """A market of the recorded service."""
    kinds = ("Season-Wins", "championship", "playoffs", "super-bowl", "nba")
    return {
        "conditionId": f"{tag}-{i}", "slug": None if i % 7 == 0 else f"s{i}", "question": f"Will {tag} win {i}?", "startDate": "1995-01-01T00:00:00Z", "endDate": "bad" if i % 50 == 49 else f"1995-{1 + i % 12:02d}-15T00:00:00Z",
        "clobTokenIds": json.dumps([f"y{i}", f"n{i}"][: i % 3]), "winner": ("Yes", "YES", "No", "no", None)[i % 5], "volume": None if i % 11 == 0 else str(i * 1000), "volumeNum": i * 10.0,
        "tags": [{"slug": kinds[i % 5] if i % 2 else "", "label": kinds[i % 5]}],
    }


class MarketService:
    """Markets of a tag, by offset; an offset behind them is answered with an error status. ``AFRICA-AGAIN`` has Africa's."""

    def __call__(self, method: str, url: str, data: dict) -> object:
        if "/markets/" in url:
            tag, _, i = url.rpartition("/")[2].rpartition("-")
            return _market(tag.replace("%20", " "), int(i))
        if data["offset"] >= MARKETS:
            raise http.HttpError(remote.PAST_THE_END)
        tag = data["tag"].replace("-AGAIN", "")
        return [_market(tag, i) for i in range(data["offset"], min(MARKETS, data["offset"] + data["limit"]))]


def _fill(token: str, i: int) -> dict:
    """A fill: seven share a second, and every fifth comes again on the other side."""
    return {"transactionHash": f"{token}-{i}", "logIndex": str(i % 7), "blockNumber": "1", "timestamp": str(1_000 + i // 7), "maker": "a", "taker": "b", "makerAssetId": token, "takerAssetId": trades.USDC, "makerAmountFilled": "1000000", "takerAmountFilled": str(1_000 * (1 + i % 900))}


class FillService:
    """Fills behind a cursor of time and log index, in their order."""

    def __call__(self, method: str, url: str, data: dict) -> object:
        v = data["variables"]
        cursor, taker = (int(v["ts"]), int(v["li"])), "takerAssetId: $token" in data["query"]
        found = [_fill(v["token"], i) for i in range(FILLS) if not taker or i % 5 == 0]
        found = [f for f in found if (int(f["timestamp"]), int(f["logIndex"])) > cursor and int(f["timestamp"]) < int(v["end"])]
        return {"data": {"orderFilledEvents": sorted(found, key=lambda f: (int(f["timestamp"]), int(f["logIndex"])))[: v["first"]]}}


class NewsService:
    """News items newest first, a day apart, and game logs."""

    def __call__(self, method: str, url: str, data: dict) -> object:
        if "leaguegamelog" in url:
            kind, rows = data["SeasonType"][:3], []
            for g in range(40):
                home, away = [f"{kind}{g}", f"Home {g}", f"H{g} vs. A{g}", "W" if g % 3 else "L", 90 + g, f"2024-08-{1 + g % 28:02d}"], [f"{kind}{g}", f"Away {g}", f"A{g} @ H{g}", "L" if g % 3 else "W", 91, f"2024-08-{1 + g % 28:02d}"]
                rows += [away, home] if g % 2 else [home, away]
            return {"resultSets": [{"headers": ["GAME_ID", "TEAM_NAME", "MATCHUP", "WL", "PTS", "GAME_DATE"], "rowSet": rows}]}
        sport, first = url.rsplit("/", 2)[1], (data["page"] - 1) * data["limit"]
        days = [(i, f"2024-{12 - i // 28:02d}-{28 - i % 28:02d}T10:00:00Z") for i in range(first, min(ITEMS, first + data["limit"]))]
        items = [{"id": i, "published": None if i % 40 == 7 else day, "headline": f"{sport} {i}", "description": "" if i % 3 == 0 else f" d {i}", "links": {"web": {"href": None if i % 31 == 5 else f"http://{sport}/{i % 120}"}}, "categories": [{"description": sport}]} for i, day in days]
        return {"pageCount": -(-ITEMS // data["limit"]), "articles": items}


class FeedService:
    """Feeds with an unknown entity, open elements and an item without a link; and pages of the items."""

    def __call__(self, method: str, url: str, data: dict) -> object:
        if url.startswith("down"):
            raise OSError("down")
        if "/page/" in url:
            return f"<html><nav>menu</nav><article><p>Text of {url.rpartition('/')[2]}</p></article></html>".encode()
        items = "".join(
            f"<item><title>T&nbsp;{i} &amp; {url}</title>" + ("" if i == 3 else f"<link>http://{url}/{i}</link>") + ("" if i % 2 else f"<description><![CDATA[a  b {i}]]></description><pubDate>Thu, {1 + i} Aug 2024 12:30:00 GMT</pubDate>")
            + f"<category>c{i}</category><br></item>" for i in range(10)
        )
        return f"<rss><channel><title>t</title>{items}</channel></rss>".encode()


class Once:
    """Answers nothing: what is read through it must come from a cache."""

    def __call__(self, method: str, url: str, data: dict) -> object:
        raise OSError("asked again")


def _client(service: object):
    return lambda slices: http.Client(service, rate=1e6, burst=1e6, retry=http.Retry(1))


def _register(spark: SparkSession, again: bool = True) -> None:
    """The formats on the recorded services; or, with ``again`` false, on one that fails."""
    of = (lambda service: _client(service())) if again else (lambda service: _client(Once()))
    remote.register(spark, markets=of(MarketService), fills=of(FillService), news=of(NewsService), feeds=of(FeedService))


RAW = "conditionId string, slug string, question string, description string, startDate string, endDate string, resolutionDate string, resolvedDate string, clobTokenIds string, winner string, volume string, volumeNum string, tags array<struct<slug:string,label:string>>"
CATEGORIES = {"south": ["AFRICA", "AMERICA"], "east": ["ASIA", "AFRICA-AGAIN"]}
_MARKETS_SQL = """
WITH m AS (SELECT r_name AS tag, unnest(range(0, 300)) AS i FROM region WHERE r_name IN ('AFRICA', 'AMERICA', 'ASIA')),
p AS (SELECT *, ['season-wins', 'championship', 'playoffs', 'super-bowl', 'nba'][i % 5 + 1] AS kind, 1 + i % 12 AS mon, CASE WHEN i % 11 = 0 THEN i * 10 ELSE i * 1000 END AS vol FROM m)
SELECT tag || '-' || i AS market_id, CASE WHEN i % 7 = 0 THEN tag || '-' || i ELSE 's' || i END AS slug, CASE WHEN tag = 'ASIA' THEN 'east' ELSE 'south' END AS category,
    CASE i % 5 WHEN 0 THEN 'Season-Wins' WHEN 1 THEN 'championship' WHEN 2 THEN 'playoffs' WHEN 3 THEN 'super-bowl' ELSE 'nba' END AS tags,
    CASE i % 5 WHEN 0 THEN 'season_long' WHEN 1 THEN 'championship' WHEN 2 THEN 'playoff_series' WHEN 3 THEN 'championship' ELSE 'other' END AS market_type,
    i % 5 <> 4 AS is_primary_sample, CASE WHEN i % 3 >= 1 THEN 'y' || i ELSE '' END AS yes_token_id, CASE WHEN i % 3 = 2 THEN 'n' || i ELSE '' END AS no_token_id,
    CASE i % 5 WHEN 0 THEN 'YES' WHEN 1 THEN 'YES' WHEN 2 THEN 'NO' ELSE 'INVALID' END AS resolved_outcome, CAST(vol AS DOUBLE) AS total_volume_usdc, {rest}
FROM p WHERE {where}"""


def _scanned_markets(spark: SparkSession) -> DataFrame:
    """Raw markets of all categories' tags, through the paged scan."""
    _register(spark)
    rows = spark.read.format("remote_markets").options(url="http://m", tags=",".join(t for ts in CATEGORIES.values() for t in ts), start_after="1995-01-01").load()
    return rows.select(F.from_json("payload", RAW).alias("m"), F.get_json_object("slice", "$.tag").alias("found_by")).select("m.*", "found_by")


@query(_MARKETS_SQL.format(rest="strftime(make_date(1995, mon, 15), '%Y-%m-%d') AS end_at", where="i % 50 <> 49 AND vol >= 10000 AND mon >= 2"))
def market_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The universe out of a paged scan: categories by tag, repeats of one market gone, parsed, filtered and linked."""
    good, _ = runs.universe(_scanned_markets(spark), CATEGORIES, F.lit("2020-01-01").cast("timestamp"))
    return good.select("market_id", "slug", "category", F.array_join("tags", ",").alias("tags"), "market_type", "is_primary_sample", "yes_token_id", "no_token_id", "resolved_outcome", "total_volume_usdc", F.date_format("end_at", "yyyy-MM-dd").alias("end_at"))


@query("""
WITH m AS (SELECT r_name AS tag, unnest(range(0, 300)) AS i FROM region WHERE r_name IN ('AFRICA', 'AMERICA', 'ASIA'))
SELECT tag || '-' || i AS market_id, 'endDate' AS error FROM m WHERE i % 50 = 49""")
def market_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scanned markets that can't be read, with what is wrong."""
    _, bad = runs.universe(_scanned_markets(spark), CATEGORIES, F.lit("2020-01-01").cast("timestamp"))
    return bad.select("market_id", F.col("_error").alias("error"))


@query("SELECT r_name || '-' || i AS market_id, 'Will ' || r_name || ' win ' || i || '?' AS question FROM (SELECT r_name, unnest(range(0, 30)) AS i FROM region)")
def market_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markets looked up one by one."""
    _register(spark)
    ids = ",".join(f"{r}-{i}" for r in REGIONS for i in range(30))
    rows = spark.read.format("remote_market").options(url="http://m", ids=ids).load()
    return rows.select(F.get_json_object("payload", "$.conditionId").alias("market_id"), F.get_json_object("payload", "$.question").alias("question"))


FILL = ", ".join(f"{c} string" for c in remote.FILL_FIELDS.split())


def _scanned_fills(spark: SparkSession) -> DataFrame:
    _register(spark)
    rows = spark.read.format("remote_fills").options(url="http://f", tokens=",".join(f"yes-{r}" for r in REGIONS), start="1003", end="1300", slice_seconds="200").load()
    told = rows.select(F.from_json("payload", FILL).alias("f"), "slice")
    part = lambda name, kind: F.get_json_object("slice", f"$.{name}").cast(kind).alias(name)
    return told.select("f.*", part("token", "string").alias("token_id"), part("token_rank", "int"), part("side", "string"), part("side_rank", "int"))


@query("""
WITH f AS (SELECT 'yes-' || r_name AS token_id, unnest(range(0, 2500)) AS i FROM region)
SELECT token_id, count(*) AS scanned, count(DISTINCT i) AS fills, sum(i) FILTER (WHERE s = 0) AS total FROM (SELECT token_id, i, 0 AS s FROM f UNION ALL SELECT token_id, i, 1 FROM f WHERE i % 5 = 0)
WHERE 1000 + i // 7 >= 1003 AND 1000 + i // 7 < 1300 GROUP BY 1""")
def fills_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills of both sides through keyset pages and time slices; repeats across sides told apart."""
    number = F.substring_index("transactionHash", "-", -1).cast("long")
    return _scanned_fills(spark).groupBy("token_id").agg(F.count("*").alias("scanned"), F.count_distinct("transactionHash").alias("fills"), F.sum(F.when(F.col("side_rank") == 0, number)).cast("decimal(38,0)").cast("long").alias("total"))


@query("""
WITH f AS (SELECT r_name AS market_id, unnest(range(0, 2500)) AS i FROM region), p AS (SELECT *, (1000 * (1 + i % 900)) / 1000000.0 AS p FROM f WHERE 1000 + i // 7 >= 1003 AND 1000 + i // 7 < 1300)
SELECT market_id, count(*) AS trades, round(sum(p), 6) AS size_usdc, round(min(greatest(0.001, least(0.999, p))), 6) AS low, CAST(min(1000 + i // 7) AS BIGINT) AS first_s,
    max('yes-' || market_id || '-' || i) AS last_tx, 'YES_BUY' AS side FROM p WHERE market_id <> 'ASIA' GROUP BY 1""")
def fills_to_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned fills to trades of the primary markets: tokens without empty ones, repeats gone, normalised."""
    own = read(spark, sf_dir, "region").select(F.col("r_name").alias("market_id"), F.concat(F.lit("yes-"), "r_name").alias("yes_token_id"), F.lit("").alias("no_token_id"), (F.col("r_name") != "ASIA").alias("is_primary_sample"))
    found = runs.market_trades(_scanned_fills(spark).drop("side"), own)
    return found.groupBy("market_id").agg(F.count("*").alias("trades"), r6(F.sum("size_usdc")).alias("size_usdc"), r6(F.min("price_raw")).alias("low"), F.min("ts_s").alias("first_s"), F.max("tx_hash").alias("last_tx"), F.max("side").alias("side"))


_FEED_SQL = """
WITH i AS (SELECT lower(r_name) AS feed, unnest(range(0, 10)) AS i FROM region), a AS (SELECT feed, i, 'http://' || feed || '/' || i AS url FROM i WHERE i <> 3)
SELECT feed AS source, url, sha256(url) AS article_id, CASE WHEN i % 2 = 0 THEN printf('2024-08-%02d 12:30:00', 1 + i) END AS published_at, CASE WHEN i % 2 = 0 THEN 'minute' ELSE 'day' END AS precision,
    'T ' || i || ' & ' || feed AS title, CASE WHEN i % 2 = 0 THEN 'a b ' || i END AS lede, 'c' || i AS tags FROM a"""
_FEEDS = json.dumps([{"url": r.lower(), "name": r.lower()} for r in REGIONS] + [{"url": "down", "name": "down"}])


def _feed_rows(rows: DataFrame) -> DataFrame:
    found = rows.where("error is null").select(F.from_json("payload", "feed_url string, source string, xml string").alias("f")).select("f.*")
    out = news.rss_articles(found)
    return out.select("source", "url", "article_id", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"), F.col("timestamp_precision").alias("precision"), "title", "lede", F.get_json_object("raw_metadata_json", "$.tags[0]").alias("tags"))


@query(_FEED_SQL)
def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of several feeds, ill-formed ones among them; the feed that is down costs nothing but itself."""
    _register(spark)
    return _feed_rows(spark.read.format("remote_feeds").options(feeds=_FEEDS, failures="keep").load())


@query(_FEED_SQL + " UNION ALL SELECT 'down', NULL, NULL, NULL, NULL, 'OSError: asked again', NULL, NULL")
def feed_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds through the cache, and again with a service that answers nothing: what was had comes from the cache, the feed that was down stays down."""
    cache, options = http.ResponseCache(spark, folder(spark, "cache")), {"feeds": _FEEDS, "failures": "keep"}
    _register(spark)
    remote.through_cache(spark, "remote_feeds", options, cache).count()
    _register(spark, again=False)
    rows = remote.through_cache(spark, "remote_feeds", options, cache)
    none = F.lit(None).cast("string")
    down = rows.where("error is not null").select(F.get_json_object("slice", "$.name").alias("source"), *(none.alias(c) for c in ("url", "article_id", "published_at", "precision")), F.col("error").alias("title"), none.alias("lede"), none.alias("tags"))
    return _feed_rows(rows).unionByName(down)


_ITEM = "page int, pos int, sport string, item struct<id:long,published:string,headline:string,description:string,links:struct<web:struct<href:string>>,categories:array<struct<description:string>>>"
_ESPN_SQL = """
WITH n AS (SELECT s.sport, i, make_timestamp(2024, CAST(12 - i // 28 AS INTEGER), CAST(28 - i % 28 AS INTEGER), 10, 0, 0) AS day FROM (VALUES ('nfl'), ('nba')) s(sport), (SELECT unnest(range(0, 250)) AS i)),
e AS (SELECT *, CASE WHEN i % 40 <> 7 THEN day END AS t FROM n WHERE i <= (SELECT max(i) FROM n WHERE day >= TIMESTAMP '2024-08-05' )),
k AS (SELECT *, 'http://' || sport || '/' || i % 120 AS url FROM e WHERE i % 31 <> 5 AND (t IS NULL OR (t >= TIMESTAMP '2024-08-05' AND t <= TIMESTAMP '2024-12-20'))),
f AS (SELECT url, min(i) AS i FROM k GROUP BY 1)
SELECT sha256(url) AS article_id, url, strftime(t, '%Y-%m-%d %H:%M:%S') AS published_at, CASE WHEN t IS NULL THEN 'unknown' ELSE 'minute' END AS precision, sport || ' ' || i AS title,
    CASE WHEN i % 3 <> 0 THEN ' d ' || i END AS lede, CAST(i AS VARCHAR) AS espn_id FROM k JOIN f USING (url, i)"""


def _espn(spark: SparkSession) -> DataFrame:
    _register(spark)
    rows = spark.read.format("remote_news").options(sports="nfl,nba", start="2024-08-05").load()
    items = rows.select(F.from_json("payload", _ITEM).alias("n")).select("n.page", "n.pos", "n.sport", "n.item.*")
    return news.espn_articles(items, "2024-08-05", "2024-12-20")


@query(_ESPN_SQL)
def news_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News pages until the window's start; undated items stay, one of each link."""
    return _espn(spark).select("article_id", "url", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"), F.col("timestamp_precision").alias("precision"), "title", "lede", F.get_json_object("raw_metadata_json", "$.espn_id").alias("espn_id"))


_GAMES_SQL = """
WITH g AS (SELECT k.kind, g, CASE WHEN g % 3 <> 0 THEN 1 ELSE 0 END AS won, printf('2024-08-%02d', 1 + g % 28) AS d FROM (VALUES ('Reg'), ('Pla')) k(kind), (SELECT unnest(range(0, 40)) AS g))
SELECT 'https://www.nba.com/game/' || kind || g AS url, d || ' 23:59:00' AS published_at, 'Home ' || g || ' ' || (90 + g) || ' - 91 Away ' || g || ' (' || d || ')' AS title,
    CASE WHEN won = 1 THEN 'Game result: Home ' || g || ' defeated Away ' || g || ' ' || (90 + g) || '-91' ELSE 'Game result: Away ' || g || ' defeated Home ' || g || ' 91-' || (90 + g) END AS lede FROM g"""


def _games(spark: SparkSession) -> DataFrame:
    _register(spark)
    rows = spark.read.format("remote_games").options(seasons="2024-25").load()
    return news.game_articles(news.game_rows(rows.select(F.from_json("payload", "headers array<string>, rowSet array<array<string>>").alias("p")).select("p.*")))


@query(_GAMES_SQL)
def game_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of both kinds of a season's games, from two log rows each."""
    return _games(spark).select("url", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"), "title", "lede")


@query(f"""
WITH e AS ({_ESPN_SQL}), g AS ({_GAMES_SQL}), u AS (SELECT article_id, 'espn' AS source FROM e UNION ALL SELECT sha256(url), 'nba_stats' FROM g
    UNION ALL SELECT sha256('http://nfl/' || i), 'feed' FROM (SELECT unnest(range(0, 240)) AS i) WHERE sha256('http://nfl/' || i) NOT IN (SELECT article_id FROM e))
SELECT source, count(*) AS articles, min(article_id) AS least FROM u GROUP BY 1""")
def category_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A category's sources composed: news before games before feeds, one article of each id."""
    url = F.concat(F.lit("http://nfl/"), F.col("id").cast("string"))
    feed = spark.range(240).select(texts.key_of(url).alias("article_id"), F.lit("feed").alias("source"), url.alias("url"), F.lit("day").alias("timestamp_precision"))
    return runs.feeds(_espn(spark), _games(spark), feed).groupBy("source").agg(F.count("*").alias("articles"), F.min("article_id").alias("least"))


@query("""
WITH i AS (SELECT unnest(range(0, 60)) AS i)
SELECT 'a' || i AS article_id, CASE WHEN i % 3 = 0 THEN 'own' WHEN i % 10 <> 9 THEN 'Text of ' || i % 20 END AS body_text, CASE WHEN i % 3 = 0 THEN NULL WHEN i % 4 = 0 THEN 'kept' WHEN i % 10 <> 9 THEN 'Text of ' || i % 20 END AS lede,
    i % 3 = 0 OR i % 10 <> 9 AS text_available FROM i""")
def page_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles without text get their pages', fetched once each and then from the cache; those with text are left alone."""
    i, none = F.col("id"), F.lit(None).cast("string")
    url = F.when(i % 10 == 9, F.concat(F.lit("down"), i.cast("string"))).otherwise(F.concat(F.lit("http://x/page/"), (i % 20).cast("string")))
    given = spark.range(60).select(F.concat(F.lit("a"), i.cast("string")).alias("article_id"), url.alias("url"), F.when(i % 3 == 0, "own").alias("body_text"), F.when((i % 3 != 0) & (i % 4 == 0), "kept").otherwise(none).alias("lede"), (i % 3 == 0).alias("text_available"))
    articles = schemas.conform(given, schemas.ARTICLE)
    cache = http.ResponseCache(spark, folder(spark, "pages"))
    remote.fetched_pages(articles, cache, _client(FeedService())).count()
    return pages.enriched(articles, remote.fetched_pages(articles, cache, _client(Once()))).select("article_id", "body_text", "lede", "text_available")


@query("SELECT * FROM (VALUES ('nba', 'nba', 0), ('nba', 'basketball', 1), ('nfl', 'nfl', 2)) t(category, tag, place)")
def config_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags out of a configuration text, in configured order."""
    found = lake.config('{"categories": {"nba": {"tags": ["nba", "basketball"]}, "nfl": {"tags": ["nfl"]}}}')
    pairs = [(c, t) for c, own in found["categories"].items() for t in own["tags"]]
    return lake.literal_rows(spark, [(c, t, n) for n, (c, t) in enumerate(pairs)], "category string, tag string, place int")
