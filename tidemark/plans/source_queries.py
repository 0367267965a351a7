"""Queries over remote sources. What a service would answer is recorded out of the fixture tables, page by page; the registered formats then read it
through paging, cursors, slices and the cache, as they would read the service."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import texts, times
from tidemark.operators import news, ordered, pages, trades
from tidemark.plans import runs
from tidemark.plans.registry import folder, query, r6, read
from tidemark.sources import http, lake, remote, staging

#: A transport's clients at any rate; the recorded answers need no rest.
FAST = 1e6


def _client(path: str, otherwise: object):
    return lambda slices: http.Client(http.Recorded(path, otherwise), rate=FAST, burst=FAST, retry=http.Retry(1))


def _recorded(spark: SparkSession, name: str, answers: DataFrame) -> str:
    """Where the answers ``(key, body)`` lie."""
    path = folder(spark, name)
    http.record(answers, path)
    return path


def _key(method: str, url: Column | str, data: str, *columns: Column) -> Column:
    """The cache key of a request whose data are a format of columns."""
    url = F.lit(url) if isinstance(url, str) else url
    return F.format_string(f'["{method}","%s",{data}]', url, *columns)


def _paged(rows: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """``(keys, page, count, items)``: the rows' ``item`` as JSON arrays of ``size`` at most; pages are numbered from 0."""
    placed = ordered.numbered(rows, keys, order, "_place").withColumn("page", F.floor((F.col("_place") - 1) / size))
    items = F.transform(F.array_sort(F.collect_list(F.struct("_place", "item"))), lambda x: x["item"])
    return placed.groupBy(*keys, "page").agg(F.count("*").alias("count"), F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")).alias("items"))


RAW = "conditionId string, slug string, question string, description string, startDate string, endDate string, resolutionDate string, resolvedDate string, clobTokenIds string, winner string, volume string, volumeNum string, tags array<struct<slug:string,label:string>>"
CATEGORIES = {"south": ["AUTOMOBILE", "BUILDING"], "east": ["MACHINERY", "AUTOMOBILE-AGAIN"]}
_MARKETS_SQL = """
WITH m AS (SELECT c_mktsegment AS tag, c_custkey AS i FROM customer WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY')),
p AS (SELECT *, 1 + i % 12 AS mon, CASE WHEN i % 11 = 0 THEN i * 10 ELSE i * 1000 END AS vol FROM m)
SELECT tag || '-' || i AS market_id, CASE WHEN i % 7 = 0 THEN tag || '-' || i ELSE 's' || i END AS slug, CASE WHEN tag = 'MACHINERY' THEN 'east' ELSE 'south' END AS category,
    CASE i % 5 WHEN 0 THEN 'Season-Wins' WHEN 1 THEN 'championship' WHEN 2 THEN 'playoffs' WHEN 3 THEN 'super-bowl' ELSE 'nba' END AS tags,
    CASE i % 5 WHEN 0 THEN 'season_long' WHEN 1 THEN 'championship' WHEN 2 THEN 'playoff_series' WHEN 3 THEN 'championship' ELSE 'other' END AS market_type,
    i % 5 <> 4 AS is_primary_sample, CASE WHEN i % 3 >= 1 THEN 'y' || i ELSE '' END AS yes_token_id, CASE WHEN i % 3 = 2 THEN 'n' || i ELSE '' END AS no_token_id,
    CASE i % 5 WHEN 0 THEN 'YES' WHEN 1 THEN 'YES' WHEN 2 THEN 'NO' ELSE 'INVALID' END AS resolved_outcome, CAST(vol AS DOUBLE) AS total_volume_usdc, {rest}
FROM p WHERE {where}"""


def _raw_market(tag: Column, i: Column) -> Column:
    """A market as the service's JSON; dates, volumes and token lists are those of customers' keys."""
    kinds = F.element_at(F.array(*map(F.lit, ("Season-Wins", "championship", "playoffs", "super-bowl", "nba"))), (i % 5 + 1).cast("int"))
    text = i.cast("string")
    end = F.when(i % 50 == 49, "bad").otherwise(F.format_string("1995-%02d-15T00:00:00Z", i % 12 + 1))
    ids = F.when(i % 3 == 0, "[]").when(i % 3 == 1, F.concat(F.lit('["y'), text, F.lit('"]'))).otherwise(F.concat(F.lit('["y'), text, F.lit('", "n'), text, F.lit('"]')))
    return F.to_json(F.struct(
        F.concat(tag, F.lit("-"), text).alias("conditionId"), F.when(i % 7 != 0, F.concat(F.lit("s"), text)).alias("slug"), F.concat(F.lit("Will "), tag, F.lit(" win "), text, F.lit("?")).alias("question"),
        F.lit("1995-01-01T00:00:00Z").alias("startDate"), end.alias("endDate"), ids.alias("clobTokenIds"), F.element_at(F.array(*map(F.lit, ("Yes", "YES", "No", "no"))), F.when(i % 5 < 4, (i % 5 + 1).cast("int"))).alias("winner"),
        F.when(i % 11 != 0, (i * 1000).cast("string")).alias("volume"), (i * 10.0).alias("volumeNum"), F.array(F.struct(F.when(i % 2 == 1, kinds).otherwise("").alias("slug"), kinds.alias("label"))).alias("tags"),
    ))


def _scanned_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw markets of all categories' tags, through the paged scan; one tag gives another's markets again."""
    rows = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("tag"), F.col("c_custkey").alias("i"))
    again = F.explode(F.when(F.col("tag") == "AUTOMOBILE", F.array(F.lit("AUTOMOBILE"), F.lit("AUTOMOBILE-AGAIN"))).otherwise(F.array("tag")))
    asked = rows.withColumn("item", _raw_market(F.col("tag"), F.col("i"))).select(again.alias("asked"), "i", "item")
    data = '{"closed":"true","end_date_min":"1995-01-01","limit":100,"offset":%d,"tag":"%s"}'
    answers = _paged(asked, ["asked"], ["i"], remote.MARKETS_PAGE).select(_key("GET", "http://m/markets", data, F.col("page") * remote.MARKETS_PAGE, F.col("asked")).alias("key"), F.col("items").alias("body"))
    path = _recorded(spark, "markets", answers)
    remote.register(spark, markets=_client(path, remote.PAST_THE_END))
    found = spark.read.format("remote_markets").options(url="http://m", tags=",".join(t for ts in CATEGORIES.values() for t in ts), start_after="1995-01-01").load()
    return found.select(F.from_json("payload", RAW).alias("m"), F.get_json_object("slice", "$.tag").alias("found_by")).select("m.*", "found_by")


@query(_MARKETS_SQL.format(rest="strftime(make_date(1995, mon, 15), '%Y-%m-%d') AS end_at", where="i % 50 <> 49 AND vol >= 10000 AND mon >= 2"))
def market_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as markets through a paged scan by segment: categories by tag, repeats of one market gone, parsed, filtered and linked."""
    good, _ = runs.universe(_scanned_markets(spark, sf_dir), CATEGORIES, F.lit("2020-01-01").cast("timestamp"))
    return good.select("market_id", "slug", "category", F.array_join("tags", ",").alias("tags"), "market_type", "is_primary_sample", "yes_token_id", "no_token_id", "resolved_outcome", "total_volume_usdc", F.date_format("end_at", "yyyy-MM-dd").alias("end_at"))


@query("SELECT c_mktsegment || '-' || c_custkey AS market_id, 'endDate' AS error FROM customer WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY') AND c_custkey % 50 = 49")
def market_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scanned markets that can't be read, with what is wrong."""
    _, bad = runs.universe(_scanned_markets(spark, sf_dir), CATEGORIES, F.lit("2020-01-01").cast("timestamp"))
    return bad.select("market_id", F.col("_error").alias("error"))


@query("SELECT 'S-' || s_suppkey AS market_id, 'Will S win ' || s_suppkey || '?' AS question FROM supplier")
def market_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as markets, looked up one by one; whoever looks up names them, so the driver lists them."""
    rows = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"))
    url = F.concat(F.lit("http://m/markets/S-"), F.col("i").cast("string"))
    path = _recorded(spark, "lookups", rows.select(_key("GET", url, "{}").alias("key"), _raw_market(F.lit("S"), F.col("i")).alias("body")))
    remote.register(spark, markets=_client(path, 404))
    ids = ",".join(f"S-{r['i']}" for r in rows.collect())
    found = spark.read.format("remote_market").options(url="http://m", ids=ids).load()
    return found.select(F.get_json_object("payload", "$.conditionId").alias("market_id"), F.get_json_object("payload", "$.question").alias("question"))


FILL = ", ".join(f"{c} string" for c in remote.FILL_FIELDS.split())
#: Tokens of fills, seconds of a slice, and the scan's window: lineitems' days.
TOKENS, SLICE, WINDOW = [f"yes-{n}" for n in range(1, 8)], 400 * 86_400, (788_918_400, 978_307_200)
_FILLS_SQL = f"""f AS (SELECT 'yes-' || l_linenumber AS token_id, l_orderkey AS i, min(CAST(epoch(l_shipdate) AS BIGINT)) AS ts, CAST(1000 * (1 + l_orderkey % 900) AS BIGINT) AS usdc, l_linenumber AS line FROM lineitem
    WHERE epoch(l_shipdate) >= {WINDOW[0]} AND epoch(l_shipdate) < {WINDOW[1]} GROUP BY l_orderkey, l_linenumber)"""


def _scanned_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems as fills of seven tokens, through keyset pages and time slices; every fifth comes again on the other side."""
    line = read(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("line"), F.col("l_orderkey").alias("i"), times.seconds(F.col("l_shipdate")).alias("ts"))
    line = line.where(F.col("ts").between(WINDOW[0], WINDOW[1] - 1)).groupBy("line", "i").agg(F.min("ts").alias("ts"))  # a fill for each transaction and log index
    token, i = F.concat(F.lit("yes-"), F.col("line").cast("string")), F.col("i")
    fill = F.to_json(F.struct(
        F.concat(token, F.lit("-"), i.cast("string")).alias("transactionHash"), i.cast("string").alias("logIndex"), F.lit("1").alias("blockNumber"), F.col("ts").cast("string").alias("timestamp"), F.lit("a").alias("maker"), F.lit("b").alias("taker"),
        token.alias("makerAssetId"), F.lit(trades.USDC).alias("takerAssetId"), F.lit("1000000").alias("makerAmountFilled"), (1_000 * (1 + i % 900)).cast("string").alias("takerAmountFilled"),
    ))
    side = F.explode(F.when(i % 5 == 0, F.array(F.lit("maker"), F.lit("taker"))).otherwise(F.array(F.lit("maker"))))
    rows = line.withColumn("item", fill).select(token.alias("token"), side.alias("side"), F.floor((F.col("ts") - WINDOW[0]) / SLICE).alias("stretch"), "ts", "i", "item")
    size = remote.FILLS_PAGE
    keys = ["token", "side", "stretch"]
    # a page's cursor is the last row of the page before; of the first it is what the scan starts from
    ends = ordered.numbered(rows.select(*keys, "ts", "i"), keys, ["ts", "i"], "n").where(F.col("n") % size == 0).select(*keys, F.floor(F.col("n") / size).alias("page"), F.col("ts").alias("at"), F.col("i").alias("li"))
    told = _paged(rows, keys, ["ts", "i"], size).join(ends, [*keys, "page"], "left")
    start = F.lit(WINDOW[0]) + F.col("stretch") * SLICE
    end = F.least(start + SLICE, F.lit(WINDOW[1]))
    asked = F.when(F.col("side") == "maker", json.dumps(remote.fill_query("maker"))).otherwise(json.dumps(remote.fill_query("taker")))
    data = f'{{"query":%s,"variables":{{"end":"%d","first":{size},"li":"%d","token":"%s","ts":"%d"}}}}'
    key = _key("POST", "http://f", data, asked, end, F.coalesce("li", F.lit(2**62)), F.col("token"), F.coalesce("at", start - 1))
    path = _recorded(spark, "fills", told.select(key.alias("key"), F.concat(F.lit('{"data":{"orderFilledEvents":'), "items", F.lit("}}")).alias("body")))
    remote.register(spark, fills=_client(path, {"data": {"orderFilledEvents": []}}))
    found = spark.read.format("remote_fills").options(url="http://f", tokens=",".join(TOKENS), start=str(WINDOW[0]), end=str(WINDOW[1]), slice_seconds=str(SLICE)).load()
    found = found.select(F.from_json("payload", FILL).alias("f"), "slice")
    part = lambda name, kind: F.get_json_object("slice", f"$.{name}").cast(kind).alias(name)
    return found.select("f.*", part("token", "string").alias("token_id"), part("token_rank", "int"), part("side", "string"), part("side_rank", "int"))


@query(f"""
WITH {_FILLS_SQL}
SELECT token_id, count(*) AS scanned, count(DISTINCT i) AS fills, CAST(sum(i) FILTER (WHERE s = 0) AS BIGINT) AS total FROM (SELECT token_id, i, 0 AS s FROM f UNION ALL SELECT token_id, i, 1 FROM f WHERE i % 5 = 0) GROUP BY 1""")
def fills_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills of both sides through keyset pages and time slices; repeats across sides told apart."""
    number = F.substring_index("transactionHash", "-", -1).cast("long")
    return _scanned_fills(spark, sf_dir).groupBy("token_id").agg(F.count("*").alias("scanned"), F.count_distinct("transactionHash").alias("fills"), F.sum(F.when(F.col("side_rank") == 0, number)).alias("total"))


@query(f"""
WITH {_FILLS_SQL}, p AS (SELECT *, usdc / 1000000.0 AS p FROM f)
SELECT 'm' || line AS market_id, count(*) AS trades, round(sum(p), 6) AS size_usdc, round(min(greatest(0.001, least(0.999, p))), 6) AS low, min(ts) AS first_s, max(token_id || '-' || i) AS last_tx, 'YES_BUY' AS side FROM p WHERE line <> 3 GROUP BY line""")
def fills_to_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned fills to trades of the primary markets: tokens without empty ones, repeats gone, normalised."""
    line = read(spark, sf_dir, "lineitem").select("l_linenumber").distinct()
    number = F.col("l_linenumber").cast("string")
    own = line.select(F.concat(F.lit("m"), number).alias("market_id"), F.concat(F.lit("yes-"), number).alias("yes_token_id"), F.lit("").alias("no_token_id"), (F.col("l_linenumber") != 3).alias("is_primary_sample"))
    found = runs.market_trades(_scanned_fills(spark, sf_dir).drop("side"), own)
    return found.groupBy("market_id").agg(F.count("*").alias("trades"), r6(F.sum("size_usdc")).alias("size_usdc"), r6(F.min("price_raw")).alias("low"), F.min("ts_s").alias("first_s"), F.max("tx_hash").alias("last_tx"), F.max("side").alias("side"))


#: Documents of a feed.
FEED = 200
_FEED_SQL = f"""
WITH a AS (SELECT doc_id AS i, 'feed' || doc_id // {FEED} AS feed, 'http://feed' || doc_id // {FEED} || '/' || doc_id AS url, n_chars FROM documents WHERE doc_id % 10 <> 3)
SELECT feed AS source, url, sha256(url) AS article_id, CASE WHEN i % 2 = 0 THEN printf('2024-08-%02d 12:30:00', 1 + i % 28) END AS published_at, CASE WHEN i % 2 = 0 THEN 'minute' ELSE 'day' END AS precision,
    'T ' || i || ' & ' || feed AS title, CASE WHEN i % 2 = 0 THEN 'a b ' || n_chars END AS lede, 'c' || i % 5 AS tags FROM a"""


def _feeds(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Documents as items of feeds, entities and open elements among them, some without a link; where they are recorded, and the list of feeds with one that is down."""
    i = F.col("doc_id")
    feed = F.concat(F.lit("feed"), F.floor(i / FEED).cast("string"))
    link = F.when(i % 10 == 3, "").otherwise(F.concat(F.lit("<link>http://"), feed, F.lit("/"), i.cast("string"), F.lit("</link>")))
    about = F.when(i % 2 == 0, F.concat(F.lit("<description><![CDATA[a  b "), F.col("n_chars").cast("string"), F.lit("]]></description><pubDate>Thu, "), (1 + i % 28).cast("string"), F.lit(" Aug 2024 12:30:00 GMT</pubDate>"))).otherwise("")
    item = F.concat(F.lit("<item><title>T&nbsp;"), i.cast("string"), F.lit(" &amp; "), feed, F.lit("</title>"), link, about, F.lit("<category>c"), (i % 5).cast("string"), F.lit("</category><br></item>"))
    told = read(spark, sf_dir, "documents").select(feed.alias("feed"), item.alias("item")).groupBy("feed").agg(F.concat(F.lit("<rss><channel><title>t</title>"), F.array_join(F.collect_list("item"), ""), F.lit("</channel></rss>")).alias("body"))
    path = _recorded(spark, "feeds", told.select(_key("GET", F.col("feed"), "{}").alias("key"), "body"))
    names = [r["feed"] for r in told.select("feed").collect()]  # what a configuration would list
    return path, json.dumps([{"url": x, "name": x} for x in [*sorted(names), "down"]])


def _feed_rows(rows: DataFrame) -> DataFrame:
    found = rows.where("error is null").select(F.from_json("payload", "feed_url string, source string, xml string").alias("f")).select("f.*")
    out = news.rss_articles(found)
    return out.select("source", "url", "article_id", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"), F.col("timestamp_precision").alias("precision"), "title", "lede", F.get_json_object("raw_metadata_json", "$.tags[0]").alias("tags"))


@query(_FEED_SQL)
def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of feeds, ill-formed ones among them; the feed that is down costs nothing but itself."""
    path, feeds = _feeds(spark, sf_dir)
    remote.register(spark, feeds=_client(path, 503))
    return _feed_rows(spark.read.format("remote_feeds").options(feeds=feeds, failures="keep").load())


@query(_FEED_SQL + " UNION ALL SELECT 'down', NULL, NULL, NULL, NULL, 'HttpError: status 500', NULL, NULL")
def feed_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds through the cache, and again from a service that has nothing: what was had comes from the cache, the feed that was down stays down."""
    path, feeds = _feeds(spark, sf_dir)
    cache, options = http.ResponseCache(spark, folder(spark, "cache")), {"feeds": feeds, "failures": "keep"}
    remote.register(spark, feeds=_client(path, 503))
    remote.through_cache(spark, "remote_feeds", options, cache).count()
    remote.register(spark, feeds=_client(folder(spark, "nothing"), 500))
    rows = remote.through_cache(spark, "remote_feeds", options, cache)
    none = F.lit(None).cast("string")
    down = rows.where("error is not null").select(F.get_json_object("slice", "$.name").alias("source"), *(none.alias(c) for c in ("url", "article_id", "published_at", "precision")), F.col("error").alias("title"), none.alias("lede"), none.alias("tags"))
    return _feed_rows(rows).unionByName(down)


_ITEM = "page int, pos int, sport string, item struct<id:long,published:string,headline:string,description:string,links:struct<web:struct<href:string>>,categories:array<struct<description:string>>>"
#: Tasks that read a sport's pages.
LANES = 48
_SPORTS = {"F": "nfl", "O": "nba", "P": "mlb"}
_NEWS_SQL = """
WITH n AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'nfl' WHEN 'O' THEN 'nba' ELSE 'mlb' END AS sport, o_orderkey AS i, o_orderdate + INTERVAL 10 HOUR AS day, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders),
d AS (SELECT *, CASE WHEN i % 40 <> 7 THEN day END AS t FROM n), z AS (SELECT sport, min(n) AS n FROM d WHERE t < TIMESTAMP '1998-08-05' GROUP BY 1),
k AS (SELECT d.*, 'http://' || d.sport || '/' || i % 1200 AS url FROM d LEFT JOIN z USING (sport) WHERE (z.n IS NULL OR d.n < z.n) AND i % 31 <> 5 AND (t IS NULL OR t <= TIMESTAMP '2000-12-20')),
f AS (SELECT url, min(n) AS n FROM k GROUP BY 1)
SELECT sha256(url) AS article_id, url, strftime(t, '%Y-%m-%d %H:%M:%S') AS published_at, CASE WHEN t IS NULL THEN 'unknown' ELSE 'minute' END AS precision, sport || ' ' || i AS title,
    CASE WHEN i % 3 <> 0 THEN ' d ' || i END AS lede, CAST(i AS VARCHAR) AS espn_id FROM k JOIN f USING (url, n)"""


def _news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as news items by status, newest first in pages, read until the window's start."""
    orders = read(spark, sf_dir, "orders")
    i, day = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    sport = F.element_at(F.create_map(*(F.lit(x) for pair in _SPORTS.items() for x in pair)), F.col("o_orderstatus"))
    href = F.when(i % 31 != 5, F.concat(F.lit("http://"), sport, F.lit("/"), (i % 1200).cast("string")))
    item = F.to_json(F.struct(
        i.alias("id"), F.when(i % 40 != 7, F.date_format(day, "yyyy-MM-dd'T'10:00:00'Z'")).alias("published"), F.concat(sport, F.lit(" "), i.cast("string")).alias("headline"), F.when(i % 3 == 0, "").otherwise(F.concat(F.lit(" d "), i.cast("string"))).alias("description"),
        F.struct(F.struct(href.alias("href")).alias("web")).alias("links"), F.array(F.struct(sport.alias("description"))).alias("categories"),
    ))
    told = _paged(orders.select(sport.alias("sport"), (-times.seconds(day)).alias("age"), i.alias("i"), item.alias("item")), ["sport"], ["age", "i"], remote.NEWS_PAGE)
    last = told.groupBy("sport").agg((F.max("page") + 1).alias("pages"))
    url = F.concat(F.lit(f"{remote.NEWS_URL}/"), F.col("sport"), F.lit("/news"))
    answers = told.join(last, "sport").select(_key("GET", url, f'{{"limit":{remote.NEWS_PAGE},"page":%d}}', F.col("page") + 1).alias("key"), F.concat(F.lit('{"pageCount":'), F.col("pages").cast("string"), F.lit(',"articles":'), "items", F.lit("}")).alias("body"))
    remote.register(spark, news=_client(_recorded(spark, "news", answers), 404))
    rows = spark.read.format("remote_news").options(sports=",".join(_SPORTS.values()), start="1998-08-05", lanes=str(LANES)).load()
    items = staging.written(rows.select(F.from_json("payload", _ITEM).alias("n")).select("n.*"), "news-items")
    items = news.before_the_end(items).select("page", "pos", "sport", "item.*")
    return news.espn_articles(items, "1998-08-05", "2000-12-20")


@query(_NEWS_SQL)
def news_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News pages until the window's start; undated items stay, one of each link."""
    return _news(spark, sf_dir).select("article_id", "url", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"), F.col("timestamp_precision").alias("precision"), "title", "lede", F.get_json_object("raw_metadata_json", "$.espn_id").alias("espn_id"))


#: Years whose games are asked for; a season's games lie in two of them.
YEARS = range(1995, 2002)
_GAMES_SQL = """
WITH g AS (SELECT o_orderkey AS g, o_custkey AS c, strftime(o_orderdate, '%Y-%m-%d') AS d, 80 + o_orderkey % 40 AS p, o_orderkey % 3 <> 0 AS won FROM orders)
SELECT 'https://www.nba.com/game/G' || g AS url, d || ' 23:59:00' AS published_at, 'Home ' || c || ' ' || p || ' - 91 Away ' || c || ' (' || d || ')' AS title,
    CASE WHEN won THEN 'Game result: Home ' || c || ' defeated Away ' || c || ' ' || p || '-91' ELSE 'Game result: Away ' || c || ' defeated Home ' || c || ' 91-' || p END AS lede FROM g"""


def _games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as games of seasons, two log rows each, in either order; the log is asked for day by day."""
    i, day, who = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_custkey").cast("string")
    row = lambda side, sign, won, points: F.to_json(F.array(F.concat(F.lit("G"), i.cast("string")), F.concat(F.lit(f"{side} "), who), F.lit(f"A {sign} B"), won, points.cast("string"), day))
    home, away = row("Home", "vs.", F.when(i % 3 != 0, "W").otherwise("L"), 80 + i % 40), row("Away", "@", F.when(i % 3 != 0, "L").otherwise("W"), F.lit(91))
    pair = F.when(i % 2 == 0, F.concat(home, F.lit(","), away)).otherwise(F.concat(away, F.lit(","), home))
    year = F.year("o_orderdate")
    kind = F.when(i % 4 == 0, remote.SEASON_TYPES[1]).otherwise(remote.SEASON_TYPES[0])
    asked = F.date_format("o_orderdate", "MM/dd/yyyy").alias("date")
    told = read(spark, sf_dir, "orders").select(F.format_string("%d-%02d", year, (year + 1) % 100).alias("season"), kind.alias("kind"), asked, pair.alias("pair")).groupBy("season", "kind", "date").agg(F.array_join(F.collect_list("pair"), ",").alias("rows"))
    data = '{"Counter":0,"DateFrom":"%s","DateTo":"%s","Direction":"ASC","LeagueID":"00","PlayerOrTeam":"T","Season":"%s","SeasonType":"%s","Sorter":"DATE"}'
    body = F.concat(F.lit('{"resultSets":[{"headers":["GAME_ID","TEAM_NAME","MATCHUP","WL","PTS","GAME_DATE"],"rowSet":['), "rows", F.lit("]}]}"))
    path = _recorded(spark, "games", told.select(_key("GET", remote.GAMES_URL, data, F.col("date"), F.col("date"), F.col("season"), F.col("kind")).alias("key"), body.alias("body")))
    remote.register(spark, news=_client(path, {"resultSets": [{"headers": ["GAME_ID", "TEAM_NAME", "MATCHUP", "WL", "PTS", "GAME_DATE"], "rowSet": []}]}))
    rows = spark.read.format("remote_games").options(seasons=",".join(f"{y}-{(y + 1) % 100:02d}" for y in YEARS), days="1").load()
    return news.game_articles(news.game_rows(rows.select(F.from_json("payload", "headers array<string>, rowSet array<array<string>>").alias("p")).select("p.*")))


@query(_GAMES_SQL)
def game_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of both kinds of all seasons' games, from two log rows each."""
    return _games(spark, sf_dir).select("url", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"), "title", "lede")


@query(f"""
WITH e AS ({_NEWS_SQL}), g AS ({_GAMES_SQL}), p AS (SELECT DISTINCT sha256('http://nfl/' || page_id) AS a FROM pages), u AS (SELECT article_id, 'espn' AS source FROM e UNION ALL SELECT sha256(url), 'nba_stats' FROM g
    UNION ALL SELECT a, 'feed' FROM p WHERE a NOT IN (SELECT article_id FROM e))
SELECT source, count(*) AS articles, min(article_id) AS least FROM u GROUP BY 1""")
def category_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A category's sources composed: news before games before feeds, here the pages', one article of each id."""
    url = F.concat(F.lit("http://nfl/"), F.col("page_id").cast("string"))
    feed = read(spark, sf_dir, "pages").select(texts.key_of(url).alias("article_id"), F.lit("feed").alias("source"), url.alias("url"), F.lit("day").alias("timestamp_precision"))
    # every source is written before the next one registers its recorded answers
    own = [staging.written(df, "composed") for df in (_news(spark, sf_dir), _games(spark, sf_dir))]
    return runs.feeds(*own, feed).groupBy("source").agg(F.count("*").alias("articles"), F.min("article_id").alias("least"))


@query("""
WITH i AS (SELECT doc_id AS i, n_chars FROM documents), t AS (SELECT i % 300 AS u, min(i) AS first FROM i GROUP BY 1)
SELECT 'a' || i AS article_id, CASE WHEN i % 3 = 0 THEN 'own' WHEN i % 10 <> 9 THEN 'Text of ' || first END AS body_text, CASE WHEN i % 3 = 0 THEN NULL WHEN i % 4 = 0 THEN 'kept' WHEN i % 10 <> 9 THEN 'Text of ' || first END AS lede,
    i % 3 = 0 OR i % 10 <> 9 AS text_available FROM i JOIN t ON i % 300 = u""")
def page_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles: those without text get their pages', fetched once each and then from the cache; those with text are left alone."""
    docs, none = read(spark, sf_dir, "documents"), F.lit(None).cast("string")
    i = F.col("doc_id")
    page = docs.groupBy((i % 300).alias("u")).agg(F.min("doc_id").alias("first"))
    html = F.concat(F.lit("<html><nav>menu</nav><article><p>Text of "), F.col("first").cast("string"), F.lit("</p></article></html>"))
    address = lambda u: F.concat(F.lit("http://x/page/"), u.cast("string"))
    path = _recorded(spark, "pages", page.select(_key("GET", address(F.col("u")), "{}").alias("key"), html.alias("body")))
    url = F.when(i % 10 == 9, F.concat(F.lit("http://down/"), i.cast("string"))).otherwise(address(i % 300))
    given = docs.select(F.concat(F.lit("a"), i.cast("string")).alias("article_id"), url.alias("url"), F.when(i % 3 == 0, "own").alias("body_text"), F.when((i % 3 != 0) & (i % 4 == 0), "kept").otherwise(none).alias("lede"), (i % 3 == 0).alias("text_available"))
    articles = schemas.conform(given, schemas.ARTICLE)
    cache = http.ResponseCache(spark, folder(spark, "fetched"))
    remote.fetched_pages(articles, cache, _client(path, 503)).count()
    return pages.enriched(articles, remote.fetched_pages(articles, cache, _client(folder(spark, "nothing"), 503))).select("article_id", "body_text", "lede", "text_available")


@query("SELECT r_name AS category, n_name AS tag, CAST(row_number() OVER (ORDER BY r_name, n_name) - 1 AS INTEGER) AS place FROM nation JOIN region ON n_regionkey = r_regionkey")
def config_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as categories and their nations as tags: written as a configuration text, read, and listed in configured order."""
    both = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    own = both.groupBy("r_name").agg(F.array_sort(F.collect_list("n_name")).alias("tags")).orderBy("r_name").collect()  # a configuration is for the driver
    found = lake.config(json.dumps({"categories": {r["r_name"]: {"tags": r["tags"]} for r in own}}))
    pairs = [(c, t) for c, tags in found["categories"].items() for t in tags["tags"]]
    return lake.literal_rows(spark, [(c, t, n) for n, (c, t) in enumerate(pairs)], "category string, tag string, place int")
