import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import times
from tidemark.operators import news
from tidemark.sources import http, lake, remote


def test_bucket_waits_only_when_empty():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    bucket = http.TokenBucket(2.0, 3, clock=lambda: now[0], sleep=sleep)
    for _ in range(3):
        bucket.acquire()
    assert slept == []
    bucket.acquire()
    assert slept == [0.5]


def test_retry():
    waits, calls = [], []

    def what(errors):
        def once():
            calls.append(1)
            if errors:
                raise errors.pop(0)
            return "ok"

        return once

    retry = http.Retry(3, 2, 5, (429,))
    assert retry.call(what([http.HttpError(429), http.HttpError(429)]), waits.append) == "ok" and waits == [2, 4]
    with pytest.raises(http.HttpError):
        retry.call(what([http.HttpError(500)]), waits.append)
    with pytest.raises(http.HttpError):
        retry.call(what([http.HttpError(429)] * 3), waits.append)
    with pytest.raises(OSError):
        retry.call(what([OSError()]), waits.append)
    assert http.Retry(2, 1, 2, (), True).call(what([TimeoutError()]), waits.append) == "ok"


def test_market_pages():
    pages = {0: [{"id": i} for i in range(100)], 100: [{"id": 100}]}
    seen = []

    def client(method, url, data):
        seen.append(data)
        if data["tag"] == "bad":
            raise http.HttpError(422)
        return pages[data["offset"]]

    assert len(list(remote.market_pages(client, "http://m", "nba", True, "2024-08-01", None))) == 101
    assert seen[0] == {"tag": "nba", "closed": "true", "limit": 100, "offset": 0, "end_date_min": "2024-08-01"}
    assert list(remote.market_pages(client, "http://m", "bad", True, None, None)) == []
    def down(method, url, data):
        raise http.HttpError(500)

    with pytest.raises(http.HttpError):  # an error that isn't the scan's end is no end
        list(remote.market_pages(down, "http://m", "nba", True, None, None))
    assert remote.market(lambda m, u, d: {"u": u}, "http://m", "c") == {"u": "http://m/markets/c"}


def service(fills):
    """A fill service that keeps to the query's cursor."""
    def client(method, url, data):
        v = data["variables"]
        cursor = int(v["ts"]), int(v["li"])
        found = [f for f in fills if (int(f["timestamp"]), int(f["logIndex"])) > cursor and int(f["timestamp"]) < int(v["end"])]
        found.sort(key=lambda f: (int(f["timestamp"]), int(f["logIndex"])))
        return {"data": {"orderFilledEvents": found[: v["first"]]}}

    return client


def test_no_fill_is_lost_between_pages():
    fills = [{"transactionHash": f"t{i}", "logIndex": str((i * 7) % 11), "timestamp": str(100 + i // 5)} for i in range(60)]
    got = list(remote.fill_pages(service(fills), "u", "tok", "maker", 101, 110, page=4))
    assert sorted(f["transactionHash"] for f in got) == sorted(f["transactionHash"] for f in fills if 101 <= int(f["timestamp"]) < 110)
    assert "makerAssetId: $token" in remote.fill_query("maker") and "takerAssetId: $token" in remote.fill_query("taker")


def test_news_stops_at_the_start():
    items = [[{"published": "2024-09-02"}, {}], [{"published": "2024-08-05"}, {"published": "2024-07-01"}, {"published": "2024-09-09"}]]
    client = lambda m, u, d: {"pageCount": 2, "articles": items[d["page"] - 1]}
    assert [(p, n) for p, n, _ in remote.news_pages(client, "s", "2024-08-01")] == [(1, 0), (1, 1), (2, 0)]


def fake(answer):
    return lambda slices: (lambda method, url, data: answer(url, data))


def test_readers(spark):
    def markets(url, data):
        if data["tag"] == "down":
            raise OSError("down")
        return [{"conditionId": f"{data['tag']}-1", "tags": []}]

    def games(url, data):
        return {"resultSets": [{"headers": ["GAME_ID", "TEAM_NAME", "MATCHUP", "WL", "PTS", "GAME_DATE"], "rowSet": [[data["SeasonType"][:3], "A", "A vs. B", "W", 3, "2024-08-01"]]}]}

    remote.register(
        spark, markets=fake(markets), fills=fake(lambda u, d: {"data": {"orderFilledEvents": [{"transactionHash": d["variables"]["token"], "logIndex": "1", "timestamp": "5"}]}}),
        news=fake(lambda u, d: games(u, d) if "leaguegamelog" in u else {"articles": [{"headline": "h", "published": "2024-09-01T00:00:00Z"}]}), feeds=fake(lambda u, d: f"<rss>{u}</rss>".encode()),
    )
    read = lambda name, **o: spark.read.format(name).options(**o).load()
    rows = read("remote_markets", url="http://m", tags="nba,down", failures="keep").collect()
    assert [json.loads(r["payload"])["conditionId"] for r in rows if r["payload"]] == ["nba-1"]
    assert [r["error"] for r in rows if r["error"]] == ["OSError: down"]
    with pytest.raises(Exception, match="down"):
        read("remote_markets", url="http://m", tags="down").collect()
    fills = read("remote_fills", url="http://f", tokens="a,b", start="0", end="100", slice_seconds="60")
    assert fills.count() == 8 and fills.rdd.getNumPartitions() == 8
    slices = [json.loads(r["slice"]) for r in fills.collect()]
    assert {(s["token"], s["token_rank"], s["side"], s["side_rank"]) for s in slices} == {("a", 0, "maker", 0), ("a", 0, "taker", 1), ("b", 1, "maker", 0), ("b", 1, "taker", 1)}
    assert json.loads(read("remote_news", sports="x/y", start="2024-08-01").first()["payload"])["item"]["headline"] == "h"
    log = read("remote_games", seasons="2024-25").select(F.from_json("payload", "headers array<string>, rowSet array<array<string>>").alias("p")).select("p.*")
    assert sorted(r["GAME_ID"] for r in news.game_rows(log).collect()) == ["Pla", "Reg"]
    assert json.loads(read("remote_feeds", feeds='[{"url":"u","name":"n"}]').first()["payload"]) == {"feed_url": "u", "source": "n", "xml": "<rss>u</rss>"}


def test_response_cache(spark, tmp_path):
    cache = http.ResponseCache(spark, str(tmp_path / "cache"))
    key = http.cache_key("markets", {"b": 1, "a": "x'y"})
    assert key == http.cache_key("markets", {"a": "x'y", "b": 1}) and cache.get(key) is None
    cache.put([(key, "one")])
    cache.put([(key, "two"), ("other", "three")])
    assert cache.get(key) == "one"
    keys = spark.createDataFrame([(key,), ("new",)], "key string")
    assert [r["key"] for r in cache.missing(keys).collect()] == ["new"]


def test_lake_round_trips(spark, tmp_path):
    path = lambda x: str(tmp_path / x)
    when = dt.datetime(2024, 8, 5)
    market = {"market_id": "m", "category": "nba", "tags": ["a", "b"], "created_at": when, "end_at": when, "is_primary_sample": True}
    markets = spark.createDataFrame([[market.get(c) for c in schemas.MARKET.names]], schemas.MARKET)
    lake.write_universe(markets, path("u"))
    assert (tmp_path / "u/_SUCCESS").exists()
    back = lake.read_universe(spark, path("u")).first()
    assert back["tags"] == ["a", "b"] and back["end_at"] == when
    lake.write_universe(markets.limit(0), path("empty"))
    assert lake.read_universe(spark, path("empty")).columns == schemas.MARKET.names
    trades = spark.createDataFrame([("m", 1), ("zz", 2)], "market_id string, ts_s long")
    lake.write_trades(trades, markets, path("t"))
    assert (tmp_path / "t/category=nba/year=2024/month=08").exists()
    assert [r["month"] for r in lake.table(spark, path("t"), schemas.TRADE, lake.LAYOUT["trades"]).collect()] == ["08"]
    lake.write_bars(spark.createDataFrame([("m", 60)], "market_id string, ts_min long"), markets, path("b"))
    gkg = spark.createDataFrame([["1", 20240801000000, "http://g", *[None] * 7], ["2", None, "http://h", *[None] * 7]], schemas.GKG)
    lake.write_gkg(gkg, path("g"))
    assert (tmp_path / "g/year=unknown/month=unknown").exists() and (tmp_path / "g/year=2024/month=08").exists()
    article = {"article_id": "a", "source": "espn", "url": "u", "published_at": when, "timestamp_precision": "minute"}
    articles = spark.createDataFrame([[(article | x).get(c) for c in schemas.ARTICLE.names] for x in ({}, {"article_id": "b", "published_at": None, "timestamp_precision": "day", "raw_metadata_json": '{"date_int": 20240102030405}'}, {"article_id": "c", "published_at": None, "timestamp_precision": "day"})], schemas.ARTICLE)
    lake.write_feeds(articles, path("f"))
    assert (tmp_path / "f/source=espn/year=unknown/month=unknown").exists()
    assert lake.read_corpus(spark, path("none"), path("f"), path("g")).count() == 5
    lake.write_corpus(articles, path("c"))
    assert sorted(p.name for p in (tmp_path / "c").glob("year=*/month=*")) == ["month=01", "month=08", "month=unknown"]
    assert lake.read_corpus(spark, path("c"), path("f"), path("g")).count() == 3
    assert lake.read_corpus(spark, path("no"), path("no"), path("no")).count() == 0
    made = lake.register_views(spark, {"root": "x", "markets": {"universe": path("u"), "trades": path("t"), "bars_1min": path("b")}, "news": {"gdelt_gkg": path("nope"), "feeds": path("f")}})
    assert made == ["universe", "trades", "bars_1min", "feed_articles"]
    assert lake.sql(spark, "SELECT count(*) AS n FROM feed_articles WHERE month = '08'").first()["n"] == 1
    plan = lake.table(spark, path("t"), schemas.TRADE, lake.LAYOUT["trades"]).where(lake.partition_filter(month="08"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_config(spark):
    assert lake.config('{"a": [1]}') == {"a": [1]}
    assert lake.config("a: [1]\n", parse=lambda t: {"a": [1]}) == {"a": [1]}
    assert lake.literal_rows(spark, [("x", 1)], "k string, v int").first()["v"] == 1


def test_rules(spark):
    rows = spark.createDataFrame([(0.5, 0.0, "YES_BUY"), (0.0, 0.0, "YES_BUY"), (1.0, 0.0, "YES_BUY"), (0.5, 0.1, "X"), (None, None, None)], "price_raw double, log_odds double, side string")
    told = [r["violations"] for r in schemas.with_violations(rows, "trade").collect()]
    assert told == [[], ["price", "log_odds"], ["price", "log_odds"], ["log_odds", "side"], ["price", "log_odds", "side"]]
    good, bad = schemas.split_valid(rows, "trade")
    assert (good.count(), bad.count()) == (1, 4)
    events = spark.createDataFrame([("day", True, 0), ("minute", True, 1), ("day", False, 5)], "precision string, included_in_hawkes_likelihood boolean, directional_impact int")
    assert [r["violations"] for r in schemas.with_violations(events, "news_event").collect()] == [["eligibility"], [], ["impact"]]
    market = spark.createDataFrame([("m", "YES", "other", None, None)], "market_id string, resolved_outcome string, market_type string, created_at timestamp, end_at timestamp")
    assert schemas.with_violations(market, "market").first()["violations"] == ["required"]


def test_partition_keys(spark):
    row = spark.range(1).select(*times.number_year_month(F.lit(20240801)), *times.number_year_month(F.lit(0)), *times.year_month(F.lit(None).cast("timestamp"))).first()
    assert list(row) == ["2024", "08", "unknown", "unknown", "unknown", "unknown"]


def test_recorded_answers_and_what_is_missing(spark, tmp_path):
    """A recorded transport answers known requests, JSON or not, whatever the parameters' order; others get the status or the body that it was given."""
    rows = [(http.cache_key("GET", "u", {"b": 1, "a": "x"}), '{"n": 1}'), (http.cache_key("GET", "page", {}), "<p>text</p>")]
    rows += [(http.cache_key("GET", f"many/{i}", {}), f"[{i}]") for i in range(300)]
    path = str(tmp_path / "answers")
    http.record(spark.createDataFrame(rows, "key string, body string"), path)
    ask = http.Recorded(path)
    assert ask("GET", "u", {"a": "x", "b": 1}) == {"n": 1} and ask("GET", "page", {}) == b"<p>text</p>"
    assert [ask("GET", f"many/{i}", {}) for i in range(0, 300, 50)] == [[i] for i in range(0, 300, 50)]
    with pytest.raises(http.HttpError):
        ask("GET", "other", {})
    assert http.Recorded(str(tmp_path / "nothing"), {"x": []})("GET", "other", {}) == {"x": []}


@pytest.mark.parametrize("status,again", [(404, False), (503, True), (429, True)])
def test_pages_that_fail_for_now_are_fetched_again(spark, tmp_path, status, again):
    """A page that isn't there is kept as looked at; one that failed for a passing error isn't, and the next run has it."""
    articles = spark.createDataFrame([("good",), ("odd",), ("odd",), (None,), ("",)], "url string")
    cache = http.ResponseCache(spark, str(tmp_path / "cache"))

    def client(answers):
        path = str(tmp_path / f"answers{len(answers)}")
        http.record(spark.createDataFrame([(http.cache_key("GET", u, {}), b) for u, b in answers], "key string, body string"), path)
        return lambda slices: http.Client(http.Recorded(path, status), rate=1e6, burst=1e6, retry=http.Retry(1))

    first = remote.fetched_pages(articles, cache, client([("good", "<p>a</p>")]))
    assert {r.url: r.html for r in first.collect()} == {"good": "<p>a</p>", "odd": None}
    second = remote.fetched_pages(articles, cache, client([("good", "<p>b</p>"), ("odd", "<p>c</p>")]))
    assert {r.url: r.html for r in second.collect()} == {"good": "<p>a</p>", "odd": "<p>c</p>" if again else None}
