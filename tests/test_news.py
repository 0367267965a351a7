import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import texts, times
from tidemark.operators import news, pages
from tidemark.plans import runs

RSS = "feed_url string, source string, xml string"
XML = """<rss><channel><title>t</title>
<item><title>One</title><link>http://x/1</link><description>{words}</description><pubDate>Thu, 01 Aug 2024 12:30:00 GMT</pubDate><guid>g1</guid></item>
<item><title>Two</title><link>http://x/2</link></item>
<item><title>No link</title></item>
<item><link>http://x/3</link><description>   </description><pubDate>02 Aug 2024 01:00:00 +0200</pubDate></item></channel></rss>"""


def gkg(spark, *rows):
    fill = lambda r: [r.get(c) for c in schemas.GKG.names]
    return spark.createDataFrame([fill(r) for r in rows], schemas.GKG)


def test_gkg_articles(spark):
    rows = gkg(
        spark,
        {"GKGRECORDID": "1", "DATE": 20240801120000, "DocumentIdentifier": "http://a", "SourceCommonName": "a.com", "V2Themes": "SPORTS; FOOTBALL_NFL ;;", "V2Persons": "Patrick Mahomes,12;Andy Reid,80;plain", "V2Organizations": "Kansas City Chiefs,3;NFL,9;Andy Reid,1;,12"},
        {"GKGRECORDID": "2", "DocumentIdentifier": "", "V2Persons": "X,1"},
        {"GKGRECORDID": "3", "DocumentIdentifier": "http://é"},
    )
    found = {r["url"]: r for r in news.gkg_articles(rows).collect()}
    assert set(found) == {"http://a", "http://é"}
    a = found["http://a"]
    assert a["themes"] == ["SPORTS", "FOOTBALL_NFL"] and a["entities"] == ["Patrick Mahomes", "Andy Reid", "Kansas City Chiefs", "NFL", ""]
    assert (a["published_at"], a["timestamp_precision"], a["text_available"], a["title"], a["lede"]) == (None, "day", False, "http://a", None)
    assert json.loads(a["raw_metadata_json"]) == {"gkg_record_id": "1", "date_int": 20240801120000, "v2tone": "", "v2locations": "", "sharing_image": ""}
    assert json.loads(found["http://é"]["raw_metadata_json"])["date_int"] == 0 and found["http://é"]["entities"] == []


def test_gkg_window(spark):
    rows = gkg(spark, *({"GKGRECORDID": str(i), "DATE": d, "V2Persons": p, "V2Organizations": o} for i, (d, p, o) in enumerate([(20240801000000, "x", "about INFLATION,1"), (20240831235959, None, "NFL,1"), (20240901000000, "NFL", None), (20240815000000, "a+b", None), (20240815000000, None, None)])))
    ids = lambda *terms: sorted(r[0] for r in news.gkg_window(rows, "2024-08-01", "2024-08-31", terms).collect())
    assert ids("NFL") == ["0", "1"] and ids("a+B", "zz") == ["3"] and ids() == ["0", "1", "3", "4"]
    assert [tuple(r) for r in news.coverage(rows.withColumn("SourceCommonName", F.lit("s"))).collect()] == [(5, 1, 2)]


def test_rss(spark):
    words = " ".join(f"w{i}" for i in range(200))
    feeds = spark.createDataFrame([("u", "src", XML.replace("{words}", words)), ("v", "none", "<rss><channel></channel></rss>")], RSS)
    found = {r["url"]: r for r in news.rss_articles(feeds).collect()}
    assert set(found) == {"http://x/1", "http://x/2", "http://x/3"}
    one, two, three = (found[f"http://x/{i}"] for i in (1, 2, 3))
    assert (one["published_at"], one["timestamp_precision"], one["title"]) == (dt.datetime(2024, 8, 1, 12, 30), "minute", "One")
    assert one["lede"].split() == [f"w{i}" for i in range(150)] and json.loads(one["raw_metadata_json"]) == {"feed_url": "u", "entry_id": "g1", "tags": []}
    assert (two["published_at"], two["timestamp_precision"], two["lede"]) == (None, "day", None)
    assert three["published_at"] == dt.datetime(2024, 8, 1, 23, 0) and three["title"] == "http://x/3" and three["lede"] is None


def test_ill_formed_feeds_give_what_can_be_read(spark):
    xml = "<rss><item><title>A&nbsp;&amp;&bad; <b>b</title><link>http://x/1</link><category>c &lt;1</category><category term='t2'/></item><item><link>http://x/2</link><title>cut" \
        "<item><title/><link><![CDATA[ http://x/3 ]]></link></item><entry><link rel='a' href='http://x/4'/><id>i</id><updated>2024-08-01T00:00:00Z</updated></entry><item>"
    found = {r["url"]: r for r in news.rss_articles(spark.createDataFrame([("u", "s", xml), ("v", "s", None), ("w", "s", "no feed")], RSS)).collect()}
    assert set(found) == {f"http://x/{i}" for i in range(1, 5)}
    assert found["http://x/1"]["title"] == "A &&bad; <b>b" and json.loads(found["http://x/1"]["raw_metadata_json"])["tags"] == ["t2", "c <1"]
    assert found["http://x/4"]["timestamp_precision"] == "minute" and json.loads(found["http://x/4"]["raw_metadata_json"])["entry_id"] == "i"


ITEMS = "sport string, page int, pos int, id long, published string, headline string, description string, links struct<web:struct<href:string>>, categories array<struct<description:string>>"


def test_espn(spark):
    item = lambda pos, when, link, text="d": ("football/nfl", 1, pos, pos, when, None, text, ((link,),), [("NFL",), (None,)])
    items = spark.createDataFrame([item(0, "2025-06-01T00:00:01Z", "http://late"), item(1, "2025-06-01T00:00:00Z", "http://a"), item(2, "2024-09-01T10:00:00Z", "http://a"), item(3, None, "http://b", ""), item(4, "2024-07-31T23:59:59Z", "http://early"), item(5, "bad", None)], ITEMS)
    found = {r["url"]: r for r in news.espn_articles(items, "2024-08-01", "2025-06-01").collect()}
    assert set(found) == {"http://a", "http://b"}
    assert found["http://a"]["published_at"] == dt.datetime(2025, 6, 1) and found["http://a"]["timestamp_precision"] == "minute"
    assert (found["http://b"]["timestamp_precision"], found["http://b"]["lede"], found["http://b"]["title"]) == ("unknown", None, "http://b")
    assert json.loads(found["http://a"]["raw_metadata_json"]) == {"espn_id": "1", "sport": "football/nfl", "categories": ["NFL", ""]}
    assert "http://late" in {r["url"] for r in news.espn_articles(items, "2024-08-01", "2025-06-01", end_inclusive=True).collect()}
    assert schemas.with_violations(news.espn_articles(items, "2024-08-01", "2025-06-01"), "article").where(F.size("violations") > 0).count() == 0


def games(spark, *rows):
    return news.game_rows(spark.createDataFrame([(["GAME_ID", "TEAM_NAME", "MATCHUP", "WL", "PTS", "GAME_DATE"], [list(r) for r in rows])], "headers array<string>, rowSet array<array<string>>"))


def test_games(spark):
    rows = games(spark, ("g1", "Boston Celtics", "BOS @ LAL", "L", "98", "2024-08-01"), ("g1", "Los Angeles Lakers", "LAL vs. BOS", "W", "112", "2024-08-01"), ("g2", "Solo", "odd", None, "5", "bad"), ("g3", "A", "A vs. B", None, "1", "2024-08-02"), ("g3", "B", "B @ A", "W", "2", "2024-08-02"))
    found = {r["url"].rpartition("/")[2]: r for r in news.game_articles(rows).collect()}
    assert found["g1"]["title"] == "Los Angeles Lakers 112 - 98 Boston Celtics (2024-08-01)"
    assert found["g1"]["lede"] == "Game result: Los Angeles Lakers defeated Boston Celtics 112-98"
    assert found["g1"]["published_at"] == dt.datetime(2024, 8, 1, 23, 59) and found["g1"]["timestamp_precision"] == "day"
    assert found["g2"]["published_at"] is None and found["g2"]["entities"] == ["Solo", "Solo"]
    assert found["g3"]["lede"] == "Game result: B defeated A 2-1"


def article(spark, *rows):
    base = {"title": "t", "text_available": False, "entities": [], "themes": []}
    return spark.createDataFrame([[(base | r).get(c) for c in schemas.ARTICLE.names] for r in rows], schemas.ARTICLE)


def test_unified(spark):
    now = dt.datetime(2024, 8, 1)
    feed = article(spark, {"article_id": "s", "source": "espn", "published_at": now, "timestamp_precision": "minute"}, {"article_id": "f", "source": "espn", "timestamp_precision": "day"})
    stubs = article(spark, {"article_id": "s", "source": "gdelt", "timestamp_precision": "day"}, {"article_id": "g", "source": "gdelt", "timestamp_precision": "day"})
    found = {r["article_id"]: r["source"] for r in news.unified(feed, stubs).collect()}
    assert found == {"s": "espn", "f": "espn", "g": "gdelt"}
    assert news.unified(feed.limit(0), stubs).count() == 2
    bad = article(spark, {"article_id": "b", "timestamp_precision": "minute"})
    with pytest.raises(Exception, match="minute_without_time"):
        news.unified(bad, stubs).collect()
    assert {r["source"] for r in runs.feeds(feed, stubs, None).where("article_id = 's'").collect()} == {"espn"}


def test_precision_report(spark):
    df = spark.createDataFrame([("a", "minute"), ("a", "day"), ("b", "day"), ("b", "unknown")], "source string, timestamp_precision string")
    assert sorted(map(tuple, news.precision_report(df).collect()), key=str) == sorted([("a", 2, 50.0, 50.0), ("b", 2, 0.0, 50.0), (None, 4, 25.0, 50.0)], key=str)


def test_text_functions_are_pythons(spark):
    samples = ["\ta b\n c ", "\xa0x y\x1cz\x85", "", None, "one", "a​b"]
    rows = spark.createDataFrame(list(enumerate(samples)), "i int, t string").select("i", texts.words(F.col("t")), texts.stripped(F.col("t")), texts.lede(F.col("t"), 2)).collect()
    for r in rows:
        t = samples[r[0]]
        assert r[1] == (None if t is None else t.split()) and r[2] == (None if t is None else t.strip())
        assert r[3] == (" ".join((t or "").split()[:2]) or None)
    row = spark.range(1).select(texts.joined_text(F.lit("é" * 2000), F.lit("b" * 100)), texts.joined_text(F.lit(None), F.lit("x")), texts.season(F.lit("2024-08-01").cast("date")), texts.from_json_list(F.lit(None)), F.to_json(texts.from_json_list(F.lit('["a","b"]')))).first()
    assert row[0] == ("é" * 2000 + " " + "b" * 100)[:2048] and list(row)[1:] == [" x", "2024-25", [], '["a","b"]']


def test_times(spark):
    row = spark.range(1).select(*(times.iso(F.lit(x)) for x in ("2024-08-01T10:00:00Z", "", "nope", "2024-08-01T10:00:00+02:00")), *(times.rss(F.lit(x)) for x in ("Thu, 1 Aug 2024 10:00:00 +0000", "x")), times.days_between(F.lit("2024-01-02").cast("timestamp"), F.lit("2024-01-01 12:00").cast("timestamp")), times.as_number(F.lit("2024-08-01 01:02:03").cast("timestamp"))).first()
    assert list(row) == [dt.datetime(2024, 8, 1, 10), None, None, dt.datetime(2024, 8, 1, 8), dt.datetime(2024, 8, 1, 10), None, -1, 20240801010203]


def test_main_text_and_enrichment(spark):
    html = "<html><head><title>no</title></head><body><nav>menu<br>x</nav><article><h1>Head</h1><p>Para&nbsp;one<script>1</script></article><footer>foot</footer></body></html>"
    assert pages.main_text(html) == "Head\nPara one"
    assert pages.main_text("<p>a<p>b<aside>c</aside>") == "a\nb" and pages.main_text("<nav>only</nav>") == "only"
    assert pages.main_text("") is None and pages.main_text(None) is None and pages.main_text("<<<>&amp") is not None
    rows = article(spark, {"article_id": "1", "url": "u1"}, {"article_id": "2", "url": "u2", "text_available": True, "body_text": "own", "lede": None}, {"article_id": "3", "url": "u3", "lede": "kept"}, {"article_id": "4", "url": "gone"})
    fetched = spark.createDataFrame([("u1", html), ("u1", html), ("u2", html), ("u3", html)], "url string, html string")
    found = {r["article_id"]: r for r in pages.enriched(rows, fetched).collect()}
    assert len(found) == 4 and pages.enriched(rows, fetched).columns == rows.columns
    assert (found["1"]["lede"], found["1"]["text_available"]) == ("Head Para one", True)
    assert (found["2"]["body_text"], found["2"]["lede"]) == ("own", None) and found["3"]["lede"] == "kept" and found["3"]["body_text"]
    assert found["4"]["text_available"] is False and found["4"]["body_text"] is None


def test_pages_without_an_article_go_to_the_second_extractor():
    """Without an article the densest stretch of blocks is the text; link lists and short blocks around it stay out; where nothing is dense, the body."""
    story = ["The first paragraph of the story tells at length what came about that day.", "Then <a href='x'>someone</a> said something, which is told here in a second paragraph."]
    links = "".join(f"<li><a href='/{i}'>A link to some other story number {i} that is long</a></li>" for i in range(6))
    page = f"<html><head><title>t</title></head><body><div>Menu</div><ul>{links}</ul><div><p>{story[0]}</p><p>{story[1]}</p></div><div>Share</div><ul>{links}</ul><footer>All rights reserved by whoever wrote this page.</footer></body></html>"
    assert pages.article_text(page) is None
    assert pages.main_text(page) == f"{story[0]}\nThen someone said something, which is told here in a second paragraph."
    assert pages.main_text(f"<main>Short</main>{page}") == "Short"
    assert pages.dense_text("<div>Menu</div><div>Short</div>") is None and pages.main_text("<div>Menu</div><div>Short</div>") == "Menu\nShort"
    assert pages.main_text("<nav>only this</nav>") == "only this" and pages.main_text("<p></p>") is None
