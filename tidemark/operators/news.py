"""Articles from news sources, and the corpus that they make."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import texts, times
from tidemark.operators.trades import first_of_each

NO_STRINGS = "array<string>"


def _article(rows: DataFrame, **columns: Column) -> DataFrame:
    """Articles with a url; what isn't given has the value of a bare stub."""
    given = {
        "article_id": texts.key_of(columns["url"]),
        "published_at": F.lit(None),
        "timestamp_precision": F.lit("day"),
        "lede": F.lit(None),
        "body_text": F.lit(None),
        "text_available": F.lit(False),
        "entities": F.array().cast(NO_STRINGS),
        "themes": F.array().cast(NO_STRINGS),
    } | columns
    kept = rows.where(F.coalesce(columns["url"], F.lit("")) != "")
    return kept.select(*(given[f.name].cast(f.dataType).alias(f.name) for f in schemas.ARTICLE))


def gkg_window(gkg: DataFrame, start: str, end: str, terms: Iterable[str]) -> DataFrame:
    """Rows from the start date to the end date, both included (yyyy-mm-dd), whose persons or organisations hold a term.

    Terms are found as they are, in any case and within words; without terms every row passes.
    """
    spark_day = lambda day, more: F.date_format(F.date_add(F.to_date(F.lit(day)), more), "yyyyMMdd").cast("long") * 1_000_000
    named = F.concat(F.coalesce("V2Persons", F.lit("")), F.lit(";"), F.coalesce("V2Organizations", F.lit("")))
    return gkg.where((F.col("DATE") >= spark_day(start, 0)) & (F.col("DATE") < spark_day(end, 1)) & named.rlike(texts.any_of(terms))).select(*schemas.GKG.names)


def gkg_articles(gkg: DataFrame) -> DataFrame:
    """Article stubs from knowledge-graph rows; their time is never a publication time, so it is null at day precision."""
    names = texts.merged(texts.names_with_offsets(F.col("V2Persons")), texts.names_with_offsets(F.col("V2Organizations")))
    text = lambda c: F.coalesce(c, F.lit(""))
    about = F.to_json(F.struct(text("GKGRECORDID").alias("gkg_record_id"), F.coalesce("DATE", F.lit(0)).alias("date_int"), text("V2Tone").alias("v2tone"), text("V2Locations").alias("v2locations"), text("SharingImage").alias("sharing_image")))
    url = F.col("DocumentIdentifier")
    return _article(gkg, url=url, source=text("SourceCommonName"), title=url, entities=names, themes=texts.split_list(F.col("V2Themes")), raw_metadata_json=about)


#: XML's entities and the blank of HTML, the ampersand's last so that nothing is read twice.
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&(?:apos|#39|#x27);", "'"), ("&(?:nbsp|#160|#xA0);", " "), ("&(?:amp|#38);", "&"))


def _plain(text: Column) -> Column:
    """The text of an element's content: without CDATA marks, entities read, blanks at the ends gone; null if nothing is left."""
    out = F.regexp_replace(text, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    for mark, value in _ENTITIES:
        out = F.regexp_replace(out, mark, value)
    return F.nullif(texts.stripped(out), F.lit(""))


def rss_articles(feeds: DataFrame) -> DataFrame:
    """Articles from feeds ``(feed_url, source, xml)``, of items or entries; undated ones have day precision and no time.

    Parts are found by patterns, not by an XML parser: an item with unknown entities, open elements or stray marks still
    gives what can be read, one without a part has a null there, and no item can fail the query.
    """
    items = feeds.select("feed_url", "source", F.explode(F.regexp_extract_all("xml", F.lit(r"(?s)<(item|entry)\b.*?(?:</\1\s*>|(?=<\1\b)|\z)"), F.lit(0))).alias("x"))
    inside = lambda name: _plain(F.regexp_extract("x", rf"(?is)<{name}\b(?:[^>]*[^/>])?>(.*?)</{name}\s*>", 1))
    link = F.coalesce(inside("link"), _plain(F.regexp_extract("x", r"(?is)<link\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)", 1)))
    terms = F.concat(
        F.regexp_extract_all("x", F.lit(r"(?is)<category\b[^>]*?\bterm\s*=\s*[\"']([^\"']*)"), F.lit(1)),
        F.regexp_extract_all("x", F.lit(r"(?is)<category\b(?:[^>]*[^/>])?>(.*?)</category\s*>"), F.lit(1)),
    )
    parts = {"link": link, "title": inside("title"), "summary": F.coalesce(inside("description"), inside("summary")), "date": F.coalesce(*map(inside, ("pubDate", "published", "updated", "dc:date"))), "guid": F.coalesce(inside("guid"), inside("id"))}
    items = items.select("feed_url", "source", *(c.alias(name) for name, c in parts.items()), F.transform(terms, lambda t: F.coalesce(_plain(t), F.lit(""))).alias("tags"))
    when = F.coalesce(times.rss(F.col("date")), times.iso(F.col("date")))
    about = F.to_json(F.struct("feed_url", F.coalesce("guid", F.lit("")).alias("entry_id"), "tags"))
    precision = F.when(when.isNull(), "day").otherwise("minute")
    return _article(items, url=F.col("link"), source=F.col("source"), published_at=when, timestamp_precision=precision, title=F.coalesce("title", "link"), lede=texts.lede(F.col("summary")), raw_metadata_json=about)


def before_the_end(items: DataFrame) -> DataFrame:
    """News items of several lanes of a sport up to where its news end: the first place without an item (``page, pos``) that a lane tells. Read twice."""
    ends = items.where("item is null").groupBy("sport").agg(F.min(F.struct("page", "pos")).alias("_end"))
    kept = items.where("item is not null").join(F.broadcast(ends), "sport", "left")  # a row for each sport
    return kept.where(F.col("_end").isNull() | (F.struct("page", "pos") < F.col("_end"))).drop("_end")


def espn_articles(items: DataFrame, start: str, end: str, end_inclusive: bool = False) -> DataFrame:
    """Articles from news items with ``sport``, within a window of dates; undated items pass.

    The end is midnight of the end date, so that day is cut unless ``end_inclusive``. An undated item has unknown precision. Of one
    link the first item (``page``, ``pos``) stays.
    """
    when = times.iso(F.col("published"))
    last = F.lit(end).cast("timestamp") + F.expr("interval 1 day") - F.expr("interval 1 microsecond") if end_inclusive else F.lit(end).cast("timestamp")
    link = F.col("links.web.href")
    kept = items.where((F.coalesce(link, F.lit("")) != "") & (when.isNull() | when.between(F.lit(start).cast("timestamp"), last))).withColumn("_link", link)
    kept = first_of_each(kept, ["_link"], ["page", "pos"])
    about = F.to_json(F.struct(F.col("id").cast("string").alias("espn_id"), "sport", F.transform("categories", lambda c: F.coalesce(c["description"], F.lit(""))).alias("categories")))
    precision = F.when(when.isNull(), "unknown").otherwise("minute")
    lede = F.nullif(F.col("description"), F.lit(""))
    return _article(kept, url=F.col("_link"), source=F.lit("espn"), published_at=when, timestamp_precision=precision, title=F.coalesce("headline", "_link"), lede=lede, raw_metadata_json=about)


def sides(rows: DataFrame, key: str, order: str, is_home: Column, is_away: Column) -> DataFrame:
    """``(key, home, away)`` as structs: the first row that is home, else the first; the first that is away, else the last."""
    row, place = F.struct(*rows.columns), F.col(order)
    first = lambda cond: F.min_by(F.when(cond, row), F.when(cond, place))
    return rows.groupBy(key).agg(F.coalesce(first(is_home), F.min_by(row, place)).alias("home"), F.coalesce(first(is_away), F.max_by(row, place)).alias("away"))


def game_articles(rows: DataFrame) -> DataFrame:
    """One article for each game from its two log rows (``GAME_ID, TEAM_NAME, MATCHUP, PTS, WL, GAME_DATE, pos``)."""
    games = sides(rows, "GAME_ID", "pos", F.contains("MATCHUP", F.lit("vs.")), F.contains("MATCHUP", F.lit("@")))
    won = F.coalesce(F.col("home.WL") == "W", F.lit(False))
    pick = lambda yes, c: F.when(won, F.col(f"{'home' if yes else 'away'}.{c}")).otherwise(F.col(f"{'away' if yes else 'home'}.{c}"))
    title = F.format_string("%s %s - %s %s (%s)", "home.TEAM_NAME", F.col("home.PTS").cast("string"), F.col("away.PTS").cast("string"), "away.TEAM_NAME", "home.GAME_DATE")
    lede = F.format_string("Game result: %s defeated %s %s-%s", pick(True, "TEAM_NAME"), pick(False, "TEAM_NAME"), pick(True, "PTS").cast("string"), pick(False, "PTS").cast("string"))
    about = F.to_json(F.struct(F.col("GAME_ID").alias("game_id"), F.col("home.TEAM_NAME").alias("home_team"), F.col("away.TEAM_NAME").alias("away_team"), F.col("home.PTS").alias("home_score"), F.col("away.PTS").alias("away_score"), F.col("home.GAME_DATE").alias("game_date")))
    return _article(
        games, url=F.concat(F.lit("https://www.nba.com/game/"), "GAME_ID"), source=F.lit("nba_stats"), published_at=times.game_end(F.col("home.GAME_DATE")), title=title, lede=lede,
        entities=F.array("home.TEAM_NAME", "away.TEAM_NAME"), themes=F.array(F.lit("SPORTS"), F.lit("BASKETBALL_NBA")), raw_metadata_json=about,
    )


def game_rows(payloads: DataFrame) -> DataFrame:
    """Log rows from payloads ``(headers array<string>, rowSet array<array<string>>)``, one column for each field that articles need."""
    fields = ("GAME_ID", "TEAM_NAME", "MATCHUP", "PTS", "WL", "GAME_DATE")
    rows = payloads.select("headers", F.posexplode("rowSet").alias("pos", "row"))
    return rows.select("pos", *(F.get("row", F.array_position("headers", F.lit(c)).cast("int") - 1).alias(c) for c in fields))


def ranked_union(*sources: DataFrame) -> DataFrame:
    """Sources in order of preference, one under the other, with ``src_rank``; missing columns are null."""
    out = None
    for rank, df in enumerate(sources):
        df = df.withColumn("src_rank", F.lit(rank))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def distinct_articles(articles: DataFrame, keep_rank: bool = False) -> DataFrame:
    """One row for each article, of the source of least ``src_rank``; ties by all other columns, so the result is fixed."""
    rest = [c for c in articles.columns if c not in ("article_id", "src_rank")]
    return first_of_each(articles, ["article_id"], ["src_rank", F.to_json(F.struct(*rest))]).drop(*([] if keep_rank else ["src_rank"]))


def unified(feeds: DataFrame, gkg: DataFrame) -> DataFrame:
    """The corpus: feed articles before knowledge-graph stubs, one of each id, and never minute precision without a time.

    Computing a row that breaks the last rule fails the query.
    """
    both = ranked_union(schemas.conform(feeds, schemas.ARTICLE), schemas.conform(gkg, schemas.ARTICLE))
    return schemas.checked(distinct_articles(both), "article")


def precision_report(articles: DataFrame, by: str = "source") -> DataFrame:
    """Rows and the percentages of minute and day precision of each source, and of all (``source`` null) in one pass."""
    share = lambda kind: (100 * F.avg((F.col("timestamp_precision") == kind).cast("int"))).alias(f"pct_{kind}")
    return articles.groupingSets([[by], []], by).agg(F.count("*").alias("total"), share("minute"), share("day"))


def coverage(gkg: DataFrame) -> DataFrame:
    """Rows, sources and months of a pull."""
    year, month = times.number_year_month(F.col("DATE"))
    return gkg.agg(F.count("*").alias("rows"), F.count_distinct("SourceCommonName").alias("sources"), F.count_distinct(year, month).alias("months"))


def corpus_partition(articles: DataFrame) -> DataFrame:
    """Adds ``year`` and ``month``: of the publication, else of the metadata's date number, else ``unknown``."""
    number = F.get_json_object("raw_metadata_json", "$.date_int").try_cast("long")
    (y, m), (ny, nm) = times.year_month(F.col("published_at")), times.number_year_month(number)
    dated = F.col("published_at").isNotNull()
    return articles.withColumns({"year": F.when(dated, y).otherwise(ny), "month": F.when(dated, m).otherwise(nm)})
