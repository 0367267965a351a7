"""Queries that write a table with its sink, read it back, and tell what lies where."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import times
from tidemark.operators import news, vectors
from tidemark.plans.registry import folder, query, r6, read
from tidemark.sources import lake


def _markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as markets; the end is the last order's date."""
    ends = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").cast("timestamp").alias("created_at"), F.max("o_orderdate").cast("timestamp").alias("end_at"))
    own = read(spark, sf_dir, "customer").join(ends, F.col("c_custkey") == F.col("o_custkey"))
    return own.select(F.col("c_custkey").cast("string").alias("market_id"), F.col("c_mktsegment").alias("category"), F.array("c_mktsegment", "c_name").alias("tags"), "created_at", "end_at", F.col("c_acctbal").alias("total_volume_usdc"), (F.col("c_acctbal") > 0).alias("is_primary_sample"))


_MARKETS = "SELECT c_custkey, c_mktsegment, c_name, c_acctbal, min(o_orderdate) AS a, max(o_orderdate) AS e FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL"


@query(f"WITH m AS ({_MARKETS}) SELECT CAST(c_custkey AS VARCHAR) AS market_id, c_mktsegment AS category, c_mktsegment || '|' || c_name AS tags, strftime(e, '%Y-%m-%d') AS end_at, c_acctbal AS volume, c_acctbal > 0 AS is_primary_sample FROM m")
def universe_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The universe through its table, tags as JSON text in it."""
    path = folder(spark, "universe")
    lake.write_universe(_markets(spark, sf_dir), path)
    return lake.read_universe(spark, path).select("market_id", "category", F.array_join("tags", "|").alias("tags"), F.date_format("end_at", "yyyy-MM-dd").alias("end_at"), F.col("total_volume_usdc").alias("volume"), "is_primary_sample")


@query(f"""
WITH m AS ({_MARKETS}) SELECT c_mktsegment AS category, strftime(e, '%Y') AS year, strftime(e, '%m') AS month, count(*) AS bars, sum(epoch(a)::BIGINT) AS opened FROM m GROUP BY ALL""")
def bars_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars laid out by category and by year and month of their market's end."""
    own, path = _markets(spark, sf_dir), folder(spark, "bars")
    lake.write_bars(own.select("market_id", times.seconds(F.col("created_at")).alias("ts_min")), own, path)
    return lake.table(spark, path, schemas.BAR, lake.LAYOUT["bars_1min"]).groupBy("category", "year", "month").agg(F.count("*").alias("bars"), F.sum("ts_min").alias("opened"))


@query("""
SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%Y') END AS year, CASE WHEN o_orderkey % 5 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%m') END AS month,
    count(*) AS rows, count(DISTINCT o_orderpriority) AS sources FROM orders GROUP BY 1, 2""")
def gkg_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knowledge-graph rows by year and month of their date number, those without one under ``unknown``."""
    date = F.when(F.col("o_orderkey") % 5 != 0, times.as_number(F.col("o_orderdate")))
    path = folder(spark, "gkg")
    lake.write_gkg(schemas.conform(read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("GKGRECORDID"), date.alias("DATE"), F.col("o_orderpriority").alias("SourceCommonName")), schemas.GKG), path)
    return lake.table(spark, path, schemas.GKG, lake.LAYOUT["gdelt_gkg"]).groupBy("year", "month").agg(F.count("*").alias("rows"), F.count_distinct("SourceCommonName").alias("sources"))


@query("SELECT count(*) AS rows, count(DISTINCT o_orderpriority) AS sources, count(DISTINCT strftime(o_orderdate, '%Y-%m')) AS months FROM orders")
def gkg_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, sources and months of a pull."""
    return news.coverage(read(spark, sf_dir, "orders").select(times.as_number(F.col("o_orderdate")).alias("DATE"), F.col("o_orderpriority").alias("SourceCommonName")))


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles: every third is undated, of these every second has a date number."""
    i = F.col("doc_id")
    when = F.when(i % 3 != 0, F.timestamp_seconds(F.lit(1_700_000_000) + i * 86_400))
    about = F.when(i % 6 == 0, F.concat(F.lit('{"date_int": 2023'), F.lpad((1 + i % 12).cast("string"), 2, "0"), F.lit("01000000}"))).otherwise(F.lit("{}"))
    rows = read(spark, sf_dir, "documents").select(i.cast("string").alias("article_id"), "source", when.alias("published_at"), F.when(when.isNull(), "day").otherwise("minute").alias("timestamp_precision"), about.alias("raw_metadata_json"))
    return schemas.conform(rows, schemas.ARTICLE)


_DATED = "WITH d AS (SELECT *, CASE WHEN doc_id % 3 <> 0 THEN make_timestamp((1700000000 + doc_id * 86400) * 1000000) END AS t FROM documents)"


@query(f"{_DATED} SELECT source, coalesce(strftime(t, '%Y'), 'unknown') AS year, coalesce(strftime(t, '%m'), 'unknown') AS month, count(*) AS articles FROM d GROUP BY ALL")
def feed_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed articles by source, year and month, undated ones under ``unknown``."""
    path = folder(spark, "feeds")
    lake.write_feeds(_articles(spark, sf_dir), path)
    return lake.table(spark, path, schemas.ARTICLE, lake.LAYOUT["feed_articles"]).groupBy("source", "year", "month").agg(F.count("*").alias("articles"))


@query(f"""{_DATED} SELECT coalesce(strftime(t, '%Y'), CASE WHEN doc_id % 6 = 0 THEN '2023' ELSE 'unknown' END) AS year,
    coalesce(strftime(t, '%m'), CASE WHEN doc_id % 6 = 0 THEN printf('%02d', 1 + doc_id % 12) ELSE 'unknown' END) AS month, count(*) AS articles, count(DISTINCT source) AS sources FROM d GROUP BY 1, 2""")
def corpus_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus by year and month of publication, else of the metadata's date number."""
    path = folder(spark, "corpus")
    lake.write_corpus(_articles(spark, sf_dir), path)
    return lake.table(spark, path, schemas.ARTICLE, lake.LAYOUT["corpus"]).groupBy("year", "month").agg(F.count("*").alias("articles"), F.count_distinct("source").alias("sources"))


@query("""
WITH d AS (SELECT DISTINCT sha256(CAST(doc_id % 700 AS VARCHAR)) AS id FROM documents WHERE doc_id % 2 = 0), g AS (SELECT DISTINCT sha256(CAST(doc_id % 700 AS VARCHAR)) AS id FROM documents WHERE doc_id % 2 = 1 OR doc_id % 4 = 0)
SELECT source, count(*) AS articles, min(id) AS least, max(id) AS greatest FROM (SELECT 'feed' AS source, id FROM d UNION ALL SELECT 'gkg', id FROM g WHERE id NOT IN (SELECT id FROM d)) GROUP BY 1""")
def corpus_loader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus out of feeds and knowledge-graph rows where no unified one was written: feeds win, one article of each id."""
    rows = read(spark, sf_dir, "documents")
    url = (F.col("doc_id") % 700).cast("string")
    feed = rows.where("doc_id % 2 = 0").select(F.sha2(url, 256).alias("article_id"), F.lit("feed").alias("source"), url.alias("url"), F.lit("day").alias("timestamp_precision"))
    graph = rows.where("doc_id % 2 = 1 OR doc_id % 4 = 0").select(url.alias("DocumentIdentifier"), F.lit("gkg").alias("SourceCommonName"), F.lit(20240801000000).cast("long").alias("DATE"))
    base = folder(spark, "loader")
    lake.write_feeds(schemas.conform(feed, schemas.ARTICLE), f"{base}/feeds")
    lake.write_gkg(schemas.conform(graph, schemas.GKG), f"{base}/gkg")
    found = lake.read_corpus(spark, f"{base}/none", f"{base}/feeds", f"{base}/gkg")
    return found.groupBy("source").agg(F.count("*").alias("articles"), F.min("article_id").alias("least"), F.max("article_id").alias("greatest"))


@query("SELECT 'bars_1min' AS view, count(*) AS rows FROM (SELECT DISTINCT o_custkey FROM orders) UNION ALL SELECT 'feed_articles', count(*) FROM documents UNION ALL SELECT 'universe', count(*) FROM (SELECT DISTINCT o_custkey FROM orders)")
def lake_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views over the paths of a configuration; a path without files has none. SQL counts them."""
    base, own = folder(spark, "views"), _markets(spark, sf_dir)
    lake.write_universe(own, f"{base}/universe")
    lake.write_bars(own.select("market_id", times.seconds(F.col("created_at")).alias("ts_min")), own, f"{base}/bars")
    lake.write_feeds(_articles(spark, sf_dir), f"{base}/feeds")
    made = lake.register_views(spark, {"markets": {"universe": f"{base}/universe", "bars_1min": f"{base}/bars", "trades": f"{base}/none"}, "news": {"feeds": f"{base}/feeds"}})
    return lake.sql(spark, " UNION ALL ".join(f"SELECT '{view}' AS view, count(*) AS rows FROM {view}" for view in made))


@query("""
WITH v AS (SELECT vec_id, lpad(CAST(vec_id AS VARCHAR), 9, '0') AS article_id, embedding[1] AS x, len(embedding) AS n FROM embeddings)
SELECT vec_id, row_number() OVER (ORDER BY article_id) - 1 AS faiss_row, true AS near, CAST(n AS INTEGER) AS dim FROM v""")
def embedding_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as half-precision bytes and the index's id map, both read back; values stay near those written."""
    base = folder(spark, "embeddings")
    rows = read(spark, sf_dir, "embeddings").select(F.lpad(F.col("vec_id").cast("string"), 9, "0").alias("article_id"), "embedding")
    lake.write_embeddings(rows, f"{base}/articles")
    lake.write_id_map(rows, f"{base}/ids")
    back = lake.read_embeddings(spark, f"{base}/articles").join(rows.select("article_id", F.col("embedding").alias("own")), "article_id")
    far = F.exists(F.zip_with("embedding", "own", lambda a, b: F.abs(a - b) > 0.001), lambda x: x)
    ids = lake.table(spark, f"{base}/ids", spark.range(0).select(F.col("id").alias("faiss_row"), F.lit("").alias("article_id")).schema)
    return back.join(ids, "article_id").select(F.col("article_id").cast("long").alias("vec_id"), "faiss_row", (~far).alias("near"), F.size("embedding").alias("dim"))


@query("""
WITH d AS (SELECT doc_id, length(regexp_replace(coalesce(source, '') || ' ' || coalesce(text, ''), '\\s', '', 'g')) > 0 AS worded FROM documents)
SELECT doc_id, CAST(256 AS INTEGER) AS dim, CASE WHEN worded THEN 1.0 ELSE 0.0 END AS norm FROM d""")
def encoded_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' embeddings by an encoder that needs no model: unit vectors at half precision."""
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("article_id"), F.col("source").alias("title"), F.col("text").alias("lede"))
    found = vectors.embedded_articles(rows, None, vectors.hashed_encoder())
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return found.select(F.col("article_id").cast("long").alias("doc_id"), F.size("embedding").alias("dim"), r6(F.round(norm, 2)).alias("norm"))
