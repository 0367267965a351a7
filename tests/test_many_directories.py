"""Tables of very many directories: written by many tasks, and read without Spark's listing."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.sources import lake

KEYS = ("source", "year", "month")


def test_small_directories_are_dealt_to_many_tasks(spark, tmp_path):
    rows = spark.range(300).select("id", F.lit("s").alias("source"), (F.col("id") % 60).cast("string").alias("year"), F.lit("01").alias("month"))
    lake.write(rows, f"{tmp_path}/t", KEYS)
    files = list((tmp_path / "t").glob("source=*/*/*/*.parquet"))
    assert len(files) == 60 and len({f.name for f in files}) > 1


def test_a_large_directory_is_written_where_its_rows_are(spark, tmp_path):
    rows = spark.range(0, 40_000, 1, 2).select(F.sha2(F.col("id").cast("string"), 512).alias("id"), F.when(F.col("id") % 40 == 0, (F.col("id") % 400).cast("string")).otherwise("hot").alias("source"), F.lit("y").alias("year"), F.lit("m").alias("month"))
    lake.write(rows, f"{tmp_path}/t", KEYS)
    assert {f.name[:6] for f in (tmp_path / "t/source=hot").glob("*/*/*.parquet")} == {"part-a"}
    assert lake.table(spark, f"{tmp_path}/t", rows.schema, KEYS).select(*rows.columns).exceptAll(rows).count() == 0
    assert spark.read.parquet(f"{tmp_path}/t").count() == 40_000


def test_many_short_rows_of_a_directory_are_not_dealt_once_more(spark, tmp_path):
    rows = spark.range(0, 4000, 1, 2).select("id", F.lit("hot").alias("source"), F.lit("y").alias("year"), F.lit("m").alias("month"))
    lake.write(rows, f"{tmp_path}/t", KEYS)
    assert {f.name[:6] for f in (tmp_path / "t/source=hot").glob("*/*/*.parquet")} == {"part-a"}
    assert spark.read.parquet(f"{tmp_path}/t").count() == 4000


@pytest.fixture
def feeds(spark, tmp_path):
    """Articles under odd names, with a file of another writer that lacks columns, and files that readers don't see."""
    day = datetime.datetime(2024, 8, 1, tzinfo=datetime.timezone.utc)
    given = [(str(i), source, day if i % 2 else None, ["a", None] if i % 3 else None) for i, source in enumerate(["a=b/c:d%e", None, "é ü", "plain", "x y", "plain"] * 20)]
    own = spark.createDataFrame(given, "article_id string, source string, published_at timestamp, entities array<string>")
    path = f"{tmp_path}/f"
    lake.write_feeds(own, path)
    more = spark.createDataFrame([("more", "plain", "2024", "08")], "article_id string, source string, year string, month string")
    more.write.mode("append").partitionBy(*KEYS).parquet(path)
    (tmp_path / "f/source=plain/_dead").mkdir()
    (tmp_path / "f/source=plain/_dead/x.parquet").write_text("no table")
    (tmp_path / "f/source=plain/year=2024/month=08/_12").write_text("no table")
    return path


def test_very_many_directories_are_read_by_tasks_with_the_same_rows(spark, feeds, monkeypatch):
    plain = lake.table(spark, feeds, schemas.ARTICLE, lake.LAYOUT["feed_articles"])
    want = sorted(map(repr, plain.collect()))
    monkeypatch.setattr(lake, "MANY", 2)
    found = lake.table(spark, feeds, schemas.ARTICLE, lake.LAYOUT["feed_articles"])
    assert found.schema == plain.schema and len(want) == 121 and sorted(map(repr, found.collect())) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FileScan" not in plan


def test_views_of_very_many_directories(spark, feeds, monkeypatch):
    paths, asked = {"news": {"feeds": feeds}}, "SELECT article_id, source, year, month, entities FROM feed_articles"
    lake.register_views(spark, paths)
    want = sorted(map(repr, lake.sql(spark, asked).collect()))
    monkeypatch.setattr(lake, "MANY", 2)
    assert lake.register_views(spark, paths) == ["feed_articles"]
    found = lake.sql(spark, asked)
    assert sorted(map(repr, found.collect())) == want and len(want) == 121
    assert "FileScan" not in found._jdf.queryExecution().executedPlan().toString()


def test_files_beside_very_many_directories_are_left_to_spark(spark, feeds, monkeypatch):
    monkeypatch.setattr(lake, "MANY", 2)
    spark.range(3).select(F.col("id").cast("string").alias("article_id")).write.mode("append").parquet(feeds)
    found = lake.table(spark, feeds, schemas.ARTICLE, lake.LAYOUT["feed_articles"])
    assert "FileScan" in found._jdf.queryExecution().executedPlan().toString()
