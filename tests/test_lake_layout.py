"""What a partitioned table looks like on disk."""

from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.sources import lake

ROWS = "id long, source string, year string, month string"


def test_many_directories_are_a_file_each_and_come_at_once(spark, tmp_path):
    rows = spark.range(1200).select("id", F.concat(F.lit("s"), (F.col("id") % 20).cast("string")).alias("source"), (F.col("id") % 60).cast("string").alias("year"), F.lit("01").alias("month"))
    path = f"{tmp_path}/t"
    lake.write(rows, path, ("source", "year", "month"))
    assert (tmp_path / "t/_SUCCESS").exists() and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["t"]
    files = list((tmp_path / "t").glob("source=*/year=*/month=01/*"))
    # a checksum beside each file is written by way of a process for each
    assert len(files) == 60 and not list((tmp_path / "t").glob("source=*/**/.*"))
    back = lake.table(spark, path, rows.schema, ("source", "year", "month"))
    assert back.select("id", "source", "year", "month").exceptAll(rows).count() == 0 and back.count() == 1200


def test_odd_values_nulls_and_replacement(spark, tmp_path):
    given = [(1, "a=b/c:d%e", "2024", "08"), (2, None, "2024", "08"), (3, "é ü", "unknown", "unknown"), (4, "a=b/c:d%e", "2024", "08")]
    path = f"{tmp_path}/t"
    for at in (slice(0, 2), slice(0, 4)):
        rows = spark.createDataFrame(given[at], ROWS)
        lake.write(rows, path, ("source", "year", "month"))
        back = lake.table(spark, path, rows.schema, ("source", "year", "month")).select(*rows.columns)
        assert sorted(map(tuple, back.collect()), key=repr) == sorted(given[at], key=repr)
    lake.write(rows.limit(0), path, ("source", "year", "month"))
    assert lake.table(spark, path, rows.schema, ("source", "year", "month")).count() == 0


def test_the_universe_is_not_gathered_in_one_task(spark, tmp_path):
    own = spark.range(0, 40_000, 1, 4).select(F.col("id").cast("string").alias("market_id"), F.array(F.sha2(F.col("id").cast("string"), 512)).alias("tags"))
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        lake.write_universe(schemas.conform(own, schemas.MARKET), f"{tmp_path}/u")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert len(list((tmp_path / "u").glob("*.parquet"))) > 1
    assert lake.read_universe(spark, f"{tmp_path}/u").count() == 40_000
