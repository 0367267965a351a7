import random
import threading

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import news
from tidemark.sources import corpus_state, lake, snapshots

SCHEMA = "id long, v string"


def table(spark, tmp_path):
    return snapshots.Snapshots(spark, str(tmp_path / "table"))


def ids(df):
    return sorted(r.id for r in df.collect())


def test_versions_and_dead_runs(spark, tmp_path):
    """A run that dies before its commit is seen by nobody; every version stays readable; a run appends to the table that it reads."""
    own = table(spark, tmp_path)
    rows = spark.range(10).select("id", F.lit("a").alias("v"))
    assert own.read(SCHEMA).count() == 0 and own.versions() == []
    assert own.append(rows) == 1
    own.staged(rows.withColumn("id", F.col("id") + 1000))
    assert ids(own.read(SCHEMA)) == list(range(10))
    assert own.append(own.read(SCHEMA).select((F.col("id") + 10).alias("id"), F.lit("b").alias("v"))) == 2
    assert ids(own.read(SCHEMA)) == list(range(20)) and ids(own.read(SCHEMA, 1)) == list(range(10))
    assert own.read(SCHEMA, 0).count() == 0
    with pytest.raises(ValueError):
        own.read(SCHEMA, 9)
    assert own.vacuum() == 1 and ids(own.read(SCHEMA)) == list(range(20))


def test_replaced_files_and_conflicts(spark, tmp_path):
    own = table(spark, tmp_path)
    own.append(spark.range(5).select("id", F.lit("a").alias("v")))
    old = own.files()
    own.commit(own.staged(spark.range(50, 53).select("id", F.lit("b").alias("v"))), old)
    assert ids(own.read(SCHEMA)) == [50, 51, 52] and ids(own.read(SCHEMA, 1)) == list(range(5))
    with pytest.raises(snapshots.Conflict):
        own.commit([], old)
    assert own.versions() == [1, 2]


def test_many_versions_and_runs_at_once(spark, tmp_path):
    """Runs that commit at the same time all get a number of their own; manifests that list all files change nothing."""
    own = table(spark, tmp_path)
    files = own.staged(spark.range(2).select("id", F.lit("a").alias("v")).repartition(2))
    threads = [threading.Thread(target=lambda i=i: [own.commit([f"data/run{i}/{n}.parquet"]) for n in range(8)]) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert own.versions() == list(range(1, 33))
    assert sorted(own.files()) == sorted(f"data/run{i}/{n}.parquet" for i in range(4) for n in range(8))
    own.commit(files, own.files())
    assert own.files() == files and ids(own.read(SCHEMA)) == [0, 1]


def articles(spark, rows):
    df = spark.createDataFrame(rows, "article_id string, source string, src_rank int")
    return schemas.conform(df.withColumn("timestamp_precision", F.lit("day")), corpus_state._STATE)


def test_corpus_batches_equal_one_go(spark, tmp_path):
    rng = random.Random(4)
    hexes = [f"{rng.randrange(16**8):08x}" for _ in range(150)]
    rows = [(rng.choice(hexes), rng.choice("abc"), rng.randint(0, 2)) for _ in range(400)] + [(None, "a", 0)]
    state = corpus_state.CorpusState(spark, str(tmp_path / "corpus"))
    for n in range(3):
        state.update(articles(spark, rows[n::3]))
    want = news.distinct_articles(articles(spark, rows).where("article_id is not null"))
    told = lambda df: sorted((r.article_id, r.source) for r in df.collect())
    assert told(state.articles()) == told(want)
    before = len(state.table.files())
    seen = state.update(articles(spark, [(hexes[0], "a", 0)]))  # one id touches one prefix
    assert seen == {"touched": 1, "read": 1, "left": before - 1}
    assert told(state.articles()) == told(news.distinct_articles(articles(spark, [*rows[:-1], (hexes[0], "a", 0)])))


def test_colocated_tables_meet_without_a_shuffle(spark, tmp_path):
    left, right = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("a")), spark.range(0, 600, 3).select(F.col("id").alias("k"), F.lit("x").alias("b"))
    own = [lake.write_colocated(df, f"colocated_{i}", str(tmp_path / f"t{i}"), "k", 4) for i, df in enumerate((left, right))]
    for how in ("inner", "left_anti", "left"):
        met = own[0].hint("merge").join(own[1], "k", how)
        met.collect()
        assert "Exchange" not in met._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, met.collect()), key=str) == sorted(map(tuple, left.join(right, "k", how).collect()), key=str)
    counts = own[0].groupBy("k").count()
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    for i in range(2):
        spark.sql(f"DROP TABLE colocated_{i}")
