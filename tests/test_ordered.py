import collections

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ordered


@pytest.fixture()
def many_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def rows_of(spark):
    """A key with two thirds of all rows, small ones, a null one, ties, and values that are mostly null."""
    data = [("hot", i // 2, None if i % 7 else i) for i in range(400)] + [(f"k{i % 50}", i, i if i % 3 == 0 else None) for i in range(190)] + [(None, None, None), (None, 1, 5), ("hot", None, None)]
    return data, spark.createDataFrame(data, "k string, t long, v long").repartition(3)


def test_numbers_are_gapless_and_follow_the_order(many_parts):
    data, df = rows_of(many_parts)
    dealt = ordered.spread(df, ["k"], ["t"])
    assert dealt.where("k = 'hot'").select("_part").distinct().count() > 1  # a large key isn't one task
    by = collections.defaultdict(list)
    for k, t, v, place in ordered.numbered(df, ["k"], ["t"]).select("k", "t", "v", "place").collect():
        by[k].append((place, t))
    assert sum(map(len, by.values())) == len(data)
    for k, found in by.items():
        found.sort(key=lambda x: x[0])
        assert [p for p, _ in found] == list(range(1, len(found) + 1))
        assert [-1 if t is None else t for _, t in found] == sorted(-1 if t is None else t for _, t in found)


def test_values_are_carried_over_parts(many_parts):
    data, df = rows_of(many_parts)
    data = [(k, t, None if v is None else v // 2) for k, t, v in data]  # one value for each time, so that ties don't matter
    df = many_parts.createDataFrame(list({(k, t): (k, t, v) for k, t, v in data}.values()), "k string, t long, v long").repartition(3)
    want = collections.defaultdict(dict)
    for k, t, v in sorted(df.collect(), key=lambda r: (r.k or "", -1 if r.t is None else r.t)):
        want[k][t] = v if v is not None else (list(want[k].values())[-1] if want[k] else None)
    got = ordered.carried(df, ["k"], ["t"], {"last": F.col("v"), "named": F.when(F.col("v").isNotNull(), F.col("t"))}).collect()
    assert len(got) == sum(map(len, want.values())) and all(r["last"] == want[r.k][r.t] for r in got)
    assert all((r["named"] is None) == (r["last"] is None) for r in got)


def test_the_next_row(many_parts):
    df = many_parts.range(1000).select(F.when(F.col("id") < 700, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 9).cast("string"))).alias("k"), (F.col("id") * 7919 % 1000).alias("t"))
    by = collections.defaultdict(list)
    for r in df.collect():
        by[r.k].append(r.t)
    want = {(k, t): n for k, ts in by.items() for t, n in zip(sorted(ts), [*sorted(ts)[1:], None])}
    got = ordered.followed(df, ["k"], ["t"], "t", "n").collect()
    assert {(r.k, r.t): r.n for r in got} == want and len(got) == 1000


def test_empty(spark):
    none = spark.createDataFrame([], "k string, t long, v long")
    assert ordered.numbered(none, ["k"], ["t"]).count() == ordered.carried(none, ["k"], ["t"], {"x": F.col("v")}).count() == ordered.followed(none, ["k"], ["t"], "t").count() == 0
