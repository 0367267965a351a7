import bisect
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof

LEFT, RIGHT = "id long, k string, t long, p string", "k string, u long, p double, seq long"


@pytest.fixture()
def many_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def tables():
    """A key that holds nearly all rows of both sides, small ones, keys of one side only, ties, nulls and repeated rows."""
    rng = random.Random(3)
    left = [(i, rng.choice(["hot"] * 8 + ["a", "b", "left", None]), rng.choice([None, *range(300)]) if i % 9 else None, f"row {i}") for i in range(900)]
    right = [(rng.choice(["hot"] * 8 + ["a", "b", "right", None]), rng.randint(0, 280) if i % 11 else None, rng.choice([None, i / 4]), i) for i in range(700)]
    return [*left, left[1], left[1]], right


def plain(left, right, exact, within):
    by = {}
    for k, u, p, seq in sorted((r for r in right if r[0] is not None and r[1] is not None), key=lambda r: (r[1], r[3])):
        by.setdefault(k, []).append((u, p, seq))
    out = []
    for i, k, t, p in left:
        own = by.get(k, []) if t is not None else []
        at = (bisect.bisect_right if exact else bisect.bisect_left)([x[0] for x in own], t) - 1 if own else -1
        hit = own[at] if at >= 0 and (within is None or t - own[at][0] <= within) else (None, None, None)
        out.append((i, k, t, p, hit[1], hit[2]))
    return sorted(out, key=str)


@pytest.mark.parametrize("exact", [True, False])
@pytest.mark.parametrize("within", [None, 2])
def test_against_bisection(many_parts, exact, within):
    left, right = tables()
    df = asof.joined(many_parts.createDataFrame(left, LEFT).repartition(5), many_parts.createDataFrame(right, RIGHT).repartition(4), ["k"], "t", "u", ["p", "seq"], exact, within, ["seq"])
    assert df.columns == ["id", "k", "t", "p", "p", "seq"]
    assert sorted((tuple(r) for r in df.collect()), key=str) == plain(left, right, exact, within)


def test_timestamps_and_several_keys(spark):
    left = spark.createDataFrame([("x", 1, 100), ("x", 2, 100), ("y", 1, 100)], "k string, m int, s long").withColumn("t", F.timestamp_seconds("s"))
    right = spark.createDataFrame([("x", 1, 95, 1.0), ("x", 1, 101, 2.0), ("x", 2, 40, 3.0)], "k string, m int, s long, v double").withColumn("t", F.timestamp_seconds("s")).drop("s")
    got = asof.joined(left, right, ["k", "m"], "t", "t", ["v"], within=30)
    assert {(r.k, r.m): r.v for r in got.collect()} == {("x", 1): 1.0, ("x", 2): None, ("y", 1): None}


def test_empty(spark):
    left, right = spark.createDataFrame([(1, "a", 1, "p")], LEFT), spark.createDataFrame([], RIGHT)
    assert [tuple(r) for r in asof.joined(left, right, ["k"], "t", "u", ["seq"]).collect()] == [(1, "a", 1, "p", None)]
    assert asof.joined(left.limit(0), right, ["k"], "t", "u", ["seq"]).count() == 0
