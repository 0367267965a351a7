import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.operators import medians


@pytest.mark.parametrize("few", [4, 4_096])
def test_against_statistics(spark, few):
    """A group that holds nearly all rows, odd and even numbers, ties, one value, nulls, NaNs, infinities and very uneven values."""
    rng = random.Random(2)
    rows = [("hot", rng.choice([0.0, -1.5, rng.gauss(0, 1), 10.0 ** rng.randint(-30, 30)])) for _ in range(1501)]
    rows += [("even", float(i)) for i in (1, 2, 3, 10)] + [("one", 7.0), ("same", 2.5), ("same", 2.5), ("none", None), (None, 3.0), (None, 4.0), ("odd", float("nan")), ("odd", 1.0)]
    rows += [("wide", x) for x in (-1.7e308, 1.7e308, 1.0, 2.0, 1.7e308, -1.7e308)] + [("large", float(2**53 + 2 * i)) for i in range(30)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5).withColumn("rank", F.lit(1)).withColumn("lo", F.lit(2))
    want = {}
    for k in {k for k, _ in rows}:
        own = [x for g, x in rows if g == k and x is not None and x == x]
        want[k] = statistics.median_low(own) / 2 + statistics.median_high(own) / 2 if own else None
    assert {r.k: r.middle for r in medians.exact_median(df, ["k"], "x", "middle", few).collect()} == want


def test_without_groups_and_empty(spark):
    df = spark.range(10_001).select("id")
    assert medians.exact_median(df, [], "id").first()[0] == 5000.0
    assert medians.exact_median(df.limit(0), [], "id").first()[0] is None
    assert medians.exact_median(df.limit(0).withColumn("k", F.lit("x")), ["k"], "id").count() == 0
    one = medians.exact_median(df.withColumn("k", F.lit("x")), ["k"], "id")
    assert [tuple(r) for r in one.collect()] == [("x", 5000.0)]
