"""Exact medians of groups of any size, by narrowing down where the middle lies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources import staging

#: Bins of one step, and rows among which the middle is picked by sorting.
BINS, FEW = 1_024, 4_096


def exact_median(rows: DataFrame, by: list[str], value: str, name: str = "median", few: int = FEW) -> DataFrame:
    """``(by..., name)``: the median of each group as a double; of two middle values their mean. Nulls don't count, nor do NaNs; a group without a value has none.

    Each group's range is cut to ``BINS``; a task sends a count, the least and the largest value of each bin, and the bin that holds the middle is the next range.
    Once a range holds ``few`` rows these are sorted. So no task gets a group's values, whatever the group; groups of ``few`` rows or less need no step at all.
    """
    x = F.col(value).cast("double")
    own = rows.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), x.alias("_x")).where("_x is not null AND NOT isnan(_x)")
    keys = [f"_k{i}" for i in range(len(by))]
    whole = own.groupBy(*keys).agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"), F.count("*").alias("n"))
    # the lower and the upper middle, which are one where the number is odd
    middle = F.posexplode(F.array(F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1)).alias("_t", "rank")
    state = staging.written(whole.where("n > 0").select(*keys, "lo", "hi", "n", middle), "median-ranges")
    found = []

    def within(some: DataFrame) -> DataFrame:
        """The values of each range, with the range."""
        renamed = some.select(*(F.col(k).alias(f"_s{k}") for k in keys), "lo", "hi", "n", "_t", "rank")
        same = [own[k].eqNullSafe(F.col(f"_s{k}")) for k in keys] + [own["_x"] >= F.col("lo"), own["_x"] <= F.col("hi")]
        return own.join(renamed, reduce(lambda a, b: a & b, same)).drop(*(f"_s{k}" for k in keys))

    while True:
        found.append(state.where("lo = hi").select(*keys, F.col("lo").alias("_v")))
        small = state.where((F.col("lo") < F.col("hi")) & (F.col("n") <= few))
        place = Window.partitionBy(*keys, "_t").orderBy("_x")
        found.append(within(small).withColumn("_place", F.row_number().over(place)).where("_place = rank").select(*keys, F.col("_x").alias("_v")))
        large = state.where((F.col("lo") < F.col("hi")) & (F.col("n") > few))
        if large.isEmpty():
            break
        # halves first, so that a range as wide as all doubles doesn't overflow
        share = (F.col("_x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        bin_ = F.least(F.lit(BINS - 1), F.floor(share * BINS)).cast("int")
        held = within(large).withColumn("_bin", bin_).groupBy(*keys, "_t", "_bin").agg(F.first("rank").alias("rank"), F.min("_x").alias("lo"), F.max("_x").alias("hi"), F.count("*").alias("n"))
        upto = Window.partitionBy(*keys, "_t").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        held = held.withColumn("_before", F.coalesce(F.sum("n").over(upto), F.lit(0))).where("_before < rank AND rank <= _before + n")
        # the rank within the range becomes one within the bin
        state = staging.written(held.select(*keys, "lo", "hi", "n", "_t", (F.col("rank") - F.col("_before")).alias("rank")), "median-ranges")
    both = reduce(DataFrame.unionByName, found)
    out = both.groupBy(*keys).agg((F.min("_v") / 2 + F.max("_v") / 2).alias(name))
    groups = rows.select(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(by))).distinct() if by else rows.sparkSession.range(1).select()
    if not by:
        return groups.join(out, F.lit(True), "left")
    same = reduce(lambda a, b: a & b, (F.col(f"_g{i}").eqNullSafe(F.col(k)) for i, k in enumerate(keys)))
    return groups.join(out, same, "left").select(*(F.col(f"_g{i}").alias(c) for i, c in enumerate(by)), name)
