"""Ordered computations within keys, of which no key is too large for a task.

A window over a key's rows runs in one task, be the key a third of the table. Here rows are dealt by ranges of key and order, so a
large key lies in several parts that follow each other; each part is a window of its own, and what a part has to know of the parts
before it (a count, the last value) or behind it (the next row) is one small row. A part has such a neighbour only for its first
or last key, so of these rows there are no more than parts, which is what proves that they may be broadcast.

Rows equal in key and order follow each other in any order. Nulls come first, as keys and in the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources import staging

PART, TIE = "_part", "_tie"


def spread(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``rows`` dealt by ranges of key and order, written, with the number of their part; equal rows may be dealt to several."""
    tied = rows.withColumn(TIE, F.monotonically_increasing_id())
    return staging.written(tied.repartitionByRange(*keys, *order, TIE).withColumn(PART, F.spark_partition_id()), "spread")


def _within(keys: list[str], order: list[str]) -> Window:
    return Window.partitionBy(PART, *keys).orderBy(*order, TIE)


def _joined(rows: DataFrame, edges: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """``rows`` with the columns ``names`` of their key's edge in their part; one edge a part at most."""
    edges = edges.select(F.col(PART).alias("_edge_part"), *(F.col(k).alias(f"_edge_{i}") for i, k in enumerate(keys)), *names)
    same = [F.col(PART) == F.col("_edge_part"), *(rows[k].eqNullSafe(F.col(f"_edge_{i}")) for i, k in enumerate(keys))]
    return rows.join(F.broadcast(edges), same, "left").drop("_edge_part", *(f"_edge_{i}" for i in range(len(keys))))


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str = "place") -> DataFrame:
    """``rows`` with their place in their key's order, from 1."""
    dealt = spread(rows, keys, order)
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1))
    edges = dealt.groupBy(*keys, PART).agg(F.count("*").alias("_n")).withColumn("_o_before", before).where("_o_before > 0")
    own = dealt.withColumn("_o_own", F.row_number().over(_within(keys, order)))
    return _joined(own, edges, keys, ["_o_before"]).withColumn(name, F.coalesce("_o_before", F.lit(0)) + F.col("_o_own")).drop(PART, TIE, "_o_own", "_o_before")


def carried(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """``rows`` with new columns: the last value that isn't null of each column expression, up to the row itself, within the key.

    A segmented scan: each part carries on its own, then takes what came last before it.
    """
    dealt = spread(rows.withColumns({f"_value_{i}": c for i, c in enumerate(values.values())}), keys, order)
    own = [f"_value_{i}" for i in range(len(values))]
    place = F.struct(*order, TIE)
    lasts = dealt.groupBy(*keys, PART).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in own))
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    edges = lasts.withColumns({f"_from{c}": F.last(c, ignorenulls=True).over(before) for c in own}).withColumn("_parts", F.count("*").over(before)).where("_parts > 0")
    so_far = _within(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = dealt.withColumns({f"_own{c}": F.last(c, ignorenulls=True).over(so_far) for c in own})
    found = _joined(found, edges, keys, [f"_from{c}" for c in own])
    return found.withColumns({name: F.coalesce(f"_own{c}", f"_from{c}") for name, c in zip(values, own)}).drop(PART, TIE, *own, *(f"_own{c}" for c in own), *(f"_from{c}" for c in own))


def followed(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str = "next") -> DataFrame:
    """``rows`` with ``value`` of the key's next row, null at its end."""
    dealt = spread(rows, keys, order)
    place = F.struct(*order, TIE)
    behind = Window.partitionBy(*keys).orderBy(PART)
    edges = dealt.groupBy(*keys, PART).agg(F.min_by(value, place).alias("_o_first")).withColumn("_o_later", F.lead("_o_first").over(behind)).withColumn("_o_more", F.lead(F.lit(True)).over(behind)).where("_o_more")
    window = _within(keys, order)
    own = dealt.withColumn("_o_next", F.lead(value).over(window)).withColumn("_o_last", F.lead(F.lit(False), 1, True).over(window))
    return _joined(own, edges, keys, ["_o_later"]).withColumn(name, F.when(F.col("_o_last"), F.col("_o_later")).otherwise(F.col("_o_next"))).drop(PART, TIE, "_o_next", "_o_last", "_o_later")
