"""As-of join: each row with the last row of another table before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import ordered


def joined(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str], exact: bool = True, within: int | None = None, order: list[str] | None = None) -> DataFrame:
    """``left`` with the ``values`` of the last row of ``right`` of its key, up to its own time.

    With ``exact`` a row at the very time counts, else only earlier ones. ``within`` is how much older it may be, in the times' unit for numbers and
    in seconds for timestamps; an older one counts as none. Of rows of ``right`` at one time the last by ``order`` counts, columns of ``right``; without
    an order, the last by the values.

    Both tables become one, ordered by key and time, along which the right rows are carried: a segmented scan (``ordered.carried``), so a key may be larger than
    a task on either side, and no row meets another one's rows than its own. A left row without a match has nulls; rows of ``right`` without a time or a null in a
    key match nothing, left ones keep nulls; repeated left rows are kept.
    """
    place = [f"_order_{i}" for i in range(len(order or values))]
    held = F.struct(*(F.col(c).alias(f"v{i}") for i, c in enumerate(values)), F.col(right_time).alias("at"))
    own = left.select(*(F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)), F.col(left_time).alias("_time"), F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(left.columns))).alias("_left"))
    other = right.where(F.col(right_time).isNotNull()).dropna(subset=keys)
    other = other.select(*(F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)), F.col(right_time).alias("_time"), held.alias("_right"), *(F.col(c).alias(n) for n, c in zip(place, order or values)))
    both = other.withColumn("_side", F.lit(0 if exact else 1)).unionByName(own.withColumn("_side", F.lit(1 if exact else 0)), allowMissingColumns=True)
    found = ordered.carried(both, [f"_key_{i}" for i in range(len(keys))], ["_time", "_side", *place], {"_last": F.col("_right")}).where("_left is not null")
    match = F.col("_last")
    if within is not None:
        far = F.unix_micros(F.col("_time")) - F.unix_micros(F.col("_last.at")) > within * 1_000_000 if left.schema[left_time].dataType.typeName() == "timestamp" else F.col("_time") - F.col("_last.at") > within
        match = F.when(~far, match)
    found = found.withColumn("_last", F.when(F.col("_time").isNotNull(), match))
    return found.select(*(F.col("_left")[f"c{i}"].alias(c) for i, c in enumerate(left.columns)), *(F.col("_last")[f"v{i}"].alias(c) for i, c in enumerate(values)))
