"""Mergeable sketches of a table's partitions: distinct counts and quantiles of any union of them without another look at the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Logarithm of a distinct sketch's places, and of a quantile sketch's width.
PLACES, WIDTH = 12, 200


#: Twice the rank error of a quantile sketch of the default width at 99 %, as its authors give it.
QUANTILE_ERROR = 2 * 0.0165


def distinct_error(places: int = PLACES) -> float:
    """Three standard errors of a distinct count, relative: 1.04 / sqrt(2^places) each."""
    return 3 * 1.04 / 2 ** (places / 2)


def sketched(rows: DataFrame, by: list[str], distinct: dict[str, str], quantiles: dict[str, str], places: int = PLACES, width: int = WIDTH) -> DataFrame:
    """A row for each partition: its key, ``rows``, a distinct sketch of each column of ``distinct`` and a quantile sketch of each of ``quantiles`` (name to column).

    A sketch has a few kilobytes whatever the partition holds; tasks send one for each partition. Nulls don't count. Partitions are sketched when they are written,
    and the small table of sketches is what reports read.
    """
    own = [F.hll_sketch_agg(F.col(c).cast("string"), F.lit(places)).alias(n) for n, c in distinct.items()]
    own += [F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(width)).alias(n) for n, c in quantiles.items()]
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), *own)


def merged(sketches: DataFrame, by: list[str], distinct: list[str], quantiles: list[str]) -> DataFrame:
    """The sketches of partitions united by coarser keys."""
    own = [F.hll_union_agg(c).alias(c) for c in distinct] + [F.kll_merge_agg_double(c).alias(c) for c in quantiles]
    return sketches.groupBy(*by).agg(F.sum("rows").alias("rows"), *own)


def estimates(sketches: DataFrame, distinct: list[str], quantiles: dict[str, list[float]]) -> DataFrame:
    """Distinct counts, and quantiles as arrays, in place of the sketches."""
    out = sketches.withColumns({c: F.hll_sketch_estimate(c) for c in distinct})
    return out.withColumns({c: F.array(*(F.kll_sketch_get_quantile_double(c, F.lit(q)) for q in qs)) for c, qs in quantiles.items()})
