"""Exact inner-product search that leaves out blocks of rows which can't hold a result.

Rows are kept by blocks around a centre. By the inequalities of Cauchy and Schwarz no row of a block scores above q·c + |q|·r, c being the centre and
r the largest distance to it, nor above |q| times the block's largest norm. A query first meets the blocks of highest bounds that hold k rows or more;
the k-th score found there is what every other block's bound must reach, or it isn't looked at. The result is that of scoring all rows.

An index is three tables: rows ``(block, id, vector)``, blocks ``(block, cell, radius, norm, rows)``, and centres ``(cell, vector)``. Cells lie around at
most ``CELLS`` centres, which tasks hold; a cell is cut by distance to blocks of at most ``ROWS`` rows, so those close to the centre have small radii.
How much is left out depends on the rows: with clusters most, with uniform directions in many dimensions nothing (``share`` tells).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import ordered, vectors
from tidemark.sources import staging

#: Most centres, rows of a block, and rounds that move centres to the middle of their cells.
CELLS, ROWS, ROUNDS = 1_024, 8_192, 2
#: What bounds are raised by, relative to the norms, for the rounding of sums.
SLACK = 1e-9


class Index(NamedTuple):
    """An index's tables, as written."""

    rows: DataFrame
    blocks: DataFrame
    centres: DataFrame


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), float).reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))


def _nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centre and its distance."""
    far = (rows**2).sum(axis=1)[:, None] - 2 * rows @ centres.T + (centres**2).sum(axis=1)[None]
    cell = far.argmin(axis=1)
    return cell, np.sqrt(((rows - centres[cell]) ** 2).sum(axis=1))


def _centres(corpus: DataFrame, cells: int, rounds: int) -> np.ndarray:
    """Centres from rows chosen by hash, moved to the means of their cells. A task sends a sum for each cell, and these are added cell by cell."""
    first = corpus.orderBy(F.xxhash64("id"), "id").limit(cells).select("vector").toArrow()
    centres = np.unique(_matrix(first["vector"]), axis=0)
    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], at: np.ndarray = centres) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros_like(at), np.zeros(len(at))
            for batch in batches:
                if batch.num_rows:
                    rows = _matrix(batch.column(0))
                    cell, _ = _nearest(rows, at)
                    np.add.at(total, cell, rows)
                    count += np.bincount(cell, minlength=len(at))
            there = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(count[there]), pa.array(list(total[there]), pa.list_(pa.float64()))], ["cell", "n", "total"])

        def added(key: tuple, rows: pa.Table) -> pa.Table:
            return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([list(_matrix(rows["total"]).sum(axis=0) / sum(rows["n"].to_pylist()))], pa.list_(pa.float64()))], ["cell", "mean"])

        means = corpus.select("vector").mapInArrow(sums, "cell int, n double, total array<double>").groupBy("cell").applyInArrow(added, "cell int, mean array<double>").toArrow()
        centres = centres.copy()
        centres[means["cell"].to_numpy()] = _matrix(means["mean"])
    return centres


def build(corpus: DataFrame, cells: int = CELLS, rows: int = ROWS, rounds: int = ROUNDS) -> Index:
    """An index of ``(id, vector)``, written to the shared folder; rows without a vector, or with one that isn't finite, take no part. Vectors are of one length."""
    spark = corpus.sparkSession
    whole = corpus.where("vector is not null AND NOT exists(vector, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))").select("id", "vector")
    count = whole.count()
    id_type, vector_type = (whole.schema[c].dataType.simpleString() for c in ("id", "vector"))
    if not count:
        empty = lambda schema: spark.createDataFrame([], schema)
        return Index(empty(f"block long, id {id_type}, vector {vector_type}"), empty("block long, cell int, radius double, norm double, rows long"), empty("cell int, vector array<double>"))
    centres = _centres(whole, min(cells, max(1, round(np.sqrt(count)))), rounds)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = _matrix(batch.column(1))
                cell, far = _nearest(own, centres)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(far), pa.array(np.sqrt((own**2).sum(axis=1)))], ["id", "vector", "cell", "far", "norm"])

    assigned = whole.mapInArrow(assign, f"id {id_type}, vector {vector_type}, cell int, far double, norm double")
    placed = ordered.numbered(assigned, ["cell"], ["far"], "place")
    dealt = placed.withColumn("block", F.col("cell").cast("long") * (1 << 40) + F.floor((F.col("place") - 1) / rows))
    dealt = staging.written(dealt.select("block", "id", "vector", "cell", "far", "norm"), "search-rows")
    blocks = dealt.groupBy("block").agg(F.first("cell").alias("cell"), F.max("far").alias("radius"), F.max("norm").alias("norm"), F.count("*").alias("rows"))
    middle = spark.createDataFrame([(i, list(map(float, c))) for i, c in enumerate(centres)], "cell int, vector array<double>")
    return Index(dealt.select("block", "id", "vector"), staging.written(blocks, "search-blocks"), staging.written(middle, "search-centres"))


def _bounds(index: Index):
    """Each block's number, rows, and the bounds of queries, as arrays; a block is a row of a few numbers, of ``ROWS`` rows of the index each."""
    blocks, middle = index.blocks.orderBy("block").toArrow(), index.centres.orderBy("cell").toArrow()
    numbers, cells, radius, norm, rows = (blocks[c].to_numpy() for c in ("block", "cell", "radius", "norm", "rows"))
    centres = _matrix(middle["vector"])

    def of(queries: np.ndarray) -> np.ndarray:
        size = np.sqrt((queries**2).sum(axis=1))[:, None]
        above = (queries @ centres.T)[:, cells] + size * radius[None]
        return np.minimum(above, size * norm[None]) + SLACK * (1 + size * (norm[None] + np.abs(centres).max()))

    return numbers, rows, of


def search(queries: DataFrame, index: Index, k: int) -> tuple[DataFrame, DataFrame]:
    """``(query_id, rank, id, score)`` as ``vectors.nearest`` gives it, and ``(query_id, scored, share)``: the rows that each query was held against, and their share of all."""
    asked = queries.where("vector is not null").select("query_id", "vector")
    kind, vector_type = (asked.schema[c].dataType.simpleString() for c in ("query_id", "vector"))
    numbers, rows, bounds = _bounds(index)
    schema = f"query_id {kind}, vector {vector_type}, strip long, first boolean"
    total = int(rows.sum())

    def chosen(first: bool):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows or not len(numbers):
                    continue
                found = bounds(_matrix(batch.column(1)))
                order = np.argsort(-found, axis=1, kind="stable")
                before = np.cumsum(rows[order], axis=1) - rows[order]
                early = np.zeros(found.shape, bool)
                np.put_along_axis(early, order, before < k, axis=1)
                if not first:
                    least = np.array([-np.inf if x is None else x for x in batch.column(2).to_pylist()])
                    early = ~early & (found >= least[:, None])
                q, b = np.nonzero(early)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(q)), batch.column(1).take(pa.array(q)), pa.array(numbers[b]), pa.array([first] * len(q), pa.bool_())], ["query_id", "vector", "strip", "first"])

        return scan

    own = index.rows.withColumnRenamed("block", "strip")
    early = staging.written(asked.mapInArrow(chosen(True), schema), "search-first")
    found = staging.written(vectors.ranked(vectors.tiled(early.drop("first"), own, k), k), "search-found")
    least = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    late = staging.written(asked.join(least, "query_id", "left").select("query_id", "vector", "least").mapInArrow(chosen(False), schema), "search-second")
    both = found.select("query_id", "id", "score").unionByName(vectors.tiled(late.drop("first"), own, k))
    met = early.unionByName(late).join(index.blocks.select(F.col("block").alias("strip"), "rows"), "strip").groupBy("query_id").agg(F.sum("rows").alias("scored"))
    return vectors.ranked(both, k), met.withColumn("share", F.col("scored") / max(1, total))
