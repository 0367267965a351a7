"""Approximate nearest neighbours by an inverted multi-index, for the largest inner product.

Vectors are halved and each half is quantised by its own centroids, fitted by k-means on ``SAMPLE``
vectors; a pair of centroids is a cell, and every vector is an entry of its cell. A query walks the
cells by the sum of its inner products with their two centroids, best first, with a heap, until the
cells hold as many entries as the index was calibrated for; these entries are reranked by the exact inner
product of the original vectors in double precision.

Calibration: for ``PROBES`` queries, chosen by hash, the true neighbours are found by a scan of all entries, and the number
of entries a walk passes before it meets each of them is read off the cells' counts; the budget is the
``TARGET`` quantile of those numbers. So the recall that is asked for is measured on the table itself, at every size.

Each half has about as many centroids as the square root of a quarter of the entries, so cells stay small as the table grows, up to
``MOST_CENTROIDS``. Entries are dealt out to blocks of about ``BLOCK`` by cell; a cell of more entries is split. A query
goes to the blocks that its walk touches; a block with many queries is copied for each ``BLOCK_QUERIES`` of its own, and no
other is. Within a block only the ranges of cells that a query's walk passed are scored. Nothing larger than a block and
a part of its queries is held by a task. The driver holds the sample and a count for each cell and block.

Defined cases: null, zero, non-finite or null-holding vectors and rows with a null id take no part; vectors are neighbours of
vectors of their own length, with an index for each length; rows that share an id are entries and queries each, and only the query's own row is no
neighbour of it; ties go to the smaller id; a query without other rows has no result; an empty table
gives no rows; extra columns are left out, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import storage

SAMPLE, PROBES, TARGET = 65_536, 128, 0.94
MOST_CENTROIDS, KMEANS_ROUNDS = 2_048, 10
BLOCK, BLOCK_QUERIES, STRIP, RANGE = 4_096, 4_096, 256, 256


class MultiIndex(NamedTuple):
    """The centroids of both halves, entries of each cell, first block and blocks of each cell, and the walk's budget."""

    left: np.ndarray
    right: np.ndarray
    counts: np.ndarray
    first: np.ndarray
    splits: np.ndarray
    budget: int

    def scores(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inner products of the queries' halves with the centroids."""
        half = self.left.shape[1]
        return queries[:, :half] @ self.left.T, queries[:, half:] @ self.right.T

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        """The cell of each vector."""
        half = self.left.shape[1]
        return _nearest(vectors[:, :half], self.left) * len(self.right) + _nearest(vectors[:, half:], self.right)

    def walk(self, left: np.ndarray, right: np.ndarray, least: int) -> tuple[float, list[int]]:
        """The last cell's score and the cells, best first, that together hold the budget and ``least`` entries."""
        one, two = np.argsort(-left, kind="stable").tolist(), np.argsort(-right, kind="stable").tolist()
        a, b = left[one].tolist(), right[two].tolist()
        counts, width, want = self.counts, len(b), max(self.budget, least)
        heap, got, passed, score = [(-(a[0] + b[0]), 0, 0)], 0, [], 0.0
        while heap and got < want:
            score, i, j = heapq.heappop(heap)
            cell = one[i] * width + two[j]
            if n := counts[cell]:
                got += n
                passed.append(cell)
            if j + 1 < width:
                heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
            if not j and i + 1 < len(a):
                heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))
        return -score, passed


def _nearest(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(axis=1) - 2 * vectors @ centroids.T, axis=1)


def kmeans(vectors: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """At most k centroids of some vectors."""
    distinct = np.unique(vectors, axis=0)
    rng = np.random.default_rng(seed)
    centroids = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(KMEANS_ROUNDS):
        near = _nearest(vectors, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, vectors)
        sizes = np.bincount(near, minlength=len(centroids))
        centroids[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centroids


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(-1, dim)


def taking_part(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[int]]:
    """``(row, id, vector)`` of the rows that take part, each under a number of its own, and the lengths of their vectors."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).where("id is not null and vector is not null")
    finite = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = rows.where(finite & F.exists("vector", lambda x: x != 0))
    rows = storage.written(rows.select(F.monotonically_increasing_id().alias("row"), "id", "vector"), "index-vectors")
    return rows, sorted(r[0] for r in rows.select(F.size("vector")).distinct().collect())


def _exact(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Row by row inner products, summed in the order of the components, so that equal vectors tie."""
    total = np.zeros(len(left))
    for i in range(left.shape[1]):
        total += left[:, i] * right[:, i]
    return total


class Rows(NamedTuple):
    """Row numbers, ids and vectors."""

    rows: np.ndarray
    ids: np.ndarray
    vectors: np.ndarray


def _rows(table: pa.Table | pa.RecordBatch, dim: int) -> Rows:
    return Rows(np.asarray(table.column(0)), np.asarray(table.column(1)), _matrix(table.column(2), dim))


def _top(asked: Rows, own: Rows, scores: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """``FOUND`` of the k best entries of each query by their approximate scores; minus infinity is no candidate."""
    counts = (asked.rows[:, None] != own.rows[None, :]) & (scores > -np.inf)
    scores = np.where(counts, scores, -np.inf)
    if scores.shape[1] > k:
        bound = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        counts &= scores >= (bound - 1e-9 * (1 + np.where(np.isfinite(bound), np.abs(bound), 0)))[:, None]
    q, e = np.nonzero(counts)
    exact = _exact(asked.vectors[q], own.vectors[e])
    order = np.lexsort((own.rows[e], own.ids[e], -exact, q))
    q, e, exact = q[order], e[order], exact[order]
    first = np.arange(len(q)) - np.searchsorted(q, q, "left") < k
    q, e = q[first], e[first]
    return asked.rows[q], asked.ids[q], own.rows[e], own.ids[e], exact[first]


FOUND = "query_row long, query_id long, row long, vec_id long, score double"
_FOUND = [(x.split()[0], pa.float64() if x.endswith("double") else pa.int64()) for x in FOUND.split(", ")]


def _batch(found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(found, _FOUND)], [n for n, _ in _FOUND])


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def scanned(entries: DataFrame, probes: list[tuple[int, int, list[float]]], dim: int, k: int) -> DataFrame:
    """The true neighbours of a few queries ``(row, id, vector)``, by a scan of all entries."""
    asked = Rows(np.array([r for r, _, _ in probes], np.int64), np.array([x for _, x, _ in probes], np.int64), np.array([v for *_, v in probes], float).reshape(-1, dim))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = _rows(batch, dim)
                yield _batch(_top(asked, own, asked.vectors @ own.vectors.T, k))

    return _best(entries.select("row", "id", "vector").mapInArrow(scan, FOUND), k)


def built(entries: DataFrame, dim: int, queries: DataFrame, k: int) -> tuple[MultiIndex, DataFrame]:
    """The index of the entries ``(id, vector)``, calibrated on some of the queries, and the entries with their cells."""
    spark, n = entries.sparkSession, entries.count()
    sample = entries.select("row", "vector").orderBy(F.xxhash64("row", F.lit("sample")), "row").limit(SAMPLE).toArrow()
    chosen = _matrix(sample.column("vector"), dim)
    centroids = int(min(MOST_CENTROIDS, max(1, 2 ** round(np.log2(max(1, n)) / 2 - 1))))
    half = dim // 2
    left, right = kmeans(chosen[:, :half], centroids), kmeans(chosen[:, half:], centroids)
    none = np.zeros(0, np.int64)
    bare = MultiIndex(left, right, none, none, none, 0)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = bare.cells(_matrix(batch.column(2), dim)) if batch.num_rows else none
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int32())], ["row", "id", "vector", "cell"])

    kind = entries.schema["vector"].dataType.simpleString()
    placed = storage.written(entries.select("row", "id", "vector").mapInArrow(assign, f"row long, id long, vector {kind}, cell int"), "index-entries")
    counts = np.zeros(len(left) * len(right), np.int64)
    for r in placed.groupBy("cell").count().collect():  # one row for each cell at most
        counts[r["cell"]] = r["count"]
    splits = np.maximum(1, -(-counts // BLOCK))
    starts = np.concatenate([[0], np.cumsum(np.where(splits > 1, BLOCK * splits, counts))[:-1]])
    first = starts // BLOCK
    index = MultiIndex(left, right, counts, first, splits, 0)
    probes = [(r["row"], r["id"], r["vector"]) for r in queries.orderBy(F.xxhash64("row", F.lit("probe")), "row").limit(PROBES).collect()]
    neighbours = scanned(placed, probes, dim, k).join(placed.select("row", "cell"), "row").select("query_row", "cell").collect() if probes else []
    passed, by_query = [], {}
    for r in neighbours:
        by_query.setdefault(r["query_row"], []).append(r["cell"])
    for row, _, vector in probes:
        a, b = index.scores(np.array([vector], float))
        score = (a[0][:, None] + b[0][None, :]).ravel()
        passed += [counts[score >= score[c] - 1e-12].sum() for c in by_query.get(row, [])]
    budget = int(np.quantile(passed, TARGET, method="higher")) if passed else n
    return index._replace(budget=budget), placed


def _indexed(entries: DataFrame, dim: int, k: int, every: int) -> DataFrame:
    """``FOUND`` with ``rank`` of the queries among entries of one length."""
    spark, is_query = entries.sparkSession, F.col("id") % every == 0
    index, placed = built(entries, dim, entries.where(is_query), k)
    blocks = int((index.first + index.splits).max())
    kind = placed.schema["vector"].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = index.scores(_matrix(batch.column(2), dim)) if batch.num_rows else (np.zeros((0, 0)),) * 2
            at, ends, goes = [], [], []
            for i in range(batch.num_rows):
                end, cells = index.walk(left[i], right[i], k + 1)
                cells = np.array(cells)
                spans = np.zeros(blocks + 1, np.int64)
                np.add.at(spans, index.first[cells], 1)
                np.add.at(spans, index.first[cells] + index.splits[cells], -1)
                touched = np.flatnonzero(np.cumsum(spans)[:-1])
                at += [i] * len(touched)
                ends += [end] * len(touched)
                goes += touched.tolist()
            rows = batch.take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(ends, pa.float64()), pa.array(goes, pa.int32())], ["row", "id", "vector", "last", "block"])

    queries = placed.where(is_query).select("row", "id", "vector").repartition(max(spark.sparkContext.defaultParallelism, blocks))
    spread = storage.written(queries.mapInArrow(walk, f"row long, id long, vector {kind}, last double, block int"), "index-walks")
    # a block is copied once for every BLOCK_QUERIES queries that its own cells draw, and not at all for others
    parts = np.zeros(blocks, np.int32)
    for r in spread.groupBy("block").count().collect():  # one row for each block at most
        parts[r["block"]] = -(-r["count"] // BLOCK_QUERIES)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, salt = np.asarray(batch.column(3)), np.asarray(batch.column(4))
            block = index.first[cells] + salt % index.splits[cells]
            copies = parts[block]
            at = np.repeat(np.arange(len(block)), copies)
            part = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
            rows = batch.take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([*rows.columns[:4], pa.array(block[at], pa.int32()), pa.array(part, pa.int32())], ["row", "id", "vector", "cell", "block", "part"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.asarray(batch.column(5)) % np.maximum(1, parts[np.asarray(batch.column(4))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(part, pa.int32())], ["row", "id", "vector", "last", "block", "part"])

    salt = lambda name: F.pmod(F.xxhash64("row", F.lit(name)), F.lit(1 << 30)).alias("salt")
    dealt = placed.select("row", "id", "vector", "cell", salt("block")).mapInArrow(deal, f"row long, id long, vector {kind}, cell int, block int, part int")
    asked = spread.select("row", "id", "vector", "last", "block", salt("part")).mapInArrow(ask, f"row long, id long, vector {kind}, last double, block int, part int")

    def rerank(entries: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if entries.num_rows and queries.num_rows:
            entries = entries.sort_by("cell")
            own, cells = _rows(entries, dim), np.asarray(entries["cell"])
            a, b = np.divmod(cells, len(index.right))
            for at in range(0, queries.num_rows, STRIP):
                some = queries.slice(at, STRIP)
                strip, last = _rows(some, dim), np.asarray(some["last"])
                left, right = index.scores(strip.vectors)
                scores = np.full((len(last), len(cells)), -np.inf)
                for low in range(0, len(cells), RANGE):  # cells lie together, so a range that a query's walk didn't touch costs it nothing
                    high = min(low + RANGE, len(cells))
                    seen = left[:, a[low:high]] + right[:, b[low:high]] >= (last - 1e-9)[:, None]
                    q = np.flatnonzero(seen.any(axis=1))
                    if len(q):
                        scores[q, low:high] = np.where(seen[q], strip.vectors[q] @ own.vectors[low:high].T, -np.inf)
                out.append(_batch(_top(strip, own, scores, k)))
        return pa.Table.from_batches(out, pa.schema(_FOUND))

    return _best(dealt.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInArrow(rerank, FOUND), k)


def neighbours(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest found of each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    storage.bounded_batches(spark)
    entries, lengths = taking_part(vectors, id_col, vector_col)
    out = None
    for dim in lengths:
        found = _indexed(entries.where(F.size("vector") == dim), dim, k, every).select("query_id", "rank", "vec_id", "score")
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double") if out is None else out
