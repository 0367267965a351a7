"""How much the sources of a language differ, by the frequencies of their words.

Texts are counted where they lie: a task holds one table of counts and sends on a row for each language, source and term. A term is
kept in its language if enough documents have it. Frequencies are whole numbers of billionths, smoothed by one count, and all
arithmetic is exact.

Sources are compared all with all by two-dimensional tiling. A source's counts are packed into vectors, one for each ``CHUNK`` terms of
the vocabulary; the sources of a language are dealt to blocks of about ``BLOCK``, and the vectors replicated to the tiles of block
by block. A task takes a tile over a span of ``SPAN`` successive chunks and adds up its part of the tile's matrix, chunk by chunk; it holds two
blocks' vectors of one chunk and the matrix, whatever the vocabulary and the number of sources. The spans' matrices are then added.

Defined cases: null texts, languages and sources count as empty ones; a group without terms, or a language without kept terms, is compared
all the same; repeated rows and null ids are documents each; very long texts are read whole; ties rank by the item's UTF-8 bytes;
an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import storage
from tidemark.operators import ordered

#: Documents that must have a term, smoothing count, and frequencies' denominator; ranks of a source's own terms.
LEAST_DOCUMENTS, SMOOTHING, BILLION, TERM_RANKS = 3, 1, 1_000_000_000, 200
#: Terms of a vector, vectors of successive chunks that a task takes, and sources of a block.
CHUNK, SPAN, BLOCK = 4_096, 8, 64
#: Terms that a task holds before it sends their counts on.
HELD = 400_000

_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
#: Bytes to bytes: ASCII letters in lower case and all bytes beyond ASCII stay, others part words.
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256)).translate(bytes.maketrans(_UPPER, _LOWER))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in UTF-8, repeats included."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(lang, source, text)`` to partial counts; the empty term stands for the group itself."""
    counts: dict[tuple[str, str], Counter[bytes]] = defaultdict(Counter)
    docs: dict[tuple[str, str], Counter[bytes]] = defaultdict(Counter)

    def told() -> Iterator[pa.RecordBatch]:
        for key, own in counts.items():
            names, having = list(own), docs[key]
            for at in range(0, len(names), 1 << 16):
                some = names[at : at + (1 << 16)]
                columns = [pa.array([key[0]] * len(some)), pa.array([key[1]] * len(some)), pa.array([x.decode("utf-8", "replace") for x in some]), pa.array([own[x] for x in some], pa.int64()), pa.array([having[x] for x in some], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            own, having, found = counts[lang, source], docs[lang, source], terms(text)
            own.update(found)
            having.update(set(found))
            own[b""] += 0
        if sum(map(len, counts.values())) > HELD:
            yield from told()
            counts.clear()
            docs.clear()
    yield from told()


def counted(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences and documents of each term of each group, and a row with an empty term for each group."""
    storage.bounded_batches(docs.sparkSession)
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_{i}") for i, c in enumerate((lang_col, source_col, text_col))))
    found = rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def frequency(count: Column, total: Column, kept: Column) -> Column:
    """A smoothed frequency in billionths, exactly."""
    above = (count + SMOOTHING).cast("decimal(20,0)") * F.lit(BILLION).cast("decimal(10,0)")
    return F.lit(1).cast("long") + F.call_function("div", above, (total + SMOOTHING * kept).cast("decimal(20,0)"))


def _difference(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _frequencies(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """As ``frequency``, three digits at a time, so that nothing exceeds 64 bits for totals up to nine thousand million millions."""
    rest, below, out = counts + SMOOTHING, total + SMOOTHING * kept, np.zeros_like(counts)
    for _ in range(3):
        out = out * 1000 + rest * 1000 // below
        rest = rest * 1000 % below
    return out + 1


class _Tile:
    """The matrices of one tile and span, filled chunk by chunk: how far each source of one block is from each of the other."""

    def __init__(self, lang: str, span: int, chunk: int, chunks: int, kept: int) -> None:
        self.lang, self.chunk, self.kept = lang, chunk, kept
        self.first, self.end = span * chunks, min((span + 1) * chunks, -(-kept // chunk))
        self.names: list[list[str]] = [[], []]
        self.totals: list[list[int]] = [[], []]
        self.forth = self.back = np.zeros((0, 0), np.int64)
        self.at, self.rows = self.first, ({}, {})

    def group(self, side: int, source: str, total: int) -> None:
        self.names[side].append(source)
        self.totals[side].append(total)

    def vector(self, side: int, source: str, chunk: int, places: np.ndarray, counts: np.ndarray) -> None:
        while self.at < chunk:
            self._add()
        self.rows[side][source] = places, counts

    def _add(self) -> None:
        """The chunk's part of the matrices; sources without its terms have the least frequency throughout."""
        width = min(self.chunk, self.kept - self.at * self.chunk)
        dense = []
        for side in (0, 1):
            out = np.empty((len(self.names[side]), width), np.int64)
            for i, (name, total) in enumerate(zip(self.names[side], self.totals[side])):
                counts = np.zeros(width, np.int64)
                if name in self.rows[side]:
                    places, found = self.rows[side][name]
                    counts[places] = found
                out[i] = _frequencies(counts, total, self.kept)
            dense.append(out)
        if not self.forth.size:
            self.forth = np.zeros((len(dense[0]), len(dense[1])), np.int64)
            self.back = np.zeros_like(self.forth)
        for i, p in enumerate(dense[0]):
            square = (p - dense[1]) ** 2
            self.forth[i] += (square // dense[1]).sum(axis=1)
            self.back[i] += (square // p).sum(axis=1)
        self.at, self.rows = self.at + 1, ({}, {})

    def told(self, same: bool) -> pa.RecordBatch:
        """Rows ``(lang, source, item, value)``; in a tile of a block with itself both directions are in one matrix."""
        while self.at < self.end:
            self._add()
        if not self.forth.size:
            self.forth = self.back = np.zeros((len(self.names[0]), len(self.names[1])), np.int64)
        out = []
        for i, a in enumerate(self.names[0]):
            for j, b in enumerate(self.names[1]):
                if a != b:
                    out.append((a, b, int(self.forth[i, j])))
                    if not same:
                        out.append((b, a, int(self.back[i, j])))
        columns = [list(x) for x in zip(*out)] or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array([self.lang] * len(out), pa.string()), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], ["lang", "source", "item", "value"])


def _compared(chunk: int, chunks: int):
    """Sorted rows ``(lang, low, high, span, side, chunk, source, kept, total, places, counts)``, first each tile's groups (chunk -1), to its matrix."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tile = None, None
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(4))))
            sides, at, sources, kept, totals = (batch.column(i).to_pylist() for i in range(4, 9))
            for i, now in enumerate(keys):
                if now != key:
                    if tile is not None:
                        yield tile.told(key[1] == key[2])
                    key, tile = now, _Tile(now[0], now[3], chunk, chunks, kept[i])
                for side in (0, 1) if now[1] == now[2] else (sides[i],):
                    if at[i] < 0:
                        tile.group(side, sources[i], totals[i])
                    else:
                        tile.vector(side, sources[i], at[i], *(batch.column(c)[i].values.to_numpy() for c in (9, 10)))
        if tile is not None:
            yield tile.told(key[1] == key[2])

    return scan


def pairs(groups: DataFrame, vectors: DataFrame, chunk: int = CHUNK, chunks: int = SPAN, block: int = BLOCK) -> DataFrame:
    """``(lang, source, item, value)`` for every two sources of a language.

    ``groups`` are ``(lang, source, kept, total, sources)``, the last two being counts of the source's kept terms and of the language's sources;
    ``vectors`` are ``(lang, source, chunk, places, counts)``.
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.col("sources") / block)).cast("int")
    dealt = groups.withColumn("own", F.pmod(F.xxhash64("source"), blocks).cast("int")).withColumn("_blocks", blocks)
    spans = F.greatest(F.lit(1), F.ceil(F.col("kept") / (chunk * chunks))).cast("int")
    dealt = storage.written(dealt.withColumn("spans", spans), "audit-groups")
    none = [F.array().cast("array<int>").alias("places"), F.array().cast("array<long>").alias("counts")]
    heads = dealt.withColumn("span", F.explode(F.sequence(F.lit(0), F.col("spans") - 1))).withColumn("chunk", F.lit(-1).cast("long")).select("*", *none)
    packed = vectors.join(dealt, ["lang", "source"]).withColumn("span", F.floor(F.col("chunk") / chunks).cast("int"))
    rows = heads.unionByName(packed.select(heads.columns)).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    rows = rows.select("lang", low.alias("low"), high.alias("high"), "span", (F.col("own") > F.col("other")).cast("int").alias("side"), "chunk", "source", "kept", "total", "places", "counts")
    keys = ["lang", "low", "high", "span"]
    parts = rows.repartition(*keys).sortWithinPartitions(*keys, "chunk").mapInArrow(_compared(chunk, chunks), "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = LEAST_DOCUMENTS, ranks: int = TERM_RANKS, chunk: int = CHUNK, chunks: int = SPAN, block: int = BLOCK) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: for each group its distance to the language's other sources, and its most telling terms."""
    found = storage.written(counted(docs, lang_col, source_col, text_col), "audit-counts")
    vocabulary = found.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least)
    vocabulary = storage.written(ordered.numbered(vocabulary.drop("docs"), ["lang"], ["term"], "number"), "audit-vocabulary")
    kept = storage.written(found.join(vocabulary, ["lang", "term"]).drop("docs"), "audit-kept")

    sizes = vocabulary.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    own = found.where("term = ''").select("lang", "source")
    sources = own.groupBy("lang").agg(F.count("*").alias("sources"))
    groups = own.join(sums, ["lang", "source"], "left").join(sizes, "lang", "left").join(sources, "lang")
    groups = storage.written(groups.fillna(0, ["total", "kept", "lang_total"]), "audit-sums")

    place = F.col("number") - 1
    entry = F.struct((place % chunk).cast("int").alias("place"), "n")
    packed = kept.groupBy("lang", "source", F.floor(place / chunk).alias("chunk")).agg(F.collect_list(entry).alias("own"))
    vectors = packed.select("lang", "source", "chunk", F.col("own.place").alias("places"), F.col("own.n").alias("counts"))
    apart = pairs(groups.drop("lang_total"), vectors, chunk, chunks, block)
    apart = apart.select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    p, q = frequency(F.col("n"), F.col("total"), F.col("kept")), frequency(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    told = kept.join(groups, ["lang", "source"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), p.alias("p"), q.alias("q"))
    told = told.where("p > q").select("lang", "source", "part", "item", _difference(F.col("p"), F.col("q")).alias("value"))

    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = told.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= ranks)
    return apart.withColumn("rank", F.row_number().over(by)).unionByName(best)
