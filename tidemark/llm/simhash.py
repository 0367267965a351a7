"""SimHash near-duplicates by bit-sliced comparison.

A document's fingerprint is the majority of its shingles' 64-bit hashes, bit by bit. Documents of
equal fingerprint form a class. Two classes at ``radius`` or fewer differing bits link; of m equal
parts of the 64 bits they then agree in m - radius at least, so every combination of so many parts
is a key, and only classes that share a key are compared: no pair within the radius is missed.

Within the tasks fingerprints lie as 64 bit planes. The planes XORed with themselves, shifted by d
lanes, hold the differences of each row and its d-th successor; carry-save counters add up all lanes
at once, and a block of 64 lanes is left as soon as all its counts exceed the radius. Of each key's
links a spanning forest is kept, and components are the fixed point of alternating star contraction.

Defined cases: a null, empty or blank text has fingerprint zero and is linked like any other; fewer
words than a shingle make one shingle; repeated rows and null ids are kept, a null id is never the
component's name unless the component has no other. Very long texts are hashed whole, in stretches. Extra columns, whatever their
names, are left out, and kept by ``deduplicated``.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import storage

SHINGLE_WORDS, RADIUS, SEED = 4, 4, 42
#: Classes of one key that one task compares; larger keys are dealt out as pairs of parts.
KEY_ROWS = 2_048
#: Rows that the comparison holds at once.
BLOCK_ROWS = 1 << 16


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The fingerprint of one text as an unsigned integer."""
    found = (text or "").encode("utf-8").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: 1 - words]
    digest, seed = xxhash.xxh64_intdigest, SEED
    hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts.tolist(), ends[words - 1 :].tolist())], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, fp)`` of each row; fp is the fingerprint as a signed long."""
    storage.bounded_batches(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x, words) for x in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scan, f"doc_id {kind}, fp long")


def _planes(fps: np.ndarray) -> np.ndarray:
    """64 rows of bits, 64 lanes a word; row b holds bit b of each fingerprint."""
    padded = np.zeros(-(-len(fps) // 64) * 64, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def _lanes(flags: np.ndarray, words: int) -> np.ndarray:
    padded = np.zeros(words * 64, bool)
    padded[: len(flags)] = flags
    return np.packbits(padded, bitorder="little").view("<u8")


def _within(planes: np.ndarray, shift: int, valid: np.ndarray, radius: int) -> np.ndarray:
    """Lanes i of ``valid`` whose fingerprint differs from that of lane i + shift in at most ``radius`` bits."""
    blocks = np.flatnonzero(valid)
    alive, skip, rest = valid[blocks], shift // 64, np.uint64(shift % 64)
    counters = [np.zeros(len(blocks), np.uint64) for _ in range(4)]  # weights 1, 2, 4, and 8 or more
    last = planes.shape[1] - 1
    for b in range(64):
        plane = planes[b]
        near = np.where(blocks + skip <= last, plane[np.minimum(blocks + skip, last)], np.uint64(0))
        if rest:
            far = np.where(blocks + skip + 1 <= last, plane[np.minimum(blocks + skip + 1, last)], np.uint64(0))
            near = (near >> rest) | (far << (np.uint64(64) - rest))
        carry = plane[blocks] ^ near
        for k in range(3):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        counters[3] |= carry
        if b % 8 == 7:
            one, two, four, more = counters
            alive &= ~(more | _over(one, two, four, radius))
            stay = alive != 0
            if not stay.any():
                return np.zeros(0, np.int64)
            if not stay.all():
                blocks, alive = blocks[stay], alive[stay]
                counters = [x[stay] for x in counters]
    bits = np.unpackbits(alive.view(np.uint8), bitorder="little").reshape(-1, 64)
    at, lane = np.nonzero(bits)
    return blocks[at] * 64 + lane


def _over(one: np.ndarray, two: np.ndarray, four: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose three-bit count is above ``radius``."""
    over, equal = np.zeros_like(one), ~np.zeros_like(one)
    for bit, weight in ((four, 4), (two, 2), (one, 1)):
        if radius & weight:
            equal &= bit
        else:
            over |= equal & bit
            equal &= ~bit
    return over


def links(keys: np.ndarray, fps: np.ndarray, side: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between rows of equal key; rows are sorted by key.

    ``side`` is 0 where a key's rows are all compared; where a key has rows of sides 1 and 2 only links across are new.
    """
    if radius > 7:
        raise ValueError("the counters hold radii up to 7")
    n, label = len(fps), np.arange(len(fps))
    first = np.searchsorted(keys, keys, "left")
    last = np.searchsorted(keys, keys, "right")
    planes, left, right = _planes(fps), [], []
    for shift in range(1, int((last - first).max(initial=1))):
        valid = np.zeros(n, bool)
        valid[:-shift] = (keys[:-shift] == keys[shift:]) & ((side[:-shift] == 0) | (side[:-shift] != side[shift:]))
        at = _within(planes, shift, _lanes(valid, planes.shape[1]), radius)
        at = at[label[at] != label[at + shift]]
        for i in at.tolist():
            a, b = label[i], label[i + shift]
            if a != b:
                own = label[first[i] : last[i]]
                own[own == max(a, b)] = min(a, b)
                left.append(i)
                right.append(i + shift)
    return fps[np.array(left, np.int64)], fps[np.array(right, np.int64)]


def _compare(radius: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush(final: bool) -> Iterator[pa.RecordBatch]:
            key, part, fp, side = (np.concatenate(x) for x in zip(*held))
            end = len(key)
            if not final:  # the last key may go on in the next batch
                end = int(np.flatnonzero((key != key[-1]) | (part != part[-1]))[-1] + 1) if (key[0], part[0]) != (key[-1], part[-1]) else 0
            held[:] = [(key[end:], part[end:], fp[end:], side[end:])]
            if end:
                changes = np.concatenate([[0], np.cumsum((key[1:end] != key[: end - 1]) | (part[1:end] != part[: end - 1]))])
                a, b = links(changes, fp[:end].view(np.uint64), side[:end], radius)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append(tuple(np.asarray(batch.column(i)) for i in range(4)))
                if sum(len(x[0]) for x in held) >= BLOCK_ROWS:
                    yield from flush(final=False)
        if held:
            yield from flush(final=True)

    return scan


def _parts(classes: int) -> int:
    """Parts of the 64 bits: more parts make longer keys, so that keys stay rare at any size."""
    return next((m for m, most in ((6, 1 << 23), (7, 1 << 29)) if classes <= most), 8)


def _keyed(classes: DataFrame, radius: int, parts: int) -> DataFrame:
    edges = [round(64 * i / parts) for i in range(parts + 1)]
    field = [F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << (high - low)) - 1)) for low, high in itertools.pairwise(edges)]
    keys = [F.xxhash64(F.lit(i), *(field[x] for x in chosen)) for i, chosen in enumerate(itertools.combinations(range(parts), parts - radius))]
    return classes.select("fp", F.explode(F.array(*keys)).alias("key"))


def class_links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints ``fp`` that join the same classes as all links within the radius do."""
    spark = classes.sparkSession
    keyed = storage.written(_keyed(classes, radius, _parts(classes.count())), "simhash-keys")
    common = keyed.groupBy("key").count().where(F.col("count") > KEY_ROWS).withColumn("deals", F.ceil(F.col("count") / KEY_ROWS).cast("int")).drop("count")
    common = storage.small(storage.written(common, "simhash-common"))
    plain = keyed.join(common, "key", "left_anti").select("key", F.lit(0).cast("long").alias("part"), "fp", F.lit(0).alias("side"))
    own = F.pmod(F.xxhash64("fp", F.lit("part")), F.col("deals")).cast("int")
    dealt = keyed.join(common, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    dealt = dealt.select("key", (low.cast("long") * F.col("deals") + high).alias("part"), "fp", side.alias("side"))
    rows = plain.unionByName(dealt).repartition("key", "part").sortWithinPartitions("key", "part", "fp")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BLOCK_ROWS))
    found = storage.written(rows.mapInArrow(_compare(radius), "a long, b long").distinct(), "simhash-links")
    storage.bounded_batches(spark)
    return found


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for each node of the links ``(a, b)``; the root is a component's least node.

    Large-star and small-star contraction in turn until the links no longer change, each round written to the shared folder. The
    least neighbours are written before they are joined: an aggregate beside a join keeps Spark from splitting a hot node's links.
    """

    leasts: list[DataFrame] = []

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = storage.written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least")), "simhash-least")
        leasts.append(least)
        joined = both.join(least, "a")
        if large:
            out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
        return out.where(F.col("a") != F.col("b")).distinct()

    state = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    pairs = edges.where(F.col("a") != F.col("b")).select("a", "b")
    before = None
    while True:
        large = storage.written(star(pairs, large=True), "simhash-star")
        small = storage.written(star(large, large=False), "simhash-star")
        storage.dropped(large, *leasts, *([pairs] if before else []))
        leasts.clear()
        pairs = small
        if (now := state(pairs)) == before:
            break
        before = now
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for each row; component_id is the least id that links reach."""
    rows = storage.written(fingerprints(docs, id_col, text_col, words), "simhash-rows")
    classes = storage.written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    roots = storage.written(components(class_links(classes, radius)), "simhash-roots")
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = storage.written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-names")  # as in ``components``
    named = rooted.join(names, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` of each component, with all columns: that of the least id, of ids the least text hash; null ids come last.

    Rows are told apart by id and text, so neither a null nor a repeated id takes other rows along; of rows equal in both one stays.
    The marks of rows grow with the rows, so they are never broadcast: texts move once by shuffle at every size, and each task hashes its marks.
    """
    text, own = F.col(text_col).cast("string"), F.col(id_col)
    row = F.struct(own.isNull().alias("missing"), own.alias("id"), F.xxhash64(text).alias("digest"), F.hash(text).alias("check"))
    kept = F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)))
    rows = docs.select(row.alias("row"), kept.alias("kept"))
    found = near_duplicates(docs.select(row.alias("row"), text.alias("text")), "row", "text")
    marks = found.groupBy("doc_id", (F.col("doc_id") != F.col("component_id")).alias("gone")).count().where("gone OR count > 1")
    marks = storage.written(marks.select(F.col("doc_id").alias("mark"), "gone"), "simhash-marks")

    def joined(some: DataFrame, how: str) -> DataFrame:
        return rows.join(some.hint("shuffle_hash"), [F.col("row")[x].eqNullSafe(F.col("mark")[x]) for x in ("id", "digest", "check")], how)

    out = joined(marks, "left_anti")
    repeated = marks.where("NOT gone")
    if not repeated.isEmpty():
        out = out.unionByName(joined(repeated, "left_semi").dropDuplicates(["row"]))
    return out.select(*(F.col("kept")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)))
