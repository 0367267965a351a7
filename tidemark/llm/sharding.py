"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Rows hash to the slots of a ring on which every shard has virtual nodes. A row belongs to the shard of
the next node clockwise; a shard takes no more than its bound, and what overflows goes on clockwise to
the next shard with room. The bounds are the rows' fair shares, so counts differ by one at most (the
law ``rows``), and only rows beyond a shard's bound leave the place that the ring gives them.

The driver sees one count for each ring slot, a fixed number, and returns for each slot the shards of
its ranks. Rows are ranked within slots, whose hashes are uniform whatever the ids; equal rows are
counted first and then dealt out as numbered copies, stretch by stretch, so no id is hot, be it a third of all rows.

Defined cases: a null text has size 1 and the checksum of no bytes; null ids and repeated rows are
placed like others; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import bisect

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import storage

SLOTS, NODES = 1 << 14, 128
#: Copies of one row that a task writes out at once.
STRETCH = 4_096


def ring(shards: int, nodes: int = NODES, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """The virtual nodes' slots in ascending order, and their shards. A shard's nodes don't depend on the other shards."""
    places = sorted((xxhash.xxh64_intdigest(f"{shard}/{node}") % slots, shard) for shard in range(shards) for node in range(nodes))
    return [p for p, _ in places], [s for _, s in places]


def fair(rows: int, shards: int) -> list[int]:
    """Each shard's bound: equal shares, the first shards take what is left over."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def placed(counts: dict[int, int], shards: int, nodes: int = NODES, slots: int = SLOTS) -> list[tuple[int, int, int, int, int]]:
    """``(slot, first rank, end rank, shard, first place in the shard)`` for all rows of all ring slots."""
    places, owners = ring(shards, nodes, slots)
    room, taken = fair(sum(counts.values()), shards), [0] * shards
    out: list[tuple[int, int, int, int, int]] = []

    def take(slot: int, first: int, end: int, shard: int) -> int:
        n = min(end - first, room[shard] - taken[shard])
        if n:
            out.append((slot, first, first + n, shard, taken[shard]))
            taken[shard] += n
        return first + n

    over = []
    for slot in sorted(counts):
        at = bisect.bisect_left(places, slot) % len(places)
        if (first := take(slot, 0, counts[slot], owners[at])) < counts[slot]:
            over.append((slot, first, at))
    for slot, first, at in over:
        while first < counts[slot]:
            at = (at + 1) % len(places)
            first = take(slot, first, counts[slot], owners[at])
    return out


def _copies(counted: DataFrame) -> DataFrame:
    """Rows with a ``count`` as numbered copies; those of one row are cut to stretches of ``STRETCH``, which go to all tasks before they are written out."""
    parts = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = counted.withColumn("first", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count"), F.lit(STRETCH).cast("long"))))
    cut = cut.repartition(parts, "doc_id", "size", "text_crc32", "first")
    last = F.least(F.col("first") + STRETCH - 1, F.col("count"))
    return cut.withColumn("copy", F.explode(F.sequence("first", last))).drop("count", "first")


def sharded(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", nodes: int = NODES, slots: int = SLOTS) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` of each row; slot numbers a shard's rows from 0."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = _copies(rows.groupBy("doc_id", "size", "text_crc32").count())
    spot = F.xxhash64("doc_id", "size", "text_crc32", "copy")
    rows = storage.written(rows.withColumn("spot", spot).withColumn("ring_slot", F.pmod("spot", F.lit(slots)).cast("int")), "ring-rows")
    counts = {r["ring_slot"]: r["count"] for r in rows.groupBy("ring_slot").count().collect()}  # at most one row for each of the fixed slots
    segments = spark.createDataFrame(placed(counts, shards, nodes, slots), "ring_slot int, first long, end long, shard int, base long")
    order = Window.partitionBy("ring_slot").orderBy("spot", "doc_id", "size", "text_crc32", "copy")
    ranked = rows.withColumn("rank", (F.row_number().over(order) - 1).cast("long"))
    found = ranked.join(F.broadcast(segments), (ranked["ring_slot"] == segments["ring_slot"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
    slot = F.col("base") + F.col("rank") - F.col("first")
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
