import random
import zlib
from collections import Counter

import pytest

from pyspark.sql import functions as F

from tidemark.llm import sharding


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, slot int, spot string").repartition(3)


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 500])
def test_counts_and_slots(spark, n):
    rows = [(i, "é" * (i % 9)) for i in range(n)]
    found = sharding.sharded(docs_of(spark, rows)).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == [(i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in rows]
    counts = Counter(r["shard"] for r in found)
    assert sum(counts.values()) == n and max(counts.values(), default=0) - min((counts[s] for s in range(8)), default=0) <= 1
    for shard in range(8):
        assert sorted(r["slot"] for r in found if r["shard"] == shard) == list(range(counts[shard]))
    assert {(r["law"], r["grown_shard"]) for r in found} <= {("rows", None)}


def test_nulls_and_repeated_rows(spark):
    rows = [(None, None)] * 50 + [(7, "same")] * 70 + [(i, None) for i in range(30)] + [(None, "a")] * 3
    found = sharding.sharded(docs_of(spark, rows)).collect()
    assert Counter((r["doc_id"], r["size"]) for r in found) == Counter((d, len(t or "") + 1) for d, t in rows)
    counts = Counter(r["shard"] for r in found)
    assert max(counts.values()) - min(counts.values()) <= 1


def walk(counts, shards):
    """Row by row: home rows first in ring order, then each row that overflows goes on to the next node with room."""
    places, owners = sharding.ring(shards)
    room = sharding.fair(sum(counts.values()), shards)
    home = lambda slot: next((i for i, p in enumerate(places) if p >= slot), 0)
    out, over = Counter(), []
    for slot in sorted(counts):
        for rank in range(counts[slot]):
            s = owners[home(slot)]
            if room[s]:
                room[s] -= 1
                out[slot, rank] = s
            else:
                over.append((slot, rank))
    for slot, rank in over:
        i = home(slot)
        while not room[owners[i]]:
            i = (i + 1) % len(places)
        room[owners[i]] -= 1
        out[slot, rank] = owners[i]
    return out


def test_matches_row_by_row_walk():
    rng = random.Random(6)
    counts = Counter(rng.randrange(sharding.SLOTS) for _ in range(3000)) + Counter({5: 900})
    found = {(slot, rank): shard for slot, first, end, shard, _ in sharding.placed(counts, 8) for rank in range(first, end)}
    assert found == walk(counts, 8)


def test_growth_moves_few_rows():
    rng = random.Random(8)
    counts = Counter(rng.randrange(sharding.SLOTS) for _ in range(20_000))
    at = lambda k: {(slot, rank): shard for slot, first, end, shard, _ in sharding.placed(counts, k) for rank in range(first, end)}
    old, new = at(8), at(9)
    moved = sum(old[x] != new[x] for x in old) / len(old)
    assert 1 / 9 - 0.01 <= moved < 0.35


def test_very_hot_repeats_are_written_out_by_many_tasks(spark):
    """One row that is there a million times among a few others: stretches, not one array; every copy has a place of its own."""
    counted = spark.createDataFrame([(1, 5, 7, 1_000_000), (2, 5, 7, 3), (None, 1, 0, 4_097)], "doc_id long, size long, text_crc32 long, count long")
    rows = sharding._copies(counted)
    assert {(r.doc_id, r.n, r.least, r.most) for r in rows.groupBy("doc_id").agg(F.count_distinct("copy").alias("n"), F.min("copy").alias("least"), F.max("copy").alias("most")).collect()} == {(1, 1_000_000, 1, 1_000_000), (2, 3, 1, 3), (None, 4_097, 1, 4_097)}
    parts = [r.n for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(parts) > 1 and max(parts) < 0.6 * sum(parts)
