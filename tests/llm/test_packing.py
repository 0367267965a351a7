import random
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_ids(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 1]


def check(pieces, lengths, tokens, segments, loss, loss_from):
    """Every id in exactly one piece, sequences gapless, all three limits kept."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for doc, start, length, _, total, sequence, offset, bears in pieces:
        assert length > 0 and total == lengths[doc]
        assert bears == sum(p >= loss_from[doc] for p in range(start, start + length))
        by_doc[doc].append((start, length))
        by_sequence[sequence].append((offset, length, bears))
    assert set(by_doc) == {d for d, n in lengths.items() if n}
    for spans, places in ((by_doc, True), (by_sequence, False)):
        for key, found in spans.items():
            at = 0
            for x in sorted(found):
                assert x[0] == at
                at += x[1]
            assert at == lengths[key] if places else at <= tokens
    for found in by_sequence.values():
        assert len(found) <= segments and sum(x[2] for x in found) <= loss
    return len(by_sequence)


@pytest.mark.parametrize("segments, loss", [(100, 50), (3, 50), (4, 20), (1, 50), (100, 7)])
def test_limits_hold_together(segments, loss):
    rng = random.Random(segments + loss)
    lengths = {i: rng.choice([1, 2, 5, 30, 50, 51, 400, rng.randint(1, 90)]) for i in range(300)}
    loss_from = {i: rng.choice([0, 0, n // 2, n]) for i, n in lengths.items()}
    packer = packing.Packer(50, segments, loss, least_cut=1)
    for i, n in lengths.items():
        packer.add(i, bytes(4 * n), loss_from[i])
        if i % 70 == 0:
            packer.pack()
    packer.pack()
    check(packer.drain(), lengths, 50, segments, loss, loss_from)


def test_little_padding():
    rng = random.Random(1)
    lengths = {i: int(rng.lognormvariate(6, 1.2)) + 1 for i in range(3000)}
    packer = packing.Packer(2048, 128, 2048)
    for i, n in lengths.items():
        packer.add(i, bytes(4 * n))
    packer.pack()
    used = check(packer.drain(), lengths, 2048, 128, 2048, dict.fromkeys(lengths, 0))
    assert sum(lengths.values()) / (2048 * used) > 0.995


def test_pieces_hold_the_tokenizers_ids(spark):
    rng = random.Random(2)
    texts = [None, "", " ", "One two, three!", "é" * 5000, "<|endoftext|> A's it's 12", "x " * 9000, "One two, three!"]
    texts += [" ".join(rng.choice(["alpha", "Beta,", "über", "12", "don't"]) for _ in range(rng.randint(1, 900))) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, sequence_id string, start int").repartition(3)
    pieces = packing.packed(docs, PATH).collect()
    ids = {i: plain_ids(t) for i, t in enumerate(texts)}
    check(pieces, {i: len(x) for i, x in ids.items()}, 2048, 128, 2048, dict.fromkeys(ids, 0))
    for p in pieces:
        own = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert p["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own))


def test_empty_table_and_null_ids(spark):
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
    rows = packing.packed(spark.createDataFrame([(None, "a"), (None, None)], "doc_id long, text string"), PATH).collect()
    assert sorted((r["doc_id"], r["doc_tokens"]) for r in rows) == [(None, 1), (None, 2)]


def plain_packed(items, tokens, segments, loss, least_cut):
    """The same choices, one candidate at a time: ``(doc, start, length)`` by sequence."""
    sequences, current = [], []
    left = []
    for doc, total, first in items:
        start = 0
        while (most := min(total - start, tokens, max(0, first - start) + loss)) < total - start:
            sequences.append([(doc, start, most)])
            start += most
        if start < total:
            left.append([doc, start, total, first])
    bears = lambda x, n: max(0, x[1] + n - max(x[1], x[3]))
    used = [0, 0, 0]
    while left:
        room = tokens - used[0], segments - used[1], loss - used[2]
        best, score = None, -1.0
        for x in left:
            n = x[2] - x[1]
            if n <= room[0] and room[1] and bears(x, n) <= room[2]:
                dot = n * (room[0] / tokens**2) + bears(x, n) * (room[2] / loss**2)
                if dot > score:
                    best, score = x, dot
        if best is not None:
            n = best[2] - best[1]
            current.append((best[0], best[1], n))
            used = [used[0] + n, used[1] + 1, used[2] + bears(best, n)]
            left.remove(best)
            continue
        longest = max(left, key=lambda x: x[2] - x[1])
        most = min(longest[2] - longest[1], room[0], max(0, longest[3] - longest[1]) + room[2])
        if room[1] and most >= least_cut:
            current.append((longest[0], longest[1], most))
            longest[1] += most
        sequences.append(current)
        current, used = [], [0, 0, 0]
    return sorted(sorted(x) for x in [*sequences, current] if x)


@pytest.mark.parametrize("seed, segments, loss", [(1, 100, 64), (2, 3, 64), (3, 6, 24), (4, 2, 10)])
def test_choices_are_those_of_a_plain_packer(seed, segments, loss):
    rng = random.Random(seed)
    items = []
    for i in range(250):
        n = rng.choice([1, 3, 9, 30, 64, 200, rng.randint(1, 70)])
        items.append((i, n, rng.choice([0, n // 3, n])))
    packer = packing.Packer(64, segments, loss)
    for doc, n, first in items:
        packer.add(doc, bytes(4 * n), first)
    packer.pack()
    by_sequence = defaultdict(list)
    for doc, start, length, _, _, sequence, _, _ in packer.drain():
        by_sequence[sequence].append((doc, start, length))
    assert sorted(map(sorted, by_sequence.values())) == plain_packed(items, 64, segments, loss, packing.LEAST_CUT)


def test_short_texts_leave_no_padding(spark):
    docs = spark.createDataFrame([(i, "one two") for i in range(4000)], "doc_id long, text string").coalesce(1)
    rows = packing.packed(docs, PATH).collect()
    assert sum(r["length"] for r in rows) / (2048 * len({r["sequence_id"] for r in rows})) > 0.95


def test_examples_without_ids_are_kept(spark):
    docs = spark.createDataFrame([(1, ""), (2, None), (3, "word"), (None, "")], "doc_id long, text string")
    rows = {(r["doc_id"], r["length"], r["doc_tokens"], r["sequence_id"] is None) for r in packing.packed(docs, PATH, end_id=None).collect()}
    assert rows == {(1, 0, 0, True), (2, 0, 0, True), (3, 1, 1, False), (None, 0, 0, True)}


def test_conversations_keep_all_limits(spark):
    from tidemark.llm import queries

    sf = "/root/testdata/sf0.001"
    turns = {(r["conv_id"], r["turn"]): r for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    lengths, loss_from = {}, {}
    for (conv, turn), r in turns.items():
        if r["role"] == "assistant":
            before = turns.get((conv, turn - 1))
            prompt = plain_ids(before["text"])[:-1] if before and before["role"] == "user" else []
            lengths[f"{conv}/{turn}"], loss_from[f"{conv}/{turn}"] = len(prompt) + len(plain_ids(r["text"])), len(prompt)
    pieces = [tuple(r) for r in queries.conversation_packing(spark, sf).collect()]
    assert any(0 < first for first in loss_from.values())
    check(pieces, lengths, 2048, 12, 1280, loss_from)
