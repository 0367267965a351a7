import random
import zlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from tidemark.llm import encoding, storage, token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = "aAbBéÉßΣσςİı  \t\n\x0b\x1c\x85\xa0　́̀ﬁ'sStTl.,!*$<|>0123٣漢😀ẞÅ▁\x00각ᄀ"


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=ODD, max_size=20))
def test_word_tables_give_what_the_libraries_give(text):
    ids = encoding.ids_of(PATH)
    assert ids(text) == ids.whole(text)
    counts = encoding.counts_of(public_tokenizers.path("piece_bpe_32k.model"))
    assert ids._alone and counts._alone
    assert counts(text) == (counts._count(text) if text else 0)


def _twins(bits):
    """Two words that every polynomial hash modulo 2^64 with an odd base confounds."""
    turns = [bin(i).count("1") % 2 for i in range(1 << bits)]
    return "".join("ab"[t] for t in turns), "".join("ba"[t] for t in turns)


def test_words_of_one_hash_are_told_apart():
    one, two = _twins(10)
    ids = encoding.ids_of(PATH)
    text = f"{one} {two} x {two} {one}"
    assert ids.whole(one) != ids.whole(two)
    for given_text in (text, one, two, text):
        assert ids(given_text) == ids.whole(given_text)
    assert ids.batch([two, one, text]) == [ids.whole(x) for x in (two, one, text)]


def test_long_words_are_counted_but_not_kept():
    counts = encoding.counts_of(public_tokenizers.path("piece_bpe_32k.model"))
    before = len(counts._words)
    text = " ".join(f"{i}" + "x" * 200 for i in range(300))
    assert counts(text) == counts._count(text) and len(counts._words) == before


@pytest.mark.parametrize("text", ["0123456789" * 12_000, "0123456789" * 20_000, "".join(chr(0x4E00 + i * 7 % 20_000) for i in range(42_000))])
def test_one_long_word_of_many_ids(monkeypatch, text):
    monkeypatch.setattr(encoding, "TABLE_IDS", 1 << 16)
    ids = encoding.ids_of(PATH)
    whole = ids.whole(text)
    assert len(whole) > 4 * 65_535
    assert ids(text) == whole and ids(f"a b {text[:99_999]} c") == ids.whole(f"a b {text[:99_999]} c") and ids("a b") == ids.whole("a b")


def test_round_trip_and_offsets(spark):
    rng = random.Random(5)
    texts = [(None, "null id"), (3, None), (3, ""), (-7, "long " * 30_000), (5, "same"), (5, "same"), (9, "<|startoftext|> x")]
    texts += [(rng.randint(-50, 900), " ".join(rng.choice(["alpha", "Beta,", "ü"]) for _ in range(rng.randint(0, 60)))) for _ in range(200)]
    folder = storage.scratch(spark, "test-files")
    docs = spark.createDataFrame([(d, t, "x") for d, t in texts], "doc_id long, text string, offset string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    token_files.write(docs, folder, PATH)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = sorted(token_files.read(spark, folder).collect(), key=lambda r: r["start"])
    library = Tokenizer.from_file(PATH)
    own = {}
    for d, t in texts:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        own.setdefault(d, []).append((len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
    assert [r["doc_id"] for r in rows] == sorted((d for d, _ in texts), key=lambda d: (d is not None, d))
    at = 0
    for r in rows:
        assert r["start"] == at
        own[r["doc_id"]].remove((r["n_tokens"], r["ids_crc32"]))
        at += r["n_tokens"]
    index = token_files.index(spark, folder)
    assert index.select("file").distinct().count() > 1
    back = token_files.read_at(index.where("doc_id = -7").orderBy("offset")).collect()
    assert [r["ids"] for r in back] == [[*library.encode("long " * 30_000, add_special_tokens=False).ids, 1]]


def test_empty_table(spark):
    folder = storage.scratch(spark, "test-files")
    token_files.write(spark.createDataFrame([], "doc_id long, text string"), folder, PATH)
    assert token_files.read(spark, folder).collect() == []


def test_wide_ids_and_damage():
    ids = (70_000).to_bytes(4, "little") + (1).to_bytes(4, "little")
    payload = token_files.to_payload(None, ids)
    assert token_files.from_payload(payload) == (None, ids)
    record = token_files.frame(payload)

    def reader(data):
        import io

        return io.BytesIO(data).read

    assert token_files.unframe(reader(record)) == payload
    assert token_files.unframe(reader(b"")) is None
    for at in range(len(record)):
        broken = record[:at] + bytes([record[at] ^ 1]) + record[at + 1 :]
        with pytest.raises(token_files.CorruptRecord):
            token_files.unframe(reader(broken))


def test_shuffled_reads_open_a_file_once(spark, monkeypatch):
    """Reads in random order give the records asked for, however often, and nulls among the ids."""
    folder = storage.scratch(spark, "test-files")
    token_files.write(spark.createDataFrame([(i if i else None, f"text number {i} " * (i % 7)) for i in range(60)], "doc_id long, text string").repartition(3), folder, PATH)
    index = token_files.index(spark, folder)
    want = {r.doc_id: r.n_tokens for r in index.collect()}
    got = token_files.read_at(index.unionByName(index).orderBy(F.rand(3))).collect()
    assert len(got) == 120 and all(len(r["ids"]) == want[r["doc_id"]] for r in got)
