import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_pii import plain_base
from tests.llm.test_simhash import plain_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / "out")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        assert i == 4 or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.append(docs.collect())
    return out


def test_clean_languages_stay(stages):
    assert sorted(stages[0]) == sorted(stages[1])


def test_one_of_each_group_stays(stages):
    names = {name for _, _, name in plain_components([(r["doc_id"], r["text"]) for r in stages[1]])}
    assert sorted(stages[2]) == sorted(r for r in stages[1] if r["doc_id"] in names)


def test_leaks_go(stages, spark):
    norm = lambda t: [w for w in (re.sub(r"^\W+|\W+$", "", x).lower() for x in t.split()) if w]
    cut = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    items = [cut(norm(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {r["doc_id"] for r in stages[2] if any(len(cut(norm(r["text"])) & i) >= 0.8 * len(i) for i in items)}
    assert sorted(stages[3]) == sorted(r for r in stages[2] if r["doc_id"] not in leaks)


def test_personal_data_goes_and_documents_stay(stages):
    before = {r["doc_id"]: r for r in stages[3]}
    assert {r["doc_id"] for r in stages[4]} == set(before)
    for r in stages[4]:
        assert not plain_base(r["text"]) and r["n_chars"] == len(r["text"])
        if not plain_base(before[r["doc_id"]]["text"]):
            assert r == before[r["doc_id"]]


def test_every_id_is_packed_once(stages):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in stages[5]:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == {r["doc_id"] for r in stages[4]}
    for doc in stages[4]:
        ids = b"".join(x.to_bytes(4, "little") for x in [*library.encode(doc["text"], add_special_tokens=False).ids, 1])
        at = 0
        for p in sorted(pieces[doc["doc_id"]], key=lambda p: p["start"]):
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(ids[4 * at : 4 * (at + p["length"])])
            at += p["length"]
        assert 4 * at == len(ids)
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 2048


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "the quiet river runs through seven green valleys while old men watch the slow boats drift toward a distant harbour"


def odd_rows():
    rng = random.Random(3)
    words = PROSE.split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(30, 90))), "en", f"s{i % 3}", None) for i in range(60)]
    rows += [(None, None, None, None, None), (7, "", "en", "s0", 0), (None, f"{PROSE} one", None, "s1", 9), (8, f"{PROSE} two words more", "en", None, None), (8, rows[0][1], "en", "s0", 1)]
    rows += [rows[1], rows[1], (None, rows[2][1], "en", "s1", 3), (99, " ".join(rng.choice(words) for _ in range(60_000)), "en", "s2", None), (100, f"mail bob@x.com {PROSE}", "en", "s2", 1)]
    return rows


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_odd_rows_and_empty_tables(spark, stage):
    docs = spark.createDataFrame(odd_rows(), COLUMNS)
    function = corpus_pipeline.STAGES[stage][1]
    empty = function(spark, docs.limit(0), SF)
    assert empty.count() == 0 and (stage == 4 or empty.columns == docs.columns)
    rows = [tuple(r) for r in function(spark, docs, SF).collect()]
    given = odd_rows()
    if stage == 0:
        assert sorted(rows, key=str) == sorted((r for r in given if r[1]), key=str)
    elif stage == 1:
        kept = Counter(r[1] or "" for r in rows)
        assert set(kept) == {r[1] or "" for r in given} and set(kept.values()) == {1}
    elif stage == 2:
        assert sorted(rows, key=str) == sorted(given, key=str)
    elif stage == 3:
        assert sorted((r[:1] + r[2:4] for r in rows), key=str) == sorted((r[:1] + r[2:4] for r in given), key=str)
        assert [r[1] for r in rows if r[0] == 100] == [f"mail [EMAIL] {PROSE}"] and sum(r[1] is None for r in rows) == 1
    else:
        assert sum(r[2] for r in rows) == sum(len(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in given)


def test_registered_with_the_rest(spark):
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
