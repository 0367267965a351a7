import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm import ledger, storage, token_counts

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", " ", "One  two ", "One two, three!\nfour", "<s> </s> <unk>", "é" * 3000, "word " * 5000, "One two, three!\nfour", "▁x ▁", "😀漢"]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_counts_are_the_librarys(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens int")
    want = [(i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096) for i, t in enumerate(TEXTS)]
    assert rows(token_counts.token_counts(docs, PIECES, storage.scratch(spark, "cache"))) == sorted(want, key=str)


def test_cache_keeps_versions_apart_and_grows_by_misses(spark):
    cache = storage.scratch(spark, "cache")
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    first = rows(token_counts.token_counts(docs, PIECES, cache))
    kept = lambda: spark.read.parquet(cache).select("digest").distinct().count()
    assert kept() == len({t or "" for t in TEXTS})
    again = docs.unionByName(spark.createDataFrame([(None, "new"), (None, None), (3, "new"), (3, "new")], docs.schema))
    second = token_counts.token_counts(again, PIECES, cache)
    assert [r for r in rows(second) if r[0] is not None and r[1] != 3] == first
    assert second.count() == len(TEXTS) + 4
    assert kept() == len({t or "" for t in TEXTS}) + 1
    library = Tokenizer.from_file(WORDS)
    other = {r[0]: r[2] for r in rows(token_counts.token_counts(docs, WORDS, cache))}
    assert other == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(TEXTS)}
    assert len({r["version"] for r in spark.read.parquet(cache).select("version").distinct().collect()}) == 2


def test_a_run_that_died_before_its_append_counts_for_nothing(spark, monkeypatch):
    cache = storage.scratch(spark, "cache")
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    version = token_counts.tokenizer_version(PIECES)
    want = rows(token_counts.token_counts(docs, PIECES, storage.scratch(spark, "cache")))
    with monkeypatch.context() as m:
        m.setattr(token_counts, "counts_of", None)
        try:
            rows(token_counts.token_counts(docs, PIECES, cache))
        except Exception:
            pass
    assert ledger.known(spark, cache, version, "n_tokens long").count() == 0
    assert rows(token_counts.token_counts(docs, PIECES, cache)) == want
    twice = ledger.known(spark, cache, version, "n_tokens long")
    twice.withColumn("prefix", ledger._prefix()).coalesce(1).write.partitionBy("prefix").parquet(f"{cache}/version={version}/batch=again")
    assert rows(token_counts.token_counts(docs, PIECES, cache)) == want


def test_empty_table(spark):
    assert rows(token_counts.token_counts(spark.createDataFrame([], "doc_id long, text string"), PIECES, storage.scratch(spark, "cache"))) == []
