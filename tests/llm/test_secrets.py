import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from tidemark.llm import secrets, storage

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_base(text):
    text = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def joined(spans):
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in spans)


def texts():
    rng = random.Random(4)
    parts = ["password", "PassWd", "sEcReT", "token", "api_key", "apikey", "APIKEY", "=", ":", '"', "'", " ", "  ", "abc", "0123456789abcdef", "deadbeefdeadbeef0", "AKIA", "AKIAABCDEFGHIJKLMN", "AKIA1", "Zz+/_.-", "é", "😀", "\n", "ſecret", "toKen", "x" * 12, "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 20]
    fixed = [None, "", "secret=token: abcdefghijklmnop", "password=token=abcdefghijklmnop", "token" + " " * 20_000 + "=abcdefghijkl", "token=abcdefghijkl " * 800, "f" * 60_000, "AKIAAKIA" + "A" * 13, "AKIA" * 6]
    return fixed + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(600)]


def test_base_spans_match_plain_patterns(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, spans string, digest string").repartition(3)
    found = {r["doc_id"]: r for r in secrets.secret_spans(docs, storage.scratch(spark, "ledger")).collect()}
    assert len(found) == len(rows)
    for i, text in rows:
        base = plain_base(text)
        assert found[i]["base"] == joined(base), text
        assert [found[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s[3] == k for s in base) for k in ("assign", "access", "hex")]
        spans = found[i]["spans"].split(",") if found[i]["spans"] else []
        assert [s for s in spans if s.split(":")[0] in ("assign", "access", "hex")] == (joined(base).split(",") if base else [])
    assert any("pem:" in r["spans"] for r in found.values()) and any("github:" in r["spans"] for r in found.values())


def test_only_unseen_pairs_are_scanned(spark, monkeypatch):
    path = storage.scratch(spark, "ledger")
    first = spark.createDataFrame([(1, "token=abcdefghijkl"), (2, "token=abcdefghijkl"), (3, None), (None, "x")], "doc_id long, text string")
    secrets.secret_spans(first, path)
    sizes = lambda: spark.read.parquet(path).groupBy("version").agg(F.count_distinct("digest").alias("count")).orderBy("count").collect()
    assert [r["count"] for r in sizes()] == [3]
    more = spark.createDataFrame([(1, "token=abcdefghijkl"), (9, "new"), (10, None), (None, "x"), (None, "x")], "doc_id long, text string")
    found = secrets.secret_spans(more, path)
    assert [r["count"] for r in sizes()] == [4]
    assert sorted((str(r["doc_id"]), r["n_assign"]) for r in found.collect()) == [("1", 1), ("10", 0), ("9", 0), ("None", 0), ("None", 0)]
    changed = (*secrets.RULES[:3],)
    secrets.secret_spans(more, path, rules=changed)
    assert [r["count"] for r in sizes()] == [4, 4]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert secrets.secret_spans(empty, storage.scratch(spark, "ledger")).collect() == []


def test_digest_of_base(spark):
    assert spark.range(1).select(F.sha2(F.lit("hex:0:16"), 256)).first()[0] == hashlib.sha256(b"hex:0:16").hexdigest()


def test_very_many_matches_in_one_text(spark):
    """A million matches in one text: time grows with the matches, and each lies where it should."""
    seconds = []
    for n in (100_000, 1_000_000):
        text = "0123456789abcdef " * n
        start = time.perf_counter()
        found = secrets.scanned(spark.createDataFrame([(b"x", text)], "digest binary, text string")).collect()[0]
        seconds.append(time.perf_counter() - start)
        assert found["n_hex"] == n
        last = found["base"].rsplit(",", 2)[1:]
        assert last == [f"hex:{17 * i}:{17 * i + 16}" for i in (n - 2, n - 1)]
    assert seconds[1] < 25 * seconds[0] + 20
