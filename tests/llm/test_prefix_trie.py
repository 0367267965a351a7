import collections
import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """The trie out of dictionaries of whole prefixes."""
    own = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append((t is not None, t or 0, r, hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).digest(), x))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        source = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        whole[c] = tuple(own.get(source, [])[:h] + turns[h:])
    members = collections.defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1].encode()) if p else 0)
    out = []
    for p, m in members.items():
        ids = ",".join(str(c) for c in m if len(whole[c]) == len(p))
        out.append((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=str)


def told(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=str)


@pytest.mark.parametrize("stretch", [3, 1024])
def test_against_dictionaries(spark, stretch):
    rng = random.Random(7)
    rows, stock = [], [[(rng.choice(["user", "assistant", None]), rng.choice(["", None, "ä" * i, f"text {i}"])) for i in range(rng.randint(0, 14))] for _ in range(6)]
    for c in [*range(-12, 60), 10**15]:
        base = rng.choice(stock)
        turns = [*base[: rng.randint(0, len(base))], *((rng.choice(["user", ""]), f"own {rng.randint(0, 2)}") for _ in range(rng.randint(0, 4)))]
        rows += [(c, None if i == 0 and c % 4 == 0 else i, r, x) for i, (r, x) in enumerate(turns)]
    rows += [(200, 1, "a", "same"), (200, 1, "a", "same"), (200, 1, "b", "x"), (200, None, "b", "x"), (None, 1, "a", "nobody's"), (301, 1, "user", "z" * 300_000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit("extra")).withColumn("digest", F.lit(1))
    assert told(prefix_trie.trie(df, stretch=stretch)) == plain(rows)


def test_long_and_hot_conversations(spark):
    """One conversation of very many turns, others that leave it here and there, and many equal ones that end at one node."""
    rows = [(5, i, "u", f"t{i}") for i in range(700)]
    rows += [(c, i, "u", f"t{i}" if i < cut else f"{c}") for c, cut in ((1000, 100), (1005, 300), (1010, 699)) for i in range(cut + 2)]
    rows += [(c, i, "u", f"copy {i}") for c in range(2000, 2600) for i in range(10)]
    assert told(prefix_trie.trie(spark.createDataFrame(rows, SCHEMA), stretch=64)) == plain(rows)


def test_ids_are_hashed_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS", 7)
    rows = [(bytes([i % 3]), i * 37 % 1000) for i in range(500)]
    want = {d: hashlib.sha256(",".join(map(str, sorted(c for x, c in rows if x == d))).encode()).hexdigest() for d in (b"\0", b"\1", b"\2")}
    found = prefix_trie.ends(spark.createDataFrame(rows, "digest binary, conv long").repartition(5)).collect()
    assert {bytes(r[0]): r[1] for r in found} == want and len(found) == 3


def test_empty(spark):
    df = prefix_trie.trie(spark.createDataFrame([], SCHEMA))
    assert df.columns == COLUMNS and df.count() == 0
    assert prefix_trie.trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).count() == 0


def test_query(spark):
    df = queries.op11_prefix_trie(spark, "/root/testdata/sf0.001")
    rows = duckdb.sql("SELECT conv_id, turn, role, text FROM '/root/testdata/sf0.001/conversations.parquet'").fetchall()
    assert told(df) == plain(rows)
    assert all(t == ("string" if c == "ends_sha256" else "bigint") for c, t in df.dtypes)
