import numpy as np
import pytest

from tidemark.llm import multi_index as mi


def frame(spark, rows, kind="array<float>"):
    return spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], f"vec_id long, embedding {kind}, cell int, score double").repartition(3)


def plain(rows, k, every):
    """Every pair, in double precision."""
    rows = {i: v for i, v in sorted(rows, key=lambda r: r[1], reverse=True)}
    out = {}
    for q in rows:
        if q % every == 0:
            scored = [(-float(sum(np.float64(np.float32(a)) * np.float64(np.float32(b)) for a, b in zip(rows[q], v))), i) for i, v in rows.items() if i != q]
            out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def by_query(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(v) for q, v in out.items()}


def test_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), v.tolist()) for i, v in enumerate(rng.normal(size=(1200, 16)).astype(np.float32))]
    found, want = by_query(mi.neighbours(frame(spark, rows), k=10, every=20)), plain(rows, 10, 20)
    assert set(found) == set(want)
    hits = 0
    for q, got in found.items():
        assert [r for r, _, _ in got] == list(range(1, 11))
        assert [(-s, i) for _, i, s in got] == sorted((-s, i) for _, i, s in got)
        exact = dict(plain([rows[q], *[rows[i] for _, i, _ in got]], 10, q or 10**9)[q])
        assert all(exact[i] == pytest.approx(s, abs=1e-12) for _, i, s in got)
        hits += len({i for i, _ in want[q]} & {i for _, i, _ in got})
    assert hits / (10 * len(want)) >= 0.9


def test_ties_odd_rows_and_few_candidates(spark):
    nan, inf = float("nan"), float("inf")
    same = [(i, [1.0, 0.0, 0.0]) for i in range(100, 160)]
    odd = [(None, [1.0, 0.0, 0.0]), (1, None), (2, [0.0, 0.0, 0.0]), (3, [nan, 1.0, 0.0]), (4, [inf, 1.0, 0.0]), (5, [None, 1.0, 0.0]), (6, [1.0, 0.0]), (100, [1.0, 0.0, 0.0]), (101, [0.5, 0.5, 0.0])]
    found = by_query(mi.neighbours(frame(spark, same + odd), k=20, every=20))
    rest = [i for i in range(101, 160)]
    assert set(found) == {100, 120, 140}
    # two rows have id 100: each is a query, and the other's neighbour
    assert [i for _, i, _ in found[100]] == sorted([*[100, *rest[:19]]] * 2)
    assert [i for _, i, _ in found[120]] == [100, 100, *[i for i in rest if i != 120]][:20]
    few = by_query(mi.neighbours(frame(spark, [(0, [1.0, 2.0]), (7, [3.0, 4.0]), (20, [1.0, 1.0])]), k=20, every=20))
    assert few == {0: [(1, 7, 11.0), (2, 20, 3.0)], 20: [(1, 7, 7.0), (2, 0, 3.0)]}
    assert by_query(mi.neighbours(frame(spark, [(0, [1.0])]), every=20)) == {}
    assert by_query(mi.neighbours(frame(spark, odd[1:5]))) == {} and by_query(mi.neighbours(frame(spark, []))) == {}


def test_repeated_ids_and_lengths(spark):
    rows = [(0, [1.0, 0.0]), (7, [0.5, 0.1]), (7, [0.9, 0.2]), (20, [0.0, 1.0]), (20, [1.0, 1.0, 1.0]), (8, [2.0, 0.0, 0.0]), (9, [1.0, 2.0, 3.0]), (40, [1.0, 2.0, 3.0])]
    found = by_query(mi.neighbours(frame(spark, rows), k=2, every=20))
    near = lambda q: [(r, i, round(s, 6)) for r, i, s in found[q]]
    assert near(0) == [(1, 7, 0.9), (2, 7, 0.5)] and near(40) == [(1, 9, 14.0), (2, 20, 6.0)]
    assert near(20) == [(1, 7, 0.2), (1, 9, 6.0), (2, 7, 0.1), (2, 40, 6.0)]


def test_blocks_and_ranges_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(int(i), v.tolist()) for i, v in enumerate(rng.normal(size=(600, 8)).astype(np.float32))]
    whole = by_query(mi.neighbours(frame(spark, rows), k=6, every=5))
    for name, value in (("BLOCK", 64), ("BLOCK_QUERIES", 9), ("STRIP", 5), ("RANGE", 7)):
        monkeypatch.setattr(mi, name, value)
    assert by_query(mi.neighbours(frame(spark, rows), k=6, every=5)) == whole


def test_large_cells_are_split(spark, monkeypatch):
    monkeypatch.setattr(mi, "BLOCK", 8)
    monkeypatch.setattr(mi, "BLOCK_QUERIES", 2)
    rows = [(i, [1.0, float(i < 50)]) for i in range(100)]
    found, want = by_query(mi.neighbours(frame(spark, rows), k=5, every=10)), plain(rows, 5, 10)
    assert {q: [i for _, i, _ in v] for q, v in found.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_walk_is_in_order_of_the_sum():
    rng = np.random.default_rng(4)
    left, right = rng.normal(size=9), rng.normal(size=7)
    counts = rng.integers(0, 3, 63)
    index = mi.MultiIndex(np.zeros((9, 1)), np.zeros((7, 1)), counts, None, None, 40)
    last, cells = index.walk(left, right, 1)
    sums = (left[:, None] + right[None, :]).ravel()
    order = [c for c in np.argsort(-sums, kind="stable") if counts[c]]
    assert cells == order[: len(cells)] and last == pytest.approx(sums[cells[-1]])
    assert counts[cells[:-1]].sum() < 40 <= counts[cells].sum()
