import numpy as np
import pytest

from tidemark.operators import pruned, vectors

SCHEMA = "id long, vector array<float>"


def clustered(rng, n, clusters=20, dim=12):
    middle = rng.normal(size=(clusters, dim)) * 4
    return np.float32(middle[rng.integers(clusters, size=n)] + rng.normal(size=(n, dim)) * 0.2)


@pytest.mark.parametrize("size", [16, 8_192])
def test_equals_scoring_all(spark, size):
    """Clusters, norms of very different sizes, ties, repeated and odd rows: the same ranks as without an index."""
    rng = np.random.default_rng(5)
    own = clustered(rng, 1200) * np.float32(rng.choice([0.1, 1, 3], size=(1200, 1)))
    rows = [(i, list(map(float, v))) for i, v in enumerate(own)] + [(2000 + i, list(map(float, own[7]))) for i in range(20)] + [(3000, None), (3001, [float("nan")] * 12), (3002, [0.0] * 12)]
    corpus = spark.createDataFrame(rows, SCHEMA).repartition(4)
    asked = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(np.concatenate([own[::60], rng.normal(size=(4, 12))]))] + [(90, [0.0] * 12), (91, None)], "query_id long, vector array<float>")
    index = pruned.build(corpus, rows=size)
    assert index.blocks.agg({"rows": "sum", "block": "count"}).first()[0] is not None and index.rows.count() == 1221
    for k in (1, 9, 400):
        found, met = pruned.search(asked, index, k)
        want = vectors.nearest(asked, corpus.where("id < 3000 OR id = 3002"), k)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
        assert all(0 < r.share <= 1 for r in met.collect())


def test_most_blocks_of_clustered_rows_are_left_out(spark):
    rng = np.random.default_rng(6)
    own = clustered(rng, 4000)
    corpus = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(own)], SCHEMA)
    asked = spark.createDataFrame([(i, list(map(float, own[i]))) for i in range(0, 4000, 200)], "query_id long, vector array<float>")
    found, met = pruned.search(asked, pruned.build(corpus, rows=128), 5)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, vectors.nearest(asked, corpus, 5).collect()))
    assert np.mean([r.share for r in met.collect()]) < 0.25


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<float>")
    found, met = pruned.search(asked, pruned.build(none), 3)
    assert found.count() == met.count() == 0
    some = pruned.build(spark.createDataFrame([(1, [1.0, 2.0])], SCHEMA))
    assert [r.id for r in pruned.search(asked, some, 3)[0].collect()] == [1]
    assert pruned.search(asked.limit(0), some, 3)[0].count() == 0
