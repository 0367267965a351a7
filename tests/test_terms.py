import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import texts
from tidemark.operators import terms


def test_equals_the_pattern(spark):
    """Terms within words, with signs that patterns mean something by, beyond ASCII, overlapping, in any case; null and empty texts."""
    rng = random.Random(1)
    own = ["NBA", "a.c", "(x)", "été", "Ü", "b", "lake", "lakers", "z" * 30, "1+1", "É"]
    parts = ["nba", "A.C", "abc", "(X)", "ÉTÉ", "été", "ü", "Ü", "LAKE", "rs", " ", "q", "1+1", "Z" * 30, "k", "\n", "É"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 6)))) for i in range(600)] + [(None, None), (-1, "")]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3).withColumn("terms", F.lit(1)).withColumn("kept", F.lit(2))
    got = terms.holding(df, F.col("text"), own)
    assert got.columns == df.columns
    want = df.where(F.coalesce("text", F.lit("")).rlike(texts.any_of(own)))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    named = {r.id: r.found for r in terms.holding(df, F.col("text"), own, "found").collect()}
    fold = lambda x: x.translate({c: c + 32 for c in range(65, 91)})
    assert named == {i: sorted(t for t in own if fold(t) in fold(x or "")) for i, x in rows if any(fold(t) in fold(x or "") for t in own)}


def test_edges(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, text string")
    assert terms.holding(df, F.col("text"), []).count() == 2 and terms.holding(df, F.col("text"), ["", "zz"]).count() == 2
    assert [r.found for r in terms.holding(df, F.col("text"), ["", "A"], "found").orderBy("id").collect()] == [["", "A"], [""]]
    assert terms.holding(df.limit(0), F.col("text"), ["a"], "x").count() == 0
    with pytest.raises(ValueError):
        terms.holding(df, F.col("text"), ["x" * (terms.MOST_CHARS + 1)])
