import random

from pyspark.sql import functions as F

from tidemark.operators import sketches


def test_unions_are_within_their_errors(spark):
    """Partitions that share values, one that holds most rows, nulls: any union of their sketches is within the stated errors of the rows."""
    rng = random.Random(3)
    rows = [(rng.choice([2020] * 6 + [2021, 2022]), rng.randint(1, 12), rng.choice([None, *range(9000)]), rng.choice([None, rng.gauss(0, 5), rng.random()])) for _ in range(30_000)]
    df = spark.createDataFrame(rows, "year int, month int, who long, price double").repartition(6)
    kept = sketches.sketched(df, ["year", "month"], {"people": "who"}, {"prices": "price"}).cache()
    assert kept.count() == len({r[:2] for r in rows})
    for by in (["year"], ["month"], []):
        told = sketches.estimates(sketches.merged(kept, by, ["people"], ["prices"]), ["people"], {"prices": [0.1, 0.5, 0.99]})
        for r in told.collect():
            own = [x for x in rows if all(x[("year", "month").index(c)] == r[c] for c in by)]
            assert r["rows"] == len(own)
            people, prices = {x[2] for x in own} - {None}, [x[3] for x in own if x[3] is not None]
            assert abs(r["people"] - len(people)) <= sketches.distinct_error() * len(people)
            assert all(abs(sum(p <= v for p in prices) / len(prices) - q) <= sketches.QUANTILE_ERROR + 1 / len(prices) for q, v in zip((0.1, 0.5, 0.99), r["prices"]))


def test_empty(spark):
    none = spark.createDataFrame([], "year int, who long, price double")
    assert sketches.sketched(none, ["year"], {"people": "who"}, {"prices": "price"}).count() == 0
    nulls = spark.createDataFrame([(1, None, None)], "year int, who long, price double")
    told = sketches.sketched(nulls, ["year"], {"people": "who"}, {"prices": "price"})
    assert told.select(F.hll_sketch_estimate("people")).first()[0] == 0
