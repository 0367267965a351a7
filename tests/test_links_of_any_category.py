import datetime as dt
import random

from tidemark.operators import markets

SCHEMA = "market_id string, category string, created_at timestamp, end_at timestamp"


def test_small_and_large_categories_are_linked_alike(spark, monkeypatch):
    draw, day = random.Random(4), dt.datetime(2024, 1, 1)
    sizes = {"one": 1, "few": 9, "edge": markets._FEW, "over": markets._FEW + 1, "many": 300, None: 5}
    rows = []
    for category, size in sizes.items():
        for n in range(size):
            start = day + dt.timedelta(hours=draw.randrange(2000))
            rows.append((f"{category}-{n:03d}", category, start, start + dt.timedelta(hours=draw.choice((0, 5, 5, 90, 91, 700, 1500, 1500)))))
    want = {}
    for m, c, s, e in rows:
        own = [
            p for p, q, a, z in rows
            if c is not None and c == q and e > s and (e - s < z - a or (e - s == z - a and m > p)) and max(dt.timedelta(0), min(e, z) - max(s, a)) > (e - s) / 2
        ]
        want[m] = min(own, default=None)
    df = spark.createDataFrame(rows, SCHEMA)
    for few in (markets._FEW, 0, 10**6):
        monkeypatch.setattr(markets, "_FEW", few)
        assert {r["market_id"]: r["parent_event_id"] for r in markets.linked(df).collect()} == want
    assert sum(x is not None for x in want.values()) > 100
