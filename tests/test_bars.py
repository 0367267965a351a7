import collections
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bars
from tidemark.streaming.bars import ROWS, filled, newest, streamed

TRADES = "market_id string, ts_s long, log_index long, tx_hash string, log_odds double, size_usdc double"
LIVES = "market_id string, open_ts long, close_ts long"


def lo(p):
    return math.log(p / (1 - p))


def run(spark, trades, lives, width=60):
    rows = bars.resampled(spark.createDataFrame(trades, TRADES), spark.createDataFrame(lives, LIVES), width).orderBy("market_id", "ts_min").collect()
    return [tuple(r) for r in rows]


def plain(trades, lives, width):
    """Bar by bar, in time order."""
    out = []
    for market, start, end in sorted(lives):
        own = sorted(t for t in ((t[1], t[2], t[3], t[4], t[5]) for t in trades if t[0] == market))
        at = start // width * width
        last = own[0][3] if own else 0.0
        for i in range(max(1, math.ceil((end - at) / width))):
            here = [t for t in own if t[0] // width * width == at + i * width]
            prices = [t[3] for t in here] or [last]
            last = prices[-1]
            out.append((market, at + i * width, prices[0], max(prices), min(prices), last, sum(t[4] for t in here), len(here)))
    return out


def test_one_minute(spark):
    rows = run(spark, [("m", 10, 0, "a", lo(0.5), 100.0), ("m", 20, 0, "b", lo(0.6), 200.0), ("m", 30, 0, "c", lo(0.7), 150.0)], [("m", 0, 60)])
    assert rows == [("m", 0, lo(0.5), lo(0.7), lo(0.5), lo(0.7), 450.0, 3)]


def test_carried_empty_and_scale(spark):
    rows = run(spark, [("m", 30, 0, "a", lo(0.6), 100.0)], [("m", 0, 360)])
    assert [r[7] for r in rows] == [1, 0, 0, 0, 0, 0] and all(r[5] == lo(0.6) for r in rows)
    assert run(spark, [], [("m", 0, 300)]) == [("m", 60 * i, 0.0, 0.0, 0.0, 0.0, 0.0, 0) for i in range(5)]
    assert abs(run(spark, [("m", 30, 0, "a", lo(0.75), 1.0)], [("m", 0, 60)])[0][5] - math.log(3)) < 1e-12


def test_head_is_the_first_trade_of_all(spark):
    early = [("m", -500, 0, "a", 1.0, 1.0), ("m", -100, 0, "b", 2.0, 1.0)]
    assert [r[2] for r in run(spark, early, [("m", 0, 120)])] == [1.0, 1.0]
    assert len(run(spark, early, [("m", 100, 5)])) == 1


def test_random_markets_match_a_loop(spark, monkeypatch):
    rng = random.Random(5)
    trades, lives = [], []
    for m in range(25):
        start = rng.randint(-4000, 4000)
        lives.append((f"m{m:02d}", start, start + rng.randint(-200, 3000)))
        trades += [(f"m{m:02d}", rng.randint(start - 900, start + 3500), rng.randint(0, 2), f"t{i}", rng.randint(-9, 9) / 4, float(rng.randint(1, 9))) for i in range(rng.choice([0, 1, 5, 60]))]
    for stretch in (bars.STRETCH, 3):  # windows of a few buckets pass on what comes next
        monkeypatch.setattr(bars, "STRETCH", stretch)
        for width in (60, 900):
            assert run(spark, trades, lives, width) == plain(trades, lives, width)


def test_stream_gives_the_batch_bars(spark, tmp_path):
    rng = random.Random(6)
    rows = [(f"m{i % 3}", i * 7 + rng.randint(0, 5), i, "t", rng.randint(-9, 9) / 4, 1.0) for i in range(400)] + [("zz", 10**6, 0, "t", 0.0, 0.0)]
    df = spark.createDataFrame(rows, TRADES)
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = streamed(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("append").format("memory").queryName("bars_stream").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in spark.table("bars_stream").select("market_id", "ts_min", "open_lo", "high_lo", "low_lo", "close_lo", "volume_usdc", "trade_count").collect())
    assert got == sorted(tuple(r) for r in bars.ohlcv(df.where("market_id <> 'zz'")).collect())


def test_a_huge_grid_is_spread_over_tasks(spark):
    """One market of 3,000,000 buckets and a few trades: no task makes more than its share of the bars, and the sums are right."""
    trades = [("m", 60 * i + 5, 0, "t", float(i % 7), 1.0) for i in range(0, 3_000_000, 500_000)]
    df = bars.resampled(spark.createDataFrame(trades, TRADES), spark.createDataFrame([("m", 0, 60 * 3_000_000)], LIVES), 60)
    parts = [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(parts) == 3_000_000 and max(parts) < 0.5 * 3_000_000
    got = df.agg(F.count_distinct("ts_min"), F.sum("trade_count"), F.sum("close_lo")).first()
    assert tuple(got) == (3_000_000, 6, sum(float(i % 7) for i in range(0, 3_000_000, 500_000)) * 500_000)


COLUMNS = ["market_id", "ts_min", "open_lo", "high_lo", "low_lo", "close_lo", "volume_usdc", "trade_count"]


def replay(spark, folder, batches, **how):
    """Bars out of a stream of files, one for each batch, and a last row that moves the watermark beyond all; the newest telling of each bar, and all."""
    inside = spark.newSession()
    inside.conf.set("spark.sql.shuffle.partitions", "2")
    for rows in [*batches, [("", 10**7, 0, "", 0.0, 0.0, None, None)]]:
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(0.02)
    stream = inside.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = filled(stream, **how).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    told = spark.read.parquet(f"{folder}/out")
    return sorted(tuple(r) for r in newest(told).select(COLUMNS).collect()), told.collect()


@pytest.mark.parametrize("early", [None, 0])
def test_a_stream_fills_gaps_and_heads(spark, tmp_path, early):
    """Random markets in random batches, disorder within the lateness: the newest bars are the batch operator's, early ones are corrected."""
    rng = random.Random(11)
    lives, trades = [], []
    for m in range(12):
        start = rng.randint(500, 1800)
        lives.append((f"m{m:02d}", start, start + rng.choice([50, 700, 2500])))
        trades += [(f"m{m:02d}", rng.randint(start - 300, start + 2800), rng.randint(0, 2), f"t{i}", rng.randint(-9, 9) / 4, float(rng.randint(1, 9))) for i in range(rng.choice([0, 1, 4, 40]))]
    trades.sort(key=lambda t: t[1] + rng.randint(0, 250))  # none comes more than 250 s after a later one
    cuts = sorted(rng.sample(range(len(trades)), 4))
    batches = [[(*t, None, None) for t in trades[a:b]] for a, b in zip([0, *cuts], [*cuts, len(trades)])]
    batches[0] += [(m, a, None, None, None, None, a, z) for m, a, z in lives]
    got, told = replay(spark, str(tmp_path), batches, width=60, late="300 seconds", early=early)
    assert got == plain(trades, lives, 60)
    again = {m for m, n in collections.Counter((r.market_id, r.ts_min) for r in told).items() if n > 1}
    ends = {m: z for m, _, z in lives}
    after = {m for m in ends if not any(t[0] == m and t[1] < ends[m] for t in trades)}  # a first trade behind the close changes what was told as 0
    assert {m for m, _ in again} <= after if early is None else {m for m, _ in again} - after
