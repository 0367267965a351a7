"""Queries over time: bars out of a replayed stream, and news with the price before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import asof
from tidemark.plans.catalogue import _BARS_SQL, HEAD, TAIL, _events, _rounded_bars
from tidemark.plans.registry import query, read
from tidemark.sources import staging
from tidemark.streaming import bars

#: Stretches of time that the replay sends one after the other; within one rows come in any order.
STRETCHES = 4


@query(_BARS_SQL.format(w=60, first=f"a - {HEAD}", last=f"z + {TAIL}", extra=" UNION ALL SELECT 'none', 0, 600"))
def bars_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-minute bars over events replayed as a stream of files, with the SQL of ``bars_minute``: gaps, heads and a market without trades come from state and timers."""
    rows, lives = _events(spark, sf_dir)
    none = spark.range(1).select(F.lit("none").alias("market_id"), F.lit(0).cast("long").alias("open_ts"), F.lit(600).cast("long").alias("close_ts"))
    names = [c.split()[0] for c in bars.ROWS.split(", ")]
    empty = lambda df: df.select(*(F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in bars.ROWS.split(", ")))).select(names)
    first, last = rows.agg(F.min("ts_s"), F.max("ts_s")).first()
    lives = empty(lives.unionByName(none).withColumn("ts_s", F.lit(first or 1).cast("long")))  # told with the first trades
    length = ((last or 0) - (first or 0)) // STRETCHES + 1
    into = staging.folder(spark, "replay")
    for i in range(STRETCHES):
        some = empty(rows.where(F.floor((F.col("ts_s") - (first or 0)) / length) == i))
        (some.unionByName(lives) if i == 0 else some).coalesce(1).write.mode("append").parquet(f"{into}/in")
    end = spark.range(1).select(F.lit("").alias("market_id"), F.lit((last or 0) + 10 * length + 10 * TAIL).cast("long").alias("ts_s"), F.lit(0).cast("long").alias("log_index"), F.lit(0.0).alias("log_odds"))
    empty(end).write.mode("append").parquet(f"{into}/in")
    inside = spark.newSession()  # the stream's settings are its own
    inside.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    stream = inside.readStream.schema(bars.ROWS).option("maxFilesPerTrigger", 1).parquet(f"{into}/in")
    told = bars.filled(stream, late=f"{length + 1} seconds").writeStream.format("parquet").option("path", f"{into}/out").option("checkpointLocation", f"{into}/state")
    told.trigger(availableNow=True).start().awaitTermination()
    return _rounded_bars(bars.newest(spark.read.schema(bars.BARS).parquet(f"{into}/out")))


_MARKETS = ("click", "error", "purchase", "signup", "view")


@query(f"""
WITH n AS (SELECT o_orderkey, {list(_MARKETS)}[o_orderkey % 5 + 1] AS market_id, to_timestamp(1704067200 + (o_orderkey * 7919) % 2592000)::TIMESTAMP AS told FROM orders),
j AS (SELECT n.*, e.event_id, e.value, e.ts FROM n ASOF LEFT JOIN events e ON n.market_id = e.event_type AND n.told >= e.ts)
SELECT o_orderkey, market_id, CASE WHEN told - ts <= INTERVAL 1 HOUR THEN event_id END AS event_id, CASE WHEN told - ts <= INTERVAL 1 HOUR THEN value END AS price FROM j""")
def news_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as news, each with its market's last event before it, of the last hour if there is one."""
    key = F.col("o_orderkey")
    news = read(spark, sf_dir, "orders").select("o_orderkey", F.element_at(F.array(*map(F.lit, _MARKETS)), (key % 5 + 1).cast("int")).alias("market_id"), F.timestamp_seconds(1_704_067_200 + (key * 7919) % 2_592_000).alias("at"))
    events = read(spark, sf_dir, "events").select(F.col("event_type").alias("market_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("price"))
    return asof.joined(news, events, ["market_id"], "at", "ts", ["event_id", "price"], within=3_600).drop("at")
