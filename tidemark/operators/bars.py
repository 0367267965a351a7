"""Regular bars of log odds from irregular trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import numbers
from tidemark.sources import staging

MINUTE = 60
#: What orders trades of one second.
ORDER = ("ts_s", "log_index", "tx_hash")


def ohlcv(trades: DataFrame, width: int = MINUTE) -> DataFrame:
    """Open, high, low, close, volume and number of trades of each market and bucket that has any."""
    place = F.struct(*ORDER)
    return trades.groupBy("market_id", numbers.floor_to(F.col("ts_s"), width).alias("ts_min")).agg(
        F.min_by("log_odds", place).alias("open_lo"),
        F.max("log_odds").alias("high_lo"),
        F.min("log_odds").alias("low_lo"),
        F.max_by("log_odds", place).alias("close_lo"),
        F.sum("size_usdc").alias("volume_usdc"),
        F.count("*").alias("trade_count"),
    )


#: Buckets without trades that a task makes out of one row, and buckets of a market that one window may hold.
RUN, STRETCH = 4_096, 1 << 18


def _lives(markets: DataFrame, width: int) -> DataFrame:
    """``(market_id, first, last)``: the buckets of each market ``(market_id, open_ts, close_ts)``, from the open's to the close, one at least."""
    first = numbers.floor_to(F.col("open_ts"), width)
    count = F.greatest(F.lit(1), F.ceil((F.col("close_ts") - first) / width)).cast("long")
    return markets.select("market_id", first.alias("first"), (first + (count - 1) * width).alias("last"))


def _buckets(runs: DataFrame, width: int) -> DataFrame:
    """``runs`` with a row for each bucket ``ts_min`` from ``start`` to ``end``, the end excluded.

    Runs are cut to stretches of ``RUN`` buckets, and these dealt to all tasks, before they are exploded: the longest run is no task's alone.
    """
    step, parts = width * RUN, int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = runs.where("start < end").withColumn("_at", F.explode(F.sequence(F.col("start"), F.col("end") - 1, F.lit(step).cast("long"))))
    cut = cut.repartition(parts, "market_id", "_at")
    last = F.least(F.col("_at") + step, F.col("end")) - width
    return cut.withColumn("ts_min", F.explode(F.sequence(F.col("_at"), last, F.lit(width).cast("long")))).drop("_at", "start", "end")


def resampled(trades: DataFrame, markets: DataFrame, width: int = MINUTE) -> DataFrame:
    """A bar for every market and bucket of its grid.

    A bucket without trades repeats the last close, before the first bar the log odds of the market's first trade, be
    it before the open, and 0 in a market without trades. Trades outside the grid count for nothing else.

    Only bars that have trades are ordered: each learns where the next one starts and stands for the empty buckets up to there. Windows
    hold a stretch of ``STRETCH`` buckets of a market, and a stretch learns of the next one by a row for each, so neither a market's bars nor its grid
    have to fit into a task.
    """
    own = staging.written(ohlcv(trades, width), "bars")
    firsts = own.groupBy("market_id").agg(F.min_by("open_lo", "ts_min").alias("_first"))
    lives = _lives(markets, width)
    inside = own.join(lives, "market_id").where("ts_min BETWEEN first AND last").drop("first")
    inside = inside.withColumn("_stretch", F.floor(F.col("ts_min") / (width * STRETCH)))
    edges = inside.groupBy("market_id", "_stretch").agg(F.min("ts_min").alias("_start"))
    edges = edges.withColumn("_later", F.lead("_start").over(Window.partitionBy("market_id").orderBy("_stretch")))
    bars = inside.withColumn("_next", F.lead("ts_min").over(Window.partitionBy("market_id", "_stretch").orderBy("ts_min")))
    bars = bars.join(edges.select("market_id", "_stretch", "_later"), ["market_id", "_stretch"]).withColumn("_next", F.coalesce("_next", "_later"))
    prices = ["open_lo", "high_lo", "low_lo", "close_lo"]
    kept = bars.select("market_id", "ts_min", *prices, "volume_usdc", "trade_count")
    gaps = bars.select("market_id", (F.col("ts_min") + width).alias("start"), F.coalesce("_next", F.col("last") + width).alias("end"), F.col("close_lo").alias("_price"))
    starts = inside.groupBy("market_id").agg(F.min("ts_min").alias("_start"))
    heads = lives.join(starts, "market_id", "left").join(firsts, "market_id", "left")
    heads = heads.select("market_id", F.col("first").alias("start"), F.coalesce("_start", F.col("last") + width).alias("end"), F.coalesce("_first", F.lit(0.0)).alias("_price"))
    empty = _buckets(gaps.unionByName(heads), width)
    return kept.unionByName(empty.select("market_id", "ts_min", *(F.col("_price").alias(c) for c in prices), F.lit(0.0).alias("volume_usdc"), F.lit(0).cast("long").alias("trade_count")))
