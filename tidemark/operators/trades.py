"""Exchange fills to trades in log odds of YES."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import numbers
from tidemark.operators import ordered

#: Fixed value: the collateral token's address.
USDC = "0x2791bca1f2de4661ed88a30c99a7a9449aa84174"


def normalized(fills: DataFrame) -> DataFrame:
    """Trades from raw fills with ``market_id`` and ``yes_token_id``.

    The collateral side, the taker's first, tells token and direction; a token other than YES counts as
    NO, whose price is one minus its ratio. Fills of a zero or unreadable amount, or without collateral, are dropped.
    """
    maker, taker = F.lower("makerAssetId"), F.lower("takerAssetId")
    paid = fills.select(
        "*",
        numbers.amount(F.col("makerAmountFilled")).alias("_maker"),
        numbers.amount(F.col("takerAmountFilled")).alias("_taker"),
        (taker == USDC).alias("_by_taker"),
        (maker == USDC).alias("_by_maker"),
    ).where("_maker <> 0 and _taker <> 0 and (_by_taker or _by_maker)")
    token = F.when(F.col("_by_taker"), maker).otherwise(taker)
    usdc = F.when(F.col("_by_taker"), F.col("_taker")).otherwise(F.col("_maker"))
    tokens = F.when(F.col("_by_taker"), F.col("_maker")).otherwise(F.col("_taker"))
    yes = token == F.lower("yes_token_id")
    price = numbers.clipped(F.when(yes, usdc / tokens).otherwise(1 - usdc / tokens))
    bought = yes == F.col("_by_taker")
    # a projection of its own: the price is read three times, and so worked out once
    priced = paid.select(
        "market_id",
        token.alias("token_id"),
        F.col("timestamp").cast("long").alias("ts_s"),
        F.col("logIndex").cast("long").alias("log_index"),
        price.alias("price_raw"),
        (usdc / numbers.DOLLAR).alias("size_usdc"),
        F.when(bought, "YES_BUY").otherwise("YES_SELL").alias("side"),
        F.col("transactionHash").alias("tx_hash"),
    )
    odds = F.ln(F.col("price_raw") / (1 - F.col("price_raw"))).alias("log_odds")
    return priced.select("market_id", "token_id", "ts_s", "log_index", "price_raw", odds, "size_usdc", "side", "tx_hash")


def first_of_each(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key by an order; the order should be total, so that the same row always stays.

    One row per key and task is shuffled at most, so a hot key doesn't gather in one task.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    best = F.min_by(F.struct(*(F.col(c) for c in rows.columns)), F.struct(*(c.alias(f"_{i}") for i, c in enumerate(order))))
    return rows.groupBy(*(F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys))).agg(best.alias("_row")).select("_row.*")


def distinct_fills(fills: DataFrame) -> DataFrame:
    """One fill for each transaction and log index: of the first token, on the first side (``token_rank``, ``side_rank``)."""
    return first_of_each(fills, ["transactionHash", "logIndex"], ["token_rank", "side_rank"])


def tokens(markets: DataFrame) -> DataFrame:
    """``(market_id, token_id, token_rank)``: the tokens of the primary markets, without empty ones."""
    both = F.explode(F.array(F.struct(F.col("yes_token_id").alias("token_id"), F.lit(0).alias("token_rank")), F.struct(F.col("no_token_id").alias("token_id"), F.lit(1).alias("token_rank"))))
    return markets.where("is_primary_sample").select("market_id", both.alias("_t")).select("market_id", "_t.*").where(F.coalesce("token_id", F.lit("")) != "")


def known(trades: DataFrame, markets: DataFrame) -> DataFrame:
    """The trades of markets in the universe, with the market's category and times."""
    return trades.join(markets.select("market_id", "category", "created_at", "end_at"), "market_id")


def unknown(trades: DataFrame, markets: DataFrame) -> DataFrame:
    """Trades of each market that the universe lacks, counted: the warning of a run."""
    return trades.join(markets.select("market_id"), "market_id", "left_anti").groupBy("market_id").agg(F.count("*").alias("trade_count"))


def per_market(trades: DataFrame, markets: DataFrame) -> DataFrame:
    """``trade_count`` of each market, 0 for those without trades."""
    counts = trades.groupBy("market_id").agg(F.count("*").alias("trade_count"))
    return markets.join(counts, "market_id", "left").withColumn("trade_count", F.coalesce("trade_count", F.lit(0)))


def count_report(counts: DataFrame, by: list[str]) -> DataFrame:
    """Markets, trades and the median of trades a market in each group; the median of two middle values is their mean.

    Markets are first counted by their number of trades, in the tasks already, so what meets in one is a row for each number that occurs in a group, not its markets.
    """
    held = counts.groupBy(*by, "trade_count").agg(F.count("*").alias("_n"))
    known = F.when(F.col("trade_count").isNotNull(), F.col("_n")).otherwise(0)
    group = Window.partitionBy(*by)
    held = held.withColumn("_upto", F.sum(known).over(group.orderBy("trade_count"))).withColumn("_all", F.sum(known).over(group))
    at = lambda rank: F.min(F.when(F.col("_upto") >= rank, F.col("trade_count")))
    middle = (at(F.floor((F.col("_all") + 1) / 2)) + at(F.floor(F.col("_all") / 2) + 1)) / F.lit(2.0)
    return held.groupBy(*by).agg(F.sum("_n").alias("markets"), F.sum(F.col("_n") * F.col("trade_count")).alias("trades"), F.coalesce(middle, F.lit(0.0)).alias("median_trades"))


def in_order(trades: DataFrame) -> DataFrame:
    """Trades sorted by time and log index within each market, for a sink; dealt by ranges of market and time, so a large market is several files that follow each other."""
    order = ("market_id", "ts_s", "log_index", "tx_hash")
    return trades.repartitionByRange(*order).sortWithinPartitions(*order)


def numbered(trades: DataFrame) -> DataFrame:
    """Trades with their place in their market's order; a market may be larger than a task."""
    return ordered.numbered(trades, ["market_id"], ["ts_s", "log_index", "tx_hash"], "place")
