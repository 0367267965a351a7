"""Analysis tuples: a market with its trades, bars and news events nested in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nested(rows: DataFrame, key: str, name: str, order: list[str]) -> DataFrame:
    """``(key, name)``: each key's rows as an array of structs, sorted by ``order``, which should be total."""
    rest = [c for c in rows.columns if c != key]
    first = [*order, *(c for c in rest if c not in order)]
    arrays = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*first))).alias(name))
    return arrays.select(key, F.transform(name, lambda x: F.struct(*(x[c].alias(c) for c in rest))).alias(name))


def tuples(markets: DataFrame, trades: DataFrame, bars: DataFrame, events: DataFrame, articles: DataFrame | None = None) -> DataFrame:
    """Markets with ``trades, bars_1min, news_events``, their counts, and the share of member articles with full text.

    One row holds one market's history, as its consumers want it; counts are taken apart from the arrays, so a
    query of counts alone builds none. ``passes_feasibility_gate`` is left to a later step and null.
    """
    out = markets
    for rows, name, order in ((trades, "trades", ["ts_s", "log_index", "tx_hash"]), (bars, "bars_1min", ["ts_min"]), (events, "news_events", ["canonical_ts", "event_id"])):
        out = out.join(nested(rows, "market_id", name, order), "market_id", "left").withColumn(name, F.coalesce(name, F.array()))
    counts = trades.groupBy("market_id").agg(F.count("*").cast("int").alias("trade_count"))
    told = events.groupBy("market_id").agg(F.count("*").cast("int").alias("news_event_count"), F.count_if("included_in_hawkes_likelihood").cast("int").alias("hawkes_eligible_event_count"))
    out = out.join(counts, "market_id", "left").join(told, "market_id", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("trade_count", "news_event_count", "hawkes_eligible_event_count")})
    if articles is None:
        out = out.withColumn("has_full_text_pct", F.lit(0.0))
    else:
        members = events.select("market_id", F.explode("member_article_ids").alias("article_id")).distinct()
        share = members.join(articles.select("article_id", "text_available"), "article_id", "left").groupBy("market_id").agg((100 * F.avg(F.coalesce("text_available", F.lit(False)).cast("int"))).alias("has_full_text_pct"))
        out = out.join(share, "market_id", "left").withColumn("has_full_text_pct", F.coalesce("has_full_text_pct", F.lit(0.0)))
    return out.withColumn("passes_feasibility_gate", F.lit(None).cast("boolean"))
