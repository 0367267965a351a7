"""The stages of a data set's build, each from tables to tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import times
from tidemark.operators import bars, markets, news, trades


def universe(raw: DataFrame, tags: Mapping[str, list[str]], now: Column, least_volume: float = markets.LEAST_VOLUME, least_days: int = markets.LEAST_DAYS) -> tuple[DataFrame, DataFrame]:
    """The linked universe out of raw markets with ``found_by``, and the rows that couldn't be read."""
    rows = markets.parsed(markets.with_categories(raw, tags), now)
    good = schemas.conform(rows.where("_error is null"), schemas.MARKET)
    linked = markets.linked(markets.universe(good, least_volume, least_days))
    return schemas.conform(linked, schemas.MARKET), rows.where("_error is not null")


def market_trades(fills: DataFrame, universe: DataFrame) -> DataFrame:
    """Trades of the primary markets out of fills with ``token_id, token_rank, side_rank``."""
    own = trades.tokens(universe).join(universe.select("market_id", "yes_token_id"), "market_id")
    joined = trades.distinct_fills(fills.drop("token_rank").join(own, "token_id"))
    return trades.normalized(joined)


def market_bars(all_trades: DataFrame, universe: DataFrame, width: int = bars.MINUTE, only_traded: bool = True) -> DataFrame:
    """Bars of the markets' lives; of markets with trades only, unless told otherwise."""
    lives = universe.select("market_id", times.seconds(F.col("created_at")).alias("open_ts"), times.seconds(F.col("end_at")).alias("close_ts"))
    if only_traded:
        lives = lives.join(all_trades.select("market_id").distinct(), "market_id", "left_semi")
    return bars.resampled(all_trades.join(lives.select("market_id"), "market_id", "left_semi"), lives, width)


def feeds(espn: DataFrame | None, games: DataFrame | None, rss: DataFrame | None) -> DataFrame:
    """The feeds' articles, one of each id: news before games before feeds."""
    given = [schemas.conform(x, schemas.ARTICLE) for x in (espn, games, rss) if x is not None]
    return news.distinct_articles(news.ranked_union(*given))
