"""The tables' schemas, and the constraints that rows must keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Types by their short names; arrays hold one of them.
_TYPES = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "float": T.FloatType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}


def schema(text: str) -> T.StructType:
    """A schema out of ``name type, name array<type>, ...``; needs no session, unlike the engine's own parser."""
    kind = lambda t: T.ArrayType(_TYPES[t[6:-1]]) if t.startswith("array<") else _TYPES[t]
    return T.StructType([T.StructField(name, kind(t)) for name, t in (column.split() for column in text.split(","))])


MARKET = schema(
    "market_id string, slug string, question string, description string, category string, tags array<string>, "
    "created_at timestamp, end_at timestamp, resolved_at timestamp, yes_token_id string, no_token_id string, "
    "resolved_outcome string, total_volume_usdc double, market_type string, parent_event_id string, is_primary_sample boolean"
)
TRADE = schema("market_id string, token_id string, ts_s long, log_index long, price_raw double, log_odds double, size_usdc double, side string, tx_hash string")
BAR = schema("market_id string, ts_min long, open_lo double, high_lo double, low_lo double, close_lo double, volume_usdc double, trade_count long")
ARTICLE = schema(
    "article_id string, source string, url string, published_at timestamp, timestamp_precision string, title string, lede string, "
    "body_text string, text_available boolean, entities array<string>, themes array<string>, raw_metadata_json string"
)
NEWS_EVENT = schema(
    "event_id string, market_id string, canonical_ts timestamp, precision string, included_in_hawkes_likelihood boolean, "
    "directional_impact int, magnitude double, member_article_ids array<string>, sources array<string>, member_count int"
)
FILL = schema(
    "transactionHash string, logIndex string, blockNumber string, timestamp string, maker string, taker string, "
    "makerAssetId string, takerAssetId string, makerAmountFilled string, takerAmountFilled string"
)
GKG = schema(
    "GKGRECORDID string, DATE long, DocumentIdentifier string, SourceCommonName string, V2Themes string, "
    "V2Persons string, V2Organizations string, V2Locations string, V2Tone string, SharingImage string"
)
EMBEDDING = schema("article_id string, embedding array<float>")

#: The literal domains of the records.
OUTCOMES = ("YES", "NO", "INVALID")
MARKET_TYPES = ("season_long", "playoff_series", "championship", "conference", "single_game", "other")
PRIMARY_TYPES = ("season_long", "championship", "playoff_series", "conference")
SIDES = ("YES_BUY", "YES_SELL")
PRECISIONS = ("minute", "day", "unknown")
EVENT_PRECISIONS = ("minute", "day")
IMPACTS = (-1, 0, 1)


def _broken(ok: Column) -> Column:
    return ~F.coalesce(ok, F.lit(False))


#: Name of a rule and whether a row breaks it, for each table. A null breaks a rule that speaks of its column.
RULES = {
    "market": lambda: {
        "outcome": _broken(F.col("resolved_outcome").isin(*OUTCOMES)),
        "market_type": _broken(F.col("market_type").isin(*MARKET_TYPES)),
        "required": _broken(F.col("market_id").isNotNull() & F.col("created_at").isNotNull() & F.col("end_at").isNotNull()),
    },
    "trade": lambda: {
        "price": _broken((F.col("price_raw") > 0) & (F.col("price_raw") < 1)),
        "log_odds": _broken(F.abs(F.col("log_odds") - F.ln(F.try_divide("price_raw", 1 - F.col("price_raw")))) <= 1e-6),
        "side": _broken(F.col("side").isin(*SIDES)),
    },
    "article": lambda: {
        "precision": _broken(F.col("timestamp_precision").isin(*PRECISIONS)),
        "minute_without_time": (F.col("timestamp_precision") == "minute") & F.col("published_at").isNull(),
    },
    "news_event": lambda: {
        "eligibility": F.coalesce(F.col("included_in_hawkes_likelihood") & (F.col("precision") != "minute"), F.lit(False)),
        "precision": _broken(F.col("precision").isin(*EVENT_PRECISIONS)),
        "impact": _broken(F.col("directional_impact").isin(*IMPACTS)),
    },
}


def with_violations(df: DataFrame, table: str) -> DataFrame:
    """``df`` and ``violations``, the names of the rules that each row breaks."""
    # a price outside (0, 1) has no logarithm, which counts as a broken rule
    names = F.array(*(F.when(broken, F.lit(name)) for name, broken in RULES[table]().items()))
    return df.withColumn("violations", F.array_compact(names))


def split_valid(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """The rows that keep all rules, and those that don't with the names of what they break (the quarantine)."""
    told = with_violations(df, table)
    return told.where(F.size("violations") == 0).drop("violations"), told.where(F.size("violations") > 0)


def checked(df: DataFrame, table: str) -> DataFrame:
    """``df``; computing a row that breaks a rule fails the query and names the rules."""
    told = with_violations(df, table)
    message = F.concat(F.lit(f"{table}: "), F.array_join("violations", ", "))
    return told.where(F.when(F.size("violations") > 0, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))).drop("violations")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of a schema, in its order and types; what is missing is null."""
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
