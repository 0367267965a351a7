"""Markets: parsing, classification, the universe and its links."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import numbers, texts, times
from tidemark.operators.trades import first_of_each

#: Market type, parts of a tag that tell it, and whole tags that do; the first match counts.
CASCADE = (
    ("championship", ("final", "championship"), ("super-bowl",)),
    ("season_long", ("season",), ()),
    ("playoff_series", ("playoff",), ()),
    ("conference", ("conference",), ()),
    ("single_game", ("single-game", "single_game"), ()),
)
LEAST_VOLUME, LEAST_DAYS = 10_000.0, 30
#: Intervals of up to 2^35 seconds are linked; markets of categories up to so many meet without buckets.
_WIDEST, _FEW = 35, 64


def market_type(tags: Column, cascade=CASCADE) -> Column:
    """The type that a market's tags tell, ``other`` if none."""
    def told(parts, whole):
        return F.exists(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.lower(t).isin(*whole) | _contains_any(F.lower(t), parts))

    out = None
    for name, parts, whole in cascade:
        out = F.when(told(parts, whole), name) if out is None else out.when(told(parts, whole), name)
    return out.otherwise("other")


def _contains_any(text: Column, parts) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | F.contains(text, F.lit(part))
    return found


def is_primary(kind: Column) -> Column:
    """Whether a market type belongs to the primary sample."""
    return kind.isin(*schemas.PRIMARY_TYPES)


def outcome(winner: Column) -> Column:
    """YES, NO or INVALID; only these two spellings of each count."""
    return F.when(winner.isin("Yes", "YES"), "YES").when(winner.isin("No", "NO"), "NO").otherwise("INVALID")


def parsed(raw: DataFrame, now: Column) -> DataFrame:
    """Markets from the source's JSON rows with ``category``; ``now`` stands for missing start and end dates.

    ``tags`` may be strings or structs of slug and label. A row whose dates, volume or token list can't be read has
    its parts as nulls and says so in ``_error``, null in good rows.
    """
    tag_type = raw.schema["tags"].dataType.simpleString()
    names = F.coalesce("tags", F.array().cast("array<string>")) if tag_type == "array<string>" else texts.tag_names(F.col("tags"))
    have = lambda c: F.nullif(F.col(c).cast("string"), F.lit("")) if c in raw.columns else F.lit(None).cast("string")
    ids = texts.from_json_list(have("clobTokenIds"))
    volume = F.coalesce(have("volume"), have("volumeNum"), F.lit("0"))
    kind = market_type(names)
    errors = F.array(
        *(F.when(have(c).isNotNull() & times.iso(have(c)).isNull(), F.lit(c)) for c in ("startDate", "endDate", "resolutionDate")),
        F.when(ids.isNull(), F.lit("clobTokenIds")),
        F.when(volume.try_cast("double").isNull(), F.lit("volume")),
        F.when(F.col("conditionId").isNull(), F.lit("conditionId")),
    )
    out = raw.select(
        F.col("conditionId").alias("market_id"),
        F.coalesce(have("slug"), "conditionId").alias("slug"),
        F.coalesce(F.col("question"), F.lit("")).alias("question"),
        F.coalesce(F.col("description"), F.lit("")).alias("description"),
        "category",
        names.alias("tags"),
        F.coalesce(times.iso(have("startDate")), now).alias("created_at"),
        F.coalesce(times.iso(have("endDate")), now).alias("end_at"),
        times.iso(F.coalesce(have("resolutionDate"), have("resolvedDate"))).alias("resolved_at"),
        F.coalesce(F.get(ids, 0), F.lit("")).alias("yes_token_id"),
        F.coalesce(F.get(ids, 1), F.lit("")).alias("no_token_id"),
        outcome(F.coalesce(have("winner"), F.lit(""))).alias("resolved_outcome"),
        volume.try_cast("double").alias("total_volume_usdc"),
        kind.alias("market_type"),
        F.lit(None).cast("string").alias("parent_event_id"),
        is_primary(kind).alias("is_primary_sample"),
        F.nullif(F.array_join(F.array_compact(errors), ","), F.lit("")).alias("_error"),
    )
    return out


def with_categories(raw: DataFrame, tags: Mapping[str, list[str]]) -> DataFrame:
    """Raw markets with the category whose tag found them (``found_by``); of repeats the first in configured order stays.

    ``tags`` lists each category's tags in order; it is configuration, a few dozen rows.
    """
    rows = [(tag, category, rank) for rank, (category, tag) in enumerate((c, t) for c, ts in tags.items() for t in ts)]
    lookup = raw.sparkSession.createDataFrame(rows, "found_by string, category string, tag_rank int")
    joined = raw.join(F.broadcast(lookup), "found_by")
    return first_of_each(joined, ["conditionId"], ["tag_rank"])


def universe(markets: DataFrame, least_volume: float = LEAST_VOLUME, least_days: int = LEAST_DAYS) -> DataFrame:
    """The markets with so much volume and such a long life, bounds included."""
    return markets.where((F.col("total_volume_usdc") >= least_volume) & (times.days_between(F.col("created_at"), F.col("end_at")) >= least_days))


def linked(markets: DataFrame, order: Column | None = None) -> DataFrame:
    """Markets with ``parent_event_id``: the first longer market, in order, that they overlap for more than half their life.

    Of equal lives the later is the child. Markets of small categories meet by category alone, a row each. In larger ones an overlap of more than half a market's
    life holds its middle, so markets meet by the middle's place: a market of a life in [2^k, 2^(k+1)) lies in three buckets of that width at most,
    and a market asks one bucket of each width from its own up that some market has. Both are equi-joins, with few pairs or as few as lives allow.
    """
    rows = markets.drop("parent_event_id").select(
        "*",
        (order if order is not None else F.col("market_id")).alias("_order"),
        (F.unix_micros(F.col("created_at").cast("timestamp")) / 1e6).alias("_start"),
        (F.unix_micros(F.col("end_at").cast("timestamp")) / 1e6).alias("_end"),
    )
    slim = rows.where("_end - _start > 0 AND category IS NOT NULL").select("market_id", "category", "_order", "_start", "_end")
    large = slim.groupBy("category").agg(F.count("*").alias("_n")).where(F.col("_n") > _FEW).select("category")
    small, crowded = slim.join(large, "category", "left_anti"), slim.join(large, "category", "left_semi")
    life, p_life = F.col("_end") - F.col("_start"), F.col("p_end") - F.col("p_start")
    level = F.least(F.lit(_WIDEST), F.greatest(F.lit(0), F.floor(F.log2(life)))).cast("int")
    older = (life < p_life) | ((life == p_life) & (F.col("_order") > F.col("p_order")))
    shared = numbers.overlap(F.col("_start"), F.col("_end"), F.col("p_start"), F.col("p_end"))
    as_parents = lambda df, *keys: df.select(*keys, *(F.col(c).alias(f"p{c}") for c in ("market_id", "_order", "_start", "_end")))
    pairs = lambda children, parents, keys: children.join(parents, keys).where(older & (shared > life / 2)).select("market_id", "pmarket_id", "p_order")
    width = F.pow(F.lit(2.0), F.col("k"))
    parents = crowded.withColumn("k", level).withColumn("bucket", F.explode(F.sequence(F.floor(F.col("_start") / width), F.floor(F.col("_end") / width))))
    levels = crowded.agg(F.array_sort(F.collect_set(level)).alias("_levels"))  # one row, three dozen numbers at most
    children = crowded.withColumn("_k", level).crossJoin(F.broadcast(levels)).withColumn("k", F.explode(F.filter("_levels", lambda k: k >= F.col("_k"))))
    children = children.withColumn("bucket", F.floor((F.col("_start") + life / 2) / width)).drop("_k", "_levels")
    met = pairs(small, as_parents(small, "category"), ["category"]).unionByName(pairs(children, as_parents(parents, "category", "k", "bucket"), ["category", "k", "bucket"]))
    found = met.groupBy("market_id").agg(F.min_by("pmarket_id", "p_order").alias("parent_event_id"))
    return rows.drop("_order", "_start", "_end").join(found, "market_id", "left")


def category_report(markets: DataFrame, by: str = "category") -> DataFrame:
    """All, primary and other markets of each category."""
    return markets.groupBy(by).agg(F.count("*").alias("total"), F.count_if("is_primary_sample").alias("primary_count"), F.count_if(~F.col("is_primary_sample")).alias("secondary_count"))
