"""Prices, amounts and intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The bounds that prices are clipped to, and the units of one dollar.
LEAST_PRICE, MOST_PRICE, DOLLAR = 0.001, 0.999, 1_000_000


def clipped(price: Column) -> Column:
    """A price within the bounds; a null stays null."""
    bounded = F.greatest(F.lit(LEAST_PRICE), F.least(F.lit(MOST_PRICE), price))
    return F.when(price.isNotNull(), bounded)


def log_odds(price: Column) -> Column:
    """The natural log odds of a clipped price."""
    p = clipped(price)
    return F.ln(p / (1 - p))


def amount(text: Column) -> Column:
    """A token amount as the double nearest to its up to 38 digits; null beyond or if it is no number. Short ones skip decimals."""
    return F.when(F.length(text) <= 18, text.try_cast("long").cast("double")).otherwise(text.try_cast("decimal(38,0)").cast("double"))


def floor_to(seconds: Column, width: int) -> Column:
    """The start of the bucket of ``width`` seconds; floors below zero too."""
    return (F.floor(seconds / F.lit(width)) * width).cast("long")


def overlap(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """The length that two intervals share, 0 if none."""
    return F.greatest(F.lit(0), F.least(end_a, end_b) - F.greatest(start_a, start_b))


def overlap_fraction(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """The shared length as a share of the shorter interval; 0 where that isn't positive."""
    shorter = F.least(end_a - start_a, end_b - start_b)
    return F.when(shorter > 0, overlap(start_a, end_a, start_b, end_b) / shorter).otherwise(F.lit(0.0))
