"""Strings, delimited lists and JSON."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.split() knows it, for Java's regular expressions.
SPACE = r"[\s\x1C-\x1F\x85\p{Z}]"
#: White space of ASCII, as SQL engines without Unicode classes have it in ``\s``; a vertical tab isn't in it.
ASCII_SPACE = r"[\t\n\f\r ]"
LEDE_WORDS, TEXT_CHARS = 150, 2_048


def stripped(text: Column) -> Column:
    """A text without white space at its ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def words(text: Column, space: str = SPACE) -> Column:
    """The words between white space."""
    return F.filter(F.split(text, f"{space}+"), lambda w: w != "")


def lede(text: Column, count: int = LEDE_WORDS, space: str = SPACE) -> Column:
    """The first words, joined by blanks; null if there are none."""
    return F.nullif(F.array_join(F.slice(words(F.coalesce(text, F.lit("")), space), 1, count), " "), F.lit(""))


def joined_text(first: Column, second: Column, chars: int = TEXT_CHARS) -> Column:
    """Two texts, nulls as empty, joined by a blank and cut to so many characters: what is embedded."""
    return F.substring(F.concat(F.coalesce(first, F.lit("")), F.lit(" "), F.coalesce(second, F.lit(""))), 1, chars)


def key_of(url: Column) -> Column:
    """The hex SHA-256 that names an article."""
    return F.sha2(url, 256)


def split_list(text: Column, mark: str = ";") -> Column:
    """The stripped parts of a delimited list that aren't empty; repeats stay."""
    parts = F.split(F.coalesce(text, F.lit("")), re.escape(mark))
    return F.filter(F.transform(parts, stripped), lambda x: x != "")


def names_with_offsets(text: Column, mark: str = ";") -> Column:
    """The names of a list ``name,offset;name,offset``; parts without a comma are left out, empty names are kept."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), re.escape(mark)), lambda x: F.contains(x, F.lit(",")))
    return F.transform(parts, lambda x: stripped(F.split_part(x, F.lit(","), F.lit(1))))


def merged(first: Column, second: Column) -> Column:
    """Two lists in order, each value once."""
    return F.array_distinct(F.concat(first, second))


def any_of(terms: Iterable[str]) -> str:
    """A case-insensitive pattern that finds any of the terms, as plain text; without terms it finds everything."""
    return "(?i)(" + "|".join(map(re.escape, terms)) + ")"


def tag_names(tags: Column) -> Column:
    """The slug, else the label, of each tag struct."""
    names = F.transform(tags, lambda t: F.coalesce(F.nullif(t["slug"], F.lit("")), t["label"], F.lit("")))
    return F.coalesce(names, F.array().cast("array<string>"))


def from_json_list(text: Column) -> Column:
    """The strings of a JSON list that stands in a string; a null or empty text is an empty list."""
    return F.from_json(F.coalesce(F.nullif(text, F.lit("")), F.lit("[]")), "array<string>")


def season(date: Column) -> Column:
    """The season that starts in a date's year, as 2024-25."""
    start = F.year(date)
    return F.concat(start.cast("string"), F.lit("-"), F.substring((start + 1).cast("string"), 3, 2))
