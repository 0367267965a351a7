"""Which of very many terms a text holds."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of all terms that workers may hold as one automaton.
MOST_CHARS = 1 << 24


def _folded(text: str) -> str:
    """Lower case letter by letter, ASCII only, as patterns without regard to case see it; so places stay what they are."""
    return text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


def automaton(terms: Iterable[str]) -> ahocorasick.Automaton:
    """All terms as one automaton; a text is read once, however many there are."""
    out = ahocorasick.Automaton(ahocorasick.STORE_ANY)
    for term in terms:
        out.add_word(_folded(term), term)
    out.make_automaton()
    return out


def holding(rows: DataFrame, text: Column, terms: Iterable[str], name: str | None = None) -> DataFrame:
    """The rows whose text holds a term, as plain text, within words too, and in any case of A-Z; with ``name``, the terms that it holds, ascending, in a column.

    The work for a text doesn't grow with the number of terms, as that of a pattern of alternatives does. Texts that lack every term's first characters never
    leave the JVM. Without terms every row passes; an empty term is in every text, null texts count as empty; terms go to workers whole, ``MOST_CHARS`` characters at most.
    """
    own = sorted(set(terms))
    if (size := sum(map(len, own))) > MOST_CHARS:
        raise ValueError(f"{size} characters of terms, {MOST_CHARS} at most")
    whole = F.coalesce(text.cast("string"), F.lit(""))
    none = F.array().cast("array<string>")
    if not own or own[0] == "" and name is None:
        return rows.withColumn(name, none) if name else rows
    empty, words = own[0] == "", [t for t in own if t]
    # the terms' first two characters as alternatives of classes: cheap, and exact in what it leaves out
    seconds: dict[str, set[str]] = {}
    for t in map(_folded, words):
        seconds.setdefault(t[0], set()).add(t[1:2])
    cls = lambda chars: "[" + "".join(f"\\x{{{ord(c):x}}}" for c in sorted(chars)) + "]"
    may = whole.rlike("(?i)" + "|".join(cls(c) + ("" if "" in then else cls(then)) for c, then in sorted(seconds.items())))
    kept = F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(rows.columns)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(words)
        for batch in batches:
            hits = [sorted({t for _, t in found.iter(_folded(x))}) for x in batch.column(1).to_pylist()]
            at = [i for i, h in enumerate(hits) if h or empty]
            if at:
                told = [([""] if empty else []) + hits[i] for i in at]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(told, pa.list_(pa.string()))], ["kept", "terms"])

    asked = (rows if empty else rows.where(may)).select(kept.alias("kept"), whole.alias("text"))
    out = asked.mapInArrow(scan, f"kept {asked.schema['kept'].dataType.simpleString()}, terms array<string>")
    columns = [F.col("kept")[f"c{i}"].alias(c) for i, c in enumerate(rows.columns)]
    return out.select(*columns, *([F.col("terms").alias(name)] if name else []))
