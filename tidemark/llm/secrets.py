"""Secret scans over an incremental blob ledger, in SQL functions only.

Every historical version of a file is a blob, addressed by the digest of its content. The ledger says
which blobs were scanned under which version of the rules (the digest of their text); only unseen
pairs are scanned, and the findings are joined back to every path and version that holds the blob.

A rule's matches are found leftmost and without overlap, then those that are too short are dropped,
so a dropped match still hides what it covers. Positions come from the lengths of the matches and of
the texts between them; they count code points and ends are exclusive.

Defined cases: a null text is an empty blob without findings; a very long text is scanned whole, and a million matches in one take seconds; null and repeated ids keep
their rows; an empty table gives no rows; extra columns are left out, whatever their names.
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import ledger


class Rule(NamedTuple):
    """A kind of secret: its pattern, the group that holds the secret, and that group's least length."""

    kind: str
    pattern: str
    group: int
    least: int
    base: bool = True


#: Fixed values. The base rules, in their order; a run of one class is bounded in the pattern, which drops the same matches.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", "AKIA[A-Z0-9]{14,}", 0, 18),
    Rule("hex", "[0-9a-f]{16,}", 0, 16),
    Rule("github", "gh[oprsu]_[A-Za-z0-9]{36,}", 0, 40, base=False),
    Rule("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 27, base=False),
)
FINDINGS = "n_assign long, n_access long, n_hex long, base string, spans string"


def rules_version(rules: tuple[Rule, ...] = RULES) -> str:
    """The digest that stands for a set of rules."""
    return ledger.version_of(json.dumps(rules).encode())


#: Matches that one list of positions grows by; lists of a block and of the blocks are both short, so a text of a million matches takes seconds.
BLOCK = 128
_SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _with_spans(texts: DataFrame, rule: Rule, rank: int) -> DataFrame:
    """``texts`` with the rule's spans ``r<rank>`` as an array of (start, rank, end, kind).

    Each match starts where the lengths of all matches and gaps before it end. These are added up by block, then along the blocks, then within
    each block from its own start; every step is a projection of its own, read twice by the next, so that none is worked out again for each element.
    """
    pattern, text = F.lit(rule.pattern), F.col("text")
    matches, values = F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(rule.group))
    found = F.arrays_zip(matches.alias("whole"), values.alias("value"), F.split(text, rule.pattern, -1).alias("gap"))
    lengths = F.transform(found, lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["whole"]).alias("whole"), F.length(x["value"]).alias("value")))
    out = texts.withColumn("_lengths", F.when(text.rlike(rule.pattern), lengths))
    block = lambda b: F.slice("_lengths", b * BLOCK + 1, BLOCK)
    blocks = F.sequence(F.lit(0), F.floor((F.size("_lengths") - 1) / BLOCK).cast("int"))
    sums = F.transform(blocks, lambda b: F.aggregate(block(b), F.lit(0), lambda at, x: at + x["gap"] + F.coalesce(x["whole"], F.lit(0))))
    out = out.withColumn("_sums", F.when(F.col("_lengths").isNotNull(), sums))

    def after(state: Column, size: Column) -> Column:
        return F.struct((state["at"] + size).alias("at"), F.array_append(state["starts"], state["at"]).alias("starts"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    out = out.withColumn("_starts", F.when(F.size("_sums") > 0, F.aggregate("_sums", begin, after, lambda s: s["starts"])))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + x["whole"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        kept = F.when(x["value"] >= rule.least, F.array_append(state["spans"], span)).otherwise(state["spans"])
        return F.struct(F.coalesce(end, start).alias("at"), kept.alias("spans"))

    def spans(b: Column) -> Column:
        state = F.struct(F.element_at("_starts", b + 1).alias("at"), F.array().cast(_SPANS).alias("spans"))
        return F.aggregate(block(b), state, step, lambda s: s["spans"])

    each = F.transform(F.sequence(F.lit(0), F.size("_starts") - 1), spans)
    return out.withColumn(f"r{rank}", F.when(F.size("_starts") > 0, F.flatten(each)).otherwise(F.array().cast(_SPANS))).drop("_lengths", "_sums", "_starts")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scanned(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(digest, n_assign, n_access, n_hex, base, spans)`` of each blob ``(digest, text)``."""
    out = blobs.select("digest", "text")
    for i, rule in enumerate(rules):
        out = _with_spans(out, rule, i)
    base = [f"r{i}" for i, rule in enumerate(rules) if rule.base]
    counts = [F.size(f"r{i}").cast("long").alias(f"n_{rule.kind}") for i, rule in enumerate(rules) if rule.base]
    return out.select("digest", *counts, _joined(F.concat(*base)).alias("base"), _joined(F.concat(*(f"r{i}" for i in range(len(rules))))).alias("spans"))


def secret_spans(versions: DataFrame, ledger_path: str, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base, spans)`` of each row; the ledger grows by the pairs it lacked."""
    found = ledger.looked_up(versions, ledger_path, rules_version(rules), FINDINGS, lambda unseen: scanned(unseen, rules), id_col, text_col, {})
    return found.select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", "base", "spans")
