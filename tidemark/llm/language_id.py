"""Language identification by Bayesian fusion of evidence.

Four kinds of evidence are multiplied. Text: hashed letter trigrams under one multinomial model for
each language, with trigrams of a text counting a third each because they overlap. Declared language:
how often the text of each language comes with each declaration. Address suffix: how often it comes
from each suffix. Host: the languages of the host's texts, smoothed towards those of its domain, and
these towards those of all texts. All counts are grouped aggregations over every row; the declared
languages are the labels from which the text models are counted.

Every declared language has a model: the ``LANGUAGES`` most frequent a dense one, the others the buckets that they
were seen with. The driver sees those counts. Host, suffix and declaration tables are broadcast only
behind a count of their rows, and joined by shuffle beyond it.

A row is rejected if its text has no letters, if too few of its trigrams are likelier in the language that its text tells
than if all trigrams were alike, or if the fused posterior of the best language is below ``CONFIDENCE``. Too few are fewer than what
random trigrams would hit by chance in that language, and ``LIKELY_SHARE`` of the rest. Where no language is declared at all, every row with letters stays.

Defined cases: a null or empty text has no letters; a null declaration, suffix or host is no evidence; equal
posteriors go to the first language in alphabetical order; null ids and repeated rows are kept row by row; an empty table
gives no rows; very long texts are scored whole; extra columns, whatever their names, are left out of the report and kept by the filter.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import storage

#: Hash buckets of trigrams, languages with a dense text model, and rows that a language needs to be counted.
BUCKETS, LANGUAGES, LEAST_ROWS = 1 << 14, 64, 1
#: Languages that have models of their own, and the name of the model of all others, which is no subtag.
MOST_LANGUAGES, OTHER = 512, "*"
#: Likelihoods in one batch, and numbers of a side table that may be broadcast.
SCORES, BROADCAST_SCORES = 1 << 20, 1 << 21
#: Weight of an overlapping trigram, of the smoothing in the text models, of the level above, and the least posterior.
TRIGRAM_WEIGHT, SMOOTHING, LEVEL_WEIGHT, CONFIDENCE = 1 / 3, 0.5, 5.0, 0.5
#: Least share of trigrams, beyond chance, that a language must explain; a name or key in a short text doesn't spoil it.
LIKELY_SHARE = 0.3

_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)


class Evidence(NamedTuple):
    """Columns with a row's declared language, address suffix and host; a null column is no evidence."""

    declared: Column
    suffix: Column
    host: Column


def trigrams(text: str | None) -> np.ndarray:
    """The hash buckets of a text's letter trigrams; runs of other characters are one blank."""
    raw = _FOLD[np.frombuffer((text or "").lower().encode("utf-8"), np.uint8)]
    raw = np.concatenate([[32], raw, [32]]).astype(np.uint32)
    blank = raw == 32
    raw = raw[~(blank & np.concatenate([[False], blank[:-1]]))]
    if len(raw) < 3:
        return np.zeros(0, np.int64)
    mixed = (raw[:-2] << np.uint32(16) | raw[1:-1] << np.uint32(8) | raw[2:]) * np.uint32(2654435761)
    return (mixed >> np.uint32(32 - 14)).astype(np.int64)


def subtag(declared: Column) -> Column:
    """The primary subtag of a declared language in lower case; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(declared, r"^\s*([A-Za-z]{2,8})(?:$|[^A-Za-z])", 1)), F.lit(""))


def _prepared(docs: DataFrame, keep: list[str], text_col: str, evidence: Evidence) -> DataFrame:
    """``keep`` as fields ``c0``, ``c1`` ... of one column, so that no name clashes, and the text and marks of each row."""
    blank = lambda c: F.nullif(F.lower(F.trim(c.cast("string"))), F.lit(""))
    kept = F.struct(F.lit(0).alias("none"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(keep)))
    return docs.select(kept.alias("kept"), F.col(text_col).cast("string").alias("_li_text"), subtag(evidence.declared.cast("string")).alias("_li_declared"), blank(evidence.suffix).alias("_li_suffix"), blank(evidence.host).alias("_li_host"))


def _pooled(prepared: DataFrame) -> DataFrame:
    """The rows with what they declare in ``_li_said``, and all but the ``MOST_LANGUAGES`` languages that most rows declare as one, ``OTHER``.

    Raw pages declare thousands of subtags that are no languages; so models and evidence stay as many as a worker holds. A row whose best language is the pooled one keeps its declaration.
    """
    counts = prepared.where("_li_declared is not null").groupBy("_li_declared").count()
    told = [r["_li_declared"] for r in counts.orderBy(F.desc("count"), "_li_declared").limit(MOST_LANGUAGES + 1).collect()]
    out = prepared.withColumn("_li_said", F.col("_li_declared"))
    if len(told) <= MOST_LANGUAGES:
        return out
    return out.withColumn("_li_declared", F.when(F.col("_li_declared").isin(told[:MOST_LANGUAGES]), F.col("_li_declared")).when(F.col("_li_declared").isNotNull(), OTHER))


class Models(NamedTuple):
    """Log probabilities of trigrams: a dense column for each common language, the seen buckets and one value for the rest.

    ``common`` and ``rare`` are places in ``names``; rare entries lie by language, ``order`` sorts them by bucket.
    """

    names: list[str]
    common: np.ndarray
    dense: np.ndarray
    rare: np.ndarray
    unseen: np.ndarray
    languages: np.ndarray
    buckets: np.ndarray
    logs: np.ndarray
    order: np.ndarray
    bounds: np.ndarray
    shares: np.ndarray

    def scores(self, grams: np.ndarray) -> tuple[np.ndarray, int, float]:
        """A text's log likelihood in each language, its trigrams that are likelier than chance in the best, and the share of all buckets that are."""
        if not self.names:
            return np.zeros(0), len(grams), 0.0
        chance, sums = -np.log(BUCKETS), np.zeros(len(self.names))
        dense = self.dense[grams]
        sums[self.common] = dense.sum(axis=0)
        if not len(self.rare):
            return sums, int((dense[:, sums.argmax()] >= chance).sum()), float(self.shares[sums.argmax()])
        found, times = np.unique(grams, return_counts=True)
        sizes = self.bounds[found + 1] - self.bounds[found]
        at = self.order[np.repeat(self.bounds[found] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
        own = self.languages[at]
        sums[self.rare] = len(grams) * self.unseen + np.bincount(own, (self.logs[at] - self.unseen[own]) * np.repeat(times, sizes), len(self.rare))
        best = int(sums.argmax())
        if len(place := np.flatnonzero(self.common == best)):
            return sums, int((dense[:, place[0]] >= chance).sum()), float(self.shares[best])
        place = int(np.searchsorted(self.rare, best))
        first, last = np.searchsorted(self.languages, [place, place + 1])
        column = np.full(BUCKETS, self.unseen[place])
        column[self.buckets[first:last]] = self.logs[first:last]
        return sums, int((column[grams] >= chance).sum()), float(self.shares[best])


def text_models(prepared: DataFrame, least_rows: int = LEAST_ROWS) -> Models:
    """The models of all counted languages, in alphabetical order."""
    declared = prepared.groupBy("_li_declared").count().where(F.col("_li_declared").isNotNull() & (F.col("count") >= least_rows))
    found = declared.orderBy(F.desc("count"), "_li_declared").limit(MOST_LANGUAGES + 1).collect()
    names = sorted(r["_li_declared"] for r in found)
    number = {x: i for i, x in enumerate(names)}
    common = np.array(sorted(number[r["_li_declared"]] for r in found[:LANGUAGES]), np.int64)
    rare = np.setdiff1d(np.arange(len(names)), common)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for name, counts in sums.items():
                bucket = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bucket), name)), pa.array(bucket), pa.array(counts[bucket])], ["name", "bucket", "n"])
            sums.clear()

        for batch in batches:
            for text, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if number[name] not in sums:
                    if len(sums) >= LANGUAGES:
                        yield from flush()
                    sums[number[name]] = np.zeros(BUCKETS, np.int64)
                sums[number[name]] += np.bincount(trigrams(text), minlength=BUCKETS)
        yield from flush()

    dense, entries = np.full((BUCKETS, len(common)), SMOOTHING), []
    if names:
        rows = prepared.join(F.broadcast(prepared.sparkSession.createDataFrame([(x,) for x in names], "_li_declared string")), "_li_declared", "left_semi").select("_li_text", "_li_declared")
        place = {int(x): i for i, x in enumerate(common)} | {int(x): -1 - i for i, x in enumerate(rare)}
        taken: list[tuple[int, int, int]] = []
        for r in rows.mapInArrow(count, "name long, bucket long, n long").groupBy("name", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
            if (at := place[r["name"]]) >= 0:
                dense[r["bucket"], at] += r["n"]
                continue
            taken.append((-1 - at, r["bucket"], r["n"]))
            if len(taken) >= 1 << 16:
                entries.append(np.array(taken, np.int64))
                taken.clear()
        entries.append(np.array(taken, np.int64).reshape(-1, 3))
    some = np.concatenate([np.zeros((0, 3), np.int64), *entries])
    languages, buckets, n = some[np.lexsort((some[:, 1], some[:, 0]))].T
    total = np.bincount(languages, n, len(rare)) + SMOOTHING * BUCKETS
    order = np.argsort(buckets, kind="stable")
    bounds = np.searchsorted(buckets[order], np.arange(BUCKETS + 1))
    dense, unseen, logs, shares = np.log(dense / dense.sum(axis=0)), np.log(SMOOTHING / total), np.log((n + SMOOTHING) / total[languages]), np.zeros(len(names))
    shares[common] = (dense >= -np.log(BUCKETS)).mean(axis=0)
    shares[rare] = (np.bincount(languages, logs >= -np.log(BUCKETS), len(rare)) + (BUCKETS - np.bincount(languages, minlength=len(rare))) * (unseen >= -np.log(BUCKETS))) / BUCKETS
    return Models(names, common, dense, rare, unseen, languages, buckets, logs, order, bounds, shares)


def _scored(prepared: DataFrame, models: Models) -> DataFrame:
    """Adds the texts' log likelihoods in each language, the trigrams, and those likelier than chance in the best language."""
    at = prepared.columns.index("_li_text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, step := max(1, SCORES // max(1, len(models.names)))):
                part = batch.slice(first, step)
                sums, sizes, likely, shares = [], [], [], []
                for text in part.column(at):
                    grams = trigrams(text.as_py())
                    found, n, share = models.scores(grams)
                    sums.append(found)
                    sizes.append(len(grams))
                    likely.append(n)
                    shares.append(share)
                added = [pa.array(sums, pa.list_(pa.float64())), pa.array(sizes, pa.int64()), pa.array(likely, pa.int64()), pa.array(shares, pa.float64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *added], [*part.schema.names, "_li_text_log", "_li_trigrams", "_li_likely", "_li_chance"])

    schema = T.StructType([*prepared.schema.fields, T.StructField("_li_text_log", T.ArrayType(T.DoubleType())), T.StructField("_li_trigrams", T.LongType()), T.StructField("_li_likely", T.LongType()), T.StructField("_li_chance", T.DoubleType())])
    return prepared.mapInArrow(score, schema)


def _floats(values: np.ndarray) -> Column:
    """Numbers as one literal, however many."""
    return F.split(F.lit(",".join(map(repr, map(float, values)))), ",").cast("array<double>")


def _names(names: list[str]) -> Column:
    return F.split(F.lit(",".join(names)), ",")


def _best(scores: Column, names: list[str]) -> Column:
    return F.element_at(_names(names), F.array_position(scores, F.array_max(scores)).cast("int"))


def _vectors(counts: DataFrame, key: str, names: list[str]) -> DataFrame:
    """``(key, n)``: the counts ``(key, _li_text_lang, n)`` as an array for each key."""
    found = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_li_text_lang", F.col("n").cast("double")))).alias("n"))
    return found.select(key, F.transform(_names(names), lambda x: F.coalesce(F.col("n")[x], F.lit(0.0))).alias("n"))


def _small(df: DataFrame, names: list[str]) -> DataFrame:
    """As ``storage.small``, for rows with a number for each language."""
    return storage.small(df, min(storage.BROADCAST_ROWS, BROADCAST_SCORES // len(names)))


def _shares(counts: Column, above: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(counts, above, lambda n, p: (n + LEVEL_WEIGHT * p) / (total + LEVEL_WEIGHT))


def _with_evidence(rows: DataFrame, table: DataFrame, key: str, names: list[str]) -> DataFrame:
    """``rows`` with a table's columns where their key has any; rows without a key are spread, not gathered in one task."""
    table = storage.written(table, "language-evidence")
    spread = F.pmod(F.xxhash64("_li_trigrams", "_li_likely", "_li_text_log"), F.lit(1 << 20)).cast("string")
    left = rows.withColumns({"_li_none": F.col(key).isNull(), "_li_key": F.coalesce(key, spread)})
    right = table.select(F.col(key).alias("_li_key"), F.lit(False).alias("_li_none"), *(c for c in table.columns if c != key))
    return left.join(_small(right, names), ["_li_key", "_li_none"], "left").drop("_li_key", "_li_none")


def _fused(docs: DataFrame, keep: list[str], text_col: str, evidence: Evidence, least_rows: int, texts: bool) -> tuple[DataFrame, list[Column]]:
    """The rows with ``_li_lang, _li_confidence, _li_text_lang, _li_declared, _li_accepted``, and the columns of ``keep`` in them.

    Texts go through Python twice: to count the models and to be scored. The scores are written, with the texts if the rows
    that stay are wanted (``texts``), and all evidence is counted and joined on them.
    """
    spark = docs.sparkSession
    storage.bounded_batches(spark)
    shared = texts and docs.schema[text_col].dataType == T.StringType()  # the text itself need not be kept twice
    own = [c for c in keep if not (shared and c == text_col)]
    prepared = _pooled(_prepared(docs, own, text_col, evidence))
    models = text_models(prepared.select("_li_text", "_li_declared"), least_rows)
    names = models.names
    columns = [F.col("_li_text").alias(c) if shared and c == text_col else F.col("kept")[f"c{own.index(c)}"].alias(c) for c in keep]
    told = F.when(F.col("_li_trigrams") > 0, _best(F.col("_li_text_log"), names)) if names else F.lit(None).cast("string")
    scored = _scored(prepared, models).withColumn("_li_text_lang", told)
    rows = storage.written(scored if shared else scored.drop("_li_text"), "language-scores")
    if not names:
        return rows.withColumns({"_li_lang": F.lit(None).cast("string"), "_li_confidence": F.lit(0.0), "_li_accepted": F.col("_li_trigrams") > 0}), columns
    seen = rows.where("_li_text_lang is not null")
    number = {x: i for i, x in enumerate(names)}
    counts = lambda key: seen.where(F.col(key).isNotNull()).groupBy(key, "_li_text_lang").agg(F.count("*").alias("n"))
    every = np.zeros(len(names))
    for r in seen.groupBy("_li_text_lang").count().collect():
        every[number[r["_li_text_lang"]]] = r["count"]
    overall = (every + 1) / (every.sum() + len(names))

    by_name: dict[str, np.ndarray] = {}
    for r in counts("_li_declared").toLocalIterator():
        if r["_li_declared"] in number:
            by_name.setdefault(r["_li_declared"], np.zeros(len(names)))[number[r["_li_text_lang"]]] = r["n"]
    said = sum(by_name.values(), np.zeros(len(names)))
    log_declared = [(d, np.log((n + LEVEL_WEIGHT * (n.sum() + 1) / (said.sum() + len(names))) / (said + LEVEL_WEIGHT)).tolist()) for d, n in by_name.items()]
    declarations = spark.createDataFrame(log_declared, "_li_declared string, _li_declared_log array<double>")

    total = F.aggregate("n", F.lit(0.0), lambda a, x: a + x)
    suffixes = _vectors(counts("_li_suffix"), "_li_suffix", names)
    share = (total + 1) / F.lit(float(every.sum()) + 1)
    suffixes = suffixes.select("_li_suffix", F.zip_with("n", _floats(every), lambda n, m: F.log((n + LEVEL_WEIGHT * share) / (m + LEVEL_WEIGHT))).alias("_li_suffix_log"))

    domain = F.regexp_extract("_li_host", r"([^.]*\.)?[^.]*$", 0)
    by_host = storage.written(counts("_li_host").withColumn("domain", domain), "language-hosts")
    domains = _vectors(by_host.groupBy("domain", "_li_text_lang").agg(F.sum("n").alias("n")), "domain", names).withColumnRenamed("n", "m")
    domains = domains.select("domain", _shares(F.col("m"), _floats(overall)).alias("above"))
    hosts = _vectors(by_host, "_li_host", names).withColumn("domain", domain).join(domains, "domain").select("_li_host", F.transform(_shares(F.col("n"), F.col("above")), lambda p: F.log(p)).alias("_li_host_log"))

    joined = rows
    for table, key in ((hosts, "_li_host"), (suffixes, "_li_suffix"), (declarations, "_li_declared")):
        joined = _with_evidence(joined, table, key, names)
    prior = F.coalesce("_li_host_log", _floats(np.log(overall)))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    text = F.transform("_li_text_log", lambda x: x * TRIGRAM_WEIGHT)
    fused = add(add(text, prior), add(F.coalesce("_li_suffix_log", _floats(np.zeros(len(names)))), F.coalesce("_li_declared_log", _floats(np.zeros(len(names))))))
    out = joined.withColumn("_li_log", fused)
    top = F.array_max("_li_log")
    confidence = 1 / F.aggregate("_li_log", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    plausible = F.col("_li_likely") >= (LIKELY_SHARE + (1 - LIKELY_SHARE) * F.col("_li_chance")) * F.col("_li_trigrams")
    accepted = (F.col("_li_trigrams") > 0) & plausible & (confidence >= CONFIDENCE)
    best = _best(F.col("_li_log"), names)
    return out.withColumns({"_li_lang": F.when(best == OTHER, F.coalesce("_li_said", F.lit(OTHER))).otherwise(best), "_li_confidence": confidence, "_li_accepted": accepted | ((F.col("_li_trigrams") > 0) & (best == OTHER))}), columns


def identified(docs: DataFrame, evidence: Evidence, id_col: str = "doc_id", text_col: str = "text", least_rows: int = LEAST_ROWS) -> DataFrame:
    """``(doc_id, lang, confidence, text_lang, declared, accepted)`` of each row."""
    found, columns = _fused(docs, [id_col], text_col, evidence, least_rows, texts=False)
    return found.select(columns[0].alias("doc_id"), *(F.col(f"_li_{x}").alias(y) for x, y in (("lang", "lang"), ("confidence", "confidence"), ("text_lang", "text_lang"), ("said", "declared"), ("accepted", "accepted"))))


def accepted(docs: DataFrame, evidence: Evidence, text_col: str = "text", least_rows: int = LEAST_ROWS) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with all their columns."""
    found, columns = _fused(docs, docs.columns, text_col, evidence, least_rows, texts=True)
    return found.where("_li_accepted").select(columns)


def of_documents() -> Evidence:
    """The evidence of the table ``documents``: its language column, no address, and the source as host."""
    return Evidence(F.col("lang"), F.lit(None).cast("string"), F.col("source"))


def of_pages() -> Evidence:
    """The evidence of raw web pages: the markup's language, the last label of the host, and the host."""
    host = F.regexp_extract("url", r"^[a-z]+://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return Evidence(F.regexp_extract("html", r"(?i)<html[^>]*\slang\s*=\s*[\"']?([A-Za-z-]+)", 1), F.regexp_extract(host, r"\.([a-z]+)$", 1), host)


def page_text(html: Column) -> Column:
    """A page's visible text, roughly: no scripts, styles, comments, tags or entities."""
    return F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>|&[#a-z0-9]+;", " ")
