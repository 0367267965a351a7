"""Quality rules: plain limits first, then robust multivariate outliers, in SQL functions only.

Each text gives counts (words, characters in words, symbols, repeated lines, repeated words), all taken inside its row. Texts that pass the plain
limits are judged by a vector of transformed statistics: shares are smoothed, so that short texts don't stray, and all are whole
multiples of 1/``UNIT``. For each language and source the minimum covariance determinant is estimated: location and scatter of the
``HALF`` of rows whose scatter has the least determinant. A row whose robust Mahalanobis distance exceeds ``CUTOFF`` is rejected.

The estimate starts from two deterministic ones, medians with quartile ranges, and means with covariances, and concentrates each: rows go by
their distance to one of ``BINS`` bins, each bin's counts, sums and products are added up, and the fewest nearest bins that hold ``HALF`` of
the rows give the next estimate. So a step is one aggregation, of which a task sends a row for each group and bin, be a group a third of all rows.
Two steps of both starts choose the one of less determinant, further steps go on until no group's determinant falls. Sums are decimals, so nothing depends on
the order of rows, and a task that runs again gives the same.

Scatter has a floor in each statistic (``FLOORS``), as most texts have no symbols or repeats at all: a deviation below the floor is no sign of anything.

Defined cases: a null text has no words; very long texts are read whole; null languages and sources are groups of their own; groups of fewer
than ``LEAST_ROWS`` rows are judged together by language, and where these are still fewer, all are kept; repeated rows and null ids are rows each; an
empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import storage

LEAST_WORDS, REPEATED_PERCENT, WINDOW = 20, 30, 8
#: What parts words, and symbols.
SPACES, SYMBOLS = r"[\x20\x09-\x0D]+", "[#*$%&|<>]"
#: The statistics of a vector, and the least deviation of each: log of words, letters a word, shares of symbols, repeated lines and repeated words.
STATISTICS = ("words", "length", "symbols", "lines", "repeats")
FLOORS = (0.5, 0.1, 0.01, 0.15, 0.1)
#: Parts of one in which statistics are counted; share of rows that estimates rest on, and their least number; bins of distances, and steps.
UNIT, HALF, LEAST_ROWS, BINS, STEPS = 10_000, 0.75, 50, 256, 8
#: Squared distances: the chi-square quantiles with five degrees of freedom at ``HALF``, and at one in a million beyond.
HALF_QUANTILE, CUTOFF = 6.6257, 36.0
_P = len(STATISTICS)
_X = [f"x{i}" for i in range(_P)]
_LOW = [(i, j) for i in range(_P) for j in range(i + 1)]


def counts(text: Column) -> dict[str, Column]:
    """A text's words, lines and counts as columns, to be projected one after the other."""
    words = F.array_remove(F.split(text, SPACES), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0)
    return {
        "_words": words,
        "_lines": lines,
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
    }


def _windows(size: int) -> Column:
    """The hashes of all windows of the array ``_words``."""
    ends = F.size("_words") - size + 1
    return F.when(ends > 0, F.transform(F.sequence(F.lit(1), F.greatest(ends, F.lit(1))), lambda i: F.xxhash64(F.slice("_words", i, size)))).otherwise(F.array().cast("array<long>"))


def _repeated(size: int) -> dict[str, Column]:
    """Words in windows that a text has twice or more. Only texts whose windows' hashes aren't distinct are looked at further:
    windows are sorted by hash and place, those beside an equal one count, and each covers what the next one doesn't."""
    placed = F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<int>")
    beside = lambda x, k: F.try_element_at("_placed", k)["h"] == x["h"]
    twice = F.filter("_placed", lambda x, k: F.coalesce(beside(x, k + 2), F.lit(False)) | F.when(k > 0, beside(x, F.when(k > 0, k).otherwise(1))).otherwise(F.lit(False)))
    nexts = F.transform("_places", lambda i, k: F.least(F.lit(size), F.coalesce(F.try_element_at("_places", k + 2) - i, F.lit(size))))
    return {
        "_hashes": _windows(size),
        "_placed": F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), placed),
        "_places": F.coalesce(F.sort_array(F.transform(twice, lambda x: x["i"])), none),
        "n_repeat_words": F.aggregate(nexts, F.lit(0).cast("long"), lambda a, x: a + x),
    }


def _vector() -> list[Column]:
    """The transformed statistics, in units."""
    words, chars = F.col("n_words"), F.col("word_chars")
    told = (
        F.ln(words.cast("double")),
        (chars + 500.0) / (words + 100.0),
        F.col("n_symbols") / (chars + 100.0),
        F.col("n_dup_lines") / (F.col("n_lines") + 3.0),
        F.col("n_repeat_words") / (words + 50.0),
    )
    return [F.round(x * UNIT).cast("long") for x in told]


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, x0...)`` of each row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), text.alias("_text"))
    for name, column in (counts(F.col("_text")) | _repeated(WINDOW)).items():
        rows = rows.withColumn(name, column)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    kept = ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    vector = [F.when(~F.col("base_failed"), x).alias(n) for n, x in zip(_X, _vector())]
    return rows.withColumn("base_failed", failed).select(*kept, "base_failed", *vector)


def _grouped(rows: DataFrame) -> DataFrame:
    """``rows`` with the number of their group: language and source, or the language's small groups together."""
    sizes = rows.where("NOT base_failed").groupBy("lang", "source").agg(F.count("*").alias("_n"))
    sizes = sizes.withColumn("_own", F.col("_n") >= LEAST_ROWS)
    name = F.struct("lang", "_own", F.when(F.col("_own"), F.col("source")).alias("source"))
    sizes = storage.written(sizes.select("lang", "source", F.xxhash64(F.to_json(name)).alias("group")), "quality-groups")
    there = storage.small(sizes.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "group"))
    return rows.join(there, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left").drop("_lang", "_source")


def _sums() -> list[Column]:
    """Count, sums and products of the vectors, exactly."""
    exact = lambda c: F.sum(c.cast("decimal(28,0)"))
    return [F.count("*").alias("n"), *(exact(F.col(_X[i])).alias(f"s{i}") for i in range(_P)), *(exact(F.col(_X[i]) * F.col(_X[j])).alias(f"s{i}{j}") for i, j in _LOW)]


_SUMS = ["n", *(f"s{i}" for i in range(_P)), *(f"s{i}{j}" for i, j in _LOW)]


def correction(half: float = HALF, quantile: float = HALF_QUANTILE) -> float:
    """By what the scatter of a normal sample's nearest ``half`` falls short of the whole sample's."""
    k = _P / 2
    return half / (half - (quantile / 2) ** k * math.exp(-quantile / 2) / math.gamma(k + 1))


def _estimates(sums: DataFrame, keys: list[str], scale: float) -> DataFrame:
    """``(keys..., m0..., l00..., det)``: location, the inverse of the scatter's Cholesky factor, and the scatter's log determinant."""
    mean = [F.col(f"s{i}").cast("double") / F.col("n") for i in range(_P)]
    out = sums.select(*keys, *(m.alias(f"m{i}") for i, m in enumerate(mean)), *((F.col(f"s{i}{j}").cast("double") / F.col("n") - mean[i] * mean[j]).alias(f"c{i}{j}") for i, j in _LOW))
    return _factored(out, keys, scale)


def _factored(scatter: DataFrame, keys: list[str], scale: float) -> DataFrame:
    """The estimates of scatters ``c00...``, which the floors keep positive definite."""
    out = scatter
    for i, j in _LOW:
        c = F.col(f"c{i}{j}") * scale
        out = out.withColumn(f"c{i}{j}", F.greatest(c, F.lit((FLOORS[i] * UNIT) ** 2)) if i == j else c)
    for i, j in _LOW:  # the lower factor, column by column of each row
        rest = F.col(f"c{i}{j}")
        for k in range(j):
            rest = rest - F.col(f"f{i}{k}") * F.col(f"f{j}{k}")
        out = out.withColumn(f"f{i}{j}", F.sqrt(F.greatest(rest, F.lit(1.0))) if i == j else rest / F.col(f"f{j}{j}"))
    for i, j in _LOW:  # its inverse
        if i == j:
            out = out.withColumn(f"l{i}{i}", 1 / F.col(f"f{i}{i}"))
        else:
            rest = F.lit(0.0)
            for k in range(j, i):
                rest = rest - F.col(f"f{i}{k}") * F.col(f"l{k}{j}")
            out = out.withColumn(f"l{i}{j}", rest / F.col(f"f{i}{i}"))
    det = sum((F.ln(f"f{i}{i}") for i in range(1, _P)), F.ln("f00"))
    return out.select(*keys, *(f"m{i}" for i in range(_P)), *(f"l{i}{j}" for i, j in _LOW), (2 * det).alias("det"))


def _distance() -> Column:
    """The squared Mahalanobis distance of ``x`` to ``m`` by the inverse factor ``l``."""
    off = [F.col(_X[i]) - F.col(f"m{i}") for i in range(_P)]
    parts = [sum((F.col(f"l{i}{j}") * off[j] for j in range(1, i + 1)), F.col(f"l{i}0") * off[0]) for i in range(_P)]
    return sum((p * p for p in parts[1:]), parts[0] * parts[0])


def _medians(vectors: DataFrame) -> DataFrame:
    """``(group, m0..., l00..., det)`` by medians and quartile ranges, from counts of ``BINS``-fold rounded statistics."""
    width = [max(1, round(f * UNIT / 8)) for f in FLOORS]
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.floor(F.col(_X[i]) / width[i]).alias("cell")) for i in range(_P))))
    held = vectors.select("group", cells.alias("_c")).groupBy("group", "_c.i", "_c.cell").agg(F.count("*").alias("n"))
    by = Window.partitionBy("group", "i")
    held = held.withColumn("upto", F.sum("n").over(by.orderBy("cell"))).withColumn("all", F.sum("n").over(by))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("cell")))
    found = held.groupBy("group", "i").agg(at(0.5).alias("median"), (at(0.75) - at(0.25)).alias("range"))
    one = lambda c, i: F.max(F.when(F.col("i") == i, F.col(c)))
    wide = found.groupBy("group").agg(*((one("median", i) * width[i] + width[i] / 2).alias(f"m{i}") for i in range(_P)), *(F.pow(one("range", i) * width[i] / 1.349, F.lit(2.0)).alias(f"c{i}{i}") for i in range(_P)))
    return _factored(wide.withColumns({f"c{i}{j}": F.lit(0.0) for i, j in _LOW if i != j}), ["group"], 1.0)


def _concentrated(vectors: DataFrame, estimates: DataFrame, keys: list[str]) -> DataFrame:
    """One step: the estimates by the nearest ``HALF`` of each group's rows, in whole bins of distance."""
    bin_ = F.least(F.lit(BINS - 1), F.floor(12 * F.log2(1 + _distance()))).cast("int")
    held = vectors.join(storage.small(estimates), "group").withColumn("bin", bin_).groupBy(*keys, "bin").agg(*_sums())
    upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
    nearest = held.where(F.col("before") < HALF * F.col("all")).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in _SUMS))
    return storage.written(_estimates(nearest, keys, correction()), "quality-step")


def estimated(vectors: DataFrame) -> DataFrame:
    """``(group, m0..., l00..., det)`` of each group of the rows ``(group, x0...)`` that has enough of them."""
    sums = storage.written(vectors.groupBy("group").agg(*_sums()).where(F.col("n") >= LEAST_ROWS), "quality-sums")
    whole = _estimates(sums, ["group"], 1.0)
    medians = _medians(vectors).join(sums.select("group"), "group", "left_semi")
    starts = storage.written(whole.withColumn("start", F.lit(0)).unionByName(medians.withColumn("start", F.lit(1))), "quality-starts")
    for _ in range(2):
        starts = _concentrated(vectors, starts, ["group", "start"])
    columns = [c for c in starts.columns if c != "start"]
    best = starts.groupBy("group").agg(F.min_by(F.struct(*columns), F.struct("det", "start")).alias("_best")).select("_best.*")
    for _ in range(STEPS - 2):
        step = _concentrated(vectors, best, ["group"])
        fell = step.join(best.select("group", F.col("det").alias("was")), "group").where(F.col("det") < F.col("was") - 1e-9)
        both = step.withColumn("_i", F.lit(0)).unionByName(best.withColumn("_i", F.lit(1)))
        best = storage.written(both.groupBy("group").agg(F.min_by(F.struct(*columns), F.struct("det", "_i")).alias("_best")).select("_best.*"), "quality-best")
        if fell.isEmpty():
            break
    return best


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance)`` of each row; distance is squared, null where no estimate judges."""
    rows = storage.written(measured(docs, id_col, text_col, lang_col, source_col), "quality-rows")
    rows = storage.written(_grouped(rows), "quality-grouped")
    best = estimated(rows.where("NOT base_failed").select("group", *_X))
    found = rows.join(storage.small(best.drop("det")), "group", "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")
