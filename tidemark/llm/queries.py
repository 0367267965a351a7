"""The operators' registered queries: each applies its operator to its whole table and returns the full result."""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, divergence, language_id, multi_index, packing, pii, prefix_trie, quality, secrets, sharding, simhash, storage, token_counts, token_files


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document, by a cache that is empty at first."""
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), storage.scratch(spark, "token-cache"))


def op2_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every twentieth vector."""
    return multi_index.neighbours(_table(spark, sf_dir, "embeddings"))


def op3_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document, packed into sequences of at most 2048 tokens."""
    return packing.packed(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def conversation_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with their prompts, which bear no loss, packed under all three limits by op3's operator."""
    turns = _table(spark, sf_dir, "conversations")
    prompts = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prompt"))
    answers = turns.where("role = 'assistant'").join(prompts, ["conv_id", "turn"], "left")
    rows = answers.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("example"), "prompt", "text")
    return packing.packed(rows, public_tokenizers.path("word_bpe_49k.json"), "example", prompt_col="prompt", max_segments=12, max_loss=1_280).withColumnRenamed("doc_id", "example")


def op4_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, by a ledger that is empty at first."""
    found = secrets.secret_spans(_table(spark, sf_dir, "documents"), storage.scratch(spark, "secret-ledger"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op5_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that benchmark items contaminate, with the items."""
    return decontamination.contaminations(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = pii.personal_spans(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op6's operator alone, which SQL can express; the proposed spans come from a classifier."""
    return op6_weak_supervision_pii(spark, sf_dir).drop("spans")


def op7_bounded_load_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and place of every document, on a ring of eight shards."""
    return sharding.sharded(_table(spark, sf_dir, "documents"))


def op8_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, and whether it stays."""
    return language_id.identified(_table(spark, sf_dir, "documents"), language_id.of_documents())


def pages_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page by its text, markup, address suffix and host."""
    pages = _table(spark, sf_dir, "pages")
    found = language_id.identified(pages.withColumn("text", language_id.page_text(F.col("html"))), language_id.of_pages(), "page_id")
    return found.withColumnRenamed("doc_id", "page_id")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and checksum, read back from the files that were written."""
    folder = storage.scratch(spark, "token-files")
    token_files.write(_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read(spark, folder)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations."""
    return prefix_trie.trie(_table(spark, sf_dir, "conversations"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language, and the terms that tell a source from its language."""
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op13_robust_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document, and whether it stays."""
    return quality.judged(_table(spark, sf_dir, "documents"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and plain limits of op13's operator alone, which SQL can express; the estimates are iterated."""
    return op13_robust_quality(spark, sf_dir).drop("kept", "distance")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to query, in the order of the operators' numbers."""
    return {f.__name__: f for f in (op1_token_counts, op2_inverted_multi_index, op3_vector_packing, op4_secret_ledger, op5_template_decontamination, op6_weak_supervision_pii, op7_bounded_load_ring, op8_language_fusion, op9_token_files, op10_simhash_near_dedup, op11_prefix_trie, op12_source_divergence, op13_robust_quality, quality_base, pages_language, pii_base, conversation_packing)}


def _secrets_sql() -> str:
    """The scan of every document in SQL: matches, and the texts between them, whose lengths give the positions."""
    either = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
    kinds = []
    for rank, rule in enumerate(secrets.RULES):
        pattern = re.sub(r"\(\?i:([^)]*)\)", lambda m: either(m[1]), rule.pattern).replace("'", "''")
        kinds.append(
            f"SELECT doc_id, '{rule.kind}' AS kind, {rank} AS rank, {str(rule.base).lower()} AS base, {rule.least} AS least, regexp_extract_all(x, '{pattern}', 0) AS w, "
            f"regexp_extract_all(x, '{pattern}', {rule.group}) AS v, string_split_regex(x, '{pattern}') AS g FROM t WHERE regexp_matches(x, '{pattern}')"
        )
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents), m AS ({' UNION ALL '.join(kinds)}),
i AS (SELECT *, unnest(range(1, len(w) + 1)) AS n FROM m),
p AS (SELECT doc_id, kind, rank, base, CAST(list_sum(list_transform(g[1:n], lambda y: length(y))) + coalesce(list_sum(list_transform(w[1:n - 1], lambda y: length(y))), 0) AS BIGINT) AS s,
    length(w[n]) AS l FROM i WHERE length(v[n]) >= least),
a AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
    string_agg(kind || ':' || s || ':' || (s + l), ',' ORDER BY s, rank) FILTER (WHERE base) AS b, string_agg(kind || ':' || s || ':' || (s + l), ',' ORDER BY s, rank) AS spans FROM p GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN a ON d.doc_id = a.doc_id"""


def _pii_sql() -> str:
    """The base patterns of personal data in SQL, with their checks on digits."""
    digits = "regexp_replace(w[n], '[^0-9]', '', 'g')"
    small = "list_bool_and(list_transform(string_split(w[n], '.'), lambda y: length(ltrim(y, '0')) < 3 OR (length(ltrim(y, '0')) = 3 AND CAST(ltrim(y, '0') AS INTEGER) <= 255)))"
    double = "(CAST(substr(d, length(d) - i, 1) AS INTEGER) * (1 + i % 2))"
    luhn = f"list_sum(list_transform(range(length(d)), lambda i: {double} - CASE WHEN {double} > 9 THEN 9 ELSE 0 END)) % 10 = 0"
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"), ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", small),
        ("card", r"[0-9](?:[\x20-]?[0-9])+", f"length(d) BETWEEN 13 AND 19 AND {luhn}"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(d) BETWEEN 9 AND 15"),
    )
    each = [
        f"SELECT doc_id, '{kind}' AS kind, {rank} AS rank, s, length(w[n]) AS l FROM (SELECT *, {digits} AS d, "
        "CAST(list_sum(list_transform(g[1:n], lambda y: length(y))) + coalesce(list_sum(list_transform(w[1:n - 1], lambda y: length(y))), 0) AS BIGINT) AS s "
        f"FROM (SELECT *, unnest(range(1, len(w) + 1)) AS n FROM (SELECT doc_id, regexp_extract_all(x, '{pattern}') AS w, string_split_regex(x, '{pattern}') AS g FROM t WHERE regexp_matches(x, '{pattern}')))) WHERE {good}"
        for rank, (kind, pattern, good) in enumerate(kinds)
    ]
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k, _, _ in kinds)
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents), p AS ({' UNION ALL '.join(each)}),
a AS (SELECT doc_id, {counts}, string_agg(kind || ':' || s || ':' || (s + l), ',' ORDER BY rank, s) AS b FROM p GROUP BY 1)
SELECT d.doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k, _, _ in kinds)}, sha256(coalesce(b, '')) AS base_sha256 FROM documents d LEFT JOIN a ON d.doc_id = a.doc_id"""


def _divergence_sql() -> str:
    """The audit in SQL: frequencies of every kept term in every group, compared pair by pair."""
    upper = divergence._UPPER.decode()
    p, value = "1 + (1000000000::HUGEINT * ({n} + 1)) // ({total} + v)", "CAST(((p - q) * (p - q)) // q AS BIGINT)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS x FROM documents),
o AS (SELECT doc, lang, source, unnest(regexp_extract_all(translate(x, '{upper}', '{upper.lower()}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS ln FROM o GROUP BY 1, 2 HAVING count(DISTINCT doc) >= 3),
s AS (SELECT lang, count(*) AS v, sum(ln) AS lt FROM k GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS t FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {p.format(n="coalesce(c.n, 0)", total="g.t")} AS p, {p.format(n="k.ln", total="s.lt")} AS q
    FROM g JOIN k ON g.lang = k.lang JOIN s ON g.lang = s.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
a AS (SELECT x.lang, x.source, y.source AS item, sum(CAST(((x.p - y.p) * (x.p - y.p)) // y.p AS BIGINT)) AS value FROM f x JOIN f y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3),
r AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(a.value, 0) AS BIGINT) AS value
    FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN a ON a.lang = x.lang AND a.source = x.source AND a.item = y.source
    UNION ALL SELECT lang, source, 'term', term, {value} FROM f WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r) WHERE part = 'pair' OR rank <= 200"""


def _quality_sql() -> str:
    """The base counts in SQL; windows are numbered words joined with those behind them."""
    return r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT r, doc_id, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(x, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) AS l FROM t),
i AS (SELECT r, unnest(range(1, len(w) - 6)) AS i, w FROM w), g AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS g FROM i),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
c AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS k FROM d) GROUP BY 1),
o AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda y: length(y))), 0) AS BIGINT) AS word_chars, length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN c USING (r))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM o"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express; the others are held against brute force in the tests."""
    return {"op4_secret_ledger": _secrets_sql(), "pii_base": _pii_sql(), "op12_source_divergence": _divergence_sql(), "quality_base": _quality_sql()}
