"""A content-addressed ledger: what was computed for a text under some version is never computed again.

A ledger is a Parquet table ``version=<digest>/batch=<run>/prefix=<hex digit>/`` with a row for each content digest seen under
that version. A run reduces its rows to distinct digests first and reads only the prefixes that these have; of the digests that
are missing one holder's text each goes to the computation, whose results are a batch of their own. A batch counts once
it is whole (``_SUCCESS``), so a run that dies before changes nothing, and a digest that two runs append at once counts once.

What a run costs follows its own rows and one scan of the ledger's digests, which are held against a broadcast set
where the run's digests are few, and shuffled once otherwise.

Defined cases: very long texts are digested and computed like others; rows that share an id are told apart by their
digests, so nulls and repeats in the id column do no harm; rows that share both are computed each and count once.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import storage


def digest(text: Column) -> Column:
    """The binary SHA-256 of a text's UTF-8 bytes; a null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def version_of(*parts: bytes) -> str:
    """The hex digest of what defines a version."""
    whole = hashlib.sha256()
    for part in parts:
        whole.update(len(part).to_bytes(8, "little") + part)
    return whole.hexdigest()


#: Values of the directories that a batch is dealt to: the first hex digit of the digest.
PREFIX = "prefix"


def _prefix() -> Column:
    return F.substring(F.lower(F.hex("digest")), 1, 1)


def known(spark, path: str, version: str, schema: str, prefixes: list[str] | None = None) -> DataFrame:
    """``(digest, columns...)`` of a version, of some prefixes or all; a digest that two runs appended is there twice."""
    here = f"{path}/version={version}"
    if not storage.exists(spark, here):
        return spark.createDataFrame([], f"digest binary, {schema}")
    found = spark.read.schema(f"digest binary, {schema}, batch string, {PREFIX} string").parquet(here)
    if prefixes is not None:
        found = found.where(F.col(PREFIX).isin(prefixes))
    return found.drop("batch", PREFIX)


def looked_up(docs: DataFrame, path: str, version: str, schema: str, compute: Callable[[DataFrame], DataFrame], id_col: str, text_col: str, facts: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """``(id, facts..., ledger columns...)`` of each row of ``docs``, after what was missing has been computed and appended.

    ``compute`` gets ``(digest, text)`` and gives ``digest`` and the columns of ``schema``; ``facts`` are taken from each row's own text.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = storage.written(docs.select(F.col(id_col).alias("id"), digest(text).alias("digest"), *(f(text).alias(c) for c, f in facts.items())), "ledger-rows")
    wanted = storage.written(rows.groupBy("digest").agg(F.min("id").alias("holder")), "ledger-wanted")
    prefixes = [r[0] for r in wanted.select(_prefix()).distinct().collect()]  # sixteen at most
    before = known(spark, path, version, schema, prefixes).join(storage.small(wanted.select("digest")), "digest", "left_semi")
    before = storage.written(before.groupBy("digest").agg(*(F.max(c).alias(c) for c in before.columns[1:])), "ledger-known")
    missing = wanted.join(storage.small(before.select("digest")), "digest", "left_anti")
    there = storage.beside_texts(missing)
    contents = docs.select(F.col(id_col).alias("id"), digest(text).alias("digest"), text.alias("text"))
    contents = contents.join(there.withColumnRenamed("digest", "wanted"), (F.col("digest") == F.col("wanted")) & F.col("id").eqNullSafe(F.col("holder")), "left_semi")
    batch = f"{path}/version={version}/batch={uuid.uuid4().hex}"
    computed = compute(contents.select("digest", "text")).withColumn(PREFIX, _prefix())
    computed.hint("rebalance", PREFIX).write.partitionBy(PREFIX).parquet(batch)
    storage.dropped(wanted)
    names = [f.split()[0] for f in schema.split(", ")]
    new = spark.read.schema(f"digest binary, {schema}, {PREFIX} string").parquet(batch).select("digest", *names)
    # plain tables on both sides, so that the last join reads plain exchanges, whose hot digests Spark splits at run time
    return rows.join(before.select("digest", *names).unionByName(new.dropDuplicates(["digest"])), "digest").drop("digest")
