"""Token counts through a digest cache.

The content of a text is normalised only as far as no count can change (a null is an empty text);
its digest is joined to the counts stored for the tokenizer's version, which is the digest of the
vocabulary file and of the library's name and release. Only distinct contents that the cache lacks are
encoded, once each, and appended.

Defined cases: a null or empty text has 0 bytes and 0 tokens; a very long text is counted whole, like others;
null and repeated ids keep their rows; an empty table gives no rows; extra columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from importlib.metadata import version
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import ledger, storage
from tidemark.llm.encoding import counts_of

LIMIT = 4_096


def tokenizer_version(path: str) -> str:
    """The digest that stands for a tokenizer: its file, and the library that reads it."""
    library = "tokenizers" if path.endswith(".json") else "sentencepiece"
    return ledger.version_of(Path(path).read_bytes(), f"{library} {version(library)}".encode())


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of each row; the cache at ``cache_path`` grows by what it lacked."""
    storage.bounded_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counts_of(tokenizer_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(count, batch.column(1).to_pylist()), pa.int64())], ["digest", "n_tokens"])

    found = ledger.looked_up(
        docs,
        cache_path,
        tokenizer_version(tokenizer_path),
        "n_tokens long",
        lambda missing: missing.mapInArrow(encode, "digest binary, n_tokens long"),
        id_col,
        text_col,
        {"n_bytes": lambda text: F.octet_length(text).cast("long")},
    )
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
