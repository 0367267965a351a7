"""Shared scratch space, checked broadcasts and Arrow batch bounds used by the operators.

Intermediate tables are written as Parquet under the folder that the cluster names in
``spark.checkpoint.dir``; every executor can read them, so a lost executor costs only the tasks
that ran on it. Nothing here touches a machine-local folder unless the session itself is local.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side table that may be broadcast; a row of such tables is under 200 bytes.
BROADCAST_ROWS = 20_000
#: Bits of a key's hash by which rows are told apart before a shuffle: the broadcast has at most 2^20 rows of four bytes.
PREFIX_BITS = 20
#: Bytes and rows that one Arrow batch may hold on its way to a Python worker.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 2_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a temporary one for local sessions without the setting."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    spark.sparkContext.setCheckpointDir(own)
    return own


_MADE: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call uses. It stays, for results that are read later, until ``release``."""
    _MADE.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def release(spark: SparkSession) -> None:
    """Delete what this process wrote to the shared folder; only once no result of it is read any more."""
    while _MADE:
        _delete(spark, _MADE.pop())


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``written`` gave, once nothing that is still to be computed reads them."""
    for df in tables:
        _MADE.remove(df._scratch_path)
        _delete(df.sparkSession, df._scratch_path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path is there, on whatever file system it names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, so that long texts can't fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count proves that it has at most so many rows; else unhinted, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _prefix(key: Column) -> Column:
    return F.shiftrightunsigned(key, 64 - PREFIX_BITS).cast("int")


def parted(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that may have a key of ``wanted``, and rows that have none, told apart without a shuffle.

    Keys are uniform 64-bit hashes. Their first ``PREFIX_BITS`` bits are broadcast, so there are no more of them than that power of two, whatever
    the tables; where few rows are wanted, few others share a prefix with them, and only these go on to a shuffled join.
    """
    prefixes = written(wanted.select(_prefix(wanted_key).alias("_prefix")).distinct(), "prefixes")
    told = [rows.join(F.broadcast(prefixes), _prefix(key) == F.col("_prefix"), how) for how in ("left_semi", "left_anti")]
    return told[0], told[1]


def beside_texts(df: DataFrame) -> DataFrame:
    """As ``small``, for a side table of whole texts: beyond the bound tasks hash its rows and needn't sort the texts."""
    there = small(df)
    return there if there is not df else df.hint("shuffle_hash")
