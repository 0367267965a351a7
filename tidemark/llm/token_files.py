"""Token ids in length-delimited binary records, with a separate offset index.

A record is: payload length (unsigned 64-bit), masked checksum of those eight bytes (unsigned
32-bit), payload, masked checksum of the payload (unsigned 32-bit); all little-endian. A checksum is
the CRC-32 of zlib, masked as ``rotate_right(crc, 15) + 0xA282EAD8`` so that checksums of data that
holds checksums stay useful. The payload is the document's id (signed 64-bit), a byte of flags (1:
the id is null), a byte with the width of a token id (2 or 4), and the ids at that width.

Documents are range-partitioned and sorted by id, and each task streams one file of its own to the
shared folder. The index, a Parquet table that Spark commits, has a row for each record with its file
and offset; files of task attempts that were lost or ran twice are in no row of it, so they are never
read. A null id sorts first; rows of one id are in the order of their texts' hashes, so that a hot id
spreads over files.

Defined cases: a null or empty text is the end id alone; repeated rows give repeated records; an
empty table gives an index without rows; extra columns are left out.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import storage
from tidemark.llm.encoding import ids_of

END_ID = 1
MASK = 0xA282EAD8
HEAD, FOOT, ABOUT = struct.Struct("<QI"), struct.Struct("<I"), struct.Struct("<qBB")
INDEX = "doc_id long, file_no long, file string, offset long, length long, n_tokens long"


class CorruptRecord(ValueError):
    """A length or payload that its checksum doesn't match."""


def masked(data: bytes) -> int:
    """The masked checksum of some bytes."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """The record that holds a payload."""
    length = len(payload).to_bytes(8, "little")
    return b"".join((length, FOOT.pack(masked(length)), payload, FOOT.pack(masked(payload))))


def unframe(read) -> bytes | None:
    """The next payload of a file by its ``read(n)``; None at its end."""
    head = read(HEAD.size)
    if not head:
        return None
    if len(head) < HEAD.size:
        raise CorruptRecord("the file ends within a length")
    length, check = HEAD.unpack(head)
    if masked(head[:8]) != check:
        raise CorruptRecord("a length doesn't match its checksum")
    payload, foot = read(length), read(FOOT.size)
    if len(payload) < length or len(foot) < FOOT.size or FOOT.unpack(foot)[0] != masked(payload):
        raise CorruptRecord("a payload doesn't match its checksum")
    return payload


def to_payload(doc_id: int | None, ids: bytes) -> bytes:
    """The payload of a document; ``ids`` are 32-bit."""
    wide = np.frombuffer(ids, "<u4")
    width = 2 if not len(wide) or wide.max() < 1 << 16 else 4
    return ABOUT.pack(doc_id or 0, doc_id is None, width) + (wide.astype("<u2").tobytes() if width == 2 else ids)


def from_payload(payload: bytes) -> tuple[int | None, bytes]:
    """A document's id and its 32-bit ids."""
    doc_id, null, width = ABOUT.unpack_from(payload)
    ids = payload[ABOUT.size :]
    return None if null else doc_id, np.frombuffer(ids, "<u2").astype("<u4").tobytes() if width == 2 else ids


def _open(uri: str, write: bool):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_output_stream(path) if write else system.open_input_file(path)


def write(docs: DataFrame, folder: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Write the documents' records to ``folder``/data and the index of them to ``folder``/index."""
    spark = docs.sparkSession
    storage.bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text")]
    data = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/data")
    data.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(data)
    end = end_id.to_bytes(4, "little")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = ids_of(tokenizer_path), TaskContext.get()
        number, offset, out = task.partitionId(), 0, None
        uri = f"{folder}/data/part-{number:06d}-{task.taskAttemptId()}.rec"
        try:
            for batch in batches:
                found = []
                out = out or _open(uri, write=True)
                for doc_id, ids in zip(batch.column(0).to_pylist(), encode.batch(batch.column(1).to_pylist())):
                    ids += end
                    record = frame(to_payload(doc_id, ids))
                    out.write(record)
                    found.append((doc_id, number, uri, offset, len(record), len(ids) // 4))
                    offset += len(record)
                if found:
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), kinds)], [x.split()[0] for x in INDEX.split(", ")])
        finally:
            if out:
                out.close()

    rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(store, INDEX).write.parquet(f"{folder}/index")


def index(spark: SparkSession, folder: str) -> DataFrame:
    """The offset index of a folder."""
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of each record, from the files; start counts the ids of all records before it."""
    files = index(spark, folder).groupBy("file_no", "file").agg(F.sum("n_tokens").alias("held"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    files = storage.written(files.select("file", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base")), "token-files")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = []
                with _open(uri, write=False) as stream:
                    while (payload := unframe(stream.read)) is not None:
                        doc_id, ids = from_payload(payload)
                        found.append((doc_id, start, len(ids) // 4, zlib.crc32(ids)))
                        start += len(ids) // 4
                        if len(found) == 4096:
                            yield _found(found)
                            found = []
                if found:
                    yield _found(found)

    return files.repartition(max(1, files.count())).mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _found(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_at(chosen: DataFrame) -> DataFrame:
    """``(doc_id, ids)`` of chosen index rows, in any order, by their offsets: the shuffled reads of training.

    The rows of a file go to one task, which opens it once and reads on through ascending offsets; a file is what one task wrote. A record is held whole, so a very
    long text's ids must fit into a worker.
    """

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stream = None, None
        try:
            for batch in batches:
                found = []
                for uri, offset in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if uri != at:
                        if stream:
                            stream.close()
                        at, stream = uri, _open(uri, write=False)
                    stream.seek(offset)
                    doc_id, ids = from_payload(unframe(stream.read))
                    found.append((doc_id, np.frombuffer(ids, "<u4").astype(np.int64)))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.list_(pa.int64()))], ["doc_id", "ids"])
        finally:
            if stream:
                stream.close()

    dealt = chosen.select("file", "offset").repartition("file").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(load, "doc_id long, ids array<long>")
