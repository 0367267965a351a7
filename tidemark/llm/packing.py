"""Vector bin packing of token sequences for training.

Every example has a size in three dimensions: tokens, segments (one for each piece) and loss-bearing
tokens (those at or behind a given position, as in instruction data, where a prompt bears none). The
open sequence takes, of the pieces that fit in all three, the one whose size has the largest dot
product with the room left, both as shares of the limits (a piece is always one segment, so that
dimension bounds the choice and doesn't rank it). If none fits and the room is worth a cut,
the longest waiting example is cut to fill it. Long examples are cut at the limits first.

Packing is local to the tasks that tokenize: nothing is shuffled, a task holds at most
``BUFFER_TOKENS`` tokens and one text, and only its last sequence is left open. Sequence ids hold the
task's number in their upper bits, so a task that runs again gives the same rows.

Defined cases: a null or empty text is the end id alone, and without an end id one piece of no length in no sequence; very long
texts are cut at the limits; null and repeated ids are kept row by row; an empty table gives no rows; extra columns, whatever
their names, are left out.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import storage
from tidemark.llm.encoding import ids_of

MAX_TOKENS, END_ID = 2_048, 1
#: Room that is worth cutting an example for.
LEAST_CUT = 8
#: Tokens and examples that wait in a task at once.
BUFFER_TOKENS, BUFFER_EXAMPLES = 4_000_000, 4_096


class Packer:
    """Packs examples that are added one by one; ``drain`` gives the placed pieces."""

    def __init__(self, tokens: int, segments: int, loss: int, first_sequence: int = 0, least_cut: int = LEAST_CUT) -> None:
        if min(tokens, segments, loss) < 1:
            raise ValueError("limits are at least 1")
        self.tokens, self.segments, self.loss, self.least_cut = tokens, segments, loss, least_cut
        self.numbers = itertools.count(first_sequence)
        self.open, self.used = next(self.numbers), (0, 0, 0)
        self.waiting: list[list] = []
        self.held = 0
        self.placed: list[tuple] = []

    def add(self, doc, ids: bytes, loss_from: int = 0) -> None:
        """One example: its name, its ids as 32-bit bytes, and the first position that bears loss."""
        total = len(ids) // 4
        if not total:
            self.placed.append((doc, 0, 0, 0, 0, None, None, 0))
            return
        self.waiting.append([doc, ids, total, 0, max(0, min(loss_from, total))])
        self.held += total
        if self.held >= BUFFER_TOKENS or len(self.waiting) >= BUFFER_EXAMPLES:
            self.pack()

    def _close(self) -> None:
        self.open, self.used = next(self.numbers), (0, 0, 0)

    def _place(self, item: list, length: int, alone: bool = False) -> None:
        doc, ids, total, start, _ = item
        bears = self._bears(item, length)
        sequence, offset = (next(self.numbers), 0) if alone else (self.open, self.used[0])
        self.placed.append((doc, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), total, sequence, offset, bears))
        if not alone:
            self.used = self.used[0] + length, self.used[1] + 1, self.used[2] + bears
        item[3] = start + length

    @staticmethod
    def _bears(item: list, length: int) -> int:
        return max(0, item[3] + length - max(item[3], item[4]))

    def _most(self, item: list, tokens: int, loss: int) -> int:
        """The longest piece of an example within the room."""
        return min(item[2] - item[3], tokens, max(0, item[4] - item[3]) + loss)

    def pack(self) -> None:
        """Place all that waits; the last sequence stays open."""
        items, self.waiting, self.held = self.waiting, [], 0
        for item in items:
            while (most := self._most(item, self.tokens, self.loss)) < item[2] - item[3]:
                self._place(item, most, alone=True)
        items = [item for item in items if item[3] < item[2]]
        sizes = np.array([(item[2] - item[3], self._bears(item, item[2] - item[3])) for item in items], np.int64).reshape(-1, 2)
        left = len(items)
        while left:
            room = self.tokens - self.used[0], self.segments - self.used[1], self.loss - self.used[2]
            fits = (sizes[:, 0] > 0) & (sizes[:, 0] <= room[0]) & (sizes[:, 1] <= room[2]) & (room[1] > 0)
            if fits.any():
                dot = sizes[:, 0] * (room[0] / self.tokens**2) + sizes[:, 1] * (room[2] / self.loss**2)
                best = int(np.where(fits, dot, -1.0).argmax())
                self._place(items[best], int(sizes[best, 0]))
                sizes[best] = 0
                left -= 1
                continue
            best = int(sizes[:, 0].argmax())
            if room[1] and (most := self._most(items[best], room[0], room[2])) >= self.least_cut:
                self._place(items[best], most)
                rest = items[best][2] - items[best][3]
                sizes[best] = rest, self._bears(items[best], rest)
            self._close()

    def drain(self) -> list[tuple]:
        """The pieces placed since the last call."""
        placed, self.placed = self.placed, []
        return placed


COLUMNS = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


def packed(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    prompt_col: str | None = None,
    loss_from_col: str | None = None,
    max_tokens: int = MAX_TOKENS,
    max_segments: int | None = None,
    max_loss: int | None = None,
    end_id: int | None = END_ID,
) -> DataFrame:
    """One row for each piece of each document; pieces of one sequence_id lie gapless from offset 0.

    ``prompt_col`` holds a text whose ids come before the text's and bear no loss; ``loss_from_col`` instead the first token position
    that bears it (null: 0, all do). Without ``max_segments`` and ``max_loss`` a sequence may have as many of them as tokens, so
    short texts leave no padding.
    """
    storage.bounded_batches(docs.sparkSession)
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    loss_from = F.col(loss_from_col).cast("long") if loss_from_col else F.lit(0).cast("long")
    prompt = F.col(prompt_col).cast("string") if prompt_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(loss_from, F.lit(0)).alias("loss_from"), prompt.alias("prompt"))
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ids_of(tokenizer_path)
        packer = Packer(max_tokens, max_segments or max_tokens, max_loss or max_tokens, TaskContext.get().partitionId() << 40)
        kinds: list[pa.DataType] = []

        def out() -> Iterator[pa.RecordBatch]:
            if placed := packer.drain():
                columns = [pa.array(x, t) for x, t in zip(zip(*placed), [kinds[0], *[pa.int64()] * 7])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"])

        for batch in batches:
            kinds[:] = [batch.column(0).type]
            docs, texts, firsts = (batch.column(i).to_pylist() for i in range(3))
            prompts = encode.batch(batch.column(3).to_pylist()) if prompt_col else [b""] * len(docs)
            for doc, before, ids, first in zip(docs, prompts, encode.batch(texts), firsts):
                packer.add(doc, before + ids + end, first + len(before) // 4)
            yield from out()
        packer.pack()
        yield from out()

    return rows.mapInArrow(scan, COLUMNS.format(kind))
