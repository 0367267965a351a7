"""Benchmark decontamination by template canonicalisation.

Texts become sequences of template tokens: lower-cased words without outer punctuation, where numbers,
units of measure and names (capitalised words inside a sentence) are typed placeholders, and a run of
names is one. Windows of ``WINDOW`` tokens are hashed and joined with the benchmark's windows. Where
windows of an item lie close together in a document, the values of their placeholders are held against
each other: one value of the item must stand for one value of the document throughout, else the window
doesn't count. A document is contaminated by an item if ``SIMILARITY`` of the item's windows are found
so, be the slots' values the item's own or new ones (a re-parameterised question).

Whether a capitalised word is a name can't be told where a sentence begins, and case and sentence ends differ
between copies. So windows are hashed in three typings (``Template``), and a window is found if it is in any.

Windows of fewer than two plain words say too little and count on neither side, unless an item has no
others; an item shorter than a window is one window. A sentence's first word typed as a name counts as plain if it is the item's own.

Documents are scanned once, whatever the benchmark's size: of their windows those go on whose hash may be in the benchmark by
two bits of a table of at most 2^``MOST_BITS`` bits. They are joined with each item's rarest windows by hash; of the pairs that met so, those
with enough windows in common are held against each other, slots and all, text by text. Texts that no pair needs stay where they are.

Defined cases: null or empty texts and items match nothing; null ids and repeated rows are kept row by row, repeated items
count once; very long texts are read whole; empty tables give no matches; extra columns, whatever their names, are left out of
matches and kept by the filter.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import storage

WINDOW, SIMILARITY, PLAIN_WORDS = 5, 0.8, 2
#: Characters of documents that a task reads at once, and of items that may be broadcast.
CHUNK_CHARS, BROADCAST_CHARS = 1 << 20, 4 << 20
#: Bits of the table of the benchmark's hashes for each of its windows, and the table's least and most size as powers of two.
BITS_EACH, LEAST_BITS, MOST_BITS = 64, 16, 27
#: Items whose windows a worker keeps.
KEPT_ITEMS = 2_000
#: Words whose tokens a worker keeps.
KEPT_WORDS = 300_000

WORD, NUMBER, UNIT, NAME = range(4)
INSIDE, CAPITAL, LITERAL = range(3)
#: Numbers and units as words, in the corpus's four languages.
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million "
    "zwei drei vier fünf sechs sieben acht neun zehn elf zwölf hundert tausend deux trois quatre cinq six sept huit neuf dix "
    "onze douze cent mille dos tres cuatro cinco seis siete ocho nueve diez once doce ciento mil".split()
)
UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers "
    "kilometre kilometres mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l liter "
    "liters litre litres gallon gallons cup cups s sec secs second seconds min mins minute minutes h hr hrs hour hours day "
    "days week weeks month months year years mph kph km/h m/s hz khz mhz ghz w kw mw v a pa bar psi j kj cal kcal k °c °f "
    "degree degrees percent % usd eur gbp dollar dollars cent cents euro euros sekunde sekunden minuten stunde stunden tag "
    "tage woche wochen monat monate jahr jahre heure heures jour jours semaine semaines mois an ans hora horas día días "
    "semana semanas mes meses año años".split()
)
_NUMBER = re.compile(r"[+-]?\d[\d.,:/-]*\Z")
_DIGIT = re.compile(r"\d")
_GLUED = re.compile(r"(?<=\d)(?=[^\W\d_]|[%°])")
_OUTER = re.compile(r"^[^\w%°+-]+|[^\w%°]+$")
_PRIME, _PLACES = np.uint64(0x9E3779B97F4A7C15), np.array([b"<number>", b"<unit>", b"<name>"])
_HOLDER = np.array([0, *(xxhash.xxh64_intdigest(bytes(x)) for x in _PLACES)], np.uint64)
_ENDS, _CLOSERS = ".!?:;…", "\"')]}»”"


class Words(dict[str, int]):
    """Word to its row of hashes and facts, bounded; a fact byte holds the kind and whether it may be a name, ends a sentence, stays."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes, self.facts = array("Q"), bytearray()

    def __missing__(self, word: str) -> int:
        if word.isalpha():
            core = word
        elif word[:-1].isalpha() and word[-1] in ".,;:!?":
            core = word[:-1]
        else:
            core = _OUTER.sub("", word) or ("%" if "%" in word else "")
        low = core.lower()
        kind = UNIT if low in UNITS else NUMBER if low in NUMBER_WORDS or not core.isalpha() and _NUMBER.match(core) else WORD
        named = kind == WORD and core[:1].isupper() and core[1:] != core[1:].upper()
        ends = word[-1] in _ENDS or word[-1] in _CLOSERS and word.rstrip(_CLOSERS)[-1:] in _ENDS
        row = self[word] = len(self)
        self.hashes.append(xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass")))
        self.facts.append(kind | named << 2 | ends << 3 | bool(core) << 4)
        return row

    def known(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' hashes and facts."""
        if len(self) > KEPT_WORDS:
            self.clear()
            self.hashes, self.facts = array("Q"), bytearray()
        rows = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return np.frombuffer(self.hashes, np.uint64)[rows], np.frombuffer(self.facts, np.uint8)[rows]


#: The table of a worker; it lives on between tasks.
_WORDS = Words()


class View(NamedTuple):
    """A text's template tokens in one typing: hashes, kinds, what placeholders stand for, places of their first words, last words, and names that begin a sentence."""

    tokens: np.ndarray
    kinds: np.ndarray
    values: np.ndarray
    starts: np.ndarray
    lasts: np.ndarray
    opens: np.ndarray

    def windows(self, size: int) -> np.ndarray:
        """Hash of each window of ``size`` tokens."""
        n = len(self.tokens) - size + 1
        if n < 1:
            return np.zeros(0, np.uint64)
        whole = self.tokens[:n].copy()
        with np.errstate(over="ignore"):
            for i in range(1, size):
                whole *= _PRIME
                whole += self.tokens[i : i + n]
            whole *= _PRIME
        return whole ^ (whole << np.uint64(32))

    def plain(self, size: int) -> np.ndarray:
        """Number of plain words of each window of ``size`` tokens."""
        sums = np.concatenate([[0], np.cumsum(self.kinds == WORD)])
        return sums[size:] - sums[:-size]


class Template:
    """A text's template tokens in three typings of its capitalised words.

    ``INSIDE``: names but for a sentence's first word; ``CAPITAL``: names wherever they stand; ``LITERAL``: plain words.
    """

    def __init__(self, text: str | list[str | None] | None, words: Words) -> None:
        found, sizes = [], []
        for one in text if isinstance(text, list) else [text]:
            cut = (_GLUED.sub(" ", one) if _DIGIT.search(one) else one).split() if one else []
            found += cut
            sizes.append(len(cut))
        hashes, facts = words.known(found)
        #: The text that each token comes from; no run of names and no window spans two.
        self.docs = np.repeat(np.arange(len(sizes)), sizes)
        kinds, named, ends, stays = (facts & 3).astype(np.int8), (facts & 4) > 0, (facts & 8) > 0, (facts & 16) > 0
        first = self._edges() | np.concatenate([[True], ends[:-1]])[: len(found)]
        if not stays.all():
            hashes, kinds, named, first, self.docs = hashes[stays], kinds[stays], named[stays], first[stays], self.docs[stays]
        literal = View(np.where(kinds == WORD, hashes, _HOLDER[kinds]), kinds, hashes, np.arange(len(hashes)), hashes, np.zeros(len(hashes), bool))
        if named.any():
            opening, cuts = named & first, first | self._edges()
            inside = self._view(hashes, kinds, named & ~first, cuts, np.zeros(len(hashes), bool))
            self.views = [inside, self._view(hashes, kinds, named, cuts, opening) if opening.any() else inside, literal]
        else:
            self.views = [literal, literal, literal]

    def run(self, typing: int, at: int) -> np.ndarray:
        """The hashes of the words that a token of a view is made of."""
        starts, words = self.views[typing].starts, self.views[LITERAL].values
        return words[starts[at] : starts[at + 1] if at + 1 < len(starts) else len(words)]

    def _edges(self) -> np.ndarray:
        return np.concatenate([[True], self.docs[1:] != self.docs[:-1]])[: len(self.docs)]

    @staticmethod
    def _view(hashes: np.ndarray, kinds: np.ndarray, names: np.ndarray, first: np.ndarray, opens: np.ndarray) -> View:
        """A run of names in a sentence is one, with the values of all."""
        starts = np.flatnonzero(~names | first | ~np.concatenate([[False], names[:-1]]))
        kinds = np.where(names, NAME, kinds)[starts]
        with np.errstate(over="ignore"):
            mixed = hashes * (np.arange(len(hashes), dtype=np.uint64) - np.repeat(starts, np.diff([*starts, len(hashes)])).astype(np.uint64) + np.uint64(1)) * _PRIME
            values = np.where(names[starts], np.add.reduceat(mixed, starts), hashes[starts])
        return View(np.where(kinds == WORD, values, _HOLDER[kinds]), kinds, values, starts, hashes[np.append(starts[1:], len(hashes)) - 1], opens[starts])

    def hashed(self, sizes: list[int]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """``(typing, size, texts, hashes)`` of the windows within texts."""
        for typing, view in enumerate(self.views):
            docs = self.docs[view.starts]
            for size in sizes:
                hashes = view.windows(size)
                own = np.flatnonzero(docs[: len(hashes)] == docs[size - 1 :]) if len(hashes) else np.zeros(0, np.int64)
                yield typing, size, docs[own], hashes[own]


class Item(NamedTuple):
    """A benchmark item, how many of its windows count, and the plain words that a window needs."""

    item_id: int | None
    template: Template
    total: int
    need: int


class Index:
    """The windows of some benchmark items in every typing, as arrays in the order of their hashes."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int, similarity: float) -> None:
        words, self.similarity = _WORDS, similarity
        self.items: list[Item] = []
        at: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        for item_id, text in items:
            template = Template(text, words)
            base = template.views[INSIDE]
            if not len(base.tokens):
                continue
            plain = base.plain(min(window, len(base.tokens)))
            need = min(PLAIN_WORDS, int(plain.max()))
            said = np.flatnonzero(plain >= need)
            for typing, view in enumerate(template.views):
                size = min(window, len(view.tokens))
                hashes = view.windows(size)
                # the window that holds the counted one: from the token with its first word on, or the last
                own = np.minimum(np.searchsorted(view.starts, base.starts[said], "right") - 1, len(hashes) - 1)
                at[size].append((hashes[own], np.stack([np.full(len(own), typing), np.full(len(own), len(self.items)), said, own]).T.astype(np.int32)))
            self.items.append(Item(item_id, template, len(said), need))
        self.window, self.sizes = window, sorted(at)
        self.hashes, self.entries = {}, {}
        for s in self.sizes:
            hashes, entries = (np.concatenate(x) for x in zip(*at[s]))
            order = np.argsort(hashes, kind="stable")
            self.hashes[s], self.entries[s] = hashes[order], entries[order]

    def _hits(self, view: View, size: int) -> list[tuple[int, list[list[int]]]]:
        """A view's windows that items have, with their entries."""
        hashes, own = view.windows(size), self.hashes[size]
        low, high = (np.searchsorted(own, hashes, side) for side in ("left", "right"))
        return [(i, self.entries[size][low[i] : high[i]].tolist()) for i in np.flatnonzero(low < high).tolist()]

    def matches(self, text: str | None, words: Words) -> list[tuple]:
        """``(item_id, coverage, windows, slots, changed slots)`` of the items that contaminate a text."""
        template, near = Template(text, words), defaultdict(list)
        for size in self.sizes:
            hits: list[tuple[int, list[list[int]]]] = []
            for typing, view in enumerate(template.views):
                if not typing or view is not template.views[typing - 1]:
                    hits = self._hits(view, size)
                for p, entries in hits:
                    for own, item, k, q in entries:
                        if own == typing:
                            near[item].append((p, typing, k, q, size))
        found = []
        for number, hits in near.items():
            item = self.items[number]
            if len({k for _, _, k, _, _ in hits}) < self.similarity * item.total:
                continue
            best, cluster, base = (0, 0, 0), [], template.views[INSIDE].starts
            place = [int(np.searchsorted(base, template.views[typing].starts[p], "right")) for p, typing, *_ in hits]
            last = 0
            for at, hit in [*sorted(zip(place, hits)), (0, None)]:
                if cluster and (hit is None or at - last > len(item.template.views[INSIDE].tokens)):
                    best = max(best, self._consistent(template, item, cluster))
                    cluster = []
                cluster.append(hit)
                last = at
            if best[0] >= self.similarity * item.total:
                found.append((item.item_id, best[0] / item.total, best[0], best[1], best[2]))
        return found

    def _slots(self, template: Template, item: Item, hit: tuple[int, ...]) -> list[tuple] | None:
        """The item's slots in a window with what stands for them; none if the window says too little or differs behind it."""
        p, typing, k, q, size = hit
        own, other = item.template.views[typing], template.views[typing]
        if typing == LITERAL:  # a counted window with names in it has more words
            base = item.template.views[INSIDE]
            end = min(k + self.window, len(base.starts))
            size = max(size, int([*base.starts, len(own.tokens)][end]) - q)
            if not np.array_equal(own.tokens[q : q + size], other.tokens[p : p + size]):
                return None
        elif typing == CAPITAL:
            same = own.opens[q : q + size] & (own.lasts[q : q + size] == other.lasts[p : p + size])
            if (same | (own.kinds[q : q + size] == WORD)).sum() < item.need:
                return None
        return [((int(own.kinds[q + i]), int(own.values[q + i])), self._stands(template, item, typing, p + i, q + i)) for i in range(size) if own.kinds[q + i] != WORD]

    @staticmethod
    def _stands(template: Template, item: Item, typing: int, p: int, q: int) -> int:
        """What stands in the document for the item's token; names that run on beyond the item's first or last one are the item's own."""
        own, other = item.template.views[typing], template.views[typing]
        if own.kinds[q] == NAME and own.values[q] != other.values[p] and (q == 0 or q == len(own.kinds) - 1):
            words, run = item.template.run(typing, q), template.run(typing, p)
            if len(words) < len(run) and (q == 0 and np.array_equal(words, run[-len(words) :]) or q and np.array_equal(words, run[: len(words)])):
                return int(own.values[q])
        return int(other.values[p])

    def _consistent(self, template: Template, item: Item, hits: list[tuple[int, ...]]) -> tuple[int, int, int]:
        """How many of the item's windows agree on what each slot's value stands for; slots, and slots of another value."""
        stands: dict[tuple[int, int], int] = {}
        counted = set()
        lines = defaultdict(list)
        for hit in hits:
            if (slots := self._slots(template, item, hit)) is not None:
                lines[hit[1], hit[0] - hit[3]].append((hit[0], hit[2], slots))
        votes = Counter(x for line in lines.values() for _, _, slots in line for x in set(slots))
        most = {k: v for (k, v), _ in reversed(votes.most_common())}
        ordered = [x for _, line in sorted(lines.items(), key=lambda x: (-len(x[1]), x[0])) for x in line]
        for _, k, slots in sorted(ordered, key=lambda x: any(most[s] != v for s, v in x[2])):
            fresh: dict[tuple[int, int], int] = {}
            if k not in counted and all(stands.get(s, fresh.setdefault(s, v)) == v and fresh.get(s, v) == v for s, v in slots):
                stands |= fresh
                counted.add(k)
        return len(counted), len(stands), sum(k[1] != v for k, v in stands.items())


MATCHES = "item_id long, coverage double, windows long, slots long, changed_slots long"
_KEY = ("id", "digest", "check")


def _key(id_col: str, text_col: str) -> Column:
    """What tells rows apart: their id and two hashes of their text."""
    text = F.col(text_col).cast("string")
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("digest"), F.hash(text).alias("check"))


def _same(left: Column, right: Column) -> list[Column]:
    return [left[c].eqNullSafe(right[c]) for c in _KEY]


def item_windows(items: DataFrame, window: int, similarity: float) -> DataFrame:
    """``(item, total, typing, size, hash, k)``: the windows ``k`` of the items ``(item, text)`` that count, in every typing."""
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                index = Index([(0, text)], window, similarity)
                for size in index.sizes:
                    entries = index.entries[size]
                    at += [i] * len(entries)
                    rows += zip([index.items[0].total] * len(entries), entries[:, 0].tolist(), [size] * len(entries), index.hashes[size].view(np.int64).tolist(), entries[:, 2].tolist())
            columns = [pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 5, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], ["item", "total", "typing", "size", "hash", "k"])

    return items.select("item", "text").mapInArrow(cut, f"item {items.schema['item'].dataType.simpleString()}, total long, typing int, size int, hash long, k int")


def _bit_table(windows: DataFrame) -> tuple[int, np.ndarray]:
    """The power of two and the bits of a table that has two bits for every window's hash: at its first bits and at its last."""
    power = int(np.clip(np.ceil(np.log2(max(1, windows.count()) * BITS_EACH)), LEAST_BITS, MOST_BITS))
    place = F.explode(F.array(F.shiftrightunsigned("hash", 64 - power), F.col("hash").bitwiseAND(F.lit((1 << power) - 1).cast("long"))))
    windows, place = windows.select(place.alias("place")), F.col("place")
    # one row for each 64 bits at most, whatever the benchmark
    words = windows.groupBy(F.shiftrightunsigned(place, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))).alias("bits")).toArrow()
    table = np.zeros(1 << power - 6, np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    return power, np.unpackbits(table.view(np.uint8), bitorder="little").view(bool)


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Stretches of texts of about ``CHUNK_CHARS``."""
    first = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text or "") > CHUNK_CHARS:
            yield first, i
            first, size = i, 0
        size += len(text or "")
    if first < len(texts):
        yield first, len(texts)


def _hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """``(doc, typing, size, hash)``: windows of the documents ``(doc, text)`` whose hash the benchmark may have."""
    power, bits = _bit_table(windows)
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())  # no more than a window has tokens
    packed, shift, last = np.packbits(bits, bitorder="little").tobytes(), np.uint64(64 - power), np.uint64((1 << power) - 1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little").view(bool)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for first, end in _chunks(texts):
                found = [np.zeros((0, 4), np.int64)]
                for typing, size, own, hashes in Template(texts[first:end], _WORDS).hashed(sizes):
                    maybe = np.flatnonzero(table[(hashes >> shift).astype(np.int64)])
                    maybe = maybe[table[(hashes[maybe] & last).astype(np.int64)]]
                    found.append(np.stack([own[maybe] + first, np.full(len(maybe), typing), np.full(len(maybe), size), hashes[maybe].view(np.int64)], axis=1))
                rows = np.unique(np.concatenate(found), axis=0)
                if len(rows):
                    columns = [batch.column(0).take(pa.array(rows[:, 0])), pa.array(rows[:, 1], pa.int32()), pa.array(rows[:, 2], pa.int32()), pa.array(rows[:, 3], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc", "typing", "size", "hash"])

    return docs.select("doc", "text").mapInArrow(scan, f"doc {docs.schema['doc'].dataType.simpleString()}, typing int, size int, hash long")


def rarest(windows: DataFrame, similarity: float) -> DataFrame:
    """Of each item the windows of which a contaminated document has one at least: one more than may be missing, those that the fewest items share."""
    shared = windows.groupBy("typing", "size", "hash").agg(F.count_distinct("item").alias("items"))
    often = windows.join(shared, ["typing", "size", "hash"]).groupBy("item", "k").agg(F.max("total").alias("total"), F.sum("items").alias("items"))
    place = F.row_number().over(Window.partitionBy("item").orderBy("items", "k"))
    chosen = often.withColumn("place", place).where(F.col("place") <= F.col("total") - F.ceil(similarity * F.col("total")) + 1)
    return windows.join(chosen.select("item", "k"), ["item", "k"], "left_semi")


def _pairs(hits: DataFrame, windows: DataFrame, similarity: float) -> DataFrame:
    """``(pair, item)``: documents and items with enough windows in common.

    Documents meet an item by its rarest windows alone, so a window that many items share brings nobody together that has no more in
    common; all windows are then counted for the pairs that met.
    """
    key = ["typing", "size", "hash"]
    met = hits.join(rarest(windows, similarity), key).select("doc", "item").distinct()
    held = met.join(windows, "item").join(hits, ["doc", *key])
    counts = held.groupBy("doc", "item").agg(F.count_distinct("k").alias("n"), F.max("total").alias("total"))
    return counts.where(F.col("n") >= similarity * F.col("total")).select(F.col("doc").alias("pair"), "item")


_ITEMS: dict[tuple, Index] = {}


def _item(text: str, window: int, similarity: float) -> Index:
    """An item's windows, kept by the worker."""
    key = text, window, similarity
    if key not in _ITEMS:
        if len(_ITEMS) >= KEPT_ITEMS:
            _ITEMS.clear()
        _ITEMS[key] = Index([(0, text)], window, similarity)
    return _ITEMS[key]


def _matched(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_id_col: str, item_text_col: str, window: int, similarity: float) -> DataFrame:
    """``(doc, item_id, coverage, windows, slots, changed_slots)`` of each row and item that contaminates it; doc is the row's key."""
    storage.bounded_batches(docs.sparkSession)
    doc, item = _key(id_col, text_col), _key(item_id_col, item_text_col)
    rows = docs.select(doc.alias("doc"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(item.alias("item"), F.col(item_text_col).cast("string").alias("text")).where("text is not null").dropDuplicates(["item"])
    items = storage.written(items, "decontamination-items")
    windows = storage.written(item_windows(items, window, similarity), "decontamination-windows")
    hits = storage.written(_hits(rows, windows), "decontamination-hits")
    pairs = storage.written(_pairs(hits, windows, similarity), "decontamination-pairs")
    chars = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    own = items.select(F.col("item").alias("own"), F.col("text").alias("item_text"))
    likely, _ = storage.parted(rows, F.col("doc.digest"), pairs, F.col("pair.digest"))
    found = likely.join(pairs.hint("shuffle_hash"), _same(F.col("doc"), F.col("pair")))
    found = found.join(F.broadcast(own) if chars <= BROADCAST_CHARS else own, _same(F.col("item"), F.col("own")))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.float64(), *[pa.int64()] * 3]
        for batch in batches:
            at, told = [], []
            for i, (text, own) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                for _, *match in _item(own, window, similarity).matches(text, _WORDS):
                    at.append(i)
                    told.append(match)
            if at:
                kept = [batch.column(c).take(pa.array(at, pa.int64())) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x, t) for x, t in zip(zip(*told), kinds))], ["doc", *(x.split()[0] for x in MATCHES.split(", "))])

    out = found.select("doc", F.col("item.id").cast("long").alias("item_id"), "text", "item_text")
    return out.mapInArrow(check, f"doc {rows.schema['doc'].dataType.simpleString()}, {MATCHES}")


def contaminations(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, similarity: float = SIMILARITY) -> DataFrame:
    """A row for each document and item that contaminates it; clean documents have none."""
    found = _matched(docs, benchmark, id_col, text_col, item_id_col, item_text_col, window, similarity)
    return found.select(F.col("doc.id").alias("doc_id"), *(x.split()[0] for x in MATCHES.split(", ")))


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with all their columns."""
    found = _matched(docs, benchmark, id_col, text_col, item_id_col, item_text_col, window, similarity)
    gone = storage.written(found.select(F.col("doc").alias("gone")).distinct(), "decontamination-gone")
    kept = F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)))
    rows = docs.select(kept.alias("kept"), _key(id_col, text_col).alias("doc"))
    likely, clean = storage.parted(rows, F.col("doc.digest"), gone, F.col("gone.digest"))
    rows = clean.unionByName(likely.join(gone.hint("shuffle_hash"), _same(F.col("doc"), F.col("gone")), "left_anti"))
    return rows.select(*(F.col("kept")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)))
