"""Token ids and token counts of whole texts, as the public tokenizer libraries give them.

Both libraries treat text between two blanks on its own for the vocabularies used here, so one
word needs the library once per worker: its ids are kept in a bounded table and a text's ids are
those of its words, joined. Where a tokenizer's file or a text doesn't allow that, the library
encodes the whole text.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from pathlib import Path

import numpy as np

#: Words kept in each generation of a worker's table of counts, and the characters of the longest word that is kept (under 50 MB a generation).
KEPT_WORDS, KEPT_CHARS = 250_000, 64
#: Slots of a worker's table of ids, ids and bytes of words at which it is emptied (some 90 MB in all), bytes that are looked up at once, and the hash's odd base.
TABLE_SLOTS, TABLE_IDS, TABLE_BYTES, CHUNK_BYTES, _BASE = 1 << 20, 1 << 23, 1 << 24, 1 << 18, 0x5851F42D4C957F2D
#: Lower-case letters that normalisation leaves as they are; a word of them is one piece, for the model alone.
_LETTERS = [*range(0xDF, 0xF7), *range(0xF8, 0x100)]
_SIMPLE = re.compile("[a-z" + "".join(map(chr, _LETTERS)) + "]+")
_LOADED: dict[tuple[str, str], object] = {}


class _Words(dict):
    """Word to value; a missing word is encoded and kept. Two generations: words in use outlive the emptying."""

    def __init__(self, encode: Callable) -> None:
        super().__init__()
        self.encode, self.before = encode, {}

    def __missing__(self, word):
        value = self[word] = self.before.get(word) or self.encode(word)
        return value

    def bounded(self) -> None:
        if len(self) > KEPT_WORDS:
            self.before = dict(self)
            self.clear()


def _encodes_words_alone(spec: dict) -> bool:
    """Whether a tokenizer file drops white space between pieces and normalises character by character."""
    normal, split = spec.get("normalizer") or {}, (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    steps = [s.get("type") for s in normal.get("normalizers", [])]
    blanks = [s for s in normal.get("normalizers", []) if s.get("type") == "Replace"]
    first = split[0] if split else {}
    return (
        steps == ["NFC", "Replace", "Lowercase"]
        and blanks[0].get("pattern") == {"Regex": r"\s+"}
        and blanks[0].get("content") == " "
        and (first.get("type"), first.get("behavior"), first.get("invert")) == ("Split", "Removed", True)
        and r"[^\s\p{L}\p{N}]+" in (first.get("pattern") or {}).get("Regex", "")
        and not spec.get("post_processor")
        and all("<|" in t["content"] and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec["added_tokens"])
    )


def _grown(pool: np.ndarray, size: int) -> np.ndarray:
    """The pool, or a longer copy that holds ``size`` values."""
    return pool if size <= len(pool) else np.concatenate([pool, np.zeros(max(len(pool), size - len(pool)), pool.dtype)])


class _IdTable:
    """Words to their ids, in arrays with open addressing: some 40 bytes a word, and looked up for many words at once.

    Words are found by their 64-bit hashes and then held against the bytes that the table keeps of them, so words that share
    a hash are told apart: the first holds the slot.
    """

    def __init__(self, slots: int) -> None:
        self.mask, self.held = np.uint64(slots - 1), 0
        self.keys, self.at, self.size = np.zeros(slots, np.uint64), np.zeros(slots, np.uint32), np.zeros(slots, np.uint32)
        self.word_at, self.word_size = np.zeros(slots, np.uint32), np.zeros(slots, np.uint32)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.words, self.words_used = np.zeros(1 << 16, np.uint8), 0

    def slots_of(self, hashes: np.ndarray) -> np.ndarray:
        """Each hash's slot, or the empty one where it belongs."""
        slots = (hashes & self.mask).astype(np.int64)
        rest = np.flatnonzero((self.keys[slots] != hashes) & (self.keys[slots] != 0))
        while len(rest):
            slots[rest] = (slots[rest] + 1) & int(self.mask)
            now = self.keys[slots[rest]]
            rest = rest[(now != hashes[rest]) & (now != 0)]
        return slots

    def added(self, ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Where the pool holds some words' ids from now on, and how many."""
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for own in ids for x in own), np.uint32, int(sizes.sum()))
        self.pool = _grown(self.pool, self.used + len(flat))
        self.pool[self.used : self.used + len(flat)] = flat
        starts = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        return starts, sizes

    def put(self, hashes: np.ndarray, words: list[bytes], ids: list[list[int]]) -> None:
        """Add words whose hashes are distinct and not in the table."""
        starts, sizes = self.added(ids)
        joined = np.frombuffer(b"".join(words), np.uint8)
        self.words = _grown(self.words, self.words_used + len(joined))
        self.words[self.words_used : self.words_used + len(joined)] = joined
        keys, mask, place = self.keys, int(self.mask), self.words_used
        for h, start, size, word in zip(hashes.tolist(), starts.tolist(), sizes.tolist(), words):
            slot = h & mask
            while keys[slot]:
                slot = (slot + 1) & mask
            keys[slot], self.at[slot], self.size[slot] = h, start, size
            self.word_at[slot], self.word_size[slot] = place, len(word)
            place += len(word)
        self.words_used = place
        self.held += len(ids)

    def others(self, slots: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which words ``raw[start:end]`` aren't the ones that their slots hold."""
        sizes = ends - starts
        odd = self.word_size[slots] != sizes
        same = np.flatnonzero(~odd)
        if len(same):
            own = sizes[same]
            first = np.cumsum(own) - own
            step = np.arange(int(own.sum())) - np.repeat(first, own)
            differ = raw[np.repeat(starts[same], own) + step] != self.words[np.repeat(self.word_at[slots[same]].astype(np.int64), own) + step]
            odd[same] = np.logical_or.reduceat(differ, first)
        return np.flatnonzero(odd)

    def full(self, more: int) -> bool:
        """Whether so many more words are too many."""
        return self.held + more > 0.7 * len(self.keys) or self.used > TABLE_IDS or self.words_used > TABLE_BYTES

    def clear(self) -> None:
        """Forget all words."""
        self.keys[:] = 0
        self.held = self.used = self.words_used = 0


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = True


def _powers(base: int) -> np.ndarray:
    """The powers of a base modulo 2^64."""
    factors = np.full(CHUNK_BYTES + 1, base, np.uint64)
    factors[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(factors)


class IdEncoder:
    """Ids of a ``tokenizers`` file, without added special tokens, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        self._alone = _encodes_words_alone(json.loads(Path(path).read_text(encoding="utf-8")))
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._mapped = {x: as_bytes.pre_tokenize_str(chr(x))[0][0] for x in _LETTERS}
        self._table = _IdTable(TABLE_SLOTS)
        self._powers, self._inverse = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))

    def whole(self, text: str) -> bytes:
        """The ids of a text by one call of the library."""
        return np.asarray(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: bytes) -> list[int]:
        text = word.decode("utf-8")
        if _SIMPLE.fullmatch(text):
            return [x.id for x in self._tokenizer.model.tokenize(text.translate(self._mapped))]
        return self._tokenizer.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str | None) -> bytes:
        """The ids of a text; a null counts as empty."""
        return self.batch([text])[0]

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of texts, in stretches of bounded size."""
        out: list[bytes] = [b""] * len(texts)
        held, size = [], 0
        for i, text in enumerate(texts):
            if not text:
                continue
            raw = text.encode("utf-8")
            if not self._alone or b"<|" in raw:
                out[i] = self.whole(text)
                continue
            raw = raw.lower()
            if len(raw) > CHUNK_BYTES // 2:
                out[i] = b"".join(b"".join(self._stretch([x])) for x in _cut(raw))
                continue
            if size + len(raw) + 1 > CHUNK_BYTES:
                self._fill(out, held)
                held, size = [], 0
            held.append((i, raw))
            size += len(raw) + 1
        self._fill(out, held)
        return out

    def _fill(self, out: list[bytes], held: list[tuple[int, bytes]]) -> None:
        for (i, _), ids in zip(held, self._stretch([raw for _, raw in held])):
            out[i] = ids

    def _stretch(self, raws: list[bytes]) -> list[bytes]:
        """The ids of lower-case texts that together fit in a chunk."""
        joined = b"\n".join(raws)
        if len(joined) > CHUNK_BYTES:  # one word without a blank
            return [self.whole(raw.decode("utf-8")) for raw in raws]
        raw = np.frombuffer(joined, np.uint8)
        blank = np.concatenate([[True], _BLANK[raw], [True]])
        starts, ends = np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])
        if not len(starts):
            return [b""] * len(raws)
        # a word's last letter or digit ends a piece, so punctuation behind it is a piece of its own
        place = np.where(_PUNCT[raw], -1, np.arange(len(raw)))
        core = np.maximum.accumulate(place)[ends - 1]
        parts = (core >= starts) & (core < ends - 1) & _ALNUM[raw[core]]
        order = np.argsort(np.concatenate([starts, core[parts] + 1]), kind="stable")
        starts, ends = np.concatenate([starts, core[parts] + 1])[order], np.concatenate([np.where(parts, core + 1, ends), ends[parts]])[order]
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self._powers[: len(raw)])])
            hashes = (sums[ends] - sums[starts]) * self._inverse[starts]
            hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) ^ (hashes >> np.uint64(7))
        hashes |= np.uint64(1) << np.uint64(63)
        table = self._table
        slots = table.slots_of(hashes)
        missing = np.flatnonzero(table.keys[slots] == 0)
        if len(missing):
            new, first = np.unique(hashes[missing], return_index=True)
            if table.full(len(new)):
                table.clear()
                new, missing = np.unique(hashes, return_index=True)
                first = np.arange(len(missing))
            chosen = missing[first]
            words = [joined[s:e] for s, e in zip(starts[chosen].tolist(), ends[chosen].tolist())]
            table.put(new, words, list(map(self._word, words)))
            slots = table.slots_of(hashes)
        at, sizes = table.at[slots].astype(np.int64), table.size[slots].astype(np.int64)
        if len(odd := table.others(slots, raw, starts, ends)):
            at[odd], sizes[odd] = table.added([self._word(joined[s:e]) for s, e in zip(starts[odd].tolist(), ends[odd].tolist())])
        ends_at = np.cumsum(sizes)
        ids = table.pool[np.repeat(at - (ends_at - sizes), sizes) + np.arange(ends_at[-1])]
        if len(raws) == 1:
            return [ids.astype("<u4").tobytes()]
        bounds = np.cumsum([len(r) + 1 for r in raws])
        cuts = np.concatenate([[0], ends_at])[np.searchsorted(starts, bounds)]
        return [x.astype("<u4").tobytes() for x in np.split(ids, cuts[:-1])]


def _cut(raw: bytes) -> list[bytes]:
    """A long text in pieces of half a chunk, cut at blanks; a piece without a blank is longer."""
    out, at = [], 0
    while len(raw) - at > CHUNK_BYTES // 2:
        found = max(raw.rfind(c, at, at + CHUNK_BYTES // 2) for c in (b" ", b"\n"))
        if found <= at:
            found = min((x for c in (b" ", b"\n") if (x := raw.find(c, at + CHUNK_BYTES // 2)) > 0), default=len(raw))
        out.append(raw[at:found])
        at = found
    return [*out, raw[at:]]


class CountEncoder:
    """Number of tokens by a ``tokenizers`` or ``sentencepiece`` file, without begin, end or added special tokens."""

    def __init__(self, path: str) -> None:
        if path.endswith(".json"):
            ids = IdEncoder(path)
            self._count, self._alone = (lambda text: len(ids(text)) // 4), False
            return
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self._count = lambda text: len(model.encode(text))
        mark = "\N{LOWER ONE EIGHTH BLOCK}"
        inner = any(mark in model.id_to_piece(i).lstrip(mark) for i in range(model.get_piece_size()))
        keeps_blanks = model.encode("a  b", out_type=str) != model.encode("a b", out_type=str)
        as_is = all(model.decode(model.encode(x)) == x for x in ("\N{LATIN SMALL LIGATURE FI}", "\N{IDEOGRAPHIC SPACE}x", "E\N{COMBINING ACUTE ACCENT}"))
        self._alone, self._mark = not inner and keeps_blanks and as_is, mark
        self._words = _Words(self._count)

    def __call__(self, text: str | None) -> int:
        """The number of tokens of a text; a null counts as empty."""
        if not text:
            return 0
        if not self._alone or "  " in text or text[0] == " " or text[-1] == " " or self._mark in text:
            return self._count(text)
        self._words.bounded()
        words = text.split(" ")
        if len(max(words, key=len)) <= KEPT_CHARS:
            return sum(map(self._words.__getitem__, words))
        return sum(self._words[w] if len(w) <= KEPT_CHARS else self._count(w) for w in words)


def ids_of(path: str) -> IdEncoder:
    """The encoder of this worker for a file; it lives on between tasks."""
    return _LOADED.setdefault(("ids", path), None) or _load("ids", path, IdEncoder)


def counts_of(path: str) -> CountEncoder:
    """The counter of this worker for a file; it lives on between tasks."""
    return _LOADED.setdefault(("counts", path), None) or _load("counts", path, CountEncoder)


def _load(kind: str, path: str, make: type) -> object:
    value = _LOADED[(kind, path)] = make(path)
    return value
