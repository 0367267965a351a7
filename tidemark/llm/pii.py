"""Personal data by weak supervision.

The base kinds (email, ip, card, phone) are found by fixed patterns, leftmost and without overlap, and
stay whatever happens. Looser patterns propose further spans: written-out emails, phone numbers without a country
code, social security numbers, bank accounts, names of people, card and phone numbers that the base patterns lost in a longer
run of digits, and card-like numbers with a wrong check digit. On every span, base ones included, labelers vote for, against
or not at all: strict regular expressions, gazetteers (mail providers and top-level domains, area codes, card
issuers, given names), the words before the span, its shape, and other personal data close by.

Votes are counted by pattern over all documents; expectation-maximisation (a reliability for each family of kinds, labeler and class)
turns the counts into posteriors. A logistic span classifier is trained on the posteriors of base and proposed spans: of at most ``SAMPLE``
distinct vectors of features of either sort, chosen by hash, each with the number of spans that have it, so repeats crowd nothing out. Its features are the kind, the votes, the span's shape and the hashed words around it, so it
tells spans apart that get the same votes. It decides on every proposed span.

The driver sees one count for each pattern of votes, a few thousand at most, and the sample, whatever the corpus.

Defined cases: a null or empty text has no spans; very long texts are scanned whole; null ids and repeated rows are kept row by
row; an empty table gives no rows; extra columns, whatever their names, are left out of the report and kept by the redaction.
"""

from __future__ import annotations

import bisect
import itertools
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import storage

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "email_written", "phone_local", "ssn", "iban", "person", "card_lost", "phone_lost", "card_like")
LABELERS = ("regex", "gazetteer", "context", "shape", "company")
#: Rounds of expectation-maximisation and of the classifier's training; the probability from which a proposed span counts.
EM_ROUNDS, TRAIN_ROUNDS, THRESHOLD = 50, 300, 0.5
#: Spans of either sort that the classifier is trained on, and places of its hashed words.
SAMPLE, PLACES = 10_000, 512
#: Entries that a gazetteer may have, and pseudo-counts by which a family's reliabilities lean on those of all kinds.
LISTED, LEANING = 100_000, 20.0

#: The base patterns, as given, with runs that can't be shorter made possessive.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: The proposals' patterns; a name is two or three capitalised words.
_PROPOSALS = {
    "email_written": re.compile(r"(?<![\w.%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[A-Za-z0-9-]{2,63}){1,4}", re.IGNORECASE),
    "phone_local": re.compile(r"(?<![\w+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-])"),
    "ssn": re.compile(r"(?<![\w+.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "person": re.compile(r"(?<!\w)[A-ZÀ-ÖØ-Þ][^\W\d_]{1,19}(?: [A-ZÀ-ÖØ-Þ][^\W\d_]{1,19}){1,2}(?!\w)"),
    "card_lost": re.compile(r"(?<![0-9])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{13,19})(?![0-9])"),
    "phone_lost": re.compile(r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
}
_WRITTEN = re.compile(r"[\[(] ?at ?[\])]", re.IGNORECASE)
#: Words before a span that speak for personal data of its kind, and against any.
_FOR = {
    "email": frozenset("e-mail email mail mails contact write courriel correo schreib kontakt écrire escribe".split()),
    "phone": frozenset("phone tel telephone call mobile cell fax telefon handy anruf téléphone teléfono llame ring reach".split()),
    "card": frozenset("card visa mastercard amex credit karte kreditkarte carte tarjeta".split()),
    "ip": frozenset("ip address host server adresse dirección".split()),
    "ssn": frozenset("ssn social security".split()),
    "iban": frozenset("iban account konto compte cuenta".split()),
    "person": frozenset("mr mrs ms dr prof name named contact herr frau madame monsieur señor señora from signed dear".split()),
}
_AGAINST = frozenset("version order invoice isbn issn page figure table section chapter part serial model bestellung commande pedido no nr ref sku".split())
#: Gazetteers of top-level domains, mail providers and given names.
_SUFFIXES = frozenset("com org net edu gov mil int info biz io de fr es it nl be uk us eu at ch pl pt br mx ar cl co jp cn in au ca ru se no fi dk example".split())
_PROVIDERS = frozenset("gmail googlemail yahoo hotmail outlook live msn aol icloud protonmail proton gmx web t-online freenet orange laposte free wanadoo terra".split())
_GIVEN = frozenset(
    "james john robert michael william david richard joseph thomas charles mary patricia jennifer linda elizabeth barbara susan jessica sarah karen nancy lisa emma olivia anna maria "
    "hans peter klaus jürgen stefan andreas sabine petra ursula monika karin julia lena lukas felix pierre jean jacques michel philippe marie nathalie isabelle sophie camille chloé "
    "josé juan antonio manuel francisco carlos miguel carmen ana isabel dolores pilar lucía sofía diego".split()
)


class Gazetteers(NamedTuple):
    """The lists that propose and vote; workers get them whole, so each is bounded by ``LISTED`` entries."""

    suffixes: frozenset[str] = _SUFFIXES
    providers: frozenset[str] = _PROVIDERS
    given: frozenset[str] = _GIVEN

    @classmethod
    def of(cls, table: DataFrame) -> Gazetteers:
        """From a table ``(list, entry)``, list being a field's name; lists that the table lacks stay as they are. Entries count in lower case, nulls don't."""
        rows = table.where("entry is not null").select("list", F.lower("entry").alias("entry")).distinct().groupBy("list").agg(F.count("*").alias("n"), F.slice(F.collect_list("entry"), 1, LISTED + 1).alias("entries")).collect()
        if unknown := {r["list"] for r in rows} - set(cls._fields):
            raise ValueError(f"no such list: {sorted(map(str, unknown))}")
        if large := [r["list"] for r in rows if r["n"] > LISTED]:
            raise ValueError(f"more than {LISTED} entries: {large}")
        return cls(**{r["list"]: frozenset(r["entries"]) for r in rows})


LISTS = Gazetteers()
_FAMILY = {"email": "email", "email_written": "email", "phone": "phone", "phone_local": "phone", "phone_lost": "phone", "card": "card", "card_lost": "card", "card_like": "card", "ip": "ip", "ssn": "ssn", "iban": "iban", "person": "person"}
_WORDS = re.compile(r"[^\W_]+(?:-[^\W_]+)?")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (found := _DOMAIN.match(text, at + 1)):
            end = found.end()
            yield start, end
        at = max(at + 1, end)


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(x), 10)) for x in digits[-2::-2])
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """The base kinds' spans in a text, by kind and start."""
    text = text or ""
    out = [("email", *x) for x in _emails(text)]
    if re.search("[0-9]", text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) < 3 or len(p) == 3 and int(p) <= 255 for x in m[0].split("."))]
        out += [("card", *m.span()) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and _luhn(d)]
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def _people(text: str, lists: Gazetteers = LISTS) -> Iterator[tuple[int, int]]:
    """Runs of two or three capitalised words of which one is a given name."""
    for m in _PROPOSALS["person"].finditer(text):
        words = m[0].split(" ")
        if all(w[1:].islower() for w in words) and any(w.lower() in lists.given for w in words):
            yield m.span()


def _capitals(text: str, lists: Gazetteers) -> bool:
    """Whether a given name may be in the text: some are looked for, many are looked up."""
    if len(lists.given) <= 200:
        lower = text.lower()
        return any(name in lower for name in lists.given)
    return any(w.lower() in lists.given for w in _WORDS.findall(text) if w[0].isupper())


def proposed_spans(text: str | None, base: list[tuple[str, int, int]], lists: Gazetteers = LISTS) -> list[tuple[str, int, int]]:
    """Further spans that don't touch base ones, by kind and start."""
    text = text or ""
    kinds = (["email_written"] if _WRITTEN.search(text) else []) + (["phone_local", "ssn", "iban"] if re.search("[0-9]", text) else [])
    found = [(kind, *m.span()) for kind in kinds for m in _PROPOSALS[kind].finditer(text)]
    if _capitals(text, lists):
        found += [("person", *x) for x in _people(text, lists)]
    if kinds:
        for m in _PROPOSALS["card_lost"].finditer(text):
            good = _luhn(_digits(m[0]))
            if good or len(m[0]) == 16:
                found.append(("card_lost" if good else "card_like", *m.span()))
        if "+" in text:
            found += [("phone_lost", *m.span()) for m in _PROPOSALS["phone_lost"].finditer(text)]
    taken = sorted((s, e) for _, s, e in base)
    reach = list(itertools.accumulate((e for _, e in taken), max))  # the furthest end of the first spans
    before = [bisect.bisect_left(taken, (x[2], 0)) for x in found]
    return [x for x, n in zip(found, before) if not n or reach[n - 1] <= x[1]]


def _near(spans: list[tuple[str, int, int]]) -> list[bool]:
    """Whether another span lies within 200 characters of each."""
    order = sorted(range(len(spans)), key=lambda i: spans[i][1:])
    out, reach = [False] * len(spans), -1_000
    for i, following in itertools.zip_longest(order, order[1:]):
        _, start, end = spans[i]
        out[i] = reach > start - 200 or following is not None and spans[following][1] < end + 200
        reach = max(reach, end)
    return out


def _iban(span: str) -> bool:
    text = span.replace(" ", "")
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _issued(digits: str) -> bool:
    """Whether a card number begins as the large issuers' do, at their lengths."""
    two, four = int(digits[:2]), int(digits[:4])
    if len(digits) == 15:
        return two in (34, 37)
    return len(digits) in (13, 16, 19) and (digits[0] == "4" or 51 <= two <= 55 or 2221 <= four <= 2720 or two == 65 or four == 6011)


def _strict(kind: str, span: str, digits: str, around: str) -> int:
    """The regular expressions' vote: whether the span keeps to its kind's full form."""
    if kind in ("card", "card_lost", "card_like"):
        return 1 if _luhn(digits) else -1
    if kind == "iban":
        return 1 if _iban(span) else -1
    if kind == "email":
        return 1 if span.rpartition(".")[2].isalpha() else -1
    if kind == "email_written":
        return 1 if re.search(r"dot|\.", span, re.IGNORECASE) else 0
    if kind == "ip":
        return -1 if around[:1] in ".vV" or around[1:2] == "." else 1
    if kind in ("phone_local", "phone_lost", "phone"):
        return 1 if re.search(r"[0-9]{3}-[0-9]{4}$", span) else 0
    return 1 if kind == "ssn" and "." not in around else 0


def _listed(kind: str, span: str, digits: str, lists: Gazetteers) -> int:
    """The gazetteers' vote."""
    if kind in ("email", "email_written"):
        labels = re.split(r"\W+", span.lower().rstrip(")] "))
        return 1 if labels[-1] in lists.suffixes or lists.providers & set(labels) else -1
    if kind in ("phone", "phone_local", "phone_lost"):
        area, office = digits[-10:-7], digits[-7:-4]
        return 1 if len(digits) < 10 or area[:1] >= "2" and area[1:] != "11" and office[:1] >= "2" else -1
    if kind == "ssn":
        return -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
    if kind in ("card", "card_lost", "card_like"):
        return 1 if _issued(digits) else -1
    return 1 if kind == "person" and span.split(" ")[0].lower() in lists.given else 0


def _shaped(kind: str, span: str, digits: str) -> int:
    if kind in ("card", "card_lost", "card_like"):
        return 1 if len(digits) == 16 and len(span) in (16, 19) else 0
    if kind in ("phone", "phone_local", "phone_lost"):
        return 1 if "(" in span or span.count("-") >= 2 else -1 if "." in span else 0
    if kind == "person":
        return 1 if span.count(" ") == 1 else 0
    return 1 if kind in ("email", "ssn", "iban") else 0


def _before(text: str, start: int) -> list[str]:
    """The last words of the 40 characters before a span, in lower case."""
    return [w.lower() for w in _WORDS.findall(text[max(0, start - 40) : start])][-4:]


def votes(text: str, kind: str, start: int, end: int, near: bool, lists: Gazetteers = LISTS) -> tuple[int, ...]:
    """Each labeler's vote on a span: 1 for, -1 against, 0 none."""
    span, before = text[start:end], set(_before(text, start))
    digits, around = _digits(span), text[max(0, start - 1) : start].ljust(1) + text[end : end + 1]
    context = 1 if before & _FOR[_FAMILY[kind]] else -1 if before & _AGAINST else 0
    return _strict(kind, span, digits, around), _listed(kind, span, digits, lists), context, _shaped(kind, span, digits), 1 if near else 0


#: Places of the features: one that is always set, kinds, votes, lengths, first digits, hashed words.
_AT_KIND = 1
_AT_VOTE = _AT_KIND + len(KINDS)
_AT_LENGTH = _AT_VOTE + 3 * len(LABELERS)
_AT_DIGIT = _AT_LENGTH + 8
_AT_WORD = _AT_DIGIT + 11
FEATURES = _AT_WORD + PLACES


def features(text: str, kind: str, start: int, end: int, near: bool, lists: Gazetteers = LISTS) -> list[int]:
    """The places of a span's features, each once."""
    span = text[start:end]
    digits = _digits(span)
    out = {0, _AT_KIND + KINDS.index(kind), _AT_LENGTH + min(7, len(span) // 4), _AT_DIGIT + (int(digits[0]) if digits else 10)}
    out |= {_AT_VOTE + 3 * i + v + 1 for i, v in enumerate(votes(text, kind, start, end, near, lists))}
    after = [w.lower() for w in _WORDS.findall(text[end : end + 30])][:2]
    for side, words in (("<", _before(text, start)), (">", after)):
        out |= {_AT_WORD + zlib.crc32(f"{_FAMILY[kind]}{side}{re.sub('[0-9]', '0', w)}".encode("utf-8", "surrogatepass")) % PLACES for w in words}
    return sorted(out)


def pattern_of(text: str, span: tuple[str, int, int], near: bool, lists: Gazetteers = LISTS) -> int:
    """A span's kind and votes as one number."""
    number = KINDS.index(span[0])
    for v in votes(text, *span, near, lists):
        number = 3 * number + v + 1
    return number


def unpacked(number: int) -> tuple[int, list[int]]:
    """The kind's place and the votes of a pattern."""
    found = []
    for _ in LABELERS:
        number, v = divmod(number, 3)
        found.append(v - 1)
    return number, found[::-1]


def _expected(cast: np.ndarray, weight: np.ndarray, ahead: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors, class priors and reliabilities (class, labeler, vote) of patterns by EM; ``ahead`` are counts of classes and votes had beforehand."""
    post = np.clip(0.5 + 0.2 * (cast - 1).sum(axis=1), 0.05, 0.95)
    for _ in range(EM_ROUNDS):
        classes = np.stack([1 - post, post]) * weight
        prior = classes.sum(axis=1) + ahead[0]
        prior /= prior.sum()
        given = np.stack([[[c[cast[:, j] == v].sum() for v in range(3)] for j in range(len(LABELERS))] for c in classes]) + ahead[1]
        given /= given.sum(axis=2, keepdims=True)
        log = np.log(prior)[:, None] + np.log(given[:, np.arange(len(LABELERS)), cast]).sum(axis=2)
        post = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
    return post, prior, given


def reliabilities(counts: dict[int, int]) -> tuple[dict[int, float], dict[str, np.ndarray]]:
    """Posterior of each pattern, and for each family of kinds how likely each labeler casts each vote (class, labeler, vote), by EM over vote counts.

    All patterns together give the reliabilities that each family's own lean on, by ``LEANING`` counts; a family with many spans goes by these alone.
    """
    patterns = sorted(counts)
    if not patterns:
        return {}, {}
    cast = np.array([unpacked(p)[1] for p in patterns]) + 1
    weight = np.array([counts[p] for p in patterns], float)
    families = np.array([_FAMILY[KINDS[unpacked(p)[0]]] for p in patterns])
    _, prior, given = _expected(cast, weight, (np.ones(2), np.ones((2, len(LABELERS), 3))))
    posteriors, told = {}, {}
    for family in sorted(set(families)):
        own = families == family
        post, _, told[family] = _expected(cast[own], weight[own], (LEANING * prior, LEANING * given))
        posteriors |= dict(zip(np.array(patterns)[own].tolist(), post.tolist()))
    return posteriors, told


def classifier(posteriors: dict[int, float], spans: list[tuple[int, list[int]]], counts: list[int] | None = None) -> np.ndarray:
    """Weights of the span classifier, trained on spans ``(pattern, features)`` by their patterns' posteriors; counts tell how often each span stands for itself."""
    weights = np.zeros(FEATURES + 1)
    if not spans:
        return weights[:-1]
    places = np.full((len(spans), max(len(f) for _, f in spans)), FEATURES)
    for row, (_, own) in enumerate(spans):
        places[row, : len(own)] = own
    y = np.array([posteriors[p] for p, _ in spans])
    share = np.ones(len(spans)) if counts is None else np.array(counts, float)
    share /= share.sum()
    for _ in range(TRAIN_ROUNDS):
        miss = 1 / (1 + np.exp(-weights[places].sum(axis=1))) - y
        step = np.bincount(places.ravel(), np.repeat(miss * share, places.shape[1]), FEATURES + 1)
        weights -= 1.0 * (step + 1e-4 * weights)
        weights[FEATURES] = 0
    return weights[:-1]


def _scan(text: str | None, lists: Gazetteers = LISTS) -> list[tuple[str, int, int, int, list[int]]]:
    base = base_spans(text)
    spans = base + proposed_spans(text, base, lists)
    return [(*s, pattern_of(text, s, near, lists), features(text, *s, near, lists)) for s, near in zip(spans, _near(spans))]


SPANS = "array<struct<kind:string,start:int,end:int,pattern:int,features:array<int>>>"
_FIELDS = ("kind", "start", "end", "pattern", "features")


def _scanned(docs: DataFrame, id_col: str, text_col: str, lists: Gazetteers) -> DataFrame:
    """``(doc_id, found)`` of each row, written to the shared folder."""
    storage.bounded_batches(docs.sparkSession)
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("pattern", pa.int32()), ("features", pa.list_(pa.int32()))]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(_FIELDS, s)) for s in _scan(x, lists)] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, struct)], ["doc_id", "found"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scan, f"doc_id {kind}, found {SPANS}")
    return storage.written(rows, "pii-rows")


def trained(scanned: DataFrame) -> np.ndarray:
    """The span classifier's weights: votes of all spans, features of a bounded sample of them."""
    spans = scanned.select(F.explode("found").alias("s")).select("s.kind", "s.pattern", "s.features")
    counts = {r["pattern"]: r["count"] for r in spans.groupBy("pattern").count().collect()}  # one row for each pattern of votes
    posteriors, _ = reliabilities(counts)
    chosen: list[tuple[int, list[int]]] = []
    often: list[int] = []
    distinct = spans.groupBy("kind", "pattern", "features").agg(F.count("*").alias("n"))
    for some in (F.col("kind").isin(*BASE), ~F.col("kind").isin(*BASE)):
        rows = distinct.where(some).orderBy(F.xxhash64("pattern", "features"), "pattern", "features").limit(SAMPLE).collect()
        chosen += [(r["pattern"], r["features"]) for r in rows]
        often += [r["n"] for r in rows]
    return classifier(posteriors, chosen, often)


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lists: Gazetteers = LISTS) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base, spans)`` of each row; spans are kind:start:end by kind, then start."""
    rows = _scanned(docs, id_col, text_col, lists)
    weights = F.split(F.lit(",".join(map(repr, map(float, trained(rows))))), ",").cast("array<double>")
    bar = float(np.log(THRESHOLD / (1 - THRESHOLD)))
    is_base = lambda s: s["kind"].isin(*BASE)
    likely = lambda s: F.aggregate(s["features"], F.lit(0.0), lambda a, x: a + F.get(weights, x)) >= bar
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    every = F.filter("found", lambda s: is_base(s) | likely(s))
    return rows.select("doc_id", *map(count, BASE), joined(F.filter("found", is_base)).alias("base"), joined(every).alias("spans"))


def redact(text: str | None, weights: np.ndarray, lists: Gazetteers = LISTS) -> str | None:
    """A text with its spans replaced by their kinds; of spans that overlap the union is replaced once."""
    bar = np.log(THRESHOLD / (1 - THRESHOLD))
    spans = sorted((s, e, k) for k, s, e, _, own in _scan(text, lists) if k in BASE or weights[own].sum() >= bar)
    if not spans:
        return text
    out, end = [], 0
    for start, stop, kind in spans:
        if start >= end:
            out += [text[end:start], f"[{kind.upper()}]"]
        end = max(end, stop)
    return "".join(out) + text[end:]


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", lists: Gazetteers = LISTS) -> DataFrame:
    """``docs`` with personal data replaced in the texts, and the texts' lengths set anew where that column exists."""
    scanned = _scanned(docs, id_col, text_col, lists)
    weights = trained(scanned)
    storage.dropped(scanned)
    at, text_type = docs.columns.index(text_col), docs.schema[text_col].dataType

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([redact(x, weights, lists) for x in batch.column(at).to_pylist()], batch.column(at).type)
            yield batch.set_column(at, batch.schema.field(at), texts)

    out = docs.withColumn(text_col, F.col(text_col).cast(text_type)).mapInArrow(replace, docs.schema)
    if length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        out = out.withColumn(length_col, F.coalesce(F.length(text_col).cast(kind), F.col(length_col)))
    return out
