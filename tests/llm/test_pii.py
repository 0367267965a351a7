import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    odd = [int(x) for x in digits[::-1]]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(odd)) % 10 == 0


def plain_base(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".") if kind == "ip"), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}
            if good[kind]:
                out.append((kind, *m.span()))
    return out


def texts():
    rng = random.Random(7)
    parts = ["a.b", "x@y", "@", ".", "..", "com", "-", "12", "255", "256", "1.2.3.4", "0001.2.3.004", "+1", "+49 (30) 123-4567", "(", ")", " ", "4111 1111 1111 1111", "4111111111111111", "5500-0000-0000-0004", "é", "\n", "%", "٣", "555-123-4567", "123-45-6789", "bob (at) site (dot) com"]
    fixed = [None, "", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "a@b@c.d", "x@y..z", "9" * 30, "a@b-.c.", "+1((((((2"]
    return fixed + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(1500)]


def test_base_spans_match_plain_patterns():
    for text in texts():
        assert pii.base_spans(text) == plain_base(text), text


def test_long_texts_take_linear_time():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 100_000, "a@" * 100_000, "+1" * 100_000, "1.2.3.4 " * 20_000, "a" * 100_000 + " (at) b"):
        assert pii._scan(text) is not None


def test_report_and_empty_table(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i if i else None, t, "c", 1) for i, t in rows], "doc_id long, text string, spans string, found int").repartition(3)
    found = {r["doc_id"] or 0: r for r in pii.personal_spans(docs).collect()}
    for i, text in rows:
        base = plain_base(text)
        assert found[i]["base"] == ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert [found[i][f"n_{k}"] for k in pii.BASE] == [sum(x[0] == k for x in base) for k in pii.BASE]
        assert set(found[i]["base"].split(",")) - {""} <= set(found[i]["spans"].split(","))
    assert pii.personal_spans(docs.limit(0)).collect() == []


def people(rng):
    phone = lambda: f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    serial = lambda: f"{rng.randint(100, 199)}.{rng.randint(100, 199)}.{rng.randint(1000, 9999)}"
    texts, truth = [], []
    for i in range(600):
        if i % 2:
            texts.append(f"please call {phone()} or mail u{i}@mail.example.com about it")
        else:
            texts.append(f"see order version {serial()} in the table of parts")
        truth.append(bool(i % 2))
    return texts, truth


def test_votes_separate_people_from_serial_numbers(spark):
    texts, truth = people(random.Random(1))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = {r["doc_id"]: "phone_local" in r["spans"] for r in pii.personal_spans(docs).collect()}
    assert sum(found[i] == t for i, t in enumerate(truth)) / len(truth) > 0.97


def planted(rng, n):
    """Texts of one span each, and its kind where it is personal data."""
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    phone = lambda: f"({rng.randint(2, 9)}{rng.choice('02345')}{digits(1)}) {rng.randint(2, 9)}{digits(2)}-{digits(4)}"
    ssn = lambda: f"{rng.randint(100, 650)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}"
    filler = lambda: " ".join(rng.choice("the of running under blue several table quiet".split()) for _ in range(rng.randint(0, 12)))
    good = [
        lambda: ("phone_local", f"you may call {phone()} tonight"), lambda: ("ssn", f"the SSN {ssn()} is on file"), lambda: ("email_written", f"mail bob{digits(2)} [at] gmail [dot] com please"),
        lambda: ("person", f"regards from {rng.choice(['Maria', 'Stefan', 'Pierre'])} {rng.choice(['Kowalska', 'Lindner', 'Moreau'])} again"), lambda: ("iban", "pay to account DE89 3704 0044 0532 0130 00 now"),
        lambda: ("phone_lost", f"call +1 (415) 555-{digits(4)} 93.184.216.34 {digits(9)} or so"),
    ]
    bad = [
        lambda: f"see order {rng.randint(100, 199)}.{digits(3)}.{digits(4)} in part", lambda: f"invoice 000-{digits(2)}-{digits(4)} was paid", lambda: f"serial 9{digits(2)}-{digits(2)}-{digits(4)} broke",
        lambda: f"value 9{digits(14)}{rng.choice('123')} seen", lambda: "section AB12 ABCD EFGH IJKL MNOP ends",
    ]
    out = []
    for i in range(n):
        kind, text = rng.choice(good)() if i % 2 else (None, rng.choice(bad)())
        out.append((i, f"{filler()} {text} {filler()}", kind))
    return out


def test_proposals_are_kept_and_refused(spark):
    rows = planted(random.Random(5), 1200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id int, text string")
    found = {r["doc_id"]: {x.split(":")[0] for x in r["spans"].split(",") if x} - set(pii.BASE) for r in pii.personal_spans(docs).collect()}
    told = [(kind, found[i]) for i, _, kind in rows]
    hits = sum(kind in got for kind, got in told if kind)
    recall, precision = hits / sum(kind is not None for kind, _ in told), hits / max(1, sum(bool(got) for _, got in told))
    assert recall > 0.9 and precision > 0.9, (recall, precision)
    assert {k for k, _ in told if k} == {k for k, got in told if k in got}  # every kind is kept somewhere
    proposed = sum(bool(pii.proposed_spans(t, pii.base_spans(t))) for _, t, kind in rows if not kind)
    assert proposed > 300 and sum(bool(got) for kind, got in told if not kind) < 0.1 * proposed  # and most of the others were refused
    redacted = {r["doc_id"]: r["text"] for r in pii.redacted(docs).collect()}
    assert all((f"[{k.upper()}]" in redacted[i]) == (k in found[i]) for i, _, k in rows if k)


def test_words_around_decide_where_votes_are_alike():
    rng, spans = random.Random(3), []
    for _ in range(400):
        good = rng.random() < 0.5
        text = f"xx {'kindly' if good else 'widget'} 212-555-{rng.randint(1000, 9999)} yy"
        at = text.index("212")
        spans.append((1 if good else 0, pii.features(text, "phone_local", at, at + 12, False)))
    weights = pii.classifier({1: 0.9, 0: 0.1}, spans[:300])
    assert all((weights[f].sum() > 0) == (p == 1) for p, f in spans[300:])


def test_base_columns_are_the_sqls(spark):
    from tests.oracle import compare
    from tidemark.llm import queries

    assert compare(queries.pii_base(spark, "/root/testdata/sf0.01"), queries.oracle_sql()["pii_base"], "/root/testdata/sf0.01") == ""


def test_labelers_get_their_reliabilities():
    rng, counts = random.Random(2), {}
    for _ in range(20_000):
        real, number = rng.random() < 0.5, 4
        for good in (0.95, 0.9, 0.85, 0.6, 0.5):
            number = 3 * number + (2 if (rng.random() < good) == real else 0)
        counts[number] = counts.get(number, 0) + 1
    _, given = pii.reliabilities(counts)
    given = given["email"]
    learned = [(given[1][j][2] + given[0][j][0]) / 2 for j in range(5)]
    assert all(abs(a - b) < 0.04 for a, b in zip(learned, (0.95, 0.9, 0.85, 0.6, 0.5)))


def test_redaction_takes_effect(spark):
    rows = [(1, "mail bob@x.com now", "en", 18), (2, None, "en", 0), (3, "clean", "en", 5), (None, "1.2.3.4 and 4111 1111 1111 1111", "en", 31)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    found = pii.redacted(docs)
    assert found.columns == docs.columns
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(1, "mail [EMAIL] now", "en", 16), (2, None, "en", 0), (3, "clean", "en", 5), (None, "[IP] and [CARD]", "en", 15)], key=str)


def test_reliabilities_differ_by_family():
    """A labeler that is right on one kind and wrong on another gets two reliabilities; the classes' shares differ as well."""
    rng, counts = random.Random(9), {}
    for kind, share, rates in (("email_written", 0.9, (0.95, 0.9, 0.9, 0.9, 0.1)), ("phone_local", 0.2, (0.95, 0.9, 0.9, 0.1, 0.9))):
        for _ in range(10_000):
            real, number = rng.random() < share, pii.KINDS.index(kind)
            for good in rates:
                number = 3 * number + (2 if (rng.random() < good) == real else 0)
            counts[number] = counts.get(number, 0) + 1
    posteriors, given = pii.reliabilities(counts)
    learned = {f: [(given[f][1][j][2] + given[f][0][j][0]) / 2 for j in range(5)] for f in given}
    assert all(abs(a - b) < 0.08 for f, want in (("email", (0.95, 0.9, 0.9, 0.9, 0.1)), ("phone", (0.95, 0.9, 0.9, 0.1, 0.9))) for a, b in zip(learned[f], want)), learned
    share = lambda f: sum(counts[p] * q for p, q in posteriors.items() if pii._FAMILY[pii.KINDS[pii.unpacked(p)[0]]] == f) / 10_000
    assert abs(share("email") - 0.9) < 0.03 and abs(share("phone") - 0.2) < 0.03


def test_repeats_do_not_crowd_the_sample(spark, monkeypatch):
    """Fifteen kinds of span, most of them thousands of times: all are in a sample of twenty."""
    monkeypatch.setattr(pii, "SAMPLE", 20)
    rows = [("email", 1, [0, i]) for i in range(15) for _ in range(2_000 if i % 3 else 1)]
    found = spark.createDataFrame(rows, "kind string, pattern int, features array<int>")
    scanned = found.select(F.array(F.struct("kind", "pattern", "features")).alias("found"))
    seen = {}
    monkeypatch.setattr(pii, "classifier", lambda posteriors, spans, counts: seen.update(spans=spans, counts=counts))
    pii.trained(scanned)
    assert sorted(f[1] for _, f in seen["spans"]) == list(range(15)) and sorted(set(seen["counts"])) == [1, 2_000]


def test_gazetteers_from_a_table(spark):
    table = spark.createDataFrame([("given", "Xaver"), ("given", "xaver"), ("given", None), ("providers", "mailhaus")], "list string, entry string")
    lists = pii.Gazetteers.of(table)
    assert lists.given == {"xaver"} and lists.providers == {"mailhaus"} and lists.suffixes == pii.LISTS.suffixes
    text = "regards from Xaver Lindner and Maria Moreau"
    assert [text[s:e] for k, s, e in pii.proposed_spans(text, [], lists)] == ["Xaver Lindner"]
    many = lists._replace(given=frozenset(f"name{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)) | {"xaver"})
    assert pii.proposed_spans(text, [], many) == pii.proposed_spans(text, [], lists)
    for bad in ([("names", "x")],):
        with pytest.raises(ValueError):
            pii.Gazetteers.of(spark.createDataFrame(bad, "list string, entry string"))
    docs = spark.createDataFrame([(1, f"mr {text[13:26]}")], "doc_id long, text string")
    assert len(pii.personal_spans(docs, lists=lists).collect()) == 1
