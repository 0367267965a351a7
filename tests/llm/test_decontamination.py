import random

import pytest

from tidemark.llm import decontamination as dc

ITEMS = [
    (1, "A train leaves Boston at 9 km from the old bridge while Mary Jones waits 12 minutes for Mary Jones to call."),
    (2, "the quick brown fox jumps over the lazy dog near a river that runs through seven quiet valleys every spring"),
    (3, "two words"),
    (7, "at first Mary walks to the shop then Mary buys a hat so Mary goes home and Mary sleeps"),
    (4, None),
    (5, ""),
    (6, "the quick brown fox jumps over the lazy dog near a river that runs through seven quiet valleys every spring"),
]


def filler(rng, n):
    return " ".join("".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(n))


def found(spark, docs, items=ITEMS, **more):
    docs = spark.createDataFrame([(d, t, 1, 0.5) for d, t in docs], "doc_id long, text string, item_id int, coverage double").repartition(2)
    items = spark.createDataFrame(items, "item_id long, text string")
    kept = {r["doc_id"] for r in dc.decontaminated(docs, items, **more).collect()}
    rows = dc.contaminations(docs, items, **more).collect()
    assert kept == {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in rows}
    return {(r["doc_id"], r["item_id"]): r for r in rows}


def test_verbatim_changed_and_clean(spark):
    rng = random.Random(1)
    item = ITEMS[0][1]
    changed = item.replace("Boston", "Denver").replace("9", "75").replace("12", "40").replace("Mary Jones", "Ahmed")
    torn = ITEMS[3][1].replace("Mary", "Bob", 1).replace("Mary", "Ann", 1).replace("Mary", "Sue", 1)
    docs = [
        (10, f"{filler(rng, 30)} {item} {filler(rng, 30)}"),
        (11, f"{filler(rng, 30)}. {changed} {filler(rng, 9)}"),
        (12, f"{filler(rng, 30)} {torn}"),
        (13, ITEMS[1][1].upper()),
        (14, " ".join(ITEMS[1][1].split()[:9])),
        (15, f"here are two words {filler(rng, 9)}"),
        (16, None),
        (17, ""),
        (18, filler(rng, 20_000) + " " + ITEMS[1][1] + " " + filler(rng, 20_000)),
        (None, ITEMS[1][1]),
        (19, filler(rng, 400)),
        (20, ITEMS[3][1].replace("Mary", "Bob")),
    ]
    rows = found(spark, docs)
    assert set(rows) == {(10, 1), (11, 1), (13, 2), (13, 6), (15, 3), (18, 2), (18, 6), (20, 7), (None, 2), (None, 6)}
    assert rows[10, 1]["changed_slots"] == 0 and rows[11, 1]["changed_slots"] == 4
    assert rows[11, 1]["coverage"] == 1.0


def plain(items, docs, window=5, similarity=0.8):
    """All pairs, for texts without placeholders: the share of an item's windows that a document holds."""
    out = set()
    for d, text in docs:
        words = text.split()
        for i, item in items:
            own = item.split()
            size = min(window, len(own))
            cut = lambda w: [tuple(w[k : k + size]) for k in range(len(w) - size + 1)]
            have = set(cut(words))
            windows = cut(own)
            if sum(x in have for x in windows) >= similarity * len(windows):
                out.add((d, i))
    return out


@pytest.mark.parametrize("chars", [4 << 20, 0])
def test_matches_all_pairs(spark, monkeypatch, chars):
    if not chars:  # nothing broadcast, a full bit table, one text at a time
        for name, value in (("BROADCAST_CHARS", 0), ("CHUNK_CHARS", 1), ("LEAST_BITS", 6), ("MOST_BITS", 6)):
            monkeypatch.setattr(dc, name, value)
        monkeypatch.setattr(dc.storage, "small", lambda df, rows=0: df)
    rng = random.Random(2)
    items = [(i, filler(rng, rng.randint(3, 40))) for i in range(12)]
    docs = []
    for d in range(120):
        words = filler(rng, rng.randint(1, 60)).split()
        if d % 2:
            part = rng.choice(items)[1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                part[rng.randrange(len(part))] = "edited"
            at = rng.randint(0, len(words))
            words[at:at] = part[: rng.randint(len(part) // 2, len(part))] if d % 3 else part
        docs.append((d, " ".join(words)))
    assert set(found(spark, docs, items)) == plain(items, docs)


def test_common_passage_and_empty_tables(spark):
    docs = [(d, f"intro {d} {ITEMS[1][1]}") for d in range(200)]
    assert set(found(spark, docs)) == {(d, i) for d in range(200) for i in (2, 6)}
    assert found(spark, []) == {}
    assert found(spark, docs, []) == {}


def test_names_at_any_place_and_in_any_case(spark):
    items = [
        (1, "Tom has 5 apples. Tom buys 7 more apples at the market. How many apples does Tom have now?"),
        (2, "What is the capital of France?"),
        (3, "Who wrote Hamlet?"),
    ]
    changed = items[0][1].replace("Tom", "Anna").replace("5", "31").replace("7", "12")
    docs = [
        (1, changed),
        (2, f"Here is a quiz {changed}"),
        (3, f"A Quiz {changed}"),
        (4, "Trivia - What is the capital of France?"),
        (5, "what is the capital of france"),
        (6, "WHAT IS THE CAPITAL OF FRANCE"),
        (7, "Trivia - What is the capital of Spain?"),
        (8, "Trivia - Who wrote Hamlet?"),
        (9, "and who wrote hamlet"),
        (10, "Trivia - Who wrote Macbeth?"),
        (11, "Bob wrote Macbeth. They say Ann wrote Hamlet"),
        (12, "Anna has 5 apples. Bob buys 7 more apples at the market. How many apples does Carl have now?"),
        (13, "what is the capital of spain"),
    ]
    expected = {(1, 1), (2, 1), (3, 1), (4, 2), (5, 2), (6, 2), (7, 2), (8, 3), (9, 3), (10, 3)}
    assert set(found(spark, docs, items)) == expected


def test_texts_of_a_chunk_stay_apart():
    texts = ["Mary Jones", None, "Bob went home. - Ann", "", "Sue paid 5km to", "x " * 7, "- Carl"]
    whole = dc.Template(texts, dc.Words())
    for sizes in ([1], [2], [3, 5]):
        apart = [(n, t, s, h) for n, x in enumerate(texts) for t, s, _, hashes in dc.Template(x, dc.Words()).hashed(sizes) for h in hashes.tolist()]
        assert sorted(apart) == sorted((n, t, s, h) for t, s, own, hashes in whole.hashed(sizes) for n, h in zip(own.tolist(), hashes.tolist()))


#: A question in each language with two numbers, a unit and a name, and clean prose with the same function words.
QUESTIONS = {
    1: "Ein Bauer namens {name} verkauft am Morgen {a} Kisten Äpfel auf dem Markt und am Nachmittag noch {b} weitere, wie viele Kisten hat {name} an diesem Tag verkauft?",
    2: "Un train part de la gare à midi avec {name} et roule {a} {unit} avant de tourner vers le nord pendant {b} minutes, quand est-ce que {name} arrive?",
    3: "En la tienda de la esquina {name} compra {a} manzanas rojas y luego regala {b} a sus primos, cuántas manzanas le quedan a {name} al final del día?",
    4: "On a rainy evening {name} pours {a} {unit} of water into the tall blue tank and then drains {b} before lunch, how much water does {name} have left?",
}
CLEAN = [
    "Der alte Müller ging am Morgen auf den Markt und sah dort viele Kisten, aber am Nachmittag war der Platz leer und das Wetter wurde schlecht.",
    "Le train de la gare est parti avant midi et la pluie tombait sur le nord de la ville quand les voyageurs sont sortis avec leurs valises.",
    "La tienda de la esquina vende manzanas rojas y el dueño regala dulces a los niños del barrio al final del día cuando cierra.",
    "On a rainy evening the tall blue tank was full of water and nobody wanted to drain it before lunch because the pump was broken.",
]


@pytest.mark.parametrize("seed", [1, 2])
def test_reparameterised_questions_of_four_languages(spark, seed):
    rng = random.Random(seed)
    names = ["Anna", "Bruno", "Chloé", "Diego", "Erik", "Fátima", "Jürgen Maier", "Zoë"]
    made = lambda q: QUESTIONS[q].format(name=rng.choice(names), a=rng.randint(2, 900), b=rng.randint(2, 900), unit=rng.choice(["km", "miles", "l", "gallons"]))
    items = [(q, made(q)) for q in QUESTIONS]
    docs = [(100 * q + i, f"{filler(rng, rng.randint(0, 30))}. {made(q)} {filler(rng, 20)}") for q in QUESTIONS for i in range(8)]
    torn = [(1000 + q, QUESTIONS[q].replace("{name}", "Otto", 1).format(name="Ida", a=1, b=2, unit="km").replace("Ida", "Uwe", 0)) for q in QUESTIONS]
    clean = [(2000 + i, f"{x} {filler(rng, 20)}") for i, x in enumerate(CLEAN)]
    rows = found(spark, docs + clean + torn, items)
    assert {k for k in rows if k[0] < 1000} == {(d, d // 100) for d, _ in docs}
    assert not {d for d, _ in rows} & {d for d, _ in clean}
    assert any(r["changed_slots"] for r in rows.values())


def test_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame([(1, ITEMS[1][1], "a", 1), (2, "clean text here", "b", 2), (2, "clean text here", "b", 2), (None, None, "c", 3)], "doc_id long, text string, doc string, gone int")
    kept = dc.decontaminated(docs, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=str) == [(2, "clean text here", "b", 2)] * 2 + [(None, None, "c", 3)]


def test_verbatim_copies_behind_capitalised_words(spark):
    """A run of names that swallows the words before or behind the item changes no slot; another name does."""
    items = [(1, "Mary Jones has 9 apples in the old basket near the green gate and waits for her friend Tom Brown")]
    text = items[0][1]
    docs = [(1, f"Lorem Ipsum {text} Dolor Sit."), (2, f"see Chapter {text}"), (3, text), (4, f"Lorem Ipsum {text.replace('Mary Jones', 'Anna Smith')}"), (5, text.replace("9", "14") + " Dolor"), (6, f"Lorem {text.replace('Tom Brown', 'Bob White')} Dolor")]
    rows = found(spark, docs, items)
    assert {d: (r["coverage"], r["changed_slots"]) for (d, _), r in rows.items()} == {1: (1.0, 0), 2: (1.0, 0), 3: (1.0, 0), 4: (1.0, 1), 5: (1.0, 1), 6: (1.0, 1)}


def test_windows_that_many_items_share_bring_nobody_together(spark):
    """Items that begin alike: a document with the common beginning alone meets none of them; those that are there are found."""
    rng = random.Random(8)
    common = "please answer the following question as well as you can and show every step of your work"
    items = [(i, f"{common} {filler(rng, 12)}") for i in range(60)]
    windows = dc.item_windows(spark.createDataFrame([(i, t) for i, t in items], "item int, text string"), dc.WINDOW, dc.SIMILARITY).cache()
    chosen = dc.rarest(windows, dc.SIMILARITY)
    assert chosen.select("item").distinct().count() == 60 and chosen.groupBy("hash", "typing").agg({"item": "count"}).agg({"count(item)": "max"}).first()[0] == 1
    docs = [(d, f"{filler(rng, 20)} {common} {filler(rng, 20)}") for d in range(50)] + [(100 + i, f"{filler(rng, 5)} {t}") for i, t in items]
    assert set(found(spark, docs, items)) == {(100 + i, i) for i, _ in items}
