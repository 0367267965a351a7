import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import language_id as li

LETTERS = {"de": "abdeghinrstuäöüß", "fr": "aceilmnoprstuéèêç", "es": "aceilmnoprsuñóí"}


def words(rng, lang, n):
    return " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(rng.randint(2, 7))) for _ in range(n))


def corpus():
    rng = random.Random(3)
    rows = []
    for i in range(150):
        lang = rng.choice(list(LETTERS))
        host = rng.choice([f"www.{lang}{i % 3}.example", "m.mixed.example", None])
        suffix = rng.choice([lang, "com", None])
        told = lang if rng.random() < 0.8 else rng.choice(["de-AT", "FR", "xx", None, "", " es_MX"])
        rows.append((i, words(rng, lang, rng.choice([0, 1, 2, 5, 40])), told, suffix, host, "clash"))
    rows += [(None, "12 34 %% --", "de", "de", "x", "c"), (500, None, "fr", None, None, "c"), (501, "漢字" * 500, None, "com", "y", "c"), (501, "é" * 60_000, "fr", "fr", "y", "c")]
    return rows


SCHEMA = "doc_id long, text string, lang string, suffix string, host string, accepted string"


def evidence():
    return li.Evidence(F.col("lang"), F.col("suffix"), F.col("host"))


def plain(rows, least):
    """The same model, row by row."""
    def subtag(x):
        x = (x or "").strip().replace("_", "-").split("-")[0].lower()
        return x if x.isascii() and x.isalpha() and 2 <= len(x) <= 8 else None

    declared = [subtag(r[2]) for r in rows]
    names = sorted(k for k, n in Counter(d for d in declared if d).items() if n >= least)
    counts = {x: Counter() for x in names}
    for r, d in zip(rows, declared):
        if d in counts:
            counts[d].update(li.trigrams(r[1]).tolist())
    sums = {x: sum(c.values()) + li.SMOOTHING * li.BUCKETS for x, c in counts.items()}
    text = []
    for r in rows:
        grams = li.trigrams(r[1]).tolist()
        text.append([sum(math.log((counts[x][g] + li.SMOOTHING) / sums[x]) for g in grams) for x in names] if grams else None)
    told = [names[t.index(max(t))] if t else None for t in text]
    vec = lambda pairs: {k: [sum(1 for a, b in pairs if a == k and b == x) for x in names] for k in {a for a, _ in pairs}}
    seen = [(r, d, t) for r, d, t in zip(rows, declared, told) if t]
    every = [sum(t == x for _, _, t in seen) for x in names]
    overall = [(n + 1) / (sum(every) + len(names)) for n in every]
    hosts, suffixes = vec([(r[4], t) for r, _, t in seen if r[4]]), vec([(r[3], t) for r, _, t in seen if r[3]])
    by_name = vec([(d, t) for _, d, t in seen if d in names])
    said = [sum(v[i] for v in by_name.values()) for i in range(len(names))]
    domains = defaultdict(lambda: [0] * len(names))
    dom = lambda h: ".".join(h.split(".")[-2:])
    for h, v in hosts.items():
        domains[dom(h)] = [a + b for a, b in zip(domains[dom(h)], v)]
    share = lambda n, up: [(x + 5 * p) / (sum(n) + 5) for x, p in zip(n, up)]
    out = []
    for r, d, t, s in zip(rows, declared, told, text):
        grams = len(li.trigrams(r[1]))
        post = [x / 3 for x in s] if s else [0.0] * len(names)
        prior = share(hosts[r[4]], share(domains[dom(r[4])], overall)) if r[4] in hosts else overall
        post = [a + math.log(b) for a, b in zip(post, prior)]
        if r[3] in suffixes:
            n = suffixes[r[3]]
            q = (sum(n) + 1) / (sum(every) + 1)
            post = [a + math.log((x + 5 * q) / (m + 5)) for a, x, m in zip(post, n, every)]
        if d in by_name:
            n = by_name[d]
            q = (sum(n) + 1) / (sum(said) + len(names))
            post = [a + math.log((x + 5 * q) / (m + 5)) for a, x, m in zip(post, n, said)]
        top = max(post)
        conf = 1 / sum(math.exp(x - top) for x in post)
        best = names[s.index(max(s))] if s else None
        likely = sum((counts[best][g] + li.SMOOTHING) / sums[best] >= 1 / li.BUCKETS for g in li.trigrams(r[1]).tolist()) if s else 0
        chance = sum((counts[best][b] + li.SMOOTHING) / sums[best] >= 1 / li.BUCKETS for b in range(li.BUCKETS)) / li.BUCKETS if s else 0
        ok = bool(grams) and likely >= (li.LIKELY_SHARE + (1 - li.LIKELY_SHARE) * chance) * grams and conf >= li.CONFIDENCE
        out.append((r[0], names[post.index(top)], round(conf, 6), t, d, ok))
    return out


def test_matches_row_by_row_model(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = [(r["doc_id"], r["lang"], round(r["confidence"], 6), r["text_lang"], r["declared"], r["accepted"]) for r in li.identified(docs, evidence(), least_rows=10).collect()]
    assert sorted(found, key=str) == sorted(plain(rows, 10), key=str)
    kept = li.accepted(docs, evidence(), least_rows=10)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == sorted((str(r[0]), r[1]) for r, p in zip(rows, plain(rows, 10)) if p[5])


def test_what_is_no_language_goes(spark):
    rng = random.Random(6)
    rows = [(i, words(rng, lang, 60), lang, None, f"h{i % 7}", "c") for i, lang in enumerate(rng.choice(list(LETTERS)) for _ in range(400))]
    digits = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/"
    junk = [
        "".join(rng.choice(digits) for _ in range(4_000)), " ".join("".join(rng.choice("zxqjkvwy") for _ in range(12)) for _ in range(80)), "0 1 2 3 " * 400, "*** --- %%%", "", None,
        " ".join("".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(6)) for _ in range(200)), "<<<>>>" * 500,
    ]
    rows += [(1_000 + i, text, None, None, "h1", "c") for i, text in enumerate(junk)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r["doc_id"] for r in li.accepted(docs, evidence()).collect()) == list(range(400))


def test_clashing_names_and_few_columns(spark):
    rng = random.Random(2)
    given = [(words(rng, "de", 20), "de", i, "s") for i in range(20)] + [("..", "de", 99, "s")]
    docs = spark.createDataFrame(given, "text string, lang string, _li_text_log int, kept string").withColumn("none", F.create_map(F.lit("a"), F.lit(1)))
    of = li.Evidence(F.col("lang"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    kept = li.accepted(docs, of)
    assert kept.columns == docs.columns and sorted(r["_li_text_log"] for r in kept.collect()) == list(range(20))
    assert li.accepted(docs.select("text"), li.Evidence(*[F.lit(None).cast("string")] * 3)).count() == 20


def test_evidence_by_shuffled_joins(spark, monkeypatch):
    monkeypatch.setattr(li, "BROADCAST_SCORES", 0)
    test_matches_row_by_row_model(spark)


def test_held_out_accuracy(spark):
    rng = random.Random(9)
    rows = [(i, words(rng, lang, 30), lang if i % 2 else None, None, None, "c") for i, lang in enumerate(rng.choice(list(LETTERS)) for _ in range(300))]
    langs = {r[0]: max(LETTERS, key=lambda x: sum(c in LETTERS[x] for c in r[1])) for r in rows}
    found = li.identified(spark.createDataFrame(rows, SCHEMA), evidence()).where("declared is null").collect()
    assert sum(r["lang"] == langs[r["doc_id"]] for r in found) / len(found) > 0.95


@pytest.mark.parametrize("rows", [[], [(1, "some text", None, None, None, "c"), (2, "..", None, None, None, "c")]])
def test_no_language_is_known(spark, rows):
    found = li.identified(spark.createDataFrame(rows, SCHEMA), evidence()).collect()
    assert [(r["doc_id"], r["lang"], r["accepted"]) for r in sorted(found)] == [(1, None, True), (2, None, False)][: len(rows)]


def test_page_evidence(spark):
    page = '<!doctype html><HTML class=a lang="pt-BR"><script>x="<b>"</script><p>ol&aacute; mundo</p><!-- no --></html>'
    pages = spark.createDataFrame([("https://u@www.a.example.ORG:80/x", page), (None, None)], "url string, html string")
    e = li.of_pages()
    rows = pages.select(e.declared.alias("d"), e.suffix.alias("s"), e.host.alias("h"), F.trim(li.page_text(F.col("html"))).alias("t")).collect()
    assert rows[0]["d"] == "pt-BR" and rows[0]["h"] == "www.a.example.ORG" and rows[0]["t"].split() == ["ol", "mundo"]
    assert rows[1]["t"] is None


@pytest.mark.parametrize("dense", [1, 2])
def test_rare_languages_match_row_by_row_model(spark, monkeypatch, dense):
    monkeypatch.setattr(li, "LANGUAGES", dense)
    test_matches_row_by_row_model(spark)


def test_every_declared_language_stays(spark):
    rng = random.Random(4)
    signs = [chr(x) for x in (*range(0x61, 0x7B), *range(0xE0, 0xF7), *range(0x3B1, 0x3CA), *range(0x430, 0x450))]
    rows = []
    for i in range(80):
        own = rng.sample(signs, 8)
        for _ in range(2 if i > 60 else 4):
            text = " ".join("".join(rng.choice(own) for _ in range(rng.randint(2, 7))) for _ in range(60))
            rows.append((len(rows), text, f"{chr(97 + i // 26)}{chr(97 + i % 26)}", None, f"h{i % 9}.example", "c"))
    docs = spark.createDataFrame(rows, SCHEMA)
    found = li.identified(docs, evidence()).collect()
    assert all(r["accepted"] and r["lang"] == r["text_lang"] == r["declared"] for r in found) and len(found) == len(rows)
    assert li.accepted(docs, evidence()).count() == len(rows)


def test_junk_declarations_share_one_model(spark, monkeypatch):
    """Beyond the most languages all subtags are one: their rows keep what they declare and aren't rejected, the others are told as before."""
    monkeypatch.setattr(li, "MOST_LANGUAGES", 2)
    words = {"en": "the house and the river with that stone", "de": "das haus und der fluss mit dem stein"}
    rows = [(i, " ".join([words[x]] * 4), x) for i, x in enumerate(["en", "de"] * 40)]
    rows += [(100 + i, f"zqx vrk {'jjy wuu ' * 12} kpl", f"q{chr(97 + i)}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("s"))
    found = {r.doc_id: r for r in li.identified(docs, li.of_documents()).collect()}
    assert all(found[i].lang == x and found[i].declared == x and found[i].accepted for i, _, x in rows)
    models = li.text_models(li._pooled(li._prepared(docs, [], "text", li.of_documents())))
    assert models.names == ["*", "de", "en"]
