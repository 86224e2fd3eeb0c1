"""Operators that learn from the corpus: markup, categories, sentence ends, mentions."""

import math
import random
import time
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from namesift.operators import boundaries, categories, markup, mentions, tagger

# ---- markup -------------------------------------------------------------------


@pytest.mark.parametrize(
    "page",
    [
        '<a class="result" href="/x">T</a>',
        "<A HREF='/x' title='a > b' CLASS='wide result big'>T</A>",
        "<a\n\thref=/x class=result>T",
        '<a data-a="class=&quot;no&quot;" class = "result" href = "/x" disabled>T</a>',
        '<script>"<a class=\'result\' href=\'/no\'>"</script><!-- <a class="result" href="/no"> --><a href="/x" class="result">T</a>',
        '<a class="other" href="/no">N</a><a class="result" href="/x">T</a>',
        '<abbr class="result" href="/no"></abbr><a class="result" href="/x" href="/second">T</a>',
        '< a class="result" href="/no">no</a><a class="result" href="/x"> T </a>',
    ],
)
def test_links_by_class_in_any_writing(page):
    assert [(a["href"], text) for a, text in markup.elements(page, markup.Selector("a", frozenset(["result"])))] == [("/x", "T")]


def test_selectors_and_titles():
    page = '<title>A &amp; <b>B</title><input type="text"><input name="q" type=hidden><p class="a b">one</p><p class="b">two'
    first = lambda s, n=None: markup.elements(page, s, n)
    assert first(markup.Selector("title"))[0][1] == "A & <b>B"
    assert len(first(markup.Selector("input", attributes={"type": None}))) == 2
    assert first(markup.Selector("input", attributes={"type": "hidden"}))[0][0]["name"] == "q"
    assert [t for _, t in first(markup.Selector("p", frozenset("b")))] == ["one", "two"]
    assert [t for _, t in first(markup.Selector("p"), 1)] == ["one"]
    assert markup.elements(None, markup.Selector()) == markup.elements("", markup.Selector()) == markup.elements("<", markup.Selector()) == []


@pytest.mark.parametrize("piece", ["<", "<a ", "<a href='", "<!--", "<a b=c ", "</", "<div>", "<script>", "_", "<a x=\"y\" "])
def test_hostile_pages_take_time_that_grows_with_their_length(piece):
    start = time.perf_counter()
    markup.elements(piece * 100_000, markup.Selector())
    assert time.perf_counter() - start < 8


def test_selected_rows(spark):
    pages = spark.createDataFrame([(1, '<a class=r href=1>x</a>' * 3), (2, None), (3, "none"), (1, "<a class=r>y</a>")], "page_id long, html string")
    assert sorted(map(tuple, markup.links_by_class(pages, "r", 2).collect())) == [(1, 0, "1", "x"), (1, 1, "1", "x")]
    assert sorted(r["id"] for r in markup.page_titles(pages).collect()) == [1, 2, 3]


# ---- categories ------------------------------------------------------------------


def test_categories_agree_with_plain_sums(spark):
    rng = random.Random(4)
    vocabulary = {"a": ["red", "rose", "sun", "the"], "b": ["blue", "sea", "ship", "the"], "c": ["moon", "owl", "the"]}
    rows = [(i, " ".join(rng.choices(vocabulary[c], k=rng.randrange(0, 9))), c) for i in range(300) for c in [rng.choice("abc")]]
    rows += [(900, None, "a"), (901, "red sun", None), (902, "", "b"), (903, "never seen words", None)]
    docs = spark.createDataFrame(rows, "id int, text string, gold string")
    held = F.col("id") % 4 == 0
    model = categories.learn(docs, "id", "text", "gold", held)
    import hashlib

    slot = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:4], 16)
    taught = [(t, c) for i, t, c in rows if t is not None and c and i % 4]
    texts, words = Counter(c for _, c in taught), Counter((c, slot(w)) for t, c in taught for w in t.split())
    total = {c: sum(n for (x, _), n in words.items() if x == c) for c in texts}
    unit = lambda x: round(math.log(x) * 1e6)

    def lead(text):
        w = (text or "").split()
        units = []
        for c in sorted(texts):
            low = unit(1 / (total[c] + 65536))
            units.append((unit(texts[c] / sum(texts.values())) + len(w) * low + sum(unit((words[c, slot(x)] + 1) / (total[c] + 65536)) - low for x in w), c))
        units.sort(key=lambda u: (-u[0], u[1]))
        return units[0][1], min(19, (units[0][0] - units[1][0]) // (len(w) * 50_000)) if w else -1

    seen = Counter()
    for i, t, c in rows:
        if t is not None and c and i % 4 == 0:
            best, k = lead(t)
            seen[k] += 1
            seen[k, "right"] += best == c
    expected = {}
    for i, t, _ in rows:
        best, k = lead(t)
        p = (seen[k, "right"] + 1) / (seen[k] + 2) if k >= 0 and seen[k] else 0
        expected[i] = (best if p >= 0.5 else "Unknown", pytest.approx(p, abs=1e-6))
    out = {r["id"]: (r["answer"], r["probability"]) for r in categories.classify(docs, "id", "text", model).collect()}
    assert out == expected


def test_categories_without_labels(spark):
    docs = spark.createDataFrame([(1, "x", None)], "id int, text string, gold string")
    model = categories.learn(docs, "id", "text", "gold", F.lit(False))
    assert [tuple(r) for r in categories.classify(docs, "id", "text", model).collect()] == [(1, "Unknown", 0.0)]
    answers = spark.createDataFrame([("a",), ("z",)], "answer string")
    assert [r[0] for r in categories.kept_categories(answers, "answer", ["a"]).collect()] == ["a", "Unknown"]


def test_categories_of_held_out_documents_are_right(spark):
    from catalog.queries import QUERIES

    sf_dir = "/root/testdata/sf0.01"
    gold = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held = [r for r in QUERIES["classify_trained"](spark, sf_dir).collect() if r["held_out"]]
    answered = [r for r in held if r["answer"] != "Unknown"]
    assert len(answered) > 0.9 * len(held) and sum(r["answer"] == gold[r["id"]] for r in answered) > 0.95 * len(answered)


# ---- sentence ends -----------------------------------------------------------------


WORDS = {
    "en": ("late train river stone green paper window garden morning letter", "approx."),
    "de": ("zug fluss stein papier fenster garten morgen brief haus strasse", "bzw."),
    "fr": ("gare rivière pierre papier fenêtre jardin matin lettre maison rue", "env."),
    "es": ("tren río piedra papel ventana jardín mañana carta casa calle", "sra."),
}


def test_abbreviations_are_found_and_end_no_sentence(spark):
    rng, rows = random.Random(9), {}
    for lang, (words, short) in WORDS.items():
        for k in range(20):
            sentences = []
            for _ in range(12):
                w = rng.choices(words.split(), k=rng.randrange(3, 9))
                if rng.random() < 0.5:
                    w.insert(rng.randrange(1, len(w)), short)
                sentences.append(" ".join(w) + rng.choice([".", ".", "!", "?"]))
            rows[f"{lang}{k}"] = sentences
    docs = spark.createDataFrame([(k, rng.choice([" ", "\n", "  "]).join(v)) for k, v in rows.items()], "id string, text string")
    found = boundaries.abbreviations(boundaries.word_points(docs).cache())
    assert {r["type"] for r in found.collect()} == {"approx", "bzw", "env", "sra"}
    out = {}
    for r in boundaries.split_sentences(docs, found).collect():
        out.setdefault(r["id"], []).append((r["pos"], r["sentence"]))
    assert {k: [s for _, s in sorted(v)] for k, v in out.items()} == rows


def test_initials_blank_texts_and_no_points(spark):
    docs = spark.createDataFrame([(1, "By J. Doe.  Next one.\nLast"), (2, ""), (3, None), (4, " \n "), (5, "no points at all")], "id int, text string")
    none = boundaries.abbreviations(boundaries.word_points(docs.filter("id = 5")))
    assert none.count() == 0
    out = sorted(map(tuple, boundaries.split_sentences(docs, none).collect()))
    assert out == [(1, 0, "By J. Doe."), (1, 1, "Next one."), (1, 2, "Last"), (5, 0, "no points at all")]


# ---- mentions ----------------------------------------------------------------------


def random_model(seed=0):
    rng, model = np.random.default_rng(seed), tagger.Model.empty(["A", "B"])
    model.own[:] = rng.normal(0, 1, model.own.shape)
    model.pairs[:] = rng.normal(0, 1, model.pairs.shape)
    model.scale = 0.7
    return model


def test_decoding_and_probabilities_agree_with_all_label_paths():
    model, words = random_model(), ["Old", "river", "7", "river"]
    score, stop = model.scores(tagger.word_features(words)), model.allowed()
    weight = {}
    for path in product(range(len(model.labels)), repeat=len(words)):
        steps = list(zip((-1, *path), path))
        if all(np.isfinite(stop[a, b]) for a, b in steps):
            weight[path] = sum(score[i, p] for i, p in enumerate(path)) + sum(model.pairs[a, b] for a, b in steps)
    assert tuple(model.decode(score).tolist()) == max(weight, key=weight.get)
    odds = {p: math.exp(model.scale * w) for p, w in weight.items()}
    path = max(weight, key=weight.get)
    assert model.log_likelihood(tagger.word_features(words), np.array(path)) == pytest.approx(math.log(odds[path] / sum(odds.values())))

    def same(p, i, j, kind):
        names = [model.labels[k] for k in p]
        return names[i] == "B-" + kind and all(x == "I-" + kind for x in names[i + 1 : j]) and (j == len(p) or names[j] != "I-" + kind)

    for seed in range(6):
        model = random_model(seed)
        model.scale = 1.0
        score = model.scores(tagger.word_features(words))
        odds = {p: math.exp(sum(score[i, x] for i, x in enumerate(p)) + sum(model.pairs[a, b] for a, b in zip((-1, *p), p))) for p in weight}
        for i, j, kind, p in model.spans(words):
            assert p == pytest.approx(sum(w for q, w in odds.items() if same(q, i, j, kind)) / sum(odds.values()))


def test_no_inside_without_a_beginning():
    model = random_model(3)
    for n in (1, 5, 40):
        names = [model.labels[k] for k in model.decode(model.scores(tagger.word_features([f"w{i}" for i in range(n)])))]
        assert all(x[0] != "I" or before[2:] == x[2:] for before, x in zip(["", *names], names))
    assert model.spans([]) == []


def test_tagger_learns_a_dictionary_and_beyond(spark):
    rng = random.Random(1)
    towns = ["Bergheim", "Waldheim", "Steinheim", "Oberheim", "Talheim", "Neuheim", "Hochheim", "Altheim"]
    names = ["Anna Koch", "Otto Beck", "Ida Lang", "Max Horn"]
    text = lambda t: f"{rng.choice(['Today', 'Often', 'Later'])} {rng.choice(names)} went to {t} by {rng.choice(['train', 'road', 'boat'])} and back."
    docs = spark.createDataFrame([(i, " ".join(text(rng.choice(towns)) for _ in range(5))) for i in range(300)] + [(900, None), (901, "")], "id int, text string")
    dictionary = spark.createDataFrame([(t.lower(), "PLACE") for t in towns] + [(n.lower(), "PERSON") for n in names], "phrase string, entity_detected string")
    taught = tagger.learn(docs.filter("id < 200 or id >= 900"), dictionary)
    held = tagger.span_accuracy(tagger.labelled_texts(docs.filter("id >= 200"), dictionary), taught).first()
    assert held["n_gold"] > 500 and held["f1"] > 0.98
    new = spark.createDataFrame([(1, "Often Anna Koch went to Mooshausen by train and back.")], "id int, text string")
    found = {(r["text"], r["entity_detected"]): r["score"] for r in mentions.extract_with(new, taught).collect()}
    assert set(found) == {("Anna Koch", "PERSON"), ("Mooshausen", "PLACE")}
    assert all(0.5 < p <= 1 for p in found.values())


def test_tagger_without_hits_finds_nothing(spark):
    docs = spark.createDataFrame([(1, "some words")], "id int, text string")
    none = spark.createDataFrame([("absent", "X")], "phrase string, entity_detected string")
    assert mentions.extract_with(docs, tagger.learn(docs, none)).count() == 0
