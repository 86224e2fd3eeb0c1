"""How often the category model reads its rows, and rows whose keys are null or repeated."""

import random

import pytest
from pyspark.sql import functions as F

from namesift.operators import categories

WORDS = {"a": ["red", "rose", "sun", "the"], "b": ["blue", "sea", "ship", "the"], "c": ["moon", "owl", "the"]}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    return [(i, " ".join(rng.choices(WORDS[c], k=rng.randrange(0, 9))), c) for i in range(300) for c in [rng.choice("abc")]]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, text string, gold string")


def test_texts_are_read_once_to_count_and_once_to_score(spark, rows):
    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text

    docs = frame(spark, rows).repartition(4).withColumn("text", F.udf(seen, "string").asNondeterministic()("text"))
    model = categories.learn(docs, "id", "text", "gold", F.col("id") % 4 == 0)
    assert read.value <= 2 * len(rows)
    read.value = 0
    assert len(categories.classify(docs, "id", "text", model).collect()) == len(rows)
    assert read.value == len(rows)


def test_rows_that_share_a_key_share_their_words(spark, rows):
    model = categories.learn(frame(spark, rows), "id", "text", "gold", F.col("id") % 4 == 0)
    extra = {r["slot"]: r for r in model.extra.collect()}
    slots = {w: r for ws in WORDS.values() for w in ws for r in [frame(spark, [(0, w, "")]).select(categories.slot(F.col("text"))).first()[0]]}
    p = {r["class"]: r["p"] for r in model.leads.collect()}
    odd = [(1, "red sun", "a"), (1, "blue", "b"), (1, "blue", "b"), (1, "", None), (1, None, None)]
    odd += [(None, "red sun", "a"), (None, "sea", "b"), (None, "sea", "b"), (None, None, None), (None, "", None)]
    odd += [(2, None, None), (3, "never seen words", None), (4, "!?", None), *[(5, "moon owl", "c")] * 7]
    whole = {}
    for key, text, _ in odd:
        whole.setdefault(key, []).extend(slots[w] for w in (text or "").split() if w in slots)
    whole[None] = []

    def answer(key, text):
        n = len((text or "").replace("!?", "").split())
        units = [(model.prior[k] + n * model.unseen[k] + sum(extra[s][f"e{k}"] for s in whole[key]), -k) for k in range(3)]
        (best, first), (second, _), _ = sorted(units, reverse=True)
        known = p.get(min(19, (best - second) // (n * 50_000)), 0.0) if n else 0.0
        return (key, "abc"[-first] if known >= 0.5 else "Unknown", round(known, 6))

    found = sorted(map(repr, map(tuple, categories.classify(frame(spark, odd), "id", "text", model).collect())))
    assert found == sorted(repr(answer(key, text)) for key, text, _ in odd)


def test_copies_are_written_out_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(categories, "COPIES", 10)
    df = spark.createDataFrame([("a", 1), ("b", 9), ("c", 10), ("d", 11), ("e", 45)], "k string, copies long")
    out = {r["k"]: r["count"] for r in categories._copied(df, "copies").groupBy("k").count().collect()}
    assert out == {"a": 1, "b": 9, "c": 10, "d": 11, "e": 45}


def test_labels_of_texts_without_words_and_too_many_labels(spark, rows):
    blank = frame(spark, [(1, "", "a"), (2, "", "a"), (3, "!", "b"), (4, None, "c"), (5, "x", None)])
    model = categories.learn(blank, "id", "text", "gold", F.lit(False))
    assert model.categories == ("a", "b") and model.prior[0] > model.prior[1] and model.extra.count() == 0
    assert {r["answer"] for r in categories.classify(blank, "id", "text", model).collect()} == {"Unknown"}
    with pytest.raises(ValueError, match="more than 100 categories"):
        categories.learn(frame(spark, rows).withColumn("gold", F.col("id").cast("string")), "id", "text", "gold", F.lit(False))
