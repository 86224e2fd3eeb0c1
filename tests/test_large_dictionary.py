"""Dictionaries too long to be listed: only grams that may be anchors leave a task."""

import random

from pyspark.sql import functions as F

from namesift.operators import linking, sizing


def tables(spark):
    rnd = random.Random(17)
    words = ["".join(rnd.choices("abcdefgh", k=rnd.randrange(1, 9))) for _ in range(60)]
    entries = [(i, " ".join(rnd.choices(words, k=rnd.randrange(1, 7)))) for i in range(150)] + [(900, ""), (901, "ab  cd"), (902, None)]
    texts = [(i, " ".join([*rnd.choices(words, k=12), (entries[i][1] or ""), *rnd.choices(words, k=12)])) for i in range(0, 120, 2)]
    texts += [(1000 + i, " ".join(e.split()[1:3])) for i, e in entries[:60]] + [(2000, None), (2001, ""), (2002, "x ab  cd y"), (2003, "ab")]
    return spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(entries, "entry int, entry_text string")


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_anchors_that_cannot_be_listed_give_the_same_matches(spark, monkeypatch):
    texts, entries = tables(spark)
    whole = found(linking.resolve_text(texts, entries))
    held, norms = [r for r in entries.collect() if r["entry_text"]], [r for r in texts.collect() if r["text"]]
    brute = sorted((t["id"], e["entry"], "exact" if t["text"] == e["entry_text"] else "overlap") for t in norms for e in held if t["text"] in e["entry_text"] or e["entry_text"] in t["text"])
    assert [r[:2] for r in whole] == [r[:2] for r in brute] and len(brute) > 100
    monkeypatch.setattr(linking, "LISTED_ANCHORS", 0)
    assert found(linking.resolve_text(texts, entries)) == whole
    monkeypatch.setattr(sizing, "BROADCAST_ROWS", 1)
    assert found(linking.resolve_text(texts, entries)) == whole
    # A table of bits that is full tells nothing and loses nothing.
    monkeypatch.setattr(linking, "ANCHOR_BITS", 0)
    assert found(linking.resolve_text(texts, entries)) == whole


def test_few_grams_leave_a_task_when_anchors_cannot_be_listed(spark, monkeypatch):
    texts, entries = tables(spark)
    rows = []
    monkeypatch.setattr(linking, "LISTED_ANCHORS", 0)
    for name in ("with_grams", "with_likely_grams"):
        made = getattr(linking, name, None)

        def counted(*args, made=made):
            out = made(*args)
            rows.append(out.count())
            return out

        if made:
            monkeypatch.setattr(linking, name, counted)
    linking.resolve_text(texts, entries)
    every = texts.agg(F.sum(F.length("text"))).first()[0]
    assert len(rows) == 2 and sum(rows) < 0.5 * every
