"""The index of repeated passages: what it sorts, and how it is cut by key."""

import random

import numpy as np

from namesift.llm import repeats


def test_only_suffixes_not_told_apart_are_sorted_again(monkeypatch):
    rnd = np.random.default_rng(3)
    text = rnd.integers(1, 200, 20_000)
    text[15_000:15_300] = text[100:400]
    text[-1] = 0
    sort, sizes = np.argsort, []

    def counted(values, *args, **kwargs):
        sizes.append(len(values))
        return sort(values, *args, **kwargs)

    monkeypatch.setattr(np, "argsort", counted)
    order, change = repeats.suffix_order(text, 50)
    monkeypatch.undo()
    assert sum(sizes) < 1.5 * len(text)
    suffixes = sorted(range(len(text)), key=lambda i: text[i : i + 400].tolist())
    assert order.tolist() == suffixes
    heads = [text[i : i + 50].tolist() for i in suffixes]
    assert change.tolist() == [True, *[a != b for a, b in zip(heads[1:], heads[:-1], strict=True)]]


def test_an_index_for_each_key_finds_the_same_passages(spark, monkeypatch):
    rnd = random.Random(5)
    words = [f"word{i}" for i in range(300)]
    passages = [" ".join(rnd.choices(words, k=30)) for _ in range(6)]
    rows = [(i, " ".join([*rnd.choices(words, k=10), rnd.choice(passages)[rnd.randrange(40) :], *rnd.choices(words, k=10)])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(tuple(r) for r in repeats.without_repeats(docs).collect())
    monkeypatch.setattr(repeats, "INDEX_BYTES", 1)
    assert sorted(tuple(r) for r in repeats.without_repeats(docs).collect()) == whole
    removed = {d: n for d, _, n, *_ in whole}
    for i, text in rows:
        gone = np.zeros(len(text), bool)
        for at in range(len(text) - 49):
            if any(j < i and text[at : at + 50] in other for j, other in rows):
                gone[at : at + 50] = True
        assert removed[i] == gone.sum()
    assert sum(removed.values()) > 1000
