"""Collocations against brute force, whatever tiles and blocks they are counted in."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from namesift.llm import collocations as C

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = ["lang", "phrase", "a", "l", "r", "n", "score"]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, least, longest=5):
    """Every phrase counted, every cut scored, every longer phrase compared."""
    out = []
    for lang in {r[0] or "und" for r in rows}:
        f, n = Counter(), 0
        for own, text in rows:
            if (own or "und") == lang:
                for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
                    w = re.findall(r"[^\x20\x09]+", piece)
                    n += len(w)
                    f.update(tuple(w[i : i + m]) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
        kept = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        held = {}
        for q, b in kept.items():
            for m in range(2, len(q)):
                for i in range(len(q) - m + 1):
                    held[q[i : i + m]] = max(held.get(q[i : i + m], 0), b)
        for p, a in kept.items():
            if 100 * held.get(p, 0) < 100 * a:
                cuts = [(1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                out.append((lang, " ".join(p), a, f[p[:k]], f[p[k:]], n, score))
    return sorted(out)


def found(rows):
    return sorted(tuple(r[c] for c in COLUMNS) for r in rows.collect())


def numbered(rows, top):
    out, place = [], Counter()
    for r in sorted(rows, key=lambda r: (r[0], -r[6], -r[2], r[1].encode())):
        place[r[0]] += 1
        if place[r[0]] <= top:
            out.append((r[0], place[r[0]], *r[1:]))
    return out


@pytest.fixture
def small(monkeypatch):
    """Words of one frequency numbered in several cells."""
    monkeypatch.setattr(C, "NUMBERED", 7)


def texts(seed, n):
    rng = random.Random(seed)
    words = [f"W{i}" for i in range(12)] + ["é", "Ünï", "#x", "'s"]
    out = []
    for _ in range(n):
        w = rng.choices(words, [40 / (i + 1) for i in range(16)], k=rng.randrange(60))
        if rng.random() < 0.5:
            w[1:1] = ["New", "York", "City", "Hall"]
        out.append("".join(x + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".\n", "!? "]) for x in w))
    return out


def test_phrases_agree_with_brute_force(spark, small, monkeypatch):
    rows = [(random.Random(i).choice(["en", "de", None, "und"]), t) for i, t in enumerate(texts(5, 400))]
    rows += [(None, None), ("en", ""), ("fr", " , . "), ("en", rows[0][1]), ("en", rows[0][1])]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    expected = brute(rows, 6)
    assert len(expected) > 100
    assert found(C.candidates(docs, least=6)) == expected
    monkeypatch.setattr(C, "SENT_ROWS", 0)
    monkeypatch.setattr(C, "STRIPS", 3)
    assert found(C.candidates(docs, least=6, busy=3)) == expected
    monkeypatch.undo()
    best = C.best(C.candidates(docs, least=6), top=5).collect()
    names = ["lang", "rank", *COLUMNS[1:]]
    assert sorted(tuple(r[c] for c in names) for r in best) == sorted(numbered(expected, 5))


@pytest.mark.parametrize("sent", [True, False])
def test_words_beyond_the_square_agree_with_brute_force(spark, monkeypatch, sent):
    if not sent:
        monkeypatch.setattr(C, "SENT_ROWS", 0)
    rng = random.Random(2)
    rows = [("en", " ".join(f"w{int(4_000 * rng.random() ** 2)}" for _ in range(40))) for _ in range(250)]
    docs = spark.createDataFrame(rows + rows, "lang string, text string").repartition(3)
    expected = brute(rows + rows, 2, 3)
    assert len({w for r in rows for w in r[1].split()}) > C.HOT
    assert found(C.candidates(docs, least=2, longest=3, busy=1 << 24 if sent else 500)) == expected


def test_blocks_keep_every_word(spark):
    docs = spark.createDataFrame([("en", t) for t in texts(6, 50)], "lang string, text string").coalesce(1)
    one, many = C.blocks(docs), C.blocks(docs, 200)
    assert one.count() == 1 and many.count() > 3
    assert one.agg({"n": "sum"}).first() == many.agg({"n": "sum"}).first()
    assert len({r["block"] for r in many.collect()}) == many.count()


def test_tile_sums_and_packing():
    rng = np.random.default_rng(1)
    values = rng.integers(-1, 1 << 40, 1_000)
    assert (C.unpack(C.pack(values), 1_000) == values).all()
    x, y = rng.integers(0, 3_000, 400_000), rng.integers(0, 50, 400_000)
    (hot, m), (rest, n) = C.count_pairs(x, y)
    code, k = np.unique(C._code(x, y), return_counts=True)
    assert (np.sort(np.concatenate((hot, rest))) == code).all() and m.sum() + n.sum() == k.sum()
    for key, dense in ((5, True), (-3, False)):
        total = C.TileSum(key)
        parts = [np.unique(rng.integers(0, C.CELLS, 3_000)) + (key << 16 if dense else 0) for _ in range(9)]
        whole = dict.fromkeys(np.concatenate(parts).tolist(), 0)
        for p in parts:
            for c in p.tolist():
                whole[c] += 2
            row = C._tile_rows("x", 1, [(key, p, np.full(len(p), 2))]).to_pylist()[0]
            total.add(row["n"], row["cells"], row["counts"])
        at, n = total.result(4)
        assert (total.dense is not None) == dense
        assert dict(zip(at.tolist(), n.tolist(), strict=True)) == {c: v for c, v in whole.items() if v >= 4}


def test_products_beyond_64_bits_are_exact(spark):
    a, n = 10**12 + 7, 10**15 + 3
    wide = "cast({} as decimal(38,0))"
    score = spark.sql(f"select ({wide.format(1000)} * {wide.format(a)} * {wide.format(n)}) div ({wide.format(a + 1)} * {wide.format(a + 9)}) s").first()["s"]
    assert score == 1000 * a * n // ((a + 1) * (a + 9))


def test_odd_rows(spark, odd, none):
    rows = [(r["lang"], r["text"]) for r in odd.collect()]
    assert found(C.candidates(odd, least=2)) == brute(rows, 2)
    assert C.best(C.candidates(none)).count() == 0


def test_query_agrees_with_brute_force(spark):
    rows = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    names = ["lang", "rank", *COLUMNS[1:]]
    out = [tuple(r[c] for c in names) for r in C.op12_collocations(spark, SF_DIR).collect()]
    assert sorted(out) == sorted(numbered(brute(rows, 100), 2_000)) and out
