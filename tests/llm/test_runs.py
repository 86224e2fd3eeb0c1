"""Periodic runs against brute force, on odd rows and on long texts."""

import hashlib
import random
import re
import zlib

import numpy as np

from namesift.llm import runs

SF_DIR = "/root/testdata/sf0.001"


def brute(w):
    """Every stretch of every lag, without one that has a smaller period."""
    number = {x: i for i, x in enumerate(dict.fromkeys(w))}
    ids = np.array([number[x] for x in w])
    found = []
    for q in range(1, len(w) // 4 + 1):
        same = np.concatenate(([0], ids[q:] == ids[:-q], [0])).astype(int)
        for i, j in zip(np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1), strict=True):
            size = int(j - i) + q
            s = ids[i : i + size]
            if size >= max(6, 4 * q) and not any((s[d:] == s[:-d]).all() for d in range(1, q)):
                found.append((int(i), size, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute(w)
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in found)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    s, size, q = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else (None, None, None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), s, size, q, 1000 * size // q if found else None, sha(lines), sha(kept))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
order = lambda rows: sorted(rows, key=str)


def test_runs_of_short_texts_are_all_found():
    rng = random.Random(3)
    for _ in range(2_000):
        n = rng.choice([6, 7, 10, 30, 90, 200])
        w = [rng.randrange(rng.choice([1, 2, 3, 40])) for _ in range(n)]
        a, p = rng.randrange(n), rng.randrange(1, n)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        for _ in range(rng.choice([0, 0, 1, 3])):
            w[rng.randrange(n)] = rng.randrange(3)
        assert runs.find_runs(np.array(w)) == brute(w), w


def test_seeds_are_no_shorter_than_a_period_and_no_longer_than_an_overlap():
    levels = list(runs.seed_lengths(1_000_000))
    for (low, seed), after in zip(levels, [*levels[1:], None], strict=True):
        high = after[0] - 1 if after else seed
        for q in {low, high}:
            assert q <= seed <= max(6, 4 * q) - q


def test_query_agrees_with_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    rows = [tuple(r[c] for c in COLUMNS) for r in runs.op13_periodic_runs(spark, SF_DIR).collect()]
    assert order(rows) == order(expected(r["doc_id"], r["text"]) for r in docs)
    assert any(r[1] for r in rows)


def test_odd_rows(spark, odd, none, tmp_path):
    loop = "a b " * 400
    more = spark.createDataFrame([(i, loop) for i in range(20)] + [(None, loop), (99, "x " * 100_000)], "doc_id long, text string")
    odd.select("doc_id", "text").unionByName(more).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").collect()
    rows = [tuple(r[c] for c in COLUMNS) for r in runs.op13_periodic_runs(spark, str(tmp_path)).collect()]
    assert len(rows) == odd.count() + 22
    long = {99}
    short = lambda rows: order(r for r in rows if r[0] not in long)
    assert short(rows) == short(expected(r["doc_id"], r["text"]) for r in docs if r["doc_id"] not in long)
    assert [r[1:5] for r in rows if r[0] == 99] == [(1, 0, 100_000, 1)]
    assert runs.scanned(none).count() == 0


def test_collapse_keeps_columns_and_plain_texts(spark, odd):
    out = runs.collapse(odd)
    assert out.columns == odd.columns
    assert sorted(map(str, out.select("doc_id", "text").collect())) == sorted(map(str, odd.select("doc_id", "text").collect()))
    doc = odd.limit(1).selectExpr("doc_id", "'go stop go stop go stop go stop now' text")
    assert runs.collapse(doc).first()["text"] == "go stop now"
