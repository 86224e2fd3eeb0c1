"""The line field: sums against all label paths, slopes against differences, held-out accuracy, odd rows."""

import zlib
from itertools import product

import numpy as np
import pytest

from namesift.llm import line_quality as L
from namesift.llm.common import Powers

SF_DIR = "/root/testdata/sf0.1"
TEXTS = ["Some words here.\nMENU | HOME | TOP\n\nMore plain words, and an end.", "", "One line only", " \n\t\n", "a\nb\nc\nd\ne", "x x x x x x\n!!! ??? ..."]


def lines():
    return L.lines_of([t.encode() for t in TEXTS], Powers())


def field(seed=0):
    rng, out = np.random.default_rng(seed), L.Field()
    for w in (out.own, out.before, out.after, out.alone):
        w[:] = rng.normal(0, 0.3, w.shape)
    out.moves[:] = rng.normal(0, 1, (2, 2))
    return out


def test_lines_and_their_neighbours():
    found = lines()
    assert found.count.tolist() == [3, 1, 1, 1, 5, 2]
    assert found.number.tolist() == [0, 1, 3, 0, 0, 0, 0, 1, 2, 3, 4, 0, 1]
    alone = L._together([L.lines_of([t.encode()], Powers()) for t in TEXTS])
    for c in ("codes", "length", "number", "start"):
        assert (getattr(alone, c) == getattr(found, c)).all()


def test_marginals_and_likelihood_agree_with_all_label_paths():
    own, found = field(), lines()
    score = own.scores(found)
    label = np.random.default_rng(1).integers(0, 2, len(score))
    marginals, likelihood = [], 0.0
    for start, n in zip(found.start, found.count, strict=True):
        s = score[start : start + n]
        weight = {p: sum(x * y for x, y in zip(s, p, strict=True)) + sum(own.moves[a, b] for a, b in zip(p, p[1:])) for p in product((0, 1), repeat=int(n))}
        whole = sum(np.exp(v) for v in weight.values())
        marginals += [sum(np.exp(v) for p, v in weight.items() if p[i]) / whole for i in range(n)]
        likelihood += weight[tuple(label[start : start + n].tolist())] - np.log(whole)
    assert own.marginals(found) == pytest.approx(np.array(marginals))
    assert own.gradient(found, label)[0] == pytest.approx(likelihood)


def test_slopes_agree_with_differences():
    own, found = field(2), lines()
    label = np.random.default_rng(1).integers(0, 2, len(found.length))
    base, slopes = own.gradient(found, label)
    for w, slope in zip((own.own, own.before, own.after, own.alone, own.moves), slopes, strict=True):
        for k in np.argsort(-np.abs(slope.ravel()))[:6]:
            w.flat[k] += 1e-5
            assert (own.gradient(found, label)[0] - base) / 1e-5 == pytest.approx(slope.flat[k], abs=1e-3)
            w.flat[k] -= 1e-5


def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    rows = L.op11_line_quality(spark, SF_DIR).collect()
    assert len(rows) == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) >= 0.98 * len(held)
    bad = [r for r in held if not labels[r["doc_id"]]]
    assert len(bad) > 50 and sum(not r["predicted"] for r in bad) >= 0.95 * len(bad)


@pytest.fixture(scope="module")
def taught(spark):
    """Labelled documents of plain lines and of shouted ones."""
    rows = [(i, " ".join(["Plain words make a line."] * (1 + i % 3)) + "\nAnd here is another one.", 1) for i in range(100, 160)]
    rows += [(i, "BUY!! NOW!! " * (1 + i % 3) + "\nTOP!! TEN!!", 0) for i in range(200, 260)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(r[0], r[2], 0) for r in rows] + [(None, 1, 1), (100, 1, None), (101, None, 0)], "doc_id long, quality int, toxic int")


def test_odd_rows_empty_tables_and_missing_labels(spark, odd, none, taught):
    docs, labels = taught
    both = odd.unionByName(docs, allowMissingColumns=True)
    rows = L.judged(both, labels).collect()
    assert len(rows) == both.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert rows[0]["doc"].asDict().keys() == set(odd.columns)
    same = [r["score"] for r in rows if r["doc"]["doc_id"] == 7]
    assert len(same) == 2 and same[0] == pytest.approx(same[1])
    assert L.judged(none, labels).count() == 0
    assert {r["score"] for r in L.judged(odd, labels.where("false")).collect()} == {0.5}
    assert {r["score"] for r in L.judged(docs, labels.where("quality = 1")).collect()} == {0.5}


def test_clean_drops_bad_lines_and_documents(spark, taught):
    docs, labels = taught
    mixed = "\n".join(["Plain words make a line.", "And here is another one."] * 6 + ["BUY!! NOW!! TOP!! TEN!!"] * 8)
    more = docs.unionByName(spark.createDataFrame([(1, mixed)], "doc_id long, text string"))
    out = {r["doc_id"]: r["text"] for r in L.clean(more, labels).collect()}
    assert set(out) == {1, *range(100, 160)}
    assert out[1].count("\n") < 13 and out[1].startswith("\n".join(["Plain words make a line.", "And here is another one."] * 5))


def test_sample_is_bounded(taught):
    docs, labels = taught
    assert L.training_rows(docs, labels, 10).count() == 10
    assert L.training_rows(docs, labels, 1_000).count() == sum(zlib.crc32(str(i).encode()) % 5 > 0 for i in [*range(100, 160), *range(200, 260)])
