"""Record linkage: learnt weights, values a few edits apart, clusters of a match graph."""

import hashlib
import math
import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from namesift.operators import clusters, fuzzy, scoring


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i] + [0] * len(b), row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


# ---- scoring ---------------------------------------------------------------


def plain_em(counts, m, u, share, rounds):
    """The same rounds, one pair at a time."""
    for _ in range(rounds):
        p = []
        for levels, n in counts:
            a, b = share, 1 - share
            for k, level in enumerate(levels):
                if level is not None:
                    a, b = a * m[k][level], b * u[k][level]
            p += [(levels, a / (a + b))] * n
        share = sum(x for _, x in p) / len(p)
        for k in range(len(m)):
            known = [(levels[k], x) for levels, x in p if levels[k] is not None]
            m[k] = [sum(x for v, x in known if v == level) / sum(x for _, x in known) for level in range(len(m[k]))]
            u[k] = [sum(1 - x for v, x in known if v == level) / sum(1 - x for _, x in known) for level in range(len(u[k]))]
    return m, u, share


def test_learning_agrees_with_a_plain_loop():
    rng = random.Random(2)
    counts = [(levels, rng.randrange(1, 9)) for levels in product((0, 1, 2, None), (0, 1, None)) if levels != (None, None)]
    start = scoring.starting_weights({"a": 3, "b": 2})
    learnt = scoring.maximise(counts, start, 6)
    m, u, share = plain_em(counts, [list(start.m[c]) for c in "ab"], [list(start.u[c]) for c in "ab"], start.matches, 6)
    for k, c in enumerate("ab"):
        assert learnt.m[c] == pytest.approx(m[k]) and learnt.u[c] == pytest.approx(u[k])
    assert learnt.matches == pytest.approx(share)
    assert scoring.maximise(counts[::-1], start, 6) == learnt


def test_learning_finds_the_planted_weights(spark):
    rng = random.Random(5)
    m, u, share = {"a": (0.1, 0.2, 0.7), "b": (0.2, 0.8), "c": (0.1, 0.9)}, {"a": (0.8, 0.15, 0.05), "b": (0.9, 0.1), "c": (0.7, 0.3)}, 0.3
    rows = []
    for i in range(20_000):
        side = m if i < share * 20_000 else u
        rows.append((i, *[rng.choices(range(len(side[c])), side[c])[0] for c in "abc"]))
    compared = spark.createDataFrame(rows, "id int, a int, b int, c int")
    learnt = scoring.fit(compared, {"a": 3, "b": 2, "c": 2}, rounds=200)
    assert learnt.matches == pytest.approx(share, abs=0.05)
    for c in "abc":
        assert learnt.m[c] == pytest.approx(m[c], abs=0.06) and learnt.u[c] == pytest.approx(u[c], abs=0.04)
    scored = scoring.score(compared, learnt)
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString()


def test_weights_of_a_pair_add_up_and_missing_levels_say_nothing(spark):
    weights = scoring.Weights(0.25, {"a": (0.25, 0.75), "b": (0.5, 0.5)}, {"a": (0.75, 0.25), "b": (0.75, 0.25)})
    rows = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (3, None, 1), (4, None, None), (5, 7, 0)], "id int, a int, b int")
    out = {r["id"]: r for r in scoring.decide(scoring.score(rows, weights), 0.6, 0.3).collect()}
    assert out[1]["weight"] == pytest.approx(math.log2(3) + 1) and out[1]["probability"] == pytest.approx(2 / 3)
    assert out[3]["weight"] == pytest.approx(1) and out[4]["weight"] == 0 and out[4]["probability"] == pytest.approx(0.25)
    assert out[5]["weight"] is None
    assert [out[i]["decision"] for i in (1, 2, 3, 4)] == ["match", "none", "possible", "none"]


def test_agreement_takes_the_strongest_level(spark):
    rows = spark.createDataFrame([("ab", "ab"), ("ab", "abc"), ("ab", "x"), (None, "x")], "l string, r string")
    level = scoring.agreement(F.col("l"), F.col("r"), F.startswith("r", "l"), F.col("l") == F.col("r"))
    assert [r[0] for r in rows.select(level).collect()] == [2, 1, 0, None]


def test_learning_on_nothing_and_on_too_many_levels(spark):
    none = spark.createDataFrame([], "a int, b int")
    start = scoring.starting_weights({"a": 3, "b": 2})
    assert scoring.fit(none, {"a": 3, "b": 2}) == start
    with pytest.raises(ValueError):
        scoring.fit(none, {c: 40 for c in "abcd"})


def test_best_partner_is_reduced_before_the_shuffle(spark):
    rows = spark.createDataFrame([(1, 5, 2.0, "x"), (1, 4, 2.0, "y"), (1, 3, 1.0, "z"), (2, 9, None, "n")], "l int, r int, weight double, note string")
    best = scoring.best_partners(rows, "l", "r")
    assert [tuple(r) for r in best.collect()] == [(1, 4, 2.0, "y")]


# ---- values within k edits ----------------------------------------------------


def words(rng, n, letters, longest):
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(longest))) for _ in range(n)]


@pytest.mark.parametrize(("k", "hot"), [(1, 1_000), (2, 1_000), (3, 1_000), (1, 2), (2, 2)])
def test_similar_values_agree_with_all_pairs(spark, k, hot):
    rng = random.Random(k)
    left = words(rng, 120, "ab", 9) + words(rng, 80, "abcdef", 14) + ["customer" + w for w in words(rng, 40, "01", 8)]
    right = words(rng, 120, "ab", 9) + [w[:3] + "x" + w[4:] for w in left] + ["customer" + w for w in words(rng, 40, "01", 8)]
    frame = lambda rows: spark.createDataFrame([(w,) for w in [*rows, None, "", rows[0]]], "w string")
    found = fuzzy.similar_values(frame(left), frame(right), "w", "w", k, hot=hot).collect()
    expected = {(a, b, edits(a, b)) for a in set(left) for b in set(right) if a and b and edits(a, b) <= k}
    assert len(found) == len(set(found)) and {tuple(r) for r in found} == expected


def test_similar_values_need_no_nested_loop(spark):
    rows = spark.createDataFrame([("alpha",), ("alpah",)], "w string")
    plan = fuzzy.similar_within(rows, "w", 2)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_hot_segments_do_not_pair_everything(spark):
    """A start that all values share brings none of them together once it is cut out."""
    values = spark.createDataFrame([(f"customer#{i:09d}",) for i in range(2_000)], "w string")
    found = {tuple(r) for r in fuzzy.similar_values(values, values.limit(50), "w", "w", 1, normalize=False, hot=100).select("left_value", "right_value").collect()}
    few = [r["w"] for r in values.limit(50).collect()]
    assert found == {(a, b) for b in few for a in (f"customer#{i:09d}" for i in range(2_000)) if sum(x != y for x, y in zip(a, b, strict=True)) <= 1}


# ---- clusters -------------------------------------------------------------------


def clustered(spark, pairs, least=0.5):
    rows = spark.createDataFrame(pairs, "a string, b string, w double")
    return {r["node"]: (r["component"], r["cluster"]) for r in clusters.entity_clusters(rows, "a", "b", "w", least).collect()}


def expected_clusters(pairs, least):
    nodes = {x for a, b, _ in pairs for x in (a, b)}
    weight = {}
    for a, b, w in pairs:
        if w >= least and a != b:
            for e in ((a, b), (b, a)):
                weight[e] = max(weight.get(e, w), w)
    order = sorted(nodes, key=lambda x: (hashlib.md5(x.encode()).hexdigest(), x))
    taken = []
    for x in order:
        if not any((x, y) in weight for y in taken):
            taken.append(x)
    part = {x: x for x in nodes}
    for a, b in weight:
        low, high = sorted((part[a], part[b]))
        part = {k: low if v == high else v for k, v in part.items()}
    best = {x: x if x in taken else min(((-weight[x, y], order.index(y)), y) for y in taken if (x, y) in weight)[1] for x in nodes}
    return {x: (part[x], best[x]) for x in nodes}


def test_clusters_agree_with_taking_nodes_one_by_one(spark):
    rng = random.Random(8)
    pairs = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}", rng.randrange(10) / 10) for _ in range(120)]
    assert clustered(spark, pairs) == expected_clusters(pairs, 0.5)


def test_a_star_and_a_chain(spark):
    star = [("hub", f"leaf{i}", 0.9) for i in range(40)]
    chain = [(f"c{i:02d}", f"c{i + 1:02d}", 0.9) for i in range(30)]
    out = clustered(spark, star + chain)
    assert out == expected_clusters(star + chain, 0.5)
    assert {out[f"leaf{i}"][0] for i in range(40)} == {"hub"} and {out[f"c{i:02d}"][0] for i in range(31)} == {"c00"}
    assert len({out[f"c{i:02d}"][1] for i in range(31)}) > 5


def test_a_weak_link_does_not_merge_two_entities(spark):
    group = lambda c: [(f"{c}{i}", f"{c}{j}", 0.9) for i in range(5) for j in range(i)]
    out = clustered(spark, [*group("a"), *group("b"), ("a0", "b0", 0.6), ("z", "a1", 0.1)])
    assert len({v[0] for k, v in out.items() if k != "z"}) == 1
    assert len({out[f"a{i}"][1] for i in range(5)}) == 1 and len({out[f"b{i}"][1] for i in range(5)}) == 1
    assert out["a1"][1] != out["b1"][1] and out["z"] == ("z", "z")


def test_no_links_and_links_to_itself(spark):
    assert clustered(spark, [("a", "b", 0.1)]) == {"a": ("a", "a"), "b": ("b", "b")}
    assert clustered(spark, [("a", "a", 0.9)]) == {"a": ("a", "a")}
    loops = spark.createDataFrame([("a", "a"), ("b", "c")], "u string, v string")
    assert sorted(map(tuple, clusters.connected(loops).collect())) == [("a", "a"), ("b", "b"), ("c", "b")]
