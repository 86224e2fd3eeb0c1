"""Odd rows, empty tables, hot groups and small brute-force comparisons."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from namesift.llm import common, decontamination, html, licenses, lines, mixing, quality, repeats, sharding, simhash, toxicity

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 1), (2, 0, 0), (None, 1, 1), (5, None, None)], LABELS)


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, "brown fox jumps over the lazy dog while"), (1, "brown fox jumps over the lazy dog while"), (2, None), (3, ""), (4, "too short")]
    return spark.createDataFrame(rows, "item_id long, text string")


def ids(df):
    return sorted((r[0] is None, r[0]) for r in df.select("doc_id").collect())


def test_odd_rows_stay_one_for_one(spark, odd, labels):
    n = odd.count()
    assert simhash.near_components(odd).count() == n
    assert toxicity.score(odd, labels).count() == n
    assert repeats.without_repeats(odd).count() == n
    assert licenses.scanned(odd).count() == n
    assert sharding.shards(odd, 20_000).count() == n
    assert quality.rated(odd).count() == n
    assert lines.without_boilerplate(odd).count() == n
    assert mixing.mixed(odd).count() == n


def test_empty_tables(spark, none, labels, benchmark):
    empty_pages = spark.createDataFrame([], "page_id long, url string, html string")
    for rows in (
        simhash.near_components(none),
        simhash.near_groups(none),
        toxicity.score(none, labels.where("false")),
        repeats.without_repeats(none),
        licenses.scanned(none),
        sharding.shards(none),
        quality.rated(none),
        lines.without_boilerplate(none),
        mixing.mixed(none),
        decontamination.overlaps(none, benchmark),
        decontamination.overlaps(none, benchmark.where("false")),
        html.extracted(empty_pages),
    ):
        assert rows.count() == 0


def test_pipeline_stages_on_odd_rows(spark, odd, labels, benchmark, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = odd
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, str(tmp_path))
        assert set(odd.columns) <= set(out.columns)
        docs = common.stage(out, name)
    kept = docs.collect()
    assert {r["doc_id"] for r in kept} >= {2, 5, 6, 7}
    assert not {1, 8} & {r["doc_id"] for r in kept}  # they hold the benchmark item


def test_copies_of_one_row_leave_one(spark, odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    found = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sorted(found) == [1, 2, 3, 5, 6, 7]


def test_components_against_search(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(400)]
    part = {}
    for u, v in edges:
        part.setdefault(u, u), part.setdefault(v, v)
    for _ in range(70):
        for u, v in edges:
            part[u] = part[v] = min(part[u], part[v])
    alone = {u for u, v in edges if u == v} - {x for u, v in edges if u != v for x in (u, v)}
    found = common.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r["node"]: r["component"] for r in found} == {k: v for k, v in part.items() if k not in alone}


@pytest.mark.parametrize("radius", [1, 2])
@pytest.mark.parametrize("paired", [2, 32])
def test_links_against_all_pairs(spark, monkeypatch, radius, paired):
    monkeypatch.setattr(simhash, "PAIRED", paired)
    rng = random.Random(radius)
    centre = [rng.getrandbits(64) for _ in range(4)]
    prints = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for c in centre for _ in range(60)}
    rows = [(x - (1 << 64) if x >> 63 else x,) for x in prints]
    found = common.components(simhash.link(spark.createDataFrame(rows, "fp long"), radius)).collect()
    part = {x: x for (x,) in rows}
    for _ in range(len(part)):
        before = dict(part)
        for a, b in combinations(part, 2):
            if ((a ^ b) & (2**64 - 1)).bit_count() <= radius:
                part[a] = part[b] = min(part[a], part[b])
        if part == before:
            break
    sizes = {x: sum(v == part[x] for v in part.values()) for x in part}
    assert {r["node"]: r["component"] for r in found} == {x: v for x, v in part.items() if sizes[x] > 1}


def test_thresholds_sum_to_the_pigeonhole_bound():
    rng = np.random.default_rng(0)
    bits = rng.integers(0, 2, (500, 64))
    bits[:, 1] = bits[:, 0]
    both = bits.T @ bits
    assert {0, 1} <= set(simhash.group_bits(500, both, 4)[0])
    for radius in (1, 2, 3):
        chosen = simhash.plan(500, both, radius)
        parts = len(chosen)
        assert sum(t + 1 for _, t in chosen) == radius + 1 and parts >= 1


def test_near_copies_by_shingles_are_grouped(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(2000)]
    rows, pairs = [], []
    for k in range(80):
        words = [rng.choice(vocabulary) for _ in range(200)]
        rows.append((2 * k, " ".join(words)))
        for at in rng.sample(range(200), 1 + k % 4):
            words[at] = "changed"
        rows.append((2 * k + 1, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    grams = {i: {tuple(t.split()[j : j + 5]) for j in range(196)} for i, t in rows}
    pairs = [(2 * k, 2 * k + 1) for k in range(80)]
    similar = [(a, b) for a, b in pairs if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])]
    kept = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    missed = [p for p in similar if p[1] in kept]
    assert len(missed) <= 0.02 * len(similar)
    assert {b for a, b in pairs if (a, b) not in similar} <= kept


def brute_tiles(text, item, least):
    free_t, free_i, out = [True] * len(text), [True] * len(item), []
    while True:
        best, most = None, least - 1
        for q in range(len(item)):
            for p in range(len(text)):
                n = 0
                while p + n < len(text) and q + n < len(item) and text[p + n] == item[q + n] and free_t[p + n] and free_i[q + n]:
                    n += 1
                if n > most:
                    most, best = n, (p, q)
        if best is None:
            return sorted(out)
        for n in range(most):
            free_t[best[0] + n] = free_i[best[1] + n] = False
        out.append((*best, most))


def test_tiles_against_brute_force():
    rng = random.Random(2)
    for _ in range(150):
        text = np.array([rng.randrange(1, 5) for _ in range(rng.randrange(40))], np.uint64)
        item = np.array([rng.randrange(1, 5) for _ in range(rng.randrange(20))], np.uint64)
        mine = decontamination.tiles(text, item, 3)
        expected = brute_tiles(text.tolist(), item.tolist(), 3)
        assert sorted(mine) == expected


def test_reordered_passage_is_found(spark):
    item = " ".join(f"q{i}" for i in range(30))
    words = item.split()
    moved = " ".join(["x", *words[15:], "y", "z", *words[:15], "end"])
    docs = spark.createDataFrame([(1, moved), (2, "x " + " ".join(words[:8])), (3, None)], "doc_id long, text string")
    rows = decontamination.overlaps(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["n_tiles"], r["n_covered"]) for r in rows] == [(1, 9, 2, 30)]


def test_run_index_against_sets():
    rng = random.Random(1)
    for _ in range(100):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(40))) for _ in range(6)]
        owners = np.array([rng.randrange(9) for _ in strings])
        first = {}
        for s, o in zip(strings, owners):
            for i in range(len(s) - 7):
                first[s[i : i + 8]] = min(first.get(s[i : i + 8], 99), o)
        for s, o, got in zip(strings, owners, repeats.RunIndex(strings, owners, 8).matches(owners)):
            assert got.tolist() == [first[s[i : i + 8]] < o for i in range(max(0, len(s) - 7))]


def test_repeats_with_odd_ids(spark):
    a, b = "x" * 3000, "The same sixty bytes of text stand in every one of these rows here."
    rows = [(1, b), (1, b), (1, "y" + b), (None, "z" + b + a), (None, a), (2, a + b), (3, b[:49]), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"]) for r in repeats.without_repeats(docs).collect())
    n = len(b)
    assert got == sorted([(False, 1, n, 0, 0)] * 2 + [(False, 1, n + 1, 0, 0), (False, 2, 3000 + n, n, 1), (False, 3, 49, 0, 0), (False, 4, 0, 0, 0), (True, 0, 3001 + n, 3000 + n, 1), (True, 0, 3000, 3000, 1)])


@pytest.mark.parametrize("written", ["1d10t", "id!ot", "idiiiiot", "i.d.i.o.t"])
def test_disguised_words_are_restored(spark, written):
    docs = spark.createDataFrame([("the idiot went out and the idiot came in again",)] * 3, "text string")
    model = toxicity.language_model(docs)
    assert toxicity.restore(written, model) == ["idiot"]
    assert toxicity.spaced("an i d i o t here") == ["idiot"]
    assert toxicity.restore("plain,", model) == ["plain"]


def test_language_model_counts_all_texts(spark, odd):
    counted = {r["code"]: r["n"] for r in toxicity.count_sequences(odd).collect()}
    assert sum(counted.values()) == sum(len(r["text"] or "") + 1 for r in odd.select("text").collect())


def test_template_regions():
    auto = licenses.compile_template("red <<optional>>very<</optional>> blue <<var 2>> green <<var 1: one | two three>> end")
    fits = lambda text: auto.match(licenses._hashes(text), 0) == len(text.split())
    assert fits("red blue green one end") and fits("red very blue a b green two three end")
    assert not fits("red blue a b c green one end") and not fits("red blue green four end") and not fits("red very very blue green one end")
    with pytest.raises(ValueError):
        licenses.compile_template("<<var 2>> end").openings()


def test_license_text_with_other_holder(spark):
    text = licenses.TEMPLATES["mit"].replace("<<var 12>>", "the example authors").replace("<<optional>>including the next paragraph<</optional>>", "")
    text = text.replace("<<optional>>", "").replace("<</optional>>", "")
    docs = spark.createDataFrame([(1, "X. " + text.upper() + " Y"), (2, text.replace("sublicense", "sell"))], "doc_id long, text string")
    assert {r["doc_id"]: r["labels"] for r in licenses.scanned(docs).collect()} == {1: "mit", 2: ""}


def test_frame_stays_within_a_block():
    for shares in ([1], [1, 1], [5, 3, 2], [997, 2, 1], [7, 7, 7, 1]):
        served, total = [0] * len(shares), sum(shares)
        slots = mixing.frame(shares)
        for t, s in enumerate(slots, 1):
            served[s] += 1
            assert all(abs(n - t * a / total) < 1 for n, a in zip(served, shares))
        assert served == shares


def test_mix_interleaves_by_weight_and_keeps_all(spark):
    rows = [(i, "a" if i % 10 < 6 else "b" if i % 10 < 9 else None, f"t{i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found = mixing.mixed(docs, {"a": 2, "b": 1, None: 1}, block_rows=10).select("doc.source", "slot", "order").orderBy("order").collect()
    assert len(found) == 3000 and len({r["order"] for r in found}) == 3000
    by_slot = {r["slot"]: r["source"] for r in found}
    assert sorted(by_slot) == list(range(300))
    ends = min(max(s for s, x in by_slot.items() if x == y) for y in ("a", "b", None))
    for t in range(1, ends):
        counts = {x: sum(by_slot[s] == x for s in range(t)) for x in ("a", "b", None)}
        assert all(abs(counts[x] - t * w / 4) < 1 for x, w in (("a", 2), ("b", 1), (None, 1)))


@pytest.mark.parametrize("sent", [0, 50_000])
def test_shards_fit_and_only_large_ones_split(spark, monkeypatch, sent):
    monkeypatch.setattr(sharding, "SENT_CELLS", sent)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('x', 100 + int(id % 50))").alias("text"))
    hot = spark.range(500).select(F.lit(7).cast("long").alias("doc_id"), F.expr("repeat('y', 400)").alias("text"))
    rows = sharding.shards(docs.unionByName(hot), 20_000).select("doc.text", "shard", "depth", "shard_bytes").collect()
    assert len(rows) == 3500
    sizes = {}
    for r in rows:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + len(r["text"])
    assert max(sizes.values()) <= 20_000 and all(sizes[r["shard"]] == r["shard_bytes"] for r in rows)
    plain = [s for s in sizes if "+" not in s]
    for s in plain:
        parent = sum(n for k, n in sizes.items() if k.startswith(s[:-1]))
        assert s == "-" or parent > 20_000


def test_spread_lines_near_and_far_from_the_threshold(spark):
    rows = [(i, f"A line that many sites carry around.\nOnly here, number {i} of all.", f"s{i % 40}") for i in range(200)]
    rows += [(1000 + i, "This one stands on just five sites.\nshort", f"s{i}") for i in range(5)]
    rows += [(2000 + i, "This one stands on just four sites.", f"s{i % 4}") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r["doc_id"]: r["kept"] for r in lines.without_boilerplate(docs).select("doc.doc_id", "kept").collect()}
    assert kept[3] == "Only here, number 3 of all." and kept[1001] == "short" and kept[2000].startswith("This one stands")


def test_line_rules_keep_prose(spark):
    prose = "A plain sentence that ends well and has words enough to stay in.\nSecond line of it, also fine."
    menu = "Home | News | Sport | More\nHome | About | Help | Terms\nCookie settings and privacy policy. Click here.\nA b c d e f g."
    docs = spark.createDataFrame([(1, prose), (2, menu), (3, prose + "\nHome | News | Sport | More")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in quality.rated(docs).select("doc.doc_id", "kept", "clean").collect()}
    assert rows[1]["kept"] and rows[3]["kept"] and not rows[2]["kept"]
    assert rows[3]["clean"] == prose == rows[1]["clean"]
    assert [r["doc_id"] for r in quality.clean(docs).orderBy("doc_id").collect()] == [1, 3]


def test_html_of_other_layouts(spark):
    page = '<html><head><title>T</title></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><article><h1>Title of page {i}</h1><p>First text, number {i}. It says &amp; means\n something.</p><p>More of it, and an end.</p></article><footer>&copy; example</footer></body></html>'
    other = '<body><div class="menu"><a href="/">Home</a></div><div class="content"><h2>Head</h2><p>Body text, that is long enough. And<br>goes on &lt;here&gt;.</p><script>var x = "</p>";</script></div><div class="comments"><p>I like this text, a lot. Really.</p></div><form><label>Mail</label></form><footer>All rights</footer>'
    rows = [(i, f"u{i}", page.replace("{i}", str(i))) for i in range(40)] + [(100, None, other), (101, "u", None), (102, "u", ""), (None, None, "<p>")]
    found = {r["page_id"]: r["text"] for r in html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[3] == "Title of page 3\nFirst text, number 3. It says & means something.\nMore of it, and an end."
    assert found[100] == "Head\nBody text, that is long enough. And goes on <here>."
    assert found[101] == found[102] == found[None] == ""


def near_classes(spark, rows, similarity=0.8):
    """Classes of near copies by ``near_groups`` and by comparing all pairs."""
    grams = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, w in ((i, t.split()) for i, t in rows)}
    alike = [(a, b) for a, b in combinations(grams, 2) if len(grams[a] & grams[b]) >= similarity * len(grams[a] | grams[b])]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in alike:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    want = {}
    for i, _ in rows:
        want.setdefault(root(i), set()).add(i)
    found = {}
    for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found.setdefault(r["keeper"], set()).add(r["doc_id"])
    return sorted(map(sorted, found.values())), sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_near_pairs_within_a_large_template_are_found(spark):
    rng = random.Random(11)
    template = " ".join(f"t{i}" for i in range(100))
    rows = []
    for k in range(150):
        own = [f"o{k}x{i}" for i in range(14)]
        rows.append((2 * k, f"{template} {' '.join(own)}"))
        own[-rng.randint(1, 4) :] = ["other", f"end{k}"]
        rows.append((2 * k + 1, f"{template} {' '.join(own)}"))
    found, want = near_classes(spark, rows)
    assert len(want) > 100 and found == want


def test_near_pairs_of_every_length_are_found(spark):
    rng = random.Random(12)
    rows = []
    for k in range(240):
        words = [f"v{rng.randrange(5000)}" for _ in range(10 + k % 60)]
        rows.append((2 * k, " ".join(words)))
        rows.append((2 * k + 1, " ".join([*words, "appended"] if k % 2 else words[1:])))
    # A text that says the same over and over has few distinct shingles.
    rows += [(1000, " ".join("abcdefghij" * 1)), (1001, " ".join("abcdefghij" * 6))]
    rows += [(1002, " ".join("klmnopqrst" * 2)), (1003, " ".join("klmnopqrst" * 9) + " end")]
    found, want = near_classes(spark, rows)
    assert [1002, 1003] in want and len(want) > 200 and found == want


def test_rare_pages_that_label_themselves_train_the_field(spark):
    plain = "<html><body><div><p>Some text of a page without a main element.</p></div></body></html>"
    told = "<html><body><nav><a href='/'>Home</a></nav><article><p>The one long text that says itself what it is, twice over.</p></article></body></html>"
    rows = [(i, "u", plain) for i in range(40)] + [(99, "u", told)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    least = pages.orderBy(F.xxhash64("page_id", "html")).first()
    assert least["page_id"] != 99
    found = {r["page_id"]: r["text"] for r in html.extracted(pages, sample=1).collect()}
    assert "The one long text" in found[99]


@pytest.mark.parametrize("text", ["_" * 10_000 + "ab", "a_" * 5_000 + "bb", "*a" * 5_000, "@$*1" * 25_000, "a. " * 10_000 + "bb", "*abc$1!" * 1_500])
def test_hostile_texts_are_scored_in_seconds(text):
    import time

    scorer = toxicity.Scorer(np.full(toxicity.SYMBOLS**4, -3.0, np.float32), {"idiot": 3.0}, (0.0, 1.0, 0.0))
    start = time.perf_counter()
    assert 0 <= scorer.score(text) <= 1
    assert time.perf_counter() - start < 10


def test_long_spans_are_read_to_their_end():
    model = np.full(toxicity.SYMBOLS**4, -3.0, np.float32)
    assert toxicity.decode("ab1" * 40, model).count("ab") == 40
    assert toxicity.spaced("x _ y _ z") == [] and toxicity.spaced("i.d.i.o.t now") == ["idiot"]


def test_decoding_agrees_with_all_readings():
    rng = np.random.default_rng(4)
    model = rng.normal(-3, 1, toxicity.SYMBOLS**4).astype(np.float32)

    def readings(span):
        out = [(0.0, "")]
        for run in toxicity._RUN.finditer(span):
            c, n = run.group(1), run.end() - run.start()
            letters = [(0.0, c)] if c.isalpha() else [(toxicity.SUBSTITUTED, x) for x in toxicity.LEET.get(c, "")]
            options = [(cost * n, x * n) for cost, x in letters] if n < 3 else [(cost + toxicity.REPEATED, x * k) for cost, x in letters for k in (1, 2)]
            if not c.isalnum():
                options.append(((toxicity.DROPPED_LEET if c in toxicity.LEET else toxicity.DROPPED) * n, ""))
            options = options or [(0.0, c)]
            out = [(a + cost, t + x) for a, t in out for cost, x in options]
        return out

    def worth(cost, text):
        codes = [0, 0, 0, *toxicity.symbols(text).tolist(), 0]
        return cost + sum(float(model[((codes[i] * 32 + codes[i + 1]) * 32 + codes[i + 2]) * 32 + codes[i + 3]]) for i in range(len(codes) - 3))

    for span in ["1d1ot", "st*p!d", "aaab$", "x.y-z", "60", "f**k", "a|+b"]:
        best = max(worth(*r) for r in readings(span))
        found = toxicity.decode(span, model)
        assert max(worth(c, t) for c, t in readings(span) if t == found) == pytest.approx(best, abs=1e-3)


def test_line_rules_look_at_the_length_of_the_line(spark):
    filler = " ".join(f"plain{i} words{i} follow here{i}." for i in range(110))
    texts = {
        1: filler + " Then bake each cookie slowly and eat it.",
        2: " ".join(f"Il{i} dit{i} « mot{i} » et part{i} vers la{i} ville{i}." for i in range(30)),
        3: "\n".join(f"文{i} 字{i} 列{i} は{i} ここ{i} に{i} あり{i} ます{i} ね{i} よ{i}。" for i in range(4)),
        4: "Accept every cookie now please or leave.\n" * 3,
        5: "home | news | shop | help | more | login. " * 3,
        6: "Buy!! it!! now!! or!! never!! see!! this!! offer!! again!! friend!! today.",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert [r["doc_id"] for r in quality.clean(docs).orderBy("doc_id").collect()] == [1, 2, 3]


def test_a_filter_on_the_verdict_does_not_repeat_the_work(spark):
    import time

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    rows = quality.rated(docs)
    for kept in (rows.where("kept"), rows.where("not base_failed")):
        assert plan(kept).count("split(") <= plan(rows).count("split(")
    start = time.perf_counter()
    assert 0 < quality.clean(docs).count() < docs.count()
    assert time.perf_counter() - start < 60


def test_items_of_few_words_are_found_whole(spark):
    items = spark.createDataFrame([(1, "lorem"), (2, "lorem ipsum dolor"), (3, "one two three four five six"), (4, " ?! ")], "item_id long, text string")
    rows = [(1, "a Lorem ipsum, dolor b"), (2, "lorem dolor ipsum"), (3, "x one two three four five y"), (4, "ipsum dolor"), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = decontamination.overlaps(docs, items).collect()
    assert {(r["doc_id"], r["item_id"], r["coverage"]) for r in found} == {(1, 1, 1.0), (1, 2, 1.0), (2, 1, 1.0), (3, 3, 5 / 6)}


def test_one_shared_phrase_does_not_pair_long_items(spark):
    start = "which of the following is"
    items = spark.createDataFrame([(i, f"{start} " + " ".join(f"w{i}x{k}" for k in range(40))) for i in range(20)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"{start} " + " ".join(f"d{i}x{k}" for k in range(60))) for i in range(20)] + [(99, items.first()["text"])], "doc_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontamination.overlaps(docs, items).collect()] == [(99, 0)]


@pytest.mark.parametrize("page", ["<div>a" * 50_000, "<b>a" * 50_000 + "<p>" * 10_000, "<li><div>a" * 20_000, "<div>" * 30_000 + "</x>" * 30_000, "<p><a>x" * 30_000, '<div class="k">t' * 30_000])
def test_deep_pages_take_time_that_grows_with_their_length(page):
    import time

    start = time.perf_counter()
    found = html.blocks(page)
    assert time.perf_counter() - start < 10
    assert all(len(b.tags) <= html.NEAREST for b in found)


def test_a_slash_does_not_close_a_script():
    page = '<body><script src=/js/>var code = 1;</script><article><p>Text</p><svg viewBox="0"/><p>More</p></article>'
    assert [b.text for b in html.blocks(page)] == ["Text", "More"]
    assert [b.text for b in html.blocks('<style/>p{}</style><p>One')] == ["One"]


def test_shards_keep_the_order_of_the_mix(spark, odd):
    docs = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    mixed = {r["doc_id"]: r["order"] for r in mixing.mixed(docs).select("doc.doc_id", "order").collect()}
    out = corpus_pipeline.sharding_stage(spark, common.stage(corpus_pipeline.mixing_stage(spark, docs, ""), "mixing"), "")
    rows = out.collect()
    assert out.columns == [*[c for c in docs.columns if c != "shard"], "mix_order", "shard", "shard_depth", "shard_bytes"]
    assert {r["doc_id"]: r["mix_order"] for r in rows} == mixed and len(set(mixed.values())) == len(rows)


def template_pattern(text):
    """The same template as a regular expression over words with one space behind each."""
    import re

    out = ""
    for part in re.split(r"(<<.*?>>)", text):
        if part == "<<optional>>":
            out += "(?:"
        elif part == "<</optional>>":
            out += ")?"
        elif part.startswith("<<var"):
            head, _, wordings = part[5:-2].partition(":")
            options = "|".join(" ".join(re.findall(r"[a-z0-9]+", w)) + " " for w in wordings.split("|"))
            out += f"(?:{options})" if wordings else rf"(?:[^ ]+ ){{0,{int(head)}}}"
        else:
            out += "".join(w + " " for w in re.findall(r"[a-z0-9]+", part))
    negated = "".join(f"(?<! {n} )" for n in licenses.NEGATIONS)
    return re.compile("(?<= )" + negated + out)


def test_labels_agree_with_regular_expressions(spark):
    import re

    rng = random.Random(12)
    patterns = {label: template_pattern(text) for label, text in licenses.TEMPLATES.items()}

    def written(text):
        out = []
        for part in re.split(r"(<<optional>>.*?<</optional>>|<<.*?>>)", text):
            if part.startswith("<<optional>>"):
                out.append(part[12:-13] if rng.random() < 0.5 else "")
            elif part.startswith("<<var"):
                head, _, wordings = part[5:-2].partition(":")
                out.append(rng.choice(wordings.split("|")) if wordings else " ".join(["someone"] * rng.randrange(int(head) + 2)))
            else:
                out.append(part)
        words = " ".join(out).split()
        if rng.random() < 0.3:
            words[rng.randrange(len(words))] = "changed"
        return " ".join(words)

    texts = []
    for text in [*licenses.TEMPLATES.values()] * 4:
        before = rng.choice(["", "it is", "it is not", "never", "a note"])
        texts.append(f"{before} {written(text)} {rng.choice(['', 'and more', written(rng.choice(list(licenses.TEMPLATES.values())))])}")
    docs = spark.createDataFrame([(i, t.upper() if i % 2 else t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in licenses.scanned(docs).collect()}
    seen = set()
    for i, text in enumerate(texts):
        line = " " + "".join(w + " " for w in re.findall(r"[a-z0-9]+", text.lower()))
        expected = {label for label, p in patterns.items() if p.search(line)}
        assert {m["label"] for m in rows[i]["matches"]} == expected, text
        assert rows[i]["score"] == (1.0 if expected else 0.5 if rows[i]["base_labels"] else 0.0)
        seen |= expected
    assert len(seen) > 0.85 * len(licenses.TEMPLATES)


def test_headers_in_the_wild(spark):
    texts = {
        1: "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.",
        2: "// SPDX-License-Identifier: Apache-2.0",
        3: "This work is not licensed under the MIT license.",
        4: "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.",
    }
    rows = {r["doc_id"]: r for r in licenses.scanned(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert {i: r["labels"] for i, r in rows.items()} == {1: "gpl,gpl-3.0-or-later", 2: "spdx-apache-2.0", 3: "mit", 4: "mpl-2.0"}
    assert rows[3]["score"] == 0.5
