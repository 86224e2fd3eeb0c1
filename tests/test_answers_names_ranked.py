"""Bucketed answers and cluster-wide rate, names in several writings, block-max retrieval."""

import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from namesift.functions import names
from namesift.operators import answers, inference, ranked
from namesift.plans import record_to_record


class Echo:
    name = model = "echo"

    def __init__(self, log=None, fail=0):
        self.log, self.fail, self.seen = log, fail, Counter()

    def answer(self, asked):
        if self.log:
            with open(self.log, "a") as out:
                out.write("".join(f"{time.time():.6f} {p}\n" for p in asked))
        for p in asked:
            self.seen[p] += 1
            if self.seen[p] <= self.fail:
                raise RuntimeError("not yet")
        return [p.upper() for p in asked]


def prompts_frame(spark, rows):
    return spark.createDataFrame([(i, p) for i, p in enumerate(rows)], "id int, prompt string")


# ---- cache ---------------------------------------------------------------------


def test_answers_are_kept_in_buckets_and_asked_once(spark, tmp_path):
    cache, log = answers.BucketedCache(answers.new_name(), 4), str(tmp_path / "calls")
    assert cache.read(spark) is None and cache.compact(spark) is None
    for rows in (["a", "b", None, "a"], ["b", "c", "a"]):
        out = inference.infer(prompts_frame(spark, rows), "prompt", Echo(log), cache=cache, waves=2)
        assert {r["id"]: r["answer"] for r in out.collect()} == {i: p and p.upper() for i, p in enumerate(rows)}
    assert sorted(line.split()[1] for line in open(log)) == ["a", "b", "c"]


def test_a_join_with_the_cache_does_not_move_it(spark):
    cache = answers.BucketedCache(answers.new_name(), 4)
    df = prompts_frame(spark, [f"p{i}" for i in range(50)])
    inference.infer(df, "prompt", Echo(), cache=cache, waves=2)
    kept = cache.read(spark).filter("answer is not null").groupBy("key").agg(F.min("answer").alias("answer"))
    asked = df.withColumn("key", inference.prompt_key(Echo(), F.col("prompt")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = asked.join(kept, "key", "left")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    side = plan[plan.index("FileScan") - 400 : plan.index("FileScan")]
    assert "Exchange" not in side


def test_compaction_keeps_one_answer_and_survives_a_lost_run(spark, monkeypatch):
    cache = answers.BucketedCache(answers.new_name(), 4)
    rows = [("k1", "B", 1), ("k1", "A", 2), ("k2", None, 20), ("k3", "C", 1)]
    cache.append(spark.createDataFrame([(*r, None, "echo", "echo") for r in rows], answers.CACHE_SCHEMA))
    cache.append(spark.createDataFrame([("k3", "C", 3, None, "echo", "echo")], answers.CACHE_SCHEMA))
    first = cache.table(spark)

    def lost(self, found, table, mode):
        found.sparkSession.range(1).write.saveAsTable(table)
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(answers.BucketedCache, "_write", lost)
        with pytest.raises(RuntimeError):
            cache.compact(spark)
    assert cache.table(spark) == first and cache.read(spark).count() == 5
    second = cache.compact(spark)
    assert second == cache.table(spark) != first
    assert sorted((r["key"], r["answer"], r["attempts"]) for r in cache.read(spark).collect()) == [("k1", "A", 2), ("k3", "C", 1)]
    cache.append(spark.createDataFrame([("k4", "D", 1, None, "echo", "echo")], answers.CACHE_SCHEMA))
    assert cache.read(spark).count() == 3 and spark.table(first).count() == 5


# ---- rate and devices -------------------------------------------------------------


def test_no_two_tasks_share_a_slot(monkeypatch):
    now = [1000.003]
    monkeypatch.setattr(inference.time, "time", lambda: now[0])
    monkeypatch.setattr(inference.time, "sleep", lambda s: now.__setitem__(0, now[0] + s))
    rng, used = random.Random(1), []
    for task in range(5):
        now[0] = 1000.003 + rng.random() * 0.3
        slots = inference.Slots(0.01, 5, task)
        for _ in range(40):
            slots.wait()
            used.append(slots.used)
            assert now[0] >= slots.used * 0.01 - 1e-6 and slots.used % 5 == task
            now[0] += rng.random() * 0.07
    assert len(set(used)) == len(used)


def test_the_rate_holds_over_tasks_and_retries(spark, tmp_path):
    log = str(tmp_path / "calls")
    df = prompts_frame(spark, [f"p{i}" for i in range(24)])
    calls = inference.Calls(attempts=3, wait=0.0, cluster_interval=0.03)
    out = inference.infer(df, "prompt", Echo(log, fail=1), calls=calls, max_parallel=4, waves=1)
    assert {r["answer"] for r in out.collect()} == {f"P{i}" for i in range(24)}
    moments = sorted(float(line.split()[0]) for line in open(log))
    assert len(moments) == 48
    slots = [math.floor(m / 0.03) for m in moments]
    assert max(Counter(slots).values()) <= 2 and moments[-1] - moments[0] >= 40 * 0.03


def test_devices_are_asked_for_where_the_model_is_called(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    seen, plain = [], Classic.mapInPandas

    def noted(self, func, schema, barrier=False, profile=None):
        seen.append(profile)
        return plain(self, func, schema, barrier)

    monkeypatch.setattr(Classic, "mapInPandas", noted)
    inference.infer(prompts_frame(spark, ["a"]), "prompt", Echo(), profile="gpu", waves=1)
    assert seen == ["gpu"]


# ---- names --------------------------------------------------------------------------


def plain_jaro_winkler(a, b):
    if not a or not b:
        return float(a == b)
    near, used, hits = max(max(len(a), len(b)) // 2 - 1, 0), set(), []
    for i, c in enumerate(a):
        for j in range(max(0, i - near), min(len(b), i + near + 1)):
            if j not in used and b[j] == c:
                used.add(j)
                hits.append(c)
                break
    if not hits:
        return 0.0
    k, moved = len(hits), sum(x != b[j] for x, j in zip(hits, sorted(used))) // 2
    s = (k / len(a) + k / len(b) + (k - moved) / k) / 3
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return s + min(4, same) * 0.1 * (1 - s) if s > 0.7 else s


def test_similarity_agrees_with_a_plain_loop(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randrange(9)))
    rows = [(word(), word()) for _ in range(300)] + [("martha", "marhta"), ("dwayne", "duane"), ("", ""), ("a", ""), ("x" * 64, "x" * 64)]
    df = spark.createDataFrame(rows, "a string, b string")
    for a, b, s in df.select("a", "b", names.jaro_winkler(F.col("a"), F.col("b"))).collect():
        assert s == pytest.approx(plain_jaro_winkler(a, b)), (a, b)
    missing = spark.createDataFrame([(None, "x")], "a string, b string").select(names.jaro_winkler(F.col("a"), F.col("b"))).first()
    assert missing[0] is None


@pytest.mark.parametrize(
    ("name", "plain"),
    [("Jürgen", "jurgen"), ("Łukasz", "lukasz"), ("GROSS-Weiß", "grossweiss"), ("  Æsa  Øst ", "aesa ost"), ("İnci", "inci"), ("12", ""), ("Zoë", "zoe")],
)
def test_folded(spark, name, plain):
    assert spark.createDataFrame([(name,)], "x string").select(names.folded(F.col("x"))).first()[0] == plain


@pytest.mark.parametrize(("a", "b", "same"), [("Philip", "Filipp", True), ("Catherine", "Katharina", True), ("Stefan", "Stephen", True), ("Meyer", "Meier", True), ("Anna", "Otto", False), ("", "", False)])
def test_names_that_sound_alike(spark, a, b, same):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(names.same_sound(F.col("a"), F.col("b"))).first()
    assert row[0] is same


def test_only_names_in_the_middle_are_asked(spark, tmp_path):
    log = str(tmp_path / "calls")

    class Yes(Echo):
        def answer(self, asked):
            super().answer([re.sub(r"\s", " ", p) for p in asked])
            return ["Y."] * len(asked)

    rows = [("Jürgen", "Jurgen Klop"), ("Bob", "Alice Ray"), ("Stefan", "Stephen Poe"), ("Mark", "Maria Sol"), ("?", "Ann"), (None, "Ann")]
    pairs = spark.createDataFrame(rows, "name string, full string")
    out = {r["name"]: r["is_first_name"] for r in record_to_record.judge_name_variants(pairs, "name", "full", Yes(log)).collect()}
    assert out == {"Jürgen": "Y", "Bob": "N", "Stefan": "Y", "Mark": "Y", "?": "Unknown", None: "Unknown"}
    assert len(open(log).read().splitlines()) == 1


# ---- retrieval -------------------------------------------------------------------------


def full_scores(pages, searches, n):
    words = {i: re.findall(r"\w+", t.lower()) for i, t in pages}
    mean = sum(map(len, words.values())) / len(words)
    df = Counter(w for ws in words.values() for w in set(ws))
    out = {}
    for key, text in searches:
        scores = Counter()
        for w, q in Counter(re.findall(r"\w+", text.lower())).items():
            if w in df:
                idf = math.floor(math.log(1 + (len(words) - df[w] + 0.5) / (df[w] + 0.5)) * 1000)
                for i, ws in words.items():
                    if tf := ws.count(w):
                        scores[i] += q * idf * math.floor(tf * 2200.0 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / mean)))
        for rank, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:n], 1):
            out[key, rank] = (i, s)
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(80)]
    weights = [80 / (i + 1) for i in range(80)]
    pages = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 60)))) for i in range(400)]
    searches = [(k, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 6)))) for k in range(25)] + [(99, "absent"), (98, ""), (97, None)]
    return pages, searches


@pytest.mark.parametrize(("block_pages", "first"), [(7, 1), (64, 2), (1_000, 2), (1, 3)])
def test_retrieval_agrees_with_scoring_all_pages(spark, texts, block_pages, first):
    pages, searches = texts
    expected = full_scores(pages, [(k, t or "") for k, t in searches], 4)
    index = ranked.build(spark.createDataFrame(pages, "page_id int, text string"), text=F.col("text"), block_pages=block_pages)
    frame = spark.createDataFrame(searches, "id int, text string")
    out = {(r["search_id"], r["rank"]): (r["page_id"], r["score"]) for r in ranked.retrieve(index, frame, "id", "text", 4, first).collect()}
    assert out == expected


def test_blocks_below_the_bar_are_not_read(spark, texts):
    pages, searches = texts
    index = ranked.build(spark.createDataFrame(pages, "page_id int, text string"), text=F.col("text"), block_pages=4)
    rows = ranked.postings_read(index, spark.createDataFrame(searches, "id int, text string"), "id", "text", 2).collect()
    assert all(r["n_read"] <= r["n_postings"] for r in rows)
    assert sum(r["n_read"] for r in rows) < 0.8 * sum(r["n_postings"] for r in rows)


def test_an_empty_index(spark):
    index = ranked.build(spark.createDataFrame([], "page_id int, text string"), text=F.col("text"))
    assert ranked.retrieve(index, spark.createDataFrame([(1, "x")], "id int, text string"), "id", "text").count() == 0
