import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from namesift.functions import prompts
from namesift.operators import inference


class Recorder:
    """Writes each call to a shared file; fails the first ``fail`` calls of every prompt."""

    name = "recorder"
    model = "m"

    def __init__(self, log, fail=0):
        self.log, self.fail, self.seen = str(log), fail, {}

    def answer(self, asked):
        with open(self.log, "a") as out:
            out.write("".join(p.replace("\n", " ") + "\n" for p in asked))
        for p in asked:
            self.seen[p] = self.seen.get(p, 0) + 1
            if self.seen[p] <= self.fail:
                raise RuntimeError("not yet")
        return [p.upper() for p in asked]


def calls_made(log):
    return sorted(open(log).read().split("\n")[:-1]) if os.path.exists(log) else []


DATA = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "a")]


def test_each_prompt_is_asked_once_and_kept(spark, tmp_path):
    df = spark.createDataFrame(DATA, "id int, prompt string")
    log, cache = tmp_path / "calls", str(tmp_path / "cache")
    out = inference.infer(df, "prompt", Recorder(log), cache=cache, max_parallel=2)
    expected = {1: "A", 2: "B", 3: "A", 4: None, 5: "A"}
    for _ in range(2):
        assert {r["id"]: r["answer"] for r in out.collect()} == expected
    assert calls_made(log) == ["a", "b"]
    more = df.union(spark.createDataFrame([(6, "c")], "id int, prompt string"))
    again = inference.infer(more, "prompt", Recorder(log), cache=cache)
    assert {r["id"]: r["answer"] for r in again.collect()} == {**expected, 6: "C"}
    assert calls_made(log) == ["a", "b", "c"]
    assert out.columns == ["id", "prompt", "answer"]


def test_retries_then_default(spark, tmp_path):
    df = spark.createDataFrame(DATA[:2], "id int, prompt string").coalesce(1)
    cache = str(tmp_path / "cache")
    few = inference.Calls(attempts=3, wait=0.001)
    failed = inference.infer(df, "prompt", Recorder(tmp_path / "x", fail=3), cache=cache, calls=few)
    assert [r["answer"] for r in failed.collect()] == ["Unknown", "Unknown"]
    kept = inference._read_cache(df, cache)
    assert {(r["answer"], r["attempts"]) for r in kept.collect()} == {(None, 3)}
    later = inference.infer(df, "prompt", Recorder(tmp_path / "y", fail=2), cache=cache, calls=few)
    assert sorted(r["answer"] for r in later.collect()) == ["A", "B"]


def test_waits_grow_and_stop_at_the_budget(monkeypatch):
    waits = []
    monkeypatch.setattr(inference.time, "sleep", waits.append)

    class Broken:
        name = model = "broken"

        def answer(self, asked):
            raise RuntimeError("down")

    assert inference._ask(Broken(), inference.Calls(), ["p"]) == [(None, 20)]
    assert waits == [float(k) for k in range(1, 21)] and sum(waits) == 210


def test_interval_between_calls(monkeypatch):
    waits = []
    monkeypatch.setattr(inference.time, "sleep", waits.append)

    class Echo:
        name = model = "echo"

        def answer(self, asked):
            return asked

    assert inference._ask(Echo(), inference.Calls(min_interval=0.25), ["p"]) == [("p", 0)]
    assert waits == [0.25]


def test_another_model_has_its_own_answers(spark, tmp_path):
    df = spark.createDataFrame([(1, "say 12 and é")], "id int, text string")
    df = df.withColumn("prompt", prompts.entity_prompt(F.col("text"), "number"))
    cache = str(tmp_path / "cache")
    first = inference.infer(df, "prompt", inference.PatternBackend("[0-9]+"), cache=cache)
    second = inference.infer(df, "prompt", inference.PatternBackend("[a-z]+"), cache=cache)
    cue = inference.infer(df, "prompt", inference.CueBackend((("x!", "no"), ("é", "fr"))), cache=cache)
    assert [r.first()["answer"] for r in (first, second, cue)] == ["12", "say", "fr"]


@pytest.mark.parametrize("answer, kept", [("Total Deaths", "total deaths"), ("total", "Unknown"), (None, "Unknown"), ("new deaths", "new deaths")])
def test_keep_allowed(spark, answer, kept):
    df = spark.createDataFrame([(answer,)], "x string")
    assert df.select(inference.keep_allowed(F.col("x"), ["total deaths", "new deaths"])).first()[0] == kept


def test_only_pairs_the_rule_rejects_are_asked(spark, tmp_path):
    from namesift.plans.record_to_record import judge_first_names

    names = [("Mara", "Mara Quist"), ("Mara", "Quist Mara"), ("Mara", "Quist Mara"), (None, "Mara")]
    pairs = spark.createDataFrame(names, "host string, owner string")
    log = tmp_path / "calls"
    judged = judge_first_names(pairs, "host", "owner", Recorder(log), cache=str(tmp_path / "cache"))
    got = sorted(r["is_first_name"][:12] for r in judged.collect())
    assert got == ["Unknown", "Y", '[{"ROLE":"US', '[{"ROLE":"US']
    assert len(calls_made(log)) == 1


def test_many_short_prompts_are_answered_by_several_tasks(spark, tmp_path):
    df = spark.range(20_000).select("id", F.concat(F.lit("p"), "id").alias("prompt"))
    cache = str(tmp_path / "cache")
    out = inference.infer(df, "prompt", Recorder(tmp_path / "log"), cache=cache, calls=inference.Calls(batch=1000), waves=1)
    files = [f for _, _, names in os.walk(cache) for f in names if f.endswith(".parquet")]
    assert len(files) > 1 and out.filter("answer = upper(prompt)").count() == 20_000


def test_a_failing_run_keeps_earlier_waves(spark, tmp_path, monkeypatch):
    df = spark.range(64).select("id", F.concat(F.lit("p"), "id").alias("prompt"))
    cache, real = str(tmp_path / "cache"), inference.functools.partial
    made = []

    def partial(*args):
        made.append(args)
        if len(made) == 3:
            raise RuntimeError("stopped in the third wave")
        return real(*args)

    monkeypatch.setattr(inference, "functools", SimpleNamespace(partial=partial))
    with pytest.raises(RuntimeError):
        inference.infer(df, "prompt", Recorder(tmp_path / "log"), cache=cache)
    monkeypatch.undo()
    kept = inference._read_cache(df, cache).count()
    assert 0 < kept < 64
    before = len(calls_made(tmp_path / "log"))
    inference.infer(df, "prompt", Recorder(tmp_path / "log"), cache=cache)
    assert before == kept and len(calls_made(tmp_path / "log")) == 64
