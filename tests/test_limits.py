"""What may not grow with the input: broadcasts, batches sent to Python, rows kept per task."""

import random
import re

import pandas as pd
import pytest
from catalog.queries import QUERIES
from namesift.operators import linking, retrieval, sizing
from namesift.session import stage
from pyspark.sql import functions as F

from tests.test_operators import brute_top


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_grams_are_never_broadcast_by_the_size_of_files(spark, monkeypatch):
    from namesift.operators import sizing

    texts = spark.createDataFrame([(k, f"title number {k} of these pages") for k in range(50)], "id int, norm string")
    assert "BroadcastHashJoin" not in plan_of(linking.with_anchor(texts, "norm"))
    monkeypatch.setattr(sizing, "BROADCAST_ROWS", 1)
    entries = texts.select(texts["id"].alias("entry"), texts["norm"].alias("entry_text"))
    found = linking.resolve_text(texts.withColumnRenamed("norm", "text"), entries)
    assert "BroadcastHashJoin" not in plan_of(found) and found.count() == 50


def test_entries_of_one_text_all_match(spark):
    texts = spark.createDataFrame([(1, "see the dark knight rise"), (2, "dark")], "id int, text string")
    entries = [(7, "The Dark Knight"), (3, "the dark  knight"), (3, "the dark knight"), (3, "knight rise"), (None, "the dark knight")]
    found = linking.resolve_text(texts, spark.createDataFrame(entries, "entry int, entry_text string"))
    got = sorted((r["id"], r["entry"]) for r in found.collect())
    assert got == [(1, 3), (1, 3), (1, 7), (2, 3), (2, 3), (2, 7)]


class Reader:
    name = "reader"
    model = "length"

    def answer(self, asked):
        return [str(len(p)) for p in asked]


def test_prompts_reach_python_in_bounded_batches_and_do_not_return(spark):
    from namesift.operators import inference

    texts = spark.range(4000).repartition(1).select("id", F.repeat(F.lit("x"), 20_000).alias("text"))
    sizes = texts.mapInPandas(lambda batches: (pd.DataFrame({"n": [len(b)], "chars": [int(b["text"].str.len().sum())]}) for b in batches), "n long, chars long")
    most = sizes.agg(F.max("n").alias("n"), F.max("chars").alias("chars"), F.sum("n").alias("all")).first()
    assert most["n"] <= 1024 and most["chars"] <= 9_000_000 and most["all"] == 4000
    part = pd.DataFrame({"key": ["k"], "prompt": ["xx"]})
    for keep, prompt in ((True, "xx"), (False, None)):
        got = next(inference._answer_batches(Reader(), inference.Calls(), 1, keep, iter([part])))
        assert got["answer"].tolist() == ["2"] and got["prompt"].tolist() == [prompt]


def test_near_dedup_of_the_pipeline_follows_simhash_links(spark):
    import random

    import corpus_pipeline
    from namesift.llm import simhash

    rnd = random.Random(1310)
    words = [f"w{rnd.randrange(60)}" for _ in range(90)]
    changed = list(words)
    for i in rnd.sample(range(90), 5):
        changed[i] = f"v{rnd.randrange(999)}"
    one, two = " ".join(words), " ".join(changed)
    assert (simhash.fingerprint(one.encode()) ^ simhash.fingerprint(two.encode())).bit_count() == 2
    docs = spark.createDataFrame([(4, two), (3, one), (9, "a text of its own, unlike the others")], "doc_id long, text string")
    assert simhash.near_groups(docs).isEmpty()
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()) == [3, 9]


def test_texts_tagged_side_by_side_give_what_each_gives_alone():
    import random

    import numpy as np
    from namesift.operators import tagger

    rnd, rng = random.Random(3), np.random.default_rng(3)
    model = tagger.Model.empty(["ARTICLE", "LICENSE", "WORD"])
    model.own[:], model.pairs[:], model.scale = rng.normal(size=model.own.shape), rng.normal(size=model.pairs.shape), 0.5
    vocabulary = ["Der", "der", "Ünder", "x1", "the", "LICENSE", "is", "ß"]
    texts = [[rnd.choice(vocabulary) for _ in range(rnd.choice((0, 1, 2, 9, 70)))] for _ in range(90)]
    alone, together = [model.spans(words) for words in texts], model.spans_of(texts)
    assert [[s[:3] for s in of] for of in together] == [[s[:3] for s in of] for of in alone]
    assert all(abs(a[3] - b[3]) < 1e-9 for x, y in zip(alone, together, strict=True) for a, b in zip(x, y, strict=True))
    for words in filter(None, texts):
        assert np.array_equal(tagger._scores_of(model.own, [words]), model.scores(tagger.word_features(words)))
    assert model.spans_of([]) == [] and model.spans_of([[], ["the"]])[0] == []


# A shuffle of a score for every page and search: its tasks grow with the pages.
PAGE_SCORES_MOVE = r"hashpartitioning\(search_id#\d+L?, page_id"


def test_pages_are_scored_in_the_buckets_of_the_index(spark):
    found = QUERIES["retrieve_pages"](spark, "/root/testdata/sf0.001")
    assert found.count() > 0
    plan = plan_of(found)
    assert "Bucketed: true" in plan and re.search(r"hashpartitioning\(search_id#", plan)
    assert not re.search(PAGE_SCORES_MOVE, plan)


@pytest.mark.parametrize(("rare_pages", "rows", "looked_up"), [(0, None, False), (3, None, False), (9, None, True), (9, 0, True), (1000, 0, False)])
def test_a_stored_index_has_bounded_buckets_of_whole_pages(spark, monkeypatch, rare_pages, rows, looked_up):
    pick = random.Random(4)
    pages = [(k, " ".join(pick.choices(["the", "of", "in", *(f"w{i}" for i in range(30))], [9, 6, 5, *[1] * 30], k=14))) for k in range(60)]
    searches = [(k, " ".join(f"w{pick.randrange(30)}" for _ in range(3)) + " the of") for k in range(12)] + [(99, "the of"), (98, "missing")]
    text = sum(len(t) for _, t in pages)
    monkeypatch.setattr(retrieval, "BUCKET_BYTES", text // 20)
    if rows is not None:
        monkeypatch.setattr(sizing, "BROADCAST_ROWS", rows)
    staged = []
    monkeypatch.setattr(retrieval, "stage", lambda df, name: staged.append(name) or stage(df, name))
    index = retrieval.store(spark.createDataFrame(pages, "page_id int, html string"))
    files = index.select("page_id", F.input_file_name().alias("file")).distinct().collect()
    assert len(files) == len(pages) and len({r["file"] for r in files}) > 8
    got = retrieval.retrieve_pages(index, len(pages), spark.createDataFrame(searches, "sid int, q string"), "sid", "q", 2, rare_pages)
    expected = brute_top(pages, searches, 2)
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected)
    assert ("found" in staged) == looked_up
