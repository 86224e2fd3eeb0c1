"""What may not lie on disk: shuffles of stages that are done, and whole tables of texts dealt out for a few of them."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from namesift.llm import common, simhash
from namesift.operators import sizing
from namesift.session import stage


def shuffle_files(spark):
    roots = [Path(p) for p in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    return {p.name for root in roots for p in root.rglob("shuffle_*")}


def texts(spark):
    """Ten texts of their own, each with a near copy, and one written twice."""
    rnd, rows = random.Random(7), []
    for i in range(10):
        words = [f"w{rnd.randrange(10_000)}" for _ in range(120)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:-1], "changed"]))]
    rows += [(50, "a text that is written twice and has no near copy")] * 2
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_a_stage_lets_go_of_its_shuffles(spark):
    before, name = shuffle_files(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    kept = spark.conf.get(name, "false")
    done = stage(spark.range(5000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert shuffle_files(spark) <= before and spark.conf.get(name, "false") == kept
    assert done.count() == 7


def test_rows_are_dropped_without_moving_texts(spark):
    docs = texts(spark)
    gone = stage(docs.where("doc_id < 3").select(common.row_key("doc_id", "text").alias("row")), "gone")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = common.without_rows(docs, gone)
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
        assert left.count() == docs.count() - 3
        few = stage(spark.createDataFrame([(4,), (50,), (77,)], "id long"), "few")
        found = common.with_ids(docs.withColumnRenamed("doc_id", "id"), few)
        assert sorted(r["id"] for r in found.collect()) == [4, 50]
        assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == [*range(0, 20, 2), 50]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_texts_fetched_in_parts_give_the_same_copies(spark, monkeypatch):
    docs = texts(spark)
    whole = sorted(tuple(r) for r in simhash.near_groups(docs).collect())
    monkeypatch.setattr(sizing, "BROADCAST_ROWS", 4)
    assert len(whole) == 22 and sorted(tuple(r) for r in simhash.near_groups(docs).collect()) == whole


def test_texts_that_share_a_passage_only_do_not_move(spark, monkeypatch):
    rnd, rows = random.Random(11), []

    def own(n):
        return [f"v{rnd.randrange(10**6)}" for _ in range(n)]

    for i in range(20):
        passage = own(14)
        rows += [(2 * i, " ".join(passage + own(186))), (2 * i + 1, " ".join(own(186) + passage))]
    rows.append((99, rows[0][1] + " end"))
    staged = {}

    def kept(df, name):
        done = stage(df, name)
        staged[name] = staged.get(name, 0) + done.count()
        return done

    # One text as the sample, as in a large table, where it knows next to none of the passages.
    monkeypatch.setattr(simhash, "SAMPLE_ROWS", 1)
    monkeypatch.setattr(simhash, "stage", kept)
    monkeypatch.setattr(common, "stage", kept)
    found = simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in found.collect()) == [0, 99]
    assert staged.get("met", 9) > 2 and staged["compared"] == 2
