"""Pages for a search term, ranked by TF-IDF over an inverted index."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namesift.functions import text as X
from namesift.operators import sizing
from namesift.session import stage, stage_path

RARE_PAGES = 100_000
IDF_STEP = 1000
BUCKET_BYTES = 8 * 1024 * 1024


def postings(pages: DataFrame, page_id: str = "page_id", text: Column | None = None) -> DataFrame:
    """``page_id, term, tf``: how often each word occurs on each page."""
    words = X.tokens(X.page_text(F.col("html")) if text is None else text)
    rows = pages.select(F.col(page_id).alias("page_id"), F.explode(words).alias("term"))
    return rows.groupBy("page_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def store(pages: DataFrame, page_id: str = "page_id", text: Column | None = None) -> DataFrame:
    """The postings as a stored table whose pages are dealt by id into buckets of some ``BUCKET_BYTES`` of text.

    A bucket holds its pages whole and is read by one task. So pages are scored where they lie, without moving a score
    of every page and search, and what a task holds is bounded by its bucket, however many pages there are.
    """
    spark = pages.sparkSession
    size = sizing.measure(pages, F.col("html") if text is None else text)
    buckets = max(-(-size["bytes"] // BUCKET_BYTES), spark.sparkContext.defaultParallelism)
    rows = postings(pages.repartition(buckets, page_id), page_id, text)
    name = f"postings_{uuid.uuid4().hex}"
    rows.write.format("parquet").option("path", stage_path(spark, "postings")).bucketBy(buckets, "page_id").saveAsTable(name)
    return spark.table(name)


def query_terms(searches: DataFrame, key: str, text: str) -> DataFrame:
    rows = searches.select(F.col(key).alias("search_id"), F.explode(X.tokens(F.col(text))).alias("term"))
    return rows.groupBy("search_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def _top(scores: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("search_id").orderBy(F.col("score").desc(), "page_id")
    ranked = scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    return ranked.select("search_id", "page_id", "score", "rank")


def retrieve_pages(
    index: DataFrame,
    n_pages: int,
    searches: DataFrame,
    key: str,
    text: str,
    n: int = 5,
    rare_pages: int = RARE_PAGES,
) -> DataFrame:
    """The ``n`` best pages per search: ``search_id, page_id, score, rank``.

    The score adds tf times idf over the shared words, with idf in whole
    thousandths, so it is exact and ties break by page. A word whose idf rounds to
    zero says nothing about a page, and a page that shares only such words is no
    result. ``index`` should come from ``store``: it is read several times, and other
    tables are scored with a shuffle of all pages that a search finds.

    Words on more than ``rare_pages`` pages are not expanded where they need not be.
    Rare words propose pages first, and the n-th best proposal of a search is its
    bar. Of the common words, those that together cannot lift a page to the bar are
    set aside: a page has to hold one of the other words to be among the best. Words
    set aside are then looked up for the proposed pages alone. Results are the
    same for any ``rare_pages``.
    """
    weights = index.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("tf").alias("max_tf"))
    weights = weights.withColumn("idf", F.round(F.log(F.lit(float(n_pages)) / F.col("df")) * IDF_STEP).cast("bigint"))
    terms = query_terms(searches, key, text).join(weights.filter("idf > 0"), "term")
    terms = terms.select(
        "search_id", "term", (F.col("qtf") * F.col("idf")).alias("weight"), "max_tf", (F.col("df") > rare_pages).alias("common")
    )
    terms = stage(terms, "terms")
    size = sizing.measure(terms, F.col("term"))

    def total(hits: DataFrame) -> DataFrame:
        return hits.groupBy("search_id", "page_id").agg(F.sum(F.col("weight") * F.col("tf")).alias("score"))

    def score(wanted: DataFrame) -> DataFrame:
        return total(index.join(sizing.broadcast_or_merge(wanted, size), "term"))

    common = terms.filter("common")
    rare = terms.filter("not common").select("search_id", "term", "weight")
    if common.isEmpty():
        return _top(score(rare), n)
    bar = _top(score(rare), n).groupBy("search_id").agg(F.min("score").alias("_bar"), F.count(F.lit(1)).alias("_n"))
    bar = bar.filter(F.col("_n") == n).select("search_id", "_bar")
    upto = Window.partitionBy("search_id").orderBy(F.col("weight") * F.col("max_tf"), "term")
    reach = common.withColumn("_reach", F.sum(F.col("weight") * F.col("max_tf")).over(upto))
    reach = stage(
        reach.join(bar, "search_id", "left").select("search_id", "term", "weight", (F.col("_reach") < F.coalesce("_bar", F.lit(0))).alias("aside")),
        "common-terms",
    )
    # Rare words are scored again with the needed ones: that is done inside the buckets, adding up stored proposals is not.
    needed = rare.unionByName(reach.filter("not aside").drop("aside"))
    aside = reach.filter("aside").drop("aside")
    if aside.isEmpty():
        return _top(score(needed), n)
    unfinished = aside.select("search_id").distinct()
    found = stage(score(needed.join(unfinished, "search_id", "left_semi")), "found")
    lookups = found.select("search_id", "page_id").join(sizing.broadcast_or_merge(aside, size), "search_id")
    held = index.join(sizing.broadcast_or_merge(aside.select("term").distinct(), size), "term", "left_semi")
    added = total(lookups.join(held.hint("merge"), ["page_id", "term"]))
    lifted = found.unionByName(added).groupBy("search_id", "page_id").agg(F.sum("score").alias("score"))
    return _top(score(needed.join(unfinished, "search_id", "left_anti")).unionByName(lifted), n)
