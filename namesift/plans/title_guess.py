"""Guess a title from the titles of retrieved pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namesift.functions import text as X
from namesift.operators.mentions import count_tokens


def guess_title(results: DataFrame, key: str = "search_term", title: str = "title") -> DataFrame:
    """``key, word``: the most frequent title words that the search term does not hold.

    Words are counted across all titles of a search term; level words are joined
    in alphabetical order. Counts are combined before each shuffle, and the last
    step gathers only the words of the top count.
    """
    words = F.explode(F.split(F.lower(F.translate(title, "_", " ")), " "))
    rows = results.select(key, words.alias("word")).filter(F.col("word") != "")
    counts = count_tokens(rows, key).filter(~F.contains(F.lower(key), F.col("word")))
    best = counts.groupBy(key).agg(F.max("count").alias("count"))
    kept = counts.join(best, [key, "count"], "left_semi")
    gathered = kept.groupBy(key).agg(F.sort_array(F.collect_list("word")).alias("words"))
    return gathered.select(key, F.array_join("words", " ").alias("word"))


def title_results(top_pages: DataFrame, pages: DataFrame) -> DataFrame:
    """Retrieved pages with their titles: ``search_id, page_id, title``."""
    titles = pages.select("page_id", X.page_title(F.col("html")).alias("title"))
    return top_pages.join(titles, "page_id").select("search_id", "page_id", "title")
