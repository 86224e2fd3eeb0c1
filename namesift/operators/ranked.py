"""The best pages per search by BM25, reading only blocks of the index that can matter.

Pages are dealt into blocks, and for every word and block the index holds the word's postings in that block together
with the largest of them. The sum of a search's largest postings bounds every page of a block. The most
promising blocks of a search are scored first; the last page then among the best sets a bar, and only blocks whose
bound reaches it are read at all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namesift.functions import text as X
from namesift.operators.retrieval import query_terms
from namesift.session import stage

# The usual saturation of word counts and weight of page length.
K1, B = 1.2, 0.75
UNIT = 1000
BLOCK_PAGES = 64
FIRST_BLOCKS = 2


@dataclass(frozen=True)
class BlockIndex:
    """``blocks``: word, block, largest impact and postings; ``words``: word, weight of a match; both stored."""

    blocks: DataFrame
    words: DataFrame
    n_pages: int
    n_blocks: int


def impact(tf: Column, length: Column, mean: float) -> Column:
    """Whole thousandths of what a word's count says about a page; counts saturate, long pages are held back."""
    return F.floor(tf * F.lit((K1 + 1) * UNIT) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * length / F.lit(mean)))).cast("bigint")


def build(pages: DataFrame, page_id: str = "page_id", text: Column | None = None, block_pages: int = BLOCK_PAGES) -> BlockIndex:
    """Index of ``pages``, one row per word and block.

    A page goes to a block by a hash of its id, so blocks are even whatever the ids; a row's postings are no more than a
    block's pages. Pages without a word count towards the number of pages only.
    """
    words = X.tokens(X.page_text(F.col("html")) if text is None else text)
    rows = stage(pages.select(F.col(page_id).alias("page_id"), words.alias("words")), "page-words")
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("words")).alias("mean")).first()
    n_pages, mean = totals["n"], float(totals["mean"] or 1) or 1.0
    n_blocks = max(1, -(-n_pages // block_pages))
    counted = rows.select("page_id", F.size("words").alias("length"), F.explode("words").alias("term"))
    counted = counted.groupBy("page_id", "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    block = F.pmod(F.xxhash64("page_id"), F.lit(n_blocks)).cast("int").alias("block")
    posting = F.struct("page_id", impact(F.col("tf"), F.col("length"), mean).alias("impact"))
    blocks = counted.select("term", block, posting.alias("p")).groupBy("term", "block")
    blocks = blocks.agg(F.max("p.impact").alias("most"), F.count(F.lit(1)).alias("n"), F.collect_list("p").alias("postings"))
    blocks = stage(blocks, "blocks")
    df = F.sum("n")
    idf = F.log(1 + (F.lit(n_pages) - df + 0.5) / (df + 0.5))
    weights = blocks.groupBy("term").agg(F.floor(idf * UNIT).cast("bigint").alias("idf"), df.alias("df"))
    return BlockIndex(blocks, stage(weights, "words"), n_pages, n_blocks)


def _best(scores: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("search_id").orderBy(F.col("score").desc(), "page_id")
    ranked = scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    return ranked.select("search_id", "page_id", "score", "rank")


def _scored(index: BlockIndex, wanted: DataFrame, terms: DataFrame) -> DataFrame:
    """Scores of all pages of the wanted blocks (search_id, block); only these blocks' postings are unpacked."""
    needed = wanted.select("search_id", "block").join(terms, "search_id")
    read = needed.join(index.blocks.select("term", "block", "postings"), ["term", "block"])
    hits = read.select("search_id", "weight", F.explode("postings").alias("p"))
    return hits.groupBy("search_id", "p.page_id").agg(F.sum(F.col("weight") * F.col("p.impact")).alias("score"))


def _plan(index: BlockIndex, searches: DataFrame, key: str, text: str, n: int, first: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Words of the searches, bounds per block, scores of the first blocks, and the other blocks that reach the bar."""
    terms = query_terms(searches, key, text).join(index.words, "term")
    terms = stage(terms.select("search_id", "term", (F.col("qtf") * F.col("idf")).alias("weight")).filter("weight > 0"), "terms")
    largest = terms.join(index.blocks.select("term", "block", "most"), "term")
    bounds = stage(largest.groupBy("search_id", "block").agg(F.sum(F.col("weight") * F.col("most")).alias("bound")), "bounds")
    order = Window.partitionBy("search_id").orderBy(F.col("bound").desc(), "block")
    top = stage(bounds.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= first).drop("_r"), "first-blocks")
    scored = stage(_scored(index, top, terms), "first-scores")
    bar = _best(scored, n).groupBy("search_id").agg(F.min("score").alias("bar"), F.count(F.lit(1)).alias("k")).filter(F.col("k") == n)
    rest = bounds.join(top.select("search_id", "block"), ["search_id", "block"], "left_anti")
    rest = rest.join(bar.select("search_id", "bar"), "search_id", "left").filter(F.col("bound") >= F.coalesce("bar", F.lit(0)))
    return terms, top, scored, stage(rest.select("search_id", "block"), "other-blocks")


def retrieve(index: BlockIndex, searches: DataFrame, key: str, text: str, n: int = 5, first: int = FIRST_BLOCKS) -> DataFrame:
    """The ``n`` best pages per search: ``search_id, page_id, score, rank``; ties go to the smaller page.

    Scores are whole numbers, so they are exact. The result is that of scoring every page, for any size of blocks and
    any number of ``first`` blocks.
    """
    terms, _, scored, rest = _plan(index, searches, key, text, n, first)
    return _best(scored.unionByName(_scored(index, rest, terms)), n)


def postings_read(index: BlockIndex, searches: DataFrame, key: str, text: str, n: int = 5, first: int = FIRST_BLOCKS) -> DataFrame:
    """``search_id, n_postings, n_read``: how many postings the words of a search have, and how many are read for it."""
    terms, top, _, rest = _plan(index, searches, key, text, n, first)
    sizes = terms.select("search_id", "term").join(index.blocks.select("term", "block", F.col("n").alias("size")), "term")
    read = top.select("search_id", "block").unionByName(rest).withColumn("read", F.lit(1))
    both = sizes.join(read, ["search_id", "block"], "left")
    return both.groupBy("search_id").agg(F.sum("size").alias("n_postings"), F.sum(F.col("size") * F.coalesce("read", F.lit(0))).alias("n_read"))
