"""Sentences by abbreviations the corpus itself shows.

An abbreviation is a word that is written with a point nearly always, whatever follows. So for
every word it is weighed how likely its counts with and without a point are if points fell on words by
chance, against if it nearly always had one. Nothing is listed by hand, so any language serves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namesift.functions import text as X
from namesift.operators.sizing import broadcast_if_small, measure
from namesift.session import stage

WORD = r"^[^\p{L}]*(\p{L}+([.]\p{L}+)*)([.]?)[^\p{L}.]*$"
SPACES = "[ \n\t\r]+"
# Share of points an abbreviation is held to have, and the score from which a word is one.
POINTED, LEAST_SCORE = 0.99, 0.3
LONGEST = 12


def word_points(docs: DataFrame, text: str = "text") -> DataFrame:
    """``type, n_with, n_without``: how often each lower-cased word of the corpus ends with a point and how often not.

    A point inside, as in "e.g.", belongs to the word. Counts are combined before the shuffle.
    """
    words = docs.select(F.explode(F.split(F.col(text), SPACES)).alias("word"))
    found = words.select(
        F.lower(F.regexp_extract("word", WORD, 1)).alias("type"), (F.regexp_extract("word", WORD, 3) == ".").alias("point")
    ).filter("type != ''")
    pointed = F.sum(F.col("point").cast("bigint"))
    return found.groupBy("type").agg(pointed.alias("n_with"), (F.count(F.lit(1)) - pointed).alias("n_without"))


def _log_likelihood(hits: Column, misses: Column, p: Column) -> Column:
    return hits * F.log(p) + misses * F.log(1 - p)


def abbreviations(points: DataFrame, least: float = LEAST_SCORE, longest: int = LONGEST) -> DataFrame:
    """``type, n_with, n_without, score`` of the words that are abbreviations, from the counts of all words.

    The likelihood ratio grows with what a word is seen; it is lowered for long words, for words that are often seen
    without a point, and raised for points inside. A word of more than ``longest`` letters is none. ``points`` should be a
    stored table: it is read twice.
    """
    totals = points.agg(F.sum("n_with").alias("a"), F.sum("n_without").alias("b")).first()
    with_point, without = totals["a"] or 0, totals["b"] or 0
    if not with_point:
        return points.limit(0).withColumn("score", F.lit(0.0))
    chance = F.lit(min(with_point / (with_point + without), 1 - 1e-9))
    letters = F.length(F.replace("type", F.lit("."), F.lit("")))
    inside = F.length("type") - letters + 1
    ratio = 2 * (_log_likelihood(F.col("n_with"), F.col("n_without"), F.lit(POINTED)) - _log_likelihood(F.col("n_with"), F.col("n_without"), chance))
    score = ratio * F.exp(-letters) * inside * F.pow(letters, -F.least("n_without", F.lit(300)))
    scored = points.filter((F.col("n_with") > 0) & (letters <= longest)).withColumn("score", F.round(score, 6))
    return scored.filter(F.col("score") >= least)


def split_sentences(docs: DataFrame, found: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``id, pos, sentence`` of every text, split after ``.``, ``!`` or ``?`` before white space.

    The point of a word in ``found`` (column ``type``) or of a single capital letter ends nothing. Texts are cut into pieces
    at all such places, the last words of the pieces look up the abbreviations, which are broadcast if
    measured as small, and pieces are put together again per text: a group is one text, never more. ``id_col`` is one per row.
    """
    marked = F.regexp_replace(F.col(text_col), "([.!?])(" + SPACES + ")", "$1" + X.SENTENCE_MARK + "$2")
    pieces = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(marked, X.SENTENCE_MARK)).alias("pos", "piece"))
    last = F.regexp_extract("piece", r"[^ \n\t\r]+$", 0)
    word = F.regexp_extract(last, WORD, 1)
    known = found.select(F.col("type").alias("_type"), F.lit(True).alias("_known")).distinct()
    size = measure(known, F.col("_type"))
    # One capital letter is an initial: it needs no lookup.
    pieces = pieces.withColumn("_initial", F.endswith(last, F.lit(".")) & word.rlike(r"^\p{Lu}$"))
    pieces = pieces.withColumn("_type", F.when(F.endswith(last, F.lit(".")), F.lower(word)))
    joined = pieces.join(broadcast_if_small(known, size), "_type", "left")
    ends = ~(F.coalesce("_known", F.lit(False)) | F.col("_initial"))
    before = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    numbered = joined.select("id", "pos", "piece", F.coalesce(F.sum(ends.cast("int")).over(before), F.lit(0)).alias("sentence"))
    gathered = numbered.groupBy("id", "sentence").agg(F.sort_array(F.collect_list(F.struct("pos", "piece"))).alias("p"))
    whole = F.regexp_replace(F.array_join("p.piece", ""), "^" + SPACES, "")
    return gathered.select("id", F.col("sentence").cast("int").alias("pos"), whole.alias("sentence")).filter("sentence != ''")


def learned_sentences(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Sentences of ``docs`` by the abbreviations of ``docs``: two aggregates over the corpus, then one pass."""
    points = stage(word_points(docs, text_col), "points")
    return split_sentences(docs, stage(abbreviations(points), "abbreviations"), id_col, text_col)
