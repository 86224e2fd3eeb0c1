"""Votes: how often and how surely each text is mentioned per id."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCORE_STEP = 1_000_000_000
HALF = 100_000
WINDOW_ROWS = 1_000_000


def _units(score: Column) -> Column:
    return F.round(score * SCORE_STEP).cast("bigint")


def strength(prefix: str = "") -> Column:
    """What votes are ordered by: occurrences first, then mean score; no score comes last."""
    return F.struct(
        F.col(prefix + "n_occur").alias("n_occur"),
        F.coalesce(F.col(prefix + "avg_score"), F.lit(-1.0)).alias("avg_score"),
    )


def count_votes(mentions: DataFrame) -> DataFrame:
    """``id, text, avg_score, n_occur, max_occur`` from ``id, text, score``.

    Scores are added as whole billionths, in two halves that cannot overflow, so
    the mean does not depend on the order of addition and equal scores tie.

    The group maximum is an aggregate joined back, not a window: both sides read
    the same shuffled counts, the maximum is combined before its shuffle, and a
    hot id is split by the skew join where a window would sort it in one task.
    """
    units = _units(F.col("score"))
    counted = mentions.groupBy("id", "text").agg(
        F.count(F.lit(1)).alias("n_occur"),
        F.count("score").alias("_n"),
        F.sum(F.expr(f"cast(round(score * {SCORE_STEP}) as bigint) div {HALF}")).alias("_high"),
        F.sum(units % HALF).alias("_low"),
    )
    total = F.col("_high").cast("decimal(28,0)") * HALF + F.col("_low")
    mean = F.round(total / F.nullif(F.col("_n"), F.lit(0))).cast("double") / SCORE_STEP
    votes = counted.select("id", "text", mean.alias("avg_score"), "n_occur")
    best = votes.groupBy("id").agg(F.max(strength()).alias("_best"))
    joined = votes.join(best, "id")
    return joined.select("id", "text", "avg_score", "n_occur", F.col("_best.n_occur").alias("max_occur"))


def majority(votes: DataFrame, more_than: int = 1) -> DataFrame:
    """Votes level with their id's maximum, where that is above ``more_than``."""
    return votes.filter((F.col("n_occur") == F.col("max_occur")) & (F.col("max_occur") > more_than))


def rank_votes(votes: DataFrame, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Add ``relevance_rank``: 1 for the strongest vote of an id, ties share a rank.

    Mean scores are compared as whole billionths, whatever their range; a missing
    one comes last. Ids with up to ``window_rows`` votes are ranked by a window. Larger
    ids are ranked by counting the same units, see ``_rank_large``, so ranks do not
    depend on ``window_rows``. ``votes`` is read several times: store it first if it
    is costly.
    """
    sizes = votes.groupBy("id").agg(F.count(F.lit(1)).alias("_votes"))
    sized = votes.join(sizes, "id").withColumn("_units", _units(F.col("avg_score")))
    order = Window.partitionBy("id").orderBy(F.col("n_occur").desc(), F.col("_units").desc_nulls_last())
    small = sized.filter(F.col("_votes") <= window_rows).withColumn("relevance_rank", F.rank().over(order))
    large = _rank_large(sized.filter(F.col("_votes") > window_rows))
    columns = [*votes.columns, "relevance_rank"]
    return small.select(*columns).unionByName(large.select(*columns))


def _rank_large(votes: DataFrame) -> DataFrame:
    """Rank by adding up how many votes lie in better groups, coarse to fine.

    Three levels: occurrences of an id, then the leading digits of the score, then
    its trailing digits. Votes are counted per level before each shuffle. With N
    mentions an id has fewer than 1.5 * sqrt(N) different occurrence counts (they
    add up to at most N). The two score levels have as many steps each as the square
    root of the measured range of the scores in billionths, 31,624 for scores in 0..1.
    """
    low, high = votes.agg(F.min("_units"), F.max("_units")).first()
    low, high = (0, 0) if low is None else (low - 1, high)
    step = math.isqrt(high - low) + 1
    units = F.coalesce(F.col("_units"), F.lit(low)) - low
    keyed = votes.withColumn("_coarse", F.floor(units / step)).withColumn("_fine", units - F.col("_coarse") * step)
    levels = ["id", "n_occur", "_coarse", "_fine"]
    ranked = keyed.withColumn("relevance_rank", F.lit(1).cast("bigint"))
    for depth in range(1, len(levels)):
        parent, steps = levels[:depth], levels[: depth + 1]
        sums = keyed.groupBy(*steps).agg(F.count(F.lit(1)).alias("_size"))
        better = Window.partitionBy(*parent).orderBy(F.col(levels[depth]).desc())
        better = better.rowsBetween(Window.unboundedPreceding, -1)
        ahead = sums.select(*steps, F.coalesce(F.sum("_size").over(better), F.lit(0)).alias("_ahead"))
        ranked = ranked.join(ahead, steps).withColumn("relevance_rank", F.col("relevance_rank") + F.col("_ahead"))
        ranked = ranked.drop("_ahead")
    return ranked.withColumn("relevance_rank", F.col("relevance_rank").cast("int"))
