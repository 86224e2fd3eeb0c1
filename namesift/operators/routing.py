"""Which ids the cheap pass has settled, and which go on to the model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namesift.operators.votes import strength


def settled_ids(votes: DataFrame, more_than: int = 1, min_score: float = 0.0) -> DataFrame:
    """Ids whose votes decide: one strongest text, enough occurrences, enough score.

    Votes of equal strength are counted first, so the strongest group of an id and
    how many texts share it come from two combinable aggregates.
    """
    level = votes.groupBy("id", strength().alias("s")).agg(F.count(F.lit(1)).alias("n_texts"))
    top = level.groupBy("id").agg(F.max(F.struct("s", "n_texts")).alias("top"))
    decided = (
        (F.col("top.s.n_occur") > more_than)
        & (F.col("top.n_texts") == 1)
        & (F.col("top.s.avg_score") >= min_score)
    )
    return top.filter(decided).select("id")


def matched_ids(matched: DataFrame, more_than: int = 1) -> DataFrame:
    """Ids whose majority vote equals the gold label: needs labels, for replaying reported numbers."""
    kept = (F.col("majority_match") == 1) & (F.col("max_occur") > more_than)
    return matched.filter(kept).select("id").distinct()


def route_uncertain(corpus: DataFrame, settled: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows of ``corpus`` whose id is not settled, ids without any mention included."""
    keys = settled.select(F.col("id").alias(id_col))
    return corpus.join(keys, id_col, "left_anti")
