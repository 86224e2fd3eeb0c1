"""Votes against gold labels: match types, ranks of the first match, reciprocal rank, hits at k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesift.functions import text as X
from namesift.operators.votes import strength


def match_votes(votes: DataFrame, gold: DataFrame, strict_reference: bool = False) -> DataFrame:
    """Add gold label and match columns to votes.

    ``gold`` is ``id, gold``. ``match_type``, ``match_code`` and ``majority_match``
    look only at votes level with the maximum; ``any_match`` at all of them. An
    empty text matches nothing unless ``strict_reference`` is set.
    """
    labels = gold.select("id", "gold", X.normalize_label(F.col("gold")).alias("gold_norm"))
    joined = votes.join(labels, "id", "left")
    leads = F.col("n_occur") == F.col("max_occur")
    kind = X.match_type(F.col("text"), F.col("gold_norm"), strict_reference)
    joined = joined.withColumn("_any", kind)
    joined = joined.withColumn("match_type", F.when(leads, F.col("_any")).otherwise("none"))
    return (
        joined.withColumn("match_code", X.match_code(F.col("match_type")))
        .withColumn("majority_match", (F.col("match_code") > 0).cast("int"))
        .withColumn("any_match", (F.col("_any") != "none").cast("int"))
        .drop("_any")
    )


def curated_overrides(matched: DataFrame, overrides: DataFrame) -> DataFrame:
    """The matched votes whose ``(id, text)`` a curator listed."""
    return matched.join(overrides.select("id", "text").distinct(), ["id", "text"], "left_semi")


def apply_overrides(matched: DataFrame, overrides: DataFrame, match_col: str = "any_match") -> DataFrame:
    """Count a listed ``(id, text)`` as a match. It keeps its own rank among the votes."""
    listed = overrides.select("id", "text", F.lit(1).alias("_listed")).distinct()
    joined = matched.join(listed, ["id", "text"], "left")
    return joined.withColumn(match_col, F.coalesce("_listed", match_col)).drop("_listed")


def first_match_rank(
    matched: DataFrame, match_col: str = "any_match", ids: DataFrame | None = None
) -> DataFrame:
    """``id, rank_first_match, reciprocal_rank``: rank of each id's best matching vote.

    The rank is one more than the number of stronger votes, so it needs the best
    match per id and a count, both combined before their shuffle, and no window.
    With ``ids`` every id is listed, and one without a match has a NULL rank and
    scores 0; a miss therefore is never a hit at any k. ``matched`` is read twice:
    store it first if it is costly.
    """
    best = matched.filter(F.col(match_col) == 1).groupBy("id").agg(F.max(strength()).alias("_best"))
    ahead = (strength() > F.col("_best")).cast("bigint")
    ranks = matched.join(best, "id").groupBy("id").agg((F.sum(ahead) + 1).alias("rank_first_match"))
    if ids is not None:
        ranks = ids.select("id").distinct().join(ranks, "id", "left")
    return ranks.select(
        "id", "rank_first_match", X.reciprocal_rank(F.col("rank_first_match")).alias("reciprocal_rank")
    )


def mrr(ranks: DataFrame) -> DataFrame:
    return ranks.agg(F.round(F.avg("reciprocal_rank"), 6).alias("mrr"))


def hits_at_k(ranks: DataFrame, ks: Sequence[int] = (1, 5, 20)) -> DataFrame:
    """``k, n_ids, n_hits, share`` for all k from one aggregate over one set of ids.

    ``ranks`` has one row per id, so hits are a plain conditional count.
    """

    def hits(k: int) -> Column:
        return F.count(F.when(F.col("rank_first_match") <= k, 1))

    one_row = ranks.agg(F.count(F.lit(1)).alias("n_ids"), *[hits(k).alias(f"_{k}") for k in ks])
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_{k}").alias("n_hits")) for k in ks])
    rows = one_row.select("n_ids", F.explode(pairs).alias("p")).select("p.k", "n_ids", "p.n_hits")
    share = F.round(F.col("n_hits") / F.nullif(F.col("n_ids"), F.lit(0)), 6)
    return rows.withColumn("share", share)


def rank_histogram(ranks: DataFrame) -> DataFrame:
    return ranks.groupBy("rank_first_match").agg(F.count(F.lit(1)).alias("n_in_rank"))
