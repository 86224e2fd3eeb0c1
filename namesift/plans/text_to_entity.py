"""Free text to entity: cheap votes first, the model for what they leave open."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namesift.functions import prompts
from namesift.functions import text as X
from namesift.operators import inference, matching, routing, votes


def first_pass(mentions: DataFrame, gold: DataFrame, entity: str) -> DataFrame:
    """Votes for mentions of one type, matched with ``gold`` (``id, gold``)."""
    chosen = mentions.filter(F.col("entity_detected") == entity)
    labelled = chosen.select("id", X.normalize_label(F.col("text")).alias("text"), "score")
    return matching.match_votes(votes.count_votes(labelled), gold)


def second_pass(
    corpus: DataFrame,
    matched: DataFrame,
    backend: inference.Backend,
    entity: str,
    more_than: int = 1,
    min_score: float = 0.0,
    cache: str | None = None,
    calls: inference.Calls = inference.Calls(),
    max_parallel: int | None = None,
) -> DataFrame:
    """Rows of ``corpus`` (``id, text, ..``) the votes leave open, with the model's cleaned ``answer``."""
    settled = routing.settled_ids(matched, more_than, min_score)
    open_rows = routing.route_uncertain(corpus, settled)
    asked = open_rows.withColumn("_prompt", prompts.entity_prompt(F.col("text"), entity))
    answered = inference.infer(asked, "_prompt", backend, cache=cache, calls=calls, max_parallel=max_parallel)
    return answered.withColumn("answer", X.clean_answer(F.col("answer"))).drop("_prompt")


def first_pass_score(matched: DataFrame, more_than: int = 1, min_score: float = 0.0) -> DataFrame:
    """``n_correct, n_attempted`` over settled ids: is the deciding vote a match?"""
    settled = routing.settled_ids(matched, more_than, min_score)
    ranks = matching.first_match_rank(matched.join(settled, "id", "left_semi"), ids=settled)
    return ranks.agg(
        F.count(F.when(F.col("rank_first_match") == 1, 1)).alias("n_correct"),
        F.count(F.lit(1)).alias("n_attempted"),
    )
