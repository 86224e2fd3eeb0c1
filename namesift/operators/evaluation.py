"""Answers and mentions against gold labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesift.functions import fixed
from namesift.functions import text as X


def share(part: Column, whole: Column, digits: int = 6) -> Column:
    return F.round(part / F.nullif(whole, F.lit(0)), digits)


def labels_long(df: DataFrame, id_cols: Sequence[str], label_cols: Sequence[str]) -> DataFrame:
    """Wide gold labels to one row per label; missing labels give no row: ``.., col, label``."""
    return df.unpivot(list(id_cols), list(label_cols), "col", "label").filter(F.col("label").isNotNull())


def mention_accuracy(mentions: DataFrame, gold: DataFrame) -> DataFrame:
    """How many gold ``(id, label)`` pairs have an equal mention.

    Both sides are reduced to different pairs before the join, so a mention that
    repeats in a hot id travels once.
    """
    wanted = gold.select("id", F.col("label").alias("text")).distinct().withColumn("_gold", F.lit(1))
    found = mentions.select("id", "text").distinct().withColumn("_found", F.lit(1))
    both = wanted.join(found, ["id", "text"], "full")
    return both.agg(
        F.count("_gold").alias("n_gold"),
        F.count("_found").alias("n_mentions"),
        F.count(F.when(F.col("_gold").isNotNull() & F.col("_found").isNotNull(), 1)).alias("n_equal"),
    ).withColumn("accuracy", share(F.col("n_equal"), F.col("n_gold")))


def missed_labels(gold: DataFrame, mentions: DataFrame) -> DataFrame:
    """Gold rows ``(id, .., label)`` that no mention equals, for review."""
    found = mentions.select("id", F.col("text").alias("label")).distinct()
    return gold.join(found, ["id", "label"], "left_anti")


def _lenient(df: DataFrame, answer: str, gold: str) -> Column:
    sides = F.struct(X.normalize_label(F.col(gold)).alias("gold"), X.normalize_label(F.col(answer)).alias("answer"))
    return X.bind(sides, lambda pair: X.matches(pair["gold"], pair["answer"]))


def answer_accuracy(df: DataFrame, answer: str = "answer", gold: str = "gold") -> DataFrame:
    """Answers that equal, contain or are contained in the label, out of all answers."""
    answered = F.col(answer).isNotNull()
    hit = answered & _lenient(df, answer, gold)
    return df.agg(
        F.count(F.when(hit, 1)).alias("n_matches"), F.count(F.when(answered, 1)).alias("n_obs")
    ).withColumn("accuracy", share(F.col("n_matches"), F.col("n_obs")))


def answer_misses(df: DataFrame, answer: str = "answer", gold: str = "gold") -> DataFrame:
    """Answered rows the lenient check rejects, for a person to read."""
    return df.filter(~_lenient(df, answer, gold)).filter(F.col(answer).isNotNull())


def classification_report(df: DataFrame, answer: str = "answer", gold: str = "gold") -> DataFrame:
    """Coverage, and accuracy among classified rows, in one aggregate."""
    classified = X.is_answered(F.col(answer))
    correct = classified & (F.col(gold) == F.lower(F.col(answer)))
    equal = F.coalesce((F.col(gold) == F.col(answer)).cast("int"), F.lit(0))
    counts = df.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count(F.when(classified, 1)).alias("n_classified"),
        F.count(F.when(correct, 1)).alias("n_correct"),
        F.round(F.avg(equal), 2).alias("share_equal"),
    )
    return counts.withColumn("coverage", share(F.col("n_classified"), F.col("n_total"))).withColumn(
        "accuracy", share(F.col("n_correct"), F.col("n_classified"))
    )


def error_review(df: DataFrame, answer: str = "answer", gold: str = "gold") -> DataFrame:
    """Rows that are classified, but differently from the label."""
    wrong = X.bind(F.lower(F.col(answer)), lambda a: (a != fixed.UNKNOWN.lower()) & (a != F.col(gold)))
    return df.filter(wrong)


def cascade_accuracy(passes: DataFrame) -> DataFrame:
    """Accuracy over several passes from ``n_correct, n_attempted`` rows."""
    total = passes.agg(F.sum("n_correct").alias("n_correct"), F.sum("n_attempted").alias("n_attempted"))
    return total.withColumn("accuracy", share(F.col("n_correct"), F.col("n_attempted")))
