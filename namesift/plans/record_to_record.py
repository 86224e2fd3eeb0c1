"""Record pairs to judgements: the rule first, the model for what it does not accept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namesift.functions import names, prompts
from namesift.functions import text as X
from namesift.operators import inference


def judge_first_names(
    pairs: DataFrame,
    name: str,
    full_name: str,
    backend: inference.Backend,
    cache: str | None = None,
    calls: inference.Calls = inference.Calls(),
    max_parallel: int | None = None,
) -> DataFrame:
    """Add ``is_first_name``: ``Y``, ``N`` or ``Unknown``.

    Pairs the rule accepts are not sent; each other pair of names is asked once.
    """
    ruled = X.first_name_match(F.col(name), F.col(full_name)) == "Y"
    question = F.when(~ruled, prompts.first_name_prompt(F.col(name), F.col(full_name)))
    asked = pairs.withColumn("_question", question)
    answered = inference.infer(asked, "_question", backend, "_judged", cache, calls, max_parallel)
    verdict = F.when(ruled, "Y").otherwise(F.coalesce(X.clean_answer(F.col("_judged")), F.lit("Unknown")))
    return answered.withColumn("is_first_name", verdict).drop("_question", "_judged")


def judge_name_variants(
    pairs: DataFrame,
    name: str,
    full_name: str,
    backend: inference.Backend,
    accept: float = 0.9,
    refuse: float = 0.7,
    cache: str | inference.AnswerCache | None = None,
    calls: inference.Calls = inference.Calls(),
    max_parallel: int | None = None,
) -> DataFrame:
    """Add ``similarity`` and ``is_first_name`` (``Y``, ``N`` or ``Unknown``) for names written in several ways.

    Names are compared with their letters folded. From similarity ``accept``, or if they sound alike and reach
    ``refuse``, it is the name; below ``refuse`` it is not. Only pairs in between are put to the model, each pair of
    names once. A name without letters is ``Unknown``.
    """
    compared = pairs.withColumn("similarity", names.name_similarity(F.col(name), F.col(full_name)))
    alike = names.same_sound(F.col(name), F.col(full_name))
    s = F.col("similarity")
    ruled = F.when(s.isNull(), "Unknown").when((s >= accept) | (alike & (s >= refuse)), "Y").when(s < refuse, "N")
    compared = compared.withColumn("_ruled", ruled)
    asked = compared.withColumn("_question", F.when(F.col("_ruled").isNull(), prompts.first_name_prompt(F.col(name), F.col(full_name))))
    answered = inference.infer(asked, "_question", backend, "_judged", cache, calls, max_parallel)
    verdict = F.coalesce("_ruled", X.clean_answer(F.col("_judged")), F.lit("Unknown"))
    return answered.withColumn("is_first_name", verdict).drop("_question", "_judged", "_ruled")
