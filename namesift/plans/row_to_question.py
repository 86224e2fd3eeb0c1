"""Dictionary rows to questions and search terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namesift.functions import fixed
from namesift.functions import text as X
from namesift.operators.linking import link_by_key


def film_questions(films: DataFrame, gold: DataFrame | None = None) -> DataFrame:
    """``title, question`` from ``title, director, actor_1..3, release_yr``.

    With ``gold`` (``title``) only its titles are asked about.
    """
    before, after = fixed.FILM_QUESTION_YEAR
    start = F.concat_ws("", F.lit(before), X.whole_number_text(F.col("release_yr")), F.lit(after))
    parts = [(prefix, X.display_name(F.col(c))) for prefix, c in fixed.FILM_QUESTION_PARTS]
    asked = films if gold is None else films.join(gold.select("title").distinct(), "title", "left_semi")
    return asked.select("title", X.row_question(start, parts, fixed.FILM_QUESTION_END).alias("question"))


def gold_titles(labelled: DataFrame, films: DataFrame, label: str = "movie") -> DataFrame:
    """Labels with the dictionary title that has the same canonical key, NULL without one."""
    titles = films.select("title").distinct()
    return link_by_key(labelled, titles, label, "title").distinct()


def film_search_terms(films: DataFrame) -> DataFrame:
    """``title, search_terms``: actors, director and year in one string."""
    year = X.whole_number_text(F.col("year"))
    names = [F.col(c) for c in ("actor_1", "actor_2", "actor_3", "director")]
    return films.select("title", X.search_terms(*names, year).alias("search_terms"))
