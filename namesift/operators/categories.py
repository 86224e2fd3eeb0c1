"""One category per text, learnt from labelled texts: a multinomial model over hashed words.

Everything the model knows are counts: words per category and slot, words per category, texts per category. They
are aggregated on the cluster, and weights are whole millionths, so scores are exact sums that do not depend on
the order of tasks. How far a text's best category leads, per word, is turned into a probability by how often
such a lead was right on texts the counts have not seen.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namesift.functions import fixed
from namesift.functions import text as X
from namesift.session import stage

# Slots words are hashed into: four hexadecimal digits of their digest. With the number of categories it bounds the model.
SLOTS = 1 << 16
CATEGORIES = 100
UNIT = 1_000_000
# Leads per word are put into so many classes, each so many units wide.
CLASSES, CLASS_UNITS = 20, 50_000
# Copies of a row that are written out from one list.
COPIES = 10_000


@dataclass(frozen=True)
class CategoryModel:
    """Categories, per category the units of a text and of an unseen word, and the tables of extra units and of leads."""

    categories: tuple[str, ...]
    prior: tuple[int, ...]
    unseen: tuple[int, ...]
    extra: DataFrame
    leads: DataFrame


def slot(word: Column) -> Column:
    return F.conv(F.substring(F.md5(word.cast("binary")), 1, 4), 16, 10).cast("int")


def fold(key: Column) -> Column:
    """A number from 0 to 255 that is spread evenly over keys and fixed for each."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 2), 16, 10).cast("int")


def _units(share: Column) -> Column:
    return F.round(F.log(share) * UNIT).cast("bigint")


def learn(labelled: DataFrame, key: str, text: str, label: str, held: Column) -> CategoryModel:
    """A model from rows with a label; those where ``held`` is true set the leads, all others the counts.

    Rows without a label or text teach nothing. Each slot counts one more than was seen. Counts are combined before they
    are shuffled: a task sends a row per slot and category at most, and one per category for its texts.
    """
    rows = labelled.select(key, F.col(text).alias("text"), F.col(label).cast("string").alias("label"), held.alias("held"))
    rows = rows.filter("text is not null and label is not null")
    teaching = rows.filter("not held")
    # Each text ends in one null word: rows without a slot count the texts.
    words = teaching.select("label", F.explode(F.array_append(X.tokens(F.col("text")), F.lit(None).cast("string"))).alias("word"))
    slots = words.select("label", slot(F.col("word")).alias("slot"))
    counts = stage(slots.groupBy("label", "slot").agg(F.count(F.lit(1)).alias("n")), "slots")
    a_text = F.col("slot").isNull()
    totals = counts.groupBy("label").agg(F.sum(F.when(a_text, F.col("n"))).alias("n_texts"), F.sum(F.when(~a_text, F.col("n"))).alias("n_words"))
    found = totals.orderBy("label").limit(CATEGORIES + 1).collect()
    if len(found) > CATEGORIES:
        raise ValueError(f"more than {CATEGORIES} categories")
    sizes, words = {r["label"]: r["n_texts"] for r in found}, {r["label"]: r["n_words"] or 0 for r in found}
    spark, categories = labelled.sparkSession, tuple(sorted(sizes))
    none = spark.createDataFrame([], "class int, p double")
    if not categories:
        return CategoryModel((), (), (), none, none)
    total = sum(sizes.values())
    priors = {c: F.lit(sizes[c]) / F.lit(total) for c in categories}
    unseen = {c: F.lit(1) / F.lit(words[c] + SLOTS) for c in categories}
    constants = spark.range(1).select(*[_units(priors[c]) for c in categories], *[_units(unseen[c]) for c in categories]).first()
    prior, low = tuple(constants[: len(categories)]), tuple(constants[len(categories) :])

    def extra(k: int, c: str) -> Column:
        seen = _units((F.col("n") + 1) / F.lit(words[c] + SLOTS)) - low[k]
        return F.coalesce(F.sum(F.when(F.col("label") == c, seen)), F.lit(0)).alias(f"e{k}")

    table = stage(counts.filter(~a_text).groupBy("slot").agg(*[extra(k, c) for k, c in enumerate(categories)]), "extra")
    model = CategoryModel(categories, prior, low, table, none)
    led = _led(rows.filter("held"), key, "text", model, "label")
    right = F.sum((F.col("category") == F.col("label")).cast("int"))
    leads = led.groupBy("class").agg(((right + 1) / (F.count(F.lit(1)) + 2)).alias("p"))
    return CategoryModel(categories, prior, low, table, stage(leads, "leads"))


def _led(df: DataFrame, key: str, text: str, model: CategoryModel, *others: str) -> DataFrame:
    """``key, others, category, class`` of every row with a text: its best category, and the class of its lead.

    Texts are read once: a row goes with its words, even if it has none or none the model knows, and words are summed per
    row before they are shuffled. Rows that share a key share the words of all of them; a null key has none.
    """
    n = len(model.categories)
    texts = df.select(key, *others, X.tokens(F.col(text)).alias("_words")).withColumn("n", F.size("_words").cast("bigint"))
    words = texts.select(key, *others, "n", F.explode_outer("_words").alias("word"))
    scored = words.withColumn("slot", slot(F.col("word"))).join(F.broadcast(model.extra), "slot", "left")
    # Rows that are alike so far go on as one with their number, so that a hot key has few.
    rows = scored.groupBy(key, *others, "n").agg(*[F.sum(f"e{k}").alias(f"e{k}") for k in range(n)], F.expr("count(1) div greatest(n, 1)").alias("copies"))
    shared = Window.partitionBy(key)
    joined = rows.select(key, *others, "n", "copies", *[F.when(F.col(key).isNotNull(), F.sum(f"e{k}").over(shared)).alias(f"e{k}") for k in range(n)])
    units = [F.struct((F.lit(model.prior[k]) + F.col("n") * model.unseen[k] + F.coalesce(f"e{k}", F.lit(0))).alias("units"), F.lit(-k).alias("first")) for k in range(n)]
    ordered = joined.withColumn("order", F.sort_array(F.array(*units), asc=False))
    lead = F.get("order", F.lit(0))["units"] - F.coalesce(F.get("order", F.lit(1))["units"], F.lit(0))
    number = F.least(F.lit(CLASSES - 1), F.floor(lead / (F.greatest("n", F.lit(1)) * CLASS_UNITS))).cast("int")
    names = F.array(*[F.lit(c) for c in model.categories])
    led = ordered.select(key, *others, "copies", F.get(names, -F.get("order", F.lit(0))["first"]).alias("category"), F.when(F.col("n") > 0, number).otherwise(-1).alias("class"))
    return _copied(led, "copies")


def _copied(df: DataFrame, copies: str) -> DataFrame:
    """Each row as often as ``copies`` says, block by block: a list of all copies of a hot row might not fit."""
    first = F.sequence(F.lit(1).cast("bigint"), F.col(copies), F.lit(COPIES).cast("bigint"))
    blocks = df.withColumn("_first", F.explode(first))
    last = F.least(F.col(copies), F.col("_first") + (COPIES - 1))
    return blocks.withColumn("_copy", F.explode(F.sequence("_first", last))).drop(copies, "_first", "_copy")


def classify(df: DataFrame, key: str, text: str, model: CategoryModel, least: float = 0.5, answer: str = "answer") -> DataFrame:
    """``key, answer, probability`` of every row; ``Unknown`` where the probability is below ``least``.

    ``key`` is one per row. A text without words, a null one, and a lead of a class that was never seen on held texts
    are ``Unknown`` with probability 0. The model is broadcast; words are summed per row before they are shuffled.
    """
    if not model.categories:
        return df.select(key, F.lit(fixed.UNKNOWN).alias(answer), F.lit(0.0).alias("probability"))
    led = _led(df.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text")), key, "_text", model)
    known = led.join(F.broadcast(model.leads.filter("class >= 0")), "class", "left")
    p = F.coalesce("p", F.lit(0.0))
    return known.select(key, F.when(p >= least, F.col("category")).otherwise(fixed.UNKNOWN).alias(answer), F.round(p, 6).alias("probability"))


def kept_categories(answers: DataFrame, answer: str, allowed: Sequence[str]) -> DataFrame:
    """``answers`` with everything outside ``allowed`` turned into ``Unknown``."""
    listed = functools.reduce(lambda a, b: a | b, [F.col(answer) == c for c in allowed], F.lit(False))
    return answers.withColumn(answer, F.when(listed, F.col(answer)).otherwise(fixed.UNKNOWN))
