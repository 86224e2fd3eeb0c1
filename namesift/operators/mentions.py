"""Typed, scored mentions in text.

Every extractor returns ``id, pos, text, entity_detected, score``; a text without
mentions gives no row.
"""

from __future__ import annotations

import functools
import logging
from collections.abc import Iterator, Mapping, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namesift.functions import text as X
from namesift.operators.sizing import broadcast_if_small, measure

MENTION_COLUMNS = ["id", "pos", "text", "entity_detected", "score"]
KEY_WORDS = 3
FIRST_WORDS = 10_000
TAGGED_AT_ONCE = 256
FAILED = "FAILED"

logger = logging.getLogger(__name__)


def split_sentences(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """One row per sentence: ``id, pos, sentence``."""
    return docs.select(
        F.col(id_col).alias("id"), F.posexplode(X.sentences(F.col(text_col))).alias("pos", "sentence")
    )


def extract_patterns(
    docs: DataFrame, patterns: Mapping[str, str], id_col: str = "id", text_col: str = "text", score: float | None = 1.0
) -> DataFrame:
    """Mentions found by one regular expression per entity type, in one pass over the text.

    All patterns search the text together, so mentions come in text order, ``pos``
    numbers them in that order, and they do not overlap: where several patterns fit at
    one place, the one listed first takes it. A pattern may not look beyond its match.
    """
    either = "|".join(f"(?:{pattern})" for pattern in patterns.values())

    def typed(hit: Column) -> Column:
        kinds = [F.when(hit.rlike(f"^(?:{pattern})$"), F.lit(kind)) for kind, pattern in patterns.items()]
        return F.struct(hit.alias("text"), F.coalesce(*kinds).alias("entity_detected"))

    every = F.transform(F.regexp_extract_all(F.col(text_col), F.lit(either), F.lit(0)), typed)
    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(every).alias("pos", "m"))
    return rows.select(
        "id", "pos", "m.text", "m.entity_detected", F.lit(score).cast("double").alias("score")
    )


def extract_gazetteer(
    docs: DataFrame, dictionary: DataFrame, id_col: str = "id", text_col: str = "text"
) -> DataFrame:
    """Mentions of dictionary phrases: every place where a phrase's words occur in a row.

    ``dictionary`` has ``phrase, text, entity_detected, score``; a mention carries
    the entry's ``text``, so several phrases can name one entity.

    Words are joined on at most three words at a time. A longer phrase is looked
    up by its first three and then checked against the words that follow, so the
    text grows at most threefold whatever the phrase lengths. The exploded rows
    carry no document text, but for the words that follow where a longer phrase begins. If the beginnings
    of longer phrases are too many to list, their places are looked up in the text again by id. With up to ``FIRST_WORDS`` entries only places whose
    word starts some phrase are exploded. A dictionary measured as small is
    broadcast, and then nothing is shuffled.
    """
    entries = dictionary.select(
        X.tokens(F.col("phrase")).alias("_words"), F.col("text"), F.col("entity_detected"), F.col("score")
    ).filter(F.size("_words") > 0)
    n_words = F.size("_words")
    entries = entries.select(
        F.least(n_words, F.lit(KEY_WORDS)).alias("_k"),
        F.get("_words", F.lit(0)).alias("_first"),
        F.array_join(F.slice("_words", 1, KEY_WORDS), " ").alias("_key"),
        F.when(n_words > KEY_WORDS, F.array_join("_words", " ")).alias("_long"),
        n_words.alias("_n"),
        "text",
        "entity_detected",
        "score",
    )
    size = measure(
        entries,
        F.concat_ws(" ", "_key", "_long", "text", "entity_detected"),
        kinds=F.collect_set("_k"),
        longest=F.max("_n"),
    )
    if not size["rows"]:
        return docs.select(F.col(id_col).alias("id")).crossJoin(entries.limit(0)).select(
            "id", F.lit(0).alias("pos"), "text", "entity_detected", "score"
        )

    firsts: dict[int, list[str]] = {}
    long_keys: list[str] | None = []
    if size["longest"] > KEY_WORDS:
        found = entries.filter("_long is not null").select("_key").distinct().limit(FIRST_WORDS + 1).collect()
        long_keys = sorted(r["_key"] for r in found) if len(found) <= FIRST_WORDS else None
    if size["rows"] <= FIRST_WORDS:
        for row in entries.select("_k", "_first").distinct().collect():
            firsts.setdefault(row["_k"], []).append(row["_first"])
    words = docs.select(F.col(id_col).alias("id"), X.tokens(F.col(text_col)).alias("_w"))

    def grams(k: int):
        def gram(i):
            key, window = X.word_run(F.col("_w"), i, k), F.lit(None).cast("string")
            if k == KEY_WORDS and long_keys:
                window = F.when(key.isin(*long_keys), F.array_join(F.slice("_w", i + 1, F.lit(size["longest"])), " "))
            return F.struct(i.alias("pos"), key.alias("_key"), window.alias("_window"))

        places = F.sequence(F.lit(0), F.size("_w") - k)
        if firsts:
            places = F.filter(places, lambda i: F.get("_w", i).isin(*sorted(firsts[k])))
        none = F.array().cast("array<struct<pos:int,_key:string,_window:string>>")
        return F.when(F.size("_w") >= k, F.transform(places, gram)).otherwise(none)

    pieces = [grams(k) for k in sorted(size["kinds"])]
    rows = words.select("id", F.explode(F.concat(*pieces)).alias("g")).select("id", "g.*")
    hits = rows.join(broadcast_if_small(entries.drop("_k", "_first"), size), "_key")
    if long_keys is None:
        begun = hits.filter("_long is not null").join(words.select(F.col("id").alias("_id"), "_w"), F.col("id") == F.col("_id"))
        begun = begun.filter(F.array_join(F.slice("_w", F.col("pos") + 1, F.col("_n")), " ") == F.col("_long"))
        return hits.filter("_long is null").select(*MENTION_COLUMNS).unionByName(begun.select(*MENTION_COLUMNS))
    follows = F.col("_long").isNull() | F.startswith(
        F.concat(F.col("_window"), F.lit(" ")), F.concat(F.col("_long"), F.lit(" "))
    )
    return hits.filter(follows).select(*MENTION_COLUMNS)


class Tagger(Protocol):
    """A mention model: for each text a list of (mention, type, score)."""

    def tag(self, texts: list[str]) -> list[list[tuple[str, str, float]]]: ...


def _tag(tagger: Tagger, texts: list[str]) -> list[list]:
    tagged = tagger.tag(texts)
    if len(tagged) != len(texts):
        raise ValueError("a tagger must return one list per text")
    return tagged


def _tag_batches(tagger: Tagger, size: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def tag_one(text: str) -> list:
        try:
            return _tag(tagger, [text])[0]
        except Exception:
            logger.warning("a text could not be tagged", exc_info=True)
            return [(None, FAILED, None)]

    for batch in batches:
        for start in range(0, len(batch), size):
            part = batch.iloc[start : start + size]
            texts = part["text"].tolist()
            try:
                tagged = _tag(tagger, texts)
            except Exception:
                tagged = [tag_one(text) for text in texts]
            rows = [
                (key, pos, mention, kind, score)
                for key, mentions in zip(part["id"], tagged)
                for pos, (mention, kind, score) in enumerate(mentions)
            ]
            yield pd.DataFrame(rows, columns=MENTION_COLUMNS)


def extract_with(
    docs: DataFrame,
    tagger: Tagger,
    id_col: str = "id",
    text_col: str = "text",
    batch: int = TAGGED_AT_ONCE,
    keep_failed: bool = False,
) -> DataFrame:
    """Mentions from a user's model, called with at most ``batch`` texts at a time.

    A call that fails, or that returns another number of lists than it was given texts,
    is repeated text by text. A text that fails on its own does not stop the job: it
    gives no mentions, or with ``keep_failed`` one row of type ``FAILED`` without text.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    key_type = rows.schema["id"].dataType.simpleString()
    found = rows.mapInPandas(
        functools.partial(_tag_batches, tagger, batch),
        f"id {key_type}, pos int, text string, entity_detected string, score double",
    )
    return found if keep_failed else found.filter(F.col("text").isNotNull())


def extract_by_sentence(
    docs: DataFrame, tagger: Tagger, id_col: str = "id", text_col: str = "text", batch: int = TAGGED_AT_ONCE
) -> DataFrame:
    """Mentions from a user's model that reads one sentence at a time, numbered through each text.

    A text's mentions are ordered by sentence and then by place, in a window that holds
    no more than the text does.
    """
    pieces = split_sentences(docs, id_col, text_col).select(F.struct("id", "pos").alias("at"), "sentence")
    found = extract_with(pieces, tagger, "at", "sentence", batch)
    order = Window.partitionBy("id.id").orderBy("id.pos", "pos")
    return found.select(
        F.col("id.id").alias("id"), (F.row_number().over(order) - 1).alias("pos"), "text", "entity_detected", "score"
    )


def filter_mentions(mentions: DataFrame, entities: Sequence[str], include: bool = True) -> DataFrame:
    """Keep the listed entity types, or everything else."""
    listed = F.col("entity_detected").isin(*entities)
    return mentions.filter(listed if include else ~listed)


def search_text(mentions: DataFrame, id_col: str = "id") -> DataFrame:
    """The different mentions of each id in order of appearance, joined by spaces: ``id, word``.

    Copies of a mention are dropped before the shuffle that gathers an id, so an
    id gathers no more text than its own source row holds.
    """
    once = mentions.groupBy(id_col, "text", "entity_detected").agg(F.min("pos").alias("pos"))
    gathered = once.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("pos", "entity_detected", "text"))).alias("m"))
    return gathered.select(F.col(id_col).alias("id"), F.array_join(F.col("m.text"), " ").alias("word"))


def count_tokens(words: DataFrame, key: str = "search_term", word: str = "word") -> DataFrame:
    """How often each word occurs per key."""
    return words.groupBy(key, word).agg(F.count(F.lit(1)).alias("count"))
