"""Model answers for prompts: each different prompt is asked once and kept."""

from __future__ import annotations

import functools
import json
import logging
import math
import re
import time
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark import TaskContext
from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesift.functions import fixed
from namesift.functions import text as X
from namesift.operators.answers import CACHE_SCHEMA, AnswerCache, FolderCache
from namesift.session import stage, stage_path

WAVES = 4

logger = logging.getLogger(__name__)


class Backend(Protocol):
    """A model: ``answer`` returns one text per prompt or raises."""

    name: str
    model: str

    def answer(self, prompts: list[str]) -> list[str]: ...


@dataclass(frozen=True)
class PatternBackend:
    """Answers with the first match of a pattern in one message of the prompt, else ``Unknown``."""

    pattern: str
    message: int = 1
    name: str = "pattern"

    @property
    def model(self) -> str:
        return f"{self.message}:{self.pattern}"

    def answer(self, prompts: list[str]) -> list[str]:
        found = re.compile(self.pattern)
        hits = (found.search(json.loads(p)[self.message]["content"]) for p in prompts)
        return [hit.group(0) if hit else fixed.UNKNOWN for hit in hits]


@dataclass(frozen=True)
class CueBackend:
    """Answers with the first category one of whose cues occurs in the message, else ``Unknown``."""

    cues: tuple[tuple[str, str], ...]
    message: int = 1
    name: str = "cue"

    @property
    def model(self) -> str:
        return f"{self.message}:{self.cues}"

    def answer(self, prompts: list[str]) -> list[str]:
        texts = [json.loads(p)[self.message]["content"] for p in prompts]
        return [next((name for cue, name in self.cues if cue in t), fixed.UNKNOWN) for t in texts]


@dataclass(frozen=True)
class Calls:
    """How a model is called: failed attempts allowed, growth of the wait, gap between calls.

    ``min_interval`` is the gap between the calls of one task, ``cluster_interval`` that between all calls of the
    cluster, first and repeated ones alike.
    """

    attempts: int = fixed.MAX_FAILED_ATTEMPTS
    wait: float = fixed.FIRST_WAIT_SECONDS
    min_interval: float = 0.0
    batch: int = 1
    cluster_interval: float = 0.0


@dataclass
class Slots:
    """The moments at which one of ``parallel`` tasks may call: no two tasks share one.

    Time is cut into slots of ``interval`` seconds from a moment all machines know, and slot number s belongs to
    task s modulo ``parallel``. So tasks that know nothing of each other, start late or repeat calls never exceed one call
    per slot together, as far as clocks agree. A task that Spark repeats takes over the slots of the one that failed.
    """

    interval: float
    parallel: int
    task: int
    used: int = -1

    def wait(self) -> None:
        """Sleep until the next own slot that has not begun and was not used."""
        now = time.time()
        number = max(self.used + 1, math.ceil(now / self.interval))
        self.used = number + (self.task - number) % self.parallel
        time.sleep(max(0.0, self.used * self.interval - now))


def _ask(backend: Backend, calls: Calls, prompts: list[str], slots: Slots | None = None) -> list[tuple[str | None, int]]:
    """Answers with the number of failed attempts; after the last one the answer is None.

    The wait grows by ``calls.wait`` with every failure.
    """
    for failed in range(calls.attempts):
        if calls.min_interval:
            time.sleep(calls.min_interval)
        if slots is not None:
            slots.wait()
        try:
            answers = backend.answer(prompts)
            if len(answers) != len(prompts):
                raise ValueError("a backend must return one answer per prompt")
            return [(answer, failed) for answer in answers]
        except Exception:
            logger.warning("model call failed, attempt %d", failed + 1, exc_info=True)
            time.sleep(calls.wait * (failed + 1))
    return [(None, calls.attempts) for _ in prompts]


def _answer_batches(backend: Backend, calls: Calls, parallel: int, keep_prompts: bool, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    task = TaskContext.get()
    slots = Slots(calls.cluster_interval, parallel, task.partitionId() if task else 0) if calls.cluster_interval else None
    for rows in batches:
        prompts = rows["prompt"].tolist()
        answered: list[tuple[str | None, int]] = []
        for start in range(0, len(prompts), calls.batch):
            answered += _ask(backend, calls, prompts[start : start + calls.batch], slots)
        yield rows.assign(
            backend=backend.name,
            model=backend.model,
            answer=[answer for answer, _ in answered],
            attempts=[failed + (answer is not None) for answer, failed in answered],
            prompt=prompts if keep_prompts else None,
        )[["key", "answer", "attempts", "prompt", "backend", "model"]]


def _read_cache(df: DataFrame, cache: str | AnswerCache, backend: Backend | None = None) -> DataFrame | None:
    """Kept answers, of one backend and model if given."""
    kept = (FolderCache(cache) if isinstance(cache, str) else cache).read(df.sparkSession)
    if kept is None or backend is None:
        return kept
    return kept.filter((F.col("backend") == backend.name) & (F.col("model") == backend.model))


def prompt_key(backend: Backend, prompt: Column) -> Column:
    """Digest of backend, model and prompt; NULL for a NULL prompt.

    Joins go by this key alone, so a prompt nobody selects later is not shuffled.
    """
    return F.sha2(F.concat(F.lit(f"{backend.name}\u001f{backend.model}\u001f"), prompt), 256)


def infer(
    df: DataFrame,
    prompt: str,
    backend: Backend,
    answer: str = "answer",
    cache: str | AnswerCache | None = None,
    calls: Calls = Calls(),
    max_parallel: int | None = None,
    default: str = fixed.UNKNOWN,
    waves: int = WAVES,
    keep_prompts: bool = False,
    profile: ResourceProfile | None = None,
) -> DataFrame:
    """Add the backend's answer to every row.

    Different prompts without a kept answer are asked in ``mapInPandas`` tasks and
    written to ``cache``, a parquet folder by backend and model (a fresh one if none is
    named) or a bucketed table, before anything reads them, so a later action or a lost executor calls no
    model again beyond the tasks that were running. They are asked in ``waves`` by
    ranges of their key, each committed on its own, so a run that fails late keeps
    what earlier waves were answered. Prompt texts are kept only on request. Spark may run a task twice; reading the
    cache takes one answer per key, so the stored answer stays single-valued. A
    prompt that failed to the end gets ``default`` and is asked again next run.

    ``max_parallel`` sets how many calls run at once, by default one per core of the
    cluster; with ``calls.cluster_interval`` the rate holds for the whole cluster. ``profile`` asks for the
    executors and devices that the tasks calling the model need, and for no other stage. Rows with a NULL
    prompt get a NULL answer and take no part in the join.
    """
    cache = cache or stage_path(df.sparkSession, "answers")
    store = FolderCache(cache) if isinstance(cache, str) else cache
    keyed = df.withColumn("_key", prompt_key(backend, F.col(prompt)))
    asked = keyed.filter(F.col(prompt).isNotNull())
    todo = asked.select(F.col("_key").alias("key"), F.col(prompt).alias("prompt")).distinct()
    known = _read_cache(df, store, backend)
    if known is not None:
        todo = todo.join(known.filter("answer is not null").select("key"), "key", "left_anti")
    todo = stage(todo, "prompts")
    parallel = max_parallel or df.sparkSession.sparkContext.defaultParallelism
    wave = F.pmod(F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint"), F.lit(waves))
    for i in range(waves):
        # A number of partitions that is asked for is not coalesced at run time.
        part = todo.filter(wave == i).repartition(parallel, "key")
        fresh = part.mapInPandas(functools.partial(_answer_batches, backend, calls, parallel, keep_prompts), CACHE_SCHEMA, profile=profile)
        store.append(fresh)

    kept = _read_cache(df, store, backend)
    if kept is None:
        kept = df.sparkSession.createDataFrame([], CACHE_SCHEMA)
    kept = kept.filter("answer is not null").groupBy("key").agg(F.min("answer").alias("_answer"))
    joined = asked.join(kept.withColumnRenamed("key", "_key"), "_key", "left")
    joined = joined.withColumn(answer, F.coalesce("_answer", F.lit(default))).drop("_key", "_answer")
    empty = df.filter(F.col(prompt).isNull()).withColumn(answer, F.lit(None).cast("string"))
    return joined.unionByName(empty)


def keep_allowed(answer: Column, allowed: Sequence[str], default: str = fixed.UNKNOWN) -> Column:
    """The allowed value the answer spells in any case, else ``default``."""
    spelled = F.create_map(*[F.lit(x) for value in allowed for x in (value.lower(), value)])
    return F.coalesce(F.element_at(spelled, F.lower(answer)), F.lit(default))


def classify(df: DataFrame, text: str, lexicon: Mapping[str, Sequence[str]], answer: str = "answer") -> DataFrame:
    """Choose one category per row by lexicon vote, or ``Unknown``; no shuffle, no Python.

    The answer passes through a one-element explode, which later filters on it
    cannot be pushed below, so the text is scanned once.
    """
    category = X.lexicon_category(F.col(text), lexicon)
    return df.drop(answer).select("*", F.explode(F.array(category)).alias(answer))
