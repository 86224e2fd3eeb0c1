"""Periodic runs of words: seeds of guaranteed overlap, extended along their diagonal."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from namesift.llm.common import documents

# A run has at least so many words, and at least so many times its period.
LEAST_WORDS, LEAST_PERIODS = 6, 4
RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
# White space of the contract: space and the control characters 9 to 13.
SPACES = " \t\n\x0b\f\r"


def seed_lengths(n: int) -> Iterator[tuple[int, int]]:
    """(shortest period, length of seed) for each level of periods that a text of ``n`` words can have.

    A run of period q has at least ``max(6 - q, 3 * q)`` words that are equal to the word q
    further on. A level takes periods up to the least overlap among them, so its seeds
    are no longer than any overlap and no shorter than any period: 1 to 5 by seeds of
    5 words, 6 to 18 by seeds of 18, 19 to 57 by seeds of 57.
    """
    low, seed = 1, LEAST_WORDS - 1
    while LEAST_PERIODS * low <= n and seed < n:
        yield low, seed
        low, seed = seed + 1, (LEAST_PERIODS - 1) * (seed + 1)


def _joined(names: np.ndarray, shift: int) -> np.ndarray:
    """Names of the pairs of grams ``shift`` apart; equal pairs, and only those, share one."""
    a, b = names[: len(names) - shift], names[shift:]
    return np.unique(a * (int(names.max()) + 1) + b, return_inverse=True)[1].astype(np.int64)


def gram_names(names: np.ndarray, length: int, wanted: int) -> np.ndarray:
    """Names of the grams of ``wanted`` words from those of ``length`` words, by doubling. Exact: nothing is hashed."""
    while length < wanted:
        shift = min(length, wanted - length)
        names = _joined(names, shift)
        length += shift
    return names


def _reach(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading items of ``a`` and ``b`` agree, in steps that double."""
    done, step, most = 0, 32, min(len(a), len(b))
    while done < most:
        differ = np.flatnonzero(a[done : done + step] != b[done : done + step])
        if len(differ):
            return min(done + int(differ[0]), most)
        done, step = done + step, 2 * step
    return most


def find_runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a text given as word numbers, by start and period.

    At each level equal grams are indexed, and each occurrence is paired with the next one.
    Seeds are as long as the period or longer, so in a run that next one lies exactly a
    period on; a nearer one would give the run a smaller period. So there are no more pairs
    than words, whatever repeats. A pair is a seed on the diagonal of its lag. It
    is extended both ways unless the furthest place that lag has covered lies beyond it.
    """
    found = []
    names, length = words, 1
    for low, seed in seed_lengths(len(words)):
        names, length = gram_names(names, length, seed), seed
        order = np.argsort(names, kind="stable")
        again = names[order[1:]] == names[order[:-1]]
        if not again.any():
            break
        lag = (order[1:] - order[:-1])[again]
        first = order[:-1][again]
        fits = (lag >= low) & (lag <= seed)
        lag, first = lag[fits], first[fits]
        by_place = np.lexsort((first, lag))
        covered: dict[int, int] = {}
        for q, i in zip(lag[by_place].tolist(), first[by_place].tolist(), strict=True):
            if i < covered.get(q, 0):
                continue
            ahead = _reach(words[i + q :], words[i : len(words) - q])
            back = _reach(words[i + q - 1 :: -1][:i], words[i - 1 :: -1]) if i else 0
            covered[q] = i + ahead
            size = back + ahead + q
            if size >= max(LEAST_WORDS, LEAST_PERIODS * q):
                found.append((i - back, size, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay when each run keeps its first period only."""
    depth = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return np.cumsum(depth[:-1]) == 0


def _scan(text: bytes | None) -> tuple[list[tuple[int, int, int]], bytes]:
    words = (text or b"").split()
    number = defaultdict(count().__next__)
    runs = find_runs(np.fromiter(map(number.__getitem__, words), np.int64, len(words))) if len(words) >= LEAST_WORDS else []
    if runs:
        words = [w for w, keep in zip(words, kept_words(len(words), runs).tolist(), strict=True) if keep]
    return runs, b" ".join(words)


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc, runs, collapsed) for every row of ``docs``: its runs of words, and its words without the repeats.

    Words are what white space separates. A run is a longest stretch of at least six words and
    four times its smallest period. ``collapsed`` drops every word that some run holds after its
    first period and joins the others by one space. ``doc`` is the row as a struct, so any
    column may be there or be null. Rows stay one for one; a null, empty or blank
    text has no run and an empty ``collapsed``. Texts of any length are scanned whole, in one
    pass without a shuffle.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{text}`").cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, kept = zip(*[_scan(t.as_py()) for t in batch.column(1)], strict=True) if batch.num_rows else ((), ())
            shape = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
            dicts = [[{"start": s, "length": n, "period": q} for s, n, q in found] for found in runs]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dicts, shape), pa.array(kept, pa.binary())], ["doc", "runs", "collapsed"])

    schema = T.StructType([rows.schema["doc"], T.StructField("runs", RUNS), T.StructField("collapsed", T.BinaryType())])
    return rows.mapInArrow(run, schema).withColumn("collapsed", F.col("collapsed").cast("string"))


def collapse(docs: DataFrame) -> DataFrame:
    """``docs`` with every run of words cut to its first period; texts without a run stay as they are."""
    text = F.when(F.size("runs") > 0, F.col("collapsed")).otherwise(F.col("doc.text"))
    return scanned(docs).select(F.col("doc").withField("text", text).alias("doc")).select("doc.*")


def planted(doc_id: Column, words: Column) -> Column:
    """The words of a text, one text in ten with its end overwritten by copies of an earlier stretch.

    With h the checksum of the id, g = h / 10 and n words, texts with h % 10 = 0 repeat from word a = g % n on
    the p = 1 + (n - a) / (3 + g % 8) words that start there. A null id changes nothing.
    """
    h = F.crc32(doc_id.cast("string"))
    g, n = F.floor(h / 10), F.size(words)
    a = g % F.greatest(n, F.lit(1))
    p = 1 + F.floor((n - a) / (3 + g % 8))
    place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
    changed = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, place(i)))
    return F.when((h % 10 == 0) & (n > 0), changed).otherwise(words)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, the longest one, and digests of all runs and of the collapsed text."""
    split = F.filter(F.split(F.coalesce("text", F.lit("")), f"[{SPACES}]+"), lambda w: w != "")
    docs = documents(spark, sf_dir)
    changed = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    words = docs.select("doc_id", "text", F.when(changed, split).alias("words"))
    text = F.when(F.col("words").isNull(), F.col("text")).otherwise(F.array_join(planted(F.col("doc_id"), F.col("words")), " "))
    found = scanned(words.select("doc_id", text.alias("text")))
    rank = lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))
    longest = F.array_max(F.transform("runs", rank))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    rows = found.select(F.col("doc.doc_id").alias("doc_id"), "runs", "collapsed", longest.alias("longest"))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.start")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"),
        F.expr("1000 * longest.length div -longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
