"""Toxicity by a noisy-channel model: restore disguised words, then score the words."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namesift.llm.common import documents, row_key, without_rows
from namesift.session import stage

# Labelled rows used to fit, those of the smallest id hashes; documented bound.
TRAIN_ROWS = 20_000
# A feature has to occur in so many toxic rows of the sample to be weighed.
LEAST_ROWS = 4
# Standard errors taken off a feature's log odds, and the least that has to remain.
ERRORS, LEAST_ODDS = 2.0, 1.5
SYMBOLS = 32
_EDGE, _OTHER, _DIGIT, _MARK = 0, 27, 28, 29

# What a written character can stand for.
LEET = {
    "0": "o",
    "1": "il",
    "2": "z",
    "3": "e",
    "4": "a",
    "5": "s",
    "6": "gb",
    "7": "t",
    "8": "b",
    "9": "g",
    "@": "a",
    "$": "s",
    "!": "i",
    "|": "il",
    "+": "t",
    "€": "e",
    "£": "l",
    "¡": "i",
    "(": "c",
    "*": "abcdefghijklmnopqrstuvwxyz",
}
# Log costs of the channel: writing a letter as it is is free. A mark that can stand for
# a letter is less likely to be there for nothing than any other mark.
SUBSTITUTED, DROPPED, DROPPED_LEET, REPEATED = -1.0, -0.7, -2.0, -0.4


def _symbol(c: str) -> int:
    if c.isspace():
        return _EDGE
    base = "s" if c == "ß" else unicodedata.normalize("NFD", c.lower())[0]
    if "a" <= base <= "z":
        return ord(base) - 96
    return _OTHER if c.isalpha() else _DIGIT if c.isdigit() else _MARK


# Latin characters fold to their base letter; everything beyond counts as another letter.
_TABLE = np.array([_symbol(chr(i)) for i in range(0x250)] + [_OTHER], np.uint8)


def symbols(text: str) -> np.ndarray:
    """The text over an alphabet of 32 symbols: letters without accents, and five other kinds."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _TABLE[np.minimum(points, 0x250)]


def count_sequences(docs: DataFrame) -> DataFrame:
    """(code, n): how often each sequence of four symbols occurs in all texts.

    Every task adds up its own rows first; there are 32^4 codes at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**4, np.int64)
        for batch in batches:
            for text in batch.column(0):
                s = symbols("   " + (text.as_py() or "") + " ").astype(np.int32)
                codes = ((s[:-3] * SYMBOLS + s[1:-2]) * SYMBOLS + s[2:-1]) * SYMBOLS + s[3:]
                if len(codes) < SYMBOLS**3:
                    code, n = np.unique(codes, return_counts=True)
                    total[code] += n
                else:
                    total += np.bincount(codes, minlength=SYMBOLS**4)
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], ["code", "n"])

    return docs.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def language_model(docs: DataFrame) -> np.ndarray:
    """Log probability of a symbol after the three before it, indexed by the four as one code.

    Each order is smoothed by the one below it in proportion to the number of
    different symbols that follow (Witten and Bell).
    """
    counts = np.zeros(SYMBOLS**4)
    for code, n in count_sequences(docs).toPandas().itertuples(index=False):
        counts[code] = n
    counts = counts.reshape([SYMBOLS] * 4)
    lower = np.full(SYMBOLS, 1 / SYMBOLS)
    for order in range(1, 5):
        seen = counts.sum(axis=tuple(range(4 - order)))
        total, kinds = seen.sum(axis=-1, keepdims=True), (seen > 0).sum(axis=-1, keepdims=True)
        lower = (seen + np.maximum(kinds, 1) * lower) / (total + np.maximum(kinds, 1))
    return np.log(lower).astype(np.float32).ravel()


_RUN = re.compile(r"(.)\1*", re.DOTALL)
# Characters decoded at once, and runs of stars among them that can stand for any letter: no word needs more.
SPAN, STARS = 48, 2


def decode(span: str, model: np.ndarray, read_all: bool = False) -> str:
    """Most likely letters behind a written span. One of more than ``SPAN`` characters is read piece by piece, to its end."""
    return "".join(_decode(span[i : i + SPAN], model, read_all) for i in range(0, len(span), SPAN))


def _decode(span: str, model: np.ndarray, read_all: bool) -> str:
    """Viterbi over the lattice of the readings of a piece.

    A character reads as itself, as a letter it can stand for, or as nothing if it
    is a mark; a run of three or more reads as one or two. A state is the last three symbols.
    With ``read_all`` a mark that can stand for a letter does.
    """
    states: dict[tuple[int, int, int], tuple[float, str]] = {(0, 0, 0): (0.0, "")}
    stars = 0
    for run in _RUN.finditer(span):
        char, length = run.group(1), run.end() - run.start()
        options: list[tuple[float, str]] = []
        stars += char == "*"
        meant = "" if char == "*" and stars > STARS else LEET.get(char, "")
        letters = [(0.0, char)] if char.isalpha() else [(SUBSTITUTED, c) for c in meant]
        for cost, c in letters:
            if length < 3:
                options.append((cost * length, c * length))
            else:
                options += [(cost + REPEATED, c), (cost + REPEATED, c * 2)]
        if not char.isalnum() and not (read_all and meant):
            options.append(((DROPPED_LEET if char in LEET else DROPPED) * length, ""))
        if not options:
            options.append((0.0, char))
        after: dict[tuple[int, int, int], tuple[float, str]] = {}
        for (a, b, c), (score, text) in states.items():
            for cost, letter in options:
                x, y, z, s = a, b, c, score + cost
                for one in letter:
                    new = int(_TABLE[min(ord(one), 0x250)])
                    s += float(model[((x * SYMBOLS + y) * SYMBOLS + z) * SYMBOLS + new])
                    x, y, z = y, z, new
                known = after.get((x, y, z))
                if known is None or s > known[0]:
                    after[x, y, z] = (s, text + letter)
        states = after
    ends = ((s + float(model[((a * SYMBOLS + b) * SYMBOLS + c) * SYMBOLS]), text) for (a, b, c), (s, text) in states.items())
    return max(ends)[1]


_ENDS = re.compile(r"^[^\w@$|+*€£(!¡]+|[^\w$@+*€£]+$")
_PIECES = re.compile(r"[/:?=&#,;]+")
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
# No character is both a letter and a separator here, so a run can be read in one way only.
_SPACED = re.compile(r"(?<!\S)(?:(?:[^\W_]|[@$!|+*])[ .\-_]{1,2}){2,}(?:[^\W_]|[@$!|+*])(?!\w)")
_SEPARATORS = re.compile(r"[ .\-_]+")


def disguised(token: str) -> bool:
    """Whether a token has letters and marks, digits or repeats that a plain word has not."""
    return any(c.isalpha() for c in token) and (not token.isalpha() or _TRIPLE.search(token) is not None)


def restore(token: str, model: np.ndarray) -> list[str]:
    """Words behind one token written without spaces: itself if plain, else its decoded pieces."""
    token = _ENDS.sub("", token)
    if not disguised(token):
        return [token] if token.isalpha() else []
    words: list[str] = []
    for piece in (_ENDS.sub("", x) for x in _PIECES.split(token)):
        if disguised(piece):
            words += [decode(piece, model), decode(piece, model, read_all=True)]
        elif piece.isalpha():
            words.append(piece)
    return list(dict.fromkeys(words))


def spaced(text: str) -> list[str]:
    """Runs of three or more single characters set apart, put together."""
    return [_SEPARATORS.sub("", m.group()) for m in _SPACED.finditer(text)]


def features(word: str) -> list[str]:
    """The word and its beginnings of three to six letters."""
    return [f"={word}", *[word[:n] for n in range(3, min(7, len(word) + 1))]]


@dataclass
class Scorer:
    """Weights of features, and the logistic curve from evidence to a score."""

    model: np.ndarray
    weights: dict[str, float]
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)
    known: dict[str, float] = field(default_factory=dict)

    def weigh(self, token: str) -> float:
        """Evidence of one token, the largest weight of a feature of its restored words."""
        value = self.known.get(token)
        if value is None:
            if len(self.known) > 300_000:  # a cache only
                self.known.clear()
            words = restore(token, self.model)
            value = max((self.weights.get(f, 0.0) for w in words for f in features(w)), default=0.0)
            self.known[token] = value
        return value

    def evidence(self, text: str | None) -> tuple[float, float]:
        """The largest evidence of a word and the log of all, over the whole text."""
        text = (text or "").lower()
        found = [v for t in set(text.split()) if (v := self.weigh(t)) > 0]
        for span in spaced(text):
            word = decode(span, self.model)
            if (v := max((self.weights.get(f, 0.0) for f in features(word)), default=0.0)) > 0:
                found.append(v)
        return max(found, default=0.0), math.log1p(sum(found))

    def score(self, text: str | None) -> float:
        a, b, c = self.curve
        most, total = self.evidence(text)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * most + c * total))))


def _words(text: str | None, model: np.ndarray) -> set[str]:
    text = (text or "").lower()
    words = {w for t in set(text.split()) for w in restore(t, model)}
    return {f for w in words | {decode(s, model) for s in spaced(text)} for f in features(w)}


def training_rows(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text, toxic, fold) of a bounded sample of labelled rows outside the held-out fifth.

    The rows of the smallest hashes of doc_id; an id with several labels counts as
    toxic if one says so. Fold 0, a quarter, sets the curve; the others the weights.
    """
    marked = labels.where("toxic is not null and doc_id is not null and crc32(cast(doc_id as string)) % 5 <> 0")
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = docs.select("doc_id").distinct().join(marked, "doc_id")
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    fold = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)).alias("fold")
    return stage(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic", fold), "labelled")


def _count(rows: DataFrame, model, only=None) -> dict[str, int]:
    """Rows that each feature occurs in; each task adds up its own rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[str, int] = {}
        for batch in batches:
            for text in batch.column(0):
                found = _words(text.as_py(), model.value)
                for f in found & only.value if only else found:
                    n[f] = n.get(f, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], ["f", "n"])

    counted = rows.select("text").mapInArrow(run, "f string, n long").groupBy("f").agg(F.sum("n").alias("n"))
    return {f: n for f, n in counted.where(F.lit(only is not None) | (F.col("n") >= LEAST_ROWS)).toPandas().itertuples(index=False)}


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton steps, lightly held towards zero."""
    x = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hold = np.diag([1e-3, 1e-2, 1e-2])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + hold, x.T @ (y - p) - hold @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1]), float(w[2])


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Scorer | None:
    """A scorer learnt from the labels; None if either label has no row in the sample.

    The language model counts all texts. A feature's weight is its log odds between
    toxic and other rows, less two standard errors, so that few rows give little
    weight. Weights are bounded by the sample.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(language_model(docs))
    sample = training_rows(docs, labels, rows)
    parts = max(spark.sparkContext.defaultParallelism, 4)
    sample = sample.repartition(parts)
    size = {(bool(r["toxic"]), r["fold"] == 0): r["n"] for r in sample.groupBy(F.col("toxic") > 0, F.col("fold") == 0).agg(F.count("*").alias("n")).toDF("toxic", "fold", "n").selectExpr("toxic", "if(fold, 0, 1) fold", "n").collect()}
    toxic, clean = size.get((True, False), 0), size.get((False, False), 0)
    if not toxic or not clean:
        return None
    fitting = sample.where("fold <> 0")
    bad = _count(fitting.where("toxic > 0"), model)
    only = spark.sparkContext.broadcast(frozenset(bad))
    good = _count(fitting.where("toxic <= 0"), model, only)
    # A beginning that one word accounts for says no more than the word.
    words: dict[str, int] = {}
    for f, n in bad.items():
        for part in features(f[1:])[1:] if f[0] == "=" else ():
            words[part] = max(words.get(part, 0), n)
    weights = {}
    for f, n in bad.items():
        m = good.get(f, 0)
        if n < 2 * words.get(f, 0):
            continue
        odds = math.log((n + 0.5) / (toxic - n + 0.5)) - math.log((m + 0.5) / (clean - m + 0.5))
        if (held := odds - ERRORS * math.sqrt(1 / (n + 0.5) + 1 / (m + 0.5))) > LEAST_ODDS:
            weights[f] = held
    scorer = Scorer(model.value, weights)
    shared = spark.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.evidence(t.as_py()) for t in batch.column(0)]
            most, total = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(most, pa.float64()), pa.array(total, pa.float64()), batch.column(1)], ["most", "total", "toxic"])

    seen = sample.where("fold = 0").select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "most double, total double, toxic int").toPandas()
    y = (seen["toxic"].to_numpy() > 0).astype(float)
    if 0 < y.sum() < len(y):
        scorer.curve = _fit_curve(seen[["most", "total"]].to_numpy(), y)
    else:
        scorer.curve = (-3.0, 1.0, 1.0)
    return scorer


def score(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(row, doc_id, score) for every row of ``docs``, whatever its other columns.

    ``row`` is the content key of doc_id and text. A null or empty text is scored as
    one without evidence. Without labelled rows of both kinds every score is 0.
    Equal texts have equal scores; labels, lang, source and doc_id are never looked at.
    """
    scorer = fit(docs, labels, rows)
    keyed = docs.select(row_key("doc_id", "text").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    if scorer is None:
        return keyed.select("row", "doc_id", F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.score(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], ["row", "doc_id", "score"])

    return keyed.mapInArrow(run, "row long, doc_id long, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``limit`` or more."""
    toxic = score(docs, labels).where(F.col("score") >= limit).select("row").distinct()
    return without_rows(docs, stage(toxic, "toxic"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; learnt from labels outside the held-out fifth."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(documents(spark, sf_dir), labels)
    return scored.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
