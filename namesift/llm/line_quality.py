"""Document quality from its lines: a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from namesift.llm.common import MIX, Powers, documents, word_hashes

# Labelled documents the field is fitted on, those of the smallest id hashes, and the most lines one
# of them may have; documented bounds.
TRAIN_ROWS, TRAIN_LINES = 6_000, 400
STEPS, RATE, HOLD = 120, 0.08, 1e-4
# Bytes of text looked at together; a longer document is a chunk of its own.
CHUNK = 1 << 20
# Every feature of a line has so many values.
VALUES = 16
FEATURES = (
    "words",
    "word length",
    "capitals",
    "symbols",
    "digits",
    "different words",
    "repeated neighbours",
    "words with doubled marks",
    "marks alone",
    "end",
    "start",
    "seen before or after",
    "exclamations",
    "commas",
    "stops",
)
WIDTH = len(FEATURES) * VALUES
_SPACE, _UPPER, _LETTER, _DIGIT, _STOP, _BANG, _COMMA, _SYMBOL = range(8)


def _class(b: int) -> int:
    c = chr(b)
    if c in " \t\n\x0b\f\r":
        return _SPACE
    if b >= 128:
        return _LETTER
    if c.isalpha():
        return _UPPER if c.isupper() else _LETTER
    if c.isdigit():
        return _DIGIT
    return {".": _STOP, "?": _STOP, "!": _BANG, ",": _COMMA}.get(c, _SYMBOL)


_CLASS = np.array([_class(b) for b in range(256)], np.uint8)


@dataclass
class Lines:
    """Lines with a word, document by document: features, length, number in the document, and where documents begin.

    A document without such a line has one blank line.
    """

    codes: np.ndarray
    length: np.ndarray
    number: np.ndarray
    start: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(np.append(self.start, len(self.length)))


def _share(part: np.ndarray, whole: np.ndarray, steps: int = 8) -> np.ndarray:
    """The share in ``steps`` steps, rounded up, so that only nothing at all is 0."""
    return np.minimum(-(-part * steps // np.maximum(whole, 1)), VALUES - 1)


def lines_of(texts: list[bytes], powers: Powers) -> Lines:
    """Lines of all texts with their features, worked out for all bytes at once."""
    data = np.frombuffer(b"".join(t + b"\n" for t in texts), np.uint8)
    ends = np.flatnonzero(data == 10)
    begins = np.concatenate(([0], ends[:-1] + 1))
    n = len(ends)
    per_doc = np.array([t.count(b"\n") + 1 for t in texts])
    doc = np.repeat(np.arange(len(texts)), per_doc)
    line = np.repeat(np.arange(n), ends + 1 - begins)
    kind = _CLASS[data]
    bytes_of = np.bincount(line * 8 + kind, minlength=8 * n).reshape(n, 8)
    value, first, last = word_hashes(data, kind != _SPACE, powers)
    at = line[first]
    words = np.bincount(at, minlength=n)
    inked = bytes_of[:, 1:].sum(axis=1)
    different = np.bincount(at[np.unique(value + at.astype(np.uint64) * MIX, return_index=True)[1]], minlength=n)
    again = (value[1:] == value[:-1]) & (at[1:] == at[:-1])
    marked = kind[last - 1] >= _STOP
    doubled = marked & (last - first > 2) & (kind[last - 2] >= _STOP)
    alone = marked & (last - first == 1)
    opening = np.flatnonzero(np.diff(at, prepend=-1))
    closing = np.append(opening[1:], len(at)) - 1
    end, begin, seen = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    if len(at):
        whole = at[opening]
        end[whole], begin[whole] = kind[last[closing] - 1], kind[first[opening]]
        place = (np.arange(len(at)) - np.repeat(opening, closing - opening + 1) + 1).astype(np.uint64)
        print_of = np.add.reduceat(value * (place * np.uint64(2) + np.uint64(1)), opening) + doc[whole].astype(np.uint64) * MIX
        _, inverse, copies = np.unique(print_of, return_inverse=True, return_counts=True)
        seen[whole] = copies[inverse] > 1
    letters = bytes_of[:, _UPPER] + bytes_of[:, _LETTER]
    columns = [
        np.minimum(np.ceil(np.log2(words + 1)), VALUES - 1),
        np.minimum(inked // np.maximum(words, 1), VALUES - 1),
        _share(bytes_of[:, _UPPER], letters),
        _share(bytes_of[:, _SYMBOL], inked, 15),
        _share(bytes_of[:, _DIGIT], inked),
        _share(different, words),
        _share(np.bincount(at[1:][again], minlength=n), words),
        _share(np.bincount(at[doubled], minlength=n), words),
        _share(np.bincount(at[alone], minlength=n), words),
        end,
        begin,
        seen,
        _share(bytes_of[:, _BANG], words),
        _share(bytes_of[:, _COMMA], words),
        _share(bytes_of[:, _STOP], words),
    ]
    codes = np.column_stack(columns).astype(np.uint8)
    own = np.concatenate(([0], np.cumsum(per_doc)))[:-1]
    kept = words > 0
    worded = np.add.reduceat(kept, own, dtype=np.int64) if len(own) else own
    kept[own[worded == 0]] = True
    place = np.flatnonzero(kept)
    start = np.searchsorted(place, own)
    return Lines(codes[place], inked[place] + 1, place - np.repeat(own, np.maximum(worded, 1)), start)


def _neighbours(lines: Lines) -> tuple[np.ndarray, np.ndarray]:
    """For each line the place of the one before and after it in its document, -1 without one."""
    n = len(lines.length)
    before, after = np.arange(n) - 1, np.arange(n) + 1
    before[lines.start] = -1
    after[np.append(lines.start[1:], n) - 1] = -1
    return before, after


class Field:
    """Log-linear scores of a line being good, from its own and its neighbours' features, and of label pairs."""

    def __init__(self) -> None:
        self.own, self.before, self.after = (np.zeros(WIDTH) for _ in range(3))
        self.alone = np.zeros(3)  # bias, no line before, no line after
        self.moves = np.zeros((2, 2))
        self.curve = (0.0, 1.0)

    def scores(self, lines: Lines) -> np.ndarray:
        at = lines.codes + (np.arange(len(FEATURES)) * VALUES)
        before, after = _neighbours(lines)
        left, right = self.before[at].sum(axis=1), self.after[at].sum(axis=1)
        out = self.own[at].sum(axis=1) + self.alone[0]
        out += np.where(before >= 0, left[before], self.alone[1])
        return out + np.where(after >= 0, right[after], self.alone[2])

    def sums(self, score: np.ndarray, lines: Lines) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward log sums per line and label, and the log of each document's whole sum.

        All documents advance together, line by line.
        """
        size = lines.count
        order = np.argsort(-size, kind="stable")
        start, size = lines.start[order], size[order]
        still = len(size) - np.searchsorted(size[::-1], np.arange(size[0] if len(size) else 0), side="right")
        ahead, behind = np.zeros((len(score), 2)), np.zeros((len(score), 2))
        m = self.moves
        ahead[start, 1] = score[start]
        for t in range(1, len(still)):
            at = start[: still[t]] + t
            a, b = ahead[at - 1, 0], ahead[at - 1, 1]
            ahead[at, 0] = np.logaddexp(a + m[0, 0], b + m[1, 0])
            ahead[at, 1] = np.logaddexp(a + m[0, 1], b + m[1, 1]) + score[at]
        for t in range(len(still) - 2, -1, -1):
            at = start[: still[t + 1]] + t
            a, b = behind[at + 1, 0], behind[at + 1, 1] + score[at + 1]
            behind[at, 0] = np.logaddexp(m[0, 0] + a, m[0, 1] + b)
            behind[at, 1] = np.logaddexp(m[1, 0] + a, m[1, 1] + b)
        whole = np.zeros(len(lines.start))
        last = start + size - 1
        whole[order] = np.logaddexp(ahead[last, 0], ahead[last, 1])
        return ahead, behind, whole

    def marginals(self, lines: Lines) -> np.ndarray:
        """Probability of each line being good, given the whole document."""
        ahead, behind, whole = self.sums(self.scores(lines), lines)
        return np.exp(ahead[:, 1] + behind[:, 1] - np.repeat(whole, lines.count))

    def quality(self, lines: Lines, good: np.ndarray) -> np.ndarray:
        """Mean probability of a document's lines, weighted by their length."""
        return np.add.reduceat(good * lines.length, lines.start) / np.add.reduceat(lines.length, lines.start)

    def gradient(self, lines: Lines, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Log likelihood of the labels of all lines, and its slope along own, before, after, alone and moves."""
        at = lines.codes + (np.arange(len(FEATURES)) * VALUES)
        before, after = _neighbours(lines)
        score = self.scores(lines)
        ahead, behind, whole = self.sums(score, lines)
        every = np.repeat(whole, lines.count)
        slope = label - np.exp(ahead[:, 1] + behind[:, 1] - every)
        pair = np.flatnonzero(before >= 0)
        moves = np.zeros((2, 2))
        likelihood = float((score * label).sum() - whole.sum())
        for u in (0, 1):
            for v in (0, 1):
                seen = (label[pair - 1] == u) & (label[pair] == v)
                p = ahead[pair - 1, u] + self.moves[u, v] + score[pair] * v + behind[pair, v] - every[pair]
                moves[u, v] = seen.sum() - np.exp(p).sum()
                likelihood += float(seen.sum() * self.moves[u, v])
        add = lambda rows, s: np.bincount(at[rows].ravel(), np.repeat(s, at.shape[1]), minlength=WIDTH)
        left, right = before >= 0, after >= 0
        alone = np.array([slope.sum(), slope[~left].sum(), slope[~right].sum()])
        return likelihood, [add(slice(None), slope), add(before[left], slope[left]), add(after[right], slope[right]), alone, moves]

    def train(self, lines: Lines, label: np.ndarray, steps: int = STEPS) -> None:
        """Ascent of the likelihood by steps of a size kept per weight, lightly held towards zero."""
        weights = [self.own, self.before, self.after, self.alone, self.moves]
        mean, power = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        for k in range(1, steps + 1):
            for w, g, m, v in zip(weights, self.gradient(lines, label)[1], mean, power, strict=True):
                g = g / len(label) - HOLD * w
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w += RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)

    def score(self, quality: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a + b * _logit(quality), -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one variable by Newton steps, lightly held towards the identity."""
    x, w, hold = np.column_stack((np.ones(len(x)), x)), np.array([0.0, 1.0]), np.diag([0.1, 1.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + hold, x.T @ (y - p) - hold @ (w - [0.0, 1.0]))
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


def training_rows(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text, good, fold) of at most ``rows`` labelled documents outside the held-out fifth.

    An id with several labels counts as good if all say so; of several texts of one id the smallest is
    taken. Fold 0, a quarter, sets the curve; the others the weights.
    """
    marked = labels.where("quality is not null and doc_id is not null and crc32(cast(doc_id as string)) % 5 <> 0")
    marked = marked.groupBy("doc_id").agg((F.min("quality") > 0).cast("int").alias("good"))
    known = docs.select("doc_id").distinct().join(marked, "doc_id")
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31))
    n = known.count()
    if n > 4 * rows:  # only so many reach the sort that twice the number wanted is expected
        known = known.where(spot < int((1 << 31) * 2 * rows / n))
    chosen = known.orderBy(spot, "doc_id").limit(rows)
    fold = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)).cast("int").alias("fold")
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "good").agg(F.min("text").alias("text")).select(F.col("text").cast("binary").alias("text"), "good", fold)


def _chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > CHUNK:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def _together(parts: list[Lines]) -> Lines:
    start = np.cumsum([0, *[len(p.length) for p in parts]])[:-1]
    return Lines(*[np.concatenate([getattr(p, c) for p in parts]) for c in ("codes", "length", "number")], np.concatenate([p.start + s for p, s in zip(parts, start, strict=True)]))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Field | None:
    """A field learnt from documents' labels; None if either label has no row in the sample.

    Lines have no labels of their own, so each takes its document's; the field then learns that labels
    seldom change, and a single line differs from its neighbours on strong evidence only. Documents of more than
    ``TRAIN_LINES`` lines are not learnt from. The curve from quality to score is set on documents the
    weights have not seen.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            out = []
            for text, good, fold in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                lines = lines_of([text or b""], powers)
                if len(lines.length) <= TRAIN_LINES:
                    out.append((lines.codes.tobytes(), lines.length.astype(np.int64).tobytes(), good, fold))
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.binary(), pa.binary(), pa.int32(), pa.int32()), strict=True)] if out else []
            if out:
                yield pa.RecordBatch.from_arrays(columns, ["codes", "length", "good", "fold"])

    found = training_rows(docs, labels, rows).mapInArrow(run, "codes binary, length binary, good int, fold int").collect()
    found.sort(key=lambda r: (r["codes"], r["length"], r["good"], r["fold"]))
    if len({r["good"] for r in found}) < 2:
        return None

    def gathered(part: list) -> tuple[Lines, np.ndarray]:
        lines = []
        for r in part:
            length = np.frombuffer(r["length"], np.int64)
            lines.append(Lines(np.frombuffer(r["codes"], np.uint8).reshape(len(length), -1), length, np.arange(len(length)), np.zeros(1, np.int64)))
        return _together(lines), np.array([r["good"] for r in part])

    fitting = [r for r in found if r["fold"]]
    setting = [r for r in found if not r["fold"]]
    if len({r["good"] for r in fitting}) < 2 or len({r["good"] for r in setting}) < 2:
        fitting = setting = found
    field = Field()
    lines, good = gathered(fitting)
    field.train(lines, np.repeat(good, lines.count))
    lines, good = gathered(setting)
    field.curve = _fit_curve(_logit(field.quality(lines, field.marginals(lines))), good)
    return field


def judged(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, back: list[str] | None = None) -> DataFrame:
    """(doc, score, bad) for every row of ``docs``: its quality from 0 to 1, and the numbers of its bad lines.

    ``doc`` holds the columns named by ``back``, all by default. Every line is good or bad by its marginal
    probability; lines without a word are neither. A null, empty or blank text is scored as one
    blank line. Without labelled documents of both kinds every score is 0.5 and no line is bad. Equal texts have
    equal scores up to rounding; labels, lang, source and doc_id are never looked at. Texts of any length are
    read whole, in one pass without a shuffle.
    """
    field = fit(docs, labels, rows)
    back = docs.columns if back is None else back
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in back]).alias("doc"), F.col("text").cast("binary").alias("text"))
    if field is None:
        return whole.select("doc", F.lit(0.5).alias("score"), F.array().cast("array<int>").alias("bad"))
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            scores, bad = [np.zeros(0)], []
            for part in _chunks([t or b"" for t in batch.column(1).to_pylist()]):
                lines = lines_of(part, powers)
                good = shared.value.marginals(lines)
                scores.append(shared.value.score(shared.value.quality(lines, good)))
                low = (good < 0.5) & (lines.length > 1)
                edges = np.concatenate(([0], np.cumsum(np.add.reduceat(low, lines.start, dtype=np.int64))))
                numbers = lines.number[low].astype(np.int32)
                bad += [numbers[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
            columns = [batch.column(0), pa.array(np.concatenate(scores)), pa.array(bad, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "score", "bad"])

    schema = T.StructType([whole.schema["doc"], T.StructField("score", T.DoubleType()), T.StructField("bad", T.ArrayType(T.IntegerType()))])
    return whole.mapInArrow(run, schema)


def clean(docs: DataFrame, labels: DataFrame, limit: float = 0.3) -> DataFrame:
    """The documents that score ``limit`` or more, without their bad lines."""
    kept = F.filter(F.split(F.col("doc.text"), "\n", -1), lambda x, i: ~F.array_contains("bad", i))
    text = F.when(F.size("bad") > 0, F.array_join(kept, "\n")).otherwise(F.col("doc.text"))
    rows = judged(docs, labels).where(F.col("score") >= limit)
    return rows.select(F.col("doc").withField("text", text).alias("doc")).select("doc.*")


def op11_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; learnt from labels outside the held-out fifth."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rows = judged(docs, labels, back=["doc_id"]).select("doc.doc_id", "score", F.size("bad").cast("long").alias("n_bad_lines"))
    return rows.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        "n_bad_lines",
    )
