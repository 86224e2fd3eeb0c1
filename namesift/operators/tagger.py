"""A mention tagger learnt from a dictionary's own hits: no model has to be brought along.

Words are labelled as the beginning of a mention, its inside, or outside of any. A structured perceptron
scores label sequences by features of each word and its neighbours and by pairs of labels. It is trained
on all partitions at once: in every round each partition starts from the same weights, walks its own
texts, and the weights it ends with are averaged. Features are hashed, so the weights have one bounded size.
"""

from __future__ import annotations

import functools
import itertools
import re
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namesift.functions import text as X
from namesift.operators import mentions as M
from namesift.session import stage

# Rows of the weights; documents of the sample that is trained on, and words taken from each; documented bounds.
WIDTH = 1 << 16
TRAIN_DOCS, TRAIN_WORDS = 4_000, 2_000
ROUNDS = 4
# Texts walked side by side from which a step goes label by label.
FEW = 32
# Texts a call should bring, so that few steps are spent on the longest alone.
SIDE_BY_SIDE = 1024
SCALES = (0.02, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0)
_WORD = re.compile(r"[^\W_]+")


def word_features(words: Sequence[str]) -> np.ndarray:
    """Row numbers of the features of each word: itself, its ends and shape, and the words beside it."""
    lower = [w.lower() for w in words]
    shape = ["".join("X" if c.isupper() else "x" if c.isalpha() else "9" for c in w[:6]) for w in words]
    around = ["<s>", *lower, "</s>"]
    rows = []
    for i, w in enumerate(lower):
        names = (f"w={w}", f"p={w[:3]}", f"s={w[-3:]}", f"f={shape[i]}", f"l={around[i]}", f"r={around[i + 2]}", f"b={around[i]} {w}", f"a={w} {around[i + 2]}")
        rows.append([zlib.crc32(n.encode()) % WIDTH for n in names])
    return np.array(rows, np.int64).reshape(len(words), 8)


@functools.lru_cache(1 << 10)
def _shape(c: str) -> str:
    return "X" if c.isupper() else "x" if c.isalpha() else "9"


def _rows_of(begin: str, ends: Iterable[bytes], n: int) -> np.ndarray:
    """Sums of ``n`` features with one beginning."""
    return np.fromiter(map(zlib.crc32, ends, itertools.repeat(zlib.crc32(begin.encode()))), np.int64, n)


def _scores_of(own: np.ndarray, texts: Sequence[Sequence[str]]) -> np.ndarray:
    """Sums of the weights of ``word_features`` of all words of the texts, one text after the other.

    Features of one word are hashed once for each different word, those of two once for each different pair.
    """
    # The places between texts hold both ends, so that every word has a neighbour on either side.
    flat = list(itertools.chain.from_iterable(("<s>", *words, "</s>") for words in texts))
    words = list(dict.fromkeys(("<s>", "</s>", *flat)))
    code, n = {w: k for k, w in enumerate(words)}, len(words)
    around = np.fromiter(map(code.__getitem__, flat), np.int64, len(flat))
    lower = [w.lower() for w in words]
    plain = [w.encode() for w in lower]
    shape = ("".join(map(_shape, w[:6])).encode() for w in words)
    ends = (("w=", plain), ("p=", (w[:3].encode() for w in lower)), ("s=", (w[-3:].encode() for w in lower)), ("f=", shape), ("l=", plain), ("r=", plain))
    of = np.column_stack([_rows_of(begin, end, n) % WIDTH for begin, end in ends])
    alone, beside = of[:, :4], of[:, 4:]
    before, after = (_rows_of(begin, (w + b" " for w in plain), n).tolist() for begin in ("b=", "a="))
    pairs, number = np.unique(around[:-1] * n + around[1:], return_inverse=True)
    lefts, rights = (x.tolist() for x in np.divmod(pairs, n))
    second = [plain[k] for k in rights]
    two = np.column_stack([np.fromiter(map(zlib.crc32, second, map(first.__getitem__, lefts)), np.int64, len(pairs)) % WIDTH for first in (before, after)])
    at = np.flatnonzero(around > 1)
    out = np.empty((len(at), own.shape[1]))
    for start in range(0, len(at), 1 << 14):
        i = at[start : start + (1 << 14)]
        here = alone[around[i]]
        total = own.take(here[:, 0], axis=0)
        for rows in (here[:, 1], here[:, 2], here[:, 3], beside[around[i - 1], 0], beside[around[i + 1], 1], two[number[i - 1], 0], two[number[i], 1]):
            total += own.take(rows, axis=0)
        out[start : start + len(i)] = total
    return out


@dataclass
class Model:
    """Labels, weights of features by label, weights of label pairs, and the scale that turns scores into odds."""

    labels: tuple[str, ...]
    own: np.ndarray
    pairs: np.ndarray
    scale: float = 1.0

    @staticmethod
    def empty(types: Sequence[str]) -> Model:
        labels = ("O", *[f"{side}-{t}" for t in types for side in "BI"])
        n = len(labels)
        return Model(labels, np.zeros((WIDTH, n)), np.zeros((n + 1, n)))

    def allowed(self) -> np.ndarray:
        """0 where a label may follow another, minus infinity where an inside would follow neither its beginning nor itself.

        The last row stands for the start of a text.
        """
        out = np.zeros((len(self.labels) + 1, len(self.labels)))
        for k, label in enumerate(self.labels):
            if label[0] == "I":
                out[[i for i, x in enumerate((*self.labels, "^")) if x[2:] != label[2:] or x[0] not in "BI"], k] = -np.inf
        return out

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return self.own[rows].sum(axis=1)

    def decode(self, score: np.ndarray) -> np.ndarray:
        """Labels of the best allowed path (Viterbi)."""
        moves = self.pairs + self.allowed()
        best, back = moves[-1] + score[0], []
        for s in score[1:]:
            every = best[:, None] + moves[:-1]
            back.append(every.argmax(axis=0))
            best = every.max(axis=0) + s
        path = [int(best.argmax())]
        for pointers in reversed(back):
            path.append(int(pointers[path[-1]]))
        return np.array(path[::-1])

    def sums(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
        """Forward and backward log sums over all allowed paths, their whole, and the label pair weights, all scaled."""
        moves = self.scale * self.pairs + self.allowed()
        score = self.scale * score
        ahead, behind = np.zeros_like(score), np.zeros_like(score)
        ahead[0] = moves[-1] + score[0]
        with np.errstate(invalid="ignore"):
            for i in range(1, len(score)):
                ahead[i] = score[i] + np.logaddexp.reduce(ahead[i - 1][:, None] + moves[:-1], axis=0)
            for i in range(len(score) - 2, -1, -1):
                behind[i] = np.logaddexp.reduce(moves[:-1] + (score[i + 1] + behind[i + 1])[None, :], axis=1)
        return ahead, behind, float(np.logaddexp.reduce(ahead[-1])), moves

    def log_likelihood(self, rows: np.ndarray, path: np.ndarray) -> float:
        score = self.scores(rows)
        _, _, whole, moves = self.sums(score)
        return self.scale * score[np.arange(len(path)), path].sum() + moves[np.append(-1, path[:-1]), path].sum() - whole

    def spans(self, words: Sequence[str]) -> list[tuple[int, int, str, float]]:
        """(first word, end, type, probability) of the mentions on the best path.

        The probability is that of exactly this mention, over all paths: it begins here, goes on to its end,
        and does not go on.
        """
        if not words:
            return []
        score = self.scores(word_features(words))
        path = self.decode(score)
        ahead, behind, whole, moves = self.sums(score)
        out, i, n = [], 0, len(path)
        while i < n:
            if self.labels[path[i]][0] != "B":
                i += 1
                continue
            j = i + 1
            while j < n and self.labels[path[j]][0] == "I":
                j += 1
            log = ahead[i, path[i]] + sum(moves[path[k - 1], path[k]] + self.scale * score[k, path[k]] for k in range(i + 1, j))
            if j < n:
                after = moves[path[j - 1]] + self.scale * score[j] + behind[j]
                after[[k for k, x in enumerate(self.labels) if x == "I" + self.labels[path[i]][1:]]] = -np.inf
                log += np.logaddexp.reduce(after)
            out.append((i, j, self.labels[path[i]][2:], float(np.exp(log - whole))))
            i = j
        return out

    def spans_of(self, texts: Sequence[Sequence[str]]) -> list[list[tuple[int, int, str, float]]]:
        """``spans`` of many texts at once: step t takes the word t of every text that has one."""
        order = sorted((k for k, words in enumerate(texts) if len(words)), key=lambda k: -len(texts[k]))
        out: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
        if not order:
            return out
        sizes = np.array([len(texts[k]) for k in order])
        starts = np.cumsum(sizes) - sizes
        score = _scores_of(self.own, [texts[k] for k in order])
        # Texts that have a word t: the longest come first.
        active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left").tolist()
        path = self._paths(score, starts, sizes, active)
        score *= self.scale
        ahead, behind, moves = self._sums_of(score, starts, active)
        last = ahead[starts + sizes - 1]
        most = last.max(axis=1)
        whole = most + np.log(np.exp(last - most[:, None]).sum(axis=1))
        begins, inside = (np.array([x[0] == side for x in self.labels]) for side in "BI")
        i = np.flatnonzero(begins[path])
        if not len(i):
            return out
        text = np.searchsorted(starts, i, side="right") - 1
        stop = starts[text] + sizes[text]
        j, log = i + 1, ahead[i, path[i]]
        while len(on := np.flatnonzero(j < stop)) and len(on := on[inside[path[j[on]]]]):
            at = j[on]
            log[on] += moves[path[at - 1], path[at]] + score[at, path[at]]
            j[on] += 1
        on = np.flatnonzero(j < stop)
        after = moves[path[j[on] - 1]] + score[j[on]] + behind[j[on]]
        ends = np.array([[x == "I" + y[1:] for x in self.labels] for y in self.labels])
        after[ends[path[i[on]]]] = -np.inf
        high = after.max(axis=1)
        log[on] += high + np.log(np.exp(after - high[:, None]).sum(axis=1))
        chance = np.exp(log - whole[text])
        first = starts[text]
        for k, a, b, label, p in zip(text.tolist(), (i - first).tolist(), (j - first).tolist(), path[i].tolist(), chance.tolist(), strict=True):
            out[order[k]].append((a, b, self.labels[label][2:], p))
        return out

    def _paths(self, score: np.ndarray, starts: np.ndarray, sizes: np.ndarray, active: list[int]) -> np.ndarray:
        """Labels of the best allowed path of each text, as ``decode`` finds them."""
        moves = self.pairs + self.allowed()
        back = np.zeros(score.shape, np.int8)
        best = moves[-1] + score[starts]
        for t in range(1, len(active)):
            m = active[t]
            at = starts[:m] + t
            if m < FEW:
                every = best[:m, :, None] + moves[:-1]
                back[at], high = every.argmax(axis=1), every.max(axis=1)
            else:
                # Label by label, the first of equal ones as above; quicker over many texts.
                high, came = best[:m, :1] + moves[0], np.zeros((m, len(self.labels)), np.int8)
                for k in range(1, len(self.labels)):
                    other = best[:m, k : k + 1] + moves[k]
                    came[other > high] = k
                    np.maximum(high, other, out=high)
                back[at] = came
            best[:m] = high + score[at]
        path = np.zeros(len(score), np.int8)
        path[starts + sizes - 1] = best.argmax(axis=1)
        for t in range(len(active) - 1, 0, -1):
            at = starts[: active[t]] + t
            path[at - 1] = back[at, path[at]]
        return path

    def _sums_of(self, score: np.ndarray, starts: np.ndarray, active: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward log sums as in ``sums``, of scaled scores, and the scaled label pair weights."""
        moves = self.scale * self.pairs + self.allowed()
        weight = np.exp(moves[:-1])
        ahead, behind = np.empty_like(score), np.zeros_like(score)
        with np.errstate(divide="ignore"):
            now = moves[-1] + score[starts]
            ahead[starts] = now
            for t in range(1, len(active)):
                m = active[t]
                at = starts[:m] + t
                most = now[:m].max(axis=1, keepdims=True)
                now = np.log(np.exp(now[:m] - most) @ weight) + most + score[at]
                ahead[at] = now
            for t in range(len(active) - 2, -1, -1):
                at = starts[: active[t + 1]] + t
                now = score[at + 1] + behind[at + 1]
                most = now.max(axis=1, keepdims=True)
                behind[at] = np.log(np.exp(now - most) @ weight.T) + most
        return ahead, behind, moves


@dataclass(frozen=True)
class LearnedTagger:
    """A tagger for ``mentions.extract_with``: mentions as they are written, with their probability."""

    model: Model

    def tag(self, texts: list[str]) -> list[list[tuple[str, str, float]]]:
        found = [list(_WORD.finditer(text)) for text in texts]
        spans = self.model.spans_of([[m.group() for m in words] for words in found])
        return [
            [(text[words[i].start() : words[j - 1].end()], kind, p) for i, j, kind, p in of]
            for text, words, of in zip(texts, found, spans, strict=True)
        ]


def labelled_texts(docs: DataFrame, dictionary: DataFrame, id_col: str = "id", text_col: str = "text", limit: int = TRAIN_DOCS) -> DataFrame:
    """``words, starts, ends, kinds``: a bounded sample of texts as words, with the dictionary's hits on them.

    The sample is the ``limit`` texts of the smallest id hashes, each cut to ``TRAIN_WORDS`` words. Of overlapping hits the
    earliest and longest counts; one phrase of several types counts as the first by name.
    """
    spot = F.pmod(F.xxhash64(id_col), F.lit(1 << 31))
    ids = docs.filter(F.col(text_col).isNotNull()).select(id_col)
    n = ids.count()
    if n > 4 * limit:
        ids = ids.filter(spot < int((1 << 31) * 2 * limit / n))
    chosen = ids.distinct().orderBy(spot, id_col).limit(limit)
    rows = docs.join(F.broadcast(chosen), id_col).groupBy(F.col(id_col).alias("id")).agg(F.min(text_col).alias("text"))
    rows = stage(rows.select("id", F.slice(F.regexp_extract_all("text", F.lit(X.TOKEN), F.lit(0)), 1, TRAIN_WORDS).alias("words")), "sample")
    phrases = dictionary.groupBy("phrase").agg(F.min("entity_detected").alias("entity_detected"))
    phrases = phrases.select("phrase", F.col("phrase").alias("text"), "entity_detected", F.lit(1.0).alias("score"))
    hits = M.extract_gazetteer(rows.select("id", F.array_join("words", " ").alias("text")), phrases)
    places = F.struct("pos", (-F.size(X.tokens(F.col("text")))).alias("less"), F.col("entity_detected").alias("kind"))
    gathered = hits.groupBy("id").agg(F.sort_array(F.collect_list(places)).alias("hits"))
    # Hits in order of place, the longest first; one that begins inside the one before is left out.
    start = F.struct(F.lit(0).alias("free"), F.array().cast("array<struct<pos:int,less:int,kind:string>>").alias("kept"))
    keep = lambda a, h: F.when(h["pos"] >= a["free"], F.struct((h["pos"] - h["less"]).alias("free"), F.concat(a["kept"], F.array(h)).alias("kept"))).otherwise(a)
    kept = F.aggregate("hits", start, keep, lambda a: a["kept"])
    joined = rows.join(gathered.select("id", kept.alias("hits")), "id", "left").filter(F.size("words") > 0)
    hits = F.coalesce("hits", F.array().cast("array<struct<pos:int,less:int,kind:string>>"))
    return joined.select(
        "id",
        "words",
        F.transform(hits, lambda h: h["pos"]).alias("starts"),
        F.transform(hits, lambda h: h["pos"] - h["less"]).alias("ends"),
        F.transform(hits, lambda h: h["kind"]).alias("kinds"),
    )


def _path(labels: Sequence[str], n: int, starts, ends, kinds) -> np.ndarray:
    number, path = {label: k for k, label in enumerate(labels)}, np.zeros(n, np.int64)
    for a, b, kind in zip(starts, ends, kinds, strict=True):
        path[a:b] = number["I-" + kind]
        path[a] = number["B-" + kind]
    return path


def _walk(model: Model, texts: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[Model, int]:
    """One pass over texts: where the best path is wrong, its features lose and the right path's gain.

    Returns the mean of the weights over the pass, which is steadier than the last ones.
    """
    own, pairs = model.own.copy(), model.pairs.copy()
    now, late = Model(model.labels, own, pairs), (np.zeros_like(own), np.zeros_like(pairs))
    seen = 0
    for rows, path in texts:
        guess = now.decode(now.scores(rows))
        wrong = np.flatnonzero(guess != path)
        if len(wrong):
            for target, sign in ((path, 1.0), (guess, -1.0)):
                for into, step in ((own, sign), (late[0], sign * seen)):
                    np.add.at(into, (rows[wrong].ravel(), np.repeat(target[wrong], rows.shape[1])), step)
                for into, step in ((pairs, sign), (late[1], sign * seen)):
                    np.add.at(into, (np.append(-1, target[:-1]), target), step)
        seen += 1
    n = max(seen, 1)
    return Model(model.labels, own - late[0] / n, pairs - late[1] / n), seen


def _rows(model: Model) -> pd.DataFrame:
    """Weights that are not 0 as rows; label pairs lie behind the features."""
    whole = np.concatenate((model.own, model.pairs))
    at, label = np.nonzero(whole)
    return pd.DataFrame({"row": at, "label": label, "weight": whole[at, label]})


def _train_part(shared, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    model: Model = shared.value
    texts = (
        (word_features(words), _path(model.labels, len(words), starts, ends, kinds))
        for batch in batches
        for words, starts, ends, kinds in zip(batch["words"], batch["starts"], batch["ends"], batch["kinds"], strict=True)
    )
    walked, seen = _walk(model, texts)
    rows = _rows(walked) if seen else pd.DataFrame({"row": [], "label": [], "weight": []})
    rows["weight"] *= seen
    yield pd.concat([rows, pd.DataFrame({"row": [-1], "label": [0], "weight": [float(seen)]})])


def train(texts: DataFrame, rounds: int = ROUNDS, parts: int | None = None) -> Model:
    """A model learnt from labelled texts (``words, starts, ends, kinds``), by ``rounds`` of mixing.

    Partitions' weights count by the texts behind them. A row goes to the driver per weight that is not 0, no more than the
    bounded width times the labels. The scale is the one under which a tenth of the sample, by id, is likeliest.
    """
    spark = texts.sparkSession
    held = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(10)) == 0
    rows = stage(texts.repartition(parts or spark.sparkContext.defaultParallelism, F.xxhash64("id")), "labelled")
    types = sorted(r[0] for r in rows.select(F.explode("kinds")).distinct().collect())
    model = Model.empty(types)
    if not types:
        return model
    size = model.own.shape[0]
    fitting = rows.filter(~held)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)
        walked = fitting.mapInPandas(functools.partial(_train_part, shared), "row long, label int, weight double")
        mixed = walked.groupBy("row", "label").agg(F.sum("weight").alias("weight")).toPandas().sort_values(["row", "label"])
        total = mixed.loc[mixed["row"] < 0, "weight"].sum()
        if not total:
            break
        mixed = mixed[mixed["row"] >= 0]
        whole = np.zeros((size + len(model.labels) + 1, len(model.labels)))
        whole[mixed["row"].to_numpy(), mixed["label"].to_numpy()] = mixed["weight"].to_numpy() / total
        model = Model(model.labels, whole[:size], whole[size:])
    few = [(r["words"], _path(model.labels, len(r["words"]), r["starts"], r["ends"], r["kinds"])) for r in rows.filter(held).orderBy("id").limit(200).collect()]
    coded = [(word_features(words), path) for words, path in few]

    def likelihood(scale: float) -> float:
        scaled = Model(model.labels, model.own, model.pairs, scale)
        return sum(scaled.log_likelihood(f, path) for f, path in coded)

    model.scale = max(SCALES, key=likelihood) if coded else 1.0
    return model


def learn(docs: DataFrame, dictionary: DataFrame, id_col: str = "id", text_col: str = "text", limit: int = TRAIN_DOCS, rounds: int = ROUNDS) -> LearnedTagger:
    """A tagger taught by where the phrases of ``dictionary`` occur in ``docs``; it also finds mentions that look and stand alike."""
    return LearnedTagger(train(labelled_texts(docs, dictionary, id_col, text_col, limit), rounds))


def span_accuracy(texts: DataFrame, tagger: LearnedTagger) -> DataFrame:
    """One row ``n_gold, n_found, n_equal, precision, recall, f1`` of a tagger on labelled texts, by whole mentions."""
    model = tagger.model

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gold = found = equal = 0
        for batch in batches:
            spans = model.spans_of([list(words) for words in batch["words"]])
            for of, starts, ends, kinds in zip(spans, batch["starts"], batch["ends"], batch["kinds"], strict=True):
                wanted = set(zip(starts, ends, kinds, strict=True))
                got = {(i, j, kind) for i, j, kind, _ in of}
                gold, found, equal = gold + len(wanted), found + len(got), equal + len(wanted & got)
        yield pd.DataFrame({"n_gold": [gold], "n_found": [found], "n_equal": [equal]})

    columns = ["words", "starts", "ends", "kinds"]
    parts = texts.select(*columns).mapInPandas(count, "n_gold long, n_found long, n_equal long")
    total = parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_gold", "n_found", "n_equal")])
    share = lambda a, b: F.round(F.col(a) / F.nullif(b, F.lit(0)), 6)
    return total.select(
        "*",
        share("n_equal", F.col("n_found")).alias("precision"),
        share("n_equal", F.col("n_gold")).alias("recall"),
        F.round(2 * F.col("n_equal") / F.nullif(F.col("n_gold") + F.col("n_found"), F.lit(0)), 6).alias("f1"),
    )
