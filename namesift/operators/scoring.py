"""How likely a pair of records is one entity: agreement weights learnt from the pairs themselves.

Each pair is reduced to a vector of agreement levels, one per comparison. Pairs with the
same vector are alike to the model, so it is fitted on the counts of the vectors alone. Among matches a
level occurs with probability m, among other pairs with probability u; a comparison is worth log2(m / u).
Both, and the share of matches, are found by expectation-maximisation, without labels.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PATTERNS = 100_000
ROUNDS = 25
# No level is impossible among matches or others, so no weight is infinite.
LEAST_SHARE = 1e-6


@dataclass(frozen=True)
class Weights:
    """Share of matches, and per comparison the probabilities of levels 0, 1, .. among matches (m) and others (u)."""

    matches: float
    m: Mapping[str, Sequence[float]]
    u: Mapping[str, Sequence[float]]

    def weight(self, name: str, level: int) -> float:
        return math.log2(self.m[name][level] / self.u[name][level])

    def prior(self) -> float:
        """Weight that a pair has before anything is compared."""
        return math.log2(self.matches / (1 - self.matches))


def agreement(left: Column, right: Column, *levels: Column) -> Column:
    """Level of agreement: the number of ``levels``, listed from the weakest, up to the last one that holds.

    Level 0 if none holds; NULL if a side is missing, which says nothing for or against a match.
    """
    level = F.lit(0)
    for k, holds in enumerate(levels, 1):
        level = F.when(F.coalesce(holds, F.lit(False)), k).otherwise(level)
    return F.when(left.isNotNull() & right.isNotNull(), level)


def compare(pairs: DataFrame, comparisons: Mapping[str, Column]) -> DataFrame:
    """``pairs`` with one column of agreement levels per comparison."""
    return pairs.withColumns({name: level.cast("int") for name, level in comparisons.items()})


def patterns(compared: DataFrame, names: Sequence[str]) -> DataFrame:
    """Vectors of levels with the number ``n`` of pairs that show them.

    Counted before the shuffle, so however many pairs there are, a task sends each vector once.
    """
    return compared.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))


def _rescaled(sums: Mapping[str, list[float]]) -> dict[str, tuple[float, ...]]:
    out = {}
    for name, levels in sums.items():
        held = [max(x, LEAST_SHARE * sum(levels), LEAST_SHARE) for x in levels]
        out[name] = tuple(x / sum(held) for x in held)
    return out


def maximise(counts: Sequence[tuple[tuple[int | None, ...], int]], start: Weights, rounds: int = ROUNDS) -> Weights:
    """Weights after ``rounds`` of expectation-maximisation from ``start``, over vectors of levels with their counts.

    Each round holds every vector to be a match with the probability the weights give it, and sets
    the weights to the shares of levels this implies. A missing level takes no part. Counts are
    read in one fixed order, so the result does not depend on how they arrived.
    """
    names = list(start.m)
    counts = sorted(counts, key=lambda c: tuple(-1 if x is None else x for x in c[0]))
    for _ in range(rounds):
        m = {name: [0.0] * len(start.m[name]) for name in names}
        u = {name: [0.0] * len(start.u[name]) for name in names}
        matched = total = 0.0
        for levels, n in counts:
            hit, miss = start.matches, 1 - start.matches
            for name, level in zip(names, levels, strict=True):
                if level is not None:
                    hit *= start.m[name][level]
                    miss *= start.u[name][level]
            p = hit / (hit + miss)
            matched += n * p
            total += n
            for name, level in zip(names, levels, strict=True):
                if level is not None:
                    m[name][level] += n * p
                    u[name][level] += n * (1 - p)
        if not total:
            break
        share = min(max(matched / total, LEAST_SHARE), 1 - LEAST_SHARE)
        start = Weights(share, _rescaled(m), _rescaled(u))
    return start


def starting_weights(levels: Mapping[str, int], matches: float = 0.1) -> Weights:
    """Weights to start from, by the number of levels of each comparison: a level is twice as likely as the one
    below it among matches and half as likely among others."""
    m, u = {}, {}
    for name, k in levels.items():
        up = [2.0**i for i in range(k)]
        m[name] = tuple(x / sum(up) for x in up)
        u[name] = tuple(x / sum(up) for x in reversed(up))
    return Weights(matches, m, u)


def fit(compared: DataFrame, levels: Mapping[str, int], rounds: int = ROUNDS, start: Weights | None = None) -> Weights:
    """Weights learnt from compared pairs. Only the counts of different vectors reach the driver, and their number is bounded
    by the levels; with more than ``PATTERNS`` possible vectors this is an error."""
    possible = math.prod(k + 1 for k in levels.values())
    if possible > PATTERNS:
        raise ValueError(f"{possible} possible vectors of levels; compare less finely")
    names = list(levels)
    rows = patterns(compared, names).collect()
    return maximise([(tuple(r[name] for name in names), r["n"]) for r in rows], start or starting_weights(levels), rounds)


def score(compared: DataFrame, weights: Weights) -> DataFrame:
    """Add ``weight``, the evidence for a match in bits, and ``probability``, which also counts how rare matches are.

    Column expressions only: no join, no shuffle. A missing level adds nothing; a level the weights do not
    know gives NULL.
    """

    def worth(name: str) -> Column:
        level = F.col(name)
        chain = functools.reduce(lambda c, k: c.when(level == k, weights.weight(name, k)), range(len(weights.m[name])), F.when(level.isNull(), 0.0))
        return chain

    total = functools.reduce(operator.add, [worth(name) for name in weights.m])
    scored = compared.withColumn("weight", total)
    odds = F.pow(F.lit(2.0), F.col("weight") + F.lit(weights.prior()))
    return scored.withColumn("probability", odds / (odds + 1))


def decide(scored: DataFrame, match: float, possible: float) -> DataFrame:
    """Add ``decision``: ``match``, ``possible`` for review, or ``none``, by two bounds on the probability."""
    p = F.col("probability")
    return scored.withColumn("decision", F.when(p >= match, "match").when(p >= possible, "possible").otherwise("none"))


def best_partners(scored: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """The pair of highest weight for each left record, ties to the smallest right one.

    An aggregate, not a window, so a left record with very many partners is reduced before it is shuffled.
    """
    rest = [c for c in scored.columns if c not in (left_id, right_id, "weight")]
    best = F.min(F.struct((-F.col("weight")).alias("w"), F.col(right_id), *rest)).alias("b")
    found = scored.filter(F.col("weight").isNotNull()).groupBy(left_id).agg(best)
    return found.select(left_id, f"b.{right_id}", (-F.col("b.w")).alias("weight"), *[f"b.{c}" for c in rest])
