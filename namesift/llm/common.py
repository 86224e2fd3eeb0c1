"""Helpers the operators share: row keys, words as hashes, connected components."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from namesift.operators import sizing
from namesift.session import stage

MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3
_INVERSE = pow(_BASE, -1, 1 << 64)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def row_key(*columns: str) -> Column:
    """A 64-bit key of a row's content; equal rows, and only those, share it.

    It stands in for doc_id where ids may be null or repeated.
    """
    return F.xxhash64(*[F.struct(c) for c in columns])


def packed(docs: DataFrame) -> DataFrame:
    """(doc, row): each row as one struct beside its key, so that no added name can clash with its columns."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), row_key("doc_id", "text").alias("row"))


def without_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` without the rows whose key is in column ``row`` of ``rows``, a stage table.

    Its keys are counted and broadcast up to a bound, as a shuffle join would move every text.
    """
    n = rows.count()
    gone = sizing.broadcast_if_small(rows.select("row"), {"rows": n, "bytes": 8 * n})
    return packed(docs).join(gone, "row", "left_anti").select("doc.*")


def with_ids(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``texts`` whose ``id`` is in the stage table ``ids``, one of each, as a stage table.

    No other text moves: so many ids at a time are broadcast and ``texts`` is read once for each part of them.
    """
    parts = max(1, -(-ids.count() // sizing.BROADCAST_ROWS))
    found = []
    for i in range(parts):
        part = ids.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == i)
        found.append(stage(texts.join(F.broadcast(part), "id", "left_semi").dropDuplicates(["id"]), "compared"))
    return reduce(DataFrame.unionByName, found)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that equal bits of input differ everywhere in the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[:1] = 1
    done = min(n, 1)
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


class Powers:
    """Powers of the hash base and of its inverse, grown to the longest text seen."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = _powers(size, _BASE), _powers(size, _INVERSE)
        return self.up, self.down


def prefix_sums(data: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Sums of byte times power up to each place, and the inverse powers.

    The difference of two sums times the inverse power at the first is a polynomial
    hash of the bytes between them.
    """
    up, down = powers.upto(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return total, down


def word_hashes(data: np.ndarray, in_word: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every run of ``in_word`` bytes, with its start and end.

    Prefix sums of byte times power give each run's polynomial hash at once, so the
    cost is a few passes over the bytes whatever the number of words.
    """
    edge = np.flatnonzero(np.diff(np.concatenate(([0], in_word.view(np.int8), [0]))))
    start, end = edge[0::2], edge[1::2]
    total, down = prefix_sums(data, powers)
    value = (total[end] - total[start]) * down[start]
    return mix(value ^ ((end - start).astype(np.uint64) * MIX)), start, end


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words; all words as one run if there are fewer."""
    if not len(words):
        return np.zeros(0, np.uint64)
    size = min(size, len(words))
    n = len(words) - size + 1
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = (out + words[i : i + n]) * MIX
        out ^= out >> np.uint64(32)
    return mix(out)


def signature(edges: DataFrame) -> tuple:
    """Count and hash sum of an edge table; two tables that agree in both are the same."""
    row = edges.select(F.xxhash64("u", "v").cast("decimal(38,0)").alias("h")).agg(F.count("*"), F.sum("h")).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) with the smallest node of each component, from edges (u, v).

    Alternates the large-star and small-star steps, each of which rewires
    neighbours to the smallest one they know; every step is an aggregate and a join
    on the node, so a hot node is split by the skew join, and rounds grow with the
    logarithm of a component's width. Each round is written to the shared folder,
    which cuts the lineage. Nodes without an edge to another node are left out.
    """
    edges = stage(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(),
        "edges",
    )
    before = signature(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        )
        edges = stage(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        after = signature(edges)
        if after == before:
            break
        before = after
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
