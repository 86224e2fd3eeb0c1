"""Values that differ by a few letters, without comparing all pairs.

A value cut into k + 1 segments keeps one of them whole through k edits. So each value of one side is listed under its
segments, each value of the other side looks up its own substrings at the places a segment can have
moved to, and only values that meet are compared. Where a segment is shared by very many values it is cut
out, and what remains of them, which is within k edits as well, is cut into segments again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesift.functions import text as X
from namesift.session import stage

HOT_VALUES = 1_000
ROUNDS = 4
KEY = "struct<key:bigint,rest:string>"


def _key(path: Column, length: Column, place: int, part: Column) -> Column:
    """Lookup key of a segment. A collision only brings together values that are then compared."""
    return F.xxhash64(path, length, F.lit(place), part)


def _without(text: Column, start: Column, n: Column) -> Column:
    """``text`` without the ``n`` characters from ``start`` (from 1)."""
    return F.concat(F.substring(text, F.lit(1), start - 1), F.substring(text, start + n, F.length(text)))


def _segment(length: Column, i: int, k: int) -> tuple[Column, Column]:
    """Start (from 1) and length of the ``i``-th of ``k`` + 1 even segments; the last ones are longer by one."""
    base = F.floor(length / (k + 1)).cast("int")
    short = F.lit(k + 1) - (length - base * (k + 1))
    start = F.lit(1) + base * i + F.greatest(F.lit(i) - short, F.lit(0))
    return start.cast("int"), (base + F.when(F.lit(i) >= short, 1).otherwise(0)).cast("int")


def _shorter(text: Column, k: int) -> Column:
    """All texts that ``text`` becomes when up to ``k`` characters are dropped; it has at most 2 ``k`` of them."""
    found = F.array(text)
    for _ in range(k):
        drop = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: _without(t, i, F.lit(1)))
        more = F.flatten(F.transform(found, lambda t: F.when(F.length(t) > 0, drop(t)).otherwise(F.array(t))))
        found = F.array_distinct(F.concat(found, more))
    return found


def _listed(path: Column, rest: Column, k: int) -> Column:
    """Keys a value is listed under, each with what remains of it: its segments, or its shorter forms if it is too short."""
    length = F.length(rest)
    keys = []
    for i in range(k + 1):
        start, n = _segment(length, i, k)
        part = F.substring(rest, start, n)
        keys.append(F.struct(_key(path, length, i, part).alias("key"), _without(rest, start, n).alias("rest")))
    short = F.transform(_shorter(rest, k), lambda t: F.struct(_key(path, F.lit(-1), -1, t).alias("key"), F.lit(None).cast("string").alias("rest")))
    return F.when(length > k, F.array(*keys)).otherwise(short)


def _looked_up(path: Column, rest: Column, k: int) -> Column:
    """Keys a value looks up: its substrings where a segment of a value of each length it may match can lie.

    With i segments before and k - i after the one that is kept, no more than i edits need be
    looked for before it and k - i after it: if more lie there, another segment is kept that obeys this.
    """
    own, none = F.length(rest), F.array().cast(f"array<{KEY}>")
    found = none

    def substrings(length: Column, i: int, more: int) -> Column:
        start, n = _segment(length, i, k)
        low = F.greatest(start - i, start + more - (k - i), F.lit(1))
        high = F.least(start + i, start + more + (k - i), own - n + 1)

        def lookup(p: Column) -> Column:
            return F.struct(_key(path, length, i, F.substring(rest, p, n)).alias("key"), _without(rest, p, n).alias("rest"))

        return F.when((length > k) & (low <= high), F.transform(F.sequence(low, high), lookup)).otherwise(none)

    for more in range(-k, k + 1):
        found = F.concat(found, *[substrings(own - more, i, more) for i in range(k + 1)])
    short = F.transform(_shorter(rest, k), lambda t: F.struct(_key(path, F.lit(-1), -1, t).alias("key"), F.lit(None).cast("string").alias("rest")))
    return F.array_distinct(F.concat(found, F.when(own <= 2 * k, short).otherwise(none)))


def _spelled(df: DataFrame, value: str, normalize: bool) -> DataFrame:
    text = X.normalize_label(F.col(value)) if normalize else F.col(value)
    values = df.select(text.alias("value")).filter("value != ''").distinct()
    return values.select("value", F.col("value").alias("rest"), F.lit(0).cast("bigint").alias("path"))


def similar_values(
    left: DataFrame,
    right: DataFrame,
    left_value: str,
    right_value: str,
    k: int = 1,
    normalize: bool = True,
    hot: int = HOT_VALUES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """Pairs of different-or-equal values within ``k`` edits: ``left_value, right_value, distance``.

    One row per pair of different spellings, so copies of a record never multiply; join the records back by
    value. NULL and empty values match nothing. Keys that more than ``hot`` values of the right side are
    listed under are cut out and the rest is looked up again, up to ``rounds`` times; what is hot even then is
    compared in a join whose skew is split. The result is the same for any ``hot`` and ``rounds``.
    """
    if not 1 <= k <= 3:
        raise ValueError("k is 1, 2 or 3")
    out = None
    l_rows, r_rows = stage(_spelled(left, left_value, normalize), "left"), stage(_spelled(right, right_value, normalize), "right")
    for step in range(rounds):
        l_keys = l_rows.select("value", F.explode(_looked_up(F.col("path"), F.col("rest"), k)).alias("k")).select("value", "k.*")
        r_keys = r_rows.select("value", F.explode(_listed(F.col("path"), F.col("rest"), k)).alias("k")).select("value", "k.*")
        busy = None
        if step + 1 < rounds:
            l_keys, r_keys = stage(l_keys, "looked-up"), stage(r_keys, "listed")
            counted = r_keys.filter("rest is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
            busy = stage(counted.filter(F.col("n") > hot).select("key"), "hot-keys")
            if busy.isEmpty():
                busy = None
        l_cold, r_cold = l_keys, r_keys
        if busy is not None:
            l_cold, r_cold = l_keys.join(busy, "key", "left_anti"), r_keys.join(busy, "key", "left_anti")
        met = l_cold.select("key", F.col("value").alias("left_value")).join(r_cold.select("key", F.col("value").alias("right_value")), "key")
        met = met.withColumn("distance", F.levenshtein("left_value", "right_value", k)).filter("distance >= 0").drop("key")
        out = met if out is None else out.unionByName(met)
        if busy is None:
            break
        again = lambda rows: rows.join(busy, "key").select("value", "rest", F.col("key").alias("path")).distinct()
        l_rows, r_rows = stage(again(l_keys), "left-again"), stage(again(r_keys), "right-again")
    return out.distinct()


def similar_within(df: DataFrame, value: str, k: int = 1, normalize: bool = True, hot: int = HOT_VALUES) -> DataFrame:
    """Pairs of different values of one column within ``k`` edits, each once: ``left_value < right_value``."""
    return similar_values(df, df, value, value, k, normalize, hot).filter("left_value < right_value")
