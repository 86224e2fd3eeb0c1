"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namesift.llm.common import MIX, Powers, documents, row_key, shingle_hashes, without_rows, word_hashes
from namesift.session import stage

LEAST = 5
COVERAGE = 0.5
# The seed filter is a bit set of this many bits, 8 MB, whatever the benchmark's size.
FILTER_BITS = 1 << 26
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def words_of(text: bytes | None, powers: Powers) -> np.ndarray:
    """Hashes of the words of a text: runs of digits, letters a to z and all beyond ASCII, lower-cased."""
    data = _LOWER[np.frombuffer(text or b"", np.uint8)]
    return word_hashes(data, _WORD[data], powers)[0]


def seeds_of(words: np.ndarray, least: int) -> np.ndarray:
    return shingle_hashes(words, least) if len(words) >= least else np.zeros(0, np.uint64)


def _rolling(words: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hash of every run of ``size`` words, from prefix sums."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(words), MIX))))
    total = np.concatenate(([np.uint64(0)], np.cumsum(words * up[1:])))
    down = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, np.uint64(pow(int(MIX), -1, 1 << 64))))))
    return (total[size:] - total[:n]) * down


def tiles(text: np.ndarray, item: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in text, start in item, length) of the tiles.

    Among words not yet tiled the longest common run is tiled first, and of equal
    runs the one earliest in the item and then in the text; words of a tile are
    used once. Runs are found by Karp-Rabin hashes of ``least`` words and extended.
    Rounds go on until no run of ``least`` free words is left, so passages count in
    whatever order the text has them.
    """
    free_text, free_item = np.ones(len(text), bool), np.ones(len(item), bool)
    in_text, in_item = _rolling(text, least), _rolling(item, least)
    places: dict[int, list[int]] = {}
    for p in np.flatnonzero(np.isin(in_text, in_item)).tolist():
        places.setdefault(int(in_text[p]), []).append(p)
    found: list[tuple[int, int, int]] = []
    while True:
        best: list[tuple[int, int]] = []
        most = least - 1
        for q, key in enumerate(in_item.tolist()):
            if not free_item[q : q + least].all():
                continue
            for p in places.get(key, ()):
                if not free_text[p : p + least].all():
                    continue
                room = min(len(text) - p, len(item) - q)
                a, b = slice(p, p + room), slice(q, q + room)
                same = (text[a] == item[b]) & free_text[a] & free_item[b]
                length = room if same.all() else int(same.argmin())
                if length > most:
                    most, best = length, [(q, p)]
                elif length == most and length >= least:
                    best.append((q, p))
        if most < least:
            return found
        for q, p in best:
            if free_text[p : p + most].all() and free_item[q : q + most].all():
                free_text[p : p + most] = free_item[q : q + most] = False
                found.append((p, q, most))


def _whole_seed(words: np.ndarray) -> np.ndarray:
    """Seeds of all runs as long as ``words``, kept apart from those of other lengths."""
    return seeds_of(words, len(words)) ^ (np.uint64(len(words)) * MIX)


def _hashed(rows: DataFrame, least: int) -> DataFrame:
    """Items as word hashes, and their seeds with how often each occurs.

    An item of fewer than ``least`` words has itself as its only seed; one without words has none and is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            words = [words_of(t.as_py(), powers) for t in batch.column(2)]
            seeds = [np.unique(seeds_of(w, least) if len(w) >= least else _whole_seed(w) if len(w) else w, return_counts=True) for w in words]
            longs = [words, [s for s, _ in seeds], [n.astype(np.int64) for _, n in seeds]]
            arrays = [pa.array([x.view(np.int64) for x in xs], pa.list_(pa.int64())) for xs in longs]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], ["item", "item_id", "words", "seeds", "times"])

    keyed = rows.select(row_key("item_id", "text"), F.col("item_id").cast("long"), F.col("text").cast("binary"))
    schema = "item long, item_id long, words array<long>, seeds array<long>, times array<long>"
    return keyed.mapInArrow(run, schema).where("size(seeds) > 0")


def _bits(seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return seeds % np.uint64(FILTER_BITS), (seeds >> np.uint64(32)) % np.uint64(FILTER_BITS)


def seed_filter(items: DataFrame) -> np.ndarray:
    """Bit set of the items' seeds, two bits each; its size is fixed."""
    seed = F.explode("seeds").alias("s")
    low = F.col("s").bitwiseAND(F.lit(FILTER_BITS - 1))
    high = F.shiftrightunsigned("s", 32).bitwiseAND(F.lit(FILTER_BITS - 1))
    bits = items.select(seed).select(F.explode(F.array(low, high)).alias("bit"))
    words = bits.select(F.shiftright("bit", 6).alias("i"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("b"))
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for i, b in words.groupBy("i").agg(F.bit_or("b").alias("b")).toPandas().itertuples(index=False):
        out[i] = b
    return out.view(np.uint64)


def overlaps(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """(row, doc_id, item_id, n_tiles, n_covered, n_words, coverage) of contaminated documents.

    A document and an item that share runs of ``least`` words are tiled; the pair
    is returned if tiles cover at least ``coverage`` of the item's words. ``row`` is
    the content key of doc_id and text. Documents first pass a bit set of the
    items' seeds inside their scan, so only those with a likely seed leave their
    task; the join on the seed itself decides. A tile has one seed per ``least`` words at
    least, so pairs with fewer shared seeds than ``coverage`` needs are dropped before
    any words travel. An item of fewer than ``least`` words is found where a document has all of
    it in one run. Null and empty texts, items without words and empty tables give no rows; repeated items give
    a row each.
    """
    items = stage(_hashed(benchmark, least), "items")
    short = sorted(r[0] for r in items.select(F.size("words").alias("n")).where(F.col("n") < least).distinct().collect())
    bits = docs.sparkSession.sparkContext.broadcast(seed_filter(items).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, held = Powers(), np.frombuffer(bits.value, np.uint64)

        def likely(bit: np.ndarray) -> np.ndarray:
            return (held[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1

        for batch in batches:
            keep, words, seeds = [], [], []
            for i, text in enumerate(batch.column(2)):
                own = words_of(text.as_py(), powers)
                own_seeds = np.concatenate([seeds_of(own, least), *[seeds_of(own, n) ^ (np.uint64(n) * MIX) for n in short if len(own) >= n]])
                low, high = _bits(own_seeds)
                hits = np.unique(own_seeds[likely(low) & likely(high)])
                if len(hits):
                    keep.append(i)
                    words.append(own.view(np.int64))
                    seeds.append(hits.view(np.int64))
            ids = [batch.column(c).take(pa.array(keep, pa.int64())) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [*ids, pa.array(words, pa.list_(pa.int64())), pa.array(seeds, pa.list_(pa.int64()))],
                ["row", "doc_id", "words", "seeds"],
            )

    keyed = docs.select(row_key("doc_id", "text"), F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    near = stage(keyed.mapInArrow(run, "row long, doc_id long, words array<long>, seeds array<long>"), "seeded")
    own = near.select("row", F.explode("seeds").alias("seed")).distinct()
    listed = items.select("item", F.size("words").alias("n"), F.explode(F.arrays_zip("seeds", "times")).alias("s"))
    shared = own.join(listed.select("item", "n", F.col("s.seeds").alias("seed"), "s.times"), "seed")
    enough = F.sum("times") * least >= F.first("n") * coverage
    pairs = shared.groupBy("row", "item").agg(enough.alias("enough")).where("enough").select("row", "item")
    texts = near.select("row", "doc_id", F.col("words").alias("text"))
    wording = items.select("item", "item_id", "words")
    pairs = pairs.join(wording, "item").join(texts, "row")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, covered, size = [], [], []
            for a, b in zip(batch.column(3), batch.column(4), strict=True):
                item = a.values.to_numpy().view(np.uint64)
                found = tiles(b.values.to_numpy().view(np.uint64), item, min(least, len(item)))
                counts.append(len(found))
                covered.append(sum(t[2] for t in found))
                size.append(len(item))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), *[pa.array(x, pa.int64()) for x in (counts, covered, size)]],
                ["row", "doc_id", "item_id", "n_tiles", "n_covered", "n_words"],
            )

    schema = "row long, doc_id long, item_id long, n_tiles long, n_covered long, n_words long"
    tiled = pairs.select("row", "doc_id", "item_id", "words", "text").mapInArrow(tile, schema)
    return tiled.withColumn("coverage", F.col("n_covered") / F.col("n_words")).where(F.col("coverage") >= coverage)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item."""
    return without_rows(docs, stage(overlaps(docs, benchmark).select("row").distinct(), "contaminated"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contaminated documents, one row per benchmark item they hold."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return overlaps(documents(spark, sf_dir), benchmark).drop("row")
