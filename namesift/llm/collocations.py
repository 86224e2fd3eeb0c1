"""Phrases whose words occur together more often than their parts would: direct-address tiling.

Words are numbered by falling frequency, and a pair of neighbours is a cell of the square of
all pairs, which is cut into tiles. Tiles of the most frequent words are counted as dense
arrays, all others as sorted lists of cells, many sparse tiles together in a strip. Frequent pairs are numbered by
frequency in their turn and paired with their neighbours, which gives phrases one word longer.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from namesift.llm.common import documents
from namesift.operators.sizing import broadcast_if_small, measure
from namesift.session import stage

LEAST, LONGEST, TOP = 100, 5, 2_000
# Words of a block, which is coded with a dictionary of its own; a document is never cut.
BLOCK_WORDS = 1_000_000
# Ids along one side of a tile, and of the square of tiles that have rows of their own.
SIDE, HOT = 256, 2_048
CELLS = SIDE * SIDE
# Pairs in the square from which it is counted as one array, and cells of a tile that are summed as one.
DENSE_PAIRS, DENSE_CELLS = HOT * HOT // 16, CELLS // 8
# Strips that sparse tiles are dealt into at least, and words of the corpus behind one.
STRIPS, STRIP_WORDS = 64, 1 << 24
# Listed cells that are merged at once.
LISTED = 1 << 22
# Cells of one tile or strip over all blocks beyond which its sum is split over several tasks.
BUSY = 1 << 24
# Rows of one frequency that are numbered by one task, and numbers a task of the last ranking takes.
NUMBERED, SALTS = 50_000, 64
# Frequent words or pairs up to which every task gets them; beyond, they are dealt to the blocks that hold them.
SENT_ROWS, SENT_BYTES = 500_000, 8 << 20

_BREAK = b"\xff"  # no byte of UTF-8
_ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", _BREAK * 10)


def tokens(text: bytes | None) -> list[bytes]:
    """Lower-cased words, with a break wherever a piece ends."""
    found = (text or b"").lower().translate(_ENDS).replace(_BREAK, b" \xff ").split()
    found.append(_BREAK)
    return found


def pack(values: np.ndarray) -> bytes:
    """Whole numbers, compressed with equal bytes side by side."""
    return pa.compress(values.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def blocks(docs: DataFrame, size: int = BLOCK_WORDS) -> DataFrame:
    """(block, lang, n, words, counts, size, seq): texts of one language as numbers of their block's own words.

    Number 0 is the break between pieces. ``n`` counts words, ``size`` words and breaks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 24, 0
        open_blocks: dict[str, tuple[defaultdict, list[np.ndarray]]] = {}
        held: dict[str, int] = {}

        def close(lang: str) -> pa.RecordBatch:
            nonlocal made
            number, parts = open_blocks.pop(lang)
            seq = np.concatenate(parts)
            counts = np.bincount(seq, minlength=len(number))[1:]
            made += 1
            rows = [[first + made], [lang], [int(counts.sum())], [list(number)[1:]], [counts], [held.pop(lang)], [pack(seq)]]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            names = ["block", "lang", "n", "words", "counts", "size", "seq"]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows, kinds, strict=True)], names)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if lang not in open_blocks:
                    open_blocks[lang], held[lang] = (defaultdict(count(1).__next__, {_BREAK: 0}), []), 0
                number, parts = open_blocks[lang]
                found = tokens(text.as_py())
                parts.append(np.fromiter(map(number.__getitem__, found), np.int32, len(found)))
                held[lang] += len(found)
                if held[lang] >= size:
                    yield close(lang)
        for lang in list(open_blocks):
            yield close(lang)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "block long, lang string, n long, words array<binary>, counts array<long>, size long, seq binary")


def ranked(found: DataFrame, *key: str) -> DataFrame:
    """Add ``id``, the place of each row in its language by falling ``f``, from 0; ties by a hash of ``key``.

    Rows of one frequency are numbered in cells of a bounded size and the cells in order, so no task sorts a
    language.
    """
    found = stage(found, "found")
    cells = found.count() // NUMBERED + 1
    found = found.withColumn("cell", F.pmod(F.xxhash64(*key), F.lit(cells)))
    sizes = found.groupBy("lang", "f", "cell").agg(F.count("*").alias("size"))
    upto = Window.partitionBy("lang").orderBy(F.col("f").desc(), "cell").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("lang", "f", "cell", F.coalesce(F.sum("size").over(upto), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("lang", "f", "cell").orderBy(*key))
    rows = found.withColumn("inside", inside).join(sizes, ["lang", "f", "cell"])
    return rows.withColumn("id", F.col("before") + F.col("inside") - 1).drop("cell", "inside", "before")


def _code(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Tile and cell of pairs as one number; ids stay below 2^31."""
    return (x >> 8 << 39) | (y >> 8 << 16) | ((x & 255) << 8) | (y & 255)


def _strip(tile_x, tile_y, strips: int):
    """Strip of a sparse tile; the same for numpy arrays and columns."""
    return (tile_x * 1_000_003 + tile_y * 7_919) % strips


def count_pairs(x: np.ndarray, y: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(code, count) of the different pairs by code: those in the square of the most frequent ids, and all others.

    The square is counted as one directly addressed array if it holds many pairs, everything else by a sort.
    """
    hot = (x < HOT) & (y < HOT)
    rest = np.unique(_code(x[~hot], y[~hot]), return_counts=True)
    x, y = x[hot], y[hot]
    if len(x) < DENSE_PAIRS:
        return np.unique(_code(x, y), return_counts=True), rest
    square = np.bincount(x * HOT + y, minlength=HOT * HOT)
    at = np.flatnonzero(square)
    code = _code(at // HOT, at % HOT)
    order = np.argsort(code)
    return (code[order], square[at][order]), rest


TILES = "lang string, tile long, block long, n long, cells binary, counts binary"


def _tile_rows(lang: str, block: int, tiles: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Rows of tiles (key, codes, counts): cells of a square's tile as they are, codes of a strip by their differences."""
    cells = [(c & 0xFFFF).astype("<u2").tobytes() if k >= 0 else pack(np.diff(c, prepend=0)) for k, c, _ in tiles]
    counts = [n.astype("<i8").tobytes() if k >= 0 else pack(n) for k, _, n in tiles]
    columns = [
        pa.array([lang] * len(tiles), pa.string()),
        pa.array([k for k, _, _ in tiles], pa.int64()),
        pa.array([block] * len(tiles), pa.int64()),
        pa.array([len(c) for _, c, _ in tiles], pa.int64()),
        pa.array(cells, pa.binary()),
        pa.array(counts, pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["lang", "tile", "block", "n", "cells", "counts"])


def _codes(key: int, n: int, cells: bytes) -> np.ndarray:
    return (key << 16 | np.frombuffer(cells, "<u2").astype(np.int64)) if key >= 0 else np.cumsum(unpack(cells, n))


def _pieces(keys: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    order = np.argsort(keys, kind="stable")
    keys, codes, counts = keys[order], codes[order], counts[order]
    edges = np.flatnonzero(np.diff(keys)) + 1
    return [(int(k), c, n) for k, c, n in zip(keys[np.append(0, edges)], np.split(codes, edges), np.split(counts, edges), strict=True)] if len(keys) else []


def tiles(ids: DataFrame, strips: int) -> DataFrame:
    """(lang, tile, block, n, cells, counts): how often neighbours occur in each block.

    A row per tile of the square and, under negative numbers, per strip of sparse tiles, so a block has a
    bounded number of rows whatever the number of tiles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                seq = unpack(row["seq"], row["size"])
                both = (seq[:-1] >= 0) & (seq[1:] >= 0)
                (hot, m), (rest, n) = count_pairs(seq[:-1][both], seq[1:][both])
                found = _pieces(hot >> 16, hot, m) + _pieces(-1 - _strip(rest >> 39, rest >> 16 & (1 << 23) - 1, strips), rest, n)
                if found:
                    yield _tile_rows(row["lang"], row["block"], found)

    return ids.select("lang", "block", "size", "seq").mapInArrow(run, TILES)


class TileSum:
    """Counts of one tile or strip over many blocks: a list of cells, and for a tile with many one dense array."""

    def __init__(self, key: int) -> None:
        self.key = key
        self.codes: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.listed = 0
        self.dense: np.ndarray | None = None

    def add(self, n: int, cells: bytes, counts: bytes) -> None:
        codes = _codes(self.key, n, cells)
        number = np.frombuffer(counts, "<i8") if self.key >= 0 else unpack(counts, n)
        if self.dense is not None:
            self.dense[codes & 0xFFFF] += number
            return
        self.codes.append(codes)
        self.counts.append(number)
        self.listed += n
        if self.key >= 0 and self.listed >= DENSE_CELLS:
            self.dense = np.zeros(CELLS, np.int64)
            for a, b in zip(self.codes, self.counts, strict=True):
                self.dense[a & 0xFFFF] += b
        elif self.listed >= LISTED and len(self.codes) > 1:
            codes, number = self._merged()
            self.codes, self.counts, self.listed = [codes], [number], 0

    def _merged(self) -> tuple[np.ndarray, np.ndarray]:
        codes = np.concatenate(self.codes)
        order = np.argsort(codes, kind="stable")
        codes = codes[order]
        first = np.flatnonzero(np.diff(codes, prepend=-1))
        return codes[first], np.add.reduceat(np.concatenate(self.counts)[order], first)

    def result(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes with at least ``least`` pairs, and their counts."""
        if self.dense is not None:
            at = np.flatnonzero(self.dense >= least)
            return self.key << 16 | at, self.dense[at]
        codes, n = self._merged()
        return codes[n >= least], n[n >= least]


def _summed(rows: DataFrame, least: int, salt: str | None = None) -> DataFrame:
    """Tiles summed one after the other in the order of their keys, so a task holds one at a time.

    With a ``salt`` the sums are rows of tiles again; without, (lang, x, y, f) of the pairs with at least ``least``.
    """
    key = ["lang", "tile", *([salt] if salt else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None

        def out() -> pa.RecordBatch:
            codes, n = total.result(1 if salt else least)
            if salt:
                return _tile_rows(at[0], at[2], [(at[1], codes, n)])
            x, y = codes >> 39 << 8 | (codes >> 8 & 255), (codes >> 16 & (1 << 23) - 1) << 8 | (codes & 255)
            return pa.RecordBatch.from_arrays([pa.array([at[0]] * len(n), pa.string()), pa.array(x), pa.array(y), pa.array(n)], ["lang", "x", "y", "f"])

        for batch in batches:
            for i, k in enumerate(zip(*[batch.column(c).to_pylist() for c in key], strict=True)):
                if k != at:
                    if at is not None:
                        yield out()
                    at, total = k, TileSum(k[1])
                total.add(*[batch.column(c)[i].as_py() for c in ("n", "cells", "counts")])
        if at is not None:
            yield out()

    dealt = rows.select(*key, "n", "cells", "counts").repartition(*key).sortWithinPartitions(*key)
    return dealt.mapInArrow(run, TILES if salt else "lang string, x long, y long, f long")


def frequent_pairs(tiled: DataFrame, least: int, busy: int = BUSY) -> DataFrame:
    """(lang, x, y, f) of the pairs that occur ``least`` times or more, over all blocks.

    A tile or strip with more than ``busy`` cells over all blocks is summed in several tasks first.
    """
    crowded = tiled.groupBy("lang", "tile").agg(F.ceil(F.sum("n") / busy).alias("salts")).where("salts > 1")
    crowded = stage(crowded, "crowded")
    if not crowded.isEmpty():
        dealt = tiled.join(broadcast_if_small(crowded, measure(crowded, F.col("lang"))), ["lang", "tile"], "left")
        part = _summed(dealt.where("salts is not null").withColumn("salt", F.pmod("block", "salts")), 1, "salt")
        tiled = part.unionByName(dealt.where("salts is null").select(*part.columns))
    return _summed(tiled, least)


def hits(tiled: DataFrame, pairs: DataFrame, strips: int) -> DataFrame:
    """(block, codes, ids): the frequent pairs that each block holds, with their ids.

    Tiles and strips meet the frequent pairs that lie in them.
    """
    x, y = F.shiftright("x", 8), F.shiftright("y", 8)
    square = F.shiftleft(x, 23).bitwiseOR(y)
    key = F.when((F.col("x") < HOT) & (F.col("y") < HOT), square).otherwise(-1 - _strip(x, y, strips))
    cell = F.shiftleft(F.col("x").bitwiseAND(255), 8).bitwiseOR(F.col("y").bitwiseAND(255))
    code = F.shiftleft(square, 16).bitwiseOR(cell)
    known = pairs.groupBy("lang", key.alias("tile")).agg(F.sort_array(F.collect_list(F.struct(code.alias("code"), "id"))).alias("known"))
    known = known.select("lang", "tile", F.col("known.code").alias("known"), F.col("known.id").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, numbers = [], []
            for i in range(batch.num_rows):
                codes = _codes(*[batch.column(c)[i].as_py() for c in (1, 2, 3)])
                listed, ids = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (4, 5))
                at = np.minimum(np.searchsorted(listed, codes), len(listed) - 1)
                hit = listed[at] == codes
                found.append(codes[hit].tobytes())
                numbers.append(ids[at[hit]].astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), pa.array(numbers, pa.binary())], ["block", "codes", "ids"])

    met = tiled.select("lang", "tile", "block", "n", "cells").join(known, ["lang", "tile"])
    met = met.select("block", "tile", "n", "cells", "known", "ids")
    return met.mapInArrow(run, "block long, codes binary, ids binary").where(F.octet_length("codes") > 0)


ID_BLOCKS = "block long, lang string, size long, seq binary"


def _block_rows(rows: list[tuple[int, str, np.ndarray]]) -> dict[str, list]:
    rows = [r for r in rows if len(r[2])]
    return {"block": [r[0] for r in rows], "lang": [r[1] for r in rows], "size": [len(r[2]) for r in rows], "seq": [pack(r[2]) for r in rows]}


_BLOCK = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("size", pa.int64()), ("seq", pa.binary())])


def _dealt(coded: DataFrame, found: DataFrame, rename) -> DataFrame:
    """Blocks whose numbers ``rename`` replaced by means of the rows of ``found`` for the block."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.to_pylist() if right.num_rows else []
        return pa.table(_block_rows([(r["block"], r["lang"], rename(unpack(r["seq"], r["size"]), right)) for r in rows]), _BLOCK)

    rows = coded.select("block", "lang", "size", "seq")
    found = found.select(F.col("block").alias("of"), *[c for c in found.columns if c != "block"])
    return rows.groupBy("block").cogroup(found.groupBy("of")).applyInArrow(run, ID_BLOCKS)


def _sent(coded: DataFrame, known: dict, rename, *extra: str) -> DataFrame:
    """Blocks whose numbers ``rename`` replaced by means of what every task was sent for their language."""
    shared = coded.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if r["lang"] in shared.value:
                    rows = _block_rows([(r["block"], r["lang"], rename(unpack(r["seq"], r["size"]), shared.value[r["lang"]], *[r[c] for c in extra]))])
                    yield pa.RecordBatch.from_pydict(rows, _BLOCK)

    return coded.select("block", "lang", "size", "seq", *extra).mapInArrow(run, ID_BLOCKS)


def _pair_ids(seq: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The id of the frequent pair that starts at each place, -1 without one; ``known`` is sorted by code."""
    code, number = known
    x, y = seq[:-1], seq[1:]
    own = np.where((x >= 0) & (y >= 0), _code(np.maximum(x, 0), np.maximum(y, 0)), -1)
    at = np.minimum(np.searchsorted(code, own), len(code) - 1)
    return np.where(code[at] == own, number[at], -1)


def _few(size: dict) -> bool:
    return size["rows"] <= SENT_ROWS and size["bytes"] <= SENT_BYTES


def word_ids(coded: DataFrame, each: DataFrame, words: DataFrame) -> DataFrame:
    """Blocks as ids of frequent words, -1 for any other word and for breaks."""
    size = measure(words, F.col("word"))
    if _few(size):
        known: dict[str, dict[bytes, int]] = {}
        for lang, word, i in words.select("lang", "word", "id").toPandas().itertuples(index=False):
            known.setdefault(lang, {})[word.encode()] = i

        def by_name(seq: np.ndarray, own: dict[bytes, int], names: list[bytes]) -> np.ndarray:
            return np.array([-1, *[own.get(w, -1) for w in names]], np.int64)[seq]

        return _sent(coded, known, by_name, "words")

    def by_place(seq: np.ndarray, found: pa.Table) -> np.ndarray:
        table = np.full(int(seq.max()) + 1, -1, np.int64)
        table[found["at"].to_numpy()] = found["id"].to_numpy()
        return table[seq]

    met = each.select("block", "lang", "at", "word").join(words.select("lang", "word", "id"), ["lang", "word"])
    return _dealt(coded, met.select("block", "at", "id"), by_place)


def pair_ids(ids: DataFrame, tiled: DataFrame, pairs: DataFrame, strips: int) -> DataFrame:
    """Blocks as ids of the frequent pairs that start at each place."""
    if _few(measure(pairs, F.col("lang"))):
        known = {}
        for lang, rows in pairs.select("lang", "x", "y", "id").toPandas().groupby("lang"):
            code = _code(rows["x"].to_numpy(np.int64), rows["y"].to_numpy(np.int64))
            order = np.argsort(code)
            known[lang] = (code[order], rows["id"].to_numpy(np.int64)[order])
        return _sent(ids, known, _pair_ids)

    def by_code(seq: np.ndarray, found: pa.Table) -> np.ndarray:
        whole = [np.concatenate([np.frombuffer(x, "<i8") for x in found[c].to_pylist()]) for c in ("codes", "ids")]
        order = np.argsort(whole[0])
        return _pair_ids(seq, (whole[0][order], whole[1][order]))

    return _dealt(ids, hits(tiled, pairs, strips), by_code)


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, busy: int = BUSY) -> tuple[DataFrame, list[DataFrame]]:
    """Words per language, and per length the phrases that occur ``least`` times or more.

    A phrase has (lang, id, left, right, f, words, starts, ends): the ids of the phrases
    without its last and without its first word, how often it occurs, and how often its first and its last
    1, 2, .. words do. A phrase is only as frequent as its parts, so frequent pairs of neighbouring frequent
    phrases give all frequent phrases one word longer.
    """
    coded = stage(blocks(docs), "blocks")
    totals = stage(coded.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    each = coded.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w"))
    each = each.select("block", "lang", (F.col("at") + 1).alias("at"), F.col("w.words").cast("string").alias("word"), "w.counts")
    words = each.groupBy("lang", "word").agg(F.sum("counts").alias("f")).where(F.col("f") >= least)
    words = stage(ranked(words, "word"), "words")
    _bounded(words)
    ids = stage(word_ids(coded, each, words), "ids")
    strips = max(STRIPS, -(-(totals.agg(F.sum("n")).first()[0] or 0) // STRIP_WORDS))
    one = F.array("f")
    phrases = [words.select("lang", "id", F.lit(None).cast("long").alias("left"), F.lit(None).cast("long").alias("right"), "f", F.array("word").alias("words"), one.alias("starts"), one.alias("ends"))]
    for m in range(2, longest + 1):
        tiled = stage(tiles(ids, strips), "tiles")
        pairs = stage(ranked(frequent_pairs(tiled, least, busy), "x", "y"), "pairs")
        _bounded(pairs)
        if m < longest:
            ids = stage(pair_ids(ids, tiled, pairs, strips), "ids")
        left = phrases[-1].select("lang", F.col("id").alias("x"), F.col("words").alias("before"), "starts")
        right = phrases[-1].select("lang", F.col("id").alias("y"), F.element_at("words", -1).alias("last"), "ends")
        longer = pairs.join(left, ["lang", "x"]).join(right, ["lang", "y"])
        words = F.concat("before", F.array("last"))
        longer = longer.select("lang", "id", F.col("x").alias("left"), F.col("y").alias("right"), "f", words.alias("words"), F.concat("starts", F.array("f")).alias("starts"), F.concat("ends", F.array("f")).alias("ends"))
        phrases.append(stage(longer, "phrases"))
    return totals, phrases


def _bounded(rows: DataFrame) -> None:
    most = rows.agg(F.max("id")).first()[0] or 0
    if most >= 1 << 31:
        raise ValueError("more frequent phrases of one length than ids of 31 bits")


def candidates(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, busy: int = BUSY) -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score) of all phrases that no equally frequent longer one holds.

    ``a`` counts the phrase, ``l`` and ``r`` the parts of its lowest-scoring cut, and ``n`` all words of
    the language; score is floor(1000 a n / (l r)), exact in decimals of 38 digits. If a longer phrase holds
    this one as often as it occurs, so does one that is a word longer; only those are looked at. A null
    language is ``und``; null and empty texts have no words. Rows of one content count each.
    """
    totals, phrases = frequent_phrases(docs, least, longest, busy)
    rows = []
    for m, own in enumerate(phrases[1:], 2):
        if m < longest:
            holders = phrases[m].select("lang", F.explode(F.array("left", "right")).alias("id"), F.col("f").alias("most"))
            holders = holders.groupBy("lang", "id").agg(F.max("most").alias("most"))
            own = own.join(holders, ["lang", "id"], "left").where(F.coalesce(F.col("most"), F.lit(0)) < F.col("f"))
        rows.append(own.select("lang", "words", F.col("f").alias("a"), "starts", "ends"))
    found = functools.reduce(DataFrame.unionByName, rows)
    found = found.join(broadcast_if_small(totals, measure(totals, F.col("lang"))), "lang")
    wide = lambda c: c.cast("decimal(38,0)")

    def cut(k: Column) -> Column:
        left, right = F.get("starts", k - 1), F.get("ends", F.size("words") - k - 1)
        whole = wide(F.lit(1000)) * wide(F.col("a")) * wide(F.col("n"))
        return F.struct(F.call_function("div", whole, wide(left) * wide(right)).alias("score"), k.alias("k"), left.alias("l"), right.alias("r"))

    lowest = F.array_min(F.transform(F.sequence(F.lit(1), F.size("words") - 1), cut))
    found = found.withColumn("cut", lowest)
    return found.select("lang", F.array_join("words", " ").alias("phrase"), "words", "a", "cut.l", "cut.r", "n", "cut.score")


def best(found: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` of each language by falling score, then falling ``a``, then phrase, with their ``rank``.

    Each language is ranked in parts first, so one task only sees ``top`` rows of each part.
    """
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    part = found.withColumn("_salt", salt).withColumn("_part", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order)))
    part = part.where(F.col("_part") <= top).drop("_salt", "_part")
    return part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 2,000 phrases of every language."""
    rows = best(candidates(documents(spark, sf_dir)))
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
