"""Removing repeated passages with run-compressed Burrows-Wheeler indexes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namesift.llm.common import MIX, Powers, documents, mix, prefix_sums
from namesift.session import stage

# A repeated string has so many bytes.
LENGTH = 50
# Bytes hashed to choose where a window is indexed.
GRAM = 20
# Bytes of text that a task works on at a time, and that it concatenates for one pass.
BLOCK_BYTES = 8 << 20
CHUNK_BYTES = 1 << 16
# Bytes of text that go to one index, unless one key has more.
INDEX_BYTES = 1 << 17
# Low bytes of a key that are not sent. Keys only bring runs together; two that agree in
# the 40 bits left share a bucket, where their bytes are told apart.
KEY_SKIPPED = 3
_LATE = np.iinfo(np.int64).max


@dataclass
class Runs:
    """Runs of consecutive windows of one text that are indexed under the same key."""

    doc: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    key: np.ndarray
    context: np.ndarray

    @staticmethod
    def join(parts: list[Runs]) -> Runs:
        if not parts:
            empty = np.zeros(0, np.int64)
            return Runs(empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64))
        names = ("doc", "start", "windows", "key", "context")
        return Runs(*[np.concatenate([getattr(p, n) for p in parts]) for n in names])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` neighbours, by doubling."""
    done = 1
    while done * 2 <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    return np.minimum(values[: len(values) - (width - done)], values[width - done :]) if done < width else values


def _chunk_runs(texts: list[bytes], first: int, powers: Powers, length: int) -> Runs:
    """Runs of some texts laid end to end; windows that cross texts are left out.

    The key of a window is the smallest hash of its grams, so it depends on the
    window alone and equal windows have equal keys wherever they stand. Positions
    are relative to their text, the context is the hash of all bytes of the run.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < length:
        return Runs.join([])
    total, down = prefix_sums(data, powers)
    n = len(data) - GRAM + 1
    gram = mix((total[GRAM:] - total[:n]) * down[:n])
    key = _least(gram, length - GRAM + 1)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    change = np.ones(len(key) + 1, bool)
    change[1:-1] = key[1:] != key[:-1]
    # Windows from a text's last full one up to its end cross into the next text.
    valid = np.zeros(len(key) + 1, np.int64)
    starts, ends = offsets[:-1], offsets[1:] - length + 1
    full = ends > starts
    np.add.at(valid, starts[full], 1)
    np.add.at(valid, ends[full], -1)
    valid = np.cumsum(valid)[:-1] > 0
    change[starts[full]] = True
    change[ends[full]] = True
    head = np.flatnonzero(change[:-1] & valid)
    edges = np.flatnonzero(change)
    end = edges[np.searchsorted(edges, head, side="right")]
    doc = np.searchsorted(offsets, head, side="right") - 1
    last = end + length - 1
    context = mix((total[last] - total[head]) * down[head] ^ ((last - head).astype(np.uint64) * MIX))
    # Smallest hashes are all low; mixed once more they are spread evenly over the buckets.
    return Runs(doc + first, head - offsets[doc], end - head, mix(key[head]), context)


def runs_of(texts: list[bytes], powers: Powers, length: int = LENGTH) -> Runs:
    """Runs of all texts in order, worked out over chunks that stay in the cache."""
    parts, chunk, size, first = [], [], 0, 0
    for i, text in enumerate(texts):
        chunk.append(text)
        size += len(text)
        if size >= CHUNK_BYTES or i + 1 == len(texts):
            parts.append(_chunk_runs(chunk, first, powers, length))
            chunk, size, first = [], 0, i + 1
    return Runs.join(parts)


def planes(values: np.ndarray, skip: int = 0) -> bytes:
    """Bytes of equal weight side by side, which compresses when values are near each other.

    ``skip`` leaves out so many of the lowest bytes.
    """
    wide = values.astype("<i8" if values.dtype.kind == "i" else "<u8").view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(wide.T[skip:]).tobytes()


def unplanes(data: bytes, kind: str, skip: int = 0) -> np.ndarray:
    held = np.frombuffer(data, np.uint8).reshape(8 - skip, -1)
    wide = np.zeros((held.shape[1], 8), np.uint8)
    wide[:, skip:] = held.T
    return wide.reshape(-1).view(f"<{kind}8")


def suffix_order(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array by prefix doubling, and where in it the prefix of ``length`` symbols changes.

    The first order comes from as many symbols as fit one word, so texts of few
    different symbols need fewer rounds. Each round sorts only the suffixes that are
    not told apart yet. Equal codes get equal ranks, so the sorts need not be stable.
    """
    n = len(text)
    kinds = np.flatnonzero(np.bincount(text))
    symbol = np.zeros(kinds[-1] + 1, np.int64)
    symbol[kinds] = np.arange(len(kinds))
    symbol = symbol[text]
    bits = int(len(kinds) + 1).bit_length()
    depth = min(63 // bits, length)
    # Beyond the end stands a symbol of its own, so that no two suffixes are equal.
    padded = np.concatenate((symbol.astype(np.uint64) + np.uint64(1), np.zeros(depth, np.uint64)))
    code = np.zeros(n, np.uint64)
    for i in range(depth):
        code = (code << np.uint64(bits)) | padded[i : i + n]

    order = np.argsort(code)
    # A rank is the place in the order where the suffixes with one prefix begin, so those that stand alone are done.
    rank = np.empty(n, np.int64)
    first = _heads(code[order])
    rank[order] = first
    left = _together(first)
    prefix = None
    while True:
        if prefix is None and (depth * 2 > length or not len(left)):
            after = np.zeros(n, np.int64)
            step = length - depth if len(left) else n
            after[: max(n - step, 0)] = rank[step:] + 1
            prefix = rank * (n + 1) + after
        if not len(left):
            ordered = prefix[order]
            return order, np.concatenate(([True], ordered[1:] != ordered[:-1]))
        suffix = order[left]
        ahead = suffix + depth
        code = rank[suffix] * (n + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        by_code = np.argsort(code)
        suffix = suffix[by_code]
        order[left] = suffix
        first = _heads(code[by_code])
        rank[suffix] = left[first]
        left = left[_together(first)]
        depth *= 2


def _heads(ordered: np.ndarray) -> np.ndarray:
    """For each of some sorted values the place of the first one equal to it."""
    head = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    return np.maximum.accumulate(np.where(head, np.arange(len(ordered)), 0))


def _together(first: np.ndarray) -> np.ndarray:
    """Places that share their first place with another."""
    same = first[1:] == first[:-1]
    return np.flatnonzero(np.concatenate(([False], same)) | np.concatenate((same, [False])))


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of several strings, with samples for its runs.

    Runs are cut where the next ``length`` symbols change, so that a run lies in one
    interval of equal strings of that length. For each run are kept its start, where
    it goes by LF, and two samples: the text position at its end and the smallest
    owner among the strings of its interval.
    """

    def __init__(self, strings: list[bytes], owners: np.ndarray, length: int = LENGTH) -> None:
        sizes = np.array([len(s) for s in strings], np.int64)
        text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + 1
        self.ends = np.cumsum(sizes + 1) - 1
        text[self.ends] = 0
        order, change = suffix_order(text, length)
        before = text[order - 1]
        head = change | np.concatenate(([True], before[1:] != before[:-1]))
        self.start = np.flatnonzero(head)
        self.symbol = before[self.start]
        size = np.diff(np.append(self.start, len(text)))
        self.sample = order[np.append(self.start[1:], len(text)) - 1]
        by_symbol = np.argsort(self.symbol.astype(np.int16), kind="stable")
        self.goes = np.empty(len(self.start), np.int64)
        self.goes[by_symbol] = np.concatenate(([0], np.cumsum(size[by_symbol])[:-1]))
        owner = np.repeat(owners, sizes + 1)[order]
        opens = change[self.start]
        least = np.minimum.reduceat(np.minimum.reduceat(owner, self.start), np.flatnonzero(opens))
        self.least = least[np.cumsum(opens) - 1]
        rows = np.flatnonzero(text[order] == 0)
        self.end_row = np.empty(len(strings), np.int64)
        self.end_row[np.searchsorted(self.ends, order[rows])] = rows
        # Which run a row falls in, in place of a search at each step.
        self.run = np.repeat(np.arange(len(self.start), dtype=np.int32), size)
        self.sizes, self.length = sizes, length

    def matches(self, owners: np.ndarray) -> list[np.ndarray]:
        """For each string, which of its windows of ``length`` occur in one of a smaller owner.

        All strings are streamed backwards together: each LF step leads from the row of a
        suffix to that of the one before it, and the run the row falls in tells by
        its sample whether the match is long enough and whose it is.
        """
        windows = np.maximum(0, self.sizes - self.length + 1)
        offset = np.cumsum(windows) - windows
        found = np.zeros(windows.sum(), bool)
        alive, rows = np.arange(len(self.sizes)), self.end_row.copy()
        ahead = self.goes - self.start
        step = 0
        while True:
            on = self.sizes[alive] > step
            if not on.all():
                alive, rows = alive[on], rows[on]
            if not len(alive):
                return np.split(found, offset[1:])
            rows = rows + ahead[self.run[rows]]
            step += 1
            if step >= self.length:
                hit = alive[self.least[self.run[rows]] < owners[alive]]
                found[offset[hit] + self.sizes[hit] - step] = True


def _texts(column: pa.ChunkedArray) -> list[bytes]:
    return [t or b"" for t in column.to_pylist()]


def _doc_ids(column: pa.ChunkedArray) -> np.ndarray:
    return np.array([_LATE if d is None else d for d in column.to_pylist()], np.int64)


def _cut(order: np.ndarray) -> np.ndarray:
    """Heads of equal neighbours in sorted values."""
    return np.flatnonzero(np.concatenate(([True], order[1:] != order[:-1]))) if len(order) else np.zeros(0, np.int64)


def without_repeats(docs: DataFrame, length: int = LENGTH, texts: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256) with repeated passages removed.

    A byte goes if a string of ``length`` bytes that covers it also starts in a document
    of smaller doc_id; matches never cross documents and are judged on the input.
    A null text is empty, a null id counts as larger than any, and rows of one id do
    not repeat each other. Rows stay one for one; other columns are not looked at.
    With ``texts`` false, ``kept`` is null and only its digest is returned.

    Every window of a text is indexed under the smallest hash of its grams, and
    neighbouring windows of one key form a run. First the keys of all runs meet, as
    hashes and once per block of documents however often a passage occurs there. A
    run whose bytes are those of a run in a smaller document is repeated as a
    whole. Where a key has runs of different bytes, such as at the edges of a
    passage, one text of each goes to the key's bucket, which builds
    run-compressed indexes over the texts of some keys each and streams them through it; only windows that match
    there are marked. Nothing is sampled and no hash match alone decides between different bytes
    of one key but for the 64-bit hash of the run's own bytes.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))

    def keys(table: pa.Table) -> pa.Table:
        texts, ids = _texts(table["text"]), _doc_ids(table["doc_id"])
        runs = runs_of(texts, Powers(), length)
        order = np.argsort(runs.context)
        context, doc = runs.context[order], ids[runs.doc[order]]
        at = _cut(context)
        least = np.minimum.reduceat(doc, at) if len(at) else doc
        several = np.maximum.reduceat(doc, at) > least if len(at) else np.zeros(0, bool)
        context, key = context[at], runs.key[order][at]
        order = np.argsort(key)
        key, context, doc, several = key[order], context[order], least[order], several[order]
        bucket = ((key >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
        cuts = np.append(_cut(bucket), len(key))
        parts = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table(
            {
                "bucket": pa.array(bucket[cuts[:-1]], pa.int64()),
                "block": pa.array([table["block"][0].as_py()] * len(parts), pa.int64()),
                "keys": pa.array([planes(key[p], KEY_SKIPPED) for p in parts], pa.binary()),
                "contexts": pa.array([planes(context[p]) for p in parts], pa.binary()),
                "docs": pa.array([planes(doc[p]) for p in parts], pa.binary()),
                "several": pa.array([several[p].tobytes() for p in parts], pa.binary()),
            }
        )

    def meet(table: pa.Table) -> pa.Table:
        """For each block the contexts of its runs that others share: smallest document and whether the text is called for."""
        blobs = [[x.as_py() for x in table[c]] for c in ("keys", "contexts", "docs", "several")]
        of = np.array(table["block"].to_pylist(), np.int64)
        key = np.concatenate([unplanes(b, "u", KEY_SKIPPED) for b in blobs[0]])
        context = np.concatenate([unplanes(b, "u") for b in blobs[1]])
        doc = np.concatenate([unplanes(b, "i") for b in blobs[2]])
        several = np.concatenate([np.frombuffer(b, bool) for b in blobs[3]])
        block = np.repeat(of, [len(b) for b in blobs[3]])
        order = np.argsort(context)
        key, context, doc, several, block = key[order], context[order], doc[order], several[order], block[order]
        head = _cut(context)
        rows_of = np.diff(np.append(head, len(context)))
        least, most = np.minimum.reduceat(doc, head), np.maximum.reduceat(doc, head)
        again = np.bitwise_or.reduceat(several, head)
        by_key = np.argsort(key[head])
        first_of = _cut(key[head][by_key])
        contexts_of = np.diff(np.append(first_of, len(head)))
        differ = np.minimum.reduceat(least[by_key], first_of) < np.maximum.reduceat(most[by_key], first_of)
        differ |= np.bitwise_or.reduceat(again[by_key], first_of)
        ragged = np.empty(len(head), bool)
        ragged[by_key] = np.repeat((contexts_of > 1) & differ, contexts_of)
        least, ragged = np.repeat(least, rows_of), np.repeat(ragged, rows_of)
        first = ragged & (doc == least)
        keep = np.flatnonzero(np.repeat((rows_of > 1) | again, rows_of) | first)
        keep = keep[np.argsort(block[keep])]
        cuts = np.append(_cut(block[keep]), len(keep))
        parts = [keep[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table(
            {
                "block": pa.array([int(block[p[0]]) for p in parts], pa.int64()),
                "contexts": pa.array([planes(context[p]) for p in parts], pa.binary()),
                "least": pa.array([planes(least[p]) for p in parts], pa.binary()),
                "called": pa.array([first[p].tobytes() for p in parts], pa.binary()),
            }
        )

    def send(docs_: pa.Table, info: pa.Table) -> pa.Table:
        """The text of each context that is called for, from the document that has it first."""
        schema = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("key", pa.int64()), ("context", pa.int64()), ("doc", pa.int64()), ("text", pa.binary())])
        if not info.num_rows or not docs_.num_rows:
            return schema.empty_table()
        known, least, called = _gather(info)
        known, least = known[called], least[called]
        texts, ids = _texts(docs_["text"]), _doc_ids(docs_["doc_id"])
        runs = runs_of(texts, Powers(), length)
        at = np.searchsorted(known, runs.context) if len(known) else np.zeros(0, np.int64)
        hit = np.flatnonzero((known[np.minimum(at, len(known) - 1)] == runs.context) & (ids[runs.doc] == least[np.minimum(at, len(known) - 1)])) if len(known) else at
        _, once = np.unique(runs.context[hit], return_index=True)
        hit = hit[once]
        bucket = ((runs.key[hit] >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
        spans = zip(runs.doc[hit].tolist(), runs.start[hit].tolist(), runs.windows[hit].tolist(), strict=True)
        return pa.table(
            [
                pa.array(bucket, pa.int64()),
                pa.array([docs_["block"][0].as_py()] * len(hit), pa.int64()),
                pa.array(runs.key[hit].view(np.int64)),
                pa.array(runs.context[hit].view(np.int64)),
                pa.array(ids[runs.doc[hit]]),
                pa.array([texts[d][s : s + w + length - 1] for d, s, w in spans], pa.binary()),
            ],
            schema=schema,
        )

    def index(table: pa.Table) -> pa.Table:
        """Windows of each context that a smaller document has, as bits, gathered by block."""
        # Equal windows have one key, so those of different keys need no common index.
        table = table.sort_by("key")
        strings, owners = _texts(table["text"]), table["doc"].to_numpy()
        key, block, context = [table[c].to_numpy() for c in ("key", "block", "context")]
        head = np.append(_cut(key), len(key))
        size = np.diff(np.concatenate(([0], np.cumsum([len(s) for s in strings])))[head])
        part = (np.cumsum(size) - size) // INDEX_BYTES
        ends = np.append(head[_cut(part)], len(key))
        found = []
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            found += RunIndex(strings[a:b], owners[a:b], length).matches(owners[a:b])
        some = np.array([i for i, f in enumerate(found) if f.any()], np.int64)
        some = some[np.argsort(block[some], kind="stable")]
        cuts = np.append(_cut(block[some]), len(some))
        parts = [some[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table(
            {
                "block": pa.array([int(block[p[0]]) for p in parts], pa.int64()),
                "contexts": pa.array([planes(context[p]) for p in parts], pa.binary()),
                "sizes": pa.array([planes(np.array([len(found[i]) for i in p], np.int64)) for p in parts], pa.binary()),
                "bits": pa.array([np.packbits(np.concatenate([found[i] for i in p])).tobytes() for p in parts], pa.binary()),
            }
        )

    def mark(docs_: pa.Table, info: pa.Table) -> pa.Table:
        """Cut the repeated bytes out of the texts of a block."""
        whole_texts, ids = _texts(docs_["text"]), _doc_ids(docs_["doc_id"])
        runs = runs_of(whole_texts, Powers(), length)
        whole = np.zeros(len(runs.doc), bool)
        part: dict[int, np.ndarray] = {}
        if info.num_rows:
            plain = info.filter(pc.is_valid(info["least"]))
            known, least, _ = _gather(plain)
            if len(known):
                at = np.minimum(np.searchsorted(known, runs.context), len(known) - 1)
                whole = (known[at] == runs.context) & (least[at] < ids[runs.doc])
            masks = info.filter(pc.is_valid(info["bits"]))
            for contexts, sizes, bits in zip(*[masks[c].to_pylist() for c in ("contexts", "sizes", "bits")], strict=True):
                sizes = unplanes(sizes, "i")
                flags = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(sizes.sum())).view(bool)
                part |= dict(zip(unplanes(contexts, "u").tolist(), np.split(flags, np.cumsum(sizes)[:-1]), strict=True))
        partial = np.zeros(len(runs.doc), bool)
        if part:
            partial = ~whole & np.isin(runs.context, np.array(list(part), np.uint64))
        sizes = np.array([len(t) for t in whole_texts], np.int64)
        offset = np.concatenate(([0], np.cumsum(sizes)))
        start = runs.start + offset[runs.doc]
        step = np.zeros(offset[-1] + 1, np.int32)
        np.add.at(step, start[whole], 1)
        np.add.at(step, start[whole] + runs.windows[whole] + length - 1, -1)
        if partial.any():
            windows = runs.windows[partial]
            flags = np.concatenate([part[c] for c in runs.context[partial].tolist()])
            at = np.repeat(start[partial] - np.cumsum(windows) + windows, windows) + np.arange(len(flags))
            np.add.at(step, at[flags], 1)
            np.add.at(step, at[flags] + length, -1)
        gone = np.cumsum(step)[:-1] > 0
        # Runs end within their text, so a removed stretch that begins with a text is one of its own.
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        begins = offset[:-1][sizes > 0]
        opens[begins] = gone[begins]
        removed, spans = [np.diff(np.concatenate(([0], np.cumsum(x)))[offset]) for x in (gone, opens)]
        left = np.frombuffer(b"".join(whole_texts), np.uint8)[~gone].tobytes()
        ends = np.cumsum(sizes - removed)
        kept = [left[e - n : e] for e, n in zip(ends.tolist(), (sizes - removed).tolist(), strict=True)]
        return pa.table(
            {
                "doc_id": docs_["doc_id"].combine_chunks(),
                "n_bytes": pa.array(sizes),
                "n_removed": pa.array(removed.astype(np.int64)),
                "n_spans": pa.array(spans.astype(np.int64)),
                "kept": pa.array(kept if texts else [None] * len(kept), pa.binary()),
                "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
            }
        )

    blob = "bucket long, block long, keys binary, contexts binary, docs binary, several binary"
    keyed = rows.groupBy("block").applyInArrow(keys, blob)
    met = stage(keyed.groupBy("bucket").applyInArrow(meet, "block long, contexts binary, least binary, called binary"), "runs")
    sent = rows.groupBy("block").cogroup(met.groupBy("block")).applyInArrow(send, "bucket long, block long, key long, context long, doc long, text binary")
    masks = stage(sent.groupBy("bucket").applyInArrow(index, "block long, contexts binary, sizes binary, bits binary"), "masks")
    info = met.select("block", "contexts", "least", "called", F.lit(None).cast("binary").alias("sizes"), F.lit(None).cast("binary").alias("bits")).unionByName(
        masks, allowMissingColumns=True
    )
    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
    return rows.groupBy("block").cogroup(info.groupBy("block")).applyInArrow(mark, result)


def _gather(info: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts in order, with their smallest documents and whether they are called for."""
    if not info.num_rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    context = np.concatenate([unplanes(b, "u") for b in info["contexts"].to_pylist()])
    least = np.concatenate([unplanes(b, "i") for b in info["least"].to_pylist()])
    called = np.concatenate([np.frombuffer(b, bool) for b in info["called"].to_pylist()])
    order = np.argsort(context, kind="stable")
    return context[order], least[order], called[order]


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without passages of 50 bytes that an earlier one has."""
    return without_repeats(documents(spark, sf_dir), texts=False).drop("kept")
