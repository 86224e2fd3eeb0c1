"""Texts to dictionary entries and records to records, without comparing all pairs.

Two normalized texts match if they are equal or one contains the other. The longer
text is cut into grams, the shorter one is looked up by one gram of its own (its
anchor), and only texts that share the anchor are compared. A contained text brings
its anchor with it, so no match is lost:

* words strictly inside the shorter text appear whole and in sequence in the longer
  one, so up to three inner words can serve as anchor if they are long enough;
* any eight characters of it do too, or all of a text shorter than that.

Of these the rarest is taken.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesift.functions import text as X
from namesift.operators.sizing import broadcast_or_merge, measure
from namesift.session import stage

GRAM_WORDS = 3
GRAM_CHARS = 8
LISTED_ANCHORS = 10_000
RARE = 4
# Bits for each anchor in the table that tells which grams are worth sending, and the most it may have (32 MB).
ANCHOR_BITS = 32
MOST_BITS = 28
PROBES = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
ALL_KINDS = [f"w{k}" for k in range(1, GRAM_WORDS + 1)] + [f"c{q}" for q in range(1, GRAM_CHARS + 1)]


def _word_windows(words: Column, n: int) -> Column:
    """All runs of ``n`` words; NULL for a text with fewer."""
    places = F.sequence(F.lit(0), F.size(words) - n)
    return F.when(F.size(words) >= n, F.transform(places, lambda i: X.word_run(words, i, n)))


def _text_hash(text: str) -> Column:
    """A 128-bit hash of a text."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def with_anchor(df: DataFrame, norm: str) -> DataFrame:
    """Add ``_kind`` and ``_gram``: what the text is looked up by; empty texts have none and are left out.

    Any gram of a text that a longer text must hold as well can be its anchor: runs of
    inner words of ``GRAM_CHARS`` or more, and all windows of that many characters. The
    one that fewest different texts of ``df`` share is taken, so a common ending is no
    anchor; among grams shared by at most ``RARE`` texts words come first, as they are
    cheaper to look up. Grams are counted on different texts, which a 128-bit hash stands
    for beside each gram, and no table of grams is ever broadcast.

    ``_gram`` is declared non-null: a null check on it would be pushed below the
    steps that build it and repeat them inside one expression for every window.
    """
    values = df.select(F.col(norm).alias("_norm")).filter("_norm != ''").distinct()
    # A number of partitions that is asked for is not coalesced at run time: few texts give very many grams.
    values = values.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_norm")
    words = F.split("_norm", " ")
    inner = X.bind(words, lambda w: F.slice(w, F.lit(2), F.greatest(F.size(w) - 2, F.lit(0))))

    def option(kind: Column, gram: Column) -> Column:
        return F.struct(kind.alias("kind"), F.concat(kind, F.lit(":"), gram).alias("gram"))

    def by_words(inside: Column) -> Column:
        runs = [F.when(F.least(F.size(inside), F.lit(GRAM_WORDS)) == k, _word_windows(inside, k)) for k in range(1, GRAM_WORDS + 1)]
        long = F.filter(F.coalesce(*runs, F.array().cast("array<string>")), lambda w: F.length(w) >= GRAM_CHARS)
        kind = F.concat(F.lit("w"), F.least(F.size(inside), F.lit(GRAM_WORDS)))
        return F.transform(long, lambda w: option(kind, w))

    cut = F.least(F.length("_norm"), F.lit(GRAM_CHARS))
    places = F.sequence(F.lit(1), F.length("_norm") - cut + 1)
    by_chars = F.transform(places, lambda i: option(F.concat(F.lit("c"), cut), F.substring(F.col("_norm"), i, cut)))
    options = values.withColumn("_inner", inner).withColumn("o", F.explode(F.array_distinct(F.concat(by_words(F.col("_inner")), by_chars))))
    options = options.select(_text_hash("_norm").alias("_text"), "o.kind", "o.gram")
    shared = options.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rank = F.struct(
        F.when(F.col("n") <= RARE, 0).otherwise(F.col("n")).alias("n"),
        F.startswith("kind", F.lit("c")).alias("c"),
        (-F.length("gram")).alias("length"),
        "gram",
        "kind",
    )
    best = options.hint("merge").join(shared, "gram").groupBy("_text").agg(F.min(rank).alias("_best"))
    joined = df.join(best.hint("merge"), _text_hash(norm) == F.col("_text"))
    columns = [F.col("_best.kind").alias("_kind"), F.coalesce("_best.gram", F.lit("")).alias("_gram")]
    return joined.select(*[df[c] for c in df.columns], *columns)


def with_grams(
    df: DataFrame, norm: str, kinds: Sequence[str], listed: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """One row per different gram of the text in column ``_gram``.

    ``listed`` holds the only grams wanted per kind; others are then dropped before
    they become rows.
    """
    words = df.withColumn("_words", F.split(norm, " "))

    def grams(kind: str) -> Column:
        n = int(kind[1:])
        if kind[0] == "w":
            found = _word_windows(F.col("_words"), n)
        else:
            found = F.regexp_extract_all(F.col(norm), F.lit(f"(?=(.{{{n}}}))"), F.lit(1))
        found = F.coalesce(found, F.array().cast("array<string>"))
        if listed:
            found = F.filter(found, lambda g: g.isin(*listed[kind]))
        return F.transform(F.array_distinct(found), lambda g: F.concat(F.lit(kind + ":"), g))

    every = F.concat(F.array().cast("array<string>"), *[grams(kind) for kind in sorted(kinds)])
    return words.withColumn("_gram", F.explode(every)).drop("_words")


def _listed_anchors(anchors: DataFrame, size: dict) -> dict[str, list[str]] | None:
    """The anchors per kind if the measured dictionary is short enough to list them, else None."""
    if size["rows"] > LISTED_ANCHORS:
        return None
    listed: dict[str, list[str]] = {}
    for row in anchors.select("_kind", "_gram").distinct().collect():
        listed.setdefault(row["_kind"], []).append(row["_gram"].split(":", 1)[1])
    return {kind: sorted(grams) for kind, grams in listed.items()}


def _windows(text: bytes, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of all grams of a kind in a normalized text; runs of words only if ``GRAM_CHARS`` long, as anchors are.

    The hash is of the first and the last ``GRAM_CHARS`` characters and the length.
    """
    data = np.frombuffer(text, np.uint8)
    eight = np.zeros(len(data), np.uint64)
    for i in range(min(GRAM_CHARS, len(data))):
        eight[: len(data) - i] |= data[i:].astype(np.uint64) << np.uint64(8 * i)
    n = int(kind[1:])
    if kind[0] == "c":
        start = np.arange(max(0, len(data) - n + 1))
        end = start + n
        code = eight[start] & np.uint64(2 ** (8 * n) - 1)
    else:
        space = np.flatnonzero(data == 0x20)
        first, last = np.concatenate(([0], space + 1)), np.append(space, len(data))
        count = max(0, len(first) - n + 1)
        start, end = first[:count], last[n - 1 :]
        long = end - start >= GRAM_CHARS
        start, end = start[long], end[long]
        code = eight[start] * PROBES[1] ^ eight[end - GRAM_CHARS] * PROBES[2] ^ (end - start).astype(np.uint64)
    code = (code ^ np.uint64(ALL_KINDS.index(kind) + 1)) * PROBES[0]
    code = (code ^ (code >> np.uint64(29))) * PROBES[2]
    return start, end, code ^ (code >> np.uint64(32))


def _anchor_bits(anchors: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """A bit table with the places of the hashes of the ``n`` anchors, and the size of its index in bits."""
    width = min(MOST_BITS, max(10, (ANCHOR_BITS * n).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, grams = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            bodies = [(g.split(":", 1)[1].encode(), k) for k, g in zip(kinds, grams, strict=True)]
            # An anchor is the one window of its kind that begins and ends with it.
            own = [[h[(s == 0) & (e == len(b))] for s, e, h in [_windows(b, k)]][0] for b, k in bodies]
            code = np.concatenate([np.zeros(0, np.uint64), *own])
            place = np.concatenate([(code * p) >> np.uint64(64 - width) for p in PROBES]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(place >> 3), pa.array(1 << (place & 7))], ["at", "bit"])

    found = anchors.select("_kind", "_gram").mapInArrow(run, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << (width - 3), np.uint8)
    bits[found["at"].to_numpy()] = found["bits"].to_numpy().astype(np.uint8)
    return bits, width


def with_likely_grams(df: DataFrame, key: str, norm: str, anchors: DataFrame, size: dict) -> DataFrame:
    """``key, _gram`` for each different gram of the text that may be one of ``anchors``; none that is one is missed.

    The table of bits tells it before a gram becomes a row, so few rows leave a task however large the dictionary is.
    Normalized texts hold letters, digits and spaces only, a byte each.
    """
    kinds = sorted(size["kinds"])
    bits, width = _anchor_bits(anchors, size["rows"])
    shared = df.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            rows, grams = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                found = set()
                for kind in kinds if text else ():
                    start, end, code = _windows(text.encode(), kind)
                    for p in PROBES:
                        place = (code * p) >> np.uint64(64 - width)
                        hit = (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0
                        start, end, code = start[hit], end[hit], code[hit]
                    found |= {f"{kind}:{text[a:b]}" for a, b in zip(start.tolist(), end.tolist(), strict=True)}
                rows += [i] * len(found)
                grams += found
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(grams, pa.string())], [key, "_gram"])

    return df.select(key, norm).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, _gram string")


def resolve_text(
    texts: DataFrame,
    dictionary: DataFrame,
    id_col: str = "id",
    text_col: str = "text",
    entry_col: str = "entry",
    entry_text_col: str = "entry_text",
) -> DataFrame:
    """All matching ``id, entry, match_type`` of texts and dictionary entries.

    Both directions are searched: entries inside texts, and texts inside entries.
    The second concerns only texts shorter than the longest entry, which is
    measured together with the dictionary's size. Exploded grams carry ids only,
    and only grams that are anchors become rows if the anchors can be listed; else
    and for the second direction a table of bits leaves next to no others. Entries
    of one normalized text are looked up once, under the least of them. The
    normalized dictionary is staged, because it is read several times, and so are
    the candidate pairs, so that the join that brings the texts back is planned
    from their true size.
    """
    t = texts.select(F.col(id_col).alias("id"), X.normalize_label(F.col(text_col)).alias("norm"))
    members = stage(
        dictionary.select(
            F.col(entry_col).alias("entry"), X.normalize_label(F.col(entry_text_col)).alias("entry_norm")
        ).filter("entry_norm != '' and entry is not null"),
        "members",
    )
    values = members.groupBy("entry_norm").agg(F.min("entry").alias("least"))
    anchors = stage(with_anchor(values, "entry_norm"), "entries")
    d = anchors.select("least", "entry_norm")
    size = measure(
        anchors, F.col("entry_norm"), kinds=F.collect_set("_kind"), longest=F.max(F.length("entry_norm"))
    )

    listed = _listed_anchors(anchors, size)
    if listed is None:
        inside = with_likely_grams(t, "id", "norm", anchors, size)
    else:
        inside = with_grams(t, "norm", size["kinds"], listed).select("id", "_gram")
    inside = inside.join(broadcast_or_merge(anchors.select("least", "_gram"), size), "_gram")

    shorter = stage(with_anchor(t.filter(F.length("norm") < (size["longest"] or 0)), "norm").select("id", "_kind", "_gram"), "shorter")
    shorter_size = measure(shorter, F.col("_gram"), kinds=F.collect_set("_kind"))
    entry_grams = with_likely_grams(d, "least", "entry_norm", shorter, shorter_size)
    shorter = shorter.select("id", "_gram")
    gram_size = {"rows": len(ALL_KINDS) * size["bytes"], "bytes": 10 * len(ALL_KINDS) * size["bytes"]}
    around = shorter.join(broadcast_or_merge(entry_grams, gram_size), "_gram")

    pairs = stage(inside.select("id", "least").unionByName(around.select("id", "least")).distinct(), "pairs")
    # The texts come last, so that none is carried through another shuffle.
    checked = pairs.join(broadcast_or_merge(d, size), "least")
    n = pairs.count()
    checked = broadcast_or_merge(checked, {"rows": n, "bytes": n * (size["longest"] or 0)}).join(t, "id")
    kind = X.match_type(F.col("norm"), F.col("entry_norm"))
    checked = checked.select("id", "entry_norm", kind.alias("match_type")).filter(F.col("match_type") != "none")
    found = checked.join(broadcast_or_merge(members, measure(members, F.col("entry_norm"))), "entry_norm")
    return found.select("id", "entry", "match_type")


def _values(df: DataFrame, value: str, keys: Sequence[str], name: str) -> DataFrame:
    norm = X.normalize_label(F.col(value)).alias(f"{name}_value")
    values = df.select(*keys, norm).filter(F.col(f"{name}_value") != "")
    return values.groupBy(*keys, f"{name}_value").agg(F.count(F.lit(1)).alias(f"n_{name}"))


def candidate_pairs(
    left: DataFrame, right: DataFrame, left_value: str, right_value: str, keys: Sequence[str]
) -> DataFrame:
    """Matching values of two tables that agree on ``keys``.

    Returns ``keys, left_value, right_value, n_left, n_right, match_type,
    match_code``: one row per pair of different values with the number of records
    behind each, so copies of a record never multiply. Only pairs that match leave
    the join; a key shared by many records does not pair them all. The values of
    both sides are staged, because each is measured, cut and looked up.
    """
    lv = _values(left, left_value, keys, "left")
    rv = _values(right, right_value, keys, "right")
    l_anchor = stage(with_anchor(lv, "left_value"), "left")
    r_anchor = stage(with_anchor(rv, "right_value"), "right")
    lv, rv = l_anchor.drop("_kind", "_gram"), r_anchor.drop("_kind", "_gram")
    l_size = measure(l_anchor, F.col("left_value"), kinds=F.collect_set("_kind"))
    r_size = measure(r_anchor, F.col("right_value"), kinds=F.collect_set("_kind"))
    on = [*keys, "_gram"]
    columns = [*keys, "left_value", "right_value", "n_left", "n_right"]

    left_inside = with_grams(rv, "right_value", l_size["kinds"]).join(
        broadcast_or_merge(l_anchor.drop("_kind"), l_size), on
    )
    left_inside = left_inside.filter(F.contains("right_value", "left_value"))
    right_inside = with_grams(lv, "left_value", r_size["kinds"]).join(
        broadcast_or_merge(r_anchor.drop("_kind"), r_size), on
    )
    right_inside = right_inside.filter(
        F.contains("left_value", "right_value") & (F.length("right_value") < F.length("left_value"))
    )
    pairs = left_inside.select(*columns).unionByName(right_inside.select(*columns))
    kind = F.when(F.col("left_value") == F.col("right_value"), "exact").otherwise("overlap")
    return pairs.withColumn("match_type", kind).withColumn("match_code", X.match_code(F.col("match_type")))


def ambiguous_pairs(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs whose left value has more than one right record.

    Counted by an aggregate and joined back, so a left value with very many
    partners is not gathered in one window. Store ``pairs`` first: they are read twice.
    """
    left = [*keys, "left_value"]
    several = pairs.groupBy(*left).agg(F.sum("n_right").alias("n")).filter("n > 1").select(*left)
    return pairs.join(several, left, "left_semi")


def pair_records(
    pairs: DataFrame,
    left: DataFrame,
    right: DataFrame,
    left_value: str,
    right_value: str,
    keys: Sequence[str],
    left_id: str,
    right_id: str,
) -> DataFrame:
    """Records behind value pairs: ``left_id, right_id, match_type``, one row per potential match."""
    lv = left.select(*keys, X.normalize_label(F.col(left_value)).alias("left_value"), left_id)
    rv = right.select(*keys, X.normalize_label(F.col(right_value)).alias("right_value"), right_id)
    rows = pairs.join(lv, [*keys, "left_value"]).join(rv, [*keys, "right_value"])
    return rows.select(left_id, right_id, "match_type")


def link_by_key(left: DataFrame, right: DataFrame, left_text: str, right_key: str) -> DataFrame:
    """Left rows with the right row whose key equals their canonical key, or NULLs."""
    keyed = left.withColumn("canonical_key", X.canonical_key(F.col(left_text)))
    return keyed.join(right, keyed["canonical_key"] == right[right_key], "left")
