"""SimHash near-duplicates by generalised pigeonhole search."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namesift.llm.common import Powers, components, documents, packed, row_key, shingle_hashes, with_ids, without_rows, word_hashes
from namesift.operators.sizing import broadcast_if_small, broadcast_or_merge
from namesift.session import letting_go, stage

BITS = 64
# Buckets up to this size are compared pair by pair, which is linear in the rows;
# larger ones meet in one-bit variants, which is linear too and finds the same links.
PAIRED = 32
# Texts whose shingles tell common ones from rare ones, and how many common ones are kept.
SAMPLE_ROWS = 20_000
COMMON = 200_000
# Floating-point room, so that a bound never cuts a pair that is exactly similar enough.
SLACK = 1e-6
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def fold(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as one unsigned number."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    most = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(most, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of one text: XXH64 of each run of words, a bit set where over half agree."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = min(shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    n = len(words) - size + 1
    spans = zip(starts[:n], ends[size - 1 :].tolist(), strict=True)
    return fold(np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, n))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint as a signed 64-bit number.

    A null or blank text has fingerprint zero. Rows are kept one for one, whatever
    their ids; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _agreement(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for each two bits how many have both set.

    Each partition counts its own rows, so at most 65 x 64 numbers leave a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            n += len(values)
            both += np.rint(bits.T @ bits).astype(np.int64)
        flat = np.concatenate(([n], both.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["i", "n"])

    rows = fps.select("fp").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1, np.int64)
    for i, n in rows:
        flat[i] = n
    return int(flat[0]), flat[1:].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """Split the bits into ``m`` parts, each taking in the bits most correlated with it.

    Bits that move together add little to one another, so keeping them in one part
    leaves the other parts independent and their buckets small.
    """
    p = both.diagonal() / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    link = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    left, parts = set(range(BITS)), []
    for k in range(m):
        size = BITS // m + (k < BITS % m)
        part = [min(left)]
        left.discard(part[0])
        while len(part) < size:
            best = max(left, key=lambda b: (link[b, part].sum(), -b))
            part.append(best)
            left.discard(best)
        parts.append(sorted(part))
    return parts


def expected_pairs(n: int, both: np.ndarray, part: list[int], most: int) -> list[float]:
    """Pairs expected to differ in at most t bits of ``part``, for t from 0 to ``most``."""
    p = both.diagonal()[part] / max(n, 1)
    chance = np.array([1.0])
    for q in 2 * p * (1 - p):
        chance = np.convolve(chance, [1 - q, q])
    return [float(n) * n / 2 * chance[: t + 1].sum() for t in range(most + 1)]


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Cheapest thresholds of sum ``total``, each -1 (not probed) or more, by dynamic programming.

    ``costs[i][t]`` is what threshold t costs in part i; -1 costs nothing.
    """

    @cache
    def best(i: int, left: int) -> tuple[float, tuple[int, ...]]:
        if i == len(costs):
            return (0.0, ()) if left == 0 else (float("inf"), ())
        options = []
        for t in range(-1, len(costs[i])):
            rest, chosen = best(i + 1, left - t)
            options.append(((costs[i][t] if t >= 0 else 0.0) + rest, (t, *chosen)))
        return min(options)

    cost, chosen = best(0, total)
    return cost, list(chosen)


def plan(n: int, both: np.ndarray, radius: int) -> list[tuple[list[int], int]]:
    """Parts of the fingerprint with their thresholds, for the fewest expected rows.

    By the generalised pigeonhole principle two fingerprints within ``radius`` agree
    in some part within that part's threshold when thresholds sum to
    ``radius - parts + 1``. Cost counts the probes (one per key variant) and the
    candidates; parts with threshold -1 are not probed.
    """
    choices = []
    for m in range(1, radius + 4):
        parts = group_bits(n, both, m)
        most = min(1, radius)
        costs = []
        for part in parts:
            pairs = expected_pairs(n, both, part, most)
            costs.append([pairs[t] + n * (1 + t * len(part)) for t in range(most + 1)])
        cost, chosen = allocate(costs, radius - m + 1)
        choices.append((cost, m, [(p, t) for p, t in zip(parts, chosen, strict=True) if t >= 0]))
    return min(choices, key=lambda c: c[:2])[2]


def _mask(part: list[int]) -> int:
    value = sum(1 << b for b in part)
    return value - (1 << 64) if value >= 1 << 63 else value


def _flip(bit: int) -> int:
    return _mask([bit])


def link(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (u, v) that join fingerprints of column ``fp`` within ``radius`` bits (0 to 2).

    Every edge is a true link and every link within the radius is implied by a path
    of edges, so components are exact. Fingerprints are first made distinct: copies
    never multiply. A bucket holds the fingerprints that agree in one part. Small
    buckets are compared pair by pair. In a large one every fingerprint meets the
    others in its 65 one-bit variants: two within two bits share a variant, and at
    most 65 distinct fingerprints do, so no group grows with the bucket.
    """
    if not 0 <= radius <= 2:
        raise ValueError("radius must be 0, 1 or 2")
    fps = stage(fps.select("fp").where("fp is not null").distinct(), "fingerprints")
    if not radius:
        return fps.select(F.col("fp").alias("u"), F.col("fp").alias("v")).where(F.lit(False))
    keys = []
    for i, (part, threshold) in enumerate(plan(*_agreement(fps), radius)):
        base = F.col("fp").bitwiseAND(F.lit(_mask(part)))
        keys += [F.struct(F.lit(i).alias("part"), k.alias("key")) for k in [base, *[base.bitwiseXOR(F.lit(_flip(b))) for b in part if threshold]]]
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.part", "k.key")
    sizes = rows.groupBy("part", "key").agg(F.count("*").alias("n")).where("n > 1")
    held = stage(rows.join(sizes, ["part", "key"]), "probes")
    groups = held.where(F.col("n") <= PAIRED).groupBy("part", "key").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    pairs = groups.select(
        F.explode(
            F.expr(
                "flatten(transform(fps, (a, i) -> transform(filter(slice(fps, i + 2, size(fps)),"
                f" b -> bit_count(a ^ b) <= {radius}), b -> named_struct('u', b, 'v', a))))"
            )
        ).alias("e")
    ).select("e.u", "e.v")
    variants = held.where(F.col("n") > PAIRED).select("fp").distinct()
    flips = [F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_flip(b))) for b in range(BITS)]]
    meets = variants.select("fp", F.explode(F.array(*flips)).alias("variant"))
    if radius == 1:
        # A pair one bit apart meets where the variant is one of the two.
        met = meets.groupBy("variant").agg(F.collect_set("fp").alias("fps")).where("array_contains(fps, variant)")
        star = met.select(F.explode("fps").alias("u"), F.col("variant").alias("v"))
    else:
        met = meets.groupBy("variant").agg(F.collect_set("fp").alias("fps")).where("size(fps) > 1")
        star = met.select(F.explode("fps").alias("u"), F.array_min("fps").alias("v"))
    return pairs.unionByName(star.where("u <> v")).distinct()


def near_components(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits) and component_id.

    component_id is the smallest doc_id reachable over links of at most ``radius``
    differing bits; null ids count as larger than any id. Blank texts have
    fingerprint zero and link like others. An empty table gives no rows; repeated
    rows stay repeated.
    """
    fps = stage(fingerprints(docs, shingle), "documents-fp")
    firsts = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "first")
    nodes = components(link(firsts, radius))
    joined = firsts.join(nodes, firsts.fp == nodes.node, "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component")
    )
    least = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    labels = joined.join(least, "component").select("fp", "component_id")
    return fps.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _grams(text: bytes | None, powers: Powers, shingle: int) -> tuple[bytes, np.ndarray]:
    """Digest of the words and the distinct shingles in order."""
    data = _LOWER[np.frombuffer(text or b"", np.uint8)]
    words = word_hashes(data, ~_SPACE[data], powers)[0]
    return xxhash.xxh3_128_digest(words.tobytes()), np.unique(shingle_hashes(words, shingle))


def _common(keyed: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample hold, in order, and how many do.

    They only say which shingles are looked up last. Any order finds the same
    pairs, so neither the sample nor the bound on its size loses one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for text in batch.column(0):
                grams = _grams(text.as_py(), powers, shingle)[1]
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64))], ["gram"])

    every = max(1, keyed.count() // SAMPLE_ROWS)
    sample = keyed.where(F.pmod("row", F.lit(every)) == 0).select("text").dropDuplicates()
    counts = sample.mapInArrow(run, "gram long").groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")
    with letting_go(keyed.sparkSession):
        found = counts.orderBy(F.desc("n"), "gram").limit(COMMON).toArrow()
    gram = found["gram"].to_numpy().view(np.uint64)
    order = np.argsort(gram)
    return gram[order], found["n"].to_numpy()[order]


def prefix(grams: np.ndarray, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The rarest shingles of a text, of which it shares one with every text ``similarity`` like it.

    A similar text holds at least ``similarity`` of the shingles, so it can lack only
    the rest; one more than that is taken, in an order that all texts use.
    """
    known, count = common
    weight = np.zeros(len(grams), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
        weight = np.where(known[at] == grams, count[at], 0)
    keep = len(grams) - int(np.ceil(similarity * len(grams) - SLACK)) + 1
    return grams[np.lexsort((grams, weight))[:keep]] if len(grams) else grams


def near_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(row, doc_id, keeper) for rows that share a group with another: near copies by Jaccard similarity.

    Texts meet by their prefix: the shingles of ``shingle`` words that come first in
    one order of all shingles, rare ones before common ones. Two texts that are
    ``similarity`` alike always share one, and at the first they share, enough
    shingles must follow in both; pairs without that are not proposed, nor those whose
    prefixes share too few shingles for what can follow. Every
    proposed pair is verified on its whole sets of shingles, so groups are those of
    all pairs compared, short texts and long ones.
    Exact copies are folded before anything is compared. In a bucket of few texts all
    pairs are proposed. In a larger one each text is first proposed with pivots, while
    that halves the pairs that no group joins yet; all pairs that are left then are
    proposed, so a bucket loses none, whatever its size.

    ``row`` is the content key of the row (doc_id and text), ``keeper`` that of the row
    that stays: the one with the smallest doc_id. Blank texts are copies of each other.
    """

    keyed = docs.select(row_key("doc_id", "text").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    common = _common(keyed, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            found = [_grams(t.as_py(), powers, shingle) for t in batch.column(2)]
            keys = [prefix(grams, similarity, common).view(np.int64) for _, grams in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([digest for digest, _ in found], pa.binary()),
                    pa.array([len(grams) for _, grams in found], pa.int32()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                ["row", "doc_id", "digest", "size", "keys"],
            )

    made = stage(keyed.mapInArrow(run, "row long, doc_id long, digest binary, size int, keys array<long>"), "prefixes")
    rows = made.select("row", "doc_id", "digest")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    texts = stage(rows.groupBy("digest").agg(F.min(order).alias("least")).select("digest", F.col("least.row").alias("id")), "texts")
    first = made.join(texts.select("id"), F.col("row") == F.col("id"), "left_semi").dropDuplicates(["row"])
    first = stage(first.select("row", "size", "keys"), "firsts")
    buckets = first.select(F.col("row").alias("id"), "size", F.posexplode("keys").alias("place", "key"))
    # Members of a bucket that may be alike if this is the first key they share.
    left_over = f"least({{0}}.size - {{0}}.place, {{1}}.size - {{1}}.place) * {1 + similarity} >= {similarity} * ({{0}}.size + {{1}}.size) - {SLACK}"
    entry = F.struct(F.col("id").alias("id"), "size", "place")
    # Most keys are those of one text; they are counted on their own, before what stands beside them moves.
    sizes = stage(buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    n = sizes.count()
    held = buckets.join(broadcast_or_merge(sizes, {"rows": n, "bytes": 16 * n}), "key")
    held = stage(held.select("key", entry.alias("e"), "n"), "buckets")
    small = held.where(F.col("n") <= PAIRED // 2).groupBy("key").agg(F.array_sort(F.collect_list("e")).alias("es"))
    pairs = small.select(
        F.explode(
            F.expr(
                "flatten(transform(es, (a, i) -> transform(filter(slice(es, i + 2, size(es)),"
                f" b -> {left_over.format('a', 'b')}), b -> named_struct('u', a.id, 'v', b.id))))"
            )
        ).alias("e")
    ).select("e.u", "e.v")
    large = held.where(F.col("n") > PAIRED // 2).select("key", "e")
    # The text with the most shingles left after the key meets all others of the bucket first.
    pivot = large.groupBy("key").agg(F.max_by("e", F.struct(-F.col("e.place") / F.col("e.size"), "e.id")).alias("p"))

    def met(pivot: DataFrame, members: DataFrame) -> DataFrame:
        meet = members.join(pivot, "key").where("e.id <> p.id").where(left_over.format("e", "p"))
        return meet.select(F.least("e.id", "p.id").alias("u"), F.greatest("e.id", "p.id").alias("v"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()

        for batch in batches:
            keep, last, left = [], None, None
            for u, a, b in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if u != last:
                    last, left = u, _grams(a.as_py(), powers, shingle)[1]
                right = _grams(b.as_py(), powers, shingle)[1]
                shared = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(shared >= similarity * (len(left) + len(right) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    # Keys of a text that others hold too; few, whatever its length.
    marks = stage(held.groupBy(F.col("e.id").alias("id")).agg(F.first("e.size").alias("size"), F.collect_list("key").alias("keys")), "marks")

    def likely(pairs: DataFrame) -> DataFrame:
        """Pairs that may be alike by all keys they share, told before any text moves.

        Of the two prefixes one ends first in the order of all shingles. What the texts share up to there is among the keys
        that both prefixes hold, and beyond there are only the shingles that this text has left.
        """
        u, v = [marks.select(F.col("id").alias(x), F.struct("size", "keys").alias(f"of_{x}")) for x in ("u", "v")]
        rest = f"greatest(0, ceil({similarity} * greatest(of_u.size, of_v.size) - {SLACK}) - 1)"
        bound = f"(size(array_intersect(of_u.keys, of_v.keys)) + {rest}) * {1 + similarity} >= {similarity} * (of_u.size + of_v.size) - {SLACK}"
        return pairs.join(u, "u").join(v, "v").where(bound).select("u", "v")

    def checked(pairs: DataFrame) -> DataFrame:
        """The proposed pairs that are alike."""
        proposed = stage(likely(stage(pairs.distinct(), "met")), "proposed")
        ids = stage(proposed.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "ids")
        # Copies of one row share its key, and one of them is enough to compare.
        needed = with_ids(keyed.select(F.col("row").alias("id"), "text"), ids)
        left, right = needed.withColumnsRenamed({"id": "u", "text": "a"}), needed.withColumnsRenamed({"id": "v", "text": "b"})
        return stage(proposed.join(right, "v").join(left, "u").select("u", "v", "a", "b").mapInArrow(verify, "u long, v long"), "alike")

    alike = checked(pairs.unionByName(met(pivot, large)))
    groups = components(alike)
    before = None
    while True:
        # Members of one group need no further link; all others of a large bucket must still meet.
        parted = large.join(groups, F.col("e.id") == F.col("node"), "left").select("key", "e", F.coalesce("component", "e.id").alias("of"))
        counts = parted.groupBy("key", "of").agg(F.count("*").alias("c"))
        totals = counts.groupBy("key").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("within"), F.min_by("of", F.struct(-F.col("c"), "of")).alias("main"))
        parted = stage(parted.join(totals.where("n * n > within"), "key"), "parted")
        members, left = parted.agg(F.count("*"), F.sum((F.col("n") - F.col("within") / F.col("n")) / 2)).first()
        if not members:
            break
        if left <= PAIRED * members or (before is not None and 2 * left > before):
            # What pivots do not bring together is compared pair by pair; the skew join splits a hot key.
            a, b = parted.select("key", F.col("e").alias("a"), F.col("of").alias("of_a")), parted.select("key", F.col("e").alias("b"), F.col("of").alias("of_b"))
            rest = a.join(b, "key").where("a.id < b.id and of_a <> of_b").where(left_over.format("a", "b"))
            alike = alike.unionByName(checked(rest.select(F.col("a.id").alias("u"), F.col("b.id").alias("v"))))
            groups = components(alike)
            break
        before = left
        # A member of the largest group, another one each round.
        pivot = parted.groupBy("key").agg(F.min_by("e", F.struct(F.col("of") != F.col("main"), F.xxhash64("e.id", F.lit(int(left))))).alias("p"))
        alike = alike.unionByName(checked(met(pivot, parted)))
        groups = components(alike)
    classes = stage(
        rows.join(texts.select("digest", "id"), "digest").join(groups, F.col("id") == F.col("node"), "left")
        .select("row", "doc_id", F.coalesce("component", "id").alias("class")),
        "classes",
    )
    least = classes.groupBy("class").agg(F.min(order).alias("least"), F.count("*").alias("n")).where("n > 1")
    return classes.join(least, "class").select("row", "doc_id", F.col("least.row").alias("keeper"))


def duplicate_groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that another row stands for, and rows that stay but are written several times; both in column ``row``.

    Links are those of SimHash (fingerprints within two bits, see ``near_components``) and, as short texts
    change their fingerprint with any edit, the verified pairs of ``near_groups``. A group is whatever links of
    both kinds connect. Its row with the smallest doc_id stays; null ids count as larger than any id.
    """
    keyed = docs.select(row_key("doc_id", "text").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = near_components(keyed.select(F.col("row").alias("doc_id"), "text"))
    linked = marked.where("doc_id <> component_id").select(F.col("doc_id").alias("u"), F.col("component_id").alias("v"))
    groups = stage(near_groups(docs), "groups")
    edges = linked.unionByName(groups.where("row <> keeper").select(F.col("row").alias("u"), F.col("keeper").alias("v")))
    nodes = components(edges)
    members = stage(keyed.select("row", "doc_id").join(nodes, F.col("row") == F.col("node")).select("row", "doc_id", "component").distinct(), "members")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    least = members.groupBy("component").agg(F.min(order).alias("least"))
    dropped = stage(members.join(least, "component").where("row <> least.row").select("row"), "dropped")
    again = groups.groupBy("row").agg(F.count("*").alias("n")).where("n > 1").select("row").join(dropped, "row", "left_anti")
    return dropped, stage(again, "repeated")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without near copies: of each group the row with the smallest doc_id stays."""
    dropped, again = duplicate_groups(docs)
    kept = without_rows(docs, dropped)
    # A row written several times is its own keeper several times over.
    n = again.count()
    if not n:
        return kept
    several = broadcast_if_small(again, {"rows": n, "bytes": 8 * n})
    once = packed(kept).join(several, "row", "left_semi").dropDuplicates(["row"]).select("doc.*")
    return without_rows(kept, again).unionByName(once)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document, links at two or fewer bits."""
    return near_components(documents(spark, sf_dir))
