"""Sharding by extendible hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from namesift.llm.common import documents, packed
from namesift.session import stage

MAX_BYTES = 1 << 20
# Bits of the hash, and how many the directory takes beyond what even shards need.
BITS = 60
SPARE = 3
# A directory of up to so many cells is broadcast, a larger one joined by a shuffle.
SENT_CELLS = 50_000


def _prefix(depth: int) -> Column:
    return F.shiftright("_hash", BITS - depth)


def _directory(cells: DataFrame, depth: int, max_bytes: int) -> DataFrame:
    """(_cell, depth, bytes): for each prefix of ``depth`` bits the bucket it points to.

    The bucket is the shortest prefix whose bytes fit; a cell too large even at
    ``depth`` has no row.
    """
    levels = cells.select("_cell", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("depth"), "bytes")
    prefix = F.expr(f"shiftright(_cell, {depth} - depth)")
    sizes = levels.groupBy("depth", prefix.alias("prefix")).agg(F.sum("bytes").alias("bytes"))
    fits = sizes.where(F.col("bytes") <= max_bytes)
    at = levels.select("_cell", "depth", prefix.alias("prefix"))
    return at.join(fits, ["depth", "prefix"]).groupBy("_cell").agg(F.min(F.struct("depth", "bytes")).alias("b")).select("_cell", "b.depth", "b.bytes")


def shards(docs: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(doc, shard, depth, shard_bytes) for every row of ``docs``; doc is the row as a struct.

    A row hashes by doc_id and text. Buckets of hash prefixes split on their next
    bit only while their texts exceed ``max_bytes`` bytes of UTF-8, so the depth differs
    between shards; ``shard`` is the prefix in bits, ``-`` for the whole table. The
    directory is built from sums over prefixes of a fixed depth; prefixes still
    too large, and no others, are summed again at more bits. Rows that agree in all
    60 bits, such as copies of one row, cannot be split by any bit: they go to
    numbered overflow shards of as many rows as surely fit. A shard is over the
    limit only if it is one row that is larger. Null texts have no bytes.
    """
    doc_id, text = F.coalesce(F.col("doc.doc_id").cast("string"), F.lit("~")), F.coalesce("doc.text", F.lit(""))
    keyed = packed(docs).select("doc", F.octet_length(text).cast("long").alias("_bytes"), F.md5(F.concat(doc_id, F.lit("|"), F.md5(text))).alias("_md5"))
    keyed = keyed.select("doc", "_bytes", F.conv(F.substring("_md5", 1, 15), 16, 10).cast("long").alias("_hash"))
    sizes = stage(keyed.groupBy("_hash").agg(F.sum("_bytes").alias("bytes")), "sizes")
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    depth, left = min(BITS, max(1, total // max_bytes).bit_length() + SPARE), sizes
    rest, parts = keyed, []
    while True:
        cells = stage(left.groupBy(_prefix(depth).alias("_cell")).agg(F.sum("bytes").alias("bytes")), "cells")
        directory = stage(_directory(cells, depth, max_bytes), "directory")
        named = directory.select("_cell", F.col("depth").alias("_depth"), F.col("bytes").alias("_shard_bytes"))
        bits = F.expr(f"if(_depth = 0, '-', lpad(conv(shiftright(_hash, {BITS} - _depth), 10, 2), _depth, '0'))")
        held = rest.withColumn("_cell", _prefix(depth))
        named = F.broadcast(named) if directory.count() <= SENT_CELLS else named
        parts.append(held.join(named, "_cell").withColumn("_shard", bits))
        large = cells.where(F.col("bytes") > max_bytes).select("_cell")
        if large.isEmpty():
            break
        rest = held.join(large, "_cell", "left_semi").drop("_cell")
        if depth == BITS:
            parts.append(_overflow(rest, max_bytes))
            break
        left = left.withColumn("_cell", _prefix(depth)).join(large, "_cell", "left_semi").drop("_cell")
        depth = min(BITS, depth + 8)
    names = [F.col("_shard").alias("shard"), F.col("_depth").cast("int").alias("depth"), F.col("_shard_bytes").alias("shard_bytes")]
    out = parts[0].select("doc", *names)
    for part in parts[1:]:
        out = out.unionByName(part.select("doc", *names))
    return out


def _overflow(rows: DataFrame, max_bytes: int) -> DataFrame:
    """Numbered shards for rows that share all bits, numbered within written pieces."""
    rows = stage(rows.withColumn("_piece", F.shiftright(F.monotonically_increasing_id(), 12)), "overflow")
    pieces = rows.groupBy("_hash", "_piece").agg(F.count("*").alias("_n"), F.max("_bytes").alias("_most"))
    before = Window.partitionBy("_hash").orderBy("_piece")
    pieces = pieces.withColumn("_before", F.sum("_n").over(before) - F.col("_n")).withColumn("_most", F.max("_most").over(Window.partitionBy("_hash")))
    number = F.row_number().over(Window.partitionBy("_hash", "_piece").orderBy("_bytes")) - 1 + F.col("_before")
    fit = F.greatest(F.lit(1), F.floor(F.lit(max_bytes) / F.col("_most"))).cast("long")
    paged = rows.join(pieces, ["_hash", "_piece"]).withColumn("_page", F.floor(number / fit))
    totals = paged.groupBy("_hash", "_page").agg(F.sum("_bytes").alias("_shard_bytes"))
    name = F.concat(F.expr(f"lpad(conv(_hash, 10, 2), {BITS}, '0')"), F.lit("+"), F.col("_page").cast("string"))
    return paged.join(totals, ["_hash", "_page"]).withColumn("_shard", name).withColumn("_depth", F.lit(BITS))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document."""
    rows = shards(documents(spark, sf_dir).select("doc_id", "text"))
    n_bytes = F.coalesce(F.octet_length("doc.text"), F.lit(0)).cast("long").alias("n_bytes")
    return rows.select("doc.doc_id", n_bytes, "shard", "depth", "shard_bytes")


ORACLE = f"""
WITH d AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '~') || '|' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents),
l AS (
  SELECT depth, h >> ({BITS} - depth) AS prefix, sum(n_bytes)::BIGINT AS shard_bytes
  FROM d, range(0, {BITS + 1}) AS r(depth) GROUP BY ALL HAVING sum(n_bytes) <= {MAX_BYTES}),
b AS (
  SELECT d.h, min(l.depth) AS depth
  FROM (SELECT DISTINCT h FROM d) d, l WHERE l.prefix = d.h >> ({BITS} - l.depth) GROUP BY d.h)
SELECT doc_id, n_bytes,
  CASE WHEN b.depth = 0 THEN '-' ELSE lpad(bin(d.h >> ({BITS} - b.depth)), b.depth::INTEGER, '0') END AS shard,
  b.depth::INTEGER AS depth, l.shard_bytes
FROM d JOIN b USING (h) JOIN l ON l.depth = b.depth AND l.prefix = d.h >> ({BITS} - b.depth)
"""
