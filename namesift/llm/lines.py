"""Removing lines that are spread over many sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from namesift.llm.common import documents, packed, row_key
from namesift.llm.quality import SPACES
from namesift.session import stage

# A line goes if it stands on so many different sites.
SITES = 5
# Shorter lines are too likely to be alike by chance.
LEAST_CHARS = 20
# Sketch precision, and the share around the threshold in which sketches do not decide:
# five standard errors of a sketch of 2^10 registers.
PRECISION = 10
BAND = 5 * 1.04 / 2 ** (PRECISION / 2)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _spread(docs: DataFrame, site: str) -> DataFrame:
    """(key, line, site) for every line long enough to be looked at; no text leaves its task."""
    rows = docs.select(row_key("doc_id", "text").alias("key"), F.col(site).alias("site"), F.posexplode(_lines(F.col("text"))).alias("at", "line"))
    rows = rows.withColumn("line", F.btrim("line", F.lit(SPACES))).where(F.char_length("line") >= LEAST_CHARS)
    return rows.select("key", "site", "at", F.xxhash64("line").alias("line"))


def boilerplate(docs: DataFrame, site: str = "source", sites: int = SITES) -> DataFrame:
    """(line) hashes of lines that stand on ``sites`` or more different sites.

    Lines of fewer occurrences than ``sites`` cannot pass: plain counts set them aside,
    which leaves few lines to sketch. A HyperLogLog sketch of the sites is kept per
    line hash and merged by the aggregate, so a line in every document stays one
    small row per task. Estimates clear of the threshold decide; within five standard
    errors of it sites are counted exactly. A null site counts as no site.
    """
    rows = _spread(docs, site).select("line", "site")
    often = rows.groupBy("line").agg(F.count("site").alias("n")).where(F.col("n") >= sites).select("line")
    rows = rows.join(stage(often, "often"), "line", "left_semi")
    sketches = rows.groupBy("line").agg(F.hll_sketch_agg("site", PRECISION).alias("sketch"))
    counted = sketches.select("line", F.hll_sketch_estimate("sketch").alias("estimate"))
    counted = stage(counted.where(F.col("estimate") >= sites * (1 - BAND)), "spread")
    near = counted.where(F.col("estimate") <= sites * (1 + BAND)).select("line")
    exact = rows.join(near, "line", "left_semi").groupBy("line", "site").agg(F.lit(1).alias("one")).groupBy("line").agg(F.count("site").alias("n"))
    return counted.where(F.col("estimate") > sites * (1 + BAND)).select("line").unionByName(exact.where(F.col("n") >= sites).select("line"))


def without_boilerplate(docs: DataFrame, site: str = "source", sites: int = SITES) -> DataFrame:
    """(doc, kept, n_lines, n_removed) for every row of ``docs``: its text without its boilerplate lines.

    Lines are compared without white space at their ends; other lines stay as they
    are, blank ones too. Positions of removed lines come back to their row by its
    content key, so repeated rows and null ids are no trouble, and are cut out in
    one pass. A null text stays null and loses nothing. ``doc`` is the row as a struct.
    """
    marked = stage(boilerplate(docs, site, sites), "boilerplate")
    places = _spread(docs, site).join(marked, "line").groupBy("key").agg(F.array_sort(F.collect_set("at")).alias("at"))
    rows = packed(docs).join(places.withColumnRenamed("key", "row"), "row", "left").withColumn("lines", _lines(F.col("doc.text")))
    rows = rows.withColumn("cut", F.concat(F.array(F.lit(-1)), F.col("at"), F.array(F.size("lines"))))
    pieces = F.expr("flatten(transform(sequence(0, size(cut) - 2), j -> slice(lines, cut[j] + 2, cut[j + 1] - cut[j] - 1)))")
    kept = F.when(F.col("at").isNull(), F.col("doc.text")).otherwise(F.array_join(pieces, "\n"))
    removed = F.when(F.col("at").isNull(), 0).otherwise(F.size("at"))
    return rows.select("doc", kept.alias("kept"), F.size("lines").cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without lines that stand on five or more sources."""
    rows = without_boilerplate(documents(spark, sf_dir).select("doc_id", "source", "text"))
    kept = F.coalesce("kept", F.lit(""))
    return rows.select("doc.doc_id", "n_lines", "n_removed", F.char_length(kept).cast("long").alias("kept_chars"), F.md5(kept).alias("kept_md5"))


_TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
e AS (SELECT r, doc_id, source, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
b AS (
  SELECT trim(line, {_TRIM}) AS line FROM e WHERE length(trim(line, {_TRIM})) >= {LEAST_CHARS}
  GROUP BY 1 HAVING count(DISTINCT source) >= {SITES}),
k AS (
  SELECT r, count(*) AS n_lines, count(b.line) AS n_removed,
    coalesce(string_agg(e.line, chr(10) ORDER BY pos) FILTER (b.line IS NULL), '') AS kept
  FROM e LEFT JOIN b ON trim(e.line, {_TRIM}) = b.line GROUP BY r)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_removed::BIGINT AS n_removed,
  length(kept)::BIGINT AS kept_chars, md5(kept) AS kept_md5
FROM d JOIN k USING (r)
"""
