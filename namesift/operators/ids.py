"""Row numbers without a global sort in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEPARATOR = "\u001f"
BUCKET_ROWS = 200_000


def content_hash(columns: Sequence[str]) -> Column:
    """Hex digest of the columns; NULL differs from the empty string."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.md5(F.concat_ws(SEPARATOR, *parts))


def _digits(n: int) -> int:
    """Hex digits that cut ``n`` values into buckets of about ``BUCKET_ROWS``, five at most."""
    digits = 1
    while digits < 5 and n > BUCKET_ROWS * 16**digits:
        digits += 1
    return digits


def _within_keys(whole: DataFrame, keys: DataFrame, key_rows: int) -> DataFrame:
    """First numbers of the different rows (_hash, _rest, _copies) from those of their keys.

    A key's rows follow the hash of their other columns. Those of a key with more than ``key_rows`` rows are dealt into
    cells by the first digits of that hash; a cell begins where the ones before it end.
    """
    keys = keys.select("_hash", F.col("_copies").alias("_size"), "_first")
    digits = _digits(keys.agg(F.max("_size")).first()[0] or 0)
    cell = F.when(F.col("_size") > key_rows, F.substring("_rest", 1, digits)).otherwise("")
    rows = whole.join(keys, "_hash").withColumn("_cell", cell)
    sums = rows.filter("_cell != ''").groupBy("_hash", "_cell").agg(F.sum("_copies").alias("_n"))
    earlier = Window.partitionBy("_hash").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_hash", "_cell", F.sum("_n").over(earlier).alias("_start"))
    before = Window.partitionBy("_hash", "_cell").orderBy("_rest").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.sum("_copies").over(before)).join(starts, ["_hash", "_cell"], "left")
    first = F.col("_first") + F.coalesce("_start", F.lit(0)) + F.coalesce("_before", F.lit(0))
    return rows.select("_hash", "_rest", "_copies", first.alias("_first"))


def assign_ids(
    df: DataFrame,
    by: Sequence[str] | None = None,
    id_col: str = "id",
    digits: int | None = None,
    copies_per_task: int = 100_000,
    key_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Number the rows 0..n-1 in the order of their content hash.

    ``by`` names columns that identify a row; rows that repeat them are ordered by the hash of
    their other columns. Without it every column counts. Whole copies of a row get consecutive numbers.

    Numbers are worked out on hashes with their counts alone: the leading hex digits
    (by default as many as the measured count calls for) cut them into even buckets,
    bucket totals give each bucket its first number, and hashes are numbered inside
    their bucket. The totals have at most 16**digits rows, which bounds their window and
    their broadcast. Whole rows are shuffled once, by their hash, to meet their
    number. The rows of one ``by`` value are numbered in cells of their other hash if they are more than
    ``key_rows``, so a hot value is not one task. Copies meet as one row with a count; up to ``copies_per_task`` of them
    are written out where they are, more in blocks over many tasks.
    """
    columns = list(df.columns)
    rest = [c for c in columns if by is not None and c not in by]
    hashed = df.withColumn("_hash", content_hash(by or columns)).withColumn("_rest", content_hash(rest) if rest else F.lit(""))
    whole = hashed.groupBy("_hash", "_rest").agg(F.count(F.lit(1)).alias("_copies"))
    counts = whole.groupBy("_hash").agg(F.sum("_copies").alias("_copies")) if rest else whole.drop("_rest")
    if digits is None:
        digits = _digits(df.count())
    counts = counts.withColumn("_bucket", F.substring("_hash", 1, digits))

    sums = counts.groupBy("_bucket").agg(F.sum("_copies").alias("_size"))
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_bucket", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"))

    before = Window.partitionBy("_bucket").orderBy("_hash").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_copies").over(before), F.lit(0))
    numbers = counts.withColumn("_offset", offset).join(F.broadcast(starts), "_bucket")
    numbers = numbers.select("_hash", "_copies", (F.col("_start") + F.col("_offset")).alias("_first"))
    if rest:
        numbers = _within_keys(whole, numbers, key_rows)
    else:
        numbers = numbers.withColumn("_rest", F.lit(""))

    once = hashed.groupBy("_hash", "_rest").agg(*[F.any_value(c).alias(c) for c in columns])
    joined = once.join(numbers, ["_hash", "_rest"])
    few = joined.filter(F.col("_copies") <= copies_per_task)
    few = few.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_copies") - 1)))
    many = joined.filter(F.col("_copies") > copies_per_task)
    blocks = F.sequence(F.lit(0).cast("bigint"), F.expr(f"(_copies - 1) div {copies_per_task}"))
    many = many.withColumn("_block", F.explode(blocks)).repartition("_hash", "_block")
    first = F.col("_block") * copies_per_task
    last = F.least(first + copies_per_task, F.col("_copies")) - 1
    many = many.withColumn("_copy", F.explode(F.sequence(first, last))).drop("_block")
    return few.unionByName(many).select((F.col("_first") + F.col("_copy")).alias(id_col), *columns)
