"""Mixing sources to target weights by Pfair scheduling of blocks."""

from __future__ import annotations

import heapq
from math import gcd

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from namesift.llm.common import documents, packed
from namesift.operators.sizing import broadcast_if_small

# Rows of a block, the unit that is scheduled.
BLOCK_ROWS = 32
# Shares that default weights sum to, about.
SHARES = 1000
# Rows numbered together; a hot source is dealt to as many cells as it fills.
CELL_ROWS = 20_000


def frame(shares: list[int]) -> list[int]:
    """One period of the schedule: the source that each of sum(shares) slots serves.

    Block i (from 0) of a source with share a of A may start at floor(i A / a) and
    has to end by ceil((i + 1) A / a). Earliest deadline first meets all of these
    windows, so after every slot each source is less than one block from its due.
    """
    total = sum(shares)
    waiting = [(0, s, 0) for s, a in enumerate(shares) if a]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    out = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * total // shares[s]), s, i))
        _, s, i = heapq.heappop(ready)
        out.append(s)
        if i + 1 < shares[s]:
            heapq.heappush(waiting, ((i + 1) * total // shares[s], s, i + 1))
    return out


def phases(blocks: list[int], shares: list[int]) -> list[list[tuple[int, int, int, list[int]]]]:
    """For each source its phases: (first block, first slot, period, slots within a period).

    The schedule repeats with the sum of the shares, so a phase is told by one
    period. When a source has no block left a new phase begins, in which the others
    keep their shares of what remains.
    """
    left, done, offset = list(blocks), [0] * len(blocks), 0
    out: list[list[tuple[int, int, int, list[int]]]] = [[] for _ in blocks]
    while any(left):
        active = [a if n else 0 for a, n in zip(shares, left, strict=True)]
        common = gcd(*active)
        active = [a // common for a in active]
        period = sum(active)
        places: list[list[int]] = [[] for _ in blocks]
        for slot, s in enumerate(frame(active)):
            places[s].append(slot)
        served = [s for s, a in enumerate(active) if a]
        length = min((left[s] - 1) // active[s] * period + places[s][(left[s] - 1) % active[s]] for s in served) + 1
        for s in served:
            out[s].append((done[s], offset, period, places[s]))
            n = length // period * active[s] + sum(p < length % period for p in places[s])
            done[s] += n
            left[s] -= n
        offset += length
    return out


def default_shares(counts: list[int]) -> list[int]:
    """Shares in proportion to the square root of the rows, at least one each."""
    total = sum(n**0.5 for n in counts)
    return [max(1, round(SHARES * n**0.5 / total)) for n in counts]


def mixed(docs: DataFrame, weights: dict[str | None, int] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc, block, slot, order) for every row of ``docs``: where it stands in the mix.

    Rows of a source are put in the order of a content hash and cut into blocks of
    ``block_rows``; blocks of all sources are interleaved so that each source is
    always less than one block from its weight among the sources that still have
    rows. ``weights`` are whole shares by source; a source without one has share 1,
    and by default shares follow the square root of the rows. A null source is a
    source of its own. Every row is kept. order has gaps after a source's last block.
    ``doc`` is the row as a struct.

    The driver holds one row per source and one period per phase. Rows are numbered
    within hash cells of bounded size, so no source passes through one task.
    """
    spark = docs.sparkSession
    counts = sorted(docs.groupBy("source").count().collect(), key=lambda r: (r[0] is None, r[0]))
    rows = [r[1] for r in counts]
    blocks = [-(-n // block_rows) for n in rows]
    shares = default_shares(rows) if weights is None else [max(1, weights.get(r[0], 1)) for r in counts]
    plan = [("n" if r[0] is None else f"s{r[0]}", p) for r, p in zip(counts, phases(blocks, shares), strict=True)]
    slots = sum(len(p[3]) for _, ps in plan for p in ps)
    schema = "name string, phases array<struct<first: long, slot: long, period: long, places: array<long>>>"
    plan = broadcast_if_small(spark.createDataFrame(plan, schema), {"rows": len(plan), "bytes": 8 * slots})
    cells = max(1, -(-sum(rows) // CELL_ROWS))
    keyed = packed(docs).withColumn("name", F.when(F.col("doc.source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("doc.source"))))
    keyed = keyed.withColumn("cell", F.pmod("row", F.lit(cells)))
    sizes = keyed.groupBy("name", "cell").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("name").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("name", "cell", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    # The join and the window share one exchange of the rows; the plan joins after it.
    number = F.row_number().over(Window.partitionBy("name", "cell").orderBy("row", "doc.doc_id")) - 1
    placed = keyed.join(sizes, ["name", "cell"]).withColumn("place", number + F.col("before"))
    placed = placed.withColumn("block", F.expr(f"place div {block_rows}")).join(plan, "name")
    placed = placed.withColumn("phase", F.element_at(F.filter("phases", lambda p: p["first"] <= F.col("block")), -1))
    within, size = F.col("block") - F.col("phase.first"), F.size("phase.places")
    slot = F.col("phase.slot") + F.expr("(block - phase.first) div size(phase.places)") * F.col("phase.period")
    placed = placed.withColumn("slot", slot + F.get("phase.places", (within % size).cast("int")))
    order = F.col("slot") * block_rows + F.col("place") % block_rows
    return placed.select("doc", "block", "slot", order.alias("order"))


def in_order(docs: DataFrame) -> DataFrame:
    """``docs`` written in the order of the mix: ranges of it, each sorted."""
    return mixed(docs).repartitionByRange("order").sortWithinPartitions("order").select("doc.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block, slot and order of every document in the mix."""
    rows = mixed(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return rows.select("doc.doc_id", "doc.source", "block", "slot", F.col("order").alias("mix_order"))
