"""Entities from matching pairs: connected records, split where only a few links hold them together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namesift.session import stage


def _both_ways(edges: DataFrame) -> DataFrame:
    turned = [F.col("v").alias("u"), F.col("u").alias("v"), *[c for c in edges.columns if c not in ("u", "v")]]
    return edges.unionByName(edges.select(*turned))


def _print(edges: DataFrame) -> tuple:
    """Row count and sum of row hashes: two rounds that agree in both have the same links."""
    hashes = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), hashes).first())


def connected(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (u, v); a component is named by its smallest node.

    Stars are contracted: in turn, every node ties its larger neighbours, then its smaller ones, to the smallest
    neighbour it knows, until each component is a star. Each round is one aggregate and one join, written to the
    shared folder; the number of rounds grows with the logarithm of a component's width. A hot node
    is only ever reduced by an aggregate or split by the skew join. A link from a node to itself keeps the node.
    """
    loops = links.filter("u = v").select(F.col("u").alias("node")).distinct()
    stars = stage(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = _print(stars)
    while seen[0]:
        ways = _both_ways(stars)
        least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        larger = ways.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        first = larger.groupBy("u").agg(F.min("v").alias("m"))
        tied = larger.join(first, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = stage(tied.unionByName(first.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = _print(stars)
        if now == seen:
            break
        seen = now
    leaves = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    named = leaves.unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    alone = loops.join(named, "node", "left_anti").select("node", F.col("node").alias("component"))
    return named.unionByName(alone)


def pivots(links: DataFrame) -> DataFrame:
    """``node, is_pivot``: a greatest set of nodes no two of which are linked, taken in a random but fixed order.

    Nodes are taken in the order of a digest of their id unless a node taken before is linked to them. All nodes
    that come before every open neighbour are taken at once, which gives the same set as one by one, in a
    number of rounds that grows with the logarithm of the number of nodes.
    """
    ways = stage(_both_ways(links.filter("u <> v").select("u", "v").distinct()), "ways")
    open_nodes = ways.select(F.col("u").alias("node")).distinct()
    done = None
    while True:
        rank = lambda c: F.struct(F.md5(F.col(c).cast("string").cast("binary")).alias("d"), F.col(c).alias("id"))
        nearest = ways.groupBy(F.col("u").alias("node")).agg(F.min(rank("v")).alias("least"))
        taken = open_nodes.join(nearest, "node", "left").filter(F.col("least").isNull() | (rank("node") < F.col("least")))
        taken = stage(taken.select("node"), "pivots")
        beside = ways.join(taken, ways["u"] == taken["node"], "left_semi").select(F.col("v").alias("node")).distinct()
        settled = taken.withColumn("is_pivot", F.lit(True)).unionByName(beside.withColumn("is_pivot", F.lit(False)))
        settled = stage(settled, "settled")
        done = settled if done is None else done.unionByName(settled)
        gone = settled.select("node")
        open_nodes = stage(open_nodes.join(gone, "node", "left_anti"), "open")
        if open_nodes.isEmpty():
            return done
        left = ways.join(gone, ways["u"] == gone["node"], "left_anti")
        ways = stage(left.join(gone, left["v"] == gone["node"], "left_anti"), "ways")


def entity_clusters(pairs: DataFrame, left: str, right: str, weight: str, least: float) -> DataFrame:
    """``node, component, cluster``: which records are one entity, from pairs with a weight.

    Pairs of at least weight ``least`` are links; several pairs of the same records count by their best. A component
    is everything connected at all. A cluster is a pivot with records linked to it directly: each other record joins
    the pivot it has its best link to, ties by the order of pivots. So a record that one weak link ties to another
    entity stays with its own, where a component would merge the two. Every record of a pair appears once; one whose
    pairs are all below ``least`` is a cluster of its own.
    """
    both = pairs.select(F.col(left).alias("u"), F.col(right).alias("v"), F.col(weight).alias("w"))
    nodes = both.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    ordered = both.filter(F.col("w") >= least).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w")
    links = stage(ordered.filter("u <> v").groupBy("u", "v").agg(F.max("w").alias("w")), "matches")
    chosen = stage(pivots(links), "chosen") if not links.isEmpty() else links.select(F.col("u").alias("node"), F.lit(True).alias("is_pivot"))
    heads = chosen.filter("is_pivot").select(F.col("node").alias("v"))
    others = chosen.filter("not is_pivot").select(F.col("node").alias("u"))
    order = F.struct((-F.col("w")).alias("w"), F.md5(F.col("v").cast("string").cast("binary")).alias("d"), F.col("v").alias("v"))
    best = _both_ways(links).join(others, "u", "left_semi").join(heads, "v", "left_semi").groupBy("u").agg(F.min(order).alias("best"))
    joined = best.select(F.col("u").alias("node"), F.col("best.v").alias("cluster"))
    members = joined.unionByName(heads.select(F.col("v").alias("node"), F.col("v").alias("cluster")))
    found = connected(links).join(members, "node")
    return nodes.join(found, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component"), F.coalesce("cluster", "node").alias("cluster")
    )
