"""Connected components of a large edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.shared import discard, materialise, spread_join, with_parts


def _least(sym: DataFrame) -> DataFrame:
    """node, m: the smallest of the node and its neighbours, combined in salted
    parts so that a node with very many edges never meets in one task."""
    return (
        sym.groupBy("u", F.pmod("v", F.lit(32)).alias("cell")).agg(F.min("v").alias("m"))
        .groupBy("u").agg(F.least(F.min("m"), F.col("u")).alias("m"))
        .select(F.col("u").alias("node"), "m")
    )


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (the smallest node reachable) for every node with an edge.

    Each pass ties every larger neighbour to the smallest one (large star), then
    every node to its smallest smaller neighbour (small star). Passes end when only
    stars are left, after about log(n) of them. Edges are written between passes."""
    at = materialise(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "cc")
    while not _stars_only(at):
        both = at.union(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = _least(both)
        ends, total = both.groupBy("u").agg(F.count("*").alias("k")), 2 * at.count()
        both, hubs = with_parts(both, "u", ends, total)
        smallest = m.select(F.col("node").alias("u"), "m").join(F.broadcast(hubs), "u", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        large = spread_join(both, smallest, "u", "v").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        # Small star: edges (u, v) with v < u; all smaller neighbours of u and u itself to the smallest.
        n = _least(large)
        small = large.join(n, large["u"] == n["node"])
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        before, at = at, materialise(small.where("u != v").distinct(), "cc")
        discard(before, hubs)
    members = at.select(F.col("u").alias("node"), F.col("v").alias("component"))
    labels = materialise(members.union(at.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "labels")
    discard(at)
    return labels


def _stars_only(edges: DataFrame) -> bool:
    """Whether every u has one v and no v is a u: then the edges are the answer."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("centre"))
    ends = ends.union(edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("centre")))
    seen = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("centre").alias("centre"))
    return seen.where("out + centre > 1").isEmpty()


def extend_components(labels: DataFrame, links: DataFrame, a: str, b: str) -> DataFrame:
    """``labels`` (node, component) after more links: components of the contracted
    links, which are few, then carried over to the nodes."""
    of = lambda end: labels.select(F.col("node").alias(end), F.col("component").alias(f"c_{end}"))
    contracted = links.select(a, b).join(of(a), a, "left").join(of(b), b, "left")
    contracted = contracted.select(F.coalesce(f"c_{a}", a).alias("a"), F.coalesce(f"c_{b}", b).alias("b"))
    top = connected_components(contracted, "a", "b")
    nodes = materialise(labels.union(top.select("node", F.col("node").alias("component"))).distinct(), "nodes")
    over = top.select(F.col("node").alias("component"), F.col("component").alias("to"))
    counts, total = nodes.groupBy("component").agg(F.count("*").alias("k")), nodes.count()
    nodes_in_parts, large = with_parts(nodes, "component", counts, total)
    over = over.join(F.broadcast(large), "component", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    out = materialise(spread_join(nodes_in_parts, over, "component", "node", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
    discard(top, nodes, large)
    return out
