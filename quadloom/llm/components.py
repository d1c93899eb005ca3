"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is an aggregation and a join on the node; a step's links are written to the shared folder, so lineage stays
short and nothing is gathered on the driver but one row of sums. A hub's rows are pre-aggregated in the aggregation and
can be split by adaptive execution in the join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Steps after which something is wrong: components of a billion nodes need about 30.
MOST_STEPS = 60


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: (u, v) with v < u. Every node's larger neighbours (or, small: all the others) go to its smallest one."""
    if large:
        around = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = around.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        moved = links.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("l")).select("l.u", "l.v")
    return moved.filter("u <> v").distinct()


def _settled(links: DataFrame) -> bool:
    """Whether every node has one smaller node only, which has none itself: then each star is a component."""
    down = links.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = down.unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return not nodes.agg(F.max(F.expr("down > 1 or (down > 0 and up > 0)"))).first()[0]


def connected_components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for every node that a link (a, b) touches; component: the smallest node that it reaches."""
    now = scratch.table(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}_0")
    for step in range(1, MOST_STEPS):
        if _settled(now):
            break
        now = scratch.table(_star(_star(now, large=True), large=False), f"{name}_{step}")
        scratch.drop(f"{name}_{step - 1}")
    else:
        raise RuntimeError("the components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def merged_components(parts: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """parts, as connected_components gives them, once more links (a, b) are known. Only the links between components are
    walked, between their smallest nodes; parts is renamed after that."""
    side = lambda x: parts.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
    ends = links.join(side("a"), "a", "left").join(side("b"), "b", "left")
    across = scratch.table(ends.select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b")).filter("a <> b").distinct(), f"{name}_across")
    if across.isEmpty():
        return parts
    moved = scratch.table(connected_components(across, scratch, name), f"{name}_moved")
    renamed = parts.join(moved.select(F.col("node").alias("component"), F.col("component").alias("root")), "component", "left")
    new = moved.join(parts.select("node"), "node", "left_anti")  # nodes that no link touched before
    return scratch.table(renamed.select("node", F.coalesce("root", "component").alias("component")).unionByName(new.select("node", "component")), f"{name}_parts")
