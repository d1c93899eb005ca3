"""Closures over links: sub-resources, descriptions, removal, export. Each round is a join with the frontier only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.graph import TYPE
from ..plans.ontology import Ontology
from ..session import cut_lineage
from .mutate import META, SUBRESOURCE, Changed, settled, touched


def reachable(start: DataFrame, edges: DataFrame) -> DataFrame:
    """s: what start (s) reaches over edges (s, o), itself included, however deep: each round but the last finds something new."""
    found = start.select("s").distinct()
    frontier = found
    while True:
        frontier = cut_lineage(frontier.join(edges, "s").select(F.col("o").alias("s")).distinct().join(found, "s", "left_anti"))
        if frontier.isEmpty():
            return found
        found = cut_lineage(found.unionByName(frontier))


def subresources(quads: DataFrame, start: DataFrame, p: str = SUBRESOURCE) -> DataFrame:
    return reachable(start, quads.filter(F.col("p") == p).select("s", "o"))


def owned(quads: DataFrame, start: DataFrame, p: str = SUBRESOURCE) -> DataFrame:
    """start and those of its sub-resources that nothing outside links to: the outside's links are taken off until none is left."""
    chosen = subresources(quads, start, p)
    links = quads.filter("o_kind = 'uri'").select(F.col("s").alias("from"), F.col("o").alias("s")).filter(F.col("from") != F.col("s"))
    while True:  # each round but the last takes something off
        linked = links.join(chosen, "s", "left_semi").join(chosen.select(F.col("s").alias("from")), "from", "left_anti").select("s").distinct()
        outside = cut_lineage(linked.join(start.select("s"), "s", "left_anti"))
        if outside.isEmpty():
            return chosen
        chosen = cut_lineage(chosen.join(outside, "s", "left_anti"))


def remove_resources(quads: DataFrame, resources: DataFrame, now: str, with_subresources: bool = False) -> Changed:
    """Resources go as subjects and as objects; who referred to them is modified."""
    gone = owned(quads, resources) if with_subresources else resources.select("s").distinct()
    as_object = gone.select(F.col("s").alias("o"))
    left = quads.join(gone, "s", "left_anti")
    referring = left.filter("o_kind = 'uri'").join(as_object, "o", "left_semi")
    rest = left.join(as_object.withColumn("o_kind", F.lit("uri")), ["o", "o_kind"], "left_anti").select(*quads.columns)
    dropped = quads.join(gone, "s", "left_semi").select("s", "p", "o").unionByName(referring.select("s", "p", "o")).withColumn("added", F.lit(False))
    return settled(touched(rest, referring, now), dropped)


def describe(quads: DataFrame, ontology: Ontology, resources: DataFrame, discardable: bool = True) -> DataFrame:
    """Quads of the resources and their sub-resources, and of what those are related to only the defining properties, transitively."""
    whole = subresources(quads, resources)
    usable = quads if discardable else quads.filter(~F.col("g").startswith("graph:/discardable/") | F.col("p").isin(META))
    own = usable.join(whole, "s", "left_semi")
    facts = usable.filter(F.col("p").isin(ontology.defining()))
    links = facts.filter((F.col("o_kind") == "uri") & (F.col("p") != TYPE)).select("s", "o")
    related = own.filter((F.col("o_kind") == "uri") & (F.col("p") != TYPE)).select(F.col("o").alias("s")).distinct()
    around = reachable(related, links).join(whole, "s", "left_anti")
    found = own.unionByName(facts.join(around, "s", "left_semi"))
    real = found.filter(~F.col("p").isin(META)).select("s").distinct()
    return found.join(real, "s", "left_semi")


def anonymized(quads: DataFrame, prefix: str) -> DataFrame:
    """Resource uris under prefix become blank nodes, the same one everywhere."""
    name = lambda c: F.when(F.col(c).startswith(prefix), F.concat(F.lit("_:b"), F.substring(F.sha2(c, 256), 1, 16))).otherwise(F.col(c))
    return quads.withColumn("s", name("s")).withColumn("o", F.when(F.col("o_kind") == "uri", name("o")).otherwise(F.col("o")))
