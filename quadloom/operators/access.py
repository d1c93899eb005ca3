"""Looking at resources: properties, labels, tags, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.graph import TYPE
from ..plans.ontology import Ontology

# Where a label or a description is looked for, in order.
LABELS = ("nao:prefLabel", "rdfs:label", "nie:title", "nco:fullname", "nao:identifier", "nfo:fileName", "nie:url")
DESCRIPTIONS = ("nao:description", "rdfs:comment", "nie:description", "nie:comment")
PREFIXES = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "xsd": "http://www.w3.org/2001/XMLSchema#",
}


def load(quads: DataFrame, uri: str) -> DataFrame:
    """(p, values) of one resource."""
    return quads.filter(F.col("s") == uri).groupBy("p").agg(F.array_sort(F.collect_set("o")).alias("values"))


def records(quads: DataFrame, properties: list[str]) -> DataFrame:
    """(s, a map from property to its values), of the given properties."""
    lists = quads.filter(F.col("p").isin(properties)).groupBy("s", "p").agg(F.array_sort(F.collect_set("o")).alias("values"))
    return lists.groupBy("s").agg(F.map_from_entries(F.collect_list(F.struct("p", "values"))).alias("properties"))


def by_identifier(quads: DataFrame, value: str) -> DataFrame:
    return quads.filter(F.col("p").isin("nao:identifier", "nie:url") & (F.col("o") == value)).select("s").distinct()


def first_of(quads: DataFrame, properties: tuple[str, ...], name: str, fallback: Column | None = None, resources: DataFrame | None = None) -> DataFrame:
    """(s, name): the smallest value of the first of the properties that a resource has, else the fallback."""
    rank = F.array_position(F.array(*[F.lit(p) for p in properties]), F.col("p"))
    rows = quads.filter(F.col("p").isin(*properties)).groupBy("s").agg(F.min(F.struct(rank.alias("rank"), F.col("o"))).alias("best")).select("s", F.col("best.o").alias(name))
    if resources is None:
        return rows
    return resources.select("s").distinct().join(rows, "s", "left").withColumn(name, F.coalesce(name, fallback) if fallback is not None else F.col(name))


def generic_label(quads: DataFrame, resources: DataFrame) -> DataFrame:
    return first_of(quads, LABELS, "label", F.col("s"), resources)


def generic_description(quads: DataFrame, resources: DataFrame) -> DataFrame:
    return first_of(quads, DESCRIPTIONS, "description", None, resources)


def tags(quads: DataFrame, resources: DataFrame, p: str = "nao:hasTag") -> DataFrame:
    return quads.filter(F.col("p") == p).join(resources.select("s").distinct(), "s", "left_semi").select("s", F.col("o").alias("tag"))


def tag_of(quads: DataFrame, tag: str, p: str = "nao:hasTag") -> DataFrame:
    return quads.filter((F.col("p") == p) & (F.col("o") == tag)).select("s").distinct()


def usage(events: DataFrame) -> DataFrame:
    """events: (s, at). How often, first and last."""
    return events.groupBy("s").agg(F.count("*").alias("usage_count"), F.min("at").alias("first_usage"), F.max("at").alias("last_usage"))


def types_of(quads: DataFrame, ontology: Ontology) -> DataFrame:
    """(s, type): own types and those above them."""
    own = quads.filter(F.col("p") == TYPE).select("s", F.col("o").alias("sub")).distinct()
    return own.join(ontology.class_closure(), "sub").select("s", F.col("sup").alias("type")).distinct()


def expanded(column: Column, prefixes: dict[str, str] = PREFIXES) -> Column:
    """rdf:type and the like as full uris."""
    table = F.create_map(*[F.lit(x) for pair in prefixes.items() for x in pair])
    return F.coalesce(F.concat(F.try_element_at(table, F.substring_index(column, ":", 1)), F.substring_index(column, ":", -1)), column)
