"""Repair of whole graphs. Every job is a few aggregates and joins over the quads, and gives the repaired quads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.graph import TYPE, URL
from .mutate import META, renamed


def without_graphs(quads: DataFrame, graphs: list[str]) -> DataFrame:
    return quads.filter(~F.col("g").isin(graphs))


def missing_key(quads: DataFrame, cls: str, key: str) -> DataFrame:
    """s: instances of a class without the property that they need (tags without identifier, files without url)."""
    return quads.filter((F.col("p") == TYPE) & (F.col("o") == cls)).select("s").distinct().join(quads.filter(F.col("p") == key).select("s"), "s", "left_anti")


def untyped(quads: DataFrame) -> DataFrame:
    """s: resources without a type."""
    return quads.select("s").distinct().join(quads.filter(F.col("p") == TYPE).select("s"), "s", "left_anti")


def without_resources(quads: DataFrame, resources: DataFrame) -> DataFrame:
    return quads.join(resources.select("s").distinct(), "s", "left_anti")


def duplicate_groups(quads: DataFrame, cls: str, key: str) -> DataFrame:
    """(from, to): of the instances of a class with equal key, to the smallest; groups of any size."""
    instances = quads.filter((F.col("p") == TYPE) & (F.col("o") == cls)).select("s").distinct()
    keyed = quads.filter(F.col("p") == key).select("s", F.xxhash64("o").alias("h"), F.sha2("o", 256).alias("k")).join(instances, "s", "left_semi")
    first = keyed.groupBy("h", "k").agg(F.min("s").alias("to"), F.count("*").alias("n")).filter("n > 1")
    return keyed.join(first, ["h", "k"]).filter("s <> to").groupBy(F.col("s").alias("from")).agg(F.min("to").alias("to"))


def duplicate_contacts(quads: DataFrame, cls: str, name: str) -> DataFrame:
    """As duplicate_groups, of those instances only that have no other literal than their name."""
    others = quads.filter((F.col("o_kind") == "lit") & (F.col("p") != name) & ~F.col("p").isin(META)).select("s").distinct()
    return duplicate_groups(without_resources(quads, others), cls, name)


def merged(quads: DataFrame, mapping: DataFrame) -> DataFrame:
    """quads in which mapping's resources are one; equal statements of one graph are one."""
    return renamed(quads, mapping).dropDuplicates(["s", "p", "o", "o_kind", "dt", "lang", "g"])


def distinct_statements(quads: DataFrame, graphs: DataFrame | None = None) -> DataFrame:
    """A statement that several graphs have stays in the oldest one (graphs: g, created), then the smallest."""
    return _first(quads, ["s", "p", "o", "o_kind", "dt", "lang"], graphs)


def single_values(quads: DataFrame, properties: list[str], graphs: DataFrame | None = None) -> DataFrame:
    """Of properties that may have one value the one from the oldest graph stays, then the smallest."""
    several = F.col("p").isin(properties)
    return quads.filter(~several).unionByName(_first(quads.filter(several), ["s", "p"], graphs))


def _first(quads: DataFrame, keys: list[str], graphs: DataFrame | None) -> DataFrame:
    rows = quads.join(graphs.select("g", F.col("created").alias("__created")), "g", "left") if graphs is not None else quads.withColumn("__created", F.lit(None).cast("timestamp_ntz"))
    order = Window.partitionBy(*keys).orderBy(F.col("__created").asc_nulls_last(), "g", "o")
    return rows.withColumn("__n", F.row_number().over(order)).filter("__n = 1").select(*quads.columns)


def new_scheme(quads: DataFrame, scheme: str, prefix: str) -> DataFrame:
    """Subjects of an old scheme become resources that keep the old uri as their url."""
    old = quads.filter(F.col("s").startswith(scheme)).select(F.col("s").alias("from")).distinct()
    mapping = old.select("from", F.concat(F.lit(prefix), F.substring(F.sha2("from", 256), 1, 32)).alias("to"))
    urls = mapping.select(F.col("to").alias("s"), F.lit(URL).alias("p"), F.col("from").alias("o"), F.lit("uri").alias("o_kind"), F.lit("nie:url").alias("dt"))
    return renamed(quads, mapping).unionByName(urls, allowMissingColumns=True)


def one_graph_per_app(quads: DataFrame, graphs: DataFrame) -> DataFrame:
    """graphs: (g, app, kind). Every graph of an application and kind becomes its smallest one; equal quads become one."""
    target = graphs.join(graphs.groupBy("app", "kind").agg(F.min("g").alias("__g")), ["app", "kind"]).select("g", "__g")
    moved = quads.join(target, "g", "left").withColumn("g", F.coalesce("__g", "g")).select(*quads.columns)
    return moved.dropDuplicates(["s", "p", "o", "o_kind", "dt", "lang", "g"])


def stale(quads: DataFrame, allowed: Column) -> DataFrame:
    """s: resources with a url that the rules for files (a condition on column o) don't allow."""
    return quads.filter((F.col("p") == URL) & ~allowed).select("s").distinct()


#: Jobs by name; others may be added.
JOBS = {"distinct_statements": distinct_statements, "untyped": lambda q: without_resources(q, untyped(q))}
