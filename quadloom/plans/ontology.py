"""Schema as data: classes and properties, their closures, and what each property allows.

An ontology is a small table (a row a class or property) that a person maintains; closures over it are iterated joins with
a bound on rounds, and joins with it are broadcast by Spark's own size check."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

ROOT = "rdfs:Resource"
SCHEMA = "uri string, is_property boolean, parent string, domain string, range string, max_card int, defining boolean, inverse string, label string"


def closure(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(sub, sup), reflexive and transitive, of edges (sub, sup) over nodes (uri). Cycles are no problem: pairs are a set."""
    known = nodes.select(F.col("uri").alias("sub"), F.col("uri").alias("sup")).unionByName(edges.select("sub", "sup")).distinct()
    count = known.count()
    while True:  # paths double each round, until there are no more
        twice = known.alias("a").join(known.alias("b"), F.col("a.sup") == F.col("b.sub")).select(F.col("a.sub"), F.col("b.sup")).distinct()
        known = cut_lineage(twice)
        found = known.count()
        if found == count:
            return known
        count = found


@dataclass
class Ontology:
    """table: SCHEMA, a row for each parent of each class or property."""

    table: DataFrame

    @classmethod
    def of(cls, spark: SparkSession, classes: dict[str, list[str]], properties: dict[str, dict]) -> Ontology:
        """classes: parents by class; properties: parent, domain, range, max_card, defining, inverse, label by property."""
        rows = [(c, False, p, None, None, 0, None, None, c.rpartition(":")[2]) for c, ps in classes.items() for p in ps or [ROOT]]
        for p, x in properties.items():
            range_ = x.get("range")
            # Without a range nothing identifies; a literal range does, unless said otherwise.
            defining = x.get("defining", range_ is not None and range_.startswith("xsd:"))
            rows.append((p, True, x.get("parent"), x.get("domain"), range_, x.get("max_card", 0), defining, x.get("inverse"), x.get("label", p.rpartition(":")[2])))
        return cls(spark.createDataFrame(rows, SCHEMA))

    def classes(self) -> DataFrame:
        return self.table.filter("not is_property").select("uri", "label").distinct()

    def properties(self) -> DataFrame:
        return self.table.filter("is_property").drop("is_property")

    def class_closure(self) -> DataFrame:
        """(sub, sup), reflexive; made from the driver's copy of the hierarchy, which people wrote and terms need there anyway.
        closure() does the same for hierarchies that are data."""
        return self._closure(False)

    def property_closure(self) -> DataFrame:
        return self._closure(True)

    def _closure(self, is_property: bool) -> DataFrame:
        table = self._parents(is_property)
        every = set(table) | {p for ps in table.values() for p in ps if p}
        pairs = [(sub, sup) for sup in every for sub in self._below(sup, is_property)]
        return self.table.sparkSession.createDataFrame(pairs, "sub string, sup string")

    def _below(self, uri: str, is_property: bool) -> list[str]:
        found = [uri]
        table = self._parents(is_property)
        for x in found:
            found += [c for c, ps in table.items() if x in ps and c not in found]
        return found

    def _parents(self, is_property: bool) -> dict[str, set[str]]:
        """The hierarchy as a dict: an ontology is small, and terms are put together on the driver anyway."""
        cached = self.__dict__.setdefault("_dicts", {})
        if is_property not in cached:
            out: dict[str, set[str]] = {}
            for r in self.table.filter(F.col("is_property") == is_property).select("uri", "parent").collect():
                out.setdefault(r["uri"], set()).add(r["parent"])
            cached[is_property] = out
        return cached[is_property]

    def subclasses(self, uri: str) -> list[str]:
        """uri and all that is below it."""
        return self._below(uri, False)

    def subproperties(self, uri: str) -> list[str]:
        return self._below(uri, True)

    def defining(self) -> list[str]:
        """The defining properties, from the driver's copy: a join with them on the constant p of a lifted table would have
        Spark send that table's column whole."""
        cached = self.__dict__.setdefault("_defining", [])
        if not cached:
            cached += sorted(r["uri"] for r in self.properties().filter("defining").select("uri").distinct().collect())
        return cached

    def inverse(self, p: str) -> str | None:
        row = self.properties().filter((F.col("uri") == p) | (F.col("inverse") == p)).select(F.when(F.col("uri") == p, F.col("inverse")).otherwise(F.col("uri")).alias("i")).filter("i is not null").first()
        return row["i"] if row else None

    def find(self, name: str) -> DataFrame:
        """Classes and properties by label or uri, whatever the case."""
        low = name.lower()
        return self.table.filter((F.lower("label") == low) | (F.lower("uri") == low) | F.lower("uri").endswith(f":{low}")).select("uri", "is_property", "label").distinct()

    def replaced(self, rows: DataFrame) -> Ontology:
        """The ontology in which rows take the place of all rows with their uris."""
        return Ontology(self.table.join(rows.select("uri").distinct(), "uri", "left_anti").unionByName(rows))

    def without(self, uris: list[str]) -> Ontology:
        return Ontology(self.table.filter(~F.col("uri").isin(uris)))

    def properties_of(self, cls: str) -> DataFrame:
        """Properties whose domain is the class or one above it, or that have none."""
        above = self.class_closure().filter(F.col("sub") == cls).select(F.col("sup").alias("domain"))
        rows = self.properties().select("uri", "domain", "range").distinct()
        return rows.join(above, "domain", "left_semi").unionByName(rows.filter("domain is null"))
