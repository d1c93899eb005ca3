"""The graph: quads by property, and the lift of relational tables.

A graph gives the values of a property as a DataFrame with columns s, the lanes of the object, and g. Lifted properties are
projections of their table: a pattern reads the key and one column of Parquet, and filters reach the scan. Stored quads are
partitioned by property, so a pattern reads that partition."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import LANES, QUAD, lanes
from .ontology import Ontology

PREFIX = "res:/"
TYPE, URL, NAME, CREATED, MODIFIED = "rdf:type", "nie:url", "nfo:fileName", "nao:created", "nao:lastModified"
COLUMNS = ["s", *LANES, "g"]


@dataclass
class Graph:
    ontology: Ontology
    #: The DataFrames (COLUMNS) that a property's values come from.
    patterns: dict[str, list[Callable[[], DataFrame]]] = field(default_factory=dict)

    @classmethod
    def of_quads(cls, quads: DataFrame, ontology: Ontology) -> Graph:
        stored = StoredGraph(ontology)
        stored.quads_ = quads
        return stored

    def spark(self) -> SparkSession:
        return self.ontology.table.sparkSession

    def values(self, p: str | None, inference: bool = True) -> DataFrame:
        """Values of p, or of every property; under inference those of its subproperties too."""
        if p is None:
            return self.quads().drop("p")
        names = self.ontology.subproperties(p) if inference else [p]
        found = [f() for n in names for f in self.patterns.get(n, [])]
        if not found:
            return self.spark().createDataFrame([], QUAD).select(*COLUMNS)
        return reduce(DataFrame.unionByName, found)

    def quads(self) -> DataFrame:
        found = [f().withColumn("p", F.lit(p)) for p, fs in self.patterns.items() for f in fs]
        return reduce(DataFrame.unionByName, found).select("s", "p", *LANES, "g")

    def types(self) -> DataFrame:
        return self.values(TYPE, inference=False)

    def typed(self) -> DataFrame:
        """r: every resource that has a type."""
        return self.types().select(F.col("s").alias("r")).distinct()


class StoredGraph(Graph):
    quads_: DataFrame

    def values(self, p: str | None, inference: bool = True) -> DataFrame:
        if p is None:
            return self.quads_.drop("p")
        names = self.ontology.subproperties(p) if inference else [p]
        return self.quads_.filter(F.col("p").isin(names)).select(*COLUMNS)

    def quads(self) -> DataFrame:
        return self.quads_


# The lift. Table -> class, key, literal properties (column: datatype), resource properties (property: column, table).
TABLES = {
    "region": ("Region", "r_regionkey", {"r_name": "xsd:string"}, {}),
    "nation": ("Nation", "n_nationkey", {"n_name": "xsd:string"}, {"region": ("n_regionkey", "region")}),
    "customer": ("Customer", "c_custkey", {"c_name": "xsd:string", "c_acctbal": "xsd:double", "c_mktsegment": "xsd:string"}, {"nation": ("c_nationkey", "nation")}),
    "supplier": ("Supplier", "s_suppkey", {"s_name": "xsd:string", "s_acctbal": "xsd:double"}, {"nation": ("s_nationkey", "nation")}),
    "part": ("Part", "p_partkey", {"p_name": "xsd:string", "p_brand": "xsd:string", "p_type": "xsd:string", "p_size": "xsd:int", "p_retailprice": "xsd:double"}, {}),
    "orders": ("Order", "o_orderkey", {"o_orderstatus": "xsd:string", "o_totalprice": "xsd:double", "o_orderdate": "xsd:dateTime", "o_orderpriority": "xsd:string"}, {"customer": ("o_custkey", "customer")}),
    "lineitem": (
        "LineItem", None,
        {"l_quantity": "xsd:double", "l_extendedprice": "xsd:double", "l_discount": "xsd:double", "l_tax": "xsd:double", "l_returnflag": "xsd:string", "l_linestatus": "xsd:string", "l_shipdate": "xsd:dateTime"},
        {"order": ("l_orderkey", "orders"), "partOf": ("l_partkey", "part"), "suppliedBy": ("l_suppkey", "supplier")},
    ),
    "events": ("Event", "event_id", {"ts": "xsd:dateTime", "value": "xsd:double", "event_type": "xsd:string"}, {"user": ("user_id", "customer")}),
    "documents": ("Document", "doc_id", {"text": "xsd:string", "lang": "xsd:string", "source": "xsd:string", "n_chars": "xsd:long"}, {}),
    "pages": ("Page", "page_id", {"url": "nie:url", "html": "xsd:string"}, {}),
    "conversations": ("Turn", None, {"role": "xsd:string", "text": "xsd:string"}, {}),
}
#: Column -> property, where they differ from the column's name without the table's letter.
PROPERTY = {"ts": "start", "text": "text", "lang": "lang", "source": "source", "n_chars": "charCount", "url": URL, "html": "html", "role": "role", "value": "value", "event_type": "eventType"}
CLASSES = {
    "Region": ["Place"], "Nation": ["Place"], "Customer": ["Party"], "Supplier": ["Party"], "Part": [], "Order": [], "LineItem": [], "Event": [], "ClickEvent": ["Event"], "ViewEvent": ["Event"],
    "SignupEvent": ["Event"], "PurchaseEvent": ["Event"], "ErrorEvent": ["Event"], "Document": ["InformationElement"], "Page": ["InformationElement"], "Turn": ["InformationElement"], "Place": [], "Party": [],
    "InformationElement": [],
}
INVERSES = {"customer": "orderedBy"}


def property_of(column: str) -> str:
    return PROPERTY.get(column) or column.partition("_")[2]


def key_of(table: str, df: DataFrame) -> Column:
    """The uri of a row. Rows without a key column are known by two hashes of the whole row, 128 bits."""
    key = TABLES[table][1]
    whole = [F.hex(F.xxhash64(F.lit(seed), *df.columns)) for seed in (1, 2)]
    return F.concat(F.lit(f"{PREFIX}{table}/"), *([F.col(key).cast("string")] if key else whole))


def demo_ontology(spark: SparkSession) -> Ontology:
    properties: dict[str, dict] = {TYPE: {"range": "rdfs:Class", "defining": True}}
    for cls, _, literals, resources in TABLES.values():
        for column, datatype in literals.items():
            properties.setdefault(property_of(column), {"range": datatype, "max_card": 1})
        for p, (_, to) in resources.items():
            properties.setdefault(p, {"range": TABLES[to][0], "max_card": 1, "domain": cls if p not in ("nation",) else None, "inverse": INVERSES.get(p)})
    return Ontology.of(spark, CLASSES, properties)


def lift(spark: SparkSession, sf_dir: str, tables: list[str] | None = None) -> Graph:
    """The driver's tables as a graph. Each table is a graph of its own, named after it."""
    graph = Graph(demo_ontology(spark))

    def pattern(table: str, make: Callable[[DataFrame], list[Column]]) -> Callable[[], DataFrame]:
        def read() -> DataFrame:
            df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
            return df.select(key_of(table, df).alias("s"), *make(df), F.lit(f"graph:/{table}").alias("g"))

        return read

    for table in tables or TABLES:
        cls, _, literals, resources = TABLES[table]
        if table == "events":
            event_class = lambda df: F.concat(F.initcap("event_type"), F.lit("Event"))
            graph.patterns.setdefault(TYPE, []).append(pattern(table, lambda df: lanes(event_class(df), "uri", None)))
        else:
            graph.patterns.setdefault(TYPE, []).append(pattern(table, lambda df, c=cls: lanes(F.lit(c), "uri", None)))
        for column, datatype in literals.items():
            graph.patterns.setdefault(property_of(column), []).append(pattern(table, lambda df, c=column, d=datatype: lanes(F.col(c), "uri" if d == "nie:url" else "lit", d)))
        for p, (column, to) in resources.items():
            graph.patterns.setdefault(p, []).append(pattern(table, lambda df, c=column, t=to: lanes(F.concat(F.lit(f"{PREFIX}{t}/"), F.col(c).cast("string")), "uri", None)))
    return graph
