"""Graph files: N-Triples and N-Quads in and out, TriG and Turtle files of modest size in, backup and restore.

The line formats are read as text and taken apart by built-in expressions, so a directory of any size is one scan. TriG and
RDF/XML are formats of ontology files: one file is one task's work, by a small reader."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ElementTree
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import parsed_lanes
from ..operators.describe import anonymized
from ..plans.graph import PREFIX, TYPE
from ..plans.ontology import Ontology

#: A line of N-Quads: subject, predicate, uri or blank object, or literal with language or datatype, graph.
LINE = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(?:(<[^>]*>|_:[^\s.]+)|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?)\s*(?:(<[^>]*>|_:[^\s.]+)\s*)?\.\s*(?:#.*)?$'
XSD = "http://www.w3.org/2001/XMLSchema#"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
BARE = ["s", "p", "o", "o_kind", "dt", "lang", "g"]


def _term(column: Column) -> Column:
    return F.when(column.startswith("<"), F.substring(column, 2, 1 << 30).substr(F.lit(1), F.length(column) - 2)).otherwise(column)


def _unescaped(column: Column) -> Column:
    out = F.replace(column, F.lit(r"\\"), F.lit("\x00"))
    for escape, char in ((r"\"", '"'), (r"\n", "\n"), (r"\r", "\r"), (r"\t", "\t")):
        out = F.replace(out, F.lit(escape), F.lit(char))
    return F.replace(out, F.lit("\x00"), F.lit("\\"))


def _escaped(column: Column) -> Column:
    out = F.replace(column, F.lit("\\"), F.lit(r"\\"))
    for char, escape in (('"', r"\""), ("\n", r"\n"), ("\r", r"\r"), ("\t", r"\t")):
        out = F.replace(out, F.lit(char), F.lit(escape))
    return out


def with_lanes(rows: DataFrame) -> DataFrame:
    """Quads of rows with BARE columns; uris of well-known datatypes and types get their short names."""
    short = rows.withColumn("dt", F.regexp_replace("dt", f"^{re.escape(XSD)}", "xsd:")).withColumn("p", F.when(F.col("p") == RDF_TYPE, F.lit(TYPE)).otherwise(F.col("p")))
    lanes = parsed_lanes()
    return short.select("s", "p", "o", "o_kind", "dt", "lang", *[lanes[n].alias(n) for n in ("o_num", "o_long", "o_ts", "o_bool")], "g")


def read_nquads(spark: SparkSession, path: str, graph: str | None = None) -> DataFrame:
    """Quads of N-Triples or N-Quads files; lines without a graph get the given one. Other lines count as comments."""
    line = spark.read.text(path).filter(F.col("value").rlike(LINE))
    part = lambda i: F.nullif(F.regexp_extract("value", LINE, i), F.lit(""))
    literal = part(3).isNull()
    rows = line.select(
        _term(part(1)).alias("s"), part(2).alias("p"), F.when(literal, _unescaped(F.regexp_extract("value", LINE, 4))).otherwise(_term(part(3))).alias("o"),
        F.when(literal, "lit").when(part(3).startswith("_:"), "bnode").otherwise("uri").alias("o_kind"), F.when(literal, F.coalesce(part(6), F.lit(f"{XSD}string"))).alias("dt"), part(5).alias("lang"),
        F.coalesce(_term(part(7)), F.lit(graph)).alias("g"),
    )
    return with_lanes(rows)


def nquad_lines(quads: DataFrame) -> DataFrame:
    """value: a line of N-Quads for each quad."""
    term = lambda c: F.when(F.col(c).startswith("_:"), F.col(c)).otherwise(F.concat(F.lit("<"), F.col(c), F.lit(">")))
    p = F.when(F.col("p") == TYPE, F.lit(RDF_TYPE)).otherwise(F.col("p"))
    datatype = F.when(F.col("lang").isNotNull(), F.concat(F.lit("@"), F.col("lang"))).otherwise(F.concat(F.lit("^^<"), F.regexp_replace(F.coalesce("dt", F.lit("xsd:string")), "^xsd:", XSD), F.lit(">")))
    o = F.when(F.col("o_kind") == "lit", F.concat(F.lit('"'), _escaped(F.col("o")), F.lit('"'), datatype)).otherwise(term("o"))
    return quads.select(F.concat_ws(" ", term("s"), F.concat(F.lit("<"), p, F.lit(">")), o, term("g"), F.lit(".")).alias("value"))


def write_nquads(quads: DataFrame, path: str, anonymous: bool = False) -> None:
    nquad_lines(anonymized(quads, PREFIX) if anonymous else quads).write.mode("overwrite").text(path)


TOKEN = re.compile(r"""<([^>]*)>|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z-]+)|\^\^(?:<([^>]*)>|([\w-]*:[\w.-]*)))?|(@prefix)|([\w-]*:[\w./-]*)|(_:\w+)|([{};,.\[\]])|(\ba\b)|([+-]?\d[\d.]*)|(true|false)|#[^\n]*""")


def trig_rows(text: str) -> list[tuple]:
    """(s, p, o, o_kind, dt, lang, g) of a TriG or Turtle text without collections and nested blank nodes."""
    prefixes: dict[str, str] = {}
    rows, stack, graph, waiting = [], [], None, []
    tokens = [m for m in TOKEN.finditer(text) if m.lastindex]

    def uri(m: re.Match) -> tuple | None:
        if m[1] is not None:
            return m[1], "uri", None, None
        if m[7] is not None:
            name, _, local = m[7].rstrip(".").partition(":")
            return prefixes.get(name, f"{name}:") + local, "uri", None, None
        if m[8] is not None:
            return m[8], "bnode", None, None
        if m[10] is not None:
            return RDF_TYPE, "uri", None, None
        if m[2] is not None:
            full = m[4] if m[4] is not None else (prefixes.get(m[5].partition(":")[0], "") + m[5].partition(":")[2] if m[5] else f"{XSD}string")
            return re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t", "r": "\r"}.get(x[1], x[1]), m[2]), "lit", full, m[3]
        if m[11] is not None:
            return m[11].rstrip("."), "lit", f"{XSD}{'double' if '.' in m[11].rstrip('.') else 'integer'}", None
        return (m[12], "lit", f"{XSD}boolean", None) if m[12] else None

    i = 0
    while i < len(tokens):
        m = tokens[i]
        if m[6]:
            prefixes[tokens[i + 1][7].partition(":")[0]] = tokens[i + 2][1]
            i += 4
            continue
        mark = m[9]
        if mark == "{":
            graph, waiting = (waiting[0][0] if waiting else None), []
        elif mark in (".", "}", ";", ","):
            if len(stack) == 2 and waiting:
                o = waiting[0]
                rows.append((stack[0], stack[1], *o, graph))
            waiting = []
            stack = {",": stack, ";": stack[:1]}.get(mark, [])
            graph = None if mark == "}" else graph
        elif term := uri(m):
            following = tokens[i + 1][9] if i + 1 < len(tokens) else None
            if len(stack) < 2 and following != "{":
                stack.append(term[0])
            else:
                waiting = [term]
        i += 1
    return rows


def rdfxml_rows(text: str) -> list[tuple]:
    """As trig_rows, of RDF/XML with descriptions of one level."""
    rdf, rows = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}", []
    name = lambda tag: tag[1:].replace("}", "")
    for n, node in enumerate(ElementTree.fromstring(text)):
        s = node.get(f"{rdf}about") or f"_:{node.get(f'{rdf}nodeID') or n}"
        if node.tag != f"{rdf}Description":
            rows.append((s, RDF_TYPE, name(node.tag), "uri", None, None, None))
        for child in node:
            if (to := child.get(f"{rdf}resource")) is not None:
                rows.append((s, name(child.tag), to, "uri", None, None, None))
            elif (to := child.get(f"{rdf}nodeID")) is not None:
                rows.append((s, name(child.tag), f"_:{to}", "bnode", None, None, None))
            else:
                rows.append((s, name(child.tag), child.text or "", "lit", child.get(f"{rdf}datatype") or f"{XSD}string", child.get("{http://www.w3.org/XML/1998/namespace}lang"), None))
    return rows


READERS = {"trig": trig_rows, "ttl": trig_rows, "n3": trig_rows, "xml": rdfxml_rows, "rdf": rdfxml_rows}


def read_documents(spark: SparkSession, path: str, kind: str, graph: str) -> DataFrame:
    """Quads of whole-file formats (READERS); blank nodes are told apart by their file."""
    reader = READERS[kind]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                found = pd.DataFrame(reader(bytes(content).decode("utf-8")), columns=BARE, dtype=object)
                yield found.assign(g=found["g"].fillna(graph), file=file)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    read = files.mapInPandas(rows, ", ".join(f"{c} string" for c in [*BARE, "file"]))
    own = lambda c: F.when(F.col(c).startswith("_:"), F.concat(F.col(c), F.lit("_"), F.substring(F.sha2("file", 256), 1, 8))).otherwise(F.col(c))
    return with_lanes(read.withColumn("s", own("s")).withColumn("o", own("o")))


def load_ontology(quads: DataFrame) -> Ontology:
    """The ontology that quads state by rdfs:subClassOf, subPropertyOf, domain, range, label and nrl:maxCardinality."""
    rdfs = "http://www.w3.org/2000/01/rdf-schema#"
    local = F.regexp_extract("p", r"([^#/:]+)$", 1)
    wanted = {"subClassOf": "class_parent", "subPropertyOf": "property_parent", "domain": "domain", "range": "range", "label": "label", "maxCardinality": "max_card", "cardinality": "card", "inverseProperty": "inverse"}
    facts = quads.select("s", local.alias("k"), "o").filter(F.col("k").isin(*wanted))
    wide = facts.groupBy("s").pivot("k", list(wanted)).agg(F.collect_set("o"))
    kinds = quads.filter(F.col("p") == TYPE).groupBy("s").agg(F.bool_or(F.col("o").endswith("Property")).alias("is_property"), F.bool_or(F.col("o").endswith("Class")).alias("is_class"))
    rows = kinds.filter("is_property or is_class").join(wide, "s", "left")
    parents = F.coalesce(F.when(F.col("is_property"), F.col("subPropertyOf")).otherwise(F.col("subClassOf")), F.array().cast("array<string>"))
    default = F.when(F.col("is_property"), F.lit(None).cast("string")).otherwise(F.lit("rdfs:Resource"))
    rows = rows.withColumn("parent", F.explode(F.when(F.size(parents) > 0, parents).otherwise(F.array(default))))
    one = lambda c: F.regexp_replace(F.get(F.col(c), F.lit(0)), f"^{re.escape(XSD)}", "xsd:")
    most = F.greatest(F.coalesce(F.get(F.col("maxCardinality"), F.lit(0)).try_cast("int"), F.lit(0)), F.coalesce(F.get(F.col("cardinality"), F.lit(0)).try_cast("int"), F.lit(0)))
    return Ontology(rows.select(F.col("s").alias("uri"), "is_property", F.regexp_replace("parent", f"^{rdfs}", "rdfs:").alias("parent"), one("domain").alias("domain"), one("range").alias("range"), most.alias("max_card"),
                                F.coalesce(one("range").startswith("xsd:"), F.lit(False)).alias("defining"), one("inverseProperty").alias("inverse"), one("label").alias("label")))


def save(quads: DataFrame, path: str) -> None:
    """The stored form: Parquet, a directory a property. Properties of many statements are split among tasks by size."""
    quads.hint("rebalance", F.col("p")).write.mode("overwrite").partitionBy("p").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    from ..functions.values import QUAD

    return spark.read.schema(QUAD).parquet(path).select(*[c.split()[0] for c in QUAD.split(", ")])


def backup(quads: DataFrame, path: str, only: DataFrame | None = None) -> None:
    """N-Quads of everything that isn't ontology or discardable; only restricts the resources (tagged or rated ones, say)."""
    rows = quads.filter(~F.col("g").startswith("graph:/ontology/") & ~F.col("g").startswith("graph:/discardable/"))
    write_nquads(rows.join(only.select("s").distinct(), "s", "left_semi") if only is not None else rows, path)


def restore(spark: SparkSession, path: str) -> DataFrame:
    return read_nquads(spark, path)
