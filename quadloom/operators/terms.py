"""The query algebra: each term is a DataFrame with the column r (a resource) and the columns that it exposes.

Terms are put together by joins on r: a term that exposes nothing joins as a semi join, so row counts do not grow; unions,
anti joins and left joins are the other connectives. Comparisons look at one typed lane of the object, which filters push
down to. Values of a property are a set: nothing is pivoted, so a resource with several values is kept if one fits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fulltext
from ..functions.values import lane_of
from ..plans.graph import Graph

AGGREGATES = {
    "count": F.count, "distinct_count": F.countDistinct, "max": F.max, "min": F.min, "sum": F.sum, "distinct_sum": F.sum_distinct, "average": F.avg, "distinct_average": lambda c: F.expr(f"avg(distinct `{c}`)"),
}


def exposed(term: DataFrame) -> list[str]:
    return [c for c in term.columns if c != "r"]


# ---- leaves -----------------------------------------------------------------------------------------------------------


def of_type(graph: Graph, *classes: str, inference: bool = True) -> DataFrame:
    """Instances of any of the classes; under inference of what is below them too."""
    names = sorted({n for c in classes for n in (graph.ontology.subclasses(c) if inference else [c])})
    return graph.types().filter(F.col("o").isin(names)).select(F.col("s").alias("r")).distinct()


def resource(graph: Graph, uri: str) -> DataFrame:
    """The resource itself, if it has a type."""
    return graph.typed().filter(F.col("r") == uri)


def _test(op: str, value: object) -> Column:
    lane, literal = lane_of(value)
    column = F.col(lane)
    if op in ("=", "=="):
        return column == F.lit(literal)
    if op == "regexp":
        return F.col("o").rlike(f"(?i){value}")
    if op == ":":
        return fulltext.contains(F.col("o"), str(value))
    tests = {"<": column < F.lit(literal), ">": column > F.lit(literal), "<=": column <= F.lit(literal), ">=": column >= F.lit(literal)}
    if op not in tests:
        raise ValueError(f"no comparator {op!r}")
    return tests[op]


def _var(lane: str, var: str | None) -> list[Column]:
    return [F.col(lane).alias(var)] if var else []


def compare(graph: Graph, p: str | None, op: str = ":", value: object = None, var: str | None = None, inference: bool = True) -> DataFrame:
    """Resources with a value of p (None: of any property) that fits; value None asks for any value. var exposes the value."""
    found = graph.values(p, inference)
    lane = lane_of(value)[0] if value is not None else "o"
    if value is not None:
        if op != "regexp":
            found = found.filter((F.col("o_kind") == "lit") | (F.lit(op) == ":"))
        found = found.filter(_test(op, value))
    return found.select(F.col("s").alias("r"), *_var("o" if op in (":", "regexp") else lane, var)).distinct()


def has(graph: Graph, p: str | None, var: str | None = None, lane: str = "o") -> DataFrame:
    """Resources with any value of p."""
    return graph.values(p).select(F.col("s").alias("r"), *_var(lane, var)).distinct()


def is_related(graph: Graph, p: str, uri: str) -> DataFrame:
    return graph.values(p).filter((F.col("o_kind") == "uri") & (F.col("o") == uri)).select(F.col("s").alias("r")).distinct()


def related(graph: Graph, p: str | None, term: DataFrame, inverted: bool = False, var: str | None = None, both_ways: bool = False) -> DataFrame:
    """Resources that p leads from (inverted: to) to a resource of term. both_ways adds p's declared inverse.

    The term's exposed columns go along."""
    edges = graph.values(p).filter("o_kind = 'uri'").select(F.col("s").alias("from"), F.col("o").alias("to"))
    if both_ways and p and (other := graph.ontology.inverse(p)):
        edges = edges.unionByName(graph.values(other).filter("o_kind = 'uri'").select(F.col("o").alias("from"), F.col("s").alias("to")))
    here, there = ("to", "from") if inverted else ("from", "to")
    inner = term.withColumnRenamed("r", "there")
    kept = exposed(term)
    how = "inner" if kept else "left_semi"
    joined = edges.join(inner, F.col(there) == F.col("there"), how)
    return joined.select(F.col(here).alias("r"), *([F.col(there).alias(var)] if var else []), *kept).distinct()


def literal(graph: Graph, text: str) -> DataFrame:
    """Full text over any property of a resource or, one step on, of what it is related to."""
    hits = graph.values(None).filter(F.col("o_kind") == "lit").filter(fulltext.contains(F.col("o"), text)).select(F.col("s").alias("r")).distinct()
    return any_of(hits, related(graph, None, hits))


def related_literal(graph: Graph, p: str, text: str, op: str = ":") -> DataFrame:
    """Resources that p leads to one with any property that contains (=: equals) the text."""
    if op not in (":", "="):
        raise ValueError("a related resource has no order")
    test = fulltext.contains(F.col("o"), text) if op == ":" else F.col("o") == text
    hits = graph.values(None).filter("o_kind = 'lit'").filter(test).select(F.col("s").alias("r")).distinct()
    return related(graph, p, hits)


def within(graph: Graph, p: str, low: object = None, high: object = None) -> DataFrame:
    """Values strictly between low and high, either of which may be open."""
    found = graph.values(p)
    if low is not None:
        found = found.filter(_test(">", low))
    if high is not None:
        found = found.filter(_test("<", high))
    return found.select(F.col("s").alias("r")).distinct()


# ---- connectives ------------------------------------------------------------------------------------------------------


def all_of(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Conjunction. Terms that expose columns join, the others only filter."""
    with_columns = [t for t in (first, *others) if exposed(t)]
    without = [t for t in (first, *others) if not exposed(t)]
    base, rest = (with_columns[0], with_columns[1:]) if with_columns else (without.pop(0), [])
    found = reduce(lambda a, b: a.join(b, ["r", *[c for c in exposed(b) if c in a.columns]]), rest, base)
    return reduce(lambda a, b: a.join(b, "r", "left_semi"), without, found)


def any_of(first: DataFrame, *others: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), others, first).distinct()


def but_not(base: DataFrame, term: DataFrame) -> DataFrame:
    """Resources of base for which term does not hold."""
    return base.join(term.select("r").distinct(), "r", "left_anti")


def negation(graph: Graph, term: DataFrame) -> DataFrame:
    """Standing alone, a negation is about all resources that have a type."""
    return but_not(graph.typed(), term)


def not_matching(graph: Graph, p: str, pattern: str) -> DataFrame:
    """Resources with some value of p that the pattern does not match: not the negation of having one that it matches."""
    return graph.values(p).filter(~F.col("o").rlike(f"(?i){pattern}")).select(F.col("s").alias("r")).distinct()


def optionally(base: DataFrame, term: DataFrame) -> DataFrame:
    return base.join(term, ["r", *[c for c in exposed(term) if c in base.columns]], "left")


def aggregated(term: DataFrame, var: str, function: str, name: str | None = None) -> DataFrame:
    """One row for each resource and the other exposed columns, with an aggregate of var."""
    others = [c for c in exposed(term) if c != var]
    return term.groupBy("r", *others).agg(AGGREGATES[function](var).alias(name or f"{function}_{var}"))


def aggregate_values(graph: Graph, p: str, function: str, name: str, lane: str = "o_num", over: DataFrame | None = None) -> DataFrame:
    """(r, name) over all values of p, one for each statement; over restricts the resources."""
    found = graph.values(p).select(F.col("s").alias("r"), F.col(lane).alias("__v"))
    if over is not None:
        found = found.join(over.select("r").distinct(), "r", "left_semi")
    return found.groupBy("r").agg(AGGREGATES[function]("__v").alias(name))
