"""Queries: a term with result domain, request properties, order, limit, and the count and ask forms."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fulltext
from ..plans.graph import MODIFIED, PREFIX, URL, Graph
from . import terms


@dataclass
class Request:
    """A property to show; optional ones do not drop resources without it."""

    p: str
    optional: bool = True
    lane: str = "o"


@dataclass
class Order:
    """A sort key: heavier ones first; of equal weights the one added later goes first."""

    column: str
    weight: int = 1
    descending: bool = False


@dataclass
class Query:
    graph: Graph
    term: DataFrame
    requests: list[Request] = field(default_factory=list)
    orders: list[Order] = field(default_factory=list)
    limit: int = 0
    offset: int = 0
    #: (property, text): adds a score and an excerpt of the property's value.
    scored: tuple[str, str] | None = None

    def _rows(self, requests: list[Request]) -> DataFrame:
        rows = self.term.filter(F.col("r").startswith(PREFIX))
        for i, request in enumerate(self.requests, 1):
            if request in requests:
                values = self.graph.values(request.p).select(F.col("s").alias("r"), F.col(request.lane).alias(f"reqProp{i}"))
                rows = rows.join(values, "r", "left" if request.optional else "inner")
        return rows.distinct()

    def _cut(self, rows: DataFrame) -> DataFrame:
        rows = rows.offset(self.offset) if self.offset else rows
        return rows.limit(self.limit) if self.limit else rows

    def results(self) -> DataFrame:
        """r, the exposed columns, reqProp1.., in order. Ties are broken by r, so that a limit is well defined."""
        rows = self._rows(self.requests)
        if self.scored:
            p, text = self.scored
            values = self.graph.values(p).select(F.col("s").alias("r"), fulltext.score(F.col("o"), text).alias("score"), fulltext.excerpt(F.col("o"), text).alias("excerpt"))
            rows = rows.join(values.groupBy("r").agg(F.max("score").alias("score"), F.max_by("excerpt", "score").alias("excerpt")), "r")
        keys = sorted(reversed(self.orders), key=lambda o: -o.weight)
        columns = [F.desc(o.column) if o.descending else F.asc(o.column) for o in keys] + ([F.desc("score")] if self.scored else [])
        if columns or self.limit or self.offset:
            rows = rows.orderBy(*columns, "r")
        return self._cut(rows)

    def count(self) -> DataFrame:
        """n: distinct resources, or distinct rows where the term exposes columns. Optional requests play no part."""
        rows = self._rows([q for q in self.requests if not q.optional])
        columns = ["r", *[c for c in rows.columns if c != "r" and not c.startswith("reqProp")]]
        return self._cut(rows.select(*columns).distinct().agg(F.count("*").alias("n")))

    def ask(self) -> DataFrame:
        """found: whether there is any result. One row of one partition that has one is enough."""
        rows = self._rows([q for q in self.requests if not q.optional])
        return rows.limit(1).agg((F.count("*") > 0).alias("found"))


# ---- files ------------------------------------------------------------------------------------------------------------


def in_folder(graph: Graph, folder: str, recursive: bool = True, p: str = URL) -> DataFrame:
    """Resources whose url lies in a folder, taken literally (no pattern)."""
    prefix = folder.rstrip("/") + "/"
    found = graph.values(p).filter(F.col("o").startswith(prefix))
    if not recursive:
        found = found.filter(~F.substring(F.col("o"), len(prefix) + 1, 1 << 30).contains("/"))
    return found.select(F.col("s").alias("r")).distinct()


def file_query(graph: Graph, term: DataFrame | None = None, include: list[tuple[str, bool]] = (), exclude: list[str] = (), files: str = "InformationElement", folders: str | None = None) -> DataFrame:
    """Files (of a class, without those of the folder class) in any of the included and none of the excluded folders."""
    found = terms.of_type(graph, files)
    if folders:
        found = terms.but_not(found, terms.of_type(graph, folders))
    if term is not None:
        found = terms.all_of(term, found)
    if include:
        found = terms.all_of(found, terms.any_of(*[in_folder(graph, f, deep) for f, deep in include]))
    for folder in exclude:  # a file with some url outside is kept, as with every negated pattern
        outside = graph.values(URL).filter(~F.col("o").startswith(folder.rstrip("/") + "/")).select(F.col("s").alias("r")).distinct()
        found = terms.all_of(found, outside)
    return found


# ---- canned queries -----------------------------------------------------------------------------------------------------


def last_modified(graph: Graph, k: int, cls: str, p: str = MODIFIED) -> DataFrame:
    """The k instances with the latest p."""
    rows = terms.all_of(terms.has(graph, p, var="modified", lane="o_ts"), terms.of_type(graph, cls))
    return Query(graph, rows, orders=[Order("modified", descending=True)], limit=k).results()


def most_important(graph: Graph, k: int, p: str, cls: str | None = None) -> DataFrame:
    rows = terms.has(graph, p, var="score", lane="o_num")
    rows = terms.all_of(rows, terms.of_type(graph, cls)) if cls else rows
    return Query(graph, rows, orders=[Order("score", descending=True)], limit=k).results()


def never_opened(graph: Graph, cls: str, usage: str) -> DataFrame:
    """Instances whose usage count is 0, or that have none."""
    known = terms.of_type(graph, cls)
    return terms.any_of(terms.all_of(known, terms.compare(graph, usage, "=", 0)), terms.but_not(known, terms.has(graph, usage)))


def in_date_range(graph: Graph, start: object, end: object, dates: list[str] = (), usage: tuple[str, str] | None = None) -> DataFrame:
    """Resources with one of the dates strictly between start and end, or used by an event in between.

    usage: an event's property that leads to the resource, and the event's date."""
    found = [terms.within(graph, p, start, end) for p in dates]
    if usage:
        involves, when = usage
        found.append(terms.related(graph, involves, terms.within(graph, when, start, end), inverted=True))
    return terms.any_of(*found)


def downloads_of(graph: Graph, cls: str, involves: str, uri: str) -> DataFrame:
    """The events of a class that involve a resource."""
    return terms.all_of(terms.of_type(graph, cls), terms.is_related(graph, involves, uri))
