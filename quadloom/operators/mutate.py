"""Changes to a stored graph: each takes the quads and gives the new quads and the change feed, both DataFrames.

Checks come first: violations are counted by semi joins and aggregates, and nothing is changed if there are any. Quads are a
set; statements are removed by anti joins and added by unions without what is there already. A change is a row (s, p, o,
added). Metadata (created, lastModified) is in a graph of its own and does not make a resource exist."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import coerced, parsed_lanes
from ..plans.graph import CREATED, MODIFIED, PREFIX, TYPE, URL
from ..plans.ontology import ROOT, Ontology
from ..session import cut_lineage

META = [CREATED, MODIFIED, "nao:creator", "nao:userVisible"]
META_GRAPH = "graph:/meta"
SUBRESOURCE = "nao:hasSubResource"
KEYS = ["s", "p", "o", "o_kind", "g"]


class Violation(ValueError):
    """The change would break the ontology; nothing was changed."""


@dataclass
class Changed:
    quads: DataFrame
    #: s, p, o, added
    changes: DataFrame


def settled(quads: DataFrame, changes: DataFrame) -> Changed:
    """A change as a snapshot: both parts are computed and kept, so that a chain of changes does not plan all of them again."""
    return Changed(cut_lineage(quads), cut_lineage(changes))


def graph_of(app: str, discardable: bool = False) -> str:
    """The one graph of an application (for data that can be made again: another one)."""
    if not app:
        raise Violation("an application must be named")
    return f"graph:/{'discardable/' if discardable else ''}{app}"


def complete(rows: DataFrame, g: str) -> DataFrame:
    """Quads of rows (s, p, o, o_kind, dt): lanes parsed, in graph g."""
    return rows.select("s", "p", "o", "o_kind", "dt", F.lit(None).cast("string").alias("lang"), *[c.alias(n) for n, c in parsed_lanes().items()], F.lit(g).alias("g"))


def _none_of(rows: DataFrame, what: str) -> None:
    if found := rows.limit(3).collect():
        raise Violation(f"{what}: {', '.join(str(tuple(r)) for r in found)}")


def checked(rows: DataFrame, ontology: Ontology, protect: bool = True) -> DataFrame:
    """rows (s, p, o) with o_kind and dt by the property's range; raises on unknown or protected properties and values that don't fit."""
    known = ontology.properties().groupBy(F.col("uri").alias("p")).agg(F.first("range", True).alias("range"), F.max("max_card").alias("max_card"))
    joined = rows.join(known, "p", "left")
    _none_of(joined.filter("s is null or s = '' or p is null or o is null"), "empty terms")
    if protect:
        _none_of(joined.filter(F.col("p").isin(META)).select("p"), "protected properties")
    _none_of(joined.filter((F.col("max_card").isNull()) & ~F.col("p").isin(TYPE, *META, SUBRESOURCE)).select("p"), "unknown properties")
    _none_of(joined.filter(F.col("max_card").isNotNull() & F.col("range").isNull() & (F.col("p") != TYPE)).select("p"), "properties without a range")
    literal = F.coalesce(F.col("range").startswith("xsd:"), F.col("p").isin(CREATED, MODIFIED))
    fitted = joined.withColumn("o2", coerced("o", "range"))
    _none_of(fitted.filter(literal & F.col("o2").isNull()).select("s", "p", "o"), "values that don't fit the range")
    kind = F.when(literal, F.lit("lit")).otherwise(F.when(F.col("o").startswith("_:"), F.lit("bnode")).otherwise(F.lit("uri")))
    datatype = F.when(literal, F.coalesce("range", F.lit("xsd:dateTime")))
    return fitted.select("s", "p", F.coalesce("o2", "o").alias("o"), kind.alias("o_kind"), datatype.alias("dt"), F.coalesce("max_card", F.lit(0)).alias("max_card"))


def check_cardinality(quads: DataFrame, rows: DataFrame) -> None:
    """rows: from checked(). No resource may get more distinct values than the property allows, with those it has."""
    limited = rows.filter("max_card > 0").select("s", "p", "o", "max_card")
    old = quads.join(limited.select("s", "p", "max_card").distinct(), ["s", "p"]).select("s", "p", "o", "max_card")
    every = limited.unionByName(old).groupBy("s", "p", "max_card").agg(F.countDistinct("o").alias("n"))
    _none_of(every.filter("n > max_card").select("s", "p", "n"), "too many values")


def add(quads: DataFrame, rows: DataFrame) -> Changed:
    new = rows.dropDuplicates(KEYS).join(quads.select(*KEYS), KEYS, "left_anti")
    return Changed(quads.unionByName(new), new.select("s", "p", "o", F.lit(True).alias("added")))


def remove(quads: DataFrame, rows: DataFrame, keys: list[str]) -> Changed:
    """Drop the quads that agree with rows in keys."""
    some = rows.select(*keys).distinct()
    gone = quads.join(some, keys, "left_semi")
    return Changed(quads.join(some, keys, "left_anti"), gone.select("s", "p", "o", F.lit(False).alias("added")))


def touched(quads: DataFrame, resources: DataFrame, now: str) -> DataFrame:
    """quads in which lastModified of resources (s) is now; resources without data get none."""
    live = resources.select("s").distinct().join(existing(quads), "s", "left_semi")
    rest = quads.join(live.withColumn("p", F.lit(MODIFIED)), ["s", "p"], "left_anti")
    stamp = live.select("s", F.lit(MODIFIED).alias("p"), F.lit(now).alias("o"), F.lit("lit").alias("o_kind"), F.lit("xsd:dateTime").alias("dt"))
    return rest.unionByName(complete(stamp, META_GRAPH))


def existing(quads: DataFrame, g: str | None = None) -> DataFrame:
    """s of the resources that have something besides metadata."""
    rows = quads.filter(~F.col("p").isin(META))
    return (rows.filter(F.col("g") == g) if g else rows).select("s").distinct()


def swept(quads: DataFrame, resources: DataFrame) -> DataFrame:
    """quads without the metadata of those resources that have nothing else."""
    bare = resources.select("s").distinct().join(existing(quads), "s", "left_anti")
    return quads.join(bare, "s", "left_anti")


def add_property(quads: DataFrame, ontology: Ontology, rows: DataFrame, app: str, now: str) -> Changed:
    """rows: (s, p, o)."""
    fitted = checked(rows, ontology)
    check_cardinality(quads, fitted)
    done = add(quads, complete(fitted, graph_of(app)))
    return settled(touched(done.quads, done.changes, now), done.changes)


def set_property(quads: DataFrame, ontology: Ontology, rows: DataFrame, app: str, now: str) -> Changed:
    """The values of rows take the place of all values of the same (s, p); the feed has what really changed."""
    fitted = checked(rows, ontology)
    check_cardinality(quads.limit(0), fitted)
    new = complete(fitted, graph_of(app))
    pairs = rows.select("s", "p").distinct()
    gone = quads.join(pairs, ["s", "p"], "left_semi").join(new.select("s", "p", "o", "o_kind"), ["s", "p", "o", "o_kind"], "left_anti")
    kept = remove(quads, gone, ["s", "p", "o", "o_kind"])
    fresh = new.dropDuplicates(KEYS).join(quads.select("s", "p", "o", "o_kind").distinct(), ["s", "p", "o", "o_kind"], "left_anti")
    changes = kept.changes.unionByName(fresh.select("s", "p", "o", F.lit(True).alias("added")))
    return settled(touched(kept.quads.unionByName(fresh), changes, now), changes)


def remove_property(quads: DataFrame, rows: DataFrame, now: str) -> Changed:
    """rows: (s, p, o). Resources of which only metadata is left go altogether."""
    done = remove(quads, rows.filter(~F.col("p").isin(META)), ["s", "p", "o"])
    return settled(swept(touched(done.quads, done.changes, now), done.changes), done.changes)


def remove_properties(quads: DataFrame, rows: DataFrame, now: str) -> Changed:
    """rows: (s, p)."""
    done = remove(quads, rows.filter(~F.col("p").isin(META)), ["s", "p"])
    return settled(swept(touched(done.quads, done.changes, now), done.changes), done.changes)


def create_resources(quads: DataFrame, ontology: Ontology, rows: DataFrame, app: str, now: str) -> Changed:
    """rows: (s, types array, label). Types above other given types are dropped; without types it is a plain resource."""
    types = rows.select("s", F.explode(F.when(F.size("types") > 0, F.col("types")).otherwise(F.array(F.lit(ROOT)))).alias("o")).distinct()
    known = ontology.classes().select(F.col("uri").alias("o")).union(rows.sparkSession.createDataFrame([(ROOT,)], "o string"))
    _none_of(types.join(known, "o", "left_anti"), "unknown classes")
    below = ontology.class_closure().filter("sub <> sup").withColumnsRenamed({"sub": "below", "sup": "o"})
    pairs = types.join(below, "o").join(types.select("s", F.col("o").alias("below")), ["s", "below"], "left_semi")
    own = types.join(pairs.select("s", "o"), ["s", "o"], "left_anti").select("s", F.lit(TYPE).alias("p"), "o", F.lit("uri").alias("o_kind"), F.lit(None).cast("string").alias("dt"))
    labels = rows.filter("label is not null").select("s", F.lit("nao:prefLabel").alias("p"), F.col("label").alias("o"), F.lit("lit").alias("o_kind"), F.lit("xsd:string").alias("dt"))
    done = add(quads, complete(own.unionByName(labels), graph_of(app)))
    stamp = rows.select("s", F.lit(CREATED).alias("p"), F.lit(now).alias("o"), F.lit("lit").alias("o_kind"), F.lit("xsd:dateTime").alias("dt"))
    return settled(touched(add(done.quads, complete(stamp, META_GRAPH)).quads, rows, now), done.changes)


def move_urls(quads: DataFrame, moves: DataFrame) -> DataFrame:
    """moves: (old, new) urls. Every url at or below an old one is rewritten; of nested moves the longest old one counts.

    A url is joined with its own ancestors, so the moves need not be compared with every url."""
    urls = quads.filter(F.col("p") == URL)
    parts = F.split("o", "/")
    above = urls.select("s", "o", "g", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("old"))
    hit = above.join(moves, "old").groupBy("s", "o", "g").agg(F.max_by(F.struct("old", "new"), F.length("old")).alias("m"))
    moved = hit.select("s", F.lit(URL).alias("p"), "o", "g", F.concat(F.col("m.new"), F.expr("substring(o, length(m.old) + 1)")).alias("__o"))
    return quads.join(moved, ["s", "p", "o", "g"], "left").withColumn("o", F.coalesce("__o", "o")).drop("__o").select(*quads.columns)


def resolve_urls(quads: DataFrame, names: DataFrame) -> DataFrame:
    """names: (name). Adds s: the name itself if it is a resource, else the resource that has it as its url, else null."""
    subjects = quads.select(F.col("s").alias("name"), F.col("s").alias("same")).distinct()
    by_url = quads.filter(F.col("p") == URL).groupBy(F.col("o").alias("name")).agg(F.min("s").alias("found"))
    return names.join(subjects, "name", "left").join(by_url, "name", "left").select("name", F.coalesce("same", "found", F.when(F.col("name").startswith(PREFIX), F.col("name"))).alias("s"))


def reduce_duplicates(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blank nodes (s like _:x) with the same properties become one; references follow, until nothing changes.

    Gives the rows and the mapping (old, new)."""
    names = rows.select(F.col("s").alias("old"), F.col("s").alias("new")).distinct()
    while True:  # each round but the last leaves fewer names
        sums = rows.filter(F.col("s").startswith("_:")).groupBy("s").agg(F.sha2(F.to_json(F.array_sort(F.collect_set(F.struct("p", "o")))), 256).alias("h"))
        mapping = sums.groupBy("h").agg(F.min("s").alias("to"), F.collect_list("s").alias("all")).filter(F.size("all") > 1).select(F.explode("all").alias("from"), "to").filter("from <> to")
        if mapping.isEmpty():
            return rows, names
        rows = renamed(rows, mapping).distinct()
        names = names.join(mapping, names["new"] == mapping["from"], "left").select("old", F.coalesce("to", "new").alias("new"))
        rows, names = cut_lineage(rows), cut_lineage(names)


def renamed(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """rows with s and o replaced by the mapping (from, to)."""
    columns = rows.columns
    m = mapping.select(F.col("from").alias("__from"), F.col("to").alias("__to"))
    subject = rows.join(m, rows["s"] == m["__from"], "left").withColumn("s", F.coalesce("__to", "s")).select(*columns)
    return subject.join(m, subject["o"] == m["__from"], "left").withColumn("o", F.coalesce("__to", "o")).select(*columns)


def merge_resources(quads: DataFrame, ontology: Ontology, mapping: DataFrame) -> Changed:
    """mapping: (from, to), to the survivor. It gets the others' values, but where a property with one value has one already
    (its own first, then the smallest of the others'); links to the others lead to it."""
    single = [r["uri"] for r in ontology.properties().filter("max_card = 1").select("uri").distinct().collect()] + META
    moved = renamed(quads.withColumn("__own", F.lit(True)), mapping)
    own = quads.select("s", "p", "o", "g").withColumn("__first", F.lit(0))
    ranked = moved.join(own, ["s", "p", "o", "g"], "left").withColumn("__n", F.dense_rank().over(Window.partitionBy("s", "p").orderBy(F.coalesce("__first", F.lit(1)), "o")))
    kept = ranked.filter(~F.col("p").isin(single) | (F.col("__n") == 1)).select(*quads.columns).dropDuplicates(KEYS)
    gone = quads.join(kept, [*KEYS], "left_anti").select("s", "p", "o", F.lit(False).alias("added"))
    new = kept.join(quads, [*KEYS], "left_anti").select("s", "p", "o", F.lit(True).alias("added"))
    return settled(kept, gone.unionByName(new))


def store_resources(quads: DataFrame, ontology: Ontology, rows: DataFrame, app: str, now: str, identify=None, overwrite: bool = False, overwrite_all: bool = False, lazy: bool = False, merge_duplicates: bool = True, discardable: bool = False) -> tuple[Changed, DataFrame]:
    """rows: (s, p, o) in which blank nodes (_:x) stand for new resources. Gives the change, and (blank, s).

    identify: rows and quads to a mapping (from, to) of blank nodes to resources (see identify.py); none: all are new.
    overwrite: given values replace those of properties with one value; overwrite_all: of all given properties.
    lazy: of several values for a property with one, the smallest counts; else they are a violation."""
    names = rows.select(F.col("s").alias("old"), F.col("s").alias("new")).distinct()
    if merge_duplicates:
        rows, names = reduce_duplicates(rows)
    _none_of(rows.filter(F.col("o").startswith("_:")).select(F.col("o").alias("s")).distinct().join(rows.select("s").distinct(), "s", "left_anti"), "unknown blank nodes")
    found = identify(rows, quads) if identify else rows.sparkSession.createDataFrame([], "from string, to string")
    blanks = names.filter(F.col("new").startswith("_:")).select(F.col("new").alias("from")).distinct().join(found, "from", "left")
    mapping = blanks.select("from", F.coalesce("to", F.concat(F.lit(f"{PREFIX}{app}/"), F.substring(F.sha2(F.concat_ws("|", F.lit(app), F.lit(now), "from"), 256), 1, 32))).alias("to"))
    mapping = cut_lineage(mapping)
    fitted = cut_lineage(checked(renamed(rows, mapping), ontology))
    if lazy:
        fitted = fitted.withColumn("__n", F.row_number().over(Window.partitionBy("s", "p").orderBy("o"))).filter("max_card <> 1 or __n = 1").drop("__n")
    base = quads
    if overwrite or overwrite_all or lazy:
        replaced = fitted if overwrite_all else fitted.filter("max_card = 1")
        base = remove(quads, replaced, ["s", "p"]).quads
    check_cardinality(base, fitted)
    done = add(base, complete(fitted, graph_of(app, discardable)))
    fresh = fitted.select("s").distinct().join(existing(quads), "s", "left_anti")
    stamp = fresh.select("s", F.lit(CREATED).alias("p"), F.lit(now).alias("o"), F.lit("lit").alias("o_kind"), F.lit("xsd:dateTime").alias("dt"))
    final = touched(add(done.quads, complete(stamp, META_GRAPH)).quads, done.changes, now)
    result = names.filter(F.col("old").startswith("_:")).join(mapping, names["new"] == mapping["from"]).select(F.col("old").alias("blank"), F.col("to").alias("s"))
    return settled(final, done.changes), cut_lineage(result)


def remove_data_by_application(quads: DataFrame, app: str, now: str, resources: DataFrame | None = None) -> Changed:
    """All of the application's quads, or those of resources (s); what has data elsewhere is modified, the rest goes."""
    graphs = [graph_of(app), graph_of(app, True)]
    own = F.col("g").isin(graphs)
    if resources is not None:
        chosen = resources.select("s").distinct().withColumn("__hit", F.lit(True))
        marked = quads.join(chosen, "s", "left")
        gone, rest = marked.filter(own & F.col("__hit")).drop("__hit"), marked.filter(~(own & F.coalesce("__hit", F.lit(False)))).drop("__hit")
    else:
        gone, rest = quads.filter(own), quads.filter(~own)
    return settled(swept(touched(rest, gone, now), gone), gone.select("s", "p", "o", F.lit(False).alias("added")))
