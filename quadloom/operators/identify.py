"""Entity identification: which resources of the graph do the blank nodes of a batch stand for?

By url; by unique identifier; else by defining properties: a candidate has one equal value at least, and no defining
property with values of its own that all differ. It needs all the types. The best one has most statements on the
identifying properties, then the earliest creation, then the smallest uri. There is no cap on candidates. Blank nodes that
refer to others wait until those are identified, however deep the references go; cycles stay new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.graph import CREATED, TYPE, URL
from ..plans.ontology import Ontology
from ..session import cut_lineage
from .mutate import renamed


def by_value(rows: DataFrame, quads: DataFrame, p: str) -> DataFrame:
    """(from, to) of the blank nodes whose value of p a resource has."""
    known = quads.filter(F.col("p") == p).groupBy("o").agg(F.min("s").alias("to"))
    return rows.filter((F.col("p") == p) & F.col("s").startswith("_:")).join(known.hint("merge"), "o").groupBy(F.col("s").alias("from")).agg(F.min("to").alias("to"))


def by_properties(rows: DataFrame, quads: DataFrame, ontology: Ontology) -> DataFrame:
    """(from, to) by defining properties; rows must not refer to other blank nodes.

    Blank nodes that say the same are compared once. So are resources: of those with the same types and values only the
    one that goes before the others can be the best. Their joins are merge joins, for Spark takes lifted tables to be as
    small as their compressed files and would send them whole."""
    defining = F.col("p").isin(ontology.defining()) & (F.col("p") != TYPE)
    blank = rows.filter(F.col("s").startswith("_:"))
    said = blank.filter(defining).groupBy(F.col("s").alias("from"), "p").agg(F.min("o").alias("o"))
    said = said.unionByName(blank.filter(F.col("p") == TYPE).select(F.col("s").alias("from"), "p", "o").distinct())
    alike = said.groupBy("from").agg(_same().alias("same"))
    asked = alike.groupBy("same").agg(F.min("from").alias("from"))
    said = cut_lineage(said.join(asked.select("from").hint("merge"), "from", "left_semi"))
    given, needed = said.filter(F.col("p") != TYPE), said.filter(F.col("p") == TYPE).select("from", F.col("o").alias("sup"))

    held = quads.filter(defining | (F.col("p") == TYPE)).select(F.col("s").alias("to"), "p", "o").distinct()
    created = quads.filter(F.col("p") == CREATED).groupBy(F.col("s").alias("to")).agg(F.min("o_ts").alias("created"))
    # Of resources with the same statements, the earliest created, then the smallest uri.
    place = F.struct(F.col("created").isNull().alias("unknown"), "created", "to")
    stands = held.groupBy("to").agg(_same().alias("same")).join(created.hint("merge"), "to", "left").groupBy("same").agg(F.min(place).alias("place")).select("place.to", "place.created")
    held = cut_lineage(held.join(stands.hint("merge"), "to"))
    facts = held.filter(F.col("p") != TYPE).select("to", "p", "o")
    # A candidate that fits has the given value of each defining property that it has values of. So for every set of
    # properties that candidates have, the given value that fewest of them share finds all that can fit.
    has = facts.groupBy("to").agg(F.array_sort(F.collect_set("p")).alias("has"))
    keyed = facts.join(has.hint("merge"), "to").select("to", "has", "p", "o")
    shared = keyed.groupBy("has", "p", "o").agg(F.count("*").alias("sharing"))
    sets = has.select("has").distinct().withColumn("p", F.explode("has"))
    rarest = given.join(sets, "p").join(shared.hint("merge"), ["has", "p", "o"], "left").groupBy("from", "has").agg(F.min(F.struct(F.coalesce("sharing", F.lit(0)).alias("sharing"), "p", "o")).alias("key"))
    first = rarest.filter("key.sharing > 0").select("from", "has", "key.p", "key.o").join(keyed.hint("merge"), ["has", "p", "o"]).select("from", "to").distinct()
    # A defining property speaks against a candidate that has values of it, none of which is the given one.
    compared = first.join(given.hint("merge"), "from").join(facts.withColumnRenamed("o", "held").hint("merge"), ["to", "p"]).groupBy("from", "to", "p").agg(F.max(F.col("held") == F.col("o")).alias("agrees"), F.count("*").alias("n"))
    fitting = compared.groupBy("from", "to").agg(F.bool_and("agrees").alias("fits"), F.sum("n").alias("score")).filter("fits")
    types = held.filter(F.col("p") == TYPE).select("to", "created", F.col("o").alias("sub")).join(ontology.class_closure(), "sub").select("to", "created", "sup").distinct()
    wanted = needed.groupBy("from").agg(F.count("*").alias("types"))
    typed = fitting.join(needed.hint("merge"), "from").join(types.hint("merge"), ["to", "sup"]).groupBy("from", "to", "created", "score").agg(F.count("*").alias("have")).join(wanted.hint("merge"), "from").filter("have = types")
    # The best is the least by this order, an aggregate of fixed size.
    best = typed.groupBy("from").agg(F.min(F.struct((-F.col("score")).alias("score"), F.col("created").isNull().alias("unknown"), "created", "to")).alias("best"))
    found = best.join(asked.hint("merge"), "from").select("same", "best.to")
    return alike.join(found.hint("merge"), "same").select("from", "to")


def _same() -> Column:
    """Two hashes of all statements (p, o) of a resource, 128 bits, and their number."""
    return F.struct(F.count("*").alias("n"), *[F.bit_xor(F.xxhash64(F.lit(seed), "p", "o")).alias(f"h{seed}") for seed in (1, 2)])


def identifier(ontology: Ontology, data_objects: tuple[str, ...] = (), unique: tuple[str, ...] = ()):
    """An identify argument of store_resources. data_objects: classes that only urls identify; unique: properties that do alone."""

    def identify(rows: DataFrame, quads: DataFrame) -> DataFrame:
        spark = rows.sparkSession
        found = spark.createDataFrame([], "from string, to string")
        closed = ontology.class_closure()
        for p in (URL, *unique):
            found = found.unionByName(by_value(rows, quads, p).join(found, "from", "left_anti"))
        only_url = rows.filter(F.col("p") == TYPE).join(closed.filter(F.col("sup").isin(*data_objects, "")), F.col("o") == F.col("sub")).select("s").union(rows.filter(F.col("p") == URL).select("s")).distinct()
        rest = rows.filter(F.col("s").startswith("_:")).join(only_url, "s", "left_anti")
        while True:  # each round but the last identifies a blank node at least
            now = renamed(rest.join(found.select(F.col("from").alias("s")), "s", "left_anti"), found)
            waiting = now.filter(F.col("o").startswith("_:")).select("s").distinct()
            new = cut_lineage(by_properties(now.join(waiting, "s", "left_anti"), quads, ontology))
            if new.isEmpty():
                break
            # Cached, it has its real size. Its estimated one is a product over the joins of each round, of which the next
            # round takes the product again: a number with so many digits that planning never ends.
            before, found = found, cut_lineage(found.unionByName(new)).cache()
            found.count()
            before.unpersist()
        return found

    return identify
