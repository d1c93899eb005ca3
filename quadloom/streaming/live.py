"""Live queries and the change feed.

A change feed is a table or stream of (s, p, o, added, at). A live query keeps the last listing of its results in the
shared folder and, for each micro-batch of relevant changes, lists again and gives what is new and what is gone: two anti
joins on the resource."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.graph import TYPE
from ..plans.ontology import Ontology

FEED = "s string, p string, o string, added boolean, at timestamp"


def difference(before: DataFrame, now: DataFrame, emit_updates: bool = False) -> DataFrame:
    """r, event (added, removed; with emit_updates also updated): what changed between two listings, by resource."""
    new = now.join(before.select("r"), "r", "left_anti").select("r", F.lit("added").alias("event"))
    gone = before.join(now.select("r"), "r", "left_anti").select("r", F.lit("removed").alias("event"))
    found = new.distinct().unionByName(gone.distinct())
    if emit_updates:
        columns = [c for c in now.columns if c in before.columns]
        changed = now.select(*columns).exceptAll(before.select(*columns)).select("r").distinct().join(before.select("r"), "r", "left_semi")
        found = found.unionByName(changed.select("r", F.lit("updated").alias("event")))
    return found


def relevant(changes: DataFrame, properties: list[str] | None) -> DataFrame:
    """Changes that a query with comparisons of these properties may care for; None: one compares any property."""
    return changes if properties is None else changes.filter(F.col("p").isin(properties))


@dataclass
class LiveQuery:
    """listing: makes the results anew from the graph as it is. properties: those that its comparisons look at."""

    spark: SparkSession
    listing: Callable[[], DataFrame]
    folder: str
    properties: list[str] | None = None
    emit_updates: bool = False
    #: Paths of listings, oldest first; the last one counts. A query that starts again on its folder goes on from there.
    snapshots: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.snapshots = self.snapshots or self._written()

    def _written(self) -> list[str]:
        """The whole listings that the folder holds."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = files.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/listing-*/_SUCCESS"))
        return sorted(f.getPath().getParent().toString() for f in found or [])

    def list(self, batch: int | None = None) -> DataFrame:
        """The results now; they are what later differences start from."""
        path = f"{self.folder}/listing-{time.time_ns():020d}-{'asked' if batch is None else batch}"
        self.listing().write.parquet(path)
        self.snapshots.append(path)
        return self.spark.read.parquet(path)

    def update(self, batch: int | None = None) -> DataFrame:
        """What changed since the last listing; for a batch that comes again, since the last one of other batches."""
        earlier = [s for s in self.snapshots if batch is None or not s.endswith(f"-{batch}")]
        before = self.spark.read.parquet(earlier[-1]) if earlier else None
        now = self.list(batch)
        return difference(before if before is not None else now.limit(0), now, self.emit_updates)

    def run(self, feed: DataFrame, sink: Callable[[DataFrame, int], None], every: str = "2 seconds", available_now: bool = False):
        """Start on a streaming feed: each batch with a relevant change lists again and hands the difference to sink.

        How far it has read is kept in the folder, too: after a restart it goes on from there. A batch that a failure
        cut short is told again, whole."""

        def batch(changes: DataFrame, n: int) -> None:
            if not relevant(changes, self.properties).isEmpty():
                sink(self.update(n), n)

        writer = feed.writeStream.option("checkpointLocation", f"{self.folder}/progress").foreachBatch(batch)
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


# ---- subscriptions ----------------------------------------------------------------------------------------------------

SUBSCRIPTIONS = "watcher string, resource string, property string, type string"


def routed(changes: DataFrame, subscriptions: DataFrame, types: DataFrame, ontology: Ontology) -> DataFrame:
    """watcher, s, p, added, removed: property changes that subscriptions ask for.

    subscriptions: SUBSCRIPTIONS; a null field doesn't restrict, all null watches everything. types: (s, type) of the graph,
    own types; a type's subscribers hear of instances of what is below it. Changes of types have typed() instead."""
    events = changes.filter(F.col("p") != TYPE).groupBy("s", "p").agg(
        F.array_sort(F.collect_set(F.when(F.col("added"), F.col("o")))).alias("added"), F.array_sort(F.collect_set(F.when(~F.col("added"), F.col("o")))).alias("removed")
    )
    above = types.join(ontology.class_closure(), types["type"] == F.col("sub")).select("s", F.col("sup").alias("type")).distinct()
    kinds = above.join(subscriptions.filter("type is not null").select("type").distinct(), "type", "left_semi")
    free = subscriptions.filter("type is null")
    bound = subscriptions.filter("type is not null")
    # Each kind of subscription is an equi join of its own, so no event meets a subscription that cannot match it.
    rows = [
        events.join(free.filter("resource is not null and property is not null").select("watcher", F.col("resource").alias("s"), F.col("property").alias("p")), ["s", "p"]),
        events.join(free.filter("resource is not null and property is null").select("watcher", F.col("resource").alias("s")), "s"),
        events.join(free.filter("resource is null and property is not null").select("watcher", F.col("property").alias("p")), "p"),
        _to_all(events, free.filter("resource is null and property is null").select("watcher")),
        events.join(kinds, "s").join(bound.filter("property is null and resource is null").select("watcher", "type"), "type"),
        events.join(kinds, "s").join(bound.filter("property is not null and resource is null").select("watcher", "type", F.col("property").alias("p")), ["type", "p"]),
        events.join(kinds, "s").join(bound.filter("property is null and resource is not null").select("watcher", "type", F.col("resource").alias("s")), ["s", "type"]),
        events.join(kinds, "s").join(bound.filter("property is not null and resource is not null").select("watcher", "type", F.col("resource").alias("s"), F.col("property").alias("p")), ["s", "type", "p"]),
    ]
    out = rows[0].select("watcher", "s", "p", "added", "removed")
    for r in rows[1:]:
        out = out.unionByName(r.select("watcher", "s", "p", "added", "removed"))
    return out.distinct()


def _to_all(events: DataFrame, watchers: DataFrame) -> DataFrame:
    """Every event for each of those who watch everything: a list of people, sent along as one array."""
    everyone = watchers.agg(F.collect_set("watcher").alias("all")).withColumn("one", F.lit(1))
    return events.withColumn("one", F.lit(1)).join(everyone, "one").withColumn("watcher", F.explode("all")).drop("all", "one")


def types_changed(changes: DataFrame) -> DataFrame:
    """s, types_added, types_removed."""
    rows = changes.filter(F.col("p") == TYPE).groupBy("s")
    return rows.agg(F.array_sort(F.collect_set(F.when(F.col("added"), F.col("o")))).alias("types_added"), F.array_sort(F.collect_set(F.when(~F.col("added"), F.col("o")))).alias("types_removed"))


def lifecycle(changes: DataFrame, before: DataFrame, now: DataFrame) -> DataFrame:
    """s, event (created, removed): before and now are (s) of the resources that exist."""
    seen = changes.select("s").distinct()
    created = seen.join(now.select("s"), "s", "left_semi").join(before.select("s"), "s", "left_anti").withColumn("event", F.lit("created"))
    return created.unionByName(seen.join(before.select("s"), "s", "left_semi").join(now.select("s"), "s", "left_anti").withColumn("event", F.lit("removed")))
