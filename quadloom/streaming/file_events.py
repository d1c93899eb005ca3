"""File events: classification, pairing of the two halves of a move, and a leading-edge quiet-period queue.

Both state machines are Structured Streaming operators with processing-time timeouts, so state is bounded by the timers: a
half that comes later than that is a new event."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Bits of a file event's mask, in the order in which they are looked at.
EVENTS = {
    0x00000001: "accessed", 0x00000002: "modified", 0x00000004: "attributesChanged", 0x00000008: "closedWrite", 0x00000010: "closedRead", 0x00000020: "opened", 0x00000040: "movedFrom", 0x00000080: "movedTo",
    0x00000100: "created", 0x00000200: "deleted", 0x00000400: "deletedSelf", 0x00000800: "movedSelf", 0x00002000: "unmounted", 0x00004000: "overflow", 0x00008000: "ignored",
}
MOVE_MS, QUIET_MS = 1_000, 5_000


def classified(mask: Column) -> Column:
    out = F.lit("unknown")
    for bit, name in reversed(EVENTS.items()):
        out = F.when(mask.bitwiseAND(F.lit(bit)) != 0, name).otherwise(out)
    return out


def paired_moves(events: DataFrame) -> DataFrame:
    """events: (cookie, path, kind movedFrom or movedTo). Gives event, old, new.

    Both halves: moved. Only the second: created and closedWrite. Only the first, after MOVE_MS: deleted."""

    def pair(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (old,) = state.get
            state.remove()
            yield pd.DataFrame({"event": ["deleted"], "old": [old], "new": [None]})
            return
        rows = pd.concat(list(batches))
        old = state.get[0] if state.exists else None
        out = []
        for path in rows.loc[rows["kind"] == "movedFrom", "path"]:
            old = path
        for path in rows.loc[rows["kind"] == "movedTo", "path"]:
            if old is not None:
                out.append(("moved", old, path))
                old = None
            else:
                out += [("created", None, path), ("closedWrite", None, path)]
        if old is not None:
            state.update((old,))
            state.setTimeoutDuration(MOVE_MS)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["event", "old", "new"])

    return events.groupBy("cookie").applyInPandasWithState(pair, "event string, old string, new string", "old string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def paired_moves_batch(events: DataFrame) -> DataFrame:
    """As paired_moves, over a finished table of events: an aggregation by cookie."""
    both = events.groupBy("cookie").agg(F.max(F.when(F.col("kind") == "movedFrom", F.col("path"))).alias("old"), F.max(F.when(F.col("kind") == "movedTo", F.col("path"))).alias("new"))
    kinds = F.when(F.col("old").isNotNull() & F.col("new").isNotNull(), F.array(F.lit("moved"))).when(F.col("new").isNotNull(), F.array(F.lit("created"), F.lit("closedWrite"))).otherwise(F.array(F.lit("deleted")))
    return both.select(F.explode(kinds).alias("event"), "old", "new")


def first_then_quiet(events: DataFrame) -> DataFrame:
    """events: (url). The first event of a url is let through at once; later ones are held until QUIET_MS pass without one,
    and then count as one. Gives url, held (0 for the first, else how many were held)."""

    def queue(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (held,) = state.get
            state.remove()
            yield pd.DataFrame({"url": [key[0]] * (held > 0), "held": [held] * (held > 0)})
            return
        count = sum(len(b) for b in batches)
        if state.exists:
            state.update((state.get[0] + count,))
            yield pd.DataFrame({"url": [], "held": []})
        else:
            state.update((count - 1,))
            yield pd.DataFrame({"url": [key[0]], "held": [0]})
        state.setTimeoutDuration(QUIET_MS)

    return events.groupBy("url").applyInPandasWithState(queue, "url string, held long", "held long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def first_then_quiet_batch(events: DataFrame) -> DataFrame:
    """As first_then_quiet, over a finished table (url, at): sessions by gaps, each with its first event and the held rest."""
    from pyspark.sql import Window

    order = Window.partitionBy("url").orderBy("at")
    new = F.coalesce((F.unix_micros("at") - F.unix_micros(F.lag("at").over(order)) > QUIET_MS * 1000).cast("int"), F.lit(1))
    sessions = events.withColumn("new", new).withColumn("session", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    sizes = sessions.groupBy("url", "session").agg(F.count("*").alias("n"))
    return sizes.select("url", F.explode(F.when(F.col("n") > 1, F.array(F.lit(0).cast("long"), F.col("n") - 1)).otherwise(F.array(F.lit(0).cast("long")))).alias("held"))


def actions(events: DataFrame) -> DataFrame:
    """events: (event, old, new, is_folder). What to do: move or remove metadata, index a folder or a file."""
    what = (
        F.when(F.col("event") == "moved", "move")
        .when(F.col("event") == "deleted", "remove")
        .when((F.col("event") == "created") & F.col("is_folder"), "index_folder")
        .when(F.col("event") == "closedWrite", "index_file")
    )
    return events.withColumn("action", what).filter("action is not null")
