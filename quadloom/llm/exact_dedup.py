"""Exact dedup against a minimal perfect hash of the historical digests.

1. Every text is normalised and digested (SHA-256) by built-in functions; from here on only 32-byte digests move.
2. The distinct historical digests go into a minimal perfect hash, built in independent shards of bounded size
   (hash, displace: each small bucket of keys gets a seed and a shift that put its keys on free slots; seeds are tried
   until one does, and every seed hashes whole digests anew, so distinct digests always find places). A slot holds the full digest, the locator (doc_id) of its winner and the number of historical copies.
3. The distinct new digests are looked up: bucket -> displacement -> slot -> comparison of all 32 bytes. Members are
   repeats of the slot's winner; nonmembers are grouped among themselves.

Both sides are aggregated before they are shuffled, so a digest that a third of all rows share costs one row a task.
The last join, from rows to groups, has unique keys on one side; adaptive execution splits a hot digest there.

Defined cases: null text counts as empty; a null doc_id sorts after all others; rows that agree in doc_id and text are
copies of each other, of which one is kept; an empty table gives an empty result; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, Scratch, sent_if_small, text_or_empty

#: Keys in a shard (about) and in a bucket (mean) of the minimal perfect hash.
SHARD_KEYS, BUCKET_KEYS = 16_384, 4
#: A digest's 32-bit words: 0 picks the shard, 1 the bucket. A hash of seed and digest picks the slot.
SPARK_SEED = 42  # of Spark's xxhash64


def text_digest(text: Column) -> Column:
    """SHA-256, as 32 bytes, of the text with each run of ASCII white space as one space."""
    odd_run = f"[\\x09-\\x0D][{SPACES}]*|\\x20[{SPACES}]+"  # a lone space stays as it is
    return F.unhex(F.sha2(F.regexp_replace(text, odd_run, " "), 256))


def _word(i: int) -> Column:
    return F.conv(F.hex(F.substring(F.col("digest"), F.lit(i * 4 + 1), F.lit(4))), 16, 10).cast("long")


def hashed(seed: int, digests: list[bytes]) -> np.ndarray:
    """Spark's xxhash64(seed, digest) of each digest."""
    state = xxhash.xxh64_intdigest(int(seed).to_bytes(8, "little"), SPARK_SEED)
    return np.array([xxhash.xxh64_intdigest(d, state) for d in digests], dtype=np.uint64).view(np.int64)


def displace(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, seed, shift and slot of each distinct digest; slots are 0 .. n-1."""
    n = len(digests)
    words = np.array([int.from_bytes(d[4:8], "big") for d in digests], dtype=np.int64)
    bucket = words % max(1, -(-n // BUCKET_KEYS))
    order = np.argsort(bucket, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0]) if n else np.array([], dtype=int)
    groups = sorted(np.split(order, starts[1:]), key=len, reverse=True) if n else []
    taken = np.zeros(2 * n, dtype=bool)  # twice in a row, so that a shift is a slice
    seeds, shifts, slot = (np.zeros(n, dtype=np.int64) for _ in range(3))
    for keys in groups:
        own = [digests[k] for k in keys]
        for seed in count():
            at = hashed(seed, own) % n
            if len(np.unique(at)) < len(keys):
                continue
            blocked = taken[at[0] : at[0] + n].copy()
            for a in at[1:]:
                blocked |= taken[a : a + n]
            shift = int(np.argmin(blocked))
            if not blocked[shift]:
                break
        seeds[keys], shifts[keys] = seed, shift
        slot[keys] = at = (at + shift) % n
        taken[at] = taken[at + n] = True
    return bucket, seeds, shifts, slot


def _build_shard(rows: pd.DataFrame) -> pd.DataFrame:
    bucket, seed, shift, slot = displace([bytes(d) for d in rows["digest"]])
    return rows.assign(bucket=bucket, seed=seed, shift=shift, slot=slot, size=len(rows))


def build_index(history: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """The minimal perfect hash of history (distinct digest, keep_id, n) as a table, and its number of shards."""
    shards = max(1, -(-history.count() // SHARD_KEYS))
    schema = "digest binary, keep_id long, n long, shard long, bucket long, seed long, shift long, slot long, size long"
    built = history.select("digest", "keep_id", "n", (_word(0) % shards).alias("shard")).groupBy("shard").applyInPandas(_build_shard, schema)
    return scratch.table(built, "index"), shards


def look_up(digests: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """Adds shard, slot, winner to rows with distinct digests; winner is null (and found false) for nonmembers."""
    sizes = index.groupBy("shard").agg(F.first("size").alias("size"))
    buckets = index.select("shard", "bucket", "seed", "shift").distinct()
    slots = index.select("shard", "slot", F.col("digest").alias("held"), F.col("keep_id").alias("winner"))
    at = (F.pmod(F.xxhash64("seed", "digest"), F.col("size")) + F.col("shift")) % F.col("size")
    return (
        digests.withColumn("shard", _word(0) % shards)
        .join(sizes, "shard", "left")
        .withColumn("bucket", _word(1) % F.ceil(F.col("size") / BUCKET_KEYS))
        .join(buckets, ["shard", "bucket"], "left")
        .withColumn("slot", at)
        .join(slots, ["shard", "slot"], "left")
        .withColumn("found", F.coalesce(F.col("held") == F.col("digest"), F.lit(False)))
        .withColumn("winner", F.when(F.col("found"), F.col("winner")))
        .drop("held", "bucket", "seed", "shift", "size")
    )


def groups_of(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(digest, keep_id, group_size) of rows (doc_id, digest, historical)."""
    keep = F.min("doc_id").alias("keep_id")
    seen = scratch.table(rows.filter("historical").groupBy("digest").agg(keep, F.count("*").alias("n")), "history")
    index, shards = build_index(seen, scratch)
    new = rows.filter("not historical").groupBy("digest").agg(keep, F.count("*").alias("n"))
    looked = scratch.table(look_up(new, index, shards), "looked")
    repeats = looked.filter("found").select("shard", "slot", F.col("n").alias("more"), F.col("keep_id").alias("new_id"))
    old = index.select("digest", "keep_id", "n", "shard", "slot").join(repeats, ["shard", "slot"], "left")
    old = old.select("digest", F.least("keep_id", "new_id").alias("keep_id"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("group_size"))
    return old.unionByName(looked.filter("not found").select("digest", "keep_id", F.col("n").alias("group_size")))


def digested(docs: DataFrame, history: DataFrame | None, scratch: Scratch) -> DataFrame:
    """(doc_id, digest, historical) of docs, and of history where it is given.

    Without a history table the documents' lower half of the id range plays that part: the load that came first."""
    bare = lambda df: df.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest(text_or_empty()).alias("digest"))
    if history is not None:
        both = bare(docs).withColumn("historical", F.lit(False)).unionByName(bare(history).withColumn("historical", F.lit(True)))
    else:
        low, high = docs.agg(F.min("doc_id").cast("long"), F.max("doc_id").cast("long")).first()
        pivot = 0 if low is None else (low + high) // 2
        both = bare(docs).withColumn("historical", F.coalesce(F.col("doc_id") <= pivot, F.lit(False)))
    return scratch.table(both, "digests")


def exact_dedup(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """One row per row of docs (and of history): doc_id, keep_id, group_size, kept, text_sha256."""
    scratch = Scratch(docs.sparkSession, "exact_dedup")
    rows = digested(docs, history, scratch)
    found = groups_of(rows, scratch)
    same = rows.groupBy("doc_id", "digest").agg(F.count("*").alias("copies"))
    return (
        same.join(found, "digest")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact dedup keeps, with all columns of docs.

    What goes, and what is there several times, is joined with the rows, not what stays: texts are not shuffled unless
    many rows go."""
    scratch = Scratch(docs.sparkSession, "exact_dedup")
    rows = digested(docs, None, scratch)
    found = groups_of(rows, scratch).select("digest", "keep_id")
    times = rows.groupBy("doc_id", "digest").agg(F.count("*").alias("times")).join(found, "digest")
    others = times.withColumn("stays", F.col("doc_id").eqNullSafe(F.col("keep_id"))).filter("not stays or times > 1")
    others = scratch.table(others.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__other"), "stays"), "others")
    scratch.drop_but("others")
    marked = docs.withColumn("__digest", text_digest(text_or_empty()))
    same = (marked["__digest"] == others["__other"]) & marked["doc_id"].cast("long").eqNullSafe(others["__id"])
    kept = marked.join(sent_if_small(others), same, "left_anti")
    if not (several := others.filter("stays")).isEmpty():
        kept = kept.unionByName(marked.join(sent_if_small(several), same, "left_semi").dropDuplicates(["__digest"]))
    return kept.drop("__digest")
