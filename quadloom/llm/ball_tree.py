"""Exact top-k by inner product: ball-tree branch and bound per shard.

Vectors are made of integers, floor(256 x). They are dealt to shards of about SHARD_VECTORS by a hash of their id; each
shard is a ball tree (split at the median of the direction of largest spread) whose nodes hold centre and radius. For a query
q a node can hold nothing over q.c + r|q|. Queries come in blocks of BLOCK_QUERIES, which meet the shards in rounds: one shard
each at first, then in each round as many as in all rounds before, and between rounds each query's current k-th score over
all its shards so far is shared. A round starts with the roots: a block's visit to a shard whose root is under the k-th
scores of all its queries is left out before trees are joined. Visits are dealt by shard, so a tree is read once for up to
VISITS blocks; while a block goes through a tree, nodes are taken by descending bound and the k-th scores, which rise from
node to node, prune. Only what is strictly under a k-th score is skipped, with a margin for rounding, so ties survive.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part; a query is compared with the vectors
of its own length; of rows that share an id the smallest vector counts; an empty table gives an empty result; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Vectors of a shard (about), vectors of a leaf, queries of a block, blocks that a task takes through a tree, roots of a row.
SHARD_VECTORS, LEAF, BLOCK_QUERIES, VISITS, ROOTS = 8_192, 64, 256, 64, 512
LEAST = np.iinfo(np.int64).min
EXACT = 2.0**53


def prepared(embeddings: DataFrame) -> DataFrame:
    """vec_id, dim, v (array of longs) of the vectors that take part."""
    v = F.transform(F.col("embedding"), lambda x: F.floor(x.cast("double") * 256).cast("long"))
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = embeddings.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.coalesce(good, F.lit(False)))
    one = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))
    return one.withColumn("dim", F.size("v"))


def build_tree(points: np.ndarray) -> dict[str, np.ndarray]:
    """order: the points' order by leaf; of each node: centre, radius, left and right child (0: a leaf), begin, end in order."""
    x = points.astype(np.float64)
    order = np.arange(len(x))
    nodes: list[list] = []
    todo = [(0, len(x), -1, 0)]
    while todo:
        begin, end, parent, side = todo.pop()
        own = x[order[begin:end]]
        centre = own.mean(axis=0)
        nodes.append([centre, np.sqrt(((own - centre) ** 2).sum(axis=1).max()), 0, 0, begin, end])
        if parent >= 0:
            nodes[parent][2 + side] = len(nodes) - 1
        if end - begin <= LEAF:
            continue
        far = own[((own - own[0]) ** 2).sum(axis=1).argmax()]
        other = own[((own - far) ** 2).sum(axis=1).argmax()]
        middle = begin + (end - begin) // 2
        order[begin:end] = order[begin:end][np.argpartition(own @ (other - far), middle - begin)]
        me = len(nodes) - 1
        todo += [(begin, middle, me, 0), (middle, end, me, 1)]
    columns = list(zip(*nodes, strict=True))
    return {"order": order, "centre": np.stack(columns[0]), "radius": np.array(columns[1])} | {k: np.array(c) for k, c in zip(("left", "right", "begin", "end"), columns[2:], strict=True)}


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if largest < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class Best:
    """The k best of each query so far, by score and then smaller id."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.ids, self.queries, self.k = ids, queries, k
        self.norms = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
        self.scores = np.full((len(ids), k), np.iinfo(np.int64).min)
        self.vecs = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.floor = np.full(len(ids), np.iinfo(np.int64).min) if floor is None else floor

    def kth(self) -> np.ndarray:
        return np.maximum(self.floor, self.scores[:, -1])

    def offer(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """scores: (rows, ids)."""
        own = self.ids[rows][:, None] == ids[None, :]
        scores = np.where(own, np.iinfo(np.int64).min, scores)
        s = np.concatenate([self.scores[rows], scores], axis=1)
        v = np.concatenate([self.vecs[rows], np.where(own, np.iinfo(np.int64).max, np.broadcast_to(ids, scores.shape))], axis=1)
        order = np.lexsort((v, -s.astype(np.float64) if np.abs(s[s > np.iinfo(np.int64).min]).max(initial=0) < EXACT else _descending(s)), axis=1)[:, : self.k]
        self.scores[rows], self.vecs[rows] = np.take_along_axis(s, order, axis=1), np.take_along_axis(v, order, axis=1)


def _descending(s: np.ndarray) -> np.ndarray:
    return ~s  # -s - 1: no overflow


def bound(queries: np.ndarray, norms: np.ndarray, centre: np.ndarray, radius: float) -> np.ndarray:
    """No inner product of a query with a vector of the ball is over this."""
    exact = queries.astype(np.float64) @ centre + radius * norms
    return exact + 1e-9 * (np.abs(exact) + radius * norms) + 1e-6


def search(best: Best, tree: dict[str, np.ndarray], ids: np.ndarray, points: np.ndarray) -> None:
    """Take the tree's nodes by descending bound for the whole block; a node goes on with the queries that it may serve."""
    import heapq

    def bounds(node: int, rows: np.ndarray) -> np.ndarray:
        return bound(best.queries[rows], best.norms[rows], tree["centre"][node], tree["radius"][node])

    everyone = np.arange(len(best.ids))
    heap = [(-bounds(0, everyone).max(initial=0.0), 0, everyone)]
    while heap:
        _, node, rows = heapq.heappop(heap)
        rows = rows[bounds(node, rows) >= best.kth()[rows]]  # the k-th scores have risen since
        if not len(rows):
            continue
        if not tree["left"][node]:
            at = tree["order"][tree["begin"][node] : tree["end"][node]]
            best.offer(rows, ids[at], _products(best.queries[rows], points[at]))
            continue
        for child in (int(tree["left"][node]), int(tree["right"][node])):
            upper = bounds(child, rows)
            may = upper >= best.kth()[rows]
            if may.any():
                heapq.heappush(heap, (-upper[may].max(), child, rows[may]))


def top_k(embeddings: DataFrame, is_query: str, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other vectors for each vector that is_query (SQL) selects."""
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "ball_tree")
    vectors = scratch.table(prepared(embeddings), "vectors")
    queries = vectors.filter(is_query)
    count, asked = vectors.count(), queries.count()
    shards, blocks = max(1, -(-count // SHARD_VECTORS)), max(1, -(-asked // BLOCK_QUERIES))
    flat = "dim int, {key} int, ids binary, points binary"

    def packed(rows: DataFrame, parts: int, key: str) -> DataFrame:
        """A row a part: its ids and vectors as arrays of longs."""

        def pack(part: pd.DataFrame) -> pd.DataFrame:
            points = np.stack(part["v"].to_numpy()).astype("<i8")
            return pd.DataFrame([{"dim": part["dim"].iloc[0], key: part[key].iloc[0], "ids": part["vec_id"].to_numpy(dtype="<i8").tobytes(), "points": points.tobytes()}])

        return rows.withColumn(key, F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")).groupBy("dim", key).applyInPandas(pack, flat.format(key=key))

    names = ("order", "centre", "radius", "left", "right", "begin", "end")

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.iloc[i : i + 1]
                tree = build_tree(np.frombuffer(row["points"].iloc[0], dtype="<i8").reshape(-1, int(row["dim"].iloc[0])))
                yield row.assign(**{n: [tree[n].astype("<f8" if n in ("centre", "radius") else "<i8").tobytes()] for n in names})

    trees = scratch.table(packed(vectors, shards, "shard").mapInPandas(grow, flat.format(key="shard") + "".join(f", {n} binary" for n in names)), "trees")
    asking = scratch.table(packed(queries, blocks, "block").select("dim", "block", F.col("ids").alias("q_ids"), F.col("points").alias("q_points")), "asking")
    as_array = lambda data, kind="<i8": np.frombuffer(data, dtype=kind)

    def root(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            centres = [as_array(c, "<f8")[:d].tobytes() for c, d in zip(batch["centre"], batch["dim"], strict=True)]
            yield pd.DataFrame({"dim": batch["dim"], "shard": batch["shard"], "middle": centres, "reach": [as_array(r, "<f8")[0] for r in batch["radius"]]})

    roots = trees.select("dim", "shard", "centre", "radius").mapInPandas(root, "dim int, shard int, middle binary, reach double")
    # Shards are numbered anew for each length of vectors, in an order of their own for each block: block + number modulo all.
    numbered = roots.withColumn("number", F.row_number().over(Window.partitionBy("dim").orderBy("shard")) - 1)
    group = F.floor(F.col("number") / ROOTS).cast("int").alias("part")
    groups = scratch.table(numbered.groupBy("dim", group).agg(F.array_sort(F.collect_list(F.struct("number", "shard", "middle", "reach"))).alias("roots")), "roots")  # ROOTS at most
    all_shards = groups.groupBy("dim").agg(F.sum(F.size("roots")).cast("int").alias("all"))

    def visits_of(first: int, last: int):
        """The shards first .. last-1 in a block's order that may serve one of its queries."""

        def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.itertuples():
                    points = as_array(row.q_points).reshape(-1, row.dim)
                    norms = np.sqrt((points.astype(np.float64) ** 2).sum(axis=1))
                    floor = np.full(len(points), LEAST) if row.floor is None else as_array(row.floor)
                    found = [
                        r["shard"] for r in row.roots
                        if first <= (r["number"] - row.block) % row.all < last and (bound(points, norms, as_array(r["middle"], "<f8"), r["reach"]) >= floor).any()
                    ]
                    yield pd.DataFrame({"dim": np.int32(row.dim), "block": np.int32(row.block), "shard": np.array(found, dtype=np.int32)})

        return visit

    def searched(visiting: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        """The best of one tree for each of the blocks."""
        found = [pd.DataFrame({"dim": np.empty(0, np.int32), "block": np.empty(0, np.int32), "query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0, np.int64)})]
        for of in trees.itertuples():
            ids, points = as_array(of.ids), as_array(of.points).reshape(-1, of.dim)
            tree = {n: as_array(getattr(of, n), "<f8" if n in ("centre", "radius") else "<i8") for n in names}
            tree["centre"] = tree["centre"].reshape(-1, of.dim)
            for row in visiting.itertuples():
                best = Best(as_array(row.q_ids), as_array(row.q_points).reshape(-1, row.dim), k, None if row.floor is None else as_array(row.floor).copy())
                search(best, tree, ids, points)
                q, j = np.nonzero((best.vecs < np.iinfo(np.int64).max) & (best.scores >= best.floor[:, None]))
                found.append(pd.DataFrame({"dim": np.int32(row.dim), "block": np.int32(row.block), "query_id": best.ids[q], "vec_id": best.vecs[q, j], "score": best.scores[q, j]}))
        return pd.concat(found, ignore_index=True)

    def floors(part: pd.DataFrame) -> pd.DataFrame:
        """The k-th scores of a block's queries, in the block's order."""
        ids = np.frombuffer(part["q_ids"].iloc[0], dtype="<i8")
        known = {q: s for q, s, n in zip(part["query_id"], part["kth"], part["n"], strict=True) if n >= k}
        return pd.DataFrame([{"dim": part["dim"].iloc[0], "block": part["block"].iloc[0], "floor": np.array([known.get(q, LEAST) for q in ids], dtype="<i8").tobytes()}])

    most = all_shards.agg(F.max("all")).first()[0] or 0
    order = Window.partitionBy("dim", "block", "query_id").orderBy(F.desc("score"), "vec_id")
    schema = "dim int, block int, query_id long, vec_id long, score long"
    best, done, round_ = spark.createDataFrame([], schema), 0, 0
    while done < most:
        upto = max(1, 2 * done)
        if done:
            kth = best.groupBy("dim", "block", "query_id").agg(F.min("score").alias("kth"), F.count("*").alias("n"))
            floor = kth.join(asking.select("dim", "block", "q_ids"), ["dim", "block"]).groupBy("dim", "block").applyInPandas(floors, "dim int, block int, floor binary")
            now = scratch.table(asking.join(floor, ["dim", "block"], "left"), f"asking{round_}")
        else:
            now = asking.withColumn("floor", F.lit(None).cast("binary"))
        visits = now.join(groups, "dim").join(all_shards, "dim").mapInPandas(visits_of(done, upto), "dim int, block int, shard int")
        dealt = F.pmod(F.xxhash64("block"), F.lit(max(1, -(-blocks // VISITS)))).cast("int").alias("deal")
        visits = scratch.table(visits.select("dim", "block", "shard", dealt), f"visits{round_}")
        deals = visits.select(F.col("dim").alias("d"), F.col("shard").alias("s"), F.col("deal").alias("of")).distinct()
        there = trees.join(deals, (trees["dim"] == deals["d"]) & (trees["shard"] == deals["s"])).drop("d", "s")
        here = now.join(visits, ["dim", "block"])
        got = here.groupBy("dim", "shard", "deal").cogroup(there.groupBy("dim", "shard", "of")).applyInPandas(searched, schema)
        best = scratch.table(best.unionByName(got).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank"), f"best{round_}")
        done, round_ = upto, round_ + 1
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
