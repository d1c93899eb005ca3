import math

import numpy as np
import pytest

from quadloom.llm.ball_tree import Best, _products, bound, build_tree, search, top_k
from quadloom.llm.chat_format import chat_format


def brute_chat(rows):
    convs = {}
    for c, turn, role, text in {tuple(r) for r in rows}:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role is not None, role or "", text is not None, text or ""))
    turns = {c: tuple((x[2:]) for x in sorted(t)) for c, t in convs.items()}
    out = []
    for t in set(turns.values()):
        same = [c for c, x in turns.items() if x == t]
        if not any(len(x) > len(t) and x[: len(t)] == t for x in turns.values()):
            out.append((min(same), len(t), len(same), "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for _, r, _, x in t)))
    return sorted(out)


def test_chat(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (2, 2, "user", "more"), (3, 0, "user", "hi"), (4, 0, "user", "hi"), (4, 1, "assistant", "no"),
        (5, 5, "user", "hi"), (5, 6, "assistant", "yo"), (5, 7, "user", "more"), (6, 0, None, None), (7, 0, "", ""), (8, 0, "user", "x"), (8, 0, "user", "x"), (8, None, "system", "first"), (None, 0, "user", "lost"),
        (9, 0, "user", "a"), (9, 0, "user", "b"),
    ]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, n int, h1 string")
    assert sorted(map(tuple, chat_format(docs).collect())) == brute_chat(rows)
    assert chat_format(docs.limit(0)).count() == 0


def test_chat_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert sorted(map(tuple, chat_format(docs).collect())) == brute_chat([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in docs.collect()])


def brute_search(rows, every, k):
    known = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            w = [math.floor(256 * x) for x in v]
            known[i] = min(known.get(i, w), w)
    out = []
    for q, v in known.items():
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in known.items() if i != q and len(w) == len(v))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_search_table(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    got = top_k(e, "vec_id % 50 = 0", 5)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect())) == brute_search([(r["vec_id"], r["embedding"]) for r in e.collect()], 50, 5)


def test_search_odd(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 4]) for i in range(400)]  # many ties
    rows += [(400, None), (401, []), (402, [None] * 6), (403, [float("nan")] * 6), (404, [float("inf")] * 6), (405, [1.0, 2.0]), (410, [0.5, 1.0]), (7, rows[8][1]), (450, [0.1] * 6), (450, [0.1] * 6), (None, [0.0] * 6)]
    e = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, shard int")
    rows32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(map(tuple, top_k(e, "vec_id % 10 = 0", 7).collect())) == brute_search(rows32, 10, 7)
    assert top_k(e.limit(0), "vec_id % 10 = 0", 7).count() == 0


@pytest.mark.parametrize("scale", [1, 1 << 21])
def test_tree_prunes_and_is_exact(scale):
    rng = np.random.default_rng(0)
    centres = rng.integers(-200, 200, (20, 8))
    points = (centres[rng.integers(0, 20, 3000)] + rng.integers(-5, 6, (3000, 8))) * scale
    queries = points[::100]
    best, tree = Best(np.arange(0, 3000, 100), queries, 5), build_tree(points)
    asked = []
    original = best.offer
    best.offer = lambda rows, ids, scores: (asked.append(len(rows) * len(ids)), original(rows, ids, scores))
    search(best, tree, np.arange(3000), points)
    products = _products(queries, points)
    for n, q in enumerate(range(0, 3000, 100)):
        want = sorted((-int(s), i) for i, s in enumerate(products[n]) if i != q)[:5]
        assert [(-int(s), int(i)) for s, i in zip(best.scores[n], best.vecs[n], strict=True)] == want
    assert sum(asked) < 0.5 * len(queries) * len(points)


def test_rounds_share_the_kth_score(spark, monkeypatch):
    """Over several shards and lengths of vectors the result is exact."""
    import quadloom.llm.ball_tree as B

    monkeypatch.setattr(B, "SHARD_VECTORS", 60)
    monkeypatch.setattr(B, "BLOCK_QUERIES", 8)
    monkeypatch.setattr(B, "VISITS", 2)
    monkeypatch.setattr(B, "ROOTS", 4)
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.integers(-9, 10, 4 if i % 5 else 3) / 8]) for i in range(900)]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id % 10 = 0", 5)
    assert sorted(map(tuple, got.collect())) == brute_search(rows, 10, 5)


def test_bound_holds():
    rng = np.random.default_rng(1)
    points, queries = rng.integers(-300, 300, (200, 6)), rng.integers(-300, 300, (50, 6))
    tree = build_tree(points)
    norms = np.sqrt((queries.astype(float) ** 2).sum(axis=1))
    assert (bound(queries, norms, tree["centre"][0], tree["radius"][0]) >= _products(queries, points).max(axis=1)).all()
