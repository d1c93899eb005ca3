import hashlib
import re

import numpy as np

from quadloom.llm.exact_dedup import displace, exact_dedup, hashed, keep_first


def brute(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(i)
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        seen = False
        for i in sorted(ids, key=lambda x: (x is None, x)):
            kept = i == keep and not seen
            seen |= kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(odd, small):
    for docs in (odd, small):
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        assert sorted(map(tuple, exact_dedup(docs).collect()), key=str) == brute(rows)


def test_history_table(spark):
    old = spark.createDataFrame([(10, "a b"), (11, "c"), (12, "a  b")], "doc_id long, text string")
    new = spark.createDataFrame([(20, "a b"), (21, "d"), (22, "d"), (23, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup(new, old).collect()}
    assert got == {10: (10, 3, True), 12: (10, 3, False), 20: (10, 3, False), 11: (11, 1, True), 21: (21, 2, True), 22: (21, 2, False), 23: (23, 1, True)}


def test_empty(none):
    assert exact_dedup(none).count() == 0
    assert keep_first(none).count() == 0


def test_keep_first(odd):
    kept = keep_first(odd)
    assert kept.columns == odd.columns
    want = {i for i, _, _, k, _ in brute([(r["doc_id"], r["text"]) for r in odd.collect()]) if k}
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(x for x in want if x is not None)


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n, draws in [*((n, 20) for n in range(101)), (5000, 1)]:
        for _ in range(draws):
            digests = [bytes(d) for d in rng.integers(0, 256, (n, 32), dtype=np.uint8)]
            _, seed, shift, slot = displace(digests)
            assert sorted(slot) == list(range(n))
            assert [(int(hashed(s, [d])[0]) % n + f) % n for s, d, f in zip(seed, digests, shift, strict=True)] == list(slot)


def test_seeded_hash_is_that_of_the_lookup(spark):
    digests = [hashlib.sha256(bytes([i])).digest() for i in range(20)]
    rows = spark.createDataFrame([(s, d) for s in (0, 1, 77, 1 << 40) for d in digests], "seed long, digest binary")
    for seed, digest, h in rows.selectExpr("seed", "digest", "xxhash64(seed, digest)").collect():
        assert hashed(seed, [bytes(digest)])[0] == h


def test_small_histories(spark):
    for n in (*range(1, 14), 24, 40):
        rows = [(i, f"text {n} {i % (n - n // 4)}") for i in range(n)]
        got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_one_hot_digest(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'same text', concat('text ', id)) as text")
    got = exact_dedup(docs)
    assert got.filter("kept").count() == 2001
    assert got.filter("group_size = 1000 and keep_id = 0").count() == 1000


def test_rows_of_one_id(spark):
    """Of whole copies one stays, and of texts that share an id each."""
    rows = [(1, "a x"), (1, "a x"), (1, "a \tx"), (2, "a x"), (2, "b"), (2, "b"), (None, "c"), (None, "c"), (None, "a  x")]
    kept = keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r[0] or 0, " ".join(r[1].split())) for r in kept) == [(0, "c"), (1, "a x"), (2, "b")]
