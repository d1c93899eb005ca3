import random
import re

import numpy as np
import pytest

from quadloom.llm.components import connected_components, merged_components
from quadloom.llm.common import Scratch
from quadloom.llm.shingle_join import Shingler, keep_representatives, pigeonhole_keys, shingle_join


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(rows, k, num, den):
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                i, j = sorted((find(i), find(j)))
                parent[j] = i
    return sorted((i, len(s), find(i)) for i, s in sets)


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


@pytest.mark.parametrize(("k", "num", "den"), [(3, 90, 100), (5, 80, 100)])
def test_against_brute_force(odd, small, k, num, den):
    for docs in (odd, small):
        assert sorted(map(tuple, shingle_join(docs, k, num, den).collect())) == brute(rows_of(docs), k, num, den)


def test_chains_and_large_groups(spark):
    """Groups of near copies in which not every pair links, and two groups that share a passage."""
    rng = random.Random(5)
    rows = []
    for g in range(4):
        base = [f"g{g}w{rng.randrange(500)}" for _ in range(120)] + [f"shared{i}" for i in range(40)]
        for _ in range(60):
            words = list(base)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
            if rng.random() < 0.2:
                base = words  # drift: the ends of a chain are far apart
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for k, num in ((3, 90), (5, 80)):
        assert sorted(map(tuple, shingle_join(docs, k, num, 100).collect())) == brute(rows, k, num, 100)


def test_no_linked_pair_without_a_key():
    """The pigeonhole promise, on random sets at and above the threshold, of all sizes."""
    rng = np.random.default_rng(3)
    for num in (80, 90):
        for n in [*range(1, 40), 64, 127, 128, 300, 1000, 5000]:
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            for _ in range(6):
                drop = rng.integers(0, max(1, n * (100 - num) // 100) + 1)
                add = rng.integers(0, max(1, n * (100 - num) // 100) + 1)
                b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64)]))
                common = len(np.intersect1d(a, b))
                if len(b) and 100 * common >= num * (len(a) + len(b) - common):
                    assert len(np.intersect1d(pigeonhole_keys(a, num, 100), pigeonhole_keys(b, num, 100)))


def test_shingler_keeps_words_apart():
    s = Shingler(2)
    assert set(s("a bc d")).isdisjoint(s("ab c d"))
    assert (s("A\tB\nc") == s("a b  c")).all()
    assert len(s("é É")) == 1


def test_empty(none, odd):
    assert shingle_join(none).count() == 0
    kept = keep_representatives(none)
    assert kept.count() == 0
    assert kept.columns == none.columns


def test_representatives(odd):
    kept = keep_representatives(odd)
    assert kept.columns == odd.columns
    want = {i for i, _, c in brute(rows_of(odd), 5, 80, 100) if i == c}
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(x for x in got if x is not None) == sorted(want)
    assert got.count(None) == 1


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "test"), "c").collect()))
    parent = {x: x for pair in links for x in pair}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    assert got == {x: find(x) for x in parent if any(x in p and p[0] != p[1] for p in links)}


def test_merged_components(spark):
    scratch = Scratch(spark, "test")
    table = lambda rows: spark.createDataFrame(rows, "a long, b long")
    parts = connected_components(table([(1, 2), (2, 3), (10, 11), (20, 21)]), scratch, "before")
    got = {name: sorted(map(tuple, merged_components(parts, table(links), scratch, name).collect())) for name, links in {"none": [], "inside": [(1, 3)], "more": [(3, 11), (21, 7), (30, 31)]}.items()}
    before = [(1, 1), (2, 1), (3, 1), (10, 10), (11, 10), (20, 20), (21, 20)]
    assert got["none"] == got["inside"] == before
    assert got["more"] == [(1, 1), (2, 1), (3, 1), (7, 7), (10, 1), (11, 1), (20, 7), (21, 7), (30, 30), (31, 30)]


def test_one_id_with_several_texts(spark):
    x, y, z = (" ".join(f"{c}{i}" for i in range(60)) for c in "xyz")
    rows = [(1, x), (5, x + " more"), (5, y), (5, y + " more"), (7, y + " end"), (5, z), (5, z), (5, ""), (5, None), (5, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for _ in range(2):
        got = sorted(map(tuple, shingle_join(docs.repartition(3), 3, 80, 100).collect()))
        assert got == [(1, 58, 1), (5, 0, 5), (5, 0, 5), (5, 0, 5), (5, 58, 5), (5, 58, 5), (5, 58, 5), (5, 59, 1), (5, 59, 5), (7, 59, 5)]
    kept = [tuple(r) for r in keep_representatives(docs, 3, 80, 100).collect()]
    assert len([r for r in kept if r[1] and r[1].strip()]) == 3  # the first of x, one of y, one of z
    assert {r[0] for r in kept} == {1, 5}
    assert (1, x) in kept
    assert (5, z) in kept


def test_texts_reach_python_in_small_batches(spark, monkeypatch):
    from quadloom.llm import shingle_join as J

    setting, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", {}
    before, table = spark.conf.get(setting), J.Scratch.table
    monkeypatch.setattr(J.Scratch, "table", lambda self, df, name, *a: seen.update({name: int(spark.conf.get(setting))}) or table(self, df, name, *a))
    docs = spark.createDataFrame([(i, f"a b c d e f {i // 2}") for i in range(20)], "doc_id long, text string")
    assert J.shingle_join(docs, words=3, num=90, den=100).count() == 20
    assert {seen[n] for n in seen if n == "signed" or n.startswith("sets")} == {J.BATCH_ROWS}
    assert spark.conf.get(setting) == before
