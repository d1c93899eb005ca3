from collections import Counter

import pytest
from pyspark.sql import functions as F

from quadloom.llm.exact_dedup import keep_first
from quadloom.llm.shingle_join import keep_representatives
from quadloom.llm.source_mix import BLOCK_WORDS, Mix, mixed_documents, mixed_sizes, runs_of, shuffled, source_targets


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Take off sources at their limit until none is above it."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > most * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        free -= over
    return out


@pytest.mark.parametrize("sizes", [{"a": 10}, {"a": 100, "b": 1, None: 50}, {"a": 0, "b": 0}, {f"s{i}": 7 ** (i % 5) for i in range(23)}, {"é": 5, "z": 1000, "A": 3, None: 0}])
def test_targets(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in source_targets(table).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_shuffle_is_a_permutation(spark):
    for n in (1, 2, 7, 64, 1001):
        x = spark.range(n).select(shuffled(F.col("id"), F.lit(n).cast("long"), F.lit(1), F.lit(2)).alias("x"))
        got = [r["x"] for r in x.collect()]
        assert sorted(got) == list(range(n))
        if n > 50:
            assert sum(a == i for i, a in enumerate(got)) < n / 8


def test_mix(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixed_sizes(docs).collect()
    sizes = {r["doc_id"]: len((r["text"] or "").split()) for r in docs.collect()}
    assert len(rows) == len(sizes)
    by_source, targets = Counter(), {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert r["size"] == sizes[r["doc_id"]]
        by_source[r["source"]] += r["taken"]
        targets[r["source"]] = r["target"]
    for source, target in targets.items():
        assert by_source[source] == pytest.approx(target, rel=0.01)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixed_sizes(docs.repartition(7)).collect()))


def test_blocks_are_taken_equally_often(small):
    mix = Mix(small)
    slots = mix.slots().collect()
    assert len({(s["shard"], s["slot"]) for s in slots}) == len(slots)
    for source in mix.sources.collect():
        times = Counter(s["block"] for s in slots if s["sid"] == source["sid"])
        assert sum(times.values()) == source["slots"]
        assert set(times) <= set(range(source["blocks"]))
        if source["slots"] >= source["blocks"]:
            assert max(times.values()) - min(times[b] for b in range(source["blocks"])) <= 1
    words = mix.pieces().groupBy("shard", "slot").agg(F.sum("words").alias("n")).agg(F.max("n")).first()[0]
    assert words == BLOCK_WORDS


def test_taken_is_what_the_pieces_hold(spark):
    """By pages of blocks, of documents within a block, over many pages, and of odd starts, the same words are taken."""
    sizes = [1, 2, 31, 32, 33, 64, 2047, 2048, 2049, 5000, 12_345, 0, 7]
    rows = [(i, "w " * sizes[i % len(sizes)], "abc"[i % 3] if i % 7 else None) for i in range(150)]
    mix = Mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    want, blocks = Counter(), {}
    for r in mix.pieces().collect():
        of = r["sid"], r["doc_id"], r["start"], r["epoch"]
        want[of] += r["words"]
        blocks.setdefault(of, []).append((r["first"], r["words"]))
    rows = mix.taken().select("sid", "doc_id", "start", "epoch", "words", runs_of_one().alias("runs")).collect()
    got, runs = Counter(), {}
    for r in rows:
        of = r["sid"], r["doc_id"], r["start"], r["epoch"]
        got[of] += r["words"]
        runs.setdefault(of, []).extend(map(tuple, r["runs"]))
    assert got == want
    assert {k: sorted(v) for k, v in runs.items()} == {k: sorted(v) for k, v in blocks.items()}
    assert len(rows) < sum(map(len, blocks.values())) / 10


def runs_of_one():
    return runs_of(F.array(F.struct("page", "bits")))


def test_texts_are_shuffled_once(spark, small, capsys):
    """A key that goes through a table is not cast for the join: that would shuffle the texts again."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        mixed_documents(small).explain()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = capsys.readouterr().out.split("SortMergeJoin", 1)[1]
    texts = plan[: plan.index("FileScan")]  # the side of the join that has the texts
    assert "text#" in texts
    assert texts.count("Exchange") == 1


def test_only_what_is_read_is_left(small, tmp_path, monkeypatch):
    monkeypatch.setattr("quadloom.llm.common.shared_dir", lambda spark: f"file://{tmp_path}")
    got = [keep_first(small), keep_representatives(small), mixed_documents(small)]
    left = {p.parent.name.rsplit("-", 1)[0] + "/" + p.name for p in tmp_path.glob("*/*") if p.is_dir()}
    assert left == {"exact_dedup/others", "shingle_join/others", "source_mix/documents", "source_mix/sources"}
    assert all(d.count() for d in got)


def test_odd(odd, none):
    rows = mixed_sizes(odd).collect()
    assert len(rows) == odd.count()
    assert all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    assert mixed_sizes(none).count() == 0
    assert mixed_documents(none).count() == 0


def test_documents(small):
    want = {r["doc_id"]: r["taken"] for r in mixed_sizes(small).collect()}
    got = mixed_documents(small)
    assert got.columns == small.columns
    texts = {r["doc_id"]: r["text"] for r in small.collect()}
    taken = Counter()
    for r in got.collect():
        taken[r["doc_id"]] += len(r["text"].split())
        assert set(r["text"].split()) <= set(texts[r["doc_id"]].split())
        assert r["n_chars"] == len(r["text"])
    assert taken == Counter({i: n for i, n in want.items() if n})


def test_native(small, capsys):
    mixed_sizes(small).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan
    assert "Cartesian" not in plan


def test_no_row_goes_missing_by_its_id(spark):
    rows = [(i % 3 if i % 4 else None, f"t{i} " * 64, "ab"[i % 2]) for i in range(40)]
    docs = spark.createDataFrame(rows + rows[:2] + [(1, None, "a"), (None, " ", "b")], "doc_id long, text string, source string")
    want = mixed_sizes(docs).groupBy("source").agg(F.sum("taken")).collect()
    taken, seen = Counter(), Counter()
    got = mixed_documents(docs).collect()
    for r in got:
        taken[r["source"]] += len(r["text"].split())
        seen[r["doc_id"], r["text"].split()[0]] += len(r["text"].split())
    assert taken == Counter(dict(map(tuple, want)))
    assert {(i, t.split()[0]) for i, t, s in rows if s == "b"} <= set(seen)  # b is taken at least once
    assert seen[rows[0][0], "t0"] > 2 * 2 * 60  # two copies, each taken twice, about
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixed_documents(docs.repartition(5)).collect()), key=str)


def test_draws_are_multinomial(spark, monkeypatch):
    """Counts of a source over shards have a multinomial's mean and variance, and sum up to the shard's slots."""
    monkeypatch.setattr("quadloom.llm.source_mix.SHARD_SLOTS", 100)
    docs = spark.range(4000).selectExpr("id as doc_id", "concat('s', id % 3) as source", "repeat('w ', 160) as text")
    mix = Mix(docs)
    total = {r["sid"]: r["slots"] for r in mix.sources.collect()}
    every = sum(total.values())
    shards = -(-every // 100)
    counts = Counter()
    for r in mix.drawn().collect():
        counts[r["shard"], r["sid"]] = r["count"]
    full = [s for s in range(every // 100)]
    assert all(sum(counts[s, i] for i in total) == 100 for s in full)
    assert {s for s, _ in counts} == set(range(shards))
    for i, n in total.items():
        p = n / every
        drawn = [counts[s, i] for s in full]
        mean = sum(drawn) / len(drawn)
        variance = sum((x - mean) ** 2 for x in drawn) / (len(drawn) - 1)
        assert abs(mean - 100 * p) < 5 * (100 * p * (1 - p) / len(drawn)) ** 0.5
        assert 0.7 < variance / (100 * p * (1 - p)) < 1.3
    slots = Counter(r["sid"] for r in mix.slots().collect())
    assert slots == total
