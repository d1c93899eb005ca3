import re

import corpus_pipeline as P
from quadloom.llm.queries import oracle_sql, queries, unigram_model
from quadloom.llm.sentencepiece_codec import decode
from tests_llm_helpers import brute_components


def test_stages_one_by_one(spark, tmp_path):
    """Each stage's decisions, by brute force, on what its predecessor kept."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = dict(texts)
    names = [n for n, _ in P.STAGES]
    assert names == ["language ID", "exact dedup", "n-gram Jaccard join", "mixing sources", "SentencePiece"]
    for i, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, "/root/testdata/sf0.001")
        if i < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"file://{tmp_path}/{i}")
        docs = spark.read.parquet(f"file://{tmp_path}/{i}")
        rows = docs.collect()
        if i == 0:
            kept = {d: t for d, t in kept.items() if any(c.isalpha() for c in t)}
        elif i == 1:
            first = {}
            for d in sorted(kept):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", kept[d]), d)
            kept = {d: kept[d] for d in first.values()}
        elif i == 2:
            kept = {d: kept[d] for d, c in brute_components(kept, 5, 80).items() if d == c}
        if i < 3:
            assert {r["doc_id"]: r["text"] for r in rows} == kept
            assert len(rows) == len(kept)
        elif i == 3:
            assert {r["doc_id"] for r in rows} <= set(kept)
            mixed = sorted((r["doc_id"], r["text"]) for r in rows)
        else:
            model = unigram_model()
            assert sorted((r["doc_id"], decode(model, __import__("numpy").array(r["ids"]))) for r in rows) == mixed


def test_run(spark):
    assert P.run(spark, "/root/testdata/sf0.001").count() > 100


def test_registered():
    found = queries()
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in found) == list(range(1, 11))
    assert set(oracle_sql()) <= set(found)
