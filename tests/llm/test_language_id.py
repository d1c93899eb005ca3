import zlib

from quadloom.llm.language_id import keep_identified, language_id, predict, train


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = language_id(docs).collect()
    assert len(rows) == len(lang)
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_labels_of_held_out_documents_are_not_read(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = sorted(map(tuple, language_id(docs).collect()))
    changed = docs.selectExpr("doc_id", "text", "if(crc32(cast(doc_id as string)) % 3 = 1, 'xx', lang) as lang", "'s' as source", "n_chars")
    assert sorted(map(tuple, language_id(changed).collect())) == before


def test_odd(odd, none):
    rows = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language_id(odd).collect()]
    assert len(rows) == odd.count()
    for i, lang, score in rows:
        if i in (0, 1, 2, 14):
            assert (lang, score) == ("und", 0.0)
        elif i is not None:
            assert lang in ("en", "de", "fr")
    assert language_id(none).count() == 0
    assert keep_identified(none).count() == 0
    kept = keep_identified(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [3, 4, 5, 6, 7, 8, 9, 9, 11, 12, 13, 15]


def test_many_languages(spark):
    """More languages than a mask word has bits."""
    rows, n = [], 0
    for k in range(70):
        word = f"{chr(0x4E00 + 40 * k)}{chr(0x4E01 + 40 * k)}{chr(0x4E02 + 40 * k)}"
        rows += [(n + i, f"{word} {word}x{i}", f"l{k:02}") for i in range(6)]
        n += 6
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train(docs)
    assert len(model.languages) >= 68
    right = sum(predict(model, text)[0] == lang for _, text, lang in rows)
    assert right / len(rows) > 0.95


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "hello", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert [r["lang_pred"] for r in language_id(docs).collect()] == ["und", "und"]


def test_only_texts_with_a_language_are_kept(spark, none):
    english = [(i, f"the quick brown fox number {'abcdefgh'[i % 8]} jumps over the lazy dog", "en") for i in range(30)]
    others = [(100, "日本語の文章です", None), (101, "the lazy fox", None), (102, "12 !", "en"), (103, None, None), (None, "Это русский текст", None)]
    schema = "doc_id long, text string, lang string"
    kept = {r["doc_id"] for r in keep_identified(spark.createDataFrame(english + others, schema)).collect()}
    assert kept == {*range(30), 101}
    # Nothing was learned: no labels, or only on documents that are held out.
    for lang, i in ((None, 1), ("en", 2)):
        docs = spark.createDataFrame([(i, "hello", lang), (None, "日本語", None), (4, "12 34", None), (5, None, None)], schema)
        assert train(docs) is None
        assert {r["text"] for r in keep_identified(docs).collect()} == {"hello", "日本語"}
