import pytest

#: Documents with every odd case: null and empty texts, white space only, copies, near copies, repeated rows, null ids,
#: sources and languages, columns whose names operators use inside.
WORDS = [f"w{i}" for i in range(400)]


def doc(i, text, lang="en", source="a"):
    return (i, text, lang, source, len(text or ""), "x", 1, 2.0)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, keys int, n double"


@pytest.fixture(scope="session")
def odd(spark):
    base = " ".join(WORDS[:200])
    near = " ".join([*WORDS[:100], "other", *WORDS[101:200]])
    rows = [
        doc(0, None), doc(1, ""), doc(2, " \t\n "), doc(3, base), doc(4, base.replace(" ", "  ")), doc(5, near), doc(6, "one"), doc(7, "ONE"), doc(8, "one two", None, None),
        doc(9, " ".join(WORDS[200:]), "de", "b"), doc(9, " ".join(WORDS[200:]), "de", "b"), doc(None, "lost one", "en", "b"), doc(11, "é ünïcode 日本 🎉 ▁ <|endoftext|>", "fr", "c"),
        doc(12, "x" * 50_000, "en", "c"), doc(13, " ".join(WORDS * 60), "en", "a"), doc(14, "12 34 !!", "en", None), doc(15, base, None, "b"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")
