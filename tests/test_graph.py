"""The algebra against a naive evaluation of the collected quads, on a small graph with many values a property."""

import datetime as dt
import re
import time

import pytest
from pyspark.sql import functions as F

from quadloom.functions import fulltext, values
from quadloom.functions.values import parsed_lanes
from quadloom.operators import query as Q
from quadloom.operators import terms as T
from quadloom.operators.query import Order, Query, Request
from quadloom.plans.graph import TYPE, Graph
from quadloom.plans.ontology import Ontology, closure

FACTS = [
    ("res:/1", TYPE, "C"), ("res:/2", TYPE, "B"), ("res:/3", TYPE, "A"), ("res:/4", TYPE, "D"), ("res:/1", "int", 5), ("res:/1", "int", 12), ("res:/2", "int", 9), ("res:/3", "int", 40), ("res:/1", "label", "Hello World"),
    ("res:/2", "label", "hellfire"), ("res:/2", "label", "L'École d'été"), ("res:/3", "label", "Shell"), ("res:/4", "label", "other"), ("res:/1", "knows", "res:/2"), ("res:/2", "likes", "res:/3"), ("res:/3", "knows", "res:/1"),
    ("res:/4", "knownBy", "res:/2"), ("onto:/x", TYPE, "A"), ("onto:/x", "label", "Hello"),
]


@pytest.fixture(scope="module")
def graph(spark):
    onto = Ontology.of(
        spark,
        {"A": [], "B": ["A"], "C": ["B"], "D": []},
        {"int": {"range": "xsd:int"}, "label": {"range": "xsd:string"}, "knows": {"range": "A", "inverse": "knownBy"}, "likes": {"range": "A", "parent": "knows"}, "knownBy": {"range": "A"}},
    )
    rows = [(s, p, str(o), "uri" if str(o).startswith("res:") or p == TYPE else "lit", "xsd:int" if isinstance(o, int) else "xsd:string", None, "g") for s, p, o in FACTS]
    bare = spark.createDataFrame(rows, "s string, p string, o string, o_kind string, dt string, lang string, g string")
    lanes = parsed_lanes()
    quads = bare.select("s", "p", "o", "o_kind", "dt", "lang", *[lanes[n].alias(n) for n in ("o_num", "o_long", "o_ts", "o_bool")], "g")
    return Graph.of_quads(quads, onto)


def ids(df):
    return sorted(r["r"].rpartition("/")[2] for r in df.collect())


def test_types(graph):
    assert ids(T.of_type(graph, "A")) == ["1", "2", "3", "x"]
    assert ids(T.of_type(graph, "A", inference=False)) == ["3", "x"]
    assert ids(T.of_type(graph, "B", "D")) == ["1", "2", "4"]
    assert ids(T.resource(graph, "res:/2")) == ["2"]
    assert ids(T.resource(graph, "res:/9")) == []


def test_numbers_are_compared_as_numbers(graph):
    for op, test in {"<": lambda x: x < 12, ">": lambda x: x > 9, "<=": lambda x: x <= 9, ">=": lambda x: x >= 12, "=": lambda x: x == 12}.items():
        value = {"<": 12, ">": 9, "<=": 9, ">=": 12, "=": 12}[op]
        assert ids(T.compare(graph, "int", op, value)) == sorted({s[-1] for s, p, o in FACTS if p == "int" and test(o)})


def test_text(graph):
    assert ids(T.compare(graph, "label", ":", "hello")) == ["1", "x"]
    assert ids(T.compare(graph, "label", ":", "'hello world'")) == ["1"]
    assert ids(T.compare(graph, "label", ":", "hell*")) == ["1", "2", "x"]
    assert ids(T.compare(graph, "label", ":", "ÉCOLE")) == ["2"]
    assert ids(T.compare(graph, "label", ":", "hel?")) == ["1", "2", "3", "x"]
    assert ids(T.compare(graph, "label", ":", "hello not world")) == ["x"]
    assert ids(T.compare(graph, "label", ":", "hello OR other")) == ["1", "4", "x"]
    assert ids(T.compare(graph, "label", "regexp", "^s.e")) == ["3"]
    assert ids(T.literal(graph, "hellfire")) == ["1", "2", "4"]


def test_properties_below(graph):
    assert ids(T.has(graph, "knows")) == ["1", "2", "3"]
    assert ids(T.compare(graph, "knows", None, None, inference=False)) == ["1", "3"]


def test_paths(graph):
    three = T.compare(graph, "int", "=", 40)
    assert ids(T.related(graph, "knows", three)) == ["2"]
    assert ids(T.related(graph, "knows", T.related(graph, "knows", three))) == ["1"]
    assert ids(T.related(graph, "knows", three, inverted=True)) == ["1"]
    assert ids(T.related(graph, None, three)) == ["2"]
    assert ids(T.related(graph, "knows", T.resource(graph, "res:/4"), both_ways=True)) == ["2"]
    assert ids(T.related_literal(graph, "knows", "shell")) == ["2"]
    with pytest.raises(ValueError, match="order"):
        T.related_literal(graph, "knows", "x", "<")


def test_connectives(graph):
    a, small = T.of_type(graph, "A"), T.compare(graph, "int", "<", 10)
    assert ids(T.all_of(a, small)) == ["1", "2"]
    assert ids(T.any_of(small, T.of_type(graph, "D"))) == ["1", "2", "4"]
    assert ids(T.but_not(a, small)) == ["3", "x"]
    assert ids(T.negation(graph, small)) == ["3", "4", "x"]
    # Some value that does not match, not no value that does.
    assert ids(T.not_matching(graph, "label", "hell")) == ["2", "4"]
    rows = T.optionally(T.of_type(graph, "B"), T.has(graph, "label", var="label")).collect()
    assert len(rows) == 3
    assert ids(T.any_of(T.has(graph, "int", "v", "o_long"), T.of_type(graph, "D"))) == ["1", "1", "2", "3", "4"]


def test_twice_negated_is_itself(graph):
    small = T.compare(graph, "int", "<", 10)
    assert ids(T.negation(graph, T.negation(graph, small))) == ids(small)


def test_aggregates(graph):
    numbers = T.has(graph, "int", var="v", lane="o_num")
    got = {r["r"]: r["x"] for r in T.aggregated(numbers, "v", "sum", "x").collect()}
    assert got == {"res:/1": 17.0, "res:/2": 9.0, "res:/3": 40.0}
    assert {r["r"]: r["x"] for r in T.aggregate_values(graph, "int", "distinct_average", "x").collect()}["res:/1"] == 8.5


def test_query_forms(graph):
    numbers = T.has(graph, "int", var="v", lane="o_long")
    assert [r["v"] for r in Query(graph, numbers, orders=[Order("v", descending=True)], limit=2, offset=1).results().collect()] == [12, 9]
    assert Query(graph, numbers).count().first()["n"] == 4
    assert Query(graph, T.has(graph, "int")).count().first()["n"] == 3
    assert Query(graph, T.of_type(graph, "A")).count().first()["n"] == 3  # ontology nodes are never results
    assert Query(graph, numbers).ask().first()["found"]
    assert not Query(graph, T.compare(graph, "int", ">", 99)).ask().first()["found"]
    rows = Query(graph, T.of_type(graph, "C", "D"), [Request("int", lane="o_long")]).results().collect()
    assert sorted((r["r"], r["reqProp1"]) for r in rows if r["reqProp1"]) == [("res:/1", 5), ("res:/1", 12)]
    assert len(rows) == 3
    assert len(Query(graph, T.of_type(graph, "C", "D"), [Request("int", optional=False)]).results().collect()) == 2


def test_weights(spark, graph):
    """Heavier keys first; of equal ones the later."""
    texts = [("ABC", 1), ("ABCD", 2), ("ABCE", 3), ("ABD", 3), ("AB", 2), ("A", 1)]
    term = spark.createDataFrame([(f"res:/{i + 1}", t, n) for i, (t, n) in enumerate(texts)], "r string, text string, rating int")
    got = Query(graph, term, orders=[Order("text", 2), Order("rating", 10, True)]).results().collect()
    assert [r["r"][-1] for r in got] == ["3", "4", "2", "5", "6", "1"] or [r["r"][-1] for r in got] == ["3", "4", "5", "2", "6", "1"]


def test_score_and_excerpt(graph):
    rows = Query(graph, T.compare(graph, "label", ":", "hello"), scored=("label", "hello")).results().collect()
    assert rows[0]["score"] > 0
    assert "Hello" in rows[0]["excerpt"]


def test_excerpt_is_what_its_pattern_finds(spark):
    around = "(?iu)(?s).{0,40}%s.{0,40}"
    texts = ["trash", "", "none", "a trash", "x" * 39 + " trash, TRASH\nand " + "y" * 60, "é\U0001f600 " * 30 + "Trash." + "\U0001f600" * 50, "trashy " * 9 + "trash", "a " * 30 + "\ntrash\n" + "trash " * 20, "x" * 50 + "trash", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for word in ("trash", "tras?", "trash*", "*sh", "'a trash'"):
        pattern = fulltext.parts_of(word)[0][0].pattern.removeprefix("(?iu)")
        expected = F.coalesce(F.regexp_extract("t", around % pattern, 0), F.lit(""))
        for r in df.select("t", fulltext.excerpt(F.col("t"), word).alias("got"), expected.alias("want")).collect():
            assert r["got"] == r["want"], (word, r["t"])


def test_excerpt_takes_about_as_long_as_the_score(spark):
    df = spark.range(16, numPartitions=4).select(F.repeat(F.lit("some words without the one "), 20_000).alias("t"), "id")

    def seconds(column):
        best = float("inf")
        for _ in range(3):
            begun = time.perf_counter()
            df.select(F.max(F.length(F.concat(column.cast("string"), F.col("id"))))).collect()
            best = min(best, time.perf_counter() - begun)
        return best

    text = F.concat("t", F.col("id"))  # not a constant
    assert seconds(fulltext.excerpt(text, "trash")) < 6 * seconds(fulltext.score(text, "trash")) + 0.3


def test_closure_of_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "d")], "sub string, sup string")
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "uri string")
    assert closure(edges, nodes).count() == 10


def test_ontology(graph):
    onto = graph.ontology
    assert {r["sup"] for r in onto.class_closure().filter("sub = 'C'").collect()} == {"A", "B", "C", "rdfs:Resource"}
    assert onto.inverse("knows") == "knownBy"
    assert onto.inverse("knownBy") == "knows"
    assert {r["uri"] for r in onto.find("LABEL").collect()} == {"label"}
    assert "likes" not in {r["uri"] for r in onto.without(["likes"]).properties().collect()}


@pytest.mark.parametrize(
    ("value", "range_", "want"),
    [
        ("1/4", "xsd:double", "0.25"), ("1/0", "xsd:double", None), ("x", "xsd:int", None), ("42", "xsd:int", "42"), ("1999", "xsd:dateTime", "1999-01-01T00:00:00"), ("TRUE", "xsd:boolean", "true"), ("maybe", "xsd:boolean", None),
        ("/tmp/a", "nie:url", "file:///tmp/a"), ("http://x", "nie:url", "http://x"), ("any", "xsd:string", "any"),
    ],
)
def test_coercion(spark, value, range_, want):
    row = spark.createDataFrame([(value, range_)], "o string, r string").select(values.coerced("o", "r").alias("x")).first()
    assert row["x"] == want


def test_formats(spark):
    row = spark.range(1).select(values.byte_size(F.lit(1536)).alias("a"), values.byte_size(F.lit(12)).alias("b"), values.duration(F.lit(3725)).alias("c"), values.any_date(F.lit("03.02.2001")).alias("d"), values.any_date(F.lit("2001-02-03T04:05:06Z")).alias("e"), values.contacts(F.lit("A B (x), C feat. D;E")).alias("f")).first()
    assert (row["a"], row["b"], row["c"]) == ("1.5 KiB", "12 B", "1:02:05")
    assert (row["d"], row["e"]) == (dt.datetime(2001, 2, 3), dt.datetime(2001, 2, 3, 4, 5, 6))
    assert row["f"] == ["A B", "C", "D", "E"]


def test_search_text_parts():
    parts, either = fulltext.parts_of("a and 'b c' OR not d")
    assert ([p.words for p in parts], either, parts[-1].negated) == (["a", "b c", "d"], True, True)
    assert fulltext.parts_of("") == ([], False)
    assert re.compile(fulltext.parts_of("abcd*")[0][0].pattern.replace(r"\p{L}\p{N}", "a-z0-9").replace("(?iu)", "(?i)")).search("xx abcdef")


def test_folders(spark, graph):
    files = [("res:/a", "file:///x/y/a.txt"), ("res:/b", "file:///x/b.txt"), ("res:/c", "file:///x.y/c.txt"), ("res:/d", "file:///z/d.txt")]
    rows = spark.createDataFrame([(s, "nie:url", u, "uri", "nie:url") for s, u in files] + [(s, TYPE, "A", "uri", None) for s, _ in files], "s string, p string, o string, o_kind string, dt string")
    lanes = parsed_lanes()
    g = Graph.of_quads(rows.select("s", "p", "o", "o_kind", "dt", F.lit(None).cast("string").alias("lang"), *[lanes[n].alias(n) for n in ("o_num", "o_long", "o_ts", "o_bool")], F.lit("g").alias("g")), graph.ontology)
    assert ids(Q.in_folder(g, "file:///x")) == ["a", "b"]
    assert ids(Q.in_folder(g, "file:///x", recursive=False)) == ["b"]
    assert ids(Q.file_query(g, include=[("file:///x", True), ("file:///z", True)], exclude=["file:///x/y"], files="A")) == ["b", "d"]
    assert ids(Q.never_opened(g, "A", "usage")) == ["a", "b", "c", "d"]
