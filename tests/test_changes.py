"""Mutations, identification, closures, jobs, sources and streams."""

import pytest
from pyspark.sql import functions as F

from quadloom.operators import access, describe, identify, jobs
from quadloom.operators import mutate as M
from quadloom.plans.graph import CREATED, MODIFIED, TYPE
from quadloom.plans.ontology import Ontology
from quadloom.sources import files, rdf
from quadloom.streaming import file_events, live

NOW, LATER = "2024-01-01T00:00:00", "2024-02-02T00:00:00"
ROW = "s string, p string, o string"


@pytest.fixture(scope="module")
def onto(spark):
    return Ontology.of(
        spark,
        {"Contact": [], "Person": ["Contact"], "Mail": []},
        {
            "fullname": {"range": "xsd:string", "max_card": 1}, "nick": {"range": "xsd:string"}, "age": {"range": "xsd:int", "max_card": 1, "defining": False}, "knows": {"range": "Contact", "defining": True},
            "abstract": {}, "nie:url": {"range": "nie:url", "max_card": 1}, "nao:prefLabel": {"range": "xsd:string"}, TYPE: {"range": "rdfs:Class", "defining": True}, M.SUBRESOURCE: {"range": "rdfs:Resource", "defining": True},
        },
    )


@pytest.fixture(scope="module")
def start(spark, onto):
    rows = [
        ("res:/a", TYPE, "Person"), ("res:/a", "fullname", "Ann"), ("res:/a", "nick", "annie"), ("res:/b", TYPE, "Person"), ("res:/b", "fullname", "Bob"), ("res:/b", "knows", "res:/a"),
        ("res:/c", TYPE, "Contact"), ("res:/c", "fullname", "Ann"), ("res:/c", "age", "30"),
    ]
    df = spark.createDataFrame(rows, ROW)
    empty = M.complete(M.checked(df.limit(0), onto), M.graph_of("app"))
    done = M.add(empty, M.complete(M.checked(df, onto), M.graph_of("app"))).quads
    return done.checkpoint() if spark.sparkContext.getCheckpointDir() else done.cache()


def facts(quads, *properties):
    return sorted((r["s"][-1], r["p"], r["o"]) for r in quads.filter(F.col("p").isin(*properties)).collect())


def rows(spark, *r):
    return spark.createDataFrame(list(r), ROW)


def test_add(spark, onto, start):
    done = M.add_property(start, onto, rows(spark, ("res:/a", "nick", "ann"), ("res:/a", "nick", "annie"), ("res:/c", "age", "30")), "app", NOW)
    assert facts(done.quads, "nick") == [("a", "nick", "ann"), ("a", "nick", "annie")]
    assert sorted(map(tuple, done.changes.collect())) == [("res:/a", "nick", "ann", True)]
    assert facts(done.quads, MODIFIED) == [("a", MODIFIED, NOW)]
    other = M.add_property(start, onto, rows(spark, ("res:/a", "nick", "annie")), "other", NOW)  # said by two applications
    assert {r["g"] for r in other.quads.filter("p = 'nick'").collect()} == {"graph:/app", "graph:/other"}


@pytest.mark.parametrize(
    ("bad", "why"),
    [
        (("res:/a", "fullname", "Other"), "too many"), (("res:/a", "age", "x"), "fit"), (("res:/a", "nothing", "x"), "unknown"), (("res:/a", "abstract", "x"), "without a range"), (("res:/a", CREATED, NOW), "protected"),
        (("", "nick", "x"), "empty"),
    ],
)
def test_violations(spark, onto, start, bad, why):
    with pytest.raises(M.Violation, match=why):
        M.add_property(start, onto, rows(spark, bad), "app", NOW)


def test_an_application_is_needed(spark, onto, start):
    with pytest.raises(M.Violation, match="application"):
        M.add_property(start, onto, rows(spark, ("res:/a", "nick", "x")), "", NOW)


def test_set_and_remove(spark, onto, start):
    done = M.set_property(start, onto, rows(spark, ("res:/a", "nick", "x"), ("res:/a", "nick", "annie"), ("res:/b", "fullname", "Rob")), "app", NOW)
    assert facts(done.quads, "nick", "fullname") == [("a", "fullname", "Ann"), ("a", "nick", "annie"), ("a", "nick", "x"), ("b", "fullname", "Rob"), ("c", "fullname", "Ann")]
    assert sorted(map(tuple, done.changes.collect())) == [("res:/a", "nick", "x", True), ("res:/b", "fullname", "Bob", False), ("res:/b", "fullname", "Rob", True)]
    gone = M.remove_property(start, rows(spark, ("res:/a", "nick", "annie"), ("res:/a", "nick", "no")), NOW)
    assert facts(gone.quads, "nick") == []
    all_gone = M.remove_properties(start, rows(spark, ("res:/c", TYPE, ""), ("res:/c", "fullname", ""), ("res:/c", "age", "")), NOW)
    assert all_gone.quads.filter("s = 'res:/c'").count() == 0


def test_create(spark, onto, start):
    new = spark.createDataFrame([("res:/n", ["Person", "Contact"], "New"), ("res:/m", [], None)], "s string, types array<string>, label string")
    done = M.create_resources(start, onto, new, "app", NOW)
    assert [f for f in facts(done.quads, TYPE) if f[0] in "nm"] == [("m", TYPE, "rdfs:Resource"), ("n", TYPE, "Person")]
    with pytest.raises(M.Violation, match="unknown classes"):
        M.create_resources(start, onto, spark.createDataFrame([("res:/n", ["No"], None)], "s string, types array<string>, label string"), "app", NOW)


def test_remove_resources(spark, onto, start):
    linked = M.add_property(start, onto, rows(spark, ("res:/b", M.SUBRESOURCE, "res:/c")), "app", NOW).quads
    done = describe.remove_resources(linked, spark.createDataFrame([("res:/b",)], "s string"), LATER, with_subresources=True)
    assert {r["s"] for r in done.quads.collect()} == {"res:/a"}
    kept = describe.remove_resources(M.add_property(linked, onto, rows(spark, ("res:/a", "knows", "res:/c")), "app", NOW).quads, spark.createDataFrame([("res:/b",)], "s string"), LATER, with_subresources=True)
    assert {r["s"] for r in kept.quads.collect()} == {"res:/a", "res:/c"}  # linked from outside
    object_gone = describe.remove_resources(start, spark.createDataFrame([("res:/a",)], "s string"), LATER)
    assert facts(object_gone.quads, "knows", MODIFIED) == [("b", MODIFIED, LATER)]


def test_store_and_identify(spark, onto, start):
    batch = rows(spark, ("_:1", TYPE, "Contact"), ("_:1", "fullname", "Bob"), ("_:2", TYPE, "Contact"), ("_:2", "fullname", "Zoe"), ("_:2", "knows", "_:1"), ("_:3", TYPE, "Contact"), ("_:3", "fullname", "Zoe"), ("_:3", "knows", "_:1"))
    done, names = M.store_resources(start, onto, batch, "app", NOW, identify.identifier(onto))
    got = {r["blank"]: r["s"] for r in names.collect()}
    assert got["_:1"] == "res:/b"
    assert got["_:2"] == got["_:3"]
    assert got["_:2"].startswith("res:/app/")
    assert done.quads.filter("o = 'Zoe'").count() == 1
    assert done.quads.filter("p = 'knows' and o = 'res:/b'").count() == 1
    again, names2 = M.store_resources(done.quads, onto, batch, "app", LATER, identify.identifier(onto))
    assert {r["blank"]: r["s"] for r in names2.collect()} == got
    assert again.changes.count() == 0
    with pytest.raises(M.Violation, match="unknown blank"):
        M.store_resources(start, onto, rows(spark, ("_:1", "knows", "_:9")), "app", NOW)


def test_store_modes(spark, onto, start):
    two = rows(spark, ("res:/a", "fullname", "X"), ("res:/a", "fullname", "Y"))
    with pytest.raises(M.Violation, match="too many"):
        M.store_resources(start, onto, two, "app", NOW)
    assert facts(M.store_resources(start, onto, two, "app", NOW, lazy=True)[0].quads.filter("s = 'res:/a'"), "fullname") == [("a", "fullname", "X")]
    one = rows(spark, ("res:/a", "fullname", "X"), ("res:/a", "nick", "n"))
    assert facts(M.store_resources(start, onto, one, "app", NOW, overwrite=True)[0].quads.filter("s = 'res:/a'"), "fullname", "nick") == [("a", "fullname", "X"), ("a", "nick", "annie"), ("a", "nick", "n")]
    assert facts(M.store_resources(start, onto, one, "app", NOW, overwrite_all=True)[0].quads.filter("s = 'res:/a'"), "nick") == [("a", "nick", "n")]


def test_identification_prefers_more_and_older(spark, onto, start):
    # Ann is a Person (a) and a Contact (c): a Person must be a.
    batch = rows(spark, ("_:1", TYPE, "Person"), ("_:1", "fullname", "Ann"))
    assert [tuple(r) for r in identify.by_properties(batch, start, onto).collect()] == [("_:1", "res:/a")]
    # A nick that differs speaks against a; c has none.
    batch = rows(spark, ("_:1", TYPE, "Contact"), ("_:1", "fullname", "Ann"), ("_:1", "nick", "other"))
    assert [tuple(r) for r in identify.by_properties(batch, start, onto).collect()] == [("_:1", "res:/c")]


def test_merge(spark, onto, start):
    done = M.merge_resources(start, onto, spark.createDataFrame([("res:/a", "res:/c")], "from string, to string"))
    assert facts(done.quads, "fullname", "nick", "knows", "age") == [("b", "fullname", "Bob"), ("b", "knows", "res:/c"), ("c", "age", "30"), ("c", "fullname", "Ann"), ("c", "nick", "annie")]
    assert done.quads.filter("s = 'res:/a' or o = 'res:/a'").count() == 0


def test_by_application(spark, onto, start):
    both = M.add_property(start, onto, rows(spark, ("res:/a", "nick", "two"), ("res:/z", "nick", "zed")), "two", NOW).quads
    done = M.remove_data_by_application(both, "two", LATER)
    assert done.quads.filter("s = 'res:/z'").count() == 0
    assert facts(done.quads, "nick", MODIFIED) == [("a", MODIFIED, LATER), ("a", "nick", "annie")]
    some = M.remove_data_by_application(both, "two", LATER, spark.createDataFrame([("res:/a",)], "s string"))
    assert facts(some.quads, "nick") == [("a", "nick", "annie"), ("z", "nick", "zed")]


def test_move_urls(spark, onto, start):
    urls = M.add_property(start, onto, rows(spark, ("res:/a", "nie:url", "file:///x"), ("res:/b", "nie:url", "file:///x/y/f"), ("res:/c", "nie:url", "file:///xy")), "app", NOW).quads
    moves = spark.createDataFrame([("file:///x", "file:///n"), ("file:///x/y", "file:///m")], "old string, new string")
    assert facts(M.move_urls(urls, moves), "nie:url") == [("a", "nie:url", "file:///n"), ("b", "nie:url", "file:///m/f"), ("c", "nie:url", "file:///xy")]
    found = {r["name"]: r["s"] for r in M.resolve_urls(urls, spark.createDataFrame([("file:///x",), ("res:/b",), ("http://no",)], "name string")).collect()}
    assert found == {"file:///x": "res:/a", "res:/b": "res:/b", "http://no": None}


def test_describe_and_export(spark, onto, start, tmp_path):
    got = describe.describe(start, onto, spark.createDataFrame([("res:/b",)], "s string"))
    assert sorted((r["s"][-1], r["p"]) for r in got.collect()) == [("a", "fullname"), ("a", "nick"), ("a", TYPE), ("b", "fullname"), ("b", "knows"), ("b", TYPE)]
    rdf.write_nquads(got, f"file://{tmp_path}/x")
    back = rdf.read_nquads(spark, f"file://{tmp_path}/x")
    columns = ["s", "p", "o", "o_kind", "dt", "g"]
    assert sorted(map(tuple, back.filter("o_kind = 'lit'").select(*columns).collect())) == sorted(map(tuple, got.filter("o_kind = 'lit'").select(*columns).collect()))
    hidden = describe.anonymized(got, "res:/")
    assert not [r for r in hidden.collect() if "res:/" in r["s"] + r["o"]]
    assert hidden.select("s").distinct().count() == 2


def test_jobs(spark, onto, start):
    assert {tuple(r) for r in jobs.duplicate_groups(start, "Person", "fullname").collect()} == set()
    twin = M.add_property(start, onto, rows(spark, ("res:/d", TYPE, "Person"), ("res:/d", "fullname", "Ann"), ("res:/e", "nick", "untyped")), "app", NOW).quads
    mapping = jobs.duplicate_groups(twin, "Person", "fullname")
    assert {tuple(r) for r in mapping.collect()} == {("res:/d", "res:/a")}
    assert {tuple(r) for r in jobs.duplicate_contacts(twin, "Person", "fullname").collect()} == set()  # a has a nick
    assert jobs.merged(twin, mapping).filter("s = 'res:/d'").count() == 0
    assert [r["s"] for r in jobs.untyped(twin.filter(F.col("p") != MODIFIED)).collect()] == ["res:/e"]
    assert [r["s"] for r in jobs.missing_key(twin, "Contact", "nick").collect()] == ["res:/c"]
    graphs = spark.createDataFrame([("graph:/app", "x", "instance", 2), ("graph:/b", "x", "instance", 1)], "g string, app string, kind string, created int")
    double = start.unionByName(start.withColumn("g", F.lit("graph:/b")))
    assert {r["g"] for r in jobs.distinct_statements(double, graphs).collect()} == {"graph:/b"}
    assert jobs.one_graph_per_app(double, graphs).count() == start.count()
    assert jobs.single_values(double.withColumn("o", F.when(F.col("g") == "graph:/b", "new").otherwise(F.col("o"))), ["age"], graphs).filter("p = 'age'").first()["o"] == "new"
    assert jobs.new_scheme(start, "res:/a", "res:/new/").filter("p = 'nie:url' and o = 'res:/a'").count() == 1


def test_access(start, onto):
    labels = {r["s"]: r["label"] for r in access.generic_label(start.withColumn("p", F.when(F.col("p") == "fullname", "nco:fullname").otherwise(F.col("p"))), start).collect()}
    assert labels == {"res:/a": "Ann", "res:/b": "Bob", "res:/c": "Ann"}
    assert {r["p"]: r["values"] for r in access.load(start, "res:/a").collect()}["nick"] == ["annie"]
    assert {r["s"] for r in access.types_of(start, onto).filter("type = 'Contact'").collect()} == {"res:/a", "res:/b", "res:/c"}
    assert access.records(start, ["nick", "age"]).count() == 2
    assert start.limit(1).select(access.expanded(F.lit("rdf:type")).alias("x")).first()["x"].endswith("#type")


TRIG = """@prefix ex: <http://ex/> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
ex:g { ex:Sub a rdfs:Class ; rdfs:subClassOf ex:Sup , ex:Other ; rdfs:label "Sub \\"x\\""@en . ex:p a rdfs:Property ; rdfs:range xsd:int ; ex:n 5 . }  # end
"""


def test_whole_file_formats(spark, tmp_path):
    (tmp_path / "a.trig").write_text(TRIG)
    quads = rdf.read_documents(spark, f"file://{tmp_path}/a.trig", "trig", "graph:/o")
    got = {(r["s"], r["p"].rpartition("/")[2], r["o"], r["g"]) for r in quads.collect()}
    assert ("http://ex/Sub", "rdf-schema#subClassOf", "http://ex/Other", "http://ex/g") in got
    assert ("http://ex/Sub", "rdf-schema#label", 'Sub "x"', "http://ex/g") in got
    onto = rdf.load_ontology(quads)
    assert {r["sup"] for r in onto.class_closure().filter("sub = 'http://ex/Sub'").collect()} == {"http://ex/Sub", "http://ex/Sup", "http://ex/Other"}
    assert onto.properties().first()["range"] == "xsd:int"
    xml = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://ex/"><e:T rdf:about="http://a"><e:p>x</e:p><e:q rdf:resource="http://b"/></e:T></rdf:RDF>'
    assert [(p, o) for _, p, o, *_ in rdf.rdfxml_rows(xml)] == [(rdf.RDF_TYPE, "http://ex/T"), ("http://ex/p", "x"), ("http://ex/q", "http://b")]


def test_backup_and_store(spark, onto, start, tmp_path):
    rdf.backup(start, f"file://{tmp_path}/b")
    back = rdf.restore(spark, f"file://{tmp_path}/b")
    keys = ["s", "p", "o", "o_kind", "g"]
    assert sorted(map(tuple, back.select(*keys).collect())) == sorted(map(tuple, start.select(*keys).collect()))
    rdf.save(start, f"file://{tmp_path}/q")
    assert rdf.load(spark, f"file://{tmp_path}/q").filter("p = 'nick'").count() == 1
    assert sorted(map(tuple, rdf.load(spark, f"file://{tmp_path}/q").select(*keys).collect())) == sorted(map(tuple, start.select(*keys).collect()))


def test_files(spark, tmp_path):
    (tmp_path / "in" / ".hid").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_text("one two\nthree")
    (tmp_path / "in" / "b.png").write_bytes(b"x")
    (tmp_path / "in" / ".hid" / "c.txt").write_text("no")
    root = f"file:{tmp_path}/in"
    found = files.walk(spark, f"{root}")
    kept = found.filter(files.should_index(F.col("path"), [f"file:{tmp_path}"], [f"file:{tmp_path}/no"], ["*.bak"]))
    assert {r["name"]: r["type"] for r in files.attributes(kept).collect()} == {"a.txt": "nfo:TextDocument", "b.png": "nfo:Image"}
    assert files.fresh(found, found.limit(1)).count() == found.count() - 1
    text = files.plain_text(spark, f"{root}/a.txt").first()
    assert (text["words"], text["lines"], text["chars"]) == (3, 2, 13)
    files.EXTRACTORS["text/"] = lambda data: [("n", str(len(data)))]
    files.EXTRACTORS["image/"] = lambda data: 1 / 0
    try:
        assert {(r["p"], r["o"]) for r in files.extracted(spark, root).collect() if "hid" not in r["url"]} == {("n", "13"), ("error", "ZeroDivisionError('division by zero')")}
    finally:
        files.EXTRACTORS.clear()


def test_live_query(spark, tmp_path):
    feed = f"{tmp_path}/feed"
    table = {"rows": [("res:/1", 1), ("res:/2", 1)]}
    query = live.LiveQuery(spark, lambda: spark.createDataFrame(table["rows"], "r string, v int"), f"file://{tmp_path}/snap", ["p"])
    query.list()
    seen = []
    spark.createDataFrame([("res:/3", "p", "x", True, None), ("res:/4", "other", "x", True, None)], live.FEED).write.parquet(feed)
    table["rows"] = [("res:/2", 9), ("res:/3", 1)]
    stream = spark.readStream.schema(live.FEED).parquet(feed)
    query.run(stream, lambda df, n: seen.extend(map(tuple, df.collect())), available_now=True).awaitTermination(60)
    assert sorted(seen) == [("res:/1", "removed"), ("res:/3", "added")]
    query.emit_updates = True
    table["rows"] = [("res:/2", 10), ("res:/3", 1)]
    assert [tuple(r) for r in query.update().collect()] == [("res:/2", "updated")]


def test_live_query_restarts(spark, tmp_path):
    feed, folder, rows = f"{tmp_path}/feed", f"file://{tmp_path}/snap", [("res:/1",)]
    make = lambda: live.LiveQuery(spark, lambda: spark.createDataFrame(rows, "r string"), folder)
    make().list()
    change = spark.createDataFrame([("res:/2", "p", "x", True, None)], live.FEED)
    change.write.parquet(feed)
    stream = spark.readStream.schema(live.FEED).parquet(feed)
    rows = [("res:/2",)]
    with pytest.raises(Exception, match="lost"):
        make().run(stream, lambda df, n: (_ for _ in ()).throw(RuntimeError("lost")), available_now=True).awaitTermination(60)
    seen = []
    sink = lambda df, n: seen.extend(map(tuple, df.collect()))
    make().run(stream, sink, available_now=True).awaitTermination(60)
    assert sorted(seen) == [("res:/1", "removed"), ("res:/2", "added")]  # the batch that failed is told again
    make().run(stream, sink, available_now=True).awaitTermination(60)
    assert len(seen) == 2  # and no batch twice
    rows = [("res:/2",), ("res:/3",)]
    change.write.mode("append").parquet(feed)
    make().run(stream, sink, available_now=True).awaitTermination(60)
    assert seen[2:] == [("res:/3", "added")]


def test_change_feed(spark, onto):
    changes = spark.createDataFrame([("res:/1", "nick", "x", True), ("res:/1", "nick", "y", False), ("res:/1", TYPE, "Person", True), ("res:/2", "age", "3", True)], "s string, p string, o string, added boolean")
    types = spark.createDataFrame([("res:/1", "Person")], "s string, type string")
    who = spark.createDataFrame([("r", "res:/2", None, None), ("p", None, "nick", None), ("t", None, None, "Contact"), ("tp", None, "age", "Contact"), ("rp", "res:/1", "age", None), ("all", None, None, None)], live.SUBSCRIPTIONS)
    got = {(r["watcher"], r["s"], r["p"]) for r in live.routed(changes, who, types, onto).collect()}
    assert got == {("r", "res:/2", "age"), ("p", "res:/1", "nick"), ("t", "res:/1", "nick"), ("all", "res:/1", "nick"), ("all", "res:/2", "age")}
    assert [tuple(r) for r in live.types_changed(changes).collect()] == [("res:/1", ["Person"], [])]
    one = spark.createDataFrame([("res:/1",)], "s string")
    assert [tuple(r) for r in live.lifecycle(changes, one.limit(0), one).collect()] == [("res:/1", "created")]


def test_move_pairing_stream(spark, tmp_path):
    path, schema = f"{tmp_path}/moves", "cookie long, path string, kind string"
    spark.createDataFrame([(1, "/a", "movedFrom"), (1, "/b", "movedTo"), (2, "/c", "movedTo"), (3, "/d", "movedFrom")], schema).write.parquet(path)
    query = file_events.paired_moves(spark.readStream.schema(schema).parquet(path)).writeStream.format("memory").queryName("moves").outputMode("append").trigger(processingTime="500 milliseconds").start()
    try:
        import time

        for _ in range(40):
            time.sleep(0.5)
            if len(got := {tuple(r) for r in spark.table("moves").collect()}) >= 4:
                break
    finally:
        query.stop()
    assert got == {("moved", "/a", "/b"), ("created", None, "/c"), ("closedWrite", None, "/c"), ("deleted", "/d", None)}


def test_quiet_queue_stream(spark, tmp_path):
    path, schema = f"{tmp_path}/q", "url string"
    spark.createDataFrame([("a",), ("a",), ("a",), ("b",)], schema).write.parquet(path)
    query = file_events.first_then_quiet(spark.readStream.schema(schema).parquet(path)).writeStream.format("memory").queryName("quiet").outputMode("append").trigger(processingTime="500 milliseconds").start()
    try:
        import time

        for _ in range(60):
            time.sleep(0.5)
            if len(got := sorted(tuple(r) for r in spark.table("quiet").collect())) >= 3:
                break
    finally:
        query.stop()
    assert got == [("a", 0), ("a", 2), ("b", 0)]


def test_classification(spark):
    masks = spark.createDataFrame([(0x40,), (0x80,), (0x100 | 0x40000000,), (0,)], "m int")
    assert [r[0] for r in masks.select(file_events.classified(F.col("m"))).collect()] == ["movedFrom", "movedTo", "created", "unknown"]
    events = spark.createDataFrame([("moved", "a", "b", False), ("created", None, "f", False), ("created", None, "d", True), ("closedWrite", None, "f", False)], "event string, old string, new string, is_folder boolean")
    assert [r["action"] for r in file_events.actions(events).collect()] == ["move", "index_folder", "index_file"]


def test_every_customer_is_identified(spark):
    from quadloom.queries import identify_all

    got = {tuple(r) for r in identify_all(spark, "/root/testdata/sf0.001").collect()}
    keys = [r["c_custkey"] for r in spark.read.parquet("/root/testdata/sf0.001/customer.parquet").collect()]
    assert {a for a, _ in got} == {f"_:{k}" for k in keys}
    assert len(got) == len(keys)


def test_candidates_with_few_and_with_many_values(spark, onto, start):
    # Candidates are found by what they have: c has no nick, a has several values of it.
    quads = start.unionByName(start.filter("s = 'res:/a' and p = 'nick'").withColumn("o", F.lit("an")))
    batch = rows(spark, ("_:1", TYPE, "Contact"), ("_:1", "fullname", "Ann"), ("_:1", "nick", "an"), ("_:2", TYPE, "Contact"), ("_:2", "nick", "none"))
    assert [tuple(r) for r in identify.by_properties(batch, quads, onto).collect()] == [("_:1", "res:/a")]


def test_deep_references_are_identified(spark, onto, start):
    deep = 17
    facts_of = lambda name: [(name(0), TYPE, "Contact"), (name(0), "fullname", "N0")] + [x for i in range(1, deep) for x in ((name(i), TYPE, "Contact"), (name(i), "fullname", f"N{i}"), (name(i), "knows", name(i - 1)))]
    known = M.complete(M.checked(rows(spark, *facts_of(lambda i: f"res:/n{i}")), onto), M.graph_of("app"))
    found = identify.identifier(onto)(rows(spark, *facts_of(lambda i: f"_:{i}")), M.add(start.limit(0), known).quads.cache())
    assert dict(map(tuple, found.collect())) == {f"_:{i}": f"res:/n{i}" for i in range(deep)}


def test_identification_sends_no_lifted_table_whole(spark, monkeypatch):
    from quadloom.queries import identify_all

    made = []
    monkeypatch.setattr(identify, "cut_lineage", lambda df: made.append(df) or df, raising=False)
    made.append(identify_all(spark, "/root/testdata/sf0.001"))
    for df in made:
        assert "BroadcastNestedLoopJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_resources_that_say_the_same(spark, onto):
    # Of many alike, the earliest created one stands for all, and every blank node that says the same gets it.
    known = [x for i in range(40) for x in ((f"res:/n{i:02}", TYPE, "Contact"), (f"res:/n{i:02}", "fullname", "Same"))]
    quads = M.complete(M.checked(rows(spark, *known), onto), M.graph_of("app"))
    made = quads.filter("s = 'res:/n07' and p = 'fullname'").withColumns({"p": F.lit(CREATED), "o": F.lit("2020-01-01T00:00:00"), "o_ts": F.lit("2020-01-01").cast("timestamp")})
    batch = rows(spark, *[x for i in range(30) for x in ((f"_:{i}", TYPE, "Contact"), (f"_:{i}", "fullname", "Same"))])
    found = identify.by_properties(batch, quads.unionByName(made.select(quads.columns)), onto)
    assert {tuple(r) for r in found.collect()} == {(f"_:{i}", "res:/n07") for i in range(30)}
