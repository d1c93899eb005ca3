"""The queries of the graph engine over the lifted tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import access as A
from .operators import describe as DESC
from .operators import identify as IDENT
from .operators import jobs as J
from .operators import mutate as M
from .operators import query as Q
from .operators import terms as T
from .operators.query import Order, Query, Request
from .plans.graph import lift
from .sources import files as FILES
from .sources import rdf as RDF
from .streaming import file_events as FE
from .streaming import live as LIVE

REGISTERED: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name."""

    def put(f):
        REGISTERED[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


# Pieces of SQL that build uris as the lift does.
O, C, N, S, P = ("concat('res:/orders/', o_orderkey)", "concat('res:/customer/', c_custkey)", "concat('res:/nation/', n_nationkey)", "concat('res:/supplier/', s_suppkey)", "concat('res:/part/', p_partkey)")
E_, D, G = "concat('res:/events/', event_id)", "concat('res:/documents/', doc_id)", "concat('res:/pages/', page_id)"


def word(text: str) -> str:
    r"""SQL's form of a word test: RE2 has \pL and \pN, and matches letters of any case with (?i)."""
    return rf"(?i)(^|[^\pL\pN_]){text}($|[^\pL\pN_])"


# ---- the flagship ---------------------------------------------------------------------------------------------------


@query(f"""
    SELECT {O} AS r, o_totalprice AS price, c_name AS "reqProp1" FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE r_name = 'ASIA' AND o_totalprice > 100000 ORDER BY o_totalprice DESC, r LIMIT 20""")
def asia_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders above 100,000 by customers in Asia, with the customer's name, dearest first."""
    g = lift(spark, sf_dir, ["region", "nation", "customer", "orders"])
    asian = T.related(g, "nation", T.related(g, "region", T.compare(g, "name", "=", "ASIA")))
    named = T.all_of(T.has(g, "name", var="reqProp1"), asian)
    dear = T.compare(g, "totalprice", ">", 100000, var="price")
    return Query(g, T.all_of(dear, T.related(g, "customer", named), T.of_type(g, "Order")), orders=[Order("price", descending=True)], limit=20).results()


# ---- types and comparisons --------------------------------------------------------------------------------------------


@query(f"SELECT {C} AS r FROM customer UNION ALL SELECT {S} FROM supplier")
def type_closure(spark, sf_dir):
    return T.of_type(lift(spark, sf_dir), "Party")


@query(f"SELECT {N} AS r FROM nation UNION ALL SELECT {E_} FROM events WHERE event_type = 'click'")
def type_any_of(spark, sf_dir):
    return T.of_type(lift(spark, sf_dir), "Nation", "ClickEvent")


@query(f"SELECT {E_} AS r FROM events")
def type_subclasses(spark, sf_dir):
    return T.of_type(lift(spark, sf_dir), "Event")


@query("SELECT 'res:/nation/3' AS r FROM nation WHERE n_nationkey = 3")
def resource_term(spark, sf_dir):
    return T.resource(lift(spark, sf_dir, ["nation"]), "res:/nation/3")


@query(f"SELECT {C} AS r FROM customer WHERE c_mktsegment = 'BUILDING'")
def cmp_eq(spark, sf_dir):
    return T.compare(lift(spark, sf_dir), "mktsegment", "=", "BUILDING")


@query(f"SELECT {O} AS r, o_totalprice AS price FROM orders WHERE o_totalprice > 200000")
def cmp_gt(spark, sf_dir):
    return T.compare(lift(spark, sf_dir), "totalprice", ">", 200000, var="price")


@query(f"SELECT {P} AS r FROM part WHERE p_size <= 10")
def cmp_le(spark, sf_dir):
    return T.compare(lift(spark, sf_dir), "size", "<=", 10)


@query(f"SELECT {O} AS r FROM orders WHERE o_totalprice > 50000 AND o_totalprice < 60000")
def cmp_range(spark, sf_dir):
    return T.within(lift(spark, sf_dir), "totalprice", 50000, 60000)


@query(f"SELECT {P} AS r FROM part WHERE regexp_matches(p_name, 'B.*T$', 'i')")
def cmp_regex(spark, sf_dir):
    g = lift(spark, sf_dir)
    return T.all_of(T.compare(g, "name", "regexp", "B.*T$"), T.of_type(g, "Part"))


@query(f"SELECT {S} AS r FROM supplier WHERE s_acctbal IS NOT NULL UNION SELECT {C} FROM customer WHERE c_acctbal IS NOT NULL")
def has_property(spark, sf_dir):
    return T.has(lift(spark, sf_dir), "acctbal")


@query(f"SELECT {C} AS r FROM customer WHERE c_mktsegment = 'MACHINERY' UNION SELECT {P} FROM part WHERE p_type = 'MACHINERY' OR p_brand = 'MACHINERY' OR p_name = 'MACHINERY'")
def any_property_eq(spark, sf_dir):
    return T.compare(lift(spark, sf_dir, ["customer", "part"]), None, "=", "MACHINERY")


@query(f"SELECT {C} AS r FROM customer WHERE c_nationkey = 7")
def cmp_resource(spark, sf_dir):
    g = lift(spark, sf_dir)
    return T.all_of(T.is_related(g, "nation", "res:/nation/7"), T.of_type(g, "Customer"))


# ---- paths ------------------------------------------------------------------------------------------------------------


@query(f"SELECT {O} AS r FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'AUTOMOBILE' AND o_totalprice < 20000")
def path_two_hop(spark, sf_dir):
    g = lift(spark, sf_dir)
    return T.all_of(T.compare(g, "totalprice", "<", 20000), T.related(g, "customer", T.compare(g, "mktsegment", "=", "AUTOMOBILE")))


@query(f"""SELECT {O} AS r FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE r_name = 'EUROPE' AND o_orderpriority = '1-URGENT'""")
def path_three_hop(spark, sf_dir):
    g = lift(spark, sf_dir)
    european = T.related(g, "nation", T.related(g, "region", T.compare(g, "name", "=", "EUROPE")))
    return T.all_of(T.compare(g, "orderpriority", "=", "1-URGENT"), T.related(g, "customer", european))


@query(f"SELECT DISTINCT {C} AS r FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 300000")
def inverse_cmp(spark, sf_dir):
    g = lift(spark, sf_dir)
    return T.related(g, "customer", T.compare(g, "totalprice", ">", 300000), inverted=True)


@query(f"SELECT {O} AS r FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def inverse_property(spark, sf_dir):
    """Both ways: the inverse property orderedBy is declared and has no statements of its own here."""
    g = lift(spark, sf_dir)
    return T.related(g, "customer", T.compare(g, "acctbal", "<", 0), both_ways=True)


@query(f"SELECT {C} AS r FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = (SELECT n_name FROM nation WHERE n_nationkey = 4)")
def related_literal_eq(spark, sf_dir):
    g = lift(spark, sf_dir, ["nation", "customer"])
    name = spark.read.parquet(f"{sf_dir}/nation.parquet").filter("n_nationkey = 4").first()["n_name"]
    return T.related_literal(g, "nation", name, "=")


# ---- connectives ------------------------------------------------------------------------------------------------------


@query(f"""SELECT {O} AS r FROM orders WHERE (o_orderpriority = '1-URGENT' OR o_totalprice > 250000) AND o_orderstatus <> 'F'""")
def and_or_not(spark, sf_dir):
    g = lift(spark, sf_dir)
    either = T.any_of(T.compare(g, "orderpriority", "=", "1-URGENT"), T.compare(g, "totalprice", ">", 250000))
    return T.but_not(either, T.compare(g, "orderstatus", "=", "F"))


@query(f"SELECT {O} AS r FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def no_lineitem(spark, sf_dir):
    g = lift(spark, sf_dir)
    return T.but_not(T.of_type(g, "Order"), T.related(g, "order", T.of_type(g, "LineItem"), inverted=True))


@query(f"SELECT {N} AS r FROM nation WHERE n_regionkey <> 2 UNION SELECT concat('res:/region/', r_regionkey) FROM region")
def negation_alone(spark, sf_dir):
    g = lift(spark, sf_dir, ["region", "nation"])
    return T.negation(g, T.is_related(g, "region", "res:/region/2"))


@query(f"SELECT DISTINCT {O} AS r FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE NOT regexp_matches(l_returnflag, 'R', 'i')")
def not_regex_existential(spark, sf_dir):
    """Orders with some item whose flag is not R: more than the orders that have no item with it."""
    g = lift(spark, sf_dir)
    return T.related(g, "order", T.not_matching(g, "returnflag", "R"), inverted=True)


@query(f"SELECT DISTINCT {O} AS r, l_returnflag AS flag FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_totalprice > 200000")
def optional_property(spark, sf_dir):
    g = lift(spark, sf_dir)
    flags = T.related(g, "order", T.has(g, "returnflag", var="flag"), inverted=True)
    return T.optionally(T.compare(g, "totalprice", ">", 200000), flags)


# ---- projection, order, count, ask --------------------------------------------------------------------------------------


@query(f"SELECT {C} AS r, c_name AS \"reqProp1\", c_acctbal AS \"reqProp2\" FROM customer WHERE c_mktsegment = 'HOUSEHOLD'")
def request_property(spark, sf_dir):
    g = lift(spark, sf_dir)
    return Query(g, T.compare(g, "mktsegment", "=", "HOUSEHOLD"), [Request("name"), Request("acctbal", optional=False, lane="o_num")]).results()


@query(f"SELECT {P} AS r, p_brand AS brand, p_size AS size FROM part ORDER BY p_brand, p_size DESC, r LIMIT 50 OFFSET 10")
def limit_offset(spark, sf_dir):
    g = lift(spark, sf_dir)
    rows = T.all_of(T.has(g, "brand", var="brand"), T.has(g, "size", var="size", lane="o_long"))
    return Query(g, rows, orders=[Order("size", 1, True), Order("brand", 10)], limit=50, offset=10).results()


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O'")
def count_plain(spark, sf_dir):
    g = lift(spark, sf_dir)
    return Query(g, T.compare(g, "orderstatus", "=", "O")).count()


@query("SELECT count(*) AS n FROM (SELECT DISTINCT o_orderkey, l_returnflag FROM orders JOIN lineitem ON l_orderkey = o_orderkey)")
def count_vars(spark, sf_dir):
    g = lift(spark, sf_dir)
    return Query(g, T.related(g, "order", T.has(g, "returnflag", var="flag"), inverted=True)).count()


@query("SELECT count(*) > 0 AS found FROM customer WHERE c_acctbal > 9000")
def ask(spark, sf_dir):
    g = lift(spark, sf_dir)
    return Query(g, T.compare(g, "acctbal", ">", 9000)).ask()


# ---- aggregates -------------------------------------------------------------------------------------------------------



def _exact(total: str, n: str) -> str:
    """An average of whole cents, as a decimal of six places with halves away from zero; prices are above zero."""
    return f"CAST((20000 * CAST({total} AS HUGEINT) + {n}) // (2 * {n}) AS DOUBLE) / 1e6"


_AGGREGATES = {
    "count": "count(o_totalprice)", "distinct_count": "count(DISTINCT o_totalprice)", "max": "max(o_totalprice)", "min": "min(o_totalprice)", "sum": "round(sum(o_totalprice), 2)",
    "distinct_sum": "round(sum(DISTINCT o_totalprice), 2)", "average": _exact("sum(cents)", "count(cents)"), "distinct_average": _exact("sum(DISTINCT cents)", "count(DISTINCT cents)"),
}


def _aggregate(function: str, digits: int | None):
    def run(spark, sf_dir):
        g = lift(spark, sf_dir)
        price = F.col("o_num").cast("decimal(18,2)") if "average" in function else F.col("o_num")  # averages of decimals are exact
        prices = g.values("totalprice").select(F.col("s").alias("o"), price.alias("o_num"))
        orders = g.values("customer").select(F.col("o").alias("r"), F.col("s").alias("o")).join(prices, "o").select("r", F.col("o_num").alias("price"))
        found = T.aggregated(orders, "price", function, "value")
        found = found.withColumn("value", F.round("value", digits)) if digits else found
        return found.withColumn("value", F.col("value").cast("double")) if "average" in function else found

    run.__name__ = f"agg_{function}"
    return run


for _name, _sql in _AGGREGATES.items():
    query(f"SELECT concat('res:/customer/', o_custkey) AS r, {_sql} AS value FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders) GROUP BY o_custkey")(_aggregate(_name, {"sum": 2, "distinct_sum": 2}.get(_name)))


# ---- full text ----------------------------------------------------------------------------------------------------------


@query(rf"SELECT {D} AS r FROM documents WHERE regexp_matches(text, '{word('trash')}')")
def fulltext_word(spark, sf_dir):
    g = lift(spark, sf_dir, ["documents"])
    return T.compare(g, "text", ":", "Trash")


@query(rf"SELECT {D} AS r FROM documents WHERE regexp_matches(text, '{word('of the')}')")
def fulltext_phrase(spark, sf_dir):
    g = lift(spark, sf_dir, ["documents"])
    return T.compare(g, "text", ":", "'of the'")


@query(rf"SELECT {D} AS r FROM documents WHERE regexp_matches(text, '(?i)(^|[^\pL\pN_])disg[\pL\pN_]*')")
def fulltext_prefix(spark, sf_dir):
    g = lift(spark, sf_dir, ["documents"])
    return T.compare(g, "text", ":", "disg*")


@query(f"SELECT {D} AS r FROM documents WHERE regexp_matches(text, '(?i)ai.ü') OR regexp_matches(text, '(?i)öb.')")
def fulltext_short_wildcard(spark, sf_dir):
    g = lift(spark, sf_dir, ["documents"])
    return T.compare(g, "text", ":", "ai?ü or öb?")


@query(rf"SELECT {D} AS r FROM documents WHERE regexp_matches(text, '{word('the')}') AND NOT regexp_matches(text, '{word('of')}')")
def fulltext_not(spark, sf_dir):
    g = lift(spark, sf_dir, ["documents"])
    return T.compare(g, "text", ":", "the not of")


@query(rf"SELECT {D} AS r FROM documents WHERE regexp_matches(text, '{word('scum')}') OR regexp_matches(text, '{word('für')}')")
def fulltext_or(spark, sf_dir):
    g = lift(spark, sf_dir, ["documents"])
    return T.compare(g, "text", ":", "scum OR FÜR")


@query(rf"""WITH h AS (SELECT {C} AS r, NULL AS n FROM customer WHERE regexp_matches(c_mktsegment, '{word('building')}'))
    SELECT r FROM h UNION SELECT {O} FROM orders WHERE concat('res:/customer/', o_custkey) IN (SELECT r FROM h)""")
def fulltext_any_property(spark, sf_dir):
    g = lift(spark, sf_dir, ["customer", "orders"])
    return T.literal(g, "building")


@query(None)
def fulltext_score(spark, sf_dir):
    """Scores and excerpts are this engine's own."""
    g = lift(spark, sf_dir, ["documents"])
    return Query(g, T.compare(g, "text", ":", "trash"), scored=("text", "trash"), limit=100).results()


# ---- files and canned queries -----------------------------------------------------------------------------------------------


@query(f"SELECT {G} AS r FROM pages WHERE starts_with(url, 'https://blog.tionsh.example.net/') OR starts_with(url, 'http://blog.tionsh.example.net/fr/')")
def file_include(spark, sf_dir):
    g = lift(spark, sf_dir, ["pages"])
    return Q.file_query(g, include=[("https://blog.tionsh.example.net", True), ("http://blog.tionsh.example.net/fr/", True)], files="Page")


@query(f"SELECT {G} AS r FROM pages WHERE NOT starts_with(url, 'https://blog.tionsh.example.net/')")
def file_exclude(spark, sf_dir):
    g = lift(spark, sf_dir, ["pages"])
    return Q.file_query(g, exclude=["https://blog.tionsh.example.net"], files="Page")


@query(f"SELECT {G} AS r FROM pages WHERE regexp_matches(url, '^https://[^/]*/en/[^/]*$') AND starts_with(url, 'https://blog.tionsh.example.net/en/')")
def file_nonrecursive(spark, sf_dir):
    g = lift(spark, sf_dir, ["pages"])
    return Q.file_query(g, include=[("https://blog.tionsh.example.net/en", False)], files="Page")


@query(f"SELECT {O} AS r, CAST(o_orderdate AS TIMESTAMP) AS modified FROM orders ORDER BY o_orderdate DESC, r LIMIT 25")
def last_modified(spark, sf_dir):
    return Q.last_modified(lift(spark, sf_dir, ["orders"]), 25, "Order", "orderdate")


@query(f"SELECT {C} AS r, c_acctbal AS score FROM customer ORDER BY c_acctbal DESC, r LIMIT 25")
def most_important(spark, sf_dir):
    return Q.most_important(lift(spark, sf_dir, ["customer", "supplier"]), 25, "acctbal", "Customer")


@query(f"SELECT {C} AS r FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def never_used(spark, sf_dir):
    """Customers without an event: the never-opened query, with use told by a relation instead of a counter."""
    g = lift(spark, sf_dir, ["customer", "events"])
    return T.but_not(T.of_type(g, "Customer"), T.related(g, "user", T.of_type(g, "Event"), inverted=True))


@query(f"""SELECT {O} AS r FROM orders WHERE o_orderdate > TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1995-03-01'
    UNION SELECT concat('res:/customer/', user_id) FROM events WHERE ts > TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06'""")
def date_range(spark, sf_dir):
    import datetime as dt

    g = lift(spark, sf_dir, ["orders", "events", "customer"])
    return T.any_of(Q.in_date_range(g, dt.datetime(1995, 1, 1), dt.datetime(1995, 3, 1), ["orderdate"]), Q.in_date_range(g, dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 6), usage=("user", "start")))


@query(f"SELECT {E_} AS r FROM events WHERE event_type = 'purchase' AND user_id = 5")
def event_lookup(spark, sf_dir):
    return Q.downloads_of(lift(spark, sf_dir, ["events"]), "PurchaseEvent", "user", "res:/customer/5")


# ---- maintenance, mutation, closures: on quads of the driver's tables ---------------------------------------------------

_DOCS = "SELECT concat('res:/documents/', doc_id) AS s, text FROM documents"


def _document_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lift(spark, sf_dir, ["documents"]).quads()


@query(f"WITH d AS ({_DOCS}) SELECT s AS \"from\", m AS \"to\" FROM (SELECT s, min(s) OVER (PARTITION BY text) AS m FROM d) WHERE s <> m")
def dup_groups(spark, sf_dir):
    """Documents with the text of another one, and the one that stays."""
    return J.duplicate_groups(_document_quads(spark, sf_dir), "Document", "text")


@query(f"WITH d AS ({_DOCS}) SELECT text_hash, count(*) AS n FROM (SELECT sha256(text) AS text_hash, min(s) OVER (PARTITION BY text) AS m FROM d) GROUP BY text_hash")
def merge_redirect(spark, sf_dir):
    """Statements of the merged documents, by text: as many as documents had it before are one each now, but n counts the old ones."""
    quads = _document_quads(spark, sf_dir)
    mapping = J.duplicate_groups(quads, "Document", "text")
    links = J.renamed(quads.filter("p = 'text'"), mapping)
    return links.groupBy(F.sha2("o", 256).alias("text_hash")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey % 7 AS k, count(*) AS n FROM orders GROUP BY ALL")
def dedup_statements(spark, sf_dir):
    """Every statement is made twice, by two applications; one of each stays."""
    quads = lift(spark, sf_dir, ["orders"]).values("customer").withColumn("p", F.lit("customer"))
    twice = quads.unionByName(quads.withColumn("g", F.lit("graph:/again")))
    left = J.distinct_statements(twice)
    return left.groupBy((F.substring_index("s", "/", -1).cast("long") % 7).alias("k")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS orderkey, min(l_returnflag) AS flag FROM lineitem GROUP BY ALL")
def card1_repair(spark, sf_dir):
    """Taken as a property with one value, an order's return flag keeps the smallest."""
    g = lift(spark, sf_dir, ["lineitem"])
    flags = T.related(g, "order", T.has(g, "returnflag", var="o"), inverted=True).select(F.col("r").alias("s"), F.lit("flag").alias("p"), "o", F.lit("g").alias("g"))
    left = J.single_values(flags, ["flag"])
    return left.select(F.substring_index("s", "/", -1).cast("long").alias("orderkey"), F.col("o").alias("flag"))


@query(f"SELECT {O} AS s FROM orders WHERE o_orderpriority = '5-LOW'")
def untyped(spark, sf_dir):
    """Without the types of the orders of low priority, those have none."""
    g = lift(spark, sf_dir, ["orders"])
    low = T.compare(g, "orderpriority", "=", "5-LOW").select(F.col("r").alias("s"))
    quads = g.quads()
    return J.untyped(quads.filter("p <> 'rdf:type'").unionByName(quads.filter("p = 'rdf:type'").join(low, "s", "left_anti")))


@query(f"SELECT {O} AS s FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def missing_key(spark, sf_dir):
    g = lift(spark, sf_dir, ["orders", "lineitem"])
    items = g.values("order").select(F.col("o").alias("s"), F.lit("item").alias("p"), F.col("s").alias("o"))
    return J.missing_key(g.types().withColumn("p", F.lit("rdf:type")).select("s", "p", "o").unionByName(items), "Order", "item")


@query(f"""WITH RECURSIVE r AS (SELECT 'res:/region/2' AS s UNION
    SELECT e.c FROM r JOIN (SELECT concat('res:/region/', n_regionkey) AS p, {N} AS c FROM nation UNION ALL SELECT concat('res:/nation/', c_nationkey), {C} FROM customer) e ON e.p = r.s)
    SELECT s FROM r""")
def subresource_closure(spark, sf_dir):
    """What hangs below a region: its nations and their customers."""
    g = lift(spark, sf_dir, ["region", "nation", "customer"])
    down = g.values("region").unionByName(g.values("nation")).select(F.col("o").alias("s"), F.col("s").alias("o"))
    return DESC.reachable(spark.createDataFrame([("res:/region/2",)], "s string"), down)


@query(f"""SELECT p, count(*) AS n FROM (SELECT 'region' AS p FROM nation WHERE n_nationkey IN (1, 2) UNION ALL SELECT 'name' FROM nation WHERE n_nationkey IN (1, 2)
    UNION ALL SELECT 'rdf:type' FROM nation WHERE n_nationkey IN (1, 2) UNION ALL SELECT unnest(['rdf:type', 'name']) FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey IN (1, 2))) GROUP BY p""")
def describe_closure(spark, sf_dir):
    """Two nations, and of their regions the defining properties."""
    g = lift(spark, sf_dir, ["region", "nation"])
    found = DESC.describe(g.quads(), g.ontology, spark.createDataFrame([("res:/nation/1",), ("res:/nation/2",)], "s string"))
    return found.groupBy("p").agg(F.count("*").alias("n"))


@query(f"""SELECT concat('_:', c_custkey) AS "from", m AS "to" FROM (SELECT c_custkey, concat('res:/customer/', min(CAST(c_custkey AS VARCHAR)) OVER (PARTITION BY c_name, c_acctbal, c_mktsegment)) AS m FROM customer) WHERE c_custkey % 10 = 3""")
def identify_best(spark, sf_dir):
    """Blank nodes with the name, balance and segment of every tenth customer are those customers."""
    g = lift(spark, sf_dir, ["customer"])
    quads = g.quads()
    some = quads.filter((F.col("p") != "nation") & (F.substring_index("s", "/", -1).cast("long") % 10 == 3))
    blank = some.select(F.concat(F.lit("_:"), F.substring_index("s", "/", -1)).alias("s"), "p", "o")
    return IDENT.by_properties(blank, quads, g.ontology)


@query("""SELECT concat('_:', c_custkey) AS "from", concat('res:/customer/', min(CAST(c_custkey AS VARCHAR)) OVER (PARTITION BY c_name, c_acctbal, c_mktsegment)) AS "to" FROM customer""")
def identify_all(spark, sf_dir):
    """Blank nodes with the name, balance and segment of every customer are those customers."""
    g = lift(spark, sf_dir, ["customer"])
    quads = g.quads()
    blank = quads.filter(F.col("p") != "nation").select(F.concat(F.lit("_:"), F.substring_index("s", "/", -1)).alias("s"), "p", "o")
    return IDENT.by_properties(blank, quads, g.ontology)


@query(f"""SELECT {C} AS s, CASE WHEN c_mktsegment = 'BUILDING' THEN 'HOUSING' ELSE c_mktsegment END AS segment FROM customer""")
def set_property(spark, sf_dir):
    g = lift(spark, sf_dir, ["customer"])
    rows = T.compare(g, "mktsegment", "=", "BUILDING").select(F.col("r").alias("s"), F.lit("mktsegment").alias("p"), F.lit("HOUSING").alias("o"))
    done = M.set_property(g.quads(), g.ontology, rows, "app", "2024-01-01T00:00:00")
    return done.quads.filter("p = 'mktsegment'").select("s", F.col("o").alias("segment"))


@query(f"SELECT {C} AS s FROM customer WHERE c_acctbal >= 0")
def remove_resources(spark, sf_dir):
    g = lift(spark, sf_dir, ["customer"])
    gone = T.compare(g, "acctbal", "<", 0).select(F.col("r").alias("s"))
    return M.existing(DESC.remove_resources(g.quads(), gone, "2024-01-01T00:00:00").quads)


@query(f"SELECT {G} AS s, CASE WHEN starts_with(url, 'https://blog.tionsh.example.net/') THEN concat('https://moved.example.net/', substr(url, 33)) ELSE url END AS url FROM pages")
def move_urls(spark, sf_dir):
    g = lift(spark, sf_dir, ["pages"])
    moves = spark.createDataFrame([("https://blog.tionsh.example.net", "https://moved.example.net")], "old string, new string")
    return M.move_urls(g.quads(), moves).filter("p = 'nie:url'").select("s", F.col("o").alias("url"))


@query(f"SELECT {C} AS s, coalesce(c_name, {C}) AS label FROM customer UNION ALL SELECT {O}, {O} FROM orders")
def generic_label(spark, sf_dir):
    g = lift(spark, sf_dir, ["customer", "orders"])
    quads = g.quads().withColumn("p", F.when(F.col("p") == "name", "rdfs:label").otherwise(F.col("p")))
    return A.generic_label(quads, quads)


@query("SELECT concat('res:/customer/', user_id) AS s, count(*) AS usage_count, min(ts) AS first_usage, max(ts) AS last_usage FROM events GROUP BY user_id")
def usage_count(spark, sf_dir):
    g = lift(spark, sf_dir, ["events"])
    used = g.values("user").select(F.col("s").alias("e"), F.col("o").alias("s")).join(g.values("start").select(F.col("s").alias("e"), F.col("o_ts").alias("at")), "e")
    return A.usage(used)


@query(f"""SELECT {O} AS r, 'added' AS event FROM orders WHERE o_totalprice > 250000 AND o_totalprice <= 300000 UNION ALL
    SELECT {O}, 'removed' FROM orders WHERE o_totalprice > 400000""")
def snapshot_diff(spark, sf_dir):
    """Between a listing of orders above 300,000 and one of orders from 250,000 to 400,000."""
    g = lift(spark, sf_dir, ["orders"])
    before, now = T.compare(g, "totalprice", ">", 300000), T.all_of(T.compare(g, "totalprice", ">", 250000), T.compare(g, "totalprice", "<=", 400000))
    return LIVE.difference(before, now)


@query("SELECT 'all' AS watcher, 'value' AS p, count(*) AS n FROM events UNION ALL SELECT 'clicks', 'value', count(*) FROM events WHERE event_type = 'click' UNION ALL SELECT 'one', 'value', count(*) FROM events WHERE event_id = 7")
def change_routing(spark, sf_dir):
    """A change of every event's value, to who watches everything, a type, or a resource."""
    g = lift(spark, sf_dir, ["events"])
    changes = g.values("value").select("s", F.lit("value").alias("p"), "o", F.lit(True).alias("added"))
    who = spark.createDataFrame([("all", None, None, None), ("clicks", None, None, "ClickEvent"), ("one", "res:/events/7", None, None)], LIVE.SUBSCRIPTIONS)
    sent = LIVE.routed(changes, who, g.types().select("s", F.col("o").alias("type")), g.ontology)
    return sent.groupBy("watcher", "p").agg(F.count("*").alias("n"))


@query("SELECT event, count(*) AS n FROM (SELECT unnest(CASE event_id % 3 WHEN 0 THEN ['moved'] WHEN 1 THEN ['created', 'closedWrite'] ELSE ['deleted'] END) AS event FROM events) GROUP BY event")
def move_pairing(spark, sf_dir):
    """Two of three events have a first half, two of three a second one."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("cookie"), F.concat(F.lit("/f/"), "event_id").alias("path"))
    halves = e.filter("cookie % 3 <> 1").withColumn("kind", F.lit("movedFrom")).unionByName(e.filter("cookie % 3 <> 2").withColumn("kind", F.lit("movedTo")))
    return FE.paired_moves_batch(halves).groupBy("event").agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 5000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g), n AS (SELECT user_id, session, count(*) AS n FROM s GROUP BY ALL)
    SELECT CAST(user_id AS VARCHAR) AS url, CAST(h AS BIGINT) AS held FROM (SELECT user_id, unnest(CASE WHEN n > 1 THEN [0, n - 1] ELSE [0] END) AS h FROM n)""")
def quiet_queue(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("url"), F.col("ts").cast("timestamp").alias("at"))
    return FE.first_then_quiet_batch(e)


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, length(text) AS chars FROM documents")
def text_counts(spark, sf_dir):
    return FILES.text_counts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "words", "chars")


@query("SELECT 3 * count(*) AS n FROM nation")
def nquads_lines(spark, sf_dir):
    """Quads as lines of N-Quads."""
    return RDF.nquad_lines(lift(spark, sf_dir, ["nation"]).quads()).agg(F.count("*").alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(REGISTERED)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
