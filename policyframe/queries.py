"""Each operator as a query over the tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from policyframe.operators import graphql, semantic
from policyframe.operators.analytics import Analyst, avg_, count_, count_all, count_distinct, max_, min_, sum_
from policyframe.operators.fields import Batched, Computed, capped, with_alias, with_computed
from policyframe.operators.mutations import Writer
from policyframe.operators.reads import Args
from policyframe.operators.scoped import ScopedQuery
from policyframe.operators.units import OnDelete, Unit
from policyframe.plans import expression as x
from policyframe.plans.catalog import Model, Relation
from policyframe.plans.policy import Policies, Rules
from policyframe.plans.predicate import ALL, ANY_NULL, DB_NULL, JSON_NULL, Field, Rel, any_of, from_dict
from policyframe.sources import migrate
from policyframe.sources.stores import drift
from policyframe.sources.tables import MODELS, catalog
from policyframe.streaming import jobs
from policyframe.streaming.changes import change_feed, deduplicated
from policyframe.streaming.outbox import claim, decoded, from_changes, settle, waiting

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
f, r = Field, Rel
#: All may be read, but for what a test's own rules say.
OPEN = {m.name: Rules().can("read") for m in MODELS}
EUROPE_NOT_BUILDING = Policies(OPEN | {"Customer": Rules().can("read", r("nation").is_(r("region").is_(f("r_name").eq("EUROPE")))).cannot("read", f("c_mktsegment").eq("BUILDING"))})
BALANCE_OF_AUTOMOBILE = Policies(OPEN | {"Customer": Rules().can("read").cannot("read", ALL, ("c_acctbal",)).can("read", f("c_mktsegment").eq("AUTOMOBILE"), ("c_acctbal",))})
BALANCE_BY_REGION = Policies(OPEN | {"Customer": Rules().can("read").cannot("read", ALL, ("c_acctbal",)).can("read", r("nation").is_(f("n_regionkey").eq(1)), ("c_acctbal",))})


def query(name: str, sql: str | None = None):
    def add(make: Callable[[Analyst], DataFrame]):
        _QUERIES[name] = lambda spark, sf_dir: make(Analyst(catalog(spark, sf_dir)))
        if sql:
            _SQL[name] = sql
        return make

    return add


def find(name: str, sql: str, model: str, policies: Policies | None = None, **request) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Analyst(catalog(spark, sf_dir), policies).find_many(model, **request)

    _QUERIES[name], _SQL[name] = run, sql


KEY = ("o_orderkey",)
D2 = "CAST({} AS DECIMAL(18,2))"
WORDS = "CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 5 = 0 THEN [] ELSE string_split(p_name, ' ') END"
GRADE = "CASE WHEN event_id % 4 > 0 THEN event_id % 4 END"
#: A JSON text of every kind of value: absent, null, texts, numbers with a fraction of zero, booleans, and a list with an object.
DOC = """(CASE WHEN event_id % 11 = 0 THEN NULL ELSE '{"n":' || (event_id % 50) || CASE WHEN event_id % 13 = 0 THEN '' ELSE ',"x":' ||
 CASE event_id % 4 WHEN 0 THEN 'null' WHEN 1 THEN '"' || event_type || '"' WHEN 2 THEN (event_id % 10) || '.0' ELSE 'true' END END ||
 ',"tags":[' || (event_id % 3) || ',"' || event_type || '",{"a":' || (event_id % 2) || '.0}]}' END)""".replace("\n", "")
TYPE_X = f"json_type({DOC}, '$.x')"
TOTAL, BALANCE, RICH = D2.format("o_totalprice"), D2.format("c_acctbal"), "CASE WHEN c_acctbal > 5000 THEN c_acctbal END"

# --- predicates -----------------------------------------------------------------------------------------------------------
for _name, _model, _key, _where, _sql in [
    ("where_eq", "Order", "o_orderkey", f("o_orderstatus").eq("F"), "FROM orders WHERE o_orderstatus = 'F'"),
    ("where_ne_null_true", "Event", "event_id", f("grade").ne(2), f"FROM events WHERE coalesce({GRADE} <> 2, true)"),
    ("where_in", "Order", "o_orderkey", f("o_orderpriority").in_("1-URGENT", "2-HIGH"), "FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    ("where_in_empty", "Order", "o_orderkey", f("o_orderkey").in_([]), "FROM orders WHERE false"),
    ("where_not_in", "Event", "event_id", f("grade").not_in([1, 3]), f"FROM events WHERE coalesce({GRADE} NOT IN (1, 3), true)"),
    ("where_range", "Order", "o_orderkey", f("o_totalprice").gte(1000) & f("o_totalprice").lt(50000), f"FROM orders WHERE {TOTAL} >= 1000 AND {TOTAL} < 50000"),
    ("where_lte_gt", "Part", "p_partkey", f("p_size").lte(10) | f("p_size").gt(45), "FROM part WHERE p_size <= 10 OR p_size > 45"),
    ("where_contains_ci", "Part", "p_partkey", f("p_type").ci().contains("dI"), "FROM part WHERE contains(lower(p_type), 'di')"),
    ("where_contains", "Part", "p_partkey", f("p_name").contains("d w"), "FROM part WHERE contains(p_name, 'd w')"),
    ("where_starts_with", "Part", "p_partkey", f("p_brand").starts_with("Brand#1"), "FROM part WHERE starts_with(p_brand, 'Brand#1')"),
    ("where_ends_with", "Part", "p_partkey", f("p_brand").ends_with("3"), "FROM part WHERE ends_with(p_brand, '3')"),
    ("where_is_null", "Customer", "c_custkey", f("rich").is_null(), f"FROM customer WHERE ({RICH}) IS NULL"),
    ("where_is_not_null", "Customer", "c_custkey", f("rich").is_not_null(), f"FROM customer WHERE ({RICH}) IS NOT NULL"),
    ("where_and_or_not", "Order", "o_orderkey", any_of(f("o_orderstatus").eq("O") & f("o_totalprice").gt(100000), ~f("o_orderpriority").ne("5-LOW")), f"FROM orders WHERE (o_orderstatus = 'O' AND {TOTAL} > 100000) OR o_orderpriority = '5-LOW'"),
    ("where_json_path_eq", "Event", "event_id", f("props").at("k").json_eq(7), "FROM events WHERE CAST(props ->> '$.k' AS INTEGER) = 7"),
    ("where_json_path_ne", "Event", "event_id", f("props").at("k").json_ne(7), "FROM events WHERE CAST(props ->> '$.k' AS INTEGER) <> 7"),
    ("where_json_path_gt", "Event", "event_id", f("props").at("k").json_gt(50), "FROM events WHERE CAST(props ->> '$.k' AS INTEGER) > 50"),
    ("where_json_is_null", "Event", "event_id", f("doc").json_is_null(), f"FROM events WHERE {DOC} IS NULL"),
    ("where_json_is_not_null", "Event", "event_id", f("doc").json_is_not_null(), f"FROM events WHERE {DOC} IS NOT NULL"),
    ("where_json_missing", "Event", "event_id", f("doc").at("x").json_ne(4), f"FROM events WHERE {TYPE_X} = 'DOUBLE' AND CAST({DOC} ->> '$.x' AS DOUBLE) <> 4"),
    ("where_json_lt", "Event", "event_id", f("doc").at("n").json_lt(5), f"FROM events WHERE CAST({DOC} ->> '$.n' AS INTEGER) < 5"),
    ("where_json_lte", "Event", "event_id", f("doc").at("x").json_lte(6), f"FROM events WHERE {TYPE_X} = 'DOUBLE' AND CAST({DOC} ->> '$.x' AS DOUBLE) <= 6"),
    ("where_json_gte_text", "Event", "event_id", f("doc").at("x").json_gte("purchase"), f"FROM events WHERE {TYPE_X} = 'VARCHAR' AND {DOC} ->> '$.x' >= 'purchase'"),
    ("where_json_eq_boolean", "Event", "event_id", f("doc").at("x").json_eq(True), f"FROM events WHERE {TYPE_X} = 'BOOLEAN'"),
    ("where_json_eq_decimal", "Event", "event_id", f("doc").at("x").json_eq(6), f"FROM events WHERE {TYPE_X} = 'DOUBLE' AND CAST({DOC} ->> '$.x' AS DOUBLE) = 6"),
    ("where_json_eq_list", "Event", "event_id", f("doc").at("tags").json_eq([1, "view", {"a": 1}]), f"FROM events WHERE {DOC} IS NOT NULL AND event_id % 3 = 1 AND event_type = 'view' AND event_id % 2 = 1"),
    ("where_json_ne_list", "Event", "event_id", f("doc").at("tags").json_ne([1, "view", {"a": 1}]), f"FROM events WHERE {DOC} IS NOT NULL AND NOT (event_id % 3 = 1 AND event_type = 'view' AND event_id % 2 = 1)"),
    ("where_json_eq_db_null", "Event", "event_id", f("doc").at("x").json_eq(DB_NULL), f"FROM events WHERE {TYPE_X} IS NULL"),
    ("where_json_eq_json_null", "Event", "event_id", f("doc").at("x").json_eq(JSON_NULL), f"FROM events WHERE {TYPE_X} = 'NULL'"),
    ("where_json_eq_any_null", "Event", "event_id", f("doc").at("x").json_eq(ANY_NULL), f"FROM events WHERE coalesce({TYPE_X}, 'NULL') = 'NULL'"),
    ("where_json_ne_db_null", "Event", "event_id", f("doc").at("x").json_ne(DB_NULL), f"FROM events WHERE {TYPE_X} IS NOT NULL"),
    ("where_json_ne_any_null", "Event", "event_id", f("doc").at("x").json_ne(ANY_NULL), f"FROM events WHERE {TYPE_X} <> 'NULL'"),
    ("where_json_string_contains", "Event", "event_id", f("doc").at("x").string_contains("i"), f"FROM events WHERE {TYPE_X} = 'VARCHAR' AND contains({DOC} ->> '$.x', 'i')"),
    ("where_json_string_starts_with", "Event", "event_id", f("doc").ci().at("x").string_starts_with("C"), f"FROM events WHERE {TYPE_X} = 'VARCHAR' AND starts_with({DOC} ->> '$.x', 'c')"),
    ("where_json_string_ends_with", "Event", "event_id", f("doc").at("x").string_ends_with("p"), f"FROM events WHERE {TYPE_X} = 'VARCHAR' AND ends_with({DOC} ->> '$.x', 'p')"),
    ("where_json_array_contains", "Event", "event_id", f("doc").at("tags").array_contains("view"), f"FROM events WHERE {DOC} IS NOT NULL AND event_type = 'view'"),
    ("where_json_array_contains_deep", "Event", "event_id", f("doc").at("tags").array_contains([{"a": 0}, 2]), f"FROM events WHERE {DOC} IS NOT NULL AND event_id % 2 = 0 AND event_id % 3 = 2"),
    ("where_json_array_starts_with", "Event", "event_id", f("doc").at("tags").array_starts_with(1.0), f"FROM events WHERE {DOC} IS NOT NULL AND event_id % 3 = 1"),
    ("where_json_array_ends_with", "Event", "event_id", f("doc").at("tags").array_ends_with({"a": 1}), f"FROM events WHERE {DOC} IS NOT NULL AND event_id % 2 = 1"),
    ("where_list_eq", "Part", "p_partkey", f("words").list_eq(["red", "widget"]), f"FROM part WHERE {WORDS} = ['red', 'widget']"),
    ("where_list_is_null", "Part", "p_partkey", f("words").list_is_null(), f"FROM part WHERE {WORDS} IS NULL"),
    ("where_list_is_not_null", "Part", "p_partkey", f("words").list_is_not_null(), f"FROM part WHERE {WORDS} IS NOT NULL"),
    ("where_list_has", "Part", "p_partkey", f("words").has("red"), f"FROM part WHERE list_contains({WORDS}, 'red')"),
    ("where_list_has_every", "Part", "p_partkey", f("words").has_every("red", "bolt"), f"FROM part WHERE list_has_all({WORDS}, ['red', 'bolt'])"),
    ("where_list_has_every_empty", "Part", "p_partkey", f("words").has_every([]), f"FROM part WHERE {WORDS} IS NOT NULL"),
    ("where_list_has_some", "Part", "p_partkey", f("words").has_some("red", "bolt"), f"FROM part WHERE list_has_any({WORDS}, ['red', 'bolt'])"),
    ("where_list_is_empty", "Part", "p_partkey", f("words").is_empty(True), f"FROM part WHERE len({WORDS}) = 0"),
    ("where_list_is_not_empty", "Part", "p_partkey", f("words").is_empty(False), f"FROM part WHERE len({WORDS}) > 0"),
    ("rel_is", "Order", "o_orderkey", r("customer").is_(f("c_mktsegment").eq("BUILDING")), "FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'"),
    ("rel_is_not", "Order", "o_orderkey", r("customer").is_not(f("c_mktsegment").eq("BUILDING")), "FROM orders WHERE NOT EXISTS (FROM customer WHERE o_custkey = c_custkey AND c_mktsegment = 'BUILDING')"),
    ("rel_is_null", "Document", "doc_id", r("label").is_null(), "FROM documents d WHERE NOT EXISTS (FROM labels l WHERE l.doc_id = d.doc_id)"),
    ("rel_is_not_null", "Document", "doc_id", r("label").is_not_null(), "FROM documents d WHERE EXISTS (FROM labels l WHERE l.doc_id = d.doc_id)"),
    ("rel_some", "Customer", "c_custkey", r("orders").some(f("o_totalprice").gt(200000)), f"FROM customer WHERE EXISTS (FROM orders WHERE o_custkey = c_custkey AND {TOTAL} > 200000)"),
    ("rel_every", "Customer", "c_custkey", r("orders").every(f("o_totalprice").gt(20000)), f"FROM customer WHERE NOT EXISTS (FROM orders WHERE o_custkey = c_custkey AND {TOTAL} <= 20000)"),
    ("rel_none", "Customer", "c_custkey", r("orders").none(f("o_orderstatus").eq("F")), "FROM customer WHERE NOT EXISTS (FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')"),
    ("rel_two_hops", "Customer", "c_custkey", r("nation").is_(r("region").is_(f("r_name").eq("ASIA"))), "FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'"),
    ("rel_under_or", "Customer", "c_custkey", f("c_mktsegment").eq("MACHINERY") | r("orders").some(f("o_totalprice").gt(300000)), f"FROM customer WHERE c_mktsegment = 'MACHINERY' OR EXISTS (FROM orders WHERE o_custkey = c_custkey AND {TOTAL} > 300000)"),
]:
    find(_name, f"SELECT {_key} {_sql}", _model, where=_where, select=(_key,))


@query("where_dict", f"SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND NOT ({TOTAL} < 1000 OR o_orderstatus = 'P')")
def _(a: Analyst) -> DataFrame:
    c = from_dict({"customer": {"is": {"c_mktsegment": {"equals": "building", "mode": "insensitive"}}}, "NOT": [{"o_totalprice": {"lt": 1000}}, {"o_orderstatus": "P"}]}, a.catalog.model("Order"), a.catalog)
    return a.find_many("Order", where=c, select=KEY)


@query(
    "where_dict_json",
    f"SELECT event_id FROM events WHERE {TYPE_X} = 'VARCHAR' AND contains({DOC} ->> '$.x', 'ic') OR {TYPE_X} = 'NULL' OR CAST({DOC} ->> "
    "'$.tags[2].a' AS DOUBLE) = 1 AND event_id % 3 = 2",
)
def _(a: Analyst) -> DataFrame:
    either = [{"doc": {"path": "$.x", "string_contains": "IC", "mode": "insensitive"}}, {"doc": {"path": ["x"], "equals": None}}, {"doc": {"path": "$.tags[2].a", "equals": 1}, "AND": [{"doc": {"path": ["tags", "0"], "equals": 2}}]}]
    return a.find_many("Event", where=from_dict({"OR": either}, a.catalog.model("Event"), a.catalog), select=("event_id",))


# --- reads ----------------------------------------------------------------------------------------------------------------
PAGE = "row_number() OVER (ORDER BY {0}) AS ordinal FROM (SELECT * FROM {1} ORDER BY {0} LIMIT {2} OFFSET {3})"
find("find_unique_key", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey = 7", "Order", where=f("o_orderkey").eq(7), select=("o_orderkey", "o_orderstatus"))
find("find_first", f"SELECT o_orderkey, {PAGE.format(f'{TOTAL} DESC, o_orderkey', 'orders', 1, 0)}", "Order", order_by=(("o_totalprice", "desc"),), take=1, select=KEY, ordinal="ordinal")
find(
    "order_nulls",
    f"SELECT c_custkey, row_number() OVER (ORDER BY {RICH} NULLS FIRST, c_custkey) AS ordinal FROM customer",
    "Customer", order_by=("rich",), select=("c_custkey",), ordinal="ordinal",
)
find(
    "order_nulls_last",
    f"SELECT c_custkey, row_number() OVER (ORDER BY {RICH} NULLS LAST, c_custkey) AS ordinal FROM customer",
    "Customer", order_by=(("rich", "asc", "last"),), select=("c_custkey",), ordinal="ordinal",
)
find("take_skip", f"SELECT o_orderkey, {PAGE.format('o_orderdate, o_orderkey', 'orders', 20, 30)}", "Order", order_by=("o_orderdate",), skip=30, take=20, select=KEY, ordinal="ordinal")
find(
    "take_negative",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS ordinal FROM (SELECT * FROM orders ORDER BY "
    "o_orderdate DESC, o_orderkey DESC LIMIT 15)",
    "Order", order_by=("o_orderdate",), take=-15, select=KEY, ordinal="ordinal",
)
find(
    "cursor_inclusive",
    f"WITH a AS (SELECT {TOTAL} AS p, o_orderkey AS k FROM orders WHERE o_orderkey = 100) SELECT o_orderkey, row_number() OVER (ORDER "
    f"BY t DESC, o_orderkey) AS ordinal FROM (SELECT o_orderkey, {TOTAL} AS t FROM orders, a WHERE {TOTAL} < p OR ({TOTAL} = p AND "
    "o_orderkey >= k) ORDER BY t DESC, o_orderkey LIMIT 25)",
    "Order", order_by=(("o_totalprice", "desc"),), cursor={"o_orderkey": 100}, take=25, select=KEY, ordinal="ordinal",
)
find(
    "cursor_skip",
    "SELECT conv_id, turn FROM (SELECT * FROM conversations WHERE (conv_id, turn) >= (5, 0) ORDER BY conv_id, turn LIMIT 10 OFFSET 1)",
    "Turn", cursor={"conv_id": 5, "turn": 0}, skip=1, take=10, select=("conv_id", "turn"),
)
find(
    "distinct_on",
    f"SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY {TOTAL} DESC, o_orderkey) AS n "
    "FROM orders) WHERE n = 1",
    "Order", order_by=(("o_totalprice", "desc"),), distinct=("o_custkey",), select=("o_orderkey", "o_custkey"),
)
find("select_omit", f"SELECT c_custkey, c_name, c_nationkey, {BALANCE} AS c_acctbal, c_mktsegment FROM customer", "Customer", omit=("rich",))


@query("find_unique", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def _(a: Analyst) -> DataFrame:
    return a.find_unique("Customer", {"c_custkey": 42}, select=("c_custkey", "c_name"))


@query("count_where", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O'")
def _(a: Analyst) -> DataFrame:
    return a.count("Order", f("o_orderstatus").eq("O"))


@query("rel_to_one_include", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def _(a: Analyst) -> DataFrame:
    return a.find_many("Order", include={"customer": Args(select=("c_name",))}).select("o_orderkey", F.col("customer.c_name").alias("c_name"))


_ORDERS = f"(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY {TOTAL} DESC, o_orderkey) AS n FROM orders)"


def _rows(df: DataFrame, key: str, relation: str, *fields: str) -> DataFrame:
    """A row for each target, with its place; a row with nulls for a parent without any."""
    return df.select(key, F.posexplode_outer(relation).alias("place", "o")).select(key, "place", *[F.col(f"o.{x}").alias(x) for x in fields])


@query(
    "rel_nested_page",
    f"SELECT c_custkey, CAST(n - 2 AS INTEGER) AS place, o_orderkey, {TOTAL} AS o_totalprice FROM customer LEFT JOIN {_ORDERS} ON "
    "o_custkey = c_custkey AND n > 1 AND n <= 4",
)
def _(a: Analyst) -> DataFrame:
    args = Args(order_by=(("o_totalprice", "desc"),), skip=1, take=3, select=("o_orderkey", "o_totalprice"))
    return _rows(a.find_many("Customer", include={"orders": args}), "c_custkey", "orders", "o_orderkey", "o_totalprice")


@query(
    "rel_page_children",
    f"SELECT c_custkey, CAST(n - 1 AS INTEGER) AS place, o_orderkey FROM (SELECT * FROM customer ORDER BY {BALANCE} DESC, c_custkey "
    f"LIMIT 20) LEFT JOIN {_ORDERS} ON o_custkey = c_custkey AND n <= 5",
)
def _(a: Analyst) -> DataFrame:
    args = Args(order_by=(("o_totalprice", "desc"),), take=5, select=KEY)
    return _rows(a.find_many("Customer", order_by=(("c_acctbal", "desc"),), take=20, include={"orders": args}), "c_custkey", "orders", "o_orderkey")


@query(
    "rel_nested_last",
    "SELECT c_custkey, CAST(k - n AS INTEGER) AS place, o_orderkey FROM customer JOIN (SELECT *, row_number() OVER (PARTITION BY "
    "o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n, least(3, count(*) OVER (PARTITION BY o_custkey)) AS k FROM orders) ON "
    "o_custkey = c_custkey AND n <= 3",
)
def _(a: Analyst) -> DataFrame:
    out = a.find_many("Customer", include={"orders": Args(order_by=("o_orderdate",), take=-3, select=KEY)})
    return _rows(out, "c_custkey", "orders", "o_orderkey").filter("place is not null")


@query(
    "rel_nested_cursor",
    f"WITH c AS (SELECT {TOTAL} AS p FROM orders WHERE o_orderkey = 100) SELECT o_custkey AS c_custkey, CAST(row_number() OVER "
    f"(PARTITION BY o_custkey ORDER BY {TOTAL} DESC, o_orderkey) - 1 AS INTEGER) AS place, o_orderkey FROM orders, c WHERE {TOTAL} < p "
    f"OR ({TOTAL} = p AND o_orderkey >= 100)",
)
def _(a: Analyst) -> DataFrame:
    out = a.find_many("Customer", include={"orders": Args(order_by=(("o_totalprice", "desc"),), cursor={"o_orderkey": 100}, select=KEY)})
    return _rows(out, "c_custkey", "orders", "o_orderkey").filter("place is not null")


@query(
    "rel_nested_distinct",
    "SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS place, o_orderkey FROM "
    "customer JOIN (SELECT o_custkey, o_orderstatus, min(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL) ON o_custkey = c_custkey",
)
def _(a: Analyst) -> DataFrame:
    out = a.find_many("Customer", include={"orders": Args(distinct=("o_orderstatus",), select=KEY)})
    return _rows(out, "c_custkey", "orders", "o_orderkey").filter("place is not null")


@query("rel_two_levels", "SELECT r_name, n_name, s_suppkey FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey")
def _(a: Analyst) -> DataFrame:
    out = a.find_many("Region", include={"nations": Args(order_by=("n_name",), include={"suppliers": Args(select=("s_suppkey",))})})
    out = out.select("r_name", F.explode("nations").alias("n")).select("r_name", "n.n_name", F.explode_outer("n.suppliers").alias("s"))
    return out.select("r_name", "n_name", "s.s_suppkey")


@query("rel_count", "SELECT c_custkey, count(o_orderkey) AS orders_count FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey")
def _(a: Analyst) -> DataFrame:
    return a.find_many("Customer", select=("c_custkey",), count={"orders": f("o_orderstatus").eq("F")})


@query(
    "order_by_relation",
    "SELECT o_orderkey, c_name AS by, row_number() OVER (ORDER BY c_name DESC, o_orderkey) AS ordinal FROM orders LEFT JOIN customer "
    "ON o_custkey = c_custkey",
)
def _(a: Analyst) -> DataFrame:
    return a.order_by_relation("Order", "customer", "c_name", True)


@query(
    "order_by_count",
    "SELECT c_custkey, n AS by, row_number() OVER (ORDER BY n DESC, c_custkey) AS ordinal FROM (SELECT c_custkey, count(o_orderkey) AS "
    "n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)",
)
def _(a: Analyst) -> DataFrame:
    return a.order_by_relation("Customer", "orders", "_count", True)


# --- policy ---------------------------------------------------------------------------------------------------------------
_EUROPE = "FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE' AND c_mktsegment <> 'BUILDING'"
find("policy_row_constraint", f"SELECT c_custkey, c_mktsegment {_EUROPE}", "Customer", EUROPE_NOT_BUILDING, select=("c_custkey", "c_mktsegment"))
find(
    "policy_deny_override",
    "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0 OR c_mktsegment <> 'BUILDING'",
    "Customer", Policies(OPEN | {"Customer": Rules().can("read").cannot("read", f("c_mktsegment").eq("BUILDING")).can("read", f("c_mktsegment").eq("BUILDING") & f("c_acctbal").gt(0))}), select=("c_custkey",),
)
find(
    "policy_field_mask",
    f"SELECT c_custkey, CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN {BALANCE} END AS c_acctbal FROM customer",
    "Customer", BALANCE_OF_AUTOMOBILE, select=("c_custkey", "c_acctbal"),
)
find(
    "policy_relation_mask",
    f"SELECT c_custkey, CASE WHEN n_regionkey = 1 THEN {BALANCE} END AS c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "Customer", BALANCE_BY_REGION, select=("c_custkey", "c_acctbal"),
)
find(
    "policy_hop_expansion",
    f"SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey {_EUROPE})",
    "Order", EUROPE_NOT_BUILDING, where=r("customer").is_null(), select=KEY,
)


@query("policy_discharged_aggregate", f"SELECT sum({BALANCE}) AS total, count(*) AS n FROM customer WHERE c_mktsegment = 'AUTOMOBILE'")
def _(a: Analyst) -> DataFrame:
    mine = Analyst(a.catalog, BALANCE_OF_AUTOMOBILE)
    return mine.aggregate("Customer", [sum_("c_acctbal", "total"), count_all()], f("c_mktsegment").eq("AUTOMOBILE"))


ORDERS_OF_BUILDING = Policies(OPEN | {"Customer": Rules().can("read").cannot("read", ALL, ("orders",)).can("read", f("c_mktsegment").eq("BUILDING"), ("orders",))})


@query(
    "policy_masked_relation",
    "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN count(o_orderkey) END AS loaded, CASE WHEN c_mktsegment = 'BUILDING' "
    "THEN count(o_orderkey) END AS counted FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment",
)
def _(a: Analyst) -> DataFrame:
    mine = Analyst(a.catalog, ORDERS_OF_BUILDING)
    out = mine.find_many("Customer", include={"orders": Args(select=KEY)}, count=None)
    counted = mine.find_many("Customer", select=("c_custkey",), count={"orders": ALL})
    loaded = out.select("c_custkey", F.when(F.col("orders").isNotNull(), F.size("orders").cast("bigint")).alias("loaded"))
    return loaded.join(counted.withColumnRenamed("orders_count", "counted"), "c_custkey")


NATION_OF_REGION_1 = Policies(OPEN | {"Nation": Rules().can("read").cannot("read", ALL, ("n_name",)).can("read", f("n_nationkey").eq(3), ("n_name",))})


@query("policy_equality_transfer", "SELECT n_name AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_nationkey = 3 GROUP BY 1")
def _(a: Analyst) -> DataFrame:
    return Analyst(a.catalog, NATION_OF_REGION_1).group_by("Customer", {"nation": ("nation", "n_name")}, [count_all()], where=f("c_nationkey").eq(3))


# --- analytics ------------------------------------------------------------------------------------------------------------
HALF_UP = "CAST(CAST(sign(s) * ((2 * abs(s) + n) // (2 * n)) AS DECIMAL(36,0)) * CAST(0.01 AS DECIMAL(2,2)) AS DECIMAL(38,2))"


@query("agg_global", f"SELECT count(*) AS n, count({RICH}) AS rich, min(c_name) AS low, max(c_acctbal)::DECIMAL(18,2) AS high FROM customer")
def _(a: Analyst) -> DataFrame:
    return a.aggregate("Customer", [count_all(), count_("rich", "rich"), min_("c_name", "low"), max_("c_acctbal", "high")])


@query("agg_empty_nulls", "SELECT 0::BIGINT AS n, NULL::DECIMAL(38,2) AS total, NULL::VARCHAR AS low")
def _(a: Analyst) -> DataFrame:
    return a.aggregate("Customer", [count_all(), sum_("c_acctbal", "total"), min_("c_name", "low")], f("c_custkey").lt(0)).withColumn("total", F.col("total").cast("decimal(38,2)"))


@query("agg_exact_int_sum", "SELECT CAST(sum(o_orderkey) AS DECIMAL(38,0)) AS total FROM orders")
def _(a: Analyst) -> DataFrame:
    return a.aggregate("Order", [sum_("o_orderkey", "total")])


@query("agg_decimal_avg", f"SELECT o_orderstatus, {HALF_UP} AS mean FROM (SELECT o_orderstatus, sum(CAST({TOTAL} * 100 AS HUGEINT)) AS s, count(*) AS n FROM orders GROUP BY 1)")
def _(a: Analyst) -> DataFrame:
    return a.group_by("Order", {"o_orderstatus": "o_orderstatus"}, [avg_("o_totalprice", "mean")])


@query("agg_float", "SELECT event_type, round(sum(value), 6) AS total, round(avg(value), 9) AS mean, CAST(avg(user_id) AS DOUBLE) AS users FROM events GROUP BY 1")
def _(a: Analyst) -> DataFrame:
    out = a.group_by("Event", {"event_type": "event_type"}, [sum_("value", "total"), avg_("value", "mean"), avg_("user_id", "users")])
    return out.withColumns({"total": F.round("total", 6), "mean": F.round("mean", 9)})  # sums of doubles have no one order


@query(
    "agg_page",
    f"SELECT count(*) AS n, CAST(sum({TOTAL}) AS DECIMAL(28,2)) AS total, min({TOTAL}) AS low FROM (SELECT * FROM orders WHERE "
    f"o_orderstatus = 'F' ORDER BY {TOTAL} DESC, o_orderkey LIMIT 50 OFFSET 10)",
)
def _(a: Analyst) -> DataFrame:
    measures = [count_all(), sum_("o_totalprice", "total"), min_("o_totalprice", "low")]
    return a.aggregate("Order", measures, f("o_orderstatus").eq("F"), order_by=(("o_totalprice", "desc"),), skip=10, take=50)


@query("agg_page_cursor", f"SELECT count(*) AS n, max({TOTAL}) AS high FROM (SELECT * FROM orders WHERE o_orderkey >= 100 ORDER BY o_orderkey LIMIT 40)")
def _(a: Analyst) -> DataFrame:
    return a.aggregate("Order", [count_all(), max_("o_totalprice", "high")], cursor={"o_orderkey": 100}, take=40)


@query(
    "group_by",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS quantity, "
    "CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS price FROM lineitem GROUP BY ALL",
)
def _(a: Analyst) -> DataFrame:
    return a.group_by("Lineitem", {"l_returnflag": "l_returnflag", "l_linestatus": "l_linestatus"}, [count_all(), sum_("l_quantity", "quantity"), sum_("l_extendedprice", "price")])


@query("group_null_key", f"SELECT CAST({RICH} AS DECIMAL(18,2)) AS rich, count(*) AS n FROM customer GROUP BY 1")
def _(a: Analyst) -> DataFrame:
    return a.group_by("Customer", {"rich": "rich"}, [count_all()])


@query("group_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
def _(a: Analyst) -> DataFrame:
    return a.group_by("Order", {"o_custkey": "o_custkey"}, [count_all()], having=x.out("n").gt(12))


@query("group_having_text", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 HAVING contains(min(c_name), '1')")
def _(a: Analyst) -> DataFrame:
    return a.group_by("Customer", {"c_nationkey": "c_nationkey"}, [count_all(), min_("c_name", "_low")], having=x.out("_low").contains("1"))


@query(
    "group_having_tree",
    f"SELECT c_nationkey, max(c_name) AS high, count({RICH}) AS rich FROM customer GROUP BY 1 HAVING (contains(lower(max(c_name)), "
    f"'r#') AND count({RICH}) BETWEEN 5 AND 30 OR c_nationkey IN (1, 2)) AND NOT (count(*) = 50) AND max(c_acctbal) IS NOT NULL",
)
def _(a: Analyst) -> DataFrame:
    n, high = x.out("_n"), x.out("high")
    having = ((high.contains("R#", fold=True) & x.out("rich").between(5, 30)) | x.out("c_nationkey").in_(1, 2)) & ~n.eq(50) & x.out("_top").is_not_null()
    measures = [max_("c_name", "high"), count_("rich", "rich"), count_all("_n"), max_("c_acctbal", "_top")]
    return a.group_by("Customer", {"c_nationkey": "c_nationkey"}, measures, having=having)


@query(
    "group_order_page",
    "SELECT o_custkey, n, row_number() OVER (ORDER BY n DESC, o_custkey) AS ordinal FROM (SELECT o_custkey, count(*) AS n FROM orders "
    "GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 10 OFFSET 5)",
)
def _(a: Analyst) -> DataFrame:
    return a.group_by("Order", {"o_custkey": "o_custkey"}, [count_all()], order_by=(("n", "desc"),), skip=5, take=10)


@query(
    "group_negative_take",
    "SELECT o_custkey, n, row_number() OVER (ORDER BY n DESC, o_custkey) AS ordinal FROM (SELECT o_custkey, count(*) AS n FROM orders "
    "GROUP BY 1 ORDER BY n, o_custkey DESC LIMIT 10)",
)
def _(a: Analyst) -> DataFrame:
    return a.group_by("Order", {"o_custkey": "o_custkey"}, [count_all()], order_by=(("n", "desc"),), take=-10)


_BY_NATION = "SELECT n_name AS nation, count(*) AS n, CAST(sum({0}) AS DECIMAL(28,2)) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1".format(BALANCE)


@query("relation_group_by", _BY_NATION)
def _(a: Analyst) -> DataFrame:
    return a.group_by("Customer", {"nation": ("nation", "n_name")}, [count_all(), sum_("c_acctbal", "total")])


@query(
    "relation_group_by_two_hops",
    f"SELECT r_name AS region, o_orderstatus AS status, count(*) AS n, max({TOTAL}) AS high FROM orders JOIN customer ON o_custkey = "
    "c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
)
def _(a: Analyst) -> DataFrame:
    return a.group_by("Order", {"region": ("customer", "nation", "region", "r_name"), "status": "o_orderstatus"}, [count_all(), max_("o_totalprice", "high")])


@query(
    "relation_group_two_phase",
    f"SELECT segment, n, total, {HALF_UP} AS mean FROM (SELECT c_mktsegment AS segment, count(*) AS n, CAST(sum({TOTAL}) AS "
    f"DECIMAL(38,2)) AS total, sum(CAST({TOTAL} * 100 AS HUGEINT)) AS s FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)",
)
def _(a: Analyst) -> DataFrame:
    out = a.relation_group_two_phase("Order", "customer", ("segment", "c_mktsegment"), [count_all(), sum_("o_totalprice", "total"), avg_("o_totalprice", "mean")])
    return out.select("segment", "n", F.col("total").cast("decimal(38,2)").alias("total"), "mean")


# --- scoped queries -------------------------------------------------------------------------------------------------------
@query("scoped_inner_join", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING'")
def _(a: Analyst) -> DataFrame:
    q = ScopedQuery.of(a, "Order", "o").join("inner", "o", "customer", "c").where(x.field("c", "c_mktsegment").ne("BUILDING"))
    return q.select(o_orderkey=x.field("o", "o_orderkey"), c_name=x.field("c", "c_name")).frame()


@query("scoped_left_join", "SELECT d.doc_id, toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(a: Analyst) -> DataFrame:
    return ScopedQuery.of(a, "Document", "d").join("left", "d", "label", "l").select(doc_id=x.field("d", "doc_id"), toxic=x.field("l", "toxic")).frame()


@query("scoped_join_on", "SELECT s_suppkey, count(*) AS customers FROM supplier JOIN customer ON s_nationkey = c_nationkey GROUP BY 1")
def _(a: Analyst) -> DataFrame:
    q = ScopedQuery.of(a, "Supplier", "s").join_on("inner", "Customer", "c", [(x.field("s", "s_nationkey"), "c_nationkey")])
    return q.group_by(s_suppkey=x.field("s", "s_suppkey")).select(customers=x.count()).frame()


@query("scoped_to_many_fanout", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey")
def _(a: Analyst) -> DataFrame:
    q = ScopedQuery.of(a, "Customer", "c").join("inner", "c", "orders", "o")
    return q.select(c_custkey=x.field("c", "c_custkey"), o_orderkey=x.field("o", "o_orderkey")).frame()


@query(
    "scoped_group_having",
    f"SELECT c_mktsegment AS segment, count(*) AS n, CAST(sum({TOTAL}) AS DECIMAL(28,2)) AS total FROM orders JOIN customer ON "
    "o_custkey = c_custkey GROUP BY 1 HAVING count(*) > 2950",
)
def _(a: Analyst) -> DataFrame:
    q = ScopedQuery.of(a, "Order", "o").join("inner", "o", "customer", "c").group_by(segment=x.field("c", "c_mktsegment"))
    return q.select(n=x.count(), total=x.sum_(x.field("o", "o_totalprice"))).having(x.out("n").gt(2950)).frame()


@query("scoped_window_min", f"SELECT o_orderkey, min({TOTAL}) OVER (PARTITION BY o_custkey) AS low, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders")
def _(a: Analyst) -> DataFrame:
    by = (x.field("o", "o_custkey"),)
    q = ScopedQuery.of(a, "Order", "o")
    return q.select(o_orderkey=x.field("o", "o_orderkey"), low=x.min_(x.field("o", "o_totalprice")).over(by), n=x.count().over(by)).frame()


@query("scoped_count_distinct", "SELECT o_orderstatus AS status, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def _(a: Analyst) -> DataFrame:
    return ScopedQuery.of(a, "Order", "o").group_by(status=x.field("o", "o_orderstatus")).select(customers=x.count_distinct(x.field("o", "o_custkey"))).frame()


@query("scoped_expr_group", f"SELECT CASE WHEN {TOTAL} >= 100000 THEN 'high' ELSE 'low' END AS band, year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY ALL")
def _(a: Analyst) -> DataFrame:
    band = x.case((x.field("o", "o_totalprice").gte(100000), "high"), otherwise="low")
    return ScopedQuery.of(a, "Order", "o").group_by(band=band, year=x.call("year", x.field("o", "o_orderdate"))).select(n=x.count()).frame()


@query(
    "scoped_window_key_group",
    f"WITH w AS (SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS k, {TOTAL} AS t FROM orders) SELECT k, count(*) AS n, "
    "max(t) AS high FROM w GROUP BY k",
)
def _(a: Analyst) -> DataFrame:
    q = ScopedQuery.of(a, "Order", "o").select(k=x.count().over((x.field("o", "o_custkey"),)), t=x.field("o", "o_totalprice"))
    return q.step("w").group_by(k=x.field("w", "k")).select(n=x.count(), high=x.max_(x.field("w", "t"))).frame()


@query(
    "scoped_cte_pipeline",
    f"WITH per AS (SELECT o_custkey AS k, count(*) AS n, max({TOTAL}) AS high FROM orders GROUP BY 1), first AS (SELECT *, row_number() "
    "OVER (PARTITION BY n ORDER BY high DESC, k) AS place FROM per) SELECT n, k, high FROM first WHERE place = 1",
)
def _(a: Analyst) -> DataFrame:
    k, n, high = (x.field("per", c) for c in ("k", "n", "high"))
    q = ScopedQuery.of(a, "Order", "o").group_by(k=x.field("o", "o_custkey")).select(n=x.count(), high=x.max_(x.field("o", "o_totalprice")))
    q = q.step("per").select(n=n, k=k, high=high, place=x.row_number().over((n,), ((high, "desc"), k))).step("first")
    return q.where(x.field("first", "place").eq(1)).select(**{c: x.field("first", c) for c in ("n", "k", "high")}).frame()


@query(
    "scoped_cte_join",
    f"WITH per AS (SELECT o_custkey AS k, o_orderstatus AS s, sum({TOTAL}) AS total FROM orders GROUP BY 1, 2), top AS (SELECT k, "
    "max(total) AS most FROM per GROUP BY 1) SELECT per.k, per.s FROM per JOIN top ON per.k = top.k AND per.total = top.most",
)
def _(a: Analyst) -> DataFrame:
    q = ScopedQuery.of(a, "Order", "o").group_by(k=x.field("o", "o_custkey"), s=x.field("o", "o_orderstatus")).select(total=x.sum_(x.field("o", "o_totalprice"))).step("per")
    q = q.group_by(k=x.field("per", "k")).select(most=x.max_(x.field("per", "total"))).step("top").from_step("per")
    q = q.join_step("inner", "top", "t", [(x.field("per", "k"), "k"), (x.field("per", "total"), "most")])
    return q.select(k=x.field("per", "k"), s=x.field("per", "s")).frame()


@query(
    "scoped_cross_normaliser",
    f"WITH per AS (SELECT o_custkey AS k, sum({TOTAL}) AS total FROM orders GROUP BY 1), top AS (SELECT max(total) AS most FROM per) "
    "SELECT k, round(CAST(total AS DOUBLE) / CAST(most AS DOUBLE), 9) AS share FROM per CROSS JOIN top",
)
def _(a: Analyst) -> DataFrame:
    q = ScopedQuery.of(a, "Order", "o").group_by(k=x.field("o", "o_custkey")).select(total=x.sum_(x.field("o", "o_totalprice"))).step("per")
    q = q.select(most=x.max_(x.field("per", "total"))).step("top").from_step("per").cross_step("top", "t")
    share = x.call("round", x.field("per", "total").cast("double") / x.field("t", "most").cast("double"), 9)
    return q.select(k=x.field("per", "k"), share=share).frame()


@query("scoped_subquery_from", f"SELECT o_custkey, n FROM (SELECT o_custkey, count(*) AS n FROM orders WHERE {TOTAL} > 1000 GROUP BY 1) WHERE n BETWEEN 3 AND 8")
def _(a: Analyst) -> DataFrame:
    q = ScopedQuery.of(a, "Order", "o").where(x.field("o", "o_totalprice").gt(1000)).group_by(o_custkey=x.field("o", "o_custkey")).select(n=x.count())
    return q.step("per").where(x.field("per", "n").between(3, 8)).select(o_custkey=x.field("per", "o_custkey"), n=x.field("per", "n")).frame()


@query(
    "scoped_exists",
    f"SELECT c_custkey FROM customer WHERE EXISTS (FROM orders WHERE o_custkey = c_custkey AND {TOTAL} > 200000) AND NOT EXISTS (FROM "
    "orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
)
def _(a: Analyst) -> DataFrame:
    on = [(x.field("c", "c_custkey"), "o_custkey")]
    q = ScopedQuery.of(a, "Customer", "c").exists("Order", on, f("o_totalprice").gt(200000)).exists("Order", on, f("o_orderstatus").eq("P"), negate=True)
    return q.select(c_custkey=x.field("c", "c_custkey")).frame()


@query(
    "scoped_exists_step",
    "WITH busy AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12) SELECT c_custkey FROM customer "
    "WHERE c_custkey IN (SELECT k FROM busy)",
)
def _(a: Analyst) -> DataFrame:
    q = ScopedQuery.of(a, "Order", "o").group_by(k=x.field("o", "o_custkey")).select(n=x.count()).having(x.out("n").gt(12)).step("busy")
    q = q.root("Customer", "c").exists_step("busy", [(x.field("c", "c_custkey"), "k")])
    return q.select(c_custkey=x.field("c", "c_custkey")).frame()


@query("scoped_multipass", """
WITH days AS (SELECT user_id AS u, event_type AS t, CAST(year(ts) AS BIGINT) * 100 + month(ts) AS d, value AS v FROM events WHERE event_type <> 'error'),
firsts AS (SELECT u, t, d, v, min(d) OVER (PARTITION BY u) AS start FROM days),
ages AS (SELECT u, t, d - start AS age, count(*) AS n, sum(CAST(v AS DECIMAL(18,2))) AS total FROM firsts GROUP BY ALL),
baseline AS (SELECT t, age, sum(n) AS plays, sum(total) AS whole FROM ages GROUP BY ALL),
scored AS (SELECT a.u, a.t, sum(CAST(a.total AS DOUBLE) / nullif(CAST(b.whole AS DOUBLE), 0)) AS score, CAST(sum(a.n) AS BIGINT) AS n FROM ages a JOIN baseline b ON a.t = b.t AND a.age = b.age GROUP BY ALL),
most AS (SELECT max(score) AS top FROM scored)
SELECT u, t, n, round(least(score, 4) / top, 9) AS normal FROM scored CROSS JOIN most
""")
def _(a: Analyst) -> DataFrame:
    e = lambda c: x.field("e", c)
    q = ScopedQuery.of(a, "Event", "e").where(e("event_type").ne("error"))
    d = x.call("year", e("ts")) * 100 + x.call("month", e("ts"))
    q = q.select(u=e("user_id"), t=e("event_type"), d=d, v=e("value").cast("decimal(18,2)")).step("days")
    q = q.select(**{c: x.field("days", c) for c in "utdv"}, start=x.min_(x.field("days", "d")).over((x.field("days", "u"),))).step("firsts")
    w = lambda c: x.field("firsts", c)
    q = q.group_by(u=w("u"), t=w("t"), age=w("d") - w("start")).select(n=x.count(), total=x.sum_(w("v"))).step("ages")
    g = lambda c: x.field("ages", c)
    q = q.group_by(t=g("t"), age=g("age")).select(plays=x.sum_(g("n")), whole=x.sum_(g("total"))).step("baseline").from_step("ages")
    q = q.join_step("inner", "baseline", "b", [(g("t"), "t"), (g("age"), "age")])
    part = g("total").cast("double") / x.field("b", "whole").cast("double")
    q = q.group_by(u=g("u"), t=g("t")).select(score=x.sum_(part), n=x.sum_(g("n"))).step("scored")
    q = q.select(top=x.max_(x.field("scored", "score"))).step("most").from_step("scored").cross_step("most", "m")
    z = lambda c: x.field("scored", c)
    normal = x.call("round", x.call("least", z("score"), 4.0) / x.field("m", "top"), 9)
    return q.select(u=z("u"), t=z("t"), n=z("n"), normal=normal).frame()


@query(
    "scoped_scalars",
    f"SELECT c_custkey, lower(c_mktsegment) || '/' || length(c_name) AS label, abs({BALANCE}) AS size, CASE WHEN {RICH} IS NULL THEN "
    f"NULL ELSE {BALANCE} END AS strict, {BALANCE} AS loose, CAST(coalesce({RICH}, 0) AS DECIMAL(18,2)) AS filled, nullif(c_nationkey, "
    "3) AS nation FROM customer",
)
def _(a: Analyst) -> DataFrame:
    c = lambda name: x.field("c", name)
    label = x.call("concat", x.call("lower", c("c_mktsegment")), "/", x.call("length", c("c_name")).cast("string"))
    money = lambda e: e.cast("decimal(18,2)")
    return ScopedQuery.of(a, "Customer", "c").select(
        c_custkey=c("c_custkey"), label=label, size=x.call("abs", c("c_acctbal")), strict=money(x.call("least_strict", c("c_acctbal"), c("rich"))),
        loose=money(x.call("least", c("c_acctbal"), c("rich"))), filled=money(x.call("coalesce", c("rich"), 0)), nation=x.call("nullif", c("c_nationkey"), 3),
    ).frame()


# --- vectors --------------------------------------------------------------------------------------------------------------
_RANK = "WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(1 - list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q))), 9) AS distance FROM embeddings, q{} ORDER BY distance, vec_id LIMIT 10"


def _ranked(a: Analyst) -> DataFrame:
    vector = a.catalog.rows("Vector").filter("vec_id = 0").first()["embedding"]
    out = semantic.rank(a.find_many("Vector"), "vec_id", "embedding", vector, 10)
    return out.select("vec_id", F.round("distance", 9).alias("distance"))


query("semantic_rank_topk", _RANK.format(""))(_ranked)
query("semantic_rank_authorised", _RANK.format(" WHERE label <> 3"))(lambda a: _ranked(Analyst(a.catalog, Policies(OPEN | {"Vector": Rules().can("read").cannot("read", f("label").eq(3))}))))


@query(
    "semantic_refresh_dirty",
    "SELECT doc_id, CASE WHEN doc_id % 7 = 0 OR doc_id % 7 = 1 THEN 'embed' END AS action FROM documents WHERE doc_id % 7 <= 1 UNION "
    "ALL SELECT -1, 'delete'",
)
def _(a: Analyst) -> DataFrame:
    docs = a.catalog.rows("Document")
    h = semantic.document_hash(["lang", "text"])
    known = docs.filter("doc_id % 7 <> 0").select("doc_id", F.when(F.col("doc_id") % 7 == 1, "old").otherwise(h).alias("hash"))
    known = known.unionByName(a.catalog.spark.sql("SELECT -1L AS doc_id, 'gone' AS hash"))
    return semantic.refresh(docs, "doc_id", ["lang", "text"], known)


@query(
    "semantic_search",
    "WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0) SELECT doc_id, lang, round(1 - "
    "list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * "
    "sqrt(list_dot_product(q, q))), 9) AS distance FROM documents JOIN embeddings ON vec_id = doc_id, q WHERE lang = 'en' ORDER BY "
    "distance, doc_id LIMIT 10",
)
def _(a: Analyst) -> DataFrame:
    vectors = a.catalog.rows("Vector").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    query = a.catalog.rows("Vector").filter("vec_id = 0").first()["embedding"]
    mine = Analyst(a.catalog, Policies(OPEN | {"Document": Rules().can("read", f("lang").eq("en"))}))
    out = semantic.search(mine, "Document", vectors, query, 10, most=None)
    return out.select("doc_id", "lang", F.round("distance", 9).alias("distance"))


@query("semantic_refreshed", "SELECT n_nationkey, 'v2' AS fingerprint, CASE WHEN n_nationkey % 3 = 0 THEN 7.0::DOUBLE ELSE length(n_name)::DOUBLE END AS first FROM nation")
def _(a: Analyst) -> DataFrame:
    rows = a.catalog.rows("Nation")
    # Of every third row the vector is fresh; of others the document or the embedder has changed; one belongs to no row.
    h = F.when(F.col("n_nationkey") % 3 == 1, "old").otherwise(semantic.document_hash(["n_name"]))
    known = rows.select("n_nationkey", h.alias("hash"), F.when(F.col("n_nationkey") % 3 == 2, "v1").otherwise("v2").alias("fingerprint"), F.array(F.lit(7.0), F.lit(1.0)).alias("vector"))
    known = known.unionByName(a.catalog.spark.sql("SELECT -1 AS n_nationkey, 'gone' AS hash, 'v2' AS fingerprint, array(1.0D, 1.0D) AS vector"))
    made = semantic.refreshed(rows, "n_nationkey", ["n_name"], known, lambda texts: [[len(t) - len("n_name: "), 1.0] for t in texts], fingerprint="v2", dimensions=2, batch=4)
    return made.select("n_nationkey", "fingerprint", F.col("vector")[0].alias("first"))


# --- front end ------------------------------------------------------------------------------------------------------------
@query(
    "graphql_find_many",
    f"SELECT o_orderkey AS key, {TOTAL} AS price, c_name AS customer FROM orders JOIN customer ON o_custkey = c_custkey WHERE "
    f"o_orderstatus = 'O' AND c_mktsegment = 'BUILDING' ORDER BY {TOTAL} DESC, o_orderkey LIMIT 25 OFFSET 5",
)
def _(a: Analyst) -> DataFrame:
    document = """query Open($segment: String!, $n: Int = 25) {
      orders(where: {o_orderstatus: "O", customer: {is: {c_mktsegment: {equals: $segment}}}}, orderBy: [{o_totalprice: desc}], skip: 5, take: $n) { key: o_orderkey price: o_totalprice ...who }
    } fragment who on Order { customer { c_name } }"""
    out = graphql.execute(a, document, {"segment": "BUILDING"})["orders"]
    return out.select("key", "price", F.col("customer.c_name").alias("customer"))


@query(
    "graphql_aliases",
    "SELECT c_custkey, count(*) FILTER (WHERE o_orderstatus = 'O') AS opened, count(*) FILTER (WHERE o_orderstatus = 'F') AS closed, "
    "count(o_orderkey) AS every FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 50) LEFT JOIN orders ON o_custkey = c_custkey "
    "GROUP BY 1",
)
def _(a: Analyst) -> DataFrame:
    document = '{ customers(orderBy: [{c_custkey: asc}], take: 50) { c_custkey opened: orders(where: {o_orderstatus: "O"}) { o_orderkey } closed: orders(where: {o_orderstatus: "F"}) { o_orderkey } _count { orders } } }'
    out = graphql.execute(a, document)["customers"]
    return out.select("c_custkey", *[F.size(c).cast("bigint").alias(c) for c in ("opened", "closed")], F.col("_count.orders").alias("every"))


@query("graphql_aggregate", f"SELECT count(*) AS n, CAST(sum({TOTAL}) AS DECIMAL(28,2)) AS total, max({TOTAL}) AS high FROM orders WHERE o_orderpriority LIKE '1%'")
def _(a: Analyst) -> DataFrame:
    out = graphql.execute(a, '{ ordersAggregate(where: {o_orderpriority: {startsWith: "1"}}) { n: _count _sum { o_totalprice } _max { o_totalprice } } }')["ordersAggregate"]
    return out.select("n", F.col("_sum.o_totalprice").alias("total"), F.col("_max.o_totalprice").alias("high"))


@query(
    "graphql_group_by",
    f"SELECT n_name, o_orderstatus, count(*) AS n, min({TOTAL}) AS low FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation "
    f"ON c_nationkey = n_nationkey GROUP BY ALL HAVING count(*) > 100 AND NOT max({TOTAL}) < 1000",
)
def _(a: Analyst) -> DataFrame:
    document = '{ g: ordersGroupBy(by: ["customer.nation.n_name", "o_orderstatus"], having: {_count: {gt: 100}, NOT: {_max: {o_totalprice: {lt: 1000}}}}) { n_name o_orderstatus _count _min { o_totalprice } } }'
    return graphql.execute(a, document)["g"].select("n_name", "o_orderstatus", F.col("_count").alias("n"), F.col("_min.o_totalprice").alias("low"))


# --- changes and writes ---------------------------------------------------------------------------------------------------
def _facts(a: Analyst) -> DataFrame:
    """The events as facts about customers: every fact twice, as a source that delivers at least once may."""
    action = F.when(F.col("event_type").isin("signup", "view"), "created").when(F.col("event_type") == "error", "deleted").otherwise("updated")
    n = a.catalog.rows("Customer").count()
    out = a.catalog.rows("Event").select("event_id", action.alias("action"), (F.pmod("user_id", F.lit(n + 50))).alias("identity"), F.col("ts").alias("at"), F.when(F.col("user_id") % 2 == 0, "BUILDING").otherwise("MACHINERY").alias("old_segment"))
    return out


_FACTS = "WITH c AS (SELECT count(*) AS n FROM customer), facts AS (SELECT event_id, CASE WHEN event_type IN ('signup', 'view') THEN 'created' WHEN event_type = 'error' THEN 'deleted' ELSE 'updated' END AS action, user_id % (n + 50) AS identity, CASE WHEN user_id % 2 = 0 THEN 'BUILDING' ELSE 'MACHINERY' END AS old_segment FROM events, c) "
NOT_BUILDING = Policies(OPEN | {"Customer": Rules().can("read").cannot("read", f("c_mktsegment").eq("BUILDING"))})


@query("event_filter_created", _FACTS + "SELECT event_id, action FROM facts WHERE action <> 'deleted' AND identity IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_acctbal > 0)")
def _(a: Analyst) -> DataFrame:
    return change_feed(_facts(a), Analyst(a.catalog, NOT_BUILDING), "Customer", f("c_acctbal").gt(0), {"c_mktsegment": "old_segment"}).select("event_id", "action")


@query("event_deleted_snapshot", _FACTS + "SELECT event_id, action FROM facts WHERE action <> 'deleted' AND identity IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') OR action = 'deleted' AND old_segment <> 'BUILDING'")
def _(a: Analyst) -> DataFrame:
    return change_feed(_facts(a), Analyst(a.catalog, NOT_BUILDING), "Customer", ALL, {"c_mktsegment": "old_segment"}).select("event_id", "action")


@query("event_dedup", _FACTS + "SELECT event_id, action, identity FROM facts")
def _(a: Analyst) -> DataFrame:
    facts = _facts(a)
    return deduplicated(facts.unionByName(facts)).select("event_id", "action", "identity")


@query("write_update_increment", f"SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN CAST({BALANCE} + 10 AS DECIMAL(18,2)) ELSE {BALANCE} END AS c_acctbal FROM customer")
def _(a: Analyst) -> DataFrame:
    return Writer(a.catalog).update_many("Customer", f("c_mktsegment").eq("BUILDING"), c_acctbal="c_acctbal + 10").after.select("c_custkey", "c_acctbal")


@query("write_update_facts", "SELECT 'Customer' AS model, 'updated' AS action, '{\"c_custkey\":' || c_custkey || '}' AS identity FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(a: Analyst) -> DataFrame:
    return Writer(a.catalog).update_many("Customer", f("c_mktsegment").eq("BUILDING"), c_acctbal="c_acctbal + 10").facts


@query("write_delete_many", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(a: Analyst) -> DataFrame:
    return Writer(a.catalog).delete_many("Order", r("customer").is_(f("c_mktsegment").eq("BUILDING"))).after.select("o_orderkey")


@query("write_upsert", "SELECT r_regionkey, CASE WHEN r_regionkey IN (1, 2) THEN r_name || '*' ELSE r_name END AS r_name FROM region UNION ALL SELECT 99, 'NEW'")
def _(a: Analyst) -> DataFrame:
    rows = a.catalog.spark.sql("SELECT * FROM VALUES (1, 'x'), (2, 'y'), (99, 'NEW') AS t(r_regionkey, r_name)")
    return Writer(a.catalog).upsert_many("Region", rows, r_name="concat(old.r_name, '*')").after


@query("write_verified_create", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 50, 'OK'")
def _(a: Analyst) -> DataFrame:
    rules = Policies(OPEN | {"Region": Rules().can("read").can("create", f("r_name").starts_with("O"))})
    return Writer(a.catalog, rules).create_many("Region", a.catalog.spark.sql("SELECT 50 AS r_regionkey, 'OK' AS r_name")).after


# --- units of work --------------------------------------------------------------------------------------------------------
def _unit(a: Analyst, **more) -> Unit:
    return Unit(a.catalog, **more)


NATION_LINKS = (OnDelete("Customer", "nation", "cascade"), OnDelete("Supplier", "nation", "set_null"), OnDelete("Order", "customer", "cascade"), OnDelete("Lineitem", "order", "no_action"))


@query("unit_cascade", "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey <> 3")
def _(a: Analyst) -> DataFrame:
    u = _unit(a, on_delete=NATION_LINKS)
    u.delete("Nation", f("n_nationkey").eq(3))
    return u.rows("Order").select("o_orderkey")


@query("unit_set_null", "SELECT s_suppkey, CASE WHEN s_nationkey NOT IN (3, 4, 5) THEN s_nationkey END AS s_nationkey FROM supplier")
def _(a: Analyst) -> DataFrame:
    u = _unit(a, on_delete=NATION_LINKS)
    u.delete("Nation", f("n_nationkey").in_(3, 4, 5))
    return u.rows("Supplier").select("s_suppkey", "s_nationkey")


_IDENTITY = "'{\"n_nationkey\":' || n_nationkey || '}'"


@query(
    "unit_facts_in_order",
    f"SELECT 'Nation' AS model, 'updated' AS action, 0 AS ordinal, {_IDENTITY} AS identity FROM nation WHERE n_regionkey = 1 UNION ALL "
    f"SELECT 'Nation', 'deleted', 1, {_IDENTITY} FROM nation WHERE n_regionkey = 1",
)
def _(a: Analyst) -> DataFrame:
    u = _unit(a)
    u.update("Nation", f("n_regionkey").eq(1), n_name="concat(n_name, '!')")
    u.delete("Nation", f("n_name").ends_with("!"))  # sees the write before it
    return u.facts().select("model", "action", "ordinal", "identity")


@query("nested_create_connect", "SELECT n_nationkey, n_name, CASE WHEN n_nationkey < 3 THEN 2 ELSE n_regionkey END AS n_regionkey FROM nation UNION ALL SELECT 90, 'NEW', 2")
def _(a: Analyst) -> DataFrame:
    u = _unit(a)
    asia = u.nested("Region", {"r_regionkey": 2}, "nations")
    asia.create(a.catalog.spark.sql("SELECT 90 AS n_nationkey, 'NEW' AS n_name")).connect(f("n_nationkey").lt(3))
    return u.rows("Nation")


@query("nested_set", "SELECT n_nationkey, CASE WHEN n_nationkey IN (0, 1) THEN 2 WHEN n_regionkey <> 2 THEN n_regionkey END AS n_regionkey FROM nation")
def _(a: Analyst) -> DataFrame:
    u = _unit(a)
    u.nested("Region", {"r_regionkey": 2}, "nations").set(f("n_nationkey").in_(0, 1))
    return u.rows("Nation").select("n_nationkey", "n_regionkey")


@query(
    "nested_update_delete",
    "SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN lower(n_name) ELSE n_name END AS n_name FROM nation WHERE NOT (n_regionkey = 2 "
    "AND n_nationkey > 15)",
)
def _(a: Analyst) -> DataFrame:
    u = _unit(a)
    u.nested("Region", {"r_regionkey": 2}, "nations").update(ALL, n_name="lower(n_name)").delete(f("n_nationkey").gt(15))
    return u.rows("Nation").select("n_nationkey", "n_name")


@query("nested_connect_or_create", "SELECT n_nationkey, n_name, CASE WHEN n_nationkey = 0 THEN 2 ELSE n_regionkey END AS n_regionkey FROM nation UNION ALL SELECT 91, 'Y', 2")
def _(a: Analyst) -> DataFrame:
    u = _unit(a)
    u.nested("Region", {"r_regionkey": 2}, "nations").connect_or_create(a.catalog.spark.sql("SELECT * FROM VALUES (0, 'X'), (91, 'Y') AS t(n_nationkey, n_name)"))
    return u.rows("Nation")


@query("versioned_update", "SELECT p_partkey, CASE WHEN p_partkey <= 10 THEN p_size + 1 ELSE p_size END AS p_size FROM part")
def _(a: Analyst) -> DataFrame:
    u = _unit(a, versions={"Part": "p_size"})
    u.update("Part", f("p_partkey").lte(10), p_name="upper(p_name)")
    return u.rows("Part").select("p_partkey", "p_size")


# --- fields, caps, drift ---------------------------------------------------------------------------------------------------
@query("computed_field", f"SELECT c_custkey, c_name || '/' || c_mktsegment AS label, length(c_mktsegment) AS size FROM customer WHERE {BALANCE} > 0")
def _(a: Analyst) -> DataFrame:
    fields = {"label": Computed(("c_name", "c_mktsegment"), "concat(c_name, '/', c_mktsegment)"), "size": Batched(("c_mktsegment",), lambda pdf: pdf["c_mktsegment"].str.len(), "bigint")}
    return with_computed(a, "Customer", fields, select=("c_custkey", "label", "size"), where=f("c_acctbal").gt(0))


@query(
    "alias_occurrences",
    "SELECT c_custkey, count(*) FILTER (WHERE o_orderstatus = 'O') AS opened, count(*) FILTER (WHERE o_orderstatus = 'F') AS closed "
    "FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
)
def _(a: Analyst) -> DataFrame:
    loads = {s: ("orders", Args(where=f("o_orderstatus").eq(v), select=("o_orderkey",))) for s, v in (("opened", "O"), ("closed", "F"))}
    out = with_alias(a, "Customer", loads, select=("c_custkey",))
    return out.select("c_custkey", *[F.size(s).cast("bigint").alias(s) for s in loads])


@query("result_cap", "SELECT n_nationkey FROM nation")
def _(a: Analyst) -> DataFrame:
    return capped(a.find_many("Nation", select=("n_nationkey",)), 25)


@query("schema_drift", "SELECT 'Customer' AS model, 'c_acctbal' AS field, 'cast' AS state UNION ALL SELECT 'Customer', 'rich', 'derived'")
def _(a: Analyst) -> DataFrame:
    return drift(a.catalog).filter("model = 'Customer' and state <> 'same'").select("model", "field", "state")


# --- outbox ----------------------------------------------------------------------------------------------------------------
_AT = "timestamp'2024-01-01 00:00:00'"


def _outbox(a: Analyst) -> DataFrame:
    facts = a.catalog.rows("Event").select(F.col("event_id").cast("string").alias("event_id"), (F.col("user_id") % 100).alias("causation"), F.col("event_id").alias("ordinal"))
    return waiting(facts, F.expr(_AT))


_FIRSTS = "SELECT user_id % 100 AS causation, min(event_id) AS e FROM events GROUP BY 1"


@query("outbox_claim", f"SELECT CAST(e AS VARCHAR) AS event_id FROM ({_FIRSTS})")
def _(a: Analyst) -> DataFrame:
    return claim(_outbox(a), "w", F.expr(_AT), 60).filter("state = 'claimed'").select("event_id")


@query(
    "outbox_settle",
    f"WITH c AS ({_FIRSTS}) SELECT CAST(event_id AS VARCHAR) AS event_id, CASE WHEN e IS NOT NULL AND event_id % 3 = 0 THEN 'delivered' "
    "ELSE 'waiting' END AS state, CASE WHEN e IS NOT NULL THEN 1 ELSE 0 END AS attempts FROM events LEFT JOIN c ON e = event_id",
)
def _(a: Analyst) -> DataFrame:
    held = claim(_outbox(a), "w", F.expr(_AT), 60)
    results = held.filter("state = 'claimed'").select("event_id", (F.col("ordinal") % 3 == 0).alias("sent"))
    return settle(held, results, "w", F.expr(_AT)).select("event_id", "state", "attempts")


_OP = "CASE event_id % 3 WHEN 0 THEN 'c' WHEN 1 THEN 'u' ELSE 'd' END"


@query(
    "cdc_facts",
    "SELECT sha256('shop|' || length(CAST(event_id AS VARCHAR)) || ':' || event_id || '|' || length(CAST(user_id AS VARCHAR)) || ':' "
    f"|| user_id || '|1:' || {_OP}) AS event_id, CASE event_id % 3 WHEN 0 THEN 'created' WHEN 1 THEN 'updated' ELSE 'deleted' END AS "
    f"action, '{{\"id\":' || user_id || '}}' AS identity, event_id AS position FROM events",
)
def _(a: Analyst) -> DataFrame:
    log = a.catalog.rows("Event").selectExpr("event_id AS lsn", "user_id AS id", "element_at(array('c', 'u', 'd'), CAST(event_id % 3 AS int) + 1) AS op")
    return from_changes(log.unionByName(log), "shop", position="lsn", key=["id"], op="op")


@query("fact_decode", "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN CAST(props ->> '$.k' AS BIGINT) END AS k FROM events")
def _(a: Analyst) -> DataFrame:
    facts = a.catalog.rows("Event").selectExpr("event_id", "CAST(event_id % 3 + 1 AS int) AS fact_version", "CASE WHEN event_id % 3 = 0 THEN replace(props, '\"k\"', '\"old_k\"') ELSE props END AS payload")
    out = decoded(facts, {1: ("old_k string", {"k": "CAST(old.old_k AS bigint)"}), 2: ("k bigint", {"k": "old.k"})})
    return out.select("event_id", "body.k")


# --- jobs -----------------------------------------------------------------------------------------------------------------
def _jobs(a: Analyst) -> DataFrame:
    """A job an event; those of one user exclude each other, and one of each type and value in whole units is enough."""
    new = a.catalog.rows("Event").selectExpr("CAST(event_id AS string) AS job_id", "props AS payload", "concat(event_type, '/', CAST(floor(value) AS string)) AS dedupe", "CASE WHEN user_id % 2 = 0 THEN CAST(user_id AS string) END AS exclusive", "CAST(event_id % 3 * 60 AS int) AS delay_s")
    none = a.catalog.spark.createDataFrame([], "job_id string, payload string, dedupe string, exclusive string, state string, attempts int, due timestamp, owner string, code string, changed timestamp")
    return jobs.enqueued(none, new, F.expr(_AT))


_JOBS = "WITH j AS (SELECT *, CAST(event_id AS VARCHAR) AS job_id, CASE WHEN user_id % 2 = 0 THEN user_id END AS x, event_id % 3 AS late FROM events QUALIFY row_number() OVER (PARTITION BY event_type, CAST(floor(value) AS BIGINT) ORDER BY CAST(event_id AS VARCHAR)) = 1) "


@query("job_enqueue", _JOBS + "SELECT job_id, 'waiting' AS state, late FROM j")
def _(a: Analyst) -> DataFrame:
    late = F.expr(f"CAST((unix_seconds(due) - unix_seconds({_AT})) / 60 AS bigint)").alias("late")
    return _jobs(a).select("job_id", "state", late)


_RUN = "c AS (SELECT job_id FROM j WHERE late <= 1 AND (x IS NULL OR job_id IN (SELECT min_by(job_id, (late, job_id)) FROM j WHERE late <= 1 AND x IS NOT NULL GROUP BY x)) ORDER BY late, job_id LIMIT 100)"


@query("job_claim", _JOBS + f", {_RUN} SELECT job_id FROM c")
def _(a: Analyst) -> DataFrame:
    return jobs.claimed(_jobs(a), "w", F.expr(f"{_AT} + interval 1 minute"), 60, 100).filter("state = 'running'").select("job_id")


@query("job_settle", _JOBS + f", {_RUN} SELECT job_id, CASE WHEN job_id NOT IN (FROM c) THEN 'waiting' WHEN event_id % 3 = 0 THEN 'done' WHEN event_id % 3 = 1 THEN 'failed' ELSE 'waiting' END AS state, CASE WHEN job_id IN (FROM c) THEN 1 ELSE 0 END AS attempts FROM j")
def _(a: Analyst) -> DataFrame:
    now = F.expr(f"{_AT} + interval 1 minute")
    held = jobs.claimed(_jobs(a), "w", now, 60, 100)
    outcome = F.element_at(F.array(F.lit("done"), F.lit("failed"), F.lit("retry")), F.expr("CAST(job_id AS int) % 3 + 1"))
    told = held.filter("state = 'running'").select("job_id", outcome.alias("outcome"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("double").alias("delay_s"))
    return jobs.settled(held, told, "w", now).select("job_id", "state", "attempts")


# --- migrations -------------------------------------------------------------------------------------------------------------
def _after() -> list[Model]:
    """The nations with a name of their own, a rank that is filled in, and a wider key."""
    nation = Model("Nation", "nation", {"n_nationkey": "bigint", "label": "string", "n_regionkey": "int", "grade": "int"}, ("n_nationkey",), {"region": Relation("region", "Region", (("n_regionkey", "r_regionkey"),))})
    region = Model("Region", "region", {"r_regionkey": "int", "r_name": "string"}, ("r_regionkey",))
    return [nation, region]


def _plan() -> migrate.Plan:
    before = [m for m in MODELS if m.name in ("Nation", "Region")]
    return migrate.diff(before, _after(), {("nation", "n_name"): "label"}, {("nation", "grade"): "length(label) + n_regionkey"})


@query(
    "migration_plan",
    "SELECT * FROM (VALUES ('rename_column', 'nation', 'n_name', 'rewrite'), ('alter_column_type', 'nation', 'n_nationkey', "
    "'rewrite'), ('add_column', 'nation', 'grade', 'rewrite'), ('backfill_column', 'nation', 'grade', 'rewrite')) AS t(kind, model, "
    "field, risk)",
)
def _(a: Analyst) -> DataFrame:
    return a.catalog.spark.createDataFrame([(c.kind, c.table, c.column, c.risk) for c in _plan().changes], "kind string, model string, field string, risk string")


@query("migration_apply", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name AS label, n_regionkey, CAST(length(n_name) + n_regionkey AS INTEGER) AS grade FROM nation")
def _(a: Analyst) -> DataFrame:
    return migrate.migrated(_plan(), lambda t: a.catalog._load(t))["nation"]


# --- flagship -------------------------------------------------------------------------------------------------------------
@query(
    "flagship_open_orders",
    f"SELECT o_orderkey, {TOTAL} AS o_totalprice, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' "
    f"ORDER BY {TOTAL} DESC, o_orderkey LIMIT 20",
)
def _(a: Analyst) -> DataFrame:
    out = a.find_many("Order", where=f("o_orderstatus").eq("O"), order_by=(("o_totalprice", "desc"),), take=20, include={"customer": Args(select=("c_name",))})
    return out.select("o_orderkey", "o_totalprice", F.col("customer.c_name").alias("c_name"))


@query(
    "audit_revenue",
    "SELECT p_brand AS brand, year(l_shipdate) AS year, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS "
    "DECIMAL(18,2)))) AS DECIMAL(38,4)) AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL",
)
def _(a: Analyst) -> DataFrame:
    q = ScopedQuery.of(a, "Lineitem", "l").join("inner", "l", "part", "p").group_by(brand=x.field("p", "p_brand"), year=x.call("year", x.field("l", "l_shipdate")))
    return q.select(revenue=x.sum_(x.field("l", "l_extendedprice") * (1 - x.field("l", "l_discount"))).cast("decimal(38,4)")).frame()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
