"""Order, pages, relations, masks, bounds of scans, and everything that a scoped query refuses."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from policyframe.operators.analytics import Analyst, GroupLimits, count_all, max_, min_, sum_
from policyframe.operators.fields import with_alias
from policyframe.operators.reads import Args, ReadLimits
from policyframe.operators.scoped import ScopedQuery
from policyframe.plans import expression as x
from policyframe.plans.catalog import Catalog, Model, Relation
from policyframe.plans.expression import Refused
from policyframe.plans.policy import Forbidden, Policies, Rules
from policyframe.plans.predicate import ALL, Field
from policyframe.queries import BALANCE_OF_AUTOMOBILE, EUROPE_NOT_BUILDING, NATION_OF_REGION_1, OPEN
from policyframe.sources.tables import catalog

f = Field


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return catalog(spark, sf_dir)


@pytest.fixture(params=["-1", "10485760"])
def broadcasts(spark, request):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", request.param)
    yield request.param
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- order ----------------------------------------------------------------------------------------------------------------
def test_rows_come_in_order_after_joins(spark, tables, broadcasts):
    a = Analyst(tables)
    many = {"lineitems": Args(select=("l_quantity",))}
    for take in (20, -20, None):
        out = a.find_many("Order", where=f("o_orderstatus").eq("O"), order_by=(("o_totalprice", "desc"),), take=take, include={"customer": Args(select=("c_name",))} | many, count={"lineitems": ALL})
        found = [(-r["o_totalprice"], r["o_orderkey"]) for r in out.collect()]
        assert len(found) > 19 and found == sorted(found), take
    masked = Analyst(tables, BALANCE_OF_AUTOMOBILE).find_many("Customer", order_by=(("c_name", "desc"),), select=("c_custkey", "c_name", "c_acctbal"))
    names = [r["c_name"] for r in masked.collect()]
    assert names == sorted(names, reverse=True)
    aliased = with_alias(a, "Customer", {"o": ("orders", Args(take=1, select=("o_orderkey",)))}, select=("c_custkey",), order_by=(("c_acctbal", "desc"),), take=10)
    best = [r["c_custkey"] for r in a.find_many("Customer", order_by=(("c_acctbal", "desc"),), take=10).collect()]
    assert [r["c_custkey"] for r in aliased.collect()] == best


def test_whole_tables_are_numbered_in_parts(spark, tables):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = Analyst(tables).find_many("Order", order_by=(("o_orderdate", "desc"),), select=("o_orderkey", "o_orderdate"), ordinal="n")
        rows = out.collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows.sort(key=lambda r: r["n"])
    assert [r["n"] for r in rows] == list(range(1, len(rows) + 1))
    keys = [(-r["o_orderdate"].timestamp(), r["o_orderkey"]) for r in rows]
    assert keys == sorted(keys)


# --- relations ------------------------------------------------------------------------------------------------------------
def test_a_page_loads_its_own_targets_alone(spark, tables):
    a = Analyst(tables)
    flagship = a.find_many("Order", order_by=(("o_totalprice", "desc"),), take=20, include={"customer": Args(select=("c_name",))})
    children = a.find_many("Customer", order_by=(("c_acctbal", "desc"),), take=20, include={"orders": Args(order_by=("o_totalprice",), take=3)}, count={"orders": ALL})
    assert "LeftSemi" in plan(flagship) and plan(children).count("LeftSemi") == 2
    assert "LeftSemi" not in plan(a.find_many("Customer", include={"orders": Args(take=3)}))
    rows = children.collect()
    assert len(rows) == 20 and all(len(r["orders"]) == min(3, r["orders_count"]) for r in rows)


def test_a_second_target_fails_the_read(spark):
    data = {"a": spark.createDataFrame([(1, 1), (2, None), (3, 9)], "k int, b int"), "b": spark.createDataFrame([(1, "x"), (1, "y"), (None, "z"), (None, "w")], "k int, v string")}
    models = [Model("A", "a", {"k": "int", "b": "int"}, ("k",), {"b_": Relation("b_", "B", (("b", "k"),))}), Model("B", "b", {"k": "int", "v": "string"}, ("k",))]
    a = Analyst(Catalog(spark, models, data.__getitem__))
    with pytest.raises(Exception, match="several targets"):
        a.find_many("A", include={"b_": Args()}).collect()
    data["b"] = data["b"].filter("v <> 'y'")
    assert {r["k"]: r["b_"] and r["b_"]["v"] for r in a.find_many("A", include={"b_": Args()}).collect()} == {1: "x", 2: None, 3: None}


def test_relations_of_two_columns(spark):
    data = {"a": spark.createDataFrame([(1, 1), (1, 2), (1, None)], "x int, y int"), "b": spark.createDataFrame([(1, 1, 10), (1, 2, 20), (1, 2, 21), (1, None, 30), (2, 1, 40)], "x int, y int, v int")}
    pairs = (("x", "x"), ("y", "y"))
    models = [Model("A", "a", {"x": "int", "y": "int"}, ("x", "y"), {"bs": Relation("bs", "B", pairs, True)}), Model("B", "b", {"x": "int", "y": "int", "v": "int"}, ("v",), {"a": Relation("a", "A", pairs)})]
    a = Analyst(Catalog(spark, models, data.__getitem__))
    got = {(r["x"], r["y"]): [b["v"] for b in r["bs"]] for r in a.find_many("A", include={"bs": Args(order_by=(("v", "desc"),))}).collect()}
    assert got == {(1, 1): [10], (1, 2): [21, 20], (1, None): []}
    from policyframe.plans.predicate import Rel

    assert {r["v"] for r in a.find_many("B", where=Rel("a").is_null()).collect()} == {30, 40}


def test_limits_of_requests(tables):
    a = Analyst(tables, limits=ReadLimits(depth=2, selected=20))
    with pytest.raises(ValueError, match="deeper"):
        a.find_many("Region", include={"nations": Args(include={"suppliers": Args()})})
    with pytest.raises(ValueError, match="selected"):
        a.find_many("Order", include={"lineitems": Args(), "customer": Args()})


# --- policy -----------------------------------------------------------------------------------------------------------------
def test_classes_of_fields(tables):
    a = Analyst(tables, BALANCE_OF_AUTOMOBILE)
    hidden = Analyst(tables, Policies(OPEN | {"Customer": Rules().can("read").cannot("read", ALL, ("c_acctbal",))}))
    assert [a.classify("Customer", "c_name"), a.classify("Customer", "c_acctbal"), hidden.classify("Customer", "c_acctbal"), Analyst(tables).classify("Customer", "c_acctbal")] == ["always", "conditional", "never", "always"]
    with pytest.raises(Forbidden):
        hidden.find_many("Customer", select=("c_acctbal",))


def test_a_fixed_key_proves_what_lies_behind_it(tables):
    a = Analyst(tables, NATION_OF_REGION_1)
    by = {"nation": ("nation", "n_name")}
    assert a.group_by("Customer", by, [count_all()], where=f("c_nationkey").eq(3)).count() == 1
    for where in (ALL, f("c_nationkey").eq(4), f("c_nationkey").in_(3), f("c_nationkey").eq(3) | f("c_custkey").gt(0)):
        with pytest.raises(Forbidden):
            a.group_by("Customer", by, [count_all()], where=where)


# --- scans ------------------------------------------------------------------------------------------------------------------
def pushed(df):
    return " ".join(line for line in plan(df).splitlines() if "PushedFilters" in line)


def test_bounds_of_money_reach_the_scan(spark, tables):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    a = Analyst(tables)
    out = a.find_many("Order", where=f("o_totalprice").gte(1000) & f("o_totalprice").lt(50000), select=("o_orderkey",))
    assert "GreaterThanOrEqual(o_totalprice,999.9" in pushed(out) and "LessThanOrEqual(o_totalprice,50000.01" in pushed(out)
    either = a.find_many("Order", where=f("o_totalprice").lt(1000) | f("o_totalprice").gt(50000), select=("o_orderkey",))
    assert "Or(" in pushed(either)
    from policyframe.plans.predicate import Rel

    assert "GreaterThanOrEqual(o_totalprice" in pushed(a.find_many("Customer", where=Rel("orders").some(f("o_totalprice").gt(200000)), select=("c_custkey",)))
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_bounds_leave_no_row_out(spark):
    values = [0.005, 0.0049, 0.015, 0.995, 1.0, 1.005, 1.0049999, -0.005, -1.005, 1e13 + 0.01, 1e13, -1e13, 1e15, None, 2.675, 99999999999999.98]
    data = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k int, v double")
    a = Analyst(Catalog(spark, [Model("T", "t", {"k": "int", "v": "decimal(18,2)"}, ("k",))], lambda _: data))
    exact = {r["k"]: r["v"] for r in a.find_many("T").collect()}
    operands = sorted({v for v in exact.values() if v is not None} | {Decimal("1"), 0, 1.0, 10**13})
    tests = {"eq": lambda p, q: p == q, "lt": lambda p, q: p < q, "lte": lambda p, q: p <= q, "gt": lambda p, q: p > q, "gte": lambda p, q: p >= q}
    for op, holds in tests.items():
        for v in operands:
            got = {r["k"] for r in a.find_many("T", where=getattr(f("v"), op)(v), select=("k",)).collect()}
            assert got == {k for k, own in exact.items() if own is not None and holds(own, Decimal(str(v)))}, (op, v)


# --- analytics --------------------------------------------------------------------------------------------------------------
def test_limits_of_groups(tables):
    a = Analyst(tables)
    for limits in (GroupLimits(rows=10), GroupLimits(groups=3), GroupLimits(results=1)):
        with pytest.raises(ValueError, match="more than"):
            a.group_by("Order", {"s": "o_orderpriority"}, [count_all()], having=x.out("n").gt(0), limits=limits)
    assert a.group_by("Order", {"s": "o_orderpriority"}, [count_all()], limits=GroupLimits()).count() == 5
    with pytest.raises(ValueError, match="take"):
        a.group_by("Order", {"s": "o_orderpriority"}, [count_all()], take=101, most_take=100)


def test_having_is_typed(tables):
    a = Analyst(tables)
    run = lambda having: a.group_by("Customer", {"k": "c_nationkey"}, [count_all(), max_("c_name", "high"), min_("c_acctbal", "low")], having=having)
    for bad in ("n > 1", F.col("n") > 1, x.out("missing").gt(1), x.count().gt(1), x.field("c", "c_name").eq("x"), x.out("n").contains("1"), x.out("low").contains("1"), x.out("k").starts_with("1")):
        with pytest.raises(Refused):
            run(bad)
    assert run(x.out("high").contains("R#", fold=True)).count() == run(None).count() > run(x.out("high").contains("R#")).count() == 0


# --- scoped queries -----------------------------------------------------------------------------------------------------------
def test_scoped_queries_take_nothing_but_expressions(tables):
    q = ScopedQuery.of(Analyst(tables, EUROPE_NOT_BUILDING), "Customer", "c")
    key = x.field("c", "c_custkey")
    path = "SELECT count(*) FROM parquet.`/root/testdata/sf0.001/customer.parquet`"
    other = tables.rows("Customer")
    result = q.select(k=key)
    for bad in (
        lambda: q.select(n=f"({path})"),
        lambda: q.select(n=F.expr(f"({path})")),
        lambda: q.where("EXISTS (SELECT 1 FROM parquet.`/x`)"),
        lambda: q.where(F.lit(True)),
        lambda: q.where(lambda df: df),
        lambda: q.where(other),
        lambda: q.group_by(k="c.c_custkey"),
        lambda: result.having("k > 1"),
        lambda: result.page(["k"]),
        lambda: q.select(k=key, n=x.lit(other)),
        lambda: x.field("c", "c_custkey").eq(F.col("x")),
        lambda: x.call("reflect", "java.lang.System", "exit"),
        lambda: x.call("input_file_name"),
        lambda: key.cast("struct<a:int>"),
        lambda: key.cast("string) FROM x --"),
        lambda: result.step("p; drop table x"),
        lambda: ScopedQuery.of(q.reader, "customer", "c"),
        lambda: ScopedQuery.of(q.reader, "Customer", "c c"),
    ):
        with pytest.raises(Refused):
            bad()


def test_scoped_queries_read_what_they_joined(tables):
    q = ScopedQuery.of(Analyst(tables), "Order", "o")
    key = x.field("o", "o_orderkey")
    for kind in ("full", "right", "cross", "left_anti", "lateral", "leftsemi", "outer"):
        with pytest.raises(Refused):
            q.join(kind, "o", "customer", "c")
    step = q.group_by(k=x.field("o", "o_custkey")).select(n=x.count()).step("per")
    for bad in (
        lambda: q.select(v=x.field("secrets", "value")),
        lambda: q.select(v=x.field("o", "o_secret")),
        lambda: q.select(v=x.field("public.o", "o_orderkey")),
        lambda: q.select(v=x.out("o_orderkey")),
        lambda: q.join("inner", "c", "nation", "n"),
        lambda: q.join("inner", "o", "customer", "o"),
        lambda: q.join_on("inner", "Customer", "c", []),
        lambda: q.join_on("inner", "Customer", "c", [(key, "missing")]),
        lambda: q.join_on("inner", "customer", "c", [(key, "c_custkey")]),
        lambda: q.join_step("inner", "per", "p", [(key, "k")]),
        lambda: q.exists("Customer", []),
        lambda: q.exists("Customer", [(x.field("z", "z"), "c_custkey")]),
        lambda: step.exists_step("other", [(x.field("per", "k"), "k")]),
        lambda: step.exists_step("per", [(x.field("per", "k"), "missing")]),
        lambda: step.select(v=key),
        lambda: step.cross_step("per", "p"),
        lambda: step.select(k=x.field("per", "k")).step("per"),
        lambda: step.join("inner", "per", "customer", "c"),
        lambda: q.frame(),
        lambda: q.step("early"),
        lambda: q.page([key], 1),
        lambda: q.having(key.gt(1)),
        lambda: q.select(k=key).where(key.gt(1)),
        lambda: q.select(k=key).select(k=key),
        lambda: q.select(k=key).page([x.out("k")], 0),
    ):
        with pytest.raises(Refused):
            bad()
    for name in ("union", "unionAll", "unionByName", "intersect", "exceptAll", "crossJoin", "sql", "delete", "insert", "update", "modifyEnd", "withPlugin"):
        assert not hasattr(q, name)


def test_scoped_groups_and_windows_are_checked(tables):
    q = ScopedQuery.of(Analyst(tables), "Order", "o")
    key, total, status = (x.field("o", c) for c in ("o_orderkey", "o_totalprice", "o_orderstatus"))
    grouped = q.group_by(s=status)
    for bad in (
        lambda: grouped.select(k=key),
        lambda: grouped.select(k=x.sum_(total) + key),
        lambda: grouped.select(s=x.count()),
        lambda: grouped.select(k=x.sum_(x.count())),
        lambda: grouped.select(k=x.max_(x.min_(total).over((status,)))),
        lambda: grouped.select(k=x.sum_(total).over((status,))),
        lambda: grouped.where(key.gt(1)),
        lambda: grouped.join("inner", "o", "customer", "c"),
        lambda: q.select(k=key, n=x.count()),
        lambda: q.select(),
        lambda: q.group_by(),
        lambda: q.group_by(n=x.count()),
        lambda: q.where(x.count().gt(1)),
        lambda: q.where(x.row_number().over((status,), (key,)).eq(1)),
        lambda: q.select(n=x.row_number()),
        lambda: x.row_number().over((), (key,)),
        lambda: x.row_number().over((status,)),
        lambda: key.over((status,)),
        lambda: bool(key.gt(1)),
    ):
        with pytest.raises(Refused):
            bad()
    kept = grouped.select(n=x.count(), label=x.call("concat", x.call("lower", status), "!"))
    assert {r["label"] for r in kept.frame().collect()} <= {"o!", "f!", "p!"}


def test_masked_fields_are_shown_but_not_used(tables):
    a = Analyst(tables, BALANCE_OF_AUTOMOBILE)
    q = ScopedQuery.of(a, "Customer", "c")
    balance, segment = x.field("c", "c_acctbal"), x.field("c", "c_mktsegment")
    shown = q.select(s=segment, b=balance).frame()
    assert shown.filter("s <> 'AUTOMOBILE' and b is not null").count() == 0 < shown.filter("b is not null").count()
    for bad in (
        lambda: q.where(balance.gt(0)),
        lambda: q.group_by(b=balance).select(n=x.count()),
        lambda: q.group_by(s=segment).select(b=x.sum_(balance)),
        lambda: q.select(b=x.max_(balance)),
        lambda: q.select(s=segment, b=x.max_(balance).over((segment,))),
        lambda: q.select(s=segment, n=x.row_number().over((segment,), (balance,))),
        lambda: q.join_on("inner", "Supplier", "s", [(balance, "s_acctbal")]),
        lambda: ScopedQuery.of(a, "Supplier", "s").join_on("inner", "Customer", "c", [(x.field("s", "s_acctbal"), "c_acctbal")]),
        lambda: ScopedQuery.of(a, "Supplier", "s").exists("Customer", [(x.field("s", "s_acctbal"), "c_acctbal")]),
        lambda: q.when("c", f("c_acctbal").gt(0)),
    ):
        with pytest.raises(Forbidden):
            bad()
    proven = q.when("c", f("c_mktsegment").eq("AUTOMOBILE")).group_by(s=segment).select(b=x.sum_(balance), n=x.count()).frame().collect()
    (whole,) = Analyst(tables).aggregate("Customer", [sum_("c_acctbal", "b"), count_all()], f("c_mktsegment").eq("AUTOMOBILE")).collect()
    assert [(r["s"], r["b"], r["n"]) for r in proven] == [("AUTOMOBILE", whole["b"], whole["n"])]
    hidden = Analyst(tables, Policies(OPEN | {"Customer": Rules().can("read").cannot("read", ALL, ("c_acctbal",))}))
    with pytest.raises(Refused):
        ScopedQuery.of(hidden, "Customer", "c").select(b=balance)


def test_audit_records(tables):
    q = ScopedQuery.of(Analyst(tables, EUROPE_NOT_BUILDING), "Customer", "c").join("left", "c", "nation", "n").group_by(n=x.field("n", "n_name")).select(total=x.sum_(x.field("c", "c_acctbal") + 7))
    record = q.audit()
    assert record["model"] == ["Customer", "Nation"] and record["relation"] == ["c.nation"] and record["select"] == ["total: sum(+(c.c_acctbal, ?))"] and record["scoped"]
    said = []
    rows = q.audited(lambda df: df.collect(), said.append)
    assert said[0]["outcome"] == "done" and said[0]["rows"] == len(rows) and said[0]["seconds"] > 0
    assert q.audit()["fingerprint"] == said[0]["fingerprint"] != ScopedQuery.of(Analyst(tables), "Nation", "n").audit()["fingerprint"]
    with pytest.raises(ZeroDivisionError):
        q.audited(lambda df: 1 / 0, said.append)
    assert said[1]["outcome"] == "ZeroDivisionError"


def test_windows_and_passes_give_the_asserted_answers(spark):
    """Six posts: least views and how many of an author's, distinct views, bands."""
    rows = [(1, "a1", 1, True, 10), (2, "a2", 1, True, 30), (3, "a3", 1, False, 5), (4, "b1", 2, True, 20), (5, "b2", 2, True, 20), (6, "c1", 3, True, 99)]
    data = spark.createDataFrame(rows, "id int, title string, authorId int, published boolean, views int")
    models = [Model("Post", "posts", {"id": "int", "title": "string", "authorId": "int", "published": "boolean", "views": "int"}, ("id",))]
    a = Analyst(Catalog(spark, models, lambda _: data), Policies({"Post": Rules().can("read", f("published").eq(True))}))
    p = lambda c: x.field("p", c)
    q = ScopedQuery.of(a, "Post", "p")
    by = (p("authorId"),)
    got = {r["id"]: (r["low"], r["n"]) for r in q.select(id=p("id"), low=x.min_(p("views")).over(by), n=x.count().over(by)).frame().collect()}
    assert got == {1: (10, 2), 2: (10, 2), 4: (20, 2), 5: (20, 2), 6: (99, 1)}
    assert {r["a"]: r["n"] for r in q.group_by(a=p("authorId")).select(n=x.count_distinct(p("views"))).frame().collect()} == {1: 2, 2: 1, 3: 1}
    band = x.case((p("views").gte(20), "high"), otherwise="low")
    assert {r["b"]: r["n"] for r in q.group_by(b=band).select(n=x.count()).frame().collect()} == {"high": 4, "low": 1}


def test_dates_are_values(tables):
    q = ScopedQuery.of(Analyst(tables), "Order", "o").where(x.field("o", "o_orderdate").gte(datetime.datetime(1995, 1, 1)))
    assert 0 < q.select(n=x.count()).frame().first()["n"] <= Analyst(tables).count("Order").first()["n"]


def test_fields_without_an_order(spark):
    data = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, state string")
    a = Analyst(Catalog(spark, [Model("T", "t", {"id": "string", "state": "string"}, ("id",), unordered=frozenset({"id", "state"}))], lambda _: data))
    assert a.find_many("T", where=f("state").eq("x")).count() == 1
    for bad in (lambda: a.find_many("T", where=f("state").gt("x")), lambda: a.count("T", ~f("id").lte("x")), lambda: a.aggregate("T", [max_("state", "m")]), lambda: a.aggregate("T", [max_("missing", "m")])):
        with pytest.raises(ValueError):
            bad()


def test_outbox_retention_is_bounded(spark):
    from policyframe.streaming.outbox import retained

    box = spark.sql("SELECT concat('e', id) AS event_id, CASE WHEN id < 5 THEN 'delivered' ELSE 'waiting' END AS state, timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) AS due FROM range(8)")
    now = F.expr("timestamp'2024-01-02 00:00:00'")
    assert retained(box, now, 60).count() == 3
    assert {r["event_id"] for r in retained(box, now, 60, 2).collect()} == {f"e{k}" for k in range(2, 8)}
