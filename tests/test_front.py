"""GraphQL documents, subscriptions, jobs, migrations, vectors, observations, and units that meet."""

import pytest
from pyspark.sql import functions as F

from policyframe.functions.observe import Observer
from policyframe.operators import graphql, semantic
from policyframe.operators.analytics import Analyst
from policyframe.operators.reads import ReadLimits
from policyframe.operators.units import Unit
from policyframe.plans.catalog import Model, Relation
from policyframe.plans.graphql import GraphQLError, parse
from policyframe.plans.policy import Forbidden, Policies, Rules
from policyframe.plans.predicate import ALL, Field, json_path
from policyframe.queries import BALANCE_OF_AUTOMOBILE, OPEN
from policyframe.sources import migrate
from policyframe.sources.tables import catalog
from policyframe.streaming import jobs
from policyframe.streaming.hub import Broker, Closed, Hub, MemoryTransport, Subscription

f = Field


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return catalog(spark, sf_dir)


# --- GraphQL ----------------------------------------------------------------------------------------------------------------
def test_documents():
    (a, b) = parse('query Q($x: Int = 3, $no: Boolean!) { a(n: $x, l: [1, -2.5e1, "q\\"\\u0041", null, true, asc]) { id ...F } b @skip(if: $no) { id } c @include(if: $no) { id } } fragment F on T { id more { x } ... on T { more { y } } }', {"no": True})
    assert (a.alias, a.arguments) == ("a", {"n": 3, "l": [1, -25.0, 'q"A', None, True, "asc"]})
    assert [s.name for s in a.fields] == ["id", "more"] and [s.name for s in a.fields[1].fields] == ["x", "y"]
    assert b.name == "c"
    for bad in ("", "{", "{}", "{ a(", "mutation { a }", "{ a(x: $y) }", "query($x: Int!) { a }", "{ a b: ... }", "{ a: x a: y }", "{ ...F } fragment F on T { ...F }", "query A { a } query B { b }", "{ a @live }", "{ a(x: 1, x: 2) }", "{ a ? }"):
        with pytest.raises(GraphQLError):
            parse(bad)


def test_reads_by_document(tables):
    a = Analyst(tables)
    run = lambda d, v=None: {k: [r.asDict(True) for r in df.collect()] for k, df in graphql.execute(a, d, v).items()}
    got = run('{ order(where: {o_orderkey: 7}) { __typename key: o_orderkey customer { c_name nation { n_name region { r_name } } } } n: ordersCount(where: {o_orderstatus: {in: ["O", "F"]}}) regions(orderBy: [{r_name: desc}]) { r_name nations(orderBy: [{n_name: asc}], take: -2) { n_name _count { suppliers } } } }')
    assert got["order"][0]["__typename"] == "Order" and list(got["order"][0]) == ["__typename", "key", "customer"]
    assert got["n"][0]["n"] == a.count("Order", f("o_orderstatus").in_("O", "F")).first()["n"]
    names = [r["r_name"] for r in got["regions"]]
    assert names == sorted(names, reverse=True) and all(len(r["nations"]) == 2 and r["nations"][0]["n_name"] < r["nations"][1]["n_name"] for r in got["regions"])
    assert len(run("{ orders { o_orderkey } }")["orders"]) == 100
    assert run("query($c: JSON) { orders(cursor: $c, take: 2, skip: 1) { o_orderkey } }", {"c": {"o_orderkey": 5}})["orders"] == [{"o_orderkey": 6}, {"o_orderkey": 7}]
    for bad in ("{ secrets { x } }", "{ orders { secret } }", "{ orders }", "{ orders { customer } }", "{ orders(limit: 3) { o_orderkey } }", '{ orders(where: {o_x: 1}) { o_orderkey } }', "{ orders(orderBy: [{o_x: asc}]) { o_orderkey } }", "{ orders(orderBy: [{o_orderkey: up}]) { o_orderkey } }", "{ order(where: {o_orderstatus: \"F\"}) { o_orderkey } }", "{ orders { _count { customer } } }", "{ ordersAggregate { o_orderkey } }", '{ ordersGroupBy(by: ["o_orderstatus"]) { o_custkey } }', '{ ordersGroupBy(by: ["o_orderstatus"], having: {x: {gt: 1}}) { _count } }', "{ lineitem(where: {l_orderkey: 1}) { l_tax } }"):
        with pytest.raises((GraphQLError, ValueError)):
            graphql.execute(a, bad)
    with pytest.raises(ValueError, match="deeper"):
        graphql.execute(Analyst(tables, limits=ReadLimits(depth=2)), "{ regions { nations { customers { c_name } } } }")


def test_documents_obey_the_policy(tables):
    a = Analyst(tables, BALANCE_OF_AUTOMOBILE)
    rows = graphql.execute(a, "{ customers(take: 1000) { c_mktsegment c_acctbal } }")["customers"].collect()
    assert {r["c_mktsegment"] for r in rows if r["c_acctbal"] is not None} == {"AUTOMOBILE"}
    for bad in ("{ customers(where: {c_acctbal: {gt: 0}}) { c_name } }", "{ customersAggregate { _sum { c_acctbal } } }", "{ orders { customer(where: {c_acctbal: {gt: 0}}) { c_name } } }"):
        with pytest.raises(Forbidden):
            graphql.execute(a, bad)


def test_schema_text(tables):
    text = graphql.sdl(tables)
    assert "type Customer {" in text and "  orders(where: JSON" in text and "  c_acctbal: Decimal" in text and "  order(where: JSON!): Order" in text and "lineitem(where: JSON!)" not in text


def test_json_paths():
    assert json_path('$.a."b c"[0].d') == ("a", "b c", 0, "d") and json_path(["a", "0"]) == ("a", 0) and json_path("$") == ()
    for bad in ("a", "$a", "$.", "$[x]", "$.a[", '$."a'):
        with pytest.raises(ValueError):
            json_path(bad)


# --- subscriptions ------------------------------------------------------------------------------------------------------------
FACTS = "SELECT * FROM VALUES ('e1', 'created', 1L, timestamp'2024-01-01 00:00:00'), ('e2', 'updated', 2L, timestamp'2024-01-01 00:01:00'), ('e1', 'created', 1L, timestamp'2024-01-01 00:00:00'), ('e3', 'updated', 9999999L, timestamp'2024-01-01 00:02:00') AS t(event_id, action, identity, at)"


def test_equal_subscribers_are_evaluated_once(spark, tables):
    hub, reader = Hub(), Analyst(tables, Policies(OPEN))
    a, b = (hub.subscribe(Subscription("ann", reader, "Customer", f("c_custkey").gt(0) & f("c_name").ne("x"))) for _ in range(2))
    same = hub.subscribe(Subscription("ann", reader, "Customer", f("c_name").ne("x") & f("c_custkey").gt(0)))
    other = hub.subscribe(Subscription("bob", reader, "Customer", f("c_custkey").gt(1)))
    slow = hub.subscribe(Subscription("eve", reader, "Customer", most=1))
    assert hub.publish(spark.sql(FACTS)) == 3
    for s in (a, b, same):
        assert [s.next()["event_id"], s.next()["event_id"], s.next()] == ["e1", "e2", None]
    assert [other.next()["event_id"], other.next()] == ["e2", None]
    with pytest.raises(Closed):
        slow.next()
    assert hub.publish(spark.sql(FACTS)) == 2


def test_hubs_hold_no_more_than_they_may(spark, tables):
    hub = Hub(most=3)
    a, b = (hub.subscribe(Subscription(p, Analyst(tables, Policies(OPEN)), "Customer")) for p in "ab")
    hub.publish(spark.sql(FACTS))
    assert a.next()["event_id"] == "e1" and b.reason


def test_hub_on_a_stream(spark, tables, tmp_path):
    spark.sql(FACTS).write.parquet(str(tmp_path / "facts"))
    hub = Hub()
    s = hub.subscribe(Subscription("ann", Analyst(tables, Policies(OPEN)), "Customer"))
    stream = spark.readStream.schema(spark.sql(FACTS).schema).parquet(str(tmp_path / "facts"))
    hub.attach(stream, str(tmp_path / "c")).awaitTermination()
    assert [r["event_id"] for r in s.queue] == ["e1", "e2"]


def test_transports(spark):
    bus, got, broken = MemoryTransport(), [], [True]

    def listener(df):
        if broken[0]:
            raise OSError
        got.append(df.count())

    bus.listen(listener)
    bus.publish(spark.sql(FACTS))
    assert bus.redeliver() == 1
    broken[0] = False
    assert bus.redeliver() == 0 and got == [4]
    broker = Broker("facts", "localhost:9092")
    facts = spark.sql(FACTS).withColumn("causation", F.col("identity"))
    sent = broker.messages(facts)
    assert sorted(map(tuple, broker.facts(sent, "event_id string, action string, identity bigint, at timestamp, causation bigint").collect())) == sorted(map(tuple, facts.collect()))
    assert {r["key"] for r in sent.collect()} == {"1", "2", "9999999"}


# --- jobs ---------------------------------------------------------------------------------------------------------------------
def test_jobs_live(spark):
    at = lambda s: F.expr(f"timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, {s})")
    none = spark.createDataFrame([], "job_id string, payload string, dedupe string, exclusive string, state string, attempts int, due timestamp, owner string, code string, changed timestamp")
    new = spark.createDataFrame([("a", "p", "d", None, 0), ("b", "p", "d", None, 0), ("c", "p", None, "x", 0), ("e", "p", None, "x", 0), ("g", "p", None, None, 90), ("a", "p", None, None, 0)], "job_id string, payload string, dedupe string, exclusive string, delay_s int")
    kept = lambda df: spark.createDataFrame(df.collect(), df.schema)  # noqa: E731 - a step's table, as a store would keep it
    state = lambda df: {r["job_id"]: (r["state"], r["attempts"], r["owner"]) for r in df.collect()}
    table = kept(jobs.enqueued(none, new, at(0)))
    assert sorted(state(table)) == ["a", "c", "e", "g"] or sorted(state(table)) == ["b", "c", "e", "g"]
    (first,) = set(state(table)) & {"a", "b"}
    table = kept(jobs.enqueued(table, new.filter("job_id = 'b' or job_id = 'a'").withColumn("dedupe", F.lit("d")), at(1)))
    assert len(state(table)) == 4  # an open job holds the dedupe key
    run = kept(jobs.claimed(table, "w", at(1), 60, 10))
    assert {k for k, v in state(run).items() if v[0] == "running"} == {first, "c"}
    assert {k for k, v in state(jobs.claimed(run, "v", at(2), 60, 10)).items() if v[2] == "v"} == set()  # held, excluded or not due
    late = kept(jobs.claimed(run, "v", at(100), 60, 10))
    assert {k for k, v in state(late).items() if v == ("running", 2, "v")} == {first, "c"} and state(late)["g"][2] == "v"
    renewed = jobs.claimed(jobs.renewed(run, "w", at(50), 60), "v", at(100), 60, 10)
    assert {k for k, v in state(renewed).items() if v[2] == "v"} == {"g"}
    told = spark.createDataFrame([(first, "retry", "busy", 5.0), ("c", "done", None, None)], "job_id string, outcome string, code string, delay_s double")
    assert state(jobs.settled(late, told, "w", at(101)))[first] == ("running", 2, "v")  # the lease went to another
    done = kept(jobs.settled(late, told, "v", at(101)))
    assert state(done)[first] == ("waiting", 2, None) and state(done)["c"] == ("done", 2, None)
    assert state(jobs.settled(late, told, "v", at(101), jobs.Backoff(attempts=2)))[first][0] == "failed"
    assert {k for k, v in state(jobs.claimed(done, "u", at(103), 60, 10)).items() if v[2] == "u"} == {"e"}
    off = kept(jobs.cancelled(done, F.col("job_id") == "e", at(104)))
    assert state(off)["e"][0] == "cancelled" and state(jobs.requeued(off, F.lit(True), at(105)))["e"] == ("waiting", 0, None)
    assert sorted(state(jobs.retained(off, at(1000), 100))) == sorted([first, "g"])


# --- migrations -----------------------------------------------------------------------------------------------------------------
def test_migrations(spark):
    a = Model("A", "a", {"k": "int", "v": "string", "old": "string"}, ("k",))
    b = Model("B", "b", {"k": "int", "a": "int"}, ("k",), {"a_": Relation("a_", "A", (("a", "k"),))})
    gone = Model("G", "g", {"k": "int"}, ("k",))
    a2 = Model("A", "aa", {"k": "bigint", "v": "string", "n": "int"}, ("k", "n"))
    b2 = Model("B", "b", b.fields, b.key, b.relations)
    plan = migrate.diff([a, b, gone], [a2, b2], {("table", "a"): "aa"}, {("aa", "n"): "length(v)"})
    assert [(c.kind, c.table, c.column) for c in plan.changes] == [("rename_table", "a", None), ("alter_column_type", "aa", "k"), ("add_column", "aa", "n"), ("backfill_column", "aa", "n"), ("drop_primary_key", "aa", None), ("add_primary_key", "aa", None), ("drop_column", "aa", "old"), ("drop_table", "g", None)]
    assert plan.risks() == {"safe": 3, "rewrite": 3, "data loss": 2}
    data = {"a": spark.sql("SELECT * FROM VALUES (1, 'x', 'o'), (1, 'yy', 'o') AS t(k, v, old)"), "b": spark.sql("SELECT 1 AS k, 1 AS a"), "g": spark.sql("SELECT 1 AS k")}
    with pytest.raises(ValueError, match="not accepted"):
        migrate.migrated(plan, data.__getitem__)
    out = migrate.migrated(plan, data.__getitem__, ("safe", "rewrite", "data loss"))
    assert sorted(out) == ["aa"] and sorted(map(tuple, out["aa"].collect())) == [(1, "x", 1), (1, "yy", 2)]
    keyed = migrate.Plan([migrate.Change("add_unique", "a", to=("k",))])
    with pytest.raises(Exception, match="no key"):
        migrate.migrated(keyed, data.__getitem__)["a"].collect()
    linked = migrate.diff([Model("A", "a", a.fields, a.key), Model("B", "b", b.fields, b.key)], [Model("A", "a", a.fields, a.key), b])
    assert [c.kind for c in linked.changes] == ["add_foreign_key"]
    assert migrate.migrated(linked, data.__getitem__)["b"].count() == 1
    with pytest.raises(Exception, match="not there"):
        migrate.migrated(linked, {**data, "b": spark.sql("SELECT 1 AS k, 7 AS a")}.__getitem__)["b"].collect()
    with pytest.raises(ValueError, match="files have no"):
        migrate.Change("create_index", "a").risk


# --- vectors --------------------------------------------------------------------------------------------------------------------
def test_vectors(spark, tables):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "k int, vector array<double>")
    assert semantic.validated(df, "vector", 2).count() == 2
    for bad in ([1.0], [0.0, 0.0], [float("nan"), 1.0], [None, 1.0], None):
        with pytest.raises(Exception, match="declared kind"):
            semantic.validated(spark.createDataFrame([(1, bad)], "k int, vector array<double>"), "vector", 2).collect()
    a = Analyst(tables)
    vectors = tables.rows("Nation").select("n_nationkey", F.array(F.col("n_nationkey").cast("double"), F.lit(1.0)).alias("vector"))
    got = semantic.search(a, "Nation", vectors, [0.0, 1.0], 3, where=f("n_nationkey").ne(0)).collect()
    assert [r["n_nationkey"] for r in got] == [1, 2, 3] and got[0]["similarity"] == pytest.approx(2**-0.5)
    with pytest.raises(ValueError, match="candidates"):
        semantic.search(a, "Nation", vectors, [0.0, 1.0], 3, most=24)
    with pytest.raises(ValueError, match="take"):
        semantic.search(a, "Nation", vectors, [0.0, 1.0], 1001)
    none = spark.createDataFrame([], "n_nationkey int, hash string, fingerprint string, vector array<double>")
    with pytest.raises(Exception, match="vectors for"):
        semantic.refreshed(tables.rows("Nation"), "n_nationkey", ["n_name"], none, lambda t: [[1.0]] * (len(t) - 1), fingerprint="x", dimensions=1).collect()


# --- observations, units ----------------------------------------------------------------------------------------------------------
def test_observations(spark, tables):
    said, calls = [], []

    def broken(_):
        calls.append(1)
        raise OSError

    watch = Observer(said.append, broken)
    rows = watch.run("find", ("Nation",), Analyst(tables).find_many("Nation"), lambda df: df.collect())
    assert said[0] | {"seconds": 0} == {"kind": "find", "models": ("Nation",), "seconds": 0, "rows": len(rows), "outcome": "done"}
    with pytest.raises(ZeroDivisionError):
        watch.run("find", ("Nation",), spark.range(1), lambda df: 1 / 0)
    assert said[1]["outcome"] == "ZeroDivisionError" and len(calls) == 1
    with pytest.raises(ValueError):
        watch.run("other", (), spark.range(1), lambda df: None)


def test_of_two_units_on_one_base_the_second_fails(tables, tmp_path):
    base = Unit(tables)
    base.update("Region", ALL, r_name="lower(r_name)")
    base.commit(str(tmp_path), "v1")
    for k, fails in ((2, False), (3, True)):
        u = Unit(tables)
        u.update("Region", ALL, r_name="upper(r_name)")
        if fails:
            with pytest.raises(ValueError, match="conflict"):
                u.commit(str(tmp_path), f"v{k}", base="v1")
        else:
            u.commit(str(tmp_path), f"v{k}", base="v1")
