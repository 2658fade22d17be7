"""Units of work, stores, computed fields, plans and the outbox."""

import datetime

import pytest
from pyspark.sql import functions as F

from policyframe.operators.fields import Batched, Computed, capped, plan_report, with_computed
from policyframe.operators.reads import Reader
from policyframe.operators.units import Hooks, NotFound, OnDelete, Unit
from policyframe.plans.policy import Policies, Rules
from policyframe.plans.predicate import ALL, Field
from policyframe.queries import OPEN
from policyframe.sources import stores
from policyframe.sources.tables import MODELS, catalog
from policyframe.streaming.outbox import Retry, claim, deliver, event_id, from_changes, retained, settle, waiting

f = Field


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return catalog(spark, sf_dir)


def fails(df, words):
    with pytest.raises(Exception, match=words):
        df.collect()


def test_commit_and_read_back(spark, tables, tmp_path):
    told = []
    u = Unit(tables, hooks=Hooks(committed=lambda facts: told.append(facts.count())))
    u.update("Region", f("r_regionkey").eq(1), r_name="'ONE'")
    u.create("Region", spark.sql("SELECT 70 AS r_regionkey, 'SEVENTY' AS r_name"))
    with pytest.raises(ValueError):
        stores.version(spark, tables, str(tmp_path), "v1")
    u.commit(str(tmp_path), "v1")
    new = stores.version(spark, tables, str(tmp_path), "v1")
    assert {r["r_name"] for r in new.rows("Region").collect()} >= {"ONE", "SEVENTY"}
    assert new.rows("Nation").count() == 25 and told == [2]
    with pytest.raises(ValueError):
        u.commit(str(tmp_path), "v1")


def test_a_denied_unit_leaves_no_version(spark, tables, tmp_path):
    rules = Policies(OPEN | {"Region": Rules().can("read").can("update", f("r_name").ne("ASIA"))})
    u = Unit(tables, rules)
    u.update("Region", ALL, r_name="'Z'")
    with pytest.raises(Exception, match="denied"):
        u.commit(str(tmp_path), "v1")
    with pytest.raises(ValueError):
        stores.version(spark, tables, str(tmp_path), "v1")


def test_restrict_versions_and_caps(tables):
    u = Unit(tables, on_delete=(OnDelete("Nation", "region"),), versions={"Part": "p_size"})
    u.delete("Region", f("r_regionkey").eq(1))
    fails(u.rows("Region"), "still refers")
    free = Unit(tables, on_delete=(OnDelete("Nation", "region"),))
    free.delete("Nation", f("n_regionkey").eq(1))
    free.delete("Region", f("r_regionkey").eq(1))
    assert free.rows("Region").count() == 4
    size = tables.rows("Part").filter("p_partkey = 1").first()["p_size"]
    u.update("Part", f("p_partkey").eq(1), expected=size, p_name="'x'")
    u.update("Part", f("p_partkey").eq(1), expected=size + 1, p_name="'y'")
    assert u.rows("Part").filter("p_partkey = 1").first()["p_size"] == size + 2
    u.update("Part", f("p_partkey").eq(1), expected=size, p_name="'z'")
    fails(u.rows("Part"), "conflict")
    with pytest.raises(ValueError, match="more than 3"):
        u.delete("Nation", ALL, most=3)
    with pytest.raises(ValueError, match="no version"):
        u.update("Nation", ALL, expected=1, n_name="'x'")


def test_set_default_and_cycles(tables):
    u = Unit(tables, on_delete=(OnDelete("Nation", "region", "set_default", {"n_regionkey": "0"}),))
    u.delete("Region", f("r_regionkey").eq(1))
    assert u.rows("Nation").filter("n_regionkey = 1").count() == 0 and u.rows("Nation").filter("n_regionkey is null").count() == 0
    loop = Unit(tables, on_delete=(OnDelete("Label", "document", "cascade"), OnDelete("Document", "label", "cascade")))
    with pytest.raises(ValueError, match="lead back"):
        loop.delete("Document", f("doc_id").eq(1))


def test_field_rules(tables):
    rules = Policies(OPEN | {"Customer": Rules().can("read").can("update").cannot("update", ALL, ("c_acctbal",)).can("update", f("c_mktsegment").eq("AUTOMOBILE"), ("c_acctbal",))})
    good = Unit(tables, rules)
    good.update("Customer", f("c_mktsegment").eq("AUTOMOBILE"), c_acctbal="c_acctbal + 1")
    good.update("Customer", ALL, c_name="upper(c_name)", c_acctbal="c_acctbal")  # the same value is no change
    assert good.rows("Customer").count() == tables.rows("Customer").count()
    bad = Unit(tables, rules)
    bad.update("Customer", ALL, c_acctbal="c_acctbal + 1")
    fails(bad.rows("Customer"), "c_acctbal is denied")


def test_hooks(spark, tables):
    seen = []

    def before(model, action, rows):
        if action == "delete":
            raise PermissionError(model)
        return rows.withColumn("r_name", F.upper("r_name"))

    u = Unit(tables, hooks=Hooks(before=before, after=lambda m, a, facts: seen.append((m, a))))
    u.create("Region", spark.sql("SELECT 71 AS r_regionkey, 'low' AS r_name"))
    u.update("Region", f("r_regionkey").eq(71), r_name="'lower'")
    assert u.rows("Region").filter("r_regionkey = 71").first()["r_name"] == "LOWER"
    with pytest.raises(PermissionError):
        u.delete("Region", ALL)
    assert seen == [("Region", "create"), ("Region", "update")]


def test_nested(spark, tables):
    u = Unit(tables, Policies(OPEN | {"Region": Rules().can("read", f("r_name").ne("ASIA"))}))
    with pytest.raises(NotFound):
        u.nested("Region", {"r_regionkey": 2}, "nations")
    with pytest.raises(ValueError):
        u.nested("Nation", {"n_nationkey": 1}, "region")
    u = Unit(tables)
    europe = u.nested("Region", {"r_regionkey": 3}, "nations").disconnect(f("n_nationkey").lt(10))
    assert u.rows("Nation").filter("n_regionkey = 3 and n_nationkey < 10").count() == 0
    europe.upsert(spark.sql("SELECT * FROM VALUES (95, 'NEW') AS t(n_nationkey, n_name)"), n_name="new.n_name")
    assert u.rows("Nation").filter("n_nationkey = 95").first()["n_regionkey"] == 3
    europe.upsert(spark.sql("SELECT * FROM VALUES (0, 'TAKEN') AS t(n_nationkey, n_name)"), n_name="new.n_name")
    fails(u.rows("Nation"), "another parent")


def test_computed_and_batched(tables):
    calls = tables.spark.sparkContext.accumulator(0)

    def size(pdf):
        calls.add(len(pdf))
        return pdf["c_mktsegment"].str.len()

    fields = {"size": Batched(("c_mktsegment",), size, "int"), "never": Computed(("c_name",), "raise_error('unasked')")}
    rows = with_computed(Reader(tables), "Customer", fields, select=("c_custkey", "size")).collect()
    assert len(rows) == tables.rows("Customer").count() and calls.value == 5


def test_cap_and_plan(tables):
    a = Reader(tables)
    assert capped(a.find_many("Nation"), 25).count() == 25
    fails(capped(a.find_many("Nation"), 24), "more than 24")
    report = plan_report(a.find_many("Customer", where=f("c_name").eq("a secret name"), select=("c_custkey",)))
    assert any(n.startswith("Scan") for _, n in report) and "secret" not in str(report) and "customer" not in str(report)


@pytest.mark.parametrize("kind", ["parquet", "json", "orc", "csv"])
def test_file_formats(spark, tables, tmp_path, kind):
    options = {"header": "true"} if kind == "csv" else {}
    tables.rows("Customer").drop("rich").write.format(kind).options(**options).save(f"{tmp_path}/customer.{kind}")
    model = next(m for m in MODELS if m.name == "Customer")
    plain = type(model)(model.name, model.table, model.fields, model.key, {}, model.derived)
    again = stores.files(spark, [plain], str(tmp_path), kind, **options).rows("Customer")
    assert sorted(again.collect()) == sorted(tables.rows("Customer").collect())


def test_database(spark, tables):
    url = "jdbc:derby:memory:units;create=true"
    tables.rows("Region").write.format("jdbc").option("url", url).option("dbtable", "region").option("quoteIdentifiers", "false").save()
    model = next(m for m in MODELS if m.name == "Region")
    plain = type(model)(model.name, model.table, model.fields, model.key)
    db = stores.database(spark, [plain], url, splits={"region": stores.Split("r_regionkey", 0, 5, 3)})
    df = Reader(db).find_many("Region", where=f("r_regionkey").gt(1))
    assert df.rdd.getNumPartitions() == 3 and sorted(r[0] for r in df.collect()) == [2, 3, 4]


def test_drift(spark, tables):
    rows = {(r["model"], r["field"]): r["state"] for r in stores.drift(tables).collect()}
    assert rows["Region", "r_name"] == "same" and rows["Order", "o_totalprice"] == "cast" and rows["Customer", "rich"] == "derived"
    assert rows["Lineitem", "l_tax"] == "extra"


AT = datetime.datetime(2024, 1, 1)


def now(seconds=0):
    return F.lit(AT + datetime.timedelta(seconds=seconds)).cast("timestamp")


def test_outbox(spark):
    facts = spark.sql("SELECT * FROM VALUES ('a1', 'a', 1), ('a2', 'a', 2), ('b1', 'b', 1) AS t(event_id, causation, ordinal)")
    box = waiting(facts, now())

    def states(df):
        return {r["event_id"]: (r["state"], r["attempts"]) for r in df.collect()}

    held = claim(box, "w", now(), 60)
    assert states(held) == {"a1": ("claimed", 0), "a2": ("waiting", 0), "b1": ("claimed", 0)}
    assert states(claim(held, "x", now(59), 60)) == states(held)
    assert [r["owner"] for r in claim(held, "x", now(60), 60).filter("event_id = 'a1'").collect()] == ["x"]
    told = spark.sql("SELECT * FROM VALUES ('a1', true), ('b1', false), ('a2', true) AS t(event_id, sent)")
    assert states(settle(held, told, "other", now())) == states(held)
    after = settle(held, told, "w", now(), Retry(first_s=10))
    assert states(after) == {"a1": ("delivered", 1), "a2": ("waiting", 0), "b1": ("waiting", 1)}
    due = {r["event_id"]: (r["due"] - AT).total_seconds() for r in after.collect()}
    assert 5 <= due["b1"] <= 10
    assert states(claim(after, "w", now(), 60))["a2"] == ("claimed", 0) and states(claim(after, "w", now(), 60))["b1"] == ("waiting", 1)
    blocked = settle(claim(after, "w", now(10), 60), told, "w", now(10), Retry(attempts=2))
    assert states(blocked)["b1"] == ("blocked", 2)
    assert states(claim(blocked, "w", now(99), 60))["b1"] == ("blocked", 2)
    assert states(retained(blocked, now(100), 95)) .keys() == {"a2", "b1"}
    assert [r["state"] for r in claim(box, "w", now(), 60, most=1).orderBy("event_id").collect()] == ["claimed", "waiting", "waiting"]


def test_event_ids_and_changes(spark):
    rows = spark.sql("SELECT * FROM VALUES ('a', 'bc'), ('ab', 'c'), (NULL, ''), ('', NULL) AS t(x, y)")
    assert rows.select(event_id("s", "x", "y").alias("e")).distinct().count() == 4
    log = spark.sql("SELECT 1 AS lsn, 5 AS id, 'z' AS op")
    fails(from_changes(log, "s", position="lsn", key=["id"], op="op"), "unknown change z")


def test_deliver(spark, tmp_path):
    facts = spark.sql("SELECT * FROM VALUES ('a1', 'a', 1), ('a1', 'a', 1), ('a2', 'a', 2) AS t(event_id, causation, ordinal)")
    facts.write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        stream = spark.readStream.schema(facts.schema).parquet(f"{tmp_path}/in")
        deliver(stream, lambda df: df.write.mode("append").parquet(f"{tmp_path}/out"), f"{tmp_path}/c").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
