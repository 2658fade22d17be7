"""Refusals, exact numbers, masks, writes and the change feed on a stream."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from policyframe.functions.exact import exact_avg, exact_sum
from policyframe.operators.analytics import Analyst, GroupLimits, sum_
from policyframe.operators.mutations import Writer
from policyframe.operators.scoped import ScopedQuery
from policyframe.plans import expression as x
from policyframe.plans.policy import Forbidden, Policies, Rules
from policyframe.plans.predicate import ALL, Field, Rel
from policyframe.queries import BALANCE_OF_AUTOMOBILE, EUROPE_NOT_BUILDING, NOT_BUILDING, OPEN
from policyframe.sources.tables import catalog
from policyframe.streaming.changes import change_feed, deduplicated

f = Field


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return catalog(spark, sf_dir)


def test_exact_numbers(spark):
    df = spark.sql("SELECT CAST(x AS decimal(18,2)) AS x, k FROM VALUES (0.01, 1), (0.02, 1), (0.02, 1), (-0.01, 2), (-0.02, 2), (NULL, 3) AS t(x, k)")
    found = {r["k"]: r["a"] for r in df.groupBy("k").agg(exact_avg(F.col("x"), "decimal(18,2)").alias("a")).collect()}
    assert found == {1: Decimal("0.02"), 2: Decimal("-0.02"), 3: None}
    big = spark.sql("SELECT * FROM VALUES (9223372036854775807L), (9223372036854775807L) AS t(x)").agg(exact_sum(F.col("x"), "bigint")).first()[0]
    assert big == 2 * (2**63 - 1)


def test_refusals(tables):
    a = Analyst(tables, BALANCE_OF_AUTOMOBILE)
    for bad in (lambda: a.find_many("Customer", where=f("c_acctbal").gt(0)), lambda: a.find_many("Customer", order_by=("c_acctbal",)), lambda: a.aggregate("Customer", [sum_("c_acctbal", "t")]), lambda: Analyst(tables, Policies({})).find_many("Customer")):
        with pytest.raises(Forbidden):
            bad()
    with pytest.raises(ValueError):
        Analyst(tables).find_many("Lineitem", cursor={"l_orderkey": 1})
    with pytest.raises(ValueError):
        ScopedQuery.of(Analyst(tables), "Order", "o").join("full", "o", "customer", "c")
    with pytest.raises(ValueError):
        Analyst(tables).group_by("Order", {"k": "o_custkey"}, [sum_("o_totalprice", "t")], limits=GroupLimits(groups=3))
    cyclic = Policies(OPEN | {"Order": Rules().can("read", Rel("customer").is_(ALL)), "Customer": Rules().can("read", Rel("orders").some())})
    with pytest.raises(ValueError, match="lead back"):
        Analyst(tables, cyclic).find_many("Order")


def test_rule_order():
    a, b, c = f("x").eq(1), f("x").eq(2), f("x").eq(3)
    rules = Rules().can("read", a).cannot("read", b).can("read", c)
    assert repr(rules.rows("read")).count("Not(") == 1
    masked = Rules().can("read", a, ("x",)).can("read", c, ("x",))
    assert repr(masked.field("read", "x")).count("Not(") == 1


def test_missing_anchor_and_empty_page(tables):
    a = Analyst(tables)
    assert a.find_many("Order", cursor={"o_orderkey": -5}, take=3).count() == 0
    assert a.find_many("Order", take=0).count() == 0


def test_one_scan_reads_needed_columns(tables):
    plan = Analyst(tables).find_many("Order", where=f("o_orderstatus").eq("F"), select=("o_orderkey",))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "o_orderstatus,F" in plan
    assert "o_totalprice" not in plan


def test_writes(tables):
    w = Writer(tables, Policies(OPEN | {"Region": Rules().can("read").can("create", f("r_name").starts_with("O")).can("update", f("r_name").ne("ASIA")).can("delete")}))
    spark = tables.spark
    with pytest.raises(Exception, match="denied"):
        w.create_many("Region", spark.sql("SELECT 51 AS r_regionkey, 'BAD' AS r_name")).after.collect()
    with pytest.raises(Exception, match="denied"):
        w.update_many("Region", f("r_regionkey").gte(0), r_name="'Z'").after.collect()
    with pytest.raises(Exception, match="denied"):
        w.upsert_many("Region", spark.sql("SELECT 2 AS r_regionkey, 'x' AS r_name"), r_name="'granted after, not before'").after.collect()
    kept = Writer(tables, Policies(OPEN | {"Region": Rules().can("read").can("delete", f("r_name").ne("ASIA"))}))
    with pytest.raises(Exception, match="denied"):
        kept.delete_many("Region", f("r_regionkey").gte(0)).after.collect()
    with pytest.raises(Exception, match="denied"):
        kept.delete_many("Region", f("r_regionkey").gte(0)).after.select("r_name").collect()
    changed = w.delete_many("Region", f("r_regionkey").eq(1))
    assert changed.after.count() == 4 and [r["action"] for r in changed.facts.collect()] == ["deleted"]


def test_stream(spark, tables, tmp_path):
    rows = "SELECT * FROM VALUES (1, 'created', 1L, timestamp'2024-01-01 00:00:00', 'BUILDING'), (1, 'created', 1L, timestamp'2024-01-01 00:00:00', 'BUILDING'), (2, 'updated', 5L, timestamp'2024-01-01 00:01:00', 'BUILDING'), (3, 'deleted', 7L, timestamp'2024-01-01 00:02:00', 'MACHINERY'), (4, 'deleted', 8L, timestamp'2024-01-01 00:03:00', 'BUILDING') AS t(event_id, action, identity, at, old_segment)"
    batch = spark.sql(rows)
    batch.write.parquet(str(tmp_path / "facts"))
    reader = Analyst(tables, NOT_BUILDING)
    expected = sorted(r["event_id"] for r in change_feed(deduplicated(batch), reader, "Customer", snapshot={"c_mktsegment": "old_segment"}).collect())
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "facts"))
    feed = change_feed(deduplicated(stream), reader, "Customer", snapshot={"c_mktsegment": "old_segment"})
    q = feed.writeStream.format("memory").queryName("feed").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["event_id"] for r in spark.sql("SELECT * FROM feed").collect()) == expected
    assert 3 in expected and 4 not in expected


def test_scoped_rows_alone(tables):
    seen = {r["c_mktsegment"] for r in ScopedQuery.of(Analyst(tables, EUROPE_NOT_BUILDING), "Customer", "c").select(c_mktsegment=x.field("c", "c_mktsegment")).frame().collect()}
    assert "BUILDING" not in seen


def test_whole_orders(tables):
    a = Analyst(tables)
    assert a.order_by_relation("Order", "customer", "c_name", True).count() == a.count("Order").first()["n"]
    assert a.order_by_relation("Customer", "orders", "_count", True).count() == a.count("Customer").first()["n"]
    rich = [r["rich"] for r in a.find_many("Customer", order_by=("rich",), select=("c_custkey", "rich"), ordinal="ordinal").orderBy("ordinal").collect()]
    known = [x for x in rich if x is not None]
    assert known and rich == [None] * (len(rich) - len(known)) + sorted(known)
