"""The star schema, events, documents and embeddings as models."""

from __future__ import annotations

from pyspark.sql import SparkSession

from policyframe.plans.catalog import Catalog, Model, Relation


def _one(name: str, target: str, own: str, theirs: str) -> dict[str, Relation]:
    return {name: Relation(name, target, ((own, theirs),))}


def _many(name: str, target: str, own: str, theirs: str) -> dict[str, Relation]:
    return {name: Relation(name, target, ((own, theirs),), True)}


MONEY = "decimal(18,2)"
#: A JSON text of every kind of value.
_DOC = (
    """CASE WHEN event_id % 11 = 0 THEN NULL ELSE concat('{"n":', event_id % 50, CASE WHEN event_id % 13 = 0 THEN '' ELSE concat(',"x":', """
    """CASE event_id % 4 WHEN 0 THEN 'null' WHEN 1 THEN concat('"', event_type, '"') WHEN 2 THEN concat(event_id % 10, '.0') ELSE 'true' END) END, """
    """',"tags":[', event_id % 3, ',"', event_type, '",{"a":', event_id % 2, '.0}]}') END"""
)
MODELS = [
    Model("Region", "region", {"r_regionkey": "int", "r_name": "string"}, ("r_regionkey",), _many("nations", "Nation", "r_regionkey", "n_regionkey")),
    Model(
        "Nation",
        "nation",
        {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"},
        ("n_nationkey",),
        _one("region", "Region", "n_regionkey", "r_regionkey") | _many("customers", "Customer", "n_nationkey", "c_nationkey") | _many("suppliers", "Supplier", "n_nationkey", "s_nationkey"),
    ),
    Model(
        "Customer",
        "customer",
        {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": MONEY, "c_mktsegment": "string", "rich": MONEY},
        ("c_custkey",),
        _one("nation", "Nation", "c_nationkey", "n_nationkey") | _many("orders", "Order", "c_custkey", "o_custkey"), {"rich": "CASE WHEN c_acctbal > 5000 THEN c_acctbal END"},
    ),
    Model(
        "Supplier",
        "supplier",
        {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int", "s_acctbal": MONEY},
        ("s_suppkey",),
        _one("nation", "Nation", "s_nationkey", "n_nationkey") | _many("lineitems", "Lineitem", "s_suppkey", "l_suppkey"),
    ),
    Model(
        "Part",
        "part",
        {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int", "p_retailprice": MONEY, "words": "array<string>"},
        ("p_partkey",),
        _many("lineitems", "Lineitem", "p_partkey", "l_partkey"), {"words": "CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 5 = 0 THEN CAST(array() AS array<string>) ELSE split(p_name, ' ') END"},
    ),
    Model(
        "Order",
        "orders",
        {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": MONEY, "o_orderdate": "timestamp", "o_orderpriority": "string"},
        ("o_orderkey",),
        _one("customer", "Customer", "o_custkey", "c_custkey") | _many("lineitems", "Lineitem", "o_orderkey", "l_orderkey"),
    ),
    Model(
        "Lineitem",
        "lineitem",
        {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": MONEY, "l_extendedprice": MONEY, "l_discount": MONEY, "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp"},
        (),
        _one("order", "Order", "l_orderkey", "o_orderkey") | _one("part", "Part", "l_partkey", "p_partkey") | _one("supplier", "Supplier", "l_suppkey", "s_suppkey"),
    ),
    Model(
        "Event",
        "events",
        {"event_id": "bigint", "ts": "timestamp", "user_id": "bigint", "event_type": "string", "value": "double", "props": "string", "doc": "string", "grade": "int"},
        ("event_id",),
        {}, {"doc": _DOC, "grade": "CASE WHEN event_id % 4 > 0 THEN event_id % 4 END"},
    ),
    Model(
        "Document",
        "documents",
        {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"},
        ("doc_id",),
        _one("label", "Label", "doc_id", "doc_id"),
    ),
    Model("Label", "labels", {"doc_id": "bigint", "quality": "int", "toxic": "int"}, ("doc_id",), _one("document", "Document", "doc_id", "doc_id")),
    Model("Vector", "embeddings", {"vec_id": "bigint", "embedding": "array<float>", "label": "int"}, ("vec_id",)),
    Model("Turn", "conversations", {"conv_id": "bigint", "turn": "bigint", "role": "string", "text": "string"}, ("conv_id", "turn")),
]


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    return Catalog(spark, MODELS, lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
