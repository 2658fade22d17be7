"""Catalogs over stored tables: files, databases by JDBC, and versions that units of work committed; drift of their schemas."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from policyframe.plans.catalog import Catalog, Model


def folder(spark: SparkSession) -> str:
    """The folder for checkpoints, which the driver and all executors share: the one that spark.checkpoint.dir names. Only a local
    session without it gets one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="policyframe-checkpoint-")
        atexit.register(shutil.rmtree, path.removeprefix("file://"), True)
    sc.setCheckpointDir(path)
    return path


def files(spark: SparkSession, models: list[Model], folder: str, kind: str = "parquet", **options) -> Catalog:
    """folder/<table>.<kind>, in any format that Spark reads. Formats without types need the declared ones; they are given."""

    def load(table: str) -> DataFrame:
        reader = spark.read.format(kind).options(**options)
        if kind in ("csv", "json"):
            m = next(m for m in models if m.table == table)
            reader = reader.schema(", ".join(f"`{f}` {t}" for f, t in m.fields.items() if f not in m.derived))
        return reader.load(f"{folder}/{table}.{kind}")

    return Catalog(spark, models, load)


@dataclass(frozen=True)
class Split:
    """How a table is read in parts: a number column, and the bounds between which parts are cut (all rows are read)."""

    column: str
    low: int
    high: int
    parts: int


def database(spark: SparkSession, models: list[Model], url: str, *, namespace: str | None = None, splits: dict[str, Split] | None = None, **options) -> Catalog:
    """Tables of a database by JDBC. Filters and columns are pushed down to it; a table without a split is read by one task."""

    def load(table: str) -> DataFrame:
        own = {"dbtable": f"{namespace}.{table}" if namespace else table, "fetchsize": "10000"}
        if s := (splits or {}).get(table):
            own |= {"partitionColumn": s.column, "lowerBound": str(s.low), "upperBound": str(s.high), "numPartitions": str(s.parts)}
        return spark.read.format("jdbc").option("url", url).options(**own | options).load()

    return Catalog(spark, models, load)


def version(spark: SparkSession, under: Catalog, folder: str, name: str) -> Catalog:
    """The tables as a committed version left them; those that it did not write are the ones under it."""
    from policyframe.operators.units import committed

    if not committed(spark, folder, name):
        raise ValueError(f"{folder}/{name} is not committed")
    jvm = spark.sparkContext._jvm

    def load(table: str) -> DataFrame:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/{table}.parquet")
        there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return spark.read.parquet(str(path)) if there else under._load(table)

    return Catalog(spark, list(under.models.values()), load)


def drift(catalog: Catalog) -> DataFrame:
    """(model, field, declared, actual, state) of every declared field, and of stored ones that no model declares. state: same,
    cast (another type, which reads turn into the declared one), derived, missing or extra."""
    rows = []
    for m in catalog.models.values():
        actual = {x.name: x.dataType.simpleString() for x in catalog._load(m.table).schema}
        for f, kind in m.fields.items():
            if f in m.derived:
                rows.append((m.name, f, kind, None, "derived"))
            else:
                state = "missing" if f not in actual else "same" if actual[f] == kind else "cast"
                rows.append((m.name, f, kind, actual.get(f), state))
        rows += [(m.name, f, None, kind, "extra") for f, kind in actual.items() if f not in m.fields]
    return catalog.spark.createDataFrame(rows, "model string, field string, declared string, actual string, state string")
