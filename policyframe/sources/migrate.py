"""Migrations of stored tables: what changed between two sets of models, how risky each step is, and the tables after it.

Files have no constraints or indexes: keys, references and checks are validated by a query that fails, and nothing is kept of
them but the models. Steps that only a database knows (indexes, namespaces, extensions, its own bookkeeping) are refused.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policyframe.plans.catalog import Model

SAFE, REWRITE, DATA_LOSS, MANUAL = "safe", "rewrite", "data loss", "manual"
#: kind -> risk. Files are written again for all but the first.
RISKS = {
    "create_table": SAFE,
    "rename_table": SAFE,
    "drop_table": DATA_LOSS,
    "add_column": REWRITE,
    "rename_column": REWRITE,
    "alter_column_type": REWRITE,
    "alter_column_nullability": REWRITE,
    "set_column_default": SAFE,
    "drop_column_default": SAFE,
    "drop_column": DATA_LOSS,
    "backfill_column": REWRITE,
    "initialize_concurrency_column": REWRITE,
    "add_primary_key": SAFE,
    "drop_primary_key": SAFE,
    "add_unique": SAFE,
    "drop_unique": SAFE,
    "add_foreign_key": SAFE,
    "drop_foreign_key": SAFE,
    "add_check": SAFE,
    "drop_check": SAFE,
    "validate_constraint": SAFE,
    "rebuild_table": REWRITE,
    "manual_step": MANUAL,
    "record_schema_version": SAFE,
}


@dataclass(frozen=True)
class Change:
    """One step on a table. to: a new name, type or, for keys and references, the columns (and target) that they join."""

    kind: str
    table: str
    column: str | None = None
    to: object = None

    @property
    def risk(self) -> str:
        if self.kind not in RISKS:
            raise ValueError(f"files have no {self.kind}")
        return RISKS[self.kind]


@dataclass
class Plan:
    """renamed: ("table", old) or (table, old column) -> new name. Without it a rename is a drop and an addition."""

    changes: list[Change] = field(default_factory=list)

    def risks(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for c in self.changes:
            out[c.risk] = out.get(c.risk, 0) + 1
        return out


def _stored(m: Model) -> dict[str, str]:
    return {f: kind for f, kind in m.fields.items() if f not in m.derived}


def diff(before: list[Model], after: list[Model], renamed: dict[tuple[str, str], str] | None = None, backfill: dict[tuple[str, str], str] | None = None) -> Plan:
    """The steps from one set of models to another, drops last. backfill: (table, new column) -> SQL over the row."""
    renamed, backfill, out, drops = renamed or {}, backfill or {}, [], []
    old, new = {m.table: m for m in before}, {m.table: m for m in after}
    for table in sorted(set(old)):
        to = renamed.get(("table", table), table)
        if to != table:
            out.append(Change("rename_table", table, to=to))
            old[to] = old.pop(table)
    targets = {m.name: m for m in after}
    for table in sorted(set(old) | set(new)):
        if table not in new:
            drops.append(Change("drop_table", table))
            continue
        m, have = new[table], _stored(old[table]) if table in old else {}
        want = _stored(m)
        if table not in old:
            out.append(Change("create_table", table, to=", ".join(f"`{f}` {k}" for f, k in want.items())))
        for f in sorted(set(have)):
            to = renamed.get((table, f), f)
            if to != f:
                out.append(Change("rename_column", table, f, to))
                have[to] = have.pop(f)
        for f, kind in want.items() if table in old else ():
            if f not in have:
                out.append(Change("add_column", table, f, kind))
                if (table, f) in backfill:
                    out.append(Change("backfill_column", table, f, backfill[table, f]))
            elif have[f] != kind:
                out.append(Change("alter_column_type", table, f, kind))
        drops += [Change("drop_column", table, f) for f in sorted(set(have) - set(want))] if table in old else []
        key = old[table].key if table in old else ()
        if m.key != key:
            out += [Change("drop_primary_key", table)] * bool(key) + [Change("add_primary_key", table, to=m.key)] * bool(m.key)
        links = lambda model: {r.name: (r.pairs, r.target) for r in model.relations.values() if not r.many}
        had, has = links(old[table]) if table in old else {}, links(m)
        out += [Change("drop_foreign_key", table, r) for r in sorted(set(had) - set(has))]
        out += [Change("add_foreign_key", table, r, (has[r][0], targets[has[r][1]].table)) for r in sorted(has) if had.get(r) != has[r]]
    return Plan(out + drops)


def migrated(plan: Plan, load: Callable[[str], DataFrame], accept: tuple[str, ...] = (SAFE, REWRITE)) -> dict[str, DataFrame]:
    """The changed tables after the plan, by their new names; a dropped one is not among them. Steps of a risk that is not accepted
    are refused before anything is read; keys and references fail when the tables are read."""
    if refused := [c for c in plan.changes if c.risk not in accept]:
        raise ValueError(f"not accepted: {[(c.kind, c.table, c.column) for c in refused]}")
    out: dict[str, DataFrame] = {}
    at = lambda t: out[t] if t in out else load(t)
    for c in plan.changes:
        if c.kind == "create_table":
            from pyspark.sql import SparkSession

            out[c.table] = SparkSession.active().createDataFrame([], c.to)
        elif c.kind == "rename_table":
            out[c.to] = at(c.table)
            out.pop(c.table, None)
        elif c.kind == "drop_table":
            out.pop(c.table, None)
        elif c.kind == "rename_column":
            out[c.table] = at(c.table).withColumnRenamed(c.column, c.to)
        elif c.kind == "add_column":
            out[c.table] = at(c.table).withColumn(c.column, F.lit(None).cast(c.to))
        elif c.kind in ("backfill_column", "initialize_concurrency_column"):
            df = at(c.table)
            made = F.expr(c.to) if c.kind == "backfill_column" else F.lit(1)
            out[c.table] = df.withColumn(c.column, F.coalesce(F.col(f"`{c.column}`"), made.cast(df.schema[c.column].dataType)))
        elif c.kind == "alter_column_type":
            out[c.table] = at(c.table).withColumn(c.column, F.col(f"`{c.column}`").cast(c.to))
        elif c.kind == "alter_column_nullability":
            value = F.col(f"`{c.column}`")
            out[c.table] = at(c.table).withColumn(c.column, value if c.to else F.coalesce(value, F.raise_error(F.lit(f"{c.table}.{c.column} holds nulls")).cast(at(c.table).schema[c.column].dataType)))
        elif c.kind == "drop_column":
            out[c.table] = at(c.table).drop(c.column)
        elif c.kind in ("add_primary_key", "add_unique"):
            out[c.table] = _unique(at(c.table), c.table, c.to)
        elif c.kind in ("add_foreign_key", "validate_constraint"):
            pairs, target = c.to
            out[c.table] = _referenced(at(c.table), c.table, pairs, at(target))
        elif c.kind == "add_check":
            df = at(c.table)
            out[c.table] = df.filter(F.assert_true(F.coalesce(F.expr(c.to), F.lit(True)), F.lit(f"{c.table} breaks {c.column}")).isNull())
    return out


def _unique(df: DataFrame, table: str, key: tuple[str, ...]) -> DataFrame:
    """df, which fails if two rows share a key or one lacks it: rows meet the counts of their keys."""
    names = [f"_k{i}" for i in range(len(key))]
    twice = df.groupBy(*[F.col(f"`{k}`").alias(n) for k, n in zip(key, names, strict=True)]).agg(F.count("*").alias("_n"))
    out = df.join(twice, [df[f"`{k}`"].eqNullSafe(twice[n]) for k, n in zip(key, names, strict=True)], "left")
    ok = F.col("_n") == 1
    for k in key:
        ok &= F.col(f"`{k}`").isNotNull()
    return _sure(out, df.columns, ok, f"{table} has no key {key}")


def _referenced(df: DataFrame, table: str, pairs: tuple[tuple[str, str], ...], target: DataFrame) -> DataFrame:
    """df, which fails if a row without a null among its columns meets no row of the target."""
    names = [f"_t{i}" for i in range(len(pairs))]
    keys = target.select(*[F.col(f"`{theirs}`").alias(n) for n, (_, theirs) in zip(names, pairs, strict=True)]).distinct().withColumn("_there", F.lit(True))
    out = df.join(keys, [df[f"`{own}`"] == keys[n] for n, (own, _) in zip(names, pairs, strict=True)], "left")
    ok = F.coalesce("_there", F.lit(False))
    for own, _ in pairs:
        ok |= F.col(f"`{own}`").isNull()
    return _sure(out, df.columns, ok, f"{table} refers to rows that are not there")


def _sure(df: DataFrame, own: list[str], ok, words: str) -> DataFrame:
    """df's columns `own`, the first of which holds the test, as a filter could be moved."""
    first = F.when(ok, F.col(f"`{own[0]}`")).otherwise(F.raise_error(F.lit(words)).cast(df.schema[own[0]].dataType)).alias(own[0])
    return df.filter(F.assert_true(ok, F.lit(words)).isNull()).select(first, *[f"`{c}`" for c in own[1:]])
