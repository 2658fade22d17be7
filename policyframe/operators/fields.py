"""Fields made of others, caps, and reports of plans."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from policyframe.operators.reads import Args, Reader, columns, ordering
from policyframe.plans.predicate import ALL


@dataclass(frozen=True)
class Computed:
    """A field from others of its row; `needs` are read, under their masks, only when it is asked for."""

    needs: tuple[str, ...]
    value: Column | str


@dataclass(frozen=True)
class Batched:
    """A field from a function of many keys at once: a frame of distinct `needs` to a Series of values."""

    needs: tuple[str, ...]
    value: Callable[[pd.DataFrame], pd.Series]
    kind: str


def with_computed(reader: Reader, name: str, fields: dict[str, Computed | Batched], *, select: tuple[str, ...], **request) -> DataFrame:
    """find_many with fields from `fields` beside the stored ones in `select`; others of `fields` cost nothing."""
    asked = {f: fields[f] for f in select if f in fields}
    stored = [f for f in select if f not in fields]
    needs = list(dict.fromkeys([*stored, *[n for c in asked.values() for n in c.needs]]))
    df = reader.find_many(name, select=tuple(needs), **request)
    df = df.withColumns({f: F.expr(c.value) if isinstance(c.value, str) else c.value for f, c in asked.items() if isinstance(c, Computed)})
    for f, c in asked.items():
        if isinstance(c, Batched):
            df = _batched(df, f, c)
    return df.select(*[f"`{f}`" for f in select])


def _batched(df: DataFrame, name: str, c: Batched) -> DataFrame:
    """Each distinct key is computed once, whatever rows share it."""
    keys = df.select(*[f"`{n}`" for n in c.needs]).distinct()
    ddl = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in keys.schema)
    value = c.value

    def step(frames):
        for pdf in frames:
            yield pdf.assign(**{name: value(pdf)})

    found = keys.mapInPandas(step, f"{ddl}, `{name}` {c.kind}").select(*[F.col(f"`{n}`").alias(f"_b{i}") for i, n in enumerate(c.needs)], f"`{name}`")
    on = [df[f"`{n}`"].eqNullSafe(found[f"_b{i}"]) for i, n in enumerate(c.needs)]
    return df.join(found, on, "left").drop(*[f"_b{i}" for i in range(len(c.needs))])


def capped(df: DataFrame, most: int) -> DataFrame:
    """df, or a failure when it runs if it has more than `most` rows; rows are never cut off. Only for results whose cap is
    small enough for one task."""
    df = df.limit(most + 1)
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    return df.withColumn("_n", n).filter(F.assert_true(F.col("_n") <= most, F.lit(f"more than {most} rows")).isNull()).drop("_n")


def plan_report(df: DataFrame) -> list[tuple[int, str]]:
    """The physical plan as (depth, operator), from the root. It holds no literals, columns or paths: these could tell what a
    caller may not see."""
    out, stack = [], [(0, df._jdf.queryExecution().executedPlan())]
    while stack:
        depth, node = stack.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.initialPlan()
        out.append((depth, node.nodeName().split(" ")[0] if node.nodeName().startswith("Scan") else node.nodeName()))
        children = node.children()
        stack += [(depth + 1, children.apply(i)) for i in reversed(range(children.size()))]
    return out


def with_alias(reader: Reader, name: str, loads: dict[str, tuple[str, Args]], *, select: tuple[str, ...], where=ALL, order_by: tuple = (), take: int | None = None) -> DataFrame:
    """One relation several times in a read: loads has alias -> (relation, Args); each is kept apart. The parents are read once."""
    model = reader.catalog.model(name)
    own = [o for relation, _ in loads.values() for o, _ in model.relation(relation).pairs]
    out = reader.find_many(name, where=where, order_by=order_by, take=take, select=tuple(dict.fromkeys([*select, *own, *[x[0] for x in ordering(order_by, model.key)]])))
    for alias, (relation, args) in loads.items():
        out = reader._loaded(out, model, relation, args, abs(take) if take is not None else None, alias)
    if order_by:
        out = out.orderBy(*columns(ordering(order_by, model.key)))
    return out.select(*[f"`{f}`" for f in [*select, *loads]])
