"""Models: tables with typed fields, a key, relations along equality of columns, and the rows they are read from."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from policyframe.plans.predicate import ALL, And, Condition, Leaf, Or, normalize


@dataclass(frozen=True)
class Relation:
    """target: a model; pairs: (own column, target's column); many: whether a row has several targets."""

    name: str
    target: str
    pairs: tuple[tuple[str, str], ...]
    many: bool = False


@dataclass(frozen=True)
class Model:
    """fields: name -> SQL type; a field of another stored type is cast when the table is read. key: columns that tell rows
    apart, or none: such a model has no unique reads and no cursors."""

    name: str
    table: str
    fields: dict[str, str]
    key: tuple[str, ...] = ()
    relations: dict[str, Relation] = field(default_factory=dict)
    derived: dict[str, str] = field(default_factory=dict)
    #: Fields whose values are told apart but have no order, such as uuids and the words of an enumeration.
    unordered: frozenset[str] = frozenset()

    def relation(self, name: str) -> Relation:
        if name not in self.relations:
            raise ValueError(f"{self.name} has no relation {name}")
        return self.relations[name]


class Catalog:
    def __init__(self, spark: SparkSession, models: list[Model], load: Callable[[str], DataFrame]):
        self.spark, self.models, self._load = spark, {m.name: m for m in models}, load
        for m in models:
            for r in m.relations.values():
                if r.target not in self.models:
                    raise ValueError(f"{m.name}.{r.name}: no model {r.target}")

    def model(self, name: str) -> Model:
        return self.models[name]

    def rows(self, name: str, given: Condition = ALL) -> DataFrame:
        """The model's table with the declared fields alone, so that scans read no other columns. `given` is a condition that the
        caller puts to the rows afterwards: where it bounds a field that is stored in another type, the bounds are put to the
        stored column too, a little wider, so that scans can skip by them. They leave out no row for which `given` holds."""
        m = self.model(name)
        df = self._load(m.table)
        stored = {x.name: x.dataType.simpleString() for x in df.schema}
        missing = [f for f in m.fields if f not in m.derived and f not in stored]
        if missing:
            raise ValueError(f"{m.table} lacks {missing}")
        if (bounds := _bounds(normalize(given), m, stored)) is not None:
            df = df.filter(bounds)
        return df.selectExpr(*[f"CAST({m.derived.get(f, f'`{f}`')} AS {kind}) AS `{f}`" for f, kind in m.fields.items()])


def _near(value: Any, scale: int, up: bool) -> float:
    """A double beyond which, by more than any rounding, no stored double is cast to `value`."""
    x = float(value)
    step = 10.0**-scale + 4 * math.ulp(x)
    return x + step if up else x - step


def _bounds(c: Condition, m: Model, stored: dict[str, str]) -> Column | None:
    """What `c` implies for fields that are declared as decimals and stored as doubles; None if nothing."""
    if isinstance(c, And | Or):
        found = [_bounds(p, m, stored) for p in c.parts]
        if isinstance(c, Or) and any(x is None for x in found):
            return None
        found = [x for x in found if x is not None]
        return reduce(lambda a, b: a & b if isinstance(c, And) else a | b, found) if found else None
    if not isinstance(c, Leaf) or c.path or c.fold or c.field in m.derived or c.field not in m.fields:
        return None
    kind, own = m.fields[c.field], stored[c.field]
    if not kind.startswith("decimal") or own not in ("double", "float"):
        return None
    scale, x = int(kind.rstrip(")").split(",")[1]), F.col(f"`{c.field}`")
    values = c.value if c.op == "in" else (c.value,)
    if c.op not in ("eq", "in", "lt", "lte", "gt", "gte") or not values or any(isinstance(v, bool) or not isinstance(v, int | float | Decimal) for v in values):
        return None
    low, high = x >= F.lit(_near(min(values), scale, False)), x <= F.lit(_near(max(values), scale, True))
    return {"eq": low & high, "in": low & high, "gt": low, "gte": low, "lt": high, "lte": high}[c.op]
