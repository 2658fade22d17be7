"""Typed expressions over the occurrences of a query: the only thing that scoped queries and having take.

An expression names fields of occurrences, or columns of a result, and closed lists of functions and aggregates. It holds no
SQL text, no DataFrame and no function of the caller, so it can read nothing but what the query has joined. Comparisons are plain
three-valued SQL.
"""

from __future__ import annotations

import datetime
import string
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

CASTS = ("boolean", "int", "bigint", "double", "string", "date", "timestamp", "decimal")


class Refused(ValueError):
    """A query that is not made of what it may be made of."""


@dataclass(frozen=True, eq=False)
class Expr:
    """op: field, lit, call, agg, over, rank; value: (occurrence or None, name), a literal, or a name; parts: operands."""

    op: str
    value: Any = None
    parts: tuple[Expr, ...] = ()

    def _binary(self, name: str, other: Any, swapped: bool = False) -> Expr:
        a, b = (wrap(other), self) if swapped else (self, wrap(other))
        return Expr("call", name, (a, b))

    def __add__(self, x: Any) -> Expr:
        return self._binary("+", x)

    def __radd__(self, x: Any) -> Expr:
        return self._binary("+", x, True)

    def __sub__(self, x: Any) -> Expr:
        return self._binary("-", x)

    def __rsub__(self, x: Any) -> Expr:
        return self._binary("-", x, True)

    def __mul__(self, x: Any) -> Expr:
        return self._binary("*", x)

    def __rmul__(self, x: Any) -> Expr:
        return self._binary("*", x, True)

    def __truediv__(self, x: Any) -> Expr:
        return self._binary("/", x)

    def __rtruediv__(self, x: Any) -> Expr:
        return self._binary("/", x, True)

    def __mod__(self, x: Any) -> Expr:
        return self._binary("%", x)

    def eq(self, x: Any) -> Expr:
        return self._binary("=", x)

    def ne(self, x: Any) -> Expr:
        return self._binary("<>", x)

    def lt(self, x: Any) -> Expr:
        return self._binary("<", x)

    def lte(self, x: Any) -> Expr:
        return self._binary("<=", x)

    def gt(self, x: Any) -> Expr:
        return self._binary(">", x)

    def gte(self, x: Any) -> Expr:
        return self._binary(">=", x)

    def between(self, low: Any, high: Any) -> Expr:
        return self.gte(low) & self.lte(high)

    def in_(self, *values: Any) -> Expr:
        return Expr("call", "in", (self, *map(wrap, values)))

    def not_in(self, *values: Any) -> Expr:
        return ~self.in_(*values)

    def is_null(self) -> Expr:
        return Expr("call", "is null", (self,))

    def is_not_null(self) -> Expr:
        return Expr("call", "is not null", (self,))

    def contains(self, x: str, fold: bool = False) -> Expr:
        return Expr("call", "contains", (_folded(self, fold), _folded(wrap(x), fold)))

    def starts_with(self, x: str, fold: bool = False) -> Expr:
        return Expr("call", "starts_with", (_folded(self, fold), _folded(wrap(x), fold)))

    def ends_with(self, x: str, fold: bool = False) -> Expr:
        return Expr("call", "ends_with", (_folded(self, fold), _folded(wrap(x), fold)))

    def __and__(self, x: Expr) -> Expr:
        return self._binary("and", x)

    def __or__(self, x: Expr) -> Expr:
        return self._binary("or", x)

    def __invert__(self) -> Expr:
        return Expr("call", "not", (self,))

    def cast(self, kind: str) -> Expr:
        if kind.split("(")[0] not in CASTS or not set(kind) <= set(string.ascii_lowercase + string.digits + "(),"):
            raise Refused(f"cast to {kind}")
        return Expr("call", f"cast {kind}", (self,))

    def over(self, partition_by: tuple = (), order_by: tuple = ()) -> Expr:
        """An aggregate or rank of the rows that agree in partition_by; with an order, of those up to the row's own place.
        order_by: expressions, or (expression, "asc" or "desc")."""
        if self.op not in ("agg", "rank"):
            raise Refused("only aggregates and ranks go over a window")
        if not partition_by:
            raise Refused("a window needs a partition: all rows would meet in one task")
        if self.op == "rank" and not order_by:
            raise Refused("a rank needs an order")
        down = tuple(isinstance(o, tuple) and o[1] == "desc" for o in order_by)
        order = tuple(checked(o[0] if isinstance(o, tuple) else o) for o in order_by)
        return Expr("over", (len(partition_by), down), (self, *map(checked, partition_by), *order))

    def __bool__(self) -> bool:
        raise Refused("expressions have no truth here; use & | ~ and eq, ne, lt, ..")


def wrap(x: Any) -> Expr:
    if isinstance(x, Expr):
        return x
    if x is None or isinstance(x, bool | int | float | str | Decimal | datetime.date):
        return Expr("lit", x)
    raise Refused(f"{type(x).__name__} is no value")


def checked(x: Any) -> Expr:
    """x, if it is an expression; texts, columns and functions are refused."""
    if not isinstance(x, Expr):
        raise Refused(f"an expression is needed, not {type(x).__name__}")
    return x


def field(occurrence: str, name: str) -> Expr:
    return Expr("field", (occurrence, name))


def out(name: str) -> Expr:
    """A column of the result so far."""
    return Expr("field", (None, name))


def lit(x: Any) -> Expr:
    return wrap(x)


def _folded(x: Expr, fold: bool) -> Expr:
    return Expr("call", "ascii_lower", (x,)) if fold else x


def call(name: str, *parts: Any) -> Expr:
    if name not in FUNCTIONS:
        raise Refused(f"no function {name}")
    low, high, _ = FUNCTIONS[name]
    if not low <= len(parts) <= high:
        raise Refused(f"{name} takes {low} to {high} operands")
    return Expr("call", name, tuple(map(wrap, parts)))


def case(*branches: tuple[Expr, Any], otherwise: Any = None) -> Expr:
    if not branches:
        raise Refused("a case needs a branch")
    return Expr("call", "case", tuple(wrap(x) for pair in branches for x in pair) + (wrap(otherwise),))


def count(x: Expr | None = None) -> Expr:
    return Expr("agg", "count", () if x is None else (checked(x),))


def count_distinct(x: Expr) -> Expr:
    return Expr("agg", "count_distinct", (checked(x),))


def sum_(x: Expr) -> Expr:
    return Expr("agg", "sum", (checked(x),))


def avg(x: Expr) -> Expr:
    return Expr("agg", "avg", (checked(x),))


def min_(x: Expr) -> Expr:
    return Expr("agg", "min", (checked(x),))


def max_(x: Expr) -> Expr:
    return Expr("agg", "max", (checked(x),))


def row_number() -> Expr:
    return Expr("rank", "row_number")


def rank() -> Expr:
    return Expr("rank", "rank")


def lag(x: Expr) -> Expr:
    return Expr("rank", "lag", (checked(x),))


_MANY = 64
#: name -> (least and most operands, how it is made). `least` and `greatest` leave nulls out; the strict ones are null with one.
FUNCTIONS: dict[str, tuple[int, int, Callable[..., Column]]] = {
    "lower": (1, 1, F.lower),
    "upper": (1, 1, F.upper),
    "length": (1, 1, F.char_length),
    "trim": (1, 1, F.trim),
    "concat": (1, _MANY, F.concat),
    "substring": (3, 3, lambda x, a, n: F.substring(x, a, n)),
    "ascii_lower": (1, 1, lambda x: F.translate(x, string.ascii_uppercase, string.ascii_lowercase)),
    "abs": (1, 1, F.abs),
    "sqrt": (1, 1, F.sqrt),
    "ceil": (1, 1, F.ceil),
    "floor": (1, 1, F.floor),
    "round": (2, 2, lambda x, n: F.round(x, n)),
    "power": (2, 2, F.pow),
    "ln": (1, 1, F.ln),
    "exp": (1, 1, F.exp),
    "least": (2, _MANY, F.least),
    "greatest": (2, _MANY, F.greatest),
    "least_strict": (2, _MANY, lambda *x: F.when(_none_null(x), F.least(*x))),
    "greatest_strict": (2, _MANY, lambda *x: F.when(_none_null(x), F.greatest(*x))),
    "coalesce": (1, _MANY, F.coalesce),
    "nullif": (2, 2, F.nullif),
    "year": (1, 1, lambda x: F.year(x).cast("bigint")),
    "month": (1, 1, lambda x: F.month(x).cast("bigint")),
    "day": (1, 1, lambda x: F.dayofmonth(x).cast("bigint")),
}
_OPERATORS: dict[str, Callable[..., Column]] = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": lambda a, b: a / F.nullif(b, F.lit(0)),
    "%": lambda a, b: a % F.nullif(b, F.lit(0)),
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "and": lambda a, b: a & b,
    "or": lambda a, b: a | b,
    "not": lambda a: ~a,
    "is null": lambda a: a.isNull(),
    "is not null": lambda a: a.isNotNull(),
    "contains": F.contains,
    "starts_with": F.startswith,
    "ends_with": F.endswith,
    "in": lambda a, *values: a.isin(*values) if values else F.lit(False),
}
_AGGREGATES: dict[str, Callable[..., Column]] = {"count": lambda *x: F.count(*x or ("*",)), "count_distinct": F.count_distinct, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
_RANKS: dict[str, Callable[..., Column]] = {"row_number": F.row_number, "rank": F.rank, "lag": F.lag}


def _none_null(x: tuple[Column, ...]) -> Column:
    ok = x[0].isNotNull()
    for c in x[1:]:
        ok &= c.isNotNull()
    return ok


def build(e: Expr, resolve: Callable[[str | None, str], Column]) -> Column:
    """resolve: (occurrence, name) -> column, or a refusal."""
    if e.op == "field":
        return resolve(*e.value)
    if e.op == "lit":
        return F.lit(e.value)
    parts = [build(p, resolve) for p in e.parts]
    if e.op == "agg":
        return _AGGREGATES[e.value](*parts)
    if e.op == "rank":
        return _RANKS[e.value](*parts)
    if e.op == "over":
        n, down = e.value
        w = Window.partitionBy(*parts[1 : n + 1])
        order = [p.desc_nulls_last() if d else p.asc_nulls_first() for p, d in zip(parts[n + 1 :], down, strict=True)]
        return parts[0].over(w.orderBy(*order) if order else w)
    if e.value == "case":
        *pairs, otherwise = parts
        made = F.when(pairs[0], pairs[1])
        for a, b in zip(pairs[2::2], pairs[3::2], strict=True):
            made = made.when(a, b)
        return made.otherwise(otherwise)
    if e.value.startswith("cast "):
        return parts[0].cast(e.value.removeprefix("cast "))
    return _OPERATORS[e.value](*parts) if e.value in _OPERATORS else FUNCTIONS[e.value][2](*parts)


def walk(e: Expr) -> Iterator[Expr]:
    yield e
    for p in e.parts:
        yield from walk(p)


def fields(e: Expr) -> set[tuple[str | None, str]]:
    return {x.value for x in walk(e) if x.op == "field"}


def has(e: Expr, *ops: str) -> bool:
    return any(x.op in ops for x in walk(e))


def aggregated(e: Expr) -> bool:
    """Whether it holds an aggregate of the group, as against one over a window."""
    if e.op == "agg":
        return True
    return any(map(aggregated, e.parts[1:] if e.op == "over" else e.parts))


def grouped_only(e: Expr, keys: tuple[Expr, ...]) -> bool:
    """Whether every field in it is inside an aggregate or a part of a key."""
    if e.op in ("agg", "lit") or any(same(e, k) for k in keys):
        return True
    return e.op != "field" and all(grouped_only(p, keys) for p in e.parts)


def same(a: Expr, b: Expr) -> bool:
    return a.op == b.op and a.value == b.value and len(a.parts) == len(b.parts) and all(map(same, a.parts, b.parts))


def text(e: Expr) -> str:
    """A canonical form without literals, for records."""
    if e.op == "field":
        return ".".join(filter(None, e.value))
    if e.op == "lit":
        return "?"
    return f"{e.value if e.op != 'over' else 'over'}({', '.join(map(text, e.parts))})"
