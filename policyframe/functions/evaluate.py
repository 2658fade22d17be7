"""Conditions on plain Python rows, without Spark: what the compiled columns are tested against."""

from __future__ import annotations

import string

from policyframe.plans.predicate import And, Condition, Const, Leaf, Not, Or

_LOW = {ord(a): b for a, b in zip(string.ascii_uppercase, string.ascii_lowercase, strict=True)}


def holds(c: Condition, row: dict) -> bool:
    """Of a row's own fields; relations need a catalog and are not for here."""
    if isinstance(c, Const):
        return c.value
    if isinstance(c, And):
        return all(holds(p, row) for p in c.parts)
    if isinstance(c, Or):
        return any(holds(p, row) for p in c.parts)
    if isinstance(c, Not):
        return not holds(c.part, row)
    if not isinstance(c, Leaf):
        raise TypeError(type(c))
    return _leaf(c, row[c.field])


def _leaf(c: Leaf, x) -> bool:
    v, op = c.value, c.op
    if op in ("is_null", "list_is_null"):
        return x is None
    if op in ("is_not_null", "list_is_not_null"):
        return x is not None
    if x is None:
        return op in ("ne", "not_in")
    if c.fold:
        x = x.translate(_LOW)
        v = tuple(s.translate(_LOW) for s in v) if isinstance(v, tuple) else v.translate(_LOW)
    bytewise = lambda a: a.encode() if isinstance(a, str) else a
    return {
        "eq": lambda: x == v,
        "ne": lambda: x != v,
        "in": lambda: x in v,
        "not_in": lambda: x not in v,
        "lt": lambda: bytewise(x) < bytewise(v),
        "lte": lambda: bytewise(x) <= bytewise(v),
        "gt": lambda: bytewise(x) > bytewise(v),
        "gte": lambda: bytewise(x) >= bytewise(v),
        "contains": lambda: v in x,
        "starts_with": lambda: x.startswith(v),
        "ends_with": lambda: x.endswith(v),
        "list_eq": lambda: None not in x and list(x) == list(v),
        "has": lambda: v in x,
        "has_every": lambda: all(e in x for e in v),
        "has_some": lambda: any(e in x for e in v),
        "is_empty": lambda: (not x) == bool(v),
    }[op]()
