"""Predicates: a closed, two-valued algebra of conditions over a model's fields and relations.

No condition is ever unknown: a null field fails every comparison but `ne`, `not_in` and `is_null`, which it passes. An empty
conjunction is true, an empty disjunction false.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

SCALAR = frozenset("eq ne in not_in lt lte gt gte contains starts_with ends_with is_null is_not_null".split())
LIST = frozenset("list_eq has has_every has_some is_empty list_is_null list_is_not_null".split())
JSON = frozenset("json_is_null json_is_not_null json_eq json_ne json_lt json_lte json_gt json_gte string_contains string_starts_with string_ends_with array_contains array_starts_with array_ends_with".split())
RELATION = frozenset("is is_not rel_is_null rel_is_not_null some every none".split())


class Condition:
    def __and__(self, other: Condition) -> Condition:
        return And((self, other))

    def __or__(self, other: Condition) -> Condition:
        return Or((self, other))

    def __invert__(self) -> Condition:
        return Not(self)


@dataclass(frozen=True)
class Const(Condition):
    value: bool


@dataclass(frozen=True)
class And(Condition):
    parts: tuple[Condition, ...]


@dataclass(frozen=True)
class Or(Condition):
    parts: tuple[Condition, ...]


@dataclass(frozen=True)
class Not(Condition):
    part: Condition


@dataclass(frozen=True)
class Leaf(Condition):
    """A test of one field. path: into a JSON field; fold: whether A-Z and a-z are the same (no other letters are)."""

    field: str
    op: str
    value: Any = None
    path: tuple = ()
    fold: bool = False


@dataclass(frozen=True)
class Null:
    """An operand of json_eq and json_ne. db: the column is null, or the path leads nowhere; json: a JSON null is there; any: either."""

    kind: str


DB_NULL, JSON_NULL, ANY_NULL = Null("db"), Null("json"), Null("any")


@dataclass(frozen=True)
class Related(Condition):
    """A test of a relation's targets."""

    relation: str
    op: str
    part: Condition = Const(True)


ALL, NONE = Const(True), Const(False)


def all_of(*parts: Condition) -> Condition:
    return And(tuple(parts))


def any_of(*parts: Condition) -> Condition:
    return Or(tuple(parts))


class Field:
    def __init__(self, name: str, path: tuple = (), fold: bool = False):
        self._name, self._path, self._fold = name, path, fold

    def ci(self) -> Field:
        return Field(self._name, self._path, True)

    def at(self, *path: str | int) -> Field:
        return Field(self._name, path, self._fold)

    def _leaf(self, op: str, value: Any = None) -> Leaf:
        return Leaf(self._name, op, value, self._path, self._fold)

    def __getattr__(self, op: str):
        op = {"in_": "in"}.get(op, op)
        if op not in SCALAR | LIST | JSON:
            raise AttributeError(op)

        def made(*values: Any) -> Leaf:
            if op in ("in", "not_in", "has_every", "has_some"):
                values = tuple(values[0]) if len(values) == 1 and isinstance(values[0], list | tuple | set) else values
                if any(v is None for v in values):
                    raise ValueError(f"{op} takes no nulls")
                return self._leaf(op, values)
            value = values[0] if values else None
            if value is None and op in ("eq", "ne", "lt", "lte", "gt", "gte"):
                raise ValueError(f"{op} takes no null; use is_null")
            return self._leaf(op, tuple(value) if isinstance(value, list) and op not in JSON else value)

        return made


class Rel:
    def __init__(self, name: str):
        self._name = name

    def is_(self, part: Condition) -> Condition:
        return Related(self._name, "is", part)

    def is_not(self, part: Condition) -> Condition:
        return Related(self._name, "is_not", part)

    def is_null(self) -> Condition:
        return Related(self._name, "rel_is_null")

    def is_not_null(self) -> Condition:
        return Related(self._name, "rel_is_not_null")

    def some(self, part: Condition = ALL) -> Condition:
        return Related(self._name, "some", part)

    def every(self, part: Condition) -> Condition:
        return Related(self._name, "every", part)

    def none(self, part: Condition = ALL) -> Condition:
        return Related(self._name, "none", part)


_WORDS = {"equals": "eq", "not": "ne", "in": "in", "notIn": "not_in", "lt": "lt", "lte": "lte", "gt": "gt", "gte": "gte", "contains": "contains", "startsWith": "starts_with", "endsWith": "ends_with", "has": "has", "hasEvery": "has_every", "hasSome": "has_some", "isEmpty": "is_empty"}
_JSON_WORDS = {
    "equals": "json_eq", "not": "json_ne", "lt": "json_lt", "lte": "json_lte",
    "gt": "json_gt", "gte": "json_gte", "string_contains": "string_contains", "string_starts_with": "string_starts_with",
    "string_ends_with": "string_ends_with", "array_contains": "array_contains", "array_starts_with": "array_starts_with", "array_ends_with": "array_ends_with",
}
_STEP = re.compile(r'\.(?:"([^"]*)"|([^.\["]+))|\[(\d+)\]')
_REL_WORDS = {"is": "is", "isNot": "is_not", "some": "some", "every": "every", "none": "none"}


def json_path(path: str | list) -> tuple:
    """Steps of `$.a."b c"[0]`, or of a list of keys in which digits are places in a list."""
    if not isinstance(path, str):
        return tuple(int(p) if isinstance(p, str) and p.isdigit() else p for p in path)
    steps, at = [], 1
    while path[:1] == "$" and at < len(path) and (m := _STEP.match(path, at)):
        steps.append(int(m[3]) if m[3] else m[1] if m[1] is not None else m[2])
        at = m.end()
    if path[:1] != "$" or at < len(path):
        raise ValueError(f"{path} is no JSON path")
    return tuple(steps)


def _from_json(name: str, tests: dict) -> list[Condition]:
    f = Field(name, json_path(tests.pop("path", "$")), tests.pop("mode", "default") == "insensitive")
    out: list[Condition] = []
    for op, operand in tests.items():
        if op not in _JSON_WORDS:
            raise ValueError(f"unknown operator {op}")
        out.append(getattr(f, _JSON_WORDS[op])(JSON_NULL if operand is None and op in ("equals", "not") else operand))
    return out


def from_dict(where: dict, model, catalog) -> Condition:
    """The same algebra as nested dicts: {field: value}, {field: {op: operand, "mode": "insensitive"}}, AND, OR, NOT; of a JSON
    text, {field: {"path": "$.a[0]", op: operand}}, where None is a JSON null."""
    parts: list[Condition] = []
    for name, value in where.items():
        if name in ("AND", "OR", "NOT"):
            inner = [from_dict(w, model, catalog) for w in (value if isinstance(value, list) else [value])]
            parts.append(And(tuple(inner)) if name == "AND" else Or(tuple(inner)) if name == "OR" else Not(Or(tuple(inner))))
        elif name in model.relations:
            target = catalog.model(model.relation(name).target)
            for op, w in value.items():
                if op not in _REL_WORDS:
                    raise ValueError(f"unknown operator {op}")
                if w is None:
                    parts.append(Related(name, "rel_is_null" if op == "is" else "rel_is_not_null"))
                else:
                    parts.append(Related(name, _REL_WORDS[op], from_dict(w, target, catalog)))
        elif name in model.fields:
            tests = dict(value) if isinstance(value, dict) else {"equals": value}
            if "path" in tests or set(tests) & (set(_JSON_WORDS) - set(_WORDS)):
                parts += _from_json(name, tests)
                continue
            f = Field(name, fold=tests.pop("mode", "default") == "insensitive")
            for op, operand in tests.items():
                if op not in _WORDS:
                    raise ValueError(f"unknown operator {op}")
                if operand is None and op in ("equals", "not"):
                    parts.append(f.is_null() if op == "equals" else f.is_not_null())
                elif op == "not" and isinstance(operand, dict):
                    parts.append(Not(from_dict({name: operand}, model, catalog)))
                else:
                    parts.append(getattr(f, _WORDS[op])(operand))
        else:
            raise ValueError(f"{model.name} has no field or relation {name}")
    return And(tuple(parts))


def normalize(c: Condition) -> Condition:
    """Flat, without constants, doubles and double negations."""
    if isinstance(c, And | Or):
        unit, zero = (ALL, NONE) if isinstance(c, And) else (NONE, ALL)
        out: dict[str, Condition] = {}
        for part in map(normalize, c.parts):
            for p in part.parts if type(part) is type(c) else (part,):
                if p == zero:
                    return zero
                if p != unit:
                    out.setdefault(repr(p), p)
        parts = tuple(out[k] for k in sorted(out))
        return unit if not parts else parts[0] if len(parts) == 1 else type(c)(parts)
    if isinstance(c, Not):
        inner = normalize(c.part)
        return Const(not inner.value) if isinstance(inner, Const) else inner.part if isinstance(inner, Not) else Not(inner)
    if isinstance(c, Related):
        return Related(c.relation, c.op, normalize(c.part))
    return c


def leaves_of(c: Condition) -> list[Leaf]:
    """The tests of the model's own fields."""
    if isinstance(c, Leaf):
        return [c]
    return [x for p in (c.parts if isinstance(c, And | Or) else (c.part,) if isinstance(c, Not) else ()) for x in leaves_of(p)]


def fields_of(c: Condition) -> set[str]:
    """The model's own fields that the condition reads."""
    if isinstance(c, Leaf):
        return {c.field}
    if isinstance(c, Not):
        return fields_of(c.part)
    return set().union(*map(fields_of, c.parts)) if isinstance(c, And | Or) else set()


def implies(a: Condition, b: Condition, most: int = 12) -> bool:
    """Whether a proves b, by truth tables over at most `most` different tests; an impossible a proves nothing."""
    a, b = normalize(a), normalize(b)
    atoms: dict[str, int] = {}

    def collect(c: Condition) -> None:
        if isinstance(c, And | Or):
            for p in c.parts:
                collect(p)
        elif isinstance(c, Not):
            collect(c.part)
        elif not isinstance(c, Const):
            atoms.setdefault(repr(c), len(atoms))

    def holds(c: Condition, row: int) -> bool:
        if isinstance(c, And):
            return all(holds(p, row) for p in c.parts)
        if isinstance(c, Or):
            return any(holds(p, row) for p in c.parts)
        if isinstance(c, Not):
            return not holds(c.part, row)
        return c.value if isinstance(c, Const) else bool(row >> atoms[repr(c)] & 1)

    parts = a.parts if isinstance(a, And) else (a,)
    if b == ALL or b in parts:
        return a != NONE
    collect(a)
    collect(b)
    if len(atoms) > most:
        return False
    rows = [r for r in range(1 << len(atoms)) if holds(a, r)]
    return bool(rows) and all(holds(b, r) for r in rows)
