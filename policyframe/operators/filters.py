"""Conditions as DataFrame operations: tests become columns that are never null, relations semi and anti joins."""

from __future__ import annotations

import json
import string
from decimal import Decimal
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policyframe.plans.catalog import Catalog, Model
from policyframe.plans.predicate import And, Condition, Const, Leaf, Not, Null, Or, Related, normalize


_LOW = {ord(a): b for a, b in zip(string.ascii_uppercase, string.ascii_lowercase, strict=True)}


def _fold(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def test(leaf: Leaf, plain: bool = False) -> Column:
    """plain: null may stand for false, as it does in a filter; scans take such tests over, and others not."""
    c, op, v = F.col(f"`{leaf.field}`"), leaf.op, leaf.value
    if leaf.path or op.startswith(("json_", "string_", "array_")):
        return _json(leaf)
    if leaf.fold:
        c = _fold(c)
        v = tuple(x.translate(_LOW) for x in v) if isinstance(v, tuple) else v.translate(_LOW) if isinstance(v, str) else v
    simple = {"eq": lambda: c == v, "lt": lambda: c < v, "lte": lambda: c <= v, "gt": lambda: c > v, "gte": lambda: c >= v, "contains": lambda: F.contains(c, F.lit(v)), "starts_with": lambda: F.startswith(c, F.lit(v)), "ends_with": lambda: F.endswith(c, F.lit(v))}
    if op in simple:
        return simple[op]() if plain else _sure(simple[op]())
    if op == "ne":
        return ~_sure(c == v)
    if op in ("in", "not_in"):
        found = (c.isin(*v) if plain and op == "in" else _sure(c.isin(*v))) if v else F.lit(False)
        return found if op == "in" else ~found
    if op in ("is_null", "list_is_null", "json_is_null"):
        return c.isNull()
    if op in ("is_not_null", "list_is_not_null", "json_is_not_null"):
        return c.isNotNull()
    if op == "list_eq":
        # A null element is equal to nothing.
        whole = F.forall(c, lambda x: x.isNotNull())
        return _sure(whole & (c == F.array(*map(F.lit, v)))) if v else _sure(F.size(c) == 0) & c.isNotNull()
    if op == "has":
        return _sure(F.array_contains(c, F.lit(v)))
    if op == "has_every":
        out = c.isNotNull()
        for x in v:
            out &= _sure(F.array_contains(c, F.lit(x)))
        return out
    if op == "has_some":
        out = F.lit(False)
        for x in v:
            out |= _sure(F.array_contains(c, F.lit(x)))
        return out
    if op == "is_empty":
        return _sure(c.isNotNull() & ((F.size(c) == 0) == F.lit(bool(v))))
    raise ValueError(f"unknown operator {op}")


def _canonical(x: Any) -> Any:
    """JSON values that are equal as numbers, texts, lists and objects are equal as Python values; booleans are no numbers."""
    if isinstance(x, bool):
        return ("b", x)
    if isinstance(x, list | tuple):
        return [_canonical(e) for e in x]
    if isinstance(x, dict):
        return {k: _canonical(e) for k, e in x.items()}
    return Decimal(str(x)) if isinstance(x, int | float) else x


def json_contains(x: Any, y: Any) -> bool:
    """Whether canonical x holds y: an object by its keys, a list by its elements in any order, a scalar if equal."""
    if isinstance(y, dict):
        return isinstance(x, dict) and all(k in x and json_contains(x[k], v) for k, v in y.items())
    if isinstance(y, list):
        return isinstance(x, list) and all(any(json_contains(e, v) for e in x) for v in y)
    return type(x) is type(y) and x == y


def _nested(text: Column, op: str, wanted: Any) -> Column:
    """Tests of JSON texts by a list or object, whose numbers may be written in several ways; in Arrow batches."""
    wanted = _canonical(wanted)

    @F.pandas_udf("boolean")
    def tested(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> bool:
            if t is None:
                return False
            x = _canonical(json.loads(t, parse_float=Decimal, parse_int=Decimal))
            if op in ("eq", "ne"):
                return type(x) is type(wanted) and (x == wanted) == (op == "eq")
            if op == "array_contains":
                return isinstance(x, list) and json_contains(x, wanted)
            return isinstance(x, list) and len(x) > 0 and x[0 if op == "array_starts_with" else -1] == wanted

        return texts.map(one)

    return tested(text)


def _json(leaf: Leaf) -> Column:
    """Tests of a value in a JSON text. A missing path, and a value of another kind than the operand, fail every one; null
    operands are told by `Null`."""
    c, op, v = F.try_parse_json(F.col(f"`{leaf.field}`")), leaf.op, leaf.value
    path = "$" + "".join(f"[{p}]" if isinstance(p, int) else f"['{p}']" for p in leaf.path)
    at = F.try_variant_get(c, path, "variant")
    kind = F.schema_of_variant(at)
    op = {"json_eq": "eq", "json_ne": "ne", "json_lt": "lt", "json_lte": "lte", "json_gt": "gt", "json_gte": "gte"}.get(op, op)
    if op in ("json_is_null", "is_null"):
        return F.col(f"`{leaf.field}`").isNull()
    if op in ("json_is_not_null", "is_not_null"):
        return F.col(f"`{leaf.field}`").isNotNull()
    if isinstance(v, Null):
        null = _sure(F.is_variant_null(at))
        if op == "eq":
            return {"db": at.isNull(), "json": null, "any": at.isNull() | null}[v.kind]
        if op == "ne":
            return at.isNotNull() if v.kind == "db" else at.isNotNull() & ~null
        raise ValueError(f"{op} takes no null")

    def scalar(x: Column, op: str, v: Any) -> Column:
        """Of a variant x of v's kind."""
        kind = F.schema_of_variant(x)
        if isinstance(v, bool):
            x, right = F.try_variant_get(x, "$", "boolean"), kind == "BOOLEAN"
        elif isinstance(v, int | float | Decimal):
            right = kind.isin("BIGINT", "DOUBLE", "TINYINT", "SMALLINT", "INT", "FLOAT") | kind.startswith("DECIMAL")
            x, v = F.try_variant_get(x, "$", "decimal(38,12)"), Decimal(str(v))
        else:
            x, right = F.try_variant_get(x, "$", "string"), kind == "STRING"
            if leaf.fold:
                x, v = _fold(x), v.translate(_LOW)
        if op.startswith("string_"):
            f = {"contains": F.contains, "starts_with": F.startswith, "ends_with": F.endswith}[op.removeprefix("string_")]
            return _sure(right & f(x, F.lit(v)))
        tests = {"eq": x == F.lit(v), "ne": x != F.lit(v), "lt": x < F.lit(v), "lte": x <= F.lit(v), "gt": x > F.lit(v), "gte": x >= F.lit(v)}
        return _sure(right & tests[op])

    if op.startswith("string_") and not isinstance(v, str):
        raise ValueError(f"{op} takes a text")
    if isinstance(v, list | tuple | dict):
        if op not in ("eq", "ne", "array_contains", "array_starts_with", "array_ends_with"):
            raise ValueError(f"{op} takes a number or text")
        fine = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        return _sure(_nested(F.when(fine, F.to_json(at)), op, v))
    if op.startswith("array_"):
        items = F.try_variant_get(c, path, "array<variant>")
        if op == "array_contains":
            return _sure(F.exists(items, lambda x: scalar(x, "eq", v)))
        return _sure(F.size(items) > 0) & scalar(F.get(items, F.lit(0) if op == "array_starts_with" else F.size(items) - 1), "eq", v)
    return scalar(at, op, v)


def _has_relations(c: Condition) -> bool:
    return isinstance(c, Related) or any(map(_has_relations, c.parts if isinstance(c, And | Or) else (c.part,) if isinstance(c, Not) else ()))


def _targets(catalog: Catalog, model: Model, c: Related) -> tuple[DataFrame, list[tuple[str, str]], bool]:
    """Keys of the rows' wanted targets, the columns to join, and whether a row must have one (else none)."""
    relation = model.relation(c.relation)
    target = catalog.model(relation.target)
    part, wanted = c.part, c.op in ("is", "some", "rel_is_not_null")
    if c.op == "every":
        part = normalize(Not(part))
    rows = where(catalog.rows(target.name, part), part, target, catalog)
    keys = rows.select(*[F.col(f"`{theirs}`").alias(f"_k{i}") for i, (_, theirs) in enumerate(relation.pairs)])
    return keys, [(own, f"_k{i}") for i, (own, _) in enumerate(relation.pairs)], wanted


def where(df: DataFrame, condition: Condition, model: Model, catalog: Catalog) -> DataFrame:
    """df's rows for which the condition holds. Relations in a conjunction are semi and anti joins; elsewhere, flags."""
    c = normalize(condition)
    parts = c.parts if isinstance(c, And) else (c,)
    for p in sorted(parts, key=_has_relations):
        if not _has_relations(p):
            df = df.filter(_column(p, plain=True))
        elif isinstance(p, Related) or isinstance(p, Not) and isinstance(p.part, Related):
            related = p if isinstance(p, Related) else p.part
            keys, on, wanted = _targets(catalog, model, related)
            wanted = wanted == isinstance(p, Related)
            df = df.join(keys, [df[f"`{own}`"] == keys[k] for own, k in on], "left_semi" if wanted else "left_anti")
        else:
            own = df.columns
            df, flag = flagged(df, p, model, catalog, "_w")
            df = df.filter(flag).select(*[f"`{x}`" for x in own])
    return df


def flagged(df: DataFrame, condition: Condition, model: Model, catalog: Catalog, name: str) -> tuple[DataFrame, Column]:
    """df with a flag for each relation in the condition, and the condition as a column that is never null."""
    flags: dict[str, Column] = {}

    def add(c: Condition) -> None:
        nonlocal df
        if isinstance(c, Related) and repr(c) not in flags:
            keys, on, wanted = _targets(catalog, model, c)
            flag = f"{name}{len(flags)}"
            named = [(own, f"{flag}{k}") for own, k in on]
            keys = keys.toDF(*[k for _, k in named]).distinct().withColumn(flag, F.lit(True))
            df = df.join(keys, [df[f"`{own}`"] == keys[k] for own, k in named], "left").drop(*[k for _, k in named])
            flags[repr(c)] = _sure(F.col(flag)) if wanted else ~_sure(F.col(flag))
        for p in c.parts if isinstance(c, And | Or) else (c.part,) if isinstance(c, Not) else ():
            add(p)

    c = normalize(condition)
    add(c)
    return df, _column(c, flags)


def _column(c: Condition, flags: dict[str, Column] | None = None, plain: bool = False) -> Column:
    if isinstance(c, Const):
        return F.lit(c.value)
    if isinstance(c, Leaf):
        return test(c, plain)
    if isinstance(c, Not):
        return ~_column(c.part, flags)
    if isinstance(c, Related):
        return flags[repr(c)]
    parts = [_column(p, flags, plain) for p in c.parts] or [F.lit(isinstance(c, And))]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if isinstance(c, And) else out | p
    return out
