"""A GraphQL front end: documents become reads, counts, aggregates and groups of an Analyst, one DataFrame a root field.

Of a model `Order` the roots are `order(where)`, one row by its key; `orders(where, orderBy, cursor, distinct, skip, take)`;
`ordersCount(where)`; `ordersAggregate(where)`; and `ordersGroupBy(by, where, having, orderBy, skip, take)`, where `by` may hold
paths like "customer.nation.n_name". Policies, masks and limits are the Analyst's. Writes go through units of work, not here.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policyframe.operators.analytics import Analyst, Measure
from policyframe.operators.reads import Args
from policyframe.plans.catalog import Catalog, Model
from policyframe.plans.expression import Expr, out
from policyframe.plans.graphql import GraphQLError, Selected, parse
from policyframe.plans.predicate import ALL, Condition, from_dict

TAKE = 100
_SCALARS = {"int": "Int", "smallint": "Int", "bigint": "BigInt", "double": "Float", "float": "Float", "string": "String", "boolean": "Boolean", "timestamp": "DateTime", "date": "Date"}
_TESTS = {"equals": "eq", "not": "ne", "lt": "lt", "lte": "lte", "gt": "gt", "gte": "gte", "contains": "contains", "startsWith": "starts_with", "endsWith": "ends_with"}


def roots(model: Model) -> dict[str, str]:
    one = model.name[0].lower() + model.name[1:]
    many = f"{one[:-1]}ies" if one.endswith("y") else f"{one}s"
    return {"one": one, "many": many, "count": f"{many}Count", "aggregate": f"{many}Aggregate", "group": f"{many}GroupBy"}


def _kind(t: str) -> str:
    if t.startswith("array<"):
        return f"[{_kind(t[6:-1])}]"
    return "Decimal" if t.startswith("decimal") else _SCALARS.get(t, "String")


def sdl(catalog: Catalog) -> str:
    """The schema text of a catalog: types, and roots with their arguments."""
    types, query = [], []
    for m in catalog.models.values():
        lines = [f"  {f}: {_kind(t)}{'!' if f in m.key else ''}" for f, t in m.fields.items()]
        many = [r for r in m.relations.values() if r.many]
        lines += [f"  {r.name}(where: JSON, orderBy: [JSON!], cursor: JSON, distinct: [String!], skip: Int, take: Int): [{r.target}!]!" if r.many else f"  {r.name}: {r.target}" for r in m.relations.values()]
        if many:
            types.append(f"type {m.name}Count {{\n" + "\n".join(f"  {r.name}(where: JSON): BigInt!" for r in many) + "\n}")
            lines.append(f"  _count: {m.name}Count!")
        types.append(f"type {m.name} {{\n" + "\n".join(lines) + "\n}")
        r = roots(m)
        if m.key:
            query.append(f"  {r['one']}(where: JSON!): {m.name}")
        query += [
            f"  {r['many']}(where: JSON, orderBy: [JSON!], cursor: JSON, distinct: [String!], skip: Int, take: Int = {TAKE}): [{m.name}!]!",
            f"  {r['count']}(where: JSON): BigInt!",
            f"  {r['aggregate']}(where: JSON): JSON!",
            f"  {r['group']}(by: [String!]!, where: JSON, having: JSON, orderBy: [JSON!], skip: Int, take: Int): [JSON!]!",
        ]
    return "\n\n".join([*types, "type Query {\n" + "\n".join(query) + "\n}"])


def execute(analyst: Analyst, document: str, variables: dict[str, Any] | None = None, operation: str | None = None, take: int = TAKE) -> dict[str, DataFrame]:
    """alias of each root field -> its rows. take: how many rows a list has that asks for no number."""
    catalog = analyst.catalog
    known = {name: (what, m) for m in catalog.models.values() for what, name in roots(m).items()}
    made = {}
    for root in parse(document, variables, operation):
        if root.name not in known:
            raise GraphQLError(f"no root {root.name}")
        what, m = known[root.name]
        made[root.alias] = {"one": _one, "many": _many, "count": _count, "aggregate": _aggregate, "group": _group}[what](analyst, m, root, take)
    return made


def _arguments(s: Selected, *allowed: str) -> dict[str, Any]:
    if unknown := set(s.arguments) - set(allowed):
        raise GraphQLError(f"{s.name} has no {sorted(unknown)}")
    return {k: v for k, v in s.arguments.items() if v is not None}


def _condition(where: Any, m: Model, catalog: Catalog) -> Condition:
    if where is None:
        return ALL
    if not isinstance(where, dict):
        raise GraphQLError("where takes an object")
    try:
        return from_dict(where, m, catalog)
    except ValueError as e:
        raise GraphQLError(str(e)) from e


def _order(order: Any, names: set[str]) -> tuple:
    made = []
    for o in order if isinstance(order, list) else [order] if order else []:
        for name, way in o.items():
            way = way if isinstance(way, dict) else {"sort": way}
            if name not in names or way.get("sort") not in ("asc", "desc") or way.get("nulls", "first") not in ("first", "last"):
                raise GraphQLError(f"orderBy {name}")
            made.append((name, way["sort"], *([way["nulls"]] if "nulls" in way else [])))
    return tuple(made)


def _page(s: Selected, m: Model, catalog: Catalog) -> dict[str, Any]:
    given = _arguments(s, "where", "orderBy", "cursor", "distinct", "skip", "take")
    distinct = given.get("distinct") or []
    return {
        "where": _condition(given.get("where"), m, catalog),
        "order_by": _order(given.get("orderBy"), set(m.fields)),
        "cursor": given.get("cursor"),
        "distinct": tuple(distinct if isinstance(distinct, list) else [distinct]),
        "skip": given.get("skip", 0),
        "take": given.get("take"),
    }


def _asked(fields: list[Selected], m: Model, catalog: Catalog) -> tuple[tuple[str, ...], dict[str, Args], dict[str, Condition]]:
    """The fields, relations (by alias) and counts that a selection needs."""
    select, include, count = [], {}, {}
    if not fields:
        raise GraphQLError(f"fields of {m.name} are needed")
    for s in fields:
        if s.name == "__typename":
            continue
        if s.name == "_count":
            for c in s.fields:
                r = m.relation(c.name) if c.name in m.relations else None
                if r is None or not r.many:
                    raise GraphQLError(f"{m.name} has no {c.name} to count")
                condition = _condition(_arguments(c, "where").get("where"), catalog.model(r.target), catalog)
                if count.setdefault(c.name, condition) != condition:
                    raise GraphQLError(f"{c.name} is counted in two ways")
        elif s.name in m.relations:
            r = m.relation(s.name)
            target = catalog.model(r.target)
            own, inner, counts = _asked(s.fields, target, catalog)
            request = _page(s, target, catalog) if r.many else {"where": _condition(_arguments(s, "where").get("where"), target, catalog)}
            include[s.alias] = Args(select=own, include=inner, count=counts, relation=s.name, **request)
        elif s.name in m.fields:
            if s.fields or s.arguments:
                raise GraphQLError(f"{s.name} is a field without arguments or parts")
            select.append(s.name)
        else:
            raise GraphQLError(f"{m.name} has no {s.name}")
    return tuple(dict.fromkeys(select)) or (m.key or tuple(m.fields))[:1], include, count


def _part(fields: list[Selected], m: Model, catalog: Catalog) -> Callable[[Column], Column]:
    return lambda x: F.struct(*_shaped(fields, m, catalog, lambda n: x[n]))


def _shaped(fields: list[Selected], m: Model, catalog: Catalog, get: Callable[[str], Column]) -> list[Column]:
    """Columns in the order and under the names that were asked for."""
    made = []
    for s in fields:
        if s.name == "__typename":
            value = F.lit(m.name)
        elif s.name == "_count":
            value = F.struct(*[get(f"{c.name}_count").alias(c.alias) for c in s.fields])
        elif s.name in m.relations:
            r = m.relation(s.name)
            target = catalog.model(r.target)
            part, whole = _part(s.fields, target, catalog), get(s.alias)
            value = F.transform(whole, part) if r.many else F.when(whole.isNotNull(), part(whole))
        else:
            value = get(s.name)
        made.append(value.alias(s.alias))
    return made


def _read(analyst: Analyst, m: Model, root: Selected, request: dict[str, Any]) -> DataFrame:
    select, include, count = _asked(root.fields, m, analyst.catalog)
    df = analyst.find_many(m.name, select=select, relations=include, count=count, **request)
    return df.select(*_shaped(root.fields, m, analyst.catalog, lambda n: F.col(f"`{n}`")))


def _many(analyst: Analyst, m: Model, root: Selected, take: int) -> DataFrame:
    request = _page(root, m, analyst.catalog)
    return _read(analyst, m, root, request | {"take": take if request["take"] is None else request["take"]})


def _one(analyst: Analyst, m: Model, root: Selected, take: int) -> DataFrame:
    where = _arguments(root, "where").get("where") or {}
    if not m.key or set(where) != set(m.key) or any(isinstance(v, dict) for v in where.values()):
        raise GraphQLError(f"{root.name} takes {m.key}")
    return _read(analyst, m, root, {"where": _condition(where, m, analyst.catalog), "take": 1})


def _count(analyst: Analyst, m: Model, root: Selected, take: int) -> DataFrame:
    if root.fields:
        raise GraphQLError(f"{root.name} is a number")
    return analyst.count(m.name, _condition(_arguments(root, "where").get("where"), m, analyst.catalog))


def _measures(fields: list[Selected], m: Model) -> tuple[list[Measure], list[tuple[str, str, str | None]]]:
    """Measures, and (alias, measure, inner alias or None) in the order that was asked for."""
    measures, shape = {}, []
    for s in fields:
        if s.name == "_count" and not s.fields:
            measures["count_all_"] = Measure("count_all_", "count_all")
            shape.append((s.alias, "count_all_", None))
            continue
        op = {"_count": "count", "_sum": "sum", "_avg": "avg", "_min": "min", "_max": "max"}.get(s.name)
        if op is None:
            shape.append((s.alias, s.name, None))
            continue
        for c in s.fields:
            if c.name not in m.fields:
                raise GraphQLError(f"{m.name} has no {c.name}")
            name = f"{op}_{c.name}"
            measures[name] = Measure(name, op, c.name)
            shape.append((s.alias, name, c.alias))
    return list(measures.values()), shape


def _formed(df: DataFrame, shape: list[tuple[str, str, str | None]]) -> DataFrame:
    made: dict[str, Any] = {}
    for alias, name, inner in shape:
        if inner is None:
            made[alias] = F.col(f"`{name}`")
        else:
            made.setdefault(alias, []).append(F.col(f"`{name}`").alias(inner))
    return df.select(*[(F.struct(*c) if isinstance(c, list) else c).alias(a) for a, c in made.items()])


def _aggregate(analyst: Analyst, m: Model, root: Selected, take: int) -> DataFrame:
    measures, shape = _measures(root.fields, m)
    if unknown := {name for _, name, _ in shape} - {x.name for x in measures} or (not measures and {root.name}):
        raise GraphQLError(f"{root.name} has no {sorted(unknown)}")
    return _formed(analyst.aggregate(m.name, measures, _condition(_arguments(root, "where").get("where"), m, analyst.catalog)), shape)


def _tested(having: dict, names: dict[str, str]) -> Expr:
    """{measure or dimension: {op: operand}}, AND, OR, NOT; a measure is written {_sum: {field: {op: operand}}} or {_count: {..}}."""
    parts: list[Expr] = []
    for k, v in having.items():
        if k in ("AND", "OR", "NOT"):
            inner = [_tested(x, names) for x in (v if isinstance(v, list) else [v])]
            whole = inner[0]
            for p in inner[1:]:
                whole = whole & p if k == "AND" else whole | p
            parts.append(~whole if k == "NOT" else whole)
            continue
        tests = {k: v} if k in names else {f"{k}.{f}": t for f, t in v.items()} if isinstance(v, dict) else {}
        if not tests or set(tests) - set(names):
            raise GraphQLError(f"having knows no {k}")
        for name, t in tests.items():
            t = dict(t) if isinstance(t, dict) else {"equals": t}
            fold = t.pop("mode", "default") == "insensitive"
            for op, operand in t.items():
                x = out(names[name])
                if op in ("in", "notIn"):
                    parts.append(x.in_(*operand) if op == "in" else x.not_in(*operand))
                elif op not in _TESTS:
                    raise GraphQLError(f"unknown operator {op}")
                elif operand is None and op in ("equals", "not"):
                    parts.append(x.is_null() if op == "equals" else x.is_not_null())
                else:
                    parts.append(getattr(x, _TESTS[op])(operand, **({"fold": True} if fold and op in ("contains", "startsWith", "endsWith") else {})))
    if not parts:
        raise GraphQLError("having is empty")
    whole = parts[0]
    for p in parts[1:]:
        whole = whole & p
    return whole


def _group(analyst: Analyst, m: Model, root: Selected, take: int) -> DataFrame:
    given = _arguments(root, "by", "where", "having", "orderBy", "skip", "take")
    by = given.get("by")
    by = by if isinstance(by, list) else [by]
    dimensions = {d.split(".")[-1]: d if "." not in d else tuple(d.split(".")) for d in by if isinstance(d, str)}
    if not dimensions or len(dimensions) != len(by):
        raise GraphQLError("by takes fields, or paths, that end in different names")
    measures, shape = _measures(root.fields, m)
    if unknown := {name for _, name, _ in shape} - {x.name for x in measures} - set(dimensions):
        raise GraphQLError(f"{root.name} has no {sorted(unknown)}")
    having = given.get("having")
    # Measures that only having or the order names.
    names = {d: d for d in dimensions} | {"_count": "count_all_"} | {f"_{op}.{f}": f"{op}_{f}" for op in ("count", "sum", "avg", "min", "max") for f in m.fields}
    order = tuple((names[k], v) if not isinstance(v, dict) else (names[f"{k}.{next(iter(v))}"], next(iter(v.values()))) for o in (given.get("orderBy") or []) for k, v in o.items())
    have = {x.name for x in measures}
    asked = _tested(having, names) if having else None
    from policyframe.plans.expression import fields as fields_of

    for name in sorted({n for _, n in fields_of(asked)} if asked is not None else set()) + [n for n, _ in order]:
        if name not in have and name not in dimensions:
            measures.append(Measure("count_all_", "count_all") if name == "count_all_" else Measure(name, *name.split("_", 1)))
            have.add(name)
    df = analyst.group_by(m.name, dimensions, measures, where=_condition(given.get("where"), m, analyst.catalog), having=asked, order_by=order, skip=given.get("skip", 0), take=given.get("take"))
    return _formed(df, shape)
