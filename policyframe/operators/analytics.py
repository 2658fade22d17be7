"""Aggregates, groups, and groups along to-one relations, under the policy."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from policyframe.functions.exact import INTEGERS, avg_of, avg_parts, exact_avg, exact_sum
from policyframe.operators.reads import Reader, columns, ordering
from policyframe.plans.catalog import Model, Relation
from policyframe.plans.expression import Expr, Refused, build, checked, fields, walk
from policyframe.plans.policy import visible_rows
from policyframe.plans.predicate import ALL, And, Condition, Leaf, Or, implies, normalize

_ORDERED_ONLY = ("boolean",)


@dataclass(frozen=True)
class Measure:
    name: str
    op: str
    field: str | None = None


def count_all(name: str = "n") -> Measure:
    return Measure(name, "count_all")


def count_(field: str, name: str) -> Measure:
    return Measure(name, "count", field)


def count_distinct(field: str, name: str) -> Measure:
    return Measure(name, "count_distinct", field)


def sum_(field: str, name: str) -> Measure:
    return Measure(name, "sum", field)


def avg_(field: str, name: str) -> Measure:
    return Measure(name, "avg", field)


def min_(field: str, name: str) -> Measure:
    return Measure(name, "min", field)


def max_(field: str, name: str) -> Measure:
    return Measure(name, "max", field)


def measured(m: Measure, model: Model) -> Column:
    kind = model.fields.get(m.field, "")
    if m.field is not None and not kind:
        raise ValueError(f"{model.name} has no {m.field}")
    if m.op in ("min", "max") and m.field in model.unordered:
        raise ValueError(f"{model.name}.{m.field} has no order")
    c = F.col(f"`{m.field}`") if m.field else None
    if m.op in ("min", "max") and kind in _ORDERED_ONLY or m.op in ("sum", "avg") and kind in ("string", "boolean", "date", "timestamp"):
        raise ValueError(f"{m.op} of {kind}")
    return {"count_all": lambda: F.count("*"), "count": lambda: F.count(c), "count_distinct": lambda: F.count_distinct(c), "sum": lambda: exact_sum(c, kind), "avg": lambda: exact_avg(c, kind), "min": lambda: F.min(c), "max": lambda: F.max(c)}[m.op]().alias(m.name)


@dataclass(frozen=True)
class GroupLimits:
    """More rows that contribute, groups before or groups after `having` fail the query; nothing is cut off. They are counted
    first, no further than one beyond the limit."""

    rows: int | None = 1_000_000
    groups: int | None = 250_000
    results: int | None = 100_000


def within(df: DataFrame, most: int | None, what: str) -> None:
    if most is not None and df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} {what}")


class Analyst(Reader):
    def aggregate(self, name: str, measures: list[Measure], where: Condition = ALL, *, order_by: tuple = (), cursor: dict | None = None, skip: int = 0, take: int | None = None) -> DataFrame:
        """One row, also over no rows. With an order, cursor, skip or take, over that page of the rows."""
        model = self.catalog.model(name)
        paged = cursor is not None or skip or take is not None
        df = self.page(name, where=where, order_by=order_by, cursor=cursor, skip=skip, take=take) if paged else self.filtered(name, where)
        self.allowed(name, {m.field for m in measures if m.field}, where)
        return df.agg(*[measured(m, model) for m in measures])

    def group_by(self, name: str, by: dict[str, str | tuple[str, ...]], measures: list[Measure], *, where: Condition = ALL, having: Expr | None = None, order_by: tuple = (), skip: int = 0, take: int | None = None, limits: GroupLimits | None = None, most_take: int | None = None) -> DataFrame:
        """by: dimension -> a field, or a path of to-one relations that ends in a field; rows whose path meets an invisible
        or missing target fall out. Null is a group of its own. `having` is an expression over dimensions and measures as
        `out(name)` (unselected measures too, if they are named here with a leading underscore). A field at the end of a path
        is readable, too, where the request fixes the keys that lead there."""
        model = self.catalog.model(name)
        if not by or len(set(by)) != len(by) or {m.name for m in measures} & set(by) or len({m.name for m in measures}) != len(measures):
            raise ValueError("a group needs dimensions, and names that differ")
        if take == 0 or (most_take is not None and take is not None and abs(take) > most_take):
            raise ValueError(f"take {take}")
        local = {d: p for d, p in by.items() if isinstance(p, str)}
        self.allowed(name, {*local.values(), *[m.field for m in measures if m.field]}, where)
        df, ends, joined = self.filtered(name, where), {}, {}
        kinds = {m.name: (m.op, model.fields.get(m.field, "")) for m in measures}
        for d, path in by.items():
            if isinstance(path, str):
                ends[d] = F.col(f"`{path}`")
                kinds[d] = ("", model.fields[path])
                continue
            at, prefix, current = model, "", ()
            given = And((visible_rows(model, self.catalog, self.policies), where))
            for hop in path[:-1]:
                relation = at.relation(hop)
                if relation.many:
                    raise ValueError(f"{hop} leads to many")
                current += (hop,)
                new = f"{'__'.join(current)}__"
                if current not in joined:
                    target = self.scope(relation.target)
                    target = target.select(*[F.col(f"`{c}`").alias(f"{new}{c}") for c in target.columns])
                    df = df.join(target, [F.col(f"`{prefix}{own}`") == target[f"`{new}{theirs}`"] for own, theirs in relation.pairs], "inner")
                    joined[current] = True
                given = And((transferred(given, relation), visible_rows(self.catalog.model(relation.target), self.catalog, self.policies)))
                at, prefix = self.catalog.model(relation.target), new
            self.allowed(at.name, {path[-1]}, given)
            ends[d] = F.col(f"`{prefix}{path[-1]}`")
            kinds[d] = ("", at.fields[path[-1]])
        if limits is not None:
            within(df, limits.rows, "rows contribute")
        out = df.groupBy(*[c.alias(d) for d, c in ends.items()]).agg(*[measured(m, model) for m in measures])
        if limits is not None:
            within(out, limits.groups, "groups")
        if having is not None:
            out = out.filter(tested(having, kinds))
            if limits is not None:
                within(out, limits.results, "resulting groups")
        order = ordering(order_by, tuple(by))
        last = take is not None and take < 0
        if take is not None or skip:
            out = out.orderBy(*columns(order, last))
            out = out.offset(skip) if skip else out
            out = out.limit(abs(take)) if take is not None else out
        if take is not None:
            out = out.withColumn("ordinal", F.row_number().over(Window.orderBy(*columns(order))))  # over the page
        if order_by or last:
            out = out.orderBy(*columns(order))
        return out.drop(*[m.name for m in measures if m.name.startswith("_")])

    def relation_group_two_phase(self, name: str, relation: str, dimension: tuple[str, str], measures: list[Measure], where: Condition = ALL) -> DataFrame:
        """The same as group_by along one to-one relation, with the aggregation by foreign key before the join: fewer rows
        are joined than facts. Sums add up, averages are taken once from sums and counts, exactly for decimals, least and
        largest merge."""
        model = self.catalog.model(name)
        r = model.relation(relation)
        if r.many:
            raise ValueError(f"{relation} leads to many")
        self.allowed(name, {m.field for m in measures if m.field}, where)
        self.allowed(r.target, {dimension[1]}, transferred(And((visible_rows(model, self.catalog, self.policies), where)), r))
        facts = self.filtered(name, where)
        own = [o for o, _ in r.pairs]
        parts, out = [], []
        merge = {"count_all": F.sum, "count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
        for m in measures:
            kind = model.fields.get(m.field, "")
            if m.op == "count_distinct":
                raise ValueError("distinct values of parts do not add up")
            if m.op == "avg":
                total, n = avg_parts(F.col(f"`{m.field}`"), kind)
                parts += [total.alias(f"{m.name}__s"), n.alias(f"{m.name}__n")]
                out.append(avg_of(F.sum(f"{m.name}__s"), F.sum(f"{m.name}__n"), kind).alias(m.name))
            else:
                parts.append(measured(m, model))
                whole = merge[m.op](m.name)
                out.append((whole.cast("decimal(38,0)") if m.op == "sum" and kind in INTEGERS else whole).alias(m.name))
        first = facts.groupBy(*own).agg(*parts)
        target = self.scope(r.target).select(*[F.col(f"`{t}`").alias(f"_t{i}") for i, (_, t) in enumerate(r.pairs)], F.col(f"`{dimension[1]}`").alias(dimension[0]))
        joined = first.join(target, [first[o] == target[f"_t{i}"] for i, o in enumerate(own)], "inner")
        return joined.groupBy(dimension[0]).agg(*out)


def transferred(given: Condition, relation: Relation) -> Condition:
    """What a condition on a row proves of its target: a key that it fixes is fixed there too."""
    found = []

    def tests(c: Condition) -> list[Leaf]:
        if isinstance(c, And | Or):
            return [x for p in c.parts for x in tests(p)]
        return [c] if isinstance(c, Leaf) and c.op == "eq" and not c.path and not c.fold else []

    for own, theirs in relation.pairs:
        found += [Leaf(theirs, "eq", x.value) for x in tests(normalize(given)) if x.field == own and implies(given, x)]
    return And(tuple(found))


def tested(having: Expr, kinds: dict[str, tuple[str, str]]) -> Column:
    """A test of groups by their dimensions and measures. Texts are searched in the least and largest of a text field alone."""
    for x in walk(checked(having)):
        if x.op not in ("field", "lit", "call"):
            raise Refused("having tests measures by their names")
        if x.op == "field" and (x.value[0] is not None or x.value[1] not in kinds):
            raise Refused(f"no dimension or measure {x.value[1]}")
        if x.op == "call" and x.value in ("contains", "starts_with", "ends_with"):
            for _, name in fields(x):
                if kinds[name][0] not in ("min", "max") or kinds[name][1] != "string":
                    raise Refused(f"{x.value} of {name}, which is no least or largest text")
    return build(having, lambda _, name: F.col(f"`{name}`"))
