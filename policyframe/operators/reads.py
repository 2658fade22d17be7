"""Policy-scoped reads: one DataFrame a request, whatever it includes."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from policyframe.operators.filters import flagged, where
from policyframe.plans.catalog import Catalog, Model
from policyframe.plans.policy import Forbidden, Policies, expand, visible_rows
from policyframe.plans.predicate import ALL, NONE, And, Condition, fields_of, implies, leaves_of, normalize
from policyframe.sources.stores import folder


@dataclass(frozen=True)
class Args:
    """What of a relation to load for each parent: as for find_many. A negative take is the last targets in the asked order; a
    cursor is a target's key, looked up under the policy alone, from which on targets count. `relation` names the relation where
    the key under which these stand is another name for it."""

    where: Condition = ALL
    order_by: tuple = ()
    skip: int = 0
    take: int | None = None
    distinct: tuple[str, ...] = ()
    select: tuple[str, ...] | None = None
    include: dict[str, Args] = field(default_factory=dict)
    cursor: dict | None = None
    count: dict[str, Condition] = field(default_factory=dict)
    relation: str | None = None


@dataclass(frozen=True)
class ReadLimits:
    """What a request may ask for at most; more is refused before anything is read."""

    depth: int = 5
    selected: int = 256


#: A page of at most so many rows: its keys are broadcast to the targets that they choose.
PAGE = 100_000


def ordering(order_by: tuple, key: tuple[str, ...]) -> list[tuple[str, bool, bool]]:
    """(field, descending, nulls first), ended by the key. Nulls are first ascending, last descending, unless said."""
    out = []
    for o in order_by:
        name, *rest = (o,) if isinstance(o, str) else o
        down = bool(rest) and rest[0] == "desc"
        out.append((name, down, rest[1] == "first" if len(rest) > 1 else not down))
    return out + [(k, False, True) for k in key if k not in {x[0] for x in out}]


def columns(order: list[tuple[str, bool, bool]], reverse: bool = False) -> list[Column]:
    out = []
    for name, down, first in order:
        c, down, first = F.col(f"`{name}`"), down != reverse, first != reverse
        out.append((c.desc_nulls_first() if first else c.desc_nulls_last()) if down else (c.asc_nulls_first() if first else c.asc_nulls_last()))
    return out


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with each row's place in the order. The rows are sorted in parts, which are kept by a checkpoint, as a part that is
    sorted again might begin elsewhere; a row's place is that in its part after the rows of the parts before."""
    spark = df.sparkSession
    folder(spark)
    parts = df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("_at", 33).alias("_part")
    sizes = parts.groupBy(part).agg(F.count("*").alias("_n"))  # a row a part
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")
    sizes = sizes.select(F.col("_part").alias("_q"), before)
    out = parts.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(sizes), F.col("_part") == F.col("_q"))
    own = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return out.withColumn(name, F.col("_before") + own + 1).drop("_at", "_part", "_q", "_before")


class Reader:
    def __init__(self, catalog: Catalog, policies: Policies | None = None, limits: ReadLimits = ReadLimits()):
        self.catalog, self.policies, self.limits = catalog, policies, limits

    # --- scopes ---------------------------------------------------------------------------------------------------

    def scope(self, name: str, given: Condition = ALL) -> DataFrame:
        """The rows that the policy shows, unmasked. `given` is put to them afterwards, and helps the scan before."""
        model = self.catalog.model(name)
        visible = visible_rows(model, self.catalog, self.policies)
        return where(self.catalog.rows(name, And((visible, given))), visible, model, self.catalog)

    def classify(self, name: str, f: str) -> str:
        """Whether a field, or a relation, of the rows that the policy shows is readable: always, conditional or never."""
        if self.policies is None:
            return "always"
        model = self.catalog.model(name)
        c = normalize(expand(self.policies.field(name, f), model, self.catalog, self.policies))
        if c == NONE:
            return "never"
        return "always" if c == ALL or implies(visible_rows(model, self.catalog, self.policies), c) else "conditional"

    def masked(self, df: DataFrame, name: str, fields: list[str] | dict[str, str]) -> DataFrame:
        """`fields` with null where the policy hides their values: fields, or relations with the columns that hold them."""
        model, out, own = self.catalog.model(name), {}, df.columns
        if self.policies is None:
            return df
        for i, (f, column) in enumerate(fields.items() if isinstance(fields, dict) else zip(fields, fields, strict=True)):
            kind = self.classify(name, f)
            if kind == "never":
                raise Forbidden(f"read {name}.{f}")
            if kind == "conditional":
                c = normalize(expand(self.policies.field(name, f), model, self.catalog, self.policies))
                df, flag = flagged(df, c, model, self.catalog, f"_m{i}_")
                out[column] = F.when(flag, F.col(f"`{column}`"))
        return df.withColumns(out).select(*[f"`{c}`" for c in own]) if out else df

    def allowed(self, name: str, used: set[str], given: Condition = ALL) -> None:
        """A conditional field may be filtered, ordered, grouped or summed by only where the request proves its condition."""
        if self.policies is None:
            return
        model = self.catalog.model(name)
        proof = normalize(And((visible_rows(model, self.catalog, self.policies), given)))
        for f in sorted(used):
            c = normalize(self.policies.field(name, f))
            if c != ALL and not implies(proof, c):
                raise Forbidden(f"use {name}.{f}")

    def filtered(self, name: str, condition: Condition = ALL, used: set[str] = frozenset()) -> DataFrame:
        model = self.catalog.model(name)
        for x in leaves_of(condition):
            if x.field in model.unordered and x.op in ("lt", "lte", "gt", "gte"):
                raise ValueError(f"{name}.{x.field} has no order")
        self.allowed(name, set(used))
        self.allowed(name, fields_of(condition), condition)
        return where(self.scope(name, condition), expand(condition, model, self.catalog, self.policies), model, self.catalog)

    # --- reads ----------------------------------------------------------------------------------------------------

    def page(self, name: str, *, where: Condition = ALL, order_by: tuple = (), cursor: dict | None = None, skip: int = 0, take: int | None = None, distinct: tuple[str, ...] = ()) -> DataFrame:
        """The rows of a request, unmasked and in no order."""
        model = self.catalog.model(name)
        order = ordering(order_by, model.key)
        df = self.filtered(name, where, {x[0] for x in ordering(order_by, ())} | set(distinct))
        if cursor:
            df = self._after(df, model, order, cursor)
        if distinct:
            w = Window.partitionBy(*[f"`{d}`" for d in distinct]).orderBy(*columns(order))
            df = df.withColumn("_first", F.row_number().over(w)).filter("_first = 1").drop("_first")
        if take is not None or skip:
            df = df.orderBy(*columns(order, take is not None and take < 0))
            df = df.offset(skip) if skip else df
            df = df.limit(abs(take)) if take is not None else df
        return df

    def find_many(
        self,
        name: str,
        *,
        where: Condition = ALL,
        order_by: tuple = (),
        cursor: dict | None = None,
        skip: int = 0,
        take: int | None = None,
        distinct: tuple[str, ...] = (),
        select: tuple[str, ...] | None = None,
        omit: tuple[str, ...] = (),
        include: dict[str, Args] | None = None,
        count: dict[str, Condition] | None = None,
        ordinal: str | None = None,
        relations: dict[str, Args] | None = None,
    ) -> DataFrame:
        """Rows of a model. `include` adds relations to all fields, `relations` to those of `select`. A negative take is the last rows in the asked order. `ordinal` names a column with each row's
        place; without it and without an order, rows come in no order, and nothing is sorted. Rows are sorted last, after
        masks, relations and counts are joined. Relations of a page with a take are loaded for its rows alone."""
        model = self.catalog.model(name)
        if select is not None and (include or omit):
            raise ValueError("select goes with neither include nor omit")
        include = (include or {}) | (relations or {})
        self._within_limits(model, select, include, 1)
        order = ordering(order_by, model.key)
        df = self.page(name, where=where, order_by=order_by, cursor=cursor, skip=skip, take=take, distinct=distinct)
        if ordinal:
            # A page is one task's already; a whole table is numbered part by part.
            df = df.withColumn(ordinal, F.row_number().over(Window.orderBy(*columns(order)))) if take is not None else numbered(df, columns(order), ordinal)
        fields = list(select) if select is not None else [f for f in model.fields if f not in omit]
        most = abs(take) if take is not None else None
        # What the order needs is kept beside the fields, whose values may be masked.
        kept = {x: f"_o{i}" for i, (x, *_) in enumerate(order)} if order_by or cursor or (take is not None and take < 0) else {}
        df = df.withColumns({o: F.col(f"`{x}`") for x, o in kept.items()})
        df = self.masked(df, name, fields)
        for name_, args in include.items():
            df = self._loaded(df, model, args.relation or name_, args, most, name_)
        for name_, condition in (count or {}).items():
            df = self._counted(df, model, name_, condition, most)
        if kept:
            df = df.orderBy(*columns([(kept[x], down, first) for x, down, first in order]))
        extra = [*include, *[f"{r}_count" for r in count or {}], *([ordinal] if ordinal else [])]
        return df.select(*[f"`{f}`" for f in [*fields, *extra]])

    def _within_limits(self, model: Model, select: tuple[str, ...] | None, include: dict[str, Args], depth: int) -> int:
        """How many fields are selected at and below this depth."""
        if depth > self.limits.depth:
            raise ValueError(f"relations are nested deeper than {self.limits.depth}")
        n = len(select if select is not None else model.fields)
        for name, args in include.items():
            n += 1 + self._within_limits(self.catalog.model(model.relation(args.relation or name).target), args.select, args.include, depth + 1)
        if n > self.limits.selected:
            raise ValueError(f"more than {self.limits.selected} fields are selected")
        return n

    def find_first(self, name: str, **request) -> DataFrame:
        return self.find_many(name, **request | {"take": 1})

    def find_unique(self, name: str, key: dict, **request) -> DataFrame:
        """At most one row; two would show that the key is none, and raise."""
        model = self.catalog.model(name)
        if set(key) != set(model.key):
            raise ValueError(f"{name} is told by {model.key}")
        from policyframe.plans.predicate import Field

        df = self.find_many(name, where=And(tuple(Field(k).eq(v) for k, v in key.items())), **request).limit(2)
        n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))  # of two rows at most
        return df.withColumn("_n", n).filter(F.assert_true(F.col("_n") <= 1, F.lit("the key is not unique")).isNull()).drop("_n")

    def count(self, name: str, condition: Condition = ALL) -> DataFrame:
        return self.filtered(name, condition).agg(F.count("*").alias("n"))

    def _after(self, df: DataFrame, model: Model, order: list[tuple[str, bool, bool]], cursor: dict) -> DataFrame:
        """From the anchor on, itself included. The anchor is looked up under the policy alone; a missing one gives no rows."""
        if not model.key or set(cursor) != set(model.key):
            raise ValueError(f"a cursor on {model.name} needs {model.key or 'a key'}")
        from policyframe.plans.predicate import Field

        anchor = where(self.scope(model.name), And(tuple(Field(k).eq(v) for k, v in cursor.items())), model, self.catalog)
        anchor = anchor.select(*[F.col(f"`{name}`").alias(f"_a_{name}") for name, _, _ in order]).limit(1)
        df = df.crossJoin(F.broadcast(anchor))  # one row
        after, same = F.lit(False), F.lit(True)
        for name, down, first in order:
            own, at = F.col(f"`{name}`"), F.col(f"`_a_{name}`")
            more = F.coalesce(own < at if down else own > at, F.lit(False))
            more |= (at.isNull() & own.isNotNull()) if first else (at.isNotNull() & own.isNull())
            after, same = after | (same & more), same & own.eqNullSafe(at)
        return df.filter(after | same).drop(*[f"_a_{name}" for name, _, _ in order])

    def _of_page(self, rows: DataFrame, df: DataFrame, pairs: list[tuple[str, str]], most: int | None) -> DataFrame:
        """rows whose columns (second of pairs) meet a key of df (first): null keys meet none, and those of a bounded page are
        broadcast, so that targets of no row of it are not sorted or shuffled."""
        rows = rows.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for _, k in pairs]))
        if most is None or most > PAGE:
            return rows
        keys = df.select(*[F.col(f"`{own}`").alias(f"_p{i}") for i, (own, _) in enumerate(pairs)]).distinct()
        return rows.join(F.broadcast(keys), [rows[k] == keys[f"_p{i}"] for i, (_, k) in enumerate(pairs)], "left_semi")

    def _loaded(self, df: DataFrame, model: Model, name: str, args: Args, most: int | None = None, as_: str | None = None) -> DataFrame:
        """A column with the relation's target (a struct or null) or targets (an array, in order), paged per parent. A second
        target of a to-one relation fails the read. most: how many rows df has at most, if that is known."""
        relation, column = model.relation(name), as_ or name
        target = self.catalog.model(relation.target)
        rows = self.filtered(target.name, args.where, {x[0] for x in ordering(args.order_by, ())} | set(args.distinct))
        keys = [f"_r_{column}_{i}" for i in range(len(relation.pairs))]
        pairs = [(own, k) for k, (own, _) in zip(keys, relation.pairs, strict=True)]
        rows = rows.withColumns({k: F.col(f"`{theirs}`") for k, (_, theirs) in zip(keys, relation.pairs, strict=True)})
        rows = self._of_page(rows, df, pairs, most)
        order = ordering(args.order_by, target.key or tuple(target.fields))
        if args.cursor:
            rows = self._after(rows, target, order, args.cursor)
        if args.distinct:
            w = Window.partitionBy(*keys, *[f"`{d}`" for d in args.distinct]).orderBy(*columns(order))
            rows = rows.withColumn("_first", F.row_number().over(w)).filter("_first = 1").drop("_first")
        fields = list(args.select or target.fields)
        if relation.many:
            last = args.take is not None and args.take < 0
            rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*columns(order, last))))
            if args.skip or args.take is not None:
                end = args.skip + abs(args.take) if args.take is not None else (1 << 31) - 1
                rows = rows.filter((F.col("_place") > args.skip) & (F.col("_place") <= end))
            rows = rows.withColumn("_place", -F.col("_place")) if last else rows
        rows = self.masked(rows, target.name, fields)
        # Of the targets of a bounded page no bound is known.
        for inner, inner_args in args.include.items():
            rows = self._loaded(rows, target, inner_args.relation or inner, inner_args, None, inner)
            fields.append(inner)
        for inner, condition in args.count.items():
            rows = self._counted(rows, target, inner, condition)
            fields.append(f"{inner}_count")
        value = F.struct(*[F.col(f"`{f}`") for f in fields])
        if relation.many:
            rows = rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", value.alias("v")))), lambda x: x["v"]).alias(column))
        else:
            rows = rows.groupBy(*keys).agg(F.first(value).alias("_v"), F.count("*").alias("_n"))
            several = F.raise_error(F.lit(f"{model.name}.{name} has several targets")).cast(rows.schema["_v"].dataType)
            rows = rows.select(*keys, F.when(F.col("_n") == 1, F.col("_v")).otherwise(several).alias(column))
        df = df.join(rows, [df[f"`{own}`"] == rows[k] for own, k in pairs], "left").drop(*keys)
        df = df.withColumn(column, F.coalesce(F.col(column), F.array())) if relation.many else df
        return self.masked(df, model.name, {name: column})

    def _counted(self, df: DataFrame, model: Model, name: str, condition: Condition, most: int | None = None) -> DataFrame:
        relation = model.relation(name)
        keys = [f"_c{i}" for i in range(len(relation.pairs))]
        pairs = [(own, k) for k, (own, _) in zip(keys, relation.pairs, strict=True)]
        rows = self.filtered(relation.target, condition)
        rows = rows.select(*[F.col(f"`{theirs}`").alias(k) for k, (_, theirs) in zip(keys, relation.pairs, strict=True)])
        rows = self._of_page(rows, df, pairs, most).groupBy(*keys).agg(F.count("*").alias(f"{name}_count"))
        df = df.join(rows, [df[f"`{own}`"] == rows[k] for own, k in pairs], "left").drop(*keys)
        df = df.withColumn(f"{name}_count", F.coalesce(f"{name}_count", F.lit(0)))
        return self.masked(df, model.name, {name: f"{name}_count"})

    def order_by_relation(self, name: str, relation: str, by: str, down: bool, take: int | None = None) -> DataFrame:
        """All rows, or the first `take`, ordered by a field of a to-one target, or, with by '_count', by how many targets there are."""
        model = self.catalog.model(name)
        r = model.relation(relation)
        df = self.scope(name)
        if by == "_count":
            df = self._counted(df, model, relation, ALL).withColumnRenamed(f"{relation}_count", "_by")
        else:
            target = self.scope(r.target).select(*[F.col(f"`{t}`").alias(f"_o{i}") for i, (_, t) in enumerate(r.pairs)], F.col(f"`{by}`").alias("_by"))
            df = df.join(target, [df[f"`{own}`"] == target[f"_o{i}"] for i, (own, _) in enumerate(r.pairs)], "left")
        order = columns([("_by", down, not down), *[(k, False, True) for k in model.key]])
        if take is None:
            df = numbered(df, order, "ordinal")
        else:
            df = df.orderBy(*order).limit(take).withColumn("ordinal", F.row_number().over(Window.orderBy(*order)))
        return df.select(*model.key, F.col("_by").alias("by"), "ordinal")
