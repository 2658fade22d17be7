"""Explicit analytical queries over policy-scoped tables: joins, conditions, groups, windows, named steps.

A query is immutable; each step gives a new one. It is made of models of the catalog, which are scoped and masked before
anything else sees them, of steps that the query itself has named, and of typed expressions over these. Texts of SQL, columns,
DataFrames and functions of the caller are refused, and so are set operations, other kinds of joins and writes, for which there
is nothing to call. Masked fields may be shown, as they are masked; where rows are chosen, joined, ordered, grouped,
aggregated or windowed by one, the conditions given for its occurrence must prove that it is readable.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policyframe.operators.filters import where as filtered
from policyframe.operators.reads import Reader
from policyframe.plans.expression import Expr, Refused, aggregated, build, checked, fields, grouped_only, has, text, walk
from policyframe.plans.policy import expand
from policyframe.plans.predicate import ALL, And, Condition, fields_of


@dataclass(frozen=True)
class Step:
    """A named result; one: whether it has one row, as a total of all rows has."""

    df: DataFrame
    columns: tuple[str, ...]
    one: bool = False


@dataclass(frozen=True)
class ScopedQuery:
    reader: Reader
    df: DataFrame
    occurrences: dict[str, str | Step]
    given: dict[str, Condition]
    steps: dict[str, Step]
    keys: dict[str, Expr] | None = None
    result: tuple[str, ...] | None = None
    one: bool = False
    uses: tuple[tuple[str, str], ...] = ()

    # --- sources --------------------------------------------------------------------------------------------------------

    @classmethod
    def of(cls, reader: Reader, model: str, alias: str) -> ScopedQuery:
        return cls(reader, cls._view(reader, model).alias(_name(alias)), {alias: model}, {alias: ALL}, {}, uses=(("model", model),))

    @staticmethod
    def _view(reader: Reader, model: str) -> DataFrame:
        if model not in reader.catalog.models:
            raise Refused(f"no model {model}")
        own = [f for f in reader.catalog.model(model).fields if reader.classify(model, f) != "never"]
        return reader.masked(reader.scope(model), model, own).select(*[f"`{f}`" for f in own])

    def join(self, kind: str, alias: str, relation: str, as_: str) -> ScopedQuery:
        """Along a declared relation of the occurrence `alias`, inner or left. Targets are scoped before they are joined, so
        an invisible one gives nulls on the left. Relations to many multiply rows."""
        r = self.reader.catalog.model(self._model(alias)).relation(relation)
        return self.join_on(kind, r.target, as_, [(Expr("field", (alias, own)), theirs) for own, theirs in r.pairs])._used("relation", f"{alias}.{relation}")

    def join_on(self, kind: str, model: str, as_: str, on: list[tuple[Expr, str]]) -> ScopedQuery:
        """With another scoped model, where expressions over this query equal fields of it."""
        self._joinable(kind, as_, on)
        right = self._view(self.reader, model)
        self.reader.allowed(model, {theirs for _, theirs in on})
        df = self.df.join(right.alias(as_), self._equal(on, as_, tuple(right.columns)), kind)
        return replace(self, df=df, occurrences=self.occurrences | {as_: model}, given=self.given | {as_: ALL})._used("model", model)._used("join", kind)

    def join_step(self, kind: str, step: str, as_: str, on: list[tuple[Expr, str]]) -> ScopedQuery:
        """With an earlier step of this query, where expressions equal its columns."""
        self._joinable(kind, as_, on)
        right = self._step(step)
        df = self.df.join(right.df.alias(as_), self._equal(on, as_, right.columns), kind)
        return replace(self, df=df, occurrences=self.occurrences | {as_: right})._used("join", f"{kind} step")

    def cross_step(self, step: str, as_: str) -> ScopedQuery:
        """With an earlier step that has one row, which every row gets."""
        self._joinable("inner", as_, [()])
        right = self._step(step)
        if not right.one:
            raise Refused(f"{step} may have more rows than one")
        return replace(self, df=self.df.crossJoin(F.broadcast(right.df.alias(as_))), occurrences=self.occurrences | {as_: right})._used("join", "cross step")

    def exists(self, model: str, on: list[tuple[Expr, str]], where: Condition = ALL, negate: bool = False) -> ScopedQuery:
        """Rows for which a visible row of the model has the fields that `on` says, and `where`; with negate, those without one."""
        self._open()
        self.reader.allowed(model, {theirs for _, theirs in on})
        keys = self.reader.filtered(model, where).select(*[F.col(f"`{theirs}`").alias(f"_e{i}") for i, (_, theirs) in enumerate(on)])
        return self._semi(keys, on, negate)._used("model", model)

    def exists_step(self, step: str, on: list[tuple[Expr, str]], negate: bool = False) -> ScopedQuery:
        self._open()
        right = self._step(step)
        if unknown := {theirs for _, theirs in on} - set(right.columns):
            raise Refused(f"{step} has no {sorted(unknown)}")
        return self._semi(right.df.select(*[F.col(f"`{theirs}`").alias(f"_e{i}") for i, (_, theirs) in enumerate(on)]), on, negate)

    def _semi(self, keys: DataFrame, on: list[tuple[Expr, str]], negate: bool) -> ScopedQuery:
        if not on:
            raise Refused("an existence test needs fields that correlate it")
        test = [self._column(a, "join") == keys[f"_e{i}"] for i, (a, _) in enumerate(on)]
        return replace(self, df=self.df.join(keys, test, "left_anti" if negate else "left_semi"))._used("join", "not exists" if negate else "exists")

    # --- rows, groups, results --------------------------------------------------------------------------------------------

    def when(self, alias: str, condition: Condition) -> ScopedQuery:
        """Rows whose occurrence meets a condition of the predicate algebra; it also serves as a proof that fields are readable.
        For occurrences that were joined to the left, use `where`."""
        self._open()
        model = self.reader.catalog.model(self._model(alias))
        if not isinstance(condition, Condition):
            raise Refused(f"a condition is needed, not {type(condition).__name__}")
        if unknown := fields_of(condition) - set(model.fields):
            raise Refused(f"{model.name} has no {sorted(unknown)}")
        given = And((self.given[alias], condition))
        self.reader.allowed(model.name, fields_of(condition), given)
        if len(self.occurrences) > 1:
            raise Refused("conditions come before joins")
        df = filtered(self.df, expand(condition, model, self.reader.catalog, self.reader.policies), model, self.reader.catalog)
        return replace(self, df=df.alias(alias), given=self.given | {alias: given})._used("filter", f"{alias}: {len(fields_of(condition))} fields")

    def where(self, condition: Expr) -> ScopedQuery:
        self._open()
        if has(checked(condition), "agg", "over", "rank"):
            raise Refused("rows are not chosen by aggregates; name a step first")
        return replace(self, df=self.df.filter(self._column(condition, "filter")))

    def group_by(self, **keys: Expr) -> ScopedQuery:
        self._open()
        if not keys:
            raise Refused("a group needs keys")
        for k, e in keys.items():
            _name(k)
            if has(checked(e), "agg", "over", "rank"):
                raise Refused("rows are not grouped by aggregates; name a step first")
        return replace(self, keys=dict(keys))

    def select(self, **columns: Expr) -> ScopedQuery:
        """After group_by, aggregates (the keys are kept); else columns, which may be windows over others, or totals of all rows."""
        if self.result is not None:
            raise Refused("name a step before selecting from this result")
        if not columns and self.keys is None:
            raise Refused("nothing is selected")
        for k, e in columns.items():
            _name(k)
            checked(e)
            for x in walk(e):
                if x.op == "agg" and any(has(p, "agg", "over", "rank") for p in x.parts):
                    raise Refused("an aggregate of aggregates; name a step first")
                if x.op == "rank" and x.value != "lag" and x.parts:
                    raise Refused(x.value)
            if _bare(e, "rank"):
                raise Refused("a rank needs a window")
        total = any(map(aggregated, columns.values()))
        if self.keys is not None:
            if twice := set(columns) & set(self.keys):
                raise Refused(f"{sorted(twice)} are keys")
            for k, e in columns.items():
                if has(e, "over", "rank"):
                    raise Refused("windows come before groups or in a step after")
                if not grouped_only(e, tuple(self.keys.values())):
                    raise Refused(f"{k} holds a field outside of the keys and aggregates")
            keys = [self._column(e, "group").alias(k) for k, e in self.keys.items()]
            made = [self._column(e, "aggregate").alias(k) for k, e in columns.items()]
            df = self.df.groupBy(*keys).agg(*made) if made else self.df.select(*keys).distinct()
            return replace(self, df=df, occurrences={}, given={}, keys=None, result=(*self.keys, *columns), one=False)._said("group", self.keys)._said("select", columns)
        if total:
            for k, e in columns.items():
                if not grouped_only(e, ()) or has(e, "over", "rank"):
                    raise Refused(f"{k} holds a field outside of aggregates, without a group")
        made = [self._column(e, "aggregate" if total else "window" if has(e, "over", "rank") else "show").alias(k) for k, e in columns.items()]
        df = self.df.agg(*made) if total else self.df.select(*made)
        return replace(self, df=df, occurrences={}, given={}, result=tuple(columns), one=total)._said("select", columns)

    def having(self, condition: Expr) -> ScopedQuery:
        """Rows of the result, by its own columns."""
        if self.result is None:
            raise Refused("having comes after select")
        if has(checked(condition), "agg", "over", "rank"):
            raise Refused("having tests columns of the result")
        return replace(self, df=self.df.filter(self._column(condition, "filter")))

    def page(self, order_by: list[Expr | tuple[Expr, str]], take: int | None = None, skip: int = 0) -> ScopedQuery:
        """The result in order, or a part of it. Nulls come first ascending and last descending."""
        if self.result is None:
            raise Refused("a page comes after select")
        if not order_by or (take is not None and take <= 0) or skip < 0:
            raise Refused("a page needs an order, and a take above zero")
        order = []
        for o in order_by:
            e, way = o if isinstance(o, tuple) else (o, "asc")
            c = self._column(checked(e), "order")
            order.append(c.desc_nulls_last() if way == "desc" else c.asc_nulls_first())
        df = self.df.orderBy(*order)
        df = df.offset(skip) if skip else df
        return replace(self, df=df.limit(take) if take is not None else df)

    def step(self, name: str) -> ScopedQuery:
        """Names the result; the query goes on from it, as an occurrence of that name."""
        if self.result is None:
            raise Refused("only a result can be named")
        if _name(name) in self.steps:
            raise Refused(f"{name} is a step already")
        made = Step(self.df, self.result, self.one)
        return replace(self, df=made.df.alias(name), occurrences={name: made}, steps=self.steps | {name: made}, result=None, one=False)

    def root(self, model: str, alias: str) -> ScopedQuery:
        """Goes on from another scoped model, with the steps so far at hand."""
        if alias in self.steps:
            raise Refused(f"{alias} is a step")
        new = ScopedQuery.of(self.reader, model, alias)
        return replace(new, steps=self.steps, uses=(*self.uses, *new.uses))

    def from_step(self, name: str) -> ScopedQuery:
        """Goes on from an earlier step."""
        made = self._step(name)
        return replace(self, df=made.df.alias(name), occurrences={name: made}, given={}, keys=None, result=None, one=False)

    def frame(self) -> DataFrame:
        if self.result is None:
            raise Refused("nothing is selected")
        return self.df

    # --- records ----------------------------------------------------------------------------------------------------------

    def audit(self) -> dict[str, Any]:
        """What the query is made of, without values: models, relations, kinds of joins and expressions, fields by use, and a
        fingerprint that queries of one shape share."""
        out: dict[str, Any] = {}
        for use, what in self.uses:
            out.setdefault(use, []).append(what)
        out = {use: sorted(set(what)) for use, what in out.items()}
        out["scoped"] = self.reader.policies is not None
        out["fingerprint"] = hashlib.sha256(json.dumps(self.uses).encode()).hexdigest()
        return out

    def audited(self, action: Callable[[DataFrame], Any], sink: Callable[[dict[str, Any]], None]) -> Any:
        """What `action` makes of the frame; the sink gets the record, with how long it took and how it ended."""
        began, record = time.perf_counter(), self.audit()
        try:
            out = action(self.frame())
            sink(record | {"outcome": "done", "seconds": time.perf_counter() - began, "rows": len(out) if isinstance(out, list) else None})
            return out
        except Exception as e:
            sink(record | {"outcome": type(e).__name__, "seconds": time.perf_counter() - began, "rows": None})
            raise

    # --- checks -------------------------------------------------------------------------------------------------------------

    def _used(self, use: str, what: str) -> ScopedQuery:
        return replace(self, uses=(*self.uses, (use, what)))

    def _said(self, use: str, columns: dict[str, Expr]) -> ScopedQuery:
        return replace(self, uses=(*self.uses, *[(use, f"{k}: {text(e)}") for k, e in columns.items()]))

    def _open(self) -> None:
        if self.result is not None or self.keys is not None:
            raise Refused("the result is selected or grouped already; name a step first")

    def _model(self, alias: str) -> str:
        model = self.occurrences.get(alias)
        if not isinstance(model, str):
            raise Refused(f"{alias} is no occurrence of a model here")
        return model

    def _step(self, name: str) -> Step:
        if name not in self.steps:
            raise Refused(f"no step {name}")
        return self.steps[name]

    def _joinable(self, kind: str, as_: str, on: list) -> None:
        self._open()
        if kind not in ("inner", "left"):
            raise Refused(f"{kind} joins are refused")
        if _name(as_) in self.occurrences:
            raise Refused(f"{as_} is an occurrence already")
        if not on:
            raise Refused("a join needs fields that are equal")

    def _equal(self, on: list[tuple[Expr, str]], as_: str, columns: tuple[str, ...]) -> list[Column]:
        if unknown := {theirs for _, theirs in on} - set(columns):
            raise Refused(f"{as_} has no {sorted(unknown)}")
        return [self._column(checked(a), "join") == F.col(f"`{as_}`.`{theirs}`") for a, theirs in on]

    def _column(self, e: Expr, use: str) -> Column:
        """Its column, if its fields are there and may be used so."""
        asked: dict[str, set[str]] = {}
        for alias, name in fields(checked(e)):
            if isinstance(self.occurrences.get(alias), str):
                asked.setdefault(alias, set()).add(name)

        def resolve(alias: str | None, name: str) -> Column:
            if alias is None:
                if self.result is None or name not in self.result:
                    raise Refused(f"the result has no {name}")
                return F.col(f"`{name}`")
            if alias not in self.occurrences:
                raise Refused(f"no occurrence {alias}")
            what = self.occurrences[alias]
            if name not in (what.columns if isinstance(what, Step) else self.reader.catalog.model(what).fields):
                raise Refused(f"{alias} has no {name}")
            if isinstance(what, str) and self.reader.classify(what, name) == "never":
                raise Refused(f"{alias}.{name} is not readable")
            return F.col(f"`{alias}`.`{name}`")

        made = build(e, resolve)
        if use != "show":
            for alias, names in asked.items():
                self.reader.allowed(self._model(alias), names, self.given.get(alias, ALL))
        return made


def _bare(e: Expr, op: str) -> bool:
    """Whether it holds an `op` that no window covers."""
    return e.op == op or any(_bare(p, op) for p in (e.parts[1:] if e.op == "over" else e.parts))


def _name(x: str) -> str:
    if not isinstance(x, str) or not x.isidentifier() or x.startswith("_"):
        raise Refused(f"{x!r} is no name")
    return x
