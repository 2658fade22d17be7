"""Writes as frames: the rows after, the facts of what changed, and checks against the policy before and after.

Plain files have no transactions: a caller writes `after` and `facts` together in one batch and swaps them in.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policyframe.operators.filters import flagged, where
from policyframe.operators.reads import Reader
from policyframe.plans.policy import expand
from policyframe.plans.predicate import ALL, Condition


@dataclass(frozen=True)
class Change:
    after: DataFrame
    facts: DataFrame


class Writer(Reader):
    def _condition(self, name: str, action: str) -> Condition:
        model = self.catalog.model(name)
        return ALL if self.policies is None else expand(self.policies.rows(name, action), model, self.catalog, self.policies)

    def _checked(self, df: DataFrame, name: str, action: str, touched: Column) -> DataFrame:
        """Touched rows that the policy does not grant make the write fail when it runs."""
        if self.policies is None:
            return df
        model, own = self.catalog.model(name), df.columns
        df, granted = flagged(df, self._condition(name, action), model, self.catalog, "_g")
        return self._sure(df, own, name, ~touched | granted, f"{action} {name} is denied")

    def _sure(self, df: DataFrame, own: list[str], name: str, ok: Column, words: str) -> DataFrame:
        """df's columns `own`; rows that are not ok raise. A filter alone would not do: one that drops the row may be moved
        before it. So the values that later steps need, `_hit` and a field that every full write has, hold the test too."""
        model = self.catalog.model(name)
        held = {(model.key or tuple(model.fields))[0], *[c for c in ("_hit",) if c in own]}
        raised = F.raise_error(F.lit(words))
        columns = [F.when(ok, F.col(f"`{c}`")).otherwise(raised.cast(df.schema[c].dataType)).alias(c) if c in held else F.col(f"`{c}`") for c in own]
        return df.filter(F.assert_true(ok, F.lit(words)).isNull()).select(*columns)

    def _facts(self, df: DataFrame, name: str, action: Column | str) -> DataFrame:
        key = F.to_json(F.struct(*[f"`{k}`" for k in self.catalog.model(name).key]))
        return df.select(F.lit(name).alias("model"), (F.lit(action) if isinstance(action, str) else action).alias("action"), key.alias("identity"))

    def create_many(self, name: str, rows: DataFrame) -> Change:
        rows = self._checked(rows, name, "create", F.lit(True))
        return Change(self.catalog.rows(name).unionByName(rows), self._facts(rows, name, "created"))

    def update_many(self, name: str, condition: Condition, **assign: str | Column) -> Change:
        """assign: field -> SQL over the row before (increments are `x + 1`). Rows must be granted before and after."""
        model = self.catalog.model(name)
        df, chosen = flagged(self.catalog.rows(name), self._scoped(name, condition), model, self.catalog, "_u")
        df = self._checked(df.withColumn("_hit", chosen), name, "update", F.col("_hit"))
        after = df.withColumns({f: F.when(F.col("_hit"), F.expr(v) if isinstance(v, str) else v).otherwise(F.col(f"`{f}`")).cast(model.fields[f]) for f, v in assign.items()})
        after = self._checked(after, name, "update", F.col("_hit"))
        return Change(after.select(*[f"`{f}`" for f in model.fields]), self._facts(after.filter("_hit"), name, "updated"))

    def delete_many(self, name: str, condition: Condition) -> Change:
        model = self.catalog.model(name)
        df, chosen = flagged(self.catalog.rows(name), self._scoped(name, condition), model, self.catalog, "_u")
        df = self._checked(df.withColumn("_hit", chosen), name, "delete", F.col("_hit"))
        return Change(df.filter("not _hit").select(*[f"`{f}`" for f in model.fields]), self._facts(df.filter("_hit"), name, "deleted"))

    def upsert_many(self, name: str, rows: DataFrame, **assign: str) -> Change:
        """New keys are created as they are; known ones are updated by `assign`, where `new.` is the given row."""
        model = self.catalog.model(name)
        before, may = flagged(self.catalog.rows(name), self._condition(name, "update"), model, self.catalog, "_o") if self.policies else (self.catalog.rows(name), F.lit(True))
        old, new = before.select(*[f"`{c}`" for c in model.fields], may.alias("_may")).alias("old"), rows.alias("new")
        both = old.join(new, [F.col(f"old.{k}") == F.col(f"new.{k}") for k in model.key], "full")
        known, given = F.col(f"old.{model.key[0]}").isNotNull(), F.col(f"new.{model.key[0]}").isNotNull()
        fields = [F.when(known & given, F.expr(assign.get(f, f"old.{f}"))).when(known, F.col(f"old.{f}")).otherwise(F.col(f"new.{f}")).cast(kind).alias(f) for f, kind in model.fields.items()]
        after = both.select(*fields, (known & given).alias("_up"), (~known).alias("_new"), F.coalesce("_may", F.lit(True)).alias("_may"))
        after = self._sure(after, after.columns, name, ~F.col("_up") | F.col("_may"), f"update {name} is denied") if self.policies else after
        after = self._checked(self._checked(after.drop("_may"), name, "create", F.col("_new")), name, "update", F.col("_up"))
        facts = self._facts(after.filter("_up or _new"), name, F.when(F.col("_new"), "created").otherwise("updated"))
        return Change(after.drop("_up", "_new"), facts)

    def _scoped(self, name: str, condition: Condition) -> Condition:
        return expand(condition, self.catalog.model(name), self.catalog, self.policies)

    def preimage(self, name: str, condition: Condition) -> DataFrame:
        model = self.catalog.model(name)
        return where(self.catalog.rows(name), self._scoped(name, condition), model, self.catalog)
