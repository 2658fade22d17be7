"""Units of work: several writes staged one on another, nested writes, referential actions, versions, hooks, one commit.

Nothing is stored before `commit`: each write replaces the staged frame of its model, and later writes and policies see it.
A denial, a conflict or a restriction fails the commit when its frames run, and then no reader sees any of it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policyframe.operators.filters import flagged, where
from policyframe.operators.mutations import Writer
from policyframe.plans.catalog import Catalog, Relation
from policyframe.plans.policy import Policies, expand, visible_rows
from policyframe.plans.predicate import ALL, And, Condition, Field, normalize

RESTRICT, CASCADE, SET_NULL, SET_DEFAULT, NO_ACTION = "restrict", "cascade", "set_null", "set_default", "no_action"


class NotFound(Exception):
    """A parent of a nested write that is not there, or not shown."""


class Staged(Catalog):
    """A catalog in which the frames of written models stand for their tables."""

    def __init__(self, under: Catalog):
        super().__init__(under.spark, list(under.models.values()), under._load)
        self._under, self.frames = under, {}

    def rows(self, name: str, given: Condition = ALL) -> DataFrame:
        return self.frames[name] if name in self.frames else self._under.rows(name, given)


@dataclass(frozen=True)
class OnDelete:
    """What becomes of rows of `model` when the target of their to-one `relation` goes."""

    model: str
    relation: str
    action: str = RESTRICT
    default: dict[str, str] = field(default_factory=dict)


@dataclass
class Hooks:
    """before(model, action, rows) gives the rows to write, or raises; after(model, action, facts) looks on while the unit
    is built; committed(facts) runs once all is stored."""

    before: Callable[[str, str, DataFrame], DataFrame] | None = None
    after: Callable[[str, str, DataFrame], None] | None = None
    committed: Callable[[DataFrame], None] | None = None


class Unit(Writer):
    def __init__(self, catalog: Catalog, policies: Policies | None = None, *, on_delete: tuple[OnDelete, ...] = (), hooks: Hooks | None = None, versions: dict[str, str] | None = None):
        """versions: model -> the field that counts a row's writes."""
        super().__init__(Staged(catalog), policies)
        self.on_delete, self.hooks, self.versions = on_delete, hooks or Hooks(), versions or {}
        self._facts_so_far: list[DataFrame] = []

    # --- writes ---------------------------------------------------------------------------------------------------

    def create(self, name: str, rows: DataFrame) -> None:
        model = self.catalog.model(name)
        rows = self.hooks.before(name, "create", rows) if self.hooks.before else rows
        version = self.versions.get(name)
        given = {f: F.col(f"`{f}`") if f in rows.columns else F.lit(1 if f == version else None) for f in model.fields}
        rows = rows.select(*[c.cast(model.fields[f]).alias(f) for f, c in given.items()])
        rows = self._checked(rows, name, "create", F.lit(True))
        self._stage(name, self.catalog.rows(name).unionByName(rows), "create", self._facts(rows, name, "created"))

    def update(self, name: str, condition: Condition, *, expected: int | None = None, most: int | None = None, **assign: str | Column) -> None:
        """expected: the version that every chosen row must have, else the unit fails with a conflict. most: more chosen rows
        are refused; this counts them."""
        self._update(name, self._marked(name, condition), assign, expected, most)

    def delete(self, name: str, condition: Condition, *, expected: int | None = None, most: int | None = None) -> None:
        self._delete(name, self._marked(name, condition), expected, most, ())

    def upsert(self, name: str, rows: DataFrame, **assign: str) -> None:
        """New keys are created, known ones updated by `assign`, where `new.` is the given row; see upsert_many."""
        rows = self.hooks.before(name, "upsert", rows) if self.hooks.before else rows
        version = self.versions.get(name)
        change = self.upsert_many(name, rows, **({version: f"old.{version} + 1"} if version else {}) | assign)
        self._stage(name, change.after, "upsert", change.facts)

    def _marked(self, name: str, condition: Condition) -> DataFrame:
        """All rows, with `_hit` for those that the policy shows and the condition chooses."""
        model = self.catalog.model(name)
        chosen = And((visible_rows(model, self.catalog, self.policies), expand(condition, model, self.catalog, self.policies)))
        df, hit = flagged(self.catalog.rows(name), normalize(chosen), model, self.catalog, "_u")
        return df.select(*[f"`{f}`" for f in model.fields], hit.alias("_hit"))

    def _guarded(self, name: str, df: DataFrame, expected: int | None, most: int | None) -> DataFrame:
        if most is not None and df.filter("_hit").limit(most + 1).count() > most:
            raise ValueError(f"more than {most} rows of {name}")
        if expected is None:
            return df
        if name not in self.versions:
            raise ValueError(f"{name} has no version")
        fresh = ~F.col("_hit") | F.coalesce(F.col(f"`{self.versions[name]}`") == expected, F.lit(False))
        return self._sure(df, df.columns, name, fresh, f"conflict: {name} has another version")

    def _update(self, name: str, marked: DataFrame, assign: dict[str, str | Column], expected: int | None = None, most: int | None = None) -> None:
        model, version = self.catalog.model(name), self.versions.get(name)
        unknown = [f for f in assign if f not in model.fields]
        if unknown:
            raise ValueError(f"{name} has no {unknown}")
        if version and version not in assign:
            assign = assign | {version: f"`{version}` + 1"}
        df = self._checked(self._guarded(name, marked, expected, most), name, "update", F.col("_hit"))
        made = {f: F.when(F.col("_hit"), F.expr(v) if isinstance(v, str) else v).otherwise(F.col(f"`{f}`")).cast(model.fields[f]) for f, v in assign.items()}
        # Values before stay beside those after, for rules on single fields.
        df = df.withColumns({f"_old_{f}": F.col(f"`{f}`") for f in assign}).withColumns(made)
        df = self._checked(self._field_rules(df, name, list(assign)), name, "update", F.col("_hit"))
        rows = df.select(*[f"`{f}`" for f in model.fields], "_hit")
        if self.hooks.before:
            hit = self.hooks.before(name, "update", rows.filter("_hit").drop("_hit"))
            rows = rows.filter("not _hit").unionByName(self._checked(hit.withColumn("_hit", F.lit(True)), name, "update", F.lit(True)))
        self._stage(name, rows.drop("_hit"), "update", self._facts(rows.filter("_hit"), name, "updated"))

    def _field_rules(self, df: DataFrame, name: str, fields: list[str]) -> DataFrame:
        """A field may change only where the rules for updates of it hold, judged on the row after."""
        if self.policies is None:
            return df
        model, own = self.catalog.model(name), df.columns
        for i, f in enumerate(fields):
            c = normalize(expand(self.policies.field(name, f, "update"), model, self.catalog, self.policies))
            if c == ALL or f == self.versions.get(name):
                continue
            df, may = flagged(df, c, model, self.catalog, f"_f{i}_")
            changed = F.col("_hit") & ~F.col(f"`{f}`").eqNullSafe(F.col(f"`_old_{f}`"))
            df = self._sure(df, own, name, ~changed | may, f"update {name}.{f} is denied")
        return df

    def _delete(self, name: str, marked: DataFrame, expected: int | None, most: int | None, under: tuple[str, ...]) -> None:
        if name in under:
            raise ValueError(f"deletes of {' -> '.join((*under, name))} lead back to themselves")
        model = self.catalog.model(name)
        df = self._checked(self._guarded(name, marked, expected, most), name, "delete", F.col("_hit"))
        if self.hooks.before:
            self.hooks.before(name, "delete", df.filter("_hit").drop("_hit"))
        gone = df.filter("_hit")
        for rule in self.on_delete:
            relation = self.catalog.model(rule.model).relation(rule.relation)
            if relation.target != name or rule.action == NO_ACTION:
                continue
            if relation.many:
                raise ValueError(f"{rule.model}.{rule.relation} leads to many")
            if rule.action == RESTRICT:
                df = self._restricted(df, rule, relation)
                continue
            children = self._children(rule.model, relation, gone)
            if rule.action == CASCADE:
                self._delete(rule.model, children, None, None, (*under, name))
            else:
                self._update(rule.model, children, {own: rule.default.get(own, "null") if rule.action == SET_DEFAULT else "null" for own, _ in relation.pairs})
        facts = self._facts(gone, name, "deleted")
        self._stage(name, df.filter("not _hit").select(*[f"`{f}`" for f in model.fields]), "delete", facts)

    def _children(self, name: str, relation: Relation, gone: DataFrame) -> DataFrame:
        rows = self.catalog.rows(name)
        keys = gone.select(*[F.col(f"`{theirs}`").alias(f"_g{i}") for i, (_, theirs) in enumerate(relation.pairs)]).distinct().withColumn("_gone", F.lit(True))
        joined = rows.join(keys, [rows[f"`{own}`"] == keys[f"_g{i}"] for i, (own, _) in enumerate(relation.pairs)], "left")
        return joined.select(*[rows[f"`{c}`"] for c in rows.columns], F.coalesce("_gone", F.lit(False)).alias("_hit"))

    def _restricted(self, df: DataFrame, rule: OnDelete, relation: Relation) -> DataFrame:
        keys = self.catalog.rows(rule.model).select(*[F.col(f"`{own}`").alias(f"_g{i}") for i, (own, _) in enumerate(relation.pairs)]).distinct().withColumn("_used", F.lit(True))
        own = df.columns
        df = df.join(keys, [df[f"`{theirs}`"] == keys[f"_g{i}"] for i, (_, theirs) in enumerate(relation.pairs)], "left")
        free = ~F.col("_hit") | F.col("_used").isNull()
        return self._sure(df, own, relation.target, free, f"{rule.model} still refers to it")

    def _stage(self, name: str, after: DataFrame, action: str, facts: DataFrame) -> None:
        facts = facts.withColumn("ordinal", F.lit(len(self._facts_so_far)))
        if self.hooks.after:
            self.hooks.after(name, action, facts)
        self._facts_so_far.append(facts)
        self.catalog.frames[name] = after

    # --- nested writes ----------------------------------------------------------------------------------------------

    def nested(self, name: str, key: dict, relation: str) -> Nested:
        """Writes among the targets of one row's to-many relation. The row must be shown."""
        model = self.catalog.model(name)
        r = model.relation(relation)
        if set(key) != set(model.key):
            raise ValueError(f"{name} is told by {model.key}")
        if not r.many:
            raise ValueError(f"{relation} leads to one: update its own columns")
        chosen = And(tuple(Field(k).eq(v) for k, v in key.items()))
        row = where(self.scope(name), chosen, model, self.catalog).select(*[f"`{own}`" for own, _ in r.pairs]).first()
        if row is None:
            raise NotFound(f"{name} {key}")
        return Nested(self, r, {theirs: row[own] for own, theirs in r.pairs})

    # --- the end ----------------------------------------------------------------------------------------------------

    def rows(self, name: str) -> DataFrame:
        return self.catalog.rows(name)

    def facts(self) -> DataFrame:
        """Of all writes so far; `ordinal` tells their order."""
        if not self._facts_so_far:
            return self.catalog.spark.createDataFrame([], "model string, action string, identity string, ordinal int")
        out = self._facts_so_far[0]
        for more in self._facts_so_far[1:]:
            out = out.unionByName(more)
        return out

    def commit(self, folder: str, version: str, base: str | None = None) -> str:
        """Writes each staged model and the facts under folder/version, and last the mark by which `committed` knows it. A
        version that failed has no mark; a version with a mark is never written again. base: the version that the unit read;
        of units that read the same one, the first to finish takes its place and the others fail with a conflict."""
        spark, to = self.catalog.spark, f"{folder}/{version}"
        if committed(spark, folder, version):
            raise ValueError(f"{to} is committed")
        for name, df in self.catalog.frames.items():
            df.write.mode("overwrite").parquet(f"{to}/{self.catalog.model(name).table}.parquet")
        self.facts().write.mode("overwrite").parquet(f"{to}/_facts.parquet")
        if base is not None and not _created(spark, f"{folder}/{base}/_SUCCESSOR"):
            raise ValueError(f"conflict: another unit has followed {base}")
        _created(spark, f"{to}/_COMMITTED")
        if self.hooks.committed:
            self.hooks.committed(spark.read.parquet(f"{to}/_facts.parquet"))
        return to


def _created(spark, name: str) -> bool:
    """Makes an empty file, which only one of several callers can."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    try:
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, False).close()
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" not in str(e.java_exception.getClass().getName()):
            raise
        return False


def committed(spark, folder: str, version: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{version}/_COMMITTED")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


class Nested:
    def __init__(self, unit: Unit, relation: Relation, link: dict):
        self.unit, self.child, self.link = unit, relation.target, link

    def _linked(self) -> Column:
        out = F.lit(True)
        for c, v in self.link.items():
            out = out & F.coalesce(F.col(f"`{c}`") == F.lit(v), F.lit(False))
        return out

    def _mark(self, condition: Condition, linked: bool = True) -> DataFrame:
        df = self.unit._marked(self.child, condition)
        return df.withColumn("_hit", F.col("_hit") & self._linked()) if linked else df

    def _to(self) -> dict[str, Column]:
        return {c: F.lit(v) for c, v in self.link.items()}

    def create(self, rows: DataFrame) -> Nested:
        self.unit.create(self.child, rows.withColumns(self._to()))
        return self

    def connect(self, condition: Condition) -> Nested:
        self.unit._update(self.child, self._mark(condition, linked=False), self._to())
        return self

    def connect_or_create(self, rows: DataFrame) -> Nested:
        """Rows of known keys are linked and stay as they are but for that; the others are created."""
        self.unit.upsert(self.child, rows.withColumns(self._to()), **{c: f"new.{c}" for c in self.link})
        return self

    def disconnect(self, condition: Condition = ALL) -> Nested:
        self.unit._update(self.child, self._mark(condition), {c: "null" for c in self.link})
        return self

    def set(self, condition: Condition) -> Nested:
        """Those that the condition chooses, and no others, are linked."""
        chosen = self.unit._marked(self.child, condition)
        self.unit._update(self.child, chosen.withColumn("_hit", ~F.col("_hit") & self._linked()), {c: "null" for c in self.link})
        return self.connect(condition)

    def update(self, condition: Condition, **assign: str | Column) -> Nested:
        self.unit._update(self.child, self._mark(condition), assign)
        return self

    def upsert(self, rows: DataFrame, **assign: str) -> Nested:
        """New keys are created with the link. Known rows are updated if they are linked; else the unit fails."""
        rows = rows.withColumns(self._to())
        stays = " and ".join(f"old.`{c}` <=> new.`{c}`" for c in self.link)
        first = next(iter(self.link))
        guard = f"CASE WHEN {stays} THEN old.`{first}` ELSE raise_error('the row belongs to another parent') END"
        self.unit.upsert(self.child, rows, **assign | {first: guard})
        return self

    def delete(self, condition: Condition = ALL) -> Nested:
        self.unit._delete(self.child, self._mark(condition), None, None, ())
        return self
