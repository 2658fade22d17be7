"""Change feeds: facts of created, updated and deleted rows, shown to a subscriber as the policy allows now."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policyframe.operators.filters import where
from policyframe.operators.reads import Reader
from policyframe.plans.policy import visible_rows
from policyframe.plans.predicate import ALL, Condition

#: event_id, action, identity (the key's value), snapshot columns `old_<field>` of deleted rows, at.
ACTIONS = ("created", "updated", "deleted")


def deduplicated(facts: DataFrame, within: str | None = None) -> DataFrame:
    """Facts once each by event_id; on a stream, `within` bounds the state by the watermark on `at`."""
    if facts.isStreaming:
        return facts.withWatermark("at", within or "1 hour").dropDuplicatesWithinWatermark(["event_id"])
    return facts.dropDuplicates(["event_id"])


def change_feed(facts: DataFrame, reader: Reader, name: str, condition: Condition = ALL, snapshot: dict[str, str] | None = None) -> DataFrame:
    """Facts that the subscriber gets. Created and updated rows are read again under the policy and the condition as they
    are now; absent ones are left out. Deleted ones are left out if there is a condition, else the policy is put to the
    snapshot (field -> column of facts). Works on batches and, row by row, on streams (a join with static rows)."""
    model = reader.catalog.model(name)
    (key,) = model.key
    keys = reader.filtered(name, condition).select(F.col(f"`{key}`").alias("_key"))
    alive = facts.filter(F.col("action").isin("created", "updated"))
    out = alive.join(keys, alive["identity"] == keys["_key"], "left_semi")
    if condition != ALL or snapshot is None:
        return out
    gone = facts.filter("action = 'deleted'")
    own = gone.columns
    rows = gone.withColumns({f: F.col(f"`{c}`") for f, c in snapshot.items()})
    shown = where(rows, visible_rows(model, reader.catalog, reader.policies), model, reader.catalog)
    return out.unionByName(shown.select(*[f"`{c}`" for c in own]))
