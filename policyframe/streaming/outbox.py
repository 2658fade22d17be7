"""An outbox as a table: facts wait, are claimed under a lease, sent, and acknowledged, retried or blocked.

Each step is a function from frames to frames, so it runs on batches, or in foreachBatch on a stream. Delivery is at least once:
what was sent but not acknowledged before its lease ended is claimed again; receivers tell repeats by event_id.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WAITING, CLAIMED, DELIVERED, BLOCKED = "waiting", "claimed", "delivered", "blocked"


@dataclass(frozen=True)
class Retry:
    """After the n-th failure the wait is first_s * 2**(n - 1), at most longest_s, less up to a half by a hash of the event."""

    first_s: int = 5
    longest_s: int = 3600
    attempts: int = 8


def event_id(source: str, *parts: Column | str) -> Column:
    """The same for the same change whenever it is read again. Each part goes in with its length, so that parts cannot run
    into each other; null is told from empty."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    sized = [F.coalesce(F.concat(F.char_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat_ws("|", F.lit(source), *sized), 256)


def from_changes(changes: DataFrame, source: str, *, position: str, key: list[str], op: str) -> DataFrame:
    """Rows of a change log (op: c, u or d; position grows) as facts. Rows that repeat a position and key give one fact."""
    action = F.when(F.col(op) == "c", "created").when(F.col(op) == "u", "updated").when(F.col(op) == "d", "deleted")
    facts = changes.select(
        event_id(source, position, *key, op).alias("event_id"),
        F.coalesce(action, F.raise_error(F.concat(F.lit("unknown change "), F.coalesce(F.col(op), F.lit("null"))))).alias("action"),
        F.to_json(F.struct(*key)).alias("identity"),
        F.col(position).alias("position"),
    )
    return facts if facts.isStreaming else facts.dropDuplicates(["event_id"])


def waiting(facts: DataFrame, at: Column) -> DataFrame:
    """Facts as new rows of the outbox. They need event_id, causation and ordinal."""
    return facts.withColumns({"state": F.lit(WAITING), "attempts": F.lit(0), "due": at, "owner": F.lit(None).cast("string")})


def claim(outbox: DataFrame, owner: str, now: Column, lease_s: int, most: int | None = None) -> DataFrame:
    """The outbox with the rows that `owner` may send now. Facts of one causation are sent in order: only the first of them that is not
    delivered can be claimed, and none behind a blocked one. With `most`, the longest due causations are taken."""
    # Delivered rows take no part: what is open is sorted alone, and the first ones come back by their ids.
    open_ = outbox.filter(F.col("state") != DELIVERED)
    first = open_.groupBy("causation").agg(F.min(F.struct("ordinal", "event_id", "state", "due")).alias("f")).select("f.*")
    ready = first.filter((F.col("state") != BLOCKED) & (F.col("due") <= now))
    if most is not None:
        ready = ready.orderBy("due", "event_id").limit(most)
    out = outbox.join(ready.select(F.col("event_id").alias("_id")), outbox["event_id"] == F.col("_id"), "left").withColumn("_ready", F.col("_id").isNotNull()).drop("_id")
    taken = {"state": F.lit(CLAIMED), "owner": F.lit(owner), "due": now + F.make_dt_interval(secs=F.lit(lease_s))}
    return out.withColumns({c: F.when(F.col("_ready"), v).otherwise(F.col(c)) for c, v in taken.items()}).drop("_ready")


def settle(outbox: DataFrame, results: DataFrame, owner: str, now: Column, retry: Retry = Retry()) -> DataFrame:
    """The outbox after `results` (event_id, sent). Only rows that `owner` still holds change; a lease that was lost counts for
    nothing. Of several results for one event, a failure wins."""
    told = results.groupBy(F.col("event_id").alias("_id")).agg(F.min("sent").alias("_sent"))
    out = outbox.join(told, outbox["event_id"] == told["_id"], "left")
    mine = (F.col("state") == CLAIMED) & (F.col("owner") == owner) & F.col("_sent").isNotNull()
    n = F.col("attempts") + 1
    wait = F.least(F.lit(float(retry.longest_s)), retry.first_s * F.pow(F.lit(2.0), n - 1))
    wait *= 1 - F.pmod(F.xxhash64("event_id", n), F.lit(1000)) / 2000
    state = F.when(F.col("_sent"), DELIVERED).when(n >= retry.attempts, BLOCKED).otherwise(WAITING)
    due = F.when(F.col("_sent") | (n >= retry.attempts), now).otherwise(now + F.make_dt_interval(secs=wait))
    new = {"state": state, "attempts": n, "due": due, "owner": F.lit(None).cast("string")}
    return out.select(*[F.when(mine, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(f"`{c}`") for c in outbox.columns])


def retained(outbox: DataFrame, now: Column, keep_s: int, most: int | None = None) -> DataFrame:
    """Without what was delivered more than keep_s seconds ago; with `most`, the oldest so many of these go."""
    old = (F.col("state") == DELIVERED) & (F.col("due") < now - F.make_dt_interval(secs=F.lit(keep_s)))
    if most is None:
        return outbox.filter(~F.coalesce(old, F.lit(False)))
    return outbox.join(outbox.filter(old).orderBy("due", "event_id").limit(most).select("event_id"), "event_id", "left_anti").select(*outbox.columns)


def decoded(facts: DataFrame, codecs: dict[int, tuple[str, dict[str, str]]], *, version: str = "fact_version", payload: str = "payload") -> DataFrame:
    """`body`, a struct in the newest form, from JSON of any known version. codecs: version -> (schema, field -> SQL over the
    old body `old`). Of unknown versions or text that is no JSON the body is null; the row stays."""
    newest = max(codecs)
    fields = list(codecs[newest][1])
    body = F.lit(None)
    for v, (schema, upgrade) in sorted(codecs.items()):
        if list(upgrade) != fields:
            raise ValueError(f"version {v} does not give {fields}")
        facts = facts.withColumn("old", F.from_json(payload, schema))
        made = F.struct(*[F.expr(e).alias(f) for f, e in upgrade.items()])
        facts = facts.withColumn(f"_v{v}", F.when((F.col(version) == v) & F.col(payload).isNotNull() & F.try_parse_json(payload).isNotNull(), made))
    body = F.coalesce(*[F.col(f"_v{v}") for v in codecs])
    return facts.withColumn("body", body).drop("old", *[f"_v{v}" for v in codecs])


def deliver(stream: DataFrame, send: Callable[[DataFrame], None], checkpoint: str, **trigger):
    """Starts sending a stream of facts, a batch at a time and each batch in order; the checkpoint repeats a batch that failed."""

    def batch(df: DataFrame, number: int) -> None:
        send(df.dropDuplicates(["event_id"]).sortWithinPartitions(*[c for c in ("causation", "ordinal") if c in df.columns] or ["event_id"]))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()
