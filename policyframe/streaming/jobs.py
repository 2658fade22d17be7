"""A durable queue of jobs as a table: each step is a function from frames to frames, run in batches or in foreachBatch.

Jobs run at least once: one whose lease ends before its outcome is told may be claimed again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WAITING, RUNNING, DONE, FAILED, CANCELLED = "waiting", "running", "done", "failed", "cancelled"
OPEN = (WAITING, RUNNING)


@dataclass(frozen=True)
class Backoff:
    """The n-th attempt waits up to first_s * 2**(n - 1), at most longest_s: a part of it that a hash of job and attempt gives."""

    first_s: float = 1.0
    longest_s: float = 3600.0
    attempts: int = 10


def enqueued(jobs: DataFrame, new: DataFrame, at: Column) -> DataFrame:
    """jobs with the rows of `new` (job_id, payload, dedupe, exclusive, delay_s): one whose id is known, or whose dedupe key an
    open or an earlier new job has, is left out. Of one exclusive key only one job runs at a time."""
    made = new.select(
        "job_id", "payload", "dedupe", "exclusive", F.lit(WAITING).alias("state"), F.lit(0).alias("attempts"),
        (at + F.make_dt_interval(secs=F.coalesce("delay_s", F.lit(0)))).alias("due"), F.lit(None).cast("string").alias("owner"), F.lit(None).cast("string").alias("code"), at.alias("changed"),
    )
    same = Window.partitionBy("job_id").orderBy(F.asc_nulls_last("dedupe"), F.asc_nulls_last("exclusive"), "due", "payload")
    first = Window.partitionBy(F.coalesce("dedupe", F.concat(F.lit("\0"), "job_id"))).orderBy("job_id")
    for window in (same, first):
        made = made.withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n")
    made = made.join(jobs.select("job_id"), "job_id", "left_anti")
    held = jobs.filter(F.col("state").isin(*OPEN) & F.col("dedupe").isNotNull()).select("dedupe").distinct()
    return jobs.unionByName(made.join(held, "dedupe", "left_anti").select(*jobs.columns))


def claimed(jobs: DataFrame, owner: str, now: Column, lease_s: int, most: int) -> DataFrame:
    """jobs, of which the `most` longest due that may run are `owner`'s for lease_s seconds: waiting ones, and running ones whose
    lease has ended (which go first), but one at most of an exclusive key, and none of a key that another job holds."""
    open_ = jobs.filter(F.col("state").isin(*OPEN)).select("job_id", "exclusive", "state", "due")
    holds = open_.filter((F.col("state") == RUNNING) & (F.col("due") > now) & F.col("exclusive").isNotNull()).select("exclusive").distinct()
    ready = open_.filter(F.col("due") <= now).join(holds, "exclusive", "left_anti")
    free = ready.filter("exclusive is null").select("due", "job_id")
    one = ready.filter("exclusive is not null").groupBy("exclusive").agg(F.min(F.struct(F.col("state") != RUNNING, "due", "job_id")).alias("f")).select("f.due", "f.job_id")
    chosen = free.union(one).orderBy("due", "job_id").limit(most).select(F.col("job_id").alias("_id"))
    out = jobs.join(chosen, jobs["job_id"] == F.col("_id"), "left")
    mine = F.col("_id").isNotNull()
    new = {"state": F.lit(RUNNING), "owner": F.lit(owner), "due": now + F.make_dt_interval(secs=F.lit(lease_s)), "attempts": F.col("attempts") + 1, "changed": now}
    return _changed(out, jobs.columns, mine, new)


def renewed(jobs: DataFrame, owner: str, now: Column, lease_s: int) -> DataFrame:
    """Leases of `owner` that still hold, from now on."""
    mine = (F.col("state") == RUNNING) & (F.col("owner") == owner) & (F.col("due") > now)
    return _changed(jobs, jobs.columns, mine, {"due": now + F.make_dt_interval(secs=F.lit(lease_s))})


def settled(jobs: DataFrame, outcomes: DataFrame, owner: str, now: Column, backoff: Backoff = Backoff()) -> DataFrame:
    """outcomes: (job_id, outcome, code, delay_s) with outcome done, failed or retry; a retry waits delay_s, or by the backoff, and
    fails after the last attempt. Only jobs that `owner` holds change; of several outcomes for a job the least by name counts."""
    told = outcomes.groupBy(F.col("job_id").alias("_id")).agg(F.min(F.struct("outcome", "code", "delay_s")).alias("_o"))
    out = jobs.join(told, jobs["job_id"] == F.col("_id"), "left")
    mine = (F.col("state") == RUNNING) & (F.col("owner") == owner) & F.col("_o").isNotNull()
    n = F.col("attempts")
    again = (F.col("_o.outcome") == "retry") & (n < backoff.attempts)
    window = F.least(F.lit(backoff.longest_s), backoff.first_s * F.pow(F.lit(2.0), n - 1))
    wait = F.coalesce(F.col("_o.delay_s").cast("double"), window * F.pmod(F.xxhash64("job_id", n), F.lit(1 << 20)) / (1 << 20))
    state = F.when(again, WAITING).when(F.col("_o.outcome") == "done", DONE).otherwise(FAILED)
    new = {"state": state, "due": F.when(again, now + F.make_dt_interval(secs=wait)).otherwise(now), "owner": F.lit(None).cast("string"), "code": F.col("_o.code"), "changed": now}
    return _changed(out, jobs.columns, mine, new)


def cancelled(jobs: DataFrame, which: Column, now: Column) -> DataFrame:
    """Open jobs that `which` chooses never run again."""
    return _changed(jobs, jobs.columns, F.col("state").isin(*OPEN) & which, {"state": F.lit(CANCELLED), "owner": F.lit(None).cast("string"), "changed": now})


def requeued(jobs: DataFrame, which: Column, now: Column) -> DataFrame:
    """Failed or cancelled jobs that `which` chooses begin anew."""
    new = {"state": F.lit(WAITING), "attempts": F.lit(0), "due": now, "code": F.lit(None).cast("string"), "changed": now}
    return _changed(jobs, jobs.columns, F.col("state").isin(FAILED, CANCELLED) & which, new)


def retained(jobs: DataFrame, now: Column, keep_s: int) -> DataFrame:
    """Without what ended more than keep_s seconds ago."""
    return jobs.filter(F.col("state").isin(*OPEN) | (F.col("changed") >= now - F.make_dt_interval(secs=F.lit(keep_s))))


def _changed(df: DataFrame, own: list[str], mine: Column, new: dict[str, Column]) -> DataFrame:
    return df.select(*[F.when(F.coalesce(mine, F.lit(False)), new[c]).otherwise(F.col(f"`{c}`")).cast(df.schema[c].dataType).alias(c) if c in new else F.col(f"`{c}`") for c in own])
