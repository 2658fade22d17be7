"""One key, copy or passage in a third of all rows: no task reads it as a whole. Figures are Spark's own task metrics."""

import uuid

import pytest
from pyspark.sql import functions as F

from policyframe.llm import pack, shared, simhash, substrings, urls
from policyframe.llm.components import components

ROWS, SETTINGS = 30_000, {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.skewJoin.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}


@pytest.fixture
def spread(spark):
    old = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def largest(spark, run) -> int:
    """Most records that a task of what `run` starts has read from a shuffle."""
    store = spark.sparkContext._jsc.sc().statusStore()
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    run()
    tracker, most = spark.sparkContext.statusTracker(), 0
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    for job in tracker.getJobIdsForGroup(group):
        for stage in tracker.getJobInfo(job).stageIds:
            tasks = store.taskList(stage, 0, 1_000_000)
            for k in range(tasks.size()):
                metrics = tasks.apply(k).taskMetrics()
                if metrics.isDefined():
                    most = max(most, metrics.get().shuffleReadMetrics().recordsRead())
    spark.sparkContext._jsc.clearJobGroup()
    return most


def run_of(df):
    return lambda: df.write.format("noop").mode("overwrite").save()


def test_the_measure_sees_a_hot_key(spread):
    rows = spread.range(ROWS).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    one = rows.groupBy("k").agg(F.count("*").alias("times"))
    assert largest(spread, run_of(rows.join(one, "k"))) >= ROWS // 3
    assert largest(spread, run_of(shared.joined(rows, one, "k", ROWS))) < ROWS // 6


def test_a_star(spread):
    star = spread.range(1, ROWS).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") - F.col("id") % 3).alias("a"), F.col("id").alias("b"))
    assert largest(spread, lambda: run_of(components(star))()) < ROWS // 3


def _documents(spread, third):
    own = F.concat_ws(" ", *[F.concat(F.lit(f"{c}"), F.xxhash64("id", F.lit(c)).cast("string")) for c in "abcdefghijklmnopqrstuvwxyz"])
    return spread.range(ROWS // 10).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, third).otherwise(own).alias("text")).repartition(8)


def test_exact_copies(spread):
    spread.conf.set("spark.sql.shuffle.partitions", "96")  # tiles of other texts are dealt finely enough to tell
    docs = shared.cut(_documents(spread, F.lit("the same text in a third of all documents")), "docs")
    assert largest(spread, lambda: run_of(simhash.near_duplicates(docs))()) < ROWS // 30


def test_a_passage(spread):
    passage = F.concat(F.lit(" ".join(f"p{k}" for k in range(60)) + " end"), F.col("id").cast("string"))
    docs = shared.cut(_documents(spread, passage), "docs")
    # Rows of one passage are one a batch; what else is read is dealt by documents.
    assert largest(spread, lambda: run_of(substrings.remove_repeats(docs))()) < ROWS // 30


def test_pieces_that_are_alike(spread):
    docs = spread.range(ROWS // 5).select(F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("text")).repartition(4)
    assert largest(spread, lambda: run_of(pack.pack(docs))()) < ROWS // 15


def test_a_host_and_a_top_level_domain(spread):
    host = F.when(F.col("id") % 3 == 0, "hot.org").otherwise(F.concat(F.lit("h"), "id", F.lit(".org")))
    captures = spread.range(ROWS).select(F.concat(F.lit("http://"), host, F.lit("/p/"), "id").alias("url"), F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(CAST(id % 50 AS int))").alias("fetched_at"))
    captures = shared.cut(captures.repartition(8), "captures")
    day = F.lit("2024-01-10").cast("timestamp")
    events = spread.createDataFrame([("org", "a"), ("hot.org", "b"), ("h7.org", "c")], "pattern string, category string").select("pattern", "category", F.lit("add").alias("action"), day.alias("effective_at"))
    assert largest(spread, lambda: run_of(urls.filter_urls(captures, events))()) < ROWS // 6
