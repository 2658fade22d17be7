"""Subscribers to a change feed: equal ones are evaluated once, and one that cannot keep up is closed, never cut short.

Facts come by a transport: one in memory, for a process and for tests, or a broker that Spark reads and writes as a stream.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from policyframe.operators.reads import Reader
from policyframe.plans.predicate import ALL, Condition, normalize
from policyframe.streaming.changes import change_feed, deduplicated

#: Events that wait for one subscriber, and in the whole hub.
QUEUE, HUB = 64, 256


class Closed(Exception):
    """The subscriber fell behind, or the hub ended; what was queued before is still there to be read."""


@dataclass
class Subscription:
    """principal: who asks, with the reader that holds their policy; equal principals have equal policies."""

    principal: str
    reader: Reader
    model: str
    condition: Condition = ALL
    select: tuple[str, ...] = ("event_id", "action", "identity")
    snapshot: dict[str, str] | None = None
    most: int = QUEUE
    queue: deque = field(default_factory=deque)
    reason: str | None = None

    def key(self) -> tuple:
        return self.principal, self.model, repr(normalize(self.condition)), self.select, json.dumps(self.snapshot, sort_keys=True)

    def next(self) -> Any:
        if self.queue:
            return self.queue.popleft()
        if self.reason:
            raise Closed(self.reason)
        return None


class Hub:
    def __init__(self, most: int = HUB):
        self.most, self.members = most, []

    def subscribe(self, subscription: Subscription) -> Subscription:
        self.members.append(subscription)
        return subscription

    def groups(self) -> dict[tuple, list[Subscription]]:
        """Open members that one evaluation serves."""
        out: dict[tuple, list[Subscription]] = {}
        for s in self.members:
            if s.reason is None:
                out.setdefault(s.key(), []).append(s)
        return out

    def publish(self, facts: DataFrame, order_by: tuple[str, ...] = ("at", "event_id")) -> int:
        """Evaluates a batch of facts once a group, for all its members; returns how many evaluations that took. No more rows
        come to the driver than the hub may hold, and one."""
        facts, evaluated = deduplicated(facts), 0
        for members in self.groups().values():
            s = members[0]
            evaluated += 1
            feed = change_feed(facts, s.reader, s.model, s.condition, s.snapshot).orderBy(*order_by).select(*s.select)
            rows = feed.limit(self.most + 1).collect()
            for m in members:
                room = min(m.most - len(m.queue), self.most - sum(len(o.queue) for o in self.members))
                if len(rows) > room:
                    m.reason = f"{len(rows)} events for room of {room}"
                else:
                    m.queue.extend(rows)
        return evaluated

    def attach(self, stream: DataFrame, checkpoint: str, **trigger: Any) -> Any:
        """Publishes each batch of a stream of facts."""
        return stream.writeStream.foreachBatch(lambda df, _: self.publish(df)).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


class MemoryTransport:
    """Facts from publishers to listeners of one process, in order; a listener that raises gets the batch again on `redeliver`."""

    def __init__(self) -> None:
        self.listeners: list[Callable[[DataFrame], None]] = []
        self.failed: list[tuple[Callable[[DataFrame], None], DataFrame]] = []

    def listen(self, listener: Callable[[DataFrame], None]) -> None:
        self.listeners.append(listener)

    def publish(self, facts: DataFrame) -> None:
        for listener in self.listeners:
            self._give(listener, facts)

    def _give(self, listener: Callable[[DataFrame], None], facts: DataFrame) -> None:
        try:
            listener(facts)
        except Exception:  # noqa: BLE001 - kept for redelivery
            self.failed.append((listener, facts))

    def redeliver(self) -> int:
        """Tries what failed once more; returns how much still fails."""
        again, self.failed = self.failed, []
        for listener, facts in again:
            self._give(listener, facts)
        return len(self.failed)


@dataclass(frozen=True)
class Broker:
    """A topic of a broker that Spark has a source and a sink for (kafka by default; its package is the session's to load)."""

    topic: str
    servers: str
    kind: str = "kafka"
    options: dict[str, str] = field(default_factory=dict)

    def messages(self, facts: DataFrame, key: str = "causation") -> DataFrame:
        """(key, value): facts of one causation go to one partition, and so stay in order."""
        return facts.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))

    def facts(self, messages: DataFrame, schema: str) -> DataFrame:
        return messages.select(F.from_json(F.col("value").cast("string"), schema).alias("f")).select("f.*")

    def read(self, spark: SparkSession, schema: str) -> DataFrame:
        source = spark.readStream.format(self.kind).option("kafka.bootstrap.servers", self.servers).option("subscribe", self.topic)
        return self.facts(source.options(**self.options).load(), schema)

    def write(self, facts: DataFrame, checkpoint: str) -> Any:
        sink = self.messages(facts).writeStream.format(self.kind).option("kafka.bootstrap.servers", self.servers).option("topic", self.topic)
        return sink.options(**self.options).option("checkpointLocation", checkpoint).start()
