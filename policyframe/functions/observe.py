"""Closed observations of reads and writes: what ran, on which models, how long, how many rows, and how it ended.

They hold no values and no texts of errors, which could tell what a caller may not see. Rows are counted while the query
runs, by Spark's own observation, not by a second job.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

KINDS = ("find", "count", "aggregate", "group", "scoped", "search", "write", "publish", "job", "migration")


@dataclass(frozen=True)
class Observed:
    kind: str
    models: tuple[str, ...]
    seconds: float
    rows: int | None
    outcome: str


class Observer:
    """Hands observations to sinks; a sink that raises is left out from then on, and never fails a query."""

    def __init__(self, *sinks: Callable[[dict[str, Any]], None]):
        self.sinks = list(sinks)

    def run(self, kind: str, models: tuple[str, ...], df: DataFrame, action: Callable[[DataFrame], Any]) -> Any:
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind}")
        seen = Observation()
        watched = df.observe(seen, F.count(F.lit(1)).alias("rows"))
        began = time.perf_counter()
        try:
            out = action(watched)
        except Exception as e:
            self._tell(Observed(kind, models, time.perf_counter() - began, None, type(e).__name__))
            raise
        self._tell(Observed(kind, models, time.perf_counter() - began, seen.get.get("rows"), "done"))
        return out

    def _tell(self, what: Observed) -> None:
        for sink in list(self.sinks):
            try:
                sink(asdict(what))
            except Exception:  # noqa: BLE001 - a sink is no part of the query
                self.sinks.remove(sink)
