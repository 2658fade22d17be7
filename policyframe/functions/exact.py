"""Exact sums and averages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


INTEGERS = ("smallint", "int", "bigint", "short", "integer", "long")


def exact_sum(c: Column, kind: str) -> Column:
    """Integers sum to 38 digits, decimals at their own scale; beyond that Spark raises, and never rounds."""
    if kind in INTEGERS:
        return F.sum(c.cast("decimal(20,0)")).cast("decimal(38,0)")
    return F.sum(c)


def avg_parts(c: Column, kind: str) -> tuple[Column, Column]:
    """A sum and a count, which add up over parts; decimals are summed in units of their last place."""
    if not kind.startswith("decimal"):
        return F.sum(c.cast("double")), F.count(c)
    return F.sum((c * F.lit(10 ** _scale(kind))).cast("decimal(28,0)")).cast("decimal(38,0)"), F.count(c)


def avg_of(units: Column, n: Column, kind: str) -> Column:
    """The average from its parts, rounded once."""
    if not kind.startswith("decimal"):
        return units / F.nullif(n, F.lit(0))
    units, n = units.cast("decimal(38,0)"), n.cast("decimal(18,0)")
    x = (F.abs(units) * 2 + n).cast("decimal(38,0)")
    twice = F.nullif(n * 2, F.lit(0))
    # div would give a bigint: the remainder is taken off instead, and the quotient is exact.
    whole = ((x - x % twice) / twice).cast("decimal(38,0)")
    return (F.signum(units).cast("decimal(1,0)") * whole / F.lit(10 ** _scale(kind))).cast(f"decimal(38,{_scale(kind)})")


def exact_avg(c: Column, kind: str) -> Column:
    """Of decimals, to their own scale, half away from zero, rounded once; of other numbers, as doubles."""
    return avg_of(*avg_parts(c, kind), kind) if kind.startswith("decimal") else F.avg(c.cast("double"))


def _scale(kind: str) -> int:
    return int(kind.rstrip(")").split(",")[1])
