"""Column helpers whose semantics Spark's own operators don't have."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two numbers this close are the same value.
TOLERANCE = 1e-14


def same_value(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    """Whether two numbers are the same value: both null, equal (infinities too), or within the tolerance. Never null."""
    return a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= F.lit(tolerance), F.lit(False))


def same_text(a: Column, b: Column) -> Column:
    """Whether two strings are the same, nulls being equal."""
    return a.eqNullSafe(b)


def no_nan(a: Column) -> Column:
    """a with NaN made null; Spark holds NaN equal to itself and above infinity."""
    return F.when(~F.isnan(a), a)


def at(moment: datetime | str) -> Column:
    """A moment as TIMESTAMP_NTZ; an aware one as UTC."""
    if isinstance(moment, datetime):
        from datetime import timezone

        if moment.tzinfo:
            moment = moment.astimezone(timezone.utc).replace(tzinfo=None)
        moment = moment.isoformat(sep=" ")
    return F.lit(moment).cast("timestamp_ntz")


def between(column: Column, start: datetime | str | None = None, end: datetime | str | None = None) -> Column:
    """start <= column <= end, an absent bound being open."""
    out = F.lit(True)
    if start is not None:
        out = out & (column >= at(start))
    if end is not None:
        out = out & (column <= at(end))
    return out


def overlaps(left: Column, right: Column, start: datetime | str | None = None, end: datetime | str | None = None) -> Column:
    """Whether the closed interval [left, right] meets [start, end]. Null intervals meet everything only if no bound is given."""
    out = F.lit(True)
    if start is not None:
        out = out & (right >= at(start))
    if end is not None:
        out = out & (left <= at(end))
    return out


def count_upto(values: Column, value: Column) -> Column:
    """How many elements of a sorted array are at most a value, by bisection."""
    n = F.size(values)

    def halve(s: Column, _: Column) -> Column:
        lo, hi = s["lo"], s["hi"]
        mid = F.shiftright(lo + hi, 1)
        up = F.get(values, mid) <= value
        return F.when(lo >= hi, s).when(up, F.struct((mid + 1).alias("lo"), hi.alias("hi"))).otherwise(F.struct(lo.alias("lo"), mid.alias("hi")))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(n + F.lit(1))).cast("int"))
    return F.when(n == 0, 0).otherwise(F.reduce(steps, F.struct(F.lit(0).alias("lo"), n.alias("hi")), halve)["lo"])


def bisect(values: Column, value: Column) -> Column:
    """Index j with values[j] <= value < values[j + 1] in a sorted array; -1 before the first, the size after the last value."""
    return F.when(value > F.element_at(values, -1), F.size(values)).otherwise(count_upto(values, value) - 1)
