"""The calendar of a block staircase: revision dates and the starts of the blocks they serve.

Days, weeks, months, years and replaced fields are wall-clock arithmetic in the time zone of revisions;
hours, minutes and seconds are elapsed time. Business days skip week-ends only.
"""

from __future__ import annotations

from datetime import datetime, timezone

import pandas as pd

SHIFTS = {"years", "months", "weeks", "bdays", "days", "hours", "minutes", "seconds"}
FIELDS = {"year", "month", "day", "weekday", "hour", "minute", "second"}


class BlockStaircaseRevisionError(ValueError):
    """The starts of successive blocks don't increase."""


def shift_offset(spec: dict[str, int] | None) -> pd.DateOffset | None:
    """A displacement such as {'days': 1}; None for an empty one."""
    if spec is None or spec == {}:
        return None
    if not isinstance(spec, dict):
        raise TypeError(f"an offset is a dict, not {type(spec).__name__}")
    if bad := sorted(set(spec) - SHIFTS):
        raise ValueError(f"unknown keys of an offset: {bad}")
    if "bdays" in spec:
        if len(spec) > 1:
            raise ValueError("bdays can't be combined with other keys")
        return pd.offsets.BusinessDay(int(spec["bdays"]))
    return pd.DateOffset(**{k: int(v) for k, v in spec.items()})


def replace_offset(spec: dict[str, int] | None, weekday: bool = True) -> pd.DateOffset | None:
    """A replacement of fields such as {'hour': 9}; None for an empty one."""
    if spec is None or spec == {}:
        return None
    if not isinstance(spec, dict):
        raise TypeError(f"a time is a dict, not {type(spec).__name__}")
    if bad := sorted(set(spec) - FIELDS):
        raise ValueError(f"unknown keys of a time: {bad}")
    if not weekday and "weekday" in spec:
        raise ValueError("weekday isn't allowed in maturity_time")
    return pd.DateOffset(**{k: int(v) for k, v in spec.items()})


def _plus(t: pd.Timestamp, offset: pd.DateOffset | None, sign: int = 1) -> pd.Timestamp:
    if offset is None:
        return t
    return t + offset if sign > 0 else t - offset


def _utc(t: pd.Timestamp) -> datetime:
    return (t.tz_convert("UTC").tz_localize(None) if t.tzinfo else t).to_pydatetime()


def schedule(
    start: datetime,
    end: datetime,
    tzaware: bool = True,
    revision_freq: dict[str, int] | None = None,
    revision_time: dict[str, int] | None = None,
    revision_tz: str = "UTC",
    maturity_offset: dict[str, int] | None = None,
    maturity_time: dict[str, int] | None = None,
) -> list[tuple[int, datetime, datetime]]:
    """(n, revision date in UTC, start of the block) for the blocks that reach [start, end].

    Block starts are in UTC, for naive series in the wall time of revision_tz. Bounds are UTC, or wall
    time for naive series.
    """
    freq = shift_offset({"days": 1} if revision_freq is None else revision_freq)
    at_time = replace_offset({"hour": 0} if revision_time is None else revision_time)
    late = shift_offset(maturity_offset)
    at_maturity = replace_offset(maturity_time, weekday=False)
    if freq is None:
        raise ValueError("revision_freq is empty")

    def aware(t: datetime) -> pd.Timestamp:
        ts = pd.Timestamp(t)
        if not tzaware:
            return ts.tz_localize(None) if ts.tzinfo else ts
        return ts.tz_convert("UTC") if ts.tzinfo else ts.tz_localize("UTC")

    def block(r: pd.Timestamp) -> pd.Timestamp:
        b = _plus(_plus(r, late), at_maturity)
        return b if tzaware else b.tz_localize(None)

    lo, hi = aware(start), aware(end)
    r = lo.tz_convert(revision_tz) if tzaware else lo.tz_localize(revision_tz)
    r = _plus(_plus(_plus(r, at_maturity), late, -1), at_time)
    while block(r) > lo:
        back = r - freq
        if block(back) >= block(r):
            raise BlockStaircaseRevisionError("the revision frequency doesn't move the block back")
        r = back
    out, n = [], 0
    while block(r) <= hi:
        b = block(r)
        out.append((n, _utc(r), _utc(b)))
        after = r + freq
        if block(after) <= b:
            raise BlockStaircaseRevisionError("the revision frequency doesn't move the block on")
        r, n = after, n + 1
    return out


def utcnow() -> datetime:
    """Now, as naive UTC."""
    return datetime.now(timezone.utc).replace(tzinfo=None)
