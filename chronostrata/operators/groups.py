"""Groups: series that share revisions, long by (member, value date) and wide at the edge only."""

from __future__ import annotations

from collections.abc import Collection, Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import bitemporal as B

#: Members up to which the list of them is broadcast.
MEMBERS = 1_000_000


def melt(wide: DataFrame, members: Sequence[str], date_col: str = "value_date") -> DataFrame:
    """(member, value_date, num) of a wide frame, nulls included."""
    return wide.unpivot([date_col], list(members), "member", "num").select("member", F.col(date_col).alias("value_date"), F.col("num").cast("double").alias("num"))


def widen(long: DataFrame, members: Sequence[str], keys: Sequence[str] = ("value_date",), texts: Collection[str] = ()) -> DataFrame:
    """A column for each member, in the given order; the list spares a pass over the data. texts: members whose values are texts."""
    if not texts:
        return long.groupBy(*keys).pivot("member", list(members)).agg(F.first("num"))
    wide = long.groupBy(*keys).pivot("member", list(members)).agg(F.first(F.struct("num", "txt")))
    cell = lambda m: wide["`" + m.replace("`", "``") + "`"]["txt" if m in texts else "num"]
    return wide.select(*keys, *(cell(m).alias(m) for m in members))


def _hint(mapping: DataFrame, members: Sequence[str]) -> DataFrame:
    """mapping, broadcast if its members are few enough."""
    return F.broadcast(mapping) if len(members) <= MEMBERS else mapping


def check_columns(columns: Sequence[str], members: Sequence[str]) -> None:
    """The columns of a later update must be the group's members."""
    double = sorted({c for c in columns if list(columns).count(c) > 1})
    if double:
        raise ValueError(f"group update has columns twice: {double}")
    if excess := sorted(set(columns) - set(members)):
        raise ValueError(f"group update has excess columns: {excess}")
    if missing := sorted(set(members) - set(columns)):
        raise ValueError(f"group update lacks columns: {missing}")


def group_get(log: DataFrame, mapping: DataFrame, members: Sequence[str], revision_date: datetime | str | None = None, start: datetime | str | None = None, end: datetime | str | None = None, keep_nans: bool = False, texts: Collection[str] = ()) -> DataFrame:
    """The wide state of a group. mapping: (series_id, member), a row for each member."""
    state = B.state_asof(log.join(_hint(mapping.select("series_id"), members), "series_id", "left_semi"), revision_date, start, end, keep_nans)
    return widen(state.join(_hint(mapping, members), "series_id"), members, texts=texts)


def group_insertion_dates(revisions: DataFrame, mapping: DataFrame, from_insertion: datetime | str | None = None, to_insertion: datetime | str | None = None) -> DataFrame:
    """(insertion_date): the distinct ones of all members."""
    mine = revisions.join(mapping.select("series_id"), "series_id", "left_semi")
    return B.select_revisions(mine, from_insertion, to_insertion).select("insertion_date").distinct()


def group_history(log: DataFrame, revisions: DataFrame, mapping: DataFrame, members: Sequence[str], from_insertion: datetime | str | None = None, to_insertion: datetime | str | None = None, start: datetime | str | None = None, end: datetime | str | None = None, texts: Collection[str] = ()) -> DataFrame:
    """The wide state at each insertion date of the group; a member that has no revision then is as it was.

    Dates and the rows that hold then meet by equal ranges of time, as many as there are dates, so that a row
    is joined with about as many as it gives states.
    """
    dates = group_insertion_dates(revisions, mapping, from_insertion, to_insertion).select(F.unix_micros(F.col("insertion_date").cast("timestamp")).alias("t"), F.col("insertion_date").alias("at"))
    lo, hi, n = dates.agg(F.min("t"), F.max("t"), F.count("*")).first()
    lo, hi = lo or 0, hi or 0
    width = max(1, -(-(hi - lo + 1) // max(1, n)))
    mine = log.join(_hint(mapping, members), "series_id").where(B.between(F.col("value_date"), start, end))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    held = B.validity(mine).where("op = 'set'").withColumns({"since": F.greatest(micros("insertion_date"), F.lit(lo)), "until": F.least(F.coalesce(micros("next_date") - 1, F.lit(hi)), F.lit(hi))}).where("since <= until")
    cell = lambda c: F.expr(f"({c} - {lo}L) div {width}L")
    spread = held.withColumn("cell", F.explode(F.sequence(cell("since"), cell("until"))))
    states = spread.join(dates.withColumn("cell", cell("t")), "cell").where("t BETWEEN since AND until").select(F.col("at").alias("insertion_date"), "value_date", "member", "num", "txt")
    return widen(states, members, ("insertion_date", "value_date"), texts)
