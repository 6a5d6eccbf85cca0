"""Reads of the change log as plans over DataFrames, for any number of series at once.

The log has a row for each point that a revision changed:

    series_id  rev  insertion_date  value_date  op  num  txt

op is set (a value), erase (a value was erased: shown as null on demand) or drop (a replacement left the
point out: never shown). Revisions of a series have rising insertion dates. The state at a revision is the
last row of each point up to it, so that every read is a filter, one aggregation and a filter.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import at, between, count_upto, same_text, same_value

LOG = "series_id bigint, rev bigint, insertion_date timestamp_ntz, value_date timestamp_ntz, op string, num double, txt string"
#: Revisions of a part of a series.
REVS = 4096
REVISIONS = "series_id bigint, rev bigint, insertion_date timestamp_ntz, author string, metadata string, ts_start timestamp_ntz, ts_end timestamp_ntz"
POINT = ["series_id", "value_date"]


def _payload() -> Column:
    return F.struct("op", "num", "txt")


def _latest(log: DataFrame) -> DataFrame:
    """The last row of each point: one shuffle, with partial aggregation before it."""
    last = log.groupBy(*POINT).agg(F.max_by(_payload(), "rev").alias("p"))
    return last.select(*POINT, "p.op", "p.num", "p.txt")


def _shown(state: DataFrame, keep_nans: bool) -> DataFrame:
    ops = ["set", "erase"] if keep_nans else ["set"]
    return state.where(F.col("op").isin(ops)).drop("op")


def state_asof(log: DataFrame, revision_date: datetime | str | None = None, start: datetime | str | None = None, end: datetime | str | None = None, keep_nans: bool = False) -> DataFrame:
    """(series_id, value_date, num, txt): what was known at a revision date, within inclusive value bounds.

    Both filters reach the scan of the log.
    """
    rows = log.where(between(F.col("value_date"), start, end))
    if revision_date is not None:
        rows = rows.where(F.col("insertion_date") <= at(revision_date))
    return _shown(_latest(rows), keep_nans)


def validity(log: DataFrame) -> DataFrame:
    """The log with next_rev and next_date: each row holds for revisions from rev to before next_rev."""
    w = Window.partitionBy(*POINT).orderBy("rev")
    return log.withColumn("next_rev", F.lead("rev").over(w)).withColumn("next_date", F.lead("insertion_date").over(w))


def select_revisions(revisions: DataFrame, from_insertion: datetime | str | None = None, to_insertion: datetime | str | None = None, start: datetime | str | None = None, end: datetime | str | None = None, where: Column | None = None) -> DataFrame:
    """The revisions within inclusive insertion bounds whose state's interval meets the value bounds."""
    out = revisions.where(between(F.col("insertion_date"), from_insertion, to_insertion))
    if start is not None:
        out = out.where(F.col("ts_end") >= at(start))
    if end is not None:
        out = out.where(F.col("ts_start") <= at(end))
    return out if where is None else out.where(where)


def insertion_dates(revisions: DataFrame, **bounds: datetime | str | None) -> DataFrame:
    """(series_id, rev, insertion_date) of select_revisions()."""
    return select_revisions(revisions, **bounds).select("series_id", "rev", "insertion_date")


def history(log: DataFrame, revisions: DataFrame, from_insertion: datetime | str | None = None, to_insertion: datetime | str | None = None, start: datetime | str | None = None, end: datetime | str | None = None, keep_nans: bool = False) -> DataFrame:
    """(series_id, rev, insertion_date, value_date, num, txt): the whole state at each selected revision.

    Rows of the log are joined to the revisions they are valid for, an equality on the series and a range.
    With value bounds, states equal to the previous one are left out.
    """
    chosen = select_revisions(revisions, from_insertion, to_insertion, start, end).select(F.col("series_id").alias("s"), F.col("rev").alias("r"), F.col("insertion_date").alias("d"))
    rows = log.where(between(F.col("value_date"), start, end))
    if to_insertion is not None:
        rows = rows.where(F.col("insertion_date") <= at(to_insertion))
    held = validity(rows).drop("insertion_date")
    on = (F.col("series_id") == F.col("s")) & (F.col("r") >= F.col("rev")) & (F.col("next_rev").isNull() | (F.col("r") < F.col("next_rev")))
    states = held.join(chosen, on).select("series_id", F.col("r").alias("rev"), F.col("d").alias("insertion_date"), "value_date", "op", "num", "txt")
    out = _shown(states, keep_nans)
    return out if start is None and end is None else pruned_history(out)


def pruned_history(states: DataFrame) -> DataFrame:
    """states without those that are equal to the state of the revision before."""
    # the number of points and 128 bits that don't depend on their order: no row holds a state
    digests = [F.bit_xor(F.xxhash64(F.lit(k), "value_date", "num", "txt")) for k in range(2)]
    signature = states.groupBy("series_id", "rev").agg(F.count("*").alias("n"), *(x.alias(f"d{k}") for k, x in enumerate(digests))).select("series_id", "rev", F.struct("n", "d0", "d1").alias("sig"))
    w = Window.partitionBy("series_id").orderBy("rev")
    kept = signature.withColumn("before", F.lag("sig").over(w)).where(~F.col("sig").eqNullSafe(F.col("before"))).select("series_id", "rev")
    return states.join(kept, ["series_id", "rev"], "left_semi")


def history_diff(log: DataFrame, revisions: DataFrame, from_insertion: datetime | str | None = None, to_insertion: datetime | str | None = None, start: datetime | str | None = None, end: datetime | str | None = None, include_drops: bool = False) -> DataFrame:
    """(series_id, rev, insertion_date, value_date, op, num, txt): what changed from each selected revision to the next.

    The first selected revision is compared with the one before it. Points that a replacement left out
    aren't changes unless include_drops is set.
    """
    rows = log.where(between(F.col("value_date"), start, end))
    chosen = select_revisions(revisions, from_insertion, to_insertion, start, end).select(F.col("series_id").alias("s"), F.col("rev").alias("r"), F.col("insertion_date").alias("d"))
    w = Window.partitionBy("s").orderBy("r")
    first = F.lag("r").over(w)
    before = revisions.groupBy("series_id", "rev").agg(F.first("insertion_date").alias("i")).withColumn("prev", F.lag("rev").over(Window.partitionBy("series_id").orderBy("rev")))
    prev = before.select(F.col("series_id").alias("s"), F.col("rev").alias("r"), "prev")
    chosen = chosen.withColumn("lag", first).join(prev, ["s", "r"]).withColumn("lo", F.coalesce("lag", "prev", F.lit(-1)))
    # a change belongs to the next selected revision; one after which none is selected, or that the first one's predecessor had, to none
    held = Window.partitionBy(*POINT).orderBy("rev")
    point = rows.withColumn("was", F.lag(_payload()).over(held)).select("series_id", "rev", F.struct("value_date", _payload().alias("p"), "was").alias("x"), F.lit(None).cast("struct<r:bigint,d:timestamp_ntz,lo:bigint>").alias("c"))
    marks = chosen.select(F.col("s").alias("series_id"), F.col("r").alias("rev"), F.lit(None).cast(point.schema["x"].dataType).alias("x"), F.struct("r", "d", "lo").alias("c"))
    both = point.unionByName(marks).withColumn("part", F.expr(f"rev div {REVS}"))
    # within a part of a series one pass from its end, so that a long series is several tasks; else the first of a later part
    back = Window.partitionBy("series_id", "part").orderBy(F.desc("rev"), F.col("c").isNull())
    parts = both.groupBy("series_id", "part").agg(F.min("c").alias("c"))
    later = Window.partitionBy("series_id").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    later = parts.select("series_id", "part", F.last("c", ignorenulls=True).over(later).alias("after"))
    near = both.withColumn("c", F.last("c", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))).where("x IS NOT NULL")
    near = near.join(later, ["series_id", "part"]).withColumn("c", F.coalesce("c", "after")).where("c IS NOT NULL AND rev > c.lo")
    pairs = near.groupBy("series_id", F.col("x.value_date").alias("value_date"), F.col("c.r").alias("r"), F.col("c.d").alias("d")).agg(F.max_by("x.p", "rev").alias("p"), F.min_by("x.was", "rev").alias("was"))
    shown = lambda p, c: F.when(F.col(f"{p}.op") == "set", F.col(f"{p}.{c}"))
    changed = ~(same_value(shown("p", "num"), shown("was", "num")) & same_text(shown("p", "txt"), shown("was", "txt")))
    out = pairs.where(changed).select("series_id", F.col("r").alias("rev"), F.col("d").alias("insertion_date"), "value_date", "p.op", "p.num", "p.txt")
    return out if include_drops else out.where("op <> 'drop'")


def staircase(log: DataFrame, delta: timedelta, start: datetime | str | None = None, end: datetime | str | None = None) -> DataFrame:
    """(series_id, value_date, num, txt): for each point of the latest state, its value as known delta before its date.

    One pass over the log; a null as of then hides older values.
    """
    rows = log.where(between(F.col("value_date"), start, end))
    lag = F.make_dt_interval(secs=F.lit(delta.total_seconds()).cast("decimal(18,6)"))
    in_time = F.col("insertion_date") <= F.col("value_date") - lag
    both = rows.groupBy(*POINT).agg(F.max_by("op", "rev").alias("now"), F.max_by(F.when(in_time, _payload()), F.when(in_time, F.col("rev"))).alias("p"))
    return both.where("now <> 'drop' AND p.op = 'set'").select(*POINT, "p.num", "p.txt")


def block_staircase(log: DataFrame, schedule: Sequence[tuple[int, datetime, datetime]], start: datetime | str | None = None, end: datetime | str | None = None) -> DataFrame:
    """(series_id, value_date, num, txt): each point as known at the last scheduled revision whose block has begun and that has a value.

    schedule: (n, revision date, start of the block), both dates rising, as functions.schedule makes it; it is
    as long as the time range, not as the data. Each row finds the blocks that it serves by bisection.
    """
    held = validity(log.where(between(F.col("value_date"), start, end))).where("op = 'set'")
    if not schedule:
        return held.select(*POINT, "num", "txt").limit(0)
    dates, starts = (F.array(*map(at, x)) for x in list(zip(*schedule))[1:])
    # the last block that begins in time, and before the value is replaced
    upto = F.least(count_upto(starts, F.col("value_date")), F.when(F.col("next_date").isNull(), len(schedule)).otherwise(count_upto(dates, F.col("next_date") - F.expr("INTERVAL '0.000001' SECOND"))))
    since = count_upto(dates, F.col("insertion_date") - F.expr("INTERVAL '0.000001' SECOND"))
    hits = held.withColumn("upto", upto).where((F.col("upto") > 0) & (F.col("upto") > since))
    best = hits.groupBy(*POINT).agg(F.max_by(F.struct("num", "txt"), "upto").alias("p")).select(*POINT, "p.num", "p.txt")
    alive = _latest(log.where(between(F.col("value_date"), start, end))).where("op <> 'drop'").select("series_id").distinct()
    return best.join(alive, "series_id", "left_semi")


def interval(log: DataFrame) -> DataFrame:
    """(series_id, ts_start, ts_end): first and last value date of the current state."""
    return _latest(log).where("op = 'set'").groupBy("series_id").agg(F.min("value_date").alias("ts_start"), F.max("value_date").alias("ts_end"))


def revision_log(revisions: DataFrame, limit: int | None = None, start: datetime | str | None = None, end: datetime | str | None = None, authors: Sequence[str] | None = None) -> DataFrame:
    """The latest `limit` revisions of each series within inclusive insertion bounds."""
    out = revisions.where(between(F.col("insertion_date"), start, end))
    if authors is not None:
        out = out.where(F.col("author").isin(list(authors)))
    if limit is not None:
        w = Window.partitionBy("series_id").orderBy(F.desc("rev"))
        out = out.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= limit).drop("nth")
    return out


def first_last_insertion(revisions: DataFrame) -> DataFrame:
    """(series_id, first_date, last_date, last_rev)."""
    return revisions.groupBy("series_id").agg(F.min("insertion_date").alias("first_date"), F.max("insertion_date").alias("last_date"), F.max("rev").alias("last_rev"))


def revision_at(revisions: DataFrame, moment: datetime | str, mode: str = "strict") -> DataFrame:
    """(series_id, rev): the earliest revision at (strict), up to (before) or from (after) a moment.

    Mode before gives the earliest one too, not the nearest: that is what the operation has always meant.
    """
    column, m = F.col("insertion_date"), at(moment)
    tests = {"strict": column == m, "before": column <= m, "after": column >= m}
    if mode not in tests:
        raise ValueError(f"unknown mode {mode!r}")
    return revisions.where(tests[mode]).groupBy("series_id").agg(F.min("rev").alias("rev"))


def previous_revision(revisions: DataFrame, rev: int) -> DataFrame:
    """(series_id, rev): the greatest revision below rev."""
    return revisions.where(F.col("rev") < rev).groupBy("series_id").agg(F.max("rev").alias("rev"))


def strip(log: DataFrame, revisions: DataFrame, moment: datetime | str) -> tuple[DataFrame, DataFrame]:
    """Log and revisions without the first revision of each series at or after a moment and all later ones."""
    cut = revisions.where(F.col("insertion_date") >= at(moment)).groupBy("series_id").agg(F.min("rev").alias("cut"))

    def keep(df: DataFrame) -> DataFrame:
        return df.join(cut, "series_id", "left").where("cut IS NULL OR rev < cut").drop("cut")

    return keep(log), keep(revisions)


def diff(base: DataFrame, other: DataFrame) -> DataFrame:
    """(series_id, value_date, num, txt) of the points of other that change base; a null erases.

    A series without any value in base takes all points of other, nulls too. Points of base alone are
    never reported.
    """
    known = base.where("num IS NOT NULL OR txt IS NOT NULL").select(*POINT, F.col("num").alias("b_num"), F.col("txt").alias("b_txt"), F.lit(True).alias("there"))
    has = known.select("series_id").distinct().withColumn("has", F.lit(True))
    both = other.join(known, POINT, "left").join(has, "series_id", "left")
    null = F.col("num").isNull() & F.col("txt").isNull()
    same = same_value(F.col("num"), F.col("b_num")) & same_text(F.col("txt"), F.col("b_txt"))
    changed = F.when(F.col("has").isNull(), True).when(F.col("there"), ~same).otherwise(~null)
    return both.where(changed).select(*POINT, "num", "txt")


def patchmany(layers: Sequence[DataFrame]) -> DataFrame:
    """(series_id, value_date, num, txt): the union of the layers' points; the last layer that has a point wins, its nulls too."""
    tagged = [x.select(*POINT, "num", "txt", F.lit(i).alias("layer")) for i, x in enumerate(layers)]
    out = tagged[0]
    for x in tagged[1:]:
        out = out.unionByName(x)
    return out.groupBy(*POINT).agg(F.max_by(F.struct("num", "txt"), "layer").alias("p")).select(*POINT, "p.num", "p.txt")


def patch(base: DataFrame, changes: DataFrame) -> DataFrame:
    """patchmany() of two."""
    return patchmany([base, changes])


def trimmed(points: DataFrame) -> DataFrame:
    """points without leading and trailing nulls of each series, as a first insertion stores them; all-null series have none."""
    ends = points.where("num IS NOT NULL OR txt IS NOT NULL").groupBy("series_id").agg(F.min("value_date").alias("lo"), F.max("value_date").alias("hi"))
    return points.join(ends, "series_id").where("value_date BETWEEN lo AND hi").drop("lo", "hi")


def replacement(state: DataFrame, points: DataFrame) -> DataFrame:
    """Log rows (series_id, value_date, op, num, txt) that turn a state (nulls kept) into the points: sets, and drops of the others.

    Series whose points equal their state exactly get no rows.
    """
    new = points.where("num IS NOT NULL OR txt IS NOT NULL").select(*POINT, F.col("num").alias("n_num"), F.col("txt").alias("n_txt"), F.lit(True).alias("new"))
    both = state.select(*POINT, "num", "txt", F.lit(True).alias("old")).join(new, POINT, "full")
    same = F.col("num").eqNullSafe(F.col("n_num")) & F.col("txt").eqNullSafe(F.col("n_txt"))
    wanted = new.select("series_id").distinct()
    out = both.join(wanted, "series_id", "left_semi")
    gone = F.col("new").isNull()
    changed = gone | F.col("old").isNull() | ~same
    return out.where(changed).select(*POINT, F.when(gone, "drop").otherwise("set").alias("op"), F.col("n_num").alias("num"), F.col("n_txt").alias("txt"))


def replicate(origin: DataFrame, target: DataFrame) -> DataFrame:
    """The log rows of origin that are later than the last of the same series in target, erasures and drops included."""
    last = target.groupBy("series_id").agg(F.max("insertion_date").alias("last"))
    return origin.join(last, "series_id", "left").where("last IS NULL OR insertion_date > last").drop("last")
