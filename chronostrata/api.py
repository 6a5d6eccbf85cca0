"""The time-series object: one store to write to, and secondary stores to read from.

Series come and go as pandas objects; bulk methods take and give DataFrames. Unknown names give None (get,
history, staircases, groups), [] (log, insertion dates), an error (interval) or False (exists); a known
series of which nothing is visible gives an empty series, and {} as history.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta, timezone
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import schedule as calendar
from .operators import groups as G
from .operators import search as S
from .plans import bitemporal as B
from .sources.store import Store

POINTS = "series_id bigint, value_date timestamp_ntz, num double, txt string"


class Descriptor(str):
    """A series' name with its metadata, source and kind."""

    def __new__(cls, name: str, imeta: dict, meta: dict, source: str = "local", kind: str = "primary") -> "Descriptor":
        out = super().__new__(cls, name)
        out.imeta, out.meta, out.source, out.kind = imeta, meta, source, kind
        return out


def utc(moment: datetime | None, default: datetime | None = None) -> datetime | None:
    """A moment as naive UTC; a naive one is UTC."""
    if moment is None:
        return default
    if not isinstance(moment, datetime):
        raise TypeError(f"{moment!r} is not a datetime")
    return moment.astimezone(timezone.utc).replace(tzinfo=None) if moment.tzinfo else moment


def checked(series: pd.Series) -> tuple[pd.Series, bool, str]:
    """The series sorted, in UTC and as float or text; whether it is aware; its value type."""
    if not isinstance(series, pd.Series):
        raise AssertionError("not a series")
    if not isinstance(series.index, pd.DatetimeIndex):
        raise AssertionError("the index is not a DatetimeIndex")
    if series.index.duplicated().any():
        raise AssertionError("the index has duplicates")
    if series.index.hasnans:
        raise AssertionError("the index has NaT")
    aware = series.index.tz is not None
    if aware:
        series = series.tz_convert("UTC")
    if len(series) and (series.index.as_unit("ns").asi8 % 1000).any():
        raise ValueError("the index is finer than a microsecond")
    if pd.api.types.is_bool_dtype(series.dtype):
        raise ValueError("values are booleans")
    kind = "float64" if pd.api.types.is_numeric_dtype(series.dtype) else "object"
    return (series.astype("float64") if kind == "float64" else series).sort_index(), aware, kind


def _internal(entry: dict[str, Any]) -> dict[str, Any]:
    """What the store knows of a series."""
    aware, kind = entry["tzaware"], entry["value_type"]
    return {"tzaware": aware, "tablename": str(entry["id"]), "index_type": "datetime64[ns, UTC]" if aware else "datetime64[ns]", "index_dtype": "<M8[ns]", "value_type": kind, "value_dtype": {"float64": "<f8", "object": "|O"}[kind], **entry.get("imeta", {})}


def _name(name: str) -> str:
    """A name that a series or group may have, without white space around it."""
    if not isinstance(name, str) or not name.strip():
        raise ValueError("a name is a text that isn't blank")
    return name.strip()


class TimeSeries:
    """Reads and writes of one namespace, with read-only secondaries in order of precedence."""

    def __init__(self, spark: SparkSession, root: str, namespace: str = "tsh", secondaries: dict[str, "TimeSeries"] | None = None) -> None:
        self.spark, self.store = spark, Store(spark, root, namespace)
        self.secondaries = secondaries or {}

    # helpers

    def _entry(self, name: str) -> dict[str, Any] | None:
        return self.store.state().series.get(name)

    def _elsewhere(self, name: str) -> "TimeSeries | None":
        return next((s for s in self.secondaries.values() if s.exists(name)), None)

    def _forbid(self, name: str, what: str) -> None:
        if not self._entry(name) and self._elsewhere(name):
            raise ValueError(f"not allowed to {what} a series of a secondary source: {name}")

    def _read(self, name: str, otherwise: Any, local: Callable[[dict[str, Any]], Any], method: str, *args: Any, **kwargs: Any) -> Any:
        if entry := self._entry(name):
            return local(entry)
        if other := self._elsewhere(name):
            return getattr(other, method)(name, *args, **kwargs)
        return otherwise

    def _log(self, entry: dict[str, Any]) -> DataFrame:
        return self.store.log().where(F.col("series_id") == entry["id"])

    def _revs(self, entry: dict[str, Any]) -> DataFrame:
        return self.store.revisions().where(F.col("series_id") == entry["id"])

    def _bound(self, entry: dict[str, Any], moment: datetime | None) -> datetime | None:
        """A value bound in the series' own time: UTC, or wall clock whose zone is dropped."""
        if moment is None:
            return None
        if not isinstance(moment, datetime):
            raise TypeError(f"{moment!r} is not a datetime")
        return utc(moment) if entry["tzaware"] else moment.replace(tzinfo=None)

    @staticmethod
    def _series(rows: pd.DataFrame, name: str, entry: dict[str, Any]) -> pd.Series:
        rows = rows.sort_values("value_date")
        index = pd.DatetimeIndex(rows["value_date"]).rename(None).as_unit("ns")
        if entry["tzaware"]:
            index = index.tz_localize("UTC")
        values = rows["num" if entry["value_type"] == "float64" else "txt"].to_numpy()
        return pd.Series(values, index=index, name=name, dtype="float64" if entry["value_type"] == "float64" else "object")

    def _frame(self, i: int, series: pd.Series, kind: str) -> DataFrame:
        dates = series.index.tz_localize(None) if series.index.tz is not None else series.index
        null = pd.isna(series).to_numpy()
        values = series.to_numpy()
        table = pa.table({
            "series_id": pa.array([i] * len(series), pa.int64()),
            "value_date": pa.array(dates.as_unit("us"), pa.timestamp("us")),
            "num": pa.array(values, pa.float64(), mask=null) if kind == "float64" else pa.nulls(len(series), pa.float64()),
            "txt": pa.nulls(len(series), pa.string()) if kind == "float64" else pa.array([None if n else v for n, v in zip(null, values)], pa.string()),
        })
        return self.spark.createDataFrame(table, POINTS)

    def _known(self, name: str) -> dict[str, Any]:
        """The entry of a series here; ValueError if there is none."""
        if not (entry := self._entry(name)):
            raise ValueError(f"no series {name!r}")
        return entry

    # writes

    def _write(self, name: str, series: pd.Series, author: str, metadata: dict | None, insertion_date: datetime | None, replace: bool) -> pd.Series | None:
        name = name.strip() if isinstance(name, str) else name
        if not isinstance(name, str) or not name:
            raise AssertionError("a series needs a name")
        if not isinstance(author, str):
            raise AssertionError("author is not a string")
        if metadata is not None and not isinstance(metadata, dict):
            raise AssertionError("metadata is not a dict")
        self._forbid(name, "replace" if replace else "update")
        moment = utc(insertion_date, calendar.utcnow())
        series, aware, kind = checked(series)
        state = self.store.state()
        base, entry = state.version, self._entry(name)
        if replace:
            series = series.dropna()
        if not len(series):
            return pd.Series(dtype=kind, name=name)
        if entry and series.notna().any():
            if entry["tzaware"] != aware:
                raise ValueError(f"series {name!r} is {'aware' if entry['tzaware'] else 'naive'}, the new points are not")
            if entry["value_type"] != kind:
                raise ValueError(f"series {name!r} holds {entry['value_type']}, the new points are {kind}")
        elif entry:
            kind = entry["value_type"]
        if not entry:
            kept = series[series.first_valid_index() : series.last_valid_index()] if series.notna().any() else series[:0]
            if not len(kept):
                return None
            entry = {"id": state.next_id, "tzaware": aware, "value_type": kind, "meta": {}}
            rows = self._frame(entry["id"], kept, kind)
            change = [{"kind": "create", "name": name, "entry": entry}]
        else:
            if not self._revs(entry).limit(1).collect():
                raise ValueError(f"series {name!r} was stripped of all its revisions")
            points, change = self._frame(entry["id"], series, kind), []
            log = self._log(entry)
            if replace:
                rows = B.replacement(B.state_asof(log, keep_nans=True), points)
            else:
                dates = series.index.tz_localize(None) if series.index.tz is not None else series.index
                rows = B.diff(B.state_asof(log, start=dates[0].to_pydatetime(), end=dates[-1].to_pydatetime()), points)
        if "op" not in rows.columns:
            rows = rows.withColumn("op", F.when(F.col("num").isNull() & F.col("txt").isNull(), "erase").otherwise("set"))
        found = rows.select("series_id", "value_date", "op", "num", "txt").toArrow()
        if not len(found):
            return None if replace else pd.Series(dtype=kind, name=name)
        rows = self.spark.createDataFrame(found, "series_id bigint, value_date timestamp_ntz, op string, num double, txt string")
        self.store.append(rows, author, moment, metadata, change, base, [entry["id"]])
        return series if replace else self._series(found.to_pandas(), name, entry)

    def update(self, name: str, series: pd.Series, author: str, metadata: dict | None = None, insertion_date: datetime | None = None) -> pd.Series | None:
        """A revision of what is new in the series (null erases); returns it, an empty series if nothing is, None if nothing was created."""
        return self._write(name, series, author, metadata, insertion_date, False)

    def replace(self, name: str, series: pd.Series, author: str, metadata: dict | None = None, insertion_date: datetime | None = None) -> pd.Series | None:
        """A revision whose state is the series without its nulls; None if that is the state already."""
        return self._write(name, series, author, metadata, insertion_date, True)

    def update_many(self, points: DataFrame, author: str, insertion_date: datetime | None = None, tzaware: bool = True) -> int:
        """update() of all series of (name, value_date, num) in one job; the number of series with a new revision."""
        state = self.store.state()
        base, nid, change = state.version, state.next_id, []
        names = [r["name"] for r in points.where("num IS NOT NULL").select("name").distinct().orderBy("name").collect()]  # a row a series
        ids = {}
        for n in names:
            self._forbid(n, "update")
            if n not in state.series:
                change.append({"kind": "create", "name": n, "entry": {"id": nid, "tzaware": tzaware, "value_type": "float64", "meta": {}}})
                ids[n], nid = nid, nid + 1
            else:
                ids[n] = state.series[n]["id"]
        new = {c["entry"]["id"] for c in change}
        mapping = self.spark.createDataFrame([(i, n, i in new) for n, i in ids.items()], "series_id bigint, name string, fresh boolean")
        rows = points.join(mapping, "name").select("series_id", "fresh", "value_date", F.when(~F.isnan("num"), F.col("num")).alias("num"), F.lit(None).cast("string").alias("txt"))
        first = B.trimmed(rows.where("fresh").drop("fresh"))
        known = rows.where("NOT fresh").drop("fresh")
        state_now = B.state_asof(self.store.log().join(known.select("series_id").distinct(), "series_id", "left_semi"))
        changed = first.unionByName(B.diff(state_now, known)).withColumn("op", F.when(F.col("num").isNull(), "erase").otherwise("set"))
        touched = [r["series_id"] for r in changed.select("series_id").distinct().collect()]
        if touched:
            self.store.append(changed, author, utc(insertion_date, calendar.utcnow()), None, [c for c in change if c["entry"]["id"] in set(touched)], base, touched)
        return len(touched)

    def rename(self, old: str, new: str) -> None:
        """Renames a series; an unknown name is let pass."""
        base, new = self.store.state().version, _name(new)
        self._forbid(old, "rename")
        if self._elsewhere(old) or self._elsewhere(new):
            raise ValueError(f"not allowed to rename to a name of a secondary source: {new}")
        if not self._entry(old):
            return
        if self._entry(new):
            raise ValueError(f"{new} already exists")
        self.store.commit([{"kind": "rename", "name": old, "to": new}], base=base)

    def delete(self, name: str) -> None:
        """Deletes a series; an unknown name is let pass."""
        base = self.store.state().version
        self._forbid(name, "delete")
        if self._entry(name):
            self.store.commit([{"kind": "delete", "name": name}], base=base)

    def strip(self, name: str, insertion_date: datetime) -> None:
        """Deletes the first revision at or after a date and all later ones."""
        base = self.store.state().version
        self._forbid(name, "strip")
        entry = self._known(name)
        cut = self._revs(entry).where(F.col("insertion_date") >= F.lit(utc(insertion_date)).cast("timestamp_ntz")).agg(F.min("rev")).first()[0]
        if cut is not None:
            self.store.commit([{"kind": "cut", "series": entry["id"], "rev": cut}], base=base)

    # reads

    def exists(self, name: str) -> bool:
        """Whether a source has the series."""
        return bool(self._entry(name) or self._elsewhere(name))

    def source(self, name: str) -> str | None:
        """local, or the name of the secondary that has the series."""
        return "local" if self._entry(name) else next((n for n, s in self.secondaries.items() if s.exists(name)), None)

    def type(self, name: str) -> str:
        """primary, the only type."""
        return "primary"

    def tzaware(self, name: str) -> bool | None:
        """Whether value dates have a time zone."""
        return self._read(name, None, lambda e: e["tzaware"], "tzaware")

    def get(self, name: str, revision_date: datetime | None = None, from_value_date: datetime | None = None, to_value_date: datetime | None = None, _keep_nans: bool = False) -> pd.Series | None:
        """The state as of a revision date, between inclusive bounds."""

        def local(e: dict[str, Any]) -> pd.Series:
            state = B.state_asof(self._log(e), utc(revision_date), self._bound(e, from_value_date), self._bound(e, to_value_date), _keep_nans)
            return self._series(state.toPandas(), name, e)

        return self._read(name, None, local, "get", revision_date, from_value_date, to_value_date, _keep_nans)

    def history(self, name: str, from_insertion_date: datetime | None = None, to_insertion_date: datetime | None = None, from_value_date: datetime | None = None, to_value_date: datetime | None = None, diffmode: bool = False, _keep_nans: bool = False) -> dict[pd.Timestamp, pd.Series] | None:
        """States, or what changed, by insertion date. States without points are empty series; empty changes are left out."""

        def local(e: dict[str, Any]) -> dict[pd.Timestamp, pd.Series]:
            bounds = (utc(from_insertion_date), utc(to_insertion_date), self._bound(e, from_value_date), self._bound(e, to_value_date))
            log, revs = self._log(e), self._revs(e)
            if diffmode:
                rows, dates = B.history_diff(log, revs, *bounds).toPandas(), []
            else:
                rows = B.history(log, revs, *bounds, keep_nans=_keep_nans).toPandas()
                unbound = bounds[2] is None and bounds[3] is None
                dates = [r["insertion_date"] for r in B.select_revisions(revs, *bounds).select("insertion_date").collect()] if unbound else []
            by = dict(tuple(rows.groupby("insertion_date"))) if len(rows) else {}
            every = sorted({*by, *map(pd.Timestamp, dates)})
            return {d.tz_localize("UTC"): self._series(by.get(d, rows[:0]), name, e) for d in every}

        return self._read(name, None, local, "history", from_insertion_date, to_insertion_date, from_value_date, to_value_date, diffmode, _keep_nans)

    def staircase(self, name: str, delta: timedelta, from_value_date: datetime | None = None, to_value_date: datetime | None = None) -> pd.Series | None:
        """Each point as known delta before its date."""
        local = lambda e: self._series(B.staircase(self._log(e), delta, self._bound(e, from_value_date), self._bound(e, to_value_date)).toPandas(), name, e)
        return self._read(name, None, local, "staircase", delta, from_value_date, to_value_date)

    def block_staircase(self, name: str, from_value_date: datetime | None = None, to_value_date: datetime | None = None, revision_freq: dict | None = None, revision_time: dict | None = None, revision_tz: str = "UTC", maturity_offset: dict | None = None, maturity_time: dict | None = None) -> pd.Series | None:
        """Each point as known at the last scheduled revision whose block has begun."""

        def local(e: dict[str, Any]) -> pd.Series:
            log = self._log(e)
            lo, hi = self._bound(e, from_value_date), self._bound(e, to_value_date)
            now = B.state_asof(log, start=lo, end=hi, keep_nans=True).agg(F.min("value_date"), F.max("value_date")).first()
            if now[0] is None:
                return self._series(pd.DataFrame({"value_date": [], "num": [], "txt": []}), name, e)
            lo, hi = lo or now[0], hi or now[1]
            plan = calendar.schedule(lo, hi, e["tzaware"], revision_freq, revision_time, revision_tz, maturity_offset, maturity_time)
            if not plan:
                return self._series(pd.DataFrame({"value_date": [], "num": [], "txt": []}), name, e)
            out = self._series(B.block_staircase(log, plan, lo, hi).toPandas(), name, e)
            return out.tz_convert(revision_tz) if e["tzaware"] else out

        return self._read(name, None, local, "block_staircase", from_value_date, to_value_date, revision_freq, revision_time, revision_tz, maturity_offset, maturity_time)

    def insertion_dates(self, name: str, from_insertion_date: datetime | None = None, to_insertion_date: datetime | None = None, from_value_date: datetime | None = None, to_value_date: datetime | None = None) -> list[pd.Timestamp]:
        """Insertion dates, rising."""

        def local(e: dict[str, Any]) -> list[pd.Timestamp]:
            rows = B.insertion_dates(self._revs(e), from_insertion=utc(from_insertion_date), to_insertion=utc(to_insertion_date), start=self._bound(e, from_value_date), end=self._bound(e, to_value_date))
            return [pd.Timestamp(r["insertion_date"], tz="UTC") for r in rows.orderBy("rev").collect()]

        return self._read(name, [], local, "insertion_dates", from_insertion_date, to_insertion_date, from_value_date, to_value_date)

    def interval(self, name: str) -> pd.Interval:
        """First and last value date of the last revision."""

        def local(e: dict[str, Any]) -> pd.Interval:
            r = self._revs(e).orderBy(F.desc("rev")).select("ts_start", "ts_end").first()
            lo, hi = (pd.Timestamp(x, tz="UTC" if e["tzaware"] else None) for x in r)
            return pd.Interval(lo, hi, closed="both")

        out = self._read(name, None, local, "interval")
        if out is None:
            raise ValueError(f"no series {name!r}")
        return out

    def log(self, name: str, limit: int | None = None, fromdate: datetime | None = None, todate: datetime | None = None, authors: list[str] | None = None) -> list[dict[str, Any]]:
        """The latest revisions, rising."""

        def local(e: dict[str, Any]) -> list[dict[str, Any]]:
            import json

            rows = B.revision_log(self._revs(e), limit, utc(fromdate), utc(todate), authors).orderBy("rev").collect()
            return [{"rev": r["rev"], "author": r["author"], "date": pd.Timestamp(r["insertion_date"], tz="UTC"), "meta": json.loads(r["metadata"] or "{}")} for r in rows]

        return self._read(name, [], local, "log", limit, fromdate, todate, authors)

    def first_insertion_date(self, name: str) -> pd.Timestamp | None:
        """The first insertion date."""
        return self._read(name, None, lambda e: self._moment(B.first_last_insertion(self._revs(e)).select("first_date").first()), "first_insertion_date")

    def latest_insertion_date(self, name: str) -> pd.Timestamp | None:
        """The last insertion date."""
        return self._read(name, None, lambda e: self._moment(B.first_last_insertion(self._revs(e)).select("last_date").first()), "latest_insertion_date")

    @staticmethod
    def _moment(row: Any) -> pd.Timestamp | None:
        return pd.Timestamp(row[0], tz="UTC") if row else None

    def last_id(self, name: str) -> int | None:
        """The last revision's number."""
        return self._read(name, None, lambda e: (r := B.first_last_insertion(self._revs(e)).select("last_rev").first()) and r[0], "last_id")

    def changeset_at(self, name: str, moment: datetime, mode: str = "strict") -> int | None:
        """The earliest revision at (strict), up to (before) or from (after) a moment."""
        return self._read(name, None, lambda e: (r := B.revision_at(self._revs(e), utc(moment), mode).first()) and r["rev"], "changeset_at", moment, mode)

    def history_cache(self, name: str, **bounds: datetime | None) -> "HistoryCache | None":
        """The series' log within value bounds, kept on the executors for several reads; None for an unknown series."""
        return self._read(name, None, lambda e: HistoryCache(self, name, e, {k: self._bound(e, v) for k, v in bounds.items()}), "history_cache", **bounds)

    # metadata and search

    def list_series(self) -> dict[str, str]:
        """Kind by name of the series here."""
        return {n: "primary" for n in sorted(self.store.state().series)}

    def info(self) -> dict[str, Any]:
        """Number and names of the series here."""
        names = sorted(self.store.state().series)
        return {"series count": len(names), "serie names": names}

    def metadata(self, name: str) -> dict[str, Any] | None:
        """The user's metadata."""
        return self._read(name, None, lambda e: dict(e["meta"]), "metadata")

    def internal_metadata(self, name: str) -> dict[str, Any] | None:
        """What the store knows of the series."""
        return self._read(name, None, _internal, "internal_metadata")

    def update_internal_metadata(self, name: str, metadata: dict[str, Any]) -> None:
        """Merges into what the store knows of the series."""
        base = self.store.state().version
        self._forbid(name, "update metadata of")
        self.store.commit([{"kind": "set", "name": name, "entry": {"imeta": {**self._known(name).get("imeta", {}), **metadata}}}], base=base)

    def replace_metadata(self, name: str, metadata: dict[str, Any]) -> None:
        """Sets the metadata."""
        self._set_metadata(name, metadata, False)

    def update_metadata(self, name: str, metadata: dict[str, Any]) -> None:
        """Merges into the metadata."""
        self._set_metadata(name, metadata, True)

    def _set_metadata(self, name: str, metadata: dict[str, Any], merge: bool) -> None:
        base = self.store.state().version
        self._forbid(name, "update metadata of" if merge else "replace metadata of")
        if not isinstance(metadata, dict):
            raise TypeError("metadata is not a dict")
        old = self._known(name)["meta"] if merge else {}
        self.store.commit([{"kind": "set", "name": name, "entry": {"meta": {**old, **metadata}}}], base=base)

    def catalog(self, allsources: bool = True) -> dict[tuple[str, str], list[tuple[str, str]]]:
        """(source, namespace) -> [(name, kind)]."""
        out = {("local", self.store.namespace): [(n, "primary") for n in sorted(self.store.state().series)]}
        if allsources:
            for source, s in self.secondaries.items():
                out[source, s.store.namespace] = s.catalog(False)["local", s.store.namespace]
        return {k: v for k, v in out.items() if v}

    def find(self, query: str, limit: int | None = None, meta: bool = False) -> list[Descriptor]:
        """Series of all sources that match a query, by name; the limit is each source's. A source that fails is left out."""
        tree = S.parse(query)

        def ask(source: str, s: TimeSeries) -> list[Descriptor]:
            try:
                return s._find(source, tree, limit, meta)
            except Exception as e:  # noqa: BLE001  an unreachable source doesn't keep the others from answering
                print(f"source {source}: {e}")
                return []

        # all at the same time
        with ThreadPoolExecutor(1 + len(self.secondaries)) as pool:
            others = [pool.submit(ask, source, s) for source, s in self.secondaries.items()]
            out = self._find("local", tree, limit, meta)
            return sorted([*out, *(x for f in others for x in f.result())])

    def _find(self, source: str, tree: S.Query, limit: int | None, meta: bool) -> list[Descriptor]:
        mine = S.for_source(source, tree)
        if mine is None:
            return []
        rows = self.store.registry().where(S.predicate(mine)).select("name").orderBy("name")
        names = [r["name"] for r in (rows if limit is None else rows.limit(limit)).collect()]
        series = self.store.state().series
        return [Descriptor(n, _internal(series[n]) if meta else {}, dict(series[n]["meta"]) if meta else {}, source) for n in names if n in series]

    def register_basket(self, name: str, query: str) -> None:
        """Stores a query."""
        S.parse(query)
        self.store.commit([{"kind": "basket", "name": _name(name), "query": query}], base=self.store.state().version)

    def basket(self, name: str) -> list[Descriptor]:
        """What a stored query finds."""
        if (query := self.basket_definition(name)) is None:
            raise ValueError(f"no basket {name!r}")
        return self.find(query)

    def basket_definition(self, name: str) -> str | None:
        """A stored query."""
        return self.store.state().baskets.get(name)

    def list_baskets(self) -> list[str]:
        """Names of stored queries."""
        return sorted(self.store.state().baskets)

    def delete_basket(self, name: str) -> None:
        """Deletes a stored query."""
        self.store.commit([{"kind": "drop_basket", "name": name}], base=self.store.state().version)

    # groups

    def _group(self, name: str) -> dict[str, Any] | None:
        return self.store.state().groups.get(name)

    def group_exists(self, name: str) -> bool:
        """Whether the group is here; groups aren't federated."""
        return self._group(name) is not None

    def group_type(self, name: str) -> str:
        """primary, the only type."""
        return "primary"

    def group_replace(self, name: str, frame: pd.DataFrame, author: str, insertion_date: datetime | None = None) -> None:
        """A revision of all members, whose state is the frame."""
        state = self.store.state()
        entry, base = self._group(name), state.version
        columns = [str(c) for c in frame.columns]
        if entry:
            G.check_columns(columns, list(entry["members"]))
        elif len(set(columns)) < len(columns):
            raise ValueError("group has columns twice")
        frame = frame.set_axis(columns, axis=1)
        change, aware = [], frame.index.tz is not None
        members = {c: checked(frame[c]) for c in columns}
        # a column without a value tells no type
        kinds = {c: kind for c, (x, _, kind) in members.items() if x.notna().any()}
        if not entry:
            entry = {"members": {c: state.next_id + k for k, c in enumerate(columns)}, "kinds": kinds, "tzaware": aware, "value_type": "float64", "meta": {}}
            change = [{"kind": "create", "name": _name(name), "entry": entry, "group": True}]
        elif entry["tzaware"] != aware:
            raise ValueError("group and frame differ in time zone awareness")
        else:
            known = entry.get("kinds", {})
            if other := sorted(c for c, kind in kinds.items() if known.get(c, kind) != kind):
                raise ValueError(f"group members of another type of values: {other}")
            if {**known, **kinds} != known:
                entry = {**entry, "kinds": {**known, **kinds}}
                change = [{"kind": "set", "name": name, "entry": {"kinds": entry["kinds"]}, "group": True}]
        points = None
        for c, (series, _, kind) in members.items():
            part = self._frame(entry["members"][c], series.dropna(), kind)
            points = part if points is None else points.unionByName(part)
        ids = list(entry["members"].values())
        log = self.store.log().where(F.col("series_id").isin(ids))
        rows = B.replacement(B.state_asof(log, keep_nans=True), points)
        # revisions belong to the group: every member gets one
        self.store.append(rows, author, utc(insertion_date, calendar.utcnow()), None, change, base, ids)

    def _mapping(self, entry: dict[str, Any]) -> tuple[DataFrame, list[str]]:
        return self.spark.createDataFrame([(i, m) for m, i in entry["members"].items()], "series_id bigint, member string"), list(entry["members"])

    @staticmethod
    def _texts(entry: dict[str, Any]) -> list[str]:
        return [m for m, kind in entry.get("kinds", {}).items() if kind == "object"]

    def _wide(self, rows: pd.DataFrame, entry: dict[str, Any]) -> pd.DataFrame:
        out = rows.set_index("value_date")[list(entry["members"])].sort_index()
        out.index = pd.DatetimeIndex(out.index).rename(None).as_unit("ns")
        return out.tz_localize("UTC") if entry["tzaware"] else out

    def group_get(self, name: str, revision_date: datetime | None = None, from_value_date: datetime | None = None, to_value_date: datetime | None = None) -> pd.DataFrame | None:
        """The wide state of a group."""
        if not (e := self._group(name)):
            return None
        mapping, members = self._mapping(e)
        return self._wide(G.group_get(self.store.log(), mapping, members, utc(revision_date), self._bound(e, from_value_date), self._bound(e, to_value_date), texts=self._texts(e)).toPandas(), e)

    def group_insertion_dates(self, name: str, from_insertion_date: datetime | None = None, to_insertion_date: datetime | None = None) -> list[pd.Timestamp]:
        """Insertion dates of a group, rising."""
        if not (e := self._group(name)):
            return []
        rows = G.group_insertion_dates(self.store.revisions(), self._mapping(e)[0], utc(from_insertion_date), utc(to_insertion_date))
        return sorted(pd.Timestamp(r["insertion_date"], tz="UTC") for r in rows.collect())

    def group_history(self, name: str, from_insertion_date: datetime | None = None, to_insertion_date: datetime | None = None, from_value_date: datetime | None = None, to_value_date: datetime | None = None) -> dict[pd.Timestamp, pd.DataFrame] | None:
        """The wide state at each insertion date."""
        if not (e := self._group(name)):
            return None
        mapping, members = self._mapping(e)
        rows = G.group_history(self.store.log(), self.store.revisions(), mapping, members, utc(from_insertion_date), utc(to_insertion_date), self._bound(e, from_value_date), self._bound(e, to_value_date), self._texts(e)).toPandas()
        return {d.tz_localize("UTC"): self._wide(part.drop(columns="insertion_date"), e) for d, part in rows.groupby("insertion_date")}

    def group_rename(self, old: str, new: str) -> None:
        """Renames a group."""
        base, new = self.store.state().version, _name(new)
        if not self._group(old):
            raise ValueError(f"no group {old!r}")
        if self._group(new):
            raise ValueError(f"{new} already exists")
        self.store.commit([{"kind": "rename", "name": old, "to": new, "group": True}], base=base)

    def group_delete(self, name: str) -> None:
        """Deletes a group and its members; an unknown name is let pass."""
        base = self.store.state().version
        if self._group(name):
            self.store.commit([{"kind": "delete", "name": name, "group": True}], base=base)

    def group_metadata(self, name: str) -> dict[str, Any] | None:
        """The user's metadata of a group."""
        return (e := self._group(name)) and dict(e["meta"])

    def group_internal_metadata(self, name: str) -> dict[str, Any] | None:
        """What the store knows of a group."""
        return (e := self._group(name)) and {"tzaware": e["tzaware"], "value_type": e["value_type"]}

    def update_group_metadata(self, name: str, metadata: dict[str, Any]) -> None:
        """Sets the metadata of a group, as it has always done in spite of its name."""
        base = self.store.state().version
        if not self._group(name):
            raise ValueError(f"no group {name!r}")
        self.store.commit([{"kind": "set", "name": name, "entry": {"meta": metadata}, "group": True}], base=base)

    def group_catalog(self) -> dict[tuple[str, str], list[tuple[str, str]]]:
        """(source, namespace) -> [(name, kind)] of the groups."""
        names = sorted(self.store.state().groups)
        return {("local", self.store.namespace): [(n, "primary") for n in names]} if names else {}


class HistoryCache:
    """Reads from one cached slice of a log. close() gives the memory up; a lost executor's part is read again."""

    def __init__(self, tsa: TimeSeries, name: str, entry: dict[str, Any], bounds: dict[str, datetime | None]) -> None:
        self._tsa, self._name, self._entry = tsa, name, entry
        rows = tsa._log(entry).where(B.between(F.col("value_date"), bounds.get("from_value_date"), bounds.get("to_value_date")))
        self._rows = rows.persist()

    def get(self, revision_date: datetime | None = None, from_value_date: datetime | None = None, to_value_date: datetime | None = None) -> pd.Series:
        """As TimeSeries.get."""
        bounds = (self._tsa._bound(self._entry, x) for x in (from_value_date, to_value_date))
        return self._tsa._series(B.state_asof(self._rows, utc(revision_date), *bounds).toPandas(), self._name, self._entry)

    def staircase(self, delta: timedelta, from_value_date: datetime | None = None, to_value_date: datetime | None = None) -> pd.Series:
        """As TimeSeries.staircase."""
        bounds = (self._tsa._bound(self._entry, x) for x in (from_value_date, to_value_date))
        return self._tsa._series(B.staircase(self._rows, delta, *bounds).toPandas(), self._name, self._entry)

    def close(self) -> None:
        """Gives the memory up."""
        self._rows.unpersist()


def replicate_series(origin: TimeSeries, target: TimeSeries, name: str, target_name: str | None = None) -> int:
    """Copies the revisions of a series that are later than the target's last, removals included, and its metadata; the number copied."""
    target_name = target_name or name
    e = origin._entry(name)
    if not e:
        raise ValueError(f"no series {name!r}")
    have = target._entry(target_name)
    state = target.store.state()
    i = have["id"] if have else state.next_id
    change = [] if have else [{"kind": "create", "name": target_name, "entry": {**e, "id": i}}]
    version = F.lit(state.version + 1).cast("bigint").alias("version")
    log = origin._log(e).withColumn("series_id", F.lit(i).cast("bigint"))
    revs = origin._revs(e).withColumn("series_id", F.lit(i).cast("bigint"))
    if have:
        log = B.replicate(log, target._revs(have))
        revs = B.replicate(revs, target._revs(have))
    n = revs.count()
    if n:
        last = target._revs(have).agg(F.max("rev")).first()[0] or 0 if have else 0
        shift = F.lit(last - (revs.agg(F.min("rev")).first()[0] - 1))
        log, revs = (x.withColumn("rev", F.col("rev") + shift).select("*", version) for x in (log, revs))
        target.store.commit([*change, {"kind": "set", "name": target_name, "entry": {"meta": e["meta"]}}], [target.store.write(log, "points")], [target.store.write(revs, "revisions")], state.version)
    return n
