"""A versioned store on Parquet files with atomic commits.

Under <root>/<namespace>/ lie points and revisions, a folder for each commit, and _commits/, a JSON file
for each. A writer writes its data first and then creates its commit file, which fails if another writer
took the number; readers see what commit files name. Registry, metadata, baskets and groups are changes in
the commit files, replayed by the reader from the last of the states that are written every EVERY commits.
A commit is tried on a copy of the state before it is written, and one that can't be replayed has no effect.
Nothing is overwritten: compact() writes all anew, and garbage() deletes what nothing names any more, when
it is older than readers may need it.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field, replace
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import bitemporal as B

FORMAT = 1
#: Commits from one written state to the next.
EVERY = 64
#: Cuts up to which they are broadcast.
CUTS = 1_000_000


class ConcurrentWrite(RuntimeError):
    """Another writer committed first."""


@dataclass
class State:
    """What the commits say."""

    version: int = 0
    points: list[str] = field(default_factory=list)
    revisions: list[str] = field(default_factory=list)
    cuts: list[dict[str, int]] = field(default_factory=list)  # series, rev, version: rows up to the version with this rev or a later one are gone
    series: dict[str, dict[str, Any]] = field(default_factory=dict)
    groups: dict[str, dict[str, Any]] = field(default_factory=dict)
    baskets: dict[str, str] = field(default_factory=dict)
    next_id: int = 1

    def apply(self, change: dict[str, Any]) -> None:
        """Replays a change; ValueError if it can't be."""
        kind, name = change["kind"], change.get("name")
        table = self.groups if change.get("group") else self.series
        what = "group" if change.get("group") else "series"
        if kind in ("set", "rename", "delete") and name not in table:
            raise ValueError(f"no {what} {name!r}")
        if kind == "create" and name in table or kind == "rename" and change["to"] in table:
            raise ValueError(f"{change.get('to', name)} already exists")
        if kind == "create":
            table[name] = change["entry"]
            self.next_id = max(self.next_id, *(i + 1 for i in _ids(change["entry"])))
        elif kind == "set":
            table[name] = {**table[name], **change["entry"]}
        elif kind == "rename":
            table[change["to"]] = table.pop(name)
        elif kind == "delete":
            for i in _ids(table.pop(name)):
                self.cuts.append({"series": i, "rev": 0, "version": self.version})
        elif kind == "cut":
            self.cuts.append({"series": change["series"], "rev": change["rev"], "version": self.version})
        elif kind == "basket":
            self.baskets[name] = change["query"]
        elif kind == "drop_basket":
            self.baskets.pop(name, None)
        else:
            raise ValueError(f"unknown change {kind!r}")

    def after(self, commit: dict[str, Any], version: int) -> "State":
        """The state after a commit; ValueError if it can't be replayed. This one stays as it is."""
        if commit["format"] != FORMAT:
            raise RuntimeError(f"store format {commit['format']}; this is {FORMAT}")
        s = State() if commit.get("snapshot") else replace(self, points=[*self.points], revisions=[*self.revisions], cuts=[*self.cuts], series={**self.series}, groups={**self.groups}, baskets={**self.baskets})
        s.version = version
        for change in commit["changes"]:
            s.apply(change)
        if commit.get("snapshot"):
            s.next_id = max(s.next_id, commit["next_id"])
        s.points += commit["points"]
        s.revisions += commit["revisions"]
        return s


def _ids(entry: dict[str, Any]) -> list[int]:
    return list(entry["members"].values()) if "members" in entry else [entry["id"]]


class Files:
    """The few file operations a store needs, by Hadoop's file systems, so that any shared storage serves."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm = spark._jvm
        self.root = root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str) -> Any:
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        """Names in a folder; none if it doesn't exist."""
        p = self._path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def older(self, folder: str, moment: float) -> list[str]:
        """Names in a folder of what was last changed before a moment, in seconds."""
        p = self._path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p) if s.getModificationTime() < moment * 1000) if self.fs.exists(p) else []

    def read(self, name: str) -> str:
        """A text file."""
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Creates a text file; False if it exists."""
        try:
            stream = self.fs.create(self._path(name), False)
        except Exception as e:
            if self.fs.exists(self._path(name)):
                return False
            raise e
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def delete(self, name: str) -> None:
        """Deletes a file or folder."""
        self.fs.delete(self._path(name), True)


class Store:
    """One namespace."""

    def __init__(self, spark: SparkSession, root: str, namespace: str = "tsh") -> None:
        self.spark, self.namespace = spark, namespace
        self.files = Files(spark, f"{root.rstrip('/')}/{namespace}")
        self._state = State()

    def _json(self, name: str) -> dict[str, Any]:
        """A JSON file; one that is being written is waited for."""
        for _ in range(50):
            try:
                return json.loads(self.files.read(name))
            except json.JSONDecodeError:
                time.sleep(0.1)
        raise RuntimeError(f"{name} isn't complete")

    def state(self) -> State:
        """The committed state; only new commit files are read."""
        names = self.files.names("_commits")
        if names and int(names[-1].split(".")[0]) > self._state.version + EVERY:
            for name in reversed(self.files.names("_states")):
                if int(name.split(".")[0]) <= self._state.version:
                    break
                try:
                    self._state = State(**json.loads(self.files.read(f"_states/{name}")))
                    break
                except json.JSONDecodeError:
                    continue  # not complete: an earlier one does
        for name in names:
            version = int(name.split(".")[0])
            if version <= self._state.version:
                continue
            try:
                self._state = self._state.after(self._json(f"_commits/{name}"), version)
            except ValueError:
                self._state = replace(self._state, version=version)  # it has no effect
        return self._state

    def commit(self, changes: Iterable[dict[str, Any]], points: list[str] = (), revisions: list[str] = (), base: int | None = None, **more: Any) -> int:
        """Makes changes and written folders visible; ConcurrentWrite if the store is past `base`, ValueError if a change can't be made."""
        now = self.state()
        if base is not None and now.version != base:
            raise ConcurrentWrite(f"version {base + 1} of {self.namespace} is taken")
        version = now.version + 1
        body = {"format": FORMAT, "changes": list(changes), "points": list(points), "revisions": list(revisions), **more}
        after = now.after(body, version)
        if not self.files.create(f"_commits/{version:012d}.json", json.dumps(body)):
            raise ConcurrentWrite(f"version {version} of {self.namespace} is taken")
        self._state = after
        if version % EVERY == 0:
            self.files.create(f"_states/{version:012d}.json", json.dumps(asdict(after)))
        return version

    def write(self, df: DataFrame, kind: str) -> str:
        """Writes a folder of points or revisions, invisible until a commit names it."""
        name = f"{kind}/{uuid.uuid4().hex}"
        if kind == "points":
            df = df.sortWithinPartitions("series_id", "value_date", "rev")  # so that bounds prune row groups
        df.write.option("compression", "zstd").parquet(f"{self.files.root}/{name}")
        return name

    def _read(self, folders: list[str], schema: str) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(schema).parquet(*(f"{self.files.root}/{x}" for x in folders))
        return df

    def _visible(self, df: DataFrame) -> DataFrame:
        """df without rows that a strip or a deletion took away. Ids of series are never used again, revisions are."""
        cuts = self.state().cuts
        if not cuts:
            return df
        rows = self.spark.createDataFrame([(c["series"], c["rev"], c["version"]) for c in cuts], "series_id bigint, cut bigint, upto bigint")
        cut = rows.groupBy("series_id").agg(F.collect_list(F.struct("cut", "upto")).alias("cuts"))  # one row a series that was ever cut since compact()
        cut = F.broadcast(cut) if len(cuts) <= CUTS else cut
        gone = F.coalesce(F.exists("cuts", lambda c: (F.col("rev") >= c["cut"]) & (F.col("version") <= c["upto"])), F.lit(False))
        return df.join(cut, "series_id", "left").where(~gone).drop("cuts")

    def log(self) -> DataFrame:
        """The change log of all series."""
        return self._visible(self._read(self.state().points, B.LOG + ", version bigint")).drop("version")

    def revisions(self) -> DataFrame:
        """The revisions of all series."""
        return self._visible(self._read(self.state().revisions, B.REVISIONS + ", version bigint")).drop("version")

    def registry(self) -> DataFrame:
        """(series_id, name, kind, tzaware, value_type, metadata, source)."""
        rows = [(e["id"], n, "primary", e["tzaware"], e["value_type"], json.dumps(e["meta"]), "local") for n, e in self.state().series.items()]
        return self.spark.createDataFrame(rows, "series_id bigint, name string, kind string, tzaware boolean, value_type string, metadata string, source string")

    def append(self, rows: DataFrame, author: str, insertion_date: datetime, metadata: dict | None, changes: Iterable[dict[str, Any]], base: int, ids: list[int]) -> None:
        """Commits a revision of the series of the log rows (series_id, value_date, op, num, txt), and of the series `ids`.

        The intervals of the new states are computed in the same job as the next revision numbers.
        """
        spark = self.spark
        mine = spark.createDataFrame([(i,) for i in ids], "series_id bigint")
        mine = F.broadcast(mine) if len(ids) < 1_000_000 else mine
        old_rev = self.revisions().join(mine, "series_id", "left_semi").groupBy("series_id").agg(F.max("rev").alias("last"), F.max("insertion_date").alias("last_date"))
        at = F.lit(insertion_date).cast("timestamp_ntz")
        late = old_rev.where(F.col("last_date") >= at).limit(1).collect()
        if late:
            name = next((n for n, e in self.state().series.items() if e["id"] == late[0]["series_id"]), "group member")
            raise AssertionError(f'"{name}" already has a newer revision than {insertion_date}')
        rev = mine.join(old_rev, "series_id", "left").select("series_id", (F.coalesce("last", F.lit(0)) + 1).alias("rev"))
        version = base + 1
        points = rows.join(rev, "series_id").select("series_id", "rev", at.alias("insertion_date"), "value_date", "op", "num", "txt", F.lit(version).cast("bigint").alias("version"))
        folder = self.write(points, "points")
        written = self._read([folder], B.LOG + ", version bigint").drop("version")
        log = self.log().join(mine, "series_id", "left_semi").unionByName(written)
        spans = B.interval(log)
        revs = rev.join(spans, "series_id", "left").select("series_id", "rev", at.alias("insertion_date"), F.lit(author).alias("author"), F.lit(json.dumps(metadata or {})).alias("metadata"), "ts_start", "ts_end", F.lit(version).cast("bigint").alias("version"))
        rfolder = self.write(revs, "revisions")
        empty = self._read([rfolder], B.REVISIONS).where("ts_start IS NULL AND rev > 1").limit(1).collect()
        if empty:
            raise ValueError("complete erasure of a series is forbidden")
        self.commit(changes, [folder], [rfolder], base)

    def compact(self) -> None:
        """Writes all that is visible anew as one snapshot. What older commits hold stays for those who are reading it, until garbage()."""
        s = self.state()
        version = s.version + 1
        stamp = F.lit(version).cast("bigint").alias("version")
        # ranges of series and dates: a series of many points is in several
        folder = self.write(self.log().select("*", stamp).repartitionByRange("series_id", "value_date"), "points")
        rfolder = self.write(self.revisions().select("*", stamp), "revisions")
        changes = [{"kind": "create", "name": n, "entry": e} for n, e in s.series.items()]
        changes += [{"kind": "create", "name": n, "entry": e, "group": True} for n, e in s.groups.items()]
        changes += [{"kind": "basket", "name": n, "query": q} for n, q in s.baskets.items()]
        self.commit(changes, [folder], [rfolder], s.version, snapshot=True, next_id=s.next_id)

    def garbage(self, grace: timedelta = timedelta(days=1)) -> list[str]:
        """Deletes folders that the state doesn't name (of compacted or failed commits) and that are older than the grace time; their names."""
        s = self.state()
        named, moment = {*s.points, *s.revisions}, time.time() - grace.total_seconds()
        gone = [f"{kind}/{x}" for kind in ("points", "revisions") for x in self.files.older(kind, moment) if f"{kind}/{x}" not in named]
        for x in gone:
            self.files.delete(x)
        return gone
