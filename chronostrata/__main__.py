"""python -m chronostrata COMMAND STORE [NAME] ...: upkeep of a store, and looks into it. STORE is a folder, an address or a name of the configuration."""

from __future__ import annotations

import argparse
import time
from datetime import datetime, timedelta, timezone

from pyspark.sql import SparkSession

from .api import TimeSeries
from .config import config_path, timeseries
from .sources.http import Client, serve


def check(tsa: TimeSeries) -> list[str]:
    """What is wrong with the series of a store: revisions that aren't numbered or dated in order, points of no revision, intervals that aren't those of the state."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from .plans import bitemporal as B

    log, revs = tsa.store.log(), tsa.store.revisions()
    w = Window.partitionBy("series_id").orderBy("rev")
    order = revs.withColumns({"r": F.lag("rev").over(w), "d": F.lag("insertion_date").over(w)}).where("r >= rev OR d >= insertion_date").select("series_id", F.lit("revisions out of order").alias("what"))
    lost = log.select("series_id", "rev").distinct().join(revs, ["series_id", "rev"], "left_anti").select("series_id", F.lit("points of no revision").alias("what"))
    last = revs.groupBy("series_id").agg(F.max_by(F.struct("ts_start", "ts_end"), "rev").alias("x"))
    spans = last.join(B.interval(log), "series_id", "left").where("NOT (x.ts_start <=> ts_start AND x.ts_end <=> ts_end)").select("series_id", F.lit("another interval than its state").alias("what"))
    state = tsa.store.state()
    names = {e["id"]: n for n, e in state.series.items()} | {i: f"{g}/{m}" for g, e in state.groups.items() for m, i in e["members"].items()}
    return sorted({f"{names.get(r['series_id'], r['series_id'])}: {r['what']}" for r in order.unionByName(lost).unionByName(spans).collect()})


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="chronostrata", description=__doc__)
    p.add_argument("command", choices=["serve", "compact", "garbage", "list", "find", "get", "history", "log", "info", "check", "configpath"])
    p.add_argument("store", nargs="?")
    p.add_argument("name", nargs="?", help="a series, for get, history and log")
    p.add_argument("--namespace", default="tsh")
    p.add_argument("--port", type=int, default=8080)
    p.add_argument("--query", default="(by.everything)")
    p.add_argument("--limit", type=int)
    p.add_argument("--revision-date", type=datetime.fromisoformat)
    p.add_argument("--from-value-date", type=datetime.fromisoformat)
    p.add_argument("--to-value-date", type=datetime.fromisoformat)
    p.add_argument("--diff", action="store_true", help="what changed, for history")
    p.add_argument("--hours", type=float, default=24.0, help="how old what garbage deletes has to be")
    a = p.parse_args(argv)
    if a.command == "configpath":
        print(config_path() or "no configuration file")
        return 0
    if not a.store or a.command in ("get", "history", "log") and not a.name:
        p.error("a store is needed, and a series for get, history and log")
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    tsa = timeseries(spark, a.store, a.namespace)
    bounds = {"from_value_date": a.from_value_date, "to_value_date": a.to_value_date}
    if a.command in ("compact", "garbage", "check", "info") and isinstance(tsa, Client):
        p.error(f"{a.command} needs a folder")
    if a.name and not tsa.exists(a.name):
        print(f"no series {a.name!r}")
        return 1
    if a.command == "serve":
        server = serve(tsa, port=a.port)
        print(f"http://{server.server_address[0]}:{server.server_address[1]}", flush=True)
        while True:
            time.sleep(3600)
    elif a.command == "compact":
        tsa.store.compact()
    elif a.command == "garbage":
        print("\n".join(tsa.store.garbage(timedelta(hours=a.hours))))
    elif a.command == "check":
        wrong = check(tsa)
        print("\n".join(wrong) or f"nothing wrong at {datetime.now(timezone.utc):%Y-%m-%d %H:%M}")
        return int(bool(wrong))
    elif a.command == "info":
        print("\n".join(f"{k}: {v}" for k, v in tsa.info().items()))
    elif a.command == "get":
        print(tsa.get(a.name, a.revision_date, **bounds).to_string())
    elif a.command == "history":
        for date, series in tsa.history(a.name, **bounds, diffmode=a.diff).items():
            print(f"{date}\n{series.to_string()}\n")
    elif a.command == "log":
        for r in tsa.log(a.name, a.limit):
            print(r["rev"], r["date"], r["author"], r["meta"])
    else:
        for name in (n for _, v in tsa.catalog().items() for n, _ in v) if a.command == "list" else tsa.find(a.query, a.limit):
            print(name)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
