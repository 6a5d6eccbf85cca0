"""One query per operator on the driver's tables, and the SQL that gives the same rows.

Versioned data are derived from events: ten series, a value date up to four days after the event, the event
as revision. An error erases a point; in the second log a signup drops it, as a replacement does.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.columns import bisect, overlaps
from .functions.schedule import schedule
from .operators import groups as G
from .operators import search as S
from .plans import bitemporal as B

Q = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Q] = {}
SQL: dict[str, str] = {}
MEMBERS = [f"m{i}" for i in range(10)]


def _events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


def log(spark: SparkSession, d: str, drops: bool = False) -> DataFrame:
    """The change log of the ten series."""
    op = F.when(F.col("event_type") == "error", "erase")
    if drops:
        op = op.when(F.col("event_type") == "signup", "drop")
    op = op.otherwise("set")
    day = (F.date_trunc("day", "ts").cast("timestamp_ntz") + F.make_dt_interval((F.col("event_id") % 5).cast("int"))).cast("timestamp_ntz")
    return _events(spark, d).select((F.col("user_id") % 10).alias("series_id"), F.col("event_id").alias("rev"), F.col("ts").alias("insertion_date"), day.alias("value_date"), op.alias("op"), F.when(op == "set", F.col("value")).alias("num"), F.lit(None).cast("string").alias("txt"))


def revisions(spark: SparkSession, d: str) -> DataFrame:
    """The revisions of the log; an interval is that of all points set so far."""
    w = Window.partitionBy("series_id").orderBy("rev")
    rows = log(spark, d).join(_events(spark, d).select(F.col("event_id").alias("rev"), F.col("event_type").alias("author"), F.col("props").alias("metadata")), "rev")
    v = F.when(F.col("op") == "set", F.col("value_date"))
    return rows.select("series_id", "rev", "insertion_date", "author", "metadata", F.min(v).over(w).alias("ts_start"), F.max(v).over(w).alias("ts_end"))


def registry(spark: SparkSession, d: str) -> DataFrame:
    """A registry row for each event."""
    meta = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit('{"unit": "MWh", "k": "'), F.col("user_id").cast("string"), F.lit('"}'))).when(F.col("event_id") % 7 == 1, F.lit('{"nil": null}')).otherwise(F.col("props"))
    return _events(spark, d).select(F.concat(F.lit("series."), F.col("event_type"), F.lit("."), F.col("event_id").cast("string")).alias("name"), (F.col("user_id") % 2 == 0).alias("tzaware"), meta.alias("metadata"), F.when(F.col("event_id") % 3 == 0, "far").otherwise("local").alias("source"))


_LOG = """log AS (
    SELECT user_id % 10 AS series_id, event_id AS rev, ts AS insertion_date, CAST(date_trunc('day', ts) + (event_id % 5) * INTERVAL '1' DAY AS TIMESTAMP) AS value_date,
        CASE WHEN event_type = 'error' THEN 'erase' ELSE 'set' END AS op, CASE WHEN event_type <> 'error' THEN value END AS num FROM events
)"""
_DROPS = """log AS (
    SELECT user_id % 10 AS series_id, event_id AS rev, ts AS insertion_date, CAST(date_trunc('day', ts) + (event_id % 5) * INTERVAL '1' DAY AS TIMESTAMP) AS value_date,
        CASE WHEN event_type = 'error' THEN 'erase' WHEN event_type = 'signup' THEN 'drop' ELSE 'set' END AS op,
        CASE WHEN event_type NOT IN ('error', 'signup') THEN value END AS num FROM events
)"""
_REVISIONS = """revisions AS (
    SELECT log.series_id, log.rev, log.insertion_date, event_type AS author, props AS metadata,
        min(CASE WHEN op = 'set' THEN value_date END) OVER w AS ts_start, max(CASE WHEN op = 'set' THEN value_date END) OVER w AS ts_end
    FROM log JOIN events ON rev = event_id WINDOW w AS (PARTITION BY log.series_id ORDER BY rev)
)"""
_REGISTRY = """registry AS (
    SELECT 'series.' || event_type || '.' || event_id AS name, user_id % 2 = 0 AS tzaware,
        CASE WHEN event_id % 7 = 0 THEN '{"unit": "MWh", "k": "' || user_id || '"}' WHEN event_id % 7 = 1 THEN '{"nil": null}' ELSE props END AS metadata,
        CASE WHEN event_id % 3 = 0 THEN 'far' ELSE 'local' END AS source FROM events
)"""


def query(name: str, sql: str | None) -> Callable[[Q], Q]:
    """Registers a query with its SQL."""

    def add(f: Q) -> Q:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _state(where: str = "true", shown: str = "op = 'set'", ctes: str = _LOG, cols: str = "series_id, value_date, num") -> str:
    return f"WITH {ctes}, s AS (SELECT * FROM log WHERE {where} QUALIFY row_number() OVER (PARTITION BY series_id, value_date ORDER BY rev DESC) = 1) SELECT {cols} FROM s WHERE {shown}"


T1 = "2024-01-10 12:00:00"
A, Z = "2024-01-08 00:00:00", "2024-01-20 00:00:00"


@query("state_latest", _state())
def state_latest(spark: SparkSession, d: str) -> DataFrame:
    return B.state_asof(log(spark, d)).drop("txt")


@query("state_asof", _state(f"insertion_date <= '{T1}'"))
def state_asof(spark: SparkSession, d: str) -> DataFrame:
    return B.state_asof(log(spark, d), T1).drop("txt")


@query("state_slice", _state(f"insertion_date <= '{T1}' AND value_date BETWEEN '{A}' AND '{Z}'"))
def state_slice(spark: SparkSession, d: str) -> DataFrame:
    return B.state_asof(log(spark, d), T1, A, Z).drop("txt")


@query("keep_nans", _state(shown="op IN ('set', 'erase')", ctes=_DROPS))
def keep_nans(spark: SparkSession, d: str) -> DataFrame:
    return B.state_asof(log(spark, d, drops=True), keep_nans=True).drop("txt")


@query("string_series", "SELECT user_id % 10 AS series_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS value_date, arg_max_null(CASE WHEN event_type <> 'error' THEN event_type END, event_id) AS txt FROM events GROUP BY ALL HAVING txt IS NOT NULL")
def string_series(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    gone = F.col("event_type") == "error"
    rows = e.select((F.col("user_id") % 10).alias("series_id"), F.col("event_id").alias("rev"), F.col("ts").alias("insertion_date"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("value_date"), F.when(gone, "erase").otherwise("set").alias("op"), F.lit(None).cast("double").alias("num"), F.when(~gone, F.col("event_type")).alias("txt"))
    return B.state_asof(rows).drop("num")


@query("naive_numeric_cast", "SELECT p_partkey AS series_id, TIMESTAMP '2024-01-01' + (p_size % 28) * INTERVAL '1' DAY AS value_date, CAST(p_size AS DOUBLE) AS num FROM part")
def naive_numeric_cast(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet")
    day = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval((F.col("p_size") % 28).cast("int"))
    rows = p.select(F.col("p_partkey").alias("series_id"), F.lit(1).cast("bigint").alias("rev"), F.lit("2024-01-01").cast("timestamp_ntz").alias("insertion_date"), day.cast("timestamp_ntz").alias("value_date"), F.lit("set").alias("op"), F.col("p_size").cast("double").alias("num"), F.lit(None).cast("string").alias("txt"))
    return B.state_asof(rows).drop("txt")


@query("staircase_1d", _state("insertion_date <= value_date - INTERVAL '1' DAY"))
def staircase_1d(spark: SparkSession, d: str) -> DataFrame:
    return B.staircase(log(spark, d), timedelta(days=1)).drop("txt")


@query(
    "staircase_replaced",
    f"WITH {_DROPS}, now AS (SELECT series_id, value_date, arg_max(op, rev) AS op FROM log GROUP BY ALL), s AS (SELECT * FROM log WHERE insertion_date <= value_date - INTERVAL '6' HOUR QUALIFY row_number() OVER (PARTITION BY series_id, value_date ORDER BY rev DESC) = 1) "
    "SELECT s.series_id, s.value_date, s.num FROM s JOIN now USING (series_id, value_date) WHERE s.op = 'set' AND now.op <> 'drop'",
)
def staircase_replaced(spark: SparkSession, d: str) -> DataFrame:
    return B.staircase(log(spark, d, drops=True), timedelta(hours=6)).drop("txt")


_FIRST = "SELECT * FROM revisions WHERE series_id = 3 QUALIFY row_number() OVER (ORDER BY rev) <= 150"


@query("history_full", f"WITH {_LOG}, {_REVISIONS}, r AS ({_FIRST}) SELECT r.series_id, r.rev, r.insertion_date, l.value_date, arg_max_null(l.num, l.rev) AS num FROM r JOIN log l ON l.series_id = r.series_id AND l.rev <= r.rev GROUP BY ALL HAVING arg_max_null(l.num, l.rev) IS NOT NULL")
def history_full(spark: SparkSession, d: str) -> DataFrame:
    r = revisions(spark, d).where("series_id = 3").orderBy("rev").limit(150)
    return B.history(log(spark, d).where("series_id = 3"), r).drop("txt")


_BOUNDED = f"""WITH {_LOG}, {_REVISIONS}, r AS (SELECT * FROM revisions WHERE insertion_date BETWEEN '2024-01-09 00:00:00' AND '{T1}' AND ts_end >= '{A}' AND ts_start <= '2024-01-10 00:00:00'),
h AS (SELECT r.series_id, r.rev, r.insertion_date, l.value_date, arg_max_null(l.num, l.rev) AS num FROM r JOIN log l ON l.series_id = r.series_id AND l.rev <= r.rev WHERE l.value_date BETWEEN '{A}' AND '2024-01-10 00:00:00' GROUP BY ALL HAVING arg_max_null(l.num, l.rev) IS NOT NULL),
g AS (SELECT series_id, rev, string_agg(value_date || ':' || num, ',' ORDER BY value_date) AS sig FROM h GROUP BY ALL),
k AS (SELECT *, lag(sig) OVER (PARTITION BY series_id ORDER BY rev) AS was FROM g)
SELECT h.* FROM h JOIN k USING (series_id, rev) WHERE sig IS DISTINCT FROM was"""


@query("pruned_history", _BOUNDED)
def pruned_history(spark: SparkSession, d: str) -> DataFrame:
    return B.history(log(spark, d), revisions(spark, d), "2024-01-09 00:00:00", T1, A, "2024-01-10 00:00:00").drop("txt")


@query("history_diff", f"WITH {_LOG} SELECT series_id, rev, insertion_date, value_date, op, num FROM (SELECT *, lag(num) OVER (PARTITION BY series_id, value_date ORDER BY rev) AS was FROM log) WHERE num IS DISTINCT FROM was")
def history_diff(spark: SparkSession, d: str) -> DataFrame:
    return B.history_diff(log(spark, d), revisions(spark, d)).drop("txt")


@query("interval", f"WITH s AS ({_state()}) SELECT series_id, min(value_date) AS ts_start, max(value_date) AS ts_end FROM s GROUP BY series_id")
def interval(spark: SparkSession, d: str) -> DataFrame:
    return B.interval(log(spark, d))


@query("insertion_dates", f"WITH {_LOG}, {_REVISIONS} SELECT series_id, rev, insertion_date FROM revisions WHERE insertion_date BETWEEN '2024-01-03 00:00:00' AND '{T1}' AND ts_end >= '2024-01-05 00:00:00' AND ts_start <= '2024-01-06 00:00:00'")
def insertion_dates(spark: SparkSession, d: str) -> DataFrame:
    return B.insertion_dates(revisions(spark, d), from_insertion="2024-01-03 00:00:00", to_insertion=T1, start="2024-01-05 00:00:00", end="2024-01-06 00:00:00")


@query("insertion_dates_callback", f"WITH {_LOG}, {_REVISIONS} SELECT series_id, rev, insertion_date FROM revisions WHERE author = 'click' AND CAST(metadata->>'k' AS BIGINT) > 90")
def insertion_dates_callback(spark: SparkSession, d: str) -> DataFrame:
    where = (F.col("author") == "click") & (F.get_json_object("metadata", "$.k").cast("bigint") > 90)
    return B.insertion_dates(revisions(spark, d), where=where)


@query("log_latest", f"WITH {_LOG}, {_REVISIONS} SELECT * FROM revisions WHERE author IN ('click', 'view') QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY rev DESC) <= 5")
def log_latest(spark: SparkSession, d: str) -> DataFrame:
    return B.revision_log(revisions(spark, d), 5, authors=["click", "view"])


@query("first_last_idate", f"WITH {_LOG} SELECT series_id, min(insertion_date) AS first_date, max(insertion_date) AS last_date, max(rev) AS last_rev FROM log GROUP BY series_id")
def first_last_idate(spark: SparkSession, d: str) -> DataFrame:
    return B.first_last_insertion(revisions(spark, d))


@query("revision_at_after", f"WITH {_LOG} SELECT series_id, min(rev) AS rev FROM log WHERE insertion_date >= '{T1}' GROUP BY series_id")
def revision_at_after(spark: SparkSession, d: str) -> DataFrame:
    return B.revision_at(revisions(spark, d), T1, "after")


@query("previous_revision", f"WITH {_LOG} SELECT series_id, max(rev) AS rev FROM log WHERE rev < 500 GROUP BY series_id")
def previous_revision(spark: SparkSession, d: str) -> DataFrame:
    return B.previous_revision(revisions(spark, d), 500)


@query("strip", _state("insertion_date < '2024-01-10 12:00:00'"))
def strip(spark: SparkSession, d: str) -> DataFrame:
    kept, _ = B.strip(log(spark, d), revisions(spark, d), T1)
    return B.state_asof(kept).drop("txt")


def _blocks() -> list[tuple[int, datetime, datetime]]:
    return schedule(datetime(2024, 1, 2), datetime(2024, 2, 4), True, {"days": 1}, {"hour": 9}, "Europe/Brussels", {"days": 1}, {"hour": 0})


@query(
    "block_staircase_daily",
    # in winter the blocks begin at 23:00 UTC, of the day of their revision at 08:00 UTC
    f"WITH {_LOG}, iv AS (SELECT *, lead(insertion_date) OVER (PARTITION BY series_id, value_date ORDER BY rev) AS nx FROM log), "
    "b AS (SELECT n, TIMESTAMP '2024-01-01 08:00:00' + n * INTERVAL '1' DAY AS rd, TIMESTAMP '2024-01-01 23:00:00' + n * INTERVAL '1' DAY AS bs FROM range(0, 34) t(n)) "
    "SELECT series_id, value_date, arg_max(num, n) AS num FROM iv JOIN b ON rd >= insertion_date AND (nx IS NULL OR rd < nx) AND bs <= value_date WHERE num IS NOT NULL AND value_date BETWEEN '2024-01-02 00:00:00' AND '2024-02-04 00:00:00' GROUP BY series_id, value_date",
)
def block_staircase_daily(spark: SparkSession, d: str) -> DataFrame:
    return B.block_staircase(log(spark, d), _blocks(), "2024-01-02 00:00:00", "2024-02-04 00:00:00").drop("txt")


def _mapping(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, m) for i, m in enumerate(MEMBERS)], "series_id bigint, member string")


_WIDE = ", ".join(f"max(CASE WHEN series_id = {i} THEN num END) AS {m}" for i, m in enumerate(MEMBERS))


@query("group_wide", f"WITH s AS ({_state()}) SELECT value_date, {_WIDE} FROM s GROUP BY value_date")
def group_wide(spark: SparkSession, d: str) -> DataFrame:
    return G.group_get(log(spark, d), _mapping(spark), MEMBERS)


@query("group_insertion_dates", f"WITH {_LOG} SELECT DISTINCT insertion_date FROM log WHERE series_id < 3 AND insertion_date <= '{T1}'")
def group_insertion_dates(spark: SparkSession, d: str) -> DataFrame:
    return G.group_insertion_dates(revisions(spark, d), _mapping(spark).where("series_id < 3"), to_insertion=T1)


@query(
    "group_history",
    f"WITH {_LOG}, dt AS (SELECT DISTINCT insertion_date AS moment FROM log WHERE series_id < 3 AND insertion_date <= '2024-01-03 00:00:00'), h AS (SELECT moment, series_id, value_date, arg_max_null(num, rev) AS num FROM dt JOIN log ON insertion_date <= moment WHERE series_id < 3 GROUP BY ALL HAVING arg_max_null(num, rev) IS NOT NULL) "
    "SELECT moment AS insertion_date, value_date, max(CASE WHEN series_id = 0 THEN num END) AS m0, max(CASE WHEN series_id = 1 THEN num END) AS m1, max(CASE WHEN series_id = 2 THEN num END) AS m2 FROM h GROUP BY moment, value_date",
)
def group_history(spark: SparkSession, d: str) -> DataFrame:
    return G.group_history(log(spark, d), revisions(spark, d), _mapping(spark).where("series_id < 3"), MEMBERS[:3], to_insertion="2024-01-03 00:00:00")


def _layer(event_type: str) -> str:
    return f"SELECT series_id, value_date, arg_max_null(num, rev) AS num FROM log JOIN events ON rev = event_id WHERE event_type = '{event_type}' GROUP BY ALL"


def _layers(spark: SparkSession, d: str, *types: str) -> list[DataFrame]:
    rows = log(spark, d).join(_events(spark, d).select(F.col("event_id").alias("rev"), "event_type"), "rev")
    return [B.state_asof(rows.where(F.col("event_type") == t).drop("event_type"), keep_nans=True) for t in types]


@query("patch", f"WITH {_LOG}, a AS ({_layer('click')}), b AS (SELECT true AS there, * FROM ({_layer('error')})) SELECT series_id, value_date, CASE WHEN there THEN b.num ELSE a.num END AS num FROM a FULL JOIN b USING (series_id, value_date)")
def patch(spark: SparkSession, d: str) -> DataFrame:
    return B.patch(*_layers(spark, d, "click", "error")).drop("txt")


_MANY = ["view", "click", "error", "signup", "purchase"]


@query("patchmany", f"WITH {_LOG}, u AS ({' UNION ALL '.join(f'SELECT {i} AS layer, * FROM ({_layer(t)})' for i, t in enumerate(_MANY))}) SELECT series_id, value_date, num FROM u QUALIFY row_number() OVER (PARTITION BY series_id, value_date ORDER BY layer DESC) = 1")
def patchmany(spark: SparkSession, d: str) -> DataFrame:
    return B.patchmany(_layers(spark, d, *_MANY)).drop("txt")


@query(
    "diff",
    f"WITH {_LOG}, a AS (SELECT * FROM ({_layer('click')}) WHERE series_id <> 4), b AS ({_layer('error')} UNION ALL SELECT * FROM ({_layer('purchase')}) p WHERE NOT EXISTS (SELECT 1 FROM ({_layer('error')}) e WHERE e.series_id = p.series_id AND e.value_date = p.value_date)) "
    "SELECT b.series_id, b.value_date, b.num FROM b LEFT JOIN a ON a.series_id = b.series_id AND a.value_date = b.value_date WHERE b.series_id NOT IN (SELECT series_id FROM a) OR (a.series_id IS NOT NULL AND a.num IS DISTINCT FROM b.num AND NOT coalesce(abs(a.num - b.num) <= 1e-14, false)) OR (a.series_id IS NULL AND b.num IS NOT NULL)",
)
def diff(spark: SparkSession, d: str) -> DataFrame:
    click, error, purchase = _layers(spark, d, "click", "error", "purchase")
    return B.diff(click.where("series_id <> 4"), B.patch(purchase, error)).drop("txt")


@query(
    "replace_state",
    f"WITH {_LOG}, a AS (SELECT series_id, value_date, arg_max_null(num, rev) AS num FROM log GROUP BY ALL HAVING arg_max_null(num, rev) IS NOT NULL), b AS (SELECT * FROM ({_layer('purchase')}) WHERE num IS NOT NULL) "
    "SELECT coalesce(a.series_id, b.series_id) AS series_id, coalesce(a.value_date, b.value_date) AS value_date, CASE WHEN b.series_id IS NULL THEN 'drop' ELSE 'set' END AS op, b.num "
    "FROM a FULL JOIN b ON a.series_id = b.series_id AND a.value_date = b.value_date WHERE coalesce(a.series_id, b.series_id) IN (SELECT series_id FROM b) AND a.num IS DISTINCT FROM b.num",
)
def replace_state(spark: SparkSession, d: str) -> DataFrame:
    return B.replacement(B.state_asof(log(spark, d)), _layers(spark, d, "purchase")[0]).drop("txt")


@query("trimmed", f"WITH {_LOG}, e AS (SELECT series_id, min(value_date) AS lo, max(value_date) AS hi FROM log WHERE num IS NOT NULL AND rev < 40 GROUP BY series_id) SELECT log.series_id, value_date, num FROM log JOIN e USING (series_id) WHERE rev < 40 AND value_date BETWEEN lo AND hi")
def trimmed(spark: SparkSession, d: str) -> DataFrame:
    return B.trimmed(log(spark, d).where("rev < 40").select("series_id", "value_date", "num", "txt")).drop("txt")


@query("replicate", f"WITH {_LOG} SELECT series_id, rev, insertion_date, value_date, op, num FROM log WHERE series_id > 6 OR insertion_date > (SELECT max(insertion_date) FROM log t WHERE t.series_id = log.series_id AND t.insertion_date <= '{T1}')")
def replicate(spark: SparkSession, d: str) -> DataFrame:
    rows = log(spark, d)
    return B.replicate(rows, rows.where((F.col("series_id") <= 6) & (F.col("insertion_date") <= F.lit(T1).cast("timestamp_ntz")))).drop("txt")


@query("federated_state", _state("(series_id < 4) = (rev % 2 = 0)"))
def federated_state(spark: SparkSession, d: str) -> DataFrame:
    """Two sources: the first has even revisions of series 0-3; the second has odd ones of all, of which 0-3 are shadowed."""
    rows = log(spark, d)
    main, far = rows.where("series_id < 4 AND rev % 2 = 0"), rows.where("rev % 2 = 1")
    shadowed = main.select("series_id").distinct()
    return B.state_asof(main.unionByName(far.join(F.broadcast(shadowed), "series_id", "left_anti"))).drop("txt")


@query("catalog", f"WITH {_REGISTRY} SELECT source, name, 'primary' AS kind FROM registry")
def catalog(spark: SparkSession, d: str) -> DataFrame:
    return registry(spark, d).select("source", "name", F.lit("primary").alias("kind"))


_K = "try_cast(metadata->>'k' AS DOUBLE)"
_NUM = "json_type(metadata, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE')"
_FIND = {
    "find_by_name": ('(by.name "series view 12")', "name LIKE '%series%view%12%'"),
    "find_tzaware": ("(by.tzaware)", "tzaware"),
    "find_everything": ("(by.everything)", "true"),
    "find_metakey": ('(by.metakey "nil")', "json_exists(metadata, '$.nil')"),
    "find_metaitem": ('(by.metaitem "k" 42)', f"{_NUM} AND {_K} = 42"),
    "find_metaitem_text": ('(by.metaitem "k" "42")', "json_type(metadata, '$.k') = 'VARCHAR' AND metadata->>'k' = '42'"),
    "find_cmp": ('(>= "k" 90)', f"{_NUM} AND {_K} >= 90"),
    "find_at_most": ('(<= "k" 10)', f"{_NUM} AND {_K} <= 10"),
    "find_more": ('(> "k" 90)', f"{_NUM} AND {_K} > 90"),
    "find_equal": ('(= "k" 7)', f"{_NUM} AND {_K} = 7"),
    "find_equal_text": ('(= "unit" "MWh")', "json_type(metadata, '$.unit') = 'VARCHAR' AND metadata->>'unit' = 'MWh'"),
    "find_cmp_text": ('(< "unit" "N")', "json_type(metadata, '$.unit') = 'VARCHAR' AND metadata->>'unit' < 'N'"),
    "find_and_or_not": ('(by.and (by.tzaware) (by.or (by.name "error") (by.metaitem "unit" "MWh")) (by.not (< "k" 50)))', f"tzaware AND (name LIKE '%error%' OR metadata->>'unit' = 'MWh') AND NOT coalesce({_NUM} AND {_K} < 50, false)"),
    "find_source": ('(by.and (by.source "far") (by.name "click"))', "source = 'far' AND name LIKE '%click%'"),
}


def _find(text: str) -> Q:
    return lambda spark, d: registry(spark, d).where(S.predicate(S.parse(text))).select("name", "source")


for _name, (_text, _where) in _FIND.items():
    query(_name, f"WITH {_REGISTRY} SELECT name, source FROM registry WHERE {_where}")(_find(_text))


@query("find_limit", f"WITH {_REGISTRY} SELECT name FROM registry WHERE name LIKE '%click%' ORDER BY name LIMIT 7")
def find_limit(spark: SparkSession, d: str) -> DataFrame:
    return registry(spark, d).where(S.predicate(S.parse('(by.name "click")'))).select("name").orderBy("name").limit(7)


@query("federated_find", f"WITH {_REGISTRY} SELECT name, source FROM registry WHERE source = 'local' AND tzaware OR source = 'far' AND name LIKE '%view%'")
def federated_find(spark: SparkSession, d: str) -> DataFrame:
    return _federated(spark, d, '(by.or (by.and (by.source "local") (by.tzaware)) (by.and (by.source "far") (by.name "view")))')


def _federated(spark: SparkSession, d: str, text: str) -> DataFrame:
    """Each source answers its own query, in which tests of the source are folded away."""
    rows, out = registry(spark, d), None
    for source in ("local", "far"):
        mine = S.for_source(source, S.parse(text))
        part = rows.where(F.col("source") == source).where(S.predicate(mine) if mine else F.lit(False)).select("name", "source")
        out = part if out is None else out.unionByName(part)
    return out


@query("federated_find_not", f"WITH {_REGISTRY} SELECT name, source FROM registry WHERE NOT source = 'far' AND NOT (source = 'local' AND NOT tzaware)")
def federated_find_not(spark: SparkSession, d: str) -> DataFrame:
    return _federated(spark, d, '(by.and (by.not (by.source "far")) (by.not (by.and (by.source "local") (by.not (by.tzaware)))))')


@query("federated_find_or", f"WITH {_REGISTRY} SELECT name, source FROM registry WHERE source = 'far' OR name LIKE '%view%'")
def federated_find_or(spark: SparkSession, d: str) -> DataFrame:
    return _federated(spark, d, '(by.or (by.source "far") (by.name "view"))')


@query("overlaps", f"WITH {_LOG}, {_REVISIONS} SELECT series_id, rev, coalesce(ts_end >= TIMESTAMP '2024-01-05 00:00:00' AND ts_start <= TIMESTAMP '2024-01-06 00:00:00', false) AS meets FROM revisions")
def overlaps_query(spark: SparkSession, d: str) -> DataFrame:
    meets = overlaps(F.col("ts_start"), F.col("ts_end"), "2024-01-05 00:00:00", "2024-01-06 00:00:00")
    return revisions(spark, d).select("series_id", "rev", F.coalesce(meets, F.lit(False)).alias("meets"))


@query("revision_at_strict", f"WITH {_LOG} SELECT series_id, min(rev) AS rev FROM log WHERE insertion_date = (SELECT min(ts) FROM events WHERE event_id = 200) GROUP BY series_id")
def revision_at_strict(spark: SparkSession, d: str) -> DataFrame:
    moment = _events(spark, d).where("event_id = 200").agg(F.min(F.col("ts").cast("timestamp_ntz")).cast("string")).first()[0]
    return B.revision_at(revisions(spark, d), moment or T1)


@query("revision_at_before", f"WITH {_LOG} SELECT series_id, min(rev) AS rev FROM log WHERE insertion_date <= '{T1}' GROUP BY series_id")
def revision_at_before(spark: SparkSession, d: str) -> DataFrame:
    return B.revision_at(revisions(spark, d), T1, "before")


@query("bisect", "SELECT p_partkey, CASE WHEN p_size > 45 THEN 5 ELSE len(list_filter([5, 15, 25, 35, 45], lambda x: x <= p_size)) - 1 END AS j FROM part")
def bisect_query(spark: SparkSession, d: str) -> DataFrame:
    edges = F.array(*(F.lit(x) for x in (5, 15, 25, 35, 45)))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", bisect(edges, F.col("p_size")).cast("bigint").alias("j"))


@query("group_melt", "SELECT unnest(['a', 'b']) AS member, o_orderdate AS value_date, unnest([o_totalprice, CAST(o_custkey AS DOUBLE)]) AS num FROM orders WHERE o_orderkey < 500")
def group_melt(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet").where("o_orderkey < 500")
    return G.melt(o.select(F.col("o_orderdate").alias("value_date"), F.col("o_totalprice").alias("a"), F.col("o_custkey").cast("double").alias("b")), ["a", "b"])
