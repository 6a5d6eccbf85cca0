"""The set-based plans against a plain replay of revisions, with erasures, replacements and infinities."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chronostrata.functions.schedule import schedule
from chronostrata.plans import bitemporal as B

T0 = datetime(2024, 1, 1)
DAY = timedelta(days=1)


def make(seed, n_series=12, n_revs=8):
    """Log rows, revision rows and, for each series, [(rev, date, state)], a state holding None for erased points."""
    rng = random.Random(seed)
    log, revs, states = [], [], {}
    for s in range(n_series):
        state, date, states[s] = {}, T0 + timedelta(hours=rng.randrange(48)), []
        for rev in range(1, rng.randint(2, n_revs) + 1):
            date += timedelta(hours=rng.randint(1, 60))
            points = {T0 + DAY * rng.randrange(12): rng.choice([1.0, 2.0, 3.5, float("inf"), None]) for _ in range(rng.randint(1, 6))}
            if rev > 1 and rng.random() < 0.3:
                points = {d: v for d, v in points.items() if v is not None} or {T0: 1.0}
                rows = [(d, "drop", None) for d in state if d not in points] + [(d, "set", v) for d, v in points.items() if state.get(d, "x") != v]
                state = dict(points)
            else:
                some = any(v is not None for v in state.values())
                rows = [(d, "erase" if v is None else "set", v) for d, v in points.items() if (not some or (state[d] != v if d in state and state[d] is not None else v is not None))]
                state = {**state, **{d: v for d, _, v in rows}}
            log += [(s, rev, date, d, op, v, None) for d, op, v in rows]
            shown = [d for d, v in state.items() if v is not None]
            revs.append((s, rev, date, "me", "{}", min(shown, default=None), max(shown, default=None)))
            states[s].append((rev, date, dict(state)))
    return log, revs, states


@pytest.fixture(scope="module", params=[1, 2])
def world(spark, request):
    log, revs, states = make(request.param)
    return spark.createDataFrame(log, B.LOG), spark.createDataFrame(revs, B.REVISIONS), states


def shown(state, nans=False):
    return {d: v for d, v in state.items() if nans or v is not None}


def asof(history, moment):
    return next((st for _, d, st in reversed(history) if d <= moment), {})


def points(df, *keys):
    return {tuple(r[k] for k in (*keys, "series_id", "value_date")): r["num"] for r in df.collect()}


def test_state(world):
    log, _, states = world
    lo, hi = T0 + 2 * DAY, T0 + 8 * DAY
    for moment in (None, T0 + 3 * DAY, T0 + 6 * DAY, T0 - DAY):
        for nans in (False, True):
            want = {(s, d): v for s, h in states.items() for d, v in shown(asof(h, moment or datetime.max), nans).items()}
            assert points(B.state_asof(log, moment, keep_nans=nans)) == want
            assert points(B.state_asof(log, moment, lo, hi, nans)) == {k: v for k, v in want.items() if lo <= k[1] <= hi}


def test_history(world):
    log, revs, states = world
    for nans in (False, True):
        want = {(rev, s, d): v for s, h in states.items() for rev, _, st in h for d, v in shown(st, nans).items()}
        assert points(B.history(log, revs, keep_nans=nans), "rev") == want
    lo, hi = T0 + 3 * DAY, T0 + 7 * DAY
    want = {}
    for s, h in states.items():
        last = None
        for rev, _, st in h:
            ends = shown(st)
            if not ends or max(ends) < lo or min(ends) > hi:
                continue
            cut = {d: v for d, v in ends.items() if lo <= d <= hi}
            if cut and cut != last:
                want |= {(rev, s, d): v for d, v in cut.items()}
            last = cut or last
    assert points(B.history(log, revs, start=lo, end=hi), "rev") == want


def test_history_diff(world):
    log, revs, states = world
    want = {}
    for s, h in states.items():
        old = {}
        for rev, _, st in h:
            want |= {(rev, s, d): v for d, v in st.items() if v != old.get(d)}
            old = st
    assert points(B.history_diff(log, revs), "rev") == want
    some = points(B.history_diff(log, revs, from_insertion=T0 + 4 * DAY), "rev")
    first = {s: next((r for r, d, _ in h if d >= T0 + 4 * DAY), 99) for s, h in states.items()}
    assert some == {k: v for k, v in want.items() if k[0] >= first[k[1]]}


def test_staircase(world):
    log, _, states = world
    for delta in (timedelta(0), timedelta(hours=30), 3 * DAY):
        want = {(s, d): v for s, h in states.items() for d in h[-1][2] if (v := asof(h, d - delta).get(d)) is not None}
        assert points(B.staircase(log, delta)) == want


def test_block_staircase(world):
    log, _, states = world
    lo, hi = T0 + DAY, T0 + 10 * DAY
    plan = schedule(lo, hi, True, {"days": 1}, {"hour": 9}, "Europe/Brussels", {"days": 1}, {"hour": 0})
    want = {}
    for s, h in states.items():
        if not any(lo <= d <= hi for d in h[-1][2]):
            continue
        for _, rd, bs in plan:
            want |= {(s, d): v for d, v in shown(asof(h, rd)).items() if max(bs, lo) <= d <= hi}
    assert points(B.block_staircase(log, plan, lo, hi)) == want


def test_revisions(world):
    log, revs, states = world
    want = {s: (min(e), max(e)) for s, h in states.items() if (e := shown(h[-1][2]))}
    assert {r["series_id"]: (r["ts_start"], r["ts_end"]) for r in B.interval(log).collect()} == want
    last = {(r["series_id"], r["rev"]) for r in B.revision_log(revs, 2).collect()}
    assert last == {(s, r) for s, h in states.items() for r, *_ in h[-2:]}
    cut, rest = B.strip(log, revs, T0 + 5 * DAY)
    kept = {(s, r) for s, h in states.items() for r, d, _ in h if d < T0 + 5 * DAY}
    assert {(r["series_id"], r["rev"]) for r in rest.collect()} == kept
    assert points(B.state_asof(cut)) == {(s, d): v for s, h in states.items() for d, v in shown(asof(h, T0 + 5 * DAY - timedelta(seconds=1))).items()}
    target = log.where("rev <= 2")
    copied = target.unionByName(B.replicate(log, target))
    assert points(B.state_asof(copied)) == points(B.state_asof(log))
    with pytest.raises(ValueError):
        B.revision_at(revs, T0, "never")


def frame(spark, rows):
    return spark.createDataFrame([(1, T0 + DAY * d, v, None) for d, v in rows], "series_id bigint, value_date timestamp_ntz, num double, txt string")


def days(df):
    return {(r["value_date"] - T0).days: r["num"] for r in df.collect()}


def test_diff_and_patch(spark):
    inf = float("inf")
    base = frame(spark, [(0, 1.0), (1, 2.0), (2, None), (3, inf), (4, 5.0)])
    other = frame(spark, [(0, 1.0 + 1e-15), (1, None), (2, None), (3, inf), (4, 5.1), (5, None), (6, 6.0)])
    assert days(B.diff(base, other)) == {1: None, 4: 5.1, 6: 6.0}
    empty = frame(spark, [])
    assert days(B.diff(empty, other)) == days(other) and days(B.diff(frame(spark, [(0, None)]), other)) == days(other)
    assert days(B.patch(base, frame(spark, [(0, None), (9, 9.0)]))) == {0: None, 1: 2.0, 2: None, 3: inf, 4: 5.0, 9: 9.0}
    assert days(B.patch(empty, base)) == days(base) == days(B.patch(base, empty))
    assert days(B.trimmed(frame(spark, [(0, None), (1, 1.0), (2, None), (3, 2.0), (4, None)]))) == {1: 1.0, 2: None, 3: 2.0}
    rows = {(r["value_date"] - T0).days: (r["op"], r["num"]) for r in B.replacement(base, frame(spark, [(0, 1.0), (1, 3.0), (7, 7.0)])).collect()}
    assert rows == {1: ("set", 3.0), 2: ("drop", None), 3: ("drop", None), 4: ("drop", None), 7: ("set", 7.0)}


def test_bounds_reach_the_scan(spark, tmp_path):
    log, *_ = make(1)
    spark.createDataFrame(log, B.LOG).write.parquet(str(tmp_path / "log"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    df = B.state_asof(spark.read.parquet(str(tmp_path / "log")), T0 + 3 * DAY, T0, T0 + DAY)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(insertion_date" in plan and "GreaterThanOrEqual(value_date" in plan


def test_changes_of_a_long_series_in_parts(spark, monkeypatch):
    """Parts of a series are told from later ones, also where no revision of theirs is selected."""
    rng = random.Random(3)
    rows, revs = [], []
    for rev in range(1, 60):
        day = T0 + timedelta(hours=rev)
        for v in rng.sample(range(12), 3):
            op = rng.choice(["set", "set", "erase", "drop"])
            rows.append((1, rev, day, T0 + timedelta(days=v), op, float(rng.randrange(3)) if op == "set" else None, None))
        revs.append((1, rev, day, "me", "{}", T0, T0 + timedelta(days=12)))
    log, revisions = spark.createDataFrame(rows, B.LOG), spark.createDataFrame(revs, B.REVISIONS)
    chosen = F.col("rev").isin([5, 6, 23, 24, 50])
    for bounds in ({}, {"from_insertion": T0 + timedelta(hours=7), "to_insertion": T0 + timedelta(hours=41)}):
        want = None
        for part in (4096, 7, 1):
            monkeypatch.setattr(B, "REVS", part)
            got = sorted(map(str, B.history_diff(log, revisions, **bounds, include_drops=True).collect()))
            want = want or got
            assert got == want and len(got) > 50
    state = {}
    for part in (4096, 9):
        monkeypatch.setattr(B, "REVS", part)
        got = B.history_diff(log, revisions.where(chosen), include_drops=True).collect()
        state[part] = sorted(map(str, got))
        assert {r["rev"] for r in got} <= {5, 6, 23, 24, 50}
    assert state[4096] == state[9] and state[9]
