import random
from datetime import datetime

import pandas as pd
import pytest

from chronostrata.functions import schedule as C
from chronostrata.functions.schedule import schedule
from chronostrata.operators import groups as G
from chronostrata.operators import search as S
from chronostrata.plans import bitemporal as B


def names(spark, text):
    rows = [
        ("find.me.1", True, '{"foo": 42}', "local"), ("find.me.2", True, '{"foo": 43, "bar": "Hello"}', "local"), ("find.naive", False, '{"weight": 42, "birthdate": "1973-5-20", "ok": true}', "far"),
        ("other", False, '{"foo": "42", "nil": null, "x": 4.25e1}', "far"), ("empty", True, None, "local"), ("b\\"[:1] + "d", False, "not json", "local"),
    ]
    df = spark.createDataFrame(rows, "name string, tzaware boolean, metadata string, source string")
    return {r["name"] for r in df.where(S.predicate(S.parse(text))).collect()}


def test_predicates(spark):
    every = {"find.me.1", "find.me.2", "find.naive", "other", "empty", "bd"}
    cases = {
        "(by.everything)": every,
        "(by.tzaware)": {"find.me.1", "find.me.2", "empty"},
        '(by.name "find  me")': {"find.me.1", "find.me.2"},
        '(by.name "FIND")': set(),
        '(by.name "f_nd")': {"find.me.1", "find.me.2", "find.naive"},
        '(by.metakey "nil")': {"other"},
        '(by.metakey "foo")': {"find.me.1", "find.me.2", "other"},
        '(by.metaitem "foo" 42)': {"find.me.1"},
        '(by.metaitem "foo" "42")': {"other"},
        '(by.metaitem "nil" nil)': {"other"},
        '(by.metaitem "ok" #t)': {"find.naive"},
        '(by.metaitem "x" 42.5)': {"other"},
        '(>= "foo" 42)': {"find.me.1", "find.me.2"},
        '(< "foo" 43.5)': {"find.me.1", "find.me.2"},
        '(= "bar" "Hello")': {"find.me.2"},
        '(> "birthdate" "1973")': {"find.naive"},
        '(by.source "far")': {"find.naive", "other"},
        '(by.and (by.tzaware) (by.or (by.metaitem "foo" 43) (by.name "empty")))': {"find.me.2", "empty"},
        '(by.not (by.or (by.tzaware) (by.name "other")))': {"find.naive", "bd"},
        '(by.not (>= "foo" 42))': every - {"find.me.1", "find.me.2"},
    }
    for text, want in cases.items():
        assert names(spark, text) == want, text
        assert S.parse(S.parse(text).expr()) == S.parse(text)


def test_syntax():
    for text in ("", "by.name", "(by.name)", '(by.name 3)', '(by.name "a" "b")', "(by.not)", '(by.and "a")', "(by.what 1)", "(by.everything", "(by.everything))", '(< "a" nil)', "()", '(by.metaitem "k" (by.everything))', "(by.name x)"):
        with pytest.raises(SyntaxError):
            S.parse(text)


def test_sources_fold_away():
    ask = lambda source, text: (q := S.for_source(source, S.parse(text))) and q.expr()
    tree = '(by.or (by.and (by.source "a") (by.tzaware)) (by.and (by.source "b") (by.name "x")))'
    assert ask("a", tree) == "(by.tzaware)" and ask("b", tree) == '(by.name "x")' and ask("c", tree) is None
    assert ask("a", '(by.not (by.source "a"))') is None and ask("b", '(by.not (by.source "a"))') == "(by.everything)"
    assert ask("a", '(by.and (by.source "a") (by.source "b"))') is None
    assert ask("a", '(by.or (by.source "a") (by.name "x"))') == "(by.everything)" and ask("b", '(by.or (by.source "a") (by.name "x"))') == '(by.name "x")'
    assert ask("b", '(by.not (by.and (by.source "a") (by.name "x")))') == "(by.everything)" and ask("a", '(by.not (by.and (by.source "a") (by.name "x")))') == '(by.not (by.name "x"))'


def replay(states, start, end, freq, time, tz, late, maturity):
    """A block staircase step by step over states (date -> {value date: value}), as it is defined."""
    shift = lambda spec: pd.offsets.BusinessDay(spec["bdays"]) if "bdays" in spec else pd.DateOffset(**spec) if spec else pd.DateOffset(days=0)
    put = lambda t, spec: t.replace(**{k: v for k, v in spec.items() if k != "weekday"}) if "weekday" not in spec else (t + pd.DateOffset(**spec))
    block = lambda r: put(r + shift(late), maturity)
    r = put(put(start.tz_convert(tz), maturity) - shift(late), time)
    while block(r) > start:
        r = r - shift(freq)
    out = {}
    while block(r) <= end:
        known = [d for d in states if d <= r]
        state = states[max(known)] if known else {}
        out.update({v: x for v, x in state.items() if max(block(r), start) <= v <= end})
        r = r + shift(freq)
    return out


@pytest.mark.parametrize("tz", ["UTC", "Europe/Brussels", "America/New_York"])
@pytest.mark.parametrize("freq, time, late, maturity", [
    ({"days": 1}, {"hour": 0}, {}, {}), ({"days": 1}, {"hour": 9}, {"days": 1}, {"hour": 6}), ({"bdays": 1}, {"hour": 10}, {"bdays": 1}, {"hour": 0}),
    ({"hours": 6}, {"hour": 3}, {"hours": 12}, {}), ({"weeks": 1}, {"weekday": 0, "hour": 8}, {"days": 2}, {"hour": 0}), ({"days": 2}, {"hour": 23}, {"hours": 5}, {"minute": 30}), ({"months": 1}, {"day": 1, "hour": 0}, {"weeks": 1}, {}),
])
def test_block_staircases_are_those_of_a_replay(spark, tz, freq, time, late, maturity):
    rng = random.Random(str((tz, freq, time)))
    for first in ("2024-03-25", "2024-10-20", "2024-02-01"):
        states, rows, now = {}, [], {}
        date = pd.Timestamp(first, tz="UTC") - pd.Timedelta(days=6)
        for rev in range(1, 45):
            date += pd.Timedelta(minutes=rng.choice([37, 360, 725, 1440]))
            for _ in range(12):
                v = pd.Timestamp(first, tz="UTC") + pd.Timedelta(hours=rng.randrange(0, 24 * 14))
                if any(r[1] == rev and r[3] == v for r in rows):
                    continue
                op = rng.choice(["set", "set", "set", "erase"])
                x = float(rev) if op == "set" else None
                now = {**{k: y for k, y in now.items() if k != v}, **({v: x} if op == "set" else {})}
                rows.append((1, rev, date, v, op, x, None))
            states[date] = now
        start, end = pd.Timestamp(first, tz="UTC") + pd.Timedelta(hours=30), pd.Timestamp(first, tz="UTC") + pd.Timedelta(days=12)
        plain = lambda t: t.tz_localize(None).to_pydatetime()
        log = spark.createDataFrame([(i, r, plain(d), plain(v), o, x, t) for i, r, d, v, o, x, t in rows], B.LOG)
        plan = schedule(plain(start), plain(end), True, freq, time, tz, late, maturity)
        got = {pd.Timestamp(r["value_date"], tz="UTC"): r["num"] for r in B.block_staircase(log, plan, plain(start), plain(end)).collect()}
        assert got == replay(states, start, end, freq, time, tz, late, maturity), (first, tz)


def test_schedule():
    days = C.schedule(datetime(2021, 3, 27), datetime(2021, 3, 30), True, {"days": 1}, {"hour": 9}, "Europe/Brussels", {"days": 1}, {"hour": 0})
    assert [(r.day, r.hour) for _, r, _ in days] == [(25, 8), (26, 8), (27, 8), (28, 7), (29, 7)][: len(days)] or days[0][2] <= datetime(2021, 3, 27)
    assert [b for *_, b in days] == sorted(b for *_, b in days) and days[0][2] <= datetime(2021, 3, 27) < days[1][2]
    work = C.schedule(datetime(2024, 1, 1), datetime(2024, 1, 12), False, {"bdays": 1}, {"hour": 6}, "UTC", {"bdays": 1})
    assert all(r.weekday() < 5 for _, r, _ in work)
    with pytest.raises(TypeError):
        C.shift_offset([1])
    with pytest.raises(ValueError):
        C.shift_offset({"day": 1})
    with pytest.raises(ValueError):
        C.shift_offset({"bdays": 1, "days": 1})
    with pytest.raises(ValueError):
        C.replace_offset({"weekday": 1}, weekday=False)
    with pytest.raises(C.BlockStaircaseRevisionError):
        C.schedule(datetime(2024, 1, 1), datetime(2024, 1, 5), True, {"hours": 1}, {"hour": 3}, "UTC", None, {"hour": 0})


def test_group_columns():
    G.check_columns(["a", "b"], ["b", "a"])
    for columns in (["a", "a", "b"], ["a", "b", "c"], ["a"]):
        with pytest.raises(ValueError):
            G.check_columns(columns, ["a", "b"])
