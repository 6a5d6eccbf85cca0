from datetime import timedelta

import pandas as pd
import pytest

from chronostrata import __main__ as cli
from chronostrata import config
from chronostrata.api import TimeSeries
from chronostrata.sources import store as S
from chronostrata.sources.http import Client, serve

from .test_api import D, nan, plain, series


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / "store")


@pytest.fixture
def tsa(spark, folder):
    tsa = TimeSeries(spark, folder)
    tsa.update("s", series([1.0, 2.0]), "me", insertion_date=D(1))
    tsa.update("t", series([3.0]), "me", insertion_date=D(1))
    tsa.group_replace("g", pd.DataFrame({"a": [1.0]}, index=pd.date_range("2024-01-01", periods=1, tz="UTC")), "me", D(1))
    return tsa


def test_a_bad_call_leaves_the_store_as_it_is(tsa, spark, folder):
    bad = [
        lambda: tsa.replace_metadata("no", {}), lambda: tsa.update_metadata("no", {}), lambda: tsa.update_internal_metadata("no", {}), lambda: tsa.strip("no", D(1)),
        lambda: tsa.group_rename("no", "x"), lambda: tsa.update_group_metadata("no", {}), lambda: tsa.rename("s", "  "), lambda: tsa.rename("s", "t"), lambda: tsa.group_rename("g", " "), lambda: tsa.group_rename("g", "g"),
        lambda: tsa.basket("no"), lambda: tsa.register_basket(" ", "(by.everything)"), lambda: tsa.store.commit([{"kind": "what"}]), lambda: tsa.store.commit([{"kind": "delete", "name": "no"}]),
    ]
    before = tsa.store.state().version
    for call in bad:
        with pytest.raises(ValueError):
            call()
    with pytest.raises(TypeError):
        tsa.replace_metadata("s", "text")
    other = TimeSeries(spark, folder)
    assert other.store.state().version == before and sorted(other.list_series()) == ["s", "t"] and plain(other.get("s")) == {1: 1.0, 2: 2.0}
    tsa.rename("no", "x")
    tsa.delete("no")
    tsa.group_delete("no")
    assert tsa.store.state().version == before


@pytest.mark.parametrize("call", [
    lambda t: t.delete("s"), lambda t: t.rename("s", "new"), lambda t: t.update_metadata("s", {"k": 1}), lambda t: t.replace_metadata("s", {"k": 1}), lambda t: t.update_internal_metadata("s", {"k": 1}),
    lambda t: t.group_delete("g"), lambda t: t.group_rename("g", "h"), lambda t: t.update_group_metadata("g", {"k": 1}), lambda t: t.strip("s", D(1)), lambda t: t.register_basket("b", "(by.everything)"),
])
def test_of_two_writers_one_comes_through(tsa, spark, folder, call, monkeypatch):
    other = TimeSeries(spark, folder)
    create, first = S.Files.create, []

    def create_late(files, name, text):
        if not first:  # another writer commits between this one's look and its commit
            first.append(name)
            call(other)
        return create(files, name, text)

    monkeypatch.setattr(S.Files, "create", create_late)
    with pytest.raises(S.ConcurrentWrite):
        call(tsa)
    monkeypatch.undo()
    fresh = TimeSeries(spark, folder)
    assert fresh.store.state().version == 4 and fresh.store.state() == tsa.store.state() == other.store.state()


def test_a_commit_that_cannot_be_replayed_has_no_effect(tsa, spark, folder):
    import json

    body = {"format": S.FORMAT, "changes": [{"kind": "delete", "name": "s"}, {"kind": "set", "name": "no", "entry": {}}], "points": [], "revisions": []}
    assert tsa.store.files.create(f"_commits/{tsa.store.state().version + 1:012d}.json", json.dumps(body))
    fresh = TimeSeries(spark, folder)
    assert sorted(fresh.list_series()) == ["s", "t"]
    fresh.update("s", series([5.0]), "me", insertion_date=D(2))
    assert plain(tsa.get("s")) == {1: 5.0, 2: 2.0}


def test_states_are_written_and_read(tsa, spark, folder, monkeypatch):
    monkeypatch.setattr(S, "EVERY", 3)
    for k in range(8):
        tsa.update_metadata("s", {"k": k})
    assert tsa.store.files.names("_states")
    seen = []
    read = S.Files.read
    monkeypatch.setattr(S.Files, "read", lambda files, name: seen.append(name) or read(files, name))
    fresh = TimeSeries(spark, folder)
    assert fresh.store.state() == tsa.store.state() and fresh.metadata("s") == {"k": 7} and len(seen) <= 4


def test_garbage_after_compaction(tsa, spark, folder):
    reader = TimeSeries(spark, folder)
    log = reader.store.log()
    tsa.update("s", series([9.0]), "me", insertion_date=D(3))
    tsa.store.write(tsa.store.log().withColumn("version", __import__("pyspark").sql.functions.lit(0).cast("bigint")), "points")  # of a commit that failed
    tsa.store.compact()
    assert log.count() == 4  # who was reading still can
    assert tsa.store.garbage() == []
    gone = tsa.store.garbage(timedelta(seconds=-1))
    assert len([x for x in gone if x.startswith("points")]) >= 4
    fresh = TimeSeries(spark, folder)
    assert plain(fresh.get("s")) == {1: 9.0, 2: 2.0} and plain(fresh.get("s", D(2))) == {1: 1.0, 2: 2.0} and len(fresh.log("s")) == 2
    assert cli.check(fresh) == []


def test_groups_of_texts(tsa):
    frame = pd.DataFrame({"n": [1.0, nan], "x.y": ["a", None], "e": [nan, nan]}, index=pd.date_range("2024-01-01", periods=2, tz="UTC"))
    tsa.group_replace("mix", frame, "me", D(1))
    got = tsa.group_get("mix")
    assert got["x.y"].tolist() == ["a"] and got["n"].tolist() == [1.0] and got["e"].isna().all() and got.columns.tolist() == ["n", "x.y", "e"]
    frame = pd.DataFrame({"n": [1.0, 2.0], "x.y": ["a", "b"], "e": ["late", None]}, index=frame.index)
    tsa.group_replace("mix", frame, "me", D(2))
    assert tsa.group_get("mix")["e"].tolist()[0] == "late" and tsa.group_get("mix")["x.y"].tolist() == ["a", "b"]
    assert [h["x.y"].tolist() for h in tsa.group_history("mix").values()] == [["a"], ["a", "b"]]
    with pytest.raises(ValueError, match="another type"):
        tsa.group_replace("mix", frame.assign(n="text"), "me", D(3))


def test_command_line(tsa, folder, capsys, tmp_path, monkeypatch):
    tsa.update("s", series([5.0]), "you", {"why": "x"}, D(2))
    run = lambda *a: (cli.main(list(a)), capsys.readouterr().out)
    assert [x.split()[-1] for x in run("get", folder, "s")[1].splitlines()] == ["5.0", "2.0"]
    assert "5.0" not in run("get", folder, "s", "--revision-date", "2024-01-01T12:00:00+00:00")[1]
    assert [x.split()[0] for x in run("log", folder, "s")[1].splitlines()] == ["1", "2"] and "you" in run("log", folder, "s", "--limit", "1")[1]
    assert run("history", folder, "s", "--diff")[1].count("2024-01-01 00:00:00+00:00") >= 1
    assert run("info", folder)[1].startswith("series count: 2") and run("list", folder)[1].split() == ["s", "t"] and run("find", folder, "--query", '(by.name "t")')[1].split() == ["t"]
    assert run("check", folder)[0] == 0 and run("compact", folder)[0] == 0 and run("garbage", folder)[0] == 0 and run("get", folder, "none") == (1, "no series 'none'\n")
    path = tmp_path / "c.cfg"
    monkeypatch.setenv(config.VARIABLE, str(path))
    path.write_text(f"[stores]\nmain = {folder}\n")
    assert run("configpath")[1].strip() == str(path) and run("list", "main")[1].split() == ["s", "t"]


def test_configuration(tsa, spark, folder, tmp_path):
    server = serve(tsa)
    uri = f"http://127.0.0.1:{server.server_address[1]}"
    path = tmp_path / "c.cfg"
    path.write_text(f"[stores]\nmain = {tmp_path}/main\nfar = {uri}\n[sources]\nmain = far:remote, {folder}\n[auth]\n{uri} = joe:a:b\nhttp://other = token:xyz\n")
    c = config.load(path)
    main = config.timeseries(spark, "main", config=c)
    assert list(main.secondaries) == ["remote", folder] and plain(main.get("s")) == {1: 1.0, 2: 2.0} and main.source("s") == "remote"
    far = config.timeseries(spark, "far", config=c)
    assert isinstance(far, Client) and far._headers["Authorization"].startswith("Basic ")
    assert config._auth(c, "http://other/deep") == {"token": "xyz"} and config._auth(c, "http://another") is None
    assert config.timeseries(spark, f"{tmp_path}/main", sources={}, config=c).get("s") is None
    assert [str(x) for x in main.find('(by.and (by.not (by.source "local")) (by.name "s"))')] == ["s", "s"] and main.find('(by.not (by.source "remote"))')[0].source == folder
    tsa.update("s", series([5.0]), "you", insertion_date=D(2))
    assert [r["author"] for r in far.log("s", authors=["you"])] == ["you"] and far.first_insertion_date("s") == tsa.first_insertion_date("s") and far.latest_insertion_date("s") == tsa.latest_insertion_date("s")
    assert far.last_id("s") == 2
    for mode in ("strict", "before", "after"):
        assert far.changeset_at("s", D(2), mode) == tsa.changeset_at("s", D(2), mode)
    assert far.changeset_at("s", D(3)) is None is tsa.changeset_at("s", D(3))
    server.shutdown()
