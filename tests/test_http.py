from datetime import timedelta

import pandas as pd
import pytest

from chronostrata.api import TimeSeries
from chronostrata.sources import wire
from chronostrata.sources.http import Client, open_store, pack, serve, unpack

from .test_api import D, nan, plain, series


@pytest.fixture(scope="module", params=["binary", "json"])
def pair(spark, tmp_path_factory, request):
    tsa = TimeSeries(spark, str(tmp_path_factory.mktemp("http")))
    server = serve(tsa)
    uri = f"http://127.0.0.1:{server.server_address[1]}"
    yield tsa, open_store(spark, uri) if request.param == "binary" else Client(uri, binary=False)
    server.shutdown()


def test_binary_forms():
    same = lambda a, b: pd.testing.assert_series_equal(a, b, check_freq=False, check_index_type=False)
    some = [series([1.0, nan, float("inf")]).rename("a"), series(["x", None], tz=None).rename("b"), series([]).astype(float).rename("c"), series([2.0], tz="Europe/Paris").rename("d")]
    for s in some:
        meta, back = wire.unpack_series(wire.pack_series(s, {"k": 1}))
        assert meta == {"k": 1}
        same(back, s.tz_convert("UTC") if s.index.tz is not None else s)
    assert [m for m, _ in wire.unpack_many_series(wire.pack_many_series([({"n": i}, s) for i, s in enumerate(some)]))] == [{"n": i} for i in range(4)]
    history = {pd.Timestamp(D(1)): some[0], pd.Timestamp(D(2)): some[2]}
    meta, back = wire.unpack_history(wire.pack_history(history))
    assert list(back) == list(history) and meta == {}
    for d in history:
        same(back[d], history[d])
    assert wire.unpack_history(wire.pack_history({})) == ({}, {}) and wire.unpack_many_series(wire.pack_many_series([])) == []
    frame = pd.DataFrame({"n": [1.0, nan], "t": ["a", None]}, index=pd.date_range("2024-01-01", periods=2, tz="UTC"))
    pd.testing.assert_frame_equal(wire.unpack_group(wire.pack_group(frame)), frame, check_freq=False, check_index_type=False)
    got = wire.unpack_group_history(wire.pack_group_history({pd.Timestamp(D(1)): frame, pd.Timestamp(D(3)): frame[:0]}))
    assert [len(x) for x in got.values()] == [2, 0] and list(got[pd.Timestamp(D(3))].columns) == ["n", "t"]
    with pytest.raises(ValueError):
        wire.unpack_group(wire.pack_series(some[0]))


def test_pack():
    for s in (series([1.0, nan, float("inf")]), series(["a", None], tz=None), series([]).astype(float)):
        back = unpack(pack(s))
        assert back.index.equals(s.index) and back.isna().tolist() == s.isna().tolist() and back.dropna().tolist() == s.dropna().tolist()


def test_same_answers(pair, spark, tmp_path):
    tsa, c = pair
    assert isinstance(c, Client) and not c.exists("s") and c.get("s") is None and c.history("s") is None and c.insertion_dates("s") == []
    assert plain(c.update("s", series([1.0, 2.0, 3.0]), "me", {"k": 1}, D(1))) == {1: 1.0, 2: 2.0, 3: 3.0}
    c.replace("s", series([4.0, 5.0]), "me", insertion_date=D(2))
    for name, args in (("get", ()), ("get", (D(1), D(2))), ("staircase", (timedelta(0),)), ("block_staircase", (D(1), D(3)))):
        pd.testing.assert_series_equal(getattr(c, name)("s", *args), getattr(tsa, name)("s", *args), check_freq=False, check_index_type=False)
    assert [plain(s) for s in c.history("s").values()] == [plain(s) for s in tsa.history("s").values()]
    assert c.insertion_dates("s") == tsa.insertion_dates("s") and c.interval("s") == tsa.interval("s") and c.log("s") == tsa.log("s")
    c.update_metadata("s", {"unit": "MWh"})
    assert c.metadata("s") == tsa.metadata("s") == {"unit": "MWh"} and c.internal_metadata("s") == tsa.internal_metadata("s") and c.tzaware("s")
    assert c.find('(by.metakey "unit")', meta=True)[0].meta == {"unit": "MWh"} and c.catalog() == tsa.catalog()
    c.register_basket("b", "(by.everything)")
    assert c.basket("b") == ["s"] and c.basket_definition("b") == "(by.everything)" and c.list_baskets() == ["b"]
    c.delete_basket("b")
    with pytest.raises(ValueError, match="newer revision"):
        c.update("s", series([9.0]), "me", insertion_date=D(1))
    with pytest.raises(ValueError):
        c.find("(by.what)")
    here = TimeSeries(spark, str(tmp_path), secondaries={"remote": c})
    assert plain(here.get("s")) == {1: 4.0, 2: 5.0} and here.find('(by.source "remote")') == ["s"] and here.source("s") == "remote"
    c.strip("s", D(2))
    assert plain(c.get("s")) == {1: 1.0, 2: 2.0, 3: 3.0}
    c.rename("s", "t")
    c.delete("t")
    assert not c.exists("t")


def test_groups(pair):
    tsa, c = pair
    frame = pd.DataFrame({"a": [1.0, nan], "b": [2.0, 3.0]}, index=pd.date_range("2024-01-01", periods=2, tz="UTC"))
    c.group_replace("g", frame, "me", D(1))
    pd.testing.assert_frame_equal(c.group_get("g"), tsa.group_get("g"), check_freq=False, check_index_type=False)
    assert len(c.group_history("g")) == 1 and c.group_insertion_dates("g") == tsa.group_insertion_dates("g") and c.group_catalog() == tsa.group_catalog()
    c.update_group_metadata("g", {"k": 1})
    c.group_rename("g", "h")
    assert c.group_metadata("h") == {"k": 1} and c.group_type("h") == "primary" and c.group_get("g") is None
    c.group_delete("h")
    assert not c.group_exists("h")
