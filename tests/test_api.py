from datetime import date, datetime, timedelta, timezone

import numpy as np
import pandas as pd
import pytest

from chronostrata.api import TimeSeries, replicate_series
from chronostrata.sources.store import ConcurrentWrite
from chronostrata.streaming.ingest import ingest

nan = np.nan


def D(n):
    return datetime(2024, 1, n, tzinfo=timezone.utc)


def series(values, first=1, tz="UTC"):
    return pd.Series(values, index=pd.date_range(f"2024-01-{first:02}", periods=len(values), tz=tz))


def plain(s):
    return {k.day: v for k, v in s.items()}


@pytest.fixture(scope="module")
def tsa(spark, tmp_path_factory):
    return TimeSeries(spark, str(tmp_path_factory.mktemp("store")))


def test_life_of_a_series(tsa, spark):
    assert tsa.update("s", series([nan, nan]), "me") is None and not tsa.exists("s")
    assert plain(tsa.update(" s ", series([nan, 1.0, nan, 3.0, nan]), "me", insertion_date=D(1)).dropna()) == {2: 1.0, 4: 3.0}
    assert len(tsa.update("s", series([1, 3.0], 2).iloc[:1], "me", insertion_date=D(2))) == 0
    diff = tsa.update("s", series([nan, 2.0, 4.0], 2), "you", {"why": "test"}, D(3))
    assert diff.isna().tolist() == [True, False, False] and plain(tsa.get("s")) == {3: 2.0, 4: 4.0}
    assert plain(tsa.get("s", _keep_nans=True)).keys() == {2, 3, 4}
    assert plain(tsa.get("s", D(2))) == {2: 1.0, 4: 3.0} and len(tsa.get("s", datetime(2023, 1, 1))) == 0
    with pytest.raises(AssertionError, match="newer revision"):
        tsa.update("s", series([8.0]), "me", insertion_date=D(2))
    with pytest.raises(ValueError, match="complete erasure"):
        tsa.update("s", series([nan] * 5), "me", insertion_date=D(4))
    assert tsa.replace("s", series([2.0, 4.0], 3), "me", insertion_date=D(4)) is not None
    assert tsa.replace("s", series([2.0, 4.0], 3), "me", insertion_date=D(5)) is None
    assert [r["author"] for r in tsa.log("s")] == ["me", "you", "me"] and tsa.log("s", authors=["you"])[0]["meta"] == {"why": "test"}
    assert [d.day for d in tsa.insertion_dates("s")] == [1, 3, 4]
    assert {d.day: plain(s) for d, s in tsa.history("s").items()} == {1: {2: 1.0, 4: 3.0}, 3: {3: 2.0, 4: 4.0}, 4: {3: 2.0, 4: 4.0}}
    assert [d.day for d in tsa.history("s", from_value_date=D(3))] == [1, 3]
    assert tsa.interval("s") == pd.Interval(pd.Timestamp("2024-01-03", tz="UTC"), pd.Timestamp("2024-01-04", tz="UTC"), closed="both")
    assert plain(tsa.staircase("s", timedelta(days=1))) == {4: 4.0}
    assert tsa.first_insertion_date("s").day == 1 and tsa.latest_insertion_date("s").day == 4 and tsa.last_id("s") == 3
    assert tsa.changeset_at("s", D(3)) == 2 and tsa.changeset_at("s", D(3), "before") == 1 and tsa.changeset_at("s", D(2), "after") == 2 and tsa.changeset_at("s", D(2)) is None
    cache = tsa.history_cache("s", from_value_date=D(2))
    assert plain(cache.get(D(2))) == {2: 1.0, 4: 3.0} and plain(cache.staircase(timedelta(days=1))) == {4: 4.0}
    cache.close()
    assert "s" in tsa.list_series() and tsa.info()["series count"] >= 1 and tsa.history_cache("none") is None
    tsa.strip("s", D(3))
    assert plain(tsa.get("s")) == {2: 1.0, 4: 3.0}
    tsa.strip("s", D(1))
    assert tsa.history("s") == {} and len(tsa.get("s")) == 0
    with pytest.raises(ValueError):
        tsa.update("s", series([1.0]), "me")
    tsa.delete("s")
    tsa.delete("s")
    assert tsa.get("s") is None and tsa.log("s") == [] and tsa.history("s") is None
    with pytest.raises(ValueError):
        tsa.interval("s")


def test_validation(tsa):
    tsa.update("v", series([1, 2]), "me")
    assert tsa.get("v").dtype == "float64"
    for bad in (pd.Series([1.0]), series([True]), pd.Series([1.0, 2.0], index=pd.DatetimeIndex(["2024-01-01"] * 2, tz="UTC")), pd.Series([1.0], index=pd.DatetimeIndex([pd.NaT])), [1], pd.Series([1.0], index=pd.DatetimeIndex([pd.Timestamp(1)]))):
        with pytest.raises((AssertionError, ValueError)):
            tsa.update("w", bad, "me")
    for s in (series([1.0], tz=None), series(["a"])):
        with pytest.raises(ValueError):
            tsa.update("v", s, "me")
    for author, name in ((3, "v"), ("me", "  ")):
        with pytest.raises(AssertionError):
            tsa.update(name, series([1.0]), author)
    with pytest.raises(TypeError):
        tsa.get("v", from_value_date=date(2024, 1, 1))


def test_text_and_naive(tsa):
    tsa.update("t", series(["a", "b", None, "d"]), "me", insertion_date=D(1))
    tsa.update("t", series([None, "c"]), "me", insertion_date=D(2))
    assert plain(tsa.get("t")) == {2: "c", 4: "d"}
    tsa.update("n", series([1.0, 2.0], tz=None), "me")
    assert plain(tsa.get("n", from_value_date=datetime(2024, 1, 2, tzinfo=timezone(timedelta(hours=5))))) == {2: 2.0} and not tsa.tzaware("n")


def test_search_and_metadata(tsa):
    tsa.update_metadata("t", {"unit": "MWh", "rank": 2})
    tsa.update_metadata("t", {"rank": 3})
    assert tsa.metadata("t") == {"unit": "MWh", "rank": 3} and tsa.metadata("none") is None
    assert tsa.find('(by.and (by.tzaware) (> "rank" 2))', meta=True)[0].meta["unit"] == "MWh"
    tsa.register_basket("b", '(by.name "t")')
    assert tsa.basket("b") == ["t"] and tsa.list_baskets() == ["b"]
    tsa.delete_basket("b")
    assert tsa.list_baskets() == []
    tsa.rename("t", "u")
    assert plain(tsa.get("u")) == {2: "c", 4: "d"} and tsa.get("t") is None
    tsa.update_internal_metadata("u", {"formula": "x"})
    assert tsa.internal_metadata("u")["value_type"] == "object" and tsa.internal_metadata("u")["formula"] == "x"


def test_federation_and_replication(tsa, spark, tmp_path):
    tsa.update("far", series([1.0, 2.0, 3.0]), "me", insertion_date=D(1))
    tsa.replace("far", series([5.0]), "me", insertion_date=D(2))
    here = TimeSeries(spark, str(tmp_path), "here", {"there": tsa})
    here.update("near", series([7.0]), "me")
    assert plain(here.get("far")) == {1: 5.0} and here.source("far") == "there" and here.source("near") == "local"
    assert plain(here.staircase("far", timedelta(0))) == {1: 1.0} and here.staircase("nowhere", timedelta(0)) is None
    for call in (lambda: here.update("far", series([1.0]), "me"), lambda: here.delete("far"), lambda: here.rename("far", "x"), lambda: here.rename("near", "far"), lambda: here.strip("far", D(1))):
        with pytest.raises(ValueError):
            call()
    assert here.find('(by.name "ar")') == ["far", "near"] and here.find('(by.and (by.source "there") (by.name "far"))') == ["far"]
    assert replicate_series(tsa, here, "far", "copy") == 2 and plain(here.get("copy")) == {1: 5.0} and plain(here.get("copy", D(1))) == {1: 1.0, 2: 2.0, 3: 3.0}
    tsa.update("far", series([6.0]), "me", insertion_date=D(3))
    assert replicate_series(tsa, here, "far", "copy") == 1 and replicate_series(tsa, here, "far", "copy") == 0
    assert len(here.history("copy")) == 3 and plain(here.get("copy")) == {1: 6.0}
    with pytest.raises(ConcurrentWrite):
        here.store.commit([], base=here.store.state().version - 1)
    here.store.compact()
    assert plain(here.get("copy", D(2))) == {1: 5.0} and plain(TimeSeries(spark, str(tmp_path), "here").get("near")) == {1: 7.0}


def test_groups(tsa):
    wide = lambda a, b: pd.DataFrame({"a": a, "b": b}, index=pd.date_range("2024-01-01", periods=2, tz="UTC"))
    tsa.group_replace("g", wide([1.0, 2.0], [3.0, nan]), "me", D(1))
    tsa.group_replace("g", wide([1.0, 2.0], [3.0, 4.0]), "me", D(2))
    assert tsa.group_get("g", D(1)).isna().sum().sum() == 1 and tsa.group_get("g")["b"].tolist() == [3.0, 4.0]
    hist = tsa.group_history("g")
    assert [d.day for d in hist] == [1, 2] and hist[min(hist)]["a"].tolist() == [1.0, 2.0]
    assert [d.day for d in tsa.group_insertion_dates("g")] == [1, 2]
    with pytest.raises(ValueError):
        tsa.group_replace("g", wide([1.0, 2.0], [3.0, 4.0]).rename(columns={"b": "c"}), "me")
    tsa.update_group_metadata("g", {"k": 1})
    tsa.group_rename("g", "h")
    assert tsa.group_metadata("h") == {"k": 1} and tsa.group_get("g") is None and tsa.group_exists("h")
    tsa.group_delete("h")
    assert tsa.group_catalog() == {}


def test_bulk_and_streams(tsa, spark, tmp_path):
    rows = [(f"bulk.{i}", datetime(2024, 1, d), float(i + d)) for i in range(5) for d in (1, 2)]
    schema = "name string, value_date timestamp_ntz, num double"
    df = spark.createDataFrame(rows, schema)
    assert tsa.update_many(df, "me", D(1)) == 5 and tsa.update_many(df, "me", D(2)) == 0
    assert plain(tsa.get("bulk.3")) == {1: 4.0, 2: 5.0}
    df.withColumn("num", df.num + 1).where("name = 'bulk.1' OR name = 'bulk.2'").write.parquet(str(tmp_path / "in"))
    ingest(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), tsa, "stream", str(tmp_path / "check")).awaitTermination()
    assert plain(tsa.get("bulk.1")) == {1: 3.0, 2: 4.0} and plain(tsa.get("bulk.0")) == {1: 1.0, 2: 2.0}
