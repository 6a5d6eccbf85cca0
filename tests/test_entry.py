import math
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from chronostrata import queries as core

from .conftest import ROOT

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return "null" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, sf, sql, name):
    df = entry.queries()[name](spark, sf)
    want = sql.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(norm(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(norm(r[i]) for i in at) for r in want.fetchall())


def test_every_core_query_has_sql():
    assert set(core.QUERIES) == set(core.SQL)


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_no_core_plan_compares_all_pairs(spark, sf, name):
    plan = core.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_the_rest_works_without_the_llm_folders():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name in ("corpus_pipeline", "chronostrata.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
import chronostrata.api, chronostrata.sources.http, chronostrata.streaming.ingest
assert "state_latest" in e.queries() and not any(n.startswith("op") for n in e.queries()) and "pipeline" not in e.queries()
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT, timeout=120)


def test_nothing_else_imports_llm():
    found = subprocess.run(["grep", "-rlE", r"chronostrata\.llm|from \.+llm|import llm", ROOT, "--include=*.py"], capture_output=True, text=True).stdout.split()
    allowed = ("/chronostrata/llm/", "/tests/", "/corpus_pipeline.py", "/__spark_entry__.py")
    assert all(any(a in f for a in allowed) for f in found)
