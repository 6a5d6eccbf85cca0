import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronostrata.llm import sharding as H


def least(sizes, k):
    """By dynamic programming."""
    inf = float("inf")
    best = [0] + [inf] * len(sizes)
    for _ in range(k):
        now = [0] + [inf] * len(sizes)
        for j in range(1, len(sizes) + 1):
            total = 0
            for i in range(j - 1, -1, -1):
                total += sizes[i]
                now[j] = min(now[j], max(best[i], total))
        best = now
    return best[-1]


def cuts(sizes, k, seen=None):
    """Of the module's search, with cells made here."""
    ends, total = np.unique(np.cumsum(sizes)), int(sum(sizes))

    def look(spans, width, low, high):
        e = ends[np.any([(ends >= lo) & (ends <= hi) for lo, hi in spans], axis=0)]
        cell = e // width
        first = e[np.concatenate(([True], cell[1:] != cell[:-1]))]
        last = e[np.concatenate((cell[1:] != cell[:-1], [True]))]
        if seen is not None:
            seen.append((len(first), len(spans)))
        return H.narrow(first, last, low, high, total, k)

    return H.cuts(look, total, int(max(sizes)), k)


def plain(sizes, k):
    """The cuts of the least capacity, by trying capacities one after the other over all atoms."""
    def runs(c):
        out, at, run = [], 0, 0
        for x in sizes:
            if run + x > c:
                out.append(at)
                run = 0
            run, at = run + x, at + x
        return out if max(sizes) <= c and len(out) < k else None

    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if runs(mid) is not None else (mid + 1, hi)
    return runs(lo)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=1, max_size=300), st.integers(1, 9), st.sampled_from([1, 2, 16]))
def test_cuts_are_those_of_all_atoms(sizes, k, cells):
    before, H.CELLS = H.CELLS, cells
    try:
        assert cuts(sizes, k) == (plain(sizes, k) if sum(sizes) else [])
    finally:
        H.CELLS = before


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=12), st.integers(1, 5))
def test_capacity_is_least(sizes, k):
    ends = np.unique(np.cumsum(sizes))
    at = [0, *cuts(sizes, k), sum(sizes)]
    assert len(at) - 1 <= k and max(b - a for a, b in zip(at, at[1:])) == least(sizes, k)
    assert set(at[1:]) <= set(ends.tolist())


def test_shards(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([1, 3, 40, 200])) for i in rng.sample(range(10**6), 3000)]
    df = spark.createDataFrame(rows, "k bigint, n int")
    for shards in (1, 7, 64):
        got = sorted(map(tuple, H.shard(df, "k", F.col("n"), shards).collect()))
        assert [g[:2] for g in got] == sorted(rows)
        order = [g[2] for g in got]
        assert order == sorted(order) and order[-1] < shards
        sums = [sum(g[1] for g in got if g[2] == s) for s in set(order)]
        sizes = [n for _, n in sorted(rows)]
        at = [0, *plain(sizes, shards), sum(sizes)]
        assert sums == [b - a for a, b in zip(at, at[1:])]


def test_one_large_atom_among_many_costs_the_driver_next_to_nothing(spark):
    rng = np.random.default_rng(3)
    sizes = rng.integers(500, 1500, 200_000)
    sizes[123_456] = 1_000_000
    seen = []
    assert cuts(sizes, 64, seen) == plain(sizes.tolist(), 64)
    # the cells of a round are bounded, rounds are few, and what the driver gets is two numbers a shard
    assert len(seen) <= 4 and all(n <= 2 * H.CELLS * 64 * 64 and spans <= 64 for n, spans in seen)
    df = spark.range(200_000).withColumn("n", F.when(F.col("id") == 77, 1_000_000).otherwise(F.col("id") % 1000 + 500))
    got = H.shard(df, "id", F.col("n")).groupBy("shard").agg(F.sum("size").alias("s"), F.max("key").alias("last")).orderBy("shard").collect()
    sizes = [1_000_000 if i == 77 else i % 1000 + 500 for i in range(200_000)]
    at = [0, *plain(sizes, 64), sum(sizes)]
    assert [r["s"] for r in got] == [b - a for a, b in zip(at, at[1:])]


def test_sizes_below_nothing_and_fractions(spark):
    df = spark.createDataFrame([("a", 2.9), ("b", -5.0), ("c", None), ("d", 2.0), (None, 1.0)], "k string, n double")
    assert sorted(((r["key"] or ""), r["size"], r["shard"]) for r in H.shard(df, "k", F.col("n"), 2).collect()) == [("", 1, 0), ("a", 2, 0), ("b", 0, 0), ("c", 0, 0), ("d", 2, 1)]


def test_odd_rows(odd, none):
    got = {r["key"]: (r["size"], r["shard"]) for r in H.shard(odd, "doc_id", F.octet_length("text"), 3).collect()}
    assert set(got) == {None, *range(10)} and got[0] == (0, 0) and got[8][0] == 3 * 9 * len("the same words here and there ")
    assert [got[k][1] for k in (None, *range(10))] == sorted(s for _, s in got.values())
    assert H.shard(none, "doc_id", F.octet_length("text")).count() == 0
