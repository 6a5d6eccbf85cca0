import math

import numpy as np
import pytest

from chronostrata.llm import ann as A
from chronostrata.llm import topk as T
from chronostrata.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>, rank int, cosine double"


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 16)) * 0.6
    x[7], x[8] = x[3], x[3]
    return spark.createDataFrame([(i, v.tolist(), 0, 0.0) for i, v in enumerate(x.astype(np.float32))], SCHEMA)


def brute(df, k=10):
    rows = df.collect()
    x = np.array([r["embedding"] for r in rows], float)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    s = np.round(x @ x.T, T.DIGITS)
    ids = np.array([r["vec_id"] for r in rows])
    out = {}
    for i in range(len(x)):
        order = [j for j in np.lexsort((ids, -s[i])) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[i, j])) for j in order]
    return out


def lists(df):
    out = {}
    for r in df.collect():
        out.setdefault(r[0], []).append((r["rank"], r["neighbour"], r["cosine"]))
    for v in out.values():
        v.sort()
        assert [x[0] for x in v] == list(range(1, len(v) + 1))
    return {i: [x[1:] for x in v] for i, v in out.items()}


@pytest.mark.parametrize("block", [100_000, 170])
def test_exact_search(table, block):
    got, want = lists(T.top_k(table, block=block)), brute(table)
    assert got.keys() == want.keys()
    for i in want:
        assert np.allclose([s for _, s in got[i]], [s for _, s in want[i]], atol=2e-6) and [j for j, _ in got[i]] == [j for j, _ in want[i]]


def test_best_decides_ties_by_id():
    s = np.array([[1.0, 2.0, 2.0, 2.0, 0.0, -np.inf]])
    ids = np.array([[5, 9, 3, 4, 1, 0]])
    assert T.best(s, ids, 2)[1].tolist() == [[3, 4]] and T.best(s, ids, 9)[1].tolist()[0][:5] == [3, 4, 9, 5, 1]


def test_recall(table, spark, sf):
    for df in (table, spark.read.parquet(f"{sf}/embeddings.parquet")):
        got, want = lists(A.neighbours(df)), brute(df)
        assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
        recall = np.mean([len({j for j, _ in got[i]} & {j for j, _ in want[i]}) / 10 for i in want])
        assert recall >= 0.9, recall


def test_asymmetric_distances_are_those_to_the_decoded_vectors():
    rng = np.random.default_rng(1)
    books = rng.normal(size=(4, 8, 3))
    codes = rng.integers(0, 8, (20, 4)).astype(np.uint8)
    decoded = np.concatenate([books[j][codes[:, j]] for j in range(4)], 1)
    r = rng.normal(size=(1, 12))
    far = sum(A.nearest(x, books[j])[:, codes[:, j]] for j, x in enumerate(A.split(r, 4)))[0] + (r * r).sum()
    assert np.allclose(far, ((decoded - r) ** 2).sum(1))


@pytest.mark.parametrize("search", [T.top_k, A.neighbours])
def test_odd_rows(spark, search):
    inf, nan = float("inf"), float("nan")
    bad = [(None, [1.0, 2.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 2.0, 3.0])]  # the last has no other of its length
    good = [(10, [1.0, 0.0]), (11, [1.0, 0.0]), (11, [1.0, 0.0]), (12, [0.0, 1.0]), (13, [-1.0, 1e-30])]
    df = spark.createDataFrame([(i, v, None, None) for i, v in bad + good], SCHEMA)
    got = search(df, k=3)
    rows = sorted(map(tuple, got.collect()))
    assert {r[0] for r in rows} == {10, 11, 12, 13}
    assert [r[1:3] for r in rows if r[0] == 10] == [(1, 11), (2, 11), (3, 12)]
    assert search(spark.createDataFrame([], SCHEMA)).count() == 0
    assert search(df.where("vec_id = 12")).count() == 0


def crowded(kind):
    rng = np.random.default_rng(3)
    if kind == "clusters":
        c = rng.normal(size=(20, 32))
        return c[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 32)) * 0.2
    x = rng.normal(size=(1500, 32))
    x[:600] = x[0]
    return x


@pytest.mark.parametrize("kind", ["clusters", "copies"])
def test_recall_where_many_are_near(spark, kind):
    x = crowded(kind).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0, 0.0) for i, v in enumerate(x)], SCHEMA)
    got, want = lists(A.neighbours(df)), brute(df)
    recall = np.mean([len({j for j, _ in got[i]} & {j for j, _ in want[i]}) / 10 for i in want])
    assert recall >= 0.95, recall


@pytest.mark.parametrize("kind", ["clusters", "copies"])
def test_a_chunk_loses_next_to_nothing(kind):
    x = T.unit(crowded(kind).astype(float))
    rng = np.random.default_rng(4)
    centres, ids = x[rng.integers(0, len(x), 3)], rng.permutation(len(x)) * 7
    of = A.nearest(x, centres).argmin(axis=1)
    books = A.split((x - centres[of])[rng.integers(0, len(x), 64)], 8)
    codes = np.stack([A.nearest(r, books[j]).argmin(axis=1) for j, r in enumerate(A.split(x - centres[of], 8))], 1).astype(np.uint8)
    part = A.Chunk(x, ids, np.arange(len(x)), codes, of, centres, books)
    want = np.round(x @ x.T, T.DIGITS)
    np.fill_diagonal(want, -np.inf)
    want_s, want_i = T.best(want, ids[None], 10)
    s, i = part.search_all(x, np.arange(len(x)), 10)
    assert np.mean([np.isin(a, b).mean() for a, b in zip(want_i, i)]) > 0.999
    s, i = part.search_lists(x, np.arange(len(x)), np.ones((len(x), 3), bool), want_s[:, -1], 10)
    assert np.mean([np.isin(a, b).mean() for a, b in zip(want_i, i)]) > 0.99
    half = np.zeros((len(x), 3), bool)
    half[:, 1] = True
    s, i = part.search_lists(x, np.arange(len(x)), half, np.full(len(x), -1.0), 10)
    inside = np.where(of == 1, want, -np.inf)
    assert np.mean([np.isin(a, b).mean() for a, b in zip(T.best(inside, ids[None], 10)[1], i)]) > 0.99


def test_chunks_hold_all_lists_once():
    rng = np.random.default_rng(5)
    centres, counts = rng.normal(size=(60, 8)), rng.integers(0, 400, 60)
    counts[3] = 90_000
    got = A.chunks(centres, counts, 2000)
    assert sorted(np.concatenate(got).tolist()) == np.flatnonzero(counts).tolist()
    assert all(counts[g].sum() <= 2000 or len(g) == 1 for g in got)


@pytest.mark.parametrize("search", [T.top_k, A.neighbours])
def test_text_ids_and_vectors_of_several_lengths(spark, search):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 4)).astype(np.float32)
    rows = [(f"n{i:03}", v.tolist(), 0, 0.0) for i, v in enumerate(x)] + [(f"m{i}", [1.0, float(i)], 0, 0.0) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<float>, rank int, cosine double")
    got = lists(search(df, k=5))
    want = brute(spark.createDataFrame([(i, v.tolist(), 0, 0.0) for i, v in enumerate(x)], SCHEMA), 5)
    assert len(got) == 63 and [j for j, _ in got["m0"]] == ["m1", "m2"]
    for i, v in want.items():
        assert [int(j[1:]) for j, _ in got[f"n{i:03}"]] == [j for j, _ in v]


def test_many_chunks_and_pieces_of_a_long_list(spark, monkeypatch):
    rng = np.random.default_rng(7)
    c = rng.normal(size=(30, 16))
    x = (c[rng.integers(0, 30, 4000)] + rng.normal(size=(4000, 16)) * 0.4).astype(np.float32)
    x[:900] = x[0] + rng.normal(size=(900, 16)) * 0.01
    monkeypatch.setattr(A, "BLOCK", 150)
    monkeypatch.setattr(A, "QUERIES", 1000)
    monkeypatch.setattr(A.chunks, "__defaults__", (150,))
    df = spark.createDataFrame([(i, v.tolist(), 0, 0.0) for i, v in enumerate(x)], SCHEMA)
    got, want = lists(A.neighbours(df)), brute(df)
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    recall = np.mean([len({j for j, _ in got[i]} & {j for j, _ in want[i]}) / 10 for i in want])
    assert recall >= 0.9, recall


@pytest.mark.parametrize("block", [None, 170])
def test_exact_search_of_some_rows_among_all(table, block):
    got, want = lists(T.top_k(table, block=block, queries=table.vec_id % 7 == 0)), brute(table)
    assert got.keys() == {i for i in want if i % 7 == 0}
    for i in got:
        assert np.allclose([s for _, s in got[i]], [s for _, s in want[i]], atol=2e-6) and [j for j, _ in got[i]] == [j for j, _ in want[i]]


def test_the_query_asks_for_every_fiftieth_id(spark, sf):
    got, want = lists(QUERIES["op6_topk"](spark, sf)), brute(spark.read.parquet(f"{sf}/embeddings.parquet"))
    assert got.keys() == {i for i in want if i % 50 == 0} and len(got) > 5
    for i in got:
        assert np.allclose([s for _, s in got[i]], [s for _, s in want[i]], atol=2e-6)


@pytest.mark.parametrize("near", [1e-2, 1e-3, 1e-4, 0.0])
@pytest.mark.parametrize("kind", [np.float32, np.float64])
def test_single_precision_loses_nothing(near, kind):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 64))
    for i in range(5):  # groups in which single precision can't tell the order
        x[i * 1000 : i * 1000 + 60] = x[i] + rng.normal(size=(60, 64)) * near
    if kind is np.float64:
        x *= 10.0 ** rng.integers(-200, 200, (6000, 1))
    x = x.astype(kind)
    ids, row = rng.permutation(6000) * 3, np.arange(6000)
    at = np.concatenate([np.arange(0, 6000, 50), np.arange(2000, 2030)])
    u = T.unit(x.astype(float))
    want = np.round(u[at] @ u.T, T.DIGITS)
    want[np.arange(len(at)), at] = -np.inf
    want_s, want_i = T.best(want, ids[None], 10)
    found = T.Best(x[at], row[at], 10)
    for part in np.split(rng.permutation(6000), [5, 1500, 4800]):
        found.add(x[part], ids[part], row[part])
    # products of other shapes may differ in the last digit, where rounding is on an edge
    assert np.allclose(found.score, want_s, atol=1.5e-6) and (found.score == want_s).mean() > 0.999
    same = (found.score == want_s).all(axis=1)
    assert (found.ids[same] == want_i[same]).all()


def test_the_grid_follows_the_work():
    assert T.grid(64, 51_282, 1026, 4, None, 6) == (1, 4)
    blocks, shards = T.grid(64, 15_000_000, 300_000, 4, None, 6)
    moved = (15_000_000 * blocks + 300_000 * shards) * 64 * 4 + 300_000 * shards * 160
    assert blocks == 1 and 18 <= shards <= 60 and moved < 12e9
    blocks, shards = T.grid(64, 15_000_000, 15_000_000, 4, None, 6)
    assert blocks == 40 and math.ceil(15_000_000 / blocks) * math.ceil(15_000_000 / shards) * 64 <= 1.1 * T.TASK_WORK
    assert T.grid(3, 1, 1, 8, None, 6) == (1, 1) and T.grid(16, 1500, 30, 4, 170, 4) == (1, 9)
