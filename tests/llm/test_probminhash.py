import random
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from chronostrata.llm import probminhash as P
from chronostrata.llm.words import word_hashes


def naive(x, y):
    out = 0.0
    for d in x.keys() & y.keys():
        out += 1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in x.keys() | y.keys())
    return out


def arrays(c):
    k = np.array(sorted(c), np.uint64)
    return k, np.array([c[i] for i in k.tolist()], float)


BAG = st.dictionaries(st.integers(0, 12), st.integers(1, 5), max_size=9)


@settings(max_examples=200, deadline=None)
@given(BAG, BAG)
def test_probability_jaccard_is_the_formula(x, y):
    assert abs(P.probability_jaccard(arrays(x), arrays(y)) - naive(x, y)) < 1e-9


def test_sketches_agree_with_the_probability():
    rng = random.Random(3)
    for share in (0.2, 0.5, 0.8):
        a = Counter({rng.getrandbits(60): rng.randint(1, 4) for _ in range(300)})
        b = Counter({k: n for k, n in a.items() if rng.random() < share} | {rng.getrandbits(60): 2 for _ in range(60)})
        s = P.sketches([arrays(a), arrays(b)], 4096)
        assert abs((s[0] == s[1]).mean() - naive(a, b)) < 0.03
    one = P.sketches([arrays({5: 2}), arrays({5: 7}), arrays({})], 64)
    assert (one[0] == 5).all() and (one[1] == 5).all() and (one[2] == 2**64 - 1).all()


def test_word_hashes_are_those_of_single_texts():
    texts = ["Ab cd", None, "", "cd, AB!", "é_1 " * 3, "x" * 3_000_000 + " y"]
    h, at = word_hashes(pa.array(texts))
    for i, t in enumerate(texts):
        assert h[at[i] : at[i + 1]].tolist() == word_hashes(pa.array([t], pa.string()))[0].tolist()
    assert h[0] == h[3] and h[1] == h[2] and np.diff(at).tolist() == [2, 0, 0, 2, 3, 2]


def components(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([2, 5, 12, 30]), st.sampled_from([1, 3, 8]))
def test_link_is_all_pairs(seed, n, pivots):
    rng = random.Random(seed)
    base = [rng.getrandbits(50) for _ in range(30)]
    sets = [arrays({k: rng.randint(1, 2) for k in rng.sample(base, rng.randint(18, 30))}) for _ in range(n)]
    want = components((i, j) for i in range(n) for j in range(i) if P.probability_jaccard(sets[i], sets[j]) >= 0.6)
    assert P.link(sets, 0.6, pivots).tolist() == [want.get(i, i) for i in range(n)]


@settings(max_examples=100, deadline=None)
@given(st.lists(BAG.filter(bool), min_size=1, max_size=6), st.lists(BAG.filter(bool), min_size=1, max_size=6))
def test_shares_are_a_bound(xs, ys):
    got = P.shares([arrays(x) for x in xs], [arrays(y) for y in ys])
    for i, x in enumerate(xs):
        for j, y in enumerate(ys):
            share = sum(min(x[d] / sum(x.values()), y[d] / sum(y.values())) for d in x.keys() & y.keys())
            assert abs(got[i, j] - share) < 1e-5 and naive(x, y) <= share + 1e-9


def test_a_hot_bucket_is_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 60)
    rng = random.Random(7)
    heavy = "alpha beta gamma " * 20
    word = lambda: f"w{rng.randrange(10**7)}"
    rows = [(i, heavy + " ".join(word() for _ in range(90))) for i in range(2000)]
    rows += [(10_000 + i, rows[i][1].rsplit(" ", 3)[0] + " other words here") for i in range(0, 2000, 100)]
    same = heavy + " ".join(word() for _ in range(90))
    rows += [(20_000 + i, same.rsplit(" ", 1)[0] + " " + word()) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: r["keep_id"] for r in P.near_duplicates(df).collect()}
    want = {i: i for i in range(0, 2000, 100)} | {10_000 + i: i for i in range(0, 2000, 100)} | {20_000 + i: 20_000 for i in range(500)}
    assert got == want


def test_ids_of_text_and_one_id_with_several_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(100)), " ".join(f"b{i}" for i in range(100))
    rows = [("x", a), ("y", a + " more"), ("x", b), ("x", a), ("z", b + " too"), ("w", None), ("w", None), (None, a)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    assert sorted(map(tuple, P.near_duplicates(df).collect())) == [("x", "x", 2), ("x", "x", 2), ("y", "x", 2), ("z", "x", 2)]
    assert sorted((r["doc_id"] or "", r["text"]) for r in P.keep_one(df).collect() if r["text"]) == [("", a), ("x", a), ("x", b)]
    assert P.keep_one(df).where("doc_id = 'w'").count() == 1


def test_components(spark):
    rng = random.Random(1)
    edges = [(i + 1, i) for i in range(40)] + [tuple(sorted(rng.sample(range(100, 200), 2), reverse=True)) for _ in range(70)]
    got = {r["a"]: r["b"] for r in P.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: r for i, r in components(edges).items() if i != r}


def test_near_duplicates_against_all_pairs(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    sets = dict(zip([i for i, _ in rows], P.weighted(pa.array([t for _, t in rows]))))
    ids = sorted(sets)
    want = components((i, j) for i in ids for j in ids if j < i and P.probability_jaccard(sets[i], sets[j]) >= P.THRESHOLD)
    got = {r["doc_id"]: r["keep_id"] for r in P.near_duplicates(documents).collect()}
    assert len(want) > 10 and all(want.get(i) is not None for i in got)
    assert sum(got.get(i) == r for i, r in want.items()) >= 0.9 * len(want)


def test_planted_copies(spark):
    rng = random.Random(5)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = text(60)
    rows, i = [], 0
    for _ in range(20):
        w = text(200)
        for k in range(4):
            v = list(w)
            for _ in range(3 * k):
                v[rng.randrange(len(v))] = "changed"
            rows.append((i, " ".join(v)))
            i += 1
    clean = [(1000 + k, " ".join(text(150) + passage + text(150))) for k in range(80)]
    got = {r["doc_id"]: r["keep_id"] for r in P.near_duplicates(spark.createDataFrame(rows + clean, "doc_id bigint, text string")).collect()}
    assert got == {i: i // 4 * 4 for i, _ in rows}


def test_odd_rows(odd, none):
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in P.near_duplicates(odd).collect()}
    assert got == {3: (3, 2), 4: (3, 2), 8: (8, 2), 9: (8, 2)}
    kept = P.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == [0, 1, 2, 3, 5, 6, 7, 8] and ids.count(None) == 2
    assert P.near_duplicates(none).count() == 0 and P.keep_one(none).count() == 0
