import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronostrata.llm import toxicity as T

BAD = ["vlork", "snarf", "grunk"]


def corpus(spark, n=900, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(20, 200))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels[: n * 2 // 3], "doc_id bigint, toxic int"), {i for i, t in labels if t}


def test_held_out_accuracy(spark):
    docs, labels, toxic = corpus(spark)
    got = {r["doc_id"] for r in T.toxic_documents(docs, labels).collect()}
    held = set(range(600, 900))
    assert len(got & toxic & held) >= 0.95 * len(toxic & held) and len((got - toxic) & held) <= 2
    clean = {r["doc_id"] for r in T.keep_clean(docs, labels).collect()}
    assert clean == set(range(900)) - got


def test_weights_are_sparse_and_words_are_found_in_any_place():
    rng = np.random.default_rng(0)
    rows = []
    for i in range(400):
        words = [f"w{k}" for k in rng.integers(0, 500, 60)] + (["vlork"] if i % 4 == 0 else [])
        x, d = T.distinct(*T.features(pa.array([" ".join(words)])))
        rows.append((x, int(i % 4 == 0)))
    on, w, b = T.fit(rows)
    assert 0 < len(on) < 100
    s = T.Scorer((on, w, b, 0.5))
    long = "calm " * 100_000
    scores = s(pa.array(["Vlork", "", None, long, long + "vlork", "a b c"]))
    assert scores[0] > 0.5 > scores[3] and scores[4] > 0.5 > scores[5] and scores[1] == scores[2]


def test_features_count_pairs_within_texts():
    x, d = T.features(pa.array(["a b c", None, "c", "a b c"]))
    assert np.bincount(d, minlength=4).tolist() == [6, 0, 1, 6]
    assert sorted(x[d == 0]) == sorted(x[d == 3])


def test_odd_rows(spark, odd, none, labels):
    kept = T.keep_clean(odd, labels)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert T.toxic_documents(odd, labels).columns == ["doc_id", "score", "toxic"]
    nobody = spark.createDataFrame([(None, 1), (1, None), (None, None)], "doc_id bigint, toxic int")
    assert T.toxic_documents(odd, nobody).count() == 0 and T.keep_clean(none, labels).count() == 0
    both = spark.createDataFrame([(5, 0), (5, 1), (6, 0), (8, 0)], "doc_id bigint, toxic int")
    assert T.keep_clean(odd, both).count() <= odd.count()


def test_null_and_empty_are_kept(spark):
    docs, labels, _ = corpus(spark, 300)
    more = docs.unionByName(spark.createDataFrame([(None, None), (5000, ""), (5001, None), (None, "vlork snarf grunk vlork")], "doc_id bigint, text string"))
    kept = T.keep_clean(more, labels).where("doc_id IS NULL OR doc_id >= 5000").collect()
    assert {(r["doc_id"], r["text"]) for r in kept} == {(None, None), (5000, ""), (5001, None)}


def plain_ftrl(rows, epochs=T.EPOCHS):
    """FTRL-proximal as published, feature by feature, in dictionaries."""
    z, n = {}, {}
    bz = bn = 0.0
    weight = lambda k: 0.0 if abs(z.get(k, 0.0)) <= T.L1 else -(z[k] - math.copysign(T.L1, z[k])) / ((T.BETA + math.sqrt(n[k])) / T.ALPHA + T.L2)
    for _ in range(epochs):
        for x, y in rows:
            b = -bz / ((T.BETA + math.sqrt(bn)) / T.ALPHA)
            w = {k: weight(k) for k in x.tolist()}
            g = 1 / (1 + math.exp(-(sum(w.values()) + b))) - y
            for k in x.tolist():
                more = n.get(k, 0.0) + g * g
                z[k] = z.get(k, 0.0) + g - (math.sqrt(more) - math.sqrt(n.get(k, 0.0))) / T.ALPHA * w[k]
                n[k] = more
            more = bn + g * g
            bz, bn = bz + g - (math.sqrt(more) - math.sqrt(bn)) / T.ALPHA * b, more
    return {k: weight(k) for k in z if weight(k)}, -bz / ((T.BETA + math.sqrt(bn)) / T.ALPHA)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_weights_are_those_of_a_plain_program(seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(300):
        toxic = rng.random() < 0.3
        words = [f"w{rng.randrange(150)}" for _ in range(rng.randint(5, 60))] + rng.sample(BAD, 2) * toxic
        rng.shuffle(words)
        rows.append((T.distinct(*T.features(pa.array([" ".join(words)])))[0], int(toxic)))
    on, w, b = T.fit(rows)
    want, want_b = plain_ftrl(rows)
    assert sorted(want) == on.tolist() and len(want) > 2 and abs(b - want_b) < 1e-6
    assert all(abs(want[k] - x) < 1e-5 * max(1, abs(x)) for k, x in zip(on.tolist(), w.tolist()))


def test_text_ids_and_clashing_names(spark):
    docs, labels, toxic = corpus(spark, 400)
    want = {r["doc_id"] for r in T.toxic_documents(docs, labels).collect()}
    text_id = lambda df: df.withColumn("doc_id", F.format_string("n%04d", "doc_id"))
    got = {r["doc_id"] for r in T.toxic_documents(text_id(docs), text_id(labels)).collect()}
    assert len(got & {f"n{i:04}" for i in toxic}) >= 0.8 * len(toxic) and want
    named = T.toxic_documents(docs.withColumn("score", F.lit(1)).withColumnRenamed("doc_id", "toxic"), labels.select("doc_id", "toxic"), id_col="toxic")
    assert named.columns == ["toxic", "score", "is_toxic"] and {r["toxic"] for r in named.collect()} == want


def test_labels_without_a_document_take_no_places(spark):
    docs, labels, _ = corpus(spark, 300)
    absent = spark.range(10**6, 10**6 + 5000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    a, b = (T.train(docs, x, sample=150) for x in (labels, labels.unionByName(absent)))
    assert a[0].tolist() == b[0].tolist() and len(a[0]) and a[3] == b[3]
