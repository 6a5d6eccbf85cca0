"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

Features are the distinct words, pairs of neighbouring words and pairs of words with one between them of the
lower-cased text, hashed to 2**BITS buckets. FTRL-proximal keeps a learning rate for each coordinate and its L1
term leaves most weights at exactly zero, so that the weights that are broadcast are few.

The classifier is fitted on at most SAMPLE labelled documents of the table, those with the smallest hash of
their id; every document is scored, over its whole text. The cut is chosen on a held-out part of the sample. Ids
may be of any type; those of labels are taken as of the documents' type, and not used where they aren't. Nulls:
labels without an id, a label or a document aren't used, and of several labels of one document the largest
counts, of several texts of one id the first by its features; null and wordless texts score as the bias alone.
Without labels nothing is toxic. Extra columns are ignored (scores) or kept (keep_clean).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, slices, trim
from .words import pair, word_hashes

#: The most labelled documents that the classifier is fitted on.
SAMPLE = 16_000
BITS = 30
EPOCHS, ALPHA, BETA, L1, L2 = 3, 2.0, 1.0, 6.0, 0.01


def features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the features of all texts, and the number of the text of each; repeated ones included."""
    h, at = word_hashes(texts)
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    x, d = [h], [doc]
    for gap in (1, 2):
        near = np.flatnonzero(doc[:-gap] == doc[gap:])
        x.append(pair(h[near], h[near + gap], gap + 1))
        d.append(doc[near])
    return (np.concatenate(x) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(d)


def distinct(x: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of bucket and text, ordered by text and bucket."""
    both = np.unique((d << 32) | x)
    return both & 0xFFFFFFFF, both >> 32


def fit(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """Non-zero weights (buckets, weights) and the bias, from (distinct buckets, 0 or 1) in the order given.

    A gradient is below 1 and a weight is zero until the sum of gradients passes L1: buckets of too few
    rows to get there are left out before, which changes nothing.
    """
    none = np.zeros(0, np.int32), np.zeros(0, np.float32)
    y_all = [y for _, y in rows]
    if len(set(y_all)) < 2:
        return *none, 0.0
    few, mask = int(L1 // epochs), (1 << 22) - 1
    seen = np.zeros(mask + 1, np.int64)
    for lo in range(0, len(rows), 1000):
        seen += np.bincount(np.concatenate([x for x, _ in rows[lo : lo + 1000]]) & mask, minlength=mask + 1)
    flat = np.sort(np.concatenate([x[seen[x & mask] > few] for x, _ in rows]))
    first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1]))) if len(flat) else np.zeros(0, np.int64)
    names = flat[first][np.diff(first, append=len(flat)) > few]
    del flat, first
    if not len(names):
        return *none, 0.0
    own = []
    for x, _ in rows:
        x = x[seen[x & mask] > few]
        at = np.minimum(np.searchsorted(names, x), len(names) - 1)
        own.append(at[names[at] == x].astype(np.int32))
    z, n = np.zeros(len(names)), np.zeros(len(names))
    bz = bn = 0.0

    def bias() -> float:
        return -bz / ((BETA + bn**0.5) / ALPHA)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) > L1, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2), 0.0)

    for _ in range(epochs):
        for x, y in zip(own, y_all):
            zi, ni, b = z[x], n[x], bias()
            w = weights(zi, ni)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - y
            more = ni + g * g
            z[x] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / ALPHA * w
            n[x] = more
            bz += g - ((bn + g * g) ** 0.5 - bn**0.5) / ALPHA * b
            bn += g * g
    on = np.flatnonzero(np.abs(z) > L1)
    return names[on].astype(np.int32), weights(z[on], n[on]).astype(np.float32), bias()


def choose_cut(rows: list[tuple[np.ndarray, int]]) -> float:
    """The cut with the best F1 on the last fifth of the rows, for a model of the others; the highest of equally good ones, as the model of all rows tells more surely.

    Without both labels in both parts: 0.5, or 1 (nothing is toxic) where no row is toxic.
    """
    at = len(rows) * 4 // 5
    if len({y for _, y in rows[:at]}) < 2 or len({y for _, y in rows[at:]}) < 2:
        return 0.5 if any(y for _, y in rows) else 1.0
    on, w, b = fit(rows[:at])
    weight = dict(zip(on.tolist(), w.tolist()))
    p = np.array([1 / (1 + np.exp(-np.clip(sum(weight.get(i, 0.0) for i in x.tolist()) + b, -35, 35))) for x, _ in rows[at:]])
    y = np.array([y for _, y in rows[at:]])
    cuts = np.arange(0.1, 0.91, 0.05)
    f1 = np.array([2 * (y & (p > c)).sum() / (y.sum() + (p > c).sum()) for c in cuts])
    return float(round(cuts[f1 >= f1.max() - 1e-9][-1], 2))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", label_id: str = "doc_id", sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float, float]:
    """The model of fit() and its cut, fitted in one executor task on the sample; only the weights come to the driver."""
    y = labels.select(F.col(label_id).try_cast(docs.schema[id_col].dataType).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    # only labels of documents that are there take up places
    y = y.join(docs.select(F.col(id_col).alias("id")), "id", "left_semi").groupBy("id").agg(F.max("y").alias("y"))
    y = y.withColumn("at", F.xxhash64("id")).orderBy("at", "id").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(y), "id").select("at", "id", "y", "text")  # at most `sample` ids

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 3):
            x, d = distinct(*features(batch.column(3)))
            ends = np.searchsorted(d, np.arange(batch.num_rows + 1))
            x = [x[lo:hi].astype(np.int32).tobytes() for lo, hi in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(x, pa.binary())], ["at", "id", "y", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = None, []
        for batch in batches:
            x = batch.column(3).cast(pa.binary())
            ends = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1]
            data = np.frombuffer(x.buffers()[2] or b"", np.uint8)
            for i, label, lo, hi in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                if i != seen:  # of repeated rows of an id one counts
                    rows.append((data[lo:hi].view(np.int32), int(label > 0)))
                seen = i
        on, w, b = fit(rows)
        yield pa.RecordBatch.from_pydict({"on": [on.tobytes()], "w": [w.tobytes()], "b": [float(b)], "cut": [choose_cut(rows)]})
        del rows
        trim()

    hashed_rows = rows.mapInArrow(hashed, rows.select("at", "id", "y").schema.add("x", "binary"))
    got = hashed_rows.repartition(1).sortWithinPartitions("at", "id", "y", "x").mapInArrow(learn, "on binary, w binary, b double, cut double").first()
    if got is None:
        return np.zeros(0, np.int32), np.zeros(0, np.float32), 0.0, 1.0
    return np.frombuffer(got["on"], np.int32), np.frombuffer(got["w"], np.float32), got["b"], got["cut"]


class Scorer:
    """Scores of texts by a model; made on each executor from the broadcast weights."""

    def __init__(self, model: tuple[np.ndarray, np.ndarray, float, float]) -> None:
        self.on, self.w, self.b, _ = model
        self.hit = np.zeros(1 << 20, bool)  # whether a weight has these last bits
        self.hit[self.on & 0xFFFFF] = True

    def __call__(self, texts: pa.Array) -> np.ndarray:
        if not len(self.on):
            return np.full(len(texts), 1 / (1 + np.exp(-self.b)))
        x, d = features(texts)
        may = np.flatnonzero(self.hit[x & 0xFFFFF])
        x, d = distinct(x[may], d[may])
        at = np.minimum(np.searchsorted(self.on, x), len(self.on) - 1)
        total = np.bincount(d, np.where(self.on[at] == x, self.w[at], 0.0).astype(np.float64), len(texts)) + self.b
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def _scored(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int, keep_columns: bool) -> tuple[DataFrame, str, float]:
    """Rows of id and score, or of docs' columns and score; the score's name; the cut."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, sample=sample))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for batch in slices(batches, at):
            s = pa.array(scorer(batch.column(at)), pa.float64())
            if keep_columns:
                yield pa.RecordBatch.from_arrays([*batch.columns, s], [*batch.schema.names, name])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), s], [id_col, name])

    at = docs.columns.index(text_col) if keep_columns else 1
    if keep_columns:
        (name,) = fresh(docs, "score")
        return docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])), name, model.value[3]
    name = "score" if id_col.lower() != "score" else "toxicity"
    base = docs.select(id_col, F.col(text_col).cast("string").alias(text_col))
    return base.mapInArrow(score, docs.select(id_col).schema.add(name, "double")), name, model.value[3]


def toxic_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, cut: float | None = None) -> DataFrame:
    """(doc_id, score, toxic; is_toxic, if the id has that name) for the documents whose score is above the cut; all are scored. Rows without an id are left out."""
    scored, name, best = _scored(docs.where(F.col(id_col).isNotNull()), labels, id_col, text_col, sample, False)
    return scored.where(F.col(name) > (best if cut is None else cut)).withColumn("toxic" if id_col.lower() != "toxic" else "is_toxic", F.lit(True))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, cut: float | None = None) -> DataFrame:
    """docs, all columns, without the rows whose score is above the cut. Rows without an id are judged too."""
    scored, name, best = _scored(docs, labels, id_col, text_col, sample, True)
    return scored.where(F.col(name) <= (best if cut is None else cut)).drop(name)
