"""Near duplicates by ProbMinHash, banding and exact verification.

The similarity of two documents is the probability Jaccard index of their weighted shingles (runs of three
words, weighted by how often they occur):

    J_P(x, y) = sum over d in both of 1 / sum over d' of max(x_d'/x_d, y_d'/y_d)

A document's sketch has M registers. Each element sends a Poisson process of arrivals, at a rate of its weight,
to registers drawn at random; a register keeps the element that came first. Two sketches agree in a register
with probability J_P. An element ends as soon as its next arrival comes after the latest register, so that a
document costs about (elements + M log M) steps and not their product.

Sketches are cut into bands, texts that agree in a band meet in a bucket, and in each bucket the similarity is
computed exactly, from whole texts. Linked texts form groups (connected components).

A text of a bucket is compared with the first of each group found so far in it; in buckets of more than FEW
texts, pairs that are still in different groups are then told by a bound first: J_P is at most the sum of the
smaller shares of the shingles that both have, which matrices of the shared shingles give for all pairs at once.
A bucket of more than BLOCK texts is cut into blocks, each a task of its own that has PIVOTS texts of the bucket
too, so that copies in different blocks come together. What is then not in the bucket's largest group is
compared with all its blocks, in a grid of tasks. So a bucket of n copies costs about n comparisons, one of
unlike texts n squared of the bound, spread over n / BLOCK squared tasks.

What is compared is distinct weighted shingles, numbered here: ids may be of any type that has an order, and
rows of one id with different texts are different documents, rows of one id with the same text one. Null and
wordless texts have no shingles and belong to no group. Rows without an id can't be named in a result and belong
to no group. Ties: the smallest id of a group represents it, then the smallest hash of a text. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, fresh, materialise, slices, small
from .words import mix, shingles, word_hashes

REGISTERS, ROWS = 128, 4
#: Documents at least this similar are near duplicates.
THRESHOLD = 0.5
#: Texts of a block of a bucket, and those of the bucket that all its blocks have.
BLOCK, PIVOTS = 1000, 4
#: Texts up to which all pairs are compared without looking at a bound first.
FEW = 20
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def weighted(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct shingles in order, and their counts."""
    out = []
    for s in shingles(*word_hashes(texts)):
        s = np.sort(s)
        first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
        out.append((s[first], np.diff(first, append=len(s)).astype(np.float64)))
    return out


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """J_P of two weighted sets, exactly; 0 if either is empty."""
    (ka, wa), (kb, wb) = a, b
    if not len(ka) or not len(kb):
        return 0.0
    at = np.minimum(np.searchsorted(kb, ka), len(kb) - 1)
    both = kb[at] == ka
    if not both.any():
        return 0.0
    x, y = wa[both], wb[at[both]]
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    # max(x'/x, y'/y) is x'/x for the d' whose ratio x'/y' is above x/y, else y'/y
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    above = x.sum() - np.cumsum(x) + only_a
    upto = np.cumsum(y) + only_b
    return float((1.0 / (above / x + upto / y)).sum())


def sketches(sets: list[tuple[np.ndarray, np.ndarray]], m: int = REGISTERS) -> np.ndarray:
    """An array (sets, m) of 64-bit registers; all-ones for empty sets."""
    n = len(sets)
    sig = np.full(n * m, np.uint64(2**64 - 1))
    sizes = [len(k) for k, _ in sets]
    if not sum(sizes):
        return sig.reshape(n, m)
    keys = np.concatenate([k for k, _ in sets])
    weight = np.concatenate([w for _, w in sets])
    doc = np.repeat(np.arange(n), sizes)
    reg = np.full(n * m, np.inf)
    latest = np.full(n, np.inf)
    came = np.zeros(len(keys))
    step = 0
    while len(keys):
        step += 1
        r = mix(keys + np.uint64(step * int(_GOLD) & (2**64 - 1)))
        came = came - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
        on = came < latest[doc]
        keys, weight, doc, came, r = keys[on], weight[on], doc[on], came[on], r[on]
        at = doc * m + (mix(r) % np.uint64(m)).astype(np.int64)
        np.minimum.at(reg, at, came)
        won = reg[at] == came
        sig[at[won]] = keys[won]
        if len(doc):
            live = np.flatnonzero(np.diff(doc, prepend=-1))
            ids = doc[live]
            latest[ids] = reg.reshape(n, m)[ids].max(axis=1)
            on = came < latest[doc]
            if not on.all():
                keys, weight, doc, came = keys[on], weight[on], doc[on], came[on]
    return sig.reshape(n, m)


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """Hashes of the sketches' runs of `rows` registers, each with its place."""
    n, m = sig.shape
    out = np.tile(np.arange(m // rows, dtype=np.uint64) * _GOLD, (n, 1))
    for k in range(rows):
        out = mix(out + sig[:, k::rows] * np.uint64(0xC2B2AE3D27D4EB4F))
    return out.view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 2):
        sets = weighted(batch.column(2))
        keep = [i for i, (k, _) in enumerate(sets) if len(k)]
        if not keep:
            continue
        band = bands(sketches([sets[i] for i in keep]))
        same = [xxhash.xxh3_128_digest(sets[i][0].tobytes() + sets[i][1].tobytes()) for i in keep]
        flat = pa.array(band.reshape(-1), pa.int64())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1, dtype=np.int32) * band.shape[1]), flat)
        at = pa.array(keep)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(same, pa.binary()), lists], ["id", "hash", "same", "bands"])


def shares(a: list[tuple[np.ndarray, np.ndarray]], b: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each pair the sum of the smaller shares of shingles that both have: at least their probability Jaccard index."""
    out = np.zeros((len(a), len(b)), np.float32)

    def flat(sets: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys = np.concatenate([k for k, _ in sets])
        share = np.concatenate([w / w.sum() for _, w in sets]).astype(np.float32)
        order = np.argsort(keys, kind="stable")
        return keys[order], share[order], np.repeat(np.arange(len(sets)), [len(k) for k, _ in sets])[order]

    (ka, wa, da), (kb, wb, db) = flat(a), flat(b)
    both = np.intersect1d(ka, kb)
    a0, a1, b0, b1 = (np.searchsorted(k, both, side) for k in (ka, kb) for side in ("left", "right"))
    one = (a1 - a0 == 1) & (b1 - b0 == 1)  # many shingles, each of one pair
    np.add.at(out, (da[a0[one]], db[b0[one]]), np.minimum(wa[a0[one]], wb[b0[one]]))
    for lo, hi, at, to in zip(a0[~one].tolist(), a1[~one].tolist(), b0[~one].tolist(), b1[~one].tolist()):
        out[np.ix_(da[lo:hi], db[at:to])] += np.minimum(wa[lo:hi, None], wb[None, at:to])
    return out


class Groups:
    """Groups of the numbers from 0, as links join them."""

    def __init__(self, start: np.ndarray) -> None:
        self.of = start.copy()

    def join(self, i: int, j: int) -> None:
        """Makes one group of those of i and j."""
        a, b = self.of[i], self.of[j]
        if a != b:
            self.of[self.of == max(a, b)] = min(a, b)


def link(sets: list[tuple[np.ndarray, np.ndarray]], threshold: float, pivots: int = 8) -> np.ndarray:
    """The group of each set: components as if all pairs were compared; only pairs already in one group, and those whose bound is below the threshold, are left out."""
    n = len(sets)
    groups = Groups(np.arange(n))
    firsts: list[int] = []
    tested = set()
    for i in range(n):
        for j in firsts:
            if groups.of[i] != groups.of[j]:
                tested.add((i, j))
                if probability_jaccard(sets[i], sets[j]) >= threshold:
                    groups.join(i, j)
        if groups.of[i] == i and len(firsts) < pivots:
            firsts.append(i)
    if n > FEW:
        across(sets, sets, groups, np.arange(n), np.arange(n), threshold)
    else:
        for i in range(n):
            for j in range(i):
                if groups.of[i] != groups.of[j] and (i, j) not in tested and probability_jaccard(sets[i], sets[j]) >= threshold:
                    groups.join(i, j)
    return groups.of


def across(a: list[tuple[np.ndarray, np.ndarray]], b: list[tuple[np.ndarray, np.ndarray]], groups: Groups, at: np.ndarray, bt: np.ndarray, threshold: float) -> None:
    """Joins the groups of all pairs of a and b that reach the threshold; at and bt are their numbers in groups.

    Only the texts of all groups but the largest are looked at on the side of a, as a pair within it needs no look.
    """
    ga, gb = groups.of[at], groups.of[bt]
    if len(np.unique(np.concatenate([ga, gb]))) < 2:
        return
    if a is b:
        name, size = np.unique(ga, return_counts=True)
        rows = np.flatnonzero(ga != name[size.argmax()])
    else:
        rows = np.arange(len(a))
    bound = shares([a[i] for i in rows], b)
    for k, i in enumerate(rows.tolist()):
        for j in np.flatnonzero((bound[k] >= threshold - 1e-4) & (groups.of[bt] != groups.of[at[i]])).tolist():
            if groups.of[at[i]] != groups.of[bt[j]] and probability_jaccard(a[i], b[j]) >= threshold:
                groups.join(at[i], bt[j])


def _edges(ids: np.ndarray, of: np.ndarray) -> pa.Table:
    """(a, b) with b the smallest id of a's group, for ids that aren't the smallest."""
    low = {}
    for i, g in zip(ids.tolist(), of.tolist()):
        low[g] = min(low.get(g, i), i)
    pairs = sorted({(i, low[g]) for i, g in zip(ids.tolist(), of.tolist()) if i != low[g]})
    return pa.table({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})


def _verify(threshold: float):
    """Links the texts (id, text) of a block."""

    def run(table: pa.Table) -> pa.Table:
        texts = dict(zip(table.column("id").to_pylist(), table.column("text").to_pylist()))
        ids = sorted(texts)
        return _edges(np.array(ids), link(weighted(pa.array([texts[i] for i in ids], pa.string())), threshold))

    return run


def _verify_grid(threshold: float):
    """Links the texts (id, text, minor, group) of two blocks: those with minor to the others; a group is what earlier links have made."""

    def run(table: pa.Table) -> pa.Table:
        sides: dict[bool, dict[int, tuple[str, int]]] = {True: {}, False: {}}
        for i, t, m, g in zip(*(table.column(c).to_pylist() for c in ("id", "text", "minor", "group"))):
            sides[m][i] = t, g
        ids = sorted(sides[True].keys() | sides[False].keys())
        number = {i: k for k, i in enumerate(ids)}
        known = {i: g for side in sides.values() for i, (_, g) in side.items()}
        groups = Groups(np.unique([known[i] for i in ids], return_inverse=True)[1])
        a, b = (sorted(sides[m]) for m in (True, False))
        if a and b:
            sets = [weighted(pa.array([sides[m][i][0] for i in x], pa.string())) for m, x in ((True, a), (False, b))]
            across(*sets, groups, np.array([number[i] for i in a]), np.array([number[i] for i in b]), threshold)
        return _edges(np.array(ids), groups.of)

    return run


def components(edges: DataFrame) -> DataFrame:
    """(a, b) with b the smallest id of a's component, for edges (a, b) with a > b; a row for each a but the roots.

    Alternating large-star and small-star rounds, each written to the shared folder, until nothing changes.
    """
    edges = materialise(edges.distinct(), "edges")
    mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        met = large.join(low, "a")
        smaller = met.select("a", F.col("m").alias("b")).unionByName(met.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        before, edges = edges, materialise(smaller, "edges")
        discard(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges


def _hash(text_col: str) -> Column:
    """Tells rows of one id apart."""
    return F.xxhash64(F.col(text_col).cast("string"))


def _members(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """(id, hash, keep, keep_hash, size): the documents of the groups of at least two, by id and hash of the text, and the one that stays."""
    base = docs.select(F.col(id_col).alias("id"), _hash(text_col).alias("hash"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    schema = base.select("id", "hash").schema.add("same", "binary").add("bands", T.ArrayType(T.LongType()))
    sketched = materialise(base.mapInArrow(_sketch, schema), "sketches")
    # texts with the same weighted shingles are linked without a comparison, and one of them stands for all
    one = sketched.groupBy("same").agg(F.min(F.struct("id", "hash")).alias("rep"), F.count("*").alias("n"), F.min("bands").alias("bands"))
    one = materialise(one.withColumn("cid", F.monotonically_increasing_id()), "distinct")
    # the same texts often meet in several bands: one bucket of each is enough, told by number and hashes
    met = one.select("cid", F.explode("bands").alias("band"))
    sums = [F.bit_xor(F.xxhash64("cid", F.lit(k))).alias(f"h{k}") for k in range(2)]
    bucket = met.groupBy("band").agg(F.count("*").alias("n"), *sums).where("n > 1").groupBy("n", "h0", "h1").agg(F.min("band").alias("band")).select("band", "n")
    bucket = materialise(bucket, "buckets")
    m = bucket.count()
    placed = met.join(small(bucket, m), "band").withColumn("block", F.pmod(F.xxhash64("cid", F.lit("block")), F.ceil(F.col("n") / BLOCK)).cast("int"))
    placed = materialise(placed.select("band", "n", "block", "cid"), "placed")
    wanted = placed.select("cid").distinct()
    wanted = materialise(wanted.join(one.select("cid", "rep.id", "rep.hash"), "cid"), "wanted")
    texts = base.join(small(wanted, wanted.count()), ["id", "hash"]).select("cid", "text").dropDuplicates(["cid"])
    large = placed.where(F.col("n") > BLOCK)
    first = large.groupBy("band").agg(F.slice(F.sort_array(F.collect_set(F.when(F.col("block") < 1, F.col("cid")))), 1, PIVOTS).alias("cids"), F.max("n").alias("n"))
    pivots = first.select("band", F.explode("cids").alias("cid"), "n").select("band", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / BLOCK) - 1).cast("int"))).alias("block"), "cid")
    cells = placed.select("band", "block", "cid").unionByName(pivots)
    pairs = cells.join(texts, "cid").select("band", "block", F.col("cid").alias("id"), "text").groupBy("band", "block").applyInArrow(_verify(threshold), "a bigint, b bigint")
    linked = components(pairs)
    spent = [sketched, one, bucket, placed, wanted]
    if large.limit(1).count():
        grouped = large.join(linked.select(F.col("a").alias("cid"), "b"), "cid", "left").select("band", "n", "block", "cid", F.coalesce("b", "cid").alias("group"))
        grouped = materialise(grouped, "grouped")
        top = grouped.groupBy("band", "group").agg(F.count("*").alias("k")).groupBy("band").agg(F.max_by("group", F.struct("k", "group")).alias("top"))
        minor = grouped.join(top, "band").where("group <> top").select("band", "n", F.col("block").alias("row"), "cid", "group")
        # each block of those beside the largest group meets each block of the bucket
        rows = minor.select("band", "row", "n").distinct()
        left = minor.select("band", "row", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / BLOCK) - 1).cast("int"))).alias("block"), "cid", "group", F.lit(True).alias("minor"))
        right = grouped.join(rows.drop("n"), "band").select("band", "row", "block", "cid", "group", F.lit(False).alias("minor"))
        grid = left.unionByName(right).join(texts, "cid").select("band", "row", "block", F.col("cid").alias("id"), "group", "minor", "text")
        more = grid.groupBy("band", "row", "block").applyInArrow(_verify_grid(threshold), "a bigint, b bigint")
        before, linked = linked, components(linked.unionByName(more))
        discard(before)
        spent.append(grouped)
    hot = one.join(linked.withColumnsRenamed({"a": "cid", "b": "root"}), "cid", "left").join(linked.select(F.col("b").alias("cid")).distinct().withColumn("is_root", F.lit(True)), "cid", "left")
    hot = hot.where("root IS NOT NULL OR is_root OR n > 1").select("same", F.coalesce("root", "cid").alias("root"))
    members = sketched.join(hot, "same").select("root", "id", "hash").distinct()
    sizes = members.groupBy("root").agg(F.count("*").alias("size"), F.min(F.struct("id", "hash")).alias("m")).where("size > 1")
    out = materialise(members.join(sizes, "root").select("id", "hash", F.col("m.id").alias("keep"), F.col("m.hash").alias("keep_hash"), "size"), "members")
    discard(*spent, linked)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, keep_id, group_size): a row for each document of a group of at least two; keep_id is the group's smallest id."""
    return _members(docs, id_col, text_col, threshold).select(F.col("id").alias("doc_id"), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the documents that near_duplicates() finds beside the one that stays of each group.

    Repeated rows of one id and text, null texts too: one stays. Rows without an id all stay.
    """
    key, digest = F.col(id_col), F.coalesce(_hash(text_col), F.lit(0))
    gone_id, gone_hash, nth = fresh(docs, "gone", "hash", "nth")
    gone = materialise(_members(docs, id_col, text_col, threshold).where("NOT (id <=> keep AND hash <=> keep_hash)").select(F.col("id").alias(gone_id), F.col("hash").alias(gone_hash)), "gone")
    often = docs.where(key.isNotNull()).groupBy(key.alias(gone_id), digest.alias(gone_hash)).agg(F.count("*").alias(nth)).where(F.col(nth) > 1).select(gone_id, gone_hash)
    often = materialise(often, "often")
    on = (key == F.col(gone_id)) & (digest == F.col(gone_hash))
    kept = docs.join(small(gone, gone.count()), on, "left_anti")
    if m := often.count():
        again = kept.join(small(often, m), on, "left_semi")
        order = Window.partitionBy(key, digest).orderBy(F.lit(0))
        again = again.withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).drop(nth)
        kept = kept.join(small(often, m), on, "left_anti").unionByName(again)
    return kept
