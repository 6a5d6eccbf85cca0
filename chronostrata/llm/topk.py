"""Exact top-k search: tiled matrix products, partial selection per tile, tree merging.

Vectors are normalised, so that products are cosines. Queries are cut into blocks and all vectors into shards by
a hash of their rows. Each cell of the grid (query block, shard) is one task: it holds its queries and their k
best so far, and the shard passes by in parts. Products are made tile by tile in single precision; what may reach
a query's k-th best, by a bound of their error, is multiplied again in double precision, which decides. A tile in
which that is much is multiplied whole in double precision and its k best are taken by partial selection. Lists of
a query block are then merged by a tree, FAN shards at a time. Every row is a query, unless a condition tells which.

Products are rounded to DIGITS, so that results don't depend on the tiles; ties go by the smaller id, then
by row. A vector isn't its own neighbour; other rows of the same id are. Ids may be of any type that has an
order. Vectors of different lengths aren't compared: those of each length are searched among themselves.
Null vectors, vectors that hold nulls or values that aren't finite, zero vectors and rows without an id are
left out. Fewer than k neighbours: all of them. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, small, trim

K, DIGITS, FAN = 10, 6, 8
#: The query asks for the neighbours of every row whose id is divisible by this, among all rows.
EVERY = 50
#: Rows of a tile: of queries, of candidates; queries of a row of lists. Values of the candidates that are searched at a time.
QUERY_TILE, TILE, LIST_ROWS, GROUP = 256, 1024, 16_384, 2**21
#: Bytes of vectors of a query block, which a task holds, and of a shard, which passes by.
QUERY_BYTES, SHARD_BYTES = 96_000_000, 256_000_000
#: Multiplications of a task: at most, where query blocks allow it, and at least, if there are tasks for all cores.
TASK_WORK, LEAST_WORK = 8e12, 1e9


def listed(df: DataFrame, id_col: str, vec_col: str, *more: Column) -> DataFrame:
    """(id, vec, more) of rows with an id and a vector that isn't empty, as array<float> or array<double>; `more` is named asks."""
    kind = df.schema[vec_col].dataType
    kind = "float" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "double"
    return df.select(F.col(id_col).alias("id"), F.col(vec_col).cast(f"array<{kind}>").alias("vec"), *(c.alias("asks") for c in more)).where("id IS NOT NULL AND vec IS NOT NULL AND size(vec) > 0")


def vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) with the usable vectors, as array<float> or array<double>."""
    return listed(df, id_col, vec_col).where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))).where(F.exists("vec", lambda x: x != 0))


def numbered(usable: DataFrame, kind: T.DataType) -> tuple[DataFrame, DataFrame | None]:
    """(id, row, ...) with whole numbers as ids and a number for each row; (row, name) where ids of another type are numbered in their order.

    In the latter case it is written.
    """
    if isinstance(kind, T.IntegralType):
        return usable.withColumn("id", F.col("id").cast("bigint")).withColumn("row", F.monotonically_increasing_id()), None
    # ranges in order, sorted: rising row numbers are rising ids
    ranged = usable.repartitionByRange(F.col("id")).sortWithinPartitions("id").withColumn("row", F.monotonically_increasing_id())
    ranged = materialise(ranged, "vectors")
    return ranged.withColumn("id", F.col("row")), ranged.select("row", F.col("id").alias("name"))


def named(out: DataFrame | None, names: DataFrame | None, df: DataFrame, id_col: str) -> DataFrame:
    """(id, rank, neighbour, cosine) with the ids that df has."""
    if out is None:
        out = df.sparkSession.createDataFrame([], "id bigint, rank int, neighbour bigint, cosine double")
    if names is None:
        kind = df.schema[id_col].dataType
        return out.select(F.col("id").cast(kind).alias(id_col), "rank", F.col("neighbour").cast(kind).alias("neighbour"), "cosine")
    names = small(names, names.count())
    out = out.join(names.withColumnsRenamed({"row": "id", "name": "q"}), "id").join(names.withColumnsRenamed({"row": "neighbour", "name": "n"}), "neighbour")
    return out.select(F.col("q").alias(id_col), "rank", F.col("n").alias("neighbour"), "cosine")


def by_length(df: DataFrame, id_col: str, vec_col: str, search: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """(id, rank, neighbour, cosine): what `search` finds among the vectors (id, row, vec), their ids being whole numbers, and their number, for each length.

    Ids of another type are numbered in their order, and put back at the end.
    """
    usable, names = numbered(vectors(df, id_col, vec_col), df.schema[id_col].dataType)
    if names is None:
        usable = materialise(usable, "vectors")
    out = None
    for r in usable.groupBy(F.size("vec").alias("n")).count().orderBy("n").collect():  # a row for each length
        part = search(usable.where(F.size("vec") == r["n"]), r["count"])
        out = part if out is None else out.unionByName(part)
    return named(out, names, df, id_col)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The rows of a list column as a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1).astype(np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    """x with rows of length 1."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the k highest scores, by falling score and rising id, and their ids. -inf: nothing."""
    if score.shape[1] > k:
        # all that reach the k-th score stay in the running, so that ties are decided by id
        edge = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
        most = int((score >= edge[:, None]).sum(axis=1).max())
        if most < score.shape[1]:
            at = np.argpartition(-score, min(most, score.shape[1] - 1), axis=1)[:, :most]
            score, ids = np.take_along_axis(score, at, 1), np.take_along_axis(np.broadcast_to(ids, (len(score), ids.shape[-1])), at, 1)
    ids = np.broadcast_to(ids, score.shape)
    order = np.lexsort((ids, -score), axis=1)[:, :k]
    return np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)


@dataclass
class Best:
    """The k best so far of each query, over candidates that come in parts.

    Products of single precision tell which candidates may reach a query's k-th best; only those are multiplied
    in double precision, which decides. The allowance is a bound of the error, so that nothing is lost.
    """

    vec: np.ndarray
    row: np.ndarray
    k: int

    def __post_init__(self) -> None:
        self.score = np.full((len(self.vec), self.k), -np.inf)
        self.ids = np.full((len(self.vec), self.k), -1)
        self.seen, width = 0, self.vec.shape[1]
        # rounding to DIGITS; each vector's own rounding, that of their product, and the edge's
        self.slack = 0.51 * 10.0**-DIGITS + 1.02 * (width + 10) * 2.0**-24
        self.most = max(1, GROUP // width)
        self.space = np.empty((QUERY_TILE, TILE), np.float32)

    def add(self, vec: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        lo = 0
        while lo < len(vec):
            # at first in small parts, since a k-th best of few lets much through
            on = slice(lo, lo + max(TILE, self.seen))
            self._add(vec[on], ids[on], row[on])
            self.seen += len(vec[on])
            lo = on.stop

    def _add(self, vec: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        c = unit(vec.astype(np.float64))
        single = c.astype(np.float32)
        for lo in range(0, len(self.vec), QUERY_TILE):
            on = slice(lo, lo + QUERY_TILE)
            q = unit(self.vec[on].astype(np.float64))
            q_single = q.astype(np.float32)
            hits: list[tuple[np.ndarray, np.ndarray]] = []
            for at in range(0, len(c), TILE):
                part = slice(at, at + TILE)
                edge = self.score[on, -1]
                if np.isneginf(edge).any():
                    self._all(on, q, c[part], ids[part], row[part])
                    continue
                n = len(single[part])
                s = np.matmul(q_single, single[part].T, out=self.space[: len(q)] if n == TILE else None)
                edge = (edge - self.slack).astype(np.float32)
                some = np.flatnonzero(s.max(axis=1) >= edge)  # few queries, once much has passed by
                found = np.flatnonzero(s[some] >= edge[some, None])
                if len(found) * 8 > s.size:
                    self._all(on, q, c[part], ids[part], row[part])
                elif len(found):
                    hits.append((some[found // n], found % n + at))
            if hits:
                self._some(on, q, c, ids, row, *map(np.concatenate, zip(*hits)))

    def _all(self, on: slice, q: np.ndarray, c: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        s = np.round(q @ c.T, DIGITS)
        s[self.row[on, None] == row[None]] = -np.inf
        s, i = best(s, ids[None], self.k)
        self.score[on], self.ids[on] = best(np.concatenate([self.score[on], s], 1), np.concatenate([self.ids[on], i], 1), self.k)

    def _some(self, on: slice, q: np.ndarray, c: np.ndarray, ids: np.ndarray, row: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        """Pairs of the a-th query and the b-th candidate."""
        s = np.concatenate([np.einsum("ij,ij->i", q[a[x : x + self.most]], c[b[x : x + self.most]]) for x in range(0, len(a), self.most)])
        s = np.round(s, DIGITS)
        keep = (s >= self.score[on, -1][a]) & (self.row[on][a] != row[b])
        a, b, s = a[keep], b[keep], s[keep]
        if not len(a):
            return
        order = np.argsort(a, kind="stable")
        a, b, s = a[order], b[order], s[order]
        which, begin, count = np.unique(a, return_index=True, return_counts=True)
        place = np.repeat(np.arange(len(which)), count), self.k + np.arange(len(a)) - np.repeat(begin, count)
        score, near = (np.pad(x[on][which], ((0, 0), (0, int(count.max()))), constant_values=y) for x, y in ((self.score, -np.inf), (self.ids, -1)))
        score[place], near[place] = s, ids[b]
        self.score[which + on.start], self.ids[which + on.start] = best(score, near, self.k)


def top_k(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, block: int | None = None, queries: Column | None = None) -> DataFrame:
    """(id, rank, neighbour, cosine) with rank from 1 to k, for every usable vector of a row for which `queries` holds; None: of every row.

    block: rows of a block of queries and of a shard at most; None: by their bytes and the work of a task.
    """
    asks = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    given = listed(df, id_col, vec_col, asks)
    usable, names = numbered(given, df.schema[id_col].dataType)
    out = None
    counts = (given if names is None else usable).groupBy(F.size("vec").alias("length")).agg(F.count("*").alias("n"), F.count_if("asks").alias("asking"))
    for r in counts.where("asking > 0").orderBy("length").collect():  # a row for each length
        part = _top_k(usable.where(F.size("vec") == r["length"]), r["length"], r["n"], r["asking"], k, block)
        out = part if out is None else out.unionByName(part)
    return named(out, names, df, id_col)


def grid(length: int, n: int, asking: int, size: int, block: int | None, cores: int) -> tuple[int, int]:
    """The numbers of query blocks and shards for n vectors of so many values of `size` bytes, `asking` of which are queries."""
    width = length * size
    blocks = math.ceil(asking / max(1, block or QUERY_BYTES // width))
    if block:
        return blocks, math.ceil(n / block)
    work = asking * n * length
    tasks = max(work / TASK_WORK, min(cores, work / LEAST_WORK))
    return blocks, max(1, math.ceil(n * width / SHARD_BYTES), math.ceil(tasks / blocks))


def _top_k(usable: DataFrame, length: int, n: int, asking: int, k: int, block: int | None) -> DataFrame:
    """(id, rank, neighbour, cosine) among the n vectors (id, row, asks, vec) of one length, of which so many are queries."""
    kind = np.dtype(np.float32 if isinstance(usable.schema["vec"].dataType.elementType, T.FloatType) else np.float64)
    blocks, shards = grid(length, n, asking, kind.itemsize, block, usable.sparkSession.sparkContext.defaultParallelism)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a batch that go to one place, as bytes."""
        for batch in batches:
            ids, row, asks, vec = (batch.column(batch.schema.get_field_index(c)) for c in ("id", "row", "asks", "vec"))
            ids, row, asks = ids.to_numpy(), row.to_numpy(), asks.to_numpy(zero_copy_only=False).astype(bool)
            x = vec.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, length)  # nulls are NaN
            ok = np.flatnonzero(np.isfinite(x).all(axis=1) & (x != 0).any(axis=1))
            salt = (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24)).astype(np.int64)
            for query, mine, place in ((True, ok[asks[ok]], salt % blocks), (False, ok, salt % shards)):
                mine = mine[np.argsort(place[mine], kind="stable")]
                packs = [at for at in np.split(mine, np.flatnonzero(np.diff(place[mine])) + 1) if len(at)]
                first = np.array([at[0] for at in packs], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([query] * len(packs), pa.bool_()), pa.array(place[first], pa.int32()), pa.array(salt[first]), *(pa.array([y[at].tobytes() for at in packs], pa.binary()) for y in (ids, row, x))], ["query", "place", "salt", "id", "row", "vec"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The lists of each cell; its queries come first."""
        cell, found, q_ids, held = None, None, np.zeros(0, np.int64), []

        def take() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """The vectors, ids and rows of what is held."""
            ids, row, x = (np.concatenate(y) for y in zip(*held))
            held.clear()
            return x.reshape(-1, length), ids, row

        def ended() -> Iterator[pa.RecordBatch]:
            if found is None:
                return
            if held:
                found.add(*take())
            for part, lo in enumerate(range(0, len(q_ids), LIST_ROWS)):
                on = slice(lo, lo + LIST_ROWS)
                at = (pa.array([y], pa.int32()) for y in (cell // shards, part, cell % shards))
                yield pa.RecordBatch.from_arrays([*at, *(pa.array([y[on].tobytes()], pa.binary()) for y in (q_ids, found.score, found.ids))], schema=schema)

        n = 0
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("cell", "query", "id", "row", "vec")]
            for i in range(batch.num_rows):
                at, query, *data = (c[i] for c in columns)
                if at.as_py() != cell:
                    yield from ended()
                    cell, found, n = at.as_py(), None, 0
                    held.clear()
                if not query.as_py() and found is None:
                    if not held:
                        continue  # a block without queries
                    x, ids, row = take()
                    order = np.argsort(row)  # as in the other cells of the block
                    found, q_ids, n = Best(x[order], row[order], k), ids[order], 0
                    del x, ids, row
                held.append([np.frombuffer(y.as_buffer(), dtype) for y, dtype in zip(data, (np.int64, np.int64, kind))])
                n += len(held[-1][0])
                if found is not None and n * length >= GROUP:
                    found.add(*take())
                    n = 0
        yield from ended()
        found = None
        trim()

    def merge(table: pa.Table) -> pa.Table:
        s = np.concatenate([np.frombuffer(b).reshape(-1, k) for b in table.column("score").to_pylist()], 1)
        i = np.concatenate([np.frombuffer(b, np.int64).reshape(-1, k) for b in table.column("ids").to_pylist()], 1)
        s, i = best(s, i, k)
        row = table.slice(0, 1)
        return pa.table([row.column("qb"), row.column("part"), row.column("cs"), row.column("id"), [s.tobytes()], [i.tobytes()]], schema=schema)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, s, i in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("id", "score", "ids"))):
                q, s, i = np.frombuffer(q, np.int64), np.frombuffer(s), np.frombuffer(i, np.int64)
                rank = np.tile(np.arange(1, k + 1, dtype=np.int32), len(q))
                on = s > -np.inf
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, k)[on]), pa.array(rank[on]), pa.array(i[on]), pa.array(s[on] + 0.0)], ["id", "rank", "neighbour", "cosine"])

    schema = pa.schema([("qb", pa.int32()), ("part", pa.int32()), ("cs", pa.int32()), ("id", pa.binary()), ("score", pa.binary()), ("ids", pa.binary())])
    form = "qb int, part int, cs int, id binary, score binary, ids binary"
    packs = usable.select("id", "row", "asks", "vec").mapInArrow(pack, "query boolean, place int, salt bigint, id binary, row binary, vec binary")
    # queries travel once a shard, vectors once a query block; salted, so that a shard passes by in no order
    cells = packs.withColumn("cell", F.expr(f"explode(if(query, sequence(place * {shards}, place * {shards} + {shards - 1}), sequence(place, place + {(blocks - 1) * shards}, {shards})))")).drop("place")
    cells = cells.repartitionById(blocks * shards, "cell").sortWithinPartitions("cell", F.desc("query"), "salt")
    lists = cells.mapInArrow(search, form)
    left = shards
    while left > 1:
        lists = lists.withColumn("cs", (F.col("cs") / FAN).cast("int")).groupBy("qb", "part", "cs").applyInArrow(merge, form)
        left = math.ceil(left / FAN)
    return lists.mapInArrow(spread, "id bigint, rank int, neighbour bigint, cosine double")


#: top_k() of embeddings, with the ids divisible by EVERY as queries, for DuckDB.
SQL = f"""
WITH v AS (
    SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS u
    FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
), p AS (
    SELECT a.vec_id, b.vec_id AS neighbour, round(list_inner_product(a.u, b.u), {DIGITS}) + 0.0 AS cosine
    FROM v a JOIN v b ON a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id
), r AS (
    SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, neighbour) AS rank FROM p
)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbour, cosine FROM r WHERE rank <= {K}
"""
