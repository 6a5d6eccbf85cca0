"""Approximate nearest neighbours: inverted file with product-quantised residuals and exact reranking.

Unit vectors are assigned to the nearest of about sqrt(n) / 4 coarse centroids. Their residuals are cut into
SUBSPACES parts, each coded by the nearest of CODES codewords. Centroids and codewords are fitted by Lloyd's
algorithm over all vectors: each round adds up partial sums on the cluster, and only the sums come to the
driver. Every row is a query and probes its nearest lists, as many as RECALL asks for: for queries sampled in
proportion to the square root of n (256 at least), exact neighbours among all vectors are found, and the lists
that hold them are ranked.

Lists that are near each other form a chunk of about BLOCK vectors. First each vector searches its own chunk.
Then it goes, with the k-th cosine that it has found, once to each other chunk that has a list it probes.
Asymmetric distances are added up from tables of the query and the codewords, and all vectors that may be as
near as the k-th are reranked by exact cosines. With a residual's quantisation error e, a neighbour at distance
r has a squared asymmetric distance of r**2 + e**2 + 2 * r * e * cos, and cos, the cosine between two directions
in d dimensions that know nothing of each other, has a deviation of 1 / sqrt(d): SIGMAS of it are allowed for.
However long or dense a list is, no number of candidates is set. The chunks' results of a query are merged at
last.

Rounding, ties, ids, rows that are left out and a row being no neighbour of itself: as in exact search (topk).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .topk import DIGITS, K, best, by_length, matrix, unit

#: Share of the sampled queries' neighbours whose lists are to be probed, and deviations of a neighbour's asymmetric distance.
RECALL, SIGMAS = 0.95, 1.5
SUBSPACES, CODES, ROUNDS = 16, 256, 5
#: Vectors of a chunk, queries that a task holds for it; vectors and queries of a tile.
BLOCK, QUERIES, TILE, WIDE = 8192, 16_384, 1024, 256
#: Vectors of a group, groups of a tile that give a vector each to be reranked first, parts of a squared distance of 1.
GROUP, FIRST, SCALE = 32, 32, 4096.0


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x to the centres, but for the rows' own squares."""
    return (centres * centres).sum(axis=1) - 2.0 * (x @ centres.T)


def split(x: np.ndarray, parts: int) -> np.ndarray:
    """x, filled up with zeros, as (parts, rows, part of a row)."""
    width = -(-x.shape[1] // parts)
    x = np.pad(x, ((0, 0), (0, width * parts - x.shape[1])))
    return x.reshape(len(x), parts, width).transpose(1, 0, 2)


def _lloyd(df: DataFrame, centres: np.ndarray, parts: Callable[[np.ndarray], np.ndarray], rounds: int) -> np.ndarray:
    """centres (parts, k, width) moved to the means of what is nearest to them; those with nothing near stay."""
    m, k, width = centres.shape
    names = [f"s{i}" for i in range(width)]
    for _ in range(rounds):

        def partial(batches: Iterator[pa.RecordBatch], centres: np.ndarray = centres) -> Iterator[pa.RecordBatch]:
            sums, n = np.zeros((m * k, width)), np.zeros(m * k, np.int64)
            for batch in batches:
                for j, x in enumerate(parts(unit(matrix(batch.column(0))))):
                    code = nearest(x, centres[j]).argmin(axis=1) + j * k
                    n += np.bincount(code, minlength=m * k)
                    for i in range(width):
                        sums[:, i] += np.bincount(code, x[:, i], m * k)
            on = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(n[on]), *(pa.array(sums[on, i]) for i in range(width))], ["key", "n", *names])

        moved = df.select("vec").mapInArrow(partial, "key bigint, n bigint, " + ", ".join(f"{x} double" for x in names))
        rows = moved.groupBy("key").agg(F.sum("n").alias("n"), *(F.sum(x).alias(x) for x in names)).collect()  # one row a centre
        centres = centres.copy()
        for r in rows:
            centres[r["key"] // k, r["key"] % k] = [r[x] / r["n"] for x in names]
    return centres


def chunks(centres: np.ndarray, counts: np.ndarray, most: int = BLOCK) -> list[np.ndarray]:
    """Lists in groups of neighbours that hold about `most` vectors each, by halving along the widest direction; a longer list is a group."""
    out, todo = [], [np.flatnonzero(counts)]
    while todo:
        part = todo.pop()
        if not len(part):
            continue
        if len(part) == 1 or counts[part].sum() <= most:
            out.append(part)
            continue
        x = centres[part] - centres[part].mean(axis=0)
        side = x @ np.linalg.svd(x, full_matrices=False)[2][0]
        part = part[np.argsort(side, kind="stable")]
        at = int(np.searchsorted(np.cumsum(counts[part]), counts[part].sum() / 2))
        at = min(max(at, 1), len(part) - 1)
        todo += [part[at:], part[:at]]
    return out


class Chunk:
    """The vectors of some lists, in the order of the lists and of their quantisation errors, ready to be searched.

    of: the list of each vector, by its place in centres. Distances are added up as 16-bit multiples of
    1 / SCALE, which the limit allows for.
    """

    def __init__(self, x: np.ndarray, ids: np.ndarray, row: np.ndarray, codes: np.ndarray, of: np.ndarray, centres: np.ndarray, books: np.ndarray) -> None:
        decoded = np.concatenate([b[codes[:, j]] for j, b in enumerate(books)], 1)[:, : x.shape[1]]
        e2 = ((x - centres[of] - decoded) ** 2).sum(axis=1)
        self.order = order = np.lexsort((e2, of))
        x, decoded, of = x[order], decoded[order], of[order]
        self.x, self.x32, self.ids, self.row, self.of, self.centres, self.books, self.e2 = x, x.astype(np.float32), ids[order], row[order], of, centres, books, e2[order]
        # what a vector adds to the squared distance of any query, and the deviation of its neighbours' distances
        self.fixed = np.round(SCALE * ((decoded * decoded).sum(axis=1) + 2.0 * (decoded * centres[of]).sum(axis=1))).astype(np.int16)
        self.slack = 2.0 * SIGMAS / math.sqrt(x.shape[1]) * np.sqrt(self.e2)
        self.codes = [np.ascontiguousarray(codes[order, j], np.intp) for j in range(len(books))]
        self.start = np.searchsorted(of, np.arange(len(centres) + 1))

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """For each part of a vector, what each codeword adds to each query's distance."""
        return [np.round(-2.0 * SCALE * (b @ p.T)).astype(np.int16) for b, p in zip(self.books, split(q, len(self.books)))]

    def distances(self, to_list: np.ndarray, tables: list[np.ndarray], lo: int, hi: int, out: np.ndarray) -> None:
        """Asymmetric distances of the vectors lo to hi from the queries."""
        for at in range(lo, hi, TILE):
            end = min(at + TILE, hi)
            part = out[at - lo : end - lo]
            np.take(to_list, self.of[at:end], axis=0, out=part, mode="clip")
            part += self.fixed[at:end, None]
            room = np.empty_like(part)
            for table, code in zip(tables, self.codes):
                np.take(table, code[at:end], axis=0, out=room, mode="clip")
                part += room

    def within(self, far: np.ndarray, lo: int, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries and vectors, of those from lo on, that may have a cosine of at least `edge`."""
        # the furthest that such a cosine, once rounded, can be
        reach = np.sqrt(np.clip(2.0 - 2.0 * (edge - 10.0**-DIGITS), 0.0, 4.0))
        queries, found = [], []
        for first in range(0, len(far), TILE // 4):
            part = far[first : first + TILE // 4]
            at = lo + first + len(part)
            limit = SCALE * (reach * reach + self.e2[lo + first : at].max() + self.slack[lo + first : at].max() * reach) + len(self.codes) / 4
            b, a = np.divmod(np.flatnonzero(part <= np.minimum(limit, 32766.0).astype(np.int16)), far.shape[1])
            queries.append(a)
            found.append(b + lo + first)
        return np.concatenate(queries), np.concatenate(found)

    def rerank(self, q: np.ndarray, q_row: np.ndarray, edge: np.ndarray, a: np.ndarray, b: np.ndarray, s: np.ndarray, i: np.ndarray, k: int) -> None:
        """Puts vectors b of queries a into the k best so far (s, i), by exact cosines."""
        q32, kept = q.astype(np.float32), []
        for at in range(0, len(a), 8 * TILE):  # most are told by single precision
            c = np.einsum("ij,ij->i", q32[a[at : at + 8 * TILE]], self.x32[b[at : at + 8 * TILE]])
            kept.append(at + np.flatnonzero(c >= edge[a[at : at + 8 * TILE]] - 1e-5))
        on = np.concatenate(kept) if kept else np.zeros(0, np.int64)
        on = on[self.row[b[on]] != q_row[a[on]]]
        on = on[np.argsort(a[on].astype(np.int16), kind="stable")]
        a, b = a[on], b[on]
        size = np.bincount(a, minlength=len(q))
        begin = np.cumsum(size) - size
        # queries with as many candidates together, so that one with many doesn't widen all
        for some in np.array_split(np.argsort(size, kind="stable"), 8):
            width = int(size[some].max()) if len(some) else 0
            for first in range(0, width, 2 * TILE):
                place = first + np.arange(min(width - first, 2 * TILE))
                there = place < size[some, None]
                near = b[np.where(there, begin[some, None] + place, 0)]
                c = np.round(np.matmul(self.x[near], q[some][:, :, None])[:, :, 0], DIGITS)
                c[~there] = -np.inf
                c, near = best(c, self.ids[near], k)
                s[some], i[some] = best(np.concatenate([s[some], c], 1), np.concatenate([i[some], near], 1), k)

    def search_all(self, q: np.ndarray, q_row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of all vectors for each query: cosines and ids, -inf where there are fewer."""
        s, i = np.full((len(q), k), -np.inf), np.full((len(q), k), -1, np.int64)
        n, groups = len(self.x), -(-len(self.x) // GROUP)
        for lo in range(0, len(q), WIDE):
            part, mine = q[lo : lo + WIDE], q_row[lo : lo + WIDE]
            padded = np.full((groups * GROUP, len(part)), np.iinfo(np.int16).max, np.int16)
            self.distances(np.round(SCALE * (nearest(part, self.centres) + 1.0)).T.astype(np.int16), self.tables(part), 0, n, padded[:n])
            # the nearest of each of the FIRST groups that have the nearest vectors come first, and tell how near the others have to be
            most = min(max(FIRST, k), groups)
            picked = np.argpartition(padded.reshape(groups, GROUP, len(part)).min(axis=1), most - 1, axis=0)[:most].T
            places = picked[:, :, None] * GROUP + np.arange(GROUP)
            spot = picked * GROUP + padded[places, np.arange(len(part))[:, None, None]].argmin(axis=2)
            spot = np.minimum(spot, n - 1)
            c = np.round(np.matmul(self.x[spot], part[:, :, None])[:, :, 0], DIGITS)
            c[self.row[spot] == mine[:, None]] = -np.inf
            edge = np.partition(c, most - k, axis=1)[:, most - k] if most >= k else np.full(len(part), -1.0)
            edge = np.maximum(edge, -1.0)
            self.rerank(part, mine, edge, *self.within(padded[:n], 0, edge), s[lo : lo + WIDE], i[lo : lo + WIDE], k)
        return s, i

    def search_lists(self, q: np.ndarray, q_row: np.ndarray, probed: np.ndarray, edge: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best, with a cosine of at least `edge`, of the vectors in the lists that each query probes."""
        s, i = np.full((len(q), k), -np.inf), np.full((len(q), k), -1, np.int64)
        order = np.argsort(nearest(q, self.centres).argmin(axis=1), kind="stable")
        for lo in range(0, len(q), WIDE):
            mine = order[lo : lo + WIDE]
            part, limit = q[mine], np.maximum(edge[mine], -1.0)
            tables = self.tables(part)
            to_list = np.round(SCALE * (nearest(part, self.centres) + 1.0)).T.astype(np.int16)
            found = []
            for li in np.flatnonzero(probed[mine].any(axis=0)):
                on = np.flatnonzero(probed[mine, li])
                first, last = self.start[li], self.start[li + 1]
                far = np.empty((last - first, len(on)), np.int16)
                every = len(on) == len(part)
                self.distances(to_list if every else to_list[:, on], tables if every else [t[:, on] for t in tables], first, last, far)
                if last > first:
                    a, b = self.within(far, first, limit[on])
                    found.append((on[a], b))
            if found:
                part_s, part_i = s[mine], i[mine]
                self.rerank(part, q_row[mine], limit, np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found]), part_s, part_i, k)
                s[mine], i[mine] = part_s, part_i
        return s, i


def neighbours(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, recall: float = RECALL) -> DataFrame:
    """(id, rank, neighbour, cosine) with rank from 1 to k, for every usable vector."""
    return by_length(df, id_col, vec_col, lambda usable, n: _neighbours(usable, n, k, recall))


def _probes(usable: DataFrame, sample: np.ndarray, rows: np.ndarray, centres: np.ndarray, k: int, recall: float) -> tuple[int, np.ndarray]:
    """How many lists each query has to probe to find that share of the sample's exact neighbours; the number of vectors of each list."""
    model = usable.sparkSession.sparkContext.broadcast((sample, rows, centres))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample, rows, centres = model.value
        s, i = np.full((len(sample), k), -np.inf), np.full((len(sample), k), -1, np.int64)
        counts = np.zeros(len(centres), np.int64)
        for batch in batches:
            x, row = unit(matrix(batch.column(1))), batch.column(0).to_numpy()
            near = nearest(x, centres).argmin(axis=1)
            counts += np.bincount(near, minlength=len(centres))
            for lo in range(0, len(x), TILE):
                c = sample @ x[lo : lo + TILE].T
                c[rows[:, None] == row[None, lo : lo + TILE]] = -np.inf
                c, li = best(c, near[None, lo : lo + TILE], k)
                s, i = best(np.concatenate([s, c], 1), np.concatenate([i, li], 1), k)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sample), dtype=np.int64)), pa.array([x.tobytes() for x in s], pa.binary()), pa.array([x.tobytes() for x in i], pa.binary()), pa.array([None] * len(sample), pa.int64())], ["q", "s", "i", "n"])
        on = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(-1 - on), pa.array([b""] * len(on), pa.binary()), pa.array([b""] * len(on), pa.binary()), pa.array(counts[on])], ["q", "s", "i", "n"])

    def merged(table: pa.Table) -> pa.Table:
        q = table.column("q")[0].as_py()
        if q < 0:
            return pa.table({"q": [q], "n": [sum(table.column("n").to_pylist())], "ranks": pa.array([[]], pa.list_(pa.int32()))})
        sample, _, centres = model.value
        s = np.concatenate([np.frombuffer(b) for b in table.column("s").to_pylist()])[None]
        i = np.concatenate([np.frombuffer(b, np.int64) for b in table.column("i").to_pylist()])[None]
        s, i = best(s, i, k)
        rank = np.empty(len(centres), np.int32)
        rank[np.argsort(nearest(sample[q : q + 1], centres)[0], kind="stable")] = np.arange(len(centres))
        return pa.table({"q": [q], "n": [0], "ranks": pa.array([rank[i[0][s[0] > -np.inf]].tolist()], pa.list_(pa.int32()))})

    got = usable.select("row", "vec").mapInArrow(partial, "q bigint, s binary, i binary, n bigint").groupBy("q").applyInArrow(merged, "q bigint, n bigint, ranks array<int>").collect()  # a row a list and a sampled query
    counts = np.zeros(len(centres), np.int64)
    for r in got:
        if r["q"] < 0:
            counts[-1 - r["q"]] = r["n"]
    ranks = np.sort([x for r in got if r["q"] >= 0 for x in r["ranks"]])
    return (int(ranks[min(len(ranks) - 1, math.ceil(recall * len(ranks)))]) + 1 if len(ranks) else 1), counts


def _neighbours(usable: DataFrame, n: int, k: int, recall: float) -> DataFrame:
    """(id, rank, neighbour, cosine) among the n vectors (id, row, vec) of one length."""
    lists = max(1, min(n, round(math.sqrt(n) / 4)))
    sampled = max(round(math.sqrt(n)), min(n, CODES))
    first = usable.orderBy(F.xxhash64("id", "row"), "row").limit(sampled).select("row", "vec").collect()
    seeds, seed_rows = unit(np.array([r["vec"] for r in first], float)), np.array([r["row"] for r in first])
    centres = _lloyd(usable, seeds[None, :lists], lambda x: x[None], ROUNDS)[0]
    residual = lambda x: x - centres[nearest(x, centres).argmin(axis=1)]
    m = min(SUBSPACES, seeds.shape[1])
    books = _lloyd(usable, split(residual(seeds[: min(n, CODES)]), m), lambda x: split(residual(x), m), ROUNDS)
    each, counts = _probes(usable, seeds, seed_rows, centres, k, recall)
    groups = chunks(centres, counts)
    # a list longer than a chunk is cut into pieces
    pieces = [max(1, -(-int(counts[g].sum()) // (2 * BLOCK))) for g in groups]
    at = np.concatenate([[0], np.cumsum(pieces)])
    of_list = np.full(lists, -1)
    for c, g in enumerate(groups):
        of_list[g] = c
    # lists times dimensions and codewords: grows with the square root of the rows
    model = usable.sparkSession.sparkContext.broadcast((centres, books, groups, at, of_list))
    salts = max(1, math.ceil(n / QUERIES))
    blocks = max(1, math.ceil(n / QUERIES * 8))
    kind = np.float32 if usable.schema["vec"].dataType.elementType.typeName() == "float" else np.float64
    raw = lambda column: matrix(column).astype(kind)

    def probe(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        probed = np.zeros((len(x), lists), bool)
        np.put_along_axis(probed, np.argpartition(nearest(x, centres), each - 1, axis=1)[:, :each], True, 1)
        return probed

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, books, groups, at, of_list = model.value
        width = np.diff(at)
        for batch in batches:
            v, row = raw(batch.column(2)), batch.column(1).to_numpy()
            x = unit(v.astype(np.float64))
            near = nearest(x, centres).argmin(axis=1)
            codes = np.stack([nearest(r, books[j]).argmin(axis=1) for j, r in enumerate(split(x - centres[near], m))], 1).astype(np.uint8)
            group = of_list[near]
            chunk = at[group] + row % width[group]
            yield pa.RecordBatch.from_arrays([pa.array(chunk.astype(np.int32)), batch.column(0), batch.column(1), pa.array(near.astype(np.int32)), pa.array([r.tobytes() for r in v], pa.binary()), pa.array([r.tobytes() for r in codes], pa.binary())], ["chunk", "id", "row", "list", "x", "code"])

    def members(table: pa.Table) -> tuple[Chunk, np.ndarray]:
        centres, books, groups, at, _ = model.value
        mine = np.sort(groups[int(np.searchsorted(at, table.column("chunk")[0].as_py(), "right")) - 1])
        v = np.frombuffer(b"".join(table.column("x").to_pylist()), kind).reshape(len(table), -1)
        codes = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(len(table), -1)
        part = Chunk(unit(v.astype(np.float64)), table.column("id").to_numpy(), table.column("row").to_numpy(), codes, np.searchsorted(mine, table.column("list").to_numpy()), centres[mine], books)
        return part, v[part.order]

    def at_home(table: pa.Table) -> pa.Table:
        part, v = members(table)
        out = []
        for lo in range(0, len(part.x), TILE):
            cut = slice(lo, lo + TILE)
            s, i = part.search_all(part.x[cut], part.row[cut], k)
            out.append((part.ids[cut].tobytes(), part.row[cut].tobytes(), s.tobytes(), i.tobytes(), v[cut].tobytes(), table.column("chunk")[0].as_py()))
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), home)], schema=home)

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, _, groups, at, of_list = model.value
        for batch in batches:
            for r in batch.to_pylist():
                row, ids = np.frombuffer(r["rows"], np.int64), np.frombuffer(r["ids"], np.int64)
                v, edge = np.frombuffer(r["xs"], kind).reshape(len(row), -1), np.frombuffer(r["score"]).reshape(len(row), -1)[:, -1]
                probed, salt = probe(unit(v.astype(np.float64)), centres), row % salts
                for c, g in enumerate(groups):
                    goes = probed[:, g].any(axis=1)
                    for sa in range(salts):
                        on = np.flatnonzero(goes & (salt == sa))
                        for chunk in range(at[c], at[c + 1]) if len(on) else ():
                            if chunk != r["chunk"]:
                                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([sa], pa.int32()), *(pa.array([y[on].tobytes()]) for y in (ids, row, edge, v))], ["chunk", "salt", "ids", "rows", "edge", "xs"])

    def abroad(queries: pa.Table, table: pa.Table) -> pa.Table:
        if not len(queries) or not len(table):
            return found.empty_table()
        join = lambda name, kind: np.concatenate([np.frombuffer(b, kind) for b in queries.column(name).to_pylist()])
        ids, row, edge = join("ids", np.int64), join("rows", np.int64), join("edge", np.float64)
        q = unit(join("xs", kind).reshape(len(ids), -1).astype(np.float64))
        part, _ = members(table)
        centres, _, groups, at, _ = model.value
        mine = np.sort(groups[int(np.searchsorted(at, table.column("chunk")[0].as_py(), "right")) - 1])
        probed = np.concatenate([probe(q[lo : lo + TILE], centres)[:, mine] for lo in range(0, len(q), TILE)])
        s, i = part.search_lists(q, row, probed, edge, k)
        hit = s[:, 0] > -np.inf  # most chunks have nothing better
        return by_block(ids[hit], row[hit], s[hit], i[hit])

    def by_block(ids: np.ndarray, row: np.ndarray, s: np.ndarray, i: np.ndarray) -> pa.Table:
        block = row % blocks
        used = np.unique(block)
        pick = [np.flatnonzero(block == b) for b in used]
        return pa.table([pa.array(used, pa.int32()), *(pa.array([y[p].tobytes() for p in pick], pa.binary()) for y in (ids, row, s, i))], schema=found)

    def first_results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                row = np.frombuffer(r["rows"], np.int64)
                yield from by_block(np.frombuffer(r["ids"], np.int64), row, np.frombuffer(r["score"]).reshape(len(row), -1), np.frombuffer(r["near"], np.int64).reshape(len(row), -1)).to_batches()

    def merge(table: pa.Table) -> pa.Table:
        join = lambda name, kind=np.int64: np.concatenate([np.frombuffer(b, kind) for b in table.column(name).to_pylist()])
        ids, row, s, i = join("ids"), join("rows"), join("score", np.float64).reshape(-1, k), join("near").reshape(-1, k)
        flat = np.flatnonzero(s.reshape(-1) > -np.inf)
        s, i, ids, row = s.reshape(-1)[flat], i.reshape(-1)[flat], ids[flat // k], row[flat // k]
        order = np.lexsort((i, -s, row))
        s, i, ids, row = s[order], i[order], ids[order], row[order]
        start = np.flatnonzero(np.diff(row, prepend=row[:1] - 1)) if len(row) else np.zeros(0, np.int64)
        rank = np.arange(len(row)) - np.repeat(start, np.diff(start, append=len(row))) + 1
        on = rank <= k
        return pa.table({"id": ids[on], "rank": rank[on].astype(np.int32), "neighbour": i[on], "cosine": s[on] + 0.0})

    found = pa.schema([("block", pa.int32()), ("ids", pa.binary()), ("rows", pa.binary()), ("score", pa.binary()), ("near", pa.binary())])
    home = pa.schema([*list(found)[1:], ("xs", pa.binary()), ("chunk", pa.int32())])
    placed = materialise(usable.select("id", "row", "vec").mapInArrow(coded, "chunk int, id bigint, row bigint, list int, x binary, code binary"), "coded")
    kinds = "ids binary, rows binary, score binary, near binary"
    homes = materialise(placed.groupBy("chunk").applyInArrow(at_home, f"{kinds}, xs binary, chunk int"), "home")
    queries = homes.mapInArrow(probing, "chunk int, salt int, ids binary, rows binary, edge binary, xs binary")
    salted = placed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    others = queries.groupBy("chunk", "salt").cogroup(salted.groupBy("chunk", "salt")).applyInArrow(abroad, f"block int, {kinds}")
    results = homes.drop("xs", "chunk").mapInArrow(first_results, f"block int, {kinds}").unionByName(others)
    return results.groupBy("block").applyInArrow(merge, "id bigint, rank int, neighbour bigint, cosine double")
