"""Sharding by minimax contiguous partition.

Rows are grouped by a key into atoms that no shard may split; the atoms, in the order of their keys, are cut
into at most `shards` runs so that the largest run is as small as can be. The least capacity is found by binary
search, each capacity being checked greedily: a run takes atoms for as long as they fit.

Prefix sums are computed on the cluster, range by range, and written in order. The search sees them through
cells: what is known of a cell of prefix sums is its first and its last one. Greedy runs that end with the last
prefix sum known to be in reach need too many shards, if anything; those that end as far as they might need too
few. Capacities on which both agree are decided. The others, and the spans in which cuts of theirs may lie, are
looked at again through cells of those spans alone, until there is nothing between them. With k shards and cells
of width w the spans are about k * k * w wide; a round has CELLS * k * k cells, whatever the number of atoms, so
that each makes the spans about CELLS times narrower. One task has the cells of a round; the driver gets two
numbers a shard, and a row for each range.

Null keys form one atom, before all others. Rows of one key are one atom; null and negative values have size 0,
fractions are cut off. Fewer atoms than shards: the others stay empty. An empty table has no shards. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise

SHARDS = 64
#: Cells of a round for each pair of shards, of which a span is at most so many wide.
CELLS = 16
#: Least and greatest capacity, and places of each cut.
Bounds = tuple[int, int, list[int], list[int]]


def greedy(first: np.ndarray, last: np.ndarray, capacity: int, total: int, shards: int, far: bool) -> list[int] | None:
    """The ends of the runs but the last, or None if there are more than shards. far: cells are taken to hold every prefix sum between their first and last."""
    out, at = [], 0
    while total - at > capacity:
        reach = at + capacity
        k = int(np.searchsorted(first, reach, "right")) - 1
        if len(out) + 1 == shards or k < 0:
            return None
        end = int(last[k]) if last[k] <= reach else reach if far else int(first[k])
        if end <= at:
            return None
        out.append(end)
        at = end
    return out


def narrow(first: np.ndarray, last: np.ndarray, low: int, high: int, total: int, shards: int) -> Bounds:
    """The least capacity that may do and the least that is known to, from low to high, and for each cut the first and last place for the capacities between.

    first, last: the least and greatest prefix sum of each cell, in order; none that a cut may have is missing.
    """

    def least(far: bool, lo: int, hi: int) -> int:
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if greedy(first, last, mid, total, shards, far) is not None else (mid + 1, hi)
        return lo

    low = least(True, low, high)
    high = least(False, low, high)
    # of the least capacity's cuts nothing may be missing: a greedy run of it that fails goes on from where it is
    from_, upto, at, to = [], [], 0, 0
    while len(from_) < shards - 1 and (total - at > low or total - to > high):
        k = int(np.searchsorted(first, at + low, "right")) - 1
        at = max(at, (int(last[k]) if last[k] <= at + low else int(first[k])) if k >= 0 else 0)
        k = int(np.searchsorted(first, to + high, "right")) - 1
        to = max(to, min(int(last[k]), to + high) if k >= 0 else 0)
        from_.append(at)
        upto.append(to)
    return low, high, from_, upto


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans in order, those that meet being one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def cuts(look: Callable[[list[tuple[int, int]], int, int, int], Bounds], total: int, largest: int, shards: int) -> list[int]:
    """The prefix sums at which the runs of the least capacity end, the last left out.

    look(spans, width, low, high): narrow() of the cells of that width in the spans.
    """
    low = max(largest, -(-total // shards))
    high, spans, out = low + largest, [(0, total)], []
    while total:
        width = max(1, -(-sum(hi - lo + 1 for lo, hi in spans) // (CELLS * shards * shards)))
        low, high, first, last = look(spans, width, low, high)
        out = list(first)
        if low == high and out == list(last):
            break
        spans = merged(list(zip(first, last)))
    return out


def shard(df: DataFrame, key_col: str, size: Column, shards: int = SHARDS) -> DataFrame:
    """(key, size, shard) for each atom, shards being numbered from 0 in the order of the keys."""
    spark = df.sparkSession
    atoms = df.select(F.col(key_col).alias("key"), F.greatest(F.coalesce(size.cast("bigint"), F.lit(0)), F.lit(0)).alias("size")).groupBy("key").agg(F.sum("size").alias("size"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # written, so that a row's range is the same whenever it is read
    ranged = materialise(atoms.repartitionByRange(ranges, F.col("key").asc_nulls_first()).select("*", F.spark_partition_id().alias("range")), "atoms")
    sums = sorted((r["range"], r["s"], r["m"]) for r in ranged.groupBy("range").agg(F.sum("size").alias("s"), F.max("size").alias("m")).collect())  # a row for each range
    total, largest, before = 0, max((m for *_, m in sums), default=0), []
    for k, s, _ in sums:
        before.append((k, total))
        total += s
    starts = F.broadcast(spark.createDataFrame(before, "range int, before bigint"))
    order = Window.partitionBy("range").orderBy(F.col("key").asc_nulls_first())
    placed = ranged.join(starts, "range").withColumn("end", F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("range", "before")
    placed = materialise(placed, "ends")
    discard(ranged)

    def look(spans: list[tuple[int, int]], width: int, low: int, high: int) -> Bounds:
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(list(batches))
            lo, hi, from_, upto = narrow(np.sort(table.column(0).to_numpy()), np.sort(table.column(1).to_numpy()), low, high, total, shards)
            yield pa.RecordBatch.from_arrays([pa.array([lo]), pa.array([hi]), pa.array([from_], pa.list_(pa.int64())), pa.array([upto], pa.list_(pa.int64()))], ["lo", "hi", "first", "last"])

        inside = F.lit(False)
        for lo, hi in spans:  # ranges of the column that the table is sorted by
            inside = inside | F.col("end").between(lo, hi)
        seen = placed.where(inside).groupBy(F.floor(F.col("end") / width).alias("cell")).agg(F.min("end").alias("first"), F.max("end").alias("last"))
        return tuple(seen.select("first", "last").coalesce(1).mapInArrow(task, "lo bigint, hi bigint, first array<bigint>, last array<bigint>").first())

    ends = cuts(look, total, largest, shards)
    # atoms of size 0 go with what is before them
    at = F.size(F.filter(F.array(*(F.lit(x).cast("bigint") for x in ends)), lambda x: x < F.col("end"))) if ends else F.lit(0)
    return placed.select("key", "size", at.cast("int").alias("shard"))


#: shard() of documents by doc_id and length of text, for DuckDB.
SQL = f"""
WITH RECURSIVE atom AS (
    SELECT doc_id AS key, CAST(sum(coalesce(strlen(text), 0)) AS BIGINT) AS size FROM documents GROUP BY doc_id
), p AS (
    SELECT key, size, CAST(sum(size) OVER (ORDER BY key NULLS FIRST ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e FROM atom
), l AS (
    SELECT list(size ORDER BY key NULLS FIRST) AS sizes, CAST(sum(size) AS BIGINT) AS total, max(size) AS largest FROM atom
), b AS (
    SELECT greatest(largest, CAST(ceil(total / {SHARDS}.0) AS BIGINT)) AS lo, greatest(largest, CAST(ceil(total / {SHARDS}.0) AS BIGINT)) + largest AS hi FROM l
    UNION ALL
    SELECT CASE WHEN ok THEN lo ELSE mid + 1 END, CASE WHEN ok THEN mid ELSE hi END FROM (
        SELECT lo, hi, (lo + hi) // 2 AS mid,
            list_reduce(list_prepend(CAST(1 AS BIGINT) << 40, (SELECT sizes FROM l)), lambda a, x: CASE WHEN (a & ((CAST(1 AS BIGINT) << 40) - 1)) + x <= (lo + hi) // 2 THEN a + x ELSE (((a >> 40) + 1) << 40) + x END) >> 40 <= {SHARDS} AS ok
        FROM b WHERE lo < hi)
), capacity AS (
    SELECT min(hi) AS c FROM b WHERE lo >= hi
), walk AS (
    SELECT 0 AS shard, CAST(0 AS BIGINT) AS lo, (SELECT max(e) FROM p WHERE e <= (SELECT c FROM capacity)) AS hi
    UNION ALL
    SELECT shard + 1, hi, (SELECT max(e) FROM p WHERE e <= walk.hi + (SELECT c FROM capacity)) FROM walk WHERE hi < (SELECT total FROM l)
)
SELECT key, size, CAST(shard AS INTEGER) AS shard FROM p JOIN walk ON (e > lo OR lo = 0) AND e <= hi
"""
