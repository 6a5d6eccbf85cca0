"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes up to which a side of a join may be broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 64_000_000
#: Bytes of text that a Python worker handles at a time, so that its memory doesn't depend on the Arrow batch.
CHUNK_BYTES = 1_000_000


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names made of the stems that no column of df has, in whatever case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        name = f"__{stem}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, else the context's checkpoint folder.

    Only where neither is set, as in tests on one machine, a temporary folder is made and set.
    """
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    sc = spark.sparkContext
    if not (path := sc.getCheckpointDir()):
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="chronostrata-"))
        path = sc.getCheckpointDir()
    return path.rstrip("/")


#: The tables written in each open scratch().
_OPEN: list[list[DataFrame]] = []


@contextlib.contextmanager
def scratch(*kept: DataFrame) -> Iterator[list[DataFrame]]:
    """Deletes, at its end, the tables that operators write in it, but for those added to the list that it gives.

    Results are computed when they are written: with scratch(): operator(docs).write.parquet(path).
    """
    keep = list(kept)
    _OPEN.append([])
    try:
        yield keep
    finally:
        written = _OPEN.pop()
        discard(*(df for df in written if not any(df is k for k in keep)))
        if _OPEN:
            _OPEN[-1] += [df for df in written if any(df is k for k in keep)]


def materialise(df: DataFrame, stem: str) -> DataFrame:
    """df written as a table in the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{stem}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    if _OPEN:
        _OPEN[-1].append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what materialise() wrote, when nothing that is still to be computed reads it; what is gone already is let pass."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def _width(kind: T.DataType) -> int:
    """About the bytes of a value."""
    if isinstance(kind, T.StructType):
        return sum(_width(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return 16 * _width(kind.elementType)
    return 48 if isinstance(kind, (T.StringType, T.BinaryType)) else 16


def small(df: DataFrame, rows: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its counted rows take no more bytes than the limit; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows * max(16, _width(df.schema)) <= limit else df


def slices(batches: Iterable[pa.RecordBatch], column: int, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that have about `most` bytes of text each; a longer text is a slice by itself."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + most, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi
    trim()


def trim() -> None:
    """Gives memory that a task has freed back to the system: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)
