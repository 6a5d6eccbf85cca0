"""A binary form of series, histories and groups: one Arrow stream, compressed, with what it holds in its schema.

Rows are long: name, insertion date, value date, number, text. What has several parts (many series, a history,
a group, a history of groups) lists them in the schema, so that empty ones come back too.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

import pandas as pd
import pyarrow as pa

COMPRESSION = "zstd"


def _table(series: pd.Series) -> pa.Table:
    index = series.index.tz_convert("UTC").tz_localize(None) if series.index.tz is not None else series.index
    text = not pd.api.types.is_numeric_dtype(series.dtype)
    null = pd.isna(series).to_numpy()
    values = series.to_numpy()
    return pa.table({
        "value_date": pa.array(index.as_unit("ns"), pa.timestamp("ns")),
        "num": pa.nulls(len(series), pa.float64()) if text else pa.array(values, pa.float64(), mask=null),
        "txt": pa.array([None if n else v for n, v in zip(null, values)], pa.string()) if text else pa.nulls(len(series), pa.string()),
    })


def _about(series: pd.Series) -> dict[str, Any]:
    return {"name": series.name, "tz": series.index.tz is not None, "text": not pd.api.types.is_numeric_dtype(series.dtype), "rows": len(series)}


def _write(kind: str, parts: list[tuple[dict[str, Any], pd.Series]], **more: Any) -> bytes:
    tables = [_table(s) for _, s in parts] or [_table(pd.Series(dtype=float, index=pd.DatetimeIndex([])))]
    about = {"kind": kind, "parts": [{**_about(s), **a} for a, s in parts], **more}
    table = pa.concat_tables(tables)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema.with_metadata({"about": json.dumps(about)}), options=pa.ipc.IpcWriteOptions(compression=COMPRESSION)) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _read(raw: bytes, kind: str) -> tuple[dict[str, Any], list[pd.Series]]:
    with pa.ipc.open_stream(raw) as stream:
        table = stream.read_all()
        about = json.loads(stream.schema.metadata[b"about"])
    if about["kind"] != kind:
        raise ValueError(f"this holds a {about['kind']}, not a {kind}")
    out, at = [], 0
    for p in about["parts"]:
        rows = table.slice(at, p["rows"])
        at += p["rows"]
        index = pd.DatetimeIndex(rows.column("value_date").to_pandas()).rename(None)
        values = rows.column("txt").to_pylist() if p["text"] else rows.column("num").to_numpy()
        s = pd.Series(values, index=index.tz_localize("UTC") if p["tz"] else index, dtype="object" if p["text"] else "float64", name=p["name"])
        out.append(s)
    return about, out


def pack_series(series: pd.Series, metadata: Mapping[str, Any] | None = None) -> bytes:
    """A series, with metadata."""
    return _write("series", [({}, series)], metadata=dict(metadata or {}))


def unpack_series(raw: bytes) -> tuple[dict[str, Any], pd.Series]:
    """Metadata and series."""
    about, (series,) = _read(raw, "series")
    return about["metadata"], series


def pack_many_series(series: list[tuple[Mapping[str, Any], pd.Series]]) -> bytes:
    """Series, each with its metadata."""
    return _write("list", [({"metadata": dict(m)}, s) for m, s in series])


def unpack_many_series(raw: bytes) -> list[tuple[dict[str, Any], pd.Series]]:
    """Metadata and series of each."""
    about, series = _read(raw, "list")
    return [(p["metadata"], s) for p, s in zip(about["parts"], series)]


def pack_history(history: Mapping[pd.Timestamp, pd.Series], metadata: Mapping[str, Any] | None = None) -> bytes:
    """A series for each insertion date."""
    return _write("history", [({"date": d.isoformat()}, s) for d, s in history.items()], metadata=dict(metadata or {}))


def unpack_history(raw: bytes) -> tuple[dict[str, Any], dict[pd.Timestamp, pd.Series]]:
    """Metadata and history."""
    about, series = _read(raw, "history")
    return about["metadata"], {pd.Timestamp(p["date"]): s for p, s in zip(about["parts"], series)}


def pack_group(frame: pd.DataFrame) -> bytes:
    """A wide frame, a column for each member."""
    return _write("group", [({}, frame[c]) for c in frame.columns])


def unpack_group(raw: bytes) -> pd.DataFrame:
    """The frame of pack_group()."""
    _, series = _read(raw, "group")
    return pd.DataFrame({s.name: s for s in series})


def pack_group_history(history: Mapping[pd.Timestamp, pd.DataFrame]) -> bytes:
    """A wide frame for each insertion date."""
    return _write("group history", [({"date": d.isoformat()}, frame[c]) for d, frame in history.items() for c in frame.columns])


def unpack_group_history(raw: bytes) -> dict[pd.Timestamp, pd.DataFrame]:
    """The history of pack_group_history()."""
    about, series = _read(raw, "group history")
    out: dict[str, dict[str, pd.Series]] = {}
    for p, s in zip(about["parts"], series):
        out.setdefault(p["date"], {})[s.name] = s
    return {pd.Timestamp(d): pd.DataFrame(columns) for d, columns in out.items()}
