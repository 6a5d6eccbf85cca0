"""A REST server over a TimeSeries object, and a client with the same methods; JSON bodies, or the binary form for those who ask.

Errors of use are answered with 418 and their text, unknown names with 404, a rename to a taken name with
409, writes to a secondary source with 405, bad arguments with 400.
"""

from __future__ import annotations

import json
import math
import threading
from base64 import b64encode
from datetime import datetime, timedelta
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.error import HTTPError
from urllib.parse import parse_qs, urlencode, urlsplit
from urllib.request import Request, urlopen

import pandas as pd

from ..api import Descriptor, TimeSeries
from . import wire


#: The content type of the binary form (wire), which a client may ask for instead of JSON.
BINARY = "application/vnd.apache.arrow.stream"


def pack(s: pd.Series) -> dict[str, Any]:
    """A series as JSON: dates in ISO form, null for NaN; infinities as text."""
    values = [None if pd.isna(v) else (str(v) if isinstance(v, float) and math.isinf(v) else v) for v in s.tolist()]
    return {"tz": s.index.tz is not None, "kind": "object" if s.dtype == object or str(s.dtype).startswith("str") else "float64", "index": [t.isoformat() for t in s.index], "values": values}


def unpack(d: dict[str, Any], name: str | None = None) -> pd.Series:
    """The series of pack()."""
    index = pd.DatetimeIndex(pd.to_datetime(d["index"], utc=True, format="ISO8601")) if d["tz"] else pd.DatetimeIndex(pd.to_datetime(d["index"], format="ISO8601"))
    if d["kind"] == "float64":
        return pd.Series([math.nan if v is None else float(v) for v in d["values"]], index=index, name=name, dtype="float64")
    return pd.Series(d["values"], index=index, name=name, dtype="object")


def _when(text: str | None) -> datetime | None:
    return None if text is None else datetime.fromisoformat(text)


def _history(h: dict | None) -> dict | None:
    return None if h is None else {k.isoformat(): pack(v) for k, v in h.items()}


class _Failure(Exception):
    def __init__(self, status: int, text: str) -> None:
        super().__init__(text)
        self.status = status


def _frame(x: pd.DataFrame) -> dict[str, Any]:
    return {c: pack(x[c]) for c in x.columns}


class _Handler(BaseHTTPRequestHandler):
    tsa: TimeSeries

    def log_message(self, *args: Any) -> None:
        """Nothing is printed for a request."""

    def _answer(self, status: int, body: Any) -> None:
        raw = body if isinstance(body, bytes) else b"" if status == 204 else json.dumps(body).encode()
        self.send_response(status)
        self.send_header("Content-Type", BINARY if isinstance(body, bytes) else "application/json")
        self.send_header("Content-Length", str(len(raw)))
        self.end_headers()
        self.wfile.write(raw)

    def _run(self) -> None:
        url = urlsplit(self.path)
        a = {k: v[0] for k, v in parse_qs(url.query, keep_blank_values=True).items()}
        if n := int(self.headers.get("Content-Length") or 0):
            a |= json.loads(self.rfile.read(n))
        try:
            route = getattr(self, f"{self.command.lower()}{url.path.replace('/', '_').replace('-', '_')}", None)
            if not route:
                raise _Failure(404, "no such route")
            self._answer(*route(a))
        except _Failure as e:
            self._answer(e.status, str(e))
        except (KeyError, TypeError) as e:
            self._answer(400, f"bad arguments: {e}")
        except (ValueError, AssertionError, SyntaxError) as e:
            self._answer(405 if "not allowed" in str(e) else 409 if "already exists" in str(e) else 418, str(e))

    do_GET = do_PUT = do_PATCH = do_DELETE = _run

    def _binary(self) -> bool:
        return BINARY in (self.headers.get("Accept") or "")

    def _known(self, a: dict[str, Any]) -> str:
        if not self.tsa.exists(a["name"]):
            raise _Failure(404, f"{a['name']} does not exist")
        return a["name"]

    def _group(self, a: dict[str, Any]) -> str:
        if not self.tsa.group_exists(a["name"]):
            raise _Failure(404, f"{a['name']} does not exist")
        return a["name"]

    @staticmethod
    def _bounds(a: dict[str, Any], *names: str) -> dict[str, datetime | None]:
        return {n: _when(a.get(n)) for n in names}

    def get_series_source(self, a: dict[str, Any]) -> tuple[int, Any]:
        return 200, self.tsa.source(self._known(a))

    def get_series_metadata(self, a: dict[str, Any]) -> tuple[int, Any]:
        kind = a.get("type", "standard")
        if kind == "exists":
            return 200, self.tsa.exists(a["name"])
        name = self._known(a)
        if kind == "interval":
            i = self.tsa.interval(name)
            return 200, [i.left.isoformat(), i.right.isoformat()]
        return 200, {"standard": self.tsa.metadata, "internal": self.tsa.internal_metadata, "type": self.tsa.type, "tzaware": self.tsa.tzaware}[kind](name)

    def put_series_metadata(self, a: dict[str, Any]) -> tuple[int, Any]:
        return 200, self.tsa.replace_metadata(self._known(a), a["metadata"])

    def patch_series_metadata(self, a: dict[str, Any]) -> tuple[int, Any]:
        return 200, self.tsa.update_metadata(self._known(a), a["metadata"])

    def patch_series_state(self, a: dict[str, Any]) -> tuple[int, Any]:
        there = self.tsa.exists(a["name"])
        write = self.tsa.replace if a.get("replace") else self.tsa.update
        out = write(a["name"], unpack(a["series"]), a["author"], a.get("metadata"), _when(a.get("insertion_date")))
        return 200 if there else 201, None if out is None else pack(out)

    def get_series_state(self, a: dict[str, Any]) -> tuple[int, Any]:
        name = self._known(a)
        out = self.tsa.get(name, **self._bounds(a, "revision_date", "from_value_date", "to_value_date"), _keep_nans=a.get("_keep_nans") == "1")
        return 200, wire.pack_series(out) if self._binary() else pack(out)

    def put_series_state(self, a: dict[str, Any]) -> tuple[int, Any]:
        return 204, self.tsa.rename(self._known(a), a["newname"])

    def delete_series_state(self, a: dict[str, Any]) -> tuple[int, Any]:
        return 204, self.tsa.delete(self._known(a))

    def put_series_strip(self, a: dict[str, Any]) -> tuple[int, Any]:
        return 204, self.tsa.strip(self._known(a), _when(a["insertion_date"]))

    def get_series_insertion_dates(self, a: dict[str, Any]) -> tuple[int, Any]:
        dates = self.tsa.insertion_dates(self._known(a), **self._bounds(a, "from_insertion_date", "to_insertion_date", "from_value_date", "to_value_date"))
        return 200, [d.isoformat() for d in dates]

    def get_series_history(self, a: dict[str, Any]) -> tuple[int, Any]:
        bounds = self._bounds(a, "from_insertion_date", "to_insertion_date", "from_value_date", "to_value_date")
        out = self.tsa.history(self._known(a), **bounds, diffmode=a.get("diffmode") == "1", _keep_nans=a.get("_keep_nans") == "1")
        return 200, wire.pack_history(out) if self._binary() else _history(out)

    def get_series_staircase(self, a: dict[str, Any]) -> tuple[int, Any]:
        return 200, pack(self.tsa.staircase(self._known(a), timedelta(seconds=float(a["delta"])), **self._bounds(a, "from_value_date", "to_value_date")))

    def get_series_block_staircase(self, a: dict[str, Any]) -> tuple[int, Any]:
        more = {k: json.loads(a[k]) for k in ("revision_freq", "revision_time", "maturity_offset", "maturity_time") if k in a}
        out = self.tsa.block_staircase(self._known(a), **self._bounds(a, "from_value_date", "to_value_date"), revision_tz=a.get("revision_tz", "UTC"), **more)
        return 200, pack(out.tz_convert("UTC") if out.index.tz is not None else out)

    def get_series_catalog(self, a: dict[str, Any]) -> tuple[int, Any]:
        return 200, [[*k, v] for k, v in self.tsa.catalog(a.get("allsources", "1") == "1").items()]

    def get_series_find(self, a: dict[str, Any]) -> tuple[int, Any]:
        found = self.tsa.find(a["query"], int(a["limit"]) if "limit" in a else None, a.get("meta") == "1")
        return 200, [[str(x), x.imeta, x.meta, x.source, x.kind] for x in found]

    def get_series_log(self, a: dict[str, Any]) -> tuple[int, Any]:
        rows = self.tsa.log(self._known(a), int(a["limit"]) if "limit" in a else None, _when(a.get("fromdate")), _when(a.get("todate")), json.loads(a["authors"]) if "authors" in a else None)
        return 200, [{**r, "date": r["date"].isoformat()} for r in rows]

    def get_series_basket(self, a: dict[str, Any]) -> tuple[int, Any]:
        return 200, [[str(x), x.imeta, x.meta, x.source, x.kind] for x in self.tsa.basket(a["name"])]

    def put_series_basket(self, a: dict[str, Any]) -> tuple[int, Any]:
        return 200, self.tsa.register_basket(a["name"], a["query"])

    def delete_series_basket(self, a: dict[str, Any]) -> tuple[int, Any]:
        return 200, self.tsa.delete_basket(a["name"])

    def get_series_baskets(self, a: dict[str, Any]) -> tuple[int, Any]:
        return 200, self.tsa.list_baskets()

    def get_series_basket_definition(self, a: dict[str, Any]) -> tuple[int, Any]:
        return 200, self.tsa.basket_definition(a["name"])

    def patch_group_state(self, a: dict[str, Any]) -> tuple[int, Any]:
        there = self.tsa.group_exists(a["name"])
        frame = pd.DataFrame({c: unpack(s) for c, s in a["frame"].items()})
        self.tsa.group_replace(a["name"], frame, a["author"], _when(a.get("insertion_date")))
        return 200 if there else 201, None

    def get_group_state(self, a: dict[str, Any]) -> tuple[int, Any]:
        out = self.tsa.group_get(self._group(a), **self._bounds(a, "revision_date", "from_value_date", "to_value_date"))
        return 200, wire.pack_group(out) if self._binary() else _frame(out)

    def put_group_state(self, a: dict[str, Any]) -> tuple[int, Any]:
        return 204, self.tsa.group_rename(self._group(a), a["newname"])

    def delete_group_state(self, a: dict[str, Any]) -> tuple[int, Any]:
        return 204, self.tsa.group_delete(self._group(a))

    def get_group_insertion_dates(self, a: dict[str, Any]) -> tuple[int, Any]:
        return 200, [d.isoformat() for d in self.tsa.group_insertion_dates(self._group(a), **self._bounds(a, "from_insertion_date", "to_insertion_date"))]

    def get_group_history(self, a: dict[str, Any]) -> tuple[int, Any]:
        h = self.tsa.group_history(self._group(a), **self._bounds(a, "from_insertion_date", "to_insertion_date", "from_value_date", "to_value_date"))
        return 200, wire.pack_group_history(h) if self._binary() else {k.isoformat(): _frame(v) for k, v in h.items()}

    def get_group_catalog(self, a: dict[str, Any]) -> tuple[int, Any]:
        return 200, [[*k, v] for k, v in self.tsa.group_catalog().items()]

    def get_group_metadata(self, a: dict[str, Any]) -> tuple[int, Any]:
        name = self._group(a)
        return 200, {"standard": self.tsa.group_metadata, "internal": self.tsa.group_internal_metadata, "type": self.tsa.group_type}[a.get("type", "standard")](name)

    def put_group_metadata(self, a: dict[str, Any]) -> tuple[int, Any]:
        return 200, self.tsa.update_group_metadata(self._group(a), a["metadata"])


def serve(tsa: TimeSeries, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server in a thread of its own; server_address tells its port, shutdown() ends it."""
    server = ThreadingHTTPServer((host, port), type("Handler", (_Handler,), {"tsa": tsa}))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server


class Client:
    """The methods of TimeSeries, answered by a server. It may be a secondary source of a TimeSeries."""

    def __init__(self, uri: str, auth: dict[str, str] | None = None, binary: bool = True) -> None:
        """auth: login and password, or token. binary: asks for the binary form of series, histories and groups."""
        self.uri, self._headers = uri.rstrip("/"), {"Content-Type": "application/json"}
        if binary:
            self._headers["Accept"] = f"{BINARY}, application/json"
        if auth and "token" in auth:
            self._headers["Authorization"] = f"Bearer {auth['token']}"
        elif auth:
            self._headers["Authorization"] = "Basic " + b64encode(f"{auth['login']}:{auth['password']}".encode()).decode()
        self.store = type("Remote", (), {"namespace": "tsh"})()

    def _call(self, verb: str, route: str, missing: Any = None, **args: Any) -> Any:
        args = {k: v.isoformat() if isinstance(v, datetime) else v for k, v in args.items() if v is not None}
        url, body = f"{self.uri}/{route}", None
        if verb == "GET":
            flat = {k: str(int(v)) if isinstance(v, bool) else json.dumps(v) if isinstance(v, (dict, list)) else v for k, v in args.items()}
            url += "?" + urlencode(flat)
        else:
            body = json.dumps(args).encode()
        try:
            with urlopen(Request(url, body, self._headers, method=verb), timeout=600) as r:
                if r.status == 204:
                    return None
                return r.read() if r.headers.get("Content-Type") == BINARY else json.loads(r.read())
        except HTTPError as e:
            text = json.loads(e.read())
            if e.code == 404 and text != "no such route":
                return missing
            raise ValueError(text) from None

    def exists(self, name: str) -> bool:
        """As TimeSeries.exists."""
        return self._call("GET", "series/metadata", name=name, type="exists")

    def source(self, name: str) -> str | None:
        """As TimeSeries.source."""
        return self._call("GET", "series/source", name=name)

    def type(self, name: str) -> str:
        """As TimeSeries.type."""
        return self._call("GET", "series/metadata", name=name, type="type")

    def tzaware(self, name: str) -> bool | None:
        """As TimeSeries.tzaware."""
        return self._call("GET", "series/metadata", name=name, type="tzaware")

    def _write(self, name: str, series: pd.Series, replace: bool, author: str, metadata: dict | None, insertion_date: datetime | None) -> pd.Series | None:
        out = self._call("PATCH", "series/state", name=name, series=pack(series), replace=replace, author=author, metadata=metadata, insertion_date=insertion_date)
        return None if out is None else unpack(out, name)

    def update(self, name: str, series: pd.Series, author: str, metadata: dict | None = None, insertion_date: datetime | None = None) -> pd.Series | None:
        """As TimeSeries.update."""
        return self._write(name, series, False, author, metadata, insertion_date)

    def replace(self, name: str, series: pd.Series, author: str, metadata: dict | None = None, insertion_date: datetime | None = None) -> pd.Series | None:
        """As TimeSeries.replace."""
        return self._write(name, series, True, author, metadata, insertion_date)

    def get(self, name: str, revision_date: datetime | None = None, from_value_date: datetime | None = None, to_value_date: datetime | None = None, _keep_nans: bool = False) -> pd.Series | None:
        """As TimeSeries.get."""
        out = self._call("GET", "series/state", name=name, revision_date=revision_date, from_value_date=from_value_date, to_value_date=to_value_date, _keep_nans=_keep_nans)
        return None if out is None else wire.unpack_series(out)[1].rename(name) if isinstance(out, bytes) else unpack(out, name)

    def history(self, name: str, from_insertion_date: datetime | None = None, to_insertion_date: datetime | None = None, from_value_date: datetime | None = None, to_value_date: datetime | None = None, diffmode: bool = False, _keep_nans: bool = False) -> dict[pd.Timestamp, pd.Series] | None:
        """As TimeSeries.history."""
        out = self._call("GET", "series/history", name=name, from_insertion_date=from_insertion_date, to_insertion_date=to_insertion_date, from_value_date=from_value_date, to_value_date=to_value_date, diffmode=diffmode, _keep_nans=_keep_nans)
        if isinstance(out, bytes):
            return wire.unpack_history(out)[1]
        return None if out is None else {pd.Timestamp(k): unpack(v, name) for k, v in out.items()}

    def staircase(self, name: str, delta: timedelta, from_value_date: datetime | None = None, to_value_date: datetime | None = None) -> pd.Series | None:
        """As TimeSeries.staircase."""
        out = self._call("GET", "series/staircase", name=name, delta=delta.total_seconds(), from_value_date=from_value_date, to_value_date=to_value_date)
        return None if out is None else unpack(out, name)

    def block_staircase(self, name: str, from_value_date: datetime | None = None, to_value_date: datetime | None = None, revision_freq: dict | None = None, revision_time: dict | None = None, revision_tz: str = "UTC", maturity_offset: dict | None = None, maturity_time: dict | None = None) -> pd.Series | None:
        """As TimeSeries.block_staircase."""
        out = self._call("GET", "series/block_staircase", name=name, from_value_date=from_value_date, to_value_date=to_value_date, revision_freq=revision_freq, revision_time=revision_time, revision_tz=revision_tz, maturity_offset=maturity_offset, maturity_time=maturity_time)
        return None if out is None else unpack(out, name).tz_convert(revision_tz) if out["tz"] else unpack(out, name)

    def insertion_dates(self, name: str, from_insertion_date: datetime | None = None, to_insertion_date: datetime | None = None, from_value_date: datetime | None = None, to_value_date: datetime | None = None) -> list[pd.Timestamp]:
        """As TimeSeries.insertion_dates."""
        return [pd.Timestamp(x) for x in self._call("GET", "series/insertion_dates", [], name=name, from_insertion_date=from_insertion_date, to_insertion_date=to_insertion_date, from_value_date=from_value_date, to_value_date=to_value_date)]

    def interval(self, name: str) -> pd.Interval:
        """As TimeSeries.interval."""
        out = self._call("GET", "series/metadata", name=name, type="interval")
        if out is None:
            raise ValueError(f"no series {name!r}")
        return pd.Interval(*map(pd.Timestamp, out), closed="both")

    def log(self, name: str, limit: int | None = None, fromdate: datetime | None = None, todate: datetime | None = None, authors: list[str] | None = None) -> list[dict[str, Any]]:
        """As TimeSeries.log."""
        return [{**r, "date": pd.Timestamp(r["date"])} for r in self._call("GET", "series/log", [], name=name, limit=limit, fromdate=fromdate, todate=todate, authors=authors)]

    def first_insertion_date(self, name: str) -> pd.Timestamp | None:
        """As TimeSeries.first_insertion_date."""
        return min(self.insertion_dates(name), default=None)

    def latest_insertion_date(self, name: str) -> pd.Timestamp | None:
        """As TimeSeries.latest_insertion_date."""
        return max(self.insertion_dates(name), default=None)

    def last_id(self, name: str) -> int | None:
        """As TimeSeries.last_id."""
        rows = self.log(name, 1)
        return rows[-1]["rev"] if rows else None

    def changeset_at(self, name: str, moment: datetime, mode: str = "strict") -> int | None:
        """As TimeSeries.changeset_at."""
        if mode not in ("strict", "before", "after"):
            raise ValueError(f"unknown mode {mode!r}")
        moment = pd.Timestamp(moment)
        moment = moment.tz_localize("UTC") if moment.tz is None else moment
        rows = self.log(name, fromdate=None if mode == "before" else moment, todate=None if mode == "after" else moment)
        return rows[0]["rev"] if rows else None

    def rename(self, old: str, new: str) -> None:
        """As TimeSeries.rename."""
        self._call("PUT", "series/state", name=old, newname=new)

    def delete(self, name: str) -> None:
        """As TimeSeries.delete."""
        self._call("DELETE", "series/state", name=name)

    def strip(self, name: str, insertion_date: datetime) -> None:
        """As TimeSeries.strip."""
        self._call("PUT", "series/strip", name=name, insertion_date=insertion_date)

    def metadata(self, name: str) -> dict[str, Any] | None:
        """As TimeSeries.metadata."""
        return self._call("GET", "series/metadata", name=name)

    def internal_metadata(self, name: str) -> dict[str, Any] | None:
        """As TimeSeries.internal_metadata."""
        return self._call("GET", "series/metadata", name=name, type="internal")

    def replace_metadata(self, name: str, metadata: dict[str, Any]) -> None:
        """As TimeSeries.replace_metadata."""
        self._call("PUT", "series/metadata", name=name, metadata=metadata)

    def update_metadata(self, name: str, metadata: dict[str, Any]) -> None:
        """As TimeSeries.update_metadata."""
        self._call("PATCH", "series/metadata", name=name, metadata=metadata)

    def catalog(self, allsources: bool = True) -> dict[tuple[str, str], list[tuple[str, str]]]:
        """As TimeSeries.catalog."""
        return {(a, b): [tuple(x) for x in v] for a, b, v in self._call("GET", "series/catalog", allsources=allsources)}

    def find(self, query: str, limit: int | None = None, meta: bool = False) -> list[Descriptor]:
        """As TimeSeries.find."""
        return [Descriptor(*x) for x in self._call("GET", "series/find", query=query, limit=limit, meta=meta)]

    def _find(self, source: str, tree: Any, limit: int | None, meta: bool) -> list[Descriptor]:
        from ..operators import search as S

        mine = S.for_source(source, tree)
        if mine is None:
            return []
        found = self.find(mine.expr(), limit, meta)
        return [Descriptor(x, x.imeta, x.meta, source, x.kind) for x in found if x.source == "local"]

    def register_basket(self, name: str, query: str) -> None:
        """As TimeSeries.register_basket."""
        self._call("PUT", "series/basket", name=name, query=query)

    def basket(self, name: str) -> list[Descriptor]:
        """As TimeSeries.basket."""
        return [Descriptor(*x) for x in self._call("GET", "series/basket", name=name)]

    def basket_definition(self, name: str) -> str | None:
        """As TimeSeries.basket_definition."""
        return self._call("GET", "series/basket-definition", name=name)

    def list_baskets(self) -> list[str]:
        """As TimeSeries.list_baskets."""
        return self._call("GET", "series/baskets")

    def delete_basket(self, name: str) -> None:
        """As TimeSeries.delete_basket."""
        self._call("DELETE", "series/basket", name=name)

    def group_exists(self, name: str) -> bool:
        """As TimeSeries.group_exists."""
        return self._call("GET", "group/metadata", name=name) is not None

    def group_type(self, name: str) -> str:
        """As TimeSeries.group_type."""
        return self._call("GET", "group/metadata", name=name, type="type")

    def group_replace(self, name: str, frame: pd.DataFrame, author: str, insertion_date: datetime | None = None) -> None:
        """As TimeSeries.group_replace."""
        self._call("PATCH", "group/state", name=name, frame=_frame(frame), author=author, insertion_date=insertion_date)

    def group_get(self, name: str, revision_date: datetime | None = None, from_value_date: datetime | None = None, to_value_date: datetime | None = None) -> pd.DataFrame | None:
        """As TimeSeries.group_get."""
        out = self._call("GET", "group/state", name=name, revision_date=revision_date, from_value_date=from_value_date, to_value_date=to_value_date)
        if isinstance(out, bytes):
            return wire.unpack_group(out)
        return None if out is None else pd.DataFrame({c: unpack(s) for c, s in out.items()})

    def group_insertion_dates(self, name: str, from_insertion_date: datetime | None = None, to_insertion_date: datetime | None = None) -> list[pd.Timestamp]:
        """As TimeSeries.group_insertion_dates."""
        return [pd.Timestamp(x) for x in self._call("GET", "group/insertion_dates", [], name=name, from_insertion_date=from_insertion_date, to_insertion_date=to_insertion_date)]

    def group_history(self, name: str, from_insertion_date: datetime | None = None, to_insertion_date: datetime | None = None, from_value_date: datetime | None = None, to_value_date: datetime | None = None) -> dict[pd.Timestamp, pd.DataFrame] | None:
        """As TimeSeries.group_history."""
        out = self._call("GET", "group/history", name=name, from_insertion_date=from_insertion_date, to_insertion_date=to_insertion_date, from_value_date=from_value_date, to_value_date=to_value_date)
        if isinstance(out, bytes):
            return wire.unpack_group_history(out)
        return None if out is None else {pd.Timestamp(k): pd.DataFrame({c: unpack(s) for c, s in v.items()}) for k, v in out.items()}

    def group_rename(self, old: str, new: str) -> None:
        """As TimeSeries.group_rename."""
        self._call("PUT", "group/state", name=old, newname=new)

    def group_delete(self, name: str) -> None:
        """As TimeSeries.group_delete."""
        self._call("DELETE", "group/state", name=name)

    def group_metadata(self, name: str) -> dict[str, Any] | None:
        """As TimeSeries.group_metadata."""
        return self._call("GET", "group/metadata", name=name)

    def group_internal_metadata(self, name: str) -> dict[str, Any] | None:
        """As TimeSeries.group_internal_metadata."""
        return self._call("GET", "group/metadata", name=name, type="internal")

    def update_group_metadata(self, name: str, metadata: dict[str, Any]) -> None:
        """As TimeSeries.update_group_metadata."""
        self._call("PUT", "group/metadata", name=name, metadata=metadata)

    def group_catalog(self) -> dict[tuple[str, str], list[tuple[str, str]]]:
        """As TimeSeries.group_catalog."""
        return {(a, b): [tuple(x) for x in v] for a, b, v in self._call("GET", "group/catalog")}


def open_store(spark: Any, uri: str, namespace: str = "tsh", secondaries: dict[str, Any] | None = None, auth: dict[str, str] | None = None) -> TimeSeries | Client:
    """A client for an http address, else a store in a folder."""
    if uri.startswith(("http://", "https://")):
        return Client(uri, auth)
    return TimeSeries(spark, uri, namespace, secondaries)
