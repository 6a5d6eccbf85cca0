"""Stores, sources and logins by name, from a configuration file.

    [stores]
    main = /shared/store
    far = https://series.example.com/api

    [sources]
    main = far:remote, /other/store

    [auth]
    https://series.example.com/api = joe:password
    https://other.example.com = token:abcdef

A store's sources are its secondaries, in order of precedence: names of stores or addresses, each with the
name it goes by after a colon (else its own). The file is that of the variable CHRONOSTRATA_CONFIG, else
chronostrata.cfg in the working folder, else .config/chronostrata.cfg in the home folder.
"""

from __future__ import annotations

import configparser
import os
import re
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from .api import TimeSeries
from .sources.http import Client, open_store

VARIABLE, FILE = "CHRONOSTRATA_CONFIG", "chronostrata.cfg"


def config_path() -> Path | None:
    """The configuration file; None if there is none."""
    if given := os.environ.get(VARIABLE):
        return Path(given)
    return next((p for p in (Path.cwd() / FILE, Path.home() / ".config" / FILE) if p.exists()), None)


def load(path: Path | None = None) -> configparser.ConfigParser:
    """The configuration; empty without a file."""
    out = configparser.ConfigParser(delimiters=("=",), interpolation=None)
    out.optionxform = str
    if (path := path or config_path()) is not None:
        with open(path, encoding="utf-8") as f:
            out.read_file(f)
    return out


def _get(config: configparser.ConfigParser, section: str, key: str) -> str | None:
    return config.get(section, key, fallback=None)


def _auth(config: configparser.ConfigParser, uri: str) -> dict[str, str] | None:
    """The login of an address, or of the longest beginning of it that has one."""
    known = [k for k in (config["auth"] if config.has_section("auth") else ()) if uri == k or uri.startswith(k.rstrip("/") + "/")]
    if not known:
        return None
    login, _, rest = config["auth"][max(known, key=len)].partition(":")
    return {"token": rest} if login == "token" else {"login": login, "password": rest}


def timeseries(spark: SparkSession, uri: str, namespace: str = "tsh", sources: dict[str, str] | None = None, config: configparser.ConfigParser | None = None) -> TimeSeries | Client:
    """The store of a name or address, with its secondaries; sources: name -> name or address, instead of those of the configuration."""
    config = config or load()
    address = _get(config, "stores", uri) or uri
    if sources is None:
        parts = [x.strip() for x in (_get(config, "sources", uri) or "").split(",") if x.strip()]
        sources = {}
        for x in parts:
            where, name = re.fullmatch(r"(.*?)(?::([^/:]+))?", x).groups()
            sources[name or where] = where
    secondaries: dict[str, Any] = {}
    for name, where in sources.items():
        there = _get(config, "stores", where) or where
        secondaries[name] = open_store(spark, there, namespace, auth=_auth(config, there))
    return open_store(spark, address, namespace, secondaries, _auth(config, address))
