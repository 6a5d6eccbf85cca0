"""The search language: s-expressions to a tree, and the tree to a Column over the registry.

    (by.and (by.tzaware) (by.or (by.name "power fr") (by.metaitem "unit" "MWh")) (by.not (< "rank" 3)))

Nesting is honoured. A registry row has name, tzaware, metadata (a JSON object as text) and source.
"""

from __future__ import annotations

import functools
import json
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r'\s*(?:([()])|("(?:[^"\\]|\\.)*")|([^\s()"]+))')
COMPARE = ("<", "<=", ">", ">=", "=")
Value = str | int | float | bool | None


@dataclass(frozen=True)
class Query:
    """A node: its operator and its children or arguments."""

    op: str
    args: tuple["Query | Value", ...] = ()

    def expr(self) -> str:
        """The expression of the tree; parse() reads it back."""
        return f"({' '.join([self.op, *(a.expr() if isinstance(a, Query) else _literal(a) for a in self.args)])})"


def _literal(v: Value) -> str:
    if v is None:
        return "nil"
    if isinstance(v, bool):
        return "#t" if v else "#f"
    return json.dumps(v, ensure_ascii=False)


def _atom(token: str) -> Value:
    if token in ("#t", "#f"):
        return token == "#t"
    if token == "nil":
        return None
    for kind in (int, float):
        try:
            return kind(token)
        except ValueError:
            pass
    raise SyntaxError(f"unknown word {token!r}")


_ARGS = {"by.everything": (), "by.tzaware": (), "by.name": (str,), "by.metakey": (str,), "by.source": (str,), "by.metaitem": (str, object), **{c: (str, (int, float, str)) for c in COMPARE}}


def parse(text: str) -> Query:
    """The tree of an expression; SyntaxError if it is none."""
    tokens, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SyntaxError(f"can't read {text[at : at + 20]!r}")
        tokens.append(m)
        at = m.end()

    def node(i: int) -> tuple[Query, int]:
        if i + 1 >= len(tokens) or tokens[i][1] != "(" or not tokens[i + 1][3]:
            raise SyntaxError("an expression is (operator ...)")
        op, args, i = tokens[i + 1][3], [], i + 2
        while i < len(tokens) and tokens[i][1] != ")":
            if tokens[i][1]:
                a, i = node(i)
            else:
                a, i = json.loads(tokens[i][2]) if tokens[i][2] else _atom(tokens[i][3]), i + 1
            args.append(a)
        if i == len(tokens):
            raise SyntaxError("a parenthesis is open")
        q = Query(op, tuple(args))
        if op in ("by.and", "by.or", "by.not"):
            if not args or not all(isinstance(a, Query) for a in args) or op == "by.not" and len(args) != 1:
                raise SyntaxError(f"wrong arguments of {op}")
        elif op not in _ARGS:
            raise SyntaxError(f"unknown operator {op!r}")
        elif len(args) != len(_ARGS[op]) or any(isinstance(a, Query) or not isinstance(a, k) for a, k in zip(args, _ARGS[op])):
            raise SyntaxError(f"wrong arguments of {op}")
        return q, i + 1

    q, end = node(0)
    if end != len(tokens):
        raise SyntaxError("text after the expression")
    return q


def for_source(source: str, q: Query) -> Query | None:
    """q as one source is asked: its tests of the source are true or false there, and fold away; None if nothing can match."""
    out = _fold(source, q)
    return (EVERYTHING if out else None) if isinstance(out, bool) else out


def _fold(source: str, q: Query) -> Query | bool:
    if q.op == "by.source":
        return q.args[0] == source
    if q.op == "by.everything":
        return True
    if q.op not in ("by.and", "by.or", "by.not"):
        return q
    kids = [_fold(source, a) for a in q.args]
    if q.op == "by.not":
        return not kids[0] if isinstance(kids[0], bool) else Query(q.op, (kids[0],))
    decides = q.op == "by.or"  # what one of them being so decides
    left = tuple(k for k in kids if not isinstance(k, bool))
    if any(k is decides for k in kids):
        return decides
    if not left:
        return not decides
    return left[0] if len(left) == 1 else Query(q.op, left)


EVERYTHING = Query("by.everything")


def _item(metadata: Column, key: str) -> tuple[Column, Column]:
    """A top-level item of the metadata as a variant, and its kind."""
    path = "$['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']"
    v = F.try_variant_get(F.try_parse_json(metadata), path, "variant")
    return v, F.schema_of_variant(v)


def _is_number(kind: Column) -> Column:
    return kind.rlike("^(BIGINT|DECIMAL|DOUBLE)")


def predicate(q: Query, name: str = "name", tzaware: str = "tzaware", metadata: str = "metadata", source: str = "source") -> Column:
    """The Column of a tree. Missing keys and values of another type don't match."""
    sub = functools.partial(predicate, name=name, tzaware=tzaware, metadata=metadata, source=source)
    if q.op == "by.everything":
        return F.lit(True)
    if q.op == "by.and":
        return functools.reduce(Column.__and__, map(sub, q.args))
    if q.op == "by.or":
        return functools.reduce(Column.__or__, map(sub, q.args))
    if q.op == "by.not":
        return ~sub(q.args[0])
    if q.op == "by.tzaware":
        return F.coalesce(F.col(tzaware), F.lit(False))
    if q.op == "by.name":
        return F.coalesce(F.col(name).like("%" + "%".join(q.args[0].split()) + "%"), F.lit(False))
    if q.op == "by.source":
        return F.coalesce(F.col(source) == q.args[0], F.lit(False))
    if q.op == "by.metakey":
        return F.coalesce(F.array_contains(F.json_object_keys(metadata), q.args[0]), F.lit(False))
    key, want = q.args
    v, kind = _item(F.col(metadata), key)
    if isinstance(want, bool):
        hit = (kind == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == F.lit(want))
    elif want is None:
        hit = kind == "VOID"
    elif isinstance(want, str):
        got = F.try_variant_get(v, "$", "string")
        hit = (kind == "STRING") & _compare(q.op, got, F.lit(want))
    elif isinstance(want, (int, float)):
        got = F.try_variant_get(v, "$", "double")
        hit = _is_number(kind) & _compare(q.op, got, F.lit(float(want)))
    else:
        raise SyntaxError(f"can't compare with {want!r}")
    return F.coalesce(hit, F.lit(False))


def _compare(op: str, a: Column, b: Column) -> Column:
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}.get(op, a == b)
