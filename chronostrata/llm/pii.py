"""Personal data by anchor expansion.

One pass of an Aho-Corasick automaton finds anchors: at-signs, schemes, plus signs, digits, double colons and
cues that name an identifier or a street. At each anchor a deterministic parser expands to both sides and
validates what it finds: e-mail addresses, network and street addresses, telephone, card, bank and other account
numbers; sixteen digits are an account number without a check digit, but for moments of a log. A cue holds up to
the end of its sentence or paragraph: what follows it with a digit is parsed as an identifier of its kind.
Findings don't overlap; the one that begins first wins.

Null and empty texts have no findings. Whole texts are read. Rows without an id are left out of find_pii(),
redact() treats them like others. Repeated rows give repeated findings. Extra columns are ignored (find_pii) or
kept (redact).
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

CUES = ("account", "acct", "iban", "card", "passport", "ssn", "social security", "konto", "compte", "cuenta", "customer no", "policy no", "tax id")
#: What a cue announces, where it isn't an account.
KINDS = {"iban": "iban", "card": "card", "passport": "passport", "ssn": "ssn", "social security": "ssn", "tax id": "tax_id"}
STREETS = (" Street", " Avenue", " Road", " Boulevard", " Lane", " Drive", " Square")
_LOCAL = frozenset("._%+-'")
_PHONE = re.compile(r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}(?!\w)")
_LOCAL_PHONE = re.compile(r"(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)")
_SSN = re.compile(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\w-])")
_V4 = re.compile(r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d)")
_GROUPED = re.compile(r"\d{4}(?:[ -]\d{4}){3}(?![\w-])")
_RUN = re.compile(r"\d+")
_IBAN = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_V6 = re.compile(r"[0-9A-Fa-f:]+(?:\d{1,3}(?:\.\d{1,3}){3})?")
_USERINFO = re.compile(r"[^\s/@<>\[\]\"']+@")
#: Sixteen digits that are a moment of a log, to a hundredth of a second.
_MOMENT = re.compile(r"(?:19|20)\d\d(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])(?:[01]\d|2[0-3])[0-5]\d[0-5]\d\d\d")
_STREET = re.compile(r"\d{1,5}[A-Za-z]?(?: [A-Z][\w'-]*){1,4}$")
_END = re.compile(r"(?<!\b(?i:no))(?<!\b(?i:nr))(?<!\b(?i:num))[.!?]\s+(?=[^\W\d_a-z])|\n\s*\n")
#: Between a cue and a short number that is its identifier.
_BETWEEN = re.compile(r"(?>[\W_]|account|acct|bank|card|client|code|credit|customer|debit|holder|iban|ids|id|is|konto|kunde|numbers|number|nummer|num[eé]ro|n[uú]mero|num|nr|no|of|our|ref|es|her|his|my|the|their|was|your|s)*+", re.IGNORECASE)
#: Groups of letters and digits, each with a digit but for letters before the first.
_IDENTIFIER = re.compile(r"[A-Za-z0-9]{1,34}(?:[ -][A-Za-z]{0,4}\d[A-Za-z0-9]{0,33}){0,12}(?![\w])")
_BANK = re.compile(r"[A-Za-z]{2}\d{2}(?:[ -]?[A-Za-z0-9]{4}){2,7}(?:[ -]?[A-Za-z0-9]{1,3})?(?!\w)")
_DATE = re.compile(r"(?:(?:19|20)\d\d[ -]\d{1,2}[ -]\d{1,2}|\d{1,2}[ -]\d{1,2}[ -](?:19|20)\d\d)(?![\w-])")

_A = ahocorasick.Automaton()
for _cue, _kind in [("@", "@"), ("://", "s"), ("tel:", "t"), ("+", "+"), ("::", ":"), *((str(d), "d") for d in range(10)), *((s.lower(), "r") for s in STREETS), *((c, "c" + KINDS.get(c, "account")) for c in CUES)]:
    _A.add_word(_cue, (_kind, len(_cue)))
_A.make_automaton()

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number is right."""
    odd = [int(c) for c in digits[-1::-2]]
    even = [sum(divmod(2 * int(c), 10)) for c in digits[-2::-2]]
    return (sum(odd) + sum(even)) % 10 == 0


def _mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _email(text: str, at: int) -> Span | None:
    lo = at
    while lo and at - lo <= 64 and (text[lo - 1].isalnum() or text[lo - 1] in _LOCAL):
        lo -= 1
    while lo < at and text[lo] in ".'-%+":
        lo += 1
    hi = at + 1
    while hi < len(text) and hi - at <= 254 and (text[hi].isalnum() or text[hi] in ".-"):
        hi += 1
    if not 0 < at - lo <= 64 or ".." in text[lo:at] or text[at - 1] == ".":
        return None
    labels = []
    for x in text[at + 1 : hi].split("."):
        label = x.rstrip("-")
        if not label or label[0] == "-" or len(label) > 63:
            break
        labels.append(label)
        if label != x:
            break
    # the longest valid domain: what follows it isn't part of the address
    while labels and (not labels[-1].isalpha() or len(labels[-1]) < 2):
        labels.pop()
    if len(labels) < 2:
        return None
    return ("email", lo, at + 1 + len(".".join(labels)))


def _v6(text: str, at: int) -> Span | None:
    lo = at
    while lo and at - lo < 40 and text[lo - 1] in "0123456789abcdefABCDEF:":
        lo -= 1
    m = _V6.match(text, lo)
    if not m or m.end() - lo < 4 or not any(c.isdigit() for c in m.group()) or lo and text[lo - 1].isalnum() or text[m.end() : m.end() + 1].isalnum():
        return None
    try:
        ipaddress.IPv6Address(m.group().rstrip(":") if not m.group().endswith("::") else m.group())
    except ValueError:
        return None
    return ("ip", lo, lo + len(m.group().rstrip(":") if not m.group().endswith("::") else m.group()))


def _number(text: str, at: int) -> Span | None:
    """What begins at the first digit of a run of digits."""
    before = text[at - 1] if at else " "
    if before.isalpha() or before == "_":
        if at >= 2 and text[at - 2 : at].isalpha() and text[at - 2 : at].isupper() and not (at > 2 and text[at - 3].isalnum()):
            m = _IBAN.match(text, at - 2)
            while m and not _mod97(m.group()):
                m = _IBAN.fullmatch(text, at - 2, at - 2 + m.group().rfind(" ")) if " " in m.group() else None
            if m:
                return ("iban", at - 2, m.end())
        return None
    run = _RUN.match(text, at).end()
    after, n = text[run : run + 1], run - at
    if n <= 3 and after == "." and before != ".":
        m = _V4.match(text, at)
        if m and all(int(x) < 256 for x in m.group().split(".")):
            return ("ip", at, m.end())
    if n <= 4 and after == ":":
        v6 = _v6(text, at)
        if v6:
            return v6
    if n == 3:
        m = _SSN.match(text, at)
        if m and before != "-":
            return ("ssn", at, m.end())
        lo = at - 1 if before == "(" else at
        m = _LOCAL_PHONE.match(text, lo)
        if m and before != "-":
            return ("phone", lo, m.end())
    if n == 4 and before not in ".-" and (m := _GROUPED.match(text, at)):
        digits = re.sub("[ -]", "", m.group())
        return ("card" if luhn(digits) else "account", at, m.end())
    if after.isalnum() or after == "_" or before in ".,-" and at > 1 and text[at - 2].isdigit() or after in (".", ",") and text[run + 1 : run + 2].isdigit():
        return None
    if 13 <= n <= 19 and luhn(text[at:run]):
        return ("card", at, run)
    if n == 16 and not _MOMENT.fullmatch(text, at, run):
        return ("account", at, run)
    return None


def _of_kind(kind: str, value: str, close: bool) -> str | None:
    """The kind of an identifier that follows a cue of a kind, if it is one. close: only connecting words lie between them."""
    plain = re.sub("[ -]", "", value)
    n = sum(c.isdigit() for c in plain)
    if kind == "passport" and 6 <= len(plain) <= 10 and n >= (2 if close else 4):
        return kind
    if kind == "ssn" and plain.isdigit() and 9 <= n <= 15:
        return kind
    if kind == "tax_id" and 8 <= len(plain) <= 15 and n >= 7:
        return kind
    if kind == "card" and plain.isdigit() and 13 <= n <= 19 and luhn(plain):
        return kind
    if n >= 6 and len(plain) <= 34 and close or plain.isdigit() and 8 <= n <= 19:
        return "account"
    return None


def _cued(text: str, at: int, least: int, cues: dict[str, int]) -> Span | None:
    """The identifier around a digit, for the cues of its sentence (kind -> end), the nearest first. least: where it may begin."""
    lo, least = at, max(least, at - 34, *cues.values())
    while lo > least and (text[lo - 1].isascii() and text[lo - 1].isalnum() or text[lo - 1] == "-"):
        lo -= 1
    while lo < at and text[lo] == "-":
        lo += 1
    if lo >= 4 and text[lo - 1] == " " and text[lo - 3 : lo - 1].isupper() and not text[lo - 4].isalnum() and lo - 3 >= least:
        starts = (lo - 3, lo)  # two letters that stand before the digits
    else:
        starts = (lo,)
    for kind, end in reversed(cues.items()):
        for lo in starts:
            before = text[lo - 1] if lo else " "
            if before in "$€£¥" or before in ".,/" and lo > 1 and text[lo - 2].isdigit() or before.isalnum() and lo not in cues.values() or _DATE.match(text, lo):
                continue
            close = _BETWEEN.fullmatch(text, end, lo) is not None if lo - end <= 64 else False
            if kind == "iban" and (m := _BANK.match(text, lo)):
                hi = m.end()
                while hi > lo + 14 and not _mod97(re.sub("[ -]", "", text[lo:hi]).upper()):
                    hi = max(text.rfind(" ", lo, hi), text.rfind("-", lo, hi))
                if hi > lo + 14:
                    return ("iban", lo, hi)
            if lo < starts[-1]:
                m = re.compile(r"[A-Z]{2} \d[A-Za-z0-9]{0,33}(?:[ -]\d[A-Za-z0-9]{0,33}){0,12}(?!\w)").match(text, lo)
            else:
                m = _IDENTIFIER.match(text, lo)
            hi = m.end() if m else lo
            while hi > at:
                if not (text[hi : hi + 1] in (".", ",", "/") and text[hi + 1 : hi + 2].isdigit() or text[hi : hi + 1] == "%"):
                    found = _of_kind(kind, text[lo:hi], close)
                    if found:
                        return (found, lo, hi)
                hi = max(text.rfind(" ", lo, hi), text.rfind("-", lo, hi))
    return None


def lowered(text: str) -> str:
    """The text in lower case, character by character where that would change its length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def spans(text: str | None) -> list[Span]:
    """(kind, start, end) of the findings in a text, in order."""
    out: list[Span] = []
    if not text:
        return out
    done = skip = seen = 0
    host = -1
    cues: dict[str, int] = {}
    for end, (kind, n) in _A.iter(lowered(text)):
        at = end - n + 1
        if kind[0] == "c":
            if not (at and text[at - 1].isalpha()):
                if cues and _END.search(text, seen, at):
                    cues.clear()
                cues.pop(kind[1:], None)
                cues[kind[1:]], seen = end + 1, end + 1
            continue
        if at < done or at < skip or kind in "rt" and not text.startswith(STREETS if kind == "r" else "tel:", at):
            continue
        found: Span | None = None
        if kind == "d":
            found = _number(text, at)
            if cues and at > seen:
                if _END.search(text, seen, at):
                    cues.clear()
                seen = at
            if cues and (not found or found[0] == "account"):
                cued = _cued(text, at, done, cues)
                found = cued if cued and (not found or cued[2] >= found[2]) else found
            if not found:
                skip = _RUN.match(text, at).end()
        elif kind == "@":
            # what stands before the host of an URL isn't an address
            found = _email(text, at) if at != host else None
        elif kind == "+":
            m = _PHONE.match(text, at)
            if m and 8 <= sum(c.isdigit() for c in m.group()) <= 15 and not (at and text[at - 1].isalnum()):
                found = ("phone", at, m.end())
        elif kind == "s":
            m = _USERINFO.match(text, end + 1)
            # a short name alone is that of an address
            if m and (m.end() - end - 2 >= 8 or ":" in m.group()):
                found = ("credentials", end + 1, m.end() - 1)
                host = m.end() - 1
        elif kind == "t":
            m = re.compile(r"[+\d][\d().-]{6,19}").match(text, end + 1)
            if m:
                found = ("phone", end + 1, m.end())
        elif kind == ":":
            found = _v6(text, at)
        elif kind == "r":
            lo = max(done, at - 80)
            m = _STREET.search(text[lo:at])
            if m and not text[end + 1 : end + 2].isalnum() and not (m.start() and text[lo + m.start() - 1].isalnum()):
                found = ("street", lo + m.start(), end + 1)
        if found and found[1] >= done:
            out.append(found)
            done = found[2]
        elif found and found[0] == "email":  # its local part holds an earlier finding: both are one
            while out and out[-1][2] > found[1]:
                found = (found[0], min(found[1], out.pop()[1]), found[2])
            out.append(found)
            done = found[2]
    return out


def replaced(text: str, found: list[Span]) -> str:
    """The text with each finding replaced by its kind in brackets."""
    out, at = [], 0
    for kind, lo, hi in found:
        out += [text[at:lo], "[", kind.upper(), "]"]
        at = hi
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_found, spans of kind, start and end, redacted) for each document with findings.

    Places count characters from 0; the found values themselves aren't in the result.
    """
    base = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, F.col(text_col).cast("string").alias("text" if id_col != "text" else "t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in slices(batches, 1):
            texts = batch.column(1).to_pylist()
            found = [(i, t, s) for i, t in enumerate(texts) if (s := spans(t))]
            if found:
                spots = pa.array([[dict(zip(("kind", "start", "end"), x)) for x in s] for _, _, s in found], kinds)
                arrays = [batch.column(0).take(pa.array([i for i, _, _ in found])), pa.array([len(s) for _, _, s in found], pa.int32()), spots, pa.array([replaced(t, s) for _, t, s in found], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, [id_col, *names])

    names = [x if x != id_col.lower() else x + "_" for x in ("n_found", "spans", "redacted")]
    schema = docs.select(id_col).schema
    for name, kind in zip(names, ("int", "array<struct<kind:string,start:int,end:int>>", "string")):
        schema = schema.add(name, T._parse_datatype_string(kind))
    return base.mapInArrow(run, schema)


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs, every row and column, with findings replaced in the text; a length column of whole numbers follows the changed texts, another is kept."""
    at = docs.columns.index(text_col)
    size = docs.columns.index(length_col) if length_col in docs.columns and isinstance(docs.schema[length_col].dataType, T.IntegralType) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            texts, changed = batch.column(at).to_pylist(), {}
            for i, t in enumerate(texts):
                if found := spans(t):
                    changed[i] = texts[i] = replaced(t, found)
            if changed:
                columns = list(batch.columns)
                columns[at] = pa.array(texts, batch.schema.field(at).type)
                if size is not None:
                    mask = pa.array([i in changed for i in range(len(texts))])
                    columns[size] = pc.replace_with_mask(columns[size], mask, pa.array([len(x) for x in changed.values()], columns[size].type))
                batch = pa.RecordBatch.from_arrays(columns, batch.schema.names)
            yield batch

    return docs.mapInArrow(run, docs.schema)
