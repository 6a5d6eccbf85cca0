"""SentencePiece (merge type) encoding by a prefix table, and decoding.

The last token of the encoding of a prefix is unique. Token t, a match that ends a prefix, is that token
if and only if it may follow the last token of the prefix before it, which a pair test decides by undoing
both tokens' merges in order of rank. One pass over the matches of an Aho-Corasick automaton of all
pieces fills the table; the ids are then read off backwards.

Merges don't cross the start of a word (no piece has a word mark after another character; this is
checked), nor places between two characters that are neighbours in no piece, so that the table is made for
each part of a word once and remembered. Marks that are left alone in runs
of white space merge last, among themselves, by their own table.

The ids are those of the sentencepiece library for the model. Decoding gives back the text, but for the
word mark (U+2581), which is a space to this kind of model. Null texts have null ids; the empty text has
none. Nothing is cut, however long. Other columns are ignored (encode) or kept (with_ids).
"""

from __future__ import annotations

import heapq
import re
import struct
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, trim

#: The model; its path is a parameter of every function.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Parts of words whose ids a worker remembers (more only if a slice of texts has more), and characters up to which many are encoded together.
KEPT, LONGEST = 120_000, 48
#: Characters of the automaton for many parts; pairs that are remembered.
DENSE, PAIRS = 191, 1 << 20
#: Characters that may be split off words, if the model allows it.
OFTEN = "\n\t.,;:!?|*#$%&\"()[]{}<>=+~^/\\"


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes | float]]:
    """Number and value of each field of a protocol buffer."""

    def varint(i: int) -> tuple[int, int]:
        v = s = 0
        while True:
            v |= (b[i] & 127) << s
            s, i = s + 7, i + 1
            if b[i - 1] < 128:
                return v, i

    i = 0
    while i < len(b):
        key, i = varint(i)
        if key & 7 == 0:
            v, i = varint(i)
        elif key & 7 == 2:
            n, i = varint(i)
            v, i = b[i : i + n], i + n
        elif key & 7 == 5:
            v, i = struct.unpack("<f", b[i : i + 4])[0], i + 4
        else:
            v, i = b[i : i + 8], i + 8
        yield key >> 3, v


class Codec:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str = MODEL) -> None:
        with open(path, "rb") as f:
            model = list(_fields(f.read()))
        normal = {k: v for f, v in model if f == 3 for k, v in _fields(v)}
        train = {k: v for f, v in model if f == 2 for k, v in _fields(v)}
        if normal.get(2) or not normal.get(3, 1) or normal.get(4, 1) or not normal.get(5, 1) or train.get(3, 1) != 2:
            raise ValueError("only merge models that don't change texts but for the word mark at their start")
        self.pieces: list[str] = []
        score, kind = [], []
        for f, v in model:
            if f == 1:
                p = dict(_fields(v))
                self.pieces.append(p.get(1, b"").decode())
                score.append(p.get(2, 0.0))
                kind.append(p.get(3, 1))
        if any(k in (4, 5) for k in kind) or any(MARK in p[1:] and p.strip(MARK) for p, k in zip(self.pieces, kind) if k == 1):
            raise ValueError("the model has pieces that cross the start of a word, or its own symbols")
        self.byte = [0] * 256
        self.raw = [p.replace(MARK, " ").encode() for p in self.pieces]
        for i, k in enumerate(kind):
            if k == 6:
                self.byte[int(self.pieces[i][3:5], 16)] = i
                self.raw[i] = bytes([int(self.pieces[i][3:5], 16)])
            elif k in (2, 3):
                self.raw[i] = b"" if k == 3 else " ⁇ ".encode()
        self.id = {p: i for i, (p, k) in enumerate(zip(self.pieces, kind)) if k == 1}
        self.score = dict(zip(self.id, (score[i] for i in self.id.values())))
        self.mark = self.id[MARK]
        # words' tokens by rank of their merge; characters come before all merges
        words = [p for p in self.id if len(p) == 1 or p.strip(MARK)]
        words.sort(key=lambda p: (len(p) > 1, -self.score[p] if len(p) > 1 else 0, p))
        rank = {p: r for r, p in enumerate(words)}
        if len({self.score[p] for p in words if len(p) > 1}) != sum(len(p) > 1 for p in words):
            raise ValueError("two pieces have the same score")
        self.rank_id = [self.id[p] for p in words]
        self.length = [len(p) for p in words]
        self.left, self.right = list(range(len(words))), list(range(len(words)))
        self.join: dict[tuple[int, int], int] = {}
        self.automaton = ahocorasick.Automaton()
        for r, p in enumerate(words):
            parts = self._merge(p, r, rank)
            if len(parts) == 2:
                self.left[r], self.right[r] = parts
            for k in range(1, len(p)):
                if (a := rank.get(p[:k])) is not None and (b := rank.get(p[k:])) is not None:
                    self.join[a, b] = r
            if len(parts) <= 2:  # else merges never reach the piece
                self.automaton.add_word(p, r)
        self.automaton.make_automaton()
        self.ok: dict[tuple[int, int], bool] = {}
        self.parts: dict[str, bytes] = {}
        self.runs: dict[int, bytes] = {}
        letter = re.compile(r"[^\W\d_]")
        near = {x for p in words for a, b in zip(p, p[1:]) for x, y in ((a, b), (b, a)) if letter.match(y)}
        off = re.escape("".join(x for x in OFTEN if x not in near))
        some = r"(?:[^\W\d_]++" + (f"|[{off}]++" if off else "") + ")?+"
        self.split = re.compile(rf"{MARK}?+{some}(?:(?:(?![{off}{MARK}])[\W\d_])++{some})*+").findall
        self._automaton(words)

    def _automaton(self, words: list[str]) -> None:
        """The automaton of the pieces that consist of the DENSE most frequent characters, as arrays, for many parts at a time."""
        often = Counter(x for p in words for x in set(p)).most_common(DENSE)
        self.symbol = np.zeros(0x110000, np.uint8)
        for k, (x, _) in enumerate(often):
            self.symbol[ord(x)] = k + 1
        width = DENSE + 1
        children: list[dict[int, int]] = [{}]
        token = [-1]
        for p, r in ((p, r) for r, p in enumerate(words) if p in self.automaton):
            path = self.symbol[[ord(x) for x in p]].tolist()
            if 0 in path:
                continue
            node = 0
            for x in path:
                if x not in children[node]:
                    children[node][x] = len(children)
                    children.append({})
                    token.append(-1)
                node = children[node][x]
            token[node] = r
        n = len(children)
        self.delta = np.zeros((n, width), np.int32)
        self.found = np.full(n, -1, np.int32)  # the longest piece that ends in a state, else the one that its suffix link leads to
        self.next = np.full(n, -1, np.int32)  # state of the next shorter piece
        fail, level = [0] * n, [0]
        hit = [-1] * n  # the nearest state on the suffix path, itself included, that is a piece
        while level:
            below = []
            for node in level:
                f = fail[node]
                if node:
                    self.delta[node] = self.delta[f]
                    hit[node] = node if token[node] >= 0 else hit[f]
                    self.next[node] = hit[f]
                for x, child in children[node].items():
                    fail[child] = int(self.delta[f, x]) if node else 0
                    below.append(child)
                for x, child in children[node].items():
                    self.delta[node, x] = child
            level = below
        self.found = np.array(hit, np.int32)
        self.token = np.array(token, np.int32)
        self.delta = self.delta.reshape(-1)
        self.size = np.array(self.length, np.int32)
        self.ids = np.array(self.rank_id, np.int32)
        self.seen = np.full(PAIRS, -1, np.int64)
        self.fit = np.zeros(PAIRS, bool)

    def _all_fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """_fits() of many pairs; a table of fixed size remembers pairs, later ones in the place of earlier ones."""
        key = a.astype(np.int64) << 20 | b
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIRS.bit_length() + 1)).astype(np.int64)
        out = self.fit[slot]
        new = np.flatnonzero(self.seen[slot] != key)
        if len(new):
            keys, back = np.unique(key[new], return_inverse=True)
            ok = np.array([self._fits(k >> 20, k & 0xFFFFF) for k in keys.tolist()], bool)
            out[new] = ok[back]
            self.fit[slot[new]], self.seen[slot[new]] = ok[back], key[new]
        return out

    def tables(self, parts: list[str]) -> list[bytes]:
        """table() of many parts of the DENSE characters, as 32-bit integers: all prefix tables grow together."""
        n = np.array([len(p) for p in parts])
        order = np.argsort(-n, kind="stable")
        n = n[order]
        text = self.symbol[np.frombuffer("".join([parts[i] for i in order.tolist()]).encode("utf-32-le"), np.uint32)]
        start = np.cumsum(n) - n
        most = int(n[0])
        last = np.full((len(parts), most + 1), -1, np.int32)
        state = np.zeros(len(parts), np.int32)
        alive = np.searchsorted(-n, -np.arange(most), "left")  # parts longer than k
        for k in range(most):
            live = int(alive[k])
            state = self.delta[state[:live] * np.int32(DENSE + 1) + text[start[:live] + k]]
            row = np.arange(live)
            at = self.found[state]
            while len(row):
                r = self.token[at]
                lo = k + 1 - self.size[r]
                before = last[row, lo]
                ok = before < 0
                test = np.flatnonzero(~ok)
                ok[test] = self._all_fit(before[test], r[test])
                last[row[ok], k + 1] = r[ok]
                row, at = row[~ok], self.next[at[~ok]]
        got, pos, row, count = [], n.copy(), np.arange(len(parts)), np.zeros(len(parts), np.int64)
        while len(row):
            r = last[row, pos[row]]
            got.append((row, r))
            count[row] += 1
            pos[row] -= self.size[r]
            row = row[pos[row] > 0]
        ends = np.cumsum(count)
        flat = np.zeros(int(ends[-1]), np.int32)
        for k, (row, r) in enumerate(got):
            flat[ends[row] - 1 - k] = self.ids[r]
        raw, out = flat.tobytes(), [b""] * len(parts)
        for i, lo, hi in zip(order.tolist(), ((ends - count) * 4).tolist(), (ends * 4).tolist()):
            out[i] = raw[lo:hi]
        return out

    def _merge(self, p: str, r: int, rank: dict[str, int]) -> list[int]:
        """The tokens that p has when merges of a lower rank than r are done."""
        t = list(p)
        while len(t) > 1:
            best = min(((rank.get(a + b, r), i) for i, (a, b) in enumerate(zip(t, t[1:]))), default=(r, 0))
            if best[0] >= r:
                break
            t[best[1] : best[1] + 2] = [t[best[1]] + t[best[1] + 1]]
        return [rank[x] for x in t] if all(x in rank for x in t) else [0, 0, 0]

    def _fits(self, a: int, b: int) -> bool:
        """Whether the encoding of the two tokens' text is just these tokens."""
        key, limit = (a, b), len(self.length)
        while True:
            joined = self.join.get((a, b))
            if joined is not None and joined < limit:
                ok = False
                break
            if a > b:
                limit = a
                a = self.right[a]
                if a == limit:
                    limit = b + 1
                    b = self.left[b]
                    if b + 1 == limit:
                        ok = True
                        break
            else:
                limit = b + 1
                b = self.left[b]
                if b + 1 == limit:
                    limit = a
                    a = self.right[a]
                    if a == limit:
                        ok = True
                        break
        if len(self.ok) > 50_000:
            self.ok.clear()
        self.ok[key] = ok
        return ok

    def table(self, text: str) -> list[int]:
        """Ids of a text that has a word mark at its start at most."""
        n = len(text)
        last = [-1] * (n + 1)  # rank of the last token of each prefix; -1: a character that is no piece
        ok, length, done = self.ok, self.length, 0
        for end, r in self.automaton.iter(text):
            end += 1
            if end == done:
                continue
            at = end - length[r]
            before = last[at] if at else -1
            if before < 0 or (ok[before, r] if (before, r) in ok else self._fits(before, r)):
                last[end] = r
                done = end
        out, ids, byte = n, [], self.byte
        while out:
            r = last[out]
            if r < 0:
                out -= 1
                ids.extend(byte[x] for x in reversed(text[out].encode("utf-8", "surrogatepass")))
            else:
                ids.append(self.rank_id[r])
                out -= length[r]
        ids.reverse()
        return ids

    def _run(self, n: int) -> bytes:
        """Ids of n marks in a row that no word has taken."""
        if n not in self.runs:
            size = [1] * n
            prev, after = list(range(-1, n - 1)), [*range(1, n), -1]
            heap: list[tuple[float, int, int]] = []

            def offer(a: int) -> None:
                if a >= 0 and after[a] >= 0 and (s := self.score.get(MARK * (size[a] + size[after[a]]))) is not None:
                    heapq.heappush(heap, (-s, a, size[a] + size[after[a]]))

            for i in range(n):
                offer(i)
            while heap:
                _, a, k = heapq.heappop(heap)
                if not size[a] or after[a] < 0 or size[a] + size[after[a]] != k:
                    continue
                b = after[a]
                size[a], size[b], after[a] = k, 0, after[b]
                if after[b] >= 0:
                    prev[after[b]] = a
                offer(prev[a])
                offer(a)
            if len(self.runs) > 4096:
                self.runs.clear()
            self.runs[n] = np.array([self.id[MARK * k] for k in size if k], np.int32).tobytes()
        return self.runs[n]

    def learn(self, parts: set[str]) -> None:
        """Remembers the ids of parts of words."""
        if len(self.parts) + len(parts) > KEPT:
            self.parts.clear()
        dense, rest = [], []
        for p in parts:
            (dense if len(p) <= LONGEST else rest).append(p)
        if dense:
            odd = np.add.reduceat(self.symbol[np.frombuffer("".join(dense).encode("utf-32-le", "surrogatepass"), np.uint32)] == 0, np.cumsum([0, *map(len, dense[:-1])]))
            rest += [p for p, x in zip(dense, odd.tolist()) if x]
            dense = [p for p, x in zip(dense, odd.tolist()) if not x]
        if dense:
            self.parts.update(zip(dense, self.tables(dense)))
        for p in rest:
            self.parts[p] = np.array(self.table(p), np.int32).tobytes()

    def forget(self) -> None:
        """Forgets the ids of parts of words: a worker outlives its task, and other stages need the memory."""
        self.parts.clear()
        trim()

    def encode_all(self, texts: list[str | None]) -> list[bytes | None]:
        """The ids of each text as 32-bit integers; null for null."""
        split = [None if t is None else self.split(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        known = self.parts
        new = {p for parts in split if parts for p in parts if p not in known}
        if len(known) + len(new) > KEPT:
            new = {p for parts in split if parts for p in parts}
        self.learn(new)
        return [None if parts is None else self._joined(parts) for parts in split]

    def _joined(self, parts: list[str]) -> bytes:
        if parts and not parts[-1]:  # the pattern matches once more at the end
            parts.pop()
        got = [*map(self.parts.__getitem__, parts)]
        if MARK not in parts:
            return b"".join(got)
        # marks that no word has taken merge in runs, also with one that stays alone at the start of a word
        alone = struct.pack("<i", self.mark)
        out, run = [], 0
        for part, ids in zip(parts, got):
            if part == MARK:
                run += 1
                continue
            if run and part[0] == MARK and ids.startswith(alone):
                run, ids = run + 1, ids[4:]
            if run:
                out.append(self._run(run))
                run = 0
            out.append(ids)
        if run:
            out.append(self._run(run))
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """encode_all() of one text."""
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        raw = b"".join(map(self.raw.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(path: str = MODEL) -> Codec:
    """The codec of a model file, made once in a process."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _ids(c: Codec, texts: list[str | None]) -> pa.Array:
    parts = c.encode_all(texts)
    ends = np.cumsum([0, *(len(p) // 4 if p else 0 for p in parts)]).astype(np.int32)
    flat = pa.array(np.frombuffer(b"".join(p for p in parts if p), np.int32))
    return pa.ListArray.from_arrays(pa.array(ends), flat, mask=pa.array([p is None for p in parts]))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """(id, ids, n_tokens, round_trip) for every row; round_trip: whether the ids decode to the text again."""
    base = docs.select(id_col, F.col(text_col).cast("string").alias(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in slices(batches, 1):
            texts = batch.column(1).to_pylist()
            ids = _ids(c, texts)
            flat, ends = ids.values.to_numpy().tolist(), ids.offsets.to_numpy().tolist()
            same = [None if t is None else c.decode(flat[lo:hi]) == t.replace(MARK, " ") for t, lo, hi in zip(texts, ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pc.list_value_length(ids), pa.array(same, pa.bool_())], [id_col, *names])
        c.forget()

    names = ["ids", "n_tokens", "round_trip"]
    if id_col.lower() in names:
        names = [f"{x}_" if x == id_col.lower() else x for x in names]
    schema = docs.select(id_col).schema
    for name, kind in zip(names, ("array<int>", "int", "boolean")):
        schema = schema.add(name, T._parse_datatype_string(kind))
    return base.mapInArrow(run, schema)


def decode(encoded: DataFrame, ids_col: str = "ids", into: str = "text", model: str = MODEL) -> DataFrame:
    """encoded with its ids replaced by their text; null for null ids, and for ids of which some are null or no pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        n = len(c.pieces)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
            texts = [None if x is None or any(i is None or not 0 <= i < n for i in x) else c.decode(x) for x in ids]
            kept = [(c, batch.column(k)) for k, c in enumerate(batch.schema.names) if c != ids_col]
            yield pa.RecordBatch.from_arrays([a for _, a in kept] + [pa.array(texts, pa.string())], [x for x, _ in kept] + [into])

    rest = encoded.drop(ids_col)
    if into.lower() in (c.lower() for c in rest.columns):
        raise ValueError(f"there is a column {into} already")
    return encoded.mapInArrow(run, rest.schema.add(into, "string"))
