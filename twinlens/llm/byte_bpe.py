"""Byte-level BPE by ranks: a segment tree over byte positions holds the leftmost pair of least rank.

A merge takes the root, joins two live neighbours and updates the three changed leaves, each on a logarithmic path. Short
pieces of one width are merged side by side in numpy, long ones alone. The matches of the pattern are encoded separately;
a piece that is itself a token is that token. Encoded pieces are kept per worker in a bounded table, which changes nothing
but speed.

Results for odd input: null and empty texts have no ids and decode to no bytes; null id lists decode to no bytes; repeated
rows give repeated results; other columns are ignored; texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from twinlens.llm import textarrays as ta

_NONE = np.int64(2**62)
_TOO_HIGH = 2**31 - 1
_LONGEST_SIDE_BY_SIDE = 64
_KEPT_PIECES = 400_000
_OPEN: dict[int, Vocabulary] = {}


class Vocabulary:
    """Token bytes by id, and the rank of every pair of tokens whose bytes together are a token."""

    def __init__(self, rank_file: bytes) -> None:
        self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, rank_file.splitlines()))}
        self.tokens = {i: t for t, i in self.ids.items()}
        self.bytes = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        self.pairs = {}
        for token, rank in self.ids.items():
            for k in range(1, len(token)):
                a, b = self.ids.get(token[:k]), self.ids.get(token[k:])
                if a is not None and b is not None:
                    self.pairs[(a << 32) | b] = rank
        self._index_pairs()
        self.kept: dict[str, bytes] = {}

    def _index_pairs(self) -> None:
        """The pairs as an open-addressing table that numpy can probe."""
        keys, ranks = np.array(list(self.pairs), np.uint64), np.array(list(self.pairs.values()), np.int64)
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.slots, self.ranks = np.full(1 << self.bits, 2**64 - 1, np.uint64), np.full(1 << self.bits, _TOO_HIGH, np.int64)
        at, left, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(left):
            self.probes += 1
            free = self.slots[at[left]] == np.uint64(2**64 - 1)
            self.slots[at[left[free]]] = keys[left[free]]
            lost = self.slots[at[left]] != keys[left]
            won = left[~lost]
            self.ranks[at[won]] = ranks[won]
            left = left[lost]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        at, out = self._slot(keys), np.full(len(keys), _TOO_HIGH, np.int64)
        open_ = np.arange(len(keys))
        for _ in range(self.probes):
            found = self.slots[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (found != np.uint64(2**64 - 1))]
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
        return out

    def merge_side_by_side(self, texts: list[bytes], width: int) -> list[bytes]:
        """Ids, as little-endian 32-bit integers, of pieces of 2 to ``width`` (a power of two) bytes."""
        m = len(texts)
        size = np.fromiter(map(len, texts), np.int64, m)
        raw = np.zeros((m, width), np.uint8)
        inside = np.arange(width) < size[:, None]
        raw[inside] = np.frombuffer(b"".join(texts), np.uint8)
        ids = self.bytes[raw]
        nxt, prv = np.tile(np.arange(1, width + 1), (m, 1)), np.tile(np.arange(-1, width - 1), (m, 1))
        nxt[np.arange(m), size - 1] = width
        live = inside.copy()
        tree = np.full((m, 2 * width), _NONE)
        pair = inside[:, 1:]
        ranks = self.rank(ids[:, :-1][pair], ids[:, 1:][pair])
        leaves = np.full((m, width - 1), _NONE)
        leaves[pair] = np.where(ranks == _TOO_HIGH, _NONE, ranks * width + np.nonzero(pair)[1])
        tree[:, width : 2 * width - 1] = leaves
        level = width // 2
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level //= 2
        row = np.flatnonzero(tree[:, 1] < _NONE)

        def update(r: np.ndarray, pos: np.ndarray, value: np.ndarray) -> None:
            node = pos + width
            tree[r, node] = value
            while node[0] > 1:
                node = node >> 1
                tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])

        def refresh(r: np.ndarray, pos: np.ndarray) -> None:
            after = nxt[r, pos]
            value, has = np.full(len(r), _NONE), after < width
            rank = self.rank(ids[r[has], pos[has]], ids[r[has], after[has]])
            value[has] = np.where(rank == _TOO_HIGH, _NONE, rank * width + pos[has])
            update(r, pos, value)

        while len(row):
            rank, i = tree[row, 1] // width, tree[row, 1] % width
            j = nxt[row, i]
            after = nxt[row, j]
            ids[row, i], nxt[row, i], live[row, j] = rank, after, False
            has = after < width
            prv[row[has], after[has]] = i[has]
            update(row, j, np.full(len(row), _NONE))
            refresh(row, i)
            before = prv[row, i]
            has = before >= 0
            if has.any():
                refresh(row[has], before[has])
            row = row[tree[row, 1] < _NONE]
        out = ids[live].astype("<u4").tobytes()
        ends = 4 * np.cumsum(live.sum(axis=1))
        return [out[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def merge_alone(self, text: bytes) -> bytes:
        """The same for one piece of any length."""
        n, width = len(text), 1 << max(1, (len(text) - 1).bit_length())
        ids, none, pairs = self.bytes[np.frombuffer(text, np.uint8)].tolist(), int(_NONE), self.pairs
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * width)

        def value(i: int) -> int:
            j = nxt[i]
            rank = pairs.get((ids[i] << 32) | ids[j]) if j < n else None
            return none if rank is None else rank * width + i

        def update(i: int, v: int) -> None:
            k = i + width
            tree[k] = v
            while k > 1:
                k >>= 1
                least = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == least:
                    return
                tree[k] = least

        tree[width : width + n] = [value(i) for i in range(n)]
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        while tree[1] < none:
            rank, i = divmod(tree[1], width)
            j = nxt[i]
            ids[i], nxt[i] = rank, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            nxt[j] = -1
            update(j, none)
            update(i, value(i))
            if prv[i] >= 0:
                update(prv[i], value(prv[i]))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = nxt[i]
        return np.array(out, "<u4").tobytes()

    def encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        out, by_width = {}, {}
        for piece in pieces:
            raw = piece.encode()
            whole = self.ids.get(raw)
            if whole is not None:
                out[piece] = whole.to_bytes(4, "little")
            elif len(raw) > _LONGEST_SIDE_BY_SIDE:
                out[piece] = self.merge_alone(raw)
            else:
                by_width.setdefault(1 << max(1, (len(raw) - 1).bit_length()), []).append((piece, raw))
        for width, found in by_width.items():
            for a in range(0, len(found), 1 << 14):
                part = found[a : a + (1 << 14)]
                out.update(zip([p for p, _ in part], self.merge_side_by_side([r for _, r in part], width)))
        return out

    def encode(self, texts: list[str | None], pattern: regex.Pattern) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        split = [pattern.findall(t) if t else [] for t in texts]
        kept = self.kept
        new = set().union(*split).difference(kept)
        if new:
            if len(kept) + len(new) > _KEPT_PIECES:
                kept.clear()
                new = set().union(*split)
            kept.update(self.encode_pieces(list(new)))
        return [b"".join(map(kept.__getitem__, s)) for s in split]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def vocabulary(rank_file: bytes) -> Vocabulary:
    """One table per worker and file."""
    key = hash(rank_file)
    if key not in _OPEN:
        _OPEN[key] = Vocabulary(rank_file)
    return _OPEN[key]


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``ids`` (array of int) of every text. ``ranks`` is a tiktoken rank file on the driver, whose size is
    that of the vocabulary; it travels to the tasks as a broadcast. A map, no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(_read(ranks))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, compiled = vocabulary(sent.value), regex.compile(pattern)
        for batch in ta.rows(batches, 256):
            found = vocab.encode(batch.column(1).to_pylist(), compiled)
            ends = np.cumsum([0, *(len(x) // 4 for x in found)])
            flat = np.frombuffer(b"".join(found), "<i4")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], [id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def id_lists(column: pa.Array) -> list[np.ndarray]:
    """The id lists of a batch as numpy arrays; null is empty."""
    values, bounds = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))])
    return [values[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def decode(tokens: DataFrame, ranks: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col``, ``bytes`` of every id list; an unknown id is an error."""
    sent = tokens.sparkSession.sparkContext.broadcast(_read(ranks))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(sent.value)
        for batch in batches:
            out = pa.array([vocab.decode(x) for x in id_lists(batch.column(1))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), out], [id_col, "bytes"])

    kind = tokens.schema[id_col].dataType.simpleString()
    return tokens.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, bytes binary")
