"""Vector code compression: every part of a vector becomes the index of its nearest codebook entry.

Nearest entries are found over memoised grid cells. A part's components are cut into coarse cells; the cell, hashed, names
a list of the entries that can be nearest somewhere in its box: an entry whose least distance to the box exceeds another's
greatest is dominated everywhere in it. A list is made when its cell is first met and kept while the codebook lasts; only
listed entries are evaluated, exactly, in integers.

A round of training is one pass: tasks return sums and counts per part and entry, Spark adds them, and the codebooks (parts
x entries x width numbers) are all that reaches the driver.

Results for odd input: vectors that are null or empty or hold a null, NaN or infinite component take no part, nor do vectors
of another length than the one of the smallest id; a length that ``parts`` does not divide is filled up with zeros at the end;
null ids are coded and are larger than all others, equal ids are ordered by their vector; a table of fewer rows than
``entries`` has smaller codebooks; null labels are one label; an empty table gives no row; other columns are ignored.
Components beyond 62 bits and errors beyond 64 are errors of the query.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.llm.hot import attach
from twinlens.llm.integer_vectors import floors, usable
from twinlens.session import materialize

MEMO_CELLS = 200_000  # cells one part keeps lists for in a task; a fuller memo starts again
SMALL = 2**28  # components below it give distances within 64 bits


def exact(values: np.ndarray) -> np.ndarray:
    """64-bit integers where every distance fits into them, else Python's integers."""
    return values.astype(object) if values.size and max(int(values.max()), -int(values.min())) >= SMALL else values.astype(np.int64)


@dataclass
class Codebooks:
    """entries[part, entry, position]."""

    entries: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for x in self.entries.ravel()).encode()).hexdigest()


class GridMemo:
    """Nearest entries of one part's codebook."""

    def __init__(self, book: np.ndarray, cell: int) -> None:
        self.book, self.cell = exact(book), cell
        self.lists: dict[bytes, np.ndarray] = {}

    def listed(self, cells: np.ndarray) -> np.ndarray:
        """For every cell, which entries no other entry dominates across its box."""
        low = cells[:, None, :] * self.cell
        high = low + (self.cell - 1)
        gap = np.maximum(np.maximum(low - self.book, self.book - high), 0)
        reach = np.maximum(abs(self.book - low), abs(self.book - high))
        return (gap * gap).sum(axis=2) <= (reach * reach).sum(axis=2).min(axis=1)[:, None]

    def masks(self, x: np.ndarray) -> np.ndarray:
        """Entries to evaluate for every row of ``x``."""
        cells = x // self.cell
        if cells.dtype == object:
            return self.listed(cells)
        small = cells.astype(np.int32) if len(cells) and max(cells.max(), -cells.min()) < 2**31 else cells
        packed = np.ascontiguousarray(small).view(np.dtype((np.void, small.dtype.itemsize * small.shape[1]))).ravel()
        names, first, of = np.unique(packed, return_index=True, return_inverse=True)
        keys = [n.tobytes() for n in names]
        unknown = [i for i, k in enumerate(keys) if k not in self.lists]
        if len(self.lists) + len(unknown) > MEMO_CELLS:
            self.lists.clear()
            unknown = list(range(len(keys)))
        for a in range(0, len(unknown), 4096):
            part = unknown[a : a + 4096]
            for i, mask in zip(part, self.listed(cells[first[part]])):
                self.lists[keys[i]] = mask
        return np.array([self.lists[k] for k in keys], bool)[of]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and its squared distance; ties to the lower index."""
        best, at = np.full(len(x), -1, x.dtype), np.zeros(len(x), np.int64)
        masks = self.masks(x)
        for e, entry in enumerate(self.book):
            rows = np.flatnonzero(masks[:, e])
            away = x[rows] - entry
            d = (away * away).sum(axis=1)
            better = (best[rows] < 0) | (d < best[rows])
            best[rows[better]], at[rows[better]] = d[better], e
        return at, best


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _assigned(batches: Iterable[pa.RecordBatch], books: Codebooks, cell: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For every batch (its last column holds the vectors) and part: the part's values, indexes and distances."""
    memos = [GridMemo(book, cell) for book in books.entries]
    for batch in batches:
        if batch.num_rows == 0:
            continue
        v = _matrix(batch.column(batch.num_columns - 1), books.entries.shape[0] * books.entries.shape[2])
        whole = exact(v)
        if memos[0].book.dtype == object:
            whole = whole.astype(object)
        for p, memo in enumerate(memos):
            x = np.ascontiguousarray(whole[:, p * memo.book.shape[1] : (p + 1) * memo.book.shape[1]])
            yield batch, p, x, *memo.nearest(x)


def _refined(rows: DataFrame, books: Codebooks, cell: int) -> Codebooks:
    """Every entry replaced by the floor of the mean of its parts; unused entries stay."""
    parts, n, width = books.entries.shape
    schema = "p int, e int, n long, s array<decimal(38,0)>"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros((parts, n), np.int64), np.zeros((parts, n, width), object)
        for _, p, x, at, _ in _assigned(batches, books, cell):
            count[p] += np.bincount(at, minlength=n)
            for e in np.unique(at):
                sums[p, e] += x[at == e].sum(axis=0).astype(object)
        p, e = np.nonzero(count)
        if len(p):
            s = pa.array([[Decimal(int(c)) for c in sums[i, j]] for i, j in zip(p, e)], pa.list_(pa.decimal128(38, 0)))
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), s], ["p", "e", "n", "s"])

    partial = rows.select("v").mapInArrow(run, schema)
    totals = partial.groupBy("p", "e").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[k]).alias(f"s{k}") for k in range(width)])
    entries = books.entries.copy()
    for r in totals.collect():  # parts x entries rows
        entries[r["p"], r["e"]] = [int(r[f"s{k}"]) // r["n"] for k in range(width)]
    return Codebooks(entries)


def integer_rows(vectors: DataFrame, scale: float, parts: int, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, int]:
    """(id, label, v) of the vectors that take part, and their length; written once."""
    kept = vectors.where(usable(vector_col)).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), floors(vector_col, scale).alias("v"))
    first = kept.select(F.col("id").isNull().alias("last"), "id", F.size("v").alias("d")).orderBy("last", "id", "d").limit(1).collect()
    if not first:
        return materialize(kept), 0
    d = first[0]["d"]
    width = -(-d // parts) * parts
    padded = F.concat("v", F.array_repeat(F.lit(0).cast("long"), width - d)) if width > d else F.col("v")
    return materialize(kept.where(F.size("v") == d).select("id", "label", padded.alias("v"))), width


def train(rows: DataFrame, width: int, parts: int = 8, entries: int = 16, rounds: int = 6, cell: int = 1024) -> Codebooks:
    """Codebooks of (id, label, v) rows, started from the smallest ids."""
    first = rows.select(F.col("id").isNull().alias("last"), "id", "v").orderBy("last", "id", "v").limit(entries).collect()
    start = np.array([r["v"] for r in first], dtype=object).reshape(len(first), parts, width // parts)
    books = Codebooks(np.ascontiguousarray(start.transpose(1, 0, 2)))
    for _ in range(rounds):
        books = _refined(rows, books, cell)
    return books


def encode(rows: DataFrame, books: Codebooks, cell: int = 1024) -> DataFrame:
    """(id, label, code, error) of (id, label, v) rows: two hex digits a part, and the squared distance to the coded vector."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch, p, _, at, d in _assigned(batches, books, cell):
            held.append((at, d))
            if p + 1 == len(books.entries):
                code = [bytes(row).hex() for row in np.column_stack([a for a, _ in held]).astype(np.uint8)]
                error = sum(x for _, x in held).tolist()
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())], ["id", "label", "code", "error"])
                held = []

    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.select("id", "label", "v").mapInArrow(run, f"id {kind['id']}, label {kind['label']}, code string, error long")


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: float = 4096.0, cell: int = 1024, id_col: str = "vec_id",
             vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id_col, code, error, label_error, codebooks_sha256) of every vector; ``label_error`` is the sum of the errors under its
    label. ``cell`` is the side of a grid cell, after scaling; at most 256 entries. Reads the scaled table once a round."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    rows, width = integer_rows(vectors, scale, parts, id_col, vector_col, label_col)
    books = train(rows, width, parts, entries, rounds, cell) if width else Codebooks(np.zeros((parts, 0, 0), object))
    coded = materialize(encode(rows, books, cell))
    by_label = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
    total = by_label.agg(F.sum("n")).first()[0] or 0
    named = attach(coded, by_label, "label", "n", total)
    return named.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
