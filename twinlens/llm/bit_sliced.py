"""Exact top-k inner products by a bit-sliced index.

Vectors are quantised to integers. A block of rows holds one bitmap per bit of every attribute, over its rows. For a query
the slices of all attributes are added with bitmap arithmetic (carry-save adders: a bit of the query's weight shifts an
attribute's slices, a negative weight takes their complement), which yields the slices of every row's score. The top rows
are selected from the most significant slice downward; rows that tie at the boundary are resolved exactly, by id.

Results for odd input: vectors that are null or empty, hold a null, NaN or infinite component, and rows without id take no
part; a component that leaves 62 bits when quantised, or a best score that leaves 64 bits, is an error; a query meets vectors of its own length only; rows that repeat an id
count each by itself, but never against a query of that id; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinlens.session import materialize

LARGE_VALUES = 4_194_304  # components a large block holds at most
MANY_BLOCKS = 24  # of rows; a table of more has larger blocks
QUERY_BLOCKS = 4  # likewise of queries: a row is copied to every one of them


def _packed(flags: np.ndarray) -> np.ndarray:
    """Bitmaps over the last axis, as 64-bit words."""
    pad = -flags.shape[-1] % 64
    flags = np.concatenate([flags, np.zeros((*flags.shape[:-1], pad), bool)], axis=-1) if pad else flags
    return np.ascontiguousarray(np.packbits(flags, axis=-1, bitorder="little")).view(np.uint64)  # packing keeps a transposed layout


class BitSlicedIndex:
    """Slices of a block of rows, which stand in order of id."""

    def __init__(self, ids: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order].astype(np.int64)
        self.low = self.values.min(axis=0)
        above = (self.values - self.low).T
        largest = int(above.max())
        self.bits = max(1, largest.bit_length())
        # of every bit: its bitmap for every attribute, then the complements
        self.slices = np.concatenate([x for b in range(self.bits) for s in [_packed((above >> b) & 1 == 1)] for x in (s, ~s)])
        self.all = _packed(np.ones(len(ids), bool))

    def score_slices(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of a score that orders rows as the inner product with ``query`` does."""
        weight, d = np.abs(query), len(query)
        asked: dict[int, list[np.ndarray]] = {}
        for t in range(int(weight.max(initial=0)).bit_length()):
            at = np.flatnonzero((weight >> t) & 1)
            if len(at):
                rows = at + d * (query[at] < 0)
                for b in range(self.bits):
                    asked.setdefault(t + b, []).append(2 * d * b + rows)
        out, w, carries, spare = [], 0, [], np.empty_like(self.all)[None]
        while asked or carries:
            rows = np.concatenate([np.zeros(0, np.int64), *asked.pop(w, [])])
            n = len(rows) + sum(map(len, carries))
            stack = (np.empty if n else np.zeros)((max(1, n), len(self.all)), np.uint64)
            np.take(self.slices, rows, axis=0, out=stack[:len(rows)], mode="clip")
            end = len(rows)
            for carry in carries:
                stack[end:end + len(carry)] = carry
                end += len(carry)
            carries = []
            while len(stack) > 1:  # adders overwrite the slices they have read: sums stand in front of the rest, carries behind
                k = len(stack) // 3
                if k:
                    a, b, c = stack[:k], stack[k : 2 * k], stack[2 * k : 3 * k]
                    spare = spare if len(spare) >= k else np.empty_like(a)
                    odd = np.bitwise_xor(a, b, out=spare[:k])
                    a &= b
                    np.bitwise_and(odd, c, out=b)
                    a |= b
                    c ^= odd
                    stack = stack[2 * k :]
                else:
                    a, stack = stack[:1] & stack[1:], stack[:1] ^ stack[1:]
                carries.append(a)
            out.append(stack[0].copy())
            w += 1
        return out

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and inner products of the k best rows, ties to smaller ids; rows of the query's own id are left out."""
        sure = np.zeros_like(self.all)
        maybe = self.all
        own = np.searchsorted(self.ids, [query_id, query_id + 1])
        if own[0] < own[1]:
            maybe = maybe.copy()
            for i in range(*own):
                maybe[i // 64] &= ~(np.uint64(1) << np.uint64(i % 64))
        for slice_ in reversed(self.score_slices(query)):
            high = maybe & slice_
            more = sure | high
            count = int(np.bitwise_count(more).sum())
            if count > k:
                maybe = high
            elif count < k:
                sure, maybe = more, maybe & ~slice_
            else:
                sure, maybe = more, np.zeros_like(maybe)
                break
        rows = self._rows(sure)
        rows = np.concatenate([rows, self._rows(maybe)[: max(0, k - len(rows))]])
        found = self.values[rows]
        if (np.abs(found).astype(float) @ np.abs(query).astype(float) >= 2.0**62).any():  # 64 bits might not hold it
            exact = [sum(a * b for a, b in zip(row, query.tolist())) for row in found.tolist()]
            if any(abs(x) >= 2**63 for x in exact):
                raise ValueError(f"a score of query {query_id} leaves 64 bits; lower the scale")
            return self.ids[rows], np.array(exact, np.int64)
        return self.ids[rows], found @ query

    def _rows(self, bitmap: np.ndarray) -> np.ndarray:
        words = np.flatnonzero(bitmap)
        bits = np.unpackbits(bitmap[words].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at, bit = np.nonzero(bits)
        return words[at] * 64 + bit


def quantised(vectors: DataFrame, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): floor(scale * x) of every usable vector."""
    large = F.raise_error(F.lit(f"a component leaves 62 bits at scale {scale}; lower the scale")).cast("long")
    number = lambda x: F.lit(float(scale)) * x.cast("double")
    v = F.transform(F.col(vector_col), lambda x: F.when(F.abs(number(x)) < 2.0**62, F.floor(number(x))).otherwise(large))
    usable = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return (vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & usable)
            .select(F.col(id_col).cast("long").alias("id"), v.alias("v")))


def top_k(vectors: DataFrame, query_every: int = 50, k: int = 5, scale: float = 256.0, id_col: str = "vec_id",
          vector_col: str = "embedding", block_rows: int = 8192, block_queries: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row whose id is divisible by ``query_every`` its k best other rows.

    Blocks of rows meet blocks of queries; a block pair returns k rows per query, which are ranked at the end. Blocks of a
    large table grow to ``LARGE_VALUES`` components, so rows are copied and indexed less often.
    """
    rows = materialize(quantised(vectors, scale, id_col, vector_col))
    counts = rows.agg(F.count("*").alias("n"), F.count_if(F.col("id") % query_every == 0).alias("q"), F.max(F.size("v")).alias("d")).first()
    large = LARGE_VALUES // (counts["d"] or 1)
    blocks = lambda n, size, many: max(1, -(-n // max(size, min(large, n // many))))
    n_blocks, n_queries = blocks(counts["n"], block_rows, MANY_BLOCKS), blocks(counts["q"], block_queries, QUERY_BLOCKS)
    block = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "id", "v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    base = rows.select("id", "v", F.lit(False).alias("query"), block(1, n_blocks).alias("rb"), every(n_queries).alias("qb"))
    asked = rows.where(F.col("id") % query_every == 0).select("id", "v", F.lit(True).alias("query"), every(n_blocks).alias("rb"), block(2, n_queries).alias("qb"))

    def search(group: pa.Table) -> pa.Table:
        ids, is_query = group.column("id").to_numpy(), group.column("query").to_numpy()
        values = group.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1).astype(np.int64)
        out = []
        if is_query.any() and not is_query.all():
            index = BitSlicedIndex(ids[~is_query], values[~is_query])
            out = [(i, *index.top(int(i), q, k)) for i, q in zip(ids[is_query], values[is_query])]
        parts = [np.concatenate([np.zeros(0, np.int64), *x]) for x in ([np.full(len(o[1]), o[0]) for o in out], [o[1] for o in out], [o[2] for o in out])]
        return pa.table(parts, ["query_id", "vec_id", "score"])

    near = base.unionByName(asked).withColumn("d", F.size("v")).groupBy("d", "rb", "qb").applyInArrow(search, "query_id long, vec_id long, score long")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
