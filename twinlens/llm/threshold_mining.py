"""Hard negatives by Fagin's threshold algorithm.

A block of rows keeps, for every dimension, its rows in order of that component. An anchor walks all lists side by side, from
the high end where its own component is positive and from the low end where it is negative; rows met are scored by random
access, in integers. The sum of the anchor's components times the values the walk stands at bounds the score of every row not
met yet. A walk ends once that threshold lies strictly below the k-th score of every window it fills (or below the window),
so ties at the k-th score are all met.

Two walks: one for an anchor's positives, the best rows of its label; one for its windows, which reach from ``low`` percent
of a positive's score up to that score, over the rows of other labels. Blocks of rows meet blocks of anchors; a meeting
returns k rows a window, which are ranked at the end.

Results for odd input: rows without id or label, and vectors that are null or empty or hold a null, NaN or infinite
component, take no part; a component that leaves 62 bits or a score that leaves 64 is an error; an anchor meets vectors of its
own length only and never a row of its own id; other rows that repeat an id count each by itself; anchors that repeat id,
label and vector are one; a positive of negative score has an empty window; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlens.llm.integer_vectors import floors, usable
from twinlens.session import materialize

FIRST_STEP = 16  # positions a walk takes in every list before it looks at the threshold; doubled each time


class SortedLists:
    """The rows of a block in order of id, and one list of them per dimension in order of its component."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.values = ids[order], labels[order], values[order]
        self.lists = np.argsort(self.values, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.values, self.lists, axis=0)
        self.largest = np.abs(self.values.astype(float)).max(axis=0, initial=0.0)

    def walk(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int | None]]:
        """(rows met, their scores, bound on the scores of all others; None when there are none)."""
        n, values = len(self.ids), self.values
        if self.largest @ np.abs(anchor.astype(float)) >= 2.0**62:  # 64 bits might not hold a score
            values, anchor = values.astype(object), anchor.astype(object)
        down, up = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        if not len(down) + len(up):
            yield np.arange(n), values @ anchor, None
            return
        met, at, step = np.zeros(n, bool), 0, FIRST_STEP
        while at < n:
            to = min(n, at + step)
            near = np.zeros(n, bool)
            near[self.lists[n - to : n - at, down]] = True
            near[self.lists[at:to, up]] = True
            rows = np.flatnonzero(near & ~met)
            met[rows] = True
            left = None
            if to < n:
                left = sum(int(a) * int(x) for a, x in zip(anchor[down], self.sorted[n - to, down])) + sum(int(a) * int(x) for a, x in zip(anchor[up], self.sorted[to - 1, up]))
            yield rows, values[rows] @ anchor, left
            at, step = to, 2 * step

    def best(self, anchor_id: int, label: int, anchor: np.ndarray, k: int, windows: list[tuple[int, int]] | None) -> list[tuple[np.ndarray, np.ndarray]]:
        """(rows, scores) of the ``k`` best rows: one list of the anchor's label without ``windows``, else one list a window
        (least and greatest score) of the other labels."""
        spans = windows if windows is not None else [(None, None)]
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in spans]
        for rows, scores, left in self.walk(anchor):
            fits = (self.labels[rows] == label) if windows is None else (self.labels[rows] != label)
            fits &= self.ids[rows] != anchor_id
            rows, scores = rows[fits], scores[fits]
            ended = True
            for w, (low, high) in enumerate(spans):
                inside = slice(None) if low is None else (scores >= low) & (scores <= high)
                r, s = np.concatenate([found[w][0], rows[inside]]), np.concatenate([found[w][1], scores[inside]])
                keep = np.lexsort((r, -s))[:k]  # rows stand in order of id
                found[w] = r[keep], s[keep]
                if left is not None:
                    full = len(keep) == k and left < s[keep[-1]]
                    ended &= bool(full or (low is not None and (left < low or low > high)))
            if left is None or ended:
                break
        return found


def _blocks(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, block_rows: int, block_anchors: int) -> DataFrame:
    """Rows and anchors side by side, for every block of rows with every block of anchors."""
    nr, na = max(1, -(-n_rows // block_rows)), max(1, -(-n_anchors // block_anchors))
    block = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), F.monotonically_increasing_id()), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    base = rows.withColumns({"rb": block(1, nr), "key": F.lit(None).cast("long"), "scores": F.lit(None).cast("array<long>")}).withColumn("ab", every(na))
    asked = anchors.withColumn("ab", block(2, na)).withColumn("rb", every(nr))
    return base.unionByName(asked).withColumn("d", F.size("v")).groupBy("d", "rb", "ab")


def _searched(meetings, k: int, low: int) -> DataFrame:
    """(anchor, key, slot, id, score): the best rows of a block, of the anchor's label where it brings no scores, else for every
    score's window (slot) of other labels."""

    def search(group: pa.Table) -> pa.Table:
        ids, keys = group.column("id").to_numpy(), group.column("key")
        asks = keys.is_valid().to_numpy(zero_copy_only=False)
        key = keys.fill_null(0).to_numpy()
        labels = np.unique(np.array(group.column("label").to_pylist(), object), return_inverse=True)[1]
        values = group.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        out: list[tuple] = []
        if asks.any() and not asks.all():
            lists = SortedLists(ids[~asks], labels[~asks], values[~asks])
            scores = group.column("scores").filter(pa.array(asks)).to_pylist()
            for i, given in zip(np.flatnonzero(asks), scores):
                windows = None if given is None else [(-(-low * s // 100), s) for s in given]
                for slot, (rows, found) in enumerate(lists.best(int(ids[i]), labels[i], values[i], k, windows)):
                    out += [(ids[i], key[i], slot, a, s) for a, s in zip(lists.ids[rows].tolist(), found.tolist())]
        columns = list(zip(*out)) if out else [()] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["anchor", "key", "slot", "id", "score"])

    return meetings.applyInArrow(search, "anchor long, key long, slot int, id long, score long")


def hard_negatives(vectors: DataFrame, is_anchor: Column, k: int = 5, positives: int = 5, low: int = 80, scale: float = 256.0, id_col: str = "vec_id",
                   vector_col: str = "embedding", label_col: str = "label", block_rows: int = 8192, block_anchors: int = 512) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each of the ``positives`` best rows of
    an anchor's label the ``k`` best rows of other labels whose score lies between ``low`` percent of the positive's and it.

    ``is_anchor`` is a condition on the columns of ``vectors``. Components become floor(scale * x), scores are inner products,
    ties go to smaller ids.
    """
    good = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & usable(vector_col))
    rows = materialize(good.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), floors(vector_col, scale).alias("v"), is_anchor.alias("anchor")))
    n_rows, base = rows.count(), rows.select("id", "label", "v")
    anchors = materialize(rows.where("anchor").select("id", "label", "v").distinct().withColumn("key", F.xxhash64("id", "label", "v")))
    n_anchors = anchors.count()
    plain = anchors.withColumn("scores", F.lit(None).cast("array<long>"))
    order = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
    found = _searched(_blocks(base, plain, n_rows, n_anchors, block_rows, block_anchors), positives, low)
    best = materialize(found.withColumn("at", order("anchor", "key")).where(F.col("at") <= positives)
                       .select("anchor", "key", (F.col("at") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    scores = best.groupBy("anchor", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "positive_score"))), lambda x: x["positive_score"]).alias("scores"))
    asked = anchors.join(scores.withColumnRenamed("anchor", "id"), ["id", "key"]).select("id", "label", "v", "key", "scores")
    met = _searched(_blocks(base, asked, n_rows, n_anchors, block_rows, block_anchors), k, low)
    ranked = met.withColumn("rank", order("anchor", "key", "slot")).where(F.col("rank") <= k)
    return ranked.join(best, ["anchor", "key", "slot"]).select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
                                                              F.col("score").alias("negative_score"))
