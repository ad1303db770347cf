"""Quality rules: gradient-boosted trees over document statistics, scored as flat numpy node arrays.

Statistics are computed in one pass over whole texts, the trees (logistic loss, histogram splits, monotonic constraints
on chosen features) are fitted in numpy on a bounded sample of labelled rows and applied to every row.

Results for odd input: null and empty texts have all counts 0 and fail the base rules (fewer than 50 words); repeated rows
give repeated results; other columns are ignored; without usable labels (none, or one class) the verdict is the base
rules' alone and score is null.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.llm import textarrays as ta
from twinlens.session import materialize

COUNTS = ["n_bytes", "n_chars_all", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
          "n_distinct_words", "n_upper", "n_lower", "n_digits", "n_punctuation", "n_accents", "max_word_bytes"]
#: Feature name -> direction in which the score may move with it: -1 only down, 1 only up, 0 free.
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1,
    "distinct_share": 0, "upper_share": 0, "digit_share": 0, "punctuation_per_word": 0, "accent_share": 0,
    "words_per_line": 0, "log_longest": 0,
}


def _table(text: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(text)] = True
    return out


_SYMBOL = _table(b"#*$%&|<>")
_UPPER, _LOWER, _DIGIT = _table(bytes(range(65, 91))), _table(bytes(range(97, 123))), _table(bytes(range(48, 58)))
_PUNCT = _table(b".,;:!?'\"()-")


def statistics(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of COUNTS for each text."""
    n = len(bounds) - 1
    out = np.zeros((n, len(COUNTS)), np.int64)
    if not len(data):
        return out
    col = {name: k for k, name in enumerate(COUNTS)}
    lead, inside = (data & 0xC0) != 0x80, ~ta.SPACE[data]
    starts, ends, doc = ta.pieces(data, bounds)
    word = ta.hashes(data, starts, ends)
    out[:, col["n_bytes"]] = bounds[1:] - bounds[:-1]
    for name, flags in (("n_chars_all", lead), ("word_chars", inside & lead), ("n_symbols", _SYMBOL[data]), ("n_upper", _UPPER[data]),
                        ("n_lower", _LOWER[data]), ("n_digits", _DIGIT[data]), ("n_punctuation", _PUNCT[data]), ("n_accents", data >= 0xC0)):
        out[:, col[name]] = ta.totals(flags, bounds)
    count = lambda d: np.bincount(d, minlength=n)
    out[:, col["n_words"]] = count(doc)
    later, _ = ta.later_copies(word, doc)
    out[:, col["n_distinct_words"]] = count(doc[~later])
    np.maximum.at(out[:, col["max_word_bytes"]], doc, ends - starts)
    l_start, l_end, l_doc = ta.pieces(data, bounds, ta.NEWLINE)
    run = np.concatenate([[0], np.cumsum(inside)])
    full = run[l_end] > run[l_start]
    l_start, l_end, l_doc = l_start[full], l_end[full], l_doc[full]
    later, _ = ta.later_copies(ta.hashes(data, l_start, l_end), l_doc)
    out[:, col["n_lines"]], out[:, col["n_dup_lines"]] = count(l_doc), count(l_doc[later])
    window, at = ta.windows(word, doc, 3)
    _, twice = ta.later_copies(window, doc[at])
    covered = np.zeros(len(word) + 2, bool)
    for k in range(3):
        covered[at[twice] + k] = True
    out[:, col["n_repeat_words"]] = count(doc[covered[: len(word)]])
    return out


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """COUNTS of every text; a map, no shuffle."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ta.rows(batches):
            got = np.concatenate(ta.per_span(statistics, batch.column(1)) or [np.zeros((0, len(COUNTS)), np.int64)])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(got[:, k]) for k in range(len(COUNTS)))], [id_col, *COUNTS])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(count, f"`{id_col}` {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


def features(stats: dict[str, np.ndarray]) -> np.ndarray:
    s = {k: np.asarray(v, np.float64) for k, v in stats.items()}
    words, lines, letters = np.maximum(s["n_words"], 1), np.maximum(s["n_lines"], 1), np.maximum(s["n_upper"] + s["n_lower"], 1)
    return np.stack([
        np.log1p(s["n_words"]), s["word_chars"] / words, s["n_symbols"] / words, s["n_dup_lines"] / lines, s["n_repeat_words"] / words,
        s["n_distinct_words"] / words, s["n_upper"] / letters, s["n_digits"] / words, s["n_punctuation"] / words,
        s["n_accents"] / np.maximum(s["n_chars_all"], 1), words / lines, np.log1p(s["max_word_bytes"]),
    ], axis=1)


@dataclass
class Trees:
    """Complete binary trees of one depth: node k has children 2k+1 and 2k+2; leaves follow the inner nodes."""

    feature: np.ndarray  # (trees, inner nodes)
    cut: np.ndarray  # go right when value > cut
    value: np.ndarray  # (trees, leaves)
    start: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        total, depth = np.full(len(x), self.start), int(self.value.shape[1]).bit_length() - 1
        at = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[at, f[node]] > c[node])
            total += v[node - len(f)]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, directions: list[int], trees: int = 80, depth: int = 3, rate: float = 0.15,
              bins: int = 64, ridge: float = 1.0, least: int = 5) -> Trees:
    """Newton boosting on the logistic loss. A split on a constrained feature must keep the order of its two sides, and
    their midpoint then bounds every leaf below, so the score is monotonic in that feature."""
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    # cut halfway to the next value seen, so that values just outside the sample fall on the near side
    ordered = [np.append(v := np.unique(x[:, j]), v[-1:]) for j in range(d)]
    middle = [(o[i := np.searchsorted(o[:-1], e, side="right") - 1] + o[i + 1]) / 2 for o, e in zip(ordered, edges)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(d)], axis=1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    inner, leaves = 2**depth - 1, 2**depth
    feature, cut, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    total = np.full(n, start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node, bounds = np.zeros(n, np.int64), {0: (-np.inf, np.inf)}
        for k in range(inner):
            low, high = bounds[k]
            bounds[2 * k + 1] = bounds[2 * k + 2] = (low, high)
            rows = np.flatnonzero(node == k)
            best = (1e-9, None)
            for j in range(d):
                if len(rows) < 2 * least or not len(edges[j]):
                    continue
                b, m = binned[rows, j], len(edges[j])
                gl, hl = np.cumsum(np.bincount(b, g[rows], m + 1))[:-1], np.cumsum(np.bincount(b, h[rows], m + 1))[:-1]
                nl = np.cumsum(np.bincount(b, minlength=m + 1))[:-1]
                gs, hs = g[rows].sum(), h[rows].sum()
                wl, wr = np.clip(-gl / (hl + ridge), low, high), np.clip(-(gs - gl) / (hs - hl + ridge), low, high)
                loss = lambda w, gg, hh: -(gg * w + 0.5 * (hh + ridge) * w * w)
                gain = loss(wl, gl, hl) + loss(wr, gs - gl, hs - hl) - loss(np.clip(-gs / (hs + ridge), low, high), gs, hs)
                gain[(nl < least) | (len(rows) - nl < least) | (directions[j] * (wr - wl) < 0)] = -np.inf
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (gain[i], (j, i, wl[i], wr[i]))
            if best[1] is None:
                node[rows] = 2 * k + 1
                continue
            j, i, wl, wr = best[1]
            feature[t, k], cut[t, k] = j, middle[j][i]
            node[rows] = 2 * k + 1 + (binned[rows, j] > i)
            if directions[j]:
                mid = (wl + wr) / 2
                bounds[2 * k + 1], bounds[2 * k + 2] = ((low, mid), (mid, high)) if directions[j] > 0 else ((mid, high), (low, mid))
        for leaf in range(leaves):
            rows = node == leaf + inner
            low, high = bounds[leaf + inner]
            weight = -g[rows].sum() / (h[rows].sum() + ridge)
            value[t, leaf] = rate * np.clip(weight, low, high)
        total += value[t][node - inner]
    return Trees(feature, cut, value, start)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                  train_rows: int = 20_000, least_score: float = 0.5) -> DataFrame:
    """Statistics, base verdict, score and final verdict of every document.

    The trees are fitted on about ``train_rows`` labelled rows (the documented bound of the sample): those whose hashed
    statistics fall below that share, equal ones once. They see statistics only. Repeated ids among the labels count once,
    by their largest label.
    """
    stats = materialize(document_statistics(docs, id_col, text_col))
    marks = labels.select(F.col(id_col), F.col(label_col).cast("double").alias("_label")).where(
        F.col(id_col).isNotNull() & F.col("_label").isin(0.0, 1.0)).groupBy(id_col).agg(F.max("_label").alias("_label"))
    known = stats.join(marks, id_col).select("_label", *COUNTS)
    place = F.pmod(F.xxhash64(F.lit("quality"), *known.columns), F.lit(1_000_003)) / 1_000_003.0
    share = train_rows / max(1, known.count())
    sample = known.where(place < share).dropDuplicates().orderBy(place, *known.columns).toPandas()
    model = None
    if sample["_label"].nunique() == 2:
        model = fit_trees(features({c: sample[c].to_numpy() for c in COUNTS}), sample["_label"].to_numpy(), list(FEATURES.values()))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model is None:
                scores = pa.nulls(batch.num_rows, pa.float64())
            else:
                scores = pa.array(model.scores(features({c: batch.column(c).to_numpy() for c in COUNTS})))
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stats.schema) + ", score double"
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (stats.mapInArrow(score, schema)
            .withColumn("base_failed", failed)
            .withColumn("kept", ~failed & (F.coalesce(F.col("score"), F.lit(1.0)) >= least_score)))
