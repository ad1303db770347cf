"""Language identification with string kernels.

The blended-spectrum presence kernel of two texts counts the byte n-grams (n = 1, 2, 3; letters lower-cased, other ASCII
characters as blanks) that occur in both, normalised by their own counts. Nystrom features come from landmark texts, a
one-versus-rest kernel ridge regression is solved on them, and batches are scored by matrix products: presence matrix times
landmark matrix times weights.

Results for odd input: a text that is null or has no letter is ``und`` with score 0; repeated rows give repeated results;
other columns are ignored; without any usable label every text is ``und``; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.llm import textarrays as ta
from twinlens.llm.sampling import labelled_texts, remainder

_LETTERS = np.full(256, 32, np.uint8)
for _b in range(256):
    if _b >= 128 or 97 <= _b <= 122:
        _LETTERS[_b] = _b
    elif 65 <= _b <= 90:
        _LETTERS[_b] = _b + 32
_ANY_LETTER = regex.compile(r"\p{L}")
_UNDETERMINED = "und"


def _grams(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text index, code) of the 1-, 2- and 3-grams; codes of different lengths do not meet."""
    text = _LETTERS[data].astype(np.int32)
    doc = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    yield doc, text
    two = (text[:-1] << 8) | text[1:]
    same = doc[:-1] == doc[1:]
    yield doc[:-1][same], two[same] + (1 << 8)
    three = (two[:-1] << 8) | text[2:]
    same = doc[:-2] == doc[2:]
    yield doc[:-2][same], three[same] + ((1 << 8) + (1 << 16))


class KernelClassifier:
    def __init__(self, texts: list[str], labels: list[str], landmarks: int = 128, ridge: float = 1e-2, seed: int = 7,
                 least_per_label: int = 2) -> None:
        self.labels = sorted(set(labels))
        rng = np.random.default_rng(seed)
        by_label = [rng.permutation(np.flatnonzero(np.array(labels) == c)) for c in self.labels]
        ranked = [i for turn in range(max(map(len, by_label), default=0)) for c in by_label for i in c[turn : turn + 1]]
        chosen = ranked[: max(landmarks, least_per_label * len(self.labels))]
        self.table = None
        if len(self.labels) < 2:
            return
        column = pa.array([texts[i] for i in chosen], pa.large_string())
        data, bounds = ta.utf8(column)
        pairs = [np.unique(np.stack([d, c], axis=1), axis=0) for d, c in _grams(data, bounds)]
        doc, code = np.concatenate(pairs).T
        codes = np.unique(code)
        self.width, self.table = len(codes), self._places(codes)
        marks = np.zeros((self.width, len(chosen)), np.float32)
        marks[self.table[code], doc] = 1
        self.marks = marks / np.sqrt(np.maximum(marks.sum(axis=0), 1))
        between = self.marks.T @ marks / np.sqrt(np.maximum(marks.sum(axis=0), 1))
        value, vector = np.linalg.eigh(between.astype(np.float64))
        kept = value > 1e-6 * value.max()
        nystrom = vector[:, kept] / np.sqrt(value[kept])
        kernel = np.concatenate(ta.per_span(self.kernel, pa.array(texts, pa.large_string())))
        x = np.concatenate([kernel @ nystrom, np.ones((len(texts), 1))], axis=1)
        y = np.where(np.array(labels)[:, None] == np.array(self.labels), 1.0, -1.0)
        share = np.array([(np.array(labels) == c).mean() for c in labels])
        xw = x / share[:, None]  # every language weighs the same
        solved = np.linalg.solve(xw.T @ x + ridge * len(texts) * np.eye(x.shape[1]), xw.T @ y)
        self.weights, self.bias = (nystrom @ solved[:-1]).astype(np.float32), solved[-1].astype(np.float32)

    @staticmethod
    def _places(codes: np.ndarray) -> np.ndarray:
        """Column of every code; codes of no landmark have the one past the last."""
        table = np.full((1 << 8) + (1 << 16) + (1 << 24), len(codes), np.int32)
        table[codes] = np.arange(len(codes))
        return table

    def __getstate__(self) -> dict:
        """The table travels as its sorted codes."""
        codes = None if self.table is None else np.flatnonzero(self.table < self.width).astype(np.int32)
        return {**self.__dict__, "table": codes}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        if self.table is not None:
            self.table = self._places(self.table)

    def kernel(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Normalised kernel of every text with every landmark."""
        out = []
        for a in range(0, len(bounds) - 1, 256):
            part = bounds[a : a + 257]
            present, distinct = np.zeros((len(part) - 1, self.width + 1), np.uint8), 0
            flat = present.reshape(-1)
            for doc, code in _grams(data[part[0] : part[-1]], part - part[0]):
                flat[doc.astype(np.int64) * (self.width + 1) + self.table[code]] = 1
            inside = present[:, : self.width].astype(np.float32)
            distinct = np.maximum(inside.sum(axis=1, keepdims=True), 1)
            out.append(inside @ self.marks / np.sqrt(distinct))
        return np.concatenate(out) if out else np.zeros((0, self.marks.shape[1]), np.float32)

    def scores(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return self.kernel(data, bounds) @ self.weights + self.bias


def fit(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", per_label: int = 250,
        landmarks: int = 128) -> KernelClassifier:
    """Learn from about ``per_label`` texts of each language whose id is not held out (bounded by that parameter). There are
    ``landmarks`` landmark texts, and two of each language at least, however many languages there are."""
    sample = labelled_texts(docs.where(remainder(id_col) != 1), None, lang_col, per_label, id_col, text_col)
    return KernelClassifier(sample["text"].tolist(), sample["_label"].tolist(), landmarks)


def predict(docs: DataFrame, model: KernelClassifier, id_col: str = "doc_id", text_col: str = "text",
            carried: list[str] | None = None, lang_out: str = "lang_pred", score_out: str = "lang_score",
            letter_out: str | None = None) -> DataFrame:
    """``id_col`` (or ``carried`` columns), language and score of every row. A map, no shuffle.

    ``letter_out`` adds a flag, whether the text has a letter; it does not depend on the model.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [id_col] if carried is None else list(carried)
    cols = kept if text_col in kept else [*kept, text_col]  # the text travels once
    at = cols.index(text_col)
    added = [letter_out] if letter_out else []

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in ta.rows(batches):
            column = batch.column(at)
            names, score = np.full(batch.num_rows, _UNDETERMINED, object), np.zeros(batch.num_rows)
            letter = np.zeros(batch.num_rows, bool)
            if model.labels or letter_out:
                data, bounds = ta.utf8(column)
                letter = ta.totals((_LETTERS[data] != 32) & (data < 128), bounds) > 0
                for i in np.flatnonzero(~letter):
                    letter[i] = bool(_ANY_LETTER.search(column[i].as_py() or ""))
            if model.labels:
                if model.table is None:
                    names[letter], score[letter] = model.labels[0], 1.0
                else:
                    got = np.concatenate(ta.per_span(model.scores, column)) if batch.num_rows else np.zeros((0, 2))
                    best = got.argmax(axis=1)
                    names[letter] = np.array(model.labels, object)[best[letter]]
                    score[letter] = np.clip((got[np.arange(len(best)), best][letter] + 1) / 2, 0, 1)
            flag = [pa.array(letter)] if letter_out else []
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(names, pa.string()), pa.array(score), *flag], [*kept, lang_out, score_out, *added])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.select(*cols).mapInArrow(run, f"{schema}, {lang_out} string, {score_out} double" + "".join(f", {c} boolean" for c in added))


def identify(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", per_label: int = 250,
             landmarks: int = 128) -> DataFrame:
    """id, held_out, lang_pred, score of every row, by a model fitted on rows that are not held out."""
    model = fit(docs, lang_col, id_col, text_col, per_label, landmarks)
    return predict(docs, model, id_col, text_col).select(
        id_col, (remainder(id_col) == 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
