"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters by its own vector (words seen in enough training texts) beside the mean of the vectors of its runs of three
and four characters (hashed), so forms that were never seen are known by their stems. All windows of ``WINDOW`` words, one from
every word on, are scored; a text's logit is its largest window's, calibrated on the training texts. Training
(backpropagation through time, Adam) uses a bounded sample of labelled texts and every ``STRIDE``-th of their windows: at
first every window bears its text's label, then toxic texts are represented by their highest windows.

Results for odd input: texts that are null or have no word get the score of the lowest logit (near 0); repeated rows give
repeated results; other columns are ignored; without labels of both kinds every score is 0; long texts are scored whole.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.llm import textarrays as ta
from twinlens.llm.sampling import labelled_rows, order, remainder

WINDOW, STRIDE = 16, 8
_HIDDEN, _WORD, _CHAR, _GRAMS = 8, 8, 12, 1 << 15
_EMPTY = -8.0
_AT_ONCE = 20_000  # distinct words whose runs are held at once
_LONG = 32  # words from which on a text's windows are laid out as slices of its words
_SLIDE = 8192  # windows laid out together

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_GAP = np.array([not (b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122) for b in range(256)])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _fold(data: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and the accented capitals of Latin-1."""
    folded = _FOLD[data]
    if len(data):
        folded[1:][(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)] += 32
    return folded


def _add_rows(total: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    for j in range(total.shape[1]):
        total[:, j] += np.bincount(rows, values[:, j], len(total))


def _grams(padded: np.ndarray, s: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashed runs of 3, then of 4 bytes of each word with a mark before and after."""
    size = length + np.maximum(length - 1, 0)
    owner = np.repeat(np.arange(len(s)), size)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    three = k < length[owner]
    k = np.where(three, k, k - length[owner]) - 1
    code = np.where(three, 7, 11).astype(np.uint64)
    for j in range(4):
        at = k + j
        byte = padded[s[owner] + at + 1].astype(np.uint64)
        byte[at < 0], byte[at == length[owner]] = 1, 2
        code = np.where((j < 3) | ~three, code * np.uint64(0x100000001B3) + byte, code)
    return (ta.mix(code) >> np.uint64(49)).astype(np.uint16)


def _places(first: np.ndarray, left: np.ndarray) -> np.ndarray:
    k = np.arange(WINDOW)
    return np.where(k < left[:, None], first[:, None] + k, -1)


class Words:
    """Distinct words of a range of texts: hashes, runs of bytes; and which word stands where."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray) -> None:
        folded = _fold(data)
        starts, ends, self.doc = ta.pieces(data, bounds, _GAP)
        hashed = ta.hashes(folded, starts, ends)
        self.hash, first, self.at = np.unique(hashed, return_index=True, return_inverse=True)
        s, length = starts[first], (ends - starts)[first]
        self.size = length + np.maximum(length - 1, 0)
        self.bounds = np.concatenate([[0], np.cumsum(self.size)])
        padded = np.concatenate([[0], folded, np.zeros(4, np.uint8)]).astype(np.uint8)
        parts = [_grams(padded, s[a : a + _AT_ONCE], length[a : a + _AT_ONCE]) for a in range(0, len(s), _AT_ONCE)]
        self.gram = np.concatenate([np.zeros(0, np.uint16), *parts])

    def starts(self, n_docs: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word position of each window, words of its text from there on, and its text."""
        count = np.bincount(self.doc, minlength=n_docs)
        begin = np.concatenate([[0], np.cumsum(count)])[:-1]
        number = np.where(count > 0, np.maximum(1, -(-(count - (WINDOW - stride)) // stride)), 0)
        doc = np.repeat(np.arange(n_docs), number)
        nth = np.arange(len(doc)) - np.repeat(np.concatenate([[0], np.cumsum(number)])[:-1], number)
        return begin[doc] + nth * stride, count[doc] - nth * stride, doc

    def windows(self, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """Word positions (windows, WINDOW) of every STRIDE-th window, -1 where a text ends before; text of each window."""
        first, left, doc = self.starts(n_docs, STRIDE)
        return _places(first, left), doc


class _Space:
    """Arrays that are taken once and used again by every pass over windows."""

    def __init__(self) -> None:
        self.held: dict[str, np.ndarray] = {}

    def get(self, name: str, *shape: int) -> np.ndarray:
        size = int(np.prod(shape))
        if name not in self.held or len(self.held[name]) < size:
            self.held[name] = np.empty(size, np.float32)
        return self.held[name][:size].reshape(shape)


class Network:
    def __init__(self, vocabulary: np.ndarray, seed: int = 11) -> None:
        r, h, d = np.random.default_rng(seed), _HIDDEN, _WORD + _CHAR
        init = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.vocabulary = vocabulary  # sorted hashes; row 0 of the word vectors stands for all other words
        self.p = {"word": 0.1 * r.standard_normal((len(vocabulary) + 1, _WORD)).astype(np.float32),
                  "char": 0.1 * r.standard_normal((_GRAMS, _CHAR)).astype(np.float32),
                  "att": init(2 * h, h), "att_v": init(h, 1)[:, 0], "out": init(2 * h, 1)[:, 0], "bias": np.zeros(1, np.float32)}
        self.p["word"][0] = 0
        for side in "fb":
            self.p |= {f"x{side}": init(d, 3 * h), f"c{side}": np.zeros(3 * h, np.float32), f"u{side}": init(h, 2 * h), f"n{side}": init(h, h)}
        self.slope, self.shift = 1.0, 0.0

    def inputs(self, words: Words) -> np.ndarray:
        at = np.searchsorted(self.vocabulary, words.hash)
        known = at < len(self.vocabulary)
        known[known] = self.vocabulary[at[known]] == words.hash[known]
        self.rows = np.where(known, at + 1, 0)
        chars = np.zeros((len(words.hash), _CHAR), np.float32)
        for a in range(0, len(chars), _AT_ONCE):  # the vectors of all runs together would be large
            edge = words.bounds[a : a + _AT_ONCE + 1]
            chars[a : a + _AT_ONCE] = np.add.reduceat(self.p["char"][words.gram[edge[0] : edge[-1]]], edge[:-1] - edge[0], axis=0) / words.size[a : a + _AT_ONCE, None]
        return np.concatenate([self.p["word"][self.rows], chars], axis=1).astype(np.float32)

    def _run(self, x: np.ndarray, live: np.ndarray, side: str, keep: list | None) -> np.ndarray:
        """Hidden states (windows, WINDOW, h) for projected inputs x (windows, WINDOW, 3h).

        Gates are 0.5 + 0.5 tanh(x), the logistic function of 2x without its exponential.
        """
        u, un, h = self.p[f"u{side}"], self.p[f"n{side}"], _HIDDEN
        state, out = np.zeros((len(x), h), np.float32), np.empty((len(x), WINDOW, h), np.float32)
        for t in range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1):
            gates = 0.5 + 0.5 * np.tanh(x[:, t, : 2 * h] + state @ u)
            z, r = gates[:, :h], gates[:, h:]
            own = state @ un
            n = np.tanh(x[:, t, 2 * h :] + r * own)
            new = np.where(live[:, t, None], n + z * (state - n), state)
            if keep is not None:
                keep.append((t, state, z, r, own, n))
            out[:, t] = state = new
        return out

    def forward(self, projected: dict[str, np.ndarray], index: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows; index: distinct word at each place, -1 for none."""
        live = index >= 0
        kept = {s: [] for s in "fb"} if keep is not None else {"f": None, "b": None}
        states = np.concatenate([self._run(projected[s][index], live, s, kept[s]) for s in "fb"], axis=2)
        hidden = np.tanh(states @ self.p["att"])
        weight = np.where(live, hidden @ self.p["att_v"], -1e9)
        weight = np.exp(weight - weight.max(axis=1, keepdims=True))
        weight /= weight.sum(axis=1, keepdims=True)
        pooled = np.einsum("wt,wth->wh", weight, states)
        if keep is not None:
            keep |= {"kept": kept, "states": states, "hidden": hidden, "weight": weight, "pooled": pooled, "live": live}
        return pooled @ self.p["out"] + self.p["bias"][0]

    def project(self, inputs: np.ndarray) -> dict[str, np.ndarray]:
        return {s: inputs @ self.p[f"x{s}"] + self.p[f"c{s}"] for s in "fb"}

    def gradients(self, inputs: np.ndarray, index: np.ndarray, error: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters and of the inputs, given d loss / d logit of every window."""
        k, h, g = self.kept, _HIDDEN, {}
        states, hidden, weight, live = k["states"], k["hidden"], k["weight"], k["live"]
        g["out"], g["bias"] = error @ k["pooled"], np.array([error.sum()], np.float32)
        d_pooled = error[:, None] * self.p["out"]
        d_states = weight[:, :, None] * d_pooled[:, None, :]
        d_weight = np.einsum("wh,wth->wt", d_pooled, states)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=1, keepdims=True))
        g["att_v"] = np.einsum("wt,wth->h", d_score, hidden)
        d_hidden = d_score[:, :, None] * self.p["att_v"] * (1 - hidden**2)
        g["att"] = np.einsum("wti,wth->ih", states, d_hidden)
        d_states = d_states + d_hidden @ self.p["att"].T
        d_inputs = np.zeros_like(inputs)
        flat = index.reshape(-1)
        some = flat >= 0
        for s, part in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            u, un = self.p[f"u{s}"], self.p[f"n{s}"]
            gu, gn, dx = np.zeros_like(u), np.zeros_like(un), np.zeros((*index.shape, 3 * h), np.float32)
            d_state = np.zeros((len(index), h), np.float32)
            for t, before, z, r, own, n in reversed(k["kept"][s]):
                d = d_state + d_states[:, t, part]
                here = live[:, t, None]
                d_live = np.where(here, d, 0)
                d_n = d_live * (1 - z) * (1 - n**2)
                d_gates = 2 * np.concatenate([d_live * (before - n) * z * (1 - z), d_n * own * r * (1 - r)], axis=1)
                d_own = d_n * r
                d_state = np.where(here, d_live * z, d) + d_gates @ u.T + d_own @ un.T
                gu += before.T @ d_gates
                gn += before.T @ d_own
                dx[:, t] = np.concatenate([d_gates, d_n], axis=1)
            g[f"u{s}"], g[f"n{s}"] = gu, gn
            dx = dx.reshape(-1, 3 * h)[some]
            g[f"x{s}"], g[f"c{s}"] = inputs[flat[some]].T @ dx, dx.sum(axis=0)
            back = dx @ self.p[f"x{s}"].T
            for j in range(inputs.shape[1]):
                d_inputs[:, j] += np.bincount(flat[some], back[:, j], len(inputs))
        return g, d_inputs

    def train(self, words: Words, index: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int, rate: float, seed: int,
              dropped: float = 0.3, decay: float = 0.02) -> None:
        rng, moments = np.random.default_rng(seed), {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(index))
            for a in range(0, len(order), 512):
                rows = order[a : a + 512]
                used, local = np.unique(index[rows], return_inverse=True)
                local = local.reshape(len(rows), WINDOW) - (used[0] < 0)
                used = used[used >= 0]
                part = _Subset(words, used)
                inputs = self.inputs(part)
                hidden = rng.random(len(used)) < dropped  # so that stems are learned beside whole words
                inputs[hidden, :_WORD], self.rows[hidden] = 0, 0
                self.kept = {}
                p = _sigmoid(self.forward(self.project(inputs), local, self.kept))
                g, d_inputs = self.gradients(inputs, local, (weight[rows] * (p - y[rows]) / weight[rows].sum()).astype(np.float32))
                g["word"] = np.zeros_like(self.p["word"])
                _add_rows(g["word"], self.rows, d_inputs[:, :_WORD])
                g["word"][0] = 0
                g["char"] = np.zeros_like(self.p["char"])
                _add_rows(g["char"], part.gram, (d_inputs[:, _WORD:] / part.size[:, None])[part.owner])
                step += 1
                for name, grad in g.items():
                    m, v = moments[name]
                    m += 0.1 * (grad - m)
                    v += 0.01 * (grad * grad - v)
                    if name in ("word", "char"):
                        self.p[name] *= 1 - rate * decay
                    self.p[name] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        self.kept = {}

    def logits(self, words: Words, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logit and text of every window, and the words at its places."""
        places, doc = words.windows(n_docs)
        index = np.where(places >= 0, words.at[places], -1) if len(words.at) else places
        projected = self.project(self.inputs(words))
        got = [self.forward(projected, index[a : a + 2048]) for a in range(0, len(index), 2048)]
        return np.concatenate([np.zeros(0, np.float32), *got]), doc, index

    @staticmethod
    def _scaled() -> np.ndarray:
        """Factors per projected feature: a gate 0.5 + 0.5 tanh(x) is 1 / (1 + exp(-2x)), a tanh(x) is 1 - 2 / (1 + exp(2x))."""
        return np.repeat(np.array([-2, 2], np.float32), [2 * _HIDDEN, _HIDDEN])

    def _first_states(self, both: np.ndarray) -> np.ndarray:
        """State after one step from scaled inputs (words, 6h): it depends on the word alone."""
        h = _HIDDEN
        gates = 1 / (1 + np.exp(both.reshape(len(both), 2, 3 * h)))
        return ((1 - gates[:, :, :h]) * (1 - 2 * gates[:, :, 2 * h :])).reshape(len(both), 2 * h)

    def _slide(self, x: np.ndarray, space: _Space | None = None) -> np.ndarray:
        """Logits of the windows that start at each place of x (8h, places), but for the last WINDOW - 1.

        The same network as ``forward``, laid out feature by feature: a step reads one slice of x for all windows at once,
        both directions go together, and gates are formed in place. Rows of x: the scaled inputs of both directions, then
        the states after a first step. States are kept less 1, as tanh(x) - 1 is -2 / (1 + exp(2x)); a row of ones brings it back.
        """
        h, m, held = _HIDDEN, x.shape[1] - WINDOW + 1, space or _Space()
        weight = self._scaled()[:, None] * np.stack([np.concatenate([self.p[f"u{s}"], self.p[f"n{s}"]], axis=1).T for s in "fb"])
        weight = np.concatenate([weight, weight.sum(axis=2, keepdims=True)], axis=2)
        states, sums = held.get("states", WINDOW, 2, h, m), held.get("sums", 2, 3 * h, m)
        state, gates, n = held.get("state", 2, h + 1, m), held.get("gates", 2, 2 * h, m), held.get("n", 2, h, m)  # exp is faster out of place
        low, zr, own, z, r = state[:, :h], sums[:, : 2 * h], sums[:, 2 * h :], gates[:, :h], gates[:, h:]
        state[:, h] = 1
        np.subtract(x[6 * h : 7 * h, :m], 1, out=low[0])
        np.subtract(x[7 * h :, WINDOW - 1 :], 1, out=low[1])
        states[0, 0], states[WINDOW - 1, 1] = low[0], low[1]
        for t in range(1, WINDOW):
            back = WINDOW - 1 - t
            ahead = x[: 3 * h, t : t + m], x[3 * h : 6 * h, back : back + m]
            np.matmul(weight, state, out=sums)
            for side in (0, 1):
                zr[side] += ahead[side][: 2 * h]
            np.exp(zr, out=gates)
            gates += 1  # gates are kept as their reciprocals
            own /= r
            for side in (0, 1):
                own[side] += ahead[side][2 * h :]
            np.exp(own, out=n)
            n += 1
            np.divide(-2, n, out=n)
            low -= n
            low /= z
            low += n
            states[t, 0], states[back, 1] = low[0], low[1]
        flat, att = states.reshape(WINDOW, 2 * h, m), 2 * self.p["att"].T
        sums = np.matmul(att, flat, out=held.get("hidden", WINDOW, h, m))
        sums += att.sum(axis=1)[:, None]
        hidden = np.exp(sums, out=held.get("exps", WINDOW, h, m))
        hidden += 1
        np.reciprocal(hidden, out=hidden)
        share = np.matmul(-2 * self.p["att_v"], hidden, out=held.get("share", WINDOW, m))  # but for a constant, which shares do not see
        share -= share.max(axis=0)
        np.exp(share, out=share)
        told = np.matmul(self.p["out"], flat, out=held.get("told", WINDOW, m))
        told *= share
        return told.sum(axis=0) / share.sum(axis=0) + (self.p["out"].sum() + self.p["bias"][0])

    def largest(self, words: Words, n_docs: int) -> np.ndarray:
        """Largest logit over all windows of every text; windows are laid out some at a time."""
        best, projected = np.full(n_docs, _EMPTY), self.project(self.inputs(words))
        first, left, doc = words.starts(n_docs, 1)
        slides = np.bincount(words.doc, minlength=n_docs)[doc] >= _LONG
        rest = np.flatnonzero(~slides)
        for a in range(0, len(rest), 2048):
            rows = rest[a : a + 2048]
            places = _places(first[rows], left[rows])
            np.maximum.at(best, doc[rows], self.forward(projected, np.where(places >= 0, words.at[places], -1)))
        first, doc = first[slides], doc[slides]  # each of these windows is full
        both = np.concatenate([projected["f"], projected["b"]], axis=1) * np.tile(self._scaled(), 2)
        a, space = 0, _Space()
        with np.errstate(over="ignore"):  # 1 / (1 + inf) is the gate's limit
            both = np.concatenate([both, self._first_states(both)], axis=1)
            while a < len(first):
                b = int(np.searchsorted(first, first[a] + _SLIDE))
                x = np.ascontiguousarray(both[words.at[first[a] : first[b - 1] + WINDOW]].T)
                heads = a + np.flatnonzero(np.diff(doc[a:b], prepend=-1))  # windows of a text stand together
                tops = np.maximum.reduceat(self._slide(x, space)[first[a:b] - first[a]], heads - a)
                best[doc[heads]] = np.maximum(best[doc[heads]], tops)
                a = b
        return best

    def score(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Score of every text, 0 to 1."""
        n = len(bounds) - 1
        best = self.largest(Words(data, bounds), n) if len(data) else np.full(n, _EMPTY)
        return _sigmoid(self.slope * best + self.shift)


class _Subset:
    """Some of the distinct words of a Words object."""

    def __init__(self, words: Words, used: np.ndarray) -> None:
        self.hash, self.size = words.hash[used], words.size[used]
        self.bounds = np.concatenate([[0], np.cumsum(self.size)])
        self.owner = np.repeat(np.arange(len(used)), self.size)
        self.gram = words.gram[words.bounds[used][self.owner] + np.arange(self.bounds[-1]) - self.bounds[self.owner]]


def train(texts: list[str], labels: np.ndarray, least_texts: int = 4, windows_per_text: int = 48, hard_windows: int = 4000,
          clean_windows: int = 20_000, turns: int = 3, seed: int = 11) -> Network | None:
    """A network from texts and labels 0/1; None unless both occur.

    Bounds of the fit: ``windows_per_text`` is what one text adds at first; each of the ``turns`` then takes the highest windows of
    toxic texts, the ``hard_windows`` highest clean ones (twice the toxic ones if more) and ``clean_windows`` drawn ones.
    """
    labels = np.asarray(labels, float)
    if len(set(labels.tolist())) < 2:
        return None
    data, bounds = ta.utf8(pa.array(texts, pa.large_string()))
    words, n = Words(data, bounds), len(texts)
    seen = np.unique(words.doc * len(words.hash) + words.at) % max(1, len(words.hash))
    often = np.bincount(seen, minlength=len(words.hash)) >= least_texts
    net = Network(words.hash[often], seed)
    places, doc = words.windows(n)
    index = np.where(places >= 0, words.at[places], -1)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(doc))
    order = order[np.argsort(doc[order], kind="stable")]
    nth = np.arange(len(order)) - np.searchsorted(doc[order], doc[order])
    sample = order[nth < windows_per_text]
    y = labels[doc[sample]]
    weight = np.where(y == 1, (y == 0).sum() / max(1, y.sum()), 1.0)
    net.train(words, index[sample], y, np.minimum(weight, 20), epochs=3, rate=0.01, seed=seed)
    for turn in range(turns):
        logit, _, _ = net.logits(words, n)
        top = np.full(n, _EMPTY)
        np.maximum.at(top, doc, logit)
        clear = labels[doc] == 1
        positive = np.flatnonzero(clear & (logit >= np.maximum(top[doc] - 1.0, 0.5 * top[doc])))
        clean = np.flatnonzero(~clear)
        hard = clean[np.argsort(-logit[clean], kind="stable")[: max(hard_windows, 2 * len(positive))]]
        negative = np.concatenate([hard, rng.choice(clean, min(len(clean), clean_windows), replace=False)])
        rows = np.concatenate([positive, negative])
        y = labels[doc[rows]]
        weight = np.where(y == 1, (y == 0).sum() / max(1, y.sum()), 1.0)
        net.train(words, index[rows], y, np.minimum(weight, 20), epochs=2, rate=0.005, seed=seed + 1 + turn)
    top = net.largest(words, n)
    slope, shift = 1.0, 0.0
    x = np.clip(top, _EMPTY, -_EMPTY)
    for _ in range(200):  # logistic calibration, damped Newton steps
        p = _sigmoid(slope * x + shift)
        w, e = p * (1 - p) + 1e-3, p - labels
        a, b, c = (w * x * x).sum() + 1.0, (w * x).sum(), w.sum()
        ga, gb = (e * x).sum() + (slope - 1.0), e.sum()
        det = a * c - b * b
        slope, shift = max(0.1, slope - 0.5 * (c * ga - b * gb) / det), shift - 0.5 * (a * gb - b * ga) / det
    net.slope, net.shift = float(slope), float(shift)
    return net


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
        toxic_texts: int = 700, clean_texts: int = 2000) -> Network | None:
    """Learn from about so many texts of each label whose id is not held out (the bounds of the sample).

    The sample is fitted in one task, so its arrays do not stand beside the driver's own; only the network comes back.
    """
    known = labels.where((remainder(id_col) != 1) & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).alias(label_col))
    sample = labelled_rows(docs.where(remainder(id_col) != 1), known, label_col, {1: toxic_texts, 0: clean_texts}, id_col, text_col)
    if sample is None:
        return None

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"_label": [], "text": []}), *batches])
        yield pd.DataFrame({"net": [pickle.dumps(train(rows["text"].tolist(), rows["_label"].to_numpy(float)))]})

    got = sample.repartition(1).sortWithinPartitions(*order()).mapInPandas(learn, "net binary").collect()
    return pickle.loads(got[0]["net"]) if got else None


def score(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text", carried: list[str] | None = None,
          score_col: str = "tox_score") -> DataFrame:
    """``id_col`` (or ``carried`` columns) and ``score_col`` of every row. A map, no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(net)
    kept = [id_col] if carried is None else list(carried)
    cols = kept if text_col in kept else [*kept, text_col]  # the text travels once
    at = cols.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for batch in ta.rows(batches):
            got = np.zeros(batch.num_rows)
            if net is not None and batch.num_rows:
                got = np.concatenate(ta.per_span(net.score, batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(got)], [*kept, score_col])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.select(*cols).mapInArrow(run, f"{schema}, {score_col} double")


def toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
             toxic_texts: int = 700, clean_texts: int = 2000, threshold: float = 0.7) -> DataFrame:
    """id, held_out, score, predicted of every row, by a network fitted on labelled rows that are not held out."""
    net = fit(docs, labels, label_col, id_col, text_col, toxic_texts, clean_texts)
    return score(docs, net, id_col, text_col).select(
        id_col, (remainder(id_col) == 1).alias("held_out"), F.col("tox_score").alias("score"),
        (F.col("tox_score") >= threshold).cast("int").alias("predicted"))
