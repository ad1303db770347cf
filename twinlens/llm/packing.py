"""Best-fit packing of documents into sequences: tokens, documents and attention cost are the capacities of a bin.

Documents are tokenised and cut where they are longer than a sequence; whole sequences need no packing. The rest is dealt
at random into groups of a fixed size; inside a group pieces go, longest first, to the bin that fits best under every
constraint. What a group leaves in bins that are not nearly full is packed again across groups, so the share of
sequences lost to group borders shrinks from round to round.

Results for odd input: a null or empty text is a document of its end mark alone; repeated rows are packed each by
itself; strings of the tokenizer's added tokens get their ids, as in the library; other columns are ignored; texts of any length are
read whole; an empty table gives no pieces.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.llm import textarrays as ta
from twinlens.session import materialize

_KEPT_WORDS = 800_000
_LETTER, _PUNCTUATION = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[97:123] = True
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_FOUR_BYTES = partial(array, "I" if array("I").itemsize == 4 else "L")
_OPEN: dict[int, tuple] = {}


def _tokenizer(file: bytes) -> tuple:
    """The tokenizer and its table of encoded words, one per worker."""
    key = hash(file)
    if key not in _OPEN:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        tok = Tokenizer.from_buffer(file)
        added = tok.get_added_tokens_decoder()
        if any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in added.values()):
            raise ValueError("only added tokens that are matched as they stand are known")
        marks = {t.content.encode(): _FOUR_BYTES([i]).tobytes() for i, t in added.items()}
        tok.encode_special_tokens = True  # texts are split at the marks before words are encoded
        _OPEN[key] = (tok, {}, marks, re.compile(b"(" + b"|".join(map(re.escape, sorted(marks, key=len, reverse=True))) + b")") if marks else None)
    return _OPEN[key]


def spread(text: bytes) -> bytes:
    """A-Z lower-cased, and a blank set before ASCII punctuation that follows a letter of a-z or of Latin-1.

    The vocabulary folds case, ends its letter runs there and drops blanks, so ids stay the same; the words that remain
    are fewer and shorter.
    """
    data = np.frombuffer(text.lower(), np.uint8)
    latin = np.zeros(len(data), bool)
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    cut = np.flatnonzero((_LETTER[data[:-1]] | latin[:-1]) & _PUNCTUATION[data[1:]]) + 1 if len(data) else []
    return np.insert(data, cut, 32).tobytes() if len(cut) else data.tobytes()


def _words(text: bytes, marks: dict[bytes, bytes], pattern: re.Pattern | None) -> list:
    """Words to encode, and the marks of added tokens as one-tuples."""
    if not any(m in text for m in marks):
        return spread(text).split()
    return [w for part in pattern.split(text) for w in ([(part,)] if part in marks else spread(part).split())]


def token_ids(texts: list[bytes], file: bytes) -> list[bytes]:
    """Ids of each text as little-endian 32-bit integers.

    Strings of added tokens get their ids, as in the library. The vocabulary drops white space and never joins across it,
    so words between ASCII white space are encoded one by one; those met before come from the table.
    """
    tok, kept, marks, pattern = _tokenizer(file)
    split = [_words(t, marks, pattern) for t in texts]
    new = set().union(*split).difference(kept, ((m,) for m in marks))
    if new:
        if len(kept) + len(new) > _KEPT_WORDS:
            kept.clear()
            new = set().union(*split).difference((m,) for m in marks)
        new = list(new)
        for a in range(0, len(new), 4096):
            part = new[a : a + 4096]
            got = tok.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
            kept.update((w, _FOUR_BYTES(e.ids).tobytes()) for w, e in zip(part, got))
    kept.update(((m,), ids) for m, ids in marks.items())
    return [b"".join(map(kept.__getitem__, s)) for s in split]


def tokenize(docs: DataFrame, tokenizer_file: str, end_id: int = 1, most_tokens: int = 4096, id_col: str = "doc_id",
             text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: ``id_col``, piece, start, length, ids_crc32 and, if asked for, ids. A map, no shuffle."""
    with open(tokenizer_file, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    end, step = np.array([end_id], "<u4").tobytes(), 4 * most_tokens
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ta.rows(batches, 512):
            texts = [t or b"" for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
            at, out = [], []
            for k, ids in enumerate(token_ids(texts, sent.value)):
                ids += end
                for i, a in enumerate(range(0, len(ids), step)):
                    part = ids[a : a + step]
                    at.append(k)
                    out.append((i, a // 4, len(part) // 4, zlib.crc32(part), np.frombuffer(part, "<i4") if keep_ids else None))
            cols = list(zip(*out)) or [()] * 5
            arrays = [batch.column(0).take(pa.array(at, pa.int32())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:4])]
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                arrays.append(pa.array(cols[4], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def best_fit(sizes: np.ndarray, capacity: np.ndarray, rule: str = "dot", weights: np.ndarray | None = None) -> np.ndarray:
    """Bin of each item, items as rows of demands, longest first; bins count from 0.

    Among the bins that can hold an item under every capacity, ``dot`` takes the one with the least weighted dot product of
    relative demand and relative residual (what is left lines up least with the item: the tightest fit), ``norm`` the
    one whose weighted residual after the item is shortest.
    """
    n, dims = sizes.shape
    weights = np.array([1.0, 1e-3, 1e-3][:dims]) if weights is None else np.asarray(weights, float)
    share = np.ascontiguousarray((sizes / capacity).T)
    least = share.min(axis=1, initial=1.0) - 1e-12
    order = np.lexsort((np.arange(n), -sizes[:, 0]))
    left, name, out = np.ones((dims, n)), np.zeros(n, np.int64), np.zeros(n, np.int64)
    opened = bins = 0  # bins that may still take something stand first in left and name
    for k, item in enumerate(order):
        need = share[:, item]
        if k % 256 == 255:  # bins that cannot hold even the smallest item
            kept = np.flatnonzero((left[:, :opened] >= least[:, None]).all(axis=0))
            opened = len(kept)
            left[:, :opened], name[:opened] = left[:, kept], name[kept]
        fits = left[0, :opened] >= need[0] - 1e-12
        for j in range(1, dims):
            fits &= left[j, :opened] >= need[j] - 1e-12
        at = np.flatnonzero(fits)
        if len(at):
            have = left[:, at]
            cost = (weights * need) @ have if rule == "dot" else weights @ np.square(have - need[:, None])
            best = at[cost.argmin()]
        else:
            best, opened, bins = opened, opened + 1, bins + 1
            left[:, best], name[best] = 1.0, bins - 1
        left[:, best] -= need
        out[item] = name[best]
    return out


def pack(pieces: DataFrame, most_tokens: int = 4096, most_documents: int = 4096, most_attention: int | None = None,
         group_rows: int = 8192, rounds: int = 2, full_share: float = 0.995, rule: str = "dot", id_col: str = "doc_id") -> DataFrame:
    """``pieces`` (id_col, piece, length, ...) with sequence_id and offset.

    ``most_attention`` bounds the sum of squared lengths (default: no tighter than the tokens). ``pieces`` should be
    written, since its rows are counted before they are packed. Rows are dealt into groups one by one, equal rows too.
    """
    attention = most_attention or most_tokens**2
    capacity = np.array([most_tokens, most_documents, attention], float)
    names = pieces.columns
    order = [id_col, "piece", "start", "ids_crc32"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    n_groups = lambda df: max(1, -(-df.count() // group_rows))

    def packer(last: bool, number: int):
        def run(group: pa.Table) -> pa.Table:
            group = group.sort_by([(c, "ascending") for c in order])
            size = group.column("length").to_numpy().astype(float)
            bins, cut = np.zeros(len(size), np.int64), size < most_tokens
            bins[cut] = best_fit(np.stack([size, np.ones(len(size)), size**2], axis=1)[cut], capacity, rule)
            bins[~cut] = bins.max(initial=0) + 1 + np.arange((~cut).sum())  # whole sequences stand alone
            used = np.bincount(bins, size)
            number_of = np.flatnonzero((used >= full_share * most_tokens) | last)
            new = np.full(len(used), -1)
            new[number_of] = np.arange(len(number_of))
            by_bin = np.lexsort((np.arange(len(bins)), bins))
            sums = np.cumsum(size[by_bin]) - size[by_bin]
            heads = np.concatenate([[True], bins[by_bin][1:] != bins[by_bin][:-1]])
            offset = np.zeros(len(bins), np.int64)
            offset[by_bin] = (sums - np.repeat(sums[heads], np.diff(np.append(np.flatnonzero(heads), len(bins))))).astype(np.int64)
            where = np.where(new[bins] < 0, -1, (new[bins] << 24 | group.column("_group").to_numpy().astype(np.int64)) * 8 + number)
            return group.drop(["_group"]).append_column("sequence_id", pa.array(where, pa.int64())).append_column("offset", pa.array(offset))

        return run

    out, rest = [], pieces
    for k in range(rounds):
        groups, last = n_groups(rest), k == rounds - 1
        dealt = rest.withColumn("_group", F.pmod(F.xxhash64(F.lit(k), F.monotonically_increasing_id()), F.lit(groups)).cast("int"))
        done = materialize(dealt.groupBy("_group").applyInArrow(packer(last or groups == 1, k), f"{schema}, sequence_id long, offset long"))
        out.append(done.where(F.col("sequence_id") >= 0))
        if groups == 1:
            break
        rest = done.where(F.col("sequence_id") < 0).select(*names)
    packed = out[0]
    for part in out[1:]:
        packed = packed.unionByName(part)
    return packed
