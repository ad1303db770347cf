"""Licence scan: an Aho-Corasick automaton finds phrases and identifier tags, a shunting-yard parser reads expressions.

Words are runs of ASCII letters, digits and non-ASCII characters; A-Z is lower-cased. Phrases match where their words
stand consecutively. After an ``SPDX-License-Identifier`` tag the rest of the line is read as a licence expression with
``and``, ``or``, ``with``, ``+`` and parentheses; a malformed one adds nothing.

Results for odd input: null and empty texts have zero words, empty labels, null positions and score 0; repeated rows give
repeated results; other columns of the input are ignored; very long texts are scanned whole, text by text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# The base phrases and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Notice phrases of well-known licences, as words.
NOTICES = {
    "mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license": "apache-2",
    "www apache org licenses license 2 0": "apache-2",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0": "cc0",
    "gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "bsd 2 clause": "bsd-2",
    "bsd 3 clause": "bsd-3",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "all-rights-reserved",
}
# Identifiers in expressions (lower case) and their labels; others keep their own name.
IDENTIFIERS = {
    "mit": "mit", "apache-2.0": "apache-2", "cc-by-nc-4.0": "cc-by-nc", "cc-by-sa-4.0": "cc-by-sa", "cc0-1.0": "cc0",
    "gpl-2.0-only": "gpl-2", "gpl-2.0-or-later": "gpl-2", "gpl-3.0-only": "gpl-3", "gpl-3.0-or-later": "gpl-3",
    "bsd-2-clause": "bsd-2", "bsd-3-clause": "bsd-3", "mpl-2.0": "mpl", "unlicense": "unlicense",
}
PERMISSIVE = frozenset({"mit", "apache-2", "bsd", "bsd-2", "bsd-3", "cc0", "unlicense"})
TAG = "spdx license identifier"

_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_TAG_LINE = re.compile(rb"spdx[^0-9a-z\n]license[^0-9a-z\n]identifier[ \t]*:?[ \t]*([^\n\r]*)", re.I)
_TOKEN = re.compile(r"\(|\)|\+|[0-9a-z.:\-]+")
_RANK = {"or": 1, "and": 2, "with": 3}

SCHEMA = """{id} {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string,
            labels string, permissive boolean, expressions array<string>, score double"""


def postfix(text: str) -> list[str] | None:
    """The expression in postfix order (shunting-yard); None when it is malformed."""
    out, stack, operand = [], [], True
    for token in _TOKEN.findall(text.lower()):
        if token in _RANK:
            if operand:
                return None
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[token]:
                out.append(stack.pop())
            stack.append(token)
            operand = True
        elif token == "(":
            if not operand:
                return None
            stack.append(token)
        elif token == ")":
            if operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif token == "+":
            if operand:
                return None
        else:
            if not operand:
                break  # prose after the expression
            out.append(token)
            operand = False
    if operand or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(text: str) -> tuple[set[str], bool] | None:
    """Labels of an expression, and whether permissive terms satisfy it (``or``: one side does; ``and``: both do)."""
    order = postfix(text)
    if not order:
        return None
    stack: list[tuple[set[str], bool]] = []
    for token in order:
        if token in _RANK:
            (b, b_free), (a, a_free) = stack.pop(), stack.pop()
            stack.append((a, a_free) if token == "with" else (a | b, a_free or b_free if token == "or" else a_free and b_free))
        else:
            label = IDENTIFIERS.get(token, token)
            stack.append(({label}, label in PERMISSIVE))
    return stack[0]


def automaton(base: dict[str, str], notices: dict[str, str]) -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for phrase in {*base, *notices, TAG}:
        auto.add_word(f" {phrase} ", (len(phrase) + 2, base.get(phrase), notices.get(phrase), phrase == TAG))
    auto.make_automaton()
    return auto


def scan_text(raw: bytes, auto: ahocorasick.Automaton) -> tuple:
    """n_words, n_base, first, last, base labels, labels, permissive, expressions, score of one text."""
    words = raw.translate(_WORD_BYTES).split()
    if not words:
        return 0, 0, None, None, "", "", None, [], 0.0
    line = b" ".join([b"", *words, b""])
    hits = list(auto.iter(line.decode("latin-1")))  # one character a byte: positions are byte positions
    if not hits:
        return len(words), 0, None, None, "", "", None, [], 0.0
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts, base, more, tagged = [], set(), set(), False
    for end, (length, of_base, of_notice, tag) in hits:
        if of_base:
            starts.append(int(np.searchsorted(gaps, end - length + 1)))
            base.add(of_base)
        if of_notice:
            more.add(of_notice)
        tagged |= tag
    read, free = [], None
    if tagged:
        for found in _TAG_LINE.findall(raw):
            text = found.decode("utf-8", "replace").strip()
            value = evaluate(text)
            if value:
                read.append(text)
                more |= value[0]
                free = value[1] if free is None else free and value[1]
    labels = base | more
    if free is None and labels:
        free = labels <= PERMISSIVE
    score = 1.0 if base or read else 0.8 if more else 0.0
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
            ",".join(sorted(labels)), free, read, score)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 base: dict[str, str] = BASE_PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """One row per row of ``docs``: words, base phrases (count, first and last word), labels, expressions, score.

    ``permissive`` is null without any label. A map over texts, no shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(base, notices)
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            got = [scan_text(t.as_py() or b"", auto) for t in texts]
            cols = list(zip(*got)) or [()] * 9
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.float64()]
            arrays = [batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))]
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = SCHEMA.format(id=f"`{id_col}`", kind=kind)
    names = [id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "permissive", "expressions", "score"]
    return docs.select(id_col, text_col).mapInArrow(scan, schema)
