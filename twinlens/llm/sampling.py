"""Bounded, repeatable samples of labelled rows for fitting."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str) -> Column:
    """crc32 of the id as text, modulo 3; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3


def order() -> list[Column]:
    """In which order sampled rows are learned from."""
    return [F.xxhash64("text"), F.col("_label")]


def labelled_texts(docs: DataFrame, *given, **named) -> pd.DataFrame:
    """The rows of ``labelled_rows`` in one order, for fitting on the driver."""
    rows = labelled_rows(docs, *given, **named)
    return pd.DataFrame({"_label": [], "text": []}) if rows is None else rows.orderBy(*order()).toPandas()


def labelled_rows(docs: DataFrame, labels: DataFrame | None, label_col: str, per_label: int | dict, id_col: str = "doc_id",
                  text_col: str = "text", most_labels: int = 1000, most_bytes: int = 8_000_000, longest: int = 1_000_000) -> DataFrame | None:
    """About ``per_label`` different (_label, text) rows of each label (a number, or one per label), for fitting; None without any.

    Without ``labels`` text and label stand in the same row of ``docs``; else ``labels`` has (id_col, label_col), an id counts
    once, with its largest label, and labels all rows of that id. Texts are kept where a hash of them falls below the share
    that gives ``per_label`` rows and at most ``most_bytes`` bytes a label, and copies once, so the sample is the same on every
    run and its size follows from these parameters, not from the data. Texts over ``longest`` bytes are not learned from.
    """
    wanted = lambda value: per_label[value] if isinstance(per_label, dict) else per_label

    def place(*of) -> Column:
        return F.pmod(F.xxhash64(F.lit("sample"), *of), F.lit(1_000_003)) / 1_000_003.0

    def thinned(rows: DataFrame, shares: dict, *of) -> DataFrame:
        keep = F.lit(False)
        for value, share in shares.items():
            keep = keep | ((F.col("_label") == value) & (place(*of) < share))
        return rows.where(keep)

    texts = docs.where(F.col(text_col).isNotNull() & (F.octet_length(text_col) <= longest))
    if labels is None:
        rows = texts.where(F.col(label_col).isNotNull()).select(F.col(label_col).alias("_label"), F.col(text_col).alias("text"))
    else:
        marks = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_label")))
        counts = {r["_label"]: r["count"] for r in marks.groupBy("_label").count().limit(most_labels + 1).collect()}
        chosen = thinned(marks, {v: wanted(v) / n for v, n in counts.items()}, "_id")  # different ids, bounded by per_label * labels
        rows = texts.join(F.broadcast(chosen), texts[id_col] == chosen["_id"]).select("_label", F.col(text_col).alias("text"))
    sizes = rows.groupBy("_label").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).limit(most_labels + 1).collect()
    if not sizes:
        return None
    if len(sizes) > most_labels:
        raise ValueError(f"more than {most_labels} labels")
    shares = {r["_label"]: min(wanted(r["_label"]) / r["n"], most_bytes / max(1, r["b"])) for r in sizes}
    return thinned(rows, shares, "text").dropDuplicates(["_label", "text"])
