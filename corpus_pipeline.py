"""A training corpus from raw documents: filter, drop near copies, cut repeated passages, pack into sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of ``documents``. Null and empty texts pass the toxicity stage and go in
the language stage, which keeps only texts with a letter; repeated rows are near copies of each other and one stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlens.llm import bwt_dedup, language, lsh_forest, packing, toxicity
from twinlens.session import materialize

TOXIC_SCORE = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below TOXIC_SCORE; the network learns from ``labels``."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    net = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, net, carried=docs.columns, score_col="__toxicity")
    return scored.where(F.col("__toxicity") < TOXIC_SCORE).select(*docs.columns)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those without any letter go, whether or not a label could be learned."""
    model = language.fit(docs)
    named = language.predict(docs, model, carried=docs.columns, lang_out="__language", score_out="__score", letter_out="__letter")
    return named.where("__letter").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id (a null id after all others) of each group of near copies."""
    found = lsh_forest.near_duplicates(docs, keyed=True)
    first = found.where(F.col("row_key") == F.col("first_key")).select(F.col("doc_id").alias("__first"), F.col("row_key").alias("__key")).distinct()
    kept = docs.join(first, docs["doc_id"].eqNullSafe(first["__first"]) & (lsh_forest.row_key() == first["__key"]), "left_semi")
    if not docs.groupBy("doc_id").count().where(F.col("count") > 1).isEmpty():
        kept = kept.dropDuplicates(["doc_id", "text"])  # rows that repeat an id and its text
    return kept


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of passages that also start in a smaller document."""
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    cut = bwt_dedup.remove_repeats(docs, carried=others, as_text=True, names=("__n_bytes", "__kept", "__spans"))
    new = {"text": F.col("__kept"), "n_chars": F.char_length("__kept").cast("long")}
    return cut.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in a sequence of at most 4096 tokens."""
    return packing.pack(materialize(packing.tokenize(docs, public_tokenizers.path("word_bpe_49k.json"))))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("best_fit_packing", pack_sequences),
]
#: The trained stages cannot be told in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
