"""One registered query per operator, over its whole table; digest columns are derived from the operators' outputs."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlens.llm import bit_sliced, bwt_dedup, byte_bpe, language, licenses, lsh_forest, packing, quality, simhash_trie, threshold_mining, toxicity, url_rules, vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _id_digests(tokens: DataFrame, ranks: str) -> DataFrame:
    """Lengths and digests of id lists and of the bytes they decode to."""
    sent = tokens.sparkSession.sparkContext.broadcast(byte_bpe._read(ranks))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = byte_bpe.vocabulary(sent.value)
        for batch in batches:
            ids = byte_bpe.id_lists(batch.column(1))
            hexes = [[hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], [hashlib.sha256(vocab.decode(x)).hexdigest() for x in ids]]
            n = pa.array(np.array([len(x) for x in ids], np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), n, *map(pa.array, hexes)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return tokens.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return _id_digests(byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)


@query
def op2_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_sliced.top_k(table(spark, sf_dir, "embeddings"), query_every=50, k=5, scale=256.0)


ORACLES["op2_bit_sliced_top_k"] = """
WITH c AS (SELECT vec_id, pos, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS v
           FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings
                 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
s AS (SELECT q.vec_id AS query_id, r.vec_id AS vec_id, CAST(sum(q.v * r.v) AS BIGINT) AS score
      FROM c q JOIN c r ON q.pos = r.pos AND q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM n WHERE rank <= 5"""


@query
def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = bwt_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


@query
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from twinlens.session import materialize

    pieces = materialize(packing.tokenize(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
    return packing.pack(pieces)


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


@query
def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.url_filter(table(spark, sf_dir, "pages"))


@query
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    noisy = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return threshold_mining.hard_negatives(noisy, F.col("vec_id") % 100 == 0)


_USABLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

ORACLES["op11_hard_negatives"] = f"""
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE label IS NOT NULL AND {_USABLE}),
c AS (SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM r),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, CAST(sum(a.x * b.x) AS BIGINT) AS score
      FROM c a JOIN c b ON a.pos = b.pos AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 GROUP BY ALL),
p AS (SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.own
WHERE 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5"""


@query
def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_trie.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Training and coding round by round: x holds part vectors, b0, b1, ... the codebooks, n0, n1, ... the nearest entries."""
    steps = [f"""r AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v,
                 row_number() OVER (ORDER BY vec_id) AS nr FROM embeddings WHERE {_USABLE}),
x AS MATERIALIZED (SELECT vec_id, nr, p, list_slice(v, p * (len(v) // {parts}) + 1, (p + 1) * (len(v) // {parts})) AS x FROM r, range({parts}) t(p)),
b0 AS MATERIALIZED (SELECT p, nr - 1 AS e, x AS b FROM x WHERE nr <= {entries})"""]
    for k in range(rounds + 1):
        steps.append(f"""n{k} AS MATERIALIZED (SELECT vec_id, p, any_value(x) AS x, min((d, e))[1] AS d, min((d, e))[2] AS e FROM (
  SELECT x.*, b.e, CAST(list_sum(list_transform(list_zip(x.x, b.b), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
  FROM x JOIN b{k} b USING (p)) GROUP BY vec_id, p)""")
        if k < rounds:
            steps.append(f"""m{k} AS (SELECT p, e, list(m ORDER BY pos) AS b FROM (
  SELECT p, e, pos, CAST(floor(sum(c) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS m
  FROM (SELECT p, e, unnest(x) AS c, generate_subscripts(x, 1) AS pos FROM n{k}) GROUP BY ALL) GROUP BY ALL),
b{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.b, o.b) AS b FROM b{k} o LEFT JOIN m{k} m USING (p, e))""")
    return f"""WITH {", ".join(steps)},
c AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM n{rounds} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(CAST(w AS VARCHAR), ',' ORDER BY p, e, pos)) AS h FROM (SELECT p, e, unnest(b) AS w, generate_subscripts(b, 1) AS pos FROM b{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM c JOIN r USING (vec_id), h"""


ORACLES["op13_vector_codes"] = _codes_sql()
