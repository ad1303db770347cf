import random

import pytest

import corpus_pipeline
from llm_texts import sentence
from twinlens.session import materialize

KINDS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus with planted cases."""
    rng = random.Random(8)
    passage = " ".join(sentence(rng, 1) for _ in range(70))
    rows = [(k, sentence(rng, 100)) for k in range(200)]
    for k in range(200, 300):
        words = sentence(rng, 100).split()
        for j in range(0, 100, 8):
            words[j] = "vuxolin"
        rows.append((k, " ".join(words)))
    near = rows[7][1].replace(rows[7][1].split()[50], "other", 1)
    rows += [(400, rows[5][1]), (401, near), (402, "12 34 !"), (403, None), (404, ""), (405, sentence(rng, 40) + " " + passage), (406, passage + " " + sentence(rng, 40)), (407, sentence(rng, 9000))]
    root = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else "fr", "s", len(t or "")) for i, t in rows], KINDS)
    docs.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k >= 200)) for k in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root), dict(rows), passage


def test_stages(spark, folder):
    root, texts, passage = folder
    docs, kept = spark.read.parquet(f"{root}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, root))
        assert docs.columns == columns
        kept[name] = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert set(kept["toxicity"]) == set(texts) - set(range(200, 300))
    assert set(kept["toxicity"]) - set(kept["language_id"]) == {402, 403, 404}
    assert set(kept["language_id"]) - set(kept["ngram_jaccard_join"]) == {400, 401}
    final = kept["suffix_array_dedup"]
    assert set(final) == set(kept["ngram_jaccard_join"])
    assert passage in final[405] and passage[:60] not in final[406] and final[0] == texts[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, root).collect()
    assert {r.doc_id for r in packed} == set(final)


def test_near_copies_go_by_row_under_null_and_repeated_ids(spark):
    rng = random.Random(4)
    a, b, c, alone, other = (sentence(rng, 100, [f"{x}{k}" for k in range(300)]) for x in "abcde")
    near = lambda t: t + " tail"
    rows = [(None, a), (None, near(a)), (None, a), (None, alone), (1, b), (9, near(b)), (9, other), (9, other), (None, c), (3, near(c))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], KINDS).repartition(3)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    kept_a = [t for _, t in got if t in (a, near(a))]
    assert len(kept_a) == 1 and sorted((i or 0, t) for i, t in got if t not in kept_a) == sorted([(0, alone), (1, b), (9, other), (3, near(c))])


@pytest.mark.parametrize("lang", [None, "und"])
def test_texts_with_letters_stay_without_a_learned_language(spark, lang):
    texts = ["some words", "日本語", "été", "12 34 !", "", None]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t in enumerate(texts)], KINDS)
    got = corpus_pipeline.drop_unknown_language(spark, docs, "")
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [0, 1, 2]


def test_run_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], KINDS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_with_columns_named_like_internal_ones(spark, folder, tmp_path):
    root, texts, _ = folder
    clash = ["key", "kept", "starts", "spans", "marked", "masks", "n_bytes", "cut", "carried", "id", "c", "n", "sig", "row_key", "label", "score", "bucket", "piece", "start", "length"]
    docs = spark.read.parquet(f"{root}/documents.parquet")
    wide = docs.selectExpr("*", *[f"concat('{c}', doc_id) AS `{c}`" for c in clash])
    plain = wide
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        plain = materialize(stage(spark, plain, root))
        assert plain.columns == wide.columns, name
    assert plain.where(" OR ".join(f"`{c}` <> concat('{c}', doc_id)" for c in clash)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, plain, root).count() >= plain.count()
