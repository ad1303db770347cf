"""Odd documents shared by the tests of all text operators."""

import random

import pytest
from llm_texts import sentence

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string, key string, label string, c int"


@pytest.fixture(scope="session")
def odd_rows():
    rng = random.Random(5)
    passage = sentence(rng, 60)
    long_text = sentence(rng, 30_000)
    near = sentence(rng, 120)
    texts = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "one two three"), (None, sentence(rng, 80)), (6, "été à Ñandú 12 «oui»…"),
             (7, long_text), (8, sentence(rng, 50) + " " + passage), (9, passage + "\n" + sentence(rng, 40)), (10, near), (10, near),
             (11, near.replace("baran", "xyz", 1)), (12, near + " tail"), (13, "ab" * 400), (14, "ab" * 300), (15, "日本語の文章です。" * 20),
             (16, "line one\nline one\nline one\n\nother"), (17, None), (18, "x"), (18, "y"), (19, "!!! ??? ..."), (20, "a\x00b \x1c c d")]
    return [(i, t, None if i == 4 else "en", None, None, 0.5, "x", "k", "l", 1) for i, t in texts]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
