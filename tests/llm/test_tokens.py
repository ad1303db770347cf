import base64
import random
import zlib

import numpy as np
import public_tokenizers as P
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from twinlens.llm import byte_bpe, packing

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_matches_tiktoken_and_round_trips(odd, empty, odd_rows):
    enc = reference()
    tokens = byte_bpe.encode(odd, RANKS, P.PATTERN)
    got = sorted((r.doc_id or -1, r.ids) for r in tokens.collect())
    assert got == sorted((i or -1, enc.encode_ordinary(t or "")) for i, t, *_ in odd_rows)
    back = sorted((r.doc_id or -1, bytes(r.bytes)) for r in byte_bpe.decode(tokens, RANKS).collect())
    assert back == sorted((i or -1, (t or "").encode()) for i, t, *_ in odd_rows)
    assert byte_bpe.encode(empty, RANKS, P.PATTERN).count() == 0


def test_segment_tree_alone_and_side_by_side_agree():
    enc, vocab = reference(), byte_bpe.Vocabulary(open(RANKS, "rb").read())
    rng = random.Random(3)
    for n in (2, 3, 7, 16, 33, 63, 64, 65, 500, 4000):
        text = "".join(rng.choice("etaoinshé") for _ in range(n))
        raw = text.encode()
        whole = vocab.ids.get(raw)
        want = [whole] if whole is not None else enc._core_bpe.encode_single_piece(raw)
        if whole is None:
            assert np.frombuffer(vocab.merge_alone(raw), "<u4").tolist() == want
            if len(raw) <= 64:
                assert vocab.merge_side_by_side([raw, b"ab"], 64)[0] == vocab.merge_alone(raw)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_bpe_on_any_text(text):
    vocab = byte_bpe.vocabulary(open(RANKS, "rb").read())
    got = vocab.encode([text], regex.compile(P.PATTERN))[0]
    assert np.frombuffer(got, "<u4").tolist() == reference_once().encode_ordinary(text)


_once = []


def reference_once():
    if not _once:
        _once.append(reference())
    return _once[0]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abéÉÑ×÷'s.,!?ſ́ \n\x1c 9AZſ«»…"), st.characters(blacklist_categories=["Cs"])), max_size=40).map("".join))
def test_words_alone_encode_as_the_whole_text(text):
    tok = Tokenizer.from_file(WORDS)
    got = packing.token_ids([text.encode()], open(WORDS, "rb").read())[0]
    assert np.frombuffer(got, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


def check_packing(spark, docs, rows, most):
    from twinlens.session import materialize

    tok = Tokenizer.from_file(WORDS)
    pieces = materialize(packing.tokenize(docs, WORDS, most_tokens=most))
    got = packing.pack(pieces, most_tokens=most, group_rows=8).collect()
    want = []
    for i, t, *_ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), most):
            part = np.array(ids[k : k + most], "<u4")
            want.append((i or -1, k // most, k, len(part), zlib.crc32(part.tobytes())))
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= most
    return len(by_sequence), -(-sum(w[3] for w in want) // most)


def test_packing(spark, odd, odd_rows, empty):
    sequences, least = check_packing(spark, odd, odd_rows, 256)
    assert sequences <= least + 2
    check_packing(spark, empty, [], 256)


def test_best_fit_keeps_every_capacity():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 100, 500).astype(float)
    items = np.stack([sizes, np.ones(500), sizes**2], axis=1)
    capacity = np.array([100.0, 5, 6000])
    for rule in ("dot", "norm"):
        bins = packing.best_fit(items[sizes**2 <= 6000], capacity, rule)
        used = np.zeros((bins.max() + 1, 3))
        np.add.at(used, bins, items[sizes**2 <= 6000])
        assert (used <= capacity + 1e-6).all()
    tight = packing.best_fit(np.array([[60.0], [50.0], [50.0], [40.0]]), np.array([100.0]))
    assert tight.max() == 1


def test_added_tokens_as_the_library_does(spark):
    tok, file = Tokenizer.from_file(WORDS), open(WORDS, "rb").read()
    for text in ("end <|endoftext|> start", "<|endoftext|>", "a<|startoftext|><|endoftext|>b.<|endoftext", "<|ENDOFTEXT|> x"):
        assert np.frombuffer(packing.token_ids([text.encode()], file)[0], "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.token_ids([b"end <|endoftext|> start"], file)[0], "<u4").tolist() == [806, 49407, 1572]


def test_equal_rows_are_dealt_over_groups(spark):
    from twinlens.session import materialize

    pieces = materialize(packing.tokenize(spark.range(4000).selectExpr("cast(null AS bigint) AS doc_id", "'' AS text"), WORDS))
    got = packing.pack(pieces, group_rows=500, rounds=1)
    groups = got.selectExpr("(sequence_id div 8) % (1 << 24) AS g").groupBy("g").count().collect()
    assert len(groups) == 8 and max(r["count"] for r in groups) < 800
