import numpy as np
import pytest

from twinlens.llm import bit_sliced, licenses, url_rules


def brute_top(rows, every, k):
    good = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in good:
        if i % every == 0:
            scored = sorted((-int(q @ v), j) for j, v in good if j != i and len(v) == len(q))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    return sorted(out)


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), [float(x) for x in rng.normal(size=6)]) for i in range(300)]
    rows += [(301, None), (302, []), (303, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (304, [float("nan")] * 6), (305, [float("inf")] * 6), (None, [1.0] * 6),
             (306, rows[7][1]), (307, rows[7][1]), (400, [0.0] * 6), (450, [1.0, 2.0]), (451, [1.0, 2.0]), (500, [-3.0] * 6)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute_top(rows, 50, 5)
    for blocks in ({}, {"block_rows": 64, "block_queries": 3}):
        got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in bit_sliced.top_k(frame, **blocks).collect())
        assert got == want
    assert bit_sliced.top_k(frame.limit(0)).count() == 0


@pytest.mark.parametrize("n", [64, 128])
def test_blocks_of_whole_words_are_indexed(spark, n):
    rng = np.random.default_rng(n)
    rows = [(int(i), [float(x) for x in rng.normal(size=6)]) for i in range(1, n)] + [(0, [1.0] * 6), (50, [1.0, 2.0]), (51, [1.0, 2.0])]
    rows = [r for r in rows if len(r[1]) == 2 or r[0] not in (50, 51)] + [(200, [0.5] * 6), (201, [0.25] * 6)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sum(len(v) == 6 for _, v in rows) == n  # one block, no bits to fill up
    assert sorted(map(tuple, bit_sliced.top_k(frame).collect())) == brute_top(rows, 50, 5)


def test_large_blocks_give_the_same_rows(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.normal(size=6)]) for i in range(600)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(bit_sliced, "MANY_BLOCKS", 3)
    monkeypatch.setattr(bit_sliced, "QUERY_BLOCKS", 2)
    for values in (6 * 100, 10**6):
        monkeypatch.setattr(bit_sliced, "LARGE_VALUES", values)
        assert sorted(map(tuple, bit_sliced.top_k(frame, 10, 5, block_rows=20, block_queries=5).collect())) == brute_top(rows, 10, 5)


def test_slices_add_up():
    rng = np.random.default_rng(1)
    values = rng.integers(-300, 300, (130, 9))
    index = bit_sliced.BitSlicedIndex(np.arange(130), values)
    for query in (rng.integers(-300, 300, 9), np.zeros(9, int), np.eye(9, dtype=int)[2], -np.eye(9, dtype=int)[0]):
        slices = index.score_slices(query)
        total = sum(np.unpackbits(s.view(np.uint8), bitorder="little")[:130].astype(object) << w for w, s in enumerate(slices)) if slices else np.zeros(130, int)
        exact = values @ query
        assert len({int(a) - int(b) for a, b in zip(total, exact)}) == 1


@pytest.mark.parametrize("text, labels, free", [
    ("MIT", {"mit"}, True), ("MIT OR GPL-3.0-only", {"mit", "gpl-3"}, True), ("MIT AND GPL-3.0-only", {"mit", "gpl-3"}, False),
    ("(MIT OR GPL-3.0-only) AND Apache-2.0", {"mit", "gpl-3", "apache-2"}, True), ("MIT OR GPL-3.0-only AND GPL-2.0-only", {"mit", "gpl-3", "gpl-2"}, True),
    ("GPL-2.0-only WITH Classpath-exception-2.0", {"gpl-2"}, False), ("GPL-2.0+", {"gpl-2.0"}, False),
])
def test_expressions(text, labels, free):
    assert licenses.evaluate(text) == (labels, free)


@pytest.mark.parametrize("text", ["", "AND MIT", "MIT OR", "(MIT", "MIT)", "()", "+"])
def test_malformed_expressions(text):
    assert licenses.evaluate(text) is None


def test_license_scan(spark, odd, empty):
    rows = [(1, "Released UNDER the MIT License. apache license, version 2"), (2, "under the mit licenses"), (3, "CC-BY-NC cc by nc by nc"),
            (4, "# SPDX-License-Identifier: (MIT OR Apache-2.0)\nunder the mit license under the mit license"), (5, "xunder the mit license"),
            (6, "SPDX-License-Identifier: MIT AND\nsome text")]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (9, 2, 1, 5, "apache-2,mit")
    assert got[2].n_base == 0 and got[2].base_labels == ""
    assert (got[3].n_base, got[3].first_word, got[3].last_word) == (2, 0, 3)
    assert got[4].n_base == 2 and got[4].labels == "apache-2,mit" and got[4].expressions == ["(MIT OR Apache-2.0)"] and got[4].permissive
    assert got[5].n_base == 0 and "mit" in got[5].labels
    assert got[6].expressions == []
    assert licenses.license_scan(odd).count() == odd.count() and licenses.license_scan(empty).count() == 0
    blank = [r for r in licenses.license_scan(odd).collect() if r.doc_id in (1, 2, 3)]
    assert all((r.n_words, r.first_word, r.labels, r.score) == (0, None, "", 0.0) for r in blank)


def test_url_rules(spark):
    base = [(k, f"http://h{k}.example.net/{'en' if k % 2 else 'de'}/{k}") for k in range(40)]
    rows = base + [(100, None), (101, "no scheme"), (102, "HTTP://A.EXAMPLE.NET/en/1?x=1#y"), (103, "https://org/fr/"), (104, "http://xorg/fr/1"), (105, "http://www.other.info/de/7"),
                   (106, "http://example.com"), (107, "ftp://"), (107, "ftp://"), (108, "http://net?q=://a"), (109, "http://a.net/x://b")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumnsRenamed({}).selectExpr("*", "'x' AS html", "1 AS label", "2 AS tokens", "3 AS host")
    got = {}
    for r in url_rules.url_filter(pages).collect():
        got.setdefault(r.page_id, []).append((r.host, r.path, r.rule, r.verdict))
    assert got[100] == [("", "", None, "allow")] and got[101] == [("", "", None, "allow")]
    assert got[102] == [("a.example.net", "/en/1", "example.net/en/", "allow")]
    assert got[103] == [("org", "/fr/", "org/fr/", "allow")] and got[104][0][2] is None
    assert got[105][0][2:] == (None, "block")  # learned: path:de => block
    assert got[106][0] == ("example.com", "", None, got[106][0][3])
    assert len(got[107]) == 2 and got[108][0][:2] == ("net", "") and got[109][0][2] == "net/"
    assert got[0][0][2:] == ("net/", "block") and got[1][0][2:] == ("example.net/en/", "allow")
    assert url_rules.url_filter(pages.limit(0)).count() == 0


def test_inverted_index_finds_what_brute_force_finds(spark):
    rng = np.random.default_rng(3)
    names = [f"t{k}" for k in range(12)]
    urls = [(sorted(set(rng.choice(names, 5).tolist())), "block" if rng.random() < 0.5 else "allow") for _ in range(200)]
    frame = spark.createDataFrame(urls, "tokens array<string>, label string")
    rules = url_rules.mine_rules(frame, support=0.02, confidence=0.6)
    known = [(set(r.tokens), r.label, r.confidence, r.support) for r in rules.collect()]
    assert known
    for r in url_rules.match(frame, rules).collect():
        fits = [k for k in known if k[0] <= set(r.tokens)]
        assert (r.learned is None) == (not fits)
        if fits:
            assert r.learned.confidence == max(k[2] for k in fits)


def test_tokens_that_stand_together_are_one_item(spark):
    bound = [f"b{k:02}" for k in range(18)]  # 2^18 rules, were each combination one
    rows = [(sorted([*bound, f"x{k % 3}"]), "block") for k in range(30)] + [([f"x{k % 3}", "y"], "allow") for k in range(30)] + [(["z"], "block")]
    labelled = spark.createDataFrame(rows, "tokens array<string>, label string")
    rules = url_rules.mine_rules(labelled, support=0.05, confidence=0.8)
    kept = {(tuple(r.tokens), r.label): r for r in rules.collect()}
    assert set(kept) == {(("b00",), "block"), (("y",), "allow")}
    assert kept[("b00",), "block"].members == [bound] and kept[("b00",), "block"].confidence == 1.0
    urls = spark.createDataFrame([(["b07"],), (["b07"],), (["b03", "b11", "q"],), (["x0"],), (["y", "z"],), ([],)], "tokens array<string>")
    want = sorted([(["b07"], "block", ["b07"])] * 2 + [(["b03", "b11", "q"], "block", ["b11"]), (["x0"], None, None), (["y", "z"], "allow", ["y"]), ([], None, None)], key=str)
    for most in (16_000_000, 0):
        got = [(r.tokens, r.learned and r.learned.label, r.learned and r.learned.rule_tokens) for r in url_rules.match(urls, rules, most_broadcast=most).collect()]
        assert sorted(got, key=str) == want


def test_top_k_keeps_vectors_with_large_components(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(0, 3, (40, 3)) * np.where(np.arange(40) % 3 == 0, 1e6, 1)[:, None]
    x[5, 0], x[10, 2] = 3e7, -5e6
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    q = np.floor(256 * x).astype(np.int64).tolist()
    want = []
    for i in range(0, 40, 5):
        best = sorted((-sum(a * b for a, b in zip(q[i], q[j])), j) for j in range(40) if j != i)[:4]
        want += [(i, rank, j, -s) for rank, (s, j) in enumerate(best, 1)]
    for size in (7, 100):
        assert sorted(map(tuple, bit_sliced.top_k(docs, 5, 4, block_rows=size).collect())) == want


def test_top_k_names_a_score_beyond_64_bits(spark):
    docs = spark.createDataFrame([(0, [2e9, 2e9]), (1, [2e9, 1e9])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="leaves 64 bits"):
        bit_sliced.top_k(docs, 1, 1, scale=256.0 * 64).collect()
