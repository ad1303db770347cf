import random

import numpy as np
import pytest
import xxhash
from llm_texts import sentence
from pyspark.sql import functions as F

from twinlens.llm import hot, queries, simhash_trie, threshold_mining, vector_codes


def good(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)


def brute_negatives(rows, k=5, positives=5, low=80, every=100):
    rows = [(i, c, [int(x) for x in np.floor(256 * np.array(v, float))]) for i, c, v in rows if i is not None and c is not None and good(v)]
    out = set()
    for a, own, q in rows:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i, c) for i, c, v in rows if i != a and len(v) == len(q))
        for s, p, c in [x for x in scored if x[2] == own][:positives]:
            fits = [x for x in scored if x[2] != own and low * -s <= 100 * -x[0] <= 100 * -s][:k]
            out |= {(a, p, n + 1, i, -s, -t) for n, (t, i, _) in enumerate(fits)}
    return sorted(out)


def vector_rows(rng, n, d):
    rows = [(int(i), int(rng.integers(0, 3)), [float(x) for x in rng.normal(size=d)]) for i in range(n)]
    rows += [(n + 1, 1, None), (n + 2, 1, []), (n + 3, 1, [1.0, None] * (d // 2)), (n + 4, 1, [float("nan")] * d), (n + 5, 1, [float("inf")] * d), (None, 1, [1.0] * d),
             (n + 6, None, [1.0] * d), (n + 7, 2, rows[5][2]), (n + 8, 0, rows[5][2]), (n + 9, 1, rows[100][2]), (10 * n, 1, [0.0] * d), (20 * n, 2, [1.0] * (d + 8)),
             (20 * n + 1, 0, [1.0] * (d + 8)), (20 * n + 2, 2, [1.1] * (d + 8))]
    return rows


def test_hard_negatives_equal_brute_force(spark):
    rows = vector_rows(np.random.default_rng(3), 400, 8)
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").selectExpr("*", "'x' AS id", "1 AS score", "2 AS rb", "3 AS d", "4 AS anchor", "5 AS key")
    want = brute_negatives(rows)
    assert len(want) > 50
    for blocks in ({}, {"block_rows": 50, "block_anchors": 2}):
        got = threshold_mining.hard_negatives(frame, F.col("vec_id") % 100 == 0, **blocks)
        assert sorted(map(tuple, got.collect())) == want
    assert threshold_mining.hard_negatives(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    none = threshold_mining.hard_negatives(frame, F.lit(False))
    assert none.count() == 0


def test_repeated_rows_and_large_components(spark):
    rows = [(0, 1, [3e6, 1.0]), (0, 1, [3e6, 1.0]), (1, 1, [2e6, 0.0]), (1, 1, [2e6, 0.0]), (2, 2, [1.9e6, 5.0]), (2, 2, [1.9e6, 5.0]), (3, 2, [-2e6, 0.0])]
    got = threshold_mining.hard_negatives(spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>"), F.col("vec_id") == 0)
    score = 3_000_000 * 256 * 1_900_000 * 256 + 256 * 5 * 256
    found = sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.negative_score) for r in got.collect())
    # rows that repeat an id count each by itself, on the positive side too
    assert found == sorted([(0, 1, r, 2, score) for r in (1, 2)] * 2)


def test_the_walk_stops_early_and_loses_nothing():
    rng = np.random.default_rng(4)
    values = rng.integers(-300, 300, (3000, 2))
    lists = threshold_mining.SortedLists(np.arange(3000), np.zeros(3000, int), values)
    for q in (np.array([5, -3]), np.array([0, 7]), np.array([-2, 0]), np.array([0, 0])):
        rows, scores = lists.best(17, 0, q, 5, None)[0]
        exact = sorted((-int(s), i) for i, s in enumerate(values @ q) if i != 17)[:5]
        assert [(-int(s), int(i)) for i, s in zip(rows, scores)] == exact
    met = 0
    for rows, _, left in lists.walk(np.array([5, -3])):
        met += len(rows)
        if left is not None and left < scores.max():
            break
    assert met <= 3000
    steps = [len(r) for r, _, _ in lists.walk(np.array([5, -3]))]
    assert sum(steps) == 3000 and len(steps) > 3  # every row once, in steps


def plain_print(text, size=3):
    words = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    runs = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, budget=2):
    prints = [plain_print(t) for _, t in rows]
    distinct = sorted(set(prints))
    up = {f: f for f in distinct}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    for i, f in enumerate(distinct):
        for g in distinct[:i]:
            if (f ^ g).bit_count() <= budget:
                up[root(f)] = root(g)
    least = {}
    for (i, _), f in zip(rows, prints):
        if i is not None:
            least[root(f)] = min(i, least.get(root(f), i))
    return sorted(((i, f"{f:016x}", least.get(root(f))) for (i, _), f in zip(rows, prints)), key=str)


def test_simhash_equals_brute_force(spark, odd, odd_rows, empty):
    rng = random.Random(8)
    rows = [(r[0], r[1]) for r in odd_rows]
    for k in range(60):
        base = sentence(rng, rng.randint(1, 400)).split(" ")
        for c in range(rng.randint(1, 4)):
            words = list(base)
            if c and len(words) > 20:
                words[rng.randrange(len(words))] = "Änderung"
            rows.append((1000 + 10 * k + c, rng.choice(["", "\t", "  "]) + rng.choice([" ", "\n"]).join(words).upper()))
    frame = spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in rows], "doc_id long, text string, f string, label int, n int, first int").repartition(5)
    want = brute_components(rows)
    assert len({w[2] for w in want}) < len({w[1] for w in want})
    for sizes in ({}, {"block": 8, "step": 3}):
        got = sorted(map(tuple, simhash_trie.near_duplicates(frame, **sizes).collect()), key=str)
        assert got == want
    assert simhash_trie.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("dense", [False, True])
def test_the_trie_join_finds_every_pair(dense):
    rng = np.random.default_rng(6)
    a = rng.integers(0, 2**64, 3000, np.uint64)
    if dense:  # a ball: few bits differ at all, in the highest and lowest places
        a = np.uint64(0x0F0F) ^ (rng.integers(0, 2**10, 900, np.uint64) | (rng.integers(0, 8, 900, np.uint64) << np.uint64(61)))
    a = np.unique(np.concatenate([a, a[:400] ^ np.uint64(1 << 63), a[:300] ^ np.uint64(0b101), a[:200] ^ np.uint64(0b111)]))
    b = np.unique(np.concatenate([a[::3] ^ np.uint64(1 << 40), rng.integers(0, 2**64, 100, np.uint64)]))
    for left, right, same in ((a, a, True), (a, b, False)):
        apart = np.bitwise_count(left[:, None] ^ right[None, :]) <= 2
        want = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(apart, 1) if same else apart))}
        i, j = simhash_trie.linked(left, right, same, 2)
        assert len(i) == len(want) and {(int(x), int(y)) for x, y in zip(i, j)} == want
    v, root = simhash_trie.forest(np.array([5, 3, 9]), np.array([3, 1, 8]), 10)
    assert list(zip(v.tolist(), root.tolist())) == [(3, 1), (5, 1), (9, 8)]


def test_links_split_over_the_tables(spark):
    """A dense prefix goes deeper than its neighbours; links between leaves of different depth are kept."""
    rng = np.random.default_rng(7)
    f = np.unique(np.concatenate([rng.integers(0, 2**64, 300, np.uint64), rng.integers(0, 2**12, 600, np.uint64), np.uint64(1 << 62) | rng.integers(0, 2**12, 50, np.uint64)]))
    frame = spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "f long")
    apart = np.bitwise_count(f[:, None] ^ f[None, :]) <= 2
    i, j = np.nonzero(np.triu(apart, 1))
    v, root = simhash_trie.forest(i, j, len(f))
    want = {(int(x), int(y)) for x, y in zip(f[v].view(np.int64), f[root].view(np.int64))}
    for broadcast in (500_000, 0):
        edges = simhash_trie.links(frame, block=40, step=4, most_broadcast=broadcast).collect()
        place = {int(x): k for k, x in enumerate(f.view(np.int64))}
        v2, root2 = simhash_trie.forest(np.array([place[r.a] for r in edges]), np.array([place[r.b] for r in edges]), len(f))
        assert {(int(x), int(y)) for x, y in zip(f[v2].view(np.int64), f[root2].view(np.int64))} == want


def brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, c, [int(x) for x in np.floor(4096 * np.array(v, float))]) for i, c, v in rows if good(v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    d = len(kept[0][2])
    w = -(-d // parts)
    kept = [(i, c, v + [0] * (w * parts - d)) for i, c, v in kept if len(v) == d]
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for _, _, v in kept]
    books = [[cut[e][p] for e in range(min(entries, len(kept)))] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, y)), e) for e, y in enumerate(books[p]))

    for _ in range(rounds):
        at = [[near(p, x[p])[1] for p in range(parts)] for x in cut]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [x[p] for x, a in zip(cut, at) if a[p] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    final = [[near(p, x[p]) for p in range(parts)] for x in cut]
    errors = [sum(d for d, _ in f) for f in final]
    return sorted(((i, "".join(f"{e:02x}" for _, e in f), err, sum(x for x, r in zip(errors, kept) if r[1] == c)) for (i, c, _), f, err in zip(kept, final, errors)), key=str), books


@pytest.mark.parametrize("d, cell", [(16, 1024), (16, 1 << 14), (13, 64)])
def test_codes_equal_brute_force(spark, d, cell):
    rows = vector_rows(np.random.default_rng(d), 150, 16)
    rows = [(i, c, v if v is None or len(v) != 16 else v[:d]) for i, c, v in rows] + [(3, 1, rows[3][2][:d])]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").selectExpr("*", "1 AS id", "2 AS v", "3 AS code", "4 AS n", "5 AS label_error").repartition(4)
    want, books = brute_codes(rows)
    got = vector_codes.compress(frame, cell=cell).collect()
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=str) == want
    assert {r.codebooks_sha256 for r in got} == {vector_codes.Codebooks(np.array(books, object)).digest()}
    assert vector_codes.compress(frame.limit(0)).count() == 0


def test_few_rows_and_large_numbers(spark):
    rows = [(1, None, [3e5] * 8), (2, None, [-3e5] * 8), (3, None, [2.9e5] * 8), (4, 1, [0.0] * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in vector_codes.compress(frame).collect())) == brute_codes(rows)[0]


def test_listed_entries_hold_every_nearest_one():
    rng = np.random.default_rng(9)
    book, x = rng.integers(-900, 900, (16, 4)), rng.integers(-1000, 1000, (2000, 4))
    book[7] = book[3]  # a tie everywhere
    memo = vector_codes.GridMemo(book, 128)
    at, d = memo.nearest(x)
    exact = ((x[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
    assert (at == exact.argmin(axis=1)).all() and (d == exact.min(axis=1)).all()
    assert memo.masks(x).mean() < 0.5  # fewer than half are evaluated
    assert len(memo.lists) == len(np.unique(x // 128, axis=0))


def test_attach_hot_and_null_keys(spark):
    rows = spark.createDataFrame([(None if i % 3 == 0 else i % 1500, i) for i in range(6000)], "k int, i int")
    facts = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("top"))
    got = {(r.k, r.i): r.top for r in hot.attach(rows, facts, "k", "n", 6000).collect()}
    want = {r.k: r.top for r in facts.collect()}
    assert len(got) == 6000 and all(v == want[k] for (k, _), v in got.items())


def test_registered_queries_keep_their_contract(spark):
    sf = "/root/testdata/sf0.001"
    for name, columns in {"op11_hard_negatives": "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long",
                          "op12_simhash_near_dedup": "doc_id long, fingerprint string, component_id long",
                          "op13_vector_codes": "vec_id long, code string, error long, label_error long, codebooks_sha256 string"}.items():
        got = queries.QUERIES[name](spark, sf)
        assert {(f.name, f.dataType.simpleString()) for f in got.schema} == {tuple(c.replace("long", "bigint").split()) for c in columns.split(", ")}
        assert got.count() > 0
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.QUERIES["op12_simhash_near_dedup"](spark, sf).collect()), key=str) == brute_components(docs)
