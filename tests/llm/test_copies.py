import collections
import re

import numpy as np

from pyspark.sql import functions as F
from twinlens.llm import bwt_dedup, components, lsh_forest


def shingle_sets(rows):
    out = []
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        out.append((i, frozenset([tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) > 4 else [tuple(w)] if w else [])))
    return out


def links_of(rows, threshold=0.8):
    sets = shingle_sets(rows)
    links, parent = collections.Counter(), list(range(len(sets)))
    find = lambda k: k if parent[k] == k else find(parent[k])
    for a, (_, s) in enumerate(sets):
        for b, (_, t) in enumerate(sets):
            if a < b and s and t and len(s & t) >= threshold * len(s | t) - 1e-9:
                links[a] += 1
                links[b] += 1
                parent[find(max(a, b))] = find(min(a, b))
    groups = collections.defaultdict(list)
    for k in range(len(sets)):
        groups[find(k)].append(sets[k][0])
    smallest = {k: min((i for i in v if i is not None), default=None) for k, v in groups.items()}
    return sorted((sets[k][0] or -1, smallest[find(k)] or -1, links[k]) for k in range(len(sets)))


def found(docs, **kw):
    return sorted((r.doc_id or -1, r.class_id or -1, r.n_links) for r in lsh_forest.near_duplicates(docs, **kw).collect())


def test_join_on_odd_documents(odd, odd_rows, empty):
    assert found(odd) == links_of(odd_rows)
    assert found(empty) == []


def test_join_with_small_blocks_keeps_every_link(spark, odd_rows):
    rng = np.random.default_rng(2)
    base = [f"w{k}" for k in rng.integers(0, 500, 150)]
    rows = []
    for i in range(60):
        words = list(base)
        for k in rng.integers(0, 150, 3):
            words[k] = f"v{rng.integers(0, 9999)}"
        rows.append((100 + i, " ".join(words)))
    rows += [(200 + i, rows[0][1]) for i in range(5)] + [(300 + i, " ".join(f"z{k}" for k in rng.integers(0, 500, 40))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs, node_block=7, block_rows=9) == links_of(rows)


def test_links_under_null_and_repeated_ids(spark):
    rng = np.random.default_rng(6)
    rows = []
    for group in range(12):
        words = [f"g{group}w{k}" for k in rng.integers(0, 500, 120)]
        for copy in range(4):
            near = list(words)
            near[10 + 25 * copy] = f"x{copy}"
            # null under all, under some, one id for texts of all groups, ids of their own
            rows.append(((None, None if copy else 50 + group, 7, 100 + 4 * group + copy)[group % 4], " ".join(near)))
    rows += [rows[0], rows[2], (None, "alone " * 9), (7, " ".join(f"z{k}" for k in range(40)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(docs) == links_of(rows)
    assert sum(n > 2 for *_, n in found(docs)) == 50


def test_depth_shortens_until_the_threshold_is_safe():
    assert 1 - lsh_forest.chance(0.8, 5) < 1e-4 < 1 - lsh_forest.chance(0.8, 6)


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(129, 140)]
    got = {r.v: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and all(v == 100 for k, v in got.items() if k >= 100)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def removed(rows, window):
    """Brute force: per row the kept bytes and the number of removed runs; a null id is larger than all."""
    order = lambda i: 2**63 - 1 if i is None else i
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - window + 1):
            first[b[k : k + window]] = min(first.get(b[k : k + window], 2**63 - 1), order(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + window, bool)
        for k in range(len(b) - window + 1):
            if first[b[k : k + window]] < order(i):
                gone[k : k + window] = True
        gone = gone[: len(b)]
        out.append((i or -1, len(b), np.frombuffer(b, np.uint8)[~gone].tobytes(), int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())))
    return sorted(out)


def cut(docs, window=50, **kw):
    return sorted((r.doc_id or -1, r.n_bytes, bytes(r.kept), len(r.spans)) for r in bwt_dedup.remove_repeats(docs, window=window, **kw).collect())


def test_repeats_on_odd_documents(odd, odd_rows, empty):
    want = removed([(r[0], r[1]) for r in odd_rows], 50)
    assert sum(w[3] for w in want) > 3
    assert cut(odd) == want
    assert cut(odd, hot=2, bucket_bytes=50_000) == want
    assert cut(odd, most_broadcast=0) == want
    assert cut(empty) == []


def test_repeats_of_periodic_and_nested_texts(spark):
    rng = np.random.default_rng(4)
    words = ["ab", "abc", "a", "b", "cab"]
    rows = [(int(k), " ".join(rng.choice(words, 60))) for k in range(25)] + [(50, "a" * 500), (51, "a" * 60), (52, "ba" * 100), (3, "a" * 80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for window in (16, 24, 50):
        assert cut(docs, window) == removed(rows, window)


def test_merged_intervals_equal_sorted_windows():
    rng = np.random.default_rng(9)
    strings = [bytes(rng.integers(97, 99, n).astype(np.uint8)) for n in rng.integers(20, 40, 30)] + [b"a" * 30, b"a" * 30]
    text, sizes = np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings])
    for shards in (1, 2, 5):
        got = bwt_dedup.window_intervals(text, sizes, 20, shards)
        seen = {}
        for i, s in enumerate(strings):
            for k in range(len(s) - 19):
                assert seen.setdefault(s[k : k + 20], got[i, k]) == got[i, k]
        assert len(set(seen.values())) == len(seen)


def test_as_text_drops_broken_characters(spark):
    rows = [(1, "é" * 40), (2, "xé" + "é" * 40)]
    got = {r.doc_id: r.kept for r in bwt_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), as_text=True).select("doc_id", F.col("kept")).collect()}
    assert got[1] == "é" * 40 and set(got[2]) <= set("xé")
