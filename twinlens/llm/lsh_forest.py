"""N-gram Jaccard join by a MinHash LSH forest, every reported link verified exactly.

A text is the set of its runs of five words (a text of one to four words: the one run of all its words). Texts of equal
sets form a copy class, joined once. Each class has ``TREES`` signatures of up to ``DEPTH`` minima; a signature's prefix is
a node of that tree's trie. The join starts at the longest prefixes and shortens them until the estimated recall reaches
the target: a pair found with similarity s has chance 1-(1-s^depth)^TREES of being found at this depth, which gives the
expected number missed; prefixes are never left longer than what loses a pair at the threshold itself with more than
``most_loss``. Inside a node the classes whose signatures agree closely enough are connected; connected classes are then
compared pair by pair, exactly, in blocks, each block pair returning link counts and a spanning forest, never the pairs.

Sets inside a connected group are told by their difference to one member's set, so near copies travel as their few edits.

Results for odd input: texts without words have no links and form their own class; null ids take part like others, texts
are fetched again by a hash of id and text, so null and repeated ids name their own text; repeated rows are copies; other
columns are ignored; long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlens.llm import textarrays as ta
from twinlens.llm.components import components
from twinlens.session import materialize

TREES, DEPTH = 24, 6
_RNG = np.random.default_rng(51)
_XOR = _RNG.integers(0, 2**64, TREES * DEPTH, np.uint64)
_MUL = _RNG.integers(0, 2**63, TREES * DEPTH, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(data: np.ndarray, bounds: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (64-bit hashes, sorted inside each text) and their texts."""
    starts, ends, doc = ta.pieces(data, bounds)
    word = ta.hashes(data, starts, ends)
    found, at = ta.windows(word, doc, size)
    owner = doc[at]
    count = np.bincount(doc, minlength=len(bounds) - 1)
    for length in range(1, size):  # texts shorter than a shingle
        short = np.flatnonzero(count == length)
        if len(short):
            first = np.searchsorted(doc, short)
            acc = word[first]
            for k in range(1, length):
                acc = acc * np.uint64(0xD6E8FEB86659FD93) + word[first + k]
            found, owner = np.concatenate([found, ta.mix(acc + np.uint64(length))]), np.concatenate([owner, short])
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return found[new], owner[new]


def _class_keys(found: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Size of each text's set and a 64-bit key of its content."""
    size = np.bincount(owner, minlength=n)
    run = np.concatenate([[np.uint64(0)], np.cumsum(ta.mix(found ^ np.uint64(0x5851F42D4C957F2D)))])
    ends = np.cumsum(size)
    return size, ta.mix((run[ends] - run[ends - size]) ^ size.astype(np.uint64)).view(np.int64)


def _signatures(found: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Upper halves of the minima, for texts that have shingles."""
    heads = (np.cumsum(size) - size)[size > 0]
    out = np.empty((len(heads), TREES * DEPTH), np.uint32)
    for k in range(TREES * DEPTH if len(heads) else 0):
        out[:, k] = np.minimum.reduceat((found ^ _XOR[k]) * _MUL[k], heads) >> np.uint64(32)
    return out


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Hash of id and text: never null, and the same for rows that repeat both."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, row_key, c, n, sig): row key, class key, set size and signature of each text; c and sig null for texts without words."""

    def one(data: np.ndarray, bounds: np.ndarray) -> tuple:
        found, owner = shingles(data, bounds, size)
        n, key = _class_keys(found, owner, len(bounds) - 1)
        return n, key, _signatures(found, n)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ta.rows(batches):
            parts = ta.per_span(one, batch.column(2))
            n, key = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in (0, 1))
            sig = iter(np.concatenate([p[2] for p in parts]) if parts else ())
            bits = [next(sig).tobytes() if m else None for m in n]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(key, mask=n == 0), pa.array(n), pa.array(bits, pa.binary())], ["id", "row_key", "c", "n", "sig"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("row_key"), text_col).mapInArrow(run, f"id {kind}, row_key long, c long, n long, sig binary")


def _node_keys(classes: DataFrame, depth: int) -> DataFrame:
    """(key, c): the trie nodes of every class at this depth, one per tree."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, TREES, DEPTH)
            key = np.tile(np.arange(1, TREES + 1, dtype=np.uint64), (len(sig), 1))
            for k in range(depth):
                key = ta.mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, k])
            c = np.repeat(batch.column(0).to_numpy(), TREES)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(c)], ["key", "c"])

    return classes.select("c", "sig").mapInArrow(run, "key long, c long")


def chance(s: np.ndarray | float, depth: int) -> np.ndarray | float:
    """Probability that a pair of similarity ``s`` meets in a node."""
    return 1 - (1 - s**depth) ** TREES


def _connect(sig: np.ndarray, least: float, pairs: tuple[np.ndarray, np.ndarray] | None) -> list[tuple[int, int, float]]:
    """Spanning forest of the rows whose signatures agree in ``least`` of their places or more.

    With ``pairs`` (rows of one block, rows of the other) only agreements between the two count.
    """
    out, open_ = [], np.ones(len(sig), bool)
    side = None
    if pairs is not None:
        side = np.zeros(len(sig), bool)
        side[pairs[1]] = True
    for start in range(len(sig)):
        if not open_[start]:
            continue
        open_[start] = False
        queue = [start]
        while queue:
            i = queue.pop()
            rest = np.flatnonzero(open_ if side is None else open_ & (side != side[i]))
            if not len(rest):
                continue
            same = (sig[rest] == sig[i]).mean(axis=1)
            s = (same - 1 / 256) / (1 - 1 / 256)  # one byte of a minimum agrees by chance in 1 of 256
            hit = s >= least
            out += [(i, j, v) for j, v in zip(rest[hit].tolist(), s[hit].tolist())]
            open_[rest[hit]] = False
            queue += rest[hit].tolist()
    return out


def _candidate_edges(classes: DataFrame, depth: int, least: float, block: int) -> DataFrame:
    """(a, b, s): inside every node, classes connected by agreeing signatures. Nodes of more than ``block`` classes are
    split into blocks that meet pairwise."""
    keys = _node_keys(classes, depth)
    shared = keys.groupBy("key").agg(F.count("*").alias("g")).where(F.col("g") > 1)
    blocks = F.ceil(F.col("g") / block).cast("int")
    placed = (keys.join(shared, "key").withColumn("nb", blocks).withColumn("own", F.pmod(F.xxhash64("c"), F.col("nb")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))))
    placed = placed.select("key", "c", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    full = placed.join(classes.select("c", "sig"), "c")

    def link(group: pa.Table) -> pa.Table:
        c, own = group.column("c").to_numpy(), group.column("own").to_numpy()
        order = np.argsort(c)
        sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint32).reshape(len(c), -1).astype(np.uint8)[order]
        c, own = c[order], own[order]
        x, y = group.column("x")[0].as_py(), group.column("y")[0].as_py()
        found = _connect(sig, least, None if x == y else (np.flatnonzero(own == x), np.flatnonzero(own == y)))
        i, j, s = zip(*found) if found else ((), (), ())
        return pa.table([pa.array(c[list(i)], pa.int64()), pa.array(c[list(j)], pa.int64()), pa.array(s, pa.float64())], ["a", "b", "s"])

    return full.groupBy("key", "x", "y").applyInArrow(link, "a long, b long, s double")


def candidate_groups(classes: DataFrame, threshold: float, target: float, most_loss: float, block: int) -> tuple[DataFrame, int]:
    """(c, label) of classes in groups of two or more, and the depth at which the target was met."""
    spread = 5.5 * np.sqrt(threshold * (1 - threshold) / (TREES * DEPTH))
    least = max(0.05, threshold - spread)  # an estimate falls lower for one pair in some ten million
    edges, depth = None, DEPTH
    while True:
        found = materialize(_candidate_edges(classes, depth, least, block).groupBy("a", "b").agg(F.max("s").alias("s")))
        edges = found if edges is None else edges.unionByName(found)
        p = F.lit(1.0) - F.pow(1 - F.pow(F.least(F.greatest("s", F.lit(threshold)), F.lit(1.0)), depth), TREES)
        seen = found.where(F.col("s") >= threshold).agg(F.count("*").alias("n"), F.sum((1 - p) / p).alias("missed")).first()
        recall = seen["n"] / (seen["n"] + seen["missed"]) if seen["n"] else 1.0
        if depth == 1 or (recall >= target and 1 - chance(threshold, depth) <= most_loss):
            return components(edges).select(F.col("v").alias("c"), "label"), depth
        depth -= 1


def _set_rows(docs: DataFrame, text_col: str, size: int) -> DataFrame:
    """(c, n, items): class key and shingle set of each text that has words."""

    def one(data: np.ndarray, bounds: np.ndarray) -> list:
        found, owner = shingles(data, bounds, size)
        n, key = _class_keys(found, owner, len(bounds) - 1)
        ends = np.cumsum(n)
        return [(int(k), int(m), found[e - m : e].tobytes()) for k, m, e in zip(key, n, ends) if m]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ta.rows(batches, 512):
            rows = [r for part in ta.per_span(one, batch.column(0)) for r in part]
            c, n, items = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(n, pa.int64()), pa.array(items, pa.binary())], ["c", "n", "items"])

    return docs.select(text_col).mapInArrow(run, "c long, n long, items binary")


def only_ids(docs: DataFrame, ids: DataFrame, id_col: str, most_broadcast: int = 500_000) -> DataFrame:
    """Rows of ``docs`` whose id is in ``ids`` (id_col). Up to ``most_broadcast`` counted ids travel to the tasks; more are
    joined by a shuffle."""
    small = ids.limit(most_broadcast + 1).count() <= most_broadcast
    return docs.join(F.broadcast(ids) if small else ids, id_col, "left_semi")


def _encoded(members: DataFrame) -> DataFrame:
    """Sets as their difference to the set of the group's base: rows (label, c, n, w, nbase, missing, extra)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            missing, extra, nbase = [], [], []
            for own, base in zip(batch.column("items"), batch.column("base")):
                a, b = np.frombuffer(own.as_buffer(), np.uint64), np.frombuffer(base.as_buffer(), np.uint64)
                missing.append(np.setdiff1d(b, a, assume_unique=True).tobytes())
                extra.append(np.setdiff1d(a, b, assume_unique=True).tobytes())
                nbase.append(len(b))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("label", "c", "n", "w")), pa.array(nbase, pa.int64()), pa.array(missing, pa.binary()), pa.array(extra, pa.binary())],
                                             ["label", "c", "n", "w", "nbase", "missing", "extra"])

    return members.select("label", "c", "n", "w", "items", "base").mapInArrow(
        run, "label long, c long, n long, w long, nbase long, missing binary, extra binary")


class _Sparse:
    """Rows of item numbers; those of a share of the rows as a dense matrix, the others as postings."""

    def __init__(self, rows: list[np.ndarray]) -> None:
        self.sizes = np.array([len(r) for r in rows], np.int64)
        self.row = np.repeat(np.arange(len(rows)), self.sizes)
        self.item = np.concatenate([*rows, np.zeros(0, np.uint64)])


def _common(a: _Sparse, b: _Sparse, na: int, nb: int) -> np.ndarray:
    """How many items each row of ``a`` shares with each row of ``b``."""
    out = np.zeros((na, nb), np.float32)
    both = np.intersect1d(a.item, b.item)
    if not len(both):
        return out
    parts = []
    for s in (a, b):
        at = np.searchsorted(both, s.item)
        at[at == len(both)] = 0
        hit = both[at] == s.item
        parts.append((s.row[hit], at[hit]))
    (ra, ia), (rb, ib) = parts
    fa, fb = np.bincount(ia, minlength=len(both)), np.bincount(ib, minlength=len(both))
    dense = np.flatnonzero((fa > 32) & (fb > 32))
    place = np.full(len(both), -1)
    for d in range(0, len(dense), 1024):
        place[:] = -1
        place[dense[d : d + 1024]] = np.arange(len(dense[d : d + 1024]))
        x, y = np.zeros((na, 1024), np.float32), np.zeros((nb, 1024), np.float32)
        x[ra[place[ia] >= 0], place[ia[place[ia] >= 0]]] = 1
        y[rb[place[ib] >= 0], place[ib[place[ib] >= 0]]] = 1
        out += x @ y.T
    rare = np.ones(len(both), bool)
    rare[dense] = False
    ka, kb = rare[ia], rare[ib]
    ra, ia, rb, ib = ra[ka], ia[ka], rb[kb], ib[kb]
    order = np.argsort(ib, kind="stable")
    rb, ib = rb[order], ib[order]
    first, last = np.searchsorted(ib, ia), np.searchsorted(ib, ia, side="right")
    size = last - first
    step = np.concatenate([[0], np.cumsum(size)])
    flat = out.reshape(-1)
    a0 = 0
    while a0 < len(ia):  # some millions of hits at a time
        a1 = max(a0 + 1, int(np.searchsorted(step, step[a0] + 4_000_000, side="right")) - 1)
        n = size[a0:a1]
        k = np.arange(n.sum()) - np.repeat(step[a0:a1] - step[a0], n) + np.repeat(first[a0:a1], n)
        cell = np.repeat(ra[a0:a1], n) * nb + rb[k]
        cells, hits = np.unique(cell, return_counts=True)
        flat[cells] += hits
        a0 = a1
    return out


def verify_block(n: np.ndarray, nbase: int, missing: list[np.ndarray], extra: list[np.ndarray], rows: np.ndarray, cols: np.ndarray, threshold: float) -> np.ndarray:
    """Which row and column sets have Jaccard similarity ``threshold`` or more (a set never with itself)."""
    links = np.zeros((len(rows), len(cols)), bool)
    cm, ce = _Sparse([missing[j] for j in cols]), _Sparse([extra[j] for j in cols])
    for a in range(0, len(rows), 512):
        part = rows[a : a + 512]
        rm, re_ = _Sparse([missing[i] for i in part]), _Sparse([extra[i] for i in part])
        both = nbase - rm.sizes[:, None] - cm.sizes[None, :] + _common(rm, cm, len(part), len(cols)) + _common(re_, ce, len(part), len(cols))
        either = n[part][:, None] + n[cols][None, :] - both
        links[a : a + 512] = both >= threshold * either - 1e-9
    return links


def _forest(links: np.ndarray, symmetric: bool) -> list[tuple[int, int]]:
    """Spanning forest of a symmetric or a bipartite adjacency; columns count on after rows when bipartite."""
    n, m = links.shape
    out, open_ = [], np.ones(n if symmetric else n + m, bool)
    flipped = links if symmetric else np.ascontiguousarray(links.T)
    for start in np.flatnonzero(links.any(axis=1)):
        if not open_[start]:
            continue
        open_[start], queue = False, [int(start)]
        while queue:
            i = queue.pop()
            near = np.flatnonzero(links[i] & (open_ if symmetric else open_[n:])) + (0 if symmetric else n) if i < n else np.flatnonzero(flipped[i - n] & open_[:n])
            out += [(i, j) for j in near.tolist()]
            open_[near] = False
            queue += near.tolist()
    return out


def _weighed(links: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return np.concatenate([links[a : a + 256] @ weight.astype(np.float64) for a in range(0, len(links), 256)])


def _verified(groups: DataFrame, threshold: float, block_rows: int, block_items: int) -> DataFrame:
    """Rows (c, texts, docs, other): link counts of a class in one block pair; and forest edges (c, other) with null counts."""
    sizes = groups.groupBy("label").agg(F.greatest(F.ceil(F.count("*") / block_rows), F.ceil((F.sum(F.length("missing") + F.length("extra"))) / (8 * block_items))).cast("int").alias("nb"))
    placed = (groups.join(sizes, "label").withColumn("own", F.pmod(F.xxhash64("c"), F.col("nb")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
              .select("label", "c", "n", "w", "nbase", "missing", "extra", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")))

    def check(group: pa.Table) -> pa.Table:
        c, n, w, own = (group.column(k).to_numpy() for k in ("c", "n", "w", "own"))
        sets = [[np.frombuffer(v.as_buffer(), np.uint64) for v in group.column(k)] for k in ("missing", "extra")]
        x, y = group.column("x")[0].as_py(), group.column("y")[0].as_py()
        rows, cols = np.flatnonzero(own == x), np.flatnonzero(own == y)
        links = verify_block(n, group.column("nbase")[0].as_py(), *sets, rows, cols, threshold)
        if x == y:
            np.fill_diagonal(links, False)
        sides = [(rows, links.sum(axis=1), _weighed(links, w[cols]))] + ([] if x == y else [(cols, links.sum(axis=0), _weighed(links.T, w[rows]))])
        edges = _forest(links, x == y)
        at = np.concatenate([rows, cols])
        found = [(c[i][t > 0], t[t > 0], d[t > 0]) for i, t, d in sides]
        a, b = (c[at[np.array([e[k] for e in edges], np.int64)]] for k in (0, 1))
        none = pa.nulls(len(a), pa.int64())
        return pa.table([pa.chunked_array([pa.array(np.concatenate([f[0] for f in found]), pa.int64()), pa.array(a, pa.int64())]),
                         *(pa.chunked_array([pa.array(np.concatenate([f[k] for f in found]).astype(np.int64)), none]) for k in (1, 2)),
                         pa.chunked_array([pa.nulls(sum(len(f[0]) for f in found), pa.int64()), pa.array(b, pa.int64())])], ["c", "texts", "docs", "other"])

    return placed.groupBy("label", "x", "y").applyInArrow(check, "c long, texts long, docs long, other long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8,
                    target: float = 0.9999, most_loss: float = 1e-4, node_block: int = 16_384, block_rows: int = 4096,
                    block_items: int = 2_000_000, keyed: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, class_id, copy_of, n_copies, n_links, n_text_links.

    ``class_id`` is the smallest id of the documents connected by links, ``copy_of`` the smallest id with the same shingle
    set, ``n_copies`` how many rows have it, ``n_text_links`` the number of different sets of similarity ``threshold`` or
    more, ``n_links`` the number of other rows that have such a set or the same one. ``docs`` is read twice.

    ``keyed`` adds row_key (see there) and first_key, the row key of the class's first row: that of the smallest id, a null id
    being larger than all, and among rows of this id of the smallest row key.
    """
    base = materialize(sketches(docs, id_col, text_col, size))
    classes = materialize(base.where(F.col("c").isNotNull()).groupBy("c").agg(
        F.min(F.struct(F.col("id").isNull(), "id", "row_key")).alias("head"), F.count("*").alias("w"), F.first("n").alias("n"), F.first("sig").alias("sig")))
    groups, _ = candidate_groups(classes, threshold, target, most_loss, node_block)
    groups = materialize(groups.join(classes.select("c", F.col("head.row_key").alias("row_key"), "w"), "c"))
    chosen = only_ids(docs.select(row_key(id_col, text_col).alias("row_key"), text_col), groups.select("row_key"), "row_key")
    sets = _set_rows(chosen, text_col, size).dropDuplicates(["c"])
    members = materialize(sets.join(groups, "c"))
    bases = members.where(F.col("c") == F.col("label")).select("label", F.col("items").alias("base"))
    checked = materialize(_verified(materialize(_encoded(members.join(bases, "label"))), threshold, block_rows, block_items))
    counts = checked.where(F.col("texts").isNotNull()).groupBy("c").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    linked = components(checked.where(F.col("other").isNotNull()).select(F.col("c").alias("a"), F.col("other").alias("b")))
    named = linked.join(classes.select("c", "head"), linked["v"] == classes["c"])
    smallest = named.groupBy("label").agg(F.min("head").alias("class_head"))
    found = named.join(smallest, "label").select("c", "class_head").join(counts, "c", "left")
    # written, so that the join below has a shuffle on both sides and a class of very many copies can be split
    every = materialize(classes.select("c", "head", "w").join(found, "c", "left").select(
        "c", "w", "texts", "docs", F.col("head.id").alias("first_id"), F.coalesce("class_head", "head")["id"].alias("class_id"),
        F.coalesce("class_head", "head")["row_key"].alias("first_key")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    keys = [F.col("row_key"), F.coalesce("first_key", "row_key").alias("first_key")] if keyed else []
    return base.select("id", "row_key", "c").join(every, "c", "left").select(
        F.col("id").alias(id_col), F.coalesce("class_id", "first_id", "id").alias("class_id"), F.coalesce("first_id", "id").alias("copy_of"),
        F.coalesce("w", F.lit(1)).alias("n_copies"), (zero("docs") + F.coalesce("w", F.lit(1)) - 1).alias("n_links"), zero("texts").alias("n_text_links"), *keys)
