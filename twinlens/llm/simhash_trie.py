"""SimHash near-duplicates by a binary trie joined with itself.

A text's fingerprint has a bit set where more than half of the XXH64 hashes of its shingles have it. The distinct
fingerprints form a binary trie. The join walks pairs of trie nodes of one depth together, from the root with itself down, adds up
the bits in which their prefixes differ, and drops a pair once these exceed the budget; children of one node meet each
other and themselves, children of different nodes meet all.

The upper part of the walk runs on Spark: nodes with their sizes, and node pairs, are tables, a few bits deeper each round,
until a node holds at most ``block`` fingerprints. Dense prefixes simply go deeper, so no node is larger, whatever the data.
Pairs of such leaves are walked on inside tasks, down to a few fingerprints, which are compared. A task returns a spanning
forest of the links it found; a component is never held in one place.

Results for odd input: a null text is an empty one; texts without words have fingerprint zero, which links like any other;
fewer words than a shingle make one shingle; a component's id is its smallest id, null only if all its ids are; rows
that repeat an id stay rows of their own; long texts are read whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlens.llm.components import components
from twinlens.llm.hot import attach
from twinlens.session import materialize

BITS = 64
PIECE = 1 << 16  # shingles of a text hashed at once
FEW = 32  # fingerprints of a node that are compared rather than walked
FRONT = 1 << 17  # node pairs a task walks side by side


def fingerprint(text: bytes, size: int = 3, seed: int = 42) -> int:
    """SimHash of the lower-cased text's shingles of ``size`` words."""
    words = text.lower().split()  # bytes: A-Z alone, and the six ASCII white-space characters
    if not words:
        return 0
    if len(words) < size:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1].tolist()
    ends = ends[size - 1 :].tolist()
    counts = np.zeros(BITS, np.int64)
    for a in range(0, len(starts), PIECE):
        part = [joined[x:y] for x, y in zip(starts[a : a + PIECE], ends[a : a + PIECE])]
        h = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(seed)), np.uint64, len(part))
        counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(starts), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, f): the fingerprint of every text, its 64 bits as a long."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", size) for t in batch.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["id", "f"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, f"id {kind}, f long")


def _children(a: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """Where the ones of ``bit`` begin in ranges of the sorted ``a`` whose higher bits are equal."""
    one = np.uint64(1) << np.uint64(bit)
    above = a[lo] & ~(one | (one - np.uint64(1)))
    return np.clip(np.searchsorted(a, above | one), lo, hi)


def linked(a: np.ndarray, b: np.ndarray, same: bool, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all (a, b) that differ in at most ``budget`` bits; both sorted and distinct. With ``same`` a is b, and every
    pair comes once."""
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    zero = np.zeros(1, np.int64)
    todo = [(BITS - 1, zero, zero + len(a), zero, zero + len(b), zero)] if len(a) and len(b) else []
    while todo:
        bit, alo, ahi, blo, bhi, d = todo.pop()
        if len(alo) > FRONT:
            half = len(alo) // 2
            todo += [(bit, *(x[half:] for x in (alo, ahi, blo, bhi, d))), (bit, *(x[:half] for x in (alo, ahi, blo, bhi, d)))]
            continue
        small = ((ahi - alo <= FEW) & (bhi - blo <= FEW)) | (bit < 0)
        i, j = _compared(a, b, *(x[small] for x in (alo, ahi, blo, bhi)), same, budget)
        found_a.append(i)
        found_b.append(j)
        alo, ahi, blo, bhi, d = (x[~small] for x in (alo, ahi, blo, bhi, d))
        if not len(alo):
            continue
        am, bm = _children(a, alo, ahi, bit), _children(b, blo, bhi, bit)
        twin = (alo == blo) & same
        kids = [(alo, am, blo, bm, d), (am, ahi, bm, bhi, d), (alo, am, bm, bhi, d + 1), tuple(x[~twin] for x in (am, ahi, blo, bm, d + 1))]
        alo, ahi, blo, bhi, d = (np.concatenate(x) for x in zip(*kids))
        alive = (alo < ahi) & (blo < bhi) & (d <= budget)
        todo.append((bit - 1, *(x[alive] for x in (alo, ahi, blo, bhi, d))))
    return np.concatenate(found_a), np.concatenate(found_b)


def _compared(a, b, alo, ahi, blo, bhi, same: bool, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within the budget among some small node pairs."""
    wide = bhi - blo
    cells = (ahi - alo) * wide
    step, out = np.concatenate([[0], np.cumsum(cells)]), ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)])
    p0 = 0
    while p0 < len(cells):
        p1 = max(p0 + 1, int(np.searchsorted(step, step[p0] + 2_000_000, side="right")) - 1)
        n = cells[p0:p1]
        pair = np.repeat(np.arange(p0, p1), n)
        k = np.arange(len(pair)) - (step[pair] - step[p0])
        i, j = alo[pair] + k // wide[pair], blo[pair] + k % wide[pair]
        hit = np.bitwise_count(a[i] ^ b[j]) <= budget
        if same:
            hit &= i < j
        out[0].append(i[hit])
        out[1].append(j[hit])
        p0 = p1
    return np.concatenate(out[0]), np.concatenate(out[1])


def forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the same vertices as (i, j): every vertex with the smallest one it reaches."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        for at in (i, j, label[i], label[j]):
            np.minimum.at(new, at, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def _prefix(f: Column | str, depth: int) -> Column:
    return F.shiftrightunsigned(f, BITS - depth) if depth else F.lit(0).cast("long")


def _leaves(prints: DataFrame, block: int, step: int, most_broadcast: int) -> tuple[DataFrame, list[DataFrame]]:
    """(f, dep, pre): the leaf every fingerprint of ``prints`` (f) falls into; and the nodes (dep, pre, open) of every round."""
    placed, rounds, rest = [], [], prints
    for depth in range(0, BITS + 1, step):
        named = rest.withColumn("pre", _prefix("f", depth))
        nodes = materialize(named.groupBy("pre").agg(F.count("*").alias("n")).select(F.lit(depth).alias("dep"), "pre", (F.col("n") > block).alias("open")))
        rounds.append(nodes)
        wide = nodes.where("open").select("pre")
        n_open = wide.count()
        if n_open == 0:
            placed.append(named.select("f", F.lit(depth).alias("dep"), "pre"))
            break
        wide = F.broadcast(wide) if n_open <= most_broadcast else wide
        placed.append(named.join(wide, "pre", "left_anti").select("f", F.lit(depth).alias("dep"), "pre"))
        rest = materialize(named.join(wide, "pre", "left_semi").select("f"))
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    return out, rounds


def _shared(pre: str, dep: str, other: str) -> Column:
    """The first bits of a node, as many as the less deep of the two has."""
    return F.expr(f"shiftrightunsigned({pre}, {dep} - least({dep}, {other}))")


def _leaf_pairs(rounds: list[DataFrame], budget: int, step: int) -> DataFrame:
    """(ad, ap, bd, bp): pairs of leaves whose common depth differs in at most ``budget`` bits, the first not after the second."""
    name = lambda s: [F.col("dep").alias(f"{s}d"), F.col("pre").alias(f"{s}p"), F.col("open").alias(f"{s}o")]
    pairs, out = rounds[0].select(*name("a"), *name("b")), []
    for nodes in rounds[1:]:
        out.append(pairs.where("not ao and not bo"))
        kids = nodes.withColumn("up", F.shiftrightunsigned("pre", step))
        ka, kb = kids.select(F.col("up").alias("ua"), *[c.alias(f"k{n}") for c, n in zip(name("a"), ("ad", "ap", "ao"))]), kids.select(
            F.col("up").alias("ub"), *[c.alias(f"k{n}") for c, n in zip(name("b"), ("bd", "bp", "bo"))])
        wide = pairs.where("ao or bo").withColumns({"twin": F.expr("ad = bd and ap = bp"), "ja": F.expr("if(ao, ap, null)"), "jb": F.expr("if(bo, bp, null)")})
        met = wide.join(ka, wide["ja"] == ka["ua"], "left").join(kb, wide["jb"] == kb["ub"], "left")
        deeper = met.select("twin", *[F.coalesce(F.col(f"k{c}"), F.col(c)).alias(c) for c in ("ad", "ap", "ao", "bd", "bp", "bo")])
        differing = F.bit_count(_shared("ap", "ad", "bd").bitwiseXOR(_shared("bp", "bd", "ad")))
        pairs = materialize(deeper.where((~F.col("twin") | (F.col("ap") <= F.col("bp"))) & (differing <= budget)).drop("twin"))
    out.append(pairs)
    every = out[0]
    for p in out[1:]:
        every = every.unionByName(p)
    return every.select("ad", "ap", "bd", "bp")


def links(prints: DataFrame, budget: int = 2, block: int = 32_768, step: int = 4, most_broadcast: int = 500_000) -> DataFrame:
    """(a, b): links that connect the fingerprints of ``prints`` (f, distinct) as all pairs within ``budget`` bits do."""
    leaves, rounds = _leaves(prints, block, step, most_broadcast)
    leaves = materialize(leaves)
    pairs = materialize(_leaf_pairs(rounds, budget, step))
    side = lambda s: pairs.select("ad", "ap", "bd", "bp", F.lit(s).alias("side"), F.col(f"{s}d").alias("dep"), F.col(f"{s}p").alias("pre"))
    met = side("a").unionByName(side("b").where("ad <> bd or ap <> bp")).join(leaves, ["dep", "pre"])

    def walk(group: pa.Table) -> pa.Table:
        f, first = group.column("f").to_numpy().view(np.uint64), np.array(group.column("side").to_pylist()) == "a"
        a, b = np.sort(f[first]), np.sort(f[~first])
        same = not len(b)
        i, j = linked(a, a if same else b, same, budget)
        every = a if same else np.concatenate([a, b])
        v, root = forest(i, j if same else j + len(a), len(every))
        return pa.table([pa.array(every[v].view(np.int64)), pa.array(every[root].view(np.int64))], ["a", "b"])

    return met.select("ad", "ap", "bd", "bp", "side", "f").groupBy("ad", "ap", "bd", "bp").applyInArrow(walk, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, budget: int = 2, block: int = 32_768, step: int = 4) -> DataFrame:
    """(id_col, fingerprint, component_id) of every row: the fingerprint in 16 hex digits, and the smallest id among the rows
    that links of at most ``budget`` differing bits connect with it."""
    base = materialize(fingerprints(docs, id_col, text_col, size))
    prints = materialize(base.groupBy("f").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    total = prints.agg(F.sum("n")).first()[0] or 0
    grown = components(links(prints.select("f"), budget, block, step))
    named = materialize(prints.join(grown, prints["f"] == grown["v"], "left").select("f", "first", "n", F.coalesce("label", "f").alias("label")))
    least = materialize(named.groupBy("label").agg(F.min("first").alias("component_id"), F.count("*").alias("members")))
    facts = materialize(attach(named.select("f", "n", "label"), least, "label", "members", least.agg(F.sum("members")).first()[0] or 0).select("f", "n", "component_id"))
    hexes = F.lower(F.lpad(F.hex("f"), 16, "0"))
    return attach(base, facts, "f", "n", total).select(F.col("id").alias(id_col), hexes.alias("fingerprint"), "component_id")
