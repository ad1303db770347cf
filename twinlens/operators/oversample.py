"""Neighbour-based oversampling and editing of labelled tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlens.functions.hashing import hash_index, hash_normal, hash_uniform
from twinlens.operators.generate import (
    GENERATORS,
    IDX,
    SID,
    TINY,
    Table,
    class_allocation,
    draw_columns,
    exact_rows,
    finish,
    numbered,
    random_sampling,
    synthetic_only,
)
from twinlens.operators.neighbors import nearest
from twinlens.operators.ranking import (
    add_buckets,
    bucket_splits,
    lookup_intervals,
    row_number_global,
    running_counts,
)
from twinlens.pair import double_or_null
from twinlens.session import materialize

MAX_CATEGORIES = 2000  # of the form with one column per category; points have no bound
# Class strategies of the editing step.
STRATEGIES = ("auto", "all", "minority", "majority", "not minority", "not majority")


@dataclass
class Encoding:
    """Numeric columns followed by one 0/1 column per category of each other column."""

    numeric: list[str]
    categories: dict[str, list]
    types: dict[str, T.DataType]
    fill: dict[str, float | None] = field(default_factory=dict)  # mean of a numeric column; None: it has no value at all

    @property
    def blocks(self) -> dict[str, list[str]]:
        return {c: [f"{c}__is{i}" for i in range(len(v))] for c, v in self.categories.items()}

    @property
    def columns(self) -> list[str]:
        return self.numeric + [b for block in self.blocks.values() for b in block]


def fit_encoding(t: Table, features: list[str]) -> Encoding:
    """Collect the sorted categories; their number is checked. A missing value is a category of its own, the last."""
    num = set(t.numeric)
    categories = {}
    for c in features:
        if c not in num:
            values = [r[0] for r in t.rows.select(c).distinct().limit(MAX_CATEGORIES + 2).collect()]
            known = sorted(v for v in values if v is not None)
            if len(known) > MAX_CATEGORIES:
                raise ValueError(f"column {c} has too many categories to one-hot encode")
            categories[c] = known + [None] * (len(known) < len(values))
    numeric = [c for c in features if c in num]
    return Encoding(numeric, categories, {c: t.type_of(c) for c in features}, column_means(t.rows, numeric))


def column_means(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    if not cols:
        return {}
    clean = df.select(*[double_or_null(df, c) for c in cols])
    return dict(zip(cols, clean.agg(*[F.avg(F.col(c)) for c in cols]).first()))


def filled(df: DataFrame, means: dict[str, float | None]) -> list[Column]:
    """Numeric columns as doubles; null and NaN become the column's mean (0 where it has no value)."""
    clean = {c: F.col(c).cast("double") for c in means}
    nan = {c: isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) for c in means}
    return [F.when(v.isNull() | (F.isnan(v) if nan[c] else F.lit(False)), F.lit(float(means[c] or 0.0))).otherwise(v).alias(c)
            for c, v in clean.items()]


def encode(df: DataFrame, e: Encoding, keep: list[str]) -> DataFrame:
    """Numeric columns as doubles and one 0/1 column per category."""
    hot = [F.when(F.col(c).isNull() if v is None else F.col(c) == F.lit(v), 1.0).otherwise(0.0).alias(b)
           for c, values in e.categories.items() for v, b in zip(values, e.blocks[c])]
    return df.select(*keep, *filled(df, {c: e.fill.get(c) for c in e.numeric}), *hot)


def decode(df: DataFrame, e: Encoding, keep: list[str]) -> DataFrame:
    """Cast numbers back to their types; each block becomes its heaviest category, first on ties."""
    cols: list[Column] = [(F.lit(None) if e.fill.get(c, 0.0) is None else F.col(c)).cast(e.types[c]).alias(c) for c in e.numeric]
    for c, values in e.categories.items():
        block = e.blocks[c]
        if not block:
            cols.append(F.lit(None).cast(e.types[c]).alias(c))
            continue
        top = F.greatest(*block) if len(block) > 1 else F.col(block[0])
        out = None
        for v, b in zip(values, block):
            hit = F.col(b) == top
            out = F.when(hit, F.lit(v)) if out is None else out.when(hit, F.lit(v))
        cols.append(out.cast(e.types[c]).alias(c))
    return df.select(*keep, *cols)


@dataclass
class Points:
    """Numeric columns as doubles, and every other column as a point (a, b, w) of the simplex of its categories.

    Interpolation never leaves the edge between two categories, so (1 - w) a + w b says what one 0/1 column per category
    would, for any number of categories; a missing value is a category of its own.
    """

    numeric: list[str]
    categorical: list[str]
    types: dict[str, T.DataType]
    fill: dict[str, float | None] = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        return self.numeric + self.categorical

    def encode(self, df: DataFrame, keep: list[str]) -> DataFrame:
        corners = [F.struct(F.col(c).alias("a"), F.col(c).alias("b"), F.lit(0.0).alias("w")).alias(c) for c in self.categorical]
        return df.select(*keep, *filled(df, {c: self.fill.get(c) for c in self.numeric}), *corners)

    def decode(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """Numbers in their types; the heavier category, on equal weights the first, a missing one last."""
        cols = [(F.lit(None) if self.fill.get(c, 0.0) is None else F.col(c)).cast(self.types[c]).alias(c) for c in self.numeric]
        for c in self.categorical:
            x = F.col(c)
            cols.append(F.when(x["w"] < 0.5, x["a"]).when(x["w"] > 0.5, x["b"]).otherwise(F.least(x["a"], x["b"])).cast(self.types[c]).alias(c))
        return df.select(*keep, *cols)

    def width(self, df: DataFrame) -> int:
        """Number of 0/1 and numeric columns this stands for."""
        if not self.categorical:
            return len(self.numeric)
        counts = [df.select(c).distinct().count() for c in self.categorical]
        return len(self.numeric) + sum(counts)


def fit_points(t: Table, features: list[str]) -> Points:
    num = set(t.numeric)
    numeric = [c for c in features if c in num]
    return Points(numeric, [c for c in features if c not in num], {c: t.type_of(c) for c in features}, column_means(t.rows, numeric))


def _dot(p: Column, q: Column) -> Column:
    """Scalar product of two points of a categorical column."""
    same = lambda x, y: p[x].eqNullSafe(q[y]).cast("double")
    u, v = p["w"], q["w"]
    return (1 - u) * (1 - v) * same("a", "a") + u * v * same("b", "b") + (1 - u) * v * same("a", "b") + u * (1 - v) * same("b", "a")


def _centre_gap(points: Column, own: Column) -> Column:
    """Squared distance between the mean of some points and a point."""
    m = F.size(points)
    total = lambda f: F.aggregate(points, F.lit(0.0), lambda acc, p: acc + f(p))
    square = total(lambda p: F.aggregate(points, F.lit(0.0), lambda acc, q: acc + _dot(p, q)))
    return F.greatest(square / (m * m) - 2 * total(lambda p: _dot(p, own)) / m + _dot(own, own), F.lit(0.0))


def _starts(plan: DataFrame, label: str) -> DataFrame:
    """Classes that get rows, in order of label, with their range [__s0, __s1) of synthetic numbers; written once."""
    wanted = plan.where(F.col("n_new") > 0)
    n = wanted.count()
    placed = row_number_global(wanted, label, "__no", n_rows=n).withColumn("axis", F.col("__no").cast("double"))
    splits = bucket_splits(placed, ["axis"], n) if n else {"axis": None}
    sums = running_counts(add_buckets(placed, splits).withColumn("one", F.lit(1)), ["one"], "axis__b", "axis", ["n_new"], not splits["axis"]) if n else (
        placed.withColumns({"n_new_before": F.col("n_new"), "n_new_upto": F.col("n_new")}))
    return materialize(sums.select(label, F.col("n_rows").alias("__have"), "n_new", F.col("n_new_before").alias("__s0"), F.col("n_new_upto").alias("__s1")))


def interpolate(encoded: DataFrame, e: Points, label: str, plan: DataFrame, seed: int, k_max: int = 5) -> DataFrame:
    """Synthetic encoded rows: ``plan`` holds (label, n_rows, n_new) per class.

    A synthetic row lies between a random row of its class and one of that row's k
    nearest class mates; one gap serves all columns. A class of one row, or no room for
    neighbours, gives copies with tiny noise. Neighbours are searched only for rows that
    were picked.
    """
    starts = _starts(plan, label)
    n, several = starts.agg(F.sum("n_new"), F.min(F.when(F.col("__have") > 1, F.col("__have")))).first()
    if not n:
        return encoded.limit(0).select(F.lit(0).cast("bigint").alias(SID), *e.columns, label)
    k = min(k_max, several - 1) if several else 0
    within = row_number_global(encoded, IDX, "__ci", by=[label])
    seats = encoded.sparkSession.range(n).withColumnRenamed("id", SID)
    pick = (lookup_intervals(seats, SID, starts.drop("n_new"), "__s0", "__s1").drop("__s0", "__s1")
            .withColumn("__ci", F.floor(hash_uniform(seed, "base", F.col(SID)) * F.col("__have")).cast("bigint")))
    base = pick.join(within, [label, "__ci"]).drop("__ci")
    noise = {c: F.col(c) + F.lit(TINY) * hash_normal(seed, f"copy.{c}", F.col(SID)) for c in e.numeric}
    if k < 1:
        return base.withColumns(noise).select(SID, *e.columns, label)
    base = materialize(base)
    copies = base.where("__have = 1").withColumns(noise).select(SID, *e.columns, label)
    pairs = base.where("__have > 1")
    asked = pairs.select(IDX, label, *e.columns).dropDuplicates([IDX])
    mates = nearest(asked, encoded, e.numeric, [1.0] * len(e.numeric), k, qid=IDX, bid=IDX, same=label, skip_self=True, cats=e.categorical)
    other = encoded.select(F.col(IDX).alias("bid"), *[F.col(c).alias(f"{c}__mate") for c in e.columns])
    linked = (pairs.withColumn("rank", hash_index(seed, "mate", F.col(SID), k).cast("int") + 1)
              .withColumn("gap", hash_uniform(seed, "gap", F.col(SID)))
              .join(mates.select(F.col("qid").alias(IDX), "bid", "rank"), [IDX, "rank"]).join(other, "bid"))
    mixed = linked.withColumns({
        **{c: F.col(c) + F.col("gap") * (F.col(f"{c}__mate") - F.col(c)) for c in e.numeric},
        **{c: F.struct(F.col(c)["a"].alias("a"), F.col(f"{c}__mate")["a"].alias("b"), F.col("gap").alias("w")) for c in e.categorical}})
    return mixed.select(SID, *e.columns, label).unionByName(copies)


def _features(t: Table) -> list[str]:
    return [c for c in t.columns if c != t.target]


def smote(t: Table, n: int, seed: int = 42, keep_id: bool = False) -> DataFrame:
    """n synthetic rows, shared out over the classes by inverse frequency.

    Missing numbers count as their column's mean, missing categories as a category; rows without a class teach nothing,
    and a table of only such rows is sampled.
    """
    if n <= 0:
        return finish(t.rows.limit(0).withColumn(SID, F.lit(0).cast("bigint")), t, keep_id)
    e = fit_points(t, _features(t))
    encoded = materialize(e.encode(t.rows.where(F.col(t.target).isNotNull()), [IDX, t.target]))
    plan = materialize(class_allocation(encoded, t.target, n))
    classes = plan.count()
    if not classes:
        return random_sampling(t, n, seed, keep_id)
    made = interpolate(encoded, e, t.target, plan, seed, k_max=0 if classes == 1 else 5)  # one class: copies
    return finish(e.decode(made, [SID, t.target]), t, keep_id)


def adasyn(t: Table, n: int, seed: int = 42, label: str | None = None, pseudo_label: bool = False,
           keep_id: bool = False) -> DataFrame:
    """Minority rows in mixed neighbourhoods get more synthetic rows.

    Numeric columns are interpolated (missing numbers count as their column's mean), the others drawn by frequency. ``pseudo_label``
    declares the first min(n // 10, 5) rows the minority instead of reading ``label``.
    """
    if len(t.numeric) < 2:
        return random_sampling(t, n, seed, keep_id)
    label = label or t.target
    cols = [c for c in t.numeric if pseudo_label or c != label]
    flag = F.col(IDX) < min(t.n // 10, 5) if pseudo_label else None
    if flag is None:
        first = t.rows.where(F.col(label).isNotNull()).groupBy(label).count().orderBy("count", label).first()
        if first is None:
            return random_sampling(t, n, seed, keep_id)
        flag = F.coalesce(F.col(label) == F.lit(first[0]), F.lit(False))
    x = materialize(t.rows.select(IDX, *filled(t.rows, column_means(t.rows, cols)), flag.cast("int").alias("__rare")))
    n_rare = x.where("__rare = 1").count()
    k = min(5, t.n - 1)
    mates_k = min(k, n_rare - 1)
    want = t.n - 2 * n_rare
    if pseudo_label is False:
        want = t.rows.where(F.col(label).isNotNull()).groupBy(label).count().agg(F.max("count")).first()[0] - n_rare
    if mates_k < 1 or want < 1:
        return random_sampling(t, n, seed, keep_id)
    one = [1.0] * len(cols)
    rare_rows = x.where("__rare = 1").drop("__rare")
    around = nearest(rare_rows, x, cols, one, k, qid=IDX, bid=IDX, skip_self=True)
    share = (around.join(x.select(F.col(IDX).alias("bid"), "__rare"), "bid")
             .groupBy("qid").agg(F.avg(1.0 - F.col("__rare")).alias("r")))
    share = materialize(share)
    total = share.agg(F.sum("r")).first()[0]
    if not total:
        return random_sampling(t, n, seed, keep_id)
    quota = share.select("qid", F.rint(F.round(F.col("r") / F.lit(total) * F.lit(float(want)), 9)).cast("bigint").alias("w"))
    # running totals over the rare rows give every row its range of synthetic numbers
    keyed = quota.withColumn("axis", F.col("qid").cast("double"))
    splits = bucket_splits(keyed, ["axis"], n_rare)
    placed = running_counts(add_buckets(keyed, splits).withColumn("one", F.lit(1)), ["one"], "axis__b", "axis", ["w"],
                            not splits["axis"]).select("qid", "w_before", "w_upto")
    placed = materialize(placed)
    made = placed.agg(F.max("w_upto")).first()[0]
    if not made:
        return random_sampling(t, n, seed, keep_id)
    seat = numbered(t, n).withColumn("seat", F.col(SID) if made >= n else hash_index(seed, "again", F.col(SID), made))
    owner = lookup_intervals(seat, "seat", placed, "w_before", "w_upto")
    mates = nearest(rare_rows, rare_rows, cols, one, mates_k, qid=IDX, bid=IDX, skip_self=True)
    step = (owner.withColumn("rank", hash_index(seed, "mate", F.col("seat"), mates_k).cast("int") + 1)
            .withColumn("gap", hash_uniform(seed, "gap", F.col("seat")))
            .join(mates.select("qid", "bid", "rank"), ["qid", "rank"])
            .join(x.select(F.col(IDX).alias("qid"), *cols), "qid")
            .join(x.select(F.col(IDX).alias("bid"), *[F.col(c).alias(f"{c}__mate") for c in cols]), "bid"))
    mixed = step.select(SID, *[(F.col(c) + F.col("gap") * (F.col(f"{c}__mate") - F.col(c))).alias(c) for c in cols])
    mixed = mixed.withColumns({c: F.lit(None).cast("double") for c, m in column_means(t.rows, cols).items() if m is None})
    return finish(draw_columns(mixed, t, [c for c in t.columns if c not in cols], seed), t, keep_id)


def displacement_votes(df: DataFrame, cols: list[str], label: str, k: int, kind: str = "cd", id_col: str = IDX,
                       cats: list[str] | None = None) -> DataFrame:
    """(id, keep): rows whose neighbourhood supports their label.

    ``cd``: the class whose neighbour centroid moves least when the row joins it, i.e.
    the smallest |centroid - row| / (members + 1), nearer neighbour first on ties, must be
    the row's own. ``all``: the k neighbours agree among themselves. ``cats`` are points of categorical columns.
    """
    cats = list(cats or [])
    around = nearest(df, df, cols, [1.0] * len(cols), k, qid=id_col, bid=id_col, skip_self=True, cats=cats)
    mate = df.select(F.col(id_col).alias("bid"), F.col(label).alias("__mate"), *[F.col(c).alias(f"{c}__m") for c in [*cols, *cats]])
    near = around.join(mate, "bid")
    if kind == "all":
        return near.groupBy("qid").agg((F.min("__mate") == F.max("__mate")).alias("keep")).withColumnRenamed("qid", id_col)
    # at most k neighbours per row: both groupings are tiny
    centres = near.groupBy("qid", "__mate").agg(
        F.count(F.lit(1)).alias("m"), F.min("rank").alias("first"), *[F.avg(f"{c}__m").alias(f"{c}__c") for c in cols],
        *[F.collect_list(f"{c}__m").alias(f"{c}__c") for c in cats])
    own = df.select(F.col(id_col).alias("qid"), F.col(label).alias("__own"), *cols, *cats)
    square = sum(((F.col(f"{c}__c") - F.col(c)) * (F.col(f"{c}__c") - F.col(c)) for c in cols), F.lit(0.0))
    gap = F.sqrt(sum((_centre_gap(F.col(f"{c}__c"), F.col(c)) for c in cats), square))
    moved = centres.join(own, "qid").withColumn("theta", F.round(gap / (F.col("m") + 1), 9))
    vote = moved.groupBy("qid").agg(F.min(F.struct("theta", "first", "__mate")).alias("v"), F.first("__own").alias("own"))
    return vote.select(F.col("qid").alias(id_col), (F.col("v")["__mate"] == F.col("own")).alias("keep"))


def edited(df: DataFrame, cols: list[str], label: str, k: int = 5, kind: str = "cd", strategy: str = "auto",
           id_col: str = IDX, cats: list[str] | None = None) -> DataFrame:
    """Rows that survive centroid-displacement editing; the strategy spares whole classes.

    Rows with a missing coordinate have no neighbourhood and stay.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    votes = displacement_votes(df, cols, label, k, kind, id_col, cats)
    kept = F.coalesce("keep", F.lit(True))
    if strategy != "all":
        sizes = materialize(df.groupBy(label).count())
        rare, common = sizes.orderBy("count", label).first(), sizes.orderBy(F.desc("count"), label).first()
        if rare is None:
            return df
        is_rare, is_common = F.col(label).eqNullSafe(F.lit(rare[0])), F.col(label).eqNullSafe(F.lit(common[0]))
        kept = kept | {"auto": is_rare, "not minority": is_rare, "not majority": is_common, "majority": ~is_common, "minority": ~is_rare}[strategy]
    return df.join(votes, id_col, "left").where(kept).drop("keep")


def fresh_rows(made: DataFrame, original: DataFrame, e: Points) -> DataFrame:
    """Rows of ``made`` that equal no original row after rounding; a point between two categories equals none."""
    if not e.categorical:
        return synthetic_only(made, original, e.columns, multiset=False)

    def category(c: str) -> Column:
        x = F.col(c)
        w = F.round(x["w"], 8)
        return F.when((w == 0) | x["a"].eqNullSafe(x["b"]), x["a"]).when(w == 1, x["b"])

    def between(c: str) -> Column:
        x = F.col(c)
        return ~(x["a"].eqNullSafe(x["b"]) | F.round(x["w"], 8).isin(0.0, 1.0))

    keys = [*[F.round(F.col(c), 8) for c in e.numeric], *[category(c) for c in e.categorical], F.lit(False)]
    old = original.select(*[k.alias(f"__k{i}") for i, k in enumerate(keys)]).distinct()
    keys[-1] = sum((between(c).cast("int") for c in e.categorical), F.lit(0)) > 0
    match = F.lit(True)
    for i, k in enumerate(keys):
        match = match & k.eqNullSafe(F.col(f"__k{i}"))
    return made.join(old, match, "left_anti")


def smote_edited(t: Table, n: int, seed: int = 42, n_neighbors: int = 5, kind_sel: str = "cd",
                 cdnn_strategy: str = "all", keep_id: bool = False) -> DataFrame:
    """Proportional oversampling, editing of originals and synthetic rows together, originals dropped."""
    e = fit_points(t, _features(t))
    encoded = materialize(e.encode(t.rows.where(F.col(t.target).isNotNull()), [IDX, t.target]))
    counts = materialize(encoded.groupBy(t.target).agg(F.count(F.lit(1)).alias("n_rows")))
    smallest, total = counts.agg(F.coalesce(F.min("n_rows"), F.lit(0)), F.coalesce(F.sum("n_rows"), F.lit(0))).first()
    if smallest < 2 or n <= 0:
        return smote(t, n, seed, keep_id)
    k = max(1, min(n_neighbors, smallest - 1))
    plan = counts.withColumn("n_new", F.floor(F.col("n_rows") * F.lit(1 + n / total)).cast("bigint") - F.col("n_rows"))
    made = interpolate(encoded, e, t.target, plan, seed, k_max=k)
    grown = encoded.unionByName(made.withColumn(IDX, F.col(SID) + F.lit(t.n)).drop(SID))
    survivors = edited(materialize(grown), e.numeric, t.target, k, kind_sel, cdnn_strategy, cats=e.categorical)
    fresh = materialize(fresh_rows(survivors, encoded, e))
    if fresh.isEmpty():
        return smote(t, n, seed, keep_id)
    sized = exact_rows(fresh.withColumnRenamed(IDX, SID), e.numeric, n, seed)
    return finish(e.decode(sized, [SID, t.target]), t, keep_id)


GENERATORS.update({"smote": smote, "adasyn": adasyn, "smotecdnn": smote_edited})
