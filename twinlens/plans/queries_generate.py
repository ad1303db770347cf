"""Generator queries over the customer table; hashed randomness makes them checkable."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from twinlens.functions.gaussian import normal_cdf_sql, normal_ppf_sql
from twinlens.functions.numbers import tidy
from twinlens.operators import generate as G
from twinlens.operators import oversample as O
from twinlens.plans import sqlkit as S
from twinlens.plans.pairs import part_pair, table
from twinlens.plans.registry import register
from twinlens.session import shared_folder

SEED = 42


def customers(spark, sf_dir) -> G.Table:
    c = table(spark, sf_dir, "customer")
    return G.Table(c.select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"), key="c_custkey")


def _shown(df):
    return df.select("sid", tidy(F.col("c_nationkey")).alias("c_nationkey"), tidy(F.col("c_acctbal")).alias("c_acctbal"),
                     "c_mktsegment")


_T = """t AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS i, c_nationkey::DOUBLE AS x, c_acctbal AS y, c_mktsegment AS g FROM customer),
n AS (SELECT count(*) AS n FROM customer), syn AS (SELECT unnest(range(n)) AS sid, n FROM n)"""
_PICK = S.index(SEED, "pick", "sid", "n")
_OUT = f"sid, {S.num('x')} AS c_nationkey, {S.num('y')} AS c_acctbal, g AS c_mktsegment"


def _draw(source: str) -> str:
    """Join the independent draw of the segment onto numbered rows."""
    return f"(SELECT s.sid, s.x, s.y, t.g FROM {source} s, n JOIN t ON t.i = {S.index(SEED, 'draw.c_mktsegment', 's.sid', 'n.n')})"


@register("g1_random_sampling", f"WITH {_T}, r AS (SELECT sid, x, y, g FROM syn JOIN t ON t.i = {_PICK}) SELECT {_OUT} FROM r")
def g1(spark, sf_dir):
    t = customers(spark, sf_dir)
    return _shown(G.random_sampling(t, t.n, SEED, keep_id=True))


@register("g2_noise_injection", f"""WITH {_T}, r AS (SELECT sid, x, y, g FROM syn JOIN t ON t.i = {_PICK}),
s AS (SELECT stddev_samp(x) AS sx, stddev_samp(y) AS sy FROM r),
q AS (SELECT sid, x + sx * 0.1 * {S.normal(SEED, 'noise.c_nationkey', 'sid')} AS x, y + sy * 0.1 * {S.normal(SEED, 'noise.c_acctbal', 'sid')} AS y, g FROM r, s)
SELECT {_OUT} FROM q""")
def g2(spark, sf_dir):
    t = customers(spark, sf_dir)
    return _shown(G.noise_injection(t, t.n, SEED, 0.1, keep_id=True))


@register("g3_kde", f"""WITH {_T}, s AS (SELECT stddev_pop(x) AS sx, stddev_pop(y) AS sy, power(count(*)::DOUBLE, -1.0 / 6) AS h FROM t),
r AS (SELECT sid, x + h * sx * {S.normal(SEED, 'kernel.c_nationkey', 'sid')} AS x, y + h * sy * {S.normal(SEED, 'kernel.c_acctbal', 'sid')} AS y
 FROM syn JOIN t ON t.i = {_PICK}, s) SELECT {_OUT} FROM {_draw('r')}""")
def g3(spark, sf_dir):
    t = customers(spark, sf_dir)
    return _shown(G.kde_sampling(t, t.n, SEED, keep_id=True))


_MVN = "l11 * z1 AS zx, l21 * z1 + l22 * z2 AS zy"


def _factor_sql(source: str, x: str, y: str) -> str:
    return (f"f AS (SELECT l11, c / l11 AS l21, sqrt(greatest(0, vy - (c / l11) * (c / l11))) AS l22, mx, my FROM (SELECT sqrt(var_samp({x})) AS l11, "
            f"covar_samp({x}, {y}) AS c, var_samp({y}) AS vy, avg({x}) AS mx, avg({y}) AS my FROM {source}))")


_Z = f"z AS (SELECT sid, n, {S.normal(SEED, 'mvn.0', 'sid')} AS z1, {S.normal(SEED, 'mvn.1', 'sid')} AS z2 FROM syn)"


@register("g4_gaussian_mvn", f"""WITH {_T}, {_factor_sql('t', 'x', 'y')}, {_Z},
r AS (SELECT sid, mx + l11 * z1 AS x, my + l21 * z1 + l22 * z2 AS y FROM z, f) SELECT {_OUT} FROM {_draw('r')}""")
def g4(spark, sf_dir):
    t = customers(spark, sf_dir)
    return _shown(G.gaussian_mvn(t, t.n, SEED, keep_id=True))


def _score_sql(c: str) -> str:
    u = f"((rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE) / (n + 1))"
    return f"{u} AS u{c}"


def _back_sql(c: str) -> str:
    h = f"(u{c} * (n - 1))"
    return (f"(SELECT {c} FROM o{c} WHERE r = floor({h})) AS lo, (SELECT {c} FROM o{c} WHERE r = least(floor({h}) + 1, n - 1)) AS hi")


@register("g5_gaussian_copula", f"""WITH {_T}, u AS (SELECT {_score_sql('x')}, {_score_sql('y')} FROM t, n),
w AS (SELECT {normal_ppf_sql('ux')} AS wx, {normal_ppf_sql('uy')} AS wy FROM u), {_factor_sql('w', 'wx', 'wy')}, {_Z},
v AS (SELECT sid, n, l11 * z1 AS a, l21 * z1 + l22 * z2 AS b FROM z, f),
h AS (SELECT sid, n, {normal_cdf_sql('a')} * (n - 1)::DOUBLE AS hx, {normal_cdf_sql('b')} * (n - 1)::DOUBLE AS hy FROM v),
ox AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS r FROM t), oy AS (SELECT y, row_number() OVER (ORDER BY y) - 1 AS r FROM t),
r AS (SELECT sid, p.x + (q.x - p.x) * (hx - floor(hx)) AS x, s.y + (e.y - s.y) * (hy - floor(hy)) AS y FROM h
 JOIN ox p ON p.r = floor(hx) JOIN ox q ON q.r = least(floor(hx) + 1, n - 1) JOIN oy s ON s.r = floor(hy) JOIN oy e ON e.r = least(floor(hy) + 1, n - 1))
SELECT sid, round(x, 4) + 0.0 AS c_nationkey, round(y, 3) + 0.0 AS c_acctbal, g AS c_mktsegment FROM {_draw('r')}""")
def g5(spark, sf_dir):
    t = customers(spark, sf_dir)
    df = G.gaussian_copula(t, t.n, SEED, keep_id=True)
    return df.select("sid", tidy(F.col("c_nationkey"), 4).alias("c_nationkey"), tidy(F.col("c_acctbal"), 3).alias("c_acctbal"),
                     "c_mktsegment")


@register("g6_dummy", f"""WITH {_T}, e AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM t),
k AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS r, count(*) OVER () AS m FROM (SELECT DISTINCT g FROM t)),
r AS (SELECT sid, floor({S.uniform(SEED, 'dummy.c_nationkey', 'sid')} * (hx - lx + 1)) + lx AS x,
 ly + {S.uniform(SEED, 'dummy.c_acctbal', 'sid')} * (hy - ly) AS y FROM syn, e)
SELECT {_OUT} FROM r JOIN k ON k.r = {S.index(SEED, 'dummy.c_mktsegment', 'sid', 'm')}""".replace("SELECT sid, round", "SELECT r.sid, round"))
def g6(spark, sf_dir):
    t = customers(spark, sf_dir)
    return _shown(G.dummy(t, t.n, SEED, keep_id=True))


_ALLOC = """ac AS (SELECT g, count(*) AS have FROM t GROUP BY g),
ar AS (SELECT g, have, (1.0::DOUBLE / have) / sum(1.0::DOUBLE / have) OVER () * (SELECT n FROM n)::DOUBLE AS raw FROM ac),
al AS (SELECT g, have, floor(raw) + CASE WHEN row_number() OVER (ORDER BY round(raw - floor(raw), 9) DESC, g)
 <= (SELECT n FROM n) - sum(floor(raw)) OVER () THEN 1 ELSE 0 END AS made FROM ar)"""


@register("g12_class_allocation", f"WITH {_T}, {_ALLOC} SELECT g AS c_mktsegment, have AS n_rows, made::BIGINT AS n_new FROM al")
def g12(spark, sf_dir):
    t = customers(spark, sf_dir)
    return G.class_allocation(t.rows, "c_mktsegment", t.n)


_D = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"


def _smote_sql(alloc: str) -> str:
    """CTEs up to ``sm``: interpolated rows (sid, x, y, g); ``al`` holds g, have, made."""
    return f"""{alloc}, st AS (SELECT *, sum(made) OVER (ORDER BY g) - made AS s0, sum(made) OVER (ORDER BY g) AS s1 FROM al),
ci AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY i) - 1 AS ci FROM t),
pk AS (SELECT sid, st.g, floor({S.uniform(SEED, 'base', 'sid')} * have) AS ci FROM (SELECT unnest(range((SELECT sum(made) FROM al)::BIGINT)) AS sid) q
 JOIN st ON sid >= s0 AND sid < s1),
nb AS (SELECT a.i AS q, b.i AS b, row_number() OVER (PARTITION BY a.i ORDER BY {_D}, b.i) AS rank FROM t a JOIN t b ON a.g = b.g AND a.i <> b.i QUALIFY rank <= 5),
sm AS (SELECT sid, a.g, a.x + {S.uniform(SEED, 'gap', 'sid')} * (b.x - a.x) AS x, a.y + {S.uniform(SEED, 'gap', 'sid')} * (b.y - a.y) AS y
 FROM pk JOIN ci a ON a.g = pk.g AND a.ci = pk.ci JOIN nb ON nb.q = a.i AND nb.rank = {S.index(SEED, 'mate', 'sid', '5')} + 1 JOIN t b ON b.i = nb.b)"""


@register("g7_smote", f"WITH {_T}, {_smote_sql(_ALLOC)} SELECT sid, trunc(x)::DOUBLE AS c_nationkey, {S.num('y')} AS c_acctbal, g AS c_mktsegment FROM sm")
def g7(spark, sf_dir):
    t = customers(spark, sf_dir)
    return _shown(O.smote(t, t.n, SEED, keep_id=True))


_GAP = S.uniform(SEED, "gap", "sid")
_TAG = "concat('T', c_custkey % 997)"
_T7 = _T.replace("c_acctbal AS y, c_mktsegment AS g", f"c_acctbal / 1000::DOUBLE AS y, c_mktsegment AS g, {_TAG} AS tag")
_TAGGED = _smote_sql(_ALLOC).replace(_D, _D[:-1] + " + 2 * CAST(a.tag <> b.tag AS INTEGER))").replace(
    "AS y\n FROM pk", f"AS y, CASE WHEN {_GAP} < 0.5 THEN a.tag WHEN {_GAP} > 0.5 THEN b.tag ELSE least(a.tag, b.tag) END AS tag\n FROM pk")


@register("g7_smote_categories", f"WITH {_T7}, {_TAGGED} SELECT sid, trunc(x)::DOUBLE AS c_nationkey, {S.num('y')} AS balance, tag, g AS c_mktsegment FROM sm")
def g7_categories(spark, sf_dir):
    """Neighbours over two numbers and a category of very many values."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", (F.col("c_acctbal") / 1000.0).alias("balance"), F.expr(_TAG).alias("tag"), "c_mktsegment")
    t = G.Table(c, key="c_custkey")
    return O.smote(t, t.n, SEED, keep_id=True).select("sid", tidy(F.col("c_nationkey")).alias("c_nationkey"), tidy(F.col("balance")).alias("balance"), "tag", "c_mktsegment")


_T8 = _T.replace("c_mktsegment AS g", "CASE WHEN c_nationkey < 4 THEN 'coast' ELSE 'inland' END AS g, c_mktsegment AS seg")
_draw8 = (f"(SELECT r.sid, r.x, r.y, p.seg || '/' || q.g AS g FROM r, n JOIN t p ON p.i = {S.index(SEED, 'draw.c_mktsegment', 'r.sid', 'n.n')} "
          f"JOIN t q ON q.i = {S.index(SEED, 'draw.tier', 'r.sid', 'n.n')})")


@register("g8_adasyn", f"""WITH {_T8}, cl AS (SELECT g, count(*) AS c FROM t GROUP BY g), rare AS (SELECT g FROM cl ORDER BY c, g LIMIT 1),
m AS (SELECT t.*, (t.g = rare.g)::INT AS r FROM t, rare), w AS (SELECT max(c) - min(c) AS w FROM cl),
ar AS (SELECT a.i AS q, b.r, row_number() OVER (PARTITION BY a.i ORDER BY {_D}, b.i) AS rank FROM m a JOIN m b ON a.i <> b.i WHERE a.r = 1 QUALIFY rank <= 5),
sh AS (SELECT q, avg(1.0 - r) AS s FROM ar GROUP BY q),
qu AS (SELECT q, round_even(round(s / sum(s) OVER () * w, 9), 0)::BIGINT AS c FROM sh, w),
po AS (SELECT q, sum(c) OVER (ORDER BY q) - c AS s0, sum(c) OVER (ORDER BY q) AS s1 FROM qu), mk AS (SELECT sum(c) AS made FROM qu),
se AS (SELECT sid, CASE WHEN made >= n THEN sid ELSE {S.index(SEED, 'again', 'sid', 'made')} END AS seat FROM syn, mk),
nb AS (SELECT a.i AS q, b.i AS b, row_number() OVER (PARTITION BY a.i ORDER BY {_D}, b.i) AS rank FROM m a JOIN m b ON a.i <> b.i WHERE a.r = 1 AND b.r = 1 QUALIFY rank <= 5),
r AS (SELECT sid, a.x + {S.uniform(SEED, 'gap', 'seat')} * (b.x - a.x) AS x, a.y + {S.uniform(SEED, 'gap', 'seat')} * (b.y - a.y) AS y FROM se
 JOIN po ON seat >= s0 AND seat < s1 JOIN nb ON nb.q = po.q AND nb.rank = {S.index(SEED, 'mate', 'seat', '5')} + 1
 JOIN m a ON a.i = po.q JOIN m b ON b.i = nb.b) SELECT {_OUT} FROM {_draw8}""")
def g8(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    t = G.Table(c.withColumn("tier", F.when(F.col("c_nationkey") < 4, "coast").otherwise("inland")), key="c_custkey")
    df = O.adasyn(t, t.n, SEED, keep_id=True)
    return _shown(df.withColumn("c_mktsegment", F.concat_ws("/", "c_mktsegment", "tier")))


_GROW = "al AS (SELECT g, count(*) AS have, count(*)::BIGINT AS made FROM t GROUP BY g)"  # as many new rows as old ones


@register("g9_smote_edited", f"""WITH {_T}, {_smote_sql(_GROW)},
gr AS (SELECT i, x, y, g FROM t UNION ALL SELECT n + sid, x, y, g FROM sm, n),
nc AS (SELECT a.i AS q, a.x, a.y, a.g AS own, b.x AS bx, b.y AS bb, b.g AS bg,
 row_number() OVER (PARTITION BY a.i ORDER BY {_D}, b.i) AS rank FROM gr a JOIN gr b ON a.i <> b.i QUALIFY rank <= 5),
ce AS (SELECT q, own, bg, min(rank) AS f, round(sqrt((avg(bx) - x) * (avg(bx) - x) + (avg(bb) - y) * (avg(bb) - y)) / (count(*) + 1), 9) AS th
 FROM nc GROUP BY q, own, bg, x, y),
vo AS (SELECT q FROM (SELECT * FROM ce QUALIFY row_number() OVER (PARTITION BY q ORDER BY th, f) = 1) WHERE bg = own),
fr AS (SELECT gr.* FROM gr JOIN vo ON q = i WHERE NOT EXISTS (SELECT 1 FROM t WHERE round(t.x, 8) = round(gr.x, 8) AND round(t.y, 8) = round(gr.y, 8))),
ra AS (SELECT *, row_number() OVER (ORDER BY i) - 1 AS r, count(*) OVER () AS have FROM fr),
ex AS (SELECT s.sid, x + 1e-6 * {S.normal(SEED, 'again.c_nationkey', 's.sid')} AS x, y + 1e-6 * {S.normal(SEED, 'again.c_acctbal', 's.sid')} AS y, g
 FROM (SELECT unnest(range((SELECT max(have) FROM ra), (SELECT n FROM n))) AS sid) s JOIN ra ON r = {S.index(SEED, 'again', 's.sid', 'have')}),
al2 AS (SELECT r AS sid, x, y, g FROM ra UNION ALL SELECT * FROM ex)
SELECT sid, trunc(x)::DOUBLE + 0.0 AS c_nationkey, {S.num('y', 4)} AS c_acctbal, g AS c_mktsegment FROM al2""")
def g9(spark, sf_dir):
    t = customers(spark, sf_dir)
    made = O.smote_edited(t, t.n, SEED, keep_id=True)
    return made.select("sid", tidy(F.col("c_nationkey")).alias("c_nationkey"), tidy(F.col("c_acctbal"), 4).alias("c_acctbal"),
                       "c_mktsegment")


def _edit_sql(strategy: str) -> str:
    kept = {"auto": "OR g = (SELECT g FROM (SELECT g, count(*) AS c FROM t GROUP BY g ORDER BY c, g LIMIT 1))", "all": ""}[strategy]
    return f"""WITH {_T}, nb AS (SELECT a.i AS q, a.x, a.y, a.g AS own, b.x AS bx, b.y AS bb, b.g AS bg,
 row_number() OVER (PARTITION BY a.i ORDER BY {_D}, b.i) AS rank FROM t a JOIN t b ON a.i <> b.i QUALIFY rank <= 5),
ce AS (SELECT q, own, bg, count(*) AS m, min(rank) AS f, round(sqrt((avg(bx) - x) * (avg(bx) - x) + (avg(bb) - y) * (avg(bb) - y)) / (count(*) + 1), 9) AS th
 FROM nb GROUP BY q, own, bg, x, y),
vo AS (SELECT q, own, bg FROM ce QUALIFY row_number() OVER (PARTITION BY q ORDER BY th, f) = 1),
ke AS (SELECT q AS i, bg = own AS keep FROM vo)
SELECT t.i AS "row", g AS segment FROM t JOIN ke USING (i) WHERE keep {kept}"""


for _strategy in ("auto", "all"):
    def _query(spark, sf_dir, strategy=_strategy):
        t = customers(spark, sf_dir)
        rows = O.encode(t.rows, O.fit_encoding(t, ["c_nationkey", "c_acctbal"]), [G.IDX, "c_mktsegment"])
        kept = O.edited(rows, ["c_nationkey", "c_acctbal"], "c_mktsegment", 5, "cd", strategy)
        return kept.select(F.col(G.IDX).alias("row"), F.col("c_mktsegment").alias("segment"))

    register(f"g10_edited_{_strategy}", _edit_sql(_strategy))(_query)


@register("g11_encode_decode", """WITH c AS (SELECT p_partkey, p_brand, p_type, p_size FROM part),
b AS (SELECT DISTINCT p_brand AS v FROM part), k AS (SELECT DISTINCT p_type AS v FROM part)
SELECT p_partkey, p_brand, p_type, p_size, (SELECT count(*) FROM b)::BIGINT + (SELECT count(*) FROM k)::BIGINT + 1 AS width FROM c""")
def g11(spark, sf_dir):
    """Encode parts, blur every category towards another one, decode by the heaviest."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand", "p_type")
    t = G.Table(p, key="p_partkey")
    e = O.fit_points(t, ["p_size", "p_brand", "p_type"])
    other = {c: p.agg(F.min(c)).first()[0] for c in e.categorical}
    blurred = e.encode(p, ["p_partkey"]).withColumns({
        c: F.struct(F.col(c)["a"].alias("a"), F.lit(other[c]).alias("b"), F.lit(0.4).alias("w")) for c in e.categorical})
    return e.decode(blurred, ["p_partkey"]).withColumn("width", F.lit(e.width(p)).cast("bigint"))


@register("g13_independent_draw", f"""WITH {_T} SELECT s.sid, a.g AS c_mktsegment, b.x::INTEGER AS c_nationkey FROM syn s
JOIN t a ON a.i = {S.index(SEED, 'draw.c_mktsegment', 's.sid', 's.n')} JOIN t b ON b.i = {S.index(SEED, 'draw.c_nationkey', 's.sid', 's.n')}""")
def g13(spark, sf_dir):
    t = customers(spark, sf_dir)
    return G.draw_columns(G.numbered(t, t.n), t, ["c_mktsegment", "c_nationkey"], SEED)


@register("g14_exact_rows", f"""WITH {_T}, d AS (SELECT n + unnest(range(n)) AS sid, n FROM n)
SELECT 'more' AS kind, i AS sid, round(y, 8) + 0.0 AS balance FROM t UNION ALL
SELECT 'more', d.sid, round(y + 1e-6 * {S.normal(SEED, 'again.balance', 'd.sid')}, 8) + 0.0 FROM d JOIN t ON t.i = {S.index(SEED, 'again', 'd.sid', 'n')} UNION ALL
SELECT 'fewer', r, y FROM (SELECT y, row_number() OVER (ORDER BY {S.uniform(SEED, 'cut', 'i')}) - 1 AS r, n FROM t, n) WHERE r < n // 3""")
def g14(spark, sf_dir):
    t = customers(spark, sf_dir)
    rows = t.rows.select(F.col(G.IDX).alias("sid"), F.col("c_acctbal").alias("balance"))
    more, fewer = G.exact_rows(rows, ["balance"], 2 * t.n, SEED), G.exact_rows(rows, ["balance"], t.n // 3, SEED)
    return (more.select(F.lit("more").alias("kind"), "sid", (F.round("balance", 8) + 0.0).alias("balance"))
            .unionByName(fewer.select(F.lit("fewer").alias("kind"), "sid", (F.round("balance", 8) + 0.0).alias("balance"))))


_O15 = "SELECT round(p_size::DOUBLE, 8) AS p_size, round(p_retailprice, 8) AS p_retailprice FROM part"
_R15 = (_O15 + " UNION ALL SELECT round(p_size * 1.1::DOUBLE, 8), round(p_retailprice * 1.03::DOUBLE + 5, 8) FROM part")


@register("g15_synthetic_only", f"""WITH o AS ({_O15}), r AS ({_R15}),
m AS (SELECT * FROM r EXCEPT ALL SELECT * FROM o), s AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.p_size = r.p_size AND o.p_retailprice = r.p_retailprice))
SELECT 'multiset' AS kind, {S.num('p_size')} AS p_size, {S.num('p_retailprice')} AS p_retailprice FROM m UNION ALL
SELECT 'set', {S.num('p_size')}, {S.num('p_retailprice')} FROM s""")
def g15(spark, sf_dir):
    pair = part_pair(spark, sf_dir)
    grown = pair.o.unionByName(pair.a)
    many = G.synthetic_only(grown, pair.o, pair.cols, multiset=True).withColumn("kind", F.lit("multiset"))
    none = G.synthetic_only(grown, pair.o, pair.cols, multiset=False).withColumn("kind", F.lit("set"))
    both = many.unionByName(none)
    return both.select("kind", *[tidy(F.col(c)).alias(c) for c in pair.cols])


_Q = " UNION ALL ".join(
    f"SELECT avg(o.{c}) AS m1, stddev_samp(o.{c}) + 1e-10 AS s1, (SELECT avg({c}) FROM a) AS m2, (SELECT stddev_samp({c}) FROM a) AS s2 FROM o"
    for c in ("p_size", "p_retailprice"))


@register("g16_simple_quality", f"""WITH o AS (SELECT p_size::DOUBLE AS p_size, p_retailprice FROM part),
a AS (SELECT p_size * 1.1::DOUBLE AS p_size, p_retailprice * 1.03::DOUBLE + 5 AS p_retailprice FROM part), q AS ({_Q}),
t AS (SELECT avg((greatest(0, 1 - abs(m1 - m2) / s1) + greatest(0, 1 - abs(s1 - 1e-10 - s2) / s1)) / 2) AS q FROM q)
{S.facts('score', 'simple_quality', 't', [('score', 'q', 6)])}""")
def g16(spark, sf_dir):
    pair = part_pair(spark, sf_dir)
    return G.simple_quality(pair.orig.drop("p_partkey"), pair.aug.drop("p_partkey"))


_NAMES = ["random_sampling", "noise_injection", "kde", "bayesian_network", "dummy", "smote", "unknown"]
_RUN = " UNION ALL ".join(
    f"SELECT '{n}' AS technique, count(*)::BIGINT AS n_rows, 3::INTEGER AS n_columns, NULL::VARCHAR AS error FROM customer" if n != "unknown"
    else "SELECT 'unknown', NULL, NULL, 'unknown technique: unknown'" for n in _NAMES)


@register("g17_technique_run", _RUN)
def g17(spark, sf_dir):
    """Every technique written on its own, one of them failing on purpose."""
    t = customers(spark, sf_dir)
    folder = f"{shared_folder(spark).rstrip('/')}/generated-{uuid.uuid4().hex}"
    return G.run_techniques(t, _NAMES, t.n, folder, SEED).select("technique", "n_rows", "n_columns", "error")
