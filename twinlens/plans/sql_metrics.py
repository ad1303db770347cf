"""Check SQL of the metrics for any pair given as CTE text ``o`` and ``a``."""

from __future__ import annotations

from twinlens.plans import sqlkit as S

DRAWN_SHIFTS = 16  # pairs a row in the SQL of intra-diversity over drawn pairs


def fidelity_sql(pair: str, cols: list[str]) -> dict[str, str]:
    out = {}

    def fact(metric, source, entries, feature="NULL::VARCHAR"):
        return S.facts("fidelity", metric, source, entries, feature)

    stats = f"{pair},\n{S.stats(cols)}"
    f1_sql = f"""WITH {stats}, d AS (SELECT feature, abs(o_mean - a_mean) / (o_ss + 1e-10) AS d FROM s),
    t AS (SELECT avg(d) AS m, max(d) AS x, min(d) AS n FROM d)
    {fact('mean_absolute_distance', 'd', [('distance', 'd', 6)], 'feature')} UNION ALL
    {fact('mean_absolute_distance', 't', [('overall_distance', 'm', 6), ('max_distance', 'x', 6), ('min_distance', 'n', 6)])}"""
    out["f1_mean_absolute_distance"] = f1_sql
    f2_sql = f"""WITH {stats}, {S.ecdf()}, {S.pvalue('g')}, t AS (SELECT avg(p) AS p FROM k)
    {fact('kolmogorov_smirnov', 'k', [('statistic', 'd', 6), ('pvalue', 'p', 6), ('similar', 'p > 0.05', 'word')], 'feature')} UNION ALL
    {fact('kolmogorov_smirnov', 't', [('average_pvalue', 'p', 6), ('similarity_score', 'p', 6)])}"""
    out["f2_ks_statistic"] = f2_sql
    angle = " + ".join(f"w_{c} * {c} / sd_{c}" for c in cols)
    waves = ", ".join(f"sqrt(2.0::DOUBLE) * {S.normal(42, 'mmd.' + c, 'j')} AS w_{c}" for c in cols)
    f3_sql = f"""WITH {pair}, {S.scales('o', cols)},
    w AS (SELECT j, 6.283185307179586::DOUBLE * {S.uniform(42, 'mmd.phase', 'j')} AS b, {waves} FROM range(512) r(j)),
    x AS (SELECT j, avg(cos({angle} + b)) AS v FROM o, w, sd GROUP BY j), y AS (SELECT j, avg(cos({angle} + b)) AS v FROM a, w, sd GROUP BY j),
    m AS (SELECT sqrt(2 * avg((x.v - y.v) * (x.v - y.v))) AS m FROM x JOIN y USING (j))
    {fact('mmd_score', 'm', [('mmd_score', 'm', 6), ('quality', S.grade('m', [('high', '<', 0.1), ('medium', '<', 0.3)], 'low'), 'word')])}"""
    out["f3_mmd"] = f3_sql
    x, y = cols[:2]  # the closed form holds for two columns
    # two standardised columns have the axes (1, 1) and (1, -1) with variances 1 + r and 1 - r
    f4_sql = f"""WITH {pair}, z AS (SELECT avg({x}) AS m1, stddev_pop({x}) AS s1, avg({y}) AS m2,
     stddev_pop({y}) AS s2, corr({x}, {y}) AS r FROM o),
    p AS (SELECT t, ({x} - m1) / s1 AS u, ({y} - m2) / s2 AS v, CASE WHEN r >= 0 THEN 1 ELSE -1 END AS sg
     FROM (SELECT 0 AS t, * FROM o UNION ALL SELECT 1, * FROM a), z),
    w AS (SELECT t, round((u + sg * v) / sqrt(2.0), 9) AS pc1, round((u - sg * v) / sqrt(2.0), 9) AS pc2 FROM p),
    c AS (SELECT feature, value, sum(1 - t) AS x, sum(t) AS y FROM (SELECT t, 'pc1' AS feature, pc1 AS value FROM w UNION ALL
     SELECT t, 'pc2', pc2 FROM w) GROUP BY feature, value),
    e AS (SELECT feature, n_o, n_a, sum(x) OVER q / n_o AS fo, sum(y) OVER q / n_a AS fa FROM (SELECT *,
     sum(x) OVER (PARTITION BY feature)::DOUBLE AS n_o, sum(y) OVER (PARTITION BY feature)::DOUBLE AS n_a FROM c)
     WINDOW q AS (PARTITION BY feature ORDER BY value)),
    g AS (SELECT feature, max(abs(fo - fa)) AS d, max(n_o) AS n_o, max(n_a) AS n_a FROM e GROUP BY feature),
    {S.pvalue('g')},
    k2 AS (SELECT k.*, CASE feature WHEN 'pc1' THEN (1 + abs(r)) / 2 ELSE (1 - abs(r)) / 2 END AS ev FROM k, z),
    t AS (SELECT avg(p) AS p, count(*) AS n FROM k)
    {fact('pca_comparison', 'k2', [('component_similarity', 'p', 6), ('explained_variance', 'ev', 6)], 'feature')} UNION ALL
    {fact('pca_comparison', 't', [('average_component_similarity', 'p', 6), ('n_components', 'n', 6)])}"""
    out["f4_pca_similarity"] = f4_sql
    def moments(t: str) -> str:
        return (f"SELECT feature, avg(power(value - mean, 3)) / power(sp, 3) AS {t}_sk, avg(power(value - mean, 4)) / power(sp, 4) - 3 "
                f"AS {t}_ku FROM (SELECT m.feature, m.value, s.{t}_mean AS mean, s.{t}_sp AS sp FROM {t}m m JOIN s USING (feature)) "
                "GROUP BY feature, sp")
    f5_cte_sql = f"""WITH {stats}, {S.ecdf()},
    h AS (SELECT * FROM s JOIN ({moments('o')}) USING (feature) JOIN ({moments('a')}) USING (feature) JOIN g USING (feature)),
    p AS (SELECT *, abs(o_mean - a_mean) AS md, abs(o_sp - a_sp) AS sdd, abs(o_sk - a_sk) AS skd, abs(o_ku - a_ku) AS kud,
     greatest(sqrt((o_sp * o_sp + a_sp * a_sp) / 2), 1e-8) AS pooled, greatest(abs(o_sk), abs(a_sk), 1) AS sks,
     greatest(abs(o_ku), abs(a_ku), 1) AS kus FROM h),
    q AS (SELECT *, 0.4 * md / pooled + 0.2 * sdd / pooled + 0.2 * skd / sks + 0.2 * kud / kus AS comp FROM p),
    t AS (SELECT avg(comp) AS m, max(comp) AS x FROM q)"""
    f5_sql = f"""{f5_cte_sql}
    {fact('statistical_moments', 'q', [('mean_diff', 'md', 4), ('std_diff', 'sdd', 4), ('skew_diff', 'skd', 4), ('kurt_diff', 'kud', 4),
     ('cohens_d', 'md / pooled', 4), ('std_rel', 'sdd / pooled', 4), ('skew_norm', 'skd / sks', 4), ('kurt_norm', 'kud / kus', 4),
     ('composite_score', 'comp', 6), ('wasserstein', 'w', 4), ('ks_stat', 'd', 6)], 'feature')} UNION ALL
    {fact('statistical_moments', 't', [('average_moment_difference', 'm', 6), ('max_moment_difference', 'x', 6),
     ('stat_badge', "CASE WHEN m <= 0.2 THEN 'high' WHEN m >= 0.5 THEN 'low' ELSE 'medium' END", 'word')])}"""
    out["f5_statistical_moments"] = f5_sql
    out["f6_wasserstein"] = f"WITH {stats}, {S.ecdf()} SELECT feature, {S.num('w', 4)} AS wasserstein FROM g"
    hist_sql = f"""{stats},
    b AS (SELECT feature, bin, sum(x) AS x, sum(y) AS y FROM (
     SELECT m.feature, {S.bins('m.value', 's.o_lo', 's.o_hi')} AS bin, 1 AS x, 0 AS y FROM om m JOIN s USING (feature) UNION ALL
     SELECT m.feature, {S.bins('m.value', 's.o_lo', 's.o_hi')} AS bin, 0, 1 FROM am m JOIN s USING (feature)) WHERE bin IS NOT NULL GROUP BY feature, bin),
    dense AS (SELECT u.feature, u.i AS bin, coalesce(x, 0) + 1e-10 AS x, coalesce(y, 0) + 1e-10 AS y FROM (SELECT feature, i::DOUBLE AS i FROM s, range(50) r(i)) u
     LEFT JOIN b ON b.feature = u.feature AND b.bin = u.i),
    pq AS (SELECT feature, x / sum(x) OVER (PARTITION BY feature) AS p, y / sum(y) OVER (PARTITION BY feature) AS q FROM dense),
    v AS (SELECT feature, sum(p * ln(p / q)) AS kl,
     sqrt(greatest(0, sum(p * ln(p / ((p + q) / 2))) / 2 + sum(q * ln(q / ((p + q) / 2))) / 2)) AS js FROM pq GROUP BY feature),
    t AS (SELECT avg(kl) AS kl, avg(js) AS js FROM v)"""
    out["f7_kl_divergence"] = f"""WITH {hist_sql} {fact('kl_divergence', 'v', [('kl', 'kl', 6)], 'feature')} UNION ALL
    {fact('kl_divergence', 't', [('average_kl_divergence', 'kl', 6), ('similarity_score', '1 / (1 + kl)', 6),
     ('quality', S.grade('kl', [('high', '<', 0.1), ('medium', '<', 0.5)], 'low'), 'word')])}"""
    out["f8_js_divergence"] = f"""WITH {hist_sql} {fact('js_divergence', 'v', [('js', 'js', 6)], 'feature')} UNION ALL
    {fact('js_divergence', 't', [('average_js_divergence', 'js', 6), ('similarity_score', 'greatest(0, 1 - js)', 6),
     ('quality', S.grade('js', [('high', '<', 0.1), ('medium', '<', 0.3)], 'low'), 'word')])}"""
    f9_sql = f"""WITH {pair}, {S.scales('o', cols)},
    n AS (SELECT a.id, min({S.distance('a', 'o', cols, 'sd')}) AS d FROM a, o, sd GROUP BY a.id),
    t AS (SELECT 1 / (1 + avg(d)) AS q FROM n)
    {fact('q_function', 't', [('q', 'q', 6)], f"'{'+'.join(cols)}'")} UNION ALL
    {fact('q_function', 't', [('q_score', 'q', 6), ('privacy_score', 'q', 6), ('n_combinations_tested', '1', 6), ('min_q_score', 'q', 6),
     ('max_q_score', 'q', 6), ('privacy_quality', S.grade('q', [('high', '>', 0.7), ('medium', '>', 0.4)], 'low'), 'word')])}"""
    out["f9_q_function"] = f9_sql
    return out


def diversity_sql(pair: str, cols: list[str], all_pairs: bool = False) -> dict[str, str]:
    """``all_pairs``: intra-diversity over all pairs of rows, else over drawn ones."""
    out = {}

    def fact(metric, source, entries, feature="NULL::VARCHAR"):
        return S.facts("diversity", metric, source, entries, feature)

    stats = f"{pair},\n{S.stats(cols)}"
    d1_sql = f"""WITH {stats}, b AS (SELECT m.feature, {S.bins('m.value', 's.a_lo', 's.a_hi')} AS bin, count(*) AS n, max(s.a_n) AS t
     FROM am m JOIN s USING (feature) GROUP BY m.feature, bin),
    e AS (SELECT feature, -sum(n / t * ln(n / t)) AS e FROM b GROUP BY feature), t AS (SELECT avg(e) AS m, sum(e) AS s FROM e)
    {fact('feature_entropy', 'e', [('entropy', 'e', 6)], 'feature')} UNION ALL
    {fact('feature_entropy', 't', [('average_entropy', 'm', 6), ('total_entropy', 's', 6)])}"""
    out["d1_feature_entropy"] = d1_sql
    d2_sql = f"""WITH {pair}, {S.scales('o', cols)},
    n AS (SELECT o.id, min({S.distance('o', 'a', cols, 'sd')}) AS d FROM o, a, sd GROUP BY o.id),
    q AS (SELECT quantile_cont(d, 0.9) AS q FROM n),
    t AS (SELECT avg(CASE WHEN d < q THEN 1.0 ELSE 0.0 END) AS c, avg(d) AS m, max(d) AS x, max(q) AS q FROM n, q)
    {fact('coverage', 't', [('coverage_ratio', 'c', 6), ('average_distance_to_nearest', 'm', 6),
     ('max_distance_to_nearest', 'x', 6), ('threshold_used', 'q', 6)])}"""
    out["d2_coverage"] = d2_sql
    drawn_sql = f"""x AS (SELECT *, row_number() OVER (ORDER BY {S.order(42, 'intra', 'id')}) - 1 AS at, count(*) OVER () AS n FROM a),
    h AS (SELECT DISTINCT CASE WHEN c <= 17 THEN i + 1 ELSE 1 + floor({S.uniform(42, 'intra.shift', 'i')} * (c - 1))::BIGINT END AS h
     FROM range(16) r(i), (SELECT count(*) AS c FROM a) WHERE i < c - 1),
    d AS (SELECT {S.distance('l', 'r', cols, 'sd')} AS d FROM x l, h, x r, sd WHERE r.at = (l.at + h.h) % l.n)"""
    whole_sql = f"""x AS (SELECT *, row_number() OVER () AS at FROM a),
    d AS (SELECT {S.distance('l', 'r', cols, 'sd')} AS d FROM x l, x r, sd WHERE l.at < r.at)"""
    d4_sql = f"""WITH {pair}, {S.scales('a', cols)}, {whole_sql if all_pairs else drawn_sql},
    t AS (SELECT avg(d) AS m, stddev_pop(d) AS s, min(d) AS lo, max(d) AS hi FROM d)
    {fact('intra_diversity', 't', [('mean_pairwise_distance', 'm', 6), ('std_pairwise_distance', 's', 6),
     ('min_pairwise_distance', 'lo', 6), ('max_pairwise_distance', 'hi', 6), ('diversity_score', 'm', 6)])}"""
    out["d4_intra_diversity"] = d4_sql
    d5_sql = f"""WITH {stats}, c AS (SELECT feature, greatest(0, least(o_hi, a_hi) - greatest(o_lo, a_lo)) / (o_hi - o_lo) AS c,
     greatest(0, (o_lo - a_lo) / (o_hi - o_lo)) AS b, greatest(0, (a_hi - o_hi) / (o_hi - o_lo)) AS u FROM s),
    t AS (SELECT avg(c) AS c, avg(b + u) AS e FROM c)
    {fact('range_coverage', 'c', [('coverage_ratio', 'c', 6), ('extension_below', 'b', 6), ('extension_above', 'u', 6),
     ('total_extension', 'b + u', 6)], 'feature')} UNION ALL
    {fact('range_coverage', 't', [('average_coverage', 'c', 6), ('average_extension', 'e', 6)])}"""
    out["d5_range_coverage"] = d5_sql
    return out


def cluster_sql(pair: str, cols: list[str], label: str, k: int) -> dict[str, str]:
    """Cluster metrics of columns standardised by the original, with a given label of every row."""
    def fact(metric, entries):
        return S.facts("diversity", metric, "t", entries)

    scaled = ", ".join(f"(x.{c} - m_{c}) / sd_{c} AS {c}" for c in cols)
    one = ", ".join(f"1::DOUBLE AS sd_{c}" for c in cols)
    base = f"""WITH {pair}, {S.scales('o', cols)}, mean AS (SELECT {', '.join(f'avg({c}) AS m_{c}' for c in cols)} FROM o),
    co AS (SELECT id, {label} AS label, {scaled} FROM o x, sd, mean), ca AS (SELECT id, {label} AS label, {scaled} FROM a x, sd, mean),
    unit AS (SELECT {one})"""

    def silhouette(t: str) -> str:
        return f"""{t}d AS (SELECT l.id, l.label AS own, r.label AS other, sum({S.distance('l', 'r', cols, 'unit')}) AS s, count(*) AS n
         FROM {t} l, {t} r, unit GROUP BY ALL),
        {t}s AS (SELECT id, max(CASE WHEN own = other THEN s / nullif(n - 1, 0) END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b FROM {t}d GROUP BY id),
        {t}v AS (SELECT avg(coalesce((b - a) / greatest(a, b), 0)) AS v FROM {t}s)"""

    def davies(t: str) -> str:
        centre = ", ".join(f"avg({c}) AS {c}" for c in cols)
        return f"""{t}k AS (SELECT label, {centre} FROM {t} GROUP BY label),
        {t}q AS (SELECT l.label, avg({S.distance('l', 'r', cols, 'unit')}) AS s FROM {t} l JOIN {t}k r USING (label), unit GROUP BY l.label),
        {t}v AS (SELECT avg(w) AS v FROM (SELECT l.label, max((p.s + q.s) / {S.distance('l', 'r', cols, 'unit')}) AS w FROM {t}k l JOIN {t}k r ON l.label <> r.label
         JOIN {t}q p ON p.label = l.label JOIN {t}q q ON q.label = r.label, unit GROUP BY l.label))"""

    def compact(t: str) -> str:
        entries = " UNION ALL ".join(f"SELECT label, {c} AS v FROM {t}" for c in cols)
        return f"{t}v AS (SELECT avg(v) AS v FROM (SELECT var_pop(v) AS v FROM ({entries}) GROUP BY label HAVING count(*) > {len(cols)}))"

    def compared(metric: str, ctes, names: tuple[str, str], similarity: str, difference: bool, bands: list) -> str:
        return f"""{base}, {ctes('co')}, {ctes('ca')}, t AS (SELECT cov.v AS o, cav.v AS a FROM cov, cav)
        {fact(metric, [(names[0], 'o', 6), (names[1], 'a', 6), ('similarity', similarity, 6),
         *([('difference', 'abs(o - a)', 6)] if difference else []), ('n_clusters', str(k), 6), ('quality', S.grade('a', bands, 'low'), 'word')])}"""

    scores, icc = ("original_score", "augmented_score"), ("original_icc", "augmented_icc")
    return {
        "d3": f"""{base}, n AS (SELECT label, sum(x) / (SELECT count(*) FROM co) AS p, sum(y) / (SELECT count(*) FROM ca) AS q FROM
         (SELECT label, 1::DOUBLE AS x, 0::DOUBLE AS y FROM co UNION ALL SELECT label, 0, 1 FROM ca) GROUP BY label),
        e AS (SELECT *, (q + 1e-10) / (1 + {k} * 1e-10) AS u, (p + q) / 2 AS h FROM n),
        t AS (SELECT 1 - sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * ln(p / h) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / h) ELSE 0 END) / 2)) AS s,
         -sum(u * ln(u)) / ln({k}.0::DOUBLE) AS u FROM e)
        {fact('cluster_spread', [('cluster_distribution_similarity', 's', 6), ('augmented_uniformity', 'u', 6), ('n_clusters', str(k), 6)])}""",
        "d6": compared("silhouette_score", silhouette, scores, "1 - abs(o - a)", False, [("high", ">", 0.5), ("medium", ">", 0.25)]),
        "d7": compared("davies_bouldin_index", davies, scores, "1 / (1 + abs(o - a))", True, [("high", "<", 1.0), ("medium", "<", 2.0)]),
        "d8": compared("intra_class_compactness", compact, icc, "1 / (1 + abs(o - a))", True, [("high", "<", 0.5), ("medium", "<", 1.0)]),
    }


def membership_sql(pair: str, guess: str) -> str:
    """Membership facts of an attack that takes a row for an original where ``guess`` holds."""
    return f"""WITH {pair}, t AS (SELECT ((SELECT avg(CASE WHEN {guess} THEN 1.0::DOUBLE ELSE 0 END) FROM o)
     + (SELECT avg(CASE WHEN {guess} THEN 0.0::DOUBLE ELSE 1 END) FROM a)) / 2 AS acc)
    {S.facts('privacy', 'membership_inference', 't', [('classifier_accuracy', 'acc', 6), ('privacy_score', 'greatest(0, 1 - (acc - 0.5) * 2)', 6),
     ('distinguishability', 'acc', 6), ('privacy_level', S.grade('1 - (acc - 0.5) * 2', [('high', '>', 0.7), ('medium', '>', 0.4)], 'low'), 'word')])}"""


def nearest_sql(pair: str, cols: list[str]) -> str:
    return f"""WITH {pair}, {S.scales('o', cols)}, n AS (SELECT a.id AS qid, o.id AS bid, {S.distance('a', 'o', cols, 'sd')} AS d
 FROM a, o, sd), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, bid) AS rank FROM n QUALIFY rank <= 2)"""


def privacy_sql(pair: str, cols: list[str]) -> dict[str, str]:
    out = {}

    def fact(metric, source, entries, feature="NULL::VARCHAR"):
        return S.facts("privacy", metric, source, entries, feature)

    out["v1_nearest_neighbor_risk"] = f"""{nearest_sql(pair, cols)}, p AS (SELECT qid, max(CASE WHEN rank = 1 THEN d END) AS d1,
     max(CASE WHEN rank = 2 THEN d END) AS d2 FROM r GROUP BY qid),
    t AS (SELECT avg(d1 / (d2 + 1e-10)) AS r, avg(CASE WHEN d1 / (d2 + 1e-10) < 0.5 THEN 1.0 ELSE 0 END) AS h, min(d1) AS lo, avg(d1) AS m FROM p)
    {fact('nearest_neighbor_risk', 't', [('average_nn_ratio', 'r', 6), ('high_risk_ratio', 'h', 6), ('min_distance_to_original', 'lo', 6),
     ('average_distance_to_nearest', 'm', 6), ('risk_level', S.grade('h', [('high', '>', 0.3), ('medium', '>', 0.1)], 'low'), 'word')])}"""
    attr_sql = "\nUNION ALL ".join(
        f"SELECT '{c}' AS feature, avg(abs(a.{c} - o.{c})) AS m, (SELECT max({c}) - min({c}) FROM o) AS w FROM r JOIN a ON a.id = qid "
        f"JOIN o ON o.id = bid WHERE rank = 1" for c in cols)
    out["v3_attribute_disclosure"] = f"""{nearest_sql(pair, cols)}, d AS ({attr_sql}),
    e AS (SELECT *, CASE WHEN w > 0 THEN m / w ELSE 0 END AS r FROM d), t AS (SELECT avg(r) AS r FROM e)
    {fact('attribute_disclosure', 'e', [('absolute_difference', 'm', 6), ('normalized_difference', 'r', 6),
     ('risk', S.grade('r', [('high', '<', 0.1), ('medium', '<', 0.3)], 'low'), 'word')], 'feature')} UNION ALL
    {fact('attribute_disclosure', 't', [('average_attribute_risk', 'r', 6),
     ('overall_risk', S.grade('r', [('high', '<', 0.15), ('medium', '<', 0.35)], 'low'), 'word')])}"""
    out["v4_distance_to_closest"] = f"""{nearest_sql(pair, cols)}, q AS (SELECT quantile_cont(d, 0.1) AS q, quantile_cont(d, 0.5) AS mid FROM r WHERE rank = 1),
    t AS (SELECT avg(d) AS m, max(mid) AS mid, min(d) AS lo, max(d) AS hi, sum(CASE WHEN d < q THEN 1 ELSE 0 END) AS k, count(*) AS n, max(q) AS q
     FROM r, q WHERE rank = 1)
    {fact('distance_to_closest', 't', [('mean_dcr', 'm', 6), ('median_dcr', 'mid', 6), ('min_dcr', 'lo', 6), ('max_dcr', 'hi', 6),
     ('risky_records_count', 'k', 6), ('risky_records_ratio', 'k / n', 6), ('privacy_threshold', 'q', 6)])}"""
    out["v5_uniqueness"] = f"""WITH {pair}, {S.scales('o', cols)}, n AS (SELECT a.id,
     sum(CASE WHEN {S.distance('a', 'o', cols, 'sd')} <= 0.5 THEN 1 ELSE 0 END)::BIGINT AS n FROM a, o, sd GROUP BY a.id),
    t AS (SELECT avg(1 / (1 + n)::DOUBLE) AS m, quantile_cont(1 / (1 + n)::DOUBLE, 0.5) AS mid,
     avg(CASE WHEN 1 / (1 + n)::DOUBLE > 0.7 THEN 1.0 ELSE 0 END) AS h, avg(n) AS near FROM n)
    {fact('uniqueness', 't', [('average_uniqueness', 'm', 6), ('median_uniqueness', 'mid', 6), ('highly_unique_ratio', 'h', 6),
     ('average_neighbors', 'near', 6), ('privacy_quality', S.grade('m', [('good', '>', 0.6), ('fair', '>', 0.4)], 'poor'), 'word')])}"""
    def keyed(cols: list[str]) -> str:
        """CTE ``z``: augmented rows with one bin number per column, -1 out of range."""
        probs = "[" + ", ".join(f"{i / 10}" for i in range(11)) + "]"
        edges = ", ".join(f"list_sort(list_distinct(quantile_cont({c}, {probs}))) AS e_{c}" for c in cols)
        pick = ", ".join(
            f"CASE WHEN len(e_{c}) < 2 OR a.{c} < e_{c}[1] OR a.{c} > e_{c}[-1] THEN -1 ELSE "
            f"greatest(0, len(list_filter(e_{c}, lambda x: x < a.{c})) - 1) END AS b_{c}" for c in cols)
        return f"q AS (SELECT {edges} FROM o), z AS (SELECT {pick}, a.* FROM a, q)"
    keys_sql = ", ".join(f"b_{c}" for c in cols)
    out["v6_k_anonymity"] = f"""WITH {pair}, {keyed(cols)}, g AS (SELECT {keys_sql}, count(*) AS n FROM z GROUP BY {keys_sql}),
    t AS (SELECT min(n) AS k, count(*) AS g, quantile_cont(n, 0.5) AS mid, avg(n) AS m, sum(n)::DOUBLE AS total,
     {', '.join(f'sum(CASE WHEN n < {i} THEN 1 ELSE 0 END)::DOUBLE AS g{i}, sum(CASE WHEN n < {i} THEN n ELSE 0 END)::DOUBLE AS r{i}' for i in (1, 2, 5, 10))} FROM g)
    {fact('k_anonymity', 't', [('k_anonymity', 'k', 6), ('n_equivalence_classes', 'g', 6), ('median_equivalence_class_size', 'mid', 6),
     ('mean_equivalence_class_size', 'm', 6), *[(f'ratio_groups_lt_{i}', f'g{i} / g', 6) for i in (1, 2, 5, 10)],
     *[(f'ratio_records_in_groups_lt_{i}', f'r{i} / total', 6) for i in (1, 2, 5, 10)]])}"""
    def l_sql(pair_sql: str, cols: list[str]) -> str:
        keys = ", ".join(f"b_{c}" for c in cols)
        h = "(n - 1)::DOUBLE * (j::DOUBLE / least(10, greatest(2, n))::DOUBLE)"
        return f"""WITH {pair_sql}, {keyed(cols)},
    w AS (SELECT {keys}, {cols[-1]} AS v, row_number() OVER (PARTITION BY {keys} ORDER BY {cols[-1]}) - 1 AS r, count(*) OVER (PARTITION BY {keys}) AS n FROM z),
    h AS (SELECT DISTINCT {keys}, n, j, {h} AS h FROM w, range(0, 11) t(j) WHERE j <= least(10, greatest(2, n))),
    e AS (SELECT h.*, lo.v AS lo, hi.v AS hi FROM h JOIN w lo USING ({keys}) JOIN w hi USING ({keys}) WHERE lo.r = floor(h.h) AND hi.r = least(floor(h.h) + 1, h.n - 1)),
    x AS (SELECT {keys}, list_sort(list_distinct(list(lo + (hi - lo) * (h - floor(h))))) AS edges FROM e GROUP BY {keys}),
    b AS (SELECT {keys}, n, greatest(0, len(list_filter(edges, lambda y: y < v)) - 1) AS bin, count(*) AS c FROM w JOIN x USING ({keys}) GROUP BY ALL),
    d AS (SELECT {keys}, count(*) AS d, round(-sum(c / n * log2(c / n)), 9) AS e FROM b GROUP BY {keys}),
    t AS (SELECT avg(d) AS d, quantile_cont(d, 0.5) AS dm, avg(e) AS e, quantile_cont(e, 0.5) AS em, count(*) AS g,
     {', '.join(f'avg(CASE WHEN d >= {i} THEN 1.0 ELSE 0 END) AS l{i}' for i in (2, 3, 5))} FROM d)
    {fact('l_diversity', 't', [('average_distinct_sensitive_values', 'd', 6), ('median_distinct_sensitive_values', 'dm', 6),
     ('average_entropy_bits', 'e', 6), ('median_entropy_bits', 'em', 6), ('n_equivalence_classes', 'g', 6),
     *[(f'ratio_classes_l_{i}', f'l{i}', 6) for i in (2, 3, 5)]])}"""
    out["v7_l_diversity"] = l_sql(pair, cols)
    return out
