"""Text builders for the check SQL (run by another engine, never by this library)."""

from __future__ import annotations


def num(expr: str, digits: int = 6) -> str:
    return f"round(({expr})::DOUBLE, {digits}) + 0.0"


def facts(dimension: str, metric: str, source: str, entries: list[tuple], feature: str = "NULL::VARCHAR") -> str:
    """UNION ALL of one SELECT per (field, expression, digits or 'word')."""
    out = []
    for field, expr, kind in entries:
        value = "NULL::DOUBLE" if kind == "word" else num(expr, kind)
        label = f"({expr})::VARCHAR" if kind == "word" else "NULL::VARCHAR"
        out.append(f"SELECT '{dimension}' AS dimension, '{metric}' AS metric, {feature} AS feature, "
                   f"'{field}' AS field, {value} AS value, {label} AS label FROM {source}")
    return "\nUNION ALL\n".join(out)


def melt(source: str, cols: list[str], keep: str = "") -> str:
    return "\nUNION ALL\n".join(
        f"SELECT {keep}'{c}' AS feature, {i} AS pos, {c}::DOUBLE AS value FROM {source}" for i, c in enumerate(cols))


def stats(cols: list[str]) -> str:
    """CTEs ``s``: one row per feature with o_* and a_* moments."""
    def side(t: str) -> str:
        return (f"SELECT feature, pos, count(value)::DOUBLE AS {t}_n, avg(value) AS {t}_mean, stddev_pop(value) AS {t}_sp, "
                f"stddev_samp(value) AS {t}_ss, min(value) AS {t}_lo, max(value) AS {t}_hi FROM {t}m GROUP BY feature, pos")
    return (f"om AS ({melt('o', cols)}), am AS ({melt('a', cols)}),\n"
            f"s AS (SELECT * FROM ({side('o')}) JOIN ({side('a')}) USING (feature, pos))")


def ecdf() -> str:
    """CTE ``e``: running shares of both sides per distinct value (needs om, am)."""
    return """c AS (SELECT feature, value, sum(x) AS x, sum(y) AS y FROM
  (SELECT feature, value, 1 AS x, 0 AS y FROM om UNION ALL SELECT feature, value, 0, 1 FROM am) GROUP BY feature, value),
e AS (SELECT feature, value, n_o, n_a,
  sum(x) OVER w / n_o AS fo, sum(y) OVER w / n_a AS fa, lead(value) OVER w AS next
  FROM (SELECT *, sum(x) OVER (PARTITION BY feature)::DOUBLE AS n_o, sum(y) OVER (PARTITION BY feature)::DOUBLE AS n_a FROM c)
  WINDOW w AS (PARTITION BY feature ORDER BY value)),
g AS (SELECT feature, max(abs(fo - fa)) AS d, sum(abs(fo - fa) * (coalesce(next, value) - value)) AS w,
  max(n_o) AS n_o, max(n_a) AS n_a FROM e GROUP BY feature)"""


def pvalue(source: str) -> str:
    """CTE ``k``: the gaps with the Kolmogorov p-value."""
    return f"""k AS (SELECT *, CASE WHEN d * d * (n_o * n_a / (n_o + n_a)) < 0.0016 THEN 1.0::DOUBLE ELSE
  least(1.0::DOUBLE, greatest(0.0::DOUBLE, 2 * (SELECT sum(CASE WHEN i % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END
    * exp(-2.0::DOUBLE * i * i * (d * d * (n_o * n_a / (n_o + n_a))))) FROM range(1, 101) t(i)))) END AS p FROM {source})"""


def bins(value: str, lo: str, hi: str) -> str:
    """Bin of a value among 50 equal-width bins over [lo, hi]; null outside."""
    step = f"(({hi} - {lo}) / 50.0::DOUBLE)"
    guess = f"least(floor(({value} - {lo}) / {step}), 49)"
    return (f"CASE WHEN {value} >= {lo} AND {value} <= {hi} THEN CASE WHEN {value} < {guess} * {step} + {lo} THEN {guess} - 1 "
            f"WHEN {value} >= ({guess} + 1) * {step} + {lo} AND {guess} < 49 THEN {guess} + 1 ELSE {guess} END END")


def uniform(seed: int, stream: str, key: str) -> str:
    return (f"(('0x' || substr(md5(concat_ws('|', '{seed}', '{stream}', ({key})::VARCHAR)), 1, 13))::BIGINT "
            "/ 4503599627370496.0::DOUBLE)")


def normal(seed: int, stream: str, key: str) -> str:
    u, v = uniform(seed, stream + ".r", key), uniform(seed, stream + ".a", key)
    return f"(sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {u})) * cos(6.283185307179586::DOUBLE * {v}))"


def index(seed: int, stream: str, key: str, n: str) -> str:
    return f"floor({uniform(seed, stream, key)} * ({n})::DOUBLE)::BIGINT"


def order(seed: int, stream: str, key: str) -> str:
    return f"md5(concat_ws('|', '{seed}', '{stream}', ({key})::VARCHAR))"


def distance(left: str, right: str, cols: list[str], scale: str) -> str:
    """Euclidean distance in scaled units; ``scale`` has one column per feature named sd_<col>."""
    return "sqrt(" + " + ".join(
        f"(({left}.{c} - {right}.{c}) / {scale}.sd_{c}) * (({left}.{c} - {right}.{c}) / {scale}.sd_{c})" for c in cols) + ")"


def scales(source: str, cols: list[str], name: str = "sd") -> str:
    inner = ", ".join(f"coalesce(nullif(stddev_pop({c}), 0), 1) AS sd_{c}" for c in cols)
    return f"{name} AS (SELECT {inner} FROM {source})"


def grade(expr: str, bands: list[tuple[str, str, float]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {expr} {op} {t} THEN '{w}'" for w, op, t in bands) + f" ELSE '{otherwise}' END"
