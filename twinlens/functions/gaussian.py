"""Normal CDF and its inverse as plain expressions (Spark has neither).

Written as SQL text with exponent-form literals, so that they are doubles everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the published rational approximation of the inverse
# normal CDF by P. J. Acklam (relative error below 1.2e-9).
_CENTRE_NUM = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
               1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_CENTRE_DEN = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
               6.680131188771972e01, -1.328068155288572e01, 1.0)
_TAIL_NUM = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
             -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_TAIL_DEN = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
             3.754408661907416e00, 1.0)
_TAIL = 0.02425

# Coefficients of Hart's double-precision normal CDF as published by
# G. West, "Better approximations to cumulative normal functions" (2005).
_CDF_NUM = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
            112.079291497871, 221.213596169931, 220.206867912376)
_CDF_DEN = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
            296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def _num(x: float) -> str:
    return f"({x:.17e})"


def _horner(coefficients: tuple[float, ...], x: str) -> str:
    text = _num(coefficients[0])
    for c in coefficients[1:]:
        text = f"({text} * {x} + {_num(c)})"
    return text


def normal_ppf_sql(p: str) -> str:
    """SQL text of the inverse normal CDF of ``p`` in (0, 1)."""
    q = f"({p} - 5e-1)"
    centre = f"({_horner(_CENTRE_NUM, f'({q} * {q})')} * {q} / {_horner(_CENTRE_DEN, f'({q} * {q})')})"
    low = f"sqrt(-2e0 * ln({p}))"
    high = f"sqrt(-2e0 * ln(1e0 - {p}))"
    return (f"CASE WHEN {p} < {_num(_TAIL)} THEN {_horner(_TAIL_NUM, low)} / {_horner(_TAIL_DEN, low)} "
            f"WHEN {p} > 1e0 - {_num(_TAIL)} THEN -({_horner(_TAIL_NUM, high)} / {_horner(_TAIL_DEN, high)}) "
            f"ELSE {centre} END")


def normal_cdf_sql(x: str) -> str:
    """SQL text of the normal CDF of ``x``."""
    a = f"abs({x})"
    body = f"(exp(-({a} * {a}) / 2e0) * {_horner(_CDF_NUM, a)} / {_horner(_CDF_DEN, a)})"
    far = (f"(exp(-({a} * {a}) / 2e0) / ({a} + 1e0 / ({a} + 2e0 / ({a} + 3e0 / "
           f"({a} + 4e0 / ({a} + 6.5e-1))))) / 2.506628274631e0)")
    tail = f"(CASE WHEN {a} > 37e0 THEN 0e0 WHEN {a} < 7.07106781186547e0 THEN {body} ELSE {far} END)"
    return f"(CASE WHEN {x} > 0e0 THEN 1e0 - {tail} ELSE {tail} END)"


def normal_ppf(column: str) -> Column:
    return F.expr(normal_ppf_sql(f"`{column}`"))


def normal_cdf(column: str) -> Column:
    return F.expr(normal_cdf_sql(f"`{column}`"))
