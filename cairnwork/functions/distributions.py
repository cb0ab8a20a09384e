"""Normal distribution as SQL expressions that any engine with exp, ln and sqrt takes."""

from __future__ import annotations

# Abramowitz and Stegun 7.1.26; Acklam's rational approximation of the normal quantile.
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_P = 0.3275911
QUANTILE_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
QUANTILE_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
QUANTILE_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
QUANTILE_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
QUANTILE_LOW = 0.02425


def number(v: float) -> str:
    return f"CAST({v!r} AS DOUBLE)"


def polynomial(x: str, coefficients: tuple[float, ...]) -> str:
    """Highest power first."""
    text = number(coefficients[0])
    for c in coefficients[1:]:
        text = f"({text} * {x} + {number(c)})"
    return text


def normal_cdf(x: str) -> str:
    """P(Z <= x), to about 1e-7."""
    t = f"(1 / (1 + {number(ERF_P)} * abs({x}) / sqrt(CAST(2 AS DOUBLE))))"
    tail = f"({polynomial(t, ERF[::-1])} * {t} * exp(-({x}) * ({x}) / 2))"
    return f"(CASE WHEN {x} >= 0 THEN 1 - {tail} / 2 ELSE {tail} / 2 END)"


def normal_quantile(p: str) -> str:
    """x with P(Z <= x) = p, to about 1e-9."""
    q, low, high = f"({p} - 0.5)", f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    rr = f"({q} * {q})"
    tail = lambda x: f"({polynomial(x, QUANTILE_C)} / ({polynomial(x, QUANTILE_D)} * {x} + 1))"
    middle = f"({polynomial(rr, QUANTILE_A)} * {q} / ({polynomial(rr, QUANTILE_B)} * {rr} + 1))"
    return f"(CASE WHEN {p} < {number(QUANTILE_LOW)} THEN {tail(low)} WHEN {p} > {number(1 - QUANTILE_LOW)} THEN -{tail(high)} ELSE {middle} END)"
