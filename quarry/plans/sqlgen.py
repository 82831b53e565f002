"""SQL text builders for the DuckDB oracle (independent re-statement of each
query in plain SQL; p-values by Simpson quadrature of the density)."""

from __future__ import annotations


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def sig(x: str, digits: int = 7) -> str:
    s = f"({digits - 1} - floor(log10(abs({x}))))"
    return (f"(CASE WHEN ({x}) IS NULL OR isnan(({x})::DOUBLE) THEN NULL::DOUBLE "
            f"WHEN ({x}) = 0 THEN 0.0::DOUBLE "
            f"WHEN {s} >= 0 THEN round_even(({x})::DOUBLE * pow(10.0, {s}), 0) / pow(10.0, {s}) + 0.0 "
            f"ELSE round_even(({x})::DOUBLE / pow(10.0, -{s}), 0) * pow(10.0, -{s}) + 0.0 END)")


def dec(x: str, places: int = 8) -> str:
    scale = float(10 ** places)
    return (f"(CASE WHEN ({x}) IS NULL OR isnan(({x})::DOUBLE) THEN NULL::DOUBLE "
            f"ELSE round_even(({x})::DOUBLE * {scale!r}, 0) / {scale!r} + 0.0 END)")


def simpson(lo: str, hi: str, integrand: str, var: str = "u", steps: int = 4000) -> str:
    """Composite Simpson rule of ``integrand`` (an SQL expression in ``var``)
    over [lo, hi] with ``steps`` (even) intervals, as one list expression."""
    h = f"((({hi}) - ({lo})) / {steps}.0)"
    w = f"(CASE WHEN _qi = 0 OR _qi = {steps} THEN 1.0 WHEN _qi % 2 = 1 THEN 4.0 ELSE 2.0 END)"
    body = integrand.replace(f"<{var}>", f"(({lo}) + _qi * {h})")
    return f"({h} / 3.0 * list_sum(list_transform(range(0, {steps} + 1), lambda _qi: {w} * ({body}))))"


def t_two_sided_p(t: str, nu: str) -> str:
    """P(|T| > |t|), T ~ Student t(nu): angle form, density prop. to cos^(nu-1)."""
    th0 = f"atan(abs({t}) / sqrt({nu}))"
    hi = f"least(pi() / 2, {th0} + 14.0 / sqrt(greatest(({nu}) - 1, 1e-9)))"
    c = f"exp(lgamma((({nu}) + 1) / 2.0) - lgamma(({nu}) / 2.0)) / sqrt(pi())"
    integrand = f"pow(cos(<u>), ({nu}) - 1)"
    return f"least(1.0, 2.0 * {c} * {simpson(th0, hi, integrand)})"


def chi2_sf(x: str, k: str) -> str:
    """P(X > x), X ~ chi2(k): 1 - integral over [0, sqrt x] of the density of sqrt X."""
    hi = f"least(sqrt(greatest({x}, 0.0)), sqrt({k}) + 40.0)"
    logc = f"(-lgamma(({k}) / 2.0) - (({k}) / 2.0 - 1) * ln(2.0))"
    integrand = f"exp((({k}) - 1) * ln(greatest(<u>, 1e-300)) - (<u>) * (<u>) / 2.0 + {logc})"
    return f"greatest(0.0, 1.0 - {simpson('0.0', hi, integrand)})"


def f_sf(f: str, d1: str, d2: str) -> str:
    """P(F > f), F ~ F(d1, d2) = I_x(d2/2, d1/2), x = d2/(d2+d1 f), angle form."""
    thx = f"asin(sqrt(({d2}) / (({d2}) + ({d1}) * greatest({f}, 0.0))))"
    lb = f"(lgamma(({d2}) / 2.0) + lgamma(({d1}) / 2.0) - lgamma((({d1}) + ({d2})) / 2.0))"
    integrand = f"2.0 * pow(sin(<u>), ({d2}) - 1) * pow(cos(<u>), ({d1}) - 1)"
    lo = f"greatest(0.0, {thx} - 14.0 / sqrt(greatest(({d2}) - 1, 1e-9)))"
    return f"least(1.0, exp(-{lb}) * {simpson(lo, thx, integrand, steps=6000)})"


def norm_two_sided_p(z: str) -> str:
    """P(|Z| > |z|) as chi2 with 1 dof of z^2."""
    return chi2_sf(f"(({z}) * ({z}))", "1.0")
