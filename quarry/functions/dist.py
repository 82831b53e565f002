"""Tail probabilities as SQL expressions (T12), evaluated once per result row.

Spark SQL has no incomplete gamma or beta function.  Both are written here as
text for one parse; formulas are those of the Digital Library of Mathematical
Functions (DLMF), by their numbers.

* Moderate parameters: the power series (8.7.1) or continued fraction (8.9.2) of
  the incomplete gamma function, and the continued fraction of the incomplete
  beta function (8.17.22).  Each is folded from its innermost term outwards over
  a sequence whose length grows with the square root of the smaller parameter.
* From LARGE on: the uniform expansions in terms of the normal tail (8.12.3, 8.18.9),
  whose error falls with the parameter.  So there is no limit on sizes.
"""

from __future__ import annotations

import math
from itertools import count

from pyspark.sql import Column
from pyspark.sql import functions as F

#: From this parameter on the uniform expansions hold to better than 1e-10.
LARGE = 10_000.0
_LN_2PI = math.log(2 * math.pi)
# First Taylor coefficients of the expansion's terms about the mean (8.12.12 and following).
_C0 = (-1 / 3, 1 / 12, -2 / 135, 1 / 864, 1 / 2835, -139 / 777600)
_C1 = (-1 / 540, -1 / 288, 1 / 378, -77 / 77760)

_fresh = count()


def _let(body, **values: str) -> str:
    """``body`` as a function of names bound once to the given expressions."""
    row = f"v{next(_fresh)}"
    fields = ", ".join(f"'{k}', CAST({v} AS DOUBLE)" for k, v in values.items())
    return f"transform(array(named_struct({fields})), {row} -> {body(*(f'{row}.{k}' for k in values))})[0]"


def _poly(z: str, coefficients: tuple[float, ...]) -> str:
    out = f"{coefficients[-1]!r}D"
    for c in reversed(coefficients[:-1]):
        out = f"({c!r}D + {z} * {out})"
    return out


def _fold(n: str, start: str, step) -> str:
    """``step(value, j)`` for j = n, n - 1, .. 1, beginning with ``start``."""
    f, j = f"f{next(_fresh)}", f"j{next(_fresh)}"
    return f"aggregate(sequence(CAST({n} AS INT), 1, -1), CAST({start} AS DOUBLE), ({f}, {j}) -> {step(f, j)})"


def _stirling(x: str) -> str:
    """ln Gamma(x) less its leading terms, for x >= 8 (5.11.1)."""
    return f"((1 / 12D - (1 / 360D - (1 / 1260D - 1 / (1680D * {x} * {x})) / ({x} * {x})) / ({x} * {x})) / {x})"


def _rising(x: str) -> str:
    """ln of x (x + 1) .. (x + 7)."""
    return "(" + " + ".join(f"ln({x} + {i}D)" for i in range(8)) + ")"


def _ln_gamma(x: str) -> str:
    """For x > 0: by the recurrence (5.5.1) from x + 8."""
    return _let(lambda y: f"(({y} - 0.5D) * ln({y}) - {y} + {_LN_2PI / 2!r}D + {_stirling(y)} - {_rising(f'({y} - 8D)')})", y=f"({x} + 8D)")


def _ln_beta(a: str, b: str) -> str:
    """ln B(a, b) from B(a + 8, b + 8), where the large terms of the three log-gammas are cancelled by hand."""
    def body(p: str, q: str) -> str:  # p <= q, both raised by 8
        s = f"({p} + {q})"
        main = (f"{_LN_2PI / 2!r}D - 0.5D * ln({q}) + ({p} - 0.5D) * ln({p} / {s}) + {q} * log1p(-{p} / {s}) "
                f"+ {_stirling(p)} + {_stirling(q)} - {_stirling(s)}")
        up_p = " + ".join(f"ln(({s} - {16 - i}D) / ({p} - {8 - i}D))" for i in range(8))  # p from its own value, q not yet raised
        up_q = " + ".join(f"ln(({s} - {8 - i}D) / ({q} - {8 - i}D))" for i in range(8))
        return f"({main} + {up_p} + {up_q})"
    return _let(body, p=f"(least({a}, {b}) + 8D)", q=f"(greatest({a}, {b}) + 8D)")


def _gamma_q_moderate(a: str, x: str) -> str:
    n = f"30 + 9 * sqrt({a})"
    front = f"exp({a} * ln({x}) - {x} - {_ln_gamma(a)})"
    series = f"(1D - {front} / {a} * {_fold(n, '1', lambda f, j: f'1D + {x} / ({a} + {j}) * {f}')})"
    fraction = f"({front} / ({x} + 1D - {a} + {_fold(n, '0', lambda f, j: f'{j} * ({a} - {j}) / ({x} + 2D * {j} + 1D - {a} + {f})')}))"
    return f"(CASE WHEN {x} <= 0 THEN 1D WHEN {x} < {a} + 1D THEN {series} ELSE {fraction} END)"


def _normal_tail(z: str) -> str:
    """P(Z > z)."""
    half = _let(lambda h: f"(0.5D * {_gamma_q_moderate('0.5D', h)})", h=f"({z} * {z} / 2D)")
    return f"(CASE WHEN {z} >= 0 THEN {half} ELSE 1D - {half} END)"


def _gamma_q_large(a: str, x: str) -> str:
    def body(mu: str, eta: str) -> str:
        c0 = f"(CASE WHEN abs({eta}) < 0.1D THEN {_poly(eta, _C0)} ELSE 1D / {mu} - 1D / {eta} END)"
        return f"({_normal_tail(f'({eta} * sqrt({a}))')} + exp(-{a} * {eta} * {eta} / 2D - 0.5D * ln({2 * math.pi!r}D * {a})) * ({c0} + {_poly(eta, _C1)} / {a}))"

    def with_mu(mu: str) -> str:
        near = f"({mu} * {_poly(mu, (1.0, -1 / 3, 7 / 36, -73 / 540, 1331 / 12960))})"
        eta = f"(CASE WHEN abs({mu}) < 0.001D THEN {near} ELSE signum({mu}) * sqrt(2D * ({mu} - log1p({mu}))) END)"
        return _let(lambda m, e: body(m, e), m=mu, e=eta)
    return f"(CASE WHEN {x} <= 0 THEN 1D ELSE {_let(with_mu, mu=f'(({x} - {a}) / {a})')} END)"


def gamma_q(a: str, x: str) -> str:
    """Regularised upper incomplete gamma function Q(a, x)."""
    return _let(lambda p, y: f"(CASE WHEN {p} < {LARGE!r}D THEN {_gamma_q_moderate(p, y)} ELSE {_gamma_q_large(p, y)} END)", p=a, y=x)


def _beta_fraction(a: str, b: str, x: str, y: str) -> str:
    """I_x(a, b) for x below the mean; y = 1 - x."""
    ln = lambda u, v: f"(CASE WHEN {v} < 0.5D THEN log1p(-{v}) ELSE ln({u}) END)"

    def step(f: str, j: str) -> str:
        m = f"floor({j} / 2)"
        d = (f"(CASE WHEN {j} % 2 = 0 THEN {m} * ({b} - {m}) * {x} / (({a} + {j} - 1D) * ({a} + {j})) "
             f"ELSE -({a} + {m}) * ({a} + {b} + {m}) * {x} / (({a} + {j} - 1D) * ({a} + {j})) END)")
        return f"{d} / (1D + {f})"
    fraction = _fold(f"60 + 16 * sqrt(least({a}, {b}))", "0", step)
    return f"(exp({a} * {ln(x, y)} + {b} * {ln(y, x)} - {_ln_beta(a, b)}) / ({a} * (1D + {fraction})))"


def _beta_large(a: str, b: str, x: str, y: str) -> str:
    def body(n: str, x0: str, y0: str, d: str) -> str:
        square = f"(-2D * ({x0} * log1p({d} / {x0}) + {y0} * log1p(-{d} / {y0})))"

        def with_eta(eta: str) -> str:
            c0 = (f"(CASE WHEN abs({eta}) < 0.00001D THEN (1D - 2D * {x0}) / (3D * sqrt({x0} * {y0})) "
                  f"ELSE 1D / {eta} - sqrt({x0} * {y0}) / {d} END)")
            return (f"({_normal_tail(f'(-{eta} * sqrt({n}))')} + exp(-{n} * {eta} * {eta} / 2D - 0.5D * ln({2 * math.pi!r}D * {n})) * {c0})")
        return _let(with_eta, eta=f"signum({d}) * sqrt(greatest(0D, {square}))")
    # x - x0 = (x b - y a) / (a + b)
    return _let(body, n=f"({a} + {b})", x0=f"({a} / ({a} + {b}))", y0=f"({b} / ({a} + {b}))", d=f"(({x} * {b} - {y} * {a}) / ({a} + {b}))")


def beta_i(a: str, b: str, x: str, y: str) -> str:
    """Regularised incomplete beta function I_x(a, b), with y = 1 - x given apart (either may be tiny)."""
    def body(p: str, q: str, u: str, v: str) -> str:
        low = _beta_fraction(p, q, u, v)
        high = f"(1D - {_beta_fraction(q, p, v, u)})"
        moderate = f"(CASE WHEN {u} < ({p} + 1D) / ({p} + {q} + 2D) THEN {low} ELSE {high} END)"
        return (f"(CASE WHEN {u} <= 0 THEN 0D WHEN {v} <= 0 THEN 1D WHEN least({p}, {q}) < {LARGE!r}D THEN {moderate} "
                f"ELSE {_beta_large(p, q, u, v)} END)")
    return _let(body, p=a, q=b, u=x, v=y)


def _arg(value: str | float) -> str:
    """A column's name, or a number."""
    if isinstance(value, str):
        return "CAST(`" + value.replace("`", "``") + "` AS DOUBLE)"
    return f"CAST({value!r} AS DOUBLE)"


def _probability(text: str) -> Column:
    return F.expr(f"least(greatest({text}, 0D), 1D)")


def t_two_sided_p(t: str | float, dof: str | float) -> Column:
    """P(|T| > |t|) for Student's t with ``dof`` degrees of freedom."""
    t, n = _arg(t), _arg(dof)
    return _probability(_let(lambda s, k: beta_i(f"({k} / 2D)", "0.5D", f"({k} / ({k} + {s}))", f"({s} / ({k} + {s}))"), s=f"({t} * {t})", k=n))


def chi2_sf(x: str | float, dof: str | float) -> Column:
    """P(X > x) for chi-square with ``dof`` degrees of freedom."""
    return _probability(gamma_q(f"({_arg(dof)} / 2D)", f"({_arg(x)} / 2D)"))


def f_sf(f: str | float, d1: str | float, d2: str | float) -> Column:
    """P(F > f) for the F distribution."""
    return _probability(_let(lambda v, m, n: f"(CASE WHEN {v} <= 0 THEN 1D ELSE "
                             + beta_i(f"({n} / 2D)", f"({m} / 2D)", f"({n} / ({n} + {m} * {v}))", f"({m} * {v} / ({n} + {m} * {v}))") + " END)",
                             v=_arg(f), m=_arg(d1), n=_arg(d2)))


def norm_two_sided_p(z: str | float) -> Column:
    """P(|Z| > |z|) for the standard normal."""
    return _probability(gamma_q("0.5D", f"({_arg(z)} * {_arg(z)} / 2D)"))
