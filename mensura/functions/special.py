"""Special functions and tails of distributions: plain functions of floats, and Arrow UDFs made from them.

Spark has no gamma, beta or error function.  These run over results that are already aggregated, or
over columns in Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import wraps

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def gammln(x: float) -> float:
    if x <= 0:
        raise ValueError("gammln needs x > 0")
    return math.lgamma(x)


def gser(a: float, x: float, most: int = 100_000) -> float:
    """Lower regularised incomplete gamma function by its series; good for x < a + 1."""
    if x < 0 or a <= 0:
        raise ValueError("needs a > 0 and x >= 0")
    if x == 0:
        return 0.0
    term = total = 1 / a
    for n in range(1, most):
        term *= x / (a + n)
        total += term
        if abs(term) < abs(total) * 1e-16:
            return total * math.exp(a * math.log(x) - x - math.lgamma(a))
    raise ValueError("no convergence")


def gcf(a: float, x: float, most: int = 100_000) -> float:
    """Upper regularised incomplete gamma function by its continued fraction; good for x >= a + 1."""
    if x <= 0 or a <= 0:
        raise ValueError("needs a > 0 and x > 0")
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / (b if abs(b) > tiny else tiny)
    h = d
    for n in range(1, most):
        an = n * (a - n)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return h * math.exp(a * math.log(x) - x - math.lgamma(a))


def gammp(a: float, x: float) -> float:
    return gser(a, x) if x < a + 1 else 1 - gcf(a, x)


def gammq(a: float, x: float) -> float:
    return 1 - gser(a, x) if x < a + 1 else gcf(a, x)


def betacf(a: float, b: float, x: float, most: int = 100_000) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c = 1.0
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, most):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return h


def betai(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if not 0 <= x <= 1 or a <= 0 or b <= 0:
        raise ValueError("needs a, b > 0 and x from 0 to 1")
    if x in (0.0, 1.0):
        return float(x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * betacf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * betacf(b, a, 1 - x) / b


def _t_sf(t: float, df: float) -> float:
    """Two-tailed Student t probability."""
    return 0.0 if math.isinf(t) else betai(df / 2, 0.5, df / (df + t * t))


def _chi2_sf(x: float, df: float) -> float:
    return 1.0 if x <= 0 else gammq(df / 2, x / 2)


def _f_sf(f: float, df1: float, df2: float) -> float:
    return 1.0 if f <= 0 else betai(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))


def _normal_cdf(x: float, mu: float = 0.0, sigma: float = 1.0) -> float:
    return 0.5 * math.erfc((mu - x) / (sigma * math.sqrt(2)))


def bisect(cdf: Callable[[float], float], p: float, lo: float, hi: float) -> float:
    """x with cdf(x) = p, between lo and hi."""
    for _ in range(400):
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def _normal_ppf(p: float, mu: float = 0.0, sigma: float = 1.0) -> float:
    return mu + sigma * bisect(_normal_cdf, p, -40.0, 40.0)


#: Results of distinct arguments that a task keeps.
KEPT = 1 << 16


def column_function(f: Callable[..., float], kind: str = "double") -> Callable[..., Column]:
    """f over columns in Arrow batches, once for equal arguments of a task's rows; a null argument gives null.  The plain function is at .plain."""

    number, known = "float64" if kind == "double" else "Int64", {}

    def batch(rows: pd.DataFrame) -> pd.Series:
        args = rows.to_numpy(dtype=float)
        ok = ~np.isnan(args).any(axis=1)
        each, at = np.unique(args[ok], axis=0, return_inverse=True)
        if len(known) > KEPT:
            known.clear()
        results = np.empty(len(each), dtype=object)
        for i, row in enumerate(map(tuple, each.tolist())):
            if row not in known:
                known[row] = f(*row)
            results[i] = known[row]
        out = np.full(len(args), None, dtype=object)
        out[ok] = results[at.reshape(-1)]
        return pd.Series(out).astype(number)

    @wraps(f)
    def call(*args: Column | float | str) -> Column:
        cols = [F.col(a) if isinstance(a, str) else a if isinstance(a, Column) else F.lit(float(a)) for a in args]
        return F.pandas_udf(batch, kind)(F.struct(*[c.cast("double").alias(f"a{i}") for i, c in enumerate(cols)]))

    call.plain = f
    return call


t_sf, chi2_sf, f_sf = (column_function(f) for f in (_t_sf, _chi2_sf, _f_sf))
normal_cdf, normal_ppf = column_function(_normal_cdf), column_function(_normal_ppf)
