"""Densities, distribution functions, quantiles and samplers.

Where a closed form exists the function builds a Column; the rest are Arrow UDFs of special functions.
Samplers draw from hashes of seed and row, so a row's draw never changes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.functions.special import betai, bisect, column_function, gammp, normal_cdf

gaussian_cdf = normal_cdf


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def gaussian_pdf(x, mu=0.0, sigma=1.0) -> Column:
    z = (_c(x) - _c(mu)) / _c(sigma)
    return F.exp(-z * z / 2) / (_c(sigma) * math.sqrt(2 * math.pi))


def uniform_pdf(x, a=0.0, b=1.0) -> Column:
    return F.when(_c(x).between(_c(a), _c(b)), 1 / (_c(b) - _c(a))).otherwise(0.0)


def uniform_cdf(x, a=0.0, b=1.0) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (_c(x) - _c(a)) / (_c(b) - _c(a))))


def exponential_pdf(x, lam=1.0) -> Column:
    return F.when(_c(x) < 0, 0.0).otherwise(_c(lam) * F.exp(-_c(lam) * _c(x)))


def exponential_cdf(x, lam=1.0) -> Column:
    return F.when(_c(x) < 0, 0.0).otherwise(-F.expm1(-_c(lam) * _c(x)))


def geometric_pmf(k, p) -> Column:
    """Trials until the first success, from 1."""
    return F.when(_c(k) >= 1, F.pow(1 - _c(p), _c(k) - 1) * _c(p)).otherwise(0.0)


def geometric_cdf(k, p) -> Column:
    return F.when(_c(k) >= 1, 1 - F.pow(1 - _c(p), F.floor(_c(k)))).otherwise(0.0)


def log_choose(n: float, k: float) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def _binomial(k: float, n: float, p: float) -> float:
    if not 0 <= k <= n:
        return 0.0
    if p in (0.0, 1.0):
        return float(k == n * p)
    return math.exp(log_choose(n, k) + k * math.log(p) + (n - k) * math.log1p(-p))


def _poisson(k: float, lam: float) -> float:
    return 0.0 if k < 0 else float(k == 0) if lam == 0 else math.exp(k * math.log(lam) - lam - math.lgamma(k + 1))


def _hyper(k: float, good: float, bad: float, draws: float) -> float:
    if not max(0, draws - bad) <= k <= min(draws, good):
        return 0.0
    return math.exp(log_choose(good, k) + log_choose(bad, draws - k) - log_choose(good + bad, draws))


def _hyper_cdf(k: float, good: float, bad: float, draws: float) -> float:
    return min(1.0, math.fsum(_hyper(i, good, bad, draws) for i in range(int(math.floor(k)) + 1))) if k >= 0 else 0.0


def _negative_binomial(k: float, r: float, p: float) -> float:
    return 0.0 if k < 0 else math.exp(log_choose(k + r - 1, k) + r * math.log(p) + (k * math.log1p(-p) if k else 0.0))


def _negative_binomial_cdf(k: float, r: float, p: float) -> float:
    return 0.0 if k < 0 else betai(r, math.floor(k) + 1.0, p)


def _chi2_pdf(x: float, df: float) -> float:
    return _gamma_pdf(x, df / 2, 2.0)


def _chi2_cdf(x: float, df: float) -> float:
    return gammp(df / 2, x / 2) if x > 0 else 0.0


def _t_pdf(x: float, df: float) -> float:
    return math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - (df + 1) / 2 * math.log1p(x * x / df)) / math.sqrt(df * math.pi)


def _t_cdf(x: float, df: float) -> float:
    tail = betai(df / 2, 0.5, df / (df + x * x)) / 2
    return 1 - tail if x > 0 else tail


def _gamma_pdf(x: float, shape: float, scale: float = 1.0) -> float:
    if x < 0 or x == 0 and shape > 1:
        return 0.0
    if x == 0:
        return 1 / scale if shape == 1 else math.inf
    return math.exp((shape - 1) * math.log(x / scale) - x / scale - math.lgamma(shape)) / scale


def _beta_pdf(x: float, a: float, b: float) -> float:
    return math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + (a - 1) * math.log(x) + (b - 1) * math.log1p(-x)) if 0 < x < 1 else 0.0


def _chi2_ppf(p: float, df: float) -> float:
    return bisect(lambda x: _chi2_cdf(x, df), p, 0.0, df + 100 * math.sqrt(2 * df) + 200)


def _t_ppf(p: float, df: float) -> float:
    top = 10.0
    while _t_cdf(top, df) < max(p, 1 - p):
        top *= 10
    return bisect(lambda x: _t_cdf(x, df), p, -top, top)


def _gamma_ppf(p: float, shape: float, scale: float = 1.0) -> float:
    return scale * bisect(lambda x: gammp(shape, x) if x > 0 else 0.0, p, 0.0, shape + 100 * math.sqrt(shape) + 100)


def _beta_ppf(p: float, a: float, b: float) -> float:
    return bisect(lambda x: betai(a, b, x), p, 0.0, 1.0)


binomial_pmf, poisson_pmf = column_function(_binomial), column_function(_poisson)
hypergeometric_pmf, hypergeometric_cdf = column_function(_hyper), column_function(_hyper_cdf)
negative_binomial_pmf, negative_binomial_cdf = column_function(_negative_binomial), column_function(_negative_binomial_cdf)
chi2_pdf, chi2_cdf, chi2_ppf = column_function(_chi2_pdf), column_function(_chi2_cdf), column_function(_chi2_ppf)
t_pdf, t_cdf, t_ppf = column_function(_t_pdf), column_function(_t_cdf), column_function(_t_ppf)
gamma_pdf, beta_pdf = column_function(_gamma_pdf), column_function(_beta_pdf)
gamma_ppf, beta_ppf = column_function(_gamma_ppf), column_function(_beta_ppf)


def uniform(seed: int, *key: Column) -> Column:
    """A number in (0, 1) that seed and key decide."""
    return (F.shiftrightunsigned(F.xxhash64(*key, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)


def draws(spark: SparkSession, n: int, seed: int = 0, streams: int = 1) -> DataFrame:
    """(id, u0, u1, ...) of n rows."""
    return spark.range(n).select("id", *[uniform(seed, F.col("id"), F.lit(k)).alias(f"u{k}") for k in range(streams)])


def uniform_sample(spark: SparkSession, a: float, b: float, n: int, seed: int = 0) -> DataFrame:
    return draws(spark, n, seed).select("id", (F.lit(a) + (b - a) * F.col("u0")).alias("x"))


def gaussian_sample(spark: SparkSession, n: int, mu: float = 0.0, sigma: float = 1.0, seed: int = 0) -> DataFrame:
    z = F.sqrt(-2 * F.log("u0")) * F.cos(2 * math.pi * F.col("u1"))
    return draws(spark, n, seed, 2).select("id", (mu + sigma * z).alias("x"))


def exponential_sample(spark: SparkSession, n: int, lam: float = 1.0, seed: int = 0) -> DataFrame:
    return draws(spark, n, seed).select("id", (-F.log("u0") / lam).alias("x"))


def poisson_sample(spark: SparkSession, n: int, lam: float = 1.0, seed: int = 0) -> DataFrame:
    """By inversion of the distribution function, term by term."""

    def at(u: float) -> float:
        k, p = 0, math.exp(-lam)
        total = p
        while total < u and k < 10_000:
            k += 1
            p *= lam / k
            total += p
        return float(k)

    return draws(spark, n, seed).select("id", column_function(at)("u0").cast("int").alias("x"))


def sample_gamma(spark: SparkSession, n: int, shape: float, scale: float = 1.0, seed: int = 0) -> DataFrame:
    """By the inverse of the distribution function."""
    f = column_function(lambda u: _gamma_ppf(u, shape, scale))
    return draws(spark, n, seed).select("id", f("u0").alias("x"))


def sample_beta(spark: SparkSession, n: int, a: float, b: float, seed: int = 0) -> DataFrame:
    f = column_function(lambda u: _beta_ppf(u, a, b))
    return draws(spark, n, seed).select("id", f("u0").alias("x"))
