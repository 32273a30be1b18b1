"""Effects of treatments under stated assumptions, mining of correlations, conjugate updates."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.functions.special import betai, bisect, gammp, normal_ppf, t_sf
from mensura.operators.common import Names, names
from mensura.operators.descriptive import gram, pearson, solve_gram
from mensura.operators.validation import FAIL, PASS, WARNING


@dataclass(frozen=True)
class CausalAssumptions:
    """What is known of each assumption: True, False, or None for unknown."""

    temporal_order: bool | None = None
    no_unmeasured_confounding: bool | None = None
    positivity: bool | None = None
    consistency: bool | None = None

    @property
    def identified(self) -> bool:
        return all(getattr(self, f.name) is True for f in fields(self))


def audit_causal_assumptions(spark: SparkSession, assumptions: CausalAssumptions) -> DataFrame:
    status = {True: PASS, False: FAIL, None: WARNING}
    return spark.createDataFrame([(f.name.replace("_", "-"), status[getattr(assumptions, f.name)]) for f in fields(assumptions)], "name string, status string")


def linear_backdoor_effect(df: DataFrame, outcome: str, treatment: str, covariates: list[str], assumptions: CausalAssumptions) -> DataFrame:
    """The treatment's coefficient in a least squares fit with the covariates; the rows are read once for its sums."""
    if not assumptions.identified:
        raise ValueError("the effect is not identified under these assumptions")
    state = gram(df, [treatment, *covariates], outcome).first().asDict()
    effect = solve_gram(state, 1 + len(covariates))[1]
    return df.sparkSession.createDataFrame([(float(effect), "linear-backdoor", state["n"], len(covariates))], "effect double, method string, n_observations bigint, adjustment_count int")


def randomized_mean_effect(df: DataFrame, outcome: str, treated: str, randomized: bool) -> DataFrame:
    """Mean outcome of treated rows less that of the others."""
    if randomized is not True:
        raise ValueError("a difference of means needs randomized treatment")
    y, t = F.col(outcome), F.col(treated).cast("boolean")
    return df.agg((F.avg(F.when(t, y)) - F.avg(F.when(~t, y))).alias("effect"), F.lit("randomized-mean").alias("method"), F.count(y).alias("n_observations"))


def mine_correlations(df: DataFrame, features: list[str], alpha: float = 0.05, min_abs_r: float = 0.3, max_features: int = 8) -> DataFrame:
    """(feature_a, feature_b, correlation, p_value, strength) of telling pairs of the first columns that aren't constant.

    All pairs come from one pass.  strength: weak under 0.2, moderate under 0.5, else strong.
    """
    spread = df.agg(*[F.var_pop(c).alias(c) for c in features]).first()
    chosen = [c for c in features if (spread[c] or 0) > 0][:max_features]
    pairs = list(itertools.combinations(chosen, 2))
    schema = "feature_a string, feature_b string, correlation double, n bigint"
    if not pairs:
        rows = df.sparkSession.createDataFrame([], schema)
    else:
        wide = df.agg(F.count(F.lit(1)).alias("n"), *[pearson(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
        rows = wide.select("n", F.explode(F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"r{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)])).alias("s")).select("s.*", "n")
    r, dof = F.col("correlation"), F.col("n") - 2.0
    p = F.when(F.abs(r) >= 1, 0.0).otherwise(t_sf(r * F.sqrt(F.try_divide(dof, 1 - r * r)), dof))
    strength = F.when(F.abs(r) < 0.2, "weak").when(F.abs(r) < 0.5, "moderate").otherwise("strong")
    found = rows.withColumn("p_value", p).withColumn("strength", strength)
    return found.where((F.abs("correlation") >= min_abs_r) & (F.col("p_value") < alpha)).orderBy(F.desc(F.abs("correlation")), "feature_a", "feature_b").drop("n")


# ---- conjugate updates -------------------------------------------------------------------


def beta_credible_interval(alpha: float, beta: float, level: float = 0.95) -> tuple[float, float]:
    tail = (1 - level) / 2
    return tuple(bisect(lambda x: betai(alpha, beta, x), p, 0.0, 1.0) for p in (tail, 1 - tail))


credible_interval = beta_credible_interval


def gamma_credible_interval(alpha: float, beta: float, level: float = 0.95) -> tuple[float, float]:
    """Of a gamma distribution with rate beta."""
    tail, top = (1 - level) / 2, (alpha + 20 * math.sqrt(alpha) + 50) / beta
    return tuple(bisect(lambda x: gammp(alpha, beta * x), p, 0.0, top) for p in (tail, 1 - tail))


def normal_credible_interval(mu: float, sigma: float, level: float = 0.95) -> tuple[float, float]:
    z = normal_ppf.plain((1 + level) / 2)
    return mu - z * sigma, mu + z * sigma


def beta_binomial_update(df: DataFrame, success: str, by: Names = None, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """Posterior of a rate from rows of 0 and 1: alpha, beta, mean, variance."""
    s = df.groupBy(*names(by)).agg((F.lit(alpha) + F.sum(success)).alias("alpha"), (F.lit(beta) + F.count(success) - F.sum(success)).alias("beta"))
    n = F.col("alpha") + F.col("beta")
    return s.withColumn("mean", F.col("alpha") / n).withColumn("variance", F.col("alpha") * F.col("beta") / (n * n * (n + 1)))


def gamma_poisson_update(df: DataFrame, count: str, by: Names = None, alpha: float = 1.0, beta: float = 1.0, exposure: str | None = None) -> DataFrame:
    """Posterior of a rate from counts, with the exposure of each row (1 by default)."""
    e = F.sum(exposure) if exposure else F.count(count)
    s = df.groupBy(*names(by)).agg((F.lit(alpha) + F.sum(count)).alias("alpha"), (F.lit(beta) + e).alias("beta"))
    return s.withColumn("mean", F.col("alpha") / F.col("beta")).withColumn("variance", F.col("alpha") / (F.col("beta") * F.col("beta")))


def normal_normal_update(df: DataFrame, value: str, mu0: float, sigma0: float, sigma: float, by: Names = None) -> DataFrame:
    """Posterior mean and deviation of a mean with known deviation sigma."""
    s = df.groupBy(*names(by)).agg(F.count(value).alias("n"), F.coalesce(F.sum(value), F.lit(0.0)).alias("s"))
    precision = F.lit(1 / sigma0**2) + F.col("n") / sigma**2
    return s.select(*names(by), ((F.lit(mu0 / sigma0**2) + F.col("s") / sigma**2) / precision).alias("mean"), F.sqrt(1 / precision).alias("sd"), "n")


def bayes_factor(k: int, n: int, p0: float, alpha: float = 1.0, beta: float = 1.0) -> float:
    """Evidence for an unknown rate over the rate p0, of k successes in n."""
    log_beta = lambda a, b: math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    free = log_beta(alpha + k, beta + n - k) - log_beta(alpha, beta)
    point = (k * math.log(p0) if k else 0.0) + ((n - k) * math.log1p(-p0) if n > k else 0.0)
    return math.exp(free - point)


def interval_columns(posterior: DataFrame, level: float = 0.95) -> DataFrame:
    """posterior (alpha, beta of a beta distribution) with lower and upper; groups are few after an update."""
    both = F.udf(lambda a, b: list(map(float, beta_credible_interval(a, b, level))), "array<double>")
    return posterior.withColumn("_ci", both("alpha", "beta")).withColumn("lower", F.col("_ci")[0]).withColumn("upper", F.col("_ci")[1]).drop("_ci")


