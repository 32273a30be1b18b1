"""Monte Carlo, Markov chains, sensitivity and propagation of uncertainty.

Models are functions of Columns where they can be, so that samples never leave the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mensura.functions.distributions import draws

Model = Callable[..., Column]


def _result(hits: DataFrame, scale: float) -> DataFrame:
    """estimate, samples, std_error from a table with a column v."""
    return hits.agg((F.avg("v") * scale).alias("estimate"), F.count(F.lit(1)).alias("samples"), (abs(scale) * F.stddev_pop("v") / F.sqrt(F.count(F.lit(1)))).alias("std_error"))


def estimate_pi(spark: SparkSession, n_samples: int = 100_000, seed: int = 0) -> DataFrame:
    inside = F.col("u0") * F.col("u0") + F.col("u1") * F.col("u1") <= 1
    return _result(draws(spark, n_samples, seed, 2).select(inside.cast("double").alias("v")), 4.0)


def mc_integrate(spark: SparkSession, f: Callable[[Column], Column], a: float, b: float, n_samples: int = 100_000, seed: int = 0) -> DataFrame:
    """(b - a) times the mean of f; reversed bounds change the sign."""
    return _result(draws(spark, n_samples, seed).select(f(F.lit(a) + (b - a) * F.col("u0")).alias("v")), b - a)


def mc_expectation(spark: SparkSession, f: Callable[[Column], Column], n_samples: int = 10_000, a: float = 0.0, b: float = 1.0, seed: int = 0) -> DataFrame:
    return _result(draws(spark, n_samples, seed).select(f(F.lit(a) + (b - a) * F.col("u0")).alias("v")), 1.0)


def hit_or_miss(spark: SparkSession, predicate: Callable[[Column, Column], Column], x_range: tuple[float, float], y_range: tuple[float, float], n_samples: int = 50_000, seed: int = 0) -> DataFrame:
    (a, b), (c, d) = x_range, y_range
    hit = predicate(F.lit(a) + (b - a) * F.col("u0"), F.lit(c) + (d - c) * F.col("u1"))
    return _result(draws(spark, n_samples, seed, 2).select(hit.cast("double").alias("v")), (b - a) * (d - c))


def buffon_needle(spark: SparkSession, needle_length: float = 1.0, line_spacing: float = 2.0, n_throws: int = 100_000, seed: int = 0) -> DataFrame:
    """An estimate of pi from the share p of crossings, 2 l / (d p)."""
    if not 0 < needle_length <= line_spacing:
        raise ValueError("the needle must be no longer than the spacing")
    cross = F.col("u0") * line_spacing / 2 <= needle_length / 2 * F.sin(F.col("u1") * math.pi / 2)
    s = draws(spark, n_throws, seed, 2).agg(F.avg(cross.cast("double")).alias("p"), F.count(F.lit(1)).alias("samples"))
    p = F.when(F.col("p") > 0, F.col("p")).otherwise(F.raise_error(F.lit("no needle crossed a line")))
    est = 2 * needle_length / (line_spacing * p)
    return s.select(est.alias("estimate"), "samples", (est * F.sqrt((1 - F.col("p")) / (F.col("p") * F.col("samples")))).alias("std_error"))


def random_walk_1d(spark: SparkSession, steps: int, step_size: float = 1.0, seed: int = 0, walks: int = 1) -> DataFrame:
    """(walk, step, x) from the origin on; walks run side by side."""
    w = Window.partitionBy("walk").orderBy("step")
    s = spark.range(walks).withColumnRenamed("id", "walk").withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    move = F.when(F.col("step") == 0, 0.0).when(F.xxhash64("walk", "step", F.lit(seed)) % 2 == 0, step_size).otherwise(-step_size)
    return s.withColumn("x", F.sum(move).over(w))


def random_walk_2d(spark: SparkSession, steps: int, step_size: float = 1.0, seed: int = 0, walks: int = 1) -> DataFrame:
    w = Window.partitionBy("walk").orderBy("step")
    s = spark.range(walks).withColumnRenamed("id", "walk").withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    angle = F.shiftrightunsigned(F.xxhash64("walk", "step", F.lit(seed)), 11) / float(1 << 53) * 2 * math.pi
    length = F.when(F.col("step") == 0, 0.0).otherwise(step_size)
    return s.withColumn("x", F.sum(length * F.cos(angle)).over(w)).withColumn("y", F.sum(length * F.sin(angle)).over(w))


def metropolis_hastings(spark: SparkSession, log_target: Callable[[float], float], x0: float, n_samples: int = 5000, burn_in: int = 500, thin: int = 1, proposal_scale: float = 1.0, seed: int = 0, chains: int = 1) -> DataFrame:
    """(chain, sample, x, acceptance_rate); a chain is sequential, chains run side by side."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        c = int(part["chain"].iloc[0])
        rng, x, took, out = np.random.default_rng((seed, c)), x0, 0, []
        at = log_target(x)
        for i in range(burn_in + n_samples * thin):
            y = x + rng.normal(0, proposal_scale)
            new = log_target(y)
            if math.log(max(rng.random(), 1e-300)) < new - at:
                x, at, took = y, new, took + 1
            if i >= burn_in and (i - burn_in) % thin == 0:
                out.append(x)
        return pd.DataFrame({"chain": c, "sample": range(len(out)), "x": out, "acceptance_rate": took / (burn_in + n_samples * thin)})

    return spark.range(chains).withColumnRenamed("id", "chain").groupBy("chain").applyInPandas(run, "chain long, sample int, x double, acceptance_rate double")


# ---- sensitivity -------------------------------------------------------------------------


def _steps(parameters: Sequence[float], relative: float, absolute: float) -> list[float]:
    return [max(abs(p) * relative, absolute) for p in parameters]


def local_sensitivity(model: Callable[[list[float]], float], parameters: Sequence[float], relative_step: float = 1e-6, absolute_step: float = 1e-8) -> list[dict]:
    """Central differences; normalized is derivative x parameter / output, None for an output of 0."""
    base, p, out = model(list(parameters)), list(parameters), []
    for i, h in enumerate(_steps(p, relative_step, absolute_step)):
        up, down = (model([*p[:i], p[i] + s * h, *p[i + 1 :]]) for s in (1, -1))
        d = (up - down) / (2 * h)
        out.append({"index": i, "baseline": p[i], "step": h, "derivative": d, "normalized": d * p[i] / base if base else None})
    return out


def _scaled(u: Column, bound: tuple[float, float]) -> Column:
    return F.lit(float(bound[0])) + (bound[1] - bound[0]) * u


def global_sensitivity(spark: SparkSession, model: Model, bounds: Sequence[tuple[float, float]], trajectories: int = 32, levels: int = 8, seed: int = 0) -> DataFrame:
    """(index, mean_effect, mean_absolute_effect, effect_std, monotonicity) of elementary effects over random baselines."""
    d = len(bounds)
    step = 1 / (levels - 1)
    grid = [F.floor(F.col(f"u{i}") * (levels - 1)) * step for i in range(d)]
    at = [_scaled(g, b) for g, b in zip(grid, bounds)]
    effects = [(model(*[_scaled(grid[j] + step, bounds[j]) if j == i else at[j] for j in range(d)]) - model(*at)) / step for i in range(d)]
    rows = draws(spark, trajectories, seed, d).select(F.explode(F.array(*[F.struct(F.lit(i).alias("index"), e.alias("e")) for i, e in enumerate(effects)])).alias("s")).select("s.*")
    s = rows.groupBy("index").agg(F.avg("e").alias("mean_effect"), F.avg(F.abs("e")).alias("mean_absolute_effect"), F.stddev_pop("e").alias("effect_std"))
    return s.withColumn("monotonicity", F.when(F.col("mean_absolute_effect") > 0, F.abs(F.try_divide("mean_effect", "mean_absolute_effect"))).otherwise(0.0))


def variance_global_sensitivity(spark: SparkSession, model: Model, bounds: Sequence[tuple[float, float]], samples: int = 2048, seed: int = 0, variance_tolerance: float = 1e-15) -> DataFrame:
    """(index, first_order, total_order) from two samples and their mixtures, all in one aggregate."""
    d = len(bounds)
    a = [_scaled(F.col(f"u{i}"), b) for i, b in enumerate(bounds)]
    b = [_scaled(F.col(f"u{d + i}"), x) for i, x in enumerate(bounds)]
    rows = draws(spark, samples, seed, 2 * d).select(model(*a).alias("fa"), model(*b).alias("fb"), *[model(*[b[j] if j == i else a[j] for j in range(d)]).alias(f"m{i}") for i in range(d)])
    both = F.avg(F.col("fa") * F.col("fa") + F.col("fb") * F.col("fb")) / 2 - F.pow((F.avg("fa") + F.avg("fb")) / 2, 2)
    wide = rows.agg(both.alias("v"), *[F.avg(F.col("fb") * (F.col(f"m{i}") - F.col("fa"))).alias(f"s{i}") for i in range(d)], *[(F.avg(F.pow(F.col("fa") - F.col(f"m{i}"), 2)) / 2).alias(f"t{i}") for i in range(d)])
    share = lambda x: F.when(F.col("v") > variance_tolerance, F.try_divide(x, F.col("v"))).otherwise(0.0)
    return wide.select(F.explode(F.array(*[F.struct(F.lit(i).alias("index"), share(F.col(f"s{i}")).alias("first_order"), share(F.col(f"t{i}")).alias("total_order")) for i in range(d)])).alias("s")).select("s.*")


def local_identifiability(model: Callable[[list[float]], Sequence[float]], parameters: Sequence[float], relative_step: float = 1e-6, absolute_step: float = 1e-8, rank_tolerance: float = 1e-9) -> dict:
    """Rank of the finite-difference Jacobian, and which parameters add to it in their order."""
    p, cols = list(parameters), []
    for i, h in enumerate(_steps(p, relative_step, absolute_step)):
        up, down = (np.array(model([*p[:i], p[i] + s * h, *p[i + 1 :]]), float) for s in (1, -1))
        cols.append((up - down) / (2 * h))
    basis, independent = [], []
    for c in cols:
        v = c.copy()
        for q in basis:
            v -= (q @ v) * q
        ok = bool(np.linalg.norm(v) > rank_tolerance * max(1.0, np.linalg.norm(c)))
        independent.append(ok)
        if ok:
            basis.append(v / np.linalg.norm(v))
    return {"rank": len(basis), "parameter_count": len(p), "output_count": len(cols[0]), "identifiable": len(basis) == len(p), "independent_parameters": independent, "jacobian": np.array(cols).T.tolist()}


# ---- uncertainty -------------------------------------------------------------------------


@dataclass(frozen=True)
class UncertainValue:
    value: float
    standard_uncertainty: float

    def __post_init__(self) -> None:
        if self.standard_uncertainty < 0:
            raise ValueError("an uncertainty is 0 or more")


def _covariance(n: int, standard: Sequence[float] | None, covariance) -> np.ndarray:
    if (standard is None) == (covariance is None):
        raise ValueError("give standard uncertainties or a covariance")
    c = np.diag(np.square(standard)) if covariance is None else np.array(covariance, float)
    if c.shape != (n, n) or not np.allclose(c, c.T) or np.linalg.eigvalsh(c).min() < -1e-10 * max(1.0, np.abs(c).max()):
        raise ValueError("the covariance is not symmetric and positive")
    return c


def propagate_linear(function: Callable[..., float], means: Sequence[float], standard_uncertainties: Sequence[float] | None = None, covariance=None) -> dict:
    c = _covariance(len(means), standard_uncertainties, covariance)
    g = np.array([r["derivative"] for r in local_sensitivity(lambda p: function(*p), means)])
    v = float(g @ c @ g)
    return {"value": function(*means), "standard_uncertainty": math.sqrt(max(0.0, v)), "variance": v, "sensitivities": g.tolist(), "method": "linear"}


def propagate_monte_carlo(spark: SparkSession, function: Model, means: Sequence[float], standard_uncertainties: Sequence[float] | None = None, covariance=None, samples: int = 10_000, seed: int = 0, confidence: float = 0.95) -> DataFrame:
    """mean, standard_deviation, lower, upper of a function of Columns over correlated normal draws."""
    n = len(means)
    c = _covariance(n, standard_uncertainties, covariance)
    values, vectors = np.linalg.eigh(c)
    root = vectors * np.sqrt(np.maximum(values, 0))
    z = [F.sqrt(-2 * F.log(f"u{2 * i}")) * F.cos(2 * math.pi * F.col(f"u{2 * i + 1}")) for i in range(n)]
    x = [sum((z[j] * float(root[i, j]) for j in range(n)), F.lit(float(means[i]))) for i in range(n)]
    tail = (1 - confidence) / 2
    out = draws(spark, samples, seed, 2 * n).select(function(*x).alias("y"))
    return out.agg(F.avg("y").alias("mean"), F.stddev_samp("y").alias("standard_deviation"), F.percentile("y", tail).alias("lower"), F.percentile("y", 1 - tail).alias("upper"), F.count(F.lit(1)).alias("samples"))
