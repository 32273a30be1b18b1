"""Tests of hypotheses, multiple testing, resampling and power.

Statistics are native aggregates over long tables (a group column and a value column); p-values are
taken from the one row a test leaves.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mensura.functions.special import betai, chi2_sf, column_function, f_sf, normal_cdf, normal_ppf, t_sf
from mensura.operators import ordering
from mensura.operators.common import Names, names, ratio, required, whole
from mensura.operators.descriptive import average_ranks


def _test(df: DataFrame, by: Names = None) -> DataFrame:
    return df.select(*names(by), "statistic", "df", "p_value")


def one_sample_ttest(df: DataFrame, value: str, popmean: float = 0.0, by: Names = None) -> DataFrame:
    """t, n - 1 and the two-sided p of a mean; a constant sample is an error."""
    s = df.groupBy(*names(by)).agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"), F.count(value).alias("n"))
    s = s.withColumn("statistic", required((F.col("n") > 1) & (F.col("v") > 0), "a t test needs spread", F.try_divide(F.col("m") - popmean, F.sqrt(F.col("v") / F.col("n")))))
    return _test(s.withColumn("df", F.col("n") - 1.0).withColumn("p_value", t_sf("statistic", "df")), by)


def two_groups(df: DataFrame, value: str, group: str, a, b, by: Names = None) -> DataFrame:
    """n, m and v (count, mean, sample variance) of both groups, side by side."""
    out = []
    for k, g in (("a", a), ("b", b)):
        x = F.when(F.col(group) == g, F.col(value))
        out += [F.count(x).alias(f"n{k}"), F.avg(x).alias(f"m{k}"), F.var_samp(x).alias(f"v{k}")]
    return df.groupBy(*names(by)).agg(*out)


def _pooled() -> Column:
    return F.try_divide((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb"), F.col("na") + F.col("nb") - 2)


def two_sample_ttest(df: DataFrame, value: str, group: str, a, b, equal_var: bool = True, by: Names = None) -> DataFrame:
    """Pooled t test, or Welch's with its approximate degrees of freedom."""
    s = two_groups(df, value, group, a, b, by)
    qa, qb = F.col("va") / F.col("na"), F.col("vb") / F.col("nb")
    if equal_var:
        se2, dof = _pooled() * (F.lit(1.0) / F.col("na") + F.lit(1.0) / F.col("nb")), F.col("na") + F.col("nb") - 2.0
    else:
        se2, dof = qa + qb, F.try_divide((qa + qb) * (qa + qb), qa * qa / (F.col("na") - 1) + qb * qb / (F.col("nb") - 1))
    s = s.withColumn("statistic", required((F.col("na") > 1) & (F.col("nb") > 1) & (se2 > 0), "a t test needs spread", F.try_divide(F.col("ma") - F.col("mb"), F.sqrt(se2)))).withColumn("df", dof)
    return _test(s.withColumn("p_value", t_sf("statistic", "df")), by)


def paired_ttest(df: DataFrame, a: str, b: str, by: Names = None) -> DataFrame:
    """Of a - b.  Differences that are all 0 give (0, 1), all equal else (+-inf, 0)."""
    d = F.col(a) - F.col(b)
    s = df.groupBy(*names(by)).agg(F.avg(d).alias("m"), F.var_samp(d).alias("v"), F.count(d).alias("n"))
    inf = F.lit(float("inf"))
    t = F.when(F.col("v") > 0, F.try_divide("m", F.sqrt(F.col("v") / F.col("n")))).when(F.col("m") == 0, 0.0).when(F.col("m") > 0, inf).otherwise(-inf)
    return _test(s.withColumn("statistic", required(F.col("n") > 1, "needs two pairs", t)).withColumn("df", F.col("n") - 1.0).withColumn("p_value", t_sf("statistic", "df")), by)


def chi_square_gof(df: DataFrame, observed: str, expected: str) -> DataFrame:
    """Over rows of categories; totals must agree and expectations be positive."""
    s = df.agg(F.sum((F.col(observed) - F.col(expected)) * (F.col(observed) - F.col(expected)) / F.when(F.col(expected) > 0, F.col(expected))).alias("x"), F.count(F.lit(1)).alias("k"), (F.abs(F.sum(observed) - F.sum(expected)) <= 1e-12 * F.greatest(F.lit(1.0), F.abs(F.sum(observed)))).alias("ok"), F.min(expected).alias("least"))
    s = s.withColumn("statistic", required(F.col("ok") & (F.col("least") > 0) & (F.col("k") > 1), "totals must agree and expectations be positive", F.col("x"))).withColumn("df", F.col("k") - 1.0)
    return _test(s.withColumn("p_value", chi2_sf("statistic", "df")))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, o, e) of each cell, empty ones too: levels are few, so their product is small."""
    counts = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("o"))
    rows = counts.groupBy(F.col("a").alias("la")).agg(F.sum("o").alias("ra"))
    cols = counts.groupBy(F.col("b").alias("lb")).agg(F.sum("o").alias("cb"))
    same = F.col("la").eqNullSafe(F.col("a")) & F.col("lb").eqNullSafe(F.col("b"))
    cells = rows.crossJoin(F.broadcast(cols)).join(counts, same, "left").select(F.col("la").alias("a"), F.col("lb").alias("b"), F.coalesce("o", F.lit(0)).alias("o"), "ra", "cb")
    n = F.sum("o").over(Window.partitionBy())
    return cells.select("a", "b", "o", (F.col("ra") * F.col("cb") / n).alias("e"), n.alias("n"))


def chi_square_independence(df: DataFrame, a: str, b: str) -> DataFrame:
    """statistic, df, p_value, and cramers_v, of the table of two columns."""
    d = F.col("o") - F.col("e")
    s = contingency(df, a, b).agg(F.sum(d * d / F.col("e")).alias("statistic"), F.countDistinct("a").alias("r"), F.countDistinct("b").alias("c"), F.first("n").alias("n"))
    s = s.withColumn("df", ((F.col("r") - 1) * (F.col("c") - 1)).cast("double")).withColumn("p_value", chi2_sf("statistic", "df"))
    return s.select("statistic", "df", "p_value", F.sqrt(ratio(F.col("statistic"), F.col("n") * (F.least("r", "c") - 1))).alias("cramers_v"))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    return chi_square_independence(df, a, b).select("cramers_v")


def one_way_anova(df: DataFrame, value: str, group: str, by: Names = None) -> DataFrame:
    """F, degrees between groups and within them, p and eta squared."""
    g = df.groupBy(*names(by), group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_pop(value) * F.count(value), F.lit(0.0)).alias("ss"))
    total = F.sum(F.col("n") * F.col("m")) / F.sum("n")
    s = g.groupBy(*names(by)).agg((F.sum(F.col("n") * F.col("m") * F.col("m")) - F.sum("n") * total * total).alias("between"), F.sum("ss").alias("within"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    s = s.withColumn("df", F.col("k") - 1.0).withColumn("df_within", F.col("n") - F.col("k") * 1.0)
    s = s.withColumn("statistic", required((F.col("df_within") > 0) & (F.col("within") > 0), "anova needs spread within groups", F.try_divide(F.col("between") / F.col("df"), F.col("within") / F.col("df_within"))))
    s = s.withColumn("p_value", f_sf("statistic", "df", "df_within"))
    return s.select(*names(by), "statistic", "df", "df_within", "p_value", eta_squared_from_f(F.col("statistic"), F.col("df"), F.col("df_within")).alias("eta_squared"))


def cohens_d(df: DataFrame, value: str, group: str, a, b, by: Names = None) -> DataFrame:
    return two_groups(df, value, group, a, b, by).select(*names(by), F.try_divide(F.col("ma") - F.col("mb"), F.sqrt(_pooled())).alias("cohens_d"))


def paired_cohens_d(df: DataFrame, a: str, b: str, by: Names = None) -> DataFrame:
    d = F.col(a) - F.col(b)
    m, sd, inf = F.avg(d), F.stddev_samp(d), F.lit(float("inf"))
    return df.groupBy(*names(by)).agg(F.when(sd > 0, F.try_divide(m, sd)).when(m == 0, 0.0).when(m > 0, inf).otherwise(-inf).alias("cohens_d"))


def eta_squared_from_f(f: Column, df1: Column, df2: Column) -> Column:
    return F.try_divide(f * df1, f * df1 + df2)


def bonferroni_corrected_alpha(alpha: float, k: int) -> float:
    if not 0 < alpha < 1 or k < 1:
        raise ValueError("alpha must be between 0 and 1, k positive")
    return alpha / k


# ---- multiple testing --------------------------------------------------------------------


def _adjusted(df: DataFrame, p: Column, alpha: float) -> DataFrame:
    return df.withColumn("adjusted", F.least(F.lit(1.0), p)).withColumn("rejected", F.col("adjusted") <= alpha)


def _along(df: DataFrame, p: str, key: Names, alpha: float, kind: str, value: Callable[[int], Column], backwards: bool) -> DataFrame:
    """A whole table's adjustment: the running extreme of value(number of rows) over ranges of p; _k is a row's number by p and key."""
    order = [p, *names(key)]
    dealt = ordering.carried(ordering.ranges(df, order), "sum", F.lit(1).cast("long"), "_k", order)
    found = ordering.carried(dealt, kind, value(df.count()), "_run", order, backwards=backwards)
    return _adjusted(found, F.col("_run"), alpha).drop("_k", "_run", ordering.PART)


def _placed(df: DataFrame, p: str, key: Names, by: Names) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*names(by)).orderBy(p, *names(key)))).withColumn("_m", F.count(F.lit(1)).over(whole(by)))


def bonferroni(df: DataFrame, p: str, key: Names = None, by: Names = None, alpha: float = 0.05) -> DataFrame:
    return _adjusted(df, F.col(p) * F.count(F.lit(1)).over(whole(by)), alpha)


def holm(df: DataFrame, p: str, key: Names, by: Names = None, alpha: float = 0.05) -> DataFrame:
    """Running maxima of (m - rank + 1) p; equal p in the order of key."""
    if not names(by):
        return _along(df, p, key, alpha, "max", lambda m: F.col(p) * (m - F.col("_k") + 1), False)
    up = Window.partitionBy(*names(by)).orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    return _adjusted(_placed(df, p, key, by), F.max(F.col(p) * (F.col("_m") - F.col("_k") + 1)).over(up), alpha).drop("_k", "_m")


def _step_up(df: DataFrame, p: str, key: Names, by: Names, alpha: float, factor: Column, of: Callable[[int], float] = lambda m: 1.0) -> DataFrame:
    """factor: a column over _m, the tests of a group; of: the same from the number of all tests."""
    if not names(by):
        return _along(df, p, key, alpha, "min", lambda m: F.col(p) * m / F.col("_k") * of(m), True)
    down = Window.partitionBy(*names(by)).orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)  # a running minimum from the largest p
    return _adjusted(_placed(df, p, key, by), F.min(F.col(p) * F.col("_m") / F.col("_k") * factor).over(down), alpha).drop("_k", "_m")


def benjamini_hochberg(df: DataFrame, p: str, key: Names, by: Names = None, alpha: float = 0.05) -> DataFrame:
    return _step_up(df, p, key, by, alpha, F.lit(1.0))


def benjamini_yekutieli(df: DataFrame, p: str, key: Names, by: Names = None, alpha: float = 0.05) -> DataFrame:
    harmonic = F.aggregate(F.sequence(F.lit(1), F.col("_m").cast("int")), F.lit(0.0), lambda s, i: s + F.lit(1.0) / i)
    return _step_up(df, p, key, by, alpha, harmonic, harmonic_number)


def harmonic_number(n: int) -> float:
    """1 + 1/2 + ... + 1/n; beyond ten million terms by its expansion, whose error is under 1e-30 there."""
    if n <= 10_000_000:
        return math.fsum(1 / i for i in range(1, n + 1))
    return math.log(n) + 0.5772156649015329 + 1 / (2 * n) - 1 / (12 * n * n)


METHODS = {"bonferroni": bonferroni, "holm": holm, "benjamini-hochberg": benjamini_hochberg, "benjamini-yekutieli": benjamini_yekutieli}


def adjust_p_values(df: DataFrame, p: str, key: Names, method: str = "benjamini-hochberg", by: Names = None, alpha: float = 0.05) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    return METHODS[method](df, p, key, by=by, alpha=alpha)


# ---- rank tests --------------------------------------------------------------------------


def _two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * (1 - normal_cdf(F.abs(z))))


def mann_whitney_u(df: DataFrame, value: str, group: str, a, b) -> DataFrame:
    """statistic (smaller U), z with tie correction, p_value, n_effective."""
    both = average_ranks(df.where(F.col(group).isin(a, b)), value, out="_r")
    ties = both.groupBy(value).agg(F.count(F.lit(1)).alias("t")).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).cast("double").alias("ties"))
    s = both.agg(F.count_if(F.col(group) == a).alias("na"), F.count_if(F.col(group) == b).alias("nb"), F.sum(F.when(F.col(group) == a, F.col("_r"))).alias("ra")).crossJoin(F.broadcast(ties))
    n, prod = F.col("na") + F.col("nb"), F.col("na") * F.col("nb") * 1.0
    ua = F.col("ra") - F.col("na") * (F.col("na") + 1) / 2
    s = s.withColumn("statistic", F.least(ua, prod - ua)).withColumn("v", prod / 12 * (n + 1 - ratio(F.col("ties"), n * (n - 1.0))))
    s = s.withColumn("z", ratio(F.col("statistic") - prod / 2, F.sqrt("v")))
    return s.select("statistic", "z", _two_sided(F.col("z")).alias("p_value"), n.alias("n_effective"))


def wilcoxon_signed_rank(df: DataFrame, difference: str) -> DataFrame:
    """statistic (sum of positive ranks), z with tie correction, p_value, n_effective; zeros are left out."""
    d = df.where(F.col(difference) != 0).withColumn("_a", F.abs(difference))
    ranked = average_ranks(d, "_a", out="_r")
    ties = ranked.groupBy("_a").agg(F.count(F.lit(1)).alias("t")).agg(F.coalesce(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")), F.lit(0)).cast("double").alias("ties"))
    s = ranked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col(difference) > 0, F.col("_r"))), F.lit(0.0)).alias("statistic")).crossJoin(F.broadcast(ties))
    n = F.col("n").cast("double")
    s = s.withColumn("z", ratio(F.col("statistic") - n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)))
    return s.select("statistic", "z", _two_sided(F.col("z")).alias("p_value"), F.col("n").alias("n_effective"))


# ---- resampling --------------------------------------------------------------------------


#: A prime and the multipliers of the hash that draws weights.
PRIME, _FIRST, _SECOND, _THIRD = 2_147_483_647, 48_271, 69_621, 16_807


def with_poisson_weight(df: DataFrame, row: str, resample: str, seed: int, out: str = "_w", most: int = 8) -> DataFrame:
    """df with how often a row is drawn in a resample: about Poisson with mean 1, from integers alone, so that any engine draws the same.

    row and resample are integers; their hash is a few squarings and products modulo a prime.  Each step is a
    column of its own, as what is used twice in one expression would be worked out twice.
    """
    df = df.withColumn("_z", (F.pmod(F.col(row), F.lit(PRIME)) * _FIRST + F.pmod(F.col(resample), F.lit(PRIME)) * _SECOND + seed) % PRIME)
    z = F.col("_z")
    for _ in range(3):
        df = df.withColumn("_z", (z * z % PRIME + z * _THIRD + 12_345) % PRIME)
    below, p, weight = 0.0, math.exp(-1), F.lit(0)
    for k in range(most):
        below += p
        weight = weight + (z >= math.ceil(below * PRIME)).cast("int")
        p /= k + 1
    return df.withColumn(out, weight).drop("_z")


@dataclass(frozen=True)
class Quantile:
    """The value at a share p of the rows in their order, between two neighbours in proportion.  Resamples find it by counts, so only draws close to it are shuffled."""

    p: float

    def __call__(self, value) -> Column:
        return F.percentile(value, self.p)


def _keyed(df: DataFrame, value: str, key: Names) -> DataFrame:
    """(x, _row) of rows with a value; _row is the integer that draws them."""
    rows = df.where(F.col(value).isNotNull())
    if key is None:
        rows = ordering.numbered(rows.select(value), [value], "_row")
    else:
        keys = names(key)
        whole = len(keys) == 1 and dict(df.dtypes)[keys[0]] in ("tinyint", "smallint", "int", "bigint")
        rows = rows.select(value, (F.col(keys[0]).cast("long") if whole else F.xxhash64(*keys)).alias("_row"))
    return rows.select(F.col(value).cast("double").alias("x"), "_row")


def _resampled(df: DataFrame, value: str, key: Names, n_resamples: int, seed: int, stat: Callable[[str], Column], out: str) -> DataFrame:
    """(b, out): stat over each resample.  Rows are read once and weighted where they are; what is shuffled are a task's partial aggregates, a row a resample."""
    each = _keyed(df, value, key).select("x", "_row", F.explode(F.sequence(F.lit(0), F.lit(n_resamples - 1))).alias("b"))
    drawn = with_poisson_weight(each.withColumn("b", F.col("b").cast("long")), "_row", "b", seed)
    return drawn.select("b", "x", F.explode(F.array_repeat(F.lit(True), F.col("_w"))).alias("_once")).groupBy("b").agg(stat("x").alias(out))


#: Ranges about a quantile, and one over the rank error of the values that part them.
RANGES, ACCURACY = 32, 10_000


def _parting(rows: DataFrame, p: float) -> list[float]:
    """Values that part the neighbourhood of a quantile, which all but a resample in 1e15 fall into."""
    around = 8 * math.sqrt(p * (1 - p) / max(1, rows.count())) + 4 / ACCURACY
    places = sorted({min(1.0, max(0.0, p + around * (2 * i / RANGES - 1))) for i in range(RANGES + 1)})
    found = rows.agg(F.percentile_approx("x", places, ACCURACY)).first()[0] or []
    return sorted({v for v in found if v == v})


def _resampled_quantile(df: DataFrame, value: str, key: Names, n_resamples: int, seed: int, p: float, out: str) -> DataFrame:
    """(b, out): the quantile of each resample, and with b = -1 that of the rows themselves.

    Values part the line into ranges, and each of them is a range of its own.  Draws are counted by resample and range; then
    the ranges that hold a resample's quantile are read again, and their values counted.  Wherever the values lie the
    result is the same; where they lie well a task shuffles some hundred counts a resample.
    """
    rows = _keyed(df, value, key)
    parting = _parting(rows, p)

    @F.pandas_udf("int")
    def place(x: pd.Series) -> pd.Series:  # a column of so many comparisons is too long a method for Java to compile
        return pd.Series(np.searchsorted(parting, x, "left") + np.searchsorted(parting, x, "right"), dtype="int32")

    rows = rows.select("x", "_row", place("x").alias("_at"))

    def drawn(each: DataFrame) -> DataFrame:
        # no filter here: Spark would put it before the steps of the hash, each worked out again wherever it is used
        return with_poisson_weight(each, "_row", "b", seed).withColumn("_w", F.when(F.col("b") < 0, 1).otherwise(F.col("_w")))

    every = rows.select("_at", "_row", F.explode(F.sequence(F.lit(-1).cast("long"), F.lit(n_resamples - 1).cast("long"))).alias("b"))
    counts = drawn(every).groupBy("b", "_at").agg(F.sum("_w").alias("_n"))
    along = Window.partitionBy("b").orderBy("_at")
    placed = counts.select("b", "_at", (F.sum("_n").over(along) - F.col("_n")).alias("_before"), "_n", (p * (F.sum("_n").over(Window.partitionBy("b")) - 1)).alias("_rank"))
    holds = placed.where((F.col("_before") <= F.ceil("_rank")) & (F.col("_before") + F.col("_n") > F.floor("_rank"))).select("b", "_at", "_before", "_rank")
    # a row or two a resample
    near = drawn(rows.join(F.broadcast(holds), "_at")).groupBy("b", "x").agg(F.sum("_w").alias("_n"), F.min("_before").alias("_before"), F.min("_rank").alias("_rank")).where("_n > 0")
    upto = F.min("_before").over(Window.partitionBy("b")) + F.sum("_n").over(Window.partitionBy("b").orderBy("x"))
    ends = near.withColumn("_upto", upto)
    at = lambda r: F.max(F.when((F.col("_upto") > r) & (F.col("_upto") - F.col("_n") <= r), F.col("x")))
    ends = ends.groupBy("b").agg(F.min("_rank").alias("_rank"), at(F.floor("_rank")).alias("_lo"), at(F.ceil("_rank")).alias("_hi"))
    between = (F.ceil("_rank") - F.col("_rank")) * F.col("_lo") + (F.col("_rank") - F.floor("_rank")) * F.col("_hi")
    return ends.select("b", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(between).alias(out))


def _quantile_interval(stats: DataFrame, n_resamples: int, confidence: float) -> DataFrame:
    """Of (b, s), whose estimate is that of b = -1."""
    tail = (1 - confidence) / 2
    s = F.when(F.col("b") >= 0, F.col("s"))
    ends = stats.agg(F.max(F.when(F.col("b") < 0, F.col("s"))).alias("estimate"), F.percentile(s, tail).alias("lower"), F.percentile(s, 1 - tail).alias("upper"), F.stddev_pop(s).alias("se"))
    return ends.select("estimate", "lower", "upper", F.lit(n_resamples).alias("n_resamples"), F.lit(confidence).alias("confidence"), "se")


def _interval(stats: DataFrame, estimate: DataFrame, n_resamples: int, confidence: float) -> DataFrame:
    tail = (1 - confidence) / 2
    ends = stats.agg(F.percentile("s", tail).alias("lower"), F.percentile("s", 1 - tail).alias("upper"), F.stddev_pop("s").alias("se"))
    return estimate.crossJoin(F.broadcast(ends)).select("estimate", "lower", "upper", F.lit(n_resamples).alias("n_resamples"), F.lit(confidence).alias("confidence"), "se")


def bootstrap_ci(df: DataFrame, value: str, stat: Callable[[str], Column] = F.avg, n_resamples: int = 5000, confidence: float = 0.95, seed: int = 0, key: Names = None) -> DataFrame:
    """Percentile interval of an aggregate over Poisson resamples; null values don't count.

    Each row enters each resample by a hash of seed, resample and key, so a task run again draws the same.  Without
    a key a row's number in the order of values takes its place.  A median or the like as Quantile(p).
    """
    _some(df, value)
    if isinstance(stat, Quantile):
        return _quantile_interval(_resampled_quantile(df, value, key, n_resamples, seed, stat.p, "s"), n_resamples, confidence)
    stats = _resampled(df, value, key, n_resamples, seed, stat, "s")
    return _interval(stats, df.agg(stat(value).alias("estimate")), n_resamples, confidence)


def bootstrap_diff_ci(df: DataFrame, value: str, group: str, a, b, stat: Callable[[str], Column] = F.avg, n_resamples: int = 5000, confidence: float = 0.95, seed: int = 0, key: Names = None) -> DataFrame:
    """Of stat(group a) - stat(group b); both are drawn by themselves."""
    for g in (a, b):
        _some(df.where(F.col(group) == g), value)
    if isinstance(stat, Quantile):
        one, other = (_resampled_quantile(df.where(F.col(group) == g), value, key, n_resamples, seed + i, stat.p, t) for i, (g, t) in enumerate(((a, "a"), (b, "c"))))
        return _quantile_interval(one.join(other, "b").select("b", (F.col("a") - F.col("c")).alias("s")), n_resamples, confidence)
    sides = [_resampled(df.where(F.col(group) == g), value, key, n_resamples, seed + i, stat, t) for i, (g, t) in enumerate(((a, "a"), (b, "c")))]
    stats = sides[0].join(sides[1], "b").select((F.col("a") - F.col("c")).alias("s"))
    one = [df.where(F.col(group) == g).agg(stat(value).alias(t)) for g, t in ((a, "a"), (b, "c"))]
    return _interval(stats, one[0].crossJoin(F.broadcast(one[1])).select((F.col("a") - F.col("c")).alias("estimate")), n_resamples, confidence)


def _some(df: DataFrame, value: str) -> None:
    if df.where(F.col(value).isNotNull()).limit(1).count() == 0:
        raise ValueError("no values to resample")


# ---- power -------------------------------------------------------------------------------


def _t_cdf(t: float, df: float) -> float:
    tail = betai(df / 2, 0.5, df / (df + t * t)) / 2
    return 1 - tail if t > 0 else tail


def _t_ppf(p: float, df: float) -> float:
    lo, hi = -1e3, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _t_cdf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


def power_t_test(effect_size: float, n_per_group: int, alpha: float = 0.05, two_sided: bool = True) -> float:
    """Power of the pooled t test, with the shifted central t for the noncentral one."""
    if n_per_group < 2:
        raise ValueError("needs two rows a group")
    df, shift = 2 * n_per_group - 2, abs(effect_size) * math.sqrt(n_per_group / 2)
    crit = _t_ppf(1 - (alpha / 2 if two_sided else alpha), df)
    return 1 - _t_cdf(crit - shift, df) + (_t_cdf(-crit - shift, df) if two_sided else 0.0)


def required_n_per_group(effect_size: float, target_power: float = 0.8, alpha: float = 0.05, two_sided: bool = True) -> int:
    """The smallest n from 2 to 10,000 with the power asked for."""
    lo, hi = 2, 10_000
    if power_t_test(effect_size, hi, alpha, two_sided) < target_power:
        raise ValueError("needs more than 10,000 rows a group")
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if power_t_test(effect_size, mid, alpha, two_sided) >= target_power else (mid + 1, hi)
    return lo


def power_proportion_test(p1: float, p2: float, n_per_group: int, alpha: float = 0.05, two_sided: bool = True) -> float:
    """Power of the z test of two proportions, by the normal approximation."""
    mean = (p1 + p2) / 2
    null, alt = math.sqrt(2 * mean * (1 - mean) / n_per_group), math.sqrt((p1 * (1 - p1) + p2 * (1 - p2)) / n_per_group)
    z, cdf = normal_ppf.plain(1 - (alpha / 2 if two_sided else alpha)), normal_cdf.plain
    return cdf((abs(p1 - p2) - z * null) / alt) + (cdf((-abs(p1 - p2) - z * null) / alt) if two_sided else 0.0)


def power_grid(df: DataFrame, effect: str, n: str, alpha: float = 0.05) -> DataFrame:
    """Rows of designs (effect size, rows a group) with their power."""
    of = column_function(lambda e, k: power_t_test(e, int(k), alpha))
    return df.withColumn("power", of(effect, n))
