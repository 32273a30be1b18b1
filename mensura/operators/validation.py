"""Checks of data and results.  A check is a row (name, status, message, details); a report is a union of checks.

status is pass, warning or fail.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mensura.operators import ordering
from mensura.operators.common import Names, names, ordered

PASS, WARNING, FAIL = "pass", "warning", "fail"


def check(df: DataFrame, name: str, ok: Column, details: dict[str, Column], worse: str = FAIL, message: str = "") -> DataFrame:
    """One check row from a one-row table."""
    pairs = [x for k, v in details.items() for x in (F.lit(k), v.cast("string"))]
    good = F.coalesce(ok, F.lit(False))
    return df.select(F.lit(name).alias("name"), F.when(good, PASS).otherwise(worse).alias("status"), F.when(good, "").otherwise(message or name + " does not hold").alias("message"), (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("details"))


def report(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


final_audit = report


def passed(checks: DataFrame) -> DataFrame:
    """One row: did nothing fail?"""
    return checks.agg((F.count_if(F.col("status") == FAIL) == 0).alias("passed"))


def _violations(df: DataFrame, bad: Column, key: Names, name: str, limit: int = 20) -> DataFrame:
    """Fails with the number of bad rows and the first few of their keys."""
    k = F.struct(*names(key))
    seen = df.agg(F.count_if(bad).alias("n"), F.slice(F.array_sort(F.array_agg(F.when(bad, k))), 1, limit).alias("keys")) if limit == 0 else df.where(bad).orderBy(*names(key)).limit(limit).agg(F.to_json(F.collect_list(k)).alias("keys")).crossJoin(F.broadcast(df.agg(F.count_if(bad).alias("n"))))
    return check(seen, name, F.col("n") == 0, {"violations": F.col("n"), "first": F.col("keys")})


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def check_finite(df: DataFrame, value: str, key: Names, name: str = "finite-values") -> DataFrame:
    return _violations(df, ~_finite(F.col(value).cast("double")), key, name)


def check_positive(df: DataFrame, value: str, key: Names, allow_zero: bool = False, name: str = "positive-domain") -> DataFrame:
    x = F.col(value).cast("double")
    return _violations(df, ~(_finite(x) & ((x >= 0) if allow_zero else (x > 0))), key, name)


def check_bounds(df: DataFrame, bounds: dict[str, tuple[float, float]], key: Names, name: str = "domain-bounds") -> DataFrame:
    """A bound that is not ordered or not finite is a violation too."""
    bad = F.lit(False)
    for c, (lo, hi) in bounds.items():
        ok = math.isfinite(lo) and math.isfinite(hi) and lo <= hi
        bad = bad | (~F.coalesce(F.col(c).between(lo, hi), F.lit(False)) if ok else F.lit(True))
    return _violations(df, bad, key, name)


def check_monotonic(df: DataFrame, value: str, order_by: Names, by: Names = None, increasing: bool = True, strict: bool = False, name: str = "monotonic-domain") -> DataFrame:
    """The rows after which order breaks are the violations."""
    nxt = F.lead(value).over(ordered(by, order_by))
    a, b = (F.col(value), F.col("_next")) if increasing else (F.col("_next"), F.col(value))
    return _violations(df.withColumn("_next", nxt), F.coalesce(~((a < b) if strict else (a <= b)), F.lit(False)), [*names(by), *names(order_by)], name)


def cross_method_agreement(df: DataFrame, primary: str, secondary: str, rtol: float = 1e-6, atol: float = 1e-9, name: str = "cross-method-agreement") -> DataFrame:
    """Over a one-row table of two results."""
    a, b = F.col(primary), F.col(secondary)
    return check(df, name, F.abs(a - b) <= atol + rtol * F.greatest(F.abs(a), F.abs(b)), {"difference": F.abs(a - b)})


def check_conservation(df: DataFrame, before: str, after: str, rtol: float = 1e-9, atol: float = 1e-12, name: str = "conservation") -> DataFrame:
    return cross_method_agreement(df, before, after, rtol, atol, name)


def check_duplicate_rows(train: DataFrame, test: DataFrame, cols: Names = None, name: str = "data-leakage") -> DataFrame:
    """Test rows that are in train, nulls equal to nulls."""
    return check(duplicate_rows(train, test, cols).agg(F.count(F.lit(1)).alias("n")), name, F.col("n") == 0, {"duplicates": F.col("n")})


def duplicate_rows(train: DataFrame, test: DataFrame, cols: Names = None) -> DataFrame:
    t = train.select(*[F.col(c).alias(f"_{c}") for c in names(cols) or test.columns]).distinct()
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names(cols) or test.columns])
    return test.join(t, on, "left_semi")


def shared_groups(train: DataFrame, test: DataFrame, group: str) -> DataFrame:
    return train.select(group).intersect(test.select(group))


def check_group_leakage(train: DataFrame, test: DataFrame, group: str, name: str = "group-leakage") -> DataFrame:
    return check(shared_groups(train, test, group).agg(F.count(F.lit(1)).alias("n")), name, F.col("n") == 0, {"shared": F.col("n")})


def ood_ranges(training: DataFrame, candidates: DataFrame, features: list[str], margin_fraction: float = 0.0) -> DataFrame:
    """candidates with `outside`: beyond the training range, widened by a share of it, in any feature."""
    ends = training.agg(*[f(c).alias(f"_{n}_{c}") for c in features for n, f in (("lo", F.min), ("hi", F.max))])
    out = F.lit(False)
    for c in features:
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        out = out | ~F.coalesce(F.col(c).between(lo - margin_fraction * (hi - lo), hi + margin_fraction * (hi - lo)), F.lit(False))
    return candidates.crossJoin(F.broadcast(ends)).withColumn("outside", out).drop(*ends.columns)


def check_ood_ranges(training: DataFrame, candidates: DataFrame, features: list[str], allowed_fraction: float = 0.0, margin_fraction: float = 0.0, name: str = "out-of-distribution-range") -> DataFrame:
    share = ood_ranges(training, candidates, features, margin_fraction).agg(F.avg(F.col("outside").cast("double")).alias("share"))
    return check(share, name, F.col("share") <= allowed_fraction, {"share": F.col("share")})


def drift_of_moments(reference: DataFrame, current: DataFrame, value: str) -> DataFrame:
    """One row: standardized shift of the mean (deviation at least 1e-12) and ratio of variances (larger to smaller)."""
    stats = lambda df, k: df.agg(F.avg(value).alias(f"m{k}"), F.var_pop(value).alias(f"v{k}"))
    s = stats(reference, "r").crossJoin(F.broadcast(stats(current, "c")))
    tiny = F.lit(1e-12)
    vr, vc = F.greatest("vr", tiny * tiny), F.greatest("vc", tiny * tiny)
    return s.select((F.abs(F.col("mc") - F.col("mr")) / F.greatest(F.sqrt("vr"), tiny)).alias("shift"), (F.greatest(vr, vc) / F.least(vr, vc)).alias("variance_ratio"))


def check_distribution_drift(reference: DataFrame, current: DataFrame, value: str, max_standardized_mean_shift: float = 0.5, max_variance_ratio: float = 2.0, name: str = "distribution-drift") -> DataFrame:
    s = drift_of_moments(reference, current, value)
    ok = (F.col("shift") <= max_standardized_mean_shift) & (F.col("variance_ratio") <= max_variance_ratio)
    out = check(s, name, ok, {c: F.col(c) for c in s.columns}, WARNING)
    return out.withColumn("status", F.when(F.col("details")["shift"].cast("double") == float("inf"), FAIL).otherwise(F.col("status")))


def residual_diagnostics(df: DataFrame, residual: str, order_by: Names) -> DataFrame:
    """One row: bias in standard errors, first autocorrelation, ratio of the halves' variances."""
    order = names(order_by)
    ranged = ordering.ranges(df.select(F.col(residual).cast("double").alias("r"), *order), order)
    s = ordering.carried(ranged, "sum", F.lit(1).cast("long"), "i", order)
    s = ordering.carried(s, "lag", "r", "prior", order)
    s = s.crossJoin(F.broadcast(ranged.agg(F.avg("r").alias("m"), F.count(F.lit(1)).alias("n"))))  # one row
    d = F.col("r") - F.col("m")
    s = s.withColumn("p", d * (F.col("prior") - F.col("m"))).withColumn("first", F.col("i") <= F.floor(F.col("n") / 2))
    a = s.agg(F.first("m").alias("m"), F.first("n").alias("n"), F.var_samp("r").alias("v"), F.sum("p").alias("p"), F.sum(d * d).alias("q"), F.var_pop(F.when(F.col("first"), F.col("r"))).alias("v1"), F.var_pop(F.when(~F.col("first"), F.col("r"))).alias("v2"))
    tiny = F.lit(1e-300)
    return a.select((F.abs("m") / F.greatest(F.sqrt(F.col("v") / F.col("n")), tiny)).alias("bias_z"), F.abs(F.coalesce(F.try_divide("p", "q"), F.lit(0.0))).alias("lag1"), (F.greatest("v1", "v2", tiny) / F.greatest(F.least("v1", "v2"), tiny)).alias("variance_ratio"))


def check_residual_diagnostics(df: DataFrame, residual: str, order_by: Names, max_bias_z: float = 2.0, max_abs_lag1: float = 0.3, max_variance_ratio: float = 2.0, name: str = "residual-diagnostics") -> DataFrame:
    s = residual_diagnostics(df, residual, order_by)
    return check(s, name, (F.col("bias_z") <= max_bias_z) & (F.col("lag1") <= max_abs_lag1) & (F.col("variance_ratio") <= max_variance_ratio), {c: F.col(c) for c in s.columns}, WARNING)


def check_numerical_stability(spark: SparkSession, function: Callable[[float], float], point: float, relative_step: float = 1e-7, max_relative_change: float = 1e-4, name: str = "numerical-stability") -> DataFrame:
    h = relative_step * max(1.0, abs(point))
    y = function(point)
    change = max(abs(function(point + h) - y), abs(function(point - h) - y)) / max(abs(y), 1e-300)
    return check(spark.createDataFrame([(float(change),)], "change double"), name, F.col("change") <= max_relative_change, {"change": F.col("change")})


def data_profile(df: DataFrame, parameters: int = 0) -> DataFrame:
    cells = reduce(lambda a, b: a + b, [F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns])
    return df.agg(F.count(F.lit(1)).alias("observations"), (F.count(F.lit(1)) * len(df.columns)).alias("total_values"), cells.alias("missing_values"), F.lit(parameters).alias("parameters"))


def assess_data_adequacy(profile: DataFrame, min_observations: int, max_missing_fraction: float, min_observations_per_parameter: float | None = None, name_prefix: str = "data-adequacy") -> DataFrame:
    """Two or three checks of a profile; no parameters fail the third."""
    share = F.coalesce(F.try_divide("missing_values", "total_values"), F.lit(0.0))
    out = [
        check(profile, f"{name_prefix}:observations", F.col("observations") >= min_observations, {"observations": F.col("observations")}),
        check(profile, f"{name_prefix}:missing", share <= max_missing_fraction, {"fraction": share}),
    ]
    if min_observations_per_parameter is not None:
        per = F.try_divide("observations", "parameters")
        out.append(check(profile, f"{name_prefix}:parameters", per >= min_observations_per_parameter, {"ratio": per}))
    return report(*out)


# ---- drift and outliers ------------------------------------------------------------------


def ks_distances(reference: DataFrame, current: DataFrame, features: list[str]) -> DataFrame:
    """(feature, ks_distance): the largest gap of two empirical distribution functions.

    Rows are first counted by value, so the ordered pass sees each distinct value once, in ranges of values.
    """
    side = lambda df, k: df.select(*[F.col(c).cast("double").alias(c) for c in features]).unpivot([], features, "feature", "x").where("x is not null").select("feature", "x", F.lit(k).alias("k"))
    counts = side(reference, 0).unionByName(side(current, 1)).groupBy("feature", "x").agg(F.count_if(F.col("k") == 0).alias("a"), F.count_if(F.col("k") == 1).alias("b"))
    order = ["feature", "x"]
    dealt = ordering.ranges(counts, order)
    for side_, out in (("a", "up_a"), ("b", "up_b")):
        dealt = ordering.carried(dealt, "sum", side_, out, ["x"], "feature")
    whole = counts.groupBy("feature").agg(F.sum("a").alias("all_a"), F.sum("b").alias("all_b"))  # a row a feature
    gap = F.abs(F.col("up_a") / F.col("all_a") - F.col("up_b") / F.col("all_b"))
    return dealt.join(whole, "feature").withColumn("gap", gap).groupBy("feature").agg(F.max("gap").alias("ks_distance"))


def empirical_ks_distance(reference: DataFrame, current: DataFrame, value: str) -> DataFrame:
    return ks_distances(reference, current, [value]).select("ks_distance")


def feature_drift(reference: DataFrame, current: DataFrame, features: list[str], threshold: float = 0.2) -> DataFrame:
    return ks_distances(reference, current, features).withColumn("drifted", F.col("ks_distance") > threshold)


def screen_ood(reference: DataFrame, observations: DataFrame, features: list[str], z_threshold: float = 4.0) -> DataFrame:
    """observations with max_abs_z and out_of_distribution; a constant feature gives 0 for its value and infinity else."""
    s = reference.agg(*[f(c).alias(f"_{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = [F.when(F.col(f"_s_{c}") > 0, F.abs(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")))).when(F.col(c) == F.col(f"_m_{c}"), 0.0).otherwise(float("inf")) for c in features]
    out = observations.crossJoin(F.broadcast(s)).withColumn("max_abs_z", F.greatest(*z) if len(z) > 1 else z[0]).drop(*s.columns)
    return out.withColumn("out_of_distribution", F.col("max_abs_z") > z_threshold)


def drift_validation_check(drift: DataFrame, fail_on_drift: bool = False) -> DataFrame:
    s = drift.agg(F.count_if("drifted").alias("n"))
    return check(s, "feature-drift", F.col("n") == 0, {"drifted": F.col("n")}, FAIL if fail_on_drift else WARNING)


def ood_validation_check(screened: DataFrame, fail_on_ood: bool = False) -> DataFrame:
    s = screened.agg(F.count_if("out_of_distribution").alias("n"))
    return check(s, "out-of-distribution", F.col("n") == 0, {"flagged": F.col("n")}, FAIL if fail_on_ood else WARNING)
