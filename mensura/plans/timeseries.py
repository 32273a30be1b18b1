"""Queries over series of events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.operators import frame, timeseries
from mensura.plans.common import Registry, load, rounded

R = Registry()
E = "OVER (PARTITION BY user_id ORDER BY ts, event_id"
ORDER = ["ts", "event_id"]


def daily(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").groupBy(F.date_trunc("day", "o_orderdate").alias("day")).agg(F.count(F.lit(1)).cast("double").alias("x"))


DAILY = "WITH d AS (SELECT date_trunc('day', o_orderdate) AS day, count(*)::DOUBLE AS x FROM orders GROUP BY 1), s AS (SELECT x, row_number() OVER (ORDER BY day) - 1 AS i, x - avg(x) OVER () AS d, count(*) OVER () AS n FROM d)"


@R.add(f"SELECT event_id, round(avg(value) {E} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS moving_average FROM events")
def ma_trailing(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(frame.moving_average(load(spark, sf, "events"), "value", ORDER, "user_id").select("event_id", "moving_average"))


@R.add(f"SELECT event_id, round(avg(value) {E} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS moving_average FROM events")
def ma_symmetric(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(timeseries.moving_average(load(spark, sf, "events"), "value", ORDER, "user_id").select("event_id", "moving_average"))


@R.add(f"SELECT event_id, round(value - lag(value, 2) {E}), 6) AS difference FROM events QUALIFY row_number() {E}) > 2")
def difference(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(timeseries.difference(load(spark, sf, "events"), "value", ORDER, "user_id", lag=2).select("event_id", "difference"))


@R.add(DAILY + ", p AS (SELECT *, d * lag(d) OVER (ORDER BY i) AS q FROM s) SELECT round(sum(q) / sum(d * d), 6) AS autocorrelation FROM p")
def acf_lag1(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(timeseries.autocorrelation(daily(spark, sf), "x", "day"))


@R.add(DAILY + ", v AS (SELECT sum(d * d) AS v FROM s) SELECT (a.i - b.i)::INT AS lag, round(sum(a.d * b.d) / max(v), 6) AS r FROM s a JOIN s b ON a.i - b.i BETWEEN 0 AND 8, v GROUP BY 1")
def acf_lags(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(timeseries.autocorrelation_function(daily(spark, sf), "x", "day", max_lag=8))


@R.add(DAILY.replace("WITH", "WITH RECURSIVE", 1) + """
, v AS (SELECT sum(d * d) AS v FROM s), r AS (SELECT a.i - b.i AS lag, sum(a.d * b.d) / max(v) AS r FROM s a JOIN s b ON a.i - b.i BETWEEN 0 AND 8, v GROUP BY 1), l AS (SELECT list(r ORDER BY lag) AS r FROM r),
p AS (SELECT 1 AS k, r, [r[2]] AS phi, r[2] AS a FROM l UNION ALL
SELECT k + 1, r, list_append([phi[j] - a2 * phi[k + 1 - j] for j in range(1, k + 1)], a2), a2 FROM (SELECT k, r, phi, (r[k + 2] - list_sum([phi[j] * r[k + 2 - j] for j in range(1, k + 1)])) / (1 - list_sum([phi[j] * r[j + 1] for j in range(1, k + 1)])) AS a2 FROM p WHERE k < 8))
SELECT 0 AS lag, 1.0::DOUBLE AS pacf UNION ALL SELECT k, round(a, 6) FROM p""")
def pacf_lags(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(timeseries.partial_autocorrelation(daily(spark, sf), "x", "day", max_lag=8))


@R.add(DAILY + """
, c AS (SELECT i, d, n, sum(d) OVER (ORDER BY i) AS c FROM s), q AS (SELECT sum(c * c) AS cc, max(n) AS n, greatest(1, floor(4 * pow(max(n) / 100.0, 0.25))::INT) AS l FROM c),
g AS (SELECT a.i - b.i AS k, sum(a.d * b.d) AS g FROM s a JOIN s b ON a.i - b.i BETWEEN 0 AND 20 GROUP BY 1),
v AS (SELECT sum(CASE WHEN k = 0 THEN g ELSE 2 * (1 - k / (l + 1.0::DOUBLE)) * g END) / max(n) AS v FROM g, q WHERE k <= l)
SELECT round(cc / (n * n * v), 6) AS statistic, l AS lags, cc / (n * n * v) < 0.463 AS is_stationary FROM q, v""")
def kpss_stat(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(timeseries.kpss_statistic(daily(spark, sf), "x", "day"))


@R.add(DAILY + """
, t AS (SELECT i, x, avg(x) OVER (ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS t FROM s), m AS (SELECT i % 7 AS ph, avg(x - t) AS raw FROM t GROUP BY 1), z AS (SELECT ph, raw - avg(raw) OVER () AS se FROM m)
SELECT i::INT AS i, x, round(t, 6) AS trend, round(se, 6) AS seasonal, round(x - t - se, 6) AS residual FROM t JOIN z ON ph = i % 7""")
def seasonal_decompose(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(timeseries.seasonal_decompose(daily(spark, sf), "x", "day", 7))


@R.add(DAILY + ", v AS (SELECT sum(d * d) AS v, max(n) AS n FROM s), r AS (SELECT a.i - b.i AS k, sum(a.d * b.d) / max(v) AS r FROM s a JOIN s b ON a.i - b.i BETWEEN 1 AND 10, v GROUP BY 1) SELECT round(max(n) * (max(n) + 2) * sum(r * r / (n - k)), 4) AS statistic, 10 AS df FROM r, v")
def ljung_box_stat(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(timeseries.ljung_box(daily(spark, sf), "x", "day").select("statistic", "df"), 4)


@R.add("""
WITH RECURSIVE d AS (SELECT date_trunc('day', ts) AS day, sum(value) AS x FROM events GROUP BY 1), s AS (SELECT x, row_number() OVER (ORDER BY day) AS i FROM d), r AS (SELECT i, x AS y FROM s WHERE i = 1 UNION ALL SELECT s.i, 0.3 * s.x + 0.7 * r.y FROM r JOIN s ON s.i = r.i + 1)
SELECT i AS place, round(y, 5) AS smoothed FROM r""")
def exponential_smoothing(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "events").groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.sum("value").alias("x"))
    out = timeseries.exponential_smoothing(d.withColumn("k", F.lit(1)), "x", "day", "k", 0.3)
    return rounded(out.select(F.expr("cast(row_number() over (order by day) as bigint)").alias("place"), "smoothed"), 5)
