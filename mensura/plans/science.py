"""Queries for formulas, units, quadrature, models, streaming, quantum registers and fractals."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.functions import science, symbolic
from mensura.operators import calculus, descriptive
from mensura.plans.common import Registry, load, rounded
from mensura.sources.tables import shared_dir
from mensura.streaming import accumulators, fits

R = Registry()


@R.add("""SELECT p_partkey, 0.5 * p_size * p_retailprice * p_retailprice AS energy, round(2 * pi() * sqrt(p_size / 9.80665), 8) AS period FROM part""")
def formulas(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "part").withColumn("m", F.col("p_size").cast("double"))
    return p.select("p_partkey", science.kinetic_energy("m", "p_retailprice").alias("energy"), F.round(science.pendulum_period("m"), 8).alias("period"))


@R.add("""SELECT p_partkey, round(p_size * 2.54 / 100, 8) AS metres FROM part""")
def unit_conversion(spark: SparkSession, sf: str) -> DataFrame:
    length = science.Dimension(length=1)
    inch, metre = science.Unit("in", 0.0254, length), science.Unit("m", 1.0, length)
    return load(spark, sf, "part").select("p_partkey", F.round(science.Quantity(F.col("p_size").cast("double"), inch).to(metre).value, 8).alias("metres"))


@R.fixed("""SELECT round(exp(1.0::DOUBLE) - 1, 6) AS trapezoid, round(exp(1.0::DOUBLE) - 1, 8) AS simpson, round(exp(1.0::DOUBLE) - 1, 8) AS simpson_38""")
def quadrature(spark: SparkSession, sf: str) -> DataFrame:
    row = (round(calculus.trapezoid(spark, F.exp, 0, 1), 6), round(calculus.simpson(spark, F.exp, 0, 1, 100), 8), round(calculus.simpson_38(spark, F.exp, 0, 1, 99), 8))
    return spark.createDataFrame([row], "trapezoid double, simpson double, simpson_38 double")


@R.add("""SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) / 1e6, 4) AS charge, round(sum(-l_extendedprice * (1 + l_tax)) / 1e6, 4) AS by_discount FROM lineitem GROUP BY 1""")
def symbolic_model(spark: SparkSession, sf: str) -> DataFrame:
    """An expression and its derivative, compiled to columns."""
    p, d, t = (symbolic.Variable(n) for n in ("l_extendedprice", "l_discount", "l_tax"))
    charge = p * (1 - d) * (1 + t)
    return load(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(charge.column()) / 1e6, 4).alias("charge"), F.round(F.sum(charge.diff("l_discount").column()) / 1e6, 4).alias("by_discount"))


@R.add("""SELECT round(regr_slope(l_extendedprice, l_quantity), 2) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 1) AS intercept FROM lineitem""")
def model_fit(spark: SparkSession, sf: str) -> DataFrame:
    a, b, x = (symbolic.Variable(n) for n in ("a", "b", "l_quantity"))
    fit = symbolic.fit_parameters(a + b * x, load(spark, sf, "lineitem"), "l_extendedprice", ["a", "b"])["parameters"]
    return spark.createDataFrame([(round(fit["b"], 2), round(fit["a"], 1))], "slope double, intercept double")


def _streamed(spark: SparkSession, sf: str, table: str) -> DataFrame:
    """A table's files as a stream."""
    return spark.readStream.schema(load(spark, sf, table).schema).parquet(f"{sf}/{table}.parquet*")


def _run(state: DataFrame) -> DataFrame:
    """What a streaming aggregate holds once all files have gone by: each batch replaces the table of its groups."""
    spark = state.sparkSession
    at = f"{shared_dir(spark)}/mensura/stream-{uuid.uuid4().hex}"
    write = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{at}/state")
    state.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(state.schema).parquet(f"{at}/state")


@R.add("""SELECT user_id, count(*) AS count, round(avg(value), 6) AS mean FROM events GROUP BY 1""")
def stream_moments(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a file stream, run to its end; the state of each user is a row."""
    return rounded(_run(accumulators.streaming_moments(_streamed(spark, sf, "events"), "value", "user_id")).select("user_id", "count", "mean"))


@R.add("""SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 5) AS intercept, count(*) AS rows_seen FROM lineitem""")
def streaming_linear_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Lineitem as a file stream; the state is one row of sums, solved at the end."""
    sums = _run(accumulators.streaming_gram(_streamed(spark, sf, "lineitem"), ["l_quantity"], "l_extendedprice"))
    return fits.solved(sums, 1).select(F.round(F.col("coefficients")[0], 6).alias("slope"), F.round("intercept", 5).alias("intercept"), "rows_seen")


@R.add("""SELECT date_trunc('day', ts) AS day, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1""")
def windowed_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a file stream in windows of a day; files are in no order of time, so the watermark leaves ten years."""
    epoch = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"  # watermarks need instants: times count as UTC, whatever the session's zone
    stream = _streamed(spark, sf, "events").withColumn("at", F.expr(f"timestamp_micros(timestampdiff(MICROSECOND, {epoch}, ts))"))
    w = _run(accumulators.windowed_moments(stream, "at", "value", "1 day", "3650 days"))
    return rounded(w.select(F.expr(f"timestampadd(MICROSECOND, unix_micros(window.start), {epoch})").alias("day"), F.col("count").alias("n"), "mean"))


@R.fixed()
def quantum_shots(spark: SparkSession, sf: str) -> DataFrame:
    return science.ghz_state(3).measure_shots(spark, 10_000, 7)


@R.fixed()
def mandelbrot(spark: SparkSession, sf: str) -> DataFrame:
    return science.mandelbrot_image(spark, -2, 1, -1, 1, 60, 40, 50)


@R.fixed()
def fern(spark: SparkSession, sf: str) -> DataFrame:
    return science.barnsley_fern(spark, 500, chains=4)


@R.add()
def ode_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Decay at the rate of each nation's number, side by side."""
    rates = load(spark, sf, "nation").select((F.col("n_nationkey") / 10.0).alias("k"))
    return calculus.sweep(rates, lambda k: calculus.rk45(lambda t, y: -k * y, 0.0, [1.0], 1.0), "k")


@R.add()
def ols_coefficients(spark: SparkSession, sf: str) -> DataFrame:
    g = descriptive.gram(load(spark, sf, "lineitem"), ["l_quantity", "l_tax", "l_discount"], "l_extendedprice").first().asDict()
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(descriptive.solve_gram(g, 3))], "i int, coefficient double")
