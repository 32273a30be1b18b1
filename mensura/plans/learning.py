"""Queries for measures of predictions and learning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.operators import learning, metrics
from mensura.plans.common import Registry, load, rounded

R = Registry()


@R.add("""SELECT round(avg((quality = toxic)::INT), 6) AS accuracy FROM labels""")
def metrics_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.accuracy(load(spark, sf, "labels"), "quality", "toxic"))


@R.add("""
WITH l AS (SELECT quality AS x FROM labels UNION SELECT toxic FROM labels)
SELECT a.x AS truth, b.x AS predicted, (SELECT count(*) FROM labels WHERE quality = a.x AND toxic = b.x) AS n FROM l a, l b""")
def metrics_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion_matrix(load(spark, sf, "labels"), "quality", "toxic")


PRF = """
WITH l AS (SELECT quality AS x FROM labels UNION SELECT toxic FROM labels),
c AS (SELECT x, count_if(quality = x AND toxic = x)::DOUBLE AS tp, count_if(quality = x) AS t, count_if(toxic = x) AS p FROM l, labels GROUP BY 1),
s AS (SELECT x, CASE WHEN p > 0 THEN tp / p ELSE 0.0 END::DOUBLE AS pr, CASE WHEN t > 0 THEN tp / t ELSE 0.0 END::DOUBLE AS re FROM c),
f AS (SELECT x, pr, re, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0.0 END::DOUBLE AS f1 FROM s)
"""


@R.add(PRF + "SELECT x AS label, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1 FROM f")
def metrics_prf(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.precision_recall_f1(load(spark, sf, "labels"), "quality", "toxic"))


@R.add(PRF + "SELECT round(avg(pr), 6) AS precision, round(avg(re), 6) AS recall, round(avg(f1), 6) AS f1 FROM f")
def metrics_macro(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.macro_prf(load(spark, sf, "labels"), "quality", "toxic"))


@R.add("""
WITH s AS (SELECT quality AS y, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0::DOUBLE AS r FROM labels JOIN documents USING (doc_id)), a AS (SELECT sum(r) FILTER (y = 1) AS s, count_if(y = 1) AS p, count_if(y = 0) AS n FROM s)
SELECT round((s - p * (p + 1) / 2.0::DOUBLE) / (p::DOUBLE * n), 6) AS auc FROM a""")
def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    both = load(spark, sf, "labels").join(load(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return rounded(metrics.roc_auc(both, "quality", "n_chars", 1))


@R.add("""
WITH e AS (SELECT l_linestatus AS g, l_extendedprice AS y, l_extendedprice - l_quantity * 1000 AS e FROM lineitem)
SELECT g AS l_linestatus, round(avg(e * e) / 1e6, 4) AS mse, round(avg(abs(e)), 4) AS mae, round(1 - sum(e * e) / (var_pop(y) * count(*)), 6) AS r2 FROM e GROUP BY 1""")
def mse_mae_r2(spark: SparkSession, sf: str) -> DataFrame:
    li = load(spark, sf, "lineitem").withColumn("p", F.col("l_quantity") * 1000)
    out = metrics.regression_scores(li, "l_extendedprice", "p", "l_linestatus")
    return out.select("l_linestatus", F.round(F.col("mse") / 1e6, 4).alias("mse"), F.round("mae", 4).alias("mae"), F.round("r2", 6).alias("r2"))


@R.add("""SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 6) AS p_size, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 6) AS p_retailprice FROM part""")
def standard_scale(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(learning.standard_scale(load(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"]))


@R.add("""
WITH l AS (SELECT l_returnflag AS label, unnest([{'feature': 'l_quantity', 'x': l_quantity}, {'feature': 'l_tax', 'x': l_tax}], recursive := true) FROM lineitem)
SELECT label, round(count(*) / (SELECT count(*) FROM lineitem)::DOUBLE, 6) AS prior, feature, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS var FROM l GROUP BY 1, 3""")
def gnb_fit(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(learning.gnb_fit(load(spark, sf, "lineitem"), ["l_quantity", "l_tax"], "l_returnflag"))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


VEC = "v AS (SELECT vec_id, label, embedding::DOUBLE[64] AS x FROM embeddings)"


@R.add(f"""
WITH {VEC}, d AS (SELECT q.vec_id AS query, t.vec_id AS k, t.label, list_sum(list_transform(range(1, 65), lambda i: pow(q.x[i] - t.x[i], 2))) AS d2 FROM v q, v t WHERE q.vec_id % 100 = 0 AND t.vec_id % 100 <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d2, k) AS rk FROM d QUALIFY rk <= 5), c AS (SELECT query, label, count(*) AS c, max(rk) AS r FROM n GROUP BY 1, 2)
SELECT query, arg_min(label, (-c, r)) AS prediction FROM c GROUP BY 1""")
def knn_vote(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    return learning.knn_classify(v.where("vec_id % 100 <> 0"), v.where("vec_id % 100 = 0"), "x", "label", "vec_id", "vec_id")


@R.add(f"""
WITH {VEC}, c AS (SELECT vec_id AS c, x AS y FROM v WHERE vec_id < 4), d AS (SELECT vec_id, c, list_sum(list_transform(range(1, 65), lambda i: pow(x[i] - y[i], 2))) AS d2 FROM v, c)
SELECT vec_id, arg_min(c, (d2, c))::INT AS cluster, round(min(d2), 6) AS d2 FROM d GROUP BY 1""")
def kmeans_assign(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    centroids = [r[0] for r in v.where("vec_id < 4").orderBy("vec_id").select("x").collect()]
    return rounded(learning.assign_clusters(v, "x", centroids).select("vec_id", "cluster", "d2"))


@R.add(f"""
WITH {VEC}, p AS (SELECT i, j FROM range(64) a(i), range(64) b(j) WHERE i <= j)
SELECT i::INT AS i, j::INT AS j, round(covar_samp(x[i + 1], x[j + 1]), 6) AS covariance FROM v, p GROUP BY 1, 2""")
def cov_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(learning.covariance(_vectors(spark, sf), "x", 64))


@R.add("""SELECT doc_id, ntile(5) OVER (ORDER BY doc_id)::INT - 1 AS fold FROM labels""")
def kfold_ids(spark: SparkSession, sf: str) -> DataFrame:
    return learning.k_fold_ids(load(spark, sf, "labels").select("doc_id"), "doc_id", 5)


@R.add("""
WITH s AS (SELECT covar_pop(l_quantity, l_extendedprice) AS xy, covar_pop(l_quantity, l_tax) AS xz, covar_pop(l_tax, l_extendedprice) AS zy, var_pop(l_quantity) AS xx, var_pop(l_tax) AS zz, avg(l_quantity) AS mx, avg(l_tax) AS mz, avg(l_extendedprice) AS my FROM lineitem),
b AS (SELECT *, (xy * zz - xz * zy) / (xx * zz - xz * xz) AS b1, (zy * xx - xz * xy) / (xx * zz - xz * xz) AS b2 FROM s)
SELECT round(my - b1 * mx - b2 * mz, 2) AS intercept, round(b1, 3) AS b1, round(b2, 1) AS b2 FROM b""")
def ols_fit(spark: SparkSession, sf: str) -> DataFrame:
    m = learning.LinearRegression(["l_quantity", "l_tax"], "l_extendedprice").fit(load(spark, sf, "lineitem"))
    return spark.createDataFrame([(round(m.intercept, 2), round(m.coefficients[0], 3), round(m.coefficients[1], 1))], "intercept double, b1 double, b2 double")


#: Fixed value: the dimensions of an embedding.
DIMENSIONS = 64
XS = [f"x{i}" for i in range(DIMENSIONS)]


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "embeddings").select("vec_id", F.col("label"), *[F.col("embedding")[i].cast("double").alias(x) for i, x in enumerate(XS)], (F.col("label") < 5).cast("int").alias("y"))


@R.add()
def pca_variance(spark: SparkSession, sf: str) -> DataFrame:
    m = learning.PCA("x", 3).fit(_vectors(spark, sf))
    return spark.createDataFrame([(i, float(v), float(r)) for i, (v, r) in enumerate(zip(m.explained_variance, m.explained_variance_ratio))], "component int, variance double, ratio double")


@R.add()
def kmeans_fit(spark: SparkSession, sf: str) -> DataFrame:
    return learning.KMeans("x", 3, max_iter=5).fit(_vectors(spark, sf)).predict(_vectors(spark, sf)).select("vec_id", "cluster")


def _tree_sql(name: str, rows: str, depth: int, sums: dict[str, str], impurity: str) -> str:
    """CTEs {name}0 to {name}{depth}: rows (vec_id, y, x, ...) with the node each has reached, every cut between neighbouring values tried.

    impurity: of a side, with {s} for the sum s on it and {w} for its rows.
    """
    out = [f"{name}0 AS (SELECT *, 1 AS node FROM ({rows}) s)"]
    both = " + ".join("(CASE WHEN {0} > 0 THEN {0} * ({1}) ELSE 0 END)".format(w, impurity.format(w=w, **{s: f"({side.format(s)})" for s in sums})) for w, side in (("lw", "l_{0}"), ("(tw - lw)", "t_{0} - l_{0}")))
    for i in range(depth):
        t = f"{name}{i}"
        out += [
            f"{t}v AS (SELECT node, f, x[f]::DOUBLE AS v, count(*)::DOUBLE AS w, {', '.join(f'sum({e})::DOUBLE AS {s}' for s, e in sums.items())} FROM {t}, range(1, {len(XS) + 1}) r(f) GROUP BY ALL)",
            f"{t}c AS (SELECT node, f, (v + lead(v) OVER up) / 2 AS cut, sum(w) OVER up AS lw, sum(w) OVER side AS tw, {', '.join(f'sum({s}) OVER up AS l_{s}, sum({s}) OVER side AS t_{s}' for s in sums)} FROM {t}v WINDOW up AS (PARTITION BY node, f ORDER BY v), side AS (PARTITION BY node, f))",
            f"{t}b AS (SELECT node, arg_min([f, cut], (round({both}, 10), f, cut)) AS b FROM {t}c WHERE cut IS NOT NULL GROUP BY node)",
            f"{name}{i + 1} AS (SELECT d.* EXCLUDE (node), CASE WHEN b IS NULL THEN node ELSE 2 * node + (x[b[1]::INT] > b[2])::INT END AS node FROM {t} d LEFT JOIN {t}b USING (node))",
        ]
    return ", ".join(out)


_ROWS = "SELECT vec_id, (label < 5)::INT AS y, embedding AS x FROM embeddings"


def _boost_sql(rounds: int, depth: int, rate: float) -> str:
    out = [f"s0 AS (SELECT *, ln(avg(y) OVER () / (1 - avg(y) OVER ())) AS score FROM ({_ROWS}) r)"]
    for i in range(rounds):
        rows = f"SELECT vec_id, y, x, score, y - 1 / (1 + exp(-score)) AS r, 1 / (1 + exp(-score)) * (1 - 1 / (1 + exp(-score))) AS h FROM s{i}"
        out.append(_tree_sql(f"t{i}_", rows, depth, {"r": "r", "rr": "r * r"}, "{rr} / {w} - ({r} / {w}) * ({r} / {w})"))
        out.append(f"s{i + 1} AS (SELECT vec_id, y, x, score + {rate} * sum(r) OVER (PARTITION BY node) / sum(h) OVER (PARTITION BY node) AS score FROM t{i}_{depth})")
    return f"WITH {', '.join(out)} SELECT vec_id, y, round(1 / (1 + exp(-score)), 6) AS probability, (score > 0)::INT AS prediction FROM s{rounds}"


_GINI = "1 - ({c0} * {c0} + {c1} * {c1}) / ({w} * {w})"


@R.add(f"WITH {_tree_sql('d', _ROWS, 3, {'c0': '1 - y', 'c1': 'y'}, _GINI)} SELECT vec_id, y, (avg(y) OVER (PARTITION BY node) > 0.5)::INT AS prediction FROM d3")
def tree_fit(spark: SparkSession, sf: str) -> DataFrame:
    d = _labelled(spark, sf)
    return learning.DecisionTreeClassifier(XS, "y", 3).fit(d).predict(d).select("vec_id", "y", "prediction")


@R.add()
def forest_fit(spark: SparkSession, sf: str) -> DataFrame:
    d = _labelled(spark, sf)
    return learning.RandomForestClassifier(XS, "y", "vec_id", 3, 2).fit(d).predict(d).select("vec_id", "y", "prediction")


@R.add(_boost_sql(3, 2, 0.1))
def gboost(spark: SparkSession, sf: str) -> DataFrame:
    d = _labelled(spark, sf)
    return rounded(learning.GradientBoostingClassifier(XS, "y", 3).fit(d).predict(d).select("vec_id", "y", "probability", "prediction"))


@R.add(f"""WITH {_tree_sql('d', _ROWS, 1, {'c0': '1 - y', 'c1': 'y'}, _GINI)}
SELECT b[1]::INT - 1 AS feature, round(b[2], 6) AS cut, (SELECT count(*) FROM d1 WHERE node = 2) AS left_rows, (SELECT round(avg(y), 6) FROM d1 WHERE node = 2) AS left_share, (SELECT round(avg(y), 6) FROM d1 WHERE node = 3) AS right_share FROM d0b""")
def tree_split(spark: SparkSession, sf: str) -> DataFrame:
    """The first cut of a tree over all vectors: its feature, place and shares."""
    d = _labelled(spark, sf)
    t = learning.DecisionTreeClassifier(XS, "y", 1).fit(d).tree
    left = d.where(F.col(t.feature) <= t.cut)
    return rounded(left.agg(F.lit(XS.index(t.feature)).alias("feature"), F.lit(float(t.cut)).alias("cut"), F.count(F.lit(1)).alias("left_rows"), F.lit(float(t.left.value[1])).alias("left_share"), F.lit(float(t.right.value[1])).alias("right_share")))


def _descent_sql(epochs: int, rate: float) -> str:
    """CTEs d and w0 to w{epochs}: bias b and weights w after each epoch."""
    out = [f"d AS (SELECT vec_id, y, [1.0::DOUBLE] || x::DOUBLE[] AS x FROM ({_ROWS}) r)", f"w0 AS (SELECT [0.0::DOUBLE FOR i IN range({len(XS) + 1})] AS w)"]
    for k in range(epochs):
        out.append(f"g{k} AS (SELECT i, avg((1 / (1 + exp(-list_dot_product(w, x))) - y) * x[i]) AS g FROM d, w{k}, range(1, {len(XS) + 2}) r(i) GROUP BY i)")
        out.append(f"w{k + 1} AS (SELECT list(w[i] - {rate} * g ORDER BY i) AS w FROM g{k}, w{k})")
    return ", ".join(out)


@R.add(f"WITH {_descent_sql(10, 0.1)} SELECT vec_id, y, round(1 / (1 + exp(-list_dot_product(w, x))), 8) AS probability, (list_dot_product(w, x) >= 0)::INT AS prediction FROM d, w10")
def logistic_fit(spark: SparkSession, sf: str) -> DataFrame:
    d = _labelled(spark, sf)
    return rounded(learning.LogisticRegression(XS, "y", epochs=10).fit(d).predict(d).select("vec_id", "y", "probability", "prediction"), 8)


@R.add(f"""WITH v AS (SELECT vec_id, label, i, embedding[i]::DOUBLE AS x FROM embeddings, range(1, {len(XS) + 1}) r(i)), s AS (SELECT label AS k, i, avg(x) AS m, var_pop(x) AS v FROM v GROUP BY ALL),
p AS (SELECT label AS k, ln(count(*)::DOUBLE / (SELECT count(*) FROM embeddings)) AS prior FROM embeddings GROUP BY 1), q AS (SELECT vec_id, label, s.k, sum(-0.5 * ln(2 * pi() * s.v) - (x - m) * (x - m) / (2 * s.v)) AS score FROM v JOIN s USING (i) GROUP BY ALL)
SELECT vec_id, label, arg_max(q.k, (score + prior, -q.k)) AS prediction FROM q JOIN p ON q.k = p.k GROUP BY ALL""")
def gnb_predict(spark: SparkSession, sf: str) -> DataFrame:
    d = _labelled(spark, sf)
    return learning.GaussianNaiveBayes(XS, "label").fit(d).predict(d).select("vec_id", "label", "prediction")
