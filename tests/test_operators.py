"""Operators without an SQL form, and the edges of the others, against values worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mensura.functions import distributions as dist
from mensura.functions import neural, science, special, symbolic
from mensura.operators import calculus, causal, descriptive, frame, graph, inference, information, learning, linalg, signals, simulation, text, timeseries, validation
from mensura.plans import workflow
from mensura.sources import files
from mensura.streaming import accumulators


def one(df):
    return df.first()[0]


@pytest.fixture(scope="module")
def xs(spark):
    return spark.createDataFrame([(i, float(i), float(2 * i + 1), "a" if i % 2 else "b") for i in range(1, 9)], "i int, x double, y double, g string")


def test_frames(spark, xs):
    assert frame.shape(xs) == (8, 4) and [r["i"] for r in frame.tail(xs, "i", 2).collect()] == [7, 8]
    assert frame.tail(xs, "i", 0).count() == 8
    t = spark.createDataFrame([("k", "1"), ("k", "x"), ("m", None)], "g string, v string")
    assert {r["g"]: r["mean"] for r in frame.group_mean(t, "g", "v").collect()} == {"k": 1.0, "m": 0.0}
    assert {r["column"] for r in frame.describe(xs).collect()} == {"i", "x", "y"}
    assert {r["normalized"] for r in frame.normalize(xs.withColumn("c", F.lit(1)), "c").collect()} == {0.0}
    with pytest.raises(ValueError):
        frame.column(xs, "nope")
    assert frame.filter_rows(xs, lambda p: p.x > 6).count() == frame.filter_rows(xs, "x > 6").count() == 2


def test_descriptive_edges(spark, xs):
    empty = xs.limit(0)
    assert one(descriptive.median(empty, "x")) == 0.0
    with pytest.raises(Exception, match="mean of no values"):
        descriptive.mean(empty, "x").collect()
    assert one(descriptive.correlation(xs.withColumn("c", F.lit(3.0)), "x", "c")) == 0.0
    with pytest.raises(Exception, match="constant"):
        descriptive.z_scores(xs.withColumn("c", F.lit(3.0)), "c").collect()
    fit = descriptive.linear_regression(xs, "x", "y").first()
    assert (fit["slope"], fit["intercept"], fit["r_squared"]) == (2.0, 1.0, 1.0)
    assert descriptive.linear_regression(xs.withColumn("c", F.lit(3.0)), "x", "c").first()["r_squared"] == 0.0
    assert one(descriptive.percentile(spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,)], "x double"), "x", 25)) == 1.75


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_merged_moments_are_one_pass(xs, parts):
    states = descriptive.moments(xs.withColumn("p", F.xxhash64("i") % parts), "x", "p")
    m = descriptive.finish_moments(descriptive.merge_moments(states)).first()
    assert m["count"] == 8 and m["mean"] == pytest.approx(4.5) and m["variance"] == pytest.approx(6.0)


def test_special_functions():
    assert special.gammp(2, 1.5) == pytest.approx(1 - math.exp(-1.5) * 2.5) and special.gammq(0.5, 4) == pytest.approx(math.erfc(2))
    assert special.betai(2, 3, 0.4) == pytest.approx(0.5248) and special.normal_ppf.plain(0.975) == pytest.approx(1.959964, abs=1e-6)
    assert special.t_sf.plain(2.228138851986273, 10) == pytest.approx(0.05) and special.f_sf.plain(4.0, 2, 10) == pytest.approx(0.05291, abs=1e-4)
    assert dist.chi2_ppf.plain(0.95, 3) == pytest.approx(7.814728, abs=1e-5) and dist.t_ppf.plain(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    assert math.fsum(dist.hypergeometric_pmf.plain(k, 5, 7, 4) for k in range(5)) == pytest.approx(1)
    assert dist.negative_binomial_cdf.plain(3, 2, 0.4) == pytest.approx(math.fsum(dist.negative_binomial_pmf.plain(k, 2, 0.4) for k in range(4)))


def test_tests_of_hypotheses(spark, xs):
    t = inference.two_sample_ttest(xs, "x", "g", "a", "b").first()
    assert t["statistic"] == pytest.approx(-0.5477226) and t["df"] == 6 and t["p_value"] == pytest.approx(0.60364, abs=1e-4)
    same = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0)], "a double, b double")
    p = inference.paired_ttest(same, "a", "b").first()
    assert (p["statistic"], p["p_value"]) == (0.0, 1.0)
    q = inference.paired_ttest(same.withColumn("b", F.col("b") - 1), "a", "b").first()
    assert math.isinf(q["statistic"]) and q["p_value"] == 0.0
    w = inference.wilcoxon_signed_rank(spark.createDataFrame([(0.0,), (1.0,), (-2.0,), (3.0,)], "d double"), "d").first()
    assert w["statistic"] == 4.0 and w["n_effective"] == 3
    assert inference.required_n_per_group(0.5) == 64 and inference.power_t_test(0.5, 64) == pytest.approx(0.801, abs=0.005)
    ci = inference.bootstrap_ci(xs, "x", n_resamples=400).first()
    assert ci["lower"] < 4.5 < ci["upper"] and ci["estimate"] == 4.5
    assert inference.bootstrap_ci(xs.repartition(7), "x", n_resamples=400).first() == ci
    with pytest.raises(ValueError):
        inference.adjust_p_values(xs, "x", "i", "nope")


def test_information_and_validation(spark, xs):
    p = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "c string, p double")
    q = spark.createDataFrame([("a", 1.0)], "c string, p double")
    assert one(information.entropy(p)) == 1.0 and math.isinf(one(information.kl_divergence(p, q, "c"))) and one(information.kl_divergence(q, p, "c")) == 1.0
    assert one(information.js_divergence(p, q, "c")) == pytest.approx(one(information.js_divergence(q, p, "c")))
    a, b = (spark.createDataFrame([(float(v),) for v in vs], "x double") for vs in ([0, 0, 1], [0, 1, 1]))
    assert one(validation.empirical_ks_distance(a, b, "x")) == pytest.approx(1 / 3)
    odd = spark.createDataFrame([(1, float("nan")), (2, 1.0), (3, None)], "k int, x double")
    c = validation.check_finite(odd, "x", "k").first()
    assert c["status"] == "fail" and c["details"]["violations"] == "2"
    assert validation.check_monotonic(xs, "x", "i", strict=True).first()["status"] == "pass"
    assert validation.check_monotonic(xs, "x", "i", increasing=False).first()["status"] == "fail"
    assert validation.check_duplicate_rows(odd, odd).first()["details"]["duplicates"] == "3"
    assert one(validation.passed(validation.report(c_ := validation.check_positive(xs, "x", "i"), c_)))
    z = validation.screen_ood(xs.withColumn("c", F.lit(1.0)), xs.withColumn("c", F.lit(2.0)), ["c"])
    assert {r["max_abs_z"] for r in z.collect()} == {float("inf")}


def test_effects_and_updates(spark, xs):
    with pytest.raises(ValueError):
        causal.linear_backdoor_effect(xs, "y", "x", [], causal.CausalAssumptions(True))
    assert causal.linear_backdoor_effect(xs, "y", "x", [], causal.CausalAssumptions(True, True, True, True)).first()["effect"] == pytest.approx(2)
    m = causal.mine_correlations(xs, ["x", "y"]).first()
    assert m["correlation"] == pytest.approx(1) and m["p_value"] < 1e-6 and m["strength"] == "strong"
    lo, hi = causal.beta_credible_interval(2, 2)
    assert lo == pytest.approx(0.0943, abs=1e-4) and hi == pytest.approx(1 - lo)
    assert causal.bayes_factor(5, 10, 0.5) == pytest.approx(1 / 11 / (math.comb(10, 5) / 2**10))


def test_time_series(spark, xs):
    s = xs.select("i", "x")
    assert [round(r["r"], 4) for r in timeseries.autocorrelation_function(s, "x", "i", max_lag=1).orderBy("lag").collect()] == [1.0, 0.625]
    assert timeseries.partial_autocorrelations([1.0, 0.5, 0.25]) == pytest.approx([1, 0.5, 0])
    assert [r["difference"] for r in timeseries.difference(s, "x", "i", order=2).collect()] == [0.0] * 6
    assert timeseries.autocorrelation(s.withColumn("c", F.lit(1.0)), "c", "i").first()[0] == 0.0


def test_learning(spark):
    rng = np.random.default_rng(0)
    rows = [(i, *(rng.normal(3.0 * (i % 2), 1, 2)).tolist(), i % 2) for i in range(120)]
    df = spark.createDataFrame([(int(i), float(a), float(b), int(y)) for i, a, b, y in rows], "i int, a double, b double, y int")
    score = lambda m: one(m.fit(df).predict(df).agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))))
    assert score(learning.DecisionTreeClassifier(["a", "b"], "y", 2)) > 0.93
    assert score(learning.GradientBoostingClassifier(["a", "b"], "y", 2)) > 0.9
    assert score(learning.GaussianNaiveBayes(["a", "b"], "y")) > 0.95
    assert score(learning.LogisticRegression(["a", "b"], "y", rate=0.5, epochs=25)) > 0.9
    train, test = learning.train_test_split(df, "i", 0.25, 3)
    assert test.count() == 30 and train.count() == 90
    assert [r["count"] for r in learning.k_fold_ids(df.limit(11), "i", 3).groupBy("fold").count().orderBy("fold").collect()] == [4, 4, 3]
    v = df.select("i", "y", F.array("a", "b").alias("x"))
    km = learning.KMeans("x", 2, max_iter=10).fit(v)
    assert sorted(round(c[0]) for c in km.centroids) == [0, 3]
    pca = learning.PCA("x", 2).fit(v)
    assert pca.explained_variance_ratio.sum() == pytest.approx(1)
    back = pca.inverse_transform(pca.transform(v)).first()
    assert back["restored"] == pytest.approx(back["x"])
    near = learning.nearest(v, v.where("i < 3"), "x", "i", "i", 1).collect()
    assert all(r["query"] == r["key"] and r["d2"] == 0 for r in near)


def test_text_and_sequences(spark):
    t = text.PairTokenizer({"<unk>": 0, "<pad>": 1, "<bos>": 2, "<eos>": 3, "a": 4, "b": 5, "ab": 6, "ab</w>": 7})
    assert t.encode("ab abab c") == [7, 6, 7, 0, 0] and t.encode("a", True) == [2, 4, 0, 3] and t.decode([7, 6]) == "ab ab"
    assert text.PairTokenizer.loads(t.dumps()) == t
    trained = text.train_pairs(spark.createDataFrame([("low low low lower lower newest",)], "t string"), "t", 20)
    assert trained.merges[0] == ("l", "o") and trained.decode(trained.encode("low lower")) == "low lower"
    assert text.align("GATTACA", "GCATGCU")[0] == 0
    d = spark.createDataFrame([("GCNN",), ("",), ("at",)], "s string")
    assert [r["gc"] for r in text.gc_content(d, "s").collect()] == [1.0, 0.0, 0.0]
    with pytest.raises(Exception, match="other than"):
        text.gc_content(spark.createDataFrame([("GX",)], "s string"), "s").collect()
    assert text.k_mers(d, "s", 5).count() == 0
    kg = text.KnowledgeGraph.empty(spark).add_relations([("a", "b", "is", 1.0), ("b", "c", "is", 1.0)], create=True)
    assert [r["name"] for r in kg.neighbors("b").collect()] == ["a", "c"]
    with pytest.raises(ValueError):
        kg.add_relations([("a", "zz", "is", 1.0)])


def test_signals(spark):
    s = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 3, 4, 0, 1, 2, 3])], "i int, x double")
    a = [complex(r["re"], r["im"]) for r in signals.dft(s).orderBy("k").collect()]
    b = [complex(r["re"], r["im"]) for r in signals.fft(s).orderBy("k").collect()]
    assert np.allclose(a, b) and np.allclose([r["re"] for r in signals.idft(signals.dft(s)).orderBy("i").collect()], [1, 2, 3, 4, 0, 1, 2, 3])
    assert np.allclose([r["x"] for r in signals.idwt(signals.dwt(s)).orderBy("i").collect()], [1, 2, 3, 4, 0, 1, 2, 3])
    low, high = signals.butter_lowpass(3, 0.3), signals.butter_highpass(2, 0.3)
    assert sum(low.b) / sum(low.a) == pytest.approx(1) and np.polyval(high.b, -1) / np.polyval(high.a, -1) == pytest.approx(1)
    assert signals.iir(np.ones(300), low)[-1] == pytest.approx(1, abs=1e-6)
    assert signals.frame_signal(s, 4, 3).groupBy("frame").count().count() == 3
    knots = spark.createDataFrame([(0.0, 0.0), (2.0, 4.0)], "x double, y double")
    pts = lambda *v: spark.createDataFrame([(float(x),) for x in v], "x double")
    assert sorted(r["y"] for r in signals.interp1d(knots, pts(0, 0.5, 2)).collect()) == [0.0, 1.0, 4.0]
    assert [r["y"] for r in signals.interp1d(knots, pts(1), "nearest").collect()] == [0.0]
    with pytest.raises(Exception, match="outside"):
        signals.interp1d(knots, pts(3)).collect()


def test_matrices(spark):
    a = np.array([[4.0, 2.0], [2.0, 3.0]])
    m = linalg.frame(spark, a)
    assert np.allclose(linalg.dense(linalg.mat_mul(m, linalg.matrix_inverse(m))), np.eye(2)) and linalg.determinant(m) == pytest.approx(8)
    p, low, up = linalg.lu(np.array([[0.0, 1.0], [2.0, 3.0]]))
    assert np.allclose(p @ [[0.0, 1.0], [2.0, 3.0]], low @ up)
    value, vector = linalg.power_iteration(m)
    assert value == pytest.approx(np.linalg.eigvalsh(a)[-1])
    with pytest.raises(ValueError):
        linalg.solve_linear(linalg.frame(spark, np.ones((2, 2))), spark.createDataFrame([(0, 1.0), (1, 2.0)], "i int, x double"))


def test_graphs(spark):
    e = graph.edge_table(spark, [(0, 1, 4), (0, 2, 1), (2, 1, 2), (1, 3, 5), (5, 6, 1)])
    v = spark.createDataFrame([(i,) for i in range(7)], "v long")
    assert {r["v"]: r["distance"] for r in graph.dijkstra(e, 0).collect()} == {0: 0, 2: 1, 1: 3, 3: 8}
    assert {r["v"]: r["component"] for r in graph.connected_components(e, v).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5, 6: 5}
    assert graph.bfs(e, 0) == [0, 1, 2, 3] and graph.dfs(e, 0, True) == [0, 1, 3, 2] and graph.find_path(e, 0, 3, True) == [0, 1, 3]
    assert graph.topological_sort(e, v)[:2] == [0, 4] and not graph.has_cycle(e) and graph.has_cycle(graph.edge_table(spark, [(0, 1), (1, 0)]))
    assert graph.kruskal_mst(e).agg(F.sum("weight")).first()[0] == 9 and graph.prim_mst(e)[1] == 8
    with pytest.raises(ValueError, match="negative cycle"):
        graph.bellman_ford(graph.edge_table(spark, [(0, 1, -1), (1, 0, -1)]), 0)


def test_simulation(spark):
    pi = simulation.estimate_pi(spark, 50_000).first()
    assert abs(pi["estimate"] - math.pi) < 5 * pi["std_error"]
    s = {r["index"]: r for r in simulation.variance_global_sensitivity(spark, lambda a, b: a + 2 * b, [(0, 1), (0, 1)], 4000).collect()}
    assert s[1]["first_order"] == pytest.approx(0.8, abs=0.08) and s[0]["total_order"] == pytest.approx(0.2, abs=0.05)
    assert simulation.propagate_linear(lambda a, b: a * b, [2, 3], [0.1, 0.2])["standard_uncertainty"] == pytest.approx(0.5, abs=1e-6)
    assert simulation.local_identifiability(lambda p: [p[0] + p[1], 2 * p[0] + 2 * p[1]], [1, 2])["rank"] == 1


def test_calculus(spark):
    assert calculus.simpson(spark, F.exp, 0, 1, 100) == pytest.approx(math.e - 1, abs=1e-9)
    for r in (calculus.romberg(math.exp, 0, 1), calculus.adaptive_simpson(math.exp, 0, 1)):
        assert r.value == pytest.approx(math.e - 1, abs=1e-9)
    assert calculus.gaussian_quadrature(math.exp, 0, 1, 8) == pytest.approx(math.e - 1, abs=1e-14)
    decay = lambda t, y: -y
    for solve, tol in ((calculus.rk4, 1e-8), (calculus.rk45, 1e-6), (calculus.trapezoid_method, 1e-4), (calculus.backward_euler, 5e-3), (calculus.euler_method, 5e-3)):
        assert solve(decay, 0.0, [1.0], 1.0).y[-1][0] == pytest.approx(math.exp(-1), abs=tol)
    q = calculus.velocity_verlet(lambda q: -q, [1.0], [0.0], 0.0, 2 * math.pi, 0.01).y[-1]
    assert q == pytest.approx([1, 0], abs=1e-3)
    assert calculus.nelder_mead(lambda p: (p[0] - 1) ** 2 + p[1] ** 2, [0, 1]).x == pytest.approx([1, 0], abs=1e-5)
    assert calculus.newton_method(lambda x: x * x - 2, 1.0).x == pytest.approx(math.sqrt(2)) and calculus.line_search(lambda x: (x - 1) ** 2, 0, 3).x == pytest.approx(1, abs=1e-6)
    assert calculus.projected_gradient_descent(lambda p: (p[0] - 5) ** 2, [0], [0], [2]).x == pytest.approx([2])
    heat = calculus.solve_heat([math.sin(math.pi * i / 20) for i in range(21)], 1.0, 1.0, 0.05, 21)
    assert max(heat.u_final) == pytest.approx(math.exp(-math.pi**2 * 0.05), abs=0.01)


def test_symbolic_models(spark, xs):
    x = symbolic.Variable("x")
    e = (x * 0 + symbolic.Sin(x) * x**2 + 1).simplify()
    d = e.diff("x")
    assert d.evaluate(x=1.3) == pytest.approx(calculus.derivative(lambda v: e.evaluate(x=v), 1.3), abs=1e-6)
    assert xs.select(d.column().alias("d")).first()[0] == pytest.approx(d.evaluate(x=1.0))
    assert symbolic.solve_equation(x**2 - 2, "x")["x"] == pytest.approx(math.sqrt(2))
    fit = symbolic.fit_parameters(symbolic.Variable("a") * x + symbolic.Variable("b"), xs, "y", ["a", "b"])
    assert fit["parameters"] == pytest.approx({"a": 2, "b": 1}) and fit["converged"]


def test_science(spark):
    assert science.get_constant("c") == 299792458.0
    with pytest.raises(KeyError):
        science.get_constant("nope")
    m, km = science.Unit("m", 1, science.Dimension(length=1)), science.Unit("km", 1000, science.Dimension(length=1))
    assert (science.Quantity(1.0, km) + science.Quantity(500.0, m)).value == 1.5
    with pytest.raises(ValueError):
        science.Quantity(1.0, km).to(science.Unit("s", 1, science.Dimension(time=1)))
    assert science.is_entangled(science.bell_state()) and not science.is_entangled(science.QuantumRegister(2))
    shots = {r["state"]: r["n"] for r in science.ghz_state(3).measure_shots(spark, 2000).collect()}
    assert set(shots) == {"000", "111"} and abs(shots["000"] - 1000) < 150
    assert science.mandelbrot(0, 0) == 256 and science.mandelbrot(2, 2) == 1
    assert science.mandelbrot_image(spark, -2, 1, -1, 1, 3, 3, 20).count() == 9


def test_neural():
    p = neural.Parameter([[1.0, 2.0], [3.0, 4.0]])
    loss = neural.cross_entropy(neural.gelu(p @ p) + neural.exp(neural.neg(p)), [0, 1])
    loss.backward()
    h = 1e-6
    q = neural.Parameter(p.data + np.array([[h, 0], [0, 0]]))
    again = neural.cross_entropy(neural.gelu(q @ q) + neural.exp(neural.neg(q)), [0, 1])
    assert (again.data - loss.data) / h == pytest.approx(p.grad[0, 0], abs=1e-4)
    model = neural.MiniGPT(5, 8, 2, 8)
    opt = neural.Adam(model.parameters(), lr=0.02)
    losses = [neural.train_step(model, [0, 1, 2, 3], [1, 2, 3, 4], opt) for _ in range(60)]
    assert losses[-1] < 0.3 * losses[0] and len(neural.sample(model, [0], 3)) == 4


def test_sources_and_streams(spark, tmp_path, xs):
    path = tmp_path / "t.csv"
    path.write_text("x1,x2,y\n" + "\n".join(f"{a},{b},{3 + 1.25 * a - 0.5 * b}" for a, b in [(1, 2), (2, 1), (3, 5), (4, 4), (5, 1)]))
    fit = accumulators.fit_linear_csv_streaming(spark, str(path), ["x1", "x2"], "y")
    assert [fit.intercept, *fit.coefficients] == pytest.approx([3, 1.25, -0.5]) and fit.rows_seen == 5
    acc = accumulators.StreamingLinearAccumulator()
    for r in frame.to_list(xs):
        acc.update([[r["x"]]], [r["y"]])
    assert acc.fit().coefficients == pytest.approx((2,))
    assert [len(b) for b in files.iter_csv_batches(spark, str(path), 2)] == [2, 2, 1]
    a, b = accumulators.moments_of([1, 2]), accumulators.moments_of([3, 4])
    a.merge(b)
    assert (a.count, a.mean) == (4, 2.5) and a.variance == pytest.approx(5 / 3)
    assert files.profile_file(spark, str(path)).size_bytes == path.stat().st_size
    blocks = files.file_blocks(spark, str(path), 16).orderBy("block").collect()
    assert b"".join(bytes(r["bytes"]) for r in blocks) == path.read_bytes()
    chunks = list(files.iter_array_chunks(np.arange(10).reshape(5, 2), chunk_size=2))
    assert [c.stop - c.start for c in chunks] == [2, 2, 1] and files.reduce_chunks(chunks, lambda s, d: s + d.sum(), 0) == 45
    with pytest.raises(ValueError):
        files.resolve_within_root("../x", tmp_path)


def test_workflow(spark, tmp_path, xs):
    h = workflow.generate_hypotheses("Does x differ?")[0]
    r = workflow.HypothesisEvaluator().evaluate(h, {"groups": {"df": xs, "value": "x", "group": "g"}}).first()
    assert r["test_name"] == "two-sample-t" and not r["is_significant"]
    need = workflow.SelectionCondition("n", "gte", 5)
    ranked = workflow.rank_methods([workflow.MethodCandidate("b", requirements=(need,)), workflow.MethodCandidate("a", required_tools=("none",))], workflow.MethodSelectionContext({"n": 8}))
    assert [(x.candidate.name, x.status) for x in ranked] == [("b", "eligible"), ("a", "blocked")] and need.check({}) == "unknown"
    plan = lambda request, best: (workflow.AnalysisPlan(request, (workflow.PlanStep("s", "describe"),)), {"s": lambda values: frame.describe(xs)})
    o = workflow.ResearchOrchestrator(lambda q: workflow.MethodSelectionContext({"n": 8}), [workflow.MethodCandidate("b")], plan, {"finite": lambda values: validation.check_finite(xs, "x", "i")})
    yes, no = lambda x: True, lambda x: False
    run = lambda *asked, **of: o.run(spark, workflow.AnalysisRequest("q", **of), *asked)
    assert run(yes, yes)["gate"] == workflow.GateDecision("review", ("no alternatives",)) and run(yes, yes)["manifest"].decisions[0].approved_by_user
    assert [run(*asked)["trace"][0].step_id for asked in ((), (yes,), (yes, no), (None, yes), (no, yes))] == ["plan", "plan", "plan", "s", "s"]
    for asked in ((), (yes,), (yes, no), (None, yes), (no, yes)):
        got = run(*asked)
        assert got["gate"].status == "blocked" and not got["values"] and not got["manifest"].decisions[0].approved_by_user
    o.policy = workflow.GatePolicy(require_alternatives=False)
    assert run(yes, yes)["gate"].status == "ready" and run(yes, require_plan_approval=False)["gate"].status == "ready"
    m = workflow.RunManifest("q", seed=1)
    workflow.save_checkpoint("c.json", m, {"k": 1}, tmp_path)
    assert workflow.load_checkpoint("c.json", tmp_path) == (m, {"k": 1})
    with pytest.raises(ValueError):
        workflow.canonical_sha256(float("nan"))


def test_command_line(capsys):
    from mensura.__main__ import main

    assert main(["version"]) == 0 and main(["nope"]) == 2 and main(["constants"]) == 0 and main(["hypothesis", "why"]) == 0
    assert "2.99792e+08" in capsys.readouterr().out
