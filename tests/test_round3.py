"""Diagnostics and fits added or mended in the third round."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wavepanel.functions import numeric
from wavepanel.operators import glm, residuals
from wavepanel.operators.extended import fit_glmm_ri, glmm_log_likelihood, glmm_residuals, mixture_residuals
from wavepanel.operators import absorb, extended, predict, summaries
from wavepanel.operators.counts import fit_hurdle, fit_negbin, fit_ztnb
from wavepanel.operators.glm import fit_glm
from wavepanel.plans.panels import lines, long_panel, wide_panel
from wavepanel.sources import tables


def brute_ks(u):
    u, n = np.sort(u), len(u)
    return max((np.arange(1, n + 1) / n - u).max(), (u - np.arange(n) / n).max())


def test_ks_of_values_close_together(spark):
    rng = np.random.default_rng(12)
    n = 20_000
    near = 0.4 + 1e-6 * rng.random(n)
    near[rng.random(n) < 0.01] = rng.random()
    deep = 0.7 + 1e-12 * rng.random(n) ** 8
    tied = np.where(rng.random(n) < 0.9, 0.25, rng.random(n))
    pdf = pd.concat([pd.DataFrame({"g": g, "u": u}) for g, u in (("near", near), ("deep", deep), ("tied", tied), (None, rng.random(n)), ("one", np.array([0.3])))])
    df = spark.createDataFrame(pdf, "g string, u double").repartition(4)
    sorted_rows = []
    real = residuals.durable

    def watch(table):
        kept = real(table)
        if "c" in kept.columns and "__path" in kept.columns:
            sorted_rows.append(kept.where(F.col("hi") > F.col("lo")).count())
        return kept
    residuals.durable = watch
    try:
        got = {r["g"]: (r["n"], r["ks"]) for r in residuals.uniform_ks(df, "u", "g", leaf=50).collect()}
    finally:
        residuals.durable = real
    assert len(sorted_rows) >= 3                              # refined more than once
    for g, u in (("near", near), ("deep", deep), ("tied", tied), ("one", np.array([0.3]))):
        assert got[g] == (len(u), pytest.approx(brute_ks(u), abs=1e-12)), g
    assert got[None][0] == n


def test_size_beyond_the_former_limit(spark):
    rng = np.random.default_rng(4)
    n, k, mu = 60_000, math.exp(8.5), 3000.0
    y = rng.poisson(rng.gamma(k, mu / k, n))
    df = spark.createDataFrame(pd.DataFrame({"y": y, "h": np.where(rng.random(n) < 0.7, y, 0)}))
    for m in (fit_negbin(df, "y", []), fit_ztnb(df, "y", []), fit_hurdle(df, "h", [], []).count):
        se = float(np.sqrt(m.cov[-1, -1]))
        assert m.converged and not m.poisson_limit and abs(m.log_k - 8.5) < 4 * se < 0.4
        assert m.boundary_z > 3


def test_poisson_boundary(spark):
    rng = np.random.default_rng(9)
    y = np.minimum(rng.binomial(20, 0.2, 5000), 19)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "p": y + 1.0}))
    m = fit_negbin(df, "y", [])
    assert m.poisson_limit and math.isinf(m.theta) and m.boundary_z < 0
    poisson = fit_glm(df, "y", [], "poisson")
    assert m.log_likelihood == pytest.approx(poisson.log_likelihood(), rel=1e-9)
    assert m.cov[0, 0] == pytest.approx(poisson.cov[0, 0], rel=1e-6)
    t = fit_ztnb(df.where("y > 0"), "y", [])
    mean = df.where("y > 0").withColumn("m", t.mean_positive()).first()["m"]
    assert t.poisson_limit and mean == pytest.approx(y[y > 0].mean(), rel=1e-6)
    low, high = t.family.cdf(np.array([1.0, 5.0]), np.array([4.0, 4.0]))
    assert low[0] == pytest.approx(0, abs=1e-12) and 0 < low[1] < high[1] < 1


def test_exact_binomial_p():
    def brute(k, n, p):
        pmf = np.array([math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(n + 1)])
        return min(1.0, pmf[pmf <= pmf[k] * (1 + 1e-7)].sum())
    for n, p in ((10, 0.3), (50, 0.01), (41, 0.5), (200, 0.97)):
        for k in range(0, n + 1, max(1, n // 17)):
            assert numeric.binomial_two_sided(k, n, p) == pytest.approx(brute(k, n, p), abs=1e-10), (k, n, p)
    assert numeric.binomial_two_sided(0, 10**12, 0.0) == 1 and numeric.binomial_two_sided(3, 10, 0.0) == 0


def test_residual_tests_have_p_values(spark):
    rng = np.random.default_rng(21)
    flat = spark.createDataFrame(pd.DataFrame({"residual": np.concatenate([rng.random(4000), [0.0] * 60])}))
    row = residuals.residual_overall(flat, sims=250).first()
    assert row["outliers"] == 60 and row["outliers_p"] < 1e-4 and 0 < row["dispersion_p"] < 1
    narrow = spark.createDataFrame(pd.DataFrame({"residual": rng.beta(4, 4, 4000)}))
    row = residuals.residual_overall(narrow, sims=250).first()
    assert row["dispersion_p"] < 1e-6 and row["outliers_p"] < 1e-4      # about 32 outliers expected, none seen


def test_dispersion_by_replicates(spark):
    rng = np.random.default_rng(2)
    n = 3000
    pdf = pd.DataFrame({"id": np.arange(n), "good": rng.poisson(6.0, n), "wide": rng.poisson(rng.gamma(2.0, 3.0, n))})
    df = spark.createDataFrame(pdf).repartition(3)
    good = residuals.dispersion_test(fit_glm(df, "good", [], "poisson"), df, ["id"], sims=100).first()
    wide = residuals.dispersion_test(fit_glm(df, "wide", [], "poisson"), df, ["id"], sims=100).first()
    assert 0.9 < good["ratio"] < 1.1 and good["p_value"] > 0.02
    assert wide["ratio"] > 2 and wide["p_value"] == 0
    again = residuals.dispersion_test(fit_glm(df, "good", [], "poisson"), df.repartition(7), ["id"], sims=100).first()
    assert again["simulated"] == pytest.approx(good["simulated"], rel=1e-12)


def test_sums_of_models_by_buckets(spark):
    def vectors(batches):
        for b in batches:
            for i in b["id"]:
                yield pd.DataFrame({"v": [np.arange(5.0) * i]})
    for parts in (1, 40):
        df = spark.range(0, 200, 1, parts).mapInPandas(vectors, "v array<double>")
        assert glm.sum_arrays(df).tolist() == [x * 19900.0 for x in range(5)]
    assert len(glm.sum_arrays(spark.range(0).mapInPandas(vectors, "v array<double>"))) == 0
    plan = df._jdf.queryExecution().toString()
    assert "Generate" not in plan                            # no row per number


@pytest.fixture(scope="module")
def grouped(spark):
    rng = np.random.default_rng(31)
    groups, each, sigma, nu = 150, 20, 0.5, 4.0
    g = np.repeat(np.arange(groups), each)
    x = rng.normal(size=len(g))
    b = rng.normal(0, sigma, groups)[g]
    pdf = pd.DataFrame({"g": g, "x": x, "y": rng.gamma(nu, np.exp(1 + 0.3 * x + b) / nu)})
    df = spark.createDataFrame(pdf).repartition(4)
    return pdf, df, fit_glmm_ri(df, "y", [("x",)], "g")


def brute_log_likelihood(pdf, beta, sigma, nu):
    """Plain integration on a fine grid of intercepts."""
    grid = np.linspace(-8, 8, 2001)
    eta = beta[0] + beta[1] * pdf.x.to_numpy()
    total = 0.0
    for _, rows in pd.DataFrame({"g": pdf.g, "y": pdf.y, "eta": eta}).groupby("g"):
        m = rows.eta.to_numpy()[:, None] + sigma * grid
        y = rows.y.to_numpy()[:, None]
        h = (nu * np.log(nu) - math.lgamma(nu) + (nu - 1) * np.log(y) - nu * m - nu * y * np.exp(-m)).sum(axis=0) - grid**2 / 2
        total += h.max() + math.log(np.trapezoid(np.exp(h - h.max()), grid)) - 0.5 * math.log(2 * math.pi)
    return total


def test_random_intercept_information(grouped, spark):
    pdf, df, m = grouped
    par = np.array([*m.beta, math.log(m.sigma), math.log(m.shape)])

    def ll(v):
        return brute_log_likelihood(pdf, v[:2], math.exp(v[2]), math.exp(v[3]))
    assert m.converged and m.log_likelihood == pytest.approx(ll(par), abs=1e-4)
    got = glmm_log_likelihood(df, "y", F.lit(float(par[0])) + F.col("x") * float(par[1]), "g", m.sigma, m.shape).first()
    assert got["groups"] == 150 and got["log_likelihood"] == pytest.approx(m.log_likelihood, abs=1e-5)
    step, k = 1e-3, len(par)
    h = np.zeros((k, k))
    for i in range(k):
        for j in range(k):
            e, f = np.eye(k)[i] * step, np.eye(k)[j] * step
            h[i, j] = (ll(par + e + f) - ll(par + e - f) - ll(par - e + f) + ll(par - e - f)) / (4 * step * step)
    want = np.sqrt(np.diag(np.linalg.inv(-h)))
    table = {r["term"]: r["std_error"] for r in m.coef_table(spark).collect()}
    got = [table["(Intercept)"], table["x"], table["sd(group intercept)"] / m.sigma, table["shape"] / m.shape]
    assert got == pytest.approx(want, rel=0.01)


def test_random_intercept_residuals(grouped, spark, monkeypatch):
    _, df, m = grouped
    u = glmm_residuals(m, df, "g", given="none")
    ks = residuals.uniform_ks(u, "residual").first()["ks"]
    assert ks < 0.12                                          # groups share their intercept
    own = glmm_residuals(m, df, "g")
    row = residuals.residual_overall(own).first()
    assert row["n"] == 3000 and row["ks_p"] > 0.01 and row["mean"] == pytest.approx(0.5, abs=0.02)
    monkeypatch.setattr(extended, "BROADCAST_ROWS", 1)        # the same by a salted join
    salted = {r["g"]: r["m"] for r in glmm_residuals(m, df, "g").groupBy("g").agg(F.avg("residual").alias("m")).collect()}
    assert salted == pytest.approx({r["g"]: r["m"] for r in own.groupBy("g").agg(F.avg("residual").alias("m")).collect()})
    odd = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", None), ("a", -1.0), ("b", 3.0)], "g string, y double")
    assert mixture_residuals(odd, "y", F.lit(0.0), "g", 0.5, 2.0).count() == 3


def test_cube_rolls_up_exactly(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rng.choice(["x", "y"], 500), "b": rng.choice(["p", "q", "r"], 500), "v": 1e8 + rng.normal(size=500), "w": rng.normal(size=500)})
    pdf.loc[pdf.b == "r", "w"] = None
    pdf.loc[pdf.a == "y", "a"] = None
    df = spark.createDataFrame(pdf).replace(float("nan"), None)
    cube = summaries.moment_cube(df, ["a", "b"], ["v", "w"])
    got = {r["a"]: r for r in summaries.describe_layers(cube, ["a"], ["v", "w"]).where("measure = 'v'").collect()}
    for a, rows in pdf.groupby("a", dropna=False):
        r = got[None if pd.isna(a) else a]
        assert (r["n"], r["mean"], r["se"]) == (len(rows), pytest.approx(rows.v.mean(), rel=1e-14), pytest.approx(rows.v.std() / len(rows) ** 0.5, rel=1e-6))
    only = {r["b"]: r for r in summaries.roll_up(cube, ["b"], ["w"]).collect()}
    assert only["r"]["w_n"] == 0 and only["r"]["w_mean"] is None
    assert only["p"]["w_mean"] == pytest.approx(pdf[pdf.b == "p"].w.mean())


def test_box_layers_equal_single_boxes(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"t": rng.choice(["a", "b"], 400), "c": rng.choice(["u", "v"], 400), "x": np.round(rng.normal(size=400), 1)})
    df = spark.createDataFrame(pdf)
    stats, outliers = summaries.box_layers(df, "t", {"all": F.lit("all"), "c": "c"}, "x")
    alone, out = summaries.box_stats(df, ["t", "c"], "x")
    names = ["t", "n", "ymin", "lower", "middle", "upper", "ymax", "n_outliers"]
    assert sorted(stats.where("layer = 'c'").select("cell", *names).collect()) == sorted(alone.select("c", *names).collect())
    assert outliers.where("layer = 'c'").count() == out.count()


def test_marginal_interval_by_blocks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"x": rng.normal(size=900), "g": rng.choice(["a", "b"], 900), "d": rng.choice(["u", "v", "w"], 900)})
    pdf["y"] = (rng.random(900) < 1 / (1 + np.exp(-pdf.x - (pdf.g == "a")))).astype(int)
    df = spark.createDataFrame(pdf)
    m = fit_glm(df, "y", [("x",), ("g",), ("d",)], "binomial")
    grid = spark.createDataFrame([(float(i), g, d) for i in range(4) for g in "ab" for d in "uvw"], "x double, g string, d string")
    share = spark.createDataFrame([("a", "u", 0.2), ("a", "v", 0.3), ("a", "w", 0.5), ("b", "u", 0.6), ("b", "v", 0.4)], "g string, d string, share double")

    def run(**more):
        rows = predict.marginal_ci(m, grid, "d", ["x", "g"], share, ["g"], draws=500, seed=3, **more).collect()
        return {(r["x"], r["g"]): (r["p_mle"], r["p_lower"], r["p_upper"]) for r in rows}
    whole = run()
    assert len(whole) == 8 and all(whole[x, "b"] == (None, None, None) for x in range(4))          # no weight of w for b
    point, low, high = whole[1.0, "a"]
    sims = predict.coefficient_draws(m.beta_scaled, predict.covariance_root(m.cov_scaled), 500, 3)
    cells = m.design.matrix(m.inputs(grid.where("x = 1 and g = 'a'").orderBy("d")).toPandas())[:, m.cols]
    p = (1 / (1 + np.exp(-cells @ sims.T))) * np.array([[0.2], [0.3], [0.5]])
    assert (low, high) == pytest.approx(np.quantile(p.sum(axis=0), [0.025, 0.975]), rel=1e-9) and low < point < high
    monkeypatch.setattr(predict, "LEVELS_PER_BLOCK", 1)
    monkeypatch.setattr(predict, "BATCH_BYTES", 8 * 500 * 2)
    blocks = run()
    for k, v in whole.items():
        assert blocks[k] == (pytest.approx(v, rel=1e-9) if v[0] is not None else v)
    natural = spark.createDataFrame([(i, t, float(v)) for i in range(40) for t, v in m.coef.items()], "draw int, term string, value double")
    same = run(coefficients=natural)
    assert same[2.0, "a"][1:] == pytest.approx((whole[2.0, "a"][0],) * 2)                            # equal draws give the point itself
    with pytest.raises(ValueError, match="every draw"):
        run(coefficients=natural.where("draw > 0 or term <> 'x'"))
    assert predict.marginal_ci(m, grid, "d", [], draws=50).count() == 1


def test_malformed_rows_are_quarantined(spark, tmp_path):
    (tmp_path / "p.csv").write_text("ID,trat,alt0,alt1\n1,a,10.5,11\n2,b,NA,12\n3,a,tall,9\n4,a\n5,b,1,2,3\nNA,a,1,2\n6,b,7,NA\n")
    good, rejected = tables.read_checked(spark, str(tmp_path / "p.csv"), "ID long, alt0 double, alt1 double", ["ID"])
    assert sorted((r["ID"], r["alt0"], r["alt1"]) for r in good.collect()) == [(1, 10.5, 11.0), (2, None, 12.0), (6, 7.0, None)]
    assert good.select("ID").count() == 3 and rejected.count() == 4
    lines = {r["line"]: r["reason"] for r in rejected.collect()}
    assert lines["3,a,tall,9"] == lines["4,a"] == lines["5,b,1,2,3"] == "malformed" and "missing ID" in lines.values()
    counts = {r["reason"]: r["n"] for r in tables.quarantine(rejected, str(tmp_path / "q")).collect()}
    assert counts == {"malformed": 3, "missing ID": 1}


def test_bundles_are_seen_whole_or_not(spark, tmp_path):
    path = str(tmp_path / "study")
    a, b = spark.range(5).toDF("x"), spark.range(3).toDF("y")
    first = tables.write_bundle({"points": a, "boxes": b}, path)
    broken = spark.range(4).select(F.raise_error(F.lit("lost")).cast("int").alias("z"))
    with pytest.raises(Exception, match="lost"):
        tables.write_bundle({"points": b, "boxes": broken}, path)                # half a version: no manifest
    layers = tables.read_bundle(spark, path)
    assert {k: v.count() for k, v in layers.items()} == {"points": 5, "boxes": 3}
    second = tables.write_bundle({"points": b}, path)
    assert second > first and set(tables.read_bundle(spark, path)) == {"points"}
    assert tables.read_bundle(spark, path, first)["boxes"].count() == 3
    with pytest.raises(ValueError, match="no version"):
        tables.read_bundle(spark, path, 1)


@pytest.mark.parametrize("family, y", [("gaussian", "l_extendedprice"), ("binomial", "big")])
def test_absorbed_factor_equals_the_expanded_one(spark, sf, family, y):
    df = lines(spark, sf).withColumn("part", (F.col("l_partkey") % 25).cast("string"))
    terms = [("l_quantity",), ("l_returnflag",), ("l_quantity", "l_returnflag")]
    m = absorb.fit_absorbed(df, y, terms, "part", family)
    if m.left_out:
        mixed = df.groupBy("part").agg(F.avg(y).alias("a")).where("a > 0 and a < 1").select("part")
        df = df.join(mixed, "part", "left_semi")
    dense = fit_glm(df, y, [*terms, ("part",)], family)
    own, table = dense.coef, {r["term"]: r["std_error"] for r in dense.coef_table(spark).collect()}
    assert m.converged and m.n == dense.n and m.deviance == pytest.approx(dense.deviance, rel=1e-8)
    for r in m.coef_table(spark).collect():
        assert r["estimate"] == pytest.approx(own[r["term"]], rel=1e-6, abs=1e-9) and r["std_error"] == pytest.approx(table[r["term"]], rel=1e-6)
    assert m.df_resid == dense.df_resid and set(m.coef) == {"l_quantity", "l_returnflagN", "l_returnflagR", "l_quantity:l_returnflagN", "l_quantity:l_returnflagR"}
    effects = {r["part"]: r["effect"] for r in m.effects.collect()}
    some = sorted(effects)[:2]
    gap = own.get(f"part{some[1]}", 0.0) - own.get(f"part{some[0]}", 0.0)
    assert len(effects) == m.levels and effects[some[1]] - effects[some[0]] == pytest.approx(gap, rel=1e-5, abs=1e-7)


def test_absorbed_factor_with_odd_levels(spark):
    rows = [("a", 0, 1.0), ("a", 1, 2.0), ("a", 1, 3.0), ("b", 1, 1.0), ("b", 1, 2.0), (None, 1, 5.0), ("c", 0, 3.0), ("c", 1, 1.0), ("c", None, 1.0), ("c", 0, 2.0)]
    df = spark.createDataFrame(rows, "g string, y int, x double").withColumn("one", F.col("g").eqNullSafe("a").cast("double"))
    m = absorb.fit_absorbed(df, "y", [("x",), ("one",)], "g", "binomial")
    assert m.left_out == 1 and m.levels == 2 and set(m.coef) == {"x"} and any("aliased" in w for w in m.warnings)
    with pytest.raises(ValueError, match="not 0 or 1"):
        absorb.fit_absorbed(df.withColumn("y", F.lit(2)), "y", [("x",)], "g", "binomial")
    with pytest.raises(ValueError, match="no complete rows"):
        absorb.fit_absorbed(df.where("false"), "y", [("x",)], "g")


def test_orders_outside_the_waves_are_an_error(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/customer.parquet").write.parquet(str(tmp_path / "customer.parquet"))
    orders = spark.read.parquet(f"{sf}/orders.parquet").limit(20)
    late = orders.withColumn("o_orderdate", F.to_timestamp(F.lit("2020-05-01")))
    orders.unionByName(late.limit(1)).write.parquet(str(tmp_path / "orders.parquet"))
    for panel in (wide_panel, long_panel):
        with pytest.raises(Exception, match="outside the waves"):
            panel(spark, str(tmp_path)).collect()
