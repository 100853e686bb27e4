"""Inputs that had given wrong or no answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavepanel.functions import numeric
from wavepanel.operators import clean, joins, summaries
from wavepanel.operators.glm import fit_glm
from wavepanel.operators.hypothesis import anova_ii
from wavepanel.operators.predict import coefficient_draws, covariance_root, marginal_ci, predict_ci
from wavepanel.operators.residuals import draw_count, levene, sim_residuals
from wavepanel.plans.panels import SUP, WAVE_YEARS, wide_panel


def test_panel_waves_cover_every_order(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    years = {r[0] for r in orders.select(F.year("o_orderdate")).distinct().collect()}
    assert years <= set(WAVE_YEARS.values())
    panel = wide_panel(spark, sf)
    total = panel.agg(F.sum(sum((F.coalesce(F.col(f"t{k}"), F.lit(0.0)) for k in WAVE_YEARS), F.lit(0.0)))).first()[0]
    customers = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("o_custkey"))
    assert total == pytest.approx(orders.join(customers, "o_custkey").agg(F.sum("o_totalprice")).first()[0] / 10000, rel=1e-9)
    assert len(SUP) == len(WAVE_YEARS) - 1


def test_histogram_refuses_values_outside_its_breaks(spark):
    df = spark.createDataFrame([(float(i),) for i in (1, 2, 3, 8, 9)], "x double")
    with pytest.raises(ValueError, match="2 values"):
        summaries.histogram(df, "x", [0, 2, 5])
    assert [r["count"] for r in summaries.histogram(df, "x", [0, 2, 9]).orderBy("bin").collect()] == [2, 3]


@pytest.mark.parametrize("values", [[1.0, 2.0, 3.0, math.inf], [-math.inf, 0.0, 1.0, 5.0, math.inf, math.inf], [1e308, -1e308, 0.0, 1.0, 2.0]])
def test_quantiles_with_infinite_and_huge_values(spark, values):
    df = spark.createDataFrame([(v,) for v in values * 3], "x double")
    narrow = summaries.quantiles(df, "x", [0.0, 0.25, 0.5, 1.0], exact_distinct=0).first()
    exact = summaries.quantiles(df, "x", [0.0, 0.25, 0.5, 1.0]).first()
    assert narrow["q0"] == exact["q0"] and narrow["q3"] == exact["q3"]
    assert narrow["q2"] == pytest.approx(exact["q2"])


def test_boxes_leave_nan_out_and_need_no_group(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (float("nan"),), (None,)], "x double")
    stats, _ = summaries.box_stats(df, [], "x")
    row = stats.first()
    assert row["n"] == 4 and row["middle"] == 2.5
    assert "NestedLoop" not in stats._jdf.queryExecution().executedPlan().toString()
    assert levene(df.where("x > 0"), "x", []).first()["df1"] == 0


def test_crosstab_shares_of_all(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "x")], "r string, c string")
    got = {(r.r, r.c): r.prop for r in summaries.crosstab_prop(df, "r", "c", margin="all").collect()}
    assert got == {("a", "x"): 0.25, ("a", "y"): 0.25, ("b", "x"): 0.5}


def test_binding_and_weights_match_missing_keys(spark):
    left = spark.createDataFrame([(1, "a"), (None, "b")], "k int, x string")
    right = spark.createDataFrame([(1, "c"), (None, "d")], "k int, y string")
    assert {(r.k, r.x, r.y) for r in joins.bind_by_key(left, right, ["k"]).collect()} == {(1, "a", "c"), (None, "b", "d")}
    pred = spark.createDataFrame([("g", "u", 1.0), ("g", None, 3.0), ("h", "u", 5.0), ("h", "w", 7.0)], "k string, o string, p double")
    weights = spark.createDataFrame([("u", 0.5), (None, 0.5)], "o string, share double")
    got = {r.k: r.p for r in summaries.marginalise(pred, "o", ["k"], "p", weights).collect()}
    assert got == {"g": 2.0, "h": None}


@pytest.fixture(scope="module")
def positive(spark):
    rng = np.random.default_rng(5)
    rows = [(g, h, float(rng.gamma(4, m / 4))) for g, m in (("a", 1.0), ("b", 2.0), ("c", 4.0)) for h in ("u", "v") for _ in range(40)]
    return spark.createDataFrame(rows, "g string, h string, y double")


@pytest.mark.parametrize("family, link", [("gamma", "inverse"), ("inverse_gaussian", "1/mu^2"), ("gamma", "log")])
def test_interval_ends_are_in_order(positive, family, link):
    model = fit_glm(positive, "y", [("g",)], family, link)
    rows = predict_ci(model, positive.select("g").distinct()).collect()
    assert len(rows) == 3 and all(r.p_lower < r.p_mle < r.p_upper for r in rows)


def test_key_without_weight_keeps_its_row(spark, positive):
    model = fit_glm(positive, "y", [("g",), ("h",)], "gamma", "log")
    grid = positive.select("g", "h").distinct()
    weights = spark.createDataFrame([("a", "u", 0.5), ("a", "v", 0.5), ("b", "u", 1.0)], "g string, h string, share double")
    got = {r.g: r.p_mle for r in marginal_ci(model, grid, "h", ["g"], weights, ["g"], draws=200).collect()}
    assert set(got) == {"a", "b", "c"} and got["a"] is not None and got["b"] is None and got["c"] is None
    many = spark.range(20_000).select(F.lit("a").alias("g"), F.lit("u").alias("h"))          # more rows of a key than one task adds up
    assert marginal_ci(model, many, "h", ["g"], draws=10).first().p_mle == pytest.approx(model.with_mean(many.limit(1), "m").first().m)


def test_draws_come_from_one_factor():
    cov = np.array([[2.0, 0.6], [0.6, 1.0]])
    root = covariance_root(cov)
    assert np.allclose(root @ root.T, cov)
    assert np.cov(coefficient_draws(np.zeros(2), root, 200_000, 1).T) == pytest.approx(cov, abs=0.03)
    flat = covariance_root(np.array([[1.0, 1.0], [1.0, 1.0]]))
    assert np.allclose(flat @ flat.T, 1.0)


@pytest.mark.parametrize("mean, size", [(800.0, None), (5000.0, None), (2000.0, 1000.0), (1e6, 2000.0), (3.0, None)])
def test_counts_with_large_means(mean, size):
    u = (np.arange(4000) + 0.5) / 4000
    y = draw_count(u, np.full(4000, mean), size)
    variance = mean if size is None else mean + mean * mean / size
    assert y.mean() == pytest.approx(mean, rel=0.01) and y.var() == pytest.approx(variance, rel=0.05)
    cdf = (lambda v: numeric.poisson_cdf(v, np.full(4000, mean))) if size is None else (lambda v: numeric.negbin_cdf(v, np.full(4000, mean), size))
    assert (cdf(y) >= u - 1e-9).all() and (cdf(np.maximum(y - 1, 0)) < u + 1e-9)[y > 0].all()


def test_boolean_and_date_levels_keep_their_type(spark):
    df = spark.createDataFrame([(True, "2020-01-02", 1.0), (False, "2020-01-01", 2.0), (True, "2020-01-01", 4.0), (False, "2020-01-02", 3.0)], "b boolean, d string, y double")
    df = df.withColumn("d", F.to_date("d"))
    found = clean.find_levels(df, ["b", "d"])
    assert found["b"].values == (False, True) and [str(d) for d in found["d"].values] == ["2020-01-01", "2020-01-02"]
    model = fit_glm(df, "y", [("b",)])
    assert model.n == 4 and {round(r.fitted, 6) for r in model.fitted(df).collect()} == {2.5}


def test_distinct_values_are_a_table(spark):
    df = spark.range(3000).select(F.col("id").alias("a"), (F.col("id") % 2).cast("string").alias("b"))
    out = clean.distinct_values(df, ["a", "b"])
    assert out.count() == 3002


def test_inverse_link_without_intercept(positive):
    model = fit_glm(positive, "y", [("g",)], "gamma", "inverse", intercept=False)
    assert model.converged and math.isinf(model.null_deviance)
    means = {r.g: r.m for r in positive.groupBy("g").agg(F.avg("y").alias("m")).collect()}
    assert {round(r.fitted, 6) for r in model.fitted(positive).collect()} == {round(m, 6) for m in means.values()}


def test_random_intercept_residuals_are_refused(spark):
    class Model:
        sigma = 1.0
    with pytest.raises(ValueError, match="random-intercept"):
        sim_residuals(Model(), spark.range(1), ["id"])


def test_unconverged_nested_fits_raise(positive, monkeypatch):
    from wavepanel.operators import glm
    solve = glm.ModelFrame.solve
    monkeypatch.setattr(glm.ModelFrame, "solve", lambda self, sets, max_passes=40: solve(self, sets, 2))
    with pytest.raises(ArithmeticError, match="did not converge"):
        anova_ii(positive, "y", [("g",), ("h",)], "gamma", "inverse")
