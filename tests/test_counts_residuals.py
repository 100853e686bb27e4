"""Count models, scale and random-effect models, residuals."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wavepanel.functions import numeric as N
from wavepanel.operators import residuals
from wavepanel.operators.counts import anova_negbin, count_log_likelihood, fit_hurdle, fit_negbin, fit_ztnb, negbin_terms
from wavepanel.operators.extended import fit_gamma_ls, fit_glmm_ri, group_intercepts
from wavepanel.operators.glm import fit_glm
from wavepanel.operators.hypothesis import anova_wald
from wavepanel.operators.residuals import (counter_uniform, draw_count, draw_gamma, levene, residual_by_cell, residual_overall,
                                           residual_qq, residual_smooth, residual_trend, sim_residuals, simulate,
                                           simulated_position, uniform_ks)
from wavepanel.operators.reshape import to_long
from wavepanel.operators.summaries import box_stats
from wavepanel.operators.terms import star, term_list


def negbin(rng, mu, k):
    return rng.poisson(rng.gamma(k, mu / k))


@pytest.fixture(scope="module")
def counts(spark):
    rng = np.random.default_rng(12)
    n = 6000
    pdf = pd.DataFrame({"id": np.arange(n), "trat": rng.choice(list("ab"), n), "x": np.round(rng.uniform(0, 2, n), 2)})
    mu = np.exp(0.8 + 0.5 * (pdf.trat == "b") + 0.4 * pdf.x)
    pdf["y"] = negbin(rng, mu, 1.5)
    p = 1 / (1 + np.exp(-(0.3 - 0.6 * (pdf.trat == "b"))))
    pos = negbin(rng, mu, 1.5)
    while (pos == 0).any():
        pos = np.where(pos == 0, negbin(rng, mu, 1.5), pos)
    pdf["h"] = np.where(rng.uniform(size=n) < p, pos, 0)
    pdf["pos"] = pos
    return spark.createDataFrame(pdf), pdf


TRUE = np.array([0.8, 0.5, 0.4, math.log(1.5)])


def test_derivatives_match_differences():
    y, mu, k = np.array([1.0, 2.0, 7.0, 40.0]), np.array([0.4, 3.0, 5.0, 20.0]), 1.3
    for truncated in (False, True):
        f = lambda e, c: negbin_terms(y, mu * math.exp(e), k * math.exp(c), truncated)
        ll, s_m, s_k, h_mm, h_mk, h_kk = f(0, 0)
        h = 1e-4
        assert s_m == pytest.approx((f(h, 0)[0] - f(-h, 0)[0]) / (2 * h), rel=1e-5, abs=1e-6)
        assert s_k == pytest.approx((f(0, h)[0] - f(0, -h)[0]) / (2 * h), rel=1e-5, abs=1e-6)
        assert h_mm == pytest.approx((f(h, 0)[1] - f(-h, 0)[1]) / (2 * h), rel=1e-5, abs=1e-6)
        assert h_mk == pytest.approx((f(0, h)[1] - f(0, -h)[1]) / (2 * h), rel=1e-5, abs=1e-6)
        assert h_kk == pytest.approx((f(0, h)[2] - f(0, -h)[2]) / (2 * h), rel=1e-5, abs=1e-6)


@pytest.mark.parametrize("fit,y", [(fit_negbin, "y"), (fit_ztnb, "pos")])
def test_counts_recover_parameters(counts, fit, y):
    df, _ = counts
    m = fit(df, y, [("trat",), ("x",)])
    est = np.append([m.coef[c] for c in m.labels], m.log_k)
    se = np.sqrt(np.diag(m.cov))
    assert m.converged and m.max_score < 1e-3
    assert np.all(np.abs(est - TRUE) < 4 * se)
    by_row = fit(df.withColumn("x", F.col("x") + F.col("id") * 1e-9), y, [("trat",), ("x",)])   # no repeated patterns
    assert by_row.log_likelihood == pytest.approx(m.log_likelihood, rel=1e-6)


def test_likelihood_is_a_maximum(counts):
    df, _ = counts
    m = fit_ztnb(df, "pos", [("trat",)])
    b0, b1 = (m.coef[c] for c in m.labels)
    at = lambda a, b, c: count_log_likelihood(df, "pos", F.lit(a) + b * (F.col("trat") == "b").cast("int"), c, True).first()[1]
    top = at(b0, b1, m.log_k)
    assert top == pytest.approx(m.log_likelihood, rel=1e-10)
    for d in ((0.01, 0, 0), (-0.01, 0, 0), (0, 0.01, 0), (0, -0.01, 0), (0, 0, 0.01), (0, 0, -0.01)):
        assert at(b0 + d[0], b1 + d[1], m.log_k + d[2]) < top


def test_wald_of_additive_count_model(counts):
    df, _ = counts
    m = fit_ztnb(df, "pos", [("trat",), ("x",)])
    z = {r["term"]: r["statistic"] for r in m.coef_table(df.sparkSession).collect()}
    got = {r["term"]: r for r in anova_wald(df.sparkSession, m).collect()}
    assert got["trat"]["chisq"] == pytest.approx(z["tratb"] ** 2, rel=1e-9)
    assert got["x"]["chisq"] == pytest.approx(z["x"] ** 2, rel=1e-9)
    assert got["x"]["df"] == 1


def test_negbin_lr_table(counts):
    df, _ = counts
    m = fit_negbin(df, "y", [("trat",), ("x",)])
    got = {r["term"]: r for r in anova_negbin(df, "y", [("trat",), ("x",)], m).collect()}
    full = fit_glm(df, "y", [("trat",), ("x",)], "negbin", theta=m.theta).deviance
    less = fit_glm(df, "y", [("trat",)], "negbin", theta=m.theta).deviance
    assert got["x"]["lr_chisq"] == pytest.approx(less - full, rel=1e-6)


def test_poisson_limit_and_bad_counts(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame(pd.DataFrame({"y": rng.binomial(8, 0.5, 2000)}))
    m = fit_negbin(df, "y", [])
    assert m.poisson_limit and m.coef["(Intercept)"] == pytest.approx(math.log(df.agg(F.avg("y")).first()[0]), abs=1e-6)
    with pytest.raises(ValueError, match="counts"):
        fit_ztnb(df, "y", [])                               # zeros in a truncated model
    with pytest.raises(ValueError, match="counts"):
        fit_negbin(df.withColumn("y", F.col("y") + 0.5), "y", [])


def test_hurdle_mean(counts, spark):
    df, pdf = counts
    m = fit_hurdle(df, "h", [("trat",)], [("trat",)])
    out = {r["trat"]: r for r in m.predict(df.select("trat").distinct()).collect()}
    for t in "ab":
        g = pdf[pdf.trat == t]
        assert out[t]["p_positive"] == pytest.approx((g.h > 0).mean(), rel=1e-6)
        # the truncated likelihood reproduces each group's mean of positive counts
        assert out[t]["mean_positive"] == pytest.approx(g.h[g.h > 0].mean(), rel=0.03)
        assert out[t]["expected"] == pytest.approx(out[t]["p_positive"] * out[t]["mean_positive"])
    none = df.withColumn("h", F.when(F.col("trat") == "b", F.lit(0)).otherwise(F.col("h")))
    dropped = fit_hurdle(none, "h", [("x",)], [("trat",), ("x",)], levels={"trat": ["a", "b"]})
    assert dropped.count.design.levels["trat"] == ("a",)


def test_location_scale_recovers_both_parts(spark):
    rng = np.random.default_rng(1)
    n = 6000
    x, f = rng.uniform(0, 1, n), rng.integers(0, 2, n)
    phi = np.exp(-1 + 0.8 * x + 0.5 * f)
    pdf = pd.DataFrame({"id": np.arange(n), "x": x, "f": np.array(["a", "b"])[f], "y": rng.gamma(1 / phi, np.exp(1 + 0.7 * x - 0.4 * f) * phi)})
    df = spark.createDataFrame(pdf)
    m = fit_gamma_ls(df, "y", [("x",), ("f",)], [("x",), ("f",)])
    for r, want in zip(m.coef_table(spark).orderBy("position").collect(), [1, 0.7, -0.4, -1, 0.8, 0.5], strict=True):
        assert abs(r["estimate"] - want) < 4 * r["std_error"]
    ks = residual_overall(sim_residuals(m, df, ["id"])).first()
    assert ks["ks_p"] > 0.001
    assert m.anova(spark).count() == 4


def test_random_intercept_recovers(spark):
    rng = np.random.default_rng(4)
    groups, m = 300, 8
    b = rng.normal(0, 0.5, groups)
    x = rng.uniform(0, 1, (groups, m))
    y = rng.gamma(4.0, np.exp(1 + 0.7 * x + b[:, None]) / 4.0)
    pdf = pd.DataFrame({"g": np.repeat(np.arange(groups), m), "x": x.ravel(), "y": y.ravel()})
    df = spark.createDataFrame(pdf)
    fit = fit_glmm_ri(df, "y", [("x",)], "g")
    assert fit.converged
    assert fit.sigma == pytest.approx(b.std(), abs=0.06) and fit.shape == pytest.approx(4, rel=0.1)
    assert fit.coef["x"] == pytest.approx(0.7, abs=4 * math.sqrt(fit.cov[1, 1]))
    modes = group_intercepts(fit, df, "g").toPandas().sort_values("g")
    assert np.corrcoef(modes.intercept, b)[0, 1] > 0.9


# ---------------------------------------------------------------- residuals

def test_simulated_position_equals_explicit_simulation():
    """The shortcut gives what forming every simulated response and its jitter gives."""
    rng = np.random.default_rng(0)
    n, p = 500, np.array([0.2, 0.7, 0.5, 0.9])
    y, v, h = np.array([0, 1, 1, 0]), rng.uniform(size=4), rng.integers(0, 2**62, 4)
    low, high = np.where(y > 0, 1 - p, 0.0), np.where(y > 0, 1.0, 1 - p)
    got = simulated_position(low, high, v, h, n)
    for i in range(4):
        w = counter_uniform(np.array([h[i]], dtype=np.uint64), np.arange(1, n + 1, dtype=np.uint64))
        sims = (w > 1 - p[i]).astype(float)                       # inverse-CDF Bernoulli
        jitter = np.where(sims > 0, (w - (1 - p[i])) / p[i], w / (1 - p[i]))
        assert got[i] == pytest.approx(np.mean(sims + jitter - 0.5 <= y[i] + v[i] - 0.5), abs=1e-12)


def test_residuals_are_uniform_and_independent_of_partitions(counts):
    df, pdf = counts
    model = fit_ztnb(df, "pos", [("trat",), ("x",)])
    for mode in ("exact", "sim"):
        a = sim_residuals(model, df, ["id"], seed=5, mode=mode, n=400)
        b = sim_residuals(model, df.repartition(13), ["id"], seed=5, mode=mode, n=400)
        pa, pb = (x.select("id", "residual").toPandas().sort_values("id").residual.to_numpy() for x in (a, b))
        assert pa == pytest.approx(pb, abs=1e-12)
        assert residual_overall(a).first()["ks_p"] > 1e-3
    wrong = sim_residuals(fit_negbin(df, "y", []), df, ["id"])     # ignores x and trat
    assert levene(wrong.withColumn("residual", F.col("residual")), "residual", "trat").first()["df1"] == 1


@pytest.mark.parametrize("family,link,y", [("binomial", None, "b"), ("poisson", None, "p"), ("gamma", "log", "g"), ("gaussian", None, "z"),
                                           ("inverse_gaussian", "log", "i")])
def test_residuals_and_simulation_per_family(spark, family, link, y):
    rng = np.random.default_rng(8)
    n = 3000
    f = rng.choice(list("ab"), n)
    mu = np.where(f == "a", 2.0, 5.0)
    pdf = pd.DataFrame({"id": np.arange(n), "f": f, "b": (rng.uniform(size=n) < mu / 7).astype(int), "p": rng.poisson(mu),
                        "g": rng.gamma(3, mu / 3), "z": rng.normal(mu, 1.5), "i": rng.wald(mu, 4.0)})
    df = spark.createDataFrame(pdf)
    m = fit_glm(df, y, [("f",)], family, link)
    assert residual_overall(sim_residuals(m, df, ["id"], seed=2)).first()["ks_p"] > 1e-3
    sims = simulate(m, df, 20, ["id"], seed=9).groupBy("f").agg(F.avg("y_sim").alias("m"), F.var_samp("y_sim").alias("v")).toPandas().set_index("f")
    for t, grp in pdf.groupby("f"):
        assert sims.m[t] == pytest.approx(grp[y].mean(), rel=0.03)
        assert sims.v[t] == pytest.approx(grp[y].var(), rel=0.25)


def test_draws_have_the_right_moments():
    h = np.arange(40_000, dtype=np.uint64) * np.uint64(7919)
    for shape in (0.4, 1.0, 6.5):
        g = draw_gamma(np.full(len(h), shape), h, 2)
        assert g.mean() == pytest.approx(shape, rel=0.03) and g.var() == pytest.approx(shape, rel=0.08)
    u = counter_uniform(h, 1)
    y = draw_count(u, np.full(len(h), 4.0), 2.0)
    assert y.mean() == pytest.approx(4, rel=0.03) and y.var() == pytest.approx(12, rel=0.08)
    t = draw_count(u, np.full(len(h), 4.0), 2.0, truncated=True)
    assert t.min() == 1 and t.mean() == pytest.approx(4 / (1 - (2 / 6) ** 2), rel=0.03)
    assert draw_count(u, np.full(len(h), 3.0), None).var() == pytest.approx(3, rel=0.05)


def test_ks_by_cell_is_exact(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b"], 5000, p=[0.95, 0.05]), "u": rng.beta(1.1, 0.9, 5000)})
    pdf.loc[:300, "u"] = 0.25                                  # heavy tie
    df = spark.createDataFrame(pdf)
    got = {r["g"]: r["ks"] for r in uniform_ks(df, "u", "g").collect()}
    for g, grp in pdf.groupby("g"):
        u, n = np.sort(grp.u), len(grp)
        want = max((np.arange(1, n + 1) / n - u).max(), (u - np.arange(n) / n).max())
        assert got[g] == pytest.approx(want, abs=1e-12)
    for bins in (1, 7, 100_000):
        assert uniform_ks(df, "u", bins=bins).first()["ks"] == pytest.approx(uniform_ks(df, "u").first()["ks"], abs=1e-12)


def test_diagnostic_tables(spark):
    rng = np.random.default_rng(2)
    n = 4000
    x = rng.uniform(0, 10, n)
    pdf = pd.DataFrame({"x": x, "g": rng.choice(["a", "b"], n), "residual": np.clip(0.5 + 0.3 * np.sin(x) + rng.normal(0, 0.1, n), 0, 1)})
    df = spark.createDataFrame(pdf)
    trend = residual_trend(df, "x", bins=5).orderBy("bin").toPandas()
    cut = pd.qcut(pdf.x, 5, labels=False)
    assert trend.n.sum() == n and trend.q50.to_numpy() == pytest.approx(pdf.groupby(cut).residual.median(), rel=1e-9)
    smooth = residual_smooth(df, "x", "g", knots=5, points=30).toPandas()
    assert np.abs(smooth.fit - (0.5 + 0.3 * np.sin(smooth.x))).max() < 0.06
    cells = residual_by_cell(df, "g").toPandas().set_index("g")
    assert cells.middle["a"] == pytest.approx(pdf[pdf.g == "a"].residual.median(), rel=1e-12)
    qq = residual_qq(df, points=10).toPandas().sort_values("expected")
    assert qq.observed.to_numpy() == pytest.approx(np.quantile(pdf.residual, qq.expected), rel=1e-12)
    z = np.abs(pdf.residual - pdf.groupby("g").residual.transform("median"))
    a, b = z[pdf.g == "a"], z[pdf.g == "b"]
    f = (len(a) * (a.mean() - z.mean()) ** 2 + len(b) * (b.mean() - z.mean()) ** 2) / (
        (((a - a.mean()) ** 2).sum() + ((b - b.mean()) ** 2).sum()) / (n - 2))
    assert levene(df, "residual", "g").first()["f_statistic"] == pytest.approx(f, rel=1e-9)


def test_outlier_count_of_simulated_residuals(counts):
    df, _ = counts
    m = fit_glm(df, "pos", [], "poisson")                       # far too narrow
    r = residual_overall(sim_residuals(m, df, ["id"], mode="sim", n=100), sims=100).first()
    assert r["outliers"] > 3 * r["outliers_expected"] and r["dispersion"] > 1.5
    assert N.ks_tail(r["ks"], r["n"]) < 1e-6 and term_list(star("a", "b"))[-1] == ("a", "b")


def _counted(df, into):
    """The rows with a residual made in Python, which counts the rows it is made for."""
    @F.pandas_udf("double")
    def place(x: pd.Series) -> pd.Series:
        into.add(len(x))
        return (x * 0.6180339887498949) % 1
    return df.withColumn("residual", place("x"))


def test_cells_and_overall_make_each_residual_once(spark):
    df = spark.range(4000).select("id", (F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("x"))
    for read in (lambda d: residual_by_cell(d, "g"), residual_overall):
        made = spark.sparkContext.accumulator(0)
        table = read(_counted(df, made))
        assert table.count() and table.collect() and made.value == 4000


def test_persisted_long_residuals_are_not_made_again_in_joins(spark):
    wide = spark.range(1000).select("id", (F.col("id") % 3).alias("g"), *[(F.col("id") * 7 + k).cast("double").alias(f"x{k}") for k in range(4)])
    made = spark.sparkContext.accumulator(0)
    res = _counted(to_long(wide, ["id", "g"], [f"x{k}" for k in range(4)], "name", "x", index="wave"), made).persist()
    cells = residual_by_cell(res, ["g", "wave"]).collect()
    whole = residual_overall(res).first()
    boxes = box_stats(res, ["g", "wave"], "residual")[0].collect()
    assert made.value == 4000 and whole["n"] == 4000 and sum(r["n"] for r in cells) == 4000
    assert {(r["g"], r["wave"], r["middle"]) for r in cells} == {(r["g"], r["wave"], r["middle"]) for r in boxes}
    res.unpersist()


def test_distinct_cdf_places_every_row():
    class Shifted:
        def cdf(self, y, mu, dispersion, shape):
            asked.append(len(y))
            return y - mu * shape, y + mu * shape + dispersion
    asked = []
    y, mu, a = np.array([1.0, 2, 1, 3, 2, 1]), np.array([0.5, 0.5, 0.5, 7, 0.5, 8]), np.array([1.0, 1, 1, 2, 3, 1])
    low, high = residuals.distinct_cdf(Shifted(), y, mu, 0.25, a)
    assert asked == [5] and (low == y - mu * a).all() and (high == y + mu * a + 0.25).all()
    assert len(residuals.distinct_cdf(Shifted(), y[:0], mu[:0], 0.25, a[:0])[0]) == 0
