"""Terms, fits, tests and predictions."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import RFormula
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import functions as F

from wavepanel.operators.glm import ModelFrame, fit_glm, independent_columns
from wavepanel.operators.hypothesis import anova_ii, anova_seq, anova_wald, fit_and_test
from wavepanel.operators.predict import fit_curve, marginal_ci, predict_ci
from wavepanel.operators.terms import Design, poly, power, star, term_label, term_list

LV = {"year": list("12345"), "trat": list("abc"), "dom": ["d", "s"], "sp": ["p", "q"]}


def labels_and_df(terms, levels):
    d = Design(terms, levels)
    count = {}
    for c in d.columns:
        if c.term >= 0:
            count[term_label(terms[c.term])] = count.get(term_label(terms[c.term]), 0) + 1
    return list(count.items())


def test_term_order_and_df_match_published_tables():
    two = {k: LV[k] for k in ("trat", "dom")}
    surv = term_list(star("year", "trat"), star("alt0", "year"), star("alt0", "trat"), star("dom", "year"), star("dom", "trat"))
    # Labels, order and degrees of freedom of the published tables.
    assert labels_and_df(surv, two) == [
        ("year", 1), ("trat", 2), ("alt0", 1), ("dom", 1), ("year:trat", 2), ("year:alt0", 1), ("trat:alt0", 2),
        ("year:dom", 1), ("trat:dom", 2)]
    sq = poly("alt0", 2)
    height = term_list(star("year", "trat"), star("alt0", "year"), star("alt0", "trat"), star(sq, "year"), star(sq, "trat"),
                       star("dom", "year"), star("dom", "trat"))
    assert labels_and_df(height, {**two, "year": LV["year"]}) == [
        ("year", 4), ("trat", 2), ("alt0", 1), ("I(alt0^2)", 1), ("dom", 1), ("year:trat", 8), ("year:alt0", 4),
        ("trat:alt0", 2), ("year:I(alt0^2)", 4), ("trat:I(alt0^2)", 2), ("year:dom", 4), ("trat:dom", 2)]
    fruit = term_list(star("year", "trat"), star("alt0", "trat"), star("alt0", "year"), star("dom", "trat"), star("dom", "year"), "sp")
    assert [t for t, _ in labels_and_df(fruit, LV)] == ["year", "trat", "alt0", "dom", "sp", "year:trat", "trat:alt0", "year:alt0",
                                                       "trat:dom", "year:dom"]
    assert labels_and_df([("year",), ("trat",), ("alt0",), ("dom",)], {"year": ["5", "4", "3"], "trat": ["b", "c"], "dom": LV["dom"]}) == [
        ("year", 2), ("trat", 1), ("alt0", 1), ("dom", 1)]


def test_power_and_coding_rules():
    assert power(["a", "b", "c"], 3) == [("a",), ("b",), ("c",), ("a", "b"), ("a", "c"), ("b", "c"), ("a", "b", "c")]
    assert Design([("trat",)], LV, intercept=False).labels() == ["trata", "tratb", "tratc"]
    assert Design([("trat",), ("dom",)], LV, intercept=False).labels() == ["trata", "tratb", "tratc", "doms"]
    # without the numeric main effect every level gets its own slope
    assert Design([("trat",), ("trat", "x")], LV).labels()[-3:] == ["trata:x", "tratb:x", "tratc:x"]
    assert Design([("trat",), ("x",), ("trat", "x")], LV).labels()[-2:] == ["tratb:x", "tratc:x"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    n = 4000
    pdf = pd.DataFrame({"id": np.arange(n), "trat": rng.choice(list("abc"), n), "dom": rng.choice(["d", "s"], n),
                        "x": np.round(rng.uniform(100, 630, n), 1), "k": rng.integers(1, 6, n)})
    eta = 0.5 - 0.004 * (pdf.x - 300) + 0.4 * (pdf.trat == "b") - 0.3 * (pdf.dom == "s") + 0.2 * (pdf.trat == "c") * (pdf.k - 3)
    pdf["y"] = (rng.uniform(size=n) < 1 / (1 + np.exp(-eta))).astype(int)
    pdf["g"] = rng.gamma(3.0, np.exp(eta + 3) / 3)
    pdf["c"] = rng.poisson(np.exp(0.3 + eta / 2))
    pdf["z"] = 5 + 2 * eta + rng.normal(size=n)
    return spark.createDataFrame(pdf), pdf


TERMS = term_list(star("k", "trat"), star("x", "trat"), "dom", poly("x", 2))


def irls(x, y, family):
    """Reference fit in NumPy."""
    beta = np.zeros(x.shape[1])
    mu = {"binomial": (y + 0.5) / 2, "gamma": y, "poisson": y + 0.1, "gaussian": y}[family]
    eta = {"binomial": lambda m: np.log(m / (1 - m)), "gaussian": lambda m: m}.get(family, np.log)(mu)
    for _ in range(60):
        mu = {"binomial": lambda e: 1 / (1 + np.exp(-e)), "gaussian": lambda e: e}.get(family, np.exp)(eta)
        d = {"binomial": mu * (1 - mu), "gaussian": np.ones_like(mu)}.get(family, mu)
        v = {"binomial": mu * (1 - mu), "gamma": mu**2, "poisson": mu, "gaussian": np.ones_like(mu)}[family]
        w = d * d / v
        beta = np.linalg.solve(x.T @ (x * w[:, None]), x.T @ (w * (eta + (y - mu) / d)))
        eta = x @ beta
    mu = {"binomial": lambda e: 1 / (1 + np.exp(-e)), "gaussian": lambda e: e}.get(family, np.exp)(eta)
    with np.errstate(all="ignore"):
        dev = {"binomial": lambda: -2 * np.sum(y * np.log(mu) + (1 - y) * np.log(1 - mu)),
               "gamma": lambda: 2 * np.sum(-np.log(y / mu) + (y - mu) / mu),
               "poisson": lambda: 2 * np.sum(np.where(y > 0, y * np.log(y / mu), 0) - (y - mu)),
               "gaussian": lambda: np.sum((y - mu) ** 2)}[family]()
    return beta, dev, np.linalg.inv(x.T @ (x * w[:, None])), mu


def matrix(pdf, cols=None):
    b, c = (pdf.trat == "b").astype(float), (pdf.trat == "c").astype(float)
    x = np.column_stack([np.ones(len(pdf)), pdf.k, b, c, pdf.x, pdf.dom == "s", pdf.x**2, pdf.k * b, pdf.k * c, pdf.x * b, pdf.x * c]).astype(float)
    return x


@pytest.mark.parametrize("family,link,y", [("binomial", None, "y"), ("gamma", "log", "g"), ("poisson", None, "c"), ("gaussian", None, "z")])
@pytest.mark.parametrize("compress", [True, False])
def test_fit_matches_dense_irls(data, family, link, y, compress):
    df, pdf = data
    m = fit_glm(df, y, TERMS, family, link, compress=compress)
    x = matrix(pdf)
    # condition the reference fit, then map back
    shift = x.mean(axis=0) * (np.arange(x.shape[1]) > 0)
    scale = np.where(np.arange(x.shape[1]) > 0, x.std(axis=0), 1)
    beta, dev, inv, mu = irls((x - shift) / scale, pdf[y].to_numpy(float), family)
    want = beta / scale
    want[0] -= (beta * shift / scale).sum()
    assert m.converged and m.rank == 11
    assert m.labels == ["(Intercept)", "k", "tratb", "tratc", "x", "doms", "I(x^2)", "k:tratb", "k:tratc", "tratb:x", "tratc:x"]
    assert m.beta == pytest.approx(want, rel=1e-5, abs=1e-9)
    assert m.deviance == pytest.approx(dev, rel=1e-9)
    se = np.sqrt(np.diag(inv) * m.dispersion) / scale
    assert np.sqrt(np.diag(m.cov))[1:] == pytest.approx(se[1:], rel=1e-5)
    scored = m.with_mean(df).toPandas().sort_values("id")
    assert scored.fitted.to_numpy() == pytest.approx(mu, rel=1e-6)


def test_deviance_agrees_with_spark_ml(data):
    df, _ = data
    ours = fit_glm(df, "g", [("x",), ("trat",), ("dom",)], "gamma", "log")
    feats = RFormula(formula="g ~ x + trat + dom").fit(df).transform(df)
    theirs = GeneralizedLinearRegression(family="gamma", link="log", tol=1e-10).fit(feats).summary
    assert ours.deviance == pytest.approx(theirs.deviance, rel=1e-9)
    assert ours.null_deviance == pytest.approx(theirs.nullDeviance, rel=1e-9)
    assert ours.aic == pytest.approx(theirs.aic, rel=1e-6)


def test_same_answer_on_any_partitioning(data):
    df, _ = data
    base = fit_glm(df, "y", TERMS, "binomial")
    for parts in (1, 4, 16):
        other = fit_glm(df.repartition(parts, F.rand(parts)), "y", TERMS, "binomial")
        assert other.beta == pytest.approx(base.beta, rel=1e-8, abs=1e-12)
        assert other.deviance == pytest.approx(base.deviance, rel=1e-12)


def test_type_ii_table_equals_separate_fits(data):
    df, _ = data
    terms = term_list(star("trat", "dom"), "x", star("k", "trat"))
    model, table = fit_and_test(df, "g", terms, "gamma", "log")
    rows = {r["term"]: r for r in table.collect()}
    assert list(rows) == ["trat", "dom", "x", "k", "trat:dom", "trat:k"]

    def dev(keep):
        return fit_glm(df, "g", keep, "gamma", "log").deviance
    for t in terms:
        rest = [u for u in terms if not set(t) <= set(u)]
        lr = (dev(rest) - dev([*rest, t])) / model.dispersion
        got = rows[term_label(t)]
        assert got["lr_chisq"] == pytest.approx(lr, rel=1e-6, abs=1e-6)
    assert [rows[t]["df"] for t in rows] == [2, 1, 1, 1, 2, 2]


def test_lm_f_and_r_squared(data):
    df, pdf = data
    model, table = fit_and_test(df, "z", [("x",)])
    s = model.stats(df.sparkSession).first()
    slope, icpt = np.polyfit(pdf.x, pdf.z, 1)
    assert model.coef["x"] == pytest.approx(slope, rel=1e-8)
    rss = ((pdf.z - icpt - slope * pdf.x) ** 2).sum()
    r2 = 1 - rss / ((pdf.z - pdf.z.mean()) ** 2).sum()
    assert s["r_squared"] == pytest.approx(r2, rel=1e-9)
    f = r2 / (1 - r2) * (len(pdf) - 2)
    assert table.first()["f_statistic"] == pytest.approx(f, rel=1e-8)
    assert s["f_statistic"] == pytest.approx(f, rel=1e-8)


def test_sequential_deviance_adds_up(data):
    df, _ = data
    rows = anova_seq(df, "y", [("trat",), ("x",), ("trat", "x")], "binomial").orderBy("position").collect()
    assert [r["term"] for r in rows] == ["NULL", "trat", "x", "trat:x"]
    assert rows[0]["resid_deviance"] - sum(r["deviance"] for r in rows[1:]) == pytest.approx(rows[-1]["resid_deviance"])


def test_wald_of_term_with_relatives(data):
    df, _ = data
    m = fit_glm(df, "y", term_list(star("trat", "dom")), "binomial")
    got = {r["term"]: r for r in anova_wald(df.sparkSession, m).collect()}
    b, v = np.array([m.coef[c] for c in m.labels]), m.cov
    inter = [i for i, c in enumerate(m.labels) if ":" in c]
    w = b[inter] @ np.linalg.solve(v[np.ix_(inter, inter)], b[inter])
    assert got["trat:dom"]["chisq"] == pytest.approx(w, rel=1e-9) and got["trat:dom"]["df"] == 2
    # conjugate complement of the interaction inside {trat, trat:dom}
    idx = [i for i, c in enumerate(m.labels) if c.startswith("trat")]
    big = b[idx] @ np.linalg.solve(v[np.ix_(idx, idx)], b[idx])
    assert got["trat"]["chisq"] == pytest.approx(big - w, rel=1e-9) and got["trat"]["df"] == 2


def test_missing_rows_and_unlisted_levels_are_dropped(spark, data):
    df, pdf = data
    holes = df.withColumn("x", F.when(F.col("id") % 7 != 0, F.col("x"))).withColumn("dom", F.when(F.col("id") % 11 != 0, F.col("dom")))
    m = fit_glm(holes, "y", [("x",), ("dom",), ("trat",)], "binomial", levels={"trat": ["a", "b"]})
    keep = (pdf.id % 7 != 0) & (pdf.id % 11 != 0) & pdf.trat.isin(["a", "b"])
    assert m.n == keep.sum() and m.labels == ["(Intercept)", "x", "doms", "tratb"]
    assert m.with_mean(holes).where("fitted is null").count() == len(pdf) - keep.sum()
    # the reference level is the first one listed
    assert "trata" in fit_glm(df, "y", [("trat",)], "binomial", levels={"trat": ["c", "a", "b"]}).labels


def test_empty_cell_is_reported_as_aliased(data):
    df, _ = data
    hole = df.where("not (trat = 'c' and dom = 's')")
    m = fit_glm(hole, "z", term_list(star("trat", "dom")))
    assert m.aliased == ["tratc:doms"] and m.rank == 5 and "rank deficient" in m.warnings[0]
    null = m.coef_table(df.sparkSession).where("estimate is null").collect()
    assert [r["term"] for r in null] == ["tratc:doms"]
    table = anova_ii(hole, "z", term_list(star("trat", "dom"))).where("term = 'trat:dom'").first()
    assert table["df"] == 1
    assert independent_columns(np.array([[1.0, 2.0], [2.0, 4.0]])) == [0]


def test_separation_is_flagged_not_patched(spark):
    df = spark.createDataFrame([("a", 0)] * 30 + [("b", 0)] * 10 + [("b", 1)] * 10, "g string, y int")
    m = fit_glm(df, "y", [("g",)], "binomial", levels={"g": ["b", "a"]})
    assert any("separation" in w or "converge" in w for w in m.warnings)
    assert math.sqrt(m.cov[1, 1]) > 100


@pytest.mark.parametrize("family,bad", [("binomial", 37.0), ("gamma", 0.0), ("poisson", -1.0)])
def test_response_domain_is_checked(spark, family, bad):
    df = spark.createDataFrame([("a", 1.0), ("b", bad), ("a", 1.0)], "g string, y double")
    for terms in ([("g",)], []):
        with pytest.raises(ValueError, match="outside the range"):
            fit_glm(df, "y", terms, family)
    with pytest.raises(ValueError, match="no complete rows"):
        fit_glm(df.where("g = 'zzz'"), "y", [], "gaussian")
    with pytest.raises(ValueError, match="not in the table"):
        fit_glm(df, "y", [("nope",)], "gaussian")


def test_factor_models_are_compressed(data):
    df, _ = data
    with ModelFrame(df, "y", term_list(star("trat", "dom")), "binomial") as frame:
        assert frame.compressed and frame.data.count() == 6 and frame.data.rdd.getNumPartitions() == 1
        frame.fit()


def test_predict_interval_on_cells(data):
    df, pdf = data
    m = fit_glm(df, "y", [("trat",)], "binomial")
    out = {r["trat"]: r for r in predict_ci(m, df.select("trat").distinct(), keep_se=True).collect()}
    for t in "abc":
        y = pdf[pdf.trat == t].y
        p, se = y.mean(), math.sqrt(1 / y.sum() + 1 / (len(y) - y.sum()))
        lo = math.log(p / (1 - p)) - 1.959963984540054 * se
        assert out[t]["p_mle"] == pytest.approx(p, rel=1e-8)
        assert out[t]["se"] == pytest.approx(se, rel=1e-6)
        assert out[t]["p_lower"] == pytest.approx(1 / (1 + math.exp(-lo)), rel=1e-6)


def test_marginal_interval_agrees_with_delta_method(spark, data):
    df, pdf = data
    m = fit_glm(df, "y", term_list("x", star("trat", "dom")), "binomial")
    grid = spark.createDataFrame([(x, t, d) for x, t, d in itertools.product([150.0, 400.0], "abc", "ds")], "x double, trat string, dom string")
    w = spark.createDataFrame([(t, d, s) for t, a in zip("abc", (0.2, 0.5, 0.9)) for d, s in (("d", a), ("s", 1 - a))],
                              "trat string, dom string, share double")
    got = marginal_ci(m, grid, "dom", ["x", "trat"], w, ["trat"], draws=30_000, seed=3).toPandas()
    again = marginal_ci(m, grid.repartition(7), "dom", ["x", "trat"], w, ["trat"], draws=30_000, seed=3).toPandas()
    keys = ["x", "trat"]
    got, again = got.sort_values(keys).reset_index(drop=True), again.sort_values(keys).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, again, rtol=1e-9)
    design = m.design
    for _, r in got.iterrows():
        share = {"a": 0.2, "b": 0.5, "c": 0.9}[r.trat]
        p, grad = 0.0, np.zeros(m.rank)
        for d, s in (("d", share), ("s", 1 - share)):
            row = pd.DataFrame({"__f0": [list("abc").index(r.trat)], "__f1": ["ds".index(d)], "__x0": [r.x]})
            x = design.matrix(row, scaled=False)[0]
            q = 1 / (1 + math.exp(-x @ m.beta))
            p += s * q
            grad += s * q * (1 - q) * x
        se = math.sqrt(grad @ m.cov @ grad)
        assert r.p_mle == pytest.approx(p, rel=1e-8)
        # the draws are nearly normal on the logit scale, not on the probability scale
        lo, hi = (1 / (1 + math.exp(-(math.log(p / (1 - p)) + s * 1.96 * se / (p * (1 - p))))) for s in (-1, 1))
        assert r.p_lower == pytest.approx(lo, abs=0.06 * se)
        assert r.p_upper == pytest.approx(hi, abs=0.06 * se)


def test_group_curves_cover_their_own_range(data):
    df, pdf = data
    part = df.where("trat <> 'c' or x < 300")
    out = fit_curve(part, "x", "g", "trat", n=5).toPandas()
    own = pdf[(pdf.trat != "c") | (pdf.x < 300)].groupby("trat").x.agg(["min", "max"])
    for t, grp in out.groupby("trat"):
        assert [grp.x.min(), grp.x.max()] == pytest.approx(list(own.loc[t]))
    assert (out.p_lower < out.p_mle).all() and (out.p_mle < out.p_upper).all()


def test_fit_from_a_checkpoint_folder(spark, data, tmp_path):
    df, _ = data
    want = fit_glm(df, "y", term_list(star("trat", "dom")), "binomial")
    # only here, because the test session names no folder of its own
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    got = fit_glm(df, "y", term_list(star("trat", "dom")), "binomial")
    assert got.beta == pytest.approx(want.beta, rel=1e-12)
    assert any(tmp_path.rglob("part-*"))
