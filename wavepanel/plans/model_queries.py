"""Model fits, tests, predictions and diagnostics on the driver tables."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from wavepanel.functions.numeric import normal_quantile
from wavepanel.operators import joins, summaries
from wavepanel.operators.absorb import fit_absorbed
from wavepanel.operators.counts import (anova_negbin, count_log_likelihood, fit_hurdle, fit_negbin, fit_ztnb)
from wavepanel.operators.extended import fit_gamma_ls, fit_glmm_ri, glmm_log_likelihood, mixture_residuals
from wavepanel.operators.glm import fit_glm
from wavepanel.operators.hypothesis import anova_ii, anova_seq, anova_wald
from wavepanel.operators.predict import fit_curve, marginal_ci, predict_ci
from wavepanel.operators.residuals import (dispersion_test, levene, residual_by_cell, residual_overall, residual_qq, residual_smooth,
                                           residual_trend, sim_residuals, simulate, uniform_ks)
from wavepanel.operators.terms import design, poly, power, star, term_list
from wavepanel.plans.panels import LINES_SQL, lines
from wavepanel.plans.registry import SEED, query, r, round_all
from wavepanel.plans.sql_models import (glm_cte, glm_deviance, negbin_log_density, newton_cte, newton_deviance, pivot_sql,
                                        stencil_newton_1d, stencil_newton_2d, term_columns, type_ii_sql, wald_sql, ztnb_cte)

FLAG, STATUS = "l_returnflag", "l_linestatus"
CELL_TERMS = term_list(star(FLAG, STATUS))
Z = repr(normal_quantile(0.975))
ROW_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]

# Six cells of flag x status with the contrasts against (A, F), as SQL.
_BIN_CELLS = (f"{LINES_SQL}, c AS (SELECT {FLAG} AS f, {STATUS} AS g, count(*)::DOUBLE AS n, sum(big)::DOUBLE AS s, "
              f"ln(avg(big) / (1 - avg(big))) AS l, 1 / sum(big) + 1 / (count(*) - sum(big)) AS v FROM lines GROUP BY ALL)")
_GAMMA_CELLS = (f"{LINES_SQL}, c AS (SELECT {FLAG} AS f, {STATUS} AS g, count(*)::DOUBLE AS n, sum(l_extendedprice) AS s, "
                f"sum(ln(l_extendedprice)) AS ln, ln(avg(l_extendedprice)) AS l, "
                f"var_pop(l_extendedprice) / pow(avg(l_extendedprice), 2) * count(*) AS pearson FROM lines GROUP BY ALL), "
                f"phi AS (SELECT sum(pearson) / (sum(n) - 6) AS phi FROM c)")


def _cell(f, g, what):
    return f"(SELECT {what} FROM c WHERE f = '{f}' AND g = '{g}')"


def _contrast_rows(scale="1"):
    rows = [("(Intercept)", [("A", "F", 1)])]
    rows += [(f"{FLAG}{f}", [(f, "F", 1), ("A", "F", -1)]) for f in "NR"]
    rows += [(f"{STATUS}O", [("A", "O", 1), ("A", "F", -1)])]
    rows += [(f"{FLAG}{f}:{STATUS}O", [(f, "O", 1), (f, "F", -1), ("A", "O", -1), ("A", "F", 1)]) for f in "NR"]
    out = []
    for label, parts in rows:
        est = " + ".join(f"{w} * {_cell(f, g, 'l')}" for f, g, w in parts)
        var = " + ".join(_cell(f, g, "v") for f, g, w in parts)
        out.append((label, f"({est})", f"sqrt({scale} * ({var}))"))
    return out


def _coef_sql(head, scale="1"):
    return f"{head} " + " UNION ALL ".join(
        f"SELECT '{label}' AS term, {r(est)} AS estimate, {r(se)} AS std_error, {r(f'{est} / {se}', 4)} AS statistic"
        for label, est, se in _contrast_rows(scale))


def _coef(model, spark):
    return round_all(model.coef_table(spark).select("term", "estimate", "std_error", "statistic"), statistic=4)


# ---------------------------------------------------------------- fits

@query("logit_fit", _coef_sql(f"WITH {_BIN_CELLS}"))
def logit_fit(spark, sf):
    return _coef(fit_glm(lines(spark, sf), "big", CELL_TERMS, "binomial"), spark)


@query("gamma_fit", _coef_sql(f"WITH {_GAMMA_CELLS.replace('AS pearson FROM', 'AS pearson, 1.0 / count(*) AS v FROM')}", "(SELECT phi FROM phi)"))
def gamma_fit(spark, sf):
    return _coef(fit_glm(lines(spark, sf), "l_extendedprice", CELL_TERMS, "gamma", "log"), spark)


def _means_sql(label, response, g, vg):
    """One-factor model in any link: differences of the linked means; vg = dispersion * variance * slope^2 / n."""
    return (f"SELECT '{label}' AS model, '(Intercept)' AS term, {r(f'min(CASE WHEN f = 0 THEN {g} END)', 9)} AS estimate, "
            f"{r(f'sqrt(min(CASE WHEN f = 0 THEN {vg} END))', 9)} AS std_error FROM m "
            + " ".join(f"UNION ALL SELECT '{label}', '{FLAG}{name}', {r(f'min(CASE WHEN f = {i} THEN {g} END) - min(CASE WHEN f = 0 THEN {g} END)', 9)}, "
                       f"{r(f'sqrt(min(CASE WHEN f = 0 THEN {vg} END) + min(CASE WHEN f = {i} THEN {vg} END))', 9)} FROM m"
                       for i, name in ((1, "N"), (2, "R"))))


_FLAG_MEANS = ("m AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS f, count(*)::DOUBLE AS n, avg(l_quantity) AS mu, "
               "var_pop(l_quantity) * count(*) AS ss FROM lineitem GROUP BY 1)")


@query("poisson_fit", f"WITH {_FLAG_MEANS} {_means_sql('poisson', 'l_quantity', 'ln(mu)', '1 / (n * mu)')}")
def poisson_fit(spark, sf):
    m = fit_glm(lines(spark, sf), "l_quantity", [(FLAG,)], "poisson")
    return round_all(m.coef_table(spark).select(F.lit("poisson").alias("model"), "term", "estimate", "std_error"), 9)


_PHI = "(SELECT sum(ss / ({v})) / (sum(n) - 3) FROM m)"


@query("other_families", f"WITH {_FLAG_MEANS} " + " UNION ALL ".join(
    _means_sql(name, "l_quantity", g, f"{_PHI.format(v=v)} * ({v}) * ({slope}) / n")
    for name, g, v, slope in (("gamma inverse", "1 / mu", "mu * mu", "pow(mu, -4)"),
                              ("inverse_gaussian 1/mu^2", "pow(mu, -2)", "pow(mu, 3)", "4 * pow(mu, -6)"),
                              ("quasi identity", "mu", "1", "1"),
                              ("quasipoisson log", "ln(mu)", "mu", "pow(mu, -2)"))))
def other_families(spark, sf):
    out = {}
    for name, link in (("gamma", "inverse"), ("inverse_gaussian", "1/mu^2"), ("quasi", "identity"), ("quasipoisson", "log")):
        m = fit_glm(lines(spark, sf), "l_quantity", [(FLAG,)], name, link)
        out[f"{name} {link}"] = m.coef_table(spark).select("term", "estimate", "std_error")
    return round_all(joins.union_labelled(out, "model"), 9)


@query("quasibinomial_fit", f"""WITH {_BIN_CELLS}, q AS (SELECT sum(n * 1.0) / (sum(n) - 6) AS phi FROM c)
SELECT f || g AS cell, {r('l', 6)} AS eta, {r('sqrt(v * (SELECT phi FROM q))')} AS se FROM c""")
def quasibinomial_fit(spark, sf):
    df = lines(spark, sf)
    m = fit_glm(df, "big", CELL_TERMS, "quasibinomial")
    cells = predict_ci(m, df.select(FLAG, STATUS).distinct(), keep_se=True)
    return round_all(cells.select(F.concat(FLAG, STATUS).alias("cell"), F.col("fit").alias("eta"), "se"))


_LM = """d AS (SELECT l_extendedprice AS y, l_quantity AS x FROM lineitem),
t AS (SELECT count(*)::DOUBLE AS n, avg(x) AS mx, var_pop(x) * count(*) AS sxx, regr_slope(y, x) AS b, regr_intercept(y, x) AS a,
  var_pop(y) * count(*) AS syy, regr_r2(y, x) AS r2 FROM d), e AS (SELECT *, syy * (1 - r2) / (n - 2) AS s2, syy * (1 - r2) AS rss FROM t)"""


@query("lm_fit", f"""WITH {_LM} SELECT '(Intercept)' AS term, {r('a')} AS estimate, {r('sqrt(s2 * (1 / n + mx * mx / sxx))')} AS std_error, {r('a / sqrt(s2 * (1 / n + mx * mx / sxx))', 4)} AS statistic FROM e
UNION ALL SELECT 'l_quantity', {r('b')}, {r('sqrt(s2 / sxx)')}, {r('b / sqrt(s2 / sxx)', 4)} FROM e""")
def lm_fit(spark, sf):
    return _coef(fit_glm(lines(spark, sf), "l_extendedprice", [("l_quantity",)]), spark)


@query("lm_anova", f"WITH {_LM} SELECT 'l_quantity' AS term, {r('b * b * sxx / s2', 6)} AS f_statistic, 1 AS df FROM e")
def lm_anova(spark, sf):
    return round_all(anova_ii(lines(spark, sf), "l_extendedprice", [("l_quantity",)]).select("term", "f_statistic", "df"))


@query("lm_stats", f"""WITH {_LM} SELECT n::BIGINT AS n, (n - 2)::BIGINT AS df_resid, {r('rss / 1e9')} AS deviance_e9, {r('s2 / 1e6')} AS dispersion_e6, {r('r2', 9)} AS r_squared,
{r('b * b * sxx / s2')} AS f_statistic, {r('n * (ln(2 * pi() * rss / n) + 1) + 6', 3)} AS aic FROM e""")
def lm_stats(spark, sf):
    s = fit_glm(lines(spark, sf), "l_extendedprice", [("l_quantity",)]).stats(spark)
    return round_all(s.select("n", "df_resid", (F.col("deviance") / 1e9).alias("deviance_e9"), (F.col("dispersion") / 1e6).alias("dispersion_e6"),
                              "r_squared", "f_statistic", "aic"), r_squared=9, aic=3)


_LOGIT_SLOPE = glm_cte("m", "d", ["1", "x"], "binomial", sweeps=250)


@query("logit_slope", f"""WITH RECURSIVE {LINES_SQL}, a AS (SELECT avg(l_quantity) AS mid FROM lines),
d AS (SELECT l_quantity - mid AS x, count(*)::DOUBLE AS n, sum(big)::DOUBLE AS s FROM lines, a GROUP BY 1), {_LOGIT_SLOPE},
h AS (SELECT sum(n * p * (1 - p)) AS h0, sum(n * p * (1 - p) * x) AS h1, sum(n * p * (1 - p) * x * x) AS h2 FROM
  (SELECT *, 1 / (1 + exp(-(b0 + b1 * x))) AS p FROM m, d))
SELECT '(Intercept)' AS term, {r('b0 - b1 * mid')} AS estimate, {r('sqrt((h2 + 2 * mid * h1 + mid * mid * h0) / (h0 * h2 - h1 * h1))')} AS std_error FROM m, h, a
UNION ALL SELECT 'l_quantity', {r('b1')}, {r('sqrt(h0 / (h0 * h2 - h1 * h1))')} FROM m, h""")
def logit_slope(spark, sf):
    return round_all(fit_glm(lines(spark, sf), "big", [("l_quantity",)], "binomial").coef_table(spark).select("term", "estimate", "std_error"))


@query("fit_stats", f"""WITH {_BIN_CELLS}, t AS (SELECT sum(n) AS n, sum(s) AS s, -2 * sum(s * ln(s / n) + (n - s) * ln(1 - s / n)) AS dev FROM c)
SELECT n::BIGINT AS n, 6 AS rank, {r('-2 * (s * ln(s / n) + (n - s) * ln(1 - s / n))', 4)} AS null_deviance, (n - 1)::BIGINT AS df_null, {r('dev', 4)} AS deviance,
(n - 6)::BIGINT AS df_resid, {r('dev + 12', 4)} AS aic FROM t""")
def fit_stats(spark, sf):
    s = fit_glm(lines(spark, sf), "big", CELL_TERMS, "binomial").stats(spark)
    return round_all(s.select("n", "rank", "null_deviance", "df_null", "deviance", "df_resid", "aic"), 4)


_COUNT_CELLS = (f"{LINES_SQL}, c AS (SELECT excess AS y, avg(excess) OVER (PARTITION BY l_returnflag, l_linestatus) AS mu, "
                "avg(excess) OVER () AS m FROM lines), k AS (SELECT count(*) AS n FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lines))")
_STATS = ["n", "rank", "null_deviance", "deviance", "aic"]


@query("poisson_stats", f"""WITH {_COUNT_CELLS} SELECT count(*) AS n, any_value(k.n)::INTEGER AS rank,
{r('2 * sum(CASE WHEN y > 0 THEN y * ln(y / m) ELSE 0 END)', 3)} AS null_deviance, {r('2 * sum(CASE WHEN y > 0 THEN y * ln(y / mu) ELSE 0 END)', 3)} AS deviance,
{r('-2 * sum(y * ln(mu) - mu - lgamma(y + 1)) + 2 * any_value(k.n)', 3)} AS aic FROM c, k""")
def poisson_stats(spark, sf):
    return round_all(fit_glm(lines(spark, sf), "excess", CELL_TERMS, "poisson").stats(spark).select(*_STATS), 3)


_NB_DEV = "2 * sum(CASE WHEN y > 0 THEN y * ln(y / {0}) ELSE 0 END - (y + 2) * ln((y + 2) / ({0} + 2)))"


@query("negbin_stats", f"""WITH {_COUNT_CELLS} SELECT count(*) AS n, any_value(k.n)::INTEGER AS rank,
{r(_NB_DEV.format('m'), 3)} AS null_deviance, {r(_NB_DEV.format('mu'), 3)} AS deviance,
{r('-2 * sum(lgamma(y + 2) - lgamma(y + 1) + 2 * ln(2) + y * ln(mu) - (y + 2) * ln(mu + 2)) + 2 * any_value(k.n)', 3)} AS aic FROM c, k""")
def negbin_stats(spark, sf):
    return round_all(fit_glm(lines(spark, sf), "excess", CELL_TERMS, "negbin", theta=2.0).stats(spark).select(*_STATS), 3)


@query("inverse_gaussian_stats", f"""WITH {LINES_SQL}, c AS (SELECT l_extendedprice / 1000 AS y, avg(l_extendedprice / 1000) OVER (PARTITION BY l_returnflag) AS mu,
avg(l_extendedprice / 1000) OVER () AS m FROM lines), d AS (SELECT count(*)::DOUBLE AS n, sum((y - m) * (y - m) / (m * m * y)) AS d0, sum((y - mu) * (y - mu) / (mu * mu * y)) AS d1,
sum(ln(y)) AS ln FROM c)
SELECT n::BIGINT AS n, 3::INTEGER AS rank, {r('d0', 3)} AS null_deviance, {r('d1', 3)} AS deviance, {r('n * (ln(2 * pi() * d1 / n) + 1) + 3 * ln + 8', 2)} AS aic FROM d""")
def inverse_gaussian_stats(spark, sf):
    df = lines(spark, sf).withColumn("price", F.col("l_extendedprice") / 1000)
    return round_all(fit_glm(df, "price", [(FLAG,)], "inverse_gaussian", "log").stats(spark).select(*_STATS), 3, aic=2)


@query("predict_ci_inverse", f"""WITH {LINES_SQL}, c AS (SELECT l_returnflag, l_extendedprice / 1000 AS y, avg(l_extendedprice / 1000) OVER (PARTITION BY l_returnflag) AS mu FROM lines),
f AS (SELECT sum((y - mu) * (y - mu) / (mu * mu)) / (count(*) - 3) AS phi FROM c),
g AS (SELECT l_returnflag, any_value(mu) AS mu, sqrt(any_value(phi) / (count(*) * any_value(mu) * any_value(mu))) AS se FROM c, f GROUP BY 1)
SELECT l_returnflag, {r('mu')} AS p_mle, {r(f'1 / (1 / mu + {Z} * se)')} AS p_lower, {r(f'1 / (1 / mu - {Z} * se)')} AS p_upper FROM g""")
def predict_ci_inverse(spark, sf):
    df = lines(spark, sf).withColumn("price", F.col("l_extendedprice") / 1000)
    model = fit_glm(df, "price", [(FLAG,)], "gamma", "inverse")
    return round_all(predict_ci(model, df.select(FLAG).distinct()).select(FLAG, "p_mle", "p_lower", "p_upper"))


@query("vcov_corr", """WITH m AS (SELECT l_returnflag AS f, 1 / sum((l_discount > 0.05)::INTEGER) + 1 / sum((l_discount <= 0.05)::INTEGER) AS v FROM lineitem GROUP BY 1),
w AS (SELECT max(CASE f WHEN 'A' THEN v END) AS a, max(CASE f WHEN 'N' THEN v END) AS n, max(CASE f WHEN 'R' THEN v END) AS q FROM m),
k AS (SELECT unnest(['(Intercept)', 'l_returnflagN', 'l_returnflagR']) AS t, unnest([a, a + n, a + q]) AS d FROM w)
SELECT x.t AS term_a, y.t AS term_b, """ + r("CASE WHEN x.t = y.t THEN x.d WHEN x.t = '(Intercept)' OR y.t = '(Intercept)' THEN -a ELSE a END", 9) + " AS covariance, "
       + r("CASE WHEN x.t = y.t THEN x.d WHEN x.t = '(Intercept)' OR y.t = '(Intercept)' THEN -a ELSE a END / sqrt(x.d * y.d)") + " AS correlation FROM k x, k y, w")
def vcov_corr(spark, sf):
    m = fit_glm(lines(spark, sf), "big", [(FLAG,)], "binomial")
    return round_all(m.vcov(spark).join(m.corr(spark), ["term_a", "term_b"]), covariance=9)


@query("design_matrix", f"""WITH {LINES_SQL} SELECT l_orderkey, l_quantity, 1.0::DOUBLE AS m0, (l_returnflag = 'N')::INTEGER::DOUBLE AS m1, (l_returnflag = 'R')::INTEGER::DOUBLE AS m2,
l_quantity AS m3, l_quantity * l_quantity AS m4, l_quantity * (l_returnflag = 'N')::INTEGER AS m5, l_quantity * (l_returnflag = 'R')::INTEGER AS m6 FROM lines""")
def design_matrix(spark, sf):
    terms = term_list(FLAG, "l_quantity", poly("l_quantity", 2), (FLAG, "l_quantity"))
    df, _ = design(lines(spark, sf), terms, {FLAG: ["A", "N", "R"]}, keep=["l_orderkey", "l_quantity"])
    return df


# ---------------------------------------------------------------- tests

_ADD = ["1", "(f = 'N')::INTEGER", "(f = 'R')::INTEGER", "(g = 'O')::INTEGER"]
_F_ONLY, _G_ONLY = _ADD[:3], [_ADD[0], _ADD[3]]


def _anova_sql(cells, family, scale="1"):
    """Type-II table of the two-way model from additive, one-factor and saturated fits in SQL."""
    ctes = ", ".join([glm_cte("madd", "c", _ADD, family), glm_cte("mf", "c", _F_ONLY, family), glm_cte("mg", "c", _G_ONLY, family)])
    dev = {k: glm_deviance(k, "c", cols, family) for k, cols in (("madd", _ADD), ("mf", _F_ONLY), ("mg", _G_ONLY))}
    full = ("(SELECT -2 * sum(s * ln(s / n) + (n - s) * ln(1 - s / n)) FROM c)" if family == "binomial"
            else "(SELECT 2 * sum(n * l - ln) FROM c)")
    lr = [(FLAG, f"({dev['mg']} - {dev['madd']}) / {scale}", 2), (STATUS, f"({dev['mf']} - {dev['madd']}) / {scale}", 1),
          (f"{FLAG}:{STATUS}", f"({dev['madd']} - {full}) / {scale}", 2)]
    return f"WITH RECURSIVE {cells}, {ctes} " + " UNION ALL ".join(
        f"SELECT '{t}' AS term, {r(x, 5)} AS lr_chisq, {d} AS df, {r(f'exp(-({x}) / 2)', 5) if d == 2 else 'NULL::DOUBLE'} AS p_two_df" for t, x, d in lr)


def _anova(table):
    return round_all(table.select("term", "lr_chisq", "df", F.when(F.col("df") == 2, F.col("p_value")).alias("p_two_df")), 5)


@query("logit_anova", _anova_sql(_BIN_CELLS, "binomial"))
def logit_anova(spark, sf):
    return _anova(anova_ii(lines(spark, sf), "big", CELL_TERMS, "binomial"))


@query("gamma_anova", _anova_sql(_GAMMA_CELLS, "gamma", "(SELECT phi FROM phi)"))
def gamma_anova(spark, sf):
    return _anova(anova_ii(lines(spark, sf), "l_extendedprice", CELL_TERMS, "gamma", "log"))


_DEV_ADD = glm_deviance("madd", "c", _ADD, "binomial")


@query("anova_seq", f"""WITH RECURSIVE {_BIN_CELLS}, {glm_cte("madd", "c", _ADD, "binomial")},
t AS (SELECT sum(n) AS n, -2 * (sum(s) * ln(sum(s) / sum(n)) + sum(n - s) * ln(sum(n - s) / sum(n))) AS d0 FROM c),
u AS (SELECT -2 * sum(s * ln(s / n) + (n - s) * ln(1 - s / n)) AS d1 FROM (SELECT f, sum(n) AS n, sum(s) AS s FROM c GROUP BY f)),
v AS (SELECT -2 * sum(s * ln(s / n) + (n - s) * ln(1 - s / n)) AS d3 FROM c), w AS (SELECT {_DEV_ADD} AS d2)
SELECT 0 AS position, 'NULL' AS term, NULL::INTEGER AS df, NULL::DOUBLE AS deviance, (n - 1)::BIGINT AS resid_df, {r('d0', 4)} AS resid_deviance FROM t
UNION ALL SELECT 1, '{FLAG}', 2, {r('d0 - d1', 5)}, (n - 3)::BIGINT, {r('d1', 4)} FROM t, u
UNION ALL SELECT 2, '{STATUS}', 1, {r('d1 - d2', 5)}, (n - 4)::BIGINT, {r('d2', 4)} FROM t, u, w
UNION ALL SELECT 3, '{FLAG}:{STATUS}', 2, {r('d2 - d3', 5)}, (n - 6)::BIGINT, {r('d3', 4)} FROM t, v, w""")
def anova_seq_query(spark, sf):
    return round_all(anova_seq(lines(spark, sf), "big", CELL_TERMS, "binomial").drop("p_value"), 4, deviance=5)


@query("anova_wald", f"""WITH {_BIN_CELLS}, m AS (SELECT f, ln(sum(s) / (sum(n) - sum(s))) AS l, 1 / sum(s) + 1 / (sum(n) - sum(s)) AS v FROM c GROUP BY f),
w AS (SELECT max(CASE f WHEN 'N' THEN l END) - max(CASE f WHEN 'A' THEN l END) AS b1, max(CASE f WHEN 'R' THEN l END) - max(CASE f WHEN 'A' THEN l END) AS b2,
  max(CASE f WHEN 'A' THEN v END) AS a, max(CASE f WHEN 'N' THEN v END) AS n, max(CASE f WHEN 'R' THEN v END) AS q FROM m),
x AS (SELECT (b1 * b1 * (a + q) - 2 * a * b1 * b2 + b2 * b2 * (a + n)) / ((a + n) * (a + q) - a * a) AS chisq FROM w)
SELECT '{FLAG}' AS term, 2 AS df, {r('chisq')} AS chisq, {r('exp(-chisq / 2)')} AS p_value FROM x""")
def anova_wald_query(spark, sf):
    m = fit_glm(lines(spark, sf), "big", [(FLAG,)], "binomial")
    return round_all(anova_wald(spark, m).drop("position"))


# A wide Type-II table: many nested models in one set of passes.
WIDE_TERMS = term_list(star("yr", FLAG), star("tax", "yr"), star("tax", FLAG), star(STATUS, "yr"), star(STATUS, FLAG))


LINE_LEVELS = {"yr": [str(y) for y in range(1995, 2002)], FLAG: ["A", "N", "R"], STATUS: ["F", "O"]}
_LINE_SRC = (f"{LINES_SQL}, src AS (SELECT yr, {FLAG}, {STATUS}, tax - 4 AS t, count(*)::DOUBLE AS n, sum(big)::DOUBLE AS s "
             f"FROM lines GROUP BY ALL)")


@query("anova_wide_logit", type_ii_sql(_LINE_SRC, "src", WIDE_TERMS, LINE_LEVELS, {"tax": "t"}, "binomial", steps=6))
def anova_wide_logit(spark, sf):
    return round_all(anova_ii(lines(spark, sf), "big", WIDE_TERMS, "binomial").select("term", "lr_chisq", "df"), 4)


CUBED = power([FLAG, STATUS, "tax"], 3)


def _sequence_sql():
    cols = term_columns(CUBED, LINE_LEVELS, {"tax": "t"})
    names, ctes, used = [], [], ["1"]
    for i in range(len(cols) + 1):
        names.append(f"s{i}")
        ctes.append(newton_cte(f"s{i}", "src", list(used), "binomial", 6))
        if i < len(cols):
            used += cols[i][1]
    dev = [newton_deviance(n, "binomial") for n in names]
    rows = [f"SELECT 0 AS position, 'NULL' AS term, NULL::INTEGER AS df, NULL::DOUBLE AS deviance, {r(dev[0], 3)} AS resid_deviance"]
    rows += [f"SELECT {i + 1}, '{':'.join(t)}', {len(c)}, {r(f'{dev[i]} - {dev[i + 1]}', 4)}, {r(dev[i + 1], 3)}" for i, (t, c) in enumerate(cols)]
    return f"WITH RECURSIVE {_LINE_SRC}, {', '.join(ctes)} " + " UNION ALL ".join(rows)


@query("anova_cubed_terms", _sequence_sql())
def anova_cubed_terms(spark, sf):
    table = anova_seq(lines(spark, sf), "big", CUBED, "binomial")
    return round_all(table.select("position", "term", "df", "deviance", "resid_deviance"), 4, resid_deviance=3)


# ---------------------------------------------------------------- prediction

@query("predict_ci", f"""WITH {_BIN_CELLS} SELECT f AS {FLAG}, g AS {STATUS}, {r('1 / (1 + exp(-l))')} AS p_mle, {r(f'1 / (1 + exp(-(l - {Z} * sqrt(v))))')} AS p_lower,
{r(f'1 / (1 + exp(-(l + {Z} * sqrt(v))))')} AS p_upper, 'saturated' AS name FROM c""")
def predict_ci_query(spark, sf):
    df = lines(spark, sf)
    m = fit_glm(df, "big", CELL_TERMS, "binomial")
    grid = joins.expand_grid(spark, **{FLAG: m.design.levels[FLAG], STATUS: m.design.levels[STATUS]}).drop("grid_id")
    return round_all(predict_ci(m, grid, name="saturated"))


@query("fitted", f"SELECT {FLAG}, {STATUS}, {r('avg(l_extendedprice)')} AS fitted FROM lineitem GROUP BY ALL")
def fitted(spark, sf):
    df = lines(spark, sf)
    return round_all(fit_glm(df, "l_extendedprice", CELL_TERMS, "gamma", "log").fitted(df))


@query("scored_rows", f"""WITH {LINES_SQL}, m AS (SELECT {FLAG}, {STATUS}, avg(big) AS p FROM lines GROUP BY ALL)
SELECT l_orderkey, l_partkey, big, {r('p')} AS fitted FROM lines JOIN m USING ({FLAG}, {STATUS})""")
def scored_rows(spark, sf):
    df = lines(spark, sf)
    return round_all(fit_glm(df, "big", CELL_TERMS, "binomial").with_mean(df).select("l_orderkey", "l_partkey", "big", "fitted"))


@query("marginal_weighted", f"""WITH {LINES_SQL} SELECT {FLAG}, {r('avg(big)')} AS p FROM lines GROUP BY 1""")
def marginal_weighted(spark, sf):
    df = lines(spark, sf)
    m = fit_glm(df, "big", CELL_TERMS, "binomial")
    share = summaries.level_share(df, STATUS, FLAG, m.design.levels[STATUS])
    return round_all(summaries.marginalise(m.fitted(df, "p"), STATUS, [FLAG], "p", share, [FLAG]))


@query("marginal_unweighted", f"""WITH {LINES_SQL}, m AS (SELECT {FLAG}, {STATUS}, avg(big) AS p FROM lines GROUP BY ALL)
SELECT {FLAG}, {r('avg(p)')} AS p FROM m GROUP BY 1""")
def marginal_unweighted(spark, sf):
    df = lines(spark, sf)
    m = fit_glm(df, "big", CELL_TERMS, "binomial")
    return round_all(summaries.marginalise(m.fitted(df, "p"), STATUS, [FLAG], "p"))


@query("marginal_ci")
def marginal_ci_query(spark, sf):
    df = lines(spark, sf)
    m = fit_glm(df, "big", term_list(star("l_quantity", FLAG), star(STATUS, FLAG)), "binomial")
    low, high = df.agg(F.min("l_quantity"), F.max("l_quantity")).first()
    grid = joins.expand_grid(spark, l_quantity=joins.number_sequence(low, high, 100),
                             **{FLAG: m.design.levels[FLAG], STATUS: m.design.levels[STATUS]})
    share = summaries.level_share(df, STATUS, FLAG, m.design.levels[STATUS])
    return marginal_ci(m, grid, STATUS, ["l_quantity", FLAG], share, [FLAG])


# Given coefficients, so that any engine can average and take quantiles.
_GIVEN = {"(Intercept)": "-1 + 0.1 * sin(i)", "l_quantity": "0.01 + 0.002 * cos(i)", f"{FLAG}N": "0.2 + 0.1 * sin(2 * i)", f"{FLAG}R": "-0.1 + 0.1 * cos(3 * i)",
          f"{STATUS}O": "0.3 + 0.1 * sin(5 * i)"}


@query("marginal_ci_given", f"""WITH {LINES_SQL}, s AS (SELECT {FLAG} AS f, {STATUS} AS g, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY {FLAG}) AS share FROM lines GROUP BY {FLAG}, {STATUS}),
d AS (SELECT i, {', '.join(f'{v} AS b{j}' for j, v in enumerate(_GIVEN.values()))} FROM range(1, 201) t(i)),
x AS (SELECT q::DOUBLE AS q, f, i, sum(share / (1 + exp(-(b0 + b1 * q + b2 * (f = 'N')::INTEGER + b3 * (f = 'R')::INTEGER + b4 * (g = 'O')::INTEGER)))) AS p
  FROM s, d, range(1, 51) r(q) GROUP BY ALL)
SELECT q AS l_quantity, f AS {FLAG}, {r('quantile_cont(p, 0.025)')} AS p_lower, {r('quantile_cont(p, 0.975)')} AS p_upper FROM x GROUP BY ALL""")
def marginal_ci_given(spark, sf):
    df = lines(spark, sf)
    m = fit_glm(df, "big", term_list("l_quantity", FLAG, STATUS), "binomial")
    grid = joins.expand_grid(spark, l_quantity=[float(i) for i in range(1, 51)], **{FLAG: m.design.levels[FLAG], STATUS: m.design.levels[STATUS]})
    table = spark.range(1, 201).withColumnRenamed("id", "i").select("i", F.inline(F.array(*[
        F.struct(F.lit(t).alias("term"), F.expr(e).alias("value")) for t, e in _GIVEN.items()])))
    share = summaries.level_share(df, STATUS, FLAG, m.design.levels[STATUS])
    out = marginal_ci(m, grid, STATUS, ["l_quantity", FLAG], share, [FLAG], coefficients=table.withColumnRenamed("i", "draw"))
    return round_all(out.select("l_quantity", FLAG, "p_lower", "p_upper"))


def _curve_sql():
    # Per status its own 2-coefficient Gamma regression on centred x; dispersion from all rows.
    fits = ", ".join(glm_cte(f"m_{g}", f"d_{g}", ["1", "x"], "gamma", sweeps=120) for g in "FO")
    data = ", ".join(f"d_{g} AS (SELECT l_quantity - 25 AS x, count(*)::DOUBLE AS n, sum(l_extendedprice) AS s, "
                     f"var_pop(l_extendedprice) * count(*) AS ss FROM lineitem WHERE {STATUS} = '{g}' GROUP BY 1)" for g in "FO")
    pearson = " + ".join(f"(SELECT sum((ss + n * pow(s / n - mu, 2)) / (mu * mu)) FROM (SELECT *, exp(b0 + b1 * x) AS mu FROM m_{g}, d_{g}))" for g in "FO")
    grid = "(SELECT i, lo + (hi - lo) * i / 19.0 AS q FROM (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem WHERE {} = '{}'), range(20) t(i))"
    parts = []
    for g in "FO":
        eta = "b0 + b1 * (q - 25)"
        se = "sqrt(phi * (h2 - 2 * (q - 25) * h1 + (q - 25) * (q - 25) * h0) / (h0 * h2 - h1 * h1))"
        parts.append(f"SELECT '{g}' AS {STATUS}, {r('q')} AS l_quantity, {r(f'exp({eta})', 3)} AS p_mle, {r(f'exp({eta} - {Z} * {se})', 3)} AS p_lower, "
                     f"{r(f'exp({eta} + {Z} * {se})', 3)} AS p_upper FROM m_{g}, phi, {grid.format(STATUS, g)}, "
                     f"(SELECT sum(n) AS h0, sum(n * x) AS h1, sum(n * x * x) AS h2 FROM d_{g})")
    return f"WITH RECURSIVE {data}, {fits}, phi AS (SELECT ({pearson}) / (SELECT count(*) - 4 FROM lineitem) AS phi) " + " UNION ALL ".join(parts)


@query("glm_curve", _curve_sql())
def glm_curve(spark, sf):
    return round_all(fit_curve(lines(spark, sf), "l_quantity", "l_extendedprice", STATUS, n=20), 3, l_quantity=6)


# The part takes an intercept of its own: least squares on deviations from its means.
_WITHIN = ("d AS (SELECT l_extendedprice - avg(l_extendedprice) OVER w AS y, l_quantity - avg(l_quantity) OVER w AS x FROM lineitem WINDOW w AS (PARTITION BY l_partkey)), "
           "t AS (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS sxx, sum(y * y) AS syy, count(*) AS n, (SELECT count(DISTINCT l_partkey) FROM lineitem) AS g FROM d), "
           "e AS (SELECT *, (syy - b * b * sxx) / (n - g - 1) AS s2 FROM t)")


@query("absorbed_part", f"""WITH {_WITHIN} SELECT 'l_quantity' AS term, {r('b')} AS estimate, {r('sqrt(s2 / sxx)')} AS std_error, {r('b / sqrt(s2 / sxx)', 4)} AS statistic,
g::BIGINT AS levels, (n - g - 1)::BIGINT AS df_resid FROM e""")
def absorbed_part(spark, sf):
    m = fit_absorbed(lines(spark, sf), "l_extendedprice", [("l_quantity",)], "l_partkey")
    table = m.coef_table(spark).select("term", "estimate", "std_error", "statistic")
    return round_all(table.withColumns({"levels": F.lit(m.levels).cast("long"), "df_resid": F.lit(m.df_resid).cast("long")}), statistic=4)


# ---------------------------------------------------------------- counts

_NB = ("f AS (SELECT l_returnflag AS f, avg(excess) AS mu FROM lines GROUP BY 1), "
       "y AS (SELECT 1 AS one, l_returnflag AS f, excess AS y, count(*)::DOUBLE AS n FROM lines GROUP BY ALL), "
       "d AS (SELECT y.*, mu FROM y JOIN f USING (f)), "
       + stencil_newton_1d("k", "d", "one", "n * " + negbin_log_density("y", "mu", "exp(w)", False), "0.0::DOUBLE"))


def _curvature_sql(table, value, at, h=0.02):
    """Second derivative of sum({value}) in w at {at}, by five points."""
    parts = [f"{c} * (SELECT sum({value.replace('@', f'({at} + {i * h})')}) FROM {table})" for i, c in ((-2, -1), (-1, 16), (0, -30), (1, 16), (2, -1))]
    return f"(({' + '.join(parts)}) / {12 * h * h})"


# The size and the cell means are orthogonal at the estimate.
@query("negbin_fit", f"""WITH RECURSIVE {LINES_SQL}, {_NB}, w AS (SELECT v, exp(v) AS k FROM k), c AS (SELECT f, mu, sum(n) AS n FROM d GROUP BY ALL)
SELECT '{FLAG}' || f AS term, {r('ln(mu)', 5)} AS estimate, {r('sqrt((mu + k) / (n * mu * k))', 5)} AS std_error FROM c, w
UNION ALL SELECT 'log(k)', {r('v', 5)}, {r('1 / sqrt(-' + _curvature_sql('d', 'n * ' + negbin_log_density('y', 'mu', 'exp(@)', False), 'v') + ')', 5)} FROM w""")
def negbin_fit(spark, sf):
    m = fit_negbin(lines(spark, sf), "excess", [(FLAG,)], intercept=False)
    return round_all(m.coef_table(spark).select("term", "estimate", "std_error"), 5)


@query("negbin_anova", f"""WITH RECURSIVE {LINES_SQL}, {_NB}, t AS (SELECT exp(v) AS k FROM k), o AS (SELECT avg(excess) AS mu0 FROM lines)
SELECT '{FLAG}' AS term, 2 AS df, {r('''2 * sum(n * ((y * ln(mu) - (y + k) * ln(mu + k)) - (y * ln(mu0) - (y + k) * ln(mu0 + k))))''', 4)} AS lr_chisq FROM d, t, o""")
def negbin_anova(spark, sf):
    df = lines(spark, sf)
    m = fit_negbin(df, "excess", [(FLAG,)])
    return round_all(anova_negbin(df, "excess", [(FLAG,)], m).select("term", "df", "lr_chisq"), 4)


_LINE_COUNTS = "y AS (SELECT count(*) AS y FROM lineitem GROUP BY l_orderkey), m AS (SELECT avg(y) AS mu, count(*) AS n FROM y)"


# Without overdispersion the fit is the Poisson one and the score of 1/k is negative.
@query("poisson_limit", f"""WITH {_LINE_COUNTS}, s AS (SELECT sum(0.5 * (pow(y - mu, 2) - y)) / sqrt(any_value(n) * 0.5 * pow(any_value(mu), 2)) AS z FROM y, m)
SELECT z <= 0 AS poisson_limit, {r('ln(mu)')} AS log_mean, {r('1 / sqrt(n * mu)')} AS std_error, {r('z')} AS score_z FROM s, m""")
def poisson_limit(spark, sf):
    per_order = lines(spark, sf).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"))
    m = fit_negbin(per_order, "n_lines", [])
    table = m.coef_table(spark).where("term = '(Intercept)'").select(
        F.lit(m.poisson_limit).alias("poisson_limit"), F.col("estimate").alias("log_mean"), "std_error", F.lit(m.boundary_z).cast("double").alias("score_z"))
    return round_all(table)


_ZT = ("y AS (SELECT {x} AS y, count(*)::DOUBLE AS n FROM lines WHERE {x} > 0 GROUP BY 1), "
       + stencil_newton_2d("z", "y", "n * " + negbin_log_density("y", "exp(u)", "exp(v)", True),
                           ("ln(sum(n * y) / sum(n))", "0.0::DOUBLE"), steps=40))


_ZT1 = ", ".join([f"{LINES_SQL}, src AS (SELECT l_quantity AS y, count(*)::DOUBLE AS n FROM lines GROUP BY 1)", *ztnb_cte("m", "src", ["1"])])


@query("ztnb_fit", f"""WITH RECURSIVE {_ZT1} SELECT '(Intercept)' AS term, {r('b[1]', 4)} AS estimate, {r('sqrt(v[1][1])', 5)} AS std_error, {r('b[1] / sqrt(v[1][1])', 1)} AS statistic FROM m, m_v
UNION ALL SELECT 'log(k)', {r('c', 4)}, {r('sqrt(v[2][2])', 5)}, {r('c / sqrt(v[2][2])', 1)} FROM m, m_v""")
def ztnb_fit(spark, sf):
    table = fit_ztnb(lines(spark, sf), "l_quantity", []).coef_table(spark)
    return round_all(table.select("term", "estimate", "std_error", "statistic"), 5, estimate=4, statistic=1)


@query("ztnb_loglik", f"""WITH {LINES_SQL}, d AS (SELECT l_quantity AS y, 3.2 + 0.02 * (l_returnflag = 'N')::INTEGER - 0.01 * (l_linestatus = 'O')::INTEGER AS eta, exp(0.8) AS k FROM lines)
SELECT count(*) AS n, {r('sum(' + negbin_log_density('y', 'exp(eta)', 'k', True) + ')', 4)} AS log_likelihood FROM d""")
def ztnb_loglik(spark, sf):
    eta = F.lit(3.2) + 0.02 * (F.col(FLAG) == "N").cast("int") - 0.01 * (F.col(STATUS) == "O").cast("int")
    return round_all(count_log_likelihood(lines(spark, sf), "l_quantity", eta, 0.8, truncated=True), 4)


_ZT2 = ", ".join([f"{LINES_SQL}, src AS (SELECT {FLAG}, {STATUS}, l_quantity AS y, count(*)::DOUBLE AS n FROM lines GROUP BY ALL)",
                  *ztnb_cte("m", "src", ["1", f"({FLAG} = 'N')::INTEGER", f"({FLAG} = 'R')::INTEGER", f"({STATUS} = 'O')::INTEGER"])])
_ZT2_LABELS = ["(Intercept)", f"{FLAG}N", f"{FLAG}R", f"{STATUS}O"]


# The stencil in log k is good to about 1e-7, hence the fewer digits.
@query("ztnb_terms", f"WITH RECURSIVE {_ZT2} " + " UNION ALL ".join(
    [f"SELECT '{t}' AS term, {r(f'b[{i + 1}]', 4)} AS estimate, {r(f'sqrt(v[{i + 1}][{i + 1}])', 5)} AS std_error FROM m, m_v" for i, t in enumerate(_ZT2_LABELS)]
    + [f"SELECT 'log(k)', {r('c', 4)}, {r('sqrt(v[5][5])', 5)} FROM m, m_v"]))
def ztnb_terms(spark, sf):
    m = fit_ztnb(lines(spark, sf), "l_quantity", [(FLAG,), (STATUS,)])
    return round_all(m.coef_table(spark).select("term", "estimate", "std_error"), 5, estimate=4)


@query("ztnb_wald", f"WITH RECURSIVE {_ZT2} SELECT '{FLAG}' AS term, 2 AS df, {r(wald_sql('m', [2, 3]), 4)} AS chisq UNION ALL SELECT '{STATUS}', 1, {r(wald_sql('m', [4]), 4)}")
def ztnb_wald(spark, sf):
    table = anova_wald(spark, fit_ztnb(lines(spark, sf), "l_quantity", [(FLAG,), (STATUS,)]))
    return round_all(table.select("term", "df", "chisq"), 4)


@query("hurdle_fit", f"""WITH RECURSIVE {LINES_SQL}, {_ZT.format(x='excess')}, p AS (SELECT l_returnflag AS f, l_linestatus AS g, avg((excess > 0)::INTEGER) AS p FROM lines GROUP BY ALL),
m AS (SELECT exp(u) / (1 - pow(exp(v) / (exp(v) + exp(u)), exp(v))) AS mean FROM z)
SELECT f AS {FLAG}, g AS {STATUS}, {r('p')} AS p_positive, {r('mean', 3)} AS mean_positive, {r('p * mean', 3)} AS expected FROM p, m""")
def hurdle_fit(spark, sf):
    df = lines(spark, sf)
    m = fit_hurdle(df, "excess", CELL_TERMS, [])
    return round_all(m.predict(df.select(FLAG, STATUS).distinct()), 3, p_positive=6)


# ---------------------------------------------------------------- scale and random effects

@query("gamma_ls", f"""WITH RECURSIVE d AS (SELECT l_returnflag AS grp, count(*)::DOUBLE AS n, avg(l_extendedprice) AS mu, avg(ln(l_extendedprice)) AS ln FROM lineitem GROUP BY 1),
{stencil_newton_1d("z", "d", "grp", "n * (exp(-w) * -w - exp(-w) * ln(mu) + (exp(-w) - 1) * ln - exp(-w) - lgamma(exp(-w)))", "0.0::DOUBLE")},
e AS (SELECT max(CASE grp WHEN 'A' THEN ln(mu) END) AS a, max(CASE grp WHEN 'N' THEN ln(mu) END) AS n, max(CASE grp WHEN 'R' THEN ln(mu) END) AS q FROM d),
s AS (SELECT max(CASE grp WHEN 'A' THEN v END) AS a, max(CASE grp WHEN 'N' THEN v END) AS n, max(CASE grp WHEN 'R' THEN v END) AS q FROM z)
SELECT 'mean' AS part, '(Intercept)' AS term, {r('a', 5)} AS estimate FROM e UNION ALL SELECT 'mean', '{FLAG}N', {r('n - a', 5)} FROM e UNION ALL SELECT 'mean', '{FLAG}R', {r('q - a', 5)} FROM e
UNION ALL SELECT 'scale', '(Intercept)', {r('a', 5)} FROM s UNION ALL SELECT 'scale', '{FLAG}N', {r('n - a', 5)} FROM s UNION ALL SELECT 'scale', '{FLAG}R', {r('q - a', 5)} FROM s""")
def gamma_ls(spark, sf):
    m = fit_gamma_ls(lines(spark, sf), "l_extendedprice", [(FLAG,)], [(FLAG,)])
    return round_all(m.coef_table(spark).select("part", "term", "estimate"), 5)


@query("gamma_ls_anova")
def gamma_ls_anova(spark, sf):
    m = fit_gamma_ls(lines(spark, sf), "l_extendedprice", term_list(star(FLAG, STATUS), "tax"), [(FLAG,), ("tax",)])
    return round_all(m.anova(spark))


def part_volume(spark, sf):
    """Shipped size of each line; the part is the subject and its size varies between parts."""
    part = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_size")
    df = lines(spark, sf)
    return df.join(part, df["l_partkey"] == part["p_partkey"]).withColumn("volume", F.col("l_quantity") * F.col("p_size"))


@query("glmm_ri")
def glmm_ri(spark, sf):
    return round_all(fit_glmm_ri(part_volume(spark, sf), "volume", [(FLAG,), (STATUS,)], "l_partkey").coef_table(spark), 4)


# Fixed parameters of the random-intercept queries; the shape is whole, so that SQL has its distribution function.
_RI_SIGMA, _RI_SHAPE = 0.4, 3


def _ri_eta():
    return F.lit(6.4) + 0.05 * (F.col(FLAG) == "N").cast("int") - 0.03 * (F.col(STATUS) == "O").cast("int")


def _ri_sql(nodes=15):
    """Group sums, the mode of each intercept by Newton steps, and the adaptive nodes with their log weights."""
    t, w = np.polynomial.hermite.hermgauss(nodes)
    s, k = _RI_SIGMA, _RI_SHAPE
    rows = ", ".join(f"({i}, {float(a)!r}::DOUBLE, {math.log(b)!r}::DOUBLE)" for i, (a, b) in enumerate(zip(t, w, strict=True)))
    pull = f"{k} * s * exp(-{s} * b)"
    return f"""v AS (SELECT l.l_partkey AS g, l.l_quantity * p_size AS y, 6.4 + 0.05 * ({FLAG} = 'N')::INTEGER - 0.03 * ({STATUS} = 'O')::INTEGER AS eta
  FROM lineitem l JOIN part ON l_partkey = p_partkey),
q AS (SELECT g, count(*)::DOUBLE AS n, sum(ln(y)) AS ln, sum(eta) AS e, sum(y * exp(-eta)) AS s FROM v WHERE y > 0 GROUP BY g),
it(i, g, n, ln, e, s, b) AS (SELECT 0, *, 0.0::DOUBLE FROM q UNION ALL
  SELECT i + 1, g, n, ln, e, s, b + greatest(-2.0, least(2.0, ({s} * ({pull} - {k} * n) - b) / (1 + {s} * {s} * {pull}))) FROM it WHERE i < 40),
m AS (SELECT *, 1 / sqrt(1 + {s} * {s} * {pull}) AS width FROM it WHERE i = 40),
h(j, t, lw) AS (VALUES {rows}),
a AS (SELECT m.*, b + sqrt(2) * width * t AS pos, t, lw FROM m, h),
l AS (SELECT *, n * ({k} * ln({k}::DOUBLE) - lgamma({k}::DOUBLE)) + ({k} - 1) * ln - {k} * e - {k} * n * {s} * pos - {k} * s * exp(-{s} * pos) - 0.5 * pos * pos + lw + t * t AS logw FROM a),
o AS (SELECT g, max(logw) AS top, any_value(n) AS n, any_value(width) AS width FROM l GROUP BY g),
z AS (SELECT g, sum(exp(logw - top)) AS mass FROM l JOIN o USING (g) GROUP BY g)"""


@query("glmm_loglik", f"""WITH RECURSIVE {_ri_sql()}
SELECT sum(n)::BIGINT AS n, count(*) AS groups, {r('sum(top + ln(mass) + ln(sqrt(2) * width) - 0.5 * ln(2 * pi()))', 4)} AS log_likelihood FROM o JOIN z USING (g)""")
def glmm_loglik(spark, sf):
    return round_all(glmm_log_likelihood(part_volume(spark, sf), "volume", _ri_eta(), "l_partkey", _RI_SIGMA, _RI_SHAPE), 4)


@query("residual_glmm", f"""WITH RECURSIVE {_ri_sql()}, x AS (SELECT v.g, v.y, v.eta, sum(exp(l.logw - o.top) / z.mass * (1 - exp(-({_RI_SHAPE} * y * exp(-eta - {_RI_SIGMA} * l.pos)))
  * (1 + ({_RI_SHAPE} * y * exp(-eta - {_RI_SIGMA} * l.pos)) + pow({_RI_SHAPE} * y * exp(-eta - {_RI_SIGMA} * l.pos), 2) / 2))) AS u
  FROM (SELECT row_number() OVER () AS k, * FROM v WHERE y > 0) v JOIN l ON l.g = v.g JOIN o ON o.g = v.g JOIN z ON z.g = v.g GROUP BY k, v.g, v.y, v.eta)
SELECT g AS l_partkey, count(*) AS n, {r('avg(u)', 7)} AS mean, {r('min(u)', 7)} AS least, {r('max(u)', 7)} AS most, {r('sum(u * u)', 7)} AS squares FROM x GROUP BY g""")
def residual_glmm(spark, sf):
    u = mixture_residuals(part_volume(spark, sf), "volume", _ri_eta(), "l_partkey", _RI_SIGMA, _RI_SHAPE)
    return round_all(u.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.avg("residual").alias("mean"), F.min("residual").alias("least"),
                                                F.max("residual").alias("most"), F.sum(F.col("residual") * F.col("residual")).alias("squares")), 7)


# ---------------------------------------------------------------- residuals

def _u(df):
    """A column on (0, 1) to exercise the diagnostics without a model: the price modulo 1000."""
    return df.withColumn("u", (F.col("l_extendedprice") % 1000) / 1000)


_U = "u AS (SELECT *, fmod(l_extendedprice, 1000) / 1000 AS u FROM lineitem)"
_KS = ("k AS (SELECT {by} count(*)::DOUBLE AS n, max(greatest(rk / n - u, u - (rk - 1) / n)) AS ks FROM (SELECT *, row_number() OVER ({part} ORDER BY u)::DOUBLE AS rk, "
       "count(*) OVER ({part})::DOUBLE AS n FROM u) {group})")


@query("uniform_ks", f"WITH {_U}, {_KS.format(by=f'{FLAG}, {STATUS},', part=f'PARTITION BY {FLAG}, {STATUS}', group=f'GROUP BY {FLAG}, {STATUS}')} "
                     f"SELECT {FLAG}, {STATUS}, n::BIGINT AS n, {r('ks')} AS ks FROM k")
def uniform_ks_query(spark, sf):
    return round_all(uniform_ks(_u(lines(spark, sf)), "u", [FLAG, STATUS]))


def _erfc_sql(x):
    """Two-sided normal p-value of x >= 0 by Simpson's rule on the density, 2000 panels."""
    return (f"(1 - 2 * (SELECT sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-0.5 * pow(least({x}, 12.0) * i / 2000, 2))) "
            f"FROM range(2001) s(i)) * least({x}, 12.0) / 2000 / 3 / sqrt(2 * pi()))")


@query("residual_overall", f"""WITH u AS (SELECT *, CASE WHEN l_orderkey % 97 = 0 AND l_linenumber = 1 THEN 0.0 ELSE fmod(l_extendedprice, 1000) / 1000 END AS u FROM lineitem),
{_KS.format(by='', part='', group='')}, s AS (SELECT count(*) AS n, avg(u) AS mean, var_samp(u) AS v, count(CASE WHEN u <= 0 OR u >= 1 THEN 1 END) AS outliers FROM u),
z AS (SELECT *, abs(v - 1 / 12.0) / sqrt((1 / 80.0 - (n - 3.0) / (n - 1.0) / 144) / n) AS z FROM s),
b AS (SELECT i, lgamma(n + 1) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln(2 / 251.0) + (n - i) * ln(1 - 2 / 251.0) AS l FROM s, range(0, (SELECT count(*) + 1 FROM lineitem)) t(i))
SELECT n, {r('mean')} AS mean, {r('v * 12')} AS dispersion, {r(_erfc_sql('z'))} AS dispersion_p, {r('(SELECT ks FROM k)')} AS ks, outliers, {r('n * 2 / 251.0')} AS outliers_expected,
{r('(SELECT least(1.0, sum(exp(l))) FROM b WHERE l <= (SELECT l FROM b WHERE i = outliers) + 1e-7)')} AS outliers_p FROM z""")
def residual_overall_query(spark, sf):
    df = _u(lines(spark, sf)).withColumn("u", F.when((F.col("l_orderkey") % 97 == 0) & (F.col("l_linenumber") == 1), 0.0).otherwise(F.col("u")))
    return round_all(residual_overall(df, "u", sims=250).drop("ks_p"))


def _md5_uniforms(n):
    """Uniforms from the digest of a row's values and a number, the same in any engine."""
    row = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.conv(F.substring(F.md5(F.concat_ws("-", row, i)), 1, 13), 16, 10).cast("double") / 2.0**52)


@query("dispersion_test", f"""WITH {LINES_SQL}, m AS (SELECT *, avg(big) OVER (PARTITION BY {FLAG}, {STATUS}) AS mu FROM lines),
d AS (SELECT i, sum(pow((('0x' || substr(md5(concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, i)), 1, 13))::BIGINT / 4503599627370496.0 < mu)::INTEGER - mu, 2)) AS s
  FROM m, range(1, 21) t(i) GROUP BY i), o AS (SELECT count(*) AS n, sum(pow(big - mu, 2)) AS observed FROM m)
SELECT any_value(n) AS n, {r('any_value(observed)', 4)} AS observed, {r('avg(s)', 4)} AS simulated, {r('any_value(observed) / avg(s)')} AS ratio,
{r('least(1.0, 2 * least(avg((s >= observed)::INTEGER), avg((s <= observed)::INTEGER)))')} AS p_value FROM d, o""")
def dispersion_test_query(spark, sf):
    df = lines(spark, sf)
    return round_all(dispersion_test(fit_glm(df, "big", CELL_TERMS, "binomial"), df, ROW_KEY, sims=20, uniforms=_md5_uniforms(20)), observed=4, simulated=4)


@query("residual_qq", f"WITH {_U}, p AS (SELECT (i + 0.5) / 100 AS p FROM range(100) t(i)), q AS (SELECT quantile_cont(u, [{', '.join(str((i + 0.5) / 100) for i in range(100))}]) AS q FROM u) "
                      f"SELECT {r('(i + 0.5) / 100')} AS expected, {r('q[i + 1]')} AS observed FROM q, range(100) t(i)")
def residual_qq_query(spark, sf):
    return round_all(residual_qq(_u(lines(spark, sf)), "u"))


@query("residual_cells", f"WITH {_U}, {_KS.format(by=f'{FLAG}, {STATUS},', part=f'PARTITION BY {FLAG}, {STATUS}', group=f'GROUP BY {FLAG}, {STATUS}')}, "
                         f"b AS (SELECT {FLAG}, {STATUS}, count(*) AS n, quantile_cont(u, 0.25) AS lo, median(u) AS md, quantile_cont(u, 0.75) AS hi FROM u GROUP BY ALL) "
                         f"SELECT {FLAG}, {STATUS}, b.n, {r('lo')} AS lower, {r('md')} AS middle, {r('hi')} AS upper, 0::BIGINT AS n_outliers, {r('ks')} AS ks FROM b JOIN k USING ({FLAG}, {STATUS})")
def residual_cells(spark, sf):
    return round_all(residual_by_cell(_u(lines(spark, sf)), [FLAG, STATUS], "u").drop("ks_p"))


@query("levene", f"""WITH {_U}, z AS (SELECT {FLAG} AS f, {STATUS} AS g, abs(u - median(u) OVER (PARTITION BY {FLAG}, {STATUS})) AS z FROM u),
c AS (SELECT f, g, count(*)::DOUBLE AS n, avg(z) AS m, var_pop(z) * count(*) AS ss FROM z GROUP BY ALL), t AS (SELECT sum(n) AS n, count(*) AS k, sum(n * m) / sum(n) AS grand, sum(ss) AS ss FROM c)
SELECT any_value(k - 1)::BIGINT AS df1, any_value(t.n - k)::BIGINT AS df2, {r('(sum(c.n * pow(m - grand, 2)) / any_value(k - 1)) / (any_value(t.ss) / any_value(t.n - k))')} AS f_statistic FROM c, t""")
def levene_query(spark, sf):
    return round_all(levene(_u(lines(spark, sf)), "u", [FLAG, STATUS]).drop("p_value"))


@query("residual_trend", f"""WITH {_U}, e AS (SELECT list_sort(list_distinct(quantile_cont(l_quantity, [{', '.join(str(i / 10) for i in range(1, 10))}]))) AS e FROM u),
b AS (SELECT u, l_quantity, len(list_filter(e, lambda x: x < l_quantity))::INTEGER AS bin FROM u, e)
SELECT bin, count(*) AS n, {r('avg(l_quantity)')} AS x_mean, {r('quantile_cont(u, 0.25)')} AS q25, {r('median(u)')} AS q50, {r('quantile_cont(u, 0.75)')} AS q75 FROM b GROUP BY bin""")
def residual_trend_query(spark, sf):
    return round_all(residual_trend(_u(lines(spark, sf)), "l_quantity", "u", bins=10))


@query("residual_trend_by", f"""WITH {_U}, e AS (SELECT list_sort(list_distinct(quantile_cont(l_quantity, [0.25, 0.5, 0.75]))) AS e FROM u),
b AS (SELECT {STATUS}, u, l_quantity, len(list_filter(e, lambda x: x < l_quantity))::INTEGER AS bin FROM u, e)
SELECT {STATUS}, bin, count(*) AS n, {r('avg(l_quantity)')} AS x_mean, {r('median(u)')} AS q50 FROM b GROUP BY ALL""")
def residual_trend_by(spark, sf):
    return round_all(residual_trend(_u(lines(spark, sf)), "l_quantity", "u", bins=4, probs=[0.5], by=STATUS))


def _smooth_sql(knots=5, points=50):
    """Spline regression per facet: normal equations, Gauss-Jordan and the curve, all in SQL."""
    p, pieces = knots + 4, knots + 1

    def bump(t):
        d = f"abs({t})"
        return f"CASE WHEN {d} < 1 THEN (4 - 6 * pow({d}, 2) + 3 * pow({d}, 3)) / 6 WHEN {d} < 2 THEN pow(2 - {d}, 3) / 6 ELSE 0.0 END::DOUBLE"
    basis = "[" + ", ".join(bump(f"(s * {pieces} - ({j - 1}))") for j in range(p)) + "]"
    sums = ", ".join([f"sum(x[{j + 1}] * x[{k + 1}]) AS h{j}_{k}" for j in range(p) for k in range(j, p)] + [f"sum(x[{j + 1}] * u) AS g{j}" for j in range(p)])
    rows = ", ".join("[" + ", ".join([f"h{min(j, k)}_{max(j, k)}" for k in range(p)] + ["1.0::DOUBLE" if k == j else "0.0::DOUBLE" for k in range(p)] + [f"g{j}"]) + "]"
                     for j in range(p))
    rhs = "[" + ", ".join(f"g{j}" for j in range(p)) + "]"
    solved = f"SELECT f, g, n, yy, s0, s1, {rhs} AS rhs, [{rows}] AS a FROM (SELECT f, g, count(*) AS n, sum(u * u) AS yy, min(s) AS s0, max(s) AS s1, {sums} FROM d GROUP BY f, g)"
    for k in range(1, p + 1):
        solved = pivot_sql(solved, k, "f, g, n, yy, s0, s1, rhs")
    band = f"{Z} * sqrt(list_dot_product(list_transform(v, lambda row: list_dot_product(row, z)), z) * s2)"
    return (f"WITH {_U}, rng AS (SELECT min(l_quantity) AS lo, max(l_quantity) - min(l_quantity) AS w FROM u), "
            f"t AS (SELECT {FLAG} AS f, {STATUS} AS g, u, (l_quantity - lo) / w AS s FROM u, rng), d AS (SELECT f, g, u, s, {basis} AS x FROM t), "
            f"b AS (SELECT f, g, n, yy, s0, s1, rhs, list_transform(a, lambda row: row[{2 * p + 1}]) AS beta, list_transform(a, lambda row: row[{p + 1}:{2 * p}]) AS v FROM ({solved})), "
            f"q AS (SELECT *, (yy - list_dot_product(beta, rhs)) / (n - {p}) AS s2 FROM b), "
            f"c AS (SELECT *, s0 + (s1 - s0) * i / {points - 1}.0 AS s FROM q, range({points}) r(i)), o AS (SELECT *, {basis} AS z FROM c) "
            f"SELECT f AS {FLAG}, g AS {STATUS}, {r('lo + w * s')} AS l_quantity, {r('list_dot_product(beta, z)')} AS fit, {r(f'list_dot_product(beta, z) - {band}')} AS lower, "
            f"{r(f'list_dot_product(beta, z) + {band}')} AS upper FROM o, rng")


@query("residual_smooth", _smooth_sql())
def residual_smooth_query(spark, sf):
    return round_all(residual_smooth(_u(lines(spark, sf)), "l_quantity", [FLAG, STATUS], "u"))


def _summary(df, by):
    return round_all(df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("residual").alias("mean"), (F.var_samp("residual") * 12).alias("spread")), 4)


# The randomisation can be any given column; one that SQL can also compute allows an exact comparison.
_TIE = "(l_partkey % 997 + 5e-1) / 997"      # an exponent makes the literal a double in both engines
_RES_TERMS = term_list(star("l_quantity", FLAG), STATUS)
_RES_COLS = ["1", *[c for _, mine in term_columns(_RES_TERMS, LINE_LEVELS, {"l_quantity": "(l_quantity - 25) / 10"}) for c in mine]]
_RES_ROW = "[" + ", ".join(f"({c})::DOUBLE" for c in _RES_COLS) + "]"


@query("residual_exact", f"""WITH RECURSIVE {LINES_SQL}, src AS (SELECT l_quantity, {FLAG}, {STATUS}, count(*)::DOUBLE AS n, sum(big)::DOUBLE AS s FROM lines GROUP BY ALL),
{newton_cte("m", "src", _RES_COLS, "binomial", 6)},
p AS (SELECT {FLAG}, {STATUS}, big, {_TIE} AS tie, 1 / (1 + exp(-list_dot_product(b, {_RES_ROW}))) AS mu FROM lines, m),
u AS (SELECT {FLAG}, {STATUS}, CASE WHEN big = 1 THEN 1 - mu + tie * mu ELSE tie * (1 - mu) END AS u FROM p)
SELECT {FLAG}, {STATUS}, count(*) AS n, {r('avg(u)')} AS mean, {r('var_samp(u) * 12')} AS spread, {r('min(u)')} AS low, {r('max(u)')} AS high FROM u GROUP BY ALL""")
def residual_exact(spark, sf):
    df = lines(spark, sf)
    m = fit_glm(df, "big", _RES_TERMS, "binomial")
    res = sim_residuals(m, df, ROW_KEY, tie=F.expr(_TIE))
    return round_all(res.groupBy(FLAG, STATUS).agg(F.count(F.lit(1)).alias("n"), F.avg("residual").alias("mean"), (F.var_samp("residual") * 12).alias("spread"),
                                                   F.min("residual").alias("low"), F.max("residual").alias("high")))


@query("residual_keyed")
def residual_keyed(spark, sf):
    df = lines(spark, sf)
    return _summary(sim_residuals(fit_glm(df, "big", _RES_TERMS, "binomial"), df, ROW_KEY, seed=SEED), [FLAG, STATUS])


@query("residual_sim")
def residual_sim(spark, sf):
    df = lines(spark, sf)
    m = fit_glm(df, "big", term_list(star("l_quantity", FLAG), STATUS), "binomial")
    return _summary(sim_residuals(m, df, ROW_KEY, seed=SEED, mode="sim", n=2000), [FLAG, STATUS])


@query("residual_gamma")
def residual_gamma(spark, sf):
    df = lines(spark, sf)
    m = fit_glm(df, "l_extendedprice", CELL_TERMS, "gamma", "log")
    return _summary(sim_residuals(m, df, ROW_KEY, seed=SEED), [FLAG, STATUS])


@query("residual_ztnb")
def residual_ztnb(spark, sf):
    df = lines(spark, sf)
    return _summary(sim_residuals(fit_ztnb(df, "l_quantity", [(FLAG,), (STATUS,)]), df, ROW_KEY, seed=SEED), [FLAG, STATUS])


@query("residual_truncated", f"""WITH RECURSIVE {LINES_SQL}, {_ZT.format(x='l_quantity')}, k AS (SELECT i::DOUBLE AS y, exp({negbin_log_density('i', 'exp(u)', 'exp(v)', True)}) AS f FROM z, range(1, 51) t(i)),
c AS (SELECT y, sum(f) OVER (ORDER BY y) AS high, f FROM k), w AS (SELECT {FLAG}, high - f + {_TIE} * f AS u FROM lines JOIN c ON y = l_quantity)
SELECT {FLAG}, count(*) AS n, {r('avg(u)', 4)} AS mean, {r('min(u)', 4)} AS low, {r('max(u)', 4)} AS high FROM w GROUP BY ALL""")
def residual_truncated(spark, sf):
    df = lines(spark, sf)
    res = sim_residuals(fit_ztnb(df, "l_quantity", []), df, ROW_KEY, tie=F.expr(_TIE))
    return round_all(res.groupBy(FLAG).agg(F.count(F.lit(1)).alias("n"), F.avg("residual").alias("mean"), F.min("residual").alias("low"), F.max("residual").alias("high")), 4)


@query("simulate")
def simulate_query(spark, sf):
    df = lines(spark, sf)
    draws = simulate(fit_ztnb(df, "l_quantity", [(FLAG,), (STATUS,)]), df, 10, ROW_KEY, seed=SEED)
    return round_all(draws.groupBy(FLAG, STATUS).agg(F.count(F.lit(1)).alias("n"), F.avg("y_sim").alias("mean"), F.min("y_sim").alias("low"), F.max("y_sim").alias("high")), 3)

