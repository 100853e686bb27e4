"""The composite analyses, each from the raw tables to the numbers behind its figures.

Layers that a closed form or a likelihood identity pins down have SQL twins:
at the maximum of a logistic (Gamma-log) likelihood the fitted totals equal
the observed ones in every cell the model has a term for, so the calibration
tables check the iterative fits against plain aggregates.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wavepanel.functions.numeric import normal_quantile
from wavepanel.functions.storage import durable
from wavepanel.operators import clean, joins, reshape, summaries
from wavepanel.operators.counts import anova_negbin, fit_hurdle, fit_negbin, fit_ztnb
from wavepanel.operators.extended import fit_gamma_ls
from wavepanel.operators.glm import fit_glm
from wavepanel.operators.hypothesis import anova_ii, anova_wald, fit_and_test
from wavepanel.operators.predict import fit_curve, marginal_ci, predict_ci
from wavepanel.operators.residuals import residual_by_cell, residual_overall, residual_smooth, sim_residuals
from wavepanel.operators.terms import base_column, poly, star, term_list
from wavepanel.plans.panels import ALT, FRUTOS, IDS, LAST_WAVE, LINES_SQL, PANEL_SQL, SUP, TIME, lines, long_sql, wide_panel
from wavepanel.plans.registry import SEED, query, r, round_all
from wavepanel.plans.sql_models import design_list, predict_sql, stencil_newton_2d, term_columns, type_ii_sql, wald_sql, ztnb_cte
from wavepanel.plans.table_queries import observed_survival

W = f"WITH {PANEL_SQL}"
Z = repr(normal_quantile(0.975))
LEVELS = {"trat": ["a", "b", "c"], "dom": ["dom", "sub"], "sp": ["ang", "ata"]}
HEIGHT_CLASSES = ["low", "mid", "high"]

SURVIVAL = term_list(star("year", "trat"), star("alt0", "year"), star("alt0", "trat"), star("dom", "year"), star("dom", "trat"))
HEIGHT_LINEAR = SURVIVAL
HEIGHT_PLAIN = term_list(star("year", "trat"), "alt0", poly("alt0", 2), star("dom", "year"), star("dom", "trat"))
HEIGHT = term_list(star("year", "trat"), star("alt0", "year"), star("alt0", "trat"), star(poly("alt0", 2), "year"),
                   star(poly("alt0", 2), "trat"), star("dom", "year"), star("dom", "trat"))
HEIGHT_SPECIES = term_list(HEIGHT, "sp", star("alt0", "sp"), star(poly("alt0", 2), "sp"))


# ---------------------------------------------------------------- survival

def survival_long(spark, sf):
    panel, _ = clean.cut_equal(wide_panel(spark, sf), "alt0", 3, HEIGHT_CLASSES, out="alt_cat")
    long = reshape.to_long(panel, [*IDS, "alt0", "alt_cat"], SUP, "name", "survival", index="wave")
    return panel, long.withColumn("year", F.col("wave").cast("double"))


def survival_model(long):
    return fit_glm(long, "survival", SURVIVAL, "binomial", levels={k: LEVELS[k] for k in ("trat", "dom")})


def survival_layers(spark, sf, draws: int = 30_000):
    """Predictions by dominance, and marginal predictions overall and by height class, with the observed points."""
    panel, long = survival_long(spark, sf)
    model = survival_model(long)
    years = joins.number_sequence(1, LAST_WAVE, 100)
    mean_height = panel.agg(F.avg("alt0")).first()[0]
    class_means = {row["alt_cat"]: row["alt0"] for row in
                   summaries.group_mean(panel, "alt_cat", ["alt0"], casewise=True).collect()}  # three classes
    doms, trats = LEVELS["dom"], LEVELS["trat"]
    one = joins.expand_grid(spark, year=years, trat=trats, dom=doms).withColumn("alt0", F.lit(mean_height))
    classes = [c for c in HEIGHT_CLASSES if c in class_means]
    three = joins.expand_grid(spark, year=years, trat=trats, alt_cat=classes, dom=doms)
    height = None
    for c in classes:
        value = F.lit(class_means[c])
        height = F.when(F.col("alt_cat") == c, value) if height is None else height.when(F.col("alt_cat") == c, value)
    three = three.withColumn("alt0", height)
    share = summaries.level_share(panel, "dom", "trat", doms)
    share_by_class = summaries.level_share(panel, "dom", ["trat", "alt_cat"], doms)
    return {
        "dominance": predict_ci(model, one.drop("grid_id")),
        "marginal": marginal_ci(model, one, "dom", ["year", "trat"], share, ["trat"], draws=draws, seed=SEED),
        "height": marginal_ci(model, three, "dom", ["year", "trat", "alt_cat"], share_by_class, ["trat", "alt_cat"],
                              draws=draws, seed=SEED),
        "observed": observed_survival(spark, sf),
    }


@query("q3_survival")
def q3_survival(spark, sf):
    layers = survival_layers(spark, sf)
    return round_all(joins.union_labelled({k: layers[k] for k in ("dominance", "marginal", "height")}, "layer"), 4)


_LONG_SURVIVAL = f"l AS (SELECT *, wave::DOUBLE AS year FROM ({long_sql(SUP, 'name', 'survival')}) WHERE survival IS NOT NULL AND alt0 IS NOT NULL)"


_BY_YEAR = f"CASE WHEN trat IS NULL THEN {r('sum(year * survival)', 3)} END"


@query("q3_calibration", f"""{W}, {_LONG_SURVIVAL} SELECT trat, dom, count(*) AS n, {r('sum(survival)', 4)} AS observed, {r('sum(survival)', 4)} AS fitted,
{_BY_YEAR} AS observed_by_year, {_BY_YEAR} AS fitted_by_year FROM l GROUP BY GROUPING SETS ((trat, dom), ())""")
def q3_calibration(spark, sf):
    _, long = survival_long(spark, sf)
    scored = survival_model(long).with_mean(long).where("survival is not null and fitted is not null")
    total = F.col("trat").isNull()
    out = scored.rollup("trat", "dom").agg(
        F.count(F.lit(1)).alias("n"), F.sum("survival").cast("double").alias("observed"), F.sum("fitted").alias("fitted"),
        F.sum(F.col("year") * F.col("survival")).alias("oy"), F.sum(F.col("year") * F.col("fitted")).alias("fy"))
    out = out.where(F.col("dom").isNotNull() | total)  # the cells and the grand total
    return round_all(out.select("trat", "dom", "n", "observed", "fitted", F.when(total, F.col("oy")).alias("observed_by_year"),
                                F.when(total, F.col("fy")).alias("fitted_by_year")), 4, observed_by_year=3, fitted_by_year=3)


# SQL design: the wave and height are shifted and scaled, which leaves the column space as it is.
_SURV_SRC = (f"{PANEL_SQL}, src AS (SELECT wave, trat, dom, sp, (alt0 - 250) / 100 AS z, 1.0::DOUBLE AS n, survival::DOUBLE AS s "
             f"FROM ({long_sql(SUP, 'name', 'survival', IDS + ['alt0'])}) WHERE survival IS NOT NULL AND alt0 IS NOT NULL)")
_SURV_X = {"year": "wave - 3", "alt0": "z"}


def _q3_dominance_sql():
    ctes, mle, lower, upper = predict_sql("m", "src", SURVIVAL, LEVELS, _SURV_X, "binomial", Z, steps=7)
    return (f"WITH RECURSIVE {_SURV_SRC}, {', '.join(ctes)}, a AS (SELECT (avg(alt0) - 250) / 100 AS z FROM panel), "
            f"grid AS (SELECT 1 + {LAST_WAVE - 1} * i / 99.0 AS wave, trat, dom, z FROM a, range(100) t(i), (VALUES ('a'), ('b'), ('c')) x(trat), (VALUES ('dom'), ('sub')) y(dom)) "
            f"SELECT {r('wave')} AS year, trat, dom, {r(mle)} AS p_mle, {r(lower)} AS p_lower, {r(upper)} AS p_upper FROM m, m_v, m_phi, grid")


@query("q3_dominance", _q3_dominance_sql())
def q3_dominance(spark, sf):
    """Predicted survival by wave, treatment and dominance at the mean height."""
    panel, long = survival_long(spark, sf)
    grid = joins.expand_grid(spark, year=joins.number_sequence(1, LAST_WAVE, 100), trat=LEVELS["trat"], dom=LEVELS["dom"])
    grid = grid.drop("grid_id").withColumn("alt0", F.lit(panel.agg(F.avg("alt0")).first()[0]))
    return round_all(predict_ci(survival_model(long), grid).drop("alt0"))


@query("q3_anova", type_ii_sql(_SURV_SRC, "src", SURVIVAL, LEVELS, _SURV_X, "binomial", steps=7))
def q3_anova(spark, sf):
    _, long = survival_long(spark, sf)
    table = anova_ii(long, "survival", SURVIVAL, "binomial", levels={k: LEVELS[k] for k in ("trat", "dom")})
    return round_all(table.select("term", "lr_chisq", "df"), 4)


@query("q3_residuals")
def q3_residuals(spark, sf):
    """Uniformity overall and in every treatment x wave x dominance cell."""
    _, long = survival_long(spark, sf)
    model = survival_model(long)
    res = sim_residuals(model, long, ["id", "wave"], seed=SEED, mode="sim", n=2000).select("trat", "wave", "dom", "residual").persist()
    cells = residual_by_cell(res, ["trat", "wave", "dom"])
    whole = residual_overall(res, sims=2000).select("n", "ks", "ks_p")
    res.unpersist()
    return round_all(joins.union_labelled({"cell": cells, "all": whole}, "scope"), 4)


@query("q3_smooth")
def q3_smooth(spark, sf):
    _, long = survival_long(spark, sf)
    res = sim_residuals(survival_model(long), long, ["id", "wave"], seed=SEED)
    return round_all(residual_smooth(res, "alt0", ["wave", "trat"], knots=5, points=25), 4)


# ---------------------------------------------------------------- height

def height_long(spark, sf):
    long = reshape.to_long(wide_panel(spark, sf), IDS, ALT, "name", "alt", index="wave", base="alt0")
    return long.withColumn("year", F.col("wave").cast("string")).where("wave <> 0")


def height_levels(species: bool = False):
    out = {**{k: LEVELS[k] for k in ("trat", "dom")}, "year": [str(k) for k in range(1, LAST_WAVE + 1)]}
    return {**out, "sp": LEVELS["sp"]} if species else out


def _height_grid(spark, long, species: bool):
    low, high = long.agg(F.min("alt0"), F.max("alt0")).first()
    lists = dict(alt0=joins.number_sequence(low, high, 120), **{k: v for k, v in height_levels(species).items()})
    return joins.expand_grid(spark, **lists).drop("grid_id")


_HEIGHT_SRC = (f"{PANEL_SQL}, src AS (SELECT wave::VARCHAR AS year, trat, dom, sp, alt0, (alt0 - 250) / 100 AS z, 1.0::DOUBLE AS n, alt AS s, ln(alt) AS ln "
               f"FROM ({long_sql(ALT, 'name', 'alt', IDS + ['alt0'])}) WHERE wave <> 0 AND alt IS NOT NULL AND alt0 IS NOT NULL)")
# The square is shifted on its own: a square of the shifted height would bring the linear term with it.
_HEIGHT_X = {"alt0": "z", "I(alt0^2)": "(alt0 * alt0 - 65000) / 50000"}
_HEIGHT_LEVELS = height_levels(True)
_HEIGHT_PHI = ("(SELECT sum(pow((s - mu) / mu, 2)) / (sum(n) - {p}) FROM (SELECT n, s, exp(list_dot_product(b, x)) AS mu FROM mfull, mfull_d))")


def _height_grid_sql(species: bool):
    lists = [("year", height_levels()["year"]), ("trat", LEVELS["trat"]), ("dom", LEVELS["dom"])] + ([("sp", LEVELS["sp"])] if species else [])
    values = ", ".join("(VALUES " + ", ".join(f"('{v}')" for v in vals) + f") g_{c}({c})" for c, vals in lists)
    cols = ", ".join(c for c, _ in lists)
    return (f"SELECT lo + (hi - lo) * i / 119.0 AS alt0, (lo + (hi - lo) * i / 119.0 - 250) / 100 AS z, {cols} FROM "
            f"(SELECT min(alt0) AS lo, max(alt0) AS hi FROM panel), range(120) t(i), {values}")


def _q4_height_sql():
    ctes, mle, lower, upper = predict_sql("m", "src", HEIGHT, _HEIGHT_LEVELS, _HEIGHT_X, "gamma", Z, steps=24)
    return (f"WITH RECURSIVE {_HEIGHT_SRC}, {', '.join(ctes)}, grid AS ({_height_grid_sql(False)}) SELECT {r('alt0', 3)} AS alt0, year, trat, dom, "
            f"{r(mle, 3)} AS p_mle, {r(lower, 3)} AS p_lower, {r(upper, 3)} AS p_upper, 'quadratic' AS name FROM m, m_v, m_phi, grid")


@query("q4_height", _q4_height_sql())
def q4_height(spark, sf):
    long = height_long(spark, sf)
    model = fit_glm(long, "alt", HEIGHT, "gamma", "log", levels=height_levels())
    return round_all(predict_ci(model, _height_grid(spark, long, False), name="quadratic"), 3)


@query("q4_calibration", f"""{W}, l AS (SELECT * FROM ({long_sql(ALT, 'name', 'alt')}) WHERE wave <> 0 AND alt IS NOT NULL AND alt0 IS NOT NULL)
SELECT wave, trat, count(*) AS n, {r('count(*)', 4)} AS ratio_total FROM l GROUP BY ALL""")
def q4_calibration(spark, sf):
    """Sum of observed over fitted: equals the row count in every wave x treatment cell."""
    long = height_long(spark, sf)
    scored = fit_glm(long, "alt", HEIGHT, "gamma", "log", levels=height_levels()).with_mean(long)
    scored = scored.where("alt is not null and fitted is not null")
    return round_all(scored.groupBy("wave", "trat").agg(F.count(F.lit(1)).alias("n"),
                                                        F.sum(F.col("alt") / F.col("fitted")).alias("ratio_total")), 4)


@query("q4_anova", type_ii_sql(_HEIGHT_SRC, "src", HEIGHT, _HEIGHT_LEVELS, _HEIGHT_X, "gamma", _HEIGHT_PHI.format(p=6 * LAST_WAVE + 6)))
def q4_anova(spark, sf):
    table = anova_ii(height_long(spark, sf), "alt", HEIGHT, "gamma", "log", levels=height_levels())
    return round_all(table.select("term", "lr_chisq", "df"), 4)


@query("q4_residuals")
def q4_residuals(spark, sf):
    long = height_long(spark, sf)
    model = fit_glm(long, "alt", HEIGHT, "gamma", "log", levels=height_levels())
    res = sim_residuals(model, long, ["id", "wave"], seed=SEED)
    return round_all(residual_by_cell(res, ["trat", "year", "dom"]), 4)


_Q4_BOX = f"""{W}, b AS (SELECT min(alt0) AS lo0, (max(alt0) - min(alt0)) / 3 AS w FROM panel),
l AS (SELECT *, CASE WHEN alt0 <= lo0 + w THEN 'low' WHEN alt0 <= lo0 + 2 * w THEN 'mid' WHEN alt0 IS NOT NULL THEN 'high' END AS alt_cat
  FROM ({long_sql(ALT, 'name', 'alt')}), b WHERE alt IS NOT NULL)""" + "".join(
    f""", q{i} AS (SELECT trat, wave, {c} AS cell, quantile_cont(alt, 0.25) AS lo, median(alt) AS md, quantile_cont(alt, 0.75) AS hi FROM l GROUP BY ALL),
f{i} AS (SELECT '{name}' AS layer, l.trat, l.wave, q.cell, alt, lo, md, hi, alt BETWEEN lo - 1.5 * (hi - lo) AND hi + 1.5 * (hi - lo) AS inside
  FROM l JOIN q{i} q ON l.trat IS NOT DISTINCT FROM q.trat AND l.wave = q.wave AND {c} IS NOT DISTINCT FROM q.cell)"""
    for i, (name, c) in enumerate((("marginal", "'all'"), ("height", "alt_cat"), ("dominance", "dom"), ("species", "sp")))) + f"""
SELECT layer, trat, wave, cell, count(*) AS n, {r('min(CASE WHEN inside THEN alt END)', 9)} AS ymin, {r('any_value(lo)', 9)} AS lower, {r('any_value(md)', 9)} AS middle,
{r('any_value(hi)', 9)} AS upper, {r('max(CASE WHEN inside THEN alt END)', 9)} AS ymax, count(CASE WHEN NOT inside THEN 1 END) AS n_outliers
FROM (SELECT * FROM f0 UNION ALL SELECT * FROM f1 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f3) GROUP BY ALL"""


def height_boxes(spark, sf):
    """Box layers of height by wave and treatment: overall, by height class, dominance and species, in the same passes."""
    panel = durable(wide_panel(spark, sf).select(*IDS, *ALT))
    panel, _ = clean.cut_equal(panel, "alt0", 3, HEIGHT_CLASSES, out="alt_cat")
    long = reshape.to_long(panel, [*IDS, "alt_cat"], ALT, "name", "alt", index="wave")
    layers = {"marginal": F.lit("all"), "height": "alt_cat", "dominance": "dom", "species": "sp"}
    return summaries.box_layers(long, ["trat", "wave"], layers, "alt")


@query("q4_boxes", _Q4_BOX)
def q4_boxes(spark, sf):
    return round_all(height_boxes(spark, sf)[0], 9)


def spec_label(terms):
    """How the height enters a model: its degree, its crossings, and further variables."""
    names = [[base_column(v) for v in t] for t in terms]
    degree = 2 if any(v != base_column(v) for t in terms for v in t) else 1
    crossed = sorted({v for t in names for v in t if "alt0" in t} - {"alt0"})
    return f"alt0^{degree}" + (" x " + ",".join(crossed) if crossed else "")


HEIGHT_SPECS = {spec_label(terms): terms for terms in (HEIGHT_LINEAR, HEIGHT_PLAIN, HEIGHT, HEIGHT_SPECIES)}


def _q5_sql():
    ctes, parts = [], []
    for i, (name, terms) in enumerate(HEIGHT_SPECS.items()):
        species = terms is HEIGHT_SPECIES
        mine, mle, lower, upper = predict_sql(f"m{i}", "src", terms, _HEIGHT_LEVELS, _HEIGHT_X, "gamma", Z, steps=24)
        ctes += mine
        parts.append(f"SELECT {r('alt0', 3)} AS alt0, year, trat, dom, {'sp' if species else 'NULL::VARCHAR AS sp'}, {r(mle, 3)} AS p_mle, {r(lower, 3)} AS p_lower, "
                     f"{r(upper, 3)} AS p_upper, '{name}' AS name FROM m{i}, m{i}_v, m{i}_phi, {'grid_sp' if species else 'grid'}")
    return (f"WITH RECURSIVE {_HEIGHT_SRC}, {', '.join(ctes)}, grid AS ({_height_grid_sql(False)}), grid_sp AS ({_height_grid_sql(True)}) "
            + " UNION ALL ".join(parts))


@query("q5_models", _q5_sql())
def q5_models(spark, sf):
    """Competing height models side by side, predicted on the same grid."""
    long = height_long(spark, sf)
    out = {}
    for name, terms in HEIGHT_SPECS.items():
        species = terms is HEIGHT_SPECIES
        model = fit_glm(long, "alt", terms, "gamma", "log", levels=height_levels(species))
        out[name] = predict_ci(model, _height_grid(spark, long, species))
    return round_all(joins.union_labelled(out), 3)


@query("q5_location_scale")
def q5_location_scale(spark, sf):
    """Height with a modelled scale: the scaler is fitted on the training rows and reused."""
    long = clean.complete_cases(height_long(spark, sf), ["alt", "alt0"]).withColumn("alt02", F.col("alt0") ** 2)
    long = clean.zscore_apply(long, clean.zscore_fit(long, ["alt02"]))
    model = fit_gamma_ls(long, "alt", HEIGHT_SPECIES, term_list("alt0", "alt02_z", star("year", "trat")),
                         levels=height_levels(True))
    return round_all(model.anova(spark), 4)


# ---------------------------------------------------------------- fruits

# The panel's counts are not overdispersed, so the hurdle study runs on line items:
# excess quantity is the count, flag the treatment, ship year the wave, status the
# dominance and tax the baseline covariate.
FRUIT_P = term_list(star("yr", "l_returnflag"), star("tax", "l_returnflag"), star("tax", "yr"),
                    star("l_linestatus", "l_returnflag"), star("l_linestatus", "yr"))
FRUIT_N = [("yr",), ("l_returnflag",), ("tax",), ("l_linestatus",)]


_FRUIT_LEVELS = {"yr": [str(y) for y in range(1995, 2002)], "l_returnflag": ["A", "N", "R"], "l_linestatus": ["F", "O"]}
_FRUIT_COUNT_COLS = ["1", *[c for _, mine in term_columns(FRUIT_N, _FRUIT_LEVELS, {"tax": "t"}) for c in mine]]
_FRUIT_COUNT = [f"pos AS (SELECT yr, l_returnflag, l_linestatus, tax - 4 AS t, excess AS y, count(*)::DOUBLE AS n FROM lines WHERE excess > 0 GROUP BY ALL)",
                *ztnb_cte("k", "pos", _FRUIT_COUNT_COLS)]


def _q6_sql():
    ctes, mle, _, _ = predict_sql("m", "src", FRUIT_P, _FRUIT_LEVELS, {"tax": "t"}, "binomial", Z, steps=6)
    p = mle.replace("list_dot_product(b,", "list_dot_product(m.b,")
    mu = f"exp(list_dot_product(k.b, {design_list(FRUIT_N, _FRUIT_LEVELS, {'tax': 't'})}))"
    return (f"WITH RECURSIVE {LINES_SQL}, src AS (SELECT yr, l_returnflag, l_linestatus, tax - 4 AS t, count(*)::DOUBLE AS n, sum((excess > 0)::INTEGER)::DOUBLE AS s "
            f"FROM lines GROUP BY ALL), {ctes[0]}, {', '.join(_FRUIT_COUNT[:4])}, "
            f"cells AS (SELECT yr, l_returnflag, l_linestatus, avg(tax) AS tax, avg(tax) - 4 AS t, avg((excess > 0)::INTEGER) AS seen_p, avg(excess) AS seen_mean FROM lines GROUP BY ALL), "
            f"out AS (SELECT cells.*, {p} AS p, {mu} AS mu, exp(k.c) AS size FROM cells, m, k) "
            f"SELECT yr, l_returnflag, l_linestatus, {r('tax', 4)} AS tax, {r('seen_p', 4)} AS seen_p, {r('seen_mean', 4)} AS seen_mean, {r('p', 4)} AS p_positive, "
            f"{r('mu / (1 - pow(size / (size + mu), size))', 4)} AS mean_positive, {r('p * mu / (1 - pow(size / (size + mu), size))', 4)} AS expected FROM out")


@query("q6_hurdle", _q6_sql())
def q6_hurdle(spark, sf):
    df = lines(spark, sf)
    model = fit_hurdle(df, "excess", FRUIT_P, FRUIT_N)
    cells = df.groupBy("yr", "l_returnflag", "l_linestatus").agg(
        F.avg("tax").alias("tax"), F.avg((F.col("excess") > 0).cast("double")).alias("seen_p"), F.avg("excess").alias("seen_mean"))
    return round_all(model.predict(cells), 4)


@query("q6_wald", f"WITH RECURSIVE {LINES_SQL}, {', '.join(_FRUIT_COUNT)} " + " UNION ALL ".join(
    f"SELECT '{t}' AS term, {len(at)} AS df, {r(wald_sql('k', at), 3)} AS chisq"
    for t, at in (("yr", range(2, 8)), ("l_returnflag", (8, 9)), ("tax", (10,)), ("l_linestatus", (11,)))))
def q6_wald(spark, sf):
    model = fit_ztnb(lines(spark, sf).where(F.col("excess") > 0), "excess", FRUIT_N)
    return round_all(anova_wald(spark, model).select("term", "df", "chisq"), 3)


_FRUIT_BOX = """q AS (SELECT yr, l_returnflag, l_linestatus, quantile_cont(excess + 1, 0.25) AS lo, median(excess + 1) AS md, quantile_cont(excess + 1, 0.75) AS hi FROM lines GROUP BY ALL),
f AS (SELECT lines.*, lo, md, hi, excess + 1 BETWEEN lo - 1.5 * (hi - lo) AND hi + 1.5 * (hi - lo) AS inside FROM lines JOIN q USING (yr, l_returnflag, l_linestatus))"""


@query("q6_boxes", f"""WITH {LINES_SQL}, {_FRUIT_BOX} SELECT yr, l_returnflag, l_linestatus, count(*) AS n, {r('min(CASE WHEN inside THEN excess + 1 END)')} AS ymin, {r('any_value(lo)')} AS lower,
{r('any_value(md)')} AS middle, {r('any_value(hi)')} AS upper, {r('max(CASE WHEN inside THEN excess + 1 END)')} AS ymax, count(CASE WHEN NOT inside THEN 1 END) AS n_outliers FROM f GROUP BY ALL""")
def q6_boxes(spark, sf):
    df = lines(spark, sf).withColumn("shown", F.col("excess") + 1)
    return round_all(summaries.box_stats(df, ["yr", "l_returnflag", "l_linestatus"], "shown")[0])


@query("q6_count_residuals")
def q6_count_residuals(spark, sf):
    df = lines(spark, sf).where("excess > 0")
    model = fit_ztnb(lines(spark, sf).where(F.col("excess") > 0), "excess", FRUIT_N)
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    return round_all(residual_by_cell(sim_residuals(model, df, key, seed=SEED), ["yr"]), 4)


@query("q13_fruit_prob", f"""WITH {LINES_SQL} SELECT yr, l_returnflag, count(*) AS n, {r('avg((excess > 0)::INTEGER)')} AS observed, {r('avg((excess > 0)::INTEGER)')} AS fitted FROM lines GROUP BY ALL""")
def q13_fruit_prob(spark, sf):
    """Observed and fitted probability of a positive count per wave and treatment."""
    df = clean.indicator(lines(spark, sf), F.col("excess") > 0, "positive")
    scored = fit_glm(df, "positive", FRUIT_P, "binomial").with_mean(df)
    return round_all(scored.groupBy("yr", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.avg("positive").alias("observed"),
                                                              F.avg("fitted").alias("fitted")))


def _q13_sql():
    ctes, mle, lower, upper = predict_sql("m", "src", FRUIT_P, _FRUIT_LEVELS, {"tax": "t"}, "binomial", Z, steps=6)
    return (f"WITH RECURSIVE {LINES_SQL}, src AS (SELECT yr, l_returnflag, l_linestatus, tax - 4 AS t, count(*)::DOUBLE AS n, sum((excess > 0)::INTEGER)::DOUBLE AS s "
            f"FROM lines GROUP BY ALL), {', '.join(ctes)}, grid AS (SELECT yr, l_returnflag, l_linestatus, mid AS tax, mid - 4 AS t FROM "
            f"(SELECT DISTINCT yr, l_returnflag, l_linestatus FROM lines), (SELECT avg(tax) AS mid FROM lines)) "
            f"SELECT yr, l_returnflag, l_linestatus, {r('tax', 5)} AS tax, {r(mle, 5)} AS p_mle, {r(lower, 5)} AS p_lower, {r(upper, 5)} AS p_upper FROM m, m_v, m_phi, grid")


@query("q13_predictions", _q13_sql())
def q13_predictions(spark, sf):
    df = clean.indicator(lines(spark, sf), F.col("excess") > 0, "positive")
    model = fit_glm(df, "positive", FRUIT_P, "binomial")
    mean_tax = df.agg(F.avg("tax")).first()[0]
    lv = model.design.levels
    grid = joins.expand_grid(spark, yr=lv["yr"], l_returnflag=lv["l_returnflag"], l_linestatus=lv["l_linestatus"])
    return round_all(predict_ci(model, grid.drop("grid_id").withColumn("tax", F.lit(mean_tax))), 5)


def _q13_classes_sql():
    ctes, mle, lower, upper = predict_sql("m", "src", FRUIT_P, _FRUIT_LEVELS, {"tax": "t"}, "binomial", Z, steps=6)
    bins = "CASE WHEN tax <= lo + w THEN 'low' WHEN tax <= lo + 2 * w THEN 'mid' ELSE 'high' END"
    return (f"WITH RECURSIVE {LINES_SQL}, b AS (SELECT min(tax) AS lo, (max(tax) - min(tax)) / 3 AS w FROM lines), k AS (SELECT lines.*, {bins} AS class FROM lines, b), "
            f"src AS (SELECT yr, l_returnflag, l_linestatus, tax - 4 AS t, count(*)::DOUBLE AS n, sum((excess > 0)::INTEGER)::DOUBLE AS s FROM lines GROUP BY ALL), {', '.join(ctes)}, "
            f"grid AS (SELECT o.*, mid - 4 AS t FROM (SELECT yr, l_returnflag, l_linestatus, class, avg((excess > 0)::INTEGER) AS seen, count(*) AS n_lines FROM k GROUP BY ALL) o "
            f"JOIN (SELECT class, avg(tax) AS mid FROM k GROUP BY class) c USING (class)) "
            f"SELECT yr, l_returnflag, l_linestatus, class, n_lines, {r('seen', 5)} AS observed, {r(mle, 5)} AS p_mle, {r(lower, 5)} AS p_lower, {r(upper, 5)} AS p_upper FROM m, m_v, m_phi, grid")


@query("q13_classes", _q13_classes_sql())
def q13_classes(spark, sf):
    """Probability of a positive count at the mean of three classes of the covariate, beside the observed shares."""
    df = clean.indicator(lines(spark, sf), F.col("excess") > 0, "positive")
    df, _ = clean.cut_equal(df, "tax", 3, HEIGHT_CLASSES, out="class")
    model = fit_glm(df, "positive", FRUIT_P, "binomial")
    middle = summaries.group_mean(df, "class", ["tax"])
    seen = df.groupBy("yr", "l_returnflag", "l_linestatus", "class").agg(F.count(F.lit(1)).alias("n_lines"), F.avg("positive").alias("observed"))
    return round_all(predict_ci(model, joins.left_join(seen, middle, ["class"])).drop("tax"), 5)


def _species_height_sql():
    terms = term_list(HEIGHT, "sp")
    ctes, mle, lower, upper = predict_sql("m", "src", terms, _HEIGHT_LEVELS, _HEIGHT_X, "gamma", Z, steps=24)
    return (f"WITH RECURSIVE {_HEIGHT_SRC}, {', '.join(ctes)}, grid AS ({_height_grid_sql(True)}) SELECT {r('alt0', 3)} AS alt0, year, trat, dom, sp, "
            f"{r(mle, 3)} AS p_mle, {r(lower, 3)} AS p_lower, {r(upper, 3)} AS p_upper FROM m, m_v, m_phi, grid")


@query("q7_height_prediction", _species_height_sql())
def q7_height_prediction(spark, sf):
    """Heights of the model with the species beside the other terms, on the grid with species."""
    long = height_long(spark, sf)
    model = fit_glm(long, "alt", term_list(HEIGHT, "sp"), "gamma", "log", levels=height_levels(True))
    return round_all(predict_ci(model, _height_grid(spark, long, True)), 3)


# ---------------------------------------------------------------- species tables

_SP_LINES = LINES_SQL.replace("lines AS (SELECT *,", "lines AS (SELECT *, CASE WHEN l_suppkey % 2 = 0 THEN 'ang' ELSE 'ata' END AS sp,")
_FRUIT_LEVELS_SP = {**_FRUIT_LEVELS, "sp": LEVELS["sp"]}


def _q7_sql():
    fruit_src = (f"{_SP_LINES}, src AS (SELECT yr, l_returnflag, l_linestatus, sp, tax - 4 AS t, count(*)::DOUBLE AS n, "
                 f"sum((excess > 0)::INTEGER)::DOUBLE AS s FROM lines GROUP BY ALL)")
    lr = {"survival": type_ii_sql(_SURV_SRC, "src", term_list(SURVIVAL, "sp"), LEVELS, _SURV_X, "binomial", steps=7),
          "height": type_ii_sql(_HEIGHT_SRC, "src", term_list(HEIGHT, "sp"), _HEIGHT_LEVELS, _HEIGHT_X, "gamma", _HEIGHT_PHI.format(p=6 * LAST_WAVE + 7)),
          "fruit probability": type_ii_sql(fruit_src, "src", term_list(FRUIT_P, "sp"), _FRUIT_LEVELS_SP, {"tax": "t"}, "binomial", steps=6)}
    terms = [*FRUIT_N, ("sp",)]
    cols = term_columns(terms, _FRUIT_LEVELS_SP, {"tax": "t"})
    pos = ("pos AS (SELECT yr, l_returnflag, l_linestatus, sp, tax - 4 AS t, excess AS y, count(*)::DOUBLE AS n FROM lines WHERE excess > 0 GROUP BY ALL)")
    ctes = ztnb_cte("k", "pos", ["1", *[c for _, mine in cols for c in mine]])
    rows, at = [], 2
    for term, mine in cols:
        rows.append(f"SELECT '{term[0]}' AS term, {len(mine)} AS df, {r(wald_sql('k', range(at, at + len(mine))), 3)} AS wald_chisq")
        at += len(mine)
    wald = f"WITH RECURSIVE {_SP_LINES}, {pos}, {', '.join(ctes)} " + " UNION ALL ".join(rows)
    parts = [f"SELECT '{name}' AS model, term, lr_chisq, df, NULL::DOUBLE AS wald_chisq FROM ({sql})" for name, sql in lr.items()]
    return " UNION ALL ".join([*parts, f"SELECT 'fruit count', term, NULL, df, wald_chisq FROM ({wald})"])


@query("q7_species", _q7_sql())
def q7_species(spark, sf):
    """Type-II tables of the survival, height and fruit models with the species added."""
    _, surv = survival_long(spark, sf)
    two = {k: LEVELS[k] for k in ("trat", "dom", "sp")}
    height = height_long(spark, sf)
    df = lines(spark, sf).withColumn("sp", F.when(F.col("l_suppkey") % 2 == 0, "ang").otherwise("ata"))
    positive = fit_ztnb(df.where(F.col("excess") > 0), "excess", [*FRUIT_N, ("sp",)])
    fruit = anova_ii(clean.indicator(df, F.col("excess") > 0, "positive"), "positive", term_list(FRUIT_P, "sp"), "binomial")
    tables = {
        "survival": anova_ii(surv, "survival", term_list(SURVIVAL, "sp"), "binomial", levels=two),
        "height": anova_ii(height, "alt", term_list(HEIGHT, "sp"), "gamma", "log", levels=height_levels(True)),
        "fruit probability": fruit,
        "fruit count": anova_wald(spark, positive).withColumnRenamed("chisq", "wald_chisq"),
    }
    return round_all(joins.union_labelled(tables, "model").drop("position", "p_value"), 4, wald_chisq=3)


# ---------------------------------------------------------------- smaller studies

@query("q8_first_growth", f"""{W}, d AS (SELECT alt1 - tocon0 AS y, alt0 AS x FROM panel WHERE alt0 IS NOT NULL AND alt1 - tocon0 IS NOT NULL),
t AS (SELECT count(*)::DOUBLE AS n, regr_slope(y, x) AS b, regr_r2(y, x) AS r2, var_pop(y) * count(*) AS syy, var_pop(x) * count(*) AS sxx FROM d),
e AS (SELECT *, syy * (1 - r2) / (n - 2) AS s2 FROM t)
SELECT 'alt0' AS term, {r('b')} AS slope, {r('sqrt(s2 / sxx)')} AS std_error, {r('b * b * sxx / s2', 5)} AS f_statistic, {r('r2')} AS r_squared, n::BIGINT AS n FROM e""")
def q8_first_growth(spark, sf):
    df = wide_panel(spark, sf).withColumn("growth1", F.col("alt1") - F.col("tocon0"))
    model, table = fit_and_test(df, "growth1", [("alt0",)])
    slope = model.coef_table(spark).where("term = 'alt0'").select("term", F.col("estimate").alias("slope"), "std_error")
    return round_all(slope.join(table.select("term", "f_statistic"), "term")
                     .withColumn("r_squared", F.lit(1 - model.deviance / model.null_deviance)).withColumn("n", F.lit(model.n).cast("long")),
                     f_statistic=5)


@query("q9_total_nb", f"""{W}, d AS (SELECT trat, {' + '.join(f'coalesce({c},0)' for c in FRUTOS[1:])} AS y FROM panel)
SELECT trat, {r('avg(y)', 4)} AS fitted FROM d GROUP BY trat""")
def q9_total_nb(spark, sf):
    """Total count per subject by treatment, without intercept; fitted values are the group means."""
    df = clean.row_sum(wide_panel(spark, sf), FRUTOS[1:], "frut_sum")
    model = fit_negbin(df, "frut_sum", [("trat",)], levels={"trat": LEVELS["trat"]}, intercept=False)
    return round_all(model.fitted(df), 4)


_Q9 = f"""{W}, d AS (SELECT trat, {' + '.join(f'coalesce({c},0)' for c in FRUTOS[1:])} AS y FROM panel),
m AS (SELECT trat, y, avg(y) OVER (PARTITION BY trat) AS mu, avg(y) OVER () AS m0, count(*) OVER (PARTITION BY trat) AS n FROM d)"""


# The totals show no overdispersion: the score of 1/k is negative and the fit is the Poisson one.
@query("q9_coefficients", f"""{_Q9}, s AS (SELECT sum(0.5 * (pow(y - mu, 2) - y)) / sqrt(sum(0.5 * mu * mu)) AS z FROM m)
SELECT 'trat' || trat AS term, {r('ln(any_value(mu))')} AS estimate, {r('1 / sqrt(any_value(n) * any_value(mu))')} AS std_error, any_value(z) <= 0 AS poisson_limit, {r('any_value(z)')} AS score_z
FROM m, s GROUP BY trat""")
def q9_coefficients(spark, sf):
    """Coefficients of the total count by treatment, and the score test of the size at its boundary."""
    df = clean.row_sum(wide_panel(spark, sf), FRUTOS[1:], "frut_sum")
    model = fit_negbin(df, "frut_sum", [("trat",)], levels={"trat": LEVELS["trat"]}, intercept=False)
    return round_all(model.coef_table(spark).where("term <> 'log(k)'").select("term", "estimate", "std_error", F.lit(model.poisson_limit).alias("poisson_limit"),
                                                                            F.lit(model.boundary_z).cast("double").alias("score_z")))


@query("q9_anova", f"""{_Q9} SELECT 'trat' AS term, 2::INTEGER AS df, {r('2 * sum(y * ln(mu / m0))', 5)} AS lr_chisq, {r('exp(-sum(y * ln(mu / m0)))')} AS p_value FROM m""")
def q9_anova(spark, sf):
    """Type-II table of the total count by treatment."""
    df = clean.row_sum(wide_panel(spark, sf), FRUTOS[1:], "frut_sum")
    levels = {"trat": LEVELS["trat"]}
    table = anova_negbin(df, "frut_sum", [("trat",)], fit_negbin(df, "frut_sum", [("trat",)], levels=levels), levels=levels)
    return round_all(table.select("term", "df", "lr_chisq", "p_value"), 6, lr_chisq=5)


@query("q9_by_time", f"""{W.replace('WITH', 'WITH RECURSIVE', 1)}, d AS (SELECT {' + '.join(f'coalesce({c},0)' for c in FRUTOS[1:])} AS y, ({' + '.join(f'coalesce({c},0)' for c in TIME[1:])} - 100) / 50 AS x
  FROM panel WHERE trat = 'b'), {stencil_newton_2d("z", "d", "y * (u + v * x) - exp(u + v * x)", ("ln(avg(y))", "0.0::DOUBLE"))},
i AS (SELECT sum(exp(u + v * x)) AS a, sum(x * exp(u + v * x)) AS b, sum(x * x * exp(u + v * x)) AS c FROM d, z)
SELECT 't_resprout' AS term, {r('v / 50', 6)} AS estimate, {r('sqrt(a / (a * c - b * b)) / 50', 6)} AS std_error, {r('v / sqrt(a / (a * c - b * b))', 1)} AS statistic FROM z, i""")
def q9_by_time(spark, sf):
    """Total count on the total cutting time within one treatment."""
    df = clean.row_sum(clean.row_sum(wide_panel(spark, sf), FRUTOS[1:], "frut_sum"), TIME[1:], "t_resprout").where("trat = 'b'")
    table = fit_negbin(df, "frut_sum", [("t_resprout",)]).coef_table(spark)
    return round_all(table.where("term = 't_resprout'").select("term", "estimate", "std_error", "statistic"), 6, statistic=1)


@query("q10_total_time", f"""{W}, d AS (SELECT trat, CASE WHEN t = 0 THEN 1e-5 ELSE t END AS t FROM (SELECT trat, {' + '.join(f'coalesce({c},0)' for c in TIME[1:])} AS t FROM panel))
SELECT trat, {r('avg(t)')} AS fitted, {r(f'avg(t) / {LAST_WAVE - 1}')} AS per_year FROM d GROUP BY trat""")
def q10_total_time(spark, sf):
    df = clean.row_sum(wide_panel(spark, sf), TIME[1:], "t_resprout")
    df = df.withColumn("t_resprout", F.when(F.col("t_resprout") == 0, F.lit(1e-5)).otherwise(F.col("t_resprout")))
    model = fit_glm(df, "t_resprout", [("trat",)], "gamma", "log", levels={"trat": LEVELS["trat"]})
    return round_all(model.fitted(df).withColumn("per_year", F.col("fitted") / (LAST_WAVE - 1)))


@query("q10_anova", f"""{W}, d AS (SELECT trat, CASE WHEN t = 0 THEN 1e-5 ELSE t END AS t FROM (SELECT trat, {' + '.join(f'coalesce({c},0)' for c in TIME[1:])} AS t FROM panel)),
c AS (SELECT t, avg(t) OVER (PARTITION BY trat) AS mu, avg(t) OVER () AS m FROM d),
e AS (SELECT 2 * sum(ln(m) - ln(mu)) AS gap, sum((t - mu) * (t - mu) / (mu * mu)) / (count(*) - 3) AS phi FROM c)
SELECT 'trat' AS term, {r('gap / phi', 5)} AS lr_chisq, 2::INTEGER AS df, {r('exp(-gap / phi / 2)', 6)} AS p_value FROM e""")
def q10_anova(spark, sf):
    """Type-II table of the total time by treatment."""
    df = clean.row_sum(wide_panel(spark, sf), TIME[1:], "t_resprout")
    df = df.withColumn("t_resprout", F.when(F.col("t_resprout") == 0, F.lit(1e-5)).otherwise(F.col("t_resprout")))
    table = anova_ii(df, "t_resprout", [("trat",)], "gamma", "log", levels={"trat": LEVELS["trat"]})
    return round_all(table.select("term", "lr_chisq", "df", "p_value"), 6, lr_chisq=5)


def time_by_size(spark, sf):
    long = reshape.to_long_multi(wide_panel(spark, sf), ["id"], {"time": TIME, "alt": ALT}, "year")
    return long.withColumn("type", F.when(F.col("year") == 0, "baseline").otherwise("later waves"))


_Q11_X = {"alt": "(alt - 250) / 100"}
_Q11_TERMS = [("alt",), ("type",), ("alt", "type")]


def _q11_sql():
    long = " UNION ALL ".join(f"SELECT '{'baseline' if k == 0 else 'later waves'}' AS type, t{k} AS time, alt{k} AS alt FROM panel" for k in range(LAST_WAVE + 1))
    ctes, mle, lower, upper = predict_sql("m", "src", _Q11_TERMS, {"type": ["baseline", "later waves"]}, _Q11_X, "gamma", Z, steps=40)
    return (f"{W.replace('WITH', 'WITH RECURSIVE', 1)}, src AS (SELECT type, alt, 1.0::DOUBLE AS n, time AS s, ln(time) AS ln FROM ({long}) WHERE time IS NOT NULL AND alt IS NOT NULL), "
            f"{', '.join(ctes)}, grid AS (SELECT type, lo + (hi - lo) * i / 79.0 AS alt FROM (SELECT type, min(alt) AS lo, max(alt) AS hi FROM src GROUP BY type), range(80) t(i)) "
            f"SELECT type, {r('alt', 8)} AS alt, {r(mle, 8)} AS p_mle, {r(lower, 8)} AS p_lower, {r(upper, 8)} AS p_upper FROM m, m_v, m_phi, grid")


@query("q11_time_size", _q11_sql())
def q11_time_size(spark, sf):
    return round_all(fit_curve(time_by_size(spark, sf), "alt", "time", "type", n=80), 8)


def _q11_anova_sql():
    long = " UNION ALL ".join(f"SELECT '{'baseline' if k == 0 else 'later waves'}' AS type, t{k} AS time, alt{k} AS alt FROM panel" for k in range(LAST_WAVE + 1))
    src = f"{PANEL_SQL}, src AS (SELECT type, alt, 1.0::DOUBLE AS n, time AS s, ln(time) AS ln FROM ({long}) WHERE time IS NOT NULL AND alt IS NOT NULL)"
    return type_ii_sql(src, "src", _Q11_TERMS, {"type": ["baseline", "later waves"]}, _Q11_X, "gamma", _HEIGHT_PHI.format(p=4), steps=40)


@query("q11_anova", _q11_anova_sql())
def q11_anova(spark, sf):
    """Type-II table of the cutting time by size and type."""
    return round_all(anova_ii(time_by_size(spark, sf), "time", _Q11_TERMS, "gamma", "log").select("term", "lr_chisq", "df"), 4)


@query("q11_calibration", f"""{W}, l AS ({' UNION ALL '.join(f"SELECT '{'baseline' if k == 0 else 'later waves'}' AS type, t{k} AS time, alt{k} AS alt FROM panel" for k in range(LAST_WAVE + 1))})
SELECT type, count(*) AS n, {r('count(*)', 4)} AS ratio_total, {r('sum(alt) / 1000', 4)} AS weighted_total FROM l WHERE time IS NOT NULL AND alt IS NOT NULL GROUP BY type""")
def q11_calibration(spark, sf):
    df = time_by_size(spark, sf)
    scored = fit_glm(df, "time", [("alt",), ("type",), ("alt", "type")], "gamma", "log").with_mean(df)
    scored = scored.where("time is not null and fitted is not null")
    ratio = F.col("time") / F.col("fitted")
    return round_all(scored.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum(ratio).alias("ratio_total"),
                                                (F.sum(F.col("alt") * ratio) / 1000).alias("weighted_total")), 4)


_SIX = ", ".join([f"{r('min(alt0)')} AS \"min\"", f"{r('quantile_cont(alt0, 0.25)', 9)} AS q1", f"{r('median(alt0)', 9)} AS median", f"{r('avg(alt0)')} AS mean",
                  f"{r('quantile_cont(alt0, 0.75)', 9)} AS q3", f"{r('max(alt0)')} AS \"max\"", "count(alt0) AS n"])


@query("q12_baseline", f"{W} SELECT dom, {_SIX} FROM panel WHERE alt0 IS NOT NULL GROUP BY dom")
def q12_baseline(spark, sf):
    return round_all(summaries.six_num(wide_panel(spark, sf), "alt0", "dom"), 6, q1=9, median=9, q3=9)


@query("q12_species", f"""{W}, c AS (SELECT sp, dom, count(*) AS n FROM panel GROUP BY ALL) SELECT sp, dom, n, {r('n / sum(n) OVER (PARTITION BY sp)')} AS prop FROM c""")
def q12_species(spark, sf):
    return round_all(summaries.crosstab_prop(wide_panel(spark, sf), "sp", "dom", LEVELS["sp"], LEVELS["dom"]))


@query("q12_lm", f"""{W}, m AS (SELECT dom, avg(alt0) AS m, count(alt0)::DOUBLE AS n, var_pop(alt0) * count(alt0) AS ss FROM panel WHERE alt0 IS NOT NULL GROUP BY dom),
t AS (SELECT max(CASE dom WHEN 'dom' THEN m END) AS a, max(CASE dom WHEN 'sub' THEN m END) AS b, sum(ss) / (sum(n) - 2) AS s2, sum(1 / n) AS v, max(CASE dom WHEN 'dom' THEN 1 / n END) AS va FROM m)
SELECT '(Intercept)' AS term, {r('a')} AS estimate, {r('sqrt(s2 * va)')} AS std_error FROM t UNION ALL SELECT 'domsub', {r('b - a')}, {r('sqrt(s2 * v)')} FROM t""")
def q12_lm(spark, sf):
    model = fit_glm(wide_panel(spark, sf), "alt0", [("dom",)], levels={"dom": LEVELS["dom"]})
    return round_all(model.coef_table(spark).select("term", "estimate", "std_error"))
