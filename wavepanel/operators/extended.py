"""Gamma models with a modelled scale, and Gamma models with a random intercept per subject."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavepanel.functions import numeric
from wavepanel.functions.results import result_table
from wavepanel.functions.storage import BROADCAST_ROWS, durable
from wavepanel.operators.families import Family
from wavepanel.operators.glm import (PATTERN_SHARE, LinearModel, ModelInputs, independent_columns, narrow,
                                     partial_sums, sum_arrays)
from wavepanel.operators.hypothesis import wald_table
from wavepanel.operators.terms import Design

GAMMA_LOG = Family("gamma", "log", False)
SALT = 16                    # copies of a group's row where groups are joined by shuffle


def _coefficient_rows(labels, beta, cov):
    se = np.sqrt(np.diag(cov))
    return [(label, b, s, b / s, numeric.normal_two_sided(b / s)) for label, b, s in zip(labels, beta, se, strict=True)]


# ---------------------------------------------------------------- location and scale

@dataclass
class GammaScaleModel(LinearModel):
    """log mean on one term list, log dispersion on another; maximum likelihood."""

    design: Design
    scale_design: Design
    family: Family
    y: str
    n: int
    cols: list[int]
    beta_scaled: np.ndarray
    cov_scaled: np.ndarray
    scale_cols: list[int]
    scale_beta_scaled: np.ndarray
    scale_cov_scaled: np.ndarray
    log_likelihood: float
    converged: bool
    passes: int
    dispersion: float = 1.0
    warnings: list[str] = field(default_factory=list)

    def __post_init__(self):
        a = self.design.unscale()[:, self.cols]
        self.beta, self.cov = a @ self.beta_scaled, (a @ self.cov_scaled @ a.T)[np.ix_(self.cols, self.cols)]
        s = self.scale_design.unscale()[:, self.scale_cols]
        self.scale_beta = s @ self.scale_beta_scaled
        self.scale_cov = (s @ self.scale_cov_scaled @ s.T)[np.ix_(self.scale_cols, self.scale_cols)]

    def coef_table(self, spark: SparkSession) -> DataFrame:
        names = self.scale_design.labels()
        mean = _coefficient_rows(self.labels, self.beta[self.cols], self.cov)
        scale = _coefficient_rows([names[j] for j in self.scale_cols], self.scale_beta[self.scale_cols], self.scale_cov)
        rows = [(i, "mean", *r) for i, r in enumerate(mean)]
        rows += [(len(mean) + i, "scale", *r) for i, r in enumerate(scale)]
        return result_table(spark, rows, "position int, part string, term string, estimate double, "
                                         "std_error double, statistic double, p_value double")

    def anova(self, spark: SparkSession) -> DataFrame:
        """Wald table of the parametric terms of both parts."""
        mean = wald_table(spark, self.design, self.cols, self.beta[self.cols], self.cov).withColumn("part", F.lit("mean"))
        scale = wald_table(spark, self.scale_design, self.scale_cols, self.scale_beta[self.scale_cols], self.scale_cov)
        return mean.unionByName(scale.withColumn("part", F.lit("scale")))

    @property
    def aic(self) -> float:
        return 2 * (len(self.cols) + len(self.scale_cols)) - 2 * self.log_likelihood


def fit_gamma_ls(df: DataFrame, y: str, mean_terms: Sequence[tuple], scale_terms: Sequence[tuple],
                 levels: Mapping | None = None, max_passes: int = 60) -> GammaScaleModel:
    """Fisher scoring on both parts at once; they are orthogonal, so one pass gives both steps."""
    inputs = ModelInputs(df, y, [*mean_terms, *scale_terms], levels)
    n, bad, patterns, stats = inputs.probe(F.col("__y") <= 0)
    if not n:
        raise ValueError("no complete rows to fit")
    if bad:
        raise ValueError(f"{bad} values of {y!r} are not positive")
    mean, scale = Design(mean_terms, inputs.levels), Design(scale_terms, inputs.levels, tag="s")
    for d in (mean, scale):
        d.standardise({v: stats[v] for v in d.numerics})
    names = [*mean.input_names(), *scale.input_names()]
    rows = inputs.rows.select(*mean.input_columns(), *scale.input_columns(), "__y")
    if patterns <= max(PATTERN_SHARE * n, 1):
        data = rows.groupBy(*names).agg(F.count(F.lit(1)).cast("double").alias("__n"), F.avg("__y").alias("__m"),
                                        F.sum(F.log("__y")).alias("__ln"))
        cached = durable(data)
        data = narrow(df.sparkSession, cached, patterns)
    else:
        data = rows.select(*names, F.lit(1.0).alias("__n"), F.col("__y").alias("__m"), F.log("__y").alias("__ln"))
        cached = data = data.persist(StorageLevel.MEMORY_AND_DISK)
    p1, p2 = mean.p, scale.p

    def unpack(v, k):
        m = np.zeros((k, k))
        m[np.triu_indices(k)] = v
        return m + np.triu(m, 1).T

    def system(par):
        def kernel(batch):
            n_, m, ln = (batch[c].to_numpy(float) for c in ("__n", "__m", "__ln"))
            x, z = mean.matrix(batch), scale.matrix(batch)
            if par is None:
                eta, zeta = ln / n_, np.zeros(len(batch))
                work, w1 = eta, n_
                w2, s2, ll = n_, np.zeros(len(batch)), np.zeros(1)
            else:
                eta, zeta = x @ par[0], z @ par[1]
                ratio = m * np.exp(-eta)
                nu = np.exp(-zeta)
                psi = numeric.digamma(nu)
                ll = n_ * (nu * np.log(nu) - nu * eta - numeric.lgamma(nu) - nu * ratio) + (nu - 1) * ln
                work, w1 = ratio - 1, n_ * nu
                s2 = -nu * (n_ * (np.log(nu) + 1 - eta - psi - ratio) + ln)
                w2 = n_ * nu * (nu * numeric.trigamma(nu) - 1)
            a = x.T @ (x * w1[:, None])
            b = z.T @ (z * w2[:, None])
            return np.concatenate([a[np.triu_indices(p1)], b[np.triu_indices(p2)], x.T @ (w1 * work), z.T @ s2, [ll.sum()]])
        v = sum_arrays(data.mapInPandas(partial_sums(kernel), "v array<double>"))
        t1, t2 = p1 * (p1 + 1) // 2, p2 * (p2 + 1) // 2
        rest = v[t1 + t2:]
        return unpack(v[:t1], p1), unpack(v[t1:t1 + t2], p2), rest[:p1], rest[p1:p1 + p2], rest[-1]

    def solve(a, b, cols):
        out = np.zeros(len(b))
        out[cols] = np.linalg.solve(a[np.ix_(cols, cols)], b[cols])
        return out

    try:
        a, b, s1, _, _ = system(None)
        c1, c2 = independent_columns(a), independent_columns(b)
        par = (solve(a, s1, c1), np.zeros(p2))
        best, converged = None, False
        for passes in range(2, max_passes + 2):
            a, b, s1, s2, ll = system(par)
            if best is not None and not ll >= best[1] - 1e-9 * (abs(best[1]) + 1):
                par = tuple((u + v) / 2 for u, v in zip(par, best[0], strict=True))
                continue
            best = (par, ll)
            d1, d2 = solve(a, s1, c1), solve(b, s2, c2)
            gain = float(d1 @ s1 + d2 @ s2)
            widest = np.abs(d2).max() if len(d2) else 0.0
            if gain < 1e-8 + 1e-14 * abs(ll):
                converged = True
            elif widest > 2:
                d1, d2 = d1 * 2 / widest, d2 * 2 / widest
            par = (par[0] + d1, par[1] + d2)
            if converged:
                break
    finally:
        cached.unpersist()
    if not converged:
        raise ArithmeticError(f"the location-scale fit did not converge in {max_passes} passes")
    return GammaScaleModel(
        mean, scale, GAMMA_LOG, y, int(n), c1, par[0][c1], np.linalg.inv(a[np.ix_(c1, c1)]), c2, par[1][c2],
        np.linalg.inv(b[np.ix_(c2, c2)]), float(ll), converged, passes)


# ---------------------------------------------------------------- random intercept

@dataclass
class RandomInterceptModel(LinearModel):
    """Gamma log-link model with a normal intercept per group; fixed effects are conditional on it.

    ``cov_scaled`` covers the coefficients, log sigma and log shape: the inverse of the observed information.
    """

    design: Design
    family: Family
    y: str
    n: int
    groups: int
    cols: list[int]
    beta_scaled: np.ndarray
    cov_scaled: np.ndarray
    sigma: float
    shape: float
    log_likelihood: float
    converged: bool
    passes: int
    warnings: list[str] = field(default_factory=list)

    def __post_init__(self):
        a = self.design.unscale()[:, self.cols]
        k = len(self.cols)
        self.beta = a @ self.beta_scaled
        self.cov = (a @ self.cov_scaled[:k, :k] @ a.T)[np.ix_(self.cols, self.cols)]
        self.dispersion = 1 / self.shape

    def coef_table(self, spark: SparkSession) -> DataFrame:
        rows = _coefficient_rows(self.labels, self.beta[self.cols], self.cov)
        rows = [(i, *r) for i, r in enumerate(rows)]
        for i, (label, value) in enumerate((("sd(group intercept)", self.sigma), ("shape", self.shape))):
            spread = float(self.cov_scaled[len(self.cols) + i, len(self.cols) + i])
            rows.append((len(rows), label, value, value * math.sqrt(spread) if spread > 0 else None, None, None))
        return result_table(spark, rows, "position int, term string, estimate double, std_error double, "
                                         "statistic double, p_value double")


def posterior_nodes(n, ln, e, s, sigma: float, nu: float, t: np.ndarray, wt: np.ndarray):
    """Adaptive quadrature of each group's standard normal intercept b: nodes, exp(-sigma b), posterior weights, log-likelihood.

    n rows, sums of log y, of eta and of y exp(-eta) are all that a group's likelihood needs.
    """
    b = np.log(s / n) * sigma * nu * n / (1 + nu * n * sigma * sigma)
    for _ in range(50):
        pull = nu * s * np.exp(-sigma * b)
        step = np.clip((sigma * (pull - nu * n) - b) / (1 + sigma * sigma * pull), -2, 2)
        b = b + step
        if np.abs(step).max() < 1e-10:
            break
    width = 1 / np.sqrt(1 + sigma * sigma * nu * s * np.exp(-sigma * b))
    at = b[:, None] + math.sqrt(2) * width[:, None] * t
    decay = np.exp(-sigma * at)
    logw = ((n * (nu * math.log(nu) - math.lgamma(nu)) + (nu - 1) * ln - nu * e)[:, None] - nu * n[:, None] * sigma * at
            - nu * s[:, None] * decay - 0.5 * at * at + np.log(wt) + t * t)
    top = logw.max(axis=1, keepdims=True)
    weights = np.exp(logw - top)
    mass = weights.sum(axis=1)
    return at, decay, weights / mass[:, None], top[:, 0] + np.log(mass) + np.log(math.sqrt(2) * width) - 0.5 * math.log(2 * math.pi)


def fit_glmm_ri(df: DataFrame, y: str, terms: Sequence[tuple], group: str, levels: Mapping | None = None,
                nodes: int = 15, max_passes: int = 60) -> RandomInterceptModel:
    """Random-intercept Gamma model by adaptive Gauss-Hermite quadrature.

    Given the coefficients, a group's likelihood depends on its rows only
    through a few sums, so a pass is one grouped aggregation (combined
    map-side, so a huge group is never gathered) followed by a map over one row
    per group. Standard errors come from the observed information: at the estimate one
    more pass adds up the second derivatives of the groups' log-likelihoods, the
    posterior mean of the inner ones and the posterior variance of the first ones.
    """
    inputs = ModelInputs(df, y, terms, levels, {"__g": F.col(group)})
    n, bad, _, stats = inputs.probe(F.col("__y") <= 0)
    if not n:
        raise ValueError("no complete rows to fit")
    if bad:
        raise ValueError(f"{bad} values of {y!r} are not positive")
    design = Design(terms, inputs.levels)
    design.standardise(stats)
    names = design.input_names()
    rows = inputs.rows.select("__g", *design.input_columns(), "__y")
    # Rows of a group that share a covariate pattern are merged once.
    log_y = F.log("__y")
    merged = rows.groupBy("__g", *names).agg(
        F.count(F.lit(1)).cast("double").alias("__n"), F.sum("__y").alias("__sy"), F.sum(log_y).alias("__ln"),
        F.sum(log_y * log_y).alias("__ln2"))
    data = durable(merged.repartition("__g"))     # kept by group, so that a pass moves nothing
    t, wt = np.polynomial.hermite.hermgauss(nodes)
    passes = 0

    def columns():
        f = {v: F.col(f"{design.f}{i}") for i, v in enumerate(design.factors)}
        x = {v: (F.col(f"{design.x}{i}") - F.lit(design.shift[v])) / F.lit(design.scale[v])
             for i, v in enumerate(design.numerics)}
        out = []
        for c in design.columns:
            e = F.lit(1.0)
            for v, k in c.dummies:
                e = e * (f[v] == F.lit(k)).cast("double")
            for v in c.numerics:
                e = e * x[v]
            out.append(e)
        return out

    wide = data.select("__g", "__n", "__sy", "__ln", *[c.alias(f"m{j}") for j, c in enumerate(columns())])

    def total(beta, kernel, second=False):
        nonlocal passes
        passes += 1
        eta = F.lit(0.0)
        for j in cols:
            eta = eta + F.lit(float(beta[cols.index(j)])) * F.col(f"m{j}")
        e = F.col("__sy") * F.exp(-F.col("eta"))
        sums = (wide.withColumn("eta", eta).groupBy("__g").agg(
            F.sum("__n").alias("n"), F.sum("__ln").alias("ln"), F.sum(F.col("__n") * F.col("eta")).alias("e"),
            F.sum(e).alias("s"),
            F.array(*[F.sum(F.col("__n") * F.col(f"m{j}")) for j in cols]).alias("x"),
            F.array(*[F.sum(e * F.col(f"m{j}")) for j in cols]).alias("t"),
            *([F.array(*[F.sum(e * F.col(f"m{i}") * F.col(f"m{j}")) for i in cols for j in cols]).alias("tt")] if second else [])).drop("__g"))
        return sum_arrays(sums.mapInPandas(partial_sums(kernel), "v array<double>"))

    try:
        def start(batch):
            x, w = design.matrix(batch), batch["__n"].to_numpy(float)
            return np.concatenate([(x.T @ (x * w[:, None])).ravel(), x.T @ batch["__ln"].to_numpy(float)])
        flat = sum_arrays(data.drop("__g").mapInPandas(partial_sums(start), "v array<double>"))
        gram, rhs = flat[:design.p**2].reshape(design.p, design.p), flat[design.p**2:]
        cols = independent_columns(gram)
        p = len(cols)
        # Start from the spread of log y within and between groups.
        per_group = data.groupBy("__g").agg(F.sum("__n").alias("n"), F.sum("__ln").alias("a"), F.sum("__ln2").alias("b"))
        inside, free, between = per_group.agg(
            F.sum(F.col("b") - F.col("a") * F.col("a") / F.col("n")), F.sum(F.col("n") - 1),
            F.var_samp(F.col("a") / F.col("n"))).first()
        within = max(inside / free if free else 0.5, 1e-4)
        low, high = 1e-3, 1e6                       # shape with trigamma(shape) = within
        for _ in range(100):
            nu0 = math.sqrt(low * high)
            low, high = (nu0, high) if numeric.trigamma(nu0) > within else (low, nu0)
        sigma0 = math.sqrt(max((between or 0.0) - within / (n / max(n - free, 1)), 1e-3))
        beta0 = np.linalg.solve(gram[np.ix_(cols, cols)], rhs[cols])
        if cols[0] == 0:
            beta0[0] += math.log(nu0) - float(numeric.digamma(nu0))
        par = np.concatenate([beta0, [math.log(sigma0), math.log(nu0)]])

        def evaluate(par):
            sigma, nu = math.exp(par[-2]), math.exp(par[-1])
            dg = float(numeric.digamma(nu))

            def kernel(batch):
                n_, ln, e, s = (batch[c].to_numpy(float) for c in ("n", "ln", "e", "s"))
                x, tt = np.stack(batch["x"].to_numpy()), np.stack(batch["t"].to_numpy())
                at, decay, wgt, ll = posterior_nodes(n_, ln, e, s, sigma, nu, t, wt)
                m_decay, m_b = (wgt * decay).sum(axis=1), (wgt * at).sum(axis=1)
                m_bd = (wgt * at * decay).sum(axis=1)
                g_beta = nu * (m_decay[:, None] * tt - x)
                g_sigma = nu * sigma * (s * m_bd - n_ * m_b)
                g_nu = nu * (n_ * (math.log(nu) + 1 - dg) + ln - e - n_ * sigma * m_b - s * m_decay)
                g = np.column_stack([g_beta, g_sigma, g_nu])
                return np.concatenate([(g.T @ g).ravel(), g.sum(axis=0), [ll.sum(), len(batch)]])
            v = total(par[:-2], kernel)
            k = p + 2
            return v[:k * k].reshape(k, k), v[k * k:k * k + k], v[-2], int(v[-1])

        # Quasi-Newton: the score outer product starts the curvature, gradient differences refine it.
        best, converged, inverse, last = None, False, None, None
        for _ in range(max_passes):
            info, score, ll, groups = evaluate(par)
            if best is not None and not ll >= best[1] - 1e-10 * (abs(best[1]) + 1):
                par = (par + best[0]) / 2
                continue
            if last is not None and inverse is not None:
                s, d = par - best[0], last - score
                if s @ d > 1e-12:
                    rho = 1 / (s @ d)
                    left = np.eye(len(s)) - rho * np.outer(s, d)
                    inverse = left @ inverse @ left.T + rho * np.outer(s, s)
            if inverse is None:
                inverse = np.linalg.inv(info + 1e-10 * np.diag(np.diag(info) + 1e-12))
            best, last = (par, ll), score
            step = inverse @ score
            if float(step @ score) < 1e-6:
                converged = True
                break
            biggest = np.abs(step).max()
            if biggest > 1:
                step, inverse = step / biggest, None      # far away: take a fresh curvature next time
            par = par + step
        def observed(par):
            """Minus the second derivatives of the log-likelihood in (beta, log sigma, log shape)."""
            sigma, nu = math.exp(par[-2]), math.exp(par[-1])
            dg, tg = float(numeric.digamma(nu)), float(numeric.trigamma(nu))

            def kernel(batch):
                n_, ln, e, s = (batch[c].to_numpy(float) for c in ("n", "ln", "e", "s"))
                x, tt = np.stack(batch["x"].to_numpy()), np.stack(batch["t"].to_numpy())
                square = np.stack(batch["tt"].to_numpy()).reshape(len(batch), p, p)
                at, decay, wgt, _ = posterior_nodes(n_, ln, e, s, sigma, nu, t, wt)
                pull = s[:, None] * decay
                d_sigma = nu * sigma * at * (pull - n_[:, None])
                d_nu = nu * ((n_ * (math.log(nu) + 1 - dg) + ln - e)[:, None] - n_[:, None] * sigma * at - pull)
                first = np.concatenate([nu * (decay[:, :, None] * tt[:, None, :] - x[:, None, :]), d_sigma[:, :, None], d_nu[:, :, None]], axis=2)
                mean = np.einsum("gq,gqk->gk", wgt, first)
                h = np.einsum("gq,gqk,gql->kl", wgt, first, first) - mean.T @ mean
                m_decay = (wgt * decay).sum(axis=1)
                h[:p, :p] -= nu * np.einsum("g,gkl->kl", m_decay, square)
                cross = -nu * sigma * (wgt * at * decay).sum(axis=1) @ tt
                h[:p, p] += cross
                h[p, :p] += cross
                slope = nu * (m_decay @ tt - x.sum(axis=0))
                h[:p, p + 1] += slope
                h[p + 1, :p] += slope
                both = (wgt * d_sigma).sum()
                h[p, p] += both - nu * sigma * sigma * (wgt * at * at * pull).sum()
                h[p, p + 1] += both
                h[p + 1, p] += both
                h[p + 1, p + 1] += (wgt * d_nu).sum() + (n_ * nu - n_ * nu * nu * tg).sum()
                return -h.ravel()
            return total(par[:-2], kernel, second=True).reshape(p + 2, p + 2)

        par, ll = best
        info = observed(par)
    finally:
        data.unpersist()
    model = RandomInterceptModel(design, GAMMA_LOG, y, int(n), groups, cols, par[:-2], np.linalg.pinv(info),
                                 math.exp(par[-2]), math.exp(par[-1]), float(ll), converged, passes)
    if not converged:
        model.warnings.append("did not converge")
    if model.sigma < 1e-3:
        model.warnings.append("no variation between groups")
    return model


def group_intercepts(model: RandomInterceptModel, df: DataFrame, group: str) -> DataFrame:
    """Most likely intercept of each group given the fitted model (one row per group)."""
    sigma, nu = model.sigma, model.shape
    scored = model.inputs(df).withColumn("__e", F.col(model.y) * F.exp(-model.eta()))
    sums = scored.where(F.col("__e").isNotNull()).groupBy(group).agg(F.count("__e").cast("double").alias("__n"),
                                                                     F.sum("__e").alias("__s"))

    @F.pandas_udf("double")
    def mode(n: pd.Series, s: pd.Series) -> pd.Series:
        n_, s_ = n.to_numpy(float), s.to_numpy(float)
        b = np.zeros(len(n_))
        for _ in range(100):
            pull = nu * s_ * np.exp(-sigma * b)
            b = b + np.clip((sigma * (pull - nu * n_) - b) / (1 + sigma * sigma * pull), -2, 2)
        return pd.Series(sigma * b)
    return sums.select(group, F.col("__n").alias("n"), mode("__n", "__s").alias("intercept"))


def group_posterior(df: DataFrame, y: str, eta: Column, group: str, sigma: float, shape: float, nodes: int = 15) -> DataFrame:
    """Each group's intercepts (on the scale of eta) with posterior weights, and its log-likelihood: ``group, n, intercepts, weights, log_likelihood``.

    One aggregation combined map-side, then one row per group.
    """
    t, wt = np.polynomial.hermite.hermgauss(nodes)
    value = F.col(y).cast("double")
    rows = df.select(F.col(group).alias("g"), value.alias("y"), eta.cast("double").alias("eta")).where("y > 0 and eta is not null")
    sums = rows.groupBy("g").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.log("y")).alias("ln"), F.sum("eta").alias("e"),
                                 F.sum(F.col("y") * F.exp(-F.col("eta"))).alias("s"))

    def read(batches):
        for batch in batches:
            if len(batch):
                at, _, weights, ll = posterior_nodes(*(batch[c].to_numpy(float) for c in ("n", "ln", "e", "s")), sigma, shape, t, wt)
                yield pd.DataFrame({"g": batch["g"], "n": batch["n"].astype(int), "intercepts": list(sigma * at), "weights": list(weights), "log_likelihood": ll})

    kind = dict(rows.dtypes)["g"]
    found = sums.mapInPandas(read, f"g {kind}, n long, intercepts array<double>, weights array<double>, log_likelihood double")
    return found.withColumnRenamed("g", group)


def glmm_log_likelihood(df: DataFrame, y: str, eta: Column, group: str, sigma: float, shape: float, nodes: int = 15) -> DataFrame:
    """Log-likelihood of given parameters: ``n, groups, log_likelihood``."""
    found = group_posterior(df, y, eta, group, sigma, shape, nodes)
    return found.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"), F.sum("log_likelihood").alias("log_likelihood"))


def mixture_residuals(df: DataFrame, y: str, eta: Column, group: str, sigma: float, shape: float, given: str = "group", nodes: int = 15,
                      out: str = "residual") -> DataFrame:
    """Position of each response in its distribution under the random-intercept model; rows without a positive response or eta are left out.

    ``given="group"`` mixes the Gamma distribution function over the posterior nodes of the row's group, ``given="none"`` over the normal
    distribution of intercepts, as for a group not seen. Groups are joined by key: broadcast if few, otherwise with SALT copies, so that one huge
    group is dealt to as many tasks.
    """
    if given not in ("group", "none"):
        raise ValueError("given must be 'group' or 'none'")
    rows = df.withColumns({"__eta": eta.cast("double"), "__y": F.col(y).cast("double")}).where("__y > 0 and __eta is not null")

    @F.pandas_udf("double")
    def place(value: pd.Series, mean: pd.Series, at: pd.Series, weight: pd.Series) -> pd.Series:
        if not len(value):
            return pd.Series([], dtype=float)
        b, w = np.stack(at.to_numpy()), np.stack(weight.to_numpy())
        x = value.to_numpy(float)[:, None] * shape * np.exp(-mean.to_numpy(float)[:, None] - b)
        return pd.Series((w * numeric.gamma_cdf(np.full(x.shape, shape), x)).sum(axis=1))

    if given == "none":
        t, wt = np.polynomial.hermite.hermgauss(nodes)
        nodes_ = [F.array(*[F.lit(float(v)) for v in values]) for values in (math.sqrt(2) * sigma * t, wt / wt.sum())]
        return rows.withColumn(out, place("__y", "__eta", *nodes_)).drop("__eta", "__y")
    known = durable(group_posterior(df, y, eta, group, sigma, shape, nodes).select(F.col(group).alias("__g"), "intercepts", "weights"))
    count = known.count()
    same = F.col(group).eqNullSafe(F.col("__g"))
    if count <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(known), same)
    else:
        salted = known.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        salt = F.pmod(F.xxhash64("__y", "__eta"), F.lit(SALT)).cast("int")
        joined = rows.withColumn("__r", salt).join(salted, same & (F.col("__r") == F.col("__s"))).drop("__r", "__s")
    return joined.withColumn(out, place("__y", "__eta", "intercepts", "weights")).drop("__eta", "__y", "__g", "intercepts", "weights")


def glmm_residuals(model: RandomInterceptModel, df: DataFrame, group: str, given: str = "group", nodes: int = 15, out: str = "residual") -> DataFrame:
    """``mixture_residuals`` of a fitted model."""
    scored = model.inputs(df).withColumn("__fixed", model.eta()).drop(*model.design.input_names())
    return mixture_residuals(scored, model.y, F.col("__fixed"), group, model.sigma, model.shape, given, nodes, out).drop("__fixed")
