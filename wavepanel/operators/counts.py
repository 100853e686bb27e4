"""Negative binomial, zero-truncated negative binomial and hurdle models for counts.

The mean of the untruncated distribution is log-linear in the terms; log k
(the size, one number) is estimated with it by Newton steps on the analytic
score and Hessian, one Spark job per step. When k grows large the (truncated)
Poisson model is fitted, the boundary 1/k = 0, and the score of 1/k decides there:
if the likelihood does not rise into the inside the boundary is the estimate,
otherwise the steps go on from the size that the score points to.
"""

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
from wavepanel.functions.storage import durable
from wavepanel.operators.clean import Levels, drop_levels
from wavepanel.operators.families import Family
from wavepanel.operators.glm import (PATTERN_SHARE, GlmModel, LinearModel, ModelInputs, _level_values, fit_glm,
                                     independent_columns, narrow, partial_sums, sum_arrays)
from wavepanel.operators.hypothesis import anova_ii
from wavepanel.operators.terms import Design, base_column

FAR_LOG_K = 7.0              # log k from which the boundary 1/k = 0 is tried


@dataclass
class CountModel(LinearModel):
    """Fitted NB or zero-truncated NB; ``cov`` has log k as its last row and column."""

    design: Design
    family: Family
    y: str
    n: int
    cols: list[int]
    beta_scaled: np.ndarray
    cov_scaled: np.ndarray
    log_k: float
    log_likelihood: float
    max_score: float
    converged: bool
    passes: int
    poisson_limit: bool
    #: Score of 1/k at the boundary over its standard error, where the fit went there.
    boundary_z: float | None = None
    warnings: list[str] = field(default_factory=list)
    dispersion: float = 1.0

    def __post_init__(self):
        a = self.design.unscale()[:, self.cols]
        self.beta = a @ self.beta_scaled
        p = len(self.cols)
        full = np.zeros((self.design.p + 1, p + 1))
        full[:-1, :-1], full[-1, -1] = a, 1.0
        keep = [*self.cols, self.design.p]
        self.cov = (full @ self.cov_scaled @ full.T)[np.ix_(keep, keep)]
        names = self.design.labels()
        self.aliased = [names[j] for j in range(self.design.p) if j not in self.cols]

    @property
    def theta(self) -> float:
        return math.exp(self.log_k)

    def poisson_test(self, spark: SparkSession) -> DataFrame:
        """Score test of 1/k = 0 against 1/k > 0: ``z, p_value``; NULL where the fit stayed far from the boundary."""
        z = self.boundary_z
        p = None if z is None else 0.5 * numeric.normal_two_sided(abs(z))
        return result_table(spark, [(z, None if z is None else p if z > 0 else 1 - p)], "z double, p_value double")

    def coef_table(self, spark: SparkSession) -> DataFrame:
        b = [float(self.beta[j]) for j in self.cols] + [self.log_k]
        se = np.sqrt(np.diag(self.cov))
        rows = []
        for i, (label, est, s) in enumerate(zip([*self.labels, "log(k)"], b, se, strict=True)):
            z = est / s if s > 0 else math.nan
            rows.append((i, label, est, s if s > 0 else math.nan, z, math.nan if math.isnan(z) else numeric.normal_two_sided(z)))
        return result_table(spark, rows, "position int, term string, estimate double, std_error double, "
                                         "statistic double, p_value double")

    def stats(self, spark: SparkSession) -> DataFrame:
        k = self.rank + (0 if self.poisson_limit else 1)
        row = (self.n, self.rank, self.log_likelihood, 2 * k - 2 * self.log_likelihood, self.theta,
               self.poisson_limit, self.converged, self.passes)
        return result_table(spark, [row], "n long, rank int, log_likelihood double, aic double, theta double, "
                                          "poisson_limit boolean, converged boolean, passes int")

    def mean_positive(self):
        """E[y | y > 0] as a JVM expression over the input columns."""
        mu, k = F.exp(self.eta()), F.lit(self.theta)
        return mu / -F.expm1(-mu if self.poisson_limit else -k * F.log1p(mu / k))


def poisson_terms(y, mu, truncated):
    """At 1/k = 0: log-likelihood of each row, first and second derivative in log mu, score of 1/k and its information given mu."""
    ll = y * np.log(mu) - mu - numeric.lgamma(y + 1)
    s_m, h_mm = y - mu, -mu
    s_a, i_a = 0.5 * ((y - mu) ** 2 - y), 0.5 * mu * mu
    if truncated:
        r = 1 / np.expm1(mu)                         # P(0) / (1 - P(0))
        ll = ll - np.log(-np.expm1(-mu))
        s_m, h_mm = s_m - r * mu, h_mm - r * mu + r * (1 + r) * mu * mu
        s_a, i_a = s_a + r * 0.5 * mu * mu, i_a * (1 + r)
    return ll, s_m, h_mm, s_a, i_a


def _log_rising(y, k):
    """log of k (k + 1) ... (k + y - 1) over k^y, without the cancellation of large k."""
    if k < 1e4:
        return numeric.lgamma(y + k) - numeric.lgamma(k) - y * np.log(k)
    def rest(x):
        return 1 / (12 * x) - 1 / (360 * x**3)
    return (k + y - 0.5) * np.log1p(y / k) - y + rest(k + y) - rest(k)


def negbin_terms(y, mu, k, truncated):
    """Log-likelihood of each row, its first and second derivatives in (log mu, log k)."""
    q = mu / (mu + k)
    log_rest = -np.log1p(mu / k)                     # log(k / (k + mu))
    ll = _log_rising(y, k) - numeric.lgamma(y + 1) + k * log_rest + y * (np.log(mu) + log_rest)
    s_m = y - (y + k) * q
    h_mm = -(y + k) * q * (1 - q)
    s_k = numeric.digamma(y + k) - numeric.digamma(k) + log_rest + 1 - (y + k) / (k + mu)
    h_kk = numeric.trigamma(y + k) - numeric.trigamma(k) + 1 / k - 1 / (k + mu) - (mu - y) / (k + mu) ** 2
    q_k = -mu / (k + mu) ** 2
    h_mk = -q - (y + k) * q_k
    if truncated:
        a = k * log_rest                             # log P(0)
        r = 1 / np.expm1(-a)                         # P(0) / (1 - P(0))
        a_m, a_mm = -k * q, -k * q * (1 - q)
        a_k = log_rest + q
        a_kk = 1 / k - 1 / (k + mu) + q_k
        a_mk = -q - k * q_k
        ll = ll - np.log(-np.expm1(a))
        s_m, s_k = s_m + r * a_m, s_k + r * a_k
        h_mm = h_mm + r * a_mm + r * (1 + r) * a_m * a_m
        h_kk = h_kk + r * a_kk + r * (1 + r) * a_k * a_k
        h_mk = h_mk + r * a_mk + r * (1 + r) * a_m * a_k
    return ll, s_m, k * s_k, h_mm, k * h_mk, k * k * h_kk + k * s_k


def _fit(df: DataFrame, y: str, terms: Sequence[tuple], truncated: bool, levels: Mapping | None,
         intercept: bool, max_passes: int = 60) -> CountModel:
    inputs = ModelInputs(df, y, terms, levels)
    low = 1 if truncated else 0
    is_bad = (F.col("__y") < low) | (F.col("__y") != F.floor("__y"))
    count = F.count(F.lit(1)).cast("double").alias("__n")
    if not inputs.numerics:
        # Factors only: one scan to the counts per cell and response.
        cached = durable(inputs.rows.groupBy(*inputs.factors, "__y").agg(count))
        inputs.find(cached)
        patterns, n, bad = cached.agg(F.count(F.lit(1)), F.sum("__n"), F.sum(is_bad.cast("long") * F.col("__n"))).first()
        design = Design(terms, inputs.levels, intercept)
        data = narrow(df.sparkSession, cached.select(*design.input_columns(), "__y", "__n"), patterns)
    else:
        n, bad, patterns, stats = inputs.probe(is_bad, patterns_of=["__y"])
        design = Design(terms, inputs.levels, intercept)
        design.standardise(stats)
        rows = inputs.rows.select(*design.input_columns(), "__y")
        if patterns <= max(PATTERN_SHARE * n, 1):
            cached = durable(rows.groupBy(*design.input_names(), "__y").agg(count))
            data = narrow(df.sparkSession, cached, patterns)
        else:
            cached = data = rows.withColumn("__n", F.lit(1.0)).persist(StorageLevel.MEMORY_AND_DISK)
    if not n or bad:
        cached.unpersist()
        raise ValueError(f"{bad:.0f} values of {y!r} are not counts of at least {low}" if n else "no complete rows to fit")
    passes = 0

    def total(kernel):
        nonlocal passes
        passes += 1
        return sum_arrays(data.mapInPandas(partial_sums(kernel), "v array<double>"))

    try:
        def start(batch):
            x, w = design.matrix(batch), batch["__n"].to_numpy(float)
            xw = x * w[:, None]
            return np.concatenate([(x.T @ xw).ravel(), xw.T @ np.log(batch["__y"].to_numpy(float) + 0.5)])
        flat = total(start)
        p = design.p
        gram, rhs = flat[:p * p].reshape(p, p), flat[p * p:]
        cols = independent_columns(gram)
        par = np.append(np.linalg.solve(gram[np.ix_(cols, cols)], rhs[cols]), 0.0)
        p = len(cols)
        upper = np.triu_indices(p + 1)

        def evaluate(par):
            beta, k = par[:-1], math.exp(par[-1])

            def kernel(batch):
                x, w = design.matrix(batch)[:, cols], batch["__n"].to_numpy(float)
                mu = np.exp(np.clip(x @ beta, -700, 700))       # the range of doubles
                ll, s_m, s_k, h_mm, h_mk, h_kk = negbin_terms(batch["__y"].to_numpy(float), mu, k, truncated)
                h = np.empty((p + 1, p + 1))
                h[:p, :p] = x.T @ (x * (w * h_mm)[:, None])
                h[:p, p] = h[p, :p] = x.T @ (w * h_mk)
                h[p, p] = (w * h_kk).sum()
                return np.concatenate([h[upper], x.T @ (w * s_m), [(w * s_k).sum(), (w * ll).sum()]])
            v = total(kernel)
            h = np.zeros((p + 1, p + 1))
            h[upper] = v[:len(upper[0])]
            return h + np.triu(h, 1).T, v[len(upper[0]):-1], v[-1]

        def at_boundary(beta):
            def kernel(batch):
                x, w = design.matrix(batch)[:, cols], batch["__n"].to_numpy(float)
                mu = np.exp(np.clip(x @ beta, -700, 700))
                ll, s_m, h_mm, s_a, i_a = poisson_terms(batch["__y"].to_numpy(float), mu, truncated)
                return np.concatenate([(x.T @ (x * (w * h_mm)[:, None])).ravel(), x.T @ (w * s_m),
                                       [(w * s_a).sum(), (w * i_a).sum(), (w * ll).sum()]])
            v = total(kernel)
            return v[:p * p].reshape(p, p), v[p * p:p * p + p], *v[-3:]

        def poisson_fit(beta):
            """The boundary fit: coefficients, information, score, score and information of 1/k, log-likelihood, whether it converged."""
            last = None
            for _ in range(max_passes):
                h, score, s_a, i_a, ll = at_boundary(beta)
                if last is not None and not ll >= last[1] - 1e-9 * (abs(last[1]) + 1):
                    beta = (beta + last[0]) / 2
                    continue
                last = (beta, ll)
                step = np.linalg.solve(-h, score)
                if float(step @ score) < 1e-8 + 1e-14 * abs(ll):
                    return beta + step, -h, score, s_a, i_a, ll, True
                beta = beta + step * min(1.0, 2 / np.abs(step).max())
            return beta, -h, score, s_a, i_a, ll, False

        limit, converged, best, boundary_z = False, False, None, None
        for _ in range(max_passes):
            h, score, ll = evaluate(par)
            if not math.isfinite(ll) and best is None:
                raise ArithmeticError("the likelihood has no finite start")
            if best is not None and not (ll >= best[1] - 1e-9 * (abs(best[1]) + 1)):
                par = (par + best[0]) / 2
                continue
            best = (par, ll)
            value, vector = np.linalg.eigh(-h)
            step = vector @ ((vector.T @ score) / np.maximum(np.abs(value), 1e-12 * np.abs(value).max()))
            gain = float(step @ score)
            if gain < 1e-8 + 1e-14 * abs(ll) and value.min() > 0:
                converged = True
                break
            biggest = np.abs(step).max()
            if biggest > 2:
                step *= 2 / biggest
            par = par + step
            if par[-1] > FAR_LOG_K and boundary_z is None:
                beta, info, score, s_a, i_a, ll, converged = poisson_fit(par[:-1])
                boundary_z = float(s_a / math.sqrt(i_a)) if i_a > 0 else 0.0
                if s_a <= 0 or not converged:
                    limit, par = True, np.append(beta, math.inf)
                    break
                par, best, converged = np.append(beta, math.log(i_a / s_a)), None, False
        free = p if limit else p + 1
        if not limit:
            info = -h
            if converged:   # the last Newton step costs no pass
                par = par + step
        cov = np.zeros((p + 1, p + 1))
        cov[:free, :free] = np.linalg.inv(info)
    finally:
        cached.unpersist()
    family = Family("negbin", "log", True, math.exp(par[-1]), truncated)
    model = CountModel(design, family, y, int(n), cols, par[:-1], cov, float(par[-1]), float(ll),
                       float(np.abs(score[:free]).max()), converged, passes, limit, boundary_z)
    if limit:
        model.warnings.append("Poisson limit: the counts show no overdispersion, k is not estimable")
    if not converged:
        model.warnings.append("did not converge")
    if model.aliased:
        model.warnings.append(f"rank deficient; aliased: {model.aliased}")
    return model


def fit_negbin(df: DataFrame, y: str, terms: Sequence[tuple], levels: Mapping | None = None,
               intercept: bool = True) -> CountModel:
    """Negative binomial regression with estimated size; log k is infinite where the counts show no overdispersion."""
    return _fit(df, y, terms, False, levels, intercept)


def fit_ztnb(df: DataFrame, y: str, terms: Sequence[tuple], levels: Mapping | None = None,
             intercept: bool = True) -> CountModel:
    """Zero-truncated negative binomial: log mu on the terms, log k constant, infinite without overdispersion."""
    return _fit(df, y, terms, True, levels, intercept)


def anova_negbin(df: DataFrame, y: str, terms: Sequence[tuple], model: CountModel, levels: Mapping | None = None,
                 intercept: bool = True) -> DataFrame:
    """Type-II likelihood-ratio table with the size fixed at its estimate."""
    family, theta = ("poisson", None) if model.poisson_limit else ("negbin", model.theta)
    return anova_ii(df, y, terms, family, levels=levels, intercept=intercept, theta=theta)


@dataclass
class HurdleModel:
    """Probability of a positive count, and the positive counts themselves."""

    zero: GlmModel
    count: CountModel

    def predict(self, df: DataFrame) -> DataFrame:
        """``p_positive``, ``mean_positive`` and their product ``expected`` per row.

        A level never seen among positive counts has no count prediction.
        """
        out = self.zero.with_mean(df, "p_positive")
        scored = self.count.inputs(out).withColumn("mean_positive", self.count.mean_positive())
        scored = scored.drop(*self.count.design.input_names())
        return scored.withColumn("expected", F.col("p_positive") * F.col("mean_positive"))


def fit_hurdle(df: DataFrame, y: str, terms_p: Sequence[tuple], terms_n: Sequence[tuple],
               levels: Mapping | None = None) -> HurdleModel:
    """Logistic model of y > 0 on all rows and truncated NB on the positive rows.

    The count part finds its levels among the positive rows, so levels without
    any positive count drop out of it.
    """
    flag = f"__{y}_positive"
    data = df.withColumn(flag, (F.col(y) > 0).cast("int"))
    zero = fit_glm(data, flag, terms_p, "binomial", levels=levels)
    positive = df.where(F.col(y) > 0)
    names = {base_column(v) for t in terms_n for v in t}
    kept = {k: drop_levels(positive, Levels(k, v)).values for k, v in _level_values(levels).items() if k in names}
    return HurdleModel(zero, fit_ztnb(positive, y, terms_n, kept))


def count_log_likelihood(df: DataFrame, y: str, eta: Column, log_k: float, truncated: bool = False) -> DataFrame:
    """Log-likelihood of given coefficients: ``n, log_likelihood``.

    Rows with the same count and mean are merged first.
    """
    k = math.exp(log_k)
    rows = (df.select(F.col(y).cast("double").alias("y"), eta.cast("double").alias("eta")).dropna("any")
            .groupBy("y", "eta").agg(F.count(F.lit(1)).alias("c")))

    @F.pandas_udf("double")
    def density(count: pd.Series, lp: pd.Series) -> pd.Series:
        return pd.Series(negbin_terms(count.to_numpy(float), np.exp(lp.to_numpy(float)), k, truncated)[0])
    return rows.agg(F.sum("c").alias("n"), F.sum(F.col("c") * density("y", "eta")).alias("log_likelihood"))
