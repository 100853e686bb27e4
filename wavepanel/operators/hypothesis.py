"""Type-II and sequential test tables."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame

from wavepanel.functions import numeric
from wavepanel.functions.results import result_table
from wavepanel.operators.glm import GlmModel, ModelFrame


def _type_ii_sets(design) -> list[tuple[list[int], list[int]]]:
    """Per term: columns without the term and everything containing it, and the same plus the term."""
    out = []
    for i in range(len(design.terms)):
        rest = [t for t in range(len(design.terms)) if t != i and t not in design.relatives(i)]
        out.append((design.columns_of(rest), design.columns_of([*rest, i])))
    return out


def _all_converged(fits) -> None:
    open_fits = sum(not f.converged for f in fits)
    if open_fits:
        raise ArithmeticError(f"{open_fits} of {len(fits)} nested models did not converge; their deviances cannot be compared")


def fit_and_test(df: DataFrame, y: str, terms: Sequence[tuple], family="gaussian", link: str | None = None,
                 levels: Mapping | None = None, intercept: bool = True, theta: float | None = None
                 ) -> tuple[GlmModel, DataFrame]:
    """The model and its Type-II table from one set of passes.

    Likelihood-ratio chi-squared for GLMs (deviance difference over the full
    model's dispersion), F for Gaussian models.
    """
    with ModelFrame(df, y, terms, family, link, levels, intercept, theta) as frame:
        pairs = _type_ii_sets(frame.design)
        model, fits = frame.fit([s for pair in pairs for s in pair])
    _all_converged(fits)
    gaussian = model.family.name == "gaussian"
    rows = []
    for i, label in enumerate(model.term_names()):
        small, large = fits[2 * i], fits[2 * i + 1]
        df1 = len(large.cols) - len(small.cols)
        drop = max(small.deviance - large.deviance, 0.0)
        if df1 == 0:
            rows.append((i, label, None, 0, None))
        elif gaussian:
            f = drop / df1 / model.dispersion
            rows.append((i, label, f, df1, numeric.f_tail(f, df1, model.df_resid)))
        else:
            lr = drop / model.dispersion
            rows.append((i, label, lr, df1, numeric.chi2_tail(lr, df1)))
    name = "f_statistic" if gaussian else "lr_chisq"
    table = result_table(df.sparkSession, rows, f"position int, term string, {name} double, df int, p_value double")
    return model, table


def anova_ii(df: DataFrame, y: str, terms: Sequence[tuple], family="gaussian", link: str | None = None,
             levels: Mapping | None = None, intercept: bool = True, theta: float | None = None) -> DataFrame:
    return fit_and_test(df, y, terms, family, link, levels, intercept, theta)[1]


def anova_seq(df: DataFrame, y: str, terms: Sequence[tuple], family="gaussian", link: str | None = None,
              levels: Mapping | None = None, intercept: bool = True) -> DataFrame:
    """Analysis of deviance adding the terms one by one."""
    with ModelFrame(df, y, terms, family, link, levels, intercept) as frame:
        d = frame.design
        model, fits = frame.fit([d.columns_of(range(k)) for k in range(len(d.terms) + 1)])
    _all_converged(fits)
    rows = [(0, "NULL", None, None, model.n - len(fits[0].cols), float(fits[0].deviance), None)]
    for k, label in enumerate(model.term_names(), start=1):
        df1 = len(fits[k].cols) - len(fits[k - 1].cols)
        drop = fits[k - 1].deviance - fits[k].deviance
        p = None
        if df1 and model.family.dispersion_known:
            p = numeric.chi2_tail(drop, df1)
        elif df1:
            p = numeric.f_tail(drop / df1 / model.dispersion, df1, model.df_resid)
        rows.append((k, label, df1, float(drop), model.n - len(fits[k].cols), float(fits[k].deviance), p))
    return result_table(
        df.sparkSession, rows, "position int, term string, df int, deviance double, resid_df long, resid_deviance double, p_value double")


def wald_table(spark, design, cols: Sequence[int], beta: np.ndarray, cov: np.ndarray) -> DataFrame:
    """Type-II Wald chi-squared per term.

    The statistic of a term with relatives is the difference between testing
    term + relatives and relatives alone, which is the part of the hypothesis
    conjugate to the relatives.
    """
    def wald(terms):
        at = [k for k, j in enumerate(cols) if design.columns[j].term in terms]
        if not at:
            return 0.0, 0
        b, v = beta[at], cov[np.ix_(at, at)]
        return float(b @ np.linalg.solve(v, b)), len(at)

    rows = []
    for i, label in enumerate(design.term_labels()):
        rel = design.relatives(i)
        both, k_both = wald({i, *rel})
        alone, k_alone = wald(set(rel))
        df1 = k_both - k_alone
        chisq = max(both - alone, 0.0)
        rows.append((i, label, df1, chisq if df1 else None, numeric.chi2_tail(chisq, df1) if df1 else None))
    return result_table(spark, rows, "position int, term string, df int, chisq double, p_value double")


def anova_wald(spark, model) -> DataFrame:
    """Type-II Wald table of any fitted model that carries design, cols, beta and cov."""
    cols = model.cols
    beta = np.asarray([model.beta[j] for j in cols]) if len(model.beta) == model.design.p else np.asarray(model.beta)
    cov = model.cov[:len(cols), :len(cols)]
    if not np.all(np.isfinite(cov)) or any(math.isnan(b) for b in beta):
        raise ArithmeticError("the model has no finite covariance")
    return wald_table(spark, model.design, cols, beta, cov)
