"""Linear and logistic models with one factor of very many levels, absorbed instead of expanded.

Each level has an intercept of its own. In a least-squares step the intercepts
are eliminated: with the sums w, X'w and z'w of a level, the system of the other
coefficients is X'WX - sum(x_g x_g' / w_g), its right side X'Wz - sum(x_g z_g / w_g),
and a level's intercept follows from its own sums. So a pass is one grouped
aggregation, combined map-side, and the driver holds a system of the other
coefficients only, whatever the number of levels.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavepanel.functions import numeric
from wavepanel.functions.results import result_table
from wavepanel.functions.storage import durable
from wavepanel.operators.glm import ModelInputs, independent_columns, partial_sums, sum_arrays
from wavepanel.operators.terms import Design


@dataclass
class AbsorbedModel:
    """Coefficients beside an absorbed factor; ``effects`` has one row per level."""

    design: Design
    family: str
    y: str
    absorbed: str
    n: int
    levels: int
    cols: list[int]
    beta: np.ndarray
    cov: np.ndarray
    deviance: float
    dispersion: float
    df_resid: int
    effects: DataFrame
    left_out: int
    converged: bool
    passes: int
    warnings: list[str] = field(default_factory=list)

    @property
    def labels(self) -> list[str]:
        names = self.design.labels()
        return [names[j] for j in self.cols]

    @property
    def coef(self) -> dict[str, float]:
        return dict(zip(self.labels, self.beta.tolist(), strict=True))

    def coef_table(self, spark: SparkSession) -> DataFrame:
        rows = []
        for i, (label, b, s) in enumerate(zip(self.labels, self.beta, np.sqrt(np.diag(self.cov)), strict=True)):
            z = float(b / s)
            p = numeric.normal_two_sided(z) if self.family == "binomial" else numeric.t_two_sided(z, self.df_resid)
            rows.append((i, label, float(b), float(s), z, p))
        return result_table(spark, rows, "position int, term string, estimate double, std_error double, statistic double, p_value double")


def _columns(design: Design) -> list[Column]:
    """The design columns on the scale of the inputs."""
    f = {v: F.col(f"{design.f}{i}") for i, v in enumerate(design.factors)}
    x = {v: F.col(f"{design.x}{i}") for i, v in enumerate(design.numerics)}
    out = []
    for c in design.columns:
        e = F.lit(1.0)
        for v, k in c.dummies:
            e = e * (f[v] == F.lit(k)).cast("double")
        for v in c.numerics:
            e = e * x[v]
        out.append(e)
    return out


def fit_absorbed(df: DataFrame, y: str, terms: Sequence[tuple], absorb: str, family: str = "gaussian", levels: Mapping | None = None,
                 max_passes: int = 40) -> AbsorbedModel:
    """Least squares or logistic regression of ``y`` on the terms and one intercept per level of ``absorb``.

    Rows of a level that share a covariate pattern are merged once and kept with
    their level, so a pass moves only sums. In a logistic model a level whose
    responses are all alike has no finite intercept and says nothing about the
    other coefficients; such levels are left out and counted. Columns that are
    constant within all levels are aliased and left out with a warning.
    """
    if family not in ("gaussian", "binomial"):
        raise ValueError("absorbed models are gaussian or binomial")
    logistic = family == "binomial"
    inputs = ModelInputs(df, y, terms, levels, {"__g": F.col(absorb)})
    n, bad, _, _ = inputs.probe(~F.col("__y").isin(0.0, 1.0) if logistic else F.col("__y").isNull())
    if not n or bad:
        raise ValueError(f"{bad} values of {y!r} are not 0 or 1" if n else "no complete rows to fit")
    design = Design(terms, inputs.levels)             # the levels take the intercept: it varies within none of them
    names = design.input_names()
    sums = [F.count(F.lit(1)).cast("double").alias("__n"), F.sum("__y").alias("__s"), (F.var_pop("__y") * F.count(F.lit(1))).alias("__ss")]
    merged = inputs.rows.select("__g", *design.input_columns(), "__y").groupBy("__g", *names).agg(*sums)
    p = len(design.columns)
    rows = merged.select("__g", "__n", "__s", "__ss", *[c.alias(f"m{j}") for j, c in enumerate(_columns(design))]).repartition("__g")
    data = durable(rows)
    kept = [data]
    left_out = 0
    passes = 0
    try:
        if logistic:
            alike = data.groupBy("__g").agg(F.sum("__n").alias("n"), F.sum("__s").alias("s"))
            plain = durable(alike.where((F.col("s") > 0) & (F.col("s") < F.col("n"))).select(F.col("__g").alias("g"), (F.col("s") / F.col("n")).alias("p")))
            kept.append(plain)
            left_out = alike.count() - plain.count()
            effects = plain.select("g", F.log(F.col("p") / (1 - F.col("p"))).alias("alpha"))
        else:
            effects = data.groupBy("__g").agg(F.lit(0.0).alias("alpha")).withColumnRenamed("__g", "g")
        beta, cols, last, converged, deviance = np.zeros(p), None, math.inf, False, math.nan
        for _ in range(max_passes):
            passes += 1
            eta = F.col("alpha")
            for j in range(p):
                eta = eta + F.lit(float(beta[j])) * F.col(f"m{j}")
            joined = data.join(effects, F.col("__g") == F.col("g")).withColumn("eta", eta)
            mean = F.col("__s") / F.col("__n")
            if logistic:
                mu = 1 / (1 + F.exp(-F.col("eta")))
                joined = joined.withColumn("mu", mu).withColumn("w", F.col("__n") * F.col("mu") * (1 - F.col("mu")))
                joined = joined.withColumn("z", F.col("eta") + (mean - F.col("mu")) / (F.col("mu") * (1 - F.col("mu"))))
                dev = -2 * (F.col("__s") * F.log("mu") + (F.col("__n") - F.col("__s")) * F.log1p(-F.col("mu")))
            else:
                joined = joined.withColumn("w", F.col("__n")).withColumn("z", mean)
                dev = F.col("__ss") + F.col("__n") * (mean - F.col("eta")) * (mean - F.col("eta"))
            m = [F.col(f"m{j}") for j in range(p)]
            per_level = durable(joined.groupBy("g").agg(
                F.sum("w").alias("w"), F.sum(F.col("w") * F.col("z")).alias("z"), F.sum(dev).alias("d"), F.sum("__n").alias("n"),
                F.array(*[F.sum(F.col("w") * c) for c in m]).alias("x"), F.array(*[F.sum(F.col("w") * F.col("z") * c) for c in m]).alias("xz"),
                F.array(*[F.sum(F.col("w") * m[i] * m[j]) for i in range(p) for j in range(p)]).alias("xx")))
            kept.append(per_level)

            def system(batch):
                w, z = batch["w"].to_numpy(float), batch["z"].to_numpy(float)
                x, xz = np.stack(batch["x"].to_numpy()), np.stack(batch["xz"].to_numpy())
                xx = np.stack(batch["xx"].to_numpy()).sum(axis=0).reshape(p, p)
                return np.concatenate([(xx - x.T @ (x / w[:, None])).ravel(), xz.sum(axis=0) - x.T @ (z / w), xx.diagonal(),
                                       [batch["d"].sum(), batch["n"].sum(), len(batch)]])
            v = sum_arrays(per_level.mapInPandas(partial_sums(system), "v array<double>"))
            if not len(v):
                raise ValueError("no level has responses of both kinds")
            s, rhs, whole = v[:p * p].reshape(p, p), v[p * p:p * p + p], v[p * p + p:p * p + 2 * p]
            deviance, used, groups = float(v[-3]), int(v[-2]), int(v[-1])
            if cols is None:                                    # what is constant within the levels is aliased with them
                varies = [j for j in range(p) if s[j, j] > 1e-10 * whole[j]]
                cols = [varies[k] for k in independent_columns(s[np.ix_(varies, varies)])]
            new = np.zeros(p)
            new[cols] = np.linalg.solve(s[np.ix_(cols, cols)], rhs[cols])
            shift = F.col("z")
            for j in cols:
                shift = shift - F.lit(float(new[j])) * F.col("x")[j]
            effects = per_level.select("g", (shift / F.col("w")).alias("alpha"))
            beta = new
            if logistic and abs(last - deviance) <= 1e-10 * (abs(deviance) + 0.1):
                converged = True
                break
            if not logistic and passes == 2:                    # the second pass reads the deviance of the solution
                converged = True
                break
            last = deviance
        effects = durable(effects.withColumnsRenamed({"g": absorb, "alpha": "effect"}))
    finally:
        for table in kept:
            table.unpersist()
    rest = used - groups - len(cols)
    dispersion = 1.0 if logistic else deviance / rest if rest > 0 else math.nan
    model = AbsorbedModel(design, family, y, absorb, used, groups, cols, beta[cols], np.linalg.inv(s[np.ix_(cols, cols)]) * dispersion, deviance, dispersion, rest,
                          effects, left_out, converged, passes)
    if not converged:
        model.warnings.append("did not converge")
    if len(cols) < p - 1:
        model.warnings.append(f"aliased: {[x for j, x in enumerate(design.labels()) if j and j not in cols]}")
    if left_out:
        model.warnings.append(f"{left_out} levels without variation are left out")
    return model
