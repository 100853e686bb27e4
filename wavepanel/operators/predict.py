"""Predictions with intervals, simulated marginal intervals and grouped curves."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavepanel.functions import numeric
from wavepanel.functions.columns import inverse_link
from wavepanel.operators.glm import GlmModel, fit_glm
from wavepanel.operators.joins import expand_grid, left_join, number_sequence

BATCH_BYTES = 64_000_000     # largest prediction x draw matrix held by one task
LEVELS_PER_BLOCK = 10_000    # grid rows of one key that one task adds up


def _missing(names: Sequence[str]) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | F.col(n).isNull()
    return out


def with_link_se(model, df: DataFrame, fit: str = "fit", se: str = "se") -> DataFrame:
    """Linear predictor (JVM) and its standard error sqrt(x V x') per row."""
    design, names = model.design, model.design.input_names()
    cols, cov = model.cols, model.cov_scaled[:len(model.cols), :len(model.cols)]
    aug = df.select("*", *design.input_columns())
    if names:
        @F.pandas_udf("double")
        def link_se(batch: pd.DataFrame) -> pd.Series:
            x = design.matrix(batch.fillna(0))[:, cols]
            return pd.Series(np.sqrt(np.maximum(((x @ cov) * x).sum(axis=1), 0)))
        err = F.when(~_missing(names), link_se(F.struct(*names)))
    else:
        err = F.lit(float(np.sqrt(cov[0, 0])))
    return aug.withColumn(fit, design.linear_predictor(model.beta)).withColumn(se, err).drop(*names)


def predict_ci(model, df: DataFrame, level: float = 0.95, name: str | None = None, keep_se: bool = False) -> DataFrame:
    """Mean with a Wald interval built on the link scale: ``p_mle, p_lower, p_upper``.

    A decreasing link turns the ends round. An end beyond the link's range (inverse links, at or below 0) is NULL.
    """
    z = numeric.normal_quantile(0.5 + level / 2)
    link = model.family.link
    falling = link in ("inverse", "1/mu^2")
    low, high = F.col("__fit") - F.lit(z) * F.col("__se"), F.col("__fit") + F.lit(z) * F.col("__se")
    if falling:
        low, high = F.when(high > 0, high), F.when(low > 0, low)
    out = with_link_se(model, df, "__fit", "__se").withColumns({
        "p_mle": inverse_link(F.col("__fit"), link), "p_lower": inverse_link(low, link), "p_upper": inverse_link(high, link)})
    if name is not None:
        out = out.withColumn("name", F.lit(name))
    if keep_se:
        return out.withColumnsRenamed({"__fit": "fit", "__se": "se"})
    return out.drop("__fit", "__se")


def covariance_root(cov: np.ndarray) -> np.ndarray:
    """A matrix r with r r' = cov. Made once on the driver, as a factor's signs may differ between machines."""
    try:
        return np.linalg.cholesky(cov)
    except np.linalg.LinAlgError:                 # semi-definite
        value, vector = np.linalg.eigh(cov)
        return vector * np.sqrt(np.maximum(value, 0))


def coefficient_draws(beta: np.ndarray, root: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """draws x p matrix from N(beta, root root'); the same in every task for a given seed."""
    rng = np.random.Generator(np.random.Philox(seed))
    return beta + rng.standard_normal((draws, len(beta))) @ root.T


def given_draws(model, coefficients: DataFrame, draw: str = "draw", term: str = "term", value: str = "value") -> np.ndarray:
    """draws x p matrix of the model's own scale from a table of coefficients (one row per draw and term, all terms of every draw).

    It has the size of draws times one model and is gathered on the driver.
    """
    labels = model.labels
    rows = coefficients.select(draw, term, F.col(value).cast("double")).where(F.col(term).isin(labels)).collect()
    order = {d: i for i, d in enumerate(sorted({r[0] for r in rows}))}
    natural = np.full((len(order), len(labels)), np.nan)
    for d, t, v in rows:
        natural[order[d], labels.index(t)] = v
    if not len(order) or np.isnan(natural).any():
        raise ValueError(f"every draw needs a value of each of {labels}")
    return np.linalg.solve(model.design.unscale()[np.ix_(model.cols, model.cols)], natural.T).T


def marginal_ci(model: GlmModel, grid: DataFrame, over: str, keys: Sequence[str], weights: DataFrame | None = None,
                weight_keys: Sequence[str] = (), weight: str = "share", draws: int = 30_000, seed: int = 0,
                level: float = 0.95, coefficients: DataFrame | None = None) -> DataFrame:
    """Prediction averaged over the levels of ``over`` with a simulated interval.

    The rows of a key are dealt to blocks of about LEVELS_PER_BLOCK and read in
    the order of their key; a task regenerates the coefficient draws from the
    seed and keeps one running sum per draw, so no key's rows are ever
    gathered. The sums of a key's blocks are added up before its two quantiles
    are taken. ``coefficients``, a table (draw, term, value), replaces the
    simulated draws. A key that lacks a weight for one of its levels keeps its
    row, with NULL results.
    """
    keys = list(keys)
    names = model.design.input_names()
    data = grid.select("*", *model.design.input_columns())
    if weights is None:
        data = data.withColumn("__w", F.lit(1.0))
    else:
        on = [*weight_keys, over]
        data = left_join(data, weights.select(*on, F.col(weight).cast("double").alias("__w")), on)
    key = F.to_json(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]), {"ignoreNullFields": "false"}) if keys else F.lit("")
    data = data.dropna("any", subset=names).withColumn("__id", key)
    widest = data.groupBy("__id").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0] or 0
    salts = max(1, -(-widest // LEVELS_PER_BLOCK))
    salt = F.pmod(F.xxhash64(F.col(over), *names), F.lit(salts)).cast("int")
    rows = data.select(*keys, *names, "__w", "__id", salt.alias("__salt")).repartition("__id", "__salt").sortWithinPartitions("__id", "__salt")
    design, cols, fam = model.design, model.cols, model.family
    beta, root = model.beta_scaled, covariance_root(model.cov_scaled)
    lower, upper = 0.5 - level / 2, 0.5 + level / 2
    unweighted, blocks = weights is None, salts > 1
    given = None if coefficients is None else grid.sparkSession.sparkContext.broadcast(given_draws(model, coefficients))

    def finished(rows):
        """Results of sums (key values, levels, whether a weight lacks, point, sums)."""
        out = []
        for values, n, lacking, point, sums in rows:
            share = n if unweighted else 1.0
            low, high = (None, None) if lacking else np.quantile(sums / share, [lower, upper])
            out.append((*values, None if lacking else point / share, low, high))
        return pd.DataFrame(out, columns=[*keys, "p_mle", "p_lower", "p_upper"])

    def as_blocks(rows):
        return pd.DataFrame([(*values, key, n, bool(lacking), point, sums) for key, (values, n, lacking, point, sums) in rows],
                            columns=[*keys, "__id", "__n", "__open", "__point", "__sums"])

    def add_levels(batches):
        sims, current, mark = None, None, None
        for batch in batches:
            if sims is None:
                sims = (coefficient_draws(beta, root, draws, seed) if given is None else given.value).T
            step = max(1, BATCH_BYTES // (8 * sims.shape[1]))
            for at in range(0, len(batch), step):
                part = batch.iloc[at:at + step]
                ids, salt_ = part["__id"].to_numpy(), part["__salt"].to_numpy()
                starts = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (salt_[1:] != salt_[:-1])]))
                w = part["__w"].to_numpy(float)
                lacking = np.add.reduceat(np.isnan(w).astype(int), starts)
                w = np.nan_to_num(w)
                x = design.matrix(part)[:, cols]
                points = np.add.reduceat(fam.mean(x @ beta) * w, starts)
                sums = np.add.reduceat(fam.mean(x @ sims) * w[:, None], starts, axis=0)
                sizes = np.diff(np.append(starts, len(part)))
                values = part[keys].iloc[starts]
                done = []
                for j, i in enumerate(starts.tolist()):
                    if current is not None and mark == (ids[i], salt_[i]):
                        current[1:] = [current[1] + sizes[j], current[2] + lacking[j], current[3] + points[j], current[4] + sums[j]]
                    else:
                        if current is not None:
                            done.append((mark[0], current))
                        mark, current = (ids[i], salt_[i]), [tuple(values.iloc[j]), int(sizes[j]), int(lacking[j]), points[j], sums[j]]
                if done:
                    yield as_blocks(done) if blocks else finished([c for _, c in done])
        if current is not None:
            yield as_blocks([(mark[0], current)]) if blocks else finished([current])

    def add_blocks(batches):
        current, mark = None, None
        for batch in batches:
            for row in batch.to_dict("records"):
                sums = np.asarray(row["__sums"], float)
                if current is not None and mark == row["__id"]:
                    current[1:] = [current[1] + row["__n"], current[2] + row["__open"], current[3] + row["__point"], current[4] + sums]
                else:
                    if current is not None:
                        yield finished([current])
                    mark, current = row["__id"], [tuple(row[k] for k in keys), row["__n"], row["__open"], row["__point"], sums]
        if current is not None:
            yield finished([current])

    kinds = {f.name: f.dataType.simpleString() for f in data.schema.fields}
    own = "".join(f"`{k}` {kinds[k]}, " for k in keys)
    result = own + "p_mle double, p_lower double, p_upper double"
    if not blocks:
        return rows.mapInPandas(add_levels, result)
    sums = rows.mapInPandas(add_levels, own + "__id string, __n long, __open boolean, __point double, __sums array<double>")
    return sums.repartition("__id").sortWithinPartitions("__id").mapInPandas(add_blocks, result)


def fit_curve(df: DataFrame, x: str, y: str, by: str, family="gamma", link: str | None = "log",
              n: int = 80, level: float = 0.95, levels: Mapping | None = None) -> DataFrame:
    """One GLM curve per group over that group's own x range, with interval.

    The curves of all groups come from a single model with group-specific
    intercept and slope.
    """
    model = fit_glm(df, y, [(x,), (by,), (x, by)], family, link, levels)
    groups = list(model.design.levels[by])
    ranges = (df.dropna("any", subset=[x, y, by]).where(F.col(by).isin(groups))
              .groupBy(by).agg(F.min(x).cast("double").alias("__lo"), F.max(x).cast("double").alias("__hi")))
    steps = expand_grid(df.sparkSession, __s=number_sequence(0.0, 1.0, n), **{by: groups})
    grid = steps.join(ranges, by).select(by, (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("__s")).alias(x))
    return predict_ci(model, grid, level)
