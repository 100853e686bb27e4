"""Simulation residuals and their diagnostics.

A residual is the position of the observed value in the fitted distribution,
uniform on (0, 1) if the model is right. ``mode="exact"`` uses the fitted
distribution function itself (the limit of many simulations); ``mode="sim"``
compares with ``n`` simulated responses per row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavepanel.functions import numeric
from wavepanel.functions.columns import all_of, inverse_link, keyed_uniform
from wavepanel.functions.results import result_table
from wavepanel.functions.storage import durable, maybe_broadcast
from wavepanel.operators.glm import partial_sums, sum_arrays
from wavepanel.operators.summaries import _names, _rekeyed, box_stats, counted_quantiles, hide_keys, quantiles, show_keys

LEAF_ROWS = 10_000           # rows of a bin that are sorted together
SIM_CELLS = 65_536           # rows x simulations worked on at once, sized for the processor cache


_STEP, _MIX1, _MIX2 = (np.uint64(v) for v in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def counter_bits(h: np.ndarray, counter) -> np.ndarray:
    """53 mixed bits per (row hash, counter), the same on every partitioning."""
    with np.errstate(over="ignore"):
        z = h.astype(np.uint64) + np.asarray(counter, dtype=np.uint64) * _STEP
        for shift, factor in ((30, _MIX1), (27, _MIX2)):
            z ^= z >> np.uint64(shift)
            z *= factor
        z ^= z >> np.uint64(31)
    z >>= np.uint64(11)
    return z


def counter_uniform(h: np.ndarray, counter) -> np.ndarray:
    """Uniforms in (0, 1) from a row hash and a counter."""
    return (counter_bits(h, counter).astype(float) + 0.5) * 2.0**-53


def _scored(model, df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Complete rows with the fitted mean ``__mu`` and, for a Gamma response, the shape ``__shape``."""
    if hasattr(model, "sigma"):
        raise ValueError("a random-intercept model has no mean without its intercepts; use glmm_residuals")
    names = model.design.input_names()
    out = model.inputs(df).withColumn("__mu", inverse_link(model.eta(), model.family.link))
    scale = getattr(model, "scale_design", None)
    if scale is not None:
        names = [*names, *scale.input_names()]
        out = out.select("*", *scale.input_columns())
        shape = F.exp(-scale.linear_predictor(model.scale_beta))
    else:
        shape = F.lit(float(model.shape) if model.family.shape == "gamma" else 1.0)
    out = out.withColumn("__shape", shape)
    out = out.where(F.col("__mu").isNotNull() & F.col("__shape").isNotNull() & F.col(model.y).isNotNull())
    return out, [*names, "__mu", "__shape"]


def sim_residuals(model, df: DataFrame, key: Sequence[str], seed: int = 0, mode: str = "exact", n: int = 2000,
                  out: str = "residual", tie: Column | None = None) -> DataFrame:
    """One residual per complete row.

    Ties of integer responses are broken by a uniform that depends on the row
    key and the seed, so the result does not depend on partitioning; ``tie``
    supplies one instead.
    """
    if mode not in ("exact", "sim"):
        raise ValueError("mode must be 'exact' or 'sim'")
    scored, extra = _scored(model, df)
    fam, dispersion = model.family, model.dispersion
    y, mu, shape = F.col(model.y).cast("double"), F.col("__mu"), F.col("__shape")
    tie = keyed_uniform(key, seed) if tie is None else tie.cast("double")
    if mode == "exact":
        if fam.shape == "binomial":
            low = F.when(y > 0, F.lit(1.0) - F.col("__mu")).otherwise(F.lit(0.0))
            high = F.when(y > 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.col("__mu"))
            return scored.withColumn(out, low + tie * (high - low)).drop(*extra)

        @F.pandas_udf("double")
        def place(value: pd.Series, mean: pd.Series, a: pd.Series, v: pd.Series) -> pd.Series:
            low, high = distinct_cdf(fam, value.to_numpy(float), mean.to_numpy(float), dispersion, a.to_numpy(float))
            return pd.Series(low + v.to_numpy(float) * (high - low))
        return scored.withColumn(out, place(y, mu, shape, tie)).drop(*extra)

    @F.pandas_udf("double")
    def place_sim(value: pd.Series, mean: pd.Series, a: pd.Series, v: pd.Series, h: pd.Series) -> pd.Series:
        low, high = distinct_cdf(fam, value.to_numpy(float), mean.to_numpy(float), dispersion, a.to_numpy(float))
        return pd.Series(simulated_position(low, high, v.to_numpy(float), h.to_numpy(), n))
    row = F.xxhash64(*key, F.lit(int(seed)), F.lit(1))
    return scored.withColumn(out, place_sim(y, mu, shape, tie, row)).drop(*extra)


def distinct_cdf(fam, y, mu, dispersion, shape) -> tuple[np.ndarray, np.ndarray]:
    """The family's distribution function, evaluated once per distinct (y, mean, shape) of a batch."""
    where = np.zeros(len(y), np.int64)
    for column in (y, mu, shape):
        codes, found = pd.factorize(column, use_na_sentinel=False)
        where = pd.factorize(where * max(len(found), 1) + codes)[0]
    at = np.unique(where, return_index=True)[1]
    low, high = fam.cdf(y[at], mu[at], dispersion, shape[at])
    return np.asarray(low)[where], np.asarray(high)[where]


def simulated_position(low, high, v, h, n: int) -> np.ndarray:
    """Share of n simulated responses below the observed one, ties broken by jitter.

    A simulated response is the quantile of a uniform w, so it lies below the
    observed value when w <= P(Y < y), ties with it when w is between P(Y < y)
    and P(Y <= y), and its jitter is its place in between. Both conditions
    together are w <= low + v (high - low): the response need not be formed.
    """
    bar = np.minimum(np.clip(low + v * (high - low), 0, 1) * 2.0**53, 2.0**53).astype(np.uint64)[:, None]
    rows = h.astype(np.int64).view(np.uint64)[:, None]
    below = np.zeros(len(low))
    wide = min(n, SIM_CELLS)
    step = max(1, SIM_CELLS // wide)
    for first in range(1, n + 1, wide):
        counters = np.arange(first, min(first + wide, n + 1), dtype=np.uint64)[None, :]
        for at in range(0, len(low), step):
            s = slice(at, at + step)
            below[s] += np.count_nonzero(counter_bits(rows[s], counters) < bar[s], axis=1)
    return below / n


# ---------------------------------------------------------------- uniformity

def uniform_ks(df: DataFrame, u: str, by: Sequence[str] | str | None = None, bins: int = 4096, leaf: int = LEAF_ROWS) -> DataFrame:
    """Exact Kolmogorov-Smirnov distance from the uniform per cell: ``by..., n, ks``.

    Rows are counted in bins with their least and greatest value, where the
    distance is known exactly; the counts bound it inside. Bins that can hold
    the maximum are cut between their own extremes and counted again, until they
    hold at most ``leaf`` rows or one value; only such leaves are sorted. However
    close values lie, a bin of two values or more always splits, so no task sorts
    more than leaves.
    """
    by = _names(by)
    data, keys = hide_keys(df.where(F.col(u).isNotNull()).select(*by, F.col(u).cast("double").alias("__u")), by)
    key = keys or ["__all"]
    if not by:
        data = data.withColumn("__all", F.lit(0))
    rows = data.withColumns({"__path": F.lit(""), "lo": F.lit(0.0), "hi": F.lit(1.0), "before": F.lit(0).cast("bigint"),
                             "n": F.lit(None).cast("bigint")})
    kept, leaves, floor = [], [], None
    while True:
        width = bins if floor is None else 256
        place = F.least(F.floor((F.col("__u") - F.col("lo")) / (F.col("hi") - F.col("lo")) * width), F.lit(width - 1))
        parent = Window.partitionBy(*key, "__path")
        counts = rows.groupBy(*key, "__path", "before", "n", place.alias("__bin")).agg(
            F.count(F.lit(1)).alias("c"), F.min("__u").alias("lo"), F.max("__u").alias("hi"))
        upto = F.col("before") + F.sum("c").over(parent.orderBy("__bin"))
        edges = counts.withColumns({"n": F.coalesce("n", F.sum("c").over(parent)), "upto": upto}).select(
            *key, F.concat_ws(".", "__path", "__bin").alias("__path"), "n", "c", (F.col("upto") - F.col("c")).alias("before"), "upto", "lo", "hi")
        edges = durable(edges)
        kept.append(edges)
        share, below = F.col("upto") / F.col("n"), F.col("before") / F.col("n")
        reached = edges.groupBy(*key).agg(F.max("n").alias("n"), F.max(F.greatest(F.col("lo") - below, share - F.col("hi"))).alias("floor"))
        if floor is not None:
            reached = floor.unionByName(reached).groupBy(*key).agg(F.max("n").alias("n"), F.max("floor").alias("floor"))
        floor = reached
        cells = floor.select(*[F.col(k).alias(f"__f{k}") for k in key], "floor")
        here = all_of([F.col(k).eqNullSafe(F.col(f"__f{k}")) for k in key])
        open_bins = edges.join(cells, here).where((F.col("hi") > F.col("lo")) & (F.greatest(share - F.col("lo"), F.col("hi") - below) > F.col("floor")))
        open_bins = open_bins.select(*key, "__path", "c", "lo", "hi", "before", "n")
        found, large = open_bins.agg(F.count(F.lit(1)), F.count(F.when(F.col("c") > leaf, 1))).first()
        if not found:
            break
        same = all_of([F.col(f"d.{c}").eqNullSafe(F.col(f"o.{c}")) for c in [*key, "__path"]])
        inside = rows.select(*key, F.concat_ws(".", "__path", place).alias("__path"), "__u").alias("d").join(
            maybe_broadcast(open_bins, found).alias("o"), same).select(*[F.col(f"o.{c}") for c in [*key, "__path", "c", "lo", "hi", "before", "n"]], "d.__u")
        leaves.append(inside.where(F.col("c") <= leaf).groupBy(*key, "__path", "before", "n", "__u").agg(F.count(F.lit(1)).alias("c")))
        if not large:
            break
        rows = durable(inside.where(F.col("c") > leaf).drop("c"))
        kept.append(rows)
    out = floor.select(*key, "n", F.col("floor").alias("ks"))
    if leaves:
        values = reduce(DataFrame.unionByName, leaves)
        upto = F.col("before") + F.sum("c").over(Window.partitionBy(*key, "__path").orderBy("__u"))
        gap = F.greatest(F.col("upto") / F.col("n") - F.col("__u"), F.col("__u") - (F.col("upto") - F.col("c")) / F.col("n"))
        out = out.unionByName(values.withColumn("upto", upto).select(*key, "n", gap.alias("ks")))
    out = durable(out.groupBy(*key).agg(F.max("n").alias("n"), F.max("ks").alias("ks")))       # one row a cell; the rest can go
    for table in kept:
        table.unpersist()
    return show_keys(out, by) if by else out.drop("__all")


def _ks_p(n: Column, ks: Column) -> Column:
    """Asymptotic p-value as a JVM series."""
    root = F.sqrt(n)
    lam = (root + 0.12 + F.lit(0.11) / root) * ks
    total = F.lit(0.0)
    for k in range(1, 31):
        total = total + F.lit(2.0 * (-1) ** (k - 1)) * F.exp(F.lit(-2.0 * k * k) * lam * lam)
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))


@contextmanager
def _kept(df: DataFrame, cols: Sequence[str]) -> Iterator[DataFrame]:
    """These columns of a residual table, which several passes read; a table the caller has persisted is read as it is.

    It has as many rows as its source, so it is persisted and not written: a lost block is recomputed from its own split.
    """
    if df.is_cached:
        yield df
        return
    data = df.select(*cols).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield data
    finally:
        data.unpersist()


def residual_overall(df: DataFrame, u: str = "residual", sims: int | None = None) -> DataFrame:
    """Uniformity, spread and outliers of all residuals in one row, each with its p-value.

    ``dispersion`` is the variance over that of a uniform, its p-value from the
    normal limit of a variance of uniforms. With ``sims`` the residuals at
    exactly 0 or 1 are compared with the 2 / (sims + 1) expected, without it
    with none expected; their p-value is the exact two-sided binomial one.
    """
    with _kept(df, [u]) as data:
        n, mean, variance, outliers = data.agg(F.count(u), F.avg(u), F.var_samp(u), F.count(F.when((F.col(u) <= 0) | (F.col(u) >= 1), 1))).first()
        one = uniform_ks(data, u).select("ks", _ks_p(F.col("n"), F.col("ks")).alias("p")).first()
    ks, ks_p = one if one else (None, None)
    chance = 0.0 if sims is None else 2 / (sims + 1)
    spread = None if variance is None or math.isnan(variance) else variance
    row = (n, mean, None if spread is None else spread * 12, None if spread is None else numeric.uniform_variance_p(spread, n), ks, ks_p, outliers,
           None if sims is None else n * chance, numeric.binomial_two_sided(outliers, n, chance) if n else None)
    return result_table(df.sparkSession, [row], "n long, mean double, dispersion double, dispersion_p double, ks double, ks_p double, outliers long, "
                                                "outliers_expected double, outliers_p double")


def dispersion_test(model, df: DataFrame, key: Sequence[str], sims: int = 250, seed: int = 0, uniforms: Column | None = None) -> DataFrame:
    """Squared deviations from the fitted mean against those of simulated responses: ``n, observed, simulated, ratio, p_value``.

    Every task draws its rows' replicates one after the other and keeps one sum
    per replicate, so no replicate table exists and one vector of sims + 2
    numbers leaves the pass. ``uniforms``, an array of ``sims`` uniforms per
    row, replaces the keyed ones where a response comes from one uniform
    (binomial and counts). The p-value is two-sided.
    """
    scored, _ = _scored(model, df)
    fam, dispersion = model.family, model.dispersion
    given = uniforms is not None
    if given and fam.shape not in ("binomial", "poisson", "negbin"):
        raise ValueError("given uniforms draw binomial and count responses only")
    rows = scored.select(F.col(model.y).cast("double").alias("y"), F.col("__mu").alias("m"), F.col("__shape").alias("a"),
                         F.xxhash64(*key, F.lit(int(seed)), F.lit(2)).alias("h"), *([uniforms.alias("u")] if given else []))

    def kernel(batch):
        y, m, a = (batch[c].to_numpy(float) for c in ("y", "m", "a"))
        h = batch["h"].to_numpy(np.int64).view(np.uint64)
        table = np.stack(batch["u"].to_numpy()) if given else None
        sums = [float(len(y)), ((y - m) ** 2).sum()]
        for i in range(sims):
            own = counter_bits(h, i + 1)
            u = table[:, i] if given else counter_uniform(own, 1)
            sums.append(((draw_response(fam, dispersion, m, a, own, u) - m) ** 2).sum())
        return np.array(sums)

    v = sum_arrays(rows.mapInPandas(partial_sums(kernel), "v array<double>"))
    if not len(v):
        raise ValueError("no complete rows")
    n, observed, drawn = int(v[0]), float(v[1]), v[2:]
    above, below = float((drawn >= observed).mean()), float((drawn <= observed).mean())
    row = (n, observed, float(drawn.mean()), observed / float(drawn.mean()), min(1.0, 2 * min(above, below)))
    return result_table(df.sparkSession, [row], "n long, observed double, simulated double, ratio double, p_value double")


def residual_qq(df: DataFrame, u: str = "residual", points: int = 100) -> DataFrame:
    """QQ points against the uniform, one per percentile."""
    probs = [(i + 0.5) / points for i in range(points)]
    row = quantiles(df, u, probs)
    pairs = F.array(*[F.struct(F.lit(p).alias("expected"), F.col(f"q{i}").alias("observed"))
                      for i, p in enumerate(probs)])
    return row.select(F.inline(pairs))


def levene(df: DataFrame, value: str, by: Sequence[str] | str) -> DataFrame:
    """Levene test around cell medians: ``df1, df2, f_statistic, p_value``."""
    by = _names(by)
    data = df.where(F.col(value).isNotNull())
    med, groups = counted_quantiles(data, value, [0.5], by)
    med = maybe_broadcast(_rekeyed(med.select(*by, F.col("q0").alias("__med")), by), groups)
    gap = F.abs(F.col(value) - F.col("__med"))
    if by:
        centred = data.join(med, all_of([F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in by]))
    else:
        only = med.first()
        centred = data.withColumn("__med", F.lit(only["__med"] if only else None).cast("double"))
    cells = (centred
             .groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.avg(gap).alias("__m"),
                               (F.var_pop(gap) * F.count(F.lit(1))).alias("__ss")))
    cells = cells.persist()  # one row per cell
    k, n, within, total = cells.agg(
        F.count(F.lit(1)), F.sum("__n"), F.sum("__ss"), F.sum(F.col("__n") * F.col("__m"))).first()
    between = cells.agg(F.sum(F.col("__n") * (F.col("__m") - F.lit(total / n)) ** 2)).first()[0]
    cells.unpersist()
    df1, df2 = k - 1, n - k
    f = (between / df1) / (within / df2) if df1 and within else math.nan
    p = numeric.f_tail(f, df1, df2) if df1 and within else math.nan
    return result_table(df.sparkSession, [(df1, df2, f, p)], "df1 long, df2 long, f_statistic double, p_value double")


def residual_by_cell(df: DataFrame, by: Sequence[str] | str, u: str = "residual") -> DataFrame:
    """Box statistics and uniformity test of the residuals in each categorical cell."""
    by = _names(by)
    with _kept(df, [*by, u]) as data:
        boxes, _ = box_stats(data, by, u)
        ks = _rekeyed(uniform_ks(data, u, by).select(*by, "ks"), by)
        joined = boxes.join(ks, all_of([F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in by]))
        return durable(joined.select(*by, "n", "lower", "middle", "upper", "n_outliers", "ks",
                                     _ks_p(F.col("n"), F.col("ks")).alias("ks_p")))      # one row a cell; the rows can go


def residual_trend(df: DataFrame, x: str, u: str = "residual", bins: int = 20,
                   probs: Sequence[float] = (0.25, 0.5, 0.75), by: Sequence[str] | str | None = None) -> DataFrame:
    """Quantiles of the residuals in equal-count bins of a covariate (per group with ``by``)."""
    by = _names(by)
    data = df.where(F.col(x).isNotNull() & F.col(u).isNotNull())
    cuts = quantiles(data, x, [i / bins for i in range(1, bins)]).drop("n").first()
    edges = sorted(set(cuts))
    expr = None
    for i, e in enumerate(edges):
        expr = F.when(F.col(x) <= e, i) if expr is None else expr.when(F.col(x) <= e, i)
    data = data.withColumn("bin", F.lit(0) if expr is None else expr.otherwise(len(edges)))
    keys = [*by, "bin"]
    centre = data.groupBy(*keys).agg(F.avg(x).alias("x_mean"))
    q = quantiles(data, u, probs, keys)
    joined = q.join(_rekeyed(centre, keys), all_of([F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in keys]))
    return joined.select(*keys, "n", "x_mean", *[F.col(f"q{i}").alias(f"q{round(p * 100)}") for i, p in enumerate(probs)])


def _bump(t: Column) -> Column:
    """Cubic B-spline centred at 0 on unit-spaced knots."""
    d = F.abs(t)
    return (F.when(d < 1, (4 - 6 * d * d + 3 * d * d * d) / 6)
            .when(d < 2, (2 - d) * (2 - d) * (2 - d) / 6).otherwise(F.lit(0.0)))


def residual_smooth(df: DataFrame, x: str, by: Sequence[str] | str, u: str = "residual", knots: int = 5,
                    points: int = 50) -> DataFrame:
    """Cubic regression spline of the residuals on a covariate, per facet, with a 95% band.

    One grouped aggregation collects each facet's normal equations; each facet
    is then a p x p solve.
    """
    by = _names(by)
    data = df.where(F.col(x).isNotNull() & F.col(u).isNotNull())
    at = data.agg(F.min(x).cast("double"), F.max(x).cast("double")).first()
    low, high = at
    width = (high - low) or 1.0
    pieces = knots + 1
    p = knots + 4
    s = (F.col(x).cast("double") - F.lit(low)) / F.lit(width)
    kinds = dict(data.dtypes)
    cols, keys = hide_keys(data.select(*by, s.alias("__s"), F.col(u).alias("__r")), by)
    cols = cols.select(*keys, "__s", "__r", *[_bump(F.col("__s") * pieces - (j - 1)).alias(f"__b{j}") for j in range(p)])
    aggs = [F.sum(F.col(f"__b{i}") * F.col(f"__b{j}")) for i in range(p) for j in range(i, p)]
    aggs += [F.sum(F.col(f"__b{i}") * F.col("__r")) for i in range(p)] + [F.sum(F.col("__r") * F.col("__r"))]
    grams = cols.groupBy(*keys).agg(F.array(*aggs).alias("__g"), F.count(F.lit(1)).alias("__n"), F.min("__s").alias("__s0"),
                                    F.max("__s").alias("__s1"))
    upper = np.triu_indices(p)

    def solve(batches):
        for batch in batches:
            for row in batch.to_dict("records"):
                g = np.asarray(row.pop("__g"), float)
                s0, s1 = row.pop("__s0"), row.pop("__s1")
                m = np.zeros((p, p))
                m[upper] = g[:len(upper[0])]
                m = m + np.triu(m, 1).T
                b, yy, n = g[-p - 1:-1], g[-1], row.pop("__n")
                inv = np.linalg.pinv(m, rcond=1e-10, hermitian=True)
                beta = inv @ b
                rank = np.linalg.matrix_rank(m, tol=1e-10 * m.max(), hermitian=True)
                sigma = max(yy - beta @ b, 0) / max(n - rank, 1)
                t = np.linspace(s0, s1, points)
                away = np.abs(t[:, None] * pieces - (np.arange(p) - 1))
                z = np.where(away < 1, (4 - 6 * away**2 + 3 * away**3) / 6, np.maximum(2 - away, 0) ** 3 / 6)
                fit = z @ beta
                se = np.sqrt(np.maximum(((z @ inv) * z).sum(axis=1) * sigma, 0))
                yield pd.DataFrame({**{k: [v] * points for k, v in row.items()}, "__x": low + width * t, "fit": fit,
                                    "lower": fit - 1.959963984540054 * se, "upper": fit + 1.959963984540054 * se})

    schema = ", ".join([f"{k} {kinds[c]}" for k, c in zip(keys, by, strict=True)]
                       + ["__x double", "fit double", "lower double", "upper double"])
    return show_keys(grams.mapInPandas(solve, schema), by).withColumnRenamed("__x", x)


# ---------------------------------------------------------------- simulation

def draw_gamma(shape: np.ndarray, h: np.ndarray, counter: int) -> np.ndarray:
    """Standard gamma variates by squeeze-free rejection on counter-based uniforms."""
    shape = np.broadcast_to(np.asarray(shape, float), h.shape)
    boost = shape < 1
    a = np.where(boost, shape + 1, shape)
    d = a - 1 / 3
    c = 1 / np.sqrt(9 * d)
    out = np.zeros(h.shape)
    todo = np.arange(len(h))
    k = counter
    while len(todo):
        u1, u2, u3 = (counter_uniform(h[todo], k + j) for j in range(3))
        k += 3
        z = np.sqrt(-2 * np.log(u1)) * np.cos(2 * math.pi * u2)
        v = (1 + c[todo] * z) ** 3
        ok = v > 0
        ok[ok] &= np.log(u3[ok]) < 0.5 * z[ok] ** 2 + d[todo][ok] * (1 - v[ok] + np.log(v[ok]))
        out[todo[ok]] = d[todo][ok] * v[ok]
        todo = todo[~ok]
    lift = counter_uniform(h, counter + 1_000_003) ** (1 / np.where(boost, shape, 1))
    return np.where(boost, out * lift, out)


def _count_quantile(target: np.ndarray, mu: np.ndarray, size: float | None) -> np.ndarray:
    """Smallest y with P(Y <= y) >= target, by doubling steps around the mean and then halving."""
    def cdf(y):
        return numeric.poisson_cdf(y, mu) if size is None else numeric.negbin_cdf(y, mu, size)

    if not len(mu):
        return mu
    sd = np.sqrt(mu if size is None else mu + mu * mu / size)
    low, high = np.floor(mu - sd), np.ceil(mu + sd)
    for _ in range(60):
        too_high, too_low = (cdf(np.maximum(low, 0)) >= target) & (low > 0), cdf(high) < target
        if not (too_high.any() or too_low.any()):
            break
        low, high = np.where(too_high, np.maximum(low - (high - low), -1), low), np.where(too_low, high + (high - low), high)
    low = np.maximum(low, -1)
    while (high - low > 1).any():
        middle = np.floor((low + high) / 2)
        enough = cdf(np.maximum(middle, 0)) >= target
        low, high = np.where(enough, low, middle), np.where(enough, middle, high)
    return high


def draw_count(u: np.ndarray, mu: np.ndarray, size: float | None, truncated: bool = False) -> np.ndarray:
    """Poisson or negative binomial variates (size k), optionally given y > 0, by inverting the distribution."""
    with np.errstate(all="ignore"):
        if size is None:
            log_p0, ratio = -mu, mu
        else:
            log_p0, ratio = size * (np.log(size) - np.log(size + mu)), mu / (size + mu)
        p = np.exp(log_p0)
        target = p + u * -np.expm1(log_p0) if truncated else u
        y = np.zeros(len(mu))
        far = np.flatnonzero(log_p0 < -600)            # P(0) underflows: no recurrence from 0
        y[far] = _count_quantile(target[far], mu[far], size)
        left = np.flatnonzero((p < target) & (log_p0 >= -600))  # rows still below their target
        p, total, target, ratio = p[left], p[left], target[left], ratio[left]
        k = 0
        while len(left):
            k += 1
            p = p * (ratio / k if size is None else (size + k - 1) / k * ratio)
            grown = total + p
            done = (grown >= target) | (grown <= total)
            if done.any():
                y[left[done]] = k
                go = ~done
                left, p, target, ratio, grown = left[go], p[go], target[go], ratio[go], grown[go]
            total = grown
    return np.maximum(y, 1) if truncated else y


def draw_response(fam, dispersion: float, m: np.ndarray, shape: np.ndarray, rows: np.ndarray, u: np.ndarray) -> np.ndarray:
    """One response per row of a family with these means, from a row hash and a uniform."""
    if fam.shape == "binomial":
        return (u < m).astype(float)
    if fam.shape == "gamma":
        return draw_gamma(shape, rows, 2) * m / shape
    if fam.shape == "poisson":
        return draw_count(u, m, None)
    if fam.shape == "negbin":
        return draw_count(u, m, fam.theta if math.isfinite(fam.theta) else None, fam.truncated)
    z = np.sqrt(-2 * np.log(u)) * np.cos(2 * math.pi * counter_uniform(rows, 2))
    if fam.shape == "inverse_gaussian":
        q = m * z * z * dispersion / 2
        root = m * (1 + q - np.sqrt(2 * q + q * q))
        return np.where(counter_uniform(rows, 3) <= m / (m + root), root, m * m / root)
    return m + math.sqrt(dispersion) * z


def simulate(model, df: DataFrame, n: int, key: Sequence[str], seed: int = 0, out: str = "y_sim") -> DataFrame:
    """``n`` simulated responses per complete row, long with a ``replicate`` column."""
    scored, extra = _scored(model, df)
    fam, dispersion = model.family, model.dispersion
    many = scored.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(n))))
    uniform = keyed_uniform([*key, "replicate"], seed)
    mu = F.col("__mu")
    if fam.shape == "binomial":
        return many.withColumn(out, (uniform < mu).cast("double")).drop(*extra)

    @F.pandas_udf("double")
    def draw(mean: pd.Series, a: pd.Series, h: pd.Series) -> pd.Series:
        rows = h.to_numpy(np.int64).view(np.uint64)
        return pd.Series(draw_response(fam, dispersion, mean.to_numpy(float), a.to_numpy(float), rows, counter_uniform(rows, 1)))
    return many.withColumn(out, draw(mu, F.col("__shape"), F.xxhash64(*key, "replicate", F.lit(int(seed))))).drop(*extra)
