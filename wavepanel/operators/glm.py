"""Generalized linear models by distributed iteratively reweighted least squares.

The table is read once into a model frame of integer level codes and numeric
inputs. Where rows repeat covariate patterns the frame holds one row per
pattern with its sufficient statistics, so the iterations no longer touch the
data at all. Each iteration is one Spark job whose tasks return one partial
p x p system per model; several models (nested in one design) share the job.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavepanel.functions import numeric
from wavepanel.functions.columns import inverse_link
from wavepanel.functions.results import result_table
from wavepanel.functions.storage import durable
from wavepanel.operators.clean import Levels, find_levels
from wavepanel.operators.families import Family, family as make_family
from wavepanel.operators.terms import Design, base_column, numeric_value, term_label

PATTERN_SHARE = 0.1          # compress when patterns are at most this share of the rows
ROWS_PER_TASK = 50_000       # patterns per task once compressed
SUM_BUCKETS = 16             # arrays that the driver adds up per pass
STEP_TOLERANCE = 1e-15       # predicted deviance gain of the next step, relative to the deviance
FINE_TOLERANCE = 1e-20       # worth one more pass where steps converge quadratically


def _level_values(levels) -> dict:
    return {k: tuple(v.values if isinstance(v, Levels) else v) for k, v in (levels or {}).items()}


class ModelInputs:
    """The complete rows of a model's variables, before level lists and scales are known.

    ``levels`` holds the given lists; the rest is read from an aggregate of the
    rows (``find``), never from an extra scan.
    """

    def __init__(self, df: DataFrame, y: str, terms: Sequence[tuple], levels: Mapping | None,
                 extra: Mapping[str, Column] | None = None):
        given = _level_values(levels)
        kinds = dict(df.dtypes)
        variables = list(dict.fromkeys(v for t in terms for v in t))
        missing = [c for c in [y, *map(base_column, variables)] if c not in kinds]
        if missing:
            raise ValueError(f"columns not in the table: {missing}")
        self.factors = [v for v in variables if isinstance(v, str) and (v in given or kinds[v] in ("string", "boolean"))]
        self.numerics = [v for v in variables if v not in self.factors]
        self.levels = {v: given[v] for v in self.factors if v in given}
        self.unknown = [v for v in self.factors if v not in given]
        named = list(dict.fromkeys(base_column(v) for v in variables))
        rows = df.select(*named, F.col(y).cast("double").alias("__y"), *[c.alias(k) for k, c in (extra or {}).items()])
        rows = rows.dropna("any")
        for v, values in self.levels.items():
            rows = rows.where(F.col(v).isin(list(values)))
        self.rows = rows

    def find(self, table: DataFrame) -> None:
        """Complete the level lists from a table that still has the factor columns."""
        if self.unknown:
            found = find_levels(table, self.unknown)
            self.levels.update({c: found[c].values for c in self.unknown})
            self.unknown = []

    def probe(self, bad: Column, patterns_of: Sequence[str] = ()) -> tuple[int, int, int, dict]:
        """(rows, bad responses, covariate patterns, mean and sd per numeric variable) from one scan.

        Grouped by the factors: the groups give the level lists, and the
        patterns of disjoint groups add up.
        """
        n = F.count(F.lit(1))
        values = [numeric_value(v) for v in self.numerics]
        hashed = [*values, *[F.col(c) for c in patterns_of]]
        groups = self.rows.groupBy(*self.factors).agg(
            n.alias("__n"), F.sum(bad.cast("long")).alias("__bad"),
            (F.approx_count_distinct(F.xxhash64(*hashed)) if hashed else F.lit(1)).alias("__d"),
            *[x for i, v in enumerate(values) for x in (F.avg(v).alias(f"__a{i}"), (F.var_pop(v) * n).alias(f"__s{i}"))],
        ).persist()
        try:
            self.find(groups)
            weight = F.sum("__n")
            sums = []
            for i in range(len(values)):
                a = F.col(f"__a{i}")
                mean = F.sum(F.col("__n") * a) / weight
                sums += [mean, F.sqrt((F.sum(f"__s{i}") + F.sum(F.col("__n") * a * a)) / weight - mean * mean)]
            row = groups.agg(weight, F.sum("__bad"), F.sum("__d"), *sums).first()
        finally:
            groups.unpersist()
        clean = [None if v is None or math.isnan(v) else v for v in row[3:]]
        stats = {v: (clean[2 * i] or 0.0, clean[2 * i + 1]) for i, v in enumerate(self.numerics)}
        return row[0] or 0, row[1] or 0, row[2] or 0, stats


def narrow(spark: SparkSession, data: DataFrame, patterns: int) -> DataFrame:
    """Fewer partitions for a pattern table of known size; the count bounds the rows per task."""
    tasks = max(math.ceil(patterns * 1.2 / ROWS_PER_TASK), 1)
    wide = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return data.coalesce(tasks) if tasks < wide else data


def independent_columns(gram: np.ndarray, tol: float = 1e-10) -> list[int]:
    """Columns kept by a Cholesky sweep in column order; the dropped ones are aliased to earlier ones."""
    a = np.array(gram, dtype=float)
    start = np.diag(a).copy()
    kept = []
    for j in range(len(a)):
        if start[j] <= 0 or a[j, j] <= tol * start[j]:
            continue
        kept.append(j)
        pivot = a[j, j]
        rest = np.arange(len(a)) > j
        a[np.ix_(rest, rest)] -= np.outer(a[rest, j], a[j, rest]) / pivot
    return kept


def sum_arrays(df: DataFrame, column: str = "v") -> np.ndarray:
    """Elementwise sum of an array column of equal lengths; its result has the size of one model system.

    The arrays move whole, one row per task, into SUM_BUCKETS buckets where they are
    added up in Arrow; the driver adds one array per bucket. So what is shuffled
    is a row per task, and what is collected does not depend on the tasks.
    """
    def add(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                v = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).sum(axis=0)
                total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["v"])

    dealt = df.select(F.col(column).alias("v"), F.pmod(F.spark_partition_id(), F.lit(SUM_BUCKETS)).alias("b")).repartition(SUM_BUCKETS, "b")
    rows = dealt.select("v").mapInArrow(add, "v array<double>").collect()
    return np.sum([np.asarray(r["v"], float) for r in rows], axis=0) if rows else np.zeros(0)


def partial_sums(kernel):
    """mapInPandas function that adds up ``kernel(batch)`` vectors over a partition."""
    def run(batches):
        total = None
        for batch in batches:
            if len(batch):
                v = kernel(batch)
                total = v if total is None else total + v
        if total is not None:
            yield pd.DataFrame({"v": [total]})
    return run


@dataclass
class _Fit:
    """State of one model of a batch: its design columns and the last accepted step."""
    cols: list[int]
    beta: np.ndarray | None = None
    before: np.ndarray | None = None
    deviance_before: float = math.inf
    halvings: int = 0
    near: bool = False
    done: bool = False
    converged: bool = False
    checked: bool = False
    gram: np.ndarray | None = None        # expected information, up to the dispersion
    expected: np.ndarray | None = None    # the same where it does not depend on the estimate
    deviance: float = math.nan
    pearson: float = math.nan
    extreme: float = 0.0
    passes: int = 0


class ModelFrame:
    """Complete rows of one response and term list, ready for repeated fitting."""

    def __init__(self, df: DataFrame, y: str, terms: Sequence[tuple], family: str | Family = "gaussian",
                 link: str | None = None, levels: Mapping | None = None, intercept: bool = True,
                 theta: float | None = None, compress: bool | str = "auto"):
        self.spark = df.sparkSession
        self.y, self.family = y, make_family(family, link, theta)
        self.passes = 0
        inputs = ModelInputs(df, y, terms, levels)
        y_ = F.col("__y")
        is_bad = self.family.bad_response(y_)
        squares = F.coalesce(F.var_pop(y_), F.lit(0.0)) * F.count(F.lit(1))
        sums = [F.count(F.lit(1)).cast("double").alias("__n"), F.avg(y_).alias("__m"), squares.alias("__ss"),
                F.sum(self.family.saturated(y_)).alias("__sat"), F.sum(is_bad.cast("long")).alias("__bad")]
        if not inputs.numerics and compress is not False:
            # Factors only: one scan to the cells, and everything else comes from the cells.
            self._cached = durable(inputs.rows.groupBy(*inputs.factors).agg(*sums))
            inputs.find(self._cached)
            self.design = Design(terms, inputs.levels, intercept)
            names = self.design.input_names()
            cells = math.prod(len(v) for v in self.design.levels.values())
            coded = self._cached.select(*self.design.input_columns(), "__n", "__m", "__ss", "__sat", "__bad")
            self.data = narrow(self.spark, coded, cells)
            self.compressed = True
        else:
            n, bad, patterns, stats = inputs.probe(is_bad)
            self._check(n, bad)
            self.design = Design(terms, inputs.levels, intercept)
            self.design.standardise(stats)
            names = self.design.input_names()
            rows = inputs.rows.select(*self.design.input_columns(), "__y")
            self.compressed = patterns <= max(PATTERN_SHARE * n, 1) if compress == "auto" else bool(compress)
            if self.compressed:
                self._cached = durable(rows.groupBy(*names).agg(*sums))
            else:
                raw = rows.select(*names, F.lit(1.0).alias("__n"), y_.alias("__m"), F.lit(0.0).alias("__ss"),
                                           self.family.saturated(y_).alias("__sat"), F.lit(0).cast("long").alias("__bad"))
                # As many rows as the source: a lost block is recomputed from its own split of it.
                self._cached = raw.persist(StorageLevel.MEMORY_AND_DISK)
            self.data = narrow(self.spark, self._cached, patterns) if self.compressed else self._cached
        total = self.data.agg(F.sum("__n"), F.sum("__bad"), F.sum("__sat"), F.sum(F.col("__n") * F.col("__m"))).first()
        try:
            self._check(total[0] or 0, total[1])
        except ValueError:
            self.release()
            raise
        self.n, self.saturated, self.sum_y = int(total[0]), total[2], total[3]
        self.constant = self._density_constant(inputs.rows)

    def _density_constant(self, rows: DataFrame) -> Callable[[], float]:
        """The sum of the density's constants, one evaluation per distinct response; a scan of its own, made when it is asked for."""
        family = self.family
        if family.density_constant(np.ones(1)) is None:
            return lambda: 0.0

        @F.pandas_udf("double")
        def constant(y: pd.Series) -> pd.Series:
            return pd.Series(family.density_constant(y.to_numpy(float)))
        counts = rows.groupBy("__y").agg(F.count(F.lit(1)).alias("c"))
        return lambda: counts.agg(F.sum(F.col("c") * constant("__y"))).first()[0]

    def _check(self, n, bad) -> None:
        if not n:
            raise ValueError("no complete rows to fit")
        if bad:
            raise ValueError(f"{bad} values of {self.y!r} are outside the range of the {self.family.name} family")

    def release(self) -> None:
        self._cached.unpersist()

    def __enter__(self):
        return self

    def __exit__(self, *exc):
        self.release()

    # ------------------------------------------------------------ iteration

    def _pass(self, fits: list[_Fit]) -> None:
        """One job: system, deviance and Pearson sum of every unfinished model at its current estimate."""
        design, fam = self.design, self.family
        jobs = [(f.cols, f.beta) for f in fits]

        def kernel(batch):
            x_all = design.matrix(batch)
            n, m, ss, sat = (batch[c].to_numpy(float) for c in ("__n", "__m", "__ss", "__sat"))
            out = []
            for cols, beta in jobs:
                x = x_all[:, cols]
                eta = fam.link_fun(fam.start(n, m)) if beta is None else x @ beta
                with np.errstate(all="ignore"):
                    mu = fam.mean(eta)
                    slope = fam.slope(eta, mu)
                    var = fam.variance(mu)
                    w = n * slope * slope / var
                    work = (m - mu) / slope
                    dev = fam.deviance(n, m, ss, sat, mu)
                    pearson = (ss + n * (m - mu) ** 2) / var
                    bad = ~fam.valid(eta, mu)
                if beta is None:
                    work = work + eta
                elif fam.observed_weights:
                    w = n * m / mu
                    work = 1 - mu / m
                if beta is not None and bad.any():
                    dev = np.where(bad, np.inf, dev)
                    w, work = np.where(bad, 0.0, w), np.where(bad, 0.0, work)
                xw = x * w[:, None]
                gram = x.T @ xw
                extreme = n[(mu < 1e-8) | (mu > 1 - 1e-8)].sum() if fam.shape == "binomial" else 0.0
                out += [gram[np.triu_indices(len(cols))], xw.T @ work, [dev.sum(), pearson.sum(), extreme]]
            return np.concatenate(out) if out else np.zeros(0)

        needed = self.data.select(*design.input_names(), "__n", "__m", "__ss", "__sat")
        flat = sum_arrays(needed.mapInPandas(partial_sums(kernel), "v array<double>"))
        self.passes += 1
        at = 0
        for f in fits:
            p = len(f.cols)
            size = p * (p + 1) // 2
            gram = np.zeros((p, p))
            gram[np.triu_indices(p)] = flat[at:at + size]
            gram = gram + np.triu(gram, 1).T
            rhs = flat[at + size:at + size + p]
            dev, pearson, extreme = flat[at + size + p:at + size + p + 3]
            at += size + p + 3
            f.passes += 1
            self._advance(f, fam, gram, rhs, dev, pearson, extreme)

    @staticmethod
    def _advance(f: _Fit, fam: Family, gram, rhs, dev, pearson, extreme) -> None:
        if not f.checked:
            kept = independent_columns(gram)
            if len(kept) < len(f.cols):
                gram, rhs = gram[np.ix_(kept, kept)], rhs[kept]
                f.cols = [f.cols[k] for k in kept]
                if f.beta is not None:
                    f.beta = f.beta[kept]
            f.checked = True
        if f.beta is None:
            f.beta = np.linalg.solve(gram, rhs)
            f.expected = gram if fam.observed_weights else None
            return
        if not math.isfinite(dev) or dev > f.deviance_before + 1e-9 * (abs(f.deviance_before) + 0.1):
            if f.before is None or f.halvings >= 30:
                raise ArithmeticError("the fit left the valid range of the family; try another link")
            f.beta = (f.beta + f.before) / 2
            f.halvings += 1
            return
        step = np.linalg.solve(gram, rhs) if len(f.cols) else np.zeros(0)
        gain = float(rhs @ step)
        f.gram = gram if f.expected is None else f.expected
        f.deviance, f.pearson, f.extreme = dev, pearson, extreme
        size = abs(dev) + 0.1
        if gain <= STEP_TOLERANCE * size:
            if f.near or not fam.quadratic or gain <= FINE_TOLERANCE * size:
                f.beta = f.beta + step
                f.done = f.converged = True
                return
            f.near = True
        f.before, f.deviance_before = f.beta, dev
        f.beta = f.beta + step

    def solve(self, column_sets: Sequence[Sequence[int]], max_passes: int = 40) -> list[_Fit]:
        """Fit several models, each a subset of the design columns, together."""
        fits = [_Fit(list(c), beta=None if len(c) else np.zeros(0)) for c in column_sets]
        for _ in range(max_passes):
            active = [f for f in fits if not f.done]
            if not active:
                break
            self._pass(active)
        for f in fits:
            if not f.done and f.gram is None:
                raise ArithmeticError("no finite deviance was reached")
        return fits

    def fit(self, also: Sequence[Sequence[int]] = ()) -> tuple[GlmModel, list[_Fit]]:
        """Full model, plus further column subsets solved in the same passes."""
        everything = list(range(self.design.p))
        null = [0] if self.design.intercept else []
        if not null and self.family.link in ("inverse", "1/mu^2"):     # eta = 0 has no mean: the deviance is infinite
            null = everything
        sets = [everything, null, *[list(s) for s in also]]
        distinct = list(dict.fromkeys(tuple(s) for s in sets))
        fits = dict(zip(distinct, self.solve(distinct), strict=True))
        model = self._model(fits[tuple(everything)], fits[tuple(null)])
        if not self.design.intercept and null is everything:
            model.null_deviance, model.df_null = math.inf, self.n
        return model, [fits[tuple(s)] for s in also]

    def _model(self, full: _Fit, null: _Fit) -> GlmModel:
        rank = len(full.cols)
        df_resid = self.n - rank
        fam = self.family
        dispersion = 1.0 if fam.dispersion_known else (full.pearson / df_resid if df_resid > 0 else math.nan)
        inverse = np.linalg.inv(full.gram)
        model = GlmModel(
            design=self.design, family=fam, y=self.y, n=self.n, cols=full.cols, beta_scaled=full.beta,
            cov_scaled=inverse * dispersion, dispersion=dispersion, deviance=full.deviance, pearson=full.pearson,
            df_resid=df_resid, null_deviance=null.deviance, df_null=self.n - len(null.cols),
            converged=full.converged, passes=full.passes, saturated=self.saturated, compressed=self.compressed,
            constant=self.constant)
        labels = self.design.labels()
        model.aliased = [labels[j] for j in range(self.design.p) if j not in full.cols]
        if model.aliased:
            model.warnings.append(f"rank deficient; aliased: {model.aliased}")
        if not full.converged:
            model.warnings.append("did not converge")
        if fam.shape == "binomial" and full.extreme > 0:
            model.warnings.append(f"separation: fitted probability 0 or 1 on {full.extreme:.0f} rows")
        return model


class LinearModel:
    """Scoring shared by all fitted models: needs ``design``, ``beta`` (all columns), ``cols``, ``family``, ``y``."""

    def inputs(self, df: DataFrame) -> DataFrame:
        return df.select("*", *self.design.input_columns())

    def eta(self) -> Column:
        """Linear predictor over the input columns."""
        return self.design.linear_predictor(self.beta)

    def with_mean(self, df: DataFrame, out: str = "fitted") -> DataFrame:
        """Fitted mean per row, entirely JVM-side; NULL where an input is missing."""
        scored = self.inputs(df).withColumn(out, inverse_link(self.eta(), self.family.link))
        return scored.drop(*self.design.input_names())

    def fitted(self, df: DataFrame, out: str = "fitted") -> DataFrame:
        """Distinct fitted values: one row per observed combination of the model variables."""
        names = [base_column(v) for t in self.design.terms for v in t]
        cells = df.dropna("any", subset=[self.y, *dict.fromkeys(names)]).select(*dict.fromkeys(names)).distinct()
        return self.with_mean(cells, out)

    def term_names(self) -> list[str]:
        return [term_label(t) for t in self.design.terms]

    @property
    def rank(self) -> int:
        return len(self.cols)

    @property
    def labels(self) -> list[str]:
        names = self.design.labels()
        return [names[j] for j in self.cols]

    @property
    def coef(self) -> dict[str, float]:
        names = self.design.labels()
        return {names[j]: float(self.beta[j]) for j in self.cols}


@dataclass
class GlmModel(LinearModel):
    """A fitted model: p-vector and p x p covariance on the driver; per-row results are DataFrames."""

    design: Design
    family: Family
    y: str
    n: int
    cols: list[int]
    beta_scaled: np.ndarray
    cov_scaled: np.ndarray
    dispersion: float
    deviance: float
    pearson: float
    df_resid: int
    null_deviance: float
    df_null: int
    converged: bool
    passes: int
    saturated: float
    compressed: bool
    constant: Callable[[], float] = lambda: 0.0
    aliased: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    def __post_init__(self):
        a = self.design.unscale()[:, self.cols]
        self.beta = a @ self.beta_scaled                 # all design columns; aliased ones are 0
        self.cov = (a @ self.cov_scaled @ a.T)[np.ix_(self.cols, self.cols)]

    @property
    def shape(self) -> float:
        """Maximum-likelihood Gamma shape given the fitted means: log(a) - digamma(a) = deviance / 2n."""
        target = self.deviance / (2 * self.n)
        a = (3 - target + math.sqrt((target - 3) ** 2 + 24 * target)) / (12 * target)
        for _ in range(50):
            step = (math.log(a) - float(numeric.digamma(a)) - target) / (1 / a - float(numeric.trigamma(a)))
            new = a - step if a - step > 0 else a / 2
            if abs(new - a) < 1e-12 * a:
                break
            a = new
        return a

    # ------------------------------------------------ result tables

    def coef_table(self, spark: SparkSession) -> DataFrame:
        """Estimate, standard error, z or t and p per coefficient; aliased ones have NULL."""
        se = dict(zip(self.cols, np.sqrt(np.diag(self.cov)), strict=True))
        rows = []
        for j, label in enumerate(self.design.labels()):
            if j not in se:
                rows.append((j, label, None, None, None, None))
                continue
            b, s = float(self.beta[j]), float(se[j])
            stat = b / s if s > 0 else math.nan
            p = numeric.normal_two_sided(stat) if self.family.dispersion_known else numeric.t_two_sided(stat, self.df_resid)
            rows.append((j, label, b, s, stat, p))
        return result_table(spark, rows, "position int, term string, estimate double, std_error double, "
                                           "statistic double, p_value double")

    @cached_property
    def density_constant(self) -> float:
        return self.constant()

    def log_likelihood(self) -> float | None:
        n, dev, s = self.n, self.deviance, self.family.name
        if s == "gaussian":
            return -0.5 * n * (math.log(2 * math.pi * dev / n) + 1)
        if s == "binomial":
            return self.saturated - dev / 2
        if s == "gamma":
            a = n / dev
            return n * (a * math.log(a) - math.lgamma(a)) + (a - 1) * self.saturated - a * (dev / 2 + self.saturated + n)
        if s in ("poisson", "negbin"):
            return self.saturated - dev / 2 + self.density_constant
        if s == "inverse_gaussian":
            return -0.5 * n * (math.log(2 * math.pi * dev / n) + 1) + self.density_constant
        return None

    @property
    def aic(self) -> float | None:
        ll = self.log_likelihood()
        if ll is None:
            return None
        return -2 * ll + 2 * (self.rank + (0 if self.family.dispersion_known else 1))

    def stats(self, spark: SparkSession) -> DataFrame:
        row = dict(n=self.n, rank=self.rank, null_deviance=float(self.null_deviance), df_null=self.df_null,
                   deviance=float(self.deviance), df_resid=self.df_resid, dispersion=float(self.dispersion),
                   aic=self.aic, r_squared=None, adj_r_squared=None, f_statistic=None, f_p_value=None,
                   converged=self.converged, passes=self.passes)
        if self.family.name == "gaussian" and self.design.intercept and self.null_deviance > 0:
            df1 = self.rank - 1
            r2 = 1 - self.deviance / self.null_deviance
            row["r_squared"] = r2
            row["adj_r_squared"] = 1 - (1 - r2) * self.df_null / self.df_resid
            if df1:
                f = (self.null_deviance - self.deviance) / df1 / self.dispersion
                row["f_statistic"], row["f_p_value"] = f, numeric.f_tail(f, df1, self.df_resid)
        schema = ("n long, rank int, null_deviance double, df_null long, deviance double, df_resid long, "
                  "dispersion double, aic double, r_squared double, adj_r_squared double, f_statistic double, "
                  "f_p_value double, converged boolean, passes int")
        return result_table(spark, [tuple(row.values())], schema)

    def _matrix_table(self, spark, m, value) -> DataFrame:
        rows = [(a, b, float(m[i, j])) for i, a in enumerate(self.labels) for j, b in enumerate(self.labels)]
        return result_table(spark, rows, f"term_a string, term_b string, {value} double")

    def vcov(self, spark: SparkSession) -> DataFrame:
        return self._matrix_table(spark, self.cov, "covariance")

    def corr(self, spark: SparkSession) -> DataFrame:
        sd = np.sqrt(np.diag(self.cov))
        return self._matrix_table(spark, self.cov / np.outer(sd, sd), "correlation")


def fit_glm(df: DataFrame, y: str, terms: Sequence[tuple], family: str | Family = "gaussian",
            link: str | None = None, levels: Mapping | None = None, intercept: bool = True,
            theta: float | None = None, compress: bool | str = "auto") -> GlmModel:
    with ModelFrame(df, y, terms, family, link, levels, intercept, theta, compress) as frame:
        return frame.fit()[0]
