"""Grouped summaries, exact quantiles, boxes, histograms and marginal means."""

from __future__ import annotations

import math
import sys
import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavepanel.functions.columns import all_of
from wavepanel.functions.storage import durable, maybe_broadcast
from wavepanel.operators.clean import Levels
from wavepanel.operators.joins import left_join

# A group with at most this many distinct values is summarised by Spark's exact
# percentile, whose state is one entry per distinct value.
EXACT_DISTINCT = 200_000
LARGEST = sys.float_info.max


def _names(by) -> list[str]:
    return [] if by is None else [by] if isinstance(by, str) else list(by)


def hide_keys(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Rename grouping columns to ``__k0..`` so that working columns cannot clash with them."""
    return df.withColumnsRenamed({c: f"__k{i}" for i, c in enumerate(by)}), [f"__k{i}" for i in range(len(by))]


def show_keys(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({f"__k{i}": c for i, c in enumerate(by)})


def _mean(col: str, na: str) -> Column:
    if na == "skip":
        return F.avg(col)
    if na == "propagate":
        return F.when(F.count(col) == F.count(F.lit(1)), F.avg(col))
    raise ValueError("na must be 'skip' or 'propagate'")


def std_error(col: str | Column) -> Column:
    """sd / sqrt(number of non-missing values)."""
    return F.stddev_samp(col) / F.sqrt(F.count(col))


def group_mean(df: DataFrame, by: Sequence[str] | str | None, cols: Sequence[str], na: str = "skip",
               casewise: bool = False, suffix: str = "") -> DataFrame:
    """Mean of each column per group.

    ``casewise`` first drops every row with a missing response or grouping
    value, so that all columns share the same rows.
    """
    by = _names(by)
    if casewise:
        df = df.dropna("any", subset=[*by, *cols])
    return df.groupBy(*by).agg(*[_mean(c, na).alias(c + suffix) for c in cols])


def group_stderr(df: DataFrame, by: Sequence[str] | str | None, cols: Sequence[str],
                 suffix: str = "_se") -> DataFrame:
    return df.groupBy(*_names(by)).agg(*[std_error(c).alias(c + suffix) for c in cols])


def group_count(df: DataFrame, by: Sequence[str] | str, col: str | None = None, out: str = "n") -> DataFrame:
    """Rows per group, or rows in which ``col`` and all keys are present."""
    by = _names(by)
    if col is None:
        return df.groupBy(*by).agg(F.count(F.lit(1)).alias(out))
    return df.dropna("any", subset=[*by, col]).groupBy(*by).agg(F.count(F.lit(1)).alias(out))


def moment_cube(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Count, mean and sum of squared deviations of each column per finest cell: ``by..., {col}_n, {col}_mean, {col}_m2``.

    One aggregation from which ``roll_up`` makes any coarser layer without the rows.
    """
    return df.groupBy(*by).agg(*[x for c in cols for x in (
        F.count(c).alias(f"{c}_n"), F.avg(c).alias(f"{c}_mean"), (F.var_pop(c) * F.count(c)).alias(f"{c}_m2"))])


def roll_up(cube: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Exact moments of the coarser cells of a cube, merged around each coarser cell's own mean."""
    cube, keys = hide_keys(cube, by)
    cell = Window.partitionBy(*keys)

    def n(c):
        return F.col(f"{c}_n")

    means = cube.select("*", *[(F.sum(n(c) * F.col(f"{c}_mean")).over(cell) / F.nullif(F.sum(n(c)).over(cell), F.lit(0))).alias(f"__m_{c}") for c in cols])
    aggs = []
    for c in cols:
        gap = F.col(f"{c}_mean") - F.col(f"__m_{c}")
        aggs += [F.sum(n(c)).alias(f"{c}_n"), F.first(f"__m_{c}").alias(f"{c}_mean"), F.sum(F.col(f"{c}_m2") + n(c) * gap * gap).alias(f"{c}_m2")]
    return show_keys(means.groupBy(*keys).agg(*aggs), by)


def moment_error(col: str) -> Column:
    """Standard error of the mean from a column's moments."""
    n = F.col(f"{col}_n")
    return F.when(n > 1, F.sqrt(F.col(f"{col}_m2") / (n - 1)) / F.sqrt(n))


def describe_layers(cube: DataFrame, by: Sequence[str], cols: Sequence[str], measure: str = "measure") -> DataFrame:
    """Mean, standard error and n per cell of a rolled-up cube, long: ``by..., measure, mean, se, n``."""
    layers = roll_up(cube, by, cols)
    rows = [F.struct(F.lit(c).alias(measure), F.col(f"{c}_mean").alias("mean"), moment_error(c).alias("se"), F.col(f"{c}_n").alias("n")) for c in cols]
    return layers.select(*by, F.inline(F.array(*rows)))


def describe_waves(df: DataFrame, by: Sequence[str], measures: Mapping[str, Sequence[str]],
                   index: str = "wave", measure: str = "measure") -> DataFrame:
    """Mean, standard error and n per group x measure x wave.

    The wide columns are aggregated as they are and only the small result is
    turned long, so the scan is not multiplied by the number of waves.
    """
    by = _names(by)
    flat = [(m, c) for m, cols in measures.items() for c in cols]
    aggs = [F.struct(F.avg(c).alias("mean"), std_error(c).alias("se"), F.count(c).alias("n")).alias(f"__s{i}")
            for i, (_, c) in enumerate(flat)]
    wide = df.groupBy(*by).agg(*aggs)
    rows = [F.struct(F.lit(m).alias(measure), F.lit(int(c[len(c.rstrip("0123456789")):] or 0)).alias(index),
                     F.col(f"__s{i}.mean").alias("mean"), F.col(f"__s{i}.se").alias("se"), F.col(f"__s{i}.n").alias("n"))
            for i, (m, c) in enumerate(flat)]
    return wide.select(*by, F.inline(F.array(*rows)))


# ---------------------------------------------------------------- quantiles

def quantiles(df: DataFrame, col: str, probs: Sequence[float], by: Sequence[str] | str | None = None,
              exact_distinct: int = EXACT_DISTINCT) -> DataFrame:
    """Exact type-7 quantiles per group, as columns ``by..., n, q0, q1, ...``.

    One probing job measures the distinct values per group. If every group is
    small enough, Spark's exact ``percentile`` answers in one aggregation.
    Otherwise the wanted order statistics are enclosed in value brackets that
    shrink by counting, so no task ever holds a whole group.
    """
    return counted_quantiles(df, col, probs, by, exact_distinct)[0]


def counted_quantiles(df: DataFrame, col: str, probs: Sequence[float], by=None, exact_distinct: int = EXACT_DISTINCT,
                      with_moments: bool = False) -> tuple[DataFrame, int]:
    """``quantiles`` and the number of groups; ``with_moments`` adds ``min``, ``mean`` and ``max``."""
    by = _names(by)
    probs = [float(p) for p in probs]
    x = F.col(col).cast("double")
    data, keys = hide_keys(df.where(x.isNotNull() & ~F.isnan(x)).select(*by, x.alias("__x")), by)
    widest, groups = data.groupBy(*keys).agg(F.approx_count_distinct("__x").alias("d")).agg(F.max("d"), F.count("d")).first()
    moments = [F.min("__x").alias("min"), F.avg("__x").alias("mean"), F.max("__x").alias("max")] if with_moments else []
    if (widest or 0) * 1.2 <= exact_distinct:
        found = data.groupBy(*keys).agg(
            F.count("__x").alias("n"),
            F.percentile("__x", F.array(*[F.lit(p) for p in probs])).alias("__q"), *moments)
        names = ["min", "mean", "max"] if with_moments else []
        out = found.select(*keys, "n", *[F.col("__q")[i].alias(f"q{i}") for i in range(len(probs))], *names)
        return show_keys(out, by), groups
    if not by:
        data, keys = data.withColumn("__k0", F.lit(0)), ["__k0"]
    out = _bracketed_quantiles(data, keys, probs, exact_distinct)
    if with_moments:
        extra = data.groupBy(*keys).agg(*moments).withColumnsRenamed({k: f"__m{k}" for k in keys})
        out = out.join(extra, all_of([F.col(k).eqNullSafe(F.col(f"__m{k}")) for k in keys])).drop(*[f"__m{k}" for k in keys])
    return (show_keys(out, by) if by else out.drop("__k0")), groups


def _unclipped(bound: tuple[str, Column, Column, Column]) -> Column:
    """Interpolate between two order statistics; the largest finite doubles stand for the infinities."""
    name, *ends, part = bound
    low, high = (F.when(e >= LARGEST, F.lit(math.inf)).when(e <= -LARGEST, F.lit(-math.inf)).otherwise(e) for e in ends)
    return F.when((low == high) | (part == 0), low).otherwise(low + part * (high - low)).alias(name)


def _bracketed_quantiles(data: DataFrame, key: list[str], probs: list[float], limit: int,
                         cells: int = 1024) -> DataFrame:
    """Narrow a closed bracket [lo, hi] around each order statistic, one counting pass per round.

    A pass splits every bracket into equal-width cells, counts them (combined
    map-side) and keeps the cell that contains the wanted rank. A bracket is
    done when it holds at most ``limit`` rows or a single value.
    """
    # Infinite ends have no width: brackets are cut between the largest finite doubles.
    data = data.withColumn("__x", F.greatest(F.least(F.col("__x"), F.lit(LARGEST)), F.lit(-LARGEST)))
    total = data.groupBy(*key).agg(F.count("__x").alias("n"), F.min("__x").alias("lo"), F.max("__x").alias("hi"))
    # The two order statistics that a type-7 quantile interpolates between.
    targets = durable(total.select(*key, "n", "lo", "hi", F.posexplode(F.array(*[F.lit(p) for p in probs])).alias("qi", "p"))
               .withColumn("h", (F.col("n") - 1) * F.col("p"))
               .withColumn("k", F.floor("h") + 1)
               .select(*key, "qi", "n", "h", "lo", "hi", F.posexplode(F.array(
                   F.col("k"), F.least(F.col("k") + 1, F.col("n")))).alias("side", "rank")))
    wanted = targets.count()                      # groups x probs x 2, also bounds the brackets

    def same(left, right, extra=()):
        return all_of([F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in [*key, *extra]])

    before = None
    while True:
        brackets = maybe_broadcast(targets.select(*key, "lo", "hi").distinct(), wanted)
        within = (data.alias("d").join(brackets.alias("b"), same("d", "b") & F.expr("d.__x between b.lo and b.hi"))
                  .select(*[F.col(f"b.{c}") for c in [*key, "lo", "hi"]], "d.__x"))
        # halves, as the whole range of doubles has no finite width
        place = F.floor((F.col("__x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * F.lit(cells))
        cell = F.when(F.col("hi") > F.col("lo"), F.least(place, F.lit(cells - 1))).otherwise(F.lit(0))
        counted = within.groupBy(*key, "lo", "hi", cell.alias("cell")).agg(
            F.count(F.lit(1)).alias("c"), F.min("__x").alias("mn"), F.max("__x").alias("mx"))
        upto = F.sum("c").over(Window.partitionBy(*key, "lo", "hi").orderBy("cell"))
        narrowed = durable(counted.withColumn("upto", upto).alias("c")
                    .join(targets.alias("t"), same("c", "t", ("lo", "hi"))
                          & F.expr("c.upto >= t.rank and c.upto - c.c < t.rank"))
                    .select(*[F.col(f"t.{c}") for c in [*key, "qi", "side", "n", "h"]],
                            F.expr("t.rank - (c.upto - c.c)").alias("rank"),
                            F.col("c.mn").alias("lo"), F.col("c.mx").alias("hi"), F.col("c.c").alias("rows")))
        left, width = narrowed.where("hi > lo").agg(F.max("rows"), F.sum(F.col("hi") / 2 - F.col("lo") / 2)).first()
        targets.unpersist()
        targets = narrowed
        if (left or 0) <= limit:
            break
        if (left, width) == before:
            raise ValueError("quantile brackets no longer shrink")
        before = (left, width)
    # Each bracket now holds few rows or one value: finish on value counts.
    brackets = maybe_broadcast(targets.select(*key, "lo", "hi").distinct(), wanted)
    values = (data.alias("d").join(brackets.alias("b"), same("d", "b") & F.expr("d.__x between b.lo and b.hi"))
              .groupBy(*[F.col(f"b.{c}").alias(c) for c in [*key, "lo", "hi"]], F.col("d.__x").alias("v"))
              .agg(F.count(F.lit(1)).alias("c")))
    upto = F.sum("c").over(Window.partitionBy(*key, "lo", "hi").orderBy("v"))
    found = (values.withColumn("upto", upto).alias("c")
             .join(targets.alias("t"), same("c", "t", ("lo", "hi"))
                   & F.expr("c.upto >= t.rank and c.upto - c.c < t.rank"))
             .select(*[F.col(f"t.{c}") for c in [*key, "qi", "side", "n", "h"]], "c.v"))
    cols = []
    for i in range(len(probs)):
        at = F.col("qi") == i
        low = F.max(F.when(at & (F.col("side") == 0), F.col("v")))
        high = F.max(F.when(at & (F.col("side") == 1), F.col("v")))
        part = F.max(F.when(at, F.col("h") - F.floor("h")))
        cols.append((f"q{i}", low, high, part))
    return found.groupBy(*key).agg(F.max("n").alias("n"), *[_unclipped(c) for c in cols])


def six_num(df: DataFrame, col: str, by: Sequence[str] | str | None = None) -> DataFrame:
    """min, Q1, median, mean, Q3, max and n per group."""
    q = counted_quantiles(df, col, (0.25, 0.5, 0.75), by, with_moments=True)[0]
    return q.select(*_names(by), "n", "min", F.col("q0").alias("q1"), F.col("q1").alias("median"), "mean",
                    F.col("q2").alias("q3"), "max")


def _rekeyed(df: DataFrame, by: Sequence[str], prefix: str = "__k_") -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) if c in by else F.col(c) for c in df.columns])


def box_stats(df: DataFrame, by: Sequence[str] | str, col: str, whisker: float = 1.5) -> tuple[DataFrame, DataFrame]:
    """Box-plot statistics per cell and the rows outside the whiskers.

    Hinges are type-7 quartiles; whiskers reach the most extreme value within
    ``whisker`` interquartile ranges of the hinges.
    """
    by = _names(by)
    data = df.where(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double")))
    q, cells = counted_quantiles(data, col, (0.25, 0.5, 0.75), by)
    iqr = F.col("q2") - F.col("q0")
    fences = _rekeyed(q.select(*by, "n", F.col("q0").alias("__lower"), F.col("q1").alias("__median"),
                               F.col("q2").alias("__upper"), (F.col("q0") - whisker * iqr).alias("__lo"),
                               (F.col("q2") + whisker * iqr).alias("__hi")), by)
    if by:      # one row per cell on the right; the cells have been counted
        fenced = data.join(maybe_broadcast(fences, cells), all_of([F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in by]))
    else:
        only = fences.first()
        fenced = data.withColumns({c: F.lit(only[c] if only else None).cast("double") for c in fences.columns if c != "n"})
    x = F.col(col)
    inside = x.between(F.col("__lo"), F.col("__hi"))
    stats = fenced.groupBy(*by).agg(
        F.count(x).alias("n"), F.min(F.when(inside, x)).alias("ymin"), F.first("__lower").alias("lower"),
        F.first("__median").alias("middle"), F.first("__upper").alias("upper"),
        F.max(F.when(inside, x)).alias("ymax"), F.count(F.when(~inside, x)).alias("n_outliers"))
    outliers = fenced.where(~inside).select(*df.columns)
    return stats, outliers


def box_layers(df: DataFrame, by: Sequence[str] | str, layers: Mapping[str, str | Column], col: str, whisker: float = 1.5,
               layer: str = "layer", cell: str = "cell") -> tuple[DataFrame, DataFrame]:
    """``box_stats`` of several groupings at once: per layer the cells of ``by`` and the layer's own column.

    A layer is a part of the key, so all of them share every pass of the quantiles; the values are read once and kept.
    """
    by = _names(by)
    x = F.col(col).cast("double")
    several = F.array(*[F.struct(F.lit(name).alias(layer), (F.col(c) if isinstance(c, str) else c).cast("string").alias(cell)) for name, c in layers.items()])
    kept = durable(df.where(x.isNotNull() & ~F.isnan(x)).select(*by, col, several.alias("__layers")))
    each = kept.select(*by, col, F.inline("__layers"))
    return box_stats(each, [*by, layer, cell], col, whisker)


def crosstab_prop(df: DataFrame, row: str, col: str, row_levels: Levels | Sequence | None = None,
                  col_levels: Levels | Sequence | None = None, margin: str = "row") -> DataFrame:
    """Two-way counts and proportions of the row (or all) totals; absent cells count 0.

    Absent cells are filled where level lists are given.
    """
    data = df.where(F.col(row).isNotNull() & F.col(col).isNotNull())
    counts = data.groupBy(row, col).agg(F.count(F.lit(1)).alias("n"))
    if row_levels is not None and col_levels is not None:
        rows = list(row_levels.values if isinstance(row_levels, Levels) else row_levels)
        cols = list(col_levels.values if isinstance(col_levels, Levels) else col_levels)
        cells = df.sparkSession.createDataFrame([(r, c) for r in rows for c in cols], [row, col])
        counts = cells.join(counts, [row, col], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    if margin == "row":                           # the window runs over cells (levels x levels), not over rows
        total = F.sum("n").over(Window.partitionBy(row))
    else:
        total = F.lit(data.count())
    return counts.withColumn("prop", F.when(total > 0, F.col("n") / total))


def pivot_counts(df: DataFrame, row: str, col: str, col_levels: Levels | Sequence) -> DataFrame:
    """Contingency table with one column per level; the explicit list saves the extra pass pivot() makes."""
    values = list(col_levels.values if isinstance(col_levels, Levels) else col_levels)
    return df.groupBy(row).pivot(col, values).count().na.fill(0)


def level_share(df: DataFrame, col: str, by: Sequence[str] | str, levels: Levels | Sequence | None = None,
                out: str = "share") -> DataFrame:
    """Share of each level within its group, long: ``by..., col, share``."""
    by = _names(by)
    data = df.dropna("any", subset=[*by, col])
    if levels is None:
        counts = data.groupBy(*by, col).agg(F.count(F.lit(1)).alias("__n"))
        total = F.sum("__n").over(Window.partitionBy(*by))
        return counts.select(*by, col, (F.col("__n") / total).alias(out))
    values = list(levels.values if isinstance(levels, Levels) else levels)
    wide = data.groupBy(*by).agg(*[F.avg((F.col(col) == F.lit(v)).cast("double")).alias(f"__l{i}")
                                   for i, v in enumerate(values)])
    pairs = F.array(*[F.struct(F.lit(v).alias(col), F.col(f"__l{i}").alias(out)) for i, v in enumerate(values)])
    return wide.select(*by, F.inline(pairs))


def pretty_breaks(low: float, high: float, n: int) -> list[float]:
    """About ``n`` round intervals (steps of 1, 2 or 5 times a power of ten) covering the range."""
    if high <= low:
        return [low - 0.5, low + 0.5]
    cell = (high - low) / n
    base = 10.0 ** math.floor(math.log10(cell))
    unit = base
    # Candidate steps and the bias toward the larger one.
    for step, bias in ((2, 1.5), (5, 2.75), (10, 1.5)):
        if step * base - cell >= bias * (cell - unit):
            break
        unit = step * base
    first, last = math.floor(low / unit + 1e-7), math.ceil(high / unit - 1e-7)
    return [unit * i for i in range(first, last + 1)]


def histogram(df: DataFrame, col: str, breaks: Sequence[float] | str = "sturges", outside: str = "error") -> DataFrame:
    """Counts per right-closed interval (the first one closed on both sides).

    Values outside the breaks are an error; with ``outside="warn"`` they lie in no interval and a warning gives their number.
    """
    if outside not in ("error", "warn"):
        raise ValueError("outside must be 'error' or 'warn'")
    x = F.col(col).cast("double")
    if isinstance(breaks, str):
        if breaks != "sturges":
            raise ValueError("breaks must be a list or 'sturges'")
        n, low, high = df.agg(F.count(x), F.min(x), F.max(x)).first()
        if not n:
            raise ValueError(f"{col!r} has no values")
        breaks = pretty_breaks(low, high, math.ceil(math.log2(n) + 1))
    edges = [float(b) for b in breaks]
    data = df.where(x.isNotNull()).select(x.alias("x"))
    expr = F.when((F.col("x") < edges[0]) | (F.col("x") > edges[-1]) | F.isnan("x"), F.lit(-1))
    for i, edge in enumerate(edges[1:]):
        expr = expr.when(F.col("x") <= edge, F.lit(i))
    counts = durable(data.groupBy(expr.alias("bin")).agg(F.count(F.lit(1)).alias("count")))
    beyond = counts.where("bin = -1").first()
    if beyond:
        said = f"{beyond['count']} values of {col!r} lie outside the breaks"
        if outside == "error":
            raise ValueError(said)
        warnings.warn(said, stacklevel=2)
    bins = df.sparkSession.createDataFrame(
        [(i, a, b) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))],
        "bin int, lower double, upper double")
    return bins.join(counts, "bin", "left").select("bin", "lower", "upper", F.coalesce("count", F.lit(0)).alias("count"))


def marginalise(pred: DataFrame, over: str, keys: Sequence[str], value: str, weights: DataFrame | None = None,
                weight_keys: Sequence[str] | None = None, weight: str = "share", out: str | None = None) -> DataFrame:
    """Average a prediction over the levels of ``over``.

    Weighted by a table keyed on ``weight_keys`` + ``over`` (always matched by
    key, missing keys too), or unweighted when no weights are given. A group with a level that has no
    weight keeps its row, with a NULL mean.
    """
    out = out or value
    if weights is None:
        return pred.groupBy(*keys).agg(F.avg(value).alias(out))
    on = [*(weight_keys or []), over]
    joined = left_join(pred, weights.select(*on, F.col(weight).alias("__w")), on)
    part = F.col(value) * F.col("__w")
    return joined.groupBy(*keys).agg(F.when(F.count(part) == F.count(F.lit(1)), F.sum(part)).alias(out))
