"""Column choice, relabelling, level lists, binning and scaling."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavepanel.functions.columns import level_code, relabelled


@dataclass(frozen=True)
class Levels:
    """Ordered levels of a categorical column; the first one is the reference."""

    column: str
    values: tuple

    def code(self) -> Column:
        return level_code(self.column, self.values)


def cols_matching(df: DataFrame, pattern: str) -> list[str]:
    return [c for c in df.columns if re.search(pattern, c)]


def cols_any_of(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Those of ``names`` that exist, in table order."""
    wanted = set(names)
    return [c for c in df.columns if c in wanted]


def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(how="any", subset=list(cols))


# Level values keep the type of their column.
_READERS = {**dict.fromkeys(("int", "bigint", "smallint", "tinyint"), int), "double": float, "float": float,
            "boolean": lambda s: s == "true", "date": date.fromisoformat, "decimal": Decimal}


def relabel(df: DataFrame, col: str, mapping: Mapping, out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, relabelled(col, mapping))


def with_levels(df: DataFrame, col: str, levels: Sequence, labels: Sequence | None = None,
                out: str | None = None) -> tuple[DataFrame, Levels]:
    """Declare the levels of a column; values outside the list become NULL.

    ``labels`` renames the levels position by position.
    """
    names = list(labels) if labels is not None else list(levels)
    if len(names) != len(levels):
        raise ValueError("labels and levels differ in length")
    pairs = dict(zip(levels, names, strict=True))
    expr = F.when(F.col(col).isin(list(levels)), relabelled(col, pairs))
    return df.withColumn(out or col, expr), Levels(out or col, tuple(names))


def distinct_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct non-missing values of each column as a table ``column, level`` (text), however many there are."""
    pair = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in cols])
    return (df.select(*cols).groupBy(*cols).agg(F.count(F.lit(1)).alias("__n")).select(F.explode(pair).alias("__p"))
            .select("__p.*").where("level is not null").distinct())


def find_levels(df: DataFrame, cols: Sequence[str], order_by: str | None = None,
                limit: int = 1000) -> dict[str, Levels]:
    """Distinct non-missing values of each column, in one job.

    Sorted by value, or by first appearance along ``order_by``. The result is
    metadata for the driver, so a column with more than ``limit`` values is an
    error rather than a long list: it is not a category.
    """
    cols = list(cols)
    if not cols:
        return {}
    # Distinct combinations first (combined map-side), then one row per column of each combination.
    combos = df.select(*cols, *([F.col(order_by).alias("__o")] if order_by else [])).groupBy(*cols).agg(
        (F.min("__o") if order_by else F.lit(0)).alias("__first"))
    pair = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])
    values = (combos.select("__first", F.explode(pair).alias("__p")).where("__p.value is not null")
              .groupBy("__p.column", "__p.value").agg(F.min("__first").alias("first")))
    rows = values.limit(limit * len(cols) + 1).collect()
    out = {}
    kinds = dict(df.dtypes)
    for c in cols:
        mine = [r for r in rows if r["column"] == c]
        if len(mine) > limit or len(rows) > limit * len(cols):
            raise ValueError(f"{c!r} has more than {limit} levels")
        cast = _READERS.get(kinds[c].split("(")[0], str)
        pairs = [(r["first"], cast(r["value"])) for r in mine]
        out[c] = Levels(c, tuple(v for _, v in sorted(pairs)))
    return out


def drop_levels(df: DataFrame, levels: Levels) -> Levels:
    """Keep the levels that still occur, in their declared order."""
    seen = set(find_levels(df, [levels.column])[levels.column].values)
    return Levels(levels.column, tuple(v for v in levels.values if v in seen))


def indicator(df: DataFrame, predicate: Column, name: str) -> DataFrame:
    """0/1 column; a missing predicate stays missing."""
    return df.withColumn(name, predicate.cast("int"))


def row_sum(df: DataFrame, cols: Sequence[str], out: str) -> DataFrame:
    """Sum across columns that treats missing as zero."""
    total = F.lit(0.0)
    for c in cols:
        total = total + F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return df.withColumn(out, total)


def cut_breaks(low: float, high: float, k: int) -> list[float]:
    """k+1 equally spaced breaks; only the outer two are widened, by 0.1% of the range."""
    step = (high - low) / k
    breaks = [low + i * step for i in range(k + 1)]
    if high == low:
        width = abs(low) or 1.0
        return [low - width / 1000 + i * (2 * width / 1000) / k for i in range(k + 1)]
    breaks[0] = low - (high - low) / 1000
    breaks[k] = high + (high - low) / 1000
    return breaks


def interval_labels(breaks: Sequence[float], digits: int = 3) -> list[str]:
    """``(a,b]`` labels with the fewest significant digits (from ``digits``) that tell breaks apart."""
    for d in range(digits, 17):
        text = [f"{b:.{d}g}" for b in breaks]
        text = [f"{float(t):.15g}" if "e" in t else t for t in text]
        if len(set(text)) == len(text):
            break
    return [f"({a},{b}]" for a, b in zip(text[:-1], text[1:], strict=True)]


def bin_by_breaks(col: str, breaks: Sequence[float], labels: Sequence) -> Column:
    """Right-closed binning as one CASE over the k upper edges."""
    c = F.col(col)
    expr = F.when(c.isNull() | (c <= F.lit(float(breaks[0]))), F.lit(None))
    for edge, label in zip(breaks[1:], labels, strict=True):
        expr = expr.when(c <= F.lit(float(edge)), F.lit(label))
    return expr


def cut_equal(df: DataFrame, col: str, k: int, labels: Sequence[str] | None = None,
              out: str | None = None) -> tuple[DataFrame, Levels]:
    """Equal-width right-closed bins. One min/max job fixes the breaks, then it is a projection."""
    low, high = df.agg(F.min(col).cast("double"), F.max(col).cast("double")).first()
    if low is None:
        raise ValueError(f"{col!r} has no values to bin")
    breaks = cut_breaks(low, high, k)
    names = list(labels) if labels is not None else interval_labels(breaks)
    out = out or f"{col}_cat"
    return df.withColumn(out, bin_by_breaks(col, breaks, names)), Levels(out, tuple(names))


@dataclass(frozen=True)
class Scaler:
    """Training means and sample standard deviations, applied unchanged to any table."""

    stats: dict

    def expr(self, col: str) -> Column:
        mean, sd = self.stats[col]
        return (F.col(col) - F.lit(mean)) / F.lit(sd)


def zscore_fit(df: DataFrame, cols: Sequence[str]) -> Scaler:
    row = df.agg(*[f(c).cast("double") for c in cols for f in (F.avg, F.stddev_samp)]).first()
    stats = {c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(cols)}
    flat = [c for c, (_, sd) in stats.items() if sd is None or sd == 0 or math.isnan(sd)]
    if flat:
        raise ValueError(f"columns without spread: {flat}")
    return Scaler(stats)


def zscore_apply(df: DataFrame, scaler: Scaler, suffix: str = "_z") -> DataFrame:
    return df.withColumns({c + suffix: scaler.expr(c) for c in scaler.stats})
