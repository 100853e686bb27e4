"""Column expressions shared by the operators. All of them stay on the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def plogis(eta: Column) -> Column:
    """Inverse logit. exp() saturates to infinity, so both tails are exact 0 and 1."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))


def inverse_link(eta: Column, link: str) -> Column:
    if link == "logit":
        return plogis(eta)
    if link == "log":
        return F.exp(eta)
    if link == "inverse":
        return F.lit(1.0) / eta
    if link == "1/mu^2":
        return F.lit(1.0) / F.sqrt(eta)
    return eta


def paste(*cols: str | Column, sep: str = " ") -> Column:
    """Join labels into one string; a missing part is written as ``NA``."""
    parts = [F.coalesce(_col(c).cast("string"), F.lit("NA")) for c in cols]
    return F.concat_ws(sep, *parts)


def relabelled(col: str | Column, mapping: Mapping) -> Column:
    """Mapped value where the map has one, the value itself otherwise."""
    c = _col(col)
    if not mapping:
        return c
    expr = None
    for old, new in mapping.items():
        expr = F.when(c == F.lit(old), F.lit(new)) if expr is None else expr.when(c == F.lit(old), F.lit(new))
    return expr.otherwise(c)


def level_code(col: str | Column, levels: Sequence) -> Column:
    """0-based position in the level list; NULL for missing or unlisted values."""
    return F.nullif(F.array_position(F.array(*[F.lit(v) for v in levels]), _col(col)), F.lit(0)) - F.lit(1)


def wave_index(col: str | Column) -> Column:
    """Trailing number of a wave column name: ``alt3`` -> 3."""
    return F.regexp_extract(_col(col), r"(\d+)$", 1).cast("int")


def keyed_uniform(keys: Sequence[str | Column], seed: int, stream: int = 0) -> Column:
    """Uniform in (0, 1) that depends on the row's key only, not on partitioning."""
    h = F.xxhash64(*[_col(k) for k in keys], F.lit(int(seed)), F.lit(int(stream)))
    return F.shiftrightunsigned(h, 11).cast("double") * F.lit(2.0**-53) + F.lit(2.0**-54)


def rounded(c: Column, digits: int = 6) -> Column:
    """Round and fold -0.0 into 0.0."""
    return F.round(c, digits) + F.lit(0.0)


def all_of(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c
