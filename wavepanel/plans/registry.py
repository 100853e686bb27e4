"""Register a query under a name, with the SQL that must give the same table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession

from wavepanel.functions.columns import rounded


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}
#: The seed of all simulations in the queries; results with draws belong to it alone.
SEED = 11


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = Query(fn, sql)
        return fn
    return register


def round_all(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every floating column; ``special`` overrides the digits of one."""
    return df.select(*[rounded(df[c], special.get(c, digits)).alias(c) if t in ("double", "float") else df[c]
                       for c, t in df.dtypes])


def r(expr: str, digits: int = 6) -> str:
    """SQL twin of ``rounded``."""
    return f"(round(({expr})::DOUBLE, {digits}) + 0.0)"


__all__ = ["QUERIES", "SEED", "Column", "Query", "query", "r", "round_all"]
