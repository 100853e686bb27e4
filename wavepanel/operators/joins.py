"""Null-safe joins, keyed binding, value grids and labelled unions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavepanel.functions.columns import all_of


def left_join(left: DataFrame, right: DataFrame, on: Sequence[str] | str, na_matches: bool = True) -> DataFrame:
    """Left equi-join on shared keys in which a missing key matches a missing key.

    Spark plans ``<=>`` as an equi-join; whether the right side is broadcast or
    shuffled is left to the statistics (and to AQE, which also splits a hot key).
    """
    on = [on] if isinstance(on, str) else list(on)
    kinds = {**dict(right.dtypes)}
    floats = [c for c in on if kinds[c] in ("double", "float")]
    if floats:
        raise ValueError(f"join on floating-point keys {floats}; carry a label instead")
    if not na_matches:
        return left.join(right, on, "left")
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in on else F.col(c) for c in right.columns])
    match = all_of([F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in on])
    return left.join(renamed, match, "left").drop(*[f"__r_{c}" for c in on])


def bind_by_key(left: DataFrame, right: DataFrame, keys: Sequence[str], check: bool = True) -> DataFrame:
    """Put two tables side by side by key; the keys must match one to one, and a missing key matches a missing key."""
    keys = list(keys)
    if check:
        one, none = F.lit(1), F.lit(0)
        sides = (left.select(*keys, one.alias("__l"), none.alias("__r"))
                 .unionByName(right.select(*keys, none.alias("__l"), one.alias("__r"))))
        bad = sides.groupBy(*keys).agg(F.sum("__l").alias("__l"), F.sum("__r").alias("__r")).where("__l <> 1 or __r <> 1")
        if not bad.isEmpty():
            raise ValueError(f"keys {keys} do not match one to one")
    renamed = right.withColumnsRenamed({c: f"__r_{c}" for c in keys})
    match = all_of([F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in keys])
    return left.join(renamed, match, "inner").drop(*[f"__r_{c}" for c in keys])


def expand_grid(spark: SparkSession, **lists: Sequence) -> DataFrame:
    """All combinations of the value lists, the first list varying fastest.

    Each row is decoded from its ``grid_id``, so the grid is generated in
    parallel without a join.
    """
    total = 1
    strides = {}
    for name, values in lists.items():
        strides[name] = total
        total *= len(values)
    cols = []
    for name, values in lists.items():
        position = (F.floor(F.col("id") / F.lit(strides[name])) % F.lit(len(values))).cast("int")
        cols.append(F.get(F.array(*[F.lit(v) for v in values]), position).alias(name))
    return spark.range(total).select(F.col("id").alias("grid_id"), *cols)


def number_sequence(low: float, high: float, n: int) -> list[float]:
    if n == 1:
        return [float(low)]
    return [low + (high - low) * i / (n - 1) for i in range(n)]


def union_labelled(tables: Mapping[str, DataFrame], label: str = "name") -> DataFrame:
    """Stack tables under a label column; columns missing in one are NULL there."""
    out = None
    for name, df in tables.items():
        one = df.withColumn(label, F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no tables to stack")
    return out
