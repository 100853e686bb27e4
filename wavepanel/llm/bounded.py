"""Bounded parts of large tables, chosen without sorting them in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SCALE = 1 << 30


def hash_share(key: Column, share: float | Column) -> Column:
    """True for about that share of the keys, always the same ones."""
    return F.pmod(F.xxhash64(key), F.lit(_SCALE)) < share * _SCALE


def most_frequent(counts: DataFrame, key: str, n: str, size: int) -> DataFrame:
    """About size rows with the largest n, all of them if there are no more.

    A histogram of log n (a few hundred bins) finds the bin where the rows above reach size; of that bin a hashed share stays.
    """
    level = F.floor(F.log2(F.col(n).cast("double") + 1) * 16).cast("int")
    bins = sorted(((r["level"], r["k"]) for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)
    room = size
    for at, k in bins:
        if k > room:
            return counts.where((level > at) | ((level == at) & hash_share(F.col(key), room / k)))
        room -= k
    return counts
