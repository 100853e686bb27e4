"""Wide to long."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavepanel.functions.columns import wave_index


def to_long(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str, value: str,
            index: str | None = None, base: str | None = None, base_as: str | None = None) -> DataFrame:
    """Unpivot ``cols``; missing cells are kept. No shuffle.

    Rows are exploded from an array and not by ``unpivot``, whose plan Spark does
    not find again in a join of a persisted table with its own aggregate, so that
    the table would be computed a second time.

    ``index`` adds the wave number taken from the column name. ``base`` keeps a
    column that is itself unpivoted (the baseline) next to every wave, in place
    of joining it back by subject.
    """
    ids = list(ids)
    cells = F.inline(F.array(*[F.struct(F.lit(c).alias(name), F.col(c).alias(value)) for c in cols]))
    if base is not None:
        keep = base_as or base
        hidden = "__base"
        long = df.select(*ids, F.col(base).alias(hidden), cells)
        long = long.withColumnRenamed(hidden, keep)
    else:
        long = df.select(*ids, cells)
    if index is not None:
        long = long.withColumn(index, wave_index(name))
    return long


def to_long_multi(df: DataFrame, ids: Sequence[str], measures: Mapping[str, Sequence[str]],
                  index: str) -> DataFrame:
    """Unpivot several measures together: one row per wave with one column per measure.

    The waves are paired by the number in the column name; a measure without
    that wave is NULL.
    """
    def number(c: str) -> int:
        digits = len(c) - len(c.rstrip("0123456789"))
        if digits == 0:
            raise ValueError(f"no wave number in {c!r}")
        return int(c[-digits:])

    by_wave = {m: {number(c): c for c in cols} for m, cols in measures.items()}
    kinds = {m: df.schema[next(iter(cols))].dataType for m, cols in measures.items()}
    waves = sorted({w for cols in by_wave.values() for w in cols})
    rows = [F.struct(F.lit(w).alias(index),
                     *[(F.col(by_wave[m][w]) if w in by_wave[m] else F.lit(None)).cast(kinds[m]).alias(m)
                       for m in measures])
            for w in waves]
    return df.select(*ids, F.inline(F.array(*rows)))
