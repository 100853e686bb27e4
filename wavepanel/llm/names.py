"""Column names that do not clash."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def carried(df: DataFrame, outputs: Iterable[str], but: Iterable[str] = ()) -> list[str]:
    """Columns of df that an operator passes on: an output replaces a column of its name (in any case)."""
    gone = {c.lower() for c in (*outputs, *but)}
    return [c for c in df.columns if c.lower() not in gone]


def unused(df: DataFrame, stem: str = "__w") -> str:
    """A prefix that no column of df begins with."""
    while any(c.lower().startswith(stem.lower()) for c in df.columns):
        stem += "_"
    return stem


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def ddl(df: DataFrame, columns: Iterable[str], outputs: dict[str, str]) -> str:
    """Schema text of some columns of df and the outputs."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return ", ".join([f"{quoted(c)} {kinds[c]}" for c in columns] + [f"{quoted(c)} {t}" for c, t in outputs.items()])
