"""Finished model results (a few numbers per coefficient or term) as DataFrames."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def _plain(v):
    if isinstance(v, np.generic):
        v = v.item()
    return None if isinstance(v, float) and math.isnan(v) else v


def result_table(spark: SparkSession, rows, schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(_plain(v) for v in r) for r in rows], schema)
