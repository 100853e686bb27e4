"""Study tables derived from the driver tables.

A customer plays the subject and a year the wave: mean order price is its
height, total price the cutting time, urgent orders the fruits, and any order
in the year its survival. Line items play the large long table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WAVE_YEARS = {k: 1995 + k for k in range(7)}        # every year in which the table has orders
TREATMENTS = {"AUTOMOBILE": "a", "BUILDING": "b", "FURNITURE": "c", "HOUSEHOLD": "a", "MACHINERY": "b"}
URGENT = ("1-URGENT", "2-HIGH")

LAST_WAVE = max(WAVE_YEARS)
ALT = [f"alt{k}" for k in WAVE_YEARS]
SUP = [f"sup{k}" for k in WAVE_YEARS if k > 0]
FRUTOS = [f"frutos{k}" for k in WAVE_YEARS]
TIME = [f"t{k}" for k in WAVE_YEARS]
IDS = ["id", "sp", "trat", "dom"]


def order_year():
    """Year of an order; an order outside the waves is an error, not a row that vanishes."""
    year = F.year("o_orderdate")
    outside = F.raise_error(F.concat(F.lit("an order of "), year.cast("string"), F.lit(" lies outside the waves"))).cast("int")
    return F.when(year.isNull() | year.isin(*WAVE_YEARS.values()), year).otherwise(outside)


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer: id, species, treatment, dominance and stump height."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    trat = None
    for segment, code in TREATMENTS.items():
        trat = F.when(F.col("c_mktsegment") == segment, code) if trat is None else trat.when(F.col("c_mktsegment") == segment, code)
    return customer.select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_nationkey") < 12, "ang").otherwise("ata").alias("sp"), trat.alias("trat"),
        F.when(F.col("c_acctbal") >= 4500, "dom").otherwise("sub").alias("dom"),
        (F.col("c_acctbal") / 100).alias("tocon0"))


def wide_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer. Orders are combined map-side before the shuffle on the customer."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    orders = orders.select("o_custkey", order_year().alias("year"), "o_totalprice", "o_orderpriority")
    year, price = F.col("year"), F.col("o_totalprice")
    aggs = []
    for k, y in WAVE_YEARS.items():
        now = year == y
        seen = F.count(F.when(now, 1))
        aggs += [
            (F.avg(F.when(now, price)) / 1000).alias(f"alt{k}"),
            F.when(seen > 0, F.count(F.when(now & F.col("o_orderpriority").isin(*URGENT), 1))).cast("int").alias(f"frutos{k}"),
            (F.sum(F.when(now, price)) / 10000).alias(f"t{k}"),
        ]
        if k > 0:
            aggs.append(F.max(F.when(now, 1).otherwise(0)).alias(f"sup{k}"))
    waves = orders.groupBy("o_custkey").agg(*aggs)
    people = subjects(spark, sf_dir)
    joined = people.join(waves, people["id"] == waves["o_custkey"], "left")
    return joined.select(*IDS, "tocon0", *ALT, *SUP, *FRUTOS, *TIME)


def long_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer and wave with orders: ids, wave, alt, t and frutos, without forming the wide table first."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    price = F.col("o_totalprice")
    waves = orders.groupBy("o_custkey", (order_year() - WAVE_YEARS[0]).alias("wave")).agg(
        (F.avg(price) / 1000).alias("alt"), (F.sum(price) / 10000).alias("t"),
        F.count(F.when(F.col("o_orderpriority").isin(*URGENT), 1)).alias("frutos"))
    return waves.where("wave is not null").join(subjects(spark, sf_dir), F.col("o_custkey") == F.col("id")).drop("o_custkey")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the roles used by the large models."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "*", (F.col("l_discount") > 0.05).cast("int").alias("big"),
        F.year("l_shipdate").cast("string").alias("yr"),
        F.greatest(F.col("l_quantity") - 25, F.lit(0.0)).alias("excess"),
        F.round(F.col("l_tax") * 100).alias("tax"))


def _panel_sql() -> str:
    cols = []
    for k, y in WAVE_YEARS.items():
        cols += [f"avg(CASE WHEN year(o_orderdate) = {y} THEN o_totalprice END) / 1000 AS alt{k}",
                 f"CASE WHEN count(CASE WHEN year(o_orderdate) = {y} THEN 1 END) > 0 THEN count(CASE WHEN "
                 f"year(o_orderdate) = {y} AND o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 END) END::INTEGER AS frutos{k}",
                 f"sum(CASE WHEN year(o_orderdate) = {y} THEN o_totalprice END) / 10000 AS t{k}"]
        if k > 0:
            cols.append(f"max(CASE WHEN year(o_orderdate) = {y} THEN 1 ELSE 0 END)::INTEGER AS sup{k}")
    cases = " ".join(f"WHEN '{s}' THEN '{c}'" for s, c in TREATMENTS.items())
    picked = ", ".join([*ALT, *SUP, *FRUTOS, *TIME])
    return (f"waves AS (SELECT o_custkey, {', '.join(cols)} FROM orders GROUP BY o_custkey), "
            f"panel AS (SELECT c_custkey AS id, CASE WHEN c_nationkey < 12 THEN 'ang' ELSE 'ata' END AS sp, "
            f"CASE c_mktsegment {cases} END AS trat, CASE WHEN c_acctbal >= 4500 THEN 'dom' ELSE 'sub' END AS dom, "
            f"c_acctbal / 100 AS tocon0, {picked} FROM customer LEFT JOIN waves ON c_custkey = o_custkey)")


PANEL_SQL = _panel_sql()
LINES_SQL = ("lines AS (SELECT *, (l_discount > 0.05)::INTEGER AS big, year(l_shipdate)::VARCHAR AS yr, "
             "greatest(l_quantity - 25, 0.0)::DOUBLE AS excess, round(l_tax * 100) AS tax FROM lineitem)")


def long_sql(cols, name: str, value: str, ids=("id", "sp", "trat", "dom", "alt0")) -> str:
    """UNION ALL unpivot of panel columns, missing cells kept."""
    parts = [f"SELECT {', '.join(ids)}, '{c}' AS {name}, {c.lstrip('abcdefghijklmnopqrstuvwxyz')}::INTEGER AS wave, {c} AS {value} FROM panel" for c in cols]
    return " UNION ALL ".join(parts)
