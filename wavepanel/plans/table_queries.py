"""Scans, projections, reshaping, joins and aggregations on the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wavepanel.functions.columns import paste, plogis, wave_index
from wavepanel.functions.numeric import normal_quantile
from wavepanel.functions.storage import durable, shared_folder
from wavepanel.operators import clean, joins, reshape, summaries
from wavepanel.plans.panels import (ALT, FRUTOS, IDS, LAST_WAVE, LINES_SQL, PANEL_SQL, SUP, TIME, lines, long_panel, long_sql, subjects,
                                    wide_panel)
from wavepanel.plans.registry import query, r, round_all
from wavepanel.sources.tables import preview, quarantine, read_bundle, read_checked, read_panel, write_bundle

W = f"WITH {PANEL_SQL}"
L = f"WITH {LINES_SQL}"


# ---------------------------------------------------------------- scans

@query("scan_panel", f"SELECT c_custkey, c_mktsegment, {r('c_acctbal')} AS c_acctbal FROM customer")
def scan_panel(spark, sf):
    df = read_panel(spark, f"{sf}/customer.parquet", "c_custkey long, c_mktsegment string, c_acctbal double", "parquet")
    return round_all(df)


_BROKEN = """l AS (SELECT o_orderkey, o_custkey, o_totalprice, CASE WHEN o_orderkey % 50 = 0 THEN 'malformed' WHEN o_orderkey % 50 = 1 THEN 'malformed'
  WHEN o_orderkey % 50 = 2 THEN 'missing o_custkey' WHEN o_orderkey % 50 = 3 THEN 'missing o_orderkey' END AS reason FROM orders)"""


def _broken_orders(spark, sf):
    """Orders as CSV lines, some with a word for a number, some with a value too few, some without a key."""
    k = F.col("o_orderkey") % 50
    price = F.format_string("%.2f", "o_totalprice")
    line = (F.when(k == 0, F.concat_ws(",", "o_orderkey", F.lit("x"), price)).when(k == 1, F.concat_ws(",", "o_orderkey", "o_custkey"))
            .when(k == 2, F.concat_ws(",", "o_orderkey", F.lit("NA"), price)).when(k == 3, F.concat_ws(",", F.lit("NA"), "o_custkey", price))
            .otherwise(F.concat_ws(",", "o_orderkey", "o_custkey", price)))
    path = f"{shared_folder(spark)}/wavepanel-csv-{uuid.uuid4().hex}"
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(line.alias("value"))
    head = F.concat(F.lit("o_orderkey,o_custkey,o_totalprice\n"), F.array_join(F.collect_list("value"), "\n")).alias("value")
    # a file of its own with a header for each part of the table
    parts = orders.withColumn("part", F.pmod(F.xxhash64("value"), F.lit(64))).groupBy("part").agg(head)
    parts.write.partitionBy("part").text(path)
    return path


@query("csv_quarantine", f"""WITH {_BROKEN} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n, {r('coalesce(sum(CASE WHEN reason IS NULL THEN round(o_totalprice, 2) END), 0)', 2)} AS price
FROM l GROUP BY ALL""")
def csv_quarantine(spark, sf):
    path = _broken_orders(spark, sf)
    good, rejected = read_checked(spark, f"{path}/*", "o_orderkey long, o_custkey long, o_totalprice double", ["o_custkey", "o_orderkey"])
    counts = quarantine(rejected, f"{path}-quarantine").withColumn("price", F.lit(0.0))
    kept = good.agg(F.lit("kept").alias("reason"), F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("price"))
    return round_all(kept.unionByName(counts), 2)


def _preview_sql(cols):
    one = ("SELECT '{0}' AS \"column\", count({0}) AS n, count(*) - count({0}) AS n_missing, "
           "{1} AS \"min\", {2} AS mean, {3} AS \"max\" FROM panel")
    return f"{W} " + " UNION ALL ".join(one.format(c, r(f"min({c})"), r(f"avg({c})"), r(f"max({c})")) for c in cols)


@query("preview", _preview_sql([*ALT, *SUP, *FRUTOS, *TIME, "tocon0"]))
def preview_query(spark, sf):
    df = wide_panel(spark, sf).select(*ALT, *SUP, *FRUTOS, *TIME, "tocon0")
    return round_all(preview(df).drop("position", "type"))


# ---------------------------------------------------------------- projections

# Means of a few cent amounts fall exactly between two 6-digit values, so single heights keep 9 digits.
@query("cols_select", f"{W} SELECT id, {', '.join(f'{r(c, 9)} AS {c}' for c in ALT)}, sup1, sup5 FROM panel")
def cols_select(spark, sf):
    df = wide_panel(spark, sf)
    heights = clean.cols_matching(df, "^alt")
    known = clean.cols_any_of(df, ["sup1", "sup5", "sup9"])
    return round_all(df.select("id", *heights, *known), 9)


@query("relabel_levels", """
WITH t AS (SELECT CASE l_returnflag WHEN 'A' THEN 'annual' WHEN 'R' THEN 'fourth year' ELSE l_returnflag END AS trat,
  CASE l_linestatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'final' END AS dom FROM lineitem)
SELECT trat, dom, CASE dom WHEN 'open' THEN 0 WHEN 'final' THEN 1 END::BIGINT AS dom_code, 2::INTEGER AS trat_levels,
  CASE trat WHEN 'fourth year' THEN 0 WHEN 'annual' THEN 1 END::BIGINT AS trat_code, count(*) AS n
FROM t WHERE trat <> 'N' GROUP BY ALL""")
def relabel_levels(spark, sf):
    df = lines(spark, sf)
    df = clean.relabel(df, "l_returnflag", {"A": "annual", "R": "fourth year"}, out="trat")
    df, _ = clean.with_levels(df, "trat", ["fourth year", "N", "annual"])
    df, dom = clean.with_levels(df, "l_linestatus", ["O", "F"], ["open", "final"], out="dom")
    kept = df.where(F.col("trat") != "N")
    trat = clean.drop_levels(kept, clean.Levels("trat", ("fourth year", "N", "annual")))
    return kept.groupBy("trat", "dom").agg(F.count(F.lit(1)).alias("n")).select(
        "*", dom.code().alias("dom_code"), trat.code().alias("trat_code"),
        F.lit(len(trat.values)).alias("trat_levels"))


@query("first_appearance_levels", """
WITH f AS (SELECT o_orderpriority AS level, min(o_orderkey) AS k FROM orders GROUP BY 1)
SELECT level, (row_number() OVER (ORDER BY k) - 1)::INTEGER AS code FROM f""")
def first_appearance_levels(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderpriority")
    levels = clean.find_levels(orders, ["o_orderpriority"], order_by="o_orderkey")["o_orderpriority"]
    return spark.createDataFrame([(v, i) for i, v in enumerate(levels.values)], "level string, code int")


@query("distinct_levels", """
SELECT 'l_returnflag' AS "column", l_returnflag AS level FROM lineitem GROUP BY ALL
UNION ALL SELECT 'l_linestatus', l_linestatus FROM lineitem GROUP BY ALL
UNION ALL SELECT 'l_linenumber', l_linenumber::VARCHAR FROM lineitem GROUP BY ALL""")
def distinct_levels(spark, sf):
    return clean.distinct_values(lines(spark, sf), ["l_returnflag", "l_linestatus", "l_linenumber"])


@query("complete_cases", f"""{W} SELECT id, trat, {r('alt1', 9)} AS alt1, {r('alt2', 9)} AS alt2, frutos1 FROM panel
WHERE trat <> 'c' AND alt1 IS NOT NULL AND alt2 IS NOT NULL AND frutos1 IS NOT NULL""")
def complete_cases(spark, sf):
    df = wide_panel(spark, sf).where(F.col("trat") != "c").where(F.col("alt1").isNotNull())
    return round_all(clean.complete_cases(df.select("id", "trat", "alt1", "alt2", "frutos1"), ["alt2", "frutos1"]), 9)


@query("cast_wave", f"""{W}, l AS ({long_sql(SUP, 'name', 'survival')})
SELECT wave, wave::DOUBLE AS year, count(*) AS n, count(survival) AS n_seen FROM l GROUP BY ALL""")
def cast_wave(spark, sf):
    long = reshape.to_long(wide_panel(spark, sf), ["id"], SUP, "name", "survival")
    long = long.withColumn("wave", wave_index("name")).withColumn("year", F.regexp_replace("name", "sup", "").cast("double"))
    return long.groupBy("wave", "year").agg(F.count(F.lit(1)).alias("n"), F.count("survival").alias("n_seen"))


@query("derive_flags", f"""{W} SELECT id, {r('alt1 - tocon0', 9)} AS growth1, (frutos1 > 0)::INTEGER AS frutos_bin,
  CASE WHEN t1 IS NULL THEN 1e-5 ELSE {r('t1', 9)} END::DOUBLE AS time1, 'observed' AS label,
  coalesce(trat, 'NA') || ' ' || coalesce(frutos1::VARCHAR, 'NA') || ' ' || dom AS cell, (dom = 'dom')::INTEGER AS dominant
FROM panel""")
def derive_flags(spark, sf):
    df = wide_panel(spark, sf).withColumn("growth1", F.col("alt1") - F.col("tocon0"))
    df = clean.indicator(df, F.col("frutos1") > 0, "frutos_bin")
    df = clean.indicator(df, F.col("dom") == "dom", "dominant")
    return round_all(df.select(
        "id", "growth1", "frutos_bin", F.when(F.col("t1").isNull(), F.lit(1e-5)).otherwise(F.col("t1")).alias("time1"),
        F.lit("observed").alias("label"), paste("trat", "frutos1", "dom").alias("cell"), "dominant"), 9)


@query("cut_equal", f"""{W}, b AS (SELECT min(alt0) AS lo, (max(alt0) - min(alt0)) / 3 AS w FROM panel)
SELECT CASE WHEN alt0 <= lo + w THEN 'low' WHEN alt0 <= lo + 2 * w THEN 'mid' WHEN alt0 IS NOT NULL THEN 'high' END AS alt_cat,
  count(*) AS n, {r('min(alt0)')} AS smallest, {r('max(alt0)')} AS largest FROM panel, b GROUP BY 1""")
def cut_equal(spark, sf):
    df, levels = clean.cut_equal(wide_panel(spark, sf), "alt0", 3, ["low", "mid", "high"], out="alt_cat")
    return round_all(df.groupBy(levels.column).agg(F.count(F.lit(1)).alias("n"), F.min("alt0").alias("smallest"),
                                                   F.max("alt0").alias("largest")))


@query("zscore", f"""{W}, s AS (SELECT avg(alt0) AS m0, stddev_samp(alt0) AS s0, avg(tocon0) AS m1, stddev_samp(tocon0) AS s1 FROM panel)
SELECT id, {r('(alt0 - m0) / s0')} AS alt0_z, {r('(tocon0 - m1) / s1')} AS tocon0_z FROM panel, s""")
def zscore(spark, sf):
    df = wide_panel(spark, sf).select("id", "alt0", "tocon0")
    scaler = clean.zscore_fit(df, ["alt0", "tocon0"])
    return round_all(clean.zscore_apply(df, scaler).select("id", "alt0_z", "tocon0_z"))


@query("polynomial", f"SELECT l_orderkey, l_linenumber, l_quantity, {r('l_quantity * l_quantity')} AS q2, "
                     f"{r('l_quantity * l_quantity * l_quantity')} AS q3 FROM lineitem")
def polynomial(spark, sf):
    from wavepanel.operators.terms import design, poly
    df, _ = design(lines(spark, sf), [(poly("l_quantity", 2),), (poly("l_quantity", 3),)], intercept=False,
                   keep=["l_orderkey", "l_linenumber", "l_quantity"])
    return round_all(df.select("l_orderkey", "l_linenumber", "l_quantity", F.col("m0").alias("q2"), F.col("m1").alias("q3")))


@query("row_sum", f"""{W} SELECT id, ({' + '.join(f'coalesce({c},0)' for c in FRUTOS[1:])})::DOUBLE AS frut_sum,
{r(' + '.join(f'coalesce({c},0)' for c in TIME[1:]))} AS t_resprout FROM panel""")
def row_sum(spark, sf):
    df = clean.row_sum(wide_panel(spark, sf), FRUTOS[1:], "frut_sum")
    return round_all(clean.row_sum(df, TIME[1:], "t_resprout").select("id", "frut_sum", "t_resprout"))


@query("scalar_functions", f"""SELECT l_quantity, {r('1 / (1 + exp(-(l_quantity - 25) / 10))')} AS p,
  {r('exp(l_quantity / 25)')} AS e, {r('pow(l_quantity, 1.5)')} AS pw, {r('1 / l_quantity')} AS inv,
  {r(f'l_quantity - {normal_quantile(0.975)!r} * 2')} AS lower, count(*) AS n FROM lineitem GROUP BY l_quantity""")
def scalar_functions(spark, sf):
    q = F.col("l_quantity")
    z = normal_quantile(0.975)
    return round_all(lines(spark, sf).groupBy("l_quantity").agg(F.count(F.lit(1)).alias("n")).select(
        "l_quantity", plogis((q - 25) / 10).alias("p"), F.exp(q / 25).alias("e"), F.pow(q, F.lit(1.5)).alias("pw"),
        (F.lit(1.0) / q).alias("inv"), (q - F.lit(z) * 2).alias("lower"), "n"))


# ---------------------------------------------------------------- reshape

@query("to_long", f"""{W}, l AS ({long_sql(ALT, 'year_alt', 'alt')})
SELECT id, trat, year_alt, wave AS year, {r('alt0', 9)} AS alt0, {r('alt', 9)} AS alt FROM l""")
def to_long(spark, sf):
    long = reshape.to_long(wide_panel(spark, sf), ["id", "trat"], ALT, "year_alt", "alt", index="year", base="alt0")
    return round_all(long.select("id", "trat", "year_alt", "year", "alt0", "alt"), 9)


@query("to_long_multi", f"{W} " + " UNION ALL ".join(
    f"SELECT id, {k}::INTEGER AS year, {r(f't{k}', 9)} AS time, {r(f'alt{k}', 9)} AS alt, "
    f"{f'sup{k}' if k else 'NULL::INTEGER'} AS sup FROM panel" for k in range(LAST_WAVE + 1)))
def to_long_multi(spark, sf):
    return round_all(reshape.to_long_multi(wide_panel(spark, sf), ["id"], {"time": TIME, "alt": ALT, "sup": SUP}, "year"), 9)


# ---------------------------------------------------------------- joins

@query("left_join_nullsafe", f"""{W}, m AS (SELECT frutos1, avg(alt1) AS mean_alt FROM panel GROUP BY frutos1)
SELECT p.id, p.frutos1, {r('m.mean_alt')} AS mean_alt FROM panel p LEFT JOIN m ON p.frutos1 IS NOT DISTINCT FROM m.frutos1""")
def left_join_nullsafe(spark, sf):
    df = wide_panel(spark, sf)
    means = df.groupBy("frutos1").agg(F.avg("alt1").alias("mean_alt"))
    return round_all(joins.left_join(df.select("id", "frutos1"), means, "frutos1"))


@query("left_join_composite", f"""{W}, s AS (SELECT trat, dom, avg(t1) AS mean_t FROM panel GROUP BY ALL)
SELECT p.id, p.trat, p.dom, {r('mean_t')} AS mean_t FROM panel p LEFT JOIN s ON p.trat IS NOT DISTINCT FROM s.trat AND p.dom IS NOT DISTINCT FROM s.dom""")
def left_join_composite(spark, sf):
    df = wide_panel(spark, sf)
    means = summaries.group_mean(df, ["trat", "dom"], ["t1"]).withColumnRenamed("t1", "mean_t")
    return round_all(joins.left_join(df.select("id", "trat", "dom"), means, ["trat", "dom"]))


@query("expand_grid", f"""WITH rng AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem),
s AS (SELECT lo + (hi - lo) * i / 119.0 AS alt0 FROM rng, range(120) t(i)),
f AS (SELECT DISTINCT l_returnflag FROM lineitem), g AS (SELECT DISTINCT l_linestatus FROM lineitem),
y AS (SELECT DISTINCT year(l_shipdate)::VARCHAR AS yr FROM lineitem)
SELECT {r('alt0')} AS alt0, yr, l_returnflag, l_linestatus FROM s, f, g, y""")
def expand_grid(spark, sf):
    df = lines(spark, sf)
    low, high = df.agg(F.min("l_quantity"), F.max("l_quantity")).first()
    lv = clean.find_levels(df, ["yr", "l_returnflag", "l_linestatus"])
    grid = joins.expand_grid(spark, alt0=joins.number_sequence(low, high, 120), yr=lv["yr"].values,
                             l_returnflag=lv["l_returnflag"].values, l_linestatus=lv["l_linestatus"].values)
    return round_all(grid.drop("grid_id"))


@query("bind_by_key", f"""SELECT l_returnflag, l_linestatus, {r('avg(l_quantity)')} AS mean, count(*) AS n FROM lineitem GROUP BY ALL""")
def bind_by_key(spark, sf):
    df = lines(spark, sf)
    keys = ["l_returnflag", "l_linestatus"]
    means = df.groupBy(*keys).agg(F.avg("l_quantity").alias("mean"))
    return round_all(joins.bind_by_key(means, summaries.group_count(df, keys), keys))


@query("union_labelled", f"""SELECT 'by flag' AS name, l_returnflag, NULL AS l_linestatus, {r('avg(l_quantity)')} AS mean FROM lineitem GROUP BY ALL
UNION ALL SELECT 'by status', NULL, l_linestatus, {r('avg(l_quantity)')} FROM lineitem GROUP BY ALL""")
def union_labelled(spark, sf):
    df = lines(spark, sf)
    mean = F.avg("l_quantity").alias("mean")
    return round_all(joins.union_labelled({"by flag": df.groupBy("l_returnflag").agg(mean),
                                           "by status": df.groupBy("l_linestatus").agg(mean)}))


# ---------------------------------------------------------------- aggregations

@query("global_mean", f"{W} SELECT {r('avg(alt0)')} AS alt0, {r('avg(t0)')} AS t0 FROM panel")
def global_mean(spark, sf):
    return round_all(summaries.group_mean(wide_panel(spark, sf), None, ["alt0", "t0"]))


@query("group_mean_skip", f"{W} SELECT trat, dom, {r('avg(alt0)')} AS alt0, {r('avg(t1)')} AS t1 FROM panel GROUP BY trat, dom")
def group_mean_skip(spark, sf):
    return round_all(summaries.group_mean(wide_panel(spark, sf), ["trat", "dom"], ["alt0", "t1"]))


@query("group_mean_propagate", f"""{W} SELECT trat, CASE WHEN count(alt0) = count(*) THEN {r('avg(alt0)')} END AS alt0,
  CASE WHEN count(tocon0) = count(*) THEN {r('avg(tocon0)')} END AS tocon0 FROM panel GROUP BY trat""")
def group_mean_propagate(spark, sf):
    return round_all(summaries.group_mean(wide_panel(spark, sf), "trat", ["alt0", "tocon0"], na="propagate"))


@query("group_mean_casewise", f"""{W} SELECT trat, frutos1, {r('avg(sup3)')} AS sup3, {r('avg(alt0)')} AS alt0 FROM panel
WHERE trat IS NOT NULL AND frutos1 IS NOT NULL AND sup3 IS NOT NULL AND alt0 IS NOT NULL GROUP BY ALL""")
def group_mean_casewise(spark, sf):
    return round_all(summaries.group_mean(wide_panel(spark, sf), ["trat", "frutos1"], ["sup3", "alt0"], casewise=True))


@query("group_stderr", f"""{W} SELECT trat, {', '.join(f"{r(f'stddev_samp({c})/sqrt(count({c}))')} AS {c}_se" for c in [*ALT, *TIME])} FROM panel GROUP BY trat""")
def group_stderr(spark, sf):
    return round_all(summaries.group_stderr(wide_panel(spark, sf), "trat", [*ALT, *TIME]))


@query("group_count", f"{W} SELECT trat, dom, count(*) AS n FROM panel GROUP BY trat, dom")
def group_count(spark, sf):
    return summaries.group_count(wide_panel(spark, sf), ["trat", "dom"])


@query("group_length", f"{W} SELECT trat, frutos2, count(*) AS n FROM panel WHERE alt0 IS NOT NULL AND trat IS NOT NULL AND frutos2 IS NOT NULL GROUP BY ALL")
def group_length(spark, sf):
    return summaries.group_count(wide_panel(spark, sf), ["trat", "frutos2"], col="alt0")


_SIX = ", ".join([f"{r('min({0})')} AS \"min\"", f"{r('quantile_cont({0}, 0.25)')} AS q1", f"{r('median({0})')} AS median",
                  f"{r('avg({0})')} AS mean", f"{r('quantile_cont({0}, 0.75)')} AS q3", f"{r('max({0})')} AS \"max\"",
                  "count({0}) AS n"])


@query("six_num", f"SELECT l_returnflag, l_linestatus, {_SIX.format('l_extendedprice')} FROM lineitem GROUP BY ALL")
def six_num(spark, sf):
    return round_all(summaries.six_num(lines(spark, sf), "l_extendedprice", ["l_returnflag", "l_linestatus"]))


@query("six_num_global", f"SELECT {_SIX.format('o_totalprice')} FROM orders")
def six_num_global(spark, sf):
    return round_all(summaries.six_num(spark.read.parquet(f"{sf}/orders.parquet"), "o_totalprice"))


@query("column_range", "SELECT l_returnflag, min(l_quantity) AS low, max(l_quantity) AS high, min(l_extendedprice) AS low_price, max(l_extendedprice) AS high_price FROM lineitem GROUP BY ALL")
def column_range(spark, sf):
    return lines(spark, sf).groupBy("l_returnflag").agg(
        F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"),
        F.min("l_extendedprice").alias("low_price"), F.max("l_extendedprice").alias("high_price"))


@query("crosstab_prop", f"""WITH f AS (SELECT DISTINCT o_orderstatus FROM orders), p AS (SELECT DISTINCT o_orderpriority FROM orders),
c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)
SELECT f.o_orderstatus, p.o_orderpriority, coalesce(n, 0) AS n, {r('coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY f.o_orderstatus)')} AS prop
FROM f CROSS JOIN p LEFT JOIN c ON c.o_orderstatus = f.o_orderstatus AND c.o_orderpriority = p.o_orderpriority""")
def crosstab_prop(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    lv = clean.find_levels(orders, ["o_orderstatus", "o_orderpriority"])
    return round_all(summaries.crosstab_prop(orders, "o_orderstatus", "o_orderpriority", lv["o_orderstatus"], lv["o_orderpriority"]))


@query("pivot_counts", """SELECT l_returnflag, count(CASE WHEN l_linestatus = 'F' THEN 1 END) AS "F", count(CASE WHEN l_linestatus = 'O' THEN 1 END) AS "O"
FROM lineitem GROUP BY l_returnflag""")
def pivot_counts(spark, sf):
    return summaries.pivot_counts(lines(spark, sf), "l_returnflag", "l_linestatus", ["F", "O"])


@query("level_share", f"""{W}, b AS (SELECT min(alt0) AS lo, (max(alt0) - min(alt0)) / 3 AS w FROM panel),
k AS (SELECT trat, dom, CASE WHEN alt0 <= lo + w THEN 'low' WHEN alt0 <= lo + 2 * w THEN 'mid' WHEN alt0 IS NOT NULL THEN 'high' END AS alt_cat FROM panel, b),
s AS (SELECT trat, alt_cat, avg((dom = 'dom')::INTEGER) AS d, avg((dom = 'sub')::INTEGER) AS u FROM k WHERE alt_cat IS NOT NULL GROUP BY ALL)
SELECT trat, alt_cat, 'dom' AS dom, {r('d')} AS share FROM s UNION ALL SELECT trat, alt_cat, 'sub', {r('u')} FROM s""")
def level_share(spark, sf):
    df, _ = clean.cut_equal(wide_panel(spark, sf), "alt0", 3, ["low", "mid", "high"], out="alt_cat")
    return round_all(summaries.level_share(df, "dom", ["trat", "alt_cat"], ["dom", "sub"]))


_BOX = f"""WITH q AS (SELECT {{keys}}, quantile_cont({{x}}, 0.25) AS lo, median({{x}}) AS md, quantile_cont({{x}}, 0.75) AS hi FROM {{src}} GROUP BY {{keys}}),
f AS (SELECT d.*, q.lo, q.md, q.hi, d.{{x}} BETWEEN q.lo - 1.5 * (q.hi - q.lo) AND q.hi + 1.5 * (q.hi - q.lo) AS inside FROM {{src}} d JOIN q USING ({{keys}}))"""


@query("box_stats", _BOX.format(keys="event_type", x="value", src="events") + f"""
SELECT event_type, count(*) AS n, {r('min(CASE WHEN inside THEN value END)')} AS ymin, {r('any_value(lo)')} AS lower, {r('any_value(md)')} AS middle,
{r('any_value(hi)')} AS upper, {r('max(CASE WHEN inside THEN value END)')} AS ymax, count(CASE WHEN NOT inside THEN 1 END) AS n_outliers FROM f GROUP BY event_type""")
def box_stats(spark, sf):
    return round_all(summaries.box_stats(spark.read.parquet(f"{sf}/events.parquet"), "event_type", "value")[0])


@query("box_outliers", _BOX.format(keys="event_type", x="value", src="events") + " SELECT event_id, event_type, value FROM f WHERE NOT inside")
def box_outliers(spark, sf):
    outliers = summaries.box_stats(spark.read.parquet(f"{sf}/events.parquet"), "event_type", "value")[1]
    return outliers.select("event_id", "event_type", "value")


@query("box_cells", f"""{W}, l AS (SELECT * FROM ({long_sql(ALT, 'name', 'alt')}) WHERE alt IS NOT NULL),
q AS (SELECT trat, dom, wave, quantile_cont(alt, 0.25) AS lo, median(alt) AS md, quantile_cont(alt, 0.75) AS hi FROM l GROUP BY ALL),
f AS (SELECT l.*, lo, md, hi, alt BETWEEN lo - 1.5 * (hi - lo) AND hi + 1.5 * (hi - lo) AS inside FROM l JOIN q USING (trat, dom, wave))
SELECT trat, dom, wave, count(*) AS n, {r('min(CASE WHEN inside THEN alt END)', 9)} AS ymin, {r('any_value(lo)', 9)} AS lower, {r('any_value(md)', 9)} AS middle,
{r('any_value(hi)', 9)} AS upper, {r('max(CASE WHEN inside THEN alt END)', 9)} AS ymax, count(CASE WHEN NOT inside THEN 1 END) AS n_outliers FROM f GROUP BY ALL""")
def box_cells(spark, sf):
    long = reshape.to_long(wide_panel(spark, sf), IDS, ALT, "name", "alt", index="wave")
    return round_all(summaries.box_stats(long, ["trat", "dom", "wave"], "alt")[0], 9)


@query("histogram", """WITH b AS (SELECT i::INTEGER AS bin, i * 50.0 AS lower, (i + 1) * 50.0 AS upper FROM range(12) t(i))
SELECT bin, lower::DOUBLE AS lower, upper::DOUBLE AS upper, count(value) AS count FROM b LEFT JOIN events
ON (value > lower OR (bin = 0 AND value = 0)) AND value <= upper GROUP BY ALL""")
def histogram(spark, sf):
    """The twelve intervals up to 600; the values have a long tail, and the few above are counted in none, as in the SQL."""
    return summaries.histogram(spark.read.parquet(f"{sf}/events.parquet"), "value", [i * 50.0 for i in range(13)], outside="warn")


def _sturges_sql():
    # The round step for ceil(log2 n) + 1 classes, and the cells it spans.
    return """WITH s AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi, ceil(log2(count(*)) + 1) AS k FROM customer),
u AS (SELECT lo, hi, (hi - lo) / k AS cell, pow(10, floor(log10((hi - lo) / k))) AS base FROM s),
v AS (SELECT *, CASE WHEN 2*base - cell >= 1.5*(cell - base) THEN base WHEN 5*base - cell >= 2.75*(cell - 2*base) THEN 2*base
  WHEN 10*base - cell >= 1.5*(cell - 5*base) THEN 5*base ELSE 10*base END AS unit FROM u),
b AS (SELECT i::INTEGER AS bin, (floor(lo/unit + 1e-7) + i) * unit AS lower, (floor(lo/unit + 1e-7) + i + 1) * unit AS upper
  FROM v, range(100) t(i) WHERE floor(lo/unit + 1e-7) + i < ceil(hi/unit - 1e-7))
SELECT bin, lower, upper, count(c_acctbal) AS count FROM b LEFT JOIN customer ON (c_acctbal > lower OR (bin = 0 AND c_acctbal = lower)) AND c_acctbal <= upper GROUP BY ALL"""


@query("histogram_sturges", _sturges_sql())
def histogram_sturges(spark, sf):
    return summaries.histogram(spark.read.parquet(f"{sf}/customer.parquet"), "c_acctbal")


# ---------------------------------------------------------------- descriptive studies

def _q1_sql():
    parts = []
    for m, cols in (("alt", ALT), ("t", TIME), ("frutos", FRUTOS)):
        for c in cols:
            parts.append(f"SELECT trat, '{m}' AS measure, {c[-1]}::INTEGER AS wave, {r(f'avg({c})')} AS mean, "
                         f"{r(f'stddev_samp({c})/sqrt(count({c}))')} AS se, count({c}) AS n FROM panel GROUP BY trat")
    # the first cutting time weighted by the stump
    parts.append(f"SELECT trat, 't0pond', 0, {r('avg(t0 * tocon0 / 45)')}, {r('stddev_samp(t0 * tocon0 / 45)/sqrt(count(t0 * tocon0))')}, count(t0 * tocon0) FROM panel GROUP BY trat")
    return f"{W} " + " UNION ALL ".join(parts)


@query("q1_descriptive", _q1_sql())
def q1_descriptive(spark, sf):
    """One scan of the orders: moments of the finest cells, merged for each treatment and wave. A wave without values has a row with n = 0."""
    long = long_panel(spark, sf).withColumn("t0pond", F.when(F.col("wave") == 0, F.col("t") * F.col("tocon0") / 45))
    measures = ["alt", "t", "frutos", "t0pond"]
    found = summaries.describe_layers(summaries.moment_cube(long, ["trat", "dom", "sp", "wave"], measures), ["trat", "wave"], measures)
    cells = subjects(spark, sf).groupBy("trat").agg(F.lit(0)).select("trat", F.explode(F.array(*[F.struct(
        F.lit(m).alias("measure"), F.lit(w).alias("wave")) for m in measures for w in ([0] if m == "t0pond" else range(LAST_WAVE + 1))])).alias("c")).select("trat", "c.*")
    table = joins.left_join(cells, found, ["trat", "measure", "wave"])
    return round_all(table.select("trat", "measure", "wave", "mean", "se", F.coalesce("n", F.lit(0)).alias("n")))


@query("describe_waves", _q1_sql().rsplit(" UNION ALL ", 1)[0])
def describe_waves_query(spark, sf):
    return round_all(summaries.describe_waves(wide_panel(spark, sf), ["trat"], {"alt": ALT, "t": TIME, "frutos": FRUTOS}))


_Q2 = f"""{W}, b AS (SELECT min(alt0) AS lo, (max(alt0) - min(alt0)) / 3 AS w FROM panel),
l AS (SELECT *, CASE WHEN alt0 <= lo + w THEN 'low' WHEN alt0 <= lo + 2 * w THEN 'mid' WHEN alt0 IS NOT NULL THEN 'high' END AS alt_cat
  FROM ({long_sql(SUP, 'name', 'survival')}), b)
SELECT 'marginal' AS kind, wave AS year, trat, NULL AS alt_cat, NULL AS dom, {r('avg(survival)')} AS survival, NULL::DOUBLE AS alt0 FROM l WHERE survival IS NOT NULL GROUP BY wave, trat
UNION ALL SELECT 'height', wave, trat, alt_cat, NULL, {r('avg(survival)')}, {r('avg(alt0)')} FROM l WHERE survival IS NOT NULL AND alt0 IS NOT NULL GROUP BY wave, trat, alt_cat
UNION ALL SELECT 'dominance', wave, trat, NULL, dom, {r('avg(survival)')}, NULL FROM l WHERE survival IS NOT NULL GROUP BY wave, trat, dom"""


def observed_survival(spark, sf):
    """Observed proportions by wave x treatment: overall, by height class and by dominance.

    The panel is made once; its finest cells give every layer.
    """
    panel = durable(wide_panel(spark, sf).select("trat", "dom", "alt0", *SUP))
    panel, _ = clean.cut_equal(panel, "alt0", 3, ["low", "mid", "high"], out="alt_cat")
    long = reshape.to_long(panel, ["trat", "dom", "alt0", "alt_cat"], SUP, "name", "survival", index="year").where("survival is not null")
    cube = durable(summaries.moment_cube(long, ["year", "trat", "dom", "alt_cat"], ["survival", "alt0"]))

    def layer(by, cols):
        rows = summaries.roll_up(cube.dropna("any", subset=by), by, cols)
        return rows.select(*by, *[F.col(f"{c}_mean").alias(c) for c in cols])

    return joins.union_labelled({"marginal": layer(["year", "trat"], ["survival"]), "height": layer(["year", "trat", "alt_cat"], ["survival", "alt0"]),
                                 "dominance": layer(["year", "trat", "dom"], ["survival"])}, label="kind")


@query("q2_observed", _Q2)
def q2_observed(spark, sf):
    return round_all(observed_survival(spark, sf).select("kind", "year", "trat", "alt_cat", "dom", "survival", "alt0"))


@query("study_bundle", _Q2)
def study_bundle(spark, sf):
    """The layers of the observed survival, written as one version and read back."""
    table = observed_survival(spark, sf).select("kind", "year", "trat", "alt_cat", "dom", "survival", "alt0")
    path = f"{shared_folder(spark)}/wavepanel-bundle-{uuid.uuid4().hex}"
    table = durable(table)
    write_bundle({kind: table.where(F.col("kind") == kind) for kind in ("marginal", "height", "dominance")}, path)
    layers = read_bundle(spark, path)
    return round_all(layers["marginal"].unionByName(layers["height"]).unionByName(layers["dominance"]))


@query("observed_slice", f"""{L} SELECT yr, l_returnflag AS trat, {r('avg(big)')} AS p, {r('stddev_samp(big)/sqrt(count(*))')} AS se, count(*) AS n
FROM lines GROUP BY yr, l_returnflag""")
def observed_slice(spark, sf):
    return round_all(lines(spark, sf).groupBy("yr", F.col("l_returnflag").alias("trat")).agg(
        F.avg("big").alias("p"), summaries.std_error("big").alias("se"), F.count(F.lit(1)).alias("n")))

