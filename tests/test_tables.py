"""Cleaning, reshaping, joins, summaries, sources."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from wavepanel.functions.columns import paste
from wavepanel.operators import clean, joins, reshape, summaries
from wavepanel.sources.tables import panel_schema, preview, read_panel, write_layers, write_table


@pytest.fixture(scope="module")
def na_panel(spark):
    rows = [(1, "a", 1.0, 2.0, None), (2, "a", 3.0, None, None), (3, "b", None, None, None),
            (4, None, 4.0, 5.0, 6.0), (5, "b", 7.0, 8.0, 9.0), (6, "a", 2.0, 2.0, 2.0)]
    return spark.createDataFrame(rows, "id long, trat string, alt0 double, alt1 double, alt2 double")


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_means_skip_propagate_casewise(na_panel):
    skip = dict(rows(summaries.group_mean(na_panel, "trat", ["alt1"]), "trat"))
    assert skip == {None: 5.0, "a": 2.0, "b": 8.0}
    prop = dict(rows(summaries.group_mean(na_panel, "trat", ["alt1"], na="propagate"), "trat"))
    assert prop == {None: 5.0, "a": None, "b": None}
    case = rows(summaries.group_mean(na_panel, "trat", ["alt0", "alt2"], casewise=True), "trat")
    assert case == [("a", 2.0, 2.0), ("b", 7.0, 9.0)]


def test_stderr_and_counts(na_panel):
    se = dict(rows(summaries.group_stderr(na_panel, "trat", ["alt0"]), "trat"))
    assert se["a"] == pytest.approx(1.0 / math.sqrt(3))
    assert dict(rows(summaries.group_count(na_panel, "trat"), "trat")) == {None: 1, "a": 3, "b": 2}
    assert dict(rows(summaries.group_count(na_panel, "trat", col="alt1"), "trat")) == {"a": 2, "b": 1}


def test_unpivot_keeps_missing_and_baseline(na_panel):
    long = reshape.to_long(na_panel, ["id"], ["alt0", "alt1", "alt2"], "name", "alt", index="wave", base="alt0")
    assert long.count() == 18
    assert rows(long.where("id = 2").select("wave", "alt0", "alt"), "wave") == [(0, 3.0, 3.0), (1, 3.0, None), (2, 3.0, None)]


def test_paired_unpivot(spark):
    df = spark.createDataFrame([(1, 10.0, 11.0, 1, 2)], "id long, t0 double, t1 double, n1 int, n2 int")
    long = reshape.to_long_multi(df, ["id"], {"t": ["t0", "t1"], "n": ["n1", "n2"]}, "wave")
    assert rows(long, "wave") == [(1, 0, 10.0, None), (1, 1, 11.0, 1), (1, 2, None, 2)]


def test_null_matches_null_in_left_join(spark, na_panel):
    other = spark.createDataFrame([("a", 1), (None, 2)], "trat string, k int")
    got = dict(rows(joins.left_join(na_panel.select("id", "trat"), other, "trat").select("id", "k"), "id"))
    assert got == {1: 1, 2: 1, 3: None, 4: 2, 5: None, 6: 1}
    with pytest.raises(ValueError, match="floating"):
        joins.left_join(na_panel, na_panel.select("alt0"), "alt0")


def test_bind_by_key_requires_one_to_one(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    b = spark.createDataFrame([(2, "q"), (1, "p")], "k int, b string")
    assert rows(joins.bind_by_key(a, b, ["k"]), "k") == [(1, "x", "p"), (2, "y", "q")]
    with pytest.raises(ValueError, match="one to one"):
        joins.bind_by_key(a, b.union(b), ["k"])


def test_expand_grid_order(spark):
    g = joins.expand_grid(spark, a=[1.0, 2.0], b=["x", "y", "z"])
    assert rows(g, "grid_id") == [(0, 1.0, "x"), (1, 2.0, "x"), (2, 1.0, "y"), (3, 2.0, "y"), (4, 1.0, "z"), (5, 2.0, "z")]


def test_equal_width_bins_are_right_closed(spark):
    df = spark.createDataFrame([(float(v),) for v in (100, 276, 277, 453, 454, 630)] + [(None,)], "alt0 double")
    out, levels = clean.cut_equal(df, "alt0", 3)
    # Published labels for a range of 100 to 630.
    assert levels.values == ("(99.5,277]", "(277,453]", "(453,631]")
    got = {r["alt0"]: r["alt0_cat"] for r in out.collect()}
    assert got[100.0] == got[276.0] == "(99.5,277]"
    assert got[277.0] == got[453.0] == "(277,453]"   # 277 > 276.67 and 453 <= 453.33
    assert got[454.0] == got[630.0] == "(453,631]"
    assert got[None] is None


def test_level_order_of_first_appearance(spark):
    df = spark.createDataFrame([(1, "c"), (2, "a"), (3, "b"), (4, "a"), (5, None)], "i int, x string")
    assert clean.find_levels(df, ["x"], order_by="i")["x"].values == ("c", "a", "b")
    assert clean.find_levels(df, ["x"])["x"].values == ("a", "b", "c")
    lv = clean.Levels("x", ("c", "a", "b"))
    assert clean.drop_levels(df.where("x <> 'a'"), lv).values == ("c", "b")
    with pytest.raises(ValueError, match="levels"):
        clean.find_levels(df, ["i"], limit=3)


def test_relabel_keeps_unmatched(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,)], "x string")
    assert [r[0] for r in clean.relabel(df, "x", {"a": "annual"}).collect()] == ["annual", "z", None]
    out, lv = clean.with_levels(df, "x", ["a"], ["annual"])
    assert [r[0] for r in out.collect()] == ["annual", None, None] and lv.values == ("annual",)


def test_row_sum_indicator_paste(na_panel):
    df = clean.row_sum(na_panel, ["alt1", "alt2"], "total")
    assert dict(rows(df.select("id", "total"), "id"))[3] == 0.0
    df = clean.indicator(na_panel, F.col("alt1") > 4, "big")
    assert dict(rows(df.select("id", "big"), "id")) == {1: 0, 2: None, 3: None, 4: 1, 5: 1, 6: 0}
    assert [r[0] for r in na_panel.orderBy("id").select(paste("trat", "id")).collect()][3] == "NA 4"


def test_scaler_is_reused(spark):
    train = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "x double")
    scaler = clean.zscore_fit(train, ["x"])
    assert [r["x_z"] for r in clean.zscore_apply(spark.createDataFrame([(4.0,)], "x double"), scaler).collect()] == [2.0]
    with pytest.raises(ValueError, match="spread"):
        clean.zscore_fit(train.where("x = 1"), ["x"])


@pytest.mark.parametrize("limit", [200_000, 40, 3])
def test_exact_quantiles_on_both_paths(spark, limit):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", None], 3000, p=[0.7, 0.2, 0.1]),
                        "x": np.round(np.exp(rng.normal(0, 3, 3000)), 3)})
    pdf.loc[pdf.index[:200], "x"] = 0.5                      # one heavy tie
    pdf.loc[pdf.index[200:250], "x"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("x", F.nanvl("x", F.lit(None).cast("double"))).withColumn(
        "g", F.when(F.col("g") != "NaN", F.col("g")))
    probs = [0.0, 0.1, 0.25, 0.5, 0.777, 1.0]
    got = {r["g"]: r for r in summaries.quantiles(df, "x", probs, "g", exact_distinct=limit).collect()}
    for g in ("a", "b", None):
        x = pdf[pdf.g.isna() if g is None else pdf.g == g].x.dropna()
        assert got[g]["n"] == len(x)
        assert [got[g][f"q{i}"] for i in range(len(probs))] == pytest.approx(np.quantile(x, probs), rel=1e-12)
    whole = summaries.quantiles(df, "x", [0.5], exact_distinct=limit).collect()
    assert len(whole) == 1 and whole[0]["q0"] == pytest.approx(pdf.x.median(), rel=1e-12)


def test_box_whiskers_and_outliers(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [1, 2, 3, 4, 5, 6, 7, 8, 9, 40]] + [("a", None)], "g string, x double")
    stats, out = summaries.box_stats(df, "g", "x")
    r = stats.first()
    assert (r["n"], r["ymin"], r["lower"], r["middle"], r["upper"], r["ymax"], r["n_outliers"]) == (10, 1, 3.25, 5.5, 7.75, 9, 1)
    assert [tuple(x) for x in out.collect()] == [("a", 40.0)]


def test_crosstab_fills_absent_cells(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "r string, c string")
    got = {(r["r"], r["c"]): (r["n"], r["prop"]) for r in summaries.crosstab_prop(df, "r", "c", ["a", "b"], ["x", "y"]).collect()}
    assert got == {("a", "x"): (2, 1.0), ("a", "y"): (0, 0.0), ("b", "x"): (0, 0.0), ("b", "y"): (1, 1.0)}
    share = {(r["r"], r["c"]): r["share"] for r in summaries.level_share(df, "c", "r", ["x", "y"]).collect()}
    assert share[("a", "x")] == 1.0 and share[("b", "x")] == 0.0


def test_marginalise_matches_by_key(spark):
    pred = spark.createDataFrame([("t1", "d", 0.2), ("t1", "s", 0.6), ("t2", "s", 0.4), ("t2", "d", 0.8)], "t string, dom string, p double")
    w = spark.createDataFrame([("t2", "d", 0.25), ("t2", "s", 0.75), ("t1", "d", 0.5), ("t1", "s", 0.5)], "t string, dom string, share double")
    got = dict(rows(summaries.marginalise(pred, "dom", ["t"], "p", w, ["t"]), "t"))
    assert got == pytest.approx({"t1": 0.4, "t2": 0.5})
    assert dict(rows(summaries.marginalise(pred, "dom", ["t"], "p"), "t")) == pytest.approx({"t1": 0.4, "t2": 0.6})


def test_histogram_is_right_closed(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 1, 2, 3)], "x double")
    assert [r["count"] for r in summaries.histogram(df, "x", [0, 1, 2, 3]).orderBy("bin").collect()] == [3, 1, 1]
    assert summaries.pretty_breaks(0, 47, 6) == [0, 10, 20, 30, 40, 50]
    assert summaries.pretty_breaks(-994.28, 9997.41, 12) == [1000.0 * i for i in range(-1, 11)]


def test_csv_round_trip(spark, tmp_path):
    src = tmp_path / "panel.csv"
    src.write_text("ID,trat,alt1,alt0,extra\ns1,a,NA,120.5,q\ns2,b,80,99,r\n")
    df = read_panel(spark, str(src), "ID string, trat string, alt0 double, alt1 double")
    assert rows(df, "ID") == [("s1", "a", 120.5, None), ("s2", "b", 99.0, 80.0)]
    with pytest.raises(ValueError, match="sup1"):
        read_panel(spark, str(src), "ID string, sup1 int")
    assert read_panel(spark, str(src)).schema["alt0"].dataType.simpleString() == "double"
    write_table(df, str(tmp_path / "out"))
    back = read_panel(spark, str(tmp_path / "out"), df.schema)
    assert rows(back, "ID") == rows(df, "ID")
    paths = write_layers({"points": df, "boxes": df.limit(1)}, str(tmp_path / "layers"))
    assert spark.read.parquet(paths["points"]).count() == 2 and spark.read.parquet(paths["boxes"]).count() == 1
    assert "frutos5" in panel_schema().names


def test_preview(na_panel):
    got = {r["column"]: r for r in preview(na_panel).collect()}
    assert got["alt1"]["n_missing"] == 2 and got["alt1"]["max"] == 8.0 and got["trat"]["mean"] is None


def test_column_choice(na_panel):
    assert clean.cols_matching(na_panel, "alt") == ["alt0", "alt1", "alt2"]
    assert clean.cols_any_of(na_panel, ["alt9", "alt2", "id"]) == ["id", "alt2"]


def test_histogram_query_counts_its_intervals_beside_a_longer_tail(spark, tmp_path):
    values = [0.0, 50.0, 50.1, 600.0, 600.1, 731.5, None, float("nan")]
    spark.createDataFrame([(v,) for v in values], "value double").write.parquet(str(tmp_path / "events.parquet"))
    with pytest.warns(UserWarning, match="3 values"):
        got = entry.queries()["histogram"](spark, str(tmp_path)).orderBy("bin").collect()
    want = duckdb.connect()
    want.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert [tuple(r) for r in got] == sorted(want.execute(entry.oracle_sql()["histogram"]).fetchall())
    assert [r["count"] for r in got] == [2, 1] + [0] * 9 + [1]
