"""Declared constraints, ordinal codes, Gram sums, title case, whole-table replacement, keep-first across deliveries."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from shelfcast.operators import codes, dims, forecast, quality
from shelfcast.operators import features as fe
from shelfcast.sources import io
from shelfcast.streaming.ingest import ingest_daily_sales


def test_codes_are_ranks_over_many_ranges(spark):
    labels = [f"{i * 7919 % 5003:05d}" for i in range(5003)] + ["É", "a", "", "z" * 200]
    df = spark.createDataFrame([(x,) for x in labels * 2 + [None]], "c string").repartition(7)
    got = {r.label: r.code for r in codes.ordinal_codes(df, "c").collect()}
    assert got == {x: i for i, x in enumerate(sorted(set(labels), key=str.encode))}
    some = spark.createDataFrame([("00002",), ("never seen",), (None,)], "c string")
    coded = codes.with_code(some, codes.ordinal_codes(df, "c"), "c", "code").collect()
    assert {r.c: r.code for r in coded} == {"00002": float(got["00002"]), "never seen": 0.0, None: 0.0}
    assert codes.ordinal_codes(df.filter("false"), "c").count() == 0


def test_absent_column_gets_code_zero(spark):
    train = spark.createDataFrame([("a", "x"), ("b", "y")], "store_id string, cat_id string")
    got = forecast.encode_categoricals(train, forecast.fit_codes(train)).collect()
    assert {(r.store_id, r.store_code, r.cat_code, r.dept_code) for r in got} == {("a", 0.0, 0.0, 0.0), ("b", 1.0, 1.0, 0.0)}


def _history(spark, series=3, n=90):
    rng = np.random.default_rng(3)
    rows = []
    for s in range(series):
        for i in range(n - 20 * s):
            d = pd.Timestamp("2022-03-01") + pd.Timedelta(days=int(i) + s)
            rows.append((f"I{s}", "CA_1", d.date(), d.strftime("%Y-%m-%d"), int(rng.poisson(20)), int(i % 9 == 0), int(i % 4 == 0), float(900 + rng.integers(0, 50)) / 7))
    return spark.createDataFrame(rows, "item_id string, store_id string, date date, date_str string, sales_units int, is_holiday int, snap_indicator int, sell_price double")


def test_gram_solution_equals_the_rows_solution(spark):
    design = forecast.design_rows(_history(spark))
    got = {r.item_id: r for r in forecast.solve_additive(forecast.gram_sums(design)).collect()}
    for item, pdf in design.toPandas().groupby("item_id"):
        X, y = pdf[fe.ADDITIVE_FEATURES].to_numpy(float), pdf["_target"].to_numpy(float)
        Xc, yc = X - X.mean(0), y - y.mean()
        beta = np.linalg.solve(Xc.T @ Xc + forecast.RIDGE_ALPHA * np.eye(X.shape[1]), Xc.T @ yc)
        resid = yc - Xc @ beta
        np.testing.assert_allclose(got[item].coef, beta, rtol=1e-9, atol=1e-9)
        np.testing.assert_allclose(got[item].intercept, y.mean() - X.mean(0) @ beta, rtol=1e-9)
        np.testing.assert_allclose(got[item].residual_std, resid.std(), rtol=1e-9)
        assert got[item].n_train == len(pdf)


def test_gram_increments_add(spark):
    design = forecast.design_rows(_history(spark))
    days = design.withColumn("_early", F.col("trend_linear") < 0.1)
    whole = forecast.gram_sums(design)
    parts = forecast.add_grams(forecast.gram_sums(days.filter("_early")), forecast.gram_sums(days.filter("not _early")))
    a, b = ({r.item_id: r.gram for r in g.collect()} for g in (whole, parts))
    assert a.keys() == b.keys()
    for k in a:
        np.testing.assert_allclose(a[k], b[k], rtol=1e-12, atol=1e-12)  # sums of sines cancel to about 0
    nothing = forecast.gram_sums(days.filter("trend_linear < 0"))
    assert {r.item_id for r in forecast.add_grams(whole, nothing).collect()} == set(a)


def test_only_gram_rows_reach_python(spark):
    plan = forecast.fit_additive(_history(spark))._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "FlatMapGroupsInPandas" not in plan


def test_ridge_gradient_shows_wrong_coefficients(spark):
    design = forecast.design_rows(_history(spark))
    right = forecast.fit_additive(_history(spark))
    assert max(r.gradient for r in forecast.ridge_gradient(design, right).collect()) < 1e-9
    wrong = right.withColumn("intercept", F.col("intercept") + 0.01)
    assert min(r.gradient for r in forecast.ridge_gradient(design, wrong).collect()) > 1e-6


def test_constraints_find_each_kind_in_one_scan(spark):
    stores = spark.createDataFrame([("s1", "CA"), ("s2", None), ("s2", "TX")], "store_id string, state_id string")
    sales = spark.createDataFrame([("i1", "s1", "d1", 1), ("i1", "s1", "d1", 2), ("i1", "s9", "d1", None), (None, "s1", "d2", 1), ("i1", None, "d2", 1)],
                                  "item_id string, store_id string, date_str string, sales_units int")
    spec = {"dim_stores": (["store_id"], ["state_id"], []), "fact_sales": (["item_id", "store_id", "date_str"], ["sales_units"], [("store_id", "dim_stores")])}
    got = {(r.dataset, r.check): (r.status, r.total_records, r.failed_records) for r in quality.constraint_suite({"dim_stores": stores, "fact_sales": sales}, spec).collect()}
    assert got == {
        ("dim_stores", "Primary Key Uniqueness"): ("FAILED", 3, 1), ("dim_stores", "Not Null Columns"): ("FAILED", 3, 1),
        ("fact_sales", "Primary Key Uniqueness"): ("FAILED", 5, 1), ("fact_sales", "Not Null Columns"): ("FAILED", 5, 3),
        ("fact_sales", "Foreign Key Integrity"): ("FAILED", 5, 2)}
    empty = quality.table_constraints("fact_sales", {"fact_sales": sales.filter("false"), "dim_stores": stores}, *spec["fact_sales"]).collect()
    assert {(r.status, r.total_records) for r in empty} == {("PASSED", 0)}


def test_constraint_plan_scans_the_fact_once(spark, tmp_path):
    spark.range(10).select(F.col("id").alias("k"), F.col("id").alias("a"), F.col("id").alias("b")).write.parquet(str(tmp_path / "fact"))
    spark.range(10).select(F.col("id").alias("a"), F.col("id").alias("b")).write.parquet(str(tmp_path / "dim"))
    tables = {"fact": spark.read.parquet(str(tmp_path / "fact")), "da": spark.read.parquet(str(tmp_path / "dim")), "db": spark.read.parquet(str(tmp_path / "dim"))}
    plan = quality.table_constraints("fact", tables, ["k"], ["a"], [("a", "da"), ("b", "db")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("/fact]") == 1


@pytest.mark.parametrize("label, title", [("FOODS_1", "Foods 1"), ("FOODS-NEW_X", "Foods-New X"), ("a1b o'neil", "A1B O'Neil"), ("ÉTÉ_2", "Été 2"), ("", ""), ("__x", "  X")])
def test_title_case_as_after_any_non_letter(spark, label, title):
    assert label.replace("_", " ").title() == title
    assert spark.createDataFrame([(label,)], "c string").select(dims.title_label("c")).first()[0] == title


def test_replace_keeps_the_old_rows_when_a_run_fails(spark, tmp_path):
    root, table = str(tmp_path / "t"), "replaced_in_a_test"
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    io.replace_table(spark.range(5), table, root)
    reader = spark.table(table)
    with pytest.raises(PySparkException):
        io.replace_table(spark.range(0, 100, 1, 4).select(F.when(F.col("id") > 90, F.raise_error(F.lit("no")).cast("long")).otherwise(F.col("id")).alias("id")), table, root)
    assert spark.table(table).count() == 5
    io.replace_table(spark.range(7, 9), table, root)
    assert sorted(r.id for r in spark.table(table).collect()) == [7, 8]
    assert reader.count() == 5  # began before
    with pytest.raises(ValueError):
        io.replace_table(spark.range(2).select(F.col("id").cast("string")), table, root)
    io.replace_table(spark.range(0), table, root)
    assert spark.table(table).count() == 0
    spark.sql(f"DROP TABLE {table}")


def test_a_later_delivery_does_not_replace_an_earlier_row(spark, tmp_path):
    landing, target, checkpoint = (str(tmp_path / x) for x in ("landing", "target", "checkpoint"))
    os.makedirs(landing)
    calendar = spark.createDataFrame([("d_1", "2023-01-01"), ("d_2", "2023-01-02")], "d string, date_str string")
    head = "id,item_id,dept_id,cat_id,store_id,state_id,d_1,d_2\n"
    (tmp_path / "landing" / "a.csv").write_text(head + "x,x,D,C,S,ST,1,2\nx,x,D,C,S,ST,9,9\n")
    ingest_daily_sales(spark, landing, calendar, target, checkpoint, ["d_1", "d_2"])
    (tmp_path / "landing" / "b.csv").write_text(head + "x,x,D,C,S,ST,7,7\ny,y,D,C,S,ST,3,4\n")
    ingest_daily_sales(spark, landing, calendar, target, checkpoint, ["d_1", "d_2"])
    (tmp_path / "landing" / "c.csv").write_text(head + "y,y,D,C,S,ST,8,8\n")
    ingest_daily_sales(spark, landing, calendar, target, checkpoint, ["d_1", "d_2"])
    want = {("x", "2023-01-01", 1), ("x", "2023-01-02", 2), ("y", "2023-01-01", 3), ("y", "2023-01-02", 4)}
    rows = lambda: sorted((r.id, r.date_str, r.sales_units) for r in spark.read.parquet(target).collect())
    assert rows() == sorted(want)
    # the second batch is tried again: its commit is gone, the rest stays
    commits = tmp_path / "checkpoint" / "commits"
    for f in os.listdir(commits):
        if f.lstrip(".").split(".")[0] in ("1", "2"):
            os.remove(commits / f)
    for f in os.listdir(tmp_path / "checkpoint" / "offsets"):
        if f.lstrip(".").split(".")[0] == "2":
            os.remove(tmp_path / "checkpoint" / "offsets" / f)
    ingest_daily_sales(spark, landing, calendar, target, checkpoint, ["d_1", "d_2"])
    assert rows() == sorted(want)
