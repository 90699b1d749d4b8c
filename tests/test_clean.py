import pytest
from pyspark.sql import functions as F

from shelfcast.operators import clean

CAL_COLS = "date string, wm_yr_wk string, weekday string, wday string, month string, year string, d string, " \
           "event_name_1 string, snap_CA string"


def test_clean_calendar_reference_case(spark):
    rows = [("2023-01-01", "12301", "Sunday", "2", "1", "2023", "d_1", None, "1"),
            ("2023-01-01", "12301", "Sunday", "2", "1", "2023", "d_1", None, "1"),
            ("invalid_date", "12301", "Monday", "3", "1", "2023", "d_2", None, "0"),
            ("2023-01-02", "12301", "Monday", "3", "1", "2023", "d_3", "NewYear", "1")]
    df = spark.createDataFrame(rows, CAL_COLS).withColumn("ingest_ord", F.monotonically_increasing_id())
    out = clean.clean_calendar(df).orderBy("date_str").collect()
    assert len(out) == 2
    assert [r.date_str for r in out] == ["2023-01-01", "2023-01-02"]
    assert [r.is_holiday for r in out] == [0, 1]
    assert out[0].event_name_1 == "None"


def test_clean_calendar_coercion_defaults(spark):
    rows = [("2023-03-05", "x", "Sunday", None, "bad", "", "d_1", "", "?")]
    out = clean.clean_calendar(spark.createDataFrame(rows, CAL_COLS), order_by="date").first()
    assert (out.wm_yr_wk, out.wday, out.month, out.year, out.snap_CA) == (0, 1, 1, 2022, 0)
    assert out.is_holiday == 0          # empty event name is not a holiday


def test_clean_prices_reference_case(spark):
    rows = [("CA_1", "FOODS_1_001", "11101", "3.50"), ("CA_1", "FOODS_1_001", "11101", "3.50"),
            ("CA_1", "FOODS_1_002", "11101", "-5.00")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)],
                               "store_id string, item_id string, wm_yr_wk string, sell_price string, ingest_ord long")
    out = clean.clean_prices(df).collect()
    assert len(out) == 2
    assert all(r.sell_price > 0 for r in out)
    assert sorted(r.sell_price for r in out) == [3.5, 3.5]


def test_clean_prices_keep_first_and_padding(spark):
    rows = [(" TX_1", "HOBBIES_1_001 ", "11102", "2.00", 2), ("TX_1", "HOBBIES_1_001", "11102", "9.00", 1),
            ("TX_1", "HOBBIES_1_001", "11102", "7.00", 3), ("TX_1", "HOBBIES_1_002", "11102", None, 4),
            ("TX_1", "HOBBIES_1_003", "11102", "4.00", 5)]
    df = spark.createDataFrame(rows, "store_id string, item_id string, wm_yr_wk string, sell_price string, "
                                     "ingest_ord long")
    out = sorted((r.store_id, r.item_id, r.sell_price) for r in clean.clean_prices(df).collect())
    # dedup runs before trimming: the padded row is its own key and survives next to the first
    # unpadded row (arrival order 1 -> 9.00); the null price gets the median of valid prices (2, 4, 9)
    assert out == [("TX_1", "HOBBIES_1_001", 2.0), ("TX_1", "HOBBIES_1_001", 9.0),
                   ("TX_1", "HOBBIES_1_002", 4.0), ("TX_1", "HOBBIES_1_003", 4.0)]
    trimmed_first = sorted((r.item_id, r.sell_price) for r in clean.clean_prices(df, trim_first=True).collect())
    assert trimmed_first == [("HOBBIES_1_001", 9.0), ("HOBBIES_1_002", 6.5), ("HOBBIES_1_003", 4.0)]


def test_unpivot_and_units(spark):
    wide = spark.createDataFrame(
        [("A_CA_1", "A", "D", "C", "CA_1", "CA", "5", "-3", "x"),
         ("A_CA_1", "A", "D", "C", "CA_1", "CA", "9", "9", "9"),
         ("B_CA_1", "B", "D", "C", "CA_1", "CA", None, "2.7", "1")],
        "id string, item_id string, dept_id string, cat_id string, store_id string, state_id string, "
        "d_1 string, d_2 string, d_3 string").withColumn("ingest_ord", F.monotonically_increasing_id())
    cal = spark.createDataFrame([("d_1", "2023-01-01"), ("d_2", "2023-01-02")], "d string, date_str string")
    out = {(r.id, r.d): r.sales_units for r in clean.clean_and_melt_sales(wide, cal).collect()}
    # d_3 has no calendar day -> dropped; negative and unparsable -> 0; 2.7 truncated to 2
    assert out == {("A_CA_1", "d_1"): 5, ("A_CA_1", "d_2"): 0, ("B_CA_1", "d_1"): 0, ("B_CA_1", "d_2"): 2}


def test_clean_calendar_without_event_columns(spark):
    df = spark.createDataFrame([("2023-01-01", "12252", "1", "1", "2023")],
                               "date string, wm_yr_wk string, wday string, month string, year string")
    r = clean.clean_calendar(df, order_by="date").first()
    assert r.is_holiday == 0 and r.date_str == "2023-01-01"


def test_first_row_wins_not_the_smallest(spark):
    prices = spark.createDataFrame([("S", "I", "1", "3.50", 1), ("S", "I", "1", "2.00", 2)],
                                   "store_id string, item_id string, wm_yr_wk string, sell_price string, ingest_ord long")
    assert [r.sell_price for r in clean.clean_prices(prices).collect()] == [3.5]
    wide = spark.createDataFrame([("A", "A", "D", "C", "S", "T", "9", "1", 1), ("A", "A", "D", "C", "S", "T", "2", "8", 2)],
                                 "id string, item_id string, dept_id string, cat_id string, store_id string, state_id string, "
                                 "d_1 string, d_2 string, ingest_ord long")
    cal = spark.createDataFrame([("d_1", "2023-01-01"), ("d_2", "2023-01-02"), ("d_2", "2023-01-03")], "d string, date_str string")
    out = {(r.date_str, r.sales_units) for r in clean.clean_and_melt_sales(wide, cal).collect()}
    assert out == {("2023-01-01", 9), ("2023-01-03", 1)}          # one whole row; one date a day id, the last
    with pytest.raises(ValueError):
        clean.keep_first(prices.drop("ingest_ord"), ["store_id"])


def test_dirty_numbers_never_abort(spark):
    bad = ["NaN", "Infinity", "-inf", "3000000000", "1e300", "text", None, ""]
    units = spark.createDataFrame([(x,) for x in [*bad, "7.9"]], "sales_units string")
    assert [r[0] for r in units.select(clean.clean_units("sales_units")).collect()] == [0] * len(bad) + [7]
    rows = [("2023-01-%02d" % (i + 1), x, "Sunday", x, x, x, f"d_{i}", None, x) for i, x in enumerate(bad)]
    out = clean.clean_calendar(spark.createDataFrame(rows, CAL_COLS), order_by="date").collect()
    assert {(r.wm_yr_wk, r.wday, r.month, r.year, r.snap_CA) for r in out} == {(0, 1, 1, 2022, 0)}
    prices = spark.createDataFrame([("S", f"I{i}", "1", x, i) for i, x in enumerate(["NaN", "Infinity", "text", None, "4.00"])],
                                   "store_id string, item_id string, wm_yr_wk string, sell_price string, ingest_ord long")
    assert {r.sell_price for r in clean.clean_prices(prices).collect()} == {4.0}


def test_unit_cost_counts_whole_cents(spark):
    from shelfcast.operators import dims
    for price, cost in ((0.29, 0.17), (0.58, 0.35), (1.15, 0.69), (4.35, 2.61)):
        sales = spark.createDataFrame([("FOODS_1_001", "FOODS_1", "FOODS")], "item_id string, dept_id string, cat_id string")
        prices = spark.createDataFrame([("FOODS_1_001", price)], "item_id string, sell_price double")
        assert dims.dim_products(sales, prices).first().unit_cost == cost
