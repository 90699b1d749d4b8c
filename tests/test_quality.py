from shelfcast.operators import quality


def test_pricing_integrity_reference_case(spark):
    df = spark.createDataFrame([("CA_1", "I1", 11101, 5.0), ("CA_1", "I2", 11101, 10.0)],
                               "store_id string, item_id string, wm_yr_wk int, sell_price double")
    r = quality.check_pricing_integrity(df).first()
    assert r.status == "PASSED" and r.failed_records == 0 and r.total_records == 2


def test_pricing_integrity_flags(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (1001.0,), (None,)], "sell_price double")
    r = quality.check_pricing_integrity(df).first()
    assert r.status == "FAILED" and r.failed_records == 3


def test_duplicates_null_keys_compare_equal(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), ("a", 1), ("a", 2)], "k string, v int")
    r = quality.check_duplicate_records(df, "x", ["k", "v"]).first()
    assert r.failed_records == 1 and r.status == "FAILED"
    assert r.details == "Duplicates on ['k', 'v']: 1"


def test_missing_records_details(spark):
    df = spark.createDataFrame([(None, 1), ("a", None), ("b", 2)], "a string, b int")
    r = quality.check_missing_records(df, "ds", ["a", "b"]).first()
    assert r.failed_records == 2 and r.details == "Null counts per column: {'a': 1, 'b': 1}"


def test_outliers_iqr(spark):
    df = spark.createDataFrame([(x,) for x in [1, 2, 3, 4, 5, 6, 7, 8, 100]], "sales_units int")
    r = quality.check_sales_outliers(df).first()
    # q25 = 3, q75 = 7 -> bound 23
    assert r.status == "INFO" and r.failed_records == 1
    assert r.details == "Sales units > 23.0 (1 high spikes flagged for awareness)"


def test_date_completeness(spark):
    df = spark.createDataFrame([("2023-01-01",), ("2023-01-02",), ("2023-01-05",)], "date_str string")
    r = quality.check_date_completeness(df).first()
    assert r.failed_records == 2 and r.total_records == 3 and r.status == "FAILED"
