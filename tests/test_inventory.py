from pyspark.sql import functions as F

from shelfcast.functions import inventory as inv


def _one(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


def test_safety_stock(spark):
    v = _one(spark, inv.safety_stock(25.0, 10.0, 3.0, 7, 1.65))
    assert isinstance(v, int) and v == 14
    assert inv.scalar_safety_stock(25.0, 10.0, 3.0, 7, 1.65) == 14
    assert _one(spark, inv.safety_stock(25.0, 10.0, 3.0, 7, 1.65, method="max_min")) == 105


def test_reorder_point(spark):
    assert _one(spark, inv.reorder_point(10.0, 7, 15)) == 85


def test_order_quantity(spark):
    assert _one(spark, inv.order_quantity(70.0, 15, 20)) == 65
    assert _one(spark, inv.order_quantity(10.0, 1, 50)) == 0


def test_risk_reference_case(spark):
    level, status, days = inv.risk_class(5, 85, 15, 10.0, 7)
    r = spark.range(1).select(
        level.alias("level"), status.alias("status"),
        inv.stockout_risk(5, 15, 10.0, 7).alias("so"), inv.overstock_risk(5, 10.0, 7).alias("os"),
        F.date_format(F.date_add(F.to_date(F.lit("2023-12-31")), days), "yyyy-MM-dd").alias("d")).first()
    assert (r.level, r.status) == ("High Risk", "Critical Stockout Risk")
    assert r.so == 94.1 and r.os == 0.0 and r.d == "2024-01-01"


def test_risk_other_classes(spark):
    def cls(onhand, rop, ss, avg):
        level, status, days = inv.risk_class(onhand, rop, ss, avg, 7)
        return tuple(spark.range(1).select(level, status, days).first())
    assert cls(20, 85, 15, 10.0) == ("Medium Risk", "Reorder Needed", 1)
    assert cls(300, 85, 15, 10.0) == ("Medium Risk", "Excess Overstock", 30)    # 30 days: 24.5 < dos <= 36.75
    assert cls(400, 85, 15, 10.0) == ("High Risk", "Excess Overstock", 40)
    assert cls(100, 85, 15, 10.0) == ("Low Risk", "Healthy Buffer", 1)
