"""Inventory formulas (I5-I12) as column expressions.

Every argument may be a column name, a Column or a Python number, so the
same expressions serve the distributed planner and scalar checks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfcast.functions.rounding import half_up

# Fixed values of the inventory policy
DEFAULT_LEAD_TIME_DAYS = 7
DEFAULT_SERVICE_LEVEL_Z = 1.65
OVERSTOCK_DAYS_PER_LEAD_DAY = 3.5
SEVERE_OVERSTOCK_FACTOR = 1.5
MIN_DAILY_DEMAND = 0.1

HIGH, MEDIUM, LOW = "High Risk", "Medium Risk", "Low Risk"
CRITICAL, REORDER, OVERSTOCK, HEALTHY = ("Critical Stockout Risk", "Reorder Needed",
                                         "Excess Overstock", "Healthy Buffer")


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def safety_stock(max_demand, avg_demand, demand_std, lead_time=DEFAULT_LEAD_TIME_DAYS,
                 z=DEFAULT_SERVICE_LEVEL_Z, method: str = "statistical") -> Column:
    """max(1, ceil(z*std*sqrt(LT))) or, for 'max_min', max(1, ceil((max-avg)*LT))."""
    lt = _c(lead_time)
    if method == "max_min":
        ss = (_c(max_demand) - _c(avg_demand)) * lt
    else:
        ss = _c(z) * _c(demand_std) * F.sqrt(lt.cast("double"))
    return F.greatest(F.lit(1), F.ceil(ss).cast("int"))


def reorder_point(avg_demand, lead_time, ss) -> Column:
    """max(1, ceil(avg*LT + SS))."""
    return F.greatest(F.lit(1), F.ceil(_c(avg_demand) * _c(lead_time) + _c(ss)).cast("int"))


def order_quantity(forecast_demand, ss, current_inventory) -> Column:
    """max(0, ceil(forecast + SS - on hand))."""
    return F.greatest(F.lit(0), F.ceil(_c(forecast_demand) + _c(ss) - _c(current_inventory)).cast("int"))


def days_of_supply(current_inventory, avg_demand) -> Column:
    """I8: round(on hand / max(0.1, avg), 1)."""
    return half_up(_c(current_inventory) / F.greatest(F.lit(MIN_DAILY_DEMAND), _c(avg_demand)), 1)


def order_cost(qty, unit_cost) -> Column:
    """I8: qty x unit cost, exact to the cent (DECIMAL)."""
    return (_c(qty).cast("decimal(10,0)") * _c(unit_cost).cast("decimal(10,2)")).cast("decimal(14,2)")


def _daily(avg_rounded) -> Column:
    return F.greatest(F.lit(MIN_DAILY_DEMAND), _c(avg_rounded))


def stockout_risk(current_inventory, ss, avg_rounded, lead_time) -> Column:
    """clip((LT demand + SS - on hand) / max(1, LT demand + SS) * 100, 0, 100), 1 decimal."""
    ltd = _daily(avg_rounded) * _c(lead_time)
    raw = (ltd + _c(ss) - _c(current_inventory)) / F.greatest(F.lit(1.0), ltd + _c(ss)) * F.lit(100.0)
    return half_up(F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw)), 1)


def _overstock_threshold(lead_time) -> Column:
    return _c(lead_time) * F.lit(OVERSTOCK_DAYS_PER_LEAD_DAY)


def overstock_risk(current_inventory, avg_rounded, lead_time) -> Column:
    """Percent above the 3.5 x LT days-of-supply threshold, capped at 100, 1 decimal."""
    dos = _c(current_inventory) / _daily(avg_rounded)
    thr = _overstock_threshold(lead_time)
    raw = F.least(F.lit(100.0), F.greatest(F.lit(0.0), (dos - thr) / thr * F.lit(100.0)))
    return half_up(F.when(dos > thr, raw).otherwise(F.lit(0.0)), 1)


def risk_class(current_inventory, reorder_pt, ss, avg_rounded, lead_time) -> tuple[Column, Column, Column]:
    """I11 + I12: (risk_level, inventory_status, days until suggested replenishment).

    First match wins: below safety stock -> High / Critical; at or below the
    reorder point -> Medium / Reorder Needed; days of supply above the
    threshold -> Excess Overstock (High above 1.5 x threshold); else Low.
    """
    inv, ss_, rop = _c(current_inventory), _c(ss), _c(reorder_pt)
    daily = _daily(avg_rounded)
    dos = inv / daily
    thr = _overstock_threshold(lead_time)
    below_ss, below_rop, over = inv < ss_, inv <= rop, dos > thr
    level = (F.when(below_ss, HIGH).when(below_rop, MEDIUM)
             .when(over, F.when(dos > thr * F.lit(SEVERE_OVERSTOCK_FACTOR), HIGH).otherwise(MEDIUM))
             .otherwise(LOW))
    status = (F.when(below_ss, CRITICAL).when(below_rop, REORDER).when(over, OVERSTOCK)
              .otherwise(HEALTHY))
    days = (F.when(below_ss, F.lit(1))
            .when(below_rop, F.greatest(F.lit(1), ((inv - ss_) / daily).cast("int")))
            .when(over, dos.cast("int"))
            .otherwise(F.greatest(F.lit(1), ((inv - rop) / daily).cast("int"))))
    return level, status, days


def z_for_confidence(level: float) -> float:
    """Interval multiplier: 1.96 at 95 % or above, else 1.28."""
    return 1.96 if level >= 0.95 else 1.28


def scalar_safety_stock(max_d: float, avg_d: float, std_d: float, lead_time: int = 7,
                        z: float = 1.65, method: str = "statistical") -> int:
    """Plain-Python twin of ``safety_stock`` for single values (tests, notebooks)."""
    ss = (max_d - avg_d) * lead_time if method == "max_min" else z * std_d * math.sqrt(lead_time)
    return max(1, int(math.ceil(ss)))
