"""Calendar column expressions (retail week codes, weekday numbering, events)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the source platform's calendar generator.
# Holidays by month-day: (month-day, event name, event type)
HOLIDAYS = [
    ("01-01", "NewYear", "National"),
    ("01-20", "MartinLutherKingDay", "National"),
    ("02-02", "SuperBowl", "Sporting"),
    ("02-14", "ValentinesDay", "Cultural"),
    ("03-17", "StPatricksDay", "Cultural"),
    ("04-05", "Easter", "Cultural"),
    ("05-25", "MemorialDay", "National"),
    ("07-04", "IndependenceDay", "National"),
    ("09-07", "LaborDay", "National"),
    ("10-31", "Halloween", "Cultural"),
    ("11-26", "Thanksgiving", "National"),
    ("12-25", "Christmas", "National"),
    ("12-31", "NewYearsEve", "Cultural"),
]
# SNAP benefit days of the month, by state
SNAP_DAYS = {
    "CA": [1, 2, 3, 5, 6, 7, 9, 10],
    "TX": [1, 3, 5, 6, 7, 9, 10, 11],
    "WI": [2, 3, 5, 8, 9, 11, 12],
}
SNAP_STATES = ["CA", "TX", "WI"]
# ---------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def wm_yr_wk(date_col) -> Column:
    """Retail week code: '1' || last two digits of the ISO year || ISO week (2 digits)."""
    d = _c(date_col)
    iso_year = F.extract(F.lit("YEAROFWEEK"), d).cast("string")
    return F.concat(F.lit("1"), F.substring(iso_year, 3, 2),
                    F.lpad(F.weekofyear(d).cast("string"), 2, "0")).cast("int")


def wday(date_col) -> Column:
    """Weekday number with Sunday = 1 ... Saturday = 7 (ISO weekday % 7 + 1)."""
    return F.dayofweek(_c(date_col))


def weekday_name(date_col) -> Column:
    return F.date_format(_c(date_col), "EEEE")


def _holiday_map(idx: int) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(h[0]), F.lit(h[idx])) for h in HOLIDAYS))


def holiday_name(date_col) -> Column:
    return F.try_element_at(_holiday_map(1), F.date_format(_c(date_col), "MM-dd"))


def holiday_type(date_col) -> Column:
    return F.try_element_at(_holiday_map(2), F.date_format(_c(date_col), "MM-dd"))


def snap_flag(date_col, state: str) -> Column:
    return F.when(F.dayofmonth(_c(date_col)).isin(SNAP_DAYS[state]), 1).otherwise(0)


def weekday_mon0(date_col) -> Column:
    """Day of week with Monday = 0 ... Sunday = 6 (pandas ``dayofweek``)."""
    return F.weekday(_c(date_col))
