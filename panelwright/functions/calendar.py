"""Trading calendars and publication-lag rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exprs import col


def ordinals(dates: DataFrame, start: int = 1) -> DataFrame:
    """(date, ordinal) in ascending order; one row per date, so the size is bounded by time."""
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    return dates.select("date", (F.row_number().over(w) - 1 + start).cast("long").alias("ordinal"))


def latest_ordinals(dates: DataFrame) -> DataFrame:
    """(date, ordinal) counted back from the latest date (0)."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("date"))
    return dates.select("date", (F.row_number().over(w) - 1).cast("long").alias("ordinal"))


def is_weekday(d) -> Column:
    return F.weekday(col(d)) < 5


def trading_days(start, end, spine: DataFrame, holidays: DataFrame) -> DataFrame:
    """Weekdays of [start, end] per row of ``spine`` without the holidays."""
    days = spine.select(F.explode(F.sequence(col(start), col(end))).alias("date")).distinct()
    return days.where(is_weekday("date")).join(holidays.select("date"), "date", "left_anti")


def revenue_visible_cutoff(as_of) -> Column:
    """Last month end whose revenue is public (published by the 10th of the next month)."""
    d = col(as_of)
    return F.last_day(F.add_months(d, F.when(F.dayofmonth(d) >= 10, F.lit(-1)).otherwise(F.lit(-2))))


def quarter_publish_deadline(year, quarter) -> Column:
    """Quarter end + 45 days, + 90 days for the fourth quarter."""
    y, q = col(year).cast("int"), col(quarter).cast("int")
    end = F.last_day(F.make_date(y, q * 3, F.lit(1)))
    return F.date_add(end, F.when(q == 4, F.lit(90)).otherwise(F.lit(45)))


def financial_visible_cutoff(as_of) -> Column:
    """Latest quarter end whose publication deadline has passed.

    Only the four quarter ends before ``as_of`` can qualify, so the rule is a closed CASE.
    """
    d = col(as_of)
    out = None
    for back in range(1, 5):
        start = F.trunc(F.add_months(d, -3 * back), "quarter")
        end = F.last_day(F.add_months(start, 2))
        due = F.date_add(end, F.when(F.quarter(end) == 4, F.lit(90)).otherwise(F.lit(45)))
        out = F.when(due <= d, end) if out is None else out.when(due <= d, end)
    return out
