"""Data-quality checks; every check returns issue rows, nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import DATE, SYMBOL, symbol_window
from ..functions.timeseries import busdays

W = symbol_window


def missing_days(bars: DataFrame, gap: int = 5) -> DataFrame:
    """L1: business-day gaps between consecutive bars."""
    d = bars.select(SYMBOL, F.lag(DATE).over(W()).alias("from_date"), F.col(DATE).alias("to_date"))
    d = d.withColumn("gap", busdays("from_date", "to_date") - 1)
    return d.where(F.col("gap") >= gap)


def islands(df: DataFrame, new: Column, key=SYMBOL, order: str = DATE) -> DataFrame:
    """Number the runs: ``new`` marks the first row of each run."""
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_start", F.when(F.coalesce(new, F.lit(True)), 1).otherwise(0)).withColumn("_isl", F.sum("_start").over(w)).drop("_start")


def zero_volume(bars: DataFrame, quiet: Column, long_run: int = 3) -> DataFrame:
    """L2: islands of quiet rows at most one business day apart; long ones are errors."""
    d = bars.where(quiet).select(SYMBOL, DATE)
    d = islands(d, busdays(F.lag(DATE).over(W()), DATE) > 1)
    g = d.groupBy(SYMBOL, "_isl").agg(F.min(DATE).alias("start"), F.max(DATE).alias("end"), F.count(F.lit(1)).alias("days"))
    return g.drop("_isl").withColumn("severity", F.when(F.col("days") >= long_run, "error").otherwise("warning"))


def limit_streaks(bars: DataFrame, pct: float = 9.5, run: int = 5) -> DataFrame:
    """L3: runs of consecutive moves beyond the limit, per direction."""
    p = F.lag("close").over(W())
    r = (F.col("close") / F.when(p != 0, p) - 1) * 100
    d = bars.select(SYMBOL, DATE, F.when(r >= pct, "up").when(r <= -pct, "down").otherwise("none").alias("direction"))
    d = islands(d, F.lag("direction").over(W()) != F.col("direction"))
    g = d.groupBy(SYMBOL, "_isl", "direction").agg(F.min(DATE).alias("start"), F.max(DATE).alias("end"), F.count(F.lit(1)).alias("days"))
    return g.where((F.col("direction") != "none") & (F.col("days") >= run)).drop("_isl")


def price_anomalies(bars: DataFrame) -> DataFrame:
    """L4: one issue row per violated price rule."""
    c = F.col
    bad_hl = c("high") < c("low")
    rules = [
        F.when(bad_hl, "high_lt_low"),
        F.when(~bad_hl & ((c("close") > c("high")) | (c("close") < c("low"))), "close_out_of_range"),
        *[F.when(c(x) <= 0, f"non_positive_{x}") for x in ("open", "high", "low", "close")],
    ]
    issues = F.filter(F.array(*rules), lambda x: x.isNotNull())
    return bars.select(SYMBOL, DATE, F.explode(issues).alias("issue"))


def max_dates(tables: dict[str, DataFrame]) -> DataFrame:
    """(symbol, table, max_date) of several panels."""
    out = None
    for name, df in tables.items():
        d = df.groupBy(SYMBOL).agg(F.max(DATE).alias("max_date")).withColumn("table_name", F.lit(name))
        out = d if out is None else out.unionByName(d)
    return out


def range_consistency(base: DataFrame, tables: dict[str, DataFrame], days: int = 30) -> DataFrame:
    """Panels whose last date is far from the last bar of the symbol."""
    b = base.groupBy(SYMBOL).agg(F.max(DATE).alias("base_max"))
    d = max_dates(tables).join(b, SYMBOL).withColumn("diff_days", F.abs(F.datediff("base_max", "max_date")).cast("long"))
    return d.where(F.col("diff_days") > days)


def freshness(tables: dict[str, DataFrame], reference: Column, days: int = 7) -> DataFrame:
    """Business days between the last date of each table and the reference date."""
    d = max_dates(tables).groupBy("table_name").agg(F.max("max_date").alias("max_date"))
    d = d.withColumn("bdays_behind", busdays("max_date", reference))
    return d.where(F.col("max_date").isNull() | (F.col("bdays_behind") > days))


def stale_symbols(bars: DataFrame, reference: Column, days: int = 3) -> DataFrame:
    """L7."""
    d = bars.groupBy(SYMBOL).agg(F.max(DATE).alias("max_date"))
    return d.withColumn("bdays_behind", busdays("max_date", reference)).where(F.col("bdays_behind") > days)


def valid_ohlcv() -> Column:
    """Rows that may enter the store (missing range or volume passes)."""
    c = F.col
    ok = lambda cond: F.coalesce(cond, F.lit(True))
    return (
        F.coalesce(c("close") > 0, F.lit(False))
        & ok(c("high") >= c("low"))
        & ok(c("close") <= c("high"))
        & ok(c("close") >= c("low"))
        & ok(c("volume") >= 0)
    )


def price_jumps(batch: DataFrame, history: DataFrame, threshold: float = 0.11) -> DataFrame:
    """Moves of a new batch against the previous close, taken from history if needed."""
    u = batch.select(SYMBOL, DATE, "close", F.lit(True).alias("_new"))
    u = u.unionByName(history.select(SYMBOL, DATE, "close", F.lit(False).alias("_new")))
    p = F.lag("close").over(W())
    u = u.withColumn("jump", F.col("close") / F.when(p > 0, p) - 1)
    return u.where(F.col("_new") & (F.abs("jump") > threshold)).drop("_new")


def coverage(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows, distinct symbols and date range per table."""
    out = None
    for name, df in tables.items():
        d = df.agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.countDistinct(SYMBOL).alias("n_symbols"),
            F.min(DATE).alias("min_date"),
            F.max(DATE).alias("max_date"),
        ).withColumn("table_name", F.lit(name))
        out = d if out is None else out.unionByName(d)
    return out
