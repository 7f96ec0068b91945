"""N: stateful jobs as streams over files, drained once; their twins are the batch results."""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.crosssection import shared_folder
from ..functions.timeseries import busdays
from ..operators import regime as rg
from ..streaming import jobs
from .regime import RULES, market, regimes, stable_regimes
from .registry import plan

C = F.col


def folder(p, name):
    return f"{shared_folder(p.spark)}/streams/{name}-{uuid.uuid4().hex}"


def delivered(p, df, path, parts):
    """The rows in files that arrive one after the other, in date order, each with some rows of the one before again."""
    df = df.withColumn("_part", F.ntile(parts).over(Window.partitionBy(F.lit(0)).orderBy("date"))) if "_part" not in df.columns else df
    for k in range(1, parts + 1):
        df.where(C("_part").between(k - 1, k)).drop("_part").coalesce(1).write.mode("append").parquet(path)


def by_date(p, df, parts):
    """Adds the number of the delivery of each date, all rows of a date in one."""
    w = Window.partitionBy(F.lit(0)).orderBy("date")  # one row per date
    cal = df.select("date").distinct().withColumn("_part", F.ntile(parts).over(w))
    return df.join(cal, "date")


def files(p, path, like):
    return p.spark.readStream.schema(like.schema).option("maxFilesPerTrigger", 1).parquet(path)


@plan("n01_regime_state", "SELECT date, cur AS regime, pending FROM hyst_p QUALIFY row_number() OVER (ORDER BY date DESC) = 1")
def _(p):
    """The state after the whole history: a third of it folded in batch, the rest as a stream that goes on from there."""
    m = market(p)
    raw = regimes(p).select("market", "date", "regime").join(rg.transition_flags(m, RULES).select("market", "date", *rg.FLAGS), ["market", "date"])
    raw = p.shared("regime_inputs", lambda: by_date(p, raw, 3))
    root = folder(p, "regime")
    known = rg.hysteresis(raw.where("_part = 1").drop("_part"))
    last = known.groupBy("market").agg(F.max("date").alias("date"), F.max_by("regime", "date").alias("regime"), F.max_by("pending", "date").alias("pending"))
    last.write.parquet(f"{root}/initial")
    delivered(p, raw.where("_part > 1"), f"{root}/in", 3)
    initial, plain = p.spark.read.parquet(f"{root}/initial"), raw.drop("_part")
    jobs.drained(p.spark, lambda: jobs.regime_stream(files(p, f"{root}/in", plain), initial), f"{root}/out", f"{root}/checkpoint")
    out = p.spark.read.parquet(f"{root}/out").groupBy("market").agg(F.max("date").alias("date"), F.max_by("regime", "date").alias("regime"), F.max_by("pending", "date").alias("pending"))
    return out.drop("market")


CUM = lambda d: f"(floor(datediff('day', DATE '1970-01-05', {d}) / 7) * 5 + least(((datediff('day', DATE '1970-01-05', {d}) % 7) + 7) % 7, 5))"


@plan("n02_data_freshness_sentinel", f"SELECT date, n, n < 15 AS phantom, ({CUM('date')} - {CUM('pd')})::DOUBLE AS bdays_since_previous FROM (SELECT date, n, lag(date) OVER (ORDER BY date) AS pd FROM (SELECT date, count(*) AS n FROM bars_d GROUP BY 1))", "bdays_since_previous")
def _(p):
    d = p.bars_daily().groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(F.lit(0)).orderBy("date")  # one row per date
    return d.select("date", "n", (C("n") < 15).alias("phantom"), busdays(F.lag("date").over(w), C("date")).cast("double").alias("bdays_since_previous"))


@plan("n03_daily_snapshots", "SELECT portfolio, date, capital, daily_return_pct, cum_return_pct FROM alpha_p", "capital:3 daily_return_pct cum_return_pct")
def _(p):
    """Capital as it comes in, returns from the kept values, upserted by portfolio and date."""
    root = folder(p, "snapshots")
    capital = by_date(p, p.snapshots(), 2)
    delivered(p, capital, f"{root}/in", 2)
    sink = jobs.upsert_sink(f"{root}/out", ["portfolio", "date"], stream="daily")
    jobs.drained(p.spark, lambda: jobs.snapshot_stream(files(p, f"{root}/in", capital.drop("_part"))), sink, f"{root}/checkpoint")
    return p.spark.read.parquet(f"{root}/out").select("portfolio", C("date").cast("date").alias("date"), "capital", "daily_return_pct", "cum_return_pct")


@plan("n04_continuous_alerts", """SELECT * FROM (SELECT date, symbol, event_type, n, avg(n) OVER (PARTITION BY symbol, event_type ORDER BY date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS avg_n FROM (SELECT ts::DATE AS date, user_id AS symbol, event_type, count(*) AS n FROM events GROUP BY 1, 2, 3)
  WHERE date + 1 <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY) WHERE avg_n > 0 AND n >= avg_n * 2""", "avg_n")
def _(p):
    """Two streams: events to days closed by the watermark, closed days to alerts from each name's last ten in state."""
    root = folder(p, "alerts")
    events = p.table("events")
    days = lambda: jobs.daily_activity(p.spark.readStream.schema(events.schema).parquet(f"{p.root}/events.parque[t]"))  # as a pattern, the table may be a file or a folder
    jobs.drained(p.spark, days, f"{root}/days", f"{root}/checkpoint-days")
    closed = p.spark.read.parquet(f"{root}/days")
    jobs.drained(p.spark, lambda: jobs.spike_stream(p.spark.readStream.schema(closed.schema).parquet(f"{root}/days")), f"{root}/out", f"{root}/checkpoint-alerts")
    return p.spark.read.parquet(f"{root}/out").select("date", "symbol", "event_type", "n", "avg_n")
