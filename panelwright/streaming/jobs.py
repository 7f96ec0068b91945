"""Stateful and incremental jobs: regime state, daily alerts, snapshots, freshness.

Every job is written against a streaming DataFrame, restarts from its checkpoint, and writes
idempotently (keyed by date), so a lost executor or a replayed batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.regime import FLAGS, step
from ..sources.tables import insert_update, write_partitions

C = F.col


def checkpoint_dir(spark: SparkSession, name: str, fallback: str | None = None) -> str:
    """Shared folder of the cluster; ``fallback`` only where the session names none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or fallback
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root.rstrip('/')}/{name}"


def regime_state(states: DataFrame) -> DataFrame:
    """Hysteresis as keyed state.

    Input rows: market, date, regime (raw) and the transition flags.  The state of a market is
    (last date, regime, pending count); dates at or before the last one are ignored.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, cur, pending = state.get if state.exists else (None, None, 0)
        rows = pd.concat(list(batches)).sort_values("date")  # new dates of one market
        out = []
        for r in rows.to_dict("records"):
            d = str(r["date"])
            if last is not None and d <= last:
                continue
            cur, pending = step(cur, pending, r["regime"], r)
            last = d
            out.append((key[0], r["date"], r["regime"], cur, pending))
        state.update((last, cur, pending))
        yield pd.DataFrame(out, columns=["market", "date", "raw_regime", "regime", "pending"])

    cols = states.select("market", "date", "regime", *FLAGS)
    return cols.groupBy("market").applyInPandasWithState(
        fold,
        "market string, date date, raw_regime string, regime string, pending long",
        "last string, regime string, pending long",
        "append",
        GroupStateTimeout.NoTimeout,
    )


class _Regime(StatefulProcessor):
    """One market: its last date, regime and pending count."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("regime", "last date, regime string, pending long")

    def handleInitialState(self, key: tuple, initial: pd.DataFrame, timers: object) -> None:
        r = initial.iloc[-1]
        self.state.update((r["date"], r["regime"], int(r["pending"])))

    def handleInputRows(self, key: tuple, batches: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        last, now, pending = self.state.get() if self.state.exists() else (None, None, 0)
        out = []
        for r in pd.concat(list(batches)).sort_values("date").to_dict("records"):
            if last is None or r["date"] > last:
                now, pending = step(now, pending, r["regime"], r)
                last = r["date"]
                out.append((key[0], last, r["regime"], now, pending))
        self.state.update((last, now, pending))
        yield pd.DataFrame(out, columns=["market", "date", "raw_regime", "regime", "pending"])


def regime_stream(states: DataFrame, initial: DataFrame) -> DataFrame:
    """N1 that goes on from batch results: ``initial`` has market, date, regime and pending of each market's last known date.

    Rows of dates up to the last one are ignored, so what was delivered before changes nothing.
    """
    cols = states.select("market", "date", "regime", *FLAGS).groupBy("market")
    return cols.transformWithStateInPandas(
        _Regime(), "market string, date date, raw_regime string, regime string, pending long", "append", "none",
        initial.select("market", "date", "regime", "pending").groupBy("market"))


class _RecentDays(StatefulProcessor):
    """One (symbol, type): the counts of its last closed days, and the last of them."""

    def __init__(self, factor: float, rows: int) -> None:
        self.factor, self.rows = factor, rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("days", "last date, counts array<long>")

    def handleInputRows(self, key: tuple, batches: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        last, counts = self.state.get() if self.state.exists() else (None, [])
        counts, out = list(counts), []
        for r in pd.concat(list(batches)).sort_values("date").to_dict("records"):
            if last is not None and r["date"] <= last:
                continue  # a day that was closed before: sent again, or late
            mean = sum(counts) / len(counts) if counts else 0.0
            if mean > 0 and r["n"] >= mean * self.factor:
                out.append((r["date"], *key, int(r["n"]), mean))
            last, counts = r["date"], [*counts, int(r["n"])][-self.rows :]
        self.state.update((last, counts))
        yield pd.DataFrame(out, columns=["date", "symbol", "event_type", "n", "avg_n"])


def spike_stream(days: DataFrame, factor: float = 2.0, rows: int = 10) -> DataFrame:
    """Alerts on a stream of closed days (date, symbol, event_type, n), from each name's last days in state alone.

    A day that comes after a later one of its name, or again, is ignored.
    """
    cols = days.select("date", "symbol", "event_type", "n").groupBy("symbol", "event_type")
    return cols.transformWithStateInPandas(_RecentDays(factor, rows), "date date, symbol long, event_type string, n long, avg_n double", "append", "none")


class _Equity(StatefulProcessor):
    """One portfolio: its last date, its capital then and its first capital."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("equity", "last date, capital double, first double")

    def handleInputRows(self, key: tuple, batches: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        last, capital, first = self.state.get() if self.state.exists() else (None, None, None)
        out = []
        for r in pd.concat(list(batches)).sort_values("date").to_dict("records"):
            if last is not None and r["date"] <= last:
                continue
            now = float(r["capital"])
            first = now if first is None else first
            out.append((key[0], r["date"], now, None if not capital else now / capital - 1, now / first - 1 if first else None))
            last, capital = r["date"], now
        self.state.update((last, capital, first))
        yield pd.DataFrame(out, columns=["portfolio", "date", "capital", "daily_return_pct", "cum_return_pct"])


def snapshot_stream(capital: DataFrame) -> DataFrame:
    """Daily and cumulative returns of (portfolio, date, capital), against the values kept in state."""
    cols = capital.select("portfolio", "date", "capital").groupBy("portfolio")
    return cols.transformWithStateInPandas(_Equity(), "portfolio long, date date, capital double, daily_return_pct double, cum_return_pct double", "append", "none")


STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def drained(spark: SparkSession, start: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None] | str, checkpoint: str) -> None:
    """Run a stream over all files that are there, into a folder or a batch writer, with state in RocksDB."""
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        w = start().writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
        q = w.format("parquet").start(sink) if isinstance(sink, str) else w.foreachBatch(sink).start()
        q.awaitTermination()
    finally:
        spark.conf.set(STORE[0], before) if before else spark.conf.unset(STORE[0])


def daily_activity(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Event counts per (symbol, type, day), emitted once the watermark passes the day."""
    e = events.select(C("ts").cast("timestamp").alias("ts"), C("user_id").alias("symbol"), "event_type", "value")
    return (
        e.withWatermark("ts", lateness)
        .groupBy(F.window("ts", "1 day"), "symbol", "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
        .select(C("window.start").cast("date").alias("date"), "symbol", "event_type", "n", "value")
    )


def spikes(daily: DataFrame, factor: float = 2.0, rows: int = 10) -> DataFrame:
    """Alerts: a day's count against the mean of the symbol's earlier days (one row per day)."""
    w = Window.partitionBy("symbol", "event_type").orderBy("date").rowsBetween(-rows, -1)
    d = daily.withColumn("avg_n", F.avg("n").over(w))
    return d.where((C("avg_n") > 0) & (C("n") >= C("avg_n") * factor))


def alert_sink(history: str, alerts: str, factor: float = 2.0, rows: int = 10) -> Callable[[DataFrame, int], None]:
    """N4 as a stream: each batch of closed days is added to the stored ones, whose spikes on the batch's days are written.

    Both tables are keyed, so a replayed batch changes nothing.
    """
    keys = ["date", "symbol", "event_type"]
    store, emit = upsert_sink(history, keys), upsert_sink(alerts, keys)

    def write(batch: DataFrame, epoch: int) -> None:
        if batch.isEmpty():
            return
        store(batch, epoch)
        names = batch.select("symbol", "event_type").distinct()
        known = batch.sparkSession.read.parquet(history).select(*batch.columns).join(names, ["symbol", "event_type"], "left_semi")
        emit(spikes(known, factor, rows).join(batch.select("date").distinct(), "date", "left_semi"), epoch)

    return write


def upsert_sink(path: str, keys: list[str], by: str = "date", order: str | None = None, stream: str | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer that upserts by key.

    With ``stream``, a name that is the checkpoint's own, an epoch that was written whole leaves a marker, and its replay
    is skipped. The epoch's folder goes once its partitions are in place.

    The partitions that a batch touches are read, merged with it (its last row by ``order`` wins) and written to a
    folder of the epoch; then they replace the old ones.  A batch that is replayed gives the same table, and rows of
    the same date from other batches stay.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        if batch.isEmpty():
            return
        columns = [c for c in batch.columns if c != order]
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
        marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}_commits/{stream}/{epoch}") if stream else None
        if marker and fs.exists(marker):
            return
        if fs.exists(target):
            kind = batch.schema[by].dataType
            old = spark.read.parquet(path).withColumn(by, C(by).cast(kind)).join(batch.select(by).distinct(), by, "left_semi").select(*columns)
        else:
            old = batch.select(*columns).limit(0)
        staged = f"{path.rstrip('/')}_epochs/{epoch}"
        insert_update(old, batch, keys, columns, order).write.mode("overwrite").parquet(staged)
        write_partitions(spark.read.parquet(staged), path, by)
        if marker:
            fs.create(marker, True).close()
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(staged), True)

    return write


def freshness_sink(reference: str, limit_days: int, alert: Callable[[list], None], min_rows: int = 1) -> Callable[[DataFrame, int], None]:
    """Per batch, newest date, staleness and phantom days (dates with too few rows)."""

    def check(batch: DataFrame, _epoch: int) -> None:
        per = batch.groupBy("date").agg(F.count(F.lit(1)).alias("n"))
        row = per.agg(F.max("date").alias("last"), F.count_if(C("n") < min_rows).alias("phantom")).withColumn("age", F.datediff(F.lit(reference).cast("date"), "last"))
        got = row.first()  # one row
        if got["last"] is not None and (got["age"] > limit_days or got["phantom"] > 0):
            alert([got.asDict()])

    return check


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Drain a file source once into Parquet."""
    q = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).format("parquet").trigger(availableNow=True).start(path)
    q.awaitTermination()
