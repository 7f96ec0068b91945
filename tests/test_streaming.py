import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from panelwright.operators import regime as rg
from panelwright.plans.regime import RULES, market
from panelwright.sources.panels import Panels
from panelwright.streaming import jobs

from .conftest import SF


def raw_states(spark):
    m = market(Panels(spark, SF))
    d = rg.detect(m, None, RULES).select("market", "date", "regime")
    return d.join(rg.transition_flags(m, RULES).select("market", "date", *rg.FLAGS), ["market", "date"])


def test_regime_stream_equals_batch_fold(spark, tmp_path):
    src = tmp_path / "in"
    pdf = raw_states(spark).toPandas().sort_values("date")
    schema = raw_states(spark).schema
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    cuts = [0, 100, 101, 250, len(pdf)]
    for a, b in zip(cuts, cuts[1:]):
        # rows that were delivered before are sent again and must be ignored
        part = pdf.iloc[max(0, a - 5) : b]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(schema).parquet(str(src))
        jobs.run_available(jobs.regime_state(stream), out, ck)
    got = spark.read.parquet(out).orderBy("date").toPandas()
    want = rg.hysteresis(spark.createDataFrame(pdf, schema)).orderBy("date").toPandas()
    pd.testing.assert_frame_equal(got[["date", "regime", "pending"]], want[["date", "regime", "pending"]])


def test_daily_activity_stream_equals_batch_for_closed_days(spark, tmp_path):
    ev = Panels(spark, SF).table("events")
    src = str(tmp_path / "ev")
    ev.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(ev.schema).parquet(src)
    out = str(tmp_path / "out")
    jobs.run_available(jobs.daily_activity(stream), out, str(tmp_path / "ck"))
    got = spark.read.parquet(out).select("date", "symbol", "event_type", "n")
    last = ev.agg(F.max(F.col("ts").cast("date")).alias("d")).first()["d"]
    want = jobs.daily_activity(ev).select("date", "symbol", "event_type", "n")
    # the watermark trails the newest event by one day, so the last two days stay open
    closed = F.col("date") < F.lit(last - dt.timedelta(days=1))
    assert got.where(closed).exceptAll(want).count() == 0
    assert want.where(closed).exceptAll(got).count() == 0


def test_snapshot_sink_keeps_other_batches_of_a_date(spark, tmp_path):
    path = str(tmp_path / "snap")
    schema = "portfolio int, date date, capital double, version int"
    day = dt.date(2024, 1, 1)
    first = spark.createDataFrame([(1, day, 5.0, 1), (1, day, 6.0, 2), (1, dt.date(2024, 1, 2), 7.0, 1)], schema)
    second = spark.createDataFrame([(2, day, 8.0, 1), (3, day, float("nan"), 1)], schema)
    write = jobs.upsert_sink(path, ["portfolio", "date"], order="version")
    for epoch, batch in ((0, first), (1, second), (1, second), (2, first.limit(0))):
        write(batch, epoch)
    got = {(r.portfolio, r.date.day): r.capital for r in spark.read.parquet(path).collect()}
    assert got == {(1, 1): 6.0, (1, 2): 7.0, (2, 1): 8.0, (3, 1): None}
    write(first, 0)
    assert spark.read.parquet(path).count() == 4


def test_alerts_on_a_stream_of_days(spark, tmp_path):
    rows = [(dt.date(2024, 1, d), 7, "view", 30 if d == 9 else 10, 1.0) for d in range(1, 12)]
    schema = "date date, symbol long, event_type string, n long, value double"
    write = jobs.alert_sink(str(tmp_path / "days"), str(tmp_path / "alerts"))
    for epoch, (a, b) in enumerate(((0, 4), (4, 8), (8, 11), (8, 11))):
        write(spark.createDataFrame(rows[a:b], schema), epoch)
    got = spark.read.parquet(str(tmp_path / "alerts")).collect()
    assert [(r.date.day, r.n, r.avg_n) for r in got] == [(9, 30, 10.0)]
    want = jobs.spikes(spark.createDataFrame(rows, schema)).collect()
    assert [(r.date.day, r.n) for r in want] == [(9, 30)]


def test_freshness_sink_alerts(spark):
    seen = []
    df = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 1, 1),)], "date date")
    jobs.freshness_sink("2024-01-20", 7, seen.extend)(df, 0)
    jobs.freshness_sink("2024-01-03", 7, seen.extend)(df, 1)
    assert [r["age"] for r in seen] == [19]


def test_checkpoint_dir_reads_the_session(spark):
    assert jobs.checkpoint_dir(spark, "x", "/tmp/f").endswith("/x")


def files_of(spark, path, schema):
    return lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def add(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_regime_stream_goes_on_from_batch_and_from_its_checkpoint(spark, tmp_path):
    states = raw_states(spark)
    pdf, schema = states.toPandas().sort_values("date"), states.schema
    want = rg.hysteresis(spark.createDataFrame(pdf, schema)).orderBy("date").toPandas()
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    initial = spark.createDataFrame(want[["market", "date", "regime", "pending"]].iloc[119:120])
    cuts = [120, 200, len(pdf)]
    for a, b in zip(cuts, cuts[1:]):
        add(spark, pdf.iloc[a - 30 : b], schema, src)  # dates that are known already come again
        jobs.drained(spark, lambda: jobs.regime_stream(files_of(spark, src, schema)(), initial), out, ck)
    jobs.drained(spark, lambda: jobs.regime_stream(files_of(spark, src, schema)(), initial), out, ck)
    got = spark.read.parquet(out).orderBy("date").toPandas()
    pd.testing.assert_frame_equal(got[["date", "raw_regime", "regime", "pending"]], want[["date", "raw_regime", "regime", "pending"]].iloc[120:].reset_index(drop=True))


def test_alert_state_holds_the_last_ten_days(spark, tmp_path):
    counts = [10, 30, 10, 10, 10, 10, 10, 10, 10, 10, 10, 10, 24, 10, 60]
    schema = "date date, symbol long, event_type string, n long"
    rows = [(dt.date(2024, 1, 1 + k), s, "view", n * s) for k, n in enumerate(counts) for s in (1, 2)]
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for a, b in ((0, 9), (6, 20), (14, 30)):
        add(spark, rows[a:b], schema, src)
        jobs.drained(spark, lambda: jobs.spike_stream(files_of(spark, src, schema)()), out, ck)
    add(spark, [(dt.date(2024, 1, 3), 1, "view", 999)], schema, src)  # a day that was closed long ago
    jobs.drained(spark, lambda: jobs.spike_stream(files_of(spark, src, schema)()), out, ck)
    want = jobs.spikes(spark.createDataFrame(rows, schema)).select("date", "symbol", "event_type", "n", "avg_n")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(spark.read.parquet(out)) == key(want) and want.count() == 6


def test_snapshots_survive_a_restart_and_a_stop_between_writes(spark, tmp_path, monkeypatch):
    schema = "portfolio long, date date, capital double"
    rows = [(p, dt.date(2024, 1, 1 + k), 100.0 * p + k * k) for k in range(6) for p in (1, 2)]
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    add(spark, rows[:6], schema, src)
    stream = lambda: jobs.snapshot_stream(files_of(spark, src, schema)())
    sink = jobs.upsert_sink(out, ["portfolio", "date"], stream="one")
    real, stop = jobs.write_partitions, []

    def once(*a, **k):
        if not stop:
            stop.append(1)
            raise RuntimeError("stopped between the two writes")
        return real(*a, **k)

    monkeypatch.setattr(jobs, "write_partitions", once)
    try:
        jobs.drained(spark, stream, sink, ck)
    except Exception as e:
        assert "stopped between" in str(e)
    assert stop
    jobs.drained(spark, stream, sink, ck)
    add(spark, rows[4:], schema, src)
    jobs.drained(spark, stream, sink, ck)
    jobs.drained(spark, stream, sink, ck)
    got = {(r.portfolio, r.date.day - 1): (r.capital, r.daily_return_pct, r.cum_return_pct) for r in spark.read.parquet(out).collect()}
    at = lambda p, k: 100.0 * p + k * k
    assert got == {(p, k): (at(p, k), None if k == 0 else at(p, k) / at(p, k - 1) - 1, at(p, k) / at(p, 0) - 1) for p in (1, 2) for k in range(6)}
    assert not list((tmp_path / "out_epochs").glob("*")) and len([x for x in (tmp_path / "out_commits" / "one").iterdir() if x.suffix != ".crc"]) == 2


def test_a_marked_epoch_is_not_written_again(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "portfolio int, date date, capital double"
    write = jobs.upsert_sink(path, ["portfolio", "date"], stream="s")
    write(spark.createDataFrame([(1, dt.date(2024, 1, 1), 5.0)], schema), 0)
    write(spark.createDataFrame([(1, dt.date(2024, 1, 1), 9.0)], schema), 0)
    assert [r.capital for r in spark.read.parquet(path).collect()] == [5.0]
    jobs.upsert_sink(path, ["portfolio", "date"], stream="other")(spark.createDataFrame([(1, dt.date(2024, 1, 1), 9.0)], schema), 0)
    assert [r.capital for r in spark.read.parquet(path).collect()] == [9.0]
