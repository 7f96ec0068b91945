import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.functions.crosssection import CrossSection
from panelwright.operators import flows as fl
from panelwright.operators import ml
from panelwright.operators import quality as q
from panelwright.operators import ranking as rk
from panelwright.operators import regime as rg
from panelwright.operators import research as rs
from panelwright.operators import risk

XS = CrossSection()
D = dt.date


def test_hysteresis_rules():
    ok = {k: True for k in rg.FLAGS}
    no = {k: False for k in rg.FLAGS}
    assert rg.step(None, 0, "bull", ok) == ("bull", 0)
    assert rg.step("bull", 0, "crisis", no) == ("crisis", 0)
    assert rg.step("bull", 0, "sideways", ok) == ("sideways", 0)
    assert rg.step("sideways", 0, "bull", ok) == ("sideways", 1)
    assert rg.step("sideways", 2, "bull", ok) == ("bull", 0)
    assert rg.step("sideways", 2, "bull", no) == ("sideways", 0)
    assert rg.step("bull", 1, "bear", no) == ("bear", 0)  # unregulated pair: two days


def test_ledger_against_a_loop(spark):
    rng = np.random.default_rng(5)
    rows = []
    for s in range(3):
        for b in range(4):
            for i in range(30):
                rows.append((s, D(2024, 1, 1) + dt.timedelta(days=i), b, float(rng.integers(0, 50)), float(rng.integers(0, 50)), float(rng.uniform(90, 110)), float(rng.uniform(90, 110))))
    df = spark.createDataFrame(rows, "symbol int, date date, broker int, buy double, sell double, buy_price double, sell_price double")
    got = {(r.symbol, r.broker): r for r in fl.broker_ledger(df.repartition(5)).collect()}
    for key in got:
        cost = pos = gain = loss = 0.0
        wins = sells = 0
        for r in sorted(x for x in rows if (x[0], x[2]) == key):
            _, _, _, bq, sq, bp, sp = r
            if bq > 0:
                cost, pos = (cost * pos + bp * bq) / (pos + bq), pos + bq
            if sq > 0 and cost > 0:
                sells += 1
                pnl = (sp - cost) * sq
                wins, gain, loss = wins + (pnl > 0), gain + max(pnl, 0), loss + max(-pnl, 0)
                pos = max(0.0, pos - sq)
        g = got[key]
        assert g.sell_events == sells and g.win_rate == pytest.approx(wins / sells)
        assert g.hist_pnl == pytest.approx(gain - loss) and g.net_position == pytest.approx(pos)


def test_longest_runs_across_days(spark):
    pnl = [1, 1, -1, 1, 1, 1, 1, -1, -1, -1, 0, -1, 1]
    days = [1, 1, 1, 1, 2, 2, 3, 3, 3, 4, 4, 4, 5]
    rows = [(1, i, D(2024, 1, d), D(2024, 2, 1), 10.0, 10.0 + p, 1.0, "x") for i, (p, d) in enumerate(zip(pnl, days))]
    df = spark.createDataFrame(rows, "portfolio int, trade_id int, entry_date date, exit_date date, entry_price double, exit_price double, shares double, exit_reason string")
    r = risk.trade_stats(df.repartition(3), "portfolio").first()
    assert (r.max_consecutive_wins, r.max_consecutive_losses) == (4, 3)


def test_bootstrap_is_reproducible_and_centred(spark):
    df = spark.range(400).select(F.lit(1).alias("portfolio"), F.col("id").alias("trade_id"), F.when(F.col("id") % 2 == 0, 0.02).otherwise(-0.01).alias("return_pct"))
    a, b = (risk.bootstrap(df.repartition(k), "portfolio", 300).first() for k in (1, 6))
    assert a.p50 == pytest.approx(b.p50) and a.p5 < a.p50 < a.p95
    assert a.p50 == pytest.approx((1.02**200) * (0.99**200) - 1, rel=0.25)


def test_diversify_equals_the_walk(spark):
    rng = np.random.default_rng(2)
    sectors = rng.choice(["a", "b", "c"], 60, p=[0.7, 0.2, 0.1])
    df = spark.createDataFrame([(1, i + 1, str(s)) for i, s in enumerate(sectors)], "date int, pool_rank int, industry string")
    got = [r.pool_rank for r in rk.diversify(df, ["date"], 20).orderBy("rank").collect()]
    kept, count = [], {}
    for i, s in enumerate(sectors[:40], 1):
        if count.get(s, 0) < 5 and len(kept) < 20:
            kept.append(i)
            count[s] = count.get(s, 0) + 1
    assert got == kept


def test_forward_returns_by_definition(spark):
    bars = [(1, D(2024, 1, 1) + dt.timedelta(days=2 * i), 100.0 + i) for i in range(12)]
    b = spark.createDataFrame(bars, "symbol int, date date, close double")
    p = spark.createDataFrame([(1, D(2024, 1, 1) + dt.timedelta(days=k), 100.0) for k in range(20)], "symbol int, date date, close double")
    for r in rs.forward_returns(p, b, (3,)).collect():
        future = [x for x in bars if x[1] > r.date]
        want = future[2][2] / 100 - 1 if len(future) >= 3 else None
        assert r.fwd_3 == (pytest.approx(want) if want is not None else None)


def test_ic_of_a_perfect_factor(spark):
    rows = [(d, s, float(s), float(s) * 2 + d, -float(s)) for d in range(5) for s in range(8)]
    df = spark.createDataFrame(rows, "date int, symbol int, good double, fwd double, bad double")
    ic = {(r.factor): r.ic for r in rs.date_ic(df, XS, ["good", "bad"], "fwd").groupBy("factor").agg(F.avg("ic").alias("ic")).collect()}
    assert ic["good"] == pytest.approx(1) and ic["bad"] == pytest.approx(-1)


def test_quality_islands(spark):
    v = [5, 0, 0, 0, 5, 0]
    days = [D(2024, 1, d) for d in (1, 2, 3, 4, 5, 8)]
    df = spark.createDataFrame(list(zip([1] * 6, days, v)), "symbol int, date date, volume int")
    got = {(r.start, r.days, r.severity) for r in q.zero_volume(df, F.col("volume") == 0).collect()}
    assert got == {(D(2024, 1, 2), 3, "error"), (D(2024, 1, 8), 1, "warning")}


def test_pair_trades_delay_and_forced_close(spark):
    sig = [0, 1, 1, 0, -1, -1, 1, 0]
    rows = [(1, D(2024, 1, i + 1), 10.0 + i, s) for i, s in enumerate(sig)]
    df = spark.createDataFrame(rows, "symbol int, date date, close double, signal int")
    got = [(r.entry_price, r.exit_price) for r in risk.pair_trades(df, "symbol").orderBy("entry_date").collect()]
    assert got == [(12.0, 15.0), (17.0, 17.0)]


def test_model_uses_only_earlier_dates(bars):
    df, _ = bars
    f = ml.features(df)
    d = ml.split_by_date(f)
    edge = d.groupBy("is_train").agg(F.min("date").alias("lo"), F.max("date").alias("hi")).collect()
    by = {r.is_train: r for r in edge}
    assert by[True].hi < by[False].lo
    assert "close" not in ml.feature_columns(f) and "ret_5" in ml.feature_columns(f)
    out = ml.signals(f, "logistic").toPandas()
    assert set(out.signal) <= {-1, 0, 1} and out.probability_up.between(0, 1).all()
