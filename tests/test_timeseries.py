import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.functions import calendar as cal
from panelwright.functions import timeseries as ts
from panelwright.operators import indicators as ind


def series(spark, n, sym=1):
    x = np.random.default_rng(n).normal(0, 1, n).cumsum() + 50
    pdf = pd.DataFrame({"symbol": sym, "date": pd.date_range("2000-01-01", periods=n).date, "x": x})
    return spark.createDataFrame(pdf), pd.Series(x)


@pytest.mark.parametrize("n,size", [(50, None), (3000, None), (3000, 16)])
@pytest.mark.parametrize("alpha", [2 / 3, 2 / 13, 1 / 14])
def test_smooth_matches_ewm_for_any_block_size(spark, n, size, alpha):
    df, x = series(spark, n)
    got = ts.smooth(df, {"y": ("x", alpha)}, size=size).orderBy("date").toPandas()["y"]
    np.testing.assert_allclose(got, x.ewm(alpha=alpha, adjust=False).mean(), rtol=1e-9)


def test_seeded_smoothing_starts_from_the_mean(spark):
    df, x = series(spark, 60)
    got = ts.smooth(df, {"y": ("x", 1 / 14)}, seed=14).orderBy("date").toPandas()["y"]
    want = [np.nan] * 13 + [x[:14].mean()]
    for v in x[14:]:
        want.append(want[-1] * 13 / 14 + v / 14)
    np.testing.assert_allclose(got, want, rtol=1e-10)


def test_streak(spark):
    hits = [1, 1, 0, 1, 1, 1, None, 1]
    rows = [(1, i, h) for i, h in enumerate(hits)]
    df = spark.createDataFrame(rows, "symbol int, date int, h int")
    got = ts.streak(df, F.col("h") == 1, "s").orderBy("date").toPandas()["s"].tolist()
    assert got == [1, 2, 0, 1, 2, 3, 0, 1]


@pytest.mark.parametrize("exact", [True, False])
@pytest.mark.parametrize("forward", [True, False])
@pytest.mark.parametrize("tol", [None, 3])
def test_asof_against_merge_asof(spark, exact, forward, tol):
    rng = np.random.default_rng(3)
    day = lambda k: (pd.Timestamp("2020-01-01") + pd.to_timedelta(k, "D"))
    facts = pd.DataFrame({"k": rng.integers(0, 3, 40), "t": day(rng.integers(0, 90, 40))}).drop_duplicates(["k", "t"])
    facts["v"] = np.arange(len(facts), dtype=float)
    probes = pd.DataFrame({"k": rng.integers(0, 4, 120), "t": day(rng.integers(0, 90, 120)), "id": np.arange(120)})
    want = pd.merge_asof(
        probes.sort_values("t"), facts.sort_values("t"), on="t", by="k", allow_exact_matches=exact,
        direction="forward" if forward else "backward", tolerance=None if tol is None else pd.Timedelta(days=tol),
    ).sort_values("id")
    as_date = lambda d, c: spark.createDataFrame(d.assign(t=d.t.dt.date)).withColumnRenamed("t", c)
    got = ts.asof(as_date(probes, "pd"), as_date(facts, "fd"), on="k", probe_date="pd", fact_date="fd", values=["v"], allow_exact=exact, forward=forward, tolerance_days=tol)
    np.testing.assert_array_equal(got.orderBy("id").toPandas()["v"].to_numpy(dtype=float), want["v"].to_numpy())


def test_business_days(spark):
    rng = np.random.default_rng(1)
    a = pd.Timestamp("1999-01-01") + pd.to_timedelta(rng.integers(0, 4000, 300), "D")
    b = a + pd.to_timedelta(rng.integers(0, 200, 300), "D")
    pdf = pd.DataFrame({"i": range(300), "a": a.date, "b": b.date})
    got = spark.createDataFrame(pdf).select("i", ts.busdays("a", "b").alias("n"), ts.add_busdays("a", 5).alias("c")).orderBy("i").toPandas()
    np.testing.assert_array_equal(got["n"], np.busday_count(pdf.a.tolist(), pdf.b.tolist()))
    want = np.busday_offset(np.array(pdf.a.tolist(), dtype="datetime64[D]"), 5, roll="forward")
    assert [str(d) for d in got["c"]] == [str(d) for d in want]


@pytest.mark.parametrize(
    "as_of,revenue,statement",
    [
        ("2024-05-09", "2024-03-31", "2023-12-31"),
        ("2024-05-10", "2024-04-30", "2023-12-31"),
        ("2024-05-15", "2024-04-30", "2024-03-31"),
        ("2024-03-29", "2024-02-29", "2023-09-30"),
        ("2024-03-30", "2024-02-29", "2023-12-31"),
        ("2024-01-09", "2023-11-30", "2023-09-30"),
    ],
)
def test_publication_lags(spark, as_of, revenue, statement):
    d = F.lit(as_of).cast("date")
    row = spark.range(1).select(cal.revenue_visible_cutoff(d).alias("r"), cal.financial_visible_cutoff(d).alias("s")).first()
    assert (str(row["r"]), str(row["s"])) == (revenue, statement)


def test_features_match_pandas(bars):
    df, pdf = bars
    got = ind.feature_columns(df).orderBy("symbol", "date").toPandas()
    g = pdf.sort_values(["symbol", "date"]).groupby("symbol")
    want = g["close"].transform(lambda s: s.rolling(20, min_periods=10).mean())
    np.testing.assert_allclose(got["ma20"], want, rtol=1e-12)
    vol = g["close"].transform(lambda s: s.pct_change().rolling(20, min_periods=10).std() * 252**0.5 * 100)
    np.testing.assert_allclose(got["volatility_20d"], vol, rtol=1e-9)


def test_no_look_ahead_and_order_invariance(bars):
    df, _ = bars
    cols = ["sma_20", "rsi_14", "macd_hist", "adx_14"]
    full = ind.indicators(df).select("symbol", "date", *cols)
    cut = F.lit("2020-12-01").cast("date")
    a = full.where(F.col("date") <= cut).orderBy("symbol", "date").toPandas()
    b = ind.indicators(df.where(F.col("date") <= cut).repartition(7, "close")).select("symbol", "date", *cols).orderBy("symbol", "date").toPandas()
    np.testing.assert_allclose(a[cols].to_numpy(dtype=float), b[cols].to_numpy(dtype=float), rtol=1e-9)


def test_streak_of_rows_that_share_a_date_counts_a_date_at_once(spark):
    rows = [(1, 1, 1), (1, 2, 1), (1, 2, 0), (1, 3, 1), (1, 3, 1), (2, 1, 0), (2, None, 1)]
    df = spark.createDataFrame(rows, "symbol int, date int, h int")
    got = sorted(map(tuple, ts.streak(df, F.col("h") == 1, "s").select("symbol", F.coalesce("date", F.lit(0)), "h", "s").collect()))
    assert got == [(1, 1, 1, 1), (1, 2, 0, 1), (1, 2, 1, 1), (1, 3, 1, 3), (1, 3, 1, 3), (2, 0, 1, 1), (2, 1, 0, 0)]
