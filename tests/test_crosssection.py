import numpy as np
import pandas as pd
import pytest

from panelwright.functions.crosssection import CrossSection

WIN, SPLIT = CrossSection(), CrossSection(pooled=True)


@pytest.fixture
def frame(spark):
    """Three dates; one value holds a third of the rows, some values are missing, one outlier."""
    rng = np.random.default_rng(7)
    n = 900
    v = rng.normal(0, 1, n).round(2)
    v[: n // 3] = 0.5
    v[-1] = 1e9
    pdf = pd.DataFrame({"date": rng.integers(0, 3, n), "symbol": np.arange(n), "x": v})
    pdf.loc[rng.random(n) < 0.1, "x"] = np.nan
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "date long, symbol long, x double")
    return df, pdf


def by_symbol(df, col):
    return df.orderBy("symbol").toPandas()[col].to_numpy(dtype=float)


@pytest.mark.parametrize("xs", [WIN, SPLIT])
@pytest.mark.parametrize("asc", [True, False])
def test_pct_rank_is_average_rank_over_count(frame, xs, asc):
    df, pdf = frame
    got = by_symbol(xs.pct_rank(df, "date", {"r": ("x", asc)}), "r")
    want = pdf.groupby("date")["x"].rank(pct=True, ascending=asc).to_numpy()
    np.testing.assert_allclose(got, want, rtol=1e-12)


def test_row_rank_split_equals_window(frame):
    df, _ = frame
    a = by_symbol(WIN.row_rank(df, "date", "x", "r"), "r")
    b = by_symbol(SPLIT.row_rank(df, "date", "x", "r"), "r")
    np.testing.assert_array_equal(a, b)


@pytest.mark.parametrize("q", [0.0, 0.15, 0.5, 0.8, 1.0])
def test_quantiles_interpolate(frame, q):
    df, pdf = frame
    want = pdf.groupby("date")["x"].quantile(q).to_numpy()
    for xs in (WIN, SPLIT):
        got = xs.quantiles(df, "date", {"q": ("x", q)}).orderBy("date").toPandas()["q"].to_numpy()
        np.testing.assert_allclose(got, want, rtol=1e-12)


def test_stats_and_spread(frame):
    from pyspark.sql import functions as F

    df, pdf = frame
    for xs in (WIN, SPLIT):
        d = xs.with_spread(xs.with_stats(df, "date", {"n": F.count("x")}), "date", {"s": "x"})
        got = d.select("date", "n", "s").distinct().orderBy("date").toPandas()
        np.testing.assert_array_equal(got["n"], pdf.groupby("date")["x"].count())
        np.testing.assert_allclose(got["s"], pdf.groupby("date")["x"].agg(lambda v: v.max() - v.min()))


def test_pool_with_a_hot_group_and_heavy_ties(spark):
    """Nine rows in ten belong to one group, a third of them to one value."""
    rng = np.random.default_rng(3)
    n = 4000
    v = rng.normal(0, 1, n).round(3)
    v[: n // 3] = 0.25
    pdf = pd.DataFrame({"g": np.where(rng.random(n) < 0.9, 1, 2), "symbol": np.arange(n), "x": v})
    df = spark.createDataFrame(pdf)
    got = SPLIT.pct_rank(df, "g", {"r": ("x", True)})
    np.testing.assert_allclose(by_symbol(got, "r"), pdf.groupby("g")["x"].rank(pct=True).to_numpy(), rtol=1e-12)
    order = pdf.sort_values(["x", "symbol"], ascending=[False, True]).groupby("g").cumcount() + 1
    np.testing.assert_array_equal(by_symbol(SPLIT.row_rank(df, "g", "x", "r"), "r"), order.sort_index().to_numpy())


def test_plans_do_not_depend_on_the_input_size():
    from panelwright.sources.panels import Panels

    assert not Panels.xs.pooled and Panels.pool.pooled


def test_split_form_runs_a_whole_query(spark, monkeypatch):
    """Forcing the split plan must not change a registered query."""
    from panelwright.plans import load_plans
    from panelwright.sources.panels import Panels

    from .conftest import SF

    p = load_plans()["f03_coarse_filter"]
    a = p.run(spark, SF).toPandas().sort_values(["symbol", "date"]).reset_index(drop=True)
    monkeypatch.setattr(Panels, "xs", CrossSection(pooled=True))
    b = p.run(spark, SF).toPandas().sort_values(["symbol", "date"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b[a.columns])
