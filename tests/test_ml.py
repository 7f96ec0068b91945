"""Pooled models: the fixed-step fit against numpy, and the library's models as options."""

import datetime as dt

import numpy as np
import pytest

from panelwright.operators import ml

COLS = ["a", "b", "c"]


@pytest.fixture
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3)) * [1.0, 5.0, 0.0] + [0.0, 3.0, 2.0]
    y = (x[:, 0] + 0.1 * x[:, 1] + rng.normal(size=400) > 0.3).astype(float)
    day = [dt.date(2020, 1, 1) + dt.timedelta(days=k // 4) for k in range(400)]
    data = [(k % 4, day[k], *map(float, x[k]), float(y[k])) for k in range(400)]
    return spark.createDataFrame(data, "symbol int, date date, a double, b double, c double, label double"), x, y


def descent(x, y):
    z = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    z = np.column_stack([z, np.ones(len(z))])
    w = np.zeros(z.shape[1])
    for _ in range(ml.STEPS):
        p = 1 / (1 + np.exp(-z @ w))
        w -= ml.RATE * (z.T @ (p - y) / len(y) + ml.RIDGE * np.append(w[:-1], 0))
    return z, w


def test_steps_equal_numpy(rows):
    df, x, y = rows
    both = df.selectExpr("*", "0 AS model").unionByName(df.where("symbol < 2").selectExpr("*", "5 AS model"))
    weights = ml.fit_logistic(both, COLS)[2]
    assert weights[0] == pytest.approx(descent(x, y)[1].tolist(), abs=1e-9)
    some = np.arange(400) % 4 < 2
    assert weights[5] == pytest.approx(descent(x[some], y[some])[1].tolist(), abs=1e-9)


def test_folds_train_on_earlier_dates_only(rows):
    df, x, y = rows
    got = {r.fold: (r.accuracy, r.n) for r in ml.logistic_cv(df).collect()}
    for fold in (1, 2, 3):
        past, now = slice(0, 100 * fold), slice(100 * fold, 100 * fold + 100)
        _, w = descent(x[past], y[past])
        z = (x[now] - x[past].mean(0)) / np.where(x[past].std(0) > 0, x[past].std(0), 1)
        right = ((np.column_stack([z, np.ones(100)]) @ w > 0) == (y[now] == 1)).mean()
        assert got[fold] == (pytest.approx(right), 100)


def test_signals_and_importance(rows):
    df, _, _ = rows
    out = ml.logistic_signals(df).collect()
    assert len(out) == 120 and {r.signal for r in out} >= {1, -1} and min(r.date for r in out) > dt.date(2020, 3, 9)
    ranked = ml.logistic_importance(df, 0.4).collect()
    assert [r.feature for r in ranked] == ["a", "b", "c"] and [r.kept for r in ranked] == [True, True, False]


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_library_models_are_options(rows, kind):
    out = ml.signals(rows[0], kind).collect()
    assert len(out) == 120 and all(0 <= r.probability_up <= 1 for r in out)


def test_no_rows(rows):
    none = rows[0].where("symbol > 9")
    assert ml.logistic_signals(none).count() == 0 and ml.logistic_cv(none).count() == 0
