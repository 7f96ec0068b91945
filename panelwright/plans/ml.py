"""M: features and pooled models."""

from pyspark.sql import functions as F

from ..operators import flows as fl
from ..operators import ml
from .ctes import cte
from .registry import plan

C = F.col
A = lambda agg, c, n: f"{agg}({c}) OVER (PARTITION BY symbol ORDER BY date ROWS {n - 1} PRECEDING)"
FCOLS = ["ret_1", "ret_5", "ret_10", "ret_20", "sma_ratio_5", "sma_ratio_20", "volatility", "volume_ratio", "volume_change", "band_position", "range_position", "momentum_x_volume", "volatility_x_range", "ret_1_lag1", "ret_1_lag2"]
cte("mlf_p", f"""SELECT *, ret_5 * volume_ratio AS momentum_x_volume, volatility * range_position AS volatility_x_range, lag(ret_1) OVER (PARTITION BY symbol ORDER BY date) AS ret_1_lag1, lag(ret_1, 2) OVER (PARTITION BY symbol ORDER BY date) AS ret_1_lag2 FROM (
  SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n, {', '.join(f"close / lag(close, {k}) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret_{k}" for k in (1, 5, 10, 20))}, close / {A('avg', 'close', 5)} - 1 AS sma_ratio_5, close / {A('avg', 'close', 20)} - 1 AS sma_ratio_20,
   {A('stddev_samp', 'r1', 20)} AS volatility, volume / nullif({A('avg', 'volume', 20)}, 0) AS volume_ratio, volume / lag(volume) OVER (PARTITION BY symbol ORDER BY date) - 1 AS volume_change, (close - {A('avg', 'close', 20)}) / nullif(2 * {A('stddev_pop', 'close', 20)}, 0) AS band_position,
   (close - {A('min', 'low', 20)}) / nullif({A('max', 'high', 20)} - {A('min', 'low', 20)}, 0) AS range_position, CASE WHEN lead(close, 5) OVER (PARTITION BY symbol ORDER BY date) / close - 1 > 0 THEN 1.0 WHEN lead(close, 5) OVER (PARTITION BY symbol ORDER BY date) IS NOT NULL THEN 0.0 END AS label FROM bars_r)""")


@plan("m01_build_ml_features", f"SELECT symbol, date, {', '.join(FCOLS)}, label::DOUBLE AS label FROM mlf_p WHERE n > 20 AND label IS NOT NULL", " ".join(FCOLS) + " label")
def _(p):
    return ml.features(p.bars()).select("symbol", "date", *FCOLS, "label")


@plan("m02_feature_columns", "SELECT feature, count(*) AS n_rows, avg(value) AS mean FROM (UNPIVOT (SELECT " + ", ".join(FCOLS) + " FROM mlf_p WHERE n > 20 AND label IS NOT NULL) ON " + ", ".join(FCOLS) + " INTO NAME feature VALUE value) GROUP BY 1", "mean")
def _(p):
    d = ml.features(p.bars())
    cols = ml.feature_columns(d)
    return d.select("symbol", *cols).unpivot(["symbol"], cols, "feature", "value").groupBy("feature").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("value").alias("mean"))


def training(p):
    """Feature rows, persisted because every fit and fold reads them several times."""
    return p.shared("ml_features", lambda: ml.features(p.bars()))


N = len(FCOLS)
XS = f"[{', '.join(f'{c}::DOUBLE' for c in FCOLS)}]"


def fit_sql(name, train):
    """CTEs of the fit of `train` (model, label, x): statistics, standardised rows, one CTE a step."""
    cte(f"{name}s_p", f"/*MATERIALIZED*/SELECT model, list(mu ORDER BY i) AS mus, list(CASE WHEN sd > 0 THEN sd ELSE 1 END ORDER BY i) AS sds FROM (SELECT model, i, avg(v) AS mu, stddev_pop(v) AS sd FROM (SELECT model, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM ({train})) GROUP BY 1, 2) GROUP BY 1")
    cte(f"{name}z_p", f"/*MATERIALIZED*/SELECT model, label, {scaled()} AS z FROM ({train}) JOIN {name}s_p USING (model)")
    cte(f"{name}w0_p", f"SELECT model, list_transform(range({N + 1}), lambda i: 0.0::DOUBLE) AS w FROM {name}s_p")
    for k in range(ml.STEPS):
        cte(f"{name}w{k + 1}_p", f"""/*MATERIALIZED*/SELECT model, list(wi - {ml.RATE} * (g + CASE WHEN i <= {N} THEN {ml.RIDGE} * wi ELSE 0 END) ORDER BY i) AS w FROM (
  SELECT model, i, any_value(w[i]) AS wi, avg(d * v) AS g FROM (SELECT model, w, {prob()} - label AS d, unnest(z) AS v, generate_subscripts(z, 1) AS i FROM {name}z_p JOIN {name}w{k}_p USING (model)) GROUP BY 1, 2) GROUP BY 1""")
    return f"{name}w{ml.STEPS}_p"


def scaled():
    return f"list_append(list_transform(range(1, {N + 1}), lambda i: (x[i] - mus[i]) / sds[i]), 1.0)"


def prob():
    return "1 / (1 + exp(-list_dot_product(z, w)))"


def predict_sql(name, weights, rows):
    """Rows (model, x, ...) with their probability."""
    return f"SELECT * EXCLUDE (z, w), {prob()} AS probability_up FROM (SELECT r.* EXCLUDE (mus, sds, x), {scaled()} AS z FROM (SELECT * FROM ({rows}) JOIN {name}s_p USING (model)) r) JOIN {weights} USING (model)"


cte("mlrows_p", f"SELECT symbol, date, label::DOUBLE AS label, {XS} AS x FROM mlf_p WHERE n > 20 AND label IS NOT NULL AND {' AND '.join(f'{c} IS NOT NULL' for c in FCOLS)}")
cte("mlcal_p", "SELECT date, row_number() OVER (ORDER BY date) <= count(*) OVER () * 0.7 AS is_train, ntile(4) OVER (ORDER BY date) - 1 AS fold FROM (SELECT DISTINCT date FROM mlrows_p)")
W3 = fit_sql("mlsig", "SELECT 0 AS model, label, x FROM mlrows_p JOIN mlcal_p USING (date) WHERE is_train")
W4 = fit_sql("mlcv", "SELECT unnest(range(fold + 1, 4)) AS model, label, x FROM mlrows_p JOIN mlcal_p USING (date) WHERE fold < 3")
W5 = fit_sql("mlall", "SELECT 0 AS model, label, x FROM mlrows_p")


def early_model(p):
    """The logistic model of the early dates, stored for the version of the tables that it was fitted on."""

    def build():
        d = ml.split_by_date(training(p)).where("is_train").withColumn("model", F.lit(0))
        mean, sd, weights = ml.fit_logistic(d, FCOLS)
        rows = [(k, mean[k], sd[k], weights[k]) for k in mean]
        return p.spark.createDataFrame(rows, "model int, mean array<double>, sd array<double>, weights array<double>")

    rows = p.shared("ml_model", build).collect()  # one row a model
    return tuple({r["model"]: list(r[c]) for r in rows} for c in ("mean", "sd", "weights"))


def model_score(p):
    """probability_up of each name's latest complete features, by the model of the early dates."""
    last = fl.last_rows(ml.features(p.bars(), labelled=False).select("symbol", "date", *FCOLS)).withColumn("model", F.lit(0))
    return ml.predicted(last, FCOLS, early_model(p)).select("symbol", "probability_up")


cte("mllast_p", f"SELECT 0 AS model, symbol, {XS} AS x FROM mlf_p WHERE n > 20 AND {' AND '.join(f'{c} IS NOT NULL' for c in FCOLS)} QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1")
cte("mlscore_p", predict_sql("mlsig", W3, "SELECT * FROM mllast_p"))


@plan("m03_ml_signals", f"SELECT symbol, date, label, probability_up, CASE WHEN probability_up > 0.55 THEN 1 WHEN probability_up < 0.45 THEN -1 ELSE 0 END::BIGINT AS signal FROM ({predict_sql('mlsig', W3, 'SELECT 0 AS model, symbol, date, label, x FROM mlrows_p JOIN mlcal_p USING (date) WHERE NOT is_train')})", "label probability_up")
def _(p):
    return ml.logistic_signals(training(p))


@plan("m04_time_series_cv", f"SELECT model::BIGINT AS fold, avg(((probability_up > 0.5)::INT = label)::INT) AS accuracy, count(*) AS n FROM ({predict_sql('mlcv', W4, 'SELECT fold AS model, label, x FROM mlrows_p JOIN mlcal_p USING (date) WHERE fold > 0')}) GROUP BY 1", "accuracy")
def _(p):
    return ml.logistic_cv(training(p))


@plan("m05_select_features", f"SELECT feature, importance, row_number() OVER (ORDER BY round(importance, 9) DESC, feature) <= {N - int(N * 0.2)} AS kept FROM (SELECT unnest({FCOLS!r}) AS feature, abs(unnest(w[1:{N}])) AS importance FROM {W5})", "importance")
def _(p):
    return ml.logistic_importance(training(p))
