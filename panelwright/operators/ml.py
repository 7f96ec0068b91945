"""Pooled panel models: features, chronological split, fit, cross-validation, feature choice."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.crosssection import cut
from ..functions.exprs import DATE, SYMBOL, div, symbol_window, trailing
from ..functions.timeseries import ret

C = F.col
W = symbol_window


def features(bars: DataFrame, lookback: int = 20, forward: int = 5, labelled: bool = True) -> DataFrame:
    """M1, without ``labelled`` also of the last rows, whose label isn't known yet: returns, mean ratios, volatility, volume ratios, range position, interactions, lags and the label."""
    d = bars.withColumns({"_r": ret("close", 1), "_vr": div("volume", F.avg("volume").over(trailing(lookback)))})
    avg = lambda n: F.avg("close").over(trailing(n))
    hi, lo = F.max("high").over(trailing(lookback)), F.min("low").over(trailing(lookback))
    sd = F.stddev_pop("close").over(trailing(lookback))
    d = d.withColumns(
        {
            **{f"ret_{n}": ret("close", n) for n in (1, 5, 10, 20)},
            "sma_ratio_5": C("close") / avg(5) - 1,
            "sma_ratio_20": C("close") / avg(lookback) - 1,
            "volatility": F.stddev_samp("_r").over(trailing(lookback)),
            "volume_ratio": C("_vr"),
            "volume_change": ret("volume", 1),
            "band_position": (C("close") - avg(lookback)) / F.when(sd > 0, 2 * sd),
            "range_position": (C("close") - lo) / F.when(hi > lo, hi - lo),
            "_n": F.row_number().over(W()),
            "_f": F.lead("close", forward).over(W()) / C("close") - 1,
        }
    )
    d = d.withColumns(
        {
            "momentum_x_volume": C("ret_5") * C("volume_ratio"),
            "volatility_x_range": C("volatility") * C("range_position"),
            "ret_1_lag1": F.lag("ret_1", 1).over(W()),
            "ret_1_lag2": F.lag("ret_1", 2).over(W()),
            "label": F.when(C("_f").isNotNull(), (C("_f") > 0).cast("double")),
        }
    )
    d = d.where(C("_n") > lookback).drop("_r", "_vr", "_n", "_f")
    return d.na.drop(subset=feature_columns(d) + (["label"] if labelled else []))


RAW = {SYMBOL, DATE, "open", "high", "low", "close", "volume", "turnover", "label"}


def feature_columns(df: DataFrame) -> list[str]:
    """M2: everything but identifiers, raw bars and the label."""
    return [c for c in df.columns if c not in RAW and not c.startswith("_")]


def split_by_date(df: DataFrame, share: float = 0.7) -> DataFrame:
    """Chronological split: rows of the first ``share`` of the dates train."""
    w = Window.partitionBy(F.lit(0)).orderBy(DATE)  # one row per date
    cal = df.select(DATE).distinct()
    cal = cal.withColumns({"_o": F.row_number().over(w), "_m": F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))})
    return df.join(cal.select(DATE, (C("_o") <= C("_m") * share).alias("is_train")), DATE)


def pipeline(kind: str, cols: list[str], seed: int = 42) -> Pipeline:
    model = {
        "logistic": LogisticRegression(maxIter=20, regParam=0.01),
        "forest": RandomForestClassifier(numTrees=20, maxDepth=5, seed=seed),
        "boosted": GBTClassifier(maxIter=10, maxDepth=3, seed=seed),
    }[kind]
    scale = StandardScaler(inputCol="raw", outputCol="features", withMean=True)
    return Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="raw"), scale, model])


# -- logistic models of several row sets at once ------------------------------------------------------

#: Full gradient steps, their rate, and the ridge on all weights but the bias.
STEPS, RATE, RIDGE = 20, 0.5, 0.01


def _by_model(values: dict[int, list[float]]) -> Column:
    """A few numbers for each model, by the model's number."""
    return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))[C("model")]


def standardised(rows: DataFrame, cols: list[str], mean: dict, sd: dict) -> DataFrame:
    """Adds z: the features against the model's mean and deviation, and a one for the bias."""
    x = F.transform(F.arrays_zip(F.array(*[C(c).cast("double") for c in cols]).alias("x"), _by_model(mean).alias("m"), _by_model(sd).alias("s")), lambda t: (t["x"] - t["m"]) / t["s"])
    return rows.withColumn("z", F.concat(x, F.array(F.lit(1.0))))


def probability(weights: dict[int, list[float]]) -> Column:
    dot = F.aggregate(F.zip_with("z", _by_model(weights), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return 1 / (1 + F.exp(-dot))


def fit_logistic(rows: DataFrame, cols: list[str], steps: int = STEPS, rate: float = RATE, ridge: float = RIDGE) -> tuple[dict, dict, dict]:
    """Mean, deviation and weights (the bias last) of each `model` number of the rows, all models in each pass.

    A step is one aggregation of one gradient a model, so what reaches the driver is models x features, and the number of
    passes is fixed: the fit is a function of the rows alone, which SQL can repeat.
    """
    stats = rows.groupBy("model").agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).collect()
    mean = {r["model"]: [r[f"m_{c}"] for c in cols] for r in stats}
    sd = {r["model"]: [r[f"s_{c}"] or 1.0 for c in cols] for r in stats}
    weights = {k: [0.0] * (len(cols) + 1) for k in mean}
    if not mean:
        return mean, sd, weights
    z = cut(standardised(rows, cols, mean, sd).select("model", "z", "label"))
    n = len(cols)
    for _ in range(steps):
        away = z.withColumn("d", probability(weights) - C("label"))
        for r in away.groupBy("model").agg(*[F.avg(C("d") * C("z")[i]).alias(f"g{i}") for i in range(n + 1)]).collect():
            w = weights[r["model"]]
            weights[r["model"]] = [w[i] - rate * (r[f"g{i}"] + (ridge * w[i] if i < n else 0.0)) for i in range(n + 1)]
    return mean, sd, weights


def predicted(rows: DataFrame, cols: list[str], model: tuple[dict, dict, dict]) -> DataFrame:
    """Rows with a model number and its probability_up."""
    mean, sd, weights = model
    if not mean:
        return rows.withColumn("probability_up", F.lit(0.5))
    return standardised(rows, cols, mean, sd).withColumn("probability_up", probability(weights)).drop("z")


def signal(buy: float = 0.55, sell: float = 0.45) -> Column:
    return F.when(C("probability_up") > buy, 1).when(C("probability_up") < sell, -1).otherwise(0).cast("long")


def logistic_signals(df: DataFrame) -> DataFrame:
    """M3 with the fixed-step fit: the early dates train, the later ones get signals."""
    d = split_by_date(df).withColumn("model", F.lit(0))
    cols = feature_columns(df)
    model = fit_logistic(d.where("is_train"), cols)
    return predicted(d.where("not is_train"), cols, model).select(SYMBOL, DATE, "label", "probability_up", signal().alias("signal"))


def logistic_cv(df: DataFrame, n_splits: int = 3) -> DataFrame:
    """M4 with the fixed-step fit: expanding windows, all folds in the same passes."""
    w = Window.partitionBy(F.lit(0)).orderBy(DATE)  # one row per date
    cal = df.select(DATE).distinct().withColumn("fold", F.ntile(n_splits + 1).over(w) - 1)
    d = df.join(cal, DATE)
    cols = feature_columns(df)
    later = d.where(C("fold") < n_splits).withColumn("model", F.explode(F.sequence(C("fold") + 1, F.lit(n_splits))))
    model = fit_logistic(later, cols)
    test = predicted(d.where(C("fold") > 0).withColumn("model", C("fold")), cols, model)
    right = ((C("probability_up") > 0.5).cast("double") == C("label")).cast("int")
    return test.groupBy(C("fold").cast("long").alias("fold")).agg(F.avg(right).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def logistic_importance(df: DataFrame, drop_ratio: float = 0.2) -> DataFrame:
    """M5 with the fixed-step fit: size of each standardised weight, the weakest share dropped; one row per feature."""
    cols = feature_columns(df)
    weights = fit_logistic(df.withColumn("model", F.lit(0)), cols)[2].get(0, [0.0] * (len(cols) + 1))
    ranked = sorted(zip(cols, weights), key=lambda t: (-round(abs(t[1]), 9), t[0]))
    keep = len(ranked) - int(len(ranked) * drop_ratio)
    return df.sparkSession.createDataFrame([(c, abs(v), i < keep) for i, (c, v) in enumerate(ranked)], "feature string, importance double, kept boolean")


# -- models of the library ------------------------------------------------------------------------------


def signals(df: DataFrame, kind: str = "forest", buy: float = 0.55, sell: float = 0.45) -> DataFrame:
    """M3: fit on the early dates, turn the later probabilities into +1 / 0 / -1."""
    d = split_by_date(df)
    model = pipeline(kind, feature_columns(df)).fit(d.where("is_train"))
    out = model.transform(d.where("not is_train")).withColumn("probability_up", vector_to_array("probability")[1])
    sig = F.when(C("probability_up") > buy, 1).when(C("probability_up") < sell, -1).otherwise(0).cast("long")
    return out.select(SYMBOL, DATE, "label", "probability_up", sig.alias("signal"))


def time_series_cv(df: DataFrame, kind: str = "logistic", n_splits: int = 3) -> DataFrame:
    """M4: expanding-window accuracy per fold; folds are date ranges, fits are few."""
    w = Window.partitionBy(F.lit(0)).orderBy(DATE)  # one row per date
    cal = df.select(DATE).distinct().withColumn("fold", F.ntile(n_splits + 1).over(w) - 1)
    d = df.join(cal, DATE)
    cols, out = feature_columns(df), None
    for k in range(1, n_splits + 1):
        model = pipeline(kind, cols).fit(d.where(C("fold") < k))
        s = model.transform(d.where(C("fold") == k)).agg(F.avg((C("prediction") == C("label")).cast("int")).alias("accuracy"), F.count(F.lit(1)).alias("n"))
        s = s.withColumn("fold", F.lit(k).cast("long"))
        out = s if out is None else out.unionByName(s)
    return out


def choose_features(df: DataFrame, drop_ratio: float = 0.2) -> list[tuple[str, float, bool]]:
    """M5: (feature, importance, kept) after dropping the weakest share; one entry per feature."""
    cols = feature_columns(df)
    forest = pipeline("forest", cols).fit(df).stages[-1]
    imp = sorted(zip(cols, forest.featureImportances.toArray().tolist()), key=lambda t: (-t[1], t[0]))
    keep = len(imp) - int(len(imp) * drop_ratio)
    return [(c, v, i < keep) for i, (c, v) in enumerate(imp)]
