"""Forward returns, information coefficients, ablation and outcome statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.crosssection import CrossSection, cut
from ..functions.exprs import DATE, SYMBOL, corr, symbol_window
from ..functions.timeseries import asof

C = F.col
W = symbol_window


def future_bars(bars: DataFrame, horizons, entry_open: bool = False) -> DataFrame:
    """h-th following close (and its date) as columns of each bar; no join is needed."""
    w = W()
    cols = {f"exit_{h}": F.lead("close", h).over(w) for h in horizons}
    cols |= {f"exit_date_{h}": F.lead(DATE, h).over(w) for h in horizons}
    if entry_open:
        cols["next_open"] = F.lead("open", 1).over(w)
    return bars.withColumns(cols)


def forward_returns(records: DataFrame, bars: DataFrame, horizons, *, date: str = DATE, entry: str = "close") -> DataFrame:
    """Return to the h-th close strictly after the record date.

    Record dates need not be bar dates: the last bar at or before the date carries its leads.
    """
    f = future_bars(bars.select(SYMBOL, DATE, "close"), horizons).withColumnRenamed(DATE, "_bar").drop("close")
    d = asof(records, f, on=SYMBOL, probe_date=date, fact_date="_bar", values=[f"exit_{h}" for h in horizons])
    e = F.when(C(entry) > 0, C(entry))
    return d.withColumns({f"fwd_{h}": C(f"exit_{h}") / e - 1 for h in horizons})


def cost_returns(df: DataFrame, horizons, commission=0.001425, tax=0.003, slippage=0.0005) -> DataFrame:
    """Entry at the next open (close when missing), net of both legs' cost."""
    e = F.coalesce(C("next_open"), C("close"))
    paid = e * (1 + commission + slippage)
    return df.withColumns({f"net_{h}": C(f"exit_{h}") * (1 - commission - tax - slippage) / paid - 1 for h in horizons})


def excursions(bars: DataFrame, n: int = 20) -> DataFrame:
    """Best high and worst low of the next n bars relative to the close."""
    w = W().rowsBetween(1, n)
    mfe = F.max("high").over(w) / C("close") - 1
    mae = F.min("low").over(w) / C("close") - 1
    last = F.last("close").over(w) / C("close") - 1
    d = bars.withColumns({"mfe": mfe, "mae": mae, "final_return": last})
    ratio = F.when(F.abs("mae") > 0.001, C("mfe") / F.abs("mae"))
    return d.withColumn("mfe_mae_ratio", ratio)


# -- information coefficient ---------------------------------------------------------


def spearman_by(df: DataFrame, xs: CrossSection, by: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation of x and y per group over complete pairs: (by, ic, n)."""
    d = df.where(C(x).isNotNull() & C(y).isNotNull())
    d = xs.pct_rank(d, by, {"_rx": (x, True), "_ry": (y, True)})
    return d.groupBy(*by).agg(corr("_rx", "_ry").alias("ic"), F.count(F.lit(1)).alias("n"))


def long_factors(df: DataFrame, factors: list[str], keep: list[str]) -> DataFrame:
    cols = [C(c).cast("double").alias(c) for c in factors]
    # exploded, as unpivoted rows don't lie by the columns kept any more
    value = F.array(*[F.struct(F.lit(c).alias("factor"), C(c).alias("value")) for c in factors])
    return df.select(*keep, *cols).withColumn("_f", F.explode(value)).select(*keep, "_f.factor", "_f.value")


def date_ic(df: DataFrame, xs: CrossSection, factors: list[str], ret: str, date: str = DATE, min_names: int = 3) -> DataFrame:
    """Per-date Spearman of every factor: one small row per (date, factor)."""
    d = long_factors(df.repartition(date), factors, [date, SYMBOL, ret])  # dealt out before rows are multiplied
    return spearman_by(d, xs, [date, "factor"], "value", ret).where((C("n") >= min_names) & C("ic").isNotNull())


def direction(ic: Column) -> Column:
    return F.when(ic > 0.05, "effective").when(ic < -0.05, "inverse").otherwise("weak")


def factor_ic(df: DataFrame, xs: CrossSection, factors: list[str], ret: str, since: Column, min_dates: int = 3) -> DataFrame:
    """Mean per-date IC since a date; pooled IC when too few dates qualify."""
    d = df.where(C(DATE) >= since)
    per = cut(date_ic(d, xs, factors, ret).groupBy("factor").agg(F.avg("ic").alias("_m"), F.count(F.lit(1)).alias("_k"), F.sum("n").alias("_n")))
    # one row per factor; only those with too few dates are pooled
    rich = per.where(C("_k") >= min_dates)
    rest = long_factors(d, factors, [SYMBOL, ret]).join(rich.select("factor"), "factor", "left_anti")
    pool = spearman_by(rest, CrossSection(pooled=True), ["factor"], "value", ret)
    j = pool.join(rich, "factor", "full")
    use = C("_k").isNotNull()
    ic = F.when(use, C("_m")).otherwise(C("ic"))
    return j.select("factor", ic.alias("ic"), F.when(use, C("_n")).otherwise(C("n")).alias("evaluable_count"), direction(ic).alias("direction"))


def rolling_ic(per_date: DataFrame, days: int, min_dates: int = 3) -> DataFrame:
    """Mean IC of the trailing window, bounded on both sides, at every date with an IC."""
    day = F.datediff(C(DATE), F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy("factor").orderBy(day).rangeBetween(-days, 0)  # one row per date
    d = per_date.select(
        "factor",
        C(DATE).alias("window_end"),
        F.avg("ic").over(w).alias("ic"),
        F.count(F.lit(1)).over(w).alias("_k"),
        F.sum("n").over(w).alias("sample_count"),
    )
    return d.where(C("_k") >= min_dates).drop("_k")


def adjust_weights(df: DataFrame, by: list[str], factor: float = 0.5, extra: Column | None = None) -> DataFrame:
    """Damp weak (x0.5) and inverse (x0.25) factors, rescale to the original total.

    ``df`` has (by, factor, base_weight, direction); a group holds a handful of factors.
    """
    m = F.when(C("direction") == "weak", factor).when(C("direction") == "inverse", factor**2).otherwise(1.0)
    a = C("base_weight") * m * (F.lit(1.0) if extra is None else extra)
    w = Window.partitionBy(*by)
    d = df.withColumn("_a", a)
    tot = F.sum("_a").over(w)
    return d.withColumn("adjusted_weight", F.when(tot > 0, C("_a") * F.sum("base_weight").over(w) / F.when(tot > 0, tot)).otherwise(C("_a"))).drop("_a")


def ic_action(ic: Column, n: Column, weak: float = 0.02, min_samples: int = 50, dampen: bool = False) -> Column:
    """What to do with a score given its IC."""
    return (
        F.when(ic.isNull(), "kept")
        .when(n < min_samples, "kept_low_samples")
        .when(ic > weak, "kept")
        .when(ic < -weak, "flipped")
        .otherwise("dampen" if dampen else "neutralized")
    )


def transformed(score: Column, action: Column) -> Column:
    s = F.when(action == "flipped", F.greatest(F.least(1 - score, F.lit(1.0)), F.lit(0.0)))
    return s.when(action == "neutralized", 0.5).otherwise(score)


def enforceable_ic(rolling: DataFrame, as_of: Column, budget: Column | int, min_windows: int = 3, min_samples: int = 100) -> DataFrame:
    """Mean IC of the last windows per (mode, factor) and why it may not be enforced."""
    w = Window.partitionBy("mode", "factor").orderBy(F.desc("window_end"))
    d = rolling.withColumns({"_rn": F.row_number().over(w), "_cnt": F.count(F.lit(1)).over(Window.partitionBy("mode", "factor"))})
    g = d.where(C("_rn") <= min_windows).groupBy("mode", "factor").agg(
        F.avg("ic").alias("ic"),
        F.max("window_end").alias("window_end"),
        F.max("_cnt").alias("window_count"),
        F.min("sample_count").alias("min_sample_count"),
    )
    stale = F.datediff(as_of, C("window_end")).cast("long")
    reason = (
        F.when(stale > budget, "stale_window")
        .when(C("window_count") < min_windows, "insufficient_windows")
        .when(C("min_sample_count") < min_samples, "insufficient_samples")
        .otherwise("ok")
    )
    return g.withColumns({"staleness_days": stale, "reason": reason}).withColumn("enforceable", C("reason") == "ok")


def blocked(verdicts: DataFrame, threshold: float = -0.05, need_enforceable: bool = True) -> DataFrame:
    """Modes whose (enforceable) IC is below the threshold."""
    ok = C("enforceable") if need_enforceable else F.lit(True)
    return verdicts.where(ok & (C("ic") < threshold))


# -- outcome statistics ---------------------------------------------------------------


def outcome(df: DataFrame, by: list[str], value: str = "ret") -> DataFrame:
    """Win rate, mean, median and extremes of the known returns."""
    d = df.where(C(value).isNotNull())
    return d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((C(value) > 0).cast("int")).alias("win_rate"),
        F.avg(value).alias("avg_return"),
        F.median(value).alias("median_return"),
        F.max(value).alias("max_return"),
        F.min(value).alias("min_return"),
    )


def decay(df: DataFrame, by: list[str], cut: Column, value: str, min_win: float = 0.4, min_ret: float = 0.0) -> DataFrame:
    """Recent against earlier outcomes, in one aggregation."""
    r, known = C(DATE) >= cut, C(value).isNotNull()
    win = (C(value) > 0).cast("double")
    g = df.where(known).groupBy(*by).agg(
        F.count_if(r).alias("recent_count"),
        F.avg(F.when(r, win)).alias("recent_win_rate"),
        F.avg(F.when(r, C(value))).alias("recent_avg_return"),
        F.count_if(~r).alias("historical_count"),
        F.avg(F.when(~r, win)).alias("_hw"),
        F.avg(F.when(~r, C(value))).alias("_hr"),
    )
    g = g.where(C("recent_count") > 0)
    g = g.withColumns({"historical_win_rate": F.coalesce("_hw", "recent_win_rate"), "historical_avg_return": F.coalesce("_hr", "recent_avg_return")})
    return g.withColumns(
        {
            "win_rate_decay": (C("recent_win_rate") - C("historical_win_rate")) * 100,
            "return_decay": (C("recent_avg_return") - C("historical_avg_return")) * 100,
            "is_decaying": (C("recent_win_rate") < min_win) | (C("recent_avg_return") < min_ret),
        }
    ).drop("_hw", "_hr")


# -- ablation ---------------------------------------------------------------------------


def ablated_scores(df: DataFrame, dims: list[str], weight, score) -> DataFrame:
    """One row per (record, removed dimension) with the composite of the remaining ones.

    ``weight(dim)`` and ``score(dim)`` are Columns; only dimensions with weight are removed.
    """
    # a row's weights are looked up once
    df = df.withColumns({f"_w_{d}": weight(d) for d in dims})
    df = df.withColumns({f"_ws_{d}": C(f"_w_{d}") * score(d) for d in dims})
    total = sum((C(f"_w_{d}") for d in dims), F.lit(0.0))
    full = sum((C(f"_ws_{d}") for d in dims), F.lit(0.0))
    rows = F.array(*[F.struct(F.lit(d).alias("removed"), C(f"_w_{d}").alias("w"), C(f"_ws_{d}").alias("ws")) for d in dims])
    rows = F.filter(rows, lambda r: r["w"] > 0)
    d = df.withColumns({"_t": total, "_f": full}).withColumn("_r", F.explode(rows)).drop(*[f"_{k}_{d}" for k in ("w", "ws") for d in dims])
    rest = C("_t") - C("_r.w")
    ab = F.round((C("_f") - C("_r.ws")) / F.when(rest > 1e-12, rest), 9)
    return d.withColumns({"removed": C("_r.removed"), "ablated_score": F.coalesce(ab, F.lit(0.0))}).drop("_t", "_f", "_r")


def ablation_stats(df: DataFrame, xs: CrossSection, by: list[str], top_n: int = 20) -> DataFrame:
    """Rank correlation and rank shifts per removed dimension (needs baseline pool_rank)."""
    d = xs.row_rank(df, [*by, "removed"], "ablated_score", "ablated_rank")
    shift = F.abs(C("ablated_rank") - C("pool_rank"))
    return d.groupBy(*by, "removed").agg(
        corr("pool_rank", "ablated_rank").alias("rank_correlation"),
        F.avg(shift).alias("mean_rank_shift"),
        F.max(shift).alias("max_rank_shift"),
        F.count_if((C("pool_rank") <= top_n) & (C("ablated_rank") > top_n)).alias("n_dropped"),
        F.count_if((C("pool_rank") > top_n) & (C("ablated_rank") <= top_n)).alias("n_added"),
        F.count(F.lit(1)).alias("n"),
    )


# -- studies ------------------------------------------------------------------------------


def t_stat(value) -> Column:
    """J33."""
    return F.avg(value) / F.when(F.stddev_samp(value) > 0, F.stddev_samp(value)) * F.sqrt(F.count(value))


def buckets(df: DataFrame, xs: CrossSection, by: list[str], value: str, n: int = 5, out: str = "bucket") -> DataFrame:
    """Quantile buckets 1..n with linear-interpolation edges (right-closed)."""
    d = xs.with_quantiles(df, by, {f"_e{i}": (value, i / n) for i in range(1, n)})
    b = F.lit(1)
    for i in range(1, n):
        b = b + F.when(C(value) > C(f"_e{i}"), 1).otherwise(0)
    return d.withColumn(out, F.when(C(value).isNotNull(), b).cast("long")).drop(*[f"_e{i}" for i in range(1, n)])


def pair_corr(returns: DataFrame, left: DataFrame, right: DataFrame, min_obs: int = 10) -> DataFrame:
    """Return correlation of the named pairs (left symbols x right symbols of one group).

    ``left`` and ``right`` hold (group, symbol); rows meet on (group, date).
    """
    a = returns.join(left, SYMBOL).select("group", DATE, C(SYMBOL).alias("a"), C("r").alias("ra"))
    b = returns.join(right, SYMBOL).select("group", DATE, C(SYMBOL).alias("b"), C("r").alias("rb"))
    g = a.join(b, ["group", DATE]).where(C("a") != C("b")).groupBy("group", "a", "b")
    return g.agg(corr("ra", "rb").alias("rho"), F.count(F.lit(1)).alias("n")).where(C("n") > min_obs)
