"""Rolling features, technical indicators, signals (one pass over all symbols)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import DATE, SYMBOL, corr, div, symbol_window, trailing
from ..functions.timeseries import ret, rolling, smooth

W = symbol_window


def feature_columns(bars: DataFrame) -> DataFrame:
    """Moving averages, momentum, volatility and turnover features with warm-up gates."""
    c, v, t, h = (F.col(x) for x in ("close", "volume", "turnover", "high"))
    df = bars.withColumn("_r", ret("close", 1))
    df = df.withColumns(
        {
            "ma20": rolling(F.avg(c), c, 20, 10),
            "ma60": rolling(F.avg(c), c, 60, 30),
            "volume_ma20": rolling(F.avg(v), v, 20, 10),
            "turnover_ma5": rolling(F.avg(t), t, 5, 3),
            "turnover_ma20": rolling(F.avg(t), t, 20, 10),
            "momentum_20d": ret("close", 20) * 100,
            "volatility_20d": rolling(F.stddev_samp("_r"), F.col("_r"), 20, 10) * (252**0.5 * 100),
            "high_20d": rolling(F.max(h), h, 20, 10),
        }
    )
    return df.withColumn("turnover_ratio_5d_20d", div("turnover_ma5", "turnover_ma20")).drop("_r")


def sma(df: DataFrame, *periods: int, price: str = "close") -> DataFrame:
    return df.withColumns({f"sma_{n}": rolling(F.avg(price), F.col(price), n) for n in periods})


def rsi(df: DataFrame, out: str = "rsi_14", n: int = 14, *, price: str = "close", seeded: bool = False, rows: int | None = None) -> DataFrame:
    """Relative strength with alpha = 1/n smoothing.

    ``seeded`` starts from the mean of the first n moves (Wilder); otherwise the first row
    contributes a zero move and values appear from row n on.  ``rows`` as in ``smooth``.
    """
    d = F.col(price) - F.lag(price).over(W())
    zero = F.lit(None).cast("double") if seeded else F.lit(0.0)
    df = df.withColumns(
        {
            "_g": F.when(d.isNull(), zero).when(d > 0, d).otherwise(0.0),
            "_l": F.when(d.isNull(), zero).when(d < 0, -d).otherwise(0.0),
        }
    )
    df = smooth(df, {"_ag": ("_g", 1.0 / n), "_al": ("_l", 1.0 / n)}, seed=n if seeded else 0, rows=rows)
    ag, al = F.col("_ag"), F.col("_al")
    full = F.lit(100.0) if seeded else F.when(ag > 0, 100.0).otherwise(50.0)
    value = F.when(al < 1e-10, full).otherwise(100.0 - 100.0 / (1.0 + ag / F.when(al >= 1e-10, al)))
    if not seeded:
        value = F.when(F.row_number().over(W()) >= n, value)
    return df.withColumn(out, F.when(ag.isNotNull(), value)).drop("_g", "_l", "_ag", "_al")


def macd(
    df: DataFrame,
    fast: int = 12,
    slow: int = 26,
    signal: int = 9,
    *,
    value: str = "close",
    prefix: str = "macd",
    warmup: bool = True,
    rows: int | None = None,
) -> DataFrame:
    """Difference of two exponential means, its signal line and histogram; ``rows`` as in ``smooth``."""
    a = lambda n: 2.0 / (n + 1)
    df = smooth(df, {"_f": (value, a(fast)), "_s": (value, a(slow))}, rows=rows)
    line = F.col("_f") - F.col("_s")
    if warmup:
        line = F.when(F.row_number().over(W()) >= slow, line)
    df = df.withColumn(prefix, line).drop("_f", "_s")
    df = smooth(df, {f"{prefix}_signal": (prefix, a(signal))}, rows=rows)
    if warmup:
        seen = F.count(prefix).over(trailing(1 << 30))
        df = df.withColumn(f"{prefix}_signal", F.when(seen >= signal, F.col(f"{prefix}_signal")))
    return df.withColumn(f"{prefix}_hist", F.col(prefix) - F.col(f"{prefix}_signal"))


def bollinger(df: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    c = F.col("close")
    df = df.withColumns({"bb_middle": rolling(F.avg(c), c, n), "_sd": rolling(F.stddev_pop(c), c, n)})
    return df.withColumns(
        {"bb_upper": F.col("bb_middle") + k * F.col("_sd"), "bb_lower": F.col("bb_middle") - k * F.col("_sd")}
    ).drop("_sd")


def true_range(first_row: bool = True) -> Column:
    """Largest of bar range and distance to the previous close."""
    p = F.lag("close").over(W())
    h, lo = F.col("high"), F.col("low")
    gap = F.greatest(h - lo, F.abs(h - p), F.abs(lo - p))
    return F.when(p.isNull(), h - lo if first_row else None).otherwise(gap)


def adx(df: DataFrame, n: int = 14) -> DataFrame:
    """Average directional index, with both directional lines (Wilder seeding twice)."""
    up = F.col("high") - F.lag("high").over(W())
    dn = F.lag("low").over(W()) - F.col("low")
    df = df.withColumns(
        {
            "_tr": true_range(first_row=False),
            "_pd": F.when(up.isNotNull(), F.when((up > dn) & (up > 0), up).otherwise(0.0)),
            "_md": F.when(dn.isNotNull(), F.when((dn > up) & (dn > 0), dn).otherwise(0.0)),
        }
    )
    a = 1.0 / n
    df = smooth(df, {"_str": ("_tr", a), "_spd": ("_pd", a), "_smd": ("_md", a)}, seed=n)
    df = df.withColumns({"plus_di": 100 * div("_spd", "_str"), "minus_di": 100 * div("_smd", "_str")})
    p, m = F.col("plus_di"), F.col("minus_di")
    df = df.withColumn("_dx", F.when(p.isNotNull(), F.coalesce(100 * F.abs(p - m) / F.when(p + m != 0, p + m), F.lit(0.0))))
    df = smooth(df, {f"adx_{n}": ("_dx", a)}, seed=n)
    return df.drop("_tr", "_pd", "_md", "_str", "_spd", "_smd", "_dx")


def indicators(bars: DataFrame) -> DataFrame:
    """The wide indicator set."""
    return adx(bollinger(macd(rsi(sma(bars, 5, 10, 20, 60)))))


WIDE = ["sma_5", "sma_10", "sma_20", "sma_60", "rsi_14", "macd", "macd_signal", "macd_hist", "bb_upper", "bb_middle", "bb_lower", "adx_14"]


def indicators_long(bars: DataFrame) -> DataFrame:
    """One row per (symbol, date, name), missing values left out."""
    wide = indicators(bars).select(SYMBOL, DATE, *WIDE)
    return wide.unpivot([SYMBOL, DATE], WIDE, "name", "value").where(F.col("value").isNotNull())


def friday_week(d) -> Column:
    """Friday that ends the week of ``d`` (Saturday and Sunday belong to the next one)."""
    return F.next_day(F.date_sub(d, 1), "FRI")


def weekly(daily: DataFrame, min_weeks: int = 3, *, week_end: str | None = None, deal=None, rows: int | None = None) -> DataFrame:
    """Friday weeks with SMA13, RSI14 and MACD; symbols below ``min_weeks`` are dropped.

    ``week_end`` names the column with the week's Friday if rows have it, ``deal`` deals weekly rows out by symbol, and
    ``rows`` is as in ``smooth``.
    """
    w = daily.groupBy(SYMBOL, (F.col(week_end) if week_end else friday_week(F.col(DATE))).alias("week_end")).agg(
        F.min_by("open", DATE).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", DATE).alias("close"),
        F.sum("volume").alias("volume"),
    )
    w = deal(w) if deal else w
    w = w.withColumnRenamed("week_end", DATE).withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy(SYMBOL)))
    w = w.where(F.col("_k") >= min_weeks).drop("_k")
    return macd(rsi(sma(w, 13), rows=rows), rows=rows)


def rsi_latest(bars: DataFrame) -> DataFrame:
    """E5: RSI of every row, 50 below 15 rows of history."""
    df = rsi(bars).withColumn("_k", F.row_number().over(W()))
    return df.withColumn("rsi", F.when(F.col("_k") < 15, 50.0).otherwise(F.col("rsi_14"))).drop("_k")


def atr(bars: DataFrame, n: int = 14, out: str = "atr14") -> DataFrame:
    """Mean of the last (up to) n true ranges; 0 without a previous close."""
    df = bars.withColumn("_tr", true_range(first_row=False))
    return df.withColumn(out, F.coalesce(F.avg("_tr").over(trailing(n)), F.lit(0.0))).drop("_tr")


def decayed_flow(flows: DataFrame, n: int = 10, decay: float = 0.85) -> DataFrame:
    """Sum of net * decay^age over the last n dates of each symbol."""
    s = None
    for i in range(n):
        term = F.coalesce(F.lag("total_net", i).over(W()), F.lit(0.0)) * decay**i
        s = term if s is None else s + term
    return flows.withColumn("inst_flow_weighted", s)


def flow_macd(flows: DataFrame, fast: int = 5, slow: int = 20, signal: int = 5, *, rows: int | None = None) -> DataFrame:
    """Six-level score from the MACD of daily net flow; 0.5 until ``slow`` rows exist."""
    df = macd(flows, fast, slow, signal, value="total_net", prefix="cm", warmup=False, rows=rows)
    eps = 1e-6
    m, h = F.col("cm"), F.col("cm_hist")
    rising = h > F.coalesce(F.lag("cm_hist").over(W()), F.lit(0.0)) + eps
    score = (
        F.when(F.row_number().over(W()) < slow, 0.5)
        .when((m > eps) & (h > eps) & rising, 1.0)
        .when((m > eps) & (h > eps), 0.7)
        .when(m >= -eps, 0.5)
        .when(h > eps, 0.3)
        .otherwise(0.1)
    )
    return df.withColumn("chip_macd_score", score)


def revenue_pivot(revenue: DataFrame) -> DataFrame:
    """Growth of this, the previous and the third-last row side by side."""
    return revenue.withColumns(
        {
            "prev_yoy": F.lag("yoy_growth", 1).over(W()),
            "prev_mom": F.lag("mom_growth", 1).over(W()),
            "yoy_3m_ago": F.lag("yoy_growth", 3).over(W()),
        }
    )


def volume_price_divergence(bars: DataFrame, n: int = 5) -> DataFrame:
    """Correlation of price and volume changes over n rows, mapped to a bonus."""
    df = bars.withColumns({"_dc": ret("close", 1), "_dv": ret("volume", 1)})
    w = trailing(n)
    flat = (F.stddev_samp("_dc").over(w) == 0) | (F.stddev_samp("_dv").over(w) == 0)
    df = df.withColumns({"_k": F.row_number().over(W()), "_flat": flat})
    df = df.withColumn("_corr", F.when((F.col("_k") >= n + 2) & ~F.col("_flat"), corr("_dc", "_dv", w)))
    c = F.round("_corr", 12)
    adj = F.when(c < -0.3, -0.05).when(c < 0, -0.02).when(c >= 0.3, 0.02).otherwise(0.0)
    return df.withColumn("vp_divergence", adj).drop("_dc", "_dv", "_k", "_flat").withColumnRenamed("_corr", "vp_corr")


def momentum_decay(bars: DataFrame, look: int = 5, *, rows: int | None = None) -> DataFrame:
    """Bearish RSI divergence and a shrinking positive histogram, 0 / -.03 / -.06."""
    df = macd(rsi(bars, "_rsi", seeded=True, rows=rows), prefix="_m", warmup=False, rows=rows)
    df = df.withColumns(
        {
            "_k": F.row_number().over(W()),
            "_h1": F.max("high").over(W().rowsBetween(-(look - 1), 0)),
            "_h0": F.max("high").over(W().rowsBetween(-(2 * look - 1), -look)),
            "_r1": F.max("_rsi").over(W().rowsBetween(-look, 0)),
            "_r0": F.max("_rsi").over(W().rowsBetween(-2 * look, -(look + 1))),
            "_p1": F.lag("_m_hist", 1).over(W()),
            "_p2": F.lag("_m_hist", 2).over(W()),
        }
    )
    diverging = F.coalesce((F.col("_h1") > F.col("_h0")) & (F.col("_r1") < F.col("_r0")), F.lit(False))
    h, p1, p2 = F.col("_m_hist"), F.col("_p1"), F.col("_p2")
    shrinking = F.coalesce((h > 0) & (p1 > 0) & (h < p1) & (p1 < p2), F.lit(False))
    hits = diverging.cast("int") + shrinking.cast("int")
    value = F.when(F.col("_k") < 40, 0.0).when(hits == 2, -0.06).when(hits == 1, -0.03).otherwise(0.0)
    drop = ["_rsi", "_m", "_m_signal", "_m_hist", "_k", "_h1", "_h0", "_r1", "_r0", "_p1", "_p2"]
    return df.withColumn("momentum_decay", value).drop(*drop)


def flow_acceleration(flows: DataFrame, n: int = 10, recent: int = 3) -> DataFrame:
    """Mean of the last rows against the rows before them, as a bonus."""
    a = F.avg("total_net").over(W().rowsBetween(-(recent - 1), 0))
    b = F.avg("total_net").over(W().rowsBetween(-(n - 1), -recent))
    df = flows.withColumns({"_a": a, "_b": b, "_k": F.row_number().over(W())})
    ratio = F.when(F.col("_b") <= 0, 1.0).otherwise(F.col("_a") / F.when(F.col("_b") > 0, F.col("_b")) - 1)
    bonus = (
        F.when((F.col("_k") < n) | (F.col("_a") <= 0), 0.0).when(ratio > 0.5, 0.04).when(ratio > 0, 0.02).otherwise(0.0)
    )
    return df.withColumn("inst_accel_bonus", bonus).drop("_a", "_b", "_k")


def contraction(bars: DataFrame, max_range: float = 0.08, max_volume: float = 0.8) -> DataFrame:
    """Narrow 10-row price range with dried-up volume earns .03."""
    c = F.col("close")
    w10, w3 = trailing(10), trailing(3)
    df = bars.withColumns(
        {
            "vcp_range": div(F.max(c).over(w10) - F.min(c).over(w10), F.avg(c).over(w10)),
            "vcp_volume": div(F.avg("volume").over(w3), F.avg("volume").over(trailing(20))),
        }
    )
    ok = (F.col("vcp_range") < max_range) & (F.col("vcp_volume") < max_volume)
    return df.withColumn("vcp_bonus", F.when(ok, 0.03).otherwise(0.0))


def adaptive_stop(bars: DataFrame, base: float = 1.5, n: int = 20) -> DataFrame:
    """Worst fall from a running peak inside the last n rows -> stop multiplier."""
    w = trailing(n)
    closes = F.collect_list("close").over(w)  # at most n values
    state = F.struct(F.lit(0.0).alias("peak"), F.lit(0.0).alias("dd"))
    def step(s, x):
        peak = F.greatest(s["peak"], x)
        return F.struct(peak.alias("peak"), F.greatest(s["dd"], (peak - x) / peak).alias("dd"))
    df = bars.withColumns({"_w": closes})
    df = df.withColumn("mdd_pct", F.when(F.size("_w") >= 5, F.aggregate("_w", state, step, lambda s: s["dd"])).otherwise(0.0))
    m = F.col("mdd_pct")
    mult = F.when(F.size("_w") < 5, base).when(m < 0.05, base * 1.2).when(m < 0.10, base).when(m < 0.15, base * 0.85).otherwise(base * 0.7)
    return df.withColumn("adjusted_stop_mult", mult).drop("_w")


def timeframe_alignment(daily_bullish: Column, weekly_bonus: Column) -> Column:
    """Agreement of the daily and the weekly trend."""
    up, dn = weekly_bonus > 0, weekly_bonus < 0
    return F.when(daily_bullish & up, 0.04).when(~daily_bullish & dn, -0.03).when(daily_bullish & dn, -0.02).when(~daily_bullish & up, -0.02).otherwise(0.0)


def weekly_trend_bonus(week: DataFrame) -> DataFrame:
    """Close above SMA13 with RSI > 50 earns +.05, both below cost -.05."""
    up = (F.col("close") > F.col("sma_13")) & (F.col("rsi_14") > 50)
    dn = (F.col("close") < F.col("sma_13")) & (F.col("rsi_14") < 50)
    return week.withColumn("weekly_bonus", F.when(up, 0.05).when(dn, -0.05).otherwise(0.0))


def drawdown_from_high(series: DataFrame, n: int = 20, *, key=SYMBOL, out: str = "drawdown_20d") -> DataFrame:
    """Last close against the highest close of n rows."""
    top = F.max("close").over(trailing(n, key=key))
    return series.withColumn(out, F.col("close") / top - 1)


def breakout_bonus(bars: DataFrame) -> DataFrame:
    """Cross above the 60-row mean after five rows below it, or a box breakout."""
    below = F.max("close").over(W().rowsBetween(-6, -2))
    df = bars.withColumns(
        {
            "_k": F.row_number().over(W()),
            "_m60": F.avg("close").over(trailing(60)),
            "_below": below,
            "_v20": F.avg("volume").over(W().rowsBetween(-20, -1)),
            "_hi": F.max("high").over(W().rowsBetween(-20, -1)),
            "_lo": F.min("low").over(W().rowsBetween(-20, -1)),
            "_tr": true_range(first_row=False),
        }
    )
    df = df.withColumn("_atr", F.avg("_tr").over(trailing(20)))
    cross = (F.col("_k") >= 66) & (F.col("_below") < F.col("_m60")) & (F.col("close") > F.col("_m60")) & (F.col("volume") > F.col("_v20") * 1.5)
    box = (F.col("_k") >= 21) & (F.col("_hi") - F.col("_lo") < F.col("_atr") * 3) & (F.col("close") > F.col("_hi"))
    bonus = F.when(cross, 0.04).when(box, 0.03).otherwise(0.0)
    return df.withColumn("breakout_bonus", bonus).drop("_k", "_m60", "_below", "_v20", "_hi", "_lo", "_tr", "_atr")


# -- signals -------------------------------------------------------------------


def _cross(diff: Column) -> Column:
    """+1 when ``diff`` turns positive, -1 when it turns negative."""
    p = F.lag(diff).over(W())
    return F.when((p <= 0) & (diff > 0), 1).when((p >= 0) & (diff < 0), -1).otherwise(0).cast("long")


def signal_sma_cross(bars: DataFrame, fast: int = 10, slow: int = 20) -> DataFrame:
    df = sma(bars, fast, slow).withColumn("_d", F.col(f"sma_{fast}") - F.col(f"sma_{slow}"))
    return df.withColumn("signal", _cross(F.col("_d"))).drop("_d")


def signal_rsi(df: DataFrame, low: float = 30, high: float = 70) -> DataFrame:
    """Up through ``low`` buys, down through ``high`` sells (needs rsi_14)."""
    x, p = F.col("rsi_14"), F.lag("rsi_14").over(W())
    sig = F.when((p <= low) & (x > low), 1).when((p >= high) & (x < high), -1).otherwise(0)
    return df.withColumn("signal", sig.cast("long"))


def signal_bands(df: DataFrame) -> DataFrame:
    """Back inside the lower band buys, back inside the upper band sells."""
    c, p = F.col("close"), F.lag("close").over(W())
    lo, plo = F.col("bb_lower"), F.lag("bb_lower").over(W())
    hi, phi = F.col("bb_upper"), F.lag("bb_upper").over(W())
    sig = F.when((p <= plo) & (c > lo), 1).when((p >= phi) & (c < hi), -1).otherwise(0)
    return df.withColumn("signal", sig.cast("long"))


def signal_macd(df: DataFrame) -> DataFrame:
    return df.withColumn("_d", F.col("macd") - F.col("macd_signal")).withColumn("signal", _cross(F.col("_d"))).drop("_d")


def signal_buy_hold(bars: DataFrame) -> DataFrame:
    first = F.lag("close").over(W()).isNull()
    last = F.lead("close").over(W()).isNull()
    return bars.withColumn("signal", F.when(first, 1).when(last, -1).otherwise(0).cast("long"))


def signal_votes(df: DataFrame, weights=None, buy: float = 0.3, sell: float = -0.3) -> DataFrame:
    """Weighted -1/0/1 votes of RSI, MACD, flow and revenue (revenue carried forward)."""
    wt = weights or {"rsi": 0.3, "macd": 0.3, "flow": 0.2, "revenue": 0.2}
    vote = lambda up, dn: F.when(up, 1.0).when(dn, -1.0).otherwise(0.0)
    r, d = F.col("rsi_14"), F.col("macd") - F.col("macd_signal")
    n, y = F.col("total_net"), F.last("yoy_growth", ignorenulls=True).over(trailing(1 << 30))
    df = df.withColumn("_y", y)
    score = (
        vote(r < 30, r > 70) * wt["rsi"]
        + vote(d > 0, d < 0) * wt["macd"]
        + vote(n > 0, n < 0) * wt["flow"]
        + vote(F.col("_y") > 20, F.col("_y") < 0) * wt["revenue"]
    )
    df = df.withColumn("vote_score", F.round(score, 9))
    sig = F.when(F.col("vote_score") > buy, 1).when(F.col("vote_score") < sell, -1).otherwise(0)
    return df.withColumn("signal", sig.cast("long")).drop("_y")


def back_adjust(bars: DataFrame, events: DataFrame) -> DataFrame:
    """Scale prices before each ex-date; events (symbol, date, cash, stock) hit bar dates."""
    df = bars.join(events, [SYMBOL, DATE], "left")
    prev = F.lag("close").over(W())
    f = (prev - F.coalesce(F.col("cash"), F.lit(0.0))) / F.when(prev > 0, prev)
    f = f / (1 + F.coalesce(F.col("stock"), F.lit(0.0)) / 10)
    df = df.withColumn("_f", F.when((F.col("cash").isNotNull() | F.col("stock").isNotNull()) & (f > 0) & (f < 1.5), f).otherwise(1.0))
    later = W().rowsBetween(1, Window.unboundedFollowing)
    df = df.withColumn("adj_factor", F.coalesce(F.product("_f").over(later), F.lit(1.0)))
    raw = {f"raw_{c}": F.col(c) for c in ("open", "high", "low", "close")}
    df = df.withColumns(raw)
    return df.withColumns({c: F.col(c) * F.col("adj_factor") for c in ("open", "high", "low", "close")}).drop("_f", "cash", "stock")


def position_series(bars: DataFrame, calendar: DataFrame, n: int = 30) -> DataFrame:
    """Closes on the last n calendar dates per symbol and where its gap-free tail starts.

    ``calendar`` has (date, ordinal), ordinal 0 = latest date.
    """
    cal = calendar.where(F.col("ordinal") < n)
    df = bars.join(cal, DATE).select(SYMBOL, "ordinal", "close")
    w = Window.partitionBy(SYMBOL).orderBy("ordinal")
    df = df.withColumn("_tail", F.col("ordinal") - F.row_number().over(w) + 1)
    return df.groupBy(SYMBOL).agg(
        F.count(F.lit(1)).alias("n_points"),
        F.sum(F.when(F.col("_tail") == 0, 1).otherwise(0)).alias("tail_len"),
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("ordinal")).alias("o"), "close"))), lambda s: s["close"]).alias("closes"),
    )


def drawdown_series(df: DataFrame, value: str, *, key=SYMBOL) -> DataFrame:
    """Distance from the running peak in percent."""
    peak = F.max(value).over(trailing(1 << 30, key=key))
    return df.withColumn("drawdown_pct", (peak - F.col(value)) / peak * 100)


def study_features(bars: DataFrame, flows: DataFrame) -> DataFrame:
    """Flow to volume ratio, 5-row return, median-volume liquidity, forward returns from t+1."""
    df = bars.join(flows.select(SYMBOL, DATE, "foreign_net"), [SYMBOL, DATE], "left")
    w5 = trailing(5)
    df = df.withColumns(
        {
            "flow_ratio": div(F.sum(F.coalesce("foreign_net", F.lit(0.0))).over(w5), F.sum("volume").over(w5)),
            "ret5": ret("close", 5),
            "_e": F.lead("open", 1).over(W()),
            "median_volume": F.percentile("volume", F.lit(0.5)).over(Window.partitionBy(SYMBOL)),
        }
    )
    for h in (5, 10, 20):
        df = df.withColumn(f"fwd_{h}", F.lead("close", h).over(W()) / F.col("_e") - 1)
    return df.drop("_e")
