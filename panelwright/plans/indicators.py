"""E: features, indicators, signals."""

from pyspark.sql import functions as F

from ..operators import indicators as ind
from ..functions.exprs import rnd
from .ctes import cte, ewm_sql, rnd_sql
from .registry import plan

WN = "WINDOW w AS (PARTITION BY symbol ORDER BY date)"


def roll(agg: str, arg: str, n: int, k: int | None = None) -> str:
    over = f"OVER (PARTITION BY symbol ORDER BY date ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({arg}) {over} >= {n if k is None else k} THEN {agg}({arg}) {over} END"


cte("bars_r", "SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS r1 FROM bars_p")
cte("features_p", f"""SELECT * EXCLUDE r1, turnover_ma5 / nullif(turnover_ma20, 0) AS turnover_ratio_5d_20d FROM (
  SELECT *, {roll('avg', 'close', 20, 10)} AS ma20, {roll('avg', 'close', 60, 30)} AS ma60,
  {roll('avg', 'volume', 20, 10)} AS volume_ma20, {roll('avg', 'turnover', 5, 3)} AS turnover_ma5,
  {roll('avg', 'turnover', 20, 10)} AS turnover_ma20,
  (close / lag(close, 20) OVER (PARTITION BY symbol ORDER BY date) - 1) * 100 AS momentum_20d,
  ({roll('stddev_samp', 'r1', 20, 10)}) * sqrt(252.0) * 100 AS volatility_20d,
  {roll('max', 'high', 20, 10)} AS high_20d FROM bars_r)""")

FEAT = "ma20 ma60 volume_ma20 turnover_ma5 turnover_ma20 momentum_20d volatility_20d high_20d turnover_ratio_5d_20d"


@plan("e01_feature_columns", "SELECT symbol, date, ma20, ma60, volume_ma20, turnover_ma5, turnover_ma20, momentum_20d, volatility_20d, high_20d, turnover_ratio_5d_20d FROM features_p", FEAT)
def _(p):
    cols = [c.split(":")[0] for c in FEAT.split()]
    return ind.feature_columns(p.bars()).select("symbol", "date", *cols)


# indicator twins: plain step-by-step recurrences
cte("moves_p", """SELECT *, coalesce(greatest(close - pc, 0), 0) AS g, coalesce(greatest(pc - close, 0), 0) AS l FROM (
  SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS pc FROM bars_p)""")
ewm_sql("gl_p", "moves_p", {"ag": ("g", 1 / 14), "al": ("l", 1 / 14), "ef": ("close", 2 / 13), "es": ("close", 2 / 27)})
cte("macd_in", "SELECT symbol, date, ef - es AS m FROM gl_p WHERE rn >= 26")
ewm_sql("macd_s", "macd_in", {"sg": ("m", 0.2)})
cte("wilder_in", """SELECT symbol, date, k, {c} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k FROM bars_p)""".replace("{c}", "close"))
cte("dm_p", """SELECT symbol, date, row_number() OVER w AS k,
    greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr,
    CASE WHEN high - lag(high) OVER w > lag(low) OVER w - low AND high > lag(high) OVER w THEN high - lag(high) OVER w ELSE 0 END AS pd,
    CASE WHEN lag(low) OVER w - low > high - lag(high) OVER w AND lag(low) OVER w > low THEN lag(low) OVER w - low ELSE 0 END AS md
  FROM bars_p WINDOW w AS (PARTITION BY symbol ORDER BY date)""")
cte("dm_seed", """SELECT symbol, date,
    CASE WHEN k = 15 THEN avg(tr) OVER w ELSE tr END AS tr, CASE WHEN k = 15 THEN avg(pd) OVER w ELSE pd END AS pd,
    CASE WHEN k = 15 THEN avg(md) OVER w ELSE md END AS md, k FROM dm_p WHERE k > 1
    WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 13 PRECEDING) QUALIFY k >= 15""")
ewm_sql("dms_p", "dm_seed", {"str": ("tr", 1 / 14), "spd": ("pd", 1 / 14), "smd": ("md", 1 / 14)})
cte("dx_p", """SELECT symbol, date, pdi, mdi, coalesce(100 * abs(pdi - mdi) / nullif(pdi + mdi, 0), 0) AS dx, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k
  FROM (SELECT symbol, date, 100 * spd / nullif(str, 0) AS pdi, 100 * smd / nullif(str, 0) AS mdi FROM dms_p)""")
cte("dx_seed", """SELECT symbol, date, CASE WHEN k = 14 THEN avg(dx) OVER (PARTITION BY symbol ORDER BY date ROWS 13 PRECEDING) ELSE dx END AS dx FROM dx_p QUALIFY k >= 14""")
ewm_sql("adx_p", "dx_seed", {"adx": ("dx", 1 / 14)})
RSI = "CASE WHEN al < 1e-10 THEN CASE WHEN ag > 0 THEN 100.0 ELSE 50.0 END ELSE 100 - 100 / (1 + ag / al) END"
cte("ind_p", f"""SELECT g.symbol, g.date, g.open, g.high, g.low, g.close, g.volume, g.turnover, g.rn,
    {roll('avg', 'g.close', 5).replace('symbol', 'g.symbol').replace('BY date', 'BY g.date')} AS sma_5,
    {roll('avg', 'g.close', 10).replace('symbol', 'g.symbol').replace('BY date', 'BY g.date')} AS sma_10,
    {roll('avg', 'g.close', 20).replace('symbol', 'g.symbol').replace('BY date', 'BY g.date')} AS sma_20,
    {roll('avg', 'g.close', 60).replace('symbol', 'g.symbol').replace('BY date', 'BY g.date')} AS sma_60,
    {roll('stddev_pop', 'g.close', 20).replace('symbol', 'g.symbol').replace('BY date', 'BY g.date')} AS sd_20,
    CASE WHEN g.rn >= 14 THEN {RSI} END AS rsi_14, CASE WHEN g.rn >= 26 THEN ef - es END AS macd,
    CASE WHEN s.rn >= 9 THEN s.sg END AS macd_signal, x.pdi AS plus_di, x.mdi AS minus_di, a.adx AS adx_14
  FROM gl_p g LEFT JOIN macd_s s ON s.symbol = g.symbol AND s.date = g.date
  LEFT JOIN dx_p x ON x.symbol = g.symbol AND x.date = g.date LEFT JOIN adx_p a ON a.symbol = g.symbol AND a.date = g.date""")
cte("indw_p", """SELECT *, macd - macd_signal AS macd_hist, sma_20 + 2 * sd_20 AS bb_upper, sma_20 AS bb_middle, sma_20 - 2 * sd_20 AS bb_lower FROM ind_p""")
WIDE = ", ".join(ind.WIDE)


@plan("e02_indicators_wide", f"SELECT symbol, date, plus_di, minus_di, {WIDE} FROM indw_p", " ".join(ind.WIDE) + " plus_di minus_di")
def _(p):
    return ind.indicators(p.bars()).select("symbol", "date", "plus_di", "minus_di", *ind.WIDE)


@plan("e03_indicators_long", f"""SELECT * FROM (UNPIVOT (SELECT symbol, date, {WIDE} FROM indw_p) ON {WIDE} INTO NAME name VALUE value)""", "value:4")
def _(p):
    return ind.indicators_long(p.bars())


cte("bars_f", """SELECT * FROM (SELECT symbol, wk AS date, first(open ORDER BY date) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY date) AS close,
    sum(volume) AS volume FROM (SELECT *, (date + ((5 - isodow(date) + 7) % 7)::INT)::DATE AS wk FROM bars_d) GROUP BY 1, 2)
  QUALIFY count(*) OVER (PARTITION BY symbol) >= 3""")
cte("fmoves_p", """SELECT *, coalesce(greatest(close - pc, 0), 0) AS g, coalesce(greatest(pc - close, 0), 0) AS l FROM (
  SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS pc FROM bars_f)""")
ewm_sql("fgl_p", "fmoves_p", {"ag": ("g", 1 / 14), "al": ("l", 1 / 14), "ef": ("close", 2 / 13), "es": ("close", 2 / 27)})
cte("fmacd_in", "SELECT symbol, date, ef - es AS m FROM fgl_p WHERE rn >= 26")
ewm_sql("fmacd_s", "fmacd_in", {"sg": ("m", 0.2)})
cte("week_p", f"""SELECT g.symbol, g.date, g.open, g.high, g.low, g.close, g.volume,
    CASE WHEN g.rn >= 13 THEN avg(g.close) OVER (PARTITION BY g.symbol ORDER BY g.date ROWS 12 PRECEDING) END AS sma_13,
    CASE WHEN g.rn >= 14 THEN {RSI} END AS rsi_14, CASE WHEN g.rn >= 26 THEN ef - es END AS macd, CASE WHEN s.rn >= 9 THEN s.sg END AS macd_signal
  FROM fgl_p g LEFT JOIN fmacd_s s ON s.symbol = g.symbol AND s.date = g.date""")


@plan("e04_aggregate_to_weekly", "SELECT *, macd - macd_signal AS macd_hist FROM week_p", "open high low close volume sma_13 rsi_14 macd macd_signal macd_hist")
def _(p):
    return ind.weekly(p.bars_daily())


@plan("e05_rsi_latest", f"SELECT symbol, date, CASE WHEN rn < 15 THEN 50.0 ELSE {RSI} END AS rsi FROM gl_p QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1", "rsi:2")
def _(p):
    d = ind.rsi_latest(p.closes())
    return d.groupBy("symbol").agg(F.max("date").alias("date"), F.max_by("rsi", "date").alias("rsi"))


cte("atr_p", """SELECT *, coalesce(avg(tr) OVER (PARTITION BY symbol ORDER BY date ROWS 13 PRECEDING), 0) AS atr14 FROM (
  SELECT *, CASE WHEN lag(close) OVER w IS NOT NULL THEN greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr
  FROM bars_p WINDOW w AS (PARTITION BY symbol ORDER BY date))""")


@plan("e06_atr14", "SELECT symbol, date, atr14 FROM atr_p", "atr14")
def _(p):
    return ind.atr(p.bars()).select("symbol", "date", "atr14")


@plan("e07_value_weighted_flow", """SELECT a.symbol, a.date, sum(b.total_net * pow(0.85, a.k - b.k)) AS inst_flow_weighted
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k FROM flows_p) a
  JOIN (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k FROM flows_p) b
    ON a.symbol = b.symbol AND b.k BETWEEN a.k - 9 AND a.k GROUP BY 1, 2""", "inst_flow_weighted")
def _(p):
    return ind.decayed_flow(p.flows()).select("symbol", "date", "inst_flow_weighted")


ewm_sql("cmx_p", "flows_p", {"ef": ("total_net", 2 / 6), "es": ("total_net", 2 / 21)})
cte("cm_in", "SELECT symbol, date, ef - es AS m FROM cmx_p")
ewm_sql("cms_p", "cm_in", {"sg": ("m", 2 / 6)})
cte("chip_macd_p", """SELECT symbol, date, m, h, CASE WHEN rn < 20 THEN 0.5 WHEN m > 1e-6 THEN CASE WHEN h > 1e-6 AND h > ph + 1e-6 THEN 1.0 WHEN h > 1e-6 THEN 0.7 ELSE 0.5 END
    WHEN m >= -1e-6 THEN 0.5 WHEN h > 1e-6 THEN 0.3 ELSE 0.1 END AS chip_macd_score
  FROM (SELECT *, m - sg AS h, coalesce(lag(m - sg) OVER (PARTITION BY symbol ORDER BY date), 0) AS ph FROM cms_p)""")


@plan("e08_chip_macd", "SELECT symbol, date, m AS cm, h AS cm_hist, chip_macd_score FROM chip_macd_p", "cm cm_hist chip_macd_score")
def _(p):
    return ind.flow_macd(p.flows().select("symbol", "date", "total_net")).select("symbol", "date", "cm", "cm_hist", "chip_macd_score")


cte("revpivot_p", f"""SELECT *, lag(yoy_growth) OVER w AS prev_yoy, lag(mom_growth) OVER w AS prev_mom, lag(yoy_growth, 3) OVER w AS yoy_3m_ago FROM revenue_p {WN}""")


@plan("e09_pivot_revenue_rows", "SELECT * FROM revpivot_p", "revenue:2 mom_growth yoy_growth prev_yoy prev_mom yoy_3m_ago")
def _(p):
    return ind.revenue_pivot(p.revenue())


cte("vpd_p", """SELECT *, CASE WHEN k >= 7 AND NOT flat THEN round(c0, 12) END AS vp_corr FROM (SELECT symbol, date, k, corr(dc, dv) OVER w AS c0,
    stddev_samp(dc) OVER w = 0 OR stddev_samp(dv) OVER w = 0 AS flat FROM (
    SELECT symbol, date, close / lag(close) OVER v - 1 AS dc, volume / lag(volume) OVER v - 1 AS dv, row_number() OVER v AS k FROM bars_p
      WINDOW v AS (PARTITION BY symbol ORDER BY date))
    WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 4 PRECEDING))""")
cte("vp_p", """SELECT symbol, date, vp_corr, CASE WHEN vp_corr < -0.3 THEN -0.05 WHEN vp_corr < 0 THEN -0.02 WHEN vp_corr >= 0.3 THEN 0.02 ELSE 0.0 END AS vp_divergence FROM vpd_p""")


@plan("e10_volume_price_divergence", "SELECT * FROM vp_p", "vp_corr vp_divergence")
def _(p):
    return ind.volume_price_divergence(p.closes()).select("symbol", "date", "vp_corr", "vp_divergence")


cte("seed_rsi_in", """SELECT symbol, date, CASE WHEN k = 15 THEN avg(g) OVER w ELSE g END AS g, CASE WHEN k = 15 THEN avg(l) OVER w ELSE l END AS l, k FROM (
    SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k FROM moves_p) WHERE k > 1
    WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 13 PRECEDING) QUALIFY k >= 15""")
ewm_sql("seed_rsi_p", "seed_rsi_in", {"ag": ("g", 1 / 14), "al": ("l", 1 / 14)})
cte("m0_in", "SELECT symbol, date, ef - es AS m FROM gl_p")
ewm_sql("m0_p", "m0_in", {"sg": ("m", 0.2)})
cte("decay_p", """SELECT symbol, date, (CASE WHEN k < 40 THEN 0 WHEN d AND s THEN -0.06 WHEN d OR s THEN -0.03 ELSE 0 END)::DOUBLE AS momentum_decay FROM (
  SELECT symbol, date, k, coalesce(max(high) OVER a > max(high) OVER b AND max(r) OVER c < max(r) OVER e, false) AS d,
    coalesce(h > 0 AND lag(h) OVER w > 0 AND h < lag(h) OVER w AND lag(h) OVER w < lag(h, 2) OVER w, false) AS s
  FROM (SELECT g.symbol, g.date, g.high, g.rn AS k, CASE WHEN r.al < 1e-10 THEN 100.0 ELSE 100 - 100 / (1 + r.ag / r.al) END AS r, m.m - m.sg AS h
        FROM gl_p g JOIN m0_p m ON m.symbol = g.symbol AND m.date = g.date LEFT JOIN seed_rsi_p r ON r.symbol = g.symbol AND r.date = g.date)
  WINDOW w AS (PARTITION BY symbol ORDER BY date), a AS (PARTITION BY symbol ORDER BY date ROWS 4 PRECEDING),
    b AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 9 PRECEDING AND 5 PRECEDING), c AS (PARTITION BY symbol ORDER BY date ROWS 5 PRECEDING),
    e AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 10 PRECEDING AND 6 PRECEDING))""")


@plan("e11_momentum_decay", "SELECT * FROM decay_p", "momentum_decay")
def _(p):
    return ind.momentum_decay(p.bars()).select("symbol", "date", "momentum_decay")


cte("accel_p", """SELECT symbol, date, (CASE WHEN k < 10 OR a <= 0 THEN 0 WHEN b <= 0 OR a / b - 1 > 0.5 THEN 0.04 WHEN a / b - 1 > 0 THEN 0.02 ELSE 0 END)::DOUBLE AS inst_accel_bonus FROM (
  SELECT symbol, date, row_number() OVER w AS k, avg(total_net) OVER (w ROWS 2 PRECEDING) AS a, avg(total_net) OVER (w ROWS BETWEEN 9 PRECEDING AND 3 PRECEDING) AS b
  FROM flows_p WINDOW w AS (PARTITION BY symbol ORDER BY date))""")


@plan("e12_institutional_acceleration", "SELECT * FROM accel_p", "inst_accel_bonus")
def _(p):
    return ind.flow_acceleration(p.flows()).select("symbol", "date", "inst_accel_bonus")


cte("vcp_p", """SELECT symbol, date, vcp_range, vcp_volume, (CASE WHEN vcp_range < 0.5 AND vcp_volume < 0.8 THEN 0.03 ELSE 0 END)::DOUBLE AS vcp_bonus FROM (
  SELECT symbol, date, (max(close) OVER a - min(close) OVER a) / nullif(avg(close) OVER a, 0) AS vcp_range, avg(volume) OVER b / nullif(avg(volume) OVER c, 0) AS vcp_volume
  FROM bars_p WINDOW a AS (PARTITION BY symbol ORDER BY date ROWS 9 PRECEDING), b AS (PARTITION BY symbol ORDER BY date ROWS 2 PRECEDING), c AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING))""")


@plan("e13_vcp_score", "SELECT * FROM vcp_p", "vcp_range vcp_volume vcp_bonus")
def _(p):
    return ind.contraction(p.closes(), max_range=0.5).select("symbol", "date", "vcp_range", "vcp_volume", "vcp_bonus")


cte("mddw_p", """SELECT a.symbol, a.date, coalesce(max(CASE WHEN a.n >= 5 THEN (c.close - b.close) / c.close END), 0) AS mdd_pct, any_value(a.n) AS n FROM
    (SELECT *, row_number() OVER w AS k, least(row_number() OVER w, 20) AS n FROM bars_p WINDOW w AS (PARTITION BY symbol ORDER BY date)) a
    JOIN (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k FROM bars_p) b ON b.symbol = a.symbol AND b.k BETWEEN a.k - 19 AND a.k
    JOIN (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k FROM bars_p) c ON c.symbol = a.symbol AND c.k BETWEEN a.k - 19 AND b.k GROUP BY 1, 2""")
cte("astop_p", """SELECT symbol, date, mdd_pct, (CASE WHEN n < 5 THEN 1.5 WHEN mdd_pct < 0.05 THEN 1.5 * 1.2 WHEN mdd_pct < 0.1 THEN 1.5 WHEN mdd_pct < 0.15 THEN 1.5 * 0.85 ELSE 1.5 * 0.7 END)::DOUBLE AS adjusted_stop_mult FROM mddw_p""")


@plan("e14_adaptive_atr_multiplier", "SELECT * FROM astop_p", "mdd_pct adjusted_stop_mult:3")
def _(p):
    return ind.adaptive_stop(p.closes()).select("symbol", "date", "mdd_pct", "adjusted_stop_mult")


cte("trendbonus_p", """SELECT symbol, date, (CASE WHEN close > sma_13 AND rsi_14 > 50 THEN 0.05 WHEN close < sma_13 AND rsi_14 < 50 THEN -0.05 ELSE 0 END)::DOUBLE AS weekly_bonus FROM week_p""")


@plan("e15_multi_timeframe_alignment", """SELECT d.symbol, d.date, (CASE WHEN up AND b > 0 THEN 0.04 WHEN NOT up AND b < 0 THEN -0.03 WHEN up AND b < 0 THEN -0.02 WHEN NOT up AND b > 0 THEN -0.02 ELSE 0 END)::DOUBLE AS mtf_bonus
  FROM (SELECT symbol, date, coalesce(close > sma_20, false) AS up FROM indw_p) d
  JOIN (SELECT symbol, (date - INTERVAL 4 DAY)::DATE AS date, weekly_bonus AS b FROM trendbonus_p) w ON w.symbol = d.symbol AND w.date = d.date""", "mtf_bonus")
def _(p):
    d = ind.sma(p.closes(), 20).select("symbol", "date", F.coalesce(F.col("close") > F.col("sma_20"), F.lit(False)).alias("up"))
    w = ind.weekly_trend_bonus(ind.weekly(p.bars_daily())).select("symbol", F.date_sub("date", 4).alias("date"), "weekly_bonus")
    j = d.join(w, ["symbol", "date"])
    return j.select("symbol", "date", ind.timeframe_alignment(F.col("up"), F.col("weekly_bonus")).alias("mtf_bonus"))


@plan("e16_weekly_trend_bonus", "SELECT * FROM trendbonus_p", "weekly_bonus")
def _(p):
    return ind.weekly_trend_bonus(ind.weekly(p.bars_daily())).select("symbol", "date", "weekly_bonus")


cte("idxdd_p", "SELECT date, close / max(close) OVER (ORDER BY date ROWS 19 PRECEDING) - 1 AS drawdown_20d FROM index_p")


@plan("e17_index_drawdown_20d", "SELECT * FROM idxdd_p", "drawdown_20d")
def _(p):
    return ind.drawdown_from_high(p.index(), key="market").select("date", "drawdown_20d")


cte("brk_p", """SELECT symbol, date, (CASE WHEN k >= 66 AND below < m60 AND close > m60 AND volume > v20 * 1.5 THEN 0.04
    WHEN k >= 21 AND hi - lo < atr * 3 AND close > hi THEN 0.03 ELSE 0 END)::DOUBLE AS breakout_bonus FROM (
  SELECT symbol, date, close, volume, row_number() OVER w AS k, avg(close) OVER (w ROWS 59 PRECEDING) AS m60, max(close) OVER (w ROWS BETWEEN 6 PRECEDING AND 2 PRECEDING) AS below,
    avg(volume) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS v20, max(high) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS hi,
    min(low) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS lo, avg(tr) OVER (w ROWS 19 PRECEDING) AS atr FROM atr_p WINDOW w AS (PARTITION BY symbol ORDER BY date))""")


@plan("e18_breakout_bonus", "SELECT * FROM brk_p", "breakout_bonus")
def _(p):
    return ind.breakout_bonus(p.bars()).select("symbol", "date", "breakout_bonus")


def cross_sql(d: str, src: str) -> str:
    return f"""SELECT symbol, date, (CASE WHEN p <= 0 AND d > 0 THEN 1 WHEN p >= 0 AND d < 0 THEN -1 ELSE 0 END)::BIGINT AS signal
      FROM (SELECT symbol, date, {d} AS d, lag({d}) OVER (PARTITION BY symbol ORDER BY date) AS p FROM {src})"""


cte("sig_sma", cross_sql("sma_10 - sma_20", "indw_p"))
cte("sig_macd", cross_sql("macd - macd_signal", "indw_p"))
cte("sig_rsi", """SELECT symbol, date, (CASE WHEN p <= 30 AND r > 30 THEN 1 WHEN p >= 70 AND r < 70 THEN -1 ELSE 0 END)::BIGINT AS signal FROM (
  SELECT symbol, date, rsi_14 AS r, lag(rsi_14) OVER (PARTITION BY symbol ORDER BY date) AS p FROM indw_p)""")
cte("sig_bb", f"""SELECT symbol, date, (CASE WHEN lag(close) OVER w <= lag(bb_lower) OVER w AND close > bb_lower THEN 1
    WHEN lag(close) OVER w >= lag(bb_upper) OVER w AND close < bb_upper THEN -1 ELSE 0 END)::BIGINT AS signal FROM indw_p {WN}""")
cte("sig_bh", f"SELECT symbol, date, (CASE WHEN lag(date) OVER w IS NULL THEN 1 WHEN lead(date) OVER w IS NULL THEN -1 ELSE 0 END)::BIGINT AS signal FROM bars_p {WN}")
OUT = ("symbol", "date", "signal")


@plan("e19_signal_sma_cross", "SELECT * FROM sig_sma")
def _(p):
    return ind.signal_sma_cross(p.closes()).select(*OUT)


@plan("e20_signal_rsi_threshold", "SELECT * FROM sig_rsi")
def _(p):
    return ind.signal_rsi(ind.rsi(p.closes())).select(*OUT)


@plan("e21_signal_bb_breakout", "SELECT * FROM sig_bb")
def _(p):
    return ind.signal_bands(ind.bollinger(p.closes())).select(*OUT)


@plan("e22_signal_macd_cross", "SELECT * FROM sig_macd")
def _(p):
    return ind.signal_macd(ind.macd(p.closes())).select(*OUT)


@plan("e23_signal_buy_hold", "SELECT * FROM sig_bh")
def _(p):
    return ind.signal_buy_hold(p.closes()).select(*OUT)


def vote_panel(p):
    """Bars with RSI, MACD, flow and the growth of the month that ended before the week."""
    d = ind.macd(ind.rsi(p.closes()))
    rev = p.revenue().select("symbol", F.add_months("date", 1).alias("m"), "yoy_growth")
    d = d.join(p.flows().select("symbol", "date", "total_net"), ["symbol", "date"], "left")
    return d.withColumn("m", F.trunc("date", "month")).join(rev, ["symbol", "m"], "left").drop("m")


cte("votes_p", """SELECT symbol, date, round((CASE WHEN rsi_14 < 30 THEN 1 WHEN rsi_14 > 70 THEN -1 ELSE 0 END) * 0.3 + (CASE WHEN macd > macd_signal THEN 1 WHEN macd < macd_signal THEN -1 ELSE 0 END) * 0.3
    + (CASE WHEN total_net > 0 THEN 1 WHEN total_net < 0 THEN -1 ELSE 0 END) * 0.2 + (CASE WHEN y > 20 THEN 1 WHEN y < 0 THEN -1 ELSE 0 END) * 0.2, 9)::DOUBLE AS vote_score FROM (
  SELECT i.symbol, i.date, rsi_14, macd, macd_signal, total_net, last_value(yoy_growth IGNORE NULLS) OVER (PARTITION BY i.symbol ORDER BY i.date) AS y
  FROM indw_p i LEFT JOIN flows_p f ON f.symbol = i.symbol AND f.date = i.date
  LEFT JOIN revenue_p r ON r.symbol = i.symbol AND r.date + INTERVAL 1 MONTH = date_trunc('month', i.date))""")
cte("sig_votes", "SELECT symbol, date, vote_score, (CASE WHEN vote_score > 0.3 THEN 1 WHEN vote_score < -0.3 THEN -1 ELSE 0 END)::BIGINT AS signal FROM votes_p")


@plan("e24_signal_multi_factor", "SELECT * FROM sig_votes", "vote_score")
def _(p):
    return ind.signal_votes(vote_panel(p)).select("symbol", "date", "vote_score", "signal")


def dividend_events(p, on_bars=True):
    """Ex-dates: the first week of each quarter with a bar; cash from tax, stock from discount."""
    d = p.lines().groupBy("symbol", F.trunc("day", "quarter").alias("q")).agg(
        F.min("week").alias("date"), F.avg("l_tax").alias("t"), F.avg("l_discount").alias("s")
    )
    return d.select("symbol", "date", (F.col("t") * 1000).alias("cash"), (F.col("s") * 2).alias("stock"))


cte("divs_p", """SELECT symbol, min(week) AS date, avg(l_tax) * 1000 AS cash, avg(l_discount) * 2 AS stock FROM lines_p GROUP BY symbol, date_trunc('quarter', day)""")
cte("divw_p", "SELECT symbol, date, sum(cash) AS cash, sum(stock) AS stock FROM divs_p GROUP BY 1, 2")


@plan("e25_dividend_back_adjustment", """SELECT symbol, date, close * f AS close, close AS raw_close, f AS adj_factor FROM (
  SELECT a.symbol, a.date, any_value(a.close) AS close, coalesce(product(b.f), 1.0) AS f FROM bars_p a LEFT JOIN (
    SELECT symbol, date, (pc - cash) / pc / (1 + stock / 10) AS f FROM (SELECT x.symbol, x.date, cash, stock, pc FROM divw_p x JOIN moves_p m ON m.symbol = x.symbol AND m.date = x.date) WHERE pc > 0
      AND (pc - cash) / pc / (1 + stock / 10) > 0 AND (pc - cash) / pc / (1 + stock / 10) < 1.5) b
    ON b.symbol = a.symbol AND b.date > a.date GROUP BY 1, 2)""", "close raw_close adj_factor")
def _(p):
    ev = dividend_events(p).groupBy("symbol", "date").agg(F.sum("cash").alias("cash"), F.sum("stock").alias("stock"))
    return ind.back_adjust(p.bars(), ev).select("symbol", "date", "close", "raw_close", "adj_factor")


@plan("e30_position_timeseries", f"""SELECT symbol, count(*) AS n_points, sum(CASE WHEN o - k + 1 = 0 THEN 1 ELSE 0 END)::BIGINT AS tail_len, list({rnd_sql('close')} ORDER BY o DESC) AS closes FROM (
  SELECT b.symbol, b.close, o, row_number() OVER (PARTITION BY b.symbol ORDER BY o) AS k FROM bars_p b JOIN (
    SELECT date, row_number() OVER (ORDER BY date DESC) - 1 AS o FROM index_p) c ON c.date = b.date WHERE o < 30) GROUP BY 1""")
def _(p):
    from ..functions.calendar import latest_ordinals

    d = ind.position_series(p.closes(), latest_ordinals(p.lines().select(F.col("week").alias("date")).distinct()))
    return d.withColumn("closes", F.transform("closes", lambda x: rnd(x, 6)))


@plan("e31_drawdown_series", """SELECT portfolio, date, (max(capital) OVER w - capital) / max(capital) OVER w * 100 AS drawdown_pct FROM snapshots_p WINDOW w AS (PARTITION BY portfolio ORDER BY date)""", "drawdown_pct")
def _(p):
    return ind.drawdown_series(p.snapshots(), "capital", key="portfolio").select("portfolio", "date", "drawdown_pct")


cte("study_p", """SELECT symbol, date, close, sum(fn) OVER a / nullif(sum(volume) OVER a, 0) AS flow_ratio, close / lag(close, 5) OVER w - 1 AS ret5, mv AS median_volume,
    lead(close, 5) OVER w / lead(open) OVER w - 1 AS fwd_5, lead(close, 10) OVER w / lead(open) OVER w - 1 AS fwd_10, lead(close, 20) OVER w / lead(open) OVER w - 1 AS fwd_20
  FROM (SELECT b.*, coalesce(f.foreign_net, 0) AS fn, median(volume) OVER (PARTITION BY b.symbol) AS mv FROM bars_p b LEFT JOIN flows_p f ON f.symbol = b.symbol AND f.date = b.date)
  WINDOW w AS (PARTITION BY symbol ORDER BY date), a AS (PARTITION BY symbol ORDER BY date ROWS 4 PRECEDING)""")


@plan("e32_study_features", "SELECT symbol, date, flow_ratio, ret5, median_volume, fwd_5, fwd_10, fwd_20 FROM study_p", "flow_ratio ret5 median_volume fwd_5 fwd_10 fwd_20")
def _(p):
    return ind.study_features(p.bars(), p.flows()).select("symbol", "date", "flow_ratio", "ret5", "median_volume", "fwd_5", "fwd_10", "fwd_20")
