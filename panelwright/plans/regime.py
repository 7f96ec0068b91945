"""Market regime in batch."""

from pyspark.sql import functions as F

from ..operators import flows as fl
from ..operators import regime as rg
from ..functions.timeseries import streak
from .ctes import cte
from .registry import plan

RULES = rg.RegimeRules(return_5d=-0.15, single_drop=-0.10, vix_level=25.0, us_vix_level=30.5, return_threshold=0.03)


def market(p):
    """Index series with two volatility gauges taken from the dispersion of the raw lines."""
    v = p.lines().groupBy(F.col("week").alias("date")).agg(
        (F.stddev_samp("l_extendedprice") / F.avg("l_extendedprice") * 40).alias("vix"),
        (F.stddev_samp("l_quantity") / F.avg("l_quantity") * 50).alias("us_vix"),
    )
    return p.index().join(v, "date")


def regimes(p, bars=None):
    """Regime of every date: one row per date, shared by all scoring queries. ``bars`` gives the weekly bars."""
    return p.shared("regimes", lambda: build_regimes(p, bars))


def build_regimes(p, bars=None):
    return rg.detect(market(p), fl.below_mean_share((bars or p.bars)().select("symbol", "date", "close")), RULES)


cte("market_p", """SELECT i.*, vix, us_vix, row_number() OVER (ORDER BY i.date) AS n, i.close / lag(i.close) OVER (ORDER BY i.date) - 1 AS r FROM index_p i JOIN (
  SELECT week AS date, stddev_samp(l_extendedprice) / avg(l_extendedprice) * 40 AS vix, stddev_samp(l_quantity) / avg(l_quantity) * 50 AS us_vix FROM lines_p GROUP BY 1) v ON v.date = i.date""")
cte("crisis0_p", """SELECT *, close / lag(close, 5) OVER w - 1 AS ret5, sum(CASE WHEN r < 0 THEN 1 ELSE 0 END) OVER (w ROWS 2 PRECEDING) AS dn,
    CASE WHEN n >= 21 THEN stddev_samp(r) OVER (w ROWS 19 PRECEDING) END AS rv, avg(volume) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS vm,
    vix / lag(vix) OVER w - 1 AS dv, us_vix / lag(us_vix) OVER w - 1 AS du FROM market_p WINDOW w AS (ORDER BY date)""")
cte("crisis1_p", """SELECT *, CASE WHEN n >= 30 THEN coalesce(rv / CASE WHEN n - 20 > 20 THEN CASE WHEN count(rv) OVER a >= 5 THEN avg(rv) OVER a ELSE avg(rv) OVER w END ELSE avg(rv) OVER b END, 0) ELSE 0 END AS vol_ratio_val FROM crisis0_p
  WINDOW w AS (ORDER BY date), a AS (ORDER BY date ROWS BETWEEN 119 PRECEDING AND 20 PRECEDING), b AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
F_ = lambda e: f"(CASE WHEN n >= 10 AND coalesce({e}, false) THEN 1 ELSE 0 END)::BIGINT"
cte("crisis_p", f"""SELECT *, fast_return_5d + consec_decline + vol_spike + panic_volume + vix_spike + single_day_drop + us_vix_spike >= 2 AS crisis FROM (
  SELECT date, n, close, volume, r, vix, us_vix, ret5 AS fast_return_5d_val, vol_ratio_val, {F_('ret5 < -0.15')} AS fast_return_5d, {F_('dn >= 3')} AS consec_decline, {F_('vol_ratio_val > 1.8')} AS vol_spike,
    {F_('n >= 21 AND volume > vm * 1.5 AND r < 0')} AS panic_volume, {F_('vix >= 25 OR dv >= 0.25')} AS vix_spike, {F_('r < -0.10')} AS single_day_drop, {F_('us_vix >= 30.5 OR du >= 0.25')} AS us_vix_spike FROM crisis1_p)""")
cte("regime_p", """SELECT * EXCLUDE (m60, m120, low), CASE WHEN n >= 120 AND crisis THEN 'crisis' ELSE low END AS regime, low <> vote AS breadth_downgraded FROM (
  SELECT *, CASE WHEN n >= 120 AND b > 0.6 AND vote = 'bull' THEN 'sideways' WHEN n >= 120 AND b > 0.6 AND vote = 'sideways' THEN 'bear' ELSE vote END AS low FROM (
    SELECT *, CASE WHEN n < 120 THEN 'sideways' WHEN (close > m60)::INT + (close > m120)::INT + coalesce(ret_20d > 0.03, false)::INT >= 2 THEN 'bull'
      WHEN (close <= m60)::INT + (close <= m120)::INT + coalesce(ret_20d < -0.03, false)::INT >= 2 THEN 'bear' ELSE 'sideways' END AS vote FROM (
      SELECT c.*, b.breadth_below_ma20_pct AS b, avg(close) OVER (w ROWS 59 PRECEDING) AS m60, avg(close) OVER (w ROWS 119 PRECEDING) AS m120, close / lag(close, 20) OVER w - 1 AS ret_20d
      FROM crisis_p c LEFT JOIN b20_p b ON b.date = c.date WINDOW w AS (ORDER BY c.date))))""")
SIG = ", ".join(rg.SIGNALS)


@plan("e26_detect_from_series", "SELECT date, close, ret_20d, vote, crisis, regime FROM regime_p", "close ret_20d")
def _(p):
    return regimes(p).select("date", "close", "ret_20d", "vote", "crisis", "regime")


@plan("e27_crisis_signals", f"SELECT date, {SIG}, fast_return_5d_val, vol_ratio_val, vix, us_vix, crisis FROM crisis_p", "fast_return_5d_val vol_ratio_val vix us_vix")
def _(p):
    return rg.crisis_signals(market(p), RULES).select("date", *rg.SIGNALS, "fast_return_5d_val", "vol_ratio_val", "vix", "us_vix", "crisis")


cte("trans_p", """SELECT date, n, n >= 60 AND close < m60 * 0.99 AS bull_sideways, n >= 60 AND close > m60 * 1.01 AS sideways_bull, n >= 120 AND (close < m120 OR coalesce(r20 < -0.03, false)) AS sideways_bear,
    n >= 60 AND close > m60 AS bear_sideways, n >= 60 AND up AND calm AS crisis_bear, n >= 60 AND up AND calm AND close > m60 AS crisis_sideways FROM (
  SELECT date, n, close, avg(close) OVER (w ROWS 59 PRECEDING) AS m60, avg(close) OVER (w ROWS 119 PRECEDING) AS m120, close / lag(close, 20) OVER w - 1 AS r20,
    coalesce(lag(close) OVER w > lag(close, 2) OVER w AND close > lag(close) OVER w, false) AS up,
    CASE WHEN n < 30 OR stddev_samp(r) OVER b IS NULL THEN true ELSE stddev_samp(r) OVER (w ROWS 19 PRECEDING) / stddev_samp(r) OVER b < 1.3 END AS calm FROM market_p
  WINDOW w AS (ORDER BY date), b AS (ORDER BY date ROWS BETWEEN 119 PRECEDING AND 20 PRECEDING))""")


@plan("e28_transition_conditions", f"SELECT date, {', '.join(rg.FLAGS)} FROM trans_p")
def _(p):
    return rg.transition_flags(market(p), RULES).select("date", *rg.FLAGS)


cte("hyst_in", "SELECT r.date, r.n, r.regime AS raw, t.* EXCLUDE (date, n) FROM regime_p r JOIN trans_p t ON t.date = r.date")
OKAY = "CASE s.cur || '_' || h.raw WHEN 'bull_sideways' THEN bull_sideways WHEN 'sideways_bull' THEN sideways_bull WHEN 'sideways_bear' THEN sideways_bear WHEN 'bear_sideways' THEN bear_sideways WHEN 'crisis_bear' THEN crisis_bear WHEN 'crisis_sideways' THEN crisis_sideways ELSE true END"
NEED = "CASE s.cur || '_' || h.raw WHEN 'bull_sideways' THEN 1 WHEN 'sideways_bull' THEN 3 WHEN 'bear_sideways' THEN 3 ELSE 2 END"
cte("hyst_p", f"""/*RECURSIVE*/SELECT date, n, raw, raw AS cur, 0::BIGINT AS pending FROM hyst_in WHERE n = 1
  UNION ALL SELECT h.date, h.n, h.raw, CASE WHEN h.raw IN ('crisis', s.cur) THEN h.raw WHEN NOT ({OKAY}) THEN s.cur WHEN s.pending + 1 >= {NEED} THEN h.raw ELSE s.cur END,
    CASE WHEN h.raw IN ('crisis', s.cur) OR NOT ({OKAY}) OR s.pending + 1 >= {NEED} THEN 0 ELSE s.pending + 1 END FROM hyst_p s JOIN hyst_in h ON h.n = s.n + 1""")


def stable_regimes(p):
    m = market(p)
    d = rg.detect(m, fl.below_mean_share(p.closes()), RULES).select("market", "date", "regime")
    return rg.hysteresis(d.join(rg.transition_flags(m, RULES).select("market", "date", *rg.FLAGS), ["market", "date"]))


@plan("e29_hysteresis", "SELECT date, raw AS raw_regime, cur AS regime, pending FROM hyst_p")
def _(p):
    return stable_regimes(p).drop("market")


@plan("e33_detect", f"SELECT date, regime, vote, breadth_downgraded, b AS breadth_below_ma20_pct, crisis, {SIG} FROM regime_p", "breadth_below_ma20_pct")
def _(p):
    return regimes(p).select("date", "regime", "vote", "breadth_downgraded", "breadth_below_ma20_pct", "crisis", *rg.SIGNALS)


@plan("e34_macro_stress_check", """SELECT r.date, r.regime, crisis, close, ret_20d, fast_return_5d_val, vol_ratio_val, k AS consec_decline_days FROM regime_p r JOIN (
   SELECT date, n - max(CASE WHEN r < 0 THEN 0 ELSE n END) OVER (ORDER BY date) AS k FROM market_p) s ON s.date = r.date WHERE r.date = (SELECT max(date) FROM market_p)""", "close ret_20d fast_return_5d_val vol_ratio_val")
def _(p):
    d = regimes(p)
    d = streak(d, F.col("close") < F.lag("close").over(rg.W()), "consec_decline_days", key="market")
    return fl.last_date(d).select("date", "regime", "crisis", "close", "ret_20d", "fast_return_5d_val", "vol_ratio_val", "consec_decline_days")
