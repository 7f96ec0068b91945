"""B, F, G and the composite I queries: screens, rankings, stages and comparisons."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import trading as tr
from ..functions.exprs import lookup
from ..functions.timeseries import streak
from ..operators import flows as fl
from ..operators import indicators as ind
from ..operators import ranking as rk
from ..operators import scoring as sc
from ..operators import screen as sn
from . import records as rec
from .ctes import cte, pr_sql
from .flows import LAST
from .regime import regimes
from .registry import plan
from .scoring import at_scan, valuation_panel

C = F.col
KEY = rec.KEY

# -- B1..B11: factor screen -----------------------------------------------------------


def snapshot(p):
    """Bars, indicators, flows, margin and the latest published growth on every row."""
    d = ind.macd(ind.rsi(ind.sma(p.wide(), 20)))
    d = streak(d, C("foreign_net") + C("trust_net") + C("dealer_net") > 0, "buy_streak")
    r = streak(p.revenue(), C("mom_growth") > 0, "growth_streak").select("symbol", F.add_months("date", 1).alias("m"), "yoy_growth", "growth_streak")
    return d.withColumn("m", F.trunc("date", "month")).join(r, ["symbol", "m"], "left").drop("m")


cte("snap_p", """SELECT i.symbol, i.date, i.close, i.volume, i.sma_20, i.rsi_14, i.macd, i.macd_signal, f.foreign_net, f.trust_net, f.dealer_net, f.total_net, m.margin_balance, m.short_balance, s.buy_streak, r.yoy_growth, r.growth_streak
  FROM indw_p i JOIN flows_p f ON f.symbol = i.symbol AND f.date = i.date JOIN margin_p m ON m.symbol = i.symbol AND m.date = i.date
  JOIN (SELECT symbol, date, k - max(CASE WHEN x > 0 THEN 0 ELSE k END) OVER (PARTITION BY symbol ORDER BY date) AS buy_streak FROM (SELECT symbol, date, foreign_net + trust_net + dealer_net AS x, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k FROM flows_p)) s ON s.symbol = i.symbol AND s.date = i.date
  LEFT JOIN (SELECT symbol, date, yoy_growth, k - max(CASE WHEN mom_growth > 0 THEN 0 ELSE k END) OVER (PARTITION BY symbol ORDER BY date) AS growth_streak FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k FROM revenue_p)) r ON r.symbol = i.symbol AND r.date + INTERVAL 1 MONTH = date_trunc('month', i.date)""")
FLAG = {
    "rsi_oversold": ("rsi_14 < 45", {"threshold": 45}),
    "macd_golden_cross": ("lag(macd - macd_signal) OVER (PARTITION BY symbol ORDER BY date) <= 0 AND macd - macd_signal > 0", {}),
    "price_above_sma": ("close > sma_20", {}),
    "foreign_net_buy": ("foreign_net > 20", {"threshold": 20}),
    "institutional_consecutive_buy": ("buy_streak >= 3", {}),
    "short_squeeze_ratio": ("short_balance / nullif(margin_balance, 0) > 0.7", {"threshold": 0.7}),
    "revenue_yoy_growth": ("yoy_growth > 20", {}),
    "revenue_consecutive_growth": ("growth_streak >= 2", {"months": 2}),
}
cte("flags_p", "SELECT symbol, date, close, " + ", ".join(f"coalesce({e}, false) AS f_{k}" for k, (e, _) in FLAG.items()) + " FROM snap_p")
WANT = {k: kw for k, (_, kw) in FLAG.items()}

for _i, _k in enumerate(FLAG, 1):

    @plan(f"b{_i:02d}_{_k}", f"SELECT symbol, date, close FROM flags_p WHERE f_{_k}", "close")
    def _(p, k=_k):
        d = sn.factor_flags(snapshot(p), {k: WANT[k]})
        return d.where(C(f"f_{k}")).select("symbol", "date", "close")


WTS = {k: (2.0 if k.startswith("rev") else 1.0) for k in FLAG}
SCORE = " + ".join(f"f_{k}::INT * {w}" for k, w in WTS.items())


@plan("b09_scan", f"SELECT symbol, date, close, ({SCORE})::DOUBLE AS factor_score, row_number() OVER (ORDER BY {SCORE} DESC, symbol) AS rank FROM (SELECT * FROM flags_p {LAST})", "close factor_score")
def _(p):
    d = fl.last_rows(sn.factor_score(sn.factor_flags(snapshot(p), WANT), WTS)).withColumn("_g", F.lit(1))
    return p.pool.row_rank(d, "_g", "factor_score", "rank").select("symbol", "date", "close", "factor_score", "rank")


@plan("b10_scan_with_conditions", "SELECT symbol, date, f_price_above_sma AND f_foreign_net_buy AND f_revenue_yoy_growth AS all_hit, f_rsi_oversold OR f_macd_golden_cross AS any_hit FROM flags_p")
def _(p):
    d = sn.factor_flags(snapshot(p), WANT)
    a = sn.combine(["price_above_sma", "foreign_net_buy", "revenue_yoy_growth"])
    return d.select("symbol", "date", a.alias("all_hit"), sn.combine(["rsi_oversold", "macd_golden_cross"], False).alias("any_hit"))


@plan("b11_load_snapshot", "SELECT symbol, date, close, sma_20, rsi_14, macd, foreign_net, margin_balance, yoy_growth FROM snap_p", "close sma_20 rsi_14 macd foreign_net margin_balance yoy_growth")
def _(p):
    return snapshot(p).select("symbol", "date", "close", "sma_20", "rsi_14", "macd", "foreign_net", "margin_balance", "yoy_growth")


@plan("b31_multi_factor_panel", "SELECT symbol, date, close, rsi_14, total_net, margin_balance, last_value(yoy_growth IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date) AS yoy_growth FROM snap_p", "close rsi_14 total_net margin_balance yoy_growth")
def _(p):
    d = snapshot(p)
    return d.select("symbol", "date", "close", "rsi_14", "total_net", "margin_balance", F.last("yoy_growth", ignorenulls=True).over(ind.trailing(1 << 30)).alias("yoy_growth"))


@plan("b32_strategy_data", "SELECT symbol, date, close, sma_10, sma_20, rsi_14 FROM indw_p WHERE date BETWEEN DATE '1998-01-01' AND DATE '1999-12-31'", "close sma_10 sma_20 rsi_14")
def _(p):
    w = ind.rsi(ind.sma(p.bars(), 10, 20))
    long = w.unpivot(["symbol", "date"], ["sma_10", "sma_20", "rsi_14"], "name", "value")
    back = long.groupBy("symbol", "date").pivot("name", ["sma_10", "sma_20", "rsi_14"]).agg(F.max("value"))
    ok = C("date").between(F.lit("1998-01-01").cast("date"), F.lit("1999-12-31").cast("date"))
    return p.closes().where(ok).join(back, ["symbol", "date"], "left").drop("volume")


@plan("b33_check_data_available", "SELECT symbol, s AS strategy, count(*) >= n AS available FROM bars_p, (VALUES ('sma_cross', 20), ('macd_cross', 290), ('rsi_threshold', 14)) t(s, n) GROUP BY symbol, s, n")
def _(p):
    need = {"sma_cross": 20, "macd_cross": 290, "rsi_threshold": 14}
    d = p.closes().groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"))
    rows = F.array(*[F.struct(F.lit(k).alias("strategy"), (C("_n") >= v).alias("available")) for k, v in need.items()])
    return d.select("symbol", F.explode(rows).alias("r")).select("symbol", "r.*")


# -- B12..B20: universe funnel ----------------------------------------------------------

CFG = sn.UniverseConfig(min_close=100.0, min_available_days=25, avg_turnover_5d_min=60_000.0, min_turnover_5d_min=8_000.0, turnover_ma20_min=50_000.0, trend_ma=60, volume_ratio_min=1.2, limit_move=2.0, limit_days=35)
TYPES = ["AFRICA", "AMERICA", "ASIA", "EUROPE"]


def funnel(p):
    """Features with all stage inputs and the regime multiplier of the date."""
    f = sn.limit_moves(sn.turnover_five(ind.feature_columns(p.wide())), CFG)
    d = sn.available(f, p.info(), CFG, TYPES)
    d = d.join(regimes(p).select("date", "regime"), "date")
    m = lookup(C("regime"), sn.TURNOVER_MULTIPLIER, 1.0)
    return d.withColumns({"ok_liquid": sn.liquid(d, CFG, m), "ok_trend": sn.trending(CFG, CFG.volume_ratio_min), "ok_breakout": sn.breaking_out()})


cte("funnel_p", """SELECT *, coalesce(t5 >= 60000 * m AND m5 >= 8000 * m AND (turnover_ma20 IS NULL OR turnover_ma20 >= 50000 * m), false) OR coalesce(turnover_ratio_5d_20d >= 2 AND t5 >= 30000 * m, false) AS ok_liquid,
    coalesce(close >= ma60, false) AND coalesce(volume / volume_ma20 >= 1.2, false) AND n_limit < 3 AS ok_trend,
    coalesce(close >= ma20, false) AND coalesce(momentum_20d > 0, false) AND coalesce(close / high_20d >= 0.9, true) AND coalesce(volume / volume_ma20 >= 1.5, false) AND n_limit < 3 AS ok_breakout FROM (
  SELECT f.*, t5, m5, n_limit, n_year >= 25 AND f.close > 100 AS ok_stage1, g.regime, CASE g.regime WHEN 'bull' THEN 0.8 WHEN 'bear' THEN 1.3 WHEN 'crisis' THEN 1.5 ELSE 1.0 END AS m FROM features_p f
  JOIN (SELECT symbol AS s, date AS d, avg(turnover) OVER w AS t5, min(turnover) OVER w AS m5, count(*) OVER y AS n_year, sum(big) OVER l - first_value(big) OVER l AS n_limit FROM (SELECT *, CASE WHEN abs(r1) >= 2.0 THEN 1 ELSE 0 END AS big FROM bars_r)
    WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 4 PRECEDING), y AS (PARTITION BY symbol ORDER BY date RANGE INTERVAL 365 DAY PRECEDING), l AS (PARTITION BY symbol ORDER BY date RANGE INTERVAL 35 DAY PRECEDING)) x ON s = f.symbol AND d = f.date
  JOIN info_p i ON i.symbol = f.symbol AND listing_type IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE') JOIN regime_p g ON g.date = f.date)""")


@plan("b12_stage1_filter", "SELECT symbol, date, close FROM funnel_p WHERE ok_stage1", "close")
def _(p):
    return sn.available(p.closes(), p.info(), CFG, TYPES).where("ok_stage1").select("symbol", "date", "close")


@plan("b13_filter_liquidity", "SELECT symbol, date, t5 AS turnover_5_avg, m5 AS turnover_5_min FROM funnel_p WHERE ok_liquid", "turnover_5_avg:3 turnover_5_min:3")
def _(p):
    return funnel(p).where("ok_liquid").select("symbol", "date", "turnover_5_avg", "turnover_5_min")


@plan("b14_stage2_liquidity", """SELECT symbol, date, CASE WHEN cov >= 0.3 THEN turnover_ma5 ELSE t5 END AS avg5, CASE WHEN cov >= 0.3 THEN turnover_ma5 * 0.33 ELSE m5 END AS min5 FROM (
   SELECT *, avg((turnover_ma20 IS NOT NULL)::INT) OVER (PARTITION BY date) AS cov FROM funnel_p WHERE ok_stage1)""", "avg5:3 min5:3")
def _(p):
    d = p.xs.with_stats(funnel(p).where("ok_stage1"), "date", {"cov": F.avg(C("turnover_ma20").isNotNull().cast("int"))})
    use = C("cov") >= 0.3
    return d.select("symbol", "date", F.when(use, C("turnover_ma5")).otherwise(C("turnover_5_avg")).alias("avg5"), F.when(use, C("turnover_ma5") * 0.33).otherwise(C("turnover_5_min")).alias("min5"))


@plan("b15_filter_trend", "SELECT symbol, date FROM funnel_p WHERE ok_trend")
def _(p):
    return funnel(p).where("ok_trend").select("symbol", "date")


@plan("b16_filter_trend_breakout", "SELECT symbol, date FROM funnel_p WHERE ok_breakout")
def _(p):
    return funnel(p).where("ok_breakout").select("symbol", "date")


@plan("b17_trend_or_breakout", "SELECT symbol, date FROM funnel_p WHERE ok_trend OR ok_breakout")
def _(p):
    return funnel(p).where(sn.dispatch_trend("trend_or_breakout", C("ok_trend"), C("ok_breakout"))).select("symbol", "date")


def memory(p, mode="swing"):
    """Names picked within the last three scan dates of a mode, with the smallest age."""
    pk = rec.picks(p).where(C("mode") == mode).select("symbol", C("date").alias("pick_date"))
    cal = p.scan_dates().withColumn("o", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")))  # one row per date
    pk = pk.join(cal.select(C("date").alias("pick_date"), "o"), "pick_date")
    ages = pk.select("symbol", F.explode(F.array(*[F.struct((C("o") + k).alias("o"), F.lit(k).alias("age")) for k in (1, 2, 3)])).alias("e")).select("symbol", "e.*")
    return ages.join(cal, "o").groupBy("symbol", "date").agg(F.min("age").cast("long").alias("age"))


cte("mem_p", """WITH cal AS (SELECT date, row_number() OVER (ORDER BY date) AS o FROM scan_p) SELECT k.symbol, c2.date, min(c2.o - c1.o) AS age FROM picks_p k JOIN cal c1 ON c1.date = k.date JOIN cal c2 ON c2.o - c1.o BETWEEN 1 AND 3 WHERE mode = 'swing' GROUP BY 1, 2""")


@plan("g05_candidate_memory", "SELECT m.symbol, m.date, age FROM mem_p m JOIN funnel_p f ON f.symbol = m.symbol AND f.date = m.date AND ok_stage1")
def _(p):
    d = at_scan(p, sn.available(p.closes(), p.info(), CFG, TYPES)).where("ok_stage1").select("symbol", "date")
    return memory(p).join(d, ["symbol", "date"], "left_semi")


def universe(p):
    """B18, stored: several queries and the scan read it."""
    return p.shared("universe", lambda: build_universe(p))


def build_universe(p):
    """Stage flags at scan dates, stage-2 fallback, decayed re-entry of remembered picks."""
    d = at_scan(p, funnel(p))
    d = d.withColumns({"s1": C("ok_stage1"), "s2": C("ok_stage1") & C("ok_liquid")})
    d = d.withColumn("s3", C("s2") & C("ok_trend"))
    d = p.xs.with_stats(d, "date", {"_n3": F.sum(C("s3").cast("int"))})
    d = d.withColumn("s3", F.when(C("_n3") == 0, C("s2")).otherwise(C("s3"))).join(memory(p), ["symbol", "date"], "left")
    decay = lookup(C("age"), sn.MEMORY_DECAY)
    m = lookup(C("regime"), sn.TURNOVER_MULTIPLIER, 1.0)
    again = (C("s2") & (C("turnover_5_avg") >= CFG.avg_turnover_5d_min * m * decay)) | ((C("age") <= 1) & ~C("s2"))
    return d.select("symbol", "date", "regime", "ok_trend", "age", "s1", "s2", "s3", (C("s1") & ~C("s3") & sn.yes(again)).alias("from_memory"))


cte("uni_p", """SELECT u.*, age, s1 AND NOT s3 AND coalesce((s2 AND t5 >= 60000 * m * CASE age WHEN 1 THEN 0.8 WHEN 2 THEN 0.9 WHEN 3 THEN 1.0 END) OR (age <= 1 AND NOT s2), false) AS from_memory FROM (
   SELECT *, CASE WHEN count(*) FILTER (s2 AND ok_trend) OVER (PARTITION BY date) = 0 THEN s2 ELSE s2 AND ok_trend END AS s3 FROM (SELECT *, ok_stage1 AS s1, ok_stage1 AND ok_liquid AS s2 FROM funnel_p WHERE date IN (SELECT date FROM scan_p))) u
   LEFT JOIN mem_p q ON q.symbol = u.symbol AND q.date = u.date""")


@plan("b18_universe", "SELECT symbol, date, s3, from_memory FROM uni_p WHERE s3 OR from_memory")
def _(p):
    return universe(p).where(C("s3") | C("from_memory")).select("symbol", "date", "s3", "from_memory")


@plan("b19_universe_stats", "SELECT date, regime, count(*) FILTER (s1) AS total_after_sql, count(*) FILTER (s2) AS total_after_liquidity, count(*) FILTER (s2 AND ok_trend) AS total_after_trend, count(*) FILTER (from_memory) AS from_memory, count(*) FILTER (s3 OR from_memory) AS final_candidates FROM uni_p GROUP BY 1, 2")
def _(p):
    return universe_stats(p)


def universe_stats(p):
    n = lambda c, name: F.count_if(c).alias(name)
    return universe(p).groupBy("date", "regime").agg(n(C("s1"), "total_after_sql"), n(C("s2"), "total_after_liquidity"), n(C("s2") & C("ok_trend"), "total_after_trend"), n(C("from_memory"), "from_memory"), n(C("s3") | C("from_memory"), "final_candidates"))


@plan("d41_universe_stat_log", "SELECT date, regime, count(*) FILTER (s1) AS total_after_sql, count(*) FILTER (s3 OR from_memory) AS final_candidates FROM uni_p WHERE date >= DATE '2000-01-01' GROUP BY 1, 2")
def _(p):
    return universe_stats(p).where(C("date") >= F.lit("2000-01-01").cast("date")).select("date", "regime", "total_after_sql", "final_candidates")


@plan("b20_base_filter", "SELECT symbol, date, close, volume FROM bars_p WHERE close BETWEEN 500 AND 20000 AND volume >= 20", "close volume")
def _(p):
    return p.closes().where((C("close") >= 500) & (C("close") <= 20000) & (C("volume") >= 20))


@plan("b21_eps_sustainability", "SELECT symbol FROM (SELECT symbol, eps FROM statements_p QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 4) GROUP BY 1 HAVING bool_or(eps <= 0)")
def _(p):
    return fl.last_rows(p.statements(), 4).groupBy("symbol").agg(F.bool_or(C("eps") <= 0).alias("bad")).where("bad").select("symbol")


cte("peth_p", """SELECT *, CASE WHEN count(pos) OVER w >= 3 THEN median(pos) OVER w * 1.5 ELSE 50 END AS pe_threshold FROM (SELECT v.*, industry, CASE WHEN pe > 0 THEN pe END AS pos FROM val_p v JOIN info_p i ON i.symbol = v.symbol) WINDOW w AS (PARTITION BY date, industry)""")


def pe_panel(p):
    d = valuation_panel(p).join(p.info().select("symbol", "industry"), "symbol")
    return sn.pe_thresholds(d, p.xs, "date")


@plan("b22_relative_pe_thresholds", "SELECT symbol, date, industry, pe, pe_threshold FROM peth_p", "pe pe_threshold")
def _(p):
    return pe_panel(p).select("symbol", "date", "industry", "pe", "pe_threshold")


@plan("b23_negative_news_gate", """SELECT symbol, c AS composite_score, g AS neg_news_gate FROM (SELECT symbol, g, news_score * (1 + g) AS c FROM (SELECT *, CASE WHEN news_score < cut THEN -0.08 ELSE 0.0 END AS g FROM (
   SELECT *, CASE WHEN count(news_score) OVER () >= 20 THEN least(quantile_cont(news_score, 0.15) OVER (), 0.3) ELSE 0.15 END AS cut FROM news_p)))""", "composite_score neg_news_gate")
def _(p):
    from .flows import news_scores

    d = news_scores(p).withColumns({"_g": F.lit(1), "composite_score": C("news_score")})
    return sn.news_gate(d, p.pool, "_g").select("symbol", "composite_score", "neg_news_gate")


cte("rs_p", """SELECT b.symbol, b.date, coalesce(b.close / lag(b.close, 20) OVER (PARTITION BY b.symbol ORDER BY b.date) - 1 - ir, 0) AS excess_20 FROM bars_p b JOIN (SELECT date, close / lag(close, 20) OVER (ORDER BY date) - 1 AS ir FROM index_p) i ON i.date = b.date""")


@plan("c06_relative_strength", "SELECT * FROM rs_p", "excess_20")
def _(p):
    return sn.relative_strength(p.closes(), p.index()).select("symbol", "date", "excess_20")


@plan("b24_crisis_filter", "SELECT d.symbol, d.date, d.regime FROM dims_p d JOIN rs_p r ON r.symbol = d.symbol AND r.date = d.date WHERE NOT (regime = 'crisis' AND (excess_20 < -0.10 OR (n >= 60 AND close < sma60)))")
def _(p):
    d = rec.dimension_scores(p).join(sn.relative_strength(p.closes(), p.index()).select("symbol", "date", "excess_20"), ["symbol", "date"])
    return sn.crisis_filter(d).select("symbol", "date", "regime")


cte("atrk_p", "SELECT symbol, date FROM (SELECT *, quantile_cont(atr14 / close, 0.8) OVER (PARTITION BY date) AS q FROM dims_p) WHERE atr14 / close <= least(q, 10.0)")


@plan("b25_atr_risk_filter", "SELECT * FROM atrk_p")
def _(p):
    return sn.atr_risk(at_scan(p, ind.atr(p.bars())), p.xs, cap=10.0).select("symbol", "date")


@plan("b26_vol_risk_filter", "SELECT symbol, date, vol FROM (SELECT *, quantile_cont(vol, 0.85) OVER (PARTITION BY date) AS q FROM (SELECT symbol, date, CASE WHEN n >= 10 THEN hv20 END AS vol FROM dims_p)) WHERE vol <= least(coalesce(q, 20.0), 20.0)", "vol")
def _(p):
    return sn.vol_risk(at_scan(p, sn.window_volatility(p.closes(), 20, False)), p.xs, cap=20.0).select("symbol", "date", "vol")


cte("heat_p", "SELECT symbol, date, mode, CASE WHEN r5 > 0.25 OR r10 > 0.35 THEN composite_score * 0.85 ELSE composite_score END AS composite_score FROM comp_p WHERE NOT (coalesce(r5, 0) > 0.35 OR coalesce(r10, 0) > 0.50)")


@plan("b27_overheating_filter", "SELECT * FROM heat_p", "composite_score")
def _(p):
    return sn.overheating(rec.composites(p)).select("symbol", "date", "mode", "composite_score")


@plan("b28_score_threshold", "SELECT symbol, date, mode, composite_score FROM comp_p WHERE composite_score >= CASE regime WHEN 'bull' THEN 0.45 WHEN 'bear' THEN 0.55 WHEN 'crisis' THEN 0.60 ELSE 0.50 END", "composite_score")
def _(p):
    return rec.composites(p).where(C("composite_score") >= sn.score_floor(C("regime"))).select("symbol", "date", "mode", "composite_score")


@plan("b29_alert_check", "SELECT symbol, date, seq, event_type FROM ann_p WHERE event_type <> 'general' AND date >= (SELECT max(date) FROM ann_p) - INTERVAL 7 DAY")
def _(p):
    d = p.announcements().where(C("event_type") != "general")
    return d.where(C("date") >= F.date_sub(p.announcements().agg(F.max("date")).scalar(), 7)).select("symbol", "date", "seq", "event_type")


def watch(p):
    """Watch entries from the trades with the symbol's last close."""
    last = fl.last_rows(p.closes()).select("symbol", C("close").alias("latest_price"), C("date").alias("today"))
    d = p.trades().select("trade_id", "symbol", "entry_price", (C("entry_price") * 0.8).alias("stop_loss"), (C("entry_price") * 1.5).alias("take_profit"), F.date_add("exit_date", 400).alias("valid_until"))
    return d.join(last, "symbol", "left")


WST = "CASE WHEN close <= entry_price * 0.8 THEN 'stopped_loss' WHEN close >= entry_price * 1.5 THEN 'taken_profit' WHEN l.date > exit_date + 400 THEN 'expired' ELSE 'active' END"


@plan("b30_watch_status", f"SELECT trade_id, t.symbol, {WST} AS status FROM trades_p t LEFT JOIN last_close l ON l.symbol = t.symbol")
def _(p):
    return watch(p).select("trade_id", "symbol", tr.watch_status("stop_loss", "take_profit", "valid_until", "latest_price", "today").alias("status"))


@plan("c15_watch_entries_with_status", f"SELECT trade_id, t.symbol, entry_price, close AS latest_price, (close / entry_price - 1) * 100 AS unrealized_pct, {WST} AS status FROM trades_p t LEFT JOIN last_close l ON l.symbol = t.symbol", "entry_price latest_price unrealized_pct")
def _(p):
    s = tr.watch_status("stop_loss", "take_profit", "valid_until", "latest_price", "today")
    return watch(p).select("trade_id", "symbol", "entry_price", "latest_price", ((C("latest_price") / C("entry_price") - 1) * 100).alias("unrealized_pct"), s.alias("status"))


@plan("b34_regime_block", "SELECT date, mode, regime FROM regime_p, (SELECT unnest(['momentum', 'swing', 'value', 'dividend', 'growth']) AS mode) WHERE NOT ((regime = 'sideways' AND mode IN ('momentum', 'growth')) OR (regime = 'crisis' AND mode = 'growth'))")
def _(p):
    d = regimes(p).select("date", "regime", F.explode(F.array(*[F.lit(m) for m in sc.MODES])).alias("mode"))
    return d.where(sc.mode_allowed(C("mode"), C("regime"))).select("date", "mode", "regime")


# -- F --------------------------------------------------------------------------------


def coarse(p):
    return rk.coarse_ranks(rk.coarse_inputs(p.wide()), p.xs)


cte("coarse0_p", """SELECT b.*, sum(f.total_net) OVER (PARTITION BY b.symbol ORDER BY b.date RANGE INTERVAL 28 DAY PRECEDING) AS inst_net, coalesce(b.close / r.close - 1, 0) AS momentum FROM bars_p b JOIN flows_p f ON f.symbol = b.symbol AND f.date = b.date
   LEFT JOIN (SELECT symbol AS rs, date AS rd, close FROM bars_p) r ON r.rs = b.symbol AND r.rd = b.date - INTERVAL 28 DAY""")
cte("coarse_p", f"""SELECT *, round(vol_rank * 0.3 + inst_rank * 0.4 + mom_rank * 0.3, 9) AS coarse_score FROM (SELECT *, {pr_sql('volume', 'date')} AS vol_rank, {pr_sql('inst_net', 'date')} AS inst_rank, {pr_sql('momentum', 'date')} AS mom_rank FROM coarse0_p)""")


@plan("f01_finalize_coarse", "SELECT * FROM (SELECT symbol, date, coarse_score, row_number() OVER (PARTITION BY date ORDER BY coarse_score DESC, symbol) AS coarse_rank, count(*) OVER (PARTITION BY date) AS n FROM coarse_p) SELECT symbol, date, coarse_score, coarse_rank WHERE coarse_rank <= greatest(20, floor(0.15 * n))".replace("SELECT * FROM (", "FROM ("), "coarse_score")
def _(p):
    return rk.coarse_top(coarse(p), p.xs, 20).select("symbol", "date", "coarse_score", "coarse_rank")


@plan("f02_effective_top_n", "SELECT date, count(*) AS universe, greatest(10, floor(0.15 * count(*)))::BIGINT AS top_n FROM bars_p GROUP BY 1")
def _(p):
    d = p.closes().groupBy("date").agg(F.count(F.lit(1)).alias("universe"))
    return d.withColumn("top_n", rk.effective_top_n(C("universe"), 10).cast("long"))


@plan("f03_coarse_filter", "SELECT symbol, date, vol_rank, inst_rank, mom_rank, coarse_score FROM coarse_p", "vol_rank inst_rank mom_rank coarse_score")
def _(p):
    return coarse(p).select("symbol", "date", "vol_rank", "inst_rank", "mom_rank", "coarse_score")


@plan("f04_momentum_5d", "SELECT symbol, date, momentum FROM coarse0_p", "momentum")
def _(p):
    return rk.coarse_inputs(p.wide()).select("symbol", "date", "momentum")


@plan("f05_inst_net_buy", f"SELECT symbol, date, inst_net, {pr_sql('inst_net', 'date')} AS inst_rank FROM coarse0_p", "inst_net inst_rank")
def _(p):
    return p.xs.pct_rank(rk.coarse_inputs(p.wide()), "date", {"inst_rank": ("inst_net", True)}).select("symbol", "date", "inst_net", "inst_rank")


@plan("f06_rank_and_enrich", f"""SELECT c.symbol, c.date, name, industry, close, coarse_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY coarse_score DESC, symbol) AS rank FROM (
    SELECT symbol, date, close, round(vr * 0.3 + ir * 0.4 + mr * 0.3, 9) AS coarse_score FROM (SELECT c.symbol, c.date, c.close, {pr_sql('c.volume', 'c.date')} AS vr, {pr_sql('c.inst_net', 'c.date')} AS ir, {pr_sql('c.momentum', 'c.date')} AS mr FROM coarse0_p c
      JOIN funnel_p f ON f.symbol = c.symbol AND f.date = c.date WHERE f.ok_liquid AND f.ok_trend))) c JOIN info_p i ON i.symbol = c.symbol WHERE rank <= 10""", "close coarse_score")
def _(p):
    """Flagship: weekly bars -> features -> liquidity and trend filter -> ranks -> Top-10."""
    f = sn.limit_moves(sn.turnover_five(ind.feature_columns(rk.coarse_inputs(p.wide()))), CFG)
    f = f.join(p.info().where(C("listing_type").isin(TYPES)).select("symbol", "name", "industry"), "symbol")
    f = f.join(regimes(p).select("date", "regime"), "date")
    m = lookup(C("regime"), sn.TURNOVER_MULTIPLIER, 1.0)
    f = f.where(sn.liquid(f, CFG, m) & sn.trending(CFG, CFG.volume_ratio_min))
    d = rk.coarse_ranks(f, p.xs)
    d = p.xs.top(d, "date", [F.desc("coarse_score"), C("symbol")], 10)
    return d.select("symbol", "date", "name", "industry", "close", "coarse_score", "rank")


cte("divp_p", """SELECT *, row_number() OVER (PARTITION BY date, mode ORDER BY pool_rank) AS r2 FROM (SELECT *, row_number() OVER (PARTITION BY date, mode, industry ORDER BY pool_rank) AS k FROM (SELECT p.*, i.industry FROM pool_p p JOIN info_p i ON i.symbol = p.symbol WHERE pool_rank <= 40)) WHERE k <= 5""")


@plan("f07_sector_diversification", "SELECT symbol, date, mode, industry, pool_rank, r2 AS rank FROM divp_p WHERE r2 <= 20")
def _(p):
    d = rec.pool(p).where(C("pool_rank") <= 40).join(p.info().select("symbol", "industry"), "symbol")
    return rk.diversify(d, KEY, 20).select("symbol", "date", "mode", "industry", "pool_rank", "rank")


@plan("d18_sector_summary", "SELECT date, mode, industry, count(*) AS n, avg(composite_score) AS avg_score FROM picks_p p JOIN info_p i ON i.symbol = p.symbol GROUP BY 1, 2, 3", "avg_score")
def _(p):
    d = rec.picks(p).join(p.info().select("symbol", "industry"), "symbol")
    return d.groupBy(*KEY, "industry").agg(F.count(F.lit(1)).alias("n"), F.avg("composite_score").alias("avg_score"))


TOPN = "CASE WHEN drawdown_20d > -0.10 OR mode IN ('value', 'dividend') THEN 20 WHEN drawdown_20d > -0.15 THEN 10 ELSE 6 END"


@plan("f08_drawdown_adjusted_top_n", f"SELECT symbol, p.date, mode, rank FROM picks_p p JOIN idxdd_p d ON d.date = p.date WHERE rank <= {TOPN}")
def _(p):
    dd = ind.drawdown_from_high(p.index(), key="market").select("date", "drawdown_20d")
    d = rec.picks(p).join(dd, "date")
    return d.where(C("rank") <= rk.drawdown_top_n(C("drawdown_20d"), C("mode").isin("value", "dividend"), 20)).select("symbol", "date", "mode", "rank")


@plan("f09_candidate_pool", "SELECT symbol, date, mode, composite_score, pool_rank, selected FROM pool_p", "composite_score")
def _(p):
    return rec.pool(p).select("symbol", "date", "mode", "composite_score", "pool_rank", "selected")


def sectors(p):
    info = p.info()
    return rk.rank_sectors(fl.sector_flow(p.flow_long(), info, 20), fl.sector_momentum(p.closes(), info), fl.sector_flow_acceleration(p.flows(), info), p.xs)


HALF = lambda c: f"CASE WHEN max({c}) OVER () > min({c}) OVER () THEN {pr_sql(c, 'g')} ELSE 0.5 END"
cte("secrank_p", f"""SELECT *, row_number() OVER (ORDER BY sector_score DESC, industry) AS rank FROM (SELECT *, round(0.5 * institutional_score + 0.5 * momentum_score, 9) AS sector_score FROM (
   SELECT *, 0.3 * ({HALF('total_net')}) + 0.7 * ({HALF('flow_acceleration')}) AS institutional_score, {HALF('avg_return_pct')} AS momentum_score FROM (
     SELECT coalesce(f.industry, m.industry) AS industry, 1 AS g, coalesce(total_net, 0) AS total_net, coalesce(avg_return_pct, 0) AS avg_return_pct, coalesce(stock_count, 0) AS stock_count, coalesce(flow_acceleration, 0) AS flow_acceleration
     FROM sflow_p f FULL JOIN smom_p m ON m.industry = f.industry LEFT JOIN sacc_p a ON a.industry = coalesce(f.industry, m.industry))))""")


@plan("f10_rank_sectors", "SELECT industry, sector_score, institutional_score, momentum_score, total_net, avg_return_pct, stock_count, rank FROM secrank_p", "sector_score institutional_score momentum_score total_net avg_return_pct")
def _(p):
    return sectors(p).select("industry", "sector_score", "institutional_score", "momentum_score", "total_net", "avg_return_pct", "stock_count", "rank")


cte("secbonus_p", "SELECT i.symbol, i.industry, 0.05 * (1 - 2 * (rank - 1) / nullif((SELECT count(*) FROM secrank_p) - 1, 0)) AS sector_bonus FROM info_p i JOIN secrank_p s ON s.industry = i.industry")


@plan("f11_sector_scores_for_stocks", "SELECT * FROM secbonus_p", "sector_bonus")
def _(p):
    return rk.sector_bonus(sectors(p), p.info())


@plan("f12_top_stocks_from_hot_sectors", """SELECT symbol, industry, fn AS foreign_net_sum, k AS rank_in_sector FROM (SELECT f.symbol, i.industry, sum(foreign_net) AS fn, row_number() OVER (PARTITION BY i.industry ORDER BY sum(foreign_net) DESC, f.symbol) AS k FROM flows_p f JOIN info_p i ON i.symbol = f.symbol
   JOIN secrank_p s ON s.industry = i.industry AND s.rank <= 3 WHERE f.date IN (SELECT DISTINCT date FROM flows_p ORDER BY date DESC LIMIT 20) GROUP BY 1, 2) WHERE k <= 5""", "foreign_net_sum")
def _(p):
    hot = sectors(p).where(C("rank") <= 3).select("industry")
    d = fl.recent_dates(p.flows(), 20).groupBy("symbol").agg(F.sum("foreign_net").alias("foreign_net_sum"))
    d = d.join(p.info().select("symbol", "industry"), "symbol").join(hot, "industry", "left_semi")
    return p.xs.top(d, "industry", [F.desc("foreign_net_sum"), C("symbol")], 5, "rank_in_sector")


def concept_ranks(p):
    m = p.concepts()
    f = fl.investor_weighted(fl.recent_dates(p.flow_long(), 20)).groupBy("symbol").agg(F.sum("weighted_net").alias("net"))
    return rk.rank_concepts(fl.concept_mean(f, m, "net", "concept_flow"), fl.concept_mean(fl.window_return(p.closes(), 20), m, "ret", "concept_momentum"), p.xs), m


cte("conrank_p", f"""SELECT *, row_number() OVER (ORDER BY concept_score DESC, concept) AS rank FROM (SELECT *, round(0.5 * institutional_score + 0.5 * momentum_score, 9) AS concept_score FROM (
   SELECT *, {HALF('concept_flow')} AS institutional_score, {HALF('concept_momentum')} AS momentum_score FROM (SELECT m.concept, 1 AS g, concept_momentum, m.n_members, coalesce(concept_flow, 0) AS concept_flow FROM cmom_p m LEFT JOIN cflow_p f ON f.concept = m.concept)))""")


@plan("f13_rank_concepts", "SELECT concept, concept_score, institutional_score, momentum_score, n_members, rank FROM conrank_p", "concept_score institutional_score momentum_score")
def _(p):
    return concept_ranks(p)[0].select("concept", "concept_score", "institutional_score", "momentum_score", "n_members", "rank")


cte("conbonus_p", """SELECT symbol, max(b) AS concept_bonus FROM concepts_p c JOIN (SELECT concept, ((concept_score - min(concept_score) OVER ()) / CASE WHEN max(concept_score) OVER () > min(concept_score) OVER () THEN max(concept_score) OVER () - min(concept_score) OVER () ELSE 1 END * 2 - 1) * 0.05 AS b FROM conrank_p) r ON r.concept = c.concept GROUP BY 1""")


@plan("f14_concept_scores_for_stocks", "SELECT * FROM conbonus_p", "concept_bonus")
def _(p):
    return rk.concept_bonus(*concept_ranks(p))


def with_stops(p):
    return rec.picks(p)


@plan("f16_composite_rankings", """SELECT date, symbol, score, primary_mode, stop_loss, close, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY date, primary_mode ORDER BY score DESC, symbol) AS q FROM (
   SELECT date, symbol, round(avg(composite_score), 9) AS score, arg_max(mode, (composite_score, mode)) AS primary_mode, max(stop_loss) AS stop_loss, max(close) AS close FROM picks_p GROUP BY 1, 2)) WHERE q <= 2 QUALIFY rank <= 10""", "score stop_loss close")
def _(p):
    return rk.composite_rankings(rec.picks(p), ["date"], 10, 2)


@plan("f17_resolve_rankings", """SELECT date, symbol, score, primary_mode, stop_loss, close, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS rank FROM (
   SELECT date, symbol, round(avg(composite_score), 9) AS score, arg_max(mode, (composite_score, mode)) AS primary_mode, max(stop_loss) AS stop_loss, max(close) AS close FROM picks_p WHERE mode IN ('momentum', 'growth', 'swing') GROUP BY 1, 2) QUALIFY rank <= 15""", "score stop_loss close")
def _(p):
    return rk.composite_rankings(rec.picks(p).where(~C("mode").isin("value", "dividend")), ["date"], 15, None)


@plan("f18_cross_comparison", "SELECT date, symbol, " + ", ".join(f"max(rank) FILTER (mode = '{m}')::DOUBLE AS {m}_rank" for m in sc.MODES) + ", count(*) AS appearances, min(rank) AS best_rank, avg(composite_score) AS avg_score, arg_max(mode, (composite_score, mode)) AS best_mode FROM picks_p GROUP BY 1, 2", "avg_score")
def _(p):
    return rk.cross_comparison(rec.picks(p), ["date"], sc.MODES)


@plan("f20_prewarm_top_turnover", "SELECT symbol, sum(turnover) AS turnover FROM (SELECT * FROM bars_p QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 5) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 200", "turnover:2")
def _(p):
    d = fl.last_rows(p.bars().select("symbol", "date", "turnover"), 5).groupBy("symbol").agg(F.sum("turnover").alias("turnover"))
    return d.orderBy(F.desc("turnover"), "symbol").limit(200)


# -- G --------------------------------------------------------------------------------

cte("scans_p", "SELECT mode, date, lag(date) OVER (PARTITION BY mode ORDER BY date) AS prev_date FROM (SELECT DISTINCT mode, date FROM picks_p)")
cte("cmp_p", """SELECT s.mode, s.date, x.symbol, c.rank, q.rank AS prev_rank FROM scans_p s JOIN (SELECT mode, date, symbol FROM picks_p UNION SELECT n.mode, n.date, k.symbol FROM scans_p n JOIN picks_p k ON k.mode = n.mode AND k.date = n.prev_date) x ON x.mode = s.mode AND x.date = s.date
   LEFT JOIN picks_p c ON c.mode = s.mode AND c.date = s.date AND c.symbol = x.symbol LEFT JOIN picks_p q ON q.mode = s.mode AND q.date = s.prev_date AND q.symbol = x.symbol WHERE s.prev_date IS NOT NULL""")


@plan("g01_discovery_comparison", "SELECT mode, date, symbol, CASE WHEN prev_rank IS NULL THEN 'new' WHEN rank IS NULL THEN 'exit' WHEN abs(prev_rank - rank) >= 3 THEN 'moved' ELSE 'stayed' END AS status, coalesce(prev_rank - rank, 0) AS rank_change FROM cmp_p")
def _(p):
    return rk.compare_scans(rec.picks(p), ["mode"]).select("mode", "date", "symbol", "status", "rank_change")


cte("turn_p", "SELECT *, curr_count - overlap AS new_entries, prev_count - overlap AS exits, 1 - overlap / greatest(curr_count, prev_count, 1) AS turnover, overlap / (curr_count + prev_count - overlap) AS jaccard FROM (SELECT mode, date, count(rank) AS curr_count, count(prev_rank) AS prev_count, count(*) FILTER (rank IS NOT NULL AND prev_rank IS NOT NULL) AS overlap FROM cmp_p GROUP BY 1, 2)")


@plan("g02_turnover", "SELECT * EXCLUDE jaccard FROM turn_p", "turnover")
def _(p):
    return rk.turnover(rec.picks(p), ["mode"]).drop("jaccard")


@plan("g03_jaccard_stability", "SELECT mode, avg(jaccard) AS mean_jaccard, median(jaccard) AS median_jaccard, min(jaccard) AS min_jaccard, max(jaccard) AS max_jaccard, count(*) AS n_pairs FROM turn_p GROUP BY 1", "mean_jaccard median_jaccard min_jaccard max_jaccard")
def _(p):
    return rk.stability(rk.turnover(rec.picks(p), ["mode"]), ["mode"])


@plan("g04_signal_stability", """SELECT mode, avg(j) AS mean_jaccard, median(j) AS median_jaccard, min(j) AS min_jaccard, max(j) AS max_jaccard, count(*) AS n_pairs FROM (SELECT s.mode, s.date, o / (5 + 5 - o) AS j FROM scans_p s JOIN (
   SELECT a.mode, a.date, count(b.symbol) AS o FROM picks_p a JOIN scans_p s ON s.mode = a.mode AND s.date = a.date LEFT JOIN picks_p b ON b.mode = a.mode AND b.date = s.prev_date AND b.symbol = a.symbol AND b.rank <= 5 WHERE a.rank <= 5 GROUP BY 1, 2) x ON x.mode = s.mode AND x.date = s.date WHERE prev_date >= DATE '2001-01-01') GROUP BY 1""", "mean_jaccard median_jaccard min_jaccard max_jaccard")
def _(p):
    d = rec.picks(p).where((C("rank") <= 5) & (C("date") >= F.lit("2001-01-01").cast("date")))
    return rk.stability(rk.turnover(d, ["mode"]), ["mode"])


@plan("g06_overlap_bonus", "SELECT c.symbol, c.date, c.mode, CASE WHEN k.symbol IS NOT NULL THEN 0.03 ELSE 0.0 END AS overlap_bonus, c.composite_score * (1 + CASE WHEN k.symbol IS NOT NULL THEN 0.03 ELSE 0 END) AS composite_score FROM comp_p c LEFT JOIN scans_p s ON s.mode = c.mode AND s.date = c.date LEFT JOIN picks_p k ON k.mode = c.mode AND k.date = s.prev_date AND k.symbol = c.symbol", "overlap_bonus composite_score")
def _(p):
    return rk.overlap_bonus(rec.composites(p), rec.picks(p), ["mode"]).select("symbol", "date", "mode", "overlap_bonus", "composite_score")


@plan("g07_mode_overlap", """SELECT mode_a, mode_b, avg(shared) AS shared FROM (SELECT a.mode AS mode_a, b.mode AS mode_b, d.date, count(y.symbol) AS shared FROM (SELECT DISTINCT date FROM picks_p) d, (VALUES ('momentum', 1), ('swing', 2), ('value', 3), ('dividend', 4), ('growth', 5)) a(mode, o), (VALUES ('momentum', 1), ('swing', 2), ('value', 3), ('dividend', 4), ('growth', 5)) b(mode, o2)
   LEFT JOIN picks_p x ON x.mode = a.mode AND x.date = d.date LEFT JOIN picks_p y ON y.mode = b.mode AND y.date = d.date AND y.symbol = x.symbol WHERE o <= o2 GROUP BY 1, 2, 3) GROUP BY 1, 2""", "shared")
def _(p):
    return rk.mode_overlap(rec.picks(p), sc.MODES)


def tiers(p):
    """Tier label from the size of the foreign flow at each scan."""
    d = at_scan(p, p.wide())
    return d.select("symbol", "date", F.when(C("foreign_net") > 20, "6F").when(C("foreign_net") > 0, "5F").when(C("foreign_net") == 0, "3F").otherwise("N/A").alias("chip_tier"))


@plan("g08_chip_tier_changes", """SELECT symbol, date, chip_tier, prev_tier, CASE WHEN o < po THEN 'downgrade' ELSE 'upgrade' END AS direction, prev_tier || '→' || chip_tier AS label FROM (SELECT *, lag(chip_tier) OVER w AS prev_tier, lag(o) OVER w AS po FROM (
   SELECT symbol, date, CASE WHEN foreign_net > 20 THEN '6F' WHEN foreign_net > 0 THEN '5F' WHEN foreign_net = 0 THEN '3F' ELSE 'N/A' END AS chip_tier, CASE WHEN foreign_net > 20 THEN 4 WHEN foreign_net > 0 THEN 3 WHEN foreign_net = 0 THEN 1 ELSE 0 END AS o FROM flows_p WHERE date IN (SELECT date FROM scan_p)) WINDOW w AS (PARTITION BY symbol ORDER BY date)) WHERE o <> po""")
def _(p):
    return rk.tier_changes(tiers(p), [])


@plan("g09_audit_tier_changes", """SELECT k.symbol, k.date, mode, rank, coalesce(label, '') AS tier_change FROM picks_p k LEFT JOIN (SELECT symbol, date, pt || '→' || chip_tier AS label FROM (SELECT *, lag(chip_tier) OVER (PARTITION BY symbol ORDER BY date) AS pt FROM (
   SELECT symbol, date, CASE WHEN foreign_net > 20 THEN '6F' WHEN foreign_net > 0 THEN '5F' WHEN foreign_net = 0 THEN '3F' ELSE 'N/A' END AS chip_tier FROM flows_p WHERE date IN (SELECT date FROM scan_p))) WHERE pt <> chip_tier) t ON t.symbol = k.symbol AND t.date = k.date""")
def _(p):
    t = rk.tier_changes(tiers(p), []).select("symbol", "date", "label")
    return rec.picks(p).join(t, ["symbol", "date"], "left").select("symbol", "date", "mode", "rank", F.coalesce("label", F.lit("")).alias("tier_change"))


@plan("g10_scan_audit_trail", "SELECT stage, type, count(*) AS n_events, count(DISTINCT symbol) AS n_symbols FROM (SELECT symbol, date, unnest([CASE WHEN NOT s1 THEN 's1' END, CASE WHEN NOT s2 THEN 's2' END, CASE WHEN NOT s3 THEN 's3' END]) AS stage, 'hard_filter' AS type FROM uni_p) WHERE stage IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT 'adj', 'score_adj', count(*), count(DISTINCT symbol) FROM uni_p WHERE from_memory")
def _(p):
    d = universe(p).withColumn("adj", C("from_memory").cast("double"))
    e = rk.audit_events(d, ["symbol", "date"], ["s1", "s2", "s3"], ["adj"])
    return e.groupBy("stage", "type").agg(F.count(F.lit(1)).alias("n_events"), F.countDistinct("symbol").alias("n_symbols"))
