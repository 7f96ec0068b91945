"""Mode filters, composite, soft and hard stages, whole scan, per-symbol report."""

from pyspark.sql import functions as F

from ..functions import trading as tr
from ..functions.exprs import clip, lookup
from ..functions.timeseries import add_busdays
from ..operators import flows as fl
from ..operators import indicators as ind
from ..operators import ranking as rk
from ..operators import scoring as sc
from ..operators import screen as sn
from . import pointintime as pt
from . import records as rec
from .ctes import cte, pr_sql
from .records import KEY
from .registry import plan
from .scan import CAPS, RISK, key_player_factor, soft_inputs
from .screening import snapshot
from .scoring import T5, at_scan, fundamental_panel, valuation_panel

C = F.col

# -- coarse filters by mode ----------------------------------------------------------------------


def coarse_scan(p):
    """Price, volume, flow and trend inputs of the coarse filters at scan dates."""
    d = rk.coarse_inputs(sc.price_inputs(p.wide()))
    return at_scan(p, d)


cte("cscan_p", "SELECT c.symbol, c.date, c.close, c.volume, c.inst_net, c.momentum, x.v20, x.sma60, x.n FROM coarse0_p c JOIN pxs_p x ON x.symbol = c.symbol AND x.date = c.date")
RANKS = lambda src: f"SELECT *, round(vol_rank * 0.3 + inst_rank * 0.4 + mom_rank * 0.3, 9) AS coarse_score FROM (SELECT *, {pr_sql('volume', 'date')} AS vol_rank, {pr_sql('inst_net', 'date')} AS inst_rank, {pr_sql('momentum', 'date')} AS mom_rank FROM ({src}))"
IN = {"vol_rank": "volume", "inst_rank": "inst_net", "mom_rank": "momentum", "dy_rank": "dividend_yield", "yoy_rank": "yoy_growth"}
MODE_SQL = lambda src, w: "SELECT symbol, date, round(" + " + ".join(f"{k} * {v}" for k, v in w.items()) + ", 9) AS coarse_score FROM (SELECT *, " + ", ".join(f"{pr_sql(IN[k], 'date')} AS {k}" for k in w) + f" FROM ({src}))"
WV, WD, WG = (rk.COARSE_BY_MODE[m] for m in ("value", "dividend", "growth"))
OUT3 = ("symbol", "date", "coarse_score")


@plan("i24_coarse_momentum", "SELECT symbol, date, coarse_score FROM (" + RANKS("SELECT * FROM cscan_p WHERE volume > v20 * 0.5") + ")", "coarse_score")
def _(p):
    return rk.coarse_ranks(coarse_scan(p).where(C("volume") > C("v20") * 0.5), p.xs).select(*OUT3)


@plan("i25_coarse_swing", f"SELECT symbol, date, trend_rank * 0.3 + inst_rank * 0.4 + vol_rank * 0.3 AS coarse_score FROM (SELECT *, {pr_sql('ts', 'date')} AS trend_rank, {pr_sql('cum20', 'date')} AS inst_rank, {pr_sql('volume', 'date')} AS vol_rank FROM (SELECT c.*, c.close / c.sma60 AS ts, f.cum20 FROM cscan_p c JOIN fl0_p f ON f.symbol = c.symbol AND f.date = c.date WHERE c.n >= 60 AND c.close > c.sma60))", "coarse_score")
def _(p):
    d = at_scan(p, sc.flow_inputs(sc.price_inputs(p.wide())))
    d = d.where((C("n") >= 60) & (C("close") > C("sma60"))).withColumn("ts", C("close") / C("sma60"))
    d = p.xs.pct_rank(d, "date", {"trend_rank": ("ts", True), "inst_rank": ("cum20", True), "vol_rank": ("volume", True)})
    return d.withColumn("coarse_score", C("trend_rank") * 0.3 + C("inst_rank") * 0.4 + C("vol_rank") * 0.3).select(*OUT3)


@plan("i26_coarse_value", MODE_SQL("SELECT c.* FROM cscan_p c JOIN peth_p t ON t.symbol = c.symbol AND t.date = c.date WHERE pe IS NOT NULL AND ((pe > 0 AND pe < pe_threshold) OR dividend_yield > 8.5)", WV), "coarse_score")
def _(p):
    v = valuation_panel(p).join(p.info().select("symbol", "industry"), "symbol")
    v = sn.pe_thresholds(v, p.xs, "date")
    ok = C("pe").isNotNull() & (((C("pe") > 0) & (C("pe") < C("pe_threshold"))) | sn.yes(C("dividend_yield") > 8.5))
    d = coarse_scan(p).join(v.where(ok).select("symbol", "date"), ["symbol", "date"], "left_semi")
    return rk.coarse_ranks(d, p.xs, weights=WV).select(*OUT3)


@plan("i27_coarse_dividend", MODE_SQL("SELECT c.*, v.dividend_yield FROM cscan_p c JOIN val_p v ON v.symbol = c.symbol AND v.date = c.date WHERE dividend_yield > 8 AND pe > 0 AND c.symbol NOT IN (SELECT symbol FROM (SELECT symbol, eps FROM statements_p QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 4) GROUP BY 1 HAVING bool_or(eps <= 0))", WD), "coarse_score")
def _(p):
    v = valuation_panel(p).where((C("dividend_yield") > 8) & (C("pe") > 0))
    bad = fl.last_rows(p.statements(), 4).groupBy("symbol").agg(F.bool_or(C("eps") <= 0).alias("bad")).where("bad")
    d = coarse_scan(p).join(v.select("symbol", "date", "dividend_yield"), ["symbol", "date"]).join(bad, "symbol", "left_anti")
    return rk.coarse_ranks(d, p.xs, weights=WD).select(*OUT3)


@plan("i28_coarse_growth", MODE_SQL("SELECT c.*, f.yoy_growth FROM cscan_p c JOIN fund_p f ON f.symbol = c.symbol AND f.date = c.date WHERE yoy_growth > 10", WG), "coarse_score")
def _(p):
    f = fundamental_panel(p).where(C("yoy_growth") > 10).select("symbol", "date", "yoy_growth")
    return rk.coarse_ranks(coarse_scan(p).join(f, ["symbol", "date"]), p.xs, weights=WG).select(*OUT3)


# -- composite -------------------------------------------------------------------------------------


@plan("i29_score_candidates", "SELECT symbol, date, mode, regime, technical_score, chip_score, fundamental_score, coalesce(news_score, 0.5) AS news_score, composite_score FROM comp_p", "technical_score chip_score fundamental_score news_score composite_score")
def _(p):
    d = rec.composites(p).withColumn("news_score", sc.half("news_score"))
    return d.select("symbol", "date", "mode", "regime", "technical_score", "chip_score", "fundamental_score", "news_score", "composite_score")


EXB = "CASE regime WHEN 'bull' THEN 1.5 WHEN 'bear' THEN 1.2 WHEN 'crisis' THEN 1.0 ELSE 1.5 END"
EXT = "CASE regime WHEN 'bull' THEN 3.5 WHEN 'bear' THEN 2.5 WHEN 'crisis' THEN 1.8 ELSE 3.0 END"
MULT = "CASE WHEN mdd_pct < 0.05 THEN 1.2 WHEN mdd_pct < 0.1 THEN 1.0 WHEN mdd_pct < 0.15 THEN 0.85 ELSE 0.7 END"
cte("entry_p", f"""SELECT d.symbol, d.date, d.close AS entry_price, CASE WHEN n >= 15 AND d.atr14 > 0 THEN d.close - {EXB} * {MULT} * d.atr14 END AS stop_loss, CASE WHEN n >= 15 AND d.atr14 > 0 THEN d.close + {EXT} * {MULT} * d.atr14 END AS take_profit, (d.date + 7)::DATE AS valid_until
   FROM (SELECT x.*, m.mdd_pct FROM dims_p x JOIN mddw_p m ON m.symbol = x.symbol AND m.date = x.date) d""")


@plan("i30_entry_exit_columns", "SELECT * FROM entry_p", "entry_price stop_loss:4 take_profit:4")
def _(p):
    d = ind.adaptive_stop(ind.atr(sc.price_inputs(p.bars())), base=1.0)
    d = at_scan(p, d)
    from .regime import regimes

    d = d.join(regimes(p).select("date", "regime"), "date")
    m = C("adjusted_stop_mult")
    live = (C("n") >= 15) & (C("atr14") > 0)
    pick = lambda t: lookup(C("regime"), t, t["sideways"])
    return d.select(
        "symbol",
        "date",
        C("close").alias("entry_price"),
        F.when(live, C("close") - pick(tr.ATR_STOP) * m * C("atr14")).alias("stop_loss"),
        F.when(live, C("close") + pick(tr.ATR_TARGET) * m * C("atr14")).alias("take_profit"),
        add_busdays("date", 5).alias("valid_until"),
    )


# -- bonuses of sectors, concepts, peers and key players, as they stood at every scan date ------------------

cte("compb_p", "SELECT c.*, b.* EXCLUDE (symbol, date) FROM comp_p c JOIN bond_p b ON b.symbol = c.symbol AND b.date = c.date")


def with_bonuses(p):
    return rec.composites(p, rec.dimension_scores(p).join(pt.bonuses(p), ["symbol", "date"]))


BONUS = {"i31_sector_bonus": "sector_bonus", "i32_concept_bonus": "concept_bonus", "i33_peer_fundamental_ranking": "peer_rank_bonus", "i49_sector_relative_strength_stage": "relative_strength_bonus"}
for _name, _col in BONUS.items():

    @plan(_name, f"SELECT symbol, date, mode, {_col}, composite_score * (1 + {_col}) AS composite_score FROM compb_p", f"{_col} composite_score")
    def _(p, col=_col):
        return with_bonuses(p).select("symbol", "date", "mode", col, (C("composite_score") * (1 + C(col))).alias("composite_score"))


# -- soft stages, joined once per (symbol, date) -----------------------------------------------------


cte("soft_p", """SELECT c.symbol, c.date, vp_divergence, momentum_decay, inst_accel_bonus, vcp_bonus, breakout_bonus, chip_macd_score, coalesce(weekly_bonus, 0) AS weekly_bonus FROM names_p c JOIN vp_p v ON v.symbol = c.symbol AND v.date = c.date JOIN decay_p d ON d.symbol = c.symbol AND d.date = c.date
   JOIN accel_p a ON a.symbol = c.symbol AND a.date = c.date JOIN vcp_p x ON x.symbol = c.symbol AND x.date = c.date JOIN brk_p b ON b.symbol = c.symbol AND b.date = c.date JOIN chip_macd_p m ON m.symbol = c.symbol AND m.date = c.date
   LEFT JOIN (SELECT symbol AS ws, (date - 4)::DATE AS wd, weekly_bonus FROM trendbonus_p) w ON ws = c.symbol AND wd = c.date""")
MTF = "CASE WHEN technical_score > 0.55 AND weekly_bonus > 0 THEN 0.04 WHEN technical_score <= 0.55 AND weekly_bonus < 0 THEN -0.03 WHEN technical_score > 0.55 AND weekly_bonus < 0 THEN -0.02 WHEN technical_score <= 0.55 AND weekly_bonus > 0 THEN -0.02 ELSE 0 END"
cte("softc_p", f"SELECT c.*, s.* EXCLUDE (symbol, date), ({MTF})::DOUBLE AS mtf_alignment FROM comp_p c JOIN soft_p s ON s.symbol = c.symbol AND s.date = c.date")


def scored(p):
    d = rec.composites(p, rec.dimension_scores(p).join(soft_inputs(p), ["symbol", "date"]))
    up = C("technical_score") > 0.55
    return d.withColumn("mtf_alignment", ind.timeframe_alignment(up, C("weekly_bonus")))


FAST = "mode IN ('momentum', 'growth')"
SOFT = {
    "i34_multi_timeframe_alignment": ("(1 + mtf_alignment)", lambda: 1 + C("mtf_alignment"), f"NOT ({FAST} AND mtf_alignment = -0.03)", lambda: ~(C("mode").isin("momentum", "growth") & (C("mtf_alignment") == -0.03))),
    "i35_chip_macd_stage": ("(1 + (chip_macd_score - 0.5) * 0.06)", lambda: 1 + (C("chip_macd_score") - 0.5) * 0.06, None, None),
    "i48_weekly_trend_bonus": ("(1 + weekly_bonus)", lambda: 1 + C("weekly_bonus"), None, None),
    "i50_momentum_decay_stage": (f"(1 + CASE WHEN {FAST} THEN momentum_decay ELSE 0 END)", lambda: 1 + F.when(C("mode").isin("momentum", "growth"), C("momentum_decay")).otherwise(0.0), None, None),
    "i51_institutional_acceleration_stage": ("(1 + inst_accel_bonus)", lambda: 1 + C("inst_accel_bonus"), None, None),
    "i52_volume_price_divergence_stage": ("(1 + vp_divergence)", lambda: 1 + C("vp_divergence"), None, None),
}
for _name, (_sql, _fn, _wsql, _wfn) in SOFT.items():

    @plan(_name, f"SELECT symbol, date, mode, composite_score * {_sql} AS composite_score FROM softc_p" + (f" WHERE {_wsql}" if _wsql else ""), "composite_score")
    def _(p, fn=_fn, wfn=_wfn):
        d = scored(p)
        if wfn:
            d = d.where(wfn())
        return d.select("symbol", "date", "mode", (C("composite_score") * fn()).alias("composite_score"))


KP = "(1 + (CASE WHEN close / key_player_cost < 0.95 THEN 0.8 WHEN close / key_player_cost > 1.10 THEN 0.2 ELSE 0.5 END - 0.5) * 0.067)"


@plan("i36_key_player_cost_stage", f"SELECT symbol, date, mode, key_player_cost, composite_score * {KP} AS composite_score FROM compb_p", "key_player_cost composite_score")
def _(p):
    return with_bonuses(p).select("symbol", "date", "mode", "key_player_cost", (C("composite_score") * key_player_factor()).alias("composite_score"))


@plan("i37_swing_post_score", "SELECT symbol, date, composite_score + greatest(vcp_bonus, breakout_bonus) AS composite_score FROM softc_p WHERE mode = 'swing'", "composite_score")
def _(p):
    d = scored(p).where(C("mode") == "swing")
    return d.select("symbol", "date", (C("composite_score") + F.greatest("vcp_bonus", "breakout_bonus")).alias("composite_score"))


# -- risk filters by mode ------------------------------------------------------------------------------

cte("riskin_p", """SELECT c.*, c.atr14 / c.close AS atr, CASE WHEN c.n >= 10 THEN c.hv20 END AS vol20, CASE WHEN c.n >= 10 THEN h.hv60 * sqrt(252.0) END AS vol60 FROM comp_p c JOIN (SELECT symbol, date, stddev_samp(r1) OVER (PARTITION BY symbol ORDER BY date ROWS 59 PRECEDING) AS hv60 FROM bars_r) h ON h.symbol = c.symbol AND h.date = c.date""")


def risk_sql(mode):
    m, q, heat = RISK[mode]
    base = f"SELECT * FROM (SELECT *, quantile_cont({m}, {q}) OVER (PARTITION BY date) AS q FROM riskin_p WHERE mode = '{mode}') WHERE {m} <= least(q, {CAPS[m]})"
    if heat:
        base = f"SELECT * REPLACE (CASE WHEN r5 > 0.25 OR r10 > 0.35 THEN composite_score * 0.85 ELSE composite_score END AS composite_score) FROM ({base}) WHERE NOT (coalesce(r5, 0) > 0.35 OR coalesce(r10, 0) > 0.50)"
    return f"SELECT symbol, date, composite_score FROM ({base})"


def risk_filter(p, d, mode):
    """The hard risk rule of a mode on rows that carry atr_ratio inputs, vol20 and vol60."""
    m, q, heat = RISK[mode]
    col = {"atr": "_atr", "vol20": "vol20", "vol60": "vol60"}[m]
    d = d.withColumn("_atr", C("atr14") / C("close"))
    d = p.xs.with_quantiles(d, "date", {"_q": (col, q)})
    d = d.where(C(col) <= F.least(C("_q"), F.lit(CAPS[m]))).drop("_q", "_atr")
    return sn.overheating(d) if heat else d


def with_vol(p, d):
    v = sn.window_volatility(p.closes(), 60, True).select("symbol", "date", C("vol").alias("vol60"))
    return d.join(at_scan(p, v), ["symbol", "date"]).withColumn("vol20", F.when(C("n") >= 10, C("hv20")))


for _i, _m in zip((43, 44, 45, 46, 47), ("momentum", "swing", "value", "dividend", "growth")):

    @plan(f"i{_i}_risk_filter_{_m}", risk_sql(_m), "composite_score")
    def _(p, m=_m):
        d = with_vol(p, rec.composites(p).where(C("mode") == m))
        return risk_filter(p, d, m).select("symbol", "date", "composite_score")


@plan("i53_value_post_score", "SELECT symbol, date, technical_score AS technical_score_raw, valuation_score AS technical_score FROM comp_p WHERE mode = 'value'", "technical_score technical_score_raw")
def _(p):
    d = rec.composites(p).where(C("mode") == "value")
    return d.select("symbol", "date", C("technical_score").alias("technical_score_raw"), C("valuation_score").alias("technical_score"))


@plan("i54_dividend_post_score", "SELECT symbol, date, technical_score AS technical_score_raw, dividend_score AS technical_score FROM comp_p WHERE mode = 'dividend'", "technical_score technical_score_raw")
def _(p):
    d = rec.composites(p).where(C("mode") == "dividend")
    return d.select("symbol", "date", C("technical_score").alias("technical_score_raw"), C("dividend_score").alias("technical_score"))


@plan("i55_sub_factor_frame", "SELECT t.symbol, t.date, r5_ AS tech_ret5d, rv_ AS tech_vol_ratio, k_bvr AS chip_bvr, k_consec AS chip_consec FROM tech5_p t FULL JOIN chipr_p c ON c.symbol = t.symbol AND c.date = t.date", "tech_ret5d tech_vol_ratio chip_bvr chip_consec")
def _(p):
    from .scoring import chip_panel

    t = sc.technical_momentum(at_scan(p, sc.price_inputs(p.bars_beside_wide())), p.xs).select("symbol", "date", *T5)
    c = chip_panel(p).select("symbol", "date", "k_bvr", "k_consec")
    j = t.join(c, ["symbol", "date"], "full")
    return j.select("symbol", "date", "tech_ret5d", "tech_vol_ratio", C("k_bvr").alias("chip_bvr"), C("k_consec").alias("chip_consec"))


# -- report ---------------------------------------------------------------------------------------------------


def report(p):
    """Technical, chip and fundamental scores per symbol and their blend."""
    d = snapshot(p)
    z = lambda c, v: F.coalesce(C(c), F.lit(v))
    rsi = clip((70 - z("rsi_14", 50.0)) / 40, 0, 1)
    macd = clip(0.5 + (z("macd", 0.0) - z("macd_signal", 0.0)) / (C("close") * 0.02), 0, 1)
    sma = F.when(C("sma_20") > 0, (C("close") > C("sma_20")).cast("double")).otherwise(0.5)
    last = fl.last_rows(d)
    t = last.select("symbol", "date", ((rsi + macd + sma) / 3).alias("technical_score"), clip(clip(z("yoy_growth", 0.0) / 50, 0, 1) + F.when(C("growth_streak") > 0, 0.1).otherwise(0.0), 0, 1).alias("fundamental_score"))
    look = fl.last_rows(d.select("symbol", "date", "foreign_net", "trust_net", "dealer_net", "margin_balance"), 60)
    tot = C("foreign_net") + C("trust_net") + C("dealer_net")
    a, b = F.min_by("margin_balance", "date"), F.max_by("margin_balance", "date")
    g = look.groupBy("symbol").agg(
        F.avg((C("foreign_net") > 0).cast("int")).alias("_f"), F.avg((tot > 0).cast("int")).alias("_i"), ((b - a) / F.greatest(a, F.lit(1.0))).alias("_m"), F.count(F.lit(1)).alias("_n")
    )
    m = F.when(C("_n") >= 2, clip(0.5 - C("_m") * 2, 0, 1)).otherwise(0.5)
    g = g.select("symbol", (0.4 * C("_f") + 0.4 * C("_i") + 0.2 * m).alias("chip_score"))
    return t.join(g, "symbol")


cte("rep_p", """SELECT t.symbol, date, technical_score, chip_score, fundamental_score FROM (SELECT symbol, date, (least(greatest((70 - coalesce(rsi_14, 50)) / 40, 0), 1) + least(greatest(0.5 + (coalesce(macd, 0) - coalesce(macd_signal, 0)) / (close * 0.02), 0), 1) + CASE WHEN sma_20 > 0 THEN (close > sma_20)::INT ELSE 0.5 END) / 3 AS technical_score,
     least(greatest(least(greatest(coalesce(yoy_growth, 0) / 50, 0), 1) + CASE WHEN growth_streak > 0 THEN 0.1 ELSE 0 END, 0), 1) AS fundamental_score FROM snap_p QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1) t
   JOIN (SELECT symbol, 0.4 * avg((foreign_net > 0)::INT) + 0.4 * avg((foreign_net + trust_net + dealer_net > 0)::INT) + 0.2 * CASE WHEN count(*) >= 2 THEN least(greatest(0.5 - (arg_max(margin_balance, date) - arg_min(margin_balance, date)) / greatest(arg_min(margin_balance, date), 1) * 2, 0), 1) ELSE 0.5 END AS chip_score
     FROM (SELECT * FROM snap_p QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 60) GROUP BY 1) c ON c.symbol = t.symbol""")


@plan("i39_report_technical", "SELECT symbol, technical_score FROM rep_p", "technical_score")
def _(p):
    return report(p).select("symbol", "technical_score")


@plan("i40_report_chip", "SELECT symbol, chip_score FROM rep_p", "chip_score")
def _(p):
    return report(p).select("symbol", "chip_score")


@plan("i41_report_fundamental", "SELECT symbol, fundamental_score FROM rep_p", "fundamental_score")
def _(p):
    return report(p).select("symbol", "fundamental_score")


BLEND = {"technical_score": 0.3, "chip_score": 0.3, "fundamental_score": 0.25, "model_score": 0.15}
cte("repm_p", "SELECT r.*, coalesce(probability_up, 0.5) AS model_score, technical_score * 0.3 + chip_score * 0.3 + fundamental_score * 0.25 + coalesce(probability_up, 0.5) * 0.15 AS composite FROM rep_p r LEFT JOIN mlscore_p m ON m.symbol = r.symbol")


def blended(p):
    """The report with the stored model's probability; names without enough history are neutral."""
    from .ml import model_score

    d = report(p).join(model_score(p).select("symbol", C("probability_up").alias("model_score")), "symbol", "left").withColumn("model_score", sc.half("model_score"))
    return d.withColumn("composite", sum((C(k) * w for k, w in BLEND.items()), F.lit(0.0)))


@plan("i42_report_composite", "SELECT symbol, model_score, composite FROM repm_p", "model_score composite")
def _(p):
    return blended(p).select("symbol", "model_score", "composite")


@plan("i56_report_run", "SELECT symbol, date, technical_score, chip_score, fundamental_score, model_score, composite, row_number() OVER (ORDER BY composite DESC, symbol) AS rank FROM (SELECT * REPLACE (round(composite, 9) AS composite) FROM repm_p)", "technical_score chip_score fundamental_score model_score composite")
def _(p):
    d = blended(p).withColumns({"composite": F.round("composite", 9), "_g": F.lit(1)})
    return p.pool.row_rank(d, "_g", "composite", "rank").drop("_g")
