"""I: dimension scores, composites and stages at every scan date."""

from pyspark.sql import functions as F

from ..functions import trading as tr
from ..functions.exprs import div, lookup
from ..functions.timeseries import add_busdays
from ..operators import flows as fl
from ..operators import indicators as ind
from ..operators import regime as rg
from ..operators import scoring as sc
from .ctes import cte, pr_sql
from .flows import penalties_by_date
from .regime import regimes
from .registry import plan

C = F.col

# -- shared inputs ----------------------------------------------------------------


def at_scan(p, df, date="date"):
    return df.join(p.scan_dates().withColumnRenamed("date", date), date, "left_semi")


def price_panel(p, extra=False):
    d = ind.rsi_latest(sc.price_inputs(p.bars())) if extra else sc.price_inputs(p.bars())
    return d


def chip_panel(p):
    """The stored table of flow, margin, broker, smart-broker and holder ranks at scan dates."""
    return p.shared("chip_panel", lambda: build_chip_panel(p))


#: What the chip panel keeps of the flow frame: inputs of its ranks, of the base score and of the modifiers.
CHIP_FLOWS = ["foreign_streak", "total_streak", "inst_flow_weighted", "foreign_sum", "trust_sum", "total_sum", "cum20", "buy_vol_ratio", "persist10", "persist20", "smr", "short_balance", "margin_balance", "inst_slope"]


def build_chip_panel(p):
    from . import pointintime as pt

    d = fl.flow_slope(sc.flow_inputs(p.wide())).select("symbol", "date", *CHIP_FLOWS)
    d = at_scan(p, d).join(at_scan(p, sc.broker_inputs(p.brokers())), ["symbol", "date"], "left")
    d = d.join(pt.smart_brokers(p, p.bars_beside_wide).select("symbol", "date", "smart_broker_factor", "n_smart"), ["symbol", "date"], "left")
    d = d.join(penalties_by_date(p, p.scan_dates(), p.bars_beside_wide).select("symbol", "date", "daytrade_penalty"), ["symbol", "date"], "left")
    w = fl.whale_share(p.holding()).withColumnRenamed("date", "q")
    d = d.withColumn("q", F.add_months(F.trunc("date", "quarter"), -3)).join(w, ["symbol", "q"], "left")
    z = lambda c: F.coalesce(C(c), F.lit(0))
    d = d.withColumns({"has_broker": z("lead_days") > 0, "has_sbl": z("short_balance") > 0, "has_margin": z("margin_balance") > 0, "has_whale": C("whale_percent").isNotNull(), "has_smart": z("n_smart") > 0})
    d = d.withColumn("smart_broker_factor", F.round(F.coalesce("smart_broker_factor", F.lit(0.0)), 9))
    return sc.chip_ranks(d, p.xs_columns, more={"k_smart": ("smart_broker_factor", True)})


def fundamental_panel(p, scan=None):
    """Point-in-time revenue and statement inputs at scan dates, with their ranks."""
    if scan is None:
        scan = at_scan(p, p.lines().groupBy("symbol", C("week").alias("date")).agg(F.count(F.lit(1)).alias("n_lines"))).drop("n_lines")
    rev = fl.revenue_acceleration(ind.revenue_pivot(p.revenue()))
    d = sc.revenue_asof(scan, rev)
    st = fl.earnings_quality(fl.ratios(p.statements()))
    st = sc.statement_inputs(st)
    d = sc.statements_asof(d, st, ["roe", "gross_margin", "free_cf", "earnings_quality", "roe_qoq", "gm_qoq", "gm_trend", "gm_yoy", "eps_yoy", "eps_qoq", "eps_std", "eps_pos"])
    return d


OV = "OVER (PARTITION BY symbol ORDER BY date"
cte("scan_p", "SELECT max(date) AS date FROM index_p GROUP BY date_trunc('month', date)")
A = lambda agg, c, n: f"{agg}({c}) {OV} ROWS {n - 1} PRECEDING)"
cte("px_p", f"""SELECT *, {', '.join(f"close / lag(close, {k}) {OV}) - 1 AS r{k}" for k in (2, 3, 5, 10, 60))},
    {', '.join(f"{A('avg', 'close', k)} AS sma{k}" for k in (5, 20, 60, 120))}, {', '.join(f"{A('avg', 'volume', k)} AS v{k}" for k in (3, 10, 20))},
    avg(volume) {OV} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS vprev, lag(volume, 2) {OV}) AS vlag2, {A('max', 'close', 20)} AS top20, {A('max', 'high', 5)} AS hi5, {A('min', 'low', 5)} AS lo5, {A('stddev_pop', 'close', 5)} AS sd5,
    {A('min', 'close', 120)} AS min120, avg(close) {OV} ROWS BETWEEN 79 PRECEDING AND 20 PRECEDING) AS sma60_ago, {A('min', 'r1', 45)} AS worst45, {A('stddev_samp', 'r1', 20)} AS hv20,
    {A('avg', 'CASE WHEN r1 > 0 THEN volume END', 20)} AS upv, {A('avg', 'CASE WHEN r1 <= 0 THEN volume END', 20)} AS dnv
  FROM (SELECT b.symbol, b.date, b.open, b.high, b.low, b.close, b.volume, b.turnover, b.r1, g.rn AS n, CASE WHEN g.rn < 15 THEN 50.0 WHEN g.al < 1e-10 THEN CASE WHEN g.ag > 0 THEN 100.0 ELSE 50.0 END ELSE 100 - 100 / (1 + g.ag / g.al) END AS rsi
        FROM bars_r b JOIN gl_p g ON g.symbol = b.symbol AND g.date = b.date)""")
cte("pxs_p", "SELECT * FROM px_p WHERE date IN (SELECT date FROM scan_p)")


def avg_sql(parts, enough):
    tot = " + ".join(f"coalesce(CASE WHEN {c} THEN {v} ELSE 0 END, 0)" for c, v in parts)
    n = " + ".join(f"coalesce(({c})::INT, 0)" for c, v in parts)
    return f"CASE WHEN {enough} AND ({n}) > 0 THEN ({tot}) / ({n}) ELSE 0.5 END"


U = lambda x: f"least(greatest({x}, 0.0), 1.0)"
I1 = avg_sql([("n >= 5", "(close > sma5)::INT::DOUBLE"), ("n >= 4", U("0.5 + r3 * 10")), ("n >= 3", "coalesce((close - lo5) / nullif(hi5 - lo5, 0), 0.5)"), ("n >= 3", "coalesce(least(2.0, volume / nullif(vprev, 0)) / 2, 0.5)"),
              ("n >= 5", "1 - least(sd5 / sma5 / 0.1, 1.0)"), ("n >= 3", "CASE WHEN r2 > 0 AND volume > vlag2 THEN 1.0 WHEN r2 > 0 THEN 0.3 WHEN volume <= vlag2 THEN 0.5 ELSE 0.2 END")], "n >= 3")
M3 = "((sma20 + sma60 + sma120) / 3)"
SPREAD = f"greatest(0.0, 1 - sqrt((pow(sma20 - {M3}, 2) + pow(sma60 - {M3}, 2) + pow(sma120 - {M3}, 2)) / 3) / {M3} / 0.06)"
I2 = avg_sql([("n >= 120", "greatest(0.0, 1 - (close / min120 - 1) / 0.5)"), ("n >= 15", "greatest(0.0, (70 - rsi) / 70)"), ("n >= 120", SPREAD), ("n >= 5", "(close > sma5)::INT::DOUBLE")], "n >= 15")
I3 = avg_sql([("n >= 80", f"CASE WHEN worst45 <= -0.95 THEN 0.5 ELSE {U('0.5 + (sma60 / sma60_ago - 1) * 50')} END"), ("n >= 15", "greatest(0.0, 1 - abs(rsi - 50) / 50)"), ("n >= 120", SPREAD), ("n >= 21", "greatest(0.0, 1 - hv20 / 0.03)")], "n >= 15")
I6 = avg_sql([("n >= 80", U("0.5 + (sma60 / sma60_ago - 1) * 50")), ("n >= 60", U("0.5 + (sma20 / sma60 - 1) * 20")), ("n >= 61", U("0.5 + r60 * 2")),
              ("n >= 21", f"CASE WHEN upv IS NOT NULL AND dnv IS NOT NULL THEN {U('upv / greatest(dnv, 1.0) / 2')} WHEN upv IS NOT NULL THEN 1.0 ELSE 0.0 END"),
              ("adx_14 IS NOT NULL", f"CASE WHEN plus_di > minus_di THEN {U('(adx_14 - 15) / 30')} ELSE 0.0 END")], "n >= 3")


@plan("i01_technical_short", f"SELECT symbol, date, {I1} AS technical_score FROM pxs_p", "technical_score")
def _(p):
    d = at_scan(p, price_panel(p))
    return d.select("symbol", "date", sc.technical_short(d).alias("technical_score"))


@plan("i02_technical_value", f"SELECT symbol, date, {I2} AS technical_score FROM pxs_p", "technical_score")
def _(p):
    d = at_scan(p, price_panel(p, True))
    return d.select("symbol", "date", sc.technical_value(d).alias("technical_score"))


@plan("i03_technical_dividend", f"SELECT symbol, date, {I3} AS technical_score FROM pxs_p", "technical_score")
def _(p):
    d = at_scan(p, price_panel(p, True))
    return d.select("symbol", "date", sc.technical_dividend(d, -0.95).alias("technical_score"))


def tech_sql(five: bool):
    ranks = {"r5": "x5", "rb": "xb", "rv": "xv"} | ({"r10": "x10", "ra": "xa"} if five else {})
    rk = ", ".join(f"{pr_sql(x, 'date')} AS {k}0" for k, x in ranks.items())
    fix = ", ".join(f"coalesce({'CASE WHEN r1 >= 0.098 THEN 1.0 ELSE ' + k + '0 END' if k in ('rv', 'ra') else k + '0'}, 0.5) AS {k}_" for k in ranks)
    a = "(r5_ + r10_) / 2" if five else "r5_"
    b = "(rv_ + ra_) / 2" if five else "rv_"
    sp = lambda x: f"max({x}) OVER w - min({x}) OVER w >= 1e-9"
    return f"""SELECT symbol, date, {', '.join(k + '_' for k in ranks)}, CASE WHEN oa::INT + ob::INT + oc::INT > 0 THEN (CASE WHEN oa THEN a ELSE 0 END + CASE WHEN ob THEN b ELSE 0 END + CASE WHEN oc THEN rb_ ELSE 0 END) / (oa::INT + ob::INT + oc::INT) ELSE 0.5 END AS technical_score FROM (
      SELECT *, {sp('a')} AS oa, {sp('b')} AS ob, {sp('rb_')} AS oc FROM (SELECT *, {a} AS a, {b} AS b FROM (SELECT *, {fix} FROM (SELECT symbol, date, r1, {rk} FROM (
        SELECT symbol, date, r1, r5 AS x5, r10 AS x10, CASE WHEN n >= 20 THEN close / top20 END AS xb, CASE WHEN n >= 20 THEN volume / nullif(v20, 0) END AS xv, CASE WHEN n >= 10 THEN v3 / nullif(v10, 0) END AS xa FROM pxs_p)))) WINDOW w AS (PARTITION BY date))"""


cte("tech5_p", tech_sql(True))
cte("tech3_p", tech_sql(False))
T5 = ["tech_ret5d", "tech_ret10d", "tech_high20_proximity", "tech_vol_ratio", "tech_vol_accel"]


@plan("i04_technical_momentum_5f", "SELECT symbol, date, r5_ AS tech_ret5d, r10_ AS tech_ret10d, rb_ AS tech_high20_proximity, rv_ AS tech_vol_ratio, ra_ AS tech_vol_accel, technical_score FROM tech5_p", " ".join(T5) + " technical_score")
def _(p):
    return sc.technical_momentum(at_scan(p, price_panel(p)), p.xs).select("symbol", "date", *T5, "technical_score")


@plan("i05_technical_momentum_3f", "SELECT symbol, date, technical_score FROM tech3_p", "technical_score")
def _(p):
    return sc.technical_momentum(at_scan(p, price_panel(p)), p.xs, clusters=3).select("symbol", "date", "technical_score")


cte("i06_p", f"SELECT p.symbol, p.date, {I6} AS technical_score FROM pxs_p p JOIN (SELECT symbol AS s_, date AS d_, plus_di, minus_di, adx_14 FROM ind_p) i ON s_ = p.symbol AND d_ = p.date")


@plan("i06_technical_swing", "SELECT * FROM i06_p", "technical_score")
def _(p):
    d = at_scan(p, ind.adx(price_panel(p)))
    return d.select("symbol", "date", sc.technical_swing(d).alias("technical_score"))


# -- chip twins ---------------------------------------------------------------------

cte("fl0_p", f"""SELECT *, {A('sum', 'foreign_net', 10)} AS foreign_sum, {A('sum', 'trust_net', 10)} AS trust_sum, {A('sum', 'total_net', 10)} AS total_sum, {A('sum', 'total_net', 20)} AS cum20, {A('sum', 'total_net', 10)} / nullif(volume, 0) AS buy_vol_ratio,
    count(*) FILTER (total_net > 0) OVER (PARTITION BY symbol ORDER BY date RANGE INTERVAL 63 DAY PRECEDING) / 10 AS persist10, count(*) FILTER (total_net > 0) OVER (PARTITION BY symbol ORDER BY date RANGE INTERVAL 133 DAY PRECEDING) / 20 AS persist20,
    CASE WHEN margin_balance > 0 THEN short_balance / margin_balance ELSE 0 END AS smr, k - max(CASE WHEN foreign_net > 0 THEN 0 ELSE k END) {OV}) AS foreign_streak, k - max(CASE WHEN total_net > 0 THEN 0 ELSE k END) {OV}) AS total_streak
  FROM (SELECT f.*, b.volume, b.close, m.margin_balance, m.short_balance, row_number() OVER (PARTITION BY f.symbol ORDER BY f.date) AS k FROM flows_p f JOIN bars_p b ON b.symbol = f.symbol AND b.date = f.date JOIN margin_p m ON m.symbol = f.symbol AND m.date = f.date)""")
cte("vwf_p", """SELECT a.symbol, a.date, sum(b.total_net * pow(0.85, a.k - b.k)) AS inst_flow_weighted FROM fl0_p a JOIN fl0_p b ON a.symbol = b.symbol AND b.k BETWEEN a.k - 9 AND a.k WHERE a.date IN (SELECT date FROM scan_p) GROUP BY 1, 2""")
cte("bin_p", f"""SELECT symbol, date, hhi, {A('avg', 'hhi', 3)} - {A('avg', 'hhi', 7)} AS hhi_trend, {A('avg', 'hhi', 3)} AS hhi_short_avg, CASE WHEN b IS NOT NULL THEN row_number() OVER (PARTITION BY symbol, g ORDER BY date) ELSE 0 END AS lead_days FROM (
  SELECT *, sum(CASE WHEN b = pb THEN 0 ELSE 1 END) {OV}) AS g FROM (SELECT h.*, b, lag(b) OVER (PARTITION BY h.symbol ORDER BY h.date) AS pb FROM hhi_p h LEFT JOIN (
    SELECT symbol, date, broker AS b FROM brokers_p WHERE buy > sell QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY buy - sell DESC, broker) = 1) t ON t.symbol = h.symbol AND t.date = h.date))""")
KS = {"k_streak": "foreign_streak", "k_bvr": "buy_vol_ratio", "k_flow": "ifw", "k_p10": "persist10", "k_p20": "persist20", "k_total": "total_sum", "k_trust": "trust_sum", "k_cum": "cum20", "k_smr": "smr", "k_sbl0": "short_balance",
      "k_hhi": "hhi", "k_lead": "lead_days", "k_wp": "wp", "k_wc": "wc", "k_for": "foreign_sum", "k_ts": "total_streak", "k_smart": "smart_"}
FLAGS = "lead_days > 0 AS has_broker, short_balance > 0 AS has_sbl, margin_balance > 0 AS has_margin, has_whale, has_smart"
cte("chipr_p", f"""SELECT *, k_flow * 0.6 + k_streak * 0.4 AS k_consec, 1 - k_sbl0 AS k_sbl, k_hhi * 0.6 + k_lead * 0.4 AS k_broker, k_wp * 0.6 + k_wc * 0.4 AS k_whale FROM (
  SELECT symbol, date, inst_slope, hhi_trend, hhi_short_avg, persist10, {FLAGS}, {', '.join(f"{pr_sql(c, 'date')} AS {k}" for k, c in KS.items())} FROM (
    SELECT f.*, round(coalesce(smart_broker_factor, 0), 9) AS smart_, coalesce(n_smart, 0) > 0 AS has_smart, whale_percent IS NOT NULL AS has_whale, round(inst_flow_weighted, 9) AS ifw, inst_slope, coalesce(hhi, 0) AS hhi, hhi_trend, hhi_short_avg, coalesce(lead_days, 0) AS lead_days, coalesce(whale_percent, 0) AS wp, coalesce(whale_change, 0) AS wc
    FROM fl0_p f JOIN vwf_p v ON v.symbol = f.symbol AND v.date = f.date JOIN slope_p s ON s.symbol = f.symbol AND s.date = f.date LEFT JOIN bin_p b ON b.symbol = f.symbol AND b.date = f.date
    LEFT JOIN smartd_p y ON y.symbol = f.symbol AND y.date = f.date LEFT JOIN whale_p w ON w.symbol = f.symbol AND w.date = date_trunc('quarter', f.date) - INTERVAL 3 MONTH))""")
MOD = lambda s: f"least(greatest({s} + CASE WHEN inst_slope > 0 THEN 0.03 WHEN inst_slope < 0 THEN -0.03 ELSE 0 END + CASE WHEN hhi_short_avg >= 0.25 THEN CASE WHEN hhi_trend > 0 THEN 0.03 WHEN hhi_trend < 0 THEN -0.03 ELSE 0 END ELSE 0 END, 0), 1)"
W8, TIER8 = sc.chip_tier_sql("momentum")
W9, TIER9 = sc.chip_tier_sql("swing")
W12, TIER12 = sc.chip_tier_sql("growth")
ONK = lambda k: f"(max({k}) OVER w - min({k}) OVER w >= 1e-9)"
LIVE = " + ".join(f"CASE WHEN {ONK(sc.CHIP_RANKS[k])} THEN {w} ELSE 0 END" for k, w in W8.items())
SUMK = " + ".join(f"CASE WHEN {ONK(sc.CHIP_RANKS[k])} THEN {sc.CHIP_RANKS[k]} * {w} ELSE 0 END" for k, w in W8.items())
ALLK = " + ".join(f"({w})" for w in W8.values())
cte("chipm_p", f"SELECT symbol, date, {MOD('s')} AS chip_score, chip_tier FROM (SELECT symbol, date, inst_slope, hhi_short_avg, hhi_trend, {TIER8} AS chip_tier, coalesce(({SUMK}) * ({ALLK}) / nullif({LIVE}, 0), 0.5) AS s FROM chipr_p WINDOW w AS (PARTITION BY date))")
BLEND = lambda w: " + ".join(f"{sc.CHIP_RANKS[k]} * {e}" for k, e in w.items())
CHIP = {
    "i10_chip_value": "k_trust * 0.4 + k_cum * 0.4 + k_broker * 0.2",
    "i11_chip_dividend": "k_trust * 0.5 + k_cum * 0.5",
}
cte("chip7_p", "SELECT symbol, date, k_for * 0.30 + k_trust * 0.20 + k_total * 0.20 + k_ts * 0.15 + k_bvr * 0.15 AS chip_score FROM chipr_p")


@plan("i07_chip_base", "SELECT * FROM chip7_p", "chip_score")
def _(p):
    return sc.chip_base(at_scan(p, sc.flow_inputs(p.wide())), p.xs).select("symbol", "date", "chip_score")


@plan("i08_chip_momentum", "SELECT symbol, date, chip_score, chip_tier FROM chipm_p", "chip_score")
def _(p):
    return sc.chip_momentum(chip_panel(p), p.xs).select("symbol", "date", "chip_score", "chip_tier")


@plan("i09_chip_swing", f"SELECT symbol, date, {MOD('(' + BLEND(W9) + ')')} AS chip_score, {TIER9} AS chip_tier FROM chipr_p", "chip_score")
def _(p):
    return sc.chip_swing(chip_panel(p)).select("symbol", "date", "chip_score", "chip_tier")


@plan("i12_chip_growth", f"SELECT symbol, date, {BLEND(W12)} AS chip_score, {TIER12} AS chip_tier FROM chipr_p", "chip_score")
def _(p):
    return sc.chip_growth(chip_panel(p)).select("symbol", "date", "chip_score", "chip_tier")


for _name, _fn in {"i10_chip_value": sc.chip_value, "i11_chip_dividend": sc.chip_dividend}.items():

    @plan(_name, f"SELECT symbol, date, {CHIP[_name]} AS chip_score FROM chipr_p", "chip_score")
    def _(p, fn=_fn):
        d = chip_panel(p)
        return d.select("symbol", "date", fn(d).alias("chip_score"))


@plan("d09_smart_broker_history", "SELECT symbol, date, smart_broker_score, accum_broker_score, smart_broker_factor, n_smart FROM smartd_p", "smart_broker_score accum_broker_score smart_broker_factor")
def _(p):
    from . import pointintime as pt

    return pt.smart_brokers(p)


@plan("i13_daytrade_adjusted_rank", """SELECT r.symbol, r.date, k_broker, daytrade_penalty, persist10, CASE WHEN daytrade_penalty > 0 THEN k_broker * (1 - daytrade_penalty * (1 - persist10) * 0.5) ELSE k_broker END AS broker_rank
  FROM chipr_p r LEFT JOIN dtd_p d ON d.symbol = r.symbol AND d.date = r.date""", "k_broker daytrade_penalty persist10 broker_rank")
def _(p):
    d = chip_panel(p).select("symbol", "date", "k_broker", "daytrade_penalty", "persist10")
    return d.withColumn("broker_rank", sc.broker_rank_penalty("k_broker", "daytrade_penalty", "persist10"))


@plan("i14_chip_quality_modifiers", f"SELECT symbol, date, {MOD('chip_score')} AS chip_score FROM (SELECT c.*, inst_slope, hhi_trend, hhi_short_avg FROM chip7_p c JOIN chipr_p r ON r.symbol = c.symbol AND r.date = c.date)", "chip_score")
def _(p):
    d = sc.chip_base(chip_panel(p), p.xs)
    return d.select("symbol", "date", sc.quality_modifiers(C("chip_score")).alias("chip_score"))


SIX = dict(sc.CHIP_TIERS["momentum"][0][1])
ON6 = lambda k, x: f"CASE WHEN {ONK(sc.CHIP_RANKS[k])} THEN {x} ELSE 0 END"


@plan("i15_exclude_zero_variance", f"SELECT symbol, date, coalesce(({' + '.join(ON6(k, f'{sc.CHIP_RANKS[k]} * {w}') for k, w in SIX.items())}) * {sum(SIX.values())!r} / nullif({' + '.join(ON6(k, w) for k, w in SIX.items())}, 0), 0.5) AS score FROM chipr_p WINDOW w AS (PARTITION BY date)", "score")
def _(p):
    d, s = sc.drop_flat_factors(chip_panel(p), p.xs, {sc.CHIP_RANKS[k]: w for k, w in SIX.items()})
    return d.select("symbol", "date", s.alias("score"))


@plan("h35_chip_base_weights", f"SELECT symbol, date, has_broker, has_sbl, has_margin, {TIER8} AS tier, {', '.join(f'{e} AS w_{k}' for k, e in W8.items())} FROM chipr_p", " ".join(f"w_{k}" for k in W8))
def _(p):
    w, tier = sc.chip_tier("momentum")
    return chip_panel(p).select("symbol", "date", "has_broker", "has_sbl", "has_margin", tier.alias("tier"), *[e.alias(f"w_{k}") for k, e in w.items()])


# -- fundamental twins ----------------------------------------------------------------

cte("names_p", "SELECT DISTINCT symbol, week AS date FROM lines_p WHERE week IN (SELECT date FROM scan_p)")
cte("sti_p", """SELECT a.*, e.earnings_quality, roe - lag(roe) OVER w AS roe_qoq, a.gross_margin - lag(a.gross_margin) OVER w AS gm_qoq, a.gross_margin - lag(a.gross_margin, 2) OVER w AS gm_trend, a.gross_margin - b.gm AS gm_yoy,
    (a.eps - b.ep) / CASE WHEN abs(b.ep) > 0.01 THEN abs(b.ep) END AS eps_yoy, (a.eps - lag(a.eps) OVER w) / CASE WHEN abs(lag(a.eps) OVER w) > 0.01 THEN abs(lag(a.eps) OVER w) END AS eps_qoq,
    coalesce(stddev_samp(a.eps) OVER (w ROWS 3 PRECEDING), 0) AS eps_std, avg((a.eps > 0)::INT) OVER (w ROWS 3 PRECEDING) AS eps_pos
  FROM ratios_p a LEFT JOIN (SELECT symbol, year, quarter, gross_margin AS gm, eps AS ep FROM ratios_p) b ON b.symbol = a.symbol AND b.year = a.year - 1 AND b.quarter = a.quarter JOIN eq_p e ON e.symbol = a.symbol AND e.date = a.date WINDOW w AS (PARTITION BY a.symbol ORDER BY a.date)""")
cte("revs_p", "SELECT v.symbol, v.date, v.yoy_growth, v.mom_growth, v.prev_yoy, v.yoy_3m_ago, a.rev_accel_score FROM revpivot_p v JOIN racc_p a ON a.symbol = v.symbol AND a.date = v.date")
cte("cut_p", """SELECT symbol, date, last_day(date - to_months(CASE WHEN day(date) >= 10 THEN 1 ELSE 2 END)) AS rcut, (SELECT max(q) FROM qends_p WHERE due <= date) AS fcut FROM names_p""")
cte("fund0_p", """SELECT c.symbol, c.date, r.date AS rdate, r.yoy_growth, r.mom_growth, r.prev_yoy, r.yoy_3m_ago, r.rev_accel_score, s.date AS quarter_end, s.* EXCLUDE (symbol, date, year, quarter, revenue)
  FROM cut_p c ASOF LEFT JOIN revs_p r ON r.symbol = c.symbol AND r.date <= c.rcut ASOF LEFT JOIN sti_p s ON s.symbol = c.symbol AND s.date <= c.fcut""")
cte("fund_p", """SELECT symbol, date, quarter_end, free_cf, gross_margin, roe, earnings_quality, roe_qoq, gm_qoq, gm_trend, gm_yoy, eps_yoy, eps_qoq, eps_std, eps_pos,
   CASE WHEN ok THEN rdate END AS revenue_month, CASE WHEN ok THEN yoy_growth END AS yoy_growth, CASE WHEN ok THEN mom_growth END AS mom_growth, CASE WHEN ok THEN prev_yoy END AS prev_yoy, CASE WHEN ok THEN yoy_3m_ago END AS yoy_3m_ago, CASE WHEN ok THEN rev_accel_score END AS rev_accel_score
   FROM (SELECT f.*, datediff('day', rdate, last_day(date - to_months(CASE WHEN day(date) >= 10 THEN 1 ELSE 2 END))) <= 180 AS ok FROM fund0_p f)""")
FR = {"f_y": ("coalesce(yoy_growth, 0)", 1), "f_m": ("coalesce(mom_growth, 0)", 1), "f_ap": ("coalesce(yoy_growth, 0) - coalesce(prev_yoy, 0)", 1), "f_a3": ("coalesce(yoy_growth, 0) - coalesce(yoy_3m_ago, 0)", 1), "f_eq": ("coalesce(earnings_quality, 0.5)", 1),
      "f_roeq": ("roe_qoq", 1), "f_gmt": ("gm_trend", 1), "f_roe": ("roe", 1), "f_gmq": ("gm_qoq", 1), "f_epsy": ("eps_yoy", 1), "f_std": ("eps_std", 0), "f_pos": ("eps_pos", 1), "f_gmy": ("gm_yoy", 1), "f_epsq": ("eps_qoq", 1)}
cte("fundr_p", "SELECT symbol, date, " + ", ".join(f"coalesce({pr_sql('(' + c + ')', 'date', bool(a))}, 0.5) AS {k}" for k, (c, a) in FR.items()) + " FROM fund_p")
FS = {
    "base": "f_y * 0.7 + f_m * 0.3",
    "swing": "f_y * 0.30 + f_m * 0.20 + f_ap * 0.20 + f_roeq * 0.15 + f_gmt * 0.15",
    "value": "(f_y * 0.7 + f_m * 0.3) * 0.35 + f_roe * 0.20 + f_gmq * 0.15 + f_epsy * 0.15 + f_eq * 0.15",
    "dividend": "(f_y * 0.7 + f_m * 0.3) * 0.35 + f_std * 0.25 + f_pos * 0.25 + f_eq * 0.15",
    "growth": "f_y * 0.40 + f_a3 * 0.25 + f_gmy * 0.20 + f_epsq * 0.15",
}


@plan("c01_revenue_point_in_time", "SELECT symbol, date, revenue_month, yoy_growth, mom_growth, prev_yoy, yoy_3m_ago FROM fund_p", "yoy_growth mom_growth prev_yoy yoy_3m_ago")
def _(p):
    return fundamental_panel(p).select("symbol", "date", "revenue_month", "yoy_growth", "mom_growth", "prev_yoy", "yoy_3m_ago")


@plan("c02_statements_point_in_time", "SELECT symbol, date, quarter_end, roe, gross_margin, eps_yoy FROM fund_p", "roe gross_margin eps_yoy")
def _(p):
    return fundamental_panel(p).select("symbol", "date", "quarter_end", "roe", "gross_margin", "eps_yoy")


for _name, _key in {"i16_fundamental_base": "base", "i18_fundamental_swing": "swing", "i19_fundamental_value": "value", "i22_fundamental_dividend": "dividend", "i23_fundamental_growth": "growth"}.items():

    @plan(_name, f"SELECT symbol, date, {FS[_key]} AS fundamental_score FROM fundr_p", "fundamental_score")
    def _(p, key=_key):
        d = sc.fundamental_ranks(fundamental_panel(p), p.xs)
        e = sc.fundamental_base() if key == "base" else sc.FUNDAMENTAL[key]()
        return d.select("symbol", "date", e.alias("fundamental_score"))


def with_quality(p, d):
    """Quality score at scan dates: rank of the margin change inside the scan date."""
    d = p.xs.pct_rank(d, "date", {"_q": ("gm_yoy", True)})
    d = p.xs.with_stats(d, "date", {"_qn": F.count("gm_yoy")})
    r = F.when(C("_qn") >= 2, sc.half("_q")).otherwise(0.5)
    f = F.when(C("free_cf") > 0, 1.0).when(C("free_cf").isNotNull(), 0.0).otherwise(0.5)
    return d.withColumn("quality_score", 0.6 * r + 0.4 * f).drop("_q", "_qn")


cte("fm_p", f"""SELECT symbol, date, tier, CASE WHEN tier = 0 THEN 0.5 ELSE 0.55 * CASE tier WHEN 1 THEN 0.85 WHEN 2 THEN 0.72 WHEN 3 THEN 0.55 ELSE 0.30 END + 0.15 * CASE WHEN nt >= 2 AND ir IS NOT NULL THEN ir ELSE 0.5 END + 0.20 * coalesce(rev_accel_score, 0.5) + 0.10 * qs END AS fundamental_score FROM (
  SELECT *, {pr_sql('yoy_growth', 'date, tier')} AS ir, count(yoy_growth) OVER (PARTITION BY date, tier) AS nt FROM (
    SELECT *, CASE WHEN yoy_growth IS NULL THEN 0 WHEN yoy_growth > 0 AND acc AND mom AND (ny < 10 OR yoy_growth > p80) THEN 1 WHEN yoy_growth > 0 AND acc AND (ny < 10 OR yoy_growth > p60) THEN 2 WHEN yoy_growth > 0 THEN 3 ELSE 4 END::BIGINT AS tier FROM (
      SELECT *, coalesce(mom_growth > 0, false) AS mom, coalesce(yoy_growth > yoy_3m_ago, false) AS acc, count(yoy_growth) OVER w AS ny, quantile_cont(yoy_growth, 0.8) OVER w AS p80, quantile_cont(yoy_growth, 0.6) OVER w AS p60,
        0.6 * CASE WHEN count(gm_yoy) OVER w >= 2 THEN coalesce({pr_sql('gm_yoy', 'date')}, 0.5) ELSE 0.5 END + 0.4 * CASE WHEN free_cf > 0 THEN 1.0 WHEN free_cf IS NOT NULL THEN 0.0 ELSE 0.5 END AS qs FROM fund_p WINDOW w AS (PARTITION BY date))))""")


@plan("i17_fundamental_momentum", "SELECT symbol, date, tier, fundamental_score FROM fm_p", "fundamental_score")
def _(p):
    return sc.fundamental_momentum(with_quality(p, fundamental_panel(p)), p.xs).select("symbol", "date", "tier", "fundamental_score")


def valuation_panel(p):
    """Valuation of the newest public statement at scan dates."""
    scan = at_scan(p, p.lines().select("symbol", C("week").alias("date")).distinct())
    return sc.statements_asof(scan, p.valuation(), ["pe", "pb", "dividend_yield"])


cte("val_p", "SELECT c.symbol, c.date, v.pe, v.pb, v.dividend_yield FROM cut_p c ASOF LEFT JOIN valuation_p v ON v.symbol = c.symbol AND v.date <= c.fcut")
cte("valr_p", f"""SELECT symbol, date, a * 0.4 + b * 0.3 + y * 0.3 AS valuation_score, y * 0.5 + a * 0.3 + b * 0.2 AS dividend_score FROM (
  SELECT symbol, date, coalesce({pr_sql('pe', 'date', False)}, 0.5) AS a, coalesce({pr_sql('pb', 'date', False)}, 0.5) AS b, {pr_sql('dy', 'date')} AS y FROM (SELECT *, coalesce(dividend_yield, 0) AS dy FROM val_p))""")


@plan("i20_valuation_scores", "SELECT symbol, date, valuation_score FROM valr_p", "valuation_score")
def _(p):
    return sc.valuation_ranks(valuation_panel(p), p.xs).select("symbol", "date", "valuation_score")


@plan("i21_dividend_scores", "SELECT symbol, date, dividend_score FROM valr_p", "dividend_score")
def _(p):
    return sc.valuation_ranks(valuation_panel(p), p.xs).select("symbol", "date", "dividend_score")
