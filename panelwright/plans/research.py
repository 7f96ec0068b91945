"""C16-C18 and J: evaluation of records and factor research."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import trading as tr
from ..functions.exprs import corr, lookup
from ..operators import indicators as ind
from ..operators import ranking as rk
from ..operators import research as rs
from ..operators import scoring as sc
from . import records as rec
from .ctes import cte, pr_sql
from .regime import regimes
from .registry import plan
from .scoring import T5, at_scan, price_panel

C = F.col
HZ = (5, 10, 20)
FACT = ["technical_score", "chip_score", "fundamental_score", "valuation_score", "dividend_score"]
# Key factor and holding period of each mode.
KEY_FACTOR = {"momentum": "chip_score", "swing": "fundamental_score", "value": "fundamental_score", "dividend": "fundamental_score", "growth": "fundamental_score"}
HOLDING = {"momentum": 5, "swing": 10, "value": 20, "dividend": 20, "growth": 20}
SINCE = "1999-01-01"


def d_(s):
    return F.lit(s).cast("date")


def futures(p):
    f = rs.future_bars(p.bars_beside_wide().select("symbol", "date", "open", "close"), HZ, entry_open=True)
    return at_scan(p, f).drop("open", "close")


def evaluated(p):
    """Dimension scores at scan dates with forward returns."""
    d = rec.dimension_scores(p).join(futures(p), ["symbol", "date"])
    return d.withColumns({f"fwd_{h}": C(f"exit_{h}") / C("close") - 1 for h in HZ})


def evaluated_picks(p):
    d = rec.picks(p).join(futures(p), ["symbol", "date"])
    return d.withColumns({f"fwd_{h}": C(f"exit_{h}") / C("close") - 1 for h in HZ})


LD = ", ".join(f"lead(close, {h}) OVER w AS exit_{h}, lead(date, {h}) OVER w AS exit_date_{h}" for h in HZ)
cte("fut_p", f"SELECT symbol, date, lead(open) OVER w AS next_open, {LD} FROM bars_p WINDOW w AS (PARTITION BY symbol ORDER BY date)")
FW = ", ".join(f"exit_{h} / close - 1 AS fwd_{h}" for h in HZ)
EX = ", ".join(f"exit_{h}, exit_date_{h}" for h in HZ)
cte("eval_p", f"SELECT d.*, next_open, {EX}, {FW} FROM dims_p d JOIN fut_p f ON f.symbol = d.symbol AND f.date = d.date")
cte("evalk_p", f"SELECT k.*, next_open, {EX}, {FW} FROM picks_p k JOIN fut_p f ON f.symbol = k.symbol AND f.date = k.date")


@plan("c16_forward_returns", """SELECT t.trade_id, t.symbol, t.entry_date, t.fwd_5, t.fwd_10 FROM (SELECT trade_id, t.symbol, t.entry_date, exit_5 / entry_price - 1 AS fwd_5, exit_10 / entry_price - 1 AS fwd_10 FROM trades_p t ASOF LEFT JOIN fut_p f ON f.symbol = t.symbol AND f.date <= t.entry_date) t""", "fwd_5 fwd_10")
def _(p):
    t = p.trades().select("trade_id", "symbol", "entry_date", "entry_price")
    return rs.forward_returns(t, p.closes(), (5, 10), date="entry_date", entry="entry_price").select("trade_id", "symbol", "entry_date", "fwd_5", "fwd_10")


@plan("c17_attach_forward_returns", "SELECT symbol, date, mode, fwd_10 FROM evalk_p", "fwd_10")
def _(p):
    return evaluated_picks(p).select("symbol", "date", "mode", "fwd_10")


@plan("c18_calc_returns", "SELECT symbol, date, mode, " + ", ".join(f"exit_{h} * (1 - 0.001425 - 0.003 - 0.0005) / (coalesce(next_open, close) * (1 + 0.001425 + 0.0005)) - 1 AS net_{h}" for h in HZ) + " FROM evalk_p", "net_5 net_10 net_20")
def _(p):
    return rs.cost_returns(evaluated_picks(p), HZ).select("symbol", "date", "mode", "net_5", "net_10", "net_20")


# -- IC ---------------------------------------------------------------------------------


def dic(ret):
    """Per-date IC twin."""
    return f"""SELECT date, factor, corr(a, b) AS ic, count(*) AS n FROM (SELECT date, factor, {pr_sql('value', 'date, factor')} AS a, {pr_sql('f', 'date, factor')} AS b FROM (
      SELECT date, factor, value, {ret} AS f FROM (UNPIVOT (SELECT symbol, date, fwd_5, fwd_10, fwd_20, {', '.join(FACT)} FROM eval_p) ON {', '.join(FACT)} INTO NAME factor VALUE value) WHERE {ret} IS NOT NULL AND value IS NOT NULL))
      GROUP BY 1, 2 HAVING count(*) >= 3 AND stddev_pop(a) > 1e-9 AND stddev_pop(b) > 1e-9"""


for _h in HZ:
    cte(f"dic{_h}_p", dic(f"fwd_{_h}"))
cte("ic10_p", f"SELECT factor, avg(ic) AS ic, sum(n)::BIGINT AS evaluable_count, CASE WHEN avg(ic) > 0.05 THEN 'effective' WHEN avg(ic) < -0.05 THEN 'inverse' ELSE 'weak' END AS direction FROM dic10_p WHERE date >= DATE '{SINCE}' GROUP BY 1")


def ic_table(p, ev=None):
    return rs.factor_ic(evaluated(p) if ev is None else ev, p.xs, FACT, "fwd_10", d_(SINCE))


@plan("j01_factor_ic", "SELECT * FROM ic10_p", "ic")
def _(p):
    return ic_table(p)


cte("roll10_p", """SELECT * FROM (SELECT factor, date AS window_end, avg(ic) OVER w AS ic, count(*) OVER w AS k, sum(n) OVER w AS sample_count FROM dic10_p WINDOW w AS (PARTITION BY factor ORDER BY date RANGE INTERVAL 365 DAY PRECEDING)) WHERE k >= 3""")


def rolling(p, h=10):
    return rs.rolling_ic(rs.date_ic(evaluated(p), p.xs, FACT, f"fwd_{h}"), 365)


@plan("j02_rolling_ic", "SELECT factor, window_end, ic, sample_count::BIGINT AS sample_count FROM roll10_p", "ic")
def _(p):
    return rolling(p)


@plan("j03_regime_ic", "SELECT regime, factor, avg(ic) AS ic, count(*) AS n_dates, sum(d.n)::BIGINT AS samples FROM dic10_p d JOIN regime_p r ON r.date = d.date GROUP BY 1, 2", "ic")
def _(p):
    d = rs.date_ic(evaluated(p), p.xs, FACT, "fwd_10").join(regimes(p).select("date", "regime"), "date")
    return d.groupBy("regime", "factor").agg(F.avg("ic").alias("ic"), F.count(F.lit(1)).alias("n_dates"), F.sum("n").alias("samples"))


def sub_factors(p):
    return sc.technical_momentum(at_scan(p, price_panel(p)), p.xs)


cte("sub_p", "SELECT t.symbol, t.date, r5_ AS tech_ret5d, r10_ AS tech_ret10d, rb_ AS tech_high20_proximity, rv_ AS tech_vol_ratio, ra_ AS tech_vol_accel, exit_10 / close - 1 AS fwd_10 FROM tech5_p t JOIN fut_p f ON f.symbol = t.symbol AND f.date = t.date JOIN bars_p b ON b.symbol = t.symbol AND b.date = t.date")
cte("subic_p", f"""SELECT factor, corr(a, b) AS ic, count(*) AS n FROM (SELECT factor, {pr_sql('value', 'factor')} AS a, {pr_sql('fwd_10', 'factor')} AS b FROM (
   SELECT * FROM (UNPIVOT (SELECT fwd_10, {', '.join(T5)} FROM sub_p) ON {', '.join(T5)} INTO NAME factor VALUE value) WHERE fwd_10 IS NOT NULL)) GROUP BY 1""")


def sub_eval(p):
    return sub_factors(p).join(futures(p), ["symbol", "date"]).withColumn("fwd_10", C("exit_10") / C("close") - 1)


def sub_ic(p):
    return rs.spearman_by(rs.long_factors(sub_eval(p), T5, ["symbol", "fwd_10"]), p.pool, ["factor"], "value", "fwd_10")


@plan("j04_sub_factor_ic", "SELECT * FROM subic_p", "ic")
def _(p):
    return sub_ic(p)


PAIRS = [(a, b) for i, a in enumerate(T5) for b in T5[i + 1 :]]


@plan("j05_factor_correlation_matrix", " UNION ALL ".join(f"SELECT '{a}' AS factor_a, '{b}' AS factor_b, corr({a}, {b}) AS rho FROM subr_p" for a, b in PAIRS), "rho")
def _(p):
    d = p.pool.pct_rank(sub_factors(p).withColumn("_g", F.lit(1)), "_g", {f"r_{t}": (t, True) for t in T5})
    g = d.agg(*[corr(f"r_{a}", f"r_{b}").alias(f"{a}|{b}") for a, b in PAIRS])
    rows = F.array(*[F.struct(F.lit(a).alias("factor_a"), F.lit(b).alias("factor_b"), C(f"`{a}|{b}`").alias("rho")) for a, b in PAIRS])
    return g.select(F.explode(rows).alias("_r")).select("_r.*")


cte("subr_p", "SELECT " + ", ".join(f"{pr_sql(t, 'g')} AS {t}" for t in T5) + " FROM (SELECT *, 1 AS g FROM sub_p)")


def base_weights(p, regime="sideways"):
    """(mode, factor, base_weight) of one regime, attached to the IC table by factor."""
    rows = [(m, f"{k}_score", w) for m, by in sc.REGIME_WEIGHTS.items() for k, w in by[regime].items()]
    arr = F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(k).alias("factor"), F.lit(float(w)).alias("base_weight")) for m, k, w in rows])
    return arr


BW = "(VALUES " + ", ".join(f"('{m}', '{k}_score', {float(w)})" for m, by in sc.REGIME_WEIGHTS.items() for k, w in by["sideways"].items()) + ") b(mode, factor, base_weight)"


def weighted_ic(p, ic):
    one = ic.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("factor", F.struct("ic", "evaluable_count", "direction")))).alias("m"))  # one entry per factor
    d = one.select("m", F.explode(base_weights(p)).alias("b")).select("b.*", F.element_at("m", C("b.factor")).alias("e"))
    return d.select("mode", "factor", "base_weight", C("e.ic").alias("ic"), C("e.evaluable_count").alias("evaluable_count"), F.coalesce(C("e.direction"), F.lit("effective")).alias("direction"))


cte("adjw_p", f"SELECT *, a * sum(base_weight) OVER (PARTITION BY mode) / nullif(sum(a) OVER (PARTITION BY mode), 0) AS adjusted_weight FROM (SELECT b.*, coalesce(direction, 'effective') AS direction, ic, evaluable_count, base_weight * CASE direction WHEN 'weak' THEN 0.5 WHEN 'inverse' THEN 0.25 ELSE 1.0 END AS a FROM {BW} LEFT JOIN ic10_p i ON i.factor = b.factor)")


@plan("j06_ic_weight_adjustments", "SELECT mode, factor, base_weight::DOUBLE AS base_weight, direction, adjusted_weight FROM adjw_p", "base_weight adjusted_weight")
def _(p):
    return rs.adjust_weights(weighted_ic(p, ic_table(p)), ["mode"]).select("mode", "factor", "base_weight", "direction", "adjusted_weight")


@plan("j08_ic_aware_score_transform", """SELECT e.symbol, e.date, action, CASE action WHEN 'flipped' THEN 1 - technical_score WHEN 'neutralized' THEN 0.5 ELSE technical_score END AS technical_score FROM eval_p e, (SELECT CASE WHEN evaluable_count < 50 THEN 'kept_low_samples' WHEN ic > 0.02 THEN 'kept' WHEN ic < -0.02 THEN 'flipped' ELSE 'neutralized' END AS action FROM ic10_p WHERE factor = 'technical_score')""", "technical_score")
def _(p):
    ev = evaluated(p)
    ic = ic_table(p, ev).where(C("factor") == "technical_score")
    act = ic.agg(F.max(rs.ic_action(C("ic"), C("evaluable_count"))).alias("a")).scalar()
    d = ev.select("symbol", "date", "technical_score", act.alias("action"))
    return d.withColumn("technical_score", rs.transformed(C("technical_score"), C("action")))


SUBW = "(VALUES ('tech_ret5d', 0.3), ('tech_ret10d', 0.2), ('tech_high20_proximity', 0.2), ('tech_vol_ratio', 0.2), ('tech_vol_accel', 0.1)) b(factor, base_weight)"


@plan("j09_sub_factor_weight_adjustments", f"SELECT factor, base_weight::DOUBLE AS base_weight, direction, a * sum(base_weight) OVER () / nullif(sum(a) OVER (), 0) AS adjusted_weight FROM (SELECT b.*, d AS direction, base_weight * CASE d WHEN 'weak' THEN 0.5 WHEN 'inverse' THEN 0.25 ELSE 1.0 END AS a FROM {SUBW} JOIN (SELECT factor, CASE WHEN n < 20 THEN 'effective' WHEN ic > 0.05 THEN 'effective' WHEN ic < -0.05 THEN 'inverse' ELSE 'weak' END AS d FROM subic_p) i ON i.factor = b.factor)", "base_weight adjusted_weight")
def _(p):
    wt = {"tech_ret5d": 0.3, "tech_ret10d": 0.2, "tech_high20_proximity": 0.2, "tech_vol_ratio": 0.2, "tech_vol_accel": 0.1}
    d = sub_ic(p).withColumns({"base_weight": lookup(C("factor"), wt), "direction": F.when(C("n") < 20, "effective").otherwise(rs.direction(C("ic"))), "_g": F.lit(1)})
    return rs.adjust_weights(d, ["_g"]).select("factor", "base_weight", "direction", "adjusted_weight")


def win_rate_adjustment(p):
    """At each scan, outcomes of the last three scans that were known by then."""
    cal = p.scan_dates().withColumn("o", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")))  # one row per date
    k = evaluated_picks(p).join(cal, "date").select("mode", "o", "fwd_5", "exit_date_5")
    k = k.select("mode", "fwd_5", "exit_date_5", F.explode(F.sequence(C("o") + 1, C("o") + 3)).alias("o")).join(cal, "o")
    k = k.where(C("exit_date_5") <= C("date"))
    g = k.groupBy("mode", "date").agg(F.avg((C("fwd_5") > 0).cast("int")).alias("win_rate"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("adjustment", F.when(C("n") < 5, 0.0).when(C("win_rate") < 0.40, 0.05).when(C("win_rate") < 0.50, 0.02).otherwise(0.0))


@plan("j10_win_rate_threshold_adjustment", """WITH cal AS (SELECT date, row_number() OVER (ORDER BY date) AS o FROM scan_p) SELECT mode, d AS date, win_rate, n, CASE WHEN n < 5 THEN 0.0 WHEN win_rate < 0.40 THEN 0.05 WHEN win_rate < 0.50 THEN 0.02 ELSE 0.0 END AS adjustment FROM (
   SELECT mode, c2.date AS d, avg((fwd_5 > 0)::INT) AS win_rate, count(*) AS n FROM evalk_p e JOIN cal c1 ON c1.date = e.date JOIN cal c2 ON c2.o - c1.o BETWEEN 1 AND 3 WHERE exit_date_5 <= c2.date GROUP BY 1, 2)""", "win_rate adjustment")
def _(p):
    return win_rate_adjustment(p)


@plan("j11_mfe_mae", """SELECT k.symbol, k.date, k.mode, mfe, mae, CASE WHEN abs(mae) > 0.001 THEN mfe / abs(mae) END AS mfe_mae_ratio, final_return FROM picks_p k JOIN (SELECT symbol, date, max(high) OVER w / close - 1 AS mfe, min(low) OVER w / close - 1 AS mae, last_value(close) OVER w / close - 1 AS final_return FROM bars_p
   WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)) x ON x.symbol = k.symbol AND x.date = k.date""", "mfe mae mfe_mae_ratio final_return")
def _(p):
    x = at_scan(p, rs.excursions(p.bars())).select("symbol", "date", "mfe", "mae", "mfe_mae_ratio", "final_return")
    return rec.picks(p).select("symbol", "date", "mode").join(x, ["symbol", "date"])


# -- outcomes -----------------------------------------------------------------------------


def long_outcomes(p):
    d = evaluated_picks(p)
    rows = F.array(*[F.struct(F.lit(h).cast("long").alias("horizon"), C(f"fwd_{h}").alias("ret")) for h in HZ])
    return d.select("symbol", "date", "mode", "regime", F.explode(rows).alias("r")).select("symbol", "date", "mode", "regime", "r.*")


cte("lout_p", " UNION ALL ".join(f"SELECT symbol, date, mode, regime, {h}::BIGINT AS horizon, fwd_{h} AS ret FROM evalk_p WHERE fwd_{h} IS NOT NULL" for h in HZ))
OS = "count(*) AS n, avg((ret > 0)::INT) AS win_rate, avg(ret) AS avg_return, median(ret) AS median_return, max(ret) AS max_return, min(ret) AS min_return"
OR = "win_rate avg_return median_return max_return min_return"


@plan("j12_summary", f"SELECT mode, horizon, {OS} FROM lout_p GROUP BY 1, 2", OR)
def _(p):
    return rs.outcome(long_outcomes(p), ["mode", "horizon"])


@plan("j13_by_scan", f"SELECT mode, date, {OS}, arg_max(symbol, (round(ret, 9), symbol)) AS best, arg_min(symbol, (round(ret, 9), symbol)) AS worst FROM lout_p WHERE horizon = 10 GROUP BY 1, 2", OR)
def _(p):
    d = long_outcomes(p).where((C("horizon") == 10) & C("ret").isNotNull())
    o = rs.outcome(d, ["mode", "date"])
    key = F.struct(F.round("ret", 9), C("symbol"))
    b = d.groupBy("mode", "date").agg(F.max_by("symbol", key).alias("best"), F.min_by("symbol", key).alias("worst"))
    return o.join(b, ["mode", "date"])


@plan("j14_by_regime", f"SELECT regime, mode, horizon, {OS} FROM lout_p GROUP BY 1, 2, 3", OR)
def _(p):
    return rs.outcome(long_outcomes(p), ["regime", "mode", "horizon"])


DEC = """SELECT *, (recent_win_rate - historical_win_rate) * 100 AS win_rate_decay, (recent_avg_return - historical_avg_return) * 100 AS return_decay, recent_win_rate < 0.4 OR recent_avg_return < 0 AS is_decaying FROM (
   SELECT mode, count(*) FILTER (r) AS recent_count, avg((fwd_10 > 0)::INT) FILTER (r) AS recent_win_rate, avg(fwd_10) FILTER (r) AS recent_avg_return, count(*) FILTER (NOT r) AS historical_count, avg((fwd_10 > 0)::INT) FILTER (NOT r) AS historical_win_rate, avg(fwd_10) FILTER (NOT r) AS historical_avg_return
   FROM (SELECT *, date >= DATE '2001-01-01' AS r FROM evalk_p WHERE fwd_10 IS NOT NULL) GROUP BY 1)"""
DR = "recent_win_rate recent_avg_return historical_win_rate historical_avg_return win_rate_decay return_decay"
cte("decaym_p", DEC)


@plan("j15_strategy_decay", "SELECT * EXCLUDE mode FROM decaym_p WHERE mode = 'swing'", DR)
def _(p):
    return rs.decay(evaluated_picks(p).where(C("mode") == "swing"), ["mode"], d_("2001-01-01"), "fwd_10").drop("mode")


@plan("j16_all_modes_decay", "SELECT * FROM decaym_p", DR)
def _(p):
    return rs.decay(evaluated_picks(p), ["mode"], d_("2001-01-01"), "fwd_10")


# -- ablation --------------------------------------------------------------------------------


def ablated(p):
    wt = lambda k: sc.weight_column(C("mode"), C("regime"), k)
    return rs.ablated_scores(rec.pool(p), sc.DIMENSIONS, wt, lambda k: sc.half(f"{k}_score"))


cte("abl_p", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT symbol, date, mode, regime, close, pool_rank, '{k}' AS removed, wk, coalesce(round((f - ws) / CASE WHEN t - wk > 1e-12 THEN t - wk END, 9), 0) AS ablated_score FROM (SELECT *, {rec.weight_sql(k)} AS wk, ({rec.weight_sql(k)}) * coalesce({k}_score, 0.5) AS ws FROM ablf_p)" for k in sc.DIMENSIONS) + ") WHERE wk > 0")
cte("ablf_p", "SELECT *, " + " + ".join(f"coalesce({k}_score, 0.5) * ({rec.weight_sql(k)})" for k in sc.DIMENSIONS) + " AS f, " + " + ".join(f"({rec.weight_sql(k)})" for k in sc.DIMENSIONS) + " AS t FROM pool_p")
cte("ablr_p", "SELECT *, row_number() OVER (PARTITION BY date, mode, removed ORDER BY ablated_score DESC, symbol) AS ablated_rank FROM abl_p")
cte("abls_p", "SELECT date, mode, removed, covar_pop(pool_rank, ablated_rank) / nullif(stddev_pop(pool_rank) * stddev_pop(ablated_rank), 0) AS rank_correlation, avg(abs(ablated_rank - pool_rank)) AS mean_rank_shift, max(abs(ablated_rank - pool_rank)) AS max_rank_shift, count(*) FILTER (pool_rank <= 20 AND ablated_rank > 20) AS n_dropped, count(*) FILTER (pool_rank > 20 AND ablated_rank <= 20) AS n_added, count(*) AS n FROM ablr_p GROUP BY 1, 2, 3")


@plan("j17_dimension_ablation", "SELECT * FROM abls_p", "rank_correlation mean_rank_shift")
def _(p):
    return rs.ablation_stats(ablated(p), p.xs, ["date", "mode"])


LOO = {t: "(" + " + ".join(x for x in T5 if x != t) + ") / 4" for t in T5}
ALL5 = "(" + " + ".join(T5) + ") / 5"


@plan("j18_sub_factor_ablation", " UNION ALL ".join(f"SELECT date, '{t}' AS removed_factor, covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) AS score_correlation, max(m) AS mean_score_change FROM (SELECT date, {pr_sql('x', 'date')} AS a, {pr_sql('y', 'date')} AS b, avg(abs(y - x)) OVER (PARTITION BY date) AS m FROM (SELECT date, round({ALL5}, 9) AS x, round({LOO[t]}, 9) AS y FROM sub_p)) GROUP BY 1" for t in T5), "score_correlation mean_score_change")
def _(p):
    d = sub_factors(p).withColumn("_all", sum((C(t) for t in T5), F.lit(0.0)))
    rows = F.array(*[F.struct(F.lit(t).alias("removed_factor"), F.round((C("_all") - C(t)) / 4, 9).alias("y")) for t in T5])
    d = d.select("symbol", "date", F.round(C("_all") / 5, 9).alias("x"), F.explode(rows).alias("r")).select("symbol", "date", "x", "r.*")
    by = ["date", "removed_factor"]
    s = rs.spearman_by(d, p.xs, by, "x", "y").select(*by, C("ic").alias("score_correlation"))
    m = d.groupBy(*by).agg(F.avg(F.abs(C("y") - C("x"))).alias("mean_score_change"))
    return s.join(m, by)


def ablation_performance(p):
    """Picks of the ablated score against the baseline picks, per removed dimension."""
    d = ablated(p).join(futures(p).select("symbol", "date", "exit_10"), ["symbol", "date"]).withColumn("ret", C("exit_10") / C("close") - 1)
    by = ["date", "mode", "removed"]
    d = p.xs.row_rank(d, by, "ablated_score", "ablated_rank")
    top = C("ablated_rank") <= rec.TOP
    base = C("pool_rank") <= rec.TOP
    g = d.groupBy(*by).agg(
        F.sum(F.when(top, C("ret"))).alias("_s"),
        F.count(F.when(top, C("ret"))).alias("_n"),
        F.count_if(top & (C("ret") > 0)).alias("_w"),
        (F.count_if(top & base) / F.count_if(base)).alias("_o"),
    )
    return g.groupBy("mode", "removed").agg(
        (F.sum("_w") / F.sum("_n")).alias("win_rate"), (F.sum("_s") / F.sum("_n")).alias("avg_return"), F.avg("_o").alias("selection_overlap"), F.sum("_n").alias("n")
    )


@plan("j19_ablation_performance", """SELECT mode, removed, sum(w) / sum(n) AS win_rate, sum(s) / sum(n) AS avg_return, avg(o) AS selection_overlap, sum(n)::BIGINT AS n FROM (SELECT a.date, mode, removed, sum(r) FILTER (t) AS s, count(r) FILTER (t) AS n, count(*) FILTER (t AND r > 0) AS w, count(*) FILTER (t AND b) / count(*) FILTER (b) AS o FROM (
   SELECT a.*, exit_10 / close - 1 AS r, ablated_rank <= 20 AS t, pool_rank <= 20 AS b FROM ablr_p a JOIN fut_p f ON f.symbol = a.symbol AND f.date = a.date) a GROUP BY 1, 2, 3) GROUP BY 1, 2""", "win_rate avg_return selection_overlap")
def _(p):
    return ablation_performance(p)


@plan("j20_redistribute_weights", "SELECT DISTINCT date, mode, removed, wk / 1.0 AS removed_weight, 1 / (1 - wk) AS scale FROM abl_p WHERE pool_rank = 1", "removed_weight scale")
def _(p):
    d = regimes(p).select("date", "regime", F.explode(F.array(*[F.lit(m) for m in sc.MODES])).alias("mode")).join(p.scan_dates(), "date", "left_semi")
    rows = F.array(*[F.struct(F.lit(k).alias("removed"), sc.weight_column(C("mode"), C("regime"), k).alias("removed_weight")) for k in sc.DIMENSIONS])
    d = d.select("date", "mode", F.explode(F.filter(rows, lambda r: r["removed_weight"] > 0)).alias("r")).select("date", "mode", "r.*")
    return d.withColumn("scale", 1 / (1 - C("removed_weight")))


MP = [(a, b) for i, a in enumerate(sc.MODES) for b in sc.MODES[i + 1 :]]


@plan("j21_cross_mode_correlation", "SELECT mode_a, mode_b, avg(rho) AS rho, count(rho) AS n_dates FROM (SELECT x.mode AS mode_a, y.mode AS mode_b, x.date, covar_pop(x.r, y.r) / nullif(stddev_pop(x.r) * stddev_pop(y.r), 0) AS rho FROM mr_p x JOIN mr_p y ON y.date = x.date AND y.symbol = x.symbol AND ((x.mode, y.mode) IN (" + ", ".join(f"('{a}', '{b}')" for a, b in MP) + ")) GROUP BY 1, 2, 3 HAVING count(*) >= 5) GROUP BY 1, 2", "rho")
def _(p):
    d = p.xs.pct_rank(rec.composites(p), ["date", "mode"], {"r": ("composite_score", True)})
    w = d.groupBy("date", "symbol").agg(*[F.max(F.when(C("mode") == m, C("r"))).alias(m) for m in sc.MODES])
    g = w.groupBy("date").agg(*[F.when(F.count(F.lit(1)) >= 5, corr(a, b)).alias(f"{a}|{b}") for a, b in MP])
    rows = F.array(*[F.struct(F.lit(a).alias("mode_a"), F.lit(b).alias("mode_b"), C(f"`{a}|{b}`").alias("rho")) for a, b in MP])
    return g.select(F.explode(rows).alias("x")).select("x.*").groupBy("mode_a", "mode_b").agg(F.avg("rho").alias("rho"), F.count("rho").alias("n_dates"))


cte("mr_p", f"SELECT date, mode, symbol, {pr_sql('composite_score', 'date, mode')} AS r FROM comp_p")


# -- governance -----------------------------------------------------------------------------

AS_OF = "2001-11-30"


def mode_rolling(p):
    """Rolling IC of each mode's key factor over its holding period."""
    ev = evaluated(p)
    out = None
    for h in HZ:
        ms = [m for m in sc.MODES if HOLDING[m] == h]
        facts = sorted({KEY_FACTOR[m] for m in ms})
        r = rs.rolling_ic(rs.date_ic(ev, p.xs, facts, f"fwd_{h}"), 365)
        r = r.withColumn("mode", F.explode(F.filter(F.array(*[F.when(C("factor") == KEY_FACTOR[m], F.lit(m)) for m in ms]), lambda x: x.isNotNull())))
        out = r if out is None else out.unionByName(r)
    return out


def verdicts(p):
    budget = lookup(C("mode"), {m: h * 7 + 14 for m, h in HOLDING.items()})
    d = mode_rolling(p)
    return rs.enforceable_ic(d, d_(AS_OF), budget)


for _h in (5, 20):
    cte(f"roll{_h}_p", f"SELECT * FROM (SELECT factor, date AS window_end, avg(ic) OVER w AS ic, count(*) OVER w AS k, sum(n) OVER w AS sample_count FROM dic{_h}_p WINDOW w AS (PARTITION BY factor ORDER BY date RANGE INTERVAL 365 DAY PRECEDING)) WHERE k >= 3")
cte("mroll_p", " UNION ALL ".join(f"SELECT '{m}' AS mode, {HOLDING[m] * 7 + 14} AS budget, * FROM roll{HOLDING[m]}_p WHERE factor = '{KEY_FACTOR[m]}'" for m in sc.MODES))
cte("verd_p", f"""SELECT *, reason = 'ok' AS enforceable FROM (SELECT mode, factor, avg(ic) AS ic, max(window_end) AS window_end, max(cnt) AS window_count, min(sample_count)::BIGINT AS min_sample_count, datediff('day', max(window_end), DATE '{AS_OF}') AS staleness_days,
   CASE WHEN datediff('day', max(window_end), DATE '{AS_OF}') > max(budget) THEN 'stale_window' WHEN max(cnt) < 3 THEN 'insufficient_windows' WHEN min(sample_count) < 100 THEN 'insufficient_samples' ELSE 'ok' END AS reason
   FROM (SELECT *, row_number() OVER (PARTITION BY mode, factor ORDER BY window_end DESC) AS rn, count(*) OVER (PARTITION BY mode, factor) AS cnt FROM mroll_p) WHERE rn <= 3 GROUP BY 1, 2)""")


@plan("j22_select_enforceable_ic", "SELECT * FROM verd_p", "ic")
def _(p):
    return verdicts(p)


@plan("j23_blocked_modes", "SELECT mode FROM verd_p WHERE ic < 0.03")
def _(p):
    return rs.blocked(verdicts(p), 0.03, need_enforceable=False).select("mode")


@plan("j34_mode_ic_verdict", "SELECT mode, factor, window_end, ic, sample_count::BIGINT AS sample_count FROM mroll_p", "ic")
def _(p):
    return mode_rolling(p).select("mode", "factor", "window_end", "ic", "sample_count")


@plan("j35_ic_decay_adjustment", "SELECT mode, CASE WHEN enforceable AND ic < 0.05 THEN 0.05 ELSE 0.0 END AS adjustment FROM verd_p", "adjustment")
def _(p):
    return verdicts(p).select("mode", F.when(C("enforceable") & (C("ic") < 0.05), 0.05).otherwise(0.0).alias("adjustment"))


@plan("j42_factor_ic_status", "SELECT mode, factor, ic, reason, CASE WHEN reason <> 'ok' THEN reason WHEN ic < -0.05 THEN 'inverse' WHEN ic < 0.05 THEN 'weak' WHEN ic < 0.1 THEN 'decay' ELSE 'normal' END AS level FROM verd_p", "ic")
def _(p):
    return verdicts(p).select("mode", "factor", "ic", "reason", tr.ic_level("reason", "ic").alias("level"))


@plan("h38_ic_level", "SELECT factor, window_end, CASE WHEN ic < -0.05 THEN 'inverse' WHEN ic < 0.05 THEN 'weak' WHEN ic < 0.1 THEN 'decay' ELSE 'normal' END AS level FROM roll10_p")
def _(p):
    return rolling(p).select("factor", "window_end", tr.ic_level(F.lit("ok"), "ic").alias("level"))


@plan("h37_dimension_impact", "SELECT date, mode, removed, CASE WHEN rank_correlation < 0.5 THEN '極高' WHEN rank_correlation < 0.85 THEN '高' WHEN rank_correlation < 0.95 THEN '中' ELSE '低' END AS impact FROM abls_p WHERE rank_correlation IS NOT NULL")
def _(p):
    d = rs.ablation_stats(ablated(p), p.xs, ["date", "mode"]).where(C("rank_correlation").isNotNull())
    return d.select("date", "mode", "removed", tr.impact_level(F.round("rank_correlation", 9)).alias("impact"))


@plan("h36_regime_weights", "SELECT date, mode, " + ", ".join(f"({rec.weight_sql(k)})::DOUBLE AS {k}" for k in sc.DIMENSIONS) + " FROM regime_p, (SELECT unnest(['momentum', 'swing', 'value', 'dividend', 'growth']) AS mode)", " ".join(sc.DIMENSIONS))
def _(p):
    d = regimes(p).select("date", "regime", F.explode(F.array(*[F.lit(m) for m in sc.MODES])).alias("mode"))
    return d.select("date", "mode", *[sc.weight_column(C("mode"), C("regime"), k).alias(k) for k in sc.DIMENSIONS])


GRID = "(SELECT DISTINCT regime FROM regime_p) r, (SELECT unnest(['momentum', 'swing', 'value', 'dividend', 'growth']) AS mode) m"


@plan("j24_validate_regime_blocks", f"""SELECT r.regime, m.mode, coalesce(n, 0) AS n, avg_return, win_rate, CASE WHEN coalesce(n, 0) < 30 THEN 'insufficient_data' WHEN blk AND avg_return > 0.02 AND win_rate > 0.55 THEN 'lift_block' WHEN NOT blk AND avg_return < -0.03 AND win_rate < 0.35 THEN 'add_block' ELSE 'keep' END AS recommendation FROM (
   SELECT regime, mode, (regime = 'sideways' AND mode IN ('momentum', 'growth')) OR (regime = 'crisis' AND mode = 'growth') AS blk FROM {GRID}) r JOIN (SELECT unnest(['momentum', 'swing', 'value', 'dividend', 'growth']) AS mode) m ON m.mode = r.mode
   LEFT JOIN (SELECT regime, mode, count(*) AS n, avg(fwd_10) AS avg_return, avg((fwd_10 > 0)::INT) AS win_rate FROM evalk_p WHERE fwd_10 IS NOT NULL GROUP BY 1, 2) s ON s.regime = r.regime AND s.mode = r.mode""", "avg_return win_rate")
def _(p):
    s = evaluated_picks(p).where(C("fwd_10").isNotNull()).groupBy("regime", "mode").agg(F.count(F.lit(1)).alias("n"), F.avg("fwd_10").alias("avg_return"), F.avg((C("fwd_10") > 0).cast("int")).alias("win_rate"))
    g = regimes(p).select("regime").distinct().withColumn("mode", F.explode(F.array(*[F.lit(m) for m in sc.MODES])))
    d = g.join(s, ["regime", "mode"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return d.withColumn("recommendation", tr.judge_block(~sc.mode_allowed(C("mode"), C("regime")), "n", "avg_return", "win_rate"))


@plan("j25_data_coverage", """SELECT date, table_name, n, n >= 60 AS ok FROM (SELECT date, 'price' AS table_name, count(DISTINCT symbol) AS n FROM bars_p GROUP BY 1 UNION ALL SELECT date, 'flow', count(DISTINCT symbol) FROM flows_p GROUP BY 1
   UNION ALL SELECT date, 'feature', count(DISTINCT symbol) FROM features_p WHERE ma20 IS NOT NULL GROUP BY 1)""")
def _(p):
    return coverage(p)


def coverage(p):
    f = ind.feature_columns(p.wide())
    n = lambda d, k: d.groupBy("date").agg(F.countDistinct("symbol").alias("n")).withColumn("table_name", F.lit(k))
    d = n(f, "price").unionByName(n(p.flows(), "flow")).unionByName(n(f.where(C("ma20").isNotNull()), "feature"))
    return d.withColumn("ok", C("n") >= 60)


@plan("j26_sample_replay_dates", "SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT date FROM bars_p GROUP BY 1 HAVING count(DISTINCT symbol) >= 75)) WHERE (k - 1) % 10 = 0")
def _(p):
    ok = p.closes().groupBy("date").agg(F.countDistinct("symbol").alias("n")).where(C("n") >= 75)
    w = Window.partitionBy(F.lit(0)).orderBy("date")  # one row per date
    return ok.withColumn("k", F.row_number().over(w)).where((C("k") - 1) % 10 == 0).select("date")


@plan("j27_summarize_replays", f"SELECT horizon, {OS} FROM lout_p WHERE month(date) IN (3, 6, 9, 12) GROUP BY 1", OR)
def _(p):
    return rs.outcome(long_outcomes(p).where(F.month("date").isin(3, 6, 9, 12)), ["horizon"])


@plan("j28_factor_attribution", """SELECT exit_reason, corr(m, ret) AS momentum, corr(rv, ret) AS reversal, corr(q, ret) AS quality, corr(s, ret) AS size, corr(l, ret) AS liquidity, count(*) AS n FROM (SELECT exit_reason, exit_price / entry_price - 1 AS ret, m, rv, q, s, l FROM trades_p t
   ASOF JOIN (SELECT p.symbol, p.date, close / lag(close, 20) OVER w - 1 AS m, -r5 AS rv, rsi AS q, ln(v20 + 1) AS s, volume / v20 AS l FROM px_p p WINDOW w AS (PARTITION BY symbol ORDER BY date)) x ON x.symbol = t.symbol AND x.date <= t.entry_date) GROUP BY 1""", "momentum reversal quality size liquidity")
def _(p):
    d = price_panel(p, True)
    x = d.select("symbol", "date", (C("close") / F.lag("close", 20).over(rs.W()) - 1).alias("m"), (-C("r5")).alias("rv"), C("rsi").alias("q"), F.log(C("v20") + 1).alias("s"), (C("volume") / C("v20")).alias("l"))
    t = p.trades().withColumn("ret", C("exit_price") / C("entry_price") - 1).select("trade_id", "symbol", "entry_date", "exit_reason", "ret")
    j = rs.asof(t, x, on="symbol", probe_date="entry_date", fact_date="date", values=["m", "rv", "q", "s", "l"], matched="bar").where(C("bar").isNotNull())
    return j.groupBy("exit_reason").agg(*[corr(a, "ret").alias(b) for a, b in (("m", "momentum"), ("rv", "reversal"), ("q", "quality"), ("s", "size"), ("l", "liquidity"))], F.count(F.lit(1)).alias("n"))


@plan("j29_trade_stats", "SELECT portfolio, count(*) AS n, avg((r > 0)::INT) * 100 AS win_rate, avg(r) AS avg_return, sum((exit_price - entry_price) * shares) AS pnl, avg((exit_reason = 'stop_loss')::INT) * 100 AS stop_loss_pct FROM (SELECT *, exit_price / entry_price - 1 AS r FROM trades_p) GROUP BY 1", "win_rate avg_return pnl:2 stop_loss_pct")
def _(p):
    d = p.trades().withColumn("r", C("exit_price") / C("entry_price") - 1)
    return d.groupBy("portfolio").agg(F.count(F.lit(1)).alias("n"), (F.avg((C("r") > 0).cast("int")) * 100).alias("win_rate"), F.avg("r").alias("avg_return"), F.sum((C("exit_price") - C("entry_price")) * C("shares")).alias("pnl"), (F.avg((C("exit_reason") == "stop_loss").cast("int")) * 100).alias("stop_loss_pct"))


@plan("j31_concept_correlation_candidates", """SELECT concept, symbol, avg(rho) AS mean_rho
FROM (
  SELECT s.concept, b.symbol, s.symbol AS seed, corr(a.r1, b.r1) AS rho, count(*) AS n
  FROM seeds_p s
  JOIN candidates_p c ON c.concept = s.concept AND c.symbol <> s.symbol
  JOIN bars_r a ON a.symbol = s.symbol AND a.r1 IS NOT NULL
  JOIN bars_r b ON b.symbol = c.symbol AND b.date = a.date AND b.r1 IS NOT NULL
  GROUP BY 1, 2, 3 HAVING count(*) > 10)
GROUP BY 1, 2 HAVING avg(rho) >= 0.05""", "mean_rho")
def _(p):
    """Seeds: a concept's first and last member; candidates: the names of the seeds' industries."""
    seeds = p.concepts().groupBy("concept").agg(F.min("symbol").alias("a"), F.max("symbol").alias("b"))
    seeds = seeds.select(C("concept").alias("group"), F.explode(F.array("a", "b")).alias("symbol")).distinct()
    names = p.info().select("symbol", "industry")
    right = seeds.join(names, "symbol").select("group", "industry").distinct().join(names, "industry").select("group", "symbol")
    r = p.closes().select("symbol", "date", ind.ret("close", 1).alias("r")).where(C("r").isNotNull())
    rho = rs.pair_corr(r, seeds, right)
    return rho.groupBy(C("group").alias("concept"), C("b").alias("symbol")).agg(F.avg("rho").alias("mean_rho")).where(C("mean_rho") >= 0.05)


cte("candidates_p", "SELECT DISTINCT concept, j.symbol FROM seeds_p s JOIN info_p i ON i.symbol = s.symbol JOIN info_p j ON j.industry = i.industry")
cte("seeds_p", "SELECT concept, min(symbol) AS symbol FROM concepts_p GROUP BY 1 UNION SELECT concept, max(symbol) FROM concepts_p GROUP BY 1")
cte("qst_p", "SELECT s.*, 1 + (flow_ratio > quantile_cont(flow_ratio, 0.2) OVER ())::INT + (flow_ratio > quantile_cont(flow_ratio, 0.4) OVER ())::INT + (flow_ratio > quantile_cont(flow_ratio, 0.6) OVER ())::INT + (flow_ratio > quantile_cont(flow_ratio, 0.8) OVER ())::INT AS q FROM study_p s WHERE fwd_10 IS NOT NULL")


def study(p):
    d = ind.study_features(p.bars(), p.flows()).where(C("fwd_10").isNotNull()).withColumn("_g", F.lit(1))
    return rs.buckets(d, p.pool, ["_g"], "flow_ratio", 5, "quintile")


@plan("j32_quintile_study", "SELECT q::BIGINT AS quintile, count(*) AS n, avg(fwd_5) AS fwd_5, avg(fwd_10) AS fwd_10, avg(fwd_20) AS fwd_20, avg(fwd_10) / stddev_samp(fwd_10) * sqrt(count(fwd_10)) AS t_10 FROM qst_p GROUP BY 1", "fwd_5 fwd_10 fwd_20 t_10")
def _(p):
    return study(p).groupBy("quintile").agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"fwd_{h}").alias(f"fwd_{h}") for h in HZ], rs.t_stat("fwd_10").alias("t_10"))


@plan("j33_signal_t_stat", "SELECT flow_ratio < 0 AND ret5 > 0 AS divergence, count(*) AS n, avg(fwd_10) AS mean, avg(fwd_10) / stddev_samp(fwd_10) * sqrt(count(fwd_10)) AS t FROM qst_p WHERE ret5 IS NOT NULL GROUP BY 1", "mean t")
def _(p):
    d = study(p).where(C("ret5").isNotNull())
    return d.groupBy(((C("flow_ratio") < 0) & (C("ret5") > 0)).alias("divergence")).agg(F.count(F.lit(1)).alias("n"), F.avg("fwd_10").alias("mean"), rs.t_stat("fwd_10").alias("t"))


@plan("j37_dimension_impact_by_mode", "SELECT date, mode, removed, rank_correlation FROM abls_p WHERE n >= 10", "rank_correlation")
def _(p):
    return rs.ablation_stats(ablated(p), p.xs, ["date", "mode"]).where(C("n") >= 10).select("date", "mode", "removed", "rank_correlation")


@plan("j07_ic_impact_weight_adjustments", """SELECT mode, factor, base_weight::DOUBLE AS base_weight, a * sum(base_weight) OVER (PARTITION BY mode) / nullif(sum(a) OVER (PARTITION BY mode), 0) AS adjusted_weight FROM (SELECT w.mode, w.factor, w.base_weight, w.a * CASE WHEN count(i.rho) OVER (PARTITION BY w.mode) >= 3 AND i.rho IS NOT NULL THEN least(greatest(1 + 0.2 * ((1 - i.rho) - avg(1 - i.rho) OVER (PARTITION BY w.mode)), 0.6), 1.4) ELSE 1 END AS a
   FROM adjw_p w LEFT JOIN (SELECT mode, removed || '_score' AS factor, avg(rank_correlation) AS rho FROM abls_p GROUP BY 1, 2) i ON i.mode = w.mode AND i.factor = w.factor)""", "base_weight adjusted_weight")
def _(p):
    return impact_weights(p)


def impact_weights(p):
    """IC direction and ablation impact combined, per mode."""
    imp = rs.ablation_stats(ablated(p), p.xs, ["date", "mode"]).groupBy("mode", F.concat("removed", F.lit("_score")).alias("factor")).agg(F.avg("rank_correlation").alias("rho"))
    d = weighted_ic(p, ic_table(p)).join(imp, ["mode", "factor"], "left")
    w = Window.partitionBy("mode")  # a handful of factors per mode
    d = d.withColumns({"_k": F.count("rho").over(w), "_m": F.avg(1 - C("rho")).over(w)})
    mult = F.when((C("_k") >= 3) & C("rho").isNotNull(), F.least(F.greatest(1 + 0.2 * ((1 - C("rho")) - C("_m")), F.lit(0.6)), F.lit(1.4))).otherwise(1.0)
    return rs.adjust_weights(d, ["mode"], extra=mult).select("mode", "factor", "base_weight", "adjusted_weight")


@plan("j36_ic_weight_adjustment", """SELECT date, mode, factor, a * sum(base_weight) OVER w / nullif(sum(a) OVER w, 0) AS adjusted_weight FROM (SELECT x.date, w.mode, w.factor, w.base_weight, w.a * CASE WHEN count(i.rank_correlation) OVER (PARTITION BY x.date, w.mode) >= 3 AND i.rank_correlation IS NOT NULL
     THEN least(greatest(1 + 0.2 * ((1 - i.rank_correlation) - avg(1 - i.rank_correlation) OVER (PARTITION BY x.date, w.mode)), 0.6), 1.4) ELSE 1 END AS a FROM (SELECT DISTINCT date, mode FROM abls_p) x JOIN adjw_p w ON w.mode = x.mode LEFT JOIN abls_p i ON i.date = x.date AND i.mode = w.mode AND i.removed || '_score' = w.factor AND i.n >= 10) WINDOW w AS (PARTITION BY date, mode)""", "adjusted_weight")
def _(p):
    """Weights of every (scan date, mode): IC direction times the ablation impact of that pool."""
    imp = rs.ablation_stats(ablated(p), p.xs, ["date", "mode"])
    cells = imp.select("date", "mode").distinct()
    rho = imp.where(C("n") >= 10).select("date", "mode", F.concat("removed", F.lit("_score")).alias("factor"), C("rank_correlation").alias("rho"))
    d = cells.join(weighted_ic(p, ic_table(p)), "mode").join(rho, ["date", "mode", "factor"], "left")
    w = Window.partitionBy("date", "mode")  # a handful of factors per cell
    d = d.withColumns({"_k": F.count("rho").over(w), "_m": F.avg(1 - C("rho")).over(w)})
    mult = F.when((C("_k") >= 3) & C("rho").isNotNull(), F.least(F.greatest(1 + 0.2 * ((1 - C("rho")) - C("_m")), F.lit(0.6)), F.lit(1.4))).otherwise(1.0)
    return rs.adjust_weights(d, ["date", "mode"], extra=mult).select("date", "mode", "factor", "adjusted_weight")


@plan("j38_chip_sub_factor_ic", "SELECT k AS factor, ic, evaluable_count, direction FROM ic10_p, (SELECT unnest(['consec', 'bvr', 'persist', 'smr', 'sbl', 'broker']) AS k) WHERE factor = 'chip_score'", "ic")
def _(p):
    d = ic_table(p).where(C("factor") == "chip_score")
    return d.withColumn("factor", F.explode(F.array(*[F.lit(k) for k in ("consec", "bvr", "persist", "smr", "sbl", "broker")])))


@plan("j39_recompute_composite", "SELECT symbol, date, mode, composite_score FROM comp_p", "composite_score")
def _(p):
    return rec.composites(p).select("symbol", "date", "mode", "composite_score")


@plan("j40_candidate_factor_records", "SELECT symbol, date, technical_score, chip_score, fundamental_score, selected FROM pool_p WHERE mode = 'swing' AND date >= DATE '2000-01-01'", "technical_score chip_score fundamental_score")
def _(p):
    d = rec.pool(p).where((C("mode") == "swing") & (C("date") >= d_("2000-01-01")))
    return d.select("symbol", "date", "technical_score", "chip_score", "fundamental_score", "selected")


@plan("j41_replay_scan", "SELECT k.symbol, k.date, k.mode, k.rank, k.composite_score, c.n >= 60 AS coverage_ok FROM picks_p k JOIN (SELECT date, count(DISTINCT symbol) AS n FROM bars_p GROUP BY 1) c ON c.date = k.date WHERE k.date = (SELECT max(date) FROM scan_p WHERE date <= DATE '2000-06-30')", "composite_score")
def _(p):
    sd = p.scan_dates()
    last = sd.where(C("date") <= d_("2000-06-30")).agg(F.max("date")).scalar()
    cov = p.closes().groupBy("date").agg(F.countDistinct("symbol").alias("names"))
    d = rec.picks(p).where(C("date") == last).join(cov, "date")
    return d.select("symbol", "date", "mode", "rank", "composite_score", (C("names") >= 60).alias("coverage_ok"))


@plan("j43_check_strategy_decay", "SELECT d.mode, recent_win_rate, recent_avg_return, is_decaying, mean_jaccard FROM decaym_p d JOIN (SELECT mode, avg(jaccard) AS mean_jaccard FROM turn_p GROUP BY 1) s ON s.mode = d.mode", "recent_win_rate recent_avg_return mean_jaccard")
def _(p):
    d = rs.decay(evaluated_picks(p), ["mode"], d_("2001-01-01"), "fwd_10")
    s = rk.stability(rk.turnover(rec.picks(p), ["mode"]), ["mode"])
    return d.join(s, "mode").select("mode", "recent_win_rate", "recent_avg_return", "is_decaying", "mean_jaccard")


@plan("d36_stock_frequency", "SELECT mode, symbol, count(*) AS n, avg(rank) AS avg_rank, avg(composite_score) AS avg_score FROM picks_p GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY mode ORDER BY count(*) DESC, symbol) <= 20", "avg_rank avg_score")
def _(p):
    g = rec.picks(p).groupBy("mode", "symbol").agg(F.count(F.lit(1)).alias("n"), F.avg("rank").alias("avg_rank"), F.avg("composite_score").alias("avg_score"))
    return p.xs.top(g, "mode", [F.desc("n"), C("symbol")], 20).drop("rank")


@plan("d37_calendar_counts", "SELECT mode, date, count(*) AS n FROM picks_p GROUP BY 1, 2")
def _(p):
    return rec.picks(p).groupBy("mode", "date").agg(F.count(F.lit(1)).alias("n"))


@plan("d43_calendar_returns", "SELECT mode, date, avg(fwd_10) AS avg_return, count(fwd_10) AS n FROM evalk_p GROUP BY 1, 2", "avg_return")
def _(p):
    return evaluated_picks(p).groupBy("mode", "date").agg(F.avg("fwd_10").alias("avg_return"), F.count("fwd_10").alias("n"))
