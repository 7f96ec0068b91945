"""The whole scan of every mode at every scan date, from the universe to the final list.

The only thing that a scan reads from an earlier one is the bonus for names picked by the mode's previous scan. So
everything else is computed once and stored; the picks are then a fixed point: dates whose previous picks have changed
are evaluated anew until none has. A date's picks are final one round after those before it, so it takes as many rounds
as there are scan dates at most, and few rows a round.
"""

from dataclasses import dataclass, fields

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.crosssection import cut
from ..operators import indicators as ind
from ..operators import ranking as rk
from ..operators import scoring as sc
from ..operators import screen as sn
from . import pointintime as pt
from . import records as rec
from .ctes import cte, pr_sql
from .records import KEY
from .registry import plan
from .screening import universe
from .scoring import at_scan

C = F.col
TOP = 20
OVERLAP = 0.03


@dataclass(frozen=True)
class Stages:
    """Which stages of the scan a mode runs."""

    universe: bool = True
    coarse: bool = True
    overlap_bonus: bool = True
    sector_bonus: bool = True
    sector_relative_strength: bool = True
    concept_bonus: bool = True
    peer_fundamental_ranking: bool = True
    weekly_trend_bonus: bool = True
    momentum_decay: bool = True
    institutional_acceleration: bool = True
    chip_macd: bool = True
    key_player_cost: bool = True
    negative_news_gate: bool = True
    volume_price_divergence: bool = True
    risk_filter: bool = True
    crisis_filter: bool = True
    multi_timeframe_alignment: bool = True
    score_threshold: bool = True
    sector_diversification: bool = True
    drawdown_adjusted_top_n: bool = True


# Stages that the value, dividend and growth modes leave out.
_PLAIN = Stages(
    overlap_bonus=False,
    peer_fundamental_ranking=False,
    momentum_decay=False,
    institutional_acceleration=False,
    chip_macd=False,
    key_player_cost=False,
    negative_news_gate=False,
    volume_price_divergence=False,
    multi_timeframe_alignment=False,
    score_threshold=False,
    sector_diversification=False,
)
STAGES = {"momentum": Stages(), "swing": Stages(), "value": _PLAIN, "dividend": _PLAIN, "growth": _PLAIN}
DEFENSIVE = ("value", "dividend")
FAST = ("momentum", "growth")
#: Column, quantile and overheating rule of each mode's risk stage; caps fit the given tables.
RISK = {"momentum": ("atr", 0.80, True), "swing": ("vol60", 0.85, True), "value": ("vol20", 0.90, False), "dividend": ("vol20", 0.75, False), "growth": ("atr", 0.80, False)}
CAPS = {"atr": 10.0, "vol20": 20.0, "vol60": 300.0}
HEAT = {"ex5": 3.0, "ex10": 5.0, "da5": 1.0, "da10": 2.0}
#: Coarse ranks by mode and their weights.
COARSE = {
    "momentum": {"volume": 0.3, "inst_net": 0.4, "momentum": 0.3},
    "swing": {"trend": 0.3, "cum20": 0.4, "volume": 0.3},
    **{m: {{"vol_rank": "volume", "inst_rank": "inst_net", "mom_rank": "momentum", "dy_rank": "dividend_yield", "yoy_rank": "yoy_growth"}[k]: w for k, w in rk.COARSE_BY_MODE[m].items()} for m in ("value", "dividend", "growth")},
}


def runs(stages, name):
    """Whether a row's mode runs a stage."""
    return C("mode").isin([m for m, s in stages.items() if getattr(s, name)])


def soft_inputs(p):
    """All per-name bonuses at scan dates, from one pass over the wide panel plus the weekly trend."""
    return p.shared("soft_inputs", lambda: build_soft_inputs(p))


def build_soft_inputs(p):
    n = pt.market(p).count()  # a symbol has a row a market week at most, and two Friday weeks in each
    d = p.wide()
    d = ind.volume_price_divergence(d)
    d = ind.momentum_decay(d, rows=n)
    d = ind.flow_acceleration(d)
    d = ind.contraction(d, max_range=0.5)
    d = ind.breakout_bonus(d)
    d = ind.flow_macd(d, rows=n)
    cols = ["vp_divergence", "momentum_decay", "inst_accel_bonus", "vcp_bonus", "breakout_bonus", "chip_macd_score"]
    d = at_scan(p, d).select("symbol", "date", *cols)
    w = ind.weekly(p.bars_daily_of("week_end", ind.friday_week(C("day"))), week_end="week_end", deal=lambda x: p.dealt(x, "symbol"), rows=2 * n)
    w = ind.weekly_trend_bonus(w).select("symbol", F.date_sub("date", 4).alias("date"), "weekly_bonus")
    return d.join(w, ["symbol", "date"], "left").withColumn("weekly_bonus", F.coalesce("weekly_bonus", F.lit(0.0)))


def market_inputs(p):
    """Coarse inputs, excess return and volatility at scan dates."""
    return p.shared("scan_inputs", lambda: build_market_inputs(p))


def build_market_inputs(p):
    d = at_scan(p, rk.coarse_inputs(sc.flow_inputs(sc.price_inputs(p.wide())))).select("symbol", "date", "v20", "inst_net", "momentum", "cum20")
    x = at_scan(p, sn.relative_strength(p.closes(), p.index()).select("symbol", "date", "excess_20"))
    v = at_scan(p, sn.window_volatility(p.closes(), 60, True).select("symbol", "date", C("vol").alias("vol60")))
    return d.join(x, ["symbol", "date"]).join(v, ["symbol", "date"])


def candidates(p, stages):
    """Names of the universe that pass their mode's coarse filter, every mode on its own rows, with all inputs."""
    key = ["symbol", "date"]
    d = rec.dimension_scores(p).join(p.info().select("symbol", "industry"), "symbol")
    d = sn.pe_thresholds(d, p.xs, "date")
    d = d.join(pt.bonuses(p), key).join(soft_inputs(p), key).join(market_inputs(p), key)
    d = d.join(universe(p).select(*key, (C("s3") | C("from_memory")).alias("in_universe")), key, "left")
    d = d.withColumns({"trend": C("close") / C("sma60"), "atr": C("atr14") / C("close"), "vol20": F.when(C("n") >= 10, C("hv20"))})
    d = d.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in sc.MODES])))
    s = sc.composite({k: C(f"{k}_score") for k in rec.SCORES}, C("mode"), C("regime"))
    d = d.withColumn("composite_score", F.round(s, 9)).where(sc.mode_allowed(C("mode"), C("regime")))
    d = d.where(~runs(stages, "universe") | sn.yes(C("in_universe")))
    fits = {
        "momentum": C("volume") > C("v20") * 0.5,
        "swing": (C("n") >= 60) & (C("close") > C("sma60")),
        "value": C("pe").isNotNull() & (((C("pe") > 0) & (C("pe") < C("pe_threshold"))) | sn.yes(C("dividend_yield") > 8.5)),
        "dividend": (C("dividend_yield") > 8) & (C("pe") > 0) & ~sn.yes(C("eps_pos") < 1),
        "growth": C("yoy_growth") > 10,
    }
    ok = F.lit(False)
    for m, cond in fits.items():
        ok = F.when(C("mode") == m, sn.yes(cond)).otherwise(ok)
    d = d.where(~runs(stages, "coarse") | ok)
    ranks = {f"_{c}": (c, True) for c in dict.fromkeys(c for w in COARSE.values() for c in w)}
    d = p.xs.pct_rank(d, KEY, ranks)
    score = F.lit(None).cast("double")
    for m, w in COARSE.items():
        score = F.when(C("mode") == m, F.round(sum((C(f"_{c}") * x for c, x in w.items()), F.lit(0.0)), 9)).otherwise(score)
    d = d.withColumn("coarse_score", score).drop(*ranks)
    kept = rk.coarse_top(d.where(runs(stages, "coarse")), p.xs, by=KEY).drop("coarse_rank")
    return kept.unionByName(d.where(~runs(stages, "coarse")))


def adjusted(p, stages):
    """Candidates after all soft stages but the overlap bonus, and after the hard stages before the score floor."""
    d = candidates(p, stages)
    when = lambda name, factor: F.when(runs(stages, name), factor).otherwise(1.0)
    post = C("composite_score") + F.when(C("mode") == "swing", F.greatest("vcp_bonus", "breakout_bonus")).otherwise(0.0)
    mtf = ind.timeframe_alignment(C("technical_score") > 0.55, C("weekly_bonus"))
    score = post
    for name, factor in {
        "sector_bonus": 1 + C("sector_bonus"),
        "sector_relative_strength": 1 + C("relative_strength_bonus"),
        "concept_bonus": 1 + C("concept_bonus"),
        "peer_fundamental_ranking": 1 + C("peer_rank_bonus"),
        "weekly_trend_bonus": 1 + C("weekly_bonus"),
        "momentum_decay": 1 + F.when(C("mode").isin(*FAST), C("momentum_decay")).otherwise(0.0),
        "institutional_acceleration": 1 + C("inst_accel_bonus"),
        "chip_macd": 1 + (C("chip_macd_score") - 0.5) * 0.06,
        "key_player_cost": key_player_factor(),
        "volume_price_divergence": 1 + C("vp_divergence"),
        "multi_timeframe_alignment": 1 + C("mtf_alignment"),
    }.items():
        score = score * when(name, factor)
    d = d.withColumn("mtf_alignment", mtf).withColumn("composite_score", score)
    gate = sn.news_gate(d.withColumn("_was", C("composite_score")), p.xs, KEY)
    d = gate.withColumn("composite_score", F.when(runs(stages, "negative_news_gate"), C("composite_score")).otherwise(C("_was"))).drop("_was")
    d = within_risk(p, d, stages)
    calm = C("mode").isin([m for m in RISK if RISK[m][2]]) & runs(stages, "risk_filter")
    d = sn.overheating(d.where(calm), **HEAT).unionByName(d.where(~calm))
    d = sn.crisis_filter(d.where(runs(stages, "crisis_filter"))).unionByName(d.where(~runs(stages, "crisis_filter")))
    d = d.where(~(runs(stages, "multi_timeframe_alignment") & C("mode").isin(*FAST) & (C("mtf_alignment") == -0.03)))
    dd = ind.drawdown_from_high(p.index(), key="market").select("date", "drawdown_20d")
    keep = F.when(runs(stages, "drawdown_adjusted_top_n"), rk.drawdown_top_n(C("drawdown_20d"), C("mode").isin(*DEFENSIVE), TOP)).otherwise(TOP)
    floor = F.when(runs(stages, "score_threshold"), sn.score_floor(C("regime")))
    return d.join(dd, "date", "left").select(
        "symbol", "date", "mode", "industry", "composite_score", floor.alias("floor"), keep.alias("keep"),
        runs(stages, "sector_diversification").alias("capped"), runs(stages, "overlap_bonus").alias("overlaps"))


def key_player_factor(weight=0.067):
    from ..operators import flows as fl

    return 1 + (sc.half(fl.key_player_score(C("key_player_cost"), C("close"))) - 0.5) * weight


def within_risk(p, d, stages):
    """The hard risk rule of every mode, on quantiles over its candidates of the date."""
    q = {f"_q_{m}": (RISK[m][0], RISK[m][1]) for m in RISK}
    d = p.xs.with_quantiles(d, KEY, q)
    keep = F.lit(False)
    for m, (col, _, _) in RISK.items():
        keep = F.when(C("mode") == m, sn.yes(C(col) <= F.least(C(f"_q_{m}"), F.lit(CAPS[col])))).otherwise(keep)
    return d.where(~runs(stages, "risk_filter") | keep).drop(*q)


def select(p, d, overlap):
    """Score floor, pool of twice the list, sector cap and trim, of rows whose overlap bonus is known."""
    d = d.withColumn("overlap_bonus", overlap).withColumn("composite_score", F.round(C("composite_score") * (1 + C("overlap_bonus")), 9))
    d = d.where(C("floor").isNull() | (C("composite_score") >= C("floor")))
    d = p.xs.top(d, KEY, [F.desc("composite_score"), C("symbol")], 2 * TOP, "pool_rank")
    w = Window.partitionBy(*KEY)
    d = d.withColumn("_k", F.row_number().over(Window.partitionBy(*KEY, "industry").orderBy("pool_rank")))
    d = d.where(~C("capped") | (C("_k") <= rk.sector_cap(TOP)))
    d = d.withColumn("rank", F.row_number().over(w.orderBy("pool_rank")).cast("long")).where(C("rank") <= C("keep"))
    return d.select("symbol", "date", "mode", "industry", "composite_score", "overlap_bonus", "pool_rank", "rank")


def previous(base_dates, picks):
    """(mode, date, before): the names of the mode's latest earlier list, null where there is none."""
    lists = picks.groupBy("mode", "date").agg(F.sort_array(F.collect_set("symbol")).alias("_list"))  # TOP names at most
    w = Window.partitionBy("mode").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)  # one row per date
    d = base_dates.join(lists, ["mode", "date"], "left")
    return d.withColumn("before", F.last("_list", ignorenulls=True).over(w)).drop("_list")


def settled(p, base):
    """The fixed point of `select` under the overlap bonus, and the number of rounds it took."""
    base = cut(base)
    fixed = cut(select(p, base, F.lit(0.0)))
    still = fixed.where(~C("mode").isin(overlap_modes(base)))
    picks = fixed.where(C("mode").isin(overlap_modes(base)))
    moving = base.where("overlaps")
    dates = cut(moving.select("mode", "date").distinct())
    used = dates.withColumn("before", F.lit(None).cast("array<long>"))
    rounds = 0
    while True:
        now = cut(previous(dates, picks))
        changed = now.join(used.withColumnRenamed("before", "_used"), ["mode", "date"]).where(~C("before").eqNullSafe(C("_used"))).drop("_used")
        changed = cut(changed)
        if changed.isEmpty():
            return still.unionByName(picks), rounds
        rounds += 1
        part = moving.join(changed, ["mode", "date"])
        bonus = F.when(sn.yes(F.array_contains("before", C("symbol"))), OVERLAP).otherwise(0.0)
        new = select(p, part, bonus)
        picks = cut(picks.join(changed.select("mode", "date"), ["mode", "date"], "left_anti").select(*new.columns).unionByName(new))
        used = now


def overlap_modes(base):
    """At most as many as there are modes."""
    return [r["mode"] for r in base.where("overlaps").select("mode").distinct().collect()]


def scan(p, stages=None):
    """The lists of all modes and scan dates."""
    return settled(p, adjusted(p, stages or STAGES))[0]


# -- twin -----------------------------------------------------------------------------------------------


def _in(name, col="mode"):
    on = [m for m, s in STAGES.items() if getattr(s, name)]
    return f"{col} IN ({', '.join(repr(m) for m in on)})" if on else "false"


_F = lambda name, factor: f"CASE WHEN {_in(name)} THEN {factor} ELSE 1 END"
_COARSE_SQL = "CASE mode " + " ".join(f"WHEN '{m}' THEN round({' + '.join(f'{pr_sql(c, 'date, mode')} * {x}' for c, x in w.items())}, 9)" for m, w in COARSE.items()) + " END"
MTF = "CASE WHEN technical_score > 0.55 AND weekly_bonus > 0 THEN 0.04 WHEN technical_score <= 0.55 AND weekly_bonus < 0 THEN -0.03 WHEN technical_score > 0.55 AND weekly_bonus < 0 THEN -0.02 WHEN technical_score <= 0.55 AND weekly_bonus > 0 THEN -0.02 ELSE 0 END"
cte("scin_p", """SELECT c.*, i.industry, b.* EXCLUDE (symbol, date), s.* EXCLUDE (symbol, date), m.v20, m.inst_net, m.momentum, f.cum20, r.excess_20, h.hv60 * sqrt(252.0) AS hv60, c.close / c.sma60 AS trend, c.atr14 / c.close AS atr, CASE WHEN c.n >= 10 THEN c.hv20 END AS vol20, u.eps_pos, t.pe_threshold, g.drawdown_20d
  FROM comp_p c JOIN info_p i ON i.symbol = c.symbol JOIN bond_p b ON b.symbol = c.symbol AND b.date = c.date JOIN soft_p s ON s.symbol = c.symbol AND s.date = c.date JOIN cscan_p m ON m.symbol = c.symbol AND m.date = c.date
  JOIN fl0_p f ON f.symbol = c.symbol AND f.date = c.date JOIN rs_p r ON r.symbol = c.symbol AND r.date = c.date JOIN (SELECT symbol, date, stddev_samp(r1) OVER (PARTITION BY symbol ORDER BY date ROWS 59 PRECEDING) AS hv60 FROM bars_r) h ON h.symbol = c.symbol AND h.date = c.date
  JOIN fund_p u ON u.symbol = c.symbol AND u.date = c.date JOIN uni_p n ON n.symbol = c.symbol AND n.date = c.date AND (n.s3 OR n.from_memory) LEFT JOIN idxdd_p g ON g.date = c.date
  JOIN (SELECT symbol, date, CASE WHEN count(pos) OVER w >= 3 THEN median(pos) OVER w * 1.5 ELSE 50 END AS pe_threshold FROM (SELECT d.symbol, d.date, industry, CASE WHEN pe > 0 THEN pe END AS pos FROM dims_p d JOIN info_p i ON i.symbol = d.symbol) WINDOW w AS (PARTITION BY date, industry)) t ON t.symbol = c.symbol AND t.date = c.date
  WHERE NOT ((c.regime = 'sideways' AND c.mode IN ('momentum', 'growth')) OR (c.regime = 'crisis' AND c.mode = 'growth'))""")
cte("sccoarse_p", f"""SELECT * FROM (SELECT *, {_COARSE_SQL} AS coarse_score, count(*) OVER (PARTITION BY date, mode) AS n_names FROM scin_p WHERE coalesce(CASE mode WHEN 'momentum' THEN volume > v20 * 0.5 WHEN 'swing' THEN n >= 60 AND close > sma60
    WHEN 'value' THEN pe IS NOT NULL AND ((pe > 0 AND pe < pe_threshold) OR coalesce(dividend_yield > 8.5, false)) WHEN 'dividend' THEN dividend_yield > 8 AND pe > 0 AND NOT coalesce(eps_pos < 1, false) WHEN 'growth' THEN yoy_growth > 10 END, false))
  QUALIFY row_number() OVER (PARTITION BY date, mode ORDER BY coarse_score DESC, symbol) <= greatest(150, floor(0.15 * n_names))""")
_KP = "(1 + (CASE WHEN close / key_player_cost < 0.95 THEN 0.8 WHEN close / key_player_cost > 1.10 THEN 0.2 ELSE 0.5 END - 0.5) * 0.067)"
_HARD = "CASE mode " + " ".join(f"WHEN '{m}' THEN {'hv60_' if c == 'vol60' else c} <= least(quantile_cont({'hv60_' if c == 'vol60' else c}, {q}) OVER (PARTITION BY date, mode), {CAPS[c]})" for m, (c, q, _) in RISK.items()) + " END"
_HOT = ", ".join(repr(m) for m in RISK if RISK[m][2])
cte("scsoft_p", f"""SELECT *, CASE WHEN n >= 10 THEN hv60 END AS hv60_, ({MTF})::DOUBLE AS mtf, (composite_score + CASE WHEN mode = 'swing' THEN greatest(vcp_bonus, breakout_bonus) ELSE 0 END) * {_F('sector_bonus', '(1 + sector_bonus)')} * {_F('sector_relative_strength', '(1 + relative_strength_bonus)')} * {_F('concept_bonus', '(1 + concept_bonus)')}
    * {_F('peer_fundamental_ranking', '(1 + peer_rank_bonus)')} * {_F('weekly_trend_bonus', '(1 + weekly_bonus)')} * {_F('momentum_decay', "(1 + CASE WHEN mode IN ('momentum', 'growth') THEN momentum_decay ELSE 0 END)")} * {_F('institutional_acceleration', '(1 + inst_accel_bonus)')}
    * {_F('chip_macd', '(1 + (chip_macd_score - 0.5) * 0.06)')} * {_F('key_player_cost', _KP)} * {_F('volume_price_divergence', '(1 + vp_divergence)')} * {_F('multi_timeframe_alignment', f'(1 + ({MTF}))')} AS s0,
    CASE WHEN count(news_score) OVER (PARTITION BY date, mode) >= 20 THEN least(quantile_cont(news_score, 0.15) OVER (PARTITION BY date, mode), 0.3) ELSE 0.15 END AS news_cut FROM sccoarse_p""")
cte("schard_p", f"""SELECT symbol, date, mode, industry, s, CASE WHEN {_in('score_threshold')} THEN CASE regime WHEN 'bull' THEN 0.45 WHEN 'bear' THEN 0.55 WHEN 'crisis' THEN 0.60 ELSE 0.50 END END AS floor,
    CASE WHEN drawdown_20d IS NULL OR drawdown_20d > -0.10 OR mode IN ('value', 'dividend') THEN {TOP} WHEN drawdown_20d > -0.15 THEN {TOP // 2} ELSE {TOP // 3} END AS keep, dense_rank() OVER (ORDER BY date) AS o FROM (
  SELECT * REPLACE (CASE WHEN mode IN ({_HOT}) AND (r5 > {HEAT['da5']} OR r10 > {HEAT['da10']}) THEN s * 0.85 ELSE s END AS s) FROM (
    SELECT *, s0 * CASE WHEN {_in('negative_news_gate')} AND coalesce(news_score < news_cut, false) THEN 0.92 ELSE 1 END AS s, coalesce({_HARD}, false) AS calm FROM scsoft_p)
  WHERE calm AND NOT (mode IN ({_HOT}) AND (coalesce(r5, 0) > {HEAT['ex5']} OR coalesce(r10, 0) > {HEAT['ex10']})) AND NOT (regime = 'crisis' AND (coalesce(excess_20 < -0.10, false) OR coalesce(n >= 60 AND close < sma60, false)))
    AND NOT ({_in('multi_timeframe_alignment')} AND mode IN ('momentum', 'growth') AND mtf = -0.03))""")
# one scan date a step; a mode without picks hands on those of its last list
cte("scrounds_p", f"""/*RECURSIVE*/SELECT 0 AS o, NULL::DATE AS date, mode, NULL::BIGINT AS symbol, NULL::VARCHAR AS industry, NULL::DOUBLE AS composite_score, NULL::DOUBLE AS overlap_bonus, NULL::BIGINT AS pool_rank, NULL::BIGINT AS rank, false AS fresh FROM (SELECT DISTINCT mode FROM schard_p)
  UNION ALL (
    WITH last_list AS (SELECT * FROM scrounds_p), step AS (SELECT max(o) + 1 AS o FROM last_list),
    bonus AS (SELECT b.*, CASE WHEN {_in('overlap_bonus', 'b.mode')} AND l.symbol IS NOT NULL THEN {OVERLAP} ELSE 0.0 END::DOUBLE AS ob FROM schard_p b JOIN step t ON t.o = b.o LEFT JOIN last_list l ON l.mode = b.mode AND l.symbol = b.symbol),
    pooled AS (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY sf DESC, symbol) AS pk FROM (SELECT *, round(s * (1 + ob), 9) AS sf FROM bonus) WHERE floor IS NULL OR sf >= floor),
    capped AS (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY pk) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY mode, industry ORDER BY pk) AS k FROM pooled WHERE pk <= {2 * TOP}) WHERE NOT {_in('sector_diversification')} OR k <= {rk.sector_cap(TOP)}),
    listed AS (SELECT o, date, mode, symbol, industry, sf, ob, pk, rk FROM capped WHERE rk <= keep)
    SELECT o::INT, date, mode, symbol, industry, sf, ob, pk, rk, true FROM listed
    UNION ALL SELECT t.o::INT, l.date, l.mode, l.symbol, l.industry, l.composite_score, l.overlap_bonus, l.pool_rank, l.rank, false FROM last_list l, step t WHERE t.o <= (SELECT max(o) FROM schard_p) AND l.mode NOT IN (SELECT mode FROM listed))""")


@plan("i38_run_scan", "SELECT symbol, date, mode, industry, composite_score, overlap_bonus, pool_rank, rank FROM scrounds_p WHERE fresh", "composite_score overlap_bonus")
def _(p):
    return scan(p)
