"""Dimension scores, composite and the soft / hard stages of a scan.

All functions work on every scan date at once: time-series inputs are windows by symbol,
ranks are cross-sections by date.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.crosssection import CrossSection
from ..functions.exprs import DATE, SYMBOL, clip, div, lookup, symbol_window, trailing
from ..functions.timeseries import asof, ret, streak
from .indicators import decayed_flow

W = symbol_window
C = F.col

# Dimension weights by mode and regime.
REGIME_WEIGHTS = {
    "momentum": {
        "bull": {"technical": 0.00, "chip": 0.55, "fundamental": 0.45, "news": 0.00},
        "sideways": {"technical": 0.00, "chip": 0.45, "fundamental": 0.40, "news": 0.15},
        "bear": {"technical": 0.00, "chip": 0.42, "fundamental": 0.38, "news": 0.20},
        "crisis": {"technical": 0.00, "chip": 0.35, "fundamental": 0.30, "news": 0.35},
    },
    "swing": {
        "bull": {"technical": 0.30, "chip": 0.20, "fundamental": 0.40, "news": 0.10},
        "sideways": {"technical": 0.25, "chip": 0.25, "fundamental": 0.35, "news": 0.15},
        "bear": {"technical": 0.15, "chip": 0.25, "fundamental": 0.45, "news": 0.15},
        "crisis": {"technical": 0.05, "chip": 0.20, "fundamental": 0.55, "news": 0.20},
    },
    "value": {
        "bull": {"fundamental": 0.40, "valuation": 0.35, "chip": 0.15, "news": 0.10},
        "sideways": {"fundamental": 0.45, "valuation": 0.25, "chip": 0.15, "news": 0.15},
        "bear": {"fundamental": 0.50, "valuation": 0.20, "chip": 0.10, "news": 0.20},
        "crisis": {"fundamental": 0.55, "valuation": 0.15, "chip": 0.10, "news": 0.20},
    },
    "dividend": {
        "bull": {"fundamental": 0.35, "dividend": 0.35, "chip": 0.20, "news": 0.10},
        "sideways": {"fundamental": 0.40, "dividend": 0.30, "chip": 0.15, "news": 0.15},
        "bear": {"fundamental": 0.45, "dividend": 0.25, "chip": 0.10, "news": 0.20},
        "crisis": {"fundamental": 0.55, "dividend": 0.15, "chip": 0.10, "news": 0.20},
    },
    "growth": {
        "bull": {"fundamental": 0.45, "technical": 0.30, "chip": 0.15, "news": 0.10},
        "sideways": {"fundamental": 0.40, "technical": 0.25, "chip": 0.20, "news": 0.15},
        "bear": {"fundamental": 0.50, "technical": 0.15, "chip": 0.15, "news": 0.20},
        "crisis": {"fundamental": 0.60, "technical": 0.05, "chip": 0.15, "news": 0.20},
    },
}
MODES = list(REGIME_WEIGHTS)
DIMENSIONS = ["technical", "chip", "fundamental", "news", "valuation", "dividend"]
# Modes that do not run in a regime.
MODE_BLOCK = {"sideways": ["momentum", "growth"], "crisis": ["growth"]}
# Chip weights and tier by the inputs that are there; the first row whose inputs all are holds.
CHIP_TIERS = {
    "momentum": [
        (("broker", "sbl", "margin"), {"consec": 0.29, "bvr": 0.27, "persist": 0.06, "smr": 0.14, "sbl": 0.12, "broker": 0.12}, "6F"),
        (("broker", "sbl"), {"consec": 0.36, "bvr": 0.30, "persist": 0.06, "sbl": 0.14, "broker": 0.14}, "5F"),
        (("broker",), {"consec": 0.41, "bvr": 0.33, "persist": 0.06, "broker": 0.20}, "4F"),
        (("sbl", "margin"), {"consec": 0.33, "bvr": 0.30, "persist": 0.06, "smr": 0.16, "sbl": 0.15}, "5F"),
        (("sbl",), {"consec": 0.44, "bvr": 0.35, "persist": 0.06, "sbl": 0.15}, "4F"),
        (("margin",), {"consec": 0.39, "bvr": 0.35, "persist": 0.06, "smr": 0.20}, "4F"),
        ((), {"consec": 0.50, "bvr": 0.40, "persist": 0.10}, "3F"),
    ],
    "swing": [
        (("smart", "broker", "sbl", "whale"), {"trust": 0.18, "cum": 0.18, "persist20": 0.08, "whale": 0.12, "broker": 0.12, "sbl": 0.10, "smart": 0.22}, "6F"),
        (("whale", "broker", "sbl"), {"trust": 0.24, "cum": 0.24, "persist20": 0.08, "whale": 0.16, "broker": 0.16, "sbl": 0.12}, "5F"),
        (("whale", "sbl"), {"trust": 0.29, "cum": 0.29, "persist20": 0.08, "whale": 0.19, "sbl": 0.15}, "4F"),
        (("broker", "sbl"), {"trust": 0.29, "cum": 0.29, "persist20": 0.08, "broker": 0.19, "sbl": 0.15}, "4F"),
        (("sbl",), {"trust": 0.36, "cum": 0.36, "persist20": 0.08, "sbl": 0.20}, "3F"),
        (("whale", "broker"), {"trust": 0.31, "cum": 0.31, "persist20": 0.08, "whale": 0.15, "broker": 0.15}, "4F"),
        (("whale",), {"trust": 0.36, "cum": 0.36, "persist20": 0.08, "whale": 0.20}, "3F"),
        (("broker",), {"trust": 0.36, "cum": 0.36, "persist20": 0.08, "broker": 0.20}, "3F"),
        ((), {"trust": 0.42, "cum": 0.42, "persist20": 0.16}, "2F"),
    ],
    "growth": [
        (("margin", "broker"), {"streak": 0.25, "bvr": 0.22, "total": 0.22, "smr": 0.16, "broker": 0.15}, "5F"),
        (("margin",), {"streak": 0.30, "bvr": 0.25, "total": 0.25, "smr": 0.20}, "4F"),
        (("broker",), {"streak": 0.32, "bvr": 0.24, "total": 0.24, "broker": 0.20}, "4F"),
        ((), {"streak": 0.40, "bvr": 0.30, "total": 0.30}, "3F"),
    ],
}
#: The rank column of each factor.
CHIP_RANKS = {"consec": "k_consec", "bvr": "k_bvr", "persist": "k_p10", "smr": "k_smr", "sbl": "k_sbl", "broker": "k_broker", "trust": "k_trust", "cum": "k_cum", "persist20": "k_p20", "whale": "k_whale", "smart": "k_smart", "streak": "k_streak", "total": "k_total"}


def chip_tier(mode: str) -> tuple[dict[str, Column], Column]:
    """The weight of each factor, 0 where it isn't used, and the tier, by a row's own ``has_...`` flags."""
    table = CHIP_TIERS[mode]
    factors = list(dict.fromkeys(f for _, w, _ in table for f in w))
    weights, tier = {f: F.lit(0.0) for f in factors}, F.lit("N/A")
    for needs, w, name in reversed(table):
        there = reduce(lambda a, n: a & C(f"has_{n}"), needs, F.lit(True))
        weights = {f: F.when(there, w.get(f, 0.0)).otherwise(e) for f, e in weights.items()}
        tier = F.when(there, name).otherwise(tier)
    return weights, tier


def chip_tier_sql(mode: str) -> tuple[dict[str, str], str]:
    """The same as SQL."""
    table = CHIP_TIERS[mode]
    factors = list(dict.fromkeys(f for _, w, _ in table for f in w))
    case = lambda pick: "CASE " + " ".join(f"WHEN {' AND '.join(f'has_{n}' for n in needs) or 'true'} THEN {pick(w, name)}" for needs, w, name in table) + " END"
    return {f: case(lambda w, _, f=f: float(w.get(f, 0.0))) for f in factors}, case(lambda _, name: f"'{name}'")


def half(c) -> Column:
    """Missing score -> 0.5."""
    return F.coalesce(C(c) if isinstance(c, str) else c, F.lit(0.5))


def unit(x: Column) -> Column:
    return clip(x, 0, 1)


def average(parts: list[tuple[Column, Column]], enough: Column) -> Column:
    """Mean of the (condition, value) parts whose condition holds; 0.5 below the minimum history."""
    tot = reduce(lambda a, b: a + b, [F.when(c, v).otherwise(0.0) for c, v in parts])
    n = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(False)).cast("int") for c, _ in parts])
    return F.when(enough & (n > 0), tot / F.when(n > 0, n)).otherwise(0.5)


# -- inputs ---------------------------------------------------------------------


def price_inputs(df: DataFrame) -> DataFrame:
    """Trailing price and volume statistics; gates are applied by the scores through ``n``."""
    t = trailing
    df = df.withColumns({"n": F.row_number().over(W()).cast("long"), "r1": ret("close", 1)})
    return df.withColumns(
        {
            **{f"r{k}": ret("close", k) for k in (2, 3, 5, 10, 60)},
            **{f"sma{k}": F.avg("close").over(t(k)) for k in (5, 20, 60, 120)},
            **{f"v{k}": F.avg("volume").over(t(k)) for k in (3, 10, 20)},
            "vprev": F.avg("volume").over(W().rowsBetween(-20, -1)),
            "vlag2": F.lag("volume", 2).over(W()),
            "top20": F.max("close").over(t(20)),
            "hi5": F.max("high").over(t(5)),
            "lo5": F.min("low").over(t(5)),
            "sd5": F.stddev_pop("close").over(t(5)),
            "min120": F.min("close").over(t(120)),
            "sma60_ago": F.avg("close").over(W().rowsBetween(-79, -20)),
            "worst45": F.min("r1").over(t(45)),
            "hv20": F.stddev_samp("r1").over(t(20)),
            "upv": F.avg(F.when(C("r1") > 0, C("volume"))).over(t(20)),
            "dnv": F.avg(F.when(C("r1") <= 0, C("volume"))).over(t(20)),
        }
    )


def flow_inputs(df: DataFrame) -> DataFrame:
    """Trailing investor flow statistics."""
    s = lambda c, k: F.sum(c).over(trailing(k))
    df = streak(df, C("foreign_net") > 0, "foreign_streak")
    df = streak(df, C("total_net") > 0, "total_streak")
    df = decayed_flow(df)
    # days back as SQL, as rangeBetween() takes no frame of days over dates: the other windows' order serves this one too
    hits = lambda weeks: F.expr(f"sum(if(total_net > 0, 1, 0)) OVER (PARTITION BY {SYMBOL} ORDER BY {DATE} RANGE BETWEEN {7 * (weeks - 1)} PRECEDING AND CURRENT ROW)") / weeks
    return df.withColumns(
        {
            "foreign_sum": s("foreign_net", 10),
            "trust_sum": s("trust_net", 10),
            "total_sum": s("total_net", 10),
            "cum20": s("total_net", 20),
            "buy_vol_ratio": div(s("total_net", 10), "volume"),
            "persist10": hits(10),
            "persist20": hits(20),
            "smr": F.when(C("margin_balance") > 0, C("short_balance") / F.when(C("margin_balance") > 0, C("margin_balance"))).otherwise(0.0),
        }
    )


def broker_inputs(brokers: DataFrame) -> DataFrame:
    """Per (symbol, date): buyer concentration, its trend, and how long the same broker leads."""
    net = C("buy") - C("sell")
    pos = F.greatest(net, F.lit(0.0))
    lead = F.max_by(C("broker"), F.struct(net, -C("broker")))
    d = brokers.groupBy(SYMBOL, DATE).agg(
        F.sum(pos).alias("_p"), F.sum(pos * pos).alias("_q"), F.when(F.max(net) > 0, lead).alias("_b")
    )
    d = d.withColumn("hhi", F.coalesce(C("_q") / F.when(C("_p") > 0, C("_p") * C("_p")), F.lit(0.0)))
    same = F.coalesce(C("_b") == F.lag("_b").over(W()), F.lit(False))
    k = F.row_number().over(W())
    d = d.withColumns({"_k": k, "_from": F.when(~same, k)})
    d = d.withColumns(
        {
            "lead_days": F.when(C("_b").isNotNull(), C("_k") - F.max("_from").over(W()) + 1).otherwise(0).cast("long"),
            "hhi_trend": F.avg("hhi").over(trailing(3)) - F.avg("hhi").over(trailing(7)),
            "hhi_short_avg": F.avg("hhi").over(trailing(3)),
        }
    )
    return d.select(SYMBOL, DATE, "hhi", "hhi_trend", "hhi_short_avg", "lead_days")


def revenue_asof(scan: DataFrame, revenue: DataFrame) -> DataFrame:
    """Latest revenue row that is public at each (symbol, date), at most 180 days old."""
    from ..functions.calendar import revenue_visible_cutoff

    cols = ["yoy_growth", "mom_growth", "prev_yoy", "yoy_3m_ago", "rev_accel_score"]
    cols = [c for c in cols if c in revenue.columns]
    q = scan.withColumn("_cut", revenue_visible_cutoff(DATE))
    r = revenue.withColumnRenamed(DATE, "revenue_month")
    out = asof(q, r, on=SYMBOL, probe_date="_cut", fact_date="revenue_month", values=cols, tolerance_days=180, matched="revenue_month", unique=True)
    return out.drop("_cut")


def statements_asof(scan: DataFrame, statements: DataFrame, cols: list[str]) -> DataFrame:
    """Newest statement whose publication deadline has passed."""
    from ..functions.calendar import financial_visible_cutoff

    q = scan.withColumn("_cut", financial_visible_cutoff(DATE))
    s = statements.withColumnRenamed(DATE, "quarter_end")
    return asof(q, s, on=SYMBOL, probe_date="_cut", fact_date="quarter_end", values=cols, matched="quarter_end", unique=True).drop("_cut")


def statement_inputs(st: DataFrame) -> DataFrame:
    """Quarter-over-quarter and year-over-year statement features."""
    prior = st.select(SYMBOL, (C("year") + 1).alias("year"), "quarter", C("gross_margin").alias("_pg"), C("eps").alias("_pe"))
    d = st.join(prior, [SYMBOL, "year", "quarter"], "left")
    l = lambda c, k=1: F.lag(c, k).over(W())
    w4 = trailing(4)
    big = lambda c: F.when(F.abs(c) > 0.01, F.abs(c))
    return d.withColumns(
        {
            "roe_qoq": C("roe") - l("roe"),
            "gm_qoq": C("gross_margin") - l("gross_margin"),
            "gm_trend": C("gross_margin") - l("gross_margin", 2),
            "gm_yoy": C("gross_margin") - C("_pg"),
            "eps_yoy": (C("eps") - C("_pe")) / big(C("_pe")),
            "eps_qoq": (C("eps") - l("eps")) / big(l("eps")),
            "eps_std": F.coalesce(F.stddev_samp("eps").over(w4), F.lit(0.0)),
            "eps_pos": F.avg((C("eps") > 0).cast("int")).over(w4),
        }
    ).drop("_pg", "_pe")


# -- technical dimensions ---------------------------------------------------------


def technical_short(d: DataFrame) -> Column:
    """Mean of up to six short-term components."""
    n, z = C("n"), F.lit(0.5)
    up, vup = C("r2") > 0, C("volume") - C("vlag2") > 0
    return average(
        [
            (n >= 5, (C("close") > C("sma5")).cast("double")),
            (n >= 4, unit(0.5 + C("r3") * 10)),
            (n >= 3, F.coalesce((C("close") - C("lo5")) / F.when(C("hi5") > C("lo5"), C("hi5") - C("lo5")), z)),
            (n >= 3, F.coalesce(F.least(F.lit(2.0), C("volume") / F.when(C("vprev") > 0, C("vprev"))) / 2, z)),
            (n >= 5, 1 - F.least(C("sd5") / C("sma5") / 0.1, F.lit(1.0))),
            (n >= 3, F.when(up & vup, 1.0).when(up, 0.3).when(~vup, 0.5).otherwise(0.2)),
        ],
        n >= 3,
    )


def _spread3() -> Column:
    """Population deviation of three means over their mean."""
    m = (C("sma20") + C("sma60") + C("sma120")) / 3
    var = (F.pow(C("sma20") - m, 2) + F.pow(C("sma60") - m, 2) + F.pow(C("sma120") - m, 2)) / 3
    return F.greatest(F.lit(0.0), 1 - F.sqrt(var) / m / 0.06)


def technical_value(d: DataFrame) -> Column:
    """Distance to the 120-row low, RSI, mean convergence, SMA5."""
    n = C("n")
    return average(
        [
            (n >= 120, F.greatest(F.lit(0.0), 1 - (C("close") / C("min120") - 1) / 0.5)),
            (n >= 15, F.greatest(F.lit(0.0), (70 - C("rsi")) / 70)),
            (n >= 120, _spread3()),
            (n >= 5, (C("close") > C("sma5")).cast("double")),
        ],
        n >= 15,
    )


def technical_dividend(d: DataFrame, gap: float = -0.045) -> Column:
    """Slope of SMA60 (neutral after an ex-dividend gap), RSI near 50, convergence, low volatility."""
    n = C("n")
    slope = unit(0.5 + (C("sma60") / C("sma60_ago") - 1) * 50)
    return average(
        [
            (n >= 80, F.when(C("worst45") <= gap, 0.5).otherwise(slope)),
            (n >= 15, F.greatest(F.lit(0.0), 1 - F.abs(C("rsi") - 50) / 50)),
            (n >= 120, _spread3()),
            (n >= 21, F.greatest(F.lit(0.0), 1 - C("hv20") / 0.03)),
        ],
        n >= 15,
    )


def technical_swing(d: DataFrame) -> Column:
    """Medium-term trend, up/down volume and directional strength."""
    n = C("n")
    ratio = F.when(C("upv").isNotNull() & C("dnv").isNotNull(), unit(C("upv") / F.greatest(C("dnv"), F.lit(1.0)) / 2))
    vol = F.coalesce(ratio, F.when(C("upv").isNotNull(), 1.0).otherwise(0.0))
    return average(
        [
            (n >= 80, unit(0.5 + (C("sma60") / C("sma60_ago") - 1) * 50)),
            (n >= 60, unit(0.5 + (C("sma20") / C("sma60") - 1) * 20)),
            (n >= 61, unit(0.5 + C("r60") * 2)),
            (n >= 21, vol),
            (C("adx_14").isNotNull(), F.when(C("plus_di") > C("minus_di"), unit((C("adx_14") - 15) / 30)).otherwise(0.0)),
        ],
        n >= 3,
    )


def technical_momentum(d: DataFrame, xs: CrossSection, *, clusters: int = 5, by=DATE) -> DataFrame:
    """I4 (``clusters`` = 5 inputs) and I5 (3 inputs): ranked momentum, proximity and volume.

    A cluster without spread on a date is left out of the mean.
    """
    d = d.withColumns(
        {
            "_prox": F.when(C("n") >= 20, C("close") / C("top20")),
            "_vr": F.when(C("n") >= 20, div("volume", "v20")),
            "_va": F.when(C("n") >= 10, div("v3", "v10")),
        }
    )
    ranks = {"_r5": ("r5", True), "_rb": ("_prox", True), "_rv": ("_vr", True)}
    if clusters == 5:
        ranks |= {"_r10": ("r10", True), "_ra": ("_va", True)}
    d = xs.pct_rank(d, by, ranks)
    hot = C("r1") >= 0.098
    d = d.withColumns({k: half(F.when(hot, 1.0).otherwise(C(k)) if k in ("_rv", "_ra") else C(k)) for k in ranks})
    a = (C("_r5") + C("_r10")) / 2 if clusters == 5 else C("_r5")
    b = (C("_rv") + C("_ra")) / 2 if clusters == 5 else C("_rv")
    d = d.withColumns({"_a": a, "_b": b})
    d = xs.with_spread(d, by, {f"_s{k}": k for k in ("_a", "_b", "_rb")})
    on = {k: C(f"_s{k}") >= 1e-9 for k in ("_a", "_b", "_rb")}
    score = average([(on[k], C(k)) for k in on], F.lit(True))
    names = {"_r5": "tech_ret5d", "_r10": "tech_ret10d", "_rb": "tech_high20_proximity", "_rv": "tech_vol_ratio", "_ra": "tech_vol_accel"}
    d = d.withColumn("technical_score", score)
    for k in ranks:
        d = d.withColumnRenamed(k, names[k])
    return d.drop("_prox", "_vr", "_va", "_a", "_b", *[f"_s{k}" for k in on])


# -- chip dimensions -----------------------------------------------------------------


def chip_base(d: DataFrame, xs: CrossSection, by=DATE) -> DataFrame:
    """I7."""
    r = {"_f": "foreign_sum", "_t": "trust_sum", "_a": "total_sum", "_c": "total_streak", "_v": "buy_vol_ratio"}
    d = xs.pct_rank(d, by, {k: (c, True) for k, c in r.items()})
    s = C("_f") * 0.30 + C("_t") * 0.20 + C("_a") * 0.20 + C("_c") * 0.15 + C("_v") * 0.15
    return d.withColumn("chip_score", s).drop(*r)


def chip_ranks(d: DataFrame, xs: CrossSection, by=DATE, more: dict | None = None) -> DataFrame:
    """Ranks shared by the mode-specific chip scores (inputs of flow, broker and whale frames), and ``more`` in the same pass."""
    src = {
        "k_streak": ("foreign_streak", True),
        "k_bvr": ("buy_vol_ratio", True),
        "k_flow": ("inst_flow_weighted", True),
        "k_p10": ("persist10", True),
        "k_p20": ("persist20", True),
        "k_total": ("total_sum", True),
        "k_trust": ("trust_sum", True),
        "k_cum": ("cum20", True),
        "k_smr": ("smr", True),
        "k_sbl0": ("short_balance", True),
        "k_hhi": ("hhi", True),
        "k_lead": ("lead_days", True),
        "k_wp": ("whale_percent", True),
        "k_wc": ("whale_change", True),
    }
    d = d.withColumns({c: F.coalesce(C(c).cast("double"), F.lit(0.0)) for c in ("hhi", "lead_days", "whale_percent", "whale_change")})
    d = xs.pct_rank(d, by, src | (more or {}))
    return d.withColumns(
        {
            "k_consec": C("k_flow") * 0.6 + C("k_streak") * 0.4,
            "k_sbl": 1 - C("k_sbl0"),
            "k_broker": C("k_hhi") * 0.6 + C("k_lead") * 0.4,
            "k_whale": C("k_wp") * 0.6 + C("k_wc") * 0.4,
        }
    )


def drop_flat_factors(d: DataFrame, xs: CrossSection, weights: dict[str, float], by=DATE, eps: float = 1e-9) -> Column:
    """Weighted sum over factors with spread on the date, weights rescaled to their total.

    ``weights`` maps rank columns to weights, numbers or columns.  Returns (frame, score expression).
    """
    d = xs.with_spread(d, by, {f"_sp_{k}": k for k in weights})
    on = lambda k: C(f"_sp_{k}") >= eps
    tot = reduce(lambda a, b: a + b, weights.values())
    live = reduce(lambda a, b: a + b, [F.when(on(k), w).otherwise(0.0) for k, w in weights.items()])
    s = reduce(lambda a, b: a + b, [F.when(on(k), C(k) * w).otherwise(0.0) for k, w in weights.items()])
    return d, F.coalesce(s * tot / F.when(live > 0, live), F.lit(0.5))


def quality_modifiers(score: Column, bonus: float = 0.03, high: float = 0.25) -> Column:
    """Slope sign and, for concentrated names, the trend of concentration."""
    s = score + F.when(C("inst_slope") > 0, bonus).when(C("inst_slope") < 0, -bonus).otherwise(0.0)
    t = F.when(C("hhi_short_avg") >= high, F.when(C("hhi_trend") > 0, bonus).when(C("hhi_trend") < 0, -bonus).otherwise(0.0)).otherwise(0.0)
    return unit(s + t)


def chip_momentum(d: DataFrame, xs: CrossSection) -> DataFrame:
    """I8: factors with spread on the date, by the weights of the inputs that a name has."""
    w, tier = chip_tier("momentum")
    d = d.withColumns({f"_w{k}": e for k, e in w.items()}).withColumn("chip_tier", tier)
    d, s = drop_flat_factors(d, xs, {CHIP_RANKS[k]: C(f"_w{k}") for k in w})
    return d.withColumn("chip_score", quality_modifiers(s))


def chip_swing(d: DataFrame) -> DataFrame:
    """By the weights of the inputs that a name has, brokers that have done well among them."""
    w, tier = chip_tier("swing")
    s = reduce(lambda a, b: a + b, [e * C(CHIP_RANKS[k]) for k, e in w.items()])
    return d.withColumns({"chip_score": quality_modifiers(s), "chip_tier": tier})


def chip_value(d: DataFrame) -> Column:
    """I10."""
    return C("k_trust") * 0.4 + C("k_cum") * 0.4 + C("k_broker") * 0.2


def chip_dividend(d: DataFrame) -> Column:
    """I11."""
    return C("k_trust") * 0.5 + C("k_cum") * 0.5


def chip_growth(d: DataFrame) -> DataFrame:
    """By the weights of the inputs that a name has."""
    w, tier = chip_tier("growth")
    return d.withColumns({"chip_score": reduce(lambda a, b: a + b, [e * C(CHIP_RANKS[k]) for k, e in w.items()]), "chip_tier": tier})


def broker_rank_penalty(rank, penalty, persistence, factor: float = 0.5) -> Column:
    """I13."""
    p = F.coalesce(C(penalty), F.lit(0.0))
    return F.when(p > 0, C(rank) * (1 - p * (1 - F.coalesce(C(persistence), F.lit(0.0))) * factor)).otherwise(C(rank))


# -- fundamental, valuation, dividend -----------------------------------------------


def fundamental_ranks(d: DataFrame, xs: CrossSection, by=DATE) -> DataFrame:
    z = lambda c: F.coalesce(C(c), F.lit(0.0))
    d = d.withColumns(
        {
            "_y": z("yoy_growth"),
            "_m": z("mom_growth"),
            "_ap": z("yoy_growth") - z("prev_yoy"),
            "_a3": z("yoy_growth") - z("yoy_3m_ago"),
            "_eq": half("earnings_quality"),
        }
    )
    src = {
        "f_y": ("_y", True), "f_m": ("_m", True), "f_ap": ("_ap", True), "f_a3": ("_a3", True), "f_eq": ("_eq", True),
        "f_roeq": ("roe_qoq", True), "f_gmt": ("gm_trend", True), "f_roe": ("roe", True), "f_gmq": ("gm_qoq", True),
        "f_epsy": ("eps_yoy", True), "f_std": ("eps_std", False), "f_pos": ("eps_pos", True), "f_gmy": ("gm_yoy", True),
        "f_epsq": ("eps_qoq", True),
    }
    d = xs.pct_rank(d, by, src)
    return d.withColumns({k: half(k) for k in src}).drop("_y", "_m", "_ap", "_a3", "_eq")


def fundamental_base(d=None) -> Column:
    """I16."""
    return C("f_y") * 0.7 + C("f_m") * 0.3


FUNDAMENTAL = {
    "swing": lambda: C("f_y") * 0.30 + C("f_m") * 0.20 + C("f_ap") * 0.20 + C("f_roeq") * 0.15 + C("f_gmt") * 0.15,
    "value": lambda: fundamental_base() * 0.35 + C("f_roe") * 0.20 + C("f_gmq") * 0.15 + C("f_epsy") * 0.15 + C("f_eq") * 0.15,
    "dividend": lambda: fundamental_base() * 0.35 + C("f_std") * 0.25 + C("f_pos") * 0.25 + C("f_eq") * 0.15,
    "growth": lambda: C("f_y") * 0.40 + C("f_a3") * 0.25 + C("f_gmy") * 0.20 + C("f_epsq") * 0.15,
}

# Anchors of the four growth tiers and the blend of the momentum fundamental score.
TIER_ANCHOR = {1: 0.85, 2: 0.72, 3: 0.55, 4: 0.30}
TIER_BLEND = {"tier": 0.55, "intra": 0.15, "accel": 0.20, "quality": 0.10}


def fundamental_momentum(d: DataFrame, xs: CrossSection, by=DATE, min_samples: int = 10) -> DataFrame:
    """Growth tier anchor, rank inside the tier, acceleration and quality."""
    d = xs.with_stats(d, by, {"_ny": F.count("yoy_growth")})
    d = xs.with_quantiles(d, by, {"_p80": ("yoy_growth", 0.8), "_p60": ("yoy_growth", 0.6)})
    y, dyn = C("yoy_growth"), C("_ny") >= min_samples
    mom, acc = F.coalesce(C("mom_growth") > 0, F.lit(False)), F.coalesce(y > C("yoy_3m_ago"), F.lit(False))
    t1 = (y > 0) & acc & mom & (~dyn | (y > C("_p80")))
    t2 = (y > 0) & acc & (~dyn | (y > C("_p60")))
    d = d.withColumn("tier", F.when(y.isNull(), 0).when(t1, 1).when(t2, 2).when(y > 0, 3).otherwise(4).cast("long"))
    keys = [by] if isinstance(by, str) else list(by)
    d = xs.pct_rank(d, [*keys, "tier"], {"_ir": ("yoy_growth", True)})
    d = xs.with_stats(d, [*keys, "tier"], {"_nt": F.count("yoy_growth")})
    anchor = F.when(C("tier") == 1, TIER_ANCHOR[1]).when(C("tier") == 2, TIER_ANCHOR[2]).when(C("tier") == 3, TIER_ANCHOR[3]).otherwise(TIER_ANCHOR[4])
    intra = F.when((C("_nt") >= 2) & C("_ir").isNotNull(), C("_ir")).otherwise(0.5)
    b = TIER_BLEND
    s = b["tier"] * anchor + b["intra"] * intra + b["accel"] * half("rev_accel_score") + b["quality"] * half("quality_score")
    return d.withColumn("fundamental_score", F.when(C("tier") == 0, 0.5).otherwise(s)).drop("_ny", "_p80", "_p60", "_ir", "_nt")


def valuation_ranks(d: DataFrame, xs: CrossSection, by=DATE) -> DataFrame:
    """Cheapness and yield ranks."""
    d = d.withColumn("_dy", F.coalesce(C("dividend_yield"), F.lit(0.0)))
    d = xs.pct_rank(d, by, {"_pe": ("pe", False), "_pb": ("pb", False), "_yd": ("_dy", True)})
    pe, pb, dy = half("_pe"), half("_pb"), C("_yd")
    return d.withColumns(
        {"valuation_score": pe * 0.4 + pb * 0.3 + dy * 0.3, "dividend_score": dy * 0.5 + pe * 0.3 + pb * 0.2}
    ).drop("_dy", "_pe", "_pb", "_yd")


# -- composite -------------------------------------------------------------------


def weight_column(mode: Column, regime: Column, dim: str) -> Column:
    """Lookup of a dimension weight (0 when the mode does not use it)."""
    out = F.lit(0.0)
    for m, by_regime in REGIME_WEIGHTS.items():
        used = {g: w[dim] for g, w in by_regime.items() if dim in w}
        if used:
            out = F.when(mode == m, lookup(regime, used, 0.0)).otherwise(out)
    return out


def composite(scores: dict[str, Column], mode: Column, regime: Column) -> Column:
    """Weighted sum of the dimensions with 0.5 for missing scores."""
    return reduce(lambda a, b: a + b, [half(s) * weight_column(mode, regime, k) for k, s in scores.items()])


def mode_allowed(mode: Column, regime: Column) -> Column:
    """B34."""
    blocked = F.lit(False)
    for g, ms in MODE_BLOCK.items():
        blocked = blocked | ((regime == g) & mode.isin(ms))
    return ~blocked


def clip_budget(bonus: Column, used: Column, budget: float = 0.08) -> Column:
    """Keep the sum of related bonuses within the budget."""
    room = F.greatest(budget - F.abs(used), F.lit(0.0))
    return F.greatest(F.least(bonus, room), -room)
