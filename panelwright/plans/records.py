"""The candidate pool: every (scan date, mode, symbol) with its scores and ranks.

This is the engine's own output table; comparison, evaluation and portfolio queries read it.
"""

from pyspark.sql import functions as F

from ..operators import flows as fl
from ..operators import indicators as ind
from ..operators import ranking as rk
from ..operators import scoring as sc
from . import pointintime as pt
from .ctes import cte
from .regime import regimes
from .scoring import at_scan

C = F.col
TOP = 20
KEY = ["date", "mode"]
SCORES = ["technical", "chip", "fundamental", "news", "valuation", "dividend"]


def dimension_scores(p):
    """The stored candidate table: (names x scan dates) rows, a small fraction of the bars."""
    return p.shared("dimension_scores", lambda: build_dimension_scores(p))


def build_dimension_scores(p):
    """One row per (scan date, symbol) with all dimension scores and the regime."""
    d = at_scan(p, ind.atr(sc.flow_inputs(sc.price_inputs(p.wide()))))
    d = sc.chip_base(sc.technical_momentum(d, p.xs), p.xs)
    d = d.select("symbol", "date", "close", "volume", "atr14", "r5", "r10", "hv20", "n", "sma60", "technical_score", "chip_score")
    scan = d.select("symbol", "date")
    st = fl.ratios(p.statements()).withColumn("earnings_quality", F.lit(None).cast("double"))
    px = C("revenue") / C("shares")
    st = st.withColumns({"pe": px / F.when(C("eps") != 0, C("eps")), "pb": px * 100 / F.when(C("equity") != 0, C("equity")), "dividend_yield": C("gross_profit") / C("revenue") * 10})
    f = sc.revenue_asof(scan, fl.revenue_acceleration(ind.revenue_pivot(p.revenue())))
    f = sc.statements_asof(f, st, ["pe", "pb", "dividend_yield", "roe", "gross_margin", "eps"])
    z = lambda c: F.coalesce(C(c), F.lit(0.0))
    f = f.withColumns({"_y": z("yoy_growth"), "_m": z("mom_growth")})
    f = p.xs.pct_rank(f, "date", {"f_y": ("_y", True), "f_m": ("_m", True)})
    f = f.withColumn("fundamental_score", sc.fundamental_base())
    f = sc.valuation_ranks(f, p.xs)
    f = f.select("symbol", "date", "fundamental_score", "valuation_score", "dividend_score", "pe", "dividend_yield", "yoy_growth", "eps")
    d = d.join(f, ["symbol", "date"]).join(regimes(p, p.bars_beside_wide).select("date", "regime"), "date")
    return d.join(pt.news(p), ["symbol", "date"], "left")


def composites(p, d=None):
    """Scores times modes; with ``d`` of its rows, dimension scores that other columns were joined to: before they are
    multiplied."""
    d = dimension_scores(p) if d is None else d
    # a mode's weights depend on the regime alone
    s = lambda m: sc.composite({k: C(f"{k}_score") for k in SCORES}, F.lit(m), C("regime"))
    by_mode = [F.struct(F.lit(m).alias("mode"), F.round(s(m), 9).alias("composite_score")) for m in sc.MODES]
    d = d.withColumn("_mode", F.explode(F.array(*by_mode))).select("*", "_mode.*").drop("_mode")
    return d.withColumn("stop_loss", C("close") - 1.5 * C("atr14"))


def pool(p):
    # dealt out by date before rows are multiplied by the modes
    return rk.rank_pool(composites(p, dimension_scores(p).repartition("date")), p.xs, KEY, TOP)


def picks(p):
    """The selected names only. Rows below the least score that can be among the best are left out before the sort."""
    order = [F.desc("composite_score"), C("symbol")]
    least = p.shared("pick_bounds", lambda: p.xs.bounds(composites(p), KEY, "composite_score", TOP))
    return p.xs.top(p.xs.within(composites(p), KEY, "composite_score", least), KEY, order, TOP, "rank")


def weight_sql(dim):
    rows = [f"WHEN mode = '{m}' AND regime = '{g}' THEN {w[dim]}" for m, by in sc.REGIME_WEIGHTS.items() for g, w in by.items() if dim in w]
    return f"CASE {' '.join(rows)} ELSE 0 END"


cte("dims_p", """SELECT t.symbol, t.date, x.close, x.volume, a.atr14, x.r5, x.r10, x.hv20, x.n, x.sma60, t.technical_score, c.chip_score, f.f_y * 0.7 + f.f_m * 0.3 AS fundamental_score, o.news_score,
    v.valuation_score, v.dividend_score, w.pe, w.dividend_yield, u.yoy_growth, g.regime
  FROM tech5_p t JOIN pxs_p x ON x.symbol = t.symbol AND x.date = t.date JOIN chip7_p c ON c.symbol = t.symbol AND c.date = t.date JOIN fundr_p f ON f.symbol = t.symbol AND f.date = t.date JOIN valr_p v ON v.symbol = t.symbol AND v.date = t.date
  JOIN val_p w ON w.symbol = t.symbol AND w.date = t.date JOIN fund_p u ON u.symbol = t.symbol AND u.date = t.date JOIN atr_p a ON a.symbol = t.symbol AND a.date = t.date JOIN regime_p g ON g.date = t.date LEFT JOIN newsd_p o ON o.symbol = t.symbol AND o.date = t.date""")
cte("comp_p", "SELECT *, round(" + " + ".join(f"coalesce({k}_score, 0.5) * ({weight_sql(k)})" for k in SCORES) + ", 9) AS composite_score, close - 1.5 * atr14 AS stop_loss FROM dims_p, (SELECT unnest(['momentum', 'swing', 'value', 'dividend', 'growth']) AS mode)")
cte("pool_p", f"SELECT *, row_number() OVER (PARTITION BY date, mode ORDER BY composite_score DESC, symbol) AS pool_rank, row_number() OVER (PARTITION BY date, mode ORDER BY composite_score DESC, symbol) <= {TOP} AS selected FROM comp_p")
cte("picks_p", "SELECT *, pool_rank AS rank FROM pool_p WHERE selected")
