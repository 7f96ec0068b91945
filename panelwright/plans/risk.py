"""K, A14-A15 and the remaining C queries: portfolio, risk and back-test analytics."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.calendar import ordinals
from ..functions.timeseries import asof
from ..operators import flows as fl
from ..operators import indicators as ind
from ..operators import risk as rk
from . import records as rec
from .ctes import cte
from .indicators import dividend_events
from .registry import plan
from .research import verdicts
from .regime import regimes

C = F.col
INIT = 1_000_000.0
WP = "OVER (PARTITION BY portfolio ORDER BY date"


def d_(s):
    return F.lit(s).cast("date")


# -- equity ------------------------------------------------------------------------------

cte("eqr_p", f"SELECT *, capital / lag(capital) {WP}) - 1 AS ret, (max(capital) {WP}) - capital) / max(capital) {WP}) * 100 AS drawdown FROM snapshots_p")
cte("eqm_p", """SELECT portfolio, (fin / 1e6 - 1) * 100 AS total_return, (pow(fin / 1e6, 365.25 / days) - 1) * 100 AS annual_return, m / s * sqrt(252.0) AS sharpe_ratio, mdd AS max_drawdown, m / sn * sqrt(252.0) AS sortino_ratio, q * 100 AS var_95, cv * 100 AS cvar_95, (pow(fin / 1e6, 365.25 / days) - 1) * 100 / mdd AS calmar_ratio FROM (
   SELECT g.*, (SELECT avg(ret) FROM eqr_p e WHERE e.portfolio = g.portfolio AND e.ret <= g.q) AS cv FROM (SELECT portfolio, arg_max(capital, date) AS fin, datediff('day', min(date), max(date)) AS days, avg(ret) AS m, stddev_pop(ret) AS s, stddev_pop(ret) FILTER (ret < 0) AS sn, max(drawdown) AS mdd, quantile_cont(ret, 0.05) AS q FROM eqr_p GROUP BY 1) g)""")
EM = "total_return annual_return sharpe_ratio max_drawdown sortino_ratio var_95 cvar_95 calmar_ratio"


@plan("k01_compute_metrics", "SELECT * FROM eqm_p", EM)
def _(p):
    return rk.equity_metrics(p.snapshots(), "portfolio", INIT)


TS = "holding_days_avg holding_days_median avg_win_pnl:3 avg_loss_pnl:3 avg_win_return avg_loss_return profit_factor win_rate"


@plan("k02_trade_stats", """SELECT g.*, w AS max_consecutive_wins, l AS max_consecutive_losses FROM (SELECT portfolio, count(*) AS n, avg(days) AS holding_days_avg, median(days) AS holding_days_median, min(days) AS holding_days_min, max(days) AS holding_days_max, avg(pnl) FILTER (pnl > 0) AS avg_win_pnl, avg(pnl) FILTER (pnl < 0) AS avg_loss_pnl,
     avg(r) FILTER (pnl > 0) AS avg_win_return, avg(r) FILTER (pnl < 0) AS avg_loss_return, sum(pnl) FILTER (pnl > 0) / -sum(pnl) FILTER (pnl < 0) AS profit_factor, avg((pnl > 0)::INT) AS win_rate FROM pnl_p GROUP BY 1) g
   JOIN (SELECT portfolio, coalesce(max(c) FILTER (s > 0), 0) AS w, coalesce(max(c) FILTER (s < 0), 0) AS l FROM (SELECT portfolio, s, k - j AS i, count(*) AS c FROM (SELECT *, row_number() OVER (PARTITION BY portfolio ORDER BY entry_date, trade_id) AS k, row_number() OVER (PARTITION BY portfolio, s ORDER BY entry_date, trade_id) AS j FROM (SELECT *, sign(pnl) AS s FROM pnl_p)) GROUP BY 1, 2, 3) GROUP BY 1) x ON x.portfolio = g.portfolio""", TS)
def _(p):
    return rk.trade_stats(p.trades(), "portfolio")


cte("pnl_p", "SELECT *, (exit_price - entry_price) * shares AS pnl, exit_price / entry_price - 1 AS r, datediff('day', entry_date, exit_date) AS days FROM trades_p")


@plan("k02_exit_reasons", "SELECT portfolio, exit_reason, count(*) AS n FROM trades_p GROUP BY 1, 2")
def _(p):
    return rk.exit_reasons(p.trades(), "portfolio")


STEPS = " + ".join(f"(u >= {c!r})::INT" for c in rk.poisson_steps())


Q3 = lambda x, n: f"quantile_cont({x}, 0.05) AS {n}p5, quantile_cont({x}, 0.5) AS {n}p50, quantile_cont({x}, 0.95) AS {n}p95"


@plan("k03_bootstrap_returns", f"""SELECT portfolio, {Q3('growth', '')}, {Q3('drawdown', 'drawdown_')}, {Q3('sharpe', 'sharpe_')}, count(*) AS n_sims FROM (
  SELECT portfolio, sim, sum(step) AS growth, (1 - exp(-max(falls))) * 100 AS drawdown,
    CASE WHEN greatest(sum(m * r * r) / greatest(sum(m), 1) - pow(sum(m * r) / greatest(sum(m), 1), 2), 0) > 1e-18 THEN sum(m * r) / greatest(sum(m), 1) / sqrt(sum(m * r * r) / greatest(sum(m), 1) - pow(sum(m * r) / greatest(sum(m), 1), 2)) ELSE 0 END AS sharpe FROM (
    SELECT *, CASE WHEN m = 0 THEN 0 ELSE greatest(CASE WHEN g < 0 THEN (m - 1) * -g ELSE 0 END, coalesce(max(high) OVER (PARTITION BY portfolio, sim ORDER BY o, trade_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - low, 0)) END AS falls FROM (
      SELECT *, CASE WHEN m > 0 THEN cum - step + CASE WHEN g < 0 THEN g ELSE step END END AS high, CASE WHEN m > 0 THEN cum - step + CASE WHEN g < 0 THEN step ELSE g END END AS low FROM (
        SELECT *, sum(step) OVER (PARTITION BY portfolio, sim ORDER BY o, trade_id ROWS UNBOUNDED PRECEDING) AS cum FROM (SELECT *, g * m AS step FROM (
          SELECT *, {STEPS} AS m FROM (SELECT *, {rk.draw('trade_id', 'sim', 42)} AS u, (trade_id % {rk.RING} * 48271 + 42) % {rk.RING} AS o
            FROM (SELECT portfolio, trade_id::BIGINT AS trade_id, exit_price / entry_price - 1 AS r, ln(1 + greatest(exit_price / entry_price - 1, -0.999)) AS g FROM trades_p), range(200) t(sim)))))))
  GROUP BY 1, 2) GROUP BY 1""", " ".join(f"{n}p{q}" for n in ("", "drawdown_", "sharpe_") for q in (5, 50, 95)))
def _(p):
    t = p.trades().withColumn("return_pct", C("exit_price") / C("entry_price") - 1)
    return rk.bootstrap_paths(t, "portfolio", 200)


cte("dd_p", "SELECT portfolio, max(capital) AS peak, arg_max(capital, date) AS last FROM snapshots_p GROUP BY 1")


@plan("k04_portfolio_drawdown", "SELECT portfolio, peak, last, (peak - last) / peak * 100 AS drawdown_pct FROM dd_p", "peak:3 last:3 drawdown_pct")
def _(p):
    return rk.drawdown(p.snapshots(), "portfolio")


cte("eqh_p", "SELECT portfolio, date, 1e6 + sum(pnl) OVER (PARTITION BY portfolio ORDER BY date) AS capital FROM (SELECT portfolio, exit_date AS date, sum(pnl) AS pnl FROM pnl_p GROUP BY 1, 2)")


@plan("k05_drawdown_with_snapshots", "SELECT portfolio, max(capital) AS peak, arg_max(capital, (date, capital)) AS last, (max(capital) - arg_max(capital, (date, capital))) / max(capital) * 100 AS drawdown_pct FROM (SELECT portfolio, date, capital FROM eqh_p UNION ALL SELECT * FROM snapshots_p) GROUP BY 1", "peak:2 last:2 drawdown_pct")
def _(p):
    h = rk.equity_history(p.trades(), "portfolio", INIT).select("portfolio", "date", "capital").unionByName(p.snapshots())
    g = h.groupBy("portfolio").agg(F.max("capital").alias("peak"), F.max_by("capital", F.struct("date", "capital")).alias("last"))
    return g.withColumn("drawdown_pct", (C("peak") - C("last")) / C("peak") * 100)


@plan("k06_equity_history", "SELECT * FROM eqh_p", "capital:2")
def _(p):
    return rk.equity_history(p.trades(), "portfolio", INIT).select("portfolio", "date", "capital")


@plan("k15_drawdown_kill_switch", "SELECT portfolio, (peak - last) / peak * 100 >= 2.0 AS triggered FROM dd_p")
def _(p):
    return rk.drawdown(p.snapshots(), "portfolio").select("portfolio", (C("drawdown_pct") >= 2.0).alias("triggered"))


# -- held list: the best turnover names act as the positions -------------------------------


def held(p, n=8):
    g = p.lines().groupBy("symbol").agg(F.sum("l_extendedprice").alias("t"))
    return g.orderBy(F.desc("t"), "symbol").limit(n).select("symbol", "t")  # the position list of a portfolio


cte("held_p", "SELECT symbol, sum(l_extendedprice) AS t FROM lines_p GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
cte("alr_p", """SELECT symbol, date, r FROM (SELECT b.symbol, b.date, b.r1 AS r FROM bars_r b JOIN held_p h ON h.symbol = b.symbol WHERE r1 IS NOT NULL) x WHERE date IN (SELECT date FROM (SELECT b.date FROM bars_r b JOIN held_p h ON h.symbol = b.symbol WHERE r1 IS NOT NULL GROUP BY 1 HAVING count(*) = 8) ORDER BY date DESC LIMIT 60)""")
cte("mom_p", "SELECT x.symbol AS a, y.symbol AS b, covar_samp(x.r, y.r) AS cov, count(*) AS n, covar_samp(x.r, y.r) / (stddev_samp(x.r) * stddev_samp(y.r)) AS rho FROM alr_p x JOIN alr_p y ON y.date = x.date GROUP BY 1, 2")


def moments(p):
    return rk.pair_moments(rk.aligned_returns(p.closes(), held(p)))


@plan("k07_correlation_matrix", "SELECT a, b, rho, n FROM mom_p", "rho")
def _(p):
    return moments(p).select("a", "b", "rho", "n")


@plan("k08_covariance_matrix", "SELECT a, b, cov FROM mom_p WHERE n >= 20", "cov")
def _(p):
    return moments(p).where(C("n") >= 20).select("a", "b", "cov")


@plan("f19_high_correlation_pairs", "SELECT a, b, rho FROM mom_p WHERE a < b AND abs(rho) >= 0.1", "rho")
def _(p):
    return moments(p).where((C("a") < C("b")) & (F.abs("rho") >= 0.1)).select("a", "b", "rho")


@plan("k09_portfolio_var", """SELECT a AS symbol, w * cw / sqrt(v) * 1.6449 * 1e6 AS component_var, sqrt(v) * 1.6449 * 1e6 AS var_amount, sqrt(v) * 1.6449 * 100 AS var_pct FROM (SELECT *, sum(w * cw) OVER () AS v FROM (
   SELECT a, max(wa.t / tt) AS w, sum((cov + CASE WHEN a = b THEN 1e-8 ELSE 0 END) * wb.t / tt) AS cw FROM mom_p JOIN held_p wa ON wa.symbol = a JOIN held_p wb ON wb.symbol = b, (SELECT sum(t) AS tt FROM held_p) GROUP BY 1))""", "component_var:3 var_amount:3 var_pct")
def _(p):
    h = held(p)
    w = h.withColumn("weight", C("t") / F.sum("t").over(Window.partitionBy(F.lit(0)))).select("symbol", "weight")  # one row per position
    return rk.portfolio_var(moments(p), w, 1e6)


cte("vol_p", "SELECT i.industry, b.symbol, stddev_samp(r1) AS vol FROM bars_r b JOIN info_p i ON i.symbol = b.symbol GROUP BY 1, 2")


@plan("k10_vol_inverse_weights", "SELECT industry, symbol, vol, 1 / vol / sum(1 / vol) OVER (PARTITION BY industry) AS weight FROM vol_p", "vol weight")
def _(p):
    v = p.closes().withColumn("r", ind.ret("close", 1)).groupBy("symbol").agg(F.stddev_samp("r").alias("vol"))
    return rk.inverse_vol_weights(v.join(p.info().select("symbol", "industry"), "symbol"), "industry")


def positions(p):
    """Open positions: trades that exit after a date, with the last price before it as mark."""
    t = p.trades().where((C("entry_date") <= d_("2000-06-30")) & (C("exit_date") > d_("2000-06-30")))
    mark = p.closes().where(C("date") <= d_("2000-06-30"))
    mark = fl.last_rows(mark).select("symbol", C("close").alias("price"))
    t = t.join(mark, "symbol", "left").withColumns({"price": F.coalesce("price", "entry_price"), "stop_loss": F.when(C("exit_reason") != "expired", C("entry_price") * 0.9), "allocated": C("entry_price") * C("shares")})
    return t


cte("pos_p", """SELECT t.*, coalesce(m.close, entry_price) AS price, CASE WHEN exit_reason <> 'expired' THEN entry_price * 0.9 END AS stop_loss, entry_price * shares AS allocated FROM trades_p t LEFT JOIN (SELECT symbol, last(close ORDER BY date) AS close FROM bars_p WHERE date <= DATE '2000-06-30' GROUP BY 1) m ON m.symbol = t.symbol WHERE entry_date <= DATE '2000-06-30' AND exit_date > DATE '2000-06-30'""")
RISK = "CASE WHEN stop_loss IS NOT NULL AND price > 0 AND shares > 0 THEN greatest((price - stop_loss) * shares, 0) ELSE allocated * 0.03 END"


@plan("k11_portfolio_heat", f"SELECT portfolio, sum({RISK}) / 1e6 AS heat, count(*) AS n FROM pos_p GROUP BY 1", "heat")
def _(p):
    r = rk.position_risk("price", "stop_loss", "shares", "allocated")
    return positions(p).groupBy("portfolio").agg((F.sum(r) / INIT).alias("heat"), F.count(F.lit(1)).alias("n"))


@plan("k12_single_trade_risk", f"SELECT trade_id, ({RISK}) / 1e6 AS risk FROM pos_p", "risk")
def _(p):
    return positions(p).select("trade_id", (rk.position_risk("price", "stop_loss", "shares", "allocated") / INIT).alias("risk"))


from .scalars import BC, BS, SC, SS, ST, trades_n  # noqa: E402

CA = f"""SELECT portfolio, count(*) AS n_closed, 0::BIGINT AS n_open, sum({BC} + {SC}) AS commission, sum({ST}) AS tax, sum({BS} + {SS}) AS slippage, sum((entry_price + exit_price) * n) AS notional, sum({BC} + {SC} + {ST} + {BS} + {SS}) AS total_cost FROM tradesn_p"""
cte("ca_p", CA + " GROUP BY 1")
CAR = "commission:2 tax:2 slippage:2 notional:1 total_cost:2"


@plan("k13_cost_attribution", "SELECT * FROM ca_p", CAR)
def _(p):
    return rk.cost_attribution(trades_n(p), "portfolio", "n")


@plan("k14_cost_metrics", "SELECT portfolio, total_cost / 1e6 * 100 AS cost_drag_pct, notional / 1e6 AS turnover_ratio, total_cost / notional * 10000 AS cost_per_turnover_bps FROM ca_p", "cost_drag_pct turnover_ratio cost_per_turnover_bps")
def _(p):
    d = rk.cost_metrics(rk.cost_attribution(trades_n(p), "portfolio", "n"), INIT)
    return d.select("portfolio", "cost_drag_pct", "turnover_ratio", "cost_per_turnover_bps")


@plan("k28_cost_attribution_range", CA + " WHERE entry_date BETWEEN DATE '1998-01-01' AND DATE '1999-12-31' GROUP BY 1", CAR)
def _(p):
    d = trades_n(p).where(C("entry_date").between(d_("1998-01-01"), d_("1999-12-31")))
    return rk.cost_attribution(d, "portfolio", "n")


# -- benchmark -------------------------------------------------------------------------------


def bench_dividends(p):
    """Market dividend per quarter start: mean tax as amount."""
    return p.lines().groupBy(F.trunc("day", "quarter").alias("date")).agg((F.avg("l_tax") * 1000).alias("amount"))


cte("bdiv_p", "SELECT date_trunc('quarter', day)::DATE AS date, avg(l_tax) * 1000 AS amount FROM lines_p GROUP BY 1")
cte("bm_p", """SELECT s.portfolio, s.date, s.capital, i.close AS bm, coalesce(d.t, 0) AS dv FROM snapshots_p s ASOF LEFT JOIN index_d i ON i.date <= s.date ASOF LEFT JOIN (SELECT date, sum(amount) OVER (ORDER BY date) AS t FROM bdiv_p) d ON d.date <= s.date""")
cte("alpha_p", """SELECT *, cum_return_pct - benchmark_cum_return_pct AS alpha_cum_pct FROM (SELECT portfolio, date, capital, bm, capital / lag(capital) OVER w - 1 AS daily_return_pct, capital / first_value(capital) OVER w - 1 AS cum_return_pct, (bm + dv - lag(dv) OVER w) / lag(bm) OVER w - 1 AS benchmark_return_pct,
   (bm + dv - first_value(dv) OVER w) / first_value(bm) OVER w - 1 AS benchmark_cum_return_pct FROM bm_p WINDOW w AS (PARTITION BY portfolio ORDER BY date))""")
AL = "capital:3 daily_return_pct cum_return_pct benchmark_return_pct benchmark_cum_return_pct alpha_cum_pct"


def alpha_panel(p):
    return rk.benchmark_alpha(p.snapshots(), p.index("day"), bench_dividends(p))


@plan("k16_backfill_benchmark_alpha", "SELECT portfolio, date, capital, daily_return_pct, cum_return_pct, benchmark_return_pct, benchmark_cum_return_pct, alpha_cum_pct FROM alpha_p", AL)
def _(p):
    return alpha_panel(p).select("portfolio", "date", "capital", "daily_return_pct", "cum_return_pct", "benchmark_return_pct", "benchmark_cum_return_pct", "alpha_cum_pct")


@plan("h27_benchmark_alpha_fields", "SELECT portfolio, date, benchmark_return_pct, alpha_cum_pct FROM alpha_p WHERE date >= DATE '2001-01-01'", "benchmark_return_pct alpha_cum_pct")
def _(p):
    return alpha_panel(p).where(C("date") >= d_("2001-01-01")).select("portfolio", "date", "benchmark_return_pct", "alpha_cum_pct")


cte("smet_p", """SELECT portfolio, count(*) AS n, CASE WHEN count(daily_return_pct) >= 20 THEN avg(daily_return_pct) / stddev_samp(daily_return_pct) * sqrt(252.0) END AS sharpe_ratio, max(dd) AS max_drawdown_pct, avg((daily_return_pct > 0)::INT) * 100 AS win_rate_pct, arg_max(alpha_cum_pct, date) AS alpha_cum_pct FROM (
   SELECT *, (max(capital) OVER w - capital) / max(capital) OVER w * 100 AS dd, date < DATE '1999-01-01' AS early FROM alpha_p WINDOW w AS (PARTITION BY portfolio ORDER BY date)) GROUP BY 1""")
SM = "sharpe_ratio max_drawdown_pct win_rate_pct alpha_cum_pct"


@plan("a14_snapshot_metrics", "SELECT * FROM smet_p", SM)
def _(p):
    return rk.snapshot_metrics(alpha_panel(p))


cte("smet0_p", """SELECT portfolio, CASE WHEN count(daily_return_pct) >= 20 THEN avg(daily_return_pct) / stddev_samp(daily_return_pct) * sqrt(252.0) END AS sharpe_ratio, max(dd) AS max_drawdown_pct, avg((daily_return_pct > 0)::INT) * 100 AS win_rate_pct, arg_max(alpha_cum_pct, date) AS alpha_cum_pct FROM (
   SELECT *, (max(capital) OVER w - capital) / max(capital) OVER w * 100 AS dd FROM alpha_p WHERE date < DATE '1999-01-01' WINDOW w AS (PARTITION BY portfolio ORDER BY date)) GROUP BY 1""")


@plan("a15_compare_metrics", """SELECT portfolio, metric, baseline, current, current - baseline AS delta, coalesce(CASE metric WHEN 'max_drawdown_pct' THEN current - baseline > 2.0 WHEN 'sharpe_ratio' THEN current - baseline < -0.2 WHEN 'win_rate_pct' THEN current - baseline < -5.0 ELSE current - baseline < -0.03 END, false) AS is_regression, CASE WHEN current - baseline IS NULL THEN 'insufficient' ELSE 'compared' END AS status FROM (
   SELECT * FROM (UNPIVOT (SELECT portfolio, sharpe_ratio, max_drawdown_pct, win_rate_pct, alpha_cum_pct FROM smet0_p) ON sharpe_ratio, max_drawdown_pct, win_rate_pct, alpha_cum_pct INTO NAME metric VALUE baseline) a JOIN (UNPIVOT (SELECT portfolio, sharpe_ratio, max_drawdown_pct, win_rate_pct, alpha_cum_pct FROM smet_p) ON sharpe_ratio, max_drawdown_pct, win_rate_pct, alpha_cum_pct INTO NAME metric VALUE current) b USING (portfolio, metric))""", "baseline current delta")
def _(p):
    a = alpha_panel(p)
    return rk.compare_metrics(rk.snapshot_metrics(a.where(C("date") < d_("1999-01-01"))), rk.snapshot_metrics(a))


@plan("k17_backtest_metrics", f"SELECT portfolio, total_return, pow(1 + total_return / 100, 252.0 / n) - 1 AS annual_return, mdd AS max_drawdown, m / s * sqrt(252.0) AS sharpe FROM (SELECT portfolio, (arg_max(capital, date) / 1e6 - 1) * 100 AS total_return, count(*) AS n, max(drawdown) AS mdd, avg(ret) AS m, stddev_samp(ret) AS s FROM eqr_p GROUP BY 1)", "total_return annual_return max_drawdown sharpe")
def _(p):
    d = rk.equity_returns(p.snapshots(), "portfolio")
    g = d.groupBy("portfolio").agg(((F.max_by("capital", "date") / INIT - 1) * 100).alias("total_return"), F.count(F.lit(1)).alias("n"), F.max("drawdown").alias("max_drawdown"), (F.avg("ret") / F.stddev_samp("ret") * 252**0.5).alias("sharpe"))
    return g.select("portfolio", "total_return", (F.pow(1 + C("total_return") / 100, 252 / C("n")) - 1).alias("annual_return"), "max_drawdown", "sharpe")


@plan("k24_rotation_alpha_series", "SELECT portfolio, date, alpha_cum_pct, benchmark_cum_return_pct FROM alpha_p WHERE date >= (SELECT max(date) FROM alpha_p) - INTERVAL 365 DAY", "alpha_cum_pct benchmark_cum_return_pct")
def _(p):
    a = alpha_panel(p)
    cut = p.lines().agg(F.max("week")).scalar()
    return a.where(C("date") >= F.date_sub(cut, 365)).select("portfolio", "date", "alpha_cum_pct", "benchmark_cum_return_pct")


@plan("k25_alpha_chart", "SELECT portfolio, date, alpha_cum_pct + benchmark_cum_return_pct AS portfolio_cum FROM alpha_p", "portfolio_cum")
def _(p):
    return alpha_panel(p).select("portfolio", "date", (C("alpha_cum_pct") + C("benchmark_cum_return_pct")).alias("portfolio_cum"))


@plan("k26_portfolio_review", """SELECT portfolio, arg_max(daily_return_pct, date) AS period_return, arg_max(capital, date) / arg_min(capital, date) FILTER (date >= DATE '2001-11-01') - 1 AS mtd_return, avg(daily_return_pct) / stddev_samp(daily_return_pct) * sqrt(252.0) AS sharpe, (max(capital) - arg_max(capital, date)) / max(capital) * 100 AS drawdown_pct, avg((daily_return_pct > 0)::INT) * 100 AS win_rate FROM alpha_p WHERE date <= DATE '2001-11-30' GROUP BY 1""", "period_return mtd_return sharpe drawdown_pct win_rate")
def _(p):
    a = alpha_panel(p).where(C("date") <= d_("2001-11-30"))
    mtd = F.min_by(F.when(C("date") >= F.trunc(d_("2001-11-30"), "month"), C("capital")), F.when(C("date") >= F.trunc(d_("2001-11-30"), "month"), C("date")))
    return a.groupBy("portfolio").agg(
        F.max_by("daily_return_pct", "date").alias("period_return"),
        (F.max_by("capital", "date") / mtd - 1).alias("mtd_return"),
        (F.avg("daily_return_pct") / F.stddev_samp("daily_return_pct") * 252**0.5).alias("sharpe"),
        ((F.max("capital") - F.max_by("capital", "date")) / F.max("capital") * 100).alias("drawdown_pct"),
        (F.avg((C("daily_return_pct") > 0).cast("int")) * 100).alias("win_rate"),
    )


@plan("j30_alpha_delta", "SELECT portfolio, arg_max(capital, date) / arg_min(capital, date) - 1 AS period_return, arg_max(alpha_cum_pct, date) - arg_min(alpha_cum_pct, date) AS alpha_delta FROM alpha_p WHERE date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' GROUP BY 1", "period_return alpha_delta")
def _(p):
    a = alpha_panel(p).where(C("date").between(d_("1998-01-01"), d_("1998-12-31")))
    return a.groupBy("portfolio").agg((F.max_by("capital", "date") / F.min_by("capital", "date") - 1).alias("period_return"), (F.max_by("alpha_cum_pct", "date") - F.min_by("alpha_cum_pct", "date")).alias("alpha_delta"))


# -- strategies ---------------------------------------------------------------------------------


def signals(p):
    """(symbol, strategy, date, close, signal) of all rule-based strategies."""
    b = ind.bollinger(ind.macd(ind.rsi(p.closes())))
    outs = {"sma_cross": ind.signal_sma_cross(b), "rsi_threshold": ind.signal_rsi(b), "bb_breakout": ind.signal_bands(b), "macd_cross": ind.signal_macd(b), "buy_hold": ind.signal_buy_hold(b)}
    u = None
    for name, d in outs.items():
        d = d.select("symbol", F.lit(name).alias("strategy"), "date", "close", "signal")
        u = d if u is None else u.unionByName(d)
    return u


cte("sigs_p", " UNION ALL ".join(f"SELECT symbol, '{n}' AS strategy, date, signal FROM {t}" for n, t in {"sma_cross": "sig_sma", "rsi_threshold": "sig_rsi", "bb_breakout": "sig_bb", "macd_cross": "sig_macd", "buy_hold": "sig_bh"}.items()))


def trade_sql(src, key):
    return f"""SELECT {key}, fill_date AS entry_date, fill_price AS entry_price, xd AS exit_date, xp AS exit_price, xp / fill_price - 1 AS return_pct FROM (
      SELECT *, coalesce(lead(fill_date) OVER w, lastd) AS xd, coalesce(lead(fill_price) OVER w, lastc) AS xp FROM (SELECT *, lag(signal) OVER (PARTITION BY {key} ORDER BY date) AS ps FROM (
        SELECT s.*, lead(date) OVER v AS fill_date, lead(close) OVER v AS fill_price, max(date) OVER (PARTITION BY {key}) AS lastd, last_value(close) OVER (PARTITION BY {key} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lastc FROM {src} s WINDOW v AS (PARTITION BY {key} ORDER BY date))
        WHERE signal <> 0 AND fill_date IS NOT NULL) WHERE ps IS NULL OR ps <> signal WINDOW w AS (PARTITION BY {key} ORDER BY date)) WHERE signal > 0"""


def summ_sql(src, key):
    return f"""SELECT {key}, count(*) AS n_trades, arg_max(eq, entry_date) - 1 AS total_return, avg((return_pct > 0)::INT) AS win_rate, avg(return_pct) AS avg_return, max(1 - eq / greatest(pk, 1.0)) AS max_drawdown, avg(return_pct) / CASE WHEN stddev_pop(return_pct) > 1e-10 THEN stddev_pop(return_pct) END AS sharpe FROM (
      SELECT *, max(eq) OVER (PARTITION BY {key} ORDER BY entry_date) AS pk FROM (SELECT *, product(1 + return_pct) OVER (PARTITION BY {key} ORDER BY entry_date) AS eq FROM {src})) GROUP BY ALL"""


cte("sigc_p", "SELECT s.*, close FROM sigs_p s JOIN bars_p b ON b.symbol = s.symbol AND b.date = s.date".replace("SELECT s.*", "SELECT s.symbol, s.strategy, s.date, s.signal"))
cte("strades_p", trade_sql("sigc_p", "symbol, strategy"))
cte("ssum_p", summ_sql("strades_p", "symbol, strategy"))
TR_ = "total_return:4 win_rate avg_return max_drawdown sharpe"


@plan("k20_signal_trades", "SELECT * FROM strades_p WHERE strategy = 'sma_cross'", "entry_price exit_price return_pct")
def _(p):
    d = ind.signal_sma_cross(p.closes()).select("symbol", F.lit("sma_cross").alias("strategy"), "date", "close", "signal")
    return rk.pair_trades(d, ["symbol", "strategy"])


@plan("k27_strategy_rank", "SELECT symbol, strategy, n_trades, total_return, win_rate, avg_return, max_drawdown, sharpe FROM ssum_p", TR_)
def _(p):
    return rk.trade_summary(rk.pair_trades(signals(p), ["symbol", "strategy"]), ["symbol", "strategy"])


@plan("f15_strategy_leaderboard", "SELECT symbol, strategy, n_trades, sharpe, row_number() OVER (ORDER BY s DESC NULLS LAST, symbol || strategy) AS rank FROM (SELECT *, round(sharpe, 9) AS s FROM ssum_p WHERE n_trades >= 3)", "sharpe")
def _(p):
    d = rk.trade_summary(rk.pair_trades(signals(p), ["symbol", "strategy"]), ["symbol", "strategy"])
    d = d.withColumn("id", F.concat(C("symbol").cast("string"), "strategy"))
    d = d.where(C("n_trades") >= 3).withColumns({"_g": F.lit(1), "_m": F.round("sharpe", 9)})
    return p.pool.row_rank(d, "_g", "_m", "rank", tie="id").select("symbol", "strategy", "n_trades", "sharpe", "rank")


@plan("k21_walk_forward", """SELECT symbol, fold, part, count(*) AS n_trades, avg(return_pct) AS avg_return, avg((return_pct > 0)::INT) AS win_rate FROM (SELECT symbol, k, f AS fold, CASE WHEN k - f * 40 < 120 THEN 'train' ELSE 'test' END AS part, date FROM (SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS k FROM bars_p) b JOIN range(20) t(f) ON k - f * 40 BETWEEN 0 AND 159) b
   JOIN (SELECT symbol AS s, entry_date, return_pct FROM strades_p WHERE strategy = 'macd_cross') x ON s = b.symbol AND entry_date = b.date GROUP BY 1, 2, 3""", "avg_return win_rate")
def _(p):
    c = p.closes()
    t = rk.pair_trades(ind.signal_macd(ind.macd(c)), "symbol").select("symbol", C("entry_date").alias("date"), "return_pct")
    d = rk.folds(c, 120, 40, 40).join(t, ["symbol", "date"])
    return d.groupBy("symbol", "fold", "part").agg(F.count(F.lit(1)).alias("n_trades"), F.avg("return_pct").alias("avg_return"), F.avg((C("return_pct") > 0).cast("int")).alias("win_rate"))


GRID = [(f, s) for f in (3, 5, 10) for s in (20, 40)]
MA = lambda n: f"CASE WHEN count(close) OVER (PARTITION BY symbol ORDER BY date ROWS {n - 1} PRECEDING) >= {n} THEN avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS {n - 1} PRECEDING) END"
cte("gma_p", "SELECT symbol, date, close, " + ", ".join(f"{MA(n)} AS m{n}" for n in (3, 5, 10, 20, 40)) + " FROM bars_p")
cte("gsig_p", " UNION ALL ".join(f"SELECT symbol, '{f}/{s}' AS params, date, close, (CASE WHEN p <= 0 AND d > 0 THEN 1 WHEN p >= 0 AND d < 0 THEN -1 ELSE 0 END)::BIGINT AS signal FROM (SELECT *, m{f} - m{s} AS d, lag(m{f} - m{s}) OVER (PARTITION BY symbol ORDER BY date) AS p FROM gma_p)" for f, s in GRID))
cte("gtr_p", trade_sql("gsig_p", "symbol, params"))
cte("gsum_p", summ_sql("gtr_p", "symbol, params"))


@plan("k23_parameter_grid", "SELECT symbol, params, n_trades, sharpe, row_number() OVER (PARTITION BY symbol ORDER BY round(sharpe, 9) DESC NULLS LAST, params) AS rank FROM gsum_p", "sharpe")
def _(p):
    b = p.closes()
    d = ind.sma(b, 3, 5, 10, 20, 40)
    rows = F.array(*[F.struct(F.lit(f"{f}/{s}").alias("params"), (C(f"sma_{f}") - C(f"sma_{s}")).alias("d")) for f, s in GRID])
    d = d.select("symbol", "date", "close", F.explode(rows).alias("g")).select("symbol", "date", "close", "g.*")
    w = Window.partitionBy("symbol", "params").orderBy("date")
    pr = F.lag("d").over(w)
    d = d.withColumn("signal", F.when((pr <= 0) & (C("d") > 0), 1).when((pr >= 0) & (C("d") < 0), -1).otherwise(0))
    s = rk.trade_summary(rk.pair_trades(d, ["symbol", "params"]), ["symbol", "params"])
    o = Window.partitionBy("symbol").orderBy(F.round("sharpe", 9).desc_nulls_last(), "params")
    return s.withColumn("rank", F.row_number().over(o)).select("symbol", "params", "n_trades", "sharpe", "rank")


@plan("k18_benchmark_buy_hold", """SELECT symbol, n, dividends, (z * k * (1 - 0.001425 - 0.003) + dividends) / (a * 1.001425) - 1 AS buy_hold_return FROM (SELECT symbol, count(*) AS n, arg_min(close, date) AS a, arg_max(close, date) AS z, arg_max(sh, date) AS k, sum(c * coalesce(ps, 1)) AS dividends FROM (
   SELECT *, lag(sh) OVER (PARTITION BY symbol ORDER BY date) AS ps FROM (SELECT *, product(f) OVER (PARTITION BY symbol ORDER BY date) AS sh FROM (SELECT b.symbol, b.date, b.close, CASE WHEN b.pc IS NULL THEN 1 ELSE 1 + coalesce(stock, 0) / 10 END AS f, CASE WHEN b.pc IS NULL THEN 0 ELSE coalesce(cash, 0) END AS c FROM moves_p b LEFT JOIN divw_p d ON d.symbol = b.symbol AND d.date = b.date))) GROUP BY 1)""", "dividends:4 buy_hold_return")
def _(p):
    ev = dividend_events(p).groupBy("symbol", "date").agg(F.sum("cash").alias("cash"), F.sum("stock").alias("stock"))
    return rk.buy_hold(p.closes(), ev)


@plan("k19_survivorship_bias", "SELECT symbol, count(*) AS n, count(*) < 0.7 * datediff('day', (SELECT min(date) FROM bars_p), (SELECT max(date) FROM bars_p)) / 7 * 1.1 AS suspicious FROM bars_p GROUP BY 1")
def _(p):
    c = p.closes()
    lo, hi = p.lines().agg(F.min("week")).scalar(), p.lines().agg(F.max("week")).scalar()
    g = c.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("suspicious", C("n") < F.datediff(hi, lo) / 7 * 0.7 * 1.1)


@plan("k22_portfolio_weights", "SELECT date, mode, symbol, 1.0 / count(*) OVER w AS equal_weight, least(composite_score / sum(composite_score) OVER w, 0.06) AS custom_weight FROM picks_p WINDOW w AS (PARTITION BY date, mode)", "equal_weight custom_weight")
def _(p):
    w = Window.partitionBy("date", "mode")  # at most the Top-N per scan
    d = rec.picks(p)
    return d.select("date", "mode", "symbol", (1 / F.count(F.lit(1)).over(w)).alias("equal_weight"), F.least(C("composite_score") / F.sum("composite_score").over(w), F.lit(0.06)).alias("custom_weight"))


@plan("k29_alert_signals", """SELECT 'regime' AS kind, regime AS name, b AS value FROM regime_p WHERE date = (SELECT max(date) FROM regime_p) UNION ALL SELECT 'breadth', CASE WHEN b > 0.6 THEN 'weak' ELSE 'ok' END, b FROM regime_p WHERE date = (SELECT max(date) FROM regime_p) UNION ALL SELECT 'ic', mode || ':' || reason, ic FROM verd_p""", "value")
def _(p):
    r = fl.last_date(regimes(p).select("date", "regime", "breadth_below_ma20_pct"))
    b = C("breadth_below_ma20_pct")
    rows = F.array(
        F.struct(F.lit("regime").alias("kind"), C("regime").alias("name"), b.alias("value")),
        F.struct(F.lit("breadth").alias("kind"), F.when(b > 0.6, "weak").otherwise("ok").alias("name"), b.alias("value")),
    )
    a = r.select(F.explode(rows).alias("x")).select("x.*")
    v = verdicts(p).select(F.lit("ic").alias("kind"), F.concat("mode", F.lit(":"), "reason").alias("name"), C("ic").alias("value"))
    return a.unionByName(v)


# -- C: as-of and calendar joins -------------------------------------------------------------------


def probes(p):
    return p.trades().select("trade_id", "symbol", C("entry_date").alias("d"))


@plan("c03_prices_on_date", "SELECT trade_id, CASE WHEN datediff('day', b.date, t.d) <= 5 THEN b.close END AS close FROM (SELECT trade_id, symbol, entry_date AS d FROM trades_p) t ASOF LEFT JOIN bars_d b ON b.symbol = t.symbol AND b.date <= t.d", "close")
def _(p):
    return asof(probes(p), p.bars_daily(), on="symbol", probe_date="d", fact_date="date", values=["close"], tolerance_days=5).select("trade_id", "close")


@plan("c04_ohlcv_on_date", "SELECT trade_id, o AS open, h AS high, c AS close, CASE WHEN bd = d THEN v WHEN bd IS NOT NULL THEN 0 END AS volume FROM (SELECT trade_id, d, CASE WHEN ok THEN b.date END AS bd, CASE WHEN ok THEN open END AS o, CASE WHEN ok THEN high END AS h, CASE WHEN ok THEN close END AS c, volume AS v FROM (SELECT trade_id, symbol, entry_date AS d FROM trades_p) t ASOF LEFT JOIN (SELECT *, true AS dummy FROM bars_d) b ON b.symbol = t.symbol AND b.date <= t.d, LATERAL (SELECT coalesce(datediff('day', b.date, t.d) <= 5, false) AS ok))", "open high close volume")
def _(p):
    d = asof(probes(p), p.bars_daily(), on="symbol", probe_date="d", fact_date="date", values=["open", "high", "close", "volume"], tolerance_days=5, matched="bd")
    return d.select("trade_id", "open", "high", "close", F.when(C("bd") < C("d"), 0.0).otherwise(C("volume")).alias("volume"))


@plan("c05_benchmark_close_asof", "SELECT trade_id, CASE WHEN datediff('day', b.date, t.d) <= 7 THEN b.close END AS bm FROM (SELECT trade_id, exit_date AS d FROM trades_p) t ASOF LEFT JOIN index_p b ON b.date <= t.d", "bm")
def _(p):
    # distinct dates first: the index is one series, so probes collapse to one row per date
    t = p.trades().select("trade_id", C("exit_date").alias("d"))
    days = t.select("d").distinct().withColumn("market", F.lit("ALL"))
    b = asof(days, p.index(), on="market", probe_date="d", fact_date="date", values=["close"], tolerance_days=7)
    return t.join(b, "d").select("trade_id", C("close").alias("bm"))


@plan("c07_benchmark_dividends_between", "SELECT trade_id, coalesce(sum(amount), 0) AS dividends FROM trades_p t LEFT JOIN bdiv_p d ON d.date > t.entry_date AND d.date <= t.exit_date GROUP BY 1", "dividends")
def _(p):
    t = p.trades().select("trade_id", "entry_date", "exit_date")
    days = t.select(C("entry_date").alias("d")).unionByName(t.select(C("exit_date").alias("d"))).distinct()
    u = days.select("d", F.lit(0.0).alias("amount")).unionByName(bench_dividends(p).select(C("date").alias("d"), "amount")).groupBy("d").agg(F.sum("amount").alias("amount"))
    w = Window.partitionBy(F.lit(0)).orderBy("d").rowsBetween(Window.unboundedPreceding, 0)  # one row per date
    c = u.select("d", F.sum("amount").over(w).alias("cum"))
    a, b = c.select(C("d").alias("entry_date"), C("cum").alias("c0")), c.select(C("d").alias("exit_date"), C("cum").alias("c1"))
    return t.join(a, "entry_date").join(b, "exit_date").select("trade_id", (C("c1") - C("c0")).alias("dividends"))


@plan("c08_snapshot_on_or_after", "SELECT t.portfolio, t.d, s.date AS snapshot_date, s.capital FROM (SELECT DISTINCT portfolio, entry_date AS d FROM trades_p) t ASOF LEFT JOIN snapshots_p s ON s.portfolio = t.portfolio AND s.date >= t.d", "capital:3")
def _(p):
    q = p.trades().select("portfolio", C("entry_date").alias("d")).distinct()
    return asof(q, p.snapshots(), on="portfolio", probe_date="d", fact_date="date", values=["capital"], forward=True, matched="snapshot_date").select("portfolio", "d", "snapshot_date", "capital")


@plan("c09_snapshot_on_or_before", "SELECT t.portfolio, t.d, s.date AS snapshot_date, s.capital FROM (SELECT DISTINCT portfolio, entry_date AS d FROM trades_p) t ASOF LEFT JOIN snapshots_p s ON s.portfolio = t.portfolio AND s.date <= t.d", "capital:3")
def _(p):
    q = p.trades().select("portfolio", C("entry_date").alias("d")).distinct()
    return asof(q, p.snapshots(), on="portfolio", probe_date="d", fact_date="date", values=["capital"], matched="snapshot_date").select("portfolio", "d", "snapshot_date", "capital")


@plan("c10_benchmark_divergence", """SELECT portfolio, least(abs((e1 / s1 - 1) * 100 - pp), abs((e1 / s0 - 1) * 100 - pp), abs((e0 / s1 - 1) * 100 - pp), abs((e0 / s0 - 1) * 100 - pp)) AS divergence FROM (SELECT portfolio, pp, s1.close AS s1, s0.close AS s0, e1.close AS e1, e0.close AS e0 FROM (SELECT portfolio, min(date) AS a, max(date) AS z, (arg_max(capital, date) / arg_min(capital, date) - 1) * 100 AS pp FROM snapshots_p WHERE date >= DATE '1996-01-01' GROUP BY 1) x
   ASOF JOIN index_d s1 ON s1.date <= x.a ASOF JOIN index_d s0 ON s0.date < x.a ASOF JOIN index_d e1 ON e1.date <= x.z ASOF JOIN index_d e0 ON e0.date < x.z)""", "divergence")
def _(p):
    s = p.snapshots().where(C("date") >= d_("1996-01-01")).groupBy("portfolio").agg(F.min("date").alias("a"), F.max("date").alias("z"), ((F.max_by("capital", "date") / F.min_by("capital", "date") - 1) * 100).alias("pp")).withColumn("market", F.lit("ALL"))
    for col, exact, out in (("a", True, "s1"), ("a", False, "s0"), ("z", True, "e1"), ("z", False, "e0")):
        s = asof(s, p.index("day").withColumnRenamed("close", out), on="market", probe_date=col, fact_date="date", values=[out], allow_exact=exact)
    g = [F.abs((C(e) / C(b) - 1) * 100 - C("pp")) for b in ("s1", "s0") for e in ("e1", "e0")]
    return s.select("portfolio", F.least(*g).alias("divergence"))


cte("cald_p", "SELECT day AS date, row_number() OVER (ORDER BY day) AS o FROM (SELECT DISTINCT day FROM lines_p)")


def day_calendar(p):
    return ordinals(p.lines().select(C("day").alias("date")).distinct())


@plan("c11_trading_calendar", "SELECT date, o AS ordinal FROM cald_p")
def _(p):
    return day_calendar(p)


def calendar_ordinal(p, col, out):
    """Ordinal of the last trading date at or before each date (equi-join, no range join)."""
    days = p.trades().select(C(col).alias("d")).distinct().withColumn("k", F.lit(1))
    c = day_calendar(p).withColumn("k", F.lit(1))
    return asof(days, c, on="k", probe_date="d", fact_date="date", values=["ordinal"]).select(C("d").alias(col), F.coalesce("ordinal", F.lit(0)).alias(out))


@plan("c12_trading_days_held", "SELECT trade_id, coalesce(b.o, 0) - coalesce(a.o, 0) AS days_held FROM trades_p t ASOF LEFT JOIN cald_p a ON a.date <= t.entry_date ASOF LEFT JOIN cald_p b ON b.date <= t.exit_date")
def _(p):
    t = p.trades().select("trade_id", "entry_date", "exit_date")
    t = t.join(calendar_ordinal(p, "entry_date", "a"), "entry_date").join(calendar_ordinal(p, "exit_date", "b"), "exit_date")
    return t.select("trade_id", (C("b") - C("a")).alias("days_held"))


@plan("c13_planned_exit_date", """SELECT trade_id, coalesce(x.date, mx.d + (ceil((a.o + 40 - mx.o) * 7 / 5.0))::INT) AS planned_exit FROM (SELECT trade_id, entry_date FROM trades_p) t ASOF LEFT JOIN cald_p a ON a.date >= t.entry_date LEFT JOIN cald_p x ON x.o = a.o + 40, (SELECT max(date) AS d, max(o) AS o FROM cald_p) mx WHERE a.o IS NOT NULL""")
def _(p):
    cal = day_calendar(p)
    days = p.trades().select(C("entry_date").alias("d")).distinct().withColumn("k", F.lit(1))
    a = asof(days, cal.withColumn("k", F.lit(1)), on="k", probe_date="d", fact_date="date", values=["ordinal"], forward=True).where(C("ordinal").isNotNull())
    a = a.select(C("d").alias("entry_date"), (C("ordinal") + 40).alias("target"))
    mo, md = cal.agg(F.max("ordinal")).scalar(), cal.agg(F.max("date")).scalar()
    a = a.join(cal.select(C("ordinal").alias("target"), "date"), "target", "left")
    out = F.coalesce("date", F.date_add(md, F.ceil((C("target") - mo) * 7 / 5.0).cast("int")))
    return p.trades().select("trade_id", "entry_date").join(a.select("entry_date", out.alias("planned_exit")), "entry_date").select("trade_id", "planned_exit")


cte("brk_ext", """SELECT b.symbol, b.date, b.broker, buy, sell, coalesce(buy_price, close) AS buy_price, coalesce(sell_price, close) AS sell_price, count(*) OVER (PARTITION BY b.symbol) AS rows_, d.nd FROM brokers_p b JOIN bars_p x ON x.symbol = b.symbol AND x.date = b.date JOIN (SELECT symbol, count(DISTINCT date) AS nd FROM brokers_p GROUP BY 1) d ON d.symbol = b.symbol""")


@plan("c14_broker_data_extended", "SELECT symbol, date, broker, buy, sell, buy_price, sell_price FROM brk_ext WHERE nd >= 20 AND date >= (SELECT max(date) FROM brokers_p) - INTERVAL 365 DAY", "buy_price sell_price")
def _(p):
    b = p.brokers()
    d = b.join(p.closes().select("symbol", "date", "close"), ["symbol", "date"])
    ok = b.groupBy("symbol").agg(F.countDistinct("date").alias("nd")).where(C("nd") >= 20)
    d = fl.last_window(d.join(ok, "symbol", "left_semi"), 365)
    return d.select("symbol", "date", "broker", "buy", "sell", F.coalesce("buy_price", "close").alias("buy_price"), F.coalesce("sell_price", "close").alias("sell_price"))


@plan("c19_dividend_events", "SELECT symbol, date AS ex_date, cash, stock FROM divs_p WHERE (cash > 0 OR stock > 0) AND date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'", "cash stock")
def _(p):
    d = dividend_events(p).where((C("cash") > 0) | (C("stock") > 0))
    return d.where(C("date").between(d_("1997-01-01"), d_("1999-12-31"))).withColumnRenamed("date", "ex_date")


@plan("c20_latest_rankings", "SELECT s.mode, d.date, s.scan AS ranking_date FROM (SELECT DISTINCT week AS date, unnest(['momentum', 'swing']) AS mode FROM lines_p) d ASOF JOIN (SELECT DISTINCT mode, date AS scan FROM picks_p) s ON s.mode = d.mode AND s.scan < d.date WHERE datediff('day', s.scan, d.date) <= 21")
def _(p):
    s = rec.picks(p).select("mode", C("date").alias("scan")).distinct().withColumn("ranking_date", C("scan"))
    q = p.lines().select(C("week").alias("date")).distinct().withColumn("mode", F.explode(F.array(F.lit("momentum"), F.lit("swing"))))
    d = asof(q, s, on="mode", probe_date="date", fact_date="scan", values=["ranking_date"], allow_exact=False, tolerance_days=21)
    return d.where(C("ranking_date").isNotNull()).select("mode", "date", "ranking_date")


@plan("c21_announcement_window", "SELECT symbol, count(*) FILTER (age <= 10) AS recent, count(*) FILTER (age > 10) AS baseline FROM (SELECT symbol, datediff('day', date, DATE '2024-01-25') AS age FROM ann_p WHERE date <= DATE '2024-01-25') WHERE age <= 180 GROUP BY 1")
def _(p):
    a = p.announcements().where(C("date") <= d_("2024-01-25")).withColumn("age", F.datediff(d_("2024-01-25"), "date"))
    return a.where(C("age") <= 180).groupBy("symbol").agg(F.count_if(C("age") <= 10).alias("recent"), F.count_if(C("age") > 10).alias("baseline"))


def ranged(name, frame, days, cols, key="symbol, date"):
    names = ", ".join(c.split(":")[0] for c in cols.split())

    @plan(name, f"SELECT DISTINCT s.date AS scan_date, f.{', f.'.join(k.strip() for k in key.split(','))}, {names} FROM scan_p s JOIN {frame[0]} f ON f.date BETWEEN s.date - INTERVAL {days} DAY AND s.date", cols)
    def _(p):
        """Rows of the days before each scan: a row joins the scans of its month and the next by equality."""
        scan = p.scan_dates().select(C("date").alias("scan_date")).withColumn("m", F.trunc("scan_date", "month"))
        f = frame[1](p).withColumn("m", F.explode(F.array(*[F.add_months(F.trunc("date", "month"), i) for i in range(days // 28 + 2)])))
        d = f.join(scan, "m").where((C("date") <= C("scan_date")) & (C("date") >= F.date_sub("scan_date", days)))
        return d.select("scan_date", *[k.strip() for k in key.split(",")], *names.split(", "))


ranged("c22_broker_data_window", ("brokers_p", lambda p: p.brokers()), 7, "buy sell", "symbol, date, broker")
ranged("c23_sbl_data_window", ("lending_p", lambda p: p.lending()), 14, "sbl_balance sbl_change")
ranged("c24_holding_data_window", ("holding_p", lambda p: p.holding()), 60, "percent", "symbol, date, level")
