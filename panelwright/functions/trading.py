"""Trading arithmetic: costs, slippage, position size, stops, timing labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import col, lookup

# Market cost model.
COMMISSION_RATE = 0.001425
TAX_RATE = 0.003
SLIPPAGE_RATE = 0.0005
LOT_SIZE = 1000
MIN_COMMISSION_LOT = 20.0
MIN_COMMISSION_ODD = 1.0
ODD_LOT_PREMIUM = 0.001
PARTICIPATION_COEFF = 0.01
IMPACT_COEFF = 0.5
SLIPPAGE_MAX = 0.01
SPREAD_WEIGHT = 0.5
SELL_MULTIPLIER = 1.3
PARTICIPATION_LIMIT = 0.05
LIMIT_THRESHOLD = 0.095

# Stop and target multiples of ATR, and percent fall-backs, by regime.
ATR_STOP = {"bull": 1.5, "sideways": 1.5, "bear": 1.2, "crisis": 1.0}
ATR_TARGET = {"bull": 3.5, "sideways": 3.0, "bear": 2.5, "crisis": 1.8}
PCT_STOP = {"bull": 0.05, "sideways": 0.04, "bear": 0.03, "crisis": 0.02}
PCT_TARGET = {"bull": 0.10, "sideways": 0.08, "bear": 0.06, "crisis": 0.04}

# Texts shown to users.
TRIGGER_TEXT = {"above": "站上均線", "near": "貼近均線", "below": "均線下方，等待確認", "calm": "，低波動", "wild": "，高波動謹慎", "crisis": "｜⚠ 崩盤期建議降低部位規模"}
TIMING_TEXT = {
    "overbought": "謹慎觀望：RSI 超買，追高風險高",
    "rebound": "潛在反彈：RSI 超賣，留意止損",
    "falling": "下跌趨勢中超賣，等待企穩訊號",
    "crisis": "崩盤期：大幅減碼或暫停進場",
    "strong": "積極做多：動能強勁 + 趨勢向上",
    "trend": "順勢佈局：趨勢向上，動能待確認",
    "range": "區間上軌，注意壓力，設好止損",
    "bear": "空頭環境，建議觀望或嚴守止損",
    "wait": "等待訊號：尚未站上均線",
}


def split_lot_odd(shares, lot: int = LOT_SIZE) -> tuple[Column, Column]:
    """Shares in whole lots and the remainder."""
    s = col(shares)
    odd = F.pmod(s, F.lit(lot))
    return s - odd, odd


def trade_cost(price, shares, slippage, side: str = "buy") -> tuple[Column, Column, Column]:
    """(commission, tax, slippage cost); zeros for an empty trade."""
    p, s, sl = col(price), col(shares), slippage if isinstance(slippage, Column) else F.lit(float(slippage))
    lots, odd = split_lot_odd(s)
    live = (p > 0) & (s > 0)
    fee = lambda n, low: F.when(n > 0, F.greatest(p * n * COMMISSION_RATE, F.lit(low))).otherwise(0.0)
    commission = F.when(live, fee(lots, MIN_COMMISSION_LOT) + fee(odd, MIN_COMMISSION_ODD)).otherwise(0.0)
    tax = F.when(live, p * s * TAX_RATE).otherwise(0.0) if side == "sell" else F.lit(0.0)
    slip = F.when(live, p * s * sl + p * odd * ODD_LOT_PREMIUM).otherwise(0.0)
    return commission, tax, slip


def total_cost(price, shares, slippage, side: str = "buy") -> Column:
    a, b, c = trade_cost(price, shares, slippage, side)
    return a + b + c


def position_pnl(entry, exit_, shares, buy_slip=SLIPPAGE_RATE, sell_slip=SLIPPAGE_RATE) -> tuple[Column, Column]:
    """Profit after both legs' cost, and its share of the money paid."""
    paid = col(entry) * col(shares) + total_cost(entry, shares, buy_slip, "buy")
    got = col(exit_) * col(shares) - total_cost(exit_, shares, sell_slip, "sell")
    pnl = got - paid
    return pnl, F.coalesce(pnl / F.when(paid > 0, paid), F.lit(0.0))


def liquidity_limit(shares, volume, limit: float = PARTICIPATION_LIMIT) -> Column:
    """At most ``limit`` of the volume."""
    s, v = col(shares), col(volume)
    return F.when(v.isNull(), s).when(v <= 0, F.lit(0)).otherwise(F.least(s, F.floor(v * limit)))


def affordable_shares(capital, price, volume=None, slippage: float = SLIPPAGE_RATE) -> Column:
    """Largest share count whose full cost fits the capital.

    The estimate without minimum fees is an upper bound.  Its excess cost is a few fees, so the
    answer lies within excess / price shares below it, plus a slack for one lot boundary.
    """
    k, p = col(capital), col(price)
    top = F.floor(k / F.when(p > 0, p * (1 + COMMISSION_RATE + slippage)))
    if volume is not None:
        top = liquidity_limit(top, volume)
    over = F.greatest(p * top + total_cost(p, top, slippage) - k, F.lit(0.0))
    low = F.greatest(top - F.ceil((over + 25.0) / p) - 2, F.lit(0).cast("long"))
    fits = F.filter(F.sequence(low, top), lambda n: p * n + total_cost(p, n, slippage) <= k)
    return F.when(p > 0, F.coalesce(F.array_max(fits), F.lit(0))).otherwise(0).cast("long")


def dynamic_slippage(volume, high, low, close, side: str = "buy", order_shares=None) -> Column:
    """Impact of thin volume, spread proxy and participation, capped."""
    v, h, lo, c = col(volume), col(high), col(low), col(close)
    impact = SLIPPAGE_RATE + IMPACT_COEFF / F.sqrt(F.when(v > 0, v))
    impact = F.when((c > 0) & (h > lo), F.greatest(impact, (h - lo) / F.when(c > 0, c) * SPREAD_WEIGHT)).otherwise(impact)
    if order_shares is not None:
        o = col(order_shares)
        part = PARTICIPATION_COEFF * F.sqrt(F.least(o / F.when(v > 0, v), F.lit(1.0)))
        impact = impact + F.when(o > 0, part).otherwise(0.0)
    base = F.when(v > 0, F.least(impact, F.lit(SLIPPAGE_MAX))).otherwise(SLIPPAGE_RATE)
    return F.least(base * SELL_MULTIPLIER, F.lit(SLIPPAGE_MAX)) if side == "sell" else base


def limit_flags(open_, prev_close, threshold: float = LIMIT_THRESHOLD) -> tuple[Column, Column]:
    """Open at the upper / lower price limit."""
    p = col(prev_close)
    ch = (col(open_) - p) / F.when(p > 0, p)
    f = F.lit(False)
    return F.coalesce(ch >= threshold, f), F.coalesce(ch <= -threshold, f)


def dividend_factor(prev_close, cash, stock) -> Column:
    """Ex-date price factor, NULL outside (0, 1.5)."""
    p = col(prev_close)
    f = (p - col(cash)) / F.when(p > 0, p) / (1 + F.greatest(col(stock), F.lit(0.0)) / 10)
    return F.when((f > 0) & (f < 1.5), f)


def adjusted_stop(stop, prev_close, cash, stock) -> Column:
    """H21."""
    return F.coalesce(col(stop) * dividend_factor(prev_close, cash, stock), col(stop))


def dividend_cash(shares, cash) -> Column:
    """H22."""
    s, c = col(shares), col(cash)
    return F.when((s > 0) & (c > 0), s * c).otherwise(0.0)


def atr_stops(close, atr, regime) -> tuple[Column, Column]:
    """Stop and target by regime; percent fall-back without an ATR."""
    c, a, g = col(close), col(atr), col(regime)
    pick = lambda t: lookup(g, t, t["sideways"])
    stop = F.when(a > 0, c - pick(ATR_STOP) * a).otherwise(c * (1 - pick(PCT_STOP)))
    target = F.when(a > 0, c + pick(ATR_TARGET) * a).otherwise(c * (1 + pick(PCT_TARGET)))
    return F.when(c > 0, stop), F.when(c > 0, target)


def entry_trigger(close, sma20, atr_pct, regime) -> Column:
    """Distance to the mean plus volatility remark."""
    c, m, a, t = col(close), col(sma20), col(atr_pct), TRIGGER_TEXT
    where = F.when((m > 0) & (c > m * 1.01), t["above"]).when((m > 0) & (c >= m * 0.99), t["near"]).otherwise(t["below"])
    vol = F.when(a < 0.02, t["calm"]).when(a > 0.04, t["wild"]).otherwise("")
    return F.concat(where, vol, F.when(col(regime) == "crisis", t["crisis"]).otherwise(""))


def assess_timing(rsi, close, sma20, atr_pct, regime) -> Column:
    """Decision table over RSI, mean and regime."""
    r, m, a, g, t = col(rsi), col(sma20), col(atr_pct), col(regime), TIMING_TEXT
    above = F.coalesce((m > 0) & (col(close) > m * 1.005), F.lit(False))
    say = (
        F.when(r >= 70, t["overbought"])
        .when((r <= 30) & g.isin("bull", "sideways"), t["rebound"])
        .when(r <= 30, t["falling"])
        .when(g == "crisis", t["crisis"])
        .when(above & (g == "bull") & (r >= 55), t["strong"])
        .when(above & (g == "bull"), t["trend"])
        .when(above & (g == "sideways"), t["range"])
        .when(g == "bear", t["bear"])
        .otherwise(t["wait"])
    )
    return F.concat(say, F.when(a < 0.015, TRIGGER_TEXT["calm"]).when(a > 0.04, TRIGGER_TEXT["wild"]).otherwise(""))


def trailing_stop(highest, atr, multiplier: float) -> Column:
    """H26."""
    return col(highest) - col(atr) * multiplier


def benchmark_alpha(today, prev, base, cum_return, div_prev=0.0, div_base=0.0) -> dict[str, Column]:
    """Period and cumulative benchmark return including dividends, and alpha."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    t, p, b = col(today), col(prev), col(base)
    cum = (t + lit(div_base) - b) / F.when(b > 0, b)
    return {
        "benchmark_return_pct": (t + lit(div_prev) - p) / F.when(p > 0, p),
        "benchmark_cum_return_pct": cum,
        "alpha_cum_pct": col(cum_return) - cum,
    }


def watch_status(stop, target, valid_until, latest, today) -> Column:
    """Stop first, then target, then expiry."""
    return (
        F.when(col(latest) <= col(stop), "stopped_loss")
        .when(col(latest) >= col(target), "taken_profit")
        .when(col(today) > col(valid_until), "expired")
        .otherwise("active")
    )


def judge_block(blocked: Column, n, avg_return, win_rate, *, min_samples: int = 30) -> Column:
    """Keep, lift or add a (regime, mode) block."""
    r, w = col(avg_return), col(win_rate)
    return (
        F.when(col(n).isNull() | (col(n) < min_samples), "insufficient_data")
        .when(blocked & (r > 0.02) & (w > 0.55), "lift_block")
        .when(~blocked & (r < -0.03) & (w < 0.35), "add_block")
        .otherwise("keep")
    )


def holdout_severity(start, end, holdout: Column) -> tuple[Column, Column, Column]:
    """(severity, in-sample days, holdout days) of a date range."""
    s, e = col(start), col(end)
    none = s.isNull() | e.isNull()
    sev = F.when(none, "no_range").when(e < holdout, "ok").when(s >= holdout, "forward").otherwise("partial")
    ins = F.when(none | (s >= holdout), 0).when(e < holdout, F.datediff(e, s) + 1).otherwise(F.datediff(holdout, s))
    out = F.when(none | (e < holdout), 0).when(s >= holdout, F.datediff(e, s) + 1).otherwise(F.datediff(e, holdout) + 1)
    return sev, ins.cast("long"), out.cast("long")


def impact_level(rho) -> Column:
    """H37 (fixed labels)."""
    r = col(rho)
    return F.when(r < 0.5, "極高").when(r < 0.85, "高").when(r < 0.95, "中").otherwise("低")


def ic_level(reason, ic) -> Column:
    """H38."""
    i = col(ic)
    return (
        F.when(col(reason) != "ok", col(reason))
        .when(i.isNull(), "no_windows")
        .when(i < -0.05, "inverse")
        .when(i < 0.05, "weak")
        .when(i < 0.1, "decay")
        .otherwise("normal")
    )
