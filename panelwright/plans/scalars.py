"""H: scalar functions, evaluated over whole tables."""

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import text as tx
from ..functions import trading as tr
from ..functions.exprs import lookup
from ..functions.timeseries import busdays
from ..operators import flows as fl
from ..operators import indicators as ind
from .ctes import cte
from .registry import plan

# English rules for the synthetic documents (the defaults are the published tables)
NEG_CTX, POS_CTX, CLAR, NEG, POS = ["rights.{0,40}reserved"], ["free.{0,20}license"], ["mit license"], ["token", "apache"], ["license", "free"]
RULES = [("filing", ["license", "apache"]), ("governance_change", ["token"]), ("revenue", ["free"])]
TAGS = {"legal": ["License", "rights"], "software": ["apache", "token"], "free": ["free"]}


def any_sql(words):
    return "regexp_matches(text, '" + "|".join(words) + "')"


@plan("h01_classify_sentiment", f"""SELECT doc_id, (CASE WHEN text IS NULL OR text = '' THEN 0 WHEN {any_sql(NEG_CTX)} THEN -1 WHEN {any_sql(POS_CTX)} THEN 1 WHEN {any_sql(CLAR)} THEN 0
   WHEN {any_sql(NEG)} THEN -1 WHEN {any_sql(POS)} THEN 1 ELSE 0 END)::BIGINT AS sentiment FROM documents""")
def _(p):
    return p.table("documents").select("doc_id", tx.classify_sentiment("text", NEG_CTX, POS_CTX, CLAR, NEG, POS).alias("sentiment"))


@plan("h02_classify_event_type", f"""SELECT doc_id, CASE WHEN {any_sql(RULES[0][1])} THEN 'filing' WHEN {any_sql(RULES[1][1])} THEN 'governance_change' WHEN {any_sql(RULES[2][1])} THEN 'revenue' ELSE 'general' END AS event_type FROM documents""")
def _(p):
    return p.table("documents").select("doc_id", tx.classify_event_type("text", RULES).alias("event_type"))


@plan("h03_classify_concepts", """SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(lower(text), 'license|rights') THEN 'legal' END, CASE WHEN regexp_matches(lower(text), 'apache|token') THEN 'software' END,
   CASE WHEN regexp_matches(lower(text), 'free') THEN 'free' END], lambda x: x IS NOT NULL), ',') AS concepts FROM documents""")
def _(p):
    return p.table("documents").select("doc_id", F.array_join(tx.classify_concepts("text", TAGS), ",").alias("concepts"))


W = """exp(-CASE WHEN event_type IN ('governance_change', 'buyback') THEN 0.07 WHEN event_type IN ('revenue', 'general') THEN 0.15 ELSE 0.12 END * age)
  * CASE event_type WHEN 'governance_change' THEN 5.0 WHEN 'buyback' THEN 4.0 WHEN 'earnings_call' THEN 3.0 WHEN 'investor_day' THEN 2.0 WHEN 'filing' THEN 1.5 WHEN 'revenue' THEN 1.2 ELSE 1.0 END"""


@plan("h04_news_decay_weight", f"SELECT symbol, seq, {W} AS decay_weight FROM (SELECT *, greatest(0, datediff('day', date, DATE '2024-01-31')) AS age FROM ann_p)", "decay_weight")
def _(p):
    a = p.announcements()
    return a.select("symbol", "seq", tx.news_decay_weight(F.datediff(F.lit("2024-01-31").cast("date"), "date"), "event_type").alias("decay_weight"))


def holidays(p):
    """First day of every year stands in for the holiday table."""
    d = p.lines().select(F.trunc("day", "year").alias("date")).distinct()
    return d


def spine(p):
    return p.lines().agg(F.min("day").alias("lo"), F.max("day").alias("hi"))


def trading_days(p):
    return cal.trading_days("lo", "hi", spine(p), holidays(p))


cte("tdays_p", """SELECT d::DATE AS date FROM (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS d FROM lines_p)
  WHERE isodow(d) < 6 AND d NOT IN (SELECT DISTINCT date_trunc('year', day) FROM lines_p)""")


@plan("h05_is_trading_day", """SELECT date, isodow(date) < 6 AND NOT (month(date) = 1 AND day(date) = 1) AS is_trading FROM (SELECT DISTINCT day AS date FROM lines_p)""")
def _(p):
    d = p.lines().select(F.col("day").alias("date")).distinct()
    h = holidays(p).withColumn("_h", F.lit(True))
    return d.join(h, "date", "left").select("date", (cal.is_weekday("date") & F.col("_h").isNull()).alias("is_trading"))


@plan("h06_trading_days", "SELECT date FROM tdays_p")
def _(p):
    return trading_days(p)


cte("dates_p", "SELECT DISTINCT day AS d FROM lines_p")


def dates(p):
    return p.lines().select(F.col("day").alias("d")).distinct()


@plan("h07_revenue_visible_cutoff", "SELECT d, last_day(d - to_months(CASE WHEN day(d) >= 10 THEN 1 ELSE 2 END)) AS cutoff FROM dates_p")
def _(p):
    return dates(p).select("d", cal.revenue_visible_cutoff("d").alias("cutoff"))


cte("qends_p", """SELECT q, q + CASE WHEN month(q) = 12 THEN 90 ELSE 45 END AS due FROM (SELECT last_day((DATE '1993-03-01' + to_months(3 * i::INT))::DATE) AS q FROM range(40) t(i))""")


@plan("h08_financial_visible_cutoff", "SELECT d, max(q) AS cutoff FROM dates_p JOIN qends_p ON due <= d GROUP BY 1")
def _(p):
    return dates(p).select("d", cal.financial_visible_cutoff("d").alias("cutoff"))


@plan("h09_level_lower_bound", "SELECT DISTINCT level, regexp_extract(replace(level, ',', ''), '[0-9]+')::BIGINT AS lower_bound FROM holding_p")
def _(p):
    return p.holding().select("level").distinct().select("level", fl.level_lower_bound("level").alias("lower_bound"))


@plan("h10_security_type", """SELECT p_partkey AS id, CASE WHEN regexp_matches(code, '^00') OR regexp_matches(p_name, '(?i)etf') THEN 'etf' WHEN regexp_matches(code, '^[0-9]{6}$') THEN 'warrant' ELSE 'stock' END AS security_type
  FROM (SELECT *, CASE WHEN p_size > 25 THEN lpad(p_partkey::VARCHAR, 6, '1') ELSE lpad(p_partkey::VARCHAR, 4, '0') END AS code FROM part)""")
def _(p):
    c = F.col("p_partkey").cast("string")
    code = F.when(F.col("p_size") > 25, F.lpad(c, 6, "1")).otherwise(F.lpad(c, 4, "0"))
    return p.table("part").select(F.col("p_partkey").alias("id"), tx.security_type(code, F.col("p_name")).alias("security_type"))


@plan("h11_parse_number", """SELECT o_orderkey AS id, try_cast(replace(CASE WHEN o_orderpriority = '5-LOW' THEN '--' ELSE format('{:,}', (o_totalprice * 100)::BIGINT) END, ',', '') AS DOUBLE) AS value FROM orders""", "value")
def _(p):
    s = F.when(F.col("o_orderpriority") == "5-LOW", "--").otherwise(F.format_number(F.round(F.col("o_totalprice") * 100).cast("long"), 0))
    return p.table("orders").select(F.col("o_orderkey").alias("id"), tx.parse_number(s).alias("value"))


RAT = ["free_cf:2", "gross_margin", "operating_margin", "net_margin", "roe", "roa", "debt_ratio"]


@plan("h12_financial_ratios", f"SELECT symbol, date, {', '.join(c.split(':')[0] for c in RAT)} FROM ratios_p", " ".join(RAT))
def _(p):
    return fl.ratios(p.statements()).select("symbol", "date", *[c.split(":")[0] for c in RAT])


def fee_sql(p, s, side, slip="0.0005"):
    odd = f"(({s})::BIGINT % 1000)"
    lots = f"(({s}) - {odd})"
    c = f"(CASE WHEN {lots} > 0 THEN greatest({p} * {lots} * 0.001425, 20.0) ELSE 0 END + CASE WHEN {odd} > 0 THEN greatest({p} * {odd} * 0.001425, 1.0) ELSE 0 END)"
    t = f"({p} * ({s}) * 0.003)" if side == "sell" else "0.0"
    sl = f"({p} * ({s}) * {slip} + {p} * {odd} * 0.001)"
    return c, t, sl


BC, BT, BS = fee_sql("entry_price", "n", "buy")
SC, ST, SS = fee_sql("exit_price", "n", "sell")
cte("tradesn_p", "SELECT *, shares * 37 AS n FROM trades_p")


def trades_n(p):
    """Trades with larger share counts, so that whole and odd lots both occur."""
    return p.trades().withColumn("n", F.col("shares") * 37)


@plan("h13_trade_cost_amounts", f"""SELECT trade_id, {BC} AS buy_commission, {BS} AS buy_slippage, {SC} AS sell_commission, {ST} AS sell_tax, {SS} AS sell_slippage FROM tradesn_p""",
  "buy_commission buy_slippage sell_commission sell_tax sell_slippage")
def _(p):
    a, _t, s = tr.trade_cost("entry_price", "n", tr.SLIPPAGE_RATE, "buy")
    b, t, u = tr.trade_cost("exit_price", "n", tr.SLIPPAGE_RATE, "sell")
    return trades_n(p).select("trade_id", a.alias("buy_commission"), s.alias("buy_slippage"), b.alias("sell_commission"), t.alias("sell_tax"), u.alias("sell_slippage"))


@plan("h14_split_lot_odd", "SELECT trade_id, n - n::BIGINT % 1000 AS lot_shares, (n::BIGINT % 1000)::DOUBLE AS odd_shares FROM tradesn_p", "lot_shares odd_shares")
def _(p):
    a, b = tr.split_lot_odd("n")
    return trades_n(p).select("trade_id", a.alias("lot_shares"), b.alias("odd_shares"))


def slip_sql(side, order):
    base = f"""(CASE WHEN volume > 0 THEN least((CASE WHEN close > 0 AND high > low THEN greatest(0.0005 + 0.5 / sqrt(volume), (high - low) / close * 0.5) ELSE 0.0005 + 0.5 / sqrt(volume) END)
      + {f'0.01 * sqrt(least({order} / volume, 1.0))' if order else '0'}, 0.01) ELSE 0.0005 END)"""
    return f"least({base} * 1.3, 0.01)" if side == "sell" else base


@plan("h15_dynamic_slippage", f"""SELECT symbol, date, {slip_sql('buy', None)} AS buy_slip, {slip_sql('sell', None)} AS sell_slip, {slip_sql('buy', 'v10')} AS order_slip
  FROM (SELECT symbol, date, high, close, low, volume * 1e6 AS volume, volume * 1e5 AS v10 FROM bars_p)""", "buy_slip:8 sell_slip:8 order_slip:8")
def _(p):
    v = F.col("volume") * 1e6
    a = ("high", "low", "close")
    return p.bars().select(
        "symbol",
        "date",
        tr.dynamic_slippage(v, *a).alias("buy_slip"),
        tr.dynamic_slippage(v, *a, side="sell").alias("sell_slip"),
        tr.dynamic_slippage(v, *a, order_shares=F.col("volume") * 1e5).alias("order_slip"),
    )


@plan("h16_position_pnl", f"""SELECT trade_id, got - paid AS pnl, (got - paid) / paid AS return_pct FROM (SELECT trade_id, entry_price * n + {BC} + {BS} AS paid, exit_price * n - ({SC} + {ST} + {SS}) AS got FROM tradesn_p)""", "pnl:2 return_pct")
def _(p):
    pnl, r = tr.position_pnl("entry_price", "exit_price", "n")
    return trades_n(p).select("trade_id", pnl.alias("pnl"), r.alias("return_pct"))


KC, KT, KS = fee_sql("price", "s", "buy")


@plan("h17_compute_shares", f"""SELECT trade_id, max(s) AS shares FROM (SELECT trade_id, capital, price, unnest(range(greatest(top - 40, 0), top + 1)) AS s FROM (
    SELECT trade_id, shares * 5000 AS capital, entry_price / 40 AS price, least(floor(shares * 5000 / (entry_price / 40 * 1.001925)), floor(shares * 20000 * 0.05))::BIGINT AS top FROM trades_p))
  WHERE s = 0 OR price * s + {KC} + {KS} <= capital GROUP BY 1""")
def _(p):
    n = tr.affordable_shares(F.col("shares") * 5000, F.col("entry_price") / 40, F.col("shares") * 20000)
    return p.trades().select("trade_id", n.alias("shares"))


@plan("h18_liquidity_limit", "SELECT symbol, date, least(volume * 3, floor(volume * 20 * 0.05)) AS shares FROM bars_p", "shares")
def _(p):
    return p.closes().select("symbol", "date", tr.liquidity_limit(F.col("volume") * 3, F.col("volume") * 20).alias("shares"))


@plan("h19_detect_limit_price", "SELECT symbol, date, coalesce((open - pc) / nullif(pc, 0) >= 0.095, false) AS limit_up, coalesce((open - pc) / nullif(pc, 0) <= -0.095, false) AS limit_down FROM moves_p")
def _(p):
    d = p.bars().withColumn("pc", F.lag("close").over(ind.W()))
    u, v = tr.limit_flags("open", "pc")
    return d.select("symbol", "date", u.alias("limit_up"), v.alias("limit_down"))


def ex_dates(p):
    """Bars on ex-dates with the previous close and the dividends."""
    from .indicators import dividend_events

    ev = dividend_events(p).groupBy("symbol", "date").agg(F.sum("cash").alias("cash"), F.sum("stock").alias("stock"))
    return p.bars().withColumn("pc", F.lag("close").over(ind.W())).join(ev, ["symbol", "date"])


cte("exd_p", "SELECT m.*, cash, stock FROM moves_p m JOIN divw_p d ON d.symbol = m.symbol AND d.date = m.date")
FACT = "(CASE WHEN pc > 0 AND (pc - cash) / pc / (1 + stock / 10) > 0 AND (pc - cash) / pc / (1 + stock / 10) < 1.5 THEN (pc - cash) / pc / (1 + stock / 10) END)"


@plan("h20_dividend_adjustment_factor", f"SELECT symbol, date, {FACT} AS factor FROM exd_p", "factor")
def _(p):
    return ex_dates(p).select("symbol", "date", tr.dividend_factor("pc", "cash", "stock").alias("factor"))


@plan("h21_adjust_stop_loss", f"SELECT symbol, date, coalesce(pc * 0.9 * {FACT}, pc * 0.9) AS stop_loss FROM exd_p", "stop_loss")
def _(p):
    return ex_dates(p).select("symbol", "date", tr.adjusted_stop(F.col("pc") * 0.9, "pc", "cash", "stock").alias("stop_loss"))


@plan("h22_dividend_cash", "SELECT symbol, date, CASE WHEN volume > 0 AND cash > 0 THEN volume * cash ELSE 0 END AS cash_received FROM exd_p", "cash_received:3")
def _(p):
    return ex_dates(p).select("symbol", "date", tr.dividend_cash("volume", "cash").alias("cash_received"))


REG = "CASE symbol % 4 WHEN 0 THEN 'bull' WHEN 1 THEN 'sideways' WHEN 2 THEN 'bear' ELSE 'crisis' END"


def regime_of_symbol():
    return lookup(F.pmod("symbol", F.lit(4)), {0: "bull", 1: "sideways", 2: "bear"}, "crisis")


def timing_panel(p):
    d = ind.sma(ind.atr(p.bars()), 20)
    return d.withColumn("regime", regime_of_symbol()).withColumn("atr_pct", F.col("atr14") / F.col("close") / 30)


cte("timing_p", f"""SELECT a.symbol, a.date, a.close, a.atr14, i.sma_20, i.rsi_14, {REG.replace('symbol', 'a.symbol')} AS regime, a.atr14 / a.close / 30 AS atr_pct
  FROM atr_p a JOIN indw_p i ON i.symbol = a.symbol AND i.date = a.date""")


@plan("h23_atr_stops", """SELECT symbol, date, CASE WHEN atr14 > 0 THEN close - atr14 * CASE regime WHEN 'bull' THEN 1.5 WHEN 'bear' THEN 1.2 WHEN 'crisis' THEN 1.0 ELSE 1.5 END ELSE close * (1 - CASE regime WHEN 'bull' THEN 0.05 WHEN 'bear' THEN 0.03 WHEN 'crisis' THEN 0.02 ELSE 0.04 END) END AS stop_loss,
   CASE WHEN atr14 > 0 THEN close + atr14 * CASE regime WHEN 'bull' THEN 3.5 WHEN 'bear' THEN 2.5 WHEN 'crisis' THEN 1.8 ELSE 3.0 END ELSE close * (1 + CASE regime WHEN 'bull' THEN 0.10 WHEN 'bear' THEN 0.06 WHEN 'crisis' THEN 0.04 ELSE 0.08 END) END AS take_profit FROM timing_p""", "stop_loss:3 take_profit:3")
def _(p):
    s, t = tr.atr_stops("close", "atr14", "regime")
    return timing_panel(p).select("symbol", "date", s.alias("stop_loss"), t.alias("take_profit"))


@plan("h24_entry_trigger", """SELECT symbol, date, (CASE WHEN close > sma_20 * 1.01 THEN '站上均線' WHEN close >= sma_20 * 0.99 THEN '貼近均線' ELSE '均線下方，等待確認' END) || (CASE WHEN atr_pct < 0.02 THEN '，低波動' WHEN atr_pct > 0.04 THEN '，高波動謹慎' ELSE '' END)
  || (CASE WHEN regime = 'crisis' THEN '｜⚠ 崩盤期建議降低部位規模' ELSE '' END) AS entry_trigger FROM timing_p""")
def _(p):
    return timing_panel(p).select("symbol", "date", tr.entry_trigger("close", "sma_20", "atr_pct", "regime").alias("entry_trigger"))


@plan("h25_assess_timing", """SELECT symbol, date, (CASE WHEN rsi_14 >= 70 THEN '謹慎觀望：RSI 超買，追高風險高' WHEN rsi_14 <= 30 THEN CASE WHEN regime IN ('bull', 'sideways') THEN '潛在反彈：RSI 超賣，留意止損' ELSE '下跌趨勢中超賣，等待企穩訊號' END
    WHEN regime = 'crisis' THEN '崩盤期：大幅減碼或暫停進場' WHEN up AND regime = 'bull' THEN CASE WHEN rsi_14 >= 55 THEN '積極做多：動能強勁 + 趨勢向上' ELSE '順勢佈局：趨勢向上，動能待確認' END
    WHEN up AND regime = 'sideways' THEN '區間上軌，注意壓力，設好止損' WHEN regime = 'bear' THEN '空頭環境，建議觀望或嚴守止損' ELSE '等待訊號：尚未站上均線' END)
  || CASE WHEN atr_pct < 0.015 THEN '，低波動' WHEN atr_pct > 0.04 THEN '，高波動謹慎' ELSE '' END AS timing FROM (SELECT *, coalesce(close > sma_20 * 1.005, false) AS up FROM timing_p)""")
def _(p):
    d = ind.rsi(timing_panel(p))
    return d.select("symbol", "date", tr.assess_timing("rsi_14", "close", "sma_20", "atr_pct", "regime").alias("timing"))


@plan("h26_trailing_stop", "SELECT symbol, date, max(high) OVER (PARTITION BY symbol ORDER BY date) - atr14 * 2.0 AS trailing_stop FROM atr_p", "trailing_stop")
def _(p):
    d = ind.atr(p.bars())
    return d.select("symbol", "date", tr.trailing_stop(F.max("high").over(ind.trailing(1 << 30)), "atr14", 2.0).alias("trailing_stop"))


@plan("h28_holdout_violation", """SELECT portfolio, CASE WHEN hi < h THEN 'ok' WHEN lo >= h THEN 'forward' ELSE 'partial' END AS severity, (CASE WHEN lo >= h THEN 0 WHEN hi < h THEN datediff('day', lo, hi) + 1 ELSE datediff('day', lo, h) END)::BIGINT AS in_sample_days,
    (CASE WHEN hi < h THEN 0 WHEN lo >= h THEN datediff('day', lo, hi) + 1 ELSE datediff('day', h, hi) + 1 END)::BIGINT AS holdout_days
  FROM (SELECT portfolio, exit_reason, min(entry_date) AS lo, max(exit_date) AS hi, (DATE '1996-01-01' + to_months((portfolio * 3)::INT))::DATE AS h FROM trades_p WHERE exit_reason = 'stop_loss' GROUP BY 1, 2)""")
def _(p):
    g = p.trades().where(F.col("exit_reason") == "stop_loss").groupBy("portfolio").agg(F.min("entry_date").alias("lo"), F.max("exit_date").alias("hi"))
    s, a, b = tr.holdout_severity("lo", "hi", F.add_months(F.lit("1996-01-01").cast("date"), (F.col("portfolio") * 3).cast("int")))
    return g.select("portfolio", s.alias("severity"), a.alias("in_sample_days"), b.alias("holdout_days"))


@plan("h29_judge_block", """SELECT symbol % 4 AS cell, count(*) AS n, CASE WHEN count(*) < 30 THEN 'insufficient_data' WHEN symbol % 4 < 2 AND avg(r) > 0.02 AND avg((r > 0)::INT) > 0.55 THEN 'lift_block'
   WHEN symbol % 4 >= 2 AND avg(r) < -0.03 AND avg((r > 0)::INT) < 0.35 THEN 'add_block' ELSE 'keep' END AS recommendation FROM (SELECT symbol, exit_price / entry_price - 1 AS r FROM trades_p) GROUP BY symbol % 4""")
def _(p):
    r = F.col("exit_price") / F.col("entry_price") - 1
    d = p.trades().groupBy(F.pmod("symbol", F.lit(4)).alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.avg(r).alias("a"), F.avg((r > 0).cast("int")).alias("w"))
    return d.select("cell", "n", tr.judge_block(F.col("cell") < 2, "n", "a", "w").alias("recommendation"))


@plan("h30_latest_visible_revenue_month", "SELECT d, year(m)::BIGINT AS y, month(m)::BIGINT AS m FROM (SELECT d, d - to_months(CASE WHEN day(d) >= 10 THEN 1 ELSE 2 END) AS m FROM dates_p)")
def _(p):
    c = cal.revenue_visible_cutoff("d")
    return dates(p).select("d", F.year(c).cast("long").alias("y"), F.month(c).cast("long").alias("m"))


@plan("h31_quarter_publish_deadline", "SELECT symbol, date, date + CASE WHEN quarter = 4 THEN 90 ELSE 45 END AS deadline FROM statements_p")
def _(p):
    return p.statements().select("symbol", "date", cal.quarter_publish_deadline("year", "quarter").alias("deadline"))


@plan("h32_next_trading_day", """SELECT d, (SELECT min(date) FROM tdays_p t WHERE t.date > d) AS next_day, (SELECT max(date) FROM tdays_p t WHERE t.date < d) AS prev_day FROM dates_p""")
def _(p):
    from ..functions.timeseries import asof

    t = trading_days(p).withColumn("k", F.lit(1)).withColumn("v", F.col("date"))
    q = dates(p).withColumn("k", F.lit(1))
    kw = dict(on="k", probe_date="d", fact_date="date", values=["v"], allow_exact=False)
    a = asof(q, t, forward=True, **kw).select("d", "k", F.col("v").alias("next_day"))
    return asof(a, t, **kw).select("d", "next_day", F.col("v").alias("prev_day"))


@plan("h33_effective_ex_date", """SELECT o_orderkey AS id, coalesce(CASE WHEN o_orderstatus = 'F' THEN o_orderdate::DATE + 3 END, CASE WHEN o_orderstatus = 'O' THEN o_orderdate::DATE + 5 END, o_orderdate::DATE) AS ex_date FROM orders""")
def _(p):
    d = F.col("o_orderdate").cast("date")
    s = F.col("o_orderstatus")
    ex = F.coalesce(F.when(s == "F", F.date_add(d, 3)), F.when(s == "O", F.date_add(d, 5)), d)
    return p.table("orders").select(F.col("o_orderkey").alias("id"), ex.alias("ex_date"))


@plan("h34_trade_costs", f"SELECT trade_id, {SC} AS commission, {ST} AS tax, {SS} AS slippage_cost, {SC} + {ST} + {SS} AS total_cost FROM tradesn_p", "commission:2 tax:2 slippage_cost:2 total_cost:2")
def _(p):
    c, t, s = tr.trade_cost("exit_price", "n", tr.SLIPPAGE_RATE, "sell")
    return trades_n(p).select("trade_id", c.alias("commission"), t.alias("tax"), s.alias("slippage_cost"), (c + t + s).alias("total_cost"))


@plan("h39_business_days", """SELECT symbol, date, count(*) FILTER (isodow(x) < 6) AS n FROM (SELECT symbol, date, unnest(generate_series(pd, date - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS x FROM (
  SELECT symbol, date, lag(date) OVER (PARTITION BY symbol ORDER BY date) AS pd FROM bars_d) WHERE pd IS NOT NULL) GROUP BY 1, 2""")
def _(p):
    d = p.bars_daily().select("symbol", "date", F.lag("date").over(ind.W()).alias("pd"))
    return d.where(F.col("pd").isNotNull()).select("symbol", "date", busdays("pd", "date").alias("n"))
