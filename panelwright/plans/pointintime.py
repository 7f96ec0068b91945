"""Inputs of the scan's bonus stages as they stood at every scan date, one row per (symbol, scan date).

Frames by market date and by age in days are equality joins with small calendars: a scan date is listed once for each
day or date that it looks back on, so a row meets the few scans that see it. Rows that hold until the next one are dealt
to the scans between them by the scans' numbers. Nothing here reads a row later than the scan date.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.exprs import trailing
from ..functions.text import CATALYST_TYPES, RISK_TYPES, news_decay_weight
from ..operators import flows as fl
from ..operators import ranking as rk
from ..operators import scoring as sc
from .ctes import cte, pr_sql
from .flows import ACC, GAP, SMART

C = F.col
FRAME, RECENT = 20, 5
NEWS_DAYS, NEWS_BASE, NEWS_BIN = 15, 30, 3
LEDGER_DAYS = 60


def calendar(p):
    """Market dates with their ordinal `o` and the number `s` of the first scan that is not before them."""
    w = Window.partitionBy(F.lit(0)).orderBy("date")  # one row per date
    d = p.lines().select(C("week").alias("date")).distinct().join(p.scan_dates().withColumn("_scan", F.lit(1)), "date", "left")
    before = F.coalesce(F.count("_scan").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.select("date", F.row_number().over(w).alias("o"), (before + 1).alias("s"), C("_scan").isNotNull().alias("is_scan"))


def market(p):
    return p.shared("calendar", lambda: calendar(p))


def seen_dates(p, n):
    """(date, scan, age): the last n market dates of every scan date, age 0 on the scan date. Stored, so that its size is known."""
    return p.shared(f"seen_dates_{n}", lambda: _seen_dates(p, n))


def _seen_dates(p, n):
    cal = market(p)
    s = cal.where("is_scan").select(C("date").alias("scan"), C("o").alias("_so"))
    s = s.withColumn("o", F.explode(F.sequence(F.greatest(C("_so") - (n - 1), F.lit(1)), C("_so"))))
    return s.join(cal.select("date", "o"), "o").select("date", "scan", (C("_so") - C("o")).alias("age"))


def seen_days(p, days):
    """(date, scan): the scan date and the `days` days before it."""
    return p.scan_dates().select(C("date").alias("scan"), F.explode(F.sequence(F.date_sub("date", days), C("date"))).alias("date"))


def carried(p, rows, key=("symbol",), only=None):
    """Rows of (key, date, ...) dealt to every scan date at which they are the key's latest; with ``only``, those it holds for."""
    cal = market(p)
    d = rows.join(cal.select("date", "s"), "date")
    upto = F.lead("s").over(Window.partitionBy(*key).orderBy("date"))
    return dealt_to_scans(p, d.withColumn("_to", upto), only)


def dealt_to_scans(p, d, only=None, lie=None):
    """Rows for every scan from number `s` to that before `_to`, the number at the key's next row; ``lie`` says how the rows
    are to lie, before they are multiplied."""
    cal = market(p)
    d = d.withColumn("_to", F.coalesce("_to", cal.agg(F.count_if("is_scan") + 1).scalar())).where(C("s") < C("_to"))
    d = d if only is None else d.where(only)
    d = d if lie is None else lie(d)
    d = d.withColumn("s", F.explode(F.sequence(C("s"), C("_to") - 1))).drop("_to", "date")
    return d.join(cal.where("is_scan").select("s", "date"), "s").drop("s")


def frame_sums(p):
    """Weighted net of the last 20 market dates, and total net of the last 5 and of the 15 before."""
    part = lambda cond: F.sum(F.when(cond, C("total_net")).otherwise(0.0))
    net = F.round(F.sum(C("foreign_net") * fl.INVESTOR_WEIGHTS["foreign"] + C("trust_net") * fl.INVESTOR_WEIGHTS["trust"]), 9)
    d = p.flows().join(seen_dates(p, FRAME), "date").groupBy("symbol", C("scan").alias("date"))
    return d.agg(net.alias("net"), part(C("age") < RECENT).alias("recent"), part(C("age") >= RECENT).alias("base"))


def returns(p):
    """First-to-last return of the latest 60 and 20 bars."""
    ret = lambda n: F.when(F.first("close").over(trailing(n)) > 0, C("close") / F.first("close").over(trailing(n)) - 1)
    d = p.bars_beside_wide().select("symbol", "date", "close").withColumns({"ret60": ret(60), "ret20": ret(20), "_n": F.count("close").over(trailing(2))})
    return carried(p, d.select("symbol", "date", *[F.when(C("_n") >= 2, C(c)).alias(c) for c in ("ret60", "ret20")]))


def sector_ranks(p, flow, ret):
    info = p.info().select("symbol", "industry")
    by = ["industry", "date"]
    f = flow.join(info, "symbol").groupBy(*by).agg(F.round(F.sum("net"), 6).alias("total_net"), F.count(F.lit(1)).alias("stock_count"), (F.sum("recent") / RECENT - F.sum("base") / (FRAME - RECENT)).alias("flow_acceleration"))
    m = ret.where("ret60 is not null").join(info, "symbol").groupBy(*by).agg((F.avg("ret60") * 100).alias("avg_return_pct"))
    return rk.rank_sectors(f.drop("flow_acceleration"), m, f.select(*by, "flow_acceleration"), p.xs, by="date")


def concept_ranks(p, flow, ret):
    m = p.concepts()
    mean = lambda d, c, out: m.join(d.where(C(c).isNotNull()).select("symbol", "date", c), "symbol").groupBy("concept", "date").agg(F.avg(c).alias(out))
    return rk.rank_concepts(mean(flow, "net", "concept_flow"), mean(ret, "ret20", "concept_momentum"), p.xs, by="date"), m


def peers(p):
    """Peer bonus of the newest public statement, and the share of the last four public ones with a profit."""
    st = fl.peer_ranking(fl.ratios(p.statements()), p.info(), p.xs)
    st = st.withColumn("eps_pos", F.avg((C("eps") > 0).cast("int")).over(trailing(4)))
    return sc.statements_asof(names(p), st, ["peer_rank_bonus", "eps_pos"]).select("symbol", "date", "peer_rank_bonus", "eps_pos")


def names(p):
    """(symbol, scan date) of the names that trade at a scan date."""
    return p.lines().select("symbol", C("week").alias("date")).distinct().join(p.scan_dates(), "date", "left_semi")


def key_players(p, top_n=3):
    """D10 at every scan date: average buy price of the strongest net buyers of the last 60 days."""
    seen = p.brokers().join(seen_days(p, LEDGER_DAYS), "date")
    g = seen.groupBy("symbol", C("scan").alias("date"), "broker").agg(
        F.sum(C("buy") - C("sell")).alias("_n"),
        F.sum(F.when(C("buy_price").isNotNull(), C("buy") * C("buy_price"))).alias("_v"),
        F.sum(F.when(C("buy_price").isNotNull() & (C("buy") > 0), C("buy"))).alias("_q"),
    )
    w = Window.partitionBy("symbol", "date").orderBy(F.desc("_n"), "broker")  # one row per broker
    g = g.where(C("_n") > 0).withColumn("_rn", F.row_number().over(w)).where(C("_rn") <= top_n)
    return g.groupBy("symbol", "date").agg((F.sum("_v") / F.sum("_q")).alias("key_player_cost"))


def smart_brokers(p, bars=None):
    """D9 at every scan date: each broker's ledger as it stood then, for the names that trade; ``bars`` are the weekly ones."""
    rule = {"min_win_rate": 0.4, "min_profit_factor": 1.0, "min_buy_value": 50_000.0}
    smart, accum = fl.broker_kinds(min_sell_events=3, **rule)
    rows = p.brokers().join(market(p).select("date", "s"), "date", "left")
    states = fl.ledger_rows(rows, follow="s").drop("date").withColumnRenamed("_next", "_to")
    # the few that count are dealt out by symbol, as the prices lie
    states = dealt_to_scans(p, states, smart | accum, lambda d: d.repartition(p.buckets(), "symbol"))
    prices = (bars or p.bars)().join(p.scan_dates(), "date", "left_semi").select("symbol", "date", "close")
    return fl.smart_broker_score(states, prices, p.xs_columns, **rule, by="date")


def news(p):
    """D17 at every scan date: decayed catalyst and risk mass of the last 15 days against that date's other names."""
    ev = p.news().groupBy("symbol", "date", "event_type", "sentiment").agg(F.count(F.lit(1)).alias("n"))
    d = ev.join(seen_days(p, NEWS_BASE), "date").withColumn("age", F.datediff("scan", "date"))
    wt = F.when(C("age") <= NEWS_DAYS, news_decay_weight(C("age"), "event_type") * C("n"))
    risk = C("event_type").isin(RISK_TYPES) | (C("sentiment") == -1)
    cat = C("event_type").isin(CATALYST_TYPES) & ~risk
    k = F.when(C("age") <= NEWS_BIN, 0).otherwise(F.ceil(C("age") / NEWS_BIN) - 1)
    d = d.groupBy("symbol", C("scan").alias("date"), k.alias("k")).agg(
        F.sum("n").alias("n"), F.sum(F.when(C("age") <= NEWS_DAYS, C("n"))).alias("near"), F.sum(F.when(cat, wt)).alias("c"), F.sum(F.when(risk, wt)).alias("r"))
    bins = NEWS_BASE // NEWS_BIN - 1
    base = F.when(C("k").between(1, bins), C("n")).otherwise(0)
    g = d.groupBy("symbol", "date").agg(
        F.sum(F.when(C("k") == 0, C("n")).otherwise(0)).alias("_n"), (F.sum(base) / bins).alias("_mu"), (F.sum(base * base) / bins).alias("_sq"),
        F.sum("near").alias("near"), F.sum("c").alias("c"), F.sum("r").alias("r"))
    sd = F.sqrt(F.greatest(C("_sq") - C("_mu") * C("_mu"), F.lit(0.0)))
    z = (C("_n") - C("_mu")) / F.greatest(sd, F.lit(1.0))
    m = F.when(z > 2, F.least(1 + (z - 2) * 0.15, F.lit(1.5))).when(z < -1, F.greatest(1 + z * 0.1, F.lit(0.7))).otherwise(1.0)
    g = g.where(C("near") > 0).withColumns({x: F.when(C(x) > 0, F.round(C(x) * m, 9)) for x in ("c", "r")})
    g = p.xs.pct_rank(g, "date", {"pc": ("c", True), "pk": ("r", True)})
    g = p.xs.with_stats(g, "date", {"nc": F.count("c"), "nr": F.count("r")})
    pick = lambda x, n: F.when(C(x).isNull(), 0.5).when(C(n) >= 2, C(x)).otherwise(0.7)
    return g.select("symbol", "date", (0.7 * pick("pc", "nc") + 0.3 * (1 - pick("pk", "nr"))).alias("news_score"))


def bonuses(p):
    """The stored table of all bonus inputs at scan dates, for the names that trade then."""
    return p.shared("bonuses", lambda: build_bonuses(p))


def build_bonuses(p):
    flow, ret = p.shared("frame_sums", lambda: frame_sums(p)), p.shared("returns", lambda: returns(p))
    s = rk.sector_bonus(sector_ranks(p, flow, ret), p.info(), by="date").select("symbol", "date", "sector_bonus")
    c = rk.concept_bonus(*concept_ranks(p, flow, ret), by="date")
    x = fl.relative_strength_in(ret.select("symbol", "date", C("ret20").alias("ret")).where("ret is not null").join(p.info().select("symbol", "industry"), "symbol"), p.xs, ["date", "industry"])
    d = names(p)
    for t in (s, c, x.select("symbol", "date", "relative_strength_bonus"), peers(p), key_players(p)):
        d = d.join(t, ["symbol", "date"], "left")
    z = {k: F.coalesce(k, F.lit(0.0)) for k in ("sector_bonus", "concept_bonus", "relative_strength_bonus", "peer_rank_bonus")}
    d = d.withColumns(z).withColumn("concept_bonus", sc.clip_budget(C("concept_bonus"), C("sector_bonus")))
    return d.withColumn("peer_rank_bonus", sc.clip_budget(C("peer_rank_bonus"), C("sector_bonus") + C("concept_bonus")))


# -- twins ----------------------------------------------------------------------------------------------

cte("mcal_p", "SELECT date, row_number() OVER (ORDER BY date) AS o FROM (SELECT DISTINCT week AS date FROM lines_p)")
cte("mscan_p", "SELECT date, o FROM scan_p JOIN mcal_p USING (date)")
cte("framed_p", """SELECT f.symbol, s.date, round(sum(foreign_net * 0.3 + trust_net * 0.7), 9) AS net,
    sum(CASE WHEN s.o - c.o < 5 THEN total_net ELSE 0 END) AS recent, sum(CASE WHEN s.o - c.o >= 5 THEN total_net ELSE 0 END) AS base
  FROM flows_p f JOIN mcal_p c ON c.date = f.date JOIN mscan_p s ON s.o - c.o BETWEEN 0 AND 19 GROUP BY 1, 2""")
FIRST = lambda n: f"first_value(close) OVER (PARTITION BY symbol ORDER BY date ROWS {n - 1} PRECEDING)"
cte("retd_p", f"""SELECT g.symbol, g.date, r.ret60, r.ret20 FROM (SELECT symbol, date FROM (SELECT DISTINCT symbol FROM bars_p), scan_p) g
  ASOF JOIN (SELECT symbol, date, close / {FIRST(60)} - 1 AS ret60, close / {FIRST(20)} - 1 AS ret20, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k FROM bars_p) r
    ON r.symbol = g.symbol AND r.date <= g.date WHERE r.k >= 2""")
HALF_D = lambda c: f"CASE WHEN max({c}) OVER (PARTITION BY date) > min({c}) OVER (PARTITION BY date) THEN {pr_sql(c, 'date')} ELSE 0.5 END"
cte("secd_p", f"""SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, industry) AS rank, count(*) OVER (PARTITION BY date) AS n FROM (
  SELECT industry, date, round(0.5 * (0.3 * ({HALF_D('total_net')}) + 0.7 * ({HALF_D('acc')})) + 0.5 * ({HALF_D('ret')}), 9) AS score FROM (
    SELECT coalesce(f.industry, m.industry) AS industry, coalesce(f.date, m.date) AS date, coalesce(total_net, 0) AS total_net, coalesce(acc, 0) AS acc, coalesce(ret, 0) AS ret
    FROM (SELECT industry, date, round(sum(net), 6) AS total_net, sum(recent) / 5 - sum(base) / 15 AS acc FROM framed_p f JOIN info_p i ON i.symbol = f.symbol GROUP BY 1, 2) f
    FULL JOIN (SELECT industry, date, avg(ret60) * 100 AS ret FROM retd_p r JOIN info_p i ON i.symbol = r.symbol GROUP BY 1, 2) m ON m.industry = f.industry AND m.date = f.date))""")
cte("cond_p", f"""SELECT concept, date, round(0.5 * ({HALF_D('flow')}) + 0.5 * ({HALF_D('mom')}), 9) AS score FROM (
  SELECT m.concept, m.date, mom, coalesce(flow, 0) AS flow FROM (SELECT concept, date, avg(ret20) AS mom FROM retd_p r JOIN concepts_p c ON c.symbol = r.symbol GROUP BY 1, 2) m
  LEFT JOIN (SELECT concept, date, avg(net) AS flow FROM framed_p f JOIN concepts_p c ON c.symbol = f.symbol GROUP BY 1, 2) f ON f.concept = m.concept AND f.date = m.date)""")
cte("conbd_p", """SELECT symbol, date, max((score - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END * 2 - 1) * 0.05 AS cb
  FROM (SELECT *, min(score) OVER (PARTITION BY date) AS lo, max(score) OVER (PARTITION BY date) AS hi FROM cond_p) r JOIN concepts_p c ON c.concept = r.concept GROUP BY 1, 2""")
cte("srsd_p", """SELECT symbol, date, (CASE WHEN ret - m > t THEN 0.03 WHEN ret - m < -t THEN -0.03 ELSE 0 END)::DOUBLE AS rb FROM (
  SELECT r.symbol, r.date, ret20 AS ret, median(ret20) OVER w AS m, CASE WHEN count(*) OVER w >= 3 THEN greatest(1.5 * stddev_samp(ret20) OVER w, 0.05) ELSE 0.08 END AS t
  FROM retd_p r JOIN info_p i ON i.symbol = r.symbol WINDOW w AS (PARTITION BY r.date, industry))""")
cte("peerd_p", "SELECT c.symbol, c.date, s.peer_rank_bonus AS pb FROM cut_p c ASOF LEFT JOIN peer_p s ON s.symbol = c.symbol AND s.date <= c.fcut")
cte("kpd_p", f"""SELECT symbol, date, sum(v) / sum(q) AS key_player_cost FROM (
  SELECT b.symbol, s.date, broker, sum(buy - sell) AS n, sum(buy * buy_price) AS v, sum(buy) FILTER (buy > 0 AND buy_price IS NOT NULL) AS q
  FROM brokers_p b JOIN scan_p s ON b.date BETWEEN s.date - {LEDGER_DAYS} AND s.date GROUP BY 1, 2, 3 HAVING sum(buy - sell) > 0
  QUALIFY row_number() OVER (PARTITION BY b.symbol, s.date ORDER BY sum(buy - sell) DESC, broker) <= 3) GROUP BY 1, 2""")
cte("leds_p", """SELECT r.symbol, r.broker, t.date, coalesce(wins / nullif(sells, 0), 0) AS win_rate, CASE WHEN loss > 0 THEN gain / loss WHEN gain > 0 THEN 999.0 ELSE 0.0 END AS profit_factor, sells AS sell_events,
    bought AS total_buy_value, gain - loss AS hist_pnl, t.net - coalesce(a.net, 0) AS recent_net, pos AS net_position, cost AS avg_cost, t.net - coalesce(h.net, 0) > coalesce(h.net, 0) AS trend_up, coalesce(t.s / nullif(t.b, 0), 0) AS sell_ratio
  FROM led_r r JOIN ledsum_p t ON t.symbol = r.symbol AND t.broker = r.broker AND t.rn = r.rn LEFT JOIN ledsum_p a ON a.symbol = r.symbol AND a.broker = r.broker AND a.rn = r.rn - 3 LEFT JOIN ledsum_p h ON h.symbol = r.symbol AND h.broker = r.broker AND h.rn = r.rn // 2""")
cte("ledsum_p", "SELECT symbol, broker, date, rn, sum(buy - sell) OVER w AS net, sum(buy) OVER w AS b, sum(sell) OVER w AS s FROM led_in WINDOW w AS (PARTITION BY symbol, broker ORDER BY date)")
cte("smartd_p", f"""SELECT symbol, date, s AS smart_broker_score, a AS accum_broker_score, s * 0.6 + a * 0.4 AS smart_broker_factor, n_smart FROM (
  SELECT symbol, date, n_smart, ({pr_sql('raw', 'date')}) * 0.4 + ({pr_sql('wr', 'date')}) * 0.25 + ({pr_sql('pf', 'date')}) * 0.25 + ({pr_sql('un', 'date')}) * 0.1 AS s, ({pr_sql('ac', 'date')}) * 0.4 + ({pr_sql('px', 'date')}) * 0.35 + ({pr_sql('ts', 'date')}) * 0.25 AS a FROM (
    SELECT l.symbol, l.date, count(*) FILTER ({SMART} OR {ACC}) AS n_smart, round(coalesce(sum(hist_pnl * recent_net) FILTER ({SMART} AND recent_net > 0), 0), 3) AS raw, round(coalesce(avg(win_rate) FILTER ({SMART}), 0), 9) AS wr,
      round(coalesce(avg(least(profit_factor, 10.0)) FILTER ({SMART}), 0), 9) AS pf, round(coalesce(avg({GAP}) FILTER ({SMART} AND net_position > 0), 0), 9) AS un, count(*) FILTER ({ACC}) AS ac,
      round(coalesce(avg({GAP}) FILTER ({ACC}), 0), 9) AS px, coalesce(avg(1) FILTER ({ACC}), 0) AS ts
    FROM (SELECT g.symbol, g.broker, g.date, x.* EXCLUDE (symbol, broker, date) FROM (SELECT symbol, broker, date FROM (SELECT DISTINCT symbol, broker FROM brokers_p), scan_p) g
      ASOF JOIN leds_p x ON x.symbol = g.symbol AND x.broker = g.broker AND x.date <= g.date) l JOIN bars_p c ON c.symbol = l.symbol AND c.date = l.date GROUP BY 1, 2))""")
cte("bond_p", """SELECT symbol, date, sector_bonus, concept_bonus, relative_strength_bonus, key_player_cost,
    greatest(least(pb, greatest(0.08 - abs(sector_bonus + concept_bonus), 0)), -greatest(0.08 - abs(sector_bonus + concept_bonus), 0)) AS peer_rank_bonus FROM (
  SELECT *, greatest(least(cb, greatest(0.08 - abs(sector_bonus), 0)), -greatest(0.08 - abs(sector_bonus), 0)) AS concept_bonus FROM (
    SELECT c.symbol, c.date, coalesce(0.05 * (1 - 2 * (s.rank - 1) / nullif(s.n - 1, 0)), 0)::DOUBLE AS sector_bonus, coalesce(cb, 0)::DOUBLE AS cb, coalesce(rb, 0)::DOUBLE AS relative_strength_bonus, coalesce(pb, 0)::DOUBLE AS pb, key_player_cost
    FROM names_p c LEFT JOIN info_p i ON i.symbol = c.symbol LEFT JOIN secd_p s ON s.industry = i.industry AND s.date = c.date LEFT JOIN conbd_p d ON d.symbol = c.symbol AND d.date = c.date
    LEFT JOIN srsd_p x ON x.symbol = c.symbol AND x.date = c.date LEFT JOIN peerd_p r ON r.symbol = c.symbol AND r.date = c.date LEFT JOIN kpd_p k ON k.symbol = c.symbol AND k.date = c.date))""")
WEIGHT_D = """exp(-CASE WHEN event_type IN ('governance_change', 'buyback') THEN 0.07 WHEN event_type IN ('revenue', 'general') THEN 0.15 ELSE 0.12 END * age)
  * CASE event_type WHEN 'governance_change' THEN 5.0 WHEN 'buyback' THEN 4.0 WHEN 'earnings_call' THEN 3.0 WHEN 'investor_day' THEN 2.0 WHEN 'filing' THEN 1.5 WHEN 'revenue' THEN 1.2 ELSE 1.0 END"""
cte("newsev_p", """SELECT user_id AS symbol, t.event_type, sentiment, (w0 + ((epoch_us(ts) - lo) * days // (hi - lo + 1))::INT)::DATE AS date FROM events e JOIN ann_p t ON t.seq = e.event_id,
  (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events), (SELECT min(week) AS w0, datediff('day', min(week), max(week)) + 7 AS days FROM lines_p)""")
cte("newsd_p", f"""SELECT symbol, date, 0.7 * c + 0.3 * (1 - r) AS news_score FROM (
  SELECT symbol, date, CASE WHEN c IS NULL THEN 0.5 WHEN count(c) OVER w >= 2 THEN {pr_sql('c', 'date')} ELSE 0.7 END AS c, CASE WHEN r IS NULL THEN 0.5 WHEN count(r) OVER w >= 2 THEN {pr_sql('r', 'date')} ELSE 0.7 END AS r FROM (
    SELECT x.symbol, x.date, CASE WHEN c > 0 THEN round(c * m, 9) END AS c, CASE WHEN r > 0 THEN round(r * m, 9) END AS r FROM (
      SELECT symbol, scan AS date, sum({WEIGHT_D}) FILTER (event_type IN ('earnings_call', 'investor_day', 'buyback', 'revenue') AND NOT risk) AS c, sum({WEIGHT_D}) FILTER (risk) AS r
      FROM newsage_p WHERE age <= {NEWS_DAYS} GROUP BY 1, 2) x
    JOIN (SELECT symbol, date, CASE WHEN z > 2 THEN least(1 + (z - 2) * 0.15, 1.5) WHEN z < -1 THEN greatest(1 + z * 0.1, 0.7) ELSE 1 END AS m FROM (
      SELECT symbol, date, (n0 - mu) / greatest(sqrt(greatest(sq - mu * mu, 0)), 1) AS z FROM (
        SELECT symbol, scan AS date, sum(CASE WHEN k = 0 THEN n ELSE 0 END) AS n0, sum(CASE WHEN k BETWEEN 1 AND 9 THEN n ELSE 0 END) / 9 AS mu, sum(CASE WHEN k BETWEEN 1 AND 9 THEN n * n ELSE 0 END) / 9 AS sq
        FROM (SELECT symbol, scan, CASE WHEN age <= {NEWS_BIN} THEN 0 ELSE ceil(age / {NEWS_BIN}) - 1 END AS k, count(*) AS n FROM newsage_p GROUP BY 1, 2, 3) GROUP BY 1, 2))) z ON z.symbol = x.symbol AND z.date = x.date)
  WINDOW w AS (PARTITION BY date))""")
cte("newsage_p", f"""SELECT e.symbol, s.date AS scan, event_type, event_type IN ('governance_change', 'filing') OR sentiment = -1 AS risk, datediff('day', e.date, s.date) AS age
  FROM newsev_p e JOIN scan_p s ON e.date BETWEEN s.date - {NEWS_BASE} AND s.date""")
