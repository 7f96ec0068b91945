"""D: flow, broker, holder, fundamental and sector aggregates; detectors."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.calendar import ordinals
from ..functions.text import CATALYST_TYPES, RISK_TYPES, news_decay_weight
from ..operators import flows as op
from ..operators import indicators as ind
from .ctes import cte, pr_sql
from .registry import plan

OVER = "OVER (PARTITION BY symbol ORDER BY date"


def calendar(p):
    return ordinals(p.lines().select(F.col("week").alias("date")).distinct())


cte("cal_p", "SELECT date, row_number() OVER (ORDER BY date) AS ordinal FROM index_p")
cte("whale_p", """SELECT symbol, date, w AS whale_percent, w - lag(w) OVER (PARTITION BY symbol ORDER BY date) AS whale_change FROM (
  SELECT symbol, date, coalesce(sum(percent) FILTER (regexp_extract(replace(level, ',', ''), '\\d+')::BIGINT >= 400000), 0) AS w FROM holding_p GROUP BY 1, 2)""")


@plan("d01_whale_score", "SELECT * FROM whale_p", "whale_percent whale_change")
def _(p):
    return op.whale_share(p.holding())


@plan("d02_sbl_score", "SELECT symbol, date, sbl_balance FROM lending_p WHERE date = (SELECT max(date) FROM lending_p)", "sbl_balance")
def _(p):
    return op.last_date(p.lending()).select("symbol", "date", "sbl_balance")


cte("hhi_p", """SELECT symbol, date, net_total, coalesce(q / nullif(pp * pp, 0), 0) AS hhi FROM (
  SELECT symbol, date, sum(greatest(buy - sell, 0)) AS pp, sum(pow(greatest(buy - sell, 0), 2)) AS q, sum(buy - sell) AS net_total FROM brokers_p GROUP BY 1, 2)""")
cte("hhi_last", "SELECT * FROM hhi_p QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1")
cte("brokerscore_p", """WITH recent AS (SELECT DISTINCT symbol, date FROM brokers_p QUALIFY dense_rank() OVER (PARTITION BY symbol ORDER BY date DESC) <= 7),
  top AS (SELECT symbol, broker, sum(buy - sell) AS n FROM brokers_p JOIN recent USING (symbol, date) GROUP BY 1, 2
    QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY sum(buy - sell) DESC, broker) = 1),
  runs AS (SELECT b.symbol, count(*) FILTER (d > coalesce(lastmiss, DATE '1900-01-01')) AS run FROM (
      SELECT b.symbol, b.date AS d, max(CASE WHEN buy <= sell THEN b.date END) OVER (PARTITION BY b.symbol) AS lastmiss FROM brokers_p b JOIN top ON top.symbol = b.symbol AND top.broker = b.broker) b GROUP BY 1)
  SELECT h.symbol, h.hhi AS broker_concentration, (CASE WHEN t.n > 0 THEN r.run ELSE 0 END)::BIGINT AS broker_consecutive_days
  FROM hhi_last h JOIN top t USING (symbol) JOIN runs r USING (symbol)""")


@plan("d03_broker_score", "SELECT * FROM brokerscore_p", "broker_concentration")
def _(p):
    return op.broker_score(p.brokers())


cte("hhitrend_p", f"SELECT symbol, date, hhi, avg(hhi) {OVER} ROWS 2 PRECEDING) - avg(hhi) {OVER} ROWS 6 PRECEDING) AS hhi_trend, avg(hhi) {OVER} ROWS 2 PRECEDING) AS hhi_short_avg FROM hhi_p")


@plan("d04_hhi_trend", "SELECT * FROM hhitrend_p", "hhi hhi_trend hhi_short_avg")
def _(p):
    return op.hhi_trend(p.brokers()).select("symbol", "date", "hhi", "hhi_trend", "hhi_short_avg")


cte("persist_p", """SELECT f.symbol, f.date, sum(CASE WHEN total_net > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY f.symbol ORDER BY ordinal RANGE 9 PRECEDING) / least(10, ordinal) AS inst_persistence
  FROM flows_p f JOIN cal_p c ON c.date = f.date""")


@plan("d05_institutional_persistence", "SELECT * FROM persist_p", "inst_persistence")
def _(p):
    return op.persistence(p.flows(), calendar(p)).select("symbol", "date", "inst_persistence")


cte("slope_p", """SELECT symbol, date, coalesce(CASE WHEN count(*) OVER w >= 3 THEN regr_slope(total_net, i) OVER w / nullif(avg(abs(total_net)) OVER w, 0) END, 0) AS inst_slope
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM flows_p) WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 9 PRECEDING)""")


@plan("d06_inst_net_buy_slope", "SELECT * FROM slope_p", "inst_slope")
def _(p):
    return op.flow_slope(p.flows()).select("symbol", "date", "inst_slope")


cte("dtb_p", """SELECT symbol, broker, count(h) AS daytrade_events, count(h) / count(*) AS daytrade_ratio, avg(h) AS avg_hold_days FROM (
    SELECT *, CASE WHEN s1 < 0 AND -s1 >= net * 0.7 THEN 1 WHEN s2 < 0 AND -s2 >= net * 0.7 THEN 2 WHEN s3 < 0 AND -s3 >= net * 0.7 THEN 3 END AS h FROM (
      SELECT symbol, broker, buy - sell AS net, lead(buy - sell) OVER w AS s1, lead(buy - sell, 2) OVER w AS s2, lead(buy - sell, 3) OVER w AS s3
      FROM brokers_p WINDOW w AS (PARTITION BY symbol, broker ORDER BY date)) WHERE net > 0) GROUP BY 1, 2 HAVING count(h) >= 3""")


@plan("d07_daytrade_brokers", "SELECT * FROM dtb_p", "daytrade_ratio avg_hold_days")
def _(p):
    return op.quick_turn_brokers(p.brokers())


KNOWN = [3, 7]


def avg_volume(p):
    return op.last_rows(ind.feature_columns(p.bars())).select("symbol", F.col("volume_ma20").alias("avg_volume_20d"))


cte("dtp_p", """SELECT symbol, p AS daytrade_penalty, p > 0 AS has_daytrade_risk, coalesce(names, '') AS top_dt_brokers FROM (
  SELECT g.symbol, CASE WHEN v > 0 AND x < v * 0.05 THEN p1 * 0.5 ELSE p1 END AS p, names FROM (
    SELECT symbol, x, CASE WHEN tb > 0 AND kb / tb >= 0.1 THEN greatest(p0, 0.5) ELSE p0 END AS p1, names FROM (
      SELECT symbol, greatest(coalesce(sum(net) FILTER (dt), 0), 0) AS x, max(buy) FILTER (known) AS kb, sum(buy) AS tb,
        CASE WHEN sum(greatest(net, 0)) > 0 AND coalesce(sum(net) FILTER (dt), 0) > 0 THEN least(1.0, sum(net) FILTER (dt) / sum(greatest(net, 0))) ELSE 0.0 END AS p0,
        array_to_string(list_slice(list(broker::VARCHAR ORDER BY net DESC, broker) FILTER (dt), 1, 3), ',') AS names
      FROM (SELECT b.*, buy - sell AS net, b.broker IN (3, 7) AS known, d.broker IS NOT NULL OR b.broker IN (3, 7) AS dt FROM brokers_p b LEFT JOIN dtb_p d ON d.symbol = b.symbol AND d.broker = b.broker
            QUALIFY b.date = max(b.date) OVER (PARTITION BY b.symbol)) GROUP BY 1)) g
  LEFT JOIN (SELECT symbol, volume_ma20 AS v FROM features_p QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1) f ON f.symbol = g.symbol)""")


def penalties(p):
    return op.quick_turn_penalty(p.brokers(), avg_volume(p), KNOWN)


def penalties_by_date(p, dates=None, bars=None):
    v = ind.feature_columns((bars or p.bars)()).select("symbol", "date", F.col("volume_ma20").alias("avg_volume_20d"))
    return op.quick_turn_penalties(p.brokers(), v, KNOWN, dates)


cte("dts_p", """SELECT symbol, broker, known AS since FROM (SELECT symbol, broker, date, CASE WHEN s1 < 0 AND -s1 >= net * 0.7 THEN d1 WHEN s2 < 0 AND -s2 >= net * 0.7 THEN d2 WHEN s3 < 0 AND -s3 >= net * 0.7 THEN d3 END AS known FROM (
    SELECT symbol, broker, date, buy - sell AS net, lead(buy - sell, 1) OVER w AS s1, lead(buy - sell, 2) OVER w AS s2, lead(buy - sell, 3) OVER w AS s3, lead(date, 1) OVER w AS d1, lead(date, 2) OVER w AS d2, lead(date, 3) OVER w AS d3
    FROM brokers_p WINDOW w AS (PARTITION BY symbol, broker ORDER BY date)) WHERE net > 0)
  WHERE known IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, broker ORDER BY known, date) = 3""")
cte("dtd_p", """SELECT g.symbol, g.date, CASE WHEN v > 0 AND x < v * 0.05 THEN p1 * 0.5 ELSE p1 END AS daytrade_penalty FROM (
    SELECT symbol, date, x, CASE WHEN tb > 0 AND kb / tb >= 0.1 THEN greatest(p0, 0.5) ELSE p0 END AS p1 FROM (
      SELECT symbol, date, greatest(coalesce(sum(net) FILTER (dt), 0), 0) AS x, max(buy) FILTER (known) AS kb, sum(buy) AS tb,
        CASE WHEN sum(greatest(net, 0)) > 0 AND coalesce(sum(net) FILTER (dt), 0) > 0 THEN least(1.0, sum(net) FILTER (dt) / sum(greatest(net, 0))) ELSE 0.0 END AS p0
      FROM (SELECT b.*, buy - sell AS net, b.broker IN (3, 7) AS known, coalesce(d.since <= b.date, false) OR b.broker IN (3, 7) AS dt FROM brokers_p b LEFT JOIN dts_p d ON d.symbol = b.symbol AND d.broker = b.broker) GROUP BY 1, 2)) g
  LEFT JOIN (SELECT symbol, date, volume_ma20 AS v FROM features_p) f ON f.symbol = g.symbol AND f.date = g.date""")


@plan("d08_daytrade_penalty", "SELECT * FROM dtp_p", "daytrade_penalty")
def _(p):
    return penalties(p)


# twin of the ledger: one recursion step per dated row
cte("led_in", "SELECT symbol, broker, date, buy, sell, coalesce(buy_price, 0) AS bp, coalesce(sell_price, 0) AS sp, row_number() OVER (PARTITION BY symbol, broker ORDER BY date) AS rn, count(*) OVER (PARTITION BY symbol, broker) AS n FROM brokers_p")
NEWPOS = "(s.pos + CASE WHEN b.buy > 0 AND b.bp > 0 THEN b.buy ELSE 0 END)"
NEWCOST = "(CASE WHEN b.buy > 0 AND b.bp > 0 THEN (s.cost * s.pos + b.bp * b.buy) / (s.pos + b.buy) ELSE s.cost END)"
PNL = f"(CASE WHEN b.sell > 0 AND b.sp > 0 AND {NEWCOST} > 0 THEN (b.sp - {NEWCOST}) * b.sell ELSE 0 END)"
SOLD = f"(b.sell > 0 AND b.sp > 0 AND {NEWCOST} > 0)"
cte("led_r", f"""/*RECURSIVE*/SELECT symbol, broker, 0::BIGINT AS rn, 0.0::DOUBLE AS cost, 0.0::DOUBLE AS pos, 0.0::DOUBLE AS gain, 0.0::DOUBLE AS loss, 0::BIGINT AS wins, 0::BIGINT AS sells, 0.0::DOUBLE AS bought FROM led_in WHERE rn = 1
  UNION ALL SELECT b.symbol, b.broker, b.rn, {NEWCOST}, CASE WHEN {SOLD} THEN greatest(0, {NEWPOS} - b.sell) ELSE {NEWPOS} END, s.gain + greatest({PNL}, 0), s.loss + greatest(-{PNL}, 0),
    s.wins + CASE WHEN {PNL} > 0 THEN 1 ELSE 0 END, s.sells + CASE WHEN {SOLD} THEN 1 ELSE 0 END, s.bought + CASE WHEN b.buy > 0 AND b.bp > 0 THEN b.buy * b.bp ELSE 0 END
  FROM led_r s JOIN led_in b ON b.symbol = s.symbol AND b.broker = s.broker AND b.rn = s.rn + 1""")
cte("ledger_p", """SELECT r.symbol, r.broker, coalesce(wins / nullif(sells, 0), 0) AS win_rate, CASE WHEN loss > 0 THEN gain / loss WHEN gain > 0 THEN 999.0 ELSE 0.0 END AS profit_factor, sells AS sell_events,
    bought AS total_buy_value, gain - loss AS hist_pnl, recent_net, pos AS net_position, cost AS avg_cost, coalesce(h2, 0) > coalesce(h1, 0) AS trend_up, coalesce(tsell / nullif(tbuy, 0), 0) AS sell_ratio
  FROM led_r r JOIN (SELECT symbol, broker, max(n) AS n, sum(buy - sell) FILTER (rn > n - 3) AS recent_net, sum(buy - sell) FILTER (rn <= n // 2) AS h1, sum(buy - sell) FILTER (rn > n // 2) AS h2,
      sum(buy) AS tbuy, sum(sell) AS tsell FROM led_in GROUP BY 1, 2) t ON t.symbol = r.symbol AND t.broker = r.broker AND r.rn = t.n""")
SMART = "(win_rate >= 0.4 AND profit_factor >= 1.0 AND sell_events >= 3 AND total_buy_value >= 50000)"
ACC = "(sell_ratio <= 0.1 AND net_position > 0 AND total_buy_value >= 50000 AND trend_up)"
GAP = "CASE WHEN close > 0 AND avg_cost > 0 THEN (close - avg_cost) / avg_cost ELSE 0 END"


@plan("d09_broker_ledger", "SELECT * FROM ledger_p", "win_rate profit_factor:5 total_buy_value:2 hist_pnl:2 recent_net net_position avg_cost:4 sell_ratio")
def _(p):
    return op.broker_ledger(p.brokers())


cte("last_close", "SELECT symbol, last(close ORDER BY date) AS close, max(date) AS date FROM bars_p GROUP BY 1")


def last_close(p):
    return op.last_rows(p.closes()).select("symbol", "close")


RK = lambda c: pr_sql(c, "g")
cte("smart_p", f"""SELECT symbol, s AS smart_broker_score, a AS accum_broker_score, s * 0.6 + a * 0.4 AS smart_broker_factor FROM (
  SELECT symbol, ({RK('raw')}) * 0.4 + ({RK('wr')}) * 0.25 + ({RK('pf')}) * 0.25 + ({RK('un')}) * 0.1 AS s, ({RK('ac')}) * 0.4 + ({RK('px')}) * 0.35 + ({RK('ts')}) * 0.25 AS a FROM (
    SELECT l.symbol, 1 AS g, round(coalesce(sum(hist_pnl * recent_net) FILTER ({SMART} AND recent_net > 0), 0), 3) AS raw, round(coalesce(avg(win_rate) FILTER ({SMART}), 0), 9) AS wr,
      round(coalesce(avg(least(profit_factor, 10.0)) FILTER ({SMART}), 0), 9) AS pf, round(coalesce(avg({GAP}) FILTER ({SMART} AND net_position > 0), 0), 9) AS un, count(*) FILTER ({ACC}) AS ac,
      round(coalesce(avg({GAP}) FILTER ({ACC}), 0), 9) AS px, coalesce(avg(1) FILTER ({ACC}), 0) AS ts FROM ledger_p l LEFT JOIN last_close c ON c.symbol = l.symbol GROUP BY 1))""")


def smart(p):
    return op.smart_broker_score(op.broker_ledger(p.brokers()), last_close(p), p.xs, min_win_rate=0.4, min_profit_factor=1.0, min_buy_value=50_000.0)


@plan("d09_smart_broker_score", "SELECT * FROM smart_p", "smart_broker_score accum_broker_score smart_broker_factor")
def _(p):
    return smart(p)


cte("kpc_p", """SELECT symbol, sum(v) / nullif(sum(q), 0) AS key_player_cost FROM (
    SELECT symbol, broker, sum(buy - sell) AS n, sum(buy * buy_price) AS v, sum(buy) FILTER (buy > 0 AND buy_price IS NOT NULL) AS q FROM brokers_p
    WHERE date >= (SELECT max(date) FROM brokers_p) - INTERVAL 60 DAY GROUP BY 1, 2 HAVING sum(buy - sell) > 0
    QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY sum(buy - sell) DESC, broker) <= 3) GROUP BY 1""")


@plan("d10_key_player_cost_basis", "SELECT * FROM kpc_p", "key_player_cost")
def _(p):
    return op.key_player_cost(p.brokers())


cte("kps_p", """SELECT k.symbol, key_player_cost, close, CASE WHEN close / key_player_cost < 0.95 THEN 0.8 WHEN close / key_player_cost > 1.10 THEN 0.2 ELSE 0.5 END::DOUBLE AS key_player_score
  FROM kpc_p k JOIN last_close c ON c.symbol = k.symbol""")


@plan("d11_score_key_player_cost", "SELECT * FROM kps_p", "key_player_cost close key_player_score")
def _(p):
    d = op.key_player_cost(p.brokers()).join(last_close(p), "symbol")
    return d.withColumn("key_player_score", op.key_player_score(F.col("key_player_cost"), F.col("close")))


cte("abn_p", """SELECT symbol, recent_count, mu, (recent_count - mu) / greatest(sqrt(greatest(sq - mu * mu, 0)), 1) AS abnormal_z FROM (
  SELECT symbol, sum(CASE WHEN k = 0 THEN c ELSE 0 END)::BIGINT AS recent_count, sum(CASE WHEN k > 0 THEN c ELSE 0 END) / 9.0 AS mu, sum(CASE WHEN k > 0 THEN c * c ELSE 0 END) / 9.0 AS sq FROM (
    SELECT symbol, CASE WHEN age <= 3 THEN 0 ELSE (age - 1) // 3 END AS k, count(*) AS c FROM (SELECT symbol, datediff('day', date, (SELECT max(date) FROM ann_p)) AS age FROM ann_p)
    WHERE age <= 30 GROUP BY 1, 2) WHERE k <= 9 GROUP BY 1)""")


@plan("d12_abnormal_announcement_rate", "SELECT * FROM abn_p", "mu abnormal_z")
def _(p):
    return op.abnormal_rate(p.announcements(), recent=3, baseline=30)


cte("ratios_p", """SELECT *, operating_cf + investing_cf AS free_cf, gross_profit / nullif(revenue, 0) * 100 AS gross_margin, operating_income / nullif(revenue, 0) * 100 AS operating_margin,
    net_income / nullif(revenue, 0) * 100 AS net_margin, net_income / nullif(equity, 0) * 100 AS roe, net_income / nullif(total_assets, 0) * 100 AS roa,
    (total_assets - equity) / nullif(total_assets, 0) * 100 AS debt_ratio FROM statements_p""")
cte("eq_p", """SELECT symbol, date, (a + b + d) / 3.0 AS earnings_quality FROM (SELECT symbol, date,
    CASE WHEN operating_cf / nullif(net_income, 0) > 1 THEN 1.0 WHEN operating_cf / nullif(net_income, 0) > 0.5 THEN 0.6 WHEN net_income <> 0 THEN 0.2 ELSE 0.5 END AS a,
    CASE WHEN (net_income - pn) / nullif(abs(pn), 0) > (revenue - pv) / nullif(abs(pv), 0) + 0.2 THEN 0.3 WHEN pn <> 0 AND pv <> 0 THEN 0.8 ELSE 0.5 END AS b,
    CASE WHEN debt_ratio < 50 THEN 0.8 WHEN debt_ratio < 70 THEN 0.5 WHEN debt_ratio IS NOT NULL THEN 0.2 ELSE 0.5 END AS d
  FROM (SELECT *, lag(net_income) OVER w AS pn, lag(revenue) OVER w AS pv FROM ratios_p WINDOW w AS (PARTITION BY symbol ORDER BY date)))""")


@plan("d13_earnings_quality", "SELECT * FROM eq_p", "earnings_quality")
def _(p):
    return op.earnings_quality(op.ratios(p.statements())).select("symbol", "date", "earnings_quality")


cte("qs_p", f"""SELECT symbol, date, gm_yoy_change, 0.6 * CASE WHEN n >= 2 THEN coalesce(r, 0.5) ELSE 0.5 END + 0.4 * CASE WHEN free_cf > 0 THEN 1.0 WHEN free_cf IS NOT NULL THEN 0.0 ELSE 0.5 END AS quality_score FROM (
  SELECT *, {pr_sql('gm_yoy_change', 'date')} AS r, count(gm_yoy_change) OVER (PARTITION BY date) AS n FROM (
    SELECT a.symbol, a.date, a.free_cf, a.gross_margin - b.gross_margin AS gm_yoy_change FROM ratios_p a LEFT JOIN ratios_p b ON b.symbol = a.symbol AND b.year = a.year - 1 AND b.quarter = a.quarter))""")


@plan("d14_quality_score", "SELECT * FROM qs_p", "gm_yoy_change quality_score")
def _(p):
    return op.quality_score(op.ratios(p.statements()), p.xs).select("symbol", "date", "gm_yoy_change", "quality_score")


cte("peer_p", f"""SELECT symbol, date, pk AS peer_rank, (CASE WHEN n < 4 THEN 0 WHEN pk >= 0.75 THEN 0.03 WHEN pk <= 0.25 THEN -0.03 ELSE 0 END)::DOUBLE AS peer_rank_bonus FROM (
  SELECT symbol, date, round((a + b + c) / 3, 12) AS pk, n FROM (SELECT r.symbol, date, {pr_sql('roe', 'date, industry')} AS a, {pr_sql('gross_margin', 'date, industry')} AS b, {pr_sql('revenue', 'date, industry')} AS c,
    count(*) OVER (PARTITION BY date, industry) AS n FROM ratios_p r JOIN info_p i ON i.symbol = r.symbol))""")


@plan("d15_peer_fundamental_ranking", "SELECT * FROM peer_p", "peer_rank peer_rank_bonus")
def _(p):
    return op.peer_ranking(op.ratios(p.statements()), p.info(), p.xs).select("symbol", "date", "peer_rank", "peer_rank_bonus")


cte("racc_p", """SELECT symbol, date, CASE WHEN yoy_growth - q > 10 AND n >= 3 THEN 0.9 WHEN n >= 3 THEN 0.75 WHEN yoy_growth - q > 0 THEN 0.6 WHEN yoy_growth - q <= 0 THEN 0.3 ELSE 0.5 END::DOUBLE AS rev_accel_score, n AS consecutive_accel_months FROM (
  SELECT *, k - max(CASE WHEN up THEN 0 ELSE k END) OVER (PARTITION BY symbol ORDER BY date) AS n FROM (
    SELECT symbol, date, yoy_growth, yoy_3m_ago AS q, coalesce(yoy_growth > lag(yoy_growth) OVER w, false) AS up, row_number() OVER w AS k FROM revpivot_p WHERE yoy_growth IS NOT NULL
    WINDOW w AS (PARTITION BY symbol ORDER BY date)))""")


@plan("d16_revenue_acceleration_score", "SELECT * FROM racc_p", "rev_accel_score")
def _(p):
    return op.revenue_acceleration(p.revenue()).select("symbol", "date", "rev_accel_score", "consecutive_accel_months")


def news_scores(p):
    """Decayed catalyst and risk mass of each symbol over the last 15 days of the table."""
    a = p.announcements()
    a = a.withColumn("age", F.datediff(a.agg(F.max("date")).scalar(), "date")).where(F.col("age") <= 15)
    wt = news_decay_weight(F.col("age"), "event_type")
    risk = F.col("event_type").isin(RISK_TYPES) | (F.col("sentiment") == -1)
    cat = F.col("event_type").isin(CATALYST_TYPES) & ~risk
    g = a.groupBy("symbol").agg(F.sum(F.when(cat, wt)).alias("c"), F.sum(F.when(risk, wt)).alias("r"), F.lit(1).alias("_g"))
    z = op.abnormal_rate(p.announcements(), recent=3, baseline=30).select("symbol", "abnormal_z")
    g = g.join(z, "symbol", "left")
    m = F.when(F.col("abnormal_z") > 2, F.least(1 + (F.col("abnormal_z") - 2) * 0.15, F.lit(1.5))).when(
        F.col("abnormal_z") < -1, F.greatest(1 + F.col("abnormal_z") * 0.1, F.lit(0.7))
    ).otherwise(1.0)
    g = g.withColumns({k: F.when(F.col(k) > 0, F.round(F.col(k) * m, 9)) for k in ("c", "r")})
    g = p.pool.pct_rank(g, "_g", {"pc": ("c", True), "pk": ("r", True)})
    g = p.pool.with_stats(g, "_g", {"nc": F.count("c"), "nr": F.count("r")})
    pick = lambda x, n: F.when(F.col(x).isNull(), 0.5).when(F.col(n) >= 2, F.col(x)).otherwise(0.7)
    g = g.withColumns({"news_catalyst_score": pick("pc", "nc"), "news_risk_score": pick("pk", "nr")})
    return g.select("symbol", "news_catalyst_score", "news_risk_score", (0.7 * F.col("news_catalyst_score") + 0.3 * (1 - F.col("news_risk_score"))).alias("news_score"))


WEIGHT = """exp(-CASE WHEN event_type IN ('governance_change', 'buyback') THEN 0.07 WHEN event_type IN ('revenue', 'general') THEN 0.15 ELSE 0.12 END * age)
  * CASE event_type WHEN 'governance_change' THEN 5.0 WHEN 'buyback' THEN 4.0 WHEN 'earnings_call' THEN 3.0 WHEN 'investor_day' THEN 2.0 WHEN 'filing' THEN 1.5 WHEN 'revenue' THEN 1.2 ELSE 1.0 END"""
cte("news_p", f"""SELECT symbol, c AS news_catalyst_score, r AS news_risk_score, 0.7 * c + 0.3 * (1 - r) AS news_score FROM (
  SELECT symbol, CASE WHEN c IS NULL THEN 0.5 WHEN count(c) OVER () >= 2 THEN {pr_sql('c', 'g')} ELSE 0.7 END AS c, CASE WHEN r IS NULL THEN 0.5 WHEN count(r) OVER () >= 2 THEN {pr_sql('r', 'g')} ELSE 0.7 END AS r FROM (
    SELECT x.symbol, 1 AS g, round(c * m, 9) AS c, round(r * m, 9) AS r FROM (
      SELECT symbol, sum({WEIGHT}) FILTER (event_type IN ('earnings_call', 'investor_day', 'buyback', 'revenue') AND NOT risk) AS c, sum({WEIGHT}) FILTER (risk) AS r FROM (
        SELECT *, event_type IN ('governance_change', 'filing') OR sentiment = -1 AS risk, datediff('day', date, (SELECT max(date) FROM ann_p)) AS age FROM ann_p) WHERE age <= 15 GROUP BY 1) x
      JOIN (SELECT symbol, CASE WHEN abnormal_z > 2 THEN least(1 + (abnormal_z - 2) * 0.15, 1.5) WHEN abnormal_z < -1 THEN greatest(1 + abnormal_z * 0.1, 0.7) ELSE 1 END AS m FROM abn_p) z ON z.symbol = x.symbol))""")


@plan("d17_news_scores", "SELECT * FROM news_p", "news_catalyst_score news_risk_score news_score")
def _(p):
    return news_scores(p)


cte("sflow_p", """SELECT industry, sum(net) AS total_net, count(*) AS stock_count, sum(net) / count(*) AS avg_net_per_stock FROM (
  SELECT symbol, sum(net * CASE investor WHEN 'trust' THEN 0.7 WHEN 'foreign' THEN 0.3 ELSE 0 END) AS net FROM flow_long_p
  WHERE date IN (SELECT DISTINCT date FROM flow_long_p ORDER BY date DESC LIMIT 20) GROUP BY 1) f JOIN info_p i ON i.symbol = f.symbol GROUP BY 1""")


@plan("d19_sector_institutional_flow", "SELECT * FROM sflow_p", "total_net avg_net_per_stock")
def _(p):
    return op.sector_flow(p.flow_long(), p.info(), 20)


def wret(n):
    return f"""SELECT symbol, last(close ORDER BY date) / first(close ORDER BY date) - 1 AS ret FROM (
      SELECT * FROM bars_p QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= {n}) GROUP BY 1 HAVING count(*) >= 2"""


cte("ret60_p", wret(60))
cte("ret20_p", wret(20))
cte("smom_p", "SELECT industry, avg(ret) * 100 AS avg_return_pct, count(*) AS n_stocks FROM ret60_p r JOIN info_p i ON i.symbol = r.symbol GROUP BY 1")


@plan("d20_sector_price_momentum", "SELECT * FROM smom_p", "avg_return_pct")
def _(p):
    return op.sector_momentum(p.closes(), p.info())


cte("sacc_p", """SELECT industry, sum(CASE WHEN o <= 5 THEN total_net ELSE 0 END) / 5 - sum(CASE WHEN o > 5 THEN total_net ELSE 0 END) / 15 AS flow_acceleration FROM flows_p f
  JOIN (SELECT date, row_number() OVER (ORDER BY date DESC) AS o FROM (SELECT DISTINCT date FROM flows_p)) c ON c.date = f.date JOIN info_p i ON i.symbol = f.symbol WHERE o <= 20 GROUP BY 1""")


@plan("d21_flow_acceleration", "SELECT * FROM sacc_p", "flow_acceleration")
def _(p):
    return op.sector_flow_acceleration(p.flows(), p.info())


cte("srs_p", """SELECT symbol, industry, ret, (CASE WHEN ret - m > t THEN 0.03 WHEN ret - m < -t THEN -0.03 ELSE 0 END)::DOUBLE AS relative_strength_bonus FROM (
  SELECT r.symbol, industry, ret, median(ret) OVER w AS m, CASE WHEN count(*) OVER w >= 3 THEN greatest(1.5 * stddev_samp(ret) OVER w, 0.05) ELSE 0.08 END AS t
  FROM ret20_p r JOIN info_p i ON i.symbol = r.symbol WINDOW w AS (PARTITION BY industry))""")


@plan("d22_sector_relative_strength", "SELECT * FROM srs_p", "ret relative_strength_bonus")
def _(p):
    return op.sector_relative_strength(p.closes(), p.info(), p.xs)


cte("cmom_p", "SELECT concept, avg(ret) AS concept_momentum, count(*) AS n_members FROM ret20_p r JOIN concepts_p c ON c.symbol = r.symbol GROUP BY 1")


@plan("d23_concept_momentum", "SELECT * FROM cmom_p", "concept_momentum")
def _(p):
    return op.concept_mean(op.window_return(p.closes(), 20), p.concepts(), "ret", "concept_momentum")


cte("cflow_p", """SELECT concept, avg(net) AS concept_flow, count(*) AS n_members FROM (SELECT symbol, sum(net * CASE investor WHEN 'trust' THEN 0.7 WHEN 'foreign' THEN 0.3 ELSE 0 END) AS net FROM flow_long_p
  WHERE date IN (SELECT DISTINCT date FROM flow_long_p ORDER BY date DESC LIMIT 20) GROUP BY 1) f JOIN concepts_p c ON c.symbol = f.symbol GROUP BY 1""")


@plan("d24_concept_institutional_flow", "SELECT * FROM cflow_p", "concept_flow")
def _(p):
    f = op.investor_weighted(op.recent_dates(p.flow_long(), 20)).groupBy("symbol").agg(F.sum("weighted_net").alias("net"))
    return op.concept_mean(f, p.concepts(), "net", "concept_flow")


LAST = "QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1"
cte("vspike_p", f"""SELECT * FROM (SELECT symbol, date, volume AS today_vol, avg_vol, volume / nullif(avg_vol, 0) AS vol_ratio FROM (SELECT *, avg(volume) {OVER} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS avg_vol FROM bars_p) {LAST}) WHERE vol_ratio >= 1.5""")


@plan("d25_volume_spike", "SELECT * FROM vspike_p", "today_vol avg_vol vol_ratio")
def _(p):
    return op.volume_spike(p.closes(), factor=1.5)


cte("ibuy_p", "SELECT symbol, sum(net) AS inst_net FROM flow_long_p WHERE investor = 'foreign' AND date = (SELECT max(date) FROM flow_long_p WHERE investor = 'foreign') GROUP BY 1 HAVING sum(net) > 5")


@plan("d26_institutional_buy", "SELECT * FROM ibuy_p", "inst_net")
def _(p):
    return op.investor_buy(p.flow_long(), 5)


cte("lspike_p", f"""SELECT * FROM (SELECT symbol, date, sbl_change, avg(sbl_change) OVER w AS sbl_mean, stddev_samp(sbl_change) OVER w AS sbl_std FROM lending_p
  WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) {LAST}) WHERE sbl_change > 0 AND (sbl_change - sbl_mean) / nullif(sbl_std, 0) >= 1.0""")


@plan("d27_sbl_spike", "SELECT * FROM lspike_p", "sbl_change sbl_mean sbl_std")
def _(p):
    return op.lending_spike(p.lending(), sigma=1.0)


cte("bconc_p", "SELECT * FROM hhi_last WHERE hhi >= 0.4 AND net_total > 0")


@plan("d28_broker_concentration", "SELECT * FROM bconc_p", "net_total hhi")
def _(p):
    return op.broker_concentration(p.brokers())


@plan("d29_daytrade_risk", "SELECT symbol, daytrade_penalty, top_dt_brokers FROM dtp_p WHERE daytrade_penalty >= 0.3", "daytrade_penalty")
def _(p):
    return penalties(p).where(F.col("daytrade_penalty") >= 0.3).drop("has_daytrade_risk")


@plan("d30_anomaly_scan", """SELECT 'volume_spike' AS alert, symbol, vol_ratio AS value FROM vspike_p UNION ALL SELECT 'institutional_buy', symbol, inst_net FROM ibuy_p
  UNION ALL SELECT 'sbl_spike', symbol, sbl_change FROM lspike_p UNION ALL SELECT 'broker_concentration', symbol, hhi FROM bconc_p
  UNION ALL SELECT 'daytrade_risk', symbol, daytrade_penalty FROM dtp_p WHERE daytrade_penalty >= 0.3""", "value")
def _(p):
    b = p.brokers()
    parts = [
        (op.volume_spike(p.closes(), factor=1.5), "volume_spike", "vol_ratio"),
        (op.investor_buy(p.flow_long(), 5), "institutional_buy", "inst_net"),
        (op.lending_spike(p.lending(), sigma=1.0), "sbl_spike", "sbl_change"),
        (op.broker_concentration(b), "broker_concentration", "hhi"),
        (penalties(p).where(F.col("daytrade_penalty") >= 0.3), "daytrade_risk", "daytrade_penalty"),
    ]
    out = None
    for d, name, v in parts:
        d = d.select(F.lit(name).alias("alert"), "symbol", F.col(v).cast("double").alias("value"))
        out = d if out is None else out.unionByName(d)
    return out


@plan("d31_revenue_scan", f"""SELECT symbol, date, yoy_growth, mom_growth, gross_margin, margin_change, 0.7 * ({pr_sql('yoy_growth', 'g')}) + 0.3 * coalesce({pr_sql('margin_change', 'g')}, 0.5) AS scan_score FROM (
  SELECT r.symbol, r.date, 1 AS g, yoy_growth, mom_growth, gross_margin, margin_change FROM (SELECT * FROM revenue_p {LAST}) r LEFT JOIN (
    SELECT symbol, gross_margin, gross_margin - lag(gross_margin) {OVER}) AS margin_change FROM ratios_p {LAST}) m ON m.symbol = r.symbol WHERE yoy_growth >= 0 AND (margin_change IS NULL OR margin_change >= -5))""",
  "yoy_growth mom_growth gross_margin margin_change scan_score")
def _(p):
    return op.revenue_scan(p.revenue(), op.ratios(p.statements()), p.xs, 0, -5)


cte("breadth_p", f"""SELECT date, count(*) FILTER (s > 0) AS rising, count(*) FILTER (s < 0) AS falling, count(*) FILTER (s = 0) AS flat, sum(volume) AS total_volume FROM (
  SELECT date, volume, close - lag(close) {OVER}) AS s FROM bars_p) GROUP BY 1""")


@plan("d32_market_breadth", "SELECT * FROM breadth_p", "total_volume")
def _(p):
    return op.market_breadth(p.closes())


@plan("d33_market_breadth_stats", """SELECT n::BIGINT AS days, avg(rising) AS avg_rising, avg(falling) AS avg_falling, avg(flat) AS avg_flat FROM (SELECT *, row_number() OVER (ORDER BY date DESC) AS k FROM breadth_p)
  JOIN (VALUES (1), (5), (20)) t(n) ON k <= n GROUP BY 1""", "avg_rising avg_falling avg_flat")
def _(p):
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("date"))  # one row per date
    d = op.market_breadth(p.closes()).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= 20)
    d = d.withColumn("days", F.explode(F.filter(F.array(*[F.lit(n) for n in (1, 5, 20)]), lambda n: n >= F.col("_k"))))
    return d.groupBy("days").agg(*[F.avg(c).alias(f"avg_{c}") for c in ("rising", "falling", "flat")])


@plan("d34_top_institutional", """SELECT symbol, sum(net) FILTER (investor = 'foreign') AS foreign_net, sum(net) FILTER (investor = 'trust') AS trust_net, sum(net) FILTER (investor = 'dealer') AS dealer_net, sum(net) AS total FROM flow_long_p
  WHERE date IN (SELECT DISTINCT date FROM flow_long_p ORDER BY date DESC LIMIT 5) GROUP BY 1 ORDER BY abs(sum(net)) DESC, symbol LIMIT 10""", "foreign_net trust_net dealer_net total")
def _(p):
    d = op.recent_dates(p.flow_long(), 5)
    by = lambda k: F.sum(F.when(F.col("investor") == k, F.col("net"))).alias(f"{k}_net")
    g = d.groupBy("symbol").agg(by("foreign"), by("trust"), by("dealer"), F.sum("net").alias("total"))
    return g.orderBy(F.abs("total").desc(), "symbol").limit(10)


@plan("d35_market_volume_summary", "SELECT date, sum(turnover) AS turnover, sum(volume) AS volume, count(*) AS n_names FROM bars_p GROUP BY 1", "turnover:2 volume")
def _(p):
    return p.bars().groupBy("date").agg(F.sum("turnover").alias("turnover"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n_names"))


@plan("d38_calendar_heatmap", """SELECT strftime(date, '%Y-%m') AS year_month, avg(close) FILTER (wk = 1) AS w1, avg(close) FILTER (wk = 2) AS w2, avg(close) FILTER (wk = 3) AS w3, avg(close) FILTER (wk = 4) AS w4, avg(close) FILTER (wk = 5) AS w5
  FROM (SELECT *, (day(date) - 1) // 7 + 1 AS wk FROM index_d) GROUP BY 1""", "w1 w2 w3 w4 w5")
def _(p):
    d = p.index("day").withColumn("wk", F.floor((F.dayofmonth("date") - 1) / 7) + 1)
    g = d.groupBy(F.date_format("date", "yyyy-MM").alias("year_month"))
    return g.agg(*[F.avg(F.when(F.col("wk") == k, F.col("close"))).alias(f"w{k}") for k in range(1, 6)])


cte("b20_p", """SELECT date, avg((close < ma20)::INT) AS breadth_below_ma20_pct FROM features_p WHERE ma20 IS NOT NULL GROUP BY 1""")


@plan("d39_breadth_below_ma20", "SELECT * FROM b20_p", "breadth_below_ma20_pct")
def _(p):
    return op.below_mean_share(p.closes())


@plan("d42_multi_stock_closes", """SELECT date, max(close) FILTER (symbol = 1) AS s1, max(close) FILTER (symbol = 2) AS s2, max(close) FILTER (symbol = 3) AS s3 FROM bars_p WHERE symbol IN (1, 2, 3) GROUP BY 1""", "s1 s2 s3")
def _(p):
    d = p.closes().where(F.col("symbol").isin(1, 2, 3))  # the operator's own symbol list
    g = d.groupBy("date").pivot("symbol", [1, 2, 3]).agg(F.max("close"))
    return g.select("date", *[F.col(str(i)).alias(f"s{i}") for i in (1, 2, 3)])


@plan("d44_sector_flow_acceleration", """SELECT industry, sum(CASE WHEN o <= 5 THEN e ELSE 0 END) / 5 - sum(CASE WHEN o > 5 THEN e ELSE 0 END) / 15 AS flow_acceleration FROM sme_p f
  JOIN (SELECT date, row_number() OVER (ORDER BY date DESC) AS o FROM (SELECT DISTINCT date FROM flows_p)) c ON c.date = f.date JOIN info_p i ON i.symbol = f.symbol WHERE o <= 20 GROUP BY 1""", "flow_acceleration")
def _(p):
    from ..functions.timeseries import smooth

    f = smooth(p.flows().select("symbol", "date", "total_net"), {"e": ("total_net", 0.5)})
    return op.sector_flow_acceleration(f.select("symbol", "date", F.col("e").alias("total_net")), p.info())


from .ctes import ewm_sql  # noqa: E402

ewm_sql("sme_p", "flows_p", {"e": ("total_net", 0.5)})
