"""L and A: data quality and table maintenance."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..operators import flows as fl
from ..operators import indicators as ind
from ..operators import quality as q
from ..sources import tables as tb
from .ctes import cte
from .registry import plan
from .scalars import TAGS

REF = "DATE '2001-12-15'"


def ref():
    return F.lit("2001-12-15").cast("date")


BD = lambda a, b: f"(SELECT count(*) FILTER (isodow(x) < 6) FROM (SELECT unnest(generate_series({a}, {b} - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS x))"
# closed form, used on large inputs
CUM = lambda d: f"(floor(datediff('day', DATE '1970-01-05', {d}) / 7) * 5 + least(((datediff('day', DATE '1970-01-05', {d}) % 7) + 7) % 7, 5))"
BDAYS = lambda a, b: f"({CUM(b)} - {CUM(a)})::BIGINT"
PREV = "(SELECT *, lag(date) OVER (PARTITION BY symbol ORDER BY date) AS pd FROM bars_d)"

cte("gaps_p", f"SELECT * FROM (SELECT symbol, pd AS from_date, date AS to_date, {BDAYS('pd', 'date')} - 1 AS gap FROM {PREV}) WHERE gap >= 10")


@plan("l01_missing_days", "SELECT * FROM gaps_p")
def _(p):
    return q.missing_days(p.bars_daily(), 10)


cte("quiet_p", f"""SELECT symbol, start, fin, days, CASE WHEN days >= 3 THEN 'error' ELSE 'warning' END AS severity FROM (SELECT symbol, g, min(date) AS start, max(date) AS fin, count(*) AS days FROM (
  SELECT *, sum(CASE WHEN pd IS NULL OR {BDAYS('pd', 'date')} > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY date) AS g FROM (SELECT symbol, date, lag(date) OVER (PARTITION BY symbol ORDER BY date) AS pd FROM bars_d WHERE volume <= 20)) GROUP BY 1, 2)""")


@plan("l02_zero_volume", 'SELECT symbol, start, fin AS "end", days, severity FROM quiet_p')
def _(p):
    return q.zero_volume(p.bars_daily(), F.col("volume") <= 20)


cte("lim_p", """SELECT symbol, direction, start, fin, days FROM (SELECT symbol, g, direction, min(date) AS start, max(date) AS fin, count(*) AS days FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - row_number() OVER (PARTITION BY symbol, direction ORDER BY date) AS g FROM (
    SELECT symbol, date, CASE WHEN close / pc - 1 >= 0.095 THEN 'up' WHEN close / pc - 1 <= -0.095 THEN 'down' ELSE 'none' END AS direction FROM moves_p)) GROUP BY 1, 2, 3) WHERE direction <> 'none' AND days >= 4""")


@plan("l03_limit_streaks", 'SELECT symbol, direction, start, fin AS "end", days FROM lim_p')
def _(p):
    return q.limit_streaks(p.closes(), 9.5, 4)


def raw_ticks(p):
    """Line items as raw ticks with the defects a feed may carry."""
    px = F.col("l_extendedprice") / F.col("l_quantity")
    k = F.pmod("l_orderkey", F.lit(97))
    return p.lines().select(
        "symbol",
        F.col("day").alias("date"),
        F.when(k == 1, -px).otherwise(px).alias("open"),
        F.when(k == 2, px * 0.5).otherwise(px * 1.1).alias("high"),
        (px * 0.9).alias("low"),
        F.when(k == 3, px * 2).when(k == 4, F.lit(0.0)).otherwise(px).alias("close"),
        F.when(k == 5, -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("volume"),
    )


cte("ticks_p", """SELECT symbol, day AS date, CASE WHEN k = 1 THEN -px ELSE px END AS open, CASE WHEN k = 2 THEN px * 0.5 ELSE px * 1.1 END AS high, px * 0.9 AS low,
  CASE WHEN k = 3 THEN px * 2 WHEN k = 4 THEN 0 ELSE px END AS close, CASE WHEN k = 5 THEN -l_quantity ELSE l_quantity END AS volume FROM (SELECT *, l_orderkey % 97 AS k, l_extendedprice / l_quantity AS px FROM lines_p)""")


@plan("l04_price_anomalies", """SELECT symbol, date, issue FROM (SELECT symbol, date, unnest([CASE WHEN high < low THEN 'high_lt_low' WHEN close > high OR close < low THEN 'close_out_of_range' END, CASE WHEN open <= 0 THEN 'non_positive_open' END, CASE WHEN high <= 0 THEN 'non_positive_high' END,
   CASE WHEN low <= 0 THEN 'non_positive_low' END, CASE WHEN close <= 0 THEN 'non_positive_close' END]) AS issue FROM ticks_p) WHERE issue IS NOT NULL""")
def _(p):
    return q.price_anomalies(raw_ticks(p))


def panel_tables(p):
    return {"flow": p.flows(), "revenue": p.revenue(), "statement": p.statements(), "margin": p.margin()}


cte("tmax_p", """SELECT symbol, 'flow' AS table_name, max(date) AS max_date FROM flows_p GROUP BY 1 UNION ALL SELECT symbol, 'revenue', max(date) FROM revenue_p GROUP BY 1
  UNION ALL SELECT symbol, 'statement', max(date) FROM statements_p GROUP BY 1 UNION ALL SELECT symbol, 'margin', max(date) FROM margin_p GROUP BY 1""")


@plan("l05_date_range_consistency", "SELECT t.symbol, table_name, max_date, base_max, diff_days FROM (SELECT t.*, base_max, abs(datediff('day', base_max, max_date)) AS diff_days FROM tmax_p t JOIN (SELECT symbol, max(date) AS base_max FROM bars_p GROUP BY 1) b ON b.symbol = t.symbol) t WHERE diff_days > 15")
def _(p):
    return q.range_consistency(p.closes(), panel_tables(p), 15)


cte("stale_p", f"SELECT table_name, max_date, bdays_behind FROM (SELECT table_name, max(max_date) AS max_date, {BDAYS('max(max_date)', REF)} AS bdays_behind FROM tmax_p GROUP BY 1) WHERE bdays_behind > 7")


@plan("l06_data_freshness", "SELECT * FROM stale_p")
def _(p):
    return q.freshness(panel_tables(p), ref())


@plan("l07_per_stock_freshness", f"SELECT * FROM (SELECT symbol, max(date) AS max_date, {BDAYS('max(date)', REF)} AS bdays_behind FROM bars_d GROUP BY 1) WHERE bdays_behind > 15")
def _(p):
    return q.stale_symbols(p.bars_daily().select("symbol", "date"), ref(), 15)


@plan("l08_validate_ohlcv", "SELECT date, count(*) AS n_kept, sum(volume) AS volume FROM ticks_p WHERE close > 0 AND high >= low AND close <= high AND close >= low AND volume >= 0 GROUP BY 1", "volume")
def _(p):
    return raw_ticks(p).where(q.valid_ohlcv()).groupBy("date").agg(F.count(F.lit(1)).alias("n_kept"), F.sum("volume").alias("volume"))


@plan("l09_price_jumps", "SELECT symbol, date, close, close / pc - 1 AS jump FROM moves_p WHERE date >= DATE '2001-01-01' AND abs(close / pc - 1) > 0.11", "close jump")
def _(p):
    b = p.closes()
    cut = F.lit("2001-01-01").cast("date")
    return q.price_jumps(b.where(F.col("date") >= cut), b.where(F.col("date") < cut))


@plan("l10_data_freshness_signal", f"SELECT max_date, age, CASE WHEN age > 7 THEN 'critical' WHEN age > 3 THEN 'warning' ELSE 'ok' END AS level FROM (SELECT max(date) AS max_date, datediff('day', max(date), {REF}) AS age FROM index_d)")
def _(p):
    d = p.lines().agg(F.max("day").alias("max_date")).withColumn("age", F.datediff(ref(), "max_date").cast("long"))
    return d.withColumn("level", F.when(F.col("age") > 7, "critical").when(F.col("age") > 3, "warning").otherwise("ok"))


@plan("d40_run_validation", """SELECT 'missing_days' AS check_name, count(*) AS n_issues FROM gaps_p UNION ALL SELECT 'zero_volume', count(*) FROM quiet_p UNION ALL SELECT 'limit_streak', count(*) FROM lim_p UNION ALL SELECT 'data_freshness', count(*) FROM stale_p""")
def _(p):
    b = p.bars_daily()
    parts = {"missing_days": q.missing_days(b, 10), "zero_volume": q.zero_volume(b, F.col("volume") <= 20), "limit_streak": q.limit_streaks(p.closes(), 9.5, 4), "data_freshness": q.freshness(panel_tables(p), ref())}
    out = None
    for name, d in parts.items():
        d = d.agg(F.count(F.lit(1)).alias("n_issues")).withColumn("check_name", F.lit(name))
        out = d if out is None else out.unionByName(d)
    return out


@plan("d40_table_coverage", """SELECT 'bars' AS table_name, count(*) AS n_rows, count(DISTINCT symbol) AS n_symbols, min(date) AS min_date, max(date) AS max_date FROM bars_p UNION ALL SELECT 'flow', count(*), count(DISTINCT symbol), min(date), max(date) FROM flows_p
  UNION ALL SELECT 'revenue', count(*), count(DISTINCT symbol), min(date), max(date) FROM revenue_p""")
def _(p):
    return q.coverage({"bars": p.closes(), "flow": p.flows(), "revenue": p.revenue()})


# -- A -----------------------------------------------------------------------


@plan("a01_export_table", "SELECT symbol, date, close, volume FROM bars_p WHERE symbol IN (1, 2, 3, 5, 8) AND date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'", "close volume")
def _(p):
    d = p.closes().withColumn("id", F.lit(0))
    return tb.select_for_export(d, symbols=[1, 2, 3, 5, 8], start="1997-01-01", end="1999-12-31")  # the operator's own predicates


ORDER_SCHEMA = T.StructType(
    [
        T.StructField("o_orderkey", T.LongType(), False),
        T.StructField("o_orderdate", T.DateType(), False),
        T.StructField("o_totalprice", T.DoubleType(), True),
        T.StructField("o_currency", T.StringType(), False),
    ]
)


def raw_orders(p):
    """Orders as text, with a share of broken dates."""
    bad = F.pmod("o_orderkey", F.lit(11)) == 0
    d = F.when(bad, "n/a").otherwise(F.col("o_orderdate").cast("date").cast("string"))
    return p.table("orders").select(F.col("o_orderkey").cast("string").alias("o_orderkey"), d.alias("o_orderdate"), F.col("o_totalprice").cast("string").alias("o_totalprice"))


@plan("a02_import_table", "SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate::DATE END AS o_orderdate, o_totalprice FROM orders", "o_totalprice:2")
def _(p):
    raw = raw_orders(p)
    return raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in ORDER_SCHEMA.fields if f.name in raw.columns])


@plan("a03_validate_import", "SELECT 'o_currency' AS column_name, 'missing' AS problem, 0::BIGINT AS n_rows UNION ALL SELECT 'o_orderdate', 'bad_date', count(*) FROM orders WHERE o_orderkey % 11 = 0")
def _(p):
    return tb.schema_errors(raw_orders(p), ORDER_SCHEMA)


def old_new(p):
    r = p.revenue().select("symbol", "date", "revenue", "yoy_growth")
    old = r.where(F.col("date") < F.lit("2000-01-01").cast("date"))
    new = r.where(F.col("date") >= F.lit("1999-07-01").cast("date")).withColumns({"revenue": F.col("revenue") * 1.1, "yoy_growth": F.lit(0.0), "version": F.lit(1)})
    again = new.where(F.month("date") == 9).withColumns({"revenue": F.col("revenue") - 1, "version": F.lit(2)})
    return old, new.unionByName(again)


@plan("a04_upsert_ignore", "SELECT symbol, date, CASE WHEN date < DATE '2000-01-01' THEN revenue ELSE revenue * 1.1 END AS revenue, CASE WHEN date < DATE '2000-01-01' THEN yoy_growth ELSE 0 END AS yoy_growth FROM revenue_p", "revenue:3 yoy_growth")
def _(p):
    return tb.insert_ignore(*old_new(p), ["symbol", "date"], "version")


@plan("a04_upsert_update", "SELECT symbol, date, CASE WHEN date < DATE '1999-07-01' THEN revenue ELSE revenue * 1.1 - (month(date) = 9)::INT END AS revenue, CASE WHEN date < DATE '2000-01-01' THEN yoy_growth ELSE 0 END AS yoy_growth FROM revenue_p", "revenue:3 yoy_growth")
def _(p):
    return tb.insert_update(*old_new(p), ["symbol", "date"], ["revenue"], "version")


@plan("a05_last_dates", "SELECT s_suppkey AS symbol, last_date FROM supplier LEFT JOIN (SELECT symbol, max(date) AS last_date FROM bars_d WHERE day(date) < 3 AND month(date) = 2 GROUP BY 1) ON symbol = s_suppkey")
def _(p):
    d = p.lines().select("symbol", F.col("day").alias("date")).where((F.dayofmonth("date") < 3) & (F.month("date") == 2))
    return tb.last_dates(d, p.table("supplier").select(F.col("s_suppkey").alias("symbol")))


FC = ["ma20", "ma60", "volume_ma20", "turnover_ma5", "momentum_20d", "volatility_20d", "high_20d"]
FCS = ", ".join(FC)


def min_names(p):
    return 20


@plan("a06_daily_features_latest", f"SELECT symbol, date, {FCS} FROM features_p WHERE date = (SELECT max(date) FROM (SELECT date FROM bars_p GROUP BY 1 HAVING count(*) >= 20))", " ".join(FC))
def _(p):
    b = p.bars().where((F.col("volume") > 0) & (F.col("close") > 0))
    last = tb.enough_rows(b, min_names(p)).agg(F.max("date").alias("date"))
    return ind.feature_columns(b).join(last, "date", "left_semi").select("symbol", "date", *FC)


@plan("a07_backfill_features", f"SELECT symbol, date, {FCS} FROM features_p WHERE date IN (SELECT date FROM bars_p GROUP BY 1 HAVING count(*) >= 20) AND (isodow(date + 0) = 1 AND day(date) > 7)", " ".join(FC))
def _(p):
    """Dates of the first week of a month count as done already."""
    b = p.bars().where((F.col("volume") > 0) & (F.col("close") > 0))
    ok = tb.enough_rows(b, min_names(p))
    done = ok.where(F.dayofmonth("date") <= 7)
    todo = ok.join(done, "date", "left_anti")
    return ind.feature_columns(b).join(todo, "date", "left_semi").select("symbol", "date", *FC)


EAV = ["revenue", "gross_profit", "net_income", "equity", "operating_cf"]


def eav(p):
    return p.statements().unpivot(["date", "symbol"], EAV, "type", "value").withColumn("value", F.col("value").cast("string"))


@plan("a08_pivot_eav", "SELECT date, symbol, revenue AS rev, net_income AS ni, equity AS eq FROM statements_p", "rev:3 ni:3 eq:3")
def _(p):
    return tb.pivot_names(eav(p), {"revenue": "rev", "net_income": "ni", "equity": "eq"})


@plan("a09_financial_summary", "SELECT symbol, date, year, quarter, revenue, gross_margin, roe, free_cf FROM ratios_p", "revenue:3 gross_margin roe free_cf:2")
def _(p):
    s = p.statements()
    inc = s.select("symbol", "date", "revenue", "gross_profit", "operating_income", "net_income")
    bal = s.select("symbol", "date", "total_assets", "equity")
    cf = s.select("symbol", "date", "operating_cf", "investing_cf")
    j = inc.join(bal, ["symbol", "date"], "left").join(cf, ["symbol", "date"], "left")
    j = j.withColumns({"year": F.year("date"), "quarter": F.quarter("date")})
    return fl.ratios(j).select("symbol", "date", "year", "quarter", "revenue", "gross_margin", "roe", "free_cf")


@plan("a10_shared_market_data", """SELECT 'price' AS part, count(*) AS n_rows, max(date) AS max_date FROM bars_p WHERE date BETWEEN DATE '2000-06-01' AND DATE '2000-12-31' UNION ALL SELECT 'flow', count(*), max(date) FROM flows_p WHERE date BETWEEN DATE '2000-06-01' AND DATE '2000-12-31'
   UNION ALL SELECT 'revenue', count(*), max(date) FROM revenue_p WHERE date BETWEEN DATE '2000-06-01' AND DATE '2000-12-31'""")
def _(p):
    out = None
    for name, d in shared_market_data(p, "2000-06-01", "2000-12-31").items():
        d = d.agg(F.count(F.lit(1)).alias("n_rows"), F.max("date").alias("max_date")).withColumn("part", F.lit(name))
        out = d if out is None else out.unionByName(d)
    return out


def shared_market_data(p, start: str, end: str):
    """A10: the bounded panels that all scans of a date share."""
    ok = F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return {"price": p.bars().where(ok), "flow": p.flows().where(ok), "revenue": p.revenue().where(ok)}


@plan("a11_slice_revenue", "SELECT symbol, date, revenue, yoy_growth, prev_yoy, yoy_3m_ago FROM revpivot_p QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1", "revenue:3 yoy_growth prev_yoy yoy_3m_ago")
def _(p):
    return fl.last_rows(ind.revenue_pivot(p.revenue())).select("symbol", "date", "revenue", "yoy_growth", "prev_yoy", "yoy_3m_ago")


@plan("a12_sync_concept_tags", """SELECT concept, symbol FROM (SELECT DISTINCT source AS symbol, unnest(list_filter([CASE WHEN regexp_matches(lower(text), 'license|rights') THEN 'legal' END, CASE WHEN regexp_matches(lower(text), 'apache|token') THEN 'software' END, CASE WHEN regexp_matches(lower(text), 'free') THEN 'free' END], lambda x: x IS NOT NULL)) AS concept FROM documents)
  WHERE (concept, symbol) NOT IN (SELECT 'legal', min(source) FROM documents)""")
def _(p):
    d = p.table("documents")
    new = d.select(F.explode(tx.classify_concepts("text", TAGS)).alias("concept"), F.col("source").alias("symbol")).distinct()
    known = d.agg(F.min("source").alias("symbol")).withColumn("concept", F.lit("legal"))
    return new.join(known, ["concept", "symbol"], "left_anti")


@plan("a13_clear_false_delistings", """SELECT i.symbol, CASE WHEN NOT (coalesce(n, 0) >= 3) THEN delisted_date END AS delisted_date, coalesce(n, 0) >= 3 AS cleared FROM (SELECT s_suppkey AS symbol, CASE WHEN s_suppkey % 2 = 0 THEN DATE '2001-08-01' + (s_suppkey % 100)::INT END AS delisted_date FROM supplier) i
   LEFT JOIN (SELECT b.symbol, count(DISTINCT b.date) AS n FROM bars_d b WHERE b.symbol % 2 = 0 AND b.date > DATE '2001-08-01' + (b.symbol % 100)::INT GROUP BY 1) c ON c.symbol = i.symbol""")
def _(p):
    s = F.col("s_suppkey")
    gone = F.when(F.pmod(s, F.lit(2)) == 0, F.date_add(F.lit("2001-08-01").cast("date"), F.pmod(s, F.lit(100)).cast("int")))
    info = p.table("supplier").select(s.alias("symbol"), gone.alias("delisted_date"))
    return tb.false_delistings(info, p.lines().select("symbol", F.col("day").alias("date")))


@plan("a16_diff_metrics", """SELECT coalesce(a.industry, b.industry) AS industry, a.v AS a, b.v AS b, b.v - a.v AS delta FROM (SELECT industry, avg(close) AS v FROM bars_p b JOIN info_p i ON i.symbol = b.symbol WHERE date < DATE '1998-01-01' GROUP BY 1) a
   FULL JOIN (SELECT industry, avg(close) AS v FROM bars_p b JOIN info_p i ON i.symbol = b.symbol WHERE date >= DATE '1998-01-01' GROUP BY 1) b ON a.industry = b.industry""", "a b delta")
def _(p):
    d = p.closes().join(p.info().select("symbol", "industry"), "symbol")
    cut = F.lit("1998-01-01").cast("date")
    m = lambda c: d.where(c).groupBy("industry").agg(F.avg("close").alias("v"))
    return tb.map_diff(m(F.col("date") < cut), m(F.col("date") >= cut), "industry", "v")


@plan("a17_trades_to_dataframe", "SELECT trade_id, symbol, entry_date, exit_date, exit_price / entry_price - 1 AS return_pct, datediff('day', entry_date, exit_date) AS holding_days, exit_reason FROM trades_p", "return_pct")
def _(p):
    return p.trades().select("trade_id", "symbol", "entry_date", "exit_date", (F.col("exit_price") / F.col("entry_price") - 1).alias("return_pct"), F.datediff("exit_date", "entry_date").cast("long").alias("holding_days"), "exit_reason")


@plan("a18_status", """SELECT 'lineitem' AS table_name, count(*) AS n_rows, count(DISTINCT l_suppkey) AS n_symbols, min(l_shipdate)::DATE AS min_date, max(l_shipdate)::DATE AS max_date FROM lineitem UNION ALL
   SELECT 'events', count(*), count(DISTINCT user_id), min(ts)::DATE, max(ts)::DATE FROM events UNION ALL SELECT 'orders', count(*), count(DISTINCT o_custkey), min(o_orderdate)::DATE, max(o_orderdate)::DATE FROM orders""")
def _(p):
    shape = lambda n, k, d: p.table(n).select(F.col(k).alias("symbol"), F.col(d).cast("date").alias("date"))
    return q.coverage({"lineitem": shape("lineitem", "l_suppkey", "l_shipdate"), "events": shape("events", "user_id", "ts"), "orders": shape("orders", "o_custkey", "o_orderdate")})
