"""DuckDB twins of the panels, as named CTEs resolved on demand."""

from __future__ import annotations

import re

CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    if name in CTES:
        raise ValueError(f"duplicate CTE {name}")
    CTES[name] = sql.strip()


def _collect(sql: str, seen: dict[str, None], busy: frozenset = frozenset()) -> None:
    for name in dict.fromkeys(re.findall(r"(?<![.\w])[a-z]\w*", sql)):
        if name in CTES and name not in seen and name not in busy:
            _collect(CTES[name], seen, busy | {name})
            seen[name] = None


def rnd_sql(c: str, d: int = 6) -> str:
    x, m = f"({c})::DOUBLE", f"1e{d}"
    return f"CASE WHEN NOT (abs({x}) * {m} < 9007199254740992) THEN {x} WHEN {x} < 0 THEN -floor(-{x} * {m} + 0.5001) / {m} + 0.0 ELSE floor({x} * {m} + 0.5001) / {m} END"


def oracle(body: str, digits: dict[str, int] | None = None) -> str:
    """Prefix the CTEs that ``body`` mentions and round the declared columns."""
    body = body.strip().rstrip(";")
    seen: dict[str, None] = {}
    _collect(body, seen)
    kept = "/*MATERIALIZED*/"
    ctes = [f"{n} AS MATERIALIZED ({CTES[n].removeprefix(kept)})" if CTES[n].startswith(kept) else f"{n} AS ({CTES[n]})" for n in seen]
    if digits:
        rep = ", ".join(f"{rnd_sql(c, d)} AS {c}" for c, d in digits.items())
        body = f"SELECT * REPLACE ({rep}) FROM (\n{body}\n)"
    recursive = any("RECURSIVE" in CTES[n] for n in seen) or "/*recursive*/" in body
    ctes = [c.replace("/*RECURSIVE*/", "") for c in ctes]
    if not ctes:
        return body
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n" + body


PX = "l_extendedprice / l_quantity"
TIE = "l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice"


def bars_sql(grain: str) -> str:
    return f"""SELECT symbol, {grain} AS date,
      first({PX} ORDER BY {TIE}) AS open, max({PX}) AS high, min({PX}) AS low,
      last({PX} ORDER BY {TIE}) AS close, sum(l_quantity) AS volume, sum(l_extendedprice) AS turnover
    FROM lines_p GROUP BY 1, 2"""


def index_sql(grain: str) -> str:
    return f"""SELECT {grain} AS date, sum(l_extendedprice) / sum(l_quantity) AS close,
      max({PX}) AS high, min({PX}) AS low, sum(l_quantity) AS volume FROM lines_p GROUP BY 1"""


cte("lines_p", """SELECT l_suppkey AS symbol, l_shipdate::DATE AS day, date_trunc('week', l_shipdate)::DATE AS week, *
    FROM lineitem""")
cte("bars_p", bars_sql("week"))
cte("bars_d", bars_sql("day"))
cte("index_p", index_sql("week"))
cte("index_d", index_sql("day"))
cte("info_p", """SELECT s_suppkey AS symbol, s_name AS name, n_name AS industry, r_name AS listing_type, s_acctbal
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
INV = "CASE o_orderpriority WHEN '1-URGENT' THEN 'foreign' WHEN '2-HIGH' THEN 'trust' WHEN '3-MEDIUM' THEN 'dealer' ELSE 'other' END"
cte("lines_o", f"""SELECT l.*, o.o_custkey, {INV} AS investor, CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS net
    FROM lines_p l JOIN orders o ON l_orderkey = o_orderkey""")
cte("flow_long_p", "SELECT symbol, week AS date, investor, sum(net) AS net FROM lines_o GROUP BY 1, 2, 3")
cte("flows_p", """SELECT symbol, week AS date,
    coalesce(sum(net) FILTER (investor = 'foreign'), 0) AS foreign_net,
    coalesce(sum(net) FILTER (investor = 'trust'), 0) AS trust_net,
    coalesce(sum(net) FILTER (investor = 'dealer'), 0) AS dealer_net, sum(net) AS total_net
    FROM lines_o GROUP BY 1, 2""")
cte("brokers_p", """SELECT symbol, week AS date, c_nationkey::BIGINT AS broker,
    coalesce(sum(l_quantity) FILTER (l_returnflag <> 'R'), 0) AS buy,
    coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0) AS sell,
    sum(l_extendedprice) FILTER (l_returnflag <> 'R') / sum(l_quantity) FILTER (l_returnflag <> 'R') AS buy_price,
    sum(l_extendedprice) FILTER (l_returnflag = 'R') / sum(l_quantity) FILTER (l_returnflag = 'R') AS sell_price
    FROM lines_o JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3""")
cte("margin_p", """SELECT symbol, date, sum(m) OVER w AS margin_balance, sum(s) OVER w AS short_balance FROM (
      SELECT symbol, week AS date, coalesce(sum(l_quantity) FILTER (l_linestatus = 'O'), 0) AS m,
        coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0) AS s FROM lines_p GROUP BY 1, 2)
    WINDOW w AS (PARTITION BY symbol ORDER BY date)""")
cte("lending_p", """SELECT symbol, date, short_balance AS sbl_balance,
    short_balance - coalesce(lag(short_balance) OVER (PARTITION BY symbol ORDER BY date), 0) AS sbl_change FROM margin_p""")
cte("revenue_p", """SELECT a.symbol, a.date, a.revenue, (a.revenue / lag(a.revenue) OVER (PARTITION BY a.symbol ORDER BY a.date) - 1) * 100 AS mom_growth,
      (a.revenue / b.revenue - 1) * 100 AS yoy_growth
    FROM revenue_raw a LEFT JOIN revenue_raw b ON a.symbol = b.symbol AND b.date = a.date - INTERVAL 1 YEAR""")
cte("revenue_raw", """SELECT symbol, date_trunc('month', day)::DATE AS date, sum(l_extendedprice * (1 - l_discount)) AS revenue
    FROM lines_p GROUP BY 1, 2""")
cte("statements_p", """SELECT symbol, date, shares, year(date)::BIGINT AS year, quarter(date)::BIGINT AS quarter, revenue, revenue - cost AS gross_profit,
      revenue - cost - tax AS operating_income, revenue - cost - tax * 12 AS net_income, (revenue - cost - tax * 12) / shares AS eps,
      cum + s_acctbal + 20000 AS total_assets, cum * 0.5 + s_acctbal + 20000 AS equity,
      collected - cost AS operating_cf, cost * -0.2 AS investing_cf
    FROM (SELECT f.*, s_acctbal, sum(revenue) OVER (PARTITION BY symbol ORDER BY date) AS cum FROM (
      SELECT symbol, last_day(date_trunc('quarter', day)::DATE + INTERVAL 2 MONTH) AS date,
        sum(l_extendedprice * (1 - l_discount)) AS revenue, sum(p_retailprice * l_quantity * 0.4) AS cost,
        sum(l_extendedprice * (1 - l_discount) * l_tax) AS tax, sum(l_quantity) AS shares,
        coalesce(sum(l_extendedprice * (1 - l_discount)) FILTER (l_linestatus = 'F'), 0) AS collected
      FROM lines_p JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) f JOIN supplier ON s_suppkey = symbol)""")
cte("holding_p", """SELECT symbol, date, level, q / sum(q) OVER (PARTITION BY symbol, date) * 100 AS percent FROM (
      SELECT symbol, date_trunc('quarter', day)::DATE AS date,
        CASE WHEN c_acctbal < 2000 THEN '1-999 Shares' WHEN c_acctbal < 4000 THEN '1,000-5,000 Shares'
             WHEN c_acctbal < 6000 THEN '200,001-400,000 Shares' WHEN c_acctbal < 8000 THEN '400,001-600,000 Shares'
             ELSE 'more than 1,000,001 Shares' END AS level, sum(l_quantity) AS q
      FROM lines_o JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)""")
cte("valuation_p", """SELECT symbol, date, revenue / shares / nullif(eps, 0) AS pe, revenue / shares * 100 / nullif(equity, 0) AS pb,
    gross_profit / revenue * 10 AS dividend_yield FROM statements_p""")
cte("ann_p", """SELECT user_id AS symbol, ts::DATE AS date, event_id AS seq,
    CASE event_type WHEN 'purchase' THEN 'buyback' WHEN 'signup' THEN 'investor_day' WHEN 'click' THEN 'revenue'
      WHEN 'view' THEN 'general' WHEN 'error' THEN 'governance_change' ELSE 'general' END AS event_type,
    (CASE event_type WHEN 'error' THEN -1 WHEN 'purchase' THEN 1 ELSE 0 END)::BIGINT AS sentiment FROM events""")
cte("concepts_p", """SELECT concept, symbol FROM (
  SELECT p_type AS concept, symbol, count(*) AS n, sum(count(*)) OVER (PARTITION BY symbol) AS t FROM lines_p JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) WHERE n * 6 >= t""")
cte("trades_p", f"""SELECT o_orderkey AS trade_id, c_nationkey::BIGINT AS portfolio, symbol, least(o_orderdate::DATE, x.exit_date) AS entry_date, x.exit_date,
      entry_price, exit_price * (1 - disc * 3) AS exit_price, shares,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'stop_loss' WHEN '2-HIGH' THEN 'take_profit' ELSE 'expired' END AS exit_reason
    FROM (SELECT l_orderkey, min(symbol) AS symbol, max(day) AS exit_date, min({PX}) AS entry_price, avg({PX}) AS exit_price,
        sum(l_quantity) AS shares, max(l_discount) AS disc FROM lines_p GROUP BY 1) x
    JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""")
cte("snapshots_p", """SELECT portfolio, date, sum(pnl) OVER (PARTITION BY portfolio ORDER BY date) + 1000000 AS capital FROM (
      SELECT c_nationkey::BIGINT AS portfolio, week AS date, sum(l_extendedprice * (0.05 - l_discount)) AS pnl
      FROM lines_o JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)""")


def pr_sql(c: str, by: str, asc: bool = True) -> str:
    """Average-rank percentile over non-null peers."""
    d = "" if asc else " DESC"
    return (
        f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY {by} ORDER BY {c}{d} NULLS LAST)"
        f" + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0) / count({c}) OVER (PARTITION BY {by}) END"
    )


def ewm_sql(name: str, src: str, out: dict[str, tuple[str, float]], key: str = "symbol", order: str = "date") -> None:
    """Define CTE ``name``: rows of ``src`` plus first-order recurrences, one step per row.

    The inputs of all outputs must be non-null from the first row on."""
    cols = ", ".join(f"{x} AS {o}" for o, (x, a) in out.items())
    step = ", ".join(f"p.{o} * {1 - a!r} + n.{x} * {a!r}" for o, (x, a) in out.items())
    cte(f"{name}_n", f"SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM {src}")
    names = ", ".join(out)
    cte(f"{name}_r", f"""/*RECURSIVE*/SELECT {key}, rn, {cols} FROM {name}_n WHERE rn = 1
      UNION ALL SELECT n.{key}, n.rn, {step} FROM {name}_r p JOIN {name}_n n ON n.{key} = p.{key} AND n.rn = p.rn + 1""")
    cte(name, f"SELECT n.*, {', '.join('r.' + o for o in out)} FROM {name}_n n JOIN {name}_r r ON r.{key} = n.{key} AND r.rn = n.rn")
    del names
