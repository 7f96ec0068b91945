"""Flow, broker, holder, fundamental and sector aggregates; alert detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.crosssection import CrossSection
from ..functions.exprs import DATE, SYMBOL, div, mean_of, symbol_window, trailing
from ..functions.timeseries import streak

W = symbol_window


def last_date(df: DataFrame, date: str = DATE) -> DataFrame:
    """Rows of the globally latest date (one-row equi-join, no global window)."""
    return df.join(df.agg(F.max(date).alias(date)), date, "left_semi")


def last_rows(df: DataFrame, n: int = 1, key=SYMBOL, order: str = DATE) -> DataFrame:
    """The latest n rows of every series."""
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def level_lower_bound(level) -> Column:
    """H9: first integer of a bracket label such as ``400,001-600,000 Shares``."""
    c = F.col(level) if isinstance(level, str) else level
    return F.try_to_number(F.regexp_extract(F.regexp_replace(c, ",", ""), r"\d+", 0), F.lit("999999999999999")).cast("long")


def whale_share(holding: DataFrame, bound: int = 400_000) -> DataFrame:
    """Percent held in large brackets and its change against the previous date."""
    big = F.sum(F.when(level_lower_bound("level") >= bound, F.col("percent")).otherwise(0.0))
    d = holding.groupBy(SYMBOL, DATE).agg(big.alias("whale_percent"))
    return d.withColumn("whale_change", F.col("whale_percent") - F.lag("whale_percent").over(W()))


def daily_hhi(brokers: DataFrame) -> DataFrame:
    """Concentration of the positive net buyers per (symbol, date)."""
    net = F.col("buy") - F.col("sell")
    pos = F.greatest(net, F.lit(0.0))
    d = brokers.groupBy(SYMBOL, DATE).agg(F.sum(pos).alias("_p"), F.sum(pos * pos).alias("_q"), F.sum(net).alias("net_total"))
    return d.select(SYMBOL, DATE, "net_total", F.coalesce(F.col("_q") / F.when(F.col("_p") > 0, F.col("_p") * F.col("_p")), F.lit(0.0)).alias("hhi"))


def broker_score(brokers: DataFrame, days: int = 7) -> DataFrame:
    """D3: latest HHI and the current buying streak of the strongest recent broker."""
    hhi = last_rows(daily_hhi(brokers)).select(SYMBOL, F.col("hhi").alias("broker_concentration"))
    net = F.col("buy") - F.col("sell")
    b = brokers.withColumn("net", net)
    dates = b.select(SYMBOL, DATE).distinct()
    recent = last_rows(dates, days)
    top = (
        b.join(recent, [SYMBOL, DATE])
        .groupBy(SYMBOL, "broker")
        .agg(F.sum("net").alias("_n"))
        .groupBy(SYMBOL)
        .agg(F.max_by("broker", F.struct(F.col("_n"), -F.col("broker"))).alias("broker"), F.max("_n").alias("_n"))
    )
    runs = last_rows(streak(b, F.col("net") > 0, "_run", key=[SYMBOL, "broker"]), 1, [SYMBOL, "broker"])
    top = top.join(runs.select(SYMBOL, "broker", "_run"), [SYMBOL, "broker"])
    top = top.select(SYMBOL, F.when(F.col("_n") > 0, F.col("_run")).otherwise(0).alias("broker_consecutive_days"))
    return hhi.join(top, SYMBOL)


def hhi_trend(brokers: DataFrame, short: int = 3, long: int = 7) -> DataFrame:
    """Short minus long mean of the daily HHI, for every date."""
    d = daily_hhi(brokers)
    return d.withColumns(
        {
            "hhi_trend": F.avg("hhi").over(trailing(short)) - F.avg("hhi").over(trailing(long)),
            "hhi_short_avg": F.avg("hhi").over(trailing(short)),
        }
    )


def persistence(flows: DataFrame, calendar: DataFrame, n: int = 10) -> DataFrame:
    """Share of the last n market dates with a positive net, at every row."""
    d = flows.join(calendar, DATE)
    w = Window.partitionBy(SYMBOL).orderBy("ordinal").rangeBetween(-(n - 1), 0)
    hits = F.sum(F.when(F.col("total_net") > 0, 1).otherwise(0)).over(w)
    return d.withColumn("inst_persistence", hits / F.least(F.lit(n), F.col("ordinal")))


def flow_slope(flows: DataFrame, n: int = 10) -> DataFrame:
    """Least-squares slope of net over the last n rows, per mean absolute net."""
    d = flows.withColumn("_i", F.row_number().over(W()).cast("double"))
    w = trailing(n)
    slope = F.covar_pop("_i", "total_net").over(w) / F.when(F.var_pop("_i").over(w) > 0, F.var_pop("_i").over(w))
    scale = F.avg(F.abs("total_net")).over(w)
    value = F.when(F.count("total_net").over(w) >= 3, slope / F.when(scale > 0, scale))
    return d.withColumn("inst_slope", F.coalesce(value, F.lit(0.0))).drop("_i")


def quick_turn_brokers(brokers: DataFrame, ratio: float = 0.7, min_events: int = 3) -> DataFrame:
    """Brokers that sell most of a buy within their next three rows."""
    w = symbol_window(key=[SYMBOL, "broker"])
    d = brokers.withColumn("net", F.col("buy") - F.col("sell"))
    d = d.withColumns({f"_s{i}": F.lead("net", i).over(w) for i in (1, 2, 3)})
    need = F.col("net") * ratio
    hold = None
    for i in (1, 2, 3):
        hit = (F.col(f"_s{i}") < 0) & (-F.col(f"_s{i}") >= need)
        hold = F.when(hit, i) if hold is None else hold.when(hit, i)
    d = d.where(F.col("net") > 0).withColumn("_h", hold)
    g = d.groupBy(SYMBOL, "broker").agg(
        F.count("_h").alias("daytrade_events"),
        (F.count("_h") / F.count(F.lit(1))).alias("daytrade_ratio"),
        F.avg("_h").alias("avg_hold_days"),
    )
    return g.where(F.col("daytrade_events") >= min_events)


def quick_turn_penalty(
    brokers: DataFrame,
    volume: DataFrame,
    known: list[int],
    *,
    min_events: int = 3,
    min_volume_ratio: float = 0.05,
    instant_ratio: float = 0.1,
) -> DataFrame:
    """How much of the latest buying comes from flagged brokers.

    ``volume`` holds (symbol, avg_volume_20d); ``known`` is a short fixed list.
    """
    flagged = quick_turn_brokers(brokers, min_events=min_events).select(SYMBOL, "broker", F.lit(True).alias("_dt"))
    d = brokers.withColumn("net", F.col("buy") - F.col("sell"))
    d = d.join(d.groupBy(SYMBOL).agg(F.max(DATE).alias(DATE)), [SYMBOL, DATE]).join(flagged, [SYMBOL, "broker"], "left")
    return _flagged_buying(d, [SYMBOL], volume, known, min_volume_ratio, instant_ratio)


def quick_turn_penalties(brokers: DataFrame, volume: DataFrame, known: list[int], dates: DataFrame | None = None, *, min_events: int = 3, min_volume_ratio: float = 0.05, instant_ratio: float = 0.1) -> DataFrame:
    """D8 at every date, or at those of ``dates``: a broker counts as flagged from the day of its ``min_events``-th quick sale on.

    ``volume`` holds (symbol, date, avg_volume_20d).  What was known of a broker is taken from all dates.
    """
    w = symbol_window(key=[SYMBOL, "broker"])
    d = brokers.withColumn("net", F.col("buy") - F.col("sell"))
    sold, known_on = d, None
    for i in (1, 2, 3):
        sold = sold.withColumns({f"_s{i}": F.lead("net", i).over(w), f"_d{i}": F.lead(DATE, i).over(w)})
        hit = (F.col(f"_s{i}") < 0) & (-F.col(f"_s{i}") >= F.col("net") * 0.7)
        known_on = F.when(hit, F.col(f"_d{i}")) if known_on is None else known_on.when(hit, F.col(f"_d{i}"))
    sold = sold.where(F.col("net") > 0).withColumn("_since", known_on).where(F.col("_since").isNotNull())
    nth = F.row_number().over(Window.partitionBy(SYMBOL, "broker").orderBy("_since", DATE))
    since = sold.withColumn("_k", nth).where(F.col("_k") == min_events).select(SYMBOL, "broker", "_since")
    d = d if dates is None else d.join(dates, DATE, "left_semi")
    d = d.join(since, [SYMBOL, "broker"], "left").withColumn("_dt", F.col("_since") <= F.col(DATE)).drop("_since")
    return _flagged_buying(d, [SYMBOL, DATE], volume, known, min_volume_ratio, instant_ratio)


def _flagged_buying(d: DataFrame, by: list[str], volume: DataFrame, known: list[int], min_volume_ratio: float, instant_ratio: float) -> DataFrame:
    is_known = F.col("broker").isin(known)
    d = d.withColumn("_dt", F.coalesce("_dt", F.lit(False)) | is_known)
    top = F.array_sort(F.collect_list(F.when(F.col("_dt"), F.struct((-F.col("net")).alias("n"), F.col("broker")))))
    g = d.groupBy(*by).agg(
        F.greatest(F.coalesce(F.sum(F.when(F.col("_dt"), F.col("net"))), F.lit(0.0)), F.lit(0.0)).alias("_x"),
        F.sum(F.greatest("net", F.lit(0.0))).alias("_p"),
        F.max(F.when(is_known, F.col("buy"))).alias("_kb"),
        F.sum("buy").alias("_b"),
        top.alias("_top"),  # at most one entry per broker
    )
    g = g.join(volume, by, "left")
    p = F.when((F.col("_p") <= 0) | (F.col("_x") <= 0), 0.0).otherwise(F.least(F.lit(1.0), F.col("_x") / F.when(F.col("_p") > 0, F.col("_p"))))
    p = F.when((F.col("_b") > 0) & (F.col("_kb") / F.when(F.col("_b") > 0, F.col("_b")) >= instant_ratio), F.greatest(p, F.lit(0.5))).otherwise(p)
    small = (F.col("avg_volume_20d") > 0) & (F.col("_x") < F.col("avg_volume_20d") * min_volume_ratio)
    p = F.when(small, p * 0.5).otherwise(p)
    names = F.array_join(F.transform(F.slice("_top", 1, 3), lambda s: s["broker"].cast("string")), ",")
    return g.select(*by, p.alias("daytrade_penalty"), (p > 0).alias("has_daytrade_risk"), names.alias("top_dt_brokers"))


def once(x: Column, use) -> Column:
    """``use(x)`` with ``x`` evaluated a single time, however often ``use`` names it: lambdas share no subexpressions."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def broker_ledger(brokers: DataFrame, recent: int = 3) -> DataFrame:
    """The ledger of `ledger_states` after the last row of each (symbol, broker)."""
    return ledger_states(brokers, recent, only_last=True).drop(DATE)


def ledger_states(brokers: DataFrame, recent: int = 3, only_last: bool = False) -> DataFrame:
    """Moving-average-cost ledger per (symbol, broker) after each of its dated rows: one scan that keeps every state.

    A series has one row per date, so the scanned array is bounded by the calendar.
    """
    num = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    row = F.struct(DATE, num("buy"), num("sell"), num("buy_price"), num("sell_price"))
    g = brokers.groupBy(SYMBOL, "broker").agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    zero = F.lit(0.0)
    none = F.lit(0).cast("long")
    sums = ("cost", "pos", "gain", "loss", "bought", "buys_all", "sells_all")
    init = F.struct(*[zero.alias(c) for c in sums], none.alias("wins"), none.alias("sells"))

    def step(s, r):
        buys = (r["buy"] > 0) & (r["buy_price"] > 0)
        pos = F.when(buys, s["pos"] + r["buy"]).otherwise(s["pos"])
        cost = F.when(buys & (pos > 0), (s["cost"] * s["pos"] + r["buy_price"] * r["buy"]) / F.when(pos > 0, pos)).otherwise(s["cost"])
        sells = lambda t: (r["sell"] > 0) & (r["sell_price"] > 0) & (t["cost"] > 0)
        pnl = lambda t: F.when(sells(t), (r["sell_price"] - t["cost"]) * r["sell"]).otherwise(0.0)
        done = lambda t, pnl: F.struct(
            t["cost"].alias("cost"),
            F.when(sells(t), F.greatest(zero, t["pos"] - r["sell"])).otherwise(t["pos"]).alias("pos"),
            (s["gain"] + F.when(pnl > 0, pnl).otherwise(0.0)).alias("gain"),
            (s["loss"] + F.when(pnl < 0, -pnl).otherwise(0.0)).alias("loss"),
            (s["bought"] + F.when(buys, r["buy"] * r["buy_price"]).otherwise(0.0)).alias("bought"),
            (s["buys_all"] + r["buy"]).alias("buys_all"),
            (s["sells_all"] + r["sell"]).alias("sells_all"),
            (s["wins"] + F.when(pnl > 0, 1).otherwise(0)).alias("wins"),
            (s["sells"] + F.when(sells(t), 1).otherwise(0)).alias("sells"),
        )
        return once(F.struct(pos.alias("pos"), cost.alias("cost")), lambda t: once(pnl(t), lambda x: done(t, x)))

    start = F.struct(init.alias("now"), F.slice(F.array(init), 1, 0).alias("all"))

    def keep(s, r):
        return once(step(s["now"], r), lambda now: F.struct(now.alias("now"), F.concat(s["all"], F.array(now)).alias("all")))

    g = g.withColumn("_all", F.aggregate("_rows", start, keep, lambda s: s["all"]))
    at = lambda k: F.coalesce(F.get("_all", k)["buys_all"] - F.get("_all", k)["sells_all"], zero)
    def out(s, k):
        net, half = at(k), at(F.floor((k + 1) / 2).cast("int") - 1)
        return F.struct(
            F.get("_rows", k)[DATE].alias(DATE),
            F.coalesce(s["wins"] / F.when(s["sells"] > 0, s["sells"]), zero).alias("win_rate"),
            F.when(s["loss"] > 0, s["gain"] / F.when(s["loss"] > 0, s["loss"])).when(s["gain"] > 0, 999.0).otherwise(0.0).alias("profit_factor"),
            s["sells"].alias("sell_events"),
            s["bought"].alias("total_buy_value"),
            (s["gain"] - s["loss"]).alias("hist_pnl"),
            (net - at(k - recent)).alias("recent_net"),
            s["pos"].alias("net_position"),
            s["cost"].alias("avg_cost"),
            (net - half > half).alias("trend_up"),
            F.coalesce(s["sells_all"] / F.when(s["buys_all"] > 0, s["buys_all"]), zero).alias("sell_ratio"),
        )

    # rows leave as they are, without the arrays that they were taken from
    rows = out(F.element_at("_all", -1), F.size("_rows") - 1) if only_last else F.explode(F.transform("_all", out))
    return g.select(SYMBOL, "broker", rows.alias("_out")).select(SYMBOL, "broker", "_out.*")


LEDGER = ["win_rate", "profit_factor", "sell_events", "total_buy_value", "hist_pnl", "recent_net", "net_position", "avg_cost", "trend_up", "sell_ratio"]


#: Rows of series that are folded together.
LEDGER_ROWS = 100_000


def ledger_rows(brokers: DataFrame, recent: int = 3, follow: str | None = None, at_once: int = LEDGER_ROWS) -> DataFrame:
    """The rows of `ledger_states`; with ``follow``, that column too and as ``_next`` its value at the series' next row.

    The series of a batch are folded side by side in numpy, a row of each at a time. Rows arrive in the order of their
    series and go on as columns; they don't lie by symbol afterwards.
    """
    num = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    w = Window.partitionBy(SYMBOL, "broker").orderBy(DATE, "buy", "sell", "buy_price", "sell_price")
    more = [follow] if follow else []
    d = brokers.select(SYMBOL, "broker", DATE, *more, num("buy"), num("sell"), num("buy_price"), num("sell_price")).withColumn("_k", F.row_number().over(w))
    kind = {f.name: f.dataType.simpleString() for f in d.schema}
    out = [SYMBOL, "broker", DATE, *more]
    schema = ", ".join([f"{c} {kind[c]}" for c in out] + ([f"_next {kind[follow]}"] if follow else []))
    schema += ", " + ", ".join(f"{c} {'bigint' if c == 'sell_events' else 'boolean' if c == 'trend_up' else 'double'}" for c in LEDGER)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def done(t):
            yield from folded(t, out, follow, recent).to_batches()

        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= at_once:
                t = pa.Table.from_batches(held)
                first = np.flatnonzero(t["_k"].to_numpy() == 1)[-1]  # the last series may go on
                if first:
                    yield from done(t.slice(0, first))
                    t = t.slice(first)
                held, n = t.to_batches(), t.num_rows
        if n:
            yield from done(pa.Table.from_batches(held))

    return d.mapInArrow(run, schema)


def folded(t, out: list[str], follow: str | None, recent: int):
    """Whole series of an Arrow table, in order, with the ledger after each row."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    k = t["_k"].to_numpy().astype(np.int64) - 1
    buy, sell, paid, got = (t[c].to_numpy() for c in ("buy", "sell", "buy_price", "sell_price"))
    above = lambda x: (x > 0) | np.isnan(x)  # Spark's order, in which NaN is largest
    n = len(k)
    start = np.flatnonzero(k == 0)
    length = np.diff(np.append(start, n))
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    sums = ("cost", "pos", "gain", "loss", "bought", "buys_all", "sells_all")
    s = {c: np.zeros(len(start)) for c in sums} | {c: np.zeros(len(start), np.int64) for c in ("wins", "sells")}
    all_ = {c: np.empty(n, v.dtype) for c, v in s.items()}
    with np.errstate(all="ignore"):
        for i in range(int(length[0])):
            m = int(np.searchsorted(-length, -i, "left"))  # series with more than i rows
            at = start[:m] + i
            b, x, bp, sp = buy[at], sell[at], paid[at], got[at]
            now = {c: v[:m] for c, v in s.items()}
            buys = above(b) & above(bp)
            pos = np.where(buys, now["pos"] + b, now["pos"])
            cost = np.where(buys & above(pos), (now["cost"] * now["pos"] + bp * b) / pos, now["cost"])
            sells = above(x) & above(sp) & above(cost)
            pnl = np.where(sells, (sp - cost) * x, 0.0)
            new = {
                "cost": cost,
                "pos": np.where(sells, np.maximum(0.0, pos - x), pos),
                "gain": now["gain"] + np.where(above(pnl), pnl, 0.0),
                "loss": now["loss"] + np.where(pnl < 0, -pnl, 0.0),
                "bought": now["bought"] + np.where(buys, b * bp, 0.0),
                "buys_all": now["buys_all"] + b,
                "sells_all": now["sells_all"] + x,
                "wins": now["wins"] + above(pnl),
                "sells": now["sells"] + sells,
            }
            for c, v in new.items():
                s[c][:m] = v
                all_[c][at] = v
        net = all_["buys_all"] - all_["sells_all"]
        row = np.arange(n)
        earlier = lambda j: np.where(j >= 0, net[np.maximum(row - k + j, 0)], 0.0)
        half = earlier((k + 1) // 2 - 1)
        a = all_
        profit = np.where(above(a["loss"]), a["gain"] / a["loss"], np.where(above(a["gain"]), 999.0, 0.0))
        rest = net - half
        cols = {
            "win_rate": np.where(a["sells"] > 0, a["wins"] / a["sells"], 0.0),
            "profit_factor": profit,
            "sell_events": a["sells"],
            "total_buy_value": a["bought"],
            "hist_pnl": a["gain"] - a["loss"],
            "recent_net": net - earlier(k - recent),
            "net_position": a["pos"],
            "avg_cost": a["cost"],
            "trend_up": (rest > half) | (np.isnan(rest) & ~np.isnan(half)),
            "sell_ratio": np.where(above(a["buys_all"]), a["sells_all"] / a["buys_all"], 0.0),
        }
    nxt = {}
    if follow:
        ahead = np.where(np.append(k[1:], 0) > 0, row + 1, n)  # the series' next row, if there is one
        nxt = {"_next": pc.take(t[follow], pa.array(np.where(ahead < n, ahead, 0), mask=ahead >= n))}
    return pa.table({c: t[c] for c in out} | nxt | {c: pa.array(v, from_pandas=False) for c, v in cols.items()})


def broker_kinds(min_win_rate: float, min_profit_factor: float, min_sell_events: int, min_buy_value: float) -> tuple[Column, Column]:
    """Whether a ledger shows a broker that has done well, and one that accumulates."""
    c = F.col
    enough = c("total_buy_value") >= min_buy_value
    smart = (c("win_rate") >= min_win_rate) & (c("profit_factor") >= min_profit_factor) & (c("sell_events") >= min_sell_events) & enough
    return smart, (c("sell_ratio") <= 0.1) & (c("net_position") > 0) & enough & c("trend_up")


def smart_broker_score(
    ledger: DataFrame,
    prices: DataFrame,
    xs: CrossSection,
    *,
    min_win_rate: float = 0.6,
    min_profit_factor: float = 1.5,
    min_sell_events: int = 3,
    min_buy_value: float = 5_000_000.0,
    by: str | None = None,
) -> DataFrame:
    """Percent-rank blend of profitable and of accumulating brokers; prices (symbol, close).

    With ``by`` (a date) the ledger and the prices have that column, and ranks are taken inside it.
    """
    more = [by] if by else []
    c = F.col
    smart, accum = broker_kinds(min_win_rate, min_profit_factor, min_sell_events, min_buy_value)
    # with dates every priced name counts, and brokers of neither kind can be left out of the ledger
    d = ledger.join(prices, [SYMBOL, *more], "right" if by else "left")
    gap = F.when((c("close") > 0) & (c("avg_cost") > 0), (c("close") - c("avg_cost")) / F.when(c("avg_cost") > 0, c("avg_cost"))).otherwise(0.0)
    z = lambda a: F.coalesce(a, F.lit(0.0))
    g = d.groupBy(SYMBOL, *more).agg(
        F.count_if(smart | accum).alias("n_smart"),
        z(F.sum(F.when(smart & (c("recent_net") > 0), c("hist_pnl") * c("recent_net")))).alias("raw"),
        z(F.avg(F.when(smart, c("win_rate")))).alias("wr"),
        z(F.avg(F.when(smart, F.least(c("profit_factor"), F.lit(10.0))))).alias("pf"),
        z(F.avg(F.when(smart & (c("net_position") > 0), gap))).alias("un"),
        F.sum(F.when(accum, 1.0).otherwise(0.0)).alias("ac"),
        z(F.avg(F.when(accum, gap))).alias("px"),
        z(F.avg(F.when(accum, F.lit(1.0)))).alias("ts"),
        F.lit(1).alias("_g"),
    )
    if by:  # as the twin has them, so that equal values tie
        g = g.withColumns({"raw": F.round("raw", 3), **{k: F.round(k, 9) for k in ("wr", "pf", "un", "px")}})
    g = xs.pct_rank(g, by or "_g", {f"r_{k}": (k, True) for k in ("raw", "wr", "pf", "un", "ac", "px", "ts")})
    g = g.withColumns(
        {
            "smart_broker_score": c("r_raw") * 0.4 + c("r_wr") * 0.25 + c("r_pf") * 0.25 + c("r_un") * 0.1,
            "accum_broker_score": c("r_ac") * 0.4 + c("r_px") * 0.35 + c("r_ts") * 0.25,
        }
    )
    g = g.withColumn("smart_broker_factor", c("smart_broker_score") * 0.6 + c("accum_broker_score") * 0.4)
    return g.select(SYMBOL, *more, "smart_broker_score", "accum_broker_score", "smart_broker_factor", *(["n_smart"] if by else []))


def key_player_cost(brokers: DataFrame, top_n: int = 3, days: int = 60) -> DataFrame:
    """Average buy price of the strongest net buyers in the last ``days`` days."""
    b = last_window(brokers, days)
    g = b.groupBy(SYMBOL, "broker").agg(
        F.sum(F.col("buy") - F.col("sell")).alias("_n"),
        F.sum(F.when(F.col("buy_price").isNotNull(), F.col("buy") * F.col("buy_price"))).alias("_v"),
        F.sum(F.when(F.col("buy_price").isNotNull() & (F.col("buy") > 0), F.col("buy"))).alias("_q"),
    )
    w = Window.partitionBy(SYMBOL).orderBy(F.desc("_n"), "broker")
    g = g.where(F.col("_n") > 0).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= top_n)
    return g.groupBy(SYMBOL).agg(div(F.sum("_v"), F.sum("_q")).alias("key_player_cost"))


def last_window(df: DataFrame, days: int) -> DataFrame:
    """Rows within ``days`` days of the latest date of the table."""
    return df.where(F.col(DATE) >= F.date_sub(df.agg(F.max(DATE)).scalar(), days))


def key_player_score(cost, price) -> Column:
    """Price below the cost of the key players scores high."""
    r = price / F.when(cost > 0, cost)
    return F.when(r < 0.95, 0.8).when(r > 1.10, 0.2).otherwise(0.5)


def abnormal_rate(ann: DataFrame, recent: int = 10, baseline: int = 180) -> DataFrame:
    """Z-score of the recent announcement count against earlier bins of equal length."""
    n = baseline // recent - 1
    d = ann.withColumn("_age", F.datediff(ann.agg(F.max(DATE)).scalar(), DATE)).where(F.col("_age") <= baseline)
    age = F.col("_age")
    # bin k > 0 covers (recent*k, recent*(k+1)] days back; the recent bin includes its edge
    k = F.when(age <= recent, 0).otherwise(F.ceil(age / recent) - 1)
    per = d.groupBy(SYMBOL, k.alias("k")).agg(F.count(F.lit(1)).alias("c"))
    base = F.when(F.col("k").between(1, n), F.col("c")).otherwise(0)
    g = per.groupBy(SYMBOL).agg(
        F.sum(F.when(F.col("k") == 0, F.col("c")).otherwise(0)).alias("recent_count"),
        (F.sum(base) / n).alias("mu"),
        (F.sum(base * base) / n).alias("_sq"),
    )
    sd = F.sqrt(F.greatest(F.col("_sq") - F.col("mu") * F.col("mu"), F.lit(0.0)))
    return g.select(SYMBOL, "recent_count", "mu", ((F.col("recent_count") - F.col("mu")) / F.greatest(sd, F.lit(1.0))).alias("abnormal_z"))


def ratios(st: DataFrame) -> DataFrame:
    """Free cash flow, margins, returns and debt ratio in percent."""
    pct = lambda a, b: div(a, b) * 100
    return st.withColumns(
        {
            "free_cf": F.col("operating_cf") + F.col("investing_cf"),
            "gross_margin": pct("gross_profit", "revenue"),
            "operating_margin": pct("operating_income", "revenue"),
            "net_margin": pct("net_income", "revenue"),
            "roe": pct("net_income", "equity"),
            "roa": pct("net_income", "total_assets"),
            "debt_ratio": pct(F.col("total_assets") - F.col("equity"), "total_assets"),
        }
    )


def earnings_quality(st: DataFrame) -> DataFrame:
    """Cash backing, growth consistency and leverage, averaged."""
    c = F.col
    cash = div("operating_cf", "net_income")
    pr_, pn = F.lag("revenue").over(W()), F.lag("net_income").over(W())
    rg = (c("revenue") - pr_) / F.when(pr_ != 0, F.abs(pr_))
    ng = (c("net_income") - pn) / F.when(pn != 0, F.abs(pn))
    a = F.when(cash > 1, 1.0).when(cash > 0.5, 0.6).when(cash.isNotNull(), 0.2).otherwise(0.5)
    b = F.when(ng > rg + 0.2, 0.3).when((ng <= rg + 0.2), 0.8).otherwise(0.5)
    d = F.when(c("debt_ratio") < 50, 0.8).when(c("debt_ratio") < 70, 0.5).when(c("debt_ratio").isNotNull(), 0.2).otherwise(0.5)
    return st.withColumns({"_b": b}).withColumn("earnings_quality", (a + c("_b") + d) / 3).drop("_b")


def quality_score(st: DataFrame, xs: CrossSection) -> DataFrame:
    """Rank of the year-on-year margin change and sign of free cash flow, by date."""
    prior = st.select(SYMBOL, (F.col("year") + 1).alias("year"), "quarter", F.col("gross_margin").alias("_pg"))
    d = st.join(prior, [SYMBOL, "year", "quarter"], "left").withColumn("gm_yoy_change", F.col("gross_margin") - F.col("_pg"))
    d = xs.pct_rank(d, DATE, {"_r": ("gm_yoy_change", True)})
    d = xs.with_stats(d, DATE, {"_n": F.count("gm_yoy_change")})
    r = F.when(F.col("_n") >= 2, F.coalesce("_r", F.lit(0.5))).otherwise(0.5)
    f = F.when(F.col("free_cf") > 0, 1.0).when(F.col("free_cf").isNotNull(), 0.0).otherwise(0.5)
    return d.withColumn("quality_score", 0.6 * r + 0.4 * f).drop("_r", "_n", "_pg")


def peer_ranking(st: DataFrame, info: DataFrame, xs: CrossSection, bonus: float = 0.03) -> DataFrame:
    """Mean industry percentile of ROE, gross margin and revenue -> bonus."""
    d = st.join(info.select(SYMBOL, "industry"), SYMBOL)
    by = [DATE, "industry"]
    d = xs.pct_rank(d, by, {"_a": ("roe", True), "_b": ("gross_margin", True), "_c": ("revenue", True)})
    d = xs.with_stats(d, by, {"_n": F.count(F.lit(1))})
    avg = F.round(mean_of("_a", "_b", "_c"), 12)
    out = F.when(F.col("_n") < 4, 0.0).when(avg >= 0.75, bonus).when(avg <= 0.25, -bonus).otherwise(0.0)
    return d.withColumns({"peer_rank": avg, "peer_rank_bonus": out}).drop("_a", "_b", "_c", "_n")


def revenue_acceleration(rev: DataFrame, run: int = 3) -> DataFrame:
    """Streak of rising growth plus three-row acceleration -> score."""
    d = rev.withColumns({"_p": F.lag("yoy_growth").over(W()), "_q": F.lag("yoy_growth", 3).over(W())})
    d = d.where(F.col("yoy_growth").isNotNull())
    d = d.withColumn("_p", F.lag("yoy_growth").over(W()))
    d = streak(d, F.col("yoy_growth") > F.col("_p"), "consecutive_accel_months")
    acc, n = F.col("yoy_growth") - F.col("_q"), F.col("consecutive_accel_months")
    s = F.when((acc > 10) & (n >= run), 0.9).when(n >= run, 0.75).when(acc > 0, 0.6).when(acc <= 0, 0.3).otherwise(0.5)
    return d.withColumn("rev_accel_score", s).drop("_p", "_q")


INVESTOR_WEIGHTS = {"trust": 0.7, "foreign": 0.3}


def investor_weighted(flow_long: DataFrame, weights=None) -> DataFrame:
    """Net flow weighted by investor type; other types get what remains of 1."""
    wt = weights or INVESTOR_WEIGHTS
    rest = max(1.0 - sum(wt.values()), 0.0)
    w = F.lit(rest)
    for k, v in wt.items():
        w = F.when(F.col("investor") == k, v).otherwise(w)
    return flow_long.withColumn("weighted_net", F.col("net") * w)


def sector_flow(flow_long: DataFrame, info: DataFrame, days: int | None = None) -> DataFrame:
    """Investor-weighted net per industry over the last ``days`` flow dates."""
    f = flow_long
    if days:
        f = recent_dates(f, days)
    s = investor_weighted(f).groupBy(SYMBOL).agg(F.sum("weighted_net").alias("net"))
    g = s.join(info.select(SYMBOL, "industry"), SYMBOL).groupBy("industry")
    g = g.agg(F.sum("net").alias("total_net"), F.count(F.lit(1)).alias("stock_count"))
    return g.withColumn("avg_net_per_stock", F.col("total_net") / F.col("stock_count"))


def recent_dates(df: DataFrame, n: int, skip: int = 0) -> DataFrame:
    """Rows of the last n distinct dates of the table (after skipping ``skip``)."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc(DATE))  # distinct dates only
    cal = df.select(DATE).distinct().withColumn("_o", F.row_number().over(w))
    cal = cal.where(F.col("_o").between(skip + 1, skip + n)).select(DATE)
    return df.join(cal, DATE, "left_semi")


def window_return(bars: DataFrame, rows: int) -> DataFrame:
    """First-to-last return of the latest ``rows`` bars per symbol."""
    d = last_rows(bars.select(SYMBOL, DATE, "close"), rows)
    g = d.groupBy(SYMBOL).agg(
        F.min_by("close", DATE).alias("_a"), F.max_by("close", DATE).alias("_b"), F.count(F.lit(1)).alias("n")
    )
    return g.where((F.col("n") >= 2) & (F.col("_a") > 0)).select(SYMBOL, (F.col("_b") / F.col("_a") - 1).alias("ret"))


def sector_momentum(bars: DataFrame, info: DataFrame, rows: int = 60) -> DataFrame:
    """Mean member return by industry, in percent."""
    r = window_return(bars, rows).join(info.select(SYMBOL, "industry"), SYMBOL)
    return r.groupBy("industry").agg((F.avg("ret") * 100).alias("avg_return_pct"), F.count(F.lit(1)).alias("n_stocks"))


def sector_flow_acceleration(flows: DataFrame, info: DataFrame, recent: int = 5, base: int = 15) -> DataFrame:
    """Mean net per date of the recent dates minus that of the dates before."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc(DATE))  # distinct dates only
    cal = flows.select(DATE).distinct().withColumn("_o", F.row_number().over(w)).where(F.col("_o") <= recent + base)
    d = flows.join(cal, DATE).join(info.select(SYMBOL, "industry"), SYMBOL)
    r = F.sum(F.when(F.col("_o") <= recent, F.col("total_net")).otherwise(0.0)) / recent
    b = F.sum(F.when(F.col("_o") > recent, F.col("total_net")).otherwise(0.0)) / base
    return d.groupBy("industry").agg((r - b).alias("flow_acceleration"))


def sector_relative_strength(bars: DataFrame, info: DataFrame, xs: CrossSection, rows: int = 20, bonus: float = 0.03) -> DataFrame:
    """Return beyond the industry median by max(1.5 sigma, 5 %)."""
    return relative_strength_in(window_return(bars, rows).join(info.select(SYMBOL, "industry"), SYMBOL), xs, ["industry"], bonus)


def relative_strength_in(r: DataFrame, xs: CrossSection, by: list[str], bonus: float = 0.03) -> DataFrame:
    """D22 inside every group `by` of returns `ret`."""
    r = xs.with_quantiles(r, by, {"_med": ("ret", 0.5)})
    r = xs.with_stats(r, by, {"_sd": F.stddev_samp("ret"), "_n": F.count("ret")})
    thr = F.when(F.col("_n") >= 3, F.greatest(1.5 * F.col("_sd"), F.lit(0.05))).otherwise(0.08)
    d = F.col("ret") - F.col("_med")
    more = [c for c in by if c != "industry"]
    return r.select(SYMBOL, *more, "industry", "ret", F.when(d > thr, bonus).when(d < -thr, -bonus).otherwise(0.0).alias("relative_strength_bonus"))


def concept_mean(values: DataFrame, members: DataFrame, value: str, out: str) -> DataFrame:
    """Mean of a per-symbol value over the members of each concept."""
    g = members.join(values, SYMBOL).groupBy("concept")
    return g.agg(F.avg(value).alias(out), F.count(F.lit(1)).alias("n_members"))


# -- detectors -------------------------------------------------------------------


def volume_spike(bars: DataFrame, rows: int = 10, factor: float = 2.0) -> DataFrame:
    """Latest volume at least ``factor`` times the mean of the rows before."""
    avg = F.avg("volume").over(W().rowsBetween(-rows, -1))
    d = last_rows(bars.select(SYMBOL, DATE, F.col("volume").alias("today_vol"), avg.alias("avg_vol")))
    d = d.withColumn("vol_ratio", div("today_vol", "avg_vol"))
    return d.where(F.col("vol_ratio") >= factor)


def investor_buy(flow_long: DataFrame, threshold: float) -> DataFrame:
    """Foreign net on the latest foreign date above a threshold."""
    f = last_date(flow_long.where(F.col("investor") == "foreign"))
    return f.groupBy(SYMBOL).agg(F.sum("net").alias("inst_net")).where(F.col("inst_net") > threshold)


def lending_spike(lending: DataFrame, rows: int = 10, sigma: float = 2.0) -> DataFrame:
    """Latest lending change beyond ``sigma`` deviations of the rows before."""
    h = W().rowsBetween(-rows, -1)
    d = lending.select(
        SYMBOL,
        DATE,
        "sbl_change",
        F.avg("sbl_change").over(h).alias("sbl_mean"),
        F.stddev_samp("sbl_change").over(h).alias("sbl_std"),
    )
    d = last_rows(d)
    z = (F.col("sbl_change") - F.col("sbl_mean")) / F.when(F.col("sbl_std") > 0, F.col("sbl_std"))
    return d.where((F.col("sbl_change") > 0) & (z >= sigma))


def broker_concentration(brokers: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Concentrated net buying on the latest date of each symbol."""
    d = last_rows(daily_hhi(brokers))
    return d.where((F.col("hhi") >= threshold) & (F.col("net_total") > 0))


def revenue_scan(rev: DataFrame, st: DataFrame, xs: CrossSection, min_yoy: float, min_margin: float) -> DataFrame:
    """Latest growth with the change of gross margin, ranked 0.7 / 0.3."""
    r = last_rows(rev)
    m = st.withColumn("margin_change", F.col("gross_margin") - F.lag("gross_margin").over(W()))
    m = last_rows(m).select(SYMBOL, "gross_margin", "margin_change")
    d = r.join(m, SYMBOL, "left")
    d = d.where((F.col("yoy_growth") >= min_yoy) & (F.col("margin_change").isNull() | (F.col("margin_change") >= min_margin)))
    d = xs.pct_rank(d.withColumn("_g", F.lit(1)), "_g", {"_y": ("yoy_growth", True), "_m": ("margin_change", True)})
    score = 0.7 * F.col("_y") + 0.3 * F.coalesce("_m", F.lit(0.5))
    return d.select(SYMBOL, DATE, "yoy_growth", "mom_growth", "gross_margin", "margin_change", score.alias("scan_score"))


def market_breadth(bars: DataFrame) -> DataFrame:
    """Rising, falling and flat names and total volume per date."""
    d = bars.withColumn("_s", F.col("close") - F.lag("close").over(W()))
    return d.groupBy(DATE).agg(
        F.count_if(F.col("_s") > 0).alias("rising"),
        F.count_if(F.col("_s") < 0).alias("falling"),
        F.count_if(F.col("_s") == 0).alias("flat"),
        F.sum("volume").alias("total_volume"),
    )


def below_mean_share(bars: DataFrame, n: int = 20, min_periods: int = 10) -> DataFrame:
    """Share of names that close below their moving average, per date."""
    ma = F.when(F.count("close").over(trailing(n)) >= min_periods, F.avg("close").over(trailing(n)))
    d = bars.select(DATE, "close", ma.alias("_m")).where(F.col("_m").isNotNull())
    return d.groupBy(DATE).agg(F.avg((F.col("close") < F.col("_m")).cast("int")).alias("breadth_below_ma20_pct"))
