"""Panels derived from the relational tables.

Every panel is pre-aggregated from the raw rows to the grain (symbol, date[, ...]),
so a symbol that owns a third of the raw rows still shrinks to at most one row per
date before any exchange by symbol: with map-side partial aggregation, or for open
and close after an exchange by (symbol, date).
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.crosssection import CrossSection, shared_folder
from ..functions.exprs import div, lookup, symbol_window

PRIORITY_TO_INVESTOR = {"1-URGENT": "foreign", "2-HIGH": "trust", "3-MEDIUM": "dealer"}
EVENT_TO_TYPE = {
    "purchase": "buyback",
    "signup": "investor_day",
    "click": "revenue",
    "view": "general",
    "error": "governance_change",
}
#: Bytes of the lines' files for each bucket of a stored panel.
BUCKET_BYTES = 4_000_000


def monday(d) -> Column:
    return F.date_trunc("week", d).cast("date")


class Panels:
    """Lazy access to the tables under ``root`` and the panels built from them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        # panels dealt out by symbol are joined by (symbol, date) where they lie, not dealt out anew by both
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    #: rows of one date, one per name
    xs = CrossSection()
    #: the same, ranked once by many columns
    xs_columns = CrossSection(columns=True)
    #: all rows of a panel, or of a factor or mode over all dates
    pool = CrossSection(pooled=True)

    def version(self) -> str:
        """Changes when a file under ``root`` does: hash of the tables' names, sizes and times of change."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(conf)
        seen = []
        for f in fs.listStatus(path):
            inside = fs.getContentSummary(f.getPath())
            seen.append((f.getPath().getName(), inside.getLength(), inside.getFileCount(), f.getModificationTime()))
        return hashlib.sha256(repr(sorted(seen)).encode()).hexdigest()[:16]

    def shared(self, name: str, build) -> DataFrame:
        """A derived table that several queries read: written once for each version of the tables, in the folder that
        all executors share.  A lost executor costs a read; changed files give another version."""
        key = (self.root, name, self.version())
        made = self.spark.__dict__.setdefault("_panelwright_shared", {})
        if key not in made:
            path = f"{shared_folder(self.spark)}/derived/{name}-{key[2]}-{uuid.uuid4().hex}"
            build().write.option("compression", "zstd").parquet(path)
            made[key] = path
        return self.spark.read.parquet(made[key])

    def panel(self, name: str, build) -> DataFrame:
        """A panel stored once for each version of the tables, dealt to buckets by symbol and sorted by symbol and date:
        grouping, windows and joins by symbol read it without an exchange.  Raw rows are read once per version."""
        key = (self.root, f"panel {name}", self.version())
        made = self.spark.__dict__.setdefault("_panelwright_shared", {})
        if key not in made:
            table = f"panelwright_{name}_{uuid.uuid4().hex}"
            path = f"{shared_folder(self.spark)}/derived/{table}"
            n = self.buckets()
            df = build()
            order = [c for c in ("symbol", "date") if c in df.columns]
            df.repartition(n, "symbol").write.bucketBy(n, "symbol").sortBy(*order).option("path", path).option("compression", "zstd").saveAsTable(table)
            made[key] = table
        return self.spark.table(made[key])

    def buckets(self) -> int:
        """Buckets of a stored panel: as many as the session's shuffle partitions, and one for each `BUCKET_BYTES` of the
        lines' files at least, so that what a task sorts and holds by symbol doesn't grow with the tables."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/lineitem.parquet")
        size = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))

    def dealt(self, df: DataFrame, *keys: str) -> DataFrame:
        """Rows dealt out by ``keys`` to as many partitions as a panel has buckets, where those are more than the session's;
        else as they are, for the join, window or grouping by ``keys`` that follows to deal out."""
        n, usual = self.buckets(), int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return df.repartition(n, *keys) if n > usual else df

    # -- raw lines ---------------------------------------------------------

    def lines(self) -> DataFrame:
        d = F.col("l_shipdate").cast("date")
        return self.table("lineitem").select(
            F.col("l_suppkey").alias("symbol"),
            d.alias("day"),
            monday(d).alias("week"),
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
            "l_quantity",
            "l_extendedprice",
            "l_discount",
            "l_tax",
            "l_returnflag",
            "l_linestatus",
        )

    def _bars(self, grain: str) -> DataFrame:
        return self.panel(f"bars_{grain}", lambda: self._build_bars(grain))

    def _build_bars(self, grain: str) -> DataFrame:
        # min_by and max_by on a struct aggregate by sorting: rows are dealt out first, so that each is sorted once and
        # travels alone, not as a partial state of two structs and sums for almost every row
        return self._open_to_close(self.dealt(self.lines().repartition("symbol", grain), "symbol", grain).groupBy("symbol", F.col(grain).alias("date")))

    def _open_to_close(self, lines) -> DataFrame:
        """Bars of grouped lines."""
        px = F.col("l_extendedprice") / F.col("l_quantity")
        tie = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
        return lines.agg(
            F.min_by(px, tie).alias("open"),
            F.max(px).alias("high"),
            F.min(px).alias("low"),
            F.max_by(px, tie).alias("close"),
            F.sum("l_quantity").alias("volume"),
            F.sum("l_extendedprice").alias("turnover"),
        )

    def bars(self) -> DataFrame:
        """Weekly OHLCV, keyed by the Monday."""
        return self._bars("week")

    def bars_daily(self) -> DataFrame:
        return self._bars("day")

    def bars_daily_of(self, week: str, end: Column) -> DataFrame:
        """Daily bars with the end of their week, `end` of `day`, as column `week`.  They lie by (symbol, week) and aren't
        stored, for a reader that groups them by week next."""
        x = self.lines().withColumn(week, end)
        x = self.dealt(x.repartition("symbol", week), "symbol", week)
        return self._open_to_close(x.groupBy("symbol", week, F.col("day").alias("date")))

    def closes(self, grain: str = "week") -> DataFrame:
        """(symbol, date, close, volume) only."""
        return self._bars(grain).select("symbol", "date", "close", "volume")

    def index(self, grain: str = "week") -> DataFrame:
        """Market series: one row per date, close = turnover / volume over all names."""
        px = F.col("l_extendedprice") / F.col("l_quantity")
        return (
            self.lines()
            .groupBy(F.col(grain).alias("date"))
            .agg(
                (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"),
                F.max(px).alias("high"),
                F.min(px).alias("low"),
                F.sum("l_quantity").alias("volume"),
            )
            .withColumn("market", F.lit("ALL"))
        )

    def info(self) -> DataFrame:
        n, r = self.table("nation"), self.table("region")
        return (
            self.table("supplier")
            .join(n, F.col("s_nationkey") == F.col("n_nationkey"))
            .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("s_suppkey").alias("symbol"),
                F.col("s_name").alias("name"),
                F.col("n_name").alias("industry"),
                F.col("r_name").alias("listing_type"),
                "s_acctbal",
            )
        )

    # -- flows -------------------------------------------------------------

    def _lines_orders(self) -> DataFrame:
        o = self.table("orders").select("o_orderkey", "o_custkey", "o_orderpriority")
        return self.dealt(self.lines(), "l_orderkey").join(o, F.col("l_orderkey") == F.col("o_orderkey"))

    def _lines_with_orders(self) -> DataFrame:
        """All lines, those without an order too; `_orders` is the number of orders of a line's key."""
        o = self.dealt(self.table("orders").select("o_orderkey", "o_orderpriority"), "o_orderkey")
        o = o.withColumn("_orders", F.count("o_orderkey").over(Window.partitionBy("o_orderkey")))  # in the order of the join
        return self.dealt(self.lines(), "l_orderkey").join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left")

    def _lines_customers(self, *of_customer) -> DataFrame:
        """Lines with columns of their order's customer: orders meet customers first, so that lines travel once.

        Rows lie by `_part`, which follows from the order: grouped by it and more, they are added up where they lie, before
        they are dealt out by symbol.
        """
        part = lambda key: F.get(F.expr(f"array({', '.join(f'{v}L' for v in self._parts())})"), F.pmod(F.xxhash64(key), F.lit(self.buckets())).cast("int"))
        o = self.table("orders").select("o_orderkey", "o_custkey")
        c = self.table("customer").select("c_custkey", *of_customer)
        o = o.join(c, F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey", "c_custkey").withColumn("_of", part("o_orderkey"))
        x = self.lines().withColumn("_part", part("l_orderkey")).repartition(self.buckets(), "_part")
        return x.join(o, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("_part") == F.col("_of"))).drop("_of")

    def _parts(self) -> list[int]:
        """As many numbers as a panel has buckets, which are dealt out to a partition each."""
        n = self.buckets()
        made = self.spark.__dict__.setdefault("_panelwright_parts", {})
        if n not in made:
            ids = self.spark.range(64 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("id"))
            made[n] = [r.id for r in ids.orderBy("p").collect()]
        return made[n] if len(made[n]) == n else list(range(n))

    def flow_long(self) -> DataFrame:
        """Investor net per (symbol, date, investor)."""
        return self.panel("flow_long", self._build_flow_long)

    def _build_flow_long(self) -> DataFrame:
        net = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
        inv = lookup(F.col("o_orderpriority"), PRIORITY_TO_INVESTOR, "other")
        return (
            self._lines_orders()
            .groupBy("symbol", F.col("week").alias("date"), inv.alias("investor"))
            .agg(F.sum(net).alias("net"))
        )

    def flows(self) -> DataFrame:
        """Wide investor nets per (symbol, date), missing investors as 0."""
        return self.wide().select("symbol", "date", "foreign_net", "trust_net", "dealer_net", "total_net")

    def wide(self) -> DataFrame:
        """Bars, investor nets and running margin balances in one aggregation pass, of the lines that have an order."""
        return self._wide().where("_ordered").drop("_ordered", "_whole")

    def _wide(self) -> DataFrame:
        return self.panel("wide", self._build_wide)

    def bars_beside_wide(self) -> DataFrame:
        """The weekly bars, for queries that read the wide panel too: its own columns where every line has one order, so
        that lines aren't dealt out a second time; else, as wide lacks lines or counts them twice, the panel of the bars."""
        key = (self.root, "wide is whole", self.version())
        known = self.spark.__dict__.setdefault("_panelwright_shared", {})
        if key not in known:
            known[key] = self._wide().where("NOT _whole").isEmpty()
        if not known[key]:
            return self.bars()
        return self._wide().select("symbol", "date", "open", "high", "low", "close", "volume", "turnover")

    def _build_wide(self) -> DataFrame:
        px = F.col("l_extendedprice") / F.col("l_quantity")
        has = F.col("_orders").isNotNull()
        tie = F.when(has, F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"))
        q = F.col("l_quantity")
        net = F.when(F.col("l_returnflag") == "R", -q).otherwise(q)
        inv = lookup(F.col("o_orderpriority"), PRIORITY_TO_INVESTOR, "other")
        of = lambda v: F.when(has, v)
        part = lambda cond, v, name: F.coalesce(F.sum(F.when(has & cond, v)), F.lit(0.0)).alias(name)
        d = (
            self.dealt(self._lines_with_orders().repartition("symbol", "week"), "symbol", "week")  # as in the bars
            .groupBy("symbol", F.col("week").alias("date"))
            .agg(
                F.min_by(px, tie).alias("open"),
                F.max(of(px)).alias("high"),
                F.min(of(px)).alias("low"),
                F.max_by(px, tie).alias("close"),
                F.sum(of(q)).alias("volume"),
                F.sum(of(F.col("l_extendedprice"))).alias("turnover"),
                *[part(inv == k, net, f"{k}_net") for k in ("foreign", "trust", "dealer")],
                F.sum(of(net)).alias("total_net"),
                part(F.col("l_linestatus") == "O", q, "_m"),
                part(F.col("l_returnflag") == "R", q, "_s"),
                F.max(has).alias("_ordered"),
                F.min(F.coalesce(F.col("_orders") == 1, F.lit(False))).alias("_whole"),
            )
        )
        w = symbol_window().rowsBetween(Window.unboundedPreceding, 0)
        d = self.dealt(d, "symbol").withColumns({"margin_balance": F.sum("_m").over(w), "short_balance": F.sum("_s").over(w)})
        return d.drop("_m", "_s")

    def scan_dates(self) -> DataFrame:
        """The last trading week of every month."""
        return self.shared("scan_dates", self._build_scan_dates)

    def _build_scan_dates(self) -> DataFrame:
        w = self.lines().select(F.col("week").alias("date")).distinct()
        return w.groupBy(F.trunc("date", "month").alias("m")).agg(F.max("date").alias("date")).select("date")

    def brokers(self) -> DataFrame:
        """Broker trades per (symbol, date, broker)."""
        return self.panel("brokers", self._build_brokers)

    def _build_brokers(self) -> DataFrame:
        sell = F.col("l_returnflag") == "R"
        q, v = F.col("l_quantity"), F.col("l_extendedprice")
        return (
            self._lines_customers(F.col("c_nationkey").cast("long").alias("broker"))
            .groupBy("_part", "symbol", F.col("week").alias("date"), "broker")
            .agg(F.sum(F.when(~sell, q)).alias("_q"), F.sum(F.when(sell, q)).alias("_r"), F.sum(F.when(~sell, v)).alias("_v"), F.sum(F.when(sell, v)).alias("_w"))
            .repartition(self.buckets(), "symbol")
            .groupBy("symbol", "date", "broker")
            .agg(
                F.coalesce(F.sum("_q"), F.lit(0.0)).alias("buy"),
                F.coalesce(F.sum("_r"), F.lit(0.0)).alias("sell"),
                (F.sum("_v") / F.sum("_q")).alias("buy_price"),
                (F.sum("_w") / F.sum("_r")).alias("sell_price"),
            )
        )

    def margin(self) -> DataFrame:
        """Running open (margin) and returned (short) quantities per (symbol, date)."""
        return self.panel("margin", self._build_margin)

    def _build_margin(self) -> DataFrame:
        q = F.col("l_quantity")
        w = symbol_window().rowsBetween(Window.unboundedPreceding, 0)
        d = (
            self.lines()
            .groupBy("symbol", F.col("week").alias("date"))
            .agg(
                F.coalesce(F.sum(F.when(F.col("l_linestatus") == "O", q)), F.lit(0.0)).alias("m"),
                F.coalesce(F.sum(F.when(F.col("l_returnflag") == "R", q)), F.lit(0.0)).alias("s"),
            )
        )
        return self.dealt(d, "symbol").select("symbol", "date", F.sum("m").over(w).alias("margin_balance"), F.sum("s").over(w).alias("short_balance"))

    def lending(self) -> DataFrame:
        """Securities lending: running returned quantity and its change."""
        w = symbol_window()
        return self.margin().select(
            "symbol",
            "date",
            F.col("short_balance").alias("sbl_balance"),
            (F.col("short_balance") - F.lag("short_balance", 1, 0.0).over(w)).alias("sbl_change"),
        )

    # -- fundamentals ------------------------------------------------------

    def revenue(self) -> DataFrame:
        """Monthly revenue with month-on-month and year-on-year growth in percent."""
        return self.panel("revenue", self._build_revenue)

    def _build_revenue(self) -> DataFrame:
        rev = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
        m = self.lines().groupBy("symbol", F.trunc("day", "month").alias("date")).agg(rev.alias("revenue"))
        w = symbol_window()
        months = F.year("date") * 12 + F.month("date")
        yr = Window.partitionBy("symbol").orderBy(months).rangeBetween(-12, -12)
        prev, last = F.lag("revenue", 1).over(w), F.max("revenue").over(yr)
        return self.dealt(m, "symbol").select(
            "symbol",
            "date",
            "revenue",
            ((F.col("revenue") / prev - 1) * 100).alias("mom_growth"),
            ((F.col("revenue") / last - 1) * 100).alias("yoy_growth"),
        )

    def statements(self) -> DataFrame:
        """Quarterly statements per (symbol, quarter end)."""
        return self.panel("statements", self._build_statements)

    def _build_statements(self) -> DataFrame:
        q, gross = F.col("l_quantity"), F.col("l_extendedprice")
        rev = gross * (1 - F.col("l_discount"))
        part = self.table("part").select("p_partkey", "p_retailprice")
        qend = F.last_day(F.add_months(F.trunc("day", "quarter"), 2))
        f = (
            self.lines()
            .join(part, F.col("l_partkey") == F.col("p_partkey"))
            .groupBy("symbol", qend.alias("date"))
            .agg(
                F.sum(rev).alias("revenue"),
                F.sum(F.col("p_retailprice") * q * 0.4).alias("cost"),
                F.sum(rev * F.col("l_tax")).alias("tax"),
                F.sum(q).alias("shares"),
                F.sum(F.when(F.col("l_linestatus") == "F", rev).otherwise(0.0)).alias("collected"),
            )
        )
        info = self.table("supplier").select(F.col("s_suppkey").alias("symbol"), "s_acctbal")
        w = symbol_window().rowsBetween(Window.unboundedPreceding, 0)
        f = self.dealt(f, "symbol").join(info, "symbol").withColumn("_cum", F.sum("revenue").over(w))
        gp = F.col("revenue") - F.col("cost")
        ni = gp - F.col("tax") * 12
        return f.select(
            "symbol",
            "date",
            "shares",
            F.year("date").cast("long").alias("year"),
            F.quarter("date").cast("long").alias("quarter"),
            "revenue",
            gp.alias("gross_profit"),
            (gp - F.col("tax")).alias("operating_income"),
            ni.alias("net_income"),
            (ni / F.col("shares")).alias("eps"),
            (F.col("_cum") + F.col("s_acctbal") + 20000.0).alias("total_assets"),
            (F.col("_cum") * 0.5 + F.col("s_acctbal") + 20000.0).alias("equity"),
            (F.col("collected") - F.col("cost")).alias("operating_cf"),
            (F.col("cost") * -0.2).alias("investing_cf"),
        )

    def holding(self) -> DataFrame:
        """Holder levels per (symbol, quarter start, level): percent of quantity."""
        return self.panel("holding", self._build_holding)

    def _build_holding(self) -> DataFrame:
        b = F.col("c_acctbal")
        level = (
            F.when(b < 2000, "1-999 Shares")
            .when(b < 4000, "1,000-5,000 Shares")
            .when(b < 6000, "200,001-400,000 Shares")
            .when(b < 8000, "400,001-600,000 Shares")
            .otherwise("more than 1,000,001 Shares")
        )
        d = (
            self._lines_customers("c_acctbal")
            .groupBy("_part", "symbol", F.trunc("day", "quarter").alias("date"), level.alias("level"))
            .agg(F.sum("l_quantity").alias("q"))
            .repartition(self.buckets(), "symbol")
            .groupBy("symbol", "date", "level")
            .agg(F.sum("q").alias("q"))
        )
        # at most five levels per (symbol, date)
        w = Window.partitionBy("symbol", "date")
        return d.select("symbol", "date", "level", (F.col("q") / F.sum("q").over(w) * 100).alias("percent"))

    def valuation(self) -> DataFrame:
        """PE, PB and yield per (symbol, quarter) from trailing statements and turnover price."""
        s = self.statements()
        px = F.col("revenue") / F.col("shares")
        return s.select(
            "symbol",
            "date",
            div(px, F.col("eps")).alias("pe"),
            div(px * 100, F.col("equity")).alias("pb"),
            (F.col("gross_profit") / F.col("revenue") * 10).alias("dividend_yield"),
        )

    # -- text and events ---------------------------------------------------

    def announcements(self) -> DataFrame:
        t = F.col("event_type")
        return self.table("events").select(
            F.col("user_id").alias("symbol"),
            F.col("ts").cast("date").alias("date"),
            F.col("event_id").alias("seq"),
            lookup(t, EVENT_TO_TYPE, "general").alias("event_type"),
            F.when(t == "error", -1).when(t == "purchase", 1).otherwise(0).cast("long").alias("sentiment"),
        )

    def news(self) -> DataFrame:
        """Announcements laid out over the market's dates: the time of an event, as a share of the events' time span, is
        the same share of the days from the first to the last market week."""
        at = F.unix_micros(F.col("ts").cast("timestamp"))
        e = self.table("events").select(F.col("event_id").alias("seq"), at.alias("_at"))
        span = e.agg(F.struct(F.min("_at").alias("lo"), F.max("_at").alias("hi")).alias("s")).scalar()
        weeks = self.lines().agg(F.struct(F.min("week").alias("first"), (F.datediff(F.max("week"), F.min("week")) + 7).cast("long").alias("days")).alias("w")).scalar()
        d = self.announcements().drop("date").join(e, "seq").withColumns({"_s": span, "_w": weeks})
        day = F.expr("(_at - _s.lo) * _w.days div (_s.hi - _s.lo + 1)").cast("int")
        return d.select("symbol", F.date_add("_w.first", day).alias("date"), "seq", "event_type", "sentiment")

    def concepts(self, parts: int = 6) -> DataFrame:
        """(concept, symbol) membership: part types with at least one in ``parts`` of a symbol's lines."""
        p = self.table("part").select("p_partkey", F.col("p_type").alias("concept"))
        return (
            self.lines()
            .join(p, F.col("l_partkey") == F.col("p_partkey"))
            .groupBy("concept", "symbol")
            .agg(F.count(F.lit(1)).alias("n_lines"))
            .withColumn("_all", F.sum("n_lines").over(Window.partitionBy("symbol")))  # one row per part type
            .where(F.col("n_lines") * parts >= F.col("_all"))
            .select("concept", "symbol")
        )

    # -- portfolio ---------------------------------------------------------

    def trades(self) -> DataFrame:
        """Orders as closed trades of the customer's nation portfolio."""
        return self.panel("trades", self._build_trades)

    def _build_trades(self) -> DataFrame:
        o = self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
        c = self.table("customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("portfolio"))
        px = F.col("l_extendedprice") / F.col("l_quantity")
        x = self.lines().groupBy("l_orderkey").agg(
            F.min("symbol").alias("symbol"),
            F.max("day").alias("exit_date"),
            F.min(px).alias("entry_price"),
            F.avg(px).alias("exit_price"),
            F.sum("l_quantity").alias("shares"),
            F.max("l_discount").alias("_disc"),
        )
        return (
            x.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(c, F.col("o_custkey") == F.col("c_custkey"))
            .select(
                F.col("o_orderkey").alias("trade_id"),
                "portfolio",
                "symbol",
                F.least(F.col("o_orderdate").cast("date"), F.col("exit_date")).alias("entry_date"),
                "exit_date",
                "entry_price",
                (F.col("exit_price") * (1 - F.col("_disc") * 3)).alias("exit_price"),
                "shares",
                lookup(F.col("o_orderpriority"), {"1-URGENT": "stop_loss", "2-HIGH": "take_profit"}, "expired").alias("exit_reason"),
            )
        )

    def snapshots(self) -> DataFrame:
        """Weekly capital per portfolio (customer nation), benchmark = index close."""
        gain = F.col("l_extendedprice") * (F.lit(0.05) - F.col("l_discount"))
        d = (
            self._lines_customers(F.col("c_nationkey").cast("long").alias("portfolio"))
            .groupBy("portfolio", F.col("week").alias("date"))
            .agg(F.sum(gain).alias("pnl"))
        )
        w = symbol_window(key="portfolio").rowsBetween(Window.unboundedPreceding, 0)
        return d.select("portfolio", "date", (F.sum("pnl").over(w) + 1_000_000.0).alias("capital"))
