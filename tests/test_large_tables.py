"""What keeps queries within time and disk on large tables: same rows, fewer of them moved, sorted or multiplied."""

import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright.functions.crosssection import CrossSection
from panelwright.functions.timeseries import smooth
from panelwright.operators import flows as fl
from panelwright.operators import indicators as ind
from panelwright.operators import research as rs
from panelwright.operators import scoring as sc
from panelwright.plans import load_plans
from panelwright.plans import pointintime as pt
from panelwright.plans import records as rec
from panelwright.sources.panels import Panels

from .conftest import SF

load_plans()
NAN = float("nan")


def plan_of(df):
    return re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString())


def rows(df, *cols):
    near = lambda v: "nan" if v != v else round(v, 7) if isinstance(v, float) else v
    return sorted((tuple(near(v) for v in r) for r in df.select(*(cols or df.columns)).collect()), key=repr)


def tables(spark, root, lines, orders):
    """Lines (order, number, symbol, day, quantity, price, flag) and orders (key, customer, priority)."""
    d = [(o, 7, s, n, q, x, 0.0, 0.0, f, "O", f"2020-01-{day:02d}") for o, n, s, day, q, x, f in lines]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate string"
    spark.createDataFrame(d, schema).withColumn("l_shipdate", F.to_timestamp_ntz("l_shipdate")).write.parquet(f"{root}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{root}/orders.parquet")
    spark.createDataFrame([(1, 3, 500.0), (2, 4, 2500.0)], "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{root}/customer.parquet")
    return Panels(spark, str(root))


LINES = [(1, 1, 9, 6, 2.0, 20.0, "N"), (2, 1, 9, 7, 1.0, 30.0, "R"), (2, 2, 8, 8, 4.0, 20.0, "A"), (3, 1, 9, 15, 5.0, 25.0, "N")]
ORDERS = [(1, 1, "1-URGENT"), (2, 2, "2-HIGH"), (3, 1, "5-LOW")]
OHLC = ("symbol", "date", "open", "high", "low", "close", "volume", "turnover")


@pytest.mark.parametrize("orders", [ORDERS, ORDERS[:2], [*ORDERS, ORDERS[1]]], ids=["one each", "one missing", "one twice"])
def test_bars_beside_the_wide_panel_are_the_bars(spark, tmp_path, orders):
    p = tables(spark, tmp_path, LINES, orders)
    assert rows(p.bars_beside_wide(), *OHLC) == rows(p._build_bars("week"), *OHLC)
    plain = p._lines_orders().groupBy("symbol", F.col("week").alias("date")).agg(F.sum("l_quantity").alias("volume"), F.max(F.col("l_extendedprice") / F.col("l_quantity")).alias("high"))
    assert rows(p.wide(), "symbol", "date", "volume", "high") == rows(plain)
    assert ("panelwright_wide" in plan_of(p.bars_beside_wide())) == (orders is ORDERS)


@pytest.mark.parametrize("read", [pt.returns, lambda p: load_plans()["c18_calc_returns"].build(p), rec.build_dimension_scores], ids=["bonuses", "returns", "dimensions"])
def test_lines_are_not_dealt_out_again_for_bars_beside_the_wide_panel(spark, read):
    plan = plan_of(read(Panels(spark, SF)))
    assert "bars_week" not in plan


def test_brokers_are_added_up_before_they_are_dealt_out_by_symbol_once(spark, tmp_path):
    p = tables(spark, tmp_path, [*LINES, *LINES], ORDERS)
    got = {tuple(r) for r in p._build_brokers().select("symbol", "broker", "buy", "sell", "buy_price", "sell_price").collect()}
    assert (9, 3, 4.0, 0.0, 10.0, None) in got and (9, 4, 0.0, 2.0, None, 30.0) in got and len(got) == 4
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for build, group in ((p._build_brokers, "broker"), (p._build_holding, "level")):
            plan = plan_of(build().repartition(p.buckets(), "symbol"))
            dealt = re.findall(r"hashpartitioning\((symbol|_part)\b([^)]*), \d+\)", plan)
            assert dealt == [("symbol", ""), ("_part", "")]
            below = plan[plan.index("hashpartitioning(symbol") :]
            assert re.search(rf"HashAggregate\(keys=\[_part, symbol, .*{group}", below[: below.index("hashpartitioning(_part")])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def series(spark, n=700, symbols=3):
    r = random.Random(5)
    d = [(s, i, None if r.random() < 0.1 else 100 + r.gauss(0, 9), float(r.randint(1, 99))) for s in range(symbols) for i in range(n >> s)]
    d = spark.createDataFrame(d, "symbol int, i int, close double, volume double").withColumn("date", F.date_add(F.lit("2010-01-04").cast("date"), F.col("i")))
    return d.withColumns({"open": F.col("close"), "high": F.col("close") + 1, "low": F.col("close") - 1, "total_net": F.col("volume") - 50}).drop("i")


@pytest.mark.parametrize("seed", [0, 14])
def test_smoothing_in_one_block_gives_the_same_rows_in_one_order(spark, seed):
    d = series(spark)
    spec = {"a": ("close", 1 / 14)} if seed else {"a": ("close", 2 / 13), "b": ("close", 2 / 27)}
    one = smooth(d, spec, seed=seed, rows=700)
    assert rows(one) == rows(smooth(d, spec, seed=seed))
    assert set(re.findall(r"Sort \[(.*?)\], false", plan_of(one))) == {"symbol ASC NULLS FIRST, date ASC NULLS FIRST"}
    # beyond double range blocks stay
    assert "_b ASC" in plan_of(smooth(d, spec, seed=seed, rows=1_000_000))


@pytest.mark.parametrize("use", [ind.momentum_decay, ind.flow_macd, ind.macd, ind.rsi])
def test_indicators_with_a_known_number_of_rows(spark, use):
    d = series(spark)
    assert rows(use(d, rows=700)) == rows(use(d))


def test_weeks_of_daily_bars_that_lie_by_week(spark, tmp_path):
    p = tables(spark, tmp_path, [(o, 1, 9, day, 1.0 + o, 10.0 * o, "N") for o in (1, 2, 3) for day in range(1, 31)], ORDERS)
    d = p.bars_daily_of("week_end", ind.friday_week(F.col("day")))
    assert rows(d.drop("week_end")) == rows(p._build_bars("day"))
    got = ind.weekly(d, week_end="week_end", deal=lambda x: p.dealt(x, "symbol"), rows=60)
    assert rows(got) == rows(ind.weekly(p._build_bars("day")))
    assert len(re.findall(r"hashpartitioning\(symbol, week_end", plan_of(got))) == 1 and "hashpartitioning(symbol, date" not in plan_of(got)


@pytest.mark.parametrize("at_once", [1, 40, 100_000])
def test_ledgers_folded_side_by_side(spark, at_once):
    r = random.Random(3)
    some = lambda x: r.choice([None, 0.0, x, x, x])
    d = [(s, b, f"2020-{1 + i // 28:02d}-{1 + i % 28:02d}", some(r.randint(1, 9) * 1.0), some(r.randint(1, 9) * 1.0), some(r.random() * 50), some(r.random() * 50)) for s in (1, 2, None) for b in (1, 2, 3, None) for i in range((s or 3) * (b or 4) * 3)]
    d = spark.createDataFrame(d, "symbol long, broker long, date string, buy double, sell double, buy_price double, sell_price double").withColumn("date", F.col("date").cast("date"))
    cols = ["symbol", "broker", "date", *fl.LEDGER]
    assert rows(fl.ledger_rows(d, at_once=at_once), *cols) == rows(fl.ledger_states(d), *cols)
    follow = fl.ledger_rows(d.withColumn("s", F.dayofyear("date")), follow="s", at_once=at_once).select("symbol", "broker", "date", "_next")
    assert rows(follow) == rows(d.select("symbol", "broker", "date", F.lead(F.dayofyear("date")).over(Window.partitionBy("symbol", "broker").orderBy("date"))))


def test_ranks_of_columns_equal_those_of_windows(spark):
    d = [(k, i, [None, NAN, 1.0, 1.0, -0.0, 0.0, 5.0, NAN][i % 8], [3, 3, None, 7, 1, 1, 2, 9][(i * 5 + k) % 8]) for k in (1, 2, 3) for i in range(19)] + [(4, 1, None, None), (None, 2, 1.0, 2)]
    d = spark.createDataFrame(d, "date int, id int, a double, b long")
    spec = {"ra": ("a", True), "rb": ("b", False), "rc": ("a", False), "rd": ("b", True)}
    want = CrossSection().pct_rank(d, "date", spec)
    got = CrossSection(columns=True).pct_rank(d, "date", spec)
    assert got.columns == want.columns and rows(got) == rows(want)
    assert "Window" not in plan_of(got)


def test_best_rows_are_found_without_sorting_all(spark):
    r = random.Random(1)
    d = [(r.choice(["a", "b", None]), i, r.choice([None, NAN, r.random(), round(r.random(), 1), 0.5, -1e300])) for i in range(900)] + [("few", 1, 0.2), ("few", 2, None)]
    d = spark.createDataFrame(d, "g string, symbol int, score double")
    xs, order = CrossSection(), [F.desc("score"), F.col("symbol")]
    for n in (1, 7, 500):
        kept = xs.within(d, "g", "score", xs.bounds(d, "g", "score", n))
        assert rows(xs.top(kept, "g", order, n), "g", "symbol", "rank") == rows(xs.top(d, "g", order, n), "g", "symbol", "rank")
    assert xs.within(d.where("g = 'a' AND score BETWEEN 0 AND 1"), "g", "score", xs.bounds(d.where("g = 'a' AND score BETWEEN 0 AND 1"), "g", "score", 7)).count() < 60


def test_rows_are_joined_and_dealt_out_before_they_are_multiplied_by_the_modes(spark):
    from panelwright.plans import stages

    p = Panels(spark, SF)
    for frame in (stages.with_bonuses(p), stages.scored(p)):
        assert plan_of(frame).index("Generate") < plan_of(frame).index("Join")
    pool = plan_of(rec.pool(p))
    assert "hashpartitioning(date, mode" not in pool and pool.index("Generate") < pool.index("hashpartitioning(date")
    d = rs.date_ic(spark.createDataFrame([], "date date, symbol long, f double, g double, r double"), p.xs, ["f", "g"], "r")
    plan = plan_of(d)
    assert "hashpartitioning(date, factor" not in plan and plan.index("Generate") < plan.index("hashpartitioning(date")


def test_weights_of_modes(spark):
    d = spark.createDataFrame([(m, g) for m in [*sc.MODES, "none", None] for g in ("bull", "sideways", "bear", "crisis", "none", None)], "mode string, regime string")
    got = d.select("*", *[sc.weight_column(F.col("mode"), F.col("regime"), k).alias(k) for k in sc.DIMENSIONS]).collect()
    for r in got:
        want = sc.REGIME_WEIGHTS.get(r["mode"], {}).get(r["regime"], {})
        assert all(r[k] == want.get(k, 0.0) for k in sc.DIMENSIONS)
