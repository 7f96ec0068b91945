import math

import pytest
from pyspark.sql import functions as F

from panelwright.functions import text as tx
from panelwright.functions import trading as tr


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_trade_cost_splits_lots_and_odd_shares(spark):
    c, t, s = one(spark, *tr.trade_cost(F.lit(100.0), F.lit(1500.0), 0.0005, "sell"))
    assert c == pytest.approx(max(100 * 1000 * 0.001425, 20) + max(100 * 500 * 0.001425, 1))
    assert t == pytest.approx(100 * 1500 * 0.003)
    assert s == pytest.approx(100 * 1500 * 0.0005 + 100 * 500 * 0.001)


def test_minimum_fees(spark):
    c, _, _ = one(spark, *tr.trade_cost(F.lit(5.0), F.lit(1001.0), 0.0, "buy"))
    assert c == pytest.approx(20 + 1)
    assert list(one(spark, *tr.trade_cost(F.lit(5.0), F.lit(0.0), 0.0))) == [0, 0, 0]


@pytest.mark.parametrize("capital,price", [(1e6, 33.3), (20_000.0, 17.0), (50.0, 0.07), (900.0, 1.3), (10.0, 100.0), (2_003_000.0, 1000.0)])
def test_affordable_shares_is_the_largest_that_fits(spark, capital, price):
    def cost(n):
        odd = n % 1000
        lots = n - odd
        fee = (max(price * lots * 0.001425, 20) if lots else 0) + (max(price * odd * 0.001425, 1) if odd else 0)
        return price * n + fee + price * n * 0.0005 + price * odd * 0.001

    n = int(capital / (price * (1 + 0.001425 + 0.0005)))
    while n > 0 and cost(n) > capital:
        n -= 1
    assert one(spark, tr.affordable_shares(F.lit(capital), F.lit(price)))[0] == n


def test_slippage_cap_and_sell_multiplier(spark):
    b = one(spark, tr.dynamic_slippage(F.lit(1e6), F.lit(101.0), F.lit(100.9), F.lit(101.0)))[0]
    assert b == pytest.approx(max(0.0005 + 0.5 / math.sqrt(1e6), 0.1 / 101 * 0.5))
    s = one(spark, tr.dynamic_slippage(F.lit(100.0), F.lit(110.0), F.lit(90.0), F.lit(100.0), side="sell"))[0]
    assert s == 0.01


def test_watch_status_precedence(spark):
    d = lambda x: F.lit(x).cast("date")
    st = lambda px, today: one(spark, tr.watch_status(F.lit(90.0), F.lit(120.0), d("2024-01-31"), F.lit(px), d(today)))[0]
    assert st(89.0, "2024-02-02") == "stopped_loss"
    assert st(121.0, "2024-02-02") == "taken_profit"
    assert st(100.0, "2024-02-02") == "expired"
    assert st(100.0, "2024-01-02") == "active"


def test_stops_by_regime(spark):
    assert list(one(spark, *tr.atr_stops(F.lit(100.0), F.lit(2.0), F.lit("bull")))) == [97.0, 107.0]
    assert list(one(spark, *tr.atr_stops(F.lit(100.0), F.lit(0.0), F.lit("bear")))) == pytest.approx([97.0, 106.0])


@pytest.mark.parametrize(
    "subject,want",
    [("公告處分子公司股權", -1), ("處分利益", 1), ("澄清媒體報導", 0), ("公司發生虧損", -1), ("董事會決議買回庫藏股", 1), ("", 0), ("一般事項", 0)],
)
def test_sentiment(spark, subject, want):
    assert one(spark, tx.classify_sentiment(F.lit(subject)))[0] == want


def test_event_type_order_and_concepts(spark):
    r = one(spark, tx.classify_event_type(F.lit("股東臨時會決議買回庫藏股")), tx.classify_event_type(F.lit("本公司月營收")), tx.classify_concepts(F.lit("starlink 與 液冷 合作")))
    assert r[0] == "governance_change" and r[1] == "revenue" and r[2] == ["散熱模組", "低軌衛星"]


def test_numbers_and_security_types(spark):
    r = one(spark, tx.parse_number(F.lit("1,234.5")), tx.parse_number(F.lit("--")), tx.security_type(F.lit("0050"), F.lit("x")), tx.security_type(F.lit("2330"), F.lit("x")), tx.security_type(F.lit("123456"), F.lit("x")))
    assert list(r) == [1234.5, None, "etf", "stock", "warrant"]
