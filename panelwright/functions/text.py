"""Keyword classifiers and news weights.

Keyword tables are parameters; the defaults are the published rule values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import col, lookup

# Weights and decay rates per announcement type.
EVENT_WEIGHTS = {
    "governance_change": 5.0,
    "buyback": 4.0,
    "earnings_call": 3.0,
    "investor_day": 2.0,
    "filing": 1.5,
    "revenue": 1.2,
    "general": 1.0,
}
DECAY = {"governance_change": 0.07, "buyback": 0.07, "revenue": 0.15, "general": 0.15}
DECAY_DEFAULT = 0.12
CATALYST_TYPES = ["earnings_call", "investor_day", "buyback", "revenue"]
RISK_TYPES = ["governance_change", "filing"]


def news_decay_weight(days_ago, event_type) -> Column:
    """H4: exp(-rate * age) times the weight of the type."""
    t = col(event_type)
    age = F.greatest(F.lit(0), col(days_ago))
    return F.exp(-lookup(t, DECAY, DECAY_DEFAULT) * age) * lookup(t, EVENT_WEIGHTS, 1.0)


def _any_of(words: list[str]) -> str:
    return "|".join(words)


def classify_sentiment(
    subject,
    negative_context=None,
    positive_context=None,
    clarification=None,
    negative=None,
    positive=None,
) -> Column:
    """H1: context patterns first, then clarifications, then plain keyword lists -> -1, 0, 1."""
    s = col(subject)
    hit = lambda words, default: s.rlike(_any_of(default if words is None else words))
    return (
        F.when(s.isNull() | (s == ""), 0)
        .when(hit(negative_context, NEGATIVE_CONTEXT), -1)
        .when(hit(positive_context, POSITIVE_CONTEXT), 1)
        .when(hit(clarification, CLARIFICATION), 0)
        .when(hit(negative, NEGATIVE_WORDS), -1)
        .when(hit(positive, POSITIVE_WORDS), 1)
        .otherwise(0)
        .cast("long")
    )


def classify_event_type(subject, rules=None, default: str = "general") -> Column:
    """H2: the first rule whose keywords occur wins."""
    s = col(subject)
    out = None
    for label, words in EVENT_RULES if rules is None else rules:
        cond = s.rlike(_any_of(words))
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(default)


def classify_concepts(title, keywords=None) -> Column:
    """H3: all labels whose keywords occur (case-insensitive), in table order."""
    s = F.lower(col(title))
    table = CONCEPT_WORDS if keywords is None else keywords
    tags = [F.when(s.rlike(_any_of([w.lower() for w in ws])), F.lit(k)) for k, ws in table.items()]
    return F.filter(F.array(*tags), lambda x: x.isNotNull())


def security_type(symbol, name) -> Column:
    """Funds start with 00 or say ETF, warrants have six digits, preferred shares say so."""
    i, n = col(symbol), col(name)
    return (
        F.when(i.rlike("^00") | n.rlike("(?i)etf"), "etf")
        .when(i.rlike(r"^[0-9]{6}$"), "warrant")
        .when(n.contains("特"), "preferred")
        .otherwise("stock")
    )


def parse_number(s) -> Column:
    """Drop thousands separators and placeholders; NULL when nothing numeric is left."""
    return F.regexp_replace(F.trim(col(s)), ",", "").try_cast("double")


# Default keyword tables of the announcement classifiers.
NEGATIVE_CONTEXT = [r"處分.{0,10}(股權|持股|投資)", r"澄清.{0,10}(下修|衰退|虧損)", r"(大股東|董事).{0,10}處分.{0,10}持股"]
POSITIVE_CONTEXT = [r"處分.{0,10}(利益|盈餘|獲利)", r"取得.{0,10}(專利|合約|標案|訂單)", r"(合約|框架協議).{0,10}(簽訂|簽署)"]
CLARIFICATION = ["澄清", "說明媒體"]
NEGATIVE_WORDS = [
    "下市", "終止上市", "終止上櫃", "重編", "虧損", "違約", "裁罰", "減資彌補", "財務危機", "跳票", "解散",
    "清算", "撤銷", "停工", "停產", "訴訟", "求償", "罰鍰", "糾正", "現金增資", "警示",
]
POSITIVE_WORDS = [
    "庫藏股", "買回", "營收創", "合併", "收購", "取得專利", "獲獎", "上櫃轉上市", "上市", "策略聯盟", "訂單",
    "中標", "得標", "股利", "配息", "盈餘轉增資", "處分不動產", "處分有價證券", "處分資產", "法說會",
    "投資人日", "法人說明會",
]
EVENT_RULES = [
    ("governance_change", ["董監改選", "董事改選", "監察人改選", "股東臨時會", "市場派", "大股東持股申報", "持股申報轉讓", "董事會改選", "獨立董事選任"]),
    ("buyback", ["決議買回庫藏股", "買回庫藏股", "庫藏股買回", "庫藏股執行"]),
    ("earnings_call", ["法說會", "法人說明會", "業績說明會", "分析師說明會"]),
    ("investor_day", ["投資人日", "Investor Day", "investor day", "股東說明會", "股東會"]),
    ("filing", ["年報", "季報", "半年報", "財務報告", "財報", "EPS", "每股盈餘", "Q1財報", "Q2財報", "Q3財報", "Q4財報"]),
    ("revenue", ["月營收", "營收", "合併營收", "自結營收"]),
]
CONCEPT_WORDS = {
    "CoWoS封裝": ["CoWoS", "先進封裝", "SoIC", "CoCoS", "3D封裝", "Chiplet"],
    "散熱模組": ["液冷", "散熱", "冷卻板", "熱管", "vapor chamber", "均溫板", "水冷"],
    "低軌衛星": ["低軌衛星", "LEO", "Starlink", "SpaceX", "衛星通訊", "非地面網路", "NTN"],
    "AI伺服器": ["GB200", "HGX", "NVL72", "AI伺服器", "AI Server", "AI加速", "推論加速"],
    "車用電子": ["ADAS", "電動車", "EV ", "車用", "自駕", "車載", "車電"],
}
