"""Universe funnel, factor screens, hard filters: predicates on the panel, one flag per rule."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.crosssection import CrossSection
from ..functions.exprs import DATE, SYMBOL, div, symbol_window, trailing
from ..functions.timeseries import ret

W = symbol_window
C = F.col
NO = F.lit

# Liquidity multiplier by regime, and decay of remembered picks by age.
TURNOVER_MULTIPLIER = {"bull": 0.8, "sideways": 1.0, "bear": 1.3, "crisis": 1.5}
MEMORY_DECAY = {1: 0.8, 2: 0.9, 3: 1.0}


def yes(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


# -- factor registry (user-extendable) ------------------------------------------------


@dataclass
class FactorRegistry:
    """Named boolean factors: name -> Column builder plus metadata."""

    items: dict[str, tuple[Callable[..., Column], dict]] = field(default_factory=dict)

    def register(self, name: str, build: Callable[..., Column], **meta) -> None:
        self.items[name] = (build, meta)

    def column(self, name: str, **params) -> Column:
        build, _ = self.items[name]
        return yes(build(**params)).alias(f"f_{name}")

    def names(self, **meta) -> list[str]:
        return [n for n, (_, m) in self.items.items() if all(m.get(k) == v for k, v in meta.items())]


FACTORS = FactorRegistry()
FACTORS.register("rsi_oversold", lambda threshold=30: C("rsi_14") < threshold, kind="technical")
FACTORS.register("macd_golden_cross", lambda: (C("_prev_md") <= 0) & (C("_md") > 0), kind="technical")
FACTORS.register("price_above_sma", lambda period=20: C("close") > C(f"sma_{period}"), kind="technical")
FACTORS.register("foreign_net_buy", lambda threshold=0: C("foreign_net") > threshold, kind="chip")
FACTORS.register("institutional_consecutive_buy", lambda days=3: C("buy_streak") >= days, kind="chip")
FACTORS.register("short_squeeze_ratio", lambda threshold=0.2: div("short_balance", "margin_balance") > threshold, kind="chip")
FACTORS.register("revenue_yoy_growth", lambda threshold=20: C("yoy_growth") > threshold, kind="fundamental")
FACTORS.register("revenue_consecutive_growth", lambda months=3: C("growth_streak") >= months, kind="fundamental")


def factor_flags(snapshot: DataFrame, wanted: dict[str, dict]) -> DataFrame:
    """Add ``f_*`` booleans for the wanted factors."""
    d = snapshot
    if "macd_golden_cross" in wanted:
        d = d.withColumn("_md", C("macd") - C("macd_signal")).withColumn("_prev_md", F.lag("_md").over(W()))
    d = d.withColumns({f"f_{n}": FACTORS.column(n, **kw) for n, kw in wanted.items()})
    return d.drop("_md", "_prev_md")


def factor_score(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted number of hits."""
    s = reduce(lambda a, b: a + b, [C(f"f_{n}").cast("double") * w for n, w in weights.items()])
    return df.withColumn("factor_score", s)


def combine(names: list[str], require_all: bool = True) -> Column:
    """AND / OR of factor flags."""
    cols = [C(f"f_{n}") for n in names]
    return reduce((lambda a, b: a & b) if require_all else (lambda a, b: a | b), cols)


# -- funnel ---------------------------------------------------------------------------


@dataclass(frozen=True)
class UniverseConfig:
    """Funnel thresholds of the universe filter."""

    min_close: float = 10.0
    min_available_days: int = 20
    avg_turnover_5d_min: float = 30_000_000.0
    min_turnover_5d_min: float = 10_000_000.0
    turnover_ma20_min: float = 20_000_000.0
    trend_ma: int | None = 60
    volume_ratio_min: float | None = 1.5
    memory_days: int = 3
    limit_move: float = 0.095
    limit_days: int = 7


def available(bars: DataFrame, info: DataFrame, cfg: UniverseConfig, types: list[str]) -> DataFrame:
    """B12 at every date: listed type, enough bars in the trailing year, minimum close."""
    day = F.datediff(C(DATE), F.lit("1970-01-01").cast("date"))
    year = Window.partitionBy(SYMBOL).orderBy(day).rangeBetween(-365, 0)
    d = bars.join(info.where(C("listing_type").isin(types)).select(SYMBOL), SYMBOL, "left_semi")
    d = d.withColumn("n_year", F.count(F.lit(1)).over(year))
    return d.withColumn("ok_stage1", (C("n_year") >= cfg.min_available_days) & (C("close") > cfg.min_close))


def liquid(features: DataFrame, cfg: UniverseConfig, multiplier: Column | None = None) -> Column:
    """Average and lowest turnover of five bars; a surge rescues half-liquid names.

    ``features`` needs turnover_5_avg, turnover_5_min, turnover_ma20, turnover_ratio_5d_20d.
    """
    m = F.lit(1.0) if multiplier is None else multiplier
    main = (
        (C("turnover_5_avg") >= cfg.avg_turnover_5d_min * m)
        & (C("turnover_5_min") >= cfg.min_turnover_5d_min * m)
        & (C("turnover_ma20").isNull() | (C("turnover_ma20") >= cfg.turnover_ma20_min * m))
    )
    rescue = (C("turnover_ratio_5d_20d") >= 2.0) & (C("turnover_5_avg") >= cfg.avg_turnover_5d_min * m * 0.5)
    return yes(main) | yes(rescue)


def turnover_five(df: DataFrame) -> DataFrame:
    return df.withColumns({"turnover_5_avg": F.avg("turnover").over(trailing(5)), "turnover_5_min": F.min("turnover").over(trailing(5))})


def limit_moves(df: DataFrame, cfg: UniverseConfig, out: str = "n_limit") -> DataFrame:
    """Moves beyond the limit between bars of the last ``limit_days`` days."""
    day = F.datediff(C(DATE), F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy(SYMBOL).orderBy(day).rangeBetween(-cfg.limit_days, 0)
    df = df.withColumn("_big", F.when(yes(F.abs(ret("close", 1)) >= cfg.limit_move), 1).otherwise(0))
    # the first bar of the slice has no predecessor inside it
    return df.withColumn(out, F.sum("_big").over(w) - F.first("_big").over(w)).drop("_big")


def trending(cfg: UniverseConfig, volume_ratio: float | None) -> Column:
    """B15 (needs ma column, volume_ma20, n_limit)."""
    up = F.lit(True) if cfg.trend_ma is None else yes(C("close") >= C(f"ma{cfg.trend_ma}"))
    vol = F.lit(True) if volume_ratio is None else yes(div("volume", "volume_ma20") >= volume_ratio)
    return up & vol & (C("n_limit") < 3)


def breaking_out() -> Column:
    """B16."""
    near = F.coalesce(div("close", "high_20d") >= 0.9, F.lit(True))
    return (
        yes(C("close") >= C("ma20"))
        & yes(C("momentum_20d") > 0)
        & near
        & yes(div("volume", "volume_ma20") >= 1.5)
        & (C("n_limit") < 3)
    )


def dispatch_trend(mode: str, trend: Column, breakout: Column) -> Column:
    """B17."""
    return {"trend_only": trend, "breakout_only": breakout, "trend_or_breakout": trend | breakout}[mode]


# -- hard filters ------------------------------------------------------------------------


def pe_thresholds(d: DataFrame, xs: CrossSection, by, multiplier: float = 1.5, fallback: float = 50.0, min_count: int = 3) -> DataFrame:
    """Industry median of positive PE times a multiplier."""
    keys = ([by] if isinstance(by, str) else list(by)) + ["industry"]
    d = d.withColumn("_pos", F.when(C("pe") > 0, C("pe")))
    d = xs.with_quantiles(d, keys, {"_med": ("_pos", 0.5)})
    d = xs.with_stats(d, keys, {"_cnt": F.count("_pos")})
    return d.withColumn("pe_threshold", F.when(C("_cnt") >= min_count, C("_med") * multiplier).otherwise(fallback)).drop("_pos", "_med", "_cnt")


def news_gate(d: DataFrame, xs: CrossSection, by=DATE, *, threshold=0.15, penalty=0.08, q=0.15, min_sample=20, safety=0.3) -> DataFrame:
    """Penalise names below the low news percentile of the date."""
    d = xs.with_quantiles(d, by, {"_q": ("news_score", q)})
    d = xs.with_stats(d, by, {"_n": F.count("news_score")})
    cut = F.when(C("_n") >= min_sample, F.least(C("_q"), F.lit(safety))).otherwise(threshold)
    hit = yes(C("news_score") < cut)
    d = d.withColumn("neg_news_gate", F.when(hit, -penalty).otherwise(0.0))
    return d.withColumn("composite_score", C("composite_score") * (1 + C("neg_news_gate"))).drop("_q", "_n")


def atr_risk(d: DataFrame, xs: CrossSection, by=DATE, percentile: float = 0.8, cap: float = 0.08) -> DataFrame:
    """Keep names whose ATR share is within min(percentile, cap)."""
    d = d.withColumn("atr_ratio", F.when(C("close") > 0, C("atr14") / C("close")).otherwise(0.0))
    d = xs.with_quantiles(d, by, {"_q": ("atr_ratio", percentile)})
    return d.where(C("atr_ratio") <= F.least(C("_q"), F.lit(cap))).drop("_q")


def window_volatility(bars: DataFrame, window: int, annualize: bool) -> DataFrame:
    """Deviation of the last returns; NULL (dropped later) below ten bars."""
    d = bars.withColumns({"_r": ret("close", 1), "_n": F.row_number().over(W())})
    v = F.stddev_samp("_r").over(trailing(window)) * (252**0.5 if annualize else 1.0)
    return d.withColumn("vol", F.when(C("_n") >= 10, v)).drop("_r", "_n")


def vol_risk(d: DataFrame, xs: CrossSection, by=DATE, percentile: float = 0.85, cap: float = 0.05) -> DataFrame:
    """Keep names whose volatility is within min(percentile, cap); no history is dropped."""
    d = xs.with_quantiles(d, by, {"_q": ("vol", percentile)})
    return d.where(C("vol") <= F.least(F.coalesce(C("_q"), F.lit(cap)), F.lit(cap))).drop("_q")


def overheating(d: DataFrame, ex5=0.35, ex10=0.50, da5=0.25, da10=0.35, factor=0.85) -> DataFrame:
    """Drop overheated names, damp warm ones (needs r5, r10)."""
    a, b = F.coalesce(C("r5"), F.lit(0.0)), F.coalesce(C("r10"), F.lit(0.0))
    d = d.where(~((a > ex5) | (b > ex10)))
    return d.withColumn("composite_score", F.when((a > da5) | (b > da10), C("composite_score") * factor).otherwise(C("composite_score")))


def crisis_filter(d: DataFrame, lag: float = -0.10) -> DataFrame:
    """In a crisis drop names behind the index or below their 60-row mean (needs excess_20, sma60, n)."""
    weak = yes(C("excess_20") < lag) | yes((C("n") >= 60) & (C("close") < C("sma60")))
    return d.where(~((C("regime") == "crisis") & weak))


# Minimum composite by regime.
MIN_SCORE = {"bull": 0.45, "sideways": 0.50, "bear": 0.55, "crisis": 0.60}


def score_floor(regime: Column, *extra: Column) -> Column:
    """Regime floor plus the outcome adjustments."""
    out = F.lit(0.5)
    for g, v in MIN_SCORE.items():
        out = F.when(regime == g, v).otherwise(out)
    return reduce(lambda a, b: a + F.coalesce(b, F.lit(0.0)), extra, out)


def relative_strength(bars: DataFrame, index: DataFrame, n: int = 20) -> DataFrame:
    """N-row return minus the index return over n index rows; 0 with short history."""
    ix = index.select(DATE, ret("close", n, key="market").alias("_ir")) if "market" in index.columns else index
    d = bars.withColumn("_sr", ret("close", n)).join(ix, DATE, "left")
    return d.withColumn("excess_20", F.coalesce(C("_sr") - C("_ir"), F.lit(0.0))).drop("_sr", "_ir")
