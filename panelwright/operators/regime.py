"""Market regime: votes, crisis signals, transition rules and hysteresis.

The market series has one row per (market, date), so its windows are bounded by time.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import flag, symbol_window, trailing

KEY = "market"


@dataclass(frozen=True)
class RegimeRules:
    """Thresholds of the regime detector (all can be overridden)."""

    sma_short: int = 60
    sma_long: int = 120
    return_window: int = 20
    return_threshold: float = 0.03
    breadth_threshold: float = 0.60
    return_5d: float = -0.05
    consec_down: int = 3
    vol_ratio: float = 1.8
    panic_volume: float = 1.5
    vix_level: float = 30.0
    vix_change: float = 0.25
    single_drop: float = -0.025
    us_vix_level: float = 30.0
    us_vix_change: float = 0.25
    buffer: float = 0.01
    exit_vol_ratio: float = 1.3


#: Days a transition must hold; other pairs need DEFAULT_CONFIRM.
CONFIRM_DAYS = {
    ("bull", "sideways"): 1,
    ("sideways", "bull"): 3,
    ("sideways", "bear"): 2,
    ("bear", "sideways"): 3,
    ("crisis", "bear"): 2,
    ("crisis", "sideways"): 2,
}
DEFAULT_CONFIRM = 2

W = lambda: symbol_window(key=KEY)
T = lambda n: trailing(n, key=KEY)
ALL = 1 << 30


def _base(index: DataFrame) -> DataFrame:
    r = F.col("close") / F.lag("close").over(W()) - 1
    return index.withColumns({"_n": F.row_number().over(W()), "_r": r})


def crisis_signals(index: DataFrame, k: RegimeRules = RegimeRules()) -> DataFrame:
    """Seven fast signals per date; two of them make a crisis.

    Needs close, volume, vix, us_vix.
    """
    c = F.col
    d = _base(index)
    down = flag(c("_r") < 0)
    d = d.withColumns(
        {
            "fast_return_5d_val": c("close") / F.lag("close", 5).over(W()) - 1,
            "_dn": F.sum(down).over(T(k.consec_down)),
            "_rv": F.when(F.count("_r").over(T(20)) == 20, F.stddev_samp("_r").over(T(20))),
            "_vm": F.avg("volume").over(W().rowsBetween(-20, -1)),
            "_pv": F.lag("vix").over(W()),
            "_pu": F.lag("us_vix").over(W()),
        }
    )
    past = W().rowsBetween(-119, -20)
    d = d.withColumns(
        {
            "_L": F.count("_rv").over(T(ALL)),
            "_a": F.avg("_rv").over(past),
            "_ac": F.count("_rv").over(past),
            "_prev": F.avg("_rv").over(W().rowsBetween(-ALL, -1)),
            "_all": F.avg("_rv").over(T(ALL)),
        }
    )
    base = F.when(c("_L") > 20, F.when(c("_ac") >= 5, c("_a")).otherwise(c("_all"))).otherwise(c("_prev"))
    ratio = F.when((c("_n") >= 30) & (base > 0), c("_rv") / F.when(base > 0, base))
    d = d.withColumn("vol_ratio_val", F.coalesce(ratio, F.lit(0.0)))
    jump = lambda now, before: c(now) / F.when(c(before) > 0, c(before)) - 1
    ready = c("_n") >= max(k.consec_down + 1, 10)
    sig = {
        "fast_return_5d": c("fast_return_5d_val") < k.return_5d,
        "consec_decline": c("_dn") >= k.consec_down,
        "vol_spike": c("vol_ratio_val") > k.vol_ratio,
        "panic_volume": (c("_n") >= 21) & (c("volume") > c("_vm") * k.panic_volume) & (c("_r") < 0),
        "vix_spike": (c("vix") >= k.vix_level) | (jump("vix", "_pv") >= k.vix_change),
        "single_day_drop": c("_r") < k.single_drop,
        "us_vix_spike": (c("us_vix") >= k.us_vix_level) | (jump("us_vix", "_pu") >= k.us_vix_change),
    }
    d = d.withColumns({s: flag(ready & e) for s, e in sig.items()})
    hits = sum((c(s) for s in sig), F.lit(0))
    d = d.withColumn("crisis", hits >= 2)
    return d.drop("_n", "_r", "_dn", "_rv", "_vm", "_pv", "_pu", "_L", "_a", "_ac", "_prev", "_all")


SIGNALS = ["fast_return_5d", "consec_decline", "vol_spike", "panic_volume", "vix_spike", "single_day_drop", "us_vix_spike"]


def detect(index: DataFrame, breadth: DataFrame | None = None, k: RegimeRules = RegimeRules()) -> DataFrame:
    """Three votes, breadth downgrade, crisis override, for every date."""
    c = F.col
    d = crisis_signals(index, k)
    if breadth is not None:
        d = d.join(breadth, "date", "left")
    else:
        d = d.withColumn("breadth_below_ma20_pct", F.lit(None).cast("double"))
    d = d.withColumns(
        {
            "_n": F.row_number().over(W()),
            "_s": F.avg("close").over(T(k.sma_short)),
            "_l": F.avg("close").over(T(k.sma_long)),
            "ret_20d": c("close") / F.lag("close", k.return_window).over(W()) - 1,
        }
    )
    r = c("ret_20d")
    bull = flag(c("close") > c("_s")) + flag(c("close") > c("_l")) + flag(r > k.return_threshold)
    bear = flag(c("close") <= c("_s")) + flag(c("close") <= c("_l")) + flag(r < -k.return_threshold)
    vote = F.when(c("_n") < k.sma_long, "sideways").when(bull >= 2, "bull").when(bear >= 2, "bear").otherwise("sideways")
    weak = (c("_n") >= k.sma_long) & (c("breadth_below_ma20_pct") > k.breadth_threshold)
    d = d.withColumn("vote", vote)
    low = F.when(weak & (c("vote") == "bull"), "sideways").when(weak & (c("vote") == "sideways"), "bear").otherwise(c("vote"))
    d = d.withColumns({"breadth_downgraded": F.coalesce(low != c("vote"), F.lit(False)), "_low": low})
    regime = F.when((c("_n") >= k.sma_long) & c("crisis"), "crisis").otherwise(c("_low"))
    return d.withColumn("regime", regime).drop("_n", "_s", "_l", "_low")


def transition_flags(index: DataFrame, k: RegimeRules = RegimeRules()) -> DataFrame:
    """One boolean column per regulated regime change."""
    c = F.col
    d = _base(index)
    d = d.withColumns(
        {
            "_s": F.avg("close").over(T(k.sma_short)),
            "_l": F.avg("close").over(T(k.sma_long)),
            "_r20": c("close") / F.lag("close", 20).over(W()) - 1,
            "_c1": F.lag("close", 1).over(W()),
            "_c2": F.lag("close", 2).over(W()),
            "_v": F.stddev_samp("_r").over(T(20)),
            "_vb": F.stddev_samp("_r").over(W().rowsBetween(-119, -20)),
        }
    )
    ready = c("_n") >= k.sma_short
    rising = (c("_c1") > c("_c2")) & (c("close") > c("_c1"))
    calm = F.when((c("_n") < 30) | c("_vb").isNull() | (c("_vb") <= 0), True).otherwise(c("_v") / F.when(c("_vb") > 0, c("_vb")) < k.exit_vol_ratio)
    out = rising & calm
    f = lambda e: F.coalesce(ready & e, F.lit(False))
    d = d.withColumns(
        {
            "bull_sideways": f(c("close") < c("_s") * (1 - k.buffer)),
            "sideways_bull": f(c("close") > c("_s") * (1 + k.buffer)),
            "sideways_bear": f((c("_n") >= k.sma_long) & ((c("close") < c("_l")) | (c("_r20") < -0.03))),
            "bear_sideways": f(c("close") > c("_s")),
            "crisis_bear": f(out),
            "crisis_sideways": f(out & (c("close") > c("_s"))),
        }
    )
    return d.drop("_n", "_r", "_s", "_l", "_r20", "_c1", "_c2", "_v", "_vb")


FLAGS = ["bull_sideways", "sideways_bull", "sideways_bear", "bear_sideways", "crisis_bear", "crisis_sideways"]


def step(prev: str | None, count: int, raw: str, allowed: dict[str, bool]) -> tuple[str, int]:
    """One hysteresis step: (regime, pending count) after seeing ``raw``."""
    if prev is None or raw in ("crisis", prev):
        return raw, 0
    if (prev, raw) in CONFIRM_DAYS and not allowed[f"{prev}_{raw}"]:
        return prev, 0
    if count + 1 >= CONFIRM_DAYS.get((prev, raw), DEFAULT_CONFIRM):
        return raw, 0
    return prev, count + 1


def hysteresis(states: DataFrame) -> DataFrame:
    """Confirmation-count state machine over each market's dates.

    ``states`` has market, date, regime (raw) and the transition flags.  The state depends
    on the whole past, so each market is folded in date order; a market is one row per date.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        prev, count, out, counts = None, 0, [], []
        for row in pdf.to_dict("records"):
            prev, count = step(prev, count, row["regime"], row)
            out.append(prev)
            counts.append(count)
        return pd.DataFrame({"market": pdf["market"], "date": pdf["date"], "raw_regime": pdf["regime"], "regime": out, "pending": counts})

    cols = states.select(KEY, "date", "regime", *FLAGS)
    return cols.groupBy(KEY).applyInPandas(fold, "market string, date date, raw_regime string, regime string, pending long")
