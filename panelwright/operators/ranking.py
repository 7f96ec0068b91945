"""Coarse ranks, Top-N, diversification, composite rankings and scan-to-scan set comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.crosssection import CrossSection
from ..functions.exprs import DATE, SYMBOL

C = F.col

# Weights of the coarse ranking and limits of the sector cap.
COARSE = {"vol_rank": 0.30, "inst_rank": 0.40, "mom_rank": 0.30}
COARSE_BY_MODE = {
    "momentum": {"vol_rank": 0.30, "inst_rank": 0.40, "mom_rank": 0.30},
    "swing": {"inst_rank": 0.40, "trend_rank": 0.30, "vol_rank": 0.30},
    "value": {"vol_rank": 0.50, "inst_rank": 0.50},
    "dividend": {"dy_rank": 0.50, "vol_rank": 0.30, "inst_rank": 0.20},
    "growth": {"yoy_rank": 0.40, "vol_rank": 0.30, "inst_rank": 0.30},
}
SECTOR_RATIO, SECTOR_MIN = 0.25, 3
TIER_ORDER = {"N/A": 0, "3F": 1, "4F": 2, "5F": 3, "6F": 4, "7F": 5, "8F": 6}


def day_window(lo: int, hi: int):
    """Range frame in days (lo, hi relative to the row)."""
    day = F.datediff(C(DATE), F.lit("1970-01-01").cast("date"))
    return Window.partitionBy(SYMBOL).orderBy(day).rangeBetween(lo, hi)


def coarse_inputs(df: DataFrame, step: int = 7, dates: int = 5) -> DataFrame:
    """net flow over the last market dates and return against the first of them.

    ``step`` is the calendar distance of two market dates.
    """
    back = -step * (dates - 1)
    ref = F.max("close").over(day_window(back, back))
    return df.withColumns(
        {
            "inst_net": F.sum("total_net").over(day_window(back, 0)),
            "momentum": F.coalesce(C("close") / F.when(ref != 0, ref) - 1, F.lit(0.0)),
        }
    )


INPUT = {"vol_rank": "volume", "inst_rank": "inst_net", "mom_rank": "momentum", "trend_rank": "trend_strength", "dy_rank": "dividend_yield", "yoy_rank": "yoy_growth"}


def coarse_ranks(df: DataFrame, xs: CrossSection, by=DATE, weights: dict[str, float] = COARSE) -> DataFrame:
    """percent ranks of volume, flow and momentum (or a mode's own inputs) and their weighted sum."""
    df = xs.pct_rank(df, by, {k: (INPUT[k], True) for k in weights})
    s = sum((C(k) * w for k, w in weights.items()), F.lit(0.0))
    return df.withColumn("coarse_score", F.round(s, 9))


def effective_top_n(n: Column, minimum: int, ratio: float = 0.15) -> Column:
    """F2."""
    return F.greatest(F.lit(minimum), F.floor(n * ratio))


def coarse_top(df: DataFrame, xs: CrossSection, minimum: int = 150, by=DATE, score: str = "coarse_score") -> DataFrame:
    """best max(minimum, 15 %) names per date."""
    df = xs.with_stats(df, by, {"_n": F.count(F.lit(1))})
    df = xs.row_rank(df, by, score, "coarse_rank")
    return df.where(C("coarse_rank") <= effective_top_n(C("_n"), minimum)).drop("_n")


def rank_pool(df: DataFrame, xs: CrossSection, by, selected: int = 20) -> DataFrame:
    """full pool with its rank and the flag of the picks."""
    df = xs.row_rank(df, by, "composite_score", "pool_rank")
    return df.withColumn("selected", C("pool_rank") <= selected)


def sector_cap(n: int) -> int:
    return max(SECTOR_MIN, int(n * SECTOR_RATIO))


def diversify(picks: DataFrame, by: list[str], top_n: int, rank: str = "pool_rank", sector: str = "industry") -> DataFrame:
    """walk the best 2n names, keep at most the cap per sector, until n are kept.

    Keeping the first ``cap`` of every sector and then the first n overall is the same set.
    """
    pool = picks.where(C(rank) <= 2 * top_n)
    w = Window.partitionBy(*by, sector).orderBy(rank)
    pool = pool.withColumn("_k", F.row_number().over(w)).where(C("_k") <= sector_cap(top_n))
    w2 = Window.partitionBy(*by).orderBy(rank)
    return pool.withColumn("rank", F.row_number().over(w2).cast("long")).where(C("rank") <= top_n).drop("_k")


def drawdown_top_n(drawdown: Column, defensive: Column, n: int) -> Column:
    """F8: halve / third the list in a market drawdown unless the mode is defensive."""
    cut = F.when(drawdown > -0.10, n).when(drawdown > -0.15, max(3, n // 2)).otherwise(max(3, n // 3))
    return F.when(drawdown.isNull() | defensive, n).otherwise(cut).cast("long")


def flat_half(xs: CrossSection, df: DataFrame, by, specs: dict[str, str]) -> DataFrame:
    """Percent rank, 0.5 for a constant column."""
    df = xs.pct_rank(df, by, {o: (c, True) for o, c in specs.items()})
    df = xs.with_spread(df, by, {f"_d{o}": c for o, c in specs.items()})
    return df.withColumns({o: F.when(C(f"_d{o}") > 0, C(o)).otherwise(0.5) for o in specs}).drop(*[f"_d{o}" for o in specs])


def rank_sectors(flow: DataFrame, momentum: DataFrame, accel: DataFrame, xs: CrossSection, accel_weight: float = 0.7, by: str | None = None) -> DataFrame:
    """half flow (level and acceleration), half price momentum, by industry; at every `by` where there is one."""
    keys, g = ["industry", *([by] if by else [])], by or "_g"
    d = flow.select(*keys, "total_net", "stock_count").join(momentum.select(*keys, "avg_return_pct"), keys, "full")
    d = d.join(accel, keys, "left").na.fill(0).withColumn("_g", F.lit(1))
    d = flat_half(xs, d, g, {"_l": "total_net", "_a": "flow_acceleration", "momentum_score": "avg_return_pct"})
    inst = (1 - accel_weight) * C("_l") + accel_weight * C("_a")
    d = d.withColumn("institutional_score", inst)
    d = d.withColumn("sector_score", F.round(0.5 * C("institutional_score") + 0.5 * C("momentum_score"), 9))
    w = Window.partitionBy(g).orderBy(F.desc("sector_score"), "industry")  # one row per industry
    return d.withColumn("rank", F.row_number().over(w).cast("long")).drop("_l", "_a", "_g")


def sector_bonus(sectors: DataFrame, info: DataFrame, span: float = 0.05, by: str | None = None) -> DataFrame:
    """linear bonus by sector rank; names of sectors without a rank get none, or no row where there is a `by`."""
    keys = ["industry", *([by] if by else [])]
    n = F.count(F.lit(1)).over(Window.partitionBy(by or F.lit(0)))  # one row per industry
    b = F.when(C("_n") == 1, 0.0).otherwise(span * (1 - 2 * (C("rank") - 1) / F.when(C("_n") > 1, C("_n") - 1)))
    s = sectors.withColumn("_n", n).select(*keys, b.alias("sector_bonus"))
    out = info.select(SYMBOL, "industry").join(s, "industry", "inner" if by else "left")
    return out.withColumn("sector_bonus", F.coalesce("sector_bonus", F.lit(0.0)))


def rank_concepts(flow: DataFrame, momentum: DataFrame, xs: CrossSection, by: str | None = None) -> DataFrame:
    """percent-rank blend of flow and momentum per concept; at every `by` where there is one."""
    keys, g = ["concept", *([by] if by else [])], by or "_g"
    d = momentum.join(flow.select(*keys, "concept_flow"), keys, "left").na.fill(0).withColumn("_g", F.lit(1))
    d = flat_half(xs, d, g, {"institutional_score": "concept_flow", "momentum_score": "concept_momentum"})
    d = d.withColumn("concept_score", F.round(0.5 * C("institutional_score") + 0.5 * C("momentum_score"), 9))
    w = Window.partitionBy(g).orderBy(F.desc("concept_score"), "concept")  # one row per concept
    return d.withColumn("rank", F.row_number().over(w).cast("long")).drop("_g")


def concept_bonus(ranked: DataFrame, members: DataFrame, span: float = 0.05, by: str | None = None) -> DataFrame:
    """min-max scaled concept score, best concept per symbol; at every `by` where there is one."""
    more = [by] if by else []
    w = Window.partitionBy(by or F.lit(0))  # one row per concept
    r = ranked.withColumns({"_lo": F.min("concept_score").over(w), "_hi": F.max("concept_score").over(w)})
    rng = F.when(C("_hi") > C("_lo"), C("_hi") - C("_lo")).otherwise(1.0)
    r = r.select("concept", *more, (((C("concept_score") - C("_lo")) / rng * 2 - 1) * span).alias("b"))
    return members.join(r, "concept").groupBy(SYMBOL, *more).agg(F.max("b").alias("concept_bonus"))


def composite_rankings(records: DataFrame, by: list[str], top_n: int, per_mode: int | None) -> DataFrame:
    """F16: mean score over modes, primary mode = best score, tightest stop, per-mode quota."""
    g = records.groupBy(*by, SYMBOL).agg(
        F.avg("composite_score").alias("_s"),
        F.max_by("mode", F.struct("composite_score", "mode")).alias("primary_mode"),
        F.max("stop_loss").alias("stop_loss"),
        F.max("close").alias("close"),
    )
    g = g.withColumn("score", F.round("_s", 9)).drop("_s")
    order = [F.desc("score"), C(SYMBOL)]
    if per_mode:
        w = Window.partitionBy(*by, "primary_mode").orderBy(*order)
        g = g.withColumn("_q", F.row_number().over(w)).where(C("_q") <= per_mode).drop("_q")
    w = Window.partitionBy(*by).orderBy(*order)
    return g.withColumn("rank", F.row_number().over(w).cast("long")).where(C("rank") <= top_n)


def cross_comparison(picks: DataFrame, by: list[str], modes: list[str]) -> DataFrame:
    """ranks per mode side by side with appearances, best rank, mean score and best mode."""
    cols = [F.max(F.when(C("mode") == m, C("rank"))).cast("double").alias(f"{m}_rank") for m in modes]
    return picks.groupBy(*by, SYMBOL).agg(
        *cols,
        F.count(F.lit(1)).alias("appearances"),
        F.min("rank").alias("best_rank"),
        F.avg("composite_score").alias("avg_score"),
        F.max_by("mode", F.struct(C("composite_score"), C("mode"))).alias("best_mode"),
    )


def previous_scan(picks: DataFrame, by: list[str], date: str = DATE) -> DataFrame:
    """(by, date, prev_date) of consecutive scans."""
    w = Window.partitionBy(*by).orderBy(date)
    return picks.select(*by, date).distinct().withColumn("prev_date", F.lag(date).over(w))


def compare_scans(picks: DataFrame, by: list[str], min_move: int = 3) -> DataFrame:
    """G1: new / exit / moved rows of every scan against the previous one."""
    scans = previous_scan(picks, by)
    nxt = scans.select(*by, C("prev_date").alias("_d"), C(DATE).alias("_cur")).where(C("_d").isNotNull())
    cur = picks.join(scans.where(C("prev_date").isNotNull()).select(*by, DATE), [*by, DATE], "left_semi").select(*by, DATE, SYMBOL, "rank")
    prev = picks.withColumnRenamed(DATE, "_d").join(nxt, [*by, "_d"]).select(*by, C("_cur").alias(DATE), SYMBOL, C("rank").alias("prev_rank"))
    j = cur.join(prev, [*by, DATE, SYMBOL], "full")
    delta = C("prev_rank") - C("rank")
    status = F.when(C("prev_rank").isNull(), "new").when(C("rank").isNull(), "exit").when(F.abs(delta) >= min_move, "moved").otherwise("stayed")
    return j.withColumns({"status": status, "rank_change": F.coalesce(delta, F.lit(0)).cast("long")})


def turnover(picks: DataFrame, by: list[str]) -> DataFrame:
    """Overlap and turnover of consecutive scans."""
    j = compare_scans(picks, by).groupBy(*by, DATE).agg(
        F.count("rank").alias("curr_count"),
        F.count("prev_rank").alias("prev_count"),
        F.count_if(C("rank").isNotNull() & C("prev_rank").isNotNull()).alias("overlap"),
    )
    return j.withColumns(
        {
            "new_entries": C("curr_count") - C("overlap"),
            "exits": C("prev_count") - C("overlap"),
            "turnover": 1 - C("overlap") / F.greatest(C("curr_count"), C("prev_count"), F.lit(1)),
            "jaccard": C("overlap") / (C("curr_count") + C("prev_count") - C("overlap")),
        }
    )


def stability(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Mean, median, min and max Jaccard over the scans of a mode."""
    return pairs.groupBy(*by).agg(
        F.avg("jaccard").alias("mean_jaccard"),
        F.median("jaccard").alias("median_jaccard"),
        F.min("jaccard").alias("min_jaccard"),
        F.max("jaccard").alias("max_jaccard"),
        F.count(F.lit(1)).alias("n_pairs"),
    )


def overlap_bonus(scored: DataFrame, picks: DataFrame, by: list[str], bonus: float = 0.03) -> DataFrame:
    """Bonus for names picked in the previous scan of the mode."""
    nxt = previous_scan(picks, by).select(*by, C("prev_date").alias("_d"), C(DATE).alias("_cur"))
    prev = picks.withColumnRenamed(DATE, "_d").join(nxt, [*by, "_d"]).select(*by, C("_cur").alias(DATE), SYMBOL, F.lit(bonus).alias("overlap_bonus"))
    d = scored.join(prev, [*by, DATE, SYMBOL], "left").withColumn("overlap_bonus", F.coalesce("overlap_bonus", F.lit(0.0)))
    return d.withColumn("composite_score", C("composite_score") * (1 + C("overlap_bonus")))


def mode_overlap(picks: DataFrame, modes: list[str]) -> DataFrame:
    """Mean number of shared picks per mode pair; one wide row per (date, symbol), no self-join."""
    wide = picks.groupBy(DATE, SYMBOL).agg(*[F.max((C("mode") == m).cast("int")).alias(m) for m in modes])
    pairs = [(a, b) for i, a in enumerate(modes) for b in modes[i:]]
    per = wide.groupBy(DATE).agg(*[F.sum(C(a) * C(b)).alias(f"{a}|{b}") for a, b in pairs])
    avg = per.agg(*[F.avg(f"`{a}|{b}`").alias(f"{a}|{b}") for a, b in pairs])
    rows = F.array(*[F.struct(F.lit(a).alias("mode_a"), F.lit(b).alias("mode_b"), C(f"`{a}|{b}`").alias("shared")) for a, b in pairs])
    return avg.select(F.explode(rows).alias("_r")).select("_r.*")


def tier_changes(tiers: DataFrame, by: list[str]) -> DataFrame:
    """Tier moves against the previous scan of the same name, with a label."""
    order = F.lit(0)
    for t, o in TIER_ORDER.items():
        order = F.when(C("chip_tier") == t, o).otherwise(order)
    w = Window.partitionBy(*by, SYMBOL).orderBy(DATE)
    d = tiers.withColumn("_o", order).withColumns({"prev_tier": F.lag("chip_tier").over(w), "_p": F.lag("_o").over(w)})
    d = d.where(C("_p").isNotNull() & (C("_p") != C("_o")))
    label = F.concat(C("prev_tier"), F.lit("→"), C("chip_tier"))
    return d.withColumns({"direction": F.when(C("_o") < C("_p"), "downgrade").otherwise("upgrade"), "label": label}).drop("_o", "_p")


def audit_events(df: DataFrame, keys: list[str], flags: list[str], adjustments: list[str]) -> DataFrame:
    """Event rows from stage flags (False = removed there) and score adjustments."""
    hard = [F.when(~C(f), F.struct(F.lit(f).alias("stage"), F.lit("hard_filter").alias("type"), F.lit(0.0).alias("value"))) for f in flags]
    soft = [F.when(F.abs(C(a)) >= 1e-6, F.struct(F.lit(a).alias("stage"), F.lit("score_adj").alias("type"), C(a).cast("double").alias("value"))) for a in adjustments]
    ev = F.filter(F.array(*hard, *soft), lambda e: e.isNotNull())
    return df.select(*keys, F.explode(ev).alias("_e")).select(*keys, "_e.*")
