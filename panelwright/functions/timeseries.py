"""Per-series building blocks: rolling gates, streaks, recurrences, as-of joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exprs import DATE, SYMBOL, col, symbol_window, trailing


def rolling(agg: Column, value: Column, n: int, min_periods: int | None = None, *, order=DATE, key=SYMBOL) -> Column:
    """``agg`` over the last n rows, NULL until ``min_periods`` values exist."""
    w = trailing(n, order, key)
    k = n if min_periods is None else min_periods
    if k <= 1:
        return agg.over(w)
    return F.when(F.count(value).over(w) >= k, agg.over(w))


def ret(value, n: int, *, order=DATE, key=SYMBOL) -> Column:
    """Simple return over n rows."""
    v = col(value)
    p = F.lag(v, n).over(symbol_window(order, key))
    return v / F.when(p != 0, p) - 1


def streak(df: DataFrame, hit: Column, out: str, *, order=DATE, key=SYMBOL) -> DataFrame:
    """Length of the run of ``hit`` rows that ends at each row (0 on a miss)."""
    # hits so far less those before the last miss, all in one order: a window by run would sort the rows anew, twice
    w = symbol_window(order, key)
    peers = w.rangeBetween(Window.currentRow, Window.currentRow)
    df = df.withColumn("_hit", F.when(F.coalesce(hit, F.lit(False)), 1).otherwise(0))
    hits = F.sum("_hit").over(w)
    df = df.withColumns({"_hits": hits, "_gone": F.when(F.min("_hit").over(peers) == 0, hits - F.sum("_hit").over(peers))})
    n = F.col("_hits") - F.coalesce(F.max("_gone").over(w), F.lit(0))
    return df.withColumn(out, n.cast("long")).drop("_hit", "_hits", "_gone")


def smooth(
    df: DataFrame,
    specs: dict[str, tuple[str, float]],
    *,
    order=DATE,
    key=SYMBOL,
    seed: int = 0,
    size: int | None = None,
    rows: int | None = None,
) -> DataFrame:
    """First-order recurrences y[i] = (1-alpha)*y[i-1] + alpha*x[i].

    ``specs`` maps an output name to (input column, alpha); the inputs of one call must be NULL on
    the same rows.  y starts with the first non-null x.  With ``seed`` = n > 0 the start value is
    instead the mean of the first n non-null inputs and earlier rows stay NULL (Wilder seeding).

    The recurrence has the closed form y[i] = q^i * sum_j w[j]*x[j]*q^-j, one cumulative sum per
    block of rows.  The block length keeps q^-j below 1e17, and only as many earlier blocks
    are carried over as double precision can see, so series of any length need no
    row-by-row pass: three window passes serve all outputs of the call.

    ``rows`` is the most rows that a series can have, where the caller knows it, such as the dates of the calendar. If
    the powers of so many rows are within double range, one block holds any series, and two passes in the order of the
    rows do.
    """
    keys = [key] if isinstance(key, str) else list(key)
    base = symbol_window(order, key)
    past = base.rowsBetween(Window.unboundedPreceding, 0)
    decay = {o: 1.0 - a for o, (_, a) in specs.items()}
    ref = F.col(next(iter(specs.values()))[0])
    n, first = F.col("_n"), max(seed, 1)
    df = df.withColumn("_n", F.count(ref).over(past))
    if seed:
        head = {f"_h{o}": F.avg(F.when(n <= seed, F.col(x))).over(past) for o, (x, _) in specs.items()}
        df = df.withColumns(head)
    live = n >= first
    if rows is not None and size is None and all(-math.log(q) * rows < 600 for q in decay.values()):
        # powers are constants, looked up by row
        at = (n - first).cast("int")
        power = lambda q, sign: F.coalesce(F.get(F.expr(f"array({', '.join(f'{q ** (sign * i)!r}D' for i in range(rows + 1))})"), at), F.pow(F.lit(q), at * sign))
        out = {}
        for o, (x, a) in specs.items():
            start = F.col(f"_h{o}") if seed else F.col(x)
            term = F.when(F.col(x).isNotNull() & live, F.when(n == first, start).otherwise(F.col(x) * a))
            out[o] = F.when(live, F.sum(term * power(decay[o], -1)).over(past) * power(decay[o], 1))
        return df.withColumns(out).drop("_n", *([f"_h{o}" for o in specs] if seed else []))
    size = size or max(2, min(int(math.ceil(39.0 / -math.log(q))) for q in decay.values()))
    df = df.withColumn("_b", F.floor(F.when(live, n - first) / size).cast("int"))
    df = df.withColumn("_p", F.when(live, n - first - F.col("_b") * size))
    p = F.col("_p")
    blk = Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = {}
    for o, (x, a) in specs.items():
        start = F.col(f"_h{o}") if seed else F.col(x)
        term = F.when(F.col(x).isNotNull() & live, F.when(n == first, start).otherwise(F.col(x) * a))
        local[f"_y{o}"] = F.sum(term * F.pow(F.lit(decay[o]), -p)).over(blk) * F.pow(F.lit(decay[o]), p)
    df = df.withColumns(local)
    prev = Window.partitionBy(*keys).orderBy("_b")
    out = {}
    for o, q in decay.items():
        y = F.col(f"_y{o}")
        end = F.max(F.when((p == size - 1) & ref.isNotNull(), y))
        for k in range(1, int(math.ceil(39.0 / (-math.log(q) * size))) + 1):
            carry = F.coalesce(end.over(prev.rangeBetween(-k, -k)), F.lit(0.0))
            y = y + carry * F.pow(F.lit(q), p + 1 + (k - 1) * size)
        out[o] = F.when(live, y)
    df = df.withColumns(out)
    return df.drop("_n", "_b", "_p", *local, *([f"_h{o}" for o in specs] if seed else []))


def asof(
    probes: DataFrame,
    facts: DataFrame,
    *,
    on,
    probe_date: str,
    fact_date: str,
    values: list[str],
    tolerance_days: int | None = None,
    allow_exact: bool = True,
    forward: bool = False,
    matched: str | None = None,
    unique: bool = False,
) -> DataFrame:
    """As-of join by one sort: union both sides and carry the last fact along.

    Probes first collapse to distinct (key, date), so a hot key costs one row per date in the
    sort; the hits are joined back by equality.  Pass ``unique`` when the probes already are
    distinct.

    Rows of ``probes`` are kept; ``values`` are NULL without a match inside the
    tolerance.  ``matched`` names an output column for the matched fact date.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if not unique:
        hits = asof(
            probes.select(*keys, probe_date).distinct(), facts, on=keys, probe_date=probe_date, fact_date=fact_date, values=values,
            tolerance_days=tolerance_days, allow_exact=allow_exact, forward=forward, matched=matched, unique=True,
        )
        new = [*values, *([matched] if matched else [])]
        hits = hits.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(probe_date).alias("_kd"), *new)
        cond = F.col(probe_date) == F.col("_kd")
        for i, k in enumerate(keys):
            cond = cond & (F.col(k) == F.col(f"_k{i}"))
        return probes.join(hits, cond, "left").drop("_kd", *[f"_k{i}" for i in range(len(keys))])
    pcols = probes.columns
    fact = F.struct(F.col(fact_date).alias("_d"), *[F.col(v) for v in values])
    left = probes.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col(probe_date).alias("_t"),
        F.lit(1 if allow_exact != forward else 0).alias("_side"),
        F.lit(True).alias("_is_probe"),
        F.struct(*[F.col(c) for c in pcols]).alias("_row"),
    )
    right = facts.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col(fact_date).alias("_t"),
        F.lit(0 if allow_exact != forward else 1).alias("_side"),
        F.lit(False).alias("_is_probe"),
        fact.alias("_fact"),
    )
    u = left.unionByName(right, allowMissingColumns=True)
    w = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))])
    if forward:
        w = w.orderBy("_t", "_side").rowsBetween(0, Window.unboundedFollowing)
        hit = F.first("_fact", ignorenulls=True).over(w)
    else:
        w = w.orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
        hit = F.last("_fact", ignorenulls=True).over(w)
    u = u.withColumn("_hit", hit).where("_is_probe")
    if tolerance_days is not None:
        ok = F.abs(F.datediff(F.col("_t"), F.col("_hit._d"))) <= tolerance_days
        u = u.withColumn("_hit", F.when(ok, F.col("_hit")))
    out = [F.col(f"_row.{c}").alias(c) for c in pcols] + [F.col(f"_hit.{v}").alias(v) for v in values]
    if matched:
        out.append(F.col("_hit._d").alias(matched))
    return u.select(*out)


def forward_rows(bars: DataFrame, horizons, cols: list[str], *, key=SYMBOL, order=DATE) -> DataFrame:
    """Values of the h-th following row as ``{col}_{h}`` (no join needed on a panel)."""
    w = symbol_window(order, key)
    return bars.withColumns({f"{c}_{h}": F.lead(c, h).over(w) for h in horizons for c in cols})


def busday_ordinal(d) -> Column:
    """Number of weekdays since Monday 1970-01-05; differences count weekdays in [a, b)."""
    n = F.datediff(col(d), F.lit("1970-01-05").cast("date"))
    return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))


def busdays(a, b) -> Column:
    return (busday_ordinal(b) - busday_ordinal(a)).cast("long")


def add_busdays(d, n: int) -> Column:
    """Roll a weekend date forward to Monday, then step n weekdays."""
    d = col(d)
    wd = F.weekday(d)
    start = F.when(wd >= 5, F.date_add(d, 7 - wd)).otherwise(d)
    pos = F.when(wd >= 5, F.lit(0)).otherwise(wd)
    return F.date_add(start, (n + F.floor((pos + n) / 5).cast("int") * 2))
