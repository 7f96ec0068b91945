"""Small column expressions shared by all operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SYMBOL = "symbol"
DATE = "date"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def div(a, b) -> Column:
    """a / b with NULL instead of an error for a zero denominator."""
    b = col(b)
    return col(a).cast("double") / F.when(b != 0, b.cast("double"))


def clip(x, lo, hi) -> Column:
    """Clamp to [lo, hi]; NULL stays NULL."""
    x = col(x)
    return F.when(x < lo, F.lit(float(lo))).when(x > hi, F.lit(float(hi))).otherwise(x)


def flag(cond: Column) -> Column:
    """1/0 as bigint; NULL conditions count as 0."""
    return F.coalesce(cond.cast("int"), F.lit(0)).cast("long")


def bucket(x, steps, default) -> Column:
    """First matching label of ``[(predicate(x), label)...]``."""
    x = col(x)
    out = None
    for pred, label in steps:
        cond, val = pred(x), label if isinstance(label, Column) else F.lit(label)
        out = F.when(cond, val) if out is None else out.when(cond, val)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def mean_of(*cols) -> Column:
    """Row mean over the non-null inputs (NULL when all are NULL)."""
    cs = [col(c) for c in cols]
    tot = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cs])
    n = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cs])
    return tot / F.when(n > 0, n)


def wsum(weights: dict) -> Column:
    """Weighted sum of columns (NULL-propagating)."""
    return reduce(lambda a, b: a + b, [col(c) * F.lit(float(w)) for c, w in weights.items()])


def lookup(key: Column, table: dict, default=None) -> Column:
    """Fixed-size dictionary lookup as a CASE expression."""
    out = None
    for k, v in table.items():
        cond = key.isNull() if k is None else key == F.lit(k)
        out = F.when(cond, F.lit(v)) if out is None else out.when(cond, F.lit(v))
    return out.otherwise(F.lit(default))


def symbol_window(order=DATE, key=SYMBOL):
    """Ordered window of one series.  The panel grain is (symbol, date), so a
    partition never holds more rows than the calendar has dates."""
    keys = [key] if isinstance(key, str) else list(key)
    return Window.partitionBy(*keys).orderBy(order)


def trailing(n: int, order=DATE, key=SYMBOL):
    return symbol_window(order, key).rowsBetween(-(n - 1), 0)


def rnd(x, d: int) -> Column:
    """Round half away from zero in plain double arithmetic (no decimal detour).

    A value within 1e-4 of a half unit counts as a half, so summation order never shows. From 2**53 units on a double
    has no such digits, and the value passes through.
    """
    x, m = col(x).cast("double"), float(10**d)
    up = lambda v: F.floor(v * m + 0.5001)
    return F.when(~(F.abs(x) * m < 2.0**53), x).when(x < 0, -up(-x) / m).otherwise(up(x) / m)


def corr(x, y, over=None) -> Column:
    """Pearson correlation, NULL (not an error) when a side has no spread."""
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    parts = [F.covar_pop(x, y), F.stddev_pop(x), F.stddev_pop(y)]
    c, sx, sy = [a.over(over) for a in parts] if over is not None else parts
    return c / F.when(sx * sy > 1e-15, sx * sy)


def output(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Round declared double columns and widen ints so both engines agree."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in digits:
            c = rnd(c, digits[f.name])
        elif f.dataType.typeName() in ("integer", "short", "byte"):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(*cols)
