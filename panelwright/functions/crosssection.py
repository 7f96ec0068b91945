"""Ranks and quantiles inside a group of rows.

Two meanings of a group, chosen where a query is written and never by the size of its input:

* a cross-section (``CrossSection()``): the rows of one date, one per name. A window by date is exact.
* a pool (``CrossSection(pooled=True)``): all rows of a panel, or of a factor or mode over all dates. Values are
  pre-aggregated per (group, value), dealt out in value order, counted per range and joined back, so no group is ever
  sorted in one task and equal values collapse first. What several branches read is checkpointed once.
"""

from __future__ import annotations

import tempfile
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def _keys(by):
    return [by] if isinstance(by, str) else list(by)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a session in one process may go without it, and then gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="panelwright-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably, so that several readers share one result and lineage stays short."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def count_below(df: DataFrame, by, value: str) -> DataFrame:
    """Distinct (by, value) rows with ``n_eq``, ``n_below`` and ``n_all``.

    Distinct values are range-partitioned by (by, value); the number of the range is stored with them, so that every
    reader sees the same ranges. A group's offsets are sums over its ranges, as many as there are shuffle partitions.
    """
    by = _keys(by)
    d = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n_eq"))
    d = cut(d.repartitionByRange(*by, value).withColumn("_r", F.spark_partition_id()))
    group = [*by, "_r"]
    tot = d.groupBy(*group).agg(F.sum("n_eq").alias("_n"))
    w = Window.partitionBy(*by)
    before = w.orderBy(*group[len(by) :]).rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.withColumns({"_off": F.coalesce(F.sum("_n").over(before), F.lit(0)), "n_all": F.sum("_n").over(w)}).drop("_n")
    inside = Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    d = d.join(tot, group)
    return d.select(*by, value, "n_eq", (F.col("_off") + F.coalesce(F.sum("n_eq").over(inside), F.lit(0))).alias("n_below"), "n_all")


@dataclass(frozen=True)
class CrossSection:
    """Exact operators on groups; ``pooled`` says what a group is, and never changes a result.

    With ``columns`` a cross-section is ranked as columns, in numpy: a window sorts and copies whole rows for each ranked
    column. Rows don't lie by group afterwards, so this is for frames that are ranked once, by many columns.
    """

    pooled: bool = False
    columns: bool = False

    def pct_rank(self, df: DataFrame, by, specs: dict[str, tuple[str, bool]]) -> DataFrame:
        """Average rank divided by the non-null count; NULL stays NULL.

        ``specs``: output -> (column, ascending).
        """
        by = _keys(by)
        if self.columns:
            return _ranked_columns(df, by, specs)
        if not self.pooled:
            return df.withColumns({o: pr(c, by, asc) for o, (c, asc) in specs.items()})
        base = df = cut(df)
        up = (F.col("n_below") + (F.col("n_eq") + 1) / 2) / F.col("n_all")
        down = (F.col("n_all") - F.col("n_below") - F.col("n_eq") + (F.col("n_eq") + 1) / 2) / F.col("n_all")
        for c in dict.fromkeys(c for c, _ in specs.values()):  # one pass a column, whatever is asked of it
            r = count_below(base.select(*by, c), by, c)
            outs = [(up if asc else down).alias(o) for o, (x, asc) in specs.items() if x == c]
            r = r.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], F.col(c).alias("_v"), *outs)
            cond = F.col(c) == F.col("_v")
            for i, k in enumerate(by):
                cond = cond & F.col(k).eqNullSafe(F.col(f"_k{i}"))
            df = df.join(r, cond, "left").drop("_v", *[f"_k{i}" for i in range(len(by))])
        return df

    def row_rank(self, df: DataFrame, by, score: str, out: str, *, tie: str = "symbol", desc: bool = True) -> DataFrame:
        """1..n by score, NULL scores last, ties by ``tie`` ascending."""
        by = _keys(by)
        if not self.pooled:
            s = F.col(score).desc_nulls_last() if desc else F.col(score).asc_nulls_last()
            w = Window.partitionBy(*by).orderBy(s, F.col(tie))
            return df.withColumn(out, F.row_number().over(w).cast("long"))
        df = cut(df)
        low = F.lit(float("-inf"))
        df = df.withColumn("_s", F.coalesce(F.col(score) if desc else -F.col(score), low))
        # -inf would break the linear ranges, so missing scores are ranked as their own group
        df = df.withColumn("_m", (F.col("_s") == low).cast("int"))
        df = df.withColumn("_s", F.when(F.col("_m") == 1, 0.0).otherwise(F.col("_s")))
        first = count_below(df.select(*by, "_m", "_s"), [*by, "_m"], "_s")
        first = first.select(*by, "_m", "_s", (F.col("n_all") - F.col("n_below") - F.col("n_eq")).alias("_a"))
        real = df.groupBy(*by).agg(F.sum(1 - F.col("_m")).alias("_real"))
        second = count_below(df.select(*by, "_m", "_s", tie), [*by, "_m", "_s"], tie)
        second = second.select(*by, "_m", "_s", tie, F.col("n_below").alias("_t"))
        df = df.join(first, [*by, "_m", "_s"]).join(second, [*by, "_m", "_s", tie]).join(real, by)
        rank = F.col("_a") + F.col("_t") + 1 + F.col("_m") * F.col("_real")
        return df.withColumn(out, rank.cast("long")).drop("_a", "_t", "_m", "_s", "_real")

    def quantiles(self, df: DataFrame, by, specs: dict[str, tuple[str, float]]) -> DataFrame:
        """One row per group with linear-interpolation quantiles: output -> (column, q)."""
        by = _keys(by)
        if not self.pooled:
            return df.groupBy(*by).agg(*[F.percentile(c, F.lit(q)).alias(o) for o, (c, q) in specs.items()])
        df = cut(df)
        res = df.select(*by).distinct()
        for c in dict.fromkeys(c for c, _ in specs.values()):  # one pass a column, whatever is asked of it
            d = count_below(df.select(*by, c), by, c)
            at = lambda pos: F.max(F.when((F.col("n_below") <= pos) & (pos < F.col("n_below") + F.col("n_eq")), F.col(c)))
            parts, outs = [], []
            for k, (o, q) in enumerate((o, q) for o, (x, q) in specs.items() if x == c):
                p = (F.col("n_all") - 1) * q
                parts += [at(F.floor(p)).alias(f"_x{k}"), at(F.ceil(p)).alias(f"_y{k}"), F.max(p - F.floor(p)).alias(f"_f{k}")]
                outs.append((F.col(f"_x{k}") + (F.col(f"_y{k}") - F.col(f"_x{k}")) * F.col(f"_f{k}")).alias(o))
            res = res.join(d.groupBy(*by).agg(*parts).select(*by, *outs), by, "left")
        return res

    def with_quantiles(self, df: DataFrame, by, specs) -> DataFrame:
        by = _keys(by)
        if not self.pooled:
            w = Window.partitionBy(*by)
            return df.withColumns({o: F.percentile(c, F.lit(q)).over(w) for o, (c, q) in specs.items()})
        df = cut(df)
        return df.join(self.quantiles(df, by, specs), by, "left")

    def with_stats(self, df: DataFrame, by, aggs: dict[str, Column]) -> DataFrame:
        """Attach plain group aggregates (count, avg, min, ...) to every row."""
        by = _keys(by)
        if not self.pooled:
            w = Window.partitionBy(*by)
            return df.withColumns({o: a.over(w) for o, a in aggs.items()})
        df = cut(df)
        return df.join(df.groupBy(*by).agg(*[a.alias(o) for o, a in aggs.items()]), by, "left")

    def with_spread(self, df: DataFrame, by, outs: dict[str, str]) -> DataFrame:
        """Attach max - min of a column over the group: output -> column."""
        pair = {f"_lo_{o}": F.min(c) for o, c in outs.items()} | {f"_hi_{o}": F.max(c) for o, c in outs.items()}
        df = self.with_stats(df, by, pair)
        return df.withColumns({o: F.col(f"_hi_{o}") - F.col(f"_lo_{o}") for o in outs}).drop(*pair)

    def bounds(self, df: DataFrame, by, score: str, n: int, step: float = 1e-3) -> DataFrame:
        """(by, least): the lowest step of ``score`` that can hold one of the best n rows of a group, from counts by step:
        no row is sorted. NULL scores are last, NaN first, as in a descending order."""
        by = _keys(by)
        c = df.groupBy(*by, _step(score, step).alias("least")).agg(F.count(F.lit(1)).alias("_n"))
        w = Window.partitionBy(*by).orderBy(F.desc("least")).rowsBetween(Window.unboundedPreceding, -1)
        c = c.withColumn("_above", F.coalesce(F.sum("_n").over(w), F.lit(0))).where(F.col("_above") < n)
        return c.groupBy(*by).agg(F.min("least").alias("least"))

    def within(self, df: DataFrame, by, score: str, bounds: DataFrame, step: float = 1e-3) -> DataFrame:
        """Rows of ``df`` at or above their group's bound, the best n of ``bounds`` among them."""
        by = _keys(by)
        b = bounds.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], "least")
        cond = _step(score, step) >= F.col("least")
        for i, k in enumerate(by):
            cond = cond & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        return df.join(b, cond).drop("least", *[f"_k{i}" for i in range(len(by))])

    def top(self, df: DataFrame, by, order: list[Column], n, out: str = "rank") -> DataFrame:
        """Best n rows per group.  Spark limits every map-side partition to n rows before
        the exchange, so this needs no pooled form."""
        w = Window.partitionBy(*_keys(by)).orderBy(*order)
        return df.withColumn(out, F.row_number().over(w).cast("long")).where(F.col(out) <= n)


def _ranked_columns(df: DataFrame, by: list[str], specs: dict[str, tuple[str, bool]]) -> DataFrame:
    kept = [f for f in df.schema if f.name not in specs]
    schema = StructType([*kept, *[StructField(o, DoubleType()) for o in specs]])

    def run(t):
        import pyarrow as pa

        ranks = {o: pa.array(v, mask=m) for o, (c, asc) in specs.items() for v, m in [average_ranks(t[c], asc)]}
        return pa.table({f.name: t[f.name] for f in kept} | ranks)

    return df.groupBy(*by).applyInArrow(run, schema)


def average_ranks(column, asc: bool):
    """Average rank / non-null count of an Arrow column, and where it is NULL; NaN is largest, as in Spark."""
    import numpy as np

    missing = column.is_null().to_numpy(zero_copy_only=False) if column.null_count else np.zeros(len(column), bool)
    x = column.drop_null().to_numpy()
    n = len(x)
    order = np.argsort(x, kind="stable")
    s = x[order]
    new = np.ones(n, bool)
    new[1:] = (s[1:] != s[:-1]) & ~((s[1:] != s[1:]) & (s[:-1] != s[:-1]))
    first = np.flatnonzero(new)
    ties = np.diff(np.append(first, n))
    rank = first + 1 if asc else n - first - ties + 1
    out, ranked = np.zeros(len(column)), np.empty(n)
    if n:
        ranked[order] = np.repeat((rank + (ties - 1) / 2) / n, ties)
    out[~missing] = ranked
    return out, missing


def _step(score: str, step: float) -> Column:
    s = F.col(score)
    inf = float("inf")
    return F.when(s.isNull(), -inf).when(F.isnan(s), inf).otherwise(F.floor(F.greatest(F.least(s / step, F.lit(1e15)), F.lit(-1e15))).cast("double"))


def pr(c, by, asc: bool = True) -> Column:
    """Window form of the average-rank percentile."""
    by = _keys(by)
    c = F.col(c) if isinstance(c, str) else c
    order = c.asc_nulls_last() if asc else c.desc_nulls_last()
    w = Window.partitionBy(*by).orderBy(order)
    # one sort serves all three: rank, peers of the row, and the group count
    rank = F.rank().over(w)
    ties = F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow))
    n = F.count(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return F.when(c.isNotNull(), (rank + (ties - 1) / 2) / n)
