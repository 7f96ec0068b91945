"""Stored tables: export, import with a schema contract, keyed upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import DATE, SYMBOL


def select_for_export(df: DataFrame, symbols=None, start=None, end=None, date: str | None = None) -> DataFrame:
    """A1: predicates on symbol and date (both reach the scan), surrogate id dropped."""
    if date is None:
        date = DATE if DATE in df.columns else "scan_date"
    if symbols:
        df = df.where(F.col(SYMBOL).isin(list(symbols)))
    if start is not None:
        df = df.where(F.col(date) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col(date) <= F.lit(end).cast("date"))
    return df.drop("id")


def export_table(df: DataFrame, path: str, fmt: str = "parquet", **predicates) -> None:
    out = select_for_export(df, **predicates)
    if fmt == "csv":
        out.write.mode("overwrite").option("header", True).csv(path)
    elif fmt == "parquet":
        out.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"unsupported format {fmt}")


def schema_errors(df: DataFrame, schema: T.StructType) -> DataFrame:
    """A3: missing required columns and unparseable dates as (column_name, problem, n_rows)."""
    missing = [f.name for f in schema.fields if not f.nullable and f.name not in df.columns]
    checks = [f.name for f in schema.fields if f.name in df.columns and isinstance(f.dataType, (T.DateType, T.TimestampNTZType, T.TimestampType))]
    bad = lambda c: F.count_if(F.col(c).isNotNull() & F.to_timestamp_ntz(F.try_to_timestamp(F.col(c).cast("string")).cast("string")).isNull())
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit("missing").alias("problem"), F.lit(0).cast("long").alias("n_rows")) for c in missing]
    rows += [F.struct(F.lit(c).alias("column_name"), F.lit("bad_date").alias("problem"), bad(c).alias("n_rows")) for c in checks]
    if not rows:
        return df.sparkSession.createDataFrame([], "column_name string, problem string, n_rows long")
    return df.agg(F.array(*rows).alias("_r")).select(F.explode("_r").alias("_e")).select("_e.*").where("problem = 'missing' or n_rows > 0")


def read_import(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A2: CSV or Parquet by suffix, projected and cast to the declared schema."""
    raw = spark.read.option("header", True).csv(path) if path.rstrip("/").endswith(".csv") else spark.read.parquet(path)
    return raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields if f.name in raw.columns])


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """A4: keep every old row, add the new rows with unknown keys; of new rows with one key the first by ``order``."""
    fresh = one_per_key(nan_to_null(new), keys, order, last=False).join(old.select(*keys), keys, "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def insert_update(old: DataFrame, new: DataFrame, keys: list[str], update: list[str], order: str | None = None) -> DataFrame:
    """A4: new keys are added; on known keys only the ``update`` columns change, to the last new row by ``order``."""
    n = one_per_key(nan_to_null(new), keys, order, last=True)
    n = n.select(*keys, F.struct(*[c for c in n.columns if c not in keys]).alias("_new"))
    o = old.select(*keys, F.struct(*[c for c in old.columns if c not in keys]).alias("_old"))
    j = o.join(n, keys, "full")
    pick = lambda c: F.when(F.col("_old").isNull(), F.col(f"_new.{c}")).when(F.col("_new").isNotNull() & F.lit(c in update), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}"))
    return j.select(*keys, *[pick(c).alias(c) for c in old.columns if c not in keys])


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is no value in a stored table."""
    bad = {f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    return df.withColumns(bad) if bad else df


def one_per_key(df: DataFrame, keys: list[str], order: str | None, *, last: bool) -> DataFrame:
    """One row per key, the first or last by the version column ``order``, as map-side aggregation.

    Rows without a version come before all others; ties, and tables without such a column, go by the other columns.
    """
    rest = [c for c in df.columns if c not in keys and c != order]
    rank = [order, *rest] if order else rest
    pick = F.max if last else F.min
    g = df.groupBy(*keys).agg(pick(F.struct(*rank)).alias("_r"))
    return g.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def write_partitions(df: DataFrame, path: str, by: str = DATE) -> None:
    """Replace only the partitions present in ``df``; a retried job writes the same result."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def last_dates(df: DataFrame, wanted: DataFrame, date: str = DATE) -> DataFrame:
    """A5: high-water mark per requested symbol (NULL when it has no rows)."""
    return wanted.select(SYMBOL).join(df.groupBy(SYMBOL).agg(F.max(date).alias("last_date")), SYMBOL, "left")


def pivot_names(df: DataFrame, type_map: dict[str, str], keys=(DATE, SYMBOL), order: str | None = None) -> DataFrame:
    """(type, value) rows -> columns, the first by ``order``; values that do not parse become NULL."""
    types = list(type_map)
    v = F.col("value").try_cast("double")
    first = lambda x: F.min_by(x, F.when(x.isNotNull(), F.struct(order, x))) if order else F.min(x)
    cols = [first(F.when(F.col("type") == t, v)).alias(type_map[t]) for t in types]
    return df.where(F.col("type").isin(types)).groupBy(*keys).agg(*cols)


def enough_rows(bars: DataFrame, minimum: int) -> DataFrame:
    return bars.groupBy(DATE).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= minimum).select(DATE)


def false_delistings(info: DataFrame, bars: DataFrame, minimum: int = 3) -> DataFrame:
    """Clear ``delisted_date`` where enough distinct trading days follow it."""
    d = bars.select(SYMBOL, DATE).join(info.where(F.col("delisted_date").isNotNull()).select(SYMBOL, "delisted_date"), SYMBOL)
    d = d.where(F.col(DATE) > F.col("delisted_date")).groupBy(SYMBOL).agg(F.countDistinct(DATE).alias("_n"))
    j = info.join(d, SYMBOL, "left")
    cleared = F.coalesce(F.col("_n") >= minimum, F.lit(False))
    return j.withColumns({"cleared": cleared, "delisted_date": F.when(~cleared, F.col("delisted_date"))}).drop("_n")


def map_diff(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Key-wise difference of two metric tables."""
    j = a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key, "full")
    return j.withColumn("delta", F.col("b") - F.col("a"))

