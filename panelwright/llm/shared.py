"""Tables written to the folder that all executors share, to cut lineage and to be read more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; only a local master may go without it, and then gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="panelwright-llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written once and read back: an executor lost later costs a read, not a recomputation."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete what `stored` has written in this application, once no result that reads it is needed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def carried(columns: tuple[str, ...]) -> Column:
    """The columns that a caller wants beside the results, as one struct that no result can clash with."""
    return (F.struct(*columns) if columns else F.lit(0)).alias("row")


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()
