import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.sources import tables as tb

SCHEMA = T.StructType([T.StructField("symbol", T.LongType(), False), T.StructField("date", T.DateType(), False), T.StructField("close", T.DoubleType(), True)])
D = dt.date


def prices(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_export_import_round_trip(spark, tmp_path):
    df = prices(spark, [(1, D(2024, 1, 1), 1.5), (2, D(2024, 1, 2), None), (1, D(2024, 2, 1), 3.0)]).withColumn("id", F.lit(9))
    for fmt in ("csv", "parquet"):
        path = str(tmp_path / f"out.{fmt}")
        tb.export_table(df, path, fmt, symbols=[1], start="2024-01-01", end="2024-01-31")
        back = tb.read_import(spark, path, SCHEMA)
        assert [tuple(r) for r in back.collect()] == [(1, D(2024, 1, 1), 1.5)]


def test_schema_errors(spark):
    raw = spark.createDataFrame([("1", "2024-01-01"), ("2", "n/a")], "symbol string, date string")
    want = T.StructType([*SCHEMA.fields[:2], T.StructField("open", T.DoubleType(), False)])
    got = {(r.column_name, r.problem, r.n_rows) for r in tb.schema_errors(raw, want).collect()}
    assert got == {("open", "missing", 0), ("date", "bad_date", 1)}


def test_upserts(spark):
    old = prices(spark, [(1, D(2024, 1, 1), 1.0), (2, D(2024, 1, 1), 2.0)])
    new = prices(spark, [(2, D(2024, 1, 1), 20.0), (3, D(2024, 1, 1), 30.0)])
    ks = ["symbol", "date"]
    assert {r.symbol: r.close for r in tb.insert_ignore(old, new, ks).collect()} == {1: 1.0, 2: 2.0, 3: 30.0}
    assert {r.symbol: r.close for r in tb.insert_update(old, new, ks, ["close"]).collect()} == {1: 1.0, 2: 20.0, 3: 30.0}
    assert {r.symbol: r.close for r in tb.insert_update(old, new, ks, []).collect()} == {1: 1.0, 2: 2.0, 3: 30.0}


def test_repeated_keys_in_a_batch_follow_the_version(spark):
    old = prices(spark, [(2, D(2024, 1, 1), 2.0)])
    rows = [(s, D(2024, 1, 1), c, v) for s, c, v in ((2, 30.0, 1), (2, 20.0, 2), (3, 1.0, 2), (3, 9.0, 1), (4, float("nan"), 1))]
    new = spark.createDataFrame(rows, "symbol long, date date, close double, version int")
    ks = ["symbol", "date"]
    assert {r.symbol: r.close for r in tb.insert_update(old, new, ks, ["close"], "version").collect()} == {2: 20.0, 3: 1.0, 4: None}
    assert {r.symbol: r.close for r in tb.insert_ignore(old, new, ks, "version").collect()} == {2: 2.0, 3: 9.0, 4: None}


def test_rounding_passes_large_values(spark):
    from panelwright.functions.exprs import rnd

    df = spark.createDataFrame([(1e15,), (-1e20,), (2.5,), (-0.0000005,), (float("nan"),), (None,)], "x double")
    got = [r[0] for r in df.select(rnd("x", 6)).collect()]
    assert got[:2] == [1e15, -1e20] and got[2] == 2.5 and got[3] == -1e-6 and got[4] != got[4] and got[5] is None


def test_partition_overwrite_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    tb.write_partitions(prices(spark, [(1, D(2024, 1, 1), 1.0), (1, D(2024, 1, 2), 2.0)]), path)
    for _ in range(2):
        tb.write_partitions(prices(spark, [(1, D(2024, 1, 2), 9.0)]), path)
    got = {(r.date, r.close) for r in spark.read.parquet(path).collect()}
    assert got == {(D(2024, 1, 1), 1.0), (D(2024, 1, 2), 9.0)}


def test_pivot_names_keeps_unparseable_as_null(spark):
    df = spark.createDataFrame([("2024-03-31", 1, "EPS", "1.5"), ("2024-03-31", 1, "Revenue", "x"), ("2024-03-31", 1, "Other", "7")], "date string, symbol int, type string, value string")
    r = tb.pivot_names(df, {"EPS": "eps", "Revenue": "revenue"}).first()
    assert (r.eps, r.revenue) == (1.5, None)
