from __future__ import annotations

import datetime as dt
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from riskloom import catalogue
from riskloom.operators import var_es

SCHEMA = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp"


def items(days: int):
    """Two items a day of one symbol, whose close goes up and down by 1 %: no return falls below its quantile."""
    return [(d, 1, 1, i, 1.0, 100.0 + d % 2 + 2 * (i == 1), "A", "F", dt.datetime(2021, 1, 1) + dt.timedelta(d)) for d in range(days) for i in (1, 2)]


@pytest.mark.parametrize("days", [90, 32, 20])
def test_pooled_t_without_hits_equals_its_sql(spark, tmp_path, days):
    spark.createDataFrame(items(days), SCHEMA).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    want = sorted(db.execute(catalogue.oracle_sql()["pooled_t"]).fetchall(), key=str)
    got = sorted(map(tuple, catalogue.queries()["pooled_t"](spark, str(tmp_path)).collect()), key=str)
    assert got == want and [r[1] for r in got] == [{90: -math.inf}.get(days)] * 2


@pytest.mark.parametrize("x, want", [(-0.25, -math.inf), (0.1, math.inf), (0.0, math.nan)])
def test_t_of_equal_values_over_many_partitions(spark, x, want):
    e = spark.range(0, 2468, 1, 50).select((F.col("id") * 0.0 + x).alias("e"))
    got = var_es.mean_t(e, F.col("e"), F.lit(0.0)).first()
    assert got.n == 2468 and (got.t == want or math.isnan(got.t) and math.isnan(want))


def test_t_needs_two_rows(spark):
    one = spark.createDataFrame([(1.0,), (None,)], "e double")
    assert tuple(var_es.mean_t(one, F.col("e"), F.lit(0.0)).first()) == (1, None)
    two = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0), ("b", 3.0)], "k string, e double")
    assert {r.k: r.t for r in var_es.mean_t(two, F.col("e"), F.lit(0.0), ["k"]).collect()} == {"a": pytest.approx(3.0), "b": math.inf}
