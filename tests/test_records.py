"""The SQL of the queries over records, and of the estimates that SQL can express, gives the queries' rows."""

from __future__ import annotations

import duckdb
import pytest

from riskloom import catalogue
from riskloom.plans import record_queries

TABLES = ("nation", "customer", "part", "orders", "lineitem", "events")
ESTIMATES = ("har_forecast", "har_x_forecast", "backtest_p_values", "e_summary", "posterior", "quality_report", "jump_flags", "trade_summary")


@pytest.mark.parametrize("name", [*record_queries.QUERIES, *ESTIMATES])
def test_sql_gives_the_rows_of_the_query(spark, sf_dir, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    want = db.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = catalogue.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(names)
    key = lambda row: tuple((v is None, isinstance(v, float), str(v)) for v in row)
    ours = sorted((tuple(r[c] for c in sorted(names)) for r in got.collect()), key=key)
    theirs = sorted((tuple(dict(zip(names, r))[c] for c in sorted(names)) for r in want.fetchall()), key=key)
    assert ours == theirs
