"""The registered SQL, run by DuckDB on whole tables, gives the queries' rows."""

from __future__ import annotations

import duckdb
import pytest

from riskloom.llm import registry

TABLES = ("documents", "pages", "benchmark")


def in_order(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr([r[k] for k in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql_gives_the_rows_of_the_query(spark, sf_dir, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    want = db.execute(registry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = registry.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(names)
    assert in_order(got.columns, got.collect()) == in_order(names, want.fetchall())


def test_suffix_sql_with_nulls_empty_short_and_repeated_rows(spark, tmp_path):
    base = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(450))
    texts = [None, "", "short", base, base, base[:199], "x" * 450, "é" * 120, base[:230] + "tail" + base[100:430]]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(i // 2, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, n_bytes string").write.parquet(path)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    want = db.execute(registry.oracle_sql()["op4_suffix_dedup"])
    names = [c[0] for c in want.description]
    got = registry.queries()["op4_suffix_dedup"](spark, str(tmp_path))
    assert in_order(got.columns, got.collect()) == in_order(names, want.fetchall())
