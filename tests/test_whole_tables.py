from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.functions.columns import by
from riskloom.operators import features, garch, leakage
from riskloom.plans import power, series_queries, study_queries
from riskloom.plans.risk_queries import _losses
from riskloom.sources import adapters


def test_garch_forecasts_take_all_days(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(garch, "walk_forward_forecasts", lambda returns: returns)
    monkeypatch.setattr(garch, "var_es", lambda forecasts, p: forecasts)
    assert study_queries.garch_forecast(spark, sf_dir).count() == study_queries._returns(spark, sf_dir).count()


def test_symbols_with_too_few_returns_have_no_forecast(spark, sf_dir):
    few = study_queries._returns(spark, sf_dir).where("day < date'1995-03-01'")
    assert garch.walk_forward_forecasts(few).count() == 0 and few.count() > 0


def test_power_resamples_all_days(spark, sf_dir, monkeypatch):
    seen = []
    monkeypatch.setattr(power, "criterion_power", lambda spark, d, *_: seen.append(d) or spark.range(1).toDF("delta"))
    study_queries.bootstrap_power(spark, sf_dir)
    want = power.wide(_losses(spark, sf_dir).withColumn("d", F.col("q_a") - F.col("q_b")), "d")
    assert np.allclose(seen[0], want, equal_nan=True)


def test_the_gate_checks_all_days_and_kinds(spark, sf_dir, monkeypatch):
    seen = []
    monkeypatch.setattr(leakage, "check", lambda build, d, time, columns, points, kinds=leakage.KINDS: seen.append((d, kinds)))
    series_queries.leakage_gate(spark, sf_dir)
    d, kinds = seen[0]
    assert d.count() == adapters.daily_variance(spark, sf_dir).count() and set(kinds) == set(leakage.KINDS)


def test_the_gate_equals_its_sql(spark, sf_dir):
    query, text = series_queries.QUERIES["leakage_gate"]
    assert sorted(map(tuple, query(spark, sf_dir).collect())) == sorted(duckdb.sql(text).fetchall())


@pytest.mark.parametrize("kind", leakage.KINDS)
def test_each_kind_alone_finds_the_leak(spark, sf_dir, kind):
    d = adapters.daily_variance(spark, sf_dir)
    peeking = lambda x: features.rv_day(x, 1).withColumn("value", F.lead("value", 3).over(by(["symbol"], "day")))
    found = leakage.check(peeking, d, "day", ["rv"], leakage.cuts(d, "day", 2, 7), kinds=(kind,), truncate=False)
    assert found.kind == kind and found.day <= found.cut
