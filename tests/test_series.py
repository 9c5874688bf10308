from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.functions.columns import chunked, ew_mean
from riskloom.operators import candles, features, forecasts, leakage, losses, quality, trades, universe, var_es

DAY = dt.date(2021, 1, 1)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def bars(spark):
    """Days of 3 bars: moving, constant, none, moving without volume, one bar."""
    rows, price = [], 100.0
    for d, kind in enumerate(["move", "move", "flat", "none", "move", "idle", "one"]):
        for b in range({"none": 0, "one": 1}.get(kind, 3)):
            price *= 1.0 if kind == "flat" else 1.01 + 0.01 * b
            ts = dt.datetime(2021, 1, 1 + d, 0, 5 * b)
            rows.append(("A", ts, ts.date(), price, price, price, price, 0.0 if kind in ("flat", "idle") else 1.0, 1))
    return frame(spark, rows, "symbol string, ts timestamp, day date, open double, high double, low double, close double, volume double, n long")


def test_day_flags(bars):
    got = {r.day.day: r for r in candles.day_flags(bars, 3).collect()}
    assert len(got) == 7 and got[1].rv is None and not got[1].valid
    assert got[2].valid and got[3].dead and not got[3].valid and got[3].rv == 0
    assert got[4].n_bars == 0 and not got[4].dead and got[5].after_gap and got[5].valid
    assert got[6].dead and got[6].valid and got[7].incomplete
    strict = {r.day.day: r.valid for r in candles.day_flags(bars, 3, True).collect()}
    assert not strict[5]


def test_daily_rv_equals_pandas(bars):
    d = bars.toPandas().sort_values("ts")
    change = np.log(d["close"]).diff() ** 2
    want = change.groupby(d["day"]).sum()
    for r in candles.daily_rv(bars).collect():
        if r.day != DAY:
            assert r.rv == pytest.approx(want[r.day], abs=1e-15)


def test_input_contract(spark, bars):
    with pytest.raises(ValueError, match="whole number"):
        candles.checked_bars(bars, 0)
    with pytest.raises(ValueError, match="lack"):
        candles.checked_bars(bars.drop("volume"))
    assert candles.checked_bars(bars).count() == bars.count()
    with pytest.raises(Exception, match="not positive"):
        candles.checked_bars(bars.withColumn("close", -F.col("close"))).count()
    with pytest.raises(Exception, match="repeated"):
        candles.unique_times(bars.union(bars)).collect()


def test_gaps_and_jumps_are_reported_not_repaired(bars):
    gap = quality.gaps(bars, 300).collect()
    assert len(gap) == 5 and max(r.gap_seconds for r in gap) == 2 * 86400 - 600
    r = quality.report(bars.union(bars.limit(1)), 300).first()
    assert r.duplicates == 1 and r.n_rows == bars.count() + 1


def test_manifest(spark):
    rows = [({"A/5m": {"rows": 5, "gaps": 1, "missing": 7}, "B/5m": {"rows": 3}, "A/1d": {"rows": 0}},)]
    table = quality.manifest_table(frame(spark, rows, "quality map<string, map<string, bigint>>"))
    got = {(r.symbol, r.timeframe): r for r in table.collect()}
    assert got["B", "5m"].gaps == 0 and got["A", "5m"].missing == 7
    s = {r.timeframe: r for r in quality.manifest_summary(table).collect()}
    assert (s["5m"].pairs, s["5m"].pairs_with_gaps, s["5m"].missing) == (2, 1, 7)
    assert quality.most_missing(table, 1).first().symbol == "A"
    wanted = frame(spark, [("A",), ("C",)], "symbol string")
    assert {(r.symbol, r.timeframe) for r in quality.completeness(table, wanted, ["5m", "1d"]).collect()} == {("A", "1d"), ("C", "5m"), ("C", "1d")}


def series(n=500, seed=0, gaps=True):
    rng = np.random.default_rng(seed)
    days = [DAY + dt.timedelta(days=i) for i in range(n) if not gaps or i % 17 != 5]
    rv = np.exp(rng.normal(-7, 0.5, len(days)))
    r = rng.normal(0, np.sqrt(rv))
    return pd.DataFrame({"symbol": "A", "day": days, "rv": rv, "r": r, "n_bars": 288})


@pytest.mark.parametrize(("com", "least", "n"), [(60.0, 30, 900), (2.0, 5, 2500)])
def test_ewma_equals_pandas_over_many_blocks(spark, com, least, n):
    d = series(n, gaps=False)
    d.loc[d.index % 11 == 3, "r"] = np.nan
    want = (d["r"] ** 2).ewm(com=com, min_periods=least).mean().shift(1).to_numpy()
    rows = [(a, b, None if math.isnan(c) else float(c)) for a, b, c in zip(d["symbol"], d["day"], d["r"])]
    got = [r.forecast for r in forecasts.ewma_com(frame(spark, rows, "symbol string, day date, r double"), com, least).orderBy("day").collect()]
    assert np.allclose([np.nan if v is None else v for v in got], want, rtol=1e-12, equal_nan=True)


def test_ew_mean_of_sparse_positions(spark):
    rows = [("A", i, float(i % 7)) for i in range(0, 4000, 3)]
    got = ew_mean(frame(spark, rows, "k string, at long, x double"), ["k"], "at", "x", 0.9, 1, "m").orderBy("at").collect()
    num = den = 0.0
    last = 0
    for r, (_, at, x) in zip(got, rows):
        num, den = num * 0.9 ** (at - last) + x, den * 0.9 ** (at - last) + 1
        last = at
        assert r.m == pytest.approx(num / den, rel=1e-12)


def test_lambda_recursion(spark):
    d = series(200, 3, gaps=False)
    x, want = (d["r"] ** 2).to_numpy(), [None] * 30
    v = x[:30].mean()
    want.append(v)
    for t in range(31, len(x)):
        v = 0.94 * v + 0.06 * x[t - 1]
        want.append(v)
    got = [r.forecast for r in forecasts.ewma_lambda(spark.createDataFrame(d)).orderBy("day").collect()]
    assert got[:30] == want[:30] and np.allclose(got[30:], want[30:], rtol=1e-12)
    assert {r.forecast for r in forecasts.ewma_lambda(spark.createDataFrame(d.head(30))).collect()} == {None}


def slow_har(rv, extra=None, use=True, min_train=365, every=30):
    """Refits by least squares on every refit row."""
    lv = pd.Series(np.log(rv))
    x = np.column_stack([np.ones(len(lv)), lv, lv.rolling(7).mean(), lv.rolling(30).mean()])
    full = x if extra is None else np.column_stack([x, extra])
    used = full if use else x
    y = lv.shift(-1).to_numpy()
    ok = np.isfinite(full).all(axis=1) & np.isfinite(y)
    out = np.full(len(lv), np.nan)
    start = np.flatnonzero(ok)[0] + min_train
    for t in range(start, len(lv) - 1):
        if (t - start) % every == 0:
            rows = np.flatnonzero(ok[:t])
            b = np.linalg.lstsq(used[rows], y[rows], rcond=None)[0]
            s2 = (y[rows] - used[rows] @ b).var(ddof=used.shape[1])
        if np.isfinite(full[t]).all():
            out[t + 1] = math.exp(used[t] @ b + s2 / 2)
    return out


@pytest.mark.parametrize("use", [None, True, False])
def test_har_equals_repeated_least_squares(spark, use):
    d = series(620, 5, gaps=False)
    rv = d["rv"].to_numpy().copy()
    rv[[50, 300, 301, 500]] = np.nan
    extra = None if use is None else np.random.default_rng(1).normal(size=(len(d), 2))
    want = slow_har(rv, extra, bool(use) or use is None)
    rows = d.assign(rv=rv)[["symbol", "day", "rv"]]
    if extra is not None:
        rows = rows.assign(e1=extra[:, 0], e2=extra[:, 1])
    f = forecasts.har(spark.createDataFrame(rows.astype(object).where(rows.notna(), None), ", ".join(["symbol string", "day date", "rv double", *(["e1 double", "e2 double"] if extra is not None else [])])), None if extra is None else ["e1", "e2"], use is not False)
    got = np.array([np.nan if r.forecast is None else r.forecast for r in f.orderBy("day").collect()])
    assert np.isfinite(want).sum() > 150 and np.allclose(got, want, rtol=1e-8, equal_nan=True)


@pytest.mark.parametrize("name", ["rv_day", "rv_week", "atr14", "ema20_distance", "rsi14"])
def test_features_pass_the_look_ahead_gate(spark, name):
    d = series(45, 2)
    d = d.assign(close=100 * np.exp(d["r"].cumsum()))
    d = d.assign(high=d["close"] * 1.02, low=d["close"] * 0.98)
    days = spark.createDataFrame(d)
    entry = features.REGISTRY[name]
    columns = [c for c in entry.columns if c != "n_bars"]
    assert leakage.check(entry.build, days, "day", columns, leakage.cuts(days, "day", 2, 1)) is None


def test_the_gate_catches_a_leak_and_refuses_empty_tests(spark):
    days = spark.createDataFrame(series(40, 2))
    leak = lambda x: features.rv_day(x).withColumn("value", F.lead("value").over(forecasts.by(["symbol"], "day")))
    found = leakage.check(leak, days, "day", ["rv"], leakage.cuts(days, "day", 1, 1), kinds=("random",))
    assert found is not None and found.kind == "random"
    with pytest.raises(ValueError):
        leakage.check(features.rv_day, days, "day", ["rv"], [])


def test_point_mass_limit(spark):
    rows = [("A", 1.0)] * 3 + [("A", float(i)) for i in range(2, 9)]
    d = frame(spark, rows, "symbol string, value double")
    assert features.point_mass(d).first().share == pytest.approx(0.3)
    with pytest.raises(Exception, match="point mass"):
        features.check_point_mass(d).collect()
    assert features.check_point_mass(d, 0.5).count() == 1


def test_chunked_windows_equal_whole_ones(spark):
    rng = np.random.default_rng(6)
    rows = [("A", DAY + dt.timedelta(days=int(rng.integers(0, 9))), i, float(x)) for i, x in enumerate(rng.normal(size=900))]
    d = frame(spark, rows, "k string, day date, i long, x double")
    parts = chunked(d, ["k"], ["day", "i"], 50, 200)
    assert parts.where("_own").count() == 900 and parts.count() == 900 + 4 * 50
    got = trades.effective_size(d, ["k"], ["day", "i"], "x").first()
    s = pd.DataFrame(rows, columns=["k", "day", "i", "x"]).sort_values(["day", "i"])["x"].reset_index(drop=True)
    den = 1 + 2 * sum(s.autocorr(k) for k in range(1, 51))
    assert got.n_eff == pytest.approx(900 / den if den > 0 else 900, rel=1e-9)


def test_hac_and_verdict_edges(spark):
    rows = [("A", DAY + dt.timedelta(days=i), float(i % 3)) for i in range(200)]
    with pytest.raises(Exception, match="max_lag"):
        losses.hac(frame(spark, rows, "symbol string, day date, x double"), ["symbol"], "day", "x", 2).collect()
    t = frame(spark, [(1.959964,), (2.0,), (3.0,), (4.0,), (5.0,)], "t double")
    v = losses.verdict(t).first()
    assert (v.k, v.need, v.good, v.bad, v.ok) == (5, 4, 4, 0, True)


@pytest.mark.parametrize("hits", [[0] * 10, [1] * 10, [0, 1] * 20, [0] * 30 + [1] * 5, [1]])
def test_backtests_equal_slow_formulas(spark, hits):
    p, n, x = 0.1, len(hits), sum(hits)
    ll = lambda k, m, q: (k * math.log(q) if k else 0.0) + ((m - k) * math.log(1 - q) if m - k else 0.0)
    d = frame(spark, [("A", DAY + dt.timedelta(days=i), bool(h)) for i, h in enumerate(hits)], "symbol string, day date, hit boolean")
    assert var_es.kupiec(d, p).first().lr == pytest.approx(2 * (ll(x, n, x / n) - ll(x, n, p)), abs=1e-9)
    moves = {(a, b): sum(1 for u, v in zip(hits, hits[1:]) if (u, v) == (a, b)) for a in (0, 1) for b in (0, 1)}
    cc, ind = var_es.christoffersen_cc(d, p).first(), var_es.christoffersen_ind(d).first()
    if n < 2:
        assert cc.undefined and cc.lr is None
        return
    chain = sum(ll(moves[a, 1], moves[a, 0] + moves[a, 1], moves[a, 1] / max(1, moves[a, 0] + moves[a, 1])) for a in (0, 1))
    assert cc.lr == pytest.approx(2 * (chain - ll(sum(hits[1:]), n - 1, p)), abs=1e-9)
    assert ind.undefined == (0 in (moves[0, 0] + moves[0, 1], moves[1, 0] + moves[1, 1], moves[0, 0] + moves[1, 0], moves[0, 1] + moves[1, 1]))
    assert (ind.lr is None) == ind.undefined


def test_selection_and_registration(spark):
    members = frame(spark, [(dt.date(2021, m, 1), s) for m in range(1, 7) for s in ("B", "A") + (("C",) if m < 4 else ())], "month date, symbol string")
    assert [r.symbol for r in universe.top_by_months(members, 3).collect()] == ["A", "B", "C"]
    found = frame(spark, [("A", 3, "x"), ("B", 4, "y")], "symbol string, n_days long, fingerprint string")
    assert universe.disagreements(found, found).count() == 0
    other = frame(spark, [("A", 3, "z"), ("C", 4, "y")], "symbol string, n_days long, fingerprint string")
    assert {tuple(r) for r in universe.disagreements(found, other).collect()} == {("A", "fingerprint"), ("B", "not registered"), ("C", "missing")}


def test_null_distributions_of_z2_agree(spark):
    from riskloom.functions import special
    from riskloom.plans import studies

    sigma = np.exp(np.random.default_rng(0).normal(-4, 0.3, 300))
    q, es = special.tail_constants(0.05)
    general = studies.z2_null_of(spark, sigma * q, sigma * es, 0.05, lambda rng, n: rng.standard_normal((n, 300)) * sigma, 600, 1)
    special_case = studies.z2_null(spark, 300, 0.05, None, 600, 1)
    assert np.allclose(sorted(r.z2 for r in general.collect()), sorted(r.z2 for r in special_case.collect()))
    with pytest.raises(ValueError):
        studies.z2_null_of(spark, [-1.0], [-0.5], 0.05, None, 1, 1)
