from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.functions import special
from riskloom.operators import garch, var_es
from riskloom.plans import calibration, dependence, laboratories, panels, rules, study_queries


def test_rho_replicates_are_block_resamples(spark):
    s = np.random.default_rng(3).poisson(0.6, 300).astype(float)
    got = np.sort([r.rho for r in dependence.rho_replicates(spark, s, 12, 0.05, 20, 600, 5).collect()])
    again = np.sort([r.rho for r in dependence.rho_replicates(spark, s, 12, 0.05, 20, 600, 5).collect()])
    rng = np.random.default_rng(1)
    plain = []
    for _ in range(600):
        days = np.concatenate([(b + np.arange(20)) % 300 for b in rng.integers(0, 300, 15)])[:300]
        plain.append((s[days].var(ddof=1) / (12 * 0.05 * 0.95) - 1) / 11)
    assert len(got) == 600 and (got == again).all()
    assert abs(got.mean() - np.mean(plain)) < 4 * np.std(plain) / math.sqrt(600) and 0.85 < got.std() / np.std(plain) < 1.18
    with pytest.raises(ValueError, match="block"):
        dependence.rho_replicates(spark, s, 12, 0.05, 301, 10, 1)


def test_dependence_equals_its_parts(spark):
    p = panels.simulate(panels.PanelSettings(n_days=470, n_coins=3, burn=100), 7)["r"]
    days = pd.date_range("2021-01-01", periods=470)
    rows = pd.concat([pd.DataFrame({"symbol": f"c{j}", "day": days.date, "r": p[:, j]}) for j in range(3)])
    returns = spark.createDataFrame(rows, "symbol string, day date, r double")
    out = dependence.hit_dependence(spark, returns, boot=100, limit=10.0).collect()
    hits = np.zeros(70)
    for j in range(3):
        sigma, nu, _ = garch.walk_forward(p[:, j])
        hits += p[400:, j] < sigma * np.array([special.tail_constants(0.05, v)[0] for v in nu])
    vr = hits.var(ddof=1) / (3 * 0.05 * 0.95)
    assert [r.block for r in out] == [20, 10, 40] and all(r.n == 70 and r.k == 3 and r.passes for r in out)
    assert all(abs(r.vr - vr) < 1e-9 and abs(r.rho - (vr - 1) / 2) < 1e-9 and abs(r.upper - r.rho - 2 * r.se) < 1e-12 for r in out)
    assert dependence.hit_dependence(spark, returns.where("symbol = 'c0'"), boot=10).count() == 0


def test_series_tests_equal_the_column_forms(spark):
    rng = np.random.default_rng(5)
    r = rng.standard_t(5, (400, 6))
    r[:, 5] = np.abs(r[:, 5])  # a series without hits
    q, es = np.full(r.shape, -1.9), np.full(r.shape, -2.7)
    null = rng.normal(0, 0.2, 500)
    got = laboratories.series_p_values(r, q, es, 0.05, null)
    rows = [(f"s{j}", i, float(r[i, j]), -1.9, -2.7, bool(r[i, j] < -1.9)) for j in range(6) for i in range(400)]
    d = spark.createDataFrame(rows, "symbol string, day int, r double, q double, es double, hit boolean")
    col = lambda df, c: [x[c] for x in df.orderBy("symbol").collect()]
    assert np.allclose(got["kupiec"], col(var_es.with_p_values(var_es.kupiec(d, 0.05)), "p_value"))
    ind = [np.nan if v is None else v for v in col(var_es.with_p_values(var_es.christoffersen_ind(d)), "p_value")]
    assert np.allclose(got["ind"], ind, equal_nan=True) and np.isnan(got["ind"][5])
    assert np.allclose(got["cc"], col(var_es.christoffersen_cc(d, 0.05), "p_value"))
    z2 = col(var_es.z2(d, 0.05), "z2")
    assert np.allclose(got["z2"], [(1 + (null <= z).sum()) / 501 for z in z2])


def test_lab_forecasts():
    panel = panels.simulate(panels.PanelSettings(n_days=120, n_coins=2, burn=50), 1)
    sigma = laboratories.lab_sigmas(panel)
    assert list(sigma) == list(laboratories.LAB_FORECASTS) and all(s.shape == (60, 2) for s in sigma.values())
    t = 17  # known the day before: from the 10 and 60 returns before the day
    assert np.allclose(sigma["window10"][t], np.sqrt((panel["r"][60 + t - 10 : 60 + t] ** 2).mean(axis=0)))
    assert np.allclose(sigma["window60"][t], np.sqrt((panel["r"][t : 60 + t] ** 2).mean(axis=0)))
    assert np.allclose(sigma["under30"], 0.7 * sigma["true"]) and (sigma["constant"] == 0.04).all()
    (q, es), (qn, en) = special.tail_constants(0.01, 5.0), special.tail_constants(0.01)
    assert laboratories.lab_tail("true", 0.01) == (q, es) and laboratories.lab_tail("normal", 0.01) == (qn, en)
    assert laboratories.lab_tail("es_low", 0.01)[0] == q and laboratories.lab_tail("es_low", 0.01)[1] == pytest.approx(q * en / qn) and q * en / qn > es


def test_series_control_and_criteria(spark):
    study = laboratories.series_control(spark, 3, 1500, 12, 3, 1500).cache()
    rows = laboratories.series_criteria(study)
    assert len(rows) == 19 and len({r.code for r in rows}) == 19
    value = {r.code: r.value for r in rows}
    assert value["size kupiec 0.05"] < 0.2 and value["power z2 es_low 0.01"] > value["size z2 0.01"]


def test_power_laboratory_feeds_the_rule(spark, sf_dir):
    out = study_queries.power_laboratory(spark, sf_dir).collect()
    assert {(r.cell, r.p) for r in out} == {(f"{rho}/{n}", p) for rho in (0.8, 0.4) for n in (250, 500) for p in (0.01, 0.05)}
    value = {(r.cell, r.p, r.code): r.value for r in out}
    assert value["0.8/500", 0.05, "K2"] >= value["0.8/500", 0.05, "K1"]
    assert {r.verdict for r in out} <= {rules.YES, rules.NO, rules.WITHHELD}


def test_comparative_rule_is_fed_by_a_study(spark, sf_dir):
    out = {r.code: r for r in study_queries.comparative_example(spark, sf_dir).collect()}
    assert {"K4", "K5", "K6a", "K6b", "P-a", "P-b", "K7a"} <= set(out)
    assert out["K5"].value >= 0.5


def test_cells(spark):
    found = calibration.Calibration(amplitude=0.5, regime_length=300.0)
    base = panels.PanelSettings(n_days=460, n_coins=2, burn=100)
    found.cells = {"B2": {"status": "ok", "settings": base, "goal": 2.264}, "B1": {"status": "stopped"}}
    cells = laboratories.registered_cells(found, base)
    assert list(cells) == ["A0", "B2"] and cells["A0"]["full"] and cells["B2"]["goal"] == 2.264
    out = laboratories.run_cells(spark, {"A0": cells["A0"]}, 2, 3, boot=49)["A0"]
    assert [x for x, _, _ in out["curve"]] == pytest.approx([0, 0.1, 0.2]) and {c.code for c in out["verdict"].controls} >= {"K1", "K2", "K7c"}
    measure = calibration.pilot_measure(spark, 2, 7)
    control = laboratories.generator_control(measure, base)
    assert control["ok"] == (-0.03 <= control["values"]["rho"][0] <= 0.03)


def test_small_rules():
    tried = [{"alpha": a, "boundary": (b, 0.01), "not_converged": (c, 0.0)} for a, b, c in ((0.05, 0.3, 0), (0.08, 0.5, 0.5), (0.1, 0.5, 0.01), (0.12, 0.6, 0))]
    assert laboratories.choose_alpha(tried) == 0.1 and laboratories.choose_alpha(tried[:2]) is None
    assert laboratories.difference_z((0.3, 0.03), (0.1, 0.04)) == pytest.approx(4)
    assert laboratories.difference_z((0.1, 0), (0.1, 0)) == 0 and laboratories.difference_z((0, 0), (0.1, 0)) == -math.inf
    assert laboratories.wilson_high(0.05, 1000) == pytest.approx(0.0653, abs=2e-4)
