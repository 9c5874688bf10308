from __future__ import annotations

from dataclasses import replace

import pytest

from riskloom.plans import calibration
from riskloom.plans.panels import PanelSettings
from riskloom.plans.rules import Stop


def world(boundary=lambda s: 0.04 + 0.5 * s.amplitude, vr=lambda s: 1.0 + s.rho + s.shock_rho, not_converged=0.0):
    calls = []

    def measure(s, key):
        calls.append(key)
        return {"boundary": (min(1.0, boundary(s)), 0.01), "vr": (vr(s), 0.01), "not_converged": (not_converged, 0.0)}

    return measure, calls


def test_a_world_that_can_be_met():
    measure, calls = world()
    out = calibration.calibrate(measure)
    assert out.stop is None and abs(0.04 + 0.5 * out.amplitude - calibration.BOUNDARY_CENTRE) < 0.02 and out.regime_length == 300
    assert {c: v["path"] for c, v in out.cells.items()} == {"B1": "rho_down", "B2": "shock", "B3": "rho_up"}
    assert all(v["status"] == "ok" and abs(1 + v["settings"].rho + v["settings"].shock_rho - v["goal"]) <= 0.14 for v in out.cells.values())
    assert len(set(calls)) == len(calls)  # every probe has seeds of its own


def test_corrections_and_goals_out_of_reach():
    drift = iter(range(1000))
    measure, _ = world(vr=lambda s: 1.0 + s.rho + s.shock_rho + (0.3 if next(drift) == 100 else 0.0))
    out = calibration.calibrate(measure, goals={"far": 9.0, "low": 0.2})
    assert {v["status"] for v in out.cells.values()} == {"out of reach"}


def test_stops():
    with pytest.raises(Stop, match="broken"):
        calibration.calibrate(world(boundary=lambda s: 0.5)[0])
    flat = calibration.calibrate(world(boundary=lambda s: 0.05)[0])
    assert flat.amplitude is None and "no amplitude" in flat.stop and len(flat.steps) == 2
    wild = calibration.calibrate(world(not_converged=0.5)[0])
    assert wild.amplitude is None and "not confirmed" in wild.stop
    second = calibration.calibrate(world(boundary=lambda s: 0.05 if s.regime_length == 300 else 0.04 + 0.5 * s.amplitude)[0])
    assert second.regime_length == 150


def test_pilot_measure_repeats_itself(spark):
    s = PanelSettings(n_days=440, n_coins=2, burn=100)
    measure = calibration.pilot_measure(spark, 2, 7)
    one = measure(s, (1, 0, 0))
    assert one == measure(s, (1, 0, 0)) and one != measure(replace(s, rho=0.1), (1, 0, 1))
    assert {"vr", "boundary", "not_converged", "persistence", "nu", "scale_spread"} <= set(one)
