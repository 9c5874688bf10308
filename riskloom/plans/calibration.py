"""Staged calibration of the simulated world: a variance amplitude, three paths of the hit variance ratio, and cells.

Every probe is a fan-out of fresh panels (:func:`riskloom.plans.studies.pilot`); its seeds follow from the stage and the
probe, so a repeated calibration gives the same numbers. The search itself is a short driver loop over probes. It stops,
rather than repairs, where a stage can't be met.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from riskloom.plans import studies
from riskloom.plans.panels import PanelSettings, seed_of
from riskloom.plans.rules import NOT_CONVERGED, Stop, choose_amplitude, inverse, secant

# Fixed values of the registered calibration.
REGIME_LENGTHS = (300.0, 150.0)
AMPLITUDES = (0.0, 0.25, 0.5, 0.75, 1.0, 1.25, 1.5)
BOUNDARY_WINDOW = (0.413, 0.613)
BOUNDARY_CENTRE = 0.513
BOUNDARY_AT_ZERO = 0.10
BASE_RHO, FIRST_SHOCK = 0.8, 0.5
GOALS = {"B1": 1.717, "B2": 2.264, "B3": 2.811}
VR_TOLERANCE = 0.14
ROUNDS = 3
PATHS = {
    "shock": ("shock_rho", (0.0, 0.25, 0.5, 0.75, 1.0), {"rho": BASE_RHO}),
    "rho_up": ("rho", (0.80, 0.85, 0.90, 0.95), {"shock_rho": 1.0}),
    "rho_down": ("rho", (0.20, 0.35, 0.50, 0.65, 0.80), {"shock_rho": 0.0}),
}

Values = dict[str, tuple[float, float]]
Measure = Callable[[PanelSettings, tuple[int, ...]], Values]


@dataclass
class Calibration:
    amplitude: float | None = None
    regime_length: float | None = None
    stop: str | None = None
    steps: dict = field(default_factory=dict)
    paths: dict = field(default_factory=dict)
    cells: dict = field(default_factory=dict)


def pilot_measure(spark: SparkSession, count: int, entropy: int, start: int = studies.START) -> Measure:
    """(mean, standard error) of each pilot statistic over ``count`` fresh panels; an undefined one stops."""

    def measure(s: PanelSettings, key: tuple[int, ...]) -> Values:
        rows = studies.pilot(spark, s, count, seed_of(entropy, *key) & 0x7FFFFFFF, start)
        if rows.where(F.isnan("value") | F.col("value").isNull()).count():
            raise Stop(f"undefined statistics at {s}")
        return {r.stat: (r["mean"], r["se"]) for r in studies.rates(rows).collect()}

    return measure


def find_amplitude(measure: Measure, base: PanelSettings, number: int, out: Calibration) -> bool:
    """Amplitude for one regime length; False if the next length should be tried."""
    length = REGIME_LENGTHS[number]
    at = lambda a: replace(base, rho=BASE_RHO, shock_rho=FIRST_SHOCK, amplitude=a, regime_length=length)
    probes = [measure(at(a), (1, number, j)) for j, a in enumerate(AMPLITUDES)]
    out.steps[length] = list(zip(AMPLITUDES, probes))
    shares = [v["boundary"] for v in probes]
    if number == 0 and shares[0][0] > BOUNDARY_AT_ZERO:
        raise Stop("fits end at a bound without variance regimes: the generator or the measure is broken")
    now = choose_amplitude(AMPLITUDES, [m for m, _ in shares], [se for _, se in shares], BOUNDARY_WINDOW, BOUNDARY_CENTRE)
    if now is None:
        return False
    for attempt in range(ROUNDS):
        v = measure(at(now), (2, number, attempt))
        out.steps.setdefault(f"confirm {length}", []).append((now, v))
        inside = BOUNDARY_WINDOW[0] <= v["boundary"][0] <= BOUNDARY_WINDOW[1]
        if inside and v["not_converged"][0] <= NOT_CONVERGED:
            out.amplitude, out.regime_length = now, length
            return True
        new = None if inside else secant(now, v["boundary"][0], AMPLITUDES, [m for m, _ in shares], BOUNDARY_CENTRE)
        if new is None:
            break
        now = round(new, 3)
    out.stop = "the amplitude was not confirmed"
    return True


def choose_path(goal: float, paths: dict[str, list[tuple[float, Values]]]) -> str:
    """Below the shock path's start correlation falls, on it shocks rise, beyond its top correlation rises."""
    shock = [v["vr"][0] for _, v in paths["shock"]]
    return "rho_down" if goal < shock[0] else "shock" if goal <= max(shock) else "rho_up"


def confirm_cell(measure: Measure, settings, number: int, goal: float, start: float, probes: list[tuple[float, Values]]) -> dict:
    """Fresh panels at the interpolated place, with corrections while the variance ratio is off."""
    x, v = [p for p, _ in probes], [w["vr"][0] for _, w in probes]
    now, tried = round(start, 3), []
    for attempt in range(ROUNDS):
        w = measure(settings(now), (4, number, attempt))
        tried.append((now, w))
        met = abs(w["vr"][0] - goal) <= VR_TOLERANCE
        if met and w["not_converged"][0] <= NOT_CONVERGED:
            return {"status": "ok", "x": now, "tried": tried}
        new = None if met else secant(now, w["vr"][0], x, v, goal)
        if new is None:
            break
        now = round(new, 3)
    return {"status": "stopped", "x": tried[-1][0], "tried": tried}


def calibrate(measure: Measure, base: PanelSettings = PanelSettings(n_coins=4, n_days=2091), goals: dict[str, float] | None = None) -> Calibration:
    """The whole calibration; ``stop`` says where it ended early, cells that were not met have another status than ok."""
    out = Calibration()
    for number in range(len(REGIME_LENGTHS)):
        if find_amplitude(measure, base, number, out):
            break
    if out.amplitude is None:
        out.stop = out.stop or "no amplitude brings enough fits to a bound"
        return out
    level = replace(base, amplitude=out.amplitude, regime_length=out.regime_length)
    place = lambda path: lambda x: replace(level, **(PATHS[path][2] | {PATHS[path][0]: x}))
    for i, (path, (_, grid, _)) in enumerate(PATHS.items()):
        out.paths[path] = [(x, measure(place(path)(x), (3, i, j))) for j, x in enumerate(grid)]
    for number, (cell, goal) in enumerate((goals or GOALS).items()):
        path = choose_path(goal, out.paths)
        probes = out.paths[path]
        start = inverse([x for x, _ in probes], [v["vr"][0] for _, v in probes], goal, VR_TOLERANCE, VR_TOLERANCE)
        if start is None:
            out.cells[cell] = {"status": "out of reach", "path": path, "goal": goal}
        else:
            out.cells[cell] = {"path": path, "goal": goal, "settings": None} | confirm_cell(measure, place(path), number, goal, start, probes)
            out.cells[cell]["settings"] = place(path)(out.cells[cell]["x"])
    return out
