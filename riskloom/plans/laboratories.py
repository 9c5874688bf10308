"""Laboratories that feed the decision rules: series backtests, pooled backtests by length of sample, comparisons, cells.

A laboratory is a fan-out over simulated panels that gives tidy rows (cell, p, forecast, stat, value); the numbers that a
rule takes are then selections from :func:`riskloom.plans.studies.rates`.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import special
from riskloom.operators.var_es import pooled_tests, rejects
from riskloom.plans import calibration, rules, studies
from riskloom.plans.panels import PanelSettings, per_panel, seed_of
from riskloom.plans.studies import ALPHA, LEVELS, NU, SCHEMA, daily_parts, ewma_sigma, window_sigma

# Warm-up, the constant sigma, the forecasts (source of sigma, multiplier, tail), criteria of the series control.
WARM = 60
CONSTANT_SIGMA = 0.04
LAB_FORECASTS = {
    "true": ("oracle", 1.0, "t"),
    "normal": ("oracle", 1.0, "normal"),
    "constant": ("constant", 1.0, "t"),
    "window10": ("window10", 1.0, "t"),
    "window60": ("window60", 1.0, "t"),
    "ewma94": ("ewma94", 1.0, "t"),
    "under05": ("oracle", 0.95, "t"),
    "under10": ("oracle", 0.90, "t"),
    "under15": ("oracle", 0.85, "t"),
    "under20": ("oracle", 0.80, "t"),
    "under30": ("oracle", 0.70, "t"),
    "es_low": ("oracle", 1.0, "es_low"),
}
UNDER = ("true", "under05", "under10", "under15", "under20", "under30")
SERIES_TESTS = ("kupiec", "ind", "cc", "z2")
SERIES_FORECASTS = ("true", "normal", "constant", "es_low")
UNDEFINED = 0.01
SERIES_POWER = (
    ("normal", "kupiec", LEVELS),
    ("normal", "z2", (0.01,)),
    ("constant", "ind", LEVELS),
    ("es_low", "z2", LEVELS),
    ("normal", "cc", LEVELS),
)
MAIN_PAIR = ("ewma94_t5", "garch_tnu")


# ---------------------------------------------------------------- forecasts


def lab_sigmas(panel: dict[str, np.ndarray], warm: int = WARM) -> dict[str, np.ndarray]:
    """Sigma of each of the LAB_FORECASTS after the warm-up, known the day before: days x coins."""
    r = panel["r"]
    oracle = np.sqrt(panel["sigma2"])
    sources = {"oracle": oracle, "constant": np.full_like(oracle, CONSTANT_SIGMA), "window10": window_sigma(r, 10), "window60": window_sigma(r, 60), "ewma94": ewma_sigma(r)}
    late = {name: s[warm:] for name, s in sources.items()}
    if any(not np.isfinite(s).all() or s.min() <= 0 for s in late.values()):
        raise ValueError("a sigma is not positive after the warm-up")
    return {name: late[source] * multiple for name, (source, multiple, _) in LAB_FORECASTS.items()}


def null_family(name: str) -> float | None:
    """Degrees of freedom of the law that a forecast claims; None is the normal one."""
    return None if LAB_FORECASTS[name][2] == "normal" else NU


def lab_tail(name: str, p: float) -> tuple[float, float]:
    """(q, es) of a forecast at sigma 1; ``es_low`` has the t quantile with the normal ratio of ES to it."""
    q, es = special.tail_constants(p, null_family(name))
    if LAB_FORECASTS[name][2] == "es_low":
        normal_q, normal_es = special.tail_constants(p)
        es = q * normal_es / normal_q
    return q, es


# ---------------------------------------------------------------- backtests of series (days x series at once)


def _entropy_ll(hits: np.ndarray, n: np.ndarray, p) -> np.ndarray:
    """Log-likelihood of hits in n at a hit probability, 0 ln 0 being 0."""
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = [np.where(count > 0, count * np.log(share), 0.0) for count, share in ((hits, p), (n - hits, 1 - p))]
    return parts[0] + parts[1]


def series_p_values(r: np.ndarray, q: np.ndarray, es: np.ndarray, p: float, z2_null: np.ndarray) -> dict[str, np.ndarray]:
    """p-values of Kupiec, independence, conditional coverage and Z2 of every column; an undefined one is nan."""
    hit = r < q
    n, x = len(hit), hit.sum(axis=0)
    sf = np.vectorize(special.chi2_sf, otypes=[float])
    kupiec = 2 * (_entropy_ll(x, n, x / n) - _entropy_ll(x, n, p))
    moves = {(a, b): ((hit[:-1] == a) & (hit[1:] == b)).sum(axis=0) for a in (False, True) for b in (False, True)}
    rows = [moves[a, False] + moves[a, True] for a in (False, True)]
    total = moves[False, True] + moves[True, True]
    with np.errstate(divide="ignore", invalid="ignore"):
        chain = sum(_entropy_ll(moves[a, True], m, moves[a, True] / m) for a, m in zip((False, True), rows))
        chain = np.where((rows[0] == 0) | (rows[1] == 0), np.nan_to_num(chain), chain)
        free, null = _entropy_ll(total, n - 1, total / (n - 1)), _entropy_ll(total, n - 1, p)
    empty = (rows[0] == 0) | (rows[1] == 0) | (total == 0) | (total == n - 1)
    z2 = 1 - np.where(hit, r / es, 0.0).sum(axis=0) / (n * p)
    below = np.searchsorted(np.sort(z2_null), z2, "right")
    return {
        "kupiec": sf(np.maximum(kupiec, 0), 1), "ind": np.where(empty, np.nan, sf(np.maximum(2 * (chain - free), 0), 1)),
        "cc": sf(np.maximum(2 * (chain - null), 0), 2), "z2": (1 + below) / (1 + len(z2_null)), "z2_value": z2,
    }


def z2_nulls(spark: SparkSession, lengths, reps: int, entropy: int) -> dict[tuple[int, float, bool], np.ndarray]:
    """Null samples of Z2 by (days, level, normal family): reps numbers each."""
    out = {}
    for i, n in enumerate(lengths):
        for j, p in enumerate(LEVELS):
            for nu in (None, NU):
                rows = studies.z2_null(spark, n, p, nu, reps, seed_of(entropy, i, j, nu is None) & 0x7FFFFFFF).collect()
                out[n, p, nu is None] = np.sort([r[0] for r in rows])
    return out


def series_control(spark: SparkSession, panels: int, n_days: int, n_series: int, entropy: int, reps: int = 20_000) -> DataFrame:
    """Rejections (stat, 0 or 1) of the four series tests for four forecasts on independent series, with undefined ones."""
    null = z2_nulls(spark, [n_days], reps, entropy)
    settings = PanelSettings(n_days=n_days, n_coins=n_series, rho=0.0, nu=NU)

    def work(panel, number):
        rows = []
        oracle = np.sqrt(panel["sigma2"])
        for p in LEVELS:
            for name in SERIES_FORECASTS:
                sigma = oracle if LAB_FORECASTS[name][0] == "oracle" else np.full_like(oracle, CONSTANT_SIGMA)
                q, es = lab_tail(name, p)
                found = series_p_values(panel["r"], sigma * q, sigma * es, p, null[n_days, p, null_family(name) is None])
                rows += [("series", p, name, test, float(v < ALPHA)) for test in SERIES_TESTS for v in found[test]]
                rows += [("series", p, name, "undefined", float(np.isnan(v))) for v in found["ind"]]
                rows += [("series", p, name, "hit", float(v)) for v in (panel["r"] < sigma * q).mean(axis=0)]
        return studies._tidy(rows)

    return per_panel(spark, settings, panels, entropy, work, SCHEMA)


def series_criteria(study: DataFrame) -> list[rules.Row]:
    """The nineteen criteria: sizes of the true forecast, undefined tables, and powers where a test should see something."""
    rate = {(r.p, r.forecast, r.stat): (r["mean"], r["se"]) for r in studies.rates(study).collect()}
    rows = [rules.Row(f"size {t} {p}", *rate[p, "true", t], *rules.SIZE) for p in LEVELS for t in SERIES_TESTS]
    rows += [rules.Row(f"undefined {p}", *rate[p, "true", "undefined"], high=UNDEFINED) for p in LEVELS]
    return rows + [rules.Row(f"power {t} {name} {p}", *rate[p, name, t], low=rules.POWER) for name, t, levels in SERIES_POWER for p in levels]


# ---------------------------------------------------------------- pooled backtests by sample length


def pooled_cell(r, q, es, p: float, z2_null: np.ndarray, days: np.ndarray) -> dict[str, float]:
    """What one forecast shows on one panel: shares of rejecting series, the pooled tests, and a naive count of all hits."""
    n, k = r.shape
    series = series_p_values(r, q, es, p, z2_null)
    hits, excess = daily_parts(r, q, es, p)
    t = pooled_tests(hits, excess, k, p, days)
    values = {x: t[f"p_{x}"] for x in "abc"}
    all_hits = hits.sum()
    naive = 2 * (_entropy_ll(all_hits, n * k, all_hits / (n * k)) - _entropy_ll(all_hits, n * k, p))
    out = {"hit": all_hits / (n * k), "z2": series["z2_value"].mean(), "vr": hits.var(ddof=1) / (k * p * (1 - p))}
    out |= {f"series_{x}": float((series[x] < ALPHA).mean()) for x in ("kupiec", "cc", "z2")}
    out |= {f"rej_{x}": float(v < ALPHA / 3) for x, v in values.items()}
    return out | {
        "rej": float(rejects(list(values.values()), ALPHA)), "rej_a_right": float(values["a"] < ALPHA / 3 and t["t_a"] > 0),
        "rej_ac": float(rejects([values["a"], values["c"]], ALPHA)), "naive": float(special.chi2_sf(max(float(naive), 0.0), 1) < ALPHA),
        "undefined": float(sum(math.isnan(v) for v in values.values())),
    }


def power_laboratory(spark: SparkSession, base: PanelSettings, rhos, lengths, count: int, entropy: int, boot: int = 999, reps: int = 20_000) -> DataFrame:
    """Tidy rows of every forecast at each level and sample length; ``cell`` is rho/length. Panels have the longest length."""
    nulls = z2_nulls(spark, lengths, reps, entropy)
    longest = max(lengths)

    def at(rho: float) -> DataFrame:
        def work(panel, number):
            sigma = lab_sigmas(panel)
            r = panel["r"][WARM:]
            rng = np.random.default_rng(seed_of(entropy, number, 1))
            rows = []
            for n in lengths:
                days = rng.integers(0, n, size=(boot, n))
                for p in LEVELS:
                    for name, s in sigma.items():
                        q, es = lab_tail(name, p)
                        found = pooled_cell(r[:n], s[:n] * q, s[:n] * es, p, nulls[n, p, null_family(name) is None], days)
                        rows += [(f"{rho}/{n}", p, name, stat, float(v)) for stat, v in found.items()]
            return studies._tidy(rows)

        return per_panel(spark, replace(base, rho=rho, n_days=longest + WARM), count, seed_of(entropy, round(1000 * rho)) & 0x7FFFFFFF, work, SCHEMA)

    parts = [at(rho) for rho in rhos]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def pooled_numbers(rate: dict, cell: str, p: float) -> dict:
    """What :func:`rules.pooled_rule` takes, from rates by (cell, p, forecast, stat)."""
    of = lambda name, stat="rej": rate[cell, p, name, stat]
    return {
        "size": of("true"), "normal": of("normal"), "constant": of("constant"), "control30": of("under30"), "naive": of("true", "naive"),
        "curve": [of(name) for name in UNDER],
    }


def rates_by(study: DataFrame) -> dict[tuple[str, float, str, str], tuple[float, float]]:
    """(mean, standard error) by (cell, p, forecast, stat)."""
    return {(r.cell, r.p, r.forecast, r.stat): (r["mean"], r["se"] or 0.0) for r in studies.rates(study).collect()}


def rule_map(study: DataFrame, main_rho: float = 0.8) -> dict[tuple[str, float], str]:
    """Verdict of the pooled rule in each cell and level; the naive test is a control at the main correlation only."""
    rate = rates_by(study)
    return {(cell, p): rules.pooled_rule(pooled_numbers(rate, cell, p), p, float(cell.split("/")[0]) == main_rho).verdict for cell, p in sorted({(c, p) for c, p, _, _ in rate})}


# ---------------------------------------------------------------- comparisons


def estimator_numbers(rate: dict) -> dict:
    return {k: rate["estimator", 0.0, "garch", k] for k in ("nu", "persistence", "not_converged", "boundary")}


def absolute_numbers(rate: dict, p: float, cell: str = "days") -> dict:
    """What :func:`rules.absolute_rule` takes."""
    of = lambda name: rate[cell, p, name, "rej"]
    return {"k1": of("oracle_t5"), "k2": of("under30"), "ka": of("garch_tnu"), "kb": of("garch_tnu_under10"), "k7": estimator_numbers(rate)}


def absolute_curve(rate: dict, p: float, cell: str = "days") -> list[tuple[float, float]]:
    """Power of the pooled test over the understatements; the first is its size."""
    return [rate[cell, p, name, "rej"] for name in ("oracle_t5", *UNDER[1:])]


def dm_shares(study: DataFrame) -> dict[tuple[float, str, str], tuple[float, float]]:
    """(share, standard error) by (p, comparison, how): how is two_sided, right or centred."""
    out = {}
    for r in studies.dm_rates(study).collect():
        for how in ("two_sided", "right", "centred"):
            out[r.p, r.forecast, how] = (r[how], math.sqrt(max(r[how] * (1 - r[how]), 0.0) / max(r.n - 1, 1)))
    return out


def comparative_curve(share: dict, p: float, loss: str = "fz0") -> list[tuple[float, float]]:
    """Power of the comparison with the oracle over the understatements; the first is the mean size of the pairs of equal
    expected loss."""
    zero = np.mean([share[p, f"zero_{loss}_{c}", "two_sided"] for c in (90, 80)], axis=0)
    return [(float(zero[0]), float(zero[1])), *(share[p, f"{loss}_{name}__oracle_t5", "right"] for name in UNDER[1:])]


def comparative_numbers(share: dict, rate: dict, p: float) -> dict:
    """What :func:`rules.comparative_rule` takes, from comparisons on the joint loss."""
    pairs = [f"{a}__{b}" for a, b in studies.REAL_PAIRS]
    return {
        "k4": {f"{loss} {c}": share[p, f"zero_{loss}_{c}", "two_sided"] for loss in ("fz0", "pinball") for c in (90, 80)},
        "k5": share[p, "fz0_under30__oracle_t5", "right"], "k6": {pair: share[p, f"fz0_{pair}", "centred"] for pair in pairs if (p, f"fz0_{pair}", "centred") in share},
        "k7": estimator_numbers(rate), "curve": comparative_curve(share, p), "pb": share[p, "fz0_" + "__".join(MAIN_PAIR), "right"],
    }


# ---------------------------------------------------------------- calibrated cells

# The mean correlation that the negative control of the generator may show, and what the plain cell must show.
GENERATOR_BAND = (-0.03, 0.03)
PLAIN_CELL = "A0"


def choose_alpha(tried: list[dict], least_boundary: float = calibration.BOUNDARY_WINDOW[0]) -> float | None:
    """The first alpha, in the order tried, whose fits end at a bound often enough and converge."""
    fit = (t["alpha"] for t in tried if t["boundary"][0] >= least_boundary and t["not_converged"][0] <= rules.NOT_CONVERGED)
    return next(fit, None)


def generator_control(measure: calibration.Measure, base: PanelSettings) -> dict:
    """Without a common factor, shock or regimes the implied hit correlation should be about zero."""
    values = measure(replace(base, rho=0.0, shock_rho=0.0, amplitude=0.0), (5, 0))
    return {"values": values, "ok": GENERATOR_BAND[0] <= values["rho"][0] <= GENERATOR_BAND[1]}


def difference_z(a: tuple[float, float], b: tuple[float, float]) -> float:
    """Difference of two independent means in standard errors; without an error 0 if equal, else infinite."""
    gap, error = a[0] - b[0], math.hypot(a[1], b[1])
    return gap / error if error else math.copysign(math.inf, gap) if gap else 0.0


def registered_cells(found: calibration.Calibration, base: PanelSettings) -> dict[str, dict]:
    """Settings and rule of each cell: the plain one always, a calibrated one only if its calibration was met."""
    plain = replace(base, rho=calibration.BASE_RHO, shock_rho=0.0, amplitude=0.0)
    met = {name: c for name, c in found.cells.items() if c["status"] == "ok"}
    cells = {PLAIN_CELL: {"settings": plain, "full": True, "goal": None, "window": None}}
    return cells | {name: {"settings": c["settings"], "full": False, "goal": c["goal"], "window": calibration.BOUNDARY_WINDOW} for name, c in sorted(met.items())}


CELL_FORECASTS = ("oracle_t5", "under30", "garch_tnu", "garch_tnu_under10", "garch_tnu_under20")


def run_cells(spark: SparkSession, cells: dict[str, dict], count: int, entropy: int, p: float = 0.05, boot: int = 999, start: int = studies.START, log: Callable[[str], None] = lambda _: None) -> dict[str, dict]:
    """The study of each cell on seeds of its own, its rates, power curve and verdict."""
    out = {}
    for number, (name, cell) in enumerate(cells.items()):
        study = studies.estimated_study(spark, cell["settings"], count, seed_of(entropy, number) & 0x7FFFFFFF, boot, start, levels=(p,), names=CELL_FORECASTS, pairs=())
        rate = rates_by(study)
        vr = rate["days", p, "garch_tnu", "vr"]
        verdict = rules.cell_rule(absolute_numbers(rate, p), cell["full"], vr, cell["goal"], boundary_window=cell["window"])
        curve = [(1 - m, *rate["days", p, f, "rej"]) for m, f in ((1.0, "garch_tnu"), (0.9, "garch_tnu_under10"), (0.8, "garch_tnu_under20"))]
        out[name] = {"rates": rate, "vr": vr, "curve": curve, "verdict": verdict}
        log(f"{name}: {count} panels, {verdict.verdict}")
    return out


def wilson_high(share: float, n: int, z: float = 1.959964) -> float:
    """Upper end of Wilson's interval of a share."""
    shrink = 1 + z * z / n
    return (share + z * z / (2 * n) + z * math.sqrt(share * (1 - share) / n + (z / (2 * n)) ** 2)) / shrink
