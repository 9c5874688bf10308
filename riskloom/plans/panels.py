"""Simulated return panels, one task row each: seeded by panel number, never by partition."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from riskloom.functions import special

# Fixed values of the generators.
LEVEL_SALT = 21
QUANTILE_CLAMP = 1e-15


@dataclass(frozen=True)
class PanelSettings:
    """One-factor GARCH(1,1) with Student t marginals, optional common volatility shocks and variance regimes."""

    n_days: int = 2100
    n_coins: int = 20
    nu: float = 5.0
    rho: float = 0.8
    alpha: float = 0.08
    persistence: float = 0.98
    shock_rho: float = 0.0
    amplitude: float = 0.0
    regime_length: float = 300.0
    daily_vol: float = 0.04
    intraday: int = 288
    burn: int = 500

    def __post_init__(self):
        if self.nu <= 2 or not 0 <= self.rho <= 1 or not 0 <= self.shock_rho <= 1 or not 0 < self.alpha < self.persistence < 1:
            raise ValueError("nu > 2, correlations in [0, 1] and 0 < alpha < persistence < 1 are needed")
        if self.amplitude < 0 or self.regime_length < 1 or self.n_days < 1:
            raise ValueError("amplitude >= 0, regime length >= 1 and days >= 1 are needed")


def seed_of(entropy: int, *key: int) -> int:
    """A 64-bit seed for a place in a study's tree of seeds."""
    return int(np.random.SeedSequence(entropy, spawn_key=key).generate_state(1, dtype=np.uint64)[0])


def copula_multiplier(w: np.ndarray, nu: float) -> np.ndarray:
    """Scale multiplier (nu - 2) / chi-squared whose quantile follows -w."""
    u = np.clip([special.normal_cdf(-x) for x in w.ravel()], QUANTILE_CLAMP, 1 - QUANTILE_CLAMP)
    grid = np.linspace(-9, 9, 1801)
    known = np.array([math.log(special.gamma_inc_inverse(nu / 2, min(max(special.normal_cdf(x), QUANTILE_CLAMP), 1 - QUANTILE_CLAMP))) for x in grid])
    z = np.array([special.normal_ppf(p) for p in u])
    return ((nu - 2) / (2 * np.exp(np.interp(z, grid, known)))).reshape(w.shape)


def variance_level(n_days: int, amplitude: float, length: float, seed: int) -> np.ndarray:
    """Piecewise constant common variance level with mean 1."""
    if amplitude == 0:
        return np.ones(n_days)
    rng = np.random.default_rng([seed, LEVEL_SALT])
    new = rng.random(n_days) < 1 / length
    new[0] = True
    x = rng.standard_normal(n_days) * amplitude
    return np.exp(x[new][np.cumsum(new) - 1] - amplitude**2 / 2)


def simulate(s: PanelSettings, seed: int) -> dict[str, np.ndarray]:
    """r, sigma2 (known the day before) and rv: days x coins."""
    rng = np.random.default_rng(seed)
    shape = (s.n_days + s.burn, s.n_coins)
    factor, own = rng.standard_normal(shape[0]), rng.standard_normal(shape)
    z = math.sqrt(s.rho) * factor[:, None] + math.sqrt(1 - s.rho) * own
    m = (s.nu - 2) / rng.chisquare(s.nu, size=shape)
    noise = rng.chisquare(s.intraday, size=shape) / s.intraday
    if s.shock_rho > 0:
        common, single = rng.standard_normal(shape[0]), rng.standard_normal(shape)
        m = copula_multiplier(math.sqrt(s.shock_rho) * common[:, None] + math.sqrt(1 - s.shock_rho) * single, s.nu)
    shock2, beta = m * z * z, s.persistence - s.alpha
    sigma2 = np.empty(shape)
    now = np.full(s.n_coins, s.daily_vol**2)
    base = s.daily_vol**2 * (1 - s.persistence)
    for t in range(shape[0]):
        sigma2[t] = now
        now = base + (s.alpha * shock2[t] + beta) * now
    level = variance_level(s.n_days, s.amplitude, s.regime_length, seed)[:, None]
    sigma2, m, z, noise = (a[s.burn :] for a in (sigma2, m, z, noise))
    return {"r": np.sqrt(sigma2 * m * level) * z, "sigma2": sigma2 * level, "rv": sigma2 * m * noise * level}


def panels(spark: SparkSession, s: PanelSettings, count: int, entropy: int, tasks: int | None = None) -> DataFrame:
    """(panel_id, day, coin, r, sigma2, rv) of ``count`` panels, each from the seed of its own number."""

    def run(batches):
        for pdf in batches:
            for panel in pdf["id"]:
                p = simulate(s, seed_of(entropy, int(panel)))
                n, k = p["r"].shape
                yield pd.DataFrame({"panel_id": int(panel), "day": np.repeat(np.arange(n), k), "coin": np.tile(np.arange(k), n)} | {c: a.ravel() for c, a in p.items()})

    ids = spark.range(0, count, 1, tasks or min(count, 4 * spark.sparkContext.defaultParallelism))
    return ids.mapInPandas(run, "panel_id long, day int, coin int, r double, sigma2 double, rv double")


def per_panel(spark: SparkSession, s: PanelSettings, count: int, entropy: int, work, schema: str, tasks: int | None = None) -> DataFrame:
    """Rows that ``work(panel, panel_id)`` gives for each simulated panel, with its number."""

    def run(batches):
        for pdf in batches:
            for panel in pdf["id"]:
                rows = work(simulate(s, seed_of(entropy, int(panel), 0)), int(panel))
                yield rows.assign(panel_id=int(panel))

    ids = spark.range(0, count, 1, tasks or min(count, 4 * spark.sparkContext.defaultParallelism))
    return ids.mapInPandas(run, f"{schema}, panel_id long")


def control_returns(n_days: int, n_coins: int, seed: int, df: float = 3.0, rho: float = 0.5, daily_vol: float = 0.04, garch=(0.08, 0.90)) -> np.ndarray:
    """Simple returns without directional information, clipped at -95 %: days x coins."""
    alpha, beta = garch
    if df <= 2 or alpha < 0 or beta < 0 or alpha + beta >= 1:
        raise ValueError("df > 2 and a stationary GARCH are needed")
    rng = np.random.default_rng(seed)
    unit = math.sqrt((df - 2) / df)
    factor = rng.standard_t(df, n_days) * unit
    z = math.sqrt(rho) * factor[:, None] + math.sqrt(1 - rho) * rng.standard_t(df, (n_days, n_coins)) * unit
    out, var = np.empty_like(z), np.full(n_coins, daily_vol**2)
    for t in range(n_days):
        out[t] = np.sqrt(var) * z[t]
        var = daily_vol**2 * (1 - alpha - beta) + alpha * out[t] ** 2 + beta * var
    return np.clip(out, -0.95, None)


def control_ohlc(returns: np.ndarray, seed: int, start: float = 100.0) -> dict[str, np.ndarray]:
    """open, high, low, close panels around returns."""
    rng = np.random.default_rng(seed + 10_000)
    close = start * np.cumprod(1 + returns, axis=0)
    opened = np.vstack([np.full(returns.shape[1], start), close[:-1]])
    reach = 0.5 * np.abs(returns) + 0.002
    up, down = (np.abs(rng.standard_normal(returns.shape)) * reach for _ in range(2))
    return {"open": opened, "high": np.maximum(opened, close) * (1 + up), "low": np.minimum(opened, close) * np.clip(1 - down, 0.05, None), "close": close}


def candles_with_variance(sigma2: np.ndarray, seed: int, bars: int = 288) -> np.ndarray:
    """Closes (days x bars) whose daily variance is given."""
    rng = np.random.default_rng(seed)
    steps = rng.standard_normal((len(sigma2), bars)) * np.sqrt(np.asarray(sigma2)[:, None] / bars)
    return 100.0 * np.exp(np.cumsum(steps.ravel())).reshape(steps.shape)


def settings_dict(s: PanelSettings) -> dict:
    return asdict(s)
