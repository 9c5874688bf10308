"""Anytime-valid evidence: normal-mixture e-processes and a normal-normal posterior."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.functions import special
from riskloom.functions.columns import by

DAYS_A_YEAR = 365


@dataclass(frozen=True)
class Leg:
    """A strategy leg with its assumed yearly mean and volatility."""

    name: str
    column: str
    mu: float
    sigma: float

    @property
    def daily_mu(self) -> float:
        return self.mu / DAYS_A_YEAR

    @property
    def daily_sigma(self) -> float:
        return self.sigma / math.sqrt(DAYS_A_YEAR)


# The assumed legs.
LEGS = (
    Leg("TS1", "r_trend", 0.1069, 0.1812),
    Leg("CP1", "r_coinbase", 0.3104, 0.3511),
    Leg("R1", "r_port", 0.1817, 0.2166),
    Leg("X1", "r_x1", 0.0949, 0.3626),
)


def log_e(s: np.ndarray, v: np.ndarray, tau: float, side: int) -> np.ndarray:
    """log of the one-sided normal-mixture e-value of a sum of deviations s with variance v."""
    if side not in (-1, 1) or tau <= 0:
        raise ValueError("side is -1 or 1, and tau positive")
    s, a = np.asarray(s, float), np.asarray(v, float) + tau**-2
    return math.log(2) - math.log(tau) - 0.5 * np.log(a) + s * s / (2 * a) + special.log_normal_cdf(side * s / np.sqrt(a))


def tuned_tau(effect: float, sigma: float) -> float:
    return abs(effect) / sigma**2


def path(returns: DataFrame, x: str, mean: float, sigma: float, tau: float, side: int) -> DataFrame:
    """(symbol, day, t, s, e): running e-value per symbol against ``mean``; null days are skipped."""
    w = by(["symbol"], "day").rowsBetween(W.unboundedPreceding, 0)
    d = returns.where(F.col(x).isNotNull()).select("symbol", "day", F.count(F.lit(1)).over(w).alias("t"), F.sum(F.col(x) - mean).over(w).alias("s"))

    @F.pandas_udf("double")
    def value(s: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(np.exp(log_e(s.to_numpy(float), t.to_numpy(float) * sigma**2, tau, side)))

    return d.withColumn("e", value(F.col("s"), F.col("t")))


def refuting(returns: DataFrame, x: str, leg: Leg, tau: float | None = None) -> DataFrame:
    """Against the assumed mean (alternative: lower)."""
    return path(returns, x, leg.daily_mu, leg.daily_sigma, tau or tuned_tau(leg.daily_mu, leg.daily_sigma), -1)


def confirming(returns: DataFrame, x: str, leg: Leg, tau: float | None = None) -> DataFrame:
    """Against a mean of at most 0."""
    return path(returns, x, 0.0, leg.daily_sigma, tau or tuned_tau(leg.daily_mu, leg.daily_sigma), 1)


def summary(paths: DataFrame) -> DataFrame:
    """(symbol, n, last_e, max_e)."""
    return paths.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.max_by("e", "t").alias("last_e"), F.max("e").alias("max_e"))


def posterior(returns: DataFrame, x: str, sigma: float, prior_mean: float, prior_sd: float) -> DataFrame:
    """(symbol, n, mean, sd, ci_low, ci_high, p_positive) of the yearly mean; without observations the prior."""
    g = returns.groupBy("symbol").agg(F.count(x).alias("n"), F.avg(x).alias("m"))
    precision = F.lit(prior_sd**-2) + F.col("n") / (DAYS_A_YEAR * sigma**2)
    mean = (prior_mean * prior_sd**-2 + F.coalesce(F.col("m") * DAYS_A_YEAR, F.lit(0.0)) * F.col("n") / (DAYS_A_YEAR * sigma**2)) / precision
    sd = F.sqrt(1 / precision)

    @F.pandas_udf("double")
    def above_zero(m: pd.Series, s: pd.Series) -> pd.Series:
        return (m / s).map(special.normal_cdf)

    d = g.select("symbol", "n", mean.alias("mean"), sd.alias("sd"), (mean - 1.959964 * sd).alias("ci_low"), (mean + 1.959964 * sd).alias("ci_high"))
    return d.withColumn("p_positive", above_zero(F.col("mean"), F.col("sd")))
