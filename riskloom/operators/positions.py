"""Position size, liquidation distance and the liquidation study."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import special
from riskloom.functions.columns import by, positive

DAYS_A_YEAR = 365
LONG, SHORT = "long", "short"


def target_leverage(sigma: Column, yearly: float, cap: float, days: int = DAYS_A_YEAR) -> Column:
    """Leverage whose yearly volatility is the target, at most the cap."""
    if yearly <= 0 or cap <= 0:
        raise ValueError("target and cap must be positive")
    return F.least(yearly / (positive(sigma) * math.sqrt(days)), F.lit(float(cap)))


def final_leverage(sigma: Column, yearly: float, cap: float, es: Column | None = None, es_limit: float | None = None) -> Column:
    """Also at most es_limit / ES; both or neither."""
    if (es is None) != (es_limit is None):
        raise ValueError("es and es_limit come together")
    base = target_leverage(sigma, yearly, cap)
    return base if es is None else F.least(base, es_limit / positive(es))


def margin(leverage: Column, mmr: float) -> Column:
    """1 / leverage - mmr; a deposit that doesn't cover the maintenance margin fails the evaluation."""
    if not 0 <= mmr < 1:
        raise ValueError("mmr lies in [0, 1)")
    m = 1.0 / positive(leverage) - mmr
    return F.when((m > 0) | m.isNull(), m).otherwise(F.raise_error(F.lit("the deposit does not cover the maintenance margin")).cast("double"))


def liquidation_move(leverage: Column, mmr: float, side: str) -> Column:
    """Log move from entry to liquidation; minus infinity for a long position that only price 0 ends."""
    m = margin(leverage, mmr)
    if side == LONG:
        return F.when(m >= 1, F.lit(-math.inf)).otherwise(F.log1p(-m))
    if side == SHORT:
        return F.log1p(m)
    raise ValueError("side is long or short")


def distance(leverage: Column, mmr: float, sigma: Column, side: str, days: int = 1) -> Column:
    """|move| in units of sigma times root days."""
    if days < 1:
        raise ValueError("at least one day")
    return F.abs(liquidation_move(leverage, mmr, side)) / (positive(sigma) * math.sqrt(days))


def _t_tails(z: pd.Series, nu: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) else 0.0 if math.isinf(a) else special.t_sf(a * math.sqrt(b / (b - 2)), b) for a, b in zip(z, nu)], dtype=float)


def end_probability(z: Column, nu: Column) -> Column:
    """Student t tail beyond z standard deviations, at the end of the period."""
    return F.pandas_udf(_t_tails, "double")(z, nu)


def touch_probability(z: Column, nu: Column) -> Column:
    """Twice the tail, at most 1: an upper approximation of touching the level on the way."""
    return F.least(F.lit(1.0), 2 * end_probability(z, nu))


def loss_quantities(sigma: Column, nu: Column, p: float) -> Column:
    """struct(var, es): positive Value-at-Risk and Expected Shortfall of a Student t return."""

    def both(sigma: pd.Series, nu: pd.Series) -> pd.DataFrame:
        known: dict[float, tuple[float, float]] = {}
        pairs = [known.setdefault(v, special.tail_constants(p, v)) for v in nu]
        return pd.DataFrame({"var": [-s * q for s, (q, _) in zip(sigma, pairs)], "es": [-s * e for s, (_, e) in zip(sigma, pairs)]})

    return F.pandas_udf(both, "var double, es double")(sigma, nu)


def scale_to_limit(weights: DataFrame, limit: float) -> DataFrame:
    """(symbol, weight, scale): weights scaled so that sum |w| ES is at most the limit, never up; (symbol, weight, es) rows."""
    risk = weights.agg(F.sum(F.abs("weight") * F.col("es")).alias("x")).scalar()
    scale = F.when(risk <= limit, 1.0).otherwise(limit / risk)
    return weights.select("symbol", (F.col("weight") * scale).alias("weight"), scale.alias("scale"))


# Multipliers of the forecast sigma in the risk table.
SIGMA_MULTIPLES = (1.0, 1.25, 1.5)


def risk_table(fits: DataFrame, targets=(0.18, 0.35), cap: float = 3.0, mmr: float = 0.005) -> DataFrame:
    """One row per symbol and sigma multiple: leverage, distances and touch probabilities; ``fits`` has (symbol, sigma, nu)."""
    rows = fits.withColumn("multiple", F.explode(F.array(*[F.lit(m) for m in SIGMA_MULTIPLES]))).withColumn("s", F.col("sigma") * F.col("multiple"))
    for i, target in enumerate(targets):
        lev = target_leverage(F.col("s"), target, cap)
        rows = rows.withColumns({f"leverage_{i}": lev})
        for side in (LONG, SHORT):
            d = distance(F.col(f"leverage_{i}"), mmr, F.col("s"), side)
            rows = rows.withColumn(f"distance_{side}_{i}", d).withColumn(f"p_{side}_{i}", touch_probability(F.col(f"distance_{side}_{i}"), F.col("nu")))
    return rows.drop("s")


# ---------------------------------------------------------------- liquidation events


def touches(days: DataFrame, leverage: float, mmr: float, side: str, horizon: int) -> DataFrame:
    """(symbol, day, at, touched) of each entry with a full horizon: does a later low (long) or high (short) reach the level?"""
    m = 1 / leverage - mmr
    if m <= 0 or horizon < 1:
        raise ValueError("the deposit must cover the maintenance margin and the horizon be positive")
    w = by(["symbol"], "day")
    ahead = w.rowsBetween(1, horizon)
    full = F.count("close").over(ahead) == horizon
    if side == LONG:
        hit = F.min("low").over(ahead) <= F.col("close") * (1 - m)
    elif side == SHORT:
        hit = F.max("high").over(ahead) >= F.col("close") * (1 + m)
    else:
        raise ValueError("side is long or short")
    d = days.select("symbol", "day", (F.row_number().over(w) - 1).alias("at"), full.alias("full"), hit.alias("touched"))
    return d.where("full").drop("full")


def clusters(entries: DataFrame, gap: int = 7) -> DataFrame:
    """(symbol, n_clusters): entry days at most ``gap`` apart are one cluster, chained."""
    d = entries.select("symbol", "day").distinct().withColumn("before", F.lag("day").over(by(["symbol"], "day")))
    return d.groupBy("symbol").agg(F.count_if(F.col("before").isNull() | (F.date_diff("day", "before") > gap)).alias("n_clusters"))


def poisson_power(expected: float, ratio: float, alpha: float = 0.05) -> float:
    """Power of the one-sided Poisson test against ``ratio`` times the expectation."""
    return special.poisson_sf(special.poisson_critical(expected, alpha), ratio * expected)


def required_expectation(ratio: float, power: float = 0.8) -> float:
    """Smallest expectation on a grid of 0.5 that reaches the power, and keeps it beyond no further check."""
    e = 0.5
    while poisson_power(e, ratio) < power:
        e += 0.5
    return e
