"""Dependence of Value-at-Risk hits between series: measured on returns, with its bootstrap error, and on controls.

The forecasts are walk-forward GARCH-t per symbol, the daily number of hits is one row a day, and its variance over the
binomial one implies the correlation of hits. What is resampled is that daily series alone: a few thousand numbers however
many symbols or rows there are. Replicates are a fan-out of seeded tasks.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.operators import garch, var_es
from riskloom.plans import studies
from riskloom.plans.panels import PanelSettings, seed_of

# Level, block length of the gate and others, limit of the gate, replicates, and the bands of the controls.
P = 0.05
GATE_BLOCK, BLOCKS = 20, (10, 40)
LIMIT = 0.282
REPLICATES = 2000
POSITIVE_BAND, NEGATIVE_LIMIT = (0.242, 0.322), 0.03
CHUNK = 250


def daily_hits(returns: DataFrame, p: float = P, start: int = garch.START, step: int = garch.STEP) -> DataFrame:
    """(day, s, k): hits of the walk-forward forecasts on the days that have the most symbols, all of them where any day does.

    One window over the days, a row each, so that the forecasts are made once.
    """
    sums = var_es.daily_sums(garch.var_es(garch.walk_forward_forecasts(returns, start, step), p), p)
    return sums.withColumn("most", F.max("k").over(W.partitionBy())).where("k = most").select("day", "s", "k")


def implied_rho(s: np.ndarray, k: int, p: float) -> np.ndarray:
    """The hit correlation that the variance of daily hits implies, along the last axis."""
    return (s.var(axis=-1, ddof=1) / (k * p * (1 - p)) - 1) / (k - 1)


def rho_replicates(spark: SparkSession, s: np.ndarray, k: int, p: float, length: int, boot: int, entropy: int) -> DataFrame:
    """(rho): replicates by circular blocks of days."""
    if not 1 <= length <= len(s):
        raise ValueError("a block is 1 day at least and the whole series at most")

    def run(batches):
        for pdf in batches:
            for part in pdf["id"]:
                rng = np.random.default_rng(seed_of(entropy, length, int(part)))
                rows = var_es.block_indices(len(s), length, min(CHUNK, boot - CHUNK * int(part)), rng)
                yield pd.DataFrame({"rho": implied_rho(s[rows], k, p)})

    parts = -(-boot // CHUNK)
    return spark.range(0, parts, 1, parts).mapInPandas(run, "rho double")


def hit_dependence(spark: SparkSession, returns: DataFrame, p: float = P, boot: int = REPLICATES, entropy: int = 1, limit: float = LIMIT, start: int = garch.START) -> DataFrame:
    """(block, k, n, vr, rho, se, upper, passes): one row a block length; the gate is that of GATE_BLOCK.

    ``upper`` is rho and two standard errors; a row passes if it is at most the limit. Without two symbols or three common
    days there are no rows.
    """
    found = daily_hits(returns, p, start).orderBy("day").toPandas()
    schema = "block int, k int, n int, vr double, rho double, se double, upper double, passes boolean"
    if len(found) < 3 or found["k"].iloc[0] < 2:
        return spark.createDataFrame([], schema)
    s, k = found["s"].to_numpy(), int(found["k"].iloc[0])
    rho = float(implied_rho(s, k, p))
    rows = []
    for length in (GATE_BLOCK, *BLOCKS):
        if length > len(s):
            continue
        se = rho_replicates(spark, s, k, p, length, boot, entropy).agg(F.stddev_samp("rho")).first()[0]
        rows.append((length, k, len(s), float(s.var(ddof=1) / (k * p * (1 - p))), rho, se, rho + 2 * se, rho + 2 * se <= limit))
    return spark.createDataFrame(rows, schema)


def dependence_control(spark: SparkSession, base: PanelSettings, rho: float, count: int, entropy: int, start: int = garch.START) -> DataFrame:
    """(rho_made, n, mean, se, inside): the same measure on simulated panels without an error of its own.

    With a made correlation the mean should lie in POSITIVE_BAND, without one below NEGATIVE_LIMIT in size.
    """
    study = studies.pilot(spark, replace(base, rho=rho), count, entropy, start, P).where("stat = 'rho'")
    inside = F.col("mean").between(*POSITIVE_BAND) if rho > 0 else F.abs("mean") < NEGATIVE_LIMIT
    return studies.rates(study).select(F.lit(rho).alias("rho_made"), "n", "mean", "se", inside.alias("inside"))
