"""The forecast comparison from bars to verdict, in the order that its protocol demands.

Selection and out-of-sample days come from patterns of missing data alone. They are compared with the registered plan
before any loss is computed; a difference stops the run. The measurability gate sees only centred differences; the test
follows if the gate lets it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import forecasts, losses, universe
from riskloom.plans import power


@dataclass(frozen=True)
class Outcome:
    stage: str
    problems: list[tuple[str, str]]
    gate: dict[str, float] | None = None
    tests: list | None = None
    verdict: dict | None = None


def forecast_frame(days: DataFrame, extra: list[str] | None = None, min_train: int = 365, every: int = 30) -> DataFrame:
    """(symbol, day, rv, a, b): baseline and candidate. Without regressors EWMA against HAR; with them HAR against HAR-X."""
    if extra:
        a = forecasts.har(days, extra, False, min_train, every)
        b = forecasts.har(days, extra, True, min_train, every)
    else:
        a, b = forecasts.ewma_com(days), forecasts.har(days, None, True, min_train, every)
    return days.select("symbol", "day", "rv").join(a.withColumnRenamed("forecast", "a"), ["symbol", "day"]).join(b.withColumnRenamed("forecast", "b"), ["symbol", "day"])


def surrogate(days: DataFrame) -> DataFrame:
    """The days with their values replaced by hashed ones where known: forecasts then exist on the same days, and say nothing."""
    u = lambda salt: F.pmod(F.xxhash64(F.lit(salt), "symbol", "day"), F.lit(1 << 20)) / float(1 << 20)
    fake = {"rv": F.when(F.col("rv") > 0, 0.5 + u(1)), "r": F.when(F.col("r").isNotNull(), u(2) - 0.5)}
    others = [c for c in days.columns if c not in ("symbol", "day", "rv", "r")]
    return days.withColumns(fake | {c: F.when(F.col(c).isNotNull(), u(i + 3)) for i, c in enumerate(others)})


def run(spark: SparkSession, days: DataFrame, registered: DataFrame | None, deltas, extra: list[str] | None = None, s: universe.Settings = universe.Settings(), largest_mde: float = 0.1, z: float = losses.Z, days_only: bool = False) -> Outcome:
    """``days`` has (symbol, day, rv, r, regressors): rv null on days that are not valid."""
    planned = forecast_frame(surrogate(days), extra, s.min_train, s.every)
    found = forecasts.fingerprint(forecasts.oos_days(planned))
    if registered is not None:
        problems = [tuple(r) for r in universe.disagreements(found, registered).collect()]
        if problems:
            return Outcome("registration", problems)
    if days_only:
        return Outcome("days", [], tests=[tuple(r) for r in found.orderBy("symbol").collect()])
    frame = losses.compare_losses(forecast_frame(days, extra, s.min_train, s.every), "a", "b").withColumn("d", F.col("q_a") - F.col("q_b")).persist()
    try:
        if frame.select("symbol").distinct().count() < s.k_min:
            return Outcome("selection", [("*", f"fewer than {s.k_min} symbols")])
        gate = power.measurability_gate(spark, frame, "d", deltas, s.reps, z=z)
        if gate["mde_criterion"] is None or gate["mde_criterion"] > largest_mde:
            return Outcome("gate", [], gate)
        tests = losses.dm_table(frame, "a", "b")
        verdict = losses.verdict(tests.select(F.col("t_qlike").alias("t")), s.share, z).first().asDict()
        return Outcome("test", [], gate, [tuple(r) for r in tests.orderBy("symbol").collect()], verdict)
    finally:
        frame.unpersist()
