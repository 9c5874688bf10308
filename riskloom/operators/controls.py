"""Negative-control rules on return panels, and moments of panels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.functions.columns import by, full_sum, positive, trailing


def _growth(panel: DataFrame, lookback: int, peek: bool) -> DataFrame:
    """Adds the summed log growth of ``lookback`` rows; with ``peek`` that of the following rows (a deliberate error)."""
    d = panel.withColumn("g", F.log1p("r"))
    own = full_sum(F.col("g"), trailing(["symbol"], "day", lookback), lookback)
    d = d.withColumn("growth", own)
    return d.withColumn("growth", F.lead("growth", lookback).over(by(["symbol"], "day"))) if peek else d


def trend_rule(panel: DataFrame, n_symbols: int, lookback: int = 7, peek: bool = False) -> DataFrame:
    """(day, pnl): the sign of the growth up to the day before, equal weights; a missing symbol leaves the day out."""
    d = _growth(panel, lookback, peek).withColumn("position", F.lag(F.signum("growth")).over(by(["symbol"], "day")))
    g = d.groupBy("day").agg(F.count(F.col("position") * F.col("r")).alias("n"), F.sum(F.col("position") * F.col("r")).alias("s"))
    return g.where(F.col("n") == n_symbols).select("day", (F.col("s") / n_symbols).alias("pnl"))


def cross_section_rule(panel: DataFrame, n_symbols: int, lookback: int = 7, leg: int = 5, peek: bool = False) -> DataFrame:
    """(day, pnl): long the ``leg`` highest, short the lowest by growth up to the day before; ties by symbol order."""
    d = _growth(panel, lookback, peek)
    rank = F.row_number().over(W.partitionBy("day", F.col("growth").isNull()).orderBy("growth", "symbol"))
    have = F.count("growth").over(W.partitionBy("day"))
    d = d.withColumns({"rank": F.when(F.col("growth").isNotNull(), rank), "have": have})
    high = F.when(F.col("rank") > n_symbols - leg, 0.5 / leg).otherwise(0.0)
    low = F.when(F.col("rank") <= leg, 0.5 / leg).otherwise(0.0)
    d = d.withColumn("weight", F.when(F.col("growth").isNotNull(), high - low))
    d = d.withColumn("held", F.lag("weight").over(by(["symbol"], "day")))
    g = d.groupBy("day").agg(F.count(F.col("held") * F.col("r")).alias("n"), F.sum(F.col("held") * F.col("r")).alias("pnl"))
    return g.where(F.col("n") >= n_symbols).select("day", "pnl")


def autocorrelation(series: DataFrame, keys: list[str], order: str, x: str, lag: int = 1) -> DataFrame:
    """(keys, acf): full-mean estimator."""
    d = series.where(F.col(x).isNotNull()).select(*keys, order, F.col(x).alias("x"))
    e = d.join(d.groupBy(*keys).agg(F.avg("x").alias("m")), keys).withColumn("e", F.col("x") - F.col("m"))
    e = e.withColumn("p", F.col("e") * F.lag("e", lag).over(by(keys, order)))
    return e.groupBy(*keys).agg((F.sum("p") / positive(F.sum(F.col("e") * F.col("e")))).alias("acf"))


def moments(panel: DataFrame) -> DataFrame:
    """(symbol, vol, excess_kurtosis, acf_r2): population moments of returns and of their squares."""
    base = panel.groupBy("symbol").agg(F.stddev_pop("r").alias("vol"), F.kurtosis("r").alias("excess_kurtosis"), F.avg("r").alias("m"))
    sq = panel.join(base.select("symbol", "m"), "symbol").withColumn("c2", F.pow(F.col("r") - F.col("m"), 2))
    acf = autocorrelation(sq, ["symbol"], "day", "c2").withColumnRenamed("acf", "acf_r2")
    return base.drop("m").join(acf, "symbol")


def monthly_members(panel: DataFrame) -> DataFrame:
    """(month, symbol): every symbol in every month of a panel."""
    return panel.select(F.to_date(F.date_trunc("month", "day")).alias("month"), "symbol").distinct()
