"""Point-in-time features: row d holds what is known at the end of UTC day d. Each is DataFrame -> (symbol, day, value).

The registry lists them with what the look-ahead gate needs to know. Windows are full or null; days that are missing or
not valid are null on the full calendar and age like any other.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from riskloom.functions.columns import by, ew_mean, full_mean, positive, require, trailing
from riskloom.operators.candles import MIN_BARS, on_calendar


def _value(df: DataFrame, value: Column) -> DataFrame:
    return df.select("symbol", "day", value.alias("value"))


def _log_rv(days: DataFrame, min_bars: int) -> DataFrame:
    """``days`` has (symbol, day, rv, n_bars)."""
    d = on_calendar(days.select("symbol", "day", "rv", "n_bars"))
    return d.select("symbol", "day", F.ln(positive(F.when(F.col("n_bars") >= min_bars, F.col("rv")))).alias("x"))


def rv_day(days: DataFrame, min_bars: int = MIN_BARS) -> DataFrame:
    return _value(_log_rv(days, min_bars), F.col("x"))


def rv_mean(days: DataFrame, n: int, min_bars: int = MIN_BARS) -> DataFrame:
    return _value(_log_rv(days, min_bars), full_mean(F.col("x"), trailing(["symbol"], "day", n), n))


def rv_week(days: DataFrame, min_bars: int = MIN_BARS) -> DataFrame:
    return rv_mean(days, 7, min_bars)


def rv_month(days: DataFrame, min_bars: int = MIN_BARS) -> DataFrame:
    return rv_mean(days, 30, min_bars)


def one_row_a_day(df: DataFrame) -> DataFrame:
    count = F.count(F.lit(1)).over(by(["symbol", "day"], "day").rangeBetween(0, 0))
    return require(df.withColumn("_n", count), F.col("_n") == 1, "repeated days").drop("_n")


def lagged_index(index: DataFrame) -> DataFrame:
    """Close of the calendar day before, on days that have a row; a join on the date, as lag would span gaps."""
    d = one_row_a_day(index.select("symbol", "day", "close"))
    before = d.select("symbol", F.date_add("day", 1).alias("day"), F.col("close").alias("value"))
    return d.select("symbol", "day").join(before, ["symbol", "day"], "left")


def lagged_mean(rates: DataFrame) -> DataFrame:
    """Mean rate of the calendar day before, on the calendar; ``rates`` has (symbol, ts, rate), null rates are skipped."""
    daily = rates.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.avg(F.when(~F.isnan("rate"), F.col("rate"))).alias("x"))
    return _value(on_calendar(daily), F.lag("x").over(by(["symbol"], "day")))


def _valid_ohlc(days: DataFrame, min_bars: int) -> DataFrame:
    d = days.select("symbol", "day", "high", "low", "close", "n_bars")
    ok = (F.col("n_bars") >= min_bars) & (F.col("low") > 0) & (F.col("high") > F.col("low")) & F.col("close").between(F.col("low"), F.col("high"))
    return on_calendar(d.select("symbol", "day", *[F.when(ok, F.col(c)).alias(c) for c in ("high", "low", "close")]))


def day_range(days: DataFrame, min_bars: int = MIN_BARS) -> DataFrame:
    return _value(_valid_ohlc(days, min_bars), F.ln(positive(F.ln(F.col("high") / F.col("low")))))


def atr14(days: DataFrame, min_bars: int = MIN_BARS) -> DataFrame:
    d = _valid_ohlc(days, min_bars).withColumn("before", F.lag("close").over(by(["symbol"], "day")))
    parts = [F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("before")), F.abs(F.col("low") - F.col("before"))]
    d = d.withColumn("tr", F.when(F.col("before").isNotNull() & F.col("high").isNotNull(), F.greatest(*parts)))
    return _value(d, F.ln(positive(full_mean(F.col("tr"), trailing(["symbol"], "day", 14), 14) / F.col("close"))))


def ema20_distance(days: DataFrame, min_bars: int = MIN_BARS) -> DataFrame:
    d = _valid_ohlc(days, min_bars)
    start = F.min("day").over(by(["symbol"], "day").rowsBetween(W.unboundedPreceding, 0))
    d = ew_mean(d.withColumn("at", F.date_diff("day", start).cast("long")), ["symbol"], "at", "close", 19 / 21, 20, "ema")
    return _value(d, F.ln(F.col("close") / F.col("ema")))


def bb20_width(days: DataFrame, min_bars: int = MIN_BARS) -> DataFrame:
    d, w = _valid_ohlc(days, min_bars), trailing(["symbol"], "day", 20)
    sd = F.when(F.count("close").over(w) == 20, F.stddev_samp("close").over(w))
    return _value(d, F.ln(4.0 * positive(sd) / full_mean(F.col("close"), w, 20)))


def rsi14(days: DataFrame, min_bars: int = MIN_BARS) -> DataFrame:
    d = _valid_ohlc(days, min_bars).withColumn("move", F.col("close") - F.lag("close").over(by(["symbol"], "day")))
    w = trailing(["symbol"], "day", 14)
    up, down = (full_mean(F.when(F.col("move").isNotNull(), F.greatest(s * F.col("move"), F.lit(0.0))), w, 14) for s in (1, -1))
    return _value(d, (100.0 * up / positive(up + down) - 50.0) / 50.0)


@dataclass(frozen=True)
class Feature:
    """A registry entry: the builder, what it reads, and the days by which its input may lag."""

    name: str
    build: Callable[..., DataFrame]
    source: str
    columns: tuple[str, ...]
    delay_days: int = 0
    window_days: int = 1


REGISTRY = {
    f.name: f
    for f in (
        Feature("rv_day", rv_day, "daily_rv", ("rv", "n_bars")),
        Feature("rv_week", rv_week, "daily_rv", ("rv", "n_bars"), window_days=7),
        Feature("rv_month", rv_month, "daily_rv", ("rv", "n_bars"), window_days=30),
        Feature("lagged_index", lagged_index, "vol_index", ("close",), delay_days=1),
        Feature("lagged_mean", lagged_mean, "funding", ("rate",), delay_days=1),
        Feature("day_range", day_range, "daily_ohlc", ("high", "low", "close", "n_bars")),
        Feature("atr14", atr14, "daily_ohlc", ("high", "low", "close", "n_bars"), window_days=15),
        Feature("ema20_distance", ema20_distance, "daily_ohlc", ("high", "low", "close", "n_bars"), window_days=20),
        Feature("bb20_width", bb20_width, "daily_ohlc", ("high", "low", "close", "n_bars"), window_days=20),
        Feature("rsi14", rsi14, "daily_ohlc", ("high", "low", "close", "n_bars"), window_days=15),
    )
}


def technical_features(days: DataFrame, min_bars: int = MIN_BARS) -> DataFrame:
    """The five features of daily OHLC side by side: (symbol, day, one column each)."""
    names = ("day_range", "atr14", "ema20_distance", "bb20_width", "rsi14")
    out = None
    for name in names:
        one = REGISTRY[name].build(days, min_bars).withColumnRenamed("value", name)
        out = one if out is None else out.join(one, ["symbol", "day"])
    return out


def point_mass(values: DataFrame, places: int | None = None) -> DataFrame:
    """(symbol, mode, share): the most frequent value (smallest on ties) and its share of the non-null values."""
    x = F.col("value") if places is None else F.bround("value", places)
    counts = values.where("value is not null").groupBy("symbol", x.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("symbol").agg(F.min_by("v", F.struct((-F.col("n")).alias("n"), "v")).alias("mode"), (F.max("n") / F.sum("n")).alias("share"))


def check_point_mass(values: DataFrame, limit: float = 0.2, places: int | None = None) -> DataFrame:
    """The point masses; a share above the limit fails the evaluation."""
    return require(point_mass(values, places), F.col("share") <= limit, "a percentile threshold would split a point mass")
