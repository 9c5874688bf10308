"""Candles to days: realised variance, daily OHLC, calendars, day classes, returns and inventories.

Intraday windows are keyed by (symbol, day), so no task holds more than a day of bars of one symbol; what links days is
joined on the daily level, where a symbol has one row a day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from riskloom.functions.columns import by, positive, require

BARS_PER_DAY = 288
MIN_BARS = 274  # 95 % of a day, rounded up


def checked_bars(bars: DataFrame, min_bars: int = MIN_BARS) -> DataFrame:
    """Bars that satisfy the input contract; evaluation fails otherwise."""
    if not isinstance(min_bars, int) or isinstance(min_bars, bool) or not 1 <= min_bars <= BARS_PER_DAY:
        raise ValueError(f"min_bars must be a whole number in 1..{BARS_PER_DAY}")
    missing = {"symbol", "ts", "close", "volume"} - set(bars.columns)
    if missing:
        raise ValueError(f"bars lack {sorted(missing)}")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return require(bars, F.col("ts").isNotNull() & finite("close") & (F.col("close") > 0) & finite("volume") & (F.col("volume") >= 0), "bars: null time, close not positive and finite, or volume negative")


def unique_times(bars: DataFrame) -> DataFrame:
    """Bars without repeated (symbol, ts); a repeat fails the evaluation."""
    count = F.count(F.lit(1)).over(by(["symbol", "day", "ts"], "ts").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return require(bars.withColumn("_same", count), F.col("_same") == 1, "bars: repeated times").drop("_same")


def daily_ohlc(bars: DataFrame) -> DataFrame:
    """(symbol, day, high, low, close, n_bars)."""
    return bars.groupBy("symbol", "day").agg(
        F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.count(F.lit(1)).alias("n_bars")
    )


def daily_rv(bars: DataFrame) -> DataFrame:
    """(symbol, day, rv, r, n_bars, volume): sum of squared log returns, the first of a day from the last close before it.

    ``r`` is the simple return over observed days; the first day's rv is null.
    """
    inside = by(["symbol", "day"], "ts")
    change = F.ln("close") - F.ln(F.lag("close").over(inside))
    days = bars.withColumn("_c", change).groupBy("symbol", "day").agg(
        F.coalesce(F.sum(F.col("_c") * F.col("_c")), F.lit(0.0)).alias("inside"), F.min_by("close", "ts").alias("first"),
        F.max_by("close", "ts").alias("close"), F.count(F.lit(1)).alias("n_bars"), F.sum("volume").alias("volume"),
    )
    before = F.lag("close").over(by(["symbol"], "day"))
    opening = F.ln("first") - F.ln(before)
    return days.select("symbol", "day", (F.col("inside") + opening * opening).alias("rv"), (F.col("close") / before - 1).alias("r"), "n_bars", "volume")


def calendar(days: DataFrame, until: str | None = None) -> DataFrame:
    """Every (symbol, day) from a symbol's first day to its last one, or to ``until``."""
    last = F.max("day") if until is None else F.lit(until).cast("date")
    span = days.groupBy("symbol").agg(F.min("day").alias("first"), last.alias("last")).where("first <= last")
    return span.select("symbol", F.explode(F.sequence("first", "last", F.expr("interval 1 day"))).alias("day"))


def on_calendar(days: DataFrame, until: str | None = None) -> DataFrame:
    return calendar(days, until).join(days, ["symbol", "day"], "left")


def day_flags(bars: DataFrame, min_bars: int = MIN_BARS, exclude_after_gap: bool = False) -> DataFrame:
    """(symbol, day, n_bars, volume, rv, dead, after_gap, incomplete, valid) on the full calendar."""
    d = on_calendar(daily_rv(bars)).select(
        "symbol", "day", F.coalesce("n_bars", F.lit(0)).alias("n_bars"), F.coalesce("volume", F.lit(0.0)).alias("volume"), "rv"
    )
    traded = F.col("n_bars") > 0
    yes = lambda c: F.coalesce(c, F.lit(False))
    gap = yes(F.lag("n_bars").over(by(["symbol"], "day")) == 0)
    valid = (F.col("n_bars") >= min_bars) & yes(F.col("rv") > 0)
    out = d.withColumns({
        "dead": traded & (yes(F.col("rv") == 0) | (F.col("volume") == 0)), "after_gap": traded & gap,
        "incomplete": F.col("n_bars") < min_bars, "valid": valid,
    })
    return out.withColumn("valid", F.col("valid") & ~F.col("after_gap")) if exclude_after_gap else out


def flag_summary(flags: DataFrame) -> DataFrame:
    """Counts of flags per symbol, with a total row whose symbol is null."""
    return flags.rollup("symbol").agg(
        F.count(F.lit(1)).alias("days"), F.count_if("valid").alias("valid_days"), F.count_if("dead").alias("dead_days"),
        F.count_if("after_gap").alias("after_gap_days"), F.count_if("incomplete").alias("incomplete_days"),
        F.count_if(F.col("n_bars") == 0).alias("empty_days"), F.count_if(F.col("valid") & F.col("after_gap")).alias("valid_after_gap"),
    )


def compare_with_daily(flags: DataFrame, daily: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Per symbol: days dead only in bars, without volume only in the daily table, days only there, differing volumes."""
    traded = flags.where("n_bars > 0").select("symbol", "day", "dead", F.col("volume").alias("v5"), F.lit(True).alias("in_bars"))
    both = traded.join(daily.select("symbol", "day", F.col("volume").alias("v1"), F.lit(True).alias("in_daily")), ["symbol", "day"], "full")
    flag = lambda c: F.coalesce(c, F.lit(False))
    dead, idle = flag(F.col("dead")), flag(F.col("v1") == 0)
    return both.groupBy("symbol").agg(
        F.count_if(dead & ~idle).alias("dead_only_in_bars"), F.count_if(idle & ~dead).alias("idle_only_in_daily"),
        F.count_if(flag(F.col("in_daily")) & F.col("in_bars").isNull()).alias("days_only_in_daily"),
        F.count_if(flag(F.abs(F.col("v5") - F.col("v1")) > tolerance * F.col("v1"))).alias("volume_differs"),
    )


def log_returns(daily: DataFrame, until: str | None = None) -> DataFrame:
    """(symbol, day, r) on the calendar; null where this day or the one before is missing."""
    d = on_calendar(daily.select("symbol", "day", "close"), until)
    return d.select("symbol", "day", (F.ln(positive(F.col("close"))) - F.ln(positive(F.lag("close").over(by(["symbol"], "day"))))).alias("r"))


def inventory(daily: DataFrame, until: str | None = None) -> DataFrame:
    """(symbol, n_candles, first_day, last_day, missing_days, valid_returns)."""
    d = log_returns(daily, until).join(daily.select("symbol", "day", F.lit(True).alias("there")), ["symbol", "day"], "left")
    return d.groupBy("symbol").agg(
        F.count("there").alias("n_candles"), F.min(F.when(F.col("there"), F.col("day"))).alias("first_day"),
        F.max(F.when(F.col("there"), F.col("day"))).alias("last_day"), F.count_if(F.col("there").isNull()).alias("missing_days"),
        F.count("r").alias("valid_returns"),
    )


def panel_counts(returns: DataFrame) -> DataFrame:
    return returns.groupBy("day").agg(F.count("r").alias("n_returns"))


def common_panel(returns: DataFrame, n_symbols: int) -> DataFrame:
    """Rows of the days on which all ``n_symbols`` have a return."""
    if n_symbols < 2:
        raise ValueError("a panel needs two symbols at least")
    return returns.join(panel_counts(returns).where(F.col("n_returns") == n_symbols).select("day"), "day", "left_semi")


def cut_days(returns: DataFrame, n_symbols: int) -> DataFrame:
    """Days that a missing return costs, but the first of all."""
    counts = panel_counts(returns)
    return counts.where((F.col("n_returns") < n_symbols) & (F.col("day") > counts.agg(F.min("day")).scalar()))


def last_rows(panel: DataFrame, n: int) -> DataFrame:
    """Rows of the last n days (0: all); fewer days than n are an error."""
    if n == 0:
        return panel
    days = panel.select("day").distinct().orderBy(F.desc("day")).limit(n)
    have = days.count()
    if have < n:
        raise ValueError(f"the panel has {have} days; {n} are needed")
    return panel.join(days, "day", "left_semi")


def dead_tail(daily: DataFrame) -> DataFrame:
    """(symbol, tail_days, tail_start, idle_days): the run of days without volume at the end, and all such days."""
    last_live = F.max(F.when(F.col("volume") > 0, F.col("day"))).over(by(["symbol"], "symbol").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    d = daily.withColumn("_live", last_live)
    tail = (F.col("volume") == 0) & (F.col("_live").isNull() | (F.col("day") > F.col("_live")))
    return d.groupBy("symbol").agg(F.count_if(tail).alias("tail_days"), F.min(F.when(tail, F.col("day"))).alias("tail_start"), F.count_if(F.col("volume") == 0).alias("idle_days"))
