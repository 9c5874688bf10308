"""Data quality without repair: gaps, duplicates, empty or inconsistent candles, jumps, index ranges, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.columns import by, quantiles

MAD_TO_SIGMA = 1.4826
INDEX_RANGE = (0.0, 400.0)


def gaps(bars: DataFrame, step_seconds: int) -> DataFrame:
    """(symbol, ts, gap_seconds, missing) after each gap between distinct times. Windows reach one bar back per day.

    The last time of each day is linked on the daily level, so a symbol's bars are never in one task.
    """
    times = bars.select("symbol", F.to_date("ts").alias("day"), F.col("ts").cast("timestamp").alias("ts")).distinct()
    ends = times.groupBy("symbol", "day").agg(F.max("ts").alias("last"))
    before = ends.withColumn("before", F.lag("last").over(by(["symbol"], "day"))).select("symbol", "day", "before")
    inside = F.lag("ts").over(by(["symbol", "day"], "ts"))
    linked = times.withColumn("inside", inside).join(before, ["symbol", "day"])
    seconds = F.unix_micros("ts") / 1e6 - F.unix_micros(F.coalesce("inside", "before")) / 1e6
    return (
        linked.withColumn("gap_seconds", seconds).where(F.col("gap_seconds") > step_seconds)
        .select("symbol", "ts", "gap_seconds", (F.bround(F.col("gap_seconds") / step_seconds) - 1).cast("long").alias("missing"))
    )


def duplicates(bars: DataFrame) -> DataFrame:
    """(symbol, duplicates): rows beyond the first of each time. Two-level counts, so a hot symbol is many keys."""
    each = bars.groupBy("symbol", "ts").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("symbol").agg(F.sum(F.col("n") - 1).alias("duplicates"))


def jumps(bars: DataFrame, k: float = 10.0) -> DataFrame:
    """(symbol, ts, change) where a log change lies more than k robust sigmas (MAD) from the symbol's median."""
    inside = F.lag("close").over(by(["symbol", "day"], "ts"))
    ends = bars.groupBy("symbol", "day").agg(F.max_by("close", "ts").alias("last"))
    before = ends.withColumn("before", F.lag("last").over(by(["symbol"], "day"))).select("symbol", "day", "before")
    changes = bars.withColumn("inside", inside).join(before, ["symbol", "day"]).select("symbol", "ts", (F.ln("close") - F.ln(F.coalesce("inside", "before"))).alias("change")).where("change is not null")
    centre = quantiles(changes, ["symbol"], "change", {"median": 0.5})
    away = changes.join(centre, "symbol").withColumn("away", F.abs(F.col("change") - F.col("median")))
    spread = quantiles(away, ["symbol"], "away", {"mad": 0.5}).select("symbol", (F.col("mad") * MAD_TO_SIGMA).alias("sigma"))
    return away.join(spread, "symbol").where((F.col("sigma") > 0) & (F.col("away") > k * F.col("sigma"))).select("symbol", "ts", "change")


def report(bars: DataFrame, step_seconds: int, k: float = 10.0) -> DataFrame:
    """One row per symbol: rows, first and last time, duplicates, gaps, missing intervals, largest gap, empty and inconsistent candles, jumps."""
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    counts = bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.count_if((F.col("volume") == 0) | (F.col("high") == F.col("low"))).alias("empty_candles"),
        F.count_if((F.col("high") < top) | (F.col("low") > bottom) | (F.col("low") <= 0)).alias("inconsistent"),
    )
    gap = gaps(bars, step_seconds).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_gaps"), F.sum("missing").alias("missing_intervals"), F.max("gap_seconds").alias("largest_gap"))
    jump = jumps(bars, k).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_jumps"))
    out = counts.join(duplicates(bars), "symbol", "left").join(gap, "symbol", "left").join(jump, "symbol", "left")
    return out.fillna(0, ["duplicates", "n_gaps", "missing_intervals", "n_jumps"]).fillna(0.0, ["largest_gap"])


def index_report(index: DataFrame, low: float = INDEX_RANGE[0], high: float = INDEX_RANGE[1]) -> DataFrame:
    """One row per symbol of a daily index: rows, duplicate days, missing days, values out of range, inconsistent OHLC."""
    values = ["open", "high", "low", "close"]
    outside = F.array_contains(F.array(*[(F.col(c) <= low) | (F.col(c) > high) for c in values]), True)
    counts = index.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_rows"), (F.count(F.lit(1)) - F.count_distinct("day")).alias("duplicates"),
        (F.date_diff(F.max("day"), F.min("day")) + 1 - F.count_distinct("day")).cast("long").alias("missing_days"),
        F.count_if(outside).alias("out_of_range"),
        F.count_if((F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close"))).alias("inconsistent"),
    )
    return counts


def known_day_control(daily: DataFrame, day: str, low_below: float | None = None, high_above: float | None = None) -> DataFrame:
    """(symbol, ok): whether a known day has the known extremes."""
    ok = F.lit(True)
    if low_below is not None:
        ok = ok & (F.col("low") < low_below)
    if high_above is not None:
        ok = ok & (F.col("high") > high_above)
    return daily.groupBy("symbol").agg(F.coalesce(F.bool_or(F.when(F.col("day") == F.lit(day).cast("date"), ok)), F.lit(False)).alias("ok"))


QUALITY_FIELDS = ("rows", "duplicates", "gaps", "missing", "empty", "inconsistent", "jumps")


def manifest_table(manifest: DataFrame) -> DataFrame:
    """One row per (symbol, timeframe) of a manifest's quality map; fields that are missing count 0."""
    entry = manifest.select(F.explode("quality").alias("pair", "q"))
    parts = F.split("pair", "/")
    return entry.select(parts[0].alias("symbol"), parts[1].alias("timeframe"), *[F.coalesce(F.col("q")[f], F.lit(0)).alias(f) for f in QUALITY_FIELDS])


def manifest_summary(table: DataFrame) -> DataFrame:
    """Sums per timeframe, with pairs and pairs that have gaps."""
    return table.groupBy("timeframe").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("gaps") > 0).alias("pairs_with_gaps"), *[F.sum(f).alias(f) for f in QUALITY_FIELDS]
    )


def most_missing(table: DataFrame, k: int = 10) -> DataFrame:
    return table.orderBy(F.desc("missing"), "symbol", "timeframe").limit(k)


def completeness(table: DataFrame, wanted: DataFrame, timeframes: list[str]) -> DataFrame:
    """(symbol, timeframe) pairs of the wanted symbols that a manifest lacks or that have no rows."""
    pairs = wanted.select("symbol").distinct().withColumn("timeframe", F.explode(F.array(*[F.lit(t) for t in timeframes])))
    return pairs.join(table.where("rows > 0"), ["symbol", "timeframe"], "left_anti")
