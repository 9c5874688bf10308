"""Look-ahead gate: does a feature's past change when the future does?

The feature is rebuilt on data whose rows after a cut are replaced (scaled, reversed, multiplied or missing), and on data
that end at the cut. Values up to the cut must be the same, bit for bit unless a tolerance is asked for.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KINDS = ("random", "reversed", "scaled", "missing")


@dataclass(frozen=True)
class Violation:
    """The first difference that a perturbed future made."""

    kind: str
    cut: object
    symbol: str
    day: object
    clean: float | None
    changed: float | None


def perturbed(df: DataFrame, time: str, cut, kind: str, columns: list[str], seed: int = 0) -> DataFrame:
    """``df`` with the numeric ``columns`` of rows after ``cut`` replaced by one kind of garbage."""
    later = F.col(time) > F.lit(cut)
    if kind == "missing":
        return df.withColumns({c: F.when(~later, F.col(c)) for c in columns})
    if kind == "scaled":
        return df.withColumns({c: F.when(later, F.col(c) * 7.3).otherwise(F.col(c)) for c in columns})
    if kind == "random":
        noise = lambda c: F.pmod(F.xxhash64(F.lit(seed), F.lit(c), "symbol", F.col(time)), F.lit(1 << 20)) / float(1 << 20)
        return df.withColumns({c: F.when(later, (F.abs(F.col(c)) + 1) * (0.1 + 3 * noise(c))).otherwise(F.col(c)) for c in columns})
    if kind == "reversed":
        forward, back = (W.partitionBy("symbol", later).orderBy(o) for o in (F.col(time), F.col(time).desc()))
        numbered = df.withColumn("_at", F.row_number().over(forward)).withColumn("_late", later)
        mirror = df.withColumn("_at", F.row_number().over(back)).withColumn("_late", later).select("symbol", "_at", "_late", *[F.col(c).alias("_" + c) for c in columns])
        joined = numbered.join(mirror, ["symbol", "_at", "_late"])
        return joined.withColumns({c: F.when(F.col("_late"), F.col("_" + c)).otherwise(F.col(c)) for c in columns}).select(df.columns)
    raise ValueError(f"kind is one of {KINDS}")


def first_difference(clean: DataFrame, changed: DataFrame, until, rtol: float = 0.0) -> DataFrame:
    """The earliest row up to ``until`` whose value differs (one row or none)."""
    keep = F.col("day") <= F.lit(until).cast("date")
    both = clean.where(keep).select("symbol", "day", F.col("value").alias("clean"), F.lit(True).alias("a")).join(
        changed.where(keep).select("symbol", "day", F.col("value").alias("changed"), F.lit(True).alias("b")), ["symbol", "day"], "full"
    )
    same: Column = F.col("clean").eqNullSafe(F.col("changed"))
    if rtol:
        same = same | (F.abs(F.col("clean") - F.col("changed")) <= rtol * F.abs(F.col("clean")))
    absent = F.col("a").isNull() & F.col("changed").isNotNull() | F.col("b").isNull() & F.col("clean").isNotNull()
    return both.where(absent | ~F.coalesce(same, F.lit(False))).orderBy("day", "symbol").limit(1)


def cuts(df: DataFrame, time: str, n: int | None = None, seed: int = 0) -> list:
    """Cut points: every time but the last, or ``n`` of them drawn by a seeded hash."""
    times = df.select(time).distinct()
    last = times.agg(F.max(time)).first()[0]
    rest = times.where(F.col(time) < F.lit(last))
    if n is not None:
        rest = rest.orderBy(F.xxhash64(F.lit(seed), time)).limit(n)
    return sorted(r[0] for r in rest.collect())


def check(build: Callable[[DataFrame], DataFrame], df: DataFrame, time: str, columns: list[str], points: list, kinds=KINDS, delay_days: int = 0, rtol: float = 0.0, truncate: bool = True, seed: int = 0) -> Violation | None:
    """None if no cut changes the past, else the first violation. A test without cuts or kinds is an error."""
    if not points or not kinds or set(kinds) - set(KINDS) or delay_days < 0 or not 0 <= rtol < 1e-6:
        raise ValueError("cuts and known kinds are needed, a delay of at least 0, and a tolerance below 1e-6")
    clean = build(df)
    if set(clean.columns) != {"symbol", "day", "value"}:
        raise ValueError("a feature returns symbol, day and value")
    trials = [("repeat", points[-1], df)]
    for cut in points:
        trials += [(kind, cut, perturbed(df, time, cut, kind, columns, seed)) for kind in kinds]
        trials += [("truncated", cut, df.where(F.col(time) <= F.lit(cut)))] * truncate
    for kind, cut, other in trials:
        until = F.to_date(F.lit(cut)) if kind == "repeat" else F.date_add(F.to_date(F.lit(cut)), 0 if kind == "truncated" else delay_days)
        found = first_difference(clean, build(other), until, rtol).collect()
        if found:
            r = found[0]
            return Violation(kind, cut, r.symbol, r.day, r.clean, r.changed)
    return None
