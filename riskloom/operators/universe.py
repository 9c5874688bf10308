"""Universe membership, eligibility, selection, and agreement with a registered plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    """Fixed parameters of a selection."""

    start: str = "2021-01-01"
    end: str = "2026-09-30"
    latest_start: str = "2022-01-01"
    min_months: int = 12
    min_share: float = 0.95
    k_max: int = 20
    k_min: int = 12
    share: float = 0.8
    exclude_after_gap: bool = True
    min_train: int = 365
    every: int = 30
    reps: int = 1000


def from_json(spark, path: str) -> DataFrame:
    """(month, symbol) rows of a JSON map from month to symbols."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("month", "symbols")).select(F.to_date("month").alias("month"), F.explode("symbols").alias("symbol"))


def symbols(members: DataFrame, since: str) -> DataFrame:
    return members.where(F.col("month") >= F.lit(since).cast("date")).select("symbol").distinct()


def months(members: DataFrame, since: str | None = None) -> DataFrame:
    """(symbol, n_months)."""
    m = members if since is None else members.where(F.col("month") >= F.lit(since).cast("date"))
    return m.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_months"))


def top_by_months(members: DataFrame, k: int) -> DataFrame:
    """k symbols with most months, ties by name."""
    return months(members).orderBy(F.desc("n_months"), "symbol").limit(k)


def availability(flags: DataFrame, s: Settings) -> DataFrame:
    """(symbol, first_valid, last_valid, period_days, valid_days, share) from day flags; valid means valid and not dead."""
    ok = F.col("valid") & ~F.col("dead")
    inside = F.col("day").between(F.lit(s.start).cast("date"), F.lit(s.end).cast("date"))
    period = F.date_diff(F.lit(s.end).cast("date"), F.lit(s.start).cast("date")) + 1
    g = flags.groupBy("symbol").agg(F.min(F.when(ok, F.col("day"))).alias("first_valid"), F.max(F.when(ok, F.col("day"))).alias("last_valid"), F.count_if(ok & inside).alias("valid_days"))
    return g.select("symbol", "first_valid", "last_valid", period.alias("period_days"), "valid_days", (F.col("valid_days") / period).alias("share"))


def qualifies(s: Settings):
    date = lambda d: F.lit(d).cast("date")
    return F.coalesce((F.col("first_valid") <= date(s.latest_start)) & (F.col("last_valid") >= date(s.end)) & (F.col("share") >= s.min_share), F.lit(False))


def select(month_counts: DataFrame, available: DataFrame, s: Settings) -> DataFrame:
    """Qualifying symbols with enough months, most months first, ties by name, at most k_max."""
    ok = month_counts.where(F.col("n_months") >= s.min_months).join(available.where(qualifies(s)), "symbol")
    return ok.orderBy(F.desc("n_months"), "symbol").limit(s.k_max)


def disagreements(found: DataFrame, registered: DataFrame) -> DataFrame:
    """(symbol, problem) where (symbol, n_days, fingerprint) rows differ from the registered ones; empty if they agree."""
    both = found.select("symbol", F.col("n_days").alias("n"), F.col("fingerprint").alias("f"), F.lit(True).alias("a")).join(registered.select("symbol", "n_days", "fingerprint", F.lit(True).alias("b")), "symbol", "full")
    problem = (
        F.when(F.col("a").isNull(), "missing").when(F.col("b").isNull(), "not registered")
        .when(F.col("n") != F.col("n_days"), "day count").when(F.col("f") != F.col("fingerprint"), "fingerprint")
    )
    return both.select("symbol", problem.alias("problem")).where("problem is not null")
