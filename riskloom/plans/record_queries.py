"""Queries over manifests, memberships, thresholds and records, with their DuckDB SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import candles, controls, features, positions, quality, thresholds, trades, universe, var_es
from riskloom.plans import risk_queries, series_queries
from riskloom.plans.oracle import normal_cdf_sql, sql
from riskloom.plans.tidy import tidy
from riskloom.sources import adapters, archives

BASE = "http://archive"
MONTHS = ("2021-11", "2022-02")
TIMEFRAMES = ["F", "O", "P", "X"]


def _scalar(function: Callable[..., float], *columns: Column) -> Column:
    """A function of numbers, applied to columns of few rows."""

    @F.pandas_udf("double")
    def run(d: pd.DataFrame) -> pd.Series:
        return pd.Series([function(*row) for row in d.itertuples(index=False)], dtype="float64")

    return run(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)]))


def month_list(spark: SparkSession, sf: str) -> DataFrame:
    """Archive URLs of four months for every nation and two timeframes."""
    pairs = adapters.table(spark, sf, "nation").select(F.col("n_name").alias("symbol"), F.explode(F.array(F.lit("5m"), F.lit("1d"))).alias("timeframe"))
    return archives.month_urls(pairs, BASE, *MONTHS)


def _manifest(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest whose pairs are order priorities and states: at most one entry for each combination."""
    counts = adapters.table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("o_custkey") % 7 == 0).alias("gaps"), F.count_if(F.col("o_totalprice") > 200000).alias("missing")
    )
    q = F.map_from_arrays(F.array(*map(F.lit, ("rows", "gaps", "missing"))), F.array("rows", "gaps", "missing"))
    pair = F.concat_ws("/", "o_orderpriority", "o_orderstatus")
    return counts.agg(F.map_from_entries(F.collect_list(F.struct(pair, q))).alias("quality"))


def _manifest_table(spark: SparkSession, sf: str) -> DataFrame:
    return quality.manifest_table(_manifest(spark, sf))


def manifest_table(spark, sf):
    return tidy(_manifest_table(spark, sf))


def manifest_summary(spark, sf):
    return tidy(quality.manifest_summary(_manifest_table(spark, sf)))


def most_missing(spark, sf):
    return tidy(quality.most_missing(_manifest_table(spark, sf), 5))


def manifest_completeness(spark, sf):
    """Pairs that the manifest lacks, of all order priorities and nations."""
    wanted = adapters.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("symbol"))
    wanted = wanted.unionByName(adapters.table(spark, sf, "nation").select(F.col("n_name").alias("symbol")))
    return quality.completeness(_manifest_table(spark, sf), wanted, TIMEFRAMES)


def monthly_members(spark, sf):
    return controls.monthly_members(adapters.daily(spark, sf))


def technical_features(spark, sf):
    return tidy(features.technical_features(adapters.daily(spark, sf).withColumnRenamed("n", "n_bars"), 1))


def point_mass_gate(spark, sf):
    items = adapters.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("symbol"), F.col("l_quantity").alias("value"))
    return tidy(features.check_point_mass(items, 0.5))


def registered_disagreements(spark, sf):
    """Problems of the fingerprints against a registration with one symbol left out, one added and two changed."""
    found = series_queries.oos_fingerprint(spark, sf)
    is_ = lambda s: F.col("symbol") == s
    registered = found.where(~is_("AF")).select(
        F.when(is_("AO"), "ZZ").otherwise(F.col("symbol")).alias("symbol"), (F.col("n_days") + is_("NF").cast("long")).alias("n_days"),
        F.when(is_("RF"), "0").otherwise(F.col("fingerprint")).alias("fingerprint"),
    )
    return universe.disagreements(found, registered)


def monte_carlo_p(spark, sf):
    """Each symbol's Z2 among those of its own years."""
    d = risk_queries._forecasts(spark, sf)
    null = var_es.z2(d.withColumn("year", F.year("day")), risk_queries.P, ["symbol", "year"]).select("symbol", "z2")
    return tidy(var_es.monte_carlo_p(var_es.z2(d, risk_queries.P).select("symbol", "z2"), null, ["symbol"]))


def required_trades(spark, sf):
    """Trades that tell each brand's assumed hit rate from 0.52."""
    p = adapters.table(spark, sf, "part").groupBy("p_brand").agg((0.4 + F.avg("p_size") / 250).alias("p_true"))
    return tidy(p.withColumn("n", _scalar(lambda x: trades.required_trades(x, 0.52), F.col("p_true"))), 3)


def multiple_testing(spark, sf):
    """Expected best t of as many trials as a brand has parts, the t that this demands, and its yearly Sharpe ratio."""
    n = adapters.table(spark, sf, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    best, need = _scalar(lambda k: thresholds.expected_max_t(int(k)), F.col("n")), _scalar(lambda k: thresholds.required_t(int(k)), F.col("n"))
    yearly = _scalar(thresholds.min_annual_sr, F.col("required_t"))
    return tidy(n.withColumn("expected_max_t", best).withColumn("required_t", need).withColumn("min_annual_sr", yearly))


def deflated_sharpe(spark, sf):
    """Probability that each symbol's Sharpe ratio exceeds the best of ten trials without any edge."""
    d = candles.log_returns(adapters.daily(spark, sf)).where("r is not null")
    g = d.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), (F.avg("r") / F.stddev_samp("r")).alias("sr"), F.skewness("r").alias("skew"), (F.kurtosis("r") + 3).alias("kurtosis"))

    def probability(n: float, sr: float, skew: float, kurtosis: float) -> float:
        return thresholds.deflated_sharpe(sr, thresholds.expected_max_sr(10, 1 / n), n, skew, kurtosis)

    return tidy(g.withColumn("probability", _scalar(probability, F.col("n"), F.col("sr"), F.col("skew"), F.col("kurtosis"))))


def poisson_power(spark, sf):
    """Power of the one-sided Poisson test against twice as many customers as a nation's share would give."""
    n = adapters.table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")).withColumn("expected", F.col("n") / 10)
    return tidy(n.withColumn("power", _scalar(lambda e: positions.poisson_power(e, 2.0), F.col("expected"))))


MANIFEST_SQL = """m AS (SELECT o_orderpriority AS symbol, o_orderstatus AS timeframe, count(*) AS rows, CAST(0 AS BIGINT) AS duplicates, count(*) FILTER (o_custkey % 7 = 0) AS gaps,
    count(*) FILTER (o_totalprice > 200000) AS missing, CAST(0 AS BIGINT) AS empty, CAST(0 AS BIGINT) AS inconsistent, CAST(0 AS BIGINT) AS jumps FROM orders GROUP BY 1, 2)"""
SUMS = ", ".join(f"CAST(sum({f}) AS BIGINT) AS {f}" for f in quality.QUALITY_FIELDS)
TECHNICAL = {"day_range": "feat_range", "atr14": "feat_atr14", "ema20_distance": "feat_ema20", "bb20_width": "feat_bb20", "rsi14": "feat_rsi14"}
QUANTILES = """q AS (SELECT p, max_by(x, k) AS x FROM newton GROUP BY p)"""


def _quantile_sql(points: str) -> str:
    """Normal quantiles of the points from 0.5 on (and the reflected ones below) by Newton steps from 0, which rise to the root."""
    step = f"(p - {normal_cdf_sql('x')}) / (exp(-0.5 * x * x) / sqrt(2 * pi()))"
    return f"""newton AS (SELECT p, CAST(0 AS DOUBLE) AS x, 0 AS k FROM ({points}) UNION ALL SELECT p, x + {step}, k + 1 FROM newton WHERE k < 40), {QUANTILES}"""


G = repr(thresholds.EULER_GAMMA)
BEST = f"((1 - {G}) * a.x + {G} * b.x)"
TEN = thresholds.expected_max_t(10)

QUERIES = {
    "month_list": (month_list, f"""SELECT symbol, timeframe, strftime(m, '%Y-%m') AS month, '{BASE}/' || e || '/' || timeframe || '/' || e || '-' || timeframe || '-' || strftime(m, '%Y-%m') || '.zip' AS url
        FROM (SELECT n_name AS symbol, replace(n_name, ' ', '%20') AS e, unnest(['5m', '1d']) AS timeframe FROM nation),
        (SELECT unnest(generate_series(DATE '{MONTHS[0]}-01', DATE '{MONTHS[1]}-01', INTERVAL 1 MONTH)) AS m)"""),
    "manifest_table": (manifest_table, f"WITH {MANIFEST_SQL} SELECT * FROM m"),
    "manifest_summary": (manifest_summary, f"WITH {MANIFEST_SQL} SELECT timeframe, count(*) AS pairs, count(*) FILTER (gaps > 0) AS pairs_with_gaps, {SUMS} FROM m GROUP BY timeframe"),
    "most_missing": (most_missing, f"WITH {MANIFEST_SQL} SELECT * FROM m ORDER BY missing DESC, symbol, timeframe LIMIT 5"),
    "manifest_completeness": (manifest_completeness, f"""WITH {MANIFEST_SQL} SELECT symbol, timeframe FROM (SELECT symbol, unnest({TIMEFRAMES!r}) AS timeframe FROM (
        SELECT o_orderpriority AS symbol FROM orders UNION SELECT n_name FROM nation)) w ANTI JOIN m USING (symbol, timeframe)"""),
    "monthly_members": (monthly_members, sql("SELECT DISTINCT CAST(date_trunc('month', day) AS DATE) AS month, symbol FROM daily", "daily")),
    "technical_features": (technical_features, f"""SELECT symbol, day, {', '.join(f'{n}.value AS {n}' for n in TECHNICAL)} FROM
        {' JOIN '.join(f'({series_queries.QUERIES[q][1]}) {n}' + (' USING (symbol, day)' if i else '') for i, (n, q) in enumerate(TECHNICAL.items()))}"""),
    "point_mass_gate": (point_mass_gate, series_queries.QUERIES["point_mass"][1]),
    "registered_disagreements": (registered_disagreements, f"""SELECT symbol, CASE symbol WHEN 'NF' THEN 'day count' WHEN 'RF' THEN 'fingerprint' ELSE 'not registered' END AS problem
        FROM ({series_queries.QUERIES['oos_fingerprint'][1]}) WHERE symbol IN ('AF', 'AO', 'NF', 'RF') UNION ALL
        SELECT 'ZZ', 'missing' FROM ({series_queries.QUERIES['oos_fingerprint'][1]}) WHERE symbol = 'AO'"""),
    "monte_carlo_p": (monte_carlo_p, sql("""SELECT s.symbol, round(s.z2, 6) AS z2, round((1 + count(*) FILTER (n.z2 <= s.z2)) / (1 + count(*)), 6) AS p_value FROM
        (SELECT symbol, 1 - sum(CASE WHEN r < q THEN r / es ELSE 0.0 END) / (count(*) * {p}) AS z2 FROM fc GROUP BY symbol) s JOIN
        (SELECT symbol, 1 - sum(CASE WHEN r < q THEN r / es ELSE 0.0 END) / (count(*) * {p}) AS z2 FROM fc GROUP BY symbol, year(day)) n ON n.symbol = s.symbol GROUP BY s.symbol, s.z2""", "fc", **risk_queries.CONST)),
    "required_trades": (required_trades, f"""SELECT p_brand, round(p, 3) AS p_true, round(power({trades.Z_95} * sqrt(0.52 * 0.48) + {trades.Z_POWER_80} * sqrt(p * (1 - p)), 2) / power(p - 0.52, 2), 3) AS n
        FROM (SELECT p_brand, 0.4 + avg(p_size) / 250 AS p FROM part GROUP BY p_brand)"""),
    "multiple_testing": (multiple_testing, f"""WITH RECURSIVE c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand),
        {_quantile_sql(f'SELECT 1 - 1.0::DOUBLE / n AS p FROM c WHERE n > 1 UNION SELECT 1 - 1 / (n * {math.e!r}::DOUBLE) FROM c WHERE n > 1 UNION SELECT 0.95::DOUBLE')}
        SELECT p_brand, n, round(best, 6) AS expected_max_t, round(best + z, 6) AS required_t, round((best + z) / sqrt({thresholds.YEARS}), 6) AS min_annual_sr FROM (
        SELECT p_brand, n, coalesce({BEST}, 0.0) AS best, (SELECT x FROM q WHERE p = 0.95::DOUBLE) AS z FROM c LEFT JOIN q a ON a.p = 1 - 1.0::DOUBLE / n LEFT JOIN q b ON b.p = 1 - 1 / (n * {math.e!r}::DOUBLE))"""),
    "deflated_sharpe": (deflated_sharpe, sql(f"""SELECT symbol, n, round(sr, 6) AS sr, round(skew, 6) AS skew, round(kurtosis, 6) AS kurtosis, round({normal_cdf_sql('z')}, 6) AS probability FROM (
        SELECT *, (sr - sqrt(1.0 / n) * {TEN!r}::DOUBLE) * sqrt(n - 1) / sqrt(1 - skew * sr + (kurtosis - 1) / 4 * sr * sr) AS z FROM (
        SELECT symbol, count(*) AS n, avg(r) / stddev_samp(r) AS sr, avg(power(r - m, 3)) / power(var_pop(r), 1.5) AS skew, avg(power(r - m, 4)) / power(var_pop(r), 2) AS kurtosis FROM (
        SELECT symbol, r, avg(r) OVER (PARTITION BY symbol) AS m FROM ret WHERE r IS NOT NULL) GROUP BY symbol))""", "ret")),
    "poisson_power": (poisson_power, """WITH e AS (SELECT c_nationkey, count(*) AS n, count(*) / 10 AS expected FROM customer GROUP BY 1),
        k AS (SELECT c_nationkey, n, expected, unnest(range(0, CAST(6 * expected + 60 AS BIGINT))) AS k FROM e),
        s AS (SELECT *, sum(exp(-expected + k * ln(expected) - lgamma(k + 1))) OVER w AS below, sum(exp(-2 * expected + k * ln(2 * expected) - lgamma(k + 1))) OVER w AS other FROM k
            WINDOW w AS (PARTITION BY c_nationkey ORDER BY k))
        SELECT c_nationkey, any_value(n) AS n, round(any_value(expected), 6) AS expected, round(1 - min(other) FILTER (1 - below <= 0.05), 6) AS power FROM s GROUP BY c_nationkey"""),
}
