"""Queries over candles, days, features and forecasts, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.columns import by, full_mean, trailing
from riskloom.operators import candles, features, forecasts, leakage, quality, universe
from riskloom.plans.oracle import har_sql, sql
from riskloom.plans.tidy import tidy
from riskloom.sources import adapters

MIN_BARS = 50  # bars of a valid day in the event bars; theirs are sparser than exchange candles
STEP = 300


def seconds(column: str):
    return F.unix_timestamp(column).alias(column)


def candles_5m(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(adapters.bars(spark, sf).select("symbol", seconds("ts"), "day", "open", "high", "low", "close", "volume", "n"))


def daily_ohlc(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(candles.daily_ohlc(adapters.bars(spark, sf)))


def daily_rv(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(candles.daily_rv(adapters.bars(spark, sf)))


def day_flags(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(candles.day_flags(adapters.bars(spark, sf), MIN_BARS))


def day_flag_summary(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(candles.flag_summary(candles.day_flags(adapters.bars(spark, sf), MIN_BARS)))


def volume_parity(spark: SparkSession, sf: str) -> DataFrame:
    bars = adapters.bars(spark, sf)
    daily = bars.groupBy("symbol", "day").agg((F.sum("volume") * F.when(F.dayofmonth("day") % 7 == 0, 0).otherwise(1)).alias("volume"))
    return tidy(candles.compare_with_daily(candles.day_flags(bars, MIN_BARS), daily))


FLAGS = f"""SELECT symbol, day, n_bars, volume, rv, n_bars > 0 AND (coalesce(rv = 0, false) OR volume = 0) AS dead,
    n_bars > 0 AND coalesce(lag(n_bars) OVER (PARTITION BY symbol ORDER BY day) = 0, false) AS after_gap,
    n_bars < {MIN_BARS} AS incomplete, n_bars >= {MIN_BARS} AND coalesce(rv > 0, false) AS valid FROM rv_cal"""


def quality_report(spark: SparkSession, sf: str) -> DataFrame:
    r = quality.report(adapters.bars(spark, sf), STEP, 5.0)
    return tidy(r.withColumns({c: F.unix_timestamp(c) for c in ("first_ts", "last_ts")}))


def gap_list(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(quality.gaps(adapters.bars(spark, sf), STEP).withColumn("ts", F.unix_timestamp("ts")))


def duplicate_report(spark: SparkSession, sf: str) -> DataFrame:
    events = adapters.table(spark, sf, "events")
    return tidy(quality.duplicates(events.select(F.col("event_type").alias("symbol"), F.date_trunc("minute", "ts").alias("ts"))))


def jump_flags(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(quality.jumps(adapters.bars(spark, sf), 5.0).withColumn("ts", F.unix_timestamp("ts")))


def index_report(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(quality.index_report(adapters.daily(spark, sf), 900.0, 2000.0))


def known_day(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(quality.known_day_control(adapters.daily(spark, sf), "1995-03-15", 1500.0, 1500.0))


def dead_tail(spark: SparkSession, sf: str) -> DataFrame:
    d = adapters.daily(spark, sf)
    return tidy(candles.dead_tail(d.withColumn("volume", F.when((F.col("volume") < 60) | (F.col("day") >= "2001-09-01"), 0.0).otherwise(F.col("volume")))))


def log_returns(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(candles.log_returns(adapters.daily_sparse(spark, sf)))


def panel_common(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(candles.common_panel(candles.log_returns(adapters.daily_sparse(spark, sf)), 5))


def panel_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(candles.inventory(adapters.daily_sparse(spark, sf)))


def panel_cut_days(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(candles.cut_days(candles.log_returns(adapters.daily_sparse(spark, sf)), 5))


def panel_last_rows(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(candles.last_rows(candles.common_panel(candles.log_returns(adapters.daily_sparse(spark, sf)), 5), 20))


def membership_months(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(universe.months(adapters.members(spark, sf), "1995-01-01"))


def top_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(universe.top_by_months(adapters.members(spark, sf), 20))


SETTINGS = universe.Settings(start="1995-06-01", end="2001-06-30", latest_start="1995-03-01", min_months=12, min_share=0.5, k_max=4)


def eligible_symbols(spark: SparkSession, sf: str) -> DataFrame:
    d = adapters.daily(spark, sf)
    flags = candles.on_calendar(d).select("symbol", "day", F.coalesce(F.col("n") >= 2, F.lit(False)).alias("valid"), F.lit(False).alias("dead"))
    months = universe.months(d.select(F.to_date(F.date_trunc("month", "day")).alias("month"), "symbol").distinct())
    return tidy(universe.select(months, universe.availability(flags, SETTINGS), SETTINGS))


def feature(name: str, min_bars: int = 1):
    entry = features.REGISTRY[name]

    def query(spark: SparkSession, sf: str) -> DataFrame:
        d = adapters.daily_variance(spark, sf) if entry.source == "daily_rv" else adapters.daily(spark, sf).withColumnRenamed("n", "n_bars")
        return tidy(entry.build(d, min_bars))

    return query


def feat_lagged_index(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(features.lagged_index(adapters.daily_sparse(spark, sf)))


def feat_lagged_mean(spark: SparkSession, sf: str) -> DataFrame:
    events = adapters.table(spark, sf, "events")
    return tidy(features.lagged_mean(events.where("value <> 0").select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("rate"))))


def point_mass(spark: SparkSession, sf: str) -> DataFrame:
    items = adapters.table(spark, sf, "lineitem")
    return tidy(features.point_mass(items.select(F.col("l_returnflag").alias("symbol"), F.col("l_quantity").alias("value"))))


GATE_KINDS = ("scaled", "missing", "random", "reversed")  # all of leakage.KINDS; the SQL names the first to find the leak


def leakage_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each checked feature passes the look-ahead gate at two cuts; the last row is a feature made to fail."""
    d = adapters.daily_variance(spark, sf).persist()  # some dozen trials read it
    try:
        points = leakage.cuts(d, "day", 2, 7)
        peeking = lambda x: features.rv_day(x, 1).withColumn("value", F.lead("value", 3).over(by(["symbol"], "day")))
        rows = []
        for name, build in (("rv_day", lambda x: features.rv_day(x, 1)), ("rv_week", lambda x: features.rv_week(x, 1)), ("peeking", peeking)):
            found = leakage.check(build, d, "day", ["rv"], points, kinds=GATE_KINDS)
            rows.append((name, found is None, found.kind if found else None))
    finally:
        d.unpersist()
    return spark.createDataFrame(rows, "feature string, passed boolean, kind string")


def vol_window(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(forecasts.window_mean(adapters.daily_variance(spark, sf), 30))


def vol_ewma_com60(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(forecasts.ewma_com(adapters.daily_variance(spark, sf)))


def vol_lambda94(spark: SparkSession, sf: str) -> DataFrame:
    d = adapters.daily_variance(spark, sf)
    return tidy(forecasts.ewma_lambda(d.where("r is not null")))


def har_features(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(forecasts.har_features(adapters.daily_variance(spark, sf)))


def har_forecast(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(forecasts.har(adapters.daily_variance(spark, sf)))


def har_x_forecast(spark: SparkSession, sf: str) -> DataFrame:
    d = adapters.daily_variance(spark, sf)
    lagged = features.lagged_index(adapters.daily(spark, sf)).select("symbol", "day", F.ln("value").alias("x"))
    both = d.join(lagged, ["symbol", "day"], "left")
    base = forecasts.har(both, ["x"], use_extra=False).withColumnRenamed("forecast", "har")
    return tidy(base.join(forecasts.har(both, ["x"]).withColumnRenamed("forecast", "har_x"), ["symbol", "day"]))


def oos_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    d = adapters.daily_variance(spark, sf)
    f = forecasts.window_mean(d, 30).join(d.select("symbol", "day", "rv"), ["symbol", "day"])
    return tidy(forecasts.fingerprint(forecasts.oos_days(f)))


def empirical_tail(spark: SparkSession, sf: str) -> DataFrame:
    d = adapters.daily_variance(spark, sf)
    z = forecasts.window_mean(d, 30).join(d, ["symbol", "day"]).where("forecast > 0").withColumn("z", F.col("r") / F.sqrt("forecast"))
    return tidy(forecasts.empirical_tail(z, 0.05))


def step_join(spark: SparkSession, sf: str) -> DataFrame:
    """Parameters refreshed every 30 rows from row 60 on, joined to days by block."""
    d = adapters.daily_variance(spark, sf)
    at = forecasts.positioned(d)
    mean = at.withColumn("level", full_mean(F.col("rv"), trailing(["symbol"], "at", 60, 1), 60)).where((F.col("at") >= 60) & ((F.col("at") - 60) % 30 == 0))
    params = mean.select("symbol", F.floor((F.col("at") - 60) / 30).alias("block"), "level")
    return tidy(forecasts.blocks(d, 60, 30).join(params, ["symbol", "block"]).select("symbol", "day", "block", "level"))


def _feature_sql(expression: str) -> str:
    return sql(f"SELECT symbol, day, round({expression}, 6) AS value FROM valid WINDOW w AS (PARTITION BY symbol ORDER BY day)", "valid")


def _mean_sql(n: int) -> str:
    frame = f"(PARTITION BY symbol ORDER BY day ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return sql(f"SELECT symbol, day, round(CASE WHEN count(x) OVER w = {n} THEN avg(x) OVER w END, 6) AS value FROM dvar_cal WINDOW w AS {frame}", "dvar_cal")


HAR, HAR_ROWS = ("d", "w", "m"), "d IS NOT NULL AND w IS NOT NULL AND m IS NOT NULL"
WITH_INDEX = "(SELECT v.symbol, v.day, CASE WHEN rv > 0 THEN ln(rv) END AS d, ln(b.close) AS x FROM dvar v LEFT JOIN daily b ON b.symbol = v.symbol AND b.day = v.day - 1)"

QUERIES = {
    "candles_5m": (candles_5m, sql("SELECT symbol, CAST(epoch(ts) AS BIGINT) AS ts, day, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume, n FROM bars", "bars")),
    "daily_ohlc": (daily_ohlc, sql("SELECT symbol, day, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, n_bars FROM day_sums", "day_sums")),
    "daily_rv": (daily_rv, sql("SELECT symbol, day, round(rv, 6) AS rv, round(r, 6) AS r, n_bars, volume FROM rv", "rv")),
    "day_flags": (day_flags, sql(f"SELECT symbol, day, n_bars, volume, round(rv, 6) AS rv, dead, after_gap, incomplete, valid FROM ({FLAGS})", "rv_cal")),
    "day_flag_summary": (day_flag_summary, sql(f"""SELECT symbol, count(*) AS days, count(*) FILTER (valid) AS valid_days, count(*) FILTER (dead) AS dead_days,
        count(*) FILTER (after_gap) AS after_gap_days, count(*) FILTER (incomplete) AS incomplete_days, count(*) FILTER (n_bars = 0) AS empty_days,
        count(*) FILTER (valid AND after_gap) AS valid_after_gap FROM ({FLAGS}) GROUP BY ROLLUP (symbol)""", "rv_cal")),
    "volume_parity": (volume_parity, sql(f"""SELECT symbol, count(*) FILTER (dead AND v1 <> 0) AS dead_only_in_bars, count(*) FILTER (NOT dead AND v1 = 0) AS idle_only_in_daily,
        CAST(0 AS BIGINT) AS days_only_in_daily, count(*) FILTER (abs(volume - v1) > 1e-6 * v1) AS volume_differs
        FROM (SELECT *, volume * CASE WHEN dayofmonth(day) % 7 = 0 THEN 0 ELSE 1 END AS v1 FROM ({FLAGS}) WHERE n_bars > 0) GROUP BY symbol""", "rv_cal")),
    "quality_report": (quality_report, sql("""SELECT b.symbol, n_rows, first_ts, last_ts, empty_candles, inconsistent, CAST(0 AS BIGINT) AS duplicates, coalesce(n_gaps, 0) AS n_gaps,
        coalesce(missing_intervals, 0) AS missing_intervals, coalesce(largest_gap, 0.0) AS largest_gap, coalesce(n_jumps, 0) AS n_jumps
        FROM (SELECT symbol, count(*) AS n_rows, CAST(epoch(min(ts)) AS BIGINT) AS first_ts, CAST(epoch(max(ts)) AS BIGINT) AS last_ts, count(*) FILTER (volume = 0 OR high = low) AS empty_candles,
            count(*) FILTER (high < greatest(open, close) OR low > least(open, close) OR low <= 0) AS inconsistent FROM bars GROUP BY symbol) b
        LEFT JOIN (SELECT symbol, count(*) AS n_gaps, CAST(sum(round_even(g / 300, 0) - 1) AS BIGINT) AS missing_intervals, CAST(max(g) AS DOUBLE) AS largest_gap FROM (
            SELECT symbol, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY symbol ORDER BY ts)) AS g FROM bars) WHERE g > 300 GROUP BY symbol) g ON g.symbol = b.symbol
        LEFT JOIN (SELECT c.symbol, count(*) AS n_jumps FROM changes c JOIN (SELECT symbol, median(c) AS m FROM changes GROUP BY symbol) m ON m.symbol = c.symbol
            JOIN (SELECT c.symbol, median(abs(c - m)) * 1.4826 AS s FROM changes c JOIN (SELECT symbol, median(c) AS m FROM changes GROUP BY symbol) m ON m.symbol = c.symbol GROUP BY c.symbol) s ON s.symbol = c.symbol
            WHERE abs(c - m) > 5.0 * s GROUP BY c.symbol) j ON j.symbol = b.symbol""", "changes")),
    "gap_list": (gap_list, sql("""SELECT symbol, CAST(epoch(ts) AS BIGINT) AS ts, CAST(g AS DOUBLE) AS gap_seconds, CAST(round_even(g / 300, 0) - 1 AS BIGINT) AS missing FROM (
        SELECT symbol, ts, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY symbol ORDER BY ts)) AS g FROM bars) WHERE g > 300""", "bars")),
    "duplicate_report": (duplicate_report, "SELECT symbol, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT event_type AS symbol, date_trunc('minute', ts) AS m, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY symbol"),
    "jump_flags": (jump_flags, sql("""SELECT c.symbol, CAST(epoch(ts) AS BIGINT) AS ts, round(c, 6) AS change FROM changes c
        JOIN (SELECT symbol, median(c) AS m FROM changes GROUP BY symbol) m ON m.symbol = c.symbol
        JOIN (SELECT c.symbol, median(abs(c - m)) * 1.4826 AS s FROM changes c JOIN (SELECT symbol, median(c) AS m FROM changes GROUP BY symbol) m ON m.symbol = c.symbol GROUP BY c.symbol) s ON s.symbol = c.symbol
        WHERE s > 0 AND abs(c - m) > 5.0 * s""", "changes")),
    "index_report": (index_report, sql("""SELECT symbol, count(*) AS n_rows, count(*) - count(DISTINCT day) AS duplicates, CAST(max(day) - min(day) + 1 - count(DISTINCT day) AS BIGINT) AS missing_days,
        count(*) FILTER (least(open, high, low, close) <= 900 OR greatest(open, high, low, close) > 2000) AS out_of_range,
        count(*) FILTER (high < greatest(open, close) OR low > least(open, close)) AS inconsistent FROM daily GROUP BY symbol""", "daily")),
    "known_day": (known_day, sql("SELECT symbol, coalesce(bool_or(low < 1500 AND high > 1500) FILTER (day = DATE '1995-03-15'), false) AS ok FROM daily GROUP BY symbol", "daily")),
    "dead_tail": (dead_tail, sql("""SELECT symbol, count(*) FILTER (v = 0 AND (live IS NULL OR day > live)) AS tail_days, min(day) FILTER (v = 0 AND (live IS NULL OR day > live)) AS tail_start,
        count(*) FILTER (v = 0) AS idle_days FROM (SELECT symbol, day, v, max(CASE WHEN v > 0 THEN day END) OVER (PARTITION BY symbol) AS live FROM (
        SELECT symbol, day, CASE WHEN volume < 60 OR day >= DATE '2001-09-01' THEN 0.0 ELSE volume END AS v FROM daily)) GROUP BY symbol""", "daily")),
    "log_returns": (log_returns, sql("SELECT symbol, day, round(r, 6) AS r FROM sparse_ret", "sparse_ret")),
    "panel_common": (panel_common, sql("SELECT symbol, day, round(r, 6) AS r FROM sparse_ret WHERE day IN (SELECT day FROM sparse_ret GROUP BY day HAVING count(r) = 5)", "sparse_ret")),
    "panel_inventory": (panel_inventory, sql("""SELECT symbol, count(close) AS n_candles, min(day) FILTER (close IS NOT NULL) AS first_day, max(day) FILTER (close IS NOT NULL) AS last_day,
        count(*) - count(close) AS missing_days, count(r) AS valid_returns FROM (SELECT c.symbol, c.day, close, r FROM sparse_cal c JOIN sparse_ret r ON r.symbol = c.symbol AND r.day = c.day) GROUP BY symbol""", "sparse_ret")),
    "panel_cut_days": (panel_cut_days, sql("SELECT day, count(r) AS n_returns FROM sparse_ret WHERE day > (SELECT min(day) FROM sparse_ret) GROUP BY day HAVING count(r) < 5", "sparse_ret")),
    "panel_last_rows": (panel_last_rows, sql("""SELECT symbol, day, round(r, 6) AS r FROM sparse_ret WHERE day IN (SELECT day FROM sparse_ret GROUP BY day HAVING count(r) = 5 ORDER BY day DESC LIMIT 20)""", "sparse_ret")),
    "membership_months": (membership_months, sql("SELECT symbol, count(*) AS n_months FROM members WHERE month >= DATE '1995-01-01' GROUP BY symbol", "members")),
    "top_symbols": (top_symbols, sql("SELECT symbol, count(*) AS n_months FROM members GROUP BY symbol ORDER BY n_months DESC, symbol LIMIT 20", "members")),
    "eligible_symbols": (eligible_symbols, sql("""SELECT m.symbol, n_months, first_valid, last_valid, CAST(2222 AS BIGINT) AS period_days, valid_days, round(valid_days / 2222.0, 6) AS share FROM (
        SELECT symbol, count(DISTINCT date_trunc('month', day)) AS n_months FROM daily GROUP BY symbol) m JOIN (
        SELECT symbol, min(day) FILTER (n >= 2) AS first_valid, max(day) FILTER (n >= 2) AS last_valid, count(*) FILTER (n >= 2 AND day BETWEEN DATE '1995-06-01' AND DATE '2001-06-30') AS valid_days
        FROM daily GROUP BY symbol) a ON a.symbol = m.symbol WHERE n_months >= 12 AND first_valid <= DATE '1995-03-01' AND last_valid >= DATE '2001-06-30' AND valid_days / 2222.0 >= 0.5
        ORDER BY n_months DESC, m.symbol LIMIT 4""", "daily")),
    "feat_rv_day": (feature("rv_day", 2), sql("SELECT symbol, day, round(x, 6) AS value FROM dvar_cal", "dvar_cal")),
    "feat_rv_week": (feature("rv_week", 2), _mean_sql(7)),
    "feat_rv_month": (feature("rv_month", 2), _mean_sql(30)),
    "feat_range": (feature("day_range"), _feature_sql("CASE WHEN ln(high / low) > 0 THEN ln(ln(high / low)) END")),
    "feat_atr14": (feature("atr14"), sql("""SELECT symbol, day, round(CASE WHEN count(tr) OVER w = 14 THEN ln(avg(tr) OVER w / close) END, 6) AS value FROM (
        SELECT *, CASE WHEN b IS NOT NULL AND high IS NOT NULL THEN greatest(high - low, abs(high - b), abs(low - b)) END AS tr FROM (
        SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY day) AS b FROM valid)) WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)""", "valid")),
    "feat_ema20": (feature("ema20_distance"), sql("""SELECT symbol, day, round(CASE WHEN count(close) OVER w >= 20 THEN ln(close / (sum(close * power(19.0 / 21.0, -idx)) OVER w
        / sum(CASE WHEN close IS NOT NULL THEN power(19.0 / 21.0, -idx) END) OVER w)) END, 6) AS value FROM (
        SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day) - 1 AS idx FROM valid) WINDOW w AS (PARTITION BY symbol ORDER BY day)""", "valid")),
    "feat_bb20": (feature("bb20_width"), sql("""SELECT symbol, day, round(CASE WHEN count(close) OVER w = 20 AND stddev_samp(close) OVER w > 0
        THEN ln(4.0 * stddev_samp(close) OVER w / avg(close) OVER w) END, 6) AS value FROM valid WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""", "valid")),
    "feat_rsi14": (feature("rsi14"), sql("""SELECT symbol, day, round(CASE WHEN count(m) OVER w = 14 AND sum(abs(m)) OVER w > 0
        THEN (100.0 * sum(greatest(m, 0.0)) OVER w / sum(abs(m)) OVER w - 50.0) / 50.0 END, 6) AS value FROM (
        SELECT *, close - lag(close) OVER (PARTITION BY symbol ORDER BY day) AS m FROM valid) WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)""", "valid")),
    "feat_lagged_index": (feat_lagged_index, sql("SELECT s.symbol, s.day, round(b.close, 6) AS value FROM sparse s LEFT JOIN sparse b ON b.symbol = s.symbol AND b.day = s.day - 1", "sparse")),
    "feat_lagged_mean": (feat_lagged_mean, """WITH d AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS day, avg(value) AS x FROM events WHERE value <> 0 GROUP BY 1, 2), c AS (
        SELECT symbol, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d GROUP BY symbol)
        SELECT c.symbol, c.day, round(lag(x) OVER (PARTITION BY c.symbol ORDER BY c.day), 6) AS value FROM c LEFT JOIN d ON d.symbol = c.symbol AND d.day = c.day"""),
    "point_mass": (point_mass, """SELECT symbol, arg_min(v, k) AS mode, round(max(n) / sum(n), 6) AS share FROM (
        SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY n DESC, v) AS k FROM (
        SELECT l_returnflag AS symbol, l_quantity AS v, count(*) AS n FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY 1, 2)) GROUP BY symbol"""),
    "leakage_gate": (leakage_gate, "SELECT * FROM (VALUES ('rv_day', true, NULL), ('rv_week', true, NULL), ('peeking', false, 'scaled')) t(feature, passed, kind)"),
    "vol_window": (vol_window, sql("SELECT symbol, day, round(f, 6) AS forecast FROM f_window", "f_window")),
    "vol_ewma_com60": (vol_ewma_com60, sql("SELECT symbol, day, round(f, 6) AS forecast FROM f_com", "f_com")),
    "vol_lambda94": (vol_lambda94, sql("""SELECT symbol, day, round(CASE WHEN idx = 30 THEN seed WHEN idx > 30 THEN power(0.94, idx - 30) * seed + (1 - 0.94) * acc END, 6) AS forecast FROM (
        SELECT *, power(0.94, idx - 1) * sum(CASE WHEN idx >= 30 THEN r2 * power(0.94, -idx) END) OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS acc,
        avg(CASE WHEN idx < 30 THEN r2 END) OVER (PARTITION BY symbol) AS seed FROM (
        SELECT symbol, day, r * r AS r2, row_number() OVER (PARTITION BY symbol ORDER BY day) - 1 AS idx FROM dvar WHERE r IS NOT NULL))""", "dvar")),
    "har_features": (har_features, sql("""SELECT symbol, day, round(d, 6) AS d, round(CASE WHEN count(d) OVER a = 7 THEN avg(d) OVER a END, 6) AS w, round(CASE WHEN count(d) OVER b = 30 THEN avg(d) OVER b END, 6) AS m
        FROM (SELECT symbol, day, CASE WHEN rv > 0 THEN ln(rv) END AS d FROM dvar) WINDOW a AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
        b AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""", "dvar")),
    "har_forecast": (har_forecast, sql(f"SELECT symbol, day, round(forecast, 6) AS forecast FROM {har_sql('(SELECT symbol, day, CASE WHEN rv > 0 THEN ln(rv) END AS d, NULL AS x FROM dvar)', HAR, HAR_ROWS)}", "dvar")),
    "har_x_forecast": (har_x_forecast, sql(f"""SELECT symbol, day, round(a.forecast, 6) AS har, round(b.forecast, 6) AS har_x
        FROM {har_sql(WITH_INDEX, HAR, HAR_ROWS + ' AND x IS NOT NULL')} a JOIN {har_sql(WITH_INDEX, (*HAR, 'x'), HAR_ROWS + ' AND x IS NOT NULL')} b USING (symbol, day)""", "dvar")),
    "oos_fingerprint": (oos_fingerprint, sql("""SELECT symbol, count(*) AS n_days, substr(sha256(symbol || ':' || string_agg(strftime(day, '%Y-%m-%d'), ',' ORDER BY day)), 1, 16) AS fingerprint
        FROM f_window WHERE f IS NOT NULL AND rv IS NOT NULL GROUP BY symbol""", "f_window")),
    "empirical_tail": (empirical_tail, sql("""SELECT z.symbol, round(q, 6) AS q, round(avg(z) FILTER (z <= q), 6) AS es, round(any_value(qp), 6) AS q_pooled, round(any_value(ep), 6) AS es_pooled
        FROM z JOIN (SELECT symbol, quantile_cont(z, 0.05) AS q FROM z GROUP BY symbol) k ON k.symbol = z.symbol,
        (SELECT qp, avg(z) FILTER (z <= qp) AS ep FROM z, (SELECT quantile_cont(z, 0.05) AS qp FROM z) GROUP BY qp) GROUP BY z.symbol, q""", "f_window").replace(
        " SELECT z.symbol", ", z AS (SELECT symbol, r / sqrt(f) AS z FROM f_window WHERE f > 0 AND r IS NOT NULL) SELECT z.symbol", 1)),
    "step_join": (step_join, sql("""SELECT d.symbol, d.day, CAST(d.block AS BIGINT) AS block, round(p.level, 6) AS level FROM (
        SELECT symbol, day, floor((idx - 60) / 30) AS block FROM pos WHERE idx >= 60) d JOIN (
        SELECT symbol, floor((idx - 60) / 30) AS block, level FROM (SELECT *, CASE WHEN count(rv) OVER w = 60 THEN avg(rv) OVER w END AS level FROM pos
        WINDOW w AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)) WHERE idx >= 60 AND (idx - 60) % 30 = 0) p ON p.symbol = d.symbol AND p.block = d.block""", "pos")),
}
