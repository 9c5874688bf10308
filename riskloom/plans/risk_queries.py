"""Queries over losses, backtests, trades, rules, positions and evidence, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import special
from riskloom.operators import candles, controls, forecasts, losses, positions, sequential, thresholds, trades, var_es
from riskloom.plans.oracle import ess_sql, hac_sql, mixture_sql, normal_cdf_sql, sql
from riskloom.plans.tidy import tidy
from riskloom.sources import adapters

P = 0.05
Q, ES = special.tail_constants(P)
CONST = {"q": Q, "es": ES, "p": P}
ORDER = ["day", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_tax", "l_discount"]
ORDER_SQL = ", ".join(ORDER)
K = 6


def _losses(spark: SparkSession, sf: str) -> DataFrame:
    """Window (b) against exponentially weighted (a) forecasts of the daily variance."""
    d = adapters.daily_variance(spark, sf)
    a = forecasts.ewma_com(d).withColumnRenamed("forecast", "a")
    b = forecasts.window_mean(d, 30).withColumnRenamed("forecast", "b")
    return losses.compare_losses(d.join(a, ["symbol", "day"]).join(b, ["symbol", "day"]), "a", "b")


def _forecasts(spark: SparkSession, sf: str) -> DataFrame:
    """(symbol, day, r, sigma, q, es) of a normal forecast with 30-day variance."""
    d = adapters.daily_variance(spark, sf)
    f = forecasts.window_mean(d, 30).join(d, ["symbol", "day"]).where("forecast > 0 and r is not null")
    q, es = var_es.location_scale(F.sqrt("forecast"), P)
    return f.select("symbol", "day", "r", F.sqrt("forecast").alias("sigma"), q.alias("q"), es.alias("es"))


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    return var_es.with_hits(var_es.checked_forecasts(_forecasts(spark, sf)))


def _sums(spark: SparkSession, sf: str) -> DataFrame:
    return var_es.daily_sums(_forecasts(spark, sf), P)


def loss_qlike(spark, sf):
    return tidy(_losses(spark, sf).select("symbol", "day", "q_a", "q_b"))


def loss_mse_log(spark, sf):
    return tidy(_losses(spark, sf).select("symbol", "day", "m_a", "m_b"))


def hac_variance(spark, sf):
    return tidy(losses.hac(_losses(spark, sf).withColumn("d", F.col("q_a") - F.col("q_b")), ["symbol"], "day", "d"))


def dm_test(spark, sf):
    return tidy(losses.diebold_mariano(_losses(spark, sf), ["symbol"], "q_a", "q_b"), 5)


def dm_table(spark, sf):
    return tidy(losses.dm_table(_losses(spark, sf), "a", "b"), 5)


def loss_corr(spark, sf):
    return tidy(losses.correlations(_losses(spark, sf).withColumn("d", F.col("q_a") - F.col("q_b")), "d"))


def verdict_counts(spark, sf):
    return tidy(losses.verdict(losses.diebold_mariano(_losses(spark, sf), ["symbol"], "q_a", "q_b"), 0.8))


def var_hits(spark, sf):
    return tidy(_hits(spark, sf).select("symbol", "day", "hit"))


def kupiec(spark, sf):
    return tidy(var_es.kupiec(_hits(spark, sf), P))


def christoffersen_ind(spark, sf):
    return tidy(var_es.christoffersen_ind(_hits(spark, sf)))


def christoffersen_cc(spark, sf):
    return tidy(var_es.christoffersen_cc(_hits(spark, sf), P))


def backtest_p_values(spark, sf):
    return tidy(var_es.with_p_values(var_es.kupiec(_hits(spark, sf), P)))


def z2(spark, sf):
    return tidy(var_es.z2(_forecasts(spark, sf), P))


def location_scale_check(spark, sf):
    return tidy(var_es.is_location_scale(_forecasts(spark, sf), P))


def fz0(spark, sf):
    return tidy(losses.daily_losses(_forecasts(spark, sf).withColumn("weight", F.col("sigma")), P).select("day", "fz0"))


def pinball(spark, sf):
    return tidy(losses.daily_losses(_forecasts(spark, sf).withColumn("weight", F.col("sigma")), P).select("day", "pinball"))


def daily_hit_sums(spark, sf):
    return tidy(_sums(spark, sf))


def variance_ratio(spark, sf):
    return tidy(var_es.variance_ratio(_sums(spark, sf).where(F.col("k") == K), K, P))


def pooled_t(spark, sf):
    sums = _sums(spark, sf)
    a = var_es.mean_t(sums, F.col("s"), F.col("k") * P).withColumn("test", F.lit("coverage"))
    return tidy(a.unionByName(var_es.mean_t(sums, F.col("d"), F.lit(0.0)).withColumn("test", F.lit("shortfall"))))


def pooled_cluster_t(spark, sf):
    return tidy(var_es.cluster_t(_sums(spark, sf)))


def trade_returns(spark, sf):
    r = trades.trade_returns(adapters.trades(spark, sf))
    return tidy(r.select("regime", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "ret"))


def hit_rate(spark, sf):
    return tidy(trades.hit_rate(adapters.trades(spark, sf)))


def edge_by_regime(spark, sf):
    return tidy(trades.edge_by_regime(adapters.trades(spark, sf)))


def pooled_by_regime(spark, sf):
    return tidy(trades.pooled_by_regime(adapters.trades(spark, sf), ORDER), 5)


def trade_summary(spark, sf):
    return tidy(trades.trade_summary(adapters.trades(spark, sf).where("regime = 'A'"), ORDER), 5)


def ess(spark, sf):
    return tidy(trades.effective_size(trades.trade_returns(adapters.trades(spark, sf)), ["regime"], ORDER, "ret"), 3)


def pnl_summary(spark, sf):
    d = adapters.daily_variance(spark, sf).withColumn("month", F.date_trunc("month", "day").cast("date"))
    return tidy(trades.pnl_summary(d, ["symbol"], ["month", "day"], "r", 365, 1.0), 5)


def wald(spark, sf):
    g = trades.hit_rate(adapters.trades(spark, sf), ["regime"])
    half, low, high = trades.observed_wald(F.col("hit_rate") * F.col("n_trades"), F.col("n_trades"))
    lo, hi = trades.wilson(F.bround(F.col("hit_rate") * F.col("n_trades")), F.col("n_trades"))
    return tidy(g.select(
        "regime", "n_trades", half.alias("half"), low.alias("low"), high.alias("high"), lo.alias("wilson_low"), hi.alias("wilson_high"),
        trades.wald_half_width(F.col("n_trades")).alias("ex_ante"), trades.min_detectable(F.lit(0.52), F.col("n_trades")).alias("detectable"),
    ))


def measurability(spark, sf):
    parts = adapters.table(spark, sf, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("rows"), F.avg("p_size").alias("size"))
    n = trades.expected_trades(F.col("rows"), F.col("size") / 100, F.lit(0.9))
    d = parts.select("p_brand", n.alias("n"), (0.5 + F.col("size") / 250).alias("assumed"), F.lit(0.52).alias("break_even_p"))
    return tidy(trades.measurability(d))


def _registry(spark, sf):
    """A registry made of all customers, eight a day, with the mistakes that its rules find."""
    c = adapters.table(spark, sf, "customer").withColumn("k", F.col("c_custkey").cast("long"))
    day = F.date_format(F.date_add(F.lit("2022-01-01").cast("date"), (F.floor(F.col("k") / 8) - F.when(F.col("k") % 50 == 0, 9).otherwise(0)).cast("int")), "yyyy-MM-dd")
    bases, kinds = F.array(*map(F.lit, thresholds.BASES)), F.array(*map(F.lit, thresholds.KINDS))
    return c.select(
        F.col("k").alias("at"), F.when(F.col("k") % 97 == 0, F.lit("x")).otherwise(F.col("k").cast("string")).alias("nr"), day.alias("data"),
        F.when(F.col("k") % 31 == 0, F.lit(" ")).otherwise(F.lit("r")).alias("runda"),
        F.when(F.col("k") % 41 == 0, F.lit("2022_same")).otherwise(F.concat(day, F.lit("_"), F.col("k").cast("string"))).alias("katalog"),
        F.when(F.col("k") % 43 == 0, F.lit("?")).otherwise(bases[(F.col("k") % 5).cast("int")]).alias("baza"), kinds[(F.col("k") % 3).cast("int")].alias("rodzaj"),
        F.when(F.col("k") % 2 == 0, F.lit("tak")).otherwise(F.lit("nie")).alias("odczyt_programu"),
        F.when(F.col("k") % 61 == 0, F.lit("-1")).otherwise((F.col("k") % 4).cast("string")).alias("wariantow"), F.lit("u").alias("uwagi"),
    )


def registry_rules(spark, sf):
    return tidy(thresholds.registry_errors(_registry(spark, sf)))


def registry_counts(spark, sf):
    return tidy(thresholds.counted(_registry(spark, sf).where("wariantow <> '-1'")))


REGISTRY_SQL = """WITH b AS (SELECT c_custkey AS k, strftime(DATE '2022-01-01' + CAST(c_custkey // 8 - CASE WHEN c_custkey % 50 = 0 THEN 9 ELSE 0 END AS INTEGER), '%Y-%m-%d') AS data FROM customer),
    g AS (SELECT k AS pos, CASE WHEN k % 97 = 0 THEN 'x' ELSE CAST(k AS VARCHAR) END AS nr, data, CASE WHEN k % 31 = 0 THEN ' ' ELSE 'r' END AS runda,
        CASE WHEN k % 41 = 0 THEN '2022_same' ELSE data || '_' || k END AS katalog,
        CASE WHEN k % 43 = 0 THEN '?' ELSE ['krypto-2021-2026', 'tradfi-1990-2026', 'krypto-na-żywo', 'inna', 'stara-baza'][k % 5 + 1] END AS baza,
        ['werdykt', 'opis-z-wynikiem', 'bez-wyniku'][k % 3 + 1] AS rodzaj, CASE WHEN k % 2 = 0 THEN 'tak' ELSE 'nie' END AS odczyt,
        CASE WHEN k % 61 = 0 THEN '-1' ELSE CAST(k % 4 AS VARCHAR) END AS v FROM b),
    o AS (SELECT *, max(data) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, row_number() OVER (PARTITION BY katalog ORDER BY pos) AS seen FROM g) """


def trend_rule(spark, sf):
    return tidy(controls.trend_rule(candles.log_returns(adapters.daily(spark, sf)).where("r > -1"), K))


def cross_section_rule(spark, sf):
    return tidy(controls.cross_section_rule(candles.log_returns(adapters.daily(spark, sf)).where("r > -1"), K, leg=2))


def panel_moments(spark, sf):
    return tidy(controls.moments(candles.log_returns(adapters.daily(spark, sf)).where("r is not null")))


def acf(spark, sf):
    return tidy(controls.autocorrelation(candles.log_returns(adapters.daily(spark, sf)), ["symbol"], "day", "r"))


def target_leverage(spark, sf):
    f = _forecasts(spark, sf)
    lev = positions.final_leverage(F.col("sigma") / 10, 0.35, 3.0, -F.col("es") / 10, 0.05)
    d = f.select("symbol", "day", "sigma", lev.alias("leverage"))
    return tidy(d.select("symbol", "day", "leverage", positions.liquidation_move(F.col("leverage"), 0.005, "long").alias("move_long"), positions.distance(F.col("leverage"), 0.005, F.col("sigma"), "short", 4).alias("distance_short")))


def es_limit_scale(spark, sf):
    f = _forecasts(spark, sf).groupBy("symbol").agg(F.max_by(-F.col("es"), "day").alias("es"), F.lit(0.5).alias("weight"))
    return tidy(positions.scale_to_limit(f, 0.5))


def liquidation_touches(spark, sf):
    d = adapters.daily(spark, sf)
    return tidy(positions.touches(d, 3.0, 0.005, "long", 5).join(positions.touches(d, 3.0, 0.005, "short", 5).withColumnRenamed("touched", "touched_short"), ["symbol", "day", "at"]))


def touch_clusters(spark, sf):
    t = positions.touches(adapters.daily(spark, sf), 1.04, 0.005, "long", 3)
    return tidy(positions.clusters(t.where("touched")))


LEG = sequential.Leg("X", "r", 20.0, 15.0)
TAU = sequential.tuned_tau(LEG.daily_mu, LEG.daily_sigma)


def e_process(spark, sf):
    d = candles.log_returns(adapters.daily(spark, sf))
    path = sequential.refuting(d, "r", LEG).select("symbol", "day", "t", "s")
    return tidy(path)


def e_summary(spark, sf):
    d = candles.log_returns(adapters.daily(spark, sf))
    return tidy(sequential.summary(sequential.confirming(d, "r", LEG)))


def posterior(spark, sf):
    return tidy(sequential.posterior(candles.log_returns(adapters.daily(spark, sf)), "r", LEG.sigma, 0.0, LEG.mu))


HAC = hac_sql("losses", "q_a - q_b")
DM = f"(SELECT symbol, n, lag, mean AS mean_d, sqrt(long_run / n) AS se, mean / sqrt(long_run / n) AS t, n * variance / long_run AS n_eff FROM {HAC} WHERE n >= 3 AND long_run > 0)"
LL = "(CASE WHEN {x} = 0 THEN 0.0 ELSE {x} * ln({p}) END + CASE WHEN {n} - {x} = 0 THEN 0.0 ELSE ({n} - {x}) * ln(1.0 - {p}) END)"


def ll(x: str, n: str, p: str) -> str:
    return LL.replace("{x}", x).replace("{n}", n).replace("{p}", f"({p})")


X, M = "(n01 + n11)", "(n00 + n01 + n10 + n11)"
MARKOV = f"(CASE WHEN n01 + n00 = 0 THEN 0.0 ELSE {ll('n01', '(n01 + n00)', 'n01 / (n01 + n00)')} END + CASE WHEN n11 + n10 = 0 THEN 0.0 ELSE {ll('n11', '(n11 + n10)', 'n11 / (n11 + n10)')} END)"
FREE = f"(CASE WHEN {M} = 0 THEN NULL ELSE {ll(X, M, f'{X} / {M}')} END)"
EMPTY = "(least(n00 + n01, n10 + n11, n00 + n10, n01 + n11) = 0)"
ESS_RET = ess_sql("real", "ret", "regime", ORDER_SQL)
TRADE_T = "avg({x}) / (CASE WHEN stddev_samp({x}) > 0 THEN stddev_samp({x}) END / sqrt(count({x})))"
POS = "CASE WHEN {x} > 0 THEN {x} END"
A05 = "(l_tax - CAST(0.04 AS DOUBLE))"

QUERIES = {
    "loss_qlike": (loss_qlike, sql("SELECT symbol, day, round(q_a, 6) AS q_a, round(q_b, 6) AS q_b FROM losses", "losses")),
    "loss_mse_log": (loss_mse_log, sql("SELECT symbol, day, round(m_a, 6) AS m_a, round(m_b, 6) AS m_b FROM losses", "losses")),
    "hac_variance": (hac_variance, sql(f"SELECT symbol, n, CAST(lag AS BIGINT) AS lag, round(mean, 6) AS mean, round(variance, 6) AS variance, round(long_run, 6) AS long_run FROM {HAC}", "losses")),
    "dm_test": (dm_test, sql(f"SELECT symbol, n, CAST(lag AS BIGINT) AS lag, round(mean_d, 5) AS mean_d, round(se, 5) AS se, round(t, 5) AS t, round(n_eff, 5) AS n_eff FROM {DM}", "losses")),
    "dm_table": (dm_table, sql(f"""SELECT q.symbol, q.n, first_day, round(q.t, 5) AS t_qlike, round(q.mean_d / sd, 5) AS effect, round(m.t, 5) AS t_mse_log, round(scale, 5) AS scale FROM {DM} q
        JOIN (SELECT symbol, mean / sqrt(long_run / n) AS t FROM {hac_sql('losses', 'm_a - m_b')}) m ON m.symbol = q.symbol
        JOIN (SELECT symbol, stddev_samp(q_a - q_b) AS sd, avg(rv) / avg(fa) AS scale, min(day) AS first_day FROM losses GROUP BY symbol) s ON s.symbol = q.symbol""", "losses")),
    "loss_corr": (loss_corr, sql("""SELECT a.symbol AS a, b.symbol AS b, count(*) AS n, round(CASE WHEN count(*) >= 100 THEN corr(a.q_a - a.q_b, b.q_a - b.q_b) END, 6) AS corr
        FROM losses a JOIN losses b ON a.day = b.day AND a.symbol < b.symbol GROUP BY 1, 2""", "losses")),
    "verdict_counts": (verdict_counts, sql(f"""SELECT k, CAST(ceil(0.8 * k - 1e-12) AS BIGINT) AS need, good, bad, good >= ceil(0.8 * k - 1e-12) AND bad = 0 AS ok FROM (
        SELECT count(*) AS k, count(*) FILTER (t > 1.959964) AS good, count(*) FILTER (t < -1.959964) AS bad FROM {DM})""", "losses")),
    "var_hits": (var_hits, sql("SELECT symbol, day, hit FROM hits", "hits", **CONST)),
    "kupiec": (kupiec, sql(f"""SELECT symbol, x, n, round(x / n, 6) AS share, round(greatest(2 * ({ll('x', 'n', 'x / n')} - {ll('x', 'n', str(P))}), 0.0), 6) AS lr FROM (
        SELECT symbol, count(*) FILTER (hit) AS x, count(*) AS n FROM hits GROUP BY symbol)""", "hits", **CONST)),
    "christoffersen_ind": (christoffersen_ind, sql(f"""SELECT symbol, n00, n01, n10, n11, round(CASE WHEN NOT {EMPTY} THEN greatest(2 * ({MARKOV} - {FREE}), 0.0) END, 6) AS lr, {EMPTY} AS undefined FROM moves""", "moves", **CONST)),
    "christoffersen_cc": (christoffersen_cc, sql(f"""SELECT symbol, n, {M} AS n_uc, round(greatest(2 * ({FREE} - {ll(X, M, str(P))}), 0.0), 6) AS lr_uc, round(greatest(2 * ({MARKOV} - {FREE}), 0.0), 6) AS lr_ind,
        round(greatest(2 * ({MARKOV} - {ll(X, M, str(P))}), 0.0), 6) AS lr, round(exp(-greatest(2 * ({MARKOV} - {ll(X, M, str(P))}), 0.0) / 2), 6) AS p_value, {EMPTY} AS ind_undefined, false AS undefined FROM moves""", "moves", **CONST)),
    "backtest_p_values": (backtest_p_values, sql(f"""SELECT symbol, x, n, share, round(lr, 6) AS lr, round(greatest(2 * (1 - {normal_cdf_sql('root')}), 0.0), 6) AS p_value FROM (SELECT *, sqrt(lr) AS root FROM (
        SELECT symbol, x, n, round(x / n, 6) AS share, greatest(2 * ({ll('x', 'n', 'x / n')} - {ll('x', 'n', str(P))}), 0.0) AS lr FROM (SELECT symbol, count(*) FILTER (hit) AS x, count(*) AS n FROM hits GROUP BY symbol)))""", "hits", **CONST)),
    "z2": (z2, sql("SELECT symbol, count(*) AS n, round(1 - sum(CASE WHEN r < q THEN r / es ELSE 0.0 END) / (count(*) * {p}), 6) AS z2 FROM fc GROUP BY symbol", "fc", **CONST)),
    "location_scale_check": (location_scale_check, sql("SELECT symbol, bool_and(q / {q} > 0 AND abs(q / {q} - es / {es}) <= 1e-9 * abs(es / {es})) AS ok FROM fc GROUP BY symbol", "fc", **CONST)),
    "fz0": (fz0, sql("SELECT day, round(avg(-CASE WHEN r <= q THEN q - r ELSE 0.0 END / ({p} * es) + q / es + ln(-es) - 1.0), 6) AS fz0 FROM fc GROUP BY day", "fc", **CONST)),
    "pinball": (pinball, sql("SELECT day, round(avg(({p} - CASE WHEN r < q THEN 1.0 ELSE 0.0 END) * (r - q) / sigma), 6) AS pinball FROM fc GROUP BY day", "fc", **CONST)),
    "daily_hit_sums": (daily_hit_sums, sql("SELECT day, s, round(d, 6) AS d, k FROM sums", "sums", **CONST)),
    "variance_ratio": (variance_ratio, sql(f"SELECT n, round(vr, 6) AS vr, round((vr - 1) / {K - 1}, 6) AS rho FROM (SELECT count(*) AS n, var_samp(s) / ({K} * {P} * (1 - {P})) AS vr FROM sums WHERE k = {K})", "sums", **CONST)),
    "pooled_t": (pooled_t, sql("""SELECT n, round(t, 6) AS t, test FROM (SELECT count(*) AS n, avg(s - k * {p}) / (stddev_samp(s - k * {p}) / sqrt(count(*))) AS t, 'coverage' AS test FROM sums
        UNION ALL SELECT count(*), avg(d) / (stddev_samp(d) / sqrt(count(*))), 'shortfall' FROM sums)""", "sums", **CONST)),
    "pooled_cluster_t": (pooled_cluster_t, sql("""SELECT round(sum(pr) / sqrt(sum(pr * pr)), 6) AS t FROM (SELECT c * CASE WHEN count(c) OVER w = 10 THEN avg(c) OVER w END AS pr FROM (
        SELECT day, s - avg(s) OVER () AS c FROM sums) WINDOW w AS (ORDER BY day ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))""", "sums", **CONST)),
    "trade_returns": (trade_returns, sql("SELECT regime, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, round(ret, 6) AS ret FROM real", "real")),
    "hit_rate": (hit_rate, sql("""SELECT n_trades, round(p, 6) AS hit_rate, round((p - 0.5) / sqrt(0.25 / n_trades), 6) AS z_stat, round(p - 1.959964 * sqrt(p * (1 - p) / n_trades), 6) AS ci_low,
        round(p + 1.959964 * sqrt(p * (1 - p) / n_trades), 6) AS ci_high FROM (SELECT count(*) AS n_trades, avg(CASE WHEN gross > 0 THEN 1.0 ELSE 0.0 END) AS p FROM real)""", "real")),
    "edge_by_regime": (edge_by_regime, sql("""SELECT regime, n_trades, round(p, 6) AS hit_rate, round((p - 0.5) / sqrt(0.25 / n_trades), 6) AS z_stat, round(p - 1.959964 * sqrt(p * (1 - p) / n_trades), 6) AS ci_low,
        round(p + 1.959964 * sqrt(p * (1 - p) / n_trades), 6) AS ci_high, round(share_timeout, 6) AS share_timeout, round(hit_rate_barrier, 6) AS hit_rate_barrier, round(hit_rate_timeout, 6) AS hit_rate_timeout,
        round(b, 6) AS barrier_pct, round(c, 6) AS cost_pct, round(0.5 * (1 + c / b), 6) AS break_even_p, round(p - 0.5 * (1 + c / b), 6) AS margin FROM (
        SELECT regime, count(*) AS n_trades, avg(CASE WHEN gross > 0 THEN 1.0 ELSE 0.0 END) AS p, avg(CASE WHEN reason = 'timeout' THEN 1.0 ELSE 0.0 END) AS share_timeout,
        avg(CASE WHEN gross > 0 THEN 1.0 ELSE 0.0 END) FILTER (reason <> 'timeout') AS hit_rate_barrier, avg(CASE WHEN gross > 0 THEN 1.0 ELSE 0.0 END) FILTER (reason = 'timeout') AS hit_rate_timeout,
        avg(abs(exit - entry) / entry) AS b, avg(cost / notional) AS c FROM real GROUP BY regime)""", "real")),
    "pooled_by_regime": (pooled_by_regime, sql(f"""SELECT b.regime, n AS n_trades, round(mean_return, 5) AS mean_return, round(std_return, 5) AS std_return, round(mean_return / std_return, 5) AS sharpe, round(t_stat, 5) AS t_stat,
        round(least(n_eff, n), 5) AS n_eff, round(mean_return / (std_return / sqrt(least(n_eff, n))), 5) AS t_neff FROM (
        SELECT regime, avg(ret) AS mean_return, stddev_samp(ret) AS std_return, {TRADE_T.replace('{x}', 'ret')} AS t_stat FROM real GROUP BY regime) b JOIN {ESS_RET} e ON e.regime = b.regime""", "real")),
    "trade_summary": (trade_summary, sql(f"""SELECT b.regime, n, round(r_mean, 5) AS r_mean, round(r_median, 5) AS r_median, round(r_std, 5) AS r_std, round(r_p5, 5) AS r_p5, round(r_p95, 5) AS r_p95, round(t, 5) AS t,
        round(w_mean, 5) AS w_mean, round(l_mean, 5) AS l_mean, round(cost, 5) AS cost, round(least(n_eff, n), 5) AS n_eff, round((l_mean + cost) / (w_mean + l_mean), 5) AS p_star, round(t * sqrt(least(n_eff, n) / n), 5) AS t_neff FROM (
        SELECT regime, avg(net / notional) AS r_mean, median(net / notional) AS r_median, stddev_samp(net / notional) AS r_std, quantile_cont(net / notional, 0.05) AS r_p5, quantile_cont(net / notional, 0.95) AS r_p95,
        {TRADE_T.replace('{x}', 'net / notional')} AS t, avg(gross / notional) FILTER (gross / notional > 0) AS w_mean, avg(-gross / notional) FILTER (NOT gross / notional > 0) AS l_mean, avg(cost / notional) AS cost
        FROM real WHERE regime = 'A' GROUP BY regime) b JOIN {ess_sql("(SELECT * FROM real WHERE regime = 'A')", 'net / notional', 'regime', ORDER_SQL)} e ON e.regime = b.regime""", "real")),
    "ess": (ess, sql(f"SELECT regime, n, round(n_eff, 3) AS n_eff FROM {ESS_RET}", "real")),
    "pnl_summary": (pnl_summary, sql(f"""SELECT symbol, n, round(mean, 5) AS mean, round(median, 5) AS median, round(sd, 5) AS sd, round(sd / sqrt(n), 5) AS se, round(ne, 5) AS n_eff, round(sd / sqrt(ne), 5) AS se_neff,
        round(mean / (sd / sqrt(n)), 5) AS t, round(mean / (sd / sqrt(ne)), 5) AS t_neff, round(mean - 1.959964 * sd / sqrt(ne), 5) AS ci_low, round(mean + 1.959964 * sd / sqrt(ne), 5) AS ci_high,
        round(mean * 365, 5) AS annual_notional, round(mean * 365 / 1.0, 5) AS annual_capital, round(total, 5) AS total FROM (SELECT b.*, e.n, greatest(1.0, least(e.n_eff, e.n)) AS ne FROM (
        SELECT symbol, avg(r) AS mean, median(r) AS median, stddev_samp(r) AS sd, sum(r) AS total FROM dvar WHERE r IS NOT NULL GROUP BY symbol) b JOIN {ess_sql('dvar', 'r', 'symbol', 'day')} e ON e.symbol = b.symbol)""", "dvar")),
    "wald": (wald, sql("""SELECT regime, n AS n_trades, round(h, 6) AS half, round(p - h, 6) AS low, round(p + h, 6) AS high, round(c - w, 6) AS wilson_low, round(c + w, 6) AS wilson_high, round(1.959964 * sqrt(0.25 / n), 6) AS ex_ante,
        round(0.52 + 1.959964 * sqrt(0.25 / n), 6) AS detectable FROM (SELECT *, 1.959964 * sqrt(p * (1 - p) / n) AS h, (p + 1.959964 * 1.959964 / (2 * n)) / (1 + 1.959964 * 1.959964 / n) AS c,
        1.959964 * sqrt(p * (1 - p) / n + 1.959964 * 1.959964 / (4.0 * n * n)) / (1 + 1.959964 * 1.959964 / n) AS w FROM (SELECT regime, count(*) AS n, avg(CASE WHEN gross > 0 THEN 1.0 ELSE 0.0 END) AS p FROM real GROUP BY regime))""", "real")),
    "measurability": (measurability, """SELECT p_brand, round(n, 6) AS n, round(assumed, 6) AS assumed, CAST(0.52 AS DOUBLE) AS break_even_p, round(need, 6) AS p_detectable, round(100 * 1.959964 * sqrt(0.25 / round_even(n, 0)), 6) AS band_width_pp,
        round(100 * (assumed - need), 6) AS margin_pp, assumed > need AS measurable, CASE WHEN assumed > need THEN 'measurable' ELSE 'not measurable' END AS verdict FROM (
        SELECT *, 0.52 + 1.959964 * sqrt(0.25 / round_even(n, 0)) AS need FROM (SELECT p_brand, count(*) * (1 - avg(p_size) / 100) * 0.9 AS n, 0.5 + avg(p_size) / 250 AS assumed FROM part GROUP BY p_brand))"""),
    "registry_rules": (registry_rules, REGISTRY_SQL + """, x AS (SELECT pos AS at_, unnest(list_filter([CASE WHEN nr <> CAST(pos AS VARCHAR) THEN 'numbering' END, CASE WHEN data < before THEN 'date order' END,
        CASE WHEN NOT starts_with(katalog, data || '_') THEN 'folder prefix' END, CASE WHEN seen > 1 THEN 'duplicate folder' END, CASE WHEN trim(runda) = '' THEN 'empty round' END,
        CASE WHEN baza = '?' THEN 'unknown base' END, CASE WHEN odczyt = 'tak' AND rodzaj = 'bez-wyniku' THEN 'read without result' END, CASE WHEN v = '-1' THEN 'variants not a number' END,
        CASE WHEN baza IN ('krypto-2021-2026', 'stara-baza') AND CAST(v AS INTEGER) > 0 AND odczyt = 'nie' THEN 'variants unread' END], lambda e: e IS NOT NULL)) AS error FROM o) SELECT at_ AS "at", error FROM x"""),
    "registry_counts": (registry_counts, REGISTRY_SQL + "SELECT CAST(sum(greatest(CAST(v AS INTEGER), 1)) AS BIGINT) AS n_program, CAST(sum(CAST(v AS INTEGER)) AS BIGINT) AS n_variants FROM o WHERE odczyt = 'tak' AND v <> '-1'"),
    "trend_rule": (trend_rule, sql(f"""SELECT day, round(sum(p * r) / {K}, 6) AS pnl FROM (SELECT *, lag(sign(g)) OVER (PARTITION BY symbol ORDER BY day) AS p FROM (
        SELECT *, CASE WHEN count(r) OVER w = 7 THEN sum(ln(1 + r)) OVER w END AS g FROM ret WHERE r > -1 WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)))
        GROUP BY day HAVING count(p * r) = {K}""", "ret")),
    "cross_section_rule": (cross_section_rule, sql(f"""SELECT day, round(sum(h * r), 6) AS pnl FROM (SELECT *, lag(w) OVER (PARTITION BY symbol ORDER BY day) AS h FROM (
        SELECT *, CASE WHEN g IS NOT NULL THEN CASE WHEN k > {K - 2} THEN 0.25 ELSE 0.0 END - CASE WHEN k <= 2 THEN 0.25 ELSE 0.0 END END AS w FROM (
        SELECT *, row_number() OVER (PARTITION BY day, g IS NULL ORDER BY g, symbol) AS k FROM (
        SELECT *, CASE WHEN count(r) OVER w = 7 THEN sum(ln(1 + r)) OVER w END AS g FROM ret WHERE r > -1 WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)))))
        GROUP BY day HAVING count(h * r) >= {K}""", "ret")),
    "panel_moments": (panel_moments, sql("""SELECT b.symbol, round(vol, 6) AS vol, round(k, 6) AS excess_kurtosis, round(acf_r2, 6) AS acf_r2 FROM (SELECT symbol, stddev_pop(r) AS vol, kurtosis_pop(r) AS k FROM ret WHERE r IS NOT NULL GROUP BY symbol) b
        JOIN (SELECT symbol, sum(e * l) / sum(e * e) AS acf_r2 FROM (SELECT *, lag(e) OVER (PARTITION BY symbol ORDER BY day) AS l FROM (SELECT symbol, day, c2 - avg(c2) OVER (PARTITION BY symbol) AS e FROM (
        SELECT symbol, day, power(r - avg(r) OVER (PARTITION BY symbol), 2) AS c2 FROM ret WHERE r IS NOT NULL))) GROUP BY symbol) a ON a.symbol = b.symbol""", "ret")),
    "acf": (acf, sql("""SELECT symbol, round(sum(e * l) / sum(e * e), 6) AS acf FROM (SELECT *, lag(e) OVER (PARTITION BY symbol ORDER BY day) AS l FROM (
        SELECT symbol, day, r - avg(r) OVER (PARTITION BY symbol) AS e FROM ret WHERE r IS NOT NULL)) GROUP BY symbol""", "ret")),
    "target_leverage": (target_leverage, sql("""SELECT symbol, day, round(l, 6) AS leverage, round(ln(1 - (1.0 / l - 0.005)), 6) AS move_long, round(abs(ln(1 + (1.0 / l - 0.005))) / (sigma * sqrt(4)), 6) AS distance_short FROM (
        SELECT *, least(least(0.35 / (sigma / 10 * sqrt(365)), 3.0), 0.05 / (-es / 10)) AS l FROM fc) WHERE 1.0 / l - 0.005 < 1
        UNION ALL SELECT symbol, day, round(l, 6), CAST('-infinity' AS DOUBLE), round(abs(ln(1 + (1.0 / l - 0.005))) / (sigma * sqrt(4)), 6) FROM (
        SELECT *, least(least(0.35 / (sigma / 10 * sqrt(365)), 3.0), 0.05 / (-es / 10)) AS l FROM fc) WHERE 1.0 / l - 0.005 >= 1""", "fc", **CONST)),
    "es_limit_scale": (es_limit_scale, sql("""SELECT symbol, round(0.5 * s, 6) AS weight, round(s, 6) AS scale FROM (SELECT symbol, CASE WHEN sum(0.5 * es) OVER () <= 0.5 THEN 1.0 ELSE 0.5 / sum(0.5 * es) OVER () END AS s
        FROM (SELECT symbol, arg_max(-es, day) AS es FROM fc GROUP BY symbol))""", "fc", **CONST)),
    "liquidation_touches": (liquidation_touches, sql("""SELECT symbol, day, k AS "at", touched, touched_short FROM (SELECT symbol, day, row_number() OVER (PARTITION BY symbol ORDER BY day) - 1 AS k,
        min(low) OVER w <= close * (1 - (1 / 3.0 - 0.005)) AS touched, max(high) OVER w >= close * (1 + (1 / 3.0 - 0.005)) AS touched_short, count(*) OVER w AS c FROM daily
        WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)) WHERE c = 5""", "daily")),
    "touch_clusters": (touch_clusters, sql("""SELECT symbol, count(*) FILTER (b IS NULL OR day - b > 7) AS n_clusters FROM (SELECT symbol, day, lag(day) OVER (PARTITION BY symbol ORDER BY day) AS b FROM (
        SELECT symbol, day, min(low) OVER w <= close * (1 - (1 / 1.04 - 0.005)) AS touched, count(*) OVER w AS c FROM daily
        WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)) WHERE c = 3 AND touched) GROUP BY symbol""", "daily")),
    "e_process": (e_process, sql(f"""SELECT symbol, day, count(*) OVER w AS t, round(sum(r - {LEG.daily_mu!r}) OVER w, 6) AS s FROM ret WHERE r IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY day)""", "ret")),
    "e_summary": (e_summary, sql(f"""SELECT symbol, count(*) AS n, round(arg_max(e, t), 6) AS last_e, round(max(e), 6) AS max_e FROM (
        SELECT symbol, t, 2 / ({TAU!r} * sqrt(a)) * {mixture_sql('x')} AS e FROM (SELECT *, s / sqrt(a) AS x FROM (
        SELECT symbol, count(*) OVER w AS t, sum(r) OVER w AS s, count(*) OVER w * {LEG.daily_sigma**2!r} + {TAU**-2!r} AS a FROM ret WHERE r IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY day))))
        GROUP BY symbol""", "ret")),
    "posterior": (posterior, sql(f"""SELECT symbol, n, round(m, 6) AS mean, round(s, 6) AS sd, round(m - 1.959964 * s, 6) AS ci_low, round(m + 1.959964 * s, 6) AS ci_high, round({normal_cdf_sql('z')}, 6) AS p_positive FROM (SELECT *, m / s AS z FROM (
        SELECT symbol, n, x * 365 * n / (365 * {LEG.sigma!r} * {LEG.sigma!r}) / pr AS m, sqrt(1 / pr) AS s FROM (SELECT symbol, count(r) AS n, avg(r) AS x, 1 / ({LEG.mu!r} * {LEG.mu!r}) + count(r) / (365 * {LEG.sigma!r} * {LEG.sigma!r}) AS pr FROM ret GROUP BY symbol)))""", "ret")),
}

