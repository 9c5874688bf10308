"""Trade and return statistics: effective sample size, hit rates, edges by regime, measurability."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.columns import chunked, positive, quantiles, safe_div

Z_95 = 1.959964
Z_POWER_80 = 0.841621
MAX_LAG = 50
LEAST_FOR_N_EFF = 10
LEAST_FOR_HIT_CI = 20


def real(trades: DataFrame) -> DataFrame:
    return trades.where(~F.coalesce("kill", F.lit(False)) & F.col("regime").isNotNull())


def trade_returns(trades: DataFrame) -> DataFrame:
    return real(trades).withColumn("ret", F.col("net") / F.col("equity"))


def t_stat(x: str) -> Column:
    return F.avg(x) / positive(F.stddev_samp(x) / F.sqrt(F.count(x)))


def effective_size(series: DataFrame, keys: list[str], order: list[str], x: str, max_lag: int = MAX_LAG) -> DataFrame:
    """(keys, n, n_eff): n / (1 + 2 sum of Pearson autocorrelations of lags 1..max_lag).

    Lags need order, and a regime may hold a third of all rows, so each key's rows are cut into chunks that overlap by
    max_lag rows. A chunk gives the moments of the pairs of every lag, around the key's mean; they are summed by lag.
    ``order`` starts with a column that splits a key well (a day). Lags without a correlation are left out; a sum that
    is not positive gives n.
    """
    d = series.where(F.col(x).isNotNull()).select(*keys, *order, F.col(x).cast("double").alias("x"))
    cut = chunked(d, keys, order, max_lag).join(d.groupBy(*keys).agg(F.avg("x").alias("_mean")), keys)
    part = cut.select(*keys, "_chunk", "_at", "_own", (F.col("x") - F.col("_mean")).alias("e"))
    names = ["n", "sx", "sy", "sxx", "syy", "sxy"]

    def moments(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at")
        e, own = pdf["e"].to_numpy(), pdf["_own"].to_numpy()
        rows = [(0, int(own.sum()), *[0.0] * 5)]
        for lag in range(1, min(max_lag, len(e) - 1) + 1):
            mine = own[lag:]
            a, b = e[lag:][mine], e[:-lag][mine]
            rows.append((lag, len(a), a.sum(), b.sum(), a @ a, b @ b, a @ b))
        out = pd.DataFrame(rows, columns=["lag", *names])
        return out.assign(**{k: pdf[k].iloc[0] for k in keys})[[*keys, "lag", *names]]

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in part.select(*keys).schema.fields)
    found = part.groupBy(*keys, "_chunk").applyInPandas(moments, f"{kinds}, lag int, n long, " + ", ".join(f"{c} double" for c in names[1:]))
    g = found.groupBy(*keys, "lag").agg(*[F.sum(c).alias(c) for c in names])
    spread = F.sqrt(positive(F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"))) * F.sqrt(positive(F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")))
    corr = F.when(F.col("lag") > 0, (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / spread)
    per_key = g.withColumn("corr", corr).groupBy(*keys).agg(F.max(F.when(F.col("lag") == 0, F.col("n"))).alias("n"), (1 + 2 * F.coalesce(F.sum("corr"), F.lit(0.0))).alias("den"))
    return per_key.select(*keys, "n", F.when(F.col("den") > 0, F.col("n") / F.col("den")).otherwise(F.col("n").cast("double")).alias("n_eff"))


def pnl_summary(series: DataFrame, keys: list[str], order: list[str], x: str, periods: int = 3 * 365, capital: float = 2.0, z: float = Z_95) -> DataFrame:
    """Mean, median, deviation, t with effective sample size in [1, n], interval, annualised values, total."""
    s = series.where(F.col(x).isNotNull())
    base = s.groupBy(*keys).agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.sum(x).alias("total"))
    base = base.join(quantiles(s, keys, x, {"median": 0.5}), keys)
    j = base.join(effective_size(s, keys, order, x), keys).where("n >= 2").withColumn("n_eff", F.greatest(F.lit(1.0), F.least("n_eff", F.col("n").cast("double"))))
    j = j.withColumns({"se": F.col("sd") / F.sqrt("n"), "se_neff": F.col("sd") / F.sqrt("n_eff")})
    low, high = F.col("mean") - z * F.col("se_neff"), F.col("mean") + z * F.col("se_neff")
    return j.select(
        *keys, "n", "mean", "median", "sd", "se", "n_eff", "se_neff", (F.col("mean") / positive(F.col("se"))).alias("t"),
        (F.col("mean") / positive(F.col("se_neff"))).alias("t_neff"), low.alias("ci_low"), high.alias("ci_high"),
        (F.col("mean") * periods).alias("annual_notional"), (F.col("mean") * periods / capital).alias("annual_capital"), "total",
    )


def pooled_by_regime(trades: DataFrame, order: list[str]) -> DataFrame:
    """(regime, n_trades, mean_return, std_return, sharpe, t_stat, n_eff, t_neff)."""
    r = trade_returns(trades)
    base = r.groupBy("regime").agg(F.avg("ret").alias("mean_return"), F.stddev_samp("ret").alias("std_return"), t_stat("ret").alias("t_stat"))
    j = base.join(effective_size(r, ["regime"], order, "ret"), "regime")
    n_eff = F.when((F.col("n") >= LEAST_FOR_N_EFF) & (F.col("n_eff") > 0), F.least("n_eff", F.col("n").cast("double")))
    return j.select(
        "regime", F.col("n").alias("n_trades"), "mean_return", "std_return", (F.col("mean_return") / positive(F.col("std_return"))).alias("sharpe"),
        "t_stat", n_eff.alias("n_eff"), (F.col("mean_return") / (positive(F.col("std_return")) / F.sqrt(n_eff))).alias("t_neff"),
    )


def break_even(cost: Column, barrier: Column) -> Column:
    return 0.5 * (1 + cost / positive(barrier))


def hit_rate(trades: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, n_trades, hit_rate, z_stat, ci_low, ci_high); no interval below LEAST_FOR_HIT_CI trades."""
    keys = keys or []
    g = real(trades).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_trades"), F.avg((F.col("gross") > 0).cast("double")).alias("hit_rate"))
    enough, p, n = F.col("n_trades") >= LEAST_FOR_HIT_CI, F.col("hit_rate"), F.col("n_trades")
    half = Z_95 * F.sqrt(p * (1 - p) / n)
    return g.select(*keys, "n_trades", "hit_rate", F.when(enough, (p - 0.5) / F.sqrt(0.25 / n)).alias("z_stat"), F.when(enough, p - half).alias("ci_low"), F.when(enough, p + half).alias("ci_high"))


def edge_by_regime(trades: DataFrame) -> DataFrame:
    """Hit rate, timeout split, barrier, cost, break-even hit rate and margin per regime."""
    win, late = (F.col("gross") > 0).cast("double"), F.col("reason") == "timeout"
    g = real(trades).groupBy("regime").agg(
        F.avg(late.cast("double")).alias("share_timeout"), F.avg(F.when(~late, win)).alias("hit_rate_barrier"), F.avg(F.when(late, win)).alias("hit_rate_timeout"),
        F.avg(safe_div(F.abs(F.col("exit") - F.col("entry")), F.col("entry"))).alias("barrier_pct"),
        F.avg(safe_div(F.col("cost"), F.col("size") * F.col("entry"))).alias("cost_pct"),
    )
    j = hit_rate(trades, ["regime"]).join(g, "regime").withColumn("break_even_p", break_even(F.col("cost_pct"), F.col("barrier_pct")))
    return j.withColumn("margin", F.col("hit_rate") - F.col("break_even_p"))


def trade_summary(trades: DataFrame, order: list[str]) -> DataFrame:
    """Net return per trade on entry notional of one regime's trades; two regimes have no common threshold and fail."""
    regimes = F.count_distinct("regime")
    checked = trades.agg(regimes.alias("r")).where((F.col("r") == 1) | F.raise_error(F.lit("one regime is needed")).cast("boolean"))
    n_regimes = checked.scalar()
    d = real(trades).withColumn("notional", F.when(F.col("size") * F.col("entry") != 0, F.col("size") * F.col("entry")))
    d = d.withColumns({k: F.col(v) / F.col("notional") for k, v in (("g", "gross"), ("r", "net"), ("c", "cost"))}).where(n_regimes == 1)
    win = F.col("g") > 0
    base = d.groupBy("regime").agg(
        F.avg("r").alias("r_mean"), F.stddev_samp("r").alias("r_std"), t_stat("r").alias("t"), F.avg(F.when(win, F.col("g"))).alias("w_mean"),
        F.avg(F.when(~win, -F.col("g"))).alias("l_mean"), F.avg("c").alias("cost"),
    )
    base = base.join(quantiles(d, ["regime"], "r", {"r_median": 0.5, "r_p5": 0.05, "r_p95": 0.95}), "regime", "left")
    j = base.join(effective_size(d, ["regime"], order, "r"), "regime").withColumn("n_eff", F.least("n_eff", F.col("n").cast("double")))
    return j.withColumns({
        "p_star": (F.col("l_mean") + F.col("cost")) / positive(F.col("w_mean") + F.col("l_mean")), "t_neff": F.col("t") * F.sqrt(F.col("n_eff") / F.col("n")),
    })


def observed_wald(hits: Column, n: Column, z: float = Z_95) -> tuple[Column, Column, Column]:
    """(half width, low, high) around an observed share; null without trades."""
    p = hits / positive(n)
    half = z * F.sqrt(p * (1 - p) / positive(n))
    return half, p - half, p + half


def wald_half_width(n: Column, z: float = Z_95) -> Column:
    return z * F.sqrt(0.25 / positive(n))


def min_detectable(break_even_p: Column, n: Column) -> Column:
    return break_even_p + wald_half_width(n)


def required_trades(p_true: float, p_null: float, z_alpha: float = Z_95, z_power: float = Z_POWER_80) -> float:
    """Trades that tell two hit rates apart; inf if they are equal, nan outside (0, 1)."""
    if not all(0 < p < 1 for p in (p_true, p_null)):
        return math.nan
    if p_true == p_null:
        return math.inf
    return (z_alpha * math.sqrt(p_null * (1 - p_null)) + z_power * math.sqrt(p_true * (1 - p_true))) ** 2 / (p_true - p_null) ** 2


def expected_trades(rows: Column, abstention: Column, admission: Column) -> Column:
    fits = (rows >= 0) & abstention.between(0, 1) & admission.between(0, 1)
    return F.when(fits, rows * (1 - abstention) * admission)


def measurability(df: DataFrame) -> DataFrame:
    """Adds p_detectable, band_width_pp, margin_pp, measurable, verdict to (assumed, break_even_p, n) rows."""
    n, inside = F.bround("n"), lambda c: (F.col(c) > 0) & (F.col(c) < 1)
    ok = F.coalesce(inside("assumed") & inside("break_even_p") & (F.col("n") >= 1), F.lit(False))
    need = F.when(ok, min_detectable(F.col("break_even_p"), n))
    yes = F.coalesce(F.col("assumed") > need, F.lit(False))
    return df.withColumns({
        "p_detectable": need, "band_width_pp": F.when(ok, 100 * wald_half_width(n)), "margin_pp": 100 * (F.col("assumed") - need), "measurable": yes,
        "verdict": F.when(~ok, "undefined").when(yes, "measurable").otherwise("not measurable"),
    })


def wilson(hits: Column, n: Column, z: float = Z_95) -> tuple[Column, Column]:
    """Wilson interval of a share."""
    p, z2 = hits / positive(n), z * z
    centre = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return centre - half, centre + half
