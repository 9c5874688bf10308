"""Volatility forecasts: window, exponentially weighted and heterogeneous autoregressive, each known the day before."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.columns import by, ew_mean, full_mean, positive, trailing


def positioned(df: DataFrame) -> DataFrame:
    """Adds ``at``: the row's number within its symbol, from 0."""
    return df.withColumn("at", (F.row_number().over(by(["symbol"], "day")) - 1).cast("long"))


def ewma_com(returns: DataFrame, com: float = 60.0, least: int = 30) -> DataFrame:
    """(symbol, day, forecast): adjusted EWMA of squared returns with that centre of mass, moved one row on."""
    d = positioned(returns.select("symbol", "day", "r")).withColumn("r2", F.col("r") * F.col("r"))
    d = ew_mean(d, ["symbol"], "at", "r2", com / (1 + com), least, "now")
    return d.select("symbol", "day", F.lag("now").over(by(["symbol"], "at")).alias("forecast"))


def window_mean(returns: DataFrame, n: int = 30) -> DataFrame:
    """(symbol, day, forecast): mean squared return of the n rows before."""
    d = positioned(returns.select("symbol", "day", "r")).withColumn("r2", F.col("r") * F.col("r"))
    return d.select("symbol", "day", full_mean(F.col("r2"), trailing(["symbol"], "at", n, 1), n).alias("forecast"))


SEED_ROWS = 30


def ewma_lambda(returns: DataFrame, lam: float = 0.94) -> DataFrame:
    """(symbol, day, forecast): the recursion v = lam v + (1 - lam) r2, seeded at row 30 by the mean of the first 30.

    In closed form: the adjusted mean of what follows the seed, weighed against the seed's remaining weight.
    """
    d = positioned(returns.select("symbol", "day", "r")).withColumn("r2", F.col("r") * F.col("r"))
    seed = d.where(F.col("at") < SEED_ROWS).groupBy("symbol").agg(F.avg("r2").alias("seed"), F.count("r2").alias("n"))
    d = d.withColumn("later", F.when(F.col("at") >= SEED_ROWS, F.col("r2")))
    d = ew_mean(d, ["symbol"], "at", "later", lam, 1, "mean").withColumn("past", F.lag("mean").over(by(["symbol"], "at")))
    old = F.pow(F.lit(lam), (F.col("at") - SEED_ROWS).cast("double"))
    value = F.when(F.col("at") == SEED_ROWS, F.col("seed")).when(F.col("at") > SEED_ROWS, old * F.col("seed") + (1 - old) * F.col("past"))
    return d.join(seed, "symbol").select("symbol", "day", F.when(F.col("n") == SEED_ROWS, value).alias("forecast"))


def har_features(rv: DataFrame) -> DataFrame:
    """(symbol, day, d, w, m): log RV and its means over 7 and 30 rows."""
    d = rv.select("symbol", "day", F.ln(positive(F.col("rv"))).alias("d"))
    return d.withColumns({"w": full_mean(F.col("d"), trailing(["symbol"], "day", 7), 7), "m": full_mean(F.col("d"), trailing(["symbol"], "day", 30), 30)})


def har_one(day, log_rv: np.ndarray, extra: np.ndarray, use_extra: bool, min_train: int = 365, every: int = 30) -> np.ndarray:
    """Walk-forward forecasts of one series from running cross-moments; row t + 1 holds what row t knows."""
    n = len(log_rv)
    x = np.column_stack([np.ones(n), log_rv, *[pd.Series(log_rv).rolling(k).mean() for k in (7, 30)]])
    full = np.column_stack([x, extra]) if extra.size else x
    used = full if use_extra else x
    target = np.append(log_rv[1:], np.nan)
    ok = np.isfinite(full).all(axis=1) & np.isfinite(target)
    out = np.full(n, np.nan)
    if not ok.any():
        return out
    shift = log_rv[np.isfinite(log_rv)][0]
    k = used.shape[1]
    moved = used.copy()
    moved[:, 1:4] -= shift
    z = np.where(ok[:, None], np.column_stack([moved, target - shift]), 0.0)
    moments = np.concatenate([np.zeros((1, k + 1, k + 1)), np.cumsum(z[:, :, None] * z[:, None, :], axis=0)])
    trained = np.concatenate([[0], np.cumsum(ok)])
    start = int(np.flatnonzero(ok)[0]) + min_train
    beta = None
    for t in range(start, n - 1):
        if beta is None or (t - start) % every == 0:
            if trained[t] < min_train // 2:
                continue
            a = moments[t]
            beta = np.linalg.lstsq(a[:k, :k], a[:k, k], rcond=None)[0]
            free = trained[t] - k
            rss = a[k, k] - 2 * beta @ a[:k, k] + beta @ a[:k, :k] @ beta
            mean = (a[0, k] - beta @ a[:k, 0]) / trained[t]
            s2 = (rss - trained[t] * mean * mean) / free if free > 0 else math.nan
        if np.isfinite(full[t]).all():
            out[t + 1] = math.exp(moved[t] @ beta + shift + s2 / 2)
    return out


def har(rv: DataFrame, extra: list[str] | None = None, use_extra: bool = True, min_train: int = 365, every: int = 30) -> DataFrame:
    """(symbol, day, forecast) of the log HAR; ``rv`` may hold more regressors, named in ``extra``.

    Without ``use_extra`` these only restrict the rows, so that both models see the same sample. A symbol's daily rows
    are one group: the state is a small matrix of running moments.
    """
    extra = extra or []
    columns = ["symbol", "day", "rv", *extra]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day")
        with np.errstate(divide="ignore", invalid="ignore"):
            log_rv = np.where(pdf["rv"].to_numpy(float) > 0, np.log(pdf["rv"].to_numpy(float)), np.nan)
        f = har_one(pdf["day"], log_rv, pdf[extra].to_numpy(float), use_extra, min_train, every)
        return pd.DataFrame({"symbol": pdf["symbol"], "day": pdf["day"], "forecast": f}).replace({np.nan: None})

    return rv.select(*columns).groupBy("symbol").applyInPandas(one, "symbol string, day date, forecast double")


def oos_days(forecasts: DataFrame) -> DataFrame:
    """Days with all values, found from the pattern of nulls alone; ``forecasts`` has (symbol, day, values...)."""
    values = [c for c in forecasts.columns if c not in ("symbol", "day")]
    return forecasts.dropna(subset=values).select("symbol", "day")


def fingerprint(days: DataFrame) -> DataFrame:
    """(symbol, n_days, fingerprint): first 16 hex digits of the SHA-256 of a symbol's days in order.

    A symbol's days are one list of some thousand dates at most.
    """
    text = F.concat(F.col("symbol"), F.lit(":"), F.array_join(F.array_sort(F.collect_list(F.date_format("day", "yyyy-MM-dd"))), ","))
    return days.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_days"), F.substring(F.sha2(text, 256), 1, 16).alias("fingerprint"))


def blocks(days: DataFrame, start: int, step: int) -> DataFrame:
    """Adds ``block`` = floor((at - start) / step) from row ``start`` on: parameters of a block are joined on it."""
    return positioned(days).where(F.col("at") >= start).withColumn("block", F.floor((F.col("at") - start) / step))


def empirical_tail(residuals: DataFrame, p: float) -> DataFrame:
    """(symbol, q, es, q_pooled, es_pooled): p-quantile of residuals z and the mean of those at or below it."""
    z = residuals.where("z is not null")
    own = z.groupBy("symbol").agg(F.percentile("z", F.lit(p)).alias("q"))
    es = z.join(own, "symbol").groupBy("symbol", "q").agg(F.avg(F.when(F.col("z") <= F.col("q"), F.col("z"))).alias("es"))
    q_pooled = z.agg(F.percentile("z", F.lit(p))).scalar()
    es_pooled = z.where(F.col("z") <= q_pooled).agg(F.avg("z")).scalar()
    return es.select("symbol", "q", "es", q_pooled.alias("q_pooled"), es_pooled.alias("es_pooled"))
