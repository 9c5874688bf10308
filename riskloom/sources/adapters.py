"""Series of the risk domain built from the driver's tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BAR = "5 minutes"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """5-minute bars of events: (symbol, ts, day, open, high, low, close, volume, n)."""
    events = table(spark, sf_dir, "events").where("value > 0 and not isnan(value)")  # the first half reaches the scan
    order = F.struct("ts", "event_id")
    return (
        events.groupBy(F.col("event_type").alias("symbol"), F.window("ts", BAR).start.alias("bar"))
        .agg(
            F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
            F.max_by("value", order).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"), F.count(F.lit(1)).alias("n"),
        )
        .select("symbol", F.col("bar").cast("timestamp").alias("ts"), F.to_date("bar").alias("day"), "open", "high", "low", "close", "volume", "n")
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily OHLC of line items by return flag and status: (symbol, day, open, high, low, close, volume, n)."""
    items = table(spark, sf_dir, "lineitem").where("l_quantity > 0").withColumn("price", F.col("l_extendedprice") / F.col("l_quantity"))
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price")
    return items.groupBy(F.concat("l_returnflag", "l_linestatus").alias("symbol"), F.to_date("l_shipdate").alias("day")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", order).alias("close"), F.sum("l_quantity").alias("volume"), F.count(F.lit(1)).alias("n"),
    )


def daily_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily OHLC of orders by priority, with many missing days."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("day")).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"),
        F.max_by("o_totalprice", "o_orderkey").alias("close"), F.count(F.lit(1)).cast("double").alias("volume"), F.count(F.lit(1)).alias("n"),
    )


def daily_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, day, rv, r, n_bars): the variance that a day's range implies, and returns over observed days."""
    d = daily(spark, sf_dir)
    spread = F.ln(F.col("high") / F.col("low"))
    before = F.lag("close").over(Window.partitionBy("symbol").orderBy("day"))
    return d.select("symbol", "day", (spread * spread / (4 * math.log(2))).alias("rv"), (F.col("close") / before - 1).alias("r"), F.col("n").alias("n_bars"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trade per line item with its order: regime, kill switch, prices, size, pnl and equity before."""
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    joined = items.join(orders, items.l_orderkey == orders.o_orderkey).where("l_quantity > 0 and o_totalprice > 0")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    gross = F.col("l_extendedprice") * (F.col("l_tax") - F.lit(0.04))
    cost = F.col("l_extendedprice") * F.lit(0.002)
    return joined.select(
        F.col("l_returnflag").alias("regime"),
        ((F.col("l_linestatus") == "O") & (F.col("l_discount") == 0)).alias("kill"),
        price.alias("entry"), (price * (1 + F.col("l_tax") - 0.04)).alias("exit"), F.col("l_quantity").alias("size"),
        gross.alias("gross"), cost.alias("cost"), (gross - cost).alias("net"), F.col("o_totalprice").alias("equity"),
        F.when(F.col("l_discount") > 0.05, "timeout").otherwise("barrier").alias("reason"),
        F.to_date("l_shipdate").alias("day"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_tax", "l_discount",
    )


def members(spark: SparkSession, sf_dir: str, top: int = 20) -> DataFrame:
    """Membership months: each month's ``top`` customers by order value, as (month, symbol)."""
    orders = table(spark, sf_dir, "orders")
    totals = orders.groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("month"), F.col("o_custkey").alias("customer")).agg(F.sum("o_totalprice").alias("total"))
    order = Window.partitionBy("month").orderBy(F.desc(F.round("total", 2)), "customer")
    return totals.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("month", F.concat(F.lit("C"), F.col("customer").cast("string")).alias("symbol"))
