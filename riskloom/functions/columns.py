"""Column builders shared by operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.window import WindowSpec


def by(keys: list[str], order: str | list[str]) -> WindowSpec:
    return W.partitionBy(*keys).orderBy(*([order] if isinstance(order, str) else order))


def trailing(keys: list[str], order: str, n: int, skip: int = 0) -> WindowSpec:
    """The n rows that end ``skip`` rows before this one."""
    return by(keys, order).rowsBetween(-(n - 1) - skip, -skip)


def full_mean(x: Column, window: WindowSpec, n: int) -> Column:
    """Mean over a window of n rows, null unless all of them have a value."""
    return F.when(F.count(x).over(window) == n, F.avg(x).over(window))


def full_sum(x: Column, window: WindowSpec, n: int) -> Column:
    return F.when(F.count(x).over(window) == n, F.sum(x).over(window))


def positive(x: Column) -> Column:
    """x where it is positive, else null: what a logarithm or a divisor may take."""
    return F.when(x > 0, x)


def safe_div(a: Column, b: Column) -> Column:
    return a / F.when(b != 0, b)


def nan_to_null(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """``df`` itself; evaluating it fails where the condition isn't true. Nothing is repaired."""
    return df.where(F.coalesce(condition, F.lit(False)) | F.raise_error(F.lit(message)).cast("boolean"))


def ew_mean(df: DataFrame, keys: list[str], index: str, x: str, decay: float, least: int, name: str) -> DataFrame:
    """Adds the adjusted exponentially weighted mean of ``x`` at each row: weights decay**(rows since), nulls only age.

    ``index`` is the row's integer position; positions without rows count as elapsed. Two running sums per block of
    positions, plus the sums of the block before: blocks are so long that what lies further back weighs less than
    exp(-300), so powers neither overflow nor lose digits, and no window spans a whole series.
    """
    length = max(1, int(300 / -math.log(decay)))
    position = F.col(index) % length
    weight = F.pow(F.lit(decay), -position.cast("double"))
    has = F.col(x).isNotNull()
    marked = df.withColumns({"_block": F.floor(F.col(index) / length), "_w": F.when(has, weight), "_wx": F.when(has, weight * F.col(x))})
    running = by([*keys, "_block"], index).rowsBetween(W.unboundedPreceding, 0)
    totals = marked.groupBy(*keys, (F.col("_block") + 1).alias("_block")).agg(
        *[(F.coalesce(F.sum(c), F.lit(0.0)) * decay**length).alias(c + "_before") for c in ("_w", "_wx")]
    )
    seen = F.sum(has.cast("long")).over(by(keys, index).rowsBetween(W.unboundedPreceding, 0))
    joined = marked.withColumn("_seen", seen).join(totals, [*keys, "_block"], "left")
    part = lambda c: F.coalesce(F.sum(c).over(running), F.lit(0.0)) + F.coalesce(F.col(c + "_before"), F.lit(0.0))
    return joined.withColumn(name, F.when(F.col("_seen") >= least, part("_wx") / positive(part("_w")))).drop(
        "_block", "_w", "_wx", "_w_before", "_wx_before", "_seen"
    )


def chunked(df: DataFrame, keys: list[str], order: list[str], halo: int, size: int = 50_000) -> DataFrame:
    """Adds ``_chunk``, ``_at`` and ``_own`` so that ordered windows over a hot key become many: each key's rows are
    numbered in order, cut into chunks, and each chunk also gets the ``halo`` rows before it (``_own`` false).

    Numbering is two-level: within (keys, first order column), then by running counts of those groups.
    """
    first = order[0]
    inside = df.withColumn("_in", F.row_number().over(by([*keys, first], order)) - 1)
    counts = df.groupBy(*keys, first).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn("_before", F.sum("_n").over(by(keys, first)) - F.col("_n")).drop("_n")
    at = inside.join(offsets, [*keys, first]).withColumn("_at", F.col("_in") + F.col("_before")).drop("_in", "_before")
    own = F.floor(F.col("_at") / size)
    next_too = F.when(F.col("_at") % size >= size - halo, F.array(own, own + 1)).otherwise(F.array(own))
    return at.withColumn("_chunk", F.explode(next_too)).withColumn("_own", F.col("_chunk") == own)


#: Accuracy of the approximate quantiles that bracket an exact one, the bracket's half width in shares of the rows, and
#: the rows up to which a bracket is the whole range (there, neighbours in rank are further apart than the half width).
QUANTILE_ACCURACY = 10_000
BRACKET = 0.001
WHOLE_RANGE = 10_000


def quantiles(df: DataFrame, keys: list[str], x: str, points: dict[str, float]) -> DataFrame:
    """(keys, one column per point): exact interpolated quantiles of the non-null ``x``, without a task that holds a key's rows.

    Approximate quantiles bracket each one; what lies below a bracket is counted, and only the distinct values inside it,
    some 0.2 % of the rows, are ranked. A bracket that missed its quantile would be an error, not another value.
    """
    d = df.where(F.col(x).isNotNull()).select(*keys, F.col(x).alias("_x"))
    edges = F.array(*[F.lit(min(1.0, max(0.0, p + side * BRACKET))) for p in points.values() for side in (-1, 1)])
    bounds = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_x", edges, QUANTILE_ACCURACY).alias("_edges"), F.min("_x").alias("_least"), F.max("_x").alias("_most"))
    few = F.col("_n") <= WHOLE_RANGE
    low, high = (lambda i: F.when(few, F.col("_least")).otherwise(F.col("_edges")[2 * i])), (lambda i: F.when(few, F.col("_most")).otherwise(F.col("_edges")[2 * i + 1]))
    # per point: values inside the bracket, one null for what lies below, nothing for what lies above
    spot = lambda i: F.when(F.col("_x") < low(i), F.struct(F.lit(i).alias("i"), F.lit(None).cast(kind).alias("v"))).when(
        F.col("_x") <= high(i), F.struct(F.lit(i).alias("i"), F.col("_x").alias("v"))
    )
    kind = dict(d.dtypes)["_x"]
    spots = d.join(bounds, keys).select(*keys, "_n", F.explode(F.array_compact(F.array(*[spot(i) for i in range(len(points))]))).alias("_s"))
    counts = spots.groupBy(*keys, "_n", F.col("_s.i").alias("_i"), F.col("_s.v").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    ranked = counts.withColumn("_to", F.sum("_c").over(W.partitionBy(*keys, "_n", "_i").orderBy(F.asc_nulls_first("_v")).rowsBetween(W.unboundedPreceding, 0)))
    out = []
    for i, (name, p) in enumerate(points.items()):
        at, own = (F.col("_n") - 1) * F.lit(p), F.col("_i") == i
        value = lambda rank, own=own: F.min(F.when(own & F.col("_v").isNotNull() & (F.col("_to") > rank), F.col("_v")))
        below, upto = F.coalesce(F.max(F.when(own & F.col("_v").isNull(), F.col("_to"))), F.lit(0)), F.max(F.when(own, F.col("_to")))
        first, second, share = value(F.floor(at)), value(F.ceil(at)), F.max(at - F.floor(at))
        held = F.coalesce((below <= F.max(F.floor(at))) & (upto > F.max(F.ceil(at))), F.lit(False))
        exact = F.when(share == 0, first).otherwise((1 - share) * first + share * second)
        out.append(F.when(held, exact).otherwise(F.raise_error(F.lit(f"the bracket of {name} missed it")).cast("double")).alias(name))
    return ranked.groupBy(*keys).agg(*out)
