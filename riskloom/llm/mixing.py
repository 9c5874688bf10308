"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree. DataFrame functions only.

Targets: every source gets its weight's share of all words, but at most CAP times its own; the excess is shared again by
weight among the others until none is above (each round is one sum over the sources).

Blocks: a source's documents fall into blocks of about BLOCK_WORDS words by a seeded hash, so a hot source is many keys. A
source's quota is whole passes over all its blocks plus a last pass that takes blocks in permuted order; the block at the
quota is cut, and inside it the document at the quota, so that a source's words meet its target to a rounding.

Tree: each time that a block is taken is one unit of its source's quota. The root has all units; a node sends exactly half
of its units to its left child, those that come first in an order hashed from seed, node and unit. So a child's units per
source follow the multivariate hypergeometric law, and the leaves, shards of about SHARD_WORDS words, hold disjoint
permuted units of equal number. Which units come first is found from counts by buckets of the hash and an exact order in
the one bucket of a node where the half is reached: no node and no source is ever in one task. Rows get a hashed position
for a shuffle inside the shard.

Orders over all sources or over a source's blocks are range-partitioned sorts with running sums by partition
(:func:`running`), so there may be any number of sources and blocks. All randomness is hashed from a seed and the rows, so
reruns and recomputed partitions agree.

Defined results: null text has size 0; sizes of 0 are taken 0 times; null is a source of its own, last in order; empty
tables give empty results; repeated rows are drawn like others (of equal rows any may be the cut one: they are equal).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from riskloom.llm import scratch

WEIGHTS = (1, 2, 3)
CAP = 3
BLOCK_WORDS = 1 << 16
SHARD_WORDS = 1 << 22
SLICES = 8
#: Units in a bucket of a node's order that the number of buckets aims at, and the most buckets of a node.
BUCKET, MOST_BUCKETS = 1 << 10, 1 << 20
SEED = 20240611
#: Rows of a table of sources, blocks or units that is broadcast; a larger one meets documents in a sorted join.
BROADCAST_ROWS = 200_000

_SOURCE = ["no_src", "src"]


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space, tab, line feed, vertical tab, form feed and carriage return."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def sized(docs: DataFrame, keep: list[str], seed: int = SEED) -> DataFrame:
    """(row, size, source key, hash, order) of each document."""
    return docs.select(
        F.struct(*keep).alias("row"), word_count(F.col("text")).alias("size"),
        F.coalesce("source", F.lit("")).alias("src"), F.col("source").isNull().alias("no_src"),
        F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), F.col("text")).alias("hash"),
        F.xxhash64(F.lit(seed + 1), F.col("doc_id").cast("string"), F.col("text")).alias("order"),
    )


def meet(rows: DataFrame, table: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with a written table: broadcast, so that no row moves, if it has BROADCAST_ROWS rows at most."""
    return rows.join(F.broadcast(table) if table.count() <= BROADCAST_ROWS else table.hint("merge"), on, how)


def running(df: DataFrame, order: list, value: Column, name: str) -> DataFrame:
    """``df`` with ``rank`` (from 0) and ``before`` (the values of the rows before) in the given order of all rows."""
    placed = scratch.stage(df.orderBy(*order).withColumn("at", F.monotonically_increasing_id()), name)
    part = F.shiftright("at", 33)
    rows = placed.withColumns({"part": part, "inside": F.col("at") - F.shiftleft(part, 33), "value": value})
    parts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
    past = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row a partition
    offsets = scratch.stage(parts.select("part", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("n0"), F.coalesce(F.sum("v").over(past), F.lit(0)).alias("v0")), f"{name}-parts")
    here = F.coalesce(F.sum("value").over(W.partitionBy("part").orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = rows.withColumn("here", here).join(F.broadcast(offsets), "part")
    return out.withColumns({"rank": F.col("n0") + F.col("inside"), "before": F.col("v0") + F.col("here")}).drop("at", "part", "inside", "value", "n0", "v0", "here")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(src, no_src, source_size, weight, target) from (src, no_src, source_size), one row a source."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    weighed = scratch.stage(running(sources, _SOURCE, F.lit(0), "mix-ranks").select(*_SOURCE, "source_size", weight.alias("weight")), "mix-weights")
    total, rest, capped = None, None, -1
    level = 0.0
    while True:
        over = F.lit(level) * F.col("weight") > cap * F.col("source_size")
        got = weighed.agg(
            F.sum("source_size"), F.sum(F.when(over, F.col("source_size")).otherwise(0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))), F.count_if(over)
        ).first()
        total, held, rest, now = got[0] or 0, got[1] or 0, got[2] or 0.0, got[3]
        if now == capped or not rest:
            break
        level, capped = (total - cap * held) / rest, now
    goal = F.least(cap * F.col("source_size").cast("double"), F.lit(level) * F.col("weight")) if rest or not total else cap * F.col("source_size").cast("double")
    return weighed.withColumn("target", goal)


def with_blocks(rows: DataFrame, target: DataFrame) -> DataFrame:
    """Documents with the number ``block`` of their block: a source has one for each BLOCK_WORDS words."""
    sizes = target.select(*_SOURCE, F.greatest(F.lit(1), F.ceil(F.col("source_size") / BLOCK_WORDS)).cast("long").alias("blocks"))
    return meet(rows, sizes, _SOURCE).withColumn("block", F.pmod("hash", "blocks")).drop("blocks")


def draws(blocks: DataFrame, target: DataFrame, seed: int = SEED) -> DataFrame:
    """(src, no_src, block, pass, cut): each time that a block is taken; ``cut`` is the words left at the quota, else null."""
    usable = blocks.where("words > 0").withColumn("permuted", F.xxhash64(F.lit(seed + 2), *_SOURCE, "block"))
    placed = scratch.stage(running(usable, [*_SOURCE, "permuted", "block"], F.col("words"), "mix-permuted"), "mix-running")
    firsts = placed.groupBy(*_SOURCE).agg(F.min("before").alias("first"))
    quota = F.round("target").cast("long")
    of_source = scratch.stage(
        firsts.join(target.where("source_size > 0").hint("merge"), _SOURCE).withColumn("passes", F.floor(quota / F.col("source_size")))
        .select(*_SOURCE, "first", "passes", (quota - F.col("passes") * F.col("source_size")).alias("rest")),
        "mix-quotas",
    )
    ranked = meet(placed, of_source, _SOURCE).withColumn("before", F.col("before") - F.col("first"))
    taken = F.col("passes") + F.when(F.col("before") < F.col("rest"), 1).otherwise(0)
    each = ranked.where(taken > 0).withColumn("pass", F.explode(F.sequence(F.lit(1).cast("long"), taken)))
    last = (F.col("pass") > F.col("passes")) & (F.col("before") + F.col("words") > F.col("rest"))
    return each.select(*_SOURCE, "block", "pass", F.when(last, F.col("rest") - F.col("before")).alias("cut"))


def splitting_tree(units: DataFrame, levels: int, seed: int = SEED) -> DataFrame:
    """``units`` with the number ``shard`` of the leaf that holds each; (src, no_src, block, pass) name a unit.

    A node of n units has exactly n // 2 of them in its left child.
    """
    count = units.count()
    node = units.withColumn("node", F.lit(1).cast("long"))
    unit = [*_SOURCE, "block", "pass"]
    for level in range(levels):
        buckets = min(MOST_BUCKETS, 1 << max(0, math.ceil(math.log2(max(1, count / BUCKET))) - level))
        hashed = node.withColumn("hash", F.xxhash64(F.lit(seed), "node", *unit)).withColumn("bucket", F.pmod("hash", F.lit(buckets)))
        counts = hashed.groupBy("node", "bucket").agg(F.count(F.lit(1)).alias("n"))
        upto = W.partitionBy("node").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
        half = F.floor(F.sum("n").over(W.partitionBy("node")) / 2)
        sums = counts.withColumns({"upto": F.sum("n").over(upto), "half": half})
        reached = sums.where("upto > half and upto - n <= half").select("node", F.col("bucket").alias("edge"), (F.col("half") - F.col("upto") + F.col("n")).alias("lefts"))
        joined = meet(hashed, scratch.stage(reached, "mix-halves"), ["node"])
        clear = joined.where("bucket <> edge").withColumn("right", (F.col("bucket") > F.col("edge")).cast("long"))
        at_edge = joined.where("bucket = edge").withColumn("place", F.row_number().over(W.partitionBy("node").orderBy("hash", *unit)))
        sides = clear.unionByName(at_edge.withColumn("right", (F.col("place") > F.col("lefts")).cast("long")).drop("place"))
        node = scratch.stage(sides.withColumn("node", F.col("node") * 2 + F.col("right")).drop("hash", "bucket", "edge", "lefts", "right"), "mix-nodes")
    return node.withColumn("shard", F.col("node") - (1 << levels)).drop("node")


def prepare(docs: DataFrame, keep: list[str], levels: int | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sized documents with blocks, targets by source, units with their shards), from written tables."""
    rows = scratch.stage(sized(docs, keep, seed), "mix-rows")
    sources = rows.groupBy(*_SOURCE).agg(F.sum("size").alias("source_size"))
    target = scratch.stage(targets(sources), "mix-targets")
    blocked = with_blocks(rows, target)
    blocks = scratch.stage(blocked.groupBy(*_SOURCE, "block").agg(F.sum("size").alias("words")), "mix-blocks")
    if levels is None:
        words = target.agg(F.sum("target")).first()[0] or 0
        levels = max(0, math.ceil(math.log2(max(1, words / SHARD_WORDS))))
    return blocked, target, scratch.stage(splitting_tree(scratch.stage(draws(blocks, target, seed), "mix-draws"), levels, seed), "mix-units")


def in_cut_blocks(rows: DataFrame) -> Column:
    """Words that the cut leaves of each document of rows of cut blocks, in the block's hashed order."""
    inside = W.partitionBy(*_SOURCE, "block").orderBy("order", "size").rowsBetween(W.unboundedPreceding, 0)
    return F.least(F.col("size"), F.greatest(F.lit(0), F.col("cut") - F.sum("size").over(inside) + F.col("size"))).cast("long")


def with_words(rows: DataFrame, units: DataFrame) -> DataFrame:
    """Each document once per unit of its block, with the words that the unit takes of it (cut ones included)."""
    block = [*_SOURCE, "block"]
    whole = meet(rows, units.where("cut is null").drop("cut"), block).withColumn("words", F.col("size"))
    cut = meet(rows, units.where("cut is not null"), block)
    return whole.unionByName(cut.withColumn("words", in_cut_blocks(cut)).drop("cut"))


def mix(docs: DataFrame, levels: int | None = None, seed: int = SEED) -> DataFrame:
    """The mix: columns of ``docs`` (once per draw) and ``mix_shard, mix_position, mix_words``, shuffled inside each shard.

    Texts are shuffled once, to their shards, in SLICES runs of a shard's positions. Documents that a draw takes no word of
    are left out. A cut document keeps its whole text; ``mix_words`` says how much of it the mix takes. Result columns that
    ``docs`` has already get a trailing underscore.
    """
    named = docs.select(F.struct(*docs.columns).alias("doc"), *[F.col(c) for c in ("doc_id", "text", "source")])
    _, target, units = prepare(named, ["doc_id"], levels, seed)
    took = with_words(with_blocks(sized(named, ["doc"], seed), target), units).where("words > 0")
    free = lambda c: c + "_" if c in docs.columns else c
    position = F.xxhash64(F.lit(seed + 3), "shard", "pass", "order")
    out = took.select("row.doc.*", F.col("shard").alias(free("mix_shard")), position.alias(free("mix_position")), F.col("words").alias(free("mix_words")))
    slices = F.floor((F.shiftright(free("mix_position"), 32) + (1 << 31)) * SLICES / (1 << 32))
    return out.repartition(F.col(free("mix_shard")), slices).sortWithinPartitions(free("mix_shard"), free("mix_position"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the shards take of each document; ``n_shards`` of them, from ``first_shard`` on (null: none)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows, target, units = prepare(docs, ["doc_id"])
    block = [*_SOURCE, "block"]
    of_shard = units.groupBy(*block, "shard").agg(F.count_if(F.col("cut").isNull()).alias("copies"), F.max("cut").alias("cut"))
    per_block = of_shard.groupBy(*block).agg(F.sum("copies").alias("copies"), F.max("cut").alias("cut"), F.count(F.lit(1)).alias("n_shards"), F.min("shard").alias("first_shard"))
    found = meet(rows, scratch.stage(per_block, "mix-per-block"), block, "left")
    copies = F.col("size") * F.coalesce("copies", F.lit(0))
    uncut = found.where("cut is null").withColumn("taken", copies.cast("long"))
    cut = found.where("cut is not null")
    taken = uncut.unionByName(cut.withColumn("taken", copies + in_cut_blocks(cut)))
    out = meet(taken, target, _SOURCE)
    return out.select("row.doc_id", "size", "source_size", "target", "taken", F.coalesce("n_shards", F.lit(0)).cast("long").alias("n_shards"), "first_shard")
