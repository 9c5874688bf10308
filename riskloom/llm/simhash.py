"""SimHash near-dedup with pivot distance tables.

A fingerprint bit is 1 where it is set in over half of the XXH64 hashes of a text's word shingles. Two fingerprints link
at MAX_BITS differing bits or fewer; classes are connected components of links.

Search: every distinct fingerprint has a table of Hamming distances to reference fingerprints. Two within D bits of each
other differ by at most D in every coordinate, and by nothing at all in the coordinates relative to unit pivots (which
are the bits themselves) of at least C of D + C disjoint bit blocks. So

1. candidates meet where the unit-pivot coordinates of C of D + C blocks agree, for each choice of C blocks (exact, by the
   pigeonhole principle; C grows with the logarithm of the number of fingerprints, so meeting places stay small);
2. pairs whose coordinates for any of PIVOTS random references differ by more than D are discarded;
3. survivors are verified by their Hamming distance.

A meeting place emits a spanning forest of its links, fewer edges than members, never its pairs. A dense place (a cluster
of many fingerprints that agree in those blocks) is dealt over cells of two parts each, so that no task holds it. Only
distinct fingerprints take part, so exact copies cost one row. Components are found over edges of fingerprints by star contraction.

Defined results: null and wordless texts have fingerprint zero and are linked like others; fewer words than a shingle
make one shingle of them all; repeated rows share a class; a null doc_id is never a class's id unless all are null;
empty tables give empty results; extra columns may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import scratch
from riskloom.llm.components import components

SHINGLE = 4
MAX_BITS = 4
SEED = 42
PIVOTS = 12
#: Mean members of a meeting place that the number of agreeing blocks aims at.
MEETING = 256
#: Members of a part of a dense meeting place, and bytes of rows of cells that a task compares at once (whole cells).
DENSE = 1 << 14
CELLS = 1 << 23
#: Rows of dense places that are broadcast at most.
BROADCAST_ROWS = 200_000
#: Bytes of a text whose shingles are hashed at once, and hashes whose bits are counted at once.
SEGMENT = 1 << 21
COMPARED = 1 << 18
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def hashes(words: list[bytes], n: int) -> np.ndarray:
    """XXH64 of each n consecutive words, joined by spaces."""
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - n + 1].tolist()
    hash_of = xxhash.xxh64_intdigest
    return np.array([hash_of(joined[a:b], SEED) for a, b in zip(starts, ends[n - 1 :].tolist())], np.uint64)


def shingles(text: str | None, n: int) -> Iterator[np.ndarray]:
    """Hashes of a text's n-word shingles in parts of about SEGMENT bytes, cut between words; fewer words make one shingle."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    held, at, found = [], 0, False
    while at < len(data):
        space = SPACE.search(data, at + SEGMENT)
        end = space.start() if space else len(data)
        held += data[at:end].split()
        at = end
        if len(held) >= n:
            yield hashes(held, n)
            held, found = held[len(held) - n + 1 :], True
    if held and not found:
        yield hashes(held, len(held))


def fingerprint(text: str | None, n: int) -> int:
    """The fingerprint as a signed 64-bit integer."""
    ones, size = np.zeros(64, np.int64), 0
    for part in shingles(text, n):
        size += len(part)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > size, bitorder="little").view(np.int64)[0]) if size else 0


def fingerprints(docs: DataFrame, keep: list[str], shingle: int = SHINGLE) -> DataFrame:
    """(row, fp) of each document."""
    row = F.struct(*keep).alias("row")

    def run(batches):
        for batch in batches:
            fp = [fingerprint(x.as_py(), shingle) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(fp, pa.int64())], ["row", "fp"])

    kind = docs.select(row).schema["row"].dataType.simpleString()
    return docs.select(row, F.col("text").alias("text")).mapInArrow(run, f"row {kind}, fp long")


def agreeing_blocks(n: int, max_bits: int) -> list[int]:
    """A mask for each choice of C of max_bits + C disjoint bit blocks."""
    c = 1
    while c < 64 - max_bits and n / 2 ** (64 * c / (max_bits + c)) > MEETING:
        c += 1
    edges = np.linspace(0, 64, max_bits + c + 1).round().astype(int).tolist()
    blocks = [sum(1 << i for i in range(a, b)) for a, b in zip(edges[:-1], edges[1:])]
    return [sum(chosen) for chosen in combinations(blocks, c)]


def references() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 64, PIVOTS, dtype=np.uint64)


def forest(place: np.ndarray, fp: np.ndarray, max_bits: int) -> np.ndarray:
    """Index pairs that connect, within each run of equal ``place``, all members that links connect."""
    table = [np.bitwise_count(fp ^ p).astype(np.int8) for p in references()]
    root = np.arange(len(fp))
    out: list[tuple[int, int]] = []
    shift, alive = 1, np.arange(len(fp) - 1)
    while len(alive := alive[alive + shift < len(fp)]):
        alive = alive[place[alive] == place[alive + shift]]
        near = alive[root[alive] != root[alive + shift]]
        for coordinate in table:
            near = near[np.abs(coordinate[near] - coordinate[near + shift]) <= max_bits]
        near = near[np.bitwise_count(fp[near] ^ fp[near + shift]) <= max_bits]
        if len(near):
            for i, j in zip(near.tolist(), (near + shift).tolist()):
                a, b = i, j
                while root[a] != a:
                    a = root[a]
                while root[b] != b:
                    b = root[b]
                if a != b:
                    root[max(a, b)] = min(a, b)
                    out.append((i, j))
            while not np.array_equal(jumped := root[root], root):
                root = jumped
        shift += 1
    return np.array(out, np.int64).reshape(-1, 2)


def with_places(rows: DataFrame, places: DataFrame) -> DataFrame:
    """Rows with what ``places``, a written table, has for their place: broadcast if it has BROADCAST_ROWS rows at most."""
    few = places.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(places) if few else places.hint("merge"), ["choice", "place"], "left")


def sorted_cells(rows: DataFrame, cell: list[str]) -> DataFrame:
    """Rows of each cell together, cells whole within a task."""
    return rows.repartition(*cell).sortWithinPartitions(*cell)


def cells_of(batches, cell: list[str], limit: int):
    """Tables of about ``limit`` bytes that hold cells whole, with the number of each row's cell."""
    held: list[pa.RecordBatch] = []

    def numbers(table):
        keys = [table.column(c).to_numpy() for c in cell]
        return np.cumsum(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])) if table.num_rows else np.zeros(0, np.int64)

    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) < limit:
            continue
        table = pa.Table.from_batches(held)
        number = numbers(table)
        whole = int(np.searchsorted(number, number[-1]))
        if whole:
            yield table.slice(0, whole), number[:whole]
        held = table.slice(whole).to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, numbers(table)


def in_pairs(placed: DataFrame) -> DataFrame:
    """``placed`` with ``part`` and ``other``: dense places fall into parts of about DENSE members by a hash, and each member
    comes once in each cell in which its part meets a part, so that every pair of a place is in one cell."""
    sizes = placed.groupBy("choice", "place").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > DENSE)
    dense = scratch.stage(sizes.select("choice", "place", F.ceil(F.col("members") / DENSE).cast("int").alias("parts")), "simhash-dense")
    parts = F.coalesce("parts", F.lit(1))
    each = with_places(placed, dense).withColumn("own", F.pmod(F.xxhash64("fp"), parts).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), parts - 1)))
    return each.select("fp", "choice", "place", F.least("own", "with").alias("part"), F.greatest("own", "with").alias("other"))


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b) edges of fingerprints that connect exactly what links connect; ``distinct`` has a column fp."""
    masks = agreeing_blocks(distinct.count(), max_bits)
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    meet = F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("place")) for i, m in enumerate(signed)]))
    placed = distinct.select("fp", meet.alias("m")).select("fp", "m.choice", "m.place")
    cell = ["choice", "place", "part", "other"]

    def run(batches):
        for table, number in cells_of(batches, cell, CELLS):
            fp = table.column("fp").to_numpy().view(np.uint64)
            pairs = forest(number, fp, max_bits)
            yield pa.RecordBatch.from_arrays([pa.array(fp[pairs[:, k]].view(np.int64)) for k in (0, 1)], ["a", "b"])

    return sorted_cells(in_pairs(placed), cell).mapInArrow(run, "a long, b long").distinct()


def classes(docs: DataFrame, keep: list[str], shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(row, fp, component_id) of each document; needs columns ``doc_id`` and ``text``."""
    named = docs.select(F.struct(*keep).alias("kept"), F.col("doc_id").alias("id"), F.col("text").alias("text"))
    rows = scratch.stage(fingerprints(named, ["kept", "id"], shingle), "simhash-rows")
    distinct = scratch.stage(rows.groupBy("fp").agg(F.min("row.id").alias("first_id")), "simhash-distinct")
    edges = scratch.stage(links(distinct.select("fp"), max_bits), "simhash-links")
    member = components(edges, in_place=True).select(F.col("node").alias("fp"), "component")
    placed = scratch.stage(distinct.join(member, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "simhash-members")
    smallest = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named_class = scratch.stage(placed.join(smallest, "component").select("fp", "component_id", "component"), "simhash-classes")
    return rows.join(named_class.hint("merge"), "fp").select("row.kept", F.col("row.id").alias("id"), "fp", "component_id", "component")


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classes(docs, ["doc_id"]).select("kept.doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")
