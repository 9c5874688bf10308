"""SimHash near-dedup by similarity: wide fingerprints, pivot tables, exact verification.

For links at a Jaccard similarity of SIMILARITY over sets of word shingles (not at a number of bits), 64 bits tell too
little. Here a text has WORDS * 64 bits, from its distinct shingles. As in :mod:`simhash`, candidates meet where the
coordinates of unit pivots agree, now for seeded choices of bits; there are as many choices as a pair at SIMILARITY needs
to meet with probability MEET, so recall does not fall as the corpus grows (the bits of a choice grow with its logarithm).
The bits of sets of up to FEW shingles scatter too much for that: those also meet by their smallest shingle hashes, of
which two similar sets always share one. Of what meets, pairs are discarded whose sets differ too much in size, whose
distances to reference fingerprints differ by more than LOOSE bits, or that differ by more than LOOSE bits (LOOSE_FEW for
sets of up to FEW shingles); all others are candidates.

Every link is verified by the exact similarity of the shingle sets, and only verified links join classes:

1. In each cell (a meeting place, or a part of a dense one) candidates of at most SURE bits give a forest, the others a
   minimum spanning forest between its trees. Each node of a component of sure candidates is verified against the
   component's smallest node, and one of the other candidates between each two components is verified.
2. What is still apart meets once more, with its class. Dense places are dealt over cells so that all pairs of members of
   different classes meet in one of them. Nodes that are candidates there, of another class and for the first time, send
   their sets to the cell once, which verifies pair after pair until its classes are joined. No pairs are emitted.

So a link is lost only if its pair never meets (at most 1 - MEET at SIMILARITY, less above) or is over LOOSE bits.
A family of n texts just below the similarity costs n * n comparisons, dealt over cells.

Defined results: null and wordless texts have fingerprint zero and are one class; fewer words than a shingle make one
shingle of them all; texts with equal fingerprints of all 256 bits are taken as one node; repeated rows share a class;
empty tables give empty results.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm import kernels, scratch
from riskloom.llm.components import components
from riskloom.llm.simhash import COMPARED, MEETING, SEED, cells_of, shingles, sorted_cells, with_places

SHINGLE = 5
SIMILARITY = 0.8
WORDS = 4
MEET = 0.995
SURE = 20
LOOSE = 56
#: Sets of up to FEW shingles, and the bits that may differ between two similar ones of them.
FEW = 32
LOOSE_FEW = 100
PIVOTS = 4
#: Members of a cell, and shingles of its sets, that a task holds at once.
DENSE = 2048
GRAMS = 1 << 22
#: Bytes of rows of cells that a task compares at once (whole cells).
CELLS = 1 << 25
#: Candidate pairs that a cell holds before it reduces them to a forest, or hands them on.
HELD = 1 << 20
SEEDS = [np.uint64(w * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for w in range(WORDS)]

_FIELDS = [f"f{w}" for w in range(WORDS)]
_NODE = ["uid", "n", *_FIELDS]


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct XXH64 hashes of a text's word shingles."""
    parts = [np.unique(part) for part in shingles(text, n)]
    return np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0] if parts else np.zeros(0, np.uint64)


def wide_fingerprint(hashes: np.ndarray) -> list[int]:
    """WORDS signed 64-bit integers: a bit is 1 where over half of the hashes have it."""
    out = []
    for word, seed in enumerate(SEEDS):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), COMPARED):
            h = hashes[at : at + COMPARED]
            h = kernels.mix(h + seed) if word else h
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0]) if len(hashes) else 0)
    return out


def prefix(hashes: np.ndarray) -> list[int] | None:
    """The smallest hashes of a small set: two sets of the similarity share one of theirs."""
    if not 0 < len(hashes) <= FEW / SIMILARITY:
        return None
    return hashes[: len(hashes) - math.ceil(SIMILARITY * len(hashes) - 1e-9) + 1].view(np.int64).tolist()


def choices(n: int) -> list[np.ndarray]:
    """Bit positions of each choice: enough bits for meeting places of about MEETING members, enough choices for MEET."""
    bits = max(8, math.ceil(math.log2(max(n, 1) / MEETING))) if n > MEETING else 8
    flip = math.acos(2 * SIMILARITY / (1 + SIMILARITY)) / math.pi
    count = math.ceil(math.log(1 - MEET) / math.log(1 - (1 - flip) ** bits))
    rng = np.random.default_rng(SEED)
    return [np.sort(rng.choice(64 * WORDS, bits, replace=False)) for _ in range(count)]


def reduce_candidates(root: np.ndarray, i: np.ndarray, j: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which candidates a minimum spanning forest over the trees of ``root`` keeps."""
    order = np.argsort(bits, kind="stable")
    a, b = root[i], root[j]
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    keep = []
    for k in order.tolist():
        x, y = find(int(a[k])), find(int(b[k]))
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep.append(k)
    return np.array(keep, np.int64)


def count(x: np.ndarray) -> np.ndarray:
    """Bits that are 1 in each row of words."""
    return np.bitwise_count(x).sum(axis=1, dtype=np.int16)


def pivot_table(fp: np.ndarray) -> list[np.ndarray]:
    """Distances to the reference fingerprints."""
    refs = np.random.default_rng(SEED).integers(0, 1 << 64, (PIVOTS, WORDS), dtype=np.uint64)
    return [count(fp ^ r) for r in refs]


class Candidates:
    """Which members of sorted cells are candidates, ``shift`` rows apart."""

    def __init__(self, cell: np.ndarray, fp: np.ndarray, n: np.ndarray):
        self.cell, self.fp, self.n, self.table = cell, fp, n, pivot_table(fp)
        self.least, self.few = np.ceil(SIMILARITY * n - 1e-9), n <= FEW

    def apart(self, of: np.ndarray):
        """(first rows, shift, bits) of candidates with different values of ``of``, which the caller may change meanwhile."""
        shift, alive = 1, np.arange(len(self.fp) - 1)
        while len(alive := alive[alive + shift < len(self.fp)]):
            alive = alive[self.cell[alive] == self.cell[alive + shift]]
            near = alive[of[alive] != of[alive + shift]]
            near = near[(self.n[near] >= self.least[near + shift]) & (self.n[near + shift] >= self.least[near])]
            limit = np.where(self.few[near] | self.few[near + shift], LOOSE_FEW, LOOSE)
            for coordinate in self.table:
                close = np.abs(coordinate[near] - coordinate[near + shift]) <= limit
                near, limit = near[close], limit[close]
            bits = count(self.fp[near] ^ self.fp[near + shift])
            yield near[bits <= limit], shift, bits[bits <= limit].astype(np.int64)
            shift += 1


def pairs_apart(cell: np.ndarray, fp: np.ndarray, n: np.ndarray, component: np.ndarray, choice: np.ndarray, chosen: list[np.ndarray]):
    """(i, j) arrays of all candidates of two components in each cell that no earlier choice brings together."""
    masks = np.zeros((len(chosen), WORDS), np.uint64)
    for k, bits in enumerate(chosen):
        np.bitwise_or.at(masks[k], bits // 64, np.uint64(1) << (bits % 64).astype(np.uint64))
    held, size = [], 0

    def first(i, j):
        apart, own, new = fp[i] ^ fp[j], choice[i], np.ones(len(i), bool)
        for k in range(int(own.max(initial=0))):
            new &= (own <= k) | ((apart & masks[k]) != 0).any(axis=1)
        return i[new], j[new]

    for near, shift, _ in Candidates(cell, fp, n).apart(component):
        held.append((near, near + shift))
        size += len(near)
        if size > HELD:
            yield first(*(np.concatenate(x) for x in zip(*held)))
            held, size = [], 0
    if size:
        yield first(*(np.concatenate(x) for x in zip(*held)))


def forests(cell: np.ndarray, fp: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, bits): forests of candidates within each run of equal ``cell``; ``fp`` has a row of WORDS words each, of sets
    of ``n`` shingles (without ``n``, of large sets of one size)."""
    n = np.full(len(fp), FEW + 1) if n is None else n
    root = np.arange(len(fp))
    sure: list[tuple[int, int, int]] = []
    held = [np.zeros(0, np.int64) for _ in range(3)]
    for near, shift, bits in Candidates(cell, fp, n).apart(root):
        certain = np.flatnonzero(bits <= SURE)
        for k in certain.tolist():
            a, b = i, j = int(near[k]), int(near[k]) + shift
            while root[a] != a:
                a = int(root[a])
            while root[b] != b:
                b = int(root[b])
            if a != b:
                root[max(a, b)] = min(a, b)
                sure.append((i, j, int(bits[k])))
        if len(certain):
            while not np.array_equal(jumped := root[root], root):
                root[:] = jumped
        held = [np.concatenate(x) for x in zip(held, (near, near + shift, bits))]
        if len(held[0]) > HELD:
            keep = reduce_candidates(root, *held)
            held = [x[keep] for x in held]
    keep = reduce_candidates(root, *held)
    done = np.array(sure, np.int64).reshape(-1, 3)
    return tuple(np.concatenate([done[:, k], held[k][keep]]) for k in range(3))


def fingerprints(texts: DataFrame, shingle: int) -> DataFrame:
    """(uid, file_no, id, n, f0.., prefix) of a numbered table with doc_id and text; ``n`` counts distinct shingles."""

    def run(batches):
        for batch in batches:
            rows, few = [], []
            for text in batch.column("text"):
                h = shingle_hashes(text.as_py(), shingle)
                rows.append([len(h), *wide_fingerprint(h)])
                few.append(prefix(h))
            numbers = np.array(rows, np.int64).reshape(-1, 1 + WORDS)
            columns = [*(batch.column(c) for c in ("uid", "file_no", "doc_id")), *(pa.array(numbers[:, k]) for k in range(1 + WORDS)), pa.array(few, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["uid", "file_no", "id", *_NODE[1:], "prefix"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    numbers = ", ".join(f"{f} long" for f in _NODE[1:])
    return texts.select("uid", "file_no", "doc_id", "text").mapInArrow(run, f"uid long, file_no int, id {kind}, {numbers}, prefix array<long>")


def place_of(words: list[np.ndarray], bits: np.ndarray) -> np.ndarray:
    """The chosen bits of each fingerprint as a number."""
    key = np.zeros(len(words[0]), np.uint64)
    for j, b in enumerate(bits.tolist()):
        key |= (words[b // 64] >> np.uint64(b % 64) & np.uint64(1)) << np.uint64(j)
    return key


def met(nodes: DataFrame, chosen: list[np.ndarray], extra: tuple[str, ...] = ()) -> DataFrame:
    """(choice, place, uid, n, f0.., extra) of nodes in each of their meeting places."""
    columns = [*_NODE, *extra]

    def place(batches):
        for batch in batches:
            words = [batch.column(f).to_numpy().view(np.uint64) for f in _FIELDS]
            for number, bits in enumerate(chosen):
                key = place_of(words, bits)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), number, np.int32)), pa.array(key.view(np.int64)), *(batch.column(c) for c in columns)], ["choice", "place", *columns])

    return nodes.select(*columns).mapInArrow(place, "choice int, place long, " + ", ".join(f"{c} long" for c in columns))


def placed(nodes: DataFrame, chosen: list[np.ndarray], extra: tuple[str, ...] = ()) -> DataFrame:
    """(choice, place, uid, n, f0.., extra) of nodes where they meet: by chosen bits, and small sets (choice -1) by their prefix."""
    few = nodes.where("prefix is not null").select(F.lit(-1).alias("choice"), F.explode("prefix").alias("place"), *_NODE, *extra)
    return met(nodes, chosen, extra).unionByName(few)


def dense_places(rows: DataFrame) -> DataFrame:
    """(choice, place, parts) of places with more than DENSE members or GRAMS shingles."""
    sizes = rows.groupBy("choice", "place").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s")).where((F.col("m") > DENSE) | (F.col("s") > GRAMS))
    return scratch.stage(sizes.select("choice", "place", _parts(F.col("m"), F.col("s")).alias("parts")), "near-dense")


def _parts(members: Column, grams: Column) -> Column:
    return F.greatest(F.ceil(members / DENSE), F.ceil(grams / GRAMS), F.lit(1)).cast("int")


def in_cells(rows: DataFrame, dense: DataFrame) -> DataFrame:
    """``rows`` with a number ``cell``: dense places fall into parts, other ones in each choice."""
    spread = with_places(rows, dense)
    return spread.withColumn("cell", F.pmod(F.xxhash64("uid", "choice"), F.coalesce("parts", F.lit(1)))).drop("parts")


def across_cells(rows: DataFrame, dense: DataFrame) -> DataFrame:
    """``rows`` with ``part`` and ``other``: members of dense places come once in each cell in which two parts meet.

    A dense place's largest component, which needs no comparison within itself, is dealt over parts of its own; only the
    other members, in parts of theirs, meet it and each other. Dense places of one component are left out.
    """
    by = ["choice", "place"]
    groups = with_places(rows, dense).where("parts is not null").groupBy(*by, "component").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s"))
    totals = groups.groupBy(*by).agg(F.max_by(F.struct("component", "m", "s"), F.struct("m", "component")).alias("top"), F.sum("m").alias("m"), F.sum("s").alias("s"))
    rest = F.when(F.col("m") > F.col("top.m"), _parts(F.col("m") - F.col("top.m"), F.col("s") - F.col("top.s"))).otherwise(0)
    mixed = scratch.stage(totals.select(*by, F.col("top.component").alias("main"), _parts(F.col("top.m"), F.col("top.s")).alias("mains"), rest.alias("others")), "near-mixed")
    in_main, hashed = F.col("component") == F.col("main"), F.xxhash64("uid")
    own = F.when(in_main, -1 - F.pmod(hashed, "mains")).otherwise(F.pmod(hashed, "others")).cast("int")
    meets = F.sequence(F.when(in_main, F.lit(0)).otherwise(-F.col("mains")), F.col("others") - 1, F.lit(1))
    both = F.when(F.col("main").isNull(), F.array(F.lit(0))).when(F.col("others") > 0, meets).otherwise(F.array().cast("array<int>"))
    each = with_places(rows, mixed).withColumn("own", F.coalesce(F.when(F.col("others") > 0, own), F.lit(0))).withColumn("with", F.explode(both))
    return each.withColumns({"part": F.least("own", "with"), "other": F.greatest("own", "with")}).drop("main", "mains", "others", "own", "with")


def words_of(table: pa.Table) -> np.ndarray:
    return np.column_stack([table.column(f).to_numpy().view(np.uint64) for f in _FIELDS])


def candidate_edges(rows: DataFrame) -> DataFrame:
    """(a, b, bits): forests of what meets in the cells of (choice, place, cell, uid, n, f0..) rows."""
    cell = ["choice", "place", "cell"]

    def connect(batches):
        for table, number in cells_of(batches, cell, CELLS):
            uid = table.column("uid").to_numpy()
            i, j, bits = forests(number, words_of(table), table.column("n").to_numpy())
            low, high = np.minimum(uid[i], uid[j]), np.maximum(uid[i], uid[j])
            yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), pa.array(bits.astype(np.int32))], ["a", "b", "bits"])

    return sorted_cells(rows.select(*cell, *_NODE), cell).mapInArrow(connect, "a long, b long, bits int").distinct()


def undecided(rows: DataFrame, chosen: list[np.ndarray]) -> DataFrame:
    """Rows of (choice, place, part, other, uid, n, f0.., component) that are a candidate, for the first time, with a row of
    another component in their cell."""
    cell = ["choice", "place", "part", "other"]
    columns = [*cell, *_NODE, "component"]

    def keep(batches):
        for table, number in cells_of(batches, cell, CELLS):
            needed = np.zeros(table.num_rows, bool)
            for i, j in pairs_apart(number, words_of(table), table.column("n").to_numpy(), table.column("component").to_numpy(), table.column("choice").to_numpy(), chosen):
                needed[i] = needed[j] = True
            yield from table.filter(pa.array(needed)).to_batches()

    kinds = ", ".join(f"{c} {'int' if c in ('choice', 'part', 'other') else 'long'}" for c in columns)
    return sorted_cells(rows.select(*columns), cell).mapInArrow(keep, kinds)


def shingle_sets(texts: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(uid, grams) of the wanted uids: texts are read where they lie, only the sets are shuffled."""
    files = texts.select("uid", "file_no").join(wanted.select("uid").distinct().hint("merge"), "uid")
    path = scratch.beside(files, "near-beside")

    def sets(batches):
        side = scratch.Beside(path)
        for file_no, batch in scratch.text_slices(batches, kernels.SLICE_BYTES):
            _, where = side.of(file_no, batch.column("uid").to_numpy())
            some = batch.filter(pa.array([high > low for low, high in where]))
            own = [shingle_hashes(x.as_py(), shingle).view(np.int64) for x in some.column("text")]
            yield pa.RecordBatch.from_arrays([some.column("uid"), pa.array(own, pa.list_(pa.int64()))], ["uid", "grams"])

    return scratch.stage(texts.select("uid", "file_no", "text").mapInArrow(sets, "uid long, grams array<long>"), "near-grams")


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sets, sorted as unsigned numbers, have the Jaccard similarity."""
    x, y = x.view(np.uint64), y.view(np.uint64)
    common = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum()) if len(x) else 0
    return common > 0 and common >= similarity * (len(x) + len(y) - common) - 1e-9


def verified(texts: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The (a, b) pairs of uids whose shingle sets have the similarity."""
    grams = shingle_sets(texts, pairs.select(F.col("a").alias("uid")).unionByName(pairs.select(F.col("b").alias("uid"))), shingle)
    left = pairs.join(grams.select(F.col("uid").alias("a"), F.col("grams").alias("x")).hint("merge"), "a")
    both = left.join(grams.select(F.col("uid").alias("b"), F.col("grams").alias("y")).hint("merge"), "b")

    def judge(batches):
        for batch in batches:
            keep = [similar(x.values.to_numpy(), y.values.to_numpy(), similarity) for x, y in zip(batch.column("x"), batch.column("y"))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(judge, "a long, b long")


def verified_in_cells(texts: DataFrame, rows: DataFrame, chosen: list[np.ndarray], shingle: int, similarity: float) -> DataFrame:
    """(a, b) components that a similar pair of :func:`undecided` rows links, a forest of them in each cell.

    The sets travel to the cells, once a cell, never once a pair; pairs of components that the cell has linked are passed.
    """
    cell = ["choice", "place", "part", "other"]
    grams = shingle_sets(texts, rows, shingle)
    met_again = sorted_cells(rows.join(grams.hint("merge"), "uid").select(*cell, *_NODE, "component", "grams"), cell)

    def judge(batches):
        for table, number in cells_of(batches, cell, CELLS):
            sets = table.column("grams").combine_chunks()
            where, values = sets.offsets.to_numpy(), sets.values.to_numpy()
            component = table.column("component").to_numpy()
            parent: dict[int, int] = {}

            def find(x, parent=parent):
                while (up := parent.get(x, x)) != x:
                    parent[x] = parent.get(up, up)
                    x = up
                return x

            out = []
            args = (number, words_of(table), table.column("n").to_numpy(), component, table.column("choice").to_numpy(), chosen)
            for i, j in pairs_apart(*args):
                for a, b in zip(i.tolist(), j.tolist()):
                    p, q = find(int(component[a])), find(int(component[b]))
                    if p != q and similar(values[where[a] : where[a + 1]], values[where[b] : where[b + 1]], similarity):
                        parent[max(p, q)] = min(p, q)
                        out.append((int(component[a]), int(component[b])))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return met_again.mapInArrow(judge, "a long, b long")


def classes(texts: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(uid, file_no, id, component) of each row of a numbered table with doc_id and text. Only that table stays."""
    with scratch.scope(texts.sparkSession) as scope:
        rows = scratch.stage(fingerprints(texts, shingle), "near-rows")
        firsts = rows.groupBy(*_FIELDS).agg(F.min_by(F.struct("uid", "n", "prefix"), "uid").alias("first"))
        nodes = scratch.stage(firsts.select("first.uid", "first.n", *_FIELDS, "first.prefix"), "near-nodes")
        chosen = choices(nodes.count())
        dense = dense_places(placed(nodes, chosen))
        edges = scratch.stage(candidate_edges(in_cells(placed(nodes, chosen), dense)), "near-edges")
        sure = components(edges.where(F.col("bits") <= SURE).select("a", "b"), in_place=True)
        side = lambda e: sure.select(F.col("node").alias(e), F.col("component").alias(f"c{e}")).hint("merge")
        loose = edges.where(F.col("bits") > SURE).join(side("a"), "a", "left").join(side("b"), "b", "left")
        loose = loose.withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")}).where("ca <> cb")
        one = loose.groupBy(F.least("ca", "cb").alias("l"), F.greatest("ca", "cb").alias("h")).agg(F.min_by(F.struct("a", "b"), F.struct("bits", "a", "b")).alias("e"))
        stars = sure.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
        pairs = scratch.stage(stars.unionByName(one.select("e.a", "e.b")), "near-pairs")
        member = components(scratch.stage(verified(texts, pairs, shingle, similarity), "near-verified"), in_place=True)
        named = nodes.join(member.withColumnRenamed("node", "uid").hint("merge"), "uid", "left").withColumn("component", F.coalesce("component", "uid"))
        named = scratch.stage(named, "near-named")
        left = undecided(across_cells(placed(named, chosen, ("component",)), dense), chosen)
        joined = components(scratch.stage(verified_in_cells(texts, scratch.stage(left, "near-undecided"), chosen, shingle, similarity), "near-joined"), in_place=True)
        final = named.join(joined.select(F.col("node").alias("component"), F.col("component").alias("whole")).hint("merge"), "component", "left")
        final = final.select(*_FIELDS, F.coalesce("whole", "component").alias("component"))
        return scope.result(rows.join(final.hint("merge"), _FIELDS).select("uid", "file_no", "id", "component"), "near-classes")


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class, that with the smallest doc_id (null is largest); all columns as they were."""
    whole = scratch.numbered(docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").alias("doc_id"), F.col("text").alias("text")), "near-docs")
    found = classes(whole, shingle, similarity)
    order = F.struct(F.col("id").isNull().alias("none"), "id", "uid")
    stays = scratch.stage(found.groupBy("component").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "near-stays")
    gone = found.join(stays.hint("merge"), "component").where(F.col("uid") != F.col("first.uid")).select("uid", "file_no")
    path = scratch.beside(gone, "near-gone")

    def run(batches):
        side = scratch.Beside(path)
        for file_no, batch in scratch.text_slices(batches, 64 << 20):
            _, where = side.of(file_no, batch.column("uid").to_numpy())
            yield batch.select(["doc"]).filter(pa.array([low == high for low, high in where]))

    return whole.mapInArrow(run, whole.select("doc").schema).select("doc.*")
