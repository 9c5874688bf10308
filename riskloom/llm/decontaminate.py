"""Benchmark decontamination by winnowing.

For a window of n words, k = min(7, n) and w = n - k + 1, so that w consecutive k-grams are exactly one window. Each
window of a benchmark item and of a document keeps its minimum k-gram hash; equal windows keep equal minima, so joining
the kept fingerprints loses no shared window. Hits are extended to whole windows, compared by 64-bit hash and then byte
by byte. Items of at least 13 words have windows of 13; a shorter item is one window of its own length.

A benchmark of at most BLOCK_WORDS words is indexed once and its index, about 50 bytes a word, is broadcast: one pass over
the documents, none of which is shuffled. A larger one stays a table of windows. The tasks that read the documents then
send the distinct fingerprints of their file, those that a bitmap of BITMAP_BITS bits lets through, with the hash of the
window around each; a join with the table (plain exchanges, which adaptive execution can split) gives each file the windows
that occur in it, and a second pass over the documents looks them up beside the file, by the same code.

Defined results: null or wordless texts have n_words 0 and no hits; items without words never match; repeated items
count once by item_id; an item_id that is null marks words but is not listed; repeated document rows each get a row;
empty tables give empty or unmatched results. Extra columns of documents are ignored unless named in ``keep``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import kernels, scratch

WINDOW = 13
GRAM = 7
BLOCK_WORDS = 1_000_000
BITMAP_BITS = 22
#: Words of documents whose windows are looked up at once.
STEP = 1 << 19

RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


class Index:
    """The windows of texts by length: sorted hashes, and where each stands in the texts. ``items`` has (names, text) pairs."""

    def __init__(self, items: list[tuple[frozenset[str], str | None]]):
        data, offsets = kernels.text_buffer(pa.array([text for _, text in items], pa.large_string()))
        self.start, self.end, owner = kernels.tokens(data, offsets, "word")
        self.lower = kernels.ascii_lower()[data]
        self.names = [names for names, _ in items]
        words = kernels.span_hash(data, self.start, self.end)
        count = np.bincount(owner, minlength=len(items))
        #: By window length: bitmap of fingerprints, sorted window hashes, first word and item of each.
        self.lengths: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in np.unique(np.minimum(WINDOW, count[count > 0])).tolist():
            at = np.flatnonzero(np.minimum(WINDOW, count)[owner] == n)
            last = at + n - 1
            at = at[(last < len(owner)) & (owner[np.minimum(last, len(owner) - 1)] == owner[at])]
            whole = window_hash(words, at, n)
            bits = np.zeros(1 << min(BITMAP_BITS, len(at).bit_length() + 5), bool)
            bits[top_of(kept_fingerprints(words, n)[at], bits)] = True
            order = np.argsort(whole, kind="stable")
            self.lengths[n] = (bits, whole[order], at[order].astype(np.int32), owner[at[order]].astype(np.int32))

    def content(self, at: int, n: int) -> bytes:
        return b" ".join(self.lower[s:e].tobytes() for s, e in zip(self.start[at : at + n], self.end[at : at + n]))

    def find(self, n: int, key: np.uint64, content: bytes) -> set[str] | None:
        """Names of the items that have the window, or None if none has."""
        _, keys, at, owner = self.lengths[n]
        same: set[str] | None = None
        for k in range(int(np.searchsorted(keys, key)), int(np.searchsorted(keys, key, "right"))):
            if self.content(int(at[k]), n) == content:
                same = (same or set()) | self.names[owner[k]]
        return same


def top_of(kept: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The place of each fingerprint in a bitmap."""
    return kept >> np.uint64(65 - len(bits).bit_length())


def window_hash(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words from each place on."""
    whole = np.zeros(len(at), np.uint64)
    for j, factor in enumerate(kernels.gram_factors(n)):
        whole += words[at + j] * factor
    return kernels.mix(whole)


def kept_fingerprints(words: np.ndarray, n: int) -> np.ndarray:
    """The minimum k-gram hash of each window of n words."""
    k = min(GRAM, n)
    grams = kernels.gram_hash(words, k)
    return kernels.sliding_min(grams, n - k + 1) if len(grams) >= n - k + 1 else grams[:0]


def candidates(bits_of: dict[int, np.ndarray], data: np.ndarray, start: np.ndarray, end: np.ndarray, owner: np.ndarray):
    """(n, first words, kept fingerprints, window hashes) of windows inside a document whose fingerprint the bitmap has."""
    longest = max(bits_of, default=1)
    for a in range(0, len(start), STEP):
        b = min(a + STEP + longest - 1, len(start))
        words = kernels.span_hash(data, start[a:b], end[a:b])
        for n, bits in bits_of.items():
            kept = kept_fingerprints(words, n)[:STEP]
            at = np.flatnonzero(bits[top_of(kept, bits)])
            at = at[owner[a + at] == owner[a + at + n - 1]]
            if len(at):
                yield n, a + at, kept[at], window_hash(words, at, n)


def find_hits(index: Index, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[set[str]]]:
    """(document of each word, hit flag of each word, words per document, items per document)."""
    data, offsets = kernels.text_buffer(column)
    start, end, owner = kernels.tokens(data, offsets, "word")
    hit = np.zeros(len(start), bool)
    items: list[set[str]] = [set() for _ in range(len(column))]
    lower = kernels.ascii_lower()
    for n, at, _, whole in candidates({n: x[0] for n, x in index.lengths.items()}, data, start, end, owner):
        keys = index.lengths[n][1]
        found = keys[np.minimum(np.searchsorted(keys, whole), len(keys) - 1)] == whole
        known: dict[bytes, set[str] | None] = {}
        for p, key in zip(at[found].tolist(), whole[found]):
            content = b" ".join(lower[data[s:e]].tobytes() for s, e in zip(start[p : p + n], end[p : p + n]))
            if content not in known:
                known[content] = index.find(n, key, content)
            if (names := known[content]) is not None:
                hit[p : p + n] = True
                items[owner[p]] |= names
    return owner, hit, np.bincount(owner, minlength=len(column)), items


def judged(index: Index, batch: pa.RecordBatch) -> pa.StructArray:
    """The RESULT of each text of a batch."""
    owner, hit, n_words, items = find_hits(index, batch.column("text"))
    n_hit = np.bincount(owner[hit], minlength=batch.num_rows)
    sha = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
    columns = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(sha), pa.array((n_hit > 0) & (20 * n_hit >= n_words))]
    return pa.StructArray.from_arrays(columns, ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def windows(benchmark: DataFrame) -> DataFrame:
    """(n, fp, whole, content, item) of every window of every item, written."""

    def run(batches):
        for whole in batches:
            for batch in kernels.slices(whole, "text"):
                index = Index([(frozenset() if i is None else frozenset([i]), t) for i, t in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist())])
                words = kernels.span_hash(index.lower, index.start, index.end)
                for n, (_, keys, at, owner) in index.lengths.items():
                    fp = kept_fingerprints(words, n)[at]
                    texts = [index.content(p, n) for p in at.tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), n, np.int32)), pa.array(fp.view(np.int64)), pa.array(keys.view(np.int64)), pa.array(texts, pa.binary()).cast(pa.string()), pa.array([next(iter(index.names[o]), None) for o in owner.tolist()], pa.string())],
                        ["n", "fp", "whole", "content", "item"],
                    )

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("text"))
    return scratch.stage(items.mapInArrow(run, "n int, fp long, whole long, content string, item string").distinct(), "benchmark-windows")


def bitmaps(table: DataFrame) -> dict[int, np.ndarray]:
    """A bitmap of fingerprints for each window length: WINDOW bitmaps of 2**BITMAP_BITS bits at most."""
    top = F.shiftrightunsigned("fp", 64 - BITMAP_BITS)
    out = {}
    for n in [r.n for r in table.select("n").distinct().collect()]:
        found = table.where(F.col("n") == n).select(top.cast("int").alias("b")).distinct().toArrow()
        out[n] = np.zeros(1 << BITMAP_BITS, bool)
        out[n][found.column("b").to_numpy()] = True
    return out


def beside_files(texts: DataFrame, table: DataFrame) -> str:
    """The windows of ``table`` that occur in each file of a numbered table, written beside the files."""
    shared = texts.sparkSession.sparkContext.broadcast({n: np.packbits(x) for n, x in bitmaps(table).items()})

    def run(batches):
        bits_of = {n: np.unpackbits(x).astype(bool) for n, x in shared.value.items()}
        for file_no, batch in scratch.text_slices(batches, kernels.SLICE_BYTES):
            data, offsets = kernels.text_buffer(batch.column("text"))
            start, end, owner = kernels.tokens(data, offsets, "word")
            for n, _, fp, whole in candidates(bits_of, data, start, end, owner):
                both = np.unique(np.column_stack([fp, whole]), axis=0).view(np.int64)
                numbers = [pa.array(np.full(len(both), x, np.int32)) for x in (file_no, n)]
                yield pa.RecordBatch.from_arrays([*numbers, pa.array(both[:, 0]), pa.array(both[:, 1])], ["file_no", "n", "fp", "whole"])

    found = texts.select("uid", "file_no", "text").mapInArrow(run, "file_no int, n int, fp long, whole long").distinct()
    joined = found.join(table.hint("merge"), ["n", "fp", "whole"]).select("file_no", F.lit(0).cast("long").alias("uid"), "content", "item")
    return scratch.beside(joined, "benchmark-beside")


def flag(docs: DataFrame, benchmark: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of each document row, and ``n_words, n_hit, n_items, items_sha256, contaminated``.

    ``docs`` needs a string column ``text``; ``keep`` may contain it.
    """
    spark = docs.sparkSession
    plain = docs.select(F.struct(*keep).alias("row"), F.col("text").alias("text"))
    result = f"row {plain.schema['row'].dataType.simpleString()}, found struct<{RESULT.replace(' ', ':').replace(',:', ',')}>"
    columns = [*[F.col("row")[c].alias(c) for c in keep], "found.*"]
    most_words = benchmark.agg(F.sum(F.octet_length("text") / 2 + 1)).first()[0] or 0
    if most_words <= BLOCK_WORDS:
        items = [(frozenset() if r[0] is None else frozenset([r[0]]), r[1]) for r in benchmark.select(F.col("item_id").cast("string"), "text").collect()]
        shared = spark.sparkContext.broadcast(Index(items))

        def run(batches):
            for whole in batches:
                for batch in kernels.slices(whole, "text"):
                    yield pa.RecordBatch.from_arrays([batch.column("row"), judged(shared.value, batch)], ["row", "found"])

        return plain.mapInArrow(run, result).select(*columns)

    texts = scratch.numbered(plain, "decontaminate")
    path = beside_files(texts, windows(benchmark))

    def run_beside(batches):
        side, index, of_file = scratch.Beside(path), None, None
        for file_no, batch in scratch.text_slices(batches, kernels.SLICE_BYTES):
            if file_no != of_file:
                table = side.file(file_no)
                names: dict[str, set[str]] = {}
                for content, item in zip(*(table.column(c).to_pylist() for c in ("content", "item"))) if table is not None else ():
                    names.setdefault(content, set()).update([] if item is None else [item])
                index, of_file = Index([(frozenset(x), content) for content, x in names.items()]), file_no
            yield pa.RecordBatch.from_arrays([batch.column("row"), judged(index, batch)], ["row", "found"])

    return texts.mapInArrow(run_beside, result).select(*columns)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns as they were."""
    whole = docs.select(F.struct(*docs.columns).alias("doc"), F.col("text").alias("text"))
    return flag(whole, benchmark, ["doc"]).where(~F.col("contaminated")).select("doc.*")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return flag(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ["doc_id"])


#: Windows by unnesting, and plain joins of their words.
OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row_no, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bi AS (
  SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM bi
), di AS (
  SELECT row_no, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n
), hit AS (
  SELECT row_no, i, x.n, item FROM (SELECT row_no, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM di) x JOIN win ON win.n = x.n AND win.k = x.k
), words AS (
  SELECT row_no, count(DISTINCT p) AS n_hit FROM (SELECT row_no, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT row_no, i, n FROM hit)) GROUP BY row_no
), items AS (
  SELECT row_no, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT row_no, item FROM hit) GROUP BY row_no
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (row_no) LEFT JOIN items USING (row_no)
"""
