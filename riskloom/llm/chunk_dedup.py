"""Substring dedup by content-defined chunking.

A gear hash rolls over each text: every byte adds its entry of a fixed random table, and what came before shifts left, so
the hash at a byte depends on the WINDOW bytes up to it. A chunk ends where the top BITS bits are zero, unless another
such place lies less than MIN_CHUNK bytes before, so boundaries move with the content and an insertion changes only the
chunks around it. Stretches of MAX_CHUNK bytes without a boundary are cut.

Chunks are deduplicated by digest (96 bits of XXH3): of equal chunks the first in table order stays. A duplicate counts,
and is removed, only as part of MIN_RUN bytes or more of consecutive duplicate chunks of its document or of a document
that consists of such chunks alone, so common phrases stay; ``n_repeated_chunks`` counts the others too. A passage that
other text surrounds loses the parts of it that fall into chunks with the surroundings, about one chunk at each end.

Counts are aggregated before the shuffle, so a chunk that a third of all documents share is one row per task; chunk rows
meet their counts in a join that adaptive execution can split. Found chunks go back to their texts by file and row
number: texts are never shuffled.

Defined results: null texts have no bytes; repeated rows keep one copy, that of the first row; empty tables give empty
results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import kernels, scratch

WINDOW = 16
BITS = 5
MIN_CHUNK = 16
MAX_CHUNK = 1024
MIN_RUN = 64
SEGMENT = 1 << 22
GEAR = np.random.default_rng(3).integers(0, 1 << 32, 256, dtype=np.uint32)

RESULT = "doc_id long, n_bytes long, n_chunks long, n_repeated_chunks long, n_duplicate_chunks long, duplicate_bytes long, n_removed long, n_spans long, kept_sha256 string"


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte, over WINDOW bytes (fewer at the start)."""
    h, width = GEAR[data], 1
    while width < WINDOW:
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    return h << np.uint32(32 - WINDOW)


def boundaries(data: np.ndarray) -> np.ndarray:
    """Ends of bytes whose hash has its top bits zero, found over SEGMENT bytes at a time."""
    out = []
    for at in range(0, len(data), SEGMENT):
        before = max(0, at - WINDOW + 1)
        ends = np.flatnonzero(gear(data[before : at + SEGMENT]) >> np.uint32(32 - BITS) == 0) + before + 1
        out.append(ends[ends > at])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of each chunk."""
    ends = boundaries(data)
    doc = np.searchsorted(offsets[1:], ends - 1, "right")
    own = ends - offsets[doc] >= WINDOW
    ends, doc = ends[own], doc[own]
    far = np.ones(len(ends), bool)
    far[1:] = (ends[1:] - ends[:-1] >= MIN_CHUNK) | (doc[1:] != doc[:-1])
    ends = np.unique(np.concatenate([ends[far], offsets[1:]]))
    ends = ends[ends > 0]
    starts = np.concatenate([[0], ends[:-1]])[: len(ends)]
    more = (ends - starts - 1) // MAX_CHUNK
    if more.any():
        base = np.repeat(starts, more)
        step = np.arange(len(base)) - np.repeat(np.cumsum(more) - more, more) + 1
        ends = np.sort(np.concatenate([ends, base + step * MAX_CHUNK]))
        starts = np.concatenate([[0], ends[:-1]])[: len(ends)]
    return starts, ends, np.searchsorted(offsets[1:], starts, "right")


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    raw, digest = data.tobytes(), xxhash.xxh3_128_digest
    both = np.frombuffer(b"".join([digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1].astype(np.int32)


def chunk_rows(texts: DataFrame) -> DataFrame:
    """(uid, file_no, start, size, d1, d2) of each chunk of a numbered table."""

    def run(batches):
        for file_no, batch in scratch.text_slices(batches, kernels.SLICE_BYTES):
            data, offsets = kernels.text_buffer(batch.column("text"))
            start, end, doc = chunks(data, offsets)
            d1, d2 = digests(data, start, end)
            uid = batch.column("uid").to_numpy()[doc]
            numbers = (uid, np.full(len(uid), file_no, np.int32), start - offsets[doc], (end - start).astype(np.int32), d1, d2)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in numbers], ["uid", "file_no", "start", "size", "d1", "d2"])

    return texts.mapInArrow(run, "uid long, file_no int, start long, size int, d1 long, d2 int")


def removed_runs(start: np.ndarray, size: np.ndarray, other: np.ndarray, digest: np.ndarray, n_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a document's duplicate chunks in order: (in a run of MIN_RUN bytes or of the whole document, removed) flags.
    ``digest`` has a row of the two parts of each chunk's digest."""
    breaks = np.concatenate([[True], start[1:] != start[:-1] + size[:-1]])
    run = np.cumsum(breaks) - 1
    long = np.bincount(run, size)[run] >= min(MIN_RUN, n_bytes)
    again = np.ones(len(start), bool)
    again[np.unique(digest, axis=0, return_index=True)[1]] = False
    return long, long & (other | again)


def deduplicate(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Per document: doc_id, counts of bytes, chunks and duplicates, removed bytes and runs, SHA-256 of what stays.

    ``with_text`` adds ``kept_text``, the remaining bytes (removal can split a character).
    """
    texts = scratch.numbered(docs.select("doc_id", "text"), "chunk-texts")
    found = scratch.stage(chunk_rows(texts), "chunk-rows")
    counts = found.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"), F.min("uid").alias("first")).where("n > 1").drop("n")
    repeated = scratch.stage(counts, "chunk-repeated")
    mine = found.join(repeated.hint("merge"), ["d1", "d2"]).select("uid", "file_no", "start", "size", "d1", "d2", (F.col("first") != F.col("uid")).alias("other"))
    path = scratch.beside(mine, "chunk-beside")

    def run(batches):
        side = scratch.Beside(path)
        for file_no, batch in scratch.text_slices(batches, kernels.SLICE_BYTES):
            data, offsets = kernels.text_buffer(batch.column("text"))
            count = np.bincount(chunks(data, offsets)[2], minlength=batch.num_rows)
            columns, where = side.of(file_no, batch.column("uid").to_numpy())
            rows = []
            for i, (low, high) in enumerate(where):
                text = data[offsets[i] : offsets[i + 1]]
                gone = np.zeros(len(text), bool)
                shared = n_long = 0
                if high > low:
                    order = low + np.argsort(columns["start"][low:high], kind="stable")
                    start, size = columns["start"][order], columns["size"][order].astype(np.int64)
                    inside, out = removed_runs(start, size, columns["other"][order], np.column_stack([columns["d1"][order], columns["d2"][order]]), len(text))
                    shared, n_long = int(size[inside].sum()), int(inside.sum())
                    for a, b in zip(start[out].tolist(), (start + size)[out].tolist()):
                        gone[a:b] = True
                kept = text[~gone].tobytes()
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                rows.append((len(text), int(count[i]), high - low, n_long, shared, int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
            kinds = [pa.int64()] * 7 + [pa.string(), pa.binary()]
            names = ["n_bytes", "n_chunks", "n_repeated_chunks", "n_duplicate_chunks", "duplicate_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
            upto = 9 if with_text else 8
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([r[k] for r in rows], kinds[k]) for k in range(upto)]], ["doc_id", *names[:upto]])

    return texts.mapInArrow(run, RESULT + (", kept_text binary" if with_text else ""))


def op3_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"))
