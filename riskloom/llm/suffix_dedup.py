"""Removal of long repeated substrings with suffix arrays built by two-stage sorting.

A byte is removed if a string of LENGTH bytes that covers it also starts anywhere else. To bring strings together that
can be equal, every window of LENGTH bytes keeps its minimum GRAM-byte hash (the rightmost of equal ones): equal windows
keep the same gram at the same offset. The consecutive windows that keep one gram form a context. Grams that occur once
end there. Of the others, equal contexts are counted before any text moves, and one representative of each distinct
context, with a flag for repeated ones, is sent to the task of its gram.

There, a suffix array of the contexts is built by two-stage sorting: suffixes smaller than their successors are sorted
directly by their bytes (to depth LENGTH), and the others are induced by one scan over the buckets of first bytes:
whatever stands before an entry of the array, if it is larger than its successor, is the next in its bucket. Adjacent
common prefixes then say which windows occur again. Only suffixes that windows need take part.

A gram with more than CROWD distinct contexts (a frequent line in ever new surroundings) is not left to one task: its
windows keep a longer gram, half way to LENGTH, and what that makes equal is counted before it moves, again and again
until the gram is the whole window and all that share it are equal.

Repeated windows go back to every occurrence of their context, and to the texts by file and row number: texts are never
shuffled, contexts once and one of each.

Defined results: null counts as empty; texts shorter than LENGTH bytes stay whole; repeated rows remove each other;
empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import kernels, scratch

LENGTH = 200
GRAM = 100
#: Bytes of windows hashed at once inside a long text, and bytes of contexts sorted at once (whole grams).
SEGMENT = 1 << 22
SORTED = 1 << 21
#: Distinct contexts of a gram that one task sorts.
CROWD = 20_000

_LOW = 23


# ---------------------------------------------------------------- contexts


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` bytes from each position on."""
    n = max(0, len(data) - width + 1)
    up, down = kernels.powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return kernels.mix((sums[width : width + n] - sums[:n]) * down[:n])


def contexts(data: np.ndarray, offsets: np.ndarray, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(document, first window, last window, gram hash) of each context; windows as positions in ``data``."""
    parts = []
    for low in range(0, len(data), SEGMENT):
        part = data[low : low + SEGMENT + LENGTH - 1]
        if len(part) < LENGTH:
            break
        grams = rolling(part, gram)
        low_bits = np.uint64((1 << _LOW) - 1)
        late = np.arange(int(low_bits), int(low_bits) - len(grams), -1, dtype=np.uint64)  # the rightmost of equal hashes is least
        kept = kernels.sliding_min((grams & ~low_bits) | late, LENGTH - gram + 1) & low_bits
        # Runs of windows that keep one gram, cut where a document starts and where its last window has been.
        cuts = [np.flatnonzero(kept[1:] != kept[:-1]) + 1, offsets - low, offsets - low - LENGTH + 1]
        first = np.unique(np.concatenate([[0], *(c[(c > 0) & (c < len(kept))] for c in cuts)]))
        last = np.append(first[1:], len(kept)) - 1
        doc = np.searchsorted(offsets[1:], first + low, "right")
        fits = first + low + LENGTH <= offsets[np.minimum(doc + 1, len(offsets) - 1)]
        first, last, doc = first[fits], last[fits], doc[fits]
        parts.append((doc, first + low, last + low, grams[(low_bits - kept[first]).astype(np.int64)]))
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*parts))


def gram_rows(texts: DataFrame) -> DataFrame:
    def run(batches):
        for _, batch in scratch.text_slices(batches, kernels.SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array(contexts(*kernels.text_buffer(batch.column("text")))[3].view(np.int64))], ["h"])

    return texts.mapInArrow(run, "h long")


def context_rows(texts: DataFrame) -> DataFrame:
    """(uid, file_no, h, c, first, windows): c is a digest of the context's bytes."""

    def run(batches):
        digest = xxhash.xxh3_64_intdigest
        for file_no, batch in scratch.text_slices(batches, kernels.SLICE_BYTES):
            data, offsets = kernels.text_buffer(batch.column("text"))
            doc, first, last, h = contexts(data, offsets)
            raw = data.tobytes()
            c = np.array([digest(raw[a : b + LENGTH]) for a, b in zip(first.tolist(), last.tolist())], np.uint64).view(np.int64)
            numbers = (batch.column("uid").to_numpy()[doc], np.full(len(doc), file_no, np.int32), h.view(np.int64), c, first - offsets[doc], (last - first + 1).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in numbers], ["uid", "file_no", "h", "c", "first", "windows"])

    return texts.mapInArrow(run, "uid long, file_no int, h long, c long, first long, windows int")


# ---------------------------------------------------------------- suffix array


def eight_bytes(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a big-endian number; zeros past the end."""
    out = np.concatenate([text, np.zeros(LENGTH + 8, np.uint8)]).astype(np.uint64)
    for step, bits in ((1, 8), (2, 16), (4, 32)):
        out = (out[:-step] << np.uint64(bits)) | out[step:]
    return out


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than their successors; equal bytes take the type of what follows them."""
    ends = np.flatnonzero(np.concatenate([text[1:] != text[:-1], [True]])) if len(text) else np.zeros(0, np.int64)
    rises = np.append(text[ends[:-1]] < text[ends[:-1] + 1], False)[: len(ends)]
    return np.repeat(rises, np.diff(ends, prepend=-1))


def sort_directly(eight: np.ndarray, pos: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """``pos`` ordered by the LENGTH bytes from each on. Ties whose hashes of LENGTH bytes all agree need no more bytes."""
    if not len(pos):
        return pos
    key = eight[pos]
    order = np.argsort(key, kind="stable")
    pos, key = pos[order], key[order]
    tied = np.arange(len(pos))
    group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
    depth = 8
    while depth < LENGTH:
        starts = np.concatenate([[True], group[1:] != group[:-1]])
        first = np.flatnonzero(starts)
        own = whole[pos[tied]]
        open_ = np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first)
        live = open_[np.cumsum(starts) - 1]
        tied, group = tied[live], group[live]
        if not len(tied):
            break
        key = eight[pos[tied] + depth]
        order = np.lexsort((key, group))
        pos[tied] = pos[tied[order]]
        key = key[order]
        group = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]) | (group[1:] != group[:-1])]))
        depth += 8
    return pos


def suffix_order(text: np.ndarray, small: np.ndarray, needed: np.ndarray, eight: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """The needed suffixes in order of their first LENGTH bytes, by two-stage sorting; ``small`` marks those smaller
    than their successors.

    ``needed`` must hold, with a suffix larger than its successor, the successor too.
    """
    direct = sort_directly(eight, np.flatnonzero(small & needed), whole)
    first_of = np.searchsorted(text[direct], np.arange(257)) if len(direct) else np.zeros(257, int)
    induced = needed & ~small
    buckets: list[list[np.ndarray]] = [[] for _ in range(256)]
    if len(text) and induced[-1]:
        buckets[text[-1]].append(np.array([len(text) - 1]))
    out = []
    for byte in range(256):
        entries = np.concatenate(buckets[byte]) if buckets[byte] else np.zeros(0, np.int64)
        larger = [entries]
        while len(entries):  # runs of this byte go to this very bucket
            before = entries[entries > 0] - 1
            entries = before[induced[before] & (text[before] == byte)]
            larger.append(entries)
        bucket = np.concatenate([*larger, direct[first_of[byte] : first_of[byte + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[induced[before] & (text[before] > byte)]
        head = text[before]
        order = np.argsort(head, kind="stable")
        before, head = before[order], head[order]
        for value in np.unique(head).tolist():
            buckets[value].append(before[np.searchsorted(head, value) : np.searchsorted(head, value, "right")])
    return np.concatenate(out)


def common_prefix(eight: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bytes in common from a[i] and b[i] on, LENGTH at most."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for depth in range(0, LENGTH, 8):
        x = eight[a[live] + depth] ^ eight[b[live] + depth]
        differ = x != 0
        bits = np.frexp((x[differ] >> np.uint64(11)).astype(float))[1] + 11
        bits = np.where(x[differ] >> np.uint64(11) == 0, np.frexp(x[differ].astype(float))[1], bits)
        out[live[differ]] = depth + (64 - bits) // 8
        live = live[~differ]
    out[live] = LENGTH
    return np.minimum(out, LENGTH)


def repeated_windows(text: np.ndarray, offsets: np.ndarray, windows: np.ndarray, repeated: np.ndarray) -> np.ndarray:
    """True at the start of each window of the contexts that occurs again (or whose equal is in a repeated context)."""
    n = len(text)
    owner = np.repeat(np.arange(len(windows)), np.diff(offsets))
    inside = np.arange(n) - offsets[owner]
    is_window = inside < windows[owner]
    small = smaller_than_next(text)
    needed = is_window.copy()
    edge = offsets[:-1] + windows - 1  # past the last window, up to the suffix that the induction starts from
    while len(edge := edge[~small[edge] & (edge < n - 1)]):
        edge = edge + 1
        edge = edge[~needed[edge] | is_window[edge]]
        needed[edge] = True
    eight = eight_bytes(text)
    whole = np.zeros(n, np.uint64)
    hashed = rolling(text, LENGTH)
    whole[: len(hashed)] = hashed
    whole[len(hashed) :] = np.arange(n - len(hashed))
    order = suffix_order(text, small, needed, eight, whole)
    order = order[is_window[order]]
    same = common_prefix(eight, order[:-1], order[1:]) >= LENGTH
    group = np.cumsum(np.concatenate([[0], ~same])) if len(order) else np.zeros(0, int)
    again = (np.bincount(group)[group] > 1) | (np.bincount(group, repeated[owner[order]])[group] > 0) if len(order) else np.zeros(0, bool)
    out = np.zeros(n, bool)
    out[order[again]] = True
    return out


def context_results(sent: DataFrame) -> DataFrame:
    """(h, c, runs) of (h, c, repeated, windows, bytes) rows: starts and ends of runs of repeated windows."""

    def solve(table: pa.Table) -> pa.RecordBatch:
        text, offsets = kernels.text_buffer(table.column("bytes"))
        windows, repeated = table.column("windows").to_numpy(), table.column("repeated").to_numpy()
        again = repeated_windows(text, offsets, windows, repeated).astype(np.int8)
        jumps = np.diff(np.concatenate([[0], again, [0]]))
        starts, ends = np.flatnonzero(jumps == 1), np.flatnonzero(jumps == -1)
        owner = np.searchsorted(offsets[1:], starts, "right")
        runs: list[list[int]] = [[] for _ in range(table.num_rows)]
        for o, a, b in zip(owner.tolist(), starts.tolist(), ends.tolist()):
            runs[o] += [a - int(offsets[o]), b - int(offsets[o])]
        keep = pa.array([bool(r) for r in runs])
        out = pa.table({"h": table.column("h"), "c": table.column("c"), "runs": pa.array(runs, pa.list_(pa.int32()))}).filter(keep)
        return pa.RecordBatch.from_arrays([x.combine_chunks() if x.num_chunks != 1 else x.chunk(0) for x in out.columns], ["h", "c", "runs"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for part in kernels.slices(batch, "bytes", SORTED // 2):
                held.append(part)
                size += int(kernels.text_buffer(part.column("bytes"))[1][-1])
                if size < SORTED:
                    continue
                table = pa.Table.from_batches(held)
                h = table.column("h").to_numpy()
                done = int(np.searchsorted(h, h[-1]))
                if done:
                    yield solve(table.slice(0, done).combine_chunks())
                held = table.slice(done).to_batches()
                size = sum(int(kernels.text_buffer(b.column("bytes"))[1][-1]) for b in held)
        if held:
            yield solve(pa.Table.from_batches(held).combine_chunks())

    return sent.mapInArrow(run, "h long, c long, runs array<int>")


# ---------------------------------------------------------------- operator


def representatives(texts: DataFrame, path: str) -> DataFrame:
    """The bytes of the contexts that ``path`` holds beside the texts, one of each in a document."""

    def run(batches):
        side = scratch.Beside(path)
        for file_no, batch in scratch.text_slices(batches, kernels.SLICE_BYTES):
            data, offsets = kernels.text_buffer(batch.column("text"))
            columns, where = side.of(file_no, batch.column("uid").to_numpy())
            raw, rows = data.tobytes(), []
            for i, (low, high) in enumerate(where):
                seen = set()
                for k in range(low, high):
                    h, c = int(columns["h"][k]), int(columns["c"][k])
                    if (h, c) not in seen:
                        seen.add((h, c))
                        at, windows = int(offsets[i] + columns["first"][k]), int(columns["windows"][k])
                        rows.append((h, c, bool(columns["repeated"][k]), windows, raw[at : at + windows + LENGTH - 1]))
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["h", "c", "repeated", "windows", "bytes"])

    return texts.mapInArrow(run, "h long, c long, repeated boolean, windows int, bytes binary")


def narrower(crowded: DataFrame, gram: int) -> DataFrame:
    """(h, c, shift, k, d, repeated, windows, bytes): the contexts of longer grams inside contexts."""

    def run(batches):
        digest = xxhash.xxh3_64_intdigest
        for whole in batches:
            for batch in kernels.slices(whole, "bytes"):
                data, offsets = kernels.text_buffer(batch.column("bytes"))
                owner, first, last, k = contexts(data, offsets, gram)
                raw = data.tobytes()
                parts = [raw[a : b + LENGTH] for a, b in zip(first.tolist(), last.tolist())]
                d = np.array([digest(x) for x in parts], np.uint64).view(np.int64)
                take = pa.array(owner, pa.int64())
                own = [batch.column(c).take(take) for c in ("h", "c", "repeated")]
                columns = [own[0], own[1], pa.array((first - offsets[owner]).astype(np.int32)), pa.array(k.view(np.int64)), pa.array(d), own[2], pa.array((last - first + 1).astype(np.int32)), pa.array(parts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["h", "c", "shift", "k", "d", "repeated", "windows", "bytes"])

    return crowded.select("h", "c", "repeated", "bytes").mapInArrow(run, "h long, c long, shift int, k long, d long, repeated boolean, windows int, bytes binary")


def solve(sent: DataFrame, distinct: DataFrame, gram: int = GRAM) -> DataFrame:
    """(h, c, runs) of (h, c, repeated, windows, bytes) rows; ``distinct`` has their (h, c) without bytes."""
    sorted_here = lambda rows: context_results(rows.repartition("h").sortWithinPartitions("h"))
    if gram == LENGTH:  # all contexts of a gram are equal, and so one row
        return sorted_here(sent)
    crowds = scratch.stage(distinct.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD).select("h"), "suffix-crowds")
    if crowds.isEmpty():
        return sorted_here(sent)
    sent = scratch.stage(sent, "suffix-sent")
    longer = gram + (LENGTH - gram + 1) // 2
    parts = scratch.stage(narrower(sent.join(crowds.hint("merge"), "h", "left_semi"), longer), "suffix-narrower")
    again = (F.count(F.lit(1)) > 1) | F.bool_or("repeated")
    one = parts.groupBy(F.col("k").alias("h"), F.col("d").alias("c")).agg(again.alias("repeated"), F.any_value("windows").alias("windows"), F.any_value("bytes").alias("bytes"))
    one = scratch.stage(one, "suffix-one")
    inner = scratch.stage(solve(one, one.select("h", "c"), longer), "suffix-inner").select(F.col("h").alias("k"), F.col("c").alias("d"), "runs")
    moved = parts.select("h", "c", "shift", "k", "d").join(inner.hint("merge"), ["k", "d"]).select("h", "c", F.transform("runs", lambda x: x + F.col("shift")).alias("runs"))
    return sorted_here(sent.join(crowds.hint("merge"), "h", "left_anti")).unionByName(moved)


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; ``with_text`` adds the remaining bytes."""
    texts = scratch.numbered(docs.select("doc_id", "text"), "suffix-texts")
    grams = scratch.stage(gram_rows(texts).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "suffix-grams")
    found = scratch.stage(context_rows(texts).join(grams.hint("merge"), "h"), "suffix-contexts")
    distinct = scratch.stage(found.groupBy("h", "c").agg((F.count(F.lit(1)) > 1).alias("repeated"), F.min("uid").alias("one")), "suffix-distinct")
    chosen = found.join(distinct.hint("merge"), ["h", "c"]).where("uid = one").select("uid", "file_no", "h", "c", "first", "windows", "repeated")
    sent = representatives(texts, scratch.beside(chosen, "suffix-chosen"))
    results = scratch.stage(solve(sent, distinct), "suffix-results")
    hits = found.join(results.hint("merge"), ["h", "c"]).select("uid", "file_no", "first", "runs")
    path = scratch.beside(hits, "suffix-hits")

    def run(batches):
        side = scratch.Beside(path)
        for file_no, batch in scratch.text_slices(batches, kernels.SLICE_BYTES):
            data, offsets = kernels.text_buffer(batch.column("text"))
            columns, where = side.of(file_no, batch.column("uid").to_numpy())
            rows = []
            for i, (low, high) in enumerate(where):
                text = data[offsets[i] : offsets[i + 1]]
                gone = np.zeros(len(text), bool)
                for k in range(low, high):
                    first, runs = int(columns["first"][k]), columns["runs"][k]
                    for a, b in zip(runs[::2].tolist(), runs[1::2].tolist()):
                        gone[first + a : first + b + LENGTH - 1] = True
                kept = text[~gone].tobytes()
                rows.append((len(text), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest(), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            upto = 5 if with_text else 4
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"][:upto]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([r[k] for r in rows], kinds[k]) for k in range(upto)]], ["doc_id", *names])

    return texts.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_text binary" if with_text else ""))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: A window's start counts if its bytes start at least twice; removed runs are the islands of those starts.
OP4_SQL = f"""
WITH texts AS (SELECT row_number() OVER () AS u, doc_id, encode(coalesce(text, '')) AS b FROM documents),
starts AS (SELECT u, i, b[i + 1 : i + {LENGTH}] AS w FROM (SELECT u, b, unnest(range(octet_length(b) - {LENGTH - 1})) AS i FROM texts WHERE octet_length(b) >= {LENGTH})),
again AS (SELECT w FROM starts GROUP BY w HAVING count(*) > 1),
hits AS (SELECT u, i, i - lag(i) OVER (PARTITION BY u ORDER BY i) AS step FROM starts SEMI JOIN again USING (w)),
runs AS (SELECT u, min(i) AS a, max(i) + {LENGTH} AS z
    FROM (SELECT u, i, count(*) FILTER (step IS NULL OR step > {LENGTH}) OVER (PARTITION BY u ORDER BY i) AS run FROM hits) GROUP BY u, run),
ends AS (SELECT u, a, z FROM runs UNION ALL SELECT u, 0, 0 FROM texts UNION ALL SELECT u, octet_length(b), octet_length(b) FROM texts),
pieces AS (SELECT u, max(z) OVER w AS a, lead(a) OVER w AS z FROM ends WINDOW w AS (PARTITION BY u ORDER BY a, z)),
kept AS (SELECT u, string_agg(CASE WHEN p.z > p.a THEN hex(b[p.a + 1 : p.z]) ELSE '' END, '' ORDER BY p.a, p.z) AS x FROM pieces p JOIN texts USING (u) GROUP BY u),
counts AS (SELECT u, sum(z - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY u)
SELECT doc_id, octet_length(b) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(x)) AS kept_sha256
FROM texts JOIN kept USING (u) LEFT JOIN counts USING (u)
"""
