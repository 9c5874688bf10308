from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskloom.llm import chunk_dedup, suffix_dedup


def brute_removed(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(gone)
    return out


def described(text, gone):
    kept = bytes(b for b, g in zip(text, gone) if not g)
    spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
    return len(text), int(sum(gone)), spans, hashlib.sha256(kept).hexdigest()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=40).map(lambda b: bytes(x % 3 + 97 * (x > 9) for x in b)), min_size=1, max_size=6), st.lists(st.booleans(), min_size=6, max_size=6))
def test_windows_of_contexts_equal_brute_force(parts, flags):
    length = suffix_dedup.LENGTH
    pads = [bytes([i % 2]) * (length - 20) for i in range(len(parts))]
    blocks = [p + pad + p[:3] for p, pad in zip(parts, pads)]
    blocks = [b for b in blocks if len(b) >= length]
    if not blocks:
        return
    text = np.frombuffer(b"".join(blocks), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks])])
    windows = np.array([len(b) - length + 1 for b in blocks])
    repeated = np.array(flags[: len(blocks)])
    got = suffix_dedup.repeated_windows(text, offsets, windows, repeated)
    count = Counter()
    for b, r in zip(blocks, repeated):
        for i in range(len(b) - length + 1):
            count[b[i : i + length]] += 1 + int(r)
    for b, start in zip(blocks, offsets):
        for i in range(len(b) - length + 1):
            assert got[start + i] == (count[b[i : i + length]] > 1)


def test_suffix_order_is_the_sorted_order():
    rng = np.random.default_rng(7)
    for size, letters in ((1, 2), (2, 1), (400, 1), (900, 2), (900, 256), (60, 3)):
        text = rng.integers(0, letters, size).astype(np.uint8)
        hashes = np.arange(size).astype(np.uint64)
        got = suffix_dedup.suffix_order(text, suffix_dedup.smaller_than_next(text), np.ones(size, bool), suffix_dedup.eight_bytes(text), hashes)
        raw = text.tobytes()
        prefix = [raw[i : i + suffix_dedup.LENGTH] for i in got]
        assert sorted(got.tolist()) == list(range(size)) and prefix == sorted(prefix)
        a, b = rng.integers(0, size, 50), rng.integers(0, size, 50)
        common = suffix_dedup.common_prefix(suffix_dedup.eight_bytes(text), a, b)
        for x, y, c in zip(a.tolist(), b.tolist(), common.tolist()):
            exact = next((k for k in range(min(200, size - max(x, y))) if raw[x + k] != raw[y + k]), None)
            assert c == exact if exact is not None else c >= min(200, size - max(x, y))


def make_texts(rng):
    letters = "abcdefghij klmn\nopqé"
    prose = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [prose(rng.randint(150, 700)) for _ in range(6)]
    texts = [None, "", "short", "a" * 1000, "ab" * 300, passages[0], passages[0]]
    for _ in range(60):
        parts = [prose(rng.randint(0, 500)) for _ in range(3)]
        if rng.random() < 0.6:
            p = rng.choice(passages)
            parts.insert(rng.randint(0, 3), p[rng.randint(0, 60) : len(p) - rng.randint(0, 60)])
        texts.append("".join(parts))
    texts += [texts[20] + "x" * 199, "y" * 200, "y" * 199, texts[21], texts[21]]
    line = prose(160)  # shorter than a window, in ever new surroundings
    texts += [prose(rng.randint(10, 90)) + line + prose(rng.randint(10, 90)) for _ in range(30)]
    return texts + [passages[1] + prose(30) for _ in range(80)]


@pytest.mark.parametrize(("slice_bytes", "segment", "batch", "crowd"), [(1 << 21, 1 << 22, 1 << 21, 20_000), (3000, 700, 900, 3)])
def test_repeats_equal_brute_force(spark, monkeypatch, slice_bytes, segment, batch, crowd):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    monkeypatch.setattr(suffix_dedup.kernels, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", segment)
    monkeypatch.setattr(suffix_dedup, "SORTED", batch)
    texts = make_texts(random.Random(11))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, texts[9])], "doc_id long, text string")
    docs = docs.withColumn("uid", F.lit("clash")).withColumn("file_no", F.lit("clash"))
    raw = [(t or "").encode() for t in texts] + [texts[9].encode()]
    want = sorted(((i, *described(t, g)) for i, t, g in zip([*range(len(texts)), None], raw, brute_removed(raw, 200))), key=str)
    got = suffix_dedup.remove_repeats(docs.repartition(5))
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert chunk_dedup.deduplicate(none).count() == 0


def brute_chunks(text):
    """Chunk ends by the rolling hash, byte after byte."""
    ends, h, last = [], 0, None
    for i, b in enumerate(text):
        h = (h << 1) + int(chunk_dedup.GEAR[b])
        if i + 1 >= chunk_dedup.WINDOW:
            window = text[i + 1 - chunk_dedup.WINDOW : i + 1]
            h = sum(int(chunk_dedup.GEAR[c]) << (chunk_dedup.WINDOW - 1 - k) for k, c in enumerate(window))
            if (h << (32 - chunk_dedup.WINDOW) & 0xFFFFFFFF) >> (32 - chunk_dedup.BITS) == 0:
                if last is None or i + 1 - last >= chunk_dedup.MIN_CHUNK:
                    ends.append(i + 1)
                last = i + 1
    ends = sorted({*ends, len(text)} - {0})
    out, at = [], 0
    for e in ends:
        while e - at > chunk_dedup.MAX_CHUNK:
            out.append((at, at + chunk_dedup.MAX_CHUNK))
            at += chunk_dedup.MAX_CHUNK
        out.append((at, e))
        at = e
    return out


def test_chunks_equal_brute_force():
    texts = [(t or "").encode() for t in make_texts(random.Random(4))] + [b"q" * 5000]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    start, end, doc = chunk_dedup.chunks(data, offsets)
    for d, text in enumerate(texts):
        own = doc == d
        assert list(zip((start[own] - offsets[d]).tolist(), (end[own] - offsets[d]).tolist())) == brute_chunks(text)


def test_chunk_duplicates_equal_brute_force(spark):
    texts = make_texts(random.Random(4))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    raw = [(t or "").encode() for t in texts]
    pieces = [[t[a:b] for a, b in brute_chunks(t)] for t in raw]
    count = Counter(c for p in pieces for c in p)
    first: dict[bytes, int] = {}
    for d, p in enumerate(pieces):
        for c in p:
            first.setdefault(c, d)
    want = []
    for d, (text, own) in enumerate(zip(raw, pieces)):
        gone, shared, n_long, at, k, seen = np.zeros(len(text), bool), 0, 0, 0, 0, set()
        while k < len(own):
            if count[own[k]] < 2:
                at, k = at + len(own[k]), k + 1
                continue
            run = []
            while k < len(own) and count[own[k]] > 1:
                run.append((at, own[k]))
                at, k = at + len(own[k]), k + 1
            long = sum(len(c) for _, c in run) >= min(chunk_dedup.MIN_RUN, len(text))
            n_long += long * len(run)
            for where, c in run:
                if long:
                    shared += len(c)
                    if first[c] != d or c in seen:
                        gone[where : where + len(c)] = True
                seen.add(c)
        n_bytes, n_removed, n_spans, sha = described(text, gone)
        want.append((d, n_bytes, len(own), sum(count[c] > 1 for c in own), n_long, shared, n_removed, n_spans, sha))
    got = sorted(map(tuple, chunk_dedup.deduplicate(docs).collect()))
    assert got == want


def test_passages_in_two_documents_are_found(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, shared = [], []
    for i in range(100):
        passage = prose(60)
        rows += [(2 * i, f"{prose(80)} {passage} {prose(50)}"), (2 * i + 1, f"{prose(70)} {passage} {prose(90)}")]
        shared += [2 * i, 2 * i + 1]
    rows += [(1000 + i, prose(150)) for i in range(100)]
    got = {r.doc_id: r for r in chunk_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[d].duplicate_bytes > 0 for d in shared) >= 198
    assert all(got[1000 + i].duplicate_bytes == 0 for i in range(100))
