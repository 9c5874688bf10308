from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from riskloom.llm import simhash


def brute_fingerprint(text, n=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, ids, bits):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                parent[find(i)] = find(j)
    smallest = {}
    for i, d in enumerate(ids):
        if d is not None:
            smallest[find(i)] = min(smallest.get(find(i), d), d)
    return [smallest.get(find(i)) for i in range(len(fps))]


def test_hash_is_that_of_spark(spark):
    text = "some shingle of wörds"
    got = spark.range(1).select(F.xxhash64(F.lit(text))).first()[0]
    assert got & (1 << 64) - 1 == xxhash.xxh64(text.encode(), seed=42).intdigest()


def texts():
    rng = random.Random(3)
    prose = lambda n: [rng.choice("alpha beta Gamma delta épsilon zeta eta".split()) for _ in range(n)]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "One"), (4, "one"), (5, "a b c"), (5, "a b c"), (None, "A  b\tc"), (6, "x\x1cy z   w v u")]
    for i in range(40):
        base = prose(rng.randint(4, 150))
        rows.append((10 * i + 10, " ".join(base)))
        for k in range(rng.randint(0, 3)):
            base = list(base)
            base[rng.randrange(len(base))] = "changed"
            rows.append((10 * i + 11 + k, " ".join(base)))
    return rows + [(900 + i, "the hot text is here " * 3) for i in range(50)]


def test_classes_equal_brute_force(spark):
    rows = texts()
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("component", F.lit(1))
    fps = [brute_fingerprint(t) for _, t in rows]
    expected = sorted(zip([r[0] for r in rows], [f"{x:016x}" for x in fps], brute_components(fps, [r[0] for r in rows], 4)), key=str)
    got = simhash.classes(frame, ["doc_id", "fp"])
    assert sorted(map(tuple, got.select("kept.doc_id", simhash.as_hex(F.col("fp")), "component_id").collect()), key=str) == expected
    assert simhash.classes(frame.limit(0), ["doc_id"]).count() == 0


@pytest.mark.parametrize(("meeting", "dense"), [(256, 1 << 14), (256, 50), (2, 3), (0.001, 1 << 14)])
def test_no_link_is_lost(spark, monkeypatch, meeting, dense):
    monkeypatch.setattr(simhash, "MEETING", meeting)
    monkeypatch.setattr(simhash, "DENSE", dense)
    monkeypatch.setattr(simhash, "CELLS", 20_000)
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 1 << 64, 60, dtype=np.uint64)
    fps = set(centres.tolist())
    for c in centres.tolist():
        for flips in (1, 3, 4, 4, 5):
            for b in rng.choice(64, flips, replace=False).tolist():
                c ^= 1 << b
            fps.add(c)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in fps]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 4 for r in edges)
    label = {x: x for x in signed}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for r in edges:
        label[find(r.a)] = find(r.b)
    assert len({find(x) for x in signed}) == len(set(brute_components(fps, list(range(len(fps))), 4)))


def test_long_texts_are_hashed_in_parts(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(5000))
    whole = simhash.fingerprint(text, 4)
    monkeypatch.setattr(simhash, "SEGMENT", 64)
    assert simhash.fingerprint(text, 4) == whole == np.uint64(brute_fingerprint(text)).astype(np.int64)
