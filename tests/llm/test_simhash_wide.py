from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import scratch, simhash, simhash_wide


def brute_sets(texts, n=5):
    out = []
    for t in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    return out


def brute_similar(sets, ids, similarity=0.8):
    """The smallest id of each class of links at the similarity; empty sets are one class."""
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i], sets[j]
            common = len(a & b)
            if (not a and not b) or (common and common >= similarity * (len(a) + len(b) - common)):
                parent[find(i)] = find(j)
    smallest = {}
    for i, d in enumerate(ids):
        smallest[find(i)] = min(smallest.get(find(i), d), d)
    return list(smallest.values())


def corpus(seed, groups=40, copies=4):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(2000)]
    texts = [None, "", " ", "one two", "One  Two", "one two three"]
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 400))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, copies)):
            w = list(base)
            for _ in range(max(1, int(len(w) * rng.choice([0.003, 0.01, 0.02, 0.06, 0.2])))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_brute_force(spark, seed):
    texts = corpus(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("uid", F.lit("clash")).withColumn("f0", F.lit(1))
    got = sorted(r.doc_id for r in simhash_wide.drop_near_copies(docs.repartition(3)).collect())
    want = sorted(brute_similar(brute_sets(texts), range(len(texts))))
    assert len(set(got) ^ set(want)) <= 1  # a pair at the very threshold may not meet


def test_a_large_group_is_one_class(spark, monkeypatch):
    monkeypatch.setattr(simhash_wide, "HELD", 500)
    rng = random.Random(3)
    base = [f"w{rng.randrange(900)}" for _ in range(300)]
    texts = [" ".join(base[:i] + ["changed"] + base[i + 1 :]) for i in range(0, 300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, texts[0])], "doc_id long, text string")
    assert [r.doc_id for r in simhash_wide.drop_near_copies(docs).collect()] == [0]


@pytest.mark.parametrize(("least", "most", "dense"), [(3, 4, 2048), (3, 5, 16), (4, 5, 2048), (1, 6, 16)])
def test_dense_groups_lose_no_link(spark, monkeypatch, least, most, dense):
    monkeypatch.setattr(simhash_wide, "DENSE", dense)
    texts = []
    for seed in range(3):
        rng = random.Random(seed)
        base = [f"w{seed}x{rng.randrange(5000)}" for _ in range(300)]
        for _ in range(60):
            w = list(base)
            for _ in range(rng.randint(least, most)):
                w[rng.randrange(300)] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    sets = brute_sets(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.id: r.component for r in simhash_wide.classes(scratch.numbered(docs, "dense")).collect()}
    links = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(links) > 100
    assert sum(found[i] != found[j] for i, j in links) <= 0.01 * len(links)
    joined, smallest = defaultdict(set), brute_similar(sets, range(len(sets)))
    for i, c in found.items():
        joined[c].add(i)
    assert len(joined) >= len(smallest)  # no class holds more than verified links join


def test_small_sets_meet_whatever_their_bits(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(150):
        n = rng.randint(8, 20)
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        texts += [" ".join(base), " ".join([*base, "more"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(r.doc_id for r in simhash_wide.drop_near_copies(docs).collect())
    assert got == sorted(brute_similar(brute_sets(texts), range(len(texts))))


def test_long_texts_are_hashed_in_parts(monkeypatch):
    text = "".join(random.Random(7).choice(["a", "B", "é", " ", "\n", "\t"]) for _ in range(5000))
    whole = [simhash_wide.shingle_hashes(text, n) for n in (1, 5, 9000)]
    print_of = [simhash.fingerprint(text, n) for n in (1, 4, 9000)]
    monkeypatch.setattr(simhash, "SEGMENT", 40)
    assert all((a == simhash_wide.shingle_hashes(text, n)).all() for a, n in zip(whole, (1, 5, 9000)))
    assert print_of == [simhash.fingerprint(text, n) for n in (1, 4, 9000)]


def test_forests_connect_what_links_connect():
    rng = np.random.default_rng(5)
    fp = rng.integers(0, 1 << 64, (30, simhash_wide.WORDS), dtype=np.uint64)
    fp = np.vstack([fp, fp ^ np.uint64(1 << 5), fp ^ np.uint64(0xFF << 8)])
    place = np.zeros(len(fp), int)
    i, j, bits = simhash_wide.forests(place, fp)
    parent = list(range(len(fp)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in zip(i.tolist(), j.tolist()):
        assert find(a) != find(b)  # a forest
        parent[find(a)] = find(b)
    assert len({find(x) for x in range(90)}) == 30
    assert (bits == np.bitwise_count(fp[i] ^ fp[j]).sum(axis=1)).all()


def test_empty_and_choices(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash_wide.drop_near_copies(none).count() == 0
    assert simhash_wide.classes(scratch.numbered(none, "empty")).count() == 0
    few, many = simhash_wide.choices(1000), simhash_wide.choices(10**8)
    assert len(few[0]) < len(many[0]) and len(few) < len(many)


def test_twins_in_a_template_family_are_found(spark):
    pairs, words = 100, iter(f"w{i}" for i in range(10**6))
    some = lambda n: [next(words) for _ in range(n)]
    template, texts = some(259), []
    for _ in range(pairs):
        shared = some(15)
        texts += [" ".join(template + shared + some(30)) for _ in range(2)]
    sets = brute_sets(texts)
    share = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert share(0, 1) > 0.81 and share(0, 2) < 0.75
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id for r in simhash_wide.drop_near_copies(docs).collect()}
    assert sum(2 * k in got and 2 * k + 1 in got for k in range(pairs)) <= 4  # 1 % of pairs need not meet
    assert len(got) >= pairs - 4  # links of at most SURE bits are not verified


def test_a_refuted_pair_does_not_part_two_components(spark):
    def family(seed):
        rng = random.Random(seed)
        some = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
        left, a, b, right = some(140), some(31), some(31), some(133)
        blocks = [a, b[:1] + a[1:], b, b[:-1] + a[-1:]]  # two near copies of a text, two of another
        return [" ".join(left + block + right) for block in blocks]

    def facts(texts):
        sets, fp = brute_sets(texts), [np.array(simhash_wide.wide_fingerprint(simhash_wide.shingle_hashes(t, 5))).view(np.uint64) for t in texts]
        bits = {(i, j): int(np.bitwise_count(fp[i] ^ fp[j]).sum()) for i in range(4) for j in range(i + 1, 4)}
        cross = sorted((bits[i, j], len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8) for i in (0, 1) for j in (2, 3))
        return bits[0, 1] <= simhash_wide.SURE and bits[2, 3] <= simhash_wide.SURE and simhash_wide.SURE < cross[0][0] < cross[1][0] <= cross[-1][0] <= simhash_wide.LOOSE - 8 and not cross[0][1] and any(x[1] for x in cross)

    texts = next(t for t in map(family, range(1000)) if facts(t))  # the fewest bits are of a pair below the similarity
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.doc_id for r in simhash_wide.drop_near_copies(docs).collect()] == [0]
