from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from riskloom.llm import components, mixing, url_filter


def water_filled(sizes, weights=(1, 2, 3), cap=3):
    """Targets by sharing again and again until no source is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = sum(sizes.values()), set(names), {}
    while free:
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if share * weight[s] > cap * sizes[s]}
        if not over:
            out |= {s: share * weight[s] for s in free}
            break
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= over
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        source = rng.choice(["a", "b", "Z", "é", None, "", "tiny"]) if i % 3 else "a"
        if source == "tiny" and i > 60:
            source = "b"
        rows.append((i, " \t".join("w" * rng.randint(1, 4) for _ in range(rng.randint(0, 60))), source))
    rows += [(7, "again and again", "b")] * 3 + [(900, None, "empty"), (None, "no id", None), (901, "w " * 5000, "long")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("block", F.lit(1))


def test_targets_and_words(spark, docs):
    rows, target, units = mixing.prepare(docs, ["doc_id"])
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    expected = water_filled(sizes)
    got = {(None if r.no_src else r.src): r.target for r in target.collect()}
    assert got.keys() == expected.keys()
    assert all(abs(got[s] - expected[s]) < 1e-6 for s in got)
    taken = defaultdict(int)
    for r in mixing.with_words(rows, units).groupBy("no_src", "src").agg(F.sum("words").alias("w")).collect():
        taken[None if r.no_src else r.src] = r.w
    assert all(abs(taken[s] - expected[s]) <= 1 for s in expected)


@pytest.fixture
def small(monkeypatch):
    """Blocks and shards small enough that a few hundred documents make many of them."""
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 40)
    monkeypatch.setattr(mixing, "SHARD_WORDS", 2000)
    monkeypatch.setattr(mixing, "BUCKET", 8)


def test_tree_shares_units_evenly_and_disjointly(spark, docs, small):
    _, target, units = mixing.prepare(docs, ["doc_id"])
    rows = units.collect()
    assert len({(r.src, r.no_src, r.block, r["pass"]) for r in rows}) == len(rows) > 200
    shards = Counter(r.shard for r in rows)
    words = target.agg(F.sum("target")).first()[0]
    assert set(shards) == set(range(2 ** math.ceil(math.log2(words / 2000)))) and max(shards.values()) - min(shards.values()) <= 1
    again = mixing.prepare(docs, ["doc_id"])[2]
    assert again.exceptAll(units).isEmpty() and units.exceptAll(again).isEmpty()


def test_splits_follow_the_hypergeometric_law(spark):
    units = spark.createDataFrame([(s, False, i, 1) for s, n in (("a", 12), ("b", 28)) for i in range(n)], "src string, no_src boolean, block long, pass long").cache()
    lefts = []
    for seed in range(40):
        left = mixing.splitting_tree(units, 1, seed).where("shard = 0").collect()
        assert len(left) == 20
        lefts.append(sum(r.src == "a" for r in left))
    mean = sum(lefts) / len(lefts)
    assert abs(mean - 6) < 0.8  # 12 * 20 / 40, standard error 0.23
    assert 0.6 < sum((x - mean) ** 2 for x in lefts) / len(lefts) < 5  # 12 * .3 * .7 * ... = 2.15


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_query_takes_what_the_shards_take(spark, docs, small, monkeypatch, tmp_path, broadcast):
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", broadcast)
    docs.drop("size", "block").write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.op1_mixing(spark, str(tmp_path)).collect()
    again = mixing.op1_mixing(spark, str(tmp_path)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    expected = sorted((str(r.doc_id), len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in docs.collect())
    assert sorted((str(r.doc_id), r.size) for r in got) == expected
    assert all(0 <= r.taken <= 3 * r.size and (r.taken > 0) <= (r.n_shards > 0) and (r.n_shards > 0) == (r.first_shard is not None) for r in got)
    by_target = defaultdict(int)
    for r in got:
        by_target[r.source_size, r.target] += r.taken
    assert all(abs(taken - target) <= 1 for (_, target), taken in by_target.items())
    assert max(r.n_shards for r in got) > 1 and len({r.first_shard for r in got}) > 8


def test_many_sources(spark):
    many = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w "), F.expr("repeat('x ', cast(id % 7 as int))")).alias("text"), F.format_string("s%06d", F.col("id") % 20_000).alias("source"))
    _, target, units = mixing.prepare(many, ["doc_id"])
    sizes = {r.src: r.source_size for r in target.collect()}
    expected = water_filled(sizes)
    assert len(sizes) == 20_000 and all(abs(r.target - expected[r.src]) < 1e-6 for r in target.collect())
    assert units.select("src").distinct().count() <= 20_000


def test_mix_returns_documents_and_handles_clashes(spark, docs):
    out = mixing.mix(docs.withColumn("mix_shard", F.lit("x")))
    assert out.columns[: len(docs.columns)] == docs.columns and "mix_shard_" in out.columns
    most = out.where("doc_id = 901").agg(F.sum("mix_words")).first()[0]
    assert most <= 3 * 5000
    assert mixing.mix(docs.limit(0)).count() == 0


def brute_rule(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fit = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return host, path, max(fit, key=lambda r: (len(r[1] + r[2]), r[0] == "allow"), default=None)


LINK = '<html><head><link rel="canonical" href="{}"></head>'
PAGES = [
    (1, "http://a.org/x", LINK.format("https://b.org/y")),
    (2, "https://b.org/y?q=1", None),
    (3, "https://b.org/y", '<META http-equiv="refresh" content="0; URL=http://bad.net/fr/1">'),
    (4, "http://bad.net/fr/1#top", ""),
    (5, "http://c.org/", LINK.format("/d")),
    (6, "http://c.org/d", LINK.format("//www.example.com/en/ok")),
    (7, "http://c.org/d/e", LINK.format("http://q.example.com/en/bad")),
    (8, "http://q.example.com/en/bad", LINK.format("http://c.org/d")),
    (9, None, LINK.format("http://bad.net/fr/1")),
    (10, "no scheme", LINK.format("http://bad.net/fr/1")),
    (11, "HTTP://EXAMPLE.com", "x"),
    (12, "http://example.com/EN/", "x"),
    (13, "http://notexample.com/en/?a=/://b", "x"),
    (13, "http://www.example.com/en/z", "x"),
    (14, "http://alone.org/", LINK.format("http://alone.org/")),
]


@pytest.mark.parametrize("literal", [200, 0])
def test_verdicts(spark, monkeypatch, literal):
    monkeypatch.setattr(url_filter, "LITERAL_RULES", literal)
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("node", F.lit(3))
    got = {(r.page_id, r.host + r.path): r for r in url_filter.verdicts(pages).collect()}
    assert len(got) == len(PAGES)
    for page, url, _ in PAGES:
        host, path, rule = brute_rule(url, url_filter.RULES)
        row = got[page, host + path]
        assert row.rule == (rule and rule[1] + rule[2])
        if rule:
            assert row.verdict == rule[0]
    said = {k[0]: r.verdict for k, r in got.items() if k[0] != 13}
    assert said[1] == said[3] == "block"  # aliases of bad.net/fr/1
    assert said[2] == "allow"  # another query string is another url
    assert said[5] == said[6] == said[7] == "allow"  # their component holds an explicit allow
    assert said[8] == "block" and said[9] == said[10] == said[14] == "allow"


def test_redirect_table_and_empty_pages(spark):
    pages = spark.createDataFrame([(1, "http://x.org/1", None)], "page_id long, url string, html string")
    moves = spark.createDataFrame([("http://x.org/1", "http://z.net/es/2"), (None, "http://z.net/es/2")], "from_url string, to_url string")
    assert url_filter.verdicts(pages, redirects=moves).first().verdict == "block"
    assert url_filter.verdicts(pages.limit(0)).count() == 0


def test_components_equal_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, 1000 + i) for i in range(1, 60)] + [(2000 + i, 2001 + i) for i in range(40)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    smallest = {}
    for x in parent:
        smallest[find(x)] = min(smallest.get(find(x), x), x)
    assert got == {x: smallest[find(x)] for x in parent}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
