from __future__ import annotations

import itertools
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskloom.llm import kernels, language, quality


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(4)
    doc = np.array([0, 0, 0, 1, 3, 3, 3, 3])
    emit, move = rng.normal(size=len(doc)), rng.normal(size=(3, 2))
    log_p, moves, log_z = quality.marginals(quality.Chain(doc), emit, move)
    expected, crossed, zs = np.zeros((len(doc), 2)), np.zeros((3, 2)), {}
    for d in set(doc):
        at = np.flatnonzero(doc == d)
        paths = []
        for path in itertools.product((0, 1), repeat=len(at)):
            s = move[0, path[0]] + sum(emit[i] * y for i, y in zip(at, path)) + sum(move[1 + a, b] for a, b in zip(path, path[1:]))
            paths.append((path, math.exp(s)))
        z = sum(p for _, p in paths)
        zs[d] = math.log(z)
        for path, p in paths:
            for i, y in zip(at, path):
                expected[i, y] += p / z
            crossed[0, path[0]] += p / z
            for a, b in zip(path, path[1:]):
                crossed[1 + a, b] += p / z
    assert np.allclose(np.exp(log_p), expected) and np.allclose(moves, crossed)
    chain = quality.Chain(doc)
    assert np.allclose(log_z, [zs[d] for d in chain.ids])


@pytest.mark.parametrize("n", [2, 3, 10, 50, 401])
def test_blocks_of_lines_equal_the_chain(n):
    rng = np.random.default_rng(n)
    emit, move = rng.normal(scale=8, size=n + 5), rng.normal(size=(3, 2))
    doc = np.concatenate([np.zeros(5, int), np.ones(n, int)])
    exact = np.exp(quality.marginals(quality.Chain(doc), emit, move)[0][:, 1])
    assert np.allclose(quality.good(emit, doc, move), exact)
    assert np.allclose(quality.good_in_blocks(emit[5:], move), exact[5:])


def brute_features(text):
    """The documented features of each line, in plain Python."""
    rows, found = [], [x for x in (text or "").encode().split(b"\n") if x]
    for line in found:
        words = line.split()
        low = [w.lower() for w in words]
        row = [0.0] * quality._CLASSES
        for b in line:
            row[quality.CLASS_OF_BYTE[b]] += 1 / len(line)
        n = max(1, len(words))
        row += [sum(low[i] == low[i - lag] for i in range(lag, len(low))) / n for lag in (1, 2)]
        row += [sum(quality.CLASS_OF_BYTE[w[-1]] >= 6 for w in words) / n, math.log1p(len(line)), sum(map(len, words)) / n]
        rows.append([*row, sum(x.lower() == line.lower() for x in found) > 1, math.log1p(len(found)), math.log1p(n)])
    return found, rows


def test_scores_equal_plain_python(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(50)
    model = quality.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    texts = [r.text for r in docs.collect()] + ["a b a b\nA B A B\n\n c.\td! " + "word " * 80, "x" * 300 + " y y z z", "a\nb\n" * 40]

    def score(text):
        found, rows = brute_features(text)
        if not found:
            return model.share
        z = [[min(5, max(-5, (x - m) / s)) for x, m, s in zip(r, model.mean.tolist(), model.scale.tolist())] for r in rows]
        dot = lambda i, k: sum(x * w for x, w in zip(z[i], model.weights[:, k].tolist())) if 0 <= i < len(z) else 0
        e = [dot(i, 0) + dot(i - 1, 1) + dot(i + 1, 2) + model.constant for i in range(len(z))]
        add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
        move = model.move.tolist()
        ahead = [[move[0][0], move[0][1] + e[0]]]
        for x in e[1:]:
            ahead.append([add(ahead[-1][0] + move[1][s], ahead[-1][1] + move[2][s]) + s * x for s in (0, 1)])
        back = [[0.0, 0.0]]
        for x in e[:0:-1]:
            back.insert(0, [add(move[1 + s][0] + back[0][0], move[1 + s][1] + x + back[0][1]) for s in (0, 1)])
        p = [1 / (1 + math.exp(min(700, f[0] + b[0] - f[1] - b[1]))) for f, b in zip(ahead, back)]
        q = min(1 - 1e-6, max(1e-6, sum(a * len(b) for a, b in zip(p, found)) / sum(map(len, found))))
        return 1 / (1 + math.exp(-(model.slope * math.log(q / (1 - q)) + model.shift)))

    column = pa.array(texts, pa.string())
    expected = [score(t) for t in texts]
    assert np.allclose(model.score(column), expected, atol=2e-3)
    monkeypatch.setattr(quality, "CHUNK", 64)
    monkeypatch.setattr(quality, "LONG", 5)
    assert np.allclose(model.score(column), expected, atol=2e-3)


def test_lines_never_cross_documents():
    data, offsets = kernels.text_buffer(pa.array(["ab\n\ncd", None, "ef", "\n\n", "\ng"]))
    start, end, doc = quality.lines(data, offsets)
    assert [(data[s:e].tobytes(), d) for s, e, d in zip(start, end, doc)] == [(b"ab", 0), (b"cd", 0), (b"ef", 2), (b"g", 4)]


def test_quality_on_held_out_documents(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{big}/labels.parquet").withColumnRenamed("quality", "q")
    got = quality.op2_quality(spark, big)
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.q for r in rows) / len(rows) > 0.9
    assert all(r.predicted == int(r.score >= 0.7) for r in rows)


def test_quality_edge_cases(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "\n"), (None, "x"), (5, "y" * 300_000), (5, "y" * 300_000), (6, "a b\n" * 20_000)], "doc_id long, text string")
    odd = odd.withColumn("row", F.lit("clash")).withColumn("score", F.lit("clash"))
    out = quality.score(odd, model, odd.columns).collect()
    assert len(out) == 7 and all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in out if r.row.text in (None, "", "\n")} == {model.share}
    assert quality.keep_good(odd, labels.limit(0)).count() == 0
    assert quality.keep_good(docs.limit(0), labels).columns == docs.columns
    unlabelled = quality.train(docs, labels.withColumn("quality", F.lit(None).cast("int")))
    assert {r.score for r in quality.score(odd, unlabelled, ["doc_id"]).collect()} == {0.5}


def slow_grams(text):
    """Padded words' n-grams of 1 to 3 letters, counted one by one."""
    out = []
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        padded = f" {word} "
        out += list(word) + [padded[i : i + 2] for i in range(len(padded) - 1)]
        out += [padded[i : i + 3] for i in range(len(padded) - 2)]
    return out


@pytest.mark.parametrize("text", ["Ab, cé!", "", " a ", "one two  three", "日本 x", "ab" * 30])
@pytest.mark.parametrize("part", [1 << 20, 3])
def test_grams_equal_slow_grams(monkeypatch, text, part):
    monkeypatch.setattr(language, "PART", part)
    code = lambda g: sum((0 if c == " " else ord(c)) * language.SPACE ** (len(g) - 1 - i) for i, c in enumerate(g)) + sum(language.SPACE**i for i in range(1, len(g)))
    codes, counts = language.counted(text)
    assert dict(zip(codes.tolist(), counts.tolist())) == Counter(map(code, slow_grams(text)))


def test_predictions_equal_plain_distances(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    samples = [(r.lang, r.text) for r in rows[:80] if r.lang and r.text]
    samples += [("ru", "съешь ещё этих мягких французских булок"), ("uk", "щастям б'єш жук їх глицю в фон й ґедзь пріч"), ("el", "ξεσκεπάζω την ψυχοφθόρα βδελυγμία")]
    model = language.Model(samples)
    order = lambda g: tuple(0 if c == " " else ord(c) for c in g)

    def profile(texts):
        counts = Counter(g for t in texts for g in slow_grams(t))
        return sorted(counts, key=lambda g: (-counts[g], len(g), order(g)))[: language.PROFILE]

    profiles = {lang: {g: i for i, g in enumerate(profile([t for x, t in samples if x == lang]))} for lang in sorted({x for x, _ in samples})}
    for text in [r.text for r in rows[80:130]] + ["мягких булок", "їх жук", "την", "zz"]:
        own = profile([text or ""])
        far = {lang: sum(abs(i - p[g]) if g in p else language.PROFILE for i, g in enumerate(own)) for lang, p in profiles.items()}
        got = model.predict(text)
        if not own:
            assert got == ("und", 0.0)
            continue
        best = min(far, key=lambda x: (far[x], x))  # ties: the first by name
        assert got[0] == best and abs(got[1] - (1 - far[best] / (language.PROFILE * len(own)))) < 1e-12


def test_every_language_is_learned(spark):
    rows = [(i, f"{chr(0x4E00 + i)}{chr(0x4E01 + i)} " * 3, f"l{i:04d}") for i in range(1500)] + [(5000 + i, "ж" * 20_000, "long") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs)
    assert len(model.languages) > 1000 and "long" in model.languages
    assert model.predict("ж")[0] == "long"


def test_language_on_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    got = language.op9_language(spark, sf_dir.replace("sf0.001", "sf0.01")).join(docs, "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97


def test_language_edge_cases(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.train(docs)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "the and of"), (4, "the and of"), (5, "ж" * 200_000)], "doc_id long, text string").withColumn("row", F.lit(0))
    out = language.predict(odd, model, ["doc_id"]).collect()
    assert {r.row.doc_id for r in out if r.lang_pred == "und"} == {1, 2, 3}
    assert len(out) == 6 and all(0 <= r.score <= 1 for r in out)
    nothing = language.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language.predict(odd, nothing, ["doc_id"]).collect()} == {"und"}
    assert language.predict(odd.limit(0), model, ["doc_id"]).count() == 0
