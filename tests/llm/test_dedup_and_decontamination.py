from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import pytest

from riskloom.llm import decontaminate, exact_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_hits(docs, items, window=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        if w:
            n = min(window, len(w))
            for i in range(len(w) - n + 1):
                windows[tuple(w[i : i + n])].add(str(item))
    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (names := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= names
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = ["Alpha", "beta", "gámma", "x1", "Ünder", "zeta", "eta", "theta", "iota", "kappa"]
    prose = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ".", "!"]) for _ in range(n))
    items = [(1, prose(30)), (2, prose(13)), (3, "Only five words in here"), (4, "single"), (5, ""), (6, None), (20, prose(14))]
    docs = [(i, prose(rng.randint(0, 60))) for i in range(40)]
    docs += [(100, f"{prose(20)} {items[0][1].upper()} {prose(3)}"), (101, items[1][1].replace(" ", "--")), (102, "x only FIVE words in here y"), (103, None), (104, ""), (105, "Single!"), (106, items[6][1] * 300), (107, "singles"), (105, "Single!")]
    return docs, items


@pytest.mark.parametrize("block", [10**6, 20])
def test_hits_equal_brute_force(spark, texts, monkeypatch, block):
    docs, items = texts
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    frame = spark.createDataFrame([(d, t, None, None, 0) for d, t in docs], DOCS).withColumnRenamed("n_chars", "n_words")
    got = decontaminate.flag(frame, spark.createDataFrame(items, "item_id long, text string"), ["doc_id"]).collect()
    expected = brute_hits(docs, items)
    assert len(got) == len(docs)
    assert {r[0]: tuple(r[1:]) for r in got} == expected


def test_decontamination_of_empty_tables(spark, texts):
    docs, items = texts
    none = spark.createDataFrame([], "item_id long, text string")
    frame = spark.createDataFrame([(d, t) for d, t in docs], "doc_id long, text string")
    assert decontaminate.flag(frame, none, ["doc_id"]).where("contaminated").count() == 0
    assert decontaminate.flag(frame.limit(0), none, ["doc_id"]).count() == 0
    clean = decontaminate.drop_contaminated(frame.withColumnRenamed("doc_id", "row"), spark.createDataFrame(items, "item_id long, text string"))
    assert clean.columns == ["row", "text"] and 0 < clean.count() < len(docs)


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(2)
    long = "".join(rng.choice("abcdeÉ \n") for _ in range(9000))
    base = ["", None, "A", "a", "Ab", "aB", "abc" * 40, "ABC" * 40, long, long.upper().replace("É", "É"), long + "x", long[:-1] + "y", "É", "é", "q" * 64, "q" * 65, "Q" * 64, "q" * 576, "q" * 577]
    rows = [(i, t) for i, t in enumerate(base * 2)] + [(500, "same row"), (500, "same row"), (None, "no id"), (None, "no id"), (9, "No Id")]
    return rows + [(1000 + i, "hot " * 30) for i in range(200)]


def test_classes_equal_brute_force(spark, copies):
    groups = defaultdict(list)
    for doc, text in copies:
        groups[lower(text)].append(doc)
    frame = spark.createDataFrame(copies, "doc_id long, text string").withColumn("gid", exact_dedup.F.lit("clash")).withColumn("digit", exact_dedup.F.lit(1))
    got = exact_dedup.classes(frame, ["doc_id", "gid", "digit", "text"]).collect()
    assert len(got) == len(copies)
    kept = defaultdict(int)
    for r in got:
        group = groups[lower(r.row.text)]
        assert r.keep_id == max((d for d in group if d is not None), default=None)
        assert r.group_size == len(group)
        kept[lower(r.row.text)] += r.kept
        assert not r.kept or r.row.doc_id == r.keep_id
        assert r.text_sha256 == hashlib.sha256(lower(r.row.text).encode()).hexdigest()
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_digits_sent_in_many_parts_and_wide_levels(spark, copies, monkeypatch):
    frame = spark.createDataFrame(copies, "doc_id long, text string").repartition(3)
    look = lambda: sorted(map(str, exact_dedup.classes(frame, ["doc_id"]).drop("kept").collect()))
    whole = look()
    monkeypatch.setattr(exact_dedup, "HELD", 100)
    monkeypatch.setattr(exact_dedup, "WIDEST", 1024)
    assert look() == whole


def test_drop_copies_keeps_columns_and_empty_tables(spark, copies):
    frame = spark.createDataFrame([(d, t, "x") for d, t in copies], "doc_id long, text string, n string")
    out = exact_dedup.drop_copies(frame)
    assert out.columns == frame.columns
    assert out.count() == len({lower(t) for _, t in copies})
    assert exact_dedup.drop_copies(frame.limit(0)).count() == 0
