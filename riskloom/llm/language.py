"""Language identification by rank-order n-gram profiles.

A profile is the PROFILE most frequent n-grams (1 to 3 letters, words padded by a boundary, n-grams never span words) in
order of count, then of code. A document's language is the one with the smallest sum of out-of-place distances: the
difference of ranks, or PROFILE for an n-gram that the language's profile lacks. An n-gram's code is made of the code points
of its letters, so all scripts are told apart; profiles are kept as sorted codes with the languages and ranks of each.

Training sample (documented bound): rows outside the held-out fold with a language, of each language the ROWS_PER_LANGUAGE
of the smallest hashes among texts of at most LONGEST characters, and if it has fewer of those, up to ROWS_LONG longer ones
of at most LONGEST_OF_ALL characters; of these, language by language in turn, ROWS_TOTAL rows. A language whose every text
is longer than that, and one past the ROWS_TOTAL first by name, is not learned. Prediction reads every whole text, counted in
parts of PART symbols.

Defined results: ``und`` with score 0 where the text is null or has no letter, or where nothing could be learned; ties go
to the first language by name; the score is 1 minus the share of the largest possible distance.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.llm import scratch
from riskloom.llm.folds import held_out, uniform

PROFILE = 400
ROWS_PER_LANGUAGE = 600
ROWS_LONG = 5
ROWS_TOTAL = 20_000
LONGEST = 10_000
LONGEST_OF_ALL = 1_000_000
SEED = 9
#: Languages whose counts are broadcast at most.
BROADCAST_ROWS = 200_000
PART = 1 << 20
#: Code points.
SPACE = 0x110000


@cache
def is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(SPACE)), bool, SPACE)


def symbols(text: str) -> np.ndarray:
    """The text's code points in lower case, 0 for what is no letter; one 0 stands before, between and after words."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    s = np.zeros(len(points) + 2, np.uint32)
    np.multiply(points, is_letter()[points], out=s[1:-1])
    return s[np.concatenate([[True], (s[1:] > 0) | (s[:-1] > 0)])]


def grams(s: np.ndarray) -> np.ndarray:
    """Codes of the n-grams that start at the symbols of ``s`` but for the last two, which only end some."""
    s = s.astype(np.int64)
    pair = s[:-1] * SPACE + s[1:]
    three = pair[:-1] * SPACE + s[2:]
    return np.concatenate([s[:-2][s[:-2] > 0], pair[:-1][pair[:-1] > 0] + SPACE, three[s[1:-1] > 0] + SPACE + SPACE * SPACE])


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(codes in order, counts) of a text's n-grams."""
    s = np.concatenate([symbols(text), np.zeros(1, np.uint32)])
    codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for at in range(0, max(1, len(s) - 2), PART):
        codes, counts = merged([(codes, counts), np.unique(grams(s[at : at + PART + 2]), return_counts=True)])
    return codes, counts


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    parts = [p for p in parts if len(p[0])]
    if len(parts) < 2:
        return parts[0] if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    codes, back = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(back, np.concatenate([n for _, n in parts])).astype(np.int64)


def top(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The PROFILE most frequent codes in order of count, then code."""
    return codes[np.argsort(-counts, kind="stable")[:PROFILE]]


class Model:
    def __init__(self, samples: list[tuple[str, str]]):
        texts: dict[str, list[str]] = {}
        for lang, text in samples:
            texts.setdefault(lang, []).append(text)
        self.languages = sorted(texts)
        profiles = []
        for lang in self.languages:
            total, some = (np.zeros(0, np.int64), np.zeros(0, np.int64)), []
            for text in texts[lang]:
                some.append(counted(text))
                if sum(len(c) for c, _ in some) > PART:
                    total, some = merged([total, *some]), []
            profiles.append(top(*merged([total, *some])))
        code = np.concatenate(profiles) if profiles else np.zeros(0, np.int64)
        lang = np.repeat(np.arange(len(profiles)), [len(p) for p in profiles]).astype(np.int64)
        rank = np.concatenate([np.arange(len(p)) for p in profiles]) if profiles else np.zeros(0, np.int64)
        order = np.argsort(code, kind="stable")
        self.codes, first = np.unique(code[order], return_index=True)
        self.first, self.lang, self.rank = np.append(first, len(code)), lang[order], rank[order]

    def distances(self, own: np.ndarray) -> np.ndarray:
        """The out-of-place distance of each language to a document's n-grams in order."""
        out = np.full(len(self.languages), PROFILE * len(own), np.int64)
        if len(self.codes):
            at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
            place = np.flatnonzero(self.codes[at] == own)
            low, high = self.first[at[place]], self.first[at[place] + 1]
            rows = np.repeat(low - np.cumsum(high - low) + (high - low), high - low) + np.arange(int((high - low).sum()))
            nearer = np.abs(self.rank[rows] - np.repeat(place, high - low)) - PROFILE
            np.add.at(out, self.lang[rows], nearer)
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        codes, counts = counted(text or "")
        if not len(codes) or not self.languages:
            return "und", 0.0
        own = top(codes, counts)
        distance = self.distances(own)
        best = int(np.argmin(distance))
        return self.languages[best], float(1 - distance[best] / (PROFILE * len(own)))


def train(docs: DataFrame) -> Model:
    """Fit on the bounded sample; reads ``doc_id, lang, text``.

    A hash of the id leaves about twice the wanted rows of each language and length before any is ordered or moved, so a
    hot language is no task of its own.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "doc_id", "text")
    size = F.length("text")
    usable = rows.where(size <= LONGEST_OF_ALL).withColumn("long", size > LONGEST)
    counts = scratch.stage(usable.groupBy("lang", "long").agg(F.count(F.lit(1)).alias("n")), "language-counts")
    few = counts.count() <= BROADCAST_ROWS
    near = usable.join(F.broadcast(counts) if few else counts.hint("merge"), ["lang", "long"]).where(uniform(F.col("doc_id"), SEED) * F.col("n") < 2 * ROWS_PER_LANGUAGE)
    order = W.partitionBy("lang").orderBy("long", F.xxhash64(F.lit(SEED), F.col("doc_id").cast("string"), "text"))
    in_language = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= ROWS_PER_LANGUAGE)
    sample = in_language.where(~F.col("long") | (F.col("place") <= ROWS_LONG)).orderBy("place", "lang").limit(ROWS_TOTAL)
    return Model([(r.lang, r.text) for r in sample.select("lang", "text").collect()])


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of each row as struct ``row``, with ``lang_pred`` and ``score``. Reads only ``text``."""
    row = F.struct(*keep).alias("row")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            found = [shared.value.predict(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["row", "lang_pred", "score"],
            )

    kind = docs.select(row).schema["row"].dataType.simpleString()
    return docs.select(row, F.col("text").alias("text")).mapInArrow(run, f"row {kind}, lang_pred string, score double")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict(docs, train(docs), ["doc_id"])
    return out.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")
