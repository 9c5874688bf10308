"""Document quality by a linear-chain conditional random field over lines.

Every line (a run of bytes without line feed) is good or bad. Its features are shares of character classes, lengths,
repeated words and repeated lines, and the same of the lines before and after. The chain is fitted by maximum likelihood
on labelled documents, each of whose lines carries its document's label. Forward-backward marginals of ``good``, weighted
by line length, give a document's raw quality; a logistic map fitted on the training sample makes it a score in (0, 1)
whose 0.7 is the cut that separates the sample best.

Training sample (documented bound): TRAIN_ROWS labelled rows outside the held-out fold at most, those with the smallest
hashes, whose texts have at most LONGEST characters and MOST_LINES lines, and of these rows, in order of their hash, as many
as have TRAIN_LINES lines in all. Scoring reads every whole text: features are built for CHUNK bytes of lines at a time (a
longer line in parts between its words), and a document of more than LONG lines is scored by transfer matrices of blocks of
its lines, so what a document needs besides its text is about 100 bytes a line.

Defined results: texts without lines (null, empty, only line feeds) get the score of the sample's share of good
documents; labels that are null are ignored; with no usable labels every score is 0.5; repeated rows get a row each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import kernels
from riskloom.llm.folds import held_out

TRAIN_ROWS = 4000
TRAIN_LINES = 60_000
LONGEST = 50_000
MOST_LINES = 200
#: Bytes and lines of features built at once, and lines of a document above which it is scored in blocks.
CHUNK = 1 << 20
CHUNK_LINES = 1 << 15
LONG = 4096
CUT = 0.7
SEED = 2
STEPS = 300

_MARKS = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]
_CLASSES = 6 + len(_MARKS)
N_FEATURES = _CLASSES + 8


def _class_of_byte() -> np.ndarray:
    """0 lower, 1 upper, 2 digit, 3 white, 4 non-ASCII, 5 control, then each mark."""
    table = np.full(256, 5, np.uint8)
    table[0x61:0x7B], table[0x41:0x5B], table[0x30:0x3A], table[0x80:] = 0, 1, 2, 4
    table[[0x20, 9, 11, 12, 13]] = 3
    table[_MARKS] = np.arange(6, 6 + len(_MARKS))
    return table


CLASS_OF_BYTE = _class_of_byte()


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of each line."""
    inside = data != 10
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edges], stops[edges - 1] = inside[edges], inside[edges - 1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(stops) + 1, np.searchsorted(offsets[1:], start, "right")


def line_chunks(start: np.ndarray, end: np.ndarray):
    """(first, past) of lines whose bytes lie within CHUNK; a longer line is one by itself."""
    at = 0
    while at < len(start):
        past = min(at + CHUNK_LINES, int(np.searchsorted(end, start[at] + CHUNK, "right")))
        yield at, max(past, at + 1)
        at = max(past, at + 1)


def repeats(data: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each line's document has it more than once (but for the case of A-Z)."""
    whole = np.empty(len(start), np.uint64)
    for a, b in line_chunks(start, end):
        low, high = start[a], end[b - 1]
        if high - low > CHUNK:
            whole[a] = xxhash.xxh3_64_intdigest(kernels.ascii_lower()[data[low:high]].tobytes())
        else:
            whole[a:b] = kernels.span_hash(data[low:high], start[a:b] - low, end[a:b] - low)
    _, back, times = np.unique(whole ^ kernels.mix(doc.astype(np.uint64)), return_inverse=True, return_counts=True)
    return times[back] > 1


def features(data: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """One row of N_FEATURES per line."""
    out = np.zeros((len(start), N_FEATURES), np.float32)
    for (a, b), rows in zip(line_chunks(start, end), feature_chunks(data, start, end, doc)):
        out[a:b] = rows
    return out


def feature_chunks(data: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray):
    """The features of each of the :func:`line_chunks`."""
    again = repeats(data, start, end, doc)
    in_doc = np.log1p(np.bincount(doc, minlength=int(doc.max()) + 1 if len(doc) else 0))
    for a, b in line_chunks(start, end):
        low, high = start[a], end[b - 1]
        size = (end[a:b] - start[a:b]).astype(float)
        out = np.zeros((b - a, N_FEATURES), np.float32)
        counted = long_line(data[low:high]) if high - low > CHUNK else counts(data[low:high], start[a:b] - low, end[a:b] - low)
        of_class, words, same, marked, letters = counted
        words = np.maximum(1, words)
        out[:, :_CLASSES] = of_class / size[:, None]
        out[:, _CLASSES : _CLASSES + 2] = same / words[:, None]
        out[:, _CLASSES + 2], out[:, _CLASSES + 3], out[:, _CLASSES + 4] = marked / words, np.log1p(size), letters / words
        out[:, _CLASSES + 5], out[:, _CLASSES + 6], out[:, _CLASSES + 7] = again[a:b], in_doc[doc[a:b]], np.log1p(words)
        yield out


def counts(data: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Per line: bytes of each class, words, words equal to the one and the two before, words that end in a mark, their bytes."""
    n = len(start)
    line_of = np.repeat(np.arange(n), end - start)
    of_class = np.bincount(line_of * _CLASSES + CLASS_OF_BYTE[data[data != 10]], minlength=n * _CLASSES).reshape(n, _CLASSES)
    at, stop, _ = kernels.tokens(data, np.append(start, len(data)), "dark")
    owner = np.searchsorted(start, at, "right") - 1
    words = kernels.span_hash(data, at, stop)
    same = np.zeros((n, 2))
    for lag in (1, 2):
        if len(words) > lag:
            equal = (words[lag:] == words[:-lag]) & (owner[lag:] == owner[:-lag])
            same[:, lag - 1] = np.bincount(owner[lag:][equal], minlength=n)
    marked = (CLASS_OF_BYTE[data[stop - 1]] >= 6).astype(float) if len(stop) else np.zeros(0)
    return of_class, np.bincount(owner, minlength=n), same, np.bincount(owner, marked, minlength=n), np.bincount(owner, stop - at, minlength=n)


def long_line(data: np.ndarray):
    """:func:`counts` of one line, in parts of about CHUNK bytes cut between words."""
    of_class, total, same, marked, letters = np.zeros((1, _CLASSES)), 0, np.zeros((1, 2)), 0, 0
    at, before = 0, []
    while at < len(data):
        end = min(at + CHUNK, len(data))
        while end < len(data) and CLASS_OF_BYTE[data[end]] != 3:
            dark = np.flatnonzero(CLASS_OF_BYTE[data[end : end + CHUNK]] == 3)
            end = end + int(dark[0]) if len(dark) else min(end + CHUNK, len(data))
        for piece in range(at, end, CHUNK):
            of_class += np.bincount(CLASS_OF_BYTE[data[piece : min(piece + CHUNK, end)]], minlength=_CLASSES)
        words = data[at:end].tobytes().lower().split()
        found = before + [xxhash.xxh3_64_intdigest(w) for w in words]
        for lag in (1, 2):
            same[0, lag - 1] += sum(x == y for x, y in zip(found[max(lag, len(before)) :], found[max(lag, len(before)) - lag :]))
        total, letters = total + len(words), letters + sum(map(len, words))
        marked += sum(CLASS_OF_BYTE[w[-1]] >= 6 for w in words)
        before, at = found[-2:], end
    return of_class, np.array([total]), same, np.array([marked]), np.array([letters])


def emission(parts: np.ndarray, doc: np.ndarray, constant: float) -> np.ndarray:
    """Scores of ``good`` from each line's share for itself, for the line after it and for the line before it."""
    out = parts[:, 0].astype(float) + constant
    same = doc[1:] == doc[:-1]
    out[1:] += parts[:-1, 1] * same
    out[:-1] += parts[1:, 2] * same
    return out


class Chain:
    """Lines of many documents by position, longest document first, for recursions over all documents at once."""

    def __init__(self, doc: np.ndarray):
        ids, first, count = np.unique(doc, return_index=True, return_counts=True)
        order = np.argsort(-count, kind="stable")
        self.ids, self.first, self.count = ids[order], first[order], count[order]
        self.active = np.searchsorted(-self.count, -np.arange(1, int(self.count.max(initial=0)) + 1), "right")

    def at(self, t: int) -> np.ndarray:
        return self.first[: self.active[t]] + t


def marginals(chain: Chain, emit: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log P of each (line, state), expected moves between states, and log Z of each document. ``move``: 3 rows from start, bad, good."""
    n = len(emit)
    e = np.column_stack([np.zeros(n), emit])
    forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
    steps = len(chain.active)
    for t in range(steps):
        here = chain.at(t)
        if t == 0:
            forward[here] = e[here] + move[0]
        else:
            f = forward[here - 1]
            forward[here] = e[here] + np.logaddexp(f[:, :1] + move[1], f[:, 1:] + move[2])
    for t in range(steps - 2, -1, -1):
        there = chain.at(t + 1)
        b = backward[there] + e[there]
        backward[there - 1] = np.logaddexp(move[1:, 0] + b[:, :1], move[1:, 1] + b[:, 1:])
    last = chain.first + chain.count - 1
    log_z = np.logaddexp(forward[last, 0], forward[last, 1])
    z = np.zeros(n)
    z[np.concatenate([chain.at(t) for t in range(steps)]) if steps else []] = np.concatenate([log_z[: a] for a in chain.active]) if steps else []
    return forward + backward - z[:, None], _moves(chain, forward, backward, e, move, z), log_z


def _moves(chain, forward, backward, e, move, z) -> np.ndarray:
    out = np.zeros((3, 2))
    out[0] = np.exp(forward[chain.first] + backward[chain.first] - z[chain.first][:, None]).sum(axis=0)
    later = np.concatenate([chain.at(t) for t in range(1, len(chain.active))]) if len(chain.active) > 1 else np.zeros(0, int)
    for i in (0, 1):
        for j in (0, 1):
            out[1 + i, j] = np.exp(forward[later - 1, i] + move[1 + i, j] + e[later, j] + backward[later, j] - z[later]).sum()
    return out


def good(emit: np.ndarray, doc: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The marginal probability of ``good`` for each line, by log-odds run forward and backward."""
    out = np.empty(len(emit))
    of_line = np.bincount(doc)[doc] > LONG if len(doc) else np.zeros(0, bool)
    for d in np.unique(doc[of_line]).tolist():
        low, high = np.searchsorted(doc, d), np.searchsorted(doc, d, "right")
        out[low:high] = good_in_blocks(emit[low:high], move)
    at = np.flatnonzero(~of_line)
    chain, e = Chain(doc[at]), emit[at]
    ahead, back = np.zeros(len(at)), np.zeros(len(at))
    steps = len(chain.active)
    for t in range(steps):
        here = chain.at(t)
        ahead[here] = e[here] + (forth(ahead[here - 1], move) if t else move[0, 1] - move[0, 0])
    for t in range(steps - 2, -1, -1):
        there = chain.at(t + 1)
        back[there - 1] = backwards(back[there] + e[there], move)
    out[at] = sigmoid(ahead + back)
    return out


def forth(odds: np.ndarray, move: np.ndarray) -> np.ndarray:
    return np.logaddexp(odds + move[2, 1], move[1, 1]) - np.logaddexp(odds + move[2, 0], move[1, 0])


def backwards(odds: np.ndarray, move: np.ndarray) -> np.ndarray:
    return np.logaddexp(odds + move[2, 1], move[2, 0]) - np.logaddexp(odds + move[1, 1], move[1, 0])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0, -x))


def good_in_blocks(emit: np.ndarray, move: np.ndarray) -> np.ndarray:
    """:func:`good` of one document: all blocks of lines advance together, between known log-odds at their ends."""
    n, rest = len(emit), len(emit) - 1
    width = max(1, int(rest**0.5))
    blocks = -(-rest // width)
    e = np.zeros((blocks, width))
    e.ravel()[:rest] = emit[1:]
    inside = np.arange(width) < np.minimum(width, rest - np.arange(blocks) * width)[:, None]
    step = np.exp(move[1:] - move[1:].max())
    through = np.tile(np.eye(2), (blocks, 1, 1))
    for t in range(width):
        weight = np.exp(np.column_stack([np.minimum(0, -e[:, t]), np.minimum(0, e[:, t])]))
        after = through @ step * weight[:, None, :]
        through = np.where(inside[:, t, None, None], after / after.max(axis=(1, 2), keepdims=True), through)
    with np.errstate(divide="ignore"):
        log = np.log(through)
    first = emit[0] + move[0, 1] - move[0, 0]
    ahead, back = np.empty(blocks), np.zeros(blocks + 1)
    odds = first
    for b in range(blocks):
        ahead[b] = odds
        odds = np.logaddexp(log[b, 0, 1], log[b, 1, 1] + odds) - np.logaddexp(log[b, 0, 0], log[b, 1, 0] + odds)
    for b in range(blocks - 1, -1, -1):
        back[b] = np.logaddexp(log[b, 1, 0], log[b, 1, 1] + back[b + 1]) - np.logaddexp(log[b, 0, 0], log[b, 0, 1] + back[b + 1])
    out = np.empty((blocks, width))
    for t in range(width):
        ahead = e[:, t] + forth(ahead, move)
        out[:, t] = ahead
    odds = back[1:]
    for t in range(width - 1, -1, -1):
        out[:, t] = np.where(inside[:, t], sigmoid(out[:, t] + odds), 0)
        odds = np.where(inside[:, t], backwards(odds + e[:, t], move), odds)
    return np.concatenate([[sigmoid(first + back[0])], out.ravel()[: n - 1]])


class Model:
    def __init__(self, samples: list[tuple[str, int]]):
        self.ready = len({y for _, y in samples}) == 2
        self.share = float(np.mean([y for _, y in samples])) if samples else 0.5
        if not self.ready:
            return
        parts, first = [], 0
        whole = pa.record_batch([pa.array([t for t, _ in samples], pa.large_string())], ["text"])
        for part in kernels.slices(whole, "text", CHUNK):
            data, offsets = kernels.text_buffer(part.column("text"))
            start, end, doc = lines(data, offsets)
            parts.append((features(data, start, end, doc), doc + first, (end - start).astype(float)))
            first += part.num_rows
        x, doc, size = (np.concatenate(p) for p in zip(*parts))
        del parts
        self.mean, self.scale = x.mean(axis=0, dtype=float).astype(np.float32), (x.std(axis=0, dtype=float) + 1e-3).astype(np.float32)
        x = self.standard(x)
        y = np.array([q for _, q in samples])
        self.fit(x, doc, y)
        quality, has = self.raw_quality(emission(x @ self.weights, doc, self.constant), doc, size, len(samples))
        self.calibrate(quality[has], y[has])

    def standard(self, raw: np.ndarray) -> np.ndarray:
        raw -= self.mean
        raw /= self.scale
        return np.clip(raw, -5, 5, out=raw)

    def fit(self, x: np.ndarray, doc: np.ndarray, y: np.ndarray) -> None:
        """Adam on the mean log-likelihood per line, with a ridge. ``x`` is used for a line, its next and its previous one."""
        chain, label = Chain(doc), y[doc]
        truth = np.zeros((3, 2))
        firsts = np.zeros(len(doc), bool)
        firsts[chain.first] = True
        for s in (0, 1):
            truth[0, s], truth[1 + s, s] = (firsts & (label == s)).sum(), (~firsts & (label == s)).sum()
        k = 3 * N_FEATURES
        theta = np.zeros(k + 7)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        same = doc[1:] == doc[:-1]
        off = np.zeros((len(doc), 3), np.float32)
        for step in range(1, STEPS + 1):
            w, move = theta[:k].reshape(3, N_FEATURES).T.astype(np.float32), theta[-6:].reshape(3, 2)
            log_p, moves, _ = marginals(chain, emission(x @ w, doc, theta[k]), move)
            off[:, 0] = label - np.exp(log_p[:, 1])
            off[:-1, 1], off[1:, 2] = off[1:, 0] * same, off[:-1, 0] * same
            grad = np.concatenate([(x.T @ off).T.ravel(), [off[:, 0].sum(dtype=float)], (truth - moves).ravel()]) / len(doc) - 1e-3 * theta
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            theta = theta + 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.weights, self.constant, self.move = theta[:k].reshape(3, N_FEATURES).T.astype(np.float32), float(theta[k]), theta[-6:].reshape(3, 2)

    def raw_quality(self, emit: np.ndarray, doc: np.ndarray, size: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Length-weighted mean marginal of ``good`` as log-odds, and which documents have lines."""
        weight = np.bincount(doc, size, minlength=n)
        q = np.bincount(doc, good(emit, doc, self.move) * size, minlength=n) / np.maximum(weight, 1)
        q = np.clip(q, 1e-6, 1 - 1e-6)
        return np.log(q / (1 - q)), weight > 0

    def calibrate(self, quality: np.ndarray, y: np.ndarray) -> None:
        """Logistic map by Newton steps, then shifted so that the sample's best cut is CUT."""
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * quality + b)))
            z = np.column_stack([quality, np.ones_like(quality)])
            hess = (z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
            a, b = np.array([a, b]) + np.linalg.solve(hess, z.T @ (y - p) - 1e-3 * np.array([a, b]))
        a = max(a, 1e-2)
        order = np.argsort(quality, kind="stable")
        q, good = quality[order], y[order]
        right = np.concatenate([[0], np.cumsum(1 - good)]) + (good.sum() - np.concatenate([[0], np.cumsum(good)]))
        edges = np.concatenate([[q[0] - 1], (q[1:] + q[:-1]) / 2, [q[-1] + 1]])
        cut = edges[int(np.argmax(right))]
        self.slope, self.shift = float(a), float(np.log(CUT / (1 - CUT)) - a * cut)

    def score(self, column: pa.Array) -> np.ndarray:
        data, offsets = kernels.text_buffer(column)
        out = np.full(len(column), self.share)
        if not self.ready:
            return np.full(len(column), 0.5)
        start, end, doc = lines(data, offsets)
        if len(start):
            parts = np.concatenate([self.standard(x) @ self.weights for x in feature_chunks(data, start, end, doc)])
            quality, has = self.raw_quality(emission(parts, doc, self.constant), doc, (end - start).astype(float), len(column))
            out[has] = 1 / (1 + np.exp(-(self.slope * quality[has] + self.shift)))
        return out


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the bounded sample of labelled rows outside the held-out fold."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.min("quality").alias("y")).orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(TRAIN_ROWS)
    texts = docs.select("doc_id", "text").where("text is not null").where(F.length("text") <= LONGEST)
    order = (F.xxhash64(F.lit(SEED), "doc_id"), "doc_id", F.xxhash64("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y").orderBy(*order).limit(TRAIN_ROWS).collect()
    samples, left = [], TRAIN_LINES
    for r in rows:
        n = r.text.count("\n") + 1
        if n <= MOST_LINES and n <= left:
            samples.append((r.text, int(r.y)))
            left -= n
    return Model(samples)


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of each row as struct ``row``, with ``score``. Reads only ``text``."""
    row = F.struct(*keep).alias("row")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for whole in batches:
            for batch in kernels.slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(shared.value.score(batch.column("text")), pa.float64())], ["row", "score"])

    kind = docs.select(row).schema["row"].dataType.simpleString()
    return docs.select(row, F.col("text").alias("text")).mapInArrow(run, f"row {kind}, score double")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a score of at least CUT, all columns as they were."""
    whole = docs.select(F.struct(*docs.columns).alias("doc"), F.col("text").alias("text"))
    return score(whole, train(docs, labels), ["doc"]).where(F.col("score") >= CUT).select("row.doc.*")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), ["doc_id"])
    return out.select(
        "row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )
