"""A quality classifier: random-indexing word vectors, pooled for each document, and a small network with calibrated odds.

Every word (a run of letters, of digits or of signs; all capitals are one word, as are all numbers, and signs go by their last) falls into one of VOCABULARY
buckets. A bucket has a sparse index vector of NONZERO places with signs, and its context vector is the sum of the index vectors of its neighbours
within WINDOW words over the whole corpus: counts are whole numbers, so tables add up in any order. A document is pooled to the mean and deviation of its words'
unit vectors, how alike neighbours are, and its length. A network of two layers learns from at most MOST_LABELLED labelled documents; a fifth of them
sets the temperature that its odds are divided by.

Null and empty texts have no words: all their features are zero, and their score is the network's for that. Rows without doc_id count as held out.
Repeated rows score the same; without labels of both kinds every score is 0.5. Columns besides ``doc_id`` and ``text`` are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY, DIM, NONZERO, WINDOW = 8192, 64, 4, 2
MOST_LABELLED = 20_000
HIDDEN, EPOCHS, RATE, SEED = 24, 60, 0.01, 11
THRESHOLD = 0.3
#: Bytes of text that are worked on at once; vectors are summed in groups of buckets, by so many helpers first.
STEP, GROUPS, HELPERS = 2_000_000, 64, 256

_SPACE, _LETTER, _DIGIT, _SIGN = range(4)
_KIND = np.array([_LETTER if 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else _DIGIT if 48 <= c <= 57 else _SPACE if c == 32 or 9 <= c <= 13 else _SIGN for c in range(256)], np.uint8)
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint64)
_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))
_CAPITALS, _NUMBER = 0, 1  # buckets of their own


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each bucket's index vector."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, DIM, (VOCABULARY, NONZERO)), rng.choice([-1, 1], (VOCABULARY, NONZERO))


def buckets(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each word of a text, and where the word begins."""
    raw = np.frombuffer(data, np.uint8)
    kind = _KIND[raw]
    begin = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]])) if len(raw) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(raw)))
    if not len(begin):
        return np.zeros(0, np.int32), begin
    at = np.arange(len(raw)) - np.repeat(begin, size)
    with np.errstate(over="ignore"):
        h = np.add.reduceat((_LOWER[raw] + np.uint64(1)) * _POWERS[at % 64], begin)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    of = 2 + ((h >> np.uint64(33)) % np.uint64(VOCABULARY - 258)).astype(np.int32)
    capitals = (np.add.reduceat(((raw >= 65) & (raw <= 90)).astype(np.int32), begin) > 0) & (np.add.reduceat(((raw >= 97) & (raw <= 122)).astype(np.int32), begin) == 0) & (size > 1)
    what = kind[begin]
    of[(what == _LETTER) & capitals] = _CAPITALS
    of[what == _DIGIT] = _NUMBER
    sign = what == _SIGN
    of[sign] = VOCABULARY - 256 + raw[begin + size - 1][sign].astype(np.int32)
    words = what != _SPACE
    return of[words], begin[words]


def stretches(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the words of many texts, and the text each is of, in steps of about STEP bytes. A longer text is cut, at a blank if there is one."""
    held, of, size = [], [], 0
    for i, text in enumerate(texts):
        while text:
            cut = len(text) if len(text) <= STEP else max(text.rfind(b" ", 0, STEP), 0) or STEP
            held.append(text[:cut])
            of.append(i)
            size += cut
            text = text[cut:]
            if size >= STEP:
                yield _worded(held, of)
                held, of, size = [], [], 0
    if held:
        yield _worded(held, of)


def _worded(held: list[bytes], of: list[int]) -> tuple[np.ndarray, np.ndarray]:
    found, begin = buckets(b"\n".join(held))
    starts = np.cumsum([0, *[len(t) + 1 for t in held]])[:-1]
    return found, np.array(of, np.int64)[np.searchsorted(starts, begin, "right") - 1]


def neighbours(found: np.ndarray, doc: np.ndarray, places: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """For each bucket the sums of the index vectors of the words around its own, and last its number of words."""
    out = np.zeros((VOCABULARY, DIM + 1))
    out[:, DIM] = np.bincount(found, minlength=VOCABULARY)
    sums = np.zeros(VOCABULARY * DIM)
    for step in range(1, WINDOW + 1):
        same = doc[step:] == doc[:-step]
        a, b = found[:-step][same].astype(np.int64), found[step:][same].astype(np.int64)
        for x, y in ((a, b), (b, a)):
            for k in range(NONZERO):
                sums += np.bincount(x * DIM + places[y, k], signs[y, k], VOCABULARY * DIM)
    out[:, :DIM] = sums.reshape(VOCABULARY, DIM)
    return out


def _encoded(texts) -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]


def context_vectors(docs: DataFrame) -> np.ndarray:
    """A row of whole numbers for each bucket, over all documents: a fixed size, whatever the corpus."""

    def count(frames):
        places, signs = index_vectors()
        total = np.zeros((VOCABULARY, DIM + 1))
        for f in frames:
            for found, doc in stretches(_encoded(f["text"])):
                total += neighbours(found, doc, places, signs)
        parts = total.astype("<i8").reshape(GROUPS, -1)
        blobs = [zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(p.view(np.uint8).reshape(-1, 8).T).tobytes()) for p in parts]
        yield pd.DataFrame({"part": range(GROUPS), "helper": TaskContext.get().partitionId() % HELPERS, "sums": blobs})

    def opened(blob):
        return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1).T).view("<i8")[:, 0]

    def add(key, f):
        total = np.zeros(VOCABULARY * (DIM + 1) // GROUPS, "<i8")
        for blob in f["sums"]:
            total += opened(blob)
        return pd.DataFrame({"part": [key[0]], "helper": [0], "sums": [zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(total.view(np.uint8).reshape(-1, 8).T).tobytes())]})

    shape = "part int, helper int, sums binary"
    sums = docs.select("text").mapInPandas(count, shape).groupBy("part", "helper").applyInPandas(add, shape).groupBy("part").applyInPandas(add, shape)
    out = np.zeros((GROUPS, VOCABULARY * (DIM + 1) // GROUPS))
    for r in sums.collect():  # GROUPS rows
        out[r["part"]] = opened(r["sums"])
    return out.reshape(VOCABULARY, DIM + 1)


def unit(sums: np.ndarray) -> np.ndarray:
    """Rows of length one, less what any word's neighbours have in common; buckets without words are zero."""
    vectors, n = sums[:, :DIM], sums[:, DIM:]
    vectors = vectors - n * (vectors.sum(axis=0) / max(1.0, n.sum()))
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)


FEATURES = 2 * DIM + 2


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text."""
    n, sums, squares, alike = np.zeros(len(texts)), np.zeros((len(texts), DIM)), np.zeros((len(texts), DIM)), np.zeros(len(texts))
    for found, doc in stretches(texts):
        if not len(found):
            continue
        v = vectors[found]
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        to = doc[first]
        n[to] += np.diff(np.append(first, len(doc)))
        sums[to] += np.add.reduceat(v, first)
        squares[to] += np.add.reduceat(v * v, first)
        near = np.append(np.where(doc[1:] == doc[:-1], (v[1:] * v[:-1]).sum(axis=1), 0), 0)
        alike[to] += np.add.reduceat(near, first)
    words = np.maximum(n, 1)[:, None]
    mean = sums / words
    deviation = np.sqrt(np.maximum(squares / words - mean * mean, 0))
    return np.column_stack([mean, deviation, alike / words[:, 0], np.log1p(n)])


@dataclass
class Network:
    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.shift) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.odds(x) / self.temperature, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray) -> Network:
    """Learns from four fifths of the rows; the others choose the temperature of the least log loss."""
    net = Network(np.zeros(FEATURES), np.ones(FEATURES), np.zeros((FEATURES, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0)
    if len(set(y.tolist())) < 2:
        return net
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(y))
    apart, own = order[: len(y) // 5], order[len(y) // 5 :]
    net.shift, net.scale = x[own].mean(axis=0), x[own].std(axis=0) + 1e-3
    xs = (x - net.shift) / net.scale
    p = [rng.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    size = 64
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(own), max(1, len(own) // size)):
            h = np.tanh(xs[rows] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -50, 50))) - y[rows]) / len(rows)
            dh = np.outer(d, p[2]) * (1 - h * h)
            grads = [xs[rows].T @ dh + 1e-4 * p[0], dh.sum(axis=0), h.T @ d + 1e-4 * p[2], np.array([d.sum()])]
            t += 1
            for k, g in enumerate(grads):  # Adam
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = p[0], p[1], p[2], float(p[3][0])
    if len(apart):
        odds, want = net.odds(x[apart]), y[apart]
        tried = np.geomspace(0.25, 16, 61)
        loss = [np.logaddexp(0, -odds / s * (2 * want - 1)).mean() for s in tried]
        net.temperature = float(tried[int(np.argmin(loss))])
    return net


def held_out() -> Column:
    """Documents whose labels are never learned from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray) -> Network:
    """A network for the label ``quality``, from about MOST_LABELLED documents at most, drawn by the MD5 of their ids."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("label"))
    share = min(1.0, MOST_LABELLED / max(1, known.count()))
    drawn = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long") < int(share * 2**32)
    taught = docs.select("doc_id", "text").join(known.where(drawn), "doc_id")

    def pool(frames):
        for f in frames:
            x = pooled(_encoded(f["text"]), vectors).astype("<f8")
            yield pd.DataFrame({"doc_id": f["doc_id"], "label": f["label"], "x": [r.tobytes() for r in x]})

    rows = sorted((r["doc_id"], r["label"], bytes(r["x"])) for r in taught.select(F.col("doc_id").cast("long").alias("doc_id"), "label", "text").mapInPandas(pool, "doc_id long, label int, x binary").collect())  # a bounded sample
    x = np.array([np.frombuffer(r[2], "<f8") for r in rows]).reshape(-1, FEATURES)
    return fit(x, np.array([r[1] for r in rows], float))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each document; ``score`` is the odds that its label is 1."""
    vectors = unit(context_vectors(docs))
    net = train(docs, labels, vectors)
    sent = docs.sparkSession.sparkContext.broadcast((vectors, net))  # a fixed size

    def run(frames):
        vectors, net = sent.value
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "held_out": f["held_out"], "score": net.score(pooled(_encoded(f["text"]), vectors))})

    kind = dict(docs.dtypes)["doc_id"]
    src = docs.select(F.col("doc_id").cast("string").alias("doc_id"), held_out().alias("held_out"), "text")  # ids as texts, so that missing ones don't turn numbers into floats
    out = src.mapInPandas(run, "doc_id string, held_out boolean, score double")
    return out.select(F.col("doc_id").cast(kind).alias("doc_id"), "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
