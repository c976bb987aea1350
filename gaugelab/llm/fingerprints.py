"""Improbable-feature digests of documents.

Every window of 64 bytes, of 16 and of 8 has an entropy, and windows of a size are ranked by the rarity of that entropy. Of the windows of
64 and of 16 bytes, those next to each other compete, and the ones that win often enough are features: places that two versions of a text
choose alike, wherever they moved. Of those of 8 bytes the 32 rarest different ones of the whole text are, so that short texts, and texts of
filler, have features too; a text under 8 bytes is one feature. The same rules hold for texts of every length.

Features are put, in the order of the text, into a chain of Bloom filters of 2,048 bits for each size, a new one begun after 160 features. Two
digests are alike by the overlap of their filters' bits, less what chance gives, over the most that is possible. A filter looks for its partner in the
other digest's chain of its size, up to BAND filters from its own place counted from either end, so that the work grows with the text and not with its square.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, shuffle_width

WINDOW, SMALL, TINY = 64, 16, 8
CHAINS = 3
#: Usual entropy of running text in a window of so many bytes.
USUAL = {WINDOW: 4.1, SMALL: 3.3, TINY: 2.7}
#: A window is a feature if it is the rarest in this share of the runs of neighbouring windows that hold it (a run has as many windows as a window has bytes).
POPULAR = 0.25
#: So many windows of TINY bytes are features of a text, if it has as many different ones.
RAREST = 32
BITS, PER_FILTER, HASHES = 2048, 160, 5
#: About half a megabyte of text either way: what has moved further within a text is not found again.
BAND = 64

_STEPS = (np.arange(WINDOW + 1) * np.log2(np.maximum(np.arange(WINDOW + 1), 1)) * (1 << 16)).round().astype(np.int64)


def _rarity_table(usual: float) -> np.ndarray:
    """Rank of each entropy in 1/256 bit, from 1: the further from the usual one in any direction, the rarer.

    The spread is 0.25 bits. Windows of under one bit are filler (runs of one byte) and get 0: no features, but among those of TINY bytes where too few others are.
    """
    h = np.arange(6 * 256 + 1) / 256
    far = np.abs(h - usual) / 0.25
    return np.where(h < 1.0, 0, 1 + np.minimum(4000, far * 400)).astype(np.int64)


_RARITY = {w: _rarity_table(u) for w, u in USUAL.items()}
_MIX = np.random.default_rng(64).integers(1, 1 << 63, WINDOW, dtype=np.uint64) | np.uint64(1)


def _entropy(x: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Of the window at each place of ``x``, in 1/256 bit; integers, so that equal bytes give equal values anywhere."""
    n = len(x) - window + 1
    ahead = np.zeros(len(x), np.uint8)  # equal bytes among the 63 that follow
    behind = np.zeros(len(x), np.uint8)
    for k in range(1, window):
        same = (x[:-k] == x[k:]).view(np.uint8)
        ahead[:-k] += same
        behind[k:] += same
    gain = np.diff(_STEPS)
    first = np.bincount(x[:window], minlength=256)
    # moving on by one place takes a byte with ``ahead`` equals away and adds one with ``behind`` equals
    moves = gain[behind[window:]] - gain[ahead[: n - 1]]
    total = _STEPS[first].sum() + np.concatenate([[0], np.cumsum(moves)])
    return np.clip((window.bit_length() - 1) * 256 - total // (window << 8), 0, 6 * 256)


def _chosen(texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, 64-bit sum) of the features of texts of at least ``window`` bytes, in order."""
    sizes = np.array([len(t) for t in texts], np.int64)
    pad = b"\0" * (2 * window)
    x = np.frombuffer(pad + b"".join(texts) + pad, np.uint8)
    starts = 2 * window + np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0, np.int64)
    rank = _RARITY[window][_entropy(x, window)]
    n = len(rank)
    valid = np.zeros(n + 1, np.int32)
    whole = sizes >= window
    np.add.at(valid, starts[whole], 1)
    np.add.at(valid, (starts + sizes - window + 1)[whole], -1)
    inside = np.cumsum(valid[:-1]) > 0
    # the largest (rank, then leftmost) of each run; windows of one text are a run's length or more from those of the next
    best = np.where(inside & (rank > 0), (rank << 40) + (n - np.arange(n)), 0)
    span = 1
    while span < window:
        best = np.maximum(best[: len(best) - span], best[span:])
        span *= 2
    won = best[best > 0]
    at = n - (won & ((1 << 40) - 1))
    places = np.flatnonzero(np.bincount(at, minlength=n) >= POPULAR * window)
    return (np.searchsorted(starts, places, "right") - 1 if len(starts) else places), _sum_of(x, places, window)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _sum_of(x: np.ndarray, places: np.ndarray, window: int) -> np.ndarray:
    h = np.full(len(places), window, np.uint64)
    for k in range(window):
        h += (x[places + k].astype(np.uint64) + np.uint64(1)) * _MIX[k]
    return h


def _rarest(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, 64-bit hash) of the RAREST rarest different windows of TINY bytes of each text, ties by hash; of a shorter text its whole."""
    doc: list[np.ndarray] = []
    out: list[np.ndarray] = []
    for i, t in enumerate(texts):
        x = np.frombuffer(t, np.uint8)
        if len(x) < TINY:
            h = _mixed(_sum_of(x, np.zeros(1, np.int64), len(x)))[: len(x)]
        else:
            h = _mixed(_sum_of(x, np.arange(len(x) - TINY + 1), TINY))
            rank = _RARITY[TINY][_entropy(x, TINY)].astype(np.uint64)
            # rank and 51 bits of the hash in one number: smallest first
            key = np.sort(((np.uint64(8191) - rank) << np.uint64(51)) | (h >> np.uint64(13)))
            h = _mixed(key[np.concatenate([[True], key[1:] != key[:-1]])][:RAREST])
        doc.append(np.full(len(h), i))
        out.append(h)
    return np.concatenate([np.zeros(0, np.int64), *doc]), np.concatenate([np.zeros(0, np.uint64), *out])


def _features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(chain, 64-bit hash) of the features of all texts: a text's chains 3 i, 3 i + 1 and 3 i + 2 have those of WINDOW, SMALL and TINY bytes."""
    doc, h = _chosen(texts, WINDOW)
    sub, more = _chosen(texts, SMALL)
    low, least = _rarest(texts)
    doc, h = np.concatenate([CHAINS * doc, CHAINS * sub + 1, CHAINS * low + 2]), np.concatenate([_mixed(h), _mixed(more), least])
    order = np.argsort(doc, kind="stable")
    return doc[order], h[order]


class Digest(np.ndarray):
    """Filters (n, 256) of bytes; ``sizes`` has how many of them each chain has, in order."""

    sizes: tuple[int, ...] = ()


def digests(texts: list[bytes]) -> list[Digest]:
    """For each text its filters; none for an empty text, and at least one for any other."""
    chain, h = _features(texts)
    count = np.bincount(chain, minlength=CHAINS * len(texts)) if len(texts) else np.zeros(0, np.int64)
    filters = -(-count // PER_FILTER)
    base = np.concatenate([[0], np.cumsum(filters)]).astype(np.int64)
    within = np.arange(len(chain)) - np.concatenate([[0], np.cumsum(count)])[chain] if len(chain) else np.zeros(0, np.int64)
    slot = base[chain] + within // PER_FILTER if len(chain) else within
    bits = np.zeros((base[-1], BITS), bool)
    for k in range(HASHES):
        bits[slot, (h >> np.uint64(11 * k)) & np.uint64(BITS - 1)] = True
    packed = np.packbits(bits, axis=1)
    out = []
    for i, (a, b) in enumerate(zip(base[:-1:CHAINS], base[CHAINS::CHAINS])):
        out.append(packed[a:b].view(Digest))
        out[-1].sizes = tuple(filters[CHAINS * i : CHAINS * (i + 1)].tolist())
    return out


def _partners(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """For each filter of chain ``a`` the best score of a partner in chain ``b`` within the band."""
    best = np.zeros(len(a))
    p, q = len(a), len(b)
    for shift in {0, q - p}:  # places counted from the start, and from the end
        for delta in range(max(-BAND, 1 - p - shift), min(BAND, q - 1 - shift) + 1):
            lo, hi = max(0, -shift - delta), min(p, q - shift - delta)
            if lo >= hi:
                continue
            x, y, n, m = a[lo:hi], b[lo + shift + delta : hi + shift + delta], na[lo:hi], nb[lo + shift + delta : hi + shift + delta]
            chance, most = n * m / BITS, np.maximum(n, m)
            score = (np.bitwise_count(x & y).sum(1, dtype=np.int64) - chance) / np.maximum(most - chance, 1e-9)
            best[lo:hi] = np.maximum(best[lo:hi], score)
    return best


def likeness(a: Digest, b: Digest) -> float:
    """From 0 to 1: each filter of the shorter digest with its best partner in the other, weighted by its bits. Two empty texts are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    if a.shape == b.shape and (a == b).all():
        return 1.0
    x, y = np.asarray(a), np.asarray(b)
    na, nb = np.bitwise_count(x).sum(1, dtype=np.int64), np.bitwise_count(y).sum(1, dtype=np.int64)
    ends_a, ends_b = np.cumsum([0, *a.sizes]), np.cumsum([0, *b.sizes])
    best = np.concatenate([_partners(x[i:j], y[k:m], na[i:j], nb[k:m]) for i, j, k, m in zip(ends_a, ends_a[1:], ends_b, ends_b[1:])])
    return min(1.0, float((na * best).sum() / na.sum()))


def text_of(digest: np.ndarray) -> str:
    return digest.tobytes().hex()


def _edited(own: str, other: str) -> str:
    n = len(own) // 2
    return own[: len(own) - n] + other[:n]


def _reached(cuts: list[int], value: Column) -> Column:
    """How many of the sorted cuts are at most ``value``, in two steps of about the square root of their number."""
    if not cuts:
        return F.lit(0)
    m = max(1, int(len(cuts) ** 0.5))
    rough = F.size(F.filter(F.array(*[F.lit(c) for c in cuts[::m]]), lambda c: c <= value))
    near = F.slice(F.array(*[F.lit(c) for c in cuts]), F.greatest(rough - 1, F.lit(0)) * m + 1, F.lit(m))
    return F.when(rough == 0, 0).otherwise((rough - 1) * m + F.size(F.filter(near, lambda c: c <= value)))


def in_order(docs: DataFrame, doc_id: str, text: str, buckets: int | None = None) -> DataFrame:
    """Rows (bucket, doc_id, text, extra) sorted within partitions by bucket and falling doc_id, nulls last, then by a hash of the text.

    A bucket is a range of doc_ids; a doc_id, or null, that fills several has them by ranges of the text's hash. The first row of the next bucket,
    and after the last bucket the first row of all, comes again as the extra last row of a bucket, so that each row finds its successor without
    a global window. One shuffle of the texts.
    """
    spark = docs.sparkSession
    ids = docs.select(F.col(doc_id).cast("long").alias("d"))
    width = shuffle_width(spark)
    buckets = buckets or 4 * width
    every = Counter(int(c) for c in ids.approxQuantile("d", [k / buckets for k in range(1, buckets)], 0.2 / buckets)) if buckets > 1 else Counter()
    size = ids.agg(F.count("*").alias("n"), F.count("d").alias("some")).first()
    cuts = sorted(every)
    # from above: for each cut the doc_ids over it up to the next, then, if it came up more than once, the cut itself in as many parts; nulls last
    parts = [0, *(every[c] if every[c] > 1 else 0 for c in cuts)]  # by the number of cuts reached
    first, n = [0] * len(parts), 0
    for k in range(len(parts) - 1, -1, -1):
        first[k], n = n, n + 1 + parts[k]
    bare = max(1, -(-buckets * (size["n"] - size["some"]) // max(1, size["n"])))
    look = lambda values, at: F.get(F.array(*[F.lit(v) for v in values]), at)
    slot = lambda k: (F.shiftright(F.shiftright("u", 32) * k, 31)).cast("int")  # noqa: E731  # which of k equal ranges of the hash
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("u", F.shiftrightunsigned(F.xxhash64("text"), 1))

    def placed(r: Column) -> Column:
        alone = (look(parts, r) > 0) & (F.col("doc_id") == look([0, *cuts], r))
        return look(first, r) + F.when(alone, 1 + slot(look(parts, r))).otherwise(0)

    rows = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(n) + slot(F.lit(bare))).otherwise(let(_reached(cuts, F.col("doc_id")).cast("int"), placed)).cast("int"))
    # at most one row for each bucket comes to the driver, without its text
    tops = rows.select("bucket", F.struct(F.col("doc_id").isNull().alias("late"), F.bitwise_not("doc_id").alias("down"), "u").alias("k")).groupBy("bucket").agg(F.min("k").alias("k")).collect()
    firsts = sorted((r["bucket"], None if r["k"]["late"] else ~r["k"]["down"], r["k"]["u"]) for r in tops) if tops else []
    if not firsts:
        return rows.select("bucket", "doc_id", "text", F.lit(False).alias("extra"))
    ends = spark.createDataFrame([(nb, top, u, firsts[i - 1][0]) for i, (nb, top, u) in enumerate(firsts)], "nb int, top long, tu long, to int")
    heads = rows.join(F.broadcast(ends), (F.col("bucket") == F.col("nb")) & F.col("doc_id").eqNullSafe(F.col("top")) & (F.col("u") == F.col("tu")))  # one row for each bucket
    heads = heads.groupBy("to", "doc_id").agg(F.min("text").alias("text"))
    both = rows.withColumn("extra", F.lit(False)).unionByName(heads.select("doc_id", "text", F.lit(0).cast("long").alias("u"), F.col("to").alias("bucket"), F.lit(True).alias("extra")))
    dealt = both.repartition(min(width, len(firsts)), "bucket").sortWithinPartitions("bucket", "extra", F.col("doc_id").desc_nulls_last(), "u", "text")
    return dealt.select("bucket", "doc_id", "text", "extra")


def compare_with_next(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """For each row the digests of its text and of the edited text, and their likeness; and that to the next document's.

    Next: by falling doc_id, nulls last; rows with equal doc_id by a hash of the text; after the last row the first. Edited: the last half of the code
    points (rounded down) replaced by the first as many of the next document, or all it has. A null text counts as empty.
    """

    def run(batches):
        waiting = None  # the last row read, whose successor isn't known yet

        def out(rows):
            own = [r[1] for r in rows]
            edited = [_edited(r[1], r[2]) for r in rows]
            every = [*own, *edited, *(r[2] for r in rows)]
            place = {t: i for i, t in enumerate(dict.fromkeys(every))}  # a row's next is mostly the next row's own
            raw = [t.encode() for t in place]
            made = digests(raw)
            got = [made[place[t]] for t in every]
            n = len(rows)
            cols = [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([len(s) for s in own], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                pa.array([text_of(d) for d in got[:n]], pa.string()),
                pa.array([text_of(d) for d in got[n : 2 * n]], pa.string()),
                pa.array([likeness(a, b) for a, b in zip(got, got[n : 2 * n])], pa.float64()),
                pa.array([likeness(a, b) for a, b in zip(got, got[2 * n :])], pa.float64()),
            ]
            return pa.RecordBatch.from_arrays(cols, _NAMES)

        for b in batches:
            ready, held = [], 0
            for d, t, bucket, extra in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("bucket").to_pylist(), b.column("extra").to_pylist()):
                if waiting is not None and waiting[2] == bucket:
                    ready.append((waiting[0], waiting[1], t))
                    held += len(t) + len(waiting[1])
                    if held > 1 << 20:
                        yield out(ready)
                        ready, held = [], 0
                waiting = None if extra else (d, t, bucket)
            if ready:
                yield out(ready)

    return in_order(docs, doc_id, text).mapInArrow(run, _SCHEMA)


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [f.split()[0] for f in _SCHEMA.split(", ")]
