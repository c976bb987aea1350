"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints link if they differ in at most three bits. Put a ball of half that radius, one bit, around every fingerprint: two
fingerprints link exactly if a point of one ball equals, or is next to (one bit), a point of the other. So every fingerprint emits the
variants of its ball, and the odd bit is met by leaving out either half of the 64 bits in turn: all points that agree in the other half
meet in one shuffle group, where points that are one bit apart in the half left out are joined. That is 2 x 33 rows for each distinct
fingerprint, and within a group work in proportion to its points: no pairs are listed, so dense groups cost no more than others.
Each joined pair of points verifies a link of at most 1 + 1 + 1 bits by itself.

Links then are contracted to components by min-label rounds over a table that holds near duplicates alone.

Three bits are tight for near copies. ``similar_links`` adds links between texts whose sets of five-word shingles have a Jaccard similarity of SIMILAR or
more: min-wise hashes of the shingles in BANDS bands propose pairs, each text with one of its bucket (another one in each band), and every pair is
verified on the whole sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, shuffle_width, unwrapped, wide_hash, wrapped

SHINGLE = 3
LOW = np.uint64(0xFFFFFFFF)


def fingerprint_of(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Bits set in over half of the shingles' XXH64 (seed 42); zero for no words."""
    return int(_fingerprints([text], shingle)[0])


def _fingerprints(texts: list[bytes | None], shingle: int) -> np.ndarray:
    from xxhash import xxh64_intdigest as xxh

    hashes: list[int] = []
    ends = np.zeros(len(texts) + 1, np.int64)
    for i, t in enumerate(texts):
        ws = (t or b"").lower().split()  # on bytes: A-Z, and exactly the six ASCII blanks
        if len(ws) > shingle:
            line = b" ".join(ws)
            at, starts = 0, []
            for w in ws:
                starts.append(at)
                at += len(w) + 1
            starts.append(at)
            hashes += [xxh(line[a : b - 1], 42) for a, b in zip(starts, starts[shingle:])]
        elif ws:
            hashes.append(xxh(b" ".join(ws), 42))
        ends[i + 1] = len(hashes)
    h = np.array(hashes, np.uint64)
    out = np.zeros(len(texts), np.uint64)
    n = np.diff(ends)
    full = np.flatnonzero(n)
    if len(full):
        for bit in range(64):
            ones = np.add.reduceat(((h >> np.uint64(bit)) & np.uint64(1)).astype(np.int32), ends[:-1][full])
            out[full] |= (2 * ones > n[full]).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, ta, tb, fp)``: a 128-bit hash of the text and the fingerprint's 64 bits as a long. A null text counts as empty."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                fp = _fingerprints(part.column(3).cast(pa.binary()).to_pylist(), shingle)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(fp.view(np.int64))], ["doc_id", "ta", "tb", "fp"])

    ta, tb = wide_hash(F.col(f"`{text}`"))
    src = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), ta.alias("ta"), tb.alias("tb"), F.col(f"`{text}`").alias("text"))
    return src.mapInArrow(run, "doc_id long, ta long, tb long, fp long")


def _balls(batches):
    """Rows (side, key, x, inner): for either half left out, the ball's points by the 32 bits that must agree.

    ``inner`` rows stand for the point itself and its 32 neighbours in the half left out, which need no rows of their own."""
    flips = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(32, dtype=np.uint64)])
    for b in batches:
        fp = np.asarray(b.column(0)).view(np.uint64)
        for at in range(0, len(fp), 4096):
            f = fp[at : at + 4096]
            for side in (0, 1):
                keep = (f >> np.uint64(32)) if side == 0 else (f & LOW)
                key = (keep[:, None] ^ flips[None, :]).ravel()
                n = len(key)
                inner = np.tile(np.arange(33) == 0, len(f))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(((np.uint64(side) << np.uint64(32)) | key).view(np.int64)), pa.array(np.repeat(f, 33).view(np.int64)), pa.array(inner)],
                    ["key", "fp", "inner"],
                )


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest member of each of n nodes' component, by hooking and pointer jumping."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        lo, hi = np.minimum(ra, rb), np.maximum(ra, rb)
        if not (lo != hi).any():
            return root
        np.minimum.at(root, hi, lo)
        while (root != (up := root[root])).any():
            root = up


def _met(key: np.ndarray, fp: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (fp, smaller fp of its component) from whole shuffle groups, sorted by key."""
    cut = np.flatnonzero(key[1:] != key[:-1]) + 1
    size = np.diff(np.concatenate([[0], cut, [len(key)]]))
    group = np.repeat(np.arange(len(size)), size)
    many = np.repeat(size > 1, size)
    if not many.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    group, fp, inner, side = group[many].astype(np.uint64), fp[many], inner[many], key[many] >> 32
    x = np.where(side == 0, fp & LOW, fp >> np.uint64(32))
    fps, owner = np.unique(fp, return_inverse=True)
    point = (group << np.uint64(32)) | x
    bits = np.uint64(1) << np.arange(32, dtype=np.uint64)
    points = np.concatenate([point, (point[inner][:, None] ^ bits[None, :]).ravel()])
    owners = np.concatenate([owner, np.repeat(owner[inner], 32)])
    nodes, node = np.unique(points, return_inverse=True)
    first = np.full(len(nodes), len(fps))
    np.minimum.at(first, node, owners)
    a, b = [owners], [first[node]]
    for bit in bits:  # each neighbour once: from the point where the bit is off
        off = (nodes & bit) == 0
        at = np.searchsorted(nodes, nodes[off] | bit)
        ok = at < len(nodes)
        ok[ok] = nodes[at[ok]] == (nodes[off] | bit)[ok]
        a.append(first[off][ok])
        b.append(first[at[ok]])
    root = _roots(np.concatenate(a), np.concatenate(b), len(fps))
    linked = np.flatnonzero(root != np.arange(len(fps)))
    return fps[linked], fps[root[linked]]


#: Rows of shuffle groups that are handled at once; a group is never cut.
CHUNK = 200_000


def _meet(batches):
    """Over rows sorted by key. What spans batches is carried on until its group is whole."""
    kept: list[tuple] = []
    rows = 0

    def flush(last: bool):
        nonlocal kept, rows
        if not kept:
            return None
        key, fp, inner = (np.concatenate(c) for c in zip(*kept))
        end = len(key) if last else int(np.searchsorted(key, key[-1]))
        kept, rows = ([(key[end:], fp[end:], inner[end:])], len(key) - end) if end < len(key) else ([], 0)
        a, b = _met(key[:end], fp[:end], inner[:end]) if end else (np.zeros(0, np.uint64),) * 2
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    limit = CHUNK
    for b in batches:
        kept.append((np.asarray(b.column(0)), np.asarray(b.column(1)).view(np.uint64), b.column(2).to_numpy(zero_copy_only=False)))
        rows += b.num_rows
        if rows >= limit:
            yield flush(False)
            limit = max(CHUNK, 2 * rows)  # a group that outgrows the chunk is looked at again only when it has doubled
    if (out := flush(True)) is not None:
        yield out


def links(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints in column ``fp`` -> ``(a, b)`` with a and b linked, possibly over others; their components are those of all links."""
    width = shuffle_width(fps.sparkSession)
    rows = fps.mapInArrow(_balls, "key long, fp long, inner boolean")
    return rows.repartition(width, "key").sortWithinPartitions("key").mapInArrow(_meet, "a long, b long").distinct()


def _dealt(rows: DataFrame, by: str) -> DataFrame:
    """Rows with ``_salt``: those of any key are dealt to as many groups as there are partitions."""
    return rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(shuffle_width(rows.sparkSession))))


def _with_least(edges: DataFrame) -> DataFrame:
    """``(a, b, m)``: with each edge the smallest b of its a. A node of very many edges is worked on in groups, and what they find is put together."""
    dealt = _dealt(edges, "b")
    groups = dealt.groupBy("a", "_salt").agg(F.min("b").alias("m")).withColumn("m", F.min("m").over(Window.partitionBy("a")))
    return dealt.join(groups, ["a", "_salt"]).drop("_salt")


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (a, b): root is the component's smallest member.

    Alternating large-star and small-star rounds, until nothing changes: each halves the distances to the root or better, and every round's
    edges are written to the shared folder, and the round before is deleted. Nothing but a count and a checksum of a round comes to the driver.
    """
    now = materialize(edges.select("a", "b").where("a <> b"), "simhash-edges")
    seen = None
    while True:
        # large star: each node sends its larger neighbours to its smallest neighbour (or itself)
        both = now.select("a", "b").unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both).where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).where("a <> b").distinct()
        # small star: each node sends its smaller neighbours and itself to the smallest of them
        small = _with_least(large)
        moved = small.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        new = materialize(moved.where("a <> b").distinct(), "simhash-edges")
        discard(now)
        now = new
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            out = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            out._written_to = now._written_to
            return out
        seen = mark


#: Words of a shingle and similarity of near copies; bands of min-wise hashes, and hashes of each: at the similarity a pair shares none in one of 2,800 cases.
WORDS, SIMILAR = 5, 0.8
BANDS, ROWS = 20, 5
_FAMILY = np.random.default_rng(5).integers(1, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) | np.uint64(1)
_PLACES = np.random.default_rng(6).integers(1, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)


def shingle_hashes(text: bytes | None) -> np.ndarray:
    """The different five-word shingles of a text, hashed and in order; of fewer words the whole sequence, of none nothing."""
    from xxhash import xxh64_intdigest as xxh

    ws = (text or b"").lower().split()
    if not ws:
        return np.zeros(0, np.uint64)
    h = np.fromiter((xxh(w) for w in ws), np.uint64, len(ws))
    k = min(WORDS, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        out += h[j : len(h) - k + 1 + j] * _PLACES[j]
    return np.unique(out ^ (out >> np.uint64(29)))


def _band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """(n, BANDS) keys of sets that aren't empty: equal with the probability that all hashes of the band agree."""
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    every = np.concatenate(sets)
    keys = np.zeros((len(sets), BANDS), np.uint64)
    for k in range(BANDS * ROWS):
        least = np.minimum.reduceat((every * _FAMILY[0, k] + _FAMILY[1, k]) >> np.uint64(16), starts)
        band = k // ROWS
        keys[:, band] = (keys[:, band] ^ least) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band)
    return keys


def similar_links(docs: DataFrame, known: DataFrame, text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """``(a, b)``: fingerprints of texts that are at least so similar. ``known`` has the fingerprints (``ta``, ``fp``) of all texts."""

    def bands(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                sets = [shingle_hashes(t) for t in part.column(1).cast(pa.binary()).to_pylist()]
                some = np.array([i for i, x in enumerate(sets) if len(x)], np.int64)
                if len(some):
                    keys = _band_keys([sets[i] for i in some])
                    ta = np.asarray(part.column(0))[some]
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(ta, BANDS))], ["key", "ta"])

    def hashed(batches):
        for b in batches:
            sets = [shingle_hashes(t).tobytes() for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["ta", "s"])

    def verified(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= similar * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok))

    ta, _ = wide_hash(F.col(f"`{text}`"))
    texts = docs.select(ta.alias("ta"), F.col(f"`{text}`").alias("text"))
    keys = materialize(texts.mapInArrow(bands, "key long, ta long").distinct(), "simhash-bands")
    tops = keys.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("ta", "key").alias("h"), F.col("ta").alias("tb"))).alias("m")).where("n > 1").select("key", "m.tb")
    fps = known.groupBy("ta").agg(F.min("fp").alias("fp"))
    pairs = keys.join(tops, "key").where("ta <> tb").select("ta", "tb").distinct()
    pairs = pairs.join(fps.select("ta", F.col("fp").alias("a")), "ta").join(fps.select(F.col("ta").alias("tb"), F.col("fp").alias("b")), "tb").where("a <> b")
    pairs = materialize(pairs, "simhash-pairs")
    needed = materialize(pairs.select("ta").unionAll(pairs.select("tb")).distinct(), "simhash-needed")
    sets = materialize(texts.join(needed, "ta").mapInArrow(hashed, "ta long, s binary").groupBy("ta").agg(F.first("s").alias("s")), "simhash-sets")
    both = pairs.join(sets.withColumnRenamed("s", "x"), "ta").join(sets.select(F.col("ta").alias("tb"), F.col("s").alias("y")), "tb")
    out = materialize(both.select("a", "b", "x", "y").mapInArrow(verified, "a long, b long").distinct(), "simhash-similar")
    for used in (keys, pairs, needed, sets):
        discard(used)
    return out


def _classes_of(known: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """``(fp, root, component_id)`` for each distinct fingerprint; root is a fingerprint that names the component."""
    least = materialize(known.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-least")
    near = links(least.select("fp"))
    found = components(near if more is None else near.unionAll(more))
    comp = materialize(found.unionAll(found.select(F.col("root").alias("node"), "root")).distinct().withColumnRenamed("node", "fp"), "simhash-comp")
    tops = comp.join(least, "fp").groupBy("root").agg(F.min("least").alias("top"))
    dealt = _dealt(comp, "fp")  # a component may hold a large part of all fingerprints
    topped = dealt.join(dealt.select("root", "_salt").distinct().join(tops, "root"), ["root", "_salt"]).drop("_salt")
    of = least.join(topped, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("top", "least").alias("component_id"))
    out = materialize(of, "simhash-classes")  # so that a join with many documents of one fingerprint reads two plain exchanges, which Spark can split
    for used in (found, comp, least):
        discard(used)
    return out


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row for each row of ``docs``: ``(doc_id, fp, component_id)``.

    component_id is the smallest doc_id that links reach; null only if all those doc_ids are null. Equal fingerprints always link, those of
    empty texts too. Repeated rows are returned as often as they come.
    """
    known = materialize(fingerprints(docs, doc_id, text, shingle), "simhash-fp")
    return known.join(_classes_of(known), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similar: float | None = None) -> DataFrame:
    """One row of each component of ``docs``: that with the smallest doc_id (nulls last), then by its text's hash; of exact repeats, one. With ``similar``
    texts of that similarity are linked too."""
    known = materialize(fingerprints(docs, doc_id, text, shingle), "simhash-fp")
    more = None if similar is None else similar_links(docs, known, text, similar)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "ta", "tb", "n")).alias("k")
    # one row for each fingerprint before components are looked up: a group of copies is reduced where it is read
    per = known.groupBy("fp", "doc_id", "ta", "tb").agg(F.count("*").alias("n")).groupBy("fp").agg(first)
    least = per.join(_classes_of(known, more).select("fp", "root"), "fp").groupBy("root").agg(F.min("k").alias("k"))
    keep = least.select(F.col("k.doc_id").alias("_d"), F.col("k.ta").alias("_ta"), F.col("k.tb").alias("_tb"), F.col("k.n").alias("_n"))
    keep = materialize(keep, "simhash-keep")
    ta, tb = wide_hash(F.col(f"`{text}`"))
    rows = wrapped(docs, _id=F.col(f"`{doc_id}`").cast("long"), _xa=ta, _xb=tb)
    out = rows.join(keep, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_xa") == F.col("_ta")) & (F.col("_xb") == F.col("_tb")))
    again = out.where("_n > 1").withColumn("_r", F.row_number().over(Window.partitionBy("_d", "_ta", "_tb").orderBy("_n")))
    return out.where("_n = 1").select(unwrapped(docs)).unionByName(again.where("_r = 1").select(unwrapped(docs)))
