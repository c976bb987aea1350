"""Ranked lexical search with inverted treaps.

The documents of a task are cut into shards of about SHARD_BYTES of text. In a shard each term has a treap of its postings: a search tree by the
document's place (shards are in order of doc_id) and a heap by impact, what a term adds to a score apart from its weight. A treap is stored in preorder
with the size of each left subtree: the left child stands next, the right one behind the left subtree, and a subtree is one stretch of arrays.

A query walks the treaps of its terms together over intervals of documents. The sum of the roots' weighted impacts bounds every score in the
interval; intervals that can't reach the k-th best are left out, others are scored at the document of the heaviest root and split there, and those with
few postings are scored outright. What a task has found in one shard prunes the next. All arithmetic but the weights' logarithm is in 64-bit integers.

Null texts and texts without terms match nothing; repeated rows are results of their own; rows with null doc_id come last among equal scores. Items
without terms, and items no document matches, have no rows; repeated items have rows each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, discard, materialize

SHARD_BYTES = 8_000_000
#: Items that are searched in one pass over the index.
BLOCK_ITEMS = 5_000
#: Intervals that are split at once, and postings up to which one is scored outright.
WIDTH, FEW = 16, 6_000

_BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: Column) -> Column:
    """The terms of a text, without the empty strings at its ends."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _BREAKS, -1), "")


def totals(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and their terms with repeats."""
    n = docs.select(F.size(terms_of(F.col("text"))).cast("long").alias("n")).where("n > 0")
    r = n.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    return r["docs"], r["terms"]


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    m = 50 + (50 * n * docs) // max(1, terms)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def treaps(start: np.ndarray, end: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For stretches of postings in search order: which posting stands at each place in preorder, and the size of its left subtree. Keys differ.

    All subtrees of a level are worked on together.
    """
    order, left = np.zeros(len(key), np.int64), np.zeros(len(key), np.int32)
    s, e, to = start, end, start.copy()
    while len(s):
        size = e - s
        at = np.cumsum(size) - size
        flat = np.arange(int(size.sum())) + np.repeat(s - at, size)
        keys = key[flat]
        root = flat[keys == np.repeat(np.maximum.reduceat(keys, at), size)]
        order[to], left[to] = root, root - s
        s, e, to = np.concatenate([s, root + 1]), np.concatenate([root, e]), np.concatenate([to + 1, to + 1 + root - s])
        some = e > s
        s, e, to = s[some], e[some], to[some]
    return order, left


def index(docs: DataFrame, docs_total: int, terms_total: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """A row for each shard and term: ``(shard, term, size, at, tf, left)`` in preorder, and one without term for the documents: their ids, numbers of
    terms, and which have no id."""

    def shard(held: list[tuple[int | None, bytes]], number: int) -> pa.RecordBatch:
        """Postings stand end to end in a few arrays, which Arrow's columns point into: no object is made for a term."""
        held.sort(key=lambda d: (d[0] is None, d[0] or 0))
        named, docs = np.array([i for i, _ in held if i is not None], "<i8"), len(held)
        data = b" \n ".join([t.translate(_LOWER) for _, t in held])
        held.clear()
        parts = pc.split_pattern(pa.array([data], pa.large_binary()), b" ").values.dictionary_encode()
        del data
        words, ids = parts.dictionary, parts.indices.to_numpy(zero_copy_only=False)
        mark, none = (pc.index(words, pa.scalar(w, words.type)).as_py() for w in (b"\n", b""))
        term = np.flatnonzero((ids != mark) & (ids != none))
        doc = np.cumsum(ids == mark, dtype=np.int32)[term]
        n = np.bincount(doc, minlength=docs)
        pairs = ids[term].astype(np.int64)
        del parts, ids, term
        pairs *= docs
        pairs += doc
        del doc
        pairs.sort()
        first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.zeros(0, np.int64)
        tf = np.diff(np.append(first, len(pairs)))
        pairs = pairs[first]
        del first
        word, at = np.divmod(pairs, docs)
        del pairs
        begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
        end = np.append(begin[1:], len(word)) if len(word) else begin
        of = word[begin]
        del word
        key = (impacts(tf, n[at], docs_total, terms_total) << 32) | (at * 2654435761 % (1 << 32))
        order, left = treaps(begin, end, key)
        del key
        ends = np.concatenate([[0], end])

        def column(x: np.ndarray, last: np.ndarray) -> pa.Array:
            """A stretch of ``x`` for each term, and ``last`` for the documents."""
            bounds = np.append(ends * 4, ends[-1] * 4 + last.nbytes).astype("<i4")
            return pa.Array.from_buffers(pa.binary(), len(of) + 1, [None, pa.py_buffer(bounds), pa.py_buffer(x.astype("<i4").tobytes() + last.tobytes())])

        text = pc.CastOptions(pa.string(), allow_invalid_utf8=True)
        terms = pa.concat_arrays([pc.cast(words.take(pa.array(of)), options=text), pa.nulls(1, pa.string())])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(of) + 1, number)), terms, pa.array(np.append(end - begin, docs)), column(at[order], named), column(tf[order], n.astype("<i4")), column(left, np.zeros(0, "<i4"))],
            ["shard", "term", "size", "at", "tf", "left"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, held, size = TaskContext.get().partitionId(), 0, [], 0
        for f in batches:
            texts = f["text"].cast(pa.large_binary())
            for i, known, text in zip(f["doc_id"].to_pylist(), f["known"].to_pylist(), texts):
                held.append((i if known else None, text.as_py()))
                size += len(held[-1][1])
                if size >= shard_bytes:
                    yield shard(held, task << 32 | made)
                    made, held, size = made + 1, [], 0
                    pa.default_memory_pool().release_unused()
        if held:
            yield shard(held, task << 32 | made)

    src = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("known"), F.coalesce("text", F.lit("")).alias("text"))
    return src.mapInArrow(run, "shard long, term string, size long, at binary, tf binary, left binary")


class Shard:
    """A shard's treaps of the terms that are asked for, end to end: places, impacts times weights, left subtrees."""

    def __init__(self, rows: list[tuple], docs_total: int, terms_total: int):
        head = next(r for r in rows if r[0] is None)
        self.ids, self.n = np.frombuffer(head[2], "<i8"), np.frombuffer(head[3], "<i4").astype(np.int64)
        rows = [r for r in rows if r[0] is not None]
        size = np.array([r[1] for r in rows], np.int64)
        ends = np.cumsum(size)
        self.spans = {r[0]: (e - n, e) for r, n, e in zip(rows, size.tolist(), ends.tolist())}
        join = lambda k: np.concatenate([np.frombuffer(r[k], "<i4") for r in rows]).astype(np.int64) if rows else np.zeros(0, np.int64)
        self.at, self.left = join(2), join(4)
        self.score = impacts(join(3), self.n[self.at], docs_total, terms_total) * np.repeat(np.array([r[5] for r in rows], np.int64), size)

    def root(self, v: np.ndarray, end: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The heaviest node of [lo, hi) in each subtree [v, end), with its subtree's end; v = end if there is none. All go down together."""
        v, end = v.copy(), end.copy()
        rows = np.flatnonzero(v < end)
        while len(rows):
            here, at = v[rows], self.at[v[rows]]
            before, after = at < lo[rows], at >= hi[rows]
            right = here + 1 + self.left[here]
            end[rows] = np.where(after, right, end[rows])
            v[rows] = np.where(before, right, np.where(after, here + 1, here))
            rows = rows[before | after]
            rows = rows[v[rows] < end[rows]]
        return v, end

    def search(self, terms: list[str], best: Best) -> None:
        spans = [self.spans[t] for t in terms if t in self.spans]
        if not spans:
            return
        q = len(spans)
        v, end = (np.array(x, np.int64)[None, :] for x in zip(*spans))
        lo, hi = np.zeros(1, np.int64), np.array([len(self.n)], np.int64)
        weight = lambda v, end: np.where(v < end, self.score[np.minimum(v, len(self.score) - 1)], 0)
        bound = weight(v, end).sum(axis=1)
        while len(bound):
            few = (end - v).sum(axis=1) <= FEW
            some = np.zeros(len(bound), bool)
            some[np.argsort(-bound, kind="stable")[:WIDTH]] = True
            done = some & few
            if done.any():  # every posting of these intervals
                a, b = v[done].ravel(), end[done].ravel()
                size = b - a
                flat = np.arange(int(size.sum())) + np.repeat(a - (np.cumsum(size) - size), size)
                at = self.at[flat]
                inside = (at >= np.repeat(np.repeat(lo[done], q), size)) & (at < np.repeat(np.repeat(hi[done], q), size))
                places, which = np.unique(at[inside], return_inverse=True)
                sums = np.bincount(which, self.score[flat[inside]], len(places))  # far below 2^53, so exact
                best.take(sums.astype(np.int64), places, self.ids)
            part = some & ~few
            rest = (v[~some], end[~some], lo[~some], hi[~some], bound[~some])
            if part.any():
                v1, e1, lo1, hi1 = v[part], end[part], lo[part], hi[part]
                w = weight(v1, e1)
                d = self.at[v1[np.arange(len(v1)), w.argmax(axis=1)]]
                wide = lambda x: np.repeat(x, q)
                thirds = ((d, d + 1), (lo1, d), (d + 1, hi1))  # the document itself, and what is left and right of it
                low, high = (np.concatenate([wide(x[k]) for x in thirds]) for k in (0, 1))
                roots, ends = (x.reshape(3, -1, q) for x in self.root(np.tile(v1.ravel(), 3), np.tile(e1.ravel(), 3), low, high))
                sums = weight(roots, ends).sum(axis=2)
                best.take(sums[0], d, self.ids)
                rest = [np.concatenate([x, *y]) for x, y in zip(rest, zip(*[(roots[k], ends[k], *thirds[k], sums[k]) for k in (1, 2)]))]
            v, end, lo, hi, bound = rest
            open_ = (bound > 0) & best.open(bound, lo, self.ids)
            v, end, lo, hi, bound = v[open_], end[open_], lo[open_], hi[open_], bound[open_]


class Best:
    """The k best of an item so far: scores falling, then ids rising; a missing id is the greatest."""

    NONE = np.iinfo(np.int64).max

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.known = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def take(self, scores: np.ndarray, places: np.ndarray, ids: np.ndarray) -> None:
        known = places < len(ids)
        named = np.where(known, ids[np.minimum(places, len(ids) - 1)], self.NONE) if len(ids) else np.full(len(places), self.NONE)
        some = scores > 0
        if len(self.scores) == self.k:
            some &= (scores > self.scores[-1]) | (scores == self.scores[-1]) & (named < self.ids[-1])
        if some.any():
            s, i, known = np.concatenate([self.scores, scores[some]]), np.concatenate([self.ids, named[some]]), np.concatenate([self.known, known[some]])
            order = np.lexsort((~known, i, -s))[: self.k]
            self.scores, self.ids, self.known = s[order], i[order], known[order]

    def open(self, bound: np.ndarray, lo: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether an interval from ``lo`` on that is bounded so may still add to the k best."""
        if len(self.scores) < self.k:
            return np.ones(len(bound), bool)
        first = np.where(lo < len(ids), ids[np.minimum(lo, len(ids) - 1)], self.NONE) if len(ids) else np.full(len(lo), self.NONE)
        return (bound > self.scores[-1]) | (bound == self.scores[-1]) & (first < self.ids[-1])


def _block(spark: SparkSession, held: DataFrame, items: list[tuple[int, list[str]]], k: int, docs_total: int, terms_total: int) -> DataFrame:
    """``(item, doc_id, score)``: each task's k best for the items of a block."""
    asked = spark.createDataFrame([(t,) for t in sorted({t for _, ts in items for t in ts})], "_term string")
    hits = held.join(asked, F.col("term") == F.col("_term")).drop("_term")
    weight = F.floor(1000 * F.log(F.lit(2.0 * docs_total + 2) / (2 * F.sum("size") + 1)))
    weights = hits.groupBy("term").agg(weight.cast("long").alias("weight")).withColumnRenamed("term", "_term")
    rows = hits.join(weights, F.col("term") == F.col("_term")).drop("_term").unionByName(held.where("term IS NULL").withColumn("weight", F.lit(0).cast("long")))
    sent = spark.sparkContext.broadcast(items)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = {i: Best(k) for i, _ in sent.value}

        def ended(rows):
            here = Shard(rows, docs_total, terms_total)
            for i, terms in sent.value:
                here.search(terms, best[i])

        shard, rows = None, []
        for f in frames:
            for r in zip(f["shard"], f["term"], f["size"], f["at"], f["tf"], f["left"], f["weight"]):
                if r[0] != shard and rows:
                    ended(rows)
                    rows = []
                shard = r[0]
                rows.append(r[1:])
        if rows:
            ended(rows)
        for i, b in best.items():
            if len(b.scores):
                yield pd.DataFrame({"item": i, "doc_id": pd.array([int(x) if y else None for x, y in zip(b.ids, b.known)], "Int64"), "score": b.scores})

    return rows.repartition("shard").sortWithinPartitions("shard").mapInPandas(run, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 50, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` highest-scoring documents of each item."""
    spark = docs.sparkSession
    docs_total, terms_total = totals(docs)
    held = materialize(index(docs, docs_total, terms_total, shard_bytes), "search-index")
    asked = items.select("item_id", F.array_distinct(terms_of(F.col("text"))).alias("terms"))
    numbered = materialize(asked.withColumn("_item", F.monotonically_increasing_id()), "search-items")
    blocks, block = [], []

    def searched():
        blocks.append(materialize(_block(spark, held, block, k, docs_total, terms_total), "search-found"))

    for r in numbered.where(F.size("terms") > 0).select("_item", "terms").toLocalIterator():  # the stated queries, in blocks of a fixed number
        block.append((r["_item"], r["terms"]))
        if len(block) == BLOCK_ITEMS:
            searched()
            block = []
    if block or not blocks:
        searched()
    found = blocks[0]
    for more in blocks[1:]:
        found = found.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    out = found.withColumn("rank", rank).where(F.col("rank") <= k).join(numbered.select("_item", "item_id"), F.col("item") == F.col("_item"))
    out = materialize(out.select("item_id", "rank", "doc_id", "score"), "search-ranked")
    for t in (held, numbered, *blocks):
        discard(t)
    return out
