"""Phrase collocation mining: id n-grams as fixed-width keys, sorted by range and counted by their runs.

Texts are tokenized once, in blocks. Words that are frequent in their language get a number of 32 bits; pieces break at all others. Each place of a
piece gives one key of 128 bits: the numbers of its next four words, zero past the piece's end. Keys are sorted in the block, counted, cut at common
splitters and sent by range; a range is sorted again, and the runs of its two, three and four leading numbers are the counts of all phrases.
What a block needs of the dictionary comes to it by a join, so nothing that grows with the corpus is broadcast but the splitters (16 bytes for
each two million words).

Null texts are empty, a null language is ``und``, repeated rows count again, and an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, shuffle_width

LEAST = 30
LONGEST = 4
#: A candidate goes if a longer one has so many hundredths of its count.
COVERED = 80
MOST_RANKED = 2000
#: Bytes of text in a block, keys that are sorted together, and keys of a range.
BLOCK_BYTES, SORT_KEYS, RANGE_KEYS = 16_000_000, 2_000_000, 2_000_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))


def split_words(data: bytes) -> tuple[np.ndarray, list[bytes]]:
    """Places in a list of words for the words of a lower-cased text, -1 where a piece ends. Split and numbered in native code, so texts may be long."""
    parts = pc.split_pattern(pa.array([data.translate(_LOWER).replace(b"\n", b" \n ")], pa.large_binary()), b" ").values.dictionary_encode()
    words, ids = parts.dictionary.to_pylist(), parts.indices.to_numpy(zero_copy_only=False)
    place = np.array([-2 if w == b"" else -1 if w == b"\n" else 0 for w in words], np.int32)
    place[place == 0] = np.arange((place == 0).sum(), dtype=np.int32)
    ids = place[ids] if len(ids) else ids
    return ids[ids > -2], [w for w in words if w not in (b"", b"\n")]


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each block and language: its words with their counts, and the stream of its words as places in that list (-1: a piece ends)."""

    def run(frames):
        task, made = TaskContext.get().partitionId(), 0
        held, size = {}, 0

        def flush():
            nonlocal made
            rows = []
            for lang, texts in held.items():
                ids, words = split_words(b"\n".join(texts))
                rows.append((task << 32 | made, lang, [w.decode("utf-8", "surrogatepass") for w in words], np.bincount(ids[ids >= 0], minlength=len(words)), ids.astype("<i4").tobytes()))
                made += 1
            held.clear()
            return pd.DataFrame(rows, columns=["block", "lang", "words", "counts", "stream"])

        for f in frames:
            for lang, text in zip(f["lang"], f["text"]):
                data = text.encode("utf-8", "surrogatepass")
                held.setdefault(lang, []).append(data)
                size += len(data)
                if size >= block_bytes:
                    yield flush()
                    size = 0
        yield flush()

    src = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return src.mapInPandas(run, "block long, lang string, words array<string>, counts array<long>, stream binary")


def frequent_words(cut: DataFrame, least: int = LEAST) -> DataFrame:
    """``(lang, word, n, id)`` for words of ``least`` occurrences in their language; ids count from 1 over all languages."""
    each = cut.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("n"))
    placed = each.where(F.col("n") >= least).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    held = materialize(placed, "collocations-words")
    before, starts = 1, []
    for r in held.groupBy("_part").agg((F.max("_at") + 1).alias("n")).orderBy("_part").collect():  # a row for each partition
        starts.append((r["_part"], before))
        before += r["n"]
    if before >= 1 << 32:
        raise ValueError("more frequent words than numbers of 32 bits")
    starts = F.broadcast(cut.sparkSession.createDataFrame(starts, "_part int, _start long"))
    out = held.join(starts, "_part").select("lang", "word", "n", (F.col("_start") + F.col("_at")).alias("id"))
    out._written_to = held._written_to
    return out


def _keys(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """High and low halves of the keys of all places where two known words meet."""
    padded = np.concatenate([ids, np.zeros(LONGEST, ids.dtype)]).astype(np.uint64)
    at = np.flatnonzero((padded[:-1] > 0) & (padded[1:] > 0))
    third = padded[at + 2]
    fourth = np.where(third > 0, padded[np.minimum(at + 3, len(padded) - 1)], 0)
    return padded[at] << np.uint64(32) | padded[at + 1], third << np.uint64(32) | fourth


def _counted(hi: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different keys in order, with their counts: two stable passes, the low half first."""
    if not len(hi):
        return hi, lo, n
    order = np.argsort(lo, kind="stable")
    order = order[np.argsort(hi[order], kind="stable")]
    hi, lo, n = hi[order], lo[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]))
    return hi[first], lo[first], np.add.reduceat(n, first)


def _pack(hi: np.ndarray, lo: np.ndarray, n: np.ndarray) -> bytes:
    """Planes of bytes, which compress well in sorted order."""
    planes = [x.astype("<u8").view(np.uint8).reshape(-1, 8).T for x in (hi, lo, n)]
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(np.concatenate(planes)).tobytes())


def _unpack(blob: bytes) -> np.ndarray:
    """Three rows: high halves, low halves, counts."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(3, 8, -1)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<u8")[:, :, 0]


def encode(cut: DataFrame, words: DataFrame, stride: int) -> DataFrame:
    """``(stream, sample)``: each block's words by their numbers, zero at breaks and infrequent words; keys of about one place in ``stride``."""
    used = cut.select("block", "lang", F.posexplode("words").alias("at", "word")).join(words.select("lang", "word", "id"), ["lang", "word"])
    known = used.groupBy("block").agg(F.collect_list(F.struct("at", "id")).alias("known"))  # a block has few words
    both = cut.select("block", F.size("words").alias("size"), "stream").join(known, "block").select("size", "stream", F.col("known.at").alias("at"), F.col("known.id").alias("id"))

    def run(frames):
        for f in frames:
            rows = []
            for size, stream, at, new in zip(f["size"], f["stream"], f["at"], f["id"]):
                table = np.zeros(size + 1, np.int64)  # the last place, -1, is a break
                table[np.asarray(at, np.int64)] = np.asarray(new, np.int64)
                ids = table[np.frombuffer(stream, "<i4")]
                joined = np.concatenate([[0], ids, [0]])
                ids = ids[(ids > 0) & ((joined[:-2] > 0) | (joined[2:] > 0)) | (ids == 0) & (joined[:-2] > 0)]  # one zero ends a piece, single words go
                hi, lo = _keys(ids)
                some = slice(len(hi) % stride, None, stride)
                rows.append((ids.astype("<u4").tobytes(), _pack(hi[some], lo[some], np.ones(len(hi[some]), np.uint64)), len(hi[some])))
            yield pd.DataFrame(rows, columns=["stream", "sample", "n_sample"])

    return both.mapInPandas(run, "stream binary, sample binary, n_sample long")


def splitters(coded: DataFrame, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys that part the sampled ones into about equal ranges."""
    found = [_unpack(r["sample"])[:2] for r in coded.where("n_sample > 0").select("sample").toLocalIterator()]
    if not found or ranges < 2:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    hi, lo = np.concatenate(found, axis=1)
    hi, lo, _ = _counted(hi, lo, np.ones(len(hi), np.uint64))
    at = np.unique(np.arange(1, ranges) * len(hi) // ranges)
    return hi[at], lo[at]


def count_phrases(coded: DataFrame, cuts: tuple[np.ndarray, np.ndarray], least: int = LEAST) -> DataFrame:
    """``(key, a)`` for phrases of ``least`` occurrences; a key holds four bytes for each word."""
    held = coded.sparkSession.sparkContext.broadcast(cuts)

    def sort(frames):
        ends_hi, ends_lo = held.value

        def parted(parts):
            hi, lo = (np.concatenate(x) for x in zip(*parts))
            hi, lo, n = _counted(hi, lo, np.ones(len(hi), np.uint64))
            left, right = np.searchsorted(hi, ends_hi, "left"), np.searchsorted(hi, ends_hi, "right")
            at = [a + int(np.searchsorted(lo[a:b], x)) for a, b, x in zip(left.tolist(), right.tolist(), ends_lo)]
            edges = [0, *at, len(hi)]
            rows = [(k, _pack(hi[a:b], lo[a:b], n[a:b])) for k, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
            return pd.DataFrame(rows, columns=["range", "keys"])

        parts, size = [], 0
        for f in frames:
            for stream in f["stream"]:
                ids = np.frombuffer(stream, "<u4")
                for a in range(0, len(ids), SORT_KEYS):  # long streams in steps that see the words after them
                    hi, lo = _keys(ids[a : a + SORT_KEYS + LONGEST - 1])
                    if a + SORT_KEYS < len(ids):
                        whole = np.count_nonzero((ids[a : a + SORT_KEYS] > 0) & (ids[a + 1 : a + SORT_KEYS + 1] > 0))
                        hi, lo = hi[:whole], lo[:whole]
                    parts.append((hi, lo))
                    size += len(hi)
                    if size >= SORT_KEYS:
                        yield parted(parts)
                        parts, size = [], 0
        if parts:
            yield parted(parts)

    def runs(f: pd.DataFrame) -> pd.DataFrame:
        hi, lo, n = _counted(*np.concatenate([_unpack(b) for b in f["keys"]], axis=1))
        words = np.stack([hi >> np.uint64(32), hi & np.uint64(0xFFFFFFFF), lo >> np.uint64(32), lo & np.uint64(0xFFFFFFFF)], axis=1).astype(">u4")
        out, new = [], np.zeros(len(hi), bool)
        for k in range(LONGEST):
            new[1:] |= words[1:, k] != words[:-1, k]
            new[0] = True
            if k == 0:
                continue
            first = np.flatnonzero(new)
            a = np.add.reduceat(n, first)
            keep = (a >= least) & (words[first, k] > 0)
            keep[[0, -1]] = words[first[[0, -1]], k] > 0  # these may go on in the ranges beside this one
            out += [(words[i, : k + 1].tobytes(), int(x)) for i, x in zip(first[keep], a[keep])]
        return pd.DataFrame(out, columns=["key", "a"])

    ranged = coded.select("stream").mapInPandas(sort, "range long, keys binary")
    counted = ranged.groupBy("range").applyInPandas(runs, "key binary, a long")
    return counted.groupBy("key").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def _part(key: str, begin: int, words: int) -> Column:
    return F.substring(key, 4 * begin + 1, 4 * words)


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """``(key, a, l, r, score)``: the cut that scores least, of candidates that no longer one covers. Exact: products are decimals."""
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    size = F.octet_length("key") / 4
    inner = [(b, n) for n in range(2, LONGEST) for b in range(LONGEST - n + 1)]  # places and lengths of phrases within a longer one
    within = [F.when((size > n) & (size >= b + n), _part("key", b, n)) for b, n in inner]
    longer = phrases.where(size > 2).select(F.explode(F.array_compact(F.array(*within))).alias("key"), "a").groupBy("key").agg(F.max("a").alias("_long"))
    kept = phrases.join(longer, "key", "left").where(F.col("_long").isNull() | (100 * wide("_long") < COVERED * wide("a"))).select("key", "a")
    known = phrases.select("key", "a").unionByName(words.select(F.unhex(F.lpad(F.hex("id"), 8, "0")).alias("key"), F.col("n").alias("a")))
    cuts = [F.when(size > k, F.struct(F.lit(k).alias("k"), _part("key", 0, k).alias("first"), F.substring("key", 4 * k + 1, 4 * LONGEST).alias("rest"))) for k in range(1, LONGEST)]
    each = kept.select("key", "a", F.explode(F.array_compact(F.array(*cuts))).alias("c")).select("key", "a", "c.*")
    each = each.join(known.select(F.col("key").alias("first"), F.col("a").alias("l")), "first").join(known.select(F.col("key").alias("rest"), F.col("a").alias("r")), "rest")
    each = each.withColumn("score", F.expr("cast(2000000 as decimal(38,0)) * a div cast(l + r as decimal(38,0))"))
    least = each.groupBy("key", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    return least.select("key", "a", "m.l", "m.r", "m.score")


def mine(docs: DataFrame, least: int = LEAST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's MOST_RANKED phrases by score, count and text."""
    cut = materialize(blocks(docs, block_bytes), "collocations-blocks")
    sizes = cut.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    words = frequent_words(cut, least)
    ranges = max(-(-total // RANGE_KEYS), shuffle_width(docs.sparkSession))
    coded = materialize(encode(cut, words, max(1, total // max(200_000, 8 * ranges))), "collocations-streams")
    phrases = materialize(count_phrases(coded, splitters(coded, ranges), least), "collocations-phrases")
    best = materialize(scored(phrases, words), "collocations-scores")
    by_lang = best.join(words.select("lang", F.unhex(F.lpad(F.hex("id"), 8, "0")).alias("_first")), F.substring("key", 1, 4) == F.col("_first")).drop("_first")
    # scores in a thousand steps: from the one on that reaches the last rank, phrases are few enough to be written out and ordered
    step = F.expr("score div 1000")
    steps = by_lang.groupBy("lang", step.alias("step")).agg(F.count("*").alias("m"))
    seen = F.sum("m").over(Window.partitionBy("lang").orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, -1))
    needed = steps.withColumn("_seen", F.coalesce(seen, F.lit(0))).where(F.col("_seen") < MOST_RANKED).groupBy("lang").agg(F.min("step").alias("least"))
    near = by_lang.join(needed, "lang").where(step >= F.col("least")).drop("least")
    spelled = near.select("*", F.posexplode(F.sequence(F.lit(0), (F.octet_length("key") / 4 - 1).cast("int"))).alias("at", "_k"))
    spelled = spelled.withColumn("_id", F.expr("substring(key, 4 * at + 1, 4)")).join(words.select(F.unhex(F.lpad(F.hex("id"), 8, "0")).alias("_id"), "word"), "_id")
    spelled = spelled.groupBy("lang", "key", "a", "l", "r", "score").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
    spelled = spelled.select("lang", F.array_join("w.word", " ").alias("phrase"), "a", "l", "r", "score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase"))
    ranked = spelled.withColumn("rank", rank.cast("long")).where(F.col("rank") <= MOST_RANKED).join(sizes, "lang")
    out = materialize(ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations-ranked")
    for table in (cut, words, coded, phrases, best):
        discard(table)
    return out
