"""Token ids in directly addressable codes.

An id is cut into chunks of so many bits, lowest first. Level k of a block holds the k-th chunk of every id that has one, and a bitmap that
says which ids go on to level k + 1; a rank directory counts the set bits before every 512th. So the place of any id's next chunk is one
rank away, and a token is read with a few array look-ups, without decoding others.

A block is bytes: magic ``DAC1``, then unsigned 32-bit integers (number of documents, ids, levels; bits of each level), the documents' ends
(unsigned 64-bit), then for each level: number of chunks (64-bit), chunks, bitmap, directory (32-bit). Blocks are rows of an uncompressed Parquet
table, each a row group of its own, so that any file system Spark knows can hold them and a lost executor leaves nothing behind; ``part`` and
``block`` order them, and ``first`` is the number of ids that the part has before the block. By their statistics a reader that looks for a place
(``slice_at``, ``token_at``) reads the row group that has it and no other, and of its block the chunks it needs.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shuffle_width
from .tokens import default_tokenizer, memo

#: Bits of each level; they add up to 32. The vocabulary here needs two levels.
LEVELS = (8, 8, 16)
#: A block is closed when it holds so many ids.
BLOCK_IDS = 1 << 20
END_ID = 2
STEP = 512
_MAGIC = b"DAC1"


def _bitmap(flags: np.ndarray) -> bytes:
    bits = np.packbits(flags, bitorder="little")
    return bits.tobytes() + b"\0" * (-len(bits) % 8)


def encode_block(ids: np.ndarray, ends: np.ndarray) -> bytes:
    """``ends``: where each document's ids end."""
    out = [_MAGIC, struct.pack("<3I", len(ends), len(ids), len(LEVELS)), struct.pack(f"<{len(LEVELS)}I", *LEVELS), np.asarray(ends, "<u8").tobytes()]
    rest = np.asarray(ids, np.uint32)
    for bits in LEVELS:
        chunk = rest & np.uint32((1 << bits) - 1)
        more = (rest >> np.uint32(bits)) > 0 if bits < 32 else np.zeros(len(rest), bool)
        steps = np.concatenate([[0], np.cumsum(np.add.reduceat(more.astype(np.int64), np.arange(0, len(more), STEP)))]) if len(more) else np.zeros(1, np.int64)
        out += [struct.pack("<Q", len(chunk)), chunk.astype("<u1" if bits <= 8 else "<u2").tobytes(), _bitmap(more), steps.astype("<u4").tobytes()]
        rest = (rest >> np.uint32(bits))[more]
    return b"".join(out)


class Block:
    """Random access to a block's ids and documents."""

    def __init__(self, data: bytes):
        if data[:4] != _MAGIC:
            raise ValueError("not a block of directly addressable codes")
        n_docs, self.n, levels = struct.unpack_from("<3I", data, 4)
        at = 16
        self.bits = struct.unpack_from(f"<{levels}I", data, at)
        at += 4 * levels
        self.ends = np.frombuffer(data, "<u8", n_docs, at).astype(np.int64)
        at += 8 * n_docs
        self.levels = []
        for bits in self.bits:
            (m,) = struct.unpack_from("<Q", data, at)
            at += 8
            kind = np.dtype("<u1" if bits <= 8 else "<u2")
            chunks = np.frombuffer(data, kind, m, at)
            at += m * kind.itemsize
            size = -(-m // 64) * 8
            bitmap = np.frombuffer(data, "<u1", size, at)
            at += size
            count = -(-m // STEP) + 1
            ranks = np.frombuffer(data, "<u4", count, at)
            at += 4 * count
            self.levels.append((chunks, bitmap, ranks))

    def rank(self, level: int, i: int) -> int:
        """Set bits before place i."""
        _, bitmap, ranks = self.levels[level]
        at = i // STEP
        byte, bit = divmod(i, 8)
        n = int(ranks[at]) + int(np.bitwise_count(bitmap[at * STEP // 8 : byte]).sum())
        return n + (int(bitmap[byte]) & ((1 << bit) - 1)).bit_count() if bit else n

    def __getitem__(self, i: int) -> int:
        """One id."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = shift = 0
        for level, bits in enumerate(self.bits):
            chunks, bitmap, _ = self.levels[level]
            out |= int(chunks[i]) << shift
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            i, shift = self.rank(level, i), shift + bits
        return out

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """The ids at places lo to hi: each level's part of them is a run that two ranks bound."""
        out = np.zeros(hi - lo, np.uint32)
        at, shift = np.arange(hi - lo), 0
        for level, bits in enumerate(self.bits):
            if not len(at):
                break
            chunks, bitmap, _ = self.levels[level]
            out[at] |= chunks[lo:hi].astype(np.uint32) << np.uint32(shift)
            first = lo >> 3
            flags = np.unpackbits(bitmap[first : (hi >> 3) + 1], bitorder="little")[lo - 8 * first : hi - 8 * first].astype(bool)
            at, shift = at[flags], shift + bits
            lo, hi = self.rank(level, lo), self.rank(level, hi)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


_BLOCKS = "part int, block int, first long, n_docs long, n_ids long, doc_ids array<long>, data binary"


def blocks(docs: DataFrame, doc_id="doc_id", text="text", tokenizer: str | None = None, end_id=END_ID, block_ids=BLOCK_IDS) -> DataFrame:
    """All documents' ids in blocks, in rising order of doc_id (nulls first; equal ones by a hash of the text). One shuffle, of the texts; ids aren't shuffled.

    A null text counts as empty and has the end id alone; repeated rows are documents of their own. A doc_id of very many rows lies in several parts.
    """
    path = tokenizer or default_tokenizer()

    def run(batches):
        number = 0
        ids: list[np.ndarray] = []
        names: list = []
        held, part, first = 0, 0, 0
        end = np.array([end_id], "<u4")

        def closed():
            ends = np.cumsum([len(x) for x in ids])
            row = [[part], [number], [first], [len(names)], [int(ends[-1])], [names], [encode_block(np.concatenate(ids), ends)]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, _TYPES)], _NAMES)

        for b in batches:
            part = b.column(2)[0].as_py() if b.num_rows else part
            keys = iter(b.column(0).to_pylist())
            for flat, ends in memo(path).encode(b.column(1)):
                for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist()):
                    ids.append(np.concatenate([flat[lo:hi], end]))
                    names.append(next(keys))
                    held += hi - lo + 1
                    if held >= block_ids:
                        yield closed()
                        ids, names, held, number, first = [], [], 0, number + 1, first + held
        if names:
            yield closed()

    src = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).withColumn("h", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h").asc()]
    ordered = src.repartitionByRange(shuffle_width(docs.sparkSession), *order).sortWithinPartitions(*order, "text").drop("h")
    return ordered.withColumn("part", F.spark_partition_id()).mapInArrow(run, _BLOCKS)


_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
_NAMES = [f.split()[0] for f in _BLOCKS.split(", ")]


#: How files are written: blocks as they are, one to a row group.
_FORMAT = {"compression": "none", "parquet.block.row.count.limit": "1"}


def write(docs: DataFrame, path: str, **how) -> None:
    blocks(docs, **how).write.options(**_FORMAT).parquet(path)


def _bases(files: DataFrame) -> DataFrame:
    """``(part, before, n)`` of each part: the ids before it and its own. A row for each partition of the write."""
    parts = files.select("part", "n_ids").groupBy("part").agg(F.sum("n_ids").alias("n"))
    return parts.withColumn("before", F.expr("coalesce(sum(n) over (order by part rows between unbounded preceding and 1 preceding), 0)"))


def slice_at(files: DataFrame, start: int, n: int) -> DataFrame:
    """``(position, ids)``: the ids at places start to start + n of all ids, in runs of at most a block, ids packed as little-endian unsigned 32-bit integers.

    Places behind the end give nothing. Only blocks that hold some of them are read, and nothing of a block is decoded but those ids.
    """
    if start < 0 or n < 0:
        raise ValueError("places count from 0")
    held = _bases(files).where((F.col("before") < start + n) & (F.col("before") + F.col("n") > start)).collect()  # the parts that the slice touches

    def run(batches):
        for b in batches:
            for data, first in zip(b.column(0), b.column(1).to_pylist()):
                block = Block(data.as_py())
                lo, hi = max(0, start - first), min(block.n, start + n - first)
                yield pa.RecordBatch.from_arrays([pa.array([first + lo], pa.int64()), pa.array([block.ids(lo, hi).astype("<u4").tobytes()], pa.binary())], ["position", "ids"])

    out = None
    for r in held if n else []:
        own = files.where((F.col("part") == r["part"]) & (F.col("first") < start + n - r["before"]) & (F.col("first") + F.col("n_ids") > start - r["before"]))
        if start > r["before"]:  # statistics can't add: no block is longer than the longest
            own = own.where(F.col("first") >= F.lit(start - r["before"] - _longest(files, r["part"])))
        own = own.select("data", (F.col("first") + F.lit(r["before"])).alias("at"))
        out = own if out is None else out.unionAll(own)
    if out is None:
        return files.sparkSession.createDataFrame([], "position long, ids binary")
    return out.mapInArrow(run, "position long, ids binary")


def _longest(files: DataFrame, part: int) -> int:
    return files.where(F.col("part") == part).agg(F.max("n_ids")).first()[0]


def token_at(files: DataFrame, position: int) -> int:
    """The id at a place of all ids."""
    found = slice_at(files, position, 1).collect()
    if not found:
        raise IndexError(position)
    return int(np.frombuffer(found[0]["ids"], "<u4")[0])


def read(files: DataFrame) -> DataFrame:
    """Blocks as written -> ``(doc_id, start, n_tokens, ids)`` for each document; ids packed as little-endian unsigned 32-bit integers, start counted over all blocks.

    A block tells how many ids its part has before it; parts are placed by the sums of their counts, a row for each partition of the write.
    """
    before = _bases(files).select("part", "before")

    def run(batches):
        for b in batches:
            for names, data, base in zip(b.column(0), b.column(1), b.column(2).to_pylist()):
                block = Block(data.as_py())
                names = names.as_py()
                ends = block.ends.tolist()
                for at in range(0, len(names), 2048):
                    part = range(at, min(at + 2048, len(names)))
                    starts = [ends[k - 1] if k else 0 for k in part]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([names[k] for k in part], pa.int64()),
                            pa.array([base + s for s in starts], pa.int64()),
                            pa.array([ends[k] - s for k, s in zip(part, starts)], pa.int64()),
                            pa.array([block.document(k).astype("<u4").tobytes() for k in part], pa.binary()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    # at most as many rows as the write had partitions
    rows = files.join(F.broadcast(before), "part").select("doc_ids", "data", (F.col("before") + F.col("first")).alias("base"))
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, **how) -> DataFrame:
    """Written to the shared folder and read back."""
    return read(materialize(blocks(docs, **how), "token-files", **_FORMAT))
