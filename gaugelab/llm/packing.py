"""Best-fit packing by a grouping genetic algorithm.

Documents become token ids; only those longer than a sequence are cut. Pieces are dealt into shards of bounded size. A shard's packing
problem begins with best-fit decreasing; bins that this fills tightly are done, and the rest is solved by islands. Each keeps a population of
different packings (lists of bins). Crossover injects whole well-filled bins of one parent into the other, removes the bins that hold
duplicates, lets the documents so displaced take the place of smaller ones where they fill a bin better, and best-fits what is then left.
After each epoch an island's elite migrates to the next island, through a shuffle on the shard. Bins that stay badly filled are dissolved and
packed again, for groups of shards together.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_width, unwrapped, wrapped
from .tokens import default_tokenizer, encoded

CAPACITY = 4096
END_ID = 1
SHARD_ITEMS = 3000
ISLANDS, EPOCHS, GENERATIONS, POPULATION, ELITE = 2, 2, 12, 5, 2
#: Bins of the first packing that are filled so far are done, but for a quarter of all bins at least.
TIGHT, LEAST_OPEN = 0.998, 0.25
#: Bins filled less than this are packed again, for so many shards at a time.
LOOSE, LOOSE_SHARDS = 0.97, 16


def pieces(docs: DataFrame, doc_id="doc_id", text="text", tokenizer: str | None = None, capacity=CAPACITY, end_id=END_ID, with_ids: bool = True) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])``: each row's ids with the end id, cut at ``capacity``; ``ids`` are packed little-endian unsigned 32-bit integers. A null text counts as empty."""
    path = tokenizer or default_tokenizer()
    fields = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches):
        end = np.array([end_id], "<u4")
        for b in batches:
            rows: list[tuple] = []
            held = 0
            for d, ids in zip(b.column(0).to_pylist(), encoded(b.column(1), path)):
                ids = np.concatenate([ids, end])
                for k, at in enumerate(range(0, len(ids), capacity)):
                    own = ids[at : at + capacity].tobytes()
                    rows.append((d, k, at, len(own) // 4, zlib.crc32(own), own)[: len(names)])
                    held += len(own)
                if held > 8 << 20:
                    yield batch(rows)
                    rows, held = [], 0
            yield batch(rows)

    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def batch(rows):
        cols = list(zip(*rows)) or [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, fields)


# A packing is an array that gives each item its bin. Items are in order of falling length.


def best_fit(lengths: np.ndarray, capacity: int, order=None, bin_of=None, loads: list[int] | None = None) -> np.ndarray:
    """Puts the items of ``order`` each into the fullest bin with room, into new bins where there is none."""
    bin_of = np.full(len(lengths), -1) if bin_of is None else bin_of
    loads = [] if loads is None else loads
    room = sorted((capacity - x, k) for k, x in enumerate(loads) if x < capacity)
    sizes = lengths.tolist()
    for i in range(len(sizes)) if order is None else order:
        n = sizes[i]
        at = bisect_left(room, (n, -1))
        if at < len(room):
            free, k = room.pop(at)
        else:
            free, k = capacity, len(loads)
            loads.append(0)
        loads[k] += n
        bin_of[i] = k
        if free > n:
            insort(room, (free - n, k))
    return bin_of


def fitness(bin_of: np.ndarray, lengths: np.ndarray, capacity: int) -> float:
    """Mean of the squared fill of the bins: many full bins and one empty one beat even ones."""
    loads = np.bincount(bin_of, weights=lengths)
    return float(((loads / capacity) ** 2).mean())


def settle(lengths: np.ndarray, capacity: int, child: np.ndarray, loads: list[int], displaced: list[int]) -> np.ndarray:
    """Puts ``displaced`` items into ``child``: first each bin gives up one item or two for a larger one that fills it better, then best fit, longest first."""
    size = lengths.tolist()
    held: list[list[int]] = [[] for _ in loads]
    for i in np.flatnonzero(child >= 0).tolist():
        held[child[i]].append(i)
    free = sorted((size[i], i) for i in displaced)

    def better(k: int, gone: int, room: int) -> bool:
        """Is there a displaced item over ``gone`` that ``room`` holds? Then it is put in."""
        at = bisect_right(free, (room, len(size))) - 1
        if at < 0 or free[at][0] <= gone:
            return False
        n, i = free.pop(at)
        held[k].append(i)
        child[i] = k
        loads[k] += n - gone
        return True

    for k in sorted(range(len(loads)), key=lambda k: loads[k]):
        if not free:
            break
        gap = capacity - loads[k]
        if not gap:
            continue
        own = sorted(held[k], key=lambda i: size[i])
        out: tuple[int, ...] = ()
        for i in own:
            if better(k, size[i], size[i] + gap):
                out = (i,)
                break
        else:
            for x, i in enumerate(own[:4]):
                if any(better(k, size[i] + size[j], size[i] + size[j] + gap) and (out := (i, j)) for j in own[x + 1 : 5]):
                    break
        for i in out:
            child[i] = -1
            held[k].remove(i)
            insort(free, (size[i], i))
    return best_fit(lengths, capacity, [i for _, i in reversed(free)], child, loads)


def cross(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, capacity: int, rng) -> np.ndarray:
    """A child of ``a`` with a share of the best-filled bins of ``b``."""
    fill = np.bincount(b, weights=lengths)
    full = np.argsort(-fill + rng.random(len(fill)) * 0.02 * capacity, kind="stable")
    chosen = np.zeros(len(fill), bool)
    chosen[full[: max(1, int(len(fill) * rng.uniform(0.1, 0.5)))]] = True
    injected = chosen[b]
    spoiled = np.zeros(a.max() + 1, bool)
    spoiled[a[injected]] = True
    return _refilled(a, np.where(injected, b, -1), ~injected & ~spoiled[a], lengths, capacity)


def mutate(a: np.ndarray, lengths: np.ndarray, capacity: int, rng) -> np.ndarray:
    """``a`` with its loosest bins, and as many others, packed anew."""
    fill = np.bincount(a, weights=lengths)
    n = max(1, int(len(fill) * rng.uniform(0.02, 0.1)))
    gone = np.zeros(len(fill), bool)
    gone[np.argsort(fill, kind="stable")[:n]] = True
    gone[rng.integers(0, len(fill), n)] = True
    return _refilled(a, np.full(len(a), -1), ~gone[a], lengths, capacity)


def _refilled(a: np.ndarray, injected: np.ndarray, stay: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    child = np.full(len(a), -1)
    n = 0
    for own, kept in ((injected, injected >= 0), (a, stay)):
        if kept.any():
            _, at = np.unique(own[kept], return_inverse=True)
            child[kept] = at + n
            n = int(at.max()) + 1 + n
    placed = child >= 0
    loads = np.bincount(child[placed], weights=lengths[placed], minlength=n).astype(int).tolist()
    child = settle(lengths, capacity, child, loads, np.flatnonzero(~placed).tolist())
    return np.unique(child, return_inverse=True)[1]


def first_population(lengths: np.ndarray, capacity: int, size: int, rng) -> list[np.ndarray]:
    """Best-fit decreasing, then best-fit over orders in which nearly equal lengths are mixed."""
    out = [best_fit(lengths, capacity)]
    for _ in range(size - 1):
        order = np.argsort(-lengths * rng.uniform(0.8, 1.0, len(lengths)), kind="stable")
        out.append(best_fit(lengths, capacity, order.tolist()))
    return out


def least_bins(lengths: np.ndarray, capacity: int) -> int:
    return -(-int(lengths.sum()) // capacity)


def open_items(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing, and which items lie in bins that are not done."""
    first = best_fit(lengths, capacity)
    fill = np.bincount(first, weights=lengths)
    done = fill >= TIGHT * capacity
    done[np.argsort(fill, kind="stable")[: max(1, int(np.ceil(LEAST_OPEN * len(fill))))]] = False
    return first, ~done[first]


def evolve(pop: list[np.ndarray], lengths: np.ndarray, capacity: int, generations: int, rng) -> list[np.ndarray]:
    """The population after so many generations, best first and no two alike in their fill. Stops at a packing that no other can beat: all bins full but one."""
    size = len(pop)
    ranked: dict[float, np.ndarray] = {}
    add = lambda x: ranked.setdefault(round(fitness(x, lengths, capacity), 12), x)
    for x in pop:
        add(x)
    for _ in range(generations):
        best = sorted(ranked, reverse=True)
        if (np.bincount(ranked[best[0]], weights=lengths) < capacity).sum() <= 1:
            break
        parents = [ranked[k] for k in best]
        if len(parents) > 1:
            i, j = rng.permutation(len(parents))[:2]
            add(cross(parents[i], parents[j], lengths, capacity, rng))
            add(cross(parents[j], parents[i], lengths, capacity, rng))
        add(mutate(parents[int(rng.integers(len(parents)))], lengths, capacity, rng))
        ranked = {k: ranked[k] for k in sorted(ranked, reverse=True)[:size]}
    return [ranked[k] for k in sorted(ranked, reverse=True)]


_STATE = "shard long, island int, lengths binary, pop array<binary>"


def _pack(pop):
    return [x.astype("<i4").tobytes() for x in pop]


def _unpack(blobs):
    return [np.frombuffer(x, "<i4").astype(int) for x in blobs]


def solve(items: DataFrame, capacity=CAPACITY, seed: int = 1, islands=ISLANDS, epochs=EPOCHS, generations=GENERATIONS, population=POPULATION) -> DataFrame:
    """``items`` (uid, shard, length) -> (uid, shard, bin). A shard fits in a task by construction."""
    width = shuffle_width(items.sparkSession)

    def ordered(f: pd.DataFrame) -> pd.DataFrame:
        return f.sort_values(["length", "uid"], ascending=[False, True], kind="stable")

    def begin(f: pd.DataFrame) -> pd.DataFrame:
        shard, lengths = int(f["shard"].iloc[0]), ordered(f)["length"].to_numpy()
        lengths = lengths[open_items(lengths, capacity)[1]]
        rows = [(shard, k, lengths.astype("<i4").tobytes(), _pack(first_population(lengths, capacity, population, np.random.default_rng([seed, shard, k])))) for k in range(islands)]
        return pd.DataFrame(rows, columns=["shard", "island", "lengths", "pop"])

    def step(epoch):
        def run(frames):
            for f in frames:
                out = []
                for r in f.itertuples():
                    lengths, pop = np.frombuffer(r.lengths, "<i4").astype(int), _unpack(r.pop)
                    rng = np.random.default_rng([seed, int(r.shard), int(r.island), epoch + 1])
                    out.append((r.shard, r.island, r.lengths, _pack(evolve(pop, lengths, capacity, generations, rng))))
                yield pd.DataFrame(out, columns=["shard", "island", "lengths", "pop"])

        return run

    def migrate(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("island")
        pops = list(f["pop"])
        rows = [(r.shard, r.island, r.lengths, [*r.pop, *pops[k - 1][:ELITE]]) for k, r in enumerate(f.itertuples())]
        return pd.DataFrame(rows, columns=["shard", "island", "lengths", "pop"])

    state = items.select("uid", "shard", "length").repartition(width, "shard").groupBy("shard").applyInPandas(begin, _STATE)
    for epoch in range(epochs):
        if epoch:
            state = state.repartition(width, "shard").groupBy("shard").applyInPandas(migrate, _STATE)
        state = state.repartition(width, "shard", "island").mapInPandas(step(epoch), _STATE)

    def place(own: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        own = ordered(own)
        lengths = own["length"].to_numpy()
        first, free = open_items(lengths, capacity)
        best = min((x for p in states["pop"] for x in _unpack(p)), key=lambda x: (x.max(), -fitness(x, lengths[free], capacity)))
        done = first.copy()
        done[free] = best + first.max() + 1
        return pd.DataFrame({"uid": own["uid"], "shard": own["shard"], "bin": done})

    left = items.select("uid", "shard", "length").repartition(width, "shard").groupBy("shard")
    return left.cogroup(state.groupBy("shard")).applyInPandas(place, "uid long, shard long, bin long")


def pack(cut: DataFrame, capacity=CAPACITY, seed: int = 1, shard_items=SHARD_ITEMS, **how) -> DataFrame:
    """Pieces, with any columns and a ``length`` -> the same rows and columns with ``sequence_id`` and ``offset`` (long; replaced if there).

    Within a sequence, pieces lie in order of their uid without gaps. Repeated rows are packed each for itself. Pieces as long as a
    sequence have one of their own.
    """
    rows = wrapped(cut, _uid=F.monotonically_increasing_id(), length=F.col("length").cast("long"))
    held = materialize(rows, "pack-pieces")  # written, so that uids stay
    part = held.where(F.col("length") < capacity).select(F.col("_uid").alias("uid"), "length")
    n = part.count()
    shards = max(1, round(n / shard_items))
    dealt = part.withColumn("shard", F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(shards)))
    first = materialize(dealt.join(solve(dealt, capacity, seed, **how).drop("shard"), "uid"), "pack-first")
    fill = first.groupBy("shard", "bin").agg(F.sum("length").alias("fill"))
    loose = fill.where(F.col("fill") < F.lit(LOOSE * capacity)).select("shard", "bin")
    again = first.join(loose, ["shard", "bin"], "left_semi").withColumn("shard", F.expr(f"shard div {LOOSE_SHARDS}"))
    second = materialize(again.drop("bin").join(solve(again, capacity, seed + 1, **how).drop("shard"), "uid"), "pack-second")
    done = first.join(loose, ["shard", "bin"], "left_anti")
    bins = done.select("uid", (F.col("shard") * F.lit(1 << 24) + F.col("bin")).alias("sequence_id"), "length").unionAll(
        second.select("uid", ((F.col("shard") + F.lit(shards)) * F.lit(1 << 24) + F.col("bin")).alias("sequence_id"), "length")
    )
    w = Window.partitionBy("sequence_id").orderBy("uid").rowsBetween(Window.unboundedPreceding, 0)
    at = bins.withColumn("offset", F.sum("length").over(w) - F.col("length")).select(F.col("uid").alias("_uid"), "sequence_id", "offset")
    out = held.join(at, "_uid", "left")
    own = [c for c, n in zip(unwrapped(cut), cut.columns) if n not in ("sequence_id", "offset")]
    return out.select(*own, F.coalesce("sequence_id", -1 - F.col("_uid")).alias("sequence_id"), F.coalesce("offset", F.lit(0)).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, doc_id="doc_id", text="text", tokenizer: str | None = None, capacity=CAPACITY, end_id=END_ID, with_ids: bool = True, **how) -> DataFrame:
    """The pieces of all documents with their places, with their ids if asked for."""
    return pack(pieces(docs, doc_id, text, tokenizer, capacity, end_id, with_ids), capacity, **how)
