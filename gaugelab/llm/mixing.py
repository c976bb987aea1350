"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents are put into a random order (by hash) and cut into blocks. A source's quota is a number of block draws: whole
passes over its blocks, then blocks from the front until its target is met, the last one cut between two documents. A binary tree splits
the vector of quotas among the output shards: at each node the left half's composition is drawn from the multivariate hypergeometric
distribution, so that every shard is a fair sample of the mix while quotas stay exact. Each leaf finds its own way down from seeds that
the nodes' names give, without talking to others, and owns a disjoint run of each source's draws; a document's place in its shard is
another hash, and shards come sorted by it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, discard, materialize, shuffle_width, unwrapped, wrapped

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"
#: Documents in a block, on average, and words in an output shard.
BLOCK_DOCS = 512
SHARD_WORDS = 4_000_000
#: Sources whose quotas are drawn together.
GROUP = 4096
#: A table of sources of up to so many rows is broadcast; a larger one is joined by a shuffle.
MOST_BROADCAST = 100_000


def _small(table: DataFrame, n_sources: int) -> DataFrame:
    """``table``, of at most a row for each source, to be broadcast if that is small."""
    return F.broadcast(table) if n_sources <= MOST_BROADCAST else table


def _running(df: DataFrame, order: list[str | Column], sums: dict[str, Column], label: str) -> DataFrame:
    """``df`` with ``name`` for each of ``sums``: the sum over all rows before, in the order given, from sums within ranges and sums of ranges."""
    ranged = df.repartitionByRange(shuffle_width(df.sparkSession), *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    ranged = materialize(ranged, label)  # written, so that ranges stay
    whole = ranged.groupBy("_p").agg(*[F.sum(v).alias(f"_{k}") for k, v in sums.items()])
    up = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = whole.select("_p", *[F.coalesce(F.sum(f"_{k}").over(up), F.lit(0)).alias(f"_{k}") for k in sums])
    own = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumns({k: F.coalesce(F.sum(v).over(own), F.lit(0)) for k, v in sums.items()})
    joined = inside.join(F.broadcast(before), "_p")  # a row for each range
    return joined.withColumns({k: F.col(k) + F.col(f"_{k}") for k in sums}).drop("_p", *[f"_{k}" for k in sums])


def targets(per: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, order: str = "src", size: str = "source_size") -> DataFrame:
    """``per`` (a row for each source) with ``i``, its place by code point with null last, and ``target``.

    ``share`` of all sizes is dealt by the repeating weights; no source gets more than ``most`` times its size, and the excess is dealt again. Sources
    are full one after the other as the level rises, in the order of ``most * size / weight``; the level is where the first that isn't full stands.
    """
    per = _running(per, [F.col(order).asc_nulls_last()], {"i": F.lit(1).cast("long")}, "mix-order")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("i") % len(weights)).cast("int"))
    per = per.withColumn("weight", weight).withColumn("full", F.lit(float(most)) * F.col(size)).withColumn("full_at", F.col("full") / F.col("weight"))
    sums = per.agg(F.sum(size).alias("size"), F.sum("weight").alias("weight")).first()
    total = float(share) * (sums["size"] or 0)
    rising = _running(per, ["full_at", "i"], {"given": F.col("full"), "gone": F.col("weight")}, "mix-levels")
    open_ = F.lit(sums["weight"] or 0.0) - F.col("gone")
    level = rising.where((F.lit(total) - F.col("given")) / open_ <= F.col("full_at")).agg(F.min(F.struct("full_at", "i", "given", (open_).alias("open"))).alias("l")).first()["l"]
    full = F.lit(True) if level is None else (F.col("full_at") < level["full_at"]) | ((F.col("full_at") == level["full_at"]) & (F.col("i") < level["i"]))
    rest = F.col("full") if level is None else F.lit(total - level["given"]) * F.col("weight") / F.lit(level["open"])
    return rising.withColumn("target", F.when(full, F.col("full")).otherwise(rest)).drop("full", "full_at", "weight", "given", "gone")


@dataclass
class Plan:
    """``sources``: (i, src, source_size, target, n_blocks, passes, last_block, cut) for each source; its partial pass ends in last_block at the order key cut;
    ``places``: (i, block, pass_no, late, shard) for each draw of a block, late in the partial pass; ``n_sources`` their number."""

    sources: DataFrame
    places: DataFrame
    n_sources: int


def size_of(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(WORD)).cast("long")


def order_key(doc_id: str = "doc_id", text: str = "text", seed: str = SEED) -> Column:
    """32 hexadecimal digits. Rows that are equal in doc_id and text share it, and so their fate."""
    return F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")), F.coalesce(F.md5(F.col(f"`{text}`")), F.lit(""))))


def _block(key: Column, n_blocks: Column) -> Column:
    return F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * n_blocks / F.lit(float(1 << 32))).cast("long")


_DRAWS = "i long, first long, n long, n_blocks long, passes long, shard long"


def _leaves(totals: list[int], levels: int, chunk: int, seed: int):
    """Over rows (g, chunk, members): what the shards of a chunk get of a group of sources.

    At a node the groups' totals are split first, then each group's own quotas within its part, which is the same distribution as splitting all at
    once. A node's draws depend on its name, so all who pass it see the same.
    """

    def split(take: np.ndarray, n: int, *name: int) -> np.ndarray:
        return np.random.default_rng([seed, *name]).multivariate_hypergeometric(take, n, method="marginals")

    def run(frames):
        for f in frames:
            for row in f.itertuples():
                members = pd.DataFrame(list(row.members)).sort_values("i")
                for shard in range(row.chunk * chunk, min((row.chunk + 1) * chunk, 1 << levels)):
                    every, take = np.array(totals, np.int64), members["quota"].to_numpy()
                    off = np.zeros_like(take)
                    for level in range(levels):
                        node = shard >> (levels - level)
                        parts = split(every, int(every.sum()) // 2, level, node)
                        left = split(take, int(parts[row.g]), level, node, row.g + 1)
                        if (shard >> (levels - level - 1)) & 1:
                            every, off, take = every - parts, off + left, take - left
                        else:
                            every, take = parts, left
                    at = np.flatnonzero(take)
                    yield pd.DataFrame({"i": members["i"].to_numpy()[at], "first": off[at], "n": take[at], "n_blocks": members["n_blocks"].to_numpy()[at], "passes": members["passes"].to_numpy()[at], "shard": shard})

    return run


def plan(docs: DataFrame, doc_id="doc_id", source="source", text="text", weights=WEIGHTS, share=SHARE, most=MOST, seed=SEED, block_docs=BLOCK_DOCS, shard_words=SHARD_WORDS) -> Plan:
    """Reads the texts once for a narrow table (source, size, order key); everything else works on that. Empty tables give empty plans.

    Of the sources only the sums and the totals of groups of GROUP come to the driver.
    """
    spark = docs.sparkSession
    narrow = materialize(docs.select(F.col(f"`{source}`").cast("string").alias("src"), size_of(text).alias("size"), order_key(doc_id, text, seed).alias("k")), "mix-sizes")
    per = narrow.groupBy("src").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    info = targets(per, weights, share, most).withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(block_docs))).cast("long")).withColumn("passes", passes)
    info = materialize(info.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")), "mix-targets")
    known = info.agg(F.count("*").alias("n"), F.sum("target").alias("words")).first()
    n = known["n"]
    dealt = narrow.join(_small(info.withColumnRenamed("src", "_s"), n), F.col("src").eqNullSafe(F.col("_s"))).drop("_s").withColumn("block", _block(F.col("k"), F.col("n_blocks")))
    blocks = dealt.groupBy("i", "block").agg(F.sum("size").alias("size"), F.first("rest").alias("rest")).withColumn("stretch", F.expr("block div 1024"))
    blocks = materialize(blocks, "mix-blocks")
    # sums over blocks in stretches, so that a source of very many blocks isn't one task's
    stretches = blocks.groupBy("i", "stretch").agg(F.sum("size").alias("whole"))
    stretches = stretches.withColumn("base", F.expr("sum(whole) over (partition by i order by stretch)") - F.col("whole")).drop("whole")
    before = blocks.withColumn("until", F.expr("sum(size) over (partition by i, stretch order by block)")).join(stretches, ["i", "stretch"])
    before = before.withColumn("until", F.col("until") + F.col("base")).withColumn("before", F.col("until") - F.col("size"))
    edge = before.where((F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("until"))).select("i", "block", "before")
    # only the blocks in which partial passes end, at most one for each source: their documents' order keys, about block_docs of them
    ends = dealt.join(_small(edge, n), ["i", "block"]).groupBy("i", "k", "before", "rest").agg(F.sum("size").alias("size"))
    ends = ends.withColumn("c", F.col("before") + F.expr("sum(size) over (partition by i order by k)") - F.col("size"))
    cuts = ends.where(2 * F.col("c") + F.col("size") <= 2 * F.col("rest")).groupBy("i").agg(F.max("k").alias("cut"))
    starts = before.where("before < rest").groupBy("i").agg(F.max("block").alias("last_block"))
    # a partial pass takes its front blocks whole and of the last one the documents up to the cut (none if the cut is null)
    sources = info.join(starts, "i", "left").join(cuts, "i", "left")
    sources = materialize(sources.select("i", "src", "source_size", "target", "n_blocks", "passes", "last_block", "cut", (F.col("n_blocks") * F.col("passes") + F.coalesce(F.col("last_block") + 1, F.lit(0))).alias("quota")), "mix-sources")
    levels = max(0, int(np.ceil(np.log2(max(1.0, (known["words"] or 0.0) / shard_words)))))
    groups = sources.where("quota > 0").groupBy(F.expr(f"i div {GROUP}").cast("int").alias("g")).agg(F.collect_list(F.struct("i", "quota", "n_blocks", "passes")).alias("members"), F.sum("quota").alias("total"))
    rank = {r["g"]: r["total"] for r in groups.select("g", "total").collect()}  # a row for each GROUP of sources
    totals = [rank.get(g, 0) for g in range(max(rank, default=-1) + 1)]
    chunk = 16
    tasks = groups.select("g", "members", F.explode(F.sequence(F.lit(0), F.lit(((1 << levels) - 1) // chunk))).alias("chunk")).repartition(shuffle_width(spark), "g", "chunk")
    leaves = tasks.mapInPandas(_leaves(totals, levels, chunk, int.from_bytes(seed.encode()[:8], "little")), _DRAWS)
    each = leaves.select("i", "shard", "n_blocks", "passes", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("draw"))
    places = each.select("i", (F.col("draw") % F.col("n_blocks")).alias("block"), F.expr("draw div n_blocks").alias("pass_no"), (F.expr("draw div n_blocks") >= F.col("passes")).alias("late"), "shard")
    drawn = materialize(places, "mix-places")
    for used in (narrow, info, blocks):
        discard(used)
    return Plan(sources.drop("quota"), drawn, n)


def _placed(rows: DataFrame, p: Plan) -> DataFrame:
    """Rows with ``_src`` and ``_k`` beside what the plan knows of their source, and their block ``_b``."""
    return rows.join(_small(p.sources, p.n_sources), F.col("_src").eqNullSafe(F.col("src"))).withColumn("_b", _block(F.col("_k"), F.col("n_blocks")))


def _counts(p: Plan) -> DataFrame:
    """(i, block, whole draws, draws of the partial pass), counted from the shards' draws."""
    late = F.col("late").cast("long")
    return p.places.groupBy(F.col("i").alias("_i"), F.col("block").alias("_bb")).agg(F.sum(1 - late).alias("_whole"), F.sum(late).alias("_part"))


def _times(cut: Column, last: Column) -> Column:
    part = F.when(F.col("_b") < last, 1).when((F.col("_b") == last) & (F.col("_k") <= cut), 1).otherwise(0)
    return (F.coalesce(F.col("_whole"), F.lit(0)) + F.coalesce(F.col("_part"), F.lit(0)) * part).cast("int")


def taken(docs: DataFrame, doc_id="doc_id", source="source", text="text", seed=SEED, **how) -> DataFrame:
    """``(doc_id, source, size, source_size, target, times, taken)`` for each row; a null text has size 0, a null source is a source."""
    p = plan(docs, doc_id, source, text, seed=seed, **how)
    narrow = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), F.col(f"`{source}`").cast("string").alias("_src"), order_key(doc_id, text, seed).alias("_k"), size_of(text).alias("size"))
    out = _placed(narrow, p)
    out = out.join(_counts(p), (F.col("i") == F.col("_i")) & (F.col("_b") == F.col("_bb")), "left")
    out = out.withColumn("times", _times(F.col("cut"), F.col("last_block")))
    return out.select("doc_id", "source", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, doc_id="doc_id", source="source", text="text", seed=SEED, places: tuple[str, str] | None = ("_shard", "_place"), **how) -> DataFrame:
    """The mixed documents: each row as often as the mix takes it, with its shard and its place there in the columns ``places``, which replace columns of those names; None adds none.

    Rows come shuffled: in each partition by shard and place, which is random, where a partition has whole eighths of shards. So files written
    from it are read in the order of the mix.
    """
    p = plan(docs, doc_id, source, text, seed=seed, **how)
    drawn = p.places.select(F.col("i").alias("_i"), F.col("block").alias("_bb"), "pass_no", "late", F.col("shard").alias("_shard"))
    by_block = drawn.groupBy("_i", "_bb").agg(F.collect_list(F.struct("pass_no", "late", "_shard")).alias("_at"))  # at most MOST + 1 draws of a block
    rows = wrapped(docs, _src=F.col(f"`{source}`").cast("string"), _k=order_key(doc_id, text, seed))
    out = _placed(rows, p).join(by_block, (F.col("i") == F.col("_i")) & (F.col("_b") == F.col("_bb")))
    out = out.withColumn("_one", F.explode("_at"))
    inside = (F.col("_b") < F.col("last_block")) | ((F.col("_b") == F.col("last_block")) & (F.col("_k") <= F.col("cut")))
    out = out.where(~F.col("_one.late") | F.coalesce(inside, F.lit(False))).select("_row", F.col("_one._shard").alias("_shard"), F.xxhash64("_k", "_one.pass_no").alias("_place"))
    out = out.withColumn("_eighth", F.shiftrightunsigned("_place", 61))
    out = out.repartition(shuffle_width(docs.sparkSession), "_shard", "_eighth").sortWithinPartitions("_shard", "_eighth", "_place")
    if places is None:
        return out.select(*unwrapped(docs))
    own = [c for c, name in zip(unwrapped(docs), docs.columns) if name not in places]
    return out.select(*own, F.col("_shard").alias(places[0]), F.col("_place").alias(places[1]))
