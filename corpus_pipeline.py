"""A training corpus from raw documents: quality rules, line dedup, near dedup, mixing, packing.

Each stage gets what its predecessor kept and is written as Parquet in the folder that all executors share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugelab.llm import lines, mixing, packing, quality, simhash
from gaugelab.llm.common import discard, materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule go; abuse is known by stems learned from the labels beside the documents. Without tables there are none, and the
    policy is the one without that rule."""
    if not sf_dir:
        return quality.keep(docs, "web-1")
    return quality.keep(docs, quality.LEARNED, stems=quality.learn_stems(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on a large part of their source's different texts go; n_chars follows the text. Copies of a text keep their lines, and so
    does a text that would lose over half of them, as near copies would: the next stage keeps one of those."""
    out = lines.drop_boilerplate(docs, distinct=True, most=0.5, counts=None)
    return out.select(*[F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: fingerprints within three bits, or a similarity of 0.8 over five-word shingles."""
    return simhash.keep_one(docs, similar=simhash.SIMILAR)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice; written in the shuffled order of the mix's shards."""
    return mixing.mix(docs, places=None)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece, with its place in a sequence."""
    return packing.pack_documents(docs, with_ids=False)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("pack", pack)]

#: Tokenizing and packing are beyond SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)  # the next stage has written what it kept of it
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
