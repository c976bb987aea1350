"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A run of the six ASCII white-space characters that separate words (Java regular expression).
BLANKS = r"[\x20\x09-\x0D]+"
#: A word: a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(v)`` with ``v`` bound to ``value``, which is evaluated once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text, null counting as empty. Blanks at either end go first, so that no empty strings have to be filtered."""

    def cut(t: Column) -> Column:
        return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, BLANKS, -1))

    return let(F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r")), cut)


def wrapped(docs: DataFrame, **more: Column) -> DataFrame:
    """All columns of ``docs`` in a struct ``_row``, beside new ones: whatever names ``docs`` has, none of them clashes."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *[c.alias(n) for n, c in more.items()])


def unwrapped(docs: DataFrame, but: dict[str, Column] | None = None) -> list[Column]:
    """The columns of ``docs``, out of ``_row``; some of them replaced."""
    return [(but or {}).get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns]


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def wide_hash(*cols: Column) -> list[Column]:
    """Two independent 64-bit hashes: 128 bits, so that no two texts of any corpus meet by chance."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit("second"), *cols)]


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a session without one (as in tests) gets a temporary one, in local mode alone."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="gaugelab-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir()


def materialize(df: DataFrame, label: str, compression: str = "zstd", **options: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors, and fixes what is not deterministic."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what ``materialize`` wrote for ``df``, once nothing reads it any more."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(df._written_to)
    where.getFileSystem(conf).delete(where, True)
