"""Files into a table as they come, each row once, however often the stream is stopped and started.

A batch is written as one folder, ``batch=<id>``, and then entered in a ledger. A batch that is run again after a failure finds itself in the ledger and
does nothing, or overwrites its folder. Readers see only batches that the ledger has, so a half-written one is never seen.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.normalize import entities, guarded, normalize
from ..plans import schemas
from ..sinks.writers import write_text


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def ledger(spark: SparkSession, root: str) -> list[int]:
    """The batches that are complete."""
    fs, where = _fs(spark, f"{root}/_ledger")
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(where) if f.getPath().getName().isdigit()) if fs.exists(where) else []


def ingested(spark: SparkSession, root: str, test_type: str, but: int | None = None) -> DataFrame | None:
    """The rows of all complete batches; None if there are none."""
    batches = [b for b in ledger(spark, root) if b != but]
    if not batches:
        return None
    first = spark.read.parquet(f"{root}/batch={batches[0]}")
    return spark.read.schema(first.schema).parquet(*[f"{root}/batch={b}" for b in batches])


def append_batch(rows: DataFrame, batch: int, root: str, test_type: str, now: datetime | None = None, before_ledger: Callable[[int], None] | None = None) -> None:
    """One batch of raw rows, whole or not at all: ids must be new to the table and to the batch. ``before_ledger`` is called between the two steps."""
    spark = rows.sparkSession
    if batch in ledger(spark, root):
        return
    fresh = guarded(entities(normalize(rows, test_type, now), test_type), test_type, ingested(spark, root, test_type, but=batch))
    fresh.write.mode("overwrite").parquet(f"{root}/batch={batch}")
    if before_ledger is not None:
        before_ledger(batch)
    write_text(spark, f"{root}/_ledger/{batch}", str(spark.read.parquet(f"{root}/batch={batch}").count()))


def ingest_stream(spark: SparkSession, folder: str, test_type: str, root: str, checkpoint: str, now: datetime | None = None, per_trigger: int = 100, before_ledger: Callable[[int], None] | None = None) -> StreamingQuery:
    """Ingests the files that are in ``folder`` and not yet in the table below ``root``, some for each batch, and ends. To go on, call it again."""
    files = spark.readStream.schema(schemas.RAW).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").option("maxFilesPerTrigger", per_trigger).csv(folder)
    write = lambda rows, batch: append_batch(rows, batch, root, test_type, now, before_ledger)
    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def written(spark: SparkSession, root: str) -> DataFrame:
    """``(batch, n)``: what the ledger says."""
    return spark.read.text(f"{root}/_ledger").select(F.regexp_extract(F.input_file_name(), r"/(\d+)$", 1).cast("long").alias("batch"), F.col("value").cast("long").alias("n"))
