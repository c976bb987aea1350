"""Files and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..plans import schemas


class EmptySourceError(ValueError):
    """A CSV file without even a header."""


def read_csv(spark: SparkSession, path: str, schema: StructType = schemas.RAW, quarantine: bool = False) -> DataFrame:
    """CSV with a header and a known schema. A malformed cell, a short or a long row fails the job; with ``quarantine`` such rows keep their text in ``_corrupt_record``.

    A header alone gives no rows; a file without one is an error.
    """
    if spark.read.text(path).limit(1).count() == 0:
        raise EmptySourceError(f"no header in {path}")
    reader = spark.read.option("header", True).option("enforceSchema", False)
    if quarantine:
        return reader.schema(StructType([*schema.fields, StructField("_corrupt_record", StringType())])).option("mode", "PERMISSIVE").csv(path)
    return reader.schema(schema).option("mode", "FAILFAST").csv(path)


def read_report(spark: SparkSession, path: str, test_type: str) -> DataFrame:
    """A run's data as written by ``sinks.write_csv``, in the report's own types."""
    return read_csv(spark, path, schemas.REPORT[test_type])


def read_document(spark: SparkSession, path: str, test_type: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema(schemas.document(test_type)).json(path)


def list_artifacts(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Files below ``root``, each in a folder named after its test: ``(path, modified, length, test_name, kind)``. Contents aren't read.

    Empty files are left out. No such folder gives no rows.
    """
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(root)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schemas.ARTIFACTS)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
    parts = F.split("path", "/")
    return files.select("path", F.col("modificationTime").alias("modified"), "length", F.element_at(parts, -2).alias("test_name"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("kind"))


def latest_artifact(spark: SparkSession, root: str, test_name: str, kind: str) -> str | None:
    """Path of the newest result document (``json``), picture (``png``) or report (``csv``, a folder of parts) of a test, on any file system.

    Names carry their time, so of files that were written in one moment the one of the later name counts. None if there is none.
    """
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{test_name}")
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return None
    names = [(f.getPath().getName(), f) for f in fs.listStatus(where)]
    have = [(f.getModificationTime() // 1000, n, f.getPath().toString()) for n, f in names if ("_data_" in n if kind == "csv" else n.endswith(f".{kind}"))]
    return max(have)[2] if have else None


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """Contents of PNG files; empty ones are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", True).load(root)
    return files.where("length > 0").select("path", F.col("modificationTime").alias("modified"), F.element_at(F.split("path", "/"), -2).alias("test_name"), "content")


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


#: Rows of a relational table that one task is meant to read.
JDBC_ROWS = 1_000_000


def read_jdbc(spark: SparkSession, url: str, name: str, column: str | None = None, rows: int = JDBC_ROWS, **options) -> DataFrame:
    """A relational table. With a numeric ``column`` it is read in parts of about so many rows, whose bounds are the column's least and greatest value; rows
    without one are in the first part."""
    table = {"url": url, "dbtable": name, **options}
    if column is None:
        return spark.read.format("jdbc").options(**table).load()
    bounds = f"SELECT MIN({column}) AS lo, MAX({column}) AS hi, COUNT(*) AS n FROM {name}"
    lo, hi, n = spark.read.format("jdbc").options(url=url, query=bounds, **options).load().first()
    parts = -(-n // rows)
    if parts > 1 and lo is not None and lo != hi:
        table |= {"partitionColumn": column, "lowerBound": str(lo), "upperBound": str(hi + 1), "numPartitions": str(parts)}
    return spark.read.format("jdbc").options(**table).load()
