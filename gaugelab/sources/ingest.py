"""CSV files into tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

from ..operators.normalize import entities, guarded, normalize
from ..plans import schemas
from ..plans.specs import SPECS
from ..sinks.writers import append_table
from .readers import read_csv


def prepared(spark: SparkSession, test_type: str, path: str, now: datetime | None = None, legacy_float_id: bool = False) -> DataFrame:
    """The rows that a file adds to its table. Files may hold ``timestamp`` and ``result`` columns beside id and value."""
    if test_type not in SPECS:
        raise ValueError(f"unknown test type {test_type!r}")
    header = [h.strip() for h in (spark.read.text(path).first() or [""])[0].split(",")]
    more = [StructField("timestamp", schemas.N), StructField("result", schemas.S)]
    schema = StructType([*schemas.RAW.fields, *[f for f in more if f.name in header]])
    return entities(normalize(read_csv(spark, path, schema), test_type, now), test_type, legacy_float_id)


def ingest(spark: SparkSession, test_type: str, path: str, now: datetime | None = None, table: str | None = None, table_path: str | None = None) -> int:
    """All rows of a file, or on any error none. Ids must be new to the table; a new table's files lie at ``table_path``, if given. Returns the number of rows."""
    table = table or SPECS[test_type].table
    rows = prepared(spark, test_type, path, now)
    existing = spark.table(table) if spark.catalog.tableExists(table) else None
    checked = guarded(rows, test_type, existing).cache()
    try:
        n = checked.count()
        append_table(checked, table, table_path)
    finally:
        checked.unpersist()
    return n
