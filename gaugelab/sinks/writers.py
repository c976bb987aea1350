"""Tables, reports and result documents."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stamp(at: datetime) -> str:
    return at.strftime("%Y%m%d_%H%M%S")


def append_table(df: DataFrame, name: str, path: str | None = None) -> None:
    """One job, one commit: a failed task leaves no rows behind. A new table's files lie at ``path``, if given."""
    df.write.mode("append").options(**({"path": path} if path else {})).saveAsTable(name)


def append_jdbc(df: DataFrame, url: str, name: str, **options) -> int:
    """All rows of a frame into a relational table, or none. Returns their number.

    Tasks write to a staging table of their own; if all have succeeded, its rows are moved in one transaction by the database itself. If one fails, or the
    move does, the target is as it was. The staging table goes in either case. The target must exist.
    """
    stage = f"{name}_stage_{uuid.uuid4().hex[:12]}"
    jvm = df.sparkSession.sparkContext._jvm
    if options.get("driver"):
        jvm.java.lang.Class.forName(options["driver"], True, jvm.java.lang.Thread.currentThread().getContextClassLoader())
    given = jvm.java.util.Properties()
    for k, v in options.items():
        given.setProperty(k, str(v))
    connection = jvm.java.sql.DriverManager.getConnection(url, given)
    try:
        connection.setAutoCommit(False)
        columns = ", ".join(f'"{c}"' for c in df.columns)
        try:
            df.write.format("jdbc").mode("errorifexists").options(url=url, dbtable=stage, **options).save()
            statement = connection.createStatement()
            n = statement.executeUpdate(f"INSERT INTO {name} ({columns}) SELECT {columns} FROM {stage}")
            connection.commit()
            return n
        except BaseException:
            connection.rollback()
            raise
        finally:
            if connection.getMetaData().getTables(None, None, stage.upper(), None).next() or connection.getMetaData().getTables(None, None, stage, None).next():
                connection.createStatement().executeUpdate(f"DROP TABLE {stage}")
            connection.commit()
    finally:
        connection.close()


#: Times as CSV, with all their digits.
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def write_csv(df: DataFrame, root: str, test_name: str, at: datetime, one_file: bool = False) -> str:
    """CSV with a header below ``root/test_name``; nulls are empty. As many part files as the frame has partitions, in its order, or one if asked for: a single task then writes all rows."""
    path = f"{root}/{test_name}/{test_name}_data_{stamp(at)}"
    (df.coalesce(1) if one_file else df).write.option("header", True).option("nullValue", "").options(**_TIMES).csv(path)
    return path


def write_document(df: DataFrame, root: str, test_name: str, at: datetime) -> str:
    """A result document as indented JSON. It is one row; nulls are written."""
    row = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).first()["j"]
    path = f"{root}/{test_name}/{test_name}_stats_{stamp(at)}.json"
    write_text(df.sparkSession, path, json.dumps(json.loads(row), indent=4, ensure_ascii=False))
    return path


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share, below ``spark.checkpoint.dir``. Only a session without one, in local mode, gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="gaugelab-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/run-{uuid.uuid4().hex}"


def scratch_table(spark: SparkSession) -> tuple[str, str]:
    """The name of a new table and a folder for its files, as ``scratch`` gives."""
    return f"scratch_{uuid.uuid4().hex}", scratch(spark)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Through Hadoop's file systems, so that any of them will do."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(where, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def console_report(documents: DataFrame, test_name: str) -> list[str]:
    """The lines that a run prints."""
    from ..operators.views import rate_card, statistics

    lines = [f"{test_name}:"] + [f"  {r['label']}: {r['shown']}" for r in rate_card(documents).collect()]
    for r in statistics(documents, test_name).collect():  # a row for each parameter
        lines.append(f"  {r['statistic']}: " + ", ".join(f"{k} {r[k]:.2f}" if r[k] is not None else f"{k} -" for k in ("mean", "std", "min", "max")) + f" {r['unit']}".rstrip())
    return lines
