"""Runs: generate or take data, analyse it, keep the artifacts; and batches of runs."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stats
from ..sinks import writers
from ..sources.generators import generate
from . import schemas
from .specs import SPECS


def analyze(df: DataFrame, test_type: str, at: datetime | None = None) -> DataFrame:
    """The result document of measurements, as one row."""
    stamp = F.lit((at or datetime.now()).isoformat())
    return stats.document(df, SPECS[test_type], stamp)


def run(spark: SparkSession, test_type: str, root: str, duration: float = 10, seed: int = 0, at: datetime | None = None, data: DataFrame | None = None) -> dict[str, str]:
    """Measurements, generated if none are given, and their result document below ``root``; returns their paths."""
    at = at or datetime.now()
    df = generate(spark, test_type, duration, seed) if data is None else data
    names = schemas.REPORT[test_type].names
    order = "sequence_num" if "sequence_num" in df.columns else "sample_idx"
    return {"csv": writers.write_csv(df.orderBy(order).select(names), root, test_type, at), "json": writers.write_document(analyze(df, test_type, at), root, test_type, at)}


def batch(spark: SparkSession, root: str, tests: list[str] | None = None, duration: float = 10, seed: int = 0, timeout: float = 300, run_one: Callable[[str], object] | None = None) -> DataFrame:
    """Runs one test after the other: ``(test_name, success, message)``. A run that fails or takes longer than ``timeout`` seconds doesn't stop the batch; its jobs are cancelled.
    ``run_one`` runs a test by its name, if runs aren't to be generated."""
    rows = []
    for name in tests or list(SPECS):
        tag = f"batch-{name}"

        def one(name=name, tag=tag):
            spark.addTag(tag)
            return run(spark, name, root, duration, seed) if run_one is None else run_one(name)

        pool = ThreadPoolExecutor(1)
        try:
            pool.submit(one).result(timeout)
            rows.append((name, True, ""))
        except Late:
            spark.interruptTag(tag)
            rows.append((name, False, f"took more than {timeout} seconds"))
        except Exception as e:  # noqa: BLE001  the batch reports it
            rows.append((name, False, str(e).split("\n")[0]))
        finally:
            pool.shutdown(wait=False)
    return spark.createDataFrame(rows, "test_name string, success boolean, message string")
