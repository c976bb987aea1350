"""Measurement frames of each test type. Channels of one instrument are columns of one range: no joins by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import gaussian
from ..operators.rules import holds, milli_product, scaled, with_flag
from ..plans.specs import FAMILIES, SPECS
from .signals import Index, signal


def _channels(df: DataFrame, names: list[str]) -> DataFrame:
    """Long samples -> one column for each channel; one shuffle on the index, with sums before it."""
    cols = [F.max(F.when(F.col("channel") == k, F.col("x"))).alias(n) for k, n in enumerate(names)]
    return df.groupBy("sample_idx").agg(F.min("timestamp").alias("timestamp"), *cols)


def burnin(spark: SparkSession, duration: float = 10, seed: int = 0, index: Index | None = None) -> DataFrame:
    i = F.col("sample_idx")
    df = signal(spark, "analog", duration, 1, seed, index=index).select("sample_idx", "timestamp", F.col("x").alias("temperature"))
    states = signal(spark, "digital", duration, 1, seed, index=index).select("sample_idx", F.col("x").cast("int").alias("status"))
    df = df.join(states, "sample_idx").withColumns({"voltage": gaussian(3.3, 0.1, seed, "burnin voltage", i), "current": gaussian(0.5, 0.05, seed, "burnin current", i)})
    return with_flag(df, SPECS["burnin"])


def hipot(spark: SparkSession, duration: float = 10, seed: int = 0, index: Index | None = None) -> DataFrame:
    df = _channels(signal(spark, "analog", duration, 2, seed, index=index), ["v", "c"])
    df = df.select("sample_idx", "timestamp", scaled(F.col("v"), 5, absolute=True).alias("voltage"), scaled(F.col("c"), 1, absolute=True).alias("current"))
    return with_flag(df, SPECS["hipot"])


def isolation(spark: SparkSession, duration: float = 10, seed: int = 0, index: Index | None = None) -> DataFrame:
    df = signal(spark, "analog", duration, 1, seed, index=index)
    return with_flag(df.select("sample_idx", "timestamp", scaled(F.col("x"), 1e6, absolute=True).alias("resistance")), SPECS["isolation"])


def laser(spark: SparkSession, duration: float = 10, seed: int = 0, connection: str = "network", legacy: bool = False, index: Index | None = None) -> DataFrame:
    """``legacy`` computes the wavelength from the power channel."""
    df = _channels(signal(spark, "analog" if connection == "daq" else "network", duration, 2, seed, index=index), ["p", "w"])
    df = df.select("sample_idx", "timestamp", scaled(F.col("p"), 50, 55).alias("power"), scaled(F.col("p" if legacy else "w"), 25, 825).alias("wavelength"))
    return with_flag(df, SPECS["laser"])


def parametric(spark: SparkSession, duration: float = 10, seed: int = 0, index: Index | None = None) -> DataFrame:
    df = _channels(signal(spark, "analog", duration, 2, seed, index=index), ["v", "c"])
    df = df.select("sample_idx", "timestamp", scaled(F.col("v"), 1000, absolute=True).alias("voltage"), scaled(F.col("c"), 1000, absolute=True).alias("current"))
    return with_flag(df.withColumn("power", milli_product(F.col("voltage"), F.col("current"))), SPECS["parametric"])


def ict(spark: SparkSession, duration: float = 0, seed: int = 0, index: Index | None = None) -> DataFrame:
    """A row for each point of each family, sparse in the measured columns; the duration doesn't matter. With ``index`` each sample is a board of its own,
    and sequence numbers go on from board to board."""
    out, start, points = None, 0, sum(len(f.points) for f in FAMILIES)
    board, key = (None, ()) if index is None else (index(1), (F.col("sample_idx"),))
    for f in FAMILIES:
        if board is None:
            rows = spark.createDataFrame([(start + i + 1, f.label, p) for i, p in enumerate(f.points)], "sequence_num long, test_type string, test_point string")
        else:
            each = F.posexplode(F.array(*[F.lit(p) for p in f.points])).alias("k", "test_point")
            rows = board.select("sample_idx", F.lit(f.label).alias("test_type"), each).withColumn("sequence_num", F.col("sample_idx") * points + start + F.col("k") + 1)
        part = rows.withColumn(f.column, gaussian(f.mean, f.std, seed, "ict", F.col("test_point"), *key)).withColumn("pass_fail", holds(f.rule))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        start += len(f.points)
    return out.select(*SPECS["ict"].columns)


GENERATORS = {f.__name__: f for f in (burnin, hipot, isolation, laser, parametric, ict)}
#: Seconds that a run takes if nothing is said.
DEFAULT_DURATION = {"burnin": 3600}


def generate(spark: SparkSession, test_type: str, duration: float = 10, seed: int = 0, **how) -> DataFrame:
    if test_type not in GENERATORS:
        raise ValueError(f"unknown test type {test_type!r}; there are {', '.join(GENERATORS)}")
    return GENERATORS[test_type](spark, duration, seed, **how)
