"""Instrument signals. A sample depends on the seed, its channel and its index alone, so that layout and retries don't change it."""

from __future__ import annotations

import math
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import coin, gaussian, linspace, missing
from ..operators.sequence import circular_shift, debounce

DAQ_RATE = 1000
NETWORK_RATE = 10
LOSS = {"ethernet": 0.05, "network": 0.01}


def _index(spark: SparkSession, n: int, channels: int) -> DataFrame:
    base = spark.range(n * channels)
    return base.select((F.col("id") % channels).cast("int").alias("channel"), F.expr(f"id div {channels}").alias("sample_idx"))


def _key() -> tuple:
    return F.col("channel"), F.col("sample_idx")


def _analog(base: DataFrame, n: int, seed: int) -> DataFrame:
    i = F.col("sample_idx")
    return base.withColumn("x", 5.0 * F.sin(linspace(i, n, 0, 2 * math.pi)) + gaussian(0, 0.1, seed, "analog", *_key()) + linspace(i, n, 0, 0.5))


def _digital(base: DataFrame, n: int, seed: int) -> DataFrame:
    raw = base.withColumn("x", coin(seed, "digital", *_key()))
    return debounce(raw, "x", ["channel"], "sample_idx").withColumn("x", F.col("x").cast("double"))


def _ethernet(base: DataFrame, n: int, seed: int) -> DataFrame:
    raw = base.withColumn("x", missing(gaussian(0, 1, seed, "ethernet", *_key()), LOSS["ethernet"], seed, *_key()))
    late = base.sparkSession.range(1).select((gaussian(0.02, 0.005, seed, "latency") * DAQ_RATE).cast("int").alias("k")).first()["k"]
    return circular_shift(raw, "x", ["channel"], "sample_idx", late) if n else raw


def _network(base: DataFrame, n: int, seed: int) -> DataFrame:
    t = linspace(F.col("sample_idx"), n, 0, n / NETWORK_RATE)
    x = gaussian(0.5, 0.1, seed, "network", *_key()) + 0.05 * F.sin(2 * math.pi * 0.1 * t) + gaussian(0, 0.01, seed, "network noise", *_key())
    return base.withColumn("x", missing(x, LOSS["network"], seed, *_key()))


SOURCES: dict[str, tuple[Callable, int]] = {"analog": (_analog, DAQ_RATE), "digital": (_digital, DAQ_RATE), "ethernet": (_ethernet, DAQ_RATE), "network": (_network, NETWORK_RATE)}


#: Given a number of channels, their samples: ``(channel, sample_idx)``, each channel's numbers without gaps from 0.
Index = Callable[[int], DataFrame]


def signal(spark: SparkSession, source: str, duration: float, channels: int = 1, seed: int = 0, begin: datetime = datetime(2024, 1, 1), index: Index | None = None) -> DataFrame:
    """``(channel, sample_idx, timestamp, x)`` of a named source; lost samples are null. As many samples as the duration holds, or those of ``index``, whatever the duration."""
    if source not in SOURCES:
        raise ValueError(f"unknown source {source!r}; there are {', '.join(SOURCES)}")
    make, rate = SOURCES[source]
    step = int(1e6 / rate)
    ts = F.lit(begin).cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("sample_idx") * step / 1e6).cast("decimal(18,6)"))
    n = int(duration * rate) if index is None else (index(channels).agg(F.max("sample_idx")).first()[0] or 0) + 1
    base = _index(spark, n, channels) if index is None else index(channels)
    return make(base, n, seed).select("channel", "sample_idx", ts.alias("timestamp"), "x")


class Instrument:
    """A source behind a connection: reading and commands need it open. Opening fails at ``failure``, a command at ``error``, both by hash of seed and call number."""

    def __init__(self, spark: SparkSession, source: str, seed: int = 0, failure: float = 0.0, error: float = 0.0):
        if source not in SOURCES:
            raise ValueError(f"unknown source {source!r}")
        import random

        self.spark, self.source, self.seed, self.failure, self.error = spark, source, seed, failure, error
        self.connected, self._chance = False, random.Random(seed)

    def connect(self) -> bool:
        self.connected = self._chance.random() >= self.failure
        return self.connected

    def disconnect(self) -> bool:
        self.connected = False
        return True

    def read(self, duration: float, channels: int = 1, index: Index | None = None) -> DataFrame:
        if not self.connected:
            raise ConnectionError("not connected")
        return signal(self.spark, self.source, duration, channels, self.seed, index=index)

    def send(self, command: str) -> str:
        if not self.connected:
            raise ConnectionError("not connected")
        if self._chance.random() < self.error:
            raise RuntimeError(f"command failed: {command}")
        return f"OK: {command}"
