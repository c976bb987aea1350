"""Measurements as they arrive: windowed statistics with late data, and a moving range whose rows wait until their order is sure."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalar import known


def watch_csv(spark: SparkSession, folder: str, schema: StructType, per_trigger: int = 100) -> DataFrame:
    """New CSV files of a folder."""
    return spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", per_trigger).csv(folder)


def windowed_stats(stream: DataFrame, value: str, by: str, at: str = "ts", window: str = "10 seconds", late: str = "1 minute", flag: str | None = None) -> DataFrame:
    """Count, mean, deviation and extremes (and the rate of ``flag``) for each key and window; rows later than ``late`` are left out."""
    x = known(F.col(value).cast("double"))
    more = [F.avg(F.col(flag).cast("double")).alias("rate")] if flag else []
    grouped = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, window), by)
    return grouped.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), *more)


def live_moving_range(stream: DataFrame, value: str, by: str, index: str) -> DataFrame:
    """``(by, index, value, moving_range)`` at once: the difference to the key's previous row, for streams whose batches come in order. Rows of a batch are put in order
    of ``index``; state is the last row of each key, and a row that comes after a later one is left out, as no range could be right for it
    (``ordered_moving_range`` waits for such rows)."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState

    def step(key, frames, state: GroupState):
        at, last = state.get if state.exists else (None, None)
        rows = pd.concat(list(frames)).sort_values(index)
        if at is not None:
            rows = rows[rows[index] > at]
        if len(rows):
            prev = rows[value].shift(1)
            if last is not None:
                prev.iloc[0] = last
            tail = rows[value].iloc[-1]
            state.update((int(rows[index].iloc[-1]), None if pd.isna(tail) else float(tail)))
            yield pd.DataFrame({by: key[0], index: rows[index], value: rows[value], "moving_range": (rows[value] - prev).abs()})

    src = stream.select(F.col(by).cast("string").alias(by), F.col(index).cast("long").alias(index), F.col(value).cast("double").alias(value))
    return src.groupBy(by).applyInPandasWithState(step, f"{by} string, {index} long, {value} double, moving_range double", "at long, last double", "append", "NoTimeout")


#: Rows of a block of rows that wait, and blocks that are merged at once.
BLOCK_ROWS, MERGED_BLOCKS = 1_000, 64
_ROW = np.dtype([("at", "<i8"), ("index", "<i8"), ("value", "<f8")])
_SPAN = np.dtype([("part", "<i8"), ("from", "<i8")])


def ordered_moving_range(stream: DataFrame, value: str, by: str, index: str, at: str, late: str = "1 minute", forget: float | None = None) -> DataFrame:
    """``(by, index, value, moving_range)``: the absolute difference to the key's previous row, in order of time (``at``) and ``index``, however rows arrive.

    A row waits in its key's buffer until the watermark, ``late`` behind the latest time seen, has passed it; then event-time timers let rows go in order. A
    row that comes after a later one of its key has gone is left out, as no range could be right for it. The state of a key is the rows that wait and the last
    one that went, in sorted blocks that are merged a few at a time, so that a task holds no key's rows whole; after ``forget`` seconds without rows it is dropped, and the next range is null.
    Its states need RocksDB, which the session is set to.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    class Ordered(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.blocks = handle.getMapState("blocks", "part long", "packed binary")
            self.spans = handle.getValueState("spans", "packed binary")  # of each block its number and first time
            self.last = handle.getValueState("last", "at long, index long, value double")

        def _spans(self):
            return np.frombuffer(bytes(self.spans.get()[0]), _SPAN) if self.spans.exists() else np.zeros(0, _SPAN)

        def _keep(self, spans, rows):
            """Rows in order go into blocks."""
            start = int(spans["part"].max()) + 1 if len(spans) else 0
            more = [(start + k, int(rows["at"][first])) for k, first in enumerate(range(0, len(rows), BLOCK_ROWS))]
            for k, (part, _) in enumerate(more):
                self.blocks.updateValue((part,), (rows[k * BLOCK_ROWS : (k + 1) * BLOCK_ROWS].tobytes(),))
            return np.concatenate([spans, np.array(more, _SPAN)])

        def _frame(self, key, rows, before, before_at):
            x = rows["value"]
            old, old_at = np.append(before, x[:-1])[: len(x)], np.append(before_at, rows["at"][:-1])[: len(x)]
            if forget is not None:
                old = np.where(rows["at"] - old_at <= forget * 1_000_000, old, np.nan)
            with np.errstate(invalid="ignore"):
                return pd.DataFrame({by: pd.Series([key[0]] * len(x), dtype=object), index: rows["index"], value: x, "moving_range": np.abs(x - old)})

        def handleInputRows(self, key, rows, timerValues):
            last, first, spans = self.last.get() if self.last.exists() else None, None, self._spans()
            for f in rows:
                new = np.zeros(len(f), _ROW)
                new["at"], new["index"], new["value"] = f["seen_us"].to_numpy(np.int64), f[index].to_numpy(np.int64), f[value].to_numpy(float, na_value=np.nan)
                if last is not None:
                    new = new[(new["at"] > last[0]) | (new["at"] == last[0]) & (new["index"] > last[1])]
                if len(new):
                    spans = self._keep(spans, new[np.lexsort((new["value"], new["index"], new["at"]))])
                    first = int(new["at"].min()) if first is None else min(first, int(new["at"].min()))
            if first is not None:
                self.spans.update((spans.tobytes(),))
                self.handle.registerTimer(max(-(-first // 1000), timerValues.getCurrentWatermarkInMs() + 1))
            yield self._frame(key, np.zeros(0, _ROW), np.nan, 0)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            now = timerValues.getCurrentWatermarkInMs()
            end, spans = now * 1000 + 1, self._spans()
            due, spans = np.sort(spans[spans["from"] < end], order=["from", "part"]), spans[spans["from"] >= end]
            last = self.last.get() if self.last.exists() else None
            before, before_at, went = (np.nan if last is None or last[2] is None else last[2]), (0 if last is None else last[0]), None
            rows = np.zeros(0, _ROW)
            for k in range(0, len(due), MERGED_BLOCKS):  # blocks in order of their first rows: what lies before the next one's is complete
                parts = due["part"][k : k + MERGED_BLOCKS].tolist()
                rows = np.concatenate([rows, *[np.frombuffer(bytes(self.blocks.getValue((p,))[0]), _ROW) for p in parts]])
                for p in parts:
                    self.blocks.removeKey((p,))
                rows = rows[np.lexsort((rows["value"], rows["index"], rows["at"]))]
                ready = int(np.searchsorted(rows["at"], due["from"][k + MERGED_BLOCKS] if k + MERGED_BLOCKS < len(due) else end))
                if ready:
                    yield self._frame(key, rows[:ready], before, before_at)
                    went = rows[ready - 1]
                    before, before_at, rows = float(went["value"]), int(went["at"]), rows[ready:].copy()
            if went is not None:
                last = (int(went["at"]), int(went["index"]), None if np.isnan(went["value"]) else float(went["value"]))
                self.last.update(last)
            if len(rows):
                spans = self._keep(spans, rows)
            if len(spans):
                self.spans.update((spans.tobytes(),))
                self.handle.registerTimer(-(-int(spans["from"].min()) // 1000))
            else:
                self.spans.clear()
                if forget is not None and last is not None:
                    gone = -(-last[0] // 1000) + int(forget * 1000)
                    if now >= gone:
                        self.last.clear()
                    else:
                        self.handle.registerTimer(gone)
            yield self._frame(key, np.zeros(0, _ROW), np.nan, 0)

        def close(self):
            pass

    seen = F.col(at).cast("timestamp")
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = stream.select(F.col(by).cast("string").alias(by), F.col(index).cast("long").alias(index), F.col(value).cast("double").alias(value), seen.alias("seen_ts")).withWatermark("seen_ts", late)
    src = src.withColumn("seen_us", F.unix_micros("seen_ts"))
    shape = f"{by} string, {index} long, {value} double, moving_range double"
    return src.groupBy(by).transformWithStateInPandas(Ordered(), outputStructType=shape, outputMode="append", timeMode="eventtime").withColumns({c: known(F.col(c)) for c in (value, "moving_range")})
