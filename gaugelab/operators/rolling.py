"""Windows that reach back a stretch of time, and windows of k rows with a caller's own function."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import known
from .spc import _near, as_number, checked, cut_points, sliced


def _micros(x: Column) -> Column:
    return F.round(x * 1_000_000).cast("long")


def _reaching(df: DataFrame, by: list[str], at: str, seconds: float, rows: int | None) -> DataFrame:
    """``df`` with its time in seconds as ``_x``, and ``_slice`` and ``_own``: long series are cut at quantiles of the time into slices never shorter than
    ``seconds``, and a row also stands in the next slice, not as its own, if its time is that near."""
    cuts: list[float] = []
    for c in cut_points(df, by, at, rows):
        if not cuts or c - cuts[-1] >= seconds:
            cuts.append(c)
    timed = df.withColumn("_x", as_number(df, at))
    if not cuts:
        return timed.withColumns({"_slice": F.lit(0), "_own": F.lit(True)})
    own = sliced(timed, "_x", cuts)
    late = timed.withColumn("_y", F.col("_x") + seconds + 2e-6)  # times are told apart by microseconds, sums of doubles may fall short of them
    last = F.when(F.col("_x").isNull(), F.col("_mine")).otherwise(sliced(late, "_y", cuts))
    late = late.withColumn("_mine", own).withColumn("_slice", F.explode(F.sequence(F.col("_mine"), last)))
    return late.withColumn("_own", F.col("_slice") == F.col("_mine"))


def rolling_time(df: DataFrame, by: list[str], at: str, seconds: float, rows: int | None = None, **results: Callable[[], Column]) -> DataFrame:
    """``df`` with aggregates over the rows of the same keys from ``seconds`` before a row's time up to it, rows of the same time included.

    ``results`` are aggregates such as ``n=F.count("x")``. Long series are cut into slices at quantiles of the time, never shorter than the window, and a row also stands
    in the next slice if its time is that near: each row at most twice. Rows without a time have null results. Spark adds up each row's frame anew;
    ``rolling_stats`` and ``rolling_sums`` don't.
    """
    timed, reach = _reaching(df, by, at, seconds, rows), int(round(seconds * 1_000_000))
    w = Window.partitionBy(*by, "_slice").orderBy(_micros(F.col("_x"))).rangeBetween(-reach, 0)
    out = timed.withColumns({n: F.when(F.col("_x").isNotNull(), r.over(w)) for n, r in results.items()})
    return out.where("_own").select(*df.columns, *results)


def rolling_stats(df: DataFrame, value: str, by: list[str], at: str, seconds: float) -> DataFrame:
    """``df`` with ``rolling_n``, ``rolling_mean``, ``rolling_max`` and ``rolling_min`` of the values from ``seconds`` before a row's time up to it, rows of the same time
    included, in one pass each way whatever the frames hold.

    Time falls into blocks as long as the window, which so holds the end of one block and the start of the next. In a block stand its own rows, summed up as
    time rises, and those of the block before, a window later, summed up as time falls: no frame is added up anew, and nothing is taken off a sum. Each row stands twice. Missing values
    aren't counted; rows without a time have null results. A block is one task's work, which Spark spills if it has to.
    """
    reach = int(round(seconds * 1_000_000))
    timed = df.withColumns({"_t": _micros(as_number(df, at)), "_v": F.col(value).cast("double")})
    timed = timed.withColumns({"_block": F.coalesce(F.floor(F.col("_t") / max(reach, 1)), F.pmod(F.xxhash64("_v"), F.lit(1000))), "_v": F.when(F.col("_t").isNotNull(), F.col("_v")), "_own": F.lit(True)})
    both = timed
    if reach:
        past = timed.where("_t IS NOT NULL AND _v IS NOT NULL").select(*by, "_v", (F.col("_t") + reach).alias("_t"), (F.col("_block") + 1).alias("_block"), F.lit(False).alias("_own"))
        both = timed.unionByName(past, allowMissingColumns=True)
    block = Window.partitionBy(*by, "_block")
    results = {}
    for side, own, order in (("here", True, F.col("_t")), ("past", False, F.col("_t").desc())):
        w, v = block.orderBy(order).rangeBetween(Window.unboundedPreceding, 0), F.when(F.col("_own") == own, F.col("_v"))
        results |= {f"_{side}_{name}": f(v).over(w) for name, f in (("n", F.count), ("sum", F.sum), ("max", F.max), ("min", F.min))}
    got = both.withColumns(results).where("_own")
    there, zero = F.col("_t").isNotNull(), F.lit(0.0)
    n = F.col("_here_n") + F.col("_past_n")
    mean = (F.coalesce("_here_sum", zero) + F.coalesce("_past_sum", zero)) / F.when(n > 0, n)
    most, least = F.greatest("_here_max", "_past_max"), F.least("_here_min", "_past_min")
    return got.select(*df.columns, *[F.when(there, x).alias(f"rolling_{name}") for name, x in (("n", n), ("mean", mean), ("max", most), ("min", least))])


def rolling_sums(df: DataFrame, value: str, by: list[str], at: str, seconds: float, rows: int | None = None, places: int | None = None) -> DataFrame:
    """``df`` with ``rolling_n``, ``rolling_sum`` and ``rolling_mean`` of the values from ``seconds`` before a row's time up to it, in one pass whatever the frames hold.

    Each value enters at its time and leaves once the window has passed it: rows and departures stand in one order, and a sum that runs from the start of
    the slice counts the former up and the latter down. Bursts, where frames hold most of a series, cost no more than other rows. Missing and infinite values
    aren't counted; without any in reach, sum and mean are null; rows without a time have null results. Sums of
    doubles round as those of a slice do; with ``places``, values are taken as decimals of so many places (28 digits in all, more is an error) and summed up exactly.
    Exact sums are carried from slice to slice, so their slices are as even as the order can be cut, however long the window; slices of doubles are never shorter than it.
    """
    reach = int(round(seconds * 1_000_000))
    timed = _reaching(df, by, at, seconds, rows) if places is None else df.withColumns({"_x": as_number(df, at), "_own": F.lit(True), "_slice": F.lit(0)})
    v = known(F.col(value).cast("double"))
    v = F.when(F.abs(v) < float("inf"), v)
    timed = timed.withColumns({"_v": v if places is None else v.cast(f"decimal(28, {places})"), "_t": _micros(F.col("_x"))})
    # of one time rows come first and departures last, so that a window holds both its ends
    enters = timed.withColumns({"_o": F.col("_t") * 2, "_sign": F.lit(1)})
    gone = timed.where("_t IS NOT NULL AND _v IS NOT NULL").select(*by, "_slice", "_v", ((F.col("_t") + reach) * 2 + 1).alias("_o"), F.lit(-1).alias("_sign"))
    both = enters.unionByName(gone, allowMissingColumns=True)
    cuts = cut_points(both.select(*by, "_o"), by, "_o", rows) if places is not None else []
    if cuts:
        both = both.withColumn("_slice", sliced(both, "_o", cuts))
    steps = F.when(F.col("_o").isNotNull() & F.col("_v").isNotNull(), F.col("_sign")).otherwise(0)
    signed = F.when(F.col("_o").isNotNull(), F.when(F.col("_sign") > 0, F.col("_v")).otherwise(-F.col("_v")))
    w = Window.partitionBy(*by, "_slice").orderBy("_o").rangeBetween(Window.unboundedPreceding, 0)
    n, total = F.sum(steps).over(w), F.sum(signed).over(w)
    out = both.withColumns({"_n": n, "_sum": total}).where("_sign = 1 AND _own")
    if cuts:
        names, up = [*by, "_slice"], Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # a row for each slice
        ends = both.groupBy(*names).agg(F.sum(steps).alias("_n_end"), F.sum(signed).alias("_sum_end"))
        carried = checked(ends.select(*[F.col(c).alias(f"_on_{c}") for c in names], F.sum("_n_end").over(up).alias("_n_before"), F.sum("_sum_end").over(up).alias("_sum_before")))
        out = out.join(carried, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in names], "left")
        more = lambda c, before: F.coalesce(F.col(c) + F.col(before), F.col(c), F.col(before))
        out = out.withColumns({"_n": more("_n", "_n_before"), "_sum": more("_sum", "_sum_before")})
    out = out.withColumn("_sum", F.col("_sum").cast("double"))
    there = F.col("_t").isNotNull() & F.col("_own")
    some = there & (F.col("_n") > 0)
    return out.select(*df.columns, F.when(there, F.col("_n")).cast("long").alias("rolling_n"), F.when(some, F.col("_sum")).alias("rolling_sum"), F.when(some, F.col("_sum") / F.col("_n")).alias("rolling_mean"))


def rolling_apply(df: DataFrame, value: str, k: int, by: list[str], order: list[str], function: Callable[[np.ndarray], np.ndarray], name: str = "rolling", of: Column | None = None) -> DataFrame:
    """``df`` with a caller's function of the last ``k`` values: it gets an array of windows, one in each row, and gives a number for each; null unless all k are there.

    Sorted partitions are streamed in Arrow batches, and between batches the last k - 1 values are kept. Long series go in slices as ``rolling_ranges`` does.
    """
    import pandas as pd

    near, names = _near(df, by, order, of, k)
    near = near.withColumn("_v", known(F.col(value).cast("double")))
    kept = [c for c in df.columns if c != name]

    def run(frames):
        key, tail = None, np.zeros(0)
        for f in frames:
            x = f["_v"].to_numpy(float, na_value=np.nan)
            keys = list(zip(*[f[n].tolist() for n in names]))
            starts = [i for i in range(len(f)) if i == 0 or not all(a == b or a != a and b != b for a, b in zip(keys[i], keys[i - 1]))]
            result = np.full(len(f), np.nan)
            for a, b in zip(starts, [*starts[1:], len(f)]):
                if keys[a] != key:
                    tail = np.zeros(0)
                key = keys[a]
                series = np.concatenate([tail, x[a:b]])
                if len(series) >= k:
                    windows = np.lib.stride_tricks.sliding_window_view(series, k)
                    whole = ~np.isnan(windows).any(axis=1)
                    got = np.full(len(windows), np.nan)
                    if whole.any():
                        got[whole] = function(windows[whole])
                    result[b - min(len(got), b - a) : b] = got[-min(len(got), b - a) :]
                tail = series[len(series) - min(k - 1, len(series)) :]
            yield pd.DataFrame({**{c: f[c] for c in kept}, name: result})[f["_own"].to_numpy(bool)]

    shape = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c != name)
    dealt = near.repartition(*[F.col(n) for n in names]).sortWithinPartitions(*names, *order).select(*kept, *[n for n in names if n not in kept], "_own", "_v")
    return dealt.mapInPandas(run, f"{shape}, `{name}` double").withColumn(name, known(F.col(name)))
