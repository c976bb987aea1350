"""Exact percentiles of groups of any size, moments that merge, and distinct counts by sketches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import known
from .spc import SLICE_ROWS, checked, cut_points, sliced


def percentiles(df: DataFrame, value: str, shares: list[float], by: list[str] = [], rows: int | None = None) -> DataFrame:  # noqa: B006
    """``(*by, share, x)``: exact percentiles of each group, linear between neighbours; missing values are left out, and a group without values has no rows.

    Equal values are counted first. The values of large groups are then cut into slices at quantiles; slices' sums say which ones hold the ranks
    asked for, and only those are put in order. No group is one task's work.
    """
    x = df.select(*by, known(F.col(value).cast("double")).alias("_x")).where("_x IS NOT NULL")
    counted = x.groupBy(*by, "_x").agg(F.count("*").alias("_c"))
    cuts = cut_points(x, by, "_x", rows or SLICE_ROWS)
    counted = counted.withColumn("_slice", sliced(counted, "_x", cuts))
    sums = counted.groupBy(*by, "_slice").agg(F.sum("_c").alias("_m"))
    up, whole = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)  # a row for each slice
    placed = sums.select(*by, "_slice", "_m", F.coalesce(F.sum("_m").over(up), F.lit(0)).alias("_before"), F.sum("_m").over(whole).alias("_n"))
    ranks = F.array(*[F.struct(F.lit(float(s)).alias("share"), (F.lit(float(s)) * (F.col("_n") - 1)).alias("r")) for s in shares])
    asked = placed.select("*", F.explode(ranks).alias("q")).select("*", "q.share", F.floor("q.r").alias("_lo"), F.ceil("q.r").alias("_hi"), (F.col("q.r") - F.floor("q.r")).alias("_part")).drop("q")
    asked = asked.where((F.col("_hi") >= F.col("_before")) & (F.col("_lo") < F.col("_before") + F.col("_m")))
    names = [*by, "_slice"]
    need = asked.groupBy(*names).agg(F.first("_before").alias("_before"), F.collect_list(F.struct("share", "_lo", "_hi", "_part")).alias("_q"))  # a few for each slice
    on = [F.col(n).eqNullSafe(F.col(f"_on_{n}")) for n in names]
    near = counted.join(checked(need.withColumnsRenamed({n: f"_on_{n}" for n in names})), on).select(*names, "_x", "_c", "_before", "_q")
    upto = Window.partitionBy(*names).orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("_before") + F.coalesce(F.sum("_c").over(upto), F.lit(0))
    each = near.withColumn("_first", first).select(*by, "_x", "_c", "_first", F.explode("_q").alias("q")).select(*by, "_x", "_first", (F.col("_first") + F.col("_c")).alias("_end"), "q.*")
    holds = lambda rank: F.max(F.when((F.col("_first") <= F.col(rank)) & (F.col(rank) < F.col("_end")), F.col("_x")))
    out = each.groupBy(*by, "share", "_part").agg(holds("_lo").alias("_a"), holds("_hi").alias("_b"))
    return out.select(*by, "share", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part")).alias("x"))


# Moments: a state of five numbers for each group, which can be stored and merged in any order


def moments(df: DataFrame, values: list[str], by: list[str]) -> DataFrame:
    """``(*by, parameter, n, mean, m2, least, most)``: the states of a frame, one pass. ``m2`` is the sum of squared distances from the mean."""
    clean = df.select(*by, *[known(F.col(v).cast("double")).alias(v) for v in values])
    aggs = [a for v in values for a in (F.count(v).alias(f"{v}_n"), F.avg(v).alias(f"{v}_a"), (F.var_pop(v) * F.count(v)).alias(f"{v}_q"), F.min(v).alias(f"{v}_l"), F.max(v).alias(f"{v}_h"))]
    one = clean.groupBy(*by).agg(*aggs)
    state = [F.struct(F.lit(v).alias("parameter"), *[F.col(f"{v}_{s}").alias(n) for s, n in zip("naqlh", ("n", "mean", "m2", "least", "most"))]) for v in values]
    return one.select(*by, F.explode(F.array(*state)).alias("s")).select(*by, "s.*")


def merged(states: DataFrame, by: list[str]) -> DataFrame:
    """States added up to coarser groups, or over runs. The common mean comes first and distances from it second, so that nothing cancels out."""
    names = [*by, "parameter"]
    means = states.groupBy(*names).agg((F.sum(F.col("n") * F.col("mean")) / F.nullif(F.sum("n"), F.lit(0))).alias("_mean"))
    both = states.join(means.withColumnsRenamed({n: f"_on_{n}" for n in names}), [F.col(n).eqNullSafe(F.col(f"_on_{n}")) for n in names])
    away = F.col("m2") + F.col("n") * (F.col("mean") - F.col("_mean")) * (F.col("mean") - F.col("_mean"))
    return both.groupBy(*names).agg(F.sum("n").alias("n"), F.first("_mean").alias("mean"), F.sum(away).alias("m2"), F.min("least").alias("least"), F.max("most").alias("most"))


def grouping_sets(states: DataFrame, sets: list[list[str]]) -> DataFrame:
    """States merged to each of some groupings, one below the other; columns that a grouping hasn't are null, and ``grouping`` names those it has."""
    every = list(dict.fromkeys(c for s in sets for c in s))
    kinds = dict(states.dtypes)
    one = lambda s: merged(states, s).select(*[F.col(c) if c in s else F.lit(None).cast(kinds[c]).alias(c) for c in every], F.lit(",".join(s)).alias("grouping"), "parameter", "n", "mean", "m2", "least", "most")
    return reduce(DataFrame.unionByName, [one(s) for s in sets])


def finished(states: DataFrame, keep: list[str]) -> DataFrame:
    """``(*keep, parameter, n, mean, std, min, max)``; the deviation is that of a sample."""
    return states.select(*keep, "parameter", "n", "mean", F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))).alias("std"), F.col("least").alias("min"), F.col("most").alias("max"))


# Distinct counts

#: Logarithm of a sketch's registers, and its relative standard error: 1.04 over the root of their number.
REGISTERS = 12
ERROR = 1.04 / 2 ** (REGISTERS / 2)


def sketches(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """``(*by, sketch)``: a HyperLogLog sketch of a column for each group, a few kilobytes whatever the group; missing values don't count."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(column, F.lit(REGISTERS)).alias("sketch"))


def united(states: DataFrame, by: list[str]) -> DataFrame:
    """``(*by, sketch)``: what several groups or runs have seen together."""
    return states.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"))


def estimate(sketch: str = "sketch") -> Column:
    return F.hll_sketch_estimate(sketch)
