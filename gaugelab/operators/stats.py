"""Summary statistics, rates and capability. Nulls and NaN are left out; the deviation is that of a sample."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import known
from ..plans.specs import Parameter, TestSpec

FOUR = ("mean", "std", "min", "max")


def _four(v: Column) -> list[Column]:
    return [F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max")]


def _cleaned(df: DataFrame, by: list[str], **values: Column) -> DataFrame:
    """``by`` and the values as doubles with NaN as null, worked out once, before they are aggregated many times."""
    kinds = dict(df.select(*[v.alias(n) for n, v in values.items()]).dtypes)
    exact = ("tinyint", "smallint", "int", "bigint")  # these have no NaN
    return df.select(*by, *[(v.cast("double") if kinds[n] in exact else known(v.cast("double"))).alias(n) for n, v in values.items()])


def wide(df: DataFrame, parameters: list[str], by: list[str] = []) -> DataFrame:  # noqa: B006
    """``<parameter>_<statistic>`` columns, all in one pass."""
    clean = _cleaned(df, by, **{p: F.col(p) for p in parameters})
    return clean.groupBy(*by).agg(*[c.alias(f"{p}_{s}") for p in parameters for c, s in zip(_four(F.col(p)), FOUR)])


def long(df: DataFrame, parameters: list[str], by: list[str] = []) -> DataFrame:  # noqa: B006
    """A row for each parameter: ``(*by, parameter, n, mean, std, min, max)``; one pass, unpivoted after the aggregation."""
    clean = _cleaned(df, by, **{p: F.col(p) for p in parameters})
    one = clean.groupBy(*by).agg(*[c.alias(f"{p}_{s}") for p in parameters for c, s in zip([F.count(p), *_four(F.col(p))], ("n", *FOUR))])
    each = [F.struct(F.lit(p).alias("parameter"), *[F.col(f"{p}_{s}").alias(s) for s in ("n", *FOUR)]) for p in parameters]
    return one.select(*by, F.explode(F.array(*each)).alias("r")).select(*by, "r.*")


def grouped(df: DataFrame, by: str, value: Column, flag: str | None = None, order: str | None = None) -> DataFrame:
    """Statistics of ``value`` for each category, with the pass rate of ``flag`` and, from ``order``, the category's first place."""
    more = [rate(flag).alias("pass_rate")] if flag else []
    more += [F.min(order).alias("first_seen")] if order else []
    clean = df.withColumn("_v", known(value.cast("double")))
    return clean.groupBy(by).agg(F.count("_v").alias("n"), *_four(F.col("_v")), *more)


def rate(flag: str) -> Column:
    return F.avg(F.col(flag).cast("double"))


def categories(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def capability(mean: Column, std: Column, lower: float | None, upper: float | None) -> dict[str, Column]:
    """``cp`` and ``cpk``: the nearer limit's distance in three deviations (the two are the same here), and ``cp_potential``: the limits' width in six. Null without limits or spread."""
    three = F.nullif(3 * std, F.lit(0.0))
    sides = [F.lit(upper) - mean] * (upper is not None) + [mean - F.lit(lower)] * (lower is not None)
    none = F.lit(None).cast("double")
    near = none if not sides else (sides[0] if len(sides) == 1 else reduce(lambda a, b: F.when(a <= b, a).otherwise(b), sides)) / three
    return {"cp": near, "cpk": near, "cp_potential": none if len(sides) < 2 else F.lit(upper - lower) / (2 * three)}


def capabilities(stats: DataFrame, parameters: tuple[Parameter, ...], prefix: str = "") -> DataFrame:
    """Wide statistics -> ``<parameter>_cp``, ``_cpk`` and ``_cp_potential`` for the parameters with an upper limit."""
    cols = [c.alias(f"{p.name}_{k}") for p in parameters if p.upper is not None for k, c in capability(F.col(f"{p.name}_mean"), F.col(f"{p.name}_std"), p.lower, p.upper).items()]
    return stats.select(*cols)


def document(df: DataFrame, spec: TestSpec, stamp: Column) -> DataFrame:
    """The result document of a run as one row: rate, statistics, capability, time. One pass over the data."""
    if spec.group:
        value = F.coalesce(F.col("resistance"), F.col("value"))
        each = grouped(df, spec.group, value, spec.flag).select(spec.group, F.struct("pass_rate", *FOUR).alias("s"))
        rows = each.agg(F.map_from_entries(F.collect_list(F.struct(spec.group, "s"))).alias(f"{spec.group}_stats"))
        total = df.agg(rate(spec.flag).alias(spec.rate))
        return total.join(rows).select(spec.rate, f"{spec.group}_stats", stamp.alias("timestamp"))  # one row each
    names = [p.name for p in spec.parameters]
    one = _cleaned(df, [spec.flag], **{p: F.col(p) for p in names}).agg(rate(spec.flag).alias(spec.rate), *[F.struct(*_four(F.col(p))).alias(f"{p}_stats") for p in names])
    limits = [p for p in spec.parameters if p.upper is not None]
    caps = []
    for p in limits:
        c = capability(F.col(f"{p.name}_stats.mean"), F.col(f"{p.name}_stats.std"), p.lower, p.upper)
        caps.append(F.struct(c["cp"].alias("cp"), c["cpk"].alias("cpk")).alias(f"{p.name}_capability"))
    return one.select(spec.rate, *[f"{p}_stats" for p in names], *caps, stamp.alias("timestamp"))


def success(df: DataFrame, flag: str = "success") -> DataFrame:
    """Runs that succeeded, all runs, and the share in percent (null without runs)."""
    out = df.agg(F.count_if(F.col(flag)).alias("n_success"), F.count("*").alias("n_total"))
    return out.withColumn("percent", 100.0 * F.col("n_success") / F.nullif(F.col("n_total"), F.lit(0)))
