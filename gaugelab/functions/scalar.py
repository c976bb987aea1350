"""Scalar functions: noise that doesn't depend on layout, formats, units, colours."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import specs


def uniform(seed: int, *keys) -> Column:
    """In (0, 1), from the MD5 of the seed and the keys: the same for a row wherever it is computed, also in another engine."""
    name = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in keys])
    bits = F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 52))


def gaussian(mean: float, std: float, seed: int, *keys) -> Column:
    """Normally distributed (Box-Muller over two hashes)."""
    radius = F.sqrt(-2.0 * F.log(uniform(seed, "radius", *keys)))
    return F.lit(float(mean)) + F.lit(float(std)) * radius * F.cos(F.lit(2 * math.pi) * uniform(seed, "angle", *keys))


def coin(seed: int, *keys) -> Column:
    return (uniform(seed, "coin", *keys) < 0.5).cast("int")


def missing(value: Column, rate: float, seed: int, *keys) -> Column:
    """Null with probability ``rate``."""
    return F.when(uniform(seed, "loss", *keys) >= rate, value)


def known(value: Column) -> Column:
    """NaN as null."""
    return F.nanvl(value, F.lit(None).cast("double"))


def linspace(i: Column, n: int, start: float, stop: float) -> Column:
    """End-inclusive."""
    return F.lit(float(start)) + i.cast("double") * F.lit((stop - start) / (n - 1) if n > 1 else 0.0)


def two_decimals(x: Column) -> Column:
    return F.format_string("%.2f", x)


def percent(x: Column) -> Column:
    return F.concat(two_decimals(x * 100), F.lit("%"))


def title(key: Column) -> Column:
    return F.initcap(F.replace(key, F.lit("_"), F.lit(" ")))


def run_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def _unit(table: dict[tuple[str, str], str], test: Column, key: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for (t, k), u in table.items() for x in (f"{t}/{k}", u)])
    return F.coalesce(F.try_element_at(pairs, F.concat_ws("/", test, key)), F.lit(""))


def column_unit(test: Column, column: Column) -> Column:
    return _unit(specs.COLUMN_UNITS, test, column)


def statistic_unit(test: Column, key: Column) -> Column:
    return _unit(specs.STATISTIC_UNITS, test, key)


def failure_colour(rate: Column) -> Column:
    """Of a failure rate in percent: red above 5, else green."""
    return F.when(rate > 5, "red").otherwise("green")


def pass_colour(rate: Column) -> Column:
    """Of a pass rate in percent: green above 95, else orange."""
    return F.when(rate > 95, "green").otherwise("orange")


def first_rate(failure: Column, passed: Column, overall: Column) -> Column:
    """The rate that a result shows: failure before pass before overall pass; a struct of label, percent and colour, null without any."""
    shown = lambda label, x, colour: F.struct(F.lit(label).alias("label"), (x * 100).alias("percent"), colour(x * 100).alias("colour"))
    return (
        F.when(failure.isNotNull(), shown("Failure Rate", failure, failure_colour))
        .when(passed.isNotNull(), shown("Pass Rate", passed, pass_colour))
        .when(overall.isNotNull(), shown("Overall Pass Rate", overall, pass_colour))
    )


def row_count_or(text: str, default: int = 10) -> int:
    """A number of rows as typed; anything but digits gives the default."""
    return int(text) if text.isdigit() else default
