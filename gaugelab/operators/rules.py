"""Pass and fail predicates. A missing or NaN measurement never satisfies a comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import known
from ..plans.specs import Rule, TestSpec


def holds(rule: Rule, value: Column | None = None) -> Column:
    x = known((F.col(rule.column) if value is None else value).cast("double"))
    found = {
        "below": lambda: x < rule.low,
        "at_most": lambda: x <= rule.low,
        "at_least": lambda: x >= rule.low,
        "above": lambda: x > rule.low,
        "within": lambda: x.between(rule.low, rule.high),
        "near": lambda: F.abs(x - rule.low) / rule.low <= rule.high,
    }[rule.kind]()
    return F.coalesce(found, F.lit(False))


def all_hold(rules: tuple[Rule, ...]) -> Column:
    return reduce(lambda a, b: a & b, map(holds, rules), F.lit(True))


def with_flag(df: DataFrame, spec: TestSpec) -> DataFrame:
    """The test type's flag as 0 or 1."""
    return df.withColumn(spec.flag, all_hold(spec.rules).cast("int"))


def scaled(value: Column, factor: float, offset: float = 0.0, absolute: bool = False) -> Column:
    return (F.abs(value) if absolute else value) * F.lit(float(factor)) + F.lit(float(offset))


def milli_product(a: Column, b: Column) -> Column:
    """Power in mW of mV and mA."""
    return a * b / 1000


def in_category(df: DataFrame, column: str, value: str) -> DataFrame:
    return df.where(F.col(column) == value)
