"""Serving views: what dashboards and the command line show, as frames. Views of nothing are empty frames with the usual columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from ..plans.specs import SPECS, TestSpec
from . import spc, stats
from .normalize import numeric_columns, x_axis

RATES = ("failure_rate", "pass_rate", "overall_pass_rate")


def latest_artifacts(files: DataFrame) -> DataFrame:
    """``(test_name, kind, path)`` of the newest file of each kind; of equally new ones, that of the last path."""
    return files.groupBy("test_name", "kind").agg(F.max_by("path", F.struct("modified", "path")).alias("path"))


def artifact_counts(files: DataFrame, kinds: tuple[str, ...] = ("png", "json", "csv")) -> DataFrame:
    return files.groupBy("test_name").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds])


def file_listing(files: DataFrame) -> DataFrame:
    return files.select("test_name", "path", "length").orderBy("test_name", "path")


def statistics(documents: DataFrame, test_name: str) -> DataFrame:
    """Result documents -> ``(test_name, statistic, unit, mean, std, min, max)``, for every entry with a mean, nested ones too."""
    parts: list[Column] = []
    for f in documents.schema.fields:
        kind = f.dataType
        if kind.typeName() == "struct" and "mean" in kind.names:
            parts.append(F.array(F.struct(F.lit(f.name).alias("statistic"), *[F.col(f"{f.name}.{s}").alias(s) for s in stats.FOUR])))
        elif kind.typeName() == "map":
            nested = F.transform(F.map_entries(f.name), lambda e: F.struct(F.concat(e["key"], F.lit("_stats")).alias("statistic"), *[e["value"][s].alias(s) for s in stats.FOUR]))
            parts.append(nested)
    rows = documents.select(F.explode(F.concat(*parts)).alias("s")).select(F.lit(test_name).alias("test_name"), "s.*").where("mean is not null")
    return rows.select("test_name", "statistic", scalar.statistic_unit(F.col("test_name"), F.col("statistic")).alias("unit"), *stats.FOUR)


def capability_view(documents: DataFrame, test_name: str) -> DataFrame:
    names = [f.name for f in documents.schema.fields if f.dataType.typeName() == "struct" and "cp" in f.dataType.names]
    rows = [F.struct(F.lit(n.removesuffix("_capability")).alias("parameter"), F.col(f"{n}.cp").alias("cp"), F.col(f"{n}.cpk").alias("cpk")) for n in names]
    empty = "array<struct<parameter:string,cp:double,cpk:double>>"
    return documents.select(F.explode(F.array(*rows) if rows else F.array().cast(empty)).alias("r")).select(F.lit(test_name).alias("test_name"), "r.*")


def rate_card(documents: DataFrame) -> DataFrame:
    """``(label, shown, colour)`` of the rate that a result shows."""
    have = [F.col(r) if r in documents.columns else F.lit(None).cast("double") for r in RATES]
    card = documents.select(scalar.first_rate(*have).alias("c")).where("c is not null")
    return card.select("c.label", F.concat(scalar.two_decimals(F.col("c.percent")), F.lit("%")).alias("shown"), "c.colour")


def summary_cards(documents: DataFrame, test_name: str) -> DataFrame:
    """The rate's card and one for each statistic, as text."""
    card = rate_card(documents).select(F.col("label").alias("heading"), F.array("shown").alias("lines"), "colour")
    s = statistics(documents, test_name)
    text = lambda label, *cols: F.format_string(f"{label}: {' - '.join(['%.2f'] * len(cols))} %s", *cols, F.col("unit"))
    return card.unionByName(s.select(scalar.title(F.col("statistic")).alias("heading"), F.array(text("Mean", F.col("mean")), text("Std", F.col("std")), text("Range", F.col("min"), F.col("max"))).alias("lines"), F.lit(None).cast("string").alias("colour")))


def detail_table(documents: DataFrame, test_name: str) -> DataFrame:
    s = statistics(documents, test_name)
    shown = [F.concat_ws(" ", scalar.two_decimals(F.col(c)), F.when(F.col("unit") != "", F.col("unit"))).alias(c) for c in stats.FOUR]
    return s.select(scalar.title(F.col("statistic")).alias("parameter"), *shown)


def head_rows(df: DataFrame, n: int = 10, order: str | None = None) -> DataFrame:
    """The first n rows by the frame's order column."""
    return df.orderBy(order or x_axis(df)).limit(n)


def shape(df: DataFrame) -> DataFrame:
    """``(n_rows, n_columns, columns)``."""
    return df.agg(F.count("*").alias("n_rows")).select("n_rows", F.lit(len(df.columns)).alias("n_columns"), F.lit(", ".join(df.columns)).alias("columns"))


def time_series(df: DataFrame, test_name: str, first: int = 3) -> DataFrame:
    """``(x, parameter, unit, y)`` of the first numeric columns, unpivoted in one scan."""
    x, names = x_axis(df), numeric_columns(df, first=first)
    long = df.select(F.col(x).alias("x"), *[F.col(c).cast("double").alias(c) for c in names]).unpivot("x", names, "parameter", "y")
    return long.select("x", "parameter", scalar.column_unit(F.lit(test_name), F.col("parameter")).alias("unit"), "y")


def spc_chart(df: DataFrame, test_name: str, first: int = 2, places: int | None = None) -> DataFrame:
    """The time series of the first numeric columns with their control limits (rounded to ``places`` if given), which are aggregated side by side before anything is unpivoted."""
    names = numeric_columns(df, first=first)
    one = stats.wide(df, names)
    limits = one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("parameter"), F.col(f"{n}_mean").alias("m"), (3 * F.col(f"{n}_std")).alias("w")) for n in names])).alias("l"))
    limits = limits.select(F.col("l.parameter").alias("_parameter"), F.col("l.m").alias("cl"), (F.col("l.m") + F.col("l.w")).alias("ucl"), (F.col("l.m") - F.col("l.w")).alias("lcl"))
    if places is not None:
        limits = limits.select("_parameter", *[F.round(c, places).alias(c) for c in ("cl", "ucl", "lcl")])
    # at most ``first`` rows
    return time_series(df, test_name, first).join(F.broadcast(limits), F.col("parameter") == F.col("_parameter")).drop("_parameter")


def plot_panels(df: DataFrame, spec: TestSpec) -> DataFrame:
    """Series of a run's plots: ``(x, parameter, y, lower, upper)`` with the limits that are drawn."""
    limits = {p.name: (p.lower, p.upper) for p in spec.parameters}
    if spec.group:
        rows = df.select(F.col("test_point").alias("x"), F.col(spec.group).alias("parameter"), F.coalesce("resistance", "value").alias("y"))
        return rows.select("*", F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("upper"))
    pick = lambda k: F.create_map(*[v for n, l in limits.items() for v in (F.lit(n), F.lit(l[k]).cast("double"))])
    names = list(limits)
    long = df.select(F.col(x_axis(df)).alias("x"), *[F.col(n).cast("double").alias(n) for n in names]).unpivot("x", names, "parameter", "y")
    return long.select("*", F.try_element_at(pick(0), F.col("parameter")).alias("lower"), F.try_element_at(pick(1), F.col("parameter")).alias("upper"))


def spc_panels(df: DataFrame, spec: TestSpec) -> tuple[DataFrame, DataFrame]:
    """X-bar rows of all parameters, and R rows of those that have an R chart."""
    if spec.group:
        rows = df.select(F.col("sequence_num").alias("x"), F.col(spec.group).alias("parameter"), F.coalesce("resistance", "value").alias("y"))
    else:
        names = [p.name for p in spec.parameters]
        rows = df.select(F.col(x_axis(df) if "sample_idx" not in df.columns else "sample_idx").alias("x"), *[F.col(n).cast("double").alias(n) for n in names]).unpivot("x", names, "parameter", "y")
    ranged = [p.name for p in spec.parameters if p.moving_range]
    return spc.xbar_chart(rows, "y", ["parameter"]), spc.r_chart(rows.where(F.col("parameter").isin(ranged)) if ranged else rows.limit(0), "y", ["parameter"], ["x"])


def image_view(images: DataFrame) -> DataFrame:
    """``(test_name, path, source)`` of binary files, as data URLs."""
    return images.select("test_name", "path", F.concat(F.lit("data:image/png;base64,"), F.base64("content")).alias("source"))


def cross_test(documents: dict[str, DataFrame]) -> DataFrame:
    """Statistics of several tests' documents, one below the other."""
    out = None
    for name, d in documents.items():
        part = statistics(d, name)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no documents")
    return out


def register(views: dict[str, DataFrame]) -> None:
    """Names the frames for SQL."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)


def known_tests() -> list[str]:
    return list(SPECS)
