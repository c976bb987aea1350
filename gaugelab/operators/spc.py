"""Control limits, moving ranges, and chart frames. Limits are one aggregation, joined back as one row for each chart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import known


def control_limits(df: DataFrame, value: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """``(*by, cl, ucl, lcl)``: the mean, and three deviations above and below it."""
    x = known(F.col(value).cast("double"))
    one = df.select(*by, x.alias("_x")).groupBy(*by).agg(F.avg("_x").alias("cl"), F.stddev_samp("_x").alias("_s"))
    return one.select(*by, "cl", (F.col("cl") + 3 * F.col("_s")).alias("ucl"), (F.col("cl") - 3 * F.col("_s")).alias("lcl"))


def moving_range(value: str, by: list[str], order: list[str]) -> Column:
    """Absolute difference to the row before; null for the first row and next to a missing value. For many short series; see ``moving_ranges`` for long ones."""
    x = known(F.col(value).cast("double"))
    return F.abs(x - F.lag(x).over(Window.partitionBy(*by).orderBy(*order)))


def rolling_range(value: str, k: int, by: list[str], order: list[str]) -> Column:
    """Largest less smallest of the last k values; null unless all k are there. For many short series; see ``rolling_ranges`` for long ones."""
    x = known(F.col(value).cast("double"))
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - k, 0)
    return F.when(F.count(x).over(w) == k, F.max(x).over(w) - F.min(x).over(w))


def moving_range_sliced(df: DataFrame, value: str, by: list[str], index: str, width: int) -> DataFrame:
    """``moving_ranges`` by any numeric ``index``, gaps allowed, where a slice holds the rows with index in [k * width, (k + 1) * width)."""
    return moving_ranges(df, value, by, [index], F.floor(F.col(index) / F.lit(width)).cast("long"))


#: Rows of a series that one task is meant to hold.
SLICE_ROWS = 200_000


#: A table of a row for each series or chart is broadcast if it has no more rows, and no more bytes.
MOST_BROADCAST = 20_000
BROADCAST_BYTES = 8_000_000

#: Slices of all series together; beyond so many rows times SLICE_ROWS they grow with the data.
MOST_SLICES = 4_096


def checked(table: DataFrame) -> DataFrame:
    """A table of a row for each series or chart: worked out at once, and broadcast, if it has few rows and bytes; else joined as Spark sees fit. Nothing is kept."""
    held = table.limit(MOST_BROADCAST + 1).toArrow()
    if held.num_rows > MOST_BROADCAST or held.nbytes > BROADCAST_BYTES:
        return table
    return F.broadcast(table.sparkSession.createDataFrame(held, table.schema))


def as_number(df: DataFrame, column: str) -> Column:
    """A number or a time as a double (seconds), null for NaN."""
    kind = dict(df.dtypes)[column]
    return known(F.col(column).cast("timestamp").cast("double") if kind.startswith("timestamp") or kind == "date" else F.col(column).cast("double"))


def cut_points(df: DataFrame, by: list[str], column: str, rows: int | None = None) -> list[float]:
    """Values of ``column`` that part the rows of the series with more than ``rows`` rows into slices of about so many; none if no series is so long.

    Cuts are quantiles, so that outliers, bursts and gaps leave the slices even; of equal values all stay in one slice.
    """
    rows = rows or SLICE_ROWS
    if df.count() <= rows:
        return []
    counts = df.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > rows)
    total = counts.agg(F.sum("_n")).first()[0]
    if not total:
        return []
    return quantile_cuts(df, by, column, counts, total, rows)


def slice_count(total: int, rows: int) -> int:
    """Of how many slices ``total`` rows are, if no cuts are equal."""
    return min(MOST_SLICES, -(-total // rows))


def quantile_cuts(df: DataFrame, by: list[str], column: str, series: DataFrame, total: int, rows: int) -> list[float]:
    """The cuts of the ``series`` named, which have ``total`` rows."""
    parts = slice_count(total, rows)
    some = df.select(*by, as_number(df, column).alias("_x"))
    if by:
        names = {b: f"_on_{b}" for b in by}
        some = some.join(series.select(*[F.col(b).alias(n) for b, n in names.items()]), [F.col(b).eqNullSafe(F.col(n)) for b, n in names.items()], "left_semi")
    found = some.approxQuantile("_x", [k / parts for k in range(1, parts)], 0.2 / parts)
    return sorted(set(found))


def sliced(df: DataFrame, column: str, cuts: list[float]) -> Column:
    """The number of the slice that a row is in; missing values come first. A binary search in one array, so that thousands of cuts are planned and looked up
    as fast as a few."""
    x = as_number(df, column)
    span = 1 << len(cuts).bit_length()  # above the number of cuts
    held = F.split(F.lit(",".join([*map(repr, map(float, cuts)), *["Infinity"] * (span - len(cuts))])), ",").cast("array<double>")  # folded to a constant
    steps = F.array(*[F.lit(span >> k) for k in range(1, span.bit_length())])
    passed = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.element_at(held, at + step) <= x, at + step).otherwise(at)) if cuts else F.lit(0)
    return F.when(x.isNull(), F.lit(0).cast("long")).otherwise(F.least(passed, F.lit(len(cuts))).cast("long") + 1)


def slices(df: DataFrame, column: str, rows: int | None = None, by: list[str] = []) -> Column | None:  # noqa: B006
    """A slice number that rises with ``column``, a number or a time, for slices of about so many rows of the long series; None if none is longer."""
    cuts = cut_points(df, by, column, rows)
    return sliced(df, column, cuts) if cuts else None


def with_tails(df: DataFrame, by: list[str], order: list[str], of: Column, k: int) -> DataFrame:
    """``df`` with ``_slice`` and ``_own``, and before the rows of each slice the last k - 1 rows that its series has before it, which aren't its own.

    So a window over k rows can be partitioned by series and slice. ``of`` numbers the slices and rises with the first of ``order``. What goes from slice
    to slice is k - 1 rows, whatever the slices hold; a series of any length is many tasks' work.
    """
    sliced = df.withColumn("_slice", of)
    names, columns = [*by, "_slice"], [c for c in df.columns if c not in by]
    last = Window.partitionBy(*names).orderBy(*[F.col(c).desc() for c in order])
    tails = sliced.withColumn("_r", F.row_number().over(last)).where(F.col("_r") < k)  # pruned before the shuffle
    packed = tails.groupBy(*names).agg(F.sort_array(F.collect_list(F.struct("_r", *columns))).alias("_t"))
    near = Window.partitionBy(*by).orderBy(F.col("_slice").desc()).rowsBetween(1, max(1, k - 1))  # a row for each slice; none is empty
    before = packed.select(*names, F.collect_list("_t").over(near).alias("_b"))
    before = before.select(*names, F.explode(F.slice(F.flatten("_b"), 1, max(1, k - 1))).alias("_t"))
    return sliced.withColumn("_own", F.lit(True)).unionByName(before.select(*names, *[F.col(f"_t.{c}").alias(c) for c in columns], F.lit(False).alias("_own")))


def _near(df: DataFrame, by: list[str], order: list[str], of: Column | None, k: int) -> tuple[DataFrame, list[str]]:
    """Rows for a window over k rows, and what to partition it by: series and slices, or series alone if all rows fit in a slice."""
    of = slices(df, order[0], by=by) if of is None else of
    if of is None:
        return df.withColumns({"_own": F.lit(True), "_slice": F.lit(0)}), [*by, "_slice"]
    return with_tails(df, by, order, of, k), [*by, "_slice"]


def rolling_ranges(df: DataFrame, value: str, k: int, by: list[str], order: list[str], of: Column | None = None) -> DataFrame:
    """``df`` with ``rolling_range``: largest less smallest of the last k values; null unless all k are there."""
    near, names = _near(df, by, order, of, k)
    x = known(F.col(value).cast("double"))
    w = Window.partitionBy(*names).orderBy(*order).rowsBetween(1 - k, 0)
    out = near.withColumn("rolling_range", F.when(F.count(x).over(w) == k, F.max(x).over(w) - F.min(x).over(w)))
    return out.where("_own").select(*df.columns, "rolling_range")


def moving_ranges(df: DataFrame, value: str, by: list[str], order: list[str], of: Column | None = None) -> DataFrame:
    """``df`` with ``moving_range``: the absolute difference to the row before; null for the first row and next to a missing value.

    Series may be few and long: the work is parted by series and slice, and only the last row of a slice goes on to the next.
    """
    near, names = _near(df, by, order, of, 2)
    x = known(F.col(value).cast("double"))
    out = near.withColumn("moving_range", F.abs(x - F.lag(x).over(Window.partitionBy(*names).orderBy(*order))))
    return out.where("_own").select(*df.columns, "moving_range")


def _with_limits(df: DataFrame, limits: DataFrame, by: list[str], places: int | None) -> DataFrame:
    """Limits are a row for each chart, so they are rounded before they meet the rows."""
    if places is not None:
        limits = limits.select(*by, *[F.round(c, places).alias(c) for c in ("cl", "ucl", "lcl")])
    limits = checked(limits)
    if not by:
        return df.join(limits)
    on = [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by]
    return df.join(limits.withColumnsRenamed({b: f"_{b}" for b in by}), on).drop(*[f"_{b}" for b in by])


def xbar_chart(df: DataFrame, value: str, by: list[str] = [], places: int | None = None) -> DataFrame:  # noqa: B006
    """Each row with its chart's ``cl``, ``ucl`` and ``lcl``, rounded to ``places`` if given."""
    return _with_limits(df, control_limits(df, value, by), by, places)


def r_chart(df: DataFrame, value: str, by: list[str], order: list[str], places: int | None = None) -> DataFrame:
    """Each row with its moving range and the limits of the ranges; the lower one may be negative."""
    ranges = moving_ranges(df, value, by, order)
    return _with_limits(ranges, control_limits(ranges, "moving_range", by), by, places)


def out_of_limits(chart: DataFrame, value: str) -> DataFrame:
    return chart.where((F.col(value) > F.col("ucl")) | (F.col(value) < F.col("lcl")))
