"""Operators that need the order of a series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spc import SLICE_ROWS, checked, slices

HOLD = 4


def circular_shift(df: DataFrame, value: str, by: list[str], index: str, k: int) -> DataFrame:
    """``value`` moved on by k places in each series of gapless 0-based ``index``, the end coming round.

    Values keep their rows and get a new index, so nothing is sorted or shuffled but a count for each series. Only other columns, which stay where
    they were, have to be joined to them, by series and index, which parts evenly.
    """
    n = df.groupBy(*by).agg(F.count("*").alias("_n"))
    if by:
        n = checked(n.select(*[F.col(b).alias(f"_on_{b}") for b in by], "_n"))
        moved = df.join(n, [F.col(b).eqNullSafe(F.col(f"_on_{b}")) for b in by])  # a row for each series
    else:
        moved = df.join(F.broadcast(n))  # one row
    place = F.pmod(F.col(index) + k, F.col("_n"))
    if set(df.columns) == {*by, index, value}:
        return moved.select(*[place.alias(index) if c == index else F.col(c) for c in df.columns])
    source = moved.select(*[F.col(b).alias(f"_{b}") for b in by], place.alias("_i"), F.col(value).alias("_v"))
    on = [df[b].eqNullSafe(F.col(f"_{b}")) for b in by] + [df[index] == F.col("_i")]
    return df.join(source, on).select(*[F.col("_v").alias(c) if c == value else df[c] for c in df.columns])


def numbered(df: DataFrame, by: list[str], order: list[str], name: str, of: Column | None = None) -> DataFrame:
    """``df`` with the 0-based place of each row in its series (long): its place in a slice, and the rows of the slices before."""
    of = slices(df, order[0], by=by) if of is None else of
    if of is None:  # all rows fit in a slice
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(F.lit(0), *by).orderBy(*order)) - 1).cast("long"))
    sliced = df.withColumn("_slice", of)
    names = [*by, "_slice"]
    counts = sliced.groupBy(*names).agg(F.count("*").alias("_n"))
    up = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # a row for each slice
    before = counts.select(*[F.col(c).alias(f"_on_{c}") for c in names], F.coalesce(F.sum("_n").over(up), F.lit(0)).alias("_before"))
    own = sliced.withColumn("_at", F.row_number().over(Window.partitionBy(*names).orderBy(*order)) - 1)
    out = own.join(before, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in names])
    return out.select(*df.columns, (F.col("_before") + F.col("_at")).cast("long").alias(name))


def debounce(df: DataFrame, value: str, by: list[str], index: str) -> DataFrame:
    """``(*by, index, value)`` with each change of state held for the next HOLD samples; series of any number and length."""
    return debounce_sliced(df, value, by, index, SLICE_ROWS)


def debounce_long(df: DataFrame, value: str, by: list[str], index: str) -> DataFrame:
    """The same for series of up to SLICE_ROWS samples, whose sorted partitions are streamed through, with one state for each series and none of its rows
    kept. If a series is longer, or there is no key, all go in slices."""
    import pandas as pd

    if not by or df.count() > SLICE_ROWS and df.agg(F.max(index)).first()[0] >= SLICE_ROWS:
        return debounce_sliced(df, value, by, index, SLICE_ROWS)

    cols = [*by, index, value]

    def run(frames):
        series, last, left = None, None, 0
        for f in frames:
            keys = list(zip(*[f[b] for b in by])) if by else [()] * len(f)
            out = []
            for key, x in zip(keys, f[value].tolist()):
                if key != series:
                    series, last, left = key, None, 0
                if left > 0:
                    left -= 1
                else:
                    left = HOLD if last is not None and x != last else 0
                    last = x
                out.append(last)
            yield pd.DataFrame({**{c: f[c] for c in [*by, index]}, value: pd.array(out, dtype="int32")})

    src = df.select(*by, index, F.col(value).cast("int").alias(value))
    src = src.repartition(*[F.col(b) for b in by]).sortWithinPartitions(*by, index)
    return src.select(cols).mapInPandas(run, src.select(cols).schema)


def _moves() -> list[list[int]]:
    """State after a sample, for either sample and each state: 0 before any, then 1 + 5 * state held + samples left to hold."""
    out = []
    for x in (0, 1):
        row = [1 + 5 * x]
        for state in range(1, 11):
            last, left = divmod(state - 1, 5)
            row.append(state - 1 if left else state if x == last else 1 + 5 * x + HOLD)
        out.append(row)
    return out


#: Slices whose maps one task applies one after the other.
STRETCH = 10_000


def _starts(found: DataFrame, by: list[str], keys: str, starts, composed, many: bool) -> DataFrame:
    """The state that each slice begins in, from the maps of all slices (a row of eleven numbers for each). Many slices are taken in stretches,
    whose composed maps are applied first."""
    first = found.withColumn("begin", F.lit(0))
    if not many:
        return first.groupBy(*by).applyInPandas(starts, f"{keys}, begin int")
    parted = found.withColumn("_stretch", F.floor(F.col("_slice") / STRETCH).cast("long"))
    part_keys = keys.replace("`_slice`", "`_stretch`")
    whole = parted.groupBy(*by, "_stretch").applyInPandas(composed, f"{part_keys}, m array<int>").withColumn("begin", F.lit(0))
    begin = whole.groupBy(*by).applyInPandas(starts, f"{part_keys}, begin int")
    names = [*by, "_stretch"]
    on = [F.col(n).eqNullSafe(F.col(f"_on_{n}")) for n in names]
    each = parted.join(begin.select(*[F.col(n).alias(f"_on_{n}") for n in names], "begin"), on).select(*by, "_slice", "m", "begin", "_stretch")
    return each.groupBy(*names).applyInPandas(starts, f"{keys}, begin int")


def debounce_sliced(df: DataFrame, value: str, by: list[str], index: str, width: int) -> DataFrame:
    """The same where single series are too long for a task. Samples are 0 or 1.

    What a slice of the index does to a series is a map of eleven states. Slices find theirs side by side; the maps are applied one after the
    other (a row for each slice), and each slice then runs again from the state it begins with.
    """
    import pandas as pd

    moves, names = _moves(), [*by, "_slice"]
    src = df.select(*by, index, F.col(value).cast("int").alias(value), F.floor(F.col(index) / F.lit(width)).cast("long").alias("_slice"))
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.select(names).schema.fields)
    dealt = lambda d: d.repartition(*[F.col(n) for n in names]).sortWithinPartitions(*names, index)

    def maps(frames):
        key, m = None, []
        for f in frames:
            rows = []
            for k, x in zip(zip(*[f[n] for n in names]), f[value].tolist()):
                if k != key:
                    if key is not None:
                        rows.append((*key, m))
                    key, m = k, list(range(11))
                step = moves[x]
                m = [step[s] for s in m]
            yield pd.DataFrame(rows, columns=[*names, "m"])
        if key is not None:
            yield pd.DataFrame([(*key, m)], columns=[*names, "m"])

    def composed(f):
        f = f.sort_values("_slice")
        m = list(range(11))
        for step in f["m"]:
            m = [int(step[x]) for x in m]
        return f[[*by, "_stretch"]].head(1).assign(m=[m])

    def starts(f):
        part = "_slice" if "_slice" in f else "_stretch"
        f = f.sort_values(part)
        state, out = int(f["begin"].iloc[0]), []
        for m in f["m"]:
            out.append(state)
            state = int(m[state])
        return f[[*by, part]].assign(begin=out)

    def run(frames):
        key, state = None, 0
        for f in frames:
            out = []
            for k, x, begin in zip(zip(*[f[n] for n in names]), f[value].tolist(), f["begin"].tolist()):
                if k != key:
                    key, state = k, begin
                state = moves[x][state]
                out.append((state - 1) // 5)
            yield f[[*by, index]].assign(**{value: pd.array(out, dtype="int32")})

    found = dealt(src).mapInPandas(maps, f"{keys}, m array<int>")
    found = _starts(found, by, keys, starts, composed, df.count() // width >= STRETCH)
    on = [F.col(n).eqNullSafe(F.col(f"_on_{n}")) for n in names]
    both = src.join(found.select(*[F.col(n).alias(f"_on_{n}") for n in names], "begin"), on).select(*names, index, value, "begin")
    return dealt(both).mapInPandas(run, src.select(*by, index, value).schema)
