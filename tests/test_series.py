"""Slices, alignment, windows of time, percentiles, merged states, relational tables and streams against plain versions."""

import math
import os
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugelab.operators import align, rolling, sequence, spc, summaries
from gaugelab.sinks import writers
from gaugelab.sources import ingest, readers
from gaugelab.streaming import ingest as stream_ingest
from gaugelab.streaming import live

T0 = datetime(2024, 1, 1)


def frame(spark, rows, shape):
    return spark.createDataFrame(rows, shape).repartition(4)


def largest_slice(df, of):
    return df.groupBy("k", of.alias("s")).count().agg(F.max("count")).first()[0]


@pytest.mark.parametrize("by", [["k"], []])
def test_slices_stay_even_with_outliers_bursts_and_gaps(spark, by):
    rng = np.random.default_rng(1)
    times = np.concatenate([rng.uniform(0, 10, 3000), rng.uniform(500, 500.001, 3000), [10.0**10, -(10.0**12)]])
    rows = [("hot", i, float(t), float(i % 97)) for i, t in enumerate(times)] + [(f"c{i % 50}", i, float(i), 1.0) for i in range(500)]
    df = frame(spark, rows, "k string, i long, t double, x double")
    of = spc.slices(df, "t", 500, by)
    assert largest_slice(df, of) <= 1000
    cold = df.where("k <> 'hot'")
    assert spc.slices(cold, "t", 500, ["k"]) is None  # many short series aren't cut
    want = {(r.k, r.i): r.r for r in df.withColumn("r", spc.moving_range("x", ["k"], ["t", "i"])).collect()}
    got = {(r.k, r.i): r.moving_range for r in spc.moving_ranges(df, "x", ["k"], ["t", "i"], of).collect()}
    assert got == want


def test_slices_of_one_value_and_of_missing_ones(spark):
    df = frame(spark, [("a", 1.0, 1.0)] * 50 + [("a", None, 2.0)] * 5 + [("a", float("nan"), 2.0)] * 5, "k string, t double, x double")
    of = spc.slices(df, "t", 10, ["k"])
    assert of is None or df.select(of.alias("s")).where("s IS NULL").count() == 0


def test_nothing_stays_in_memory(spark):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    df = frame(spark, [("a", i, float(i)) for i in range(9)], "k string, i long, x double")
    assert spc.xbar_chart(df, "x", ["k"]).count() == 9
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_shift_keeps_other_columns(spark):
    df = frame(spark, [(k, i, float(i), f"{k}{i}") for k, n in (("a", 7), (None, 3)) for i in range(n)], "k string, i long, x double, note string")
    for k in (2, -1, 9):
        got = {(r.k, r.i): (r.x, r.note) for r in sequence.circular_shift(df, "x", ["k"], "i", k).collect()}
        assert got == {(s, i): (float((i - k) % n), f"{s}{i}" if s else f"{s}{i}") for s, n in (("a", 7), (None, 3)) for i in range(n)}
        plain = sequence.circular_shift(df.drop("note"), "x", ["k"], "i", k)
        assert {(r.k, r.i): r.x for r in plain.collect()} == {key: v[0] for key, v in got.items()}
        assert "SortMergeJoin" not in plain._jdf.queryExecution().executedPlan().toString()


def test_debounce_in_stretches(spark, monkeypatch):
    rng = np.random.default_rng(3)
    data = {k: rng.integers(0, 2, n).tolist() for k, n in (("a", 230), ("b", 3))}
    df = frame(spark, [(k, i, x) for k, xs in data.items() for i, x in enumerate(xs)], "k string, i long, x int")
    want = sequence.debounce(df, "x", ["k"], "i").collect()
    monkeypatch.setattr(sequence, "STRETCH", 4)
    assert sorted(map(tuple, sequence.debounce_sliced(df, "x", ["k"], "i", 7).collect())) == sorted(map(tuple, want))
    monkeypatch.setattr(sequence, "SLICE_ROWS", 50)
    assert sorted(map(tuple, sequence.debounce_long(df, "x", ["k"], "i").collect())) == sorted(map(tuple, want))


def channels(rng, n, hot):
    key = lambda: "hot" if rng.random() < hot else rng.choice(["a", "b", "c"])
    return [(key() if rng.random() > 0.02 else None, i, T0 + timedelta(seconds=int(rng.integers(0, 400))) if rng.random() > 0.02 else None, float(i)) for i in range(n)]


@pytest.mark.parametrize("rows", [None, 40])
@pytest.mark.parametrize("within", [None, 30])
def test_asof_against_a_plain_version(spark, rows, within):
    """Most rows have one key; ties in time, missing keys and times, several slices."""
    rng = np.random.default_rng(7)
    lefts, rights = channels(rng, 300, 0.8), channels(rng, 200, 0.8)
    shape = "k string, i long, t timestamp, x double"
    left, right = frame(spark, lefts, shape), frame(spark, rights, shape).select("k", "t", F.col("i").alias("j"), F.when(F.col("i") % 5 > 0, F.col("x")).alias("y"))
    for by in (["k"], []):
        got = align.asof_join(left, right, by, "t", ["j", "y"], ["j"], within, rows)
        assert got.columns == ["k", "i", "t", "x", "j", "y"]
        for r in got.collect():
            past = [(t, j) for k, j, t, _ in rights if t is not None and r.t is not None and t <= r.t and (not by or k is not None and k == r.k)]
            t, j = max(past, default=(None, None))
            if t is not None and within is not None and (r.t - t).total_seconds() > within:
                j = None
            assert (r.j, r.y) == (j, float(j) if j is not None and j % 5 else None)
    plan = align.asof_join(left, right, ["k"], "t", ["j"], ["j"], rows=40)
    of = plan.count()
    assert of == 300


def test_asof_of_a_hot_key_is_many_tasks(spark):
    df = spark.range(4000).select(F.lit("hot").alias("k"), (F.col("id") * 3 % 4001).cast("double").alias("t"), F.col("id").alias("j"))
    both = df.unionByName(df)
    of = spc.sliced(both, "t", spc.cut_points(both, ["k"], "t", 500))
    assert both.select(of.alias("s")).distinct().count() >= 12
    got = align.asof_join(df.select("k", "t"), df.select("k", "t", "j"), ["k"], "t", ["j"], rows=500)
    assert got.where(F.col("t") != F.col("j") * 3 % 4001).count() == 0 and got.count() == 4000


def test_interval_join_against_a_plain_version(spark):
    rng = np.random.default_rng(5)
    rows = [("hot" if i % 4 else None if i % 8 else "b", i, float(rng.uniform(0, 1000)) if i % 50 else None) for i in range(600)]
    limits = []
    for j in range(80):
        a = float(rng.uniform(-50, 1000))
        b = a + float(10.0 ** rng.uniform(-4, 3.2))
        limits.append((["hot", "b", None][j % 3], j, None if j % 17 == 0 else a, None if j % 19 == 0 else b if j % 23 else a))
    df, lim = frame(spark, rows, "k string, i long, t double"), frame(spark, limits, "k string, j long, a double, b double")
    for by in (["k"], []):
        got = Counter((r.i, r.j) for r in align.interval_join(df, lim, by, "t", "a", "b", ["j"]).collect())
        want = Counter((i, j) for k, i, t in rows for k2, j, a, b in limits if t is not None and (not by or k is not None and k == k2) and (a is None or a <= t) and (b is None or t < b))
        assert got == want and len(want) > 500
        plan = align.interval_join(df, lim, by, "t", "a", "b", ["j"])._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert align.interval_join(df.limit(0), lim, ["k"], "t", "a", "b", ["j"]).count() == 0
    assert align.interval_join(df, lim.limit(0), ["k"], "t", "a", "b", ["j"]).count() == 0


@pytest.mark.parametrize("by", [["k"], []])
def test_interval_join_in_slices(spark, by):
    """Hot and short series, open and closed intervals: the same pairs however long series are cut, and rows aren't copied before they are joined."""
    rng = np.random.default_rng(6)
    rows = [("hot" if i % 4 else None if i % 8 else f"c{i % 48}", i, float(rng.choice([rng.uniform(0, 1000), 500.0]))) for i in range(600)]
    limits = [(["hot", "c0", None][j % 3], j, None if j % 17 == 0 else a, None if j % 19 == 0 else a + float(10.0 ** rng.uniform(-4, 3.2))) for j, a in enumerate(rng.uniform(-200, 1200, 90).tolist())]
    df, lim = frame(spark, rows, "k string, i long, t double"), frame(spark, limits, "k string, j long, a double, b double")
    want = Counter((i, j) for k, i, t in rows for k2, j, a, b in limits if (not by or k is not None and k == k2) and (a is None or a <= t) and (b is None or t < b))
    for most in (20, 200, 10_000):
        joined = align.interval_join(df, lim, by, "t", "a", "b", ["j"], most)
        assert Counter((r.i, r.j) for r in joined.collect()) == want and len(want) > 500
        plan = joined._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Generate explode") == (1 if most < 600 or not by else 0)  # of intervals alone


@pytest.mark.parametrize("by", [["k"], []])
def test_interval_join_has_tasks_by_its_pairs(spark, by, monkeypatch):
    """Few bytes and many pairs: tasks are counted by pairs; where one time holds most rows, Spark is left to part the join."""
    monkeypatch.setattr(align, "TASK_PAIRS", 1_000, raising=False)
    hot = F.when(F.col("id") < 5000, "hot").alias("k")  # no constant, which would drop out of the keys
    df = spark.range(2000).select(hot, F.col("id").alias("i"), (F.col("id") * 7 % 2003).cast("double").alias("t"))
    lim = spark.range(100).select(hot, F.col("id").alias("j"), (F.col("id") * 10).cast("double").alias("a"), (F.col("id") * 10 + 900).cast("double").alias("b"))
    joined = align.interval_join(df, lim, by, "t", "a", "b", ["j"], 50)
    want = Counter((i, j) for i in range(2000) for j in range(100) if j * 10 <= i * 7 % 2003 < j * 10 + 900)
    assert Counter((r.i, r.j) for r in joined.collect()) == want and len(want) > 80_000
    assert joined.rdd.getNumPartitions() == 40  # as many as slices; session's and AQE's are 4 at most
    monkeypatch.setattr(align, "MOST_TIED", 1_000, raising=False)
    tied = df.withColumn("t", F.when(F.col("i") < 1500, 300.0).otherwise(F.col("t")))
    joined = align.interval_join(tied, lim, by, "t", "a", "b", ["j"], 50)
    assert joined.rdd.getNumPartitions() <= 4
    assert joined.count() == sum(1 for i in range(2000) for j in range(100) if j * 10 <= (300 if i < 1500 else i * 7 % 2003) < j * 10 + 900)


def test_interval_join_of_a_table_with_itself(spark):
    df = spark.range(50).select((F.col("id") % 3).alias("k"), "id", F.col("id").cast("double").alias("t"))
    limits = df.select("k", F.col("id").alias("j"), "t", F.lead("t").over(align.Window.partitionBy("k").orderBy("t")).alias("u"))
    for most in (5, 1000):
        got = align.interval_join(df.join(df.select(F.col("id").alias("i")), F.col("id") == F.col("i")), limits, ["k"], "t", "t", "u", ["j"], most).collect()
        assert len(got) == 50 and all(r.j == r.id for r in got)


@pytest.mark.parametrize("rows", [None, 60])
def test_rolling_time_against_a_plain_version(spark, rows):
    rng = np.random.default_rng(11)
    seconds = np.concatenate([rng.uniform(0, 300, 300), rng.uniform(800, 801, 200), [5000.0, 5000.0, 5003.0]])  # bursts, gaps, ties
    data = [("hot" if i % 5 else "b", i, T0 + timedelta(microseconds=int(s * 1e6)), None if i % 13 == 0 else float(i)) for i, s in enumerate(seconds)] + [("hot", 999, None, 1.0)]
    df = frame(spark, data, "k string, i long, t timestamp, x double")
    for by, reach in ((["k"], 4.0), ([], 4.0), (["k"], 0.25)):
        got = {r.i: r for r in rolling.rolling_time(df, by, "t", reach, rows, n=lambda_count(), hi=F.max("x")).collect()}
        assert len(got) == len(data)
        for k, i, t, _ in data:
            near = [x for k2, _, t2, x in data if t is not None and t2 is not None and (not by or k == k2) and timedelta(0) <= t - t2 <= timedelta(seconds=reach) and x is not None]
            assert (got[i].n, got[i].hi) == ((len(near), max(near, default=None)) if t is not None else (None, None))


@pytest.mark.parametrize("rows", [None, 60])
def test_rolling_sums_against_a_plain_version(spark, rows):
    rng = np.random.default_rng(12)
    seconds = np.concatenate([rng.uniform(0, 300, 300), rng.uniform(800, 801, 200), [5000.0, 5000.0, 5003.0, 5004.0]])
    odd = {5: float("nan"), 7: float("inf"), 26: None}
    data = [("hot" if i % 5 else None, i, T0 + timedelta(microseconds=int(s * 1e6)), odd.get(i % 40, float(i))) for i, s in enumerate(seconds)] + [("hot", 999, None, 1.0), (None, 998, None, None)]
    df = frame(spark, data, "k string, i long, t timestamp, x double")
    for by, reach in ((["k"], 4.0), ([], 4.0), (["k"], 0.25), ([], 0.0)):
        got = {r.i: r for r in rolling.rolling_sums(df, "x", by, "t", reach, rows).collect()}
        assert len(got) == len(data)
        for k, i, t, _ in data:
            near = [x for k2, _, t2, x in data if t is not None and t2 is not None and (not by or k == k2) and timedelta(0) <= t - t2 <= timedelta(seconds=reach) and x is not None and math.isfinite(x)]
            assert got[i].rolling_n == (len(near) if t is not None else None)
            assert (got[i].rolling_sum, got[i].rolling_mean) == (pytest.approx((sum(near), sum(near) / len(near))) if near else (None, None))
    assert rolling.rolling_sums(df.limit(0), "x", ["k"], "t", 1.0, rows).count() == 0


def test_rolling_stats_against_a_plain_version(spark):
    rng = np.random.default_rng(13)
    seconds = np.concatenate([rng.uniform(-20, 300, 300), rng.uniform(800, 801, 200), [5000.0, 5000.0, 5003.0, 5004.0, 5008.0]])
    odd = {5: float("nan"), 7: float("inf"), 26: None}
    data = [("hot" if i % 5 else None, i, T0 + timedelta(microseconds=int(s * 1e6)), odd.get(i % 40, float(i % 91))) for i, s in enumerate(seconds)] + [("hot", 999, None, 1.0), (None, 998, None, None)]
    df = frame(spark, data, "k string, i long, t timestamp, x double")
    rank = lambda x: (math.isnan(x), 0 if math.isnan(x) else x)  # noqa: E731  # NaN is the greatest
    for by, reach in ((["k"], 4.0), ([], 4.0), (["k"], 0.25), ([], 0.0), ([], 1e6)):
        got = {r.i: r for r in rolling.rolling_stats(df, "x", by, "t", reach).collect()}
        assert len(got) == len(data)
        for k, i, t, _ in data:
            near = [x for k2, _, t2, x in data if t is not None and t2 is not None and (not by or k == k2) and timedelta(0) <= t - t2 <= timedelta(seconds=reach) and x is not None]
            want = (len(near), sum(near) / len(near), max(near, key=rank), min(near, key=rank)) if near else (0 if t is not None else None, None, None, None)
            assert tuple(got[i])[-4:] == pytest.approx(want, nan_ok=True)
    assert rolling.rolling_stats(df.limit(0), "x", ["k"], "t", 1.0).count() == 0


def test_statistics_of_bursts_cost_no_more_than_other_rows(spark):
    """60,000 rows within one window: frames worked out anew would be 3.6 billion values."""
    df = spark.range(60_000).select((F.col("id") % 1000).cast("double").alias("t"), F.col("id").cast("double").alias("x"))
    last = rolling.rolling_stats(df, "x", [], "t", 1000.0).agg(F.max("rolling_n"), F.sum("rolling_n"), F.min("rolling_min"), F.max("rolling_max")).first()
    assert tuple(last) == (60_000, sum(60 * 60 * k for k in range(1, 1001)), 0.0, 59_999.0)


def test_exact_sums_are_carried_over_slices_shorter_than_the_window(spark, monkeypatch):
    """Windows that hold a large part of a series and bursts don't join slices: no task holds more than the order asks for."""
    rng = np.random.default_rng(14)
    times = np.concatenate([rng.uniform(0, 1000, 1500), rng.uniform(400, 400.01, 500)])
    data = [("hot" if i % 7 else f"c{i % 3}", i, None if i % 97 == 0 else float(t), None if i % 31 == 0 else i / 100) for i, t in enumerate(times)]
    df = frame(spark, data, "k string, i long, t double, x double")
    parts, cut = [], rolling.sliced
    monkeypatch.setattr(rolling, "sliced", lambda df, column, cuts: parts.append(len(cuts)) or cut(df, column, cuts))
    for by in (["k"], []):
        got = {r.i: r for r in rolling.rolling_sums(df, "x", by, "t", 300.0, 100, places=2).collect()}
        assert len(got) == len(data) and parts.pop() > 20 and not parts
        for k, i, t, _ in data:
            near = [j for k2, j, t2, x in data if t is not None and t2 is not None and (not by or k == k2) and 0 <= round(t * 1e6) - round(t2 * 1e6) <= 300_000_000 and x is not None]
            assert (got[i].rolling_n, got[i].rolling_sum) == ((len(near), sum(near) / 100 if near else None) if t is not None else (None, None))


def test_rolling_sums_of_decimals_are_exact(spark):
    """Beside a great value doubles lose a cent for good; decimals don't."""
    df = frame(spark, [(i, float(i), 1e15 if i == 3 else 0.01) for i in range(40)], "i long, t double, x double")
    for rows in (None, 10):
        got = {r.i: r.rolling_sum for r in rolling.rolling_sums(df, "x", [], "t", 2.0, rows, places=2).collect()}
        assert all(got[i] == 0.03 for i in range(6, 40)) and got[0] == 0.01 and got[1] == 0.02


def test_rolling_windows_meet_cuts_exactly(spark):
    """Times a window apart whose sums of doubles fall short of each other, with cuts between them."""
    data = [(i, i / 10) for i in range(400)]
    df = frame(spark, data, "i long, t double")
    for reach, back in ((0.1, 1), (0.3, 3), (0.7, 7)):
        n = {r.i: r.n for r in rolling.rolling_time(df, [], "t", reach, 20, n=F.count("i")).collect()}
        m = {r.i: r.rolling_n for r in rolling.rolling_sums(df, "i", [], "t", reach, 20).collect()}
        assert n == m == {i: min(i, back) + 1 for i in range(400)}


def test_bursts_cost_no_more_than_other_rows(spark):
    """120,000 rows within one window: frames added up anew would be 7 billion values."""
    df = spark.range(120_000).select((F.col("id") % 1000).cast("double").alias("t"), F.lit(1.0).alias("x"))
    last = rolling.rolling_sums(df, "x", [], "t", 1e6).agg(F.max("rolling_n"), F.sum("rolling_n")).first()
    assert tuple(last) == (120_000, sum(120 * 120 * k for k in range(1, 1001)))


def test_many_cuts_are_searched(spark):
    cuts = [float(k * k) for k in range(1, 4096)]
    df = spark.range(0, 17_000_000, 997).select(F.col("id").cast("double").alias("t"))
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (float("-inf"),), (1.0,), (0.5,)], "t double")
    got = {r.t: r.s for r in df.union(odd).where("t IS NOT NULL AND NOT isnan(t)").select("t", spc.sliced(df, "t", cuts).alias("s")).collect()}
    assert got == {t: int(np.searchsorted(cuts, t, "right")) + 1 for t in got}
    assert {r.s for r in odd.where("t IS NULL OR isnan(t)").select(spc.sliced(odd, "t", cuts).alias("s")).collect()} == {0}
    for few in ([], [3.0], [3.0, 4.0]):
        got = {r.t: r.s for r in odd.where("NOT isnan(t)").union(spark.createDataFrame([(3.0,), (3.5,), (4.0,)], "t double")).select("t", spc.sliced(odd, "t", few).alias("s")).collect()}
        assert all(s == int(np.searchsorted(few, t, "right")) + 1 for t, s in got.items() if t is not None)


def lambda_count():
    return F.count("x")


@pytest.mark.parametrize("k", [1, 3, 6])
def test_rolling_apply(spark, k):
    rng = np.random.default_rng(k)
    data = [(s, i, None if rng.random() < 0.1 else float(rng.normal())) for s, n in (("a", 230), (None, 20), ("c", 2)) for i in range(n)]
    df = frame(spark, data, "k string, i long, x double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")  # series go over batches
    try:
        for of in (None, F.floor(F.col("i") / 40).cast("long")):
            got = {(r.k, r.i): r.rolling for r in rolling.rolling_apply(df, "x", k, ["k"], ["i"], lambda w: np.median(w, axis=1), of=of).collect()}
            for s in ("a", None, "c"):
                xs = [x for n, _, x in data if n == s]
                for i in range(len(xs)):
                    w = xs[i - k + 1 : i + 1] if i >= k - 1 else [None]
                    want = None if None in w else float(np.median(w))
                    assert got[s, i] == (pytest.approx(want) if want is not None else None)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert rolling.rolling_apply(df.limit(0), "x", k, ["k"], ["i"], lambda w: w[:, 0]).count() == 0


@pytest.mark.parametrize("rows", [25, None])
def test_percentiles(spark, rows):
    rng = np.random.default_rng(2)
    data = [("hot", float(x)) for x in rng.normal(size=700)] + [("ties", float(i % 3)) for i in range(200)] + [("one", 4.0), ("hot", 1e300), ("none", None), (None, 1.0), (None, 2.0), ("hot", float("nan"))]
    df, shares = frame(spark, data, "k string, x double"), [0.0, 0.1, 0.5, 0.937, 1.0]
    got = {(r.k, r.share): r.x for r in summaries.percentiles(df, "x", shares, ["k"], rows).collect()}
    want = {(k, s): float(np.quantile([x for k2, x in data if k2 == k and x is not None and not math.isnan(x)], s)) for k in ("hot", "ties", "one", None) for s in shares}
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x]) for x in want)
    alone = {r.share: r.x for r in summaries.percentiles(df.where("k = 'ties'").drop("k"), "x", shares, [], rows).collect()}
    assert alone == {s: pytest.approx(want["ties", s]) for s in shares}


def test_moments_merge_in_any_order(spark):
    rng = np.random.default_rng(8)
    data = [(g, h, run, float(1e9 + x) if x is not None else None) for run in range(4) for g in "ab" for h in ("x", None) for x in [*rng.normal(size=rng.integers(0, 30)).tolist(), None]]
    df = frame(spark, data, "g string, h string, run int, v double")
    parts = [summaries.moments(df.where(F.col("run") == r), ["v"], ["g", "h"]) for r in range(4)]
    for order in ((0, 1, 2, 3), (3, 1, 0, 2), (2, 3, 1, 0)):
        state = parts[order[0]]
        for k in order[1:]:
            state = summaries.merged(state.unionByName(parts[k]), ["g", "h"])  # one run after the other
        for by in (["g", "h"], ["g"], []):
            got = {tuple(r[b] for b in by): r for r in summaries.finished(summaries.merged(state, by), by).collect()}
            for key in got:
                xs = [v for g, h, _, v in data if v is not None and all({"g": g, "h": h}[b] == x for b, x in zip(by, key))]
                r = got[key]
                assert (r.n, r.min, r.max) == (len(xs), min(xs, default=None), max(xs, default=None))
                assert r["mean"] == pytest.approx(np.mean(xs), rel=1e-15) and r["std"] == pytest.approx(np.std(xs, ddof=1), rel=1e-6)
    sets = summaries.grouping_sets(state, [["g", "h"], ["g"], []])
    assert Counter(r.grouping for r in sets.collect()) == {"g,h": 4, "g": 2, "": 1}
    none = summaries.merged(summaries.moments(df.where("v IS NULL"), ["v"], ["g"]), [])
    assert none.first().n == 0 and none.first()["mean"] is None


def test_sketches_unite(spark):
    df = spark.range(30_000).select((F.col("id") % 7000).alias("u"), (F.col("id") % 3).cast("string").alias("run"), F.when(F.col("id") % 4 > 0, "a").alias("g"))
    each = summaries.sketches(df, "u", ["g", "run"])
    for by in (["g"], ["run"], []):
        exact = {tuple(r[b] for b in by): r.n for r in df.groupBy(*by).agg(F.count_distinct("u").alias("n")).collect()}
        for r in summaries.united(each, by).select(*by, summaries.estimate().alias("n")).collect():
            assert abs(r.n - exact[tuple(r[b] for b in by)]) <= 4 * summaries.ERROR * exact[tuple(r[b] for b in by)]


DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def derby(spark, tmp_path, *statements):
    """An embedded database, and its URL."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    jvm = spark.sparkContext._jvm
    jvm.java.lang.Class.forName(DERBY["driver"])
    c = jvm.java.sql.DriverManager.getConnection(url)
    for s in statements:
        c.createStatement().executeUpdate(s)
    c.close()
    return url


def test_relational_append_is_all_or_nothing(spark, tmp_path):
    url = derby(spark, tmp_path, 'CREATE TABLE runs ("id" BIGINT NOT NULL PRIMARY KEY, "value" DOUBLE)')
    rows = spark.range(0, 500, numPartitions=4).select("id", (F.col("id") * 2.0).alias("value"))
    assert writers.append_jdbc(rows, url, "runs", **DERBY) == 500
    table = readers.read_jdbc(spark, url, "runs", **DERBY)
    assert table.count() == 500 and table.agg(F.sum("value")).first()[0] == 499 * 500
    failing = spark.range(1000, 1400, numPartitions=4).select("id", F.when(F.col("id") == 1399, F.raise_error(F.lit("lost"))).otherwise(F.lit(1.0)).cast("double").alias("value"))
    with pytest.raises(Exception, match="lost"):
        writers.append_jdbc(failing, url, "runs", **DERBY)  # three tasks of four have written their rows
    twice = spark.range(490, 510).select("id", F.lit(1.0).alias("value"))
    with pytest.raises(Exception):
        writers.append_jdbc(twice, url, "runs", **DERBY)  # the database refuses the move
    assert readers.read_jdbc(spark, url, "runs", **DERBY).count() == 500
    names = readers.read_jdbc(spark, url, "SYS.SYSTABLES", **DERBY).where("TABLENAME LIKE 'RUNS%'").collect()
    assert [r.TABLENAME for r in names] == ["RUNS"]  # no staging table is left


def test_relational_scan_in_parts(spark, tmp_path):
    url = derby(spark, tmp_path, 'CREATE TABLE log (id BIGINT, x DOUBLE)', "INSERT INTO log VALUES " + ", ".join(f"({i}, {i}.5)" for i in range(300)), "INSERT INTO log VALUES (NULL, 7)")
    table = readers.read_jdbc(spark, url, "log", "ID", rows=50, **DERBY)
    assert table.rdd.getNumPartitions() == 7 and table.count() == 301
    assert readers.read_jdbc(spark, url, "log", "ID", **DERBY).rdd.getNumPartitions() == 1
    assert table.where("id >= 100").count() == 200
    assert "PushedFilters: [*IsNotNull(ID), *GreaterThanOrEqual(ID,100)]" in table.where("id >= 100")._jdf.queryExecution().executedPlan().toString()


def test_stream_ingest_survives_restarts(spark, tmp_path):
    """The stream is killed after a batch is written and before the ledger has it, again and again; the table equals one ingest of all files."""
    folder, root, state = str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "state")
    os.makedirs(folder)
    for k in range(4):
        with open(f"{folder}/{k}.csv", "w") as f:
            f.write("id,value\n" + "".join(f"{10 * k + i},{i}.5\n" for i in range(10)))
        os.utime(f"{folder}/{k}.csv", (1_700_000_000 + k, 1_700_000_000 + k))
    died = []

    def die(batch):
        if died.count(batch) < 2:
            died.append(batch)
            raise RuntimeError("killed")

    for _ in range(20):
        try:
            stream_ingest.ingest_stream(spark, folder, "burnin", root, state, per_trigger=1, before_ledger=die).awaitTermination()
            break
        except Exception:
            assert stream_ingest.ingested(spark, root, "burnin") is None or stream_ingest.ingested(spark, root, "burnin").count() % 10 == 0
    assert sorted(died) == [0, 0, 1, 1, 2, 2, 3, 3] and stream_ingest.ledger(spark, root) == [0, 1, 2, 3]
    spark.sql("DROP TABLE IF EXISTS t_stream")
    for k in range(4):
        ingest.ingest(spark, "burnin", f"{folder}/{k}.csv", T0, "t_stream")
    got = stream_ingest.ingested(spark, root, "burnin")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, spark.table("t_stream").collect()))
    assert {r.batch: r.n for r in stream_ingest.written(spark, root).collect()} == {k: 10 for k in range(4)}
    spark.sql("DROP TABLE t_stream")
    with open(f"{folder}/9.csv", "w") as f:
        f.write("id,value\n900,1\n3,1\n")  # an id that the table has: the whole batch is refused
    with pytest.raises(Exception):
        stream_ingest.ingest_stream(spark, folder, "burnin", root, state).awaitTermination()
    assert stream_ingest.ingested(spark, root, "burnin").count() == 40


def test_rows_of_older_batches_are_left_out(spark, tmp_path):
    shape, folder = "k string, i long, x double", str(tmp_path / "in")
    for rows in ([("a", 5, 5.0), ("a", 3, 1.0)], [("a", 4, 9.0), ("a", 7, 6.0), ("b", 1, None)]):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(shape).parquet(folder)
        live.live_moving_range(stream, "x", "k", "i").writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out")).awaitTermination()
    assert {(r.k, r.i): r.moving_range for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a", 3): None, ("a", 5): 4.0, ("a", 7): 1.0, ("b", 1): None}


def test_live_moving_range_with_late_rows(spark, tmp_path):
    shape = "k string, i long, x double, ts timestamp"
    at = lambda s: T0 + timedelta(seconds=s)
    batches = [
        [("a", 5, 5.0, at(5)), ("a", 2, 2.0, at(2)), ("b", 1, 1.0, at(1))],
        [("a", 1, 1.0, at(1)), ("a", 4, None, at(4)), ("a", 30, 7.0, at(30)), ("z", 0, 0.0, at(30))],  # older rows that are still in time
        [("a", 3, 9.0, at(3)), ("b", 40, 4.0, at(40)), ("z", 1, 0.0, at(200))],  # a's third row comes after its later ones have gone
        [("z", 2, 0.0, at(900))],
    ]
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for rows in batches:  # a run of the stream for each, from its checkpoint
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(shape).parquet(folder)
        live.ordered_moving_range(stream, "x", "k", "i", "ts", "10 seconds", forget=20).writeStream.option("checkpointLocation", state).trigger(availableNow=True).format("parquet").start(out).awaitTermination()
    got = {(r.k, r.i): r.moving_range for r in spark.read.parquet(out).collect()}
    assert {x: v for x, v in got.items() if x[0] != "z"} == {("a", 1): None, ("a", 2): 1.0, ("a", 4): None, ("a", 5): None, ("a", 30): None, ("b", 1): None, ("b", 40): None}


def test_waiting_rows_are_merged_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "BLOCK_ROWS", 7)
    monkeypatch.setattr(live, "MERGED_BLOCKS", 2)
    rng = np.random.default_rng(4)
    rows = [("ab"[i % 2], i, None if i % 11 == 0 else float(i % 37), T0 + timedelta(seconds=int(s))) for i, s in enumerate(rng.integers(0, 60, 200))]
    shape, folder, out = "k string, i long, x double, ts timestamp", str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([*rows, ("end", -1, 0.0, T0 + timedelta(seconds=900))], shape).coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(shape).parquet(folder)
    live.ordered_moving_range(stream, "x", "k", "i", "ts", "70 seconds").writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).format("parquet").start(out).awaitTermination()
    want = {}
    for k in "ab":
        xs = sorted((t, i, x) for k2, i, x, t in rows if k2 == k)
        want |= {(k, b[1]): None if a is None or a[2] is None or b[2] is None else abs(b[2] - a[2]) for a, b in zip([None, *xs], xs)}
    assert {(r.k, r.i): r.moving_range for r in spark.read.parquet(out).collect() if r.k != "end"} == want
