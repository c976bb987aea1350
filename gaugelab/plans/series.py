"""Registered queries over series: alignment, intervals, windows of time, percentiles, merged states, and streams, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import align, rolling, summaries
from ..sinks import writers
from ..streaming import ingest as stream_ingest
from ..streaming import live
from .catalogue import MEASURES, query, rounded, t

#: Rows of a slice in queries that are to cut the small test tables as well.
FEW = 1_000


def _of_type(spark, sf, kind: str) -> DataFrame:
    return t(spark, sf, "events").where(F.col("event_type") == kind)


_VIEWS = "SELECT {by} ts, max(event_id) AS view_id, max_by(value, event_id) AS view_value FROM events WHERE event_type = 'view' GROUP BY ALL"


@query(f"SELECT c.event_id, c.user_id, view_id, view_value FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN ({_VIEWS.format(by='user_id,')}) v ON c.user_id = v.user_id AND c.ts >= v.ts")
def asof_by_user(spark, sf):
    """Each click with the last view of its user."""
    views = _of_type(spark, sf, "view").select("user_id", "ts", F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    clicks = _of_type(spark, sf, "click").select("event_id", "user_id", "ts")
    return align.asof_join(clicks, views, ["user_id"], "ts", ["view_id", "view_value"], ["view_id"]).drop("ts")


@query(
    f"SELECT c.event_id, CASE WHEN c.ts - v.ts <= INTERVAL 10 MINUTE THEN view_id END AS view_id, CASE WHEN c.ts - v.ts <= INTERVAL 10 MINUTE THEN view_value END AS view_value "
    f"FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN ({_VIEWS.format(by='')}) v ON c.ts >= v.ts"
)
def asof_one_series(spark, sf):
    """Two channels without a key, aligned by time alone, in slices; a value older than ten minutes no longer counts."""
    views = _of_type(spark, sf, "view").select("ts", F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    clicks = _of_type(spark, sf, "click").select("event_id", "ts")
    return align.asof_join(clicks, views, [], "ts", ["view_id", "view_value"], ["view_id"], within=600, rows=FEW).drop("ts")


_VALID = "SELECT o_custkey, o_orderkey AS order_in_force, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM orders"


@query(
    f"SELECT l_orderkey, l_linenumber, l_shipdate, order_in_force FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN ({_VALID}) v ON v.o_custkey = orders.o_custkey AND l_shipdate >= valid_from AND (valid_to IS NULL OR l_shipdate < valid_to)"
)
def valid_intervals(spark, sf):
    """Each shipment with the order of its customer that was the last one on that day."""
    orders = t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    w = align.Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    valid = orders.select("o_custkey", F.col("o_orderkey").alias("order_in_force"), F.col("o_orderdate").alias("valid_from"), F.lead("o_orderdate").over(w).alias("valid_to"))
    shipped = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").join(orders.select("o_custkey", "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    out = align.interval_join(shipped, valid, ["o_custkey"], "l_shipdate", "valid_from", "valid_to", ["order_in_force"])
    return out.select("l_orderkey", "l_linenumber", "l_shipdate", "order_in_force")


_WEEKS = "SELECT CAST(p_partkey AS BIGINT) AS limit_id, TIMESTAMP '2024-01-01' + to_seconds(p_partkey * 7919 % 2500000) AS a, TIMESTAMP '2024-01-01' + to_seconds(p_partkey * 7919 % 2500000 + p_size * p_size * 30) AS b FROM part"


@query(f"SELECT event_id, ts, limit_id FROM events JOIN ({_WEEKS}) w ON ts >= a AND ts < b")
def valid_limits_one_series(spark, sf):
    """Limits with times from and to, of lengths from seconds to a day, on a log without key."""
    second = lambda s: F.timestamp_seconds(F.lit(1704067200) + s)
    key, size = F.col("p_partkey").cast("long"), F.col("p_size").cast("long")
    begin = F.pmod(key * 7919, F.lit(2500000))
    limits = t(spark, sf, "part").select(key.alias("limit_id"), second(begin).alias("a"), second(begin + size * size * 30).alias("b"))
    log = t(spark, sf, "events").select("event_id", "ts")
    return align.interval_join(log, limits.withColumns({c: F.col(c).cast(dict(log.dtypes)["ts"]) for c in "ab"}), [], "ts", "a", "b", ["limit_id"])


_HOUR = "WINDOW w AS (PARTITION BY {by} ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)"
_ROLLED = "count(value) OVER w AS n, round(avg(value) OVER w, 6) AS mean, max(value) OVER w - min(value) OVER w AS spread"


def _hourly(log: DataFrame, by: list[str]) -> DataFrame:
    out = rolling.rolling_stats(log, "value", by, "ts", 3600)
    return out.select("event_id", F.col("rolling_n").alias("n"), F.round("rolling_mean", 6).alias("mean"), (F.col("rolling_max") - F.col("rolling_min")).alias("spread"))


@query(f"SELECT event_id, {_ROLLED} FROM events {_HOUR.format(by='event_type')}")
def rolling_hour(spark, sf):
    """Statistics of the hour before each row of its type."""
    return _hourly(t(spark, sf, "events").select("event_id", "event_type", "ts", "value"), ["event_type"])


@query(f"SELECT event_id, {_ROLLED} FROM events {_HOUR.format(by='1')}")
def rolling_hour_one_series(spark, sf):
    """The same over all rows, in blocks of an hour."""
    return _hourly(t(spark, sf, "events").select("event_id", "ts", "value"), [])


_WEEK = "WINDOW w AS (PARTITION BY {by} ORDER BY ts RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW)"
_EXACT = "CAST(sum(CAST(value AS DECIMAL(28, 6))) OVER w AS DOUBLE)"
_SUMMED = f"count(value) OVER w AS rolling_n, {_EXACT} AS rolling_sum, {_EXACT} / nullif(count(value) OVER w, 0) AS rolling_mean"


def _weekly(log: DataFrame, by: list[str], rows: int | None) -> DataFrame:
    """Sums are exact to six places, so no order of adding up shows in them."""
    return rolling.rolling_sums(log, "value", by, "ts", 7 * 86_400, rows, places=6).select("event_id", "rolling_n", "rolling_sum", "rolling_mean")


@query(f"SELECT event_id, {_SUMMED} FROM events {_WEEK.format(by='user_id')}")
def rolling_week_by_user(spark, sf):
    """Number, sum and mean of the week before each row of its user."""
    return _weekly(t(spark, sf, "events").select("event_id", "user_id", "ts", "value"), ["user_id"], None)


@query(f"SELECT event_id, {_SUMMED} FROM events {_WEEK.format(by='1')}")
def rolling_week_one_series(spark, sf):
    """The same over all rows, where a window holds a large part of the log, in slices of time."""
    return _weekly(t(spark, sf, "events").select("event_id", "ts", "value"), [], FEW)


@query(
    "SELECT event_type, event_id, CASE WHEN count(value) OVER w = 5 THEN max(value) OVER w - min(value) OVER w END AS rolling_range FROM events "
    "WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
)
def rolling_function(spark, sf):
    """A caller's own function of the last five values: here greatest less least, as in ``rolling_range_k``."""
    log = t(spark, sf, "events").select("event_type", "event_id", "ts", "value")
    return rolling.rolling_apply(log, "value", 5, ["event_type"], ["ts", "event_id"], lambda w: np.ptp(w, axis=1), "rolling_range").select("event_type", "event_id", "rolling_range")


_SHARES = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]


@query(" UNION ALL ".join(f"SELECT event_type, {s}::DOUBLE AS share, round(quantile_cont(value, {s}), 6) AS x FROM events GROUP BY event_type" for s in _SHARES))
def percentiles_by_type(spark, sf):
    return rounded(summaries.percentiles(t(spark, sf, "events").select("event_type", "value"), "value", _SHARES, ["event_type"], FEW))


@query(" UNION ALL ".join(f"SELECT {s}::DOUBLE AS share, round(quantile_cont(l_quantity::DOUBLE, {s}), 6) AS x FROM lineitem" for s in _SHARES))
def percentiles_with_ties(spark, sf):
    """One group, of fifty different values."""
    return rounded(summaries.percentiles(t(spark, sf, "lineitem").select("l_quantity"), "l_quantity", _SHARES, [], FEW))


def _stored_states(spark, sf) -> DataFrame:
    """States of each part of a table, stored as if each were a run's file, one after the other; the rows are read once."""
    root, kept = writers.scratch(spark), ["l_returnflag", "l_linestatus"]
    rows = t(spark, sf, "lineitem").select(*kept, "l_linenumber", *MEASURES)
    summaries.moments(rows, MEASURES, [*kept, "l_linenumber"]).write.partitionBy("l_linenumber").parquet(f"{root}/states")
    return spark.read.parquet(f"{root}/states")


@query(
    " UNION ALL ".join(
        f"SELECT l_returnflag, l_linestatus, CASE WHEN grouping(l_returnflag) = 1 THEN '' WHEN grouping(l_linestatus) = 1 THEN 'l_returnflag' ELSE 'l_returnflag,l_linestatus' END AS grouping, '{m}' AS parameter, "
        f"count({m}) AS n, round(avg({m}), 7) AS mean, round(stddev_samp({m}), 7) AS std, min({m})::DOUBLE AS min, max({m})::DOUBLE AS max FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())"
        for m in MEASURES
    )
)
def merged_moments(spark, sf):
    """Statistics of three groupings from stored states of runs, without another look at the rows."""
    sets = [["l_returnflag", "l_linestatus"], ["l_returnflag"], []]
    out = summaries.finished(summaries.grouping_sets(_stored_states(spark, sf), sets), ["l_returnflag", "l_linestatus", "grouping"])
    return out.withColumns({c: F.round(c, 7) for c in ("mean", "std")})


@query(
    "SELECT event_type, count(DISTINCT user_id) AS exact, TRUE AS near FROM events GROUP BY event_type UNION ALL SELECT NULL, count(DISTINCT user_id), TRUE FROM events UNION ALL "
    "SELECT 'day ' || day, n, TRUE FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT event_id) AS n FROM events GROUP BY 1)"
)
def distinct_sketches(spark, sf):
    """Users by type, users in all and events by day, from sketches kept for each type, day and run; whether they lie within four standard errors of the exact count."""
    log = t(spark, sf, "events").select("event_type", "event_id", "user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    root = writers.scratch(spark)
    both = log.withColumn("run", F.pmod("event_id", F.lit(3)))
    users = summaries.sketches(both, "user_id", ["event_type", "run"]).select(F.col("event_type").alias("what"), "run", "sketch")
    days = summaries.sketches(both, "event_id", ["day", "run"]).select(F.concat(F.lit("day "), "day").alias("what"), "run", "sketch")
    users.withColumn("kind", F.lit("user")).unionByName(days.withColumn("kind", F.lit("day"))).write.partitionBy("run").parquet(f"{root}/sketches")
    held = spark.read.parquet(f"{root}/sketches")
    whole = held.where("kind = 'user'").withColumn("what", F.lit(None).cast("string"))
    guess = summaries.united(held.unionByName(whole), ["what"]).select("what", summaries.estimate().alias("guess"))
    exact = log.groupBy(F.col("event_type").alias("what")).agg(F.count_distinct("user_id").alias("exact"))
    exact = exact.unionByName(log.agg(F.count_distinct("user_id").alias("exact")).select(F.lit(None).cast("string").alias("what"), "exact"))
    exact = exact.unionByName(log.groupBy(F.concat(F.lit("day "), "day").alias("what")).agg(F.count_distinct("event_id").alias("exact")))
    both = exact.join(guess.withColumnRenamed("what", "_what"), F.col("what").eqNullSafe(F.col("_what")))
    near = F.abs(F.col("guess") - F.col("exact")) <= F.greatest(F.lit(1.0), 4 * summaries.ERROR * F.col("exact"))
    return both.select(F.col("what").alias("event_type"), "exact", near.alias("near"))


@query("SELECT event_type, event_id, abs(value - lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id)) AS moving_range FROM events")
def live_moving_range(spark, sf):
    """The moving range of a stream whose rows come in any order: files hold rows of all times, and each waits until the watermark has passed it."""
    log, root = t(spark, sf, "events").select("event_id", "event_type", "value", "ts"), writers.scratch(spark)
    log.repartition(4, F.xxhash64("event_id")).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    seen = log.agg((F.max("ts").cast("timestamp").cast("double") - F.min("ts").cast("timestamp").cast("double")).alias("s")).first()["s"] or 0
    # rows may be as late as the whole log is long; a last row, of a key of its own, lets the watermark pass all others
    last = log.agg(F.max("ts").alias("ts")).where("ts IS NOT NULL").select(F.lit(-1).cast("long").alias("event_id"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"), (F.col("ts") + F.make_dt_interval(F.lit(int(seen) // 86400 + 2))).alias("ts"))
    ranges = live.ordered_moving_range(stream, "value", "event_type", "event_id", "ts", f"{int(seen) + 1} seconds")
    for k in range(2):  # the files, and then the last row
        if k:
            last.coalesce(1).write.mode("append").parquet(f"{root}/in")
        ranges.writeStream.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).format("parquet").start(f"{root}/out").awaitTermination()
    return spark.read.schema(ranges.schema).parquet(f"{root}/out").select("event_type", "event_id", "moving_range")


@query("SELECT event_id AS id, value, 'Burn-in Test ' || event_id AS description FROM events")
def ingested_stream(spark, sf):
    """Files of a folder go into a table batch by batch, each once: the stream is started twice, and the second time finds nothing new."""
    root = writers.scratch(spark)
    t(spark, sf, "events").select(F.col("event_id").alias("id"), "value").repartition(4).write.option("header", True).csv(f"{root}/in")
    for _ in range(2):
        stream_ingest.ingest_stream(spark, f"{root}/in", "burnin", f"{root}/table", f"{root}/state", per_trigger=2).awaitTermination()
    return stream_ingest.ingested(spark, f"{root}/table", "burnin")
