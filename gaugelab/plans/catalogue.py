"""Registered queries over the test tables, with their SQL.

``events`` stands for the measurement log, ``lineitem`` for a frame of several parameters, ``part`` for a parameter with a nominal value and
``orders`` for the log of artifacts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import scalar
from ..operators import normalize, rules, sequence, spc, stats, views
from .specs import COLUMN_UNITS, Parameter, Rule

QUERIES: dict = {}
SQL: dict[str, str] = {}

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_KNOWN: dict[str, StructType] = {}


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; its footers are asked for their types once in a process."""
    path = f"{sf_dir}/{name}.parquet"
    df = spark.read.schema(_KNOWN[path]).parquet(path) if path in _KNOWN else spark.read.parquet(path)
    _KNOWN[path] = df.schema
    return df


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    """Doubles to six places but for those to keep: sums may be added up in another order."""
    return df.select(*[F.round(c, 6).alias(c) if k == "double" and c not in keep else F.col(c) for c, k in df.dtypes])


def _r(x: str, name: str) -> str:
    return f"round({x}, 6) AS {name}"


def _four(x: str, prefix: str = "") -> str:
    return ", ".join((_r(f"avg({x})", f"{prefix}mean"), _r(f"stddev_samp({x})", f"{prefix}std"), _r(f"min({x})", f"{prefix}min"), _r(f"max({x})", f"{prefix}max")))


@query("SELECT event_id AS id, value AS voltage, value AS current, ts AS test_time, 'PASS' AS result, 'HiPot Test ' || event_id AS description FROM events")
def normalize_measurements(spark, sf):
    raw = t(spark, sf, "events").select(F.col("event_id").alias("id"), "value", F.col("ts").alias("timestamp"))
    return normalize.entities(normalize.normalize(raw, "hipot"), "hipot")


@query("SELECT event_id AS id, value, 'Burn-in Test ' || event_id AS description FROM events")
def normalize_unknown_type(spark, sf):
    raw = t(spark, sf, "events").select(F.col("event_id").alias("id"), "value")
    return normalize.entities(normalize.normalize(raw, "no such test"), "burnin")


@query(f"SELECT event_type, count(value) AS n, {_four('value')} FROM events GROUP BY event_type")
def param_stats_by_type(spark, sf):
    return rounded(stats.grouped(t(spark, sf, "events"), "event_type", F.col("value")))


@query("SELECT " + ", ".join(_four(m, f"{m}_") for m in MEASURES) + " FROM lineitem")
def param_stats_wide(spark, sf):
    return rounded(stats.wide(t(spark, sf, "lineitem"), MEASURES))


@query(" UNION ALL ".join(f"SELECT '{m}' AS parameter, count({m}) AS n, {_four(m)} FROM lineitem" for m in MEASURES))
def param_stats_long(spark, sf):
    return rounded(stats.long(t(spark, sf, "lineitem"), MEASURES))


@query("SELECT event_id, CASE WHEN value > 90 THEN 1 ELSE 0 END AS failures FROM events")
def pass_flag_upper(spark, sf):
    return t(spark, sf, "events").select("event_id", rules.holds(Rule("value", "above", 90.0)).cast("int").alias("failures"))


@query("SELECT event_id, CASE WHEN value >= 100 THEN 1 ELSE 0 END AS pass_fail FROM events")
def pass_flag_lower(spark, sf):
    return t(spark, sf, "events").select("event_id", rules.holds(Rule("value", "at_least", 100.0)).cast("int").alias("pass_fail"))


_MULTI = (Rule("l_quantity", "within", 5.0, 45.0), Rule("l_discount", "at_most", 0.08), Rule("l_tax", "below", 0.07))


@query("SELECT round(avg(CASE WHEN l_quantity BETWEEN 5 AND 45 AND l_discount <= 0.08 AND l_tax < 0.07 THEN 1.0::DOUBLE ELSE 0 END), 6) AS pass_rate FROM lineitem")
def pass_rate_multi(spark, sf):
    flagged = t(spark, sf, "lineitem").withColumn("pass_fail", rules.all_hold(_MULTI).cast("int"))
    return rounded(flagged.agg(stats.rate("pass_fail").alias("pass_rate")))


@query("SELECT event_type, round(avg(CASE WHEN value < 50 THEN 1.0::DOUBLE ELSE 0 END), 6) AS pass_rate FROM events GROUP BY event_type")
def pass_rate_by_type(spark, sf):
    flagged = t(spark, sf, "events").withColumn("pass_fail", rules.holds(Rule("value", "below", 50.0)).cast("int"))
    return rounded(flagged.groupBy("event_type").agg(stats.rate("pass_fail").alias("pass_rate")))


@query("SELECT p_partkey, abs(p_retailprice - 1000) / 1000 <= 0.05 AS in_tolerance FROM part")
def tolerance_flag(spark, sf):
    return t(spark, sf, "part").select("p_partkey", rules.holds(Rule("p_retailprice", "near", 1000.0, 0.05)).alias("in_tolerance"))


@query("SELECT l_orderkey, l_linenumber, l_quantity * l_extendedprice / 1000 AS power FROM lineitem")
def derived_power(spark, sf):
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", rules.milli_product(F.col("l_quantity"), F.col("l_extendedprice")).alias("power"))


@query("SELECT event_id, abs(value) * 5.0 AS scaled, value * 25.0 + 825.0 AS shifted FROM events")
def affine_scaling(spark, sf):
    x = F.col("value")
    return t(spark, sf, "events").select("event_id", rules.scaled(x, 5, absolute=True).alias("scaled"), rules.scaled(x, 25, 825).alias("shifted"))


_CAP = "SELECT avg(l_quantity) AS m, nullif(stddev_samp(l_quantity), 0) AS s FROM lineitem"


@query(f"SELECT round(least(45 - m, m - 5) / (3 * s), 6) AS l_quantity_cp, round(least(45 - m, m - 5) / (3 * s), 6) AS l_quantity_cpk, round(40 / (6 * s), 6) AS l_quantity_cp_potential FROM ({_CAP})")
def capability_two_sided(spark, sf):
    p = (Parameter("l_quantity", "", 5.0, 45.0),)
    return rounded(stats.capabilities(stats.wide(t(spark, sf, "lineitem"), ["l_quantity"]), p))


@query(f"SELECT round((45 - m) / (3 * s), 6) AS l_quantity_cp, round((45 - m) / (3 * s), 6) AS l_quantity_cpk, CAST(NULL AS DOUBLE) AS l_quantity_cp_potential FROM ({_CAP})")
def capability_upper(spark, sf):
    p = (Parameter("l_quantity", "", None, 45.0),)
    return rounded(stats.capabilities(stats.wide(t(spark, sf, "lineitem"), ["l_quantity"]), p))


_LIMITS = "SELECT event_type, avg(value) AS cl, avg(value) + 3 * stddev_samp(value) AS ucl, avg(value) - 3 * stddev_samp(value) AS lcl FROM events GROUP BY event_type"


@query(f"SELECT event_type, {_r('cl', 'cl')}, {_r('ucl', 'ucl')}, {_r('lcl', 'lcl')} FROM ({_LIMITS})")
def control_limits(spark, sf):
    return rounded(spc.control_limits(t(spark, sf, "events"), "value", ["event_type"]))


@query(f"SELECT e.event_type, e.event_id, e.value, {_r('cl', 'cl')}, {_r('ucl', 'ucl')}, {_r('lcl', 'lcl')} FROM events e JOIN ({_LIMITS}) l ON e.event_type = l.event_type")
def xbar_chart(spark, sf):
    log = t(spark, sf, "events").select("event_type", "event_id", "value")
    return spc.xbar_chart(log, "value", ["event_type"], places=6)


@query(f"SELECT e.event_type, e.event_id, e.value FROM events e JOIN ({_LIMITS}) l ON e.event_type = l.event_type WHERE value > ucl OR value < lcl")
def xbar_out_of_limits(spark, sf):
    log = t(spark, sf, "events").select("event_type", "event_id", "value")
    return spc.out_of_limits(spc.xbar_chart(log, "value", ["event_type"]), "value").select("event_type", "event_id", "value")


_ORDER = ["ts", "event_id"]
_MR = "SELECT event_type, event_id, value, abs(value - lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id)) AS moving_range FROM events"


@query(_MR.replace(", value, abs", ", abs"))
def moving_range(spark, sf):
    log = t(spark, sf, "events").select("event_type", "event_id", "ts", "value")
    return spc.moving_ranges(log, "value", ["event_type"], _ORDER).select("event_type", "event_id", "moving_range")


@query("SELECT event_id, abs(value - lag(value) OVER (ORDER BY event_id)) AS moving_range FROM events")
def moving_range_one_series(spark, sf):
    """A single series has no key to part it; slices of its index do."""
    log = t(spark, sf, "events").select("event_id", "value")
    return spc.moving_ranges(log, "value", [], ["event_id"]).select("event_id", "moving_range")


@query(
    "SELECT event_type, event_id, CASE WHEN count(value) OVER w = 5 THEN max(value) OVER w - min(value) OVER w END AS rolling_range FROM events "
    "WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
)
def rolling_range_k(spark, sf):
    log = t(spark, sf, "events").select("event_type", "event_id", "ts", "value")
    return spc.rolling_ranges(log, "value", 5, ["event_type"], _ORDER).select("event_type", "event_id", "rolling_range")


_RL = f"SELECT event_type, avg(moving_range) AS cl, avg(moving_range) + 3 * stddev_samp(moving_range) AS ucl, avg(moving_range) - 3 * stddev_samp(moving_range) AS lcl FROM ({_MR}) GROUP BY event_type"


@query(f"SELECT event_type, {_r('cl', 'cl')}, {_r('ucl', 'ucl')}, {_r('lcl', 'lcl')} FROM ({_RL})")
def range_chart_limits(spark, sf):
    ranged = spc.moving_ranges(t(spark, sf, "events").select("event_type", "event_id", "ts", "value"), "value", ["event_type"], _ORDER)
    return rounded(spc.control_limits(ranged, "moving_range", ["event_type"]))


@query(f"SELECT r.event_type, r.event_id, r.moving_range, {_r('cl', 'cl')}, {_r('ucl', 'ucl')}, {_r('lcl', 'lcl')} FROM ({_MR}) r JOIN ({_RL}) l ON r.event_type = l.event_type")
def r_chart(spark, sf):
    log = t(spark, sf, "events").select("event_type", "event_id", "ts", "value")
    return spc.r_chart(log, "value", ["event_type"], _ORDER, places=6).drop("ts", "value")


_SPARSE = "SELECT event_type AS test_type, event_id, value AS resistance, NULL::DOUBLE AS value FROM events WHERE event_type = 'click' UNION ALL SELECT event_type, event_id, NULL, value FROM events WHERE event_type <> 'click'"


@query(f"SELECT test_type, count(coalesce(resistance, value)) AS n, {_four('coalesce(resistance, value)')} FROM ({_SPARSE}) GROUP BY test_type")
def sparse_union(spark, sf):
    log = t(spark, sf, "events").select(F.col("event_type").alias("test_type"), "event_id", "value")
    one = rules.in_category(log, "test_type", "click").withColumnRenamed("value", "resistance")
    both = one.unionByName(log.where("test_type <> 'click'"), allowMissingColumns=True)
    return rounded(stats.grouped(both, "test_type", F.coalesce("resistance", "value")))


@query("SELECT event_id, value FROM events WHERE event_type = 'click'")
def category_filter(spark, sf):
    return rules.in_category(t(spark, sf, "events"), "event_type", "click").select("event_id", "value")


@query("SELECT DISTINCT event_type FROM events")
def distinct_types(spark, sf):
    return stats.categories(t(spark, sf, "events"), "event_type")


@query("SELECT event_type, min(event_id) AS first_seen FROM events GROUP BY event_type")
def category_order(spark, sf):
    return stats.grouped(t(spark, sf, "events"), "event_type", F.col("value"), order="event_id").select("event_type", "first_seen")


def _artifacts(spark, sf) -> DataFrame:
    o = t(spark, sf, "orders")
    return o.select(F.col("o_custkey").alias("test_name"), F.lower("o_orderstatus").alias("kind"), F.col("o_orderdate").alias("modified"), F.col("o_orderkey").alias("path"))


@query("SELECT o_custkey AS test_name, lower(o_orderstatus) AS kind, o_orderkey AS path FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_artifact(spark, sf):
    return views.latest_artifacts(_artifacts(spark, sf))


@query("SELECT o_custkey AS test_name, " + ", ".join(f"CAST(count(*) FILTER (lower(o_orderstatus) = '{k}') AS BIGINT) AS n_{k}" for k in "fop") + " FROM orders GROUP BY o_custkey")
def artifact_counts(spark, sf):
    return views.artifact_counts(_artifacts(spark, sf), ("f", "o", "p"))


@query("SELECT CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS n_success, count(*) AS n_total, round(100.0::DOUBLE * count(*) FILTER (o_orderstatus = 'F') / nullif(count(*), 0), 6) AS percent FROM orders")
def run_success_rate(spark, sf):
    return rounded(stats.success(t(spark, sf, "orders").select((F.col("o_orderstatus") == "F").alias("success"))))


_NUMBERED = "SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, value, count(*) OVER (PARTITION BY event_type) AS c FROM events"


def _series(spark, sf, value: Column) -> DataFrame:
    log = t(spark, sf, "events").select("event_type", "event_id", value.alias("x"))
    return sequence.numbered(log, ["event_type"], ["event_id"], "i").select("event_type", "i", "x")


@query(f"WITH s AS ({_NUMBERED}) SELECT a.event_type, a.i, b.value AS x FROM s a JOIN s b ON a.event_type = b.event_type AND b.i = ((a.i - 20) % a.c + a.c) % a.c")
def circular_shift(spark, sf):
    return sequence.circular_shift(_series(spark, sf, F.col("value")), "x", ["event_type"], "i", 20)


_STATES = "SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, CASE WHEN value > 50 THEN 1 ELSE 0 END AS b FROM events"
_DEBOUNCE = f"""WITH RECURSIVE s AS MATERIALIZED ({_STATES}), d AS (
 SELECT event_type, i, b AS x, 0 AS hold FROM s WHERE i = 0 UNION ALL
 SELECT s.event_type, s.i, CASE WHEN d.hold > 0 THEN d.x ELSE s.b END, CASE WHEN d.hold > 0 THEN d.hold - 1 WHEN s.b <> d.x THEN 4 ELSE 0 END
 FROM d JOIN s ON s.event_type = d.event_type AND s.i = d.i + 1) SELECT event_type, i, x FROM d"""


@query(_DEBOUNCE)
def debounce(spark, sf):
    return sequence.debounce(_series(spark, sf, (F.col("value") > 50).cast("int")), "x", ["event_type"], "i")


@query(_DEBOUNCE)
def debounce_long(spark, sf):
    return sequence.debounce_long(_series(spark, sf, (F.col("value") > 50).cast("int")), "x", ["event_type"], "i")


@query(_DEBOUNCE)
def debounce_sliced(spark, sf):
    return sequence.debounce_sliced(_series(spark, sf, (F.col("value") > 50).cast("int")), "x", ["event_type"], "i", 1000)


@query("SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS sequence_num FROM events")
def sequence_numbers(spark, sf):
    log = sequence.numbered(t(spark, sf, "events").select("event_type", "event_id"), ["event_type"], ["event_id"], "place")
    return log.select("event_type", "event_id", (F.col("place") + 1).alias("sequence_num"))


@query(f"SELECT event_type, count(v) AS n, {_four('v')}, round(avg(CASE WHEN v >= 50 THEN 1.0::DOUBLE ELSE 0 END), 6) AS pass_rate FROM (SELECT event_type, CASE WHEN event_id % 20 <> 0 THEN value END AS v FROM events) GROUP BY event_type")
def null_injection_stats(spark, sf):
    lost = t(spark, sf, "events").withColumn("value", F.when(F.pmod("event_id", F.lit(20)) == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    flagged = lost.withColumn("pass_fail", rules.holds(Rule("value", "at_least", 50.0)).cast("int"))
    return rounded(stats.grouped(flagged, "event_type", F.col("value"), "pass_fail"))


@query(
    "SELECT event_type, printf('%.2f', r * 100) AS shown, CASE WHEN event_type = 'click' THEN 'Failure Rate' ELSE 'Pass Rate' END AS label, CASE WHEN event_type = 'click' THEN (CASE WHEN r * 100 > 5 THEN 'red' ELSE 'green' END) "
    "ELSE (CASE WHEN r * 100 > 95 THEN 'green' ELSE 'orange' END) END AS colour FROM (SELECT event_type, avg(CASE WHEN value < 50 THEN 1.0::DOUBLE ELSE 0 END) AS r FROM events GROUP BY event_type)"
)
def rate_card(spark, sf):
    flagged = t(spark, sf, "events").withColumn("f", rules.holds(Rule("value", "below", 50.0)).cast("int"))
    r = flagged.groupBy("event_type").agg(stats.rate("f").alias("r"))
    click = F.col("event_type") == "click"
    card = scalar.first_rate(F.when(click, F.col("r")), F.when(~click, F.col("r")), F.lit(None).cast("double"))
    return r.select("event_type", card.alias("c")).select("event_type", scalar.two_decimals(F.col("c.percent")).alias("shown"), "c.label", "c.colour")


_UNITS = " ".join(f"WHEN t = '{a}' AND c = '{b}' THEN '{u}'" for (a, b), u in COLUMN_UNITS.items())


@query(
    f"SELECT event_id, CASE {_UNITS} ELSE '' END AS unit FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'burnin' WHEN 1 THEN 'laser' ELSE 'parametric' END AS t, "
    "CASE event_id % 4 WHEN 0 THEN 'voltage' WHEN 1 THEN 'power' WHEN 2 THEN 'wavelength' ELSE 'other' END AS c FROM events)"
)
def unit_lookup(spark, sf):
    pick = lambda n, names: F.get(F.array(*[F.lit(x) for x in names]), F.pmod("event_id", F.lit(n)).cast("int"))
    return t(spark, sf, "events").select("event_id", scalar.column_unit(pick(3, ["burnin", "laser", "parametric"]), pick(4, ["voltage", "power", "wavelength", "other"])).alias("unit"))


@query("SELECT c_custkey, printf('%.2f', c_acctbal) AS shown, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' Stats' AS heading, upper(c_name) AS name FROM customer")
def format_card(spark, sf):
    c = t(spark, sf, "customer")
    return c.select("c_custkey", scalar.two_decimals(F.col("c_acctbal")).alias("shown"), scalar.title(F.concat("c_mktsegment", F.lit("_stats"))).alias("heading"), F.upper("c_name").alias("name"))


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY event_type")
def json_props_sum(spark, sf):
    return t(spark, sf, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total"))


@query(" UNION ALL ".join(f"SELECT l_shipdate AS x, '{c}' AS parameter, '' AS unit, CAST({c} AS DOUBLE) AS y FROM lineitem" for c in MEASURES[:3]))
def timeseries_long(spark, sf):
    return views.time_series(t(spark, sf, "lineitem").select(F.col("l_shipdate").alias("timestamp"), *MEASURES), "none", first=3)


_SPCD = " UNION ALL ".join(f"SELECT l_shipdate AS x, '{c}' AS parameter, '' AS unit, CAST({c} AS DOUBLE) AS y FROM lineitem" for c in MEASURES[:2])


@query(
    f"WITH l AS ({_SPCD}), s AS (SELECT parameter, avg(y) AS cl, 3 * stddev_samp(y) AS w FROM l GROUP BY parameter) "
    f"SELECT x, l.parameter, unit, y, {_r('cl', 'cl')}, {_r('cl + w', 'ucl')}, {_r('cl - w', 'lcl')} FROM l JOIN s ON l.parameter = s.parameter"
)
def spc_dashboard(spark, sf):
    df = t(spark, sf, "lineitem").select(F.col("l_shipdate").alias("timestamp"), *MEASURES)
    return views.spc_chart(df, "none", first=2, places=6)


@query("SELECT event_id, event_type, value FROM events ORDER BY event_id LIMIT 10")
def head_rows(spark, sf):
    return views.head_rows(t(spark, sf, "events").select("event_id", "event_type", "value"), 10, "event_id")


@query("SELECT count(*) AS n_rows, CAST(6 AS INTEGER) AS n_columns, 'event_id, ts, user_id, event_type, value, props' AS columns FROM events")
def frame_shape(spark, sf):
    return views.shape(t(spark, sf, "events"))


@query("SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp, base64(encode(event_type)) AS image FROM events")
def stamps_and_images(spark, sf):
    return t(spark, sf, "events").select("event_id", scalar.run_stamp(F.col("ts")).alias("stamp"), F.base64(F.encode("event_type", "UTF-8")).alias("image"))


from . import round_trips, series  # noqa: E402, F401  # these register themselves
