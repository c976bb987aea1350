"""Registered queries over sources, sinks, generators and served views, with SQL that follows them.

What a source reads is written here first, from the test tables or a generator, to a folder of its own that executors share. Generated noise is a
function of MD5, so SQL draws the same numbers.
"""

from __future__ import annotations

import math
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import normalize, rules, views
from ..sinks import writers
from ..sources import ingest, readers
from ..sources.generators import GENERATORS, generate
from ..sources.signals import DAQ_RATE, LOSS, NETWORK_RATE, Instrument, signal
from . import runs, schemas
from .catalogue import query, rounded, t
from .specs import FAMILIES, SPECS, STATISTIC_UNITS

AT = datetime(2024, 2, 3, 4, 5, 6)
_AT = "TIMESTAMP '2024-02-03 04:05:06'"


# What SQL says for the functions of ``scalar``


def _u(seed: int, *keys: str) -> str:
    return f"((CAST('0x' || substr(md5(concat_ws('|', {', '.join([repr(str(seed)), *keys])})), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"


def _g(mean: float, std: float, seed: int, *keys: str) -> str:
    return f"({mean!r}::DOUBLE + {std!r}::DOUBLE * sqrt(-2.0::DOUBLE * ln({_u(seed, repr('radius'), *keys)})) * cos({2 * math.pi!r}::DOUBLE * {_u(seed, repr('angle'), *keys)}))"


def _missing(x: str, rate: float, seed: int, *keys: str) -> str:
    return f"CASE WHEN {_u(seed, repr('loss'), *keys)} >= {rate!r}::DOUBLE THEN {x} END"


def _line(n: str, start: float, stop: float | str) -> str:
    stop = stop if isinstance(stop, str) else f"{float(stop)!r}::DOUBLE"
    return f"({float(start)!r}::DOUBLE + i * CASE WHEN {n} > 1 THEN ({stop} - {float(start)!r}::DOUBLE) / ({n} - 1) ELSE 0 END)"


def _n(channels: int) -> str:
    return f"(SELECT max(event_id) // {channels} + 1 FROM events)"


def _index(channels: int) -> str:
    """Samples are the rows of the log, dealt to channels."""
    return f"SELECT CAST(event_id % {channels} AS INTEGER) AS ch, event_id // {channels} AS i FROM events"


def _analog(channels: int, seed: int = 0) -> str:
    n = _n(channels)
    return f"SELECT ch, i, 5.0::DOUBLE * sin({_line(n, 0, 2 * math.pi)}) + {_g(0.0, 0.1, seed, repr('analog'), 'ch', 'i')} + {_line(n, 0, 0.5)} AS x FROM ({_index(channels)})"


def _digital(seed: int = 0) -> str:
    states = f"SELECT ch, i, CASE WHEN {_u(seed, repr('coin'), repr('digital'), 'ch', 'i')} < 0.5 THEN 1 ELSE 0 END AS b FROM ({_index(1)})"
    return f"""WITH RECURSIVE raw AS MATERIALIZED ({states}), d AS (SELECT ch, i, b AS x, 0 AS hold FROM raw WHERE i = 0 UNION ALL
 SELECT raw.ch, raw.i, CASE WHEN d.hold > 0 THEN d.x ELSE raw.b END, CASE WHEN d.hold > 0 THEN d.hold - 1 WHEN raw.b <> d.x THEN 4 ELSE 0 END FROM d JOIN raw ON raw.ch = d.ch AND raw.i = d.i + 1)
 SELECT ch, i, x FROM d"""


def _network(channels: int, seed: int = 0) -> str:
    n, keys = _n(channels), ("ch", "i")
    x = f"{_g(0.5, 0.1, seed, repr('network'), *keys)} + 0.05::DOUBLE * sin({2 * math.pi * 0.1!r}::DOUBLE * {_line(n, 0, f'({n} / {NETWORK_RATE}.0::DOUBLE)')}) + {_g(0.0, 0.01, seed, repr('network noise'), *keys)}"
    return f"SELECT ch, i, {_missing(x, LOSS['network'], seed, *keys)} AS x FROM ({_index(channels)})"


def _ethernet(seed: int = 0) -> str:
    raw = f"SELECT ch, i, {_missing(_g(0.0, 1.0, seed, repr('ethernet'), 'ch', 'i'), LOSS['ethernet'], seed, 'ch', 'i')} AS x FROM ({_index(1)})"
    late = f"CAST(trunc({_g(0.02, 0.005, seed, repr('latency'))} * {DAQ_RATE}) AS BIGINT)"
    return f"SELECT a.ch, a.i, b.x FROM ({raw}) a JOIN ({raw}) b ON a.ch = b.ch AND a.i = (b.i + {late}) % {_n(1)}"


def _ts(rate: int) -> str:
    return f"TIMESTAMP '2024-01-01 00:00:00' + to_microseconds(i * {int(1e6 / rate)})"


def _signal(rows: str, rate: int = DAQ_RATE) -> str:
    return f"SELECT ch AS channel, i AS sample_idx, {_ts(rate)} AS timestamp, round(x::DOUBLE, 6) AS x FROM ({rows})"


def _two(rows: str) -> str:
    return f"SELECT i, max(x) FILTER (ch = 0) AS a, max(x) FILTER (ch = 1) AS b FROM ({rows}) GROUP BY i"


_RUNS = {
    "burnin": f"SELECT a.i, {_ts(DAQ_RATE)} AS timestamp, a.x AS temperature, d.x AS status, {_g(3.3, 0.1, 0, repr('burnin voltage'), 'a.i')} AS voltage, {_g(0.5, 0.05, 0, repr('burnin current'), 'a.i')} AS current "
    f"FROM ({_analog(1)}) a JOIN ({_digital()}) d ON a.i = d.i".replace(_ts(DAQ_RATE), _ts(DAQ_RATE).replace("(i *", "(a.i *")),
    "hipot": f"SELECT i, {_ts(DAQ_RATE)} AS timestamp, abs(a) * 5.0::DOUBLE + 0.0 AS voltage, abs(b) * 1.0::DOUBLE + 0.0 AS current FROM ({_two(_analog(2))})",
    "isolation": f"SELECT i, {_ts(DAQ_RATE)} AS timestamp, abs(x) * 1000000.0::DOUBLE + 0.0 AS resistance FROM ({_analog(1)})",
    "laser": f"SELECT i, {_ts(NETWORK_RATE)} AS timestamp, a * 50.0::DOUBLE + 55.0::DOUBLE AS power, b * 25.0::DOUBLE + 825.0::DOUBLE AS wavelength FROM ({_two(_network(2))})",
    "parametric": f"SELECT *, voltage * current / 1000 AS power FROM (SELECT i, {_ts(DAQ_RATE)} AS timestamp, abs(a) * 1000.0::DOUBLE + 0.0 AS voltage, abs(b) * 1000.0::DOUBLE + 0.0 AS current FROM ({_two(_analog(2))}))",
}
_FLAGS = {
    "burnin": ("failures", "temperature > 90"),
    "hipot": ("pass_fail", "current < 1"),
    "isolation": ("pass_fail", "resistance >= 100"),
    "laser": ("pass_fail", "power BETWEEN 10 AND 100 AND wavelength BETWEEN 800 AND 850"),
    "parametric": ("pass_fail", "voltage BETWEEN 3200 AND 3400 AND current BETWEEN 450 AND 550 AND power <= 2000"),
}


def _run(test: str) -> str:
    """A generated run with its flag, unrounded."""
    flag, holds = _FLAGS[test]
    return f"SELECT *, CASE WHEN {holds} THEN 1 ELSE 0 END AS {flag} FROM ({_RUNS[test]})"


def _ict() -> str:
    parts, start = [], 0
    for f in FAMILIES:
        points = ", ".join(f"({start + k + 1}, {p!r})" for k, p in enumerate(f.points))
        x, ok = _g(f.mean, f.std, 0, repr("ict"), "p", "i"), f"x < {f.rule.low}" if f.rule.kind == "below" else f"abs(x - {f.rule.low}::DOUBLE) / {f.rule.low}::DOUBLE <= {f.rule.high}::DOUBLE"
        cols = "x AS resistance, NULL::DOUBLE AS value" if f.column == "resistance" else "NULL::DOUBLE AS resistance, x AS value"
        parts.append(f"SELECT i * {sum(len(x.points) for x in FAMILIES)} + n AS sequence_num, {f.label!r} AS test_type, p AS test_point, {cols}, {ok} AS pass_fail FROM (SELECT *, {x} AS x FROM ({_index(1)}), (VALUES {points}) v(n, p))")
        start += len(f.points)
    return " UNION ALL ".join(parts)


def _places(df: DataFrame, places: int) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


#: Places that are compared: products of the instruments' full scale have fewer that mean something.
_PLACES = {"isolation": 2, "parametric": 3}


def _samples(spark, sf):
    """Samples of so many channels: the rows of the log."""
    log = t(spark, sf, "events").select("event_id")
    return lambda channels: log.select((F.col("event_id") % channels).cast("int").alias("channel"), F.expr(f"event_id div {channels}").alias("sample_idx"))


def _generated(test: str) -> None:
    names, places = schemas.REPORT[test].names, _PLACES.get(test, 6)
    doubles = {f.name for f in schemas.REPORT[test].fields if f.dataType.simpleString() == "double"}
    order = "sequence_num" if test == "ict" else "sample_idx"
    have = [*dict.fromkeys([order, *names])]
    cols = [f"round({c}, {places}) AS {c}" if c in doubles else "i AS sample_idx" if c == "sample_idx" else c for c in have]

    def generated(spark, sf):
        return _places(generate(spark, test, index=_samples(spark, sf)).select(*have), places)

    generated.__name__, generated.__doc__ = f"generated_{test}", f"A run of {SPECS[test].title} measurements."
    query(f"SELECT {', '.join(cols)} FROM ({_ict() if test == 'ict' else _run(test)})")(generated)


for _test in GENERATORS:
    _generated(_test)


@query(_signal(_analog(2)))
def signal_analog(spark, sf):
    return rounded(signal(spark, "analog", 0, 2, index=_samples(spark, sf)))


@query(_signal(_digital()))
def signal_digital(spark, sf):
    return rounded(signal(spark, "digital", 0, 1, index=_samples(spark, sf)))


@query(_signal(_ethernet()))
def signal_ethernet(spark, sf):
    return rounded(signal(spark, "ethernet", 0, 1, index=_samples(spark, sf)))


@query(_signal(_network(3), NETWORK_RATE))
def signal_network(spark, sf):
    return rounded(signal(spark, "network", 0, 3, index=_samples(spark, sf)))


@query(f"SELECT *, 'OK: *IDN?' AS reply, true AS released FROM ({_signal(_network(1, 4), NETWORK_RATE)})")
def instrument_session(spark, sf):
    """An instrument is opened, asked, read and released; reading it closed is refused."""
    x = Instrument(spark, "network", seed=4)
    try:
        x.read(1)
    except ConnectionError:
        pass
    else:
        raise AssertionError("a closed instrument was read")
    if not x.connect():
        raise ConnectionError("not connected")
    rows = rounded(x.read(0, index=_samples(spark, sf))).withColumn("reply", F.lit(x.send("*IDN?")))
    return rows.withColumn("released", F.lit(x.disconnect() and not x.connected))


# Runs taken from the measurement log: each row of ``events`` is a sample, its value scaled to what a test measures

#: Test -> measured column -> (factor, offset).
_SCALES = {
    "burnin": {"temperature": (2.0, 0.0), "voltage": (0.01, 3.0), "current": (0.005, 0.0)},
    "hipot": {"voltage": (0.02, 4.0), "current": (0.02, 0.0)},
    "isolation": {"resistance": (5.0, 0.0)},
    "laser": {"power": (1.0, 5.0), "wavelength": (1.0, 800.0)},
    "parametric": {"voltage": (4.0, 3200.0), "current": (2.0, 450.0)},
}


def _log(spark, sf, test: str) -> DataFrame:
    """The log as a run of a test, flagged by its rules."""
    rows = t(spark, sf, "events").select(F.col("event_id").alias("sample_idx"), F.col("ts").alias("timestamp"), F.col("value").alias("x"))
    if test == "ict":
        parts = []
        for k, f in enumerate(FAMILIES):
            own = rows.where(F.pmod("sample_idx", F.lit(len(FAMILIES))) == k).select((F.col("sample_idx") + 1).alias("sequence_num"), F.lit(f.label).alias("test_type"), F.lit(f.points[0]).alias("test_point"), rules.scaled(F.col("x"), f.std / 10, f.mean).alias(f.column))
            parts.append(own.withColumn("pass_fail", rules.holds(f.rule)))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).select(*schemas.REPORT["ict"].names)
    out = rows.select("sample_idx", "timestamp", *[rules.scaled(F.col("x"), k, b).alias(n) for n, (k, b) in _SCALES[test].items()])
    if test == "burnin":
        out = out.withColumn("status", F.pmod("sample_idx", F.lit(2)).cast("int"))
    if test == "parametric":
        out = out.withColumn("power", rules.milli_product(F.col("voltage"), F.col("current")))
    return rules.with_flag(out, SPECS[test])


def _logged(test: str) -> str:
    """The same in SQL."""
    if test == "ict":
        parts = []
        for k, f in enumerate(FAMILIES):
            x, ok = f"value * {f.std / 10!r}::DOUBLE + {f.mean!r}::DOUBLE", f"x < {f.rule.low}" if f.rule.kind == "below" else f"abs(x - {f.rule.low}::DOUBLE) / {f.rule.low}::DOUBLE <= {f.rule.high}::DOUBLE"
            cols = "x AS resistance, NULL::DOUBLE AS value" if f.column == "resistance" else "NULL::DOUBLE AS resistance, x AS value"
            parts.append(f"SELECT event_id + 1 AS sequence_num, {f.label!r} AS test_type, {f.points[0]!r} AS test_point, {cols}, {ok} AS pass_fail FROM (SELECT event_id, {x} AS x FROM events WHERE event_id % {len(FAMILIES)} = {k})")
        return " UNION ALL ".join(parts)
    cols = ", ".join(f"value * {k!r}::DOUBLE + {b!r}::DOUBLE AS {n}" for n, (k, b) in _SCALES[test].items())
    rows = f"SELECT event_id AS i, ts AS timestamp, {cols}, CAST(event_id % 2 AS INTEGER) AS status FROM events"
    if test == "parametric":
        rows = f"SELECT *, voltage * current / 1000 AS power FROM ({rows})"
    flag, holds = _FLAGS[test]
    return f"SELECT *, CASE WHEN {holds} THEN 1 ELSE 0 END AS {flag} FROM ({rows})"


# Statistics and views of those runs


def _shown(test: str, of: str = "statistic") -> str:
    return "CASE " + " ".join(f"WHEN {of} = {k!r} THEN {u!r}" for (s, k), u in STATISTIC_UNITS.items() if s == test) + " ELSE '' END"


def _statistics(test: str) -> str:
    """(test_name, statistic, unit, mean, std, min, max), unrounded."""
    four = lambda x: f"avg({x}) AS mean, stddev_samp({x}) AS std, min({x}) AS min, max({x}) AS max"
    if test == "ict":
        rows = f"SELECT test_type || '_stats' AS statistic, {four('coalesce(resistance, value)')} FROM ({_logged('ict')}) GROUP BY test_type"
    else:
        rows = " UNION ALL ".join(f"SELECT '{p.name}_stats' AS statistic, {four(p.name)} FROM r" for p in SPECS[test].parameters)
        rows = f"WITH r AS MATERIALIZED ({_logged(test)}) {rows}"
    return f"SELECT {test!r} AS test_name, statistic, {_shown(test)} AS unit, mean, std, min, max FROM ({rows})"


_R8 = ", ".join(f"round({s}, 8) AS {s}" for s in ("mean", "std", "min", "max"))


@query(" UNION ALL ".join(f"SELECT test_name, statistic, unit, {_R8} FROM ({_statistics(n)})" for n in GENERATORS))
def generated_statistics(spark, sf):
    """Statistics of a run of each test type, one below the other: every entry of a result that has a mean."""
    return _places(views.cross_test({n: runs.analyze(_log(spark, sf, n), n, AT) for n in GENERATORS}), 8)


def _hipot(spark, sf) -> DataFrame:
    return runs.analyze(_log(spark, sf, "hipot"), "hipot", AT)


@query(f"SELECT test_name, statistic, unit, {_R8} FROM ({_statistics('hipot')})")
def document_scan(spark, sf):
    """A result document is written as JSON and read again."""
    path = writers.write_document(_hipot(spark, sf), writers.scratch(spark), "hipot", AT)
    return _places(views.statistics(readers.read_document(spark, path, "hipot"), "hipot"), 8)


_LINE = "printf('%.2f', {})"
_RATE = f"SELECT avg(pass_fail) * 100 AS p FROM ({_logged('hipot')})"
_TITLE = "CASE statistic WHEN 'voltage_stats' THEN 'Voltage Stats' ELSE 'Current Stats' END"


def _text(label: str, *cols: str) -> str:
    return f"'{label}: ' || " + " || ' - ' || ".join(_LINE.format(c) for c in cols) + " || ' ' || unit"


@query(
    f"SELECT 'Pass Rate' AS heading, {_LINE.format('p')} || '%' AS lines, CASE WHEN p > 95 THEN 'green' ELSE 'orange' END AS colour FROM ({_RATE}) UNION ALL "
    f"SELECT {_TITLE}, {_text('Mean', 'mean')} || '; ' || {_text('Std', 'std')} || '; ' || {_text('Range', 'min', 'max')}, NULL FROM ({_statistics('hipot')})"
)
def summary_cards(spark, sf):
    return views.summary_cards(_hipot(spark, sf), "hipot").withColumn("lines", F.array_join("lines", "; "))


@query(f"SELECT {_TITLE} AS parameter, " + ", ".join(f"{_LINE.format(s)} || ' ' || unit AS {s}" for s in ("mean", "std", "min", "max")) + f" FROM ({_statistics('hipot')})")
def detail_table(spark, sf):
    return views.detail_table(_hipot(spark, sf), "hipot")


@query(
    f"SELECT 0 AS n, 'hipot:' AS line UNION ALL SELECT 1, '  Pass Rate: ' || {_LINE.format('p')} || '%' FROM ({_RATE}) UNION ALL "
    f"SELECT CASE statistic WHEN 'voltage_stats' THEN 2 ELSE 3 END, '  ' || statistic || ': mean ' || {_LINE.format('mean')} || ', std ' || {_LINE.format('std')} || ', min ' || {_LINE.format('min')} || ', max ' || {_LINE.format('max')} || ' ' || unit FROM ({_statistics('hipot')})"
)
def console_report(spark, sf):
    """What a run prints, and a summary on the command line: the newest result found below a folder."""
    root = writers.scratch(spark)
    for at in (datetime(2024, 1, 1), AT):
        path = writers.write_document(_hipot(spark, sf), root, "hipot", at)
    found = readers.latest_artifact(spark, root, "hipot", "json")
    if found is None or not found.endswith(path.rsplit("/", 1)[1]):
        raise AssertionError(f"{found} isn't the newest result")
    lines = writers.console_report(readers.read_document(spark, found, "hipot"), "hipot")
    return spark.createDataFrame(list(enumerate(lines)), "n int, line string")


@query(f"SELECT timestamp, round(voltage, 6) AS voltage, round(current, 6) AS current, pass_fail FROM ({_logged('hipot')})")
def report_rescan(spark, sf):
    """A run's data is written as CSV, found as the newest report and read in its own types."""
    root = writers.scratch(spark)
    runs.run(spark, "hipot", root, at=AT, data=_log(spark, sf, "hipot"))
    return rounded(readers.read_report(spark, readers.latest_artifact(spark, root, "hipot", "csv"), "hipot"))


@query(f"SELECT timestamp, round(voltage, 6) AS voltage, round(current, 6) AS current, pass_fail FROM ({_logged('hipot')}) ORDER BY timestamp LIMIT 10")
def report_rows(spark, sf):
    """The first rows of a report by its order; what isn't a number of rows means ten."""
    path = writers.write_csv(_log(spark, sf, "hipot").select(schemas.REPORT["hipot"].names), writers.scratch(spark), "hipot", AT)
    return rounded(views.head_rows(readers.read_report(spark, path, "hipot"), scalar.row_count_or("all of them")))


_LIMIT = {"voltage": (4.5, 5.5), "current": (None, 1.0)}


@query(" UNION ALL ".join(f"SELECT timestamp AS x, '{p}' AS parameter, round({p}, 6) AS y, {'NULL' if lo is None else lo}::DOUBLE AS lower, {hi}::DOUBLE AS upper FROM ({_logged('hipot')})" for p, (lo, hi) in _LIMIT.items()))
def plot_panels(spark, sf):
    return rounded(views.plot_panels(_log(spark, sf, "hipot").drop("sample_idx"), SPECS["hipot"]))


def _panel(chart: str, p: str) -> str:
    x = f"SELECT i AS x, {p} AS y FROM ({_logged('hipot')})"
    if chart == "r":
        x = f"SELECT x, abs(y - lag(y) OVER (ORDER BY x)) AS y FROM ({x})"
    return f"SELECT '{chart}' AS chart, x, '{p}' AS parameter, round(y, 5) AS y, round(avg(y) OVER (), 5) AS cl, round(avg(y) OVER () + 3 * stddev_samp(y) OVER (), 5) AS ucl, round(avg(y) OVER () - 3 * stddev_samp(y) OVER (), 5) AS lcl FROM ({x})"


@query(" UNION ALL ".join(_panel(c, p) for c in ("x", "r") for p in _LIMIT))
def spc_panels(spark, sf):
    xbar, ranges = views.spc_panels(_log(spark, sf, "hipot"), SPECS["hipot"])
    both = xbar.select(F.lit("x").alias("chart"), "x", "parameter", "y", "cl", "ucl", "lcl").unionByName(ranges.select(F.lit("r").alias("chart"), "x", "parameter", F.col("moving_range").alias("y"), "cl", "ucl", "lcl"))
    return _places(both, 5)


@query("SELECT 'type ' || event_type AS test_name, event_type <> 'error' AS success, CASE WHEN event_type <> 'error' THEN count(*) END AS n_rows FROM events GROUP BY event_type")
def batch_status(spark, sf):
    """A run for each type of the log; those on errors fail, which doesn't stop the batch. Reports of the others are read again."""
    root, log = writers.scratch(spark), t(spark, sf, "events")
    types = sorted(r[0] for r in log.select("event_type").distinct().collect())  # a handful of names

    def data(name):
        rows = _log(spark, sf, "hipot").join(log.where(F.col("event_type") == name).select(F.col("event_id").alias("sample_idx")), "sample_idx", "left_semi")
        return rows.withColumn("voltage", F.raise_error(F.lit("not measured")).cast("double")) if name == "error" else rows

    done = runs.batch(spark, root, [f"type {n}" for n in types], run_one=lambda name: runs.run(spark, "hipot", f"{root}/{name.replace(' ', '-')}", at=AT, data=data(name.removeprefix("type "))))
    kept = [n for n in types if n != "error"]
    counts = [readers.read_report(spark, readers.latest_artifact(spark, f"{root}/type-{n}", "hipot", "csv"), "hipot").agg(F.count("*").alias("n_rows")).select(F.lit(f"type {n}").alias("_name"), "n_rows") for n in kept]
    n_rows = reduce(DataFrame.unionByName, counts)
    return done.join(n_rows, F.col("test_name") == F.col("_name"), "left").select("test_name", "success", "n_rows")


# Files and tables


def _events_csv(spark, sf, *more) -> str:
    rows = t(spark, sf, "events").select(F.col("event_id").alias("id"), "value", *more)
    return writers.write_csv(rows, writers.scratch(spark), "raw", AT)


@query("SELECT event_id AS id, value FROM events")
def csv_scan(spark, sf):
    """Written as CSV with a header, read by its schema; a row that doesn't fit would fail the query."""
    return readers.read_csv(spark, _events_csv(spark, sf))


@query("SELECT event_id AS id, value, event_id % 10 = 0 AS corrupt FROM events WHERE event_id % 10 <> 0 UNION ALL SELECT event_id, NULL, true FROM events WHERE event_id % 10 = 0")
def csv_quarantine(spark, sf):
    """Cells that are no numbers, kept apart."""
    bad = F.when(F.col("event_id") % 10 == 0, "x").otherwise(F.col("value").cast("string"))
    path = writers.write_csv(t(spark, sf, "events").select(F.col("event_id").alias("id"), bad.alias("value")), writers.scratch(spark), "raw", AT)
    rows = readers.read_csv(spark, path, quarantine=True)
    return rows.select("id", "value", F.col("_corrupt_record").isNotNull().alias("corrupt"))


@query(f"SELECT event_id AS id, value AS voltage, value AS current, {_AT} AS test_time, 'PASS' AS result, 'Sample ICT data' AS description FROM events")
def ingest_ict(spark, sf):
    """A file without times or results goes into a table, with the time of the call and a pass."""
    table, where = writers.scratch_table(spark)
    ingest.ingest(spark, "ict", _events_csv(spark, sf), AT, table, where)
    return readers.read_table(spark, table)


@query("SELECT event_id AS id, value AS resistance, value AS voltage, ts AS test_time, CASE WHEN value < 50 THEN 'PASS' ELSE 'FAIL' END AS result, 'Isolation Test ' || event_id AS description FROM events")
def ingest_isolation(spark, sf):
    """A file with times and results of its own."""
    table, where = writers.scratch_table(spark)
    result = F.when(F.col("value") < 50, "PASS").otherwise("FAIL").alias("result")
    ingest.ingest(spark, "isolation", _events_csv(spark, sf, F.col("ts").alias("timestamp"), result), AT, table, where)
    return readers.read_table(spark, table)


@query("SELECT event_id AS id, value, 'Burn-in Test ' || event_id AS description FROM events UNION ALL SELECT event_id + 1000000000, value, 'Burn-in Test ' || (event_id + 1000000000) FROM events")
def append_twice(spark, sf):
    """Two appends to a table; a third, whose ids the table has, adds nothing."""
    table, where = writers.scratch_table(spark)
    one = _events_csv(spark, sf)
    two = writers.write_csv(t(spark, sf, "events").select((F.col("event_id") + 10**9).alias("id"), "value"), writers.scratch(spark), "raw", AT)
    for path in (one, two, one):
        try:
            ingest.ingest(spark, "burnin", path, AT, table, where)
        except normalize.IntegrityError:
            if path != one:
                raise
    return readers.read_table(spark, table)


@query("SELECT event_id AS id, 'HiPot Test ' || event_id AS description FROM events WHERE 'HiPot Test ' || event_id = 'HiPot Test 7'")
def description_filter(spark, sf):
    raw = t(spark, sf, "events").select(F.col("event_id").alias("id"), "value", F.col("ts").alias("timestamp"))
    rows = normalize.entities(normalize.normalize(raw, "hipot"), "hipot")
    return rules.in_category(rows, "description", "HiPot Test 7").select("id", "description")


def _pictures(spark, sf) -> str:
    """A file for each segment of the customers, and an empty one."""
    root = writers.scratch(spark)
    for r in t(spark, sf, "customer").select("c_mktsegment").distinct().collect():  # a handful of names
        writers.write_text(spark, f"{root}/{r[0].lower()}/plot.png", r[0])
    writers.write_text(spark, f"{root}/none/plot.png", "")
    return root


@query("SELECT lower(c_mktsegment) AS test_name, 'data:image/png;base64,' || base64(encode(c_mktsegment)) AS source FROM (SELECT DISTINCT c_mktsegment FROM customer)")
def image_scan(spark, sf):
    """Pictures as data URLs; an empty file is left out."""
    return views.image_view(readers.read_images(spark, _pictures(spark, sf))).select("test_name", "source")


@query("SELECT lower(c_mktsegment) AS test_name, 'plot.png' AS name, CAST(length(c_mktsegment) AS BIGINT) AS length FROM (SELECT DISTINCT c_mktsegment FROM customer)")
def artifact_listing(spark, sf):
    """All files below a folder but empty ones; a folder that isn't there has none."""
    root = _pictures(spark, sf)
    lists = [views.file_listing(readers.list_artifacts(spark, r)) for r in (root, f"{root}/absent")]
    return reduce(DataFrame.unionByName, lists).select("test_name", F.element_at(F.split("path", "/"), -1).alias("name"), "length")
