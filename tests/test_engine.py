"""Sources, sinks, runs, streams and the registered queries."""

import os
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugelab.operators import stats, views
from gaugelab.operators.normalize import IntegrityError
from gaugelab.plans import catalogue, runs, schemas
from gaugelab.plans.specs import FAMILIES, SPECS
from gaugelab.sinks import writers
from gaugelab.sources import readers
from gaugelab.sources.generators import GENERATORS, generate
from gaugelab.sources.ingest import ingest, prepared
from gaugelab.sources.signals import Instrument, signal
from gaugelab.streaming import live

AT = datetime(2024, 2, 3, 4, 5, 6)


def put(path, text):
    with open(path, "w") as f:
        f.write(text)
    return str(path)


def test_csv_sources(spark, tmp_path):
    good = put(tmp_path / "good.csv", "id,value\n1,1100\n2,1200\n")
    assert [tuple(r) for r in readers.read_csv(spark, good).orderBy("id").collect()] == [(1, 1100.0), (2, 1200.0)]
    assert readers.read_csv(spark, put(tmp_path / "head.csv", "id,value\n")).count() == 0
    with pytest.raises(readers.EmptySourceError):
        readers.read_csv(spark, put(tmp_path / "none.csv", ""))
    for name, text in {"text": "id,value\n1,abc\n", "long": "id,value\n1,2,3\n"}.items():
        path = put(tmp_path / f"{name}.csv", text)
        with pytest.raises(Exception):
            readers.read_csv(spark, path).collect()
        kept = readers.read_csv(spark, path, quarantine=True).cache()
        assert kept.where("_corrupt_record is not null").count() == 1
    with pytest.raises(Exception):
        readers.read_csv(spark, str(tmp_path / "absent.csv")).count()


@pytest.mark.parametrize("test_type", list(SPECS))
def test_ingest(spark, tmp_path, test_type):
    table = f"t_{test_type}"
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    good = put(tmp_path / "good.csv", "id,value\n1,1100\n2,1200\n")
    assert ingest(spark, test_type, good, AT, table) == 2
    rows = spark.table(table).orderBy("id").collect()
    assert [r.id for r in rows] == [1, 2] and all(r[m] == 1000.0 + 100 * r.id for r in rows for m in SPECS[test_type].measures)
    for bad in ("id,value\n3,1\n3,2\n", "id,value\n2,5\n4,6\n", "id,value\n5,\n", "id,value\n6,x\n"):
        with pytest.raises(Exception):
            ingest(spark, test_type, put(tmp_path / "bad.csv", bad), AT, table)
        assert spark.table(table).count() == 2  # all of a file or nothing
    assert ingest(spark, test_type, put(tmp_path / "empty.csv", "id,value\n"), AT, table) == 0
    spark.sql(f"DROP TABLE {table}")


def test_ingest_with_own_times(spark, tmp_path):
    path = put(tmp_path / "x.csv", "id,value,timestamp,result\n1,5,2024-01-02 03:04:05,FAIL\n")
    r = prepared(spark, "hipot", path).first()
    assert (r.test_time, r.result) == (datetime(2024, 1, 2, 3, 4, 5), "FAIL")
    with pytest.raises(ValueError):
        prepared(spark, "nothing", path)
    assert issubclass(IntegrityError, ValueError)


def test_signals(spark):
    a = signal(spark, "analog", 2, 2, seed=1).orderBy("channel", "sample_idx").toPandas()
    assert len(a) == 4000 and a.sample_idx.max() == 1999
    i = a[a.channel == 0].sample_idx.to_numpy()
    clean = 5 * np.sin(np.linspace(0, 2 * np.pi, 2000)) + np.linspace(0, 0.5, 2000)
    assert np.abs(a[a.channel == 0].x.to_numpy() - clean)[i].max() < 0.6
    assert (a.timestamp.diff().dropna().dt.total_seconds().abs() <= 2).all()
    d = signal(spark, "digital", 1, 1).orderBy("sample_idx").toPandas().x.to_numpy()
    runs_ = np.diff(np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]])))
    assert set(np.unique(d)) == {0.0, 1.0} and runs_[1:].min() >= 5
    e = signal(spark, "ethernet", 5, 1).toPandas().x
    assert 0.03 < e.isna().mean() < 0.07
    n = signal(spark, "network", 100, 1).toPandas().x
    assert len(n) == 1000 and 0.001 < n.isna().mean() < 0.03 and abs(n.mean() - 0.5) < 0.02
    with pytest.raises(ValueError):
        signal(spark, "radio", 1)
    assert signal(spark, "analog", 0).count() == 0


def test_instrument(spark):
    x = Instrument(spark, "network")
    with pytest.raises(ConnectionError):
        x.read(1)
    with pytest.raises(ConnectionError):
        x.send("*IDN?")
    assert x.connect() and x.send("*IDN?") == "OK: *IDN?" and x.read(1).count() == 10
    assert x.disconnect() and not x.connected
    assert not Instrument(spark, "network", failure=1.0).connect()
    y = Instrument(spark, "analog", error=1.0)
    y.connect()
    with pytest.raises(RuntimeError):
        y.send("RUN")


@pytest.mark.parametrize("test_type", list(GENERATORS))
def test_generators(spark, test_type):
    df = generate(spark, test_type, 1, seed=3)
    names = [f.name for f in schemas.REPORT[test_type].fields]
    assert set(names) <= set(df.columns)
    n = sum(len(f.points) for f in FAMILIES) if test_type == "ict" else 10 if test_type == "laser" else 1000
    assert df.count() == n
    again = generate(spark, test_type, 1, seed=3)
    assert sorted(map(str, df.select(names).collect())) == sorted(map(str, again.repartition(5).select(names).collect()))


def test_generator_options(spark):
    legacy = generate(spark, "laser", 2, legacy=True).where("power is not null").first()
    assert legacy.wavelength == pytest.approx((legacy.power - 55) / 50 * 25 + 825)
    assert generate(spark, "laser", 1, connection="daq").count() == 1000
    ict = generate(spark, "ict").orderBy("sequence_num").collect()
    assert [r.sequence_num for r in ict] == list(range(1, 15)) and all((r.resistance is None) != (r.value is None) for r in ict)
    with pytest.raises(ValueError):
        generate(spark, "nothing")


def flat(d, at=""):
    return {k2: v2 for k, v in d.items() for k2, v2 in (flat(v, f"{at}{k}.") if isinstance(v, dict) else {f"{at}{k}": v}).items()}


@pytest.mark.parametrize("test_type", list(GENERATORS))
def test_run_and_serve(spark, tmp_path, test_type):
    root = str(tmp_path)
    paths = runs.run(spark, test_type, root, 1, at=AT)
    back = readers.read_report(spark, paths["csv"], test_type)
    df = generate(spark, test_type, 1)
    assert back.count() == df.count()
    doc = readers.read_document(spark, paths["json"], test_type)
    direct = runs.analyze(df, test_type, AT)
    a, b = flat(doc.first().asDict(True)), flat(direct.first().asDict(True))
    assert a.keys() == b.keys() and all(a[k] == b[k] or a[k] == pytest.approx(b[k]) for k in a)
    assert views.statistics(doc, test_type).count() == (4 if test_type == "ict" else len(SPECS[test_type].parameters))
    assert "\n    " in open(paths["json"]).read() and writers.console_report(doc, test_type)[0] == f"{test_type}:"
    files = readers.list_artifacts(spark, root)
    assert {r.kind for r in views.latest_artifacts(files.where(F.col("test_name") == test_type)).collect()} >= {"json"}
    assert views.time_series(back, test_type).select("parameter").distinct().count() <= 3
    assert views.spc_chart(back, test_type).where("cl is null").count() == 0
    panels = views.plot_panels(df, SPECS[test_type])
    xbar, r = views.spc_panels(df, SPECS[test_type])
    assert panels.count() == xbar.count() > 0 and (r.count() > 0) == (test_type != "ict")


def test_statistics_of_a_run_match_pandas(spark):
    df = generate(spark, "hipot", 1)
    p = df.toPandas()
    r = runs.analyze(df, "hipot", AT).first()
    assert r.pass_rate == pytest.approx(p.pass_fail.mean())
    assert r.voltage_stats.std == pytest.approx(p.voltage.std())
    assert r.voltage_capability.cp == pytest.approx(min(5.5 - p.voltage.mean(), p.voltage.mean() - 4.5) / (3 * p.voltage.std()))
    assert r.current_capability.cpk == pytest.approx((1.0 - p.current.mean()) / (3 * p.current.std()))


def test_batch(spark, tmp_path):
    done = runs.batch(spark, str(tmp_path), ["laser", "nothing", "ict"], 1)
    assert [(r.test_name, r.success) for r in done.collect()] == [("laser", True), ("nothing", False), ("ict", True)]
    assert stats.success(done).first().percent == pytest.approx(200 / 3)


def test_images_and_listing(spark, tmp_path):
    os.makedirs(tmp_path / "laser")
    (tmp_path / "laser/a.png").write_bytes(b"\x89PNG")
    (tmp_path / "laser/b.png").write_bytes(b"")
    r = views.image_view(readers.read_images(spark, str(tmp_path))).collect()
    assert [x.source for x in r] == ["data:image/png;base64,iVBORw=="]
    assert readers.list_artifacts(spark, str(tmp_path / "absent")).count() == 0


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    os.makedirs(src)
    schema = "id long, k string, ts timestamp, x double"
    from pyspark.sql.types import _parse_datatype_string

    put(src / "1.csv", "id,k,ts,x\n0,a,2024-01-01 00:00:01,1\n1,a,2024-01-01 00:00:03,3\n")
    put(src / "2.csv", "id,k,ts,x\n2,a,2024-01-01 00:00:05,8\n3,b,2024-01-01 00:00:12,5\n")
    os.utime(src / "1.csv", (1_700_000_000, 1_700_000_000))  # files come in order of their times
    stream = live.watch_csv(spark, str(src), _parse_datatype_string(schema), per_trigger=1)
    q = live.windowed_stats(stream, "x", "k").writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.k, r.n, r["mean"]) for r in spark.sql("select * from w").collect()}
    assert got == {("a", 3, 4.0), ("b", 1, 5.0)}
    stream = live.watch_csv(spark, str(src), _parse_datatype_string(schema), per_trigger=1)
    q = live.live_moving_range(stream, "x", "k", "id").writeStream.outputMode("append").format("memory").queryName("mr").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.id, r.moving_range) for r in spark.sql("select * from mr").collect()} == {(0, None), (1, 2.0), (2, 5.0), (3, None)}


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_queries_equal_their_sql(spark, sf_dir, name):
    import duckdb

    df = catalogue.QUERIES[name](spark, sf_dir)
    rows = df.collect()
    assert df.columns and rows
    if name in catalogue.SQL:
        con = duckdb.connect()
        for t in ("events", "lineitem", "orders", "part", "customer"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
        cur = con.execute(catalogue.SQL[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == sorted(df.columns)
        show = lambda r: tuple(repr(x) for x in r)
        assert sorted(show(r[n] for n in names) for r in rows) == sorted(map(show, cur.fetchall()))


def test_scans_are_pruned_and_filtered(spark, sf_dir):
    plan = catalogue.QUERIES["category_filter"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,click)" in plan and "props" not in plan


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_command_line(spark, tmp_path, capfd, monkeypatch):
    from gaugelab.__main__ import main

    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    root = str(tmp_path / "reports")
    assert main(["run", "hipot", "--root", root, "--duration", "1"]) == 0
    assert main(["summary", "hipot", "--root", root]) == 0
    assert main(["rows", "hipot", "3", "--root", root]) == 0
    assert main(["summary", "laser", "--root", root]) == 0
    assert main(["files", "--root", root]) == 0
    said = capfd.readouterr().out
    assert "1 of 1 runs succeeded (100.0%)" in said and "Pass Rate: " in said and "laser: no results" in said
    assert "hipot: 1000 rows, 4 columns: timestamp, voltage, current, pass_fail" in said


def test_newest_artifact(spark, tmp_path):
    root = str(tmp_path)
    assert readers.latest_artifact(spark, root, "hipot", "json") is None
    doc = runs.analyze(generate(spark, "hipot", 1), "hipot", AT)
    paths = [writers.write_document(doc, root, "hipot", datetime(2024, 1, k, 1)) for k in (1, 3, 2)]
    for p, at in zip(paths, (1_700_000_300, 1_700_000_100, 1_700_000_200)):
        os.utime(p, (at, at))
    assert readers.latest_artifact(spark, root, "hipot", "json").endswith(paths[0])
    os.utime(paths[1], (1_700_000_300, 1_700_000_300))
    assert readers.latest_artifact(spark, root, "hipot", "json").endswith(paths[1])
    assert readers.latest_artifact(spark, root, "hipot", "csv") is None


def test_times_keep_their_digits_in_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, datetime(2024, 1, 2, 3, 4, 5, 678901))], "id long, timestamp timestamp_ntz")
    path = writers.write_csv(df, str(tmp_path), "x", AT)
    assert readers.read_csv(spark, path, df.schema).first() == df.first()
