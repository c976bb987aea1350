"""python -m gaugelab run TEST|all [--root DIR] [--duration S] [--seed N] | list | summary TEST | rows TEST [N] | files."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .functions.scalar import row_count_or
from .operators import stats, views
from .plans import runs
from .plans.specs import SPECS
from .sinks.writers import console_report
from .sources import readers


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="gaugelab")
    p.add_argument("what", choices=("run", "list", "summary", "rows", "files"))
    p.add_argument("test", nargs="?", default="all")
    p.add_argument("n", nargs="?", default="10")
    p.add_argument("--root", default="reports")
    p.add_argument("--duration", type=float, default=10)
    p.add_argument("--seed", type=int, default=0)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("gaugelab").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.what == "run":
        status = runs.batch(spark, a.root, None if a.test == "all" else [a.test], a.duration, a.seed).cache()
        status.show(truncate=False)
        r = stats.success(status).first()
        print(f"{r.n_success} of {r.n_total} runs succeeded ({r.percent:.1f}%)")
        return int(r.n_success != r.n_total)
    if a.what in ("list", "files"):
        files = readers.list_artifacts(spark, a.root)
        (views.artifact_counts(files) if a.what == "list" else views.file_listing(files)).show(1000, truncate=False)
        return 0
    for test in SPECS if a.test == "all" else [a.test]:
        path = readers.latest_artifact(spark, a.root, test, "json" if a.what == "summary" else "csv")
        if path is None:
            print(f"{test}: no results")
        elif a.what == "summary":
            print("\n".join(console_report(readers.read_document(spark, path, test), test)))
        else:
            df = readers.read_report(spark, path, test)
            r = views.shape(df).first()
            print(f"{test}: {r.n_rows} rows, {r.n_columns} columns: {r.columns}")
            views.head_rows(df, row_count_or(a.n)).show(1000, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
