"""Column mapping, defaults, casts and entity rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import schemas
from ..plans.specs import SPECS, mapping_for


def normalize(df: DataFrame, test_type: str = "burnin", now: datetime | None = None) -> DataFrame:
    """Each target that has its source becomes a copy of it; other columns stay. ``test_time`` defaults to ``now`` (one value for the frame), ``result`` to PASS."""
    mapping = mapping_for(test_type)
    out = df.withColumns({t: F.col(s) for t, s in mapping.items() if s in df.columns})
    if "test_time" in mapping and "test_time" not in out.columns:
        out = out.withColumn("test_time", F.lit(now).cast("timestamp_ntz") if now else F.current_timestamp().cast("timestamp_ntz"))
    if "result" in mapping and "result" not in out.columns:
        out = out.withColumn("result", F.lit("PASS"))
    return out


def entities(df: DataFrame, test_type: str, legacy_float_id: bool = False) -> DataFrame:
    """Normalized rows -> rows of the test type's table, with a description. ``legacy_float_id`` writes burn-in ids as 1.0."""
    spec = SPECS[test_type]
    ident = F.col("id").cast("long")
    shown = F.format_string("%.1f", ident.cast("double")) if legacy_float_id and test_type == "burnin" else ident.cast("string")
    text = F.lit("Sample ICT data") if test_type == "ict" else F.concat(F.lit(spec.prefix + " "), shown)
    cols = [ident.alias("id"), *[F.col(m).cast("double").alias(m) for m in spec.measures]]
    if test_type != "burnin":
        cols += [F.col("test_time").cast("timestamp_ntz").alias("test_time"), F.col("result").cast("string").alias("result")]
    return df.select(*cols, text.alias("description"))


class IntegrityError(ValueError):
    """Rows that a table can't take."""


def guarded(df: DataFrame, test_type: str, existing: DataFrame | None = None) -> DataFrame:
    """``df`` if its ids are unique, also against ``existing``, and its required columns have no nulls; an aggregate over the rows decides on nulls and one over the ids on repeats."""
    required = [f.name for f in schemas.table(test_type).fields if not f.nullable]
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required]).first().asDict()
    if bad := [c for c, n in nulls.items() if n]:
        raise IntegrityError(f"{test_type}: nulls in {', '.join(bad)}")
    ids = df.select("id") if existing is None else df.select("id").unionAll(existing.select("id").join(df.select("id").distinct(), "id", "left_semi"))
    twice = ids.groupBy("id").count().where("count > 1").limit(5).collect()
    if twice:
        raise IntegrityError(f"{test_type}: repeated ids, as {', '.join(str(r['id']) for r in twice)}")
    return df


def numeric_columns(df: DataFrame, without: tuple[str, ...] = ("timestamp", "sequence_num", "sample_idx"), first: int | None = None) -> list[str]:
    """Numeric columns in the order of the schema (booleans aren't), at most ``first``."""
    from pyspark.sql.types import NumericType

    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in without][:first]


def x_axis(df: DataFrame) -> str:
    """The column that orders a chart: timestamp, else sequence_num, else the row's index."""
    return next((c for c in ("timestamp", "sequence_num", "sample_idx") if c in df.columns), "sample_idx")
