"""Types of tables, reports and artifacts."""

from __future__ import annotations

from pyspark.sql import types as T

from .specs import SPECS

L, D, S, I, B, N = T.LongType(), T.DoubleType(), T.StringType(), T.IntegerType(), T.BooleanType(), T.TimestampNTZType()


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(*f) for f in fields])


RAW = _struct(("id", L), ("value", D))


def table(test_type: str) -> T.StructType:
    """The normalized table. Nullable fields are descriptions alone (burn-in's isn't)."""
    if test_type == "burnin":
        return _struct(("id", L, False), ("value", D, False), ("description", S, False))
    a, b = SPECS[test_type].measures
    return _struct(("id", L, False), (a, D, False), (b, D, False), ("test_time", N, False), ("result", S, False), ("description", S))


REPORT: dict[str, T.StructType] = {
    "burnin": _struct(("timestamp", N), ("temperature", D), ("status", I), ("voltage", D), ("current", D), ("failures", I)),
    "hipot": _struct(("timestamp", N), ("voltage", D), ("current", D), ("pass_fail", I)),
    "isolation": _struct(("timestamp", N), ("resistance", D), ("pass_fail", I)),
    "laser": _struct(("timestamp", N), ("power", D), ("wavelength", D), ("pass_fail", I)),
    "parametric": _struct(("timestamp", N), ("voltage", D), ("current", D), ("power", D), ("pass_fail", I)),
    "ict": _struct(("sequence_num", L), ("test_type", S), ("test_point", S), ("resistance", D), ("pass_fail", B), ("value", D)),
}

_STATS = _struct(("mean", D), ("std", D), ("min", D), ("max", D))
_CAPABILITY = _struct(("cp", D), ("cpk", D))


def document(test_type: str) -> T.StructType:
    """The result document of a run."""
    s = SPECS[test_type]
    if s.group:
        each = _struct(("pass_rate", D), ("mean", D), ("std", D), ("min", D), ("max", D))
        return _struct((s.rate, D), (f"{s.group}_stats", T.MapType(S, each)), ("timestamp", S))
    limits = [p for p in s.parameters if p.upper is not None]
    return _struct((s.rate, D), *[(f"{p.name}_stats", _STATS) for p in s.parameters], *[(f"{p.name}_capability", _CAPABILITY) for p in limits], ("timestamp", S))


ARTIFACTS = _struct(("path", S), ("modified", T.TimestampType()), ("length", L), ("test_name", S), ("kind", S))
