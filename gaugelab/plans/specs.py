"""What is known of each test type: parameters, limits, units, column mappings. Values in this module are fixed."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Parameter:
    """``lower`` and ``upper`` are capability limits; ``moving_range`` says whether an R chart is drawn."""

    name: str
    unit: str
    lower: float | None = None
    upper: float | None = None
    moving_range: bool = True


@dataclass(frozen=True)
class Rule:
    """One comparison. ``kind``: below, at_most, at_least, above, within (inclusive), near (relative tolerance)."""

    column: str
    kind: str
    low: float
    high: float | None = None


@dataclass(frozen=True)
class TestSpec:
    name: str
    title: str
    parameters: tuple[Parameter, ...]
    rules: tuple[Rule, ...]
    flag: str = "pass_fail"
    rate: str = "pass_rate"
    columns: tuple[str, ...] = ()
    table: str = ""
    measures: tuple[str, ...] = ()
    mapping: dict[str, str] = field(default_factory=dict)
    prefix: str = ""
    group: str | None = None


def _spec(name, title, parameters, rules, table, measures, prefix, columns, **more):
    mapping = {"id": "id", **{m: "value" for m in measures}}
    if name != "burnin":
        mapping |= {"test_time": "timestamp", "result": "result"}
    return TestSpec(name, title, parameters, rules, table=table, measures=measures, prefix=prefix, columns=columns, mapping=mapping, **more)


SPECS: dict[str, TestSpec] = {
    s.name: s
    for s in (
        _spec(
            "burnin", "Burn-in",
            (Parameter("temperature", "°C", None, 90.0), Parameter("voltage", "V", 3.0, 3.6), Parameter("current", "A", 0.3, 0.7)),
            (Rule("temperature", "above", 90.0),), "burnin_zero_current", ("value",), "Burn-in Test",
            ("timestamp", "temperature", "status", "voltage", "current", "failures"), flag="failures", rate="failure_rate",
        ),
        _spec(
            "hipot", "HiPot",
            (Parameter("voltage", "kV", 4.5, 5.5), Parameter("current", "mA", None, 1.0)),
            (Rule("current", "below", 1.0),), "hipot_data", ("voltage", "current"), "HiPot Test", ("timestamp", "voltage", "current", "pass_fail"),
        ),
        _spec(
            "isolation", "Isolation", (Parameter("resistance", "MΩ"),),
            (Rule("resistance", "at_least", 100.0),), "isolation_resistance", ("resistance", "voltage"), "Isolation Test", ("timestamp", "resistance", "pass_fail"),
        ),
        _spec(
            "laser", "Laser", (Parameter("power", "mW", 10.0, 100.0), Parameter("wavelength", "nm", 800.0, 850.0)),
            (Rule("power", "within", 10.0, 100.0), Rule("wavelength", "within", 800.0, 850.0)), "laser_profile", ("power", "wavelength"), "Laser Test",
            ("timestamp", "power", "wavelength", "pass_fail"),
        ),
        _spec(
            "parametric", "Parametric", (Parameter("voltage", "mV"), Parameter("current", "mA", moving_range=False), Parameter("power", "mW", moving_range=False)),
            (Rule("voltage", "within", 3200.0, 3400.0), Rule("current", "within", 450.0, 550.0), Rule("power", "at_most", 2000.0)), "parametric_data", ("voltage", "current"), "Parametric Test",
            ("timestamp", "voltage", "current", "power", "pass_fail"),
        ),
        _spec(
            "ict", "ICT", (Parameter("measured", "", moving_range=False),), (), "ict_data", ("voltage", "current"), "", ("sequence_num", "test_type", "test_point", "resistance", "pass_fail", "value"),
            rate="overall_pass_rate", group="test_type",
        ),
    )
}


@dataclass(frozen=True)
class Family:
    """Points of an in-circuit test: the measured column, its distribution, and the rule that passes it."""

    label: str
    points: tuple[str, ...]
    column: str
    mean: float
    std: float
    rule: Rule
    unit: str


#: Digital points are configured too, but nothing measures them.
FAMILIES: tuple[Family, ...] = (
    Family("continuity", ("TP1", "TP2", "TP3", "TP4", "TP5"), "resistance", 0.5, 0.1, Rule("resistance", "below", 1.0), "Ω"),
    Family("resistor", ("R1", "R2", "R3", "R4"), "value", 1000.0, 50.0, Rule("value", "near", 1000.0, 0.05), "Ω"),
    Family("capacitor", ("C1", "C2", "C3"), "value", 10.0, 0.5, Rule("value", "near", 10.0, 0.10), "μF"),
    Family("power", ("VCC", "GND"), "value", 3.3, 0.033, Rule("value", "near", 3.3, 0.05), "V"),
)
DIGITAL_POINTS = ("D1", "D2", "D3", "D4")

COLUMN_UNITS: dict[tuple[str, str], str] = {(s.name, p.name): p.unit for s in SPECS.values() for p in s.parameters if p.unit}
STATISTIC_UNITS: dict[tuple[str, str], str] = {(s, f"{p}_stats"): u for (s, p), u in COLUMN_UNITS.items()} | {("ict", f"{f.label}_stats"): f.unit for f in FAMILIES}
COLUMN_UNITS |= {("ict", "resistance"): "Ω", ("ict", "value"): "V"} | {k: u for k, u in STATISTIC_UNITS.items() if k[0] == "ict"}


def mapping_for(test_type: str) -> dict[str, str]:
    """Target column -> source column; an unknown test type is mapped as burn-in."""
    return SPECS.get(test_type, SPECS["burnin"]).mapping


def spec_table(spark: SparkSession) -> DataFrame:
    """One row for each parameter of each test type, with its capability limits."""
    rows = [(s.name, p.name, p.unit, p.lower, p.upper, p.moving_range) for s in SPECS.values() for p in s.parameters]
    rows += [("ict", f.label, f.unit, None, None, False) for f in FAMILIES]
    return spark.createDataFrame(rows, "test_name string, parameter string, unit string, lower double, upper double, moving_range boolean")
