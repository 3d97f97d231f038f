"""Units of measure: alias table, dimensions and linear conversion (factor and offset to an SI-like base)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Per unit its dimension, the factor and offset to the base unit of the dimension
# (base = value * factor + offset) and its spellings.
UNITS = [
    ("mm", "length", 0.001, 0.0, ["mm", "mm.", "MM", "millimeter", "millimetre", "millimeters", "millimetres", "Millimeter"]),
    ("cm", "length", 0.01, 0.0, ["cm", "cm.", "CM", "centimeter", "centimetre", "Zentimeter"]),
    ("m", "length", 1.0, 0.0, ["m", "meter", "metre", "Meter"]),
    ("um", "length", 1e-6, 0.0, ["um", "µm", "μm", "micron", "microns", "micrometer"]),
    ("inch", "length", 0.0254, 0.0, ["in", "in.", "IN", "inch", "inches", "Inch", "INCH", '"', "''", "″", "”", "Zoll", "pouce", "pouces"]),
    ("mil", "length", 2.54e-5, 0.0, ["mil", "mils", "thou"]),
    ("ft", "length", 0.3048, 0.0, ["ft", "ft.", "foot", "feet"]),
    ("A", "current", 1.0, 0.0, ["A", "amp", "amps", "Amp", "Amps", "ampere", "amperes", "Ampere"]),
    ("mA", "current", 0.001, 0.0, ["mA", "milliamp", "milliamps", "milliampere"]),
    ("V", "potential", 1.0, 0.0, ["V", "volt", "volts", "Volt", "Volts", "VAC", "VDC", "V~", "V=", "V AC", "V DC"]),
    ("mV", "potential", 0.001, 0.0, ["mV", "millivolt", "millivolts"]),
    ("kV", "potential", 1000.0, 0.0, ["kV", "KV", "kilovolt", "kilovolts"]),
    ("degC", "temperature", 1.0, 273.15, ["degC", "deg C", "°C", "° C", "℃", "C", "celsius", "Celsius"]),
    ("degF", "temperature", 5.0 / 9.0, 459.67 * 5.0 / 9.0, ["degF", "deg F", "°F", "° F", "℉", "F", "fahrenheit", "Fahrenheit"]),
    ("K", "temperature", 1.0, 0.0, ["K", "kelvin", "Kelvin"]),
    ("ohm", "resistance", 1.0, 0.0, ["ohm", "Ohm", "ohms", "Ohms", "Ω", "Ω"]),
    ("milliohm", "resistance", 0.001, 0.0, ["milliohm", "milliohms", "mOhm", "mohm", "mΩ", "mΩ"]),
    ("uohm", "resistance", 1e-6, 0.0, ["uOhm", "uohm", "µΩ", "μΩ", "µΩ", "microohm"]),
    ("bar", "pressure", 1e5, 0.0, ["bar", "BAR", "Bar"]),
    ("mbar", "pressure", 100.0, 0.0, ["mbar"]),
    ("Pa", "pressure", 1.0, 0.0, ["Pa"]),
    ("kPa", "pressure", 1000.0, 0.0, ["kPa", "KPA", "kpa"]),
    ("MPa", "pressure", 1e6, 0.0, ["MPa", "MPA"]),
    ("psi", "pressure", 6894.757, 0.0, ["psi", "PSI", "lb/in²", "lb/in2", "lbf/in²"]),
    ("kgf/cm2", "pressure", 98066.5, 0.0, ["kgf/cm²", "kgf/cm2", "kg/cm²", "kg/cm2"]),
    ("W", "power", 1.0, 0.0, ["W", "watt", "watts", "Watt", "Watts"]),
    ("mW", "power", 0.001, 0.0, ["mW", "milliwatt"]),
    ("kW", "power", 1000.0, 0.0, ["kW", "KW", "kilowatt"]),
    ("ms", "duration", 0.001, 0.0, ["ms", "msec", "millisecond", "milliseconds"]),
    ("s", "duration", 1.0, 0.0, ["s", "sec", "secs", "second", "seconds"]),
    ("us", "duration", 1e-6, 0.0, ["us", "µs", "μs", "usec"]),
    ("min", "duration", 60.0, 0.0, ["minute", "minutes"]),
    ("g", "mass", 0.001, 0.0, ["g", "gr", "gr.", "gram", "grams", "Gramm"]),
    ("kg", "mass", 1.0, 0.0, ["kg", "KG", "Kg", "kilogram"]),
    ("mg", "mass", 1e-6, 0.0, ["mg"]),
    ("oz", "mass", 0.028349523125, 0.0, ["oz", "oz.", "ounce", "ounces"]),
    ("lb", "mass", 0.45359237, 0.0, ["lb", "lbs", "lb.", "lbs.", "pound", "pounds"]),
    ("N*m", "torque", 1.0, 0.0, ["N*m", "Nm", "N·m", "N⋅m", "N m"]),
    ("N*cm", "torque", 0.01, 0.0, ["N*cm", "Ncm", "N·cm", "N⋅cm"]),
    ("lbf*in", "torque", 0.112984829, 0.0, ["lbf·in", "lbf*in", "lbf.in", "in-lb", "in.lb", "in·lb", "in-lbs", "in lb"]),
]

#: A unit as it stands in text: the spellings with a blank, digit, point or slash inside first, then any run of other signs.
UNIT_TOKEN = r"deg [CF]|° [CF]|V [AD]C|kgf?/cm[2²]|lbf?/in[2²]|N m\b|in lb|in\.lb|[^\s\d\[\](){},;:=+/]+"


def unit_rows() -> list[tuple[str, str, str, float, float]]:
    """(alias, unit, dimension, factor, offset), one row per spelling."""
    return [(a, u, d, f, o) for u, d, f, o, names in UNITS for a in names]


def unit_table(spark: SparkSession) -> DataFrame:
    """The alias table; its size is fixed by ``UNITS`` (under 200 rows), so it may always be broadcast."""
    return spark.createDataFrame(unit_rows(), "alias string, unit string, dimension string, factor double, offset double")


def unit_alias(token: Column) -> Column:
    """A unit token as it is looked up: trimmed, blank is null."""
    t = F.trim(token)
    return F.when(t != "", t)


def join_unit(df: DataFrame, token: str, units: DataFrame, prefix: str) -> DataFrame:
    """Left join of the alias table on the column ``token``; adds ``{prefix}_dim``, ``{prefix}_factor``, ``{prefix}_offset``."""
    u = units.select(
        F.col("alias").alias(f"{prefix}_alias"),
        F.col("dimension").alias(f"{prefix}_dim"),
        F.col("factor").alias(f"{prefix}_factor"),
        F.col("offset").alias(f"{prefix}_offset"),
    )
    return df.join(F.broadcast(u), F.col(token) == F.col(f"{prefix}_alias"), "left").drop(f"{prefix}_alias")
