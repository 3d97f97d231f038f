from pyspark.sql import functions as F

from partloom.functions.units import unit_rows
from partloom.operators.units import to_canonical_units, value_milli

SPECS = [("pitch", "mm"), ("port_size", "inch"), ("temp_max", "degC"), ("max_pressure", "bar"), ("torque", "N*m"), ("weight", "g"), ("way_count", None)]


def convert(spark, rows, **kw):
    s = spark.createDataFrame(SPECS, "canonical_key string, canonical_unit string")
    df = spark.createDataFrame(rows, "key string, value string, unit string, raw_text string, canonical_unit string")
    return [r["m"] for r in to_canonical_units(df, s, "key", "value", **kw).select(value_milli(F.col("canonical_value")).alias("m")).collect()]


def test_conversion(spark):
    cases = [
        (("pitch", "177,2 thou", None, "177,2 thou", "x"), 4501), (("pitch", "4.5", None, "Nennweite [mm]: 4.5", "x"), 4500), (("pitch", "0.3543", "mm", "max. 0.3543 inches", "x"), 8999),
        (("port_size", "n/a", None, "port = 1½ Zoll", "x"), 1500), (("port_size", "6,35", None, "max. 6,35CM", "x"), 2500), (("temp_max", None, None, "130 ℃ (stored at -10 ℃)", "x"), 130000),
        (("temp_max", "- 40", "°F", "- 40", "x"), -40000), (("max_pressure", "8.158", None, "pression max [kgf/cm2]: 8.158", "x"), 8000), (("max_pressure", "1", "psi", "1", "x"), 69),
        (("weight", "1,150", "gr.", "1,150", "x"), 1150000), (("torque", "250 Ncm", None, "250 Ncm", "x"), 2500), (("pitch", "0.8", "V~", "0.8 V~", "x"), None), (("pitch", "0.8", "mm", "0.8 V", "x"), None),
        (("pitch", "9", "-", "9", "x"), None), (("pitch", "9", None, "9", "x"), None), (("way_count", "9", "mm", "9 mm", "x"), None), (("nothing", "9", "mm", "9 mm", "x"), None),
        (("pitch", None, "mm", None, "x"), None), (("pitch", "see drawing", "mm", "tbc", "x"), None), ((" Pitch ", "5", "mm", "z" * 100_000, "x"), 5000), (("pitch", "0.75", None, "0.75 cm (2x)", "x"), 7500),
    ]
    rows = [c[0] for c in cases]
    assert convert(spark, rows) == [c[1] for c in cases]
    assert convert(spark, rows + rows) == [c[1] for c in cases] * 2
    assert convert(spark, []) == []


def test_source_default(spark):
    s = spark.createDataFrame(SPECS, "canonical_key string, canonical_unit string")
    df = spark.createDataFrame([("pitch", "2", None, "cm"), ("pitch", "2", "mm", "cm")], "key string, value string, unit string, d string")
    assert [r[0] for r in to_canonical_units(df, s, "key", "value", raw_text=None, source_default="d").select("canonical_value").collect()] == [20.0, 2.0]


def test_alias_table_has_one_meaning_per_spelling():
    names = [r[0] for r in unit_rows()]
    assert len(names) == len(set(names)) < 250
