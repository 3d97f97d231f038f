from pyspark.sql import functions as F

from partloom.functions.numbers import parse_number
from partloom.operators.wide import read_bool, read_number, to_wide, typed_cells

SPECS = [("c", "len", "quantity", None), ("c", "col", "enum", ["jet_black", "sky_blue"]), ("c", "ok", "bool", None), ("c", "name", "text", None), ("d", "col", "enum", ["red"])]
COLUMNS = [("col", "string"), ("len", "double"), ("name", "string"), ("ok", "boolean")]


def specs(spark):
    return spark.createDataFrame(SPECS, "scope string, attribute string, value_type string, allowed array<string>")


def wide(spark, rows, **kw):
    df = spark.createDataFrame(rows, "e string, s string, a string, v string, t int, num double, entity string")
    cells = typed_cells(df, F.col("e"), F.col("s"), F.col("a"), F.col("v"), [F.col("t")], specs(spark))
    return {r["entity"]: r for r in to_wide(cells, COLUMNS, **kw).collect()}


def test_numbers(spark):
    cases = {
        "7.5": 7.5, "1 150": 1150.0, "8 000": 8000.0, "1,150": 1150.0, "1,5": 1.5, "1,234,567": 1234567.0, "- 40": -40.0, "−40": -40.0, "1-1/4": 1.25, "2 1/2": 2.5,
        "3/8": 0.375, "1½": 1.5, "¾": 0.75, ".3175": 0.3175, "+80": 80.0, "": None, None: None, "1/0": None, "0,5000": 0.5,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["v"] for r in df.select("t", parse_number(F.col("t")).alias("v")).collect()} == cases


def test_readable_quantities(spark):
    good = ["7.5 mm.", "max. 10 mm", "approx. +80.0 °C", "10 mm typ.", "1 1/2 Zoll", "-30 deg C", "8.158 kgf/cm²", "12", "6.118 kgf/cm2", ' 0.25 "', "115 V~ typ."]
    bad = ["85 to 1155", "120 / 130", "300...630", "drawing 42", "ERROR 7", "see note 3", "four or six", "large", "#REF!", "-", "n/a", "", "-35 to -10", "5-10 mm"]
    df = spark.createDataFrame([(x, True) for x in good] + [(x, False) for x in bad], "t string, ok boolean")
    assert df.where(read_number(F.col("t")).isNotNull() != F.col("ok")).collect() == []


def test_bools(spark):
    df = spark.createDataFrame([("Ja", True), ("oui", True), ("sí", True), ("N", False), ("nein", False), ("0", False), ("2", None), ("maybe", None), (None, None)], "t string, v boolean")
    assert df.where(~read_bool(F.col("t")).eqNullSafe(F.col("v"))).collect() == []


def test_cells_and_rows(spark):
    rows = [
        ("p", "c", "len", "5 mm", 1, 1.0, "x"), ("p", "c", "len", "7", 2, None, "x"), ("p", "c", "len", "n/a", 3, None, "x"), ("p", "c", "len", "7", 2, None, "x"),
        ("p", "c", "col", "Jet-Black ", 1, None, "x"), ("p", "c", "ok", "maybe", 1, None, "x"), ("p", "c", "name", None, 1, None, "x"), ("p", "c", "name", "  ", 1, None, "x"),
        ("q", "d", "col", "jet black", 1, None, "x"), ("q", "d", "len", "5", 1, None, "x"), ("q", "c", "unknown", "5", 1, None, "x"), (None, "c", "len", "5", 1, None, "x"),
        ("r", "c", "name", "y" * 200_000, 1, None, "x"),
    ]
    out = wide(spark, rows)
    assert set(out) == {"p", "q", "r"}
    assert out["p"]["len"] == 7.0 and out["p"]["col"] == "jet_black" and out["p"]["ok"] is None and out["p"]["name"] is None
    assert out["p"]["unread"] == ["ok"] and out["q"]["unread"] == ["col"] and out["q"]["len"] is None
    assert len(out["r"]["name"]) == 200_000 and out["r"]["unread"] == []


def test_empty_and_many_blocks(spark, monkeypatch):
    assert wide(spark, []) == {}
    from partloom.operators import wide as module

    monkeypatch.setattr(module, "BLOCK_CELLS", 7)
    rows = [(f"e{i}", "c", a, v, 1, None, "x") for i in range(60) for a, v in (("len", str(i)), ("ok", "yes"), ("col", "?"))]
    out = wide(spark, rows, buckets=2)
    assert len(out) == 60 and all(out[f"e{i}"]["len"] == i and out[f"e{i}"]["ok"] and out[f"e{i}"]["unread"] == ["col"] for i in range(60))
