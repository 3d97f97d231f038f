import datetime as dt

import pytest
from pyspark.sql import functions as F

from partloom.operators.references import broken_by_period, broken_references

D = lambda d: dt.datetime(2024, 1, d)


def run(spark, refs, target, semantics="simple"):
    r = spark.createDataFrame(refs, "id int, a string, b string, at timestamp_ntz, kind string")
    t = spark.createDataFrame(target, "a string, b string, first timestamp_ntz, row_id int")
    out = broken_references(r, [F.col("a"), F.col("b")], t, [F.col("a"), F.col("b")], F.col("id"), F.col("at"), F.col("first"), semantics)
    return sorted((x["row_id"], x["kind"]) for x in out.collect())


TARGET = [("x", "1", D(5), 0), ("x", "1", D(3), 0), ("y", None, D(1), 0), ("y", "2", None, 0)]
REFS = [(1, "x", "1", D(4), "k"), (2, "x", "1", D(2), "k"), (3, "z", "1", D(9), "k"), (4, None, None, D(9), "k"), (5, "x", None, D(9), "k"), (6, None, "7", D(9), "k"), (7, "y", "2", D(1), "k"), (8, "x", "1", None, "k"), (3, "z", "1", D(9), "k")]


def test_semantics(spark):
    assert run(spark, REFS, TARGET) == [(2, "late"), (3, "missing"), (3, "missing")]
    assert run(spark, REFS, TARGET, "full") == [(2, "late"), (3, "missing"), (3, "missing"), (5, "partly_null"), (6, "partly_null")]
    assert run(spark, REFS, TARGET, "partial") == [(2, "late"), (3, "missing"), (3, "missing"), (6, "missing")]


def test_empty_tables(spark):
    assert run(spark, [], TARGET) == []
    assert run(spark, REFS[:1], []) == [(1, "missing")]
    with pytest.raises(ValueError):
        run(spark, REFS, TARGET, "other")


def test_by_period(spark):
    c = spark.createDataFrame([("t", "f", 1), ("t", "f", 1), ("t", "f", None)], "ref_table string, ref_field string, month int")
    b = spark.createDataFrame([("t", "f", 1, "missing"), ("t", "f", None, "late")], "ref_table string, ref_field string, month int, kind string")
    assert sorted(map(tuple, broken_by_period(c, b).collect()), key=str) == [("t", "f", 1, 2, 1, 0), ("t", "f", None, 1, 0, 1)]
