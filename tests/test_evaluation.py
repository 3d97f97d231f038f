from collections import defaultdict

from pyspark.sql import functions as F

from partloom.operators import decoder as D
from partloom.operators import store as S
from partloom.operators import validate as V
from partloom.sources.tables import spread


def test_decoder_against_brute_force(spark):
    rows = [("m", f"AB{w}X{c}", k, v) for w in (2, 4, 8) for c in (1, 2) for k, v in (("ways", str(w)), ("colour", "red" if c == 1 else "blue"), ("mixed", str(w * c)))]
    rows += [("m", "AB2X1", "ways", "2"), (None, "ZZ1", "ways", "1"), ("m", None, "ways", "1"), ("m", "AB2X1", None, "x"), ("m", "AB9X1", "ways", None)]
    df = spark.createDataFrame(rows, "maker string, part string, key string, value string").withColumn("family", F.lit("clash"))
    got = {(r["idx"], r["key"], r["segment"]): r["value"] for r in D.fit_decoder(df, "part", "maker", "key", "value").collect()}
    seen, want = defaultdict(set), {}
    import re

    for m, p, k, v in rows:
        if m and p and k and v:
            for i, s in enumerate(re.findall("[0-9]+|[A-Z]+", p)):
                seen[i, k, s].add(v)
    for i, k in {(i, k) for i, k, _ in seen}:
        mine = {s: vs for (a, b, s), vs in seen.items() if (a, b) == (i, k)}
        clear = {s: vs for s, vs in mine.items() if len(vs) == 1}
        if len(mine) >= 2 and len(clear) / len(mine) >= 0.9:
            want |= {(i, k, s): next(iter(vs)) for s, vs in clear.items()}
    assert got == want and got[1, "ways", "8"] == "8" and (1, "mixed", "2") not in got
    rules = D.fit_decoder(df, "part", "maker", "key", "value")
    new = spark.createDataFrame([("i", "ab-8-x-1", "m"), ("j", "QQ8X1", "m"), ("k", None, None)], "item string, part string, maker string")
    assert sorted((r["item"], r["key"], r["value"]) for r in D.decode(new, "item", "part", "maker", rules).collect()) == [("i", "colour", "red"), ("i", "ways", "8")]
    assert D.fit_decoder(df.limit(0), "part", "maker", "key", "value").collect() == []


def test_lookups_and_messages(spark):
    wide = spark.createDataFrame([("p", "c150", 350.0), ("q", "c300", 350.0), ("r", "zz", 900.0), ("s", None, None)], "e string, cls string, pressure double")
    rules = [{"id": "ceiling", "expr": "pressure <= top", "message": "{pressure} is above {cls}"}]
    x = V.with_lookups(wide, {"top": ("cls", {"c150": 300.0, "c300": 600.0}), "none": ("absent", {"a": 1.0})})
    assert sorted(map(tuple, V.rule_messages(x, "e", rules).collect())) == [("p", "ceiling", "350 is above c150")]
    assert V.rule_messages(wide, "e", rules).collect() == []  # the lookup is not there, so the rule is not evaluated


def test_values_follow_from_what_they_cite(spark):
    df = spark.createDataFrame([(1, "llm", "5", "5", "6"), (2, "llm", "5", "6", "5"), (3, "llm", "5", "6", None), (4, "table", "5", "6", "6"), (5, "llm", None, None, None)], "id int, tier string, v string, a string, b string")
    kept = df.where(V.supported_by(F.col("tier"), F.col("v"), [F.col("a"), F.col("b")], lambda x, y: x == y))
    assert sorted(r["id"] for r in kept.collect()) == [1, 2, 4]


def test_dimension_and_map_rows(spark):
    old = spark.createDataFrame([("s1", 1, "u"), ("s2", None, "v")], "id string, rank int, uri string")
    new = spark.createDataFrame([("s1", None, "w"), ("s3", 3, None)], "id string, rank int, uri string")
    assert sorted(map(tuple, S.coalesce_dimension(old, new, "id").collect())) == [("s1", 1, "w"), ("s2", None, "v"), ("s3", 3, None)]
    assert sorted(map(tuple, S.coalesce_dimension(old, old.limit(0), "id").collect())) == sorted(map(tuple, old.collect()))
    m = spark.createDataFrame([("p", {"a": "1", "b": None}), ("q", {}), ("r", None)], "id string, m map<string,string>")
    assert sorted(map(tuple, S.map_rows(m, "id", "m").collect())) == [("p", "a", "1"), ("p", "b", None)]


def test_contained_parts(spark, tmp_path):
    from partloom.plans.evaluation_queries import QUERIES

    rows = [("AB-12",), ("X AB12 9",), ("AB12",), ("B1",), (None,), ("",)]
    spark.createDataFrame(rows, "mpn string").write.parquet(f"{tmp_path}/products.parquet")
    assert [tuple(r) for r in QUERIES["contained_parts"](spark, str(tmp_path)).collect()] == [("AB12", "XAB129")]


def test_spread(spark):
    assert spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(spark.range(0, 10, 1, 9)).rdd.getNumPartitions() == 9
