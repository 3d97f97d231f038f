import random

import pytest
from pyspark.sql import functions as F

from partloom.llm.mapping import match_names, normalise_name
from partloom.llm.splits import assign_split, components, related_groups, split_leaks

NAMES = [(1, "Flestoumb Electric", []), (2, "Flestoumb Terminals", ["FLTE"]), (3, "Nimerk Armaturen", []), (4, "Foquäpos", None), (5, "Yobiark Electric", []), (6, "Joupys Electric", []), (7, "Plistav Terminals", []), (8, "Jeigor Terminals", []), (9, "Brepirk Armaturen", []), (10, "Leweflult Armaturen", [])]


def match(spark, values, names=NAMES):
    v = spark.createDataFrame([(x,) for x in values], "m string")
    e = spark.createDataFrame(names, "id int, name string, aliases array<string>")
    return {r["value"]: r["entry_id"] for r in match_names(v, "m", e, "id", "name", "aliases").collect()}


def test_normal_forms(spark):
    cases = {
        "9225 - Nimerk Armaturen GmbH & Co. KG": "nimerk armaturen", "NimerkArmaturen[active]": "nimerk armaturen", " Armaturen,  Nimerk (OEM)*": "armaturen nimerk", "Niмеrk_Аrmaturen_-_DE": "nimerk armaturen",
        "F.L.T.E.": "flte", "Foquäpos S.p.A.": "foquapos", "N1merk": "nlmerk", "Yobiark Elec.": "yobiark elec", "": "", None: None, "[active]": "",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["f"] for r in df.select("t", normalise_name(F.col("t")).alias("f")).collect()} == cases


def test_matches(spark):
    cases = {
        "FLESTOUMB ELECTRIC": 1, "Flestoumb Term. Ltd": 2, "Flestuomb Electric": 1, "Flestoumb": None, "F.L.T.E.": 2, "FLTX": None, "nimerk": 3, "Nmierk Armaturen": 3, "nimerkarmaturen": 3,
        "Foquapos": 4, "Grideiloul Armaturen": None, "n/a": None, "": None, "unknown": None, "x" * 20_000: None,
    }
    assert match(spark, [*cases, "nimerk", None]) == cases
    assert match(spark, []) == {} and match(spark, ["Nimerk"], []) == {"Nimerk": None}


def test_components_against_union_find(spark):
    rng = random.Random(2)
    edges = [(f"n{rng.randint(0, 400):03}", f"n{rng.randint(0, 400):03}") for _ in range(330)] + [(f"p{i:03}", f"p{i + 1:03}") for i in range(60)] + [("hub", f"h{i}") for i in range(200)] + [(None, "x"), ("y", "y")]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    want = {n: find(n) for n in list(parent)}
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges + edges, "u string, v string")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "u string, v string")).collect() == []


def test_groups_leaks_and_splits(spark):
    links = spark.createDataFrame([("A", "F"), ("B", "F"), ("B", "G"), ("C", "G"), ("D", None), ("A", "F")], "part string, family string")
    labels = spark.createDataFrame([("A", "dev"), ("C", "test"), ("D", "dev"), ("D", "test"), ("E", "dev"), ("E", None), (None, "dev"), ("B", None)], "part string, split string")
    g = related_groups(labels, "part", links, "part", "family")
    ids = {r["record"]: r["group_id"] for r in g.collect()}
    assert set(ids) == {"A", "B", "C", "D", "E"} and ids["A"] == ids["B"] == ids["C"] and len({ids["A"], ids["D"], ids["E"]}) == 3
    assert sorted(r["record"] for r in split_leaks(g, labels, "part", "split").collect()) == ["A", "B", "C", "D"]


def test_proportions(spark):
    parts = {"dev": 0.4, "calibration": 0.3, "test": 0.3}
    rows = spark.range(20_000).select(assign_split(F.col("id").cast("string"), parts).alias("s")).groupBy("s").count().collect()
    assert all(abs(r["count"] / 20_000 - parts[r["s"]]) < 0.02 for r in rows) and len(rows) == 3
    with pytest.raises(ValueError):
        assign_split(F.lit("x"), {"a": 0.5})


def test_short_forms_come_from_the_list(spark):
    """Another list with other general words than those of the test tables."""
    from pyspark.sql import functions as F

    from partloom.llm.mapping import match_names, name_words, short_forms

    makers = ["Norvik", "Ostrand", "Belmara", "Tarquist", "Zephora", "Quillon"]
    general = ["Brewery", "Shipyards", "Foundries"]
    entries = [(i + 1, f"{m} {general[i % 3]} Ltd.") for i, m in enumerate(makers * 2)]
    entries = [(i, n if i <= 6 else n.replace(" Ltd.", "").replace(makers[(i - 1) % 6], makers[(i - 1) % 6][::-1].capitalize())) for i, n in entries]
    table = spark.createDataFrame(entries, "i int, n string")
    known = name_words(table, "n")
    words = spark.createDataFrame([("brew",), ("brwry",), ("shpyds",), ("fndrs",), ("norvik",), ("xyz",), ("b",)], "w string")
    assert {r["w"]: r["full"] for r in short_forms(words, known).collect()} == {"brew": "brewery", "brwry": "brewery", "shpyds": "shipyards", "fndrs": "foundries"}
    typed = ["Norvik Brew. GmbH", "OSTRAND SHPYDS", "belmara fndrs", "Norvik", "Brewery", None, "completely else"]
    got = {r["value"]: r["entry_id"] for r in match_names(spark.createDataFrame([(t,) for t in typed], "v string"), "v", table, "i", "n").collect()}
    assert got == {"Norvik Brew. GmbH": 1, "OSTRAND SHPYDS": 2, "belmara fndrs": 3, "Norvik": 1, "Brewery": None, "completely else": None}
    assert match_names(spark.createDataFrame([("Norvik",)], "v string"), "v", table.where(F.lit(False)), "i", "n").select("entry_id").collect()[0][0] is None
