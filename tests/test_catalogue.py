import math
import random
import re
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from partloom.functions.text import mpn_variants, percent_bucket
from partloom.operators import adjudicate as A
from partloom.operators import commerce as M
from partloom.operators import confidence as C
from partloom.operators import extract as E
from partloom.operators import retrieval as R
from partloom.operators import store as S
from partloom.operators import validate as V
from partloom.operators.verify import identifier_codes


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_whole_identifiers(spark):
    cases = {
        "Part 154630200-3RT here": True, "Part 154630200-3": False, "154630200 3RT": True, "154630200_3RT.": True, "1546302003RT": True, "154630200-3RT-GV": False, "X-154630200-3RT": False,
        "X 154630200-3RT": True, "154630200-3RTX": False, None: False, "": False, "--154630200 / 3RT": True, "154630200;3RT": False,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r["t"]: r["x"] for r in df.select("t", F.array_contains(identifier_codes(F.col("t"), 3, 20), "1546302003RT").alias("x")).collect()}
    assert got == cases


def test_identifiers_of_many_pieces(spark):
    cases = {"Part A-1-B-2-C-3-D 4 here": True, "1.5.4.6.3.0": False, "A 1 B 2 C 3 D 4": True, "A-1-B-2-C-3-D-4-E": False, "A-1-B;2-C-3-D-4": False, "": False, None: False}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r["t"]: r["x"] for r in df.select("t", F.array_contains(identifier_codes(F.col("t"), 3, 8), "A1B2C3D4").alias("x")).collect()}
    assert got == cases and one(spark, F.size(identifier_codes(F.lit("A-1"), 1, 0))) == 0


def test_text_functions(spark):
    assert one(spark, mpn_variants(F.lit("ab-1 2"))) == ["AB 1 2", "AB-1 2", "AB-1-2", "AB.1.2", "AB12", "AB_1_2"]
    import hashlib

    for x in ("A", "KX-12", ""):
        assert one(spark, percent_bucket(F.lit(x), "split:")) == int(hashlib.sha256(f"split:{x}".encode()).hexdigest(), 16) % 100


def test_rows_outside_ascii_are_hashed_and_counted(spark, tmp_path):
    import hashlib

    from partloom.plans.catalogue_queries import QUERIES

    texts = ["plain", "Größe 5 °C", "a\tb", "\u00a0 Привет\u3000", "継手", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["content_hash"], r["loose_hash"]) for r in QUERIES["content_hash"](spark, str(tmp_path)).collect()}
    assert got == {i: (hashlib.sha256(t.encode()).hexdigest(), hashlib.md5(t.strip(" \u00a0\u3000").lower().encode()).hexdigest()) for i, t in enumerate(texts) if t is not None}
    values = [("k", "Cast Iron"), ("k", "cast-iron\u00ae"), ("k", "\u00a0CAST IRON"), ("k", "Größe"), ("k", None)]
    spark.createDataFrame(values, "canonical_key string, value_text string").write.parquet(f"{tmp_path}/provenance.parquet")
    assert {r["value"]: r["n"] for r in QUERIES["categorical_values"](spark, str(tmp_path)).collect()} == {"cast_iron": 3, "gre": 1}


def test_adjudication(spark):
    rows = [  # group, key, item, source, authority, locator, tier
        ("single", "c:a", 1, "s1", 3, "prose", "rule"), ("single", "c:a", 1, "s1", 3, "prose", "rule"),
        ("clear", "c:a", 2, "s1", 1, "table_cell", "table"), ("clear", "c:b", 3, "s2", 5, "prose", "rule"), ("clear", None, 9, "s2", 1, "table_cell", "table"),
        ("close", "c:a", 4, "s1", 2, "prose", "rule"), ("close", "c:b", 5, "s2", 2, "prose", "rule"), ("close", "c:b", 6, "s3", 3, "prose", "rule"),
        ("conflict", "c:a", 7, "s1", 1, "table_cell", "table"), ("conflict", "c:b", 8, "s2", 1, "prose", "rule"),
    ]
    df = spark.createDataFrame(rows, "g string, vkey string, item int, src string, auth int, loc string, tier string")
    won = A.adjudicate(df, ["g"], "vkey", "item", "src", "auth", "loc", "tier")
    got = {r["g"]: r for r in won.collect()}
    assert {g: (r["winner"], r["conflict"], r["close_call"], r["n_values"]) for g, r in got.items()} == {"single": (1, False, False, 1), "clear": (2, False, False, 2), "close": (5, False, True, 2), "conflict": (None, True, False, 2)}
    assert abs(got["clear"]["top_score"] - (0.4 + 0.35 + 0.1 + 0.05)) < 1e-9
    assert sorted((r["g"], r["item"]) for r in A.rejected(df, won, ["g"], "vkey").collect()) == [("clear", 3), ("close", 4), ("conflict", 7), ("conflict", 8)]
    assert A.adjudicate(df.limit(0), ["g"], "vkey", "item", "src", "auth", "loc", "tier").collect() == []


def test_rules(spark):
    wide = spark.createDataFrame([("p", 1.0, 2.0, "x"), ("q", 3.0, 2.0, "o'k"), ("r", None, 2.0, "x")], "e string, a double, b double, t string")
    rules = [{"id": "r1", "expr": "a < b"}, {"id": "r2", "expr": "a > 0 or b > 0"}, {"id": "r3", "when": "b == 2", "expr": "t in ['x', 'y']", "severity": "warn"}, {"id": "r4", "expr": "missing > 1"}]
    got = {(r["e"], r["rule_id"], r["key"]): r["passed"] for r in V.apply_rules(wide, "e", rules).collect()}
    assert got == {
        ("p", "r1", "a"): True, ("p", "r1", "b"): True, ("q", "r1", "a"): False, ("q", "r1", "b"): False, ("p", "r2", "a"): True, ("p", "r2", "b"): True, ("q", "r2", "a"): True, ("q", "r2", "b"): True,
        ("p", "r3", "t"): True, ("q", "r3", "t"): False, ("r", "r3", "t"): True,
    }
    assert V.compile_rule("t == \"o'k\"")[0] == "(`t` = 'o\\'k')"
    for bad in ("__import__('os')", "a.b > 1", "a <", "[x for x in a]", "f(a) > 1"):
        with pytest.raises(V.RuleError):
            V.compile_rule(bad)


def test_family_outliers(spark):
    rng = random.Random(1)
    rows = [(f"f{i % 4}", "k", i, rng.choice([1.0, 2.0, 2.5, 90.0, None])) for i in range(60)] + [("same", "k", 100 + i, 5.0) for i in range(7)] + [("same", "k", 200, 6.0)] + [("few", "k", 300 + i, 1.0) for i in range(5)]
    rows += [(f"n{n}", "k", 1000 * n + i, rng.choice([1.0, 2.0, 2.5, 3.25, 7.0, 90.0, rng.random()])) for n in (6, 7, 8, 9, 30, 31) for i in range(n)]
    rows += [("big", "k", 100_000 + i, rng.choice([1.0, 2.0, rng.random()])) for i in range(5000)]  # a family of any size
    df = spark.createDataFrame(rows, "f string, k string, m int, v double")
    got = {r["member"]: r for r in V.family_outliers(df, "f", "k", "m", "v").collect()}
    known = {m: (f, v) for f, _, m, v in rows if v is not None}
    assert set(got) == {m for m, (f, _) in known.items() if f != "few"}
    assert not got[200]["coherent"] and got[100]["coherent"]
    members = {}
    for m, (f, v) in known.items():
        members.setdefault(f, {})[m] = v
    for m, r in got.items():
        if m >= 100_000 and m % 97:
            continue  # brute force is quadratic
        others = [v for x, v in members[known[m][0]].items() if x != m]
        med = statistics.median(others)
        assert math.isclose(r["median"], med, abs_tol=1e-6) and math.isclose(r["mad"], statistics.median(abs(v - med) for v in others), abs_tol=2e-6)


def test_strangers_and_gaps(spark):
    rows = [("f", i, "k", "a" if i else "b") for i in range(7)] + [("f", i, "j", "x") for i in range(6)] + [("g", 9, "k", "z")]
    df = spark.createDataFrame(rows, "f string, m int, k string, v string")
    assert [(r["member"], r["n_peers"]) for r in V.family_strangers(df, "f", "k", "m", "v").collect()] == [(0, 6)]
    assert [(r["m"], r["k"]) for r in V.coverage_gaps(df.select("f", "m"), df, "f", "m", "k").collect()] == [(6, "j")]


def test_spans(spark):
    df = spark.createDataFrame([(1, "c1", "5 mm"), (2, "c1", "6 mm"), (3, "zz", "5 mm"), (4, "c1", ""), (5, None, "x"), (6, "c1", None)], "id int, c string, span string")
    chunks = spark.createDataFrame([("c1", "pitch 5 mm"), (None, "x")], "c string, text string")
    assert sorted(r["id"] for r in V.span_present(df, chunks, F.col("c"), F.col("c"), "span", "text").where("span_present").collect()) == [1]


def test_confidence(spark):
    df = spark.createDataFrame([(0.05, True), (1.0, True), (0.95, False), (0.95, True), (None, True), (0.5, None), (0.3, False)], "c double, ok boolean")
    bins = {r["bin"]: (r["n"], r["mean_confidence"], r["observed_accuracy"]) for r in C.reliability(df, "c", "ok").collect()}
    assert bins == {0: (1, 0.05, 1.0), 9: (3, 0.9667, 0.6667), 3: (1, 0.3, 0.0)}
    assert C.calibration_error(C.reliability(df, "c", "ok")).first()["ece"] == round((0.95 + 3 * 0.3 + 0.3) / 5, 4)
    curve = {r["threshold"]: (r["n"], r["precision"]) for r in C.abstention_curve(df, "c", "ok").collect()}
    assert len(curve) == 21 and curve[0.0] == (5, 0.6) and curve[0.95] == (3, 0.6667) and curve[1.0] == (1, 1.0)
    assert {r["n"] for r in C.abstention_curve(df.limit(0), "c", "ok").collect()} == {0}


def test_calibrator_against_gradient(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=400)
    y = rng.random(400) < 1 / (1 + np.exp(-(1.5 * x - 0.4)))
    rows = [("g", float(a), bool(b)) for a, b in zip(x, y)] + [("few", 1.0, True)] * 5
    df = spark.createDataFrame(rows, "g string, f double, ok boolean")
    model = C.fit_calibrator(df, "g", ["f"], "ok")
    m = {r["g"]: r for r in model.collect()}
    w, b = m["g"]["weights"][0], m["g"]["intercept"]
    p = 1 / (1 + np.exp(-(w * x + b)))
    assert abs(((p - y) * x).mean() + w / 400) < 1e-4 and abs((p - y).mean()) < 1e-4
    assert m["few"]["weights"] is None and m["few"]["base_rate"] == 1.0
    new = spark.createDataFrame([("g", 0.0), ("few", 0.0), ("other", 0.0)], "g string, f double")
    got = {r["g"]: r["probability"] for r in C.predict(new, model, "g", ["f"]).collect()}
    assert abs(got["g"] - 1 / (1 + math.exp(-b))) < 1e-9 and got["few"] == 1.0 and got["other"] == 0.5


def test_bm25_and_fusion(spark):
    docs = [(1, "red valve 12 bar"), (2, "red red gland"), (3, None), (4, ""), (5, "blue valve valve 12"), (6, "a long text about other things")]
    d = spark.createDataFrame(docs, "id int, t string")
    q = spark.createDataFrame([(10, "red valve valve"), (11, None), (12, "nothing here")], "q int, t string")
    got = {(r["query_id"], r["doc_id"]): (r["score"], r["rank"]) for r in R.bm25_topk(d, "id", "t", q, "q", "t").collect()}
    toks = {i: (t or "").split() for i, t in docs}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    df = {w: sum(w in t for t in toks.values()) for t in toks.values() for w in t}
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    low = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else low for w, v in idf.items()}
    score = lambda i, words: sum(idf[w] * toks[i].count(w) * 2.5 / (toks[i].count(w) + 1.5 * (0.25 + 0.75 * len(toks[i]) / avg)) for w in words if w in toks[i])
    assert set(got) == {(10, 1), (10, 2), (10, 5)}
    assert all(math.isclose(s, score(i, ["red", "valve", "valve"]), abs_tol=1e-5) for (_, i), (s, _) in got.items())
    a = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "query_id int, doc_id int, rank int")
    b = spark.createDataFrame([(1, 6, 1)], "query_id int, doc_id int, rank int")
    assert [(r["doc_id"], r["rank"]) for r in R.reciprocal_rank_fusion([(a, 0.7), (b, 0.3)]).orderBy("rank").collect()] == [(6, 1), (5, 2)]


def test_gram_topk_over_all_documents(spark, tmp_path):
    from partloom.plans.catalogue_queries import QUERIES

    assert dict(R.char_grams("Ab A ab")) == {" ab": 2, "ab ": 2, " ab ": 2, " a ": 1}
    docs = [(1, "red valve 12 bar"), (2, "red red gland"), (3, None), (4, ""), (5, "blue valves 12"), (6, "a long text about other things"), (7, "KX-1207 pump")]
    asked = [(100, "red valve", "M1"), (200, None, "KX-1207"), (300, "gland valveX", "M3"), (400, "zzz", None)]
    d = spark.createDataFrame(docs, "doc_id int, text string")
    q = spark.createDataFrame(asked, "sku_id int, description_fragment string, mpn string")
    grams = {i: R.char_grams(t) for i, t in docs}
    idf = {g: math.log(8 / (1 + sum(g in x for x in grams.values()))) + 1 for x in grams.values() for g in x}
    vec = lambda c: {g: n * idf[g] for g, n in c.items() if g in idf}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    want = {}
    for s, t, m in asked:
        a = vec(R.char_grams(t or m))
        for i, x in grams.items():
            b = vec(x)
            if set(a) & set(b):
                want[s, i] = round(sum(a[g] * b[g] for g in a if g in b) / norm(a) / norm(b), 5)
    for block in (512, 2):
        got = {(r["query_id"], r["doc_id"]): round(r["score"], 5) for r in R.gram_topk(d, "doc_id", "text", q.withColumn("asked", F.coalesce("description_fragment", "mpn")), "sku_id", "asked", block=block).collect()}
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 2e-5 for x in want)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    q.write.parquet(f"{tmp_path}/sku_inputs.parquet")
    fused = {(r["query_id"], r["doc_id"]) for r in QUERIES["fused_topk"](spark, str(tmp_path)).collect()}
    assert {(100, 5), (200, 7), (300, 1), (300, 5)} <= fused  # no whole token in common


def test_bm25_moves_no_pairs(spark):
    """Queries meet blocks of documents where these are read: no row for each query and document is sorted or shuffled."""
    rng = np.random.default_rng(5)
    words = ["in", "valve", "gland", "m16", "x", "red", "12"]
    docs = [(int(i), None if i % 17 == 0 else " ".join(rng.choice(words, rng.integers(0, 6)))) for i in rng.permutation(90)]
    asked = [(int(i), " ".join(rng.choice(words, rng.integers(0, 5)))) for i in range(40)]
    d, q = spark.createDataFrame(docs, "id long, t string"), spark.createDataFrame(asked, "q long, t string")
    found = R.bm25_topk(d, "id", "t", q, "q", "t", k=5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" not in plan and "Window" not in plan
    toks = {i: re.findall("[a-z]+|[0-9]+", t or "") for i, t in docs}
    avg = sum(map(len, toks.values())) / len(docs)
    idf = {w: math.log(len(docs) - c + 0.5) - math.log(c + 0.5) for w in {w for t in toks.values() for w in t} for c in [sum(w in t for t in toks.values())]}
    low = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else low for w, v in idf.items()}
    want = {}
    for i, t in asked:
        terms = [w for w in re.findall("[a-z]+|[0-9]+", t) if w in idf]
        scored = [(-round(sum(idf[w] * x.count(w) * 2.5 / (x.count(w) + 1.5 * (0.25 + 0.75 * len(x) / avg)) for w in terms), 6), j) for j, x in toks.items() if set(terms) & set(x)]
        want |= {(i, rank): j for rank, (_, j) in enumerate(sorted(scored)[:5], 1)}
    for block in (4096, 7):
        assert {(r["query_id"], r["rank"]): r["doc_id"] for r in R.bm25_topk(d, "id", "t", q, "q", "t", k=5, block=block).collect()} == want


def test_gram_vocabulary_is_ranked_off_the_driver(spark, monkeypatch):
    """The driver gets the vocabulary only, not as many grams from every partition; ties at its end go by gram."""
    from pyspark.sql.classic.dataframe import DataFrame

    plans, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: plans.append(self._jdf.queryExecution().executedPlan().toString()) or collect(self))
    monkeypatch.setattr(R, "MAX_GRAMS", 9)
    docs = [(1, "valve bar"), (2, "valve gland"), (3, None), (4, "bar bar vat")]
    d = spark.createDataFrame(docs, "id long, t string")
    got = {r["doc_id"]: r["score"] for r in R.gram_topk(d, "id", "t", spark.createDataFrame([(7, "valve bar")], "q long, t string"), "q", "t").collect()}
    assert plans and not any("false\n+- TakeOrdered" in p for p in plans)  # elsewhere in a plan it runs in a task
    n = sum((R.char_grams(t) for _, t in docs), start=R.char_grams(None))
    kept = sorted(n, key=lambda g: (-n[g], g))[:9]
    idf = {g: math.log(5 / (1 + sum(g in R.char_grams(t) for _, t in docs))) + 1 for g in kept}
    vec = lambda t: np.array([R.char_grams(t)[g] * idf[g] for g in kept])
    cos = {i: vec(t) @ vec("valve bar") / np.linalg.norm(vec(t)) / np.linalg.norm(vec("valve bar")) for i, t in docs if vec(t).any()}
    assert got.keys() == {i for i, c in cos.items() if c > 0} and all(abs(got[i] - cos[i]) < 1e-5 for i in got)


def test_fused_asks_all_inputs(spark, tmp_path):
    from partloom.plans.catalogue_queries import ORACLE, QUERIES

    docs = [(1, "red valve 12 bar"), (2, "red red gland"), (3, None), (5, "blue valves 12"), (7, "KX-1207 pump")]
    asked = [(100, "red valve", "M1"), (101, None, "KX-1207"), (7, "gland valveX", "M3"), (8, "red valve", "M4"), (9, "", None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(asked, "sku_id long, description_fragment string, mpn string").write.parquet(f"{tmp_path}/sku_inputs.parquet")
    rows = QUERIES["fused_topk"](spark, str(tmp_path)).collect()
    of = {i: [(r["doc_id"], r["score"], r["rank"]) for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == i] for i, _, _ in asked}
    assert of[101][0][0] == 7 and of[7][0][0] == 2 and of[8] == of[100] and of[9] == []
    assert "% 100" not in ORACLE["fused_topk"] and "% 100" in ORACLE["bm25_topk"]


def test_dense_against_numpy(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(90, 8))
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(200, None), (201, [0.0] * 8)]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    got = {}
    for r in R.dense_topk(df, "id", "v", df.where("id % 30 = 0"), k=5, block=16).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["doc_id"]
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    assert set(got) == {0, 30, 60}
    assert all([x[k] for k in range(1, 6)] == np.argsort(-(unit @ unit[q]))[:5].tolist() for q, x in got.items())


def test_extraction(spark):
    lex = spark.createDataFrame([("PA66", "m", "polyamide_66"), ("HALOGEN FREE", "h", "true"), ("NO", "f", "open"), ("W/ LOCKNUT AND SEAL RING", "l", "true")], "token string, canonical_key string, value string")
    df = spark.createDataFrame([(1, "tb pa66 halogen free"), (2, "NOPA66 NO."), (3, None), (4, "x NO y"), (4, "x NO y"), (5, "gland w/ locknut and seal ring")], "id int, t string")
    assert sorted((r["row_id"], r["canonical_key"]) for r in E.lexicon_tokens(df, "id", "t", lex).collect()) == [(1, "h"), (1, "m"), (4, "f"), (5, "l")]
    assert E.token_sort_ratio("a b", "b a") == 100.0 and E.token_sort_ratio("abc", "abd") == pytest.approx(66.6667, abs=1e-3) and E.token_sort_ratio("", "") == 100.0
    h = spark.createDataFrame([("Rated  Current",), ("rated curent",), ("xyz",), (None,)], "h string")
    al = spark.createDataFrame([("rated current", "rated_current"), ("weight", "weight")], "alias string, canonical_key string")
    assert {r["header"]: r["canonical_key"] for r in E.match_headers(h, "h", al).collect()} == {"Rated  Current": "rated_current", "rated curent": "rated_current", "xyz": None}
    assert one(spark, E.box_union(F.array(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.5), F.lit(3.0), F.lit(2.0), F.lit(9.0))))) == [0.5, 2.0, 3.0, 9.0]


def test_display(spark):
    assert [one(spark, M.catalogue_fraction(F.lit(x))) for x in (0.25, 1.5, 3.0, 0.3333, 0.374016, 0.7, 0.01, 0.0, -1.5)] == ["1/4", "1-1/2", "3", "1/3", "3/8", "7/10", "0.01", "0", "-1.5"]
    assert one(spark, M.fill_template("{a} {b}, {c}, {d}", {"a": F.lit("x"), "b": F.lit(None).cast("string"), "c": F.lit(None).cast("string"), "d": F.lit("y")})) == "x, y"
    assert one(spark, M.unlicensed_numbers(F.lit("with 9A and 3.50 mm, 007"), F.array(F.lit("3.5")))) == ["7", "9"]


def test_upsert_is_null_safe_and_idempotent(spark):
    old = spark.createDataFrame([("i1", None, "A", "h1"), ("i2", "m", "B", "h2")], "id string, m string, p string, h string")
    new = spark.createDataFrame([("n1", None, "A", "h9"), ("n3", "m", "C", "h3")], "id string, m string, p string, h string")
    once = S.upsert(old, new, ["m", "p"], ["id"])
    want = [("i1", None, "A", "h9"), ("i2", "m", "B", "h2"), ("n3", "m", "C", "h3")]
    assert sorted(map(tuple, once.collect())) == want
    assert sorted(map(tuple, S.upsert(once, new, ["m", "p"], ["id"]).collect())) == want
    assert sorted(map(tuple, S.changed_keys(old, new, ["p"], ["h"]).collect())) == [("A", "changed"), ("C", "new")]
    assert sorted(map(tuple, S.replace_children(old, "p", new).collect()))[0] == ("i2", "m", "B", "h2")


def test_swapped_contents_change_the_combined_hash(spark):
    df = spark.createDataFrame([("p", "s1", "a"), ("p", "s2", "b"), ("q", "s1", "b"), ("q", "s2", "a"), ("r", "s1", "a"), ("t", "s1", "a"), ("t", "s2", "a"), ("u", "s1", None)], "p string, s string, c string")
    got = {r["p"]: r["combined"] for r in S.combined_hash(df, "p", "s", "c").collect()}
    import hashlib

    assert len(set(got.values())) == 5 and got["p"] == hashlib.sha256(b"s1:a|s2:b").hexdigest()


def test_heuristic_and_value_keys(spark):
    h = lambda *a: one(spark, C.heuristic(*[F.lit(x).cast(t) for x, t in zip(a, ("string", "string", "int", "int", "boolean"))]))
    assert h("table_cell", "table", 3, 1, True) == 0.999 and h("inferred", "rule", 1, 6, True) == pytest.approx(0.55 + 0.1 / 3 + 0.1 / 6 - 0.15, abs=1e-6)
    assert h("prose", None, None, None, False) == pytest.approx(0.3 + 0.1 / 9, abs=1e-6)
    assert one(spark, A.value_key(F.lit(3.0), F.lit("3"), F.lit("length"))) == "q:3.000000:length" and one(spark, A.value_key(F.lit(3.0), F.lit("3"))) == "q:3.000000:dimensionless"
    assert one(spark, A.value_key(F.lit(None).cast("double"), F.lit("n/a"))) is None


def test_candidates_of_parts_and_families(spark):
    from partloom.plans.pipeline import table_candidates, typed_claims

    cells = "array<struct<header:string,value:string>>"
    rows = [
        ("S1", "c1", "table_cell", [("Part No.", "AB-12"), ("pitch", "5 mm / 6 mm"), ("Notes", "at 20 C")]), ("S1", "c2", "table_cell", [("Part No.", "AB-12-X"), ("pitch", "7 mm")]),
        ("S1", "c3", "table_cell", [("pitch", "1/4 in"), ("colour", None)]), ("S1", "c4", "structured_field", [("Parameter", "Colour"), ("Rating", "Jet Black")]), ("S1", "c5", "prose", [("pitch", "9 mm")]), ("S2", "c6", "table_cell", None),
    ]
    chunks = spark.createDataFrame(rows, f"source_id string, chunk_id string, locator string, cells {cells}")
    parts = spark.createDataFrame([("p", "s1", "AB12"), ("q", "s1", "AB12X"), ("r", "s1", "ZZ9"), ("t", "s2", "AB12")], "_p string, _s string, _code string")
    names = spark.createDataFrame([("pitch", "pitch"), ("colour", "body_colour")], "alias string, canonical_key string")
    got = sorted((r["product_id"], r["canonical_key"], r["value"], tuple(r["alternatives"]), r["condition"]) for r in table_candidates(chunks, parts, names).collect() if r["value"])
    family = lambda p: [(p, "body_colour", "Jet Black", (), None), (p, "pitch", "1/4 in", (), None)]
    assert got == sorted([("p", "pitch", "5 mm", ("6 mm",), "at 20 C"), ("q", "pitch", "7 mm", (), None), *family("p"), *family("q"), *family("r")], key=str)
    specs = spark.createDataFrame(
        [("tb", "pitch", "quantity", "length", "mm", None, 0.0, 9.0), ("tb", "ways", "quantity", "dimensionless", None, None, 0.0, 9.0), ("tb", "colour", "enum", None, None, ["jet_black", "light_grey"], None, None), ("tb", "ok", "bool", None, None, None, None, None)],
        "category_code string, canonical_key string, value_type string, dimension string, canonical_unit string, allowed_values array<string>, plausible_min double, plausible_max double",
    )
    said = [("pitch", "1/4 in"), ("pitch", "5"), ("pitch", "5 bar"), ("ways", "about 3"), ("colour", "JET-BLACK"), ("colour", "jet blackk"), ("colour", "green"), ("ok", "Ja"), ("ok", "maybe"), ("zz", "1"), ("ok", None)]
    claims = spark.createDataFrame([("tb", k, v, None) for k, v in said], "category_code string, canonical_key string, value string, unit string")
    assert sorted((r["value"], r["typed"]) for r in typed_claims(claims, specs).collect()) == [("1/4 in", "6.350000"), ("5", "5.000000"), ("JET-BLACK", "jet_black"), ("Ja", "true"), ("about 3", "3.000000"), ("jet blackk", "jet_black")]


def test_makers_in_texts(spark):
    from partloom.operators.verify import maker_names, makers_in_sources

    products = spark.createDataFrame([("p", "Acme"), ("q", "ACME Works, Ltd."), ("r", None), ("s", " ")], "id string, m string")
    entries = spark.createDataFrame([(1, "Acme", ["Acme Works Ltd", None])], "e int, n string, al array<string>")
    names = maker_names(products, "id", "m", entries, "e", "n", "al")
    assert sorted(map(tuple, names.collect())) == [("p", "ACME"), ("p", "ACME WORKS LTD"), ("q", "ACME"), ("q", "ACME WORKS LTD")]
    chunks = spark.createDataFrame([("s1", "by Acme\nworks ltd."), ("s2", "Acmeworks"), ("s3", None)], "s string, t string")
    assert sorted((r["s"], r["name"]) for r in makers_in_sources(chunks, "s", "t", names.select("name")).collect()) == [("s1", "ACME"), ("s1", "ACME WORKS LTD")]
