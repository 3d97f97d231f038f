import datetime as dt
import json
import time

from pyspark.sql import functions as F

import __spark_entry__ as entry
from partloom.sources.files import binary_documents, listings, words_to_lines
from partloom.sources.sinks import json_snapshot, replace_table
from partloom.streaming.revisions import recheck_sink, revision_stream, windowed_counts


def test_listings(spark, tmp_path):
    (tmp_path / "a1.json").write_text(json.dumps({"source_type": "marketplace", "mpn": "X-1", "manufacturer": None, "title": "A valve", "specifications": {"Pitch": "5 mm", "Body": " "}}))
    rows = listings(spark, str(tmp_path)).orderBy("chunk_ord").collect()
    assert [(r["chunk_id"], r["locator"], r["text"]) for r in rows] == [("a1:head", "prose", "A valve"), ("a1:mpn", "structured_field", "Part Number: X-1"), ("a1:f0", "structured_field", "Pitch: 5 mm")]
    assert rows[2]["cells"][0]["header"] == "Pitch"


def test_binary_documents(spark, tmp_path):
    (tmp_path / "ok.bin").write_bytes(b"hello")
    (tmp_path / "bad.bin").write_bytes(b"?")

    def parse(path, content):
        if content == b"?":
            raise ValueError("empty")
        return [("c1", "s", "t", 1, 1, content.decode(), None, "prose", None)]

    got = {r["locator"]: r for r in binary_documents(spark, str(tmp_path), parse).collect()}
    assert set(got) == {"prose", "error"} and got["prose"]["text"] == "hello" and got["error"]["text"] == "ValueError: empty" and got["error"]["source_id"].endswith("bad.bin")


def test_listing_that_is_no_json(spark, tmp_path):
    (tmp_path / "bad.json").write_text("{no json")
    assert [(r["source_id"], r["locator"], r["text"], r["cells"]) for r in listings(spark, str(tmp_path)).collect()] == [("bad", "error", "{no json", None)]


def test_lines(spark):
    w = spark.createDataFrame([(1, 10.0, 20.0, 100.0, 110.0, "b"), (1, 0.0, 9.0, 101.0, 111.0, "a"), (1, 0.0, 9.0, 103.5, 113.0, "c")], "page int, x0 double, x1 double, top double, bottom double, text string")
    assert [(r["text"], r["bbox"]) for r in words_to_lines(w, ["page"]).orderBy("line").collect()] == [("a b", [0.0, 100.0, 20.0, 111.0]), ("c", [0.0, 103.5, 9.0, 113.0])]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    replace_table(spark.range(3), path)
    replace_table(spark.read.parquet(path).where("id > 0"), path)
    assert spark.read.parquet(path).count() == 2
    json_snapshot(spark.range(5).withColumn("k", F.lit("x")), str(tmp_path / "j"), F.col("id"))
    assert sorted(json.loads(r["value"])["id"] for r in spark.read.text(str(tmp_path / "j")).collect()) == [0, 1, 2, 3, 4]


def test_revision_stream(spark, tmp_path):
    schema = "id string, content_hash string, fetched_at timestamp_ntz"
    t = dt.datetime(2025, 1, 1)
    src = str(tmp_path / "src")
    spark.createDataFrame([("S1", "h1", t), ("S1", "h1", t), ("S2", "h2", t)], schema).write.mode("append").parquet(src)
    links = spark.createDataFrame([("P1", " s1"), ("P2", "S3"), (None, "S2")], "product_id string, source_id string")
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    run = lambda: recheck_sink(revision_stream(spark, src, spark.read.parquet(src).schema), links, out, check).awaitTermination(60)
    assert run()
    time.sleep(1)
    spark.createDataFrame([("S3", "h3", t)], schema).write.mode("append").parquet(src)
    assert run()
    assert sorted((r["product_id"], r["content_hash"]) for r in spark.read.parquet(out).collect()) == [("p1", "h1"), ("p2", "h3")]
    assert windowed_counts(spark.read.parquet(src).withColumn("at", F.col("fetched_at").cast("timestamp")), "at", "id").count() == 3


def test_old_revisions_in_later_batches_are_kept_once(spark, tmp_path):
    schema = "id string, content_hash string, fetched_at timestamp_ntz"
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    rows = [("S1", "h1", dt.datetime(2025, 6, 1)), ("S2", "h2", dt.datetime(2023, 1, 1)), (" s1", "h1", dt.datetime(2024, 1, 1)), ("S1", "h0", dt.datetime(2022, 1, 1))]
    for row in rows:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)  # files are taken in the order of their times
    links = spark.createDataFrame([("P1", "S1"), ("P2", "S2")], "product_id string, source_id string")
    assert recheck_sink(revision_stream(spark, src, spark.read.parquet(src).schema, max_files=1), links, out, str(tmp_path / "check")).awaitTermination(120)
    got = spark.read.parquet(out)
    assert sorted((r["product_id"], r["content_hash"]) for r in got.collect()) == [("p1", "h0"), ("p1", "h1"), ("p2", "h2")]


def test_entry_lists(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and all(callable(f) for f in q.values()) and len(q) > 50
