"""Reading document collections: JSON listings, JSON-lines indexes, labelled records and binary documents with a pluggable parser."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_SCHEMA = "chunk_id string, source_id string, source_type string, page int, chunk_ord int, text string, bbox array<double>, locator string, cells array<struct<header:string,value:string>>"
LISTING_SCHEMA = "distributor string, source_type string, mpn string, manufacturer string, title string, specifications map<string,string>"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines file or folder with a declared schema (no inference pass); lines that are no JSON give nulls."""
    return spark.read.schema(schema).json(path)


def listings(spark: SparkSession, path: str) -> DataFrame:
    """Listing files (one JSON object each) as chunks: the title as prose, part number, manufacturer and each specification as a field.

    The source id is the file's name without its suffix; empty parts give no chunk; the order of specifications is kept. A file
    that is no JSON object gives one row with the locator ``error`` and its text.
    """
    parsed = F.from_json("value", LISTING_SCHEMA + ", _broken string", {"columnNameOfCorruptRecord": "_broken"}).alias("j")
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("source_id"), parsed).select("source_id", "j.*")
    field = lambda h, v, tag: F.struct(F.lit(tag).alias("tag"), F.lit(h).alias("header") if isinstance(h, str) else h.alias("header"), v.alias("value"), F.lit("structured_field").alias("locator"))
    specs = F.transform(F.map_entries("specifications"), lambda e, i: F.struct(F.concat(F.lit("f"), i.cast("string")).alias("tag"), e["key"].alias("header"), e["value"].alias("value"), F.lit("structured_field").alias("locator")))
    head = F.struct(F.lit("head").alias("tag"), F.lit(None).cast("string").alias("header"), F.col("title").alias("value"), F.lit("prose").alias("locator"))
    error = F.array(F.struct(F.lit("error").alias("tag"), F.lit(None).cast("string").alias("header"), F.col("_broken").alias("value"), F.lit("error").alias("locator")))
    parts = F.when(F.col("_broken").isNotNull(), error).otherwise(F.concat(F.array(head, field("Part Number", F.col("mpn"), "mpn"), field("Manufacturer", F.col("manufacturer"), "manufacturer")), F.coalesce(specs, F.array().cast("array<struct<tag:string,header:string,value:string,locator:string>>"))))
    x = raw.select("source_id", "source_type", F.posexplode(F.filter(parts, lambda p: p["value"].isNotNull() & (F.trim(p["value"]) != ""))).alias("ord", "p"))
    cell = F.when(F.col("p.header").isNotNull(), F.array(F.struct(F.col("p.header").alias("header"), F.col("p.value").alias("value"))))
    text = F.when(F.col("p.header").isNotNull(), F.concat("p.header", F.lit(": "), "p.value")).otherwise(F.col("p.value"))
    return x.select(
        F.concat_ws(":", "source_id", "p.tag").alias("chunk_id"), "source_id", "source_type", F.lit(1).alias("page"), (F.col("ord") + 1).cast("int").alias("chunk_ord"), text.alias("text"),
        F.lit(None).cast("array<double>").alias("bbox"), F.col("p.locator").alias("locator"), cell.alias("cells"),
    )


def binary_documents(spark: SparkSession, path: str, parse: Callable[[str, bytes], list[tuple]], pattern: str = "*") -> DataFrame:
    """Documents read as bytes and parsed on the workers by ``parse(path, content)``, which gives rows of ``CHUNK_SCHEMA``.

    No parser of page formats is part of the library. A document that the parser refuses (an exception) gives one row: its path
    as ``source_id``, the locator ``error`` and the message as text.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")]
        for f in frames:
            rows: list[tuple] = []
            for p, c in zip(f["path"], f["content"]):
                try:
                    rows += parse(p, bytes(c))
                except Exception as e:
                    rows.append((None, p, None, None, None, f"{type(e).__name__}: {e}", None, "error", None))
            yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, CHUNK_SCHEMA)


def words_to_lines(words: DataFrame, page: list[str], tolerance: float = 2.0) -> DataFrame:
    """Words of a page (``x0, x1, top, bottom, text``) as lines: a word joins the open line when its top is within the tolerance of the line's first word."""
    w = F.array_sort(F.collect_list(F.struct("top", "x0", "x1", "bottom", "text")))  # the words of one page
    kind = "array<struct<top:double,words:array<struct<top:double,x0:double,x1:double,bottom:double,text:string>>>>"

    def step(lines, x):
        n = F.size(lines)
        last = F.get(lines, n - 1)
        joins = (n > 0) & (F.abs(x["top"] - last["top"]) <= tolerance)
        grown = F.concat(F.slice(lines, 1, F.greatest(n - 1, F.lit(0))), F.array(F.struct(last["top"].alias("top"), F.concat(last["words"], F.array(x)).alias("words"))))
        return F.when(joins, grown).otherwise(F.concat(lines, F.array(F.struct(x["top"].alias("top"), F.array(x).alias("words"))))).cast(kind)

    lines = words.groupBy(*page).agg(F.aggregate(w, F.array().cast(kind), step).alias("lines"))
    one = lines.select(*page, F.posexplode("lines").alias("line", "l")).withColumn("w", F.sort_array(F.transform("l.words", lambda v: F.struct(v["x0"].alias("x0"), v["x1"].alias("x1"), v["top"].alias("top"), v["bottom"].alias("bottom"), v["text"].alias("text")))))
    side = lambda c: F.transform("w", lambda v: v[c])
    box = F.array(F.array_min(side("x0")), F.array_min(side("top")), F.array_max(side("x1")), F.array_max(side("bottom")))
    return one.select(*page, "line", F.array_join(F.transform("w", lambda v: v["text"]), " ").alias("text"), box.alias("bbox"))
