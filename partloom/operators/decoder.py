"""Part numbers read by position: segments that go with a value throughout a family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: members a family needs, and the least share of segments that go with a single value
LEAST_MEMBERS, LEAST_SHARE = 5, 0.9


def segments(c: Column) -> Column:
    """Runs of letters and runs of digits of a part number, upper case."""
    return F.regexp_extract_all(F.upper(c), F.lit("[0-9]+|[A-Z]+"), F.lit(0))


def positional_family(maker: Column, segs: Column) -> Column:
    """Parts of one maker whose numbers begin alike and have as many segments."""
    return F.concat_ws("|", F.coalesce(maker, F.lit("?")), F.coalesce(F.get(segs, F.lit(0)), F.lit("")), F.size(segs).cast("string"))


def fit_decoder(labels: DataFrame, part: str, maker: str, key: str, value: str) -> DataFrame:
    """``family, idx, key, segment, value``: what a segment of a family's part numbers stands for.

    A rule needs a family of at least ``LEAST_MEMBERS`` parts, at least two different segments at the position that go with
    the key, and at least ``LEAST_SHARE`` of them with a single value; ambiguous segments are left out. Values stay as they are.
    Null parts, keys and values take no part. Aggregations only: a hot family costs its distinct segments and values.
    """
    x = labels.where(F.col(part).isNotNull()).select(F.col(part).alias("part"), F.col(maker).alias("maker"), F.col(key).alias("key"), F.col(value).alias("value"), segments(F.col(part)).alias("s"))
    x = x.withColumn("family", positional_family(F.col("maker"), F.col("s")))
    big = x.groupBy("family").agg(F.countDistinct("part").alias("members")).where(F.col("members") >= LEAST_MEMBERS).select("family")
    seen = x.where("key is not null and value is not null").select("family", "key", "value", F.posexplode("s").alias("idx", "segment")).groupBy("family", "idx", "key", "segment", "value").agg(F.lit(1).alias("one"))
    per = seen.join(big, "family").groupBy("family", "idx", "key", "segment").agg(F.count("one").alias("n"), F.min("value").alias("value"))
    kept = per.groupBy("family", "idx", "key").agg(F.count(F.lit(1)).alias("segs"), F.sum((F.col("n") == 1).cast("int")).alias("clear")).where((F.col("segs") >= 2) & (F.col("clear") / F.col("segs") >= LEAST_SHARE))
    return per.where("n = 1").join(kept.select("family", "idx", "key"), ["family", "idx", "key"]).select("family", "idx", "key", "segment", "value")


def decode(parts: DataFrame, item: str, part: str, maker: str, rules: DataFrame) -> DataFrame:
    """``item, idx, key, segment, value``: the rules that a part number meets, by equi-join on family, position and segment."""
    x = parts.select(F.col(item).alias("item"), F.col(maker).alias("maker"), segments(F.col(part)).alias("s"))
    x = x.select("item", positional_family(F.col("maker"), F.col("s")).alias("family"), F.posexplode("s").alias("idx", "segment"))
    return x.join(rules, ["family", "idx", "segment"]).select("item", "idx", "key", "segment", "value")
