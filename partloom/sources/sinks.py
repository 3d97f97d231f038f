"""Writing results: staged replacement of tables and snapshots of JSON records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def replace_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write ``df`` beside ``path`` and then put it in its place, so that a plan may read the table it replaces and a retry is harmless."""
    spark = df.sparkSession
    staged = f"{path}__staged"
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(staged)
    jvm = spark._jvm
    target, source = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(staged)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    old = jvm.org.apache.hadoop.fs.Path(f"{path}__old")
    if fs.exists(target):  # a copy left by a crash goes only when there is a newer one
        fs.delete(old, True)
        fs.rename(target, old)
    if not fs.rename(source, target):
        raise OSError(f"{staged} could not take the place of {path}; the old table is {path}__old")
    fs.delete(old, True)


def json_snapshot(df: DataFrame, path: str, key: Column, partitions: int = 16) -> None:
    """One JSON text per row, in folders by a hash of the key, so that a record is found without an index."""
    bucket = F.pmod(F.xxhash64(key), F.lit(partitions)).cast("int")
    df.select(bucket.alias("bucket"), F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").partitionBy("bucket").text(path)
