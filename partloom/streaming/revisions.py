"""Source revisions as a stream: skip known contents, find the linked products, keep the store up to date.

An extension of the batch operators in ``operators.store``; each micro-batch runs the same plans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from partloom.functions.text import reference_key


def revision_stream(spark: SparkSession, folder: str, schema, max_files: int = 100) -> DataFrame:
    """New files of the source table as a stream, all rows of them however old; ``recheck_sink`` skips known contents."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)
    return s.withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))


def recheck_sink(stream: DataFrame, links: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append the products linked to each batch of revised sources to ``out``; a repeated batch overwrites its own folder.

    Each content of a source counts once, whenever it was fetched: the pairs seen are kept by batch in the folder beside ``out``
    whose name ends in ``_seen``, and a batch is compared with those of the batches before it.
    """
    seen = out.rstrip("/") + "_seen"
    pairs = ["source_id", "content_hash"]
    # so that the folder can be read from the first batch on
    stream.sparkSession.createDataFrame([], "source_id string, content_hash string").write.mode("overwrite").parquet(f"{seen}/batch_id=-1")

    def write(batch: DataFrame, batch_id: int) -> None:
        known = batch.sparkSession.read.schema("source_id string, content_hash string, batch_id long").parquet(seen).where(F.col("batch_id") < batch_id)
        every = batch.select(reference_key(F.col("id")).alias("source_id"), "content_hash").distinct()
        same = [every[c].eqNullSafe(known[c]) for c in pairs]
        changed = every.join(known, same, "left_anti").persist()
        hit = links.select(reference_key(F.col("product_id")).alias("product_id"), reference_key(F.col("source_id")).alias("source_id")).where("product_id is not null").distinct().join(changed, "source_id")
        hit.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        changed.write.mode("overwrite").parquet(f"{seen}/batch_id={batch_id}")
        changed.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, at: str, by: str, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events per window and group, closed by a watermark."""
    return stream.withWatermark(at, late).groupBy(F.window(at, size), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), by, "n")
