"""Incremental forms: deduplicated arrival, daily statistics, and ingest by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import text as tf
from brindle.operators import mutate


def stream_csv(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).csv(folder, header=True)


def scrape_hash(rows: DataFrame) -> DataFrame:
    """Adds review_hash: product, source, date and the first 80 characters of the text."""
    part = F.trim(F.lower(F.substring(F.coalesce("raw_text", F.lit("")), 1, 80)))
    return rows.withColumn("review_hash", tf.sha(F.col("product_id"), F.col("source"), F.col("review_date"), part))


def first_arrivals(rows: DataFrame, time: str, keep: str = "7 days") -> DataFrame:
    """Rows whose hash wasn't seen within `keep`: state is bounded by the watermark."""
    return scrape_hash(rows).withWatermark(time, keep).dropDuplicatesWithinWatermark(["review_hash"])


def daily(rows: DataFrame, time: str, late: str = "2 days") -> DataFrame:
    """Count and mean rating per day and product, with late rows counted until the watermark."""
    return rows.withWatermark(time, late).groupBy(F.window(time, "1 day").alias("day"), "product_id").agg(F.count("*").alias("reviews"), F.avg("rating").alias("avg_rating"))


def ingest_batches(rows: DataFrame, target: str, checkpoint: str):
    """Micro-batches through `mutate.ingest` against what target already holds; returns the query.

    A batch that is replayed writes its own folder again, so a restart leaves no row twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        stored = spark.read.option("basePath", target).parquet(target).where(F.col("batch") != number) if there else None
        keyed = mutate.review_keys(batch.withColumn("seq", F.monotonically_increasing_id() + F.lit(number).cast("long") * (1 << 40)))
        decided = mutate.ingest(keyed, stored)
        decided.where("status <> 'touch'").write.mode("overwrite").parquet(f"{target}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
