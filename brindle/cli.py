"""Jobs for spark-submit: each reads CSV, writes its result and prints a JSON summary on stdout.

    spark-submit brindle/cli.py clean IN OUT
    spark-submit brindle/cli.py normalise IN CATALOGUE OUT
    spark-submit brindle/cli.py catalogue IN STORED OUT

IN and CATALOGUE are CSV files, STORED the Parquet snapshot of the catalogue (it may be missing), OUT a folder.
"""

from __future__ import annotations

import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import imports, quality
from brindle.sources import readers


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    return readers.read_csv(spark, path).withColumn("row_number", F.monotonically_increasing_id() + 2)


def clean(spark: SparkSession, source: str, out: str) -> dict:
    """Collected reviews: clean rows and a report with up to 20 removed ones."""
    rows = _numbered(spark, source)
    for c in ("product_id", "product_name", "source_url", "raw_text", "review_title", "marketplace"):
        rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast("string"))
    rows = rows.withColumn("raw_text", quality.repaired_text(F.col("raw_text"), F.col("review_title")))
    cleaned = quality.clean_reviews(rows, order="row_number")
    counts, removed = imports.clean_report(cleaned, "row_number")
    examples = removed.select("row_number", F.col("status").alias("reason"), "product_name", "raw_text", "review_title")
    return readers.write_report(cleaned.where("status = 'clean'").drop("status", "row_number"), counts, examples, out)


def normalise(spark: SparkSession, source: str, catalogue: str, out: str) -> dict:
    """Reviews of any layout against the catalogue: kept rows and a report with up to 20 unresolved ones."""
    known = imports.catalogue_records(readers.read_csv(spark, catalogue), F.lit(None).cast("string")).where("skip is null")
    done = imports.normalise_reviews(_numbered(spark, source), known)
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    counts = done.agg(n("kept").alias("imported_candidate_count"), n("skipped").alias("skipped_count"), n("duplicate").alias("duplicate_count"), n("unresolved").alias("unresolved_count"))
    open_ = done.where("status = 'unresolved'").orderBy("row_number").limit(20).select("row_number", "product_name", "brand", "raw_text")
    return readers.write_report(done.where("status = 'kept'").drop("status", "row_number"), counts, open_, out)


def catalogue(spark: SparkSession, source: str, stored: str, out: str) -> dict:
    """Catalogue rows merged into the stored snapshot; the new snapshot is written to OUT."""
    records = imports.catalogue_records(_numbered(spark, source), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"), keep=("row_number",))
    path = spark._jvm.org.apache.hadoop.fs.Path(stored)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    old = spark.read.parquet(stored) if there else records.select(*imports.FIELDS).limit(0)
    after, counts = imports.import_catalogue(records, old, "row_number")
    after.write.mode("overwrite").parquet(out)
    return counts.first().asDict()


def main(args: list[str]) -> int:
    jobs = {"clean": clean, "normalise": normalise, "catalogue": catalogue}
    if len(args) < 3 or args[0] not in jobs:
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName(f"brindle-{args[0]}").getOrCreate()
    print(json.dumps(jobs[args[0]](spark, *args[1:])))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
