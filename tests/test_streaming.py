import datetime

from brindle.streaming import incremental


def test_arrivals_and_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    t = datetime.datetime(2026, 5, 1).isoformat()
    lines = [f"r{k},p,s,2026-05-0{k % 3 + 1},text {k % 3},4.0,{t}" for k in range(6)]
    (tmp_path / "in" / "a.csv").write_text("review_id,product_id,source,review_date,raw_text,rating,ts\n" + "\n".join(lines) + "\n")
    schema = "review_id string, product_id string, source string, review_date string, raw_text string, rating double, ts timestamp"
    rows = incremental.stream_csv(spark, str(tmp_path / "in"), schema)
    q = incremental.first_arrivals(rows, "ts").writeStream.format("memory").queryName("arrivals").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("arrivals").count() == 3
    from pyspark.sql import functions as F

    full = rows.select("*", *(F.lit(None).cast("string").alias(c) for c in ("marketplace", "marketplace_product_id", "marketplace_review_id", "reviewer_hash")))
    incremental.ingest_batches(full, str(tmp_path / "out"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).where("status = 'insert'").count() == 3
