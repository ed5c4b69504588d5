"""The driver's tables seen as reviews and aspect facts, in Spark and in SQL alike.

A line item is a review: its part's brand is the product, the part's type an aspect, the return flag a sentiment,
discount and tax give intensity and confidence, and a fixed sentence serves as its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SENTENCES = [
    "Camera is mast but battery backup is bekar",
    "Phone 10 min gaming ke baad garam tawa ban jata hai",
    "Camra zabardast hai aur display bhi mast hai bhai",
    "battery backup bakwas hai aur charging bahut slow hai",
    "Display bright hai, outdoor me clearly dikhta hai",
    "Delivery late thi, packaging and box damaged",
    "Performance smooth hai, apps fast open hote hain",
    "UI lag karta hai; software bugs bahut hain, update not good",
    "Design premium lagta hai, haath me feel acha hai",
    "Wah wah kya phone hai, heat aur battery drain",
    "Speaker loud hai aur call quality clear hai | sound excellent",
    "Network bar bar drop hota hai, internet unstable hai",
    "seller refused the refund, service poor",
    "",
    "theek hai",
    "Nice phone, front cam and selfie good, night photos poor",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it comes from fewer splits, as one small file does; larger inputs are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item; only the columns that a query asks for are read."""
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_name")
    r = li.join(part, li.l_partkey == part.p_partkey)
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return r.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents).alias("review_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("source_key"),
        F.col("p_brand").alias("product_id"), F.col("p_type").alias("aspect"), F.col("l_shipdate").cast("date").alias("review_date"),
        F.when(F.col("l_returnflag") == "A", "positive").when(F.col("l_returnflag") == "R", "negative").otherwise("neutral").alias("sentiment"),
        (F.round(F.col("l_discount") * 100) / 10).cast("decimal(4,1)").alias("intensity"), ((20 - F.round(F.col("l_tax") * 100)) / 20).cast("decimal(4,2)").alias("confidence"),
        (1 + F.pmod(F.col("l_quantity"), F.lit(5.0))).alias("rating"), (F.col("l_linestatus") == "O").alias("verified_purchase"), F.col("l_linenumber").alias("helpful_votes"),
        F.col("p_name").alias("name"), F.concat(F.lit("store"), F.pmod("l_suppkey", F.lit(4)).cast("string")).alias("source"), F.col("l_orderkey").alias("order_key"), cents.alias("seq"),
        _pick(SENTENCES, F.pmod(F.col("l_partkey") * 7 + F.col("l_linenumber"), F.lit(len(SENTENCES)))).alias("raw_text"),
    )


REVIEWS_SQL = f"""reviews AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS review_id,
    concat_ws('-', l_orderkey, l_linenumber) AS source_key, p_brand AS product_id, p_type AS aspect, CAST(l_shipdate AS DATE) AS review_date,
    CASE l_returnflag WHEN 'A' THEN 'positive' WHEN 'R' THEN 'negative' ELSE 'neutral' END AS sentiment,
    CAST(round(l_discount * 100) / 10 AS DECIMAL(4,1)) AS intensity, CAST((20 - round(l_tax * 100)) / 20 AS DECIMAL(4,2)) AS confidence,
    1 + l_quantity % 5 AS rating, l_linestatus = 'O' AS verified_purchase, l_linenumber AS helpful_votes, p_name AS name,
    'store' || (l_suppkey % 4) AS source, l_orderkey AS order_key, CAST(round(l_extendedprice * 100) AS BIGINT) AS seq,
    list_extract([{", ".join("'" + s.replace("'", "''") + "'" for s in SENTENCES)}], CAST((l_partkey * 7 + l_linenumber) % {len(SENTENCES)} + 1 AS BIGINT)) AS raw_text
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A product per brand: price, own flag, segment."""
    p = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("product_id")).agg(F.min("p_name").alias("product_name"), F.min(F.floor(F.col("p_retailprice") * 25)).alias("price"), F.min("p_size").alias("size"))
    return p.withColumn("own_brand", F.col("product_id").isin("Brand#1", "Brand#2", "Brand#3")).withColumn("competitor_product_ids", F.concat_ws("; ", F.lit("Brand#1"), F.concat(F.lit("Brand#"), F.col("size").cast("string"))))


PRODUCTS_SQL = """products AS (
  SELECT *, product_id IN ('Brand#1', 'Brand#2', 'Brand#3') AS own_brand, 'Brand#1; Brand#' || size AS competitor_product_ids
  FROM (SELECT p_brand AS product_id, min(p_name) AS product_name, min(CAST(floor(p_retailprice * 25) AS BIGINT)) AS price, min(p_size) AS size FROM part GROUP BY p_brand))"""
