"""Deduplication and upserts as transformations from one snapshot to the next.

Parquet has no MERGE: each takes what is stored and what comes in and returns what to write as
the new snapshot. `seq` is the order of arrival.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.functions import text as tf
from brindle.operators.summary import first_by, latest_by


def review_keys(reviews: DataFrame) -> DataFrame:
    """Adds the hashes that ingest compares: exact, normalised, fingerprint and source key."""
    norm = tf.hash_text(F.col("raw_text"))
    rating = F.when(F.col("rating") == 0, "").otherwise(F.coalesce(F.col("rating").cast("string"), F.lit("")))
    out = reviews.withColumn("text_hash", F.sha2(F.coalesce("raw_text", F.lit("")), 256)).withColumn("normalized_text_hash", F.sha2(norm, 256))
    out = out.withColumn("review_fingerprint", tf.sha(F.col("product_id"), rating, F.col("review_date"), norm))
    known = tf.sha(F.coalesce("marketplace", "source", F.lit("unknown_marketplace")), F.coalesce("marketplace_product_id", "product_id"), F.col("marketplace_review_id"))
    seed = tf.sha(F.coalesce("source", "marketplace", F.lit("unknown_source")), F.coalesce("marketplace_product_id", "product_id"), F.coalesce("reviewer_hash", F.lit("unknown_reviewer")), F.coalesce(F.col("review_date").cast("string"), F.lit("unknown_date")), F.col("normalized_text_hash"))
    return out.withColumn("source_review_key", F.when(F.col("marketplace_review_id").isNotNull(), known).otherwise(seed))


def ingest(incoming: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Decides for each incoming row (seq, review_id, product_id, rating, source_review_key, normalized_text_hash):

    status: `touch` (source key known or seen before in the batch), `attach` (duplicate of an earlier review of other
    id, whose id is canonical_id) or `insert`. A duplicate has the same product, text and rating; the earliest stored review is
    canonical, else the first of the batch. Two equi joins take the place of a join with OR.
    """
    seen = W.partitionBy("source_review_key").orderBy("seq")
    batch = incoming.withColumn("nth", F.row_number().over(seen))
    group = ["product_id", "normalized_text_hash", "rating_key"]
    batch = batch.withColumn("rating_key", F.coalesce(F.col("rating").cast("double"), F.lit(-1.0)))
    if stored is not None:
        known = stored.select("source_review_key").distinct().withColumn("known", F.lit(True))
        old = stored.withColumn("rating_key", F.coalesce(F.col("rating").cast("double"), F.lit(-1.0)))
        old = first_by(old, group, ["seq"]).select(*group, F.col("review_id").alias("stored_id"))
        batch = batch.join(known, "source_review_key", "left").join(old, group, "left")
    else:
        batch = batch.withColumn("known", F.lit(None).cast("boolean")).withColumn("stored_id", F.lit(None).cast("string"))
    touch = (F.col("nth") > 1) | F.coalesce("known", F.lit(False))
    leads = F.first(F.when(~touch, F.col("review_id"))).over(W.partitionBy(*group).orderBy(touch, "seq"))  # the first that isn't known, null if all are
    batch = batch.withColumn("first_id", leads).withColumn("canonical_id", F.coalesce("stored_id", "first_id", "review_id"))
    status = F.when(touch, "touch").when(F.col("canonical_id") != F.col("review_id"), "attach").otherwise("insert")
    return batch.withColumn("status", status).drop("nth", "known", "stored_id", "first_id", "rating_key")


def import_counts(decided: DataFrame) -> DataFrame:
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    return decided.agg(n("insert").alias("imported"), n("attach").alias("duplicates"), n("touch").alias("touched"), F.countDistinct("product_id").alias("products"))


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], keep_stored: bool = True) -> DataFrame:
    """Field-wise merge. keep_stored: an incoming NULL leaves the stored value; otherwise incoming rows replace all fields."""
    rest = [c for c in stored.columns if c not in keys]
    i = incoming.select(*keys, F.struct(*rest).alias("new"))
    j = stored.select(*keys, F.struct(*rest).alias("old")).join(i, keys, "full_outer")
    pick = lambda c: F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}")) if keep_stored else F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}"))
    return j.select(*keys, *(pick(c).alias(c) for c in rest))


def insert_new(stored: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """INSERT OR IGNORE: the first incoming row of each key that isn't stored is appended."""
    fresh = first_by(incoming, keys, order).join(stored.select(*keys), keys, "left_anti")
    return stored.unionByName(fresh.select(*stored.columns))


def last_write_wins(stored: DataFrame, incoming: DataFrame, keys: list[str], newest: list[str]) -> DataFrame:
    return latest_by(stored.unionByName(incoming), keys, newest)


def provenance(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of each key the last value that isn't NULL of every other column, and how often it was seen."""
    rest = [c for c in rows.columns if c not in (*keys, order)]
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in rest]
    return rows.groupBy(*keys).agg(*last, F.count("*").alias("times_seen"), F.min(order).alias("first_seen"), F.max(order).alias("last_seen"))


def merge_entities(left: DataFrame, right: DataFrame, key: str, either: list[str]) -> DataFrame:
    """Full outer join where left wins field by field; the flags in `either` hold if either side has them."""
    names = list(dict.fromkeys([*left.columns, *right.columns]))
    a, b = left.select(key, F.struct(*[c for c in left.columns if c != key]).alias("a")), right.select(key, F.struct(*[c for c in right.columns if c != key]).alias("b"))
    j = a.join(b, key, "full_outer")

    def field(c):
        sides = [F.col(f"{s}.{c}") for s, df in (("a", left), ("b", right)) if c in df.columns]
        return (F.coalesce(sides[0], F.lit(False)) | F.coalesce(sides[-1], F.lit(False)) if c in either else F.coalesce(*sides)).alias(c)

    return j.select(*(F.col(key) if c == key else field(c) for c in names))


def edges(products: DataFrame, column: str = "competitor_product_ids", key: str = "product_id") -> DataFrame:
    """Competitor edges out of a list separated by semicolons or commas; no edge to itself."""
    e = products.select(key, F.explode(F.split(F.translate(column, ";", ","), ",")).alias("competitor_id")).withColumn("competitor_id", F.trim("competitor_id"))
    return e.where((F.col("competitor_id") != "") & (F.col("competitor_id") != F.col(key))).distinct()


def unknown(rows: DataFrame, known: DataFrame, key: str, known_key: str | None = None) -> DataFrame:
    """The rows whose key is not known; a null key is unknown."""
    ids = known.select(F.col(known_key or key).alias("__known"))
    return rows.join(ids, F.col(key) == F.col("__known"), "left_anti")


def with_seen(rows: DataFrame, known: DataFrame, key: str, known_key: str | None = None) -> DataFrame:
    """Adds seen: whether the key is known."""
    ids = known.select(F.col(known_key or key).alias(key)).distinct().withColumn("seen", F.lit(True))
    return rows.join(ids, key, "left").withColumn("seen", F.coalesce("seen", F.lit(False)))


def balanced(rows: DataFrame, quotas: dict[str, int], most: int, quality: list, product: str = "product_id", rating: str = "rating") -> DataFrame:
    """Up to a quota of each rating per product, best first, then filled up to `most` from what is left.

    A row that has more than `most` better ones beside the quota of its own rating can't fill; such rows go before a
    product's ratings meet, so that the second window has a bounded number of rows for each rating of a product.
    """
    quota = F.coalesce(F.create_map(*(F.lit(x) for kv in quotas.items() for x in kv))[F.col(rating)], F.lit(0))
    r = rows.withColumn("__nth", F.row_number().over(W.partitionBy(product, rating).orderBy(*quality))).where(F.col("__nth") <= max(quotas.values(), default=0) + most)
    r = r.withColumn("__in", F.col("__nth") <= quota).drop("__nth")
    r = r.withColumn("__all", F.row_number().over(W.partitionBy(product).orderBy(F.desc("__in"), *quality)))
    return r.where(F.col("__in") | (F.col("__all") <= most)).drop("__in", "__all")
