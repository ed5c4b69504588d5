"""Imports and their reports: catalogue records, counters, cleaned and normalised reviews, discovered products, appended files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.functions import identity as idn
from brindle.functions import text as tf
from brindle.operators.mutate import upsert
from brindle.operators.resolve import similar
from brindle.operators.summary import first_by, latest_by

# Fields of a catalogue record in order, and the other headers under which a field may come
FIELDS = [
    "product_id", "company_name", "brand", "product_name", "model_name", "series_name", "canonical_product_key", "normalized_brand", "normalized_model_key", "variant_key", "is_own_product", "launch_date",
    "launch_market", "price_band", "current_price", "ram", "storage", "battery_capacity", "charging_wattage", "chipset", "display_size", "display_type", "refresh_rate", "screen_to_body_ratio",
    "rear_camera", "front_camera", "android_version", "custom_ui", "network_5g", "weight", "thickness", "official_url", "marketplace_url", "source_name", "source_confidence", "updated_at",
]
OTHER_HEADERS = {"product_name": "name", "series_name": "series", "launch_market": "market", "current_price": "price", "battery_capacity": "battery", "charging_wattage": "charging", "chipset": "processor"}
DEFAULTS = {"source_name": "manual_catalog", "source_confidence": "manual_pending"}
TEXTS = ["raw_text", "review_text", "review", "comment", "comments", "body", "text", "content"]
NAMES = ["product_name", "product", "model_name", "model", "title", "item_name"]


def _first(have: list[str], names: list[str]) -> Column:
    """The first of the columns named that holds more than a null word."""
    found = [tf.null_token(F.col(n).cast("string")) for n in names if n in have]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def catalogue_records(rows: DataFrame, updated_at: Column, owner: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """CSV rows (all text) as records of 36 fields, with `competitor_product_ids` and `skip`: 'empty row', 'missing product_name' or null.

    owner: the company of products whose brand is one's own, where none is given; keep: columns that are no fields and are carried along.
    """
    have = [c for c in rows.columns if c not in keep]
    given = {f: _first(have, [f, *([OTHER_HEADERS[f]] if f in OTHER_HEADERS else [])]) for f in FIELDS}
    given["model_name"] = F.coalesce(_first(have, ["model_name", "model"]), given["product_name"])
    empty = F.coalesce(*(tf.null_token(F.col(c).cast("string")) for c in have)).isNull()
    flag = tf.tri_state(F.col("is_own_product").cast("string"), tf.CATALOGUE_FLAGS) if "is_own_product" in have else F.lit(None).cast("boolean")
    rest = _first(have, ["competitor_product_ids"])
    r = rows.select(*keep, *(given[f].alias(f) for f in FIELDS if f not in ("is_own_product", "updated_at")), flag.alias("is_own_product"), rest.alias("competitor_product_ids"), empty.alias("empty"))
    r = idn.with_identity(r, "product_name", "brand", "model_name", out="i")
    known = F.col("i.brand")
    own = F.coalesce("is_own_product", known.isin(*idn.OWN), F.lit(False))
    title = F.when(known.isin("tecno", "itel"), F.upper(known)).otherwise(F.initcap(known))
    made = {
        "product_id": F.coalesce("product_id", "i.product_id"), "company_name": F.coalesce("company_name", F.when(own, F.lit(owner))), "brand": F.coalesce("brand", title), "canonical_product_key": F.col("i.canonical_key"),
        "normalized_brand": known, "normalized_model_key": F.col("i.model_key"), "variant_key": F.coalesce("variant_key", "i.variant"), "is_own_product": own, "updated_at": updated_at,
    } | {f: F.coalesce(f, F.lit(v)) for f, v in DEFAULTS.items()}
    skip = F.when(F.col("empty"), "empty row").when(F.col("product_name").isNull(), "missing product_name")
    return r.select(*keep, *((made[f] if f in made else F.col(f)).alias(f) for f in FIELDS), "competitor_product_ids", skip.alias("skip"))


def import_catalogue(records: DataFrame, stored: DataFrame, order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(the catalogue after the import, one row of counts).

    The last record of an id replaces all fields of the stored one; the first of an id that isn't stored counts as imported, every other as updated.
    """
    good = records.where("skip is null")
    known = stored.select("product_id", F.lit(True).alias("known")).distinct()
    nth = F.row_number().over(W.partitionBy("product_id").orderBy(order))
    marked = records.withColumn("nth", nth).join(known, "product_id", "left")
    new = F.col("skip").isNull() & F.col("known").isNull()
    first = F.min(F.when(F.col("skip").isNull(), F.col("nth"))).over(W.partitionBy("product_id"))
    marked = marked.withColumn("imported", new & (F.col("nth") == first))
    edges = F.size(F.filter(F.split(F.coalesce("competitor_product_ids", F.lit("")), ";"), lambda x: F.trim(x) != ""))
    n = lambda c: F.count(F.when(c, 1))
    counts = marked.agg(
        n(F.col("imported")).alias("imported_count"), n(F.col("skip").isNull() & ~F.col("imported")).alias("updated_count"), n(F.col("skip").isNotNull()).alias("skipped_count"),
        F.countDistinct(F.when(F.col("skip").isNull(), F.col("product_id"))).alias("products"), F.coalesce(F.sum(F.when(F.col("skip").isNull(), edges)), F.lit(0)).alias("imported_mappings"),
    )
    after = upsert(stored, latest_by(good, ["product_id"], [order]).select(*stored.columns), ["product_id"], keep_stored=False)
    return after, counts


def import_report(decided: DataFrame, failed: DataFrame, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """(one row of counts, up to `most` errors) of an import: decided by `mutate.ingest`, failed: (row_number, reason).

    A row whose source is known counts as a duplicate; one that repeats another review's text counts as a possible duplicate too.
    """
    n = lambda *s: F.count(F.when(F.col("status").isin(*s), 1))
    counts = decided.agg(
        n("insert").alias("imported_count"), n("attach", "touch").alias("skipped_duplicate_count"), n("attach", "touch").alias("attached_source_count"), n("attach").alias("possible_duplicate_count"),
        F.array_join(F.array_sort(F.collect_set("product_id")), ",").alias("product_ids"),
    )
    counts = counts.join(F.broadcast(failed.agg(F.count("*").alias("failed_count"))))  # one row each
    return counts, failed.orderBy("row_number").limit(most)


def counts_by(rows: DataFrame, column: str = "status") -> DataFrame:
    return rows.groupBy(F.col(column).alias("reason")).agg(F.count("*").alias("n"))


def clean_report(cleaned: DataFrame, order: str = "seq", most: int = 20) -> tuple[DataFrame, DataFrame]:
    """(input, clean, removed and duplicate counts; the first `most` removed rows with their reason) of `quality.clean_reviews`."""
    kept = F.col("status").isin("clean", "duplicate")
    n = lambda c: F.count(F.when(c, 1))
    counts = cleaned.agg(F.count("*").alias("input_count"), n(F.col("status") == "clean").alias("clean_count"), n(~kept).alias("removed_count"), n(F.col("status") == "duplicate").alias("duplicate_count"))
    return counts, cleaned.where(~kept).orderBy(order).limit(most)


def batch_fingerprint(product: Column, text: Column, rating: Column, date: Column) -> Column:
    """Product, text of a-z and digits alone, rating and date as one hash; letters of other scripts don't count."""
    plain = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))
    return F.sha2(F.concat_ws("|", product, plain, F.coalesce(rating, F.lit("")), F.coalesce(date, F.lit(""))), 256)


def normalise_reviews(rows: DataFrame, catalogue: DataFrame, order: str = "row_number") -> DataFrame:
    """Messy review rows (all text) against a catalogue (product_id, product_name, brand): status and the review's own columns.

    status: skipped (no text), unresolved, duplicate (of an earlier row of the batch) or kept. A product is found by its id, by the id
    or canonical key that its name gives, by a model key that one product has, or by the likeness of model (.88) or canonical key (.82).
    """
    have = rows.columns
    pick = lambda *names: _first(have, list(names))
    r = rows.select(
        F.col(order).alias("__order"), _first(have, TEXTS).alias("raw_text"), pick("product_id").alias("__id"), _first(have, NAMES).alias("__name"), pick("brand").alias("__brand"), pick("rating", "stars", "score").alias("rating"),
        pick("review_date", "date", "created_at").alias("review_date"), F.coalesce(pick("marketplace", "source_marketplace"), F.lit("manual_csv")).alias("marketplace"),
        F.coalesce(pick("source"), F.lit("catalog_normalized_csv")).alias("source"), pick("review_id", "id").alias("review_id"),
    )
    r = idn.with_identity(r, "__name", "__brand", out="__i")
    cat = first_by(catalogue.select("product_id", "product_name", "brand"), ["product_id"], ["product_name"])
    cat = idn.with_identity(cat, "product_name", "brand", out="i").select(F.col("product_id").alias("cid"), F.col("product_name").alias("cname"), F.col("brand").alias("cbrand"), "i.model_key", "i.canonical_key")
    ids = cat.select("cid")
    key = cat.groupBy("canonical_key").agg(F.min("cid").alias("by_key"))
    model = cat.groupBy("model_key").agg(F.min("cid").alias("by_model"), F.count("*").alias("n")).where("n = 1").drop("n")
    r = r.join(ids.withColumnRenamed("cid", "by_id"), F.col("__id") == F.col("by_id"), "left").join(ids.withColumnRenamed("cid", "by_name"), F.col("__i.product_id") == F.col("by_name"), "left")
    r = r.join(key, F.col("__i.canonical_key") == F.col("canonical_key"), "left").join(model, F.col("__i.model_key") == F.col("model_key"), "left").drop("canonical_key", "model_key")
    named = F.col("__name").isNotNull()
    sure = F.coalesce("by_id", F.when(named, F.coalesce("by_name", "by_key", "by_model")))
    open_ = r.where(sure.isNull() & named & F.col("raw_text").isNotNull())
    near_model = similar(open_.select(F.col("__i.model_key").alias("asked")), cat.select("cid", F.col("model_key").alias("name")), 0.88).select(F.col("asked").alias("m"), F.col("cid").alias("near_model"))
    near_key = similar(open_.select(F.col("__i.canonical_key").alias("asked")), cat.select("cid", F.col("canonical_key").alias("name")), 0.82).select(F.col("asked").alias("k"), F.col("cid").alias("near_key"))
    r = r.join(near_model, F.col("__i.model_key") == F.col("m"), "left").join(near_key, F.col("__i.canonical_key") == F.col("k"), "left")
    r = r.withColumn("product_id", F.coalesce(sure, F.when(named, F.coalesce("near_model", "near_key")))).join(cat.select(F.col("cid").alias("product_id"), "cname", "cbrand"), "product_id", "left")
    r = r.withColumn("fingerprint", batch_fingerprint(F.col("product_id"), F.col("raw_text"), F.col("rating"), F.col("review_date")))
    open_status = F.when(F.col("raw_text").isNull(), "skipped").when(F.col("product_id").isNull(), "unresolved")
    r = r.withColumn("__open", open_status)
    nth = F.row_number().over(W.partitionBy(F.coalesce("__open", "fingerprint"), F.when(F.col("__open").isNotNull(), F.pmod(F.xxhash64("__order"), F.lit(1024)))).orderBy("__order"))
    r = r.withColumn("status", F.coalesce("__open", F.when(nth > 1, "duplicate").otherwise("kept")))
    return r.select(
        F.col("__order").alias(order), "status", F.coalesce("review_id", F.concat(F.lit("norm_"), F.substring("fingerprint", 1, 16))).alias("review_id"), "product_id", F.coalesce("cname", "__name", "product_id").alias("product_name"),
        F.coalesce("cbrand", "__brand").alias("brand"), "source", "marketplace", "raw_text", F.coalesce("rating", F.lit("")).alias("rating"), F.coalesce("review_date", F.lit("")).alias("review_date"),
    )


def new_products(found: DataFrame, known: DataFrame, order: str = "seq") -> DataFrame:
    """Discovered products (brand, model_name) with product_id, the first of each id, and of those the ones that aren't known."""
    from brindle.functions.parse import slug

    named = found.withColumn("product_id", slug(F.concat_ws(" ", F.coalesce("brand", F.lit("")), F.coalesce("model_name", F.lit("")))))
    return first_by(named, ["product_id"], [order]).join(known.select("product_id"), "product_id", "left_anti")


def append_new(static: DataFrame, live: DataFrame, key: str = "product_id") -> DataFrame:
    """The curated rows, and the live ones whose key they lack."""
    fresh = live.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").join(static.select(key), key, "left_anti")
    return static.unionByName(fresh, allowMissingColumns=True)


def scraped_csv(rows: DataFrame, price_band: str = "") -> DataFrame:
    """Scraped reviews as the columns of a review CSV."""
    have = rows.columns
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")
    flag = F.coalesce(F.col("verified_purchase").cast("boolean"), F.lit(False)) if "verified_purchase" in have else F.lit(False)
    votes = F.coalesce(F.col("helpful_votes").cast("int"), F.lit(0)) if "helpful_votes" in have else F.lit(0)
    return rows.select(
        *(text(c).alias(c) for c in ("review_id", "source", "product_id", "product_name", "brand", "review_date", "rating", "title", "raw_text")), F.when(flag, "TRUE").otherwise("FALSE").alias("verified_purchase"),
        votes.alias("helpful_votes"), F.coalesce(F.nullif(text("price_band"), F.lit("")), F.lit(price_band)).alias("price_band"), F.coalesce(F.nullif(text("marketplace"), F.lit("")), text("source")).alias("marketplace"),
    )


def append_csv(df: DataFrame, folder: str) -> None:
    """Adds rows to a folder of CSV files: every file has its header, which readers skip."""
    df.write.mode("append").option("header", True).csv(folder)


def reset(tables: dict[str, DataFrame], keep: tuple[str, ...] = ("living_lexicon",)) -> dict[str, DataFrame]:
    """All tables without rows but those kept: what to write after a reset of review data."""
    return {n: df if n in keep else df.limit(0) for n, df in tables.items()}


def reseed(stored: DataFrame, seeds: DataFrame, key: str = "source_id") -> DataFrame:
    """The sources with all fields of the seeds, which become active again; sources that aren't seeds stay as they are."""
    return upsert(stored, seeds.withColumn("is_active", F.lit(True)).select(*stored.columns), [key], keep_stored=False)


def migrate(df: DataFrame, schema: dict[str, str], renamed: dict[str, str] | None = None, fill: dict[str, Column] | None = None) -> DataFrame:
    """Rows of an older layout in the current one: renamed columns, new ones null or filled, cast to their types; others are left out."""
    df = df.withColumnsRenamed(renamed or {})
    old = {c: F.col(c) for c in df.columns}
    value = lambda c: (fill or {}).get(c, old.get(c, F.lit(None)))
    return df.select(*(value(c).cast(t).alias(c) for c, t in schema.items()))
