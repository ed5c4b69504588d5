"""Sources and sinks: review and catalogue CSV, catalogue JSON, RSS, saved HTML pages, exports."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import parse as pr
from brindle.functions import text as tf


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; headers without byte-order mark, white space and escaped underscores."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', encoding="UTF-8")
    return df.toDF(*(c.replace("﻿", "").replace("\\_", "_").strip() for c in df.columns))


def reviews(rows: DataFrame) -> DataFrame:
    """CSV rows to typed reviews: column aliases, generated ids, and an `error` for rows that can't be imported."""
    have = set(rows.columns)
    first = lambda *names: tf.first_filled(*(F.col(n) for n in names if n in have)) if any(n in have for n in names) else F.lit(None).cast("string")
    product = F.replace(F.lower(first("product_id")), F.lit(" "), F.lit("_"))
    out = rows.select(
        first("review_id").alias("given_id"), product.alias("product_id"), first("product_name", "model").alias("product_name"), first("brand").alias("brand"), first("source", "marketplace").alias("source"), first("marketplace").alias("marketplace"),
        first("marketplace_product_id", "asin", "fsn").alias("marketplace_product_id"), first("marketplace_review_id", "external_review_id").alias("marketplace_review_id"), first("source_url", "review_url", "product_url").alias("source_url"),
        first("reviewer_hash", "reviewer_id").alias("reviewer_hash"), first("review_title", "title").alias("review_title"), first("rating").alias("rating_text"), first("review_date", "date").alias("date_text"), first("raw_text", "review_text", "body").alias("raw_text"),
        tf.tri_state(first("verified_purchase")).alias("verified_purchase"), first("helpful_votes").alias("votes_text"),
    )
    seed_known = F.concat_ws("|", F.coalesce("source", F.lit("unknown_source")), F.coalesce("marketplace_product_id", "product_id"), "marketplace_review_id")
    seed = F.concat_ws("|", F.coalesce("source", F.lit("unknown_source")), F.coalesce("marketplace_product_id", "product_id"), F.coalesce("date_text", F.lit("unknown_date")), F.coalesce("reviewer_hash", F.lit("unknown_reviewer")), "raw_text")
    out = out.withColumn("review_id", F.coalesce("given_id", pr.uuid5_url(F.when(F.col("marketplace_review_id").isNotNull(), seed_known).otherwise(seed))))
    out = out.withColumn("rating", F.col("rating_text").try_cast("double")).withColumn("helpful_votes", tf.int_via_float(F.col("votes_text"))).withColumn("review_date", pr.iso_date(F.col("date_text")))
    error = F.when(F.col("product_id").isNull(), "product_id is empty").when(F.col("raw_text").isNull(), "raw_text is empty").when(F.col("rating_text").isNotNull() & F.col("rating").isNull(), "rating is not a number").when((F.col("rating") < 0) | (F.col("rating") > 5), "rating out of range").when(F.col("votes_text").isNotNull() & F.col("helpful_votes").isNull(), "helpful_votes is not a number")
    return out.withColumn("error", error).drop("given_id", "rating_text", "votes_text", "date_text")


def read_catalogue_json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """A JSON array of products, or a product a line as `write_catalogue_json` has it; bad JSON gives no rows; rows of comments (keys that begin with _) are left out."""
    df = spark.read.schema(f"{schema}, _bad string").json(path, multiLine=not lines, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
    return df.where("product_id is not null").drop("_bad")


def write_catalogue_json(df: DataFrame, path: str) -> None:
    df.orderBy("product_id").write.mode("overwrite").json(path)


def rss(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """Feed texts to items with title and link: markup out of the summary, the header's own calendar date."""
    item = "struct<title:string,link:string,description:string,pubDate:string>"
    items = F.from_xml(F.col(xml), f"channel struct<item:array<{item}>>, item array<{item}>", {"mode": "PERMISSIVE"})
    df = feeds.withColumn("x", items).withColumn("i", F.explode(F.coalesce("x.channel.item", "x.item"))).drop("x", xml)
    strip = F.trim(F.regexp_replace(F.regexp_replace(tf.unescape_basic(F.coalesce("i.description", F.lit(""))), "<[^>]+>", " "), r"\s+", " "))
    df = df.select("*", F.trim("i.title").alias("title"), F.trim("i.link").alias("url"), strip.alias("summary"), pr.feed_date(F.col("i.pubDate")).alias("published_date")).drop("i")
    return df.where("title <> '' and url <> ''")


_CARD = re.compile(r'<(?:div|li)[^>]*data-hook="review"[^>]*>(.*?)(?=<(?:div|li)[^>]*data-hook="review"|\Z)', re.S)


def review_pages(pages: DataFrame, key: str = "page_id", page: str = "html") -> DataFrame:
    """Saved review pages to rows (key, rating_text, title, body, date_text, votes_text, verified); cards without body are left out."""

    def hook(card: str, name: str) -> str:
        m = re.search(rf'data-hook="{name}"[^>]*>(.*?)</(?:span|i|a|div|p)>', card, re.S)
        return " ".join(html.unescape(re.sub(r"<[^>]+>", " ", m[1])).split()) if m else ""

    def run(frames):
        for f in frames:
            rows = [(k, hook(c, "review-star-rating"), hook(c, "review-title"), body, hook(c, "review-date"), hook(c, "helpful-vote-statement"), "Verified Purchase" in c) for k, h in zip(f[key], f[page]) for c in _CARD.findall(h or "") if (body := hook(c, "review-body"))]
            yield pd.DataFrame(rows, columns=[key, "rating_text", "title", "body", "date_text", "votes_text", "verified"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, page).mapInPandas(run, f"{key} {kind}, rating_text string, title string, body string, date_text string, votes_text string, verified boolean")


def page_text(page: str = "html"):
    """Title and visible text of a page as built-in expressions."""
    p = F.col(page)
    body = F.regexp_replace(F.regexp_replace(p, r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>", " "), "<[^>]+>", " ")
    return F.struct(F.trim(F.regexp_extract(p, r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), F.trim(F.regexp_replace(tf.unescape_basic(body), r"\s+", " ")).alias("body"))


def tabs(raw: DataFrame, processed: DataFrame, aspects: DataFrame, products: DataFrame, daily: DataFrame, since: str) -> dict[str, DataFrame]:
    """The four tabs of a spreadsheet export: catalogue, raw reviews, aspect mentions and the daily summary, from a day on."""
    p = products.select("product_id", F.col("brand").alias("brand"))
    recent = raw.where((F.coalesce("duplicate_status", F.lit("canonical")) == "canonical") & (F.col("review_date") >= F.lit(since).cast("date"))).drop("brand").join(p, "product_id", "left")
    language = processed.select("review_id", F.when(F.col("primary_language") == "hi_en_mixed", "Yes").otherwise("No").alias("is_hinglish"))
    mentions = aspects.select("review_id", "sentiment", F.col("aspect").alias("main_aspect"), F.col("evidence_span").alias("key_phrase"), "confidence").join(recent, "review_id").join(language, "review_id", "left")
    shown = lambda df, *columns: df.select(*(tf.shown(F.col(c)).alias(c) for c in columns))
    head = ("review_date", "product_name", "brand", "source", "rating")
    return {
        "Catalog": products, "Raw Reviews": shown(recent.withColumn("verified_purchase", tf.yes_no(F.col("verified_purchase"))), *head, "raw_text", "verified_purchase"),
        "Processed Sentiment": shown(mentions.withColumn("is_hinglish", F.coalesce("is_hinglish", F.lit("No"))), *head, "sentiment", "main_aspect", "key_phrase", "confidence", "is_hinglish"),
        "Daily Summary": daily.where(F.col("review_date") >= F.lit(since).cast("date")),
    }


def write_report(rows: DataFrame, counts: DataFrame, examples: DataFrame, folder: str) -> dict:
    """Kept rows as CSV and a JSON report (one row of counts, a bounded list of examples) under folder; returns the counts."""
    rows.write.mode("overwrite").csv(f"{folder}/rows", header=True)
    many = F.struct(*examples.columns)
    report = counts.join(F.broadcast(examples.agg(F.collect_list(many).alias("examples"))))  # one row each
    report.coalesce(1).write.mode("overwrite").json(f"{folder}/report")
    return counts.first().asDict()


def export(frames: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """Each frame as CSV under folder; one that fails doesn't stop the others. Returns an error text by name."""
    failed = {}
    for name, df in frames.items():
        try:
            df.write.mode("overwrite").csv(f"{folder}/{name}", header=True)
        except Exception as e:  # noqa: BLE001  reported to the caller
            failed[name] = str(e)[:200]
    return failed
