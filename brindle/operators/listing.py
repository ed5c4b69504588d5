"""Lists as services show them: optional filters, search, period with default bounds, order and page size.

A limit here is the page size that the caller asks for; ties are broken by a key, so a page is the same on every run.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.functions import text as tf
from brindle.operators.summary import latest_by


def matching(df: DataFrame, **wanted) -> DataFrame:
    """Rows that equal every value given; None asks for nothing."""
    for c, value in wanted.items():
        df = df if value is None else df.where(F.col(c) == F.lit(value))
    return df


def search(df: DataFrame, term: str | None, *columns: str) -> DataFrame:
    """Rows with the term inside a column, whatever the case; arrays are searched as a text. % and _ are wildcards, as in LIKE."""
    if not term:
        return df
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    texts = (F.array_join(c, " ") if kinds[c] == "array" else F.col(c) for c in columns)
    return df.where(reduce(or_, (F.coalesce(F.ilike(t, F.lit(f"%{term}%")), F.lit(False)) for t in texts)))


def of_types(df: DataFrame, *types: str, column: str = "term_type") -> DataFrame:
    return df.where(F.col(column).isin(*types))


def page(df: DataFrame, order: list, limit: int | None = None) -> DataFrame:
    df = df.orderBy(*order)
    return df if limit is None else df.limit(limit)


def feedback(rows: DataFrame, limit: int = 100, **wanted) -> DataFrame:
    """The latest feedback of each identity, newest first."""
    key = F.coalesce("provider", F.lit(""))
    latest = latest_by(rows.withColumn("__provider", key), ["review_id", "product_id", "aspect", "predicted_sentiment", "__provider"], ["id"]).drop("__provider")
    return page(matching(latest, **wanted), [F.desc("created_at"), F.desc("id")], limit)


def newest(rows: DataFrame, seen: str, limit: int = 100, **wanted) -> DataFrame:
    """Sources, duplicates and golden cases: last seen or created first."""
    return page(matching(rows, **wanted), [F.desc(seen), F.desc("id")], limit)


def lexicon(rows: DataFrame, term: str | None = None, limit: int = 200, **wanted) -> DataFrame:
    found = matching(search(rows, term, "term", "normalized_term", "examples"), **wanted)
    return page(found, [F.desc("approved"), F.desc("confidence"), "aspect", "term"], limit)


def queue(rows: DataFrame, status: str = "open", product_id: str | None = None, limit: int = 100) -> DataFrame:
    return page(matching(rows, status=status, product_id=product_id), [F.desc("priority_score"), F.desc("created_at"), "id"], limit)


def news(rows: DataFrame, source_id: str | None = None, least: float | None = None, limit: int = 50) -> DataFrame:
    found = matching(rows, source_id=source_id)
    found = found if least is None else found.where(F.col("relevance_score") >= least)
    return page(found, [F.desc("relevance_score"), F.desc("published_at"), F.desc("ingested_at")], limit)


def competitors(rows: DataFrame) -> DataFrame:
    return page(rows, ["comparison_group", "product_name", "competitor_id"])


def catalogue(rows: DataFrame, own: bool | None = None) -> DataFrame:
    """All products, own ones or others, by brand and name."""
    return page(matching(rows.withColumn("is_own_product", F.coalesce("is_own_product", F.lit(False))), is_own_product=own), [F.coalesce("brand", F.lit("")), F.coalesce("product_name", F.lit("")), "product_id"])


def visible(rows: DataFrame, hidden: list[str], words: list[str], allowed: list[str] | None = None) -> DataFrame:
    """Products without demo ids and names, of the allowed ids alone where such a list is given; own ones first."""
    low = F.lower(F.coalesce("product_name", F.lit("")))
    shown = rows.where(~F.col("product_id").isin(*hidden))
    for w in words:
        shown = shown.where(~F.contains(low, F.lit(w)))
    shown = shown if allowed is None else shown.where(F.col("product_id").isin(*allowed))
    return page(shown, [F.desc("own_brand"), "brand", "product_name", "product_id"])


def recent(rows: DataFrame, as_of: str, days: int, date: str = "review_date") -> DataFrame:
    """Rows of the last days up to a day, both included; rows without a date don't count."""
    end = F.lit(as_of).cast("date")
    return rows.where((F.col(date) >= F.date_sub(end, days)) & (F.col(date) <= end))


def capped(rows: DataFrame, most: int, by: str, *order) -> DataFrame:
    """The first `most` rows of each group."""
    return rows.withColumn("__k", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("__k") <= most).drop("__k")


def within(rows: DataFrame, **bounds: tuple) -> DataFrame:
    """Rows whose values lie between the bounds given (None is open); a value that is missing is let through."""
    for c, (low, high) in bounds.items():
        for ok in ([F.col(c) >= low] if low is not None else []) + ([F.col(c) <= high] if high is not None else []):
            rows = rows.where(F.col(c).isNull() | ok)
    return rows


def lookup(rows: DataFrame, key: str, value, active: str | None = None) -> DataFrame:
    """The row of a key: none for an unknown one, nor for one that is marked inactive."""
    found = rows.where(F.col(key) == F.lit(value))
    return found if active is None else found.where(F.coalesce(active, F.lit(False)))


def period(df: DataFrame, start: str | None = None, end: str | None = None, date: str = "review_date") -> DataFrame:
    """Rows of the period, with period_start, period_end and period_label; a missing bound is that of the data, a reversed period is turned round.

    Rows without a date don't count.
    """
    bounds = df.agg(F.min(date).alias("__lo"), F.max(date).alias("__hi"))
    a, b = (F.coalesce(F.lit(x).cast("date"), F.col(c)) for x, c in ((start, "__lo"), (end, "__hi")))
    bounds = bounds.select(F.least(a, b).alias("period_start"), F.greatest(a, b).alias("period_end"))
    label = f"{start or 'beginning'} to {end or 'latest'}" if start or end else "all_available_dated_reviews"
    out = df.join(F.broadcast(bounds), (F.col(date) >= F.col("period_start")) & (F.col(date) <= F.col("period_end")))  # one row
    return out.withColumn("period_label", F.lit(label))


def evidence(aspects: DataFrame, raw: DataFrame, processed: DataFrame, limit: int | None = 50, hinglish: bool | None = None, **wanted) -> DataFrame:
    """Aspect mentions with their review in 15 columns and the kind of language; the best evidence first."""
    j = matching(aspects, **wanted).join(raw.drop("product_id"), "review_id").join(processed, "review_id")
    j = j.select(
        "review_id", "product_id", "product_name", "source", "rating", "review_date", "raw_text", "clean_text", "quality_score", "aspect", "sentiment", "intensity", "confidence", "evidence_span", "provider",
        tf.evidence_language(F.coalesce("raw_text", F.lit(""))).alias("language_type"),
    )
    if hinglish is not None:
        j = j.where((F.col("language_type") != "english") == F.lit(hinglish))
    return page(j, [F.desc("quality_score"), F.desc("confidence"), F.desc("review_date"), "review_id", "aspect"], limit)


def forecast_order() -> list[Column]:
    """High confidence first, then medium, then mentions and strength of the score."""
    label = F.col("confidence_label")
    return [F.desc(label == "high"), F.desc(label == "medium"), F.desc("current_mentions"), F.desc(F.abs("current_score")), F.asc("aspect")]


def best_and_worst(aspects: DataFrame, k: int = 3, by: str = "product_id") -> DataFrame:
    """(product, kind, place, aspect, ...): the k best strengths and worst risks of each product, by score and mentions."""
    some = aspects.where((F.col("mentions") > 0) & (F.col("aspect_score") != 0))
    kind = F.when(F.col("aspect_score") > 0, "strength").otherwise("risk")
    w = W.partitionBy(by, "kind").orderBy(F.desc(F.abs("aspect_score")), F.desc("mentions"), "aspect")
    return some.withColumn("kind", kind).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


# What marks a bullet of internals, and how theme bullets are worded on screen
INTERNAL = ("has 1 review", "has 2 review", "has 3 review", "net sentiment score", "top delight signal", "top complaint signal", "in the selected period with average rating")
WORDING = ((r"(?i):\s*Camera delight theme\.?", " is showing early delight."), (r"(?i):\s*Battery complaint theme\.?", " is the main complaint area to validate."))


def readable_bullets(bullets: DataFrame, column: str = "bullet", names: dict[str, str] | None = None) -> DataFrame:
    """Bullets as a screen shows them: none of internals, themes reworded, ids of products replaced by the names given."""
    t = F.col(column)
    shown = bullets.where(~tf.has_any(F.lower(t), list(INTERNAL)))
    for pattern, to in (*WORDING, *((rf"(?i)\b{k}\b", v) for k, v in (names or {}).items())):
        t = F.regexp_replace(t, pattern, to)
    return shown.withColumn(column, F.trim(t))
