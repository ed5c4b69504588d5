"""Aggregations over aspect facts and reviews.

facts: review_id, product_id, aspect, sentiment, intensity, confidence, review_date, evidence.
Every aggregation combines on the map side; averages come from exact decimal sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.functions.scores import mean, rounded, signed


def _n(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def in_period(df: DataFrame, start: str | None = None, end: str | None = None, date: str = "review_date") -> DataFrame:
    """Rows from start to end, both included; either may be left open."""
    if start:
        df = df.where(F.col(date) >= F.lit(start).cast("date"))
    return df.where(F.col(date) <= F.lit(end).cast("date")) if end else df


def product_summary(reviews: DataFrame, by: str = "product_id") -> DataFrame:
    return reviews.groupBy(by).agg(
        F.count("*").alias("review_count"), rounded(mean(F.col("rating")), 2).alias("average_rating"), rounded(mean(F.col("quality_score")), 3).alias("average_quality"),
        _n(F.col("contradiction_flag")).alias("contradictions"), _n(F.col("sarcasm_flag")).alias("sarcasm"),
    )


def sentiment_counts(facts: DataFrame, by: str = "product_id") -> DataFrame:
    return facts.groupBy(by, "sentiment").agg(F.count("*").alias("n"), rounded(mean(F.col("intensity")), 3).alias("avg_intensity"))


def net_sentiment(facts: DataFrame, by: str = "product_id") -> DataFrame:
    """Signed intensity per mention times 100; a sentiment whose mean intensity is 0 counts with a half."""
    per = facts.groupBy(by, "sentiment").agg(F.count("*").alias("n"), mean(F.col("intensity")).alias("i"))
    weight = F.when(F.col("i") == 0, 0.5).otherwise(F.col("i")) * F.col("n")
    total = F.sum(F.when(F.col("sentiment") == "positive", weight).otherwise(0.0)) - F.sum(F.when(F.col("sentiment") == "negative", weight).otherwise(0.0))
    return per.groupBy(by).agg(rounded(total / F.sum("n") * 100, 1).alias("net_sentiment"))


def top_aspects(facts: DataFrame, k: int = 5, by: str = "product_id") -> DataFrame:
    counts = facts.groupBy(by, "aspect").agg(F.count("*").alias("mentions"))
    return counts.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy(F.desc("mentions"), "aspect"))).where(F.col("place") <= k)


def aspect_summary(facts: DataFrame, *by: str) -> DataFrame:
    """Mentions, counts by sentiment, mean confidence and score (mean signed intensity times 100)."""
    score = F.sum(signed(F.col("sentiment"), F.col("intensity").cast("decimal(18,6)"))).cast("double") / F.count("*") * 100
    return facts.groupBy(*(by or ("product_id", "aspect"))).agg(
        F.count("*").alias("mentions"), _n(F.col("sentiment") == "positive").alias("positive_count"), _n(F.col("sentiment") == "negative").alias("negative_count"),
        _n(~F.col("sentiment").isin("positive", "negative")).alias("neutral_count"), rounded(mean(F.col("confidence")), 3).alias("avg_confidence"), rounded(score, 1).alias("aspect_score"),
    )


# Sub-aspects in the order in which they are tried
CAMERA = [("camera_front", r"(?i)front[\s\-]?cam|selfie"), ("camera_night", r"(?i)night|low[\s\-]?light|dark(?:ness)?"), ("camera_video", r"(?i)video|reel|recording")]


def sub_aspect_scores(facts: DataFrame, patterns: list[tuple[str, str]] = CAMERA, rest: str = "camera_overall", by: str = "product_id") -> DataFrame:
    """Mean signed intensity times 100 by what the evidence is about; the first pattern that matches counts."""
    name = F.lit(rest)
    for label, pattern in reversed(patterns):
        name = F.when(F.coalesce(F.col("evidence"), F.lit("")).rlike(pattern), label).otherwise(name)
    score = F.sum(signed(F.col("sentiment"), F.col("intensity").cast("decimal(18,6)"))).cast("double") / F.count("*") * 100
    return facts.groupBy(by, name.alias("sub_aspect")).agg(rounded(score, 1).alias("score"), F.count("*").alias("n"))


def theme_groups(facts: DataFrame, by: str = "product_id") -> DataFrame:
    """(aspect, sentiment) groups with severity: count x mean intensity x mean confidence, a quarter more if negative."""
    g = facts.groupBy(by, "aspect", "sentiment").agg(F.count("*").alias("mentions"), rounded(mean(F.col("intensity")), 3).alias("avg_intensity"), rounded(mean(F.col("confidence")), 3).alias("avg_confidence"))
    return g.withColumn("severity", rounded(F.col("mentions") * F.col("avg_intensity") * F.col("avg_confidence") * F.when(F.col("sentiment") == "negative", 1.25).otherwise(1.0), 3))


def themes(facts: DataFrame, k: int = 5, watch_below: float = 0.72, by: str = "product_id") -> DataFrame:
    """The k most severe themes of each family; a theme of low confidence is on the watchlist too."""
    g = theme_groups(facts, by)
    family = F.when(F.col("sentiment") == "negative", "complaint").when(F.col("sentiment") == "positive", "delight").otherwise("watchlist")
    families = F.array_distinct(F.array_compact(F.array(family, F.when(F.col("avg_confidence") < watch_below, "watchlist"))))
    g = g.withColumn("family", F.explode(families))
    place = F.row_number().over(W.partitionBy(by, "family").orderBy(F.desc("severity"), F.desc("mentions"), "aspect", "sentiment"))
    return g.withColumn("place", place).where(F.col("place") <= k)


def evidence_top(facts: DataFrame, k: int = 3, *by: str) -> DataFrame:
    """The k best pieces of evidence of each group in one pass."""
    w = W.partitionBy(*by).orderBy(F.desc("intensity"), F.desc("confidence"), F.desc("review_date"), "review_id", "aspect")
    return facts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def product_list(products: DataFrame, reviews: DataFrame, key: str = "product_id") -> DataFrame:
    """All products with count, first and latest date of their canonical reviews, of none too."""
    canonical = reviews.where(F.coalesce("duplicate_status", F.lit("canonical")) == "canonical")
    agg = canonical.groupBy(key).agg(F.count("*").alias("review_count"), F.min("review_date").alias("first_date"), F.max("review_date").alias("latest_date"))
    return products.join(agg, key, "left").withColumn("review_count", F.coalesce("review_count", F.lit(0)))


def provider_quality(feedback: DataFrame) -> DataFrame:
    """Totals, correct, incorrect and accuracy by provider over the latest feedback of each identity."""
    latest = latest_by(feedback, ["review_id", "product_id", "aspect", "predicted_sentiment", "provider"], ["id"])
    g = latest.groupBy(F.coalesce("provider", F.lit("unknown")).alias("provider")).agg(F.count("*").alias("total"), _n(F.col("is_correct")).alias("correct"), _n(~F.col("is_correct")).alias("incorrect"))
    return g.withColumn("accuracy", rounded(F.col("correct") / F.col("total"), 3))


def latest_by(df: DataFrame, keys: list[str], newest: list[str]) -> DataFrame:
    """The row of each key that is last by `newest`."""
    w = W.partitionBy(*keys).orderBy(*(F.desc(c) for c in newest))
    return df.withColumn("__place", F.row_number().over(w)).where("__place = 1").drop("__place")


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__place", F.row_number().over(w)).where("__place = 1").drop("__place")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def daily_stats(reviews: DataFrame, facts: DataFrame) -> DataFrame:
    """A row per day and product: rating, counts and shares of sentiment, top complaint and top praise."""
    key = ["review_date", "product_id"]
    base = reviews.groupBy(*key).agg(rounded(mean(F.col("rating")), 2).alias("avg_rating"), F.count("*").alias("reviews"))
    mood = facts.groupBy(*key).agg(*(_n(F.col("sentiment") == s).alias(s) for s in ("positive", "negative", "neutral")))
    total = F.greatest(F.col("positive") + F.col("negative") + F.col("neutral"), F.lit(1))
    for s in ("positive", "negative", "neutral"):
        mood = mood.withColumn(f"{s}_pct", rounded(F.col(s) * 100.0 / total, 1)) if s != "neutral" else mood
    out = base.join(mood, key, "left")
    for s, label in (("negative", "top_complaint"), ("positive", "top_praise")):
        counts = facts.where(F.col("sentiment") == s).groupBy(*key, "aspect").count()
        top = first_by(counts.withColumn("less", -F.col("count")), key, ["less", "aspect"]).select(*key, F.col("aspect").alias(label))
        out = out.join(top, key, "left")
    return out


def rating_counts(reviews: DataFrame, by: str = "product_id") -> DataFrame:
    """Rows per product by rating 1 to 5, those of none or another as unknown, and all of them."""
    r = F.regexp_replace(F.coalesce(F.trim(F.col("rating").cast("string")), F.lit("")), r"\.0$", "")
    of = lambda k: _n(r == str(k)).alias(f"r{k}")
    return reviews.groupBy(by).agg(*(of(k) for k in range(1, 6)), _n(~r.isin("1", "2", "3", "4", "5")).alias("unknown"), F.count("*").alias("total"))


# Words by which a text of the feed is about something
FEED_WORDS = ["camera", "battery", "display", "performance", "charging", "heat", "heating", "speaker", "network", "lag", "design", "price", "budget", "value"]


def duplicate_counts(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """How many rows are the first of their key and how many repeat it, and of how many keys."""
    nth = F.row_number().over(W.partitionBy(key).orderBy(*order))
    status = rows.select(key, F.when(nth == 1, "first").otherwise("repeat").alias("status"))
    return status.groupBy("status").agg(F.count("*").alias("n"), F.countDistinct(key).alias("sources"))


def competitor_lists(edges: DataFrame, by: str = "product_id") -> DataFrame:
    """The competitors of each product as a text; a product has as many as its record lists."""
    return edges.groupBy(by).agg(F.array_join(F.array_sort(F.collect_list("competitor_id")), ", ").alias("competitors"))


def scrape_stats(rows: DataFrame, day: str, date: str = "review_date") -> DataFrame:
    return rows.groupBy("source").agg(F.count("*").alias("total"), _n(F.col(date) == F.lit(day).cast("date")).alias("today"))


def sentiment_share(facts: DataFrame, by: str = "product_id") -> DataFrame:
    """Of each sentiment its share of a product's mentions in whole percent, half up."""
    c = facts.groupBy(by, "sentiment").agg(F.count("*").alias("n"))
    return c.select(by, "sentiment", F.floor(F.col("n") * 100.0 / F.sum("n").over(W.partitionBy(by)) + 0.5).alias("pct"))


def source_totals(rows: DataFrame, by: str = "product_id") -> DataFrame:
    """Rows by product and source, by product, and in all."""
    return rows.rollup(by, "source").agg(F.count("*").alias("n"))


def feed_quality(text: Column, title: Column, rating: Column) -> Column:
    """struct(specific, words, titled, rating) by which a feed prefers rows, the largest first."""
    from brindle.functions.text import has_any

    t, head = F.coalesce(text, F.lit("")), F.coalesce(title, F.lit(""))
    words = F.when(F.trim(t) == "", 0).otherwise(F.size(F.split(F.trim(t), r"\s+")))
    return F.struct(
        has_any(F.lower(t), FEED_WORDS).cast("int").alias("specific"), F.least(words, F.lit(80)).alias("words"),
        ((head != "") & (F.lower(head) != F.lower(t))).cast("int").alias("titled"), F.coalesce(rating.cast("string"), F.lit("")).alias("rating"),
    )


def phrases(df: DataFrame, text: str, least: int = 3, most: int = 60, k: int = 40) -> DataFrame:
    """The k most frequent phrases between commas, semicolons and bars (a top-k report)."""
    p = df.select(F.explode(F.split(F.lower(F.col(text)), r"[,;|]")).alias("phrase"), "sentiment").withColumn("phrase", F.trim("phrase"))
    p = p.where((F.char_length("phrase") > least) & (F.char_length("phrase") < most))
    g = p.groupBy("phrase").agg(F.count("*").alias("n"), _n(F.col("sentiment") == "positive").alias("positive"), _n(F.col("sentiment") == "negative").alias("negative"))
    g = g.withColumn("dominant", F.when(F.col("positive") > F.col("negative"), "positive").when(F.col("negative") > F.col("positive"), "negative").otherwise("neutral"))
    return g.orderBy(F.desc("n"), "phrase").limit(k)
