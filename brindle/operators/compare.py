"""Comparisons: product against product, period against period, label against label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.functions import scores as sc
from brindle.operators.summary import aspect_summary


def benchmark(facts: DataFrame, own: str, other: str) -> DataFrame:
    """Aspect by aspect, both products: a full outer join, a missing side counting as no mention."""
    side = lambda p, tag: aspect_summary(facts.where(F.col("product_id") == p), "aspect").select("aspect", F.col("mentions").alias(f"{tag}_mentions"), F.col("aspect_score").alias(f"{tag}_score"), F.col("avg_confidence").alias(f"{tag}_confidence"))
    b = side(own, "own").join(side(other, "other"), "aspect", "full_outer")
    for c in ("own_mentions", "other_mentions"):
        b = b.withColumn(c, F.coalesce(c, F.lit(0)))
    for c in ("own_score", "other_score"):
        b = b.withColumn(c, F.coalesce(c, F.lit(0.0)))
    b = b.withColumn("gap", sc.rounded(F.col("own_score") - F.col("other_score"), 1))
    b = b.withColumn("confidence_label", sc.pair_confidence_label(F.col("own_mentions"), F.col("other_mentions"), F.col("own_confidence"), F.col("other_confidence")))
    return b.withColumn("signal", sc.benchmark_signal(F.col("gap"), F.col("confidence_label"))).withColumn("interpretation", sc.gap_text(F.col("aspect"), F.col("gap"), F.col("confidence_label"), F.col("own_mentions"), F.col("other_mentions")))


def strengths(b: DataFrame, k: int = 3) -> DataFrame:
    """The k largest gaps each way among aspects that both products have."""
    both = b.where("own_mentions > 0 and other_mentions > 0 and gap <> 0").withColumn("kind", F.when(F.col("gap") > 0, "strength").otherwise("weakness"))
    w = W.partitionBy("kind").orderBy(F.desc(F.abs("gap")), F.desc(F.col("own_mentions") + F.col("other_mentions")), "aspect")
    return both.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def forecast(facts: DataFrame, start: str, end: str, by: str = "product_id") -> DataFrame:
    """Direction of each aspect from [start, end] against the period of equal length before it, in one pass.

    A reversed period is turned round; rows without a date don't count.
    """
    lo, hi = F.least(F.lit(start).cast("date"), F.lit(end).cast("date")), F.greatest(F.lit(start).cast("date"), F.lit(end).cast("date"))
    before = F.date_sub(lo, F.datediff(hi, lo) + 1)
    now = F.col("review_date") >= lo
    rows = facts.where((F.col("review_date") >= before) & (F.col("review_date") <= hi))
    value = sc.signed(F.col("sentiment"), F.col("intensity").cast("decimal(18,6)"))
    part = lambda c: F.sum(F.when(c, value)).cast("double") * 100 / F.count(F.when(c, 1))
    g = rows.groupBy(by, "aspect").agg(
        F.count(F.when(now, 1)).alias("current_mentions"), F.count(F.when(~now, 1)).alias("previous_mentions"),
        sc.rounded(part(now), 1).alias("current_score"), sc.rounded(part(~now), 1).alias("previous_score"), sc.mean(F.col("confidence")).alias("c"),
    ).where("current_mentions > 0")
    g = g.withColumn("movement", sc.rounded(F.col("current_score") - F.col("previous_score"), 1))
    g = g.withColumn("direction", sc.direction(F.col("current_score"), F.col("movement")))
    return g.withColumn("confidence_label", sc.confidence_label(F.col("current_mentions") + F.col("previous_mentions"), F.col("c"))).drop("c")


def overall_direction(f: DataFrame, by: str = "product_id") -> DataFrame:
    up, down = F.count(F.when(F.contains("direction", F.lit("improving")), 1)), F.count(F.when(F.contains("direction", F.lit("declining")), 1))
    high, medium = (F.count(F.when(F.col("confidence_label") == x, 1)) for x in ("high", "medium"))
    half = F.greatest(F.lit(1), F.floor(F.count("*") / 2))
    return f.groupBy(by).agg(
        F.when(down > up, "likely_declining").when(up > down, "likely_improving").otherwise("likely_stable_or_mixed").alias("direction"),
        F.when(high >= half, "high").when(medium + high >= half, "medium").otherwise("low").alias("confidence"),
    )


def label_match(expected: DataFrame, predicted: DataFrame, *key: str) -> DataFrame:
    """expected and predicted (key..., label) joined outer: what is matched, missed and over-extracted."""
    e, p = expected.withColumnRenamed("label", "expected"), predicted.withColumnRenamed("label", "predicted")
    j = e.join(p, list(key), "full_outer")
    return j.withColumn("outcome", F.when(F.col("predicted").isNull(), "missed").when(F.col("expected").isNull(), "extra").when(F.col("expected") == F.col("predicted"), "exact").otherwise("matched"))


def label_report(matched: DataFrame, case: str) -> DataFrame:
    """Recall, sentiment accuracy, over-extraction and exact pass rate; 1 where there is nothing to divide by."""
    n = lambda *o: F.count(F.when(F.col("outcome").isin(*o), 1))
    per = matched.groupBy(case).agg(n("missed", "matched", "exact").alias("e"), n("extra", "matched", "exact").alias("p"), n("matched", "exact").alias("m"), n("exact").alias("s"))
    share = lambda a, b: F.when(b == 0, 1.0).otherwise(sc.rounded(a / b, 3))
    t = per.agg(F.count("*").alias("cases"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in "epms"), F.count(F.when((F.col("e") == F.col("s")) & (F.col("p") == F.col("e")), 1)).alias("passed"))
    return t.select("cases", F.col("e").alias("expected"), F.col("p").alias("predicted"), F.col("m").alias("matched"), share(F.col("m"), F.col("e")).alias("recall"), share(F.col("s"), F.col("m")).alias("sentiment_accuracy"), share(F.col("p") - F.col("m"), F.col("p")).alias("over_extraction"), share(F.col("passed"), F.col("cases")).alias("exact_pass_rate"))


def spec_table(catalogue: DataFrame, own: str, other: str, fields: list[str], key: str = "product_id") -> DataFrame:
    """Both products' fields as rows (field, own, other, winner): tie if equal ignoring case, else unknown."""
    long = lambda p, tag: catalogue.where(F.col(key) == p).select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(tag)) for f in fields))).alias("x")).select("x.*")
    t = long(own, "own").join(long(other, "other"), "field", "full_outer")
    return t.withColumn("winner", F.when(F.lower("own") == F.lower("other"), "tie").otherwise("unknown"))
