"""Golden cases: queue items that a person has judged, their labels, and what an analyser makes of them.

Labels are array<struct<aspect, sentiment>>: trimmed, in lower case, blank ones dropped, each once in the order given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import scores as sc
from brindle.operators.summary import first_by, latest_by


def label_set(labels: Column) -> Column:
    clean = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    tidy = F.transform(F.coalesce(labels, F.array().cast("array<struct<aspect:string,sentiment:string>>")), lambda x: F.struct(clean(x["aspect"]).alias("aspect"), clean(x["sentiment"]).alias("sentiment")))
    return F.array_distinct(F.filter(tidy, lambda x: (x["aspect"] != "") & (x["sentiment"] != "")))


def label_text(labels: Column, apart: str = ",") -> Column:
    return F.array_join(F.transform(labels, lambda x: F.concat(x["aspect"], F.lit(":"), x["sentiment"])), apart)


def case_id(review_id: Column, labels: Column) -> Column:
    names = F.array_join(F.transform(labels, lambda x: F.concat_ws("_", x["aspect"], x["sentiment"])), "_")
    return F.regexp_replace(F.lower(F.concat_ws("_", F.lit("live"), review_id, names)), "[^a-z0-9_]+", "_")


def promote(queue: DataFrame, reviews: DataFrame, decisions: DataFrame) -> DataFrame:
    """Queue items (id, review_id, aspect, predicted_sentiment) with a decision (id, expected, expected_aspect, expected_sentiment, note) as cases.

    Labels are those of `expected`; where it is null or empty, one label of the decision or else of the prediction.
    Items without a valid label get an error in place of a case_id; items of unknown reviews or without a decision have no row.
    """
    j = queue.join(decisions, "id").join(reviews.select("review_id", F.struct(*(c for c in reviews.columns if c not in ("review_id", "product_id"))).alias("review")), "review_id")
    one = F.array(F.struct(F.coalesce(F.nullif(F.col("expected_aspect"), F.lit("")), F.col("aspect")).alias("aspect"), F.coalesce(F.nullif(F.col("expected_sentiment"), F.lit("")), F.col("predicted_sentiment")).alias("sentiment")))
    j = j.withColumn("labels", label_set(F.when(F.size("expected") > 0, F.col("expected")).otherwise(one)))
    some = F.size("labels") > 0
    return j.withColumn("case_id", F.when(some, case_id(F.col("review_id"), F.col("labels")))).withColumn("error", F.when(~some, "no valid aspect and sentiment"))


def store(cases: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """The golden table after promotions: a case that is there keeps its item and gets the new labels and note; the last promotion counts.

    Columns: case_id, source_item, review_id, product_id, labels, note, seq (order of promotion).
    """
    new = cases.where("case_id is not null").select("case_id", F.col("id").alias("source_item"), "review_id", "product_id", "labels", "note", F.col("id").cast("long").alias("seq"))
    rows = new if stored is None else stored.select(*new.columns).unionByName(new.withColumn("seq", F.col("seq") + (1 << 40)))
    first = first_by(rows, ["case_id"], ["seq"]).select("case_id", "source_item", "review_id", "product_id")
    return first.join(latest_by(rows, ["case_id"], ["seq"]).select("case_id", "labels", "note", "seq"), "case_id")


def set_status(queue: DataFrame, changes: DataFrame) -> DataFrame:
    """The queue with the status of the items in changes (seq, id, status); the last change of an item counts, unknown ids change nothing."""
    new = latest_by(changes, ["id"], ["seq"]).select("id", F.col("status").alias("__status"))
    return queue.join(new, "id", "left").withColumn("status", F.coalesce("__status", "status")).drop("__status")


def relabel(golden: DataFrame, changes: DataFrame) -> DataFrame:
    """The golden table with new labels and notes of the cases in changes (case_id, labels, note); changes without a valid label are left out."""
    new = changes.withColumn("__labels", label_set(F.col("labels"))).where(F.size("__labels") > 0).select("case_id", "__labels", F.struct(F.col("note").alias("note")).alias("__note"))
    j = golden.join(new, "case_id", "left")
    return j.withColumn("labels", F.coalesce("__labels", "labels")).withColumn("note", F.when(F.col("__note").isNotNull(), F.col("__note.note")).otherwise(F.col("note"))).drop("__labels", "__note")


def subset(part: Column, whole: Column) -> Column:
    return F.size(F.array_except(part, whole)) == 0


def proxies(cases: DataFrame) -> DataFrame:
    """One row over cases (case_id, expected, predicted: label arrays): how many have all aspects, how many all labels, and their shares."""
    names = lambda c: F.transform(c, lambda x: x["aspect"])
    per = cases.select(subset(names("expected"), names("predicted")).alias("a"), subset(F.col("expected"), F.col("predicted")).alias("s"))
    n = lambda c: F.count(F.when(F.col(c), 1))
    t = per.agg(F.count("*").alias("total_cases"), n("a").alias("exact_aspect_hits"), n("s").alias("sentiment_hits"))
    share = lambda c: sc.rounded(F.col(c) / F.greatest(F.col("total_cases"), F.lit(1)), 3)
    return t.select("*", share("exact_aspect_hits").alias("aspect_precision_proxy"), share("sentiment_hits").alias("sentiment_accuracy_proxy"))


def failed(cases: DataFrame) -> DataFrame:
    """The ids of cases that lack an expected label."""
    return cases.where(~subset(F.col("expected"), F.col("predicted"))).select("case_id")
