"""What dashboards and reports say, as tables: cards, tiles, picks, summaries in words. One row per product or card."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.functions import text as tf
from brindle.operators.summary import evidence_top, first_by


def kpi_cards(summary: DataFrame, net: DataFrame, by: str = "product_id") -> DataFrame:
    """(product, card, value, status): four cards per product; few reviews make it directional."""
    s = summary.join(net, by, "left")
    few = F.col("review_count") < 30
    cards = [
        ("review_count", F.col("review_count").cast("double"), F.when(few, "low_volume").otherwise("stronger_volume")), ("average_rating", F.col("average_rating"), F.lit(None).cast("string")),
        ("quality_score", F.col("average_quality"), F.lit(None).cast("string")), ("net_sentiment", F.col("net_sentiment"), F.when(few, "directional").otherwise("usable")),
    ]
    return s.select(by, F.explode(F.array(*(F.struct(F.lit(n).alias("card"), v.alias("value"), x.alias("status")) for n, v, x in cards))).alias("c")).select(by, "c.*")


def tiles(summary: DataFrame, picks: DataFrame, comparable: int | None, news_items: int, by: str = "product_id") -> DataFrame:
    """(product, tile, status): strengths, risks, volume, benchmark and market context."""
    s = summary.join(picks.groupBy(by).agg(F.max(F.col("pick") == "strongest_positive").alias("good"), F.max(F.col("pick") == "strongest_negative").alias("bad")), by, "left")
    on = lambda c: F.when(F.coalesce(F.col(c), F.lit(False)), "active").otherwise("thin_evidence")
    parts = [("customer_signal", on("good")), ("risk_signal", on("bad")), ("evidence_volume", F.when(F.col("review_count") < 30, "low_volume").otherwise("usable"))]
    parts += [("benchmark_mode", F.lit("active" if comparable else "product_only")), ("market_context", F.lit("active" if news_items else "empty"))]
    return s.select(by, F.explode(F.array(*(F.struct(F.lit(n).alias("tile"), x.alias("status")) for n, x in parts))).alias("t")).select(by, "t.*")


def aspect_picks(aspects: DataFrame, by: str = "product_id") -> DataFrame:
    """(product, pick, aspect): strongest positive, strongest negative and polarized aspect; ties by aspect."""
    p, n = F.col("positive_count"), F.col("negative_count")
    kinds = [("strongest_positive", p > n, [p, F.col("mentions"), F.col("aspect_score")]), ("strongest_negative", n > p, [n, F.col("mentions"), F.abs("aspect_score")]), ("polarized", (p > 0) & (n > 0), [F.col("mentions"), F.lit(0), F.lit(0)])]
    found = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(k).alias("pick"), *(x.cast("double").alias(f"o{j}") for j, x in enumerate(order)))) for k, c, order in kinds)))
    rows = aspects.select(by, "aspect", F.explode(found).alias("x")).select(by, "aspect", "x.*")
    place = F.row_number().over(W.partitionBy(by, "pick").orderBy(F.desc("o0"), F.desc("o1"), F.desc("o2"), "aspect"))
    return rows.withColumn("place", place).where("place = 1").select(by, "pick", "aspect")


def dominant(positive: Column, negative: Column, neutral: Column) -> Column:
    return F.when((positive > negative) & (positive >= neutral), "positive").when((negative > positive) & (negative >= neutral), "negative").when((neutral > positive) & (neutral > negative), "neutral").when((positive > 0) & (negative > 0), "mixed").otherwise("unclear")


def evidence_themes(evidence: DataFrame, rules: dict[str, list[tuple[str, list[str]]]], words: list[str], by: str = "product_id", most: int = 12) -> DataFrame:
    """(product, aspect, theme, evidence_terms, evidence_examples) of the `most` best pieces of evidence of each aspect.

    rules: of each aspect (theme, words inside the text that tell it), in order of preference; theme is the first that holds, null if none.
    Terms are up to six: themes by how many of their words are there, then the words of `words` that are.
    """
    top = evidence_top(evidence, most, by, "aspect")
    spans = F.transform(F.array_sort(F.collect_list(F.struct("place", F.trim(F.coalesce("evidence", F.lit(""))).alias("t")))), lambda x: x["t"])  # `most` at most
    g = top.groupBy(by, "aspect").agg(F.filter(spans, lambda t: t != "").alias("spans"))
    g = g.withColumn("t", F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.array_join("spans", " ")), r"[^a-z0-9\u0900-\u097f ._-]+", " "), r"\s+", " ")))
    kind = "array<struct<aspect:string,n:int,theme:string,triggers:array<string>>>"
    told = F.from_json(F.lit(json.dumps([{"aspect": a, "n": n, "theme": label, "triggers": ws} for a, rs in rules.items() for n, (label, ws) in enumerate(rs)])), kind)
    hits = F.transform(F.filter(told, lambda r: r["aspect"] == F.col("aspect")), lambda r: F.struct((-F.size(F.filter(r["triggers"], lambda w: F.contains(F.col("t"), F.lower(w))))).alias("k"), r["n"].alias("n"), r["theme"].alias("theme")))
    g = g.withColumn("hits", F.filter(hits, lambda h: h["k"] < 0))
    first = F.try_element_at(F.array_sort(F.transform("hits", lambda h: F.struct(h["n"], h["theme"].alias("theme")))), F.lit(1))["theme"]
    terms = F.concat(F.transform(F.array_sort("hits"), lambda h: h["theme"]), F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.col("t"), w)))
    return g.select(by, "aspect", first.alias("theme"), F.slice(F.array_distinct(terms), 1, 6).alias("evidence_terms"), F.slice("spans", 1, 3).alias("evidence_examples"))


def reason_cards(aspects: DataFrame, themes: dict[str, str] | None = None) -> DataFrame:
    """Adds reaction, one_liner and confidence_label to aspect summaries. themes: what an aspect is called in words.

    Where there is a column theme (of `evidence_themes`), it is what the line speaks of.
    """
    names = F.create_map(*(F.lit(x) for kv in (themes or {"": ""}).items() for x in kv))
    label = tf.labelize(F.col("aspect"))
    theme = F.coalesce(*([F.col("theme")] if "theme" in aspects.columns else []), F.try_element_at(names, F.col("aspect")), F.lower(label))
    d = dominant(F.col("positive_count"), F.col("negative_count"), F.col("neutral_count"))
    say = lambda a, b="": F.concat(F.lit(a), theme, F.lit(b))
    line = F.when(d == "positive", say("Users mostly like ", ".")).when(d == "negative", say("Users mostly complain about ", ".")).when(d == "mixed", say("Users are split on ", ".")).when(d == "neutral", say("Users mention ", ", but sentiment is mostly neutral."))
    line = line.when(F.col("mentions") <= 1, F.concat(label, F.lit(" has only one clear mention so far."))).otherwise(say("Users mention ", ", but the sentiment direction is not clear yet."))
    sure = F.when(F.col("mentions") == 0, "no_evidence").when(F.col("mentions") < 3, "early").when(F.col("mentions") < 10, "directional").otherwise("stronger")
    return aspects.withColumn("reaction", d).withColumn("one_liner", line).withColumn("reason_confidence", sure)


def phrase(names: Column) -> Column:
    """'a', 'a and b', or 'a, b and c': an array in words."""
    n = F.size(names)
    return F.when(n == 0, "").when(n == 1, F.try_element_at(names, F.lit(1))).otherwise(F.concat(F.array_join(F.slice(names, F.lit(1), F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), F.try_element_at(names, F.lit(-1))))


def benchmark_summary(b: DataFrame) -> DataFrame:
    """One row in words over a benchmark: who leads where, and where evidence is missing."""
    gapless = F.contains("confidence_label", F.lit("insufficient"))
    pick = lambda c: F.array_sort(F.collect_list(F.when(c, tf.labelize(F.col("aspect")))))  # noqa: E731  a benchmark has a row per aspect
    s = b.agg(F.count("*").alias("n"), pick(~gapless & (F.col("gap") > 0)).alias("own"), pick(~gapless & (F.col("gap") < 0)).alias("other"), pick(gapless).alias("missing"))
    some = lambda c: F.size(c) > 0
    none = F.col("n") == 0
    heads = F.array_compact(F.array(F.when(some("own"), F.concat(F.lit("users prefer the selected product for "), phrase(F.col("own")))), F.when(some("other"), F.concat(F.lit("users prefer the competitor for "), phrase(F.col("other")))), F.when(some("missing"), F.concat(phrase(F.col("missing")), F.lit(" need more comparable evidence")))))
    return s.select(
        F.when(none, "No comparable benchmark evidence is available yet.").when(some(heads), F.concat(F.lit("Benchmark indicates that "), F.array_join(heads, "; "), F.lit("."))).otherwise("Benchmark evidence is still thin.").alias("headline"),
        F.when(none, "Selected product comparison needs more review evidence.").when(some("own"), F.concat(F.lit("Users appear to prefer the selected product for "), phrase(F.col("own")), F.lit("."))).otherwise("No clear selected-product preference is visible yet.").alias("selected_product_summary"),
        F.when(none, "Competitor comparison needs more review evidence.").when(some("other"), F.concat(F.lit("Users appear to prefer the competitor for "), phrase(F.col("other")), F.lit("."))).otherwise("No clear competitor preference is visible yet.").alias("competitor_summary"),
        F.when(none, "Import more comparable reviews before reading this benchmark.").when(some("missing"), F.concat(phrase(F.col("missing")), F.lit(" have evidence gaps, so they should not be read as confirmed wins or losses."))).otherwise("Read this benchmark as directional until more comparable reviews are available.").alias("risk_summary"),
    )


def brief(summary: DataFrame, net: DataFrame, picks: DataFrame, overall: DataFrame, by: str = "product_id") -> DataFrame:
    """A product's brief in words: volume, rating, net sentiment, top strength and risk, direction."""
    p = picks.groupBy(by).agg(F.max(F.when(F.col("pick") == "strongest_positive", F.col("aspect"))).alias("good"), F.max(F.when(F.col("pick") == "strongest_negative", F.col("aspect"))).alias("bad"))
    j = summary.join(net, by, "left").join(p, by, "left").join(overall, by, "left")
    good = F.when(F.col("good").isNotNull(), F.concat(F.lit("Top strength is "), "good", F.lit("."))).otherwise("No strong positive aspect has enough evidence yet.")
    bad = F.when(F.col("bad").isNotNull(), F.concat(F.lit("Top risk is "), "bad", F.lit("."))).otherwise("No major negative aspect has enough evidence yet.")
    rated = F.coalesce(F.concat(F.lit(" with average rating "), F.col("average_rating").cast("string")), F.lit(""))
    told = F.concat(
        F.col(by), F.lit(" currently has "), F.col("review_count").cast("string"), F.lit(" processed review(s)"), rated, F.lit(". The net sentiment score is "), F.coalesce("net_sentiment", F.lit(0.0)).cast("string"), F.lit(". "), good, F.lit(" "), bad,
        F.lit(" Near-term perception direction is "), F.coalesce("direction", F.lit("uncertain")), F.lit(" with "), F.coalesce("confidence", F.lit("low")), F.lit(" confidence."),
    )
    return j.select(by, told.alias("brief"))


def route(providers: DataFrame) -> DataFrame:
    """(task, place, provider_id, enabled) to each task's first enabled provider and the others as fallbacks."""
    on = providers.where("enabled")
    first = first_by(on, ["task"], ["place"]).select("task", F.col("provider_id").alias("selected"), F.col("place").alias("first"))
    rest = on.join(first, "task").where("place > first").groupBy("task").agg(F.array_sort(F.collect_list(F.struct("place", "provider_id"))).alias("r"))
    return first.drop("first").join(rest, "task", "left").select("task", "selected", F.coalesce(F.array_join(F.transform("r", lambda x: x["provider_id"]), ","), F.lit("")).alias("fallbacks"))
