"""Market news: trusted domains, tags, relevance and the brief. Tests on words are substring tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values
SMARTPHONE = ["smartphone", "phone", "mobile", "handset", "device", "oem", "camera", "battery", "display", "charging", "chipset", "mediatek", "qualcomm", "snapdragon", "dimensity", "samsung", "xiaomi", "oppo", "vivo", "honor", "transsion", "tecno", "infinix", "itel"]
AI = ["ai", "artificial intelligence", "genai", "generative ai", "llm", "on-device", "edge ai", "npu", "assistant", "gemini", "camera ai", "multimodal"]
MARKET = ["shipment", "market share", "launch", "pricing", "sales", "forecast", "growth", "emerging market", "india", "africa", "middle east", "latin america"]
MAKERS = ["samsung", "xiaomi", "oppo", "vivo", "honor", "transsion", "tecno", "infinix", "itel", "realme", "motorola", "apple"]
REGIONS = ["india", "africa", "middle east", "mea", "latin america", "latam", "pakistan", "bangladesh", "nigeria", "kenya", "egypt"]
TECH = ["on-device", "edge ai", "npu", "llm", "multimodal", "camera ai", "generative ai", "chipset", "snapdragon", "dimensity", "android", "ai assistant"]
CHIPS = ["chipset", "snapdragon", "dimensity", "npu"]


def _found(text: Column, terms: list[str]) -> Column:
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t))


def _tags(a: Column) -> Column:
    return F.transform(a, lambda t: F.replace(t, F.lit(" "), F.lit("_")))


def score(title: Column, summary: Column, default_tags: Column, programme: str = "market") -> Column:
    """struct(topic_tags, company_tags, technology_tags, region_tags, relevance_score, priority_label, why_it_matters).

    programme: how the text on background items calls the reader's programme.
    """
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(summary, F.lit(""))))
    tags = F.coalesce(default_tags, F.array().cast("array<string>"))
    phone, ai, market, makers, regions, tech = (_found(text, t) for t in (SMARTPHONE, AI, MARKET, MAKERS, REGIONS, TECH))
    some = lambda a: F.size(a) > 0
    topics = F.array_sort(F.array_union(tags, F.array_compact(F.array(F.when(some(phone), "smartphone"), F.when(some(ai), "ai"), F.when(some(market), "market"), F.when(some(makers), "oem")))))
    companies = F.array_sort(F.array_union(makers, F.filter(phone, lambda t: t.isin(*MAKERS, "qualcomm", "mediatek"))))
    technology = F.array_sort(F.array_union(F.array_union(_tags(ai), _tags(tech)), F.filter(phone, lambda t: t.isin(*CHIPS))))
    region_tags = F.array_sort(_tags(regions))
    has_ai = F.array_contains(topics, "ai") | F.exists(technology, lambda t: F.contains(t, F.lit("ai")))
    has_phone = F.array_contains(topics, "smartphone")
    has_chip = F.exists(technology, lambda t: t.isin(*CHIPS))
    has_maker = F.exists(companies, lambda t: t.isin(*MAKERS))
    yes = lambda c, n: F.when(c, n).otherwise(0)
    total = 7 * F.size(phone) + 10 * F.size(ai) + 5 * F.size(market) + 8 * F.size(makers) + 12 * F.size(tech) + 7 * F.size(regions)
    total = total + yes(has_ai & has_phone, 18) + yes(has_chip & (has_ai | has_phone), 15) + yes(has_maker, 10) + yes(some(regions), 8)
    total = total + yes(F.array_contains(tags, "edge_ai"), 4) + yes(F.array_contains(tags, "smartphone"), 4) + yes(F.array_contains(tags, "market"), 3)
    total = F.least(total, F.lit(100)).cast("double")
    reasons = F.array_compact(F.array(F.when(has_ai & has_phone, "AI + smartphone signal"), F.when(has_chip & (has_ai | has_phone), "chipset/platform signal relevant to OEM product planning"), F.when(has_maker, "OEM/competitor ecosystem signal"), F.when(some(regions), "emerging-market / regional relevance")))
    said = lambda a, n, kind, none: F.when(some(a), F.concat(F.lit(f"{kind} signal: "), F.array_join(F.slice(a, 1, n), ", "), F.lit("."))).otherwise(none)
    why = F.concat_ws(
        " ", F.concat(F.array_join(F.slice(reasons, 1, 3), "; "), F.lit(".")), said(companies, 4, "Company", "No direct company signal detected."), said(technology, 5, "Technology", "No specific technology signal detected."),
        said(region_tags, 4, "Region", "No specific priority-region signal detected."), F.lit("Use this as an evidence-linked item for smartphone/OEM market intelligence."),
    )
    why = F.when(some(reasons), why).when(total < 20, f"Low immediate {programme} relevance; keep only for background awareness.").otherwise("Relevant technology or market signal; review for possible OEM implications.")
    return F.struct(topics.alias("topic_tags"), companies.alias("company_tags"), technology.alias("technology_tags"), region_tags.alias("region_tags"), total.alias("relevance_score"), F.when(total >= 70, "high").when(total >= 35, "medium").otherwise("low").alias("priority_label"), why.alias("why_it_matters"))


def trusted(url: Column, domains: Column) -> Column:
    """Whether the host is one of the domains or below one."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.coalesce(F.exists(domains, lambda d: (host == d) | host.endswith(F.concat(F.lit("."), d))), F.lit(False))


SCORED = ["topic_tags", "company_tags", "technology_tags", "region_tags", "relevance_score", "priority_label", "why_it_matters"]


def classify(items: DataFrame, title: str = "title", summary: str = "summary", tags: str = "default_tags", programme: str = "market") -> DataFrame:
    return items.withColumn("s", score(F.col(title), F.col(summary), F.col(tags), programme)).select("*", "s.*").drop("s")


def rescore(items: DataFrame, sources: DataFrame, source_id: str | None = None, programme: str = "market") -> DataFrame:
    """Stored items scored anew with their source's default tags, with `updated`; items of unknown or other sources stay as they are."""
    known = sources.select("source_id", F.struct(F.col("default_tags").alias("tags")).alias("__source")).dropDuplicates(["source_id"])
    j = items.join(known, "source_id", "left")
    asked = F.col("__source").isNotNull() & (F.lit(True) if source_id is None else F.col("source_id") == F.lit(source_id))
    j = j.withColumn("updated", asked).withColumn("__s", F.when(asked, score(F.col("title"), F.col("summary"), F.col("__source.tags"), programme)))
    for c in SCORED:
        j = j.withColumn(c, F.when(F.col("updated"), F.col(f"__s.{c}")).otherwise(F.col(c)))
    return j.drop("__s", "__source")


def brief(items: DataFrame, k: int = 8) -> DataFrame:
    """(family, tag, n, place): the k most frequent tags of each family, priorities and, where there is such a column, source tiers (a top-k report)."""
    families = [("topic", "topic_tags"), ("company", "company_tags"), ("technology", "technology_tags"), ("region", "region_tags")]
    single = [("priority", "priority_label"), *([("tier", "source_tier")] if "source_tier" in items.columns else [])]
    every = F.array(*(F.struct(F.lit(f).alias("family"), F.col(c).alias("tags")) for f, c in families), *(F.struct(F.lit(f).alias("family"), F.array(F.col(c).cast("string")).alias("tags")) for f, c in single))
    rows = items.select(F.explode_outer(every).alias("f")).select("f.family", F.explode_outer("f.tags").alias("tag")).where("tag is not null")
    g = rows.groupBy("family", "tag").agg(F.count("*").alias("n"))
    return g.withColumn("place", F.row_number().over(W.partitionBy("family").orderBy(F.desc("n"), "tag"))).where(F.col("place") <= k)


# Fixed values
WATCHED_TECH = ("npu", "edge_ai", "on-device", "camera_ai", "llm", "multimodal")


def brief_texts(items: DataFrame, programme: str = "market") -> DataFrame:
    """One row over the items of a brief: how many, the summary and the recommended actions as arrays of sentences."""
    n = lambda c: F.count(F.when(c, 1))
    tier = n(F.col("source_tier") == 1) if "source_tier" in items.columns else F.lit(0).cast("long")
    watched = F.arrays_overlap("technology_tags", F.array(*map(F.lit, WATCHED_TECH)))
    facts = items.agg(F.count("*").alias("items"), n(F.col("priority_label") == "high").alias("high"), n(F.col("priority_label") == "medium").alias("medium"), tier.alias("first_tier"), (n(watched) > 0).alias("watched"))
    named = lambda f: F.transform(F.array_sort(F.collect_list(F.when((F.col("family") == f) & (F.col("place") <= 4), F.struct("place", "tag")))), lambda x: x["tag"]).alias(f)  # noqa: E731  four tags
    r = facts.join(F.broadcast(brief(items, 4).agg(named("technology"), named("company"), named("region"))))  # one row each
    count = lambda c, words: F.concat(F.col(c).cast("string"), F.lit(words))
    lists = lambda c, words: F.when(F.size(c) > 0, F.concat(F.lit(words), F.array_join(c, ", "), F.lit(".")))
    some, high = F.col("items") > 0, F.col("high") > 0
    summary = F.array(
        F.when(high, count("high", " high-priority trusted news item(s) were identified for smartphone/OEM market intelligence.")).otherwise("No high-priority item was identified; current signals should be treated as background monitoring."),
        lists("technology", "Key technology signals include "), lists("company", "Key company/ecosystem signals include "), lists("region", "Priority region signals include "),
        F.when(F.col("first_tier") > 0, count("first_tier", " item(s) come from Tier-1 official or primary sources, improving evidence quality.")),
    )
    actions = F.array_compact(F.array(
        F.when(high, f"Review high-priority items for possible inclusion in the weekly {programme} intelligence report."),
        F.when(F.col("watched"), "Assess whether detected AI/on-device technology signals affect smartphone roadmap, camera stack, assistant strategy, or chipset planning."),
        F.when(F.size("company") > 0, "Map company signals against competitor/OEM watchlists and update the market intelligence tracker."),
        F.when(F.size("region") > 0, "Check whether region-specific signals have implications for India, Africa, MEA, LATAM, or other priority emerging markets."),
    ))
    actions = F.when(F.size(actions) > 0, actions).otherwise(F.array(F.lit("Keep the items as background monitoring; no immediate product or market action is suggested.")))
    return r.select(
        "items", "high", "medium", F.when(some, F.array_compact(summary)).otherwise(F.array(F.lit("No trusted news items met the relevance threshold for this brief."))).alias("summary"),
        F.when(some, actions).otherwise(F.array(F.lit("Expand trusted source ingestion or lower the relevance threshold if coverage is unexpectedly empty."))).alias("actions"),
    )


def signals(items: DataFrame, k: int = 5) -> DataFrame:
    """One row: the k most relevant items as sentences, title and why it matters (a top-k report)."""
    top = items.orderBy(F.desc("relevance_score"), "title").limit(k)
    return top.agg(F.array_sort(F.collect_list(F.struct(-F.col("relevance_score"), F.concat("title", F.lit(" — "), "why_it_matters").alias("t")))).alias("x")).select(F.transform("x", lambda x: x["t"]).alias("signals"))
