"""The frames of a dashboard and of an executive report: cards, chart rows and bullets for every product at once.

Sentences are fixed values: they must read as the services that they stand for word them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.functions import scores as sc
from brindle.functions import text as tf
from brindle.operators import report

FEW = 30
# Category and label of each compared field, and of the rows shown where a product has no record
SPEC_ROWS = [
    ("Commercial", "Current price", "current_price"), ("Commercial", "Price band", "price_band"), ("Display", "Display size", "display_size"), ("Display", "Display type", "display_type"), ("Display", "Refresh rate", "refresh_rate"),
    ("Display", "Screen-to-body ratio", "screen_to_body_ratio"), ("Performance", "Chipset", "chipset"), ("Performance", "RAM", "ram"), ("Performance", "Storage", "storage"), ("Battery", "Battery capacity", "battery_capacity"),
    ("Battery", "Charging wattage", "charging_wattage"), ("Camera", "Rear camera", "rear_camera"), ("Camera", "Front camera", "front_camera"), ("Software", "Android version", "android_version"), ("Software", "Custom UI", "custom_ui"),
    ("Network", "5G support", "network_5g"), ("Design", "Weight", "weight"), ("Design", "Thickness", "thickness"),
]
UNKNOWN_ROWS = [
    ("Commercial", "Current price"), ("Design", "Dimensions"), ("Design", "Weight"), ("Display", "Display size"), ("Display", "Resolution"), ("Display", "Refresh rate"), ("Performance", "Chipset"), ("Performance", "RAM"),
    ("Performance", "Storage"), ("Battery", "Battery capacity"), ("Battery", "Charging wattage"), ("Camera", "Rear camera setup"), ("Camera", "Front camera"), ("Software", "Android version"), ("Network", "5G support"), ("Audio & Sensors", "Speaker type"),
]
NO_VALUE = ("", "unknown", "none", "null", "n/a", "na", "-", "--")


def _said(column: str, words: str) -> Column:
    return F.concat(F.col(column).cast("string"), F.lit(words))


def quality_cards(products: DataFrame, readiness: DataFrame, by: str = "product_id") -> DataFrame:
    """(product, card, value, status, helper_text): readiness, warnings and confidence; readiness: one row of status and warnings (comma-separated)."""
    r = readiness.select(F.col("status").alias("ready"), F.filter(F.split(F.coalesce("warnings", F.lit("")), ","), lambda w: w != "").alias("warned"))
    few = F.col("review_count") < FEW
    j = products.select(by, "review_count").join(F.broadcast(r))  # one row
    n = F.size("warned")
    cards = [
        ("readiness_status", tf.labelize(F.col("ready")), F.col("ready"), F.lit("Whether the current workspace is safe to interpret.")),
        ("warning_count", n.cast("string"), F.when(n > 0, "warn").otherwise("pass"), F.coalesce(F.try_element_at("warned", F.lit(1)), F.lit("No readiness warnings."))),
        ("confidence_note", F.when(few, "Directional").otherwise("Stronger"), F.when(few, "directional").otherwise("stronger"), F.when(few, "Low review volume. Validate before decisions.").otherwise("Review volume supports stronger directional analysis.")),
    ]
    return _cards(j, cards, by)


def _cards(df: DataFrame, cards: list, by: str) -> DataFrame:
    parts = F.array(*(F.struct(F.lit(c).alias("card"), v.alias("value"), s.alias("status"), h.alias("helper_text")) for c, v, s, h in cards))
    return df.select(by, F.explode(parts).alias("c")).select(by, "c.*")


def sentiment_chart(counts: DataFrame, by: str = "product_id") -> DataFrame:
    """(product, label, value, helper_text) of (product, sentiment, n)."""
    return counts.select(by, F.col("sentiment").alias("label"), F.col("n").alias("value"), F.concat(F.col("n").cast("string"), F.lit(" "), "sentiment", F.lit(" signal(s)")).alias("helper_text"))


def top_aspect_chart(top: DataFrame, by: str = "product_id") -> DataFrame:
    return top.select(by, "place", F.col("aspect").alias("label"), F.col("mentions").alias("value"), _said("mentions", " mention(s)").alias("helper_text"))


def aspect_text(aspect: Column, mentions: Column, label: Column, bucket: Column) -> Column:
    name = tf.labelize(aspect)
    say = lambda words: F.concat(name, F.lit(words))
    only = lambda a, b: F.concat(name, F.lit(a), mentions.cast("string"), F.lit(b))
    return (
        F.when(bucket == "high-volume-complaint", say(" is a high-volume complaint area and should be treated as a priority pain point."))
        .when(bucket == "complaint-driver", say(" is currently a complaint driver, but evidence volume is still limited."))
        .when(bucket == "watchlist-complaint", only(" has negative sentiment, but only ", " mention(s). Keep it on the watchlist."))
        .when(bucket == "high-volume-delight", say(" is a high-volume positive driver and likely a product strength."))
        .when(bucket == "delight-driver", say(" is currently a positive driver, but evidence volume is still limited."))
        .when(bucket == "small-delight", only(" has a small positive signal with only ", " mention(s)."))
        .when(label.startswith("polarized") | (bucket == "mixed-signal"), say(" has mixed signals and should be checked with supporting review evidence."))
        .otherwise(say(" has thin evidence. Avoid drawing a strong conclusion yet."))
    )


def aspect_chart(aspects: DataFrame, by: str = "product_id") -> DataFrame:
    """Aspect summaries with place, sentiment_label, priority_bucket, priority_level and interpretation, most mentioned and then strongest first."""
    p, n, z, s, m = (F.col(c) for c in ("positive_count", "negative_count", "neutral_count", "aspect_score", "mentions"))
    place = F.row_number().over(W.partitionBy(by).orderBy(F.desc("mentions"), F.desc(F.abs("aspect_score")), "aspect"))
    a = aspects.withColumn("place", place).withColumn("sentiment_label", sc.sentiment_label(p, n, z, s)).withColumn("priority_bucket", sc.priority_bucket(m, p, n, s))
    a = a.withColumn("priority_level", sc.priority_level(F.col("priority_bucket")))
    return a.withColumn("interpretation", aspect_text(F.col("aspect"), m, F.col("sentiment_label"), F.col("priority_bucket")))


def insight_cards(products: DataFrame, counts: DataFrame, aspects: DataFrame, by: str = "product_id") -> DataFrame:
    """(product, card, value, status, helper_text): mood, positive and complaint drivers, evidence strength, polarised aspect."""
    n = lambda s: F.coalesce(F.sum(F.when(F.col("sentiment") == s, F.col("n"))), F.lit(0)).alias(s)
    picked = report.aspect_picks(aspects, by).join(aspect_chart(aspects, by).select(by, "aspect", "mentions", "priority_bucket"), [by, "aspect"])
    one = lambda pick, c: F.max(F.when(F.col("pick") == pick, F.col(c)))
    names = ("strongest_positive", "strongest_negative", "polarized")
    picked = picked.groupBy(by).agg(*(one(p, c).alias(f"{p}_{c}") for p in names for c in ("aspect", "mentions", "priority_bucket")))
    j = products.select(by, "review_count").join(counts.groupBy(by).agg(n("positive"), n("negative"), n("neutral")), by, "left").join(picked, by, "left").fillna(0, ["positive", "negative", "neutral"])
    p, g, z, r = (F.col(c) for c in ("positive", "negative", "neutral", "review_count"))
    mood = sc.mood_balance(p, g, z)
    text = lambda c: c.cast("string")
    helper = F.when(mood == "No Signal", "No sentiment signal is available yet.").when(mood == "Positive-Leaning", F.concat(text(p), F.lit(" positive vs "), text(g), F.lit(" negative signal(s).")))
    helper = helper.when(mood == "Negative-Leaning", F.concat(text(g), F.lit(" negative vs "), text(p), F.lit(" positive signal(s)."))).otherwise(F.concat(text(p), F.lit(" positive and "), text(g), F.lit(" negative signal(s) are currently balanced.")))
    state = F.when(mood == "No Signal", "neutral").when(mood == "Positive-Leaning", "good").when(mood == "Negative-Leaning", "bad").otherwise("warn")

    def driver(pick, label, none, status):
        a = F.col(f"{pick}_aspect")
        told = aspect_text(a, F.col(f"{pick}_mentions"), F.lit(label), F.col(f"{pick}_priority_bucket"))
        return F.coalesce(tf.labelize(a), F.lit("Not clear")), F.when(a.isNotNull(), status).otherwise("neutral"), F.when(a.isNotNull(), told).otherwise(none)

    strength = F.when(r == 0, "Import reviews before interpreting sentiment.").when(r < FEW, "Small sample. Treat aspect sentiment as early signal.").when(r < 100, "Usable sample for directional sentiment analysis.")
    strength = strength.when(r < 500, "Stronger sample for product interpretation.").otherwise("Large review base supports high-confidence sentiment patterns.")
    split = F.col("polarized_aspect")
    cards = [
        ("mood_balance", mood, state, helper), ("dominant_positive_area", *driver("strongest_positive", "positive-heavy", "No strong positive aspect signal yet.", "good")),
        ("dominant_negative_area", *driver("strongest_negative", "negative-heavy", "No strong complaint aspect signal yet.", "bad")),
        ("sentiment_evidence_strength", sc.evidence_strength(r), F.when(r < FEW, "warn").otherwise("good"), strength),
        ("polarized_aspect", F.coalesce(tf.labelize(split), F.lit("None yet")), F.when(split.isNotNull(), "warn").otherwise("neutral"), F.when(split.isNotNull(), "This aspect has both positive and negative signals.").otherwise("No aspect has enough mixed evidence yet.")),
    ]
    return _cards(j, cards, by)


def gap_chart(benchmark: DataFrame) -> DataFrame:
    return benchmark.select("aspect", "gap", "own_score", F.col("other_score").alias("competitor_score"), "confidence_label", "interpretation")


def signal_chart(tags: DataFrame, k: int = 12) -> DataFrame:
    """The first k signals, technology before company before region, each as often as the brief names it; tags: (family, tag, place)."""
    order = F.array_position(F.array(*map(F.lit, ("technology", "company", "region"))), F.col("family"))
    named = tags.where(F.col("family").isin("technology", "company", "region")).groupBy("family", "tag").agg(F.count("*").alias("value"), F.min("place").alias("place"))
    return named.orderBy(F.desc("value"), order, "place").limit(k).select(F.col("tag").alias("label"), "value", F.col("family").alias("category"), F.concat("family", F.lit(" signal")).alias("helper_text"))


def tier_chart(items: DataFrame, tier: str = "source_tier") -> DataFrame:
    n = items.groupBy(F.col(tier).cast("string").alias("tier")).agg(F.count("*").alias("value"))
    return n.select(F.concat(F.lit("Tier "), "tier").alias("label"), "value", F.concat(F.lit("tier_"), "tier").alias("status"), F.concat(F.col("value").cast("string"), F.lit(" item(s) from source tier "), "tier").alias("helper_text"))


def chips(tags: DataFrame) -> DataFrame:
    """Technology (8), company (6) and region (6) signals of the brief."""
    most = F.when(F.col("family") == "technology", 8).when(F.col("family").isin("company", "region"), 6).otherwise(0)
    return tags.where(F.col("place") <= most).select(F.col("tag").alias("label"), F.col("family").alias("signal_type")).distinct()


def spec_value(t: Column) -> Column:
    t = F.trim(F.regexp_replace(t.cast("string"), r"\s+", " "))
    return F.when(F.coalesce(F.lower(t), F.lit("")).isin(*NO_VALUE), "Unknown").otherwise(t)


def spec_table(catalogue: DataFrame, own: str, other: str, rows: list[tuple[str, str, str]] = SPEC_ROWS) -> DataFrame:
    """(place, category, field, selected_product_value, competitor_value, winner, confidence, source_status) of two records; no row unless both are there."""
    two = catalogue.where(F.col("product_id").isin(own, other))
    values = F.array(*(F.struct(F.lit(k).alias("place"), F.lit(c).alias("category"), F.lit(label).alias("field"), spec_value(F.col(f)).alias("value")) for k, (c, label, f) in enumerate(rows)))
    source = F.lower(F.coalesce("source_confidence", F.lit(""))) if "source_confidence" in catalogue.columns else F.lit("")
    side = lambda p, tag: two.where(F.col("product_id") == p).limit(1).select(F.explode(values).alias("x"), source.alias(f"{tag}_source")).select("x.place", "x.category", "x.field", F.col("x.value").alias(tag), f"{tag}_source")
    j = side(own, "a").join(side(other, "b").drop("category", "field"), "place")
    blank = (F.col("a") == "Unknown") | (F.col("b") == "Unknown")
    winner = F.when(~blank & (F.lower("a") == F.lower("b")), "tie").otherwise("unknown")
    official = F.contains("a_source", F.lit("official")) & F.contains("b_source", F.lit("official"))
    sure = F.when(blank, "unknown").when(official, "verified").when((F.col("a_source") != "") | (F.col("b_source") != ""), "likely").otherwise("unknown")
    return j.select("place", "category", "field", F.col("a").alias("selected_product_value"), F.col("b").alias("competitor_value"), winner.alias("winner"), sure.alias("confidence"), F.lit("catalog").alias("source_status"))


def unknown_specs(spark) -> DataFrame:
    rows = [(k, c, f, "Unknown", "Unknown", "unknown", "unknown", "needs_source") for k, (c, f) in enumerate(UNKNOWN_ROWS)]
    return spark.createDataFrame(rows, "place int, category string, field string, selected_product_value string, competitor_value string, winner string, confidence string, source_status string")


def specs(catalogue: DataFrame, own: str, other: str | None) -> DataFrame | None:
    """The table of both records, else the rows of unknowns; None without a competitor."""
    if other is None:
        return None
    known = spec_table(catalogue, own, other)
    there = known.agg((F.count("*") > 0).alias("there"))
    return known.unionByName(unknown_specs(catalogue.sparkSession).join(F.broadcast(there)).where("not there").drop("there"))  # one row


def checked_specs(rows: DataFrame, most: int = 64) -> DataFrame:
    """Spec rows of another origin made safe: `most` rows, cells cut to their widths, words outside the known ones replaced."""
    cell = lambda c, none, n: tf.truncate(F.coalesce(F.nullif(F.trim(F.regexp_replace(F.col(c), r"\s+", " ")), F.lit("")), F.lit(none)), n).alias(c)
    known = lambda c, words, none: F.when(F.lower(F.trim(c)).isin(*words), F.lower(F.trim(c))).otherwise(none).alias(c)
    return rows.orderBy("place").limit(most).select(
        "place", cell("category", "General", 40), cell("field", "Specification", 60), cell("selected_product_value", "Unknown", 90), cell("competitor_value", "Unknown", 90),
        known("winner", ("selected", "competitor", "tie", "unknown"), "unknown"), known("confidence", ("verified", "likely", "unknown"), "unknown"), known("source_status", ("catalog", "needs_source", "model_knowledge"), "needs_source"),
    )


def clean_sentence(t: Column) -> Column:
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    t = F.replace(F.replace(t, F.lit("our product"), F.lit("the selected product")), F.lit("Our product"), F.lit("The selected product"))
    return F.when(F.coalesce(t, F.lit("")) == "", "Evidence is not strong enough yet.").otherwise(tf.sentence(t))


def distinct_bullets(bullets: Column) -> Column:
    """Each bullet once, whatever the case, in the order of its first place."""
    b = F.transform(F.array_compact(bullets), clean_sentence)
    low = F.transform(b, lambda x: F.lower(x))
    return F.filter(b, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def executive_report(products: DataFrame, themes: DataFrame, strengths: DataFrame | None = None, benchmark: DataFrame | None = None, news: DataFrame | None = None, own: str | None = None, by: str = "product_id") -> DataFrame:
    """(product, confidence_note and the bullets of each section as arrays), a row for every product.

    themes: rows of `summary.themes`; strengths and benchmark: those of `compare` for the product `own` against a competitor, or None;
    news: one row of `signals` and `actions` (arrays), or None.
    """
    ranked = lambda family: F.transform(F.array_sort(F.collect_list(F.when((F.col("family") == family) & (F.col("place") <= 3), F.struct("place", "aspect")))), lambda x: x["aspect"])  # noqa: E731  three rows at most
    t = themes.groupBy(by).agg(ranked("delight").alias("delights"), ranked("complaint").alias("complaints"))
    none = F.array().cast("array<string>")
    j = products.select(by, "review_count").join(t, by, "left")
    of = F.col(by) == F.lit(own)
    told = lambda kind, k: strengths.where((F.col("kind") == kind) & (F.col("place") <= k)).agg(F.array_sort(F.collect_list(F.struct("place", "interpretation"))).alias("x")).select(F.transform("x", lambda x: x["interpretation"]).alias(kind))  # noqa: E731  k rows
    if strengths is not None:
        j = j.join(F.broadcast(told("strength", 2)), of, "left").join(F.broadcast(told("weakness", 2)), of, "left")
    if benchmark is not None:
        five = benchmark.orderBy(F.desc(F.abs("gap")), "aspect").limit(5).agg(F.array_sort(F.collect_list(F.struct(-F.abs("gap"), "aspect", "interpretation"))).alias("x"))
        j = j.join(F.broadcast(five.select(F.transform("x", lambda x: x["interpretation"]).alias("taken"))), of, "left")
    if news is not None:
        j = j.join(F.broadcast(news.select(F.col("signals").alias("market"), "actions")))
    have = set(j.columns)
    col = lambda c: F.coalesce(F.col(c), none) if c in have else none
    signal = lambda a, words: F.transform(F.coalesce(F.col(a), none), lambda x: F.concat(tf.labelize(x), F.lit(words)))
    or_else = lambda a, words: F.when(F.size(a) > 0, a).otherwise(F.array(F.lit(words)))
    n, compared = F.col("review_count"), (of if own is not None else F.lit(False))
    j = j.withColumn("key_strengths", or_else(distinct_bullets(F.concat(signal("delights", " is the strongest positive customer signal."), col("strength"))), "No clear positive customer signal is strong enough yet. More review evidence is needed."))
    j = j.withColumn("key_risks", or_else(distinct_bullets(F.concat(signal("complaints", " is the clearest customer risk area to validate."), col("weakness"))), "No clear customer risk signal is strong enough yet. Continue collecting review evidence."))
    thin = "Competitor benchmark is available, but comparable evidence is still too thin for a strong conclusion."
    j = j.withColumn("competitor_takeaways", F.when(compared, or_else(distinct_bullets(col("taken")), thin)).otherwise(none))
    j = j.withColumn("market_news_signals", distinct_bullets(F.slice(col("market"), 1, 5)))
    actions = F.array(
        F.when(n < FEW, "Increase the real review sample before using these findings for roadmap or leadership decisions."), F.lit("Validate the top risk signal with more reviews, evidence examples, and product-team review."),
        F.when(compared, "Use competitor gap findings to separate product issues from positioning, marketing, and after-sales issues.").otherwise("Keep this as a product-only analysis, or add a competitor only when benchmark comparison is required."),
        F.lit("Preserve evidence links with every claim so the report remains auditable."),
    )
    j = j.withColumn("recommended_actions", F.slice(distinct_bullets(F.concat(F.array_compact(actions), F.slice(col("actions"), 1, 2))), 1, 6))
    volume = F.when(n < FEW, "Current findings should be treated as early directional signals because the review volume is still low.").otherwise("Review volume is strong enough to support more confident directional product insights.")
    view = F.when(compared, F.concat(F.lit("Competitive takeaway: "), F.col("competitor_takeaways")[0])).otherwise("This is a product-only view. Add a competitor only when benchmark comparison is needed.")
    context = F.when(F.size("market_news_signals") > 0, "Trusted market signals are available and should be used as external context, not as a replacement for review evidence.")
    summary = F.array(volume, F.concat(F.lit("Primary positive signal: "), F.col("key_strengths")[0]), F.concat(F.lit("Primary risk signal: "), F.col("key_risks")[0]), view, context)
    empty = F.array(F.lit("No usable review evidence is available for the selected product yet. Import review data before drawing product conclusions."))
    j = j.withColumn("executive_summary", F.when(n == 0, empty).otherwise(F.slice(distinct_bullets(summary), 1, 6)))
    note = F.when(n == 0, "No confidence yet: the selected product has no usable review evidence in the selected scope.")
    note = note.when(n < FEW, "Directional confidence: review volume is low, so findings should be treated as early signals and validated with more data.")
    note = note.otherwise("Higher confidence: evidence volume is sufficient for stronger directional conclusions.")
    return j.select(by, note.alias("confidence_note"), "executive_summary", "key_strengths", "key_risks", "competitor_takeaways", "market_news_signals", "recommended_actions")


def sections(executive: DataFrame, by: str = "product_id") -> DataFrame:
    """(product, section, place, bullet): the report as rows."""
    alone = F.array(F.lit("No competitor was selected. This report focuses on the selected product only."))
    quiet = F.array(F.lit("No high-relevance trusted market signal is available yet."))
    parts = [
        ("Decision Summary", F.col("executive_summary")), ("Customer Strength Signals", F.col("key_strengths")), ("Customer Risk Signals", F.col("key_risks")),
        ("Competitor Benchmark", F.when(F.size("competitor_takeaways") > 0, F.col("competitor_takeaways")).otherwise(alone)), ("Trusted Market Signals", F.when(F.size("market_news_signals") > 0, F.col("market_news_signals")).otherwise(quiet)),
        ("Recommended Actions", F.col("recommended_actions")),
    ]
    rows = executive.select(by, F.explode(F.array(*(F.struct(F.lit(n).alias("section"), b.alias("bullets")) for n, b in parts))).alias("s"))
    return rows.select(by, "s.section", F.posexplode("s.bullets").alias("place", "bullet"))


def dashboard(products: DataFrame, net: DataFrame, counts: DataFrame, top: DataFrame, aspects: DataFrame, readiness: DataFrame, tags: DataFrame, items: DataFrame, benchmark: DataFrame | None = None, catalogue: DataFrame | None = None, own: str | None = None, other: str | None = None, executive: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every frame of the dashboard by its name; frames over a competitor are there only where one is chosen."""
    out = {
        "kpi_cards": report.kpi_cards(products, net), "sentiment_distribution_chart": sentiment_chart(counts), "top_aspect_chart": top_aspect_chart(top), "aspect_sentiment_chart": aspect_chart(aspects),
        "sentiment_priority_matrix": aspect_chart(aspects).select("product_id", "place", "aspect", "mentions", "aspect_score", "sentiment_label", "priority_bucket", "priority_level", "interpretation"),
        "sentiment_insight_cards": insight_cards(products, counts, aspects), "aspect_reason_cards": report.reason_cards(aspects), "workflow_tiles": report.tiles(products, report.aspect_picks(aspects), None if other is None else 1, 1),
        "quality_cards": quality_cards(products, readiness), "news_signal_chart": signal_chart(tags), "source_tier_chart": tier_chart(items), "news_signal_chips": chips(tags),
    }
    if benchmark is not None:
        out |= {"competitor_gap_chart": gap_chart(benchmark), "benchmark_summary": report.benchmark_summary(benchmark)}
    if catalogue is not None and own and other:
        out["benchmark_spec_table"] = specs(catalogue, own, other)
    if executive is not None:
        out |= {"executive_report": executive, "recommended_actions": executive.select("product_id", F.posexplode("recommended_actions").alias("place", "action"))}
    return out
