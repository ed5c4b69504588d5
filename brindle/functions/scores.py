"""Scores, labels and rules over numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int) -> Column:
    """Half up on the value as it is, the same in every engine."""
    k = float(10**digits)
    return F.floor(x * k + 0.5) / F.lit(k)


def mean(x: Column) -> Column:
    """Average by an exact decimal sum, so that it doesn't depend on the order of rows."""
    return F.sum(x.cast("decimal(18,6)")).cast("double") / F.count(x)


def signed(sentiment: Column, intensity: Column) -> Column:
    return F.when(sentiment == "positive", intensity).when(sentiment == "negative", -intensity).otherwise(F.lit(0).cast("decimal(18,6)"))


def contradiction(rating: Column, sentiments: Column) -> Column:
    """A high rating with only negative aspects, or a low one with only positive aspects."""
    bad, good = F.array_contains(sentiments, "negative"), F.array_contains(sentiments, "positive")
    return F.coalesce(((rating >= 4) & bad & ~good) | ((rating <= 2) & good & ~bad), F.lit(False))


def quality(verified: Column, text: Column, votes: Column, signals: Column, confidence: Column, language_confidence: Column) -> Column:
    """0 to 1: how much a review is worth as evidence. confidence: mean over its aspects, or NULL."""
    s = F.lit(0.35) + F.when(verified, 0.15).otherwise(0.0) + F.when(F.char_length(F.trim(text)) >= 20, 0.12).otherwise(0.0)
    s = s + F.when(votes > 0, F.least(F.lit(0.1), votes / F.lit(100.0))).otherwise(0.0)
    s = s + F.when(F.array_contains(signals, "product"), 0.12).otherwise(0.0) + F.coalesce(confidence * 0.18, F.lit(0.0)) + language_confidence * 0.08
    s = s - F.when(F.array_contains(signals, "delivery") | F.array_contains(signals, "service"), 0.08).otherwise(0.0)
    return rounded(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)), 3)


def confidence_label(mentions: Column, confidence: Column) -> Column:
    return F.when((mentions >= 50) & (confidence >= 0.82), "high").when((mentions >= 10) & (confidence >= 0.7), "medium").otherwise("low")


def pair_confidence_label(own: Column, other: Column, own_confidence: Column, other_confidence: Column) -> Column:
    """Confidence of a comparison; the mean is over the sides that have one."""
    both = (F.coalesce(own_confidence, F.lit(0.0)) + F.coalesce(other_confidence, F.lit(0.0))) / F.greatest(own_confidence.isNotNull().cast("int") + other_confidence.isNotNull().cast("int"), F.lit(1))
    return F.when((own == 0) | (other == 0), "insufficient_comparison").otherwise(confidence_label(own + other, both))


def gap_text(aspect: Column, gap: Column, label: Column, own: Column, other: Column) -> Column:
    side = lambda a, b, c: F.concat(F.lit(f"The {a} has "), aspect, F.lit(f" evidence, but the {b} has no comparable "), aspect, F.lit(f" evidence yet. Treat this as an evidence gap, not a confirmed {c}."))
    lead = F.when(F.abs(gap) < 5, F.concat(F.lit("Near parity on "), aspect, F.lit(".")))
    lead = lead.when(gap > 0, F.concat(F.lit("The selected product is ahead on "), aspect, F.lit(" by "), gap.cast("string"), F.lit(" points.")))
    lead = lead.otherwise(F.concat(F.lit("The competitor is ahead on "), aspect, F.lit(" by "), F.abs(gap).cast("string"), F.lit(" points.")))
    low = F.when(label == "low", " Treat as directional because evidence volume/confidence is still low.").otherwise("")
    none = F.concat(F.lit("No comparable evidence is available for "), aspect, F.lit(" on either product."))
    return F.when((own == 0) & (other == 0), none).when(own == 0, side("competitor", "selected product", "weakness")).when(other == 0, side("selected product", "competitor", "strength")).otherwise(F.concat(lead, low))


def direction(score: Column, movement: Column) -> Column:
    """From the movement between periods; without one, from the score alone."""
    alone = F.when(score >= 15, "likely_positive_but_unproven").when(score <= -15, "likely_negative_but_unproven").otherwise("uncertain")
    return F.when(movement.isNull(), alone).when(movement >= 8, "likely_improving").when(movement <= -8, "likely_declining").otherwise("likely_stable")


def benchmark_signal(gap: Column, label: Column) -> Column:
    return F.when(F.contains(label, F.lit("insufficient")) | F.contains(label, F.lit("gap")), "evidence_gap").when(F.abs(gap) < 5, "near_parity").when(gap > 0, "selected_product_preferred").otherwise("competitor_preferred")


def sentiment_label(positive: Column, negative: Column, neutral: Column, score: Column) -> Column:
    mixed = F.when(F.abs(score) < 25, "mixed").when(score > 0, "polarized-positive").otherwise("polarized-negative")
    one = F.when(score >= 25, "positive-heavy").when(score <= -25, "negative-heavy").when(neutral > 0, "neutral").otherwise("mixed")
    return F.when(positive + negative + neutral == 0, "no-signal").when((positive > 0) & (negative > 0), mixed).otherwise(one)


def priority_bucket(mentions: Column, positive: Column, negative: Column, score: Column) -> Column:
    thin = F.when(score >= 25, "small-delight").when(score <= -25, "watchlist-complaint").otherwise("thin-evidence")
    bad = F.when(mentions >= 3, "high-volume-complaint").otherwise("complaint-driver")
    good = F.when(mentions >= 3, "high-volume-delight").otherwise("delight-driver")
    return F.when(mentions < 2, thin).when(negative > positive, bad).when(positive > negative, good).otherwise("mixed-signal")


def priority_level(bucket: Column) -> Column:
    return F.when(bucket.isin("high-volume-complaint", "complaint-driver"), "high").when(bucket.isin("watchlist-complaint", "mixed-signal"), "medium").when(bucket.isin("high-volume-delight", "delight-driver"), "positive").otherwise("low")


def mood_balance(positive: Column, negative: Column, neutral: Column) -> Column:
    return F.when(positive + negative + neutral == 0, "No Signal").when(positive > negative * 1.25, "Positive-Leaning").when(negative > positive * 1.25, "Negative-Leaning").otherwise("Mixed")


def evidence_strength(n: Column) -> Column:
    return F.when(n == 0, "No Evidence").when(n < 30, "Early Signal").when(n < 100, "Directional").when(n < 500, "Stronger Signal").otherwise("High Confidence")


def price_band(price: Column) -> Column:
    return F.when(price.isNull(), "10000-35000").when(price <= 15000, "10000-15000").when(price <= 20000, "15000-20000").when(price <= 25000, "20000-25000").otherwise("25000-35000")


def segment(band: Column) -> Column:
    # Fixed values
    names = {"10000-15000": "Budget", "15000-20000": "Lower Mid-range", "20000-25000": "Mid-range", "25000-35000": "Upper Mid-range", "10000-35000": "Budget–Mid-range"}
    return F.coalesce(F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[F.coalesce(band, F.lit(""))], band, F.lit(""))


# What can be done about an aspect
ACTIONS = {
    "battery": "hardware_or_software_optimization", "camera": "software_tuning_or_next_gen_camera", "display": "hardware_display_or_brightness_planning", "performance": "software_optimization", "heating": "thermal_optimization",
    "charging": "charger_accessory_or_charging_stack", "software": "software_fixable", "ui": "software_fixable", "connectivity": "modem_network_stack_or_operator_context", "audio": "hardware_or_software_audio_tuning",
    "design": "next_gen_industrial_design", "value": "pricing_or_marketing_position", "after_sales": "cx_process",
}


def theme_type(sentiment: Column) -> Column:
    return F.when(sentiment == "negative", "complaint").when(sentiment == "positive", "delight").otherwise("watchlist")


def theme_name(aspect: Column, sentiment: Column) -> Column:
    return F.concat(F.initcap(F.lower(F.replace(aspect, F.lit("_"), F.lit(" ")))), F.lit(" "), theme_type(sentiment), F.lit(" theme"))


def actionability(aspect: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in ACTIONS.items() for x in kv))
    return F.coalesce(F.try_element_at(known, aspect), F.lit("analyst_review_required"))


def theme_text(aspect: Column, sentiment: Column, mentions: Column, severity_: Column) -> Column:
    n = mentions.cast("string")
    bad = F.concat(aspect, F.lit(" is appearing as a complaint theme in "), n, F.lit(" mention(s). Severity score is "), severity_.cast("string"), F.lit("; prioritize if this grows with more data."))
    good = F.concat(aspect, F.lit(" is appearing as a delight driver in "), n, F.lit(" mention(s). This may be useful for product positioning or marketing evidence."))
    return F.when(sentiment == "negative", bad).when(sentiment == "positive", good).otherwise(F.concat(aspect, F.lit(" has mixed/neutral signals. Keep it on watchlist until more evidence is available.")))


def movement_text(aspect: Column, direction_: Column, movement: Column, current: Column, previous: Column, label: Column) -> Column:
    end = F.concat(F.lit("Direction is "), direction_, F.lit("; confidence is "), label, F.lit("."))
    alone = F.concat(aspect, F.lit(" has "), current.cast("string"), F.lit(" current-period mention(s) but no previous-period baseline. "), end)
    moved = F.concat(aspect, F.lit(" moved by "), movement.cast("string"), F.lit(" points versus the previous period ("), previous.cast("string"), F.lit(" previous mention(s), "), current.cast("string"), F.lit(" current mention(s)). "), end)
    return F.when(movement.isNull(), alone).otherwise(moved)


def severity(count: Column, intensity: Column, confidence: Column, negative: Column) -> Column:
    return rounded(count * intensity * confidence * F.when(negative, 1.25).otherwise(1.0), 3)
