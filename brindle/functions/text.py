"""Expressions over review text. All take and return columns and run inside the JVM, but for `unescape_full`."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions import lexicon as lx


@F.pandas_udf(T.StringType())
def unescape_full(s: pd.Series) -> pd.Series:
    """All HTML entities and NFC; Spark has no function for either."""
    return s.map(lambda t: unicodedata.normalize("NFC", html.unescape(t)), na_action="ignore")


def unescape_basic(t: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return t


def clean(t: Column) -> Column:
    """Entities, zero-width characters, tags, shop boilerplate and runs of white space removed."""
    t = F.regexp_replace(unescape_basic(t), "[​-‍﻿]", "")
    t = F.regexp_replace(t, "<[^>]+>", " ")
    t = F.replace(F.replace(t, F.lit("READ MORE"), F.lit(" ")), F.lit("Certified Buyer"), F.lit(" "))
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def normalise_spelling(t: Column) -> Column:
    for r in lx.of_type("spelling_variant"):
        t = F.regexp_replace(t, f"(?i){r['term']}", r["normalized"])
    return t


def spelling_notes(t: Column) -> Column:
    notes = []
    for r in lx.of_type("spelling_variant"):
        notes.append(F.when(F.contains(F.lower(t), F.lit(r["term"])), F.lit(f"normalized '{r['term']}' to '{r['normalized']}'")))
    return F.array_compact(F.array(*notes))


def has_any(t: Column, terms: list[str]) -> Column:
    """Whether any term is inside t. One pattern for all: in a chain of ORs, t would be computed again for each term."""
    return t.rlike("|".join(re.sub(r"([^\w\s])", r"\\\1", term) for term in terms))


def let(x: Column, f) -> Column:
    """f(x), with x computed once however often f names it."""
    return F.transform(F.array(x), f)[0]


def language_profile(t: Column) -> Column:
    """struct(primary_language, script, hinglish_hints, confidence)."""
    tokens = F.transform(F.regexp_extract_all(t, F.lit("([A-Za-zऀ-ॿ]+)"), F.lit(1)), F.lower)
    hints = F.array_sort(F.array_intersect(tokens, F.array(*map(F.lit, lx.HINGLISH_HINTS))))
    indic, hit = t.rlike("[ऀ-ॿ]"), F.size(hints) > 0
    return F.struct(
        F.when(hit, "hi_en_mixed").when(indic, "hi_or_indic").otherwise("en_or_unknown").alias("primary_language"),
        F.when(indic & hit, "mixed").when(indic, "devanagari").when(hit, "roman").otherwise("latin").alias("script"),
        hints.alias("hinglish_hints"),
        F.when(indic & hit, 0.82).when(indic, 0.78).when(hit, F.least(F.lit(95), 62 + 4 * F.size(hints)) / 100.0).otherwise(0.62).alias("confidence"),
    )


def evidence_language(t: Column, markers: tuple[str, ...] = ("mast", "bakwas", "ekdum", "nahi", "nahin", "hai", "bahut", "bhai")) -> Column:
    """hinglish from three marker words on, mixed from one on, else english."""
    n = F.regexp_count(F.lower(t), F.lit(r"\b(" + "|".join(markers) + r")\b"))
    return F.when(n >= 3, "hinglish").when(n >= 1, "mixed").otherwise("english")


def signal_types(t: Column) -> Column:
    """Sorted array of what a review speaks of; `unclear` if of nothing known."""

    def found(low: Column) -> Column:
        gate = F.coalesce(has_any(low, [r["term"] for r in lx.of_type("delivery_service")]), F.lit(False))
        gated = [("delivery", ["delivery", "courier"]), ("packaging", ["packag", "box"]), ("seller", ["seller"]), ("service", ["return", "refund", "warranty", "service"])]
        kinds = let(gate, lambda g: F.array(*(F.when(g & has_any(low, terms), kind) for kind, terms in gated)))
        product = F.when(has_any(low, [r["term"] for r in lx.of_type("aspect", "spelling_variant")]), "product")
        return F.array_sort(F.array_compact(F.concat(kinds, F.array(product))))

    return let(let(F.lower(t), found), lambda a: F.when(F.size(a) == 0, F.array(F.lit("unclear"))).otherwise(a))


def sarcasm(t: Column) -> Column:
    return has_any(F.lower(t), [r["term"] for r in lx.of_type("sarcasm_marker")])


def hash_text(t: Column) -> Column:
    """Lower case, white space collapsed, only a-z, digits, Devanagari and spaces: what text hashes are made of."""
    t = F.regexp_replace(F.trim(F.lower(F.coalesce(t, F.lit("")))), r"\s+", " ")
    return F.trim(F.regexp_replace(t, "[^a-z0-9ऀ-ॿ ]+", ""))


def sha(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def first_filled(*values: Column) -> Column:
    """The first value that is not blank, trimmed."""
    return F.coalesce(*(F.nullif(F.trim(v), F.lit("")) for v in values))


NULL_TOKENS = ("", "nan", "none", "null", "n/a", "na", "-", "--")


def null_token(t: Column) -> Column:
    """Trimmed with white space collapsed and escaped underscores repaired; NULL for the usual null words."""
    t = F.trim(F.regexp_replace(F.replace(t, F.lit("\\_"), F.lit("_")), r"\s+", " "))
    return F.when(~F.lower(t).isin(*NULL_TOKENS), t)


# What counts as true and false in reviews and in catalogues
REVIEW_FLAGS = (("true", "1", "yes", "y", "verified", "verified_purchase"), ("false", "0", "no", "n", "unverified"))
CATALOGUE_FLAGS = (("1", "true", "yes", "y", "own", "owned"), ("0", "false", "no", "n", "competitor"))


def tri_state(t: Column, words: tuple = REVIEW_FLAGS) -> Column:
    yes, no = words
    t = F.lower(F.trim(t))
    return F.when(t.isin(*yes), True).when(t.isin(*no), False)


def int_via_float(t: Column) -> Column:
    return F.trim(t).try_cast("double").try_cast("int")


def labelize(t: Column) -> Column:
    return F.initcap(F.lower(F.replace(t, F.lit("_"), F.lit(" "))))


def sentence(t: Column) -> Column:
    t = F.trim(t)
    return F.when(t.rlike("[.!?]$"), t).when(t == "", t).otherwise(F.concat(t, F.lit(".")))


def truncate(t: Column, n: int) -> Column:
    return F.when(F.char_length(t) <= n, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, n - 3)), F.lit("...")))


def json_list(t: Column, element: str = "string") -> Column:
    """A JSON array, empty where the text is null, bad or no array."""
    return F.coalesce(F.from_json(t, f"array<{element}>"), F.array().cast(f"array<{element}>"))


def without_scores(t: Column) -> Column:
    """Text without '12 points' and 'by 3.5'."""
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)\b\d+(?:\.\d+)?\s*points?\b", ""), r"(?i)\bby\s+\d+(?:\.\d+)?\b", "")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def joined_short(values: Column) -> Column:
    """'none', 'a', 'a and b' or 'a, b, and 3 more'; blank values don't count."""
    v = F.filter(values, lambda x: F.coalesce(x, F.lit("")) != "")
    n = F.size(v)
    more = F.concat(F.array_join(F.slice(v, 1, 2), ", "), F.lit(", and "), (n - 2).cast("string"), F.lit(" more"))
    return F.when(n <= 0, "none").when(n <= 2, F.array_join(v, " and ")).otherwise(more)


def bounded(t: Column, default: float, low: float = 0.0, high: float = 1.0) -> Column:
    """A number between low and high out of a text; the default where it is none."""
    x = t.cast("string").try_cast("double")
    return F.when(x.isNull() | F.isnan(x), F.lit(default)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), x)))


def optional(t: Column) -> Column:
    return F.nullif(F.trim(t.cast("string")), F.lit(""))


def one_of(t: Column, words: list[str]) -> Column:
    """The word of the list that the text is, whatever the case; NULL if none."""
    low = F.lower(F.trim(t))
    return F.when(low.isin(*words), low)


def signals_of(product: Column, delivery: Column, service: Column, rest: Column) -> Column:
    """Signal types out of three booleans; the rest where none holds."""
    found = F.array_compact(F.array(F.when(product, "product"), F.when(delivery, "delivery"), F.when(service, "service")))
    return F.when(F.size(found) > 0, found).otherwise(rest)


def yes_no(t: Column) -> Column:
    return F.when(F.lower(t.cast("string")).isin("1", "true", "yes"), "Yes").otherwise("No")


def shown(t: Column) -> Column:
    """The value as a text, empty for NULL."""
    return F.coalesce(t.cast("string"), F.lit(""))


def local_stamp(utc: Column, zone: str = "+05:30", name: str = "IST") -> Column:
    return F.concat(F.date_format(F.from_utc_timestamp(utc, zone), "yyyy-MM-dd HH:mm"), F.lit(f" {name}"))


def distinct_texts(values: Column) -> Column:
    """Each text once, whatever the case, the first as it is written."""
    low = F.transform(values, lambda x: F.lower(x))
    return F.filter(values, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def json_object(t: Column, schema: str) -> Column:
    """The first JSON object inside noisy text, NULL if there is none that parses."""
    return F.from_json(F.regexp_extract(t, r"(?s)(\{.*\})", 1), schema)
