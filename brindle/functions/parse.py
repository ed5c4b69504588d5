"""Dates, prices, ratings, votes and urls out of text. Bad values give NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OLDEST = 700_000  # days back; a date before the year 1 is none
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def _month(t: Column) -> Column:
    return F.nullif(F.array_position(F.array(*map(F.lit, _MONTHS)), F.substring(F.lower(t), 1, 3)), F.lit(0))


def _date(y: Column, m: Column, d: Column) -> Column:
    d = F.when(d == "", F.lit("1")).otherwise(d)
    return F.concat_ws("-", y, F.lpad(m.cast("string"), 2, "0"), F.lpad(d, 2, "0")).try_cast("date")


def iso_date(t: Column) -> Column:
    return F.try_to_timestamp(F.substring(t, 1, 10), F.lit("yyyy-MM-dd")).cast("date")


def launch_date(t: Column) -> Column:
    """'2025, March 7', 'Mar 2025', '2025-03', '2025-03-07'."""
    t = F.trim(t)
    a, b, c = r"(\d{4}),?\s+([A-Za-z]+)(?:\s+(\d{1,2}))?", r"([A-Za-z]+)\s+(\d{4})", r"^(\d{4})-(\d{2})(?:-(\d{2}))?"
    g = F.regexp_extract
    first = F.when(_month(g(t, a, 2)).isNotNull(), _date(g(t, a, 1), _month(g(t, a, 2)), g(t, a, 3)))
    second = F.when(_month(g(t, b, 1)).isNotNull(), _date(g(t, b, 2), _month(g(t, b, 1)), F.lit("1")))
    third = F.when(t.rlike(c), _date(g(t, c, 1), g(t, c, 2), g(t, c, 3)))
    return F.coalesce(first, second, third)


def relative_date(t: Column, as_of: Column) -> Column:
    """'today', 'yesterday', '3 weeks ago' (months of 30 and years of 365 days) before as_of."""
    low = F.lower(F.trim(t))
    n = F.regexp_extract(low, r"(\d+)\s*(day|week|month|year)s?\s*ago", 1)
    unit = F.regexp_extract(low, r"(\d+)\s*(day|week|month|year)s?\s*ago", 2)
    scale = F.when(unit == "day", 1).when(unit == "week", 7).when(unit == "month", 30).otherwise(365)
    days = F.when(low == "today", 0).when(low == "yesterday", 1).when(n != "", F.try_multiply(n.try_cast("int"), scale))
    return F.when(days <= _OLDEST, F.date_sub(as_of, days))


def posted_date(t: Column) -> Column:
    """'Reviewed in X on 15 March 2025'."""
    p = r"on (\d{1,2}) ([A-Za-z]+) (\d{4})"
    return F.when(_month(F.regexp_extract(t, p, 2)).isNotNull(), _date(F.regexp_extract(t, p, 3), _month(F.regexp_extract(t, p, 2)), F.regexp_extract(t, p, 1)))


def feed_date(t: Column) -> Column:
    """The calendar date of a mail-style header, 'Wed, 01 May 2026 10:00:00 GMT'."""
    p = r"(\d{1,2}) ([A-Za-z]{3})[a-z]* (\d{4})"
    return F.when(_month(F.regexp_extract(t, p, 2)).isNotNull(), _date(F.regexp_extract(t, p, 3), _month(F.regexp_extract(t, p, 2)), F.regexp_extract(t, p, 1)))


def votes(t: Column) -> Column:
    """'One person found this helpful' is 1, '1,234 people ...' is 1234."""
    low = F.lower(F.trim(t))
    return F.when(low.startswith("one person"), 1).otherwise(F.replace(F.regexp_extract(low, r"([\d,]+)", 1), F.lit(",")).try_cast("int"))


def price(t: Column) -> Column:
    """The first number, the lower end of a range; currency signs and dots don't count."""
    t = F.replace(F.replace(F.replace(t, F.lit("₹")), F.lit("Rs")), F.lit("."))
    return F.replace(F.regexp_extract(t, r"([\d,]+)", 1), F.lit(",")).try_cast("int")


def rating(t: Column) -> Column:
    """The first number of 1 to 5 with at most one decimal, as text without '.0'; empty if there is none."""
    return F.regexp_replace(F.regexp_extract(t, r"\b([1-5](?:\.\d)?)\b", 1), r"\.0$", "")


def slug(t: Column) -> Column:
    t = F.regexp_replace(F.lower(F.trim(t)), r"[^a-z0-9\s]", "")
    return F.regexp_replace(F.regexp_replace(t, r"\s+", "_"), "^_+|_+$", "")


def review_url(u: Column) -> Column:
    """The url with none but its pid and lid parameters."""
    part = lambda k: F.try_parse_url(u, F.lit("QUERY"), F.lit(k))
    q = F.concat_ws("&", *(F.when(part(k).isNotNull(), F.concat(F.lit(f"{k}="), part(k))) for k in ("pid", "lid")))
    base = F.regexp_extract(u, r"^([^?#]+)", 1)
    return F.when(q == "", base).otherwise(F.concat(base, F.lit("?"), q))


# Brands by which product names start
BRANDS = ["Samsung", "Xiaomi", "Redmi", "POCO", "Realme", "Vivo", "OPPO", "Motorola", "OnePlus", "iQOO", "Nothing", "Lava", "Tecno", "Infinix", "itel", "Nokia", "Google", "Apple", "ASUS", "Sony", "Honor"]


def brand_prefix(t: Column, brands: list[str] = BRANDS) -> Column:
    """The first brand that the name starts with, whatever the case, else its first word; empty for an empty name."""
    t = F.trim(F.coalesce(t, F.lit("")))
    known = F.coalesce(*(F.when(F.lower(t).startswith(b.lower()), F.lit(b)) for b in brands))
    return F.coalesce(known, F.split(t, r"\s+")[0])


def uuid5_url(seed: Column) -> Column:
    """The version-5 UUID of seed in the URL namespace."""
    space = F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8"))
    h = F.sha1(F.concat(space, F.encode(seed, "utf-8")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), 1, 16)
    nibble = F.substr(variant, F.conv(F.substring(h, 17, 1), 16, 10).cast("int") + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(nibble, F.substring(h, 18, 3)), F.substring(h, 21, 12))
