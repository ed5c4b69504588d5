"""Saved shop pages to rows: cards by selectors with fallbacks, reviews, listings and specification tables.

Pages are parsed in Arrow batches; what follows the parse is expressions. A selector is (tag or None, pattern of the class or None);
of a list of selectors the first that finds anything counts, as class names of shops change. Null and empty pages have no cards;
tags that are never closed end with what holds them.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import parse as pr
from brindle.functions import text as tf
from brindle.operators import quality

Selector = tuple[str | None, str | None]
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Node:
    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.parts = tag, attrs, []

    def below(self):
        for p in self.parts:
            if isinstance(p, Node):
                yield p
                yield from p.below()

    def text(self) -> str:
        held = []
        todo = [self]
        while todo:
            p = todo.pop()
            if isinstance(p, str):
                held.append(p)
            elif p.tag not in ("script", "style"):
                todo.extend(reversed(p.parts))
        return " ".join(" ".join(held).split())

    def matches(self, selector: Selector) -> bool:
        tag, kind = selector
        return (tag is None or self.tag == tag) and (kind is None or any(re.search(kind, c) for c in self.attrs.get("class", "").split()))

    def find(self, selectors: list[Selector]) -> list[Node]:
        """All nodes below that the first fruitful selector names, but none inside another."""
        for s in selectors:
            found, inside = [], set()
            for n in self.below():
                if id(n) not in inside and n.matches(s):
                    found.append(n)
                    inside.update(map(id, n.below()))
            if found:
                return found
        return []


class _Tree(HTMLParser):
    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].parts.append(node)
        if tag not in _VOID and len(self.open) < 200:  # deeper tags lie flat
            self.open.append(node)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        self.open[-1].parts.append(data)


def cards(pages: DataFrame, card: list[Selector], fields: dict[str, list[Selector]], key: str = "page_id", page: str = "html") -> DataFrame:
    """(key, place, text, link, fields...): a row for each card of a page, fields as text, empty where nothing is found."""

    def run(frames):
        for f in frames:
            rows = []
            for k, h in zip(f[key], f[page]):
                for n, c in enumerate(_Tree(h).root.find(card) if h else []):
                    link = next((x.attrs["href"] for x in [c, *c.below()] if x.tag == "a" and x.attrs.get("href")), "")
                    rows.append((k, n, c.text(), link, *(found[0].text() if (found := c.find(s)) else "" for s in fields.values())))
            yield pd.DataFrame(rows, columns=[key, "place", "text", "link", *fields])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, page).mapInPandas(run, f"{key} {kind}, place int, text string, link string" + "".join(f", {c} string" for c in fields))


def _date(t: Column, as_of: Column) -> Column:
    """Relative forms and '15 Mar, 2025', '15th March 2025', 'Mar 2025'."""
    low = F.lower(F.trim(t))
    now = low.rlike(r"just now|today|hours? ago|minutes? ago|second")
    relative = F.when(now, as_of).when(F.contains(low, F.lit("yesterday")), F.date_sub(as_of, 1))
    one = F.regexp_replace(low, r"\ba\s+(day|week|month|year)", "1 $1")
    relative = F.coalesce(relative, pr.relative_date(F.regexp_extract(one, r"(\d+\s+(?:day|week|month|year)s?\s*ago)", 1), as_of))
    day = F.regexp_replace(t, r"(\d{1,2})(?:st|nd|rd|th)?\s+([A-Za-z]+),?\s+(\d{4})", "$3, $2 $1")
    return F.coalesce(relative, pr.launch_date(day))


def shop_reviews(found: DataFrame, as_of: Column, key: str = "page_id") -> DataFrame:
    """Cards with body, rating, title and date to reviews; those without a body are left out.

    A rating over five is out of fifty; the id is made of the first 30 characters of the text.
    """
    number = F.regexp_extract("rating", r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    certified = F.contains(F.lower("text"), F.lit("certified buyer"))
    return found.where(F.col("body") != "").select(
        key, "place", F.concat(F.lit("fk_"), F.substring(F.sha2(F.substring("body", 1, 30), 256), 1, 16)).alias("review_id"), F.when(number > 5, number / 10).otherwise(number).alias("rating"), "title",
        F.col("body").alias("raw_text"), _date(F.col("date"), as_of).alias("review_date"), certified.alias("verified_purchase"),
    )


def listings(found: DataFrame, root: str, source: str, key: str = "page_id") -> DataFrame:
    """Cards with name, price and date to phones; names of under four letters are left out, links made whole."""
    link = F.when(F.col("link").startswith("http") | (F.col("link") == ""), F.col("link")).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), F.regexp_replace("link", "^/+", "")))
    return found.where(F.char_length("name") >= 4).select(
        key, "place", F.col("name").alias("model_name"), pr.brand_prefix(F.col("name")).alias("brand"), F.col("price").alias("current_price"), pr.price(F.col("price")).alias("current_price_int"), pr.launch_date(F.col("date")).alias("launch_date"),
        link.alias("specs_url"), F.lit(source).alias("source_name"),
    )


def spec_rows(pages: DataFrame, key: str = "page_id", page: str = "html", tables: list[Selector] = [("table", "(?i)spec"), ("table", None)]) -> DataFrame:  # noqa: B006  never written
    """(key, place, label, value) of every table row with two cells."""

    def run(frames):
        for f in frames:
            rows = []
            for k, h in zip(f[key], f[page]):
                trs = [r for t in (_Tree(h).root.find(tables) if h else []) for r in t.below() if r.tag == "tr"]
                for n, tr in enumerate(trs):
                    cells = [c.text() for c in tr.parts if isinstance(c, Node) and c.tag in ("td", "th")]
                    if len(cells) > 1 and cells[0] and cells[1]:
                        rows.append((k, n, cells[0].lower(), cells[1]))
            yield pd.DataFrame(rows, columns=[key, "place", "label", "value"])

    return pages.select(key, page).mapInPandas(run, f"{key} {pages.schema[key].dataType.simpleString()}, place int, label string, value string")


# By field the parts of labels that name it, in order of preference, what to take of the value, and how it is written
SPEC_FIELDS = {
    "display_size": (["size", "display size"], r"(?i)(\d+\.?\d*)\s*inch(?:es)?", "%s inch"), "display_type": (["type", "display type"], r"(?i)(AMOLED|OLED|LCD|IPS|TFT|LTPO)", "%s"), "refresh_rate": (["refresh"], r"(?i)(\d+)\s*hz", "%sHz"),
    "chipset": (["chipset", "cpu"], r"^\s*([^(]*[^(\s])", "%s"), "android_version": (["os"], r"(?i)android\s*([\d.]+)", "Android %s"), "ram": (["ram"], r"^(.{1,20})", "%s"), "storage": (["internal", "storage"], r"^(.{1,30})", "%s"),
    "battery_capacity": (["capacity", "battery"], r"(?i)(\d[\d,]+)\s*mah", "%s mAh"), "charging_wattage": (["charging"], r"(?i)(\d+)\s*w", "%sW"), "rear_camera": (["main camera", "rear camera", "triple", "dual", "single"], r"(?i)(\d+)\s*mp", "%sMP"),
    "front_camera": (["selfie", "front camera"], r"(?i)(\d+)\s*mp", "%sMP"),
}


def spec_fields(rows: DataFrame, key: str = "page_id") -> DataFrame:
    """A row for each page: of each field the value of the first row whose label holds the likeliest name."""
    out = []
    for field, (labels, pattern, form) in SPEC_FIELDS.items():
        rank = F.lit(None).cast("int")
        for n, part in reversed(list(enumerate(labels))):
            rank = F.when(F.contains("label", F.lit(part)), n).otherwise(rank)
        value = F.min_by("value", F.when(rank.isNotNull(), F.struct(rank, F.col("place"))))
        found = F.nullif(F.regexp_extract(value, pattern, 1), F.lit(""))
        out.append(F.when(found.isNotNull(), F.format_string(form, found)).alias(field))
    return rows.groupBy(key).agg(*out)


# Fixed values
HARD_JUNK = ["outer ring road", "devarabeesanahalli", "flipkart internet private limited", "registered office", "cin :", "telephone:", "contact us", "terms of use", "privacy policy", "social media"]


def hard_junk(t: Column) -> Column:
    """Whether a card's text is of the shop itself; so is one that is empty."""
    low = F.lower(F.coalesce(t, F.lit("")))
    return (low == "") | tf.has_any(low, HARD_JUNK)


def junk(t: Column, opinions: list[str] = quality.OPINIONS) -> Column:
    """Whether a text is no opinion: boilerplate, metadata, a variant, or three words or fewer that say nothing."""
    t = F.trim(F.coalesce(t, F.lit("")))
    low = F.lower(t)
    variants = sum((F.when(F.contains(low, F.lit(w)), 1).otherwise(0) for w in ("color", "ram", "storage")), F.lit(0))
    few = F.size(F.split(t, r"\s+")) <= 3
    return (t == "") | tf.has_any(low, quality.JUNK) | low.startswith("review for:") | low.isin(*quality.METADATA) | (F.contains(t, F.lit("•")) & (variants >= 2)) | (few & ~tf.has_any(low, opinions))
