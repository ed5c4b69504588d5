"""Rules on text, against sentences with known answers and a plain-Python reading of the rules."""

import datetime
import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from brindle.functions import aspects, identity, lexicon, parse, text
from brindle.operators import compare, mutate, news, quality, resolve, summary
from brindle.sources import readers

# sentence, rating, aspects that must be found with their sentiment, aspects that must not
SENTENCES = [
    ("Phone 10 min gaming ke baad garam tawa ban jata hai", 3, {"heating": "negative"}, {"performance"}),
    ("UI lag karta hai aur software bugs bahut hain", 3, {"software": "negative"}, {"performance"}),
    ("Design premium lagta hai, haath me feel acha hai", 3, {"design": "positive"}, {"performance"}),
    ("Speaker loud hai aur call quality clear hai", 3, {"audio": "positive"}, set()),
    ("Network bar bar drop hota hai, internet unstable hai", 3, {"connectivity": "negative"}, set()),
    ("Display bright hai, outdoor me clearly dikhta hai", 3, {"display": "positive"}, set()),
    ("Performance smooth hai, apps fast open hote hain", 3, {"performance": "positive"}, set()),
    ("Camra zabardast hai", 5, {"camera": "positive"}, set()),
    ("Bhai camera mast hai but battery backup bekar hai", 3, {"camera": "positive", "battery": "negative"}, set()),
    ("Delivery late thi, product ka issue nahi hai", 1, {}, {"camera", "battery"}),
]


@pytest.fixture(scope="module")
def analysed(spark):
    rows = [(str(k), "p", t, float(r)) for k, (t, r, _, _) in enumerate(SENTENCES)]
    rows += [("a", "p", "Battery backup bakwas hai aur phone garam hota hai", 5.0), ("b", "p", "Phone display good hai but delivery late thi and packaging damaged tha", 4.0), ("n", "p", None, None), ("e", "p", "", 3.0), ("w", "p", "wah wah kya phone hai", 3.0)]
    return {r.review_id: r for r in quality.needs_review(quality.analyse(spark.createDataFrame(rows, "review_id string, product_id string, raw_text string, rating double"))).collect()}


@pytest.mark.parametrize("k", range(len(SENTENCES)))
def test_sentences(analysed, k):
    _, _, want, absent = SENTENCES[k]
    got = {a.aspect: a.sentiment for a in analysed[str(k)].aspects}
    assert {a: got.get(a) for a in want} == want and not absent & set(got)


def test_flags_and_signals(analysed):
    assert analysed["a"].contradiction_flag and not analysed["0"].contradiction_flag
    assert {"delivery", "packaging", "product"} <= set(analysed["b"].signal_types)
    assert analysed["7"].clean_text == "camera zabardast hai" and analysed["7"].processing_notes
    assert analysed["w"].sarcasm_flag and analysed["w"].route_reason == "sarcasm"
    assert analysed["e"].aspects == [] and analysed["n"].aspects == []
    assert analysed["0"].language_profile.primary_language == "hi_en_mixed"


def plain_aspects(t):
    """The rules read as plain loops."""
    low, found = t.lower(), []
    at = lambda s, w: (m.start() if (m := re.search(rf"(?<![a-z0-9]){re.escape(w)}(?![a-z0-9])", s)) else -1)
    for n, (aspect, term, conf, prior) in enumerate(lexicon.aspect_terms()):
        if (i := at(low, term)) >= 0:
            found.append((i, aspect, n, term, conf, prior))
    out, seen = [], set()
    for i, aspect, _, term, conf, prior in sorted(found, key=lambda f: f[:3]):
        skip = any(a == aspect and w == term and (any(x in low for x in ws) != beside) for a, w, beside, ws in lexicon.CONTEXTS)
        if aspect in seen or skip:
            continue
        seen.add(aspect)
        start = max(0, i - aspects.REACH)
        ev = t[start : min(len(t), i + len(term) + aspects.REACH)].strip(" ")
        moods = [(0 if (j := at(ev.lower(), w)) >= i - start else 1, abs(j - i + start), -inten, n, m, c) for n, (w, m, inten, c) in enumerate(lexicon.sentiment_terms()) if at(ev.lower(), w) >= 0]
        mood, c = (min(moods)[4:] if moods else (prior, 0.7) if prior else ("neutral", 0.48))
        out.append((aspect, mood, round(min(c, conf), 3)))
    return out


def test_aspects_like_plain_loops(spark):
    rng = random.Random(4)
    vocabulary = [t for _, t, _, _ in lexicon.aspect_terms()] + [t for t, *_ in lexicon.sentiment_terms()] + "hai aur but the quite network hand word x".split()
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 25))) for _ in range(300)]
    df = aspects.with_aspects(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string"), "t")
    for r in df.collect():
        assert [(a.aspect, a.sentiment, round(a.confidence, 3)) for a in r.aspects] == plain_aspects(texts[r.k]), texts[r.k]


def test_parse(spark):
    as_of = F.lit("2026-05-10").cast("date")
    row = spark.range(1).select(
        parse.launch_date(F.lit("2025, March 7")).alias("a"), parse.launch_date(F.lit("Mar 2025")).alias("b"), parse.launch_date(F.lit("2025-03")).alias("c"), parse.launch_date(F.lit("soon")).alias("d"),
        parse.relative_date(F.lit("3 weeks ago"), as_of).alias("e"), parse.posted_date(F.lit("Reviewed in India on 15 March 2025")).alias("f"), parse.votes(F.lit("One person found this helpful")).alias("g"),
        parse.price(F.lit("₹12,999 - ₹14,999")).alias("h"), parse.rating(F.lit("4.0 out of 5")).alias("i"), parse.uuid5_url(F.lit("shop|p|1")).alias("j"), parse.feed_date(F.lit("Wed, 01 May 2026 23:30:00 +0530")).alias("k"),
        text.int_via_float(F.lit("4.0")).alias("l"), text.null_token(F.lit(" N/A ")).alias("m"), parse.iso_date(F.lit("2026-13-40")).alias("n"), text.tri_state(F.lit("Verified")).alias("o"),
    ).first()
    d = datetime.date
    assert (row.a, row.b, row.c, row.d, row.e, row.f) == (d(2025, 3, 7), d(2025, 3, 1), d(2025, 3, 1), None, d(2026, 4, 19), d(2025, 3, 15))
    assert (row.g, row.h, row.i, row.k, row.l, row.m, row.n, row.o) == (1, 12999, "4", d(2026, 5, 1), 4, None, None, True)
    assert row.j == str(uuid.uuid5(uuid.NAMESPACE_URL, "shop|p|1"))


def test_identity_and_resolution(spark):
    names = [("Tecno Pova 7 Pro 5G (8GB 256GB, Black)", None), ("TecnoPova7 Pro 5 G", None), ("RedmiNote 13 Pro+", "Redmi"), ("Infinix Note50x 5G", "Infinix"), ("", None), (None, None)]
    got = identity.with_identity(spark.createDataFrame(names, "n string, b string"), "n", "b").collect()
    assert got[0].identity.product_id == got[1].identity.product_id == "tecno_pova_7_pro_5g"
    assert got[0].identity.variant == "8gb_ram_256gb_storage"
    assert got[2].identity.canonical_key == "redmi|note_13_pro_plus" and got[4].identity.model_key == "unknown_model"
    cat = spark.createDataFrame([("tecno_pova_7_pro_5g", "Tecno Pova 7 Pro 5G", "tecno"), ("itel_a95_5g", "itel A95 5G", "itel")], "product_id string, product_name string, brand string")
    rows = spark.createDataFrame([("x", "Tecno Pova 7 Pro 5G", "tecno"), ("itel_a95_5g", "whatever", None), ("y", "Pova 7 Pro 5G", None), ("z", "Tecno Pova 7 Pr0 5G", "tecno"), (None, None, None)], "product_id string, product_name string, brand string")
    kinds = [r.match_kind for r in resolve.resolve(rows.coalesce(1), cat).orderBy(F.col("product_id").asc_nulls_last()).collect()]
    assert sorted(kinds) == sorted(["id", "canonical_key", "model_key", "similarity", "unresolved"])


def test_cleaner_and_preview(spark):
    r = [(1, "p", "P", "http://x", "Good camera and battery backup", "m"), (2, "p", "P", "http://x", "good camera and battery  backup", "m"), (3, "p", "P", "http://x", "Helpful for 12", "m"), (4, "p", None, "http://x", "nice", "m"), (5, "p", "P", "ftp", "nice phone", "m"), (6, "p", "P", "http://x", "R A T A N KAR", "m"), (7, "p", "P", "http://x", "READ MORE", "m"), (8, "p", "P", "http://x", None, "m"), (9, "p", "P", "http://x", "Some village nice phone", "m")]
    got = {x.seq: x.status for x in quality.clean_reviews(spark.createDataFrame(r, "seq int, product_id string, product_name string, source_url string, raw_text string, marketplace string")).collect()}
    assert got == {1: "clean", 2: "duplicate", 3: "helpful_count_only", 4: "missing_product_name", 5: "missing_source_url", 6: "name_like_text", 7: "metadata_only", 8: "missing_raw_text", 9: "location_or_address"}
    p = [(2, "r1", "a", "fine and long enough", "4", "2026-01-02"), (3, "r1", "a", "fine and long enough", "x", "2026-13-02"), (4, "r1", "", "", "9", "")]
    pv = quality.preview(spark.createDataFrame(p, "row_number int, review_id string, product_id string, raw_text string, rating string, review_date string"))
    by = {x.row_number: x for x in pv.collect()}
    assert not by[2].errors and len(by[3].errors) == 2 and len(by[4].errors) == 3 and "review_id is repeated." in by[3].warnings
    assert quality.preview_counts(pv).first().valid_count == 1


def test_ingest(spark):
    schema = "seq long, review_id string, product_id string, rating double, review_date string, raw_text string, source string, marketplace string, marketplace_product_id string, marketplace_review_id string, reviewer_hash string"
    rows = [(1, "a", "p", 4.0, "d", "Nice phone!", "s", None, None, "m1", None), (2, "b", "p", 4.0, "d2", "nice  phone", "s", None, None, "m2", None), (3, "c", "p", 4.0, "d", "other", "s", None, None, "m1", None), (4, "d", "p", 3.0, "d", "nice phone", "s", None, None, None, None)]
    keyed = mutate.review_keys(spark.createDataFrame(rows, schema))
    got = {r.review_id: (r.status, r.canonical_id) for r in mutate.ingest(keyed).collect()}
    assert got == {"a": ("insert", "a"), "b": ("attach", "a"), "c": ("touch", got["c"][1]), "d": ("insert", "d")}
    again = {r.review_id: r.status for r in mutate.ingest(keyed, keyed).collect()}
    assert set(again.values()) == {"touch"}


def test_forecast_reversed_and_empty(spark):
    schema = "review_id string, product_id string, aspect string, sentiment string, intensity double, confidence double, review_date date"
    d = datetime.date
    f = spark.createDataFrame([("o", "p", "battery", "negative", 0.9, 0.9, d(2026, 3, 1)), ("n", "p", "camera", "positive", 0.9, 0.9, d(2026, 4, 1)), ("u", "p", "camera", "positive", 0.9, 0.9, None)], schema)
    assert [r.aspect for r in compare.forecast(f, "2026-04-01", "2026-04-01").collect()] == ["camera"]
    assert compare.forecast(f.limit(0), "2026-04-01", "2026-04-02").count() == 0
    assert summary.net_sentiment(f.limit(0)).count() == 0


def test_news(spark):
    rows = [("Qualcomm brings on-device AI to Snapdragon smartphone chipset in India", "generative AI", []), ("Bakery opens", "bread", []), (None, None, None)]
    got = news.classify(spark.createDataFrame(rows, "title string, summary string, default_tags array<string>")).collect()
    assert got[0].priority_label == "high" and "qualcomm" in got[0].company_tags and got[1].priority_label == got[2].priority_label == "low"
    xml = "<rss><channel><item><title>A</title><link>http://x.com/1</link><description>&lt;p&gt;hi&lt;/p&gt;</description><pubDate>Wed, 01 May 2026 10:00:00 GMT</pubDate></item><item><title>B</title></item></channel></rss>"
    items = readers.rss(spark.createDataFrame([("f", xml)], "feed string, xml string")).collect()
    assert [(i.title, i.url, i.published_date) for i in items] == [("A", "http://x.com/1", datetime.date(2026, 5, 1))]


def test_sources(spark, tmp_path):
    (tmp_path / "r.csv").write_text("﻿review_id,product\\_id,raw_text,rating\nr1,Phone A,\"nice, phone\",4\n,phone b,ok,x\n", encoding="utf-8")
    got = readers.reviews(readers.read_csv(spark, str(tmp_path / "r.csv"))).orderBy("product_id").collect()
    assert got[0].product_id == "phone_a" and got[0].raw_text == "nice, phone" and got[0].error is None
    assert got[1].error == "rating is not a number" and len(got[1].review_id) == 36
    page = '<div data-hook="review"><i data-hook="review-star-rating"><span>4.0 out of 5</span></i><span data-hook="review-body"><b>Good</b> phone &amp; more</span></div><div data-hook="review"><span data-hook="review-body"></span></div>'
    cards = readers.review_pages(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")).collect()
    assert [(c.page_id, c.body) for c in cards] == [(1, "Good phone & more")]


def test_golden_report(spark):
    rows = [(str(k), "p", t, float(r)) for k, (t, r, *_) in enumerate(SENTENCES)]
    analysed = quality.analyse(spark.createDataFrame(rows, "review_id string, product_id string, raw_text string, rating double"))
    f = quality.facts(analysed, "review_id", "product_id")
    predicted = f.select("review_id", "aspect", F.col("sentiment").alias("label"))
    want = [(str(k), a, m) for k, (_, _, w, _) in enumerate(SENTENCES) for a, m in w.items()]
    expected = spark.createDataFrame(want, "review_id string, aspect string, label string")
    report = compare.label_report(compare.label_match(expected, predicted, "review_id", "aspect"), "review_id").first()
    assert report.recall >= 0.45 and report.sentiment_accuracy >= 0.65 and report.expected == len(want)


def test_second_opinion(spark):
    schema = "review_id string, aspects array<struct<aspect:string,sentiment:string>>, quality_score double, contradiction_flag boolean, sarcasm_flag boolean"
    rules = spark.createDataFrame([("a", [("camera", "positive")], 0.5, False, False), ("b", [], 0.5, True, False)], schema)
    other = spark.createDataFrame([("a", [("camera", "negative"), ("x", "odd")], 0.9, True, False), ("b", [("x", "odd")], 0.9, False, True)], schema)
    got = {r.review_id: r for r in quality.merge_second_opinion(rules, other).collect()}
    assert [x.sentiment for x in got["a"].aspects] == ["negative"] and got["a"].quality_score == 0.72 and got["a"].contradiction_flag
    assert got["b"].aspects == [] and got["b"].quality_score == 0.5 and not got["b"].sarcasm_flag
