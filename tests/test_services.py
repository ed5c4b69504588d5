"""Imports, golden cases, lists, pages, reports and small expressions, on fixtures with known answers."""

import datetime
import difflib
import json
import random

import pytest
from pyspark.sql import functions as F

from brindle import cli
from brindle.functions import identity, parse, scores, text
from brindle.operators import compare, dashboard, golden, imports, listing, mutate, news, quality, resolve, summary
from brindle.sources import pages, readers
from brindle.streaming import incremental

CATALOGUE = [("infinix_note_60_pro", "Infinix Note 60 Pro", "Infinix"), ("itel_zeno_200", "itel Zeno 200", "itel"), ("tecno_pova_curve_2_5g", "Tecno Pova Curve 2 5G", "TECNO"), ("tecno_pova_curve_2_5g", "Tecno Pova Curve 2 5G", "TECNO")]


@pytest.fixture(scope="module")
def catalogue(spark):
    return spark.createDataFrame(CATALOGUE, "product_id string, product_name string, brand string")


def test_normaliser(spark, catalogue):
    """Nine rows: seven kept, one duplicate, one unresolved; and one without text."""
    rows = [
        (1, None, "Infinix Note 60 Pro", "Infinix", "Good camera", "5"), (2, None, "infinix note60 pro", None, "Nice battery", "4"), (3, "itel_zeno_200", None, None, "ok phone", "3"), (4, None, "itel Zeno200", "itel", "cheap", "4"),
        (5, None, "TecnoPova Curve 2 5 G", None, "curved", "5"), (6, None, "Tecno Pova Curv 2 5G", "tecno", "typo", "5"), (7, None, "Note 60 Pro", None, "no brand", "2"), (8, None, "Infinix Note 60 Pro", "Infinix", "GOOD  camera!!", "5"),
        (9, None, "Acme Rocket 9", "Acme", "what is this", "1"), (10, None, "itel Zeno 200", "itel", " n/a ", "1"),
    ]
    df = spark.createDataFrame(rows, "row_number int, product_id string, product string, brand string, comments string, stars string")
    got = {r.row_number: r for r in imports.normalise_reviews(df, catalogue).collect()}
    assert [got[k].status for k in range(1, 11)] == ["kept"] * 7 + ["duplicate", "unresolved", "skipped"]
    assert [got[k].product_id for k in range(1, 8)] == ["infinix_note_60_pro"] * 2 + ["itel_zeno_200"] * 2 + ["tecno_pova_curve_2_5g"] * 2 + ["infinix_note_60_pro"]
    assert got[1].review_id.startswith("norm_") and got[1].marketplace == "manual_csv" and got[1].rating == "5" and got[1].review_date == ""
    assert imports.normalise_reviews(df.limit(0), catalogue).count() == 0


def test_similar_finds_what_a_full_comparison_finds(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcde 12", k=rng.randint(1, 14)))
    names = [(f"c{k:03}", word()) for k in range(60)]
    asked = [word() for _ in range(40)] + [n[:-1] + "e" for _, n in names[:30]]
    df = spark.createDataFrame([(t,) for t in {*asked, *(n for _, n in names)}], "t string")
    norm = {r.t: r.n for r in df.select("t", identity.name(F.col("t")).alias("n")).collect()}
    got = {r.asked: (r.cid, r.s) for r in resolve.similar(spark.createDataFrame([(a,) for a in asked], "asked string"), spark.createDataFrame(names, "cid string, name string"), 0.82).collect()}
    for a in set(asked):
        scored = [(-(1.0 if norm[a] == norm[n] else round(difflib.SequenceMatcher(None, norm[a], norm[n]).ratio(), 4)), c) for c, n in names if norm[a] and norm[n]]
        best = min(scored, default=(0, None))
        assert got.get(a) == ((best[1], -best[0]) if -best[0] >= 0.82 else None), a


def test_resolution_of_repeated_ids(spark, catalogue):
    rows = spark.createDataFrame([("tecno_pova_curve_2_5g", "x", None), ("q", "Tekno Pova Curve 2 5G", "tekno")], "product_id string, product_name string, brand string")
    got = {r.product_id: (r.resolved_id, r.match_kind) for r in resolve.resolve(rows, catalogue).collect()}
    assert len(got) == 2 and got["tecno_pova_curve_2_5g"] == ("tecno_pova_curve_2_5g", "id") and got["q"] == ("tecno_pova_curve_2_5g", "similarity")


def test_catalogue_import(spark):
    rows = [("Infinix Note 60 Pro", None, "13,999", "a; b ;"), ("Acme One", "Acme", None, None), ("Infinix Note 60 Pro", "Infinix", "12,999", None), ("  ", None, None, None), (None, "Lone", None, None)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "seq int, name string, brand string, price string, competitor_product_ids string")
    records = imports.catalogue_records(df, F.lit("now"), "Owner", keep=("seq",))
    got = {r.seq: r for r in records.collect()}
    assert records.columns[1:37] == imports.FIELDS
    assert (got[0].product_id, got[0].brand, got[0].company_name, got[0].is_own_product, got[0].source_name) == ("infinix_note_60_pro", "Infinix", "Owner", True, "manual_catalog")
    assert (got[1].company_name, got[1].is_own_product, got[3].skip, got[4].skip) == (None, False, "empty row", "missing product_name")
    stored = records.where("seq = 1").select(*imports.FIELDS).withColumn("ram", F.lit("8GB"))
    after, counts = imports.import_catalogue(records, stored)
    c = counts.first()
    assert (c.imported_count, c.updated_count, c.skipped_count, c.products, c.imported_mappings) == (1, 2, 2, 2, 2)
    by = {r.product_id: r for r in after.collect()}
    assert by["infinix_note_60_pro"].current_price == "12,999" and by[got[1].product_id].ram is None


def test_import_and_clean_reports(spark):
    decided = spark.createDataFrame([("insert", "b"), ("attach", "a"), ("touch", "a"), ("insert", "a")], "status string, product_id string")
    bad = spark.createDataFrame([(k, "bad") for k in range(60, 0, -1)], "row_number int, reason string")
    counts, errors = imports.import_report(decided, bad)
    assert counts.first().asDict() == {"imported_count": 2, "skipped_duplicate_count": 2, "attached_source_count": 2, "possible_duplicate_count": 1, "product_ids": "a,b", "failed_count": 60}
    assert [r.row_number for r in errors.collect()] == list(range(1, 51))


def test_jobs(spark, catalogue, tmp_path, capsys):
    (tmp_path / "in.csv").write_text("product_id,product_name,source_url,raw_text,review_title,marketplace\np,P,http://x,Good camera and battery backup,t,m\np,P,http://x,good camera and battery  backup,t,m\np,P,http://x,Helpful for 12,Very good battery,m\np,P,http://x,Helpful for 3,x,m\n")
    (tmp_path / "in2.csv").write_text("product,comment\nitel Zeno 200,Good camera\nitel zeno200,good camera!\nNope 1,x\n,y\n")
    catalogue.withColumnRenamed("product_id", "id").drop("id").coalesce(1).write.csv(str(tmp_path / "cat"), header=True)
    assert cli.main(["clean", str(tmp_path / "in.csv"), str(tmp_path / "out")]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"input_count": 4, "clean_count": 2, "removed_count": 1, "duplicate_count": 1}
    report = json.loads(next((tmp_path / "out" / "report").glob("part-*.json")).read_text())
    assert [e["reason"] for e in report["examples"]] == ["helpful_count_only"]
    got = cli.normalise(spark, str(tmp_path / "in2.csv"), str(tmp_path / "cat"), str(tmp_path / "n"))
    assert got["duplicate_count"] == 1 and got["unresolved_count"] == 2
    got = cli.catalogue(spark, str(tmp_path / "cat"), str(tmp_path / "none"), str(tmp_path / "snap"))
    assert (got["imported_count"], got["updated_count"]) == (3, 1)
    assert cli.catalogue(spark, str(tmp_path / "cat"), str(tmp_path / "snap"), str(tmp_path / "snap2"))["updated_count"] == 4
    assert cli.main(["nothing"]) == 2
    imports.append_csv(catalogue.limit(1), str(tmp_path / "log"))
    imports.append_csv(catalogue.limit(1), str(tmp_path / "log"))
    assert spark.read.csv(str(tmp_path / "log"), header=True).count() == 2
    assert "bad" in readers.export({"good": catalogue, "bad": catalogue.withColumn("x", F.array(F.lit(1)))}, str(tmp_path / "e")) and (tmp_path / "e" / "good").exists()
    readers.write_catalogue_json(catalogue, str(tmp_path / "j"))
    assert readers.read_catalogue_json(spark, str(tmp_path / "j"), "product_id string, brand string", lines=True).count() == 4
    (tmp_path / "c.json").write_text('[{"product_id": "a"}, {"_comment": "x"}]')
    assert [r.product_id for r in readers.read_catalogue_json(spark, str(tmp_path / "c.json"), "product_id string, brand string").collect()] == ["a"]


def test_golden(spark):
    queue = spark.createDataFrame([(1, "R 1", "p", "camera", "positive", "open"), (2, "R 2", "p", None, None, "open"), (3, "gone", "p", "x", "y", "open"), (4, "R 1", "p", "battery", None, "open")], "id long, review_id string, product_id string, aspect string, predicted_sentiment string, status string")
    reviews = spark.createDataFrame([("R 1", "p", "text"), ("R 2", "p", "other")], "review_id string, product_id string, raw_text string")
    labels = "array<struct<aspect:string,sentiment:string>>"
    decisions = spark.createDataFrame([(1, None, None, None, "n"), (2, None, None, None, None), (3, None, None, None, None), (4, [("Battery ", "NEGATIVE"), ("battery", "negative"), ("", "x"), ("Camera", "positive")], None, None, "m")], f"id long, expected {labels}, expected_aspect string, expected_sentiment string, note string")
    made = golden.promote(queue, reviews, decisions)
    got = {r.id: r for r in made.collect()}
    assert set(got) == {1, 2, 4} and got[1].case_id == "live_r_1_camera_positive" and got[4].case_id == "live_r_1_battery_negative_camera_positive" and got[2].case_id is None and got[2].error
    first = golden.store(made)
    again = golden.store(made.withColumn("note", F.lit("new")).withColumn("id", F.col("id") + 10), first)
    assert {(r.case_id, r.source_item, r.note) for r in again.collect()} == {("live_r_1_camera_positive", 1, "new"), ("live_r_1_battery_negative_camera_positive", 4, "new")}
    after = golden.set_status(queue, spark.createDataFrame([(1, 1, "skipped"), (2, 1, "promoted"), (3, 99, "x")], "seq int, id long, status string"))
    assert {r.id: r.status for r in after.collect()} == {1: "promoted", 2: "open", 3: "open", 4: "open"}
    cases = spark.createDataFrame([("a", [("x", "p")], [("x", "p"), ("y", "n")]), ("b", [("x", "p")], [("x", "n")]), ("c", [], [])], f"case_id string, expected {labels}, predicted {labels}")
    p = golden.proxies(cases).first()
    assert (p.total_cases, p.exact_aspect_hits, p.sentiment_hits, p.sentiment_accuracy_proxy) == (3, 3, 2, 0.667) and [r.case_id for r in golden.failed(cases).collect()] == ["b"]
    assert golden.proxies(cases.limit(0)).first().aspect_precision_proxy == 0.0


def test_lists(spark):
    d = datetime.date
    rows = spark.createDataFrame([(k, "open" if k % 2 else "done", "p" if k < 5 else "q", float(k % 3), d(2026, 1, 1 + k), None if k == 3 else k) for k in range(8)], "id int, status string, product_id string, priority_score double, created_at date, x int")
    assert [r.id for r in listing.queue(rows, product_id=None).collect()] == [5, 7, 1, 3]
    assert listing.matching(rows, product_id="q", x=None).count() == 3 and listing.search(rows, "DO%e", "status").count() == 4
    p = listing.period(rows, "2026-01-06", "2026-01-03", "created_at").agg(F.count("*"), F.min("period_start"), F.max("period_label")).first()
    assert tuple(p) == (4, d(2026, 1, 3), "2026-01-06 to 2026-01-03") and listing.period(rows, date="created_at").first().period_label == "all_available_dated_reviews"
    assert listing.lookup(rows.withColumn("on", F.col("id") > 3), "id", 2, "on").count() == 0


def test_pages(spark):
    card = '<div class="col EPCmJX"><div class="X_4Vge">45</div><p class="title z9">Nice &amp; good</p><div class="body"><div>Great <b>phone</b></div></div><span>Certified Buyer</span><p class="when">2 months ago</p></div>'
    html = f"<html><body>{card}<div class='EPCmJX'><div class='body'></div></div><div class='EPCmJX'><div class='body'>Second one</div><p class='when'>15th Mar, 2025</p></body>"
    df = spark.createDataFrame([(1, html), (2, None), (3, "<p>no cards")], "page_id long, html string")
    found = pages.cards(df, [("section", "none"), ("div", "EPCmJX")], {"body": [("div", "^body$")], "rating": [("div", "_3LWZlK"), ("div", "X_4Vge")], "title": [("p", "title")], "date": [("p", "when")]})
    got = pages.shop_reviews(found, F.lit("2026-05-10").cast("date")).orderBy("place").collect()
    d = datetime.date
    assert [(r.rating, r.title, r.raw_text, r.review_date, r.verified_purchase) for r in got] == [(4.5, "Nice & good", "Great phone", d(2026, 3, 11), True), (None, "", "Second one", d(2025, 3, 15), False)]
    assert got[0].review_id.startswith("fk_") and len(got[0].review_id) == 19
    shop = '<ul><li class="product-item"><h3>Infinix Hot 50</h3><span class="price">₹9,999</span><a href="/spec/1">s</a></li><li class="product-item"><h3>abc</h3></li></ul><table class="spec-table"><tr><td>Display Size</td><td>6.7 inches</td></tr><tr><td>Selfie</td><td>32 MP</td></tr><tr><td>OS</td><td>Android 15, XOS</td></tr><tr><td>CPU</td><td>Dimensity 7020 (6 nm)</td></tr><tr><td>Battery</td><td>5,000 mAh</td></tr></table>'
    one = spark.createDataFrame([(1, shop)], "page_id long, html string")
    phone = pages.listings(pages.cards(one, [("li", "product-item")], {"name": [("h3", None)], "price": [("span", "price")], "date": [("i", None)]}), "https://x.com/", "x").collect()
    assert [(r.model_name, r.brand, r.current_price_int, r.specs_url) for r in phone] == [("Infinix Hot 50", "Infinix", 9999, "https://x.com/spec/1")]
    s = pages.spec_fields(pages.spec_rows(one)).first()
    assert (s.display_size, s.front_camera, s.android_version, s.chipset, s.battery_capacity, s.ram) == ("6.7 inch", "32MP", "Android 15", "Dimensity 7020", "5,000 mAh", None)


def test_specs_and_report(spark):
    rows = [("a", "A", "8 GB", " n/a ", "official site"), ("b", "B", "8 gb", "x", "Official")]
    cat = spark.createDataFrame(rows, "product_id string, product_name string, ram string, storage string, source_confidence string")
    for _, _, f in dashboard.SPEC_ROWS:
        cat = cat if f in cat.columns else cat.withColumn(f, F.lit(None).cast("string"))
    got = {r.field: r for r in dashboard.specs(cat, "a", "b").collect()}
    assert len(got) == 18 and (got["RAM"].winner, got["RAM"].confidence) == ("tie", "verified") and (got["Storage"].selected_product_value, got["Storage"].confidence) == ("Unknown", "unknown")
    assert dashboard.specs(cat, "a", "zzz").count() == 16 and dashboard.specs(cat, "a", None) is None
    products = spark.createDataFrame([("a", 3), ("b", 0), ("c", 50)], "product_id string, review_count long")
    themes = spark.createDataFrame([("a", "delight", "battery_life", 1), ("a", "complaint", "camera", 1), ("c", "delight", "x", 4)], "product_id string, family string, aspect string, place int")
    gaps = spark.createDataFrame([("strength", 1, "our product leads"), ("weakness", 1, "It  lags!")], "kind string, place int, interpretation string")
    bench = spark.createDataFrame([("x", 3.0, "ahead on x"), ("y", -9.0, "behind on y.")], "aspect string, gap double, interpretation string")
    told = spark.createDataFrame([(["News — matters", "news — matters"], ["act"])], "signals array<string>, actions array<string>")
    r = {x.product_id: x for x in dashboard.executive_report(products, themes, gaps, bench, told, own="a").collect()}
    assert r["a"].key_strengths == ["Battery Life is the strongest positive customer signal.", "the selected product leads."] and r["a"].key_risks[1] == "It lags!" and r["a"].competitor_takeaways == ["behind on y.", "ahead on x."]
    assert r["a"].market_news_signals == ["News — matters."] and r["a"].recommended_actions[-1] == "act." and r["b"].executive_summary[0].startswith("No usable review evidence") and len(r["a"].executive_summary) == 5
    assert "product-only" in r["c"].executive_summary[3] and r["b"].confidence_note.startswith("No confidence yet")
    s = dashboard.sections(dashboard.executive_report(products, themes))
    assert s.where("product_id = 'c' and section = 'Competitor Benchmark'").first().bullet.startswith("No competitor was selected")


def test_news_texts(spark):
    items = news.classify(spark.createDataFrame([("a", "Qualcomm brings on-device AI to Snapdragon smartphone chipset in India", "generative AI", 1), ("b", "Bakery opens", "bread", 2)], "source_id string, title string, summary string, source_tier int").withColumn("default_tags", F.array().cast("array<string>")))
    t = news.brief_texts(items).first()
    assert (t.items, t.high) == (2, 1) and any("Tier-1" in x for x in t.summary) and t.actions[1].startswith("Assess whether detected")
    assert news.brief_texts(items.limit(0)).first().summary == ["No trusted news items met the relevance threshold for this brief."]
    stale = items.withColumn("relevance_score", F.lit(0.0)).withColumn("topic_tags", F.array().cast("array<string>"))
    done = {r.source_id: r for r in news.rescore(stale, spark.createDataFrame([("a", ["market"])], "source_id string, default_tags array<string>")).collect()}
    assert done["a"].relevance_score == 100.0 and "market" in done["a"].topic_tags and done["b"].relevance_score == 0.0 and not done["b"].updated


def test_small_expressions(spark):
    as_of = F.lit("2026-05-10").cast("date")
    names = identity.with_identity(identity.with_identity(spark.createDataFrame([("Tecno Pova 7", "tecno", "TecnoPova7", None), ("Pova 7", None, "Tecno Pova 7", None), ("Acme 1", None, "Zed 2", None)], "a string, b string, c string, d string"), "a", "b", out="l"), "c", "d", out="r")
    assert [round(r[0], 2) for r in names.select(identity.compared(F.col("l"), F.col("r"))).collect()[:2]] == [1.0, 0.82]
    row = spark.range(1).select(
        parse.relative_date(F.lit("99999999 years ago"), as_of).alias("a"), parse.review_url(F.lit("http://[bad url?pid=1")).alias("b"), parse.review_url(F.lit("https://x.com/p?x=1&pid=A&lid=B")).alias("c"), parse.brand_prefix(F.lit("iqoo Z11")).alias("d"),
        text.json_list(F.lit("{bad")).alias("e"), text.joined_short(F.array(F.lit("a"), F.lit(""), F.lit("b"))).alias("f"), text.bounded(F.lit("x"), 0.3).alias("g"), text.without_scores(F.lit("ahead by 3.5 points")).alias("h"), text.distinct_texts(F.array(F.lit("A"), F.lit("a"))).alias("i"),
        text.json_object(F.lit('noise {"a": 1} more'), "a int").alias("j"), text.local_stamp(F.lit("2026-01-01 00:00:00").cast("timestamp")).alias("k"), quality.repaired_text(F.lit("good phone"), F.lit("Excellent battery life")).alias("l"), identity.own_brand(F.lit("TECNO")).alias("m"),
        scores.gap_text(F.lit("x"), F.lit(6.0), F.lit("low"), F.lit(1), F.lit(1)).alias("n"), quality.repaired_text(F.lit("good phone that is mine"), F.lit("Excellent battery life")).alias("o"),
    ).first()
    assert (row.a, row.c, row.d, row.e, row.f, row.g, row.h, row.i) == (None, "https://x.com/p?pid=A&lid=B", "iQOO", [], "a and b", 0.3, "ahead by", ["A"])
    assert row.j.a == 1 and row.k == "2026-01-01 05:30 IST" and row.l == "Excellent battery life" and row.m and row.n.startswith("The selected product is ahead on x by 6.0 points. Treat") and row.o == "good phone that is mine"
    assert identity.names_in(" A, b ,") == {"a", "b"} and identity.names_in(None) == set()


def test_balanced_and_upsert(spark):
    rng = random.Random(2)
    rows = [("p" if k < 60 else "q", rng.choice("12345x"), k) for k in range(100)]
    quotas, most = {"5": 4, "4": 3, "1": 2}, 12
    got = sorted(r.k for r in mutate.balanced(spark.createDataFrame(rows, "product_id string, rating string, k int"), quotas, most, [F.col("k")]).collect())
    want = []
    for p in "pq":
        inside = [k for r in "12345x" for k in [k for q, s, k in rows if (q, s) == (p, r)][: quotas.get(r, 0)]]
        rest = [k for q, _, k in rows if q == p and k not in inside]
        want += inside + rest[: max(0, most - len(inside))]
    assert got == sorted(want)
    old, new = (spark.createDataFrame(x, "k int, a string, b string") for x in ([(1, "a", "b"), (2, "c", None)], [(2, None, "n"), (3, "x", None)]))
    assert sorted(map(tuple, mutate.upsert(old, new, ["k"]).collect())) == [(1, "a", "b"), (2, "c", "n"), (3, "x", None)]
    assert sorted(map(tuple, mutate.upsert(old, new, ["k"], keep_stored=False).collect())) == [(1, "a", "b"), (2, None, "n"), (3, "x", None)]
    assert imports.reset({"living_lexicon": old, "x": old})["x"].count() == 0
    moved = imports.migrate(old, {"id": "bigint", "key": "string", "new": "int"}, {"k": "id"}, {"key": F.coalesce("b", F.lit(""))})
    assert sorted(map(tuple, moved.collect())) == [(1, "b", None), (2, "", None)]


def test_ingest_against_a_snapshot(spark):
    """A stored review of the same product, text and rating is canonical; known sources are only touched."""
    schema = "seq long, review_id string, product_id string, rating double, source_review_key string, normalized_text_hash string"
    stored = spark.createDataFrame([(1, "s1", "p", 4.0, "k1", "t1"), (2, "s2", "p", 4.0, "k2", "t1")], schema)
    rows = [(1, "a", "p", 4.0, "k9", "t1"), (2, "b", "p", 4.0, "k1", "t7"), (3, "c", "p", 4.0, "k8", "t7"), (4, "d", "p", 4.0, "k7", "t7"), (5, "e", "p", None, "k6", "t7")]
    got = {r.review_id: (r.status, r.canonical_id) for r in mutate.ingest(spark.createDataFrame(rows, schema), stored).collect()}
    assert got["a"] == ("attach", "s1") and got["b"][0] == "touch" and got["c"] == ("insert", "c") and got["d"] == ("attach", "c") and got["e"] == ("insert", "e")


def test_evidence_of_aspects(spark):
    """Evidence spans and intensity of a known sentence."""
    r = quality.analyse(spark.createDataFrame([("a", "p", "x" * 100 + " camera mast hai " + "y" * 100, 5.0)], "review_id string, product_id string, raw_text string, rating double")).first()
    (a,) = r.aspects
    assert (a.aspect, a.sentiment, a.intensity) == ("camera", "positive", 0.86) and "camera mast hai" in a.evidence and len(a.evidence) < 160


def test_daily_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("product_id,rating,ts\np,4,2026-05-01T01:00:00\np,2,2026-05-01T23:00:00\np,5,2026-05-09T00:00:00\np,1,2026-05-02T00:00:00\n")
    rows = incremental.stream_csv(spark, str(tmp_path / "in"), "product_id string, rating double, ts timestamp")
    q = incremental.daily(rows, "ts").writeStream.format("memory").outputMode("complete").queryName("days").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.day.start.day, r.reviews, r.avg_rating) for r in spark.table("days").collect()}
    assert got == {(1, 2, 3.0), (2, 1, 1.0), (9, 1, 5.0)}


def test_forecast_texts_and_feed(spark):
    f = spark.createDataFrame([("p", "camera", "likely_stable", 1.0, 4, 5, "low"), ("p", "ui", "uncertain", None, 4, 0, "low")], "product_id string, aspect string, direction string, movement double, current_mentions long, previous_mentions long, confidence_label string")
    c = F.col
    t = [r[0] for r in f.select(scores.movement_text(c("aspect"), c("direction"), c("movement"), c("current_mentions"), c("previous_mentions"), c("confidence_label"))).collect()]
    assert t[0].startswith("camera moved by 1.0 points versus the previous period (5 previous mention(s), 4 current") and "no previous-period baseline" in t[1]
    q = spark.createDataFrame([("camera is fine", "Title", "4"), (None, None, None)], "t string, h string, r string").select(summary.feed_quality(c("t"), c("h"), c("r")).alias("q")).collect()
    assert tuple(q[0].q) == (1, 3, 1, "4") and tuple(q[1].q) == (0, 0, 0, "")
    n = summary.rating_counts(spark.createDataFrame([("p", "5.0"), ("p", "7"), ("p", None), ("p", "1")], "product_id string, rating string")).first()
    assert (n.r5, n.r1, n.unknown, n.total) == (1, 1, 2, 4)
    assert compare.label_report(compare.label_match(spark.createDataFrame([], "c string, a string, label string"), spark.createDataFrame([], "c string, a string, label string"), "c", "a"), "c").first().recall == 1.0
