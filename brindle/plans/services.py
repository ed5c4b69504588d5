"""More of the query catalogue: lists, imports, golden cases, dashboard and reports. Registered beside the queries of `catalogue`."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import parse as pr
from brindle.functions import scores as sc
from brindle.functions import text as tf
from brindle.operators import compare, dashboard, golden, imports, listing, mutate, news, quality, report, summary
from brindle.plans import adapter as ad
from brindle.plans.catalogue import _NEWS, ASP, BENCH, CARD, FORECAST, KEYED, ORACLES, PD, PICKS, RV, SCORED, THEMES, M, N, R, _count_terms, _keyed, _news, query, scored
from brindle.sources import pages, readers

LANGUAGE = "CASE WHEN len(regexp_extract_all(lower(raw_text), '\\b(mast|bakwas|ekdum|nahi|nahin|hai|bahut|bhai)\\b')) >= 3 THEN 'hinglish' WHEN len(regexp_extract_all(lower(raw_text), '\\b(mast|bakwas|ekdum|nahi|nahin|hai|bahut|bhai)\\b')) >= 1 THEN 'mixed' ELSE 'english' END"
LABEL = lambda c: f"array_to_string(list_transform(string_split(lower(replace({c}, '_', ' ')), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


def _dates(df, *columns):
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


# --- lists -------------------------------------------------------------------------------------


@query(
    """SELECT id, review_id, is_correct, CAST(created_at AS VARCHAR) AS created_at FROM (SELECT event_id AS id, CAST(user_id % 50 AS VARCHAR) AS review_id, event_type AS provider, value > 10 AS is_correct, date_trunc('second', ts) AS created_at FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id % 50, event_type ORDER BY event_id DESC) = 1) WHERE provider = 'click' ORDER BY created_at DESC, id DESC LIMIT 40"""
)
def fil3_srt13_joi10_feedback_list(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events")
    f = e.select(F.col("event_id").alias("id"), (F.col("user_id") % 50).cast("string").alias("review_id"), F.lit("p").alias("product_id"), F.lit("a").alias("aspect"), F.lit("s").alias("predicted_sentiment"), F.col("event_type").alias("provider"), (F.col("value") > 10).alias("is_correct"), F.date_trunc("second", "ts").alias("created_at"))
    return _dates(listing.feedback(f, 40, provider="click", product_id=None), "created_at").select("id", "review_id", "is_correct", "created_at")


@query("SELECT p_partkey AS id, term, aspect FROM (SELECT *, p_name AS term, p_type AS aspect FROM part) WHERE (term ILIKE '%w_dget%' OR p_brand ILIKE '%w_dget%' OR p_type ILIKE '%w_dget%') AND p_type IN ('ECONOMY', 'STANDARD') ORDER BY p_size > 25 DESC, p_retailprice DESC, aspect, term LIMIT 200")
def fil4_fil16_srt6_lexicon_list(spark, sf_dir):
    p = ad.table(spark, sf_dir, "part")
    x = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("term"), F.col("p_brand").alias("normalized_term"), F.col("p_type").alias("aspect"), F.col("p_type").alias("term_type"), F.array("p_type").alias("examples"), (F.col("p_size") > 25).alias("approved"), F.col("p_retailprice").alias("confidence"))
    return listing.lexicon(listing.of_types(x, "ECONOMY", "STANDARD"), "W_dget").select("id", "term", "aspect")


@query("SELECT c_custkey AS competitor_id, c_name AS product_name, c_mktsegment AS comparison_group, row_number() OVER (ORDER BY c_mktsegment, c_name, c_custkey) AS place FROM customer ORDER BY place LIMIT 100")
def srt7_competitor_list(spark, sf_dir):
    c = ad.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("competitor_id"), F.col("c_name").alias("product_name"), F.col("c_mktsegment").alias("comparison_group"))
    return _placed(listing.competitors(c).limit(100), "comparison_group", "product_name", "competitor_id")


def _placed(few, *order):
    """The place of each row of a page, so that its order can be compared; a page is one task's rows."""
    from pyspark.sql import Window as W

    return few.withColumn("place", F.row_number().over(W.orderBy(*order)).cast("long"))


QUEUE = f"""queue AS (SELECT review_id, product_id, aspect, reason, {R("p", 3)} AS priority_score, CAST(review_date AS VARCHAR) AS created_at FROM (
    SELECT *, 'low_confidence_extraction' AS reason, 80 + (1 - CAST(confidence AS DOUBLE)) * 20 AS p FROM scored WHERE confidence < 0.72
    UNION ALL SELECT *, 'low_quality_review_signal', 70 + (1 - quality_score) * 20 FROM scored WHERE quality_score < 0.75
    UNION ALL SELECT *, 'high_intensity_complaint', 75 + CAST(intensity AS DOUBLE) * 10 FROM scored WHERE sentiment = 'negative' AND intensity >= 0.8
    UNION ALL SELECT *, 'rating_text_contradiction_candidate', 85.0 FROM scored WHERE contradiction_flag))"""


def _queue(spark, sf_dir):
    r = scored(spark, sf_dir)
    q = quality.queue_candidates(r).join(r.select("review_id", F.col("review_date").cast("string").alias("created_at")).dropDuplicates(["review_id"]), "review_id")
    return q.withColumn("status", F.lit("open")).withColumn("id", F.concat_ws("|", "review_id", "aspect", "reason"))


@query("SELECT review_id || '|' || aspect || '|' || reason AS id, priority_score, created_at FROM queue WHERE product_id = 'Brand#7' ORDER BY priority_score DESC, created_at DESC, id LIMIT 100", RV, SCORED, QUEUE)
def fil3_srt9_queue_list(spark, sf_dir):
    return listing.queue(_queue(spark, sf_dir), product_id="Brand#7").select("id", "priority_score", "created_at")


@query("SELECT reason, count(*) AS n FROM queue GROUP BY reason", RV, SCORED, QUEUE)
def agg24_queue_counts(spark, sf_dir):
    return imports.counts_by(_queue(spark, sf_dir).select("reason"), "reason")


RELEVANCE = f"""scored_news AS (SELECT page_id, CAST(least(100, total) AS DOUBLE) AS relevance_score FROM (SELECT page_id, 7 * ph + 10 * ai + 5 * mk + 8 * oe + 12 * te + 7 * re + CASE WHEN hai AND ph > 0 THEN 18 ELSE 0 END + CASE WHEN chip AND (hai OR ph > 0) THEN 15 ELSE 0 END + CASE WHEN oe > 0 THEN 10 ELSE 0 END + CASE WHEN re > 0 THEN 8 ELSE 0 END AS total
    FROM (SELECT *, ai > 0 OR te_ai AS hai FROM (SELECT page_id, {_count_terms(news.SMARTPHONE)} AS ph, {_count_terms(news.AI)} AS ai, {_count_terms(news.MARKET)} AS mk, {_count_terms(news.MAKERS)} AS oe, {_count_terms(news.TECH)} AS te, {_count_terms(news.REGIONS)} AS re,
      {" OR ".join(f"contains(t, '{x}')" for x in news.CHIPS)} AS chip, {" OR ".join(f"contains(t, '{x}')" for x in news.TECH if "ai" in x)} AS te_ai FROM n))))"""


@query("SELECT page_id, relevance_score FROM scored_news WHERE relevance_score >= 10 ORDER BY relevance_score DESC, page_id // 10 DESC, page_id DESC LIMIT 50", _NEWS, RELEVANCE)
def fil3_srt8_news_list(spark, sf_dir):
    n = _news(spark, sf_dir).withColumn("published_at", F.floor(F.col("page_id") / 10)).withColumn("ingested_at", F.col("page_id"))
    return listing.news(n, least=10).select("page_id", "relevance_score")


@query("SELECT doc_id, src, CASE WHEN src = 'a' THEN 1 ELSE 2 END AS k, relevance_score, updated FROM (SELECT page_id AS doc_id, CASE WHEN page_id % 3 = 0 THEN 'a' WHEN page_id % 3 = 1 THEN 'b' ELSE 'gone' END AS src, page_id % 3 <> 2 AS updated, CASE WHEN page_id % 3 <> 2 THEN relevance_score ELSE 0 END AS relevance_score FROM scored_news)", _NEWS, RELEVANCE)
def dom15_news_rescore(spark, sf_dir):
    src = F.when(F.col("page_id") % 3 == 0, "a").when(F.col("page_id") % 3 == 1, "b").otherwise("gone")
    old = _news(spark, sf_dir).drop("default_tags").withColumn("source_id", src).withColumn("relevance_score", F.lit(0.0))
    sources = spark.createDataFrame([("a", []), ("b", None), ("b", None)], "source_id string, default_tags array<string>")
    n = news.rescore(old, sources)
    return n.select(F.col("page_id").alias("doc_id"), F.col("source_id").alias("src"), F.when(F.col("source_id") == "a", 1).otherwise(2).alias("k"), "relevance_score", "updated")


@query("SELECT product_id, product_name, own_brand FROM products WHERE own_brand", PD)
def fil8_own_products(spark, sf_dir):
    p = ad.products(spark, sf_dir).withColumn("is_own_product", F.when(F.col("own_brand"), True)).withColumn("brand", F.col("product_id"))
    return listing.catalogue(p, own=True).select("product_id", "product_name", "own_brand")


@query("SELECT product_id, product_name FROM products WHERE product_id NOT IN ('Brand#5', 'Brand#6') AND NOT contains(lower(product_name), 'blue') AND product_id IN ('Brand#1', 'Brand#5', 'Brand#7', 'Brand#8', 'Brand#9')", PD)
def fil9_srt10_visible_products(spark, sf_dir):
    p = ad.products(spark, sf_dir).withColumn("brand", F.col("product_id"))
    return listing.visible(p, ["Brand#5", "Brand#6"], ["blue"], ["Brand#1", "Brand#5", "Brand#7", "Brand#8", "Brand#9"]).select("product_id", "product_name")


@query("SELECT product_id, count(*) AS n, min(b.lo)::VARCHAR AS period_start, min(b.hi)::VARCHAR AS period_end, 'beginning to 1997-06-30' AS period_label FROM reviews, (SELECT least(min(review_date), DATE '1997-06-30') AS lo, greatest(min(review_date), DATE '1997-06-30') AS hi FROM reviews) b WHERE review_date BETWEEN b.lo AND b.hi GROUP BY product_id", RV)
def fil14_default_period(spark, sf_dir):
    p = listing.period(ad.reviews(spark, sf_dir), None, "1997-06-30")
    return _dates(p.groupBy("product_id", "period_start", "period_end", "period_label").agg(F.count("*").alias("n")), "period_start", "period_end")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 7 AND n_regionkey > 0")
def fil15_lookup(spark, sf_dir):
    return listing.lookup(ad.table(spark, sf_dir, "nation").withColumn("is_active", F.col("n_regionkey") > 0), "n_nationkey", 7, "is_active").select("n_nationkey", "n_name")


EVIDENCE = f"""ev AS (SELECT a.review_id, a.product_id, a.name AS product_name, a.source, a.rating, CAST(a.review_date AS VARCHAR) AS review_date, a.raw_text, trim(a.raw_text) AS clean_text, a.quality_score, a.aspect, a.sentiment, CAST(a.intensity AS DOUBLE) AS intensity, CAST(a.confidence AS DOUBLE) AS confidence,
    a.raw_text AS evidence_span, 'rules' AS provider, {LANGUAGE} AS language_type FROM scored a)"""


def _evidence_tables(spark, sf_dir):
    """Reviews, what the analysis made of them, and their aspects as three tables by review_id."""
    r = scored(spark, sf_dir)
    raw = r.select("review_id", "product_id", F.col("name").alias("product_name"), "source", "rating", "review_date", "raw_text")
    aspects = r.select("review_id", "product_id", "aspect", "sentiment", F.col("intensity").cast("double").alias("intensity"), F.col("confidence").cast("double").alias("confidence"), F.col("raw_text").alias("evidence_span"), F.lit("rules").alias("provider"))
    return aspects, raw, r.select("review_id", F.trim("raw_text").alias("clean_text"), "quality_score")


@query("SELECT * FROM ev WHERE product_id = 'Brand#7'", RV, SCORED, EVIDENCE)
def prj1_joi3_fil3_evidence(spark, sf_dir):
    return _dates(listing.evidence(*_evidence_tables(spark, sf_dir), limit=None, product_id="Brand#7", sentiment=None), "review_date")


@query("SELECT review_id, aspect, quality_score, language_type FROM ev WHERE sentiment = 'negative' AND language_type <> 'english' ORDER BY quality_score DESC, confidence DESC, review_date DESC, review_id, aspect LIMIT 50", RV, SCORED, EVIDENCE)
def fil11_srt1_evidence_page(spark, sf_dir):
    return listing.evidence(*_evidence_tables(spark, sf_dir), hinglish=True, sentiment="negative").select("review_id", "aspect", "quality_score", "language_type")


@query("SELECT product_id, source, count(*) AS n, count(DISTINCT aspect) AS aspects FROM reviews GROUP BY product_id, source", RV)
def joi1_joi2_reviews_and_aspects(spark, sf_dir):
    aspects, raw, processed = _evidence_tables(spark, sf_dir)
    j = aspects.select("review_id", "aspect").join(raw.select("review_id", "product_id", "source"), "review_id").join(processed.select("review_id"), "review_id")
    return j.groupBy("product_id", "source").agg(F.count("*").alias("n"), F.countDistinct("aspect").alias("aspects"))


@query("SELECT CAST(review_date AS VARCHAR) AS review_date, r.review_id, p.product_name, r.source, CASE WHEN verified_purchase THEN 'Yes' ELSE 'No' END AS verified_purchase, CASE WHEN own_brand THEN CAST(rating AS VARCHAR) ELSE '' END AS own_rating FROM reviews r LEFT JOIN (SELECT * FROM products WHERE price > 22600) p ON r.product_id = p.product_id WHERE review_date >= DATE '2001-01-01'", RV, PD)
def joi6_sca53_export_rows(spark, sf_dir):
    p = ad.products(spark, sf_dir).where("price > 22600").select("product_id", "product_name", "own_brand")
    r = summary.in_period(ad.reviews(spark, sf_dir), "2001-01-01").join(p, "product_id", "left")
    return r.select(F.col("review_date").cast("string").alias("review_date"), "review_id", "product_name", "source", tf.yes_no(F.col("verified_purchase")).alias("verified_purchase"), tf.shown(F.when(F.col("own_brand"), F.col("rating"))).alias("own_rating"))


@query("SELECT product_id, aspect, direction, confidence_label, row_number() OVER (PARTITION BY product_id ORDER BY confidence_label = 'high' DESC, confidence_label = 'medium' DESC, current_mentions DESC, abs(current_score) DESC, aspect) AS place FROM fd", RV, FORECAST)
def srt4_forecast_order(spark, sf_dir):
    from pyspark.sql import Window as W

    f = compare.forecast(ad.reviews(spark, sf_dir), "1998-01-01", "1998-01-31")
    return f.select("product_id", "aspect", "direction", "confidence_label", F.row_number().over(W.partitionBy("product_id").orderBy(*listing.forecast_order())).cast("long").alias("place"))


@query(
    """SELECT product_id, aspect, CASE WHEN movement IS NULL THEN aspect || ' has ' || current_mentions || ' current-period mention(s) but no previous-period baseline. ' ELSE aspect || ' moved by ' || CAST(movement AS VARCHAR) || ' points versus the previous period (' || previous_mentions || ' previous mention(s), ' || current_mentions || ' current mention(s)). ' END
    || 'Direction is ' || direction || '; confidence is ' || confidence_label || '.' AS explanation FROM fd""", RV, FORECAST,
)
def sca50_forecast_texts(spark, sf_dir):
    f = compare.forecast(ad.reviews(spark, sf_dir), "1998-01-01", "1998-01-31")
    c = F.col
    return f.select("product_id", "aspect", sc.movement_text(c("aspect"), c("direction"), c("movement"), c("current_mentions"), c("previous_mentions"), c("confidence_label")).alias("explanation"))


@query(
    """SELECT product_id, kind, aspect, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY product_id, kind ORDER BY abs(aspect_score) DESC, mentions DESC, aspect) AS place FROM (SELECT *, CASE WHEN aspect_score > 0 THEN 'strength' ELSE 'risk' END AS kind FROM asp WHERE aspect_score <> 0)) WHERE place <= 3""", RV, ASP,
)
def srt5_best_and_worst(spark, sf_dir):
    return listing.best_and_worst(summary.aspect_summary(ad.reviews(spark, sf_dir))).select("product_id", "kind", "aspect", "place")


# --- imports -----------------------------------------------------------------------------------


@query("SELECT reason, n FROM (SELECT status AS reason, count(*) AS n FROM (SELECT CASE WHEN nth > 1 THEN 'touch' WHEN lead_id <> review_id THEN 'attach' ELSE 'insert' END AS status FROM (SELECT review_id, nth, first_value(review_id) OVER (PARTITION BY product_id, text_hash, rating ORDER BY nth > 1, seq, review_id) AS lead_id FROM (SELECT *, row_number() OVER (PARTITION BY source, product_id, source_key ORDER BY seq, review_id) AS nth FROM keyed))) GROUP BY status)", RV, KEYED)
def agg21_ingest_counts(spark, sf_dir):
    return imports.counts_by(_decided(spark, sf_dir))


def _decided(spark, sf_dir):
    return mutate.ingest(_keyed(spark, sf_dir).withColumn("seq", F.struct("seq", "review_id")))


@query(
    """SELECT count(*) FILTER (status = 'insert') AS imported_count, count(*) FILTER (status <> 'insert') AS skipped_duplicate_count, count(*) FILTER (status <> 'insert') AS attached_source_count, count(*) FILTER (status = 'attach') AS possible_duplicate_count, string_agg(DISTINCT product_id, ',' ORDER BY product_id) AS product_ids,
    (SELECT count(*) FROM reviews WHERE rating > 4.5) AS failed_count
    FROM (SELECT product_id, CASE WHEN nth > 1 THEN 'touch' WHEN lead_id <> review_id THEN 'attach' ELSE 'insert' END AS status FROM (SELECT product_id, review_id, nth, first_value(review_id) OVER (PARTITION BY product_id, text_hash, rating ORDER BY nth > 1, seq, review_id) AS lead_id FROM (SELECT *, row_number() OVER (PARTITION BY source, product_id, source_key ORDER BY seq, review_id) AS nth FROM keyed)))""", RV, KEYED,
)
def agg20_import_report(spark, sf_dir):
    bad = ad.reviews(spark, sf_dir).where("rating > 4.5").select(F.col("review_id").alias("row_number"), F.lit("rating out of range").alias("reason"))
    return imports.import_report(_decided(spark, sf_dir), bad)[0]


CATALOGUE = """rows_ AS (SELECT p_partkey AS seq, CASE WHEN p_size > 1 THEN 'Infinix Note ' || p_size END AS product_name, CAST(p_retailprice AS VARCHAR) AS price FROM part),
 good AS (SELECT *, lower(replace(product_name, ' ', '_')) AS product_id FROM rows_ WHERE product_name IS NOT NULL),
 stored AS (SELECT DISTINCT 'infinix_note_' || p_size AS product_id FROM part WHERE p_size BETWEEN 2 AND 9)"""


def _catalogue_import(spark, sf_dir):
    p = ad.table(spark, sf_dir, "part")
    name = F.concat(F.lit("Infinix Note "), F.col("p_size").cast("string"))
    rows = p.select(F.col("p_partkey").alias("seq"), F.when(F.col("p_size") > 1, name).alias("name"), F.col("p_retailprice").cast("string").alias("price"), F.lit("x; y ;").alias("competitor_product_ids"))
    stored = p.where("p_size between 2 and 9").select(F.lower(F.replace(name, F.lit(" "), F.lit("_"))).alias("product_id")).distinct()
    stored = stored.withColumn("company_name", F.lit("old")).withColumn("launch_market", F.lit("old")).withColumn("current_price", F.lit("1"))
    return imports.import_catalogue(imports.catalogue_records(rows, F.lit("2026-01-01"), "Owner", keep=("seq",)), stored)


@query("SELECT coalesce(g.product_id, s.product_id) AS product_id, CASE WHEN g.product_id IS NULL THEN 'old' ELSE 'Owner' END AS company_name, CASE WHEN g.product_id IS NULL THEN 'old' END AS launch_market, CASE WHEN g.product_id IS NULL THEN '1' ELSE price END AS current_price FROM (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY seq DESC) = 1) g FULL JOIN stored s ON g.product_id = s.product_id", CATALOGUE)
def src3_src4_ups6_catalogue_import(spark, sf_dir):
    return _catalogue_import(spark, sf_dir)[0]


@query(
    """SELECT new AS imported_count, (SELECT count(*) FROM good) - new AS updated_count, (SELECT count(*) FROM rows_ WHERE product_name IS NULL) AS skipped_count,
    (SELECT count(DISTINCT product_id) FROM good) AS products, 2 * (SELECT count(*) FROM good) AS imported_mappings FROM (SELECT count(DISTINCT product_id) AS new FROM good WHERE product_id NOT IN (SELECT product_id FROM stored))""", CATALOGUE,
)
def src3_catalogue_counts(spark, sf_dir):
    return _catalogue_import(spark, sf_dir)[1]


@query(
    """SELECT p_partkey AS seq, product_id, 'Owner' AS company_name, 'Infinix' AS brand, product_name, product_name AS model_name, 'infinix|note_' || p_size AS canonical_product_key, 'infinix' AS normalized_brand, 'note_' || p_size AS normalized_model_key, true AS is_own_product,
    CAST(p_retailprice AS VARCHAR) AS current_price, '5000mAh' AS battery_capacity, CASE WHEN p_size % 2 = 0 THEN 'official' ELSE 'manual_pending' END AS source_confidence, 'manual_catalog' AS source_name, 36 AS fields FROM (SELECT *, 'Infinix Note ' || p_size AS product_name, 'infinix_note_' || p_size AS product_id FROM part)"""
)
def prj6_catalogue_records(spark, sf_dir):
    p = ad.table(spark, sf_dir, "part")
    rows = p.select(F.col("p_partkey").alias("seq"), F.concat(F.lit(" Infinix  Note "), F.col("p_size").cast("string")).alias("product_name"), F.lit("n/a").alias("current_price"), F.col("p_retailprice").cast("string").alias("price"), F.lit("5000mAh").alias("battery"), F.when(F.col("p_size") % 2 == 0, "official").alias("source_confidence"))
    r = imports.catalogue_records(rows, F.lit("2026-01-01"), "Owner", keep=("seq",))
    return r.select("seq", "product_id", "company_name", "brand", "product_name", "model_name", "canonical_product_key", "normalized_brand", "normalized_model_key", "is_own_product", "current_price", "battery_capacity", "source_confidence", "source_name", F.lit(len(imports.FIELDS)).alias("fields"))


MESSY = """messy AS (SELECT *, CASE WHEN p_size % 10 = 0 THEN NULL ELSE 'text ' || (seq % 97) || CASE WHEN seq % 2 = 0 THEN '!' ELSE '' END END AS body, CASE p_size % 5 WHEN 0 THEN 'infinix_note_' || p_size WHEN 1 THEN 'INFINIX note' || p_size WHEN 2 THEN 'note ' || p_size || ' (8GB, black)' WHEN 3 THEN 'Infinix Nota ' || p_size ELSE 'unheard of ' || p_brand END AS said
   FROM (SELECT p_partkey AS seq, p_size, p_brand, CAST(p_size % 5 AS VARCHAR) AS stars FROM part)),
 resolved AS (SELECT seq, body, stars, CASE WHEN body IS NULL THEN 'skipped' WHEN p_size % 5 = 4 THEN 'unresolved' END AS open_, CASE WHEN p_size % 5 < 4 THEN 'infinix_note_' || p_size END AS product_id FROM messy),
 printed AS (SELECT *, sha256(concat_ws('|', product_id, trim(regexp_replace(lower(body), '[^a-z0-9]+', ' ', 'g')), stars, '')) AS f FROM resolved),
 normal AS (SELECT seq, product_id, coalesce(open_, CASE WHEN row_number() OVER (PARTITION BY coalesce(open_, f) ORDER BY seq) > 1 THEN 'duplicate' ELSE 'kept' END) AS status, 'norm_' || f[:16] AS review_id FROM printed)"""


def _normalised(spark, sf_dir):
    p = ad.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), "p_size", "p_brand")
    size, five = F.col("p_size").cast("string"), F.col("p_size") % 5
    said = F.when(five == 1, F.concat(F.lit("INFINIX note"), size)).when(five == 2, F.concat(F.lit("note "), size, F.lit(" (8GB, black)"))).when(five == 3, F.concat(F.lit("Infinix Nota "), size)).when(five == 4, F.concat(F.lit("unheard of "), "p_brand"))
    body = F.when(F.col("p_size") % 10 != 0, F.concat(F.lit("text "), (F.col("seq") % 97).cast("string"), F.when(F.col("seq") % 2 == 0, "!").otherwise("")))
    rows = p.select("seq", F.when(five == 0, F.concat(F.lit("infinix_note_"), size)).alias("product_id"), said.alias("product"), body.alias("comment"), five.cast("string").alias("stars"))
    catalogue = p.select(F.concat(F.lit("infinix_note_"), size).alias("product_id"), F.concat(F.lit("Infinix Note "), size).alias("product_name"), F.lit("Infinix").alias("brand")).distinct()
    return imports.normalise_reviews(rows, catalogue, "seq")


@query("SELECT seq, status, CASE WHEN status IN ('kept', 'duplicate') THEN product_id END AS product_id, CASE WHEN status = 'kept' THEN review_id END AS review_id FROM normal", MESSY)
def dom21_sca10_review_normaliser(spark, sf_dir):
    n = _normalised(spark, sf_dir)
    known = F.col("status").isin("kept", "duplicate")
    return n.select("seq", "status", F.when(known, F.col("product_id")).alias("product_id"), F.when(F.col("status") == "kept", F.col("review_id")).alias("review_id"))


@query("SELECT status AS reason, count(*) AS n FROM normal GROUP BY status", MESSY)
def snk2_agg21_normaliser_counts(spark, sf_dir):
    return imports.counts_by(_normalised(spark, sf_dir))


@query("SELECT 'Brand ' || lower(p_name) AS k, replace('brand ' || lower(p_name), ' ', '_') AS product_id FROM (SELECT DISTINCT p_name FROM part) WHERE replace('brand ' || lower(p_name), ' ', '_') NOT IN (SELECT replace('brand ' || lower(p_name), ' ', '_') FROM part WHERE p_size > 48)")
def dom27_new_products(spark, sf_dir):
    p = ad.table(spark, sf_dir, "part")
    found = p.select(F.lit("Brand!").alias("brand"), F.col("p_name").alias("model_name"), F.col("p_partkey").alias("seq"))
    known = p.where("p_size > 48").select(pr.slug(F.concat(F.lit("Brand "), "p_name")).alias("product_id")).distinct()
    return imports.new_products(found, known).select(F.concat(F.lit("Brand "), F.lower("model_name")).alias("k"), "product_id")


@query("SELECT s_suppkey AS product_id, s_name AS name, CAST(s_acctbal AS VARCHAR) AS curated FROM supplier UNION ALL SELECT c_custkey, c_name, NULL FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def joi11_set6_append_new(spark, sf_dir):
    s = ad.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("product_id"), F.col("s_name").alias("name"), F.col("s_acctbal").cast("string").alias("curated"))
    return imports.append_new(s, ad.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("product_id"), F.col("c_name").alias("name")))


@query("SELECT review_id, source, product_id, name AS product_name, '' AS brand, CASE WHEN verified_purchase THEN 'TRUE' ELSE 'FALSE' END AS verified_purchase, helpful_votes, '10000-35000' AS price_band, source AS marketplace FROM reviews", RV)
def prj4_scraped_csv(spark, sf_dir):
    r = imports.scraped_csv(ad.reviews(spark, sf_dir).withColumnRenamed("name", "product_name").drop("brand"), "10000-35000")
    return r.select("review_id", "source", "product_id", "product_name", "brand", "verified_purchase", "helpful_votes", "price_band", "marketplace")


@query("SELECT table_name, n FROM (VALUES ('reviews_raw', 0), ('products', 0), ('living_lexicon', (SELECT count(*) FROM region))) t(table_name, n)")
def ups13_reset(spark, sf_dir):
    tables = {"reviews_raw": ad.table(spark, sf_dir, "lineitem"), "products": ad.table(spark, sf_dir, "part"), "living_lexicon": ad.table(spark, sf_dir, "region")}
    return summary.table_counts(imports.reset(tables))


@query("SELECT coalesce(n.n_nationkey, s.k) AS source_id, coalesce(s.name, n.n_name) AS source_name, s.k IS NOT NULL OR n_regionkey > 1 AS is_active FROM nation n FULL JOIN (SELECT r_regionkey * 7 AS k, r_name AS name FROM region) s ON n.n_nationkey = s.k")
def ups11_reseed_sources(spark, sf_dir):
    stored = ad.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("source_id"), F.col("n_name").alias("source_name"), (F.col("n_regionkey") > 1).alias("is_active"))
    return imports.reseed(stored, ad.table(spark, sf_dir, "region").select((F.col("r_regionkey") * 7).alias("source_id"), F.col("r_name").alias("source_name")))


@query("SELECT event_id AS id, coalesce(CASE WHEN event_type <> 'error' THEN event_type END, '') AS provider_key, CAST(user_id AS VARCHAR) AS review_id, CAST(NULL AS VARCHAR) AS note FROM events")
def ups15_migrate_feedback(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("provider"), "value")
    return imports.migrate(e, {"id": "bigint", "provider_key": "string", "review_id": "string", "note": "string"}, {"event_id": "id", "user_id": "review_id"}, {"provider_key": F.coalesce("provider", F.lit(""))})


# --- golden cases ------------------------------------------------------------------------------

GOLDEN = """items AS (SELECT event_id AS id, 'R-' || user_id AS review_id, event_type AS product_id, ['battery', 'camera', 'display'][user_id % 3 + 1] AS aspect, CASE event_type WHEN 'error' THEN 'negative' WHEN 'purchase' THEN 'positive' END AS sentiment, value FROM events),
 judged AS (SELECT *, CASE WHEN value > 40 THEN CASE WHEN aspect = 'battery' THEN ['battery:negative', 'battery:positive'] ELSE ['battery:negative', aspect || ':positive'] END WHEN sentiment IS NOT NULL THEN [aspect || ':' || sentiment] END AS labels FROM items WHERE value > 10),
 cases AS (SELECT *, 'live_r_' || (replace(review_id, 'R-', '')) || '_' || replace(array_to_string(labels, '_'), ':', '_') AS case_id FROM judged WHERE labels IS NOT NULL)"""


def _promoted(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events")
    aspect = F.element_at(F.array(F.lit("battery"), F.lit("camera"), F.lit("display")), (F.col("user_id") % 3 + 1).cast("int"))
    sentiment = F.when(F.col("event_type") == "error", "negative").when(F.col("event_type") == "purchase", "positive")
    queue = e.select(F.col("event_id").alias("id"), F.concat(F.lit("R-"), F.col("user_id").cast("string")).alias("review_id"), F.col("event_type").alias("product_id"), aspect.alias("aspect"), sentiment.alias("predicted_sentiment"), F.lit("open").alias("status"))
    label = lambda a, s: F.struct(F.lit(a).alias("aspect") if isinstance(a, str) else a.alias("aspect"), F.lit(s).alias("sentiment"))
    given = F.when(F.col("value") > 40, F.array(label(" Battery ", "Negative"), label("", "positive"), label(aspect, "positive"), label("battery", "negative")))
    decisions = e.where("value > 10").select(F.col("event_id").alias("id"), given.alias("expected"), F.lit(None).cast("string").alias("expected_aspect"), F.lit("").alias("expected_sentiment"), F.concat(F.lit("note "), F.col("event_id").cast("string")).alias("note"))
    reviews = queue.select("review_id").distinct().withColumn("raw_text", F.lit("text"))
    return queue, golden.promote(queue, reviews, decisions)


@query("SELECT case_id, min(id) AS source_item, any_value(review_id) AS review_id, arg_min(product_id, id) AS product_id, any_value(array_to_string(labels, ',')) AS labels, arg_max('note ' || id, id) AS note FROM cases GROUP BY case_id", GOLDEN)
def dom17_promote_to_golden(spark, sf_dir):
    return golden.store(_promoted(spark, sf_dir)[1]).select("case_id", "source_item", "review_id", "product_id", golden.label_text(F.col("labels")).alias("labels"), "note")


@query("SELECT i.id, CASE WHEN c.id IS NOT NULL THEN 'promoted' ELSE 'open' END AS status FROM items i LEFT JOIN cases c USING (id)", GOLDEN)
def ups9_queue_status(spark, sf_dir):
    queue, made = _promoted(spark, sf_dir)
    return golden.set_status(queue, made.where("case_id is not null").select(F.col("id").alias("seq"), "id", F.lit("promoted").alias("status"))).select("id", "status")


@query("SELECT case_id, any_value(CASE WHEN contains(case_id, 'camera') THEN 'camera:mixed' ELSE array_to_string(labels, ',') END) AS labels, CASE WHEN any_value(contains(case_id, 'camera')) THEN NULL ELSE arg_max('note ' || id, id) END AS note FROM cases GROUP BY case_id", GOLDEN)
def ups9_golden_relabel(spark, sf_dir):
    g = golden.store(_promoted(spark, sf_dir)[1])
    one = lambda a, s: F.array(F.struct(F.lit(a).alias("aspect"), F.lit(s).alias("sentiment")))
    new = F.when(F.contains("case_id", F.lit("camera")), one("Camera", " mixed")).otherwise(one("", "bad"))
    changes = g.select("case_id", new.alias("labels"), F.lit(None).cast("string").alias("note"))
    return golden.relabel(g, changes).select("case_id", golden.label_text(F.col("labels")).alias("labels"), "note")


CASES = """cs AS (SELECT doc_id, quality = 1 AS e1, toxic = 1 AS e2, (doc_id + quality) % 2 = 0 AS s1 FROM labels)"""


def _cases(spark, sf_dir):
    t = ad.table(spark, sf_dir, "labels")
    one = lambda a, s: F.struct(F.lit(a).alias("aspect"), F.lit(s).alias("sentiment"))
    expected = F.array_compact(F.array(F.when(F.col("quality") == 1, one("quality", "positive")), F.when(F.col("toxic") == 1, one("toxicity", "negative"))))
    predicted = F.array(one("quality", "positive"), F.when((F.col("doc_id") + F.col("quality")) % 2 == 0, one("toxicity", "negative")).otherwise(one("toxicity", "mixed")))
    return t.select(F.col("doc_id").alias("case_id"), expected.alias("expected"), predicted.alias("predicted"))


@query(f"SELECT count(*) AS total_cases, count(*) AS exact_aspect_hits, {N('NOT e2 OR s1')} AS sentiment_hits, 1.0::DOUBLE AS aspect_precision_proxy, {R(N('NOT e2 OR s1') + ' / CAST(count(*) AS DOUBLE)', 3)} AS sentiment_accuracy_proxy FROM cs", CASES)
def agg23_set3_evaluation_proxies(spark, sf_dir):
    return golden.proxies(_cases(spark, sf_dir))


@query("SELECT doc_id AS case_id FROM cs WHERE e2 AND NOT s1", CASES)
def set3_failed_cases(spark, sf_dir):
    return golden.failed(_cases(spark, sf_dir))


# --- dashboard and reports ---------------------------------------------------------------------

CARD4 = f"""cards AS (SELECT s.product_id, n, rating, quality, net FROM (SELECT product_id, count(*) AS n, {R(M("rating"), 2)} AS rating, {R(M("quality_score"), 3)} AS quality FROM scored GROUP BY product_id) s JOIN
  (SELECT product_id, {R("(sum(CASE WHEN sentiment = 'positive' THEN w ELSE 0 END) - sum(CASE WHEN sentiment = 'negative' THEN w ELSE 0 END)) / CAST(sum(n) AS DOUBLE) * 100", 1)} AS net FROM (SELECT product_id, sentiment, n, CASE WHEN i = 0 THEN 0.5::DOUBLE ELSE i END * n AS w FROM (SELECT product_id, sentiment, count(*) AS n, {M("intensity")} AS i FROM reviews GROUP BY ALL)) GROUP BY product_id) m USING (product_id))"""


def _products(spark, sf_dir):
    r = scored(spark, sf_dir)
    return r, summary.product_summary(r), summary.net_sentiment(r), summary.sentiment_counts(r), summary.aspect_summary(r)


@query("SELECT product_id, card, CASE card WHEN 'review_count' THEN CAST(n AS DOUBLE) WHEN 'average_rating' THEN rating WHEN 'quality_score' THEN quality ELSE net END AS value, CASE card WHEN 'review_count' THEN CASE WHEN n < 30 THEN 'low_volume' ELSE 'stronger_volume' END WHEN 'net_sentiment' THEN CASE WHEN n < 30 THEN 'directional' ELSE 'usable' END END AS status FROM cards, (VALUES ('review_count'), ('average_rating'), ('quality_score'), ('net_sentiment')) c(card)", RV, SCORED, CARD4)
def dom30_all_kpi_cards(spark, sf_dir):
    _, products, net, _, _ = _products(spark, sf_dir)
    return report.kpi_cards(products, net)


@query(
    """SELECT product_id, card, CASE card WHEN 'readiness_status' THEN 'Ready With Limitations' WHEN 'warning_count' THEN '2' ELSE CASE WHEN n < 30 THEN 'Directional' ELSE 'Stronger' END END AS value, CASE card WHEN 'readiness_status' THEN 'ready_with_limitations' WHEN 'warning_count' THEN 'warn' ELSE CASE WHEN n < 30 THEN 'directional' ELSE 'stronger' END END AS status,
    CASE card WHEN 'readiness_status' THEN 'Whether the current workspace is safe to interpret.' WHEN 'warning_count' THEN 'a' ELSE CASE WHEN n < 30 THEN 'Low review volume. Validate before decisions.' ELSE 'Review volume supports stronger directional analysis.' END END AS helper_text
    FROM (SELECT product_id, count(*) AS n FROM reviews GROUP BY product_id), (VALUES ('readiness_status'), ('warning_count'), ('confidence_note')) c(card)""", RV,
)
def dom30_quality_cards(spark, sf_dir):
    ready = spark.createDataFrame([("ready_with_limitations", "a,b")], "status string, warnings string")
    return dashboard.quality_cards(_products(spark, sf_dir)[1], ready)


@query("SELECT product_id, sentiment AS label, count(*) AS value, count(*) || ' ' || sentiment || ' signal(s)' AS helper_text FROM reviews GROUP BY product_id, sentiment", RV)
def dom31_sentiment_chart(spark, sf_dir):
    return dashboard.sentiment_chart(summary.sentiment_counts(ad.reviews(spark, sf_dir)))


@query("SELECT product_id, CAST(place AS INT) AS place, aspect AS label, n AS value, n || ' mention(s)' AS helper_text FROM (SELECT product_id, aspect, count(*) AS n, row_number() OVER (PARTITION BY product_id ORDER BY count(*) DESC, aspect) AS place FROM reviews GROUP BY product_id, aspect) WHERE place <= 5", RV)
def dom31_top_aspect_chart(spark, sf_dir):
    return dashboard.top_aspect_chart(summary.top_aspects(ad.reviews(spark, sf_dir)))


LABELLED = f"""lab AS (SELECT *, CASE WHEN positive_count > 0 AND negative_count > 0 THEN CASE WHEN abs(aspect_score) < 25 THEN 'mixed' WHEN aspect_score > 0 THEN 'polarized-positive' ELSE 'polarized-negative' END WHEN aspect_score >= 25 THEN 'positive-heavy' WHEN aspect_score <= -25 THEN 'negative-heavy' WHEN neutral_count > 0 THEN 'neutral' ELSE 'mixed' END AS sentiment_label,
    CASE WHEN mentions < 2 THEN CASE WHEN aspect_score >= 25 THEN 'small-delight' WHEN aspect_score <= -25 THEN 'watchlist-complaint' ELSE 'thin-evidence' END WHEN negative_count > positive_count THEN CASE WHEN mentions >= 3 THEN 'high-volume-complaint' ELSE 'complaint-driver' END WHEN positive_count > negative_count THEN CASE WHEN mentions >= 3 THEN 'high-volume-delight' ELSE 'delight-driver' END ELSE 'mixed-signal' END AS priority_bucket, {LABEL("aspect")} AS nice FROM asp),
 told AS (SELECT *, nice || CASE priority_bucket WHEN 'high-volume-complaint' THEN ' is a high-volume complaint area and should be treated as a priority pain point.' WHEN 'complaint-driver' THEN ' is currently a complaint driver, but evidence volume is still limited.' WHEN 'watchlist-complaint' THEN ' has negative sentiment, but only ' || mentions || ' mention(s). Keep it on the watchlist.'
    WHEN 'high-volume-delight' THEN ' is a high-volume positive driver and likely a product strength.' WHEN 'delight-driver' THEN ' is currently a positive driver, but evidence volume is still limited.' WHEN 'small-delight' THEN ' has a small positive signal with only ' || mentions || ' mention(s).'
    ELSE CASE WHEN sentiment_label LIKE 'polarized%' OR priority_bucket = 'mixed-signal' THEN ' has mixed signals and should be checked with supporting review evidence.' ELSE ' has thin evidence. Avoid drawing a strong conclusion yet.' END END AS interpretation FROM lab)"""


@query("SELECT product_id, aspect, CAST(row_number() OVER (PARTITION BY product_id ORDER BY mentions DESC, abs(aspect_score) DESC, aspect) AS INT) AS place, sentiment_label, priority_bucket, interpretation FROM told", RV, ASP, LABELLED)
def dom32_sca50_aspect_chart(spark, sf_dir):
    return dashboard.aspect_chart(summary.aspect_summary(ad.reviews(spark, sf_dir))).select("product_id", "aspect", "place", "sentiment_label", "priority_bucket", "interpretation")


@query(
    """SELECT p.product_id, c.card, CASE c.card WHEN 'mood_balance' THEN CASE WHEN a > b * 1.25 THEN 'Positive-Leaning' WHEN b > a * 1.25 THEN 'Negative-Leaning' ELSE 'Mixed' END WHEN 'dominant_positive_area' THEN coalesce(g.nice, 'Not clear') WHEN 'dominant_negative_area' THEN coalesce(h.nice, 'Not clear')
      WHEN 'sentiment_evidence_strength' THEN CASE WHEN n < 30 THEN 'Early Signal' WHEN n < 100 THEN 'Directional' WHEN n < 500 THEN 'Stronger Signal' ELSE 'High Confidence' END ELSE coalesce(z.nice, 'None yet') END AS value,
    CASE c.card WHEN 'mood_balance' THEN CASE WHEN a > b * 1.25 THEN a || ' positive vs ' || b || ' negative signal(s).' WHEN b > a * 1.25 THEN b || ' negative vs ' || a || ' positive signal(s).' ELSE a || ' positive and ' || b || ' negative signal(s) are currently balanced.' END
      WHEN 'dominant_positive_area' THEN coalesce(g.interpretation, 'No strong positive aspect signal yet.') WHEN 'dominant_negative_area' THEN coalesce(h.interpretation, 'No strong complaint aspect signal yet.')
      WHEN 'sentiment_evidence_strength' THEN CASE WHEN n < 30 THEN 'Small sample. Treat aspect sentiment as early signal.' WHEN n < 100 THEN 'Usable sample for directional sentiment analysis.' WHEN n < 500 THEN 'Stronger sample for product interpretation.' ELSE 'Large review base supports high-confidence sentiment patterns.' END
      ELSE CASE WHEN z.aspect IS NULL THEN 'No aspect has enough mixed evidence yet.' ELSE 'This aspect has both positive and negative signals.' END END AS helper_text
    FROM (SELECT product_id, count(*) AS n, count(*) FILTER (sentiment = 'positive') AS a, count(*) FILTER (sentiment = 'negative') AS b FROM reviews GROUP BY product_id) p
    CROSS JOIN (VALUES ('mood_balance'), ('dominant_positive_area'), ('dominant_negative_area'), ('sentiment_evidence_strength'), ('polarized_aspect')) c(card)
    LEFT JOIN (SELECT t.* FROM picks k JOIN told t USING (product_id, aspect) WHERE pick = 'strongest_positive') g ON g.product_id = p.product_id LEFT JOIN (SELECT t.* FROM picks k JOIN told t USING (product_id, aspect) WHERE pick = 'strongest_negative') h ON h.product_id = p.product_id
    LEFT JOIN (SELECT t.* FROM picks k JOIN told t USING (product_id, aspect) WHERE pick = 'polarized') z ON z.product_id = p.product_id""", RV, ASP, LABELLED, PICKS,
)
def dom33_insight_cards(spark, sf_dir):
    _, products, _, counts, aspects = _products(spark, sf_dir)
    return dashboard.insight_cards(products, counts, aspects).select("product_id", "card", "value", "helper_text")


GAPS = """gaps AS (SELECT *, CASE WHEN own_mentions = 0 AND other_mentions = 0 THEN 'No comparable evidence is available for ' || aspect || ' on either product.'
   WHEN own_mentions = 0 THEN 'The competitor has ' || aspect || ' evidence, but the selected product has no comparable ' || aspect || ' evidence yet. Treat this as an evidence gap, not a confirmed weakness.'
   WHEN other_mentions = 0 THEN 'The selected product has ' || aspect || ' evidence, but the competitor has no comparable ' || aspect || ' evidence yet. Treat this as an evidence gap, not a confirmed strength.'
   ELSE CASE WHEN abs(gap) < 5 THEN 'Near parity on ' || aspect || '.' WHEN gap > 0 THEN 'The selected product is ahead on ' || aspect || ' by ' || CAST(gap AS VARCHAR) || ' points.' ELSE 'The competitor is ahead on ' || aspect || ' by ' || CAST(abs(gap) AS VARCHAR) || ' points.' END || CASE WHEN confidence_label = 'low' THEN ' Treat as directional because evidence volume/confidence is still low.' ELSE '' END END AS interpretation FROM bl)"""


@query("SELECT aspect, gap, own_score, other_score AS competitor_score, confidence_label, interpretation FROM gaps", RV, BENCH, GAPS)
def dom34_sca20_gap_chart(spark, sf_dir):
    return dashboard.gap_chart(compare.benchmark(ad.reviews(spark, sf_dir), "Brand#1", "Brand#2"))


NAMED = lambda c: f"list_sort(list_filter([{c}], x -> x IS NOT NULL))"


TAGS = """tags AS (SELECT 'priority' AS family, CASE WHEN relevance_score >= 70 THEN 'high' WHEN relevance_score >= 35 THEN 'medium' ELSE 'low' END AS tag FROM scored_news UNION ALL SELECT 'tier', CAST(page_id % 3 AS VARCHAR) FROM n
  UNION ALL SELECT 'company', x FROM (SELECT unnest(list_distinct(list_concat(list_filter({makers}, lambda x: contains(t, x)), list_filter(['qualcomm', 'mediatek'], lambda x: contains(t, x))))) AS x FROM n)
  UNION ALL SELECT 'region', replace(x, ' ', '_') FROM (SELECT unnest(list_filter({regions}, lambda x: contains(t, x))) AS x FROM n)
  UNION ALL SELECT 'technology', x FROM (SELECT unnest(list_distinct(list_concat(list_transform(list_filter({tech}, lambda x: contains(t, x)), lambda x: replace(x, ' ', '_')), list_filter({chips}, lambda x: contains(t, x))))) AS x FROM n)),
 counted AS (SELECT family, tag, count(*) AS n, CAST(row_number() OVER (PARTITION BY family ORDER BY count(*) DESC, tag) AS INT) AS place FROM tags GROUP BY family, tag)""".format(makers=news.MAKERS, regions=news.REGIONS, tech=[*news.AI, *news.TECH], chips=news.CHIPS)


def _brief(spark, sf_dir):
    return _news(spark, sf_dir).withColumn("source_tier", F.col("page_id") % 3)


@query("SELECT family, tag, n, place FROM counted WHERE place <= 8", _NEWS, RELEVANCE, TAGS)
def agg18_news_counters(spark, sf_dir):
    return news.brief(_brief(spark, sf_dir)).where("family <> 'topic'")


@query("SELECT tag AS label, 1 AS value, family AS category, family || ' signal' AS helper_text FROM (SELECT *, row_number() OVER (ORDER BY family = 'technology' DESC, family = 'company' DESC, place) AS k FROM counted WHERE place <= 8 AND family IN ('technology', 'company', 'region')) WHERE k <= 12", _NEWS, RELEVANCE, TAGS)
def agg28_signal_chart(spark, sf_dir):
    return dashboard.signal_chart(news.brief(_brief(spark, sf_dir)))


@query("SELECT 'Tier ' || tag AS label, n AS value, 'tier_' || tag AS status, n || ' item(s) from source tier ' || tag AS helper_text FROM counted WHERE family = 'tier'", _NEWS, RELEVANCE, TAGS)
def agg28_tier_chart(spark, sf_dir):
    return dashboard.tier_chart(_brief(spark, sf_dir))


@query("SELECT tag AS label, family AS signal_type FROM counted WHERE (family = 'technology' AND place <= 8) OR (family IN ('company', 'region') AND place <= 6)", _NEWS, RELEVANCE, TAGS)
def agg28_signal_chips(spark, sf_dir):
    return dashboard.chips(news.brief(_brief(spark, sf_dir)))


@query(
    """SELECT items, high, medium, array_to_string(list_filter([CASE WHEN high > 0 THEN high || ' high-priority trusted news item(s) were identified for smartphone/OEM market intelligence.' ELSE 'No high-priority item was identified; current signals should be treated as background monitoring.' END, CASE WHEN len(te) > 0 THEN 'Key technology signals include ' || array_to_string(te, ', ') || '.' END,
      CASE WHEN len(co) > 0 THEN 'Key company/ecosystem signals include ' || array_to_string(co, ', ') || '.' END, CASE WHEN len(re) > 0 THEN 'Priority region signals include ' || array_to_string(re, ', ') || '.' END, CASE WHEN first > 0 THEN first || ' item(s) come from Tier-1 official or primary sources, improving evidence quality.' END], lambda x: x IS NOT NULL), ' ') AS summary
    FROM (SELECT (SELECT count(*) FROM n) AS items, (SELECT coalesce(sum(n), 0)::BIGINT FROM counted WHERE tag = 'high' AND family = 'priority') AS high, (SELECT coalesce(sum(n), 0)::BIGINT FROM counted WHERE tag = 'medium' AND family = 'priority') AS medium, (SELECT coalesce(sum(n), 0)::BIGINT FROM counted WHERE family = 'tier' AND tag = '1') AS first,
      (SELECT coalesce(list(tag ORDER BY place), []) FROM counted WHERE family = 'technology' AND place <= 4) AS te, (SELECT coalesce(list(tag ORDER BY place), []) FROM counted WHERE family = 'company' AND place <= 4) AS co, (SELECT coalesce(list(tag ORDER BY place), []) FROM counted WHERE family = 'region' AND place <= 4) AS re)""", _NEWS, RELEVANCE, TAGS,
)
def dom14_set7_news_texts(spark, sf_dir):
    return news.brief_texts(_brief(spark, sf_dir)).select("items", "high", "medium", F.array_join("summary", " ").alias("summary"))


SPECS = """sp AS (SELECT p_partkey, p_name, p_type, p_size, p_retailprice FROM part)"""


@query(
    "SELECT place, category, field, a AS selected_product_value, b AS competitor_value, CASE WHEN a <> 'Unknown' AND b <> 'Unknown' AND lower(a) = lower(b) THEN 'tie' ELSE 'unknown' END AS winner, CASE WHEN a = 'Unknown' OR b = 'Unknown' THEN 'unknown' ELSE 'likely' END AS confidence, 'catalog' AS source_status FROM ("
    + " UNION ALL ".join(f"SELECT {k}::INT AS place, '{c}' AS category, '{label}' AS field, {v(7)} AS a, {v(8)} AS b" for k, (c, label, f) in enumerate(dashboard.SPEC_ROWS) for v in [lambda key, f=f: {"current_price": f"(SELECT CAST(p_retailprice AS VARCHAR) FROM part WHERE p_partkey = {key})", "ram": f"(SELECT CAST(p_size AS VARCHAR) FROM part WHERE p_partkey = {key})", "chipset": "'same'" if key == 7 else "'SAME'", "storage": "'Unknown'"}.get(f, "'Unknown'")])
    + ")"
)
def prj2_full_spec_table(spark, sf_dir):
    fields = {"current_price": F.col("p_retailprice").cast("string"), "ram": F.col("p_size").cast("string"), "chipset": F.when(F.col("p_partkey") == 7, "same").otherwise(" SAME "), "storage": F.lit(" n/a")}
    p = ad.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("product_id"), *(fields.get(f, F.lit(None).cast("string")).alias(f) for _, _, f in dashboard.SPEC_ROWS), F.lit("manual").alias("source_confidence"))
    return dashboard.specs(p, "7", "8")


@query("SELECT * FROM (VALUES " + ", ".join(f"({k}::INT, '{c}', '{f}', 'Unknown', 'Unknown', 'unknown', 'unknown', 'needs_source')" for k, (c, f) in enumerate(dashboard.UNKNOWN_ROWS)) + ") t(place, category, field, selected_product_value, competitor_value, winner, confidence, source_status)")
def prj3_prj8_unknown_specs(spark, sf_dir):
    p = ad.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("product_id"), *(F.lit(None).cast("string").alias(f) for _, _, f in dashboard.SPEC_ROWS))
    return dashboard.checked_specs(dashboard.specs(p, "7", "none"))


@query("SELECT r.product_id, coalesce(p.product_name, r.product_id) AS shown FROM (SELECT DISTINCT product_id FROM reviews) r LEFT JOIN (SELECT * FROM products WHERE price > 22600) p ON r.product_id = p.product_id", RV, PD)
def prj9_display_names(spark, sf_dir):
    names = ad.products(spark, sf_dir).where("price > 22600").select("product_id", "product_name")
    return ad.reviews(spark, sf_dir).select("product_id").distinct().join(names, "product_id", "left").select("product_id", F.coalesce("product_name", "product_id").alias("shown"))


ACTIONS = "CASE aspect " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in sc.ACTIONS.items()) + " ELSE 'analyst_review_required' END"


@query(
    f"""SELECT product_id, aspect, sentiment, {LABEL("aspect")} || CASE sentiment WHEN 'negative' THEN ' complaint theme' WHEN 'positive' THEN ' delight theme' ELSE ' watchlist theme' END AS theme_name, {ACTIONS} AS actionability,
    CASE sentiment WHEN 'negative' THEN aspect || ' is appearing as a complaint theme in ' || mentions || ' mention(s). Severity score is ' || CAST(severity AS VARCHAR) || '; prioritize if this grows with more data.' WHEN 'positive' THEN aspect || ' is appearing as a delight driver in ' || mentions || ' mention(s). This may be useful for product positioning or marketing evidence.'
    ELSE aspect || ' has mixed/neutral signals. Keep it on watchlist until more evidence is available.' END AS interpretation FROM (SELECT * REPLACE (CASE WHEN aspect = 'ECONOMY' THEN 'battery' ELSE lower(aspect) END AS aspect) FROM th)""", RV, THEMES,
)
def sca23_sca50_theme_texts(spark, sf_dir):
    g = summary.theme_groups(ad.reviews(spark, sf_dir)).withColumn("aspect", F.when(F.col("aspect") == "ECONOMY", "battery").otherwise(F.lower("aspect")))
    a, s = F.col("aspect"), F.col("sentiment")
    return g.select("product_id", "aspect", "sentiment", sc.theme_name(a, s).alias("theme_name"), sc.actionability(a).alias("actionability"), sc.theme_text(a, s, F.col("mentions"), F.col("severity")).alias("interpretation"))


@query("SELECT product_id, family, t.aspect, CAST(e.place AS INT) AS evidence_place, review_id FROM (SELECT *, CASE sentiment WHEN 'negative' THEN 'complaint' WHEN 'positive' THEN 'delight' ELSE 'watchlist' END AS family, row_number() OVER (PARTITION BY product_id, sentiment ORDER BY severity DESC, mentions DESC, aspect, sentiment) AS k FROM th WHERE sentiment <> 'neutral') t JOIN (SELECT product_id, aspect, sentiment, review_id, row_number() OVER (PARTITION BY product_id, aspect, sentiment ORDER BY intensity DESC, confidence DESC, review_date DESC, review_id, aspect) AS place FROM reviews) e USING (product_id, aspect, sentiment) WHERE k <= 5 AND e.place <= 3", RV, THEMES)
def dom7_theme_evidence(spark, sf_dir):
    r = ad.reviews(spark, sf_dir)
    t = summary.themes(r).where("family <> 'watchlist'").select("product_id", "family", "aspect", "sentiment")
    e = summary.evidence_top(r.select("product_id", "aspect", "sentiment", "review_id", "intensity", "confidence", "review_date"), 3, "product_id", "aspect", "sentiment")
    return t.join(e, ["product_id", "aspect", "sentiment"]).select("product_id", "family", "aspect", F.col("place").alias("evidence_place"), "review_id")


BRIEF = f"""brief AS (SELECT c.product_id, c.product_id || ' currently has ' || n || ' processed review(s) with average rating ' || CAST(rating AS VARCHAR) || '. The net sentiment score is ' || CAST(net AS VARCHAR) || '. ' || coalesce('Top strength is ' || g.aspect || '.', 'No strong positive aspect has enough evidence yet.') || ' ' || coalesce('Top risk is ' || b.aspect || '.', 'No major negative aspect has enough evidence yet.')
   || ' Near-term perception direction is ' || coalesce(o.direction, 'uncertain') || ' with ' || coalesce(o.confidence, 'low') || ' confidence.' AS brief
  FROM cards c LEFT JOIN (SELECT * FROM picks WHERE pick = 'strongest_positive') g USING (product_id) LEFT JOIN (SELECT * FROM picks WHERE pick = 'strongest_negative') b ON b.product_id = c.product_id LEFT JOIN
  (SELECT product_id, CASE WHEN d > u THEN 'likely_declining' WHEN u > d THEN 'likely_improving' ELSE 'likely_stable_or_mixed' END AS direction, CASE WHEN h >= half THEN 'high' WHEN m + h >= half THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT product_id, {N("contains(direction, 'improving')")} AS u, {N("contains(direction, 'declining')")} AS d, {N("confidence_label = 'high'")} AS h, {N("confidence_label = 'medium'")} AS m, greatest(1, count(*) // 2) AS half FROM fd GROUP BY product_id)) o ON o.product_id = c.product_id)"""


REPORT = f"""top3 AS (SELECT product_id, CASE sentiment WHEN 'negative' THEN 'risk' ELSE 'strength' END AS kind, {LABEL("aspect")} || CASE sentiment WHEN 'negative' THEN ' is the clearest customer risk area to validate.' ELSE ' is the strongest positive customer signal.' END AS bullet, row_number() OVER (PARTITION BY product_id, sentiment ORDER BY severity DESC, mentions DESC, aspect) AS place FROM th WHERE sentiment <> 'neutral'),
 lists AS (SELECT product_id, n, (SELECT list(bullet ORDER BY place) FROM top3 t WHERE t.product_id = p.product_id AND kind = 'strength' AND place <= 3) AS good, (SELECT list(bullet ORDER BY place) FROM top3 t WHERE t.product_id = p.product_id AND kind = 'risk' AND place <= 3) AS bad FROM (SELECT product_id, count(*) AS n FROM reviews GROUP BY product_id) p),
 full_ AS (SELECT product_id, n, coalesce(good, ['No clear positive customer signal is strong enough yet. More review evidence is needed.']) AS good, coalesce(bad, ['No clear customer risk signal is strong enough yet. Continue collecting review evidence.']) AS bad FROM lists)"""


@query(
    """SELECT product_id, section, CAST(k - 1 AS INT) AS place, bullets[k] AS bullet FROM (SELECT product_id, section, bullets, unnest(range(1, len(bullets) + 1)) AS k FROM (
      SELECT product_id, 'Decision Summary' AS section, [CASE WHEN n < 30 THEN 'Current findings should be treated as early directional signals because the review volume is still low.' ELSE 'Review volume is strong enough to support more confident directional product insights.' END, 'Primary positive signal: ' || good[1], 'Primary risk signal: ' || bad[1], 'This is a product-only view. Add a competitor only when benchmark comparison is needed.'] AS bullets FROM full_
      UNION ALL SELECT product_id, 'Customer Strength Signals', good FROM full_ UNION ALL SELECT product_id, 'Customer Risk Signals', bad FROM full_ UNION ALL SELECT product_id, 'Competitor Benchmark', ['No competitor was selected. This report focuses on the selected product only.'] FROM full_ UNION ALL SELECT product_id, 'Trusted Market Signals', ['No high-relevance trusted market signal is available yet.'] FROM full_
      UNION ALL SELECT product_id, 'Recommended Actions', list_filter([CASE WHEN n < 30 THEN 'Increase the real review sample before using these findings for roadmap or leadership decisions.' END, 'Validate the top risk signal with more reviews, evidence examples, and product-team review.', 'Keep this as a product-only analysis, or add a competitor only when benchmark comparison is required.', 'Preserve evidence links with every claim so the report remains auditable.'], lambda x: x IS NOT NULL) FROM full_))""", RV, THEMES, REPORT,
)
def dom25_executive_sections(spark, sf_dir):
    r = ad.reviews(spark, sf_dir)
    return dashboard.sections(dashboard.executive_report(r.groupBy("product_id").agg(F.count("*").alias("review_count")), summary.themes(r)))


@query(
    """SELECT frame, n FROM (SELECT 'aspect_sentiment_chart' AS frame, count(*) AS n FROM asp UNION ALL SELECT 'kpi_cards', 4 * count(DISTINCT product_id) FROM reviews UNION ALL SELECT 'quality_cards', 3 * count(DISTINCT product_id) FROM reviews UNION ALL SELECT 'sentiment_insight_cards', 5 * count(DISTINCT product_id) FROM reviews
    UNION ALL SELECT 'sentiment_distribution_chart', count(DISTINCT product_id || '|' || sentiment) FROM reviews UNION ALL SELECT 'sentiment_priority_matrix', count(*) FROM asp UNION ALL SELECT 'aspect_reason_cards', count(*) FROM asp UNION ALL SELECT 'workflow_tiles', 5 * count(DISTINCT product_id) FROM reviews
    UNION ALL SELECT 'top_aspect_chart', sum(least(5, k))::BIGINT FROM (SELECT count(*) AS k FROM asp GROUP BY product_id) UNION ALL SELECT 'competitor_gap_chart', count(DISTINCT aspect) FROM asp WHERE product_id IN ('Brand#1', 'Brand#2') UNION ALL SELECT 'benchmark_summary', 1 UNION ALL SELECT 'benchmark_spec_table', 18 UNION ALL SELECT 'source_tier_chart', count(DISTINCT page_id % 3) FROM pages)""", RV, ASP,
)
def dom24_dashboard_frames(spark, sf_dir):
    r, products, net, counts, aspects = _products(spark, sf_dir)
    items = _brief(spark, sf_dir)
    ready = spark.createDataFrame([("ready", "")], "status string, warnings string")
    cat = ad.products(spark, sf_dir).select("product_id", *(F.lit(None).cast("string").alias(f) for _, _, f in dashboard.SPEC_ROWS))
    frames = dashboard.dashboard(products, net, counts, summary.top_aspects(r), aspects, ready, news.brief(items), items, compare.benchmark(r, "Brand#1", "Brand#2"), cat, "Brand#1", "Brand#2")
    return summary.table_counts({n: f for n, f in frames.items() if not n.startswith("news_signal")}).withColumnRenamed("table_name", "frame")


# --- small expressions -------------------------------------------------------------------------


@query(
    """SELECT p_partkey, CASE WHEN p_size < 10 THEN p_name WHEN p_size < 20 THEN 'none' ELSE p_name || ', ' || p_type || ', and 1 more' END AS joined, CASE WHEN p_size < 25 THEN 0.5 ELSE least(1.0, p_size / 40.0) END AS bounded, CASE WHEN p_size % 2 = 0 THEN lower(p_type) END AS kind, p_name || ' leads on ' || p_type AS without_scores, CASE WHEN p_size % 3 = 0 THEN 2 ELSE 0 END AS listed, p_brand IN ('Brand#1', 'Brand#2') AS own_brand FROM part"""
)
def sca43_sca45_sca51_sca55_expressions(spark, sf_dir):
    p = ad.table(spark, sf_dir, "part")
    size = F.col("p_size")
    parts = F.when(size < 10, F.array(F.lit(""), F.col("p_name"))).when(size < 20, F.array(F.lit(None).cast("string"))).otherwise(F.array("p_name", "p_type", "p_brand"))
    number = F.when(size < 25, F.lit("none")).otherwise((size / 40.0).cast("string"))
    kind = F.when(size % 2 == 0, F.concat(F.lit(" "), "p_type")).otherwise("other")
    listed = F.when(size % 3 == 0, F.lit('["a", "b"]')).when(size % 3 == 1, F.lit("{bad"))
    own = ["Brand#1", "Brand#2"]
    return p.select(
        "p_partkey", tf.joined_short(parts).alias("joined"), tf.bounded(number, 0.5).alias("bounded"), tf.one_of(kind, [t.lower() for t in ("ECONOMY", "STANDARD", "PROMO", "MEDIUM", "SMALL", "LARGE")]).alias("kind"),
        tf.without_scores(F.concat("p_name", F.lit(" leads  on "), "p_type", F.lit(" by 12.5"), F.lit(" 3 points"))).alias("without_scores"), F.size(tf.json_list(listed)).alias("listed"), F.col("p_brand").isin(*own).alias("own_brand"),
    )


@query(
    """SELECT doc_id, CASE WHEN text = '' THEN NULL ELSE trim(text) END AS first_filled, CASE WHEN lower(trim(source)) IN ('', 'nan', 'none', 'null', 'n/a', 'na', '-', '--') THEN NULL ELSE trim(regexp_replace(source, '\\s+', ' ', 'g')) END AS source FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE source END AS text, CASE WHEN doc_id % 3 = 0 THEN ' N/A ' ELSE source END AS source FROM documents)"""
)
def sca47_sca49_null_words(spark, sf_dir):
    d = ad.table(spark, sf_dir, "documents")
    t, s = F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("source")), F.when(F.col("doc_id") % 3 == 0, " N/A ").otherwise(F.col("source"))
    return d.select("doc_id", tf.first_filled(F.lit(" "), t).alias("first_filled"), tf.null_token(s).alias("source"))


CLEANED = rf"""SELECT review_id, coalesce(reason, CASE WHEN row_number() OVER (PARTITION BY reason, source, product_id, lower(t) ORDER BY seq, review_id) > 1 THEN 'duplicate' ELSE 'clean' END) AS status FROM (SELECT *, CASE WHEN t = '' THEN 'missing_raw_text' WHEN regexp_full_match(low, 'helpful\s+for\s+\d+') THEN 'helpful_count_only'
     WHEN metadata THEN 'metadata_only' WHEN junk THEN 'junk_token' WHEN placed THEN 'location_or_address' WHEN t LIKE ',%' OR t LIKE '%District' THEN 'location_like_text' WHEN named THEN 'name_like_text' WHEN (words >= 2 AND opinion) OR words >= 5 THEN NULL WHEN length(t) < 15 THEN 'too_short' WHEN words < 4 AND NOT opinion THEN 'too_few_words' WHEN NOT opinion AND words < 8 THEN 'no_opinion_signal' END AS reason
     FROM (SELECT *, low LIKE 'review for:%' OR low IN ({", ".join(f"'{x}'" for x in quality.METADATA)}) OR regexp_full_match(t, '[^a-zA-Z]+') OR (words <= 3 AND NOT opinion) AS metadata, NOT opinion AND regexp_full_match(replace(t, ' ', ''), '\p{{L}}+') AND ((words >= 2 AND len(regexp_extract_all(t, '\p{{Lu}}')) > 0.7 * len(regexp_extract_all(t, '\p{{L}}'))) OR (words <= 4 AND regexp_matches(low, 'kumar|kar|singh|rahman|baig|tiwari|mankar'))) AS named
      FROM (SELECT *, lower(t) AS low, len(string_split(t, ' ')) AS words, regexp_matches(lower(t), '{"|".join(quality.OPINIONS)}') AS opinion, regexp_matches(lower(t), '{"|".join(quality.JUNK)}') AS junk, regexp_matches(lower(t), '{"|".join(quality.PLACES)}') AS placed FROM (SELECT *, trim(regexp_replace(raw_text, '\s+', ' ', 'g')) AS t FROM reviews))))"""


# --- feeds, pages and exports ------------------------------------------------------------------


@query("SELECT product_id, count(*) FILTER (rating = 1) AS r1, count(*) FILTER (rating = 2) AS r2, count(*) FILTER (rating = 3) AS r3, count(*) FILTER (rating = 4) AS r4, 0::BIGINT AS r5, count(*) FILTER (rating = 5) AS unknown, count(*) AS total FROM reviews GROUP BY product_id", RV)
def agg25_rating_counts(spark, sf_dir):
    return summary.rating_counts(ad.reviews(spark, sf_dir).withColumn("rating", F.when(F.col("rating") < 5, F.col("rating").cast("string")).otherwise("n/a")))


@query(
    """SELECT review_id, specific, words, titled, CAST(row_number() OVER (PARTITION BY product_id ORDER BY specific DESC, words DESC, titled DESC, rating DESC, review_id) AS INT) AS place FROM (SELECT review_id, product_id, CAST(regexp_matches(lower(raw_text), 'camera|battery|display|performance|charging|heat|heating|speaker|network|lag|design|price|budget|value') AS INT) AS specific,
    CASE WHEN raw_text = '' THEN 0 ELSE least(80, len(string_split(raw_text, ' ')))::INT END AS words, 1 AS titled, CAST(CAST(rating AS INT) AS VARCHAR) AS rating FROM reviews) QUALIFY place <= 20""", RV,
)
def srt12_feed_quality(spark, sf_dir):
    from pyspark.sql import Window as W

    q = summary.feed_quality(F.regexp_replace("raw_text", " +", " "), F.col("name"), F.col("rating").cast("int"))
    r = ad.reviews(spark, sf_dir).withColumn("q", q)
    r = r.withColumn("place", F.row_number().over(W.partitionBy("product_id").orderBy(F.desc("q"), "review_id"))).where("place <= 20")
    return r.select("review_id", "q.specific", "q.words", "q.titled", "place")


@query("SELECT o_orderkey, CAST(o_orderdate AS VARCHAR)[:10] AS launch FROM orders WHERE o_orderdate >= TIMESTAMP '1998-06-01' ORDER BY launch, o_orderkey LIMIT 30")
def srt14_upcoming(spark, sf_dir):
    o = ad.table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("launch"))
    return listing.page(o.where("launch >= '1998-06-01'"), ["launch", "o_orderkey"], 30)


@query(
    rf"""SELECT review_id, CASE WHEN raw_text = '' OR raw_text = 'theek hai' THEN 'Good ' || name ELSE raw_text END AS repaired, junk, hard FROM (SELECT *, raw_text = '' OR regexp_matches(low, '{"|".join(quality.JUNK)}') OR (len(string_split(raw_text, ' ')) <= 3 AND NOT regexp_matches(low, '{"|".join(quality.OPINIONS)}')) AS junk, raw_text = '' AS hard FROM (SELECT *, lower(raw_text) AS low FROM reviews))""", RV,
)
def sca40_src16_repair_and_junk(spark, sf_dir):
    t, title = F.col("raw_text"), F.concat(F.lit("Good "), "name")
    return ad.reviews(spark, sf_dir).select("review_id", quality.repaired_text(t, title).alias("repaired"), pages.junk(t).alias("junk"), pages.hard_junk(t).alias("hard"))


@query(f"SELECT count(*) AS input_count, count(*) FILTER (status = 'clean') AS clean_count, count(*) FILTER (status NOT IN ('clean', 'duplicate')) AS removed_count, count(*) FILTER (status = 'duplicate') AS duplicate_count FROM ({CLEANED})", RV)
def snk1_agg21_clean_report(spark, sf_dir):
    return imports.clean_report(_cleaned(spark, sf_dir))[0]


@query(f"SELECT status AS reason, count(*) AS n FROM ({CLEANED}) GROUP BY status", RV)
def agg21_cleaner_counts(spark, sf_dir):
    return imports.counts_by(_cleaned(spark, sf_dir))


def _cleaned(spark, sf_dir):
    r = ad.reviews(spark, sf_dir).select("review_id", "product_id", F.col("name").alias("product_name"), F.concat(F.lit("http://"), "source").alias("source_url"), "raw_text", F.col("source").alias("marketplace"), F.struct("seq", "review_id").alias("seq"))
    return quality.clean_reviews(r)


@query(
    """SELECT tab, n FROM (SELECT 'Catalog' AS tab, count(*) AS n FROM products UNION ALL SELECT 'Raw Reviews', count(*) FROM reviews WHERE review_date >= DATE '2001-01-01' AND helpful_votes < 7 UNION ALL SELECT 'Processed Sentiment', count(*) FROM reviews WHERE review_date >= DATE '2001-01-01' AND helpful_votes < 7
    UNION ALL SELECT 'Daily Summary', count(DISTINCT product_id || review_date) FROM reviews WHERE review_date >= DATE '2001-01-01')""", RV, PD,
)
def snk3_spreadsheet_tabs(spark, sf_dir):
    aspects, raw, processed = _evidence_tables(spark, sf_dir)
    r = ad.reviews(spark, sf_dir)
    more = r.select("review_id", "verified_purchase", F.when(F.col("helpful_votes") < 7, "canonical").otherwise("duplicate").alias("duplicate_status"))
    frames = readers.tabs(raw.join(more, "review_id"), processed.withColumn("primary_language", F.lit("hi_en_mixed")), aspects, ad.products(spark, sf_dir).withColumn("brand", F.col("product_id")), summary.daily_stats(r, r), "2001-01-01")
    return summary.table_counts(frames).withColumnRenamed("table_name", "tab")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN 'the selected product is ahead' ELSE 'battery is the main complaint area to validate.' END AS bullet FROM documents WHERE doc_id % 3 > 0")
def fil13_readable_bullets(spark, sf_dir):
    k = F.col("doc_id") % 3
    b = F.when(k == 0, "It has a net sentiment score of 3").when(k == 1, " phone_a is ahead").otherwise("battery: Battery complaint theme.")
    return listing.readable_bullets(ad.table(spark, sf_dir, "documents").select("doc_id", b.alias("bullet")), names={"phone_a": "the selected product"})


@query("SELECT conv_id, ['A', 'b'] AS kept, len(string_split(roles, ',')) AS n FROM (SELECT conv_id, string_agg(role, ',') AS roles FROM conversations GROUP BY conv_id)".replace("['A', 'b']", "'A,b'"))
def set6_distinct_texts(spark, sf_dir):
    c = ad.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").cast("long").alias("n"))
    return c.select("conv_id", F.array_join(tf.distinct_texts(F.array(F.lit("A"), F.lit("b"), F.lit("a"), F.lit("B"))), ",").alias("kept"), "n")


REASONS = {"ECONOMY": [("battery life", ["battery backup", "drain"]), ("camera quality", ["camera", "selfie"])], "STANDARD": [("display brightness", ["bright"]), ("heat", ["garam", "tawa", "heat"])]}


@query(
    f"""SELECT product_id, aspect, theme, reaction, CASE reaction WHEN 'positive' THEN 'Users mostly like ' || said || '.' WHEN 'negative' THEN 'Users mostly complain about ' || said || '.' WHEN 'mixed' THEN 'Users are split on ' || said || '.' WHEN 'neutral' THEN 'Users mention ' || said || ', but sentiment is mostly neutral.'
      ELSE CASE WHEN mentions <= 1 THEN {LABEL("aspect")} || ' has only one clear mention so far.' ELSE 'Users mention ' || said || ', but the sentiment direction is not clear yet.' END END AS one_liner FROM (SELECT *, coalesce(theme, lower(aspect)) AS said, {CARD} AS reaction FROM asp JOIN (SELECT product_id, aspect, CASE
      {" ".join(f"WHEN aspect = '{a}' AND ({' OR '.join(f"contains(t, '{w}')" for w in ws)}) THEN '{label}'" for a, rules in REASONS.items() for label, ws in rules)} END AS theme
      FROM (SELECT product_id, aspect, string_agg(lower(raw_text), ' ') AS t FROM (SELECT * FROM reviews QUALIFY row_number() OVER (PARTITION BY product_id, aspect ORDER BY intensity DESC, confidence DESC, review_date DESC, review_id, aspect) <= 12) GROUP BY product_id, aspect)) USING (product_id, aspect))""", RV, ASP,
)
def dom10_reason_themes(spark, sf_dir):
    r = ad.reviews(spark, sf_dir).withColumn("evidence", F.col("raw_text"))
    a = summary.aspect_summary(r).join(report.evidence_themes(r, REASONS, ["good", "mast", "slow"]), ["product_id", "aspect"])
    return report.reason_cards(a).select("product_id", "aspect", "theme", "reaction", "one_liner")


# --- SQL of queries of the catalogue that came without ------------------------------------------


def _sql(name: str, sql: str, *ctes: str) -> None:
    ORACLES[name] = (f"WITH {', '.join(ctes)} " if ctes else "") + sql


_sql("dom9_brief", "SELECT product_id, brief FROM brief", RV, SCORED, CARD4, ASP, PICKS, FORECAST, BRIEF)
_sql(
    "dom12_dom35_benchmark_summary",
    """SELECT CASE WHEN len(o) + len(t) + len(g) = 0 THEN 'Benchmark evidence is still thin.' ELSE 'Benchmark indicates that ' || array_to_string(list_filter([CASE WHEN len(o) > 0 THEN 'users prefer the selected product for ' || po END, CASE WHEN len(t) > 0 THEN 'users prefer the competitor for ' || pt END, CASE WHEN len(g) > 0 THEN pg || ' need more comparable evidence' END], lambda x: x IS NOT NULL), '; ') || '.' END AS headline,
    CASE WHEN len(o) > 0 THEN 'Users appear to prefer the selected product for ' || po || '.' ELSE 'No clear selected-product preference is visible yet.' END AS selected_product_summary, CASE WHEN len(t) > 0 THEN 'Users appear to prefer the competitor for ' || pt || '.' ELSE 'No clear competitor preference is visible yet.' END AS competitor_summary,
    CASE WHEN len(g) > 0 THEN pg || ' have evidence gaps, so they should not be read as confirmed wins or losses.' ELSE 'Read this benchmark as directional until more comparable reviews are available.' END AS risk_summary
    FROM (SELECT o, t, g, """
    + ", ".join(f"CASE WHEN len({x}) < 2 THEN array_to_string({x}, '') ELSE array_to_string({x}[:len({x}) - 1], ', ') || ' and ' || {x}[len({x})] END AS p{x}" for x in "otg")
    + " FROM (SELECT "
    + ", ".join(f"coalesce(list_sort(list({LABEL('aspect')}) FILTER ({c})), []) AS {x}" for x, c in (("o", "confidence_label NOT LIKE '%insufficient%' AND gap > 0"), ("t", "confidence_label NOT LIKE '%insufficient%' AND gap < 0"), ("g", "confidence_label LIKE '%insufficient%'")))
    + " FROM bl))", RV, BENCH,
)
_sql(
    "dom14_agg18_news_brief",
    f"""SELECT family, tag, n, place FROM (SELECT family, tag, count(*) AS n, CAST(row_number() OVER (PARTITION BY family ORDER BY count(*) DESC, tag) AS INT) AS place FROM (SELECT * FROM tags WHERE family <> 'tier'
    UNION ALL SELECT 'topic', unnest(list_filter([CASE WHEN ph > 0 THEN 'smartphone' END, CASE WHEN ai > 0 THEN 'ai' END, CASE WHEN mk > 0 THEN 'market' END, CASE WHEN oe > 0 THEN 'oem' END], lambda x: x IS NOT NULL))
      FROM (SELECT {_count_terms(news.SMARTPHONE)} AS ph, {_count_terms(news.AI)} AS ai, {_count_terms(news.MARKET)} AS mk, {_count_terms(news.MAKERS)} AS oe FROM n)) GROUP BY family, tag) WHERE place <= 8""", _NEWS, RELEVANCE, TAGS,
)
_sql(
    "src9_page_text",
    r"""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '<[^>]+>', ' ', 'g'),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS body FROM pages""",
)
_sql(
    "dom19_import_preview",
    """SELECT review_id, CASE WHEN raw_text = '' THEN 'raw_text is empty.' ELSE '' END AS errors, array_to_string(list_filter([CASE WHEN row_number() OVER (PARTITION BY review_id ORDER BY seq) > 1 THEN 'review_id is repeated.' END, CASE WHEN raw_text <> '' AND length(raw_text) < 8 THEN 'raw_text is very short.' END,
    'missing recommended: product_name, source, ' || CASE WHEN raw_text = '' THEN 'raw_text, verified_purchase, helpful_votes' ELSE 'verified_purchase, helpful_votes, brand' END], lambda x: x IS NOT NULL), ';') AS warnings FROM reviews""", RV,
)
_sql("dom20_clean_reviews", CLEANED, RV)
_sql(
    "sca31_sca35_identity",
    """SELECT p_partkey, brand, model_key, brand || '|' || model_key AS canonical_key, brand || '_' || model_key AS product_id, '8gb_ram_256gb_storage' AS variant FROM (SELECT p_partkey, ['tecno', 'infinix', 'redmi', 'samsung', 'iqoo'][p_partkey % 5 + 1] AS brand, ['pova_', 'note_', 'note_', 'galaxy_a', 'z_'][p_partkey % 5 + 1] || p_size || '_5g' AS model_key FROM part)""",
)
_sql(
    "joi15_joi16_joi17_resolution",
    """SELECT p_partkey, 'tecno_pova_' || p_size || '_pro' AS resolved_id, 'similarity' AS match_kind, round(2.0 * (14 + length(CAST(p_size AS VARCHAR))) / (31 + 2 * length(CAST(p_size AS VARCHAR))), 4)::DOUBLE AS match_score FROM part""",
)
