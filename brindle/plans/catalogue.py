"""The query catalogue: name -> query, and name -> equivalent DuckDB SQL. Names begin with the inventory id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.functions import aspects as asp
from brindle.functions import identity as idn
from brindle.functions import parse as pr
from brindle.functions import scores as sc
from brindle.functions import text as tf
from brindle.operators import compare, listing, mutate, news, quality, report, resolve, summary
from brindle.plans import adapter as ad
from brindle.sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *ctes: str):
    """Registers a query under its own name, with SQL over the given common table expressions."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (f"WITH {', '.join(ctes)} " if ctes else "") + sql
        return f

    return register


def M(x: str) -> str:
    return f"(CAST(sum(CAST({x} AS DECIMAL(18,6))) AS DOUBLE) / count({x}))"


def R(x: str, digits: int) -> str:
    k = float(10**digits)
    return f"(floor(({x}) * {k} + 0.5) / {k})"


N = lambda c: f"count(CASE WHEN {c} THEN 1 END)"
SIGNED = "CASE sentiment WHEN 'positive' THEN CAST(intensity AS DECIMAL(18,6)) WHEN 'negative' THEN -CAST(intensity AS DECIMAL(18,6)) ELSE CAST(0 AS DECIMAL(18,6)) END"
SCORE = R(f"CAST(sum({SIGNED}) AS DOUBLE) / count(*) * 100", 1)
RV, PD = ad.REVIEWS_SQL, ad.PRODUCTS_SQL
QUALITY = R("greatest(0.0, least(1.0, 0.35::DOUBLE + CASE WHEN verified_purchase THEN 0.15 ELSE 0.0 END::DOUBLE + CASE WHEN length(trim(raw_text)) >= 20 THEN 0.12 ELSE 0.0 END::DOUBLE + CASE WHEN helpful_votes > 0 THEN least(0.1::DOUBLE, helpful_votes / 100.0::DOUBLE) ELSE 0.0 END + 0.0::DOUBLE + CAST(confidence AS DOUBLE) * 0.18::DOUBLE + 0.62::DOUBLE * 0.08::DOUBLE - 0.0::DOUBLE))", 3)
SCORED = f"""scored AS (SELECT *, {QUALITY} AS quality_score,
  (rating >= 4 AND sentiment = 'negative') OR (rating <= 2 AND sentiment = 'positive') AS contradiction_flag, contains(lower(raw_text), 'wah wah') AS sarcasm_flag FROM reviews)"""
ASP = f"""asp AS (SELECT product_id, aspect, count(*) AS mentions, {N("sentiment = 'positive'")} AS positive_count, {N("sentiment = 'negative'")} AS negative_count, {N("sentiment = 'neutral'")} AS neutral_count,
  {R(M("confidence"), 3)} AS avg_confidence, {SCORE} AS aspect_score FROM reviews GROUP BY product_id, aspect)"""
THEMES = f"""g AS (SELECT product_id, aspect, sentiment, count(*) AS mentions, {R(M("intensity"), 3)} AS avg_intensity, {R(M("confidence"), 3)} AS avg_confidence FROM reviews GROUP BY ALL),
  th AS (SELECT *, {R("mentions * avg_intensity * avg_confidence * CASE WHEN sentiment = 'negative' THEN 1.25 ELSE 1.0 END::DOUBLE", 3)} AS severity FROM g)"""


def scored(spark, sf_dir):
    """Reviews with flags and quality as the rules give them for one aspect a review."""
    r = ad.reviews(spark, sf_dir)
    r = r.withColumn("contradiction_flag", sc.contradiction(F.col("rating"), F.array("sentiment"))).withColumn("sarcasm_flag", tf.sarcasm(F.col("raw_text")))
    return r.withColumn("quality_score", sc.quality(F.col("verified_purchase"), F.col("raw_text"), F.col("helpful_votes"), F.array().cast("array<string>"), F.col("confidence").cast("double"), F.lit(0.62)))


# --- aggregates --------------------------------------------------------------------------------


@query(f"SELECT product_id, count(*) AS review_count, {R(M('rating'), 2)} AS average_rating, {R(M('quality_score'), 3)} AS average_quality, {N('contradiction_flag')} AS contradictions, {N('sarcasm_flag')} AS sarcasm FROM scored GROUP BY product_id", RV, SCORED)
def agg1_product_summary(spark, sf_dir):
    return summary.product_summary(scored(spark, sf_dir))


@query(f"SELECT product_id, sentiment, count(*) AS n, {R(M('intensity'), 3)} AS avg_intensity FROM reviews GROUP BY product_id, sentiment", RV)
def agg2_sentiment_counts(spark, sf_dir):
    return summary.sentiment_counts(ad.reviews(spark, sf_dir))


@query(
    f"""SELECT product_id, {R("(sum(CASE WHEN sentiment = 'positive' THEN w ELSE 0 END) - sum(CASE WHEN sentiment = 'negative' THEN w ELSE 0 END)) / CAST(sum(n) AS DOUBLE) * 100", 1)} AS net_sentiment
    FROM (SELECT product_id, sentiment, n, CASE WHEN i = 0 THEN 0.5::DOUBLE ELSE i END * n AS w FROM (SELECT product_id, sentiment, count(*) AS n, {M("intensity")} AS i FROM reviews GROUP BY ALL)) GROUP BY product_id""", RV,
)
def agg3_net_sentiment(spark, sf_dir):
    return summary.net_sentiment(ad.reviews(spark, sf_dir))


@query("SELECT * FROM (SELECT product_id, aspect, count(*) AS mentions, CAST(row_number() OVER (PARTITION BY product_id ORDER BY count(*) DESC, aspect) AS INT) AS place FROM reviews GROUP BY product_id, aspect) WHERE place <= 5", RV)
def agg4_top_aspects(spark, sf_dir):
    return summary.top_aspects(ad.reviews(spark, sf_dir))


@query("SELECT * FROM asp", RV, ASP)
def agg5_aspect_summary(spark, sf_dir):
    return summary.aspect_summary(ad.reviews(spark, sf_dir))


@query(
    f"""SELECT product_id, CASE WHEN regexp_matches(lower(raw_text), 'front[ -]?cam|selfie') THEN 'camera_front' WHEN regexp_matches(lower(raw_text), 'night|low[ -]?light|dark(ness)?') THEN 'camera_night'
    WHEN regexp_matches(lower(raw_text), 'video|reel|recording') THEN 'camera_video' ELSE 'camera_overall' END AS sub_aspect, {SCORE} AS score, count(*) AS n FROM reviews GROUP BY 1, 2""", RV,
)
def agg6_sub_aspects(spark, sf_dir):
    return summary.sub_aspect_scores(ad.reviews(spark, sf_dir).withColumnRenamed("raw_text", "evidence"))


@query(
    """SELECT p.product_id, count(r.review_id) AS review_count, CAST(min(r.review_date) AS VARCHAR) AS first_date, CAST(max(r.review_date) AS VARCHAR) AS latest_date
    FROM products p LEFT JOIN (SELECT * FROM reviews WHERE helpful_votes = 1) r ON p.product_id = r.product_id GROUP BY p.product_id""", RV, PD,
)
def agg7_product_list(spark, sf_dir):
    r = ad.reviews(spark, sf_dir).withColumn("duplicate_status", F.when(F.col("helpful_votes") == 1, "canonical").otherwise("duplicate"))
    out = summary.product_list(ad.products(spark, sf_dir).select("product_id"), r)
    return out.withColumn("first_date", F.col("first_date").cast("string")).withColumn("latest_date", F.col("latest_date").cast("string"))


FEEDBACK = "fb AS (SELECT event_id AS id, user_id % 50 AS k, event_type AS provider, value > 10 AS is_correct FROM events)"


@query(
    f"""SELECT provider, count(*) AS total, {N("is_correct")} AS correct, {N("NOT is_correct")} AS incorrect, {R(N("is_correct") + " / CAST(count(*) AS DOUBLE)", 3)} AS accuracy
    FROM (SELECT * FROM fb QUALIFY row_number() OVER (PARTITION BY k, provider ORDER BY id DESC) = 1) GROUP BY provider""", FEEDBACK,
)
def agg8_provider_quality(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events")
    f = e.select(F.col("event_id").alias("id"), (F.col("user_id") % 50).cast("string").alias("review_id"), F.lit("p").alias("product_id"), F.lit("a").alias("aspect"), F.lit("s").alias("predicted_sentiment"), F.col("event_type").alias("provider"), (F.col("value") > 10).alias("is_correct"))
    return summary.provider_quality(f)


@query("SELECT status, count(*) AS n, count(DISTINCT source_key) AS sources FROM (SELECT source_key, CASE WHEN row_number() OVER (PARTITION BY source_key ORDER BY seq, review_id) = 1 THEN 'first' ELSE 'repeat' END AS status FROM reviews) GROUP BY status", RV)
def agg9_duplicate_summary(spark, sf_dir):
    r = ad.reviews(spark, sf_dir).select("source_key", "seq", "review_id")
    return summary.duplicate_counts(r, "source_key", "seq", "review_id")


_TABLES = ["customer", "documents", "events", "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in _TABLES))
def agg10_table_counts(spark, sf_dir):
    return summary.table_counts({t: ad.table(spark, sf_dir, t) for t in _TABLES})


@query("SELECT * FROM th", RV, THEMES)
def agg11_agg12_theme_severity(spark, sf_dir):
    return summary.theme_groups(ad.reviews(spark, sf_dir))


DAILY = f"""base AS (SELECT review_date, product_id, {R(M("rating"), 2)} AS avg_rating, count(*) AS reviews, {N("sentiment = 'positive'")} AS positive, {N("sentiment = 'negative'")} AS negative, {N("sentiment = 'neutral'")} AS neutral FROM reviews GROUP BY ALL),
  tops AS (SELECT review_date, product_id, sentiment, aspect FROM (SELECT review_date, product_id, sentiment, aspect, row_number() OVER (PARTITION BY review_date, product_id, sentiment ORDER BY count(*) DESC, aspect) AS k FROM reviews GROUP BY review_date, product_id, sentiment, aspect) WHERE k = 1)"""


@query(
    f"""SELECT CAST(b.review_date AS VARCHAR) AS review_date, b.product_id, avg_rating, reviews, positive, negative, neutral, {R("positive * 100.0::DOUBLE / greatest(positive + negative + neutral, 1)", 1)} AS positive_pct, {R("negative * 100.0::DOUBLE / greatest(positive + negative + neutral, 1)", 1)} AS negative_pct,
    c.aspect AS top_complaint, p.aspect AS top_praise FROM base b LEFT JOIN tops c ON b.review_date = c.review_date AND b.product_id = c.product_id AND c.sentiment = 'negative' LEFT JOIN tops p ON b.review_date = p.review_date AND b.product_id = p.product_id AND p.sentiment = 'positive'""", RV, DAILY,
)
def agg15_agg16_win2_joi20_daily_stats(spark, sf_dir):
    r = ad.reviews(spark, sf_dir)
    return summary.daily_stats(r, r).withColumn("review_date", F.col("review_date").cast("string"))


@query("SELECT product_id, string_agg(competitor_id, ', ' ORDER BY competitor_id) AS competitors FROM edges GROUP BY product_id", PD, "edges AS (SELECT DISTINCT product_id, trim(c) AS competitor_id FROM (SELECT product_id, unnest(string_split(replace(competitor_product_ids, ';', ','), ',')) AS c FROM products) WHERE trim(c) <> '' AND trim(c) <> product_id)")
def agg17_src5_competitor_lists(spark, sf_dir):
    return summary.competitor_lists(mutate.edges(ad.products(spark, sf_dir)))


@query("SELECT source, count(*) AS total, count(CASE WHEN review_date = DATE '1998-06-01' THEN 1 END) AS today FROM reviews GROUP BY source", RV)
def agg19_scrape_stats(spark, sf_dir):
    return summary.scrape_stats(ad.reviews(spark, sf_dir), "1998-06-01")


@query(
    f"""SELECT product_id, {", ".join(f"{N(f'rating = {k}')} AS r{k}" for k in range(1, 6))}, count(*) AS total FROM reviews GROUP BY product_id""", RV,
)
def agg25_rating_pivot(spark, sf_dir):
    r = ad.reviews(spark, sf_dir).select("product_id", F.concat(F.lit("r"), F.col("rating").cast("int").cast("string")).alias("k"))
    out = r.groupBy("product_id").pivot("k", [f"r{k}" for k in range(1, 6)]).count().na.fill(0)
    return out.withColumn("total", sum((F.col(f"r{k}") for k in range(1, 6)), F.lit(0).cast("long")))


@query(
    f"""SELECT phrase, count(*) AS n, {N("sentiment = 'positive'")} AS positive, {N("sentiment = 'negative'")} AS negative,
    CASE WHEN {N("sentiment = 'positive'")} > {N("sentiment = 'negative'")} THEN 'positive' WHEN {N("sentiment = 'negative'")} > {N("sentiment = 'positive'")} THEN 'negative' ELSE 'neutral' END AS dominant
    FROM (SELECT sentiment, trim(unnest(regexp_split_to_array(lower(raw_text), '[,;|]'))) AS phrase FROM reviews) WHERE length(phrase) > 3 AND length(phrase) < 60 GROUP BY phrase ORDER BY n DESC, phrase LIMIT 40""", RV,
)
def agg26_phrases(spark, sf_dir):
    return summary.phrases(ad.reviews(spark, sf_dir), "raw_text")


@query("SELECT product_id, sentiment, CAST(floor(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY product_id) + 0.5) AS BIGINT) AS pct FROM (SELECT product_id, sentiment, count(*) AS n FROM reviews GROUP BY ALL)", RV)
def agg27_sentiment_share(spark, sf_dir):
    return summary.sentiment_share(ad.reviews(spark, sf_dir))


@query("SELECT product_id, source, count(*) AS n FROM reviews GROUP BY ROLLUP (product_id, source)", RV)
def agg29_source_totals(spark, sf_dir):
    return summary.source_totals(ad.reviews(spark, sf_dir))


@query(
    """SELECT '' AS failed_checks, concat_ws(',', CASE WHEN few > 0 THEN 'low_volume_products' END, CASE WHEN n < 100 THEN 'low_review_volume' END, CASE WHEN d < 10 THEN 'thin_news' END) AS warnings,
    CASE WHEN few > 0 OR n < 100 OR d < 10 THEN 'ready_with_limitations' ELSE 'ready' END AS status
    FROM (SELECT (SELECT count(*) FROM reviews) AS n, (SELECT count(*) FROM documents) AS d, (SELECT count(*) FROM (SELECT product_id FROM reviews GROUP BY product_id HAVING count(*) < 30)) AS few)""", RV,
)
def agg30_readiness(spark, sf_dir):
    r = ad.reviews(spark, sf_dir)
    counts = summary.table_counts({"products": ad.products(spark, sf_dir), "reviews_raw": r, "reviews_processed": r, "aspect_sentiments": r, "living_lexicon": ad.table(spark, sf_dir, "region"), "news_items": ad.table(spark, sf_dir, "documents")})
    return quality.readiness(counts, r.groupBy("product_id").agg(F.count("*").alias("review_count")))


# --- filters, projections, orderings -----------------------------------------------------------


@query("SELECT review_id, product_id, CAST(review_date AS VARCHAR) AS review_date FROM reviews WHERE product_id = 'Brand#7' AND review_date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'", RV)
def fil1_fil2_period(spark, sf_dir):
    r = ad.reviews(spark, sf_dir).where(F.col("product_id") == "Brand#7")
    return summary.in_period(r, "1997-01-01", "1998-12-31").select("review_id", "product_id", F.col("review_date").cast("string").alias("review_date"))


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%widget%' OR lower(p_type) LIKE '%widget%' OR lower(p_brand) LIKE '%widget%'")
def fil4_lexicon_search(spark, sf_dir):
    p = ad.table(spark, sf_dir, "part")
    return listing.search(p, "widget", "p_name", "p_type", "p_brand").select("p_partkey", "p_name")


@query("SELECT product_id, count(*) AS n FROM reviews WHERE review_date >= DATE '2001-06-01' - INTERVAL 90 DAY AND review_date <= DATE '2001-06-01' GROUP BY product_id", RV)
def fil6_fil7_recency(spark, sf_dir):
    return listing.recent(ad.reviews(spark, sf_dir), "2001-06-01", 90).groupBy("product_id").agg(F.count("*").alias("n"))


@query("SELECT product_id, product_name, own_brand, row_number() OVER (ORDER BY own_brand DESC, product_name, product_id) AS place FROM products WHERE NOT contains(product_name, 'demo')", PD)
def fil8_fil9_srt10_products(spark, sf_dir):
    p = ad.products(spark, sf_dir).where(~F.contains("product_name", F.lit("demo")))  # a product per brand: few rows whatever the scale
    return p.select("product_id", "product_name", "own_brand", F.row_number().over(W.orderBy(F.desc("own_brand"), "product_name", "product_id")).cast("long").alias("place"))


@query("SELECT p_partkey FROM part WHERE (p_retailprice IS NULL OR p_retailprice BETWEEN 920 AND 960) AND (p_size IS NULL OR p_size >= 10)")
def fil10_price_band(spark, sf_dir):
    return listing.within(ad.table(spark, sf_dir, "part"), p_retailprice=(920, 960), p_size=(10, None)).select("p_partkey")


@query("SELECT page_id, host IN ('example.com', 'example.org') OR host LIKE '%.example.com' OR host LIKE '%.example.org' AS trusted FROM (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host FROM pages)")
def fil12_trusted_domain(spark, sf_dir):
    return ad.table(spark, sf_dir, "pages").select("page_id", news.trusted(F.col("url"), F.array(F.lit("example.com"), F.lit("example.org"))).alias("trusted"))


@query("SELECT review_id, aspect, sentiment, CAST(review_date AS VARCHAR) AS review_date, CASE WHEN n >= 3 THEN 'hinglish' WHEN n >= 1 THEN 'mixed' ELSE 'english' END AS language_type FROM (SELECT *, len(regexp_extract_all(lower(raw_text), '\\b(mast|bakwas|ekdum|nahi|nahin|hai|bahut|bhai)\\b')) AS n FROM reviews)", RV)
def prj1_sca12_evidence(spark, sf_dir):
    return ad.reviews(spark, sf_dir).select("review_id", "aspect", "sentiment", F.col("review_date").cast("string").alias("review_date"), tf.evidence_language(F.col("raw_text")).alias("language_type"))


_SPEC = ["product_name", "price", "size", "own_brand"]


@query(
    "SELECT coalesce(a.field, b.field) AS field, own, other, CASE WHEN lower(own) = lower(other) THEN 'tie' ELSE 'unknown' END AS winner FROM "
    + " FULL JOIN ".join("(" + " UNION ALL ".join(f"SELECT '{f}' AS field, CAST({f} AS VARCHAR) AS {tag} FROM products WHERE product_id = '{p}'" for f in _SPEC) + f") {x}" for x, tag, p in (("a", "own", "Brand#1"), ("b", "other", "Brand#7")))
    + " ON a.field = b.field", PD,
)
def prj2_spec_table(spark, sf_dir):
    return compare.spec_table(ad.products(spark, sf_dir), "Brand#1", "Brand#7", _SPEC)


@query("SELECT p_partkey, CASE WHEN v <= 15000 THEN '10000-15000' WHEN v <= 20000 THEN '15000-20000' WHEN v <= 25000 THEN '20000-25000' ELSE '25000-35000' END AS band, CASE WHEN v <= 15000 THEN 'Budget' WHEN v <= 20000 THEN 'Lower Mid-range' WHEN v <= 25000 THEN 'Mid-range' ELSE 'Upper Mid-range' END AS segment, CASE WHEN p_brand = 'Brand#1' THEN 'own' ELSE 'competitor' END AS ownership, replace(lower(p_name), ' ', '_') AS slug FROM (SELECT *, p_size * 700 AS v FROM part)")
def prj5_sca29_sca41_catalogue_record(spark, sf_dir):
    p = ad.table(spark, sf_dir, "part")
    band = sc.price_band(F.col("p_size") * 700)
    return p.select("p_partkey", band.alias("band"), sc.segment(band).alias("segment"), F.when(F.col("p_brand") == "Brand#1", "own").otherwise("competitor").alias("ownership"), pr.slug(F.col("p_name")).alias("slug"))


@query("SELECT review_id, aspect, quality_score, CAST(place AS INT) AS place FROM (SELECT review_id, aspect, quality_score, row_number() OVER (ORDER BY quality_score DESC, confidence DESC, review_date DESC, review_id, aspect) AS place FROM scored) WHERE place <= 50", RV, SCORED)
def srt1_evidence_top(spark, sf_dir):
    top = scored(spark, sf_dir).orderBy(F.desc("quality_score"), F.desc("confidence"), F.desc("review_date"), "review_id", "aspect").limit(50)
    place = F.row_number().over(W.orderBy(F.desc("quality_score"), F.desc("confidence"), F.desc("review_date"), "review_id", "aspect"))  # fifty rows
    return top.withColumn("place", place).select("review_id", "aspect", "quality_score", "place")


# --- joins and comparisons ---------------------------------------------------------------------


@query("SELECT o.o_orderstatus, count(*) AS n FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderstatus")
def joi1_joi2_inner(spark, sf_dir):
    li, o = ad.table(spark, sf_dir, "lineitem").select("l_orderkey"), ad.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return li.join(o, li.l_orderkey == o.o_orderkey).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority, p_brand, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def joi3_three_way(spark, sf_dir):
    li, o, p = (ad.table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    return li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey).groupBy("o_orderpriority", "p_brand").agg(F.count("*").alias("n"))


@query("SELECT e.product_id, e.competitor_id, p.product_name AS competitor_name FROM edges e LEFT JOIN products p ON e.competitor_id = p.product_id", PD, "edges AS (SELECT DISTINCT product_id, trim(c) AS competitor_id FROM (SELECT product_id, unnest(string_split(replace(competitor_product_ids, ';', ','), ',')) AS c FROM products) WHERE trim(c) <> '' AND trim(c) <> product_id)")
def joi4_ups5_competitors(spark, sf_dir):
    p = ad.products(spark, sf_dir)
    names = p.select(F.col("product_id").alias("competitor_id"), F.col("product_name").alias("competitor_name"))
    return mutate.edges(p).join(names, "competitor_id", "left").select("product_id", "competitor_id", "competitor_name")


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'O') ON c_custkey = o_custkey GROUP BY c_custkey")
def joi5_left_filtered(spark, sf_dir):
    o = ad.table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return ad.table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))


BENCH = f"""{ASP}, a AS (SELECT * FROM asp WHERE product_id = 'Brand#1'), b AS (SELECT * FROM asp WHERE product_id = 'Brand#2'),
 bm AS (SELECT coalesce(a.aspect, b.aspect) AS aspect, coalesce(a.mentions, 0) AS own_mentions, coalesce(a.aspect_score, 0) AS own_score, a.avg_confidence AS own_confidence, coalesce(b.mentions, 0) AS other_mentions, coalesce(b.aspect_score, 0) AS other_score, b.avg_confidence AS other_confidence FROM a FULL JOIN b ON a.aspect = b.aspect),
 bg AS (SELECT *, {R("own_score - other_score", 1)} AS gap, (coalesce(own_confidence, 0.0) + coalesce(other_confidence, 0.0)) / greatest(CAST(own_confidence IS NOT NULL AS INT) + CAST(other_confidence IS NOT NULL AS INT), 1) AS c FROM bm),
 bl AS (SELECT aspect, own_mentions, own_score, own_confidence, other_mentions, other_score, other_confidence, gap, CASE WHEN own_mentions = 0 OR other_mentions = 0 THEN 'insufficient_comparison' WHEN own_mentions + other_mentions >= 50 AND c >= 0.82 THEN 'high' WHEN own_mentions + other_mentions >= 10 AND c >= 0.7 THEN 'medium' ELSE 'low' END AS confidence_label FROM bg)"""


@query("SELECT *, CASE WHEN contains(confidence_label, 'insufficient') THEN 'evidence_gap' WHEN abs(gap) < 5 THEN 'near_parity' WHEN gap > 0 THEN 'selected_product_preferred' ELSE 'competitor_preferred' END AS signal FROM bl", RV, BENCH)
def joi7_dom6_benchmark(spark, sf_dir):
    return compare.benchmark(ad.reviews(spark, sf_dir), "Brand#1", "Brand#2").drop("interpretation")


@query("SELECT aspect, gap, kind, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY abs(gap) DESC, own_mentions + other_mentions DESC, aspect) AS place FROM (SELECT *, CASE WHEN gap > 0 THEN 'strength' ELSE 'weakness' END AS kind FROM bl WHERE own_mentions > 0 AND other_mentions > 0 AND gap <> 0)) WHERE place <= 3", RV, BENCH)
def srt2_strengths(spark, sf_dir):
    return compare.strengths(compare.benchmark(ad.reviews(spark, sf_dir), "Brand#1", "Brand#2")).select("aspect", "gap", "kind", "place")


@query("SELECT coalesce(c.k, s.k) AS k, coalesce(c.n, s.n) AS name, coalesce(c.f, false) OR coalesce(s.f, false) AS flag FROM (SELECT c_custkey AS k, c_name AS n, c_acctbal > 5000 AS f FROM customer) c FULL JOIN (SELECT s_suppkey * 3 AS k, s_name AS n, s_acctbal > 5000 AS f FROM supplier) s ON c.k = s.k")
def joi8_merge_entities(spark, sf_dir):
    c = ad.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), (F.col("c_acctbal") > 5000).alias("flag"))
    s = ad.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 3).alias("k"), F.col("s_name").alias("name"), (F.col("s_acctbal") > 5000).alias("flag"))
    return mutate.merge_entities(c, s, "k", ["flag"])


LABELS_ALL = "e AS (SELECT doc_id AS c, 'quality' AS a, CAST(quality AS VARCHAR) AS l FROM labels), p AS (SELECT doc_id AS c, CASE WHEN toxic = 1 THEN 'toxicity' ELSE 'quality' END AS a, '1' AS l FROM labels), m AS (SELECT coalesce(e.c, p.c) AS c, CASE WHEN p.l IS NULL THEN 'missed' WHEN e.l IS NULL THEN 'extra' WHEN e.l = p.l THEN 'exact' ELSE 'matched' END AS o FROM e FULL JOIN p ON e.c = p.c AND e.a = p.a)"


def _labels_all(spark, sf_dir):
    t = ad.table(spark, sf_dir, "labels")
    e = t.select("doc_id", F.lit("quality").alias("aspect"), F.col("quality").cast("string").alias("label"))
    p = t.select("doc_id", F.when(F.col("toxic") == 1, "toxicity").otherwise("quality").alias("aspect"), F.lit("1").alias("label"))
    return compare.label_match(e, p, "doc_id", "aspect")


@query("SELECT c AS doc_id, o AS outcome FROM m", LABELS_ALL)
def joi9_set1_set2_label_match_all(spark, sf_dir):
    return _labels_all(spark, sf_dir).select("doc_id", "outcome")


@query(
    f"""SELECT cases, expected, predicted, matched, {R("matched / CAST(expected AS DOUBLE)", 3)} AS recall, {R("exact / CAST(matched AS DOUBLE)", 3)} AS sentiment_accuracy, {R("(predicted - matched) / CAST(predicted AS DOUBLE)", 3)} AS over_extraction, {R("passed / CAST(cases AS DOUBLE)", 3)} AS exact_pass_rate
    FROM (SELECT count(*) AS cases, CAST(sum(e) AS BIGINT) AS expected, CAST(sum(p) AS BIGINT) AS predicted, CAST(sum(mm) AS BIGINT) AS matched, sum(x) AS exact, count(CASE WHEN e = x AND p = e THEN 1 END) AS passed
      FROM (SELECT c, {N("o IN ('missed', 'matched', 'exact')")} AS e, {N("o IN ('extra', 'matched', 'exact')")} AS p, {N("o IN ('matched', 'exact')")} AS mm, {N("o = 'exact'")} AS x FROM m GROUP BY c))""", LABELS_ALL,
)
def agg22_dom18_label_report_all(spark, sf_dir):
    return compare.label_report(_labels_all(spark, sf_dir), "doc_id")


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def joi10_win1_latest(spark, sf_dir):
    return summary.latest_by(ad.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], ["event_id"])


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def joi11_joi12_anti(spark, sf_dir):
    return mutate.unknown(ad.table(spark, sf_dir, "customer").select("c_custkey"), ad.table(spark, sf_dir, "orders"), "c_custkey", "o_custkey")


@query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS seen FROM customer")
def joi13_seen(spark, sf_dir):
    return mutate.with_seen(ad.table(spark, sf_dir, "customer").select("c_custkey"), ad.table(spark, sf_dir, "orders"), "c_custkey", "o_custkey")


FORECAST = f"""fc AS (SELECT product_id, aspect, {N("review_date >= DATE '1998-01-01'")} AS current_mentions, {N("review_date < DATE '1998-01-01'")} AS previous_mentions,
  {R(f"CAST(sum(CASE WHEN review_date >= DATE '1998-01-01' THEN {SIGNED} END) AS DOUBLE) * 100 / {N('''review_date >= DATE '1998-01-01' ''')}", 1)} AS current_score,
  CASE WHEN {N("review_date < DATE '1998-01-01'")} > 0 THEN {R(f"CAST(sum(CASE WHEN review_date < DATE '1998-01-01' THEN {SIGNED} END) AS DOUBLE) * 100 / nullif({N('''review_date < DATE '1998-01-01' ''')}, 0)", 1)} END AS previous_score, {M("confidence")} AS c
  FROM reviews WHERE review_date BETWEEN DATE '1998-01-01' - INTERVAL 31 DAY AND DATE '1998-01-31' GROUP BY ALL HAVING {N("review_date >= DATE '1998-01-01'")} > 0),
 fm AS (SELECT product_id, aspect, current_mentions, previous_mentions, current_score, previous_score, {R("current_score - previous_score", 1)} AS movement, c FROM fc),
 fd AS (SELECT product_id, aspect, current_mentions, previous_mentions, current_score, previous_score, movement, CASE WHEN movement IS NULL THEN CASE WHEN current_score >= 15 THEN 'likely_positive_but_unproven' WHEN current_score <= -15 THEN 'likely_negative_but_unproven' ELSE 'uncertain' END WHEN movement >= 8 THEN 'likely_improving' WHEN movement <= -8 THEN 'likely_declining' ELSE 'likely_stable' END AS direction,
  CASE WHEN current_mentions + previous_mentions >= 50 AND c >= 0.82 THEN 'high' WHEN current_mentions + previous_mentions >= 10 AND c >= 0.7 THEN 'medium' ELSE 'low' END AS confidence_label FROM fm)"""


@query("SELECT * FROM fd", RV, FORECAST)
def joi19_win8_dom8_forecast(spark, sf_dir):
    return compare.forecast(ad.reviews(spark, sf_dir), "1998-01-31", "1998-01-01")


@query(
    f"""SELECT product_id, CASE WHEN d > u THEN 'likely_declining' WHEN u > d THEN 'likely_improving' ELSE 'likely_stable_or_mixed' END AS direction, CASE WHEN h >= half THEN 'high' WHEN m + h >= half THEN 'medium' ELSE 'low' END AS confidence
    FROM (SELECT product_id, {N("contains(direction, 'improving')")} AS u, {N("contains(direction, 'declining')")} AS d, {N("confidence_label = 'high'")} AS h, {N("confidence_label = 'medium'")} AS m, greatest(1, count(*) // 2) AS half FROM fd GROUP BY product_id)""", RV, FORECAST,
)
def agg14_overall_direction(spark, sf_dir):
    return compare.overall_direction(compare.forecast(ad.reviews(spark, sf_dir), "1998-01-01", "1998-01-31"))


@query(
    """SELECT product_id, family, aspect, sentiment, severity, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY product_id, family ORDER BY severity DESC, mentions DESC, aspect, sentiment) AS place
    FROM (SELECT *, CASE sentiment WHEN 'negative' THEN 'complaint' WHEN 'positive' THEN 'delight' ELSE 'watchlist' END AS family FROM th UNION ALL SELECT *, 'watchlist' FROM th WHERE avg_confidence < 0.72 AND sentiment <> 'neutral')) WHERE place <= 5""", RV, THEMES,
)
def dom7_srt3_themes(spark, sf_dir):
    return summary.themes(ad.reviews(spark, sf_dir)).select("product_id", "family", "aspect", "sentiment", "severity", "place")


# --- windows -----------------------------------------------------------------------------------


@query("SELECT review_id, product_id FROM reviews QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY seq, review_id) <= 40", RV)
def win3_cap_per_product(spark, sf_dir):
    r = ad.reviews(spark, sf_dir).select("review_id", "product_id", "seq")
    return listing.capped(r, 40, "product_id", "seq", "review_id").select("review_id", "product_id")


_QUOTAS = {"5": 84, "4": 60, "3": 36, "2": 24, "1": 36}


@query(
    """SELECT review_id, product_id, rating FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY q DESC, seq, review_id) AS k FROM
    (SELECT review_id, product_id, CAST(CAST(rating AS INT) AS VARCHAR) AS rating, seq, row_number() OVER (PARTITION BY product_id, rating ORDER BY seq, review_id) <= CASE rating WHEN 5 THEN 84 WHEN 4 THEN 60 WHEN 3 THEN 36 WHEN 2 THEN 24 ELSE 36 END AS q FROM reviews)) WHERE q OR k <= 240""", RV,
)
def win4_win5_dom22_balanced_feed(spark, sf_dir):
    r = ad.reviews(spark, sf_dir).select("review_id", "product_id", F.col("rating").cast("int").cast("string").alias("rating"), "seq")
    return mutate.balanced(r, _QUOTAS, 240, [F.col("seq"), F.col("review_id")]).select("review_id", "product_id", "rating")


@query("SELECT product_id, aspect, review_id FROM reviews QUALIFY row_number() OVER (PARTITION BY product_id, aspect ORDER BY intensity DESC, confidence DESC, review_date DESC, review_id) <= 12", RV)
def win6_evidence_per_aspect(spark, sf_dir):
    return summary.evidence_top(ad.reviews(spark, sf_dir), 12, "product_id", "aspect").select("product_id", "aspect", "review_id")


@query("SELECT source_key, review_id FROM reviews QUALIFY row_number() OVER (PARTITION BY source_key ORDER BY seq, review_id) = 1", RV)
def win7_win9_first_seen(spark, sf_dir):
    return summary.first_by(ad.reviews(spark, sf_dir).select("source_key", "review_id", "seq"), ["source_key"], ["seq", "review_id"]).drop("seq")


# --- labels over numbers -----------------------------------------------------------------------


@query(
    """SELECT product_id, aspect, sentiment_label, bucket, CASE WHEN bucket IN ('high-volume-complaint', 'complaint-driver') THEN 'high' WHEN bucket IN ('watchlist-complaint', 'mixed-signal') THEN 'medium' WHEN bucket IN ('high-volume-delight', 'delight-driver') THEN 'positive' ELSE 'low' END AS level, mood, strength FROM (
    SELECT product_id, aspect, CASE WHEN mentions = 0 THEN 'no-signal' WHEN positive_count > 0 AND negative_count > 0 THEN CASE WHEN abs(aspect_score) < 25 THEN 'mixed' WHEN aspect_score > 0 THEN 'polarized-positive' ELSE 'polarized-negative' END WHEN aspect_score >= 25 THEN 'positive-heavy' WHEN aspect_score <= -25 THEN 'negative-heavy' WHEN neutral_count > 0 THEN 'neutral' ELSE 'mixed' END AS sentiment_label,
    CASE WHEN mentions < 2 THEN CASE WHEN aspect_score >= 25 THEN 'small-delight' WHEN aspect_score <= -25 THEN 'watchlist-complaint' ELSE 'thin-evidence' END WHEN negative_count > positive_count THEN CASE WHEN mentions >= 3 THEN 'high-volume-complaint' ELSE 'complaint-driver' END WHEN positive_count > negative_count THEN CASE WHEN mentions >= 3 THEN 'high-volume-delight' ELSE 'delight-driver' END ELSE 'mixed-signal' END AS bucket,
    CASE WHEN mentions = 0 THEN 'No Signal' WHEN positive_count > negative_count * 1.25 THEN 'Positive-Leaning' WHEN negative_count > positive_count * 1.25 THEN 'Negative-Leaning' ELSE 'Mixed' END AS mood, CASE WHEN mentions = 0 THEN 'No Evidence' WHEN mentions < 30 THEN 'Early Signal' WHEN mentions < 100 THEN 'Directional' WHEN mentions < 500 THEN 'Stronger Signal' ELSE 'High Confidence' END AS strength FROM asp)""", RV, ASP,
)
def sca21_sca22_dom32_labels(spark, sf_dir):
    a = summary.aspect_summary(ad.reviews(spark, sf_dir))
    p, n, z, s, m = (F.col(c) for c in ("positive_count", "negative_count", "neutral_count", "aspect_score", "mentions"))
    bucket = sc.priority_bucket(m, p, n, s)
    return a.select("product_id", "aspect", sc.sentiment_label(p, n, z, s).alias("sentiment_label"), bucket.alias("bucket"), sc.priority_level(bucket).alias("level"), sc.mood_balance(p, n, z).alias("mood"), sc.evidence_strength(m).alias("strength"))


@query("SELECT review_id, contradiction_flag, sarcasm_flag, quality_score FROM scored", RV, SCORED)
def sca14_sca15_sca16_flags_and_quality(spark, sf_dir):
    return scored(spark, sf_dir).select("review_id", "contradiction_flag", "sarcasm_flag", "quality_score")


@query(
    f"""SELECT review_id, aspect, reason, {R("p", 3)} AS priority_score FROM (
    SELECT review_id, aspect, 'low_confidence_extraction' AS reason, 80 + (1 - CAST(confidence AS DOUBLE)) * 20 AS p FROM scored WHERE confidence < 0.72
    UNION ALL SELECT review_id, aspect, 'low_quality_review_signal', 70 + (1 - quality_score) * 20 FROM scored WHERE quality_score < 0.75
    UNION ALL SELECT review_id, aspect, 'high_intensity_complaint', 75 + CAST(intensity AS DOUBLE) * 10 FROM scored WHERE sentiment = 'negative' AND intensity >= 0.8
    UNION ALL SELECT review_id, aspect, 'rating_text_contradiction_candidate', 85.0 FROM scored WHERE contradiction_flag)""", RV, SCORED,
)
def dom16_agg24_queue(spark, sf_dir):
    return quality.queue_candidates(scored(spark, sf_dir)).select("review_id", "aspect", "reason", "priority_score")


# --- keys, dedup, upserts ----------------------------------------------------------------------

KEYED = """keyed AS (SELECT *, sha256(trim(regexp_replace(regexp_replace(trim(lower(raw_text)), '\\s+', ' ', 'g'), '[^a-z0-9ऀ-ॿ ]+', '', 'g'))) AS text_hash FROM reviews)"""


@query("SELECT review_id, text_hash AS normalized_text_hash, sha256(concat_ws('|', source, product_id, source_key)) AS source_review_key FROM keyed", RV, KEYED)
def sca5_sca6_review_keys(spark, sf_dir):
    return _keyed(spark, sf_dir).select("review_id", "normalized_text_hash", "source_review_key")


def _keyed(spark, sf_dir):
    r = ad.reviews(spark, sf_dir).withColumnsRenamed({"source_key": "marketplace_review_id"})
    return mutate.review_keys(r.withColumn("marketplace", F.col("source")).withColumn("marketplace_product_id", F.lit(None).cast("string")).withColumn("reviewer_hash", F.lit(None).cast("string")))


@query("SELECT review_id, sha256(concat_ws('|', product_id, source, CAST(review_date AS VARCHAR), lower(substr(raw_text, 1, 80)))) AS review_hash FROM reviews", RV)
def sca7_scrape_hash(spark, sf_dir):
    from brindle.streaming.incremental import scrape_hash

    return scrape_hash(ad.reviews(spark, sf_dir)).select("review_id", "review_hash")


@query(
    """SELECT review_id, status, canonical_id FROM (
     SELECT review_id, nth, first_value(review_id) OVER (PARTITION BY product_id, text_hash, rating ORDER BY nth > 1, seq, review_id) AS lead_id, CASE WHEN nth > 1 THEN 'touch' END AS t,
       CASE WHEN nth > 1 THEN 'touch' WHEN lead_id <> review_id THEN 'attach' ELSE 'insert' END AS status, lead_id AS canonical_id
     FROM (SELECT *, row_number() OVER (PARTITION BY source, product_id, source_key ORDER BY seq, review_id) AS nth FROM keyed))
     """, RV, KEYED,
)
def joi14_ups2_ingest(spark, sf_dir):
    k = _keyed(spark, sf_dir)
    seq = F.row_number().over(W.partitionBy("source_review_key").orderBy("seq", "review_id"))  # ties of seq by id
    k = k.withColumn("seq", F.struct("seq", "review_id")).withColumn("tie", seq)
    return mutate.ingest(k).select("review_id", "status", "canonical_id")


# The keys of customers are shifted so that some suppliers have none
@query("SELECT coalesce(i.k, s.k) AS k, coalesce(i.n, s.n) AS name, coalesce(i.b, s.b) AS balance FROM (SELECT s_suppkey AS k, s_name AS n, s_acctbal AS b FROM supplier) s FULL JOIN (SELECT c_custkey + 5 AS k, CASE WHEN c_acctbal > 0 THEN c_name END AS n, c_acctbal AS b FROM customer) i ON s.k = i.k")
def ups4_upsert_keep_all(spark, sf_dir):
    return mutate.upsert(*_upsert_all(spark, sf_dir), ["k"], keep_stored=True)


@query("SELECT coalesce(i.k, s.k) AS k, CASE WHEN i.k IS NOT NULL THEN i.n ELSE s.n END AS name, coalesce(i.b, s.b) AS balance FROM (SELECT s_suppkey AS k, s_name AS n, s_acctbal AS b FROM supplier) s FULL JOIN (SELECT c_custkey + 5 AS k, CASE WHEN c_acctbal > 0 THEN c_name END AS n, c_acctbal AS b FROM customer) i ON s.k = i.k")
def ups6_upsert_overwrite_all(spark, sf_dir):
    return mutate.upsert(*_upsert_all(spark, sf_dir), ["k"], keep_stored=False)


def _upsert_all(spark, sf_dir):
    s = ad.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    c = ad.table(spark, sf_dir, "customer")
    return s, c.select((F.col("c_custkey") + 5).alias("k"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("name"), F.col("c_acctbal").alias("balance"))


@query("SELECT user_id, event_type, value FROM events WHERE event_id < 500 UNION ALL SELECT user_id, event_type, value FROM (SELECT * FROM events WHERE event_id >= 500 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1) n WHERE NOT EXISTS (SELECT 1 FROM events o WHERE o.event_id < 500 AND o.user_id = n.user_id AND o.event_type = n.event_type)")
def ups1_ups8_ups10_ups12_insert_or_ignore(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id")
    return mutate.insert_new(e.where("event_id < 500"), e.where("event_id >= 500"), ["user_id", "event_type"], ["event_id"]).drop("event_id")


@query("SELECT user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def ups7_ups14_last_write_wins(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id")
    return mutate.last_write_wins(e.where("event_id < 500"), e.where("event_id >= 500"), ["user_id", "event_type"], ["event_id"]).drop("event_id")


@query("SELECT user_id, count(*) AS times_seen, min(event_id) AS first_seen, max(event_id) AS last_seen, arg_max(v, event_id) AS v FROM (SELECT user_id, event_id, CASE WHEN value > 10 THEN value END AS v FROM events) GROUP BY user_id")
def ups3_provenance(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("value") > 10, F.col("value")).alias("v"))
    return mutate.provenance(e, ["user_id"], "event_id")


# --- text --------------------------------------------------------------------------------------


@query("SELECT doc_id, CASE WHEN n > 0 THEN 'hi_en_mixed' ELSE 'en_or_unknown' END AS primary_language, CASE WHEN n > 0 THEN 'roman' ELSE 'latin' END AS script, CASE WHEN n > 0 THEN least(95, 62 + 4 * n) / 100.0::DOUBLE ELSE 0.62 END AS confidence FROM (SELECT review_id AS doc_id, len(list_intersect(list_distinct(list_transform(regexp_extract_all(raw_text, '[A-Za-z]+'), lambda x: lower(x))), ['hai','nahi','bahut','ekdum','mast','bekar','bakwas','paisa','vasool','garam','jaldi','khatam','theek','acha','bura','bhai'])) AS n FROM reviews)", RV)
def sca11_language_profile(spark, sf_dir):
    r = ad.reviews(spark, sf_dir).select(F.col("review_id").alias("doc_id"), tf.language_profile(F.col("raw_text")).alias("p"))
    return r.select("doc_id", "p.primary_language", "p.script", "p.confidence")


SIGNALS = """SELECT review_id, CASE WHEN s = '' THEN 'unclear' ELSE s END AS signals FROM (SELECT review_id, concat_ws(',', CASE WHEN g AND regexp_matches(t, 'delivery|courier') THEN 'delivery' END, CASE WHEN g AND regexp_matches(t, 'packag|box') THEN 'packaging' END,
  CASE WHEN regexp_matches(t, 'camera|battery|backup|heating|garam|display|performance|lag|charging|camra|kamera|baatri|battri') THEN 'product' END, CASE WHEN g AND contains(t, 'seller') THEN 'seller' END, CASE WHEN g AND regexp_matches(t, 'return|refund|warranty|service') THEN 'service' END) AS s
  FROM (SELECT review_id, lower(raw_text) AS t, regexp_matches(lower(raw_text), 'delivery|packaging|seller|return|refund') AS g FROM reviews))"""


@query(SIGNALS, RV)
def sca13_signal_types(spark, sf_dir):
    return ad.reviews(spark, sf_dir).select("review_id", F.array_join(tf.signal_types(F.col("raw_text")), ",").alias("signals"))


# What each sentence of the adapter says, worked out by hand from the rules: (sentence, aspect, sentiment)
SAID = [(0, "battery", "negative"), (0, "camera", "positive"), (1, "heating", "negative"), (2, "camera", "positive"), (2, "display", "positive"), (3, "battery", "negative"), (3, "charging", "negative"), (4, "display", "positive"), (6, "performance", "positive"), (7, "software", "negative"), (8, "design", "positive"), (9, "battery", "negative"), (9, "heating", "negative"), (10, "audio", "positive"), (11, "connectivity", "negative")]


@query("SELECT review_id, aspect, said.sentiment FROM (SELECT review_id, raw_text FROM reviews) r JOIN (VALUES " + ", ".join(f"('{ad.SENTENCES[k]}', '{a}', '{m}')" for k, a, m in SAID) + ") said(raw_text, aspect, sentiment) ON r.raw_text = said.raw_text", RV)
def dom1_aspect_extraction(spark, sf_dir):
    r = ad.spread(ad.reviews(spark, sf_dir).select("review_id", tf.normalise_spelling(tf.clean(F.col("raw_text"))).alias("clean_text")))
    return asp.with_aspects(r, "clean_text").select("review_id", F.inline_outer("aspects")).where("aspect is not null").select("review_id", "aspect", "sentiment")


@query(None)
def dom2_dom3_review_analysis(spark, sf_dir):
    a = quality.needs_review(quality.analyse(ad.spread(ad.reviews(spark, sf_dir).select("review_id", "product_id", "raw_text", "rating", "verified_purchase", "helpful_votes"))))
    return a.select("review_id", "clean_text", "language_profile.primary_language", F.array_join("signal_types", ",").alias("signals"), F.size("aspects").alias("n_aspects"), "contradiction_flag", "sarcasm_flag", "quality_score", "route_reason")


@query("SELECT doc_id, regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g') = text AS clean_already, length(text) AS n, regexp_matches(lower(text), '(^|[^a-z0-9])the($|[^a-z0-9])') AS has_the FROM documents")
def sca3_joi18_term_presence(spark, sf_dir):
    d = ad.table(spark, sf_dir, "documents")
    t = F.col("text")
    same = F.regexp_replace(F.regexp_replace(t, "<[^>]+>", " "), r"\s+", " ") == t
    return d.select("doc_id", same.alias("clean_already"), F.char_length(t).cast("long").alias("n"), F.lower(t).rlike("(?<![a-z0-9])the(?![a-z0-9])").alias("has_the"))


@query(
    """SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CASE WHEN contains(url, 'example.com') THEN 'com' WHEN contains(url, 'example.org') THEN 'org' ELSE 'other' END AS shop FROM pages"""
)
def src13_page_titles(spark, sf_dir):
    u = F.col("url")
    return ad.table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.when(F.contains(u, F.lit("example.com")), "com").when(F.contains(u, F.lit("example.org")), "org").otherwise("other").alias("shop"))


@query(None)
def src9_page_text(spark, sf_dir):
    return ad.table(spark, sf_dir, "pages").select("page_id", readers.page_text().alias("p")).select("page_id", "p.*")


_NEWS = "n AS (SELECT page_id, lower(regexp_extract(html, '<title>([^<]*)</title>', 1) || ' ' || url) AS t FROM pages)"


def _count_terms(terms):
    return " + ".join(f"CAST(contains(t, '{x}') AS INT)" for x in terms)


@query(
    f"""SELECT page_id, CAST(least(100, total) AS DOUBLE) AS relevance_score, CASE WHEN total >= 70 THEN 'high' WHEN total >= 35 THEN 'medium' ELSE 'low' END AS priority_label FROM (
    SELECT page_id, 7 * ph + 10 * ai + 5 * mk + 8 * oe + 12 * te + 7 * re + CASE WHEN hai AND ph > 0 THEN 18 ELSE 0 END + CASE WHEN chip AND (hai OR ph > 0) THEN 15 ELSE 0 END + CASE WHEN oe > 0 THEN 10 ELSE 0 END + CASE WHEN re > 0 THEN 8 ELSE 0 END AS total
    FROM (SELECT *, ai > 0 OR te_ai AS hai FROM (SELECT page_id, {_count_terms(news.SMARTPHONE)} AS ph, {_count_terms(news.AI)} AS ai, {_count_terms(news.MARKET)} AS mk, {_count_terms(news.MAKERS)} AS oe, {_count_terms(news.TECH)} AS te, {_count_terms(news.REGIONS)} AS re,
      {" OR ".join(f"contains(t, '{x}')" for x in news.CHIPS)} AS chip, {" OR ".join(f"contains(t, '{x}')" for x in news.TECH if "ai" in x)} AS te_ai FROM n)))""", _NEWS,
)
def dom13_news_scores(spark, sf_dir):
    return _news(spark, sf_dir).select("page_id", "relevance_score", "priority_label")


def _news(spark, sf_dir):
    p = ad.table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.col("url").alias("summary"), F.array().cast("array<string>").alias("default_tags"))
    return news.classify(p)


@query(None)
def dom14_agg18_news_brief(spark, sf_dir):
    return news.brief(_news(spark, sf_dir))


@query(None)
def sca31_sca35_identity(spark, sf_dir):
    p = ad.table(spark, sf_dir, "part")
    makers = F.element_at(F.array(*map(F.lit, ["Tecno Pova", "Infinix Note", "RedmiNote", "Samsung Galaxy A", "iqoo Z"])), (F.col("p_partkey") % 5 + 1).cast("int"))
    full = F.concat(makers, F.col("p_size").cast("string"), F.lit(" 5 G (8GB 256 GB, black)"))
    return idn.with_identity(p.select("p_partkey", full.alias("n"), F.lit(None).cast("string").alias("b")), "n", "b").select("p_partkey", "identity.*")


@query(None)
def joi15_joi16_joi17_resolution(spark, sf_dir):
    p = ad.table(spark, sf_dir, "part").select(F.concat(F.lit("Tecno Pova "), F.col("p_size").cast("string"), F.lit(" Pro")).alias("product_name"), F.lit("tecno").alias("brand")).distinct()
    cat = p.select(F.regexp_replace(F.lower("product_name"), " ", "_").alias("product_id"), "product_name", "brand")
    r = ad.table(spark, sf_dir, "part").select("p_partkey", F.lit(None).cast("string").alias("product_id"), F.concat(F.lit("TecnoPova"), F.col("p_size").cast("string"), F.lit(" Pr0")).alias("product_name"), F.lit("tecno").alias("brand"))
    return resolve.resolve(r, cat).select("p_partkey", "resolved_id", "match_kind", "match_score")


@query(
    f"""SELECT doc_id, CASE WHEN src IS NULL THEN 'missing_source_url' WHEN text = '' THEN 'missing_raw_text' ELSE 'present' END AS state, {N("true")} OVER (PARTITION BY text) > 1 AS repeated FROM (SELECT doc_id, source AS src, text FROM documents)"""
)
def sca47_sca49_presence(spark, sf_dir):
    d = ad.table(spark, sf_dir, "documents")
    n = d.groupBy(F.xxhash64("text").alias("h"), "text").count().select(F.col("text").alias("t"), "count")
    state = F.when(F.col("source").isNull(), "missing_source_url").when(F.col("text") == "", "missing_raw_text").otherwise("present")
    return d.join(n, d.text == n.t).select("doc_id", state.alias("state"), (F.col("count") > 1).alias("repeated"))


@query(None)
def dom20_clean_reviews(spark, sf_dir):
    r = ad.reviews(spark, sf_dir).select("review_id", "product_id", F.col("name").alias("product_name"), F.concat(F.lit("http://"), "source").alias("source_url"), "raw_text", F.col("source").alias("marketplace"), F.struct("seq", "review_id").alias("seq"))
    return quality.clean_reviews(r).select("review_id", "status")


@query(None)
def dom19_import_preview(spark, sf_dir):
    r = ad.reviews(spark, sf_dir).select("review_id", "product_id", "raw_text", F.col("rating").cast("string").alias("rating"), F.col("review_date").cast("string").alias("review_date"), F.struct("seq", "review_id").alias("row_number"))
    return quality.preview(r).select("review_id", F.array_join("errors", ";").alias("errors"), F.array_join("warnings", ";").alias("warnings"))


# --- reports -----------------------------------------------------------------------------------

PICKS = """picks AS (SELECT product_id, pick, aspect FROM (
  SELECT product_id, 'strongest_positive' AS pick, aspect, row_number() OVER (PARTITION BY product_id ORDER BY positive_count DESC, mentions DESC, aspect_score DESC, aspect) AS k FROM asp WHERE positive_count > negative_count
  UNION ALL SELECT product_id, 'strongest_negative', aspect, row_number() OVER (PARTITION BY product_id ORDER BY negative_count DESC, mentions DESC, abs(aspect_score) DESC, aspect) FROM asp WHERE negative_count > positive_count
  UNION ALL SELECT product_id, 'polarized', aspect, row_number() OVER (PARTITION BY product_id ORDER BY mentions DESC, aspect) FROM asp WHERE positive_count > 0 AND negative_count > 0) WHERE k = 1)"""


@query("SELECT * FROM picks", RV, ASP, PICKS)
def srt11_dom33_aspect_picks(spark, sf_dir):
    return report.aspect_picks(summary.aspect_summary(ad.reviews(spark, sf_dir)))


@query(
    f"""SELECT product_id, card, value, CASE card WHEN 'review_count' THEN CASE WHEN n < 30 THEN 'low_volume' ELSE 'stronger_volume' END END AS status FROM (
    SELECT product_id, 'review_count' AS card, CAST(count(*) AS DOUBLE) AS value, count(*) AS n FROM reviews GROUP BY product_id UNION ALL SELECT product_id, 'average_rating', {R(M("rating"), 2)}, 0 FROM reviews GROUP BY product_id)""", RV,
)
def dom30_kpi_cards(spark, sf_dir):
    cards = report.kpi_cards(summary.product_summary(scored(spark, sf_dir)), summary.net_sentiment(ad.reviews(spark, sf_dir)))
    return cards.where(F.col("card").isin("review_count", "average_rating"))


@query(
    """SELECT product_id, tile, status FROM (SELECT product_id, (SELECT count(*) FROM reviews r WHERE r.product_id = p.product_id) AS n, EXISTS (SELECT 1 FROM picks k WHERE k.product_id = p.product_id AND pick = 'strongest_positive') AS g, EXISTS (SELECT 1 FROM picks k WHERE k.product_id = p.product_id AND pick = 'strongest_negative') AS b FROM (SELECT DISTINCT product_id FROM reviews) p)
    CROSS JOIN LATERAL (VALUES ('customer_signal', CASE WHEN g THEN 'active' ELSE 'thin_evidence' END), ('risk_signal', CASE WHEN b THEN 'active' ELSE 'thin_evidence' END), ('evidence_volume', CASE WHEN n < 30 THEN 'low_volume' ELSE 'usable' END), ('benchmark_mode', 'product_only'), ('market_context', 'active')) t(tile, status)""", RV, ASP, PICKS,
)
def dom29_workflow_tiles(spark, sf_dir):
    r = ad.reviews(spark, sf_dir)
    return report.tiles(r.groupBy("product_id").agg(F.count("*").alias("review_count")), report.aspect_picks(summary.aspect_summary(r)), None, 1)


CARD = "CASE WHEN positive_count > negative_count AND positive_count >= neutral_count THEN 'positive' WHEN negative_count > positive_count AND negative_count >= neutral_count THEN 'negative' WHEN neutral_count > positive_count AND neutral_count > negative_count THEN 'neutral' WHEN positive_count > 0 AND negative_count > 0 THEN 'mixed' ELSE 'unclear' END"


@query(
    f"""SELECT product_id, aspect, reaction, CASE reaction WHEN 'positive' THEN 'Users mostly like ' || t || '.' WHEN 'negative' THEN 'Users mostly complain about ' || t || '.' WHEN 'mixed' THEN 'Users are split on ' || t || '.' WHEN 'neutral' THEN 'Users mention ' || t || ', but sentiment is mostly neutral.'
    ELSE CASE WHEN mentions <= 1 THEN upper(aspect[1]) || substr(t, 2) || ' has only one clear mention so far.' ELSE 'Users mention ' || t || ', but the sentiment direction is not clear yet.' END END AS one_liner,
    CASE WHEN mentions < 3 THEN 'early' WHEN mentions < 10 THEN 'directional' ELSE 'stronger' END AS reason_confidence FROM (SELECT *, {CARD} AS reaction, lower(aspect) AS t FROM asp)""", RV, ASP,
)
def dom10_reason_cards(spark, sf_dir):
    a = summary.aspect_summary(ad.reviews(spark, sf_dir))
    return report.reason_cards(a).select("product_id", "aspect", "reaction", "one_liner", "reason_confidence")


@query(None)
def dom12_dom35_benchmark_summary(spark, sf_dir):
    return report.benchmark_summary(compare.benchmark(ad.reviews(spark, sf_dir), "Brand#1", "Brand#2"))


@query(None)
def dom9_brief(spark, sf_dir):
    r = ad.reviews(spark, sf_dir)
    overall = compare.overall_direction(compare.forecast(r, "1998-01-01", "1998-01-31"))
    return report.brief(summary.product_summary(scored(spark, sf_dir)), summary.net_sentiment(r), report.aspect_picks(summary.aspect_summary(r)), overall)


@query("SELECT task, arg_min(provider_id, place) AS selected, coalesce(string_agg(CASE WHEN k > 1 THEN provider_id END, ',' ORDER BY place), '') AS fallbacks FROM (SELECT 'task' || n_regionkey AS task, n_name AS provider_id, n_nationkey AS place, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation WHERE n_nationkey % 3 <> 0) GROUP BY task")
def dom26_router(spark, sf_dir):
    n = ad.table(spark, sf_dir, "nation")
    return report.route(n.select(F.concat(F.lit("task"), F.col("n_regionkey").cast("string")).alias("task"), F.col("n_name").alias("provider_id"), F.col("n_nationkey").alias("place"), (F.col("n_nationkey") % 3 != 0).alias("enabled")))
