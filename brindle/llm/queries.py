"""The thin queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers

from brindle.llm import langid, licenses, media, neardup, packing, pieces, setjoin, suffixes, toxicity, warc

QUERIES: dict = {}
ORACLES: dict = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_language_id(spark, sf_dir):
    return langid.identify(spark, _table(spark, sf_dir, "documents"))


@_query
def op2_best_fit_packing(spark, sf_dir):
    special = packing.special_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(spark, _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, special)


@_query
def op3_media(spark, sf_dir):
    return media.store_and_read(spark, _table(spark, sf_dir, "documents"))


@_query
def op4_license_scan(spark, sf_dir):
    return licenses.scan(_table(spark, sf_dir, "documents"))


@_query
def op5_warc_derivatives(spark, sf_dir):
    return warc.derive(warc.responses(_table(spark, sf_dir, "pages")), "page_id")


@_query
def op6_toxicity(spark, sf_dir):
    return toxicity.judge(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op7_suffix_array_dedup(spark, sf_dir):
    return suffixes.spans(spark, _table(spark, sf_dir, "documents"))


@_query
def op8_sentencepiece(spark, sf_dir):
    return pieces.digests(spark, _table(spark, sf_dir, "documents"), public_tokenizers.path(pieces.MODEL))


@_query
def op9_ngram_jaccard_join(spark, sf_dir):
    return setjoin.components(spark, _table(spark, sf_dir, "documents"), words=4, num=85, den=100)


ORACLES["op9_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], chr(32)) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT node AS doc_id, min(seen) AS component_id FROM r GROUP BY node) c USING (doc_id)
"""


@_query
def op10_embedding_near_duplicates(spark, sf_dir):
    return neardup.near_duplicates(spark, _table(spark, sf_dir, "embeddings"))


ORACLES["op10_embedding_near_duplicates"] = """
WITH RECURSIVE u AS (
  SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS l FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL)
  WHERE len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_dot_product(x, x) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_dot_product(a.x, b.x) / (a.l * b.l) >= 0.95),
r AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a)
SELECT d.vec_id, coalesce(k.n, 0) AS n_links, c.m AS component_id, d.vec_id = c.m AS kept
FROM embeddings d LEFT JOIN (SELECT a, count(*) AS n FROM e GROUP BY a) k ON k.a = d.vec_id
JOIN (SELECT node, min(seen) AS m FROM r GROUP BY node) c ON c.node = d.vec_id
"""

ORACLES["op7_suffix_array_dedup"] = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, i - 1 AS p, md5(array_to_string(w[i : i + 49], chr(32))) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
o AS (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) > 1 AS is_copy, count(*) OVER (PARTITION BY h) AS n FROM g),
m AS (SELECT *, lag(p) OVER (PARTITION BY doc_id, is_copy ORDER BY p) AS q FROM o WHERE n > 1),
s AS (SELECT *, sum(CASE WHEN q IS NULL OR p > q + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, is_copy ORDER BY p) AS k FROM m)
SELECT doc_id, min(p) AS first_word, max(p) + 50 AS end_word, is_copy FROM s GROUP BY doc_id, is_copy, k
"""
