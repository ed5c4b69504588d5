"""The pipeline's stages in a row, each against plain loops over its own input, and its query against the stages run by hand."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
from test_operators import brute_components, brute_spans
from tokenizers import Tokenizer

import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs.count()
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns, name
        assert out.count() <= kept
        kept, docs = out.count(), out
    packed = cp.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert 4 <= len(cp.STAGES) <= 5
    again = cp.run(spark, SF)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, again.select(key).collect())) == sorted(map(tuple, packed.select(key).collect()))


def test_stages_by_plain_loops(spark):
    """Near-duplicates, repeated passages and packing over what each gets; the other two by what they may drop."""
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    long = " ".join(f"w{k}" for k in range(80))
    near = " ".join(f"w{k}" if k != 40 else "other" for k in range(80))
    rows += [(9001, long, "en", "s", 1), (9001, long, "en", "s", 1), (9002, near, "en", "s", 1), (9003, "lead " + " ".join(f"w{k}" for k in range(55)) + " and then a tail of its own " * 6, "en", "s", 1), (9004, None, None, None, None), (9005, "", "en", "s", 0), (None, "a text without an id", "en", "s", 2)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    kept = cp.near_duplicates(spark, docs, SF).collect()
    texts = {r[0]: r[1] or "" for r in rows if r[0] is not None}
    low = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    split = lambda t: [w for w in re.split(r"[\x20\x09-\x0d]+", t) if w]
    words = {i: split(low(t)) for i, t in texts.items()}
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))} if w else set() for i, w in words.items()}
    want = brute_components(sets, 80, 100)
    assert Counter(r.doc_id for r in kept) == Counter(r[0] for r in rows if r[0] is None or want[r[0]] == r[0])
    cut = cp.repeated_passages(spark, spark.createDataFrame(kept, docs.schema), SF).collect()
    once, gone = {}, brute_spans([(r.doc_id, low(r.text)) for r in {(r.doc_id, r.text): r for r in kept}.values() if r.doc_id is not None], 50)[True]
    for r in cut:
        once.setdefault(r.doc_id, []).append(split(r.text or ""))
    for i, lists in once.items():
        if i is not None:
            left = [w for q, w in enumerate(split(texts[i])) if (i, q) not in gone]
            assert left in lists and all(x in (left, []) for x in lists), i
    tok, have = Tokenizer.from_file(P.path("byte_bpe_50k.json")), Counter()
    packed = cp.packed_sequences(spark, spark.createDataFrame(cut, docs.schema), SF).toPandas()
    for r in packed.itertuples():
        have[None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.length, r.ids_crc32] += 1
    ids = [(r.doc_id, [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in cut]
    plain = Counter()
    for i, x in ids:
        cuts = [0, *range(len(x) % 1024 or min(len(x), 1024), len(x) + 1, 1024)]
        plain.update((i, p, z - a, zlib.crc32(np.array(x[a:z], "<u4").tobytes())) for p, (a, z) in enumerate(zip(cuts, cuts[1:])))
    assert have == plain and packed.groupby("sequence_id").length.sum().max() <= 1024


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
        if "text" not in docs.columns:
            break
