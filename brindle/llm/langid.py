"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training adds up hashed n-gram counts per language over all labelled rows: each task counts
with numpy and sends at most languages x buckets sums, Spark adds them up, and the matrix of
log-probabilities (buckets x languages, float32) is broadcast. Its size depends on
`bits` and the number of languages alone, never on the corpus; a label set of more than
`max_languages` values raises. Scoring counts the buckets of each whole text, BLOCK n-grams at a time, and multiplies
these sparse counts with the matrix rows that they name, CELLS numbers at a time, so memory doesn't grow with the languages.

Nulls and edges: a null or letterless text gets `und` with score 0; rows with null id, text or
language don't train; without any training row every text is `und`; rows repeat as often as
the input has them; other columns of the input play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm import text as tx

ORDERS = (1, 2, 3)
BITS = 15
MAX_LANGUAGES = 512
UNKNOWN = "und"
BLOCK, CELLS = 1 << 20, 1 << 22
_LETTER = regex.compile(r"\p{L}")
_MULT = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id written as text, modulo n."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % n


def ngrams(texts: list[str], bits: int, orders: tuple[int, ...] = ORDERS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: (bucket of every n-gram, document of every n-gram). Texts are lower-cased."""
    low = [t.lower() for t in texts]
    size = np.fromiter(map(len, low), np.int64, len(low))
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(low), dtype=np.int32), size)
    h = np.zeros(len(points), np.uint32)
    for k in range(1, max(orders) + 1):
        if len(points) < k:
            return
        h = (h[: len(points) - k + 1] ^ (points[k - 1 :] * _MULT[(k - 1) % 3])) * np.uint32(0x01000193)
        if k in orders:
            inside = doc[: len(h)] == doc[k - 1 :]
            g = h[inside] + np.uint32(k)
            yield ((g ^ (g >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - bits), doc[: len(h)][inside]


def fit(spark: SparkSession, docs: DataFrame, text: str = "text", lang: str = "lang", bits: int = BITS, max_languages: int = MAX_LANGUAGES) -> tuple[list[str], np.ndarray]:
    """(languages, matrix of log-probabilities: buckets x languages). Learns from all rows given."""

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for b in tx.slices(batches, "t"):
            tags = np.array(b.column("l").to_pylist(), object)
            texts = b.column("t").to_pylist()
            for tag in dict.fromkeys(tags):
                own = [t for t, x in zip(texts, tags) if x == tag]
                at = sums.setdefault(tag, np.zeros(1 << bits, np.int64))
                for g, _ in ngrams(own, bits):
                    at += np.bincount(g, minlength=1 << bits)
        for tag, at in sums.items():
            k = np.flatnonzero(at)
            yield pa.RecordBatch.from_arrays([pa.array([tag] * len(k)), pa.array(k, pa.int32()), pa.array(at[k])], ["l", "g", "n"])

    rows = docs.select(F.col(text).alias("t"), F.col(lang).alias("l")).where("t is not null and l is not null")
    sums = rows.mapInArrow(count, "l string, g int, n long").groupBy("l", "g").agg(F.sum("n").alias("n"))
    langs = sorted(r.l for r in rows.select("l").distinct().limit(max_languages + 1).collect())
    if len(langs) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    counts = np.ones((1 << bits, len(langs)), np.float64)
    if langs:
        got = sums.toArrow()  # at most languages x buckets rows
        col = np.searchsorted(np.array(langs, object), np.array(got.column("l").to_pylist(), object))
        counts[got.column("g").to_numpy(), col] += got.column("n").to_numpy()
    return langs, np.log(counts / counts.sum(0)).astype(np.float32)


class Model:
    """Scores batches of texts with the broadcast matrix."""

    def __init__(self, langs: list[str], raw: bytes):
        self.langs = langs
        self.matrix = np.frombuffer(raw, np.float32).reshape(-1, max(len(langs), 1))
        self.bits = self.matrix.shape[0].bit_length() - 1

    def __call__(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(best language, its posterior under equal priors) of each text."""
        texts = [t or "" for t in texts]
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        known = np.array([bool(_LETTER.search(t)) for t in texts], bool)
        total = np.zeros((len(texts), len(self.langs)))
        for g, doc in ngrams(texts, self.bits) if known.any() else ():
            for s in range(0, len(g), BLOCK):
                pair, n = np.unique(doc[s : s + BLOCK].astype(np.int64) << self.bits | g[s : s + BLOCK], return_counts=True)
                step = max(CELLS // len(self.langs), 1)
                for k in range(0, len(pair), step):
                    of = pair[k : k + step] >> self.bits
                    at = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                    rows = self.matrix[pair[k : k + step] & (len(self.matrix) - 1)] * n[k : k + step, None].astype(np.float32)
                    total[of[at]] += np.add.reduceat(rows, at, axis=0, dtype=np.float64)
        best = total.argmax(1)
        p = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        return [self.langs[i] if k else UNKNOWN for i, k in zip(best, known)], np.where(known, p, 0.0)


def predict(spark: SparkSession, docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score) of every row."""
    langs, sent = model[0], spark.sparkContext.broadcast(model[1].tobytes())

    def score(batches):
        m = Model(langs, sent.value)
        for b in tx.slices(batches, "t"):
            pred, p = m(b.column("t").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(pred, pa.string()), pa.array(p)], [key, "lang_pred", "score"])

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return rows.mapInArrow(score, f"{key} {rows.schema['k'].dataType.simpleString()}, lang_pred string, score double")


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row: learns where crc32(doc_id) mod 4 is not 2."""
    model = fit(spark, docs.where(fold("doc_id", 4) != 2))
    out = predict(spark, docs, model)
    return out.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_identified(spark: SparkSession, docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose text has an identified language; the others go.

    A text goes if it is null, has no letter, or its best language has a posterior below `least`.
    """
    langs, matrix = fit(spark, docs)
    sent = spark.sparkContext.broadcast(matrix.tobytes())

    @F.arrow_udf(T.BooleanType())
    def keep(text: pa.Array) -> pa.Array:
        m, out = Model(langs, sent.value), []
        for b in tx.slices([pa.record_batch([text], ["t"])], "t"):
            pred, p = m(b.column("t").to_pylist())
            out += [x != UNKNOWN and y >= least for x, y in zip(pred, p)]
        return pa.array(out, pa.bool_())

    return docs.where(keep("text"))
