"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are present-or-absent buckets of single words, neighbouring pairs and pairs
with one word between (letters, digits and non-ASCII characters make words, in lower case).
Training takes a bounded sample of labelled rows: of each label the rows whose hashed ids
are smallest, `sample` at most. The rows taken of the two labels weigh the same in total; where the bound
leaves rows out, the bias is corrected by the log of the shares taken. They are dealt out by `shard` rows, each task runs FTRL-proximal with
per-coordinate rates and L1, and the weights are averaged. L1 leaves few weights, which are
broadcast as index and value; their number is bounded by the sample, not by the corpus.

Nulls and edges: null counts as empty; empty and wordless texts get the score of the bias;
labels that are null or name no document don't train, of repeated labels of a document the
mean counts; with labels of one kind only, every score is that label; rows repeat as often as
the input has them; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm import text as tx
from brindle.llm.langid import fold

BITS = 22
SAMPLE = 6144
SHARD = 4096
EPOCHS = 6


def features(data: np.ndarray, off: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of every single word, pair and skip pair, repeats included."""
    begin, end, first = tx.words(data, off, tx.NOT_ALNUM)
    h = tx.word_hashes(data, begin, end)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    shift = np.uint64(64 - bits)
    out, docs = [h], [doc]
    for gap in (1, 2):
        if len(h) > gap:
            inside = doc[gap:] == doc[:-gap]
            out.append(tx.mix(h[:-gap] * tx._TURN[gap] + h[gap:])[inside])
            docs.append(doc[gap:][inside])
    return (np.concatenate(out) >> shift).astype(np.int64), np.concatenate(docs)


def ftrl(rows: list[np.ndarray], labels: np.ndarray, bits: int, epochs: int = EPOCHS, alpha: float = 1.0, beta: float = 1.0, l1: float = 10.0, l2: float = 1.0, cost: tuple[float, float] = (1.0, 1.0)) -> tuple[np.ndarray, float]:
    """(weights, bias) of logistic regression on rows of present buckets, by FTRL-proximal; cost: what a row of label 0 and of 1 weighs."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bz = bn = bias = 0.0
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            x = rows[k]
            zx, nx = z[x], n[x]
            root = np.sqrt(nx)
            w = np.where(np.abs(zx) > l1, (np.sign(zx) * l1 - zx) / ((beta + root) / alpha + l2), 0.0)
            bias = -bz / ((beta + bn**0.5) / alpha)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - labels[k]
            g *= cost[labels[k]]
            z[x] = zx + g - (np.sqrt(nx + g * g) - root) / alpha * w
            n[x] = nx + g * g
            bz += g - ((bn + g * g) ** 0.5 - bn**0.5) / alpha * bias
            bn += g * g
    w = np.where(np.abs(z) > l1, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)
    return w, float(-bz / ((beta + bn**0.5) / alpha))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS, shard: int = SHARD) -> tuple[np.ndarray, np.ndarray, float]:
    """(buckets, weights, bias). Learns from the labels given: all rows of each value up to `sample`."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("toxic").alias("y")).select("doc_id", (F.col("y") >= 0.5).cast("int").alias("y"))
    known = known.withColumn("r", F.xxhash64(F.lit(11), "doc_id"))
    have = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(have) < 2:
        return np.zeros(0, np.int64), np.zeros(0), 20.0 if have.get(1) else -20.0
    n = {y: min(sample, have[y]) for y in (0, 1)}
    left_out = float(np.log(have[1] / n[1]) - np.log(have[0] / n[0]))  # 0 where all rows are taken
    cost = (sum(n.values()) / n[0] / 2, sum(n.values()) / n[1] / 2)
    shards = -(-sum(n.values()) // shard)
    picked = [known.where(F.col("y") == y).orderBy("r", "doc_id").limit(n[y]) for y in (0, 1)]
    picked = picked[0].unionByName(picked[1]).select(F.col("doc_id").alias("id"), "y", F.pmod("r", F.lit(shards)).alias("shard"))
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("id")).select("shard", "doc_id", "text", "y")  # at most 2 x sample rows

    def train(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        xs = []
        for b in tx.slices(table.to_batches(), "text"):
            g, doc = features(*tx.utf8(b.column("text"), lower=True), bits)
            g = np.unique(doc << bits | g)
            edge = np.searchsorted(g, np.arange(b.num_rows + 1) << bits)
            xs += [g[a:z] & ((1 << bits) - 1) for a, z in zip(edge, edge[1:])]
        w, bias = ftrl(xs, table.column("y").to_numpy(), bits, cost=cost)
        at = np.flatnonzero(w)
        return pa.table({"g": np.append(at, -1), "w": np.append(w[at], bias)})

    got = rows.groupBy("shard").applyInArrow(train, "g long, w double").toArrow()  # L1 leaves few weights
    w, at = np.zeros(1 << bits), got.column("g").to_numpy()
    values = got.column("w").to_numpy()
    tasks = max(int((at < 0).sum()), 1)
    np.add.at(w, at[at >= 0], values[at >= 0] / tasks)
    keep = np.flatnonzero(np.abs(w) > 1e-3)
    return keep, w[keep], float(values[at < 0].sum() / tasks) + left_out


class Model:
    """Scores batches of texts with the broadcast weights."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray, bias: float, bits: int = BITS):
        self.at, self.w, self.bias, self.bits = buckets, weights, bias, bits
        self.has = np.zeros(1 << bits, bool)
        self.has[buckets] = True

    def __call__(self, col: pa.Array) -> np.ndarray:
        g, doc = features(*tx.utf8(col, lower=True), self.bits)
        hit = self.has[g]
        pairs = np.unique(doc[hit] << self.bits | g[hit])
        w = self.w[np.searchsorted(self.at, pairs & ((1 << self.bits) - 1))] if len(pairs) else None
        return 1 / (1 + np.exp(-np.clip(np.bincount(pairs >> self.bits, w, minlength=len(col)) + self.bias, -35, 35)))


def score(spark: SparkSession, docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """(doc_id, score) of every row, score being the probability of label 1 where both labels weigh the same (see fit for the bound)."""
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        m = Model(*sent.value)
        for b in tx.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(m(b.column("text")))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def judge(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row: learns where crc32(doc_id) mod 5 is not 0."""
    model = fit(spark, docs, labels.where(fold("doc_id", 5) != 0))
    out = score(spark, docs, model)
    return out.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, with a score under `limit`; the others go."""
    sent = spark.sparkContext.broadcast(fit(spark, docs, labels))

    @F.arrow_udf(T.BooleanType())
    def keep(text: pa.Array) -> pa.Array:
        m = Model(*sent.value)
        parts = [m(b.column("t")) for b in tx.slices([pa.record_batch([text], ["t"])], "t")]
        return pa.array(np.concatenate(parts) < limit if parts else [], pa.bool_())

    return docs.where(keep("text"))
