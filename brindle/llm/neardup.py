"""Embedding near-duplicates: random-hyperplane signs in several tables, exact cosines, components.

Equal vectors (by 128 bits of hash) are one class and are compared once. Each class gets, per table, `bits` signs
of random projections; classes that agree in all signs of a table meet in a bucket. What is dealt out to
buckets is the class's number and its signs in all tables, a few bits each. A pair is looked at in the first table where it
meets, and only if its signs leave the limit likely (SLACK standard deviations of the differing bits); classes without
such a partner go no further. The vectors of the others are fetched once for each block where they have one, and exact
double-precision cosines are taken as matrix products; link counts add up without a list of pairs, as each block
passes on one count per vector and a spanning forest of its links, both no longer than its
members. Bits grow with the logarithm of the number of vectors, so that buckets stay small, and
tables with the bits, so that a pair at the limit is missed with a probability of `miss` at most.
Buckets over `block` members are cut into blocks, and pairs of blocks are compared as tasks of
their own: a link count of m vectors alike needs m * m / 2 cosines, shared out.

Nulls and edges: vectors that are null, empty, zero, or hold null or non-finite components
link with nothing, nor do vectors of different lengths, nor those with a null id, which get a null component and are kept; rows with the same id and vector
count as one, and a row that repeats an id with another vector is a vector of its own; ids of any type that has an order; labels and other columns play no part; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.tables import Scratch, connected_components

LIMIT = 0.95
MISS = 0.002
BLOCK = 128
SLACK = 6
U = np.uint64


def runs(batches: Iterable[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """The rows of each key from batches that are sorted by it; one key at a time is held."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(c).to_numpy().astype(np.int64) for c in by])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
        if held and any(held[-1].column(c)[0].as_py() != b.column(c)[0].as_py() for c in by):
            yield pa.Table.from_batches(held)
            held = []
        for x, y in zip(cuts, cuts[1:]):
            if x:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(x, y - x))
    if held:
        yield pa.Table.from_batches(held)


def plan(n: int, limit: float = LIMIT, miss: float = MISS) -> tuple[int, int]:
    """(bits, tables) for n distinct vectors."""
    bits = min(max(int(math.log2(max(n, 1) / 16 + 1)), 4), 30)
    agree = (1 - math.acos(limit) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - agree))


def signs(v: np.ndarray, bits: int, tables: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all tables, (vectors, tables); all signs as 64-bit words)."""
    planes = np.random.default_rng(seed + v.shape[1]).standard_normal((v.shape[1], bits * tables))
    on = v @ planes > 0
    packed = np.packbits(np.pad(on, ((0, 0), (0, -on.shape[1] % 64))), axis=1, bitorder="little").view(U)
    return on.reshape(len(v), tables, bits) @ (1 << np.arange(bits)), packed


def masks(bits: int, tables: int) -> np.ndarray:
    """(tables, words): which signs are those of each table."""
    on = np.zeros((tables, -(-bits * tables // 64) * 64), np.uint8)
    for t in range(tables):
        on[t, t * bits : (t + 1) * bits] = 1
    return np.packbits(on, axis=1, bitorder="little").view(U)


def likely(left: np.ndarray, right: np.ndarray, before: np.ndarray, most: float) -> np.ndarray:
    """Which pairs of left and right differ in no more than `most` signs and agree in none of the tables before."""
    differ = left[:, None] ^ right[None]
    out = np.bitwise_count(differ).sum(2) <= most
    for mask in before if out.any() else ():
        out &= (differ & mask).any(2)
    return out


def units(col: pa.ListArray) -> np.ndarray:
    """Vectors of one length as rows of unit length, in double precision."""
    v = col.flatten().to_numpy().astype(np.float64).reshape(len(col), -1)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest node that the links a-b reach."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def links(v: np.ndarray, packed: np.ndarray, weight: np.ndarray, before: np.ndarray, limit: float, split: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(links counted here, links: a, b) among unit vectors of one bucket that agree in none of the tables before.

    split: over 0 if only pairs between v[:split] and v[split:] are meant.
    """
    count = np.zeros(len(v), np.int64)
    left, right = [], []
    for s in range(0, split or len(v), 512):
        rows = v[s : min(s + 512, split or len(v))]
        start = split or s
        x, y = np.nonzero(rows @ v[start:].T >= limit)
        x, y = x + s, y + start
        keep = x < y
        x, y = x[keep], y[keep]
        differ = packed[x] ^ packed[y]
        keep = np.ones(len(x), bool)
        for mask in before:
            keep &= (differ & mask).any(1)
        x, y = x[keep], y[keep]
        count += np.bincount(x, weight[y], minlength=len(v)).astype(np.int64) + np.bincount(y, weight[x], minlength=len(v)).astype(np.int64)
        left.append(x)
        right.append(y)
    return count, np.concatenate(left or [np.zeros(0, int)]), np.concatenate(right or [np.zeros(0, int)])


def near_duplicates(spark: SparkSession, vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", limit: float = LIMIT, miss: float = MISS, block: int = BLOCK, seed: int = 5) -> DataFrame:
    """(key, n_links, component_id, kept), one row per vector."""
    scratch = Scratch(spark, "neardup")
    number = "float" if vectors.schema[embedding].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col(key).alias("id"), F.col(embedding).cast(f"array<{number}>").alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fine = F.col("id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False))).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0).cast(number)))  # -0.0 becomes 0.0
    rows = rows.withColumn("h", F.struct(F.xxhash64(F.size("v"), "v").alias("x"), F.xxhash64(F.lit(seed), "v").alias("y")))
    ids = scratch.save(rows.select("id", "h", "fine").distinct(), "ids")
    sound = ids.where("fine")
    classes = sound.groupBy("h").agg(F.min("id").alias("id"), F.count("*").alias("weight"))
    classes = scratch.save(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    whole = rows.where("fine").join(classes, ["id", "h"]).dropDuplicates(["id", "h"]).select("c", "weight", "v")
    whole = scratch.save(whole, "vectors")
    bits, tables = plan(classes.count(), limit, miss)
    if tables > 255 or bits > 30:
        raise ValueError("a bucket's number holds 255 tables of 30 bits at most")
    apart = math.acos(limit) / math.pi
    most = bits * tables * apart + SLACK * math.sqrt(bits * tables * apart * (1 - apart))
    mask = masks(bits, tables)

    def deal(batches, all_signs=True):
        for b in batches:
            if not b.num_rows:
                continue
            size = pc.list_value_length(b.column("v")).to_numpy()
            for width in np.unique(size).tolist():
                of = b.filter(pa.array(size == width))
                codes, packed = signs(units(of.column("v")), bits, tables, seed)
                held = pa.array([p.tobytes() for p in packed], pa.binary())
                for t in range(tables):
                    bucket = pa.array((width << 38 | t << 30) + codes[:, t])
                    yield pa.RecordBatch.from_arrays([bucket, of.column("c"), held] if all_signs else [bucket], ["bucket", "c", "signs"][: 3 if all_signs else 1])

    counts = whole.mapInArrow(lambda batches: deal(batches, False), "bucket long").groupBy("bucket").count()
    large = scratch.save(counts.where(F.col("count") > block).select("bucket", F.ceil(F.col("count") / block).alias("blocks")), "large")
    members = whole.mapInArrow(deal, "bucket long, c long, signs binary").join(large, "bucket", "left")
    members = members.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("c"), "blocks"))
    # a member meets its own block, and each other block once
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    members = members.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    group = ["bucket", "i", "j"]
    members = members.select(*group, "block", "c", "signs").repartition(*group).sortWithinPartitions(*group, "block", "c")

    def read(g):
        bucket, i, j = (g.column(c)[0].as_py() for c in group)
        packed = np.frombuffer(b"".join(g.column("signs").to_pylist()), U).reshape(g.num_rows, -1)
        split = int((g.column("block").to_numpy() == i).sum()) if i != j else 0
        return packed, mask[: bucket >> 30 & 255], split, i == j or 0 < split < g.num_rows

    def screen(batches):
        for g in runs(batches, group):
            if g.num_rows < 2:
                continue
            packed, before, split, some = read(g)
            on = np.zeros(g.num_rows, bool)
            for s in range(0, (split or g.num_rows) if some else 0, 128):
                end = min(s + 128, split or g.num_rows)
                start = split or s + 1
                near = likely(packed[s:end], packed[start:], before, most)
                if not split:
                    near &= np.arange(s, end)[:, None] < np.arange(start, g.num_rows)[None]
                on[s:end] |= near.any(1)
                on[start:] |= near.any(0)
            if on.any():
                yield from g.filter(pa.array(on)).combine_chunks().to_batches()

    dealt = scratch.save(members.mapInArrow(screen, members.schema), "dealt")
    asked = dealt.join(whole, "c").repartition(*group).sortWithinPartitions(*group, "block", "c")

    def compare(batches):
        for g in runs(batches, group):
            packed, before, split, some = read(g)
            if not some:
                continue
            c, weight = g.column("c").to_numpy(), g.column("weight").to_numpy()
            count, x, y = links(units(g.column("v").combine_chunks()), packed, weight, before, limit, split)
            met = np.flatnonzero(count)
            root = forest(x, y, len(c))
            yield pa.RecordBatch.from_arrays([pa.array(c[met]), pa.array(c[root[met]]), pa.array(count[met])], ["a", "b", "n"])

    found = scratch.save(asked.mapInArrow(compare, "a long, b long, n long"), "links")
    near = connected_components(scratch, found.select("a", "b"))
    counts = found.groupBy("a").agg(F.sum("n").alias("n"))
    known = classes.join(counts, classes.c == counts.a, "left").join(near, classes.c == near.node, "left")
    known = scratch.save(known.select("h", "id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "c").alias("component")), "known")
    first = known.groupBy("component").agg(F.min("id").alias("first"))
    known = known.join(first, "component").select("h", "n", "first")
    out = sound.join(known, "h").select("id", "n", "first").union(ids.where("not fine").select("id", F.lit(0).cast("long"), "id"))
    scratch.drop(whole, large, dealt, found, near)
    return out.select(F.col("id").alias(key), F.col("n").alias("n_links"), F.col("first").alias("component_id"), F.col("id").eqNullSafe(F.col("first")).alias("kept"))
