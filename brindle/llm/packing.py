"""Best-fit packing of documents into sequences of a fixed number of tokens.

Bulk-synchronous best fit over two tables, pieces that have no place yet and gaps in sequences.
A superstep range-sorts both together by size over the cluster and sweeps from small to large: a gap takes
the largest piece before it that no smaller gap has taken, so a piece goes to its successor, the smallest
gap that holds it, and of the pieces that ask for one gap the rank in the order decides. Each
task sweeps its own range; pieces and gaps that it leaves over are counted, one row a task, and the counts
alone say which rank of which range meets which (pieces wait on a stack, gaps take from its top), so that
matches across ranges are one equi join. Then gaps are updated and the next superstep starts. A gap that holds the largest
waiting piece several times over is offered as that many slots. Where no gap holds the smallest waiting piece, or
a sweep matches nothing, new sequences are opened, as many as the waiting tokens fill at least; once slots for all that waits would take
no more than a share SPARE of all sequences beyond that, so many are opened and the next sweep is the last. Pieces as
long as a sequence are sequences of their own from the start.

The same vocabulary is given as a tokenizer file and as byte-pair ranks; the ranks serve the
faster library, whose ids are the same (tests hold it against the other), and the file names its special tokens,
which texts may hold: their strings become their ids, as that library has it by default. Spaces after other
characters start a new token, so each task keeps a bounded table of distinct chunks.

Nulls and edges: null counts as empty text; an empty text is one piece of the end id alone;
rows repeat as often as the input has them; ids of any type, also null, are carried along; an empty table packs into no sequence; other
columns play no part.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm import text as tx
from brindle.llm.tables import Scratch

CACHED = 150_000
SPARE = 0.001
_AFTER_SPACE = re.compile(r"\s ")


def special_tokens(path: str) -> tuple[tuple[str, int], ...]:
    """The (string, id) of the special tokens that a tokenizer file adds to its vocabulary."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if any(t.get(flag) for t in added for flag in ("lstrip", "rstrip", "single_word")):
        raise ValueError("special tokens that take in their surroundings are not supported")
    return tuple((t["content"], t["id"]) for t in added)


class TokenTable(dict):
    """chunk that follows a space -> its ids, with that space, as little-endian bytes."""

    longest = 64

    def __init__(self, path: str, pattern: str, special: tuple[tuple[str, int], ...] = ()):
        super().__init__()
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("brindle", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(special))
        self.special = [s for s, _ in special]
        self.spaced = np.zeros(max(ranks.values()) + 1, bool)
        self.spaced[[i for b, i in ranks.items() if b[:1] == b" "]] = True

    def ids(self, text: str) -> bytes:
        return np.array(self.bpe.encode(text, allowed_special="all", disallowed_special=()), "<u4").tobytes()

    def segment(self, chunks: list[str]) -> dict[str, bytes]:
        plain = [c for c in chunks if c and not c[0].isspace() and not c[-1].isspace()]
        out = {c: self.ids(" " + c) for c in set(chunks).difference(plain)}
        for k in range(0, len(plain), 2000):
            part = plain[k : k + 2000]
            raw = np.array(self.bpe.encode_ordinary(" " + " ".join(part)), "<u4")
            edge = np.append(np.flatnonzero(self.spaced[raw]), len(raw))
            if len(edge) - 1 != len(part):  # a chunk of its own kind: one by one
                out.update((c, self.ids(" " + c)) for c in part)
                continue
            raw, edge = raw.tobytes(), (4 * edge).tolist()
            out.update(zip(part, [raw[a:b] for a, b in zip(edge, edge[1:])]))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each whole text as little-endian bytes."""
        whole = {k: self.ids(t) for k, t in enumerate(texts) if _AFTER_SPACE.search(t) or any(s in t for s in self.special)}
        chunks = tx.Chunks(["" if k in whole else t for k, t in enumerate(texts)])
        known = [self.get(c) for c in chunks.distinct]
        got = self.segment([c for c, i in zip(chunks.distinct, known) if i is None])
        if room := max(0, CACHED - len(self)):
            self.update(islice(((c, x) for c, x in got.items() if len(c) <= self.longest), room))
        rest = chunks.join([got[c] if i is None else i for c, i in zip(chunks.distinct, known)], first=False)
        heads = [chunks.distinct[c] for c in chunks.codes[chunks.offsets[:-1]]]
        return [whole[k] if k in whole else self.ids(h) + r for k, (h, r) in enumerate(zip(heads, rest))]


@lru_cache(maxsize=2)
def token_table(path: str, pattern: str, special: tuple[tuple[str, int], ...]) -> TokenTable:
    return TokenTable(path, pattern, special)


def pieces(docs: DataFrame, path: str, pattern: str, special: tuple[tuple[str, int], ...], capacity: int, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and end id, cut only where longer than `capacity`.

    All pieces but the first are full, so that the first alone is left to be packed.
    """

    def cut(batches):
        t = token_table(path, pattern, special)
        end = np.array([end_id], "<u4").tobytes()
        for b in tx.slices(batches, "t", 1 << 22):
            rows = []
            for k, (key_, ids) in enumerate(zip(b.column("k").to_pylist(), t.encode([x or "" for x in b.column("t").to_pylist()]))):
                ids += end
                n = len(ids) // 4
                first = n % capacity or min(n, capacity)
                cuts = [0, *range(first, n + 1, capacity)]
                rows += [(key_, p, a, z - a, zlib.crc32(ids[4 * a : 4 * z])) for p, (a, z) in enumerate(zip(cuts, cuts[1:]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), (b.schema.field("k").type, pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return rows.mapInArrow(cut, f"doc_id {rows.schema['k'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def swept(size: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pieces, gaps that take them): places in an order by size, pieces before gaps of their size.

    A gap takes the last piece before it that no other has taken: pieces open brackets, gaps close
    them, and a bracket and its partner are neighbours among the brackets of one depth.
    """
    depth = np.cumsum(np.where(gap, -1, 1)) + gap  # a piece's after it, a gap's before it
    order = np.argsort(depth, kind="stable")
    same = (depth[order[1:]] == depth[order[:-1]]) & ~gap[order[:-1]] & gap[order[1:]]
    return order[:-1][same], order[1:][same]


def meetings(left: dict[int, tuple[int, int]]) -> list[tuple[int, bool, int, int, int]]:
    """Which of the pieces and gaps that ranges have left over meet, from their numbers alone.

    left: range -> (pieces, gaps), both left over and in order of size. Returns runs
    (range, whether gaps, first rank, end rank, key of the first); keys of gaps go up by rank, those of pieces down.
    """
    runs, waiting, key = [], [], 0
    for at in sorted(left):
        pieces, gaps = left[at]
        taken = 0
        while taken < gaps and waiting:
            of, n = waiting.pop()
            use = min(n, gaps - taken)
            runs += [(of, False, n - use, n, key + use - 1), (at, True, taken, taken + use, key)]
            taken, key = taken + use, key + use
            if use < n:
                waiting.append((of, n - use))
        if pieces:
            waiting.append((at, pieces))
    return runs


def _superstep(scratch: Scratch, waiting: DataFrame, gaps: DataFrame, largest: int, names: list[str]) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(pieces placed, those that still wait, gaps, how many were placed) after one sweep.

    waiting: names and n, a number of the piece; gaps: sequence and room.
    """
    spark = scratch.spark
    slots = F.greatest(F.lit(1).cast("long"), F.floor(F.col("room") / largest))
    slot = gaps.withColumn("slots", slots).withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), "slots")))
    slot = slot.select("sequence", F.when(F.col("n") < F.col("slots"), F.lit(largest)).otherwise(F.col("room") - (F.col("slots") - 1) * largest).cast("long").alias("size"), F.lit(True).alias("gap"), "n")
    piece = waiting.select("*", F.lit(None).cast("long").alias("sequence"), F.col("length").alias("size"), F.lit(False).alias("gap"))
    every = piece.unionByName(slot, allowMissingColumns=True)
    order = ["size", "gap", "sequence", "n"]
    every = every.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)

    def sweep(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        size, gap = t.column("size").to_numpy(), t.column("gap").to_numpy()
        sequence = pc.fill_null(t.column("sequence"), 0).to_numpy().copy()
        of, by = swept(size, gap)
        rank = np.full(len(size), -1)
        over = np.ones(len(size), bool)
        over[of] = over[by] = False
        for kind in (gap, ~gap):
            rank[over & kind] = np.arange(int((over & kind).sum()))
        size = size.copy()
        sequence[of] = sequence[by]
        size[by] -= size[of]
        new = {"sequence": pa.array(sequence), "size": pa.array(size), "part": pa.array(np.full(len(size), TaskContext.get().partitionId())), "rank": pa.array(rank)}
        out = pa.table({c: new[c] if c in new else t.column(c) for c in [*t.column_names, "part", "rank"]})
        yield from out.to_batches(1 << 16)

    fields = [*every.schema.fields, T.StructField("part", T.LongType()), T.StructField("rank", T.LongType())]
    done = scratch.save(every.mapInArrow(sweep, T.StructType(fields)), "swept")
    counts, here = {}, 0
    for r in done.groupBy("part", "gap", (F.col("rank") >= 0).alias("over")).agg(F.count("*").alias("n")).collect():  # four rows a range
        if r.over:
            counts.setdefault(r.part, [0, 0])[r.gap] = r.n
        elif not r.gap:
            here += r.n
    runs = meetings(counts)
    kind = "array<struct<of:bigint,gaps:boolean,low:bigint,high:bigint,first:bigint>>"  # as a literal, so that no job is needed
    found = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps([dict(zip(("of", "gaps", "low", "high", "first"), r)) for r in runs])), kind)))
    at = (F.col("part") == F.col("of")) & (F.col("gap") == F.col("gaps")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    key = F.when(F.col("gap"), F.col("first") + F.col("rank") - F.col("low")).otherwise(F.col("first") - F.col("rank") + F.col("low"))
    over = done.where("rank >= 0").join(F.broadcast(found), at, "left").withColumn("key", key)  # at most two runs a range
    taken = over.where("not gap and key is not null").drop("sequence", "size")
    met = scratch.save(taken.join(over.where("gap and key is not null").select("key", "sequence", "size"), "key").select(*names, "n", "sequence", (F.col("size") - F.col("length")).alias("size")), "met")
    placed = done.where("not gap and rank < 0").select(*names, "sequence").unionByName(met.select(*names, "sequence"))
    room = done.where("gap and rank < 0").select("sequence", "size").unionByName(met.select("sequence", "size")).unionByName(over.where("gap and key is null").select("sequence", "size"))
    room = room.groupBy("sequence").agg(F.sum("size").alias("room"))
    return placed, over.where("not gap and key is null").select(*names, "n"), room, here + sum(high - low for _, gap, low, high, _ in runs if gap)


def pack(spark: SparkSession, docs: DataFrame, path: str, pattern: str, special: tuple[tuple[str, int], ...] = (), capacity: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece."""
    scratch = Scratch(spark, "packing")
    cut = pieces(docs, path, pattern, special, capacity, end_id, key, text)
    names = cut.columns
    cut = scratch.save(cut.withColumn("n", F.monotonically_increasing_id()), "pieces")
    full = cut.where(F.col("length") == capacity).select(*names, (-1 - F.col("n")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    waiting = cut.where(F.col("length") < capacity)
    whole = cut.agg(F.count(F.when(F.col("length") == capacity, 1))).first()[0]
    gaps = spark.range(0).select(F.col("id").alias("sequence"), F.col("id").alias("room"))
    placed, opened, matched = None, 0, 0
    while True:
        sizes = waiting.select("length", F.lit(None).cast("long").alias("room")).unionByName(gaps.select(F.lit(None).cast("long").alias("length"), "room"))
        n, total, least, most, room = sizes.agg(F.count("length"), F.sum("length"), F.min("length"), F.max("length"), F.max("room")).first()
        if not n:
            break
        gaps = gaps.where(F.col("room") >= least)
        if not matched or (room or 0) < least:
            more, slots = -(-total // capacity), -(-n // (capacity // most))
            more = slots if slots - more <= SPARE * (whole + opened) else more
            gaps = gaps.unionByName(spark.range(opened, opened + more).select(F.col("id").alias("sequence"), F.lit(capacity).cast("long").alias("room")))
            opened += more
        now, waiting, gaps, matched = _superstep(scratch, waiting, gaps, most, names)
        placed = now if placed is None else placed.unionByName(now)
    if placed is None:
        return full
    before = W.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "piece", "ids_crc32").rowsBetween(W.unboundedPreceding, -1)  # a sequence has `capacity` pieces at most
    placed = placed.withColumnRenamed("sequence", "sequence_id")
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0).cast("long"))).select(full.columns).unionByName(full)
