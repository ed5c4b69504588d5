"""N-gram Jaccard self-join: universe partition and pigeonhole, verified exactly.

Two sets of sizes s and t with a Jaccard similarity of at least num/den differ in at most
H = (s + t)(den - num)/(den + num) elements. Sizes fall into bands, each as wide as the
similarity allows, so that partners lie in the same or the next band. A band has a scheme: it
hashes the universe of shingles into H + 1 segments, and partners agree in one segment at
least. What a set has in each segment is hashed to a signature; sets with a signature in
common meet in a bucket. A set takes part in the scheme of its own band and in that of the
band below, where a partner can be.

Allocation: a segment that is empty in a set would meet every other empty one, so it costs
most and says least. It is skipped, and the lost difference is allowed for in a cheaper place:
one of the set's first segments also gives the signatures of its one-deletion neighbourhood,
so that it is found with one difference. How many of the first segments do so is a power of two
found per set, which makes the choices of two sets nest; the set with the smaller one alone
proves that the pair meets. A set too sparse for that keeps its empty segments.

Buckets are gathered as packed arrays (no row per signature) and become groups of documents, listed in
chunks of BLOCK members; equal groups count once. Of a group each member is first verified against its smallest
member; after connected components of those links, only pairs of members that are still in
different components remain. In a group with several components the members outside its largest one meet
each other and those inside, in pairs of blocks that are rows of their own, and of these pairs only those whose sizes and parity sketches
leave a link possible (each differing bit proves a differing element) are verified. A sketch has a bit for each element at least, from 2**LEAST
to 2**WIDEST bits: with fewer bits than elements that may differ it would prove nothing of documents that share a passage. Pairs
inside a component can't change it and are never made, so n near-copies cost n links and n rows for each signature. Equal sets are
one class from the start. Verification reads the whole texts again: the text of a document with many partners travels once for BLOCK of them.
Elsewhere texts don't travel but where a bitmap of ids leaves open whether a row stays.

Words are runs of bytes other than space and \\x09-\\x0D with A-Z lower-cased.

Nulls and edges: null or wordless text has an empty set, linked with nothing; a text with
fewer words than a shingle is one shingle; a null id gets a null component, an id that is no whole number raises; rows repeat as
often as the input has them, each following its own text; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import text as tx
from brindle.llm.neardup import runs
from brindle.llm.tables import Scratch, connected_components

U = np.uint64
BLOCK = 1024
FLUSH = 1 << 20
MOST = 28  # a bitmap of 32 MB
LEAST, WIDEST = 9, 15  # sketches of 64 bytes to 4 KB


class Schemes:
    """Bands of sizes and the number of segments of each band's scheme."""

    def __init__(self, num: int, den: int, largest: int = 1 << 31):
        self.num, self.den = num, den
        low = [1]
        while low[-1] <= largest:
            low.append(low[-1] * den // num + 1)
        self.low = np.array(low)
        top = self.low[1:] - 1
        self.reach = top * den // num  # the largest partner of a set of this band
        self.segments = (top + self.reach) * (den - num) // (den + num) + 1

    def of(self, n: int) -> list[int]:
        """The schemes that a set of n elements takes part in; none where only equal sets could link."""
        k = int(np.searchsorted(self.low, n, side="right")) - 1
        return [x for x in (k, k - 1) if x >= 0 and n <= self.reach[x] and self.segments[x] > 1]

    def linked(self, common: int, a: int, b: int) -> bool:
        return self.den * common >= self.num * (a + b - common)

    def possible(self, a: np.ndarray, b: np.ndarray, differ: np.ndarray) -> np.ndarray:
        """Whether sets of sizes a and b can link that differ in so many elements at least."""
        return (np.minimum(a, b) * self.den >= np.maximum(a, b) * self.num) & (differ * (self.den + self.num) <= (a + b) * (self.den - self.num))


def signatures(h: np.ndarray, scheme: int, m: int) -> np.ndarray:
    """The signatures of a set (its hashes) in a scheme of m segments."""
    k = np.full(1, scheme + 1, U)
    g = tx.mix(h + k * tx._TURN[1])
    seg = ((g >> U(32)) * U(m) >> U(32)).astype(np.int64)
    v = tx.mix(g)
    size = np.bincount(seg, minlength=m)
    total = (np.bincount(seg, (v >> U(32)).astype(np.float64), m).astype(U) << U(32)) + np.bincount(seg, (v & U(0xFFFFFFFF)).astype(np.float64), m).astype(U)
    tag = (np.arange(m).astype(U) + U(1)) * tx._TURN[2] + k * tx._TURN[3]
    own = tx.mix(total + tag)
    empty = m - int(np.count_nonzero(size))
    if not empty:
        return own
    room = np.cumsum(size >= 2)
    if room[-1] < empty:  # too sparse: nothing is skipped
        first, out = m, own
    else:
        first, out = 1 << int(np.searchsorted(room, empty)).bit_length(), own[size > 0]
    out = np.concatenate([out, tx.mix((total[seg] - v + tag[seg])[(seg < first) & (size[seg] >= 2)])])
    return out


def sketch(h: np.ndarray) -> bytes:
    """Parity bits of a set by the low bits of its hashes: as many as it has elements, rounded up to a power of two."""
    bits = 1 << min(max((len(h) - 1).bit_length(), LEAST), WIDEST)
    return np.packbits((np.bincount((h & U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


class Sketches:
    """Sketches of sets; of two, the wider one is folded to the other's width."""

    def __init__(self, bits: list[bytes]):
        self.bits, self.words, self.folded = bits, np.array([len(x) // 8 for x in bits], np.int64), {}

    def at(self, words: int) -> np.ndarray:
        """All sketches of so many words or more, folded to that width; rows of zeros for the others."""
        if words not in self.folded:
            out = np.zeros((len(self.bits), words), U)
            for wide in np.unique(self.words[self.words >= words]).tolist():
                rows = np.flatnonzero(self.words == wide)
                m = np.frombuffer(b"".join(self.bits[k] for k in rows.tolist()), U).reshape(len(rows), wide)
                while m.shape[1] > words:
                    half = m.shape[1] // 2
                    m = m[:, :half] ^ m[:, half:]
                out[rows] = m
            self.folded[words] = out
        return self.folded[words]

    def differ(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many elements the sets x[k] and y[k] differ in at least."""
        out, width = np.zeros(len(x), np.int64), np.minimum(self.words[x], self.words[y])
        for words in np.unique(width).tolist():
            rows, m = np.flatnonzero(width == words), self.at(words)
            for part in np.array_split(rows, len(rows) * words // FLUSH + 1):  # 8 MB at once
                out[part] = np.bitwise_count(m[x[part]] ^ m[y[part]]).sum(1)
        return out


def measure(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, print, sketch): set size, 128-bit hash of the set, parity bits."""

    def run(batches):
        for b in tx.slices(batches, "text"):
            sets = tx.shingle_sets(*tx.utf8(b.column("text")), words)
            cols = [pa.array([len(h) for h in sets], pa.int64()), pa.array([xxhash.xxh3_128_hexdigest(h.tobytes()) for h in sets]), pa.array([sketch(h) for h in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], ["doc_id", "n", "print", "sketch"])

    return docs.mapInArrow(run, "doc_id long, n long, print string, sketch binary")


def groups(docs: DataFrame, words: int, schemes: Schemes, parts: int) -> DataFrame:
    """(key, size, chunk, lead, members) of all buckets with more than one document; equal groups once.

    lead is the smallest member; the others are listed in order, up to BLOCK of them in a chunk.
    """
    shift = U(64 - (parts.bit_length() - 1))

    def pack(sigs, ids):
        sig, doc = np.concatenate(sigs), np.concatenate(ids)
        part = (sig >> shift).astype(np.int64)
        order = np.lexsort((doc, part))
        sig, doc, part = sig[order], doc[order], part[order]
        cut = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        spans = list(zip(cut, cut[1:]))
        kinds = [pa.array(part[cut[:-1]], pa.int64()), pa.array([sig[a:z].tobytes() for a, z in spans], pa.binary()), pa.array([np.diff(doc[a:z], prepend=0).tobytes() for a, z in spans], pa.binary())]
        return pa.RecordBatch.from_arrays(kinds, ["part", "sigs", "steps"])

    def sign(batches):
        sigs, ids, held = [], [], 0
        for b in tx.slices(batches, "text"):
            for doc, h in zip(b.column("doc_id").to_pylist(), tx.shingle_sets(*tx.utf8(b.column("text")), words)):
                for k in schemes.of(len(h)) if len(h) and doc is not None else ():
                    sigs.append(signatures(h, k, int(schemes.segments[k])))
                    ids.append(np.full(len(sigs[-1]), doc, np.int64))
                    held += len(sigs[-1])
            if held >= FLUSH:
                yield pack(sigs, ids)
                sigs, ids, held = [], [], 0
        if held:
            yield pack(sigs, ids)

    def meet(batches):
        for g in runs(batches, ["part"]):
            sig = np.frombuffer(b"".join(g.column("sigs").to_pylist()), U)
            doc = np.concatenate([np.cumsum(np.frombuffer(x, np.int64)) for x in g.column("steps").to_pylist()])
            order = np.lexsort((doc, sig))
            sig, doc = sig[order], doc[order]
            same = sig[1:] == sig[:-1]
            new = np.concatenate(([True], ~(same & (doc[1:] == doc[:-1]))))
            sig, doc = sig[new], doc[new]
            at = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
            size = np.diff(np.append(at, len(sig)))
            at, size = at[size > 1], size[size > 1]
            if not len(at):
                continue
            sums = np.cumsum(np.concatenate(([U(0)], tx.mix(doc.astype(U)))))
            _, one = np.unique(np.stack([sums[at + size] - sums[at], size.astype(U)]), axis=1, return_index=True)
            rows = []
            for a, n in zip(at[one].tolist(), size[one].tolist()):
                key = xxhash.xxh3_64_intdigest(doc[a : a + n].tobytes()) >> 1
                rows += [(key, n, c, doc[a], doc[x : min(x + BLOCK, a + n)]) for c, x in enumerate(range(a + 1, a + n, BLOCK))]
            *flat, members = zip(*rows)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, members)]), pa.int32()), pa.array(np.concatenate(members)))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in flat), lists], ["key", "size", "chunk", "lead", "members"])

    packed = docs.mapInArrow(sign, "part long, sigs binary, steps binary")
    met = packed.repartition("part").sortWithinPartitions("part").mapInArrow(meet, "key long, size long, chunk long, lead long, members array<long>")
    return met.groupBy("key", "size", "chunk").agg(F.first("lead").alias("lead"), F.first("members").alias("members"))


def sifted(scratch: Scratch, docs: DataFrame, ids: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(rows, bitmap): the rows of docs as (row, id, maybe); maybe is false only where the id isn't among ids, of which there are n.

    A bitmap of hashed ids, eight bits or more for each up to 2**MOST bits (2**(MOST - 6) rows), is broadcast.
    """
    bits = min(max((8 * n).bit_length(), 16), MOST)
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    bitmap = ids.select(slot("doc_id").alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
    bitmap = scratch.save(bitmap, "bitmap")
    near = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"))
    near = near.withColumn("slot", slot("id")).withColumn("word", F.shiftright("slot", 6)).join(F.broadcast(bitmap), "word", "left")
    return near.select("row", "id", F.expr("coalesce((bits & shiftleft(1L, cast(slot & 63 as int))) <> 0, false)").alias("maybe")), bitmap


def among(scratch: Scratch, docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is in ids (doc_id, distinct), without a shuffle of all texts: only rows that the bitmap lets through are joined."""
    near, bitmap = sifted(scratch, docs, ids, ids.count())
    out = scratch.save(near.where("maybe").join(ids, F.col("id") == ids["doc_id"], "left_semi").select("row.*"), "texts")
    scratch.drop(bitmap)
    return out


def without(scratch: Scratch, docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is not in ids (doc_id, distinct), among them those without one.

    Rows that the bitmap rules out stay where they are and only the others are joined. If most rows go, the bitmap
    is of the ids that stay, so that about half of the texts travel at most.
    """
    n, rows = ids.count(), docs.count()
    if not n:
        return docs
    if 2 * n <= rows:
        near, _ = sifted(scratch, docs, ids, n)
        stay = near.where("not maybe").union(near.where("maybe").join(ids, F.col("id") == ids["doc_id"], "left_anti"))
    else:
        rest = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().join(ids, "doc_id", "left_anti")
        rest = scratch.save(rest, "rest")
        near, _ = sifted(scratch, docs, rest, rest.count())
        stay = near.where("id is null").union(near.where("id is not null and maybe").join(rest, F.col("id") == rest["doc_id"], "left_semi"))
    return stay.select("row.*")


def verify(scratch: Scratch, docs: DataFrame, pairs: DataFrame, words: int, schemes: Schemes) -> DataFrame:
    """The pairs (a, b) that link, by their whole texts.

    A document's partners are dealt out by BLOCK, and its text travels once for each such part.
    """
    ids = scratch.save(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "asked")
    texts = among(scratch, docs, ids)
    much = pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("a", F.ceil(F.col("n") / BLOCK).alias("parts"))
    dealt = scratch.save(pairs.join(much, "a", "left").select("a", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).alias("part"), "b"), "dealt")
    text = lambda c: texts.select(F.col("doc_id").alias(c), "text")
    first = dealt.select("a", "part").distinct().join(text("a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    both = first.unionByName(dealt.join(text("b"), "b")).repartition("a", "part").sortWithinPartitions("a", "part", "b")  # the null b first

    def run(batches):
        of, own = None, []
        for b in tx.slices(batches, "text"):
            hit = []
            for a, part, other, h in zip(*(b.column(c).to_pylist() for c in ("a", "part", "b")), tx.shingle_sets(*tx.utf8(b.column("text")), words)):
                if (a, part) != of:
                    of, own = (a, part), []
                if other is None:
                    own.append(h)
                hit.append(other is not None and any(schemes.linked(len(np.intersect1d(x, h, assume_unique=True)), len(x), len(h)) for x in own))
            yield b.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

    links = scratch.save(both.mapInArrow(run, "a long, b long"), "links")
    scratch.drop(ids, texts, dealt)
    return links


def components(spark: SparkSession, docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of docs; a link is a Jaccard of num/den or more."""
    scratch, schemes = Scratch(spark, "setjoin"), Schemes(num, den)
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sizes = scratch.save(measure(docs, words), "sizes")
    some = sizes.where("n > 0 and doc_id is not null")
    classes = scratch.save(some.groupBy("print", "n").agg(F.min("doc_id").alias("rep")), "classes")
    copies = scratch.save(some.join(classes, ["print", "n"]).where("doc_id <> rep").select("doc_id").distinct(), "copies")
    single = without(scratch, docs, copies)
    parts = 1 << max(10, (4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    met = scratch.save(groups(single, words, schemes, parts), "groups")
    about = sizes.where("n > 0").select(F.col("doc_id").alias("member"), "n", "sketch").dropDuplicates(["member"])

    first = met.select(F.col("lead").alias("a"), F.explode("members").alias("b")).distinct()
    first = scratch.save(_possible(first.join(_as(about, "a"), "a").join(_as(about, "b"), "b"), schemes), "first")
    links = verify(scratch, docs, first, words, schemes)  # no id of a pair is one of a copy
    near = connected_components(scratch, links)

    listed = F.when(F.col("chunk") == 0, F.concat(F.array("lead"), "members")).otherwise(F.col("members"))
    member = met.select("key", "size", F.explode(listed).alias("member")).join(near, F.col("member") == F.col("node"), "left")
    member = scratch.save(member.select("key", "size", "member", F.coalesce("component", "member").alias("label")), "members")
    later = scratch.save(_blocks(member, about).mapInArrow(_across(schemes), "a long, b long").distinct(), "later")
    if later.limit(1).count():
        more = verify(scratch, docs, later, words, schemes)
        scratch.drop(near)
        near = connected_components(scratch, links.union(more))
        scratch.drop(more)
    scratch.drop(copies, met, first, links, member, later)

    out = sizes.select("doc_id", "n", "print").join(classes, ["print", "n"], "left").join(near, F.col("rep") == F.col("node"), "left")
    own = F.when(F.col("n") > 0, F.coalesce("component", "rep")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))


def _as(about: DataFrame, side: str) -> DataFrame:
    return about.select(F.col("member").alias(side), F.col("n").alias(f"{side}_n"), F.col("sketch").alias(f"{side}_sketch"))


def _possible(pairs: DataFrame, schemes: Schemes) -> DataFrame:
    """The pairs whose sizes and sketches leave a link possible."""

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, BLOCK):
                b = batch.slice(s, BLOCK)
                n, m = (b.column(c).to_numpy() for c in ("a_n", "b_n"))
                at = np.arange(len(n))
                differ = Sketches([*b.column("a_sketch").to_pylist(), *b.column("b_sketch").to_pylist()]).differ(at, at + len(n))
                yield b.select(["a", "b"]).filter(pa.array(schemes.possible(n, m, differ)))

    fits = F.least("a_n", "b_n") * schemes.den >= F.greatest("a_n", "b_n") * schemes.num
    return pairs.where(fits).mapInArrow(run, "a long, b long")


def _blocks(member: DataFrame, about: DataFrame) -> DataFrame:
    """Rows of each two blocks of members between which a link could still join components, sorted by blocks.

    Of a group with several components, the members of its largest one and all others are dealt
    out into blocks of about BLOCK. A block of others meets itself, each other such block and each block of
    the largest component: (n / BLOCK) * (others / BLOCK + 1) pairs of blocks, in proportion to n where one component holds nearly all.
    """
    group = ["key", "size"]
    parts = F.ceil(F.col("size") / BLOCK)  # a group's rows are joined in so many parts
    per = member.groupBy(*group, "label").agg(F.count("*").alias("n"))
    open_ = per.groupBy(*group).agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("m"), F.sum("n").alias("all"), F.count("*").alias("labels")).where("labels > 1")
    open_ = open_.select(*group, "main", F.ceil((F.col("all") - F.col("m")) / BLOCK).alias("others"), F.ceil(F.col("m") / BLOCK).alias("mains"))
    open_ = open_.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    rest = member.withColumn("salt", F.pmod(F.xxhash64("member"), parts)).join(open_, [*group, "salt"]).join(about, "member")
    inside = F.col("label") == F.col("main")
    rest = rest.withColumn("block", F.when(inside, F.col("others") + F.pmod(F.xxhash64("member"), "mains")).otherwise(F.pmod(F.xxhash64("member"), "others")))
    last = F.when(inside, F.col("others")).otherwise(F.col("others") + F.col("mains"))
    rest = rest.withColumn("partner", F.explode(F.sequence(F.lit(0).cast("long"), last - 1)))
    rest = rest.withColumn("i", F.least("block", "partner")).withColumn("j", F.greatest("block", "partner"))
    of = [*group, "i", "j"]
    return rest.select(*of, "block", "member", "label", "n", "sketch").repartition(*of).sortWithinPartitions(*of, "member")


def _across(schemes: Schemes):
    """Of each two blocks the pairs of members under different labels that can link by sizes and sketches."""

    def run(batches):
        for g in runs(batches, ["key", "size", "i", "j"]):
            doc, label, n, block = (g.column(c).to_numpy() for c in ("member", "label", "n", "block"))
            sketches = Sketches(g.column("sketch").to_pylist())
            least = sketches.at((1 << LEAST) // 64)
            i, j = g.column("i")[0].as_py(), g.column("j")[0].as_py()
            left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
            for s in range(0, len(left), 256):
                rows = left[s : s + 256, None]
                fits = (label[rows] != label[right]) & (np.minimum(n[rows], n[right]) * schemes.den >= np.maximum(n[rows], n[right]) * schemes.num)
                x, y = np.nonzero(fits & (rows < right) if i == j else fits)
                x, y = left[s + x], right[y]
                keep = schemes.possible(n[x], n[y], np.bitwise_count(least[x] ^ least[y]).sum(1))
                x, y = x[keep], y[keep]
                keep = schemes.possible(n[x], n[y], sketches.differ(x, y))
                if keep.any():
                    a, b = doc[x[keep]], doc[y[keep]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def keep_one(spark: SparkSession, docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs, all columns, whose document leads its component: one of each group stays.

    Rows without an id stay, as do rows that repeat the id of a leading document.
    """
    scratch = Scratch(spark, "keepone")
    copies = components(spark, docs, words, num, den).where("doc_id <> component_id").select("doc_id").distinct()
    return without(scratch, docs, scratch.save(copies, "copies"))
