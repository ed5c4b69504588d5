"""Repeated passages by sparse suffix arrays.

Suffixes are kept only where a text's minimiser lies: of the `words - k + 1` k-word prefixes
(k: half of `words`) that start within a window of `words` words, the one with the smallest hash, so that
equal windows keep the suffix at equal places. Kept suffixes are dealt out by the hash of that prefix,
sorted word by word, and neighbours are compared for the number of words that they share; the words left
of each kept place are sorted and compared in the same way, read backwards. Two windows of
`words` words around two kept places are equal exactly if the suffixes share the window's words right of the
place and the reversed lefts those left of it, so every length that a match extends to the left
is paired with the rest to the right. A word belongs to a span exactly if it lies in a window that occurs
twice or more. Words are compared as texts (by codes of a dictionary of the words themselves), never by hash.

Prefixes that repeat mark a bitmap, eight bits or more for each up to 2**MOST bits, which is broadcast; only marked suffixes
travel, with the words that their windows reach. A false mark, also where more prefixes repeat
than that bitmap can tell apart, costs the sort of one suffix more and changes nothing. Before suffixes are
shuffled, each task settles those whose whole reach it has met before itself and passes on only
the smallest place of each, so a passage that a third of all documents share arrives about once for every
8 MB of suffixes. Places are ordered by (doc_id, word): the smallest is the original, the rest are copies.

Words are runs of bytes other than space and \\x09-\\x0D with A-Z lower-cased.

Nulls and edges: null and empty texts and those with fewer words than the window have no span, nor
have rows with null ids; an id that is no whole number raises; spans of one document may be copies of each other; other columns play no
part. Rows that repeat a doc_id are texts of their own: `spans` names them by doc_id alone, so that a
repeated row is found as a copy under the same id; `cut_copies` numbers them, so that one stays whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm import text as tx
from brindle.llm.neardup import runs
from brindle.llm.setjoin import sifted
from brindle.llm.tables import Scratch

WORDS = 50
MOST = 31  # a bitmap of 256 MB
HEAD = 2  # bytes before a reach that say how many of its words lie left of the place
ROW = 32  # places of rows that repeat an id hold the row's number above so many bits
SLICE, FLUSH, FLUSH_BYTES = 1 << 20, 1 << 19, 1 << 23
FOUND = ["part", "doc", "at", "many", "reach", "reach_size", "stop"]
U = np.uint64


def joined(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n hashes, by doubling."""
    if len(h) < n:
        return np.zeros(0, U)
    power, at, out = h, 0, None
    step = 1
    while True:
        if n & step:
            part = power[at : at + len(h) - n + 1]
            out = tx.mix(part + U(step)) if out is None else tx.mix(out * tx._TURN[0] + part)
            at += step
        if 2 * step > n:
            return out
        power = tx.mix(power[:-step] * tx._TURN[1] + power[step:])
        step *= 2


def lowest(h: np.ndarray, n: int) -> np.ndarray:
    """The smallest of all runs of n values."""
    step = 1
    size = len(h) - n + 1
    while 2 * step <= n:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    return np.minimum(h[:size], h[n - step : n - step + size])


class Suffixes:
    """The kept suffixes of a slice of texts: document, place, hash of the prefix, and the least and most words that windows around it reach to the left.

    Where the smallest prefix of a window occurs in it more than once, each of its places is kept.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray, words: int):
        begin, end, first = tx.words(data, off)
        self.words, self.data, self.begin, self.end, self.first = words, data, begin, end, first
        self.place = self.least = self.most = self.doc = np.zeros(0, np.int64)
        self.key = np.zeros(0, U)
        if len(begin) < words:
            return
        k, reach = words // 2, words - words // 2
        prefix = joined(tx.word_hashes(data, begin, end), k)
        low = lowest(prefix, reach + 1)
        doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
        inside = doc[: len(low)] == doc[words - 1 :]
        asked = np.zeros(len(prefix) + reach, U)  # by each window, in the places of the prefixes that it has
        asked[np.flatnonzero(inside) + reach] = low[inside]
        self.place = np.flatnonzero(prefix == ~lowest(~asked, reach + 1))
        value = prefix[self.place]
        self.least, self.most = np.full(len(value), reach + 1), np.full(len(value), -1)
        for left in range(reach + 1):
            at = self.place - left
            of = np.clip(at, 0, len(low) - 1)
            on = (at == of) & inside[of] & (low[of] == value)
            self.least[on & (self.most < 0)] = left
            self.most[on] = left
        some = self.most >= 0
        self.place, self.least, self.most = self.place[some], self.least[some], self.most[some]
        self.key, self.doc = tx.mix(value[some]), doc[self.place]

    def reach_of(self, pick: np.ndarray) -> pa.LargeBinaryArray:
        """The words that the windows of the suffixes picked reach, joined by spaces, after the number of words that lie left of the place."""
        size = self.end - self.begin
        inside = ~tx.SPACE[self.data]
        text = np.full(len(self.begin) + int(size.sum()), 32, np.uint8)
        text[np.arange(int(inside.sum())) + np.repeat(np.arange(len(size)), size)] = tx.LOWER[self.data[inside]]
        at = np.cumsum(size + 1) - size - 1
        a, z = self.place[pick] - self.most[pick], self.place[pick] + self.words - self.least[pick] - 1
        length = at[z] + size[z] - at[a] + HEAD
        off = np.concatenate(([0], np.cumsum(length)))
        out = text[np.minimum(np.repeat(at[a] - HEAD - off[:-1], length) + np.arange(off[-1]), len(text) - 1)]
        for byte in range(HEAD):
            out[off[:-1] + byte] = self.most[pick] >> 8 * byte & 255
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(out)])


def ranked(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the rows, how many values each shares with its predecessor from the first on)."""
    if not rows.shape[1]:
        return np.arange(len(rows)), np.zeros(len(rows), np.int64)
    order = np.argsort(np.ascontiguousarray(rows.astype(">u4")).view(f"V{4 * rows.shape[1]}")[:, 0], kind="stable")
    rows = rows[order]
    differ = rows[1:] != rows[:-1]
    return order, np.concatenate(([0], np.where(differ.any(1), differ.argmax(1), rows.shape[1])))


def repeats(reach: pa.LargeBinaryArray, many: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix, words that the window reaches to its left, whether it is a copy) of every repeated window.

    Suffixes are given in the order of their places; many: whether the same reach was met elsewhere, later.
    """
    n, most_left = len(reach), words - words // 2
    raw, off = tx.raw_bytes(reach)
    most = sum(raw[off[:-1] + byte].astype(np.int64) << 8 * byte for byte in range(HEAD))
    text = pa.LargeStringArray.from_buffers(n, pa.py_buffer(np.concatenate(([0], np.cumsum(np.diff(off) - HEAD))).astype(np.int64)), pa.py_buffer(np.delete(raw, (off[:-1, None] + np.arange(HEAD)).reshape(-1))))
    split = pc.split_pattern(text, " ")
    coded = split.flatten().dictionary_encode()
    rank = np.empty(len(coded.dictionary), np.int64)
    rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(rank))
    code, at = rank[coded.indices.to_numpy()], split.offsets.to_numpy()
    least = most + words - np.diff(at)
    none = len(rank) + np.arange(n)  # what lies beyond the reach equals nothing

    def side(start, step, have, width):
        j = np.arange(width)
        return np.where(j < have[:, None], code[np.clip(start[:, None] + step * j, 0, len(code) - 1)], none[:, None])

    place = at[:-1] + most
    right, right_shared = ranked(side(place, 1, words - least, words))
    left, left_shared = ranked(side(place - 1, -1, most, most_left))
    found = []
    classes = np.empty((2, n), np.int64)
    for reached in range(most_left + 1):
        classes[0, right] = np.cumsum(right_shared < words - reached)
        classes[1, left] = np.cumsum(left_shared < reached)
        on = np.flatnonzero((least <= reached) & (reached <= most))
        _, first, same, count = np.unique(classes[0, on] * (n + 1) + classes[1, on], return_index=True, return_inverse=True, return_counts=True)
        again = ((count > 1) | (np.bincount(same, many[on], minlength=len(count)) > 0))[same]
        copy = (first[same] != np.arange(len(on)))[again]
        found.append((on[again], np.full(len(copy), reached), copy))
    return tuple(map(np.concatenate, zip(*found)))


def united(doc: np.ndarray, start: np.ndarray, stop: np.ndarray, copy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The spans of each document and kind with those that meet or overlap made one."""
    if not len(doc):
        return doc, start, stop, copy
    order = np.lexsort((start, doc, copy))
    doc, start, stop, copy = doc[order], start[order], stop[order], copy[order]
    other = np.concatenate(([True], (doc[1:] != doc[:-1]) | (copy[1:] != copy[:-1])))
    group = np.cumsum(other)
    rank = np.unique(np.concatenate([start, stop]), return_inverse=True)[1]  # small numbers, so that groups can be kept apart
    width = int(rank.max()) + 1
    reached = np.maximum.accumulate(rank[len(start) :] + group * width) - group * width
    new = np.flatnonzero(other | np.concatenate(([True], rank[1 : len(start)] > reached[:-1])))
    last = np.append(new[1:], len(doc)) - 1
    values = np.empty(width, np.int64)
    values[rank] = np.concatenate([start, stop])
    return doc[new], start[new], values[reached[last]], copy[new]


def _dealt(part: np.ndarray, **columns) -> pa.RecordBatch:
    """A row for each part, with that part's values of each column as bytes; of binary values also their sizes."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    cut = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    arrays, names = [pa.array(part[cut[:-1]], pa.int64())], ["part"]
    for name, c in columns.items():
        if isinstance(c, pa.Array):
            raw, off = tx.raw_bytes(c.take(pa.array(order)))
            arrays.append(pa.array([raw[off[a] : off[z]].tobytes() for a, z in zip(cut, cut[1:])], pa.binary()))
            names.append(name)
            name, c = f"{name}_size", np.diff(off).astype(np.int32)
        else:
            c = c[order]
        arrays.append(pa.array([c[a:z].tobytes() for a, z in zip(cut, cut[1:])], pa.binary()))
        names.append(name)
    return pa.RecordBatch.from_arrays(arrays, names)


def _held(group: pa.Table, **kinds) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(group.column(c).to_pylist()), k) for c, k in kinds.items()]


def _bitmap(spark: SparkSession, scratch: Scratch, docs: DataFrame, words: int, parts: int) -> tuple[bytes, int]:
    """(bits set for the keys of prefixes that are kept twice or more, how many bits of a key name its place)."""
    top = U(64 - (parts.bit_length() - 1))

    def keys(batches):
        got, held = [], 0
        for b in tx.slices(batches, "text", SLICE):
            got.append(Suffixes(*tx.utf8(b.column("text")), words).key)
            held += len(got[-1])
            if held >= FLUSH:
                yield rows(got)
                got, held = [], 0
        if held:
            yield rows(got)

    def rows(got):
        key, n = np.unique(np.concatenate(got), return_counts=True)  # what repeats here is passed on as such
        return _dealt((key >> top).astype(np.int64), key=key, many=n > 1)

    def repeated(batches):
        for g in runs(batches, ["part"]):
            key, many = _held(g, key=U, many=bool)
            order = np.argsort(key)
            key, many = key[order], many[order].copy()
            many[1:] |= key[1:] == key[:-1]
            if many.any():
                yield pa.RecordBatch.from_arrays([g.column("part")[:1].combine_chunks(), pa.array([np.unique(key[many]).tobytes()], pa.binary())], ["part", "keys"])

    kept = docs.mapInArrow(keys, "part long, key binary, many binary").repartition("part").sortWithinPartitions("part")
    found = scratch.save(kept.mapInArrow(repeated, "part long, keys binary"), "repeated")
    n = (found.agg(F.sum(F.length("keys"))).first()[0] or 0) // 8
    bits = min(max((8 * n).bit_length(), parts.bit_length() + 2), MOST)
    width = 1 << (bits - (parts.bit_length() - 1))  # bits of a part

    def mark(batches):
        for b in batches:
            for part, raw in zip(b.column("part").to_pylist(), b.column("keys").to_pylist()):
                on = np.zeros(width, np.uint8)
                on[(np.frombuffer(raw, U) >> U(64 - bits)).astype(np.int64) - part * width] = 1
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())], ["part", "marks"])

    out = np.zeros(1 << (bits - 3), np.uint8)
    got = found.mapInArrow(mark, "part long, marks binary").toArrow()  # 2**MOST bits at most
    for part, raw in zip(got.column("part").to_pylist(), got.column("marks").to_pylist()):
        out[part * width // 8 : (part + 1) * width // 8] = np.frombuffer(raw, np.uint8)
    scratch.drop(found)
    return out.tobytes(), bits


def spans(spark: SparkSession, docs: DataFrame, words: int = WORDS, key: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """(doc_id, first_word, end_word, is_copy): maximal spans of repeated windows.

    is_copy: the span is made of windows that occur at a smaller place too. Words of originals
    are in spans with is_copy false; spans of the two kinds may overlap.
    row: a column that numbers the rows of an id (under 2**31); spans then have it as `row`, and
    places are ordered by (doc_id, row, word).
    """
    scratch = Scratch(spark, "suffixes")
    number = [F.col(row).cast("long").alias("row")] if row else []
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), *number).where("doc_id is not null and text is not null")
    parts = 1 << max(9, (4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    top = U(64 - (parts.bit_length() - 1))
    marks, bits = _bitmap(spark, scratch, docs, words, parts)
    sent = spark.sparkContext.broadcast(marks)

    def marked(batches):
        marks = np.frombuffer(sent.value, np.uint8)
        got, held = [], 0
        for b in tx.slices(batches, "text", SLICE):
            s = Suffixes(*tx.utf8(b.column("text")), words)
            slot = (s.key >> U(64 - bits)).astype(np.int64)
            on = np.flatnonzero(marks[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
            if not len(on):
                continue
            at = s.place[on] - s.first[s.doc[on]]
            if row:
                at += b.column("row").to_numpy()[s.doc[on]] << ROW
            got.append((s.key[on], b.column("doc_id").to_numpy()[s.doc[on]], at, s.least[on], s.most[on], s.reach_of(on)))
            held += got[-1][-1].nbytes
            if held >= FLUSH_BYTES:
                yield from settle(got)
                got, held = [], 0
                tx.trim()
        if got:
            yield from settle(got)

    def settle(got):
        *columns, reach = zip(*got)
        hash_, doc, at, least, most = map(np.concatenate, columns)
        reach = pa.concat_arrays(reach).dictionary_encode()
        code = reach.indices.to_numpy()
        order = np.lexsort((at, doc, code))
        hash_, doc, at, least, most, code = (x[order] for x in (hash_, doc, at, least, most, code))
        first = np.concatenate(([True], code[1:] != code[:-1]))
        many = np.concatenate((~first[1:], [False]))[first]
        sent = _dealt((hash_[first] >> top).astype(np.int64), doc=doc[first], at=at[first], many=many, reach=reach.dictionary)
        yield sent.append_column("stop", pa.nulls(sent.num_rows, pa.binary()))
        if not first.all():
            rest = ~first
            copies = united(doc[rest], at[rest] - most[rest], at[rest] - least[rest] + words, np.ones(int(rest.sum()), bool))
            part = _of(copies[0], parts)
            rows = _dealt(part, doc=copies[0], at=copies[1], stop=copies[2])
            none = pa.nulls(rows.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column("part"), rows.column("doc"), rows.column("at"), none, none, none, rows.column("stop")], [*FOUND])

    def compare(batches):
        for g in runs(batches, ["part"]):
            doc, at, many, size = _held(g, doc=np.int64, at=np.int64, many=bool, reach_size=np.int32)
            raw = b"".join(g.column("reach").to_pylist())
            off = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
            reach = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(off), pa.py_buffer(raw)])
            order = np.lexsort((at, doc))
            doc, at = doc[order], at[order]
            of, left, copy = repeats(reach.take(pa.array(order)), many[order], words)
            if len(of):
                doc, start, stop, copy = united(doc[of], at[of] - left, at[of] - left + words, copy)
                yield _dealt(_of(doc, parts), doc=doc, at=start, stop=stop, copy=copy)

    found = scratch.save(docs.mapInArrow(marked, ", ".join(f"{c} {'long' if c == 'part' else 'binary'}" for c in FOUND)), "reaches")
    met = found.where("stop is null").drop("stop").repartition("part").sortWithinPartitions("part").mapInArrow(compare, "part long, doc binary, at binary, stop binary, copy binary")
    settled = found.where("stop is not null").select("part", "doc", "at", "stop", F.lit(None).cast("binary").alias("copy"))
    names = ["doc_id", "first_word", "end_word", "is_copy", *["row"] * bool(row)]

    def merge(batches):
        for g in runs(batches, ["part"]):
            doc, at, stop = _held(g, doc=np.int64, at=np.int64, stop=np.int64)
            copy = np.frombuffer(b"".join(c if c is not None else b"\1" * (len(d) // 8) for c, d in zip(g.column("copy").to_pylist(), g.column("doc").to_pylist())), bool)
            doc, at, stop, copy = united(doc, at, stop, copy)
            word = (1 << ROW) - 1
            extra = [pa.array(at >> ROW)] if row else []
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(at & word), pa.array(stop & word), pa.array(copy), *extra], names)

    places = met.unionByName(settled).repartition("part").sortWithinPartitions("part")
    return places.mapInArrow(merge, "doc_id long, first_word long, end_word long, is_copy boolean" + ", row long" * bool(row))


def _of(doc: np.ndarray, parts: int) -> np.ndarray:
    return (tx.mix(doc.astype(U)) & U(parts - 1)).astype(np.int64)


def _numbered(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, bool]:
    """(row, key, t, nth): docs as structs, their id and text, and a number that tells rows of one id apart; whether any id repeats.

    Rows that repeat an id are written out first, so that each keeps its number when read again.
    """
    scratch = Scratch(spark, "numbered")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("key"), F.col("text").alias("t"))
    ids = scratch.save(rows.where("key is not null").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "ids")
    if ids.isEmpty():
        return rows.withColumn("nth", F.lit(0).cast("long")), False
    again = scratch.save(rows.join(ids, "key", "left_semi").select("row", "key", "t").withColumn("nth", F.monotonically_increasing_id()), "rows")
    part, at = F.shiftright("nth", 33), F.col("nth").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r.part, r.n) for r in again.groupBy(part.alias("part")).agg((F.max(at) + 1).alias("n")).collect())  # a row per task
    starts, total = [], 0
    for p, n in sizes:
        starts.append((p, total))
        total += n
    starts = F.broadcast(spark.createDataFrame(starts, "part long, start long"))
    again = again.join(starts, part == F.col("part")).select("row", "key", "t", (F.col("start") + at).alias("nth"))
    return rows.join(ids, "key", "left_anti").select("row", "key", "t", F.lit(0).cast("long").alias("nth")).unionByName(again), True


def cut_copies(spark: SparkSession, docs: DataFrame, words: int = WORDS) -> DataFrame:
    """docs with the words of copies cut out of text; the original of each window stays, as does all other text.

    n_chars, where there is such a column, follows the text. Rows stay even if their text is all copies;
    of rows that repeat id and text, one keeps the text.
    """
    names = docs.columns
    rows, repeat = _numbered(spark, docs)
    found = spans(spark, rows, words, key="key", text="t", row="nth" if repeat else None).where("is_copy")
    nth = F.col("row") if repeat else F.lit(0).cast("long")
    found = found.select(F.col("doc_id").alias("id"), nth.alias("id_nth"), F.struct("first_word", "end_word").alias("span"))
    found = found.groupBy("id", "id_nth").agg(F.array_sort(F.collect_list("span")).alias("spans"))  # of one row, as long as its text at most
    scratch = Scratch(spark, "cut")
    found = scratch.save(found, "spans")
    near, _ = sifted(scratch, rows.withColumnRenamed("key", "doc_id"), found.select(F.col("id").alias("doc_id")), found.count())
    near = near.select("maybe", "row.row", F.col("row.doc_id").alias("key"), "row.t", "row.nth")
    whole = near.where("not maybe").drop("maybe").withColumn("spans", F.lit(None).cast(found.schema["spans"].dataType))  # these texts don't travel
    met = near.where("maybe").drop("maybe").join(found, (F.col("key") == F.col("id")) & (F.col("nth") == F.col("id_nth")), "left")
    rows = whole.unionByName(met.drop("id", "id_nth"))

    def cut(batches):
        for b in tx.slices(batches, "t"):
            texts = []
            for text, at in zip(b.column("t").to_pylist(), b.column("spans").to_pylist()):
                if at and text:
                    raw = np.frombuffer(text.encode(), np.uint8)
                    begin = np.append(tx.words(raw, np.array([0, len(raw)]))[0], len(raw))
                    keep = np.ones(len(raw), bool)
                    for s in at:
                        keep[begin[s["first_word"]] : begin[s["end_word"]]] = False
                    text = raw[keep].tobytes().decode()
                texts.append(text)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string())], ["row", "t"])

    out = rows.select("row", "t", "spans").mapInArrow(cut, T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("t", T.StringType())]))
    new = {"text": F.col("t"), "n_chars": F.char_length("t").cast("long")}
    return out.select(*(new[n].alias(n) if n in new else F.col("row")[n].alias(n) for n in names))
