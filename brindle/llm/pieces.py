"""SentencePiece encoding and decoding with a table of distinct chunks.

Where no piece of the vocabulary crosses from another character to the whitespace marker
(checked when the model is loaded), a text falls into chunks of spaces followed by other
characters, and chunks never affect each other. Texts are split into chunks slice by slice and written as
codes of the slice's distinct chunks. The distinct chunks of all slices are dealt out by hash and make one table, part by part, in which the library segments
and decodes each chunk once in the whole corpus; the ids go back to the slices that
asked, in the order of their codes, and each text's ids are put together by position; decoded texts are put together from
the pieces of their ids, or by the library where these are no plain text. Chunks and ids travel as sorted, compressed
lists, one for each slice and part. A slice asks for a chunk once however often it
occurs, so a frequent chunk weighs no more than there are slices; memory is that of a slice of SLICE bytes or of its longest text, or of a part of the table.

Nulls and edges: null counts as empty text; an empty text has the begin and end ids alone and
decodes to empty text; keys of any type, also null; rows repeat as often as the input has them; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from brindle.llm import text as tx
from brindle.llm.neardup import runs
from brindle.llm.tables import Scratch

MODEL = "piece_bpe_32k.model"
SLICE = 1 << 25
GATHER = 1 << 19  # chunks whose ids are put together at once
_CHUNK = re.compile(" +[^ ]*")
_MARK = "▁"


def split(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct chunks without their first space, codes of all texts' chunks, where each text's codes begin and end)."""
    texts = [t.replace(_MARK, " ") if _MARK in t else t for t in texts]
    spaced = {k: [c[1:] for c in _CHUNK.findall(" " + t)] for k, t in enumerate(texts) if "  " in t or t[:1] == " "}
    plain = tx.Chunks(["" if k in spaced else t for k, t in enumerate(texts)])
    distinct, codes, at = plain.distinct, plain.codes, plain.offsets
    parts = [codes[at[k] : at[k + 1]] if t else codes[:0] for k, t in enumerate(texts)]
    if spaced:
        code = {c: i for i, c in enumerate(distinct)}
        for k, own in spaced.items():
            parts[k] = np.fromiter((code.setdefault(c, len(code)) for c in own), np.int32, len(own))
        distinct = list(code)
    return distinct, np.concatenate([np.zeros(0, np.int32), *parts]).astype(np.int32), np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64)))


class Segmenter:
    """The library's segmentation of chunks, many in a call."""

    def __init__(self, path: str):
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        crossing = [p for p in map(sp.id_to_piece, range(sp.vocab_size())) if re.search(f"[^{_MARK}]{_MARK}", p)]
        if crossing:
            raise ValueError(f"pieces cross whitespace markers: {crossing[:5]}")
        self.lead = sp.encode("a")
        self.marked = np.array([sp.id_to_piece(i).startswith(_MARK) for i in range(sp.vocab_size())])
        self.space = [sp.piece_to_id(_MARK)]
        pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        self.plain = np.array([not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(sp.vocab_size())])
        self.text = [p.replace(_MARK, " ").encode() for p in pieces]
        self.begin, self.end = (np.array([i], "<u4").tobytes() for i in (sp.bos_id(), sp.eos_id()))

    def __call__(self, chunks: list[str]) -> Iterator[tuple[str, bytes]]:
        """(chunk, ids as little-endian bytes), many chunks in a call of the library."""
        plain = [c for c in chunks if c and " " not in c]
        for k in range(0, len(plain), 2000):
            part = plain[k : k + 2000]
            raw = np.array(self.sp.encode(" ".join(part)), "<u4")
            edge = np.append(np.flatnonzero(self.marked[raw]), len(raw))
            raw, edge = raw.tobytes(), (4 * edge).tolist()
            if len(part) != len(edge) - 1:
                raise ValueError("chunks and pieces don't agree")
            yield from zip(part, [raw[a:b] for a, b in zip(edge, edge[1:])])
        for c in chunks:
            if not c or " " in c:
                yield c, np.array(self.sp.encode(c) or self.space, "<u4").tobytes()

    def decode(self, texts: list[bytes]) -> list[str]:
        """decode(ids) of each list of ids (little-endian bytes, without begin and end)."""
        ids = np.frombuffer(b"".join(texts), "<u4")
        at = np.concatenate(([0], np.cumsum([len(t) // 4 for t in texts], dtype=np.int64)))
        odd = np.concatenate(([0], np.cumsum(~self.plain[ids], dtype=np.int64)))
        odd = odd[at[1:]] > odd[at[:-1]]
        out = []
        for k, (a, z) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
            t = b"" if odd[k] else b"".join([self.text[i] for i in ids[a:z].tolist()])
            if odd[k] or t[:2] == b"  " or t[:1] != b" ":
                out.append(self.sp.decode(ids[a:z].tolist()))
            else:
                out.append(t[1:].decode())
        return out


@lru_cache(maxsize=2)
def segmenter(path: str) -> Segmenter:
    return Segmenter(path)


def squeezed(values: np.ndarray) -> bytes:
    """Numbers, byte by byte of all of them, compressed."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes())


def expanded(value: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(value), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def ranked(codes: np.ndarray) -> bytes:
    """Codes, written by how frequent they are, which takes fewer bytes, and the codes by frequency."""
    by = np.argsort(-np.bincount(codes), kind="stable").astype(np.int32) if len(codes) else codes
    rank = np.empty_like(by)
    rank[by] = np.arange(len(by), dtype=np.int32)
    first, second = squeezed(by), squeezed(rank[codes])
    return len(first).to_bytes(8, "little") + first + second


def unranked(value: bytes) -> np.ndarray:
    cut = 8 + int.from_bytes(value[:8], "little")
    return expanded(value[8:cut], np.int32)[expanded(value[cut:], np.int32)]


def dealt(distinct: list[str], codes: np.ndarray, parts: int) -> tuple[np.ndarray, list[int], list[bytes], list[bytes]]:
    """(codes in the order of parts and texts, parts, the sizes and the bytes of the chunks of each part in that order).

    Chunks that begin alike are in one part, so that their list compresses well.
    """
    chunks = pa.array(distinct, pa.large_string())
    raw, off = tx.raw_bytes(chunks.cast(pa.large_binary()))
    part = (tx.mix(tx.word_hashes(raw, off[:-1], np.minimum(off[1:], off[:-1] + 4))) % np.uint64(parts)).astype(np.int64)
    rank = np.empty(len(part), np.int64)
    rank[pc.sort_indices(chunks).to_numpy()] = np.arange(len(part))
    order = np.lexsort((rank, part))
    new = np.empty(len(part), np.int32)
    new[order] = np.arange(len(part))
    part, (raw, off) = part[order], tx.raw_bytes(chunks.cast(pa.large_binary()).take(pa.array(order)))
    cut = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)] if len(part) else [0]
    spans, pack = list(zip(cut, cut[1:])), zstandard.ZstdCompressor(level=6)
    return new[codes], part[cut[:-1]].tolist(), [squeezed(np.diff(off[x : z + 1]).astype(np.uint32)) for x, z in spans], [pack.compress(raw[off[x] : off[z]].tobytes()) for x, z in spans]


def encode(spark: SparkSession, docs: DataFrame, path: str, key: str, text: str, schema: str, arrays) -> DataFrame:
    """(key, ...) of every row: the columns that `arrays` makes of [(ids with begin and end as little-endian bytes, decoded text)]; schema names them."""
    scratch = Scratch(spark, "pieces")
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = rows.schema["k"].dataType
    parts = max(256, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))

    def code(batches):
        task, n = TaskContext.get().partitionId(), 0
        for b in tx.slices(batches, "t", SLICE):
            distinct, codes, at = split([x or "" for x in b.column("t").to_pylist()])
            codes, *lists = dealt(distinct, codes, parts)
            cols = [pa.array([task << 32 | n], pa.int64()), pa.array([ranked(codes)], pa.binary()), pa.array([squeezed(at)], pa.binary()), pa.array([b.column("k").to_pylist()], pa.list_(b.schema.field("k").type))]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array([x], pa.list_(t)) for x, t in zip(lists, (pa.int32(), pa.binary(), pa.binary())))], names)
            n += 1

    names = ["slice", "codes", "ends", "keys", "parts", "sizes", "chunks"]
    kinds = [T.LongType(), T.BinaryType(), T.BinaryType(), T.ArrayType(kind), T.ArrayType(T.IntegerType()), T.ArrayType(T.BinaryType()), T.ArrayType(T.BinaryType())]
    coded = scratch.save(rows.mapInArrow(code, T.StructType([T.StructField(c, t) for c, t in zip(names, kinds)])), "coded")
    asked = coded.select("slice", F.explode(F.arrays_zip("parts", "sizes", "chunks")).alias("x")).select("slice", F.col("x.parts").alias("part"), F.col("x.sizes").alias("sizes"), F.col("x.chunks").alias("chunks"))

    def segment(batches):
        s, unpack = segmenter(path), zstandard.ZstdDecompressor()
        narrow = np.uint16 if len(s.plain) <= 1 << 16 else np.uint32
        for g in runs(batches, ["part"]):
            lists = []
            for size, raw in zip(g.column("sizes").to_pylist(), g.column("chunks").to_pylist()):
                off = np.concatenate(([0], np.cumsum(expanded(size, np.uint32), dtype=np.int64)))
                lists.append(pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(off), pa.py_buffer(unpack.decompress(raw))))
            table = pa.concat_arrays(lists).dictionary_encode()
            chunks = table.dictionary.to_pylist()
            known = dict(s(chunks))
            ids = pa.array([known[c] for c in chunks], pa.large_binary())
            at = 0
            for of, own in zip(g.column("slice").to_pylist(), lists):
                raw, off = tx.raw_bytes(ids.take(table.indices.slice(at, len(own))))
                at += len(own)
                cols = [squeezed((np.diff(off) // 4).astype(np.uint32)), squeezed(raw.view("<u4").astype(narrow))]
                yield pa.RecordBatch.from_arrays([pa.array([of], pa.int64()), g.column("part")[:1].combine_chunks(), *(pa.array([c], pa.binary()) for c in cols)], ["slice", "part", "counts", "ids"])

    known = asked.repartition("part").sortWithinPartitions("part").mapInArrow(segment, "slice long, part int, counts binary, ids binary")
    slices = coded.select("slice", F.lit(-1).alias("part"), "codes", "ends", "keys")
    both = slices.unionByName(known, allowMissingColumns=True).repartition("slice").sortWithinPartitions("slice", "part")
    struct = T.StructType.fromDDL(schema)
    columns, key_type = [key, *struct.names], to_arrow_type(kind)

    def join(batches):
        s = segmenter(path)
        narrow = np.uint16 if len(s.plain) <= 1 << 16 else np.uint32
        for g in runs(batches, ["slice"]):
            codes, at = unranked(g.column("codes")[0].as_py()), expanded(g.column("ends")[0].as_py(), np.int64)
            counts, ids = ([expanded(x, t) for x in g.column(c).to_pylist()[1:]] for c, t in (("counts", np.uint32), ("ids", narrow)))
            flat, size = np.concatenate([np.zeros(0, narrow), *ids]).astype("<u4"), np.concatenate([np.zeros(0, np.uint32), *counts]).astype(np.int64)
            keys, cut = g.column("keys")[0].as_py(), np.searchsorted(at, np.arange(0, at[-1], GATHER)) if len(codes) else []
            edges = sorted({0, len(keys), *(int(c) for c in cut)})
            for x, z in zip(edges, edges[1:]):  # some texts at a time
                made = tx.gathered(codes[at[x] : at[z]], at[x : z + 1] - at[x], flat, size)
                yield pa.RecordBatch.from_arrays([pa.array(keys[x:z], key_type), *arrays([(s.begin + i + s.end, d) for i, d in zip(made, s.decode(made))])], columns)

    return both.mapInArrow(join, T.StructType([T.StructField(key, kind), *struct.fields]))


def round_trip(spark: SparkSession, docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (array<int>, with begin and end) and decoded text of every row."""
    return encode(spark, docs, path, key, text, "ids array<int>, decoded string", lambda made: [pa.array([np.frombuffer(i, "<i4") for i, _ in made], pa.list_(pa.int32())), pa.array([d for _, d in made], pa.string())])


def digests(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row."""
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return encode(
        spark, docs, path, "doc_id", "text", "n_tokens long, ids_sha256 string, decoded_sha256 string",
        lambda made: [pa.array([len(i) // 4 for i, _ in made], pa.int64()), pa.array([sha(i) for i, _ in made], pa.string()), pa.array([sha(d.encode()) for _, d in made], pa.string())],
    )
