"""Vectorised text primitives over Arrow batches: slices, words, word hashes and shingles.

Everything works on the UTF-8 buffers themselves, so that a batch costs a few numpy calls
and no Python object per word.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
#: Bytes that separate words: space and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes outside letters, digits and non-ASCII characters.
NOT_ALNUM = np.array([not (chr(b).isalnum() or b >= 128) for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_LONG = 64
_LIBC = ctypes.CDLL(None) if sys.platform == "linux" and hasattr(ctypes.CDLL(None), "malloc_trim") else None


def slices(batches: Iterable[pa.RecordBatch], column: str, size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about `size` bytes of the text column."""
    for batch in batches:
        if not batch.num_rows:
            continue
        total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        cuts = np.unique(np.searchsorted(total, np.arange(size, total[-1], size), side="right")) if total[-1] > size else []
        edges = [0, *(int(c) for c in cuts if 0 < c < batch.num_rows), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)
    trim()


def trim() -> None:
    """Gives freed memory back to the system: workers live on after a task, beside others on their executor."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def utf8(col: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, in lower case if asked for; null counts as empty."""
    col = pc.fill_null(col, "").cast(pa.large_string())
    col = pc.utf8_lower(col) if lower else col
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def raw_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large binary column without nulls."""
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def words(data: np.ndarray, off: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, first): byte ranges of all words, and each document's first word (length: documents + 1)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    inside = ~apart[data]
    begin, last = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = off[(off > 0) & (off < n)]
    begin[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    b = np.flatnonzero(begin)
    return b, np.flatnonzero(last) + 1, np.searchsorted(b, off)


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words with A-Z lower-cased."""
    if not len(begin):
        return np.zeros(0, U64)
    low = LOWER[data]
    size = np.minimum(end - begin, _LONG + 1).astype(np.uint8)
    order = np.argsort(size, kind="stable")
    at, sizes = begin[order], size[order]
    h = np.full(len(begin), 0xCBF29CE484222325, U64)
    first = np.searchsorted(sizes, np.arange(_LONG + 1), side="right")
    stop = first[_LONG]
    for j in range(int(sizes[stop - 1]) if stop else 0):
        p = first[j]
        h[p:stop] = (h[p:stop] ^ low[at[p:stop] + j].astype(U64)) * U64(0x100000001B3)
    for k in range(stop, len(at)):
        h[k] = xxhash.xxh3_64_intdigest(low[at[k] : end[order[k]]].tobytes())
    out = np.empty_like(h)
    out[order] = mix(h)
    return out


_TURN = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def combine(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n hashes, in order; at most len(h) - n + 1 of them."""
    if len(h) < n:
        return np.zeros(0, U64)
    out = np.zeros(len(h) - n + 1, U64)
    for j in range(n):
        out = mix(out * _TURN[0] + h[j : len(h) - n + 1 + j]) if n > len(_TURN) else out + h[j : len(h) - n + 1 + j] * _TURN[j]
    return mix(out + U64(n))


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int) -> list[np.ndarray]:
    """For each document the sorted distinct hashes of its n-word shingles.

    With fewer words than n, the whole sequence is the one shingle; without words the set is empty.
    """
    begin, end, first = words(data, off)
    h = word_hashes(data, begin, end)
    runs = combine(h, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(runs[a : b - n + 1]))
        else:
            out.append(combine(h[a:b], b - a) if b > a else np.zeros(0, U64))
    return out


class Chunks:
    """A slice of texts split at single spaces, with a code for every chunk and the distinct chunks."""

    def __init__(self, texts: list[str]):
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        self.codes = coded.indices.to_numpy()
        self.offsets = split.offsets.to_numpy()
        self.distinct: list[str] = coded.dictionary.to_pylist()

    def join(self, ids: list[bytes], first: bool = True) -> list[bytes]:
        """Each text's ids (little-endian 32 bits) joined by position from those of the distinct chunks.

        first: False leaves each text's first chunk out.
        """
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        return gathered(self.codes, self.offsets, np.frombuffer(b"".join(ids), "<u4"), size, first)


def gathered(codes: np.ndarray, offsets: np.ndarray, flat: np.ndarray, size: np.ndarray, first: bool = True) -> list[bytes]:
    """The ids (little-endian 32 bits) of each run of codes, out of the ids of all codes and how many each has; first: False leaves the first code of each run out."""
    n, at = size[codes], (np.cumsum(size) - size)[codes]
    if not first and len(n):
        n[offsets[:-1]] = 0
    end = np.cumsum(n)
    out = flat[np.repeat(at - end + n, n) + np.arange(end[-1] if len(end) else 0)].tobytes()
    edge = (4 * np.concatenate(([0], end))[offsets]).tolist()
    return [out[a:b] for a, b in zip(edge, edge[1:])]
