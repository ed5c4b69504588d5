"""AVI motion-JPEG: RIFF parsing, intra-frame decoding and shot detection.

`clips` reads AVI files from a binary column: the RIFF tree and its idx1 index give the
frames, each frame is a baseline JPEG of its own, and a cut is where the histogram difference
of neighbouring frames exceeds what the shot so far makes likely. `store` goes the other way
and keeps any bytes losslessly in such a file: 64 payload bytes are the 64 quantised
coefficients of one 8x8 block. JPEG rounds pixels but codes quantised coefficients exactly,
so the coefficient, 8 bits of it, is the format's unit here. Byte b is coefficient 256 + b,
which makes all codes ten bits long, and a restart marker after each block keeps DC values
independent; both sides are then plain numpy. Frames of any other table layout go through the
general decoder, which looks codes up sixteen bits at a time; frames without Huffman tables have the standard ones.

Nulls and edges: null text counts as empty and gives a payload of 64 zero bytes; a null
file and one without frames have no clips; frames that can't be decoded, whatever is wrong with them, are skipped and counted in
`failed`, and a file that has no other frames is one row without clip; rows
repeat as often as the input has them; ids of any type; other columns play no part. A file is held whole in memory.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import text as tx

FPS = 25
BINS = 16
_ROW, _TALL = 8, 8  # blocks in a row, rows in a frame
_UNIT = 64


@lru_cache(maxsize=1)
def zigzag() -> np.ndarray:
    """Row-major place of each coefficient in coding order: along the anti-diagonals, turning each time."""
    return np.array([8 * y + x for y, x in sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))])


@lru_cache(maxsize=1)
def idct() -> np.ndarray:
    """64x64 matrix from coefficients (row-major) to pixels."""
    u, x = np.arange(8)[:, None], np.arange(8)[None]
    c = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)
    return np.kron(c, c).astype(np.float32)


# Fixed values of the format: how many codes of each length, and the symbols that come first; all others follow in ascending order
_DC_BRIGHT = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]
_DC_COLOUR = [0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]
_AC_BRIGHT = [0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]
_AC_COLOUR = [0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119]
_BRIGHT_FIRST = [
    0x01, 0x02, 0x03, 0x00, 0x04, 0x11, 0x05, 0x12, 0x21, 0x31, 0x41, 0x06, 0x13, 0x51, 0x61, 0x07, 0x22, 0x71, 0x14, 0x32,
    0x81, 0x91, 0xA1, 0x08, 0x23, 0x42, 0xB1, 0xC1, 0x15, 0x52, 0xD1, 0xF0, 0x24, 0x33, 0x62, 0x72, 0x82,
]
_COLOUR_FIRST = [
    0x00, 0x01, 0x02, 0x03, 0x11, 0x04, 0x05, 0x21, 0x31, 0x06, 0x12, 0x41, 0x51, 0x07, 0x61, 0x71, 0x13, 0x22, 0x32, 0x81, 0x08, 0x14,
    0x42, 0x91, 0xA1, 0xB1, 0xC1, 0x09, 0x23, 0x33, 0x52, 0xF0, 0x15, 0x62, 0x72, 0xD1, 0x0A, 0x16, 0x24, 0x34, 0xE1, 0x25, 0xF1,
]


@lru_cache(maxsize=1)
def standard_tables() -> dict[int, tuple[bytes, bytes]]:
    """(counts by length, symbols) of the tables that a frame without its own has, by class and number."""
    every = sorted({0x00, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))})
    ac = lambda first: bytes([*first, *(x for x in every if x not in first)])
    dc = bytes(range(12))
    return {0x00: (bytes(_DC_BRIGHT), dc), 0x01: (bytes(_DC_COLOUR), dc), 0x10: (bytes(_AC_BRIGHT), ac(_BRIGHT_FIRST)), 0x11: (bytes(_AC_COLOUR), ac(_COLOUR_FIRST))}


@lru_cache(maxsize=64)
def _lookup(counts: bytes, symbols: bytes) -> list[int]:
    """For every sixteen bits: length << 8 | symbol of the code that they begin with, 0 if none."""
    out, code, k = np.zeros(1 << 16, np.int32), 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            if code >> length or k >= len(symbols):
                raise ValueError("codes overflow")
            out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out.tolist()


# --- writing -----------------------------------------------------------------------------


def _segment(mark: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body


@lru_cache(maxsize=64)
def _head(blocks_wide: int, blocks_tall: int) -> bytes:
    """All of a frame before its scan: unit quantisation, one Huffman code a table, restarts after each block."""
    code = bytes([1] + [0] * 15 + [9])
    return b"".join(
        [
            b"\xff\xd8",
            _segment(0xDB, b"\x00" + b"\x01" * 64),
            _segment(0xC0, struct.pack(">BHHBBBB", 8, 8 * blocks_tall, 8 * blocks_wide, 1, 1, 0x11, 0)),
            _segment(0xC4, b"\x00" + code),
            _segment(0xC4, b"\x10" + code),
            _segment(0xDD, b"\x00\x01"),
            _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
        ]
    )


def encode_frame(payload: np.ndarray, blocks_wide: int) -> bytes:
    """A greyscale JPEG whose coefficients are 256 + payload bytes, 64 a block."""
    blocks = len(payload) // _UNIT
    v = payload.reshape(-1, 4).astype(np.uint64) | np.uint64(256)
    x = v[:, 0] << np.uint64(30) | v[:, 1] << np.uint64(20) | v[:, 2] << np.uint64(10) | v[:, 3]
    scan = x.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].reshape(-1)
    size = len(scan) // blocks
    marks = np.arange(blocks - 1)
    stuffed = scan == 255
    at = np.arange(len(scan)) + np.cumsum(stuffed) - stuffed + 2 * (np.arange(len(scan)) // size)
    out = np.zeros(len(scan) + int(stuffed.sum()) + 2 * len(marks), np.uint8)
    out[at] = scan
    last = at[size - 1 : -1 : size] + 1 + stuffed[size - 1 : -1 : size] if blocks > 1 else marks
    out[last] = 255
    out[last + 1] = 0xD0 + marks % 8
    return _head(blocks_wide, blocks // blocks_wide) + out.tobytes() + b"\xff\xd9"


def _chunk(tag: bytes, body: bytes) -> bytes:
    return tag + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(frames: list[bytes], width: int, height: int, fps: int = FPS, comment: bytes = b"") -> bytes:
    """An AVI file of one motion-JPEG stream, with an idx1 index."""
    avih = struct.pack("<14I", 1_000_000 // fps, 0, 0, 0x10, len(frames), 0, 1, max(map(len, frames), default=0), width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(frames), 0, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    parts = [_chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))]
    if comment:
        parts.append(_chunk(b"LIST", b"INFO" + _chunk(b"ICMT", comment)))
    index, movi, at = [], [b"movi"], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movi.append(_chunk(b"00dc", f))
        at += len(movi[-1])
    return _chunk(b"RIFF", b"".join([b"AVI ", *parts, _chunk(b"LIST", b"".join(movi)), _chunk(b"idx1", b"".join(index))]))


def store(data: bytes) -> tuple[bytes, bytes]:
    """(payload, AVI file): data with bytes 0 up to a positive multiple of 64, and the file that holds it."""
    payload = data + b"\0" * ((-len(data)) % _UNIT or _UNIT * (not data))
    blocks = len(payload) // _UNIT
    rows = min(_TALL, -(-blocks // _ROW))
    frame = _UNIT * _ROW * rows
    padded = np.frombuffer(payload + b"\0" * (-len(payload) % frame), np.uint8)
    frames = [encode_frame(padded[k : k + frame], _ROW) for k in range(0, len(padded), frame)]
    return payload, write_avi(frames, 8 * _ROW, 8 * rows, comment=b"payload=%d" % len(payload))


# --- reading -----------------------------------------------------------------------------


def riff(data: bytes, start: int, stop: int, depth: int = 8) -> Iterator[tuple[bytes, int, int]]:
    """(tag, first byte, end) of every chunk, lists by their kind and then what is in them, `depth` levels down."""
    while start + 8 <= stop:
        tag, size = data[start : start + 4], struct.unpack_from("<I", data, start + 4)[0]
        body, end = start + 8, min(start + 8 + size, stop)
        if tag in (b"RIFF", b"LIST"):
            yield data[body : body + 4], body, end
            if depth:
                yield from riff(data, body + 4, end, depth - 1)
        else:
            yield tag, body, end
        start = body + size + size % 2


def open_avi(data: bytes) -> dict:
    """fps, comment and the frames' bytes; by idx1 if it fits the file, else by the movi list."""
    out = {"fps": float(FPS), "comment": b"", "frames": []}
    movi, walked, index = None, [], None
    for tag, a, b in riff(data, 0, len(data)):
        if tag == b"movi":
            movi = a
        elif tag == b"strh" and data[a : a + 4] == b"vids" and b - a >= 28:
            scale, rate = struct.unpack_from("<II", data, a + 20)
            out["fps"] = rate / scale if scale and rate else out["fps"]
        elif tag == b"ICMT":
            out["comment"] = data[a:b]
        elif tag == b"idx1":
            index = [struct.unpack_from("<4sIII", data, k) for k in range(a, b - 15, 16)]
        elif tag[2:] in (b"dc", b"db") and movi is not None:
            walked.append((a, b))
    if movi is not None and index:
        entries = [(at, size) for tag, _, at, size in index if tag[2:] in (b"dc", b"db")]
        for base in (movi, 0):
            spans = [(base + at + 8, base + at + 8 + size) for at, size in entries]
            if spans and all(data[a - 8 + 2 : a - 8 + 4] in (b"dc", b"db") and b <= len(data) for a, b in spans):
                walked = spans
                break
    out["frames"] = [data[a:b] for a, b in walked]
    return out


def decode_frame(data: bytes) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
    """(quantised luma coefficients (blocks, 64) in coding order, luma quantisation in coding order, (blocks wide, tall))."""
    quant, huff, restart, at = {}, dict(standard_tables()), 0, 2
    frame: list[tuple[int, int, int, int]] = []
    tables = None
    while at + 4 <= len(data):
        mark, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if mark == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                quant[body[k] & 15] = np.frombuffer(body[k + 1 : k + 1 + 64 * (1 + wide)], ">u2" if wide else np.uint8).astype(np.float32)
                k += 1 + 64 * (1 + wide)
        elif mark == 0xC4:
            k = 0
            while k < len(body):
                n = sum(body[k + 1 : k + 17])
                huff[body[k]] = (bytes(body[k + 1 : k + 17]), bytes(body[k + 17 : k + 17 + n]))
                k += 17 + n
        elif mark == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif mark == 0xC0:
            bits, tall, wide, n = struct.unpack_from(">BHHB", body)
            frame = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        elif 0xC1 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline frames are decoded")
        elif mark == 0xDA:
            tables = {body[1 + 2 * k]: (body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])}
            break
    if not frame or tables is None or not all(f[0] in tables and f[1] and f[2] for f in frame) or not wide or not tall:
        raise ValueError("no frame, no scan or no size")
    end = data.rfind(b"\xff\xd9")
    scan = data[at : end if end >= at else len(data)]
    if -(-wide // 8) * -(-tall // 8) > 4 * len(scan) + 4:  # a block takes two bits at least
        raise ValueError("more blocks than the scan can hold")
    one = (bytes([1] + [0] * 15), b"\x09")
    if len(frame) == 1 and restart == 1 and huff.get(0) == one and huff.get(0x10) == one:
        return _even(scan), quant[frame[0][3]], (-(-wide // 8), -(-tall // 8))
    return _general(scan, frame, tables, huff, restart, wide, tall), quant[frame[0][3]], (-(-wide // (8 * max(f[1] for f in frame))) * frame[0][1], -(-tall // (8 * max(f[2] for f in frame))) * frame[0][2])


def _even(scan: bytes) -> np.ndarray:
    """Coefficients of a scan whose codes are all ten bits long, a restart after each block."""
    s = np.frombuffer(scan, np.uint8)
    ff = np.flatnonzero(s[:-1] == 255) if len(s) else np.zeros(0, int)
    drop = np.zeros(len(s), bool)
    drop[ff + 1] = True
    drop[ff[s[ff + 1] != 0]] = True
    s = s[~drop].reshape(-1, 5).astype(np.uint64)
    x = s[:, 0] << np.uint64(32) | s[:, 1] << np.uint64(24) | s[:, 2] << np.uint64(16) | s[:, 3] << np.uint64(8) | s[:, 4]
    v = np.stack([x >> np.uint64(k) & np.uint64(0x3FF) for k in (30, 20, 10, 0)], 1)
    if (v >> np.uint64(8) != 1).any():
        raise ValueError("codes of another length")
    return v.reshape(-1, _UNIT).astype(np.int32)


def _general(scan: bytes, frame, tables, huff, restart: int, wide: int, tall: int) -> np.ndarray:
    """Luma coefficients of any baseline scan."""
    books = {key: _lookup(*t) for key, t in huff.items() if key in {k for dc, ac in tables.values() for k in (dc, 16 + ac)}}
    parts, a, k = [], 0, 0
    while (k := scan.find(b"\xff", k)) >= 0 and k + 1 < len(scan):
        if 0xD0 <= scan[k + 1] <= 0xD7:
            parts.append(scan[a:k])
            a = k + 2
        k += 2
    parts.append(scan[a:])
    h, v = max(f[1] for f in frame), max(f[2] for f in frame)
    across, down = -(-wide // (8 * h)), -(-tall // (8 * v))
    if len(frame) == 1:
        across, down, frame = -(-wide // 8), -(-tall // 8), [(frame[0][0], 1, 1, frame[0][3])]
    out = np.zeros((down * frame[0][2], across * frame[0][1], 64), np.int32)
    step = restart or across * down
    for p, part in enumerate(parts):
        raw = np.frombuffer(part.replace(b"\xff\x00", b"\xff") + b"\0\0\0\0", np.uint8).astype(np.int64)
        window = (raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]).tolist()  # 24 bits from each byte on
        at, last, stop = 0, [0] * len(frame), 8 * (len(raw) - 4)

        def symbol(book):
            nonlocal at
            found = book[window[at >> 3] >> (8 - (at & 7)) & 0xFFFF]
            at += found >> 8
            if not found or at > stop:
                raise ValueError("no such code")
            return found & 255

        def number(size):
            nonlocal at
            if not size:
                return 0
            value = window[at >> 3] >> (24 - (at & 7) - size) & ((1 << size) - 1)
            at += size
            if size > 16 or at > stop:
                raise ValueError("the scan ends in a number")
            return value if value >> size - 1 else value - (1 << size) + 1

        for mcu in range(p * step, min((p + 1) * step, across * down)):
            for c, (ident, ch, cv, _) in enumerate(frame):
                dc, ac = tables[ident]
                for y in range(cv):
                    for x in range(ch):
                        block = np.zeros(64, np.int32)
                        last[c] += number(symbol(books[dc]))
                        block[0] = last[c]
                        k = 1
                        while k < 64:
                            s = symbol(books[16 + ac])
                            if not s & 15:
                                if s != 0xF0:
                                    break
                                k += 16
                                continue
                            k += s >> 4
                            block[k] = number(s & 15)
                            k += 1
                        if c == 0:
                            out[mcu // across * cv + y, mcu % across * ch + x] = block
    return out.reshape(-1, 64)


def luma(coefficients: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """8-bit pixels, (blocks, 64)."""
    order = np.empty((len(coefficients), 64), np.float32)
    order[:, zigzag()] = coefficients * quant
    return np.clip(np.rint(order @ idct() + 128), 0, 255).astype(np.uint8)


def shots(histograms: np.ndarray, least: float = 0.1, spread: float = 3.0) -> list[tuple[int, int]]:
    """(first, last) frames of each shot: cuts where the difference of histograms exceeds
    both `least` and mean + spread * deviation of the differences within the shot so far."""
    out, begin, seen = [], 0, []
    p = histograms / np.maximum(histograms.sum(1, keepdims=True), 1)
    for k, d in enumerate((np.abs(np.diff(p, axis=0)).sum(1) / 2).tolist(), 1):
        if d > max(least, float(np.mean(seen) + spread * np.std(seen)) if seen else 0.0):
            out.append((begin, k - 1))
            begin, seen = k, []
        else:
            seen.append(d)
    return [*out, (begin, len(histograms) - 1)] if len(histograms) else []


def read(data: bytes) -> dict:
    """What a file holds: fps, comment, coefficients of all frames, histograms, shots and how many frames failed."""
    avi = open_avi(data)
    got, kept, failed = [], [], 0
    for k, f in enumerate(avi["frames"]):
        try:
            got.append(decode_frame(f))
            kept.append(k)
        except (ValueError, LookupError, ArithmeticError, TypeError, struct.error):  # whatever the bytes may say
            failed += 1
    hist = np.zeros((len(got), BINS), np.int64)
    for k, (c, q, _) in enumerate(got):
        hist[k] = np.bincount(luma(c, q).reshape(-1) >> 4, minlength=BINS)
    return avi | {"coefficients": [c for c, _, _ in got], "histograms": hist, "kept": kept, "failed": failed, "shots": shots(hist)}


def payload_of(got: dict) -> bytes:
    """The bytes that store() put in."""
    size = int(got["comment"].partition(b"=")[2])
    return b"".join((c - 256).astype(np.uint8).tobytes() for c in got["coefficients"])[:size]


def clips(df: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """Timed clip rows (key, clip, first_frame, last_frame, start_s, end_s, mean_luma, failed) of AVI files in a binary column.

    failed: how many frames of the file can't be decoded; where none can, clip is null.
    """

    def run(batches):
        for b in batches:
            rows = []
            for k, data in zip(b.column("k").to_pylist(), b.column("c").to_pylist()):
                got = read(data or b"")
                for n, (x, y) in enumerate(got["shots"]):
                    h = got["histograms"][x : y + 1].sum(0)
                    a, z = got["kept"][x], got["kept"][y]
                    rows.append((k, n, a, z, a / got["fps"], (z + 1) / got["fps"], float((h * (16 * np.arange(BINS) + 7.5)).sum() / h.sum()), got["failed"]))
                if got["failed"] and not got["shots"]:
                    rows.append((k, *[None] * 6, got["failed"]))
            cols = zip(*rows) if rows else [[]] * 8
            kinds = (b.schema.field("k").type, pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["key", "clip", "first_frame", "last_frame", "start_s", "end_s", "mean_luma", "failed"])

    rows = df.select(F.col(key).alias("k"), F.col(content).alias("c"))
    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, clip int, first_frame long, last_frame long, start_s double, end_s double, mean_luma double, failed long").withColumnRenamed("key", key)


def store_and_read(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Each whole text stored as an AVI file and read back: sizes, digests of what was read, and its clips as text."""

    def run(batches):
        for b in tx.slices(batches, "text"):
            data, off = tx.utf8(b.column("text"))
            raw, rows = data.tobytes(), []
            for a, z in zip(off[:-1].tolist(), off[1:].tolist()):
                payload, avi = store(raw[a:z])
                got = read(avi)
                back = payload_of(got)
                if back != payload:
                    raise ValueError("the payload read back differs")
                h = got["histograms"]
                cuts = ",".join(f"{x / got['fps']:.2f}-{(y + 1) / got['fps']:.2f}" for x, y in got["shots"])
                feature = f"frames={len(h)};clips={cuts};luma={'/'.join(map(str, h.sum(0).tolist()))}"
                rows.append((z - a, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(avi), hashlib.sha256(avi).hexdigest(), feature))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
