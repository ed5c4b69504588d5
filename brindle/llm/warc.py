"""WARC derivatives: from response records to linked metadata and plain-text conversion records.

Every response becomes a metadata record (title, language, links, status) and, where its
content is HTML or text, a conversion record with the visible text. Both name the response
in WARC-Refers-To, with its target URI and date, and keep its target URI, date, payload and block digest and the other
headers listed in KEPT; the metadata lists the response's HTTP headers too. Each carries a block digest
of its own, and its id is made from the response's id, so that a rerun gives equal records.
Chunked transfer and gzip, deflate and zstd content codings are undone before the text is read.

`read` takes WARC files, plain or gzip, from a path: each file is held whole as Spark reads it, and unpacked and cut
into records in one pass; `responses` makes response
records from a table of pages; `derive` works on either; `to_bytes` is the exact record.

Nulls and edges: a record that isn't a response, or that is null or malformed, gives nothing; a file that breaks off gives the records before;
a payload in an unknown or broken coding has metadata that says so, and no conversion;
a null or empty page is a response with an empty payload and an empty conversion; pages with
equal urls and html stay apart by their key, and rows that repeat a key as well repeat their records; keys of any type; other columns play no part.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import text as tx

DATE = "2024-01-01T00:00:00Z"
#: Headers of the source that derivatives carry on.
KEPT = ["WARC-IP-Address", "WARC-Warcinfo-ID", "WARC-Identified-Payload-Type", "WARC-Truncated", "WARC-Profile"]
PIECE = 1 << 16
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(?:!doctype|\?)[^>]*>", re.I | re.S)
_BREAK = re.compile(r"</?(?:p|div|br|h[1-6]|li|ul|ol|tr|table|section|article|header|footer|nav|blockquote|pre|title|hr|main|aside|dl|dt|dd|figure|form)\b[^>]*>", re.I)
_TAG = re.compile(r"<[a-z/][^>]*>", re.I)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title", re.I | re.S)
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([\w-]+)", re.I)
_LINK = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?([\w-]+)", re.I)
_SPACES = re.compile(r"[ \t\r\f\v ]+")
_LINES = re.compile(r" ?\n[ \n]*")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def visible_text(page: str) -> str:
    """The text that a page shows, a line for each block."""
    page = _TAG.sub("", _BREAK.sub("\n", _HIDDEN.sub(" ", page).replace("\n", " ")))
    return _LINES.sub("\n", _SPACES.sub(" ", html.unescape(page))).strip()


def to_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """(headers with lower-case names, block) of one record; ValueError if it is none."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers: dict[str, str] = {}
    last = ""
    for line in lines[1:]:
        if line[:1] in " \t" and last:
            headers[last] += " " + line.strip()
            continue
        name, _, value = line.partition(":")
        last = name.strip().lower()
        headers[last] = value.strip()
    size = int(headers["content-length"])
    if len(rest) < size:
        raise ValueError("the block is cut short")
    return headers, rest[:size]


def unpacked(data: bytes) -> Iterator[bytes]:
    """The bytes of a file in pieces, with gzip members undone; what follows a broken member is left out."""
    view = memoryview(data)
    if data[:2] != b"\x1f\x8b":
        yield from (bytes(view[k : k + PIECE]) for k in range(0, len(data), PIECE))
        return
    at = 0
    while data[at : at + 2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        while not z.eof and at < len(data):
            piece = view[at : at + PIECE]
            try:
                yield z.decompress(piece)
            except zlib.error:
                return
            at += len(piece) - len(z.unused_data)


def split(data: bytes) -> Iterator[bytes]:
    """The records of a file, plain or gzip, however its members are cut."""
    held = bytearray()
    end, sought = 0, 0  # where the record that is being read ends, 0 while its head isn't whole; how far its head was looked for
    for piece in unpacked(data):
        held += piece
        while True:
            if not end:
                skip = len(held) - len(held.lstrip(b"\r\n")) if held[:1] in (b"\r", b"\n") else 0
                if skip:
                    del held[:skip]
                    sought = 0
                head = held.find(b"\r\n\r\n", max(0, sought - 3))
                if head < 0:
                    sought = len(held)
                    break
                m = re.search(rb"\r\ncontent-length:[ \t]*(\d+)", held[: head + 2], re.I)
                if not m:
                    return
                end = head + 4 + int(m[1])
            if len(held) < end:
                break
            yield bytes(held[:end])
            del held[:end]
            end = sought = 0


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, record: binary) of every record of the WARC files under path."""

    def run(batches):
        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                held, size = [], 0
                for r in split(data):
                    held.append(r)
                    size += len(r)
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(held)), pa.array(held, pa.binary())], ["file", "record"])
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(held)), pa.array(held, pa.binary())], ["file", "record"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, record binary")


def dechunked(body: bytes) -> bytes:
    """The body of a chunked transfer; ValueError if it is none."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        size = int(body[at : line if line >= 0 else at].split(b";")[0].strip(), 16)
        if not size:
            return b"".join(out)
        if size < 0 or len(body) < line + 2 + size:
            raise ValueError("a chunk is cut short")
        out.append(body[line + 2 : line + 2 + size])
        at = line + 4 + size


def decoded(body: bytes, http: dict[str, str]) -> bytes:
    """The payload without transfer and content codings; ValueError for one that is unknown or broken."""
    if not body:
        return body
    if "chunked" in http.get("transfer-encoding", "").lower():
        try:
            body = dechunked(body)
        except ValueError:
            if re.match(rb"[0-9a-f]+[ \t]*(;[^\r\n]*)?\r\n", body, re.I):
                raise  # chunked, but cut short; otherwise the writer has undone it
    for coding in reversed([c.strip().lower() for c in http.get("content-encoding", "").split(",")]):
        try:
            if coding in ("gzip", "x-gzip"):
                body = zlib.decompress(body, 47) if body[:2] == b"\x1f\x8b" else body
            elif coding == "deflate":
                body = zlib.decompress(body, 15 if body[:1] and body[0] & 15 == 8 else -15)
            elif coding == "zstd":
                body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
            elif coding not in ("", "identity"):
                raise ValueError(f"unknown coding {coding}")
        except (zlib.error, zstandard.ZstdError) as e:
            raise ValueError(f"broken {coding}") from e
    return body


def response(key: object, url: str | None, page: str | None) -> bytes:
    payload = (page or "").encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    ident = uuid.uuid5(uuid.NAMESPACE_URL, f"{key}|{url or ''}")
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{ident}>"), ("WARC-Date", DATE), ("WARC-Target-URI", url or ""), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(http + payload))]
    return to_bytes(headers, http + payload)


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(key, record: binary): a response record for every page."""

    def run(batches):
        for b in tx.slices(batches, "h"):
            made = [response(*row) for row in zip(*(b.column(c).to_pylist() for c in "kuh"))]
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(made, pa.binary())], [key, "record"])

    rows = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(page).alias("h"))
    return rows.mapInArrow(run, f"{key} {rows.schema['k'].dataType.simpleString()}, record binary")


def derivatives(record: bytes | None) -> list[dict]:
    """The metadata and conversion records of a response; nothing for any other record."""
    try:
        headers, block = parse(record or b"")
    except (ValueError, KeyError):
        return []
    if headers.get("warc-type") != "response" or "warc-record-id" not in headers:
        return []
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *fields = head.decode("latin-1").split("\r\n")
    pairs = [(n.strip(), v.strip()) for n, sep, v in (f.partition(":") for f in fields) if sep]
    http = {n.lower(): v for n, v in reversed(pairs)}
    kind, broken, body = http.get("content-type", ""), "", payload
    try:
        body = decoded(payload, http)
    except ValueError as e:
        broken = str(e)
    charset = _CHARSET.search(kind.encode()) or _CHARSET.search(body[:1024])
    try:
        page = body.decode(charset[1].decode() if charset else "utf-8", "replace")
    except LookupError:
        page = body.decode("utf-8", "replace")
    source = headers["warc-record-id"]
    source_digest = headers.get("warc-payload-digest") or digest(payload)
    if broken:
        page = ""
    title, lang = _TITLE.search(page), _LANG.search(page)
    links = list(dict.fromkeys(html.unescape(next(filter(None, m), "")) for m in _LINK.findall(page)))
    about = [("status", status.split(" ")[1] if " " in status else ""), ("contentType", kind), ("title", _SPACES.sub(" ", html.unescape(title[1])).strip() if title else ""), ("language", lang[1] if lang else "")]
    about += [("decodeError", broken)] * bool(broken) + [(f"http-{n.lower()}", v) for n, v in pairs] + [("outlink", x) for x in links]
    blocks = [("metadata", "application/warc-fields", "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in about))]
    if not broken and (not kind or kind.lower().startswith("text/") or "html" in kind.lower()):
        blocks.append(("conversion", "text/plain; charset=utf-8", visible_text(page) if "html" in kind.lower() or not kind else page))
    uri, date, out = headers.get("warc-target-uri", ""), headers.get("warc-date", ""), []
    carried = [(n, headers[n.lower()]) for n in KEPT if n.lower() in headers]
    if "warc-block-digest" in headers:
        carried.append(("WARC-Source-Block-Digest", headers["warc-block-digest"]))
    for what, mime, text in blocks:
        own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{source}|{what}')}>"
        own_digest = digest(text.encode())
        h = [("WARC-Type", what), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date)]
        h += [("WARC-Source-Payload-Digest", source_digest), *carried, ("WARC-Block-Digest", own_digest), ("Content-Type", mime)]
        out.append({"record_type": what, "record_id": own, "refers_to": source, "target_uri": uri, "source_digest": source_digest, "block_digest": own_digest, "headers": h, "body": text})
    return out


_COLUMNS = ["record_type", "record_id", "refers_to", "target_uri", "source_digest", "block_digest", "content_length", "body", "record_sha256"]


def derive(records: DataFrame, key: str, record: str = "record") -> DataFrame:
    """One row per derivative record: its fields, its block as text and the digest of its exact bytes."""

    def run(batches):
        for b in tx.slices(batches, "r"):
            keys, cols = [], {c: [] for c in _COLUMNS}
            for k, data in zip(b.column("k").to_pylist(), b.column("r").to_pylist()):
                for d in derivatives(data):
                    body = d["body"].encode()
                    keys.append(k)
                    for c in _COLUMNS:
                        cols[c].append(len(body) if c == "content_length" else hashlib.sha256(to_bytes(d["headers"], body)).hexdigest() if c == "record_sha256" else d[c])
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field("k").type), *(pa.array(v, pa.int64() if c == "content_length" else pa.string()) for c, v in cols.items())], [key, *_COLUMNS])

    rows = records.select(F.col(key).alias("k"), F.col(record).alias("r"))
    fields = ", ".join(f"{c} {'long' if c == 'content_length' else 'string'}" for c in _COLUMNS)
    return rows.mapInArrow(run, f"{key} {rows.schema['k'].dataType.simpleString()}, {fields}")
