"""WARC derivatives: a metadata and a conversion record for each response.

Both records name the response in WARC-Refers-To and carry its target URI and
date. The metadata record's block is canonical JSON with the response's WARC
and HTTP headers as they were, its digests as given and as found, the page's
title and links, and the id of the conversion; the conversion record's block is
the page's plain text. Record ids are derived from the response's, so that
reruns agree. The format is that of WARC 1.1, which allows WARC-Concurrent-To
on neither (they aren't of the capture): the link is in the metadata's block.

Responses come from archives (archives(), gzipped or not) or, where a table
holds pages alone, are made from those (responses()).
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from html import unescape
from urllib.parse import urljoin

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only
from .html_extract import blocks

#: The namespace of derived record ids.
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: The date of responses made from pages, which have none: a parameter of responses(), no fact about a page.
DATE = "2024-01-01T00:00:00Z"
#: A response's WARC headers as JSON: pairs of name and value, in order.
SOURCE = "page_id long, record_id string, target_uri string, date string, payload_digest string, headers string, block binary"

_TITLE = re.compile(r"<title[^>]*>(.*?)(?:</title|\Z)", re.S | re.I)
_LINK = re.compile(r"""<a\s[^>]*?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TYPE = re.compile(r"charset=[\"']?([\w-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record's bytes: version, headers, block and the two line ends after it. Line ends in values would end a header: they become spaces."""
    head = "".join(f"{k}: {' '.join(str(v).splitlines())}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


class Records:
    """The records of WARC bytes, fed piece by piece: (headers in order, block). Gzip members are opened as they come; at most one record is held."""

    def __init__(self):
        self.packed: zlib._Decompress | None = None
        self.plain: bool | None = None
        self.buffer = bytearray()

    def _opened(self, data: bytes) -> bytes:
        if self.plain is None:
            self.plain = data[:2] != b"\x1f\x8b"
        if self.plain:
            return data
        out = b""
        while data:
            if self.packed is None:
                self.packed = zlib.decompressobj(31)
            out += self.packed.decompress(data)
            if not self.packed.eof:
                break
            data, self.packed = self.packed.unused_data, None  # the next record's member
        return out

    def feed(self, data: bytes):
        self.buffer += self._opened(data)
        at = 0
        while True:
            start = self.buffer.find(b"WARC/", at)
            end = self.buffer.find(b"\r\n\r\n", start) if start >= 0 else -1
            if end < 0:
                break
            pairs = []
            for line in bytes(self.buffer[start:end]).decode("utf-8", "replace").split("\r\n")[1:]:
                if line[:1] in (" ", "\t") and pairs:  # goes on from the line before
                    pairs[-1][1] += " " + line.strip()
                elif ":" in line:
                    pairs.append([x.strip() for x in line.split(":", 1)])
            size = next((int(v) for k, v in pairs if k.lower() == "content-length" and v.isdigit()), None)
            if size is None:
                raise ValueError(f"a record without a Content-Length: {pairs}")
            if len(self.buffer) < end + 4 + size:
                break
            yield pairs, bytes(self.buffer[end + 4 : end + 4 + size])
            at = end + 4 + size
        del self.buffer[:at]

    def close(self) -> None:
        """Raises if the bytes ended inside a record."""
        if self.packed is not None or self.buffer.strip(b"\r\n"):
            raise ValueError("the archive ends inside a record")


def parse(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """The records of whole WARC bytes: headers by lower-cased name, block."""
    r = Records()
    out = [({k.lower(): v for k, v in pairs}, block) for pairs, block in r.feed(data)]
    r.close()
    return out


def http(block: bytes) -> tuple[str, list[list[str]], bytes]:
    """(status line, headers in order, body) of a response's block; a block without an empty line is all body."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return "", [], block
    status, *lines = head.decode("utf-8", "replace").split("\r\n")
    return status, [[p.strip() for p in x.split(":", 1)] for x in lines if ":" in x], body


def derive(record_id: str, uri: str, date: str, given: str | None, block: bytes, source: list[list[str]] | None = None) -> list[tuple]:
    """The metadata and the conversion record: (type, id, refers to, the other's id, content type, source payload digest, block digest, length, bytes). source: the response's WARC headers."""
    status, headers, body = http(block)
    kind = next((v for k, v in headers if k.lower() == "content-type"), "")
    charset = m[1] if (m := _TYPE.search(kind)) else "utf-8"
    try:
        html = body.decode(charset, "replace")
    except LookupError:
        html = body.decode("utf-8", "replace")
    found = digest(body)
    title = " ".join(unescape(m[1]).split()) if (m := _TITLE.search(html)) else None
    links = []
    for g in _LINK.findall(html):
        try:
            links.append(urljoin(uri, unescape("".join(g))))
        except ValueError:  # not an address
            links.append(unescape("".join(g)))
    text = "\n".join(b.text for b in blocks(html))
    ids = [f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{record_id} {t}')}>" for t in ("metadata", "conversion")]
    meta = {"conversion": ids[1], "source": {"record_id": record_id, "warc_headers": source or [], "date": date, "status": status, "headers": headers, "payload_digest": given or found, "payload_digest_found": found, "block_digest": digest(block), "length": len(block)}, "page": {"title": title, "links": links, "n_chars": len(text)}}
    out = []
    for k, (type_, content, data) in enumerate((("metadata", "application/json", json.dumps(meta, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()), ("conversion", "text/plain; charset=utf-8", text.encode()))):
        own = digest(data)
        head = [("WARC-Type", type_), ("WARC-Record-ID", ids[k]), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Refers-To", record_id), ("WARC-Block-Digest", own), ("Content-Type", content)]
        out.append((type_, ids[k], record_id, ids[1 - k], content, given or found, own, len(data), record(head, data)))
    return out


RECORDS = "page_id long, target_uri string, record_type string, record_id string, refers_to string, linked_to string, content_type string, source_payload_digest string, block_digest string, content_length long, warc binary"


def _derived(batches):
    import pyarrow as pa

    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [pa.int64(), *[pa.string()] * 8, pa.int64(), pa.binary()]
    for batch in batches:
        rows = []
        for i, record_id, uri, date, given, source, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows += [(i, uri, *r) for r in derive(record_id or "", uri or "", date or "", given, block or b"", json.loads(source) if source else None)]
        for s in range(0, len(rows), 1000):
            cols = list(zip(*rows[s : s + 1000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def derivatives(responses: DataFrame) -> DataFrame:
    """Responses (see SOURCE) -> two rows a response (see RECORDS).

    A null block counts as empty and gives an empty conversion; a null URI, id
    or date as empty; a null payload_digest is replaced by the one found; null
    headers are none. Repeated rows
    give repeated records of the same ids; an empty table gives none; other
    columns are not looked at.
    """
    names = [x.split()[0] for x in SOURCE.split(", ")]
    return only(responses, *names).select(F.col("page_id").cast("long").alias("page_id"), *names[1:]).mapInArrow(_derived, RECORDS)


def _unpacked(batches):
    import pyarrow as pa

    kinds = [pa.int64(), *[pa.string()] * 5, pa.binary()]
    names = [x.split()[0] for x in SOURCE.split(", ")]
    for batch in batches:
        for raw in batch.column(0):
            r, rows, held = Records(), [], 0
            data = raw.as_buffer()
            for s in range(0, max(data.size, 1), 1 << 20):
                for pairs, block in r.feed(data.slice(s, min(1 << 20, data.size - s)).to_pybytes()):
                    head = {k.lower(): v for k, v in pairs}
                    if head.get("warc-type") != "response":
                        continue
                    rows.append((None, head.get("warc-record-id"), head.get("warc-target-uri"), head.get("warc-date"), head.get("warc-payload-digest"), json.dumps(pairs, ensure_ascii=False), block))
                    held += len(block)
                    if held > 16_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, held = [], 0
            r.close()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def archives(spark: SparkSession, path: str) -> DataFrame:
    """The response records (see SOURCE; page_id null) of WARC files, each gzipped by record or not at all; other records are passed over.

    A task holds one file's packed bytes (2 GB at most, as a row; Arrow batches end
    at spark.sql.execution.arrow.maxBytesPerBatch) and one record at a time. A file that ends inside a record fails the read; an empty one has none.
    """
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_unpacked, SOURCE)


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """(page_id, url, html) as response records, with ids by page and url, for tables that hold pages and not archives."""
    pages = only(pages, "page_id", "url", "html")
    uri = F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\r\n]+", " ")
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    key = F.sha1(F.concat_ws("\x1f", F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce(F.col("url"), F.lit(""))))
    part = lambda a, n: F.substring(key, a, n)
    variant = F.element_at(F.array(*map(F.lit, "89ab")), F.conv(part(17, 1), 16, 10).cast("int") % 4 + 1)
    uid = F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.length(body).cast("string"), F.lit("\r\n\r\n"))
    id_ = F.concat(F.lit("<urn:uuid:"), uid, F.lit(">"))
    pair = lambda k, v: F.array(F.lit(k), v)
    block = F.concat(head.cast("binary"), body)
    headers = F.to_json(F.array(pair("WARC-Type", F.lit("response")), pair("WARC-Record-ID", id_), pair("WARC-Date", F.lit(date)), pair("WARC-Target-URI", uri), pair("Content-Type", F.lit("application/http; msgtype=response")), pair("Content-Length", F.length(block).cast("string"))))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), id_.alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"), F.lit(None).cast("string").alias("payload_digest"), headers.alias("headers"), block.alias("block"))

