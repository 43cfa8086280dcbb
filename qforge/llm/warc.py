"""WARC derivatives: metadata and plain-text conversion records from response records.

A record is a row: warc_type, record_id, refers_to, target_uri, date, content_type, headers (WARC headers beyond the usual ones), block_digest, payload_digest,
content_length and block (bytes). Each response gets

* a ``conversion`` record: its payload as plain text, WARC-Refers-To its record id;
* a ``metadata`` record (application/warc-fields): title, language hint, out-links, and the response's own HTTP status, headers and digests,
  linked to the response by WARC-Refers-To and to the conversion record by a field.

Ids are name-based UUIDs of what a record is made from, so a rerun writes equal records. A file starts with a warcinfo record and every record is a gzip member of its
own, so readers can seek. A task packs members into files of about FILE_BYTES; only a single record can make one larger.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = (
    "warc_type string, record_id string, refers_to string, target_uri string, date string, content_type string, headers map<string,string>, "
    "block_digest string, payload_digest string, content_length long, block binary"
)
EPOCH = "1970-01-01T00:00:00Z"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space of URLs

#: Compressed bytes after which a task starts a new file, and the effort of the compression.
FILE_BYTES = 64 << 20
LEVEL = 6

HIDDEN = ("script", "style", "noscript", "template")
BREAKS = frozenset("p div br li ul ol tr table h1 h2 h3 h4 h5 h6 section article header footer nav title blockquote pre hr".split())
OPEN = re.compile(r"<(?:!--|(/?)([a-zA-Z][a-zA-Z0-9:-]*)|[/!?])")
CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in (*HIDDEN, "title")}
LANG = re.compile(r"\slang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
HREF = re.compile(r"\shref\s*=\s*(?:\"([^\"]*)|'([^']*)|([^\s>]+))", re.I)
UNSAFE = re.compile(r"[\r\n]+")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def urn(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(0).join(parts))}>"


def read_page(page: str) -> tuple[str, str, str, list[str]]:
    """(text, title, language, links) of a page, in one pass: every character is looked at a fixed number of times, whatever is left unclosed.

    Text: markup dropped, block elements start lines, scripts, styles and comments are a space, entities resolved, space collapsed, empty lines dropped. A tag ends
    at its first ">"; one without is text, and so is a "<" that starts no tag. A hidden element or comment without an end reaches to the end of the page.
    """
    out, links, title, lang = [], [], None, None
    at = seen = 0  # where the search goes on, and up to where the page is in ``out``
    while m := OPEN.search(page, at):
        start, name = m.start(), (m[2] or "").lower()
        if m[0] == "<!--":
            end = page.find("-->", m.end())
            out += (page[seen:start], " ")
            at = seen = end + 3 if end >= 0 else len(page)
            continue
        end = page.find(">", m.end())
        if end < 0:
            break  # no tag ends any more
        out.append(page[seen:start])
        at = seen = end + 1
        if not m[1] and name in HIDDEN:
            close = CLOSE[name].search(page, at)
            out.append(" ")
            at = seen = close.end() if close else len(page)
            continue
        if name in BREAKS:
            out.append("\n")
        if m[1] or name not in ("a", "html", "title"):
            continue
        if name == "a" and (h := HREF.search(page, m.end(), end)):
            links.append(html.unescape(h[h.lastindex]))
        elif name == "html" and lang is None and (h := LANG.search(page, m.end(), end)):
            lang = h[1]
        elif name == "title" and title is None:
            close = CLOSE["title"].search(page, at)
            title = " ".join(html.unescape(page[at : close.start()]).split()) if close else ""
    out.append(page[seen:])
    text = html.unescape("".join(out))
    return "\n".join(line for raw in text.split("\n") if (line := " ".join(raw.split()))), title or "", lang or "", links


def http_parts(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status line, headers in order, payload) of an HTTP response; a block without a header has a payload alone."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    head, _, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    return lines[0], [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:]) if k.strip()], payload


def _record(kind: str, record_id: str, refers_to: str | None, uri: str | None, date: str, content_type: str, headers: dict, block: bytes, payload: str | None = None) -> tuple:
    return (kind, record_id, refers_to, uri, date, content_type, headers, digest(block), payload, len(block), block)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")])


def response(page_id: str | None, url: str | None, page: str | None, date: str) -> tuple:
    payload = (page or "").encode("utf-8", "replace")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    return _record("response", urn("response", str(page_id), url or "", digest(block)), None, url, date, "application/http; msgtype=response", {}, block, digest(payload))


def derived(record: tuple) -> list[tuple]:
    """The conversion and the metadata record of a response record."""
    _, record_id, _, uri, date, _, _, block_digest, payload_digest, _, block = record
    block, date = bytes(block or b""), date or EPOCH
    status, headers, payload = http_parts(block)
    text, title, lang, links = read_page(payload.decode("utf-8", "replace"))
    payload_digest = payload_digest or digest(payload)
    source = {"WARC-Source-Block-Digest": block_digest or digest(block), "WARC-Source-Payload-Digest": payload_digest}
    plain = text.encode("utf-8")
    conversion = urn("conversion", record_id or "", digest(plain))
    fields = [("conversion", conversion), ("http-status", status), *((f"http-header-{k}", v) for k, v in headers), ("source-block-digest", source["WARC-Source-Block-Digest"]), ("source-payload-digest", payload_digest)]
    fields += [("title", title), ("language", lang), ("text-length", str(len(plain))), *(("outlink", x) for x in links)]
    meta = "".join(f"{k}: {UNSAFE.sub(' ', v)}\r\n" for k, v in fields if v).encode("utf-8", "replace")
    return [
        _record("conversion", conversion, record_id, uri, date, "text/plain; charset=utf-8", source, plain),
        _record("metadata", urn("metadata", record_id or "", digest(meta)), record_id, uri, date, "application/warc-fields", source, meta),
    ]


def member(record: tuple) -> bytes:
    """A record of WARC/1.1 as a gzip member."""
    kind, record_id, refers_to, uri, date, content_type, headers, block_digest, payload_digest, length, block = record
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", date), ("WARC-Refers-To", refers_to), ("WARC-Target-URI", uri)]
    head += [("Content-Type", content_type), ("WARC-Block-Digest", block_digest), ("WARC-Payload-Digest", payload_digest), *sorted(dict(headers or {}).items())]
    lines = "".join(f"{k}: {UNSAFE.sub(' ', v)}\r\n" for k, v in head if v)
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(f"WARC/1.1\r\n{lines}Content-Length: {length}\r\n\r\n".encode() + bytes(block) + b"\r\n\r\n") + z.flush()


def packed(records: Iterator[tuple], file_bytes: int) -> Iterator[pd.DataFrame]:
    """(file): the bytes of whole files, rolled at ``file_bytes``.

    The text sink ends a file with its line separator, here a zero byte. That byte is the last one of the last member: the high byte of its length,
    which is zero below 16 MiB. After a longer member it is padding, which gzip readers pass over.
    """
    held: list[bytes] = []
    size = 0

    def whole() -> pd.DataFrame:
        data = b"".join(held)
        return pd.DataFrame({"file": [data[:-1] if data[-1] == 0 else data]})

    for r in records:
        if not held:
            info = b"software: qforge\r\nformat: WARC File Format 1.1\r\n"
            held.append(member(_record("warcinfo", urn("warcinfo", r[1] or "", digest(info)), None, None, r[4] or EPOCH, "application/warc-fields", {}, info)))
        held.append(member(r))
        size += len(held[-1])
        if size >= file_bytes:
            yield whole()
            held, size = [], 0
    if held:
        yield whole()


def _tuples(b: pd.DataFrame) -> Iterator[tuple]:
    return b[[c.split()[0] for c in RECORD.split(", ")]].itertuples(index=False, name=None)


def _pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    return pages.select(F.col(id_col).cast("string").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))


def responses(pages: DataFrame, date: str = EPOCH, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One response record per page row. A null page is an empty one; a null url stays null. Rows that repeat give equal records."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield _frame([response(*x, date) for x in zip(b["id"], b["url"], b["html"], strict=True)])

    return _pages(pages, id_col, url_col, html_col).mapInPandas(run, RECORD)


def derive(records: DataFrame) -> DataFrame:
    """Two records for each response record: its conversion and its metadata. Records of other types are passed over.

    Blocks that are no UTF-8 are decoded with replacement. A response with an empty payload gets an empty conversion. Rows that repeat are derived as often as they occur.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield _frame([d for r in _tuples(b) for d in derived(r)])

    return records.filter("warc_type = 'response'").mapInPandas(run, RECORD)


def _sink(files: DataFrame, path: str) -> str:
    files.select(F.col("file").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)
    return path


def write_warc(records: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> str:
    """Write gzip WARC files of about ``file_bytes`` to a folder, every task its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return packed((r for b in batches for r in _tuples(b)), file_bytes)

    return _sink(records.mapInPandas(run, "file binary"), path)


def write_derivatives(pages: DataFrame, path: str, date: str = EPOCH, file_bytes: int = FILE_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> str:
    """``write_warc(derive(responses(pages)))`` in one step, so that a page's bytes go to a Python worker once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return packed((d for b in batches for x in zip(b["id"], b["url"], b["html"], strict=True) for d in derived(response(*x, date))), file_bytes)

    return _sink(_pages(pages, id_col, url_col, html_col).mapInPandas(run, "file binary"), path)


def parse(data: bytes) -> Iterator[tuple]:
    at = 0
    known = {"warc-type", "warc-record-id", "warc-date", "warc-refers-to", "warc-target-uri", "content-type", "warc-block-digest", "warc-payload-digest", "content-length"}
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = [x.partition(": ") for x in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]]
        h = {k.lower(): v for k, _, v in head}
        n = int(h["content-length"])
        block = data[end + 4 : end + 4 + n]
        if len(block) != n or data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError(f"damaged record at byte {at}")
        if h.get("warc-block-digest") not in (None, digest(block)):
            raise ValueError(f"wrong digest at byte {at}")
        yield (h["warc-type"], h["warc-record-id"], h.get("warc-refers-to"), h.get("warc-target-uri"), h["warc-date"], h.get("content-type"), {k: v for k, _, v in head if k.lower() not in known}, h.get("warc-block-digest"), h.get("warc-payload-digest"), n, block)
        at = end + 8 + n


def members(data: bytes) -> Iterator[bytes]:
    """What the gzip members of a file hold, one after the other; a file that is not gzip is one."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    at, view = 0, memoryview(data)
    while at < len(data):
        if not view[at]:  # padding
            at += 1
            continue
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(data):
                raise ValueError("a gzip member is cut short")
            piece = view[at : at + (1 << 14)]
            parts.append(z.decompress(piece))
            at += len(piece)
        at -= len(z.unused_data)
        yield b"".join(parts)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of a folder of WARC files (plain or gzip), without warcinfo. Records cut short or with a wrong block digest raise."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                rows: list[tuple] = []
                for plain in members(bytes(content)):
                    rows += (r for r in parse(plain) if r[0] != "warcinfo")
                    if len(rows) >= 500:
                        yield _frame(rows)
                        rows = []
                if rows:
                    yield _frame(rows)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInPandas(run, RECORD)


def derivatives(pages: DataFrame, path: str) -> DataFrame:
    """Write the derivatives of pages as WARC files in ``path``, read them back, and give one row a record: record_id, warc_type, refers_to, target_uri,
    block_digest, source_payload_digest, content_length, block_sha256.

    Two rows a page row. Null and empty pages get an empty conversion record and a metadata record; a null url stays null. Pages that repeat give equal records, as often
    as they occur. An empty table gives no rows. Other columns are ignored.
    """
    write_derivatives(pages, path)
    back = read_warc(pages.sparkSession, path)
    return back.select("record_id", "warc_type", "refers_to", "target_uri", "block_digest", F.col("headers")["WARC-Source-Payload-Digest"].alias("source_payload_digest"), "content_length", F.sha2("block", 256).alias("block_sha256"))
