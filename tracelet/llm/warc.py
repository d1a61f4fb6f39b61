"""WARC derivatives: linked metadata and plain-text conversion records of responses.

Of each response record a metadata record (JSON: the source's headers, title,
description, links) and a conversion record (the page's text) are derived. Both
refer to the response (WARC-Refers-To), keep its target URI, date and payload
digest, and carry digests of their own blocks. Responses are those of a WARC
file (read_warc, derivatives_of_records), with the headers they came with, or
are made of pages (derivatives), which have neither headers nor time of their
own: HTTP 200 and the epoch stand for them. The responses come out beside what
is derived from them, so that what is referred to is there. Record ids are
name-based UUIDs of what they name, so a rerun gives the same ones.

A page is read once from left to right: a tag reaches to the next ">", and one
that doesn't end is text; comments, scripts and other unseen elements reach to
their end or that of the page.

Defined cases: a null page is an empty page, whose text is empty; a null
address leaves WARC-Target-URI out and is null in the rows; a null id counts as
empty in the record id; repeated rows give equal records; very long pages are
read whole, in time proportional to their length; an empty table gives no rows;
other columns are ignored. Of a file cut off within a record, what is there of
its block is read and marked as truncated; a head that is cut off is left out;
what doesn't begin as a record ends the file, marked likewise; header fields
that occur more than once are all kept, in their order.

How it scales: one narrow pass, bounded by a page at a time, or by a file, whose
records are unpacked one after another.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DATE = "1970-01-01T00:00:00Z"  # pages carry no time of their own
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122's name space of URLs
CRLF = "\r\n"

RAW = ("script", "style")
UNSEEN = (*RAW, "noscript", "template", "head", "svg")
BREAKS = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 tr table section article header footer nav blockquote pre td th hr body main aside form dd dt dl figure option".split())
LINKED = frozenset("a link img script iframe form".split())
ADDRESSES = ("href", "src", "action")
END = re.compile(r"</(script|style|noscript|template|head|svg|title)\b", re.IGNORECASE)
NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9]*+")
BLANK = re.compile(r"[^\S\n]+")
ATTRIBUTE = re.compile(r"""(?<![\w:-])([\w:-]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""")


def scan(page: str) -> Iterator[tuple[str, str, str]]:
    """Pieces (kind, name, content) in order: text; tag and end with the name and what follows it; title with its text. Unseen text doesn't come out."""
    ends: dict[str, list[int]] = {}
    for m in END.finditer(page):
        ends.setdefault(m[1].lower(), []).append(m.start())

    def end_of(name: str, at: int) -> int:
        places = ends.get(name, [])
        i = bisect.bisect_left(places, at)
        return places[i] if i < len(places) else len(page)

    at, seen_from, j = 0, 0, -1  # text before seen_from is not seen; j: the next ">", looked for once
    while at < len(page):
        i = page.find("<", at)
        if i >= 0 and j < i and (j := page.find(">", i)) < 0:
            j = len(page)
        if i < 0 or j == len(page) and not page.startswith("<!--", i):
            i = len(page)
        if i > at and i > seen_from:
            yield "text", "", page[max(at, seen_from) : i]
        if i == len(page):
            return
        if page.startswith("<!--", i):
            stop = page.find("-->", i + 4)
            yield "tag", "!--", ""
            if stop < 0:
                return
            at = stop + 3
            continue
        closing = page.startswith("/", i + 1)
        m = NAME.match(page, i + 1 + closing)
        if not m:
            if page[i + 1 : i + 2] not in ("!", "?"):
                if i >= seen_from:
                    yield "text", "", "<"
                at = i + 1
                continue
            at = j + 1
            continue
        name = m[0].lower()
        yield "end" if closing else "tag", name, page[m.end() : j]
        at = j + 1
        if closing:
            continue
        if name == "title":
            stop = end_of("title", at)
            yield "title", "", page[at:stop]
            at = stop
        elif name in UNSEEN and at > seen_from:
            stop = end_of(name, at)
            after = page.find(">", stop)
            seen_from = len(page) if after < 0 else after + 1
        if name in RAW:
            at = max(at, end_of(name, at))


def read_page(page: str) -> tuple[str, dict]:
    """What a reader sees (blocks on lines of their own, blanks joined, empty lines dropped), and the page's title, meta tags and links."""
    parts: list[str] = []
    title, metas, links = None, [], []
    for kind, name, content in scan(page):
        if kind == "text":
            parts.append(content)
        elif kind == "title":
            title = content if title is None else title
        else:
            if name in BREAKS or kind == "tag" and (name in UNSEEN or name == "!--"):
                parts.append("\n")
            if kind == "tag" and (name == "meta" or name in LINKED):
                found = [(k.lower(), html.unescape(a or b or c)) for k, a, b, c in ATTRIBUTE.findall(content)]
                if name == "meta":
                    metas.append(dict(reversed(found)))  # of attributes that occur twice the first holds
                elif address := next(((k, v) for k, v in found if k in ADDRESSES), None):
                    links.append({"path": f"{name.upper()}@/{address[0]}", "url": address[1]})
    lines = (BLANK.sub(" ", x).strip() for x in html.unescape("".join(parts)).split("\n"))
    return "\n".join(x for x in lines if x), {"title": None if title is None else " ".join(html.unescape(title).split()), "metas": metas, "links": links}


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*names: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(0).join(names))}>"


def record(fields: dict[str, str | None], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}{CRLF}" for k, v in fields.items() if v is not None)
    return f"WARC/1.0{CRLF}{head}Content-Length: {len(block)}{CRLF}{CRLF}".encode() + block + (CRLF * 2).encode()


def response(key: str, url: str | None, page: str) -> tuple[dict[str, str | None], bytes, bytes]:
    """Fields, block and payload of the response record of a page."""
    payload = page.encode()
    block = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: {len(payload)}{CRLF}{CRLF}".encode() + payload
    fields = {
        "WARC-Type": "response",
        "WARC-Record-ID": record_id("response", key, url or "", digest(payload)),
        "WARC-Date": DATE,
        "WARC-Target-URI": url,
        "WARC-Payload-Digest": digest(payload),
        "WARC-Block-Digest": digest(block),
        "Content-Type": "application/http; msgtype=response",
    }
    return fields, block, payload


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers in their order, and payload as it was sent."""
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("utf-8", "replace").split(CRLF)
    return status, _fields(lines), payload


def _fields(lines: list[str]) -> list[tuple[str, str]]:
    """Of header lines; one that begins with a blank continues the last."""
    out: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif line:
            k, _, v = line.partition(":")
            out.append((k.strip(), v.strip()))
    return out


def page_of(headers: list[tuple[str, str]], payload: bytes) -> str:
    """The payload without chunks and compression, as text of the charset that its headers name (UTF-8 where they name none that is known)."""
    said = {k.lower(): v.lower() for k, v in headers}
    if "chunked" in said.get("transfer-encoding", ""):
        parts, at = [], 0
        while (end := payload.find(b"\r\n", at)) >= 0:
            size = payload[at:end].split(b";")[0].strip()
            if not re.fullmatch(rb"[0-9a-fA-F]{1,15}", size) or not int(size, 16):
                break
            parts.append(payload[end + 2 : end + 2 + int(size, 16)])
            at = end + 4 + int(size, 16)
        payload = b"".join(parts) if parts else payload
    if said.get("content-encoding") in ("gzip", "x-gzip", "deflate"):
        try:
            payload = zlib.decompressobj(47).decompress(payload)
        except zlib.error:  # already unpacked, as crawlers often leave it
            pass
    named = re.search(r"charset=[\"']?([\w.:-]+)", said.get("content-type", ""))
    try:
        return payload.decode(named[1] if named else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def derive(fields: dict[str, str | None], block: bytes) -> list[tuple[dict[str, str | None], bytes]]:
    """The metadata and the conversion record of a response record."""
    status, headers, payload = split_http(block)
    text, facts = read_page(page_of(headers, payload))
    kept = {"WARC-Payload-Digest": digest(payload), "WARC-Block-Digest": digest(block)} | {k: v for k, v in fields.items() if v is not None}
    source = {k: kept.get(k) for k in ("WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "WARC-Payload-Digest", "WARC-Block-Digest")}
    said = {"source": source, "http": {"status": status, "headers": [list(x) for x in headers]}, "html": facts}
    out = []
    for kind, content_type, data in (
        ("metadata", "application/json", json.dumps(said, ensure_ascii=False, sort_keys=True).encode()),
        ("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace")),
    ):
        out.append(
            (
                {
                    "WARC-Type": kind,
                    "WARC-Record-ID": record_id(kind, kept.get("WARC-Record-ID") or ""),
                    "WARC-Refers-To": kept.get("WARC-Record-ID"),
                    "WARC-Date": kept.get("WARC-Date"),
                    "WARC-Target-URI": kept.get("WARC-Target-URI"),
                    "WARC-Payload-Digest": kept["WARC-Payload-Digest"],
                    "WARC-Block-Digest": digest(data),
                    "Content-Type": content_type,
                },
                data,
            )
        )
    return out


def _unpacked(data: bytes) -> Iterator[bytes]:
    """Of gzip members one after another; a member that is cut off or damaged is the last. Plain data as it is."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data:
        one = zlib.decompressobj(31)
        try:
            yield one.decompress(data)
        except zlib.error:
            return
        data = one.unused_data


def read_records(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes, bool]]:
    """(header fields, block, truncated) of the records of a WARC file, gzip members or plain; a record may lie in several members."""
    held, at = b"", 0
    for part in _unpacked(data):
        held, at = held[at:] + part, 0
        while (record := _record(held, at)) and record[3] <= len(held):
            yield record[0], record[1], False
            at = record[3]
            while held[at : at + 2] == b"\r\n":
                at += 2
    if record := _record(held, at):
        yield record[0], record[1], True
    elif held[at:]:
        yield [], held[at:], True


def _record(data: bytes, at: int) -> tuple[list[tuple[str, str]], bytes, bool, int] | None:
    """Fields, block, whether it is whole, and where it ends, of a record whose head is there."""
    end = data.find(b"\r\n\r\n", at)
    if end < 0 or not data.startswith(b"WARC/", at):
        return None
    fields = _fields(data[at:end].decode("utf-8", "replace").split(CRLF)[1:])
    size = next((v for k, v in fields if k.lower() == "content-length"), "")
    stop = end + 4 + (int(size) if size.isascii() and size.isdigit() else 0)
    return fields, data[end + 4 : stop], stop <= len(data), stop


SCHEMA = "record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, content_length long, payload_digest string, block_digest string, content string"


PLACES = ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "WARC-Date", "Content-Type")
KINDS = [*[pa.string()] * 6, pa.int64(), *[pa.string()] * 3]
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def _row(fields: dict[str, str | None], data: bytes, with_member: bool) -> tuple:
    row = (*[fields.get(k) for k in PLACES], len(data), fields.get("WARC-Payload-Digest"), fields.get("WARC-Block-Digest"), data.decode("utf-8", "replace"))
    return row + ((gzip.compress(record(fields, data), mtime=0),) if with_member else ())


def derivatives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", with_response: bool = True, with_member: bool = False) -> DataFrame:
    """Rows for each page: page_id, and the fields and content of the response that is made of it (on demand), of its metadata and of its conversion; on demand member: the record as a gzip member, to be put one after another in a WARC file."""
    kind = pages.schema[id_col].dataType.simpleString()
    schema = f"page_id {kind}, {SCHEMA}" + ", member binary" * with_member

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                keys, rows = [], []
                for i, (key, url, page) in enumerate(zip(*[part.column(j).to_pylist() for j in (0, 1, 2)])):
                    source, block, _ = response("" if key is None else str(key), url, page or "")
                    for f, data in [(source, block)] * with_response + derive(source, block):
                        keys.append(i)
                        rows.append(_row(f, data, with_member))
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), [*KINDS, pa.binary()])]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keys, pa.int64())), *columns], ["page_id", *NAMES] + ["member"] * with_member)

    return pages.select(id_col, url_col, html_col).mapInArrow(run, schema)


FIELD = "array<struct<name: string, value: string>>"


def read_warc(spark, path: str) -> DataFrame:
    """Rows (path, fields, block, truncated) of the records of WARC files; fields: the header's names and values in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                for fields, block, truncated in read_records(data.as_py()):
                    pairs = [{"name": k, "value": v} for k, v in fields]
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([pairs], kind), pa.array([block], pa.binary()), pa.array([truncated])], ["path", "fields", "block", "truncated"])

    files = spark.read.format("binaryFile").load(path).select(F.col("path"), F.col("content"))
    return files.mapInArrow(run, f"path string, fields {FIELD}, block binary, truncated boolean")


def derivatives_of_records(records: DataFrame, with_member: bool = False) -> DataFrame:
    """Two rows for each response among records (fields, block), as read_warc gives them: the fields and content of its metadata and its conversion."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fields, block in zip(batch.column(0).to_pylist(), batch.column(1)):
                named = {x["name"]: x["value"] for x in reversed(fields)}  # the first of a name holds
                columns = zip(*[_row(f, data, with_member) for f, data in derive(named, block.as_py())])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [*KINDS, pa.binary()])], NAMES + ["member"] * with_member)

    responses = records.filter(F.exists("fields", lambda f: (F.lower(f["name"]) == "warc-type") & (f["value"] == "response")))
    return responses.select("fields", "block").mapInArrow(run, SCHEMA + ", member binary" * with_member)
