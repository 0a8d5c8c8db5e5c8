"""WARC derivatives: every response record gives a metadata and a plain-text conversion record.

Derivatives point to their response by WARC-Refers-To and keep its address, date, HTTP headers
and digests. Their own ids come from the response's id and their contents, so a task that is
run again after a lost executor gives the same records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from waymesh.llm.common import map_frames, map_rows
from waymesh.llm.html_extract import RAW, blocks_of, tree_of

VERSION = "WARC/1.1"
#: The date of responses made from tables that have none.
NO_DATE = "1970-01-01T00:00:00Z"

HREF = re.compile(r"(?:^|\s)href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Comments; elements whose contents are no markup; links and bases with their attributes.
LINKING = re.compile(
    rf"<!--.*?(?:-->|$)|<({'|'.join(sorted(RAW))})\b[^>]*>(.*?)(?:</\1\b|$)|<(a|base)\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.I | re.S
)
CHARSET = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9._:-]+)", re.I)


@dataclass
class Record:
    """Header fields in order, and the block; not ``sound`` if the header gave it no length."""

    headers: list[tuple[str, str]] = field(default_factory=list)
    block: bytes = b""
    sound: bool = True

    def get(self, name: str) -> str | None:
        return next((v for k, v in self.headers if k.lower() == name.lower()), None)

    def to_bytes(self) -> bytes:
        lines = "".join(f"{k}: {v}\r\n" for k, v in self.headers if k.lower() != "content-length")
        return f"{VERSION}\r\n{lines}Content-Length: {len(self.block)}\r\n\r\n".encode() + self.block + b"\r\n\r\n"


def header_lines(raw: bytes) -> tuple[str, list[tuple[str, str]]]:
    """The first line and the fields of a header; continued lines are joined."""
    lines = raw.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")
    fields: list[tuple[str, str]] = []
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and fields:
            fields[-1] = (fields[-1][0], f"{fields[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            fields.append((name.strip(), value.strip()))
    return lines[0].strip(), fields


def read_records(stream: io.BufferedIOBase) -> Iterator[Record]:
    """Records of an uncompressed stream, one at a time.

    Where the length is no number, the block is what stands before the next record begins.
    """
    line = stream.readline()
    while line:
        if not line.strip():
            line = stream.readline()
            continue
        raw = line
        while (line := stream.readline()).strip():
            raw += line
        record = Record(header_lines(raw)[1])
        size = record.get("Content-Length") or "0"
        if size.isascii() and size.isdigit():
            record.block = stream.read(int(size))
            line = stream.readline()
        else:
            record.sound = False
            held = []
            while (line := stream.readline()) and not line.startswith(b"WARC/"):
                held.append(line)
            record.block = b"".join(held)
        yield record


def open_warc(raw: bytes) -> io.BufferedIOBase:
    """The records' stream of a file, inflated as it is read if it is compressed member by member."""
    source = io.BytesIO(raw)
    return gzip.GzipFile(fileobj=source) if raw[:2] == b"\x1f\x8b" else source


def digest(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


@dataclass
class Response:
    """An HTTP response: status line, header fields, body as sent and body as meant."""

    status: str
    headers: list[tuple[str, str]]
    payload: bytes
    body: bytes
    decoded: bool = True

    def get(self, name: str) -> str:
        return next((v for k, v in self.headers if k.lower() == name), "")

    def text(self) -> str:
        """The body decoded by the charset of the header, or of the page, or as UTF-8."""
        found = CHARSET.search(self.get("content-type")) or CHARSET.search(self.body[:2048].decode("latin-1"))
        try:
            return self.body.decode(found[1] if found else "utf-8", "replace")
        except LookupError:
            return self.body.decode("utf-8", "replace")


def unchunked(raw: bytes) -> bytes:
    out, at = [], 0
    while (end := raw.find(b"\r\n", at)) >= 0:
        try:
            size = int(raw[at:end].split(b";")[0], 16)
        except ValueError:
            return raw
        if size == 0:
            break
        out.append(raw[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return b"".join(out)


def inflated(raw: bytes, coding: str) -> tuple[bytes, bool]:
    """``raw`` without its content coding, and whether the coding is one this knows; damaged bodies stay as they are."""
    kinds = {"": (), "identity": (), "gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}
    if coding not in kinds:
        return b"", False
    for bits in kinds[coding]:
        try:
            return zlib.decompress(raw, bits), True
        except zlib.error:
            continue
    return raw, True


def http_response(block: bytes) -> Response:
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not gap:
        head, gap, payload = block.partition(b"\n\n")
    status, headers = header_lines(head)
    out = Response(status, headers, payload, payload)
    if out.get("transfer-encoding").strip().lower() == "chunked":
        out.payload = out.body = unchunked(payload)
    out.body, out.decoded = inflated(out.payload, out.get("content-encoding").strip().lower())
    return out


def title_and_links(page: str, target: str) -> tuple[str, list[str]]:
    """The title and the addresses of the links, in order and once each, from the page's own address or its base.

    What stands in comments, scripts and the like is no link.
    """
    title, base, links = None, None, {}
    for match in LINKING.finditer(page):
        if match[1]:
            if title is None and match[1].lower() == "title":
                title = one_line(html.unescape(match[2]))
        elif match[3]:
            href = HREF.search(match[4])
            link = one_line(html.unescape(href[1] or href[2] or href[3] or "")) if href else ""
            if link and match[3].lower() == "a":
                links.setdefault(link)
            elif link and base is None:
                base = link
    start = resolved(target, base) if base else target
    return title or "", list(dict.fromkeys(resolved(start, link) for link in links))


def plain_text(page: str) -> str:
    """All visible text, a line for each block."""
    return "\n".join(blocks_of(tree_of(page, marks=False), marked_too=True))


def one_line(text: str) -> str:
    return " ".join(text.split())


def derivatives(record: Record, response: Response | None = None) -> list[Record]:
    """The metadata and the conversion record of a response record, whose block may have been read already."""
    response = response or http_response(record.block)
    kind = (response.get("content-type") or "html").lower()
    page = response.text() if "html" in kind and response.decoded else None
    text = plain_text(page) if page is not None else response.text() if kind.startswith("text/") and response.decoded else ""
    source = record.get("WARC-Record-ID") or ""
    target = record.get("WARC-Target-URI") or ""
    block_digest, payload_digest = digest(record.block), digest(response.payload)
    stated = record.get("WARC-Payload-Digest")
    facts = [
        ("source-status", response.status),
        *[(f"source-header-{k.lower()}", v) for k, v in response.headers],
        ("source-block-digest", block_digest),
        ("source-payload-digest", payload_digest),
        ("source-digest-check", "absent" if stated is None else "ok" if stated == payload_digest else "mismatch"),
    ]
    if not record.sound:
        facts.append(("source-header-check", "no content length"))
    if not response.decoded:
        facts.append(("source-coding-check", "not decoded"))
    if page is not None:
        title, links = title_and_links(page, target)
        facts += [("title", title), *[("outlink", link) for link in links]]
    meta = "".join(f"{k}: {one_line(v)}\r\n" for k, v in facts).encode()
    out = []
    for kind, content_type, block in (("metadata", "application/warc-fields", meta), ("conversion", "text/plain; charset=utf-8", text.encode())):
        headers = [
            ("WARC-Type", kind),
            ("WARC-Record-ID", f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{source} {kind} {digest(block)}').urn}>"),
            ("WARC-Date", record.get("WARC-Date") or NO_DATE),
            ("WARC-Target-URI", target),
            ("WARC-Refers-To", source),
            ("WARC-Block-Digest", digest(block)),
            ("WARC-Payload-Digest", digest(block)),
            ("Content-Type", content_type),
        ]
        out.append(Record([(k, v) for k, v in headers if v], block))
    return out


def resolved(base: str, link: str) -> str:
    try:
        return urljoin(base, link)
    except ValueError:
        return link


def response_record(record_id: str, url: str | None, date: str, page: str | None) -> Record:
    """A response record around a page as a server would have sent it."""
    body = (page or "").encode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    headers = [
        ("WARC-Type", "response"),
        ("WARC-Record-ID", record_id),
        ("WARC-Date", date),
        ("WARC-Target-URI", one_line(url or "")),
        ("WARC-Payload-Digest", digest(body)),
        ("WARC-Block-Digest", digest(head + body)),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    return Record([(k, v) for k, v in headers if v], head + body)


def responses_of_pages(pages: DataFrame, date: str = NO_DATE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, record``: a response record for every row of ``pages``; a null page has an empty body."""

    def make():
        def work(batch: pd.DataFrame) -> pd.DataFrame:
            records = [
                response_record(f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest((page or "").encode())}').urn}>", url, date, page).to_bytes()
                for page_id, url, page in zip(batch["page_id"], batch["url"], batch["html"], strict=True)
            ]
            return pd.DataFrame({"page_id": batch["page_id"], "record": records})

        return work

    own = pages.select(
        pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html")
    )
    return map_rows(own, make, "page_id long, record binary")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, record`` of the response records in the WARC files at ``path``; ``page_id`` is null.

    A file is one row of Spark's binaryFile source, so files are to stay below 2 GB; records are
    handed on one by one.
    """

    def run(batches):
        for batch in batches:
            for raw in batch["content"]:
                for record in read_records(open_warc(bytes(raw))):
                    if record.get("WARC-Type") == "response":
                        yield pd.DataFrame({"page_id": [None], "record": [record.to_bytes()]}, dtype=object)

    return map_frames(spark.read.format("binaryFile").load(path).select("content"), run, "page_id long, record binary")


def derive(responses: DataFrame, id_col: str = "page_id", record_col: str = "record") -> DataFrame:
    """Two rows for every row of ``responses``, its metadata and its conversion record.

    ``page_id, record_type, record_id, refers_to, target_uri, date, content_type, content_length,
    block_digest, payload_digest, block, record``: ``payload_digest`` is the source's, ``block`` the
    text of the derivative, ``record`` its bytes as they stand in a WARC file, with digests of its own.
    A null or empty record counts as a response without header and body; one whose header has no
    length that is a number is told so in its metadata, as is a body in a coding that isn't known, which
    gives no text. Pages may be nested to any depth. Repeated rows give repeated
    derivatives; an empty table gives none; further columns are ignored.
    """

    def make():
        def work(batch: pd.DataFrame) -> pd.DataFrame:
            rows = []
            for page_id, raw in zip(batch["page_id"], batch["record"], strict=True):
                source = next(read_records(io.BytesIO(bytes(raw or b""))), Record())
                response = http_response(source.block)
                payload = digest(response.payload)
                for made in derivatives(source, response):
                    names = ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "WARC-Date", "Content-Type")
                    fields = [made.get(n) for n in names]
                    digests = [made.get("WARC-Block-Digest"), payload]
                    rows.append((page_id, *fields, len(made.block), *digests, made.block.decode(), made.to_bytes()))
            return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")], dtype=object)

        return work

    schema = (
        "page_id long, record_type string, record_id string, refers_to string, target_uri string, date string, "
        "content_type string, content_length long, block_digest string, payload_digest string, block string, record binary"
    )
    own = responses.select(responses[id_col].cast("long").alias("page_id"), responses[record_col].alias("record"))
    return map_rows(own, make, schema)
