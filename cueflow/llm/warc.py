"""WARC derivatives: metadata and plain-text conversion records from responses.

``page_responses`` wraps pages as WARC/1.1 response records (bytes).  ``derivatives`` reads
response records and builds, for each, a ``metadata`` record (title, charset, links, the
source's HTTP headers) and a ``conversion`` record (plain text).  Both refer to the response
by WARC-Refers-To, carry its target URI and date (as WARC-Refers-To-Target-URI and -Date in
the conversion), and have payload and block digests of their own; the metadata record names
the conversion too.  Record ids are UUIDs made from content, so reruns agree.

Defined results: null html is an empty payload; null url leaves the target URI out; records
other than responses pass no derivative; a record that can't be parsed gives one row with
``error``; repeated rows give repeated records with equal ids; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION, DATE = "WARC/1.1", "2024-01-01T00:00:00Z"

_HIDDEN = re.compile(r"<!--.*?(?:-->|$)|<(script|style|noscript|template|head)\b.*?(?:</\1\s*>|$)", re.IGNORECASE | re.DOTALL)
_BREAK = re.compile(r"</?(?:p|div|br|li|ul|ol|tr|td|th|table|h[1-6]|section|article|header|footer|nav|main|aside|blockquote|pre|title|body|html)\b[^>]*>", re.IGNORECASE)
_TAG = re.compile(r"<(?:/?[A-Za-z][^>]*|![^>]*)>")
_TITLE, _TITLE_END = re.compile(r"<title\b[^>]*>", re.IGNORECASE), re.compile(r"</title\s*>", re.IGNORECASE)
_LINK, _NAME = re.compile(r"<a\b", re.IGNORECASE), re.compile(r"\bhref", re.IGNORECASE)
_HREF = re.compile(r"""href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_BLANKS, _LINES = re.compile(r"[ \t\f\v\r\xa0]+"), re.compile(r" ?\n[ \n]*")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: bytes | str) -> str:
    """A urn:uuid made from the parts."""
    h = hashlib.sha256()
    for part in parts:
        part = part.encode() if isinstance(part, str) else part
        h.update(len(part).to_bytes(8, "big") + part)
    return f"<urn:uuid:{uuid.UUID(bytes=h.digest()[:16], version=4)}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse_head(data: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """First line, headers and what follows the blank line."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    headers: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in (" ", "\t") and headers:
            headers[-1] = (headers[-1][0], f"{headers[-1][1]} {line.strip()}")
        else:
            name, _, value = line.partition(":")
            headers.append((name.strip(), value.strip()))
    return first, headers, rest


def value_of(headers: list[tuple[str, str]], name: str) -> str | None:
    return next((v for k, v in headers if k.lower() == name.lower()), None)


# A tag that never closes must not be looked for from every place where one could open: each
# search below goes over the page once.


def _closed(pattern: re.Pattern, to: str, page: str) -> str:
    """``pattern.sub``; it ends with ``>``, so what is behind the last one is left alone."""
    end = page.rfind(">") + 1
    return pattern.sub(to, page[:end]) + page[end:]


def title_of(page: str) -> str | None:
    """What stands between the first title tag and the first end of one behind it."""
    begin = _TITLE.search(page, 0, page.rfind(">") + 1)
    end = _TITLE_END.search(page, begin.end()) if begin else None
    return page[begin.end() : end.start()] if end else None


def links_of(page: str) -> list[str]:
    """The first href of every ``a`` tag."""
    out, at = [], 0
    while tag := _LINK.search(page, at):
        stop = page.find(">", tag.end())
        stop = len(page) if stop < 0 else stop
        name, value = _NAME.search(page, tag.end(), stop), None
        while name and not (value := _HREF.match(page, name.start())):
            name = _NAME.search(page, name.end(), stop)
        if value:
            out.append(html.unescape(next(g for g in value.groups() if g is not None)))
        # Without a link no other place before the tag's end can begin one either.
        at = value.end() if value else stop
    return out


def plain_text(page: str) -> str:
    text = _closed(_TAG, " ", _closed(_BREAK, "\n", _HIDDEN.sub(" ", page)))
    return _LINES.sub("\n", _BLANKS.sub(" ", html.unescape(text))).strip()


def response(url: str | None, page: str | bytes, date: str = DATE) -> tuple[str, bytes]:
    """Id and bytes of the response record of a page."""
    payload = page.encode() if isinstance(page, str) else page
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    name = record_id("response", url or "", payload)
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", name), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", re.sub(r"[\r\n]+", " ", url)))
    headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(http))]
    return name, record(headers, http)


def derive(data: bytes) -> list[dict]:
    """The metadata and the conversion record of a response record."""
    version, headers, rest = parse_head(data)
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    if value_of(headers, "WARC-Type") != "response":
        return []
    block = rest[: int(value_of(headers, "Content-Length") or 0)]
    if (said := value_of(headers, "WARC-Block-Digest")) and said.startswith("sha1:") and said != digest(block):
        raise ValueError("the block doesn't match its digest")
    status, http, payload = parse_head(block)
    source, uri, date = value_of(headers, "WARC-Record-ID") or "", value_of(headers, "WARC-Target-URI"), value_of(headers, "WARC-Date") or DATE
    charset = re.search(r"charset=\"?([\w.-]+)", value_of(http, "Content-Type") or "", re.IGNORECASE)
    try:
        page = payload.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        page = payload.decode("utf-8", "replace")
    text = plain_text(page).encode()
    title, links = title_of(page), links_of(page)
    conversion, metadata = record_id("conversion", source, text), record_id("metadata", source, text)
    one_line = lambda s: re.sub(r"\s+", " ", s).strip()
    fields = [
        ("title", one_line(html.unescape(title or ""))), ("charset", charset[1].lower() if charset else ""), ("http-status", status),
        ("conversion-record-id", conversion), ("source-payload-digest", value_of(headers, "WARC-Payload-Digest") or digest(payload)),
        *((f"source-header-{k.lower()}", v) for k, v in http), *(("outlink", one_line(x)) for x in links),
    ]
    described = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    target = [("WARC-Target-URI", uri)] if uri is not None else []
    out = []
    for kind, name, body, mime, extra in (
        ("metadata", metadata, described, "application/warc-fields", []),
        ("conversion", conversion, text, "text/plain; charset=utf-8", [*([("WARC-Refers-To-Target-URI", uri)] if uri is not None else []), ("WARC-Refers-To-Date", date)]),
    ):
        head = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", date), *target, ("WARC-Refers-To", source), *extra]
        head += [("Content-Type", mime), ("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", digest(body))]
        out.append({"record_type": kind, "record_id": name, "refers_to": source, "target_uri": uri, "block_digest": digest(body), "source_digest": value_of(headers, "WARC-Payload-Digest"), "n_chars": len(body.decode()), "n_links": len(links), "record": record(head, body)})
    return out


_RECORD = {"record_type": pa.string(), "record_id": pa.string(), "refers_to": pa.string(), "target_uri": pa.string(), "block_digest": pa.string(), "source_digest": pa.string(), "n_chars": pa.int64(), "n_links": pa.int64(), "record": pa.binary(), "error": pa.string()}
RECORD = "record_type string, record_id string, refers_to string, target_uri string, block_digest string, source_digest string, n_chars long, n_links long, record binary, error string"
#: Rows of a batch are turned into records a few at a time: they hold whole pages.
_AT_ONCE = 64


def _respond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, _AT_ONCE):
            part = batch.slice(start, _AT_ONCE)
            made = [response(None if not u.is_valid else u.as_py().decode("utf-8", "replace"), h.as_py() or b"") for u, h in zip(part.column("url"), part.column("html"), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), pa.array([n for n, _ in made], pa.string()), pa.array([r for _, r in made], pa.binary())], names=["page_id", "response_id", "record"])


def _derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, _AT_ONCE):
            part, ids, rows = batch.slice(start, _AT_ONCE), [], []
            for page, data in zip(part.column("page_id"), part.column("record"), strict=True):
                try:
                    made = derive(data.as_py() or b"")
                except ValueError as e:
                    made = [{"error": str(e)}]
                ids += [page.as_py()] * len(made)
                rows += made
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array([r.get(c) for r in rows], t) for c, t in _RECORD.items())], names=["page_id", *_RECORD])


def page_responses(pages: DataFrame) -> DataFrame:
    """page_id, response_id and record (bytes) of every page."""
    return pages.select("page_id", F.col("url").cast("binary").alias("url"), F.col("html").cast("binary").alias("html")).mapInArrow(_respond, "page_id long, response_id string, record binary")


def derivatives(responses: DataFrame) -> DataFrame:
    """The derivative records of responses(page_id, record)."""
    return responses.select("page_id", "record").mapInArrow(_derive, f"page_id long, {RECORD}")


def derivative_digests(pages: DataFrame) -> DataFrame:
    """Every derivative record of every page, with the digest of its bytes in their place."""
    return derivatives(page_responses(pages)).select(
        "page_id", "record_type", "record_id", "refers_to", "target_uri", "block_digest", "source_digest", "n_chars", "n_links", F.sha2("record", 256).alias("record_sha256"), "error"
    )
