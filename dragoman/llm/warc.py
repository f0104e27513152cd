"""Derivatives of web archive responses: linked metadata and plain-text conversion records.

Every response gives two records. The metadata record lists what the page says about itself (title, language,
links) with the response's own headers; the conversion record holds the page's text. Both name the response they
come from in WARC-Refers-To, keep its target URI, date, content type and digest, and carry digests of their own
blocks. Record ids are derived from the response's id and the kind, so reruns write the same records.

Null payloads are empty, null URIs are left out of the headers. Repeated responses give repeated records with the
same ids. Malformed markup never fails: what is not a tag is text. An empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Date of responses that come without one.
NO_DATE = "1970-01-01T00:00:00Z"
UNSEEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|title)\b.*?(?:</\1\s*>|\Z)", re.I | re.S)
BREAKS = re.compile(r"</?(?:p|div|br|hr|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|nav|main|aside|blockquote|pre|form|dt|dd|dl|option|td|th)\b[^>]*>", re.I)
TAG = re.compile(r"</?[a-z!?][^>]*>", re.I)
TITLE = re.compile(r"<title\b[^>]*>(.*?)(?:</title\s*>|\Z)", re.I | re.S)
LANGUAGE = re.compile(r"\blang\s*=\s*[\"']?([a-z0-9-]+)", re.I)
HREF = re.compile(r"\bhref\s*=\s*", re.I)
VALUE = re.compile(r"\"([^\"]*)\"|'([^']*)'|([^\s>]+)")
BLANKS = re.compile(r"[^\S\n]+")
FIELDS = "record_id string, refers_to string, kind string, target_uri string, date string, content_type string, content_length long, block_digest string, source_digest string, headers string, block string"


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(source: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{source}#{kind}')}>"


def without_tags(text: str, breaks: bool = False) -> str:
    """Text without its tags. Behind the last ``>`` there is none, so there every search for an end would be in vain."""
    end = text.rfind(">") + 1
    head = BREAKS.sub("\n", text[:end]) if breaks else text[:end]
    return TAG.sub("", head) + text[end:]


def attributes(page: str, tag: str) -> Iterator[tuple[int, int]]:
    """Where the attributes of the tags of a name lie: each tag ends at the next ``>`` and is looked at once."""
    start = re.compile(rf"<{tag}\b", re.I)
    at = 0
    while m := start.search(page, at):
        at = page.find(">", m.end())
        if at < 0:
            return
        yield m.end(), at


def links(page: str) -> Iterator[str]:
    """Targets of the links of a page, in order."""
    for a, b in attributes(page, "a"):
        m = HREF.search(page, a, b)
        value = m and VALUE.match(page, m.end())
        if value:
            yield next(v for v in value.groups() if v is not None)


def language(page: str) -> str | None:
    for a, b in attributes(page, "html"):
        if m := LANGUAGE.search(page, a, b):
            return m[1].lower()
    return None


def title(page: str) -> str | None:
    end = page.rfind(">") + 1
    m = TITLE.search(page) if "<title" in page[:end].lower() else None
    return _one_line(m[1]) if m else None


def plain_text(page: str) -> str:
    """Text of a page, a line for each block, blanks folded, without scripts, styles, comments and title."""
    text = without_tags(UNSEEN.sub(" ", page), True)
    lines = (BLANKS.sub(" ", x).strip() for x in html.unescape(text).replace("\r", "\n").split("\n"))
    return "\n".join(x for x in lines if x)


def _one_line(text: str) -> str:
    return " ".join(html.unescape(without_tags(text)).split())


def metadata(page: str, http_headers: str) -> str:
    """Fields of the metadata block, one a line."""
    fields = [(k, v) for k, v in (("title", title(page)), ("language", language(page))) if v is not None]
    fields += [("source-header", _one_line(h)) for h in http_headers.splitlines() if h.strip()]
    fields += [("outlink", _one_line(target)) for target in links(UNSEEN.sub(" ", page))]
    return "".join(f"{k}: {v}\r\n" for k, v in fields)


def _header(kind: str, own: str, source: dict, content_type: str, block: bytes, source_digest: str) -> str:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {own}", f"WARC-Date: {source['date']}"]
    if source["target_uri"] is not None:
        lines.append(f"WARC-Target-URI: {_one_line(source['target_uri'])}")
    lines += [
        f"WARC-Refers-To: {source['record_id']}", f"WARC-Source-Payload-Digest: {source_digest}", f"WARC-Source-Content-Type: {source['content_type']}",
        f"WARC-Block-Digest: {digest(block)}", f"Content-Type: {content_type}", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines) + "\r\n\r\n"


def _derived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in FIELDS.split(", ")]
    for batch in batches:
        for a in range(0, batch.num_rows, 128):
            part = batch.slice(a, 128)
            rows, origin = [], []
            for i, source in enumerate(part.select(["record_id", "target_uri", "date", "content_type", "http_headers", "payload"]).to_pylist()):
                page = source["payload"] or ""
                whole = digest(page.encode("utf-8", "replace"))
                for kind, content_type, text in (("metadata", "application/warc-fields", metadata(page, source["http_headers"] or "")), ("conversion", "text/plain; charset=utf-8", plain_text(page))):
                    block = text.encode("utf-8", "replace")
                    own = record_id(source["record_id"], kind)
                    head = _header(kind, own, source, content_type, block, whole)
                    rows.append((own, source["record_id"], kind, source["target_uri"], source["date"], content_type, len(block), digest(block), whole, head, block.decode()))
                    origin.append(i)
            keys = part.column(0).take(pa.array(origin, pa.int64()))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([keys, *[pa.array(c, pa.int64() if n == "content_length" else pa.string()) for n, c in zip(names, columns, strict=True)]], ["key", *names])


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", date: Column | None = None) -> DataFrame:
    """Response records of a table of pages; the id is made of the key and the URL, or of the payload where both are missing."""
    nameless = F.when(F.col(key).isNull() & F.col(url).isNull(), F.md5(F.coalesce(F.col(payload), F.lit("")).cast("binary")))
    name = F.concat_ws(" ", F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce(F.col(url), F.lit("")), nameless)
    h = F.md5(name)
    dashed = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return pages.select(
        F.col(key).alias("key"), F.concat(F.lit("<urn:uuid:"), dashed, F.lit(">")).alias("record_id"), F.col(url).alias("target_uri"),
        (date if date is not None else F.lit(NO_DATE)).alias("date"), F.lit("text/html").alias("content_type"),
        F.lit("HTTP/1.1 200 OK\nContent-Type: text/html; charset=utf-8").alias("http_headers"), F.col(payload).alias("payload"),
    )


def derive(source: DataFrame) -> DataFrame:
    """Two records for every response: key and the columns of ``FIELDS``."""
    return source.select("key", "record_id", "target_uri", "date", "content_type", "http_headers", "payload").mapInArrow(
        _derived, f"key {dict(source.dtypes)['key']}, {FIELDS}"
    )


def write(records: DataFrame, path: str) -> None:
    """WARC files, gzipped, one per partition. A record ends with two line ends; the writer adds the last byte."""
    records.select(F.concat("headers", "block", F.lit("\r\n\r")).alias("value")).write.option("compression", "gzip").text(path, lineSep="\n")
