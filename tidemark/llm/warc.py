"""Derivatives of WARC responses: linked metadata records and plain-text conversion records.

Every response record gives one ``metadata`` record (status, title, outgoing links, source
headers and digests) and, where its payload is HTML or plain text, one ``conversion`` record
(text). Both carry ``WARC-Refers-To`` with the identifier, target and date of the response.
Record identifiers are name-based UUIDs of the response identifier, so that a task that runs
again writes the same records.

Cases: a null record gives nothing; a record without a WARC header gives one metadata record that
says so and refers to nothing; an empty payload gives an empty conversion; unknown charsets are
read as UTF-8 with replacement; repeated records give repeated derivatives; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
import uuid
from base64 import b32encode
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import short_batches

DERIVED = (
    "source_id long, record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, "
    "content_length long, block_digest string, source_digest string, source_digest_ok boolean, source_headers string, body string"
)
_COLUMNS = [c.split()[0] for c in DERIVED.split(", ")]
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space of URLs in RFC 4122
_HIDDEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<(script|style|noscript|template|svg)\b(?:.*?</\1\s*>|.*\Z)", re.DOTALL | re.IGNORECASE)
_HEAD = re.compile(r"<head\b.*?(?:</head\s*>|(?=<body\b)|\Z)", re.DOTALL | re.IGNORECASE)
_BREAK = re.compile(r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b[^<>]*>", re.IGNORECASE)
_TAG = re.compile(r"</?[a-zA-Z!?][^<>]*>")
_BLANK = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[ \n]*")
_TITLE = re.compile(r"<title\b[^<>]*>([^<]*)", re.IGNORECASE)
_LINK = re.compile(r"<a\s[^<>]*?href\s*=\s*(?:\"([^\"<>]*)\"|'([^'<>]*)'|([^\s<>\"']+))", re.IGNORECASE)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.IGNORECASE)


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """``pages`` (page_id, url, html) as WARC/1.1 response records (source_id, record)."""
    crlf = F.lit("\r\n")
    body = F.coalesce("html", F.lit("")).cast("binary")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), crlf, crlf).cast("binary")
    block = F.concat(http, body)
    key = F.sha1(F.concat_ws(" ", F.col("page_id").cast("string"), "url").cast("binary"))
    ident = F.concat_ws("-", *[F.substring(key, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, crlf)

    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\n"),
        line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), ident, F.lit(">"))),
        F.coalesce(line("WARC-Target-URI", F.col("url")), F.lit("")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1(body))),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.sha1(block))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        crlf,
    ).cast("binary")
    return pages.select(F.col("page_id").alias("source_id"), F.concat(head, block).alias("record"))


def _fields(raw: bytes) -> list[tuple[str, str]]:
    """Header fields in their order; folded lines are joined."""
    out: list[tuple[str, str]] = []
    for line in raw.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def _get(fields: list[tuple[str, str]], name: str) -> str | None:
    return next((v for k, v in fields if k.lower() == name), None)


def _digest(block: bytes, like: str | None = None) -> str:
    """sha1 of a block, in hexadecimal if ``like`` is, else in base 32."""
    h = hashlib.sha1(block)
    return f"sha1:{h.hexdigest()}" if like and re.fullmatch(r"sha1:[0-9a-fA-F]{40}", like) else f"sha1:{b32encode(h.digest()).decode()}"


def plain_text(markup: str) -> str:
    """Visible text of HTML, one line per block element."""
    text = _HEAD.sub("\n", _HIDDEN.sub("", markup), count=1)
    text = html.unescape(_TAG.sub("", _BREAK.sub("\n", text.replace("\n", " "))))
    return _LINES.sub("\n", _BLANK.sub(" ", text)).strip()


def _derive(source: int | None, record: bytes) -> Iterator[tuple]:
    head, _, rest = record.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        body = "warning: no WARC header\r\n"
        yield (source, "metadata", f"<urn:uuid:{uuid.uuid5(_SPACE, 'metadata ' + hashlib.sha1(record).hexdigest())}>", None, None, None, "application/warc-fields", len(body), _digest(body.encode()), None, None, "", body)
        return
    fields = _fields(head)
    size = _get(fields, "content-length")
    block = rest[: int(size)] if size and size.isdigit() else rest
    given = _get(fields, "warc-block-digest")
    ident, uri, date = (_get(fields, k) for k in ("warc-record-id", "warc-target-uri", "warc-date"))
    http, _, payload = block.partition(b"\r\n\r\n")
    status, _, lines = http.partition(b"\r\n")
    headers = _fields(lines)
    kind = (_get(headers, "content-type") or "").lower()
    found = _CHARSET.search(kind) or _CHARSET.search(payload[:1024].decode("latin-1"))
    try:
        text = payload.decode(found[1] if found else "utf-8", "replace")
    except LookupError:
        text = payload.decode("utf-8", "replace")
    is_html, is_text = "html" in kind, kind.startswith("text/")
    source_lines = "".join(f"{k}: {v}\r\n" for k, v in headers)
    ok = _digest(block, given).lower() == given.lower() if given and given.lower().startswith("sha1:") else None
    title = _TITLE.search(text) if is_html else None
    links = dict.fromkeys(html.unescape(a or b or c) for a, b, c in _LINK.findall(text)) if is_html else {}
    meta = [f"status: {status.decode('latin-1')}", *([f"title: {' '.join(html.unescape(title[1]).split())}"] if title else [])]
    meta += [f"payload-length: {len(payload)}", f"payload-digest: {_get(fields, 'warc-payload-digest') or _digest(payload)}"]
    meta += [f"source-block-digest: {given}"] if given else []
    meta += [f"source-header: {k}: {v}" for k, v in headers]
    meta += [f"outlink: {' '.join(x.split())}" for x in links]
    bodies = [("metadata", "application/warc-fields", "".join(f"{m}\r\n" for m in meta))]
    if is_html or is_text:
        bodies.append(("conversion", "text/plain; charset=utf-8", plain_text(text) if is_html else text))
    for what, content, body in bodies:
        raw = body.encode("utf-8", "replace")
        new = f"<urn:uuid:{uuid.uuid5(_SPACE, f'{what} {ident}')}>"
        yield (source, what, new, ident, uri, date, content, len(raw), _digest(raw), given, ok, source_lines, body)


def derive(records: DataFrame) -> DataFrame:
    """Derivative records of response records (source_id, record binary)."""

    short_batches(records.sparkSession)

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["source_id"].astype("Int64")
            out = [d for i, r in zip(ids, batch["record"], strict=True) if r is not None for d in _derive(None if pd.isna(i) else int(i), bytes(r))]
            frame = pd.DataFrame(out, columns=_COLUMNS)
            yield frame.assign(source_id=frame["source_id"].astype("Int64"), source_digest_ok=frame["source_digest_ok"].astype("boolean"))

    return records.select("source_id", "record").mapInPandas(build, DERIVED)


def as_record(d: DataFrame) -> Column:
    """The whole WARC record of a derivative row as one string, without its closing blank lines."""
    names = [("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Refers-To-Target-URI", "target_uri"), ("WARC-Refers-To-Date", "warc_date"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length")]
    lines = [F.coalesce(F.concat(F.lit(f"{n}: "), d[c].cast("string"), F.lit("\r\n")), F.lit("")) for n, c in names]
    return F.concat(F.lit("WARC/1.1\r\n"), *lines, F.lit("\r\n"), d["body"])


def write(d: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write derivative rows as WARC files, one per task."""
    d.select(as_record(d).alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def digest(pages: DataFrame) -> DataFrame:
    """Derivatives of the whole table; ``page_id`` is the id of the page."""
    return derive(responses(pages)).withColumnRenamed("source_id", "page_id")
