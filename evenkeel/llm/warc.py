"""Derivatives of WARC response records: linked metadata and plain-text conversion records.

Each response gives a metadata record (title, links, the source's HTTP headers and
digests) and a conversion record (its text).  Both refer to the response by
WARC-Refers-To, keep its target and date, name each other by WARC-Concurrent-To, and have digests of
their own blocks.  Ids are derived from the response's id, so reruns agree.

Responses without a payload give both records with an empty text.  A null id is the
empty one, a null target or date leaves its header out.  Repeated responses give
repeated records; an empty input gives none.  One response is held at a time, and the
work on it grows with its length, also where its tags, comments or quotes are never closed.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

VERSION = "WARC/1.1"
#: Between the records of a file.
BETWEEN = "\r\n\r\n"

_OPENS = re.compile(r"<!--|<(script|style|template|noscript)\b", re.I)
_CLOSES = {None: re.compile("-->")} | {
    tag: re.compile(rf"</{tag}\s*>", re.I) for tag in ("script", "style", "template", "noscript")
}
_BREAKS = re.compile(r"</?(?:p|br|div|li|ul|ol|h[1-6]|tr|table|title|article|section|nav|header|footer|blockquote|pre)\b[^>]*>", re.I)
_TAGS = re.compile(r"<[a-zA-Z/!?][^>]*>")
_SPACES = re.compile(r"[ \t\r\f\v]+")
_LINES = re.compile(r" ?\n[ \n]*")
_TITLE, _TITLE_END = re.compile(r"<title\b[^>]*>", re.I), re.compile(r"</title\s*>", re.I)
_ANCHOR, _HREF = re.compile(r"<a\s", re.I), re.compile(r"\bhref\s*=\s*", re.I)
_TARGET = re.compile(r"""(?:"([^"]*)"|'([^']*)'|["']?([^"'\s>][^\s>]*))""")

FIELDS = {
    "refers_to": pa.string(),
    "warc_type": pa.string(),
    "record_id": pa.string(),
    "concurrent_to": pa.string(),
    "target_uri": pa.string(),
    "warc_date": pa.string(),
    "content_type": pa.string(),
    "content_length": pa.int64(),
    "block_digest": pa.string(),
    "block": pa.string(),
}
_DDL = ", ".join(f"{k} {'long' if v == pa.int64() else 'string'}" for k, v in FIELDS.items())


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _shown(page: str) -> str:
    """The page with a space for each comment, script and the like; one that is never closed is left as it stands."""
    out, at, pos, unclosed = [], 0, 0, set()
    while opened := _OPENS.search(page, pos):
        pos, kind = opened.end(), opened[1] and opened[1].lower()
        closed = None if kind in unclosed else _CLOSES[kind].search(page, pos)
        if closed:
            out += [page[at : opened.start()], " "]
            at = pos = closed.end()
        else:
            unclosed.add(kind)
    return "".join(out) + page[at:]


def plain_text(page: str) -> str:
    """Visible text, one line for each block of the page.  Time grows with the page, whatever is in it."""
    page = _shown(page)
    # no tag ends behind the last ">"
    end = page.rfind(">") + 1
    text = _TAGS.sub("", _BREAKS.sub("\n", page[:end])) + page[end:]
    text = html.unescape(text) if "&" in text else text
    return _LINES.sub("\n", _SPACES.sub(" ", text)).strip()


def _title(page: str) -> str | None:
    opened = _TITLE.search(page, 0, page.rfind(">") + 1)
    closed = opened and _TITLE_END.search(page, opened.end())
    return page[opened.end() : closed.start()] if closed else None


def _outlinks(page: str) -> list[str]:
    """Targets of the page's links in order; a link is sought from ``<a`` to the next ``>``."""
    out, pos = [], 0
    while anchor := _ANCHOR.search(page, pos):
        end = page.find(">", anchor.end())
        end = len(page) if end < 0 else end
        href = _HREF.search(page, anchor.end(), end)
        target = href and _TARGET.match(page, href.end())
        while href and not target:
            href = _HREF.search(page, href.end(), end)
            target = href and _TARGET.match(page, href.end())
        if target:
            out.append(target[1] or target[2] or target[3] or "")
        pos = target.end() if target else end
    return out


def _one_line(value: str) -> str:
    return " ".join(value.split())


def _fields(http: str, payload: str) -> str:
    """The metadata block: source headers and digests, title, links in order."""
    title = _title(payload)
    lines = [f"source-payload-digest: {digest(payload.encode())}", f"source-block-digest: {digest((http + payload).encode())}"]
    headers = [h.partition(":") for h in http.split("\r\n")[1:] if ":" in h]
    lines += [f"source-http-status: {_one_line(http.split(chr(13))[0])}"] if http else []
    lines += [f"source-header-{name.strip().lower()}: {_one_line(value)}" for name, _, value in headers]
    if title is not None:
        lines.append(f"title: {_one_line(html.unescape(title))}")
    links = [_one_line(html.unescape(link)) for link in _outlinks(payload)]
    lines += [f"outlink: {link}" for link in links if link]
    return "".join(f"{line}\r\n" for line in lines)


def _id(source: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} {source}')}>"


def _derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(list(FIELDS.items()))
    for batch in batches:
        for first in range(0, batch.num_rows, 500):
            rows = []
            for r in batch.slice(first, 500).to_pylist():
                source, payload = r["record_id"] or "", r["payload"] or ""
                ids = {kind: _id(source, kind) for kind in ("metadata", "conversion")}
                for kind, other, content, block in (
                    ("metadata", "conversion", "application/warc-fields", _fields(r["http"] or "", payload)),
                    ("conversion", "metadata", "text/plain; charset=utf-8", plain_text(payload)),
                ):
                    data = block.encode()
                    rows.append(
                        (source, kind, ids[kind], ids[other], r["target_uri"], r["warc_date"], content, len(data), digest(data), block)
                    )
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def derive(responses: DataFrame) -> DataFrame:
    """Two records (``FIELDS``) for each row of record_id, target_uri, warc_date, http, payload."""
    names = ("record_id", "target_uri", "warc_date", "http", "payload")
    return responses.select(*[F.col(c).cast("string") for c in names]).mapInArrow(_derive, _DDL)


def responses_of(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of a table of pages (page_id, url, html)."""
    number = F.md5(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit(""))))
    record = F.regexp_replace(number, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")
    length = F.coalesce(F.octet_length("html"), F.lit(0)).cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), length, F.lit(BETWEEN))
    return pages.select(
        record.alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("warc_date"), http.alias("http"),
        F.coalesce("html", F.lit("")).alias("payload"),
    )


def record_text(block: Column) -> Column:
    """A record as it stands in a file, without the lines that follow it."""
    headers = (
        ("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"),
        ("WARC-Concurrent-To", "concurrent_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"),
        ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"),
    )
    lines = [F.concat(F.lit(f"{name}: "), F.col(column).cast("string")) for name, column in headers]
    return F.concat(F.concat_ws("\r\n", F.lit(VERSION), *lines), F.lit(BETWEEN), block)


def write(records: DataFrame, path: str) -> None:
    """One compressed file a task; records are separated as the format wants it."""
    texts = records.select(record_text(F.col("block")).alias("value"))
    texts.write.option("lineSep", BETWEEN).option("compression", "gzip").text(path)


#: Where files are cut into pieces; what follows tells the version.
_CUT = f"{BETWEEN}WARC/1."


def _record(headers: bytes, block: bytes, length: int | None) -> dict:
    pairs: dict = {}
    for line in headers.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        pairs.setdefault(name.strip().lower().decode("utf-8", "replace"), value.strip().decode("utf-8", "replace"))
    whole = length is not None and len(block) >= length and block[length:] in (b"", BETWEEN.encode())
    block = block if length is None else block[:length]
    return {"headers": list(pairs.items()), "block": block.decode("utf-8", "replace"), "whole": whole}


_LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*([0-9]+)", re.I)
_READ = pa.schema([("headers", pa.map_(pa.string(), pa.string())), ("block", pa.string()), ("whole", pa.bool_())])


def _rejoined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of the pieces of files, which come in order: pieces are taken until the stated length is reached."""
    file, parts, headers, length, held = None, [], b"", None, 0

    def done():
        return pa.RecordBatch.from_pylist([_record(headers, b"".join(parts), length)], _READ)

    for batch in batches:
        for piece, source in zip(batch["piece"], batch["file"].to_pylist()):
            piece = piece.as_py()
            if parts and source == file and length is not None and held < length:
                more = _CUT.encode() + piece
                parts.append(more)
                held += len(more)
                continue
            if parts:
                yield done()
            file, (headers, _, block) = source, piece.partition(BETWEEN.encode())
            # the first piece of a file has its version line, the others begin in the middle of it
            found = _LENGTH.search(b"\r\n" + headers)
            parts, length, held = [block], int(found[1]) if found else None, len(block)
    if parts:
        yield done()


def read(spark: SparkSession, path: str) -> DataFrame:
    """headers (map, names in lower case), block, whole (its length is the one stated) for each record under a path.

    Files are cut before each version line that follows an empty line, and a record whose block holds
    such lines is put together again by its Content-Length, one record at a time.  A header that comes again
    counts once.  ``whole`` is false where a file ends too early, or a block is longer than stated or has no length;
    bytes that are no UTF-8 are replaced.  Compressed files are one task each; an uncompressed one that is larger than a
    task's share (``spark.sql.files.maxPartitionBytes``) may lose the rejoining at the seam.
    """
    rows = spark.read.option("lineSep", _CUT).text(path)
    pieces = rows.select(F.col("value").cast("binary").alias("piece"), F.input_file_name().alias("file"))
    return pieces.mapInArrow(_rejoined, "headers map<string,string>, block string, whole boolean")
