"""WARC derivatives: metadata and plain-text conversion records that refer to the responses they come from."""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = b"WARC/1.1"
#: Elements whose text is no prose, and elements that end a line.
SILENT = ("script", "style", "template", "noscript")
LINES = (
    "p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "article", "section",
    "header", "footer", "nav", "blockquote", "pre", "dd", "dt", "hr",
)
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122

_END = r"(?=[\s/>])"
_REST = r"(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>"
_FLAGS = re.DOTALL | re.IGNORECASE
_UNSEEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({'|'.join(SILENT)}){_END}[^>]*+>.*?(?:</\1\s*>|\Z)", _FLAGS)
_TITLE = re.compile(rf"<title{_END}[^>]*+>(.*?)(?:</title\s*>|\Z)", _FLAGS)
_HEAD = re.compile(rf"<head{_END}[^>]*+>.*?(?:</head\s*>|(?=<body{_END})|\Z)", _FLAGS)
_LINK = re.compile(r"<a(?=\s)(?:[^<>\"']|\"[^\"]*\"|'[^']*')*?\shref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>]+))", _FLAGS)
_BREAK = re.compile(rf"</?(?:{'|'.join(LINES)}){_END}{_REST}", _FLAGS)
_TAG = re.compile(rf"</?[a-z]{_REST}|<[!?/][^>]*>", _FLAGS)


def plain_text(html: str) -> tuple[str, str, list[str]]:
    """(text, title, links) of a page: lines without surplus blanks; scripts, styles, comments and the head are left out.

    What an unclosed script, style or comment holds is left out up to the end of the page, an unclosed head up to the
    body. A '<' that begins no tag is text.
    """
    seen = _UNSEEN.sub("", html)
    title = " ".join(" ".join(unescape(x) for x in _TITLE.findall(seen)).split())
    seen = _HEAD.sub("", _TITLE.sub("", seen))
    links = [unescape(a or b or c) for a, b, c in _LINK.findall(seen) if a or b or c]
    text = unescape(_TAG.sub("", _BREAK.sub("\n", seen)))
    lines = (" ".join(x.split()) for x in text.split("\n"))
    return "\n".join(x for x in lines if x), title, links


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """A stable identifier, so that a task that runs again writes the same records."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, chr(0).join(parts))}>"


_LINE_ENDS = re.compile(r"[\r\n]+")


def _clean(value: str) -> str:
    return _LINE_ENDS.sub(" ", value) if "\n" in value or "\r" in value else value


def serialize(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A whole record: version, headers, block."""
    lines = [VERSION, *(f"{k}: {_clean(v)}".encode("utf-8", "replace") for k, v in headers), f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a WARC stream, plain or of gzip members; a cut last record ends it.

    Members are inflated as they are read. Names are in lower case; the values of a repeated one are joined by commas.
    """
    raw = io.BytesIO(data)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if data[:2] == b"\x1f\x8b" else raw
    try:
        while line := stream.readline():
            if not line.startswith(b"WARC/"):
                continue
            headers: dict[str, str] = {}
            while (line := stream.readline()).strip():
                name, _, value = line.decode("utf-8", "replace").partition(":")
                name, value = name.strip().lower(), value.strip()
                headers[name] = f"{headers[name]}, {value}" if name in headers else value
            n = headers.get("content-length", "")
            if not n.isdecimal():
                continue
            block = stream.read(int(n))
            if len(block) < int(n):
                return
            yield headers, block
    except EOFError:  # the last member is cut
        return


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of an HTTP response; a block without a status line is all payload."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    head, _, body = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    headers = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:])]
    return lines[0], headers, body


def _charset(headers: list[tuple[str, str]]) -> str:
    for k, v in headers:
        found = re.search(r"charset=[\"']?([\w.-]+)", v) if k.lower() == "content-type" else None
        if found:
            try:
                return codecs.lookup(found[1]).name
            except LookupError:
                break
    return "utf-8"


def payload_of(headers: list[tuple[str, str]], body: bytes) -> bytes | None:
    """The body without its chunks and compression; None where it can't be undone."""
    given = {k.lower(): v.lower() for k, v in headers}
    try:
        if "chunked" in given.get("transfer-encoding", ""):
            out, at = [], 0
            while at < len(body):
                end = body.index(b"\r\n", at)
                n = int(body[at:end].split(b";")[0], 16)
                if n == 0:
                    break
                out.append(body[end + 2 : end + 2 + n])
                at = end + 4 + n
            body = b"".join(out)
        for coding in reversed([x.strip() for x in given.get("content-encoding", "").split(",")]):
            if coding in ("gzip", "x-gzip", "deflate"):
                raw = coding == "deflate" and body[:1] != b"\x78"
                body = zlib.decompressobj(-zlib.MAX_WBITS if raw else zlib.MAX_WBITS | 32).decompress(body)
            elif coding not in ("", "identity"):
                return None
    except (ValueError, zlib.error):
        return None
    return body


def _readable(headers: list[tuple[str, str]]) -> str | None:
    """'html' or 'text' by the content type; none is taken for HTML, and what isn't text gives None."""
    kind = next((v.split(";")[0].strip().lower() for k, v in headers if k.lower() == "content-type"), "")
    if kind in ("", "text/html", "application/xhtml+xml"):
        return "html"
    return "text" if kind.startswith("text/") or re.search(r"[/+](?:json|xml|javascript)$", kind) else None


SCHEMA = (
    "key {key}, warc_type string, record_id string, refers_to string, target_uri string, date string, content_type string, "
    "block_digest string, payload_digest string, source_digest string, source_block_digest string, warc_headers map<string,string>, "
    "source_headers array<struct<name:string,value:string>>, text string, record binary"
)
_PAIRS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
_MAP = pa.map_(pa.string(), pa.string())


def responses_from_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records (key, headers, block) for a table of pages; null html is an empty payload."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html), F.lit("\r\n\r\n"), html
    )
    uri = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    headers = F.create_map(F.lit("warc-type"), F.lit("response"), F.lit("warc-target-uri"), uri, F.lit("content-type"), F.lit("application/http; msgtype=response"))
    return pages.select(F.col(id_col).alias("key"), headers.alias("headers"), F.encode(http, "UTF-8").alias("block"))


def read(spark: SparkSession, path: str, types: tuple[str, ...] = ("response",)) -> DataFrame:
    """Records (key, headers, block) of the given types in WARC files, one task per file; key is ``file#number``.

    A file is read whole by one task, as gzip members can't be found from the middle: keep them near 1 GB, as crawls do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, (headers, block) in enumerate(parse(data)):
                    if headers.get("warc-type") in types:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([f"{name}#{k}"]), pa.array([list(headers.items())], _MAP), pa.array([block], pa.binary())],
                            names=["key", "headers", "block"],
                        )

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, "key string, headers map<string,string>, block binary")


def derive(responses: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Two records for each response (key, headers, block): 'metadata' and 'conversion'.

    Both name the response in WARC-Refers-To and carry its target and date; the conversion's block is the plain text,
    the metadata's block lists the source's status, all its WARC and HTTP headers in order, digests, title and links.
    A response without an id gets a stable one from its key, target and payload digest; one without a date gets
    ``date``. Digests are SHA-1 in base 32; those that the source carries stay in its headers beside them.

    Chunked and gzip or deflate bodies are undone first; digests are those of the stored bytes. A response whose
    content type isn't text, or whose coding is unknown or broken, has a metadata record only.

    Returns key, warc_type, record_id, refers_to, target_uri, date, content_type, block_digest, payload_digest,
    source_digest and source_block_digest (of the response's payload and block), warc_headers and source_headers (its
    WARC and HTTP headers), text (conversions only), record.

    Null blocks are empty payloads; null keys and repeated rows are kept (equal rows get equal ids); markup that isn't
    HTML is taken as text; an empty table gives no rows; other columns are not read.
    """
    kind = responses.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 10 + [_MAP, _PAIRS, pa.string(), pa.binary()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            rows: list[int] = []
            for i, (key, given, block) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                headers = {k.lower(): v for k, v in (given or [])}
                status, http, payload = split_http(block or b"")
                uri, when = headers.get("warc-target-uri") or "", headers.get("warc-date") or date
                source, whole = digest(payload), digest(block or b"")
                refers = headers.get("warc-record-id") or record_id("response", str(key), uri, source)
                listed = [("status", status), *headers.items(), *((f"http-{k.lower()}", v) for k, v in http)]
                listed += [("payloadDigest", source), ("blockDigest", whole)]
                how, body = _readable(http), payload_of(http, payload)
                text = None
                if how and body is not None:
                    text = body.decode(_charset(http), "replace")
                    if how == "html":
                        text, title, links = plain_text(text)
                        listed += [("title", title), *(("outlink", x) for x in links)]
                metadata = "".join([f"{k}: {_clean(v)}\r\n" for k, v in listed if v is not None]).encode("utf-8", "replace")
                made = [("metadata", "application/warc-fields", metadata)]
                if text is not None:
                    made.append(("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace")))
                for type_, content, body in made:
                    own, sha = record_id(type_, refers, uri), digest(body)
                    fields = [
                        ("WARC-Type", type_), ("WARC-Record-ID", own), ("WARC-Date", when), ("WARC-Target-URI", uri),
                        ("WARC-Refers-To", refers), ("WARC-Block-Digest", sha), ("WARC-Payload-Digest", sha),
                        ("Content-Type", content),
                    ]
                    row = (
                        type_, own, refers, uri, when, content, sha, sha, source, whole, list(headers.items()),
                        [{"name": k, "value": v} for k, v in http], text if type_ == "conversion" else None, serialize(fields, body),
                    )
                    rows.append(i)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            columns = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *columns], names=names)

    return responses.select("key", "headers", "block").mapInArrow(run, SCHEMA.format(key=kind))


def write(records: DataFrame, path: str) -> None:
    """Write the ``record`` column as gzipped WARC files, one for each partition.

    The records are UTF-8, so Spark's text writer places and commits the files, and a lost task leaves no half file;
    its line end is the last byte of each record.
    """
    whole = F.decode("record", "UTF-8")
    lines = records.filter(F.col("record").isNotNull()).select(F.left(whole, F.length(whole) - 1).alias("value"))
    lines.write.option("compression", "gzip").option("lineSep", "\n").text(path)
