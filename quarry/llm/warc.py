r"""WARC derivatives: each response record yields a metadata record and a plain-text conversion record.

A response is a row: record_id, date, target_uri, http (status line and headers), payload (bytes), payload_digest,
block_digest.  Both derivatives name it in WARC-Refers-To (with its URI and date) and carry its digests; the
metadata record holds the source's HTTP headers, title, language and outlinks as ``application/warc-fields`` and
names the conversion record in WARC-Concurrent-To.  ``record`` is the whole record as it stands in a WARC file;
parse() reads such files back.

Rows are independent: no shuffle, and memory for one Arrow batch.

Defined results: a null payload is empty and yields an empty text; null URI, date, headers or digests leave their
fields out; a null record_id gets one from the row's other fields; bytes that are no text in the declared charset
are replaced; a tag that never ends is text up to the page's end; repeated rows yield repeated records; an empty table gives no rows; further columns are dropped, but
for those named in ``keep``.
"""

from __future__ import annotations

import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: elements whose content is no text; elements that part lines.
_SILENT = {"script", "style", "noscript", "template", "title", "textarea", "svg", "iframe", "object", "select"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "br", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head",
    "header", "hr", "html", "li", "main", "nav", "ol", "option", "p", "pre", "section", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
# A tag's end is looked for once: what stands inside is matched possessively, an unclosed quote is an ordinary
# character, and a tag or declaration that never ends takes the rest of the page.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?<![-\w:.])([a-zA-Z_:][-\w:.]*+)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))")
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in _SILENT}
_SPACES = re.compile(r"[^\S\n]+")
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)


def extract(page: str) -> tuple[str, str, str, list[str]]:
    """Plain text, title, language and outlinks of an HTML page."""
    out, links, title, lang, at = [], [], "", "", 0
    while m := _TOKEN.search(page, at):
        out.append(html.unescape(page[at : m.start()]))
        at = m.end()
        if m[2] and not m[4]:  # no end: text, as it stands
            out.append(html.unescape(m[0]))
            break
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in _BLOCK:
            out.append("\n")
        if m[1]:
            continue
        if name in ("a", "area", "html"):
            attributes = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(m[3])}
            if name == "html":
                lang = lang or attributes.get("lang", "")
            elif attributes.get("href"):
                links.append(attributes["href"].strip())
        elif name in _SILENT and not m[3].endswith("/"):
            end = _CLOSE[name].search(page, at)
            if name == "title" and not title:
                title = " ".join(html.unescape(page[at : end.start() if end else len(page)]).split())
            at = end.end() if end else len(page)
    out.append(html.unescape(page[at:]))
    lines = (x.strip() for x in _SPACES.sub(" ", "".join(out)).split("\n"))
    return "\n".join(x for x in lines if x), title, lang, links


def digest(raw: bytes) -> str:
    return "sha1:" + hashlib.sha1(raw).hexdigest()


def urn(*parts: object) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(chr(31).join(map(str, parts)).encode('utf-8', 'surrogatepass')).digest())}>"


def record(fields: list[tuple[str, str | None]], block: bytes) -> tuple[str, bytes]:
    """Header text and whole record; fields without a value are left out."""
    lines = [f"{k}: {' '.join(str(v).split())}" for k, v in fields if v not in (None, "")]
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"]) + "\r\n\r\n"
    return head, head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of a WARC file."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        version, *lines = raw[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines)
        n = int(fields["Content-Length"])
        yield fields, raw[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


PAGES = 256  # held as Python objects at a time
_OUT = "warc_type string, record_id string, refers_to string, target_uri string, source_payload_digest string, source_http string, title string, n_links long, content_type string, content_length long, block_digest string, block string, record binary"


def _text(value: object) -> str | None:
    return value if isinstance(value, str) else None


def _derive(batches: Iterator[pa.RecordBatch], keep: list[str]) -> Iterator[pa.RecordBatch]:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    made = {c: kinds[t] for c, t in (x.split() for x in _OUT.split(", "))}
    for batch in (whole.slice(a, PAGES) for whole in batches for a in range(0, whole.num_rows, PAGES)):
        out = []
        for r in batch.to_pylist():
            uri, date, http = _text(r["target_uri"]), _text(r["date"]), _text(r["http"])
            payload = bytes(r["payload"]) if r["payload"] is not None else b""
            source = _text(r["record_id"]) or urn("response", uri, date, http, hashlib.md5(payload).hexdigest())
            charset = _CHARSET.search(http or "") or _CHARSET.search(payload[:1024].decode("latin-1"))
            try:
                page = payload.decode(charset[1] if charset else "utf-8", "replace")
            except LookupError:
                page = payload.decode("utf-8", "replace")
            text, title, lang, links = extract(page)
            came = [("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date)]
            kept = [("Source-Payload-Digest", _text(r["payload_digest"])), ("Source-Block-Digest", _text(r["block_digest"]))]
            ids = {kind: urn(kind, source) for kind in ("metadata", "conversion")}
            status, *headers = (http or "").strip().split("\r\n")
            notes = [("sourceStatus", status), *(("sourceHeader", h) for h in headers), ("title", title), ("language", lang), *(("outlink", x) for x in links)]
            fields = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in notes if v)
            for kind, mime, block, more in (("metadata", "application/warc-fields", fields, [("WARC-Concurrent-To", ids["conversion"])]), ("conversion", "text/plain; charset=utf-8", text, [])):
                raw = block.encode("utf-8", "surrogatepass")
                head = [("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), ("WARC-Date", date), ("WARC-Target-URI", uri), *came, *more, *kept, ("WARC-Block-Digest", digest(raw)), ("Content-Type", mime)]
                out.append((*(r[c] for c in keep), kind, ids[kind], source, uri, _text(r["payload_digest"]), http, title, len(links), mime, len(raw), digest(raw), block, record(head, raw)[1]))
        types = {**{c: batch.schema.field(c).type for c in keep}, **made}
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types.values())], names=list(types))


def derivatives(responses: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Two rows, metadata and conversion, for every response."""
    needed = {"record_id": "string", "date": "string", "target_uri": "string", "http": "string", "payload": "binary", "payload_digest": "string", "block_digest": "string"}
    rows = responses.select(*[F.col(f"`{c}`") for c in keep], *[F.col(c).cast(t).alias(c) for c, t in needed.items()])
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[: len(keep)])
    return rows.mapInArrow(lambda it: _derive(it, list(keep)), types + _OUT)


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of a table of pages (page_id, url, html), all captured at ``date``."""
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit("\r\n\r\n"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("target_uri"), body.alias("payload")).withColumn("http", http)
    name = F.md5(F.concat_ws("\x1f", F.lit("page"), F.col("page_id").cast("string"), "target_uri").cast("binary"))
    dashed = F.regexp_replace(name, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")
    sha = lambda c: F.concat(F.lit("sha1:"), F.sha1(c))
    return rows.select("page_id", dashed.alias("record_id"), F.lit(date).alias("date"), "target_uri", "http", "payload", sha(F.col("payload")).alias("payload_digest"), sha(F.concat(F.col("http").cast("binary"), F.col("payload"))).alias("block_digest"))


def page_derivatives(pages: DataFrame) -> DataFrame:
    """The derivatives of every page, with a digest of each whole record in place of its bytes."""
    rows = derivatives(responses(pages), ("page_id",))
    return rows.withColumn("record_sha256", F.sha2("record", 256)).drop("record", "block")
