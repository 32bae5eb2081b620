"""WARC derivatives: metadata and plain-text conversion records of responses.

For every response two records are written to WARC/1.1 files: a ``metadata``
record (title, language, links, and the source's headers, length and digest)
and a ``conversion`` record with the plain text of its payload.  Both name the
response in WARC-Refers-To and repeat its URI, date and payload digest; their
own ids follow from the response's id, so a retried task writes the same
records.  Files are written by Spark's text writer (the record separator is
its line end) into the shared folder, one file a task, and read back by
Spark's text reader, split at record starts.

Blocks hold no carriage return, so no block can imitate a record start.

Defined results
---------------
* a null payload is an empty one: both records exist, the text is empty;
* a null URI or id leaves its header out and reads back as null;
* repeated rows give repeated records (with equal ids); an empty table writes
  no record; further columns of the input are ignored.
"""

from __future__ import annotations

import html as htmllib
import re
import uuid
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finelens.llm.common import new_path

VERSION = "WARC/1.1"
SEPARATOR = "\r\n\r\n"
#: Date of responses that carry none.
NO_DATE = "1970-01-01T00:00:00Z"

_NAMESPACE = uuid.UUID("8d0f3d0e-6f0c-5b7e-9a51-4b1f2f9f7c11")
_HIDDEN = re.compile(r"<!--.*?(?:-->|$)|<(script|style|noscript|template|svg)\b.*?(?:</\1\s*>|$)", re.I | re.S)
_BLOCK = re.compile(
    r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|"
    r"ol|option|p|pre|section|table|tbody|td|th|thead|title|tr|ul)\b[^<>]*>",
    re.I,
)
_TAG = re.compile(r"<[a-zA-Z/!?][^<>]*>")
_SPACES = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[ \n]*")
_TITLE = re.compile(r"<title\b[^<>]*>(.*?)</title\s*>", re.I | re.S)
_LANG = re.compile(r"<html\b[^<>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
_CHARSET = re.compile(r"<meta\b[^<>]*?\bcharset\s*=\s*[\"']?([\w-]+)", re.I)
_HREF = re.compile(r"<a\b[^<>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def plain_text(page: str) -> str:
    """Visible text of an HTML page: hidden parts dropped, block tags as line ends, entities resolved."""
    t = _TAG.sub("", _BLOCK.sub("\n", _HIDDEN.sub(" ", page)))
    if "&" in t:
        t = htmllib.unescape(t)
    return _LINES.sub("\n", _SPACES.sub(" ", t.replace("\r", "\n"))).strip(" \n")


def one_line(value: str) -> str:
    return " ".join(value.split())


def page_facts(page: str) -> list[tuple[str, str]]:
    """Fields of the metadata block taken from the page itself."""
    first = lambda rx: one_line(htmllib.unescape(m[1])) if (m := rx.search(page)) else ""
    facts = [("title", first(_TITLE)), ("language", first(_LANG)), ("charset", first(_CHARSET))]
    shown = _HIDDEN.sub(" ", page)
    links = [one_line(htmllib.unescape(a or b or c)) for a, b, c in _HREF.findall(shown)]
    return [f for f in facts if f[1]] + [("outlink", x) for x in links if x]


def record(kind: str, source: dict, block: str, content_type: str) -> str:
    """One record without its final separator."""
    body = block.encode("utf-8")
    own = uuid.uuid5(_NAMESPACE, f"{kind}|{source['record_id']}")
    headers = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:uuid:{own}>"),
        ("WARC-Refers-To", source["record_id"]),
        ("WARC-Target-URI", source["target_uri"]),
        ("WARC-Date", source["date"]),
        ("WARC-Refers-To-Date", source["date"]),
        ("WARC-Source-Payload-Digest", source["digest"]),
        ("WARC-Block-Digest", f"sha256:{sha256(body).hexdigest()}"),
        ("X-Source-Id", source["id"]),
        ("Content-Type", content_type),
        ("Content-Length", str(len(body))),
    ]
    head = "\r\n".join(f"{k}: {v}" for k, v in headers if v is not None)
    return f"{VERSION}\r\n{head}{SEPARATOR}{block}"


def derivatives(source: dict, payload: str, headers: str) -> tuple[str, str]:
    """The metadata and the conversion record of one response."""
    body = payload.encode("utf-8")
    source = source | {"digest": f"sha256:{sha256(body).hexdigest()}"}
    fields = page_facts(payload) + [("source-content-length", str(len(body))), ("source-payload-digest", source["digest"])]
    fields += [("source-header", one_line(h)) for h in headers.splitlines() if h.strip()]
    meta = "".join(f"{k}: {v}\n" for k, v in fields)
    return (
        record("metadata", source, meta, "application/warc-fields"),
        record("conversion", source, plain_text(payload), "text/plain; charset=utf-8"),
    )


def _derive(batches):
    for b in batches:
        out = []
        for row in b.to_pylist():
            uri = row["target_uri"]
            source = {
                "id": None if row["id"] is None else str(row["id"]),
                "record_id": row["record_id"],
                "target_uri": None if uri is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri),
                "date": row["date"] or NO_DATE,
            }
            out += derivatives(source, row["payload"] or "", row["headers"] or "")
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])


def responses(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Response rows (id, record_id, target_uri, date, headers, payload) of a page table.

    The response's id is a UUID from the digest of its row id and URI.
    """
    h = F.sha2(F.concat_ws("|", F.lit("response"), F.col(id_col).cast("string"), F.col(uri_col)), 256)
    cut = lambda a, n: F.substring(h, a, n)
    rid = F.concat(F.lit("<urn:uuid:"), cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-8"), cut(14, 3), F.lit("-a"), cut(18, 3), F.lit("-"), cut(21, 12), F.lit(">"))
    return pages.select(
        F.col(id_col).cast("long").alias("id"),
        rid.alias("record_id"),
        F.col(uri_col).alias("target_uri"),
        F.lit(NO_DATE).alias("date"),
        F.lit("HTTP/1.1 200 OK\nContent-Type: text/html; charset=utf-8").alias("headers"),
        F.col(payload_col).alias("payload"),
    )


def write_derivatives(rows: DataFrame, out: str) -> None:
    """Writes the derivative records of response rows as WARC files in the folder ``out``."""
    records = rows.select("id", "record_id", "target_uri", "date", "headers", "payload").mapInArrow(_derive, "value string")
    records.write.option("lineSep", SEPARATOR).text(out)


def header(head: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(head, rf"(?:^|\r\n){name}: ([^\r\n]*)", 1), F.lit(""))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files as written here: parsed headers and the block.

    Every row is what lies between two record starts, so files split at any byte.
    """
    raw = spark.read.option("lineSep", f"{SEPARATOR}{VERSION}\r\n").text(path)
    body = F.regexp_replace("value", rf"^{VERSION}\r\n", "")
    rows = raw.select(body.alias("body")).select(
        F.substring_index("body", SEPARATOR, 1).alias("head"),
        # the last record of a file still has its final separator
        F.regexp_replace(F.expr(f"substring(body, instr(body, '\\r\\n\\r\\n') + {len(SEPARATOR)})"), "(?:\r\n)+$", "").alias("block"),
    )
    head = F.col("head")
    return rows.select(
        header(head, "X-Source-Id").cast("long").alias("id"),
        header(head, "WARC-Type").alias("record_type"),
        header(head, "WARC-Record-ID").alias("record_id"),
        header(head, "WARC-Refers-To").alias("refers_to"),
        header(head, "WARC-Target-URI").alias("target_uri"),
        header(head, "WARC-Date").alias("date"),
        header(head, "WARC-Source-Payload-Digest").alias("source_digest"),
        header(head, "WARC-Block-Digest").alias("block_digest"),
        header(head, "Content-Length").cast("long").alias("content_length"),
        "block",
    )


def round_trip(rows: DataFrame) -> DataFrame:
    spark = rows.sparkSession
    out = new_path(spark, "warc")
    write_derivatives(rows, out)
    return read_records(spark, out)


def checked(records: DataFrame) -> DataFrame:
    """Record rows with the read-back block measured against its headers."""
    block = F.col("block")
    return records.select(
        F.col("id").alias("page_id"),
        "record_type",
        "record_id",
        "refers_to",
        "target_uri",
        "source_digest",
        "block_digest",
        "content_length",
        (F.col("block_digest") == F.concat(F.lit("sha256:"), F.sha2(block, 256))).alias("digest_ok"),
        (F.col("content_length") == F.octet_length(block)).alias("length_ok"),
        F.length(block).cast("long").alias("block_chars"),
    )
