"""WARC derivative builder: response records become linked metadata and plain-text conversion records.

Records are rows: (type, record_id, refers_to, target_uri, date, headers, block, block_digest, payload_digest). A
derivative names its response in refers_to and keeps its target, date, source headers and payload digest. All steps
are DataFrame functions, and each pattern reads a page once: what is not closed ends with the page. Pages come
without a status or headers of their own, so those of ``responses`` are constants. Files are written by Spark's text
source and read record by record by the length in the header, so files of other tools can be read too: of any version, with a member
for each record, and with blocks that are no text.

Defined results: a null page has an empty block and an identifier of its own; a null URL is an empty one; repeated
responses give repeated derivatives; a page without text has an empty conversion; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"

#: Fixed steps from HTML to text, in this order: (pattern, replacement). They mean the same to Java and RE2.
STEPS = [
    (r"(?s)<!--.*?(?:-->|\z)", ""),
    (r"(?is)<script\b[^>]*(?:>.*?(?:</script[ \t\r\n\f]*>|\z)|\z)", ""),
    (r"(?is)<style\b[^>]*(?:>.*?(?:</style[ \t\r\n\f]*>|\z)|\z)", ""),
    (r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|nav|header|footer|title|blockquote|pre)\b[^>]*(?:>|\z)", "\n"),
    (r"<[A-Za-z/!?][^>]*(?:>|\z)", ""),
    (r"&nbsp;", " "),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"&quot;", "\""),
    (r"&#39;", "'"),
    (r"&amp;", "&"),
    (r"[ \t\r\f]+", " "),
    (r" ?\n[ \n]*", "\n"),
    (r"^[ \n]+|[ \n]+$", ""),
]


TITLE = r"(?is)<title\b[^>]*(?:>(.*?)(?:</title[ \t\r\n\f]*>|\z)|\z)"
#: A link's tag, and its target within the tag.
ANCHOR, HREF = r"(?i)<a\b[^>]*(?:>|\z)", r'(?i)\bhref="([^"]*)"'


def plain_text(html: Column) -> Column:
    for pattern, replacement in STEPS:
        html = F.regexp_replace(html, pattern, replacement)
    return html


def _uuid(*parts: Column) -> Column:
    """An identifier that is the same for the same parts."""
    h = F.sha2(F.concat_ws("|", *parts), 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """Response records of fetched pages; the key column stays, as ``key``."""
    url, html = F.coalesce(F.col(url_col), F.lit("")), F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("key"), url.alias("target_uri"), html.alias("payload"))
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8"
    rows = rows.withColumn("payload_digest", _digest(F.col("payload"))).withColumn("http", F.lit(head))
    return rows.select(
        "key",
        F.lit("response").alias("type"),
        _uuid(F.coalesce(F.col("key").cast("string"), F.lit("")), F.col("target_uri"), F.col("payload_digest")).alias("record_id"),
        F.lit(None).cast("string").alias("refers_to"),
        "target_uri",
        F.lit(date).alias("date"),
        F.lit("application/http; msgtype=response").alias("content_type"),
        "http",
        "payload",
        "payload_digest",
    )


def derivatives(records: DataFrame) -> DataFrame:
    """A metadata and a conversion record for each response record among ``records``."""
    r = records.where("type = 'response'")
    title = F.regexp_replace(F.regexp_extract("payload", TITLE, 1), r"[ \t\r\n\f]+", " ")
    links = F.transform(F.filter(F.regexp_extract_all("payload", F.lit(ANCHOR), 0), lambda x: x.rlike(HREF)), lambda x: F.regexp_extract(x, HREF, 1))
    lines = F.concat_ws("\n", F.concat(F.lit("title: "), title), F.concat(F.lit("source-digest: "), F.col("payload_digest")), F.concat(F.lit("source-http: "), F.regexp_replace("http", "\r\n", "; ")), F.when(F.size(links) > 0, F.concat_ws("\n", F.transform(links, lambda x: F.concat(F.lit("outlink: "), x)))))
    kinds = F.array(
        F.struct(F.lit("metadata").alias("type"), F.lit("application/warc-fields").alias("content_type"), lines.alias("block")),
        F.struct(F.lit("conversion").alias("type"), F.lit("text/plain; charset=utf-8").alias("content_type"), plain_text(F.col("payload")).alias("block")),
    )
    rows = r.select("key", "record_id", "target_uri", "date", "http", "payload_digest", F.explode(kinds).alias("d"))
    return rows.select(
        "key",
        "d.type",
        _uuid(F.col("record_id"), F.col("d.type")).alias("record_id"),
        F.col("record_id").alias("refers_to"),
        "target_uri",
        "date",
        "d.content_type",
        "http",
        "d.block",
        _digest(F.col("d.block")).alias("block_digest"),
        "payload_digest",
    )


def lines_of(records: DataFrame) -> DataFrame:
    """Each record as one string: header fields, a blank line and the block."""
    block = F.concat(F.col("http"), F.lit("\r\n\r\n"), F.col("payload")) if "payload" in records.columns else F.col("block")
    rows = records.withColumn("__block", block)

    def field(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"\r\n{name}: "), F.regexp_replace(value, r"[\r\n]+", " "))).otherwise("")

    head = F.concat(
        F.lit(VERSION),
        field("WARC-Type", F.col("type")),
        field("WARC-Record-ID", F.col("record_id")),
        field("WARC-Refers-To", F.col("refers_to")),
        field("WARC-Target-URI", F.col("target_uri")),
        field("WARC-Date", F.col("date")),
        field("WARC-Block-Digest", _digest(F.col("__block"))),
        field("WARC-Payload-Digest", F.col("payload_digest")),
        field("Content-Type", F.col("content_type")),
        field("Content-Length", F.octet_length("__block").cast("string")),
    )
    return rows.select(F.concat(head, F.lit("\r\n\r\n"), F.col("__block")).alias("value"))


def write(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """WARC files of the records, one for each partition; a record ends with two line breaks."""
    lines_of(records).write.option("lineSep", END).option("compression", compression).text(path)


def records_of(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of the records of a WARC file, plain or of gzip members."""
    f = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not the start of a WARC record: {line[:80]!r}")
        headers, last = {"warc-version": line.strip().decode()[5:]}, None
        while (line := f.readline()).strip():
            if line[:1] in b" \t" and last:  # goes on from the line before
                headers[last] += " " + line.decode("utf-8", "replace").strip()
            else:
                name, _, value = line.decode("utf-8", "replace").partition(":")
                headers[last := name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = f.read(size)
        if len(block) != size:
            raise ValueError("a WARC block is not as long as its header says")
        yield headers, block


def read(spark: SparkSession, path: str) -> DataFrame:
    """(headers, block) of WARC files of any tool, the block in bytes; fails where a file is cut short.

    A file is a task, as gzip members can't be found from the middle of one; its compressed bytes are held, its records one at a time."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                for headers, block in records_of(data.as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array([list(headers.items())], pa.map_(pa.string(), pa.string())), pa.array([block], pa.binary())], names=["headers", "block"])

    return files.mapInArrow(run, "headers map<string,string>, block binary")
