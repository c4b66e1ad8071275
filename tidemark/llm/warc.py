"""Derivatives of WARC responses: metadata and plain-text conversion records, in DataFrame functions only.

A response record is a row: its id, target, date, the HTTP head and the payload. Two records are derived from it:

* ``metadata``: a JSON block of the response's headers, its payload's digest and length, the page's title, and counts;
* ``conversion``: the page's plain text (script, style, head, comments and tags removed, entities of HTML's core decoded).

Both refer to the response (WARC-Refers-To), repeat its target and date, and carry the source's payload digest; their own
blocks have digests and lengths. Ids are made from the response's id and the record type, so runs repeat exactly.

Nulls and edge cases: a null url is '', a null payload empty: it gives an empty conversion block. Null page ids count as
'' in ids. Repeated rows give repeated records, so ties need no order. A very long payload is one row's work and stays in it. An
element that isn't closed keeps its text; only its tags go. Empty tables give empty ones. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements that go with their content; their names are matched whole, so that <head> isn't <header>.
GONE = ("script", "style", "head")
#: Steps from HTML to text: pattern and what replaces it (fixed values).
STEPS = (
    (r"(?s)<!--.*?-->", ""),
    *((rf"(?is)<{name}([\s/][^>]*)?>.*?</{name}([\s/][^>]*)?>", "") for name in GONE),
    (r"(?i)<(br|/p|/div|/li|/h[1-6]|/tr|/title|/article|/nav|/ul)[^>]*>", "\n"),
    (r"(?s)<[^>]*>", ""),
    (r"&nbsp;", " "),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"&quot;", '"'),
    (r"&#39;", "'"),
    (r"&amp;", "&"),
    (r"[ \t\r\f]+", " "),
    (r" ?\n[ \n]*", "\n"),
    (r"^[ \n]+", ""),
    (r"[ \n]+$", ""),
)
DATE = "2024-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def record_id(*parts: Column) -> Column:
    """A URN in the form of a UUID from the parts' MD5."""
    h = F.md5(F.concat_ws("|", *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def plain_text(html: Column) -> Column:
    for pattern, new in STEPS:
        html = F.regexp_replace(html, pattern, new.replace("\\", "\\\\").replace("$", "\\$"))
    return html


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of ``pages`` (page_id, url, html)."""
    key, url, html = F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", record_id(F.lit("response"), key, url).alias("record_id"), url.alias("target_uri"), F.lit(date).alias("date"), html.alias("payload"))
    return rows.withColumn("http_headers", F.concat(F.lit(HTTP + "Content-Length: "), F.octet_length("payload").cast("string"), F.lit("\r\n")))


def derivatives(source: DataFrame) -> DataFrame:
    """Two rows for each response: page_id, type, ids, target, date, source headers and digests, and the block."""
    digest = F.concat(F.lit("sha256:"), F.sha2("payload", 256))
    rows = source.select("page_id", "record_id", "target_uri", "date", "http_headers", "payload", digest.alias("source_digest"), plain_text(F.col("payload")).alias("text"))
    title = F.regexp_extract("payload", r"(?is)<title[^>]*>([^<]*)", 1)
    fields = F.struct(
        F.col("target_uri").alias("target"), F.col("http_headers").alias("http"), F.col("source_digest").alias("digest"), F.octet_length("payload").cast("long").alias("length"),
        title.alias("title"), F.regexp_count("payload", F.lit(r"(?i)<a\s")).cast("long").alias("links"), F.length("text").cast("long").alias("text_chars"),
    )
    made = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/json").alias("content_type"), F.to_json(fields).alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain").alias("content_type"), F.col("text").alias("block")),
    )
    rows = rows.select("page_id", F.col("record_id").alias("refers_to"), "target_uri", "date", "http_headers", "source_digest", title.alias("title"), F.explode(made).alias("made"))
    rows = rows.select("page_id", "made.*", "refers_to", "target_uri", "date", "http_headers", "source_digest", "title")
    rows = rows.withColumn("record_id", record_id("record_type", "refers_to"))
    return rows.withColumn("block_digest", F.concat(F.lit("sha256:"), F.sha2("block", 256))).withColumn("content_length", F.octet_length("block").cast("long"))


def serialised(records: DataFrame) -> DataFrame:
    """page_id, record_type and the WARC 1.1 record as text, CRLF after each header."""
    head = [("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length")]
    lines = F.concat(F.lit("WARC/1.1\r\n"), *(F.concat(F.lit(f"{name}: "), F.col(c).cast("string"), F.lit("\r\n")) for name, c in head))
    return records.select("page_id", "record_type", F.concat(lines, F.lit("\r\n"), "block", F.lit("\r\n\r\n")).alias("record"))

