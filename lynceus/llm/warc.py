"""WARC derivatives (operator 2): metadata and plain-text conversion records for response records.

Each response gives two records, which name it in WARC-Refers-To and each other in WARC-Concurrent-To,
and carry its target, date, source headers and payload digest on.  Record ids are name-based, so that
a rerun after a lost executor gives the same ones.  All is done by SQL functions on each row alone.
"""

from __future__ import annotations

from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lynceus.functions.narrative import let
from lynceus.sources.lines import lined

CRLF = "\r\n"
VERSION = "WARC/1.1" + CRLF
#: References in text: decimal, hexadecimal, named; and the characters of the named ones, as HTML defines them.
REFERENCE = "&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);"
NAMED = {name[:-1]: text for name, text in html5.items() if name.endswith(";")} | {"nbsp": " "}
LINK = r"(?i)<a[ \t\r\n\f](?:[^>]*?[ \t\r\n\f])?href[ \t\r\n\f]*=[ \t\r\n\f]*(\"[^\"]*\"|'[^']*'|[^ \t\r\n\f\"'>]+)"
UNSEEN = r"(?is)<!--.*?-->|<(?:script|style|title)\b[^>]*>.*?</(?:script|style|title)\s*>"
#: Elements that end a line.
BLOCK = "p|div|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|tr|td|th|thead|tbody|tfoot|caption|table|article|section|nav|header|footer|aside|main|form|fieldset|legend|option|select|body|html|blockquote|pre|figure|figcaption|address|details|summary|dialog|center|hgroup|search|menu"
BREAKS = rf"(?i)</?(?:{BLOCK})\b[^>]*>"


def _character(reference: Column) -> Column:
    """What a reference (without & and ;) stands for; null for a name that HTML does not know."""
    hexadecimal = F.conv(F.substring(reference, 3, 6), 16, 10)
    code = F.when(reference.rlike("^#[xX]"), hexadecimal).otherwise(F.substring(reference, 2, 7)).cast("int")
    valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    number = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("\ufffd")
    names = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])
    usual = F.when(reference == "nbsp", " ").when(reference == "amp", "&").when(reference == "quot", '"').when(reference == "lt", "<").when(reference == "gt", ">")
    return F.when(reference.startswith("#"), number).otherwise(F.coalesce(usual, F.try_element_at(names, reference)))


def decoded(text: Column) -> Column:
    """The text with each reference replaced once; one that HTML does not know stays as it stands."""
    one = lambda r: F.coalesce(_character(r), F.concat(F.lit("&"), r, F.lit(";")))

    def replaced(t: Column) -> Column:
        after = F.array_append(F.transform(F.regexp_extract_all(t, F.lit(REFERENCE), F.lit(1)), one), F.lit(""))
        return F.when(t.contains("&"), F.array_join(F.zip_with(F.split(t, REFERENCE, -1), after, lambda p, r: F.concat(p, r)), "")).otherwise(t)

    return let(text, replaced)  # the text is made once, whatever it takes


def plain_text(html: Column) -> Column:
    """The text of a page, a line for each block; white space inside a line is one space."""
    text = F.regexp_replace(html, UNSEEN, "")
    text = F.regexp_replace(text, r"[ \t\r\n\f]{2,}|[\t\r\n\f]", " ")
    text = F.regexp_replace(F.regexp_replace(text, BREAKS, "\n"), r"<[^>]*>", "")
    text = F.regexp_replace(decoded(text), " *\n[ \n]*", "\n")
    return F.btrim(F.regexp_replace(text, " {2,}", " "), F.lit(" \n"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def urn(*parts: Column) -> Column:
    """A name-based record id: a UUID of version 8 and variant 8 with what is left of an MD5."""
    h = F.md5(F.concat_ws("\n", *[F.coalesce(p, F.lit("")) for p in parts]))
    cuts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("8"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Pages as response records: id, record_id, target_uri, warc_date, http_headers, payload."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    head = "HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "
    return pages.select(
        F.col(id_col),
        urn(F.lit("response"), F.col(id_col).cast("string"), F.col(url_col), payload).alias("record_id"),
        F.col(url_col).alias("target_uri"),
        F.lit(date).alias("warc_date"),
        F.concat(F.lit(head), F.octet_length(payload).cast("string")).alias("http_headers"),
        payload.alias("payload"),
    )


def derivatives(source: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Two rows for each response: id, warc_type, record_id, refers_to, concurrent_to, target_uri, warc_date,
    content_type, content_length, block_digest, payload_digest, source_headers, header, block, record.

    ``record`` is the whole record as it stands in a file: header, an empty line, block and two line ends.
    The metadata block has a field for the title, one for each source header and one for each link; the
    conversion block is the page's text.  White space in a target is percent-encoded in the header, so that
    no line breaks.  A null payload or header is empty; a null target leaves its header line out; rows that repeat give
    records that repeat, with the same ids; an empty table gives an empty table.
    """
    none = F.lit("")
    rows = source.select(
        F.col(id_col), "record_id", "target_uri", "warc_date",
        F.coalesce("http_headers", none).alias("http_headers"), F.coalesce("payload", none).alias("payload"),
    )
    field = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit(CRLF))
    title = F.trim(decoded(F.regexp_replace(F.regexp_extract("payload", r"(?is)<title[^>]*>(.*?)</title", 1), r"[ \t\r\n\f]+", " ")))
    links = F.transform(
        F.regexp_extract_all("payload", F.lit(LINK), F.lit(1)), lambda x: F.when(x.rlike("^[\"']"), F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(x)
    )
    unfolded = F.regexp_replace("http_headers", r"\r?\n[ \t]+", " ")  # a line that begins with a blank goes on with the one before
    named = F.filter(F.split(unfolded, r"\r?\n"), lambda x: x.rlike(r"^[^:\s]+[ \t]*:"))
    headers = F.transform(named, lambda x: F.concat(F.rtrim(F.substring_index(x, ":", 1)), F.lit(": "), F.trim(F.regexp_replace(x, "^[^:]*:", ""))))
    lines = F.concat(
        F.array(F.concat(F.lit("title: "), title)),
        F.transform(headers, lambda x: F.concat(F.lit("source-"), x)),
        F.transform(links, lambda x: F.concat(F.lit("outlink: "), decoded(x))),
    )
    metadata_id, text_id = (urn(F.lit(x), F.col("record_id")) for x in ("metadata", "conversion"))
    record = lambda kind, own, other, mime, block: F.struct(
        F.lit(kind).alias("warc_type"), own.alias("record_id"), other.alias("concurrent_to"),
        F.lit(mime).alias("content_type"), block.alias("block"),
    )
    both = F.array(
        record("metadata", metadata_id, text_id, "application/warc-fields", F.concat(F.array_join(lines, CRLF), F.lit(CRLF))),
        record("conversion", text_id, metadata_id, "text/plain; charset=utf-8", plain_text(F.col("payload"))),
    )
    out = rows.select(
        id_col, F.explode(both).alias("r"), F.col("record_id").alias("refers_to"), "target_uri", "warc_date",
        digest(F.col("payload")).alias("payload_digest"), F.col("http_headers").alias("source_headers"),
    ).select(
        id_col, "r.warc_type", "r.record_id", "refers_to", "r.concurrent_to", "target_uri", "warc_date", "r.content_type",
        F.octet_length("r.block").cast("long").alias("content_length"), digest(F.col("r.block")).alias("block_digest"),
        "payload_digest", "source_headers", "r.block",
    )
    uri = F.col("target_uri")
    for blank, code in ((" ", "%20"), ("\t", "%09"), ("\r", "%0D"), ("\n", "%0A")):
        uri = F.replace(uri, F.lit(blank), F.lit(code))
    header = F.concat(
        F.lit(VERSION),
        field("WARC-Type", F.col("warc_type")),
        field("WARC-Record-ID", F.col("record_id")),
        field("WARC-Refers-To", F.col("refers_to")),
        field("WARC-Concurrent-To", F.col("concurrent_to")),
        F.when(F.col("target_uri").isNotNull(), field("WARC-Target-URI", uri)).otherwise(none),
        field("WARC-Date", F.col("warc_date")),
        field("WARC-Payload-Digest", F.col("payload_digest")),
        field("WARC-Block-Digest", F.col("block_digest")),
        field("Content-Type", F.col("content_type")),
        field("Content-Length", F.col("content_length").cast("string")),
    )
    out = out.withColumn("header", header).select(*[c for c in out.columns if c != "block"], "header", "block")
    return out.withColumn("record", F.concat("header", F.lit(CRLF), "block", F.lit(CRLF + CRLF)))


def write_records(made: DataFrame, path: str) -> None:
    """The records, one after the other, in a file for each partition."""
    made.select(F.expr("substring(record, 1, length(record) - 4)").alias("record")).write.option("lineSep", CRLF + CRLF).text(path)


def _chained(table: pa.Table) -> pa.Table:
    """Of one file's pieces in order, the piece that each one's record begins with."""
    table = table.sort_by("line")
    lines, sizes, needs = (table.column(c).to_pylist() for c in ("line", "bytes", "need"))
    begins, first, left = [], None, 0
    for line, size, need in zip(lines, sizes, needs):
        if first is None or left <= 0:
            first, left = line, need or 0
        begins.append(first)
        left -= size
    return pa.Table.from_arrays([table.column("file"), table.column("line"), pa.array(begins, pa.int64())], names=["file", "line", "begin"])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(warc_type, record_id, refers_to, target_uri, content_length, headers, block, whole) of written records, of any version.

    Files, gzipped or not, are split between tasks where one record may end and the next begin.  A record ends where
    its Content-Length says: pieces that its block reaches into are put together again, so a block may quote other
    records.  Only the sizes of a file's pieces meet in one task.  ``whole`` tells whether the file has the whole block.
    """
    pieces = lined(spark, path, CRLF + CRLF + "WARC/").select("file", "line", F.regexp_replace("value", "^WARC/", "").alias("value"))
    head = F.substring_index("value", CRLF + CRLF, 1)
    stated = F.regexp_extract(head, r"(?i)\r\n(?:content-length)[ \t]*:[ \t]*(\d+)[ \t]*(?:\r\n|$)", 1)
    need = F.when(stated != "", F.octet_length(head) + 4 + stated.cast("long"))
    sizes = pieces.select("file", "line", (F.octet_length("value") + 9).cast("long").alias("bytes"), need.cast("long").alias("need"))
    begins = sizes.groupBy("file").applyInArrow(_chained, "file string, line long, begin long")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda x: x["value"])  # one record's pieces
    whole = pieces.join(begins, ["file", "line"]).groupBy("file", "begin").agg(F.array_join(parts, CRLF + CRLF + "WARC/").alias("value"))
    rows = whole.select(F.split("value", CRLF + CRLF, 2).alias("r")).filter(F.size("r") == 2)
    unfolded = F.regexp_replace(F.col("r")[0], r"\r\n[ \t]+", " ")
    lines = F.transform(
        F.filter(F.split(unfolded, CRLF), lambda x: x.contains(":")),
        lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("name"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value")),
    )
    rows = rows.select(lines.alias("headers"), F.col("r")[1].alias("rest"))
    of = lambda name: F.get(F.filter("headers", lambda h: F.lower(h["name"]) == name), F.lit(0))["value"]
    length = of("content-length").cast("long")
    block = F.decode(F.substring(F.col("rest").cast("binary"), F.lit(1), F.coalesce(length, F.octet_length("rest")).cast("int")), "UTF-8")
    return rows.select(
        of("warc-type").alias("warc_type"), of("warc-record-id").alias("record_id"), of("warc-refers-to").alias("refers_to"),
        of("warc-target-uri").alias("target_uri"), length.alias("content_length"), "headers", block.alias("block"), (F.octet_length("rest") >= length).alias("whole"),
    )
