"""Derivative records of web archives: from responses to linked metadata and plain-text conversion records.

Each response gives a metadata record, with its title, outgoing links and the headers and digests of the source,
and a conversion record with its plain text. Both refer to the response by its identifier and keep its address
and date. Column functions only; nothing is shuffled.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
VERSION = "WARC/1.1"
#: Elements without readable text, and those that end a line.
HIDDEN = ("script", "style", "noscript", "template")
BREAKS = "address article aside blockquote body br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section table tbody td th thead title tr ul"
#: Named character references by the standard table of names; the ampersand is resolved last, by itself.
NAMED = {f"&{name};": chr(code) for name, code in name2codepoint.items() if name != "amp"} | {"&nbsp;": " ", "&apos;": "'"}
NAME_PATTERN = r"&[A-Za-z][A-Za-z0-9]{1,7};"

HIDDEN_PATTERN = "(?is)<(?:!--.*?-->|" + "|".join(rf"{n}\b[^>]*>.*?</{n}\s*>" for n in HIDDEN) + ")"
BREAK_PATTERN = rf"(?i)</?(?:{'|'.join(BREAKS.split())})\b[^>]*>"
TAG_PATTERN = r"</?[a-zA-Z!?][^>]*>"
NUMBER_PATTERN = r"&#([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"
#: Characters above are for private use.
LAST_CHAR = 0xEFFFF
TITLE_PATTERN = r"(?is)<title[^>]*>(.*?)</title\s*>"
#: The address of a link as it stands: in double quotes, single quotes or none.
LINK_PATTERN = r"""(?i)<a(?:\s[^>]*?)?[\s"']href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
#: Blanks that are not one space already.
BLANK_PATTERN = r" ?[\t\r\f\x{0B}][ \t\r\f\x{0B}]*|  [ \t\r\f\x{0B}]*"
LINES_PATTERN = r" ?\n[ \n]*"


def digest(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.encode(content, "UTF-8"), 256))


def record_id(seed: Column) -> Column:
    """A urn:uuid that follows from what the record is made of, so that a task that runs again gives it again."""
    h = F.md5(seed)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _numbers(text: Column) -> Column:
    """Decimal and hexadecimal character references resolved; those of no character are left as they are."""

    def resolve(out: Column, ref: Column) -> Column:
        digits = F.regexp_extract(ref, NUMBER_PATTERN, 1)
        hexed = F.lower(F.substring(digits, 1, 1)) == "x"
        code = F.when(hexed, F.conv(F.substring(digits, 2, 6), 16, 10)).otherwise(digits).cast("int")
        # an ampersand waits for the others, or it would make new references
        char = F.when(code == ord("&"), "&amp;").otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        known = code.between(1, 0xD7FF) | code.between(0xE000, LAST_CHAR)
        return F.when(known, F.replace(out, ref, char)).otherwise(out)

    refs = F.array_distinct(F.regexp_extract_all(text, F.lit(NUMBER_PATTERN), F.lit(0)))
    return F.when(F.contains(text, F.lit("&#")), F.aggregate(refs, text, resolve)).otherwise(text)


def _named(text: Column) -> Column:
    """Named character references resolved, but for the ampersand; unknown names are left as they are."""
    chars = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])
    refs = F.array_distinct(F.regexp_extract_all(text, F.lit(NAME_PATTERN), F.lit(0)))
    known = F.filter(refs, lambda r: r != "&amp;")
    found = F.aggregate(known, text, lambda out, r: F.replace(out, r, F.coalesce(chars[r], r)))
    return F.when(F.contains(text, F.lit("&")), found).otherwise(text)


def _unquoted(address: Column) -> Column:
    """A link's address without the quotes around it."""
    return F.when(F.substring(address, 1, 1).isin('"', "'"), F.substring(address, F.lit(2), F.length(address) - 2)).otherwise(address)


def _resolved(text: Column) -> Column:
    whole = F.replace(_numbers(_named(text)), F.lit("&amp;"), F.lit("&"))
    return F.when(F.contains(text, F.lit("&")), whole).otherwise(text)


def _bare(html: Column) -> Column:
    shown = F.regexp_replace(html, HIDDEN_PATTERN, "")
    lined = F.regexp_replace(shown, BREAK_PATTERN, "\n")
    return F.regexp_replace(lined, TAG_PATTERN, "")


def _tidy(text: Column) -> Column:
    one = F.regexp_replace(F.replace(text, F.lit("&amp;"), F.lit("&")), BLANK_PATTERN, " ")
    return F.btrim(F.regexp_replace(one, LINES_PATTERN, "\n"), F.lit(" \n"))


#: Readable text of a page: hidden elements and tags go, block elements end lines, references are resolved, blanks are merged.
TEXT_STEPS = (_bare, _named, _numbers, _tidy)


def plain_text(html: Column) -> Column:
    for step in TEXT_STEPS:
        html = step(html)
    return html


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once however often it is used: the optimizer merges projections, not this."""
    return df.withColumn(name, F.explode(F.array(value)))


def one_line(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"[ \t\r\n\f\x{0B}]+", " "))


def responses(pages: DataFrame, date: str) -> DataFrame:
    """Response records from pages(page_id, url, html): key, record_id, target_uri, date, http_header, payload, payload_digest.

    Null addresses and pages are empty. Equal rows give equal records.
    """
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    parts = pages.select(F.col("page_id").alias("key"), url.alias("target_uri"), html.alias("payload"))
    known = once(parts, "payload_digest", digest(F.col("payload")))
    status = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("payload"), F.lit(CRLF))
    seed = F.concat_ws("|", F.lit("response"), F.coalesce(F.col("key").cast("string"), F.lit("")), "target_uri", "payload_digest")
    return known.select("key", record_id(seed).alias("record_id"), "target_uri", F.lit(date).alias("date"), status.alias("http_header"), "payload", "payload_digest")


def _header(kind: str, record: Column, block_type: str, block: Column, block_digest: Column) -> Column:
    fields = [
        ("WARC-Type", F.lit(kind)),
        ("WARC-Record-ID", record),
        ("WARC-Refers-To", F.col("record_id")),
        ("WARC-Target-URI", one_line(F.col("target_uri"))),
        ("WARC-Date", F.col("date")),
        ("WARC-Block-Digest", block_digest),
        ("Content-Type", F.lit(block_type)),
        ("Content-Length", F.octet_length(block)),
    ]
    return F.concat(F.lit(VERSION + CRLF), *[x for name, value in fields for x in (F.lit(f"{name}: "), value, F.lit(CRLF))])


def derive(source: DataFrame) -> DataFrame:
    """Two records for each response: (key, record_type, record_id, refers_to, source_payload_digest, block_digest, content_length, header, block).

    Source columns are those of ``responses``; others are ignored. The metadata block lists title, text length,
    links in order of the page (repeats included), and the source's HTTP header and payload digest. An empty page
    has an empty conversion block, and an empty table gives no records. Pages of any length are read whole. A hidden
    element or comment that is never closed hides nothing: its tag goes and its content stays.
    """
    read = source.select("key", "record_id", "target_uri", "date", "http_header", "payload", "payload_digest", F.col("payload").alias("_text"))
    for step in TEXT_STEPS:
        read = once(read, "_text", step(F.col("_text")))
    title = one_line(_resolved(F.regexp_extract("payload", TITLE_PATTERN, 1)))
    links = F.transform(F.regexp_extract_all("payload", F.lit(LINK_PATTERN), F.lit(1)), lambda x: F.concat(F.lit("outlink: "), one_line(_resolved(_unquoted(x))), F.lit(CRLF)))
    sources = F.transform(
        F.filter(F.split("http_header", CRLF), lambda x: x != ""), lambda x: F.concat(F.lit("source-http-header: "), x, F.lit(CRLF))
    )
    fields = F.concat(
        F.lit("title: "), title, F.lit(f"{CRLF}text-bytes: "), F.octet_length("_text"), F.lit(CRLF), F.array_join(links, ""),
        F.array_join(sources, ""), F.lit("source-payload-digest: "), F.col("payload_digest"), F.lit(CRLF),
    )
    read = once(read, "_fields", fields)
    kinds = [("metadata", "application/warc-fields", F.col("_fields")), ("conversion", "text/plain; charset=utf-8", F.col("_text"))]
    both = read.select(
        "key", "record_id", "target_uri", "date", "payload_digest",
        F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(t).alias("type"), b.alias("block"), digest(b).alias("digest")) for k, t, b in kinds])).alias("r"),
    )
    own = record_id(F.concat_ws("|", "r.kind", "record_id", "r.digest"))
    header = F.when(F.col("r.kind") == "metadata", _header("metadata", own, kinds[0][1], F.col("r.block"), F.col("r.digest"))).otherwise(
        _header("conversion", own, kinds[1][1], F.col("r.block"), F.col("r.digest"))
    )
    return both.select(
        "key",
        F.col("r.kind").alias("record_type"),
        own.alias("record_id"),
        F.col("record_id").alias("refers_to"),
        F.col("payload_digest").alias("source_payload_digest"),
        F.col("r.digest").alias("block_digest"),
        F.octet_length("r.block").cast("bigint").alias("content_length"),
        header.alias("header"),
        F.col("r.block").alias("block"),
    )


def write(records: DataFrame, path: str) -> None:
    """Records(header, block) as gzip-compressed archive files, one for each partition."""
    whole = F.concat("header", F.lit(CRLF), "block")
    records.select(whole.alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)


def read(spark, path: str) -> DataFrame:
    """(header, block) of the records in archive files that ``write`` made."""
    start = VERSION + CRLF
    whole = spark.read.text(path, lineSep=CRLF * 2 + start).select(F.regexp_replace("value", f"(^{start})|({CRLF}{CRLF}$)", "").alias("v"))
    at = F.instr("v", CRLF * 2)
    return whole.select(F.concat(F.lit(start), F.substring("v", F.lit(1), at + 1)).alias("header"), F.substring("v", at + 4, F.length("v")).alias("block"))
