"""WARC derivatives in SQL functions: responses become linked metadata and plain-text conversion records.

A record is one string: version line, named fields, blank line, block. Reading one keeps its fields; each
derivative carries the response's URI and date, refers to its record id, and has digests of its own block, while
the response's fields and digests go into the metadata.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clicklens.functions.plan import evaluated_once

LINE, BLANK = "\r\n", "\r\n\r\n"

# The named character references of HTML, by their first letter so that a lookup passes a few names. A no-break
# space reads as a space.
REFERENCES: dict[str, dict[str, str]] = {}
for _name, _value in html5.items():
    if _name.endswith(";"):
        REFERENCES.setdefault(_name[0], {})[_name[:-1]] = " " if _name == "nbsp;" else _value
# Numbers of control characters that mean a character of Windows-1252, where that has one.
CONTROLS = {str(n): bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}
# Elements that end a line of text.
BLOCKS = """address article aside blockquote br center dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4
h5 h6 header hr li main nav ol option p pre section table td th title tr ul""".split()


def base32(hexadecimal: Column) -> Column:
    """Base 32 of 40 hexadecimal digits (a SHA-1)."""
    parts = [F.lpad(F.conv(F.substring(hexadecimal, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def digest(text: Column) -> Column:
    """Labelled digest of the UTF-8 bytes of a text."""
    return F.concat(F.lit("sha1:"), base32(F.sha1(text.cast("binary"))))


def record_id(*parts: Column) -> Column:
    """A name-based identifier: the same parts give the same URN."""
    h = F.md5(F.concat_ws("\n", *parts))
    pieces = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *pieces), F.lit(">"))


def serialise(fields: list[tuple[str, Column]], block: Column) -> Column:
    """One record of the fields that are not null, in order, with the length of its block."""
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in fields]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.concat_ws(LINE, F.lit("WARC/1.0"), *lines, length), F.lit(BLANK), block, F.lit(BLANK))


def response_records(pages: DataFrame, date: str) -> DataFrame:
    """``pages`` (page_id, url, html) with a column ``record``: a response record with its HTTP message.

    Null url and html are empty.
    """
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    length = F.octet_length(html).cast("string")
    block = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), length, F.lit(BLANK), html
    )
    fields = [
        ("WARC-Type", F.lit("response")),
        ("WARC-Target-URI", url),
        ("WARC-Date", F.lit(date)),
        ("WARC-Record-ID", record_id(F.lit("response"), F.col("page_id").cast("string"), url)),
        ("WARC-Payload-Digest", digest(html)),
        ("WARC-Block-Digest", digest(block)),
        ("Content-Type", F.lit("application/http; msgtype=response")),
    ]
    return pages.withColumn("record", serialise(fields, block))


def _fields(lines: Column) -> Column:
    """Structs (name, value) of header lines; a line without a colon is no field."""
    named = F.filter(lines, lambda x: F.instr(x, ":") > 1)
    return F.transform(
        named,
        lambda x: F.struct(
            F.trim(F.substring_index(x, ":", 1)).alias("name"),
            F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("value"),
        ),
    )


def field(fields: Column, name: str) -> Column:
    """Value of the first field of that name, in whatever case; null if there is none."""
    return F.get(F.filter(fields, lambda x: F.lower(x["name"]) == name.lower()), F.lit(0))["value"]


def parse_records(rows: DataFrame) -> DataFrame:
    """``rows`` with ``fields`` and ``block`` read from ``record``.

    The block has Content-Length bytes, or all that follows without one. A null record has no fields and an
    empty block.
    """
    record = F.coalesce("record", F.lit(""))
    head = F.substring_index(record, BLANK, 1)
    rest = F.substring(record, F.length(head) + len(BLANK) + 1, F.length(record))
    fields = _fields(F.split(head, LINE))
    rows = evaluated_once(rows.withColumns({"fields": fields, "block": rest}))
    length = F.expr("try_cast(_length AS int)")
    rows = rows.withColumn("_length", field(F.col("fields"), "Content-Length"))
    cut = F.when(
        length.isNotNull() & (length < F.octet_length("block")),
        F.substring(F.col("block").cast("binary"), F.lit(1), length).cast("string"),
    ).otherwise(F.col("block"))
    return rows.withColumn("block", cut).drop("_length")


def html_text(html: Column) -> Column:
    """Readable text: no scripts, styles, comments and tags; elements that end lines do; references resolved."""
    text = F.regexp_replace(html, r"(?is)<(script|style|noscript|template)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    text = F.regexp_replace(text, rf"(?i)</?(?:{'|'.join(BLOCKS)})\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[A-Za-z/!?][^>]*>", "")
    # A single space is the common case and stays untouched.
    text = F.regexp_replace(text, r"[\t\r\f\xA0][ \t\r\f\xA0]*|  [ \t\r\f\xA0]*", " ")
    text = F.regexp_replace(text, r" ?\n[ \n]*", "\n")
    # The lambda takes the text as a value, so its uses do not strip the page again.
    return F.get(F.transform(F.array(text), lambda t: F.trim(_resolved(t), F.lit(" \n"))), F.lit(0))


def _resolved(text: Column) -> Column:
    """Character references as characters, each once: what a reference stands for is not read again.

    Knows all names of HTML and decimal and hexadecimal numbers; numbers of no character give U+FFFD. A reference
    ends with a semicolon; anything else behind an ampersand stays as it is.
    """
    named = F.from_json(F.lit(json.dumps(REFERENCES)), "map<string, map<string, string>>")
    controls = F.from_json(F.lit(json.dumps(CONTROLS)), "map<string, string>")

    def number(name: Column) -> Column:
        spelled = F.when(
            F.rlike(name, F.lit(r"\A#[xX][0-9A-Fa-f]{1,6}\z")), F.conv(F.substring(name, F.lit(3), F.length(name)), 16, 10)
        ).when(F.rlike(name, F.lit(r"\A#[0-9]{1,7}\z")), F.substring(name, F.lit(2), F.length(name)))
        code = spelled.cast("long")
        code = F.when((code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF), code).otherwise(0xFFFD)
        utf = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(spelled.isNotNull(), F.coalesce(controls[code.cast("string")], utf))

    def piece(p: Column) -> Column:
        name = F.substring_index(p, ";", 1)
        known = F.when(F.startswith(name, F.lit("#")), number(name)).otherwise(named[F.substring(name, 1, 1)][name])
        behind = F.substring(p, F.length(name) + 2, F.length(p))
        whole = F.concat(known, behind)
        return F.when(F.contains(p, F.lit(";")), whole)

    def resolved(parts: Column) -> Column:
        tail = F.transform(F.slice(parts, 2, F.size(parts)), lambda p: F.coalesce(piece(p), F.concat(F.lit("&"), p)))
        return F.array_join(F.concat(F.slice(parts, 1, 1), tail), "")

    # The lambda takes the pieces as a value, so the text is split once.
    spelled = F.get(F.transform(F.array(F.split(text, "&", -1)), resolved), F.lit(0))
    return F.when(F.contains(text, F.lit("&")), spelled).otherwise(text)


def derivatives(rows: DataFrame) -> DataFrame:
    """Metadata and conversion records of the responses in ``rows`` (record, ...).

    Two rows per response record whose block is an HTTP message, with all columns of ``rows`` but ``record`` and
    warc_type, record_id, refers_to, target_uri, warc_date, content_type, block_digest, content_length, block
    and the serialised ``derived`` record. Other record types, null and unreadable records give no rows. Without
    a record id in the source refers_to is null. Repeated records give repeated rows with equal ids. A column of
    ``rows`` that has a name of the result gives way to it.
    """
    names = ["warc_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type"]
    names += ["block_digest", "content_length", "block", "derived"]
    kept = [c for c in rows.columns if c.lower() not in (*names, "record", "fields")]
    parsed = parse_records(rows.select(*[F.col(f"`{c}`") for c in kept], "record"))
    f = F.col("fields")
    parsed = parsed.filter((F.lower(field(f, "WARC-Type")) == "response") & F.startswith("block", F.lit("HTTP/")))
    head = F.substring_index("block", BLANK, 1)
    parsed = evaluated_once(
        parsed.select(
            *[F.col(f"`{c}`").alias(f"_in_{c}") for c in kept],
            "fields",
            F.split(head, LINE).alias("http"),
            F.substring("block", F.length(head) + len(BLANK) + 1, F.length("block")).alias("payload"),
        )
    )
    title = F.regexp_extract("payload", r"(?is)<title[^>]*>(.*?)</title", 1)
    link = r"""(?is)<(?:a|area|link|img|script|iframe)\b[^>]*?\b(?:href|src)\s*=\s*["']([^"']*)["']"""
    metadata = F.to_json(
        F.struct(
            F.col("fields").alias("source_fields"),
            F.get("http", F.lit(0)).alias("status_line"),
            _fields(F.col("http")).alias("http_fields"),
            F.trim(_resolved(title)).alias("title"),
            F.transform(F.regexp_extract_all("payload", F.lit(link), F.lit(1)), _resolved).alias("links"),
        )
    )
    made = evaluated_once(
        parsed.select(
            *[f"_in_{c}" for c in kept],
            field(f, "WARC-Record-ID").alias("refers_to"),
            field(f, "WARC-Target-URI").alias("target_uri"),
            field(f, "WARC-Date").alias("warc_date"),
            metadata.alias("_metadata"),
            html_text(F.col("payload")).alias("_text"),
        )
    )
    kind = lambda name, content, block: F.struct(
        F.lit(name).alias("warc_type"), F.lit(content).alias("content_type"), F.col(block).alias("block")
    )
    both = F.array(kind("metadata", "application/json", "_metadata"), kind("conversion", "text/plain; charset=UTF-8", "_text"))
    out = made.select(*[f"_in_{c}" for c in kept], "refers_to", "target_uri", "warc_date", F.inline(both))
    out = out.withColumn("record_id", record_id("warc_type", F.coalesce("refers_to", F.concat_ws(" ", "target_uri", "warc_date"))))
    out = out.withColumn("block_digest", digest(F.col("block"))).withColumn("content_length", F.octet_length("block").cast("long"))
    fields = [
        ("WARC-Type", F.col("warc_type")),
        ("WARC-Target-URI", F.col("target_uri")),
        ("WARC-Date", F.col("warc_date")),
        ("WARC-Record-ID", F.col("record_id")),
        ("WARC-Refers-To", F.col("refers_to")),
        ("WARC-Block-Digest", F.col("block_digest")),
        ("Content-Type", F.col("content_type")),
    ]
    out = evaluated_once(out)
    return out.select(
        *[F.col(f"`_in_{c}`").alias(c) for c in kept], *names[:-1], serialise(fields, F.col("block")).alias("derived")
    )
