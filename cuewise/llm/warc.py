r"""WARC derivatives: metadata and plain-text conversion records of responses.

Method: each response gives two records.  The conversion record holds the page's
plain text, the metadata record its title, language and outlinks as
``application/warc-fields``.  Both refer to the response's record id and carry its
target URI, its HTTP header block and its digests; the metadata record also names
the conversion it goes with (concurrent-to).  Ids are made from the source's id and the
record's type, so a rerun makes the same records.

Scale: a map over responses in DataFrame expressions, with no shuffle and no Python;
a long page costs what its own bytes cost.  Serialised records are WARC/1.1
bytes, so files of any size can be put together from partitions.

Edge cases: tags that are never closed stay text, and cost what their bytes cost; a quoted value may hold angle brackets and blanks; the
first attribute of a name counts; line ends in
an address are percent-encoded, so they cannot end a header; a null payload is empty; a null URI or date leaves its header out; a null id is
made from URI and payload; equal rows make equal records; a page without title,
language or links leaves those lines out; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.entities import html5

from pyspark.sql import Column, DataFrame, functions as F

#: Character references by name that the oracle knows besides ``amp``; all of HTML's are decoded.
NAMED = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®", "middot": "·", "hellip": "…", "ndash": "–", "mdash": "—", "laquo": "«", "raquo": "»", "euro": "€"}
SLOTS = 251
HIDDEN = ("script", "style", "noscript", "template", "svg")
_BLOCK = "p|div|br|li|ul|ol|dl|dt|dd|h[1-6]|tr|td|th|table|section|article|aside|main|header|footer|nav|title|head|body|html|blockquote|pre|hr|form|figure|figcaption"
#: The rest of a tag.  What is quoted behind an equals sign may hold angle brackets; without its closing quote, the quote is
#: a sign like others.  The tag ends at the next angle bracket, so a page of tags that are never closed is read once.
_QUOTED = r"""(?:"[^"]*+"|'[^']*+')"""
_REST = rf"""(?:[^<>=]++|=\s*+{_QUOTED}?+)*+>"""
#: Elements that end a drawing which is not closed, as a browser shows what is in them.
_SHOWN = f"{_BLOCK}|a|b|i|u|em|strong|small|span|center|img|code|sub|sup"
#: What no reader sees: comments, and elements with all that is in them, to the end of the page if they are not closed.
#: A drawing may close itself, or be ended by what cannot be in it.
UNSEEN = (
    rf"(?is)<(?:!--.*?(?:-->|\z)|svg\b{_REST}(?:(?<=/>)|.*?(?:</svg\s*+>|(?=<(?:{_SHOWN})\b)|\z))"
    rf"|({'|'.join(h for h in HIDDEN if h != 'svg')})\b{_REST}.*?(?:</\1\s*+>|\z))"
)
BLOCK_TAG = rf"(?i)</?(?:{_BLOCK})\b{_REST}"
ANY_TAG = rf"<[/!?A-Za-z]{_REST}"
PLAIN_TITLE = rf"(?i)<title\b{_REST}([^<]*+)</title"


def _attribute(tag: str, name: str) -> str:
    """Pattern of a start tag up to its first attribute of exactly this name, whose value, quotes included, is the first group."""
    value = rf"(?:{_QUOTED}|[^\s>\"'<][^\s><]*+)"
    others = rf"(?:[\s/]*+(?!{name}\s*+=)[^\s/>=<]++(?:\s*+=\s*+{value})?+)*+"
    return rf"{tag}(?=[\s/]){others}[\s/]*+{name}\s*+=\s*+({value})"


LANGUAGE = rf"(?i)<{_attribute('html', 'lang')}"
#: Links, and first what holds none, which leaves the group empty.
SHOWN_LINK = rf"(?i)<(?:!--(?s:.*?)(?:-->|\z)|(?:script\b{_REST}(?s:.*?)(?:</script\s*+>|\z))|(?:style\b{_REST}(?s:.*?)(?:</style\s*+>|\z))|{_attribute('a', 'href')})"


def unquoted(value: Column) -> Column:
    """An attribute's value without its quotes and the blanks around it."""
    return F.trim(F.regexp_replace(value, r"""(?s)^(["'])(.*)\1$""", "$2"))


def _slot(first: int, length: int) -> int:
    return (first + 31 * length) % SLOTS


def _slots() -> str:
    """The names that end in a semicolon, as JSON: a list of small maps, as Spark looks through a map from its start."""
    maps: list[dict] = [{} for _ in range(SLOTS)]
    for name, char in html5.items():
        if name.endswith(";"):
            maps[_slot(ord(name[0]), len(name) - 1)][name[:-1]] = char
    return json.dumps(maps)


def decoded(text: Column, *, attribute: bool = False) -> Column:
    """Character references decoded, once; what names no character stays as it is.

    Old names need no semicolon, in an ``attribute`` only where no letter, digit or ``=`` follows.
    """
    table = F.from_json(F.lit(_SLOTS), "array<map<string,string>>")
    pieces = F.split(text, "&")
    after = lambda piece, length: F.substring(piece, length, F.length(piece))

    # What a step uses several times is a field of the row that the step before made.
    def with_name(piece: Column) -> Column:
        return F.struct(piece.alias("piece"), F.regexp_extract(piece, "^(#[xX][0-9A-Fa-f]{1,6}|#[0-9]{1,7}|[A-Za-z][A-Za-z0-9]*);", 1).alias("name"))

    def with_char(x: Column) -> Column:
        name = x["name"]
        code = F.when(F.lower(F.substring(name, 2, 1)) == "x", F.conv(F.substring(name, 3, 6), 16, 10)).otherwise(F.substring(name, 2, 7)).try_cast("long")
        named = F.element_at(F.element_at(table, ((F.ascii(name) + 31 * F.length(name)) % SLOTS + 1).cast("int")), name)
        return F.struct(x["piece"].alias("piece"), F.length(name).alias("length"), F.when(name.startswith("#"), code).alias("code"), F.when((name != "") & ~name.startswith("#"), named).alias("char"))

    def one(x: Column) -> Column:
        piece, code = x["piece"], x["code"]
        valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        numeric = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        old = F.regexp_extract(piece, _OLD + ("(?![=A-Za-z0-9])" if attribute else ""), 1)
        bare = F.element_at(F.from_json(F.lit(_OLD_JSON), "map<string,string>"), old)
        return (
            F.when(x["char"].isNotNull(), F.concat(x["char"], after(piece, x["length"] + 2)))
            .when(valid, F.concat(numeric, after(piece, x["length"] + 2)))
            .when(code.isNull() & (old != ""), F.concat(bare, after(piece, F.length(old) + 1)))
            .otherwise(F.concat(F.lit("&"), piece))
        )

    def joined(ps: Column) -> Column:
        rest = F.slice(ps, 2, F.greatest(F.size(ps) - 1, F.lit(0)))
        return F.concat(ps[0], F.array_join(F.transform(F.transform(F.transform(rest, with_name), with_char), one), ""))

    # A list of one, so that the text is split once.
    return F.when(F.contains(text, F.lit("&")), F.transform(F.array(pieces), joined)[0]).otherwise(text)


_SLOTS = _slots()
_OLD_JSON = json.dumps({n: c for n, c in html5.items() if not n.endswith(";")})
_OLD = "^(" + "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)) + ")"


def plain(text: Column) -> Column:
    """References decoded, blanks collapsed, blank lines dropped."""

    def lines(whole: Column) -> Column:
        """Lines without blanks at their ends; the collapsing pattern runs where there is something to collapse."""
        broad = whole.contains("  ")
        for sign in "\t\r\f\v\xa0":
            broad = broad | whole.contains(sign)
        single = F.when(broad, F.regexp_replace(whole, r" [ \t\r\f\x{B}\x{A0}]+|[\t\r\f\x{B}\x{A0}][ \t\r\f\x{B}\x{A0}]*", " ")).otherwise(whole)
        return F.array_join(F.filter(F.transform(F.split(single, "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")

    return F.transform(F.array(decoded(text)), lines)[0]


def without_tags(html: Column) -> Column:
    """What a reader sees, references still coded: no comments, scripts or tags; block tags end lines."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(html, UNSEEN, ""), BLOCK_TAG, "\n"), ANY_TAG, "")


def coded_title(html: Column, plain_title: Column) -> Column:
    """What the first title element holds; empty without one that is closed.

    ``plain_title``: the first that holds no tag, which settles nearly all pages.  In the others
    each cut reads the page once.
    """
    begun = F.split(html, r"(?i)<title\b", 2)
    inside = F.split(F.regexp_replace(F.get(begun, F.lit(1)), r"^[^>]*+>", ""), "(?i)</title", 2)
    return F.when(plain_title != "", plain_title).when(F.size(inside) == 2, inside[0]).otherwise("")


def one_line(text: Column) -> Column:
    """Text without line ends, as a header or a field must be; line ends and blanks around them are one blank."""
    return F.regexp_replace(text, r"[ \t]*+[\r\n]\s*+", " ")


def header_uri(uri: Column) -> Column:
    """An address with its line ends percent-encoded."""
    return F.replace(F.replace(uri, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def record_id(*parts: Column) -> Column:
    """An id that follows from ``parts``."""
    h = F.md5(F.concat_ws("\n", *parts))
    return F.concat(F.lit("urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"))


def digest(body: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(body, 256))


def shown_links(html: Column) -> Column:
    """Addresses of all links that are not in comments, scripts or styles, in order."""
    found = F.transform(F.array_remove(F.regexp_extract_all(html, F.lit(SHOWN_LINK), F.lit(1)), ""), unquoted)
    return F.transform(F.array_remove(found, ""), lambda x: header_uri(decoded(x, attribute=True)))


def responses(pages: DataFrame, *, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of a table of pages (page_id, url, html)."""
    payload = F.coalesce("html", F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit("\r\n\r\n"))
    key = F.coalesce(F.col("page_id").cast("string"), F.concat(F.lit("?"), F.sha2("payload", 256)))
    return (
        pages.select(F.col("page_id").cast("long").alias("page_id"), header_uri(F.col("url")).alias("target_uri"), payload.alias("payload"))
        .withColumn("record_id", record_id(F.lit("response"), key, F.coalesce("target_uri", F.lit(""))))
        .withColumn("date", F.lit(date))
        .withColumn("http_headers", head)
        .withColumn("block_digest", digest(F.concat("http_headers", "payload")))
        .withColumn("payload_digest", digest(F.col("payload")))
    )


def derivatives(found: DataFrame) -> DataFrame:
    """Two records a response: page_id, warc_type, record_id, refers_to, concurrent_to, target_uri,
    date, content_type, content_length, block_digest, body, and the source's
    http_headers, block and payload digest."""
    html = F.col("payload")
    # Columns of their own first: what ``plain`` uses several times is then evaluated once a row.
    coded = found.withColumns({"coded": without_tags(html), "plain_title": F.regexp_extract(html, PLAIN_TITLE, 1)})
    coded = coded.withColumn("coded_title", coded_title(html, F.col("plain_title")))
    text = coded.withColumns({"text": plain(F.col("coded")), "title": plain(F.col("coded_title")), "language": F.regexp_extract(F.regexp_extract(html, LANGUAGE, 1), "[A-Za-z0-9-]+", 0), "links": shown_links(html)})
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    fields = F.concat(
        F.when(F.col("title") != "", line("title", one_line(F.col("title")))).otherwise(""),
        F.when(F.col("language") != "", line("language", F.col("language"))).otherwise(""),
        F.array_join(F.transform("links", lambda x: line("outlink", x)), ""),
    )
    ids = text.withColumns({"fields": fields, "conversion_id": record_id(F.lit("conversion"), F.col("record_id")), "metadata_id": record_id(F.lit("metadata"), F.col("record_id"))})
    metadata = F.struct(F.lit("metadata").alias("warc_type"), F.col("metadata_id").alias("record_id"), F.col("conversion_id").alias("concurrent_to"), F.lit("application/warc-fields").alias("content_type"), F.col("fields").alias("body"))
    conversion = F.struct(F.lit("conversion").alias("warc_type"), F.col("conversion_id").alias("record_id"), F.lit(None).cast("string").alias("concurrent_to"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("text").alias("body"))
    both = ids.select("page_id", F.col("record_id").alias("refers_to"), "target_uri", "date", F.col("http_headers").alias("source_http_headers"), F.col("block_digest").alias("source_block_digest"), F.col("payload_digest").alias("source_payload_digest"), F.explode(F.array(metadata, conversion)).alias("r"))
    return both.select(
        "page_id", "r.warc_type", "r.record_id", "refers_to", "r.concurrent_to", "target_uri", "date", "r.content_type",
        F.octet_length("r.body").cast("long").alias("content_length"), digest(F.col("r.body")).alias("block_digest"), "r.body",
        "source_http_headers", "source_block_digest", "source_payload_digest",
    )


def serialised(records: DataFrame) -> DataFrame:
    """(record_id, record): each record as WARC/1.1 bytes, to be written one behind the other."""
    header = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), one_line(value), F.lit("\r\n")), F.lit(""))
    bracket = lambda c: F.concat(F.lit("<"), F.col(c), F.lit(">"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), header("WARC-Type", F.col("warc_type")), header("WARC-Record-ID", bracket("record_id")), header("WARC-Refers-To", bracket("refers_to")), header("WARC-Concurrent-To", bracket("concurrent_to")),
        header("WARC-Target-URI", F.col("target_uri")), header("WARC-Date", F.col("date")), header("WARC-Block-Digest", F.col("block_digest")), header("WARC-Source-Block-Digest", F.col("source_block_digest")), header("WARC-Source-Payload-Digest", F.col("source_payload_digest")),
        header("WARC-Source-HTTP-Headers", F.regexp_replace(F.base64(F.col("source_http_headers").cast("binary")), "\r\n", "")), header("Content-Type", F.col("content_type")), header("Content-Length", F.col("content_length").cast("string")), F.lit("\r\n"),
    )
    return records.select("record_id", F.concat(head.cast("binary"), F.col("body").cast("binary"), F.lit("\r\n\r\n").cast("binary")).alias("record"))


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of WARC bytes."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode("utf-8").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(line.split(": ", 1) for line in lines)
        start = end + 4
        stop = start + int(headers["Content-Length"])
        yield headers, data[start:stop]
        at = stop + 4
