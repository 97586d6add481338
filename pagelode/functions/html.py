"""HTML extraction as columns; regular expressions over the page, no Python on the way."""

from __future__ import annotations

import html as _html
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements whose text is no visible text.
DROPPED = ("script", "style", "noscript", "iframe", "svg", "canvas")
#: What links are not followed.
SKIPPED_HREF = r"^(#|javascript:|mailto:|tel:|ftp:|data:)"
#: Entities that are replaced, the ampersand last.
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "#39": "'", "nbsp": " ", "middot": "·", "copy": "©", "reg": "®", "trade": "™", "hellip": "…", "mdash": "—", "ndash": "–", "laquo": "«", "raquo": "»", "bull": "•", "euro": "€", "times": "×", "amp": "&"}


def _numbered(text: Column) -> Column:
    """With numeric character references, decimal and hexadecimal, as their characters; numbers that are none as U+FFFD."""

    def of(piece: Column) -> Column:
        digits = F.regexp_extract(piece, "^([xX]?[0-9a-fA-F]+);", 1)
        code = F.when(digits.rlike("^[xX]"), F.conv(F.substring(digits, 2, 9), 16, 10)).otherwise(digits).cast("bigint")
        sound = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(sound, code).otherwise(F.lit(0xFFFD))), 8, "0")), "UTF-32")
        return F.concat(char, F.substring(piece, F.length(digits) + 2, F.length(piece)))

    pieces = F.split(text, "&#(?=(?:[xX][0-9a-fA-F]{1,7}|[0-9]{1,8});)")
    whole = F.array_join(F.concat(F.slice(pieces, 1, 1), F.transform(F.slice(pieces, 2, F.size(pieces)), of)), "")
    return F.when(text.contains("&#"), whole).otherwise(text)


def unescape(text: Column) -> Column:
    text = F.element_at(F.transform(F.array(text), _numbered), 1)
    for name, char in ENTITIES.items():
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return text


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def title(page: Column) -> Column:
    return F.trim(unescape(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def meta(page: Column, name: str) -> Column:
    """The content of <meta name=...>, with its attributes in either order; empty if there is none."""
    first = F.regexp_extract(page, rf"""(?is)<meta\s[^>]*name\s*=\s*["']{name}["'][^>]*content\s*=\s*["']([^"']*)["']""", 1)
    second = F.regexp_extract(page, rf"""(?is)<meta\s[^>]*content\s*=\s*["']([^"']*)["'][^>]*name\s*=\s*["']{name}["']""", 1)
    return unescape(F.when(first != "", first).otherwise(second))


def visible_text(page: Column) -> Column:
    """The text outside dropped elements, comments and tags, with white space collapsed; the title is part of it.

    A dropped element that is never closed takes the rest of the page with it, as in a browser."""
    bare = F.regexp_replace(page, r"(?s)<!--.*?-->", "")
    bare = F.regexp_replace(bare, rf"(?is)<({'|'.join(DROPPED)})\b[^>]*>.*?</\1\s*>", "")
    bare = F.regexp_replace(bare, rf"(?is)<(?:{'|'.join(DROPPED)})\b[^>]*>.*$", "")
    return _squeezed(unescape(F.regexp_replace(bare, r"(?s)<[^>]*>", "\n")))


def headings(page: Column) -> Column:
    """array<struct<tag,text>>: all h1, then h2, then h3; a heading's pieces of text are joined without a separator."""

    def of(tag: str) -> Column:
        inner = F.regexp_extract_all(page, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>"), F.lit(1))
        bare = lambda x: unescape(F.regexp_replace(F.trim(F.regexp_replace(x, r"(?s)\s*<[^>]*>\s*", "")), r"\s+", " "))
        return F.transform(inner, lambda x: F.struct(F.lit(tag).alias("tag"), bare(x).alias("text")))

    return F.filter(F.concat(*map(of, ("h1", "h2", "h3"))), lambda x: x["text"] != "")


def anchors(page: Column) -> Column:
    """array<struct<href,anchor>> in page order; an anchor without text has its title, both cut to 200."""
    raw = F.regexp_extract_all(page, F.lit(r"(?is)<a\s[^>]*>.*?</a\s*>"), F.lit(0))

    def parts(x):
        attributes = F.regexp_extract(x, r"(?is)^<a\s([^>]*)>", 1)
        href = unescape(F.trim(F.regexp_extract(attributes, r"""(?is)\bhref\s*=\s*["']([^"']*)["']""", 1)))
        text = _squeezed(unescape(F.regexp_replace(x, r"(?s)<[^>]*>", " ")))
        named = unescape(F.regexp_extract(attributes, r"""(?is)\btitle\s*=\s*["']([^"']*)["']""", 1))
        return F.struct(href.alias("href"), F.substring(F.when(text != "", text).otherwise(named), 1, 200).alias("anchor"))

    return F.transform(raw, parts)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


class _Visible(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.dropped = [], 0

    def handle_starttag(self, tag, attrs):
        self.dropped += tag in DROPPED

    def handle_endtag(self, tag):
        self.dropped -= tag in DROPPED and self.dropped > 0

    def handle_data(self, data):
        if not self.dropped:
            self.out.append(data)


@F.pandas_udf(T.StringType())
def visible_text_lenient(page: pd.Series) -> pd.Series:
    """By a tolerant parser, for pages that regular expressions misread, such as tags with > in an attribute."""

    def read(text):
        if text is None:
            return None
        parser = _Visible()
        parser.feed(text)
        parser.close()
        return " ".join(_html.unescape("\n".join(parser.out)).split())

    return pd.Series([read(t) for t in page], dtype=object)
