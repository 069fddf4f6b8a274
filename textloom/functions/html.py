"""HTML to title, body text and links as Column functions.

A lexer over text nodes: skipped elements and comments become tag boundaries, the
rest is split at tags.  ``parse_tree`` is a slower parser-based path for markup a
lexer cannot follow.
"""

from __future__ import annotations

import html as _html
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as St

MAX_BYTES = 10 * 1024 * 1024
_SKIPPED = r"(?is)<(script|style|noscript)\b[^>]*>.*?(?:</\1\s*>|$)"
_COMMENT = r"(?s)<!--.*?(?:-->|$)"
_TITLE = r"(?is)<title\b[^>]*>(.*?)</title\s*>"
# a ``>`` inside a quoted attribute value does not end a tag
_TAG = r"<[!?][^>]*+(?:>|$)|</?[A-Za-z](?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|$)|'[^']*+(?:'|$))?+)*+(?:>|$)|</[^A-Za-z>][^>]*+(?:>|$)"
# a reference that is none of those ``unescape_basic`` knows
_OTHER_REFERENCE = r"&(?!(?:lt|gt|quot|apos|nbsp|amp|#39);)[A-Za-z#]"


@F.pandas_udf(St.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: _html.unescape(x) if isinstance(x, str) and "&" in x else x)


def unescape_basic(text: Column) -> Column:
    """Character references of markup characters and quotes, decimal ones included."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def unescape(text: Column) -> Column:
    """All named and numeric character references; only texts with uncommon ones go through Python (Arrow batches)."""
    return F.coalesce(_unescape(F.when(text.rlike(_OTHER_REFERENCE), text)), unescape_basic(text))


def decode_entities(text: Column) -> Column:
    """Second pass over parsed text: ``&amp; &lt; &gt; &quot;`` in turn, then decimal codes up to 255.

    A code above 127 becomes the Latin-1 character.
    """
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        text = F.replace(text, F.lit(entity), F.lit(char))
    pieces = F.regexp_extract_all(text, F.lit(r"&#[0-9]+[^;]*;|[^&]+|&"), F.lit(0))
    number = lambda p: F.regexp_extract(p, r"^&#([0-9]{1,9})", 1)
    small = lambda p: p.rlike(r"^&#0*(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?![0-9])[^;]*;")
    one = lambda p: F.when(small(p), F.char(number(p).try_cast("int"))).otherwise(p)
    return F.when(F.contains(text, F.lit("&#")), F.array_join(F.transform(pieces, one), "")).otherwise(text)


def _visible(page: Column) -> Column:
    page = F.substring_index(page, "\x00", 1)
    return F.regexp_replace(F.regexp_replace(page, _COMMENT, "<x>"), _SKIPPED, "<x>")


def title(page: Column, full: bool = True) -> Column:
    """Text of all title elements joined without separator."""
    found = F.array_join(F.regexp_extract_all(_visible(page), F.lit(_TITLE), F.lit(1)), "")
    return decode_entities(unescape(found) if full else unescape_basic(found))


def body_text(page: Column, full: bool = True) -> Column:
    """Text nodes outside titles, each followed by a blank; empty if no ASCII letter or digit is left.

    Line ends and tabs become blanks one by one.  Without ``full`` only the references
    of markup characters, quotes and the hard blank are decoded.
    """
    nodes = F.split(F.regexp_replace(_visible(page), _TITLE, "<x>"), _TAG)
    kept = F.filter(nodes, lambda n: n.rlike(r"[^ \t\n\r\f]"))
    text = F.concat(F.array_join(kept, " "), F.lit(" "))
    text = F.translate(unescape(text) if full else unescape_basic(text), "\n\t\r", "   ")
    decoded = decode_entities(text)
    return F.when(decoded.rlike("[A-Za-z0-9]"), decoded).otherwise(F.when(page.isNotNull(), ""))


def links(page: Column) -> Column:
    """Raw ``href`` values of the anchors in document order, repeated ones included."""
    tags = F.regexp_extract_all(_visible(page), F.lit(r"(?i)<a\s(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>"), F.lit(0))
    has = F.filter(tags, lambda t: t.rlike(r"(?i)\shref\s*="))
    value = lambda t: F.regexp_extract(t, r"(?i)\shref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", 1)
    other = lambda t: F.concat(F.regexp_extract(t, r"(?i)\shref\s*=\s*'([^']*)'", 1), F.regexp_extract(t, r"(?i)\shref\s*=\s*([^\s>\"']+)", 1))
    pick = lambda t: F.when(value(t) != "", value(t)).otherwise(other(t))
    found = F.array_join(F.transform(has, pick), "\x00")  # no value holds this character: pages end at it
    return F.when(F.size(has) > 0, F.split(unescape(found), "\x00")).when(page.isNotNull(), F.array().cast("array<string>"))


def raw_links(page: Column) -> Column:
    """Quoted ``href`` values anywhere in the bytes of a page, 1 to 2,048 characters long."""
    found = F.regexp_extract_all(page, F.lit("href[ \\t]*=[ \\t]*(?:\"([^\"]*)\"|'[^']*')"), F.lit(0))
    value = F.transform(found, lambda t: F.regexp_replace(F.regexp_replace(t, "^href[ \\t]*=[ \\t]*[\"']", ""), "[\"']$", ""))
    return F.filter(value, lambda v: F.length(v).between(1, 2048))


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.nodes, self.links, self.skip, self.in_title = [], [], [], 0, 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "noscript"):
            self.skip += 1
        elif tag == "title":
            self.in_title += 1
        elif tag == "a" and not self.skip:
            self.links += [v for k, v in attrs if k == "href" and v is not None][:1]

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript"):
            self.skip = max(0, self.skip - 1)
        elif tag == "title":
            self.in_title = max(0, self.in_title - 1)

    def handle_data(self, data):
        if not self.skip and data.strip(" \t\n\r\f"):
            (self.title if self.in_title else self.nodes).append(data)


@F.pandas_udf(St.StructType([St.StructField("title", St.StringType()), St.StructField("body_text", St.StringType()), St.StructField("links", St.ArrayType(St.StringType()))]))
def parse_tree(pages: pd.Series) -> pd.DataFrame:
    """Parser-based title, text and links, for malformed markup."""
    rows = []
    for page in pages:
        t = _Tree()
        if isinstance(page, str):
            t.feed(page.split("\x00", 1)[0])
            t.close()
        body = "".join(n + " " for n in t.nodes).translate(str.maketrans("\n\t\r", "   "))
        rows.append(("".join(t.title), body if any(c.isascii() and c.isalnum() for c in body) else "", t.links))
    return pd.DataFrame(rows, columns=["title", "body_text", "links"])
