"""Tokeniser and stemmer as Column functions, with a pure-Python twin for query strings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the 97 stop words of the retrieval contract
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for",
    "from", "in", "is", "it", "of", "on", "the", "to", "with",
    "about", "after", "all", "also", "am", "any", "been", "before",
    "being", "but", "can", "could", "did", "do", "does", "doing",
    "down", "during", "each", "few", "had", "have", "having", "he",
    "her", "here", "hers", "him", "himself", "his", "how", "i",
    "if", "into", "me", "more", "most", "my", "no", "not", "now",
    "or", "other", "our", "out", "over", "own", "same", "she",
    "should", "so", "some", "such", "than", "that", "their", "them",
    "then", "there", "these", "they", "this", "those", "through",
    "under", "up", "very", "was", "we", "were", "what", "when",
    "where", "which", "who", "why", "will", "you", "your",
)

TOKEN = "[A-Za-z0-9]{2,}"

# Suffix rules as anchored expressions, applied in order.  Each reads its input once,
# so the nested expression grows linearly.
_RULES = (
    # -ingly / -ing / -ed with the prefix each needs; a doubled last letter but s and l loses one
    (r"^(?:(?=.{2,}ingly$)|(?=.{3,}ing$)|(?=.{3,}ed$))(.*?)(?:([^sl])\2)?(?:ingly|ing|ed)$", "$1$2"),
    (r"^(.{2,})fully$|^(.{3,})ful$", "$1$2"),
    (r"^(.{2,})ness$", "$1"),
    (r"^(.{2,})ment$", "$1"),
    (r"^(.{2,})ies$", "$1y"),
    (r"^(.{3,})es$|^(.{2,}[^s])s$", "$1$2"),
)


def raw_tokens(text: Column) -> Column:
    """Array of maximal ASCII alphanumeric runs of at least two characters, as written."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def is_stop_word(token: Column) -> Column:
    return token.isin(*STOP_WORDS)


def stem(token: Column) -> Column:
    """Stem of a lower-cased token."""
    for pattern, to in _RULES:
        token = F.regexp_replace(token, pattern, to)
    return token


def tokens(text: Column) -> Column:
    """Array of kept, stemmed tokens in order, duplicates included; null text gives null."""
    lowered = F.transform(raw_tokens(text), lambda t: F.lower(t))
    kept = F.filter(lowered, lambda t: ~is_stop_word(t))
    return F.transform(kept, stem)


def join_tokens(tokens_: Column) -> Column:
    return F.array_join(tokens_, " ")


def snippet(text: Column, length: int = 120) -> Column:
    """First characters of a text, followed by dots."""
    return F.concat(F.substring(text, 1, length), F.lit("..."))


_PY_RULES = tuple((re.compile(p), re.sub(r"\$(\d)", r"\\g<\1>", to)) for p, to in _RULES)


def stem_py(token: str) -> str:
    for pattern, to in _PY_RULES:
        token = pattern.sub(to, token)
    return token


def tokenize_py(text: str) -> list[str]:
    """The same tokens for a string on the driver, as for a query."""
    lowered = (t.lower() for t in re.findall(TOKEN, text))
    return [stem_py(t) for t in lowered if t not in STOP_WORDS]
