"""Wiki markup cleaning as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: namespaces whose pages are no articles
SPECIAL = ("Template:", "Category:", "File:", "Wikipedia:", "Portal:", "Help:")


def _no_templates(text: Column) -> Column:
    """Without what stands between ``{{`` and the next ``}}``; one that is never closed stays.

    The pieces between openers are folded: ``held`` is what follows an opener still open.
    """
    pieces = F.split(text, r"\{\{")
    zero = F.struct(F.element_at(pieces, 1).alias("out"), F.lit("").alias("held"))

    def step(acc: Column, piece: Column) -> Column:
        at = F.locate("}}", piece)
        closed = F.struct(F.concat(acc["out"], F.substring(piece, at + 2, F.length(piece))).alias("out"), F.lit("").alias("held"))
        still = F.struct(acc["out"].alias("out"), F.concat(acc["held"], F.lit("{{"), piece).alias("held"))
        return F.when(at > 0, closed).otherwise(still)

    folded = F.aggregate(F.slice(pieces, F.lit(2), F.size(pieces)), zero, step, lambda acc: F.concat(acc["out"], acc["held"]))
    return F.when(F.contains(text, F.lit("{{")), folded).otherwise(text)


def _link_labels(text: Column) -> Column:
    """Links as what they show: after the first bar if anything follows it, else all of it."""
    tokens = F.regexp_extract_all(text, F.lit(r"\[\[[^\]]+\]\]|[^\[]+|\["), F.lit(0))

    def shown(token: Column) -> Column:
        inner = F.substring(token, F.lit(3), F.length(token) - 4)
        bar = F.locate("|", inner)
        label = F.when((bar > 0) & (bar < F.length(inner)), F.substring(inner, bar + 1, F.length(inner))).otherwise(inner)
        return F.when(token.startswith("[[") & token.endswith("]]"), label).otherwise(token)

    return F.when(F.contains(text, F.lit("[[")), F.array_join(F.transform(tokens, shown), "")).otherwise(text)


def _no_addresses(text: Column) -> Column:
    """Each word up to an address that begins in it."""
    words = F.regexp_extract_all(text, F.lit(r"\S+|\s+"), F.lit(0))

    def cut(word: Column) -> Column:
        at = F.locate("http", word)
        return F.when((at > 0) & (F.length(word) > at + 3), F.substring(word, F.lit(1), at - 1)).otherwise(word)

    return F.when(F.contains(text, F.lit("http")), F.array_join(F.transform(words, cut), "")).otherwise(text)


def _no_headings(line: Column) -> Column:
    """A line without what stands between two runs of equals signs, or within one of four and more."""
    tokens = F.regexp_extract_all(line, F.lit("={2,}|=|[^=]+"), F.lit(0))
    zero = F.struct(F.lit("").alias("out"), F.lit("").alias("run"), F.lit("").alias("held"))

    def step(acc: Column, token: Column) -> Column:
        is_run, open_ = token.startswith("=="), acc["run"] != ""
        state = lambda out, run, held: F.struct(out.alias("out"), run.alias("run"), held.alias("held"))
        none = F.lit("")
        return (
            F.when(is_run & open_, state(acc["out"], none, none)).when(is_run, state(acc["out"], token, none))
            .when(open_, state(acc["out"], acc["run"], F.concat(acc["held"], token))).otherwise(state(F.concat(acc["out"], token), none, none))
        )

    end = lambda acc: F.concat(acc["out"], F.when(F.length(acc["run"]) >= 4, "").otherwise(acc["run"]), acc["held"])
    return F.aggregate(tokens, zero, step, end)


def clean_text(text: Column) -> Column:
    """Text without wiki markup, in single blanks: a lexer and a fold for each kind of markup."""
    plain = _no_addresses(_link_labels(_no_templates(text)))
    bare = F.when(F.contains(plain, F.lit("==")), F.array_join(F.transform(F.split(plain, "\n"), _no_headings), "\n")).otherwise(plain)
    return F.array_join(F.filter(F.split(bare, r"\s+"), lambda word: word != ""), " ")


def is_article(title: Column, text: Column) -> Column:
    """A title and text that are there, no redirect and no special namespace."""
    special = F.lit(False)
    for prefix in SPECIAL:
        special = special | title.startswith(prefix)
    return F.coalesce((title != "") & (text != "") & ~text.startswith("#REDIRECT") & ~special, F.lit(False))
