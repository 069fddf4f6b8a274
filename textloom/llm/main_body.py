"""Main body of web pages, by equivalence-class template deduction.

A token's role is the token with the one before it inside its line.  A role's
occurrence vector says how often it stands in each page of its host; it is carried
as the number of occurrences and the sum of the hashes of their pages.  Roles of one
host with equal vectors form an equivalence class; classes that are large and
frequent enough are template.  Lines nest classes: a line covered by template roles
is template as a whole, and what is left are the slots that hold the content.  Roles
that are template on several hosts with many pages each are so everywhere, which
serves small hosts.  Prose repeats short phrases, so a wide line is template where
classes with many roles in it, or one with most of its roles, cover it; a long line
also where it stands as a whole on as many pages.  The slots' lines are then bounded by the first and the
last line of running text: unlabelled lines outside, such as links to other
articles under a sidebar heading, belong to the page and not to the article.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import batch, codes, mix, run_hashes, site_of
from textloom.runtime import materialize, spread, tasks

SHORT = 160  # up to here any classes may cover a line; longer ones are compared whole too
WIDE = 96  # longer lines have roles of their own: COVERED of SHORT, so that they hold all lines of a template that has long ones
WIDE_CLASS = 10  # roles in a wide line of a class that covers it, if it has not COVERED of them
GROUP = 1 << 23  # characters of a site's wide lines that are counted as one group
MIN_PAGES = 3  # pages of a host a template role needs
MIN_SHARE = 0.04  # and their share of the host's pages
CLASS_SIZE = 2  # roles of a valid class
COMMON_HOSTS = 2  # hosts on which a role is template from which on it is so everywhere
COMMON_PAGES = 8  # pages of such a host that it needs there
COVERED = 0.6  # share of a line's roles that makes it template
HEAD_COVERED = 0.3  # the same before the running text begins
UNTITLED_COVERED = 0.45  # and there in a page without a title, whose headline is not known

_WORD, _OTHER = re.compile(r"\w"), re.compile(r"[^\w\s]")  # a token is a run of the first or one of the second
_DIGITS = re.compile("[0-9]+")
_ENDS = frozenset(".!?…。！？;")
_CLOSING = "\"'“”’»)]"
_MARKED = re.compile(r"^(?:[-*•–]|\d{1,3}[.)])\s")
# fixed values: how links to other articles are introduced or end
_LINK = re.compile(
    r"^(?:see also|siehe auch|voir aussi|véase también|ver también|veja também|zobacz też|см\. также|δείτε επίσης)\b|^(?:related|read next|read more|more|weiterlesen|mehr dazu|à lire aussi|lea también|más|mais|leia também|czytaj dalej)\s?:"
    r"|»$|\(\d+ comments?\)$",
    re.I,
)
# two sentences on a line, or what messages of programs name: paths, codes, error classes
_MESSAGE = re.compile(r"[.!?] \S|(?:^|\s)/\w+/[\w-]+|\[[0-9a-f]{6,}\]|\b[A-Z]\w+Error\b")
# unfilled slots and unset values are what a broken page has for content
_SLOT = re.compile(r"\{\{.*?\}\}|\$\{.*?\}|#\{.*?\}|<%.*?%>|\{%.*?%\}|\[\[.*?\]\]|<<\w+>>|@@\w+@@|__[A-Z_]+__|%[A-Z_]+%|\$[A-Z_]+\$|\{[A-Z_]+\}|\[[A-Z_]+\]|\[object \w+\]|\bNaN\b|\bundefined\b|, null!|^null$")


def normal(text: str) -> str:
    """Lines in lower case with one blank per run of white space inside and none around them, ``0`` per number."""
    return "\n".join([" ".join(line.split()) for line in _DIGITS.sub("0", text.lower()).split("\n")])


_KINDS = np.full(0x110000, 3, np.uint8)  # of characters: 0 white space, 1 of a word, 2 other, 3 not looked up yet


def _kinds(symbols: np.ndarray) -> np.ndarray:
    kinds = _KINDS[symbols]
    if (kinds == 3).any():
        for c in np.unique(symbols[kinds == 3]).tolist():
            _KINDS[c] = 1 if _WORD.match(chr(c)) else 2 if _OTHER.match(chr(c)) else 0
        kinds = _KINDS[symbols]
    return kinds


def roles_of(norms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of (token before, token) of normalised lines, their ends included, and how many each line has."""
    roles, sizes, lo, held = [], [], 0, 0
    for i, norm in enumerate(norms):
        held += len(norm)
        if held < 1 << 20 and i + 1 < len(norms):
            continue
        part = norms[lo : i + 1]
        symbols = codes("\x03".join(part) + "\x03")
        kinds = _kinds(symbols)
        word = kinds == 1
        first = kinds > 0
        first[1:] &= ~(word[1:] & word[:-1])
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
        sizes.append(np.diff(np.searchsorted(np.flatnonzero(first), ends), prepend=0))
        first[0] = True
        starts = np.flatnonzero(first)
        now = run_hashes(np.where(kinds > 0, symbols, 0), starts)
        if kinds[0] == 0:
            now = now[1:]
        before = np.roll(now, 1)  # a line begins after the end of another one
        roles.append(mix(before * np.uint64(0x9E3779B97F4A7C15) + now).view(np.int64))
        lo, held = i + 1, 0
    return np.concatenate(roles), np.concatenate(sizes)


def _distinct(roles: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(role, line) pairs once each, by role; the lines are in order."""
    order = np.argsort(roles, kind="stable")
    roles, line = roles[order], line[order]
    new = np.ones(len(roles), bool)
    new[1:] = (roles[1:] != roles[:-1]) | (line[1:] != line[:-1])
    return roles[new], line[new]


def _lists(roles: np.ndarray, line: np.ndarray, lines: int) -> pa.Array:
    """A list of roles for each of ``lines`` lines."""
    ends = np.zeros(lines + 1, np.int32)
    np.cumsum(np.bincount(line, minlength=lines), out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(roles[np.argsort(line, kind="stable")]))


_ROWS = pa.schema([
    ("origin", pa.string()), ("record_id", pa.int64()), ("site", pa.int64()), ("line_no", pa.int32()), ("key", pa.int64()),
    ("content", pa.bool_()), ("heading", pa.bool_()), ("link", pa.bool_()), ("short", pa.bool_()), ("line", pa.string()),
])
_ROWS_SQL = "origin string, record_id long, site long, line_no int, key long, content boolean, heading boolean, link boolean, short boolean, line string"


def read_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per non-blank line of (origin, record_id, site, title, text).

    Normalised text comes with every wide line, of others with their first place in a
    task; where it comes again changes nothing.
    ``content`` marks running text, messages, marked list items and unset values; ``heading``
    a line that begins the title (null without a title), ``link`` breadcrumbs and
    links to other articles.
    """
    seen: set[tuple[int, int]] = set()
    for b in batches:
        rows = []
        for origin, rid, site, title, text in zip(*(c.to_pylist() for c in b.columns)):
            head = normal(title.replace("\n", " ")) if title else ""
            slots = any(c in text for c in "{[<@$%_") or "NaN" in text or "undefined" in text or "null" in text
            for no, (line, n) in enumerate(zip(text.split("\n"), normal(text).split("\n"))):
                if not n:
                    continue
                key = xxhash.xxh3_64_intdigest(n) - (1 << 63)
                short = len(n) <= SHORT
                text_of = n
                if len(n) <= WIDE:
                    if (site, key) in seen:
                        text_of = None
                    elif len(seen) > 500_000:
                        seen.clear()
                    seen.add((site, key))
                stripped = line.strip()
                ends = len(n) >= 12 and stripped.rstrip(_CLOSING)[-1:] in _ENDS
                content = len(n) >= 110 or ends or _MESSAGE.search(stripped) is not None or _MARKED.match(stripped) is not None or (slots and _SLOT.search(line) is not None)
                heading = len(n) >= 4 and head.startswith(n) if head else None
                rows.append((origin, rid, site, no, key, content, heading, " > " in stripped or (short and not heading and _LINK.search(stripped) is not None), short, text_of))
        if rows:
            yield batch(_ROWS, *zip(*rows))


_DISTINCT = pa.schema([("site", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("y", pa.int64()), ("roles", pa.list_(pa.int64()))])


def read_roles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(site, key, n, y, line) rows with the line's distinct roles in place of its text."""
    for b in batches:
        if b.num_rows:
            roles, sizes = roles_of(b.column(4).to_pylist())
            yield batch(_DISTINCT, *b.columns[:4], _lists(*_distinct(roles, np.repeat(np.arange(len(sizes)), sizes)), len(sizes)))


_WIDE = pa.schema([("site", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("y", pa.int64()), ("n_roles", pa.int64()), ("roles", pa.list_(pa.int64()))])
_WIDE_SQL = "site long, key long, n long, y long, n_roles long, roles array<long>"


def _count_roles(site: int, whole: bool, lines: dict[int, list]) -> Iterator[pa.RecordBatch]:
    """The rows of ``read_wide`` for one group."""
    roles, sizes = roles_of([x[2] for x in lines.values()])
    roles, line = _distinct(roles, np.repeat(np.arange(len(sizes)), sizes))
    n_roles = np.bincount(line, minlength=len(sizes))
    n = np.array([x[0] for x in lines.values()], np.int64)
    y = np.array([x[1] & ((1 << 64) - 1) for x in lines.values()], np.uint64)
    starts = np.flatnonzero(np.r_[True, roles[1:] != roles[:-1]])
    rn, ry = np.add.reduceat(n[line], starts), np.add.reduceat(y[line], starts)
    keep = np.ones(len(starts), bool)
    if whole:  # the counts are final
        keep = rn >= MIN_PAGES
        _, which, members = np.unique(mix(ry + rn.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
        keep &= np.bincount(which, weights=keep, minlength=len(members))[which] >= CLASS_SIZE
    kept = np.repeat(keep, np.diff(np.r_[starts, len(roles)]))
    found = np.flatnonzero(np.bincount(line, weights=kept, minlength=len(sizes)) >= COVERED * n_roles)
    place = np.full(len(sizes), -1)
    place[found] = np.arange(len(found))
    kept &= place[line] >= 0
    keys = np.array(list(lines), np.int64)
    vectors = int(keep.sum())
    if vectors:
        yield batch(_WIDE, np.full(vectors, site), roles[starts][keep], rn[keep], ry[keep].view(np.int64), np.zeros(vectors, np.int64), [None] * vectors)
    if len(found):
        yield batch(_WIDE, np.full(len(found), site), keys[found], n[found], y[found].view(np.int64), n_roles[found], _lists(roles[kept], place[line[kept]], len(found)))


def read_wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrence vectors of the roles of (site, part, parts, key, page, line) rows, a group being a site's part, and lines that they may cover.

    A role comes as (site, role, n, y, 0, null), a line as (site, key, n, y, n_roles,
    roles).  Where a group is all of a site, roles that are in no class and lines that
    cannot be covered are left out.
    """
    at, lines = None, {}
    for b in batches:
        for site, part, parts, key, page, norm in zip(*(c.to_pylist() for c in b.columns)):
            if (site, part, parts) != at:
                if lines:
                    yield from _count_roles(at[0], at[2] == 1, lines)
                at, lines = (site, part, parts), {}
            if (e := lines.get(key)) is None:
                lines[key] = [1, page, norm]
            else:
                e[0] += 1
                e[1] += page
    if lines:
        yield from _count_roles(at[0], at[2] == 1, lines)


_COMMON = pa.schema([("site", pa.int64()), ("key", pa.int64()), ("n_roles", pa.int64()), ("roles", pa.list_(pa.int64()))])
_BITS = 24  # of a filter before the exact comparison


def read_common(words: np.ndarray):
    """(site, key, line) rows to (site, key, n_roles, roles) of the lines that ``words``, a filter of roles, may cover."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            roles, sizes = roles_of(b.column(2).to_pylist())
            roles, line = _distinct(roles, np.repeat(np.arange(len(sizes)), sizes))
            n_roles = np.bincount(line, minlength=len(sizes))
            bit = roles & ((1 << _BITS) - 1)
            hit = (words[bit >> 5] >> (bit & 31)) & 1 == 1
            found = np.flatnonzero(np.bincount(line, weights=hit, minlength=len(sizes)) >= COVERED * n_roles)
            place = np.full(len(sizes), -1)
            place[found] = np.arange(len(found))
            hit &= place[line] >= 0
            if len(found):
                rows = pa.array(found)
                yield batch(_COMMON, b.column(0).take(rows), b.column(1).take(rows), n_roles[found], _lists(roles[hit], place[line[hit]], len(found)))

    return read


def _wrapping_sum(col: str):
    """Sum of longs modulo 2**64, from the sums of their halves, as a plain sum fails where it overflows."""
    low, high = F.sum(F.col(col).bitwiseAND(0xFFFFFFFF)), F.sum(F.shiftrightunsigned(col, 32))
    return F.shiftleft(high + F.shiftrightunsigned(low, 32), 32).bitwiseOR(low.bitwiseAND(0xFFFFFFFF))


def _wide_templates(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """``(site, key)`` of wide lines that their own roles show as template."""
    wide = lines.where(F.length("line") > WIDE).select("site", "key", F.xxhash64("origin", "record_id").alias("page"), "line")
    # a row for GROUP characters at most
    large = wide.groupBy("site").agg(F.ceil(F.sum(F.length("line")) / F.lit(GROUP)).cast("int").alias("parts")).where("parts > 1")
    parted = wide.join(F.broadcast(materialize(large, "large-sites")), "site", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    parted = parted.select("site", F.expr("cast(pmod(key, parts) as int)").alias("part"), "parts", "key", "page", "line")
    placed = parted.repartition(tasks(lines), "site", "part").sortWithinPartitions("site", "part")
    counted = materialize(placed.mapInArrow(read_wide, _WIDE_SQL), "wide-roles")
    vectors = counted.where("n_roles = 0").groupBy("site", F.col("key").alias("role")).agg(F.sum("n").alias("rn"), _wrapping_sum("y").alias("ry")).where(F.col("rn") >= MIN_PAGES)
    often = materialize(vectors.join(pages, "site").where(F.col("rn") >= F.col("pages") * F.lit(MIN_SHARE)).select("site", "role", "rn", "ry"), "frequent-wide-roles")
    classes = often.groupBy("site", "rn", "ry").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= CLASS_SIZE)
    own = often.join(classes, ["site", "rn", "ry"], "left_semi")
    each = counted.where("n_roles > 0").select("site", "key", "n_roles", F.explode("roles").alias("role"))
    hits = materialize(each.join(own.hint("merge"), ["site", "role"]).select("site", "key", "n_roles", "role", "rn", "ry"), "wide-hits")
    covers = F.col("c") >= F.col("n_roles") * F.lit(COVERED)
    inside = hits.groupBy("site", "key", "n_roles", "rn", "ry").agg(F.count(F.lit(1)).alias("c")).where((F.col("c") >= WIDE_CLASS) | covers)
    near = inside.groupBy("site", "key", "n_roles").agg(F.sum("c").alias("c")).where(covers)
    near = materialize(inside.join(near, ["site", "key"], "left_semi"), "wide-lines")
    # the lines that a class covers stand on as many pages themselves
    on = lines.select("site", "key", "origin", "record_id").join(near.select("site", "key", "rn", "ry"), ["site", "key"])
    valid = on.groupBy("site", "rn", "ry").agg(F.countDistinct("origin", "record_id").alias("n")).where(F.col("n") >= MIN_PAGES)
    sure = materialize(near.join(valid, ["site", "rn", "ry"], "left_semi"), "wide-classes")
    template = sure.groupBy("site", "key", "n_roles").agg(F.sum("c").alias("c")).where(covers).select("site", "key")
    found = hits.where(F.col("rn") >= COMMON_PAGES).join(sure.join(template, ["site", "key"], "left_semi"), ["site", "key", "rn", "ry"], "left_semi")
    shown = found.groupBy("role").agg(F.countDistinct("site").alias("hosts"))
    common = materialize(shown.where(F.col("hosts") >= COMMON_HOSTS).select("role"), "common-wide-roles")
    # a bit for a role in at most 2 ** _BITS
    bit = F.col("role").bitwiseAND((1 << _BITS) - 1)
    filled = common.groupBy(F.shiftright(bit, 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(role & 31 as int))")).alias("bits")).toArrow()
    if not filled.num_rows:
        return template
    words = np.zeros(1 << (_BITS - 5), np.int64)
    words[filled["word"].to_numpy()] = filled["bits"].to_numpy()
    near = wide.select("site", "key", "line").mapInArrow(read_common(words), "site long, key long, n_roles long, roles array<long>")
    near = near.select("site", "key", "n_roles", F.explode("roles").alias("role")).join(common, "role", "left_semi")
    near = near.groupBy("site", "key", "n_roles").agg(F.countDistinct("role").alias("c")).where(covers)
    return template.unionByName(near.select("site", "key")).distinct()


def _template_coverage(lines: DataFrame) -> DataFrame:
    """``(site, key, covered)``: share of template roles of every distinct line that has any, 1 for a wide line found by its own."""
    page = F.xxhash64("origin", "record_id")
    pages = lines.groupBy("site").agg(F.countDistinct("origin", "record_id").alias("pages"))
    # a page counts as often as the role stands in it: an XOR would drop even counts
    distinct = lines.where("short").withColumn("page", page).groupBy("site", "key").agg(F.count(F.lit(1)).alias("n"), _wrapping_sum("page").alias("y"), F.first("line", ignorenulls=True).alias("line"))
    distinct = materialize(distinct.mapInArrow(read_roles, "site long, key long, n long, y long, roles array<long>"), "line-roles")
    each = distinct.select("site", "key", "n", "y", F.size("roles").alias("n_roles"), F.explode("roles").alias("role"))
    # vectors combine before their shuffle; a role that many lines of a host have is split by the join's re-planning
    vectors = each.groupBy("site", "role").agg(F.sum("n").alias("rn"), _wrapping_sum("y").alias("ry")).where(F.col("rn") >= MIN_PAGES)
    often = materialize(vectors.join(pages, "site").where(F.col("rn") >= F.col("pages") * F.lit(MIN_SHARE)).select("site", "role", "rn", "ry"), "frequent-roles")
    classes = often.groupBy("site", "rn", "ry").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= CLASS_SIZE)
    own = materialize(often.join(classes, ["site", "rn", "ry"], "left_semi").select("site", "role", "rn"), "template-roles")
    # sorted and merged at any size: only so can a hot role of a hot host be split
    valid = each.select("site", "key", "role", "n_roles").join(own.hint("merge"), ["site", "role"])
    hosts = own.where(F.col("rn") >= COMMON_PAGES).groupBy("role").agg(F.count(F.lit(1)).alias("hosts"))
    common = materialize(hosts.where(F.col("hosts") >= COMMON_HOSTS).select("role"), "common-roles")
    shared = each.join(common, "role", "left_semi").select("site", "key", "role", "n_roles")
    hits = valid.select("site", "key", "role", "n_roles").unionByName(shared).groupBy("site", "key", "n_roles").agg(F.countDistinct("role").alias("hits"))
    # long lines by their pages, and everywhere where several hosts have them so
    long = materialize(lines.where("NOT short").groupBy("site", "key").agg(F.countDistinct("origin", "record_id").alias("n")), "long-lines")
    repeated = long.where(F.col("n") >= MIN_PAGES).join(pages, "site").where(F.col("n") >= F.col("pages") * F.lit(MIN_SHARE)).select("site", "key", "n")
    known = repeated.where(F.col("n") >= COMMON_PAGES).groupBy("key").agg(F.count(F.lit(1)).alias("hosts")).where(F.col("hosts") >= COMMON_HOSTS)
    whole = repeated.select("site", "key").unionByName(long.join(known, "key", "left_semi").select("site", "key")).unionByName(_wide_templates(lines, pages))
    covered = hits.select("site", "key", (F.col("hits") / F.col("n_roles")).alias("covered"))
    return covered.unionByName(whole.withColumn("covered", F.lit(1.0))).groupBy("site", "key").agg(F.max("covered").alias("covered"))


def page_lines(documents: DataFrame, parsed: DataFrame, responses: DataFrame) -> DataFrame:
    """(origin, record_id, site, title, text) of both tables; a repeated row of a record counts once."""
    docs = documents.select(F.lit("documents").alias("origin"), F.col("doc_id").alias("record_id"), F.xxhash64(site_of(F.col("url"), F.col("source"))).alias("site"), "title", "text")
    hosts = responses.groupBy("response_id").agg(F.max(site_of(F.coalesce("final_url", "url"), F.lit(None).cast("string"))).alias("host"))
    once = parsed.groupBy("response_id").agg(F.max(F.struct("body_text", "title")).alias("p"))
    pages = once.join(hosts, "response_id", "left")
    pages = pages.select(F.lit("parsed_documents").alias("origin"), F.col("response_id").alias("record_id"), F.xxhash64("host").alias("site"), F.col("p.title").alias("title"), F.col("p.body_text").alias("text"))
    return docs.unionByName(pages).where("text IS NOT NULL AND record_id IS NOT NULL")


def line_templates(documents: DataFrame, parsed: DataFrame, responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines of all pages, template cover of every distinct line), both stored."""
    rows = materialize(spread(page_lines(documents, parsed, responses)).mapInArrow(read_lines, _ROWS_SQL), "page-lines")
    return rows, materialize(_template_coverage(rows), "coverage")


def labelled_lines(rows: DataFrame, covered: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """``(origin, record_id, line_no, furniture, heading)`` for every non-blank line of ``line_templates``.

    With ``only`` (record_id) just those documents are labelled, by the templates of all.
    """
    if only is not None:
        rows = rows.where("origin = 'documents'").join(only, "record_id", "left_semi")
    marked = rows.join(covered, ["site", "key"], "left").withColumn("covered", F.coalesce("covered", F.lit(0.0)))
    template = F.col("covered") >= COVERED
    body = F.col("content") & ~template & ~F.col("link")
    record = Window.partitionBy("origin", "record_id")  # the lines of one page
    at = F.when(body, F.col("line_no"))
    # a page without running text has its first unlabelled line for content
    plain = ~body & ~template & ~F.col("link") & ~F.coalesce("heading", F.lit(False)) & (F.col("covered") < HEAD_COVERED)
    core = F.min(F.when(plain, F.col("line_no"))).over(record)
    zones = marked.withColumn("first", F.coalesce(F.min(at).over(record), core)).withColumn("last", F.coalesce(F.max(at).over(record), core))
    heading = F.coalesce("heading", F.lit(False))
    likely = F.col("covered") >= F.when(F.col("heading").isNull(), UNTITLED_COVERED).otherwise(HEAD_COVERED)
    # before the running text, or in a page without any
    head = F.coalesce(F.col("line_no") < F.col("first"), F.lit(True)) & likely
    tail = F.coalesce(F.col("line_no") > F.col("last"), F.lit(False))
    furniture = template | F.col("link") | ((head | tail) & ~heading)
    return zones.select("origin", "record_id", F.col("line_no").cast("long").alias("line_no"), furniture.alias("furniture"), heading.alias("heading"))


def furniture_lines(documents: DataFrame, parsed: DataFrame, responses: DataFrame) -> DataFrame:
    """``(origin, record_id, line_no)`` of every non-blank line that is not main body.

    Null and empty texts give nothing; repeated rows of a record count once (of
    different ones the greatest text holds); records without a host form one host.
    Line numbers count all pieces between line feeds.
    """
    return labelled_lines(*line_templates(documents, parsed, responses)).where("furniture").select("origin", "record_id", "line_no").distinct()


def main_bodies(documents: DataFrame, parsed: DataFrame, responses: DataFrame) -> DataFrame:
    """``(origin, record_id, body)``: the main body of each page with text; null if nothing is left."""
    gone = furniture_lines(documents, parsed, responses).groupBy("origin", "record_id").agg(F.collect_set("line_no").alias("gone"))  # lines of one page
    pages = page_lines(documents, parsed, responses).join(gone, ["origin", "record_id"], "left")
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.coalesce(F.array_contains("gone", i.cast("long")), F.lit(False)))
    body = F.array_join(kept, "\n")
    return pages.select("origin", "record_id", F.when(F.trim(F.translate(body, "\n\r\t", "   ")) != "", body).alias("body"))
