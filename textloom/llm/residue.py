"""Template residue, filler, error pages and scripts-required notices.

Documents are read as units: the sentences of their lines, with numbers, paths and
codes masked.  Units that match a trusted pattern are labelled; the labels
spread to near-duplicates and on from those through connected components, found
with a prefix filter on five-word shingles, which misses no pair of the similarity
asked for, and verified by the shingles themselves.  A document is residue where all units of its main
body carry a label, or where a slot was left unfilled or a value unset.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import main_body
from textloom.llm.common import batch, mix, run_hashes
from textloom.runtime import materialize, spread

SIMILARITY = 0.8
SHINGLE = 5
LABELLED = 1 / 3  # share of a page's units with a label from which on it passes labels on
HOSTS = 3  # hosts on which a unit must stand in such pages

# slots as template languages write them, with a name inside
_NAME = r"[A-Za-z][\w.]*"
SLOT = re.compile(
    rf"\{{\{{-?\s*({_NAME})\s*-?\}}\}}|[$#]\{{\s*({_NAME})\s*\}}|<%=?\s*({_NAME})\s*%>|\{{%\s*({_NAME})\s*%\}}|\[\[\s*({_NAME})\s*\]\]|<<\s*({_NAME})\s*>>|@@({_NAME})@@"
    r"|\b__([A-Z][A-Z_]*)__\b|%([A-Z][A-Z_]+)%|\$([A-Z][A-Z_]+)\$|\{([A-Z][A-Z_]+)\}|\[([A-Z][A-Z]+(?:_[A-Z]+)*)\]"
)
# a sentence that explains a slot shows it as an example
EXPLAINS = re.compile(r"\b(?:marker|placeholder|syntax|expands|expand|filling|slots?|is replaced|are replaced|render time|template (?:variable|language))\b", re.I)
UNSET = re.compile(r"\[object \w+\]|\b(?:hello|welcome back|dear|hi),? (?:undefined|null|nan|none)\b|\bnan (?:new|results?|items?|messages?)\b|\$\s?nan\b|\b(?:stock|price|total|name|date|by)\s?: (?:undefined|null|nan|none)\b|\bfor (?:undefined|null|nan)$", re.I)
UNSET_TITLE = re.compile(r"^(?:undefined|null|nan|none|\[object \w+\])(?:\s*(?:[-|:–—]|::)\s.*)?$", re.I)

# fixed patterns: messages of servers, programs and page builders
TRUSTED = re.compile(
    r"^(?:error\s+)?[45]\d\d(?:\s*[-–:]\s|\s+(?:bad|internal|not|forbidden|service|gateway|unauthori[sz]ed|error|too)\b)|\bnot found\b|\bpage not available\b|bad gateway|gateway time-?out|internal server error|service (?:temporarily )?unavailable|(?:access|permission) denied|do not have permission to"
    r"|request blocked|reference number|too many requests|retry in \w+ (?:second|minute)|session has expired|sign in again|down for maintenance|expected back in|error establishing a database|^fatal error\b|^traceback\b|\w+error '"
    r"|page can'?t be found|try the search box|^oops\b|no longer available|has moved or never existed|return to the start page|closed the connection|quote incident|come back later|checking your connection|^ray \w+\W*$"
    r"|nicht gefunden|est introuvable|no existe o fue movida|não (?:existe|foi encontrada)"
    r"|(?:enable|aktivieren sie|requiert|without|activez|active|ative) (?:los )?(?:javascript|scripts)|javascript is disabled|turn it on and reload|needs scripts to run|blocks them|scripts are off|allow scripts|scripting active|^loading\W*$"
    r"|sample text|dummy (?:copy|text)|replace this paragraph|second column here|type something in|short description of your|headline belongs in|^(?:text )+text\W*$",
    re.I,
)
# fixed values: words of mock Latin
LATIN = frozenset(
    "lorem ipsum dolor amet sint aute irure fugiat animo magnum venit excepta vetus elitum duisa curabit nullam labor mollit marena quiseda sitor aliquas ullamo cupida temporam officia proident culpam consequi nostri vellem ponat "
    "sit consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis in reprehenderit voluptate velit esse cillum eu nulla pariatur excepteur occaecat cupidatat non sunt culpa qui deserunt mollit anim id est laborum".split()
)


def _slot_chars(text: str) -> bool:
    return any(c in text for c in "{[<@$%") or "__" in text



def _alternatives(source: str) -> list[str]:
    """The alternatives of a pattern outside all brackets."""
    out, depth, inside, at, i = [], 0, False, 0, 0
    while i < len(source):
        c = source[i]
        if c == "\\":
            i += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and depth == 0:
            out.append(source[at:i])
            at = i + 1
        i += 1
    return [*out, source[at:]]


def _literals(tree) -> set[str]:
    """Strings of which every match of a parsed pattern holds one, the longest such set; empty if there is none."""
    best: set[str] = set()
    run = ""

    def offer(found: set[str]) -> None:
        nonlocal best
        if found and all(found) and (not best or min(map(len, found)) > min(map(len, best))):
            best = found

    for kind, value in [*tree, (None, None)]:
        name = str(kind)
        if name == "LITERAL":
            run += chr(value)
            continue
        offer({run.lower()} if run else set())
        run = ""
        if name == "SUBPATTERN":
            offer(_literals(value[-1]))
        elif name == "BRANCH":
            each = [_literals(x) for x in value[1]]
            offer(set().union(*each) if all(each) else set())
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
            offer(_literals(value[2]))
    return best


class Tries:
    """A pattern with many alternatives, tried only on units that hold a string some alternative needs.

    The strings are read off the pattern and found in a whole text in one pass.
    Alternatives that need no string of three characters or more are tried on every unit.
    """

    def __init__(self, pattern: re.Pattern):
        import ahocorasick

        self.pattern, self.words, bare = pattern, ahocorasick.Automaton(), []
        for source in _alternatives(pattern.pattern):
            needed = _literals(re._parser.parse(source, pattern.flags))
            if needed and min(map(len, needed)) >= 3:
                for w in needed:
                    self.words.add_word(w, "trusted")
            else:
                bare.append(source)
        self.at_start = re.compile("|".join(x for x in bare if x.startswith("^")), pattern.flags) if any(x.startswith("^") for x in bare) else None
        self.anywhere = re.compile("|".join(x for x in bare if not x.startswith("^")), pattern.flags) if any(not x.startswith("^") for x in bare) else None
        for kind, words in (("latin", [w for w in LATIN if len(w) > 3]), ("unset", ["undefined", "null", "nan", "none", "[object"])):
            for w in words:
                self.words.add_word(w, self.words.get(w, "") + kind)
        self.words.make_automaton()

    def places(self, text: str) -> list[tuple[int, str]] | None:
        """(end, kinds) of needed strings in order; null if places in the text and its lower case differ."""
        low = text.lower()
        return list(self.words.iter(low)) if len(low) == len(text) else None

    def found(self, unit: str, kinds: str) -> bool:
        if "trusted" in kinds and self.pattern.search(unit):
            return True
        return (self.at_start is not None and self.at_start.match(unit) is not None) or (self.anywhere is not None and self.anywhere.search(unit) is not None)

    def hits(self, text: str, units: list[tuple[int, str]]) -> set[int]:
        """Numbers of the (place, unit) rows of a text that match."""
        places = self.places(text)
        kinds = lambda at, u: "trusted" if places is None else "".join(k for end, k in places if at <= end < at + len(u))
        return {i for i, (at, u) in enumerate(units) if self.found(u, kinds(at, u))}


_SENTENCE = re.compile(r"([.!?…。！？])(?:(?<![。！？])[^\S\n]+|(?<=[。！？])(?!\n))")  # begins with a set, which the engine looks for fast
_CODE = re.compile(r"/[\w./-]+|\b[^\W\d]*+\d\w*")
_OTHER = re.compile(r"[^\w\s\x1e]+|_+")
_NAMES = re.compile(r"[A-Z](?:(?<=[^\W\d_] .)|(?<=, .))\w*(?: [A-Z]\w*)*")


class _Masks(dict):
    """Words between white space in lower case without punctuation, paths, codes and numbers as ``0``; single blanks inside."""

    def __missing__(self, word: str) -> str:
        if len(self) > 200_000:
            self.clear()
        self[word] = m = " ".join(_OTHER.sub(" ", _CODE.sub("0", word.lower())).split())
        return m


def masked(text: str, masks: _Masks) -> str:
    """Lower case without punctuation, single blanks; paths, codes and numbers as ``0``, as are the names that ``_NAMES`` finds before."""
    out = " ".join(map(masks.__getitem__, text.split()))
    # words of punctuation alone leave nothing
    return " ".join(out.split()) if "  " in out or out[:1] == " " or out[-1:] == " " else out


def mock_latin(unit: str) -> bool:
    words = re.findall(r"[^\W\d_]+", unit.lower())
    return len(words) >= 3 and sum(w in LATIN for w in words) >= 0.8 * len(words)


def has_slot(sentence: str) -> bool:
    """A slot or unset value where words belong; a sentence about slots only shows them."""
    if UNSET.search(sentence):
        return True
    return SLOT.search(sentence) is not None and not EXPLAINS.search(sentence)


def _word_hashes(texts: list[str]) -> np.ndarray:
    out = []
    for lo in range(0, len(texts), 4096):
        symbols = np.frombuffer((" ".join(texts[lo : lo + 4096]) + " ").encode("utf-8", "surrogatepass"), np.uint8)
        out.append(run_hashes(symbols, np.append(0, np.flatnonzero(symbols == 32)[:-1] + 1)))
    return np.concatenate(out)


def simhashes(texts: list[str]) -> np.ndarray:
    """64-bit SimHash of each text over its pairs of adjacent words, the last one with the end."""
    if not texts:
        return np.empty(0, np.int64)
    h = _word_hashes(texts)
    size = np.array([t.count(" ") + 1 for t in texts])
    ends = np.cumsum(size)
    out = np.empty(len(texts), np.uint64)
    for lo in range(0, len(texts), 4096):
        hi = min(len(texts), lo + 4096)
        a, b = ends[lo] - size[lo], ends[hi - 1]
        after = np.append(h[a + 1 : b], 0).astype(np.uint64)
        after[ends[lo:hi] - 1 - a] = 0
        pairs = mix(h[a:b] * np.uint64(3) + after)
        votes = np.unpackbits(pairs.view(np.uint8).reshape(-1, 8), axis=1)
        sums = np.add.reduceat(votes, ends[lo:hi] - size[lo:hi] - a, axis=0, dtype=np.int32)
        out[lo:hi] = np.packbits(2 * sums > size[lo:hi, None], axis=1).reshape(-1).view(np.uint64)
    return out.view(np.int64)


def prefixes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, half of the shingle's hash) of the shingles in each text's prefix; half will do to find candidates.

    Texts of Jaccard similarity ``SIMILARITY`` share all but a fifth of either's n
    shingles at most, so they have one in common among the first n - ceil(0.8 n) + 1
    of both in the order of the hashes.  Texts under ``SHINGLE`` words have none here:
    they are one shingle as a whole, which only an equal text has.
    """
    none = np.empty(0, np.int64), np.empty(0, np.int32)
    if not texts:
        return none
    h = _word_hashes(texts)
    size = np.array([t.count(" ") + 1 for t in texts])
    owner = np.repeat(np.arange(len(texts)), size)
    if len(h) < SHINGLE:
        return none
    m = len(h) - SHINGLE + 1
    w = h[:m].copy()
    for i in range(1, SHINGLE):
        w = mix(w) * np.uint64(3) + h[i : m + i]
    w = mix(w)
    inside = owner[:m] == owner[SHINGLE - 1 :]
    w, owner = w[inside], owner[:m][inside]
    if not len(w):
        return none
    # one word holds text number and hash, which loses no more than the bits of the number
    bits = np.uint64(len(texts).bit_length())
    both = np.sort((owner.astype(np.uint64) << (np.uint64(64) - bits)) | (w >> bits))
    both = both[np.append(True, both[1:] != both[:-1])]
    owner, w = (both >> (np.uint64(64) - bits)).astype(np.int64), both << bits
    n = np.bincount(owner, minlength=len(texts))
    rank = np.arange(len(w)) - (np.cumsum(n) - n)[owner]
    kept = rank < (n - (4 * n + 4) // 5 + 1)[owner]  # in whole numbers: 0.8 n rounded up
    return owner[kept], (w[kept].view(np.int64) >> 32).astype(np.int32)


_PREFIX = pa.schema([("key", pa.int64()), ("v", pa.int32())])


def read_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per unit and prefix shingle of (key, masked) rows."""
    for b in batches:
        keys = b.column(0).to_numpy(zero_copy_only=False)
        owner, v = prefixes(b.column(1).to_pylist())
        yield batch(_PREFIX, keys[owner], v)


_UNITS = pa.schema([("doc_id", pa.int64()), ("line_no", pa.int64()), ("key", pa.int64()), ("slot", pa.bool_()), ("trusted", pa.bool_()), ("masked", pa.string()), ("prefix", pa.list_(pa.int32()))])
_UNITS_SQL = "doc_id long, line_no long, key long, slot boolean, trusted boolean, masked string, prefix array<int>"


def _prefix_lists(column: tuple) -> pa.Array:
    """Prefixes of the masked texts of a column; null texts have none."""
    at = np.array([i for i, t in enumerate(column) if t is not None], np.int64)
    owner, v = prefixes([t for t in column if t is not None])
    ends = np.zeros(len(column) + 1, np.int32)
    np.cumsum(np.bincount(at[owner], minlength=len(column)), out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(v))


def unit_reader(pattern: re.Pattern):
    """Reader of (doc_id, title, text) rows into units; those that match ``pattern`` are trusted.

    The title is line -1 and only looked at for slots.  The masked text and its prefix
    come with its first place in a task.
    """
    digest = xxhash.xxh3_64_intdigest

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        tries, masks = Tries(pattern), _Masks()
        for b in batches:
            rows = []
            for doc, title, text in zip(*(c.to_pylist() for c in b.columns)):
                if title and (UNSET_TITLE.match(title.strip()) or has_slot(title.strip())):
                    rows.append((doc, -1, None, True, False, None))
                if not text:
                    continue
                marked = _SENTENCE.sub("\\1\x1e", text.replace("\x1e", " "))
                slotted = _slot_chars(text)
                places = tries.places(marked)
                upcoming, start = iter(places or ()), 0
                end, kind = next(upcoming, (1 << 62, ""))
                for no, (line, raw) in enumerate(zip(_NAMES.sub("0", marked).split("\n"), marked.split("\n"))):
                    for unit, r in zip(line.split("\x1e"), raw.split("\x1e")):
                        start += len(r) + 1  # where the next unit begins
                        kinds = "" if places is not None else "trusted latin unset"
                        while end < start:
                            kinds += kind
                            end, kind = next(upcoming, (1 << 62, ""))
                        r = r.strip()
                        if not r:
                            continue
                        unit = masked(unit, masks)
                        slot = ("unset" in kinds or (slotted and _slot_chars(r))) and has_slot(r)
                        if not unit:
                            if slot:
                                rows.append((doc, no, None, True, False, None))
                            continue
                        key = digest(unit) - (1 << 63)
                        if key in seen:
                            rows.append((doc, no, key, slot, False, None))
                            continue
                        if len(seen) > 1_000_000:
                            seen.clear()
                        seen.add(key)
                        rows.append((doc, no, key, slot, tries.found(r, kinds) or ("latin" in kinds and mock_latin(r)), unit))
            if rows:
                columns = list(zip(*rows))
                yield batch(_UNITS, *columns, _prefix_lists(columns[5]))

    return read


def _shingles(text: str):
    words = F.split(text, " ")
    n = F.greatest(F.size(words) - (SHINGLE - 1), F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(words, i, SHINGLE), " ")))


def spread_labels(units: DataFrame, texts: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """Keys of all units in a connected component of near-duplicates that holds a trusted one.

    ``units`` is (key, trusted), ``texts`` (key, masked), ``table`` (key, v) their prefixes,
    read from the texts if it is not given.  Grows from the trusted
    units: each round joins the prefixes of what was labelled last with those of the
    unlabelled rest, until a round adds nothing.  Components without a trusted unit
    are never built.
    """
    latest = materialize(units.where("trusted").select("key").distinct(), "labels")
    labels = latest
    if table is None:
        table = materialize(texts.select("key", "masked").mapInArrow(read_prefixes, "key long, v int"), "prefixes")
    while True:
        old = table.join(latest, "key", "left_semi").select(F.col("key").alias("old"), "v").distinct()
        near = materialize(table.join(labels, "key", "left_anti").join(old, "v").select("old", "key").distinct(), "near")
        needed = near.select("key").unionByName(near.select(F.col("old").alias("key"))).distinct()
        known = materialize(texts.join(needed, "key", "left_semi").groupBy("key").agg(F.first("masked").alias("masked")), "near-texts")
        both = near.join(known, "key").join(known.withColumnsRenamed({"key": "old", "masked": "other"}), "old")
        x, y = _shingles("masked"), _shingles("other")
        alike = F.size(F.array_intersect(x, y)) >= F.lit(SIMILARITY) * F.size(F.array_union(x, y))
        latest = materialize(both.where(alike).select("key").distinct(), "labels")
        if latest.isEmpty():
            return labels
        labels = labels.unionByName(latest)


def residue_units(documents: DataFrame, pattern: re.Pattern = TRUSTED) -> tuple[DataFrame, DataFrame]:
    """(units of all documents, keys that carry a residue label by themselves or as a near-duplicate)."""
    docs = spread(documents.select("doc_id", "title", "text").where("doc_id IS NOT NULL"))
    rows = materialize(docs.mapInArrow(unit_reader(pattern), _UNITS_SQL), "units")
    firsts = rows.where("masked IS NOT NULL")
    distinct = materialize(firsts.groupBy("key").agg(F.max("trusted").alias("trusted")), "distinct-units")
    return rows, spread_labels(distinct, firsts.select("key", "masked"), firsts.select("key", F.explode("prefix").alias("v")))


def _passed_on(bodies: DataFrame, labels: DataFrame) -> DataFrame:
    """Keys that get a label from the pages they stand in.

    ``bodies`` is (doc_id, site, key).  A page passes labels on when at least a share
    ``LABELLED`` of its units carry one and all others stand on ``HOSTS`` hosts or more in such
    pages: a message that several hosts show beside known ones.
    """
    marked = bodies.join(labels.withColumn("labelled", F.lit(1)), "key", "left").withColumn("labelled", F.coalesce("labelled", F.lit(0)))
    parts = marked.groupBy("doc_id").agg(F.avg("labelled").alias("share"))
    likely = marked.join(parts.where((F.col("share") >= LABELLED) & (F.col("share") < 1)).select("doc_id"), "doc_id", "left_semi").where("labelled = 0").select("doc_id", "site", "key")
    wide = likely.select("key", "site").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("hosts")).where(F.col("hosts") >= HOSTS).select("key")
    known = likely.join(wide.withColumn("wide", F.lit(True)), "key", "left")
    pages = known.groupBy("doc_id").agg(F.count_if(F.col("wide").isNull()).alias("others")).where("others = 0").select("doc_id")
    return likely.join(pages, "doc_id", "left_semi").select("key").distinct()


def residue_documents(documents: DataFrame, parsed: DataFrame, responses: DataFrame, pattern: re.Pattern = TRUSTED) -> DataFrame:
    """``(doc_id)`` of documents that are template residue, filler, errors or notices.

    The page furniture aside (found together with the parsed pages, which share
    hosts), every unit must be labelled, and one at least; a slot or unset value
    anywhere in text or title is enough.  Null and empty texts and titles are no case.
    Labels start from units that match ``pattern``, spread to near-duplicates, and from page
    to page, round by round, until a round adds none.
    """
    rows, labels = residue_units(documents, pattern)
    labels = materialize(labels.distinct(), "labels")
    slots = rows.where("slot").select("doc_id")
    units = rows.where("line_no >= 0 AND key IS NOT NULL").select("doc_id", "line_no", "key")
    templates = main_body.line_templates(documents, parsed, responses)
    site = templates[0].where("origin = 'documents'").select(F.col("record_id").alias("doc_id"), "site").distinct()
    bodies, latest = None, labels
    while True:
        some = units.join(latest, "key", "left_semi").select("doc_id").distinct()
        if bodies is not None:
            some = some.join(bodies.select("doc_id").distinct(), "doc_id", "left_anti")
        some = materialize(some, "with-label")
        lines = main_body.labelled_lines(*templates, some.withColumnRenamed("doc_id", "record_id")).where("NOT furniture AND NOT heading")
        mine = units.join(some, "doc_id", "left_semi").join(lines.select(F.col("record_id").alias("doc_id"), "line_no"), ["doc_id", "line_no"], "left_semi").select("doc_id", "key")
        new = materialize(mine.join(site, "doc_id").select("doc_id", "site", "key"), "bodies")
        bodies = new if bodies is None else bodies.unionByName(new)
        latest = materialize(_passed_on(bodies, labels), "labels")
        if latest.isEmpty():
            break
        labels = labels.unionByName(latest)
    marked = bodies.join(labels.withColumn("labelled", F.lit(True)), "key", "left")
    pages = marked.groupBy("doc_id").agg(F.bool_and(F.coalesce("labelled", F.lit(False))).alias("all")).where("all").select("doc_id")
    return slots.unionByName(pages).distinct()


def without_residue(documents: DataFrame, parsed: DataFrame, responses: DataFrame) -> DataFrame:
    """The documents that are no residue."""
    return documents.join(residue_documents(documents, parsed, responses), "doc_id", "left_anti")
