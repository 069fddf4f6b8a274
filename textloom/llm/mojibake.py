"""Text decoded with the wrong character encoding: find it and restore it.

1. Adjacent character pairs are counted over the whole corpus and scored by their
   information.  The reference distribution is uniform: with the characters' own
   frequencies a pair of two garbage characters that only meet each other would
   score as a strong association.
2. Improbable pairs score positive, probable ones negative; the maximal scoring
   segments (all of them, in linear time) are the suspicious runs.
3. Inverse mappings (encode with the encoding wrongly used, decode with the right
   one) are tried inside those runs only and accepted where they decode and the
   corpus finds the outcome clearly more probable.  A run with replacement
   characters or stranded lead bytes inside words is garbled beyond repair.
4. Every other non-ASCII stretch that strictly decodes as UTF-8 is tested too, against
   a reference counted without any such stretch, so that frequent garbling does not
   pass for normal.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import batch, chunks_of, codes
from textloom.runtime import materialize, spread

SMALLEST = -22.0  # log2 share from which on a pair's count is kept, which bounds them by 2**22; all rarer ones count as UNKNOWN
UNKNOWN = -25.0  # log2 share of the pairs not kept
LIMIT = -15.0  # log2 share of all pairs under which a pair is improbable
RARE = -17.0  # a restored run has mostly pairs above this
PLAIN = -3.0  # score of a pair of two ASCII characters
ENOUGH = 1.0  # score a run needs to be tested at all
GAIN = 3.0  # bits a pair by which runs must be more probable after a mapping between single-byte encodings
SURE = 10.0  # total gain in bits that such a mapping needs
_CHUNK = 1 << 20

# encodings that text is wrongly read as, and encodings that it really had
READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp437", "cp850", "mac_roman", "koi8-r", "cp866", "cp932", "gbk", "iso8859-2", "iso8859-7", "iso8859-5", "cp1254", "iso8859-15", "big5", "euc_jp", "euc_kr")
WRITTEN_AS = ("cp1252", "cp1250", "cp1251", "cp1253", "iso8859-2", "iso8859-7", "koi8-r", "cp850", "mac_roman", "cp866", "iso8859-5")
MULTI = ("cp932", "euc_jp", "gbk", "big5", "euc_kr")


def _sloppy(name: str):
    """Encoder that also takes C1 characters for bytes an encoding leaves undefined."""
    table: dict[int, int] = {}
    for i in range(256):
        try:
            table[ord(bytes([i]).decode(name))] = i
        except (UnicodeDecodeError, TypeError):
            table[i] = i
    return table


_SINGLE = {n: _sloppy(n) for n in READ_AS if n not in MULTI}
_TO = {}
for _n in WRITTEN_AS:
    _TO[_n] = [None] * 256
    for _i in range(256):
        try:
            _TO[_n][_i] = bytes([_i]).decode(_n)
        except UnicodeDecodeError:
            pass


def _encode(run: str, name: str) -> bytes | None:
    table = _SINGLE.get(name)
    try:
        return run.encode(name) if table is None else bytes([table[ord(c)] for c in run])
    except (KeyError, UnicodeEncodeError):
        return None


_STRETCH = re.compile("[^\x00-\x7f]+")
_EDGES = "“”‘’‚„«»‹›–—…¿¡"
# encodings by the characters that stand for the first byte of a UTF-8 sequence; those of several bytes have East Asian ones there
_LEADS: dict[str, list[str]] = {}
for _n, _table in _SINGLE.items():
    for _c, _i in _table.items():
        if 0xC2 <= _i <= 0xF4:
            _LEADS.setdefault(chr(_c), []).append(_n)


def decodings(stretch: str) -> dict[str, str]:
    """Outcomes of all inverse mappings under which a whole non-ASCII stretch strictly is UTF-8."""
    out: dict[str, str] = {}
    for name in [*_LEADS.get(stretch[0], ()), *(MULTI if stretch[0] >= "\u2e80" else ())]:
        raw = _encode(stretch, name)
        if raw is None:
            continue
        try:
            new = raw.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if new != stretch and "\x00" not in new:
            out[name] = new
    return out


class Stretches:
    """Non-ASCII stretches of texts that strictly decode, with what they decode to."""

    def __init__(self):
        self.known: dict[str, tuple[int, int, dict[str, str]] | None] = {}

    def look(self, stretch: str) -> tuple[int, int, dict[str, str]] | None:
        """(from, to, outcomes) in a stretch: as a whole, or without the sound quotes and dashes around it."""
        if stretch in self.known:
            return self.known[stretch]
        lo, hi = 0, len(stretch)
        found = decodings(stretch)
        if not found and (inner := stretch.strip(_EDGES)) and inner != stretch:
            lo = stretch.index(inner)
            hi = lo + len(inner)
            found = decodings(inner)
        if len(self.known) > 200_000:
            self.known.clear()
        self.known[stretch] = out = (lo, hi, found) if found else None
        return out

    def certain(self, text: str) -> str | None:
        """The text undone if all its stretches, three different ones at least, decode under one mapping, which no sound text does."""
        names: set[str] | None = None
        stretches = set(_STRETCH.findall(text))
        for x in stretches if len(stretches) >= 3 else ():
            hit = self.look(x)
            names = set() if hit is None else set(hit[2]) if names is None else names & set(hit[2])
            if not names:
                return None
        if not names:
            return None
        name = min(names, key=READ_AS.index)
        parts, done = [], 0
        for lo, hi, outcomes in self.find(text):
            parts += [text[done:lo], outcomes[name]]
            done = hi
        new = "".join([*parts, text[done:]])
        return self.certain(new) or new

    def find(self, text: str) -> Iterator[tuple[int, int, dict[str, str]]]:
        for m in _STRETCH.finditer(text):
            if m.end() - m.start() > 1 or m.group() >= "\u2e80":
                hit = self.look(m.group())
                if hit is not None:
                    yield m.start() + hit[0], m.start() + hit[1], hit[2]


# letter case is no evidence, so the case of characters under 0x2000 is folded one by one
_FOLD = np.array([ord(chr(i).lower()) if len(chr(i).lower()) == 1 else i for i in range(0x2000)], np.uint32)


def folded(text: str) -> np.ndarray:
    s = codes(text)
    return np.where(s < 0x2000, _FOLD[np.minimum(s, 0x1FFF)], s)


_PLAIN_TEXT = re.compile(r"[A-Za-z0-9 .,;:'\"()!?\n-]+")


def _from_wide(run: str) -> str | None:
    """Plain text whose bytes were read two by two as UTF-16, in a run of at least six such characters."""
    if len(run) >= 6:
        for name in ("utf-16-le", "utf-16-be"):
            try:
                new = run.encode(name, "surrogatepass").decode("ascii")
            except UnicodeDecodeError:
                continue
            if _PLAIN_TEXT.fullmatch(new) and sum(c.isalpha() or c == " " for c in new) >= 0.8 * len(new):
                return new
    return None


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.int64) << 21) | b.astype(np.int64)


_COUNTS = pa.schema([("pair", pa.int64()), ("n", pa.int64()), ("plain", pa.int64())])


class _Counter:
    """Exact counts of keys, gathered from arrays."""

    def __init__(self):
        self.keys, self.counts, self.parts, self.held = np.empty(0, np.int64), np.empty((0, 2), np.int64), [], 0

    def add(self, keys: np.ndarray, column: int) -> None:
        found, n = np.unique(keys, return_counts=True)
        both = np.zeros((len(found), 2), np.int64)
        both[:, column] = n
        self.parts.append((found, both))
        self.held += len(found)
        if self.held > 1_000_000:
            self.sum()

    def sum(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.parts)])
        counts = np.concatenate([self.counts, *(c for _, c in self.parts)])
        self.keys, at = np.unique(keys, return_inverse=True)
        self.counts = np.stack([np.bincount(at, weights=counts[:, i], minlength=len(self.keys)).astype(np.int64) for i in (0, 1)], axis=1)
        self.parts, self.held = [], 0


def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of adjacent pairs with a non-ASCII character, summed per task; pair -1 counts all pairs.

    ``plain`` leaves out the pairs of stretches that strictly decode as UTF-8; texts that
    are certain to be garbled count there as they were.
    """
    table, total = _Counter(), 0
    stretches = Stretches()
    for _, texts in chunks_of(batches, 0, _CHUNK):
        joined = "\n".join(t for t in texts if t)
        s = folded(joined)
        high = s > 127
        at = np.flatnonzero(high[1:] | high[:-1])
        pairs = pair_keys(s[at], s[at + 1])
        table.add(pairs, 0)
        total += len(s)
        kept = np.ones(len(s), bool)
        for lo, hi, _ in stretches.find(joined):
            kept[max(lo - 1, 0) : hi] = False
        table.add(pairs[kept[at]], 1)
        if not kept.all():
            undone = [new for t in texts if t and (new := stretches.certain(t))]
            s = folded("\n".join(undone))
            high = s > 127
            at = np.flatnonzero(high[1:] | high[:-1])
            table.add(pair_keys(s[at], s[at + 1]), 1)
    table.sum()
    yield batch(_COUNTS, np.append(table.keys, -1), np.append(table.counts[:, 0], total), np.append(table.counts[:, 1], total))


@dataclass(frozen=True)
class Model:
    """log2 shares of pairs: sorted ``keys``, ``shares`` over all fields, ``plain`` without strictly decodable stretches; limits of improbable and rare pairs."""

    keys: np.ndarray
    shares: np.ndarray
    plain: np.ndarray
    unknown: float
    limit: float
    rare: float

    def look(self, pairs: np.ndarray, shares: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(pairs), self.unknown, np.float32)
        at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        return np.where(self.keys[at] == pairs, shares[at], np.float32(self.unknown))


def pair_model(fields: DataFrame) -> Model:
    """Shares of the pairs that are not rarer than ``SMALLEST``: at most 2**22 rows reach the driver, whatever the corpus.

    In a small corpus pairs seen up to three times are improbable and unseen ones rare,
    whatever their share.
    """
    counts = materialize(fields.mapInArrow(count_pairs, "pair long, n long, plain long").groupBy("pair").agg(F.sum("n").alias("n"), F.sum("plain").alias("plain")), "pair-counts")
    row = counts.where("pair = -1").first()
    total = max(1, int(row["n"]) if row else 0)
    most = F.greatest("n", "plain")
    kept = counts.where((F.col("pair") >= 0) & (most >= F.lit(2.0**SMALLEST * total))).toPandas().sort_values("pair")
    shares = lambda numbers: np.maximum(np.log2((numbers.to_numpy(float) + 0.5) / total), unknown).astype(np.float32)
    unknown = max(UNKNOWN, float(np.log2(0.5 / total)))
    return Model(kept.pair.to_numpy(np.int64), shares(kept.n), shares(kept.plain), unknown, max(LIMIT, float(np.log2(4 / total))), max(RARE, float(np.log2(1 / total))))


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in linear time.

    Each candidate knows the nearest one before it whose sum before it is lower, so
    that the search back never visits a candidate in between again.
    """
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum up to, nearest lower candidate
    total = 0.0
    for i, s in enumerate(scores):
        total += s
        if s <= 0:
            continue
        start, before, k = i, total - s, len(stack) - 1
        while True:
            while k >= 0 and stack[k][2] >= before:
                k = stack[k][4]
            if k < 0 or stack[k][3] >= total:
                break
            start, before, k, cut = stack[k][0], stack[k][2], stack[k][4], k
            del stack[cut:]
        stack.append((start, i + 1, before, total, k))
    return [(a, b, y - x) for a, b, x, y, _ in stack]


# replacement or C1 characters next to letters or digits: bytes were lost there, nothing can be restored
_NO_TEXT = re.compile("[\ufffd\x80-\x9f]")
_LOST = re.compile("(?<=[^\\W_])[\ufffd\x80-\x9f]+|[\ufffd\x80-\x9f]+(?=[^\\W_])")
_QUOTES = {"“": "”", "‘": "’", "„": "“", "«": "»", '"': '"', "'": "'", "`": "`", "「": "」", "(": ")"}


# Latin letters next to Greek or Cyrillic ones
_MIXED = re.compile("[A-Za-z\u00c0-\u024f][\u0370-\u04ff]|[\u0370-\u04ff][A-Za-z\u00c0-\u024f]")
_INSIDE = re.compile("[A-Za-z][^\x00-\xa0][A-Za-z]|(?:(?![\x00-\xa0])\\w){2}")
_PARTS = re.compile("[^\n\u2e80-\uffef]+|[^\n\x80-\u024f]+")


class Restorer:
    """Finds and undoes wrong decodings in single texts, given a pair model."""

    def __init__(self, model: Model):
        self.model, self.limit, self.rare = model, model.limit, model.rare
        self.stretches = Stretches()
        self.known: dict[str, str | None] = {}
        self.mapped: dict[str, dict[tuple[str, str], tuple[str, float]]] = {}
        self.decoded: dict[tuple[bool, str], str | None] = {}

    def logs(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        s = folded(text)
        high = s > 127
        at = np.flatnonzero(high[1:] | high[:-1])
        return at, self.model.look(pair_keys(s[at], s[at + 1]), self.model.shares)

    def mean(self, text: str) -> float:
        """Mean log2 share of the pairs with a non-ASCII character; plain text counts as probable."""
        logs = self.logs(text)[1]
        return float(logs.mean()) if len(logs) else self.rare / 2

    def runs(self, text: str) -> list[tuple[int, int, float]]:
        """Suspicious runs (from, to, score), widened to whole stretches of non-ASCII characters."""
        at, logs = self.logs(text)
        if not len(at):
            return []
        score = np.minimum(self.limit - logs, 10.0)
        if _NO_TEXT.search(text):  # characters that no text is written with, however often they stand there
            s = codes(text)
            none = (s == 0xFFFD) | ((s >= 0x80) & (s < 0xA0))
            score = np.where(none[at] | none[at + 1], 10.0, score)
        if not (score > 0).any():
            return []
        values, spots, last = [], [], None
        for i, v in zip(at.tolist(), score.tolist()):
            if last is not None and i > last + 1:  # plain pairs in between as one
                values.append(PLAIN * min(i - last - 1, 20)), spots.append(last + 1)
            values.append(v), spots.append(i)
            last = i
        out: list[tuple[int, int, float]] = []
        for a, b, v in maximal_segments(values):
            if v < ENOUGH:
                continue
            lo, hi = spots[a], spots[b - 1] + 2
            while lo > 0 and text[lo - 1] > "\x7f":
                lo -= 1
            while hi < len(text) and text[hi] > "\x7f":
                hi += 1
            if out and lo < out[-1][1]:
                out[-1] = (out[-1][0], max(hi, out[-1][1]), out[-1][2] + v)
            else:
                out.append((lo, hi, v))
        return [part for span in out for part in self.parts(text, *span)]

    @staticmethod
    def parts(text: str, lo: int, hi: int, score: float) -> Iterator[tuple[int, int, float]]:
        """A run cut at line ends and between Latin and East Asian characters, which no one decoding mixes."""
        for m in _PARTS.finditer(text, lo, hi):
            if not m.group().isascii():
                yield m.start(), m.end(), score

    def unmap(self, run: str) -> str | None:
        """The run undone if it is UTF-8 read as something else (perhaps several times over), or null."""
        if run in self.known:
            return self.known[run]
        best, value = _from_wide(run), self.mean(run)
        for name in READ_AS if best is None else ():
            raw = _encode(run, name)
            if raw is None:
                continue
            try:
                new = raw.decode("utf-8")
            except UnicodeDecodeError:
                continue
            if new != run and "\x00" not in new:
                deeper = self.unmap(new)  # each step is shorter, so this ends
                new = new if deeper is None else deeper
                v = self.mean(new)
                if v >= value:
                    best, value = new, v
        if len(self.known) > 200_000:
            self.known.clear()
        self.known[run] = best
        return best

    def mappings(self, run: str) -> dict[tuple[str, str], tuple[str, float]]:
        """Mappings between two encodings that make the run clearly more probable: outcome and gain a pair."""
        if run in self.mapped:
            return self.mapped[run]
        out, seen, old = {}, {}, self.mean(run)
        if old < self.limit and any(c > "\xa0" for c in run):
            for name, table in _SINGLE.items():
                try:
                    raw = [table[ord(c)] for c in run]
                except KeyError:
                    continue
                options = [(right, "".join(chars)) for right, to in _TO.items() if right != name and None not in (chars := [to[i] for i in raw])]
                for right in MULTI:
                    try:
                        options.append((right, bytes(raw).decode(right)))
                    except UnicodeDecodeError:
                        pass
                for right, new in options:
                    if new == run:
                        continue
                    if new not in seen:
                        logs = self.logs(new)[1]
                        odd = any("\x7f" <= c < "\xa0" for c in new) or _MIXED.search(new) is not None or (logs < self.rare).mean() >= 0.34 if len(logs) else True
                        seen[new] = 0.0 if odd else float(logs.mean()) - old
                    if seen[new] >= GAIN:
                        out[name, right] = (new, seen[new])
        if len(self.mapped) > 200_000:
            self.mapped.clear()
        self.mapped[run] = out
        return out

    def remap(self, runs: list[str]) -> list[str | None]:
        """Runs of one field undone by the one mapping between encodings that explains them best.

        Runs that the mapping does not improve stay; together the others must gain
        ``SURE`` bits and change a character inside a word or two that adjoin.
        """
        options = [self.mappings(r) for r in runs]
        total: dict[tuple[str, str], list[float]] = {}
        for run, known in zip(runs, options):
            n = sum(c > "\xa0" for c in run)
            for mapping, (_, gain) in known.items():
                t = total.setdefault(mapping, [0.0, 0])
                t[0] += gain * (n + 1)
                t[1] += _INSIDE.search(run) is not None
        fit = [(t[0], m) for m, t in total.items() if t[0] >= SURE and t[1]]
        if not fit:
            return [None] * len(runs)
        best = max(fit, key=lambda x: (x[0], -list(total).index(x[1])))[1]
        return [known[best][0] if best in known else None for known in options]

    @staticmethod
    def quoted(text: str, lo: int, hi: int) -> bool:
        """A short run that stands alone between quotation marks is an example."""
        while lo < hi and text[lo] in _QUOTES:
            lo += 1
        while hi > lo and text[hi - 1] in _QUOTES.values():
            hi -= 1
        return hi - lo <= 12 and lo > 0 and hi < len(text) and _QUOTES.get(text[lo - 1]) == text[hi]

    def weight(self, text: str) -> float:
        """Mean log2 share in the reference of the pairs with a non-ASCII character."""
        s = folded(text)
        high = s > 127
        at = np.flatnonzero(high[1:] | high[:-1])
        return float(self.model.look(pair_keys(s[at], s[at + 1]), self.model.plain).mean()) if len(at) else self.rare / 2

    def deepest(self, outcomes: dict[str, str]) -> list[str]:
        """The outcomes of a strict decoding and of those nested in it; each step is shorter, so this ends."""
        out, todo = dict.fromkeys(outcomes.values()), list(outcomes.values())
        while todo:
            new = todo.pop()
            for more in decodings(new).values() if _STRETCH.fullmatch(new) else ():
                if more not in out:
                    out[more] = None
                    todo.append(more)
        return list(out)

    @staticmethod
    def replaced(text: str, pieces: list[tuple[int, int, str]]) -> str:
        parts, done = [], 0
        for lo, hi, new in pieces:
            parts += [text[done:lo], new]
            done = hi
        return "".join([*parts, text[done:]]) if parts else text

    def strict(self, text: str) -> list[tuple[int, int, str]]:
        """Stretches that strictly decode to what the reference finds clearly more probable."""
        out = []
        for lo, hi, outcomes in self.stretches.find(text):
            if self.quoted(text, lo, hi):
                continue
            before, after = text[max(lo - 1, 0) : lo], text[hi : hi + 1]
            key = text[max(lo - 1, 0) : hi + 1]
            if (lo > 0, key) not in self.decoded:
                if len(self.decoded) > 200_000:
                    self.decoded.clear()
                options = [(self.weight(before + new + after), new) for new in self.deepest(outcomes)]
                value, new = max(options, key=lambda x: x[0])
                sound = value - self.weight(key) < GAIN or (_MIXED.search(before + new + after) is not None and _MIXED.search(key) is None)
                self.decoded[lo > 0, key] = None if sound else new
            new = self.decoded[lo > 0, key]
            if new is not None:
                out.append((lo, hi, new))
        return out

    def restore(self, text: str | None) -> tuple[int, int, str | None]:
        """(stretches found, stretches restored, text with them restored)."""
        if not text or text.isascii():
            return 0, 0, text
        first = self.strict(text)
        text = self.replaced(text, first)
        spans = [(lo, hi) for lo, hi, _ in self.runs(text) if not self.quoted(text, lo, hi)]
        new: list[str | None] = []
        for lo, hi in spans:
            fixed = self.unmap(text[lo:hi])
            if fixed is None:  # a part of the run may be sound
                pieces = re.split("([\x00-\x7f]+)", text[lo:hi])
                fixes = [self.unmap(p) if p and p[0] > "\x7f" else None for p in pieces]
                if any(f is not None for f in fixes):
                    fixed = "".join(p if f is None else f for p, f in zip(pieces, fixes))
            if fixed is not None and _MIXED.search(fixed) and not _MIXED.search(text, lo, hi):
                fixed = None
            new.append(fixed)
        rest = [i for i, n in enumerate(new) if n is None]
        if rest:
            for i, n in zip(rest, self.remap([text[slice(*spans[i])] for i in rest])):
                new[i] = n
        lost = sum(not self.quoted(text, m.start(), m.end()) and any(lo < m.end() and m.start() < hi for lo, hi in spans) for m in _LOST.finditer(text)) if spans else 0
        then = [(lo, hi, n) for (lo, hi), n in zip(spans, new) if n is not None]
        undone = len(first) + len(then)
        return undone + lost, undone, self.replaced(text, then)


_FIXED = pa.schema([("doc_id", pa.int64()), ("field", pa.string()), ("n_found", pa.int32()), ("n_restored", pa.int32()), ("restored", pa.string())])


def restorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fix = Restorer(model)
        for b in batches:
            ids, rows = b.column(0).to_pylist(), []
            for k, field in ((1, "text"), (2, "title")):
                for i, t in enumerate(b.column(k).to_pylist()):
                    found, undone, new = fix.restore(t)
                    if found:
                        rows.append((ids[i], field, found, undone, new))
            if rows:
                yield batch(_FIXED, *zip(*rows))

    return run


def garbled(documents: DataFrame) -> DataFrame:
    """``(doc_id, field, n_found, n_restored, restored)`` of every garbled ``text`` or ``title``.

    ``restored`` is the whole field with the stretches undone that could be; the
    others stay.  Nulls, empty and pure ASCII fields are sound; rows without a
    ``doc_id`` are left out.  Statistics are
    those of the table given, so an empty table gives no rows.
    """
    docs = spread(documents.select("doc_id", "text", "title").where("doc_id IS NOT NULL"))
    odd = docs.where(F.col("text").rlike("[^\\x00-\\x7F]") | F.col("title").rlike("[^\\x00-\\x7F]"))
    fields = docs.select(F.explode(F.array("text", "title")).alias("t"))
    model = documents.sparkSession.sparkContext.broadcast(pair_model(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from restorer(model.value)(batches)

    return odd.mapInArrow(run, "doc_id long, field string, n_found int, n_restored int, restored string")


def garbled_fields(documents: DataFrame) -> DataFrame:
    return garbled(documents).select("doc_id", "field").distinct()
