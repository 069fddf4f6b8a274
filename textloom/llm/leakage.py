"""Evaluation texts leaking into a corpus, by an FM-index per shard.

Each task reads its documents once and turns them into word numbers.  For each block of
test items (words none of them uses are one separator symbol; stretches too short for a
phrase are left out, which loses no match) it builds a suffix array, the Burrows-Wheeler transform and a wavelet matrix
over it, and searches all phrases of the block backwards at once.  Occurrences are located
by walking to sampled suffix positions, and hits of one item merge into spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textloom.llm.common import batch
from textloom.runtime import spread

WORDS = 12
SAMPLE = 16  # every 16th text position is kept
SHARD_SYMBOLS = 1 << 20
ITEMS_AT_ONCE = 5000  # test items per search pass: bounds what each task is sent
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, case ignored."""
    return _WORD.findall(text.lower()) if text else []


class Bits:
    """Bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        self.sums = np.concatenate([[0], np.cumsum(bits, dtype=np.int32)])
        self.zeros = len(bits) - int(self.sums[-1])

    def rank1(self, i: np.ndarray) -> np.ndarray:
        return self.sums[i]


class WaveletMatrix:
    """Rank and access over a sequence of small integers, one bit vector per level."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.depth = max(1, int(sigma - 1).bit_length())
        self.levels = []
        cur = seq
        for level in range(self.depth - 1, -1, -1):
            bit = (cur >> level) & 1
            self.levels.append(Bits(bit))
            cur = np.concatenate([cur[bit == 0], cur[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before position ``i``, element by element."""
        lo, hi = np.zeros_like(i), i.copy()
        for k, v in enumerate(self.levels):
            one = ((symbol >> (self.depth - 1 - k)) & 1).astype(bool)
            l1, h1 = v.rank1(lo), v.rank1(hi)
            lo, hi = np.where(one, v.zeros + l1, lo - l1), np.where(one, v.zeros + h1, hi - h1)
        return hi - lo

    def access(self, i: np.ndarray) -> np.ndarray:
        out, at = np.zeros_like(i), i.copy()
        for v in self.levels:
            r = v.rank1(at)
            one = v.rank1(at + 1) > r
            out = (out << 1) | one
            at = np.where(one, v.zeros + r, at - r)
        return out


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling that sorts only the still undecided suffixes."""
    n = len(seq)
    sa = np.argsort(seq, kind="stable")
    new = np.concatenate([[True], seq[sa[1:]] != seq[sa[:-1]]])
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    span = 1
    while True:
        # positions of sa inside groups of more than one suffix
        single = new & np.append(new[1:], True)
        open_ = np.flatnonzero(~single)
        if not len(open_):
            return sa
        pos = sa[open_]
        nxt = np.where(pos + span < n, rank[np.minimum(pos + span, n - 1)] + 1, 0)
        group = rank[pos]
        order = np.lexsort((nxt, group))
        sa[open_] = pos[order]
        g, x = group[order], nxt[order]
        fresh = np.concatenate([[True], (g[1:] != g[:-1]) | (x[1:] != x[:-1])])
        new[open_] = fresh
        rank[sa[open_]] = open_[np.maximum.accumulate(np.where(fresh, np.arange(len(open_)), 0))]
        span *= 2


class FMIndex:
    """Self-index of one shard; symbol 0 is the end mark, 1 separates."""

    def __init__(self, seq: np.ndarray, sigma: int):
        text = np.append(seq, 0)
        sa = suffix_array(text)
        bwt = text[sa - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.bwt = WaveletMatrix(bwt, sigma)
        kept = sa % SAMPLE == 0
        self.marked = Bits(kept.astype(np.int8))
        self.samples = sa[kept]
        self.n = len(text)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of all rows of ``phrases`` by backward search, together."""
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), self.n, np.int64)
        for c in phrases.T[::-1]:
            lo, hi = self.first[c] + self.bwt.rank(c, lo), self.first[c] + self.bwt.rank(c, hi)
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back until a sampled one."""
        rows, out = rows.copy(), np.full(len(rows), -1, np.int64)
        todo = np.arange(len(rows))
        steps = 0
        while len(todo):
            r = rows[todo]
            before = self.marked.rank1(r)
            hit = self.marked.rank1(r + 1) > before
            out[todo[hit]] = self.samples[before[hit]] + steps
            todo, r = todo[~hit], r[~hit]
            c = self.bwt.access(r)
            rows[todo] = self.first[c] + self.bwt.rank(c, r)
            steps += 1
        return out


class Phrases:
    """The test items' distinct phrases of ``WORDS`` words as word numbers, and their items."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.number: dict[str, int] = {}
        rows: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for item, text in items:
            seq = [self.number.setdefault(w, len(self.number) + 2) for w in words(text)]
            for i in range(len(seq) - WORDS + 1):
                rows.setdefault(tuple(seq[i : i + WORDS]), []).append((item, i))
        self.table = np.array(list(rows), np.int64).reshape(len(rows), WORDS)
        self.owners = list(rows.values())


_HITS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("word_from", pa.int32()), ("word_to", pa.int32())])
HITS_SQL = "doc_id long, item_id long, word_from int, word_to int"


def _flush(phrases: Phrases, seqs: list, docs: list, offsets: list) -> Iterator[pa.RecordBatch]:
    lengths = np.array([len(s) for s in seqs])
    ends = np.cumsum(lengths)
    index = FMIndex(np.concatenate(seqs), len(phrases.number) + 2)
    lo, hi = index.search(phrases.table)
    counts = hi - lo
    which = np.repeat(np.arange(len(counts)), counts)
    rows = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + lo[which]
    at = index.locate(rows)
    run = np.searchsorted(ends, at, side="right")
    where = at - (ends - lengths)[run] + np.array(offsets)[run]
    out = sorted({(docs[r], item, int(w)) for p, r, w in zip(which, run, where) for item, _ in phrases.owners[p]})
    doc, item, start, end = [], [], [], []
    for d, i, w in out:  # hits of one item that touch become one span
        if doc and doc[-1] == d and item[-1] == i and w <= end[-1]:
            end[-1] = w + WORDS
        else:
            doc.append(d), item.append(i), start.append(w), end.append(w + WORDS)
    if doc:
        yield batch(_HITS, doc, item, start, end)


def _search_shard(blocks: list[Phrases], vocabulary: dict[str, int], seqs: list[np.ndarray], docs: list[int]) -> Iterator[pa.RecordBatch]:
    """Hits of all blocks of test items in a shard that was read once; each block sees it in its own word numbers."""
    for phrases in blocks:
        get = phrases.number.get
        numbers = np.array([get(w, 1) for w in vocabulary], np.int64)
        runs, owners, offsets = [], [], []
        for doc, local in zip(docs, seqs):
            seq = numbers[local]
            gaps = np.concatenate([[-1], np.flatnonzero(seq == 1), [len(seq)]])
            for g in np.flatnonzero(np.diff(gaps) > WORDS):
                runs.append(np.append(seq[gaps[g] + 1 : gaps[g + 1]], 1)), owners.append(doc), offsets.append(int(gaps[g] + 1))
        if runs:
            yield from _flush(phrases, runs, owners, offsets)


def searcher(blocks):
    """Search of (doc_id, text) rows for the test items of ``blocks``, a broadcast list of ``Phrases``."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary: dict[str, int] = {}
        seqs, docs, held = [], [], 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = words(text)
                if len(found) < WORDS:
                    continue
                seqs.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in found], np.int32)), docs.append(doc)
                held += len(found)
                if held >= SHARD_SYMBOLS:
                    yield from _search_shard(blocks.value, vocabulary, seqs, docs)
                    vocabulary, seqs, docs, held = {}, [], [], 0
        if seqs:
            yield from _search_shard(blocks.value, vocabulary, seqs, docs)

    return search


def leaks(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """``(doc_id, item_id, word_from, word_to)``: stretches of an item's words inside a document.

    Items are a stated query set, broadcast in blocks of at most ``ITEMS_AT_ONCE``; the
    documents are read and split into words once for all of them.  Null, empty and short
    texts on either side give nothing; equal items are all listed.  Word numbers count
    the document's words from 0, ends excluded.
    """
    docs = spread(documents.select("doc_id", "text").where("text IS NOT NULL AND doc_id IS NOT NULL"))
    blocks, block = [], []

    def add() -> None:
        phrases = Phrases(block)
        if phrases.owners:
            blocks.append(phrases)

    for row in eval_items.select("item_id", "text").where("item_id IS NOT NULL").distinct().toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == ITEMS_AT_ONCE:
            add()
            block = []
    add()
    if not blocks:
        return documents.sparkSession.createDataFrame([], HITS_SQL)
    return docs.mapInArrow(searcher(documents.sparkSession.sparkContext.broadcast(blocks)), HITS_SQL)


def leaked_documents(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    return leaks(documents, eval_items).select("doc_id", "item_id").distinct()
