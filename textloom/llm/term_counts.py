"""Frequency of every distinct term by burst-trie counting.

Each task counts its rows in a compact trie, so a hot term is one counter of each task
however many rows it has, and hands its trie on as subtrees.  Terms are routed by
adaptive prefixes: a prefix with more than its share of the tasks' entries is burst into
longer ones.  Matching subtrees of all tasks meet at their route and are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import batch
from textloom.plans.postings_skew import clean_term
from textloom.runtime import materialize, spread, tasks

CONTAINER = 64  # entries of a container before it bursts
DEPTH = 64  # characters below which containers don't burst any more
SUBTREE = 512  # entries of a subtree handed on as one row, at most
HELD = 300_000  # entries a task holds before it hands its trie on


class BurstTrie:
    """Counters per term: containers of suffixes that burst into a node when full.

    ``add(term, *counts)`` adds to the term's counters; ``items()`` yields terms in
    order.  The empty term is a counter of the root.
    """

    __slots__ = ("children", "depth", "here", "limit")

    def __init__(self, limit: int = CONTAINER, depth: int = 0):
        self.children: dict[str, BurstTrie | dict] = {}
        self.here: list[int] | None = None
        self.limit = limit
        self.depth = depth

    def add(self, term: str, *counts: int) -> None:
        node, at = self, 0
        while at < len(term):
            child = node.children.get(term[at])
            if child is None:
                node.children[term[at]] = {term[at + 1 :]: list(counts)}
                return
            if type(child) is dict:
                rest = term[at + 1 :]
                held = child.get(rest)
                if held is None:
                    child[rest] = list(counts)
                    if len(child) > node.limit and node.depth < DEPTH:
                        node.children[term[at]] = burst = BurstTrie(node.limit, node.depth + 1)
                        for suffix, c in child.items():
                            burst.add(suffix, *c)
                else:
                    for i, c in enumerate(counts):
                        held[i] += c
                return
            node, at = child, at + 1
        if node.here is None:
            node.here = list(counts)
        else:
            for i, c in enumerate(counts):
                node.here[i] += c

    def items(self, prefix: str = "") -> Iterator[tuple[str, list[int]]]:
        if self.here is not None:
            yield prefix, self.here
        for ch in sorted(self.children):
            child = self.children[ch]
            if type(child) is dict:
                for suffix in sorted(child):
                    yield prefix + ch + suffix, child[suffix]
            else:
                yield from child.items(prefix + ch)

    def subtrees(self, limit: int) -> list[tuple[str, list[tuple[str, list[int]]]]]:
        """(prefix, entries below it) of the largest subtrees of at most ``limit`` entries; containers stay whole."""
        out: list[tuple[str, list[tuple[str, list[int]]]]] = []
        rest = self._cut("", limit, out)
        if rest:
            out.append(("", rest))
        return out

    def _cut(self, prefix: str, limit: int, out: list) -> list[tuple[str, list[int]]] | None:
        parts, n, whole = [], 0, True
        if self.here is not None:
            parts.append(("", [("", self.here)]))
            n = 1
        for ch in sorted(self.children):
            child = self.children[ch]
            entries = sorted(child.items()) if type(child) is dict else child._cut(prefix + ch, limit, out)
            if entries is None:
                whole = False
            else:
                parts.append((ch, entries))
                n += len(entries)
        if whole and n <= limit:
            return [(ch + suffix, c) for ch, entries in parts for suffix, c in entries]
        out += [(prefix + ch, entries) for ch, entries in parts]
        return None


def current_postings(postings: DataFrame) -> DataFrame:
    """One row per (term, doc_id): the frequency written last.

    Rows with ``term_freq`` below 1, no ``doc_id`` or a blank term do not count;
    of equal times the larger frequency holds.  The grouping combines before its
    shuffle and splits a hot term by document.
    """
    rows = postings.select(clean_term(F.col("term")).alias("term"), "doc_id", "term_freq", "indexed_at")
    rows = rows.where((F.col("term_freq") >= 1) & F.col("doc_id").isNotNull() & (F.col("term") != ""))
    last = F.max(F.struct("indexed_at", "term_freq")).getField("term_freq")
    return rows.groupBy("term", "doc_id").agg(last.alias("tf"))


_LISTS = [("suffixes", pa.list_(pa.string())), ("tfs", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64()))]
_SUBTREES = pa.schema([("prefix", pa.string()), ("n", pa.int64()), *_LISTS])
_SUBTREES_SQL = "prefix string, n long, suffixes array<string>, tfs array<long>, docs array<long>"


def count_in_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Subtrees of the burst trie that counts a task's (term, tf) rows."""

    def handed_on(trie: BurstTrie) -> pa.RecordBatch:
        parts = trie.subtrees(SUBTREE)
        column = lambda f: [[f(x) for x in entries] for _, entries in parts]
        return batch(_SUBTREES, [p for p, _ in parts], [len(e) for _, e in parts], column(lambda x: x[0]), column(lambda x: x[1][0]), column(lambda x: x[1][1]))

    trie, held = BurstTrie(), 0
    for b in batches:
        for term, tf in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            trie.add(term, tf, 1)
        held += b.num_rows
        if held >= HELD:
            held = sum(1 for _ in trie.items())
            if held >= HELD:
                yield handed_on(trie)
                trie, held = BurstTrie(), 0
    yield handed_on(trie)


def large_prefixes(subtrees: DataFrame, share: int) -> set[str]:
    """Prefixes with more than ``share`` entries: a node of the routing trie that bursts.

    At most entries / share of them a level reach the driver and at most ``DEPTH`` levels count.
    Entries of a subtree count for its prefix and all prefixes of that.
    """
    above = F.transform(F.sequence(F.lit(0), F.least(F.length("prefix"), F.lit(DEPTH))), lambda k: F.substring(F.col("prefix"), F.lit(1), k))
    loads = subtrees.select(F.explode(above).alias("p"), "n").groupBy("p").agg(F.sum("n").alias("n"))
    return {r["p"] for r in loads.where(F.col("n") > share).collect()}


_ROUTED = pa.schema([("route", pa.int64()), ("prefix", pa.string()), *_LISTS])
_ROUTED_SQL = "route long, prefix string, suffixes array<string>, tfs array<long>, docs array<long>"


def router(large):
    """Subtrees with their routes; one that reaches over several routes is cut.  ``large`` is a broadcast set."""

    def route_of(term: str, big: set[str]) -> str:
        k = 0
        while k < len(term) and term[:k] in big:
            k += 1
        return term[:k]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        big = large.value
        for b in batches:
            rows = []
            for prefix, _, suffixes, tfs, docs in zip(*(c.to_pylist() for c in b.columns)):
                if prefix not in big:
                    rows.append((route_of(prefix, big), prefix, suffixes, tfs, docs))
                    continue
                parts: dict[str, tuple[list, list, list]] = {}
                for suffix, tf, n in zip(suffixes, tfs, docs):
                    part = parts.setdefault(route_of(prefix + suffix, big), ([], [], []))
                    part[0].append(suffix), part[1].append(tf), part[2].append(n)
                rows += [(r, prefix, *part) for r, part in parts.items()]
            if rows:
                names, *rest = zip(*rows)
                yield batch(_ROUTED, [xxhash.xxh3_64_intdigest(r) - (1 << 63) for r in names], *(list(c) for c in rest))

    return route


_COUNTED = "term string, total_freq long, n_docs long"
_SCHEMA = pa.schema([("term", pa.string()), ("total_freq", pa.int64()), ("n_docs", pa.int64())])


def merge_subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counters of all terms from rows that come sorted by route; a task holds the trie of one route."""

    def counted(trie: BurstTrie) -> pa.RecordBatch:
        items = list(trie.items())
        return batch(_SCHEMA, [t for t, _ in items], [c[0] for _, c in items], [c[1] for _, c in items])

    trie, last = BurstTrie(), None
    for b in batches:
        for route, prefix, suffixes, tfs, docs in zip(*(c.to_pylist() for c in b.columns)):
            if last is not None and route != last:
                yield counted(trie)
                trie = BurstTrie()
            last = route
            for suffix, tf, n in zip(suffixes, tfs, docs):
                trie.add(prefix + suffix, tf, n)
    if last is not None:
        yield counted(trie)


def term_counts(postings: DataFrame, rare_below: int = 3, common_share: float = 0.2) -> DataFrame:
    """``(term, total_freq, n_docs, mark)`` for every distinct term.

    ``mark`` is ``rare`` (fewer documents than ``rare_below``), ``common`` (at least
    ``common_share`` of all distinct documents; a term that is both is ``rare``) or
    null.  Repeated rows count once, ties of the write time take the larger
    frequency, nulls and blank terms do not count, no rows give no rows.
    """
    pairs = materialize(current_postings(postings), "term-doc")
    subtrees = materialize(spread(pairs.select("term", "tf")).mapInArrow(count_in_tries, _SUBTREES_SQL), "subtrees")
    n = tasks(pairs)
    entries = subtrees.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    large = pairs.sparkSession.sparkContext.broadcast(large_prefixes(subtrees, max(1000, entries // (4 * n))))
    merged = subtrees.mapInArrow(router(large), _ROUTED_SQL).repartition(n, "route").sortWithinPartitions("route").mapInArrow(merge_subtrees, _COUNTED)
    all_docs = pairs.select("doc_id").distinct().count()
    mark = F.when(F.col("n_docs") < rare_below, "rare").when(F.col("n_docs") >= F.lit(all_docs * common_share), "common")
    return merged.select("term", "total_freq", "n_docs", mark.alias("mark"))


def marked_terms(postings: DataFrame) -> DataFrame:
    return term_counts(postings).where(F.col("mark").isNotNull()).select("term", "mark")
