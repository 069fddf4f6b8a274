"""Long exact spans shared between records, by super-k-mer partitioning.

Every window of ``K`` characters belongs to the bucket of its minimiser, the
smallest hash among its ``M``-character pieces.  Consecutive windows with one
minimiser form a super-k-mer: one packed string instead of many windows.  Equal
windows have equal minimisers, so buckets are counted independently, and a
minimiser that occurs in one text only cannot hold a shared window: those
super-k-mers never travel.  Equal texts are represented by one record until the
end.  Inside a bucket windows are sorted and equal ones compared exactly; a bucket
of more than ``HOT`` strings is counted as flat window rows instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import batch, chunks_of, codes, mix, rolling, sliding_min
from textloom.runtime import materialize, spread, tasks

K = 300
M = 32
HOT = 1000
_CHUNK = 1 << 20  # characters handled at once; positions fit the low bits of a sort key
_LOW = np.uint64((1 << 22) - 1)


def super_kmers(symbols: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, minimiser hash) of each super-k-mer of concatenated texts.

    ``ends`` are the end positions of the texts; windows over an end do not count.
    """
    m = min(M, k)
    h = rolling(symbols, m)
    if len(symbols) < k:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    if len(h) > int(_LOW):
        raise ValueError("too many characters at once")
    low = sliding_min((h & ~_LOW) | np.arange(len(h), dtype=np.uint64), k - m + 1)
    at = (low & _LOW).astype(np.int64)
    start_of = np.concatenate([[0], ends[:-1]])
    text = np.repeat(np.arange(len(ends)), ends - start_of)
    valid = text[: len(at)] == text[k - 1 : k - 1 + len(at)]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (valid[1:] != valid[:-1]) | (text[1 : len(at)] != text[: len(at) - 1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    keep = valid[first]
    first, count = first[keep], count[keep]
    return first, count, h[at[first]].view(np.int64)


_SEGMENTS = pa.schema([("h", pa.int64()), ("th", pa.binary()), ("doc_id", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])
_SEGMENTS_SQL = "h long, th binary, doc_id long, start int, n int"


def _pieces(texts: list[str]) -> Iterator[tuple[list[int], list[int], list[str]]]:
    """Groups of (index, offset in the text, piece) of at most about ``_CHUNK`` characters.

    A longer text is read in pieces that overlap by a window less one, so every
    window lies in one piece.
    """
    rows, offs, parts, held = [], [], [], 0
    for i, t in enumerate(texts):
        if not t or len(t) < K:
            continue
        for o in range(0, max(1, len(t) - K + 1), _CHUNK):
            piece = t[o : o + _CHUNK + K - 1]
            rows.append(i), offs.append(o), parts.append(piece)
            held += len(piece)
            if held >= _CHUNK:
                yield rows, offs, parts
                rows, offs, parts, held = [], [], [], 0
    if rows:
        yield rows, offs, parts


def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Super-k-mers of (doc_id, text) rows as positions: (minimiser, text hash, doc_id, start, windows)."""
    for b, texts in chunks_of(batches, 1, _CHUNK):
        ids = np.array(b.column(0).to_numpy(zero_copy_only=False))
        for rows, offs, parts in _pieces(texts):
            ends = np.cumsum([len(p) for p in parts])
            first, count, h = super_kmers(codes("".join(parts)), ends, K)
            which = np.searchsorted(ends, first, side="right")
            starts = first - np.concatenate([[0], ends[:-1]])[which] + np.array(offs)[which]
            digests = [xxhash.xxh3_128_digest(texts[i].encode("utf-8", "surrogatepass")) for i in rows]
            yield batch(_SEGMENTS, h, [digests[w] for w in which], ids[np.array(rows)[which]], pa.array(starts, pa.int32()), pa.array(count, pa.int32()))


# a row of a set names one document of a set that shares a window; a place of shared windows has no set
_FOUND = pa.schema([("span_set", pa.binary()), ("doc_id", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])
_FOUND_SQL = "span_set binary, doc_id long, start int, n int"


def _match(docs: list[int], starts: list[int], strings: list[str]) -> Iterator[pa.RecordBatch]:
    """Shared windows of the packed strings of some whole buckets: places, and sets of documents.

    Windows are sorted by a 128-bit hash.  Windows that stand in the same documents
    give one set, with one row per document, and are compared character by character
    with its first member, so that the output stays linear in the input.
    """
    ends = np.cumsum([len(s) for s in strings])
    begin = np.concatenate([[0], ends[:-1]])
    symbols = codes("".join(strings))
    one, two = rolling(symbols, K), rolling(symbols, K, 0x5851F42D4C957F2D)
    owner = np.repeat(np.arange(len(ends)), ends - begin)
    windows = np.flatnonzero(owner[: len(one)] == owner[K - 1 : K - 1 + len(one)])
    doc = np.array(docs)[owner]
    order = windows[np.lexsort((doc[windows], two[windows], one[windows]))]
    d = doc[order]
    new = np.concatenate([[True], (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])])
    group = np.cumsum(new) - 1
    distinct = new | np.concatenate([[True], d[1:] != d[:-1]])
    n_docs = np.bincount(group[distinct])
    shared = n_docs[group] > 1
    if not shared.any():
        return
    # places: runs of consecutive shared windows of a document
    at = order[shared]
    who, pos = doc[at], at - begin[owner[at]] + np.array(starts)[owner[at]]
    by = np.lexsort((pos, who))
    who, pos = who[by], pos[by]
    run = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (pos[1:] - pos[:-1] > 1)]))
    n = pos[np.append(run[1:], len(pos)) - 1] - pos[run] + 1
    yield batch(_FOUND, pa.nulls(len(run), pa.binary()), who[run], pa.array(pos[run], pa.int32()), pa.array(n, pa.int32()))
    # sets: one window per set of documents
    first = np.flatnonzero(distinct & shared)
    heads = np.flatnonzero(np.concatenate([[True], group[first[1:]] != group[first[:-1]]]))
    sums = np.add.reduceat(mix(d[first].astype(np.uint64)), heads)
    tails = np.append(heads[1:], len(first))
    ids, members = [], []
    for k in np.unique(sums, return_index=True)[1]:
        same: dict[bytes, list[int]] = {}
        for i in order[first[heads[k] : tails[k]]]:
            same.setdefault(symbols[i : i + K].tobytes(), []).append(int(doc[i]))
        for found in same.values():
            if len(found) > 1:
                ids += [xxhash.xxh3_128_digest(np.array(found, np.int64).tobytes())] * len(found)
                members += found
    nothing = pa.nulls(len(ids), pa.int32())
    yield batch(_FOUND, ids, members, nothing, nothing)


def match_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shared windows of (h, doc_id, start, packed) rows that come sorted by bucket ``h``.

    Works on whole buckets, several at a time; a bucket has at most ``HOT`` strings.
    """
    docs, starts, strings, last, held = [], [], [], None, 0
    for b in batches:
        for h, d, s, p in zip(*(c.to_pylist() for c in b.columns)):
            if h != last and held >= _CHUNK:
                yield from _match(docs, starts, strings)
                docs, starts, strings, held = [], [], [], 0
            last = h
            docs.append(d), starts.append(s), strings.append(p)
            held += len(p)
    if strings:
        yield from _match(docs, starts, strings)


_WINDOWS = pa.schema([("w", pa.binary()), ("doc_id", pa.int64()), ("pos", pa.int32())])


def flat_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of hot buckets as rows (128-bit window hash, doc_id, position)."""
    for b in batches:
        for _, d, s, p in zip(*(c.to_pylist() for c in b.columns)):
            keys = [xxhash.xxh3_128_digest(p[i : i + K].encode("utf-8", "surrogatepass")) for i in range(len(p) - K + 1)]
            yield batch(_WINDOWS, keys, [d] * len(keys), pa.array(range(s, s + len(keys)), pa.int32()))


def _representatives(segments: DataFrame) -> DataFrame:
    """(doc_id, th, rep): every text of at least ``K`` characters and the record standing for its copies."""
    texts = segments.where("start = 0").select("doc_id", "th").distinct()
    return texts.join(texts.groupBy("th").agg(F.min("doc_id").alias("rep")), "th")


def placed(packed: DataFrame) -> DataFrame:
    """Rows of a stored table with whole buckets, sorted, in each task.

    The table must not be a join by ``h``: its placement would then be taken for this
    one, and a join turned into a broadcast while it runs leaves buckets in pieces.
    """
    return packed.repartition(tasks(packed), "h").sortWithinPartitions("h")


def shared_runs(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, texts): sets of representatives and places of shared windows, and who stands for whom.

    Spans repeated inside one record alone are not shared.
    """
    docs = documents.select("doc_id", "text").where((F.length("text") >= K) & F.col("doc_id").isNotNull())
    segments = materialize(spread(docs).mapInArrow(segment, _SEGMENTS_SQL), "segments")
    texts = materialize(_representatives(segments), "texts")
    stats = segments.groupBy("h").agg(F.min("th").alias("lo"), F.max("th").alias("hi"), F.count(F.lit(1)).alias("c"))
    shared = stats.where(F.col("lo") != F.col("hi")).select("h", (F.col("c") > HOT).alias("hot"))
    reps = texts.where(F.col("doc_id") == F.col("rep")).select("doc_id")
    places = segments.select("h", "doc_id", "start", "n").join(shared, "h").join(reps, "doc_id", "left_semi")
    by_doc = places.groupBy("doc_id").agg(F.collect_list(F.struct("h", "start", "n", "hot")).alias("s"))  # bounded by one text
    cut = docs.join(by_doc, "doc_id").select("doc_id", "text", F.explode("s").alias("s"))
    packed = materialize(cut.select("s.h", "doc_id", "s.start", F.expr("substring(text, s.start + 1, s.n + %d)" % (K - 1)).alias("packed"), "s.hot"), "packed")
    columns = ["h", "doc_id", "start", "packed"]
    runs = placed(packed.where("NOT hot").select(columns)).mapInArrow(match_buckets, _FOUND_SQL)
    flat = materialize(packed.where("hot").select(columns).mapInArrow(flat_windows, "w binary, doc_id long, pos int"), "windows")
    # the documents of a window as an order-free signature: each set of documents is listed once
    first = flat.select("w", "doc_id").distinct()
    sets = first.groupBy("w").agg(F.count(F.lit(1)).alias("c"), F.sum(F.xxhash64("doc_id").cast("decimal(20,0)")).alias("s"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("t")).where("c > 1")
    chosen = sets.groupBy("c", "s", "t").agg(F.min("w").alias("w")).select("w")
    none = F.lit(None).cast("int")
    members = first.join(chosen, "w", "left_semi").select(F.col("w").alias("span_set"), "doc_id", none.alias("start"), none.alias("n"))
    places = flat.join(sets.select("w"), "w", "left_semi").select(F.lit(None).cast("binary").alias("span_set"), "doc_id", F.col("pos").alias("start"), F.lit(1).alias("n"))
    return materialize(runs.unionByName(members).unionByName(places), "runs"), texts


def _linked(runs: DataFrame) -> DataFrame:
    """``(a, b)``, a < b: representatives of different texts with a common span."""
    member = runs.where("span_set IS NOT NULL").select("span_set", "doc_id").distinct()
    x, y = member.withColumnRenamed("doc_id", "a"), member.withColumnRenamed("doc_id", "b")
    return x.join(y, "span_set").where("a < b").select("a", "b").distinct()


def span_classes(documents: DataFrame) -> DataFrame:
    """``(doc_id, class_id, links)`` of every record with a shared span.

    A class is a text with all its copies, named by their smallest id; ``links`` counts
    the other texts that share a span of at least ``K`` characters with it.  Copies are
    not set out as pairs.  Nulls and shorter texts give nothing.
    """
    runs, texts = shared_runs(documents)
    pairs = _linked(runs)
    links = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    copied = texts.groupBy("rep").agg((F.count(F.lit(1)) > 1).alias("copied"))
    out = texts.join(copied, "rep").join(links, "rep", "left").where("copied OR links IS NOT NULL")
    return out.select("doc_id", F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links")).distinct()


def sharing_pairs(documents: DataFrame) -> DataFrame:
    """``(doc_id_a, doc_id_b)``, a < b: records with a common span of at least ``K`` characters.

    Nulls and shorter texts give nothing; equal texts of at least ``K`` characters
    are pairs too; a repeated row (equal id) is one record.
    """
    runs, texts = shared_runs(documents)
    between = _linked(runs)
    member = texts.select(F.col("rep"), "doc_id")
    one = between.join(member.withColumnsRenamed({"rep": "a", "doc_id": "x"}), "a")
    both = one.join(member.withColumnsRenamed({"rep": "b", "doc_id": "y"}), "b").select("x", "y")
    copies = texts.groupBy("rep").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("rep")
    same = member.join(copies, "rep", "left_semi")
    equal = same.withColumnRenamed("doc_id", "x").join(same.withColumnRenamed("doc_id", "y"), "rep").where("x < y").select("x", "y")
    out = both.where("x <> y").unionByName(equal)
    return out.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()


def shared_shares(documents: DataFrame) -> DataFrame:
    """``(doc_id, n_chars, shared_chars, share)`` of every record with a shared span.

    ``shared_chars`` counts characters inside any span of at least ``K`` characters
    that another record has too; a record with a copy is shared as a whole.
    """
    runs, texts = shared_runs(documents)
    places = runs.where("span_set IS NULL")
    spans = places.select(F.col("doc_id").alias("rep"), F.col("start").alias("s"), (F.col("start") + F.col("n") + (K - 1)).alias("e")).distinct()
    # union of intervals per record, as a fold over the sorted spans of one text
    ordered = spans.groupBy("rep").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("v"))
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("to"))
    step = lambda acc, x: F.struct((acc["sum"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], acc["to"]))).alias("sum"), F.greatest(acc["to"], x["e"]).alias("to"))
    covered = ordered.select("rep", F.aggregate("v", zero, step)["sum"].alias("covered"))
    copies = texts.groupBy("rep").agg((F.count(F.lit(1)) > 1).alias("copied"))
    per = texts.select("doc_id", "rep").join(copies, "rep").join(covered, "rep", "left").where("copied OR covered IS NOT NULL")
    size = documents.select("doc_id", F.length("text").cast("long").alias("n_chars")).where(F.col("n_chars") >= K)
    shared = F.when(F.col("copied"), F.col("n_chars")).otherwise(F.col("covered"))
    return per.join(size, "doc_id").select("doc_id", "n_chars", shared.alias("shared_chars"), (shared / F.col("n_chars")).alias("share")).distinct()
