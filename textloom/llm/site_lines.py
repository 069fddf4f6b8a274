"""Lines repeated across one site's documents, by content-defined chunking.

Every line is normalised and cut where a rolling hash of its last ``WINDOW``
characters hits a divisor, so equal text gives equal chunks wherever it stands;
a line end is a cut too, because the result is a set of lines.  Distinct
documents are counted per (site, chunk).  All chunks of a line that repeats are
at least as frequent as the line, so a line whose anchor chunk (its smallest
chunk hash) is infrequent is no case; the others are counted exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import batch, chunks_of, codes, mix, rolling, site_of
from textloom.runtime import materialize, spread

WINDOW = 8
DIVISOR = 64
MIN_DOCS = 5
MIN_SHARE = 0.05

_BLANKS = re.compile("[ \t\r ]+")
_DIGITS = re.compile("[0-9]+")


def normalise(text: str) -> str:
    """Lower case, one space per run of blanks, ``0`` per run of digits; line ends stay."""
    return _DIGITS.sub("0", _BLANKS.sub(" ", text.lower()))


def lines_of(text: str) -> list[str]:
    """Normalised, trimmed lines between line feeds, empty ones included."""
    return [x.strip(" ") for x in normalise(text).split("\n")]


def cuts(symbols: np.ndarray, line_ends: np.ndarray) -> np.ndarray:
    """End positions of the chunks: rolling-hash hits inside lines and every line end."""
    hit = np.zeros(len(symbols), bool)
    h = rolling(symbols, WINDOW)
    hit[WINDOW - 1 :] = h % np.uint64(DIVISOR) == 0
    # a window that reaches over a line start depends on the line before it
    starts = np.concatenate([[0], line_ends[:-1]])
    age = np.arange(len(symbols)) - np.repeat(starts, line_ends - starts)
    hit &= age >= WINDOW - 1
    hit[line_ends[line_ends > 0] - 1] = True
    return np.flatnonzero(hit) + 1


_INV = pow(0x100000001B3, -1, 1 << 64)


def chunk_hashes(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each chunk, from prefix sums of a polynomial."""
    n = len(symbols)
    steps = np.full(n, 0x100000001B3, np.uint64)
    steps[:1] = 1
    powers = np.cumprod(steps, dtype=np.uint64)
    back = np.full(n, _INV, np.uint64)
    back[:1] = 1
    inverse = np.cumprod(back, dtype=np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((symbols.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * powers, dtype=np.uint64)])
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


_LINES = pa.schema([("site", pa.int64()), ("doc_id", pa.int64()), ("line_no", pa.int64()), ("line", pa.binary()), ("first", pa.bool_()), ("anchor", pa.int64()), ("chunks", pa.list_(pa.int64()))])
_LINES_SQL = "site long, doc_id long, line_no long, line binary, first boolean, anchor long, chunks array<long>"


def chunk_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (site, doc_id, line_no, 128-bit line key, first, anchor, chunks) of all non-blank lines.

    ``first`` marks a line's first place in its document; ``chunks`` lists only
    chunks not seen before in the document, so that counting rows counts documents.
    """
    for b, texts in chunks_of(batches, 2, 1 << 20):
        sites, ids = b.column(0).to_pylist(), b.column(1).to_pylist()
        site, doc, no, lines, first_here, nth = [], [], [], [], [], []
        for k, (s, d, t) in enumerate(zip(sites, ids, texts)):
            if t:
                seen = set()
                for i, line in enumerate(lines_of(t)):
                    if line:
                        site.append(s), doc.append(d), no.append(i), lines.append(line), nth.append(k)
                        first_here.append(line not in seen)
                        seen.add(line)
        if not lines:
            continue
        ends = np.cumsum([len(x) for x in lines])
        symbols = codes("".join(lines))
        at = cuts(symbols, ends)
        hashes = chunk_hashes(symbols, at).view(np.int64)
        last = np.searchsorted(at, ends, side="left") + 1  # chunks up to and with each line's last
        first = np.concatenate([[0], last[:-1]])
        anchors = np.minimum.reduceat(hashes, first)
        keys = [xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in lines]
        row = np.repeat(np.arange(len(lines)), last - first)
        of_doc = np.array(nth)[row]
        order = np.lexsort((hashes, of_doc))
        new = np.ones(len(hashes), bool)
        new[order[1:]] = (hashes[order[1:]] != hashes[order[:-1]]) | (of_doc[order[1:]] != of_doc[order[:-1]])
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(lines)))])
        fresh = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(hashes[new], pa.int64()))
        yield batch(_LINES, site, doc, no, keys, first_here, pa.array(anchors, pa.int64()), fresh)


def _frequent(counts: DataFrame, sizes: DataFrame, min_docs: int, min_share: float) -> DataFrame:
    """Rows of ``counts`` (site, ..., n) that reach both limits in their site."""
    near = counts.where(F.col("n") >= min_docs)
    return near.join(sizes, "site").where(F.col("n") >= F.col("site_docs") * F.lit(min_share))


def site_chunks(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, sizes, chunk counts): chunked lines in shared storage, documents per site, documents per chunk."""
    docs = documents.select(site_of(F.col("url"), F.col("source")).alias("name"), "doc_id", "text")
    docs = docs.where("name IS NOT NULL AND doc_id IS NOT NULL").select(F.xxhash64("name").alias("site"), "doc_id", "text")
    sizes = docs.groupBy("site").agg(F.countDistinct("doc_id").alias("site_docs"))
    lines = materialize(spread(docs).where(F.col("text").isNotNull()).mapInArrow(chunk_lines, _LINES_SQL), "lines")
    # a hot chunk is one counter per map task when it is shuffled
    per_chunk = lines.select("site", F.explode("chunks").alias("chunk")).groupBy("site", "chunk").agg(F.count(F.lit(1)).alias("n"))
    return lines, sizes, per_chunk


def repeated_lines(documents: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """``(doc_id, line_no)`` of every line to be removed.

    A line is a case when it stands in at least ``min_docs`` documents of its site
    and in at least ``min_share`` of them.  Line numbers count all pieces between
    line feeds.  A line repeated inside one document counts once there but every
    occurrence is listed.  Blank lines, null texts and documents without a site or id
    give nothing; a repeated row is the same document.
    Sites travel as 64-bit hashes of their names, lines as 128-bit hashes.
    """
    lines, sizes, per_chunk = site_chunks(documents)
    hot = _frequent(per_chunk, sizes, min_docs, min_share).select("site", F.col("chunk").alias("anchor"))
    candidates = materialize(lines.select("site", "doc_id", "line_no", "line", "first", "anchor").join(hot, ["site", "anchor"], "left_semi").drop("anchor"), "line-candidates")
    per_line = candidates.where("first").select("site", "line", "doc_id").distinct().groupBy("site", "line").agg(F.count(F.lit(1)).alias("n"))
    cases = _frequent(per_line, sizes, min_docs, min_share).select("site", "line")
    return candidates.join(cases, ["site", "line"], "left_semi").select("doc_id", "line_no").distinct()


def repeated_chunks(documents: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """``(site, chunk, n_docs)``: content-defined chunks (as hashes, like the site) repeated excessively in a site."""
    _, sizes, per_chunk = site_chunks(documents)
    return _frequent(per_chunk, sizes, min_docs, min_share).select("site", "chunk", F.col("n").alias("n_docs"))


def without_repeated_lines(documents: DataFrame) -> DataFrame:
    """``(doc_id, text)``: each document without its repeated lines; a null text stays null."""
    gone = repeated_lines(documents).groupBy("doc_id").agg(F.collect_list("line_no").alias("gone"))  # bounded by the lines of one text
    pieces = F.split(F.col("text"), "\n")
    kept = F.filter(pieces, lambda _, i: ~F.array_contains(F.col("gone"), i.cast("long")))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return documents.select("doc_id", "text").join(gone, "doc_id", "left").select("doc_id", text.alias("text"))
