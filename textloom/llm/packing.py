"""Filling fixed-capacity containers with texts, by non-negative least squares.

Lengths are summed up in a histogram (at most ``capacity`` bins, whatever the number
of texts).  Shallow combinations of lengths that fill a container exactly are
enumerated, least squares with non-negative repeat counts fits them to the
histogram, the counts are rounded to what is there, and what is left is packed
greedily, largest first.  Texts then find their container by their rank among the
texts of their length, by binary search in a table of places that every task has; ranks
come from per-bucket counts, so no task holds a length.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import batch
from textloom.runtime import materialize, spread, tasks

CAPACITY = 1024
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
ROUNDS = 300
# fixed value: the splitting pattern published with the 50k byte-level vocabulary
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_SIZES = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])


def token_counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode_ordinary
        for b in batches:
            yield batch(_SIZES, b.column(0), [len(encode(t)) if t else 0 for t in b.column(1).to_pylist()])

    return count


def combinations(present: np.ndarray, capacity: int) -> np.ndarray:
    """Rows (a, b, c), a >= b >= c >= 0 and a + b + c = capacity, of lengths that occur; 0 is no item."""
    have = np.zeros(capacity + 1, bool)
    have[present] = True
    have[0] = True
    out = []
    for a in present[present * 3 >= capacity]:
        rest = capacity - a
        b = np.arange((rest + 1) // 2, min(a, rest) + 1)
        b = b[have[b] & have[rest - b] & ((b > 0) | (rest == 0))]
        out.append(np.stack([np.full(len(b), a), b, rest - b], axis=1))
    return np.concatenate(out) if out else np.empty((0, 3), np.int64)


def repeat_counts(combos: np.ndarray, histogram: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Non-negative x that fits ``A x = histogram`` in least squares, by multiplicative steps.

    A has a column per combination, with the number of items of each length.
    Length 0 has no equation.
    """
    if not len(combos):
        return np.empty(0)
    h = histogram.astype(float)
    h[0] = 0
    used = (combos > 0).astype(float)
    x = np.full(len(combos), max(1e-9, h.sum() / max(1, used.sum())))
    back = (h[combos] * used).sum(1)
    for _ in range(rounds):
        made = np.bincount(combos.ravel(), weights=(x[:, None] * used).ravel(), minlength=len(h))
        x *= back / np.maximum((made[combos] * used).sum(1), 1e-12)
    return x


def pack_histogram(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of one container) and how often each is used; every item is placed once.

    ``histogram[n]`` counts items of length n, 1 <= n <= capacity.
    """
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[tuple[int, ...], int]] = []

    def use(lengths: tuple[int, ...], most: int) -> None:
        need: dict[int, int] = {}
        for n in lengths:
            need[n] = need.get(n, 0) + 1
        times = min([most, *(int(left[n]) // k for n, k in need.items())])
        if times > 0:
            for n, k in need.items():
                left[n] -= k * times
            out.append((lengths, times))

    combos = combinations(np.flatnonzero(left), capacity)
    x = repeat_counts(combos, left)
    order = np.argsort(-x, kind="stable")
    for extra in (0, 1):  # whole repeats first, then one more where items are left
        for i in order:
            most = int(x[i]) if extra == 0 else 1
            if most == 0:
                break
            lengths = tuple(int(n) for n in combos[i] if n)
            if all(left[n] > 0 for n in lengths):
                use(lengths, most)
    while True:
        present = np.flatnonzero(left)
        if not len(present):
            return out
        lengths, room, taken = [], capacity, {}
        while True:
            fit = present[: np.searchsorted(present, room, side="right")]
            while len(fit) and taken.get(int(fit[-1]), 0) >= left[fit[-1]]:
                fit = fit[:-1]
            if not len(fit):
                break
            n = int(fit[-1])
            lengths.append(n)
            taken[n] = taken.get(n, 0) + 1
            room -= n
        use(tuple(lengths), int(left[lengths[0]]))


def _places(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple]:
    """Rows (len, from, to, per, base, fill): ranks from..to-1 of a length go to base + (rank - from) // per."""
    rows, base, used = [], 0, {}
    for lengths, times in patterns:
        need: dict[int, int] = {}
        for n in lengths:
            need[n] = need.get(n, 0) + 1
        for n, k in need.items():
            start = used.get(n, 0)
            used[n] = start + k * times
            rows.append((n, start, used[n], k, base, sum(lengths)))
        base += times
    return rows


_PLACED = pa.schema([("doc_id", pa.int64()), ("piece_no", pa.int64()), ("n_tokens", pa.int64()), ("container_id", pa.int64()), ("container_tokens", pa.int64())])
_PLACED_SQL = "doc_id long, piece_no long, n_tokens long, container_id long, container_tokens long"
_RANKS = 40  # bits of a rank inside a length


def place_finder(places):
    """Containers of (doc_id, piece_no, len, rank) rows by binary search in a broadcast, sorted table of places."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, lo, _, per, base, filled = places.value
        keys = (length << _RANKS) | lo
        for b in batches:
            n, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            at = np.searchsorted(keys, (n << _RANKS) | rank, side="right") - 1
            yield batch(_PLACED, b.column(0), b.column(1), b.column(2), base[at] + (rank - lo[at]) // per[at], filled[at])

    return find


def containers(documents: DataFrame, capacity: int = CAPACITY, tokenizer_path: str = TOKENIZER) -> DataFrame:
    """``(doc_id, piece_no, token_from, n_tokens, container_id, container_tokens)``.

    Every text is whole in one container; one above ``capacity`` tokens is split into
    full pieces and a rest.  A null or empty text has no tokens and no container
    (nulls).  A repeated row is a further text.  Equal lengths are placed in order of a hash of the id, then the id.
    """
    sizes = spread(documents.select("doc_id", "text")).mapInArrow(token_counter(tokenizer_path), "doc_id long, n_tokens long")
    n_pieces = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / capacity)).cast("int")
    pieces = sizes.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), n_pieces - 1)).alias("piece_no"))
    size = F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - F.col("piece_no") * capacity)
    buckets = tasks(documents)
    bucket = F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(buckets))
    items = materialize(pieces.select("doc_id", "piece_no", size.alias("len")).withColumn("bucket", bucket), "pieces")
    counts = items.where("len > 0").groupBy("len", "bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts, "piece-counts")  # at most capacity * buckets rows
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("len").agg(F.sum("n").alias("n")).collect():
        histogram[r["len"]] = r["n"]
    # patterns times three lengths at most: bounded by the capacity, not by the data
    rows = np.array(_places(pack_histogram(histogram, capacity)), np.int64).reshape(-1, 6)
    places = documents.sparkSession.sparkContext.broadcast(rows[np.lexsort((rows[:, 1], rows[:, 0]))].T.copy())
    before = Window.partitionBy("len").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("len", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("len", "bucket").orderBy(F.xxhash64("doc_id", "piece_no"), "doc_id", "piece_no")
    ranked = items.where("len > 0").withColumn("rn", F.row_number().over(within) - 1).join(offsets, ["len", "bucket"]).withColumn("rank", F.col("rn") + F.col("offset"))
    placed = ranked.select("doc_id", F.col("piece_no").cast("long").alias("piece_no"), "len", F.col("rank").cast("long").alias("rank")).mapInArrow(place_finder(places), _PLACED_SQL)
    start = (F.col("piece_no").cast("long") * capacity).alias("token_from")
    none = F.lit(None).cast("long")
    empty = items.where("len = 0").select("doc_id", F.col("piece_no").cast("long").alias("piece_no"), start, F.col("len").alias("n_tokens"), none.alias("container_id"), none.alias("container_tokens"))
    return placed.select("doc_id", "piece_no", start, "n_tokens", "container_id", "container_tokens").unionByName(empty)


def contract(documents: DataFrame, capacity: int = CAPACITY, tokenizer_path: str = TOKENIZER) -> DataFrame:
    """One row that checks a packing against its texts: ``(texts, placed, split_wrongly, overfull, misstated, gaps)``.

    ``placed`` counts texts with a container; a text of at most ``capacity`` tokens in
    several pieces is split wrongly; a container is overfull above the capacity and
    misstated where its pieces are not what it says; gaps are pieces that do not follow each other.
    """
    packed = materialize(containers(documents, capacity, tokenizer_path), "packed")
    texts = packed.groupBy("doc_id").agg(F.count("container_id").alias("placed"), F.sum("n_tokens").alias("n"), F.max(F.col("token_from") + F.col("n_tokens")).alias("end"))
    of_texts = texts.agg(
        F.count(F.lit(1)).alias("texts"), F.count_if(F.col("placed") > 0).alias("placed"), F.count_if(F.col("placed") > F.greatest(F.lit(1), F.ceil(F.col("n") / capacity))).alias("split_wrongly"),
        F.count_if(F.col("n") != F.col("end")).alias("gaps"),
    )
    filled = packed.where("container_id IS NOT NULL").groupBy("container_id").agg(F.sum("n_tokens").alias("n"), F.min("container_tokens").alias("lo"), F.max("container_tokens").alias("hi"))
    of_containers = filled.agg(F.count_if(F.col("n") > capacity).alias("overfull"), F.count_if((F.col("n") != F.col("lo")) | (F.col("n") != F.col("hi"))).alias("misstated"))
    return of_texts.crossJoin(of_containers)  # two one-row results


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row ``(n_containers, n_tokens, fill)``; fill is null where nothing is packed."""
    # a container's tokens are known on each of its pieces, so its first piece stands for it
    out = packed.where("container_id IS NOT NULL").groupBy("container_id").agg(F.sum("n_tokens").alias("t"))
    total = out.agg(F.count(F.lit(1)).alias("n_containers"), F.sum("t").alias("n_tokens"))
    return total.select("n_containers", "n_tokens", (F.col("n_tokens") / (F.col("n_containers") * capacity)).alias("fill"))
