"""Pieces shared by the text operators: site keys, rolling hashes, batch helpers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

M64 = (1 << 64) - 1
_MUL = 0x9E3779B97F4A7C15


def site_of(url: Column, source: Column) -> Column:
    """Host of ``url`` in lower case without port; ``source`` trimmed in lower case where ``url`` is null."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.when(url.isNotNull(), host).otherwise(F.lower(F.regexp_replace(source, r"^[\s ]+|[\s ]+$", "")))


def codes(text: str) -> np.ndarray:
    """Code points of a text; lone surrogates are kept."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads a polynomial hash over all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def run_hashes(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of symbols from one of ``starts`` to the next, of which the first is 0; zeros at its end change nothing."""
    sizes = np.diff(starts, append=len(symbols))
    power = np.cumprod(np.full(sizes.max(), _MUL, np.uint64))
    place = np.arange(len(symbols)) - np.repeat(starts, sizes)
    return mix(np.add.reduceat(symbols.astype(np.uint64) * power[place], starts))


def rolling(symbols: np.ndarray, k: int, base: int = 0x100000001B3) -> np.ndarray:
    """Polynomial hash (mod 2**64) of every window of ``k`` symbols, by doubling.

    Windows of length 2n come from two of length n, so the cost is O(log k) passes.
    """
    n = len(symbols) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power = lambda e: np.uint64(pow(base, e, 1 << 64))
    cur = symbols.astype(np.uint64) * np.uint64(_MUL) + np.uint64(0x632BE59BD9B4E019)
    cur_len, out, out_len = 1, None, 0
    while True:
        if k & 1:
            if out is None:
                out, out_len = cur, cur_len
            else:
                m = len(cur) - out_len
                out = out[:m] * power(cur_len) + cur[out_len : out_len + m]
                out_len += cur_len
        k >>= 1
        if not k:
            return mix(out[:n])
        m = len(cur) - cur_len
        cur = cur[:m] * power(cur_len) + cur[cur_len : cur_len + m]
        cur_len *= 2


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every window of ``w`` values, by doubling."""
    n = len(a) - w + 1
    if n <= 0:
        return a[:0]
    span, cur = 1, a
    while span * 2 <= w:
        cur = np.minimum(cur[: len(cur) - span], cur[span:])
        span *= 2
    return np.minimum(cur[:n], cur[w - span : w - span + n])


def chunks_of(batches: Iterator[pa.RecordBatch], text: int, limit: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches whose texts (column number ``text``) hold about ``limit`` characters together."""
    for batch in batches:
        texts, start, held = batch.column(text).to_pylist(), 0, 0
        for i, t in enumerate(texts):
            held += len(t) if t else 0
            if held >= limit:
                yield batch.slice(start, i + 1 - start), texts[start : i + 1]
                start, held = i + 1, 0
        if start < len(texts):
            yield batch.slice(start), texts[start:]


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)
