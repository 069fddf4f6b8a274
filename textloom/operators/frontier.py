"""Crawl frontier: deduplication and politeness order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import urls as U

DELAY_MS = 100


def push(seen: DataFrame | None, urls: DataFrame) -> DataFrame:
    """New frontier rows ``(url, domain, seq)``: valid, normalised, first occurrence, not seen before.

    ``urls`` is (url, seq); ``seen`` holds normalised ``url``s.
    """
    norm = urls.select(U.normalize(F.col("url")).alias("url"), "seq").where("url <> ''")
    fresh = norm.groupBy("url").agg(F.min("seq").alias("seq"))
    if seen is not None:
        fresh = fresh.join(seen.select("url"), "url", "left_anti")
    return fresh.select("url", U.domain(F.col("url")).alias("domain"), "seq")


def schedule(frontier: DataFrame, delay_ms: int = DELAY_MS) -> DataFrame:
    """``(url, domain, seq, ready_ms)``: the k-th URL of a host is ready after k - 1 delays.

    A host's queue is ordered in one window; its URLs are what one crawl round holds.
    """
    turn = F.row_number().over(Window.partitionBy("domain").orderBy("seq"))
    return frontier.select("url", "domain", "seq", ((turn - 1) * F.lit(delay_ms)).cast("long").alias("ready_ms"))


def counts(seen: DataFrame, popped: DataFrame) -> DataFrame:
    """One row ``(seen, pending)``."""
    waiting = seen.join(popped.select("url"), "url", "left_anti")
    return seen.agg(F.countDistinct("url").alias("seen")).crossJoin(waiting.agg(F.count(F.lit(1)).alias("pending")))  # two one-row results
