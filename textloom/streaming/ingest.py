"""Streaming ingest: pages that keep arriving become documents and postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from textloom.functions import urls as U
from textloom.operators.frontier import DELAY_MS
from textloom.plans.index import document_lengths, term_frequencies
from textloom.plans.process import parse_pages

PAGE = "page_id long, url string, html string, fetched_at timestamp"


def page_stream(spark: SparkSession, path: str) -> DataFrame:
    """Pages from Parquet files as they appear in a folder."""
    return spark.readStream.schema(PAGE).parquet(path)


def distinct_pages(pages: DataFrame, delay: str = "1 day") -> DataFrame:
    """First arrival of each normalised URL; state older than the watermark is dropped."""
    keyed = pages.withColumn("url", U.normalize(F.col("url"))).where("url <> ''")
    return keyed.withWatermark("fetched_at", delay).dropDuplicatesWithinWatermark(["url"])


def pages_per_host(pages: DataFrame, window: str = "10 minutes", delay: str = "1 day") -> DataFrame:
    """Pages per host and time window, final once the watermark has passed."""
    host = U.domain(F.col("url")).alias("domain")
    return pages.withWatermark("fetched_at", delay).groupBy(F.window("fetched_at", window).alias("w"), host).agg(F.count(F.lit(1)).alias("pages"))


def start_index(pages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's documents, postings and lengths under ``out``; a repeated batch overwrites itself."""

    def append(batch: DataFrame, batch_id: int) -> None:
        kept = parse_pages(batch.select("page_id", "url", "html")).where("error IS NULL")
        docs = kept.select(F.col("page_id").alias("doc_id"), "url", "title", "text")
        docs.write.mode("overwrite").parquet(f"{out}/docs/batch={batch_id}")
        stored = batch.sparkSession.read.parquet(f"{out}/docs/batch={batch_id}")
        term_frequencies(stored).sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{out}/postings/batch={batch_id}")
        document_lengths(stored).write.mode("overwrite").parquet(f"{out}/doc_lengths/batch={batch_id}")

    return pages.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def polite(urls: DataFrame, delay_ms: int = DELAY_MS) -> DataFrame:
    """``(url, domain, ready_ms)`` for a stream of (url, domain, at_ms): next free slot of each host.

    A host's state is the time of its next slot.
    """

    def slots(key, frames, state):
        import pandas as pd

        free = state.get[0] if state.exists else 0
        for frame in frames:
            rows = []
            for url, at in sorted(zip(frame["url"], frame["at_ms"]), key=lambda x: (x[1], x[0])):
                ready = max(int(at), free)
                free = ready + delay_ms
                rows.append((url, key[0], ready))
            yield pd.DataFrame(rows, columns=["url", "domain", "ready_ms"])
        state.update((free,))

    return urls.groupBy("domain").applyInPandasWithState(slots, "url string, domain string, ready_ms long", "free long", "append", "NoTimeout")
