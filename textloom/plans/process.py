"""From raw pages to the document store."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as St

from textloom.functions import html as H
from textloom.runtime import materialize


def parse_pages(pages: DataFrame, full: bool = True) -> DataFrame:
    """``(page_id, url, title, text, error)`` of each page (page_id, url, html).

    A page over the size limit, without markup or without text has ``error`` set and
    no text; the job never fails on one.
    """
    size = F.octet_length("html")
    body = H.body_text(F.col("html"), full)
    parsed = pages.select("page_id", "url", size.alias("size"), H.title(F.col("html"), full).alias("title"), body.alias("text"))
    error = F.when(F.col("size").isNull(), "NotFound").when(F.col("size") > H.MAX_BYTES, "TooLarge").when(F.coalesce("text", F.lit("")) == "", "Empty")
    return parsed.select("page_id", "url", "title", F.when(error.isNull(), F.col("text")).alias("text"), error.alias("error"))


def number(docs: DataFrame, order: str, name: str = "doc_id") -> DataFrame:
    """Dense numbers from 0 in the order of column ``order``, without a one-task window.

    Rows are range-partitioned and sorted, rows per partition counted, and each
    row's number is its place plus the rows before its partition.  The driver holds
    one number per partition.
    """
    parts = docs.repartitionByRange(order).sortWithinPartitions(order).withColumn("__p", F.spark_partition_id())
    kept = materialize(parts, "numbered")
    counts = {r["__p"]: r["n"] for r in kept.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, starts = 0, []
    for p in sorted(counts):
        starts.append((p, before))
        before += counts[p]
    schema = St.StructType([St.StructField("__p", St.IntegerType()), St.StructField("__start", St.LongType())])
    offsets = docs.sparkSession.createDataFrame(starts, schema)
    within = Window.partitionBy("__p").orderBy(order)
    out = kept.join(F.broadcast(offsets), "__p").withColumn(name, F.row_number().over(within) - 1 + F.col("__start"))
    return out.drop("__p", "__start")


def process(pages: DataFrame, full: bool = True) -> DataFrame:
    """Document store ``(doc_id, url, title, text)`` of the pages that hold text, numbered by page_id."""
    # parsed once: the range partitioning below samples its input first
    kept = materialize(parse_pages(pages, full), "parsed").where("error IS NULL").drop("error")
    return number(kept, "page_id").select("doc_id", "url", "title", "text")


def process_stats(pages: DataFrame) -> DataFrame:
    """One row ``(processed, skipped, avg_len)``; the length is in bytes of the texts kept."""
    p = parse_pages(pages)
    ok = F.col("error").isNull()
    return p.agg(F.count_if(ok).alias("processed"), F.count_if(~ok).alias("skipped"), F.avg(F.octet_length("text")).alias("avg_len"))


def sample_documents(docs: DataFrame, n: int = 5, seed: int = 7) -> DataFrame:
    """A few random documents for a look after writing; an empty store gives none."""
    return docs.orderBy(F.rand(seed)).limit(n).select("doc_id", "title", F.substring("text", 1, 100).alias("snippet"))
