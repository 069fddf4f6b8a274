"""Sources: seed lists, raw page folders, the document store, wiki dumps, crawled tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import html as H
from textloom.functions import wiki as W

DOCUMENT = "doc_id long, url string, title string, text string"


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """``(url, seq)``: one URL per non-empty line, in file order."""
    lines = spark.read.text(path).where("value <> ''")
    return lines.select(F.col("value").alias("url"), F.monotonically_increasing_id().alias("seq"))


def html_folder(spark: SparkSession, path: str) -> DataFrame:
    """``(page_id, url, html)`` of every file of a folder up to the size limit; the URL is the file name.

    ``page_id`` is the number a file name begins with, else a hash of the name.
    """
    files = spark.read.format("binaryFile").load(path).where(F.col("length") <= H.MAX_BYTES)
    name = F.regexp_extract("path", "([^/]+)$", 1)
    number = F.regexp_extract(name, "^([0-9]{1,18})", 1).try_cast("long")
    return files.select(F.coalesce(number, F.xxhash64(name)).alias("page_id"), name.alias("url"), F.decode("content", "UTF-8").alias("html"))


def response_pages(responses: DataFrame) -> DataFrame:
    """``(page_id, url, html)`` of successful HTML responses; a repeated response counts once."""
    ok = responses.where((F.col("status_code") == 200) & F.contains(F.col("content_type"), F.lit("text/html")))
    one = ok.groupBy("response_id").agg(F.max(F.struct("fetched_at", "url", "body")).alias("r"))
    return one.select(F.col("response_id").alias("page_id"), F.col("r.url").alias("url"), F.col("r.body").alias("html"))


def documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DOCUMENT).parquet(path)


def document(docs: DataFrame, doc_id: int) -> DataFrame:
    """The document with a number; no row if there is none.  The filter reaches the scan."""
    return docs.where(F.col("doc_id") == doc_id)


def wiki_dump(spark: SparkSession, path: str) -> DataFrame:
    """``(title, text)`` of every page element of an XML dump; compressed files are read as they are."""
    schema = "title string, revision struct<text: string>"
    pages = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    return pages.select("title", F.col("revision.text").alias("text"))


def articles(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """``(title, text)``: cleaned articles; redirects, special pages and empty ones are left out."""
    kept = pages.where(W.is_article(F.col("title"), F.col("text")))
    cleaned = kept.select("title", W.clean_text(F.col("text")).alias("text")).where("text <> ''")
    return cleaned if limit is None else cleaned.limit(limit)


def write_documents(docs: DataFrame, path: str) -> None:
    docs.select("doc_id", "url", "title", "text").write.mode("overwrite").parquet(path)
