"""Command line: crawl, process, index, search, extract."""

from __future__ import annotations

import argparse
import sys
import time
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from textloom.plans import crawl as C
from textloom.plans import index as I
from textloom.plans import process as P
from textloom.plans import search as S
from textloom.runtime import ship
from textloom.sources import http, readers


@contextmanager
def timed(label: str):
    began = time.time()
    yield
    print(f"{label}: {(time.time() - began) * 1000:.0f} ms")


def _crawl(spark: SparkSession, a: argparse.Namespace) -> None:
    seeds = readers.seeds(spark, a.seeds)
    if a.responses:
        stored = spark.read.parquet(a.responses)
        fetch = C.table_fetcher(stored.select("url", F.col("status_code").alias("status"), "body", "final_url", "content_type"))
    else:
        fetch = C.http_fetcher(http.get, a.threads)
    pages = C.crawl(seeds, fetch, lambda urls: C.fetched_rules(urls, fetch), C.CrawlConfig(max_pages=a.max_pages))
    pages.write.mode("overwrite").parquet(a.output)


def _process(spark: SparkSession, a: argparse.Namespace) -> None:
    pages = spark.read.parquet(a.input) if a.parquet else readers.html_folder(spark, a.input)
    readers.write_documents(P.process(pages), a.output)
    stats = P.process_stats(pages).first()
    print(f"processed {stats['processed']}, skipped {stats['skipped']}, average length {stats['avg_len'] or 0:.1f}")
    P.sample_documents(readers.documents(spark, a.output)).show(truncate=100)


def _index(spark: SparkSession, a: argparse.Namespace) -> None:
    I.write_index(I.build_index(readers.documents(spark, a.docs)), a.output)
    index = I.read_index(spark, a.output)
    stats = index.corpus_stats.first()
    longest = I.longest_posting_list(index).first()
    print(f"documents {stats['doc_count']}, average length {stats['avg_doc_length']:.2f}, vocabulary {index.term_stats.count()}")
    if longest:
        print(f"longest list {longest['term']} -> {longest['df']}")


def _search(spark: SparkSession, a: argparse.Namespace) -> int:
    from textloom.functions.text import tokenize_py

    if not tokenize_py(a.query):
        print("no terms in the query", file=sys.stderr)
        return 1
    index = I.read_index(spark, a.index)
    for r in S.search(index, readers.documents(spark, a.docs), a.query, a.top).collect():  # at most --top rows
        print(f"{r['rank']}. {r['score']:.10f} [{r['doc_id']}] {r['title']}\n   {r['snippet']}")
    return 0


def _extract(spark: SparkSession, a: argparse.Namespace) -> None:
    readers.articles(readers.wiki_dump(spark, a.input), a.max_pages).write.mode("overwrite").parquet(a.output)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="textloom")
    verbs = p.add_subparsers(dest="verb", required=True)
    v = verbs.add_parser("crawl")
    v.add_argument("--seeds", required=True), v.add_argument("--responses"), v.add_argument("--output", default="pages")
    v.add_argument("--max-pages", type=int, default=100), v.add_argument("--threads", type=int, default=8)
    v.set_defaults(run=_crawl)
    v = verbs.add_parser("process")
    v.add_argument("--input", required=True), v.add_argument("--output", required=True), v.add_argument("--parquet", action="store_true")
    v.set_defaults(run=_process)
    v = verbs.add_parser("index")
    v.add_argument("--docs", required=True), v.add_argument("--output", required=True)
    v.set_defaults(run=_index)
    v = verbs.add_parser("search")
    v.add_argument("--docs", required=True), v.add_argument("--query", required=True), v.add_argument("--index", required=True)
    v.add_argument("--top", type=int, default=10)
    v.set_defaults(run=_search)
    v = verbs.add_parser("extract")
    v.add_argument("--input", required=True), v.add_argument("--output", required=True), v.add_argument("--max-pages", type=int)
    v.set_defaults(run=_extract)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("textloom").getOrCreate()
    ship(spark)
    with timed(args.verb):
        return args.run(spark, args) or 0


if __name__ == "__main__":
    sys.exit(main())
