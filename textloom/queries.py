"""Registered queries of the core and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import html as H
from textloom.functions import text as T
from textloom.functions import urls as U
from textloom.functions import wiki as W
from textloom.operators import frontier as Q
from textloom.operators import robots as R
from textloom.plans import crawl as C
from textloom.plans import index as I
from textloom.plans import postings_skew
from textloom.plans import process as P
from textloom.plans import search as S
from textloom.runtime import folder, shipped, spread, table
from textloom.sources import readers
from textloom.sql import SQL

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, Query] = {}

FLAGSHIP = "archive canvas archive report"


def query(f: Query) -> Query:
    _ALL[f.__name__] = f
    return f


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _index(spark: SparkSession, d: str) -> I.Index:
    return I.build_index(_docs(spark, d))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return readers.response_pages(table(spark, d, "http_responses"))


# text


@query
def tokenize(spark, d):
    return I.indexed_text(spread(_docs(spark, d))).select("doc_id", T.tokens(F.col("text")).alias("tokens"))


@query
def stop_words_removed(spark, d):
    return I.kept_tokens(_docs(spark, d)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"))


@query
def stem_vocabulary(spark, d):
    return I.kept_tokens(_docs(spark, d)).select("raw").distinct().select("raw", T.stem(F.col("raw")).alias("stem"))


@query
def joined_tokens(spark, d):
    return I.indexed_text(spread(_docs(spark, d))).select("doc_id", T.join_tokens(T.tokens(F.col("text"))).alias("joined"))


@query
def snippets(spark, d):
    return _docs(spark, d).where("text IS NOT NULL").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


# index


@query
def term_freq(spark, d):
    return I.term_frequencies(_docs(spark, d))


@query
def doc_freq(spark, d):
    return _index(spark, d).term_stats


@query
def doc_lengths(spark, d):
    return I.document_lengths(_docs(spark, d))


@query
def corpus_stats(spark, d):
    return _index(spark, d).corpus_stats


@query
def total_postings(spark, d):
    return I.term_frequencies(_docs(spark, d)).agg(F.count(F.lit(1)).alias("total_postings"))


@query
def vocabulary_size(spark, d):
    return I.vocabulary_size(_index(spark, d))


@query
def longest_posting_list(spark, d):
    return I.longest_posting_list(_index(spark, d))


@query
def postings_sorted(spark, d):
    return _index(spark, d).postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")


@query
def posting_lists(spark, d):
    return I.posting_lists(_index(spark, d)).select("term", F.transform("postings", lambda p: p["doc_id"]).alias("doc_ids"), F.transform("postings", lambda p: p["tf"]).alias("tfs"))


@query
def term_lookup(spark, d):
    """Documents of a fixed set of terms, as a point lookup in the directory."""
    return _index(spark, d).term_stats.where(F.col("term").isin("algorithm", "archive", "canvas", "missing"))


@query
def document_get(spark, d):
    return readers.document(_docs(spark, d), 1825).select("doc_id", "url", "title", "text")


# ranking


@query
def idf_table(spark, d):
    return S.idf_table(_index(spark, d)).select("term", "df", F.round("idf", 6).alias("idf"))


def _bm25(text: str, **kw):
    def run(spark, d):
        return S.score(_index(spark, d), text, **kw).select("doc_id", F.round("score", 6).alias("score"))

    return run


_ALL["bm25_single_term"] = _bm25("archive")
_ALL["bm25_multi_term"] = _bm25("archive canvas report")
_ALL["bm25_repeated_term"] = _bm25("archive archive canvas")
_ALL["bm25_missing_term"] = _bm25("qqqqzz canvas")
_ALL["bm25_no_terms"] = _bm25("the of a")
_ALL["bm25_params"] = _bm25("archive canvas", k1=2.0, b=0.3)


@query
def bm25_top_k(spark, d):
    return S.top_k(_index(spark, d), FLAGSHIP, 25).select("doc_id", F.round("score", 6).alias("score"))


@query
def search_results_page(spark, d):
    page = S.search(_index(spark, d), _docs(spark, d), FLAGSHIP, 10)
    return page.select("rank", F.round("score", 6).alias("score"), "doc_id", "title", "snippet")


# URLs


def _urls(spark, d):
    a = _docs(spark, d).select("url")
    b = table(spark, d, "http_responses").select(F.explode(F.array("url", "final_url")).alias("url"))
    return a.unionByName(b).where("url IS NOT NULL").distinct()


@query
def url_normalize(spark, d):
    return _urls(spark, d).select("url", U.normalize(F.col("url")).alias("normalized"))


@query
def url_domain(spark, d):
    return _urls(spark, d).select("url", U.domain(F.col("url")).alias("domain"))


@query
def url_components(spark, d):
    parts = U.components(F.col("url"))
    return _urls(spark, d).select("url", *[parts[c].alias(c) for c in ("scheme", "authority", "host", "port", "path", "query", "fragment")])


@query
def url_dedup(spark, d):
    norm = _urls(spark, d).select(U.normalize(F.col("url")).alias("url")).where("url <> ''")
    return norm.distinct()


@query
def url_robots_path(spark, d):
    return _urls(spark, d).select("url", U.robots_path(F.col("url")).alias("path"))


def _links(spark, d):
    r = table(spark, d, "http_responses").groupBy("response_id").agg(F.max("url").alias("base"))
    p = table(spark, d, "parsed_documents").select("response_id", F.explode("links").alias("rel")).distinct()
    return p.join(r, "response_id").where("base IS NOT NULL AND rel IS NOT NULL")


@query
def url_resolve_links(spark, d):
    return _links(spark, d).select("response_id", "base", "rel", U.resolve(F.col("base"), F.col("rel")).alias("resolved"))


@query
def link_in_degree(spark, d):
    found = _links(spark, d).select("response_id", U.resolve(F.col("base"), F.col("rel")).alias("link")).where("link <> ''").distinct()
    return found.groupBy("link").agg(F.count(F.lit(1)).alias("pages"))


@query
def dot_segments(spark, d):
    return _links(spark, d).select("rel").distinct().select("rel", U.remove_dot_segments(F.col("rel")).alias("path"))


# HTML


@query
def html_title(spark, d):
    return _pages(spark, d).select("page_id", H.title(F.col("html")).alias("title"))


@query
def html_body_text(spark, d):
    return _pages(spark, d).select("page_id", H.body_text(F.col("html")).alias("body_text"))


@query
def html_links(spark, d):
    return _pages(spark, d).select("page_id", F.posexplode(H.links(F.col("html"))).alias("pos", "href")).select("page_id", F.col("pos").cast("long").alias("pos"), "href")


@query
def html_raw_links(spark, d):
    return _pages(spark, d).select("page_id", F.posexplode(H.raw_links(F.col("html"))).alias("pos", "href")).select("page_id", F.col("pos").cast("long").alias("pos"), "href")


@query
def html_parse_tree(spark, d):
    tree = H.parse_tree(F.col("html"))
    return _pages(spark, d).select("page_id", tree.alias("t")).select("page_id", "t.title", "t.body_text")


@query
def page_filter(spark, d):
    r = table(spark, d, "http_responses").withColumnRenamed("status_code", "status")
    return C.is_page(r).select("response_id").distinct()


@query
def parse_errors(spark, d):
    return P.parse_pages(_pages(spark, d)).select("page_id", "error")


@query
def process_docs(spark, d):
    return P.process(_pages(spark, d))


@query
def process_stats(spark, d):
    s = P.process_stats(_pages(spark, d))
    return s.select("processed", "skipped", F.round("avg_len", 4).alias("avg_len"))


@query
def page_index_search(spark, d):
    docs = P.process(_pages(spark, d))
    return S.top_k(I.build_index(docs), "museum archive", 20).select("doc_id", F.round("score", 6).alias("score"))


# crawl


def _robots(spark, d):
    """One file per host of the fetched pages, written from its name."""
    hosts = _urls(spark, d).select(U.domain(F.col("url")).alias("domain")).where("domain <> ''").distinct()
    text = F.concat(
        F.lit("# rules of "), "domain", F.lit("\nUser-Agent: other\nDisallow: /\nuser-agent: *\nDisallow:\nDISALLOW: /s # all of it\nAllow: /sensors\nDisallow: /"),
        F.substring("domain", 1, 1), F.lit("\r\nCrawl-delay: "), F.length("domain") % 4, F.lit(".5\nUser-agent: last\nDisallow: /a\n"),
    )
    return hosts.select("domain", text.alias("robots_txt"))


@query
def robots_rules(spark, d):
    return R.parse_rules(_robots(spark, d))


@query
def robots_filter(spark, d):
    return R.allowed(_urls(spark, d), R.parse_rules(_robots(spark, d))).select("url")


@query
def seed_urls(spark, d):
    return _docs(spark, d).where("url <> ''").select("url", F.col("doc_id").alias("seq"))


@query
def frontier_push(spark, d):
    seen = table(spark, d, "http_responses").select(U.normalize(F.col("url")).alias("url")).where("url <> ''").distinct()
    return Q.push(seen, seed_urls(spark, d))


@query
def frontier_counts(spark, d):
    front = Q.push(None, seed_urls(spark, d))
    return Q.counts(front, front.where("seq % 3 = 0"))


@query
def politeness_schedule(spark, d):
    return Q.schedule(Q.push(None, seed_urls(spark, d)))


@query
def crawl_links(spark, d):
    pages = _pages(spark, d).select("url", F.col("html").alias("body")).where("url IS NOT NULL")
    return C.page_links(pages).select("url", "link").distinct()


@query
def crawl_bfs(spark, d):
    r = table(spark, d, "http_responses")
    seeds = r.where("url IS NOT NULL").groupBy("url").agg(F.min("response_id").alias("seq"))
    answers = r.select("url", F.col("status_code").alias("status"), "body", "final_url", "content_type")
    return C.crawl(seeds, C.table_fetcher(answers), R.parse_rules(_robots(spark, d)), C.CrawlConfig(max_pages=10**6))


@query
def crawl_from_start_pages(spark, d):
    """What a crawl reaches from the first page of each host, exclusion rules fetched as hosts are met."""
    r = table(spark, d, "http_responses")
    first = r.where("url IS NOT NULL").groupBy(U.domain(F.col("url")).alias("domain")).agg(F.min(F.struct("response_id", "url")).alias("r")).where("domain <> ''")
    seeds = first.select("r.url", F.col("r.response_id").alias("seq"))
    answers = r.select("url", F.col("status_code").alias("status"), "body", "final_url", "content_type")
    files = _robots(spark, d).select(F.concat(F.lit("https://"), "domain", F.lit("/robots.txt")).alias("url"), F.lit(200).alias("status"), F.col("robots_txt").alias("body"), F.lit("").alias("final_url"), F.lit("text/plain").alias("content_type"))
    fetch = C.table_fetcher(answers.unionByName(files))
    return C.crawl(seeds, fetch, lambda urls: C.fetched_rules(urls, fetch), C.CrawlConfig(max_pages=10**6)).select("url")


# stores


@query
def stored_index_search(spark, d):
    """Ranking on an index written to storage: the terms reach the scan of the sorted postings."""
    path = f"{folder(spark, 'index')}"
    I.write_index(_index(spark, d), path)
    return S.top_k(I.read_index(spark, path), FLAGSHIP, 25).select("doc_id", F.round("score", 6).alias("score"))


@query
def stored_term_stats(spark, d):
    path = f"{folder(spark, 'index')}"
    I.write_index(_index(spark, d), path)
    return I.read_index(spark, path).term_stats.select("term", "df")


@query
def document_store(spark, d):
    """Documents written to a store and read from it."""
    path = folder(spark, "store")
    readers.write_documents(_docs(spark, d), path)
    return readers.documents(spark, path)


@query
def seeds_file(spark, d):
    """URLs written one a line and read as seeds."""
    path = folder(spark, "seeds")
    _docs(spark, d).where("url IS NOT NULL AND NOT contains(url, '\n')").select(F.col("url").alias("value")).write.text(path)
    return readers.seeds(spark, path).groupBy("url").agg(F.count(F.lit(1)).alias("n"))


@query
def dump_articles(spark, d):
    """Articles of an XML dump written from the documents."""
    path = folder(spark, "dump")
    rows = _docs(spark, d).where("title IS NOT NULL AND text IS NOT NULL").select(F.regexp_replace("title", r"\s+", " ").alias("title"), F.struct(F.regexp_replace("text", r"\s+", " ").alias("text")).alias("revision"))
    rows.write.format("xml").option("rowTag", "page").option("rootTag", "mediawiki").save(path)
    return readers.articles(readers.wiki_dump(spark, path))


# wiki dump


@query
def wiki_clean_text(spark, d):
    marked = F.concat(F.lit("{{box\n}} == Head == [[a|"), F.coalesce("title", F.lit("none")), F.lit("]] see http://x.test/y "), F.coalesce("text", F.lit("")))
    return _docs(spark, d).select("doc_id", W.clean_text(marked).alias("cleaned"))


@query
def wiki_articles(spark, d):
    titled = _docs(spark, d).select(F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("File:"), "title")).otherwise(F.col("title")).alias("title"), "text")
    return readers.articles(titled)


# skewed postings


@query
def p2_found(spark, d):
    return postings_skew.heavy_keys(table(spark, d, "postings"))


@query
def p2_term_results(spark, d):
    return postings_skew.term_results(table(spark, d, "postings"), table(spark, d, "term_entries"))


@query
def p2_document_results(spark, d):
    return postings_skew.document_results(table(spark, d, "postings"), table(spark, d, "doc_lengths"), table(spark, d, "hub_pages"))


def queries() -> dict[str, Query]:
    return {name: shipped(f) for name, f in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
