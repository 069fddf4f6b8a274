"""BM25 ranking and the result page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.plans.index import Index
from textloom.runtime import materialize

K1 = 1.2
B = 0.75
SCORES = "doc_id long, score double"


def idf(n: Column, df: Column) -> Column:
    return F.log(F.lit(1) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def term_weight(tf: Column, doc_len: Column, avg: Column, k1: float = K1, b: float = B) -> Column:
    return tf * F.lit(k1 + 1) / (tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * doc_len / avg))


def idf_table(index: Index) -> DataFrame:
    """``(term, df, idf)`` of the whole vocabulary."""
    stats = index.corpus_stats.first()
    return index.term_stats.select("term", "df", idf(F.lit(stats["doc_count"] if stats else 0), F.col("df")).alias("idf"))


def score(index: Index, query: str | list[str], k1: float = K1, b: float = B) -> DataFrame:
    """``(doc_id, score)`` of every document with a query term.

    Terms are joined by OR; a repeated query term counts repeatedly; unknown terms add
    nothing; a query without terms gives no rows.  Scores are rounded to ten decimals.
    """
    terms = T.tokenize_py(query) if isinstance(query, str) else list(query)
    spark = index.postings.sparkSession
    if not terms:
        return spark.createDataFrame([], SCORES)
    stats = index.corpus_stats.first()
    # the filter reaches the scan; the few postings left are read twice below
    hits = materialize(index.postings.where(F.col("term").isin(sorted(set(terms)))), "hits")
    counts = {r["term"]: r["df"] for r in hits.groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}  # one row a query term
    weight = F.lit(0.0)
    for term, df in sorted(counts.items()):
        weight = F.when(F.col("term") == term, idf(F.lit(stats["doc_count"]), F.lit(df)) * F.lit(terms.count(term))).otherwise(weight)
    part = weight * term_weight(F.col("tf"), F.col("doc_len"), F.lit(stats["avg_doc_length"]), k1, b)
    return hits.groupBy("doc_id").agg(F.round(F.sum(part), 10).alias("score"))


def top_k(index: Index, query: str | list[str], k: int = 10, k1: float = K1, b: float = B) -> DataFrame:
    """The ``k`` best documents; equal scores in order of ``doc_id``."""
    return score(index, query, k1, b).orderBy(F.desc(F.round("score", 6)), "doc_id").limit(k)


def search(index: Index, docs: DataFrame, query: str, k: int = 10) -> DataFrame:
    """Result page ``(rank, score, doc_id, title, snippet)``; a document gone from the store keeps its rank unused."""
    best = top_k(index, query, k)
    order = Window.orderBy(F.desc(F.round("score", 6)), "doc_id")  # at most k rows
    ranked = best.withColumn("rank", F.row_number().over(order).cast("long"))
    page = F.broadcast(ranked).join(docs.select("doc_id", "title", "text"), "doc_id")
    return page.select("rank", "score", "doc_id", "title", T.snippet(F.coalesce("text", F.lit(""))).alias("snippet")).orderBy("rank")
