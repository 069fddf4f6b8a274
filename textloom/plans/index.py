"""Inverted index: postings, term statistics, document lengths and corpus statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.runtime import spread


@dataclass
class Index:
    """``postings`` (term, doc_id, tf, doc_len), ``term_stats`` (term, df), ``doc_lengths``
    (doc_id, doc_len) and the one-row ``corpus_stats``."""

    postings: DataFrame
    term_stats: DataFrame
    doc_lengths: DataFrame
    corpus_stats: DataFrame


def indexed_text(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)``: title and body joined by a blank, nulls as empty text."""
    return docs.select("doc_id", F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"))


def kept_tokens(docs: DataFrame) -> DataFrame:
    """``(doc_id, pos, raw)`` of the kept tokens before stemming."""
    each = indexed_text(docs).select("doc_id", F.posexplode(T.raw_tokens(F.col("text"))).alias("pos", "t"))
    return each.select("doc_id", "pos", F.lower("t").alias("raw")).where(~T.is_stop_word(F.col("raw")))


def term_frequencies(docs: DataFrame) -> DataFrame:
    """``(doc_id, term, tf)``.

    Texts are placed by document once; counting raw tokens and then stems (far fewer)
    needs no further shuffle.
    """
    placed = docs.select("doc_id", "title", "text").repartition("doc_id")
    raw = kept_tokens(placed).groupBy("doc_id", "raw").agg(F.count(F.lit(1)).alias("n"))
    return raw.select("doc_id", T.stem(F.col("raw")).alias("term"), "n").groupBy("doc_id", "term").agg(F.sum("n").alias("tf"))


def document_lengths(docs: DataFrame) -> DataFrame:
    """``(doc_id, doc_len)``: kept tokens with duplicates; documents without any have 0."""
    lowered = F.transform(T.raw_tokens(F.col("text")), lambda t: F.lower(t))
    kept = F.filter(lowered, lambda t: ~T.is_stop_word(t))
    return indexed_text(spread(docs)).select("doc_id", F.size(kept).cast("long").alias("doc_len"))


def corpus_statistics(lengths: DataFrame) -> DataFrame:
    """One row ``(doc_count, total_tokens, avg_doc_length)``; the average of no documents is 0."""
    return lengths.agg(
        F.count(F.lit(1)).alias("doc_count"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("total_tokens"), F.coalesce(F.sum("doc_len") / F.count(F.lit(1)), F.lit(0.0)).alias("avg_doc_length")
    )


def build_index(docs: DataFrame) -> Index:
    tf = term_frequencies(docs)
    lengths = document_lengths(docs)
    # a document's length is the sum of its own frequencies: its rows are already placed together
    postings = tf.select("term", "doc_id", "tf", F.sum("tf").over(Window.partitionBy("doc_id")).alias("doc_len"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return Index(postings, df, lengths, corpus_statistics(lengths))


def write_index(index: Index, path: str) -> None:
    """Store an index; postings are range-partitioned and sorted, so a term lies in few row groups."""
    index.postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
    stored = index.postings.sparkSession.read.parquet(f"{path}/postings")
    stored.groupBy("term").agg(F.count(F.lit(1)).alias("df")).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/term_stats")
    index.doc_lengths.write.mode("overwrite").parquet(f"{path}/doc_lengths")
    lengths = stored.sparkSession.read.parquet(f"{path}/doc_lengths")
    corpus_statistics(lengths).write.mode("overwrite").parquet(f"{path}/corpus_stats")


def read_index(spark: SparkSession, path: str) -> Index:
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    return Index(read("postings"), read("term_stats"), read("doc_lengths"), read("corpus_stats"))


def vocabulary_size(index: Index) -> DataFrame:
    return index.term_stats.agg(F.count(F.lit(1)).alias("vocabulary_size"))


def longest_posting_list(index: Index) -> DataFrame:
    """``(term, df)`` of the most frequent term; ties go to the smaller term."""
    return index.term_stats.orderBy(F.desc("df"), "term").limit(1)


def posting_lists(index: Index) -> DataFrame:
    """Grouped view ``(term, postings)``, each list sorted by document; meant for selected terms."""
    return index.postings.groupBy("term").agg(F.sort_array(F.collect_list(F.struct("doc_id", "tf"))).alias("postings"))
