"""Per-term and per-document results over a skewed postings table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators import skew
from textloom.runtime import materialize, tasks


def clean_term(term: Column) -> Column:
    """Trimmed (blanks, tabs, line ends, no-break spaces) and lower-cased term."""
    return F.lower(F.regexp_replace(term, r"^[\s ]+|[\s ]+$", ""))


def valid_postings(postings: DataFrame) -> DataFrame:
    """Rows that count: ``term_freq`` at least 1, a ``doc_id`` and a non-blank term."""
    out = postings.select(clean_term(F.col("term")).alias("term"), "doc_id", "term_freq", "segment_id", "indexed_at")
    return out.where((F.col("term_freq") >= 1) & F.col("doc_id").isNotNull() & (F.col("term") != ""))


def distinct_pairs(postings: DataFrame) -> DataFrame:
    return valid_postings(postings).select("term", "doc_id").distinct()


def _loads(pairs: DataFrame, key: str) -> DataFrame:
    return pairs.groupBy(key).agg(F.count(F.lit(1)).alias("w"))


def key_loads(postings: DataFrame, keys: tuple[str, ...] = ("term", "doc_id")) -> tuple[DataFrame, dict[str, skew.LoadPlan]]:
    """Distinct pairs (written once to shared storage) and a load plan for each of ``keys``."""
    pairs = materialize(distinct_pairs(postings), "pairs")
    n = tasks(pairs)
    return pairs, {k: skew.plan_load(_loads(pairs, k), k, "w", n) for k in keys}


def heavy_keys(postings: DataFrame, share: float = 0.01) -> DataFrame:
    """Keys holding at least ``share`` of all distinct pairs: ``(key_kind, key_value)``.

    Blank terms, missing ids and frequencies below 1 are left out; repeated rows
    count once; ties at the limit are all listed; an empty table gives no rows.
    """
    pairs, plans = key_loads(postings)
    out = None
    for kind, key, other in (("term", "term", "doc_id"), ("doc", "doc_id", "term")):
        counts = skew.balanced_counts(pairs, key, [other], plans[key])
        part = counts.where(F.col("n_rows") >= F.lit(share * plans[key].total)).select(F.lit(kind).alias("key_kind"), F.col(key).cast("string").alias("key_value"))
        out = part if out is None else out.unionByName(part)
    return out


def term_results(postings: DataFrame, term_entries: DataFrame) -> DataFrame:
    """Per term: pairs, and the writers' own count summed over segments, joined without skew.

    ``(term, n_docs, posting_count, n_segments)``; a term no segment lists has nulls.
    """
    pairs, plans = key_loads(postings, ("term",))
    own = (
        term_entries.select(clean_term(F.col("term")).alias("term"), "posting_count", "segment_id").groupBy("term")
        .agg(F.sum("posting_count").alias("posting_count"), F.countDistinct("segment_id").alias("n_segments"))
    )

    def per_shard(joined: DataFrame) -> DataFrame:
        return materialize(joined.groupBy("term", F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.max("posting_count").alias("pc"), F.max("n_segments").alias("ns")), "shards")

    part = skew.fragment_replicate_join(pairs, own, "term", plans["term"], ["doc_id"], "left", per_shard)
    return part.groupBy("term").agg(F.sum("n").alias("n_docs"), F.max("pc").alias("posting_count"), F.max("ns").alias("n_segments"))


def document_results(postings: DataFrame, doc_lengths: DataFrame, hub_pages: DataFrame) -> DataFrame:
    """Per document: distinct terms and its recorded length: ``(doc_id, n_terms, doc_len, is_hub)``.

    A document with several lengths takes the largest; a missing one stays null.
    """
    pairs, plans = key_loads(postings, ("doc_id",))
    lens = doc_lengths.groupBy("doc_id").agg(F.max("doc_len").alias("doc_len"), F.lit(False).alias("hub"))
    side = lens.unionByName(hub_pages.select("doc_id", F.lit(None).cast("long").alias("doc_len"), F.lit(True).alias("hub")))
    side = side.groupBy("doc_id").agg(F.max("doc_len").alias("doc_len"), F.max("hub").alias("hub"))

    def per_shard(joined: DataFrame) -> DataFrame:
        return materialize(joined.groupBy("doc_id", F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.max("doc_len").alias("doc_len"), F.max("hub").alias("hub")), "shards")

    part = skew.fragment_replicate_join(pairs, side, "doc_id", plans["doc_id"], ["term"], "left", per_shard)
    return part.groupBy("doc_id").agg(F.sum("n").alias("n_terms"), F.max("doc_len").alias("doc_len"), F.coalesce(F.max("hub"), F.lit(False)).alias("is_hub"))
