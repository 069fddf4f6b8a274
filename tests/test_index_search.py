import math

import pytest

from textloom.plans import index as I
from textloom.plans import search as S

DOCS = "doc_id long, url string, title string, text string"


def build(spark, *texts):
    return I.build_index(spark.createDataFrame([(i, None, None, t) for i, t in enumerate(texts)], DOCS))


def test_postings(spark):
    ix = build(spark, "search engine search", "search database")
    lists = {r.term: [tuple(p) for p in r.postings] for r in I.posting_lists(ix).collect()}
    assert lists == {"search": [(0, 2), (1, 1)], "engine": [(0, 1)], "database": [(1, 1)]}
    assert tuple(ix.corpus_stats.first()) == (2, 5, 2.5)
    assert tuple(I.longest_posting_list(ix).first()) == ("search", 2)
    assert I.vocabulary_size(ix).first()[0] == 3


@pytest.mark.parametrize("df,want", [(3049, 1.18159), (171, 4.05974), (8633, 0.140917), (1871, 1.66983), (7575, 0.271648), (1917, 1.64554), (157, 4.1449)])
def test_idf(spark, df, want):
    from pyspark.sql import functions as F

    got = spark.range(1).select(S.idf(F.lit(9939), F.lit(df))).first()[0]
    assert math.isclose(got, want, rel_tol=5e-6)


def test_ranking(spark):
    ix = build(spark, "machine learning", "machine machine machine", "gardening flowers")
    assert [(r.doc_id, r.score) for r in S.top_k(ix, "machine").collect()] == [(1, 0.6959669125), (0, 0.4991762683)]
    assert S.top_k(ix, "nonexistent").collect() == []
    assert S.top_k(ix, "the").collect() == []


def test_ties_and_repeats(spark):
    ix = build(spark, "machine learning", "machine", "learning", "")
    best = S.top_k(ix, ["machine", "learn"]).collect()
    assert best[0].doc_id == 0 and [r.doc_id for r in best[1:]] == [1, 2]
    once, twice = (S.score(ix, t).where("doc_id = 1").first()[1] for t in (["machine"], ["machine", "machine"]))
    assert math.isclose(twice, 2 * once, rel_tol=1e-9)


def test_stored_index_gives_the_same(spark, tmp_path, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    ix = I.build_index(docs)
    I.write_index(ix, str(tmp_path))
    stored = I.read_index(spark, str(tmp_path))
    for a, b in ((ix.postings, stored.postings), (ix.term_stats, stored.term_stats), (ix.doc_lengths, stored.doc_lengths), (ix.corpus_stats, stored.corpus_stats)):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert S.top_k(ix, "archive canvas").collect() == S.top_k(stored, "archive canvas").collect()
    plan = stored.postings.where("term = 'archive'")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,archive)]" in plan
    sums = ix.postings.groupBy("doc_id").sum("tf").collect()
    lengths = {r.doc_id: r.doc_len for r in ix.doc_lengths.collect()}
    assert all(lengths[r[0]] == r[1] for r in sums)


def test_empty_store(spark):
    ix = build(spark)
    assert tuple(ix.corpus_stats.first()) == (0, 0, 0.0)
    assert ix.postings.count() == 0 and S.top_k(ix, "x1").collect() == []


def test_result_page_skips_missing_documents(spark):
    ix = build(spark, "alpha beta", "alpha")
    store = spark.createDataFrame([(0, None, "t", "alpha beta")], DOCS)
    page = S.search(ix, store, "alpha").collect()
    assert [(r["rank"], r.doc_id, r.title) for r in page] == [(2, 0, "t")]
