import datetime as dt
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.llm import term_counts as C

SCHEMA = "term string, doc_id long, term_freq long, segment_id int, indexed_at timestamp"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("abc", max_size=6), st.integers(1, 5))), st.integers(1, 4))
def test_trie_counts_like_a_dictionary(rows, limit):
    trie, want = C.BurstTrie(limit), defaultdict(lambda: [0, 0])
    for term, n in rows:
        trie.add(term, n, 1)
        want[term][0] += n
        want[term][1] += 1
    assert list(trie.items()) == sorted(want.items())


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_counts_against_brute_force(spark):
    t = [dt.datetime(2025, 1, d) for d in (1, 2, 3)]
    rows = [(w, d, 1 + (i % 3), i % 2, t[i % 3]) for i, (w, d) in enumerate((w, d) for w in ("aa", " AB ", "abc", "b", "日本", "hot") for d in range(1 if w == "b" else 40))]
    rows += [("hot", d, 2, 0, t[0]) for d in range(3000)] + rows[:20] + [(None, 1, 1, 0, t[0]), ("x", None, 1, 0, t[0]), ("x", 1, 0, 0, t[0]), ("x", 1, None, 0, t[0]), (" \t", 1, 5, 0, t[0]), ("y", 9, -1, 0, t[0])]
    last = {}
    for w, d, f, _, at in rows:
        if w and w.strip() and d is not None and f and f >= 1:
            k = (w.strip().lower(), d)
            last[k] = max(last.get(k, (dt.datetime.min, 0)), (at, f))
    freq, docs = Counter(), Counter()
    for (w, _), (_, f) in last.items():
        freq[w] += f
        docs[w] += 1
    n = len({d for _, d in last})
    got = {r.term: (r.total_freq, r.n_docs, r.mark) for r in C.term_counts(frame(spark, rows)).collect()}
    assert got == {w: (freq[w], docs[w], "rare" if docs[w] < 3 else "common" if docs[w] >= 0.2 * n else None) for w in docs}


def test_empty_table(spark):
    assert C.term_counts(frame(spark, [])).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("abc", max_size=6), st.integers(1, 5))), st.integers(1, 4), st.integers(1, 9))
def test_subtrees_hold_every_counter_once(rows, limit, most):
    trie = C.BurstTrie(limit)
    for term, n in rows:
        trie.add(term, n, 1)
    parts = trie.subtrees(most)
    assert sorted((p + suffix, c) for p, entries in parts for suffix, c in entries) == list(trie.items())
    assert all(len(entries) <= max(most, limit) for _, entries in parts)


def test_long_terms_with_one_beginning(spark):
    rows = [("x" * 3000 + str(i), i, 1, 0, None) for i in range(300)] + [("x" * 3000 + str(i), i + 1, 2, 0, None) for i in range(300)]
    got = {r.term: (r.total_freq, r.n_docs) for r in C.term_counts(frame(spark, rows)).collect()}
    assert got == {"x" * 3000 + str(i): (3, 2) for i in range(300)}


def test_large_term_and_large_prefix_are_cut(spark):
    """A hot term is one counter of each task; a prefix with many terms is routed by longer ones."""
    pairs = spark.createDataFrame([("hot", d, 1) for d in range(4000)] + [(f"w{d}", d, 1) for d in range(3000)] + [(chr(0x4E00 + d), d, 1) for d in range(3000)], "term string, doc_id long, tf long")
    subtrees = pairs.select("term", "tf").repartition(4).mapInArrow(C.count_in_tries, C._SUBTREES_SQL)
    assert subtrees.agg(F.sum("n")).first()[0] == 6004
    large = C.large_prefixes(subtrees, 1000)
    assert large == {"", "w", "w1", "w2"}
    routed = subtrees.mapInArrow(C.router(spark.sparkContext.broadcast(large)), C._ROUTED_SQL)
    load = routed.select("route", F.size("suffixes").alias("n")).groupBy("route").sum("n").collect()
    assert sum(r[1] for r in load) == 6004 and max(r[1] for r in load) < 1000
    merged = routed.repartition(4, "route").sortWithinPartitions("route").mapInArrow(C.merge_subtrees, C._COUNTED).collect()
    assert len(merged) == 6001 and {r.term: (r.total_freq, r.n_docs) for r in merged}["hot"] == (4000, 4000)
