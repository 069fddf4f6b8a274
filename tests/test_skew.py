from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.operators import skew
from textloom.plans import postings_skew


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(0, 63), st.integers(1, 50)), st.dictionaries(st.text("ab", min_size=1, max_size=3), st.integers(51, 2000), max_size=5))
def test_packing_is_balanced(bins, heavy):
    plan = skew.pack(bins, heavy, 4)
    fair = -(-(sum(bins.values()) + sum(heavy.values())) // 4)
    load = Counter()
    for b, t in enumerate(plan.bins):
        load[t] += bins.get(b, 0)
    for key, shards in plan.heavy.items():
        for t in shards:
            load[t] += heavy[key] / len(shards)
    assert set(plan.heavy) == set(heavy)
    assert max(load.values(), default=0) <= 2 * fair + 50


def postings(spark, rows):
    return spark.createDataFrame(rows, "term string, doc_id long, term_freq long, segment_id int, indexed_at timestamp")


def test_heavy_keys(spark):
    rows = [(" Hot\t", i, 1, 0, None) for i in range(300)] + [("hot", i, 2, 1, None) for i in range(300)] + [(f"t{i}", 7, 1, 0, None) for i in range(200)] + [(f"u{i}", 1000 + i, 1, 0, None) for i in range(100)]
    rows += [(None, 1, 1, 0, None), ("x", None, 1, 0, None), ("x", 1, 0, 0, None), ("  ", 1, 1, 0, None), ("y", 2, None, 0, None)]
    got = {(r.key_kind, r.key_value) for r in postings_skew.heavy_keys(postings(spark, rows)).collect()}
    assert got == {("term", "hot"), ("doc", "7")}
    assert postings_skew.heavy_keys(postings(spark, [])).count() == 0


def test_split_key_meets_its_match_once(spark):
    large = spark.createDataFrame([("h", i) for i in range(500)] + [("a", 1), ("b", 2), (None, 3)], "k string, v long")
    small = spark.createDataFrame([("h", 10), ("a", 11), ("c", 12)], "k string, v long")
    loads = large.groupBy("k").count()
    plan = skew.plan_load(loads, "k", "count", 4)
    assert len(plan.heavy["h"]) > 1
    joined = skew.fragment_replicate_join(large, small, "k", plan, ["v"]).collect()
    assert Counter(r.k for r in joined) == {"h": 500, "a": 1} and {r.v_m for r in joined} == {10, 11}
    exchanges = skew.fragment_replicate_join(large, small, "k", plan, ["v"], reduce=lambda df: df._jdf.queryExecution().executedPlan().toString()).count("shufflepartitionidpassthrough")
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
    assert exchanges in (1, 2)  # rows stay in their tasks; a tiny side may be broadcast instead
    left = skew.fragment_replicate_join(large, small, "k", plan, ["v"], "left")
    assert left.count() == 503
    tasks = skew.fragment(large, "k", plan, ["v"]).where("k = 'h'").groupBy("__task").count().collect()
    assert len(tasks) == len(set(plan.heavy["h"])) and max(r["count"] for r in tasks) < 300
