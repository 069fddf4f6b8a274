import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import wiki as W


def clean_one(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.c for r in df.select("i", W.clean_text(F.col("t")).alias("c")).orderBy("i").collect()]


def test_cases(spark):
    cases = {
        "{{box\n|x}} a": "a", "{{ a {{ b }} c }} d": "c }} d", "{{open [[x|y]]": "{{open y", "[[a|b|c]] [[d]] [[e|]] [[|f]] [[]] [[g": "b|c d e| f [[]] [[g", "see http://x.y/z, https://q more http": "see more http",
        "ahttp://b": "a", "== H ==\nbody": "body", "a ==b== c ===d": "a c ===d", "====": "", "===": "===", "== a\nb ==": "== a b ==", "x=1": "x=1", "": "", "  a \t\n b ": "a b", "[[ht|tp]]tp://x": "tptp://x", "{{{a}}} [[x]": "} [[x]",
    }
    assert clean_one(spark, *cases) == list(cases.values())
    assert clean_one(spark, None) == [None]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="{}[]|=h \na", max_size=40), min_size=200, max_size=200))
def test_balanced_markup_goes(spark, texts):
    """No closed template and no closed heading on a line is left, whatever surrounds it."""
    for t, c in zip(texts, clean_one(spark, *texts)):
        opened = t.find("{{")
        if opened >= 0 and "}}" in t[opened + 2 :] and "[" not in t:
            assert len(c) < len(re.sub(r"\s+", " ", t).strip())
        assert "  " not in c and c == c.strip()
