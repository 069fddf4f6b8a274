"""Defined results for nulls, repeated rows, empty tables and clashing columns, operator by operator."""

import pytest

from textloom.llm import leakage, main_body, mojibake, packing, residue, shared_spans, site_lines

DOC = "doc_id long, url string, source string, title string, text string"
CLASH = "1 AS n, 'x' AS site, 2 AS key, 3 AS line_no, 4 AS h, 'y' AS origin, 5 AS record_id, 6 AS len, 7 AS field, 8 AS w, 9 AS line, true AS first, 'z' AS term, 10 AS piece_no, 11 AS rep"


def none(spark, schema):
    return spark.createDataFrame([], schema)


@pytest.fixture
def side(spark):
    return (none(spark, "response_id long, title string, body_text string, links array<string>"), none(spark, "response_id long, url string, status_code int, body string, final_url string, content_type string"))


@pytest.fixture
def items(spark):
    return spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve thirteen"), (2, None), (None, "x")], "item_id long, text string")


def operators(side, items):
    return {
        "p3": lambda d: mojibake.garbled_fields(d), "p4": lambda d: residue.residue_documents(d, *side), "p5": lambda d: site_lines.repeated_lines(d), "p6": lambda d: main_body.furniture_lines(d, *side), "p7": lambda d: packing.containers(d), "p8": lambda d: leakage.leaked_documents(d, items),
        "p9": lambda d: shared_spans.sharing_pairs(d), "p9s": lambda d: shared_spans.shared_shares(d),
    }


@pytest.mark.parametrize("name", ["p3", "p4", "p5", "p6", "p7", "p8", "p9", "p9s"])
def test_odd_rows(name, spark, side, items):
    op = operators(side, items)[name]
    assert op(none(spark, DOC)).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, None), (2, "", "", "", ""), (3, "http://", "  ", "\n", " \r\n\t\n")], DOC)
    kept = op(nulls).collect()
    assert name == "p7" and len(kept) == 4 or kept == []
    words = "one two three four five six seven eight nine ten eleven twelve thirteen. "
    docs = spark.createDataFrame([(1, "http://a.test/", None, "T", words * 20 + "\nEnd"), (2, "http://a.test/", None, "T", words * 20 + "\nEnd"), (3, None, "a.test", None, "long " * 40_000)], DOC)
    once = sorted(map(tuple, op(docs).collect()), key=repr)
    assert sorted(map(tuple, op(docs.selectExpr("*", *CLASH.split(", "))).collect()), key=repr) == once
    if name != "p7":
        assert sorted(map(tuple, op(docs.unionAll(docs)).collect()), key=repr) == once
