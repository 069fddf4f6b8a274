import os

import pytest

from textloom import queries

CASES = sorted(set(queries.queries()) & set(queries.oracle_sql()))


@pytest.mark.parametrize("name", CASES)
def test_same_as_sql(name, same_as_sql):
    same_as_sql(queries.queries()[name], queries.oracle_sql()[name])


def test_every_sql_has_a_query():
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["rank", "score", "doc_id", "title", "snippet"]
    assert df.count() > 0


def test_crawl_reaches_every_page_once(spark, data):
    pages = queries.queries()["crawl_bfs"](spark, data).collect()
    assert len({r.url for r in pages}) == len(pages) > 0
    assert sorted(r.page_id for r in pages) == list(range(len(pages)))


def test_core_does_not_import_llm():
    root = os.path.dirname(queries.__file__)
    for folder, _, files in os.walk(root):
        if os.sep + "llm" in folder[len(root) :]:
            continue
        for f in files:
            if f.endswith(".py"):
                assert "textloom.llm" not in open(os.path.join(folder, f)).read()
