import pytest

from textloom.llm import queries

CASES = sorted(set(queries.queries()) & set(queries.oracle_sql()))


@pytest.mark.parametrize("name", CASES)
def test_same_as_sql(name, same_as_sql):
    same_as_sql(queries.queries()[name], queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_runs_over_whole_tables(name, spark, data):
    df = queries.queries()[name](spark, data)
    assert df.count() > 0


@pytest.mark.parametrize("name,columns", [
    ("p1_found", ["term", "mark"]), ("p3_found", ["doc_id", "field"]), ("p4_found", ["doc_id"]), ("p5_found", ["doc_id", "line_no"]), ("p6_found", ["origin", "record_id", "line_no"]), ("p8_found", ["doc_id", "item_id"]),
    ("p9_found", ["doc_id_a", "doc_id_b"]),
])
def test_found_columns(name, columns, spark, data):
    assert queries.queries()[name](spark, data).columns == columns
