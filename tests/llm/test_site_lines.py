from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import site_lines as L

SCHEMA = "doc_id long, url string, source string, text string"


def brute(rows):
    sites, lines = defaultdict(set), defaultdict(set)
    split = {}
    for d, url, source, text in rows:
        site = url.lower().split("//")[1].split("/")[0].split(":")[0] if url else (source.strip().lower() if source is not None else None)
        if site is None:
            continue
        sites[site].add(d)
        split[d] = (site, L.lines_of(text) if text else [])
        for x in split[d][1]:
            if x:
                lines[site, x].add(d)
    return {(d, i) for d, (site, ls) in split.items() for i, x in enumerate(ls) if x and len(lines[site, x]) >= 5 and len(lines[site, x]) >= 0.05 * len(sites[site])}


def found(spark, rows):
    return {tuple(r) for r in L.repeated_lines(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_against_brute_force(spark):
    rows = []
    for i in range(150):
        url = f"http://{'ABab'[i % 2]}.test:80/p{i}" if i % 3 else None
        text = f"Own line {chr(97 + i % 26)}{i}\r\n  Share  THIS page {i} \n\nshort\n" + ("Legal notice of the site, all rights reserved by its owners and their heirs." if i % 4 else "") + ("\nrare one" if i < 4 else "") + "\nshort"
        rows.append((i, url, " A.test " if url is None else None, text))
    rows += [(1000, None, None, "short\nshort"), (1001, "http://a.test/", None, None), (1002, "http://a.test/", None, ""), (1003, "http://c.test/", "a.test", "short\nshort\nshort\nshort\nshort\nshort")]
    got = found(spark, rows)
    assert got == brute(rows) and got


def test_share_of_site_and_ties(spark):
    rows = [(i, "http://x.test/", None, "seen in five" if i < 5 else f"t{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(100)]
    assert found(spark, rows) == {(i, 0) for i in range(5)}
    assert found(spark, [*rows, (100, "http://x.test/", None, None)]) == set()


def test_repeated_rows_are_one_document(spark):
    rows = [(i, "http://x.test/", None, "four times only") for i in range(4)]
    assert found(spark, rows + rows + [(None, "http://x.test/", None, "four times only")] * 3) == set()
    assert len(found(spark, rows + rows + [(4, "http://x.test/", None, "four times only")])) == 5


def test_long_text_empty_table_and_clashing_columns(spark):
    rows = [(i, "http://x.test/", None, "word " * 60_000 + f"{chr(97 + i)}\nthe same end") for i in range(6)]
    assert {(d, n) for d, n in found(spark, rows)} == {(i, 1) for i in range(6)}
    assert found(spark, []) == set()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS site", "2 AS line", "3 AS line_no", "4 AS n")
    assert L.repeated_lines(df).count() == 6
    assert {r.text.endswith("same end") for r in L.without_repeated_lines(df).collect()} == {False}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab c", min_size=1, max_size=200), min_size=1, max_size=8))
def test_chunks_depend_on_the_line_alone(lines):
    import numpy as np

    def chunks(ls):
        ends = np.cumsum([len(x) for x in ls])
        s = L.codes("".join(ls))
        at = L.cuts(s, ends)
        h = L.chunk_hashes(s, at)
        last = np.searchsorted(at, ends) + 1
        return [h[a:b].tolist() for a, b in zip([0, *last[:-1]], last)]

    assert chunks(lines) == [chunks([x])[0] for x in lines]
