import pytest

from pyspark.sql import functions as F
from textloom.functions import html as H
from textloom.plans import process as P

PAGES = [
    ("<html><head><title>My page</title></head><body><p>Hello world</p><a href='https://x.com'>x</a></body></html>", "My page", "Hello world x ", ["https://x.com"]),
    ("<body><script>var a = '<p>no</p>';</script><style>p{}</style><p>Visible text</p><noscript>off</noscript></body>", "", "Visible text ", []),
    ("<p>Tom &amp; Jerry &lt;Cartoon&gt;</p>", "", "Tom & Jerry <Cartoon> ", []),
    ("<p><b>foo</b>bar</p>", "", "foo bar ", []),
    ("<p>…</p>", "", "", []),
    ("", "", "", []),
    ("<p>a<!-- x -->b\nc</p>cut <b", "", "a b c cut  ", []),
    ("<p>&amp;lt;x&#65;y&amp;#66;</p>\x00gone", "", "<xAyB ", []),
    ("<title>A</title><svg><title>B</title></svg><a class=k HREF=/q>go</a>", "AB", "go ", ["/q"]),
]


@pytest.mark.parametrize("page,title,body,links", PAGES)
def test_parse(spark, page, title, body, links):
    df = spark.createDataFrame([(page,)], "h string")
    got = df.select(H.title(F.col("h")), H.body_text(F.col("h")), H.links(F.col("h"))).first()
    assert got[0] == title
    assert got[1].replace("  ", " ") == body.replace("  ", " ")
    assert got[2] == links


def test_full_entities(spark):
    df = spark.createDataFrame([("<title>&eacute;</title><p>caf&eacute; &copy; &#x41;</p>",)], "h string")
    assert tuple(df.select(H.title(F.col("h"), True), H.body_text(F.col("h"), True)).first()) == ("é", "café © A ")


def test_tree_and_lexer_agree(spark, data):
    from textloom.sources import readers

    pages = readers.response_pages(spark.read.parquet(f"{data}/http_responses.parquet"))
    both = pages.select(H.body_text(F.col("html")).alias("a"), H.parse_tree(F.col("html")).alias("t"))
    assert both.where("coalesce(a, '') <> t.body_text").count() == 0


def test_process_numbers_and_errors(spark):
    rows = [(5, "u5", "<p>five</p>"), (1, "u1", None), (2, "u2", "<p>--</p>"), (3, None, "<title>t</title><p>three</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert [(r.doc_id, r.url, r.text) for r in P.process(pages).orderBy("doc_id").collect()] == [(0, None, "three "), (1, "u5", "five ")]
    assert {r.page_id: r.error for r in P.parse_pages(pages).collect()} == {5: None, 1: "NotFound", 2: "Empty", 3: None}
    assert tuple(P.process_stats(pages).first()) == (2, 2, 5.5)
    assert P.process(pages.limit(0)).count() == 0
    assert P.sample_documents(P.process(pages.limit(0))).count() == 0


def test_references_and_quoted_tag_ends(spark):
    page = """<title>A &eacute;&#x41;&notit; b</title><p title="1 > 0" class='x>y'>caf&eacute; &euro;5 &#8364; it&rsquo;s &amp;lt;</p><a title=">" href='/a?x=1&amp;y=&eacute;'>l</a><a href=/plain>m</a>"""
    row = spark.createDataFrame([(page,), ("<p>plain &gt; text",), (None,)], "html string").select(H.title(F.col("html")).alias("t"), H.body_text(F.col("html")).alias("b"), H.links(F.col("html")).alias("l")).collect()
    assert row[0].t == "A éA¬it; b" and row[0].b == "café €5 € it’s < l m " and row[0].l == ["/a?x=1&y=é", "/plain"]
    assert row[1].b == "plain > text " and row[1].l == [] and row[2] == (None, None, None)
