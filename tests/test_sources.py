import bz2

from textloom import cli
from textloom.plans import index as I
from textloom.sources import readers
from textloom.streaming import ingest


def test_seeds(spark, tmp_path):
    (tmp_path / "s.txt").write_text("http://a.com\n\nhttp://b.com\n")
    assert [r.url for r in readers.seeds(spark, str(tmp_path / "s.txt")).orderBy("seq").collect()] == ["http://a.com", "http://b.com"]


def test_html_folder(spark, tmp_path):
    (tmp_path / "3.html").write_text("<p>three</p>")
    (tmp_path / "x.htm").write_text("<p>x</p>")
    got = {r.url: (r.page_id, r.html) for r in readers.html_folder(spark, str(tmp_path)).collect()}
    assert got["3.html"] == (3, "<p>three</p>") and got["x.htm"][1] == "<p>x</p>"


def test_wiki_dump(spark, tmp_path):
    page = "<page><title>{}</title><revision><text>{}</text></revision></page>"
    pages = [("A", "{{t}}One [[b|two]] == H == http://x.y end"), ("B", "#REDIRECT [[A]]"), ("File:C", "x"), ("D", "{{only}}")]
    path = tmp_path / "d.xml.bz2"
    path.write_bytes(bz2.compress(("<mediawiki>" + "".join(page.format(*p) for p in pages) + "</mediawiki>").encode()))
    got = readers.articles(readers.wiki_dump(spark, str(path))).collect()
    assert [tuple(r) for r in got] == [("A", "One two end")]


def test_command_line(spark, tmp_path, capsys):
    raw, docs, index = (str(tmp_path / x) for x in ("raw", "docs", "index"))
    (tmp_path / "raw").mkdir()
    for i, t in enumerate(("archive of maps", "other words", "archive archive")):
        (tmp_path / "raw" / f"{i}.html").write_text(f"<title>T{i}</title><p>{t}</p>")
    assert cli.main(["process", "--input", raw, "--output", docs]) == 0
    assert cli.main(["index", "--docs", docs, "--output", index]) == 0
    assert cli.main(["search", "--docs", docs, "--index", index, "--query", "archive", "--top", "1"]) == 0
    assert "[2] T2" in capsys.readouterr().out
    assert cli.main(["search", "--docs", docs, "--index", index, "--query", "the"]) == 1


def test_streaming_index(spark, tmp_path):
    rows = [(i, f"http://a.com/{i % 3}", f"<p>word{i} shared</p>", "2025-01-01 00:00:00") for i in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, t string").selectExpr("page_id", "url", "html", "timestamp(t) AS fetched_at")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    pages = ingest.distinct_pages(ingest.page_stream(spark, str(tmp_path / "in")))
    q = ingest.start_index(pages, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out/docs")).count() == 3
    postings = spark.read.parquet(str(tmp_path / "out/postings"))
    assert postings.where("term = 'shared' OR term = 'shar'").count() == 3


def test_polite_stream(spark, tmp_path):
    rows = [("u1", "a", 0), ("u2", "a", 10), ("u3", "b", 5), ("u4", "a", 500)]
    spark.createDataFrame(rows, "url string, domain string, at_ms long").coalesce(1).write.parquet(str(tmp_path / "in"))
    urls = spark.readStream.schema("url string, domain string, at_ms long").parquet(str(tmp_path / "in"))
    q = ingest.polite(urls).writeStream.format("memory").queryName("polite_out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {r.url: r.ready_ms for r in spark.sql("SELECT * FROM polite_out").collect()}
    assert got == {"u1": 0, "u2": 100, "u3": 5, "u4": 500}


def test_numbers_are_dense(spark):
    from textloom.plans.process import number

    got = number(spark.range(1000, 0, -1, 7).withColumnRenamed("id", "k"), "k").orderBy("k").collect()
    assert [r.doc_id for r in got] == list(range(1000))


def test_postings_view_keeps_order(spark):
    docs = spark.createDataFrame([(9, None, None, "bb aa"), (3, None, None, "bb")], readers.DOCUMENT)
    assert [p.doc_id for p in I.posting_lists(I.build_index(docs)).where("term = 'bb'").first().postings] == [3, 9]
