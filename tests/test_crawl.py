from pyspark.sql import functions as F
from textloom.operators import frontier as Q
from textloom.operators import robots as R
from textloom.plans import crawl as C

ROBOTS = """# all
User-Agent: bot
Disallow: /x
USER-AGENT: *
Disallow: /private # not this
Disallow:
Allow: /private/open
Crawl-delay: 2
crawl-delay: abc
Disallow: /q?a
User-agent: foo
Disallow: /
"""


def rules(spark, *rows):
    return R.parse_rules(spark.createDataFrame(rows, "domain string, robots_txt string"))


def test_rules(spark):
    got = {r.domain: (r.disallow, r.crawl_delay_ms) for r in rules(spark, ("a.com", ROBOTS), ("b.com", None), ("c.com", "User-agent:*\nCrawl-delay: 1.5\r\nDisallow: /\r"), ("d.com", "User-agent: *\nCrawl-delay: 0")).collect()}
    assert got == {"a.com": (["/private", "/q?a"], 2000), "b.com": ([], 1000), "c.com": (["/"], 1000), "d.com": ([], 1000)}


def test_allowed(spark):
    urls = [("http://a.com/private/open",), ("http://A.com/public",), ("http://a.com/q?a=1",), ("http://a.com/q?b",), ("http://z.com/private",), ("bad",), (None,)]
    got = R.allowed(spark.createDataFrame(urls, "url string"), rules(spark, ("a.com", ROBOTS)))
    assert sorted(r.url for r in got.collect()) == ["http://A.com/public", "http://a.com/q?b", "http://z.com/private"]


def test_frontier(spark):
    urls = spark.createDataFrame([("http://a.com/x", 0), ("http://a.com/x/", 1), ("http://b.com/", 2), ("nope", 3)], "url string, seq long")
    front = Q.push(None, urls)
    assert sorted((r.url, r.domain, r.seq) for r in front.collect()) == [("http://a.com/x", "a.com", 0), ("http://b.com/", "b.com", 2)]
    assert Q.push(front, urls).count() == 0
    assert tuple(Q.counts(front, front.limit(0)).first()) == (2, 2)


def test_politeness(spark):
    rows = [(f"http://{h}.com/{i}", 10 * i + k) for i in range(5) for k, h in enumerate("ab")]
    got = Q.schedule(Q.push(None, spark.createDataFrame(rows, "url string, seq long")), 50).collect()
    assert max(r.ready_ms for r in got) == 200 and len(got) == 10


def site(spark):
    page = lambda *links: "".join(f'<a href="{x}">l</a>' for x in links) + "text"
    rows = [
        ("http://a.com/", 200, page("/1", "/2", "http://b.com/#f"), "text/html"), ("http://a.com/1", 200, page("/", "/3"), "text/html"), ("http://a.com/2", 404, "no", "text/html"),
        ("http://a.com/3", 200, page("/4"), "text/html; charset=x"), ("http://a.com/4", 200, "x", "application/pdf"), ("http://b.com/", 200, page("/secret", "/ok"), "text/html"), ("http://b.com/ok", 200, "end", "text/html"), ("http://b.com/secret", 200, "s", "text/html"),
    ]
    return spark.createDataFrame(rows, "url string, status int, body string, content_type string").withColumn("final_url", F.col("url"))


def test_crawl(spark):
    seeds = spark.createDataFrame([("http://A.com", 0), ("http://a.com/", 1)], "url string, seq long")
    no = rules(spark, ("b.com", "User-agent: *\nDisallow: /secret"))
    got = C.crawl(seeds, C.table_fetcher(site(spark)), no).orderBy("page_id").collect()
    assert [r.url for r in got] == ["http://a.com/", "http://a.com/1", "http://b.com/", "http://a.com/3", "http://b.com/ok"]
    assert C.crawl(seeds, C.table_fetcher(site(spark)), no, C.CrawlConfig(max_pages=2)).count() == 2


def test_fetch_errors_are_values(spark):
    def get(url):
        if url.endswith("bad"):
            raise TimeoutError
        return 200, "b", url, "text/html"

    rows = C.http_fetcher(get)(spark.createDataFrame([("http://a/bad",), ("http://a/ok",)], "url string")).collect()
    assert {r.url: (r.status, r.error) for r in rows} == {"http://a/bad": (None, "TimeoutError"), "http://a/ok": (200, None)}


def table(spark, rows):
    return C.table_fetcher(spark.createDataFrame([(u, s, b, u, "text/html") for u, s, b in rows], "url string, status int, body string, final_url string, content_type string"))


def test_long_chain(spark):
    pages = [(f"http://c.com/{i}", 200, f'<a href="/{i + 1}">n</a>') for i in range(12)]
    seeds = spark.createDataFrame([("http://c.com/0", 2**40)], "url string, seq long")
    got = C.crawl(seeds, table(spark, pages)).orderBy("page_id").collect()
    assert [r.url for r in got] == [p[0] for p in pages]


def test_budget_is_used_up(spark):
    """Seeds the budget had no place for are fetched after those that are no pages."""
    pages = [(f"http://d{i % 3}.com/{i}", 200 if i % 2 else 404, "x") for i in range(40)]
    seeds = spark.createDataFrame([(p[0], i) for i, p in enumerate(pages)], "url string, seq long")
    assert C.crawl(seeds, table(spark, pages), config=C.CrawlConfig(max_pages=20)).count() == 20
    assert C.crawl(seeds, table(spark, pages), config=C.CrawlConfig(max_pages=7)).count() == 7


def test_rules_of_hosts_met_later(spark):
    rows = [("http://e.com/", 200, '<a href="http://f.com/open">1</a><a href="http://f.com/no/1">2</a>'), ("http://f.com/open", 200, "x"), ("http://f.com/no/1", 200, "x")]
    fetch = table(spark, [*rows, ("https://f.com/robots.txt", 200, "User-agent: *\nDisallow: /no")])
    seeds = spark.createDataFrame([("http://e.com/", 0)], "url string, seq long")
    got = C.crawl(seeds, fetch, lambda urls: C.fetched_rules(urls, fetch)).collect()
    assert sorted(r.url for r in got) == ["http://e.com/", "http://f.com/open"]


def test_many_links_on_a_page(spark):
    links = "".join(f'<a href="/{i}">x</a>' for i in range(10_050))
    rows = [("http://g.com/", 200, links), ("http://g.com/10049", 200, "end"), ("http://h.com/", 200, '<a href="/1">x</a>'), ("http://h.com/1", 200, "y")]
    seeds = spark.createDataFrame([("http://g.com/", 0), ("http://h.com/", 1)], "url string, seq long")
    assert [r.url for r in C.crawl(seeds, table(spark, rows)).orderBy("page_id").collect()] == ["http://g.com/", "http://h.com/", "http://h.com/1", "http://g.com/10049"]


def test_no_seeds(spark):
    assert C.crawl(spark.createDataFrame([], "url string, seq long"), table(spark, [("http://a.com/", 200, "x")])).count() == 0


def test_polite_fetcher_waits(spark):
    import time

    def get(url):
        return 200, str(time.time()), url, "text/html"

    urls = spark.createDataFrame([("http://a.com/1", 0), ("http://a.com/2", 200), ("http://a.com/3", 400), ("http://b.com/1", 0)], "url string, ready_ms long")
    at = {r.url: float(r.body) for r in C.http_fetcher(get, 2, 200)(urls).collect()}
    assert at["http://a.com/2"] - at["http://a.com/1"] >= 0.19 and at["http://a.com/3"] - at["http://a.com/2"] >= 0.19


def test_crawl_has_no_depth_limit():
    assert C.CrawlConfig().max_rounds is None
