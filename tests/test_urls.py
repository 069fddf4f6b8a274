from pyspark.sql import functions as F
from textloom.functions import urls as U

NORMAL = {
    "HTTP://Example.COM/Page/": "http://example.com/Page", "http://x.com/a#frag": "http://x.com/a", "http://x.com:80/a": "http://x.com/a", "https://x.com:443/a": "https://x.com/a", "https://Example.COM/": "https://example.com/",
    "mailto:a@b": "", "javascript:x": "", "ftp://x/y": "", "https://example.com:8080/a/b": "https://example.com:8080/a/b", "https://127.0.0.1:3000/test": "https://127.0.0.1:3000/test", "invalid-url": "",
    "http://x.com?q=1": "http://x.com/?q=1", "http://x.com:/a": "http://x.com/a", "http://x.com/%7Euser/%2F%41": "http://x.com/~user/%2FA", "http://x.com/a//": "http://x.com/a/", "http://x.com/a/../b": "http://x.com/a/../b",
    "http://x.com/a?": "http://x.com/a", "http://x.com/a/?b=%41#f": "http://x.com/a?b=%41", "http://u:p@h.com/x": "http://u:p@h.com/x", "http://[::1]:80/": "http://[::1]:80/",
}
DOMAIN = {"http://u:p@h.com/x": "u", "http://[::1]:80/": "[", "https://127.0.0.1:3000/test": "127.0.0.1", "ftp://x/y": "", "HTTP://Example.COM/Page/": "example.com"}
RESOLVED = [
    ("https://en.wikipedia.org/wiki/A", "/wiki/B", "https://en.wikipedia.org/wiki/B"), ("https://en.wikipedia.org/wiki/A", "B", "https://en.wikipedia.org/wiki/B"), ("https://example.com/a/b/c", "d", "https://example.com/a/b/d"),
    ("https://example.com/a/b", "https://google.com/x", "https://google.com/x"), ("https://example.com/a/b", "//cdn.example.com/file.js", "https://cdn.example.com/file.js"), ("https://e.com/a/b", "../c", "https://e.com/c"),
    ("https://e.com/a/b", "../../../c", "https://e.com/c"), ("https://e.com/a/b", "#top", "https://e.com/a"), ("https://e.com/a/b", "", "https://e.com/a"), ("https://e.com/a/b", "?q=1", "https://e.com/a?q=1"),
    ("https://e.com/a/b", "mailto:x@y", "https://e.com/a/mailto:x@y"), ("https://e.com/a/b", "/r?u=http://z/../w", "https://e.com/r?u=http:/w"), ("https://e.com/a/b", "HTTP://Z.com/x", "https://e.com/a/HTTP:/Z.com/x"),
    ("https://e.com:8443/a/b?x=1", "c/", "https://e.com:8443/a/c"), ("https://e.com", "x", "https://e.com/x"), ("nothing", "x", ""),
]


def test_normalize(spark):
    df = spark.createDataFrame(list(NORMAL.items()), "url string, want string").withColumn("got", U.normalize(F.col("url")))
    assert df.where("got <> want").collect() == []
    assert spark.createDataFrame([(None,)], "url string").select(U.normalize(F.col("url"))).first()[0] is None


def test_domain(spark):
    df = spark.createDataFrame(list(DOMAIN.items()), "url string, want string").withColumn("got", U.domain(F.col("url")))
    assert df.where("got <> want").collect() == []


def test_resolve(spark):
    df = spark.createDataFrame(RESOLVED, "base string, rel string, want string").withColumn("got", U.resolve(F.col("base"), F.col("rel")))
    assert df.where("got <> want").collect() == []


def test_components_of_invalid_url(spark):
    assert spark.createDataFrame([("x",), (None,)], "url string").select(U.components(F.col("url")).alias("c")).where("c IS NOT NULL").count() == 0
