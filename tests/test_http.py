import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from textloom import cli
from textloom.plans import crawl as C
from textloom.sources import http


class Handler(BaseHTTPRequestHandler):
    def do_GET(self):
        host = f"http://127.0.0.1:{self.server.server_port}"
        if self.path.startswith("/loop"):
            self.send_response(302)
            self.send_header("Location", host + self.path + "x")
            self.end_headers()
            return
        if self.path == "/moved":
            self.send_response(301)
            self.send_header("Location", host + "/ok")
            self.end_headers()
            return
        body = {"/ok": f'<p>fine é</p><a href="{host}/two">2</a>', "/two": "<p>second</p>", "/big": "x" * 3000}.get(self.path)
        self.send_response(200 if body else 404)
        self.send_header("Content-Type", "text/html; charset=utf-8")
        self.end_headers()
        self.wfile.write((body or "none").encode())

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def host():
    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_get(host):
    assert http.get(host + "/ok")[:2][0] == 200 and "é" in http.get(host + "/ok")[1]
    assert http.get(host + "/moved")[2] == host + "/ok"
    assert http.get(host + "/none")[0] == 404
    with pytest.raises(http.HttpError):
        http.get(host + "/loop")
    with pytest.raises(http.HttpError):
        http.get(host + "/big", max_bytes=100)
    with pytest.raises(http.NetworkError):
        http.get("http://127.0.0.1:1/")
    with pytest.raises(http.NetworkError):
        http.get("nonsense")


def test_crawl_command(spark, host, tmp_path):
    (tmp_path / "seeds.txt").write_text(host + "/ok\n")
    assert cli.main(["crawl", "--seeds", str(tmp_path / "seeds.txt"), "--output", str(tmp_path / "pages"), "--threads", "2"]) == 0
    assert [r.url for r in spark.read.parquet(str(tmp_path / "pages")).orderBy("page_id").collect()] == [host + "/ok", host + "/two"]


def test_rules_from_hosts(spark):
    answers = spark.createDataFrame([("https://a.test/robots.txt", 200, "User-agent: *\nDisallow: /x", "", "text/plain"), ("https://b.test/robots.txt", 500, "User-agent: *\nDisallow: /", "", "")], "url string, status int, body string, final_url string, content_type string")
    urls = spark.createDataFrame([("http://a.test/1",), ("http://b.test:80/",), ("http://c.test/",), ("bad",)], "url string")
    got = {r.domain: r.disallow for r in C.fetched_rules(urls, C.table_fetcher(answers)).collect()}
    assert got == {"a.test": ["/x"], "b.test": [], "c.test": []}
