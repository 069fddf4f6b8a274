"""Breadth-first crawl in rounds, with an injected fetcher."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import html as H
from textloom.functions import urls as U
from textloom.operators import frontier as Q
from textloom.operators import robots as R
from textloom.plans.process import number
from textloom.runtime import Table, materialize

# (url) or (url, ready_ms) rows in, (url, status, body, final_url, content_type, error) rows out
Fetcher = Callable[[DataFrame], DataFrame]
# (url) rows in, (domain, disallow, crawl_delay_ms) rows of their hosts out
Rules = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class CrawlConfig:
    max_pages: int = 100
    max_rounds: int | None = None  # by default until the budget or the frontier is used up
    delay_ms: int = Q.DELAY_MS


def table_fetcher(responses: DataFrame) -> Fetcher:
    """Fetcher that answers from a table (url, status, body, final_url, content_type).

    Of several rows with one normalised URL the greatest holds; an unknown URL gives a
    ``NetworkError`` row.
    """
    columns = ["status", "body", "final_url", "content_type"]
    known = responses.withColumn("url", U.normalize(F.col("url"))).where("url <> ''")
    known = known.groupBy("url").agg(F.max(F.struct(*columns)).alias("r"))

    def fetch(urls: DataFrame) -> DataFrame:
        error = F.when(F.col("r").isNull(), "NetworkError")
        return urls.select("url").join(known, "url", "left").select("url", *[F.col(f"r.{c}").alias(c) for c in columns], error.alias("error"))

    return fetch


def http_fetcher(get: Callable[[str], tuple[int, str, str, str]], lanes: int = 8, delay_ms: int = Q.DELAY_MS) -> Fetcher:
    """Fetcher that calls ``get(url) -> (status, body, final_url, content_type)`` in the tasks.

    An exception becomes an ``error`` value (its class name), never a failed task.  All
    URLs of a host go to one of ``lanes`` tasks, in the order of ``ready_ms`` where the rows have
    it, and two calls to a host begin at least ``delay_ms`` apart.
    """

    def fetch(urls: DataFrame) -> DataFrame:
        def run(frames):
            import time

            import pandas as pd

            began, last = time.monotonic(), {}
            for frame in frames:
                rows = []
                for url, host, ready in zip(frame["url"], frame["host"], frame["ready_ms"]):
                    due = max(began + ready / 1000, last.get(host, began) + delay_ms / 1000 if host in last else began)
                    time.sleep(max(0.0, due - time.monotonic()))
                    last[host] = time.monotonic()
                    try:
                        rows.append((url, *get(url), None))
                    except Exception as e:  # noqa: BLE001
                        rows.append((url, None, None, None, None, type(e).__name__))
                yield pd.DataFrame(rows, columns=["url", "status", "body", "final_url", "content_type", "error"])

        ready = F.col("ready_ms") if "ready_ms" in urls.columns else F.lit(0).cast("long")
        laned = urls.select("url", U.domain(F.col("url")).alias("host"), ready.alias("ready_ms")).repartition(lanes, "host").sortWithinPartitions("ready_ms")
        return laned.mapInPandas(run, "url string, status int, body string, final_url string, content_type string, error string")

    return fetch


def fetched_rules(urls: DataFrame, fetch: Fetcher) -> DataFrame:
    """Rules of the hosts of ``urls`` from ``https://<host>/robots.txt``; any failure or status but 200 allows all."""
    hosts = urls.select(U.domain(F.col("url")).alias("domain")).where("domain <> ''").distinct()
    asked = hosts.withColumn("url", F.concat(F.lit("https://"), "domain", F.lit("/robots.txt")))
    answers = fetch(asked.select("url")).where("status = 200 AND error IS NULL").select("url", "body")
    return R.parse_rules(asked.join(answers, "url", "left").select("domain", F.col("body").alias("robots_txt")))


def is_page(df: DataFrame) -> DataFrame:
    return df.where((F.col("status") == 200) & F.contains(F.col("content_type"), F.lit("text/html")))


def page_links(pages: DataFrame) -> DataFrame:
    """``(url, link, pos)``: resolved, normalised links of (url, body) pages, first occurrence each."""
    each = pages.select("url", F.posexplode(H.raw_links(F.col("body"))).alias("pos", "rel"))
    found = each.select("url", "pos", U.resolve(F.col("url"), F.col("rel")).alias("link")).where("link <> ''")
    return found.groupBy("url", "link").agg(F.min("pos").alias("pos"))


def crawl(seeds: DataFrame, fetch: Fetcher, rules: DataFrame | Rules | None = None, config: CrawlConfig = CrawlConfig()) -> DataFrame:
    """``(page_id, url, html)`` of up to ``max_pages`` pages reached from ``seeds`` (url, seq).

    Each round fetches what the frontier holds in politeness order, as many URLs as should
    fill the page budget by the share of pages so far, keeps pages, and pushes their links
    behind what was not fetched.
    Ends on the budget or an empty frontier.  ``rules`` is a table of all hosts or a
    function that gets the rules of hosts when they are first met.  Frontier rows are
    numbered anew in each round; rounds are appended to tables in shared storage, so
    plans don't grow with the rounds and a lost executor repeats at most a round's task.
    """
    spark = seeds.sparkSession
    seen = Table(spark, "url string", "seen")
    pages = Table(spark, "round int, ready_ms long, seq long, url string, html string", "crawled")
    hosts = Table(spark, "domain string", "hosts")
    met = Table(spark, "domain string, disallow array<string>, crawl_delay_ms long", "rules")

    def permitted(front: DataFrame) -> DataFrame:
        if rules is None:
            return front
        if isinstance(rules, DataFrame):
            return R.allowed(front, rules)
        new = materialize(front.select("domain").distinct().join(hosts.read(), "domain", "left_anti"), "new-hosts")
        met.append(rules(new.select(F.concat(F.lit("https://"), "domain", F.lit("/")).alias("url"))))
        hosts.append(new)
        return R.allowed(front, met.read())

    front, waiting, crawled, fetched, round_ = Q.push(None, seeds.select("url", F.struct(F.lit(0).alias("s"), F.col("seq").cast("long").alias("pos")).alias("seq"))), None, 0, 0, 0
    while config.max_rounds is None or round_ < config.max_rounds:
        fresh = materialize(front, "fresh")
        seen.append(fresh.select("url"))
        queue = permitted(fresh).select("url", "domain", F.struct(F.lit(1).alias("new"), F.col("seq.s").cast("long").alias("s"), F.col("seq.pos").cast("long").alias("pos")).alias("order"))
        if waiting is not None:
            queue = waiting.unionByName(queue)
        queue = materialize(Q.schedule(number(queue, "order", "seq").drop("order"), config.delay_ms), "frontier")
        room = config.max_pages - crawled
        most = -(-room * max(1, fetched) // max(1, crawled)) if fetched else room  # as many as should fill the budget
        turn = materialize(queue.orderBy("ready_ms", "seq", "url").limit(min(most, 2**31 - 1)), "turn")
        n = turn.count()
        if not n:
            break
        fetched += n
        answers = is_page(fetch(turn.select("url", "ready_ms"))).select("url", "body").join(turn.select("url", "ready_ms", "seq"), "url")
        got = materialize(answers.orderBy("ready_ms", "seq", "url").limit(room) if most > room else answers, "fetched")
        pages.append(got.select(F.lit(round_).alias("round"), "ready_ms", "seq", "url", F.col("body").alias("html")))
        crawled += got.count()
        if crawled >= config.max_pages:
            break
        rest = queue.join(turn.select("url"), "url", "left_anti")
        waiting = rest.select("url", "domain", F.struct(F.lit(0).alias("new"), F.col("seq").alias("s"), F.lit(0).cast("long").alias("pos")).alias("order"))
        links = page_links(got.select("url", "body")).join(got.select("url", F.col("seq").alias("s")), "url")
        front = Q.push(seen.read(), links.select(F.col("link").alias("url"), F.struct("s", "pos").alias("seq")))
        round_ += 1
    keyed = pages.read().withColumn("k", F.struct("round", "ready_ms", "seq", "url"))
    return number(keyed, "k", "page_id").select("page_id", "url", "html")
