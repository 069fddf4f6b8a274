"""Exclusion rules of hosts: parsing and filtering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import urls as U

DEFAULT_DELAY_MS = 1000


def parse_rules(files: DataFrame) -> DataFrame:
    """``(domain, disallow, crawl_delay_ms)`` from one (domain, robots_txt) row per host.

    ``user-agent: *`` opens a block and any other agent line closes it.  Comments and
    white space are stripped, keys are case-insensitive, the last positive delay in
    whole seconds holds, a null file allows everything.
    """
    trim = lambda c: F.regexp_replace(c, r"^[ \t\r\n\f\x0B]+|[ \t\r\n\f\x0B]+$", "")
    lines = files.select("domain", F.posexplode(F.split(F.coalesce("robots_txt", F.lit("")), "\n")).alias("no", "line"))
    bare = lines.withColumn("line", trim(F.substring_index(F.col("line"), "#", 1)))
    pair = bare.select("domain", "no", F.lower(trim(F.regexp_extract("line", "(?s)^([^:]*):", 1))).alias("key"), trim(F.regexp_extract("line", "(?s)^[^:]*:(.*)$", 1)).alias("value"))
    agent = F.when(F.col("key") == "user-agent", F.lower("value") == "*")
    so_far = Window.partitionBy("domain").orderBy("no").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # lines of one file
    inside = pair.withColumn("open", F.coalesce(F.last(agent, ignorenulls=True).over(so_far), F.lit(False)))
    path = F.when(F.col("open") & (F.col("key") == "disallow") & (F.col("value") != ""), F.struct("no", "value"))
    seconds = F.regexp_extract("value", r"^[+]?([0-9]{1,9})", 1).try_cast("long")
    delay = F.when(F.col("open") & (F.col("key") == "crawl-delay") & (seconds > 0), F.struct("no", (seconds * 1000).alias("ms")))
    rules = inside.groupBy("domain").agg(F.sort_array(F.collect_list(path)).alias("paths"), F.max(delay).alias("delay"))
    return rules.select("domain", F.transform("paths", lambda p: p["value"]).alias("disallow"), F.coalesce("delay.ms", F.lit(DEFAULT_DELAY_MS)).cast("long").alias("crawl_delay_ms"))


def allowed(urls: DataFrame, rules: DataFrame, column: str = "url") -> DataFrame:
    """Rows of ``urls`` with a valid URL that no rule of its host excludes.

    The path with its query must not start with an excluded prefix.  Hosts without
    rules allow everything.
    """
    norm = U.normalize(F.col(column))
    keyed = urls.withColumns({"__domain": U.domain(norm), "__path": U.robots_path(norm)}).where(norm != "")
    prefixes = rules.select(F.col("domain").alias("__d"), F.explode("disallow").alias("__prefix"))
    blocked = (F.col("__domain") == F.col("__d")) & F.expr("startswith(__path, __prefix)")
    return keyed.join(prefixes, blocked, "left_anti").drop("__domain", "__path")
