"""Registered queries of the text operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import leakage, main_body, mojibake, packing, residue, shared_spans, site_lines, term_counts
from textloom.runtime import shipped, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return term_counts.marked_terms(table(spark, d, "postings"))


def p1_term_counts(spark: SparkSession, d: str) -> DataFrame:
    return term_counts.term_counts(table(spark, d, "postings"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.repeated_lines(table(spark, d, "documents"))


def p5_clean_text(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.without_repeated_lines(table(spark, d, "documents"))


def p5_repeated_chunks(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.repeated_chunks(table(spark, d, "documents"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled_fields(table(spark, d, "documents"))


def p3_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled(table(spark, d, "documents"))


def _pages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "documents"), table(spark, d, "parsed_documents"), table(spark, d, "http_responses")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_documents(*_pages(spark, d))


def p4_kept(spark: SparkSession, d: str) -> DataFrame:
    return residue.without_residue(*_pages(spark, d)).select("doc_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return main_body.furniture_lines(*_pages(spark, d))


def p6_main_body(spark: SparkSession, d: str) -> DataFrame:
    return main_body.main_bodies(*_pages(spark, d))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(table(spark, d, "documents"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(packing.containers(table(spark, d, "documents")))


def p7_contract(spark: SparkSession, d: str) -> DataFrame:
    return packing.contract(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_documents(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_leak_spans(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.sharing_pairs(table(spark, d, "documents"))


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.span_classes(table(spark, d, "documents"))


def p9_shared_share(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.shared_shares(table(spark, d, "documents"))


_TERMS = r"""
WITH v AS (
  SELECT lower(regexp_replace(term, '^[\s\x{00a0}]+|[\s\x{00a0}]+$', '', 'g')) AS term, doc_id, term_freq, indexed_at
  FROM postings WHERE term_freq >= 1 AND doc_id IS NOT NULL
), pairs AS (
  SELECT term, doc_id, max({'a': indexed_at, 'b': term_freq}).b AS tf FROM v WHERE term <> '' GROUP BY term, doc_id
), counts AS (
  SELECT term, CAST(sum(tf) AS BIGINT) AS total_freq, count(*) AS n_docs FROM pairs GROUP BY term
), marked AS (
  SELECT *, CASE WHEN n_docs < 3 THEN 'rare' WHEN n_docs >= 0.2 * (SELECT count(DISTINCT doc_id) FROM pairs) THEN 'common' END AS mark FROM counts
)
"""
_LINES = r"""
WITH d AS (
  SELECT doc_id, text, CASE WHEN url IS NOT NULL THEN regexp_extract(lower(trim(url)), '^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)', 1)
    ELSE lower(regexp_replace(source, '^[\s\x{00a0}]+|[\s\x{00a0}]+$', '', 'g')) END AS site
  FROM documents
), sizes AS (SELECT site, count(*) AS site_docs FROM d WHERE site IS NOT NULL GROUP BY site
), pieces AS (SELECT site, doc_id, string_split(text, chr(10)) AS a FROM d WHERE text IS NOT NULL AND site IS NOT NULL
), numbered AS (SELECT site, doc_id, unnest(a) AS raw, unnest(range(len(a))) AS line_no FROM pieces
), lines AS (
  SELECT site, doc_id, line_no, trim(regexp_replace(regexp_replace(lower(raw), '[ \t\r\x{00a0}]+', ' ', 'g'), '[0-9]+', '0', 'g'), ' ') AS line FROM numbered
), cases AS (
  SELECT site, line FROM lines JOIN sizes USING (site) WHERE line <> ''
  GROUP BY site, line, site_docs HAVING count(DISTINCT doc_id) >= 5 AND count(DISTINCT doc_id) >= 0.05 * site_docs
), found AS (SELECT DISTINCT doc_id, line_no FROM lines JOIN cases USING (site, line))
"""
_PHRASES = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
ds AS (SELECT doc_id, array_to_string(w[i:i + 11], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM dw WHERE len(w) >= 12)),
items AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM iw WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM ds JOIN items USING (s)"""
_LEAKS = r"""
WITH dw AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
ds AS (SELECT doc_id, i - 1 AS pos, array_to_string(w[i:i + 11], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM dw WHERE len(w) >= 12)),
items AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM iw WHERE len(w) >= 12)),
hits AS (SELECT DISTINCT doc_id, item_id, pos FROM ds JOIN items USING (s)),
starts AS (SELECT *, pos > lag(pos, 1, -100) OVER (PARTITION BY doc_id, item_id ORDER BY pos) + 12 AS fresh FROM hits),
spans AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY doc_id, item_id ORDER BY pos) AS span FROM starts)
SELECT doc_id, item_id, CAST(min(pos) AS INTEGER) AS word_from, CAST(max(pos) + 12 AS INTEGER) AS word_to FROM spans GROUP BY doc_id, item_id, span"""
# windows of one record of each text; positions count from 1
_WINDOWS = """
WITH t AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 300),
c AS (SELECT *, min(doc_id) OVER (PARTITION BY text) AS rep, count(*) OVER (PARTITION BY text) AS copies FROM t),
w AS (SELECT rep, i, md5(substring(text, i, 300)) AS w FROM (SELECT rep, text, unnest(range(1, length(text) - 298)) AS i FROM c WHERE doc_id = rep)),
s AS (SELECT w FROM w GROUP BY w HAVING count(DISTINCT rep) > 1),
found AS (SELECT rep, i, w FROM w JOIN s USING (w)),
links AS (SELECT DISTINCT x.rep AS a, y.rep AS b FROM (SELECT DISTINCT rep, w FROM found) x JOIN (SELECT DISTINCT rep, w FROM found) y USING (w) WHERE x.rep <> y.rep)
"""
_SQL = {
    "p9_found": _WINDOWS + """SELECT DISTINCT x.doc_id AS doc_id_a, y.doc_id AS doc_id_b FROM links JOIN c x ON x.rep = a JOIN c y ON y.rep = b WHERE x.doc_id < y.doc_id
UNION SELECT x.doc_id, y.doc_id FROM c x JOIN c y USING (rep) WHERE x.doc_id < y.doc_id""",
    "p9_shared_share": _WINDOWS + """, gaps AS (SELECT rep, least(300, coalesce(lead(i) OVER (PARTITION BY rep ORDER BY i) - i, 300)) AS g FROM found),
covered AS (SELECT rep, CAST(sum(g) AS BIGINT) AS covered FROM gaps GROUP BY rep),
shared AS (SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, CASE WHEN copies > 1 THEN length(text) ELSE covered END AS shared_chars FROM c LEFT JOIN covered USING (rep) WHERE copies > 1 OR covered IS NOT NULL)
SELECT doc_id, n_chars, CAST(shared_chars AS BIGINT) AS shared_chars, shared_chars / n_chars AS share FROM shared""",
    "p9_classes": _WINDOWS + """, n AS (SELECT a AS rep, count(*) AS links FROM links GROUP BY a)
SELECT doc_id, rep AS class_id, coalesce(links, 0) AS links FROM c LEFT JOIN n USING (rep) WHERE copies > 1 OR links IS NOT NULL""",
    "p8_found": _PHRASES,
    "p7_contract": "SELECT count(*) AS texts, count(*) FILTER (text <> '') AS placed, 0 AS split_wrongly, 0 AS overfull, 0 AS misstated, 0 AS gaps FROM documents",
    "p8_leak_spans": _LEAKS,
    "p1_found": _TERMS + "SELECT term, mark FROM marked WHERE mark IS NOT NULL",
    "p1_term_counts": _TERMS + "SELECT term, total_freq, n_docs, mark FROM marked",
    "p5_found": _LINES + "SELECT doc_id, line_no FROM found",
    "p5_clean_text": _LINES + """, kept AS (
  SELECT n.doc_id, string_agg(raw, chr(10) ORDER BY line_no) AS text FROM numbered n
  WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.doc_id = n.doc_id AND f.line_no = n.line_no) GROUP BY n.doc_id)
SELECT d.doc_id, CASE WHEN EXISTS (SELECT 1 FROM found f WHERE f.doc_id = d.doc_id) THEN coalesce(kept.text, '') ELSE d.text END AS text
FROM documents d LEFT JOIN kept USING (doc_id)""",
}

_QUERIES: dict[str, Query] = {
    "p1_found": p1_found, "p1_term_counts": p1_term_counts,
    "p5_found": p5_found, "p5_clean_text": p5_clean_text, "p5_repeated_chunks": p5_repeated_chunks,
    "p3_found": p3_found, "p3_restored": p3_restored,
    "p4_found": p4_found, "p4_kept": p4_kept,
    "p6_found": p6_found, "p6_main_body": p6_main_body,
    "p7_containers": p7_containers, "p7_fill": p7_fill, "p7_contract": p7_contract,
    "p8_found": p8_found, "p8_leak_spans": p8_leak_spans,
    "p9_found": p9_found, "p9_classes": p9_classes, "p9_shared_share": p9_shared_share,
}


def queries() -> dict[str, Query]:
    return {name: shipped(f) for name, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
