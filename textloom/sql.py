"""SQL statements that give the same rows as the core's queries."""

from __future__ import annotations

from textloom.functions.text import STOP_WORDS

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)

_TOKENS = f"""
WITH src AS (SELECT doc_id, coalesce(title, '') || ' ' || coalesce(text, '') AS t FROM documents),
each AS (SELECT doc_id, unnest(a) AS x, unnest(range(len(a))) AS pos FROM (SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9]{{2,}}') AS a FROM src)),
kept AS (SELECT doc_id, pos, lower(x) AS raw FROM each WHERE lower(x) NOT IN ({_STOP})),
words AS (SELECT DISTINCT raw FROM kept),
s1 AS (SELECT raw, CASE WHEN raw LIKE '%ingly' AND length(raw) > 6 THEN left(raw, length(raw) - 5) WHEN raw LIKE '%ing' AND length(raw) > 5 THEN left(raw, length(raw) - 3)
  WHEN raw LIKE '%ed' AND length(raw) > 4 THEN left(raw, length(raw) - 2) END AS cut FROM words),
s1d AS (SELECT raw, CASE WHEN cut IS NULL THEN raw WHEN length(cut) > 1 AND right(cut, 1) = substr(cut, length(cut) - 1, 1) AND right(cut, 1) NOT IN ('s', 'l') THEN left(cut, length(cut) - 1) ELSE cut END AS w FROM s1),
s2a AS (SELECT raw, CASE WHEN w LIKE '%fully' AND length(w) > 6 THEN left(w, length(w) - 5) WHEN w LIKE '%ful' AND length(w) > 5 THEN left(w, length(w) - 3) ELSE w END AS w FROM s1d),
s2b AS (SELECT raw, CASE WHEN w LIKE '%ness' AND length(w) > 5 THEN left(w, length(w) - 4) ELSE w END AS w FROM s2a),
s2c AS (SELECT raw, CASE WHEN w LIKE '%ment' AND length(w) > 5 THEN left(w, length(w) - 4) ELSE w END AS w FROM s2b),
stems AS (SELECT raw, CASE WHEN w LIKE '%ies' AND length(w) > 4 THEN left(w, length(w) - 3) || 'y' WHEN w LIKE '%es' AND length(w) > 4 THEN left(w, length(w) - 2)
  WHEN w LIKE '%s' AND w NOT LIKE '%ss' AND length(w) > 3 THEN left(w, length(w) - 1) ELSE w END AS stem FROM s2c),
terms AS (SELECT k.doc_id, k.pos, k.raw, s.stem AS term FROM kept k JOIN stems s USING (raw)),
tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY doc_id, term),
lens AS (SELECT d.doc_id, count(k.raw) AS doc_len FROM documents d LEFT JOIN kept k USING (doc_id) GROUP BY d.doc_id),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
stats AS (SELECT count(*) AS n, CAST(coalesce(sum(doc_len), 0) AS BIGINT) AS total, coalesce(sum(doc_len) / count(*), 0.0) AS avgdl FROM lens)
"""


def _scores(terms: list[str], k1: float = 1.2, b: float = 0.75) -> str:
    values = ", ".join(f"('{t}')" for t in terms)
    return _TOKENS + f""", q AS (SELECT t AS term, count(*) AS qtf FROM (VALUES {values}) v(t) GROUP BY t),
scored AS (
  SELECT tf.doc_id, round(sum(q.qtf * ln(1 + (n - df.df + 0.5) / (df.df + 0.5)) * (tf.tf * ({k1} + 1)) / (tf.tf + {k1} * (1 - {b} + {b} * l.doc_len / avgdl))), 6) AS score
  FROM tf JOIN q USING (term) JOIN df USING (term) JOIN lens l ON l.doc_id = tf.doc_id CROSS JOIN stats GROUP BY tf.doc_id)
"""


_URLS = """
WITH urls AS (SELECT DISTINCT url FROM (SELECT url FROM documents UNION ALL SELECT url FROM http_responses UNION ALL SELECT final_url FROM http_responses) WHERE url IS NOT NULL)
"""
_CODE = r"(?i)^%(2D|2E|5F|7E|3[0-9]|4[1-9A-F]|5[0-9A]|6[1-9A-F]|7[0-9A])$"


def _valid(u: str) -> str:
    return f"regexp_matches({u}, '^(?i)https?://[^/?#]')"


def _authority(u: str) -> str:
    return f"regexp_extract({u}, '^[^:]*://([^/?#]*)', 1)"


def _scheme(u: str) -> str:
    return f"lower(regexp_extract({u}, '^([^:]*)://', 1))"


def _host(u: str) -> str:
    return f"lower(split_part({_authority(u)}, ':', 1))"


def _port(u: str) -> str:
    return f"regexp_extract({_authority(u)}, '^[^:]*:(.*)$', 1)"


def _path(u: str) -> str:
    return f"coalesce(nullif(regexp_extract({u}, '^[^:]*://[^/?#]*([^?#]*)', 1), ''), '/')"


def _query(u: str) -> str:
    return f"regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1)"


def _normal(u: str) -> str:
    decoded = f"array_to_string(list_transform(regexp_extract_all({_path(u)}, '%[0-9A-Fa-f]{{2}}|[^%]+|%'), lambda p: CASE WHEN regexp_matches(p, '{_CODE}') THEN chr(CAST('0x' || substr(p, 2) AS INTEGER)) ELSE p END), '')"
    port = f"CASE WHEN {_port(u)} = '' OR ({_scheme(u)} = 'http' AND {_port(u)} = '80') OR ({_scheme(u)} = 'https' AND {_port(u)} = '443') THEN '' ELSE ':' || {_port(u)} END"
    query = f"CASE WHEN {_query(u)} = '' THEN '' ELSE '?' || {_query(u)} END"
    return f"CASE WHEN {_valid(u)} THEN {_scheme(u)} || '://' || {_host(u)} || {port} || regexp_replace({decoded}, '^(.+)/$', '\\1') || {query} ELSE '' END"


def _dots(p: str) -> str:
    parts = f"list_transform(string_split({p}, '/'), lambda x: [x])"
    fold = f"list_reduce({parts}, lambda acc, x: CASE WHEN x[1] = '' OR x[1] = '.' THEN acc WHEN x[1] = '..' THEN acc[:len(acc) - 1] ELSE acc || x END, CAST([] AS VARCHAR[]))"
    return f"'/' || array_to_string({fold}, '/')"


_LINKS = """
WITH base AS (SELECT response_id, max(url) AS base FROM http_responses GROUP BY response_id),
rels AS (SELECT DISTINCT response_id, rel FROM (SELECT response_id, unnest(links) AS rel FROM parsed_documents) WHERE rel IS NOT NULL),
links AS (SELECT response_id, base, rel FROM rels JOIN base USING (response_id) WHERE base IS NOT NULL)
"""
_ROOT = f"{_scheme('base')} || '://' || {_host('base')} || CASE WHEN {_port('base')} = '' THEN '' ELSE ':' || {_port('base')} END"
_RESOLVED = _LINKS + f""", raws AS (
  SELECT response_id, base, rel, CASE WHEN regexp_matches(rel, '^https?://') THEN rel WHEN NOT {_valid('base')} THEN '' WHEN rel LIKE '//%' THEN {_scheme('base')} || ':' || rel
    WHEN rel LIKE '/%' THEN {_ROOT} || {_dots('rel')} ELSE {_ROOT} || {_dots(f"regexp_extract({_path('base')}, '^(.*/)[^/]*$', 1) || rel")} END AS raw
  FROM links), resolved AS (SELECT response_id, base, rel, {_normal('raw')} AS link FROM raws)
"""

_PAGES = r"""
WITH pages AS (
  SELECT response_id AS page_id, r.url AS url, r.body AS html FROM (
    SELECT response_id, max({'a': fetched_at, 'url': url, 'body': body}) AS r FROM http_responses WHERE status_code = 200 AND contains(content_type, 'text/html') GROUP BY response_id)
), seen AS (
  SELECT page_id, url, html, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?(?:-->|$)', '<x>', 'g'),
    '(?is)<script\b[^>]*>.*?(?:</script\s*>|$)', '<x>', 'g'), '(?is)<style\b[^>]*>.*?(?:</style\s*>|$)', '<x>', 'g'), '(?is)<noscript\b[^>]*>.*?(?:</noscript\s*>|$)', '<x>', 'g') AS v FROM pages
), nodes AS (
  SELECT page_id, url, html, v, list_filter(string_split_regex(regexp_replace(v, '(?is)<title\b[^>]*>(.*?)</title\s*>', '<x>', 'g'), '<[A-Za-z/!?][^>]*(?:>|$)'), lambda n: regexp_matches(n, '[^ \t\n\r\f]')) AS n FROM seen
), texts AS (
  SELECT page_id, url, html, v, replace(replace(replace(translate(array_to_string(n, ' ') || ' ', chr(10) || chr(9) || chr(13), '   '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS t FROM nodes
), parsed AS (
  SELECT page_id, url, html, array_to_string(regexp_extract_all(v, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1), '') AS title,
    CASE WHEN html IS NULL THEN NULL WHEN regexp_matches(t, '[A-Za-z0-9]') THEN t ELSE '' END AS body FROM texts
)
"""
_DOCS = _PAGES + """, docs AS (SELECT row_number() OVER (ORDER BY page_id) - 1 AS doc_id, url, title, body AS text FROM parsed WHERE body <> '' AND octet_length(encode(html)) <= 10485760)
"""

_ROBOTS = _URLS + f""", hosts AS (SELECT DISTINCT {_host('url')} AS domain FROM urls WHERE {_valid('url')}),
rules AS (SELECT domain, ['/s', '/' || left(domain, 1)] AS disallow, CASE WHEN length(domain) % 4 > 0 THEN (length(domain) % 4) * 1000 ELSE 1000 END AS crawl_delay_ms FROM hosts)
"""
_FRONT = f"""
WITH norm AS (SELECT {_normal('url')} AS u, doc_id AS seq FROM documents WHERE url <> ''),
front AS (SELECT u AS url, {_host('u')} AS domain, min(seq) AS seq FROM norm WHERE u <> '' GROUP BY u),
seen AS (SELECT DISTINCT {_normal('url')} AS url FROM http_responses WHERE url IS NOT NULL)
"""

_VALID = r"""
WITH v AS (
  SELECT lower(regexp_replace(term, '^[\s\x{00a0}]+|[\s\x{00a0}]+$', '', 'g')) AS term, doc_id, term_freq, segment_id, indexed_at
  FROM postings WHERE term_freq >= 1 AND doc_id IS NOT NULL
), rows_ok AS (SELECT * FROM v WHERE term <> ''), pairs AS (SELECT DISTINCT term, doc_id FROM rows_ok)
"""

_PATH = "coalesce(nullif(regexp_extract(url, '://[^/]*(/.*)$', 1), ''), '/')"
_KNOWN = _URLS + f""", hosts AS (SELECT DISTINCT {_host('url')} AS domain FROM urls WHERE {_valid('url')}),
known AS (SELECT u AS url, max({{'status': status_code, 'body': body, 'final_url': final_url, 'content_type': content_type}}) AS r
  FROM (SELECT {_normal('url')} AS u, * FROM http_responses WHERE url IS NOT NULL) WHERE u <> '' GROUP BY u),
ok AS (SELECT url, {_host('url')} AS domain, r.body AS html, r.status = 200 AND contains(r.content_type, 'text/html') AS page FROM known k
  WHERE NOT starts_with({_PATH}, '/s') AND NOT starts_with({_PATH}, '/' || left({_host('url')}, 1)))
"""
_CRAWL = _KNOWN + f""", firsts AS (SELECT url, min(response_id) AS seq FROM http_responses WHERE url IS NOT NULL GROUP BY url),
seeds AS (SELECT {_normal('url')} AS url, min(seq) AS seq FROM firsts GROUP BY 1),
turns AS (SELECT url, html, page, seq, (row_number() OVER (PARTITION BY domain ORDER BY seq) - 1) * 100 AS ready_ms FROM ok JOIN seeds USING (url))
"""
_REACH = "WITH RECURSIVE" + _KNOWN.split("WITH", 1)[1] + f""", hrefs AS (SELECT url AS base, unnest(list_filter(regexp_extract_all(html, 'href[ \\t]*=[ \\t]*"([^"]*)"', 1), lambda v: length(v) BETWEEN 1 AND 2048)) AS rel FROM ok WHERE page),
links AS (SELECT DISTINCT 0 AS response_id, base, rel FROM hrefs), raws AS{_RESOLVED.split(", raws AS")[1].rstrip()},
starts AS (SELECT min({{'a': response_id, 'url': url}}).url AS u FROM http_responses WHERE {_valid('url')} GROUP BY {_host('url')}),
reach AS (SELECT url FROM ok WHERE url IN (SELECT {_normal('u')} FROM starts)
  UNION SELECT ok.url FROM reach JOIN resolved ON base = reach.url JOIN ok ON ok.url = link)
"""

SQL = {
    "crawl_bfs": _CRAWL + "SELECT row_number() OVER (ORDER BY ready_ms, seq, url) - 1 AS page_id, url, html FROM turns WHERE page",
    "crawl_from_start_pages": _REACH + "SELECT url FROM reach JOIN ok USING (url) WHERE page",
    "stored_index_search": _scores(["archive", "canva", "archive", "report"]) + "SELECT doc_id, score FROM scored ORDER BY score DESC, doc_id LIMIT 25",
    "stored_term_stats": _TOKENS + "SELECT term, df FROM df",
    "document_store": "SELECT doc_id, url, title, text FROM documents",
    "seeds_file": "SELECT url, count(*) AS n FROM documents WHERE url <> '' AND NOT contains(url, chr(10)) GROUP BY url",
    "tokenize": _TOKENS + "SELECT d.doc_id, coalesce(x.tokens, []) AS tokens FROM documents d LEFT JOIN (SELECT doc_id, list(term ORDER BY pos) AS tokens FROM terms GROUP BY doc_id) x USING (doc_id)",
    "stop_words_removed": _TOKENS + "SELECT doc_id, count(*) AS kept FROM kept GROUP BY doc_id",
    "stem_vocabulary": _TOKENS + "SELECT raw, stem FROM stems",
    "joined_tokens": _TOKENS + "SELECT d.doc_id, coalesce(x.j, '') AS joined FROM documents d LEFT JOIN (SELECT doc_id, string_agg(term, ' ' ORDER BY pos) AS j FROM terms GROUP BY doc_id) x USING (doc_id)",
    "snippets": "SELECT doc_id, substr(text, 1, 120) || '...' AS snippet FROM documents WHERE text IS NOT NULL",
    "term_freq": _TOKENS + "SELECT doc_id, term, tf FROM tf",
    "doc_freq": _TOKENS + "SELECT term, df FROM df",
    "doc_lengths": _TOKENS + "SELECT doc_id, doc_len FROM lens",
    "corpus_stats": _TOKENS + "SELECT n AS doc_count, total AS total_tokens, avgdl AS avg_doc_length FROM stats",
    "total_postings": _TOKENS + "SELECT count(*) AS total_postings FROM tf",
    "vocabulary_size": _TOKENS + "SELECT count(*) AS vocabulary_size FROM df",
    "longest_posting_list": _TOKENS + "SELECT term, df FROM df ORDER BY df DESC, term LIMIT 1",
    "postings_sorted": _TOKENS + "SELECT term, doc_id, tf, doc_len FROM tf JOIN lens USING (doc_id)",
    "posting_lists": _TOKENS + "SELECT term, list(doc_id ORDER BY doc_id) AS doc_ids, list(tf ORDER BY doc_id) AS tfs FROM tf GROUP BY term",
    "term_lookup": _TOKENS + "SELECT term, df FROM df WHERE term IN ('algorithm', 'archive', 'canvas', 'missing')",
    "document_get": "SELECT doc_id, url, title, text FROM documents WHERE doc_id = 1825",
    "idf_table": _TOKENS + "SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df CROSS JOIN stats",
    "bm25_single_term": _scores(["archive"]) + "SELECT doc_id, score FROM scored",
    "bm25_multi_term": _scores(["archive", "canva", "report"]) + "SELECT doc_id, score FROM scored",
    "bm25_repeated_term": _scores(["archive", "archive", "canva"]) + "SELECT doc_id, score FROM scored",
    "bm25_missing_term": _scores(["qqqqzz", "canva"]) + "SELECT doc_id, score FROM scored",
    "bm25_no_terms": "SELECT doc_id, 0.5 AS score FROM documents WHERE false",
    "bm25_params": _scores(["archive", "canva"], 2.0, 0.3) + "SELECT doc_id, score FROM scored",
    "bm25_top_k": _scores(["archive", "canva", "archive", "report"]) + "SELECT doc_id, score FROM scored ORDER BY score DESC, doc_id LIMIT 25",
    "search_results_page": _scores(["archive", "canva", "archive", "report"]) + """, best AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored)
SELECT rank, score, doc_id, title, substr(coalesce(text, ''), 1, 120) || '...' AS snippet FROM best JOIN documents USING (doc_id) WHERE rank <= 10""",
    "url_normalize": _URLS + f"SELECT url, {_normal('url')} AS normalized FROM urls",
    "url_domain": _URLS + f"SELECT url, CASE WHEN {_valid('url')} THEN {_host('url')} ELSE '' END AS domain FROM urls",
    "url_components": _URLS + f"""SELECT url, CASE WHEN {_valid('url')} THEN {_scheme('url')} END AS scheme, CASE WHEN {_valid('url')} THEN {_authority('url')} END AS authority, CASE WHEN {_valid('url')} THEN {_host('url')} END AS host,
  CASE WHEN {_valid('url')} THEN {_port('url')} END AS port, CASE WHEN {_valid('url')} THEN {_path('url')} END AS path, CASE WHEN {_valid('url')} THEN {_query('url')} END AS query, CASE WHEN {_valid('url')} THEN regexp_extract(url, '#(.*)$', 1) END AS fragment FROM urls""",
    "url_dedup": _URLS + f"SELECT DISTINCT {_normal('url')} AS url FROM urls WHERE {_normal('url')} <> ''",
    "url_robots_path": _URLS + "SELECT url, coalesce(nullif(regexp_extract(url, '://[^/]*(/.*)$', 1), ''), '/') AS path FROM urls",
    "url_resolve_links": _RESOLVED + "SELECT response_id, base, rel, link AS resolved FROM resolved",
    "link_in_degree": _RESOLVED + "SELECT link, count(DISTINCT response_id) AS pages FROM resolved WHERE link <> '' GROUP BY link",
    "dot_segments": _LINKS + f"SELECT DISTINCT rel, {_dots('rel')} AS path FROM links",
    "html_title": _PAGES + "SELECT page_id, CASE WHEN html IS NULL THEN NULL ELSE title END AS title FROM parsed",
    "html_body_text": _PAGES + "SELECT page_id, body AS body_text FROM parsed",
    "html_links": _PAGES + r""", tags AS (SELECT page_id, regexp_extract_all(v, '(?i)<a\s[^>]*>') AS a FROM seen),
has AS (SELECT page_id, list_filter(a, lambda t: regexp_matches(t, '(?i)\shref\s*=\s*"')) AS a FROM tags)
SELECT page_id, unnest(range(len(a))) AS pos, replace(unnest(list_transform(a, lambda t: regexp_extract(t, '(?i)\shref\s*=\s*"([^"]*)"', 1))), '&amp;', '&') AS href FROM has""",
    "html_raw_links": _PAGES + r""", hits AS (SELECT page_id, list_filter(regexp_extract_all(html, 'href[ \t]*=[ \t]*"([^"]*)"', 1), lambda v: length(v) BETWEEN 1 AND 2048) AS a FROM pages)
SELECT page_id, unnest(range(len(a))) AS pos, unnest(a) AS href FROM hits""",
    "html_parse_tree": _PAGES + "SELECT page_id, coalesce(title, '') AS title, coalesce(body, '') AS body_text FROM parsed",
    "page_filter": "SELECT DISTINCT response_id FROM http_responses WHERE status_code = 200 AND contains(content_type, 'text/html')",
    "parse_errors": _PAGES + "SELECT page_id, CASE WHEN html IS NULL THEN 'NotFound' WHEN octet_length(encode(html)) > 10485760 THEN 'TooLarge' WHEN body = '' THEN 'Empty' END AS error FROM parsed",
    "process_docs": _DOCS + "SELECT doc_id, url, title, text FROM docs",
    "process_stats": _PAGES + "SELECT count(*) FILTER (body <> '') AS processed, count(*) FILTER (body IS NULL OR body = '') AS skipped, round(avg(octet_length(encode(body))) FILTER (body <> ''), 4) AS avg_len FROM parsed",
    "page_index_search": _DOCS.replace("WITH pages AS", "WITH RECURSIVE pages AS", 1) + _scores(["museum", "archive"]).replace("WITH src AS", ", src AS", 1).replace("documents", "docs") + "SELECT doc_id, score FROM scored ORDER BY score DESC, doc_id LIMIT 20",
    "robots_rules": _ROBOTS + "SELECT domain, disallow, crawl_delay_ms FROM rules",
    "robots_filter": _ROBOTS + f""", keyed AS (SELECT url, {_normal('url')} AS u FROM urls)
SELECT url FROM keyed WHERE u <> '' AND NOT EXISTS (SELECT 1 FROM rules WHERE domain = {_host('u')}
  AND (starts_with(coalesce(nullif(regexp_extract(u, '://[^/]*(/.*)$', 1), ''), '/'), disallow[1]) OR starts_with(coalesce(nullif(regexp_extract(u, '://[^/]*(/.*)$', 1), ''), '/'), disallow[2])))""",
    "seed_urls": "SELECT url, doc_id AS seq FROM documents WHERE url <> ''",
    "frontier_push": _FRONT + "SELECT url, domain, seq FROM front WHERE url NOT IN (SELECT url FROM seen)",
    "frontier_counts": _FRONT + "SELECT count(DISTINCT url) AS seen, count(*) FILTER (seq % 3 <> 0) AS pending FROM front",
    "politeness_schedule": _FRONT + "SELECT url, domain, seq, (row_number() OVER (PARTITION BY domain ORDER BY seq) - 1) * 100 AS ready_ms FROM front",
    "crawl_links": _PAGES + r""", hrefs AS (SELECT url AS base, unnest(list_filter(regexp_extract_all(html, 'href[ \t]*=[ \t]*"([^"]*)"', 1), lambda v: length(v) BETWEEN 1 AND 2048)) AS rel FROM pages WHERE url IS NOT NULL),
links AS (SELECT DISTINCT 0 AS response_id, base, rel FROM hrefs), """ + _RESOLVED.split("), raws AS")[0][:0] + "raws AS" + _RESOLVED.split(", raws AS")[1] + "SELECT DISTINCT base AS url, link FROM resolved WHERE link <> ''",
    "wiki_clean_text": r"""
WITH m AS (SELECT doc_id, '{{box' || chr(10) || '}} == Head == [[a|' || coalesce(title, 'none') || ']] see http://x.test/y ' || coalesce(text, '') AS t FROM documents)
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?s)\{\{.*?\}\}', '', 'g'), '\[\[(?:[^|\]]*\|)?([^\]]+)\]\]', '\1', 'g'), 'http[^\s]+', '', 'g'), '==+.*?==+', '', 'g'), '\s+', ' ', 'g'), ' ') AS cleaned FROM m""",
    "wiki_articles": r"""
WITH m AS (SELECT CASE WHEN doc_id % 5 = 0 THEN 'File:' || title ELSE title END AS title, text FROM documents),
c AS (SELECT title, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)\{\{.*?\}\}', '', 'g'), '\[\[(?:[^|\]]*\|)?([^\]]+)\]\]', '\1', 'g'), 'http[^\s]+', '', 'g'), '==+.*?==+', '', 'g'), '\s+', ' ', 'g'), ' ') AS text FROM m
  WHERE title <> '' AND text <> '' AND NOT starts_with(text, '#REDIRECT') AND NOT regexp_matches(title, '^(Template|Category|File|Wikipedia|Portal|Help):'))
SELECT title, text FROM c WHERE text <> ''""",
    "dump_articles": r"""
WITH m AS (SELECT trim(regexp_replace(title, '\s+', ' ', 'g')) AS title, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents WHERE title IS NOT NULL AND text IS NOT NULL),
c AS (SELECT title, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)\{\{.*?\}\}', '', 'g'), '\[\[(?:[^|\]]*\|)?([^\]]+)\]\]', '\1', 'g'), 'http[^\s]+', '', 'g'), '==+.*?==+', '', 'g'), '\s+', ' ', 'g'), ' ') AS text FROM m
  WHERE title <> '' AND text <> '' AND NOT starts_with(text, '#REDIRECT') AND NOT regexp_matches(title, '^(Template|Category|File|Wikipedia|Portal|Help):'))
SELECT title, text FROM c WHERE text <> ''""",
    "p2_found": _VALID + """
SELECT 'term' AS key_kind, term AS key_value FROM pairs GROUP BY term HAVING count(*) >= 0.01 * (SELECT count(*) FROM pairs)
UNION ALL
SELECT 'doc', CAST(doc_id AS VARCHAR) FROM pairs GROUP BY doc_id HAVING count(*) >= 0.01 * (SELECT count(*) FROM pairs)""",
    "p2_term_results": _VALID + r""", own AS (
  SELECT lower(regexp_replace(term, '^[\s\x{00a0}]+|[\s\x{00a0}]+$', '', 'g')) AS term, CAST(sum(posting_count) AS BIGINT) AS posting_count, count(DISTINCT segment_id) AS n_segments
  FROM term_entries GROUP BY 1)
SELECT p.term, count(*) AS n_docs, max(posting_count) AS posting_count, max(n_segments) AS n_segments FROM pairs p LEFT JOIN own USING (term) GROUP BY p.term""",
    "p2_document_results": _VALID + """, side AS (
  SELECT doc_id, max(doc_len) AS doc_len, bool_or(hub) AS hub FROM (
    SELECT doc_id, doc_len, false AS hub FROM doc_lengths UNION ALL SELECT doc_id, NULL, true FROM hub_pages) GROUP BY doc_id)
SELECT p.doc_id, count(*) AS n_terms, max(doc_len) AS doc_len, coalesce(bool_or(hub), false) AS is_hub FROM pairs p LEFT JOIN side USING (doc_id) GROUP BY p.doc_id""",
}
