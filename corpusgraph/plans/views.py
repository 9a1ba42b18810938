"""Views over the driver's tables on which the engine's operators are registered.

Each view is one SQL text that Spark and DuckDB both run, so a query and its SQL counterpart start from the
same rows. `view` builds a DataFrame; `with_views` prefixes DuckDB SQL with the views that it names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    # A code graph: customers are files, orders the symbols in them.
    "g_files": """
SELECT c_custkey AS custkey, lower(r_name) || '/' || lower(n_name) || '/' || CASE WHEN c_custkey % 5 = 0 THEN 'test_' ELSE '' END || 'c' || CAST(c_custkey AS STRING) || '.py' AS path,
  c_custkey % 5 = 0 AS is_test, lower(r_name) AS region, lower(n_name) AS nation
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "g_symbols": """
SELECT path || '#o' || CAST(o_orderkey AS STRING) AS id, 'o' || CAST(o_orderkey % 1000 AS STRING) AS name, path, (o_orderkey % 50) * 10 + 1 AS span_from, (o_orderkey % 50) * 10 + 10 AS span_to,
  CASE WHEN o_orderpriority LIKE '1%' THEN 'class' WHEN o_orderpriority LIKE '2%' THEN 'method' ELSE 'function' END AS kind, o_orderstatus = 'F' AS exported, is_test,
  md5(CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS STRING)) AS body_hash, o_orderkey AS orderkey
FROM orders JOIN g_files ON o_custkey = custkey""",
    "g_nodes": """
SELECT path AS id, path AS name, path, CAST(NULL AS BIGINT) AS span_from, CAST(NULL AS BIGINT) AS span_to, 'file' AS kind, true AS exported, is_test, CAST(NULL AS STRING) AS body_hash FROM g_files
UNION ALL SELECT id, name, path, CAST(span_from AS BIGINT), CAST(span_to AS BIGINT), kind, exported, is_test, body_hash FROM g_symbols""",
    "g_first": "SELECT l_partkey AS partkey, min(l_orderkey) AS orderkey FROM lineitem GROUP BY l_partkey",
    "g_calls": """
SELECT a.id AS source, b.id AS target, 'calls' AS relation, CASE WHEN l_returnflag = 'R' THEN 'inferred' ELSE 'extracted' END AS confidence, CAST(l_linenumber AS INT) AS line
FROM lineitem JOIN g_first ON l_partkey = partkey JOIN g_symbols a ON a.orderkey = l_orderkey JOIN g_symbols b ON b.orderkey = g_first.orderkey WHERE l_orderkey <> g_first.orderkey""",
    "g_edges": """
SELECT source, target, relation, confidence, line FROM g_calls
UNION ALL SELECT path, id, 'contains', 'extracted', 0 FROM g_symbols
UNION ALL SELECT path, 'ext:' || nation, 'imports', 'extracted', 1 FROM g_files""",
    # The same calls with lines of the caller's file, and those lines; some lines are missing or name their callee elsewhere.
    "g_sites": "SELECT source, target, relation, confidence, CASE WHEN line = 7 THEN 0 ELSE CAST(span_from + line AS INT) END AS line FROM g_calls JOIN g_symbols ON id = source",
    "g_lines": """
SELECT path, CAST(line_no AS BIGINT) AS line_no, min(line) AS line FROM (SELECT a.path, a.span_from + line AS line_no, '  call ' || b.name || '()' AS line FROM g_calls JOIN g_symbols a ON a.id = source JOIN g_symbols b ON b.id = target WHERE line <> 6
UNION ALL SELECT path, span_from, 'def ' || name || ': token ' || name FROM g_symbols) x GROUP BY path, line_no""",
    # Documents with paths, and two snapshots of them.
    "t_docs": "SELECT doc_id, source || '/' || lang || '/' || CAST(doc_id AS STRING) || '.md' AS path, source, lang, text FROM documents",
    "snap_a": "SELECT path, doc_id, md5(text) AS content_hash, length(text) AS size, doc_id AS mtime FROM t_docs WHERE doc_id % 10 <> 0",
    "snap_b": """
SELECT CASE WHEN doc_id % 11 = 0 THEN 'moved/' || path ELSE path END AS path, doc_id, md5(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS content_hash,
  length(text) + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS size, doc_id + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS mtime FROM t_docs WHERE doc_id % 7 <> 0""",
    "t_count": "SELECT count(*) AS n FROM documents",
    "t_links": """
SELECT doc_id AS source, (doc_id * 7 + 3) % n AS target FROM documents, t_count
UNION ALL SELECT doc_id, (doc_id * 13 + 1) % n FROM documents, t_count WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, doc_id + 2000000 FROM documents WHERE doc_id % 4 = 0""",
    # Changed line ranges: every order's line items, around the order's span.
    "d_hunks": """
SELECT path, span_from + l_linenumber AS line_from, span_from + l_linenumber + CAST(l_quantity AS INT) % 7 AS line_to, l_linenumber AS hunk
FROM lineitem JOIN g_symbols ON orderkey = l_orderkey""",
    # Coverage reports.
    "c_cov": "SELECT 'src/' || p_brand || '/p' || CAST(l_partkey AS STRING) || '.py' AS path, l_linenumber AS line, CAST(greatest(l_quantity - 25, 0) AS BIGINT) AS hits, l_returnflag AS report FROM lineitem JOIN part ON l_partkey = p_partkey",
    # A run journal, sessions and timings.
    "l_journal": "SELECT user_id AS run, event_type AS node, event_id AS seq, ts, md5(props) AS input_hash, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'paused' ELSE 'done' END AS outcome, value AS seconds FROM events",
    "b_timings": "SELECT event_type AS name, user_id AS series, event_id AS seq, abs(value) AS ms FROM events",
    "m_msgs": "SELECT conv_id, turn, role, text FROM conversations",
    # Areas of documents and of the code graph, and what is asked of them.
    "a_areas": "SELECT DISTINCT source || '/' || lang AS scope, lang = 'de' AS local_only, lang = 'en' AS shared FROM documents",
    "a_scopes": "SELECT DISTINCT region || '/' || nation AS scope FROM g_files UNION SELECT DISTINCT nation || '/' || region FROM g_files",
    "a_asks": "SELECT custkey, CASE custkey % 4 WHEN 0 THEN region || '/' || nation WHEN 1 THEN nation WHEN 2 THEN region ELSE 'nowhere' END AS ask FROM g_files",
    "g_asks": "SELECT DISTINCT CASE custkey % 4 WHEN 0 THEN path WHEN 1 THEN nation || '/c' || CAST(custkey AS STRING) || CASE WHEN custkey % 3 = 0 THEN '.go' ELSE '.py' END WHEN 2 THEN CASE custkey % 3 WHEN 0 THEN region || '/' || nation || '.o' WHEN 1 THEN 'nowhere.o' ELSE nation || '.o' END || CAST(custkey % 1000 AS STRING) ELSE CASE custkey % 3 WHEN 0 THEN '#O' WHEN 1 THEN 'o' ELSE 'py#o' END || CAST(custkey % 1000 AS STRING) END AS ask FROM g_files",
    # Listings, catalogs, pages with headings.
    "s_listing": "SELECT CASE WHEN doc_id % 23 = 0 THEN '.hidden/' ELSE '' END || path AS path, length(text) AS size, doc_id % 17 = 0 AS ignored, doc_id % 19 = 0 AS link FROM t_docs",
    "s_tree": """
SELECT lower(p_brand) AS area, lower(p_brand) || CASE WHEN p_partkey % 7 = 0 THEN '/node_modules' ELSE '' END || '/p' || CAST(p_partkey AS STRING) || CASE WHEN p_partkey % 5 = 0 THEN '.min' ELSE '' END
  || CASE p_partkey % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.JS' WHEN 2 THEN '.md' ELSE '' END AS path, p_partkey AS partkey, p_size AS size FROM part""",
    "w_lines": "SELECT t_links.source AS page, target AS line_no, '* [' || CAST(target AS STRING) || '](' || path || ') text' AS line FROM t_links JOIN t_docs ON target = doc_id",
    "m_lines": "SELECT conv_id AS page, turn AS line_no, CASE turn % 4 WHEN 0 THEN '# ' || role WHEN 2 THEN '## part' ELSE text END AS line FROM conversations",
    "r_lines": "SELECT id, 'see `' || path || ':' || CAST(span_from AS STRING) || CASE WHEN orderkey % 2 = 0 THEN '-' || CAST(span_to AS STRING) ELSE '' END || '` here' AS line FROM g_symbols",
    "k_pages": """
SELECT doc_id, source || '/' || lang AS scope, source || '/' || lang || CASE WHEN doc_id % 17 = 0 THEN '/log.md' WHEN doc_id % 13 = 0 THEN '/d' || CAST(doc_id % 50 AS STRING) || '/index.md' ELSE '/d' || CAST(doc_id % 50 AS STRING) || '/' || CAST(doc_id AS STRING) || '.md' END AS path,
  CASE WHEN doc_id % 3 = 0 THEN 'guide' END AS type FROM documents""",
    "k_lines": "SELECT path, CASE doc_id % 3 WHEN 0 THEN '## 2024-01-0' || CAST(1 + doc_id % 9 AS STRING) WHEN 1 THEN '## May ' || CAST(doc_id AS STRING) ELSE 'text' END AS line FROM k_pages",
    # Function coverage and its exemptions, mutation outcomes, a version matrix.
    "f_table": """
SELECT 'p' || CAST(l_partkey AS STRING) || '.py:' || CAST(l_orderkey * 10 + l_linenumber AS STRING) || ':' || chr(9) || 'f' || CAST(l_suppkey AS STRING) || chr(9) || CASE WHEN l_linenumber = 7 THEN 'broken' ELSE CAST(CAST(l_quantity AS INT) * 2 AS STRING) || '.0%' END AS value
FROM lineitem""",
    "f_exempt": "SELECT 'p' || CAST(l_partkey AS STRING) || '.py' AS path, l_orderkey * 10 + l_linenumber - 1 AS line, CASE WHEN l_linestatus = 'O' THEN 'slow' ELSE ' ' END AS reason FROM lineitem WHERE l_returnflag = 'R'",
    "u_outcomes": "SELECT l_suppkey AS package, CASE CAST(l_quantity AS INT) % 6 WHEN 0 THEN 'passed' WHEN 1 THEN 'build_failed' WHEN 2 THEN 'unchanged' WHEN 3 THEN 'timed_out' ELSE 'failed' END AS outcome FROM lineitem",
    "x_entries": """
SELECT p_partkey AS key, p_brand AS fixture, CASE p_partkey % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'go' ELSE 'node' END AS runtime, CAST(p_size AS STRING) || '.' || CAST(p_partkey % 10 AS STRING) AS version,
  split(CASE WHEN p_partkey % 2 = 0 THEN 'linux' ELSE 'linux,windows' END, ',') AS os FROM part""",
    "x_old": "SELECT key, fixture, runtime, CASE WHEN key % 9 = 0 THEN '0.' || version ELSE version END AS version, os FROM x_entries WHERE key % 6 <> 0",
    "x_eol": "SELECT DISTINCT runtime, CASE WHEN key % 5 = 0 THEN version ELSE split_part(version, '.', 1) END AS cycle, 'ends ' || runtime || CASE WHEN key % 5 = 0 THEN ' ' || version ELSE '' END AS ends FROM x_entries WHERE key % 4 = 0",
    # Files as lines: fences and conflict boxes, diffs, coverage markers, ignore rules.
    "li_nth": "SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS nth FROM lineitem",
    "v_lines": """
SELECT 's/' || CAST(l_suppkey % 10 AS STRING) || '/' || CAST(l_suppkey AS STRING) || '.md' AS path, l_suppkey AS suppkey, CAST(l_orderkey * 100 + nth AS BIGINT) AS line_no,
  CASE (l_partkey + l_orderkey) % 17 WHEN 0 THEN '```' WHEN 1 THEN '  ~~~ x' WHEN 2 THEN '```py' WHEN 3 THEN '~~~' WHEN 4 THEN '> [!CONFLICT] a' WHEN 5 THEN '  > [!conflict]'
  WHEN 6 THEN 'see `src/p' || CAST(l_partkey AS STRING) || '.py:' || CAST(l_linenumber AS STRING) || '-9` and [x](../p' || CAST(l_partkey AS STRING) || '.py#L3)'
  WHEN 7 THEN '[up](../../../out.py) `a/../b/' || CAST(l_partkey AS STRING) || '.go/` `plain` [web](https://x.y/z) [abs](/a/b)' ELSE 'text' END AS line FROM li_nth""",
    "w_patch": """
SELECT 'o' || CAST(l_orderkey AS STRING) AS path, CAST(nth * 100 + k AS BIGINT) AS line_no,
  CASE WHEN k = 0 THEN 'diff --git a/p b/p' WHEN k = 1 THEN CASE WHEN l_returnflag = 'A' THEN '--- /dev/null' ELSE '--- a/p' || CAST(l_partkey AS STRING) END
  WHEN k = 2 THEN CASE WHEN l_returnflag = 'R' THEN '+++ /dev/null' ELSE '+++ b/p' || CAST(l_partkey AS STRING) END
  WHEN k = 3 THEN '@@ -' || CAST(l_partkey % 90 AS STRING) || ',' || CAST(CAST(l_quantity AS INT) % 5 AS STRING) || ' +' || CAST(l_partkey % 70 AS STRING) || CASE WHEN l_suppkey % 3 = 1 THEN '' ELSE ',' || CAST(l_suppkey % 3 AS STRING) END || ' @@ f'
  WHEN k < 4 + CAST(l_quantity AS INT) % 5 THEN '--- gone' ELSE '+++ came' END AS line
FROM li_nth JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9)) AS v(k) ON k < 4 + CAST(l_quantity AS INT) % 5 + l_suppkey % 3""",
    "x_src": """
SELECT 'p' || CAST(l_partkey AS STRING) || CASE WHEN l_partkey % 3 = 0 THEN '.js' ELSE '.py' END AS path, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, nth) AS line_no,
  CASE l_suppkey % 12 WHEN 0 THEN 'x = 1  # coverage:exempt: slow' WHEN 1 THEN '# coverage:exempt' WHEN 2 THEN '// coverage:exempt-file - generated' WHEN 3 THEN 'q = "coverage:exempt"' WHEN 4 THEN '# pragma: no cover' WHEN 5 THEN '# skip-start'
  WHEN 6 THEN '# skip-stop' WHEN 7 THEN '# too slow' WHEN 8 THEN '-- coverage:exempt: odd' WHEN 9 THEN 'a -- coverage:exempt' WHEN 10 THEN '# coverage:exempt-file' ELSE 'y = 2' END AS line FROM li_nth""",
    "i_rules": """
SELECT 0 AS level, '' AS base, 1 AS line_no, '*.tmp' AS line UNION ALL SELECT 1, '', 1, 'docs/**/x?.md' UNION ALL SELECT 2, '', 1, '# none' UNION ALL SELECT 2, '', 2, 'build/' UNION ALL SELECT 2, '', 3, '!keep.tmp'
UNION ALL SELECT 2, lower(p_brand), CAST(p_partkey AS INT) * 4, 'p' || CAST(p_partkey % 100 AS STRING) || '.*' FROM part
UNION ALL SELECT 2, lower(p_brand), CAST(p_partkey AS INT) * 4 + 1, '!p' || CAST(p_partkey % 50 AS STRING) || '.py' FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT 2, lower(p_brand) || '/node_modules', CAST(p_partkey AS INT) * 4 + 2, '/p' || CAST(p_partkey % 30 AS STRING) || '[0-4].min.*' FROM part WHERE p_partkey % 3 = 0""",
    "i_files": """
SELECT area || '/' || CASE partkey % 5 WHEN 0 THEN 'build/' WHEN 1 THEN 'docs/a/' WHEN 2 THEN 'node_modules/' WHEN 3 THEN 'docs/' ELSE '' END
  || CASE WHEN partkey % 9 = 0 THEN 'x' || CAST(partkey % 10 AS STRING) || '.md' WHEN partkey % 9 = 1 THEN 'keep.tmp' WHEN partkey % 9 = 2 THEN CAST(partkey AS STRING) || '.tmp' ELSE 'p' || CAST(partkey % 1000 AS STRING) || CASE partkey % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.min.js' ELSE '.go' END END AS path, partkey % 13 = 0 AS tracked FROM s_tree""",
    # The documents some time later: changed, gone and new ones.
    "d_now": """
SELECT doc_id AS id, path, CASE WHEN doc_id % 50 = 0 THEN text || ' licensed under nothing' ELSE text END AS text FROM t_docs WHERE doc_id % 70 <> 1
UNION ALL SELECT doc_id + 10000000, 'new/' || path, text FROM t_docs WHERE doc_id % 60 = 2""",
    # Modules in four layers: stars go one layer down, in the top layer also to a neighbour and back; named re-exports go to the bottom layer, in rings, too.
    "e_count": "SELECT count(*) AS n FROM part",
    "e_tops": "SELECT DISTINCT 'm' || CAST(l_partkey AS STRING) AS file, 'n' || CAST(l_linenumber AS STRING) AS name, 'm' || CAST(l_partkey AS STRING) || '#' || CAST(l_linenumber AS STRING) AS id, l_partkey % 5 <> 1 AS exported FROM lineitem WHERE l_suppkey % 7 = 0",
    "e_imports": """
SELECT 'm' || CAST(l_partkey AS STRING) AS file, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, nth) AS pos,
  CASE WHEN l_linenumber <= 2 THEN 'reexport' WHEN l_linenumber = 3 THEN 'export' ELSE '' END AS kind,
  CASE WHEN l_linenumber = 1 AND l_partkey % 4 > 0 THEN '*' WHEN l_linenumber = 5 THEN '*' ELSE 'n' || CAST(1 + l_suppkey % 7 AS STRING) END AS name,
  CASE WHEN l_linenumber <> 1 AND l_orderkey % 2 = 0 THEN 'n' || CAST(1 + l_orderkey % 7 AS STRING) END AS alias,
  CASE WHEN l_linenumber = 3 OR l_orderkey % 17 = 0 THEN NULL WHEN l_linenumber = 1 AND l_partkey % 4 > 0 THEN 'm' || CAST(((l_orderkey * 7 + l_suppkey) % CAST(floor(n / 4) AS BIGINT)) * 4 + l_partkey % 4 - 1 AS STRING)
  ELSE 'm' || CAST(((l_orderkey * 11 + l_partkey) % CAST(floor(n / 4) AS BIGINT)) * 4 AS STRING) END AS target FROM li_nth, e_count WHERE l_linenumber <= 5 AND (l_linenumber > 1 OR l_partkey % 4 = 0 OR l_orderkey % 3 = 0)
UNION ALL SELECT 'm' || CAST(p_partkey AS STRING), 0, 'reexport', '*', NULL, 'm' || CAST(CASE WHEN CAST(floor(p_partkey / 4) AS BIGINT) % 2 = 0 THEN p_partkey + 4 ELSE p_partkey - 4 END AS STRING) FROM part WHERE p_partkey % 4 = 3 AND p_partkey % 3 > 0""",
    # Pinned versions, and releases of them.
    "r_subjects": """
SELECT p_partkey AS pos, p_brand AS fixture, 's' || CAST(p_partkey % 2 AS STRING) AS stack, CASE WHEN p_partkey % 3 < 2 THEN 'runtime' ELSE 'crate' END AS kind, 'r' || CAST(p_partkey % 4 AS STRING) AS name,
  CASE WHEN p_partkey % 5 = 0 THEN CAST(p_size % 9 AS STRING) WHEN p_partkey % 5 = 1 THEN CAST(p_size % 9 AS STRING) || '.' || CAST(p_partkey % 12 AS STRING) || '.7' ELSE CAST(p_size % 9 AS STRING) || '.' || CAST(p_partkey % 6 AS STRING) END AS version, p_partkey % 11 = 0 AS held FROM part""",
    "r_releases": """
SELECT CASE WHEN o_custkey % 3 < 2 THEN 'runtime' ELSE 'crate' END AS kind, 'r' || CAST(o_custkey % 4 AS STRING) AS name, o_orderkey % 6 > 1 AS pre,
  CASE o_orderkey % 6 WHEN 0 THEN 'v' || CAST(o_orderkey % 8 AS STRING) || '.' || CAST(o_custkey % 9 AS STRING) || '.1' WHEN 1 THEN CAST(o_orderkey % 7 AS STRING) || '.' || CAST(o_custkey % 13 AS STRING) WHEN 2 THEN CAST(o_orderkey % 11 AS STRING) || '.' || CAST(o_custkey % 10 AS STRING) || '.0-beta.' || CAST(o_orderkey % 14 AS STRING)
  WHEN 3 THEN CAST(o_orderkey % 11 AS STRING) || '.' || CAST(o_custkey % 10 AS STRING) || 'rc' || CAST(o_orderkey % 14 AS STRING) WHEN 4 THEN CAST(o_orderkey % 10 AS STRING) || '.0.0-alpha.' || CAST(o_custkey % 20 AS STRING) || '.0' ELSE CAST(o_orderkey % 12 AS STRING) || CASE WHEN o_custkey % 2 = 0 THEN '-ea' ELSE '-odd' END END AS version FROM orders""",
    "r_titles": """
SELECT DISTINCT p_brand || CASE WHEN p_partkey % 3 = 0 THEN '@s' || CAST(p_size % 2 AS STRING) ELSE '' END || '/' || CASE WHEN p_partkey % 4 = 3 THEN 'crate:' ELSE '' END || 'r' || CAST(p_size % 4 AS STRING) || ' ' || CASE p_partkey % 4 WHEN 0 THEN CAST(p_size % 9 AS STRING) || '.' || CAST(p_partkey % 5 AS STRING)
  WHEN 1 THEN CAST(p_size % 10 AS STRING) WHEN 2 THEN CAST(p_size % 9 AS STRING) || '.' || CAST(p_partkey % 7 AS STRING) || 'rc1' ELSE 'v7.1' END || ' is out' AS title, p_partkey % 5 = 0 AS stands FROM part
UNION ALL SELECT DISTINCT 'r' || CAST(p_partkey % 4 AS STRING) || ' ' || CAST(p_size % 9 AS STRING) || '.' || CAST(p_partkey % 6 AS STRING) || ' is past end of support', false FROM part
UNION ALL SELECT 'something else', true""",
    # Merge events, areas, their pages and the cases that stand.
    "m_events": "SELECT o_orderkey AS event, 'repo' || CAST(o_custkey % 150 AS STRING) AS repo, split(CASE WHEN o_orderkey % 3 = 0 THEN 'a' || CAST(o_orderkey % 2 AS STRING) ELSE 'a' || CAST(o_orderkey % 2 AS STRING) || ',b' || CAST(o_orderkey % 5 AS STRING) END, ',') AS evidence FROM orders",
    "m_areas": "SELECT DISTINCT 'scope' || CAST(c_custkey % 120 AS STRING) AS scope, 'repo' || CAST(c_custkey % 120 AS STRING) AS repo FROM customer",
    "m_pages": "SELECT 'scope' || CAST(p_partkey % 100 AS STRING) AS scope, 'p' || CAST(p_partkey AS STRING) AS path, CASE p_size % 4 WHEN 0 THEN 'planned' WHEN 1 THEN 'partial' ELSE 'implemented' END AS state FROM part",
    "m_cases": "SELECT scope, path, CASE WHEN path LIKE '%7' THEN 'source' ELSE 'merge' END AS trigger, CASE WHEN path LIKE '%1' THEN 'a0 a1 b0 b1 b2 b3 b4' WHEN path LIKE '%2' THEN 'a0, b0' ELSE 'a1 b1 b2' END AS package FROM m_pages WHERE path LIKE '%1' OR path LIKE '%2' OR path LIKE '%53' OR path LIKE '%7' AND scope LIKE '%7'",
    # Which directories and files of the code graph are open.
    "g_open": "SELECT DISTINCT region AS element FROM g_files WHERE region <> 'asia' UNION SELECT DISTINCT region || '/' || nation FROM g_files WHERE nation < 'j' UNION SELECT path FROM g_files WHERE custkey % 3 = 0",
    "g_pages": "SELECT doc_id, 'docs/' || CAST(doc_id AS STRING) || '.md' AS path FROM documents",
    "g_page_refs": """
SELECT 'docs/' || CAST(o_custkey % n AS STRING) || '.md' AS page, CASE o_orderkey % 5 WHEN 0 THEN region WHEN 1 THEN region || '/' || nation WHEN 2 THEN 'gone/' || CAST(o_orderkey AS STRING) WHEN 3 THEN 'docs/' || CAST(o_orderkey % n AS STRING) || '.md' ELSE path END AS path,
  CASE WHEN o_orderkey % 10 = 4 THEN path || '#o' || CAST(o_orderkey AS STRING) END AS symbol FROM orders JOIN g_files ON o_custkey = custkey, t_count""",
    # Nested values as JSON, keys in two orders.
    "j_json": """
SELECT o_orderkey AS key, CASE WHEN o_orderkey % 2 = 0 THEN '{"b": {"y": [1, {"q": true, "p": null}], "x": ' || CAST(o_custkey AS STRING) || '}, "a": "' || o_orderstatus || '"}' ELSE '{ "a":"' || o_orderstatus || '","b":{"x":' || CAST(o_custkey AS STRING) || ',"y":[1,{"p":null,"q":true}]} }' END AS inputs,
  CASE o_orderkey % 4 WHEN 0 THEN '{"id": 1, "kind": "x"}' WHEN 1 THEN '{"kind": "x", "id": 1, "more": 2}' WHEN 2 THEN '{"kind": 3}' ELSE '[1]' END AS row FROM orders""",
    # Pages with headers, and catalogs.
    "h_pages": """
SELECT CASE WHEN o_orderkey % 40 = 0 THEN 'd' || CAST(o_orderkey % 70 AS STRING) || '/' || CAST(o_orderkey AS STRING) || '/index.md' ELSE 'd' || CAST(o_orderkey % 70 AS STRING) || '/p' || CAST(o_orderkey AS STRING) || '.md' END AS path,
  CASE WHEN o_orderkey % 9 = 0 THEN 'no header' WHEN o_orderkey % 9 = 1 THEN '---' || chr(10) || 'title: open' WHEN o_orderkey % 9 = 2 THEN '---' || chr(10) || 'type: x' || chr(10) || '= odd' || chr(10) || '---' || chr(10) ELSE '---' || chr(10) || CASE WHEN o_orderkey % 4 = 0 THEN 'title: "Page ' || CAST(o_orderkey AS STRING) || '"' || chr(10) ELSE '' END
  || 'type: ' || CASE WHEN o_orderkey % 5 = 0 THEN 'Attested Computation' ELSE 'guide' END || chr(10) || CASE WHEN o_orderkey % 10 = 0 THEN 'runtime: py' || chr(10) ELSE '' END || 'tags: [a, ' || o_orderstatus || ']' || chr(10) || 'sources:' || chr(10) || '  - id: s' || CAST(o_custkey AS STRING) || chr(10) || '    resource: r1' || chr(10) || '  - resource: r2' || chr(10)
  || CASE WHEN o_orderkey % 3 = 0 THEN 'generated:' || chr(10) || '  by: ' || CASE WHEN o_orderkey % 2 = 0 THEN 'tool' ELSE '' END || chr(10) ELSE '' END || '---' || chr(10) || 'See [x](other.md#a), ![i](pic.png) and [[wiki page|w]].' END AS text FROM orders
UNION ALL SELECT 'd' || CAST(k AS STRING) || '/index.md', '* [a](p' || CAST(k AS STRING) || '.md) - first ' || chr(10) || '* [b](p' || CAST(k + 70 AS STRING) || '.md#x) –' || chr(10) || '[c](./p' || CAST(k + 140 AS STRING) || '.md?q=1), [d](/d' || CAST(k AS STRING) || '/p' || CAST(k + 210 AS STRING) || '.md) last' || chr(10) || '[sub](sub/)' FROM (SELECT DISTINCT o_orderkey % 70 AS k FROM orders) WHERE k % 2 = 0""",
    # Names as values, selectors of imported packages, calls on results.
    "k_defs": "SELECT id, name, path AS file, regexp_replace(path, '/[^/]*$', '') AS dir, CASE WHEN orderkey % 4 = 0 THEN 'T' || CAST(orderkey % 3 AS STRING) ELSE '' END AS owner, 'func ' || name || '(f func(int) string, n int) ' || CASE orderkey % 5 WHEN 0 THEN '*T0' WHEN 1 THEN '(t T1, err error)' WHEN 2 THEN '(*x.T2, error)' WHEN 3 THEN '' ELSE 'T2[int]' END AS signature FROM g_symbols",
    "k_files": "SELECT path AS file, CASE WHEN custkey % 10 = 0 THEN nation || '_test' ELSE nation END AS package FROM g_files",
    "k_clauses": "SELECT DISTINCT region || '/' || nation AS dir, CASE WHEN nation LIKE '%1' THEN 'main' ELSE nation END AS package FROM g_files",
    "k_imports": "SELECT a.path AS file, b.custkey AS pos, CASE b.custkey % 5 WHEN 0 THEN 'al' WHEN 1 THEN '_' ELSE '' END AS alias, CASE WHEN b.custkey % 11 <> 0 THEN b.region || '/' || b.nation END AS dir FROM g_files a JOIN g_files b ON b.custkey % 50 = a.custkey % 50",
    "k_raw": "SELECT CAST(o_orderkey AS STRING) AS raw_id, path AS file, (region) || '/' || nation AS dir, 'o' || CAST(o_orderkey * 7 % 1000 AS STRING) AS name, CASE WHEN o_orderkey % 3 = 0 THEN 'al' WHEN o_orderkey % 3 = 1 THEN 'main' ELSE 'nation_' || CAST(o_orderkey % 25 AS STRING) END AS receiver, CAST(o_orderkey * 3 % 1500 AS STRING) AS via FROM orders JOIN g_files ON custkey = o_custkey",
    # Sources of shared areas, changes beside a wiki, tools and lanes, questions.
    "b_sources": "SELECT source || '/' || lang AS scope, path, CASE doc_id % 5 WHEN 0 THEN 'BRAIN:/' || source || '/' || lang || '/x.md#a' WHEN 1 THEN 'brain:' || source || '/en/y?b=1' WHEN 2 THEN 'brain://' WHEN 3 THEN 'https://x' ELSE 'brain:' || source || '/english' END AS resource FROM t_docs",
    "b_changes": "SELECT 'o' || CAST(l_orderkey AS STRING) AS project, CASE WHEN l_linenumber % 3 = 0 THEN 'docs/wiki/p.md' WHEN l_linenumber % 3 = 1 THEN 'docs/wikipedia.md' ELSE 'src/a.py' END AS path FROM lineitem",
    "b_wikis": "SELECT 'o' || CAST(o_orderkey AS STRING) AS project, CASE WHEN o_orderkey % 7 = 0 THEN '.' ELSE 'docs/wiki' END AS wiki FROM orders WHERE o_orderkey % 5 <> 0",
    "b_tools": "SELECT DISTINCT 'o' || CAST(l_orderkey AS STRING) AS project, CASE l_linenumber WHEN 1 THEN 'go-test' WHEN 2 THEN 'go-vet' WHEN 3 THEN 'ruff' ELSE 'mypy' END AS tool FROM lineitem",
    "b_lanes": "SELECT 'o' || CAST(l_orderkey AS STRING) AS project, l_linenumber AS pos, CASE l_suppkey % 5 WHEN 0 THEN ' go test ./...' WHEN 1 THEN 'cargo test && go vet x' WHEN 2 THEN 'ruff' WHEN 3 THEN 'ruffle;mypy .' ELSE 'cargo test' END AS lane FROM lineitem",
    "q_hits": "SELECT item_id, min(doc_id) AS expected FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY item_id",
}


#: The same rows for Spark in fewer shuffles: what a call names is looked up once a part and not once a call, and lines and
#: sites come from the caller itself instead of a second join by its id.
LIGHT = {
    "g_targets": "SELECT partkey, s.orderkey AS orderkey, id, name FROM g_first f JOIN g_symbols s ON s.orderkey = f.orderkey",
    "g_calls": """
SELECT a.id AS source, b.id AS target, 'calls' AS relation, CASE WHEN l_returnflag = 'R' THEN 'inferred' ELSE 'extracted' END AS confidence, CAST(l_linenumber AS INT) AS line
FROM lineitem JOIN g_targets b ON l_partkey = partkey JOIN g_symbols a ON a.orderkey = l_orderkey WHERE l_orderkey <> b.orderkey""",
    "g_sites": """
SELECT a.id AS source, b.id AS target, 'calls' AS relation, CASE WHEN l_returnflag = 'R' THEN 'inferred' ELSE 'extracted' END AS confidence, CASE WHEN CAST(l_linenumber AS INT) = 7 THEN 0 ELSE CAST(span_from + CAST(l_linenumber AS INT) AS INT) END AS line
FROM lineitem JOIN g_targets b ON l_partkey = partkey JOIN g_symbols a ON a.orderkey = l_orderkey WHERE l_orderkey <> b.orderkey""",
    "g_lines": """
SELECT path, CAST(line_no AS BIGINT) AS line_no, min(line) AS line FROM (SELECT a.path, a.span_from + CAST(l_linenumber AS INT) AS line_no, '  call ' || b.name || '()' AS line
FROM lineitem JOIN g_targets b ON l_partkey = partkey JOIN g_symbols a ON a.orderkey = l_orderkey WHERE l_orderkey <> b.orderkey AND CAST(l_linenumber AS INT) <> 6
UNION ALL SELECT path, span_from, 'def ' || name || ': token ' || name FROM g_symbols) x GROUP BY path, line_no""",
}


def _needs(name: str, views: dict[str, str] = VIEWS) -> list[str]:
    """The views that a view's or query's text names, each after those it needs."""
    text = views.get(name, name)
    out: list[str] = []
    for other in views:
        if other != name and re.search(rf"\b{other}\b", text):
            for x in [*_needs(other, views), other]:
                if x not in out:
                    out.append(x)
    return out


def with_views(sql: str) -> str:
    """DuckDB SQL with the views that it names as common table expressions in front."""
    ctes = [f"{v} AS ({VIEWS[v].strip()})" for v in _needs(sql)]
    if not ctes:
        return sql
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    if own:
        return f"WITH RECURSIVE {', '.join(ctes)}, {sql[own.end() :]}"
    return f"WITH {', '.join(ctes)} {sql}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table, as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    views = {**VIEWS, **LIGHT}
    needs = [*_needs(name, views), name]
    text = f"WITH {', '.join(f'{v} AS ({views[v].strip()})' for v in needs)} SELECT * FROM {name}"
    text = text.replace("{", "{{").replace("}", "}}")
    used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]
    for t in used:
        text = re.sub(rf"\b(FROM|JOIN|,) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})
