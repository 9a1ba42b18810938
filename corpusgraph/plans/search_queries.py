"""Queries of the text-search operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, collapse, content_hash, fold_umlauts, grams, lines, tokens
from ..operators import search
from .registry import Tables, query

QUERY = "license public general version the of"
STOP = "(" + ",".join(f"'{w}'" for w in STOP_WORDS) + ")"
#: Tokens as the tokeniser makes them.
TOKENS = "list_filter(string_split_regex(lower(regexp_replace({c}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda t: length(t) > 1 AND t NOT IN " + STOP + ")"


def toks(column: str) -> str:
    return TOKENS.replace("{c}", column)


def docs(t: Tables) -> DataFrame:
    return t.t_docs.withColumnRenamed("doc_id", "id")


@query("t1_tokens", f"SELECT doc_id, len(k) AS n, sha256(array_to_string(k, ' ')) AS tokens_sha256 FROM (SELECT doc_id, {toks('text')} AS k FROM documents)")
def tokenised(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tokens(F.col("text")).alias("k")).select("doc_id", F.size("k").cast("long").alias("n"), F.sha2(F.array_join("k", " "), 256).alias("tokens_sha256"))


@query("a1_term_counts", f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({toks('text')}) AS term FROM documents) GROUP BY ALL")
def term_counts(t: Tables) -> DataFrame:
    return search.postings(docs(t), {"body": "text"}).select(F.col("id").alias("doc_id"), "term", "tf")


@query("a2_term_stats", f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({toks('text')}) AS term FROM documents UNION ALL SELECT doc_id, unnest({toks('path')}) FROM t_docs) GROUP BY term")
def term_stats(t: Tables) -> DataFrame:
    return search.term_stats(search.postings(docs(t), {"body": "text", "path": "path"}))


LEXICAL = f"""b AS MATERIALIZED (SELECT doc_id AS id, {toks('path')} AS p, {toks('text')} AS w FROM t_docs),
q AS MATERIALIZED (SELECT term, count(*) AS qtf FROM (SELECT unnest({toks("'" + QUERY + "'")}) AS term) GROUP BY term),
h AS MATERIALIZED (SELECT id, term, qtf, len(list_filter(p, lambda x: x = term)) AS np, len(list_filter(w, lambda x: x = term)) AS nw, len(w) AS n FROM b, q),
s AS MATERIALIZED (SELECT count(*) AS docs, avg(len(w)) AS al FROM b),
i AS MATERIALIZED (SELECT term, ln(1 + (SELECT docs FROM s) / (1 + count(*) FILTER (np + nw > 0))) AS idf FROM h GROUP BY term),
lex AS MATERIALIZED (SELECT id, sum(idf * (2.0 * qtf * np + CASE WHEN nw > 0 THEN nw * 2.2 / (nw + 1.2 * (0.25 + 0.75 * n / al)) ELSE 0 END)) AS lexical FROM h JOIN i USING (term), s GROUP BY id)"""


@query("t5_lexical", f"WITH {LEXICAL} SELECT id, round(lexical, 6) AS lexical FROM lex WHERE lexical > 0")
def lexical(t: Tables) -> DataFrame:
    return search.lexical(docs(t), QUERY, None, "path", "text").select("id", F.round("lexical", 6).alias("lexical"))


@query("w1_top_hits", f"WITH {LEXICAL} SELECT id, round(lexical, 6) AS lexical FROM lex WHERE lexical > 0 ORDER BY 2 DESC, id LIMIT 8")
def top_hits(t: Tables) -> DataFrame:
    return search.top(lexical(t), "lexical")


@query("w15_normalised", f"WITH {LEXICAL} SELECT id, round(lexical / max(lexical) OVER (), 6) AS lexical FROM lex WHERE lexical > 0")
def normalised(t: Tables) -> DataFrame:
    rows = search.lexical(docs(t), QUERY, None, "path", "text")
    return rows.crossJoin(F.broadcast(rows.agg(F.max("lexical").alias("top")))).select("id", F.round(F.col("lexical") / F.col("top"), 6).alias("lexical"))


def _hybrid_sql() -> str:
    steps = ["r0 AS MATERIALIZED (SELECT id, r AS mass FROM base)"]
    for i in range(25):
        steps.append(
            f"r{i + 1} AS MATERIALIZED (SELECT id, sum(got) AS mass FROM (SELECT dst AS id, mass * share * 0.75 AS got FROM r{i} JOIN adj ON src = id UNION ALL "
            f"SELECT id, r * (0.25 + 0.75 * (SELECT coalesce(sum(mass), 0) FROM r{i} WHERE id NOT IN (SELECT src FROM adj))) FROM base) GROUP BY id)"
        )
    return (
        f"WITH {LEXICAL}, l AS MATERIALIZED (SELECT * FROM lex WHERE lexical > 0), p AS MATERIALIZED (SELECT source AS src, target AS dst FROM t_links WHERE target IN (SELECT doc_id FROM documents)), "
        "adj AS MATERIALIZED (SELECT src, dst, count(*) / sum(count(*)) OVER (PARTITION BY src) AS share FROM (SELECT src, dst FROM p UNION ALL SELECT dst, src FROM p) GROUP BY src, dst), "
        "base AS MATERIALIZED (SELECT id, lexical / sum(lexical) OVER () AS r FROM l), " + ", ".join(steps) + ", g AS (SELECT id, mass / (SELECT max(mass) FROM r25) AS graph FROM r25 WHERE mass > 0) "
        "SELECT id, round(coalesce(lexical, 0) / (SELECT max(lexical) FROM l) + 0.5 * coalesce(graph, 0), 6) AS score FROM l FULL JOIN g USING (id) WHERE lexical IS NOT NULL OR graph >= 0.15 ORDER BY score DESC, id LIMIT 8"
    )


@query("t6_hybrid", _hybrid_sql())
def hybrid(t: Tables) -> DataFrame:
    edges = t.t_links.withColumns({"relation": F.lit("references"), "confidence": F.lit("extracted"), "line": F.lit(1)})
    return search.hybrid(docs(t), edges, QUERY, None, "path", "text").select("id", "score")


@query("s6_lines", "SELECT doc_id, i AS line_no, regexp_replace(l[i], '\r$', '') AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))")
def all_lines(t: Tables) -> DataFrame:
    return lines(t.documents, "doc_id", "text").withColumn("line_no", F.col("line_no").cast("long"))


GRAMS = "SELECT DISTINCT doc_id, l[i] || l[i + 1] || l[i + 2] AS gram FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM (SELECT doc_id, string_split(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS l FROM documents)) WHERE strlen(l[i]) = 1 AND strlen(l[i + 1]) = 1 AND strlen(l[i + 2]) = 1"


@query("t8_trigrams", f"SELECT doc_id, count(*) AS n FROM ({GRAMS}) GROUP BY doc_id")
def trigrams(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(grams(F.col("text"))).cast("long").alias("n")).filter("n > 0")


@query("t9_gram_index", f"SELECT gram, count(*) AS n FROM ({GRAMS}) GROUP BY gram")
def gram_index(t: Tables) -> DataFrame:
    return search.gram_index(docs(t)).groupBy("gram").agg(F.count("*").alias("n"))


def _candidates(t: Tables, alternatives: list[list[str]]) -> DataFrame:
    return search.candidates(search.postings_of(docs(t), alternatives), docs(t), alternatives)


@query("t10_candidates", f"WITH gx AS MATERIALIZED ({GRAMS}), a AS (SELECT unnest(['lic', 'ice', 'cen', 'ens', 'nse', 'sed']) AS gram), b AS (SELECT unnest(['thh', 'hhe', 'hen']) AS gram) SELECT doc_id AS id FROM gx JOIN a USING (gram) GROUP BY doc_id HAVING count(*) = 6 UNION SELECT doc_id FROM gx JOIN b USING (gram) GROUP BY doc_id HAVING count(*) = 3")
def pruned(t: Tables) -> DataFrame:
    return _candidates(t, [["licens", "sed", "nse"], ["Thhen"]])


HITS = "hits AS MATERIALIZED (SELECT doc_id AS id, i AS line_no, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE regexp_matches(l[i], '{p}'))"


@query("t11_grep", "WITH " + HITS.replace("{p}", "licensed under|token = .[0-9a-f]+") + " SELECT id, line_no, md5(line) AS line FROM hits")
def grep(t: Tables) -> DataFrame:
    found = search.grep(docs(t), "licensed under|token = .[0-9a-f]+", _candidates(t, [["licensed under"], ["token = "]]))
    return found.select("id", F.col("line_no").cast("long").alias("line_no"), F.md5("line").alias("line"))


@query("t11_grep_ignore_case", "WITH " + HITS.replace("{p}", "(?i)the thing") + " SELECT id, line_no FROM hits")
def grep_fold(t: Tables) -> DataFrame:
    return search.grep(docs(t), "the thing", None, True, True).select("id", F.col("line_no").cast("long").alias("line_no"))


@query("t12_grouped_grep", "WITH " + HITS.replace("{p}", "thing") + " SELECT source || '/' || lang AS dir, count(*) AS hits, count(DISTINCT id) AS docs FROM hits JOIN t_docs ON doc_id = id GROUP BY 1")
def grouped(t: Tables) -> DataFrame:
    hits = search.grep(docs(t), "thing", None, True)
    return hits.join(docs(t).select("id", F.concat_ws("/", "source", "lang").alias("dir")), "id").groupBy("dir").agg(F.count("*").alias("hits"), F.count_distinct("id").alias("docs"))


@query("t13_counters", "WITH " + HITS.replace("{p}", "token") + " SELECT (SELECT count(*) FROM documents) AS in_scope, (SELECT count(*) FROM documents WHERE contains(text, chr(0))) AS binary, (SELECT count(*) FROM documents WHERE contains(lower(text), 'tok') AND contains(lower(text), 'oke') AND contains(lower(text), 'ken')) AS candidates, count(DISTINCT id) AS with_hits, count(*) AS hits FROM hits")
def counters(t: Tables) -> DataFrame:
    return search.search_counters(docs(t), _candidates(t, [["token"]]), search.grep(docs(t), "token", None, True))


@query("t15_keyword", f"WITH {LEXICAL} SELECT id, round(lexical, 6) AS lexical FROM lex WHERE lexical > 0 ORDER BY 2 DESC, id LIMIT 20")
def keyword(t: Tables) -> DataFrame:
    return search.top(lexical(t), "lexical", 20)


COSINE = "v AS MATERIALIZED (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS n FROM embeddings), c AS MATERIALIZED (SELECT q.id AS query, v.id, round(list_sum(list_transform(range(1, len(v.e) + 1), lambda i: (q.e[i] / q.n) * (v.e[i] / v.n))), 6) AS score FROM v JOIN v q ON v.id <> q.id AND q.id % 100 = 0)"


@query("t16_vectors", f"WITH {COSINE} SELECT query, id, score, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS k FROM c) WHERE k <= 8")
def vectors(t: Tables) -> DataFrame:
    v = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return search.nearest(v.filter("id % 100 = 0"), v, 8)


@query("w14_caps", "SELECT source, lang, shown, greatest(n - 3, 0) AS hidden FROM (SELECT source, lang, count(*) AS n, array_to_string(list_sort(list(doc_id))[1:3], ',') AS shown FROM documents GROUP BY ALL)")
def caps(t: Tables) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("source", "lang").orderBy("doc_id"))
    rows = t.documents.select("source", "lang", "doc_id", k.alias("k"))
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= 3, F.col("doc_id")))), lambda x: x.cast("string")), ",")
    return rows.groupBy("source", "lang").agg(shown.alias("shown"), F.sum((F.col("k") > 3).cast("int")).alias("hidden"))


@query("f5_hashes", "SELECT doc_id, 'sha256:' || sha256(replace(text, chr(13) || chr(10), chr(10))) AS h, sha256(left(trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g')), 5000)) AS body, sha256(replace(replace(replace(replace(text, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')) AS folded FROM documents")
def hashes(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", content_hash(F.col("text")).alias("h"), F.sha2(collapse(F.col("text"), 5000), 256).alias("body"), F.sha2(fold_umlauts(F.col("text")), 256).alias("folded"))


@query("j50_quotes", "WITH " + HITS.replace("{p}", "\\btoken\\b") + " SELECT id, arg_min(md5(line), line_no) AS quote, min(line_no) AS line_no FROM hits GROUP BY id")
def quotes(t: Tables) -> DataFrame:
    return search.grep(docs(t), "\\btoken\\b").groupBy("id").agg(F.min_by(F.md5("line"), "line_no").alias("quote"), F.min("line_no").cast("long").alias("line_no"))
