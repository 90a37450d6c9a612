"""Chunking, diffs and retrieval over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import text as tx
from tallyloom.operators import chunks as ch
from tallyloom.operators import retrieval as rt
from tallyloom.plans import views as v
from tallyloom.plans.registry import Registry
from tallyloom.sources.files import language

R = Registry()

_SRC = "WITH s AS (SELECT DISTINCT file_id, content FROM source_files WHERE content IS NOT NULL AND trim(content, ' ') <> ''), l AS (SELECT file_id, regexp_split_to_array(regexp_replace(content, '(\\r\\n|\\r|\\n)$', ''), '\\r\\n|\\r|\\n') AS ls FROM s)"


def sources(spark: SparkSession, d: str) -> DataFrame:
    return v.load(spark, d, "source_files").filter("content is not null").select("file_id", "file_path", "content").distinct()


@R.add("w07_sliding_chunks", _SRC + ", w AS (SELECT file_id, ls, len(ls) AS n, unnest(generate_series(0, greatest(len(ls) - 1, 0), 39)) AS s FROM l) SELECT file_id, CAST(s + 1 AS INTEGER) AS start_line, CAST(least(s + 40, n) AS INTEGER) AS end_line, md5(array_to_string(ls[s + 1 : s + 40], chr(10))) AS sum FROM w WHERE s = 0 OR s - 39 + 40 < n")
def w07_sliding_chunks(spark, d):
    c = ch.sliding_chunks(sources(spark, d).select("file_id", "content").distinct().withColumnRenamed("content", "t"), "t", 40)
    return c.select("file_id", "start_line", "end_line", F.md5("content").alias("sum"))


@R.add("w08_split_chunks", _SRC + ", w AS (SELECT file_id, ls, len(ls) AS n, unnest(generate_series(0, greatest(len(ls) - 1, 0), 64)) AS s FROM l) SELECT file_id, CAST(s + 1 AS INTEGER) AS start_line, CAST(least(s + 80, n) AS INTEGER) AS end_line, md5(array_to_string(ls[s + 1 : s + 80], chr(10))) AS sum FROM w")
def w08_split_chunks(spark, d):
    c = ch.split_chunks(sources(spark, d).select("file_id", "content").distinct().withColumnRenamed("content", "t"), "t")
    return c.select("file_id", "start_line", "end_line", F.md5("content").alias("sum"))


@R.add("w09_boundary_chunks", r"""
    WITH s AS (SELECT DISTINCT file_id, content, CASE lower(regexp_extract(regexp_extract(file_path, '([^/]*)$', 1), '^\.*[^.].*?(\.[^.]*)$', 1)) WHEN '.js' THEN 'javascript' WHEN '.ts' THEN 'typescript' WHEN '.go' THEN 'go' WHEN '.java' THEN 'java' ELSE 'other' END AS lang FROM source_files WHERE content IS NOT NULL),
    l AS (SELECT row_number() OVER () AS k, file_id, lang, regexp_split_to_array(regexp_replace(content, '(\r\n|\r|\n)$', ''), '\r\n|\r|\n') AS ls FROM s),
    r AS (SELECT k, file_id, lang, ls, unnest(generate_series(1, len(ls))) AS i FROM l WHERE lang <> 'other'),
    b AS (SELECT k, file_id, i, ls[i] AS ln, (i = 1 OR CASE lang
        WHEN 'javascript' THEN regexp_matches(ls[i], '^(?:export\s+)?(?:async\s+)?(?:function\s+\w+|const\s+\w+\s*=\s*(?:async\s+)?\()')
        WHEN 'typescript' THEN regexp_matches(ls[i], '^(?:export\s+)?(?:async\s+)?(?:function\s+\w+|const\s+\w+\s*=\s*(?:async\s+)?\(|class\s+\w+)')
        WHEN 'java' THEN regexp_matches(ls[i], '^\s*(?:public|private|protected|static|final|abstract|\s)+\s+\w[\w<>\[\]]*\s+\w+\s*\(')
        ELSE regexp_matches(ls[i], '^func\s+') END)::INT AS is_b FROM r),
    g AS (SELECT *, sum(is_b) OVER (PARTITION BY k ORDER BY i) AS seg FROM b),
    c AS (SELECT file_id, min(i) AS base, list(ln ORDER BY i) AS ls, 64 AS step FROM g GROUP BY k, file_id, seg UNION ALL SELECT file_id, 1, ls, 78 FROM l WHERE lang = 'other'),
    w AS (SELECT *, len(ls) AS n, unnest(generate_series(0, len(ls) - 1, step)) AS o FROM c WHERE len(list_filter(ls, lambda x: length(trim(x, ' ')) > 0)) > 0)
    SELECT file_id, CAST(base + o AS INTEGER) AS start_line, CAST(base + least(o + 80, n) - 1 AS INTEGER) AS end_line, md5(array_to_string(ls[o + 1 : o + 80], chr(10))) AS sum FROM w WHERE step = 64 OR o = 0 OR o - step + 80 < n""")
def w09_boundary_chunks(spark, d):
    """Files of all languages cut where functions and classes begin, parts over 80 lines into windows that overlap by 16."""
    s = sources(spark, d).select("file_id", "content", language(F.col("file_path")).alias("language")).distinct()
    c = ch.boundary_chunks(s, "file_id", "content", F.col("language"), 80, 16)
    return c.select("file_id", "start_line", "end_line", F.md5("content").alias("sum"))


_DIFF = r"""
    WITH p AS (SELECT doc_id, regexp_split_to_array(text, '\r?\n') AS ls FROM documents WHERE kind = 'diff' AND text IS NOT NULL),
    r AS (SELECT doc_id, unnest(ls) AS ln, generate_subscripts(ls, 1) AS i FROM p),
    h AS (SELECT *, CASE WHEN regexp_matches(ln, '^@@ -\d+(?:,\d+)? \+(\d+)') THEN CAST(regexp_extract(ln, '^@@ -\d+(?:,\d+)? \+(\d+)', 1) AS INTEGER) END AS head FROM r),
    m AS (SELECT *, (head IS NULL AND NOT regexp_matches(ln, '^(?:--- |\+\+\+ |diff --git |index [0-9a-f]+\.\.)') AND NOT starts_with(ln, '\') AND NOT starts_with(ln, '-'))::INT AS n FROM h),
    c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM m),
    e AS (SELECT *, last_value(head IGNORE NULLS) OVER w AS st, last_value(CASE WHEN head IS NOT NULL THEN before END IGNORE NULLS) OVER w AS at_head FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING))
    SELECT doc_id, CAST(st + before - at_head AS INTEGER) AS line, CASE WHEN starts_with(ln, '+') THEN '+' ELSE ' ' END AS kind, substr(ln, 2) AS text FROM e WHERE n = 1 AND st IS NOT NULL"""


def diffs(spark: SparkSession, d: str) -> DataFrame:
    return v.load(spark, d, "documents").filter("kind = 'diff' and text is not null").select("doc_id", "text")


@R.add("w06_diff_lines", _DIFF)
def w06_diff_lines(spark, d):
    return ch.diff_lines(diffs(spark, d), ["doc_id"], "text")


@R.add("f10_diff_counts", r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\r?\n'), lambda x: starts_with(x, '+') AND NOT starts_with(x, '+++'))) AS INTEGER) AS added, CAST(len(list_filter(regexp_split_to_array(text, '\r?\n'), lambda x: starts_with(x, '-') AND NOT starts_with(x, '---'))) AS INTEGER) AS removed FROM documents WHERE kind = 'diff' AND text IS NOT NULL")
def f10_diff_counts(spark, d):
    """Also P11."""
    plus, minus = ch.diff_counts(F.col("text"))
    return diffs(spark, d).select("doc_id", plus.alias("added"), minus.alias("removed"))


@R.add("f14_split_diff", r"SELECT doc_id, CAST(len(list_filter(string_split(regexp_replace(text, '(?m)^(--- a/|diff --git )', chr(1) || '\1', 'g'), chr(1)), lambda x: length(trim(x, ' ')) > 0)) AS INTEGER) AS n_files FROM documents WHERE kind = 'diff' AND text IS NOT NULL")
def f14_split_diff(spark, d):
    return diffs(spark, d).select("doc_id", F.size(ch.split_diff(F.col("text"))).alias("n_files"))


@R.add("p24_on_added_lines", f"WITH x AS ({_DIFF}) SELECT DISTINCT doc_id, line AS line_start FROM x WHERE kind = '+'")
def p24_on_added_lines(spark, d):
    """Every line of the new files as a place."""
    lines = ch.diff_lines(diffs(spark, d), ["doc_id"], "text")
    return ch.valid_lines(lines.select("doc_id", F.col("line").alias("line_start")).distinct(), lines, ["doc_id"])


_TOK = r"list_filter(list_transform(regexp_split_to_array(regexp_replace({}, '([a-z])([A-Z])', '\1 \2', 'g'), '[^a-zA-Z0-9_]+'), lambda x: lower(x)), lambda x: len(x) > 1)"


@R.add("f01_code_tokens", f"SELECT doc_id, CAST(len({_TOK.format('text')}) AS INTEGER) AS n, md5(array_to_string({_TOK.format('text')}, ' ')) AS sum FROM documents WHERE text IS NOT NULL")
def f01_code_tokens(spark, d):
    t = v.load(spark, d, "documents").filter("text is not null").select("doc_id", tx.code_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("sum"))


_BM25 = f"""
    WITH d AS (SELECT doc_id, {_TOK.format('text')} AS ts FROM documents WHERE text IS NOT NULL),
    st AS (SELECT count(*) AS n_docs, avg(len(ts)) AS avgdl FROM d),
    t AS (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM d),
    ix AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM t GROUP BY 1, 2),
    r AS (SELECT term, ln(n_docs - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM ix, st GROUP BY term, n_docs),
    idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM r) ELSE raw END AS idf FROM r),
    q AS (SELECT doc_id AS query, term, count(*) AS qf FROM t WHERE doc_id % 100 = 0 GROUP BY 1, 2),
    s AS (SELECT query, ix.doc_id, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN idf USING (term) JOIN ix USING (term), st GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank FROM s)"""


def searched(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    """Documents whose id is divisible by 100 as queries against all documents."""
    docs = v.load(spark, d, "documents").filter("text is not null").select("doc_id", "text")
    return rt.search_texts(docs, docs.filter("doc_id % 100 = 0"), "doc_id", "text", "doc_id", "text", k)


@R.add("a21_bm25_stats", _BM25 + " SELECT term, CAST(count(*) AS BIGINT) AS df FROM ix GROUP BY 1")
def a21_bm25_stats(spark, d):
    docs = v.load(spark, d, "documents").filter("text is not null")
    return rt.postings(docs, "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"))


@R.add("t07_bm25_top", _BM25 + " SELECT query, doc_id, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 10 AND score > 0")
def t07_bm25_top(spark, d):
    return searched(spark, d).select("query", "doc_id", "rank")


_DENSE = "e AS (SELECT vec_id, embedding AS v FROM embeddings), dn AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, vec_id) AS rank FROM (SELECT q.vec_id AS query, e.vec_id, round(sqrt(list_sum(list_transform(list_zip(q.v, e.v), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE)))), 6) AS distance FROM e q, e WHERE q.vec_id % 100 = 0))"


def nearest(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    e = v.load(spark, d, "embeddings")
    return rt.dense_top(e, e.filter("vec_id % 100 = 0"), "vec_id", "embedding", "vec_id", "embedding", k)


@R.add("t08_dense_top", f"WITH {_DENSE} SELECT query, vec_id, distance, CAST(rank AS INTEGER) AS rank FROM dn WHERE rank <= 10")
def t08_dense_top(spark, d):
    return nearest(spark, d).select("query", "vec_id", "distance", "rank")


_FUSED = _BM25 + f", {_DENSE}" + """,
    u AS (SELECT query, vec_id AS doc_id, 'dense' AS list, rank FROM dn WHERE rank <= 10 UNION ALL SELECT query, doc_id, 'lexical', rank FROM k WHERE rank <= 10 AND score > 0),
    f AS (SELECT query, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, coalesce(max(rank) FILTER (WHERE list = 'dense'), 0) AS dense_rank, coalesce(max(rank) FILTER (WHERE list = 'lexical'), 0) AS lexical_rank FROM u GROUP BY 1, 2),
    z AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, dense_rank = 0, dense_rank, lexical_rank = 0, lexical_rank, doc_id) AS place FROM f)"""


def fused(spark: SparkSession, d: str) -> DataFrame:
    dense = nearest(spark, d).withColumnRenamed("vec_id", "doc_id")
    return rt.fuse({"dense": dense, "lexical": searched(spark, d)}, ["doc_id"])


@R.add("a20_rrf", _FUSED + " SELECT query, doc_id, score, CAST(dense_rank AS INTEGER) AS dense_rank, CAST(lexical_rank AS INTEGER) AS lexical_rank, CAST(place AS INTEGER) AS place FROM z WHERE place <= 5")
def a20_rrf(spark, d):
    """Also J12, T09 and W01: ranks of two searches in one list."""
    return fused(spark, d).select("query", "doc_id", "score", "dense_rank", "lexical_rank", "place")


@R.add("j13_hits_with_text", _FUSED + " SELECT query, z.doc_id, text FROM z JOIN documents USING (doc_id) WHERE place <= 5")
def j13_hits_with_text(spark, d):
    """Hits with their whole text."""
    return fused(spark, d).join(v.load(spark, d, "documents").select("doc_id", "text"), "doc_id").select("query", "doc_id", "text")


@R.add("j20_rerank", _FUSED + """, h AS (SELECT query, doc_id, place FROM z WHERE place <= 5), sc AS (SELECT query, doc_id, length(text) AS ln FROM h JOIN documents USING (doc_id) WHERE doc_id % 3 <> 0)
    SELECT h.query, h.doc_id, CAST(row_number() OVER (PARTITION BY h.query ORDER BY sc.ln IS NULL, sc.ln DESC, h.place) AS INTEGER) AS new_place FROM h LEFT JOIN sc ON h.query = sc.query AND h.doc_id = sc.doc_id""")
def j20_rerank(spark, d):
    """Also U05: a second score orders the hits it knows, the others follow (a text's length stands in for a model)."""
    h = fused(spark, d).select("query", "doc_id", "place")
    s = h.join(v.load(spark, d, "documents").filter("doc_id % 3 <> 0").select(F.col("doc_id").alias("id"), F.length("text").alias("score")), F.col("doc_id") == F.col("id")).select("query", "doc_id", "score")
    return rt.rerank(h, s, ["query", "doc_id"], 5).select("query", "doc_id", "new_place")


@R.add("f12_context_text", _FUSED + " SELECT query, md5(string_agg('### ' || z.doc_id || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY place)) AS sum FROM z JOIN documents USING (doc_id) WHERE place <= 5 GROUP BY 1")
def f12_context_text(spark, d):
    """Contexts of whole texts."""
    t = v.load(spark, d, "documents").select(F.col("doc_id").alias("id"), tx.nz(F.col("text")).alias("content"))
    h = fused(spark, d).join(t, F.col("doc_id") == F.col("id")).withColumn("file_path", F.col("doc_id").cast("string"))
    return rt.context_text(h, ["query"]).select("query", F.md5("context").alias("sum"))


@R.add("m09_history", """
    WITH h AS (SELECT DISTINCT provider_pr_id AS pr_number, repository_id AS repo, id AS ord, title FROM pull_requests),
    l AS (SELECT pr_number, repo, max(ord) AS ord, arg_max(title, ord) AS title FROM h GROUP BY 1, 2) SELECT * FROM l ORDER BY ord DESC LIMIT 500""")
def m09_history(spark, d):
    """Also W03 and T11: upsert by key, then the newest 500."""
    p = v.prs(spark, d).select(F.col("provider_pr_id").alias("pr_number"), F.col("repository_id").alias("repo"), F.col("id").alias("ord"), "title")
    return rt.keep_history(p.filter("ord % 2 = 0"), p.filter("ord % 2 = 1"), 500)
