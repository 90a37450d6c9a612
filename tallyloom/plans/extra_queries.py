"""Clamps, labels, character chunks and line-wise symbols over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import clamps as cl
from tallyloom.operators.char_chunks import split_characters
from tallyloom.operators.code_symbols import code_symbols
from tallyloom.operators.python_symbols import parse_python
from tallyloom.plans import views as v
from tallyloom.plans.registry import Registry
from tallyloom.plans.views import with_views

R = Registry()


@R.add("p22_clamped", "SELECT DISTINCT id, CASE WHEN lower(trim(category)) IN ('security', 'style', 'performance') THEN lower(trim(category)) ELSE 'other' END AS kind FROM findings")
def p22_clamped(spark, d):
    """Also P23."""
    return v.load(spark, d, "findings").select("id", cl.clamped(F.col("category"), ("security", "style", "performance"), "other").alias("kind")).distinct()


@R.add("p34_nonzero", with_views("SELECT severity, count(*) FILTER (WHERE suppressed) AS n FROM finds GROUP BY 1 HAVING count(*) FILTER (WHERE suppressed) > 0", "finds"))
def p34_nonzero(spark, d):
    return v.finds(spark, d, "id", "severity", "suppressed").groupBy("severity").agg(F.count_if("suppressed").alias("n")).filter("n > 0")


@R.add("p38_constant_name", with_views("SELECT symbol_id, (name = upper(name) AND name <> lower(name) AND (contains(name, '_') OR length(name) > 2)) AS constant FROM syms", "syms"))
def p38_constant_name(spark, d):
    return v.syms(spark, d).select("symbol_id", cl.constant_name(F.col("name")).alias("constant"))


@R.add("f15_labels", with_views("SELECT id, CASE WHEN length(full_name) > 16 THEN substr(full_name, 1, 14) || '…' ELSE full_name END AS label, replace(full_name, '/', '%2F') AS url FROM repos", "repos"))
def f15_labels(spark, d):
    return v.repos(spark, d).select("id", cl.shortened(F.col("full_name")).alias("label"), cl.url_path(F.col("full_name")).alias("url"))


@R.add("f22_arrays", with_views("SELECT file_id, CAST(least(count(DISTINCT name), 5) AS INTEGER) AS n, array_to_string(list_sort(list(DISTINCT name))[1:5], ',') AS names FROM syms GROUP BY 1", "syms"))
def f22_arrays(spark, d):
    n = v.syms(spark, d).groupBy("file_id").agg(F.slice(F.array_sort(F.collect_set("name")), 1, 5).alias("a"))
    return n.select("file_id", F.size("a").alias("n"), F.array_join("a", ",").alias("names"))


@R.add("f24_json_or_words", r"""
    WITH t AS (SELECT event_id, props AS s FROM events),
    p AS (SELECT event_id, CASE WHEN starts_with(trim(s, ' '), '[') AND json_valid(s) THEN from_json(s, '["VARCHAR"]') ELSE list_filter(regexp_split_to_array(coalesce(s, ''), '\s+'), lambda x: length(x) > 0) END AS a FROM t)
    SELECT event_id, CAST(len(a) AS INTEGER) AS n, array_to_string(a, '|') AS parts FROM p""")
def f24_json_or_words(spark, d):
    """The properties of every event."""
    e = v.load(spark, d, "events").select("event_id", cl.json_or_words(F.col("props")).alias("a"))
    return e.select("event_id", F.size("a").alias("n"), F.array_join("a", "|").alias("parts"))


@R.add("f27_icons", with_views("SELECT id, CASE severity WHEN 'error' THEN 'E' WHEN 'warning' THEN 'W' ELSE 'N' END AS icon FROM finds", "finds"))
def f27_icons(spark, d):
    table = F.create_map(F.lit("error"), F.lit("E"), F.lit("warning"), F.lit("W"))
    return v.finds(spark, d, "id", "severity").select("id", F.coalesce(F.try_element_at(table, F.col("severity")), F.lit("N")).alias("icon"))


@R.add("f28_text_changed", with_views("SELECT DISTINCT file_id, trim(content) IS DISTINCT FROM trim(replace(content, 'shard', 'part')) AS changed FROM source_files"))
def f28_text_changed(spark, d):
    s = v.load(spark, d, "source_files")
    return s.select("file_id", cl.text_changed(F.col("content"), F.replace("content", F.lit("shard"), F.lit("part"))).alias("changed")).distinct()


_DIAGRAM = r"""regexp_replace(regexp_replace(regexp_replace({0}, '(?m)^[ \t]*```\w*[ \t]*$', '', 'g'), '^\s+|\s+$', '', 'g'), '\[([^\["(/\]][^\[\]"]*)\]', '["\1"]', 'g')"""


@R.add("f08_diagram", f"""
    WITH t AS (SELECT 'stage' AS source, id, raw_output AS t FROM (SELECT DISTINCT id, raw_output FROM stage_results) UNION ALL SELECT 'document', doc_id, text FROM documents),
    c AS (SELECT source, id, {_DIAGRAM.format('t')} AS d FROM t)
    SELECT source, id, CASE WHEN regexp_matches(d, '^(?:{'|'.join(cl.DIAGRAMS)})\\b') THEN d END AS d FROM c""")
def f08_diagram(spark, d):
    """Diagrams in every model output and document."""
    s = v.load(spark, d, "stage_results").select(F.lit("stage").alias("source"), "id", F.col("raw_output").alias("t")).distinct()
    t = s.unionByName(v.load(spark, d, "documents").select(F.lit("document").alias("source"), F.col("doc_id").alias("id"), F.col("text").alias("t")))
    return t.select("source", "id", cl.diagram(F.col("t")).alias("d"))


@R.add("f02_prompt", with_views("SELECT id, 'Review ' || coalesce(title, '') || ' by ' || coalesce(author, '') || '.' AS prompt FROM prs", "prs"))
def f02_prompt(spark, d):
    return cl.prompt_text(v.prs(spark, d), "Review {t} by {a}.", t=F.col("title"), a=F.col("author")).select("id", "prompt")


@R.add("w10_character_chunks")
def w10_character_chunks(spark, d):
    return split_characters(v.load(spark, d, "documents"), "doc_id", "text")


@R.add("g01_python_symbols")
def g01_python_symbols(spark, d):
    s = v.load(spark, d, "source_files").filter(F.lower("file_path").endswith(".py")).select("file_path", "content").distinct()
    return parse_python(s, "symbols")


@R.add("g02_python_edges")
def g02_python_edges(spark, d):
    s = v.load(spark, d, "source_files").filter(F.lower("file_path").endswith(".py")).select("file_path", "content").distinct()
    return parse_python(s, "edges")


@R.add("x09_python_chunks")
def x09_python_chunks(spark, d):
    s = v.load(spark, d, "source_files").filter(F.lower("file_path").endswith(".py")).select("file_path", "content").distinct()
    return parse_python(s, "chunks")


@R.add("g03_code_symbols")
def g03_code_symbols(spark, d):
    """Functions, methods, classes and imports of the languages other than Python."""
    return code_symbols(v.load(spark, d, "source_files").select("file_path", "content").distinct())


@R.add("g03_code_edges")
def g03_code_edges(spark, d):
    """Imports, calls and bases of the languages other than Python."""
    return code_symbols(v.load(spark, d, "source_files").select("file_path", "content").distinct(), "edges")
