"""The finding pipeline over the supplied tables, and over literal tool output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import text as tx
from tallyloom.operators import findings as fi
from tallyloom.operators import relational as rel
from tallyloom.operators.chunks import diff_counts
from tallyloom.operators.clamps import RISK_WORDS, risk_areas
from tallyloom.operators.model_calls import FORBIDDEN, script_problem
from tallyloom.plans import views as v
from tallyloom.plans.registry import Registry
from tallyloom.plans.views import with_views
from tallyloom.sources.files import SKIP_EXTENSIONS, reviewable

R = Registry()


def _then(sql: str) -> str:
    """Join a CTE list that starts with a comma to the views before it."""
    return sql.replace(")\n\n    , ", "),\n    ").replace(")\n, ", "),\n")


@R.add("p19_confident", "SELECT DISTINCT id FROM findings WHERE coalesce(confidence, 0.5) >= 0.6 AND NOT coalesce(is_suppressed, false)")
def p19_confident(spark: SparkSession, d: str) -> DataFrame:
    """Findings that weren't marked invalid (here: suppressed) and are confident enough."""
    f = v.finds(spark, d, "id", "confidence", "suppressed")
    return fi.confident(f.withColumn("is_valid", ~F.col("suppressed"))).select("id")


@R.add("p20_postable", with_views("SELECT id FROM finds WHERE severity IN ('error', 'warning') AND file_path IS NOT NULL AND coalesce(line_start, 0) <> 0", "finds"))
def p20_postable(spark, d):
    return fi.postable(v.finds(spark, d, "id", "file_path", "line_start", "severity")).select("id")


@R.add("p21_normalised", with_views("SELECT severity, category, count(*) AS n FROM finds GROUP BY ALL", "finds"))
def p21_normalised(spark, d):
    return v.finds(spark, d, "severity", "category").groupBy("severity", "category").agg(F.count("*").alias("n"))


_PREFIX = "CASE " + " ".join(f"WHEN starts_with(rule_id, '{p}') THEN '{s}'" for p, s in fi.RULE_PREFIXES) + " ELSE 'note' END"


@R.add("p28_rule_severity", with_views(f"SELECT id, {_PREFIX} AS rule_severity FROM finds WHERE rule_id <> ''", "finds"))
def p28_rule_severity(spark, d):
    return v.finds(spark, d, "id", "rule_id").filter("rule_id <> ''").select("id", fi.by_prefix(F.col("rule_id")).alias("rule_severity"))


@R.add("p29_tool_severity", """
    WITH m(tool, word, s) AS (VALUES ('bandit', 'high', 'error'), ('bandit', 'medium', 'warning'), ('bandit', 'low', 'note'), ('bandit', 'undefined', 'note'),
      ('semgrep', 'error', 'error'), ('semgrep', 'warning', 'warning'), ('semgrep', 'info', 'note'), ('semgrep', 'inventory', 'note'), ('semgrep', 'experiment', 'note'),
      ('trivy', 'critical', 'error'), ('trivy', 'high', 'error'), ('trivy', 'medium', 'warning'), ('trivy', 'low', 'note'), ('trivy', 'unknown', 'note'), ('mypy', 'error', 'error'), ('mypy', 'warning', 'warning'), ('mypy', 'note', 'note')),
    r AS (SELECT DISTINCT id, tool_source, severity FROM findings)
    SELECT r.id, r.tool_source AS tool, coalesce(m.s, 'warning') AS severity FROM r LEFT JOIN m ON lower(r.tool_source) = m.tool AND lower(trim(r.severity, ' ')) = m.word""")
def p29_tool_severity(spark, d):
    """Tool and word of every finding."""
    f = v.load(spark, d, "findings").select("id", "tool_source", "severity").distinct()
    return f.select("id", F.col("tool_source").alias("tool"), fi.tool_severity(F.col("tool_source"), F.col("severity")).alias("severity"))


@R.add("p10_reviewable", rf"SELECT DISTINCT file_id FROM source_files WHERE content IS NOT NULL AND lower(regexp_extract(regexp_extract(file_path, '([^/]*)$', 1), '^\.*[^.].*?(\.[^.]*)$', 1)) NOT IN {SKIP_EXTENSIONS}")
def p10_reviewable(spark, d):
    """Files with content that a review reads, by extension."""
    f = v.load(spark, d, "source_files").filter("content is not null")
    return f.filter(reviewable(F.col("file_path"))).select("file_id").distinct()


@R.add("p11_patch_files", rf"""
    WITH p AS (SELECT doc_id, file_path, regexp_split_to_array(text, '\r?\n') AS ls FROM documents WHERE kind = 'diff' AND text IS NOT NULL AND file_path IS NOT NULL)
    SELECT doc_id, CASE WHEN list_contains(ls, '--- /dev/null') THEN 'added' WHEN len(list_filter(ls, lambda x: starts_with(x, 'rename to '))) > 0 THEN 'renamed' ELSE 'modified' END AS status,
      CAST(len(list_filter(ls, lambda x: starts_with(x, '+') AND NOT starts_with(x, '+++'))) AS INTEGER) AS additions, CAST(len(list_filter(ls, lambda x: starts_with(x, '-') AND NOT starts_with(x, '---'))) AS INTEGER) AS deletions
    FROM p WHERE NOT list_contains(ls, '+++ /dev/null') AND lower(regexp_extract(regexp_extract(file_path, '([^/]*)$', 1), '^\.*[^.].*?(\.[^.]*)$', 1)) NOT IN {SKIP_EXTENSIONS}""")
def p11_patch_files(spark, d):
    """Changed files that aren't deleted and are reviewable, with status and counts of lines."""
    t = v.load(spark, d, "documents").filter("kind = 'diff' and text is not null and file_path is not null").withColumn("ls", F.split("text", r"\r?\n"))
    status = F.when(F.array_contains("ls", "--- /dev/null"), "added").when(F.exists("ls", lambda x: x.startswith("rename to ")), "renamed").otherwise("modified")
    plus, minus = diff_counts(F.col("text"))
    kept = t.filter(reviewable(F.col("file_path")) & ~F.array_contains("ls", "+++ /dev/null"))
    return kept.select("doc_id", status.alias("status"), plus.alias("additions"), minus.alias("deletions"))


@R.add("p32_script_problems", "WITH t AS (SELECT DISTINCT file_id, content AS s FROM source_files WHERE length(content) > 0) SELECT file_id, CASE " + " ".join("WHEN regexp_matches(s, '(?i)" + p.replace("'", "''") + "') THEN '" + r + "'" for p, r in FORBIDDEN) + r" WHEN len(regexp_split_to_array(regexp_replace(s, '(?:\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}])$', ''), '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]')) > 200 THEN 'longer than 200 lines' END AS problem FROM t")
def p32_script_problems(spark, d):
    """The first reason for which a text may not be run as a script, over all source files."""
    s = v.load(spark, d, "source_files").filter("length(content) > 0").select("file_id", "content").distinct()
    return s.select("file_id", script_problem(F.col("content")).alias("problem"))


@R.add("p12_glob_skip", "SELECT DISTINCT file_id FROM source_files WHERE NOT (file_path GLOB '*.go' OR starts_with(file_path, 'lib/') OR file_path GLOB 'app/*/a*.py')")
def p12_glob_skip(spark, d):
    from tallyloom.sources.files import skip_by_globs

    return skip_by_globs(v.load(spark, d, "source_files"), "file_path", ["*.go", "lib/", "app/*/a*.py"]).select("file_id").distinct()


@R.add("p13_skip_components", "SELECT DISTINCT file_id FROM source_files WHERE NOT list_has_any(string_split(file_path, '/'), ['cli', 'webui', 'node_modules']) AND size_bytes <= 3000")
def p13_skip_components(spark, d):
    from tallyloom.sources.files import skip_by_parts

    f = skip_by_parts(v.load(spark, d, "source_files"), "file_path", ["cli", "webui", "node_modules"])
    return f.filter("size_bytes <= 3000").select("file_id").distinct()


@R.add("p26_language", r"""SELECT DISTINCT file_id, CASE lower(regexp_extract(regexp_extract(file_path, '([^/]*)$', 1), '^\.*[^.].*?(\.[^.]*)$', 1)) WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.ts' THEN 'typescript' WHEN '.go' THEN 'go' WHEN '.java' THEN 'java' ELSE 'unknown' END AS language FROM source_files""")
def p26_language(spark, d):
    from tallyloom.sources.files import language

    return v.load(spark, d, "source_files").select("file_id", language(F.col("file_path")).alias("language")).distinct()


@R.add("p35_risk_areas", "SELECT doc_id, " + " || ".join(f"CASE WHEN {' OR '.join(f'contains(lower(text), {w!r})' for w in ws)} THEN '{a},' ELSE '' END" for a, ws in RISK_WORDS.items()) + " AS areas FROM documents WHERE kind = 'diff' AND text IS NOT NULL")
def p35_risk_areas(spark, d):
    """The areas whose words stand in a diff."""
    t = v.load(spark, d, "documents").filter("kind = 'diff' and text is not null")
    return t.select("doc_id", F.array_join(F.transform(risk_areas(F.col("text")), lambda x: F.concat(x, F.lit(","))), "").alias("areas"))


@R.add("p37_exported", with_views("SELECT symbol_id, NOT starts_with(name, '_') AS exported FROM syms", "syms"))
def p37_exported(spark, d):
    return v.syms(spark, d).select("symbol_id", (~F.col("name").startswith("_")).alias("exported"))


@R.add("a10_severities_per_review", with_views("SELECT review_id, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings, count(*) FILTER (WHERE severity = 'note') AS notes, count(*) AS total FROM finds GROUP BY 1", "finds"))
def a10_severities_per_review(spark, d):
    return rel.severity_counts(v.finds(spark, d, "review_id", "severity"), ["review_id"])


@R.add("a11_penalty", with_views("SELECT review_id, greatest(0.0, round_even(10 - least(2.0 * e + 0.5 * w + 0.1 * n, 10), 1)) AS score FROM (SELECT review_id, count(*) FILTER (WHERE severity = 'error') AS e, count(*) FILTER (WHERE severity = 'warning') AS w, count(*) FILTER (WHERE severity = 'note') AS n FROM finds GROUP BY 1)", "finds").replace("2.0 * e + 0.5 * w + 0.1 * n", "CAST(2 AS DOUBLE) * e + CAST(0.5 AS DOUBLE) * w + CAST(0.1 AS DOUBLE) * n").replace("greatest(0.0,", "greatest(CAST(0 AS DOUBLE),"))
def a11_penalty(spark, d):
    """A weighted, clamped score per review from its severity counts."""
    c = rel.severity_counts(v.finds(spark, d, "review_id", "severity"), ["review_id"])
    loss = F.lit(2.0) * F.col("errors") + F.lit(0.5) * F.col("warnings") + F.lit(0.1) * F.col("notes")
    return c.select("review_id", F.greatest(F.lit(0.0), F.bround(10 - F.least(loss, F.lit(10.0)), 1)).alias("score"))


@R.add("a12_findings_by_file", with_views("SELECT file_path, count(*) AS n, count(DISTINCT severity) AS n_severities FROM finds WHERE file_path IS NOT NULL GROUP BY 1", "finds"))
def a12_findings_by_file(spark, d):
    """Groups by file as counts; the rows themselves stay distributed (a file may hold a third of them)."""
    return v.finds(spark, d, "file_path", "severity").filter("file_path is not null").groupBy("file_path").agg(F.count("*").alias("n"), F.count_distinct("severity").alias("n_severities"))


@R.add("a13_tool_lines", with_views("SELECT tool_source AS tool, tool_source || ': ' || count(*) || ' findings (' || count(*) FILTER (WHERE severity = 'error') || ' errors)' AS line FROM finds GROUP BY 1", "finds"))
def a13_tool_lines(spark, d):
    return fi.tool_lines(v.finds(spark, d, "severity", "tool_source"))


@R.add("a15_totals", """
    WITH s AS (SELECT DISTINCT * FROM stage_results)
    SELECT review_id, sum(tokens_input)::BIGINT AS tokens_in, sum(tokens_output)::BIGINT AS tokens_out, round(coalesce(sum(cost_estimate) FILTER (WHERE success), 0), 6) AS cost,
           round(sum(latency_seconds), 6) AS seconds, arg_max(model, id) FILTER (WHERE model <> '') AS last_model FROM s GROUP BY 1""")
def a15_totals(spark, d):
    """Also A17."""
    from tallyloom.tables import latest_by_id

    s = latest_by_id(v.load(spark, d, "stage_results").drop("prompt", "raw_output", "error"), "id", "created_at")
    return fi.totals(s, ["review_id"], F.col("id"))


@R.add("a17_stage_totals", "WITH s AS (SELECT DISTINCT * FROM stage_results) SELECT lower(stage_name) AS stage, count(*) AS n, count(*) FILTER (WHERE success) AS n_ok, sum(tokens_input)::BIGINT AS tokens_in FROM s GROUP BY 1")
def a17_stage_totals(spark, d):
    from tallyloom.tables import latest_by_id

    s = latest_by_id(v.load(spark, d, "stage_results").select("id", "stage_name", "success", "tokens_input", "created_at"), "id", "created_at")
    return s.groupBy(F.lower("stage_name").alias("stage")).agg(F.count("*").alias("n"), F.count_if("success").alias("n_ok"), F.sum("tokens_input").alias("tokens_in"))


@R.add("a23_severity_line", with_views("SELECT review_id, string_agg(initcap_s || ': ' || n, ', ' ORDER BY severity) AS line FROM (SELECT review_id, severity, upper(severity[1]) || severity[2:] AS initcap_s, count(*) AS n FROM finds GROUP BY ALL) GROUP BY 1", "finds"))
def a23_severity_line(spark, d):
    n = v.finds(spark, d, "review_id", "severity").groupBy("review_id", "severity").agg(F.count("*").alias("n"))
    return fi.ordered_text(n, ["review_id"], [F.col("severity")], F.concat(F.initcap("severity"), F.lit(": "), F.col("n").cast("string")), ", ", "line")


@R.add("a24_summary_text", with_views("SELECT review_id, string_agg('- ' || file_path || ':' || line_start, chr(10) ORDER BY file_path, line_start, id) AS text FROM finds WHERE severity = 'error' AND file_path IS NOT NULL GROUP BY 1", "finds"))
def a24_summary_text(spark, d):
    f = v.finds(spark, d, "id", "review_id", "file_path", "line_start", "severity").filter("severity = 'error' and file_path is not null")
    return fi.ordered_text(f, ["review_id"], [F.col("file_path"), F.col("line_start"), F.col("id")], F.format_string("- %s:%d", "file_path", "line_start"))


@R.add("a14_flattened_tools", with_views("SELECT id, 'tool' AS kind FROM finds WHERE tool_source <> 'llm' UNION ALL SELECT id, 'model' AS kind FROM finds WHERE tool_source = 'llm'", "finds"))
def a14_flattened_tools(spark, d):
    """Also U01 and U02: findings of several sources in one table."""
    f = v.finds(spark, d, "id", "tool_source")
    tools = f.filter("tool_source <> 'llm'").select("id", F.lit("tool").alias("kind"))
    return tools.unionByName(f.filter("tool_source = 'llm'").select("id", F.lit("model").alias("kind")))


@R.add("a29_stage_success", "WITH s AS (SELECT DISTINCT * FROM stage_results) SELECT id, (coalesce(error, '') = '' OR length(trim(raw_output)) > 0) IS TRUE AS ok FROM s")
def a29_stage_success(spark, d):
    from tallyloom.tables import latest_by_id

    s = latest_by_id(v.load(spark, d, "stage_results").select("id", "error", "raw_output", "created_at"), "id", "created_at")
    return s.select("id", F.coalesce((tx.nz(F.col("error")) == "") | (F.length(F.trim("raw_output")) > 0), F.lit(False)).alias("ok"))


_W = r"list_distinct(list_filter(regexp_split_to_array(lower({}), '\s+'), lambda x: len(x) > 0))"


@R.add("u04_word_overlap", _then(with_views(rf"""
    , n AS (SELECT id, message, lead(message) OVER (PARTITION BY review_id ORDER BY id) AS other FROM finds)
    SELECT id, CASE WHEN len({_W.format('message')}) > 0 AND len({_W.format('other')}) > 0 THEN round(len(list_intersect({_W.format('message')}, {_W.format('other')})) / len(list_distinct(list_concat({_W.format('message')}, {_W.format('other')}))), 6) ELSE 0 END AS overlap
    FROM n WHERE other IS NOT NULL""", "finds")))
def u04_word_overlap(spark, d):
    """Each message against the next of its review; neighbours by rank, so a large review is no one task."""
    from tallyloom.operators.ranking import previous

    f = v.finds(spark, d, "id", "review_id", "message").select("review_id", "id", "message")
    n = previous(f.withColumn("neg", -F.col("id")), ["review_id"], ["neg"], ["message"], "next_").filter("next_message is not null")
    return n.select("id", F.round(fi.word_overlap(F.col("message"), F.col("next_message")), 6).alias("overlap"))


@R.add("w05_greedy_dedup")
def w05_greedy_dedup(spark, d):
    """Findings kept by the greedy rule; order-dependent, so it is tested against a plain loop."""
    return fi.greedy_dedup(v.finds(spark, d, "id", "file_path", "line_start", "message", "confidence")).select("id")


@R.add("j15_override", _then(with_views("""
    , c AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'error' WHEN id % 3 = 1 THEN '' END AS severity FROM finds WHERE id % 2 = 0)
    SELECT f.id, coalesce(nullif(c.severity, ''), f.severity) AS severity FROM finds f LEFT JOIN c USING (id)""", "finds")))
def j15_override(spark, d):
    f = v.finds(spark, d, "id", "severity")
    c = f.filter("id % 2 = 0").select("id", F.when(F.col("id") % 3 == 0, "error").when(F.col("id") % 3 == 1, "").alias("severity"))
    return fi.override(f, c, ["severity"]).select("id", "severity")


@R.add("j16_by_suffix", _then(with_views("""
    , names AS (SELECT DISTINCT regexp_extract(file_path, '([^/]*/[^/]*)$', 1) AS name FROM finds WHERE file_path IS NOT NULL),
    tails AS (SELECT id, unnest(list_transform(generate_series(1, len(string_split(file_path, '/'))), lambda k: array_to_string(string_split(file_path, '/')[k:], '/'))) AS tail FROM finds WHERE file_path IS NOT NULL)
    SELECT t.id, n.name FROM tails t JOIN names n ON t.tail = n.name""", "finds")))
def j16_by_suffix(spark, d):
    """Every finding against the changed-file names of all findings."""
    f = v.finds(spark, d, "id", "file_path")
    names = f.filter("file_path is not null").select(F.regexp_extract("file_path", "([^/]*/[^/]*)$", 1).alias("name")).distinct()
    return fi.by_suffix(f, names).select("id", "name")


@R.add("j17_unposted", _then(with_views("""
    , old AS (SELECT file_path AS path, line_start AS line, message AS body FROM finds WHERE id % 2 = 0)
    SELECT f.id FROM finds f WHERE id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM old o WHERE o.path = f.file_path AND o.line = f.line_start AND contains(o.body, substr(f.message, 1, 50)))""", "finds")))
def j17_unposted(spark, d):
    f = v.finds(spark, d, "id", "file_path", "line_start", "message").select("id", F.col("file_path").alias("path"), F.col("line_start").alias("line"), F.col("message").alias("body"))
    return fi.unposted(f.filter("id % 2 = 1"), f.filter("id % 2 = 0")).select("id")


@R.add("j18_semi", with_views("SELECT id FROM finds WHERE file_path IN (SELECT file_path FROM finds WHERE severity = 'error')", "finds"))
def j18_semi(spark, d):
    f = v.finds(spark, d, "id", "file_path", "severity")
    bad = f.filter("severity = 'error'").select(F.col("file_path").alias("p")).distinct()
    return f.join(bad, F.col("file_path") == F.col("p"), "left_semi").select("id")


@R.add("j21_findings_per_thread", with_views("SELECT t.id, count(f.id) AS n FROM threads t LEFT JOIN finds f ON f.review_id = t.review_id AND f.file_path = t.file_path GROUP BY 1", "threads", "finds"))
def j21_findings_per_thread(spark, d):
    n = v.finds(spark, d, "id", "review_id", "file_path").groupBy(F.col("review_id").alias("r"), F.col("file_path").alias("p")).agg(F.count("*").alias("c"))
    t = v.threads(spark, d)
    return t.join(n, (F.col("review_id") == F.col("r")) & (F.col("file_path") == F.col("p")), "left").groupBy("id").agg(F.sum(F.coalesce("c", F.lit(0))).alias("n"))


@R.add("j23_zip", _then(with_views("""
    , a AS (SELECT review_id, id, row_number() OVER (PARTITION BY review_id ORDER BY id) AS k FROM finds WHERE severity = 'error'),
    b AS (SELECT review_id, id, row_number() OVER (PARTITION BY review_id ORDER BY id) AS k FROM finds WHERE severity = 'note')
    SELECT a.id AS error_id, b.id AS note_id FROM a JOIN b USING (review_id, k)""", "finds")))
def j23_zip(spark, d):
    f = v.finds(spark, d, "id", "review_id", "severity").select("review_id", "id", "severity")
    a, b = (f.filter(F.col("severity") == s).select("review_id", F.col("id").alias("n"), F.col("id").alias(name)) for s, name in (("error", "error_id"), ("note", "note_id")))
    return fi.zipped(a, b, ["review_id"], ["n"]).select("error_id", "note_id")


@R.add("f03_truncate", with_views("SELECT id, CASE WHEN length(message) > 50 THEN substr(message, 1, 50) || '...' ELSE message END AS short, CASE WHEN length(message) > 80 THEN substr(message, 1, 80) || chr(10) || '... [' || (length(message) - 80) || ' chars truncated]' ELSE message END AS counted FROM finds", "finds"))
def f03_truncate(spark, d):
    m = F.col("message")
    return v.finds(spark, d, "id", "message").select("id", tx.truncate(m, 50, "...").alias("short"), tx.truncate_counted(m, 80).alias("counted"))


@R.add("f04_module", r"SELECT DISTINCT file_id, replace(regexp_replace(regexp_replace(replace(file_path, '\', '/'), '^[./]+', ''), '\.[^./]*$', ''), '/', '.') AS module FROM source_files")
def f04_module(spark, d):
    return v.load(spark, d, "source_files").select("file_id", tx.module_name(F.col("file_path")).alias("module")).distinct()


@R.add("f05_extension", r"SELECT lower(regexp_extract(regexp_extract(file_path, '([^/]*)$', 1), '^\.*[^.].*?(\.[^.]*)$', 1)) AS ext, count(*) AS n FROM source_files GROUP BY 1")
def f05_extension(spark, d):
    return v.load(spark, d, "source_files").groupBy(tx.ext(F.col("file_path")).alias("ext")).agg(F.count("*").alias("n"))


@R.add("f06_json_slice", r"""
    WITH s AS (SELECT DISTINCT id, raw_output FROM stage_results), x AS (SELECT id, nullif(regexp_extract(regexp_replace(raw_output, '^```\w*\s*$', '', 'gm'), '(\{.*\})', 1, 's'), '') AS j FROM s)
    SELECT id, CAST(json_array_length(j, '$.comments') AS INTEGER) AS n_comments FROM x WHERE j IS NOT NULL AND json_valid(j) AND json_array_length(j, '$.comments') > 0""")
def f06_json_slice(spark, d):
    """JSON taken out of model output: fences dropped, the outermost braces parsed, broken ones left out."""
    s = v.load(spark, d, "stage_results").select("id", "raw_output").distinct()
    j = s.select("id", F.try_parse_json(tx.json_slice(F.col("raw_output"))).alias("j"))
    arr = F.try_variant_get("j", "$.comments", "array<variant>")
    return j.select("id", F.size(arr).alias("n_comments")).filter("n_comments > 0")


@R.add("f07_comment_form", with_views("SELECT id, '**[' || upper(category) || ']** ' || message AS comment FROM finds WHERE line_start IS NOT NULL", "finds"))
def f07_comment_form(spark, d):
    return v.finds(spark, d, "id", "line_start", "category", "message").filter("line_start is not null").select("id", F.concat(F.lit("**["), F.upper("category"), F.lit("]** "), "message").alias("comment"))


@R.add("f09_fence_body", r"""SELECT DISTINCT id, trim(CASE WHEN regexp_matches(raw_output, '```[\w+-]*[ \t]*\r?\n(?s:.*?)```') AND regexp_extract(raw_output, '(?s)```[\w+-]*[ \t]*\r?\n(.*?)```', 1) <> '' THEN regexp_extract(raw_output, '(?s)```[\w+-]*[ \t]*\r?\n(.*?)```', 1) ELSE raw_output END, ' ') AS body FROM stage_results""")
def f09_fence_body(spark, d):
    return v.load(spark, d, "stage_results").select("id", tx.fence_body(F.col("raw_output")).alias("body")).distinct()


@R.add("f11_embedding_text", with_views("SELECT review_id, string_agg(severity || ': ' || substr(message, 1, 150), chr(10) ORDER BY id) AS text FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY id) AS k FROM finds) WHERE k <= 10 GROUP BY 1", "finds"))
def f11_embedding_text(spark, d):
    """First ten findings of each review as one text (also T12)."""
    f = rel.newest(v.finds(spark, d, "id", "review_id", "severity", "message").select("review_id", "id", "severity", "message"), ["review_id"], 10, F.asc("id"))
    return fi.ordered_text(f, ["review_id"], [F.col("id")], F.concat("severity", F.lit(": "), F.substring("message", 1, 150)))


@R.add("f25_hashes", with_views("SELECT id, sha256(coalesce(file_path, '') || '|' || coalesce(message, '')) AS sha, md5(coalesce(message, '')) AS md FROM finds", "finds"))
def f25_hashes(spark, d):
    m = tx.nz(F.col("message"))
    return v.finds(spark, d, "id", "file_path", "message").select("id", F.sha2(F.concat(tx.nz(F.col("file_path")), F.lit("|"), m), 256).alias("sha"), F.md5(m).alias("md"))


@R.add("f26_aliases", "WITH r AS (SELECT DISTINCT id, file_path, line_start, message FROM findings) SELECT id, coalesce(file_path, 'none') AS file, coalesce(line_start, 0) AS line, coalesce(message, '') AS comment, 'llm' AS tool FROM r")
def f26_aliases(spark, d):
    raw = v.load(spark, d, "findings").select("id", "file_path", "line_start", "message").distinct()
    return fi.aliased(raw, {"id": (["id"], None), "file": (["file", "file_path"], "none"), "line": (["line", "line_start"], 0), "comment": (["comment", "message"], ""), "tool": (["tool"], "llm")})


@R.add("s11_budgeted_text", with_views("SELECT review_id, substr(string_agg(substr(message, 1, CAST(floor(1500 / n) AS INTEGER)), chr(10) ORDER BY id), 1, 1500) AS text FROM (SELECT *, count(*) OVER (PARTITION BY review_id) AS n FROM finds) GROUP BY 1", "finds"))
def s11_budgeted_text(spark, d):
    """Parts of each review cut to an equal share of a budget, then joined and cut once more."""
    f = v.finds(spark, d, "id", "review_id", "message").select("review_id", "id", "message")
    n = f.groupBy(F.col("review_id").alias("r")).agg(F.count("*").alias("n"))
    part = f.join(n, F.col("review_id").eqNullSafe(F.col("r"))).withColumn("part", F.expr("substring(message, 1, cast(floor(1500 / n) as int))"))
    t = fi.ordered_text(part, ["review_id"], [F.col("id")], F.col("part"))
    return t.withColumn("text", F.substring("text", 1, 1500))
