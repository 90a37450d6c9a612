"""Code graph, mutations and events over the supplied tables.

The tables hold symbols but no resolved calls, so the edges here are made from the symbols by a
rule that both engines can state: symbol s calls the one with id s * 7919 mod the largest id + 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import events as ev
from tallyloom.operators import graph as gr
from tallyloom.operators import mutations as mu
from tallyloom.plans import views as v
from tallyloom.plans.registry import Registry
from tallyloom.plans.views import SQL, with_views

R = Registry()

_G = f"""
    WITH RECURSIVE syms AS ({SQL['syms']}),
    g AS (SELECT qualified_name, max(symbol_id) AS symbol_id, arg_max(file_path, symbol_id) AS file_path, arg_max(line_start, symbol_id) AS line_start, arg_max(is_exported, symbol_id) AS is_exported FROM syms GROUP BY 1),
    e AS (SELECT DISTINCT a.qualified_name AS source, b.qualified_name AS target, CASE a.symbol_id % 3 WHEN 0 THEN 'import' ELSE 'call' END AS kind, a.file_path, a.line_start AS line
          FROM syms a JOIN g b ON b.symbol_id = (a.symbol_id * 7919) % (SELECT max(symbol_id) FROM g) + 1 WHERE a.symbol_id % 5 <> 0
          UNION SELECT b.qualified_name, a.qualified_name, 'call', b.file_path, b.line_start FROM g a JOIN g b ON b.symbol_id = a.symbol_id + 7 WHERE a.symbol_id % 4 = 0)"""


def symbols(spark: SparkSession, d: str) -> DataFrame:
    return gr.assemble(v.syms(spark, d).select("symbol_id", "qualified_name", "file_path", "line_start", "is_exported"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    s = v.syms(spark, d)
    g = symbols(spark, d)
    top = g.agg(F.max("symbol_id").alias("top"))  # one row
    b = g.select(F.col("symbol_id").alias("bid"), F.col("qualified_name").alias("bq"), F.col("file_path").alias("bf"), F.col("line_start").alias("bl"))
    a = s.filter("symbol_id % 5 <> 0").join(F.broadcast(top)).withColumn("to", (F.col("symbol_id") * 7919) % F.col("top") + 1)
    first = a.join(b, F.col("to") == F.col("bid")).select(F.col("qualified_name").alias("source"), F.col("bq").alias("target"), F.when(F.col("symbol_id") % 3 == 0, "import").otherwise("call").alias("kind"), "file_path", F.col("line_start").alias("line"))
    more = g.filter("symbol_id % 4 = 0").join(b, F.col("symbol_id") + 7 == F.col("bid")).select(F.col("bq").alias("source"), F.col("qualified_name").alias("target"), F.lit("call").alias("kind"), F.col("bf").alias("file_path"), F.col("bl").alias("line"))
    return first.unionByName(more).distinct()


def changed(spark: SparkSession, d: str) -> DataFrame:
    """The changed symbols of a report: ids divisible by 100."""
    return symbols(spark, d).filter("symbol_id % 100 = 0")


@R.add("g04_assembled", _G + " SELECT qualified_name, symbol_id, file_path FROM g")
def g04_assembled(spark, d):
    return symbols(spark, d).select("qualified_name", "symbol_id", "file_path")


@R.add("j07_callers", _G + " SELECT target AS name, source AS caller, line FROM e JOIN g ON e.source = g.qualified_name")
def j07_callers(spark, d):
    return gr.callers(edges(spark, d), symbols(spark, d))


@R.add("j08_callees", _G + " SELECT source AS name, target AS callee, line FROM e JOIN g ON e.target = g.qualified_name")
def j08_callees(spark, d):
    return gr.callees(edges(spark, d), symbols(spark, d))


@R.add("j09_dependants", _G + " SELECT DISTINCT g.file_path, e.file_path AS used_by FROM e JOIN g ON e.target = g.qualified_name WHERE e.file_path <> g.file_path")
def j09_dependants(spark, d):
    return gr.dependants(edges(spark, d), symbols(spark, d))


@R.add("j10_symbols_of_file", with_views("SELECT file_id, count(*) AS n, string_agg(name, ',' ORDER BY line_start, symbol_id) AS names FROM syms GROUP BY 1", "syms"))
def j10_symbols_of_file(spark, d):
    s = v.syms(spark, d)
    rows = F.array_sort(F.collect_list(F.struct("line_start", "symbol_id", "name")))
    return s.groupBy("file_id").agg(F.count("*").alias("n"), F.array_join(F.transform(rows, lambda r: r["name"]), ",").alias("names"))


_REACH = _G + """, w AS (SELECT qualified_name AS root, qualified_name AS name, 0 AS depth FROM g WHERE symbol_id % 100 = 0
    UNION SELECT w.root, e.source, depth + 1 FROM w JOIN e ON e.target = w.name WHERE depth < 3),
    m AS (SELECT root, name, min(depth) AS depth FROM w WHERE name <> root GROUP BY 1, 2)"""


@R.add("g06_reach", _REACH + " SELECT root, name, CAST(depth AS INTEGER) AS depth FROM m")
def g06_reach(spark, d):
    """Also J11: callers within three steps."""
    return gr.reach(edges(spark, d), changed(spark, d).select(F.col("qualified_name").alias("name")), 3)


_IMPACT = _REACH + """,
    dc AS (SELECT e.target AS name, e.source AS caller FROM e JOIN g s ON s.qualified_name = e.source JOIN g t ON t.qualified_name = e.target WHERE t.symbol_id % 100 = 0),
    d1 AS (SELECT name, count(*) AS n_edges, count(DISTINCT caller) AS n_direct FROM dc GROUP BY 1),
    al AS (SELECT name, caller FROM dc UNION SELECT root, name FROM m),
    d2 AS (SELECT al.name, count(*) AS n_all, list_sort(list(DISTINCT g.file_path)) AS files FROM al JOIN g ON g.qualified_name = al.caller GROUP BY 1),
    i AS (SELECT g.qualified_name AS name, coalesce(n_edges, 0) AS n_edges, coalesce(n_direct, 0) AS n_direct, coalesce(n_all, 0) AS n_all, array_to_string(coalesce(files, []), ',') AS files,
        CASE WHEN coalesce(n_all, 0) >= 21 THEN 'CRITICAL' WHEN n_all >= 6 THEN 'HIGH' WHEN n_all >= 1 THEN 'MEDIUM' ELSE 'LOW' END AS level, is_exported AND coalesce(n_direct, 0) > 0 AS breaking
      FROM g LEFT JOIN d1 ON d1.name = g.qualified_name LEFT JOIN d2 ON d2.name = g.qualified_name WHERE g.symbol_id % 100 = 0)"""


@R.add("g07_impact", _IMPACT + " SELECT * FROM i")
def g07_impact(spark, d):
    """Also A19, A28, U03 and F20."""
    return gr.impact(edges(spark, d), symbols(spark, d), changed(spark, d)).withColumn("files", F.array_join("files", ","))


@R.add("g08_report", _IMPACT + " SELECT count(*) AS n_changed, count(*) FILTER (WHERE breaking) AS n_breaking, count(*) FILTER (WHERE level IN ('HIGH', 'CRITICAL')) AS n_high, arg_max(level, list_position(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], level)) AS max_level FROM i")
def g08_report(spark, d):
    """Also A18."""
    i = gr.impact(edges(spark, d), symbols(spark, d), changed(spark, d))
    return i.agg(F.count("*").alias("n_changed"), F.count_if("breaking").alias("n_breaking"), F.count_if(F.col("level").isin("HIGH", "CRITICAL")).alias("n_high"), F.max_by("level", gr.level_rank(F.col("level"))).alias("max_level"))


@R.add("j22_drawing_edges", _IMPACT + " SELECT DISTINCT t.file_path AS changed, g.file_path AS affected FROM al JOIN g ON g.qualified_name = al.caller JOIN g t ON t.qualified_name = al.name WHERE t.symbol_id % 100 = 0 AND t.file_path <> g.file_path")
def j22_drawing_edges(spark, d):
    """One report per changed file: that file with each file its changed symbols affect."""
    c = changed(spark, d).select("qualified_name", F.col("file_path").alias("report"))
    i = gr.impact(edges(spark, d), symbols(spark, d), changed(spark, d)).select("name", F.explode("files").alias("file"))
    affected = i.join(c, F.col("name") == F.col("qualified_name")).select("report", "file").distinct()
    return gr.pairs_to_draw(c.select("report", F.col("report").alias("file")).distinct(), affected).select("changed", "affected")


@R.add("m01_insert_absent", with_views("SELECT id, full_name FROM repos UNION ALL SELECT -n.id AS id, 'new-' || n.id AS full_name FROM repos n WHERE n.id % 2 = 0", "repos"))
def m01_insert_absent(spark, d):
    r = v.repos(spark, d, "id", "full_name").select("id", "full_name")
    new = r.unionByName(r.filter("id % 2 = 0").select((-F.col("id")).alias("id"), F.concat(F.lit("new-"), F.col("id").cast("string")).alias("full_name")))
    return mu.insert_absent(r, new.select("id", F.when(F.col("id") > 0, "changed").otherwise(F.col("full_name")).alias("full_name")), ["id"])


@R.add("m02_upsert", with_views("SELECT id, CASE WHEN id % 10 = 0 THEN 'title ' || id ELSE title END AS title, author, diff_size FROM prs UNION ALL SELECT id + 1000000, 'new', 'ann', 1 FROM prs WHERE id % 50 = 0", "prs"))
def m02_upsert(spark, d):
    p = v.prs(spark, d, "id", "title", "author", "diff_size").select("id", "title", "author", "diff_size")
    edit = p.filter("id % 10 = 0").select("id", F.concat(F.lit("title "), F.col("id").cast("string")).alias("title"), F.lit("nobody").alias("author"), F.lit(None).cast("int").alias("diff_size"))
    new = p.filter("id % 50 = 0").select((F.col("id") + 1000000).alias("id"), F.lit("new").alias("title"), F.lit("ann").alias("author"), F.lit(1).alias("diff_size"))
    return mu.upsert(p, edit.unionByName(new), ["id"], ["title", "diff_size"])


@R.add("m04_defaults", with_views("SELECT id, coalesce(rule_id, '') AS rule_id, 'open' AS status FROM finds", "finds"))
def m04_defaults(spark, d):
    """Also M03: rows appended with the defaults of their table."""
    return mu.with_defaults(v.finds(spark, d, "id", "rule_id").select("id", "rule_id"), {"rule_id": "", "status": "open"})


@R.add("m05_transition", with_views("SELECT id, CASE WHEN id % 3 = 0 THEN 'failed' WHEN id % 3 = 1 THEN 'completed' ELSE status END AS status FROM revs", "revs"))
def m05_transition(spark, d):
    r = v.revs(spark, d, "id", "status").select("id", "status")
    log = r.filter("id % 3 < 2").select("id", F.lit(1).alias("at"), F.lit("running").alias("status")).unionByName(r.filter("id % 3 < 2").select("id", F.lit(2).alias("at"), F.when(F.col("id") % 3 == 0, "failed").otherwise("completed").alias("status")))
    log = log.unionByName(r.filter("id % 3 < 2").select("id", F.lit(3).alias("at"), F.lit(None).cast("string").alias("status")))
    return mu.transition(r, log, "id", "at", ["status"])


@R.add("m06_suppress", with_views("SELECT id, suppressed OR category = 'style' AS suppressed, CASE WHEN category = 'style' THEN 'noise' ELSE suppression_reason END AS suppression_reason FROM finds", "finds"))
def m06_suppress(spark, d):
    f = v.finds(spark, d, "id", "category", "suppressed", "suppression_reason").select("id", "category", "suppressed", "suppression_reason")
    new, _ = mu.update_where(f, F.col("category") == "style", {"suppressed": F.lit(True), "suppression_reason": F.lit("noise")})
    return new.drop("category")


@R.add("m06_rows_changed", with_views("SELECT count(*) AS n_changed FROM finds WHERE category = 'style'", "finds"))
def m06_rows_changed(spark, d):
    return mu.update_where(v.finds(spark, d, "category", "suppressed"), F.col("category") == "style", {"suppressed": F.lit(True)})[1]


@R.add("m07_unsuppress", with_views("SELECT id, CASE WHEN review_id % 2 = 0 THEN false ELSE suppressed END AS suppressed, CASE WHEN review_id % 2 = 0 THEN NULL ELSE suppression_reason END AS suppression_reason FROM finds", "finds"))
def m07_unsuppress(spark, d):
    f = v.finds(spark, d, "id", "review_id", "suppressed", "suppression_reason").select("id", "review_id", "suppressed", "suppression_reason")
    return mu.update_where(f, F.col("review_id") % 2 == 0, {"suppressed": F.lit(False), "suppression_reason": F.lit(None).cast("string")})[0].drop("review_id")


@R.add("m08_delete_cascade", with_views("SELECT 'findings' AS tbl, count(*) AS n FROM finds WHERE NOT EXISTS (SELECT 1 FROM revs WHERE revs.id = review_id AND status = 'failed') UNION ALL SELECT 'reviews', count(*) FROM revs WHERE coalesce(status <> 'failed', true)", "finds", "revs"))
def m08_delete_cascade(spark, d):
    out = mu.delete_cascade(v.revs(spark, d, "id", "status"), F.col("status") == "failed", "id", {"findings": (v.finds(spark, d, "id", "review_id"), "review_id")})
    return out["findings"].agg(F.lit("findings").alias("tbl"), F.count("*").alias("n")).unionByName(out[""].agg(F.lit("reviews").alias("tbl"), F.count("*").alias("n")))


@R.add("m10_json_field", "SELECT event_id, json_extract_string(props, '$.k') AS k, 'ready' AS status FROM events")
def m10_json_field(spark, d):
    e = v.load(spark, d, "events").select("event_id", mu.set_json_field(F.col("props"), "status", F.lit("ready")).alias("p"))
    return e.select("event_id", F.get_json_object("p", "$.k").alias("k"), F.get_json_object("p", "$.status").alias("status"))


@R.add("w11_debounced")
def w11_debounced(spark, d):
    """Also ST01. The last accepted event counts, so it is tested against a plain loop."""
    return ev.debounce(v.load(spark, d, "events"), "user_id", "ts", "event_id", 3600).withColumnRenamed("id", "event_id")


@R.add("w12_new_revisions", with_views("SELECT id FROM (SELECT id, commit_sha, lag(commit_sha) OVER w AS before, row_number() OVER w AS k FROM revs WINDOW w AS (PARTITION BY pull_request_id ORDER BY created_at, id)) WHERE k = 1 OR commit_sha IS DISTINCT FROM before", "revs"))
def w12_new_revisions(spark, d):
    """Also ST04."""
    return ev.new_revisions(v.revs(spark, d, "id", "pull_request_id", "commit_sha", "created_at").select("id", "pull_request_id", "created_at", "commit_sha"), "pull_request_id", ["created_at", "id"], "commit_sha").select("id")


@R.add("j24_unseen", with_views("SELECT r.id FROM revs r WHERE NOT EXISTS (SELECT 1 FROM revs s WHERE s.id % 2 = 0 AND s.pull_request_id = r.pull_request_id AND s.commit_sha IS NOT DISTINCT FROM r.commit_sha)", "revs"))
def j24_unseen(spark, d):
    """Also ST05 and S12."""
    r = v.revs(spark, d, "id", "pull_request_id", "commit_sha").select("id", "pull_request_id", "commit_sha")
    return ev.unseen(r, r.filter("id % 2 = 0").select("pull_request_id", "commit_sha").distinct(), ["pull_request_id"], "commit_sha").select("id")


@R.add("st06_until_terminal", with_views("SELECT event_id FROM (SELECT *, coalesce(sum((event_type IN ('purchase', 'error'))::INT) OVER (PARTITION BY review_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM evs) WHERE ended = 0", "evs"))
def st06_until_terminal(spark, d):
    return ev.until_terminal(v.evs(spark, d), "review_id", ["ts", "event_id"], F.col("event_type").isin("purchase", "error")).select("event_id")


@R.add("st10_wire_format", """SELECT event_id, 'event: ' || event_type || chr(10) || 'data: {"type":"' || event_type || '","review_id":' || user_id || '}' || chr(10) || chr(10) AS frame FROM events""")
def st10_wire_format(spark, d):
    """Also S25."""
    e = v.evs(spark, d)
    return e.select("event_id", ev.wire_format(F.col("event_type"), F.struct(F.col("event_type").alias("type"), "review_id")).alias("frame"))


@R.add("p16_routed", "SELECT event_id, CASE WHEN event_type = 'error' AND value > 20 THEN 'alarm' WHEN event_type = 'purchase' THEN 'review' WHEN event_type IN ('view', 'click') THEN 'index' ELSE 'ignored' END AS route FROM events")
def p16_routed(spark, d):
    """Also P14, P15, P17 and P18: ordered rules, the first that holds names the row."""
    t = F.col("event_type")
    return ev.route(v.load(spark, d, "events"), [("alarm", (t == "error") & (F.col("value") > 20)), ("review", t == "purchase"), ("index", t.isin("view", "click"))]).select("event_id", "route")


@R.add("p33_for_reader", "SELECT event_id FROM events WHERE user_id IS NULL OR user_id = 8")
def p33_for_reader(spark, d):
    return ev.for_reader(v.load(spark, d, "events"), "user_id", 8).select("event_id")


@R.add("p36_marked", "SELECT DISTINCT id FROM comments WHERE contains(body, 'race between')")
def p36_marked(spark, d):
    return v.load(spark, d, "comments").filter(F.contains("body", F.lit("race between"))).select("id").distinct()


@R.add("f21_backoff", "SELECT event_id, CAST(greatest(0, ([0, 120, 300, 900])[CAST(least(user_id % 6, 3) AS INTEGER) + 1] - CAST(floor(value) AS INTEGER)) AS INTEGER) AS wait FROM events")
def f21_backoff(spark, d):
    """Also ST03: the gate of the failure counter."""
    e = v.load(spark, d, "events")
    return e.select("event_id", ev.backoff_left(F.col("user_id") % 6, F.col("value"), [0, 120, 300, 900]).alias("wait"))


