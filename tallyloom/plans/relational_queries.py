"""Review analytics over the supplied tables: scans, filters, joins, aggregations, top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import relational as rel
from tallyloom.plans import views as v
from tallyloom.plans.registry import Registry
from tallyloom.plans.views import with_views

R = Registry()
ANCHOR = "2025-12-01"


@R.add("s01_scan", "SELECT id, review_id, file_path, line_start, severity FROM findings")
def s01_scan(spark: SparkSession, d: str) -> DataFrame:
    return v.load(spark, d, "findings").select("id", "review_id", "file_path", "line_start", "severity")


@R.add("p01_by_id", with_views("SELECT id, status, mode FROM revs WHERE id = 42", "revs"))
def p01_by_id(spark, d):
    return rel.lookup(v.revs(spark, d, "id", "status", "mode"), id=42).select("id", "status", "mode")


@R.add("p02_by_names", with_views("SELECT id, provider, full_name FROM repos WHERE provider = 'github' AND full_name = 'optional-envelopes/patch-kit'", "repos"))
def p02_by_names(spark, d):
    return rel.lookup(v.repos(spark, d, "id", "provider", "full_name"), provider="github", full_name="optional-envelopes/patch-kit").select("id", "provider", "full_name")


@R.add("p03_active", with_views("SELECT id, full_name FROM repos WHERE is_active", "repos"))
def p03_active(spark, d):
    return v.repos(spark, d, "id", "full_name", "is_active").filter("is_active").select("id", "full_name")


@R.add("p04_open_pulls", with_views("SELECT id, title FROM prs WHERE repository_id = 7 AND state = 'open'", "prs"))
def p04_open_pulls(spark, d):
    return rel.lookup(v.prs(spark, d, "id", "repository_id", "title", "state"), repository_id=7, state="open").select("id", "title")


@R.add("p05_recent_reviews", with_views(f"SELECT id, created_at FROM revs WHERE created_at >= DATE '{ANCHOR}' - 29 AND created_at < DATE '{ANCHOR}' + 1", "revs"))
def p05_recent_reviews(spark, d):
    return rel.since(v.revs(spark, d, "id", "created_at"), "created_at", ANCHOR, 30).select("id", "created_at")


@R.add("p06_unsuppressed", with_views("SELECT id FROM finds WHERE NOT suppressed", "finds"))
def p06_unsuppressed(spark, d):
    return v.finds(spark, d, "id", "suppressed").filter(~F.col("suppressed")).select("id")


@R.add("p07_json_path", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events")
def p07_json_path(spark, d):
    """Fields of a JSON column by path, with a default for absent ones, through VARIANT."""
    p = v.load(spark, d, "events").withColumn("j", F.try_parse_json("props"))
    return p.select("event_id", F.try_variant_get("j", "$.k", "bigint").alias("k"), F.coalesce(F.try_variant_get("j", "$.missing", "string"), F.lit("none")).alias("missing"))


@R.add("p08_finding_of_review", with_views("SELECT id, review_id FROM finds WHERE id = 11 AND review_id = 2760", "finds"))
def p08_finding_of_review(spark, d):
    return rel.lookup(v.finds(spark, d, "id", "review_id"), id=11, review_id=2760).select("id", "review_id")


@R.add("p09_nullable", with_views("SELECT id, CASE WHEN completed_at IS NOT NULL THEN strftime(completed_at, '%Y-%m-%dT%H:%M:%S') END AS completed_iso, coalesce(model, 'unknown') AS model FROM revs", "revs"))
def p09_nullable(spark, d):
    return v.revs(spark, d, "id", "model", "completed_at").select("id", F.date_format("completed_at", "yyyy-MM-dd'T'HH:mm:ss").alias("completed_iso"), F.coalesce("model", F.lit("unknown")).alias("model"))


@R.add("p25_search", with_views("SELECT p.id, r.full_name, p.title FROM prs p LEFT JOIN repos r ON p.repository_id = r.id WHERE (p.title ILIKE '%listener%' OR r.full_name ILIKE '%listener%') AND p.state = 'merged'", "prs", "repos"))
def p25_search(spark, d):
    r = v.repos(spark, d, "id", "full_name").select(F.col("id").alias("rid"), "full_name")
    j = v.prs(spark, d, "id", "repository_id", "title", "state").join(r, F.col("repository_id") == F.col("rid"), "left")
    return j.filter((F.col("title").ilike("%listener%") | F.col("full_name").ilike("%listener%")) & (F.col("state") == "merged")).select("id", "full_name", "title")


@R.add("j01_reviews_of_repository", with_views("SELECT v.id, p.repository_id FROM revs v JOIN prs p ON v.pull_request_id = p.id WHERE p.repository_id = 7", "revs", "prs"))
def j01_reviews_of_repository(spark, d):
    p = v.prs(spark, d, "id", "repository_id").filter("repository_id = 7").select(F.col("id").alias("pid"), "repository_id")
    return v.revs(spark, d, "id", "pull_request_id").join(p, F.col("pull_request_id") == F.col("pid")).select("id", "repository_id")


@R.add("j02_findings_by_repository", with_views("SELECT p.repository_id, count(*) AS n FROM finds f JOIN revs v ON f.review_id = v.id JOIN prs p ON v.pull_request_id = p.id GROUP BY 1", "finds", "revs", "prs"))
def j02_findings_by_repository(spark, d):
    """Three-way join with the counting pushed below it: findings shrink to one row per review first."""
    per = v.finds(spark, d, "id", "review_id").groupBy("review_id").agg(F.count("*").alias("n"))
    r = v.revs(spark, d, "id", "pull_request_id").select(F.col("id").alias("rid"), "pull_request_id")
    p = v.prs(spark, d, "id", "repository_id").select(F.col("id").alias("pid"), "repository_id")
    j = per.join(r, F.col("review_id") == F.col("rid")).join(p, F.col("pull_request_id") == F.col("pid"))
    return j.groupBy("repository_id").agg(F.sum("n").alias("n"))


@R.add("j03_findings_by_day", with_views("SELECT CAST(v.created_at AS DATE) AS day, count(*) AS n FROM finds f JOIN revs v ON f.review_id = v.id GROUP BY 1", "finds", "revs"))
def j03_findings_by_day(spark, d):
    r = v.revs(spark, d, "id", "created_at").select(F.col("id").alias("rid"), F.to_date("created_at").alias("day"))
    return v.finds(spark, d, "id", "review_id").select("review_id").join(r, F.col("review_id") == F.col("rid")).groupBy("day").agg(F.count("*").alias("n"))


@R.add("j04_review_chain", with_views("SELECT v.id, p.title, r.full_name FROM revs v LEFT JOIN prs p ON v.pull_request_id = p.id LEFT JOIN repos r ON p.repository_id = r.id", "revs", "prs", "repos"))
def j04_review_chain(spark, d):
    p = v.prs(spark, d, "id", "repository_id", "title").select(F.col("id").alias("pid"), "title", "repository_id")
    r = v.repos(spark, d, "id", "full_name").select(F.col("id").alias("rid"), "full_name")
    return v.revs(spark, d, "id", "pull_request_id").join(p, F.col("pull_request_id") == F.col("pid"), "left").join(r, F.col("repository_id") == F.col("rid"), "left").select("id", "title", "full_name")


@R.add("j05_nested_findings", with_views("SELECT v.id, count(f.id) AS n, coalesce(string_agg(f.id::VARCHAR, ',' ORDER BY f.id), '') AS finding_ids FROM revs v LEFT JOIN finds f ON f.review_id = v.id GROUP BY 1", "revs", "finds"))
def j05_nested_findings(spark, d):
    n = rel.nest_children(v.revs(spark, d, "id").select("id"), v.finds(spark, d, "id", "review_id", "severity"), "id", "review_id", ["severity"], "id", "findings")
    return n.select("id", F.size("findings").cast("long").alias("n"), F.array_join(F.transform("findings", lambda x: x["id"].cast("string")), ",").alias("finding_ids"))


@R.add("j06_repository_overview", with_views("""
    , j AS (SELECT p.repository_id AS repo, v.id AS vid, v.status FROM revs v JOIN prs p ON v.pull_request_id = p.id),
    a AS (SELECT repo, count(*) AS rv, count(*) FILTER (WHERE status = 'completed') AS ok FROM j GROUP BY 1),
    b AS (SELECT repo, count(*) AS o FROM finds f JOIN j ON f.review_id = j.vid WHERE NOT suppressed GROUP BY 1)
    SELECT r.id, r.full_name, coalesce(rv, 0) AS reviews_count, coalesce(ok, 0) AS completed_count,
           CASE WHEN coalesce(rv, 0) > 0 THEN CAST(round_even(100.0 * ok / rv, 0) AS INTEGER) ELSE 100 END AS success_rate, coalesce(o, 0) AS open_issues
    FROM repos r LEFT JOIN a ON a.repo = r.id LEFT JOIN b ON b.repo = r.id""", "repos", "prs", "revs", "finds").replace("\n\n    , j AS", ",\n    j AS"))
def j06_repository_overview(spark, d):
    """Also A09."""
    return rel.repository_overview(v.repos(spark, d, "id", "full_name"), v.prs(spark, d, "id", "repository_id"), v.revs(spark, d, "id", "pull_request_id", "status"), v.finds(spark, d, "review_id", "suppressed"))


@R.add("a01_status_counts", with_views("SELECT count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'running') AS running FROM revs", "revs"))
def a01_status_counts(spark, d):
    return rel.status_counts(v.revs(spark, d, "status"))


@R.add("a02_active_count", with_views("SELECT count(*) AS n FROM repos WHERE is_active", "repos"))
def a02_active_count(spark, d):
    return v.repos(spark, d, "is_active").filter("is_active").agg(F.count("*").alias("n"))


_SEV = "count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings, count(*) FILTER (WHERE severity = 'note') AS notes, count(*) AS total"


@R.add("a03_severity_counts", with_views(f"SELECT {_SEV} FROM finds WHERE NOT suppressed", "finds"))
def a03_severity_counts(spark, d):
    return rel.severity_counts(v.finds(spark, d, "severity", "suppressed").filter(~F.col("suppressed")))


@R.add("a04_top_categories", with_views("SELECT category, count(*) AS n FROM finds WHERE NOT suppressed GROUP BY 1 ORDER BY n DESC, category LIMIT 10", "finds"))
def a04_top_categories(spark, d):
    n = v.finds(spark, d, "category", "suppressed").filter(~F.col("suppressed")).groupBy("category").agg(F.count("*").alias("n"))
    return rel.top(n, 10, F.desc("n"), F.asc("category"))


@R.add("a05_findings_per_review", with_views("SELECT CASE WHEN r.n > 0 THEN round_even(f.n / r.n, 2) ELSE 0 END AS ratio FROM (SELECT count(*) AS n FROM finds WHERE NOT suppressed) f, (SELECT count(*) AS n FROM revs WHERE status = 'completed') r", "finds", "revs"))
def a05_findings_per_review(spark, d):
    f = v.finds(spark, d, "suppressed").filter(~F.col("suppressed")).agg(F.count("*").alias("f"))
    r = v.revs(spark, d, "status").filter("status = 'completed'").agg(F.count("*").alias("r"))
    return f.join(r).select(F.bround(F.when(F.col("r") > 0, F.col("f") / F.col("r")).otherwise(0.0), 2).alias("ratio"))  # one row each


@R.add("a06_mean_duration", with_views("SELECT round_even(coalesce(avg(duration), 0), 1) AS avg_seconds FROM revs WHERE status = 'completed'", "revs"))
def a06_mean_duration(spark, d):
    return v.revs(spark, d, "status", "duration").filter("status = 'completed'").agg(F.bround(F.coalesce(F.avg("duration"), F.lit(0.0)), 1).alias("avg_seconds"))


@R.add("a07_daily_trend", with_views(f"""
    , c AS (SELECT CAST(v.created_at AS DATE) AS d, severity FROM finds f JOIN revs v ON f.review_id = v.id WHERE NOT suppressed)
    SELECT CAST(day AS DATE) AS day, count(*) FILTER (WHERE severity = 'error') AS critical, count(*) FILTER (WHERE severity = 'warning') AS high, count(*) FILTER (WHERE severity NOT IN ('error', 'warning')) AS other
    FROM (SELECT unnest(generate_series(DATE '{ANCHOR}' - 29, DATE '{ANCHOR}', INTERVAL 1 DAY)) AS day) LEFT JOIN c ON c.d = CAST(day AS DATE) GROUP BY 1""", "finds", "revs").replace("\n\n    , c AS", ",\n    c AS"))
def a07_daily_trend(spark, d):
    return rel.daily_trend(v.revs(spark, d, "id", "created_at"), v.finds(spark, d, "review_id", "severity", "suppressed"), ANCHOR, 30)


@R.add("a08_repository_stats", with_views("SELECT p.repository_id, count(*) AS n_reviews, round(coalesce(avg(total_findings), 0), 6) AS avg_findings, round(coalesce(avg(duration), 0), 6) AS avg_duration, coalesce(CAST(sum(CAST(cost AS DECIMAL(18, 9))) AS DOUBLE), 0) AS total_cost FROM revs v JOIN prs p ON v.pull_request_id = p.id GROUP BY 1", "revs", "prs"))
def a08_repository_stats(spark, d):
    return rel.repository_stats(v.prs(spark, d, "id", "repository_id"), v.revs(spark, d, "pull_request_id", "total_findings", "duration", "cost"))


@R.add("a22_symbol_counts", with_views("SELECT count(DISTINCT qualified_name) AS n_names, count(*) AS n_symbols, count(DISTINCT file_id) AS n_files FROM syms", "syms"))
def a22_symbol_counts(spark, d):
    return v.syms(spark, d).agg(F.count_distinct("qualified_name").alias("n_names"), F.count("*").alias("n_symbols"), F.count_distinct("file_id").alias("n_files"))


@R.add("a25_index_stats", "SELECT count(*) AS n_files, sum(len(regexp_split_to_array(content, '\\r\\n|\\r|\\n')))::BIGINT AS n_lines FROM (SELECT DISTINCT file_id, content FROM source_files WHERE content IS NOT NULL)")
def a25_index_stats(spark, d):
    f = v.load(spark, d, "source_files").filter("content is not null").select("file_id", "content").distinct()
    return f.agg(F.count("*").alias("n_files"), F.sum(F.size(F.split("content", r"\r\n|\r|\n"))).alias("n_lines"))


@R.add("a27_events_per_review", with_views("SELECT review_id, count(*) AS n FROM evs GROUP BY 1", "evs"))
def a27_events_per_review(spark, d):
    return v.evs(spark, d).groupBy("review_id").agg(F.count("*").alias("n"))


@R.add("a30_open_per_review", with_views("SELECT review_id, count(*) FILTER (WHERE NOT suppressed) AS n_open FROM finds GROUP BY 1", "finds"))
def a30_open_per_review(spark, d):
    return v.finds(spark, d, "review_id", "suppressed").groupBy("review_id").agg(F.count_if(~F.col("suppressed")).alias("n_open"))


@R.add("t01_latest_reviews", with_views("SELECT id, created_at FROM revs ORDER BY created_at DESC, id DESC LIMIT 50", "revs"))
def t01_latest_reviews(spark, d):
    return rel.top(v.revs(spark, d, "id", "created_at").select("id", "created_at"), 50, F.desc("created_at"), F.desc("id"))


@R.add("t02_open_pulls_latest", with_views("SELECT id, updated_at FROM prs WHERE repository_id = 7 AND state = 'open' ORDER BY updated_at DESC, id DESC LIMIT 50", "prs"))
def t02_open_pulls_latest(spark, d):
    return rel.top(rel.lookup(v.prs(spark, d, "id", "repository_id", "state", "updated_at"), repository_id=7, state="open").select("id", "updated_at"), 50, F.desc("updated_at"), F.desc("id"))


@R.add("t03_reviews_per_pull", with_views("SELECT * FROM (SELECT id, pull_request_id, CAST(row_number() OVER (PARTITION BY pull_request_id ORDER BY created_at DESC, id DESC) AS INTEGER) AS rank FROM revs) WHERE rank <= 10", "revs"))
def t03_reviews_per_pull(spark, d):
    return rel.newest(v.revs(spark, d, "id", "pull_request_id", "created_at").select("id", "pull_request_id", "created_at"), ["pull_request_id"], 10, F.desc("created_at"), F.desc("id")).drop("created_at")


@R.add("t04_findings_in_order", with_views("SELECT id, CAST(row_number() OVER (PARTITION BY review_id ORDER BY upper(severity), file_path NULLS FIRST, line_start, id) AS INTEGER) AS rank FROM finds", "finds"))
def t04_findings_in_order(spark, d):
    """Findings of each review by severity name, path and line; ranks by a distributed sort, as a review may hold any number."""
    from tallyloom.operators.ranking import distributed_rank

    f = v.finds(spark, d, "id", "review_id", "file_path", "line_start", "severity").select("id", "review_id", F.upper("severity").alias("s"), "file_path", "line_start")
    return distributed_rank(f, ["review_id"], ["s", "file_path", "line_start", "id"], "rank").select("id", F.col("rank").cast("int").alias("rank"))


@R.add("t05_first_events", with_views("SELECT * FROM (SELECT event_id, review_id, CAST(row_number() OVER (PARTITION BY review_id ORDER BY ts, event_id) AS INTEGER) AS rank FROM evs) WHERE rank <= 50", "evs"))
def t05_first_events(spark, d):
    return rel.newest(v.evs(spark, d).select("event_id", "review_id", "ts"), ["review_id"], 50, F.asc("ts"), F.asc("event_id")).drop("ts")


@R.add("t13_last_trend_days", with_views(f"SELECT day, n FROM (SELECT CAST(v.created_at AS DATE) AS day, count(*) AS n FROM revs v WHERE created_at < DATE '{ANCHOR}' + 1 GROUP BY 1) ORDER BY day DESC LIMIT 7", "revs"))
def t13_last_trend_days(spark, d):
    n = v.revs(spark, d, "created_at").filter(F.col("created_at") < F.lit(ANCHOR).cast("date") + F.expr("interval 1 day")).groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"))
    return rel.top(n, 7, F.desc("day"))


@R.add("st08_last_events", with_views("SELECT * FROM (SELECT event_id, review_id, CAST(row_number() OVER (PARTITION BY review_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS rank FROM evs) WHERE rank <= 6", "evs"))
def st08_last_events(spark, d):
    return rel.newest(v.evs(spark, d).select("event_id", "review_id", "ts"), ["review_id"], 6, F.desc("ts"), F.desc("event_id")).drop("ts")


@R.add("w02_latest_version", "SELECT id, max(coalesce(edited_at, TIMESTAMP '1900-01-01')) AS version_at FROM comments GROUP BY 1")
def w02_latest_version(spark, d):
    """The latest version of each comment by one aggregation."""
    from tallyloom.tables import latest_by_id

    c = latest_by_id(v.load(spark, d, "comments"), "id", "edited_at")
    return c.select("id", F.coalesce("edited_at", F.lit("1900-01-01").cast("timestamp_ntz")).alias("version_at"))


@R.add("w04_last_model", with_views("SELECT id, last_value(model IGNORE NULLS) OVER (PARTITION BY pull_request_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS last_model FROM revs", "revs"))
def w04_last_model(spark, d):
    from tallyloom.operators.ranking import distributed_last

    r = v.revs(spark, d, "id", "pull_request_id", "model", "created_at").select("id", "pull_request_id", "model", "created_at")
    return distributed_last(r, ["pull_request_id"], ["created_at", "id"], "model", "last_model").select("id", "last_model")


@R.add("u06_repository_names", with_views("SELECT DISTINCT full_name FROM repos WHERE full_name IS NOT NULL", "repos"))
def u06_repository_names(spark, d):
    return v.repos(spark, d, "full_name").select("full_name").dropna().distinct()


@R.add("f16_dates", with_views("SELECT id, CAST(created_at AS DATE) AS day, strftime(created_at, '%Y-%m-%d') AS label, CAST(CAST(created_at AS DATE) - 29 AS DATE) AS window_start, CAST(isodow(created_at) AS INTEGER) AS weekday FROM revs", "revs"))
def f16_dates(spark, d):
    day = F.to_date("created_at")
    return v.revs(spark, d, "id", "created_at").select("id", day.alias("day"), F.date_format("created_at", "yyyy-MM-dd").alias("label"), F.date_sub(day, 29).alias("window_start"), (F.weekday(day) + 1).alias("weekday"))


@R.add("f18_rounding", with_views("SELECT id, round_even(duration, 1) AS r1, CAST(floor(duration + 0.5) AS BIGINT) AS half_up, round_even(total_findings / 4.0, 0) AS half_even FROM revs WHERE duration IS NOT NULL", "revs"))
def f18_rounding(spark, d):
    r = v.revs(spark, d, "id", "total_findings", "duration").filter("duration is not null")
    return r.select("id", F.bround("duration", 1).alias("r1"), F.floor(F.col("duration") + 0.5).alias("half_up"), F.bround(F.col("total_findings") / 4.0, 0).alias("half_even"))


@R.add("f23_maps", with_views("SELECT review_id, CAST(len(map_keys(m)) AS INTEGER) AS n_severities, coalesce(m['error'], 0) AS n_errors FROM (SELECT review_id, map_from_entries(list((severity, n))) AS m FROM (SELECT review_id, severity, count(*) AS n FROM finds GROUP BY 1, 2) GROUP BY 1)", "finds"))
def f23_maps(spark, d):
    n = v.finds(spark, d, "review_id", "severity").groupBy("review_id", "severity").agg(F.count("*").alias("n"))
    m = n.groupBy("review_id").agg(F.map_from_entries(F.collect_list(F.struct("severity", "n"))).alias("m"))
    return m.select("review_id", F.size("m").alias("n_severities"), F.coalesce(F.try_element_at("m", F.lit("error")), F.lit(0)).alias("n_errors"))


@R.add("w15_running_counts", with_views("SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n_so_far FROM evs", "evs"))
def w15_running_counts(spark, d):
    """Running counters per event type (a handful of keys): ranks by a distributed sort, so no type is one task."""
    from tallyloom.operators.ranking import distributed_rank

    return distributed_rank(v.evs(spark, d).select("event_id", "event_type", "ts"), ["event_type"], ["ts", "event_id"], "n_so_far").select("event_id", "n_so_far")


