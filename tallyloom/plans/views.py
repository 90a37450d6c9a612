"""Cleaned views of the supplied tables, as DataFrames and as the SQL that says the same.

One row per id (rows delivered twice are one), names of enums in lower case, severities and
categories normalised, models in one spelling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.text import norm_name, norm_path
from tallyloom.operators.findings import norm_category, norm_severity
from tallyloom.tables import latest_by_id, load

SQL = {
    "repos": "SELECT DISTINCT id, lower(trim(provider)) AS provider, lower(trim(full_name)) AS full_name, provider_id, default_branch, is_active, created_at, updated_at FROM repositories",
    "prs": "SELECT DISTINCT id, repository_id, provider_pr_id, title, author, source_branch, target_branch, is_draft, lower(trim(state)) AS state, diff_size, created_at, updated_at FROM pull_requests",
    "revs": "SELECT DISTINCT id, pull_request_id, lower(trim(status)) AS status, mode, nullif(regexp_replace(lower(trim(model_used)), '[_ ]+', '-', 'g'), '') AS model, total_findings, error_count, warning_count, CASE WHEN completed_at IS NOT NULL AND NOT isnan(duration_seconds) AND duration_seconds >= 0 THEN duration_seconds END AS duration, total_tokens_input AS tokens_in, total_tokens_output AS tokens_out, CASE WHEN NOT isnan(cost_estimate) AND cost_estimate >= 0 THEN cost_estimate END AS cost, commit_sha, created_at, completed_at FROM reviews",
    "finds": r"""SELECT DISTINCT id, review_id, nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(trim(file_path), '\', '/'), '^\s+|\s+$', '', 'g'), '/(\./)+', '/', 'g'), '/{2,}', '/', 'g'), '^(\./|/)+', ''), '') AS file_path, line_start, line_end,
        CASE WHEN lower(trim(severity)) IN ('error', 'warning', 'note') THEN lower(trim(severity)) ELSE 'note' END AS severity,
        CASE WHEN lower(trim(category)) IN ('security', 'correctness', 'reliability', 'performance', 'maintainability', 'style', 'vulnerability') THEN lower(trim(category)) ELSE 'maintainability' END AS category,
        rule_id, tool_source, message, confidence, coalesce(is_suppressed, false) AS suppressed, suppression_reason FROM findings""",
    "syms": "SELECT DISTINCT symbol_id, file_id, name, lower(trim(kind)) AS kind, file_path, line_start, line_end, qualified_name, is_exported FROM symbols",
    "threads": "SELECT DISTINCT id, review_id, file_path, line_start, resolved, created_at FROM comment_threads",
    "evs": "SELECT event_id, ts, user_id AS review_id, event_type, value, props FROM events",
}


def with_views(body: str, *names: str) -> str:
    """SQL with the named views in front."""
    if not names:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names) + "\n" + body


def _pruned(df: DataFrame, spec: dict[str, tuple[tuple[str, ...], Column]], want: tuple[str, ...], order: tuple[str, ...] = ()) -> DataFrame:
    """The wanted columns of a view, one row per id; only the raw columns that they need are read and shuffled.

    Of several versions of an id the one greatest in ``order`` stands, whatever columns are wanted.
    """
    want = want or tuple(spec)
    raw = dict.fromkeys(["id", *order, *(c for w in want for c in spec[w][0])])
    one = latest_by_id(df.select(*raw), "id", order)
    return one.select(*[spec[w][1].alias(w) for w in want])


def _same(*names: str) -> dict[str, tuple[tuple[str, ...], Column]]:
    return {n: ((n,), F.col(n)) for n in names}


def _usable(c: str) -> Column:
    return ~F.isnan(c) & (F.col(c) >= 0)


def repos(spark: SparkSession, d: str, *want: str) -> DataFrame:
    spec = _same("id", "provider_id", "default_branch", "is_active", "created_at", "updated_at") | {"provider": (("provider",), F.lower(F.trim("provider"))), "full_name": (("full_name",), F.lower(F.trim("full_name")))}
    return _pruned(load(spark, d, "repositories"), spec, want, ("updated_at",))


def prs(spark: SparkSession, d: str, *want: str) -> DataFrame:
    spec = _same("id", "repository_id", "provider_pr_id", "title", "author", "source_branch", "target_branch", "is_draft", "diff_size", "created_at", "updated_at") | {"state": (("state",), F.lower(F.trim("state")))}
    return _pruned(load(spark, d, "pull_requests"), spec, want, ("updated_at",))


def revs(spark: SparkSession, d: str, *want: str) -> DataFrame:
    spec = _same("id", "pull_request_id", "mode", "total_findings", "error_count", "warning_count", "commit_sha", "created_at", "completed_at") | {
        "status": (("status",), F.lower(F.trim("status"))),
        "model": (("model_used",), norm_name(F.col("model_used"))),
        "duration": (("completed_at", "duration_seconds"), F.when(F.col("completed_at").isNotNull() & _usable("duration_seconds"), F.col("duration_seconds"))),
        "tokens_in": (("total_tokens_input",), F.col("total_tokens_input")),
        "tokens_out": (("total_tokens_output",), F.col("total_tokens_output")),
        "cost": (("cost_estimate",), F.when(_usable("cost_estimate"), F.col("cost_estimate"))),
    }
    return _pruned(load(spark, d, "reviews"), spec, want, ("completed_at", "created_at", "pull_request_id"))


def finds(spark: SparkSession, d: str, *want: str) -> DataFrame:
    spec = _same("id", "review_id", "line_start", "line_end", "rule_id", "tool_source", "message", "confidence", "suppression_reason") | {
        "file_path": (("file_path",), norm_path(F.col("file_path"))),
        "severity": (("severity",), norm_severity(F.col("severity"))),
        "category": (("category",), norm_category(F.col("category"))),
        "suppressed": (("is_suppressed",), F.coalesce("is_suppressed", F.lit(False))),
    }
    return _pruned(load(spark, d, "findings"), spec, want, ("review_id", "line_start", "confidence"))


def syms(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "symbols").select("symbol_id", "file_id", "name", F.lower(F.trim("kind")).alias("kind"), "file_path", "line_start", "line_end", "qualified_name", "is_exported")
    return s.distinct()


def threads(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "comment_threads").select("id", "review_id", "file_path", "line_start", "resolved", "created_at").distinct()


def evs(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").withColumnRenamed("user_id", "review_id")
