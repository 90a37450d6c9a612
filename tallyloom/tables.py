"""The engine's tables: schemas, loading, versions of repeated rows.

Schemas are plain ``StructType`` constants of the code-review data model; ``load`` reads a table
from a directory of Parquet files or folders (``<dir>/<name>.parquet``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


SCHEMAS: dict[str, str] = {
    "repositories": "id BIGINT, provider STRING, full_name STRING, provider_id BIGINT, default_branch STRING, is_active BOOLEAN, created_at TIMESTAMP, updated_at TIMESTAMP",
    "pull_requests": "id BIGINT, repository_id BIGINT, provider_pr_id BIGINT, title STRING, author STRING, source_branch STRING, target_branch STRING, is_draft BOOLEAN, state STRING, diff_size INT, created_at TIMESTAMP, updated_at TIMESTAMP",
    "reviews": "id BIGINT, pull_request_id BIGINT, status STRING, mode STRING, model_used STRING, provider_used STRING, total_findings INT, error_count INT, warning_count INT, duration_seconds DOUBLE, total_tokens_input BIGINT, total_tokens_output BIGINT, cost_estimate DOUBLE, error_message STRING, commit_sha STRING, created_at TIMESTAMP, completed_at TIMESTAMP",
    "findings": "id BIGINT, review_id BIGINT, chapter_id BIGINT, file_path STRING, line_start INT, line_end INT, severity STRING, category STRING, rule_id STRING, tool_source STRING, message STRING, code_fix STRING, confidence DOUBLE, is_suppressed BOOLEAN, suppression_reason STRING",
    "review_events": "id BIGINT, review_id BIGINT, event_type STRING, message STRING, data STRING, created_at TIMESTAMP",
    "mcp_servers": "id BIGINT, name STRING, transport_type STRING, command STRING, args STRING, url STRING, is_active BOOLEAN, created_at TIMESTAMP",
    "chapters": "id BIGINT, review_id BIGINT, external_id STRING, `order` INT, title STRING, summary STRING, created_at TIMESTAMP",
    "key_changes": "id BIGINT, chapter_id BIGINT, external_id STRING, content STRING, line_refs_json STRING",
    "comment_threads": "id BIGINT, review_id BIGINT, file_path STRING, line_start INT, line_end INT, side STRING, status STRING, github_comment_id BIGINT, resolved BOOLEAN, created_at TIMESTAMP",
    "comments": "id BIGINT, thread_id BIGINT, author STRING, body STRING, is_bot BOOLEAN, created_at TIMESTAMP, edited_at TIMESTAMP",
    "stage_results": "id BIGINT, review_id BIGINT, stage_name STRING, model STRING, provider STRING, tokens_input BIGINT, tokens_output BIGINT, latency_seconds DOUBLE, cost_estimate DOUBLE, success BOOLEAN, error STRING, prompt STRING, raw_output STRING, created_at TIMESTAMP",
    "symbols": "symbol_id BIGINT, file_id BIGINT, name STRING, kind STRING, file_path STRING, line_start INT, line_end INT, qualified_name STRING, signature STRING, docstring STRING, is_exported BOOLEAN",
    "source_files": "file_id BIGINT, repository_id BIGINT, file_path STRING, lang STRING, content STRING, size_bytes BIGINT, commit_sha STRING, indexed_at TIMESTAMP",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, kind STRING, file_path STRING, created_at TIMESTAMP",
    "edges": "source STRING, target STRING, kind STRING, file_path STRING, line INT",
    "chunks": "content STRING, file_path STRING, start_line INT, end_line INT, chunk_type STRING, symbol_name STRING, language STRING, metadata MAP<STRING,STRING>",
    "lint_findings": "file_path STRING, line INT, `column` INT, severity STRING, rule_id STRING, message STRING, tool STRING, fix_suggestion STRING",
    "history": "pr_number INT, repo STRING, timestamp STRING, title STRING, diff_summary STRING, findings ARRAY<STRUCT<severity:STRING,comment:STRING>>, reviewer_comments ARRAY<STRING>, resolution STRING, embedding_text STRING, metadata MAP<STRING,STRING>",
}


def schema(name: str) -> T.StructType:
    """The ``StructType`` of a table of the data model."""
    return T.StructType.fromDDL(SCHEMAS[name])


def load(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Read ``<directory>/<name>.parquet`` (one file or a folder of files)."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def empty(spark: SparkSession, name: str) -> DataFrame:
    """An empty table of the data model."""
    return spark.createDataFrame([], schema(name))


def latest_by_id(df: DataFrame, key: str, order: str | tuple[str, ...] | None = None) -> DataFrame:
    """One row per ``key``: the one greatest in ``order`` (nulls first), else in all columns.

    A plain aggregation with partial (map-side) maxima, so an id that holds a third of all rows
    costs one row per input partition. Rows whose key is null are kept as one row. The result
    depends on the values only, never on the order of arrival.
    """
    first = (order,) if isinstance(order, str) else order or ()
    rest = [c for c in df.columns if c != key and c not in first]
    if not rest and not first:
        return df.distinct()
    fields = [F.col(f"`{c}`") for c in (*first, *rest)]
    return df.groupBy(F.col(f"`{key}`")).agg(F.max(F.struct(*fields)).alias("__v")).select(*[F.col(f"`{c}`") if c == key else F.col(f"__v.`{c}`").alias(c) for c in df.columns])
