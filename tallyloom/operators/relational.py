"""Review analytics: lookups, counts, pivots, trends, per-repository figures.

Every operator takes DataFrames and gives a DataFrame; nothing is collected. Fan-out joins are
avoided by aggregating each level before it is joined.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lookup(df: DataFrame, **keys: object) -> DataFrame:
    """Rows whose columns equal the given values (null-safe): primary and composite keys alike."""
    for k, v in keys.items():
        df = df.filter(F.col(k).eqNullSafe(F.lit(v)))
    return df


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """First ``n`` rows by ``order``, which should end in a unique key (TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(n)


def since(df: DataFrame, column: str, anchor: date | str, days: int) -> DataFrame:
    """Rows of the ``days`` days that end with ``anchor``."""
    first = F.date_sub(F.lit(str(anchor)).cast("date"), days - 1).cast("timestamp")
    return df.filter((F.col(column) >= first) & (F.col(column) < F.date_add(F.lit(str(anchor)).cast("date"), 1).cast("timestamp")))


def status_counts(reviews: DataFrame) -> DataFrame:
    """One row: total and the number of completed, failed and running reviews."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return reviews.agg(F.count("*").alias("total"), n("completed"), n("failed"), n("running"))


def severity_counts(findings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Errors, warnings, notes and all findings, over everything or per group: a pivot in one pass."""
    n = lambda s, name: F.count_if(F.col("severity") == s).alias(name)
    return findings.groupBy(*(by or [])).agg(n("error", "errors"), n("warning", "warnings"), n("note", "notes"), F.count("*").alias("total"))


def daily_trend(reviews: DataFrame, findings: DataFrame, anchor: date | str, days: int = 30) -> DataFrame:
    """(day, critical, high, other) for each of ``days`` days up to ``anchor``, zeros where nothing happened.

    Findings are counted by the day of their review; the calendar is generated and left-joined.
    """
    recent = since(reviews, "created_at", anchor, days).select(F.col("id").alias("rid"), F.to_date("created_at").alias("d"))
    hits = findings.filter(~F.col("suppressed")).join(recent, F.col("review_id") == F.col("rid"))
    counts = hits.groupBy("d").agg(F.count_if(F.col("severity") == "error").alias("c"), F.count_if(F.col("severity") == "warning").alias("h"), F.count_if(~F.col("severity").isin("error", "warning")).alias("o"))
    end = F.lit(str(anchor)).cast("date")
    calendar = reviews.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(end, days - 1), end)).alias("day"))
    zero = lambda c, n: F.coalesce(c, F.lit(0)).alias(n)
    return calendar.join(counts, F.col("day") == F.col("d"), "left").select("day", zero("c", "critical"), zero("h", "high"), zero("o", "other"))


def repository_overview(repos: DataFrame, pulls: DataFrame, reviews: DataFrame, findings: DataFrame) -> DataFrame:
    """Per repository: reviews, completed ones, success rate in percent (100 if none), open findings.

    Findings are counted per review and reviews per pull request before they meet the repositories,
    so no join multiplies rows.
    """
    per_review = findings.filter(~F.col("suppressed")).groupBy("review_id").agg(F.count("*").alias("n"))
    r = reviews.join(per_review, F.col("id") == F.col("review_id"), "left")
    per_pr = r.groupBy("pull_request_id").agg(F.count("*").alias("rv"), F.count_if(F.col("status") == "completed").alias("ok"), F.sum(F.coalesce("n", F.lit(0))).alias("open"))
    per_repo = pulls.join(per_pr, F.col("id") == F.col("pull_request_id")).groupBy(F.col("repository_id").alias("repo")).agg(F.sum("rv").alias("rv"), F.sum("ok").alias("ok"), F.sum("open").alias("open"))
    j = repos.join(per_repo, F.col("id") == F.col("repo"), "left")
    rv, ok = F.coalesce("rv", F.lit(0)), F.coalesce("ok", F.lit(0))
    rate = F.when(rv > 0, F.bround(100 * ok / rv, 0).cast("int")).otherwise(F.lit(100))
    return j.select("id", "full_name", rv.alias("reviews_count"), ok.alias("completed_count"), rate.alias("success_rate"), F.coalesce("open", F.lit(0)).alias("open_issues"))


def repository_stats(pulls: DataFrame, reviews: DataFrame) -> DataFrame:
    """Per repository: reviews, mean findings, mean duration, total cost (summed as decimals, so the order of rows doesn't matter); nulls count as 0."""
    j = reviews.join(pulls.select(F.col("id").alias("pid"), "repository_id"), F.col("pull_request_id") == F.col("pid"))
    mean = lambda c, n: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(n)
    return j.groupBy("repository_id").agg(F.count("*").alias("n_reviews"), mean("total_findings", "avg_findings"), mean("duration", "avg_duration"), F.coalesce(F.sum(F.col("cost").cast("decimal(18,9)")).cast("double"), F.lit(0.0)).alias("total_cost"))


def latest_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row per key by ``order`` (ends in a unique key)."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def newest(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows per key by ``order``; a rank limit, which Spark pushes below the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def nest_children(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, fields: list[str], order: str, name: str) -> DataFrame:
    """Parents with their children as an array of structs in ``order``, empty where there are none."""
    rows = F.array_sort(F.collect_list(F.struct(order, *[f for f in fields if f != order])))
    lists = children.groupBy(F.col(child_key).alias("__k")).agg(rows.alias(name))
    j = parents.join(lists, parents[parent_key] == F.col("__k"), "left")
    return j.select(*parents.columns, F.coalesce(name, F.array().cast(lists.schema[name].dataType)).alias(name))
