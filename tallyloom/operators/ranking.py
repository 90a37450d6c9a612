"""Exact ranks by a full distributed sort with per-partition counts.

A window over one key puts that key's rows into one task. Here the rows are range-partitioned by
(key, order), so a key that holds a third of all rows spreads over a third of the partitions; each
partition counts its rows per key, prefix sums of these counts (one row per key and partition it
spans) are the offsets, and rank = offset + place within the partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyloom.session import cut, shuffle_parts

_LOW = (1 << 33) - 1


def sorted_slices(df: DataFrame, keys: list[str], order: list[str], parts: int | None) -> tuple[DataFrame, DataFrame]:
    """``df`` sorted over ``parts`` slices by (keys, order), with ``__part`` and the place ``__at`` in it, cut once; and the same grouped by slice and key."""
    n = parts or shuffle_parts(df.sparkSession)
    cols = [F.col(f"`{c}`") for c in (*keys, *order)]
    rows = df.repartitionByRange(n, *cols).sortWithinPartitions(*cols).withColumn("__at", F.monotonically_increasing_id())
    rows = cut(rows.withColumn("__part", F.shiftright("__at", 33)).withColumn("__at", F.col("__at").bitwiseAND(F.lit(_LOW))))
    return rows, rows.groupBy("__part", *keys)


def distributed_rank(df: DataFrame, keys: list[str], order: list[str], name: str = "rank", parts: int | None = None) -> DataFrame:
    """``df`` with a 1-based ``name``: the place of each row within its ``keys`` by ``order``.

    ``order`` must be total within a key for a deterministic rank; null keys form one group,
    nulls in the order come first. The rows are cut to the shared folder once (range bounds are
    then fixed, whatever executors are lost later).
    """
    rows, grouped = sorted_slices(df, keys, order, parts)
    counts = grouped.agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    offsets = offsets.select("__part", *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__first", "__before")
    same: Column = rows["__part"] == offsets["__part"]
    for i, k in enumerate(keys):
        same = same & rows[k].eqNullSafe(offsets[f"__k{i}"])
    joined = rows.join(offsets, same, "left")
    return joined.select(*[rows[c] for c in df.columns], (rows["__at"] - F.col("__first") + F.col("__before") + 1).alias(name))


def distributed_last(df: DataFrame, keys: list[str], order: list[str], column: str, name: str, parts: int | None = None) -> DataFrame:
    """``df`` with ``name``: the last non-null ``column`` up to each row, within ``keys`` by ``order``.

    Within a slice by a window over (slice, key); what earlier slices carry in comes from one row
    per key and slice.
    """
    rows, grouped = sorted_slices(df, keys, order, parts)
    ends = grouped.agg(F.max_by(column, F.when(F.col(column).isNotNull(), F.col("__at"))).alias("__end"))
    before = W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(F.col("__part").alias("__p"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.last("__end", ignorenulls=True).over(before).alias("__in"))
    inside = W.partitionBy("__part", *keys).orderBy("__at").rowsBetween(W.unboundedPreceding, 0)
    run = rows.withColumn("__last", F.last(column, ignorenulls=True).over(inside))
    same: Column = run["__part"] == carried["__p"]
    for i, k in enumerate(keys):
        same = same & run[k].eqNullSafe(carried[f"__k{i}"])
    return run.join(carried, same, "left").select(*[run[c] for c in df.columns], F.coalesce("__last", "__in").alias(name))


def previous(df: DataFrame, keys: list[str], order: list[str], columns: list[str], prefix: str = "before_", parts: int | None = None) -> DataFrame:
    """``df`` with ``rank`` and the ``columns`` of the row before (null for the first), within ``keys`` by ``order``: ranks, then one join on key and rank."""
    ranked = cut(distributed_rank(df, keys, order, "rank", parts))
    b = ranked.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], (F.col("rank") + 1).alias("__next"), *[F.col(c).alias(f"{prefix}{c}") for c in columns])
    same: Column = ranked["rank"] == b["__next"]
    for i, k in enumerate(keys):
        same = same & ranked[k].eqNullSafe(b[f"__k{i}"])
    return ranked.join(b, same, "left").select(*[ranked[c] for c in ranked.columns], *[b[f"{prefix}{c}"] for c in columns])
