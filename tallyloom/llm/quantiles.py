"""Percentiles of very large numeric columns per group, exact and combinable.

Two steps. ``daily_counts`` reduces each day's rows to (group, metric, value, count); such tables
of separate days, partitions or runs are combined by adding counts (``combine``), in any order and
grouping, which is exact. ``percentiles`` sorts the combined values across the cluster, keeps
per-partition counts, turns them into offsets per group, locates the slices that hold the target
positions, counts on only within these, and
interpolates the neighbouring order statistics linearly: position q * (n - 1), 0-based.

Error bound: 0 in rank and value (IEEE rounding of the one interpolation apart). With
``relative_error`` e > 0 the intermediates hold one value per bin of ratio (1+e)/(1-e), so their
size no longer depends on the number of rows, and each order statistic is within e of the true
one, relatively.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.operators.ranking import sorted_slices
from tallyloom.session import cut

#: Targets (groups x metrics x quantiles) up to this number are broadcast, some 60 bytes each.
BROADCAST_TARGETS = 200_000
QUANTILES = (0.5, 0.9, 0.95, 0.99)


def _usable(v: Column) -> Column:
    """A measured value: not null, NaN, infinite or negative."""
    return v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < F.lit(float("inf")))


def daily_counts(df: DataFrame, group: Column, day: Column, metrics: dict[str, Column], relative_error: float = 0.0) -> DataFrame:
    """(day, grp, metric, value, n) of every usable value; unusable ones (null, NaN, infinite, negative) aren't counted.

    One scan; the counts are combined on the map side before the shuffle. A null group or day is a
    group of its own. An empty table gives an empty one. Rows count as given: reduce rows that were
    delivered twice before (``tables.latest_by_id``). Only the given columns are read, so others may
    have any names.
    """
    if not 0 <= relative_error < 1:
        raise ValueError("relative_error must be in [0, 1)")
    long = df.select(day.alias("day"), group.alias("grp"), F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in metrics.items()])).alias("m"))
    long = long.select("day", "grp", "m.metric", "m.value").filter(_usable(F.col("value")))
    if relative_error:
        step = math.log((1 + relative_error) / (1 - relative_error))
        mid = F.exp(F.round(F.log(F.col("value")) / step) * step)
        long = long.withColumn("value", F.when(F.col("value") > 0, mid).otherwise(F.lit(0.0)))
    return long.groupBy("day", "grp", "metric", "value").agg(F.count("*").alias("n"))


def combine(*parts: DataFrame) -> DataFrame:
    """One table of counts from any number of them (days, partitions, runs)."""
    rows = reduce(DataFrame.unionByName, [p.select("grp", "metric", "value", "n") for p in parts])
    return rows.groupBy("grp", "metric", "value").agg(F.sum("n").alias("n"))


def percentiles(counts: DataFrame, quantiles: tuple[float, ...] = QUANTILES, parts: int | None = None) -> DataFrame:
    """(grp, metric, n, pXX...) from combined counts (grp, metric, value, n).

    A group without usable values has no row. Ties share one counted row, so a value that holds a
    third of all rows weighs as one.
    """
    keys = ["grp", "metric"]
    rows, grouped = sorted_slices(counts, keys, ["value"], parts)
    per = cut(grouped.agg(F.sum("n").alias("w")))  # one row per group and partition it spans
    before = F.coalesce(F.sum("w").over(W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    totals = per.groupBy(F.col("grp").alias("tg"), F.col("metric").alias("tm")).agg(F.sum("w").alias("total"))
    wanted = totals.select("tg", "tm", "total", F.posexplode(F.array(*[F.lit(float(q)) for q in quantiles])).alias("qi", "q")).withColumn("at", F.col("q") * (F.col("total") - 1))
    at_hand = per.select("__part", *keys, "w", before.alias("before"))
    slices = at_hand.join(wanted, F.col("grp").eqNullSafe(F.col("tg")) & (F.col("metric") == F.col("tm")) & (F.col("before") <= F.ceil("at")) & (F.col("before") + F.col("w") - 1 >= F.floor("at")))
    slices = cut(slices.select(F.col("__part").alias("sp"), "tg", "tm", "before", "total", "qi", "at"))  # two rows per group, metric and quantile at most
    small = slices.limit(BROADCAST_TARGETS + 1).count() <= BROADCAST_TARGETS
    mark = F.broadcast if small else (lambda x: x)
    same = (F.col("__part") == F.col("sp")) & F.col("grp").eqNullSafe(F.col("tg")) & (F.col("metric") == F.col("tm"))
    # Only the slices that hold a target are read on; each is one partition's part of a group.
    chosen = rows.join(mark(slices.select("sp", "tg", "tm", "before").distinct()), same).drop("sp", "tg", "tm")
    run = F.sum("n").over(W.partitionBy("__part", *keys).orderBy("__at").rowsBetween(W.unboundedPreceding, 0))
    places = chosen.withColumn("last", F.col("before") + run - 1).withColumn("first", F.col("last") - F.col("n") + 1).drop("before")
    # At most two rows per group, metric and quantile pass this join.
    hit = places.alias("p").join(mark(slices).alias("w"), same & (F.col("p.first") <= F.ceil("w.at")) & (F.col("p.last") >= F.floor("w.at")))
    lo = F.max(F.when((F.col("p.first") <= F.floor("w.at")) & (F.col("p.last") >= F.floor("w.at")), F.col("p.value")))
    hi = F.max(F.when((F.col("p.first") <= F.ceil("w.at")) & (F.col("p.last") >= F.ceil("w.at")), F.col("p.value")))
    at = hit.groupBy(F.col("w.tg").alias("grp"), F.col("w.tm").alias("metric"), F.col("w.total").alias("n"), F.col("w.qi").alias("qi"), F.col("w.at").alias("at")).agg(lo.alias("lo"), hi.alias("hi"))
    at = at.withColumn("v", F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("at") - F.floor("at")))
    named = [F.max(F.when(F.col("qi") == i, F.col("v"))).alias(f"p{100 * q:g}".replace(".", "_")) for i, q in enumerate(quantiles)]
    return at.groupBy("grp", "metric", "n").agg(*named)
