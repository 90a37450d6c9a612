"""Batch twins of the event streams: debounce, new revisions, terminal events, routing, wire format."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.operators.ranking import previous


def _debounce_kernel(gap_us: int):
    def kernel(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_key, last = None, 0
        for b in batches:
            keep = []
            for k, t in zip(b["part"].to_numpy(), b["us"].to_numpy()):
                ok = k != last_key or t - last >= gap_us
                if ok:
                    last_key, last = k, t
                keep.append(ok)
            yield b.loc[keep, ["id"]]

    return kernel


def debounce(events: DataFrame, key: str, time: str, id_: str, seconds: int = 60) -> DataFrame:
    """(id): events accepted when one is dropped that comes within ``seconds`` of the last accepted one of its key.

    A pause of ``seconds`` starts anew whatever came before, so a key is cut at its pauses into
    independent runs. Pauses are found on cells of that length per key (by aggregation: their
    number is bounded by time, not by events), and each run is a sorted stream with one number of
    state. Ties in time go by id; rows without key or time are left out.
    """
    us = F.unix_micros(F.col(time).cast("timestamp"))
    cell = F.floor(us / (seconds * 1_000_000)).cast("long")
    e = events.select(F.col(id_).alias("id"), F.col(key).alias("k"), us.alias("us"), cell.alias("cell")).filter("k is not null and us is not null")
    cells = e.groupBy("k", "cell").count()
    w = W.partitionBy("k").orderBy("cell")
    gap = cells.withColumn("new", (F.coalesce(F.col("cell") - F.lag("cell").over(w), F.lit(9)) > 1).cast("long"))
    runs = gap.withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0))).select("k", "cell", "run")
    j = e.join(runs, ["k", "cell"]).select("id", "us", F.concat_ws("\x01", F.col("k").cast("string"), F.col("run").cast("string")).alias("part"))
    return j.repartition("part").sortWithinPartitions("part", "us", "id").mapInPandas(_debounce_kernel(seconds * 1_000_000), f"id {events.schema[id_].dataType.simpleString()}")


def new_revisions(df: DataFrame, key: str, order: list[str], sha: str) -> DataFrame:
    """Rows whose revision differs from the one before (null-safe); the first of a key counts as new. Skew-proof: by ranks, not by a window per key."""
    d = previous(df, [key], order, [sha], "__before_")
    return d.filter((F.col("rank") == 1) | ~F.col(sha).eqNullSafe(F.col(f"__before_{sha}"))).select(*df.columns)


def unseen(rows: DataFrame, state: DataFrame, keys: list[str], sha: str) -> DataFrame:
    """Rows whose revision isn't the one that the state remembers for their key."""
    s = state.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(sha).alias("__sha"))
    cond: Column = F.lit(True)
    for k in keys:
        cond = cond & rows[k].eqNullSafe(s[f"__{k}"])
    return rows.join(s, cond & rows[sha].eqNullSafe(s["__sha"]), "left_anti")


def until_terminal(events: DataFrame, key: str, order: list[str], terminal: Column) -> DataFrame:
    """Events of each key up to its first terminal one, that one included: the first by aggregation, then one join; no window."""
    first = events.filter(terminal).groupBy(F.col(key).alias("__k")).agg(F.min(F.struct(*order)).alias("__end"))
    j = events.join(first, F.col(key) == F.col("__k"), "left")
    return j.filter(F.col("__end").isNull() | (F.struct(*order) <= F.col("__end"))).select(*events.columns)


def route(df: DataFrame, rules: list[tuple[str, Column]], default: str = "ignored", name: str = "route") -> DataFrame:
    """Each row with the name of the first rule that it meets, in order."""
    out: Column = F.lit(default)
    for label, cond in reversed(rules):
        out = F.when(F.coalesce(cond, F.lit(False)), F.lit(label)).otherwise(out)
    return df.withColumn(name, out)


def for_reader(events: DataFrame, key: str, value: object) -> DataFrame:
    """Events for one reader: those of its key, and those for everyone (null)."""
    return events.filter(F.col(key).isNull() | (F.col(key) == F.lit(value)))


def wire_format(type_: Column, data: Column, retry_ms: int | None = None) -> Column:
    """The text of a server-sent event: event name, optional retry, JSON data, blank line."""
    retry = F.lit(f"retry: {retry_ms}\n") if retry_ms is not None else F.lit("")
    return F.concat(F.lit("event: "), type_, F.lit("\n"), retry, F.lit("data: "), F.to_json(data), F.lit("\n\n"))


def backoff_left(failures: Column, elapsed: Column, steps: list[int]) -> Column:
    """Seconds still to wait after so many failures, by a table of steps whose last holds for all further ones."""
    table = F.array(*[F.lit(s) for s in steps])
    wait = F.element_at(table, F.least(failures, F.lit(len(steps) - 1)).cast("int") + 1)
    return F.greatest(F.lit(0), wait - F.floor(elapsed).cast("int"))
