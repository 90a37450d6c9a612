"""Structured Streaming: the event operators over unbounded input. Batch twins are in ``operators.events``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyloom.functions.text import hmac_sha256_hex
from tallyloom.operators.events import wire_format


def json_stream(spark: SparkSession, path: str, schema: str, **options: str) -> DataFrame:
    """JSON files that arrive in a folder, with a declared schema."""
    return spark.readStream.schema(schema).options(**options).json(path)


def signed(payloads: DataFrame, secret: bytes, body: str = "body", signature: str = "signature") -> DataFrame:
    """Payloads whose ``sha256=<hex>`` signature is right for their body; JVM-side."""
    return payloads.filter(F.coalesce(F.lower(signature) == F.concat(F.lit("sha256="), hmac_sha256_hex(secret, F.col(body))), F.lit(False)))


def debounced(events: DataFrame, key: str, time: str, seconds: int = 60, ttl_seconds: int | None = None) -> DataFrame:
    """(key, time) of accepted events: an event within ``seconds`` of the last accepted one of its key is dropped.

    State is one number per key; with ``ttl_seconds`` it is dropped after so long without events
    (processing time; such a stream has a batch per trigger even without data).
    """
    kind = events.schema[key].dataType.simpleString()

    def fn(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        out = []
        times = sorted(t for f in frames for t in f["us"].tolist())
        for t in times:
            if last is None or t - last >= seconds * 1_000_000:
                last = t
                out.append(t)
        if last is not None:
            state.update((last,))
        if ttl_seconds:
            state.setTimeoutDuration(ttl_seconds * 1000)
        yield pd.DataFrame({"key": [k[0]] * len(out), "us": out})

    e = events.select(F.col(key).alias("key"), F.unix_micros(F.col(time).cast("timestamp")).alias("us")).dropna()
    got = e.groupBy("key").applyInPandasWithState(fn, f"key {kind}, us long", "last long", "append", GroupStateTimeout.ProcessingTimeTimeout if ttl_seconds else GroupStateTimeout.NoTimeout)
    return got.select(F.col("key").alias(key), F.timestamp_micros("us").alias(time))


def changed_revisions(events: DataFrame, key: str, order: str, sha: str) -> DataFrame:
    """(key, sha) whenever the revision of a key changes; state is the last revision per key, which lasts."""
    kind = events.schema[key].dataType.simpleString()

    def fn(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        rows = sorted((o, s) for f in frames for o, s in zip(f["o"], f["sha"]) if s is not None)
        for _, s in rows:
            if s != last:
                last = s
                out.append(s)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({"key": [k[0]] * len(out), "sha": out})

    e = events.select(F.col(key).alias("key"), F.col(order).cast("string").alias("o"), F.col(sha).alias("sha")).filter("key is not null")
    got = e.groupBy("key").applyInPandasWithState(fn, f"key {kind}, sha string", "sha string", "append", GroupStateTimeout.NoTimeout)
    return got.withColumnsRenamed({"key": key, "sha": sha})


def locked(requests: DataFrame, key: str, time: str, release: Column, ttl_seconds: int = 300) -> DataFrame:
    """(key, time, granted): a request gets its key's lock if nobody holds it; a release or ``ttl_seconds`` (event time) frees it."""
    kind = requests.schema[key].dataType.simpleString()

    def fn(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        until = state.get[0] if state.exists else 0
        out = []
        for t, free in sorted((t, r) for f in frames for t, r in zip(f["us"].tolist(), f["free"].tolist())):
            if free:
                until = 0
                continue
            ok = t >= until
            if ok:
                until = t + ttl_seconds * 1_000_000
            out.append((k[0], t, ok))
        state.update((until,))
        yield pd.DataFrame(out, columns=["key", "us", "granted"])

    e = requests.select(F.col(key).alias("key"), F.unix_micros(F.col(time).cast("timestamp")).alias("us"), F.coalesce(release, F.lit(False)).alias("free")).dropna()
    got = e.groupBy("key").applyInPandasWithState(fn, f"key {kind}, us long, granted boolean", "until long", "append", GroupStateTimeout.NoTimeout)
    return got.select(F.col("key").alias(key), F.timestamp_micros("us").alias(time), "granted")


def failure_gate(outcomes: DataFrame, key: str, time: str, failed: Column, steps: tuple[int, ...] = (0, 120, 300, 900)) -> DataFrame:
    """(key, time, failures, wait_seconds) after each outcome: failures count up, a success clears them, the wait follows the table."""
    kind = outcomes.schema[key].dataType.simpleString()

    def fn(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        out = []
        for t, bad in sorted((t, b) for f in frames for t, b in zip(f["us"].tolist(), f["bad"].tolist())):
            n = n + 1 if bad else 0
            out.append((k[0], t, n, steps[min(n, len(steps) - 1)]))
        state.update((n,))
        yield pd.DataFrame(out, columns=["key", "us", "failures", "wait_seconds"])

    e = outcomes.select(F.col(key).alias("key"), F.unix_micros(F.col(time).cast("timestamp")).alias("us"), F.coalesce(failed, F.lit(False)).alias("bad")).dropna()
    got = e.groupBy("key").applyInPandasWithState(fn, f"key {kind}, us long, failures int, wait_seconds int", "n int", "append", GroupStateTimeout.NoTimeout)
    return got.select(F.col("key").alias(key), F.timestamp_micros("us").alias(time), "failures", "wait_seconds")


def open_until_terminal(events: DataFrame, key: str, time: str, type_: str, terminal: tuple[str, ...]) -> DataFrame:
    """(key, time, type) up to each key's first terminal event, that one included; later ones are dropped."""
    kind = events.schema[key].dataType.simpleString()

    def fn(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        closed = state.exists and state.get[0]
        out = []
        for t, y in sorted((t, y) for f in frames for t, y in zip(f["us"].tolist(), f["type"].tolist())):
            if closed:
                break
            out.append((k[0], t, y))
            closed = y in terminal
        state.update((bool(closed),))
        yield pd.DataFrame(out, columns=["key", "us", "type"])

    e = events.select(F.col(key).alias("key"), F.unix_micros(F.col(time).cast("timestamp")).alias("us"), F.col(type_).alias("type")).dropna()
    got = e.groupBy("key").applyInPandasWithState(fn, f"key {kind}, us long, type string", "closed boolean", "append", GroupStateTimeout.NoTimeout)
    return got.select(F.col("key").alias(key), F.timestamp_micros("us").alias(time), F.col("type").alias(type_))


def counts_per_window(events: DataFrame, time: str, by: list[str], window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts per time window and group, with late events up to ``late`` (beyond the reference: windows by event time)."""
    e = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return e.groupBy(F.window(time, window).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def frames(events: DataFrame, type_: str, fields: list[str]) -> DataFrame:
    """Server-sent-event texts of a stream."""
    return events.select(wire_format(F.col(type_), F.struct(*fields)).alias("frame"))


def to_each_batch(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, **options: str):
    """Start a stream whose batches go to ``sink(batch, number)``; a batch comes again under its number after a failure."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).options(**options).start()


def refresh_on_change(events: DataFrame, build: Callable[[DataFrame], None], checkpoint: str):
    """Rebuild something (an index) for the keys of each batch of changes; empty batches are skipped."""

    def each(batch: DataFrame, _: int) -> None:
        if batch.limit(1).count():
            build(batch)

    return to_each_batch(events, each, checkpoint)
