"""Small stores as tables: review history as JSON lines, key-value state with expiry, response cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.mutations import VersionedTable
from tallyloom.tables import schema


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Review history from JSON lines with the declared schema; lines that don't parse are skipped.

    Where a rewrite broke off between its two renames, the history before it is read.
    """
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(of(path)) and fs.exists(of(f"{path}.before")):
        path = f"{path}.before"
    s = schema("history").add("_corrupt_record", "string")
    raw = spark.read.schema(s).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return raw.filter("_corrupt_record is null and pr_number is not null").drop("_corrupt_record")


def write_history(df: DataFrame, path: str) -> None:
    """Rewrite the history: written beside it, then two renames; a failure at any point leaves the old one or the new one readable."""
    spark = df.sparkSession
    fresh = f"{path}.next"
    df.write.mode("overwrite").json(fresh)
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    before = of(f"{path}.before")
    if fs.exists(of(path)):
        fs.delete(before, True)
        fs.rename(of(path), before)
    fs.rename(of(fresh), of(path))
    fs.delete(before, True)


class KeyValues:
    """Keyed values with expiry (key, value, at, ttl_seconds) as versions of one table; the latest write of a key counts."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.table = VersionedTable(spark, path)

    def put(self, rows: DataFrame) -> None:
        """Add writes and compact: one row per key."""
        old = self.table.read() if self.table.versions() else None
        every = rows if old is None else old.unionByName(rows)
        self.table.write(every.groupBy("key").agg(F.max(F.struct("at", "value", "ttl_seconds")).alias("r")).select("key", "r.value", "r.at", "r.ttl_seconds"))

    def get(self, now: Column) -> DataFrame:
        """(key, value) of the keys that haven't expired."""
        age = F.unix_micros(now) - F.unix_micros("at")
        return self.table.read().filter(F.col("ttl_seconds").isNull() | (age < F.col("ttl_seconds") * 1_000_000)).select("key", "value")


def cache_key(*parts: Column) -> Column:
    """SHA-256 over everything that shapes a response (null-safe, with lengths, so parts can't run together)."""
    fields = [F.concat(F.coalesce(F.length(p.cast("string")), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce(p.cast("string"), F.lit(""))) for p in parts]
    return F.sha2(F.concat_ws("|", *fields), 256)


def with_cache(requests: DataFrame, cache: DataFrame, key: str, now: Column, ttl_seconds: int = 3600) -> tuple[DataFrame, DataFrame]:
    """Requests answered by a cache (key, response, at) younger than ``ttl_seconds``, and those still to ask."""
    fresh = cache.filter((F.unix_micros(now) - F.unix_micros("at")) < ttl_seconds * 1_000_000)
    one = fresh.groupBy(F.col("key").alias("__k")).agg(F.max_by("response", "at").alias("response"))
    hit = requests.join(one, F.col(key) == F.col("__k")).drop("__k")
    return hit, requests.join(one, F.col(key) == F.col("__k"), "left_anti")
