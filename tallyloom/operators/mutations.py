"""Changes to tables as new versions: insert-if-absent, upsert, conditional update, delete with cascade.

Parquet has no update in place, so each change is a DataFrame that is the next version; a
``VersionedTable`` writes it beside the old one and then moves a pointer, so a reader sees one
version or the other, never a mixture.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _same(left: DataFrame, right: DataFrame, keys: list[str], prefix: str) -> Column:
    cond: Column = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[f"{prefix}{k}"])
    return cond


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in df.columns])


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The table with the new rows whose key it lacks; existing rows stay as they are. Of new rows of one key the least (in all columns) is taken."""
    rest = [c for c in new.columns if c not in keys]
    one = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__r")).select(*keys, "__r.*") if rest else new.distinct()
    known = _prefixed(old.select(*keys).distinct(), "__")
    fresh = one.join(known, _same(one, known, keys, "__"), "left_anti")
    return old.unionByName(fresh.select(*new.columns), allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], update: list[str]) -> DataFrame:
    """The table with new rows inserted, and of existing rows only the columns in ``update`` replaced where the new value isn't null. ``new`` has unique keys."""
    n = _prefixed(new, "__n_")
    o = _prefixed(old, "__o_").withColumn("__here", F.lit(True))
    cond: Column = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"__o_{k}").eqNullSafe(F.col(f"__n_{k}"))
    j = o.join(n, cond, "full_outer")
    cols = []
    for c in old.columns:
        here, there = F.col(f"__o_{c}"), F.col(f"__n_{c}") if c in new.columns else F.lit(None)
        cols.append(F.when(F.col("__here"), F.coalesce(there, here) if c in update else here).otherwise(there).alias(c))
    return j.select(*cols)


def update_where(df: DataFrame, condition: Column, values: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """The next version, and one row with the number of rows changed (null conditions change nothing)."""
    hit = F.coalesce(condition, F.lit(False))
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()}), df.agg(F.count_if(hit).alias("n_changed"))


def delete_cascade(parent: DataFrame, condition: Column, key: str, children: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """The parent without the rows that meet ``condition``, and each child table without theirs, under the children's names and ``""``."""
    hit = F.coalesce(condition, F.lit(False))
    gone = parent.filter(hit).select(F.col(key).alias("__gone")).distinct()
    out = {"": parent.filter(~hit)}
    for name, (df, foreign) in children.items():
        out[name] = df.join(gone, F.col(foreign) == F.col("__gone"), "left_anti")
    return out


def transition(df: DataFrame, changes: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Rows with the latest non-null value of each of ``columns`` from a log of changes (key, order, columns), else their own."""
    latest = changes.groupBy(F.col(key).alias("__k")).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"__{c}") for c in columns])
    j = df.join(latest, F.col(key) == F.col("__k"), "left")
    return j.withColumns({c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in columns}).select(*df.columns)


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Missing columns added and nulls filled with the defaults of a table."""
    have = set(df.columns)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in have else F.lit(v) for c, v in defaults.items()})


def set_json_field(column: Column, field: str, value: Column) -> Column:
    """A JSON text with one top-level field set: parsed to a map of texts, other fields kept as they are."""
    m = F.coalesce(F.from_json(column, "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.to_json(F.map_concat(F.map_filter(m, lambda k, _: k != field), F.create_map(F.lit(field), value.cast("string"))))


class VersionedTable:
    """A table as numbered Parquet folders below one path; the highest complete one is current."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._of = jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[int]:
        root = self._of(self.path)
        if not self._fs.exists(root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(root)]
        return sorted(int(n[2:]) for n in names if n.startswith("v-") and n[2:].isdigit() and self._fs.exists(self._of(f"{self.path}/{n}/_SUCCESS")))

    def read(self, version: int | None = None) -> DataFrame:
        known = self.versions()
        if not known:
            raise FileNotFoundError(self.path)
        return self.spark.read.parquet(f"{self.path}/v-{(known[-1] if version is None else version):08d}")

    def write(self, df: DataFrame, keep: int = 2) -> int:
        """Write the next version (the reader's version changes when it is complete); drop those before the last ``keep``."""
        known = self.versions()
        n = (known[-1] if known else 0) + 1
        df.write.mode("overwrite").parquet(f"{self.path}/v-{n:08d}")
        for old in known[: max(0, len(known) + 1 - keep)]:
            self._fs.delete(self._of(f"{self.path}/v-{old:08d}"), True)
        return n

    def drop(self) -> None:
        self._fs.delete(self._of(self.path), True)
