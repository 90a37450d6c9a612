"""Text cut into chunks of lines, and unified diffs read line by line. All JVM-side arrays and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: How a top-level function or class begins, by language.
BOUNDARIES = {
    "javascript": r"^(?:export\s+)?(?:async\s+)?(?:function\s+\w+|const\s+\w+\s*=\s*(?:async\s+)?\()",
    "typescript": r"^(?:export\s+)?(?:async\s+)?(?:function\s+\w+|const\s+\w+\s*=\s*(?:async\s+)?\(|class\s+\w+)",
    "java": r"^\s*(?:public|private|protected|static|final|abstract|\s)+\s+\w[\w<>\[\]]*\s+\w+\s*\(",
    "go": r"^func\s+",
    "rust": r"^(?:pub\s+)?(?:async\s+)?fn\s+",
    "c": r"^\w[\w\s\*]+\w\s*\([^;{]*\)\s*\{",
    "cpp": r"^\w[\w\s\*:~<>]+\w\s*\([^;]*\)\s*\{?",
}


def lines_of(text: Column) -> Column:
    """Lines of a text as an array, any line ends; an end of line at the very end starts no further line."""
    return F.split(F.regexp_replace(text, r"(\r\n|\r|\n)\z", ""), r"\r\n|\r|\n")


def _windows(lines: Column, size: int, step: int, early_stop: bool, base: Column) -> Column:
    """Array of structs (start_line, end_line, content) of windows over an array of lines; none if all are blank."""
    n = F.size(lines)
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step))
    if early_stop:  # the first window that reaches the end is the last
        starts = F.filter(starts, lambda s: (s == 0) | (s - step + size < n))
    made = F.transform(starts, lambda s: F.struct((s + base).alias("start_line"), (F.least(s + size, n) + base - 1).alias("end_line"), F.array_join(F.slice(lines, s + 1, size), "\n").alias("content")))
    return F.when(F.exists(lines, lambda x: F.length(F.trim(x)) > 0), made).otherwise(F.slice(made, 1, 0))


def sliding_chunks(df: DataFrame, text: str, size: int = 80, overlap: int | None = None) -> DataFrame:
    """Windows of ``size`` lines with step ``size - size // 40``, ending with the first that reaches the end; blank texts give none."""
    step = size - (size // 40 if overlap is None else overlap)
    return df.withColumn("chunk", F.explode(_windows(lines_of(F.col(text)), size, max(1, step), True, F.lit(1)))).select(*df.columns, "chunk.*")


def split_chunks(df: DataFrame, text: str, size: int = 80, overlap: int = 16, base: Column | None = None) -> DataFrame:
    """Windows of ``size`` lines that overlap by ``overlap``, up to the last line: the last may only repeat a suffix."""
    return df.withColumn("chunk", F.explode(_windows(lines_of(F.col(text)), size, size - overlap, False, F.lit(1) if base is None else base))).select(*df.columns, "chunk.*")


def boundary_chunks(df: DataFrame, key: str, text: str, language: str, size: int = 80, overlap: int = 16) -> DataFrame:
    """(key, start_line, end_line, content): texts split where a function or class begins, long parts into windows.

    The segments are folded within each row (no explode and regroup): line numbers at which a
    boundary pattern matches, then a slice between neighbours; a text without a boundary is one
    segment. Texts of other languages fall back to sliding windows.
    """
    lines = lines_of(F.col(text))
    pattern: Column = F.lit(None).cast("string")
    for name, p in BOUNDARIES.items():
        pattern = F.when(F.lower(language) == name, F.lit(p)).otherwise(pattern)
    d = df.select(F.col(key).alias(key), F.col(text).alias("__t"), lines.alias("__l"), pattern.alias("__p"))
    at = F.filter(F.transform(F.sequence(F.lit(0), F.size("__l") - 1), lambda k: F.when((k == 0) | F.regexp_like(F.element_at("__l", k + 1), F.col("__p")), k)), lambda k: k.isNotNull())
    d = d.withColumn("__b", F.when(F.col("__p").isNotNull(), at))
    cut = d.filter(F.size("__b") > 0)
    edges = F.concat(F.col("__b"), F.array(F.size("__l")))
    parts = F.transform(F.sequence(F.lit(1), F.size("__b")), lambda k: F.struct((F.element_at(edges, k) + 1).alias("base"), F.slice(F.col("__l"), F.element_at(edges, k) + 1, F.element_at(edges, k + 1) - F.element_at(edges, k)).alias("seg")))
    segs = cut.select(key, F.explode(parts).alias("s")).select(key, F.explode(_windows(F.col("s.seg"), size, size - overlap, False, F.col("s.base"))).alias("chunk"))
    long = segs.select(key, "chunk.start_line", "chunk.end_line", "chunk.content")
    other = sliding_chunks(d.filter(F.coalesce(F.size("__b"), F.lit(0)) < 1).select(key, "__t"), "__t", size).select(key, "start_line", "end_line", "content")
    return long.unionByName(other)


def diff_lines(df: DataFrame, keys: list[str], patch: str) -> DataFrame:
    """(keys, line, kind, text): the lines of unified diffs with their number in the new file.

    A hunk header sets the counter; added and context lines count, removed ones, file headers and
    the no-newline mark don't. ``kind`` is ``+`` or a space. ``keys`` must tell the patches apart.
    Running sums over the lines of one patch: one sort serves all of them.
    """
    ln = F.col("__ln")
    rows = df.select(*keys, F.posexplode(F.split(F.col(patch), r"\r?\n")).alias("__pos", "__ln"))
    head = F.regexp_extract(ln, r"^@@ -\d+(?:,\d+)? \+(\d+)", 1)
    mark = (head != "") | ln.rlike(r"^(?:--- |\+\+\+ |diff --git |index [0-9a-f]+\.\.)")
    gone = ln.startswith("\\") | ln.startswith("-")
    rows = rows.withColumns({"__head": F.when(head != "", head.try_cast("int")), "__mark": mark, "__n": F.when(mark | gone, 0).otherwise(1)})
    w = W.partitionBy(*keys).orderBy("__pos")
    before = F.coalesce(F.sum("__n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({"__before": before, "__start": F.last("__head", ignorenulls=True).over(upto)})
    rows = rows.withColumn("__at", F.last(F.when(F.col("__head").isNotNull(), F.col("__before")), ignorenulls=True).over(upto))
    kept = rows.filter((F.col("__n") == 1) & F.col("__start").isNotNull())
    return kept.select(*keys, (F.col("__start") + F.col("__before") - F.col("__at")).cast("int").alias("line"), F.when(ln.startswith("+"), "+").otherwise(" ").alias("kind"), F.expr("substring(__ln, 2)").alias("text"))


def diff_counts(patch: Column) -> tuple[Column, Column]:
    """Added and removed lines of a unified diff."""
    lines = F.split(patch, r"\r?\n")
    plus = F.size(F.filter(lines, lambda x: x.startswith("+") & ~x.startswith("+++")))
    minus = F.size(F.filter(lines, lambda x: x.startswith("-") & ~x.startswith("---")))
    return plus, minus


def split_diff(patch: Column) -> Column:
    """The files of a diff of several files, as an array of texts."""
    return F.filter(F.split(patch, r"(?m)(?=^--- a/|^diff --git )"), lambda x: F.length(F.trim(x)) > 0)


def valid_lines(findings: DataFrame, added: DataFrame, keys: list[str]) -> DataFrame:
    """Findings on lines that a diff adds: a semi join on file and line."""
    a = added.filter("kind = '+'").select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("line").alias("__line"))
    cond = F.col("line_start") == F.col("__line")
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"__{k}"))
    return findings.join(a, cond, "left_semi")
