"""Source-file scans: from folders, with pruning by path, glob, extension and size."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.text import ext

#: Folders that are never scanned.
SKIP_DIRS = ("__pycache__", ".venv", "venv", "node_modules", ".git", "dist", "build", "migrations", ".mypy_cache", ".pytest_cache", "target", ".gradle", ".next", "out")
#: Language by extension.
LANGUAGES = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".go": "go", ".rs": "rust", ".c": "c", ".cpp": "cpp", ".h": "c", ".hpp": "cpp", ".md": "markdown", ".txt": "text"}


#: Extensions of files that no review reads.
SKIP_EXTENSIONS = (".class", ".pyc", ".pyo", ".o", ".so", ".dll", ".exe", ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".svg", ".webp", ".woff", ".woff2", ".ttf", ".eot", ".zip", ".tar", ".gz", ".jar", ".war", ".lock", ".map", ".min.js", ".min.css", ".pdf", ".doc", ".docx")


def reviewable(path: Column) -> Column:
    """Whether a file is one that a review reads, by its extension."""
    return ~ext(path).isin(*SKIP_EXTENSIONS)


def language(path: Column) -> Column:
    """Language of a path by its extension, else ``unknown``."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, ext(path)), F.lit("unknown"))


def glob_regex(pattern: str) -> str:
    """A glob as a Java regular expression; a pattern that ends in ``/`` means everything below that folder."""
    if pattern.endswith("/"):
        return "(?s)^" + fnmatch.translate(pattern + "*").removeprefix("(?s:").replace(r")\z", "").replace(r")\Z", "").rstrip("$") + "$"
    return "(?s)^" + fnmatch.translate(pattern).removeprefix("(?s:").replace(r")\z", "").replace(r")\Z", "") + "$"


def skip_by_globs(df: DataFrame, path: str, patterns: list[str]) -> DataFrame:
    """Rows whose path matches none of the globs (translated once, on the driver)."""
    if not patterns:
        return df
    return df.filter(~F.col(path).rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns)))


def skip_by_parts(df: DataFrame, path: str, parts: list[str] | tuple[str, ...] = SKIP_DIRS) -> DataFrame:
    """Rows none of whose path components is in ``parts``."""
    return df.filter(~F.arrays_overlap(F.split(F.regexp_replace(path, r"\\", "/"), "/"), F.array(*[F.lit(p) for p in parts])))


def scan_folder(spark: SparkSession, root: str, extensions: tuple[str, ...] = (), max_bytes: int = 500 * 1024, skip_dirs: tuple[str, ...] = SKIP_DIRS, globs: list[str] | None = None, only: DataFrame | None = None) -> DataFrame:
    """(file_path, size_bytes, content) of the text files below ``root``.

    Read as binary files, recursively and in parallel; path and size are checked before the content
    is decoded. Files that aren't UTF-8 are dropped. ``only`` (file_path) restricts to a list.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.regexp_replace(F.col("path"), r"^.*?" + root.rstrip("/").replace(".", r"\.") + "/", "")
    f = raw.filter(F.col("length") <= max_bytes).select(base.alias("file_path"), F.col("length").alias("size_bytes"), "content")
    f = skip_by_globs(skip_by_parts(f, "file_path", skip_dirs), "file_path", globs or [])
    if extensions:
        f = f.filter(ext(F.col("file_path")).isin(*extensions))
    if only is not None:
        f = f.join(only.select(F.col("file_path").alias("__o")).distinct(), F.col("file_path") == F.col("__o"), "left_semi")
    return f.filter(F.is_valid_utf8("content")).withColumn("content", F.decode("content", "UTF-8"))
