"""Output of linters and scanners, one raw text per run, as rows of one shape.

Columns: (run, file_path, line, column, severity, rule_id, message, tool, fix_suggestion). JSON is
read with explicit schemas or as VARIANT, all JVM-side; output that doesn't parse gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.findings import by_prefix, tool_severity

COLUMNS = ("run", "file_path", "line", "column", "severity", "rule_id", "message", "tool", "fix_suggestion")


def _shape(df: DataFrame, tool: str, **cols: Column) -> DataFrame:
    kinds = {"line": "int", "column": "int"}
    null = F.lit(None)
    return df.select("run", *[(F.lit(tool) if c == "tool" else cols.get(c, null).cast(kinds.get(c, "string"))).alias(c) for c in COLUMNS[1:]])


def _get(v: str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col(v), path, kind)


def _items(df: DataFrame, path: str, name: str) -> DataFrame:
    """One row per element of an array in the VARIANT ``v``."""
    source = F.col("v") if path == "$" else F.try_variant_get("v", path, "variant")
    return df.select("run", F.explode(F.try_variant_get(source, "$", "array<variant>")).alias(name))


def _parsed(raw: DataFrame) -> DataFrame:
    return raw.select("run", F.try_parse_json("output").alias("v")).filter("v is not null")


def ruff(raw: DataFrame) -> DataFrame:
    """A JSON array of findings; severity by the rule's prefix."""
    f = _items(_parsed(raw), "$", "f")
    code = F.coalesce(F.nullif(_get("f", "$.code"), F.lit("")), _get("f", "$.rule_id"), F.lit(""))
    line = F.coalesce(_get("f", "$.location.row", "int"), _get("f", "$.location.line", "int"), _get("f", "$.start.line", "int"), F.lit(0))
    column = F.coalesce(_get("f", "$.location.column", "int"), _get("f", "$.location.col", "int"))
    return _shape(f, "ruff", file_path=F.coalesce(_get("f", "$.filename"), F.lit("")), line=line, column=column, severity=by_prefix(code), rule_id=code, message=F.coalesce(_get("f", "$.message"), F.lit("")), fix_suggestion=_get("f", "$.fix.message"))


def bandit(raw: DataFrame) -> DataFrame:
    f = _items(_parsed(raw), "$.results", "f")
    return _shape(f, "bandit", file_path=_get("f", "$.filename"), line=_get("f", "$.line_number", "int"), severity=tool_severity(F.lit("bandit"), _get("f", "$.issue_severity"), "note"), rule_id=_get("f", "$.test_id"), message=_get("f", "$.issue_text"))


def mypy(raw: DataFrame) -> DataFrame:
    """One finding per line, each as JSON or as ``file:line: severity: message``."""
    lines = raw.select("run", F.explode(F.split("output", r"\r?\n")).alias("t")).filter(F.length(F.trim("t")) > 0).withColumn("f", F.try_parse_json("t"))
    js = lines.filter("f is not null and try_variant_get(f, '$.file', 'string') is not null")
    first = _shape(js, "mypy", file_path=_get("f", "$.file"), line=_get("f", "$.line", "int"), column=_get("f", "$.column", "int"), severity=tool_severity(F.lit("mypy"), _get("f", "$.severity"), "error"), rule_id=_get("f", "$.code"), message=_get("f", "$.message"))
    form = r"^(.+?):(\d+)(?::(\d+))?: (error|warning|note): (.*?)(?:\s+\[([\w-]+)\])?$"
    tx = lines.filter(F.col("f").isNull() & F.col("t").rlike(form))
    part = lambda k: F.nullif(F.regexp_extract("t", form, k), F.lit(""))
    second = _shape(tx, "mypy", file_path=part(1), line=part(2).try_cast("int"), column=part(3).try_cast("int"), severity=part(4), rule_id=part(6), message=part(5))
    return first.unionByName(second)


def semgrep(raw: DataFrame) -> DataFrame:
    f = _items(_parsed(raw), "$.results", "f")
    return _shape(f, "semgrep", file_path=_get("f", "$.path"), line=_get("f", "$.start.line", "int"), column=_get("f", "$.start.col", "int"), severity=tool_severity(F.lit("semgrep"), _get("f", "$.extra.severity"), "note"), rule_id=_get("f", "$.check_id"), message=_get("f", "$.extra.message"), fix_suggestion=_get("f", "$.extra.fix"))


def pip_audit(raw: DataFrame) -> DataFrame:
    """Two levels: dependencies, and the vulnerabilities of each."""
    d = _items(_parsed(raw), "$.dependencies", "d")
    f = d.select("run", "d", F.explode(F.try_variant_get("d", "$.vulns", "array<variant>")).alias("f"))
    fixes = F.try_variant_get("f", "$.fix_versions", "array<string>")
    message = F.concat(F.coalesce(_get("d", "$.name"), F.lit("unknown")), F.lit("=="), F.coalesce(_get("d", "$.version"), F.lit("?")), F.lit(" has known vulnerability: "), F.substring(F.coalesce(_get("f", "$.description"), F.lit("")), 1, 200))
    return _shape(f, "pip-audit", file_path=F.lit("requirements.txt"), line=F.lit(0), severity=F.lit("error"), rule_id=_get("f", "$.id"), message=message, fix_suggestion=F.when(F.size(fixes) > 0, F.concat(F.lit("Upgrade to "), F.array_join(fixes, ", "))).otherwise(F.lit("No fix version available")))


def trivy(raw: DataFrame) -> DataFrame:
    """Two levels: targets, and the vulnerabilities of each."""
    d = _items(_parsed(raw), "$.Results", "d")
    f = d.select("run", "d", F.explode(F.try_variant_get("d", "$.Vulnerabilities", "array<variant>")).alias("f"))
    fixed = F.nullif(_get("f", "$.FixedVersion"), F.lit(""))
    message = F.concat(F.coalesce(_get("f", "$.PkgName"), F.lit("?")), F.lit("=="), F.coalesce(_get("f", "$.InstalledVersion"), F.lit("?")), F.lit(" — "), F.substring(F.coalesce(_get("f", "$.Description"), F.lit("")), 1, 200))
    return _shape(f, "trivy", file_path=F.coalesce(_get("d", "$.Target"), F.lit("unknown")), line=F.lit(0), severity=tool_severity(F.lit("trivy"), _get("f", "$.Severity"), "note"), rule_id=_get("f", "$.VulnerabilityID"), message=message, fix_suggestion=F.when(fixed.isNotNull(), F.concat(F.lit("Upgrade to "), fixed)))


PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {"ruff": ruff, "bandit": bandit, "mypy": mypy, "semgrep": semgrep, "pip-audit": pip_audit, "trivy": trivy}
#: Tools by language.
TOOLS_OF = {"python": ("ruff", "bandit", "mypy", "semgrep", "pip-audit"), "javascript": ("semgrep", "trivy"), "typescript": ("semgrep", "trivy"), "java": ("semgrep", "trivy"), "go": ("semgrep", "trivy")}


def parse_outputs(raw: DataFrame, tools: list[str] | None = None) -> DataFrame:
    """Findings of raw runs (run, tool, output) of all tools (or of some), in one table."""
    chosen = [t for t in PARSERS if tools is None or t in tools]
    return reduce(DataFrame.unionByName, [PARSERS[t](raw.filter(F.lower("tool") == t)) for t in chosen])
