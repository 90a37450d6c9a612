"""The finding pipeline: normalising, filtering, de-duplicating and summing up findings."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.set_pairs import representative_pairs
from tallyloom.operators.ranking import distributed_rank
from tallyloom.session import cut

SEVERITIES = ("error", "warning", "note")
CATEGORIES = ("security", "correctness", "reliability", "performance", "maintainability", "style", "vulnerability")
#: Severity by rule prefix, in the order in which the prefixes are tried (so ANN meets A first).
RULE_PREFIXES = (("E", "error"), ("F", "error"), ("W", "warning"), ("C", "warning"), ("N", "note"), ("D", "note"), ("I", "note"), ("UP", "note"), ("B", "warning"), ("S", "error"), ("T", "warning"), ("A", "warning"), ("ANN", "note"), ("RUF", "warning"))
#: Severities of tools in their own words.
TOOL_SEVERITIES = {
    "bandit": {"high": "error", "medium": "warning", "low": "note", "undefined": "note"},
    "semgrep": {"error": "error", "warning": "warning", "info": "note", "inventory": "note", "experiment": "note"},
    "trivy": {"critical": "error", "high": "error", "medium": "warning", "low": "note", "unknown": "note"},
    "mypy": {"error": "error", "warning": "warning", "note": "note"},
}


def norm_severity(col: Column) -> Column:
    """error, warning or note; anything else, null too, is a note."""
    v = F.lower(F.trim(col))
    return F.when(v.isin(*SEVERITIES), v).otherwise(F.lit("note"))


def norm_category(col: Column) -> Column:
    """One of seven categories; anything else is maintainability."""
    v = F.lower(F.trim(col))
    return F.when(v.isin(*CATEGORIES), v).otherwise(F.lit("maintainability"))


def by_prefix(col: Column, prefixes: tuple[tuple[str, str], ...] = RULE_PREFIXES, default: str = "note") -> Column:
    """Value of the first prefix, in the given order, with which a code starts."""
    out = F.lit(default)
    for p, v in reversed(prefixes):
        out = F.when(col.startswith(p), F.lit(v)).otherwise(out)
    return out


def tool_severity(tool: Column, severity: Column, default: str = "warning") -> Column:
    """Severity of a tool's own word for it, by nested literal maps (no join)."""
    out: Column = F.lit(None).cast("string")
    for name, words in TOOL_SEVERITIES.items():
        table = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
        out = F.when(F.lower(tool) == name, F.try_element_at(table, F.lower(F.trim(severity)))).otherwise(out)
    return F.coalesce(out, F.lit(default))


def confident(findings: DataFrame, least: float = 0.6) -> DataFrame:
    """Findings of at least the given confidence that aren't marked invalid; a missing confidence counts as 0.5, a missing ``is_valid`` (value or column) as true."""
    valid = F.coalesce("is_valid", F.lit(True)) if "is_valid" in findings.columns else F.lit(True)
    return findings.filter(valid & (F.coalesce("confidence", F.lit(0.5)) >= least))


def postable(findings: DataFrame) -> DataFrame:
    """Errors and warnings with a file and a line."""
    return findings.filter(F.col("severity").isin("error", "warning") & F.col("file_path").isNotNull() & (F.coalesce("line_start", F.lit(0)) != 0))


def word_overlap(a: Column, b: Column) -> Column:
    """Shared words over all words of two texts, by white space and in lower case; 0 where either has none."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: F.length(w) > 0))
    x, y = words(a), words(b)
    both, either = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), both / either).otherwise(F.lit(0.0))


def _settled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids kept by the greedy rule over (id, c) nodes and (id_a, id_b) edges, in parallel rounds.

    In each round those that have no undecided better neighbour are kept and their neighbours
    dropped; this gives what taking them one by one gives.
    """
    a = nodes.select(F.col("id").alias("id_a"), F.col("c").alias("ca"))
    b = nodes.select(F.col("id").alias("id_b"), F.col("c").alias("cb"))
    both = edges.join(a, "id_a").join(b, "id_b")
    first = F.struct(F.col("ca").alias("c"), F.col("id_a").alias("id")) < F.struct(F.col("cb").alias("c"), F.col("id_b").alias("id"))
    links = cut(both.select(F.when(first, F.col("id_a")).otherwise(F.col("id_b")).alias("better"), F.when(first, F.col("id_b")).otherwise(F.col("id_a")).alias("worse")))
    open_ = cut(nodes.select("id"))
    kept: DataFrame | None = None
    while True:  # each round decides at least the best of those left
        free = cut(open_.join(links, F.col("id") == F.col("worse"), "left_anti"))
        kept = free if kept is None else kept.unionByName(free)
        hit = links.join(free, F.col("better") == F.col("id"), "left_semi").select(F.col("worse").alias("hit")).distinct()
        gone = cut(hit.unionByName(free.select(F.col("id").alias("hit"))))
        open_ = cut(open_.join(gone, F.col("id") == F.col("hit"), "left_anti"))
        if not open_.limit(1).count():
            break
        links = cut(links.join(gone, F.col("better") == F.col("hit"), "left_anti").join(gone, F.col("worse") == F.col("hit"), "left_anti"))
    return kept


def greedy_dedup(findings: DataFrame, threshold: float = 0.5, heavy: int = 500) -> DataFrame:
    """Findings kept when taken by falling confidence: one is dropped if it shares more than ``threshold`` of its words with one kept before at the same file and line.

    Order-dependent, so each place is folded in the JVM over its sorted array. Equal texts of a
    place are reduced to the first of them before (the others would be dropped by it anyway). A
    place of more than ``heavy`` different texts isn't gathered: its pairs come from the
    similarity join and the rule is settled in parallel rounds. Rows without words are all kept.
    """
    text = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("message", F.lit(""))), r"\s+"), lambda w: F.length(w) > 0))
    f = findings.select("id", "file_path", "line_start", F.array_sort(text).alias("__w"), (-F.coalesce("confidence", F.lit(0.0))).alias("__c"))
    blank = f.filter(F.size("__w") == 0).select(F.col("id").alias("kept_id"))
    place = F.concat_ws("\x01", F.coalesce("file_path", F.lit("\0")), F.coalesce("line_start", F.lit(-1)).cast("string"))
    firsts = f.filter(F.size("__w") > 0).groupBy("file_path", "line_start", "__w").agg(F.min(F.struct("__c", "id")).alias("k"))
    firsts = firsts.select(place.alias("place"), F.col("k.__c").alias("c"), F.col("k.id").alias("id"), F.col("__w").alias("w"))
    large = cut(firsts.groupBy("place").count().filter(F.col("count") > heavy).select(F.col("place").alias("large")))
    any_large = large.limit(1).count() > 0
    small = firsts.join(large, F.col("place") == F.col("large"), "left_anti") if any_large else firsts
    places = small.groupBy("place").agg(F.array_sort(F.collect_list(F.struct("c", "id", "w"))).alias("rows"))

    def step(kept: Column, x: Column) -> Column:
        alike = F.exists(kept, lambda y: F.size(F.array_intersect(y["w"], x["w"])) > threshold * F.size(F.array_union(y["w"], x["w"])))
        return F.when(alike, kept).otherwise(F.concat(kept, F.array(x)))

    kept = places.select(F.explode(F.transform(F.aggregate("rows", F.slice("rows", 1, 0), step), lambda x: x["id"])).alias("kept_id"))
    if any_large:
        rest = cut(firsts.join(large, F.col("place") == F.col("large"), "left_semi"))
        hashed = F.array_join(F.transform("w", lambda x: F.concat(F.lit("h"), F.md5(x))), " ")
        one = rest.select(F.col("place").alias("path"), F.lit(0).alias("cell"), F.lit(1).alias("border"), "id", F.lit(0).alias("line"), hashed.alias("text"))
        pairs, members = representative_pairs(one, 0, threshold + 1e-7, 4 * heavy)
        members = cut(members)
        a, b = (members.select(F.col("rep").alias(f"__{x}"), F.col("id").alias(f"id_{x}")) for x in "ab")
        edges = pairs.join(a, F.col("rep_a") == F.col("__a")).join(b, F.col("rep_b") == F.col("__b")).select("id_a", "id_b")
        kept = kept.unionByName(_settled(rest.select("id", "c"), edges).select(F.col("id").alias("kept_id")))
    return findings.join(kept.unionByName(blank), F.col("id") == F.col("kept_id"), "left_semi")


def override(findings: DataFrame, corrections: DataFrame, columns: list[str]) -> DataFrame:
    """Corrected values by finding id, where they are given and not blank; others stay."""
    c = corrections.select(F.col("id").alias("__id"), *[F.col(x).alias(f"__{x}") for x in columns])
    j = findings.join(c, F.col("id") == F.col("__id"), "left")
    new = {x: F.coalesce(F.when(F.col(f"__{x}").cast("string") != "", F.col(f"__{x}")), F.col(x)) for x in columns}
    return j.withColumns(new).select(*findings.columns)


def unposted(new: DataFrame, old: DataFrame, prefix: int = 50) -> DataFrame:
    """New comments (path, line, body) that no old one at the same path and line already contains, by their first characters: an anti join with equal keys."""
    o = old.select(F.col("path").alias("__p"), F.col("line").alias("__l"), F.col("body").alias("__b"))
    said = (F.col("path") == F.col("__p")) & (F.col("line") == F.col("__l")) & F.contains(F.col("__b"), F.substring("body", 1, prefix))
    return new.join(o, said, "left_anti")


def by_suffix(findings: DataFrame, files: DataFrame, contains: bool = False) -> DataFrame:
    """Findings joined with changed files (name) of which their path is a suffix, by whole components.

    Each path has few suffixes: both sides meet on an equal key, so no nested loop is needed. With
    ``contains`` any part of the path counts (for files of few names only).
    """
    if contains:
        return findings.join(files, F.contains(F.col("file_path"), F.col("name")) | F.contains(F.col("name"), F.col("file_path")))
    parts = F.split("file_path", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts) - k + 1), "/"))
    return findings.filter("file_path is not null").withColumn("__tail", F.explode(tails)).join(files, F.col("__tail") == F.col("name")).drop("__tail")


def tool_lines(findings: DataFrame) -> DataFrame:
    """One summary line per tool."""
    n = findings.groupBy(F.col("tool_source").alias("tool")).agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "error").alias("e"))
    return n.select("tool", F.format_string("%s: %d findings (%d errors)", F.col("tool"), F.col("n"), F.col("e")).alias("line"))


def ordered_text(df: DataFrame, keys: list[str], order: list[Column], text: Column, sep: str = "\n", name: str = "text") -> DataFrame:
    """Texts of each group joined in ``order``."""
    rows = F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)], text.alias("t"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r["t"]), sep).alias(name))


def totals(results: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Per key: tokens, cost of successful stages, seconds, and the last non-empty model in ``order``."""
    exact = lambda c: F.col(c).cast("decimal(30,12)")  # noqa: E731  # the same sum in any order
    named = F.when(F.length(F.coalesce("model", F.lit(""))) > 0, order)
    return results.groupBy(*keys).agg(
        F.sum("tokens_input").alias("tokens_in"), F.sum("tokens_output").alias("tokens_out"),
        F.round(F.coalesce(F.sum(F.when(F.col("success"), exact("cost_estimate"))).cast("double"), F.lit(0.0)), 6).alias("cost"),
        F.round(F.sum(exact("latency_seconds")).cast("double"), 6).alias("seconds"), F.max_by("model", named).alias("last_model"),
    )


def aliased(raw: DataFrame, fields: Mapping[str, tuple[list[str], object]]) -> DataFrame:
    """Columns by the first of their names that is present and not null, else a default."""
    have = set(raw.columns)
    pick = [F.coalesce(*[F.col(n) for n in names if n in have], F.lit(default)).alias(out) for out, (names, default) in fields.items()]
    return raw.select(*pick)


def zipped(left: DataFrame, right: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of two tables paired by their place within ``keys``; both have the same ``order`` columns, the right one's other columns come along."""
    a = distributed_rank(left, keys, order, "__place")
    b = distributed_rank(right, keys, order, "__other").select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__other", *[c for c in right.columns if c not in keys and c not in left.columns])
    same: Column = a["__place"] == b["__other"]
    for i, k in enumerate(keys):
        same = same & a[k].eqNullSafe(b[f"__k{i}"])
    drop = [f"__k{i}" for i in range(len(keys))]
    return a.join(b, same).drop("__place", "__other", *drop)
