"""Cleaning of model output: enums, lists, JSON with fallbacks, labels, diagrams. Expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clamped(col: Column, allowed: list[str] | tuple[str, ...], default: str) -> Column:
    """A value of a closed list, by trimmed lower case; anything else, null too, is the default."""
    x = F.lower(F.trim(col))
    return F.when(x.isin(*allowed), x).otherwise(F.lit(default))


def clamped_list(col: Column, allowed: list[str] | tuple[str, ...] | None = None, most: int | None = None) -> Column:
    """An array without values outside the list, at most the first ``most`` of them; null is empty."""
    x = F.coalesce(col, F.array().cast("array<string>"))
    if allowed is not None:
        x = F.filter(F.transform(x, lambda v: F.lower(F.trim(v))), lambda v: v.isin(*allowed))
    return F.slice(x, 1, most) if most is not None else x


def json_or_words(col: Column) -> Column:
    """An array of texts from a JSON list, or else from the words of the text; null or blank is empty."""
    words = F.filter(F.split(F.trim(F.coalesce(col, F.lit(""))), r"\s+"), lambda w: F.length(w) > 0)
    return F.coalesce(F.when(F.trim(col).startswith("["), F.try_variant_get(F.try_parse_json(col), "$", "array<string>")), words)


def shortened(col: Column, head: int = 14) -> Column:
    """First ``head`` characters and an ellipsis where something was cut."""
    return F.when(F.length(col) > head + 2, F.concat(F.substring(col, 1, head), F.lit("…"))).otherwise(col)


def namespaced(col: Column, sep: str = "__") -> tuple[Column, Column]:
    """The two parts of a name at the first separator; the second is null where there is none."""
    parts = F.split(col, sep, 2)
    return parts[0], F.when(F.size(parts) > 1, F.try_element_at(parts, F.lit(2)))


def url_path(col: Column) -> Column:
    """A path as one URL component (slashes too)."""
    return F.replace(F.url_encode(col), F.lit("+"), F.lit("%20"))


def constant_name(col: Column) -> Column:
    """Whether a name is written like a constant: upper case, with an underscore or longer than two."""
    return (col == F.upper(col)) & (col != F.lower(col)) & (F.contains(col, F.lit("_")) | (F.length(col) > 2))


#: How a Mermaid diagram begins.
DIAGRAMS = ("graph", "flowchart", "sequenceDiagram", "classDiagram", "stateDiagram", "erDiagram", "journey", "gantt", "pie", "mindmap", "timeline")


def diagram(col: Column) -> Column:
    """A Mermaid diagram without fences, its bare bracket labels quoted; null if it doesn't begin like one."""
    bare = F.regexp_replace(F.regexp_replace(col, r"(?m)^[ \t]*```\w*[ \t]*$", ""), r"^\s+|\s+$", "")
    quoted = F.regexp_replace(bare, r"\[(?![\"\[(/])([^\[\]\"]+)\]", r'["$1"]')
    return F.when(bare.rlike(rf"^(?:{'|'.join(DIAGRAMS)})\b"), quoted)


def text_changed(old: Column, new: Column) -> Column:
    """Whether two texts differ but for white space at their ends."""
    return ~F.trim(old).eqNullSafe(F.trim(new))


def prompt_text(df: DataFrame, template: str, **columns: Column) -> DataFrame:
    """``df`` with ``prompt``: a template whose ``{name}`` fields are columns, nulls as nothing."""
    import string

    parts: list[Column] = []
    for text, field, _, _ in string.Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if field:
            parts.append(F.coalesce(columns[field].cast("string"), F.lit("")))
    return df.withColumn("prompt", F.concat(*parts))


#: Words that hint at an area of risk, anywhere in a text.
RISK_WORDS = {
    "security": ("password", "secret", "token", "api_key", "auth", "sql", "inject", "eval", "exec"),
    "concurrency": ("thread", "lock", "async", "await", "concurrent", "mutex", "semaphore"),
}


def risk_areas(text: Column) -> Column:
    """The areas of risk whose words stand in a text, in a fixed order; none for a null text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*[F.when(low.rlike("|".join(words)), F.lit(area)) for area, words in RISK_WORDS.items()]), lambda x: x.isNotNull())
