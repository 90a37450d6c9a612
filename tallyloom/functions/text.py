"""Scalar expressions over text, all JVM-side columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nz(col: Column, other: str = "") -> Column:
    """``col`` with null as ``other``."""
    return F.coalesce(col, F.lit(other))


def blank(col: Column) -> Column:
    """True where a text is null or has no visible character (Unicode white space, format and control characters are not visible)."""
    return col.isNull() | (F.length(F.regexp_replace(col, r"[\p{Z}\p{C}\s]", "")) == 0)


def norm_path(col: Column) -> Column:
    """One spelling of a path: trimmed, slashes forward and single, no leading ``./`` or ``/``; null when nothing is left."""
    p = F.regexp_replace(F.regexp_replace(F.trim(col), r"\\", "/"), r"^[\s]+|[\s]+$", "")
    p = F.regexp_replace(F.regexp_replace(p, r"/(\./)+", "/"), r"/{2,}", "/")
    p = F.regexp_replace(p, r"^(\./|/)+", "")
    return F.when(F.length(p) > 0, p)


def words(col: Column) -> Column:
    """Distinct lower-case words: runs of letters, digits and underscores (Unicode)."""
    return F.array_distinct(F.regexp_extract_all(F.lower(col), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))


def norm_name(col: Column) -> Column:
    """One spelling of a model or similar name: trimmed, lower case, ``_`` as ``-``; null when blank."""
    v = F.regexp_replace(F.lower(F.trim(col)), "[_ ]+", "-")
    return F.when(F.length(v) > 0, v)


def code_tokens(col: Column) -> Column:
    """Tokens of code for lexical search: split on other than letters, digits and ``_``; camel humps apart; lower case; longer than one character."""
    humps = F.regexp_replace(F.regexp_replace(col, "([a-z])([A-Z])", "$1 $2"), "[^a-zA-Z0-9_]+", " ")
    return F.filter(F.split(F.lower(humps), " "), lambda t: F.length(t) > 1)


def ext(col: Column) -> Column:
    """Lower-case extension with its dot; a leading dot of the base name starts no extension."""
    base = F.regexp_extract(col, r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(base, r"^\.*[^.].*?(\.[^.]*)$", 1))


def module_name(col: Column, keep_ext: bool = False) -> Column:
    """Dotted module of a path: ``\\`` as ``/``, leading ``.`` and ``/`` dropped, ``.py`` (or with ``keep_ext`` False any extension) cut."""
    p = F.regexp_replace(F.regexp_replace(col, r"\\", "/"), r"^[./]+", "")
    p = F.regexp_replace(p, r"\.py$" if keep_ext else r"\.[^./]*$", "")
    return F.regexp_replace(p, "/", ".")


def truncate(col: Column, n: int, suffix: str = "") -> Column:
    """First ``n`` characters, with ``suffix`` where something was cut."""
    return F.when(F.length(col) > n, F.concat(F.substring(col, 1, n), F.lit(suffix))).otherwise(col)


def truncate_counted(col: Column, n: int) -> Column:
    """First ``n`` characters and a note with the number of characters left out."""
    return F.when(F.length(col) > n, F.concat(F.substring(col, 1, n), F.lit("\n... ["), (F.length(col) - n).cast("string"), F.lit(" chars truncated]"))).otherwise(col)


def fence_body(col: Column) -> Column:
    """The inside of the first ``` block of a text (language tag dropped), else the whole text trimmed."""
    inside = F.regexp_extract(col, r"(?s)```[\w+-]*[ \t]*\r?\n(.*?)```", 1)
    return F.trim(F.when(F.length(inside) > 0, inside).otherwise(col))


def json_slice(col: Column) -> Column:
    """The outermost ``{...}`` of a text without fences, null if there is none."""
    bare = F.regexp_replace(col, r"(?m)^```\w*\s*$", "")
    found = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.when(F.length(found) > 0, found)


def hmac_sha256_hex(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 of a text under a driver-side key, from the engine's own sha2 (RFC 2104), no Python per row."""
    import hashlib

    k = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ x for b in k).hex())) for x in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(outer, first), 256)
