"""Texts cut into chunks of characters at the coarsest separator that keeps them small enough."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEPARATORS = ("\n\n", "\n", " ", "")


def _pieces(text: str, size: int, separators: tuple[str, ...]) -> list[str]:
    if len(text) <= size:
        return [text]
    sep, rest = separators[0], separators[1:]
    if not sep:
        return [text[i : i + size] for i in range(0, len(text), size)]
    parts = text.split(sep)
    parts = [p + sep for p in parts[:-1]] + [parts[-1]]
    return [x for p in parts if p for x in (_pieces(p, size, rest) if len(p) > size else [p])]


def char_chunks(text: str, size: int = 600, overlap: int = 80) -> list[str]:
    """Chunks of at most ``size`` characters; each after the first begins with whole pieces of at most ``overlap`` characters of the one before."""
    out: list[str] = []
    held: list[str] = []
    n = 0
    for p in _pieces(text, size, SEPARATORS):
        if n + len(p) > size and held:
            out.append("".join(held))
            while held and (n > overlap or n + len(p) > size):
                n -= len(held.pop(0))
        held.append(p)
        n += len(p)
    if held:
        out.append("".join(held))
    return [c for c in out if c.strip()]


def split_characters(df: DataFrame, key: str, text: str, size: int = 600, overlap: int = 80) -> DataFrame:
    """(key, chunk, content): the chunks of each text, from 1; null and blank texts give none. Map-only."""
    kind = df.schema[key].dataType.simpleString()

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, no, content = [], [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                for n, c in enumerate(char_chunks(t, size, overlap)):
                    at.append(k)
                    no.append(n + 1)
                    content.append(c)
            if at:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(no, pa.int32()), pa.array(content)], names=[key, "chunk", "content"])

    return df.select(key, text).filter(F.col(text).isNotNull()).mapInArrow(kernel, f"`{key}` {kind}, chunk int, content string")
