"""Pairs of similar word sets within groups of any size, exactly and without comparing all pairs.

Rows with the same words and line collapse into one representative; representatives are keyed by
each of their rarest words (prefix filter), and a key that many share is split into chunks whose
pairs are joined as separate tasks, by set-relation skipping (``functions.setjoin``).
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.runs import runs
from tallyloom.functions.setjoin import similar_sets
from tallyloom.functions.text import words
from tallyloom.session import cut


def join_group(rows: list[tuple[int, int, frozenset]], border: int, gap: int, t: float, out: tuple[list, list], every: bool = True) -> None:
    """Pairs of (id, line, words) rows with a line below ``border``, the smaller one, and another at most ``gap`` on.

    Without ``every``, copies are linked to their neighbours by line only: fewer pairs, the same groups.
    """
    same: dict[frozenset, list[tuple[int, int]]] = defaultdict(list)
    for i, line, s in rows:
        same[s].append((i, line))
    sets = list(same)
    if not every:
        for members in same.values():
            members.sort(key=lambda m: (m[1], m[0]))

    def pair(p: tuple[int, int], q: tuple[int, int]) -> None:
        if p[0] != q[0] and abs(p[1] - q[1]) <= gap and min(p[1], q[1]) < border:
            out[0].append(p[0])
            out[1].append(q[0])

    for members in same.values():
        for k, p in enumerate(members):
            for q in members[k + 1 :] if every else members[k + 1 : k + 2]:
                pair(p, q)
    for i, j in similar_sets(sets, t):
        for p in same[sets[i]]:
            others = same[sets[j]]
            if not every:
                at = bisect_right(others, p[1], key=lambda m: m[1])
                others = others[max(0, at - 1) : at + 1]
            for q in others:
                pair(p, q)


def _chunked(gap: int, t: float):
    def kernel(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in runs(batches, ["key"]):
            for _, f in frame.groupby("key", sort=False):
                rows = [(i, ln, frozenset(w)) for i, ln, w in zip(f["rep"], f["line"], f["ws"])]
                out: tuple[list, list] = ([], [])
                # Sets alike in more than one line are apart as representatives: join_group handles both.
                join_group(rows, int(f["border"].iloc[0]), gap, t, out)
                if out[0]:
                    yield pd.DataFrame({"rep_a": [min(p) for p in zip(*out)], "rep_b": [max(p) for p in zip(*out)]})

    return kernel


def representative_pairs(rows: DataFrame, gap: int, t: float, limit: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of representatives (rep_a, rep_b) and membership (rep, id) of rows (path, cell, border, id, line, text).

    A group is one (path, cell); a pair of it has its smaller line below ``border`` and its lines at
    most ``gap`` apart. Rows of one path, line and set of words share a representative, whose name is
    a 128-bit digest of these. No task holds more than about twice ``limit`` representatives.
    """
    tagged = rows.withColumn("ws", F.array_sort(words(F.col("text")))).filter(F.size("ws") > 0).drop("text")
    tagged = tagged.withColumn("rep", F.md5(F.concat_ws("\x01", "path", F.col("line").cast("string"), F.array_join("ws", " "))))
    classes = cut(tagged.select("path", "cell", "border", "line", "ws", "rep").distinct())
    members = tagged.select("rep", "id").distinct()
    token = classes.select("path", "cell", "border", "line", "rep", "ws", F.explode("ws").alias("w"))
    df = token.groupBy("path", "cell", "w").agg(F.count("*").alias("df"))
    ranked = token.select("path", "cell", "rep", "line", "w").join(df, ["path", "cell", "w"]).groupBy("path", "cell", "rep", "line").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("o"))
    size = F.size("o")
    length = size - F.ceil(F.lit(t) * size - F.lit(1e-9)).cast("int") + 1
    keyed = ranked.select("path", "cell", "rep", "line", F.explode(F.slice("o", F.lit(1), length)).alias("p"))
    keyed = keyed.select("path", "cell", "rep", "line", F.col("p.w").alias("w"))
    n = keyed.groupBy("path", "cell", "w").agg(F.count("*").alias("n")).filter("n > 1")
    keyed = keyed.join(n, ["path", "cell", "w"]).withColumn("chunks", F.ceil(F.col("n") / limit).cast("int"))
    keyed = keyed.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    pairs = keyed.select("*", other).withColumn("ca", F.least("chunk", "other")).withColumn("cb", F.greatest("chunk", "other"))
    tasks = pairs.join(classes.select("path", "cell", "line", "rep", "border", "ws"), ["path", "cell", "line", "rep"])
    tasks = tasks.select(F.md5(F.concat_ws("\x01", "path", "cell", "w", "ca", "cb")).alias("key"), "rep", "line", "border", "ws")
    found = tasks.repartition("key").sortWithinPartitions("key").mapInPandas(_chunked(gap, t), "rep_a string, rep_b string")
    return found.distinct(), members
