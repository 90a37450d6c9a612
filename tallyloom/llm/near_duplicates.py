"""Near-duplicate records at the same place, without comparing all pairs.

A pair is two records of one path whose lines differ by at most ``max_gap`` and whose texts share
at least ``threshold`` of their distinct words (words in both over words in either).

Plan. Places are cut into cells of ``max_gap + 1`` lines; a pair lies in one cell or in two
neighbours, so each cell with its successor is a *group* and the pair belongs to the group of its
smaller line. One shuffle brings the rows of a path's stretch of cells together; the kernel
(``functions.setjoin``) walks the sorted rows and joins each group by set-relation skipping.

A group of more than ``heavy`` rows (a hot line; found by a count before the shuffle) takes a
second, equally exact way, by representatives and rarest words (``operators.set_pairs``). No task
holds more than about twice ``heavy`` rows whatever the skew.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.runs import runs
from tallyloom.functions.text import norm_path
from tallyloom.operators.set_pairs import join_group, representative_pairs
from tallyloom.session import cut

_WORD = re.compile(r"\w+")
#: Heavy groups up to this number are broadcast (24 bytes each); more are joined by shuffle.
BROADCAST_GROUPS = 100_000
#: Cells per stretch: one row in so many is sent to two stretches.
STRETCH = 64


def _emit(a: list[int], b: list[int]) -> pd.DataFrame:
    x, y = np.array(a, dtype="int64"), np.array(b, dtype="int64")
    return pd.DataFrame({"id_a": np.minimum(x, y), "id_b": np.maximum(x, y)})


def _light(gap: int, t: float, every: bool):
    cell = gap + 1

    def kernel(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in runs(batches, ["stretch_key"]):
            key, line = frame["stretch_key"].to_numpy(), frame["line"].to_numpy()
            close = (key[1:] == key[:-1]) & (line[1:] - line[:-1] <= gap)
            keep = np.zeros(len(frame), dtype=bool)
            keep[1:] |= close
            keep[:-1] |= close
            if not keep.any():
                continue
            f = frame[keep]
            groups: dict[tuple, list] = defaultdict(list)
            sets: dict[str, frozenset] = {}
            for path, ln, guest, skip_own, skip_prev, i, text in zip(f["path"], f["line"], f["guest"], f["skip_own"], f["skip_prev"], f["id"], f["text"]):
                s = sets.get(text)
                if s is None:
                    s = sets[text] = frozenset(_WORD.findall(text.lower()))
                if not s:
                    continue
                c = ln // cell
                if not guest and not skip_own:
                    groups[path, c].append((i, ln, s))
                if ln % cell < gap and not skip_prev:
                    groups[path, c - 1].append((i, ln, s))
            out: tuple[list, list] = ([], [])
            for (_, c), rows in groups.items():
                border = (c + 1) * cell
                if len(rows) > 1 and any(r[1] < border for r in rows):
                    join_group(rows, border, gap, t, out, every)
                if len(out[0]) > 50_000:
                    yield _emit(*out)
                    out = ([], [])
            if out[0]:
                yield _emit(*out)

    return kernel


def near_duplicates(df: DataFrame, id_col: str, path_col: str, line_col: str, text_col: str, threshold: float = 0.6, max_gap: int = 3, heavy: int = 2048, every: bool = True) -> DataFrame:
    """(id_a, id_b), id_a < id_b, each once: records of one place that share ``threshold`` of their words.

    Rows whose id, path, line or text is null, or whose path or text is blank, match nothing. A
    record delivered twice matches as one; versions that differ count each. Spellings of a path
    (``./``, backslashes, doubled slashes, white space around) are one path. Empty tables give no
    rows; further columns are ignored, whatever their names. Texts are read whole, however long. With ``every`` False exact copies are
    linked in chains instead of all pairs: enough for groups, and linear in the copies.
    """
    cell = max_gap + 1
    base = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), norm_path(F.col(f"`{path_col}`")).alias("path"), F.col(f"`{line_col}`").cast("long").alias("line"), F.col(f"`{text_col}`").alias("text"))
    base = base.dropna().filter(F.col("text").rlike(r"[\p{L}\p{N}_]"))
    at = F.floor(F.col("line") / cell).cast("long")
    cells = base.groupBy("path", at.alias("cell")).agg(F.count("*").alias("n"))
    sums = cells.unionByName(cells.withColumn("cell", F.col("cell") - 1)).groupBy("path", "cell").agg(F.sum("n").alias("n"))
    hot = cut(sums.filter(F.col("n") > heavy).select("path", "cell"))
    n_hot = hot.limit(BROADCAST_GROUPS + 1).count()

    rows = base.withColumn("cell", at)
    if n_hot:
        mark = (lambda x: F.broadcast(x)) if n_hot <= BROADCAST_GROUPS else (lambda x: x)
        own = hot.select(F.col("path").alias("p1"), F.col("cell").alias("c1"))
        prev = hot.select(F.col("path").alias("p2"), (F.col("cell") + 1).alias("c2"))
        rows = rows.join(mark(own), (F.col("path") == F.col("p1")) & (F.col("cell") == F.col("c1")), "left").join(mark(prev), (F.col("path") == F.col("p2")) & (F.col("cell") == F.col("c2")), "left")
        rows = rows.withColumns({"skip_own": F.col("p1").isNotNull(), "skip_prev": F.col("p2").isNotNull()}).drop("p1", "c1", "p2", "c2")
    else:
        rows = rows.withColumns({"skip_own": F.lit(False), "skip_prev": F.lit(False)})

    first = F.floor(F.col("cell") / STRETCH)
    border: Column = (F.pmod(F.col("cell"), F.lit(STRETCH)) == 0) & (F.pmod(F.col("line"), F.lit(cell)) < max_gap) & ~F.col("skip_prev")
    sent = F.filter(F.array(F.when(~(F.col("skip_own") & F.col("skip_prev")), F.struct(first.alias("s"), F.lit(False).alias("guest"))), F.when(border, F.struct((first - 1).alias("s"), F.lit(True).alias("guest")))), lambda x: x.isNotNull())
    light = rows.select("*", F.explode(sent).alias("at")).select(F.xxhash64("path", "at.s").alias("stretch_key"), "path", "line", "at.guest", "skip_own", "skip_prev", "id", "text")
    pairs = light.repartition("stretch_key").sortWithinPartitions("stretch_key", "line").mapInPandas(_light(max_gap, threshold, every), "id_a long, id_b long")
    if n_hot:
        own_rows = rows.filter("skip_own").select("path", "cell", ((F.col("cell") + 1) * cell).alias("border"), "id", "line", "text")
        next_rows = rows.filter(F.col("skip_prev") & (F.pmod(F.col("line"), F.lit(cell)) < max_gap)).select("path", (F.col("cell") - 1).alias("cell"), (F.col("cell") * cell).alias("border"), "id", "line", "text")
        reps, members = representative_pairs(own_rows.unionByName(next_rows), max_gap, threshold, heavy)
        members = cut(members)
        if not every:
            least = members.groupBy("rep").agg(F.min("id").alias("least"))
            star = members.join(least, "rep").select(F.col("least").alias("ia"), F.col("id").alias("ib"))
            a, b = (least.select(F.col("rep").alias(f"r{x}"), F.col("least").alias(f"i{x}")) for x in "ab")
            both = reps.join(a, F.col("rep_a") == F.col("ra")).join(b, F.col("rep_b") == F.col("rb")).select("ia", "ib").unionByName(star)
            return pairs.unionByName(both.filter("ia <> ib").select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"))).distinct()
        a, b = members.select(F.col("rep").alias("ra"), F.col("id").alias("ia")), members.select(F.col("rep").alias("rb"), F.col("id").alias("ib"))
        across = reps.join(a, F.col("rep_a") == F.col("ra")).join(b, F.col("rep_b") == F.col("rb")).select("ia", "ib")
        within = a.join(b, (F.col("ra") == F.col("rb")) & (F.col("ia") < F.col("ib"))).select("ia", "ib")
        both = across.unionByName(within).filter("ia <> ib")
        pairs = pairs.unionByName(both.select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b")))
    return pairs.distinct()
