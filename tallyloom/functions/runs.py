"""Walk sorted partitions group by group inside ``mapInPandas``.

``applyInPandas`` pays a fixed price per group, which dominates where most groups hold a row or
two. Repartition by the key, sort within partitions, and walk the batches: groups come whole, and
only the group at hand is held.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd


def runs(batches: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of whole groups, several at a time: equal ``keys`` never spread over two frames.

    The batches must be sorted so that equal keys are adjacent.
    """
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        new = np.zeros(len(batch), dtype=bool)
        for k in keys:
            v = batch[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
            if held:
                last = held[-1][k].iloc[-1]
                new[0] |= bool(v[0] != last)
        starts = np.flatnonzero(new)
        if not held:
            cut = starts[-1] if len(starts) else 0
            if cut:
                yield batch.iloc[:cut]
            held = [batch.iloc[cut:]]
        elif not len(starts):
            held.append(batch)
        else:
            held.append(batch.iloc[: starts[-1]])
            yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
            held = [batch.iloc[starts[-1] :]]
    if held:
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
