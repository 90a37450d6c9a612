"""Texts packed into containers of fixed capacity by bin completion.

Token counts come from a public tokenizer; only (id, count) travels on. Texts over the capacity are
cut into full pieces and a rest. Items are ranked by size and dealt to shards of ``shard_items``, so
all shards have a like mix of sizes and are small enough for a search. Each shard is packed by bin
completion: the largest item left opens a container, the fillings of the room beside it are
enumerated, least waste first, dominated ones are skipped, and a branch ends where the waste so far
exceeds what a solution as good as the best one may have. Best fit gives the incumbent.

The containers of a shard with most room left, at most one in eight, aren't kept: their items go to
the next level, where they are dealt anew to an eighth as many shards, until one shard is left. So
what many small shards would leave half empty is filled, and only the last shard has a rest.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions.runs import runs
from tallyloom.operators.ranking import distributed_rank
from tallyloom.session import cut, shuffle_parts

#: Where the public vocabulary files lie, unless a path is given.
TOKENIZER = os.environ.get("TALLYLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: One container in so many of a shard, those with most room left, is opened again at the next level.
AGAIN = 8
#: Items per task, beyond the session's number of shuffle partitions.
PART_ITEMS = 500_000
#: Fixed value: the split pattern that belongs to that public byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoding(path: str):
    """The tiktoken encoding of a vocabulary file, loaded once per Python worker (kept in the library's own registry, as this module may be shipped by value)."""
    import tiktoken
    from tiktoken import registry

    name = f"file:{path}"
    if name not in registry.ENCODINGS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        registry.ENCODINGS[name] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return registry.ENCODINGS[name]


def _counter(path: str):
    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "tokens"])

    return kernel


def _reachable(sizes: list[int], count: dict[int, int], room: int) -> list[int]:
    """Of each suffix of ``sizes`` the sums up to ``room`` that its items make, as bits of one integer."""
    mask = (1 << (room + 1)) - 1
    out = [1] * (len(sizes) + 1)
    for k in range(len(sizes) - 1, -1, -1):
        sums, s, n = out[k + 1], sizes[k], min(count[sizes[k]], room // sizes[k])
        step = 1
        while n > 0:  # 1, 2, 4, ... items at once
            m = min(step, n)
            sums |= (sums << (s * m)) & mask
            n -= m
            step *= 2
        out[k] = sums
    return out


def _undominated(sizes: list[int], count: dict[int, int], sums: list[int], room: int, waste: int) -> Iterator[tuple[int, ...]]:
    """The undominated multisets that leave ``waste`` of ``room``, the largest items first; the bits of ``sums`` leave no sums that can't be met.

    A filling is dominated if an item left out fits beside it, or could replace a smaller item, or
    several items, and still fit: the container so changed packs at least as much and leaves items
    over that are no harder to pack. Both only become truer as more sizes are decided, so a choice
    is dropped as soon as the sizes decided so far show it, with all that would follow it.
    """
    least = sizes[-1] if sizes else 0
    fits = (1 << (waste + 1)) - 1
    stack = [(0, room - waste, (), 0, 0, 0, 0)]
    while stack:
        # Bits: sizes from an item chosen on to ``waste`` more, the like without the item's own, the like of sums of several; sizes left out.
        k, left, chosen, one, above, several, others = stack.pop()
        if not left:
            if k == len(sizes) or least > waste:  # what remains is smaller than all items chosen
                yield chosen
            continue
        s = sizes[k]
        for n in range(0, min(count[s], left // s) + 1):  # the last pushed, with most of the largest, comes first
            if n:
                several |= (several << s) | (one << s)
                one |= fits << s
                above |= (fits ^ 1) << s
            if not (sums[k + 1] >> (left - n * s)) & 1:
                continue
            out = others
            if n < count[s]:
                if s <= waste:
                    continue
                out |= 1 << s
            if not (several | above) & out:
                stack.append((k + 1, left - n * s, chosen + (s,) * n, one, above, several, out))


def _fillings(count: dict[int, int], room: int, most: int | None = None) -> Iterator[tuple[int, tuple[int, ...]]]:
    """(waste, items) of the undominated fillings of ``room`` from the multiset ``count``, least waste first, lazily and without a limit but ``most``, the waste up to which they are wanted."""
    sizes = sorted((s for s, n in count.items() if n and s <= room), reverse=True)
    sums = _reachable(sizes, count, room)
    for waste in range(room + 1 if most is None else min(room, most) + 1):
        if (sums[0] >> (room - waste)) & 1:
            for filling in _undominated(sizes, count, sums, room, waste):
                yield waste, filling


def best_fit(items: list[int], capacity: int) -> list[list[int]]:
    """Best fit decreasing: item numbers by container."""
    rooms: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for i in sorted(range(len(items)), key=lambda i: (-items[i], i)):
        k = bisect_left(rooms, (items[i], -1))
        if k == len(rooms):
            bins.append([i])
            insort(rooms, (capacity - items[i], len(bins) - 1))
        else:
            left, b = rooms.pop(k)
            bins[b].append(i)
            insort(rooms, (left - items[i], b))
    return bins


def least_containers(items: list[int], capacity: int) -> int:
    """A lower bound: for any threshold, items too large to share, those over half, and what is left of the rest beside these."""
    big = sorted(items, reverse=True)
    sums = [0, *accumulate(big)]
    half = sum(2 * x > capacity for x in big)
    best = half
    for a in {0, *(x for x in big if 2 * x <= capacity)}:
        alone = sum(x > capacity - a for x in big)
        last = sum(x >= a for x in big)
        room = (half - alone) * capacity - (sums[half] - sums[alone]) if half > alone else 0
        best = max(best, max(half, alone) + max(0, -(-(sums[last] - sums[max(half, alone)] - room) // capacity)))
    return best


def pack_items(items: list[int], capacity: int, nodes: int | None = 1_000) -> tuple[list[list[int]], bool]:
    """(containers, searched): containers (lists of item numbers) that hold all ``items`` (0 < size <= capacity).

    Bin completion within ``nodes`` containers opened, without a limit where None: then the number
    of containers is the least one. ``searched`` tells that the containers are those of the search;
    otherwise it found nothing as good as best fit decreasing, which then stands.
    """
    if not items:
        return [], True
    best, searched = best_fit(items, capacity), False
    bound = least_containers(items, capacity)
    total = sum(items)
    by_size: dict[int, list[int]] = defaultdict(list)
    for i in sorted(range(len(items)), reverse=True):
        by_size[items[i]].append(i)
    count = {s: len(v) for s, v in by_size.items()}
    order = sorted(count, reverse=True)
    limit = len(best) + 1  # a solution as good as best fit is taken
    spare = (limit - 1) * capacity - total
    plan: list[tuple[int, ...]] = []
    waste, left, used = 0, len(items), 0

    def options() -> Iterator[tuple[int, tuple[int, ...]]]:
        s = next(x for x in order if count[x])
        count[s] -= 1
        rest = {x: n for x, n in count.items() if n}
        count[s] += 1
        over = sum(x * n for x, n in rest.items()) - (capacity - s)
        # Only the container that takes all that is left may waste more than the rest of ``spare``.
        return ((w, (s, *f)) for w, f in _fillings(rest, capacity - s, None if over <= 0 else spare - waste))

    stack = [options()]
    while stack and (nodes is None or used < nodes):
        used += 1
        if len(plan) == len(stack):  # undo what this node chose before
            chosen = plan.pop()
            waste -= capacity - sum(chosen)
            left += len(chosen)
            for x in chosen:
                count[x] += 1
        w, chosen = next(stack[-1], (None, ()))
        if w is None or waste + w > spare and left > len(chosen):  # what follows wastes as much or more
            stack.pop()
            continue
        for x in chosen:
            count[x] -= 1
        left -= len(chosen)
        waste += w
        plan.append(chosen)
        if left:
            if len(plan) + 1 >= limit:
                stack.append(iter(()))
            else:
                stack.append(options())
            continue
        if len(plan) < limit:
            pools = {z: list(v) for z, v in by_size.items()}
            best, searched, limit = [[pools[x].pop() for x in c] for c in plan], True, len(plan)
            if limit == bound:
                break
            spare = (limit - 1) * capacity - total
    return best, searched


def _pack_shards(capacity: int, nodes: int | None, last: bool):
    """Containers of whole shards, numbered within the partition; those whose items go to the next level have a negative number."""

    def kernel(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        at_most = 0
        for frame in runs(batches, ["shard"]):
            for _, f in frame.groupby("shard", sort=True):
                f = f.sort_values(["size", "doc_id", "piece"], ascending=[False, True, True])
                sizes = [int(x) for x in f["size"]]
                bins, searched = pack_items(sizes, capacity, nodes)
                free = [capacity - sum(sizes[i] for i in members) for members in bins]
                again = set() if last else {b for b in sorted(range(len(bins)), key=lambda b: (-free[b], b))[: max(1, len(bins) // AGAIN)] if free[b]}
                at = [0] * len(f)
                for b, members in enumerate(bins):
                    no = -1 if b in again else at_most
                    at_most += b not in again
                    for i in members:
                        at[i] = no
                yield pd.DataFrame({"part": part, "bin": at, "searched": searched, "doc_id": f["doc_id"].to_numpy(), "piece": f["piece"].to_numpy(), "size": f["size"].to_numpy(), "first_token": f["first_token"].to_numpy()})

    return kernel


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens) of every non-blank text."""
    docs = documents.select(F.col("doc_id").cast("long"), "text").filter(F.col("doc_id").isNotNull() & F.col("text").rlike(r"[^\s\p{Z}\p{C}]"))
    return docs.mapInArrow(_counter(tokenizer), "doc_id long, tokens long")


def _numbered(rows: DataFrame, keys: list[str], top: Column, start: int) -> tuple[DataFrame, int]:
    """``rows`` with ``container`` = ``start`` + their ``no`` + the containers of the partitions before (``top`` by ``keys``), and the next free number."""
    sizes = rows.groupBy(*keys).agg(top.alias("n"))
    ahead = sizes.select(*[F.col(k).alias(f"__{k}") for k in keys], F.coalesce(F.sum("n").over(W.orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))  # one row per partition
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"__{k}") for k in keys])
    used = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("u")).first().u
    return rows.join(F.broadcast(ahead), same).withColumn("container", F.lit(start) + F.col("ahead") + F.col("no")), start + used


def pack_sizes(items: DataFrame, capacity: int, shard_items: int = 256, nodes: int | None = 1_000) -> DataFrame:
    """(doc_id, piece, size, first_token, level, part, no, searched): items (doc_id, piece, size, first_token) in containers, by levels.

    A container is one (level, part, no); ``searched`` tells that its shard's containers come from the search.
    """
    spark = items.sparkSession
    out: DataFrame | None = None
    level = 0
    todo = items
    while True:
        n = todo.count()
        shards = max(1, -(-n // shard_items))
        parts = max(1, min(shards, max(shuffle_parts(spark), n // PART_ITEMS)))
        dealt = distributed_rank(todo, [], ["size", "doc_id", "piece"], "rank").withColumn("shard", (F.col("rank") - 1) % shards)
        packed = dealt.repartition(parts, "shard").sortWithinPartitions("shard").mapInPandas(_pack_shards(capacity, nodes, shards == 1), "part int, bin long, searched boolean, doc_id long, piece int, size long, first_token long")
        packed = cut(packed)
        kept = packed.filter("bin >= 0").select("doc_id", "piece", "size", "first_token", F.lit(level).alias("level"), "part", F.col("bin").alias("no"), "searched")
        out = kept if out is None else out.unionByName(kept)
        if shards == 1:
            return out
        todo = packed.filter("bin < 0").select("doc_id", "piece", "size", "first_token")
        level += 1


def pack_documents(documents: DataFrame, capacity: int = 2048, tokenizer: str = TOKENIZER, shard_items: int = 256, nodes: int | None = 1_000) -> DataFrame:
    """(doc_id, piece, first_token, n_tokens, container): every non-blank text in a container of ``capacity`` tokens.

    ``piece`` is 1 for a text that fits; a longer text is cut into full containers, and its rest
    is packed like any item. Containers count from 0 without gaps. Null and blank texts and null
    ids have no row; an id given twice is packed once per distinct token count (repeated rows
    once). Deterministic for the same rows and settings. Empty tables give no rows.
    """
    counted = cut(token_counts(documents, tokenizer).distinct())
    full = F.floor(F.col("tokens") / capacity).cast("int")
    pieces = counted.select("doc_id", F.explode(
        F.transform(F.sequence(F.lit(0), full), lambda k: F.struct((k + 1).cast("int").alias("piece"), (k * capacity).cast("long").alias("first_token"), F.least(F.lit(capacity).cast("long"), F.col("tokens") - k * capacity).alias("size"))),
    ).alias("p")).select("doc_id", "p.*").filter("size > 0")
    shared, used = _numbered(pack_sizes(pieces.filter(F.col("size") < capacity), capacity, shard_items, nodes), ["level", "part"], F.max("no") + 1, 0)
    # Full pieces fill a container each; they are numbered behind the shared ones.
    alone = cut(pieces.filter(F.col("size") == capacity).withColumn("__at", F.monotonically_increasing_id()))
    alone = alone.withColumn("part", F.shiftright("__at", 33)).withColumn("no", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    own, _ = _numbered(alone, ["part"], F.max("no") + 1, used)
    columns = ["doc_id", "piece", "first_token", F.col("size").alias("n_tokens"), "container"]
    return shared.select(*columns).unionByName(own.select(*columns))
