"""Evaluation passages inside training text, by a distributed positional inverted index.

1. The index (``build_index``): the postings (term -> documents, positions) of every term of every
   training text, once, partitioned by document in segments of bounded size and written as Parquet
   to the shared folder. Any number of item sets is searched against it; the texts aren't read again
   but for the candidates.
2. Term statistics: the number of postings of the items' terms, from the index.
3. Seeds: of each item the rarest terms, so many that every run of ``clean_run`` words holds one.
4. Offset-adjusted intersection within each segment: a posting's position minus the seed's position
   in the item is the offset; the lists of the terms beside the seed are intersected at that offset.
   A (document, item) is a candidate if ``clean_run`` words in a row are so met, and if in some
   window of ``min_words`` item words all but those that edits can spoil occur thereabouts. No list
   of hits is ever shuffled.
5. The candidates' texts are aligned word by word: exact phrases, and proximity matches with up to
   one edit in ten words.

No case is lost by 4: a stretch of n words with at most n / 10 edits has a run of ``clean_run``
words without any (its n - e words lie in e + 1 runs), and a window of ``min_words`` words with at
most ``window_edits`` of them (fewer than 50 words have 4 at most; longer stretches hold disjoint
windows, of which the best has no more than its share).

Words are runs of letters, digits and underscores, case ignored. Numbers at line starts (of lists,
quotes, listings) are no words of the text around them, unless they stand in the item themselves: a
text with such numbers is indexed both without and with them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.session import cut, drop_folder, shared_folder

_WORD = re.compile(r"\w+")
#: A number that opens a line, behind markers of quotes, lists, tables and diffs.
_LINE_NUMBER = re.compile(r"(?m)^[ \t>#*+|/•·(\[{\"'-]*(\d+)(?=[ \t.):\]|}>-])")
#: Postings per segment of the index, beyond the one document that fills it; rows of about 1 MB.
SEGMENT = 200_000
#: Bytes of a row group of the index (as written) and segments handed to Python at once: readers hold as much, however many segments a file has.
ROW_GROUP, BATCH = 8 << 20, 4
#: Hits that are held at once; a segment with more is taken in parts, by documents and then by items.
HELD = 4_000_000
#: Ids of documents up to this number are broadcast (8 bytes each); more are joined by shuffle.
BROADCAST_IDS = 500_000
#: Items up to this number are broadcast to the alignment (some kB each); more are joined by shuffle.
BROADCAST_ITEMS = 5_000


def clean_run(min_words: int, edits_in: int) -> int:
    """Words without an edit in a row that every valid stretch has at least once."""
    return min(-(-(n - n // edits_in) // (n // edits_in + 1)) for n in range(min_words, min_words + 20 * edits_in))


def window_edits(min_words: int, edits_in: int) -> int:
    """Edits that the best window of ``min_words`` item words of a valid stretch has at most."""
    return (2 * min_words - 1) // edits_in


def item_words(text: str) -> list[str]:
    """The words of an item, without numbers at line starts."""
    return _counted(text.lower())


def text_words(text: str) -> tuple[list[str], list[bool]]:
    """The words of a text, and which of them are numbers at line starts."""
    low = text.lower()
    heads = {m.start(1) for m in _LINE_NUMBER.finditer(low)}
    if not heads:
        w = _WORD.findall(low)
        return w, [False] * len(w)
    found = [(m.group(), m.start()) for m in _WORD.finditer(low)]
    return [w for w, _ in found], [w.isdigit() and at in heads for w, at in found]


def _counted(low: str) -> list[str]:
    """The words of a lower-case text without numbers at line starts."""
    return _WORD.findall(_LINE_NUMBER.sub(lambda m: m.group()[: -len(m.group(1))], low))


# ---------------------------------------------------------------- alignment


def _by_blocks(item: list[str], words: list[str], head: list[bool], min_words: int, edits_in: int) -> tuple[int, int, int, int] | None:
    """(item words, edits, first item word, first text word) of the longest valid stretch of one alignment, that of the longest common blocks."""
    n = len(item)
    cost = [0] * (n + 1)  # edits charged to item word i, those before it included
    at = [-1] * n  # where a word is met
    for tag, a0, a1, b0, b1 in SequenceMatcher(None, item, words, autojunk=False).get_opcodes():
        if tag == "equal":
            at[a0:a1] = range(b0, b1)
            continue
        lost = a1 - a0
        for i in range(a0, a1):
            cost[i] += 1
        cost[a1] += max(0, sum(not h for h in head[b0:b1]) - lost)
    # f grows by edits_in per edit and falls by 1 per word: a stretch i..j holds if f[j] - f[i] <= 1
    f, sums, total = [0] * n, [0] * n, 0
    for i in range(n):
        total += cost[i]
        sums[i] = total
        f[i] = edits_in * total - i
    best: tuple[int, int, int, int] | None = None
    starts: list[tuple[int, int]] = []  # (f, i) with rising f: the earliest start for each bound
    pending = 0
    for j in range(n):
        while pending <= j - min_words + 1:
            if at[pending] >= 0 and (not starts or f[pending] > starts[-1][0]):
                starts.append((f[pending], pending))
            pending += 1
        if at[j] >= 0:
            for fi, i in starts:
                if fi >= f[j] - 1:
                    if best is None or j - i + 1 > best[0]:
                        best = (j - i + 1, sums[j] - sums[i], i, at[i])
                    break
    return best


def _by_cells(item: list[str], words: list[str], min_words: int, edits_in: int) -> tuple[int, int, int, int] | None:
    """The like over all alignments: per number of edits and place in the text the longest stretch that ends there."""
    n, m = len(item), len(words)
    top = n // edits_in
    if n < min_words or not m:
        return None
    ids = {w: k for k, w in enumerate(dict.fromkeys(item))}
    text = np.array([ids.get(w, -1) for w in words], dtype=np.int32)
    none = -(1 << 20)
    # longest[e, p]: item words of a stretch with e edits whose last text word is p - 1; begun[e, p]: where it starts in the text
    longest, begun = np.full((top + 1, m + 1), none, dtype=np.int32), np.zeros((top + 1, m + 1), dtype=np.int32)
    best: tuple[int, int, int, int] | None = None
    edits = np.arange(top + 1)[:, None]
    for i, w in enumerate(item):
        met = text == ids[w]
        diagonal, from_ = longest[:, :-1] + 1, begun[:, :-1]
        new, start = np.full_like(longest, none), np.zeros_like(begun)
        new[:, 1:] = np.where(met, diagonal, none)
        start[:, 1:] = from_
        fresh = met & (new[0, 1:] < 1)
        new[0, 1:][fresh] = 1
        start[0, 1:][fresh] = np.flatnonzero(fresh)
        if met.any():
            valid = np.where(met & (new[:, 1:] >= np.maximum(min_words, edits * edits_in)), new[:, 1:], 0)
            k = int(valid.argmax())
            e, p = divmod(k, m)
            if valid[e, p] > (best[0] if best else 0):
                size = int(valid[e, p])
                best = (size, e, i - size + 1, int(start[e, p + 1]))
        for e in range(1, top + 1):
            for value, where, to in ((longest[e - 1, :-1] + 1, begun[e - 1, :-1], slice(1, None)), (longest[e - 1] + 1, begun[e - 1], slice(None)), (new[e - 1, :-1], start[e - 1, :-1], slice(1, None))):
                better = value > new[e, to]
                new[e, to][better] = value[better]
                start[e, to][better] = where[better]
        longest, begun = new, start
    return best


def best_stretch(item: list[str], words: list[str], head: list[bool], min_words: int = 25, edits_in: int = 10) -> tuple[int, int, int, int] | None:
    """(item words, edits, first item word, first text word) of a stretch of the item that stands in ``words``; None if there is none.

    A stretch begins and ends with words that are met, has at least ``min_words`` item words and at
    most one edit (a changed, added or lost word) in ``edits_in`` of them. Words flagged in ``head``
    are free to be there. One alignment by common blocks settles nearly all pairs; where it finds
    nothing, all alignments are searched, so the answer whether there is a stretch is exact.
    """
    found = _by_blocks(item, words, head, min_words, edits_in)
    if found or not _may_align(item, words, min_words, window_edits(min_words, edits_in)):
        return found
    found = _by_cells(item, words, min_words, edits_in)
    if found or not any(head):
        return found
    kept = [k for k, h in enumerate(head) if not h]
    found = _by_cells(item, [words[k] for k in kept], min_words, edits_in)
    return found and (*found[:3], kept[found[3]])


def stretch(item: list[str], words: list[str], head: list[bool], min_words: int = 25, edits_in: int = 10) -> int:
    """Item words of the stretch that ``best_stretch`` finds, 0 if there is none."""
    found = best_stretch(item, words, head, min_words, edits_in)
    return found[0] if found else 0


def _may_align(item: list[str], words: list[str], min_words: int, spoiled: int) -> bool:
    """Whether in some window of ``min_words`` item words all but ``spoiled`` occur in ``words`` at all."""
    have = set(words)
    total = 0
    for k, w in enumerate(item):
        total += w in have
        if k >= min_words:
            total -= item[k - min_words] in have
        if k >= min_words - 1 and total >= min_words - spoiled:
            return True
    return False


# ---------------------------------------------------------------- index

_INDEX = "docs array<long>, full array<boolean>, terms array<string>, ends array<int>, doc array<int>, at array<int>"


def _segment(ids: list[int], full: list[bool], found: list[list[str]]) -> pa.RecordBatch:
    number: dict[str, int] = {}
    term = np.fromiter((number.setdefault(w, len(number)) for ws in found for w in ws), dtype=np.int32)
    sizes = [len(ws) for ws in found]
    doc = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
    at = np.concatenate([np.arange(k, dtype=np.int32) for k in sizes])
    names = sorted(number)
    place = np.empty(len(names), dtype=np.int32)
    for k, w in enumerate(names):
        place[number[w]] = k
    term = place[term]
    order = np.argsort(term, kind="stable")
    ends = np.cumsum(np.bincount(term, minlength=len(names))).astype(np.int32)
    lists = [pa.array(ids, pa.int64()), pa.array(full), pa.array(names), pa.array(ends), pa.array(doc[order]), pa.array(at[order])]
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in lists], names=[c.split()[0] for c in _INDEX.split(", ")])


def _segments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of the index: postings sorted by term, then document and position, as parallel arrays."""
    ids: list[int] = []
    full: list[bool] = []
    found: list[list[str]] = []
    held = 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            low = t.lower()
            words = _counted(low)
            forms = [(False, words)]
            if _LINE_NUMBER.search(low):
                forms.append((True, _WORD.findall(low)))
            for with_heads, ws in forms:
                if ws:
                    ids.append(i)
                    full.append(with_heads)
                    found.append(ws)
                    held += len(ws)
            if held >= SEGMENT:
                yield _segment(ids, full, found)
                ids, full, found, held = [], [], [], 0
    if found:
        yield _segment(ids, full, found)


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long"), "text").filter("doc_id is not null and length(text) > 0")


def build_index(documents: DataFrame, path: str | None = None) -> str:
    """Write the positional index of ``documents`` (doc_id, text) and return its folder.

    Without ``path`` a new folder in the shared folder of the session is taken. One pass over the
    texts, no shuffle; null and empty texts have no postings. Row groups are small, as a row holds a
    whole segment; their size is looked at after every row, not only after a hundred.
    """
    at = path or shared_folder(documents.sparkSession, "postings")
    _texts(documents).mapInArrow(_segments, _INDEX).write.mode("overwrite").options(**{"parquet.block.size": str(ROW_GROUP), "parquet.page.size.row.check.min": "1"}).parquet(at)
    return at


def _frequencies(vocabulary: list[str]):
    wanted = sorted(vocabulary)

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(wanted), dtype=np.int64)
        values = pa.array(wanted)
        for b in batches:
            for row in range(b.num_rows):
                at = pc.index_in(b.column(0)[row].values, value_set=values)
                n = np.diff(b.column(1)[row].values.to_numpy(zero_copy_only=False), prepend=0)
                known = at.is_valid().to_numpy(zero_copy_only=False)
                seen[at.drop_null().to_numpy()] += n[known]
        keep = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([wanted[k] for k in keep], pa.string()), pa.array(seen[keep])], names=["term", "n"])

    return kernel


def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers begin[k] .. begin[k] + count[k] - 1, one range after the other."""
    total = int(count.sum())
    ahead = np.cumsum(count) - count
    return np.arange(total) - np.repeat(ahead - begin, count)


def _seeds(costs: list[int], run: int) -> list[int]:
    """Positions of least total cost of which every ``run`` positions in a row hold one: the rarest terms of an item."""
    best: list[int] = []  # least cost of a choice that ends at a position
    before: list[int] = []
    for p, c in enumerate(costs):
        q = min(range(p - run, p), key=lambda k: (best[k], -k)) if p >= run else -1
        best.append(c + (best[q] if q >= 0 else 0))
        before.append(q)
    n = len(costs)
    p = min(range(max(0, n - run), n), key=lambda k: (best[k], k))
    chosen = []
    while p >= 0:
        chosen.append(p)
        p = before[p]
    return chosen[::-1]


def _intersected(item_ids: list[int], words: list[list[str]], n: dict[str, int], min_words: int, edits_in: int):
    """Candidates of each stored segment for items whose terms have ``n`` postings."""
    run, spoiled = clean_run(min_words, edits_in), window_edits(min_words, edits_in)
    terms = sorted({w for ws in words for w in ws})
    number = {w: k for k, w in enumerate(terms)}
    # All items in one line, apart by ``run`` marks that match nothing; ``item_at`` tells where each begins.
    gap = [-2] * run
    line = np.array([x for ws in words for x in (*gap, *(number[w] for w in ws))] + gap, dtype=np.int32)
    sizes = np.array([len(ws) for ws in words], dtype=np.int64)
    item_at = np.cumsum(sizes + run) - sizes
    table = np.array(sorted((number[ws[p]], i, int(item_at[i]) + p) for i, ws in enumerate(words) for p in _seeds([n.get(w, 0) + 1 for w in ws], run)), dtype=np.int64).reshape(-1, 3)
    uses = np.bincount(table[:, 0], minlength=len(terms))
    first = np.cumsum(uses) - uses

    def close(item: int, text: np.ndarray) -> bool:
        """Whether in some window of an item all words but ``spoiled`` occur in ``text``."""
        mine = line[item_at[item] : item_at[item] + sizes[item]]
        met = np.cumsum(np.r_[0, np.isin(mine, text)])
        return bool((met[min_words:] - met[:-min_words] >= min_words - spoiled).any())

    def meet(rows: np.ndarray, x: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hits (rows of the table, places in ``text``) that lie in a run of ``run`` words without an edit: the neighbours' lists, offset-adjusted, are intersected word by word."""
        g = table[rows, 2]
        around = np.zeros(len(x), dtype=np.int8)
        for side in (-1, 1):
            on = np.arange(len(x))
            for k in range(1, run):
                on = on[text[x[on] + side * k] == line[g[on] + side * k]]
                around[on] += 1
        keep = around >= run - 1
        return rows[keep], x[keep]

    def parts(rows: np.ndarray, begin: np.ndarray, count: np.ndarray, doc: np.ndarray, place: np.ndarray, text: np.ndarray, docs: tuple[int, int], items: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``meet`` of all hits of a segment, halved by documents, then by items, until they can be held."""
        if int(count.sum()) > HELD and docs[1] - docs[0] > 1:
            mid = (docs[0] + docs[1]) // 2
            for half in ((docs[0], mid), (mid, docs[1])):
                lo = np.array([b + np.searchsorted(doc[b : b + c], half[0]) for b, c in zip(begin, count)])
                hi = np.array([b + np.searchsorted(doc[b : b + c], half[1]) for b, c in zip(begin, count)])
                yield from parts(rows, lo, hi - lo, doc, place, text, half, items)
        elif int(count.sum()) > HELD and items[1] - items[0] > 1:
            mid = (items[0] + items[1]) // 2
            for half in ((items[0], mid), (mid, items[1])):
                mine = (table[rows, 1] >= half[0]) & (table[rows, 1] < half[1])
                yield from parts(rows[mine], begin[mine], count[mine], doc, place, text, docs, half)
        elif len(rows):
            yield meet(np.repeat(rows, count), place[_ranges(begin, count)], text)

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = pa.array(terms, pa.string())
        for batch in batches:
            for row in range(batch.num_rows):
                docs, full, names, ends, doc, at = (batch.column(c)[row].values for c in range(6))
                doc, at, e = doc.to_numpy(), at.to_numpy().astype(np.int64), ends.to_numpy().astype(np.int64)
                b = np.r_[0, e[:-1]]
                known = pc.fill_null(pc.index_in(names, value_set=values), -1).to_numpy()
                # The texts as the lists give them, apart like the items.
                length = np.bincount(doc, minlength=len(docs))
                doc_at = np.cumsum(length + run) - length
                place = doc_at[doc] + at
                text = np.full(int(length.sum()) + run * (len(docs) + 1), -1, dtype=np.int32)
                text[place] = np.repeat(known, e - b)
                mine = np.flatnonzero(known >= 0)
                t = known[mine]
                rows = _ranges(first[t], uses[t])
                begin, count = np.repeat(b[mine], uses[t]), np.repeat((e - b)[mine], uses[t])
                met = list(parts(rows, begin, count, doc, place, text, (0, len(docs)), (0, len(words))))
                if not met:
                    continue
                r, x = (np.concatenate(v) for v in zip(*met))
                i, d = table[r, 1], np.searchsorted(doc_at, x, side="right") - 1
                offset = x - doc_at[d] - (table[r, 2] - item_at[i])  # where the item would begin in the text
                order = np.lexsort((offset, i, d))
                i, d, offset = i[order], d[order], offset[order]
                bounds = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (d[1:] != d[:-1]), True]) if len(i) else []
                found = []
                for lo, hi in zip(bounds[:-1], bounds[1:]):
                    k, dn = int(i[lo]), int(d[lo])
                    drift = int(sizes[k]) // edits_in + 1
                    begins, stops = int(offset[lo]) - drift, int(offset[hi - 1] + sizes[k]) + drift
                    if close(k, text[int(doc_at[dn]) + max(0, begins) : int(doc_at[dn]) + min(int(length[dn]), stops)]):
                        found.append((dn, item_ids[k], max(0, begins), min(int(length[dn]), stops) - 1))
                if found:
                    dn, k, lo, hi = zip(*found)
                    yield pa.RecordBatch.from_arrays([docs.take(pa.array(dn)), full.take(pa.array(dn)), pa.array(k, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], names=["hit_id", "full", "item", "lo", "hi"])

    return kernel


# ---------------------------------------------------------------- search

_FOUND = "doc_id long, item_id long, words int, edits int, item_from int, doc_from int, kind string"


def _aligned(min_words: int, edits_in: int):
    spoiled = window_edits(min_words, edits_in)

    def best_of(words: list[str], head: list[bool], place: list[int], lo: int, hi: int, item: list[str]) -> tuple[int, int, int, int] | None:
        span = len(item) + 2 * (len(item) // edits_in + 1)
        best = None
        for s in range(lo, hi + 1, 4 * span):  # repeats far apart: windows that overlap by more than a stretch
            e = min(hi, s + 5 * span)
            a, z = place[s], place[e] + 1
            part = words[a:z]
            if _may_align(item, part, min_words, spoiled):
                got = best_stretch(item, part, head[a:z], min_words, edits_in)
                if got and (best is None or got[0] > best[0]):
                    best = (*got[:3], got[3] + a)
            if e == hi:
                break
        return best

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            last, words, head, places = None, [], [], {}
            for i, t, k, item, hits in zip(*(b.column(c).to_pylist() for c in range(5))):
                if last is None or t != last:  # the rows of one text mostly come together
                    words, head = text_words(t)
                    last, places = t, {True: range(len(words)), False: [n for n, h in enumerate(head) if not h]}
                found = [x for x in (best_of(words, head, places[h["full"]], h["lo"], h["hi"], item_words(item)) for h in hits) if x]
                if found:
                    size, edits, at, begins = max(found, key=lambda x: (x[0], -x[1], -x[2], -x[3]))
                    out.append((i, k, size, edits, at + 1, begins + 1, "proximity" if edits else "phrase"))
            if out:
                kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], names=[c.split()[0] for c in _FOUND.split(", ")])

    return kernel


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """``BATCH`` rows at once go to Python in what runs inside: a row of the index is a whole segment."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _hits(index: DataFrame, block: list[tuple[int, str]], min_words: int, edits_in: int) -> DataFrame:
    """Candidates (hit_id, full, item, lo, hi) of one block of items."""
    ids = [k for k, _ in block]
    words = [item_words(t) for _, t in block]
    counts = index.select("terms", "ends").mapInArrow(_frequencies(list({w for ws in words for w in ws})), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    with _small_batches(index.sparkSession):
        n = {r.term: r.n for r in counts.collect()}  # one row per term of the block's items
    return index.mapInArrow(_intersected(ids, words, n, min_words, edits_in), "hit_id long, full boolean, item long, lo int, hi int")


def search(spark: SparkSession, index: str, documents: DataFrame, items: DataFrame, min_words: int = 25, edits_in: int = 10, items_per_block: int = 5_000) -> DataFrame:
    """``leaked`` against a stored index of the same ``documents``; any number of item sets may use one index."""
    table = spark.read.schema(_INDEX).parquet(index)
    rows = items.select(F.col("item_id").cast("long"), "text").filter("item_id is not null and length(text) > 0").distinct()
    blocks: list[DataFrame] = []
    block: list[tuple[int, str]] = []
    n_items = 0
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        if len(item_words(r.text)) >= min_words:
            n_items += 1
            block.append((r.item_id, r.text))
            if len(block) >= items_per_block:
                blocks.append(_hits(table, block, min_words, edits_in))
                block = []
    if block:
        blocks.append(_hits(table, block, min_words, edits_in))
    if not blocks:
        return spark.createDataFrame([], _FOUND)
    with _small_batches(spark):
        hits = cut(reduce(DataFrame.unionByName, blocks).groupBy("hit_id", "item").agg(F.collect_set(F.struct("full", "lo", "hi")).alias("hits")))  # the few hits of one pair
    docs = _texts(documents)
    few = hits.select("hit_id").distinct().limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    chosen = docs.join(F.broadcast(hits.select("hit_id").distinct()) if few else hits.select("hit_id").distinct(), F.col("doc_id") == F.col("hit_id"), "left_semi")
    of_items = rows.select(F.col("item_id").alias("ik"), F.col("text").alias("item_text"))
    both = hits.join(F.broadcast(of_items) if n_items <= BROADCAST_ITEMS else of_items, F.col("item") == F.col("ik"))
    both = chosen.distinct().join(both, F.col("doc_id") == F.col("hit_id")).select("doc_id", "text", "ik", "item_text", "hits")
    found = both.mapInArrow(_aligned(min_words, edits_in), _FOUND)
    longest = F.struct("words", -F.col("edits"), -F.col("item_from"), -F.col("doc_from"))
    one = found.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("words", "edits", "item_from", "doc_from", "kind"), longest).alias("f"))
    return one.select("doc_id", "item_id", "f.*")


def leaked(documents: DataFrame, items: DataFrame, min_words: int = 25, edits_in: int = 10, items_per_block: int = 5_000) -> DataFrame:
    """(doc_id, item_id, words, edits, item_from, doc_from, kind), once per pair: documents that repeat ``min_words`` words or more of an item.

    ``words`` are the item words of the stretch found, ``edits`` the words changed, added or lost in
    it (at most one in ``edits_in``), ``item_from`` and ``doc_from`` the word numbers at which it
    begins, ``kind`` is ``phrase`` without an edit, else ``proximity``.

    ``documents`` has doc_id and text, ``items`` item_id and text; further columns are ignored.
    Null or blank texts and ids match nothing; items shorter than ``min_words`` words can't leak.
    Rows repeated under one id count as one. Items are taken in blocks of ``items_per_block``, each
    against the stored index, so any number of items is handled. Empty tables give no rows.
    """
    spark = documents.sparkSession
    if clean_run(min_words, edits_in) < 2:
        raise ValueError("edits_in is too small for min_words: a stretch need not have two words in a row")
    index = build_index(documents)
    found = cut(search(spark, index, documents, items, min_words, edits_in, items_per_block))
    drop_folder(spark, index)
    return found
