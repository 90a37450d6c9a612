"""Leaked passages: the alignment, and the index against alignment of every pair."""

import random

import pytest

from tallyloom.llm import leakage
from tallyloom.llm.leakage import best_stretch, build_index, clean_run, item_words, leaked, search, stretch, text_words, window_edits

WORDS = [f"w{i}" for i in range(120)]


def test_stretch_counts_edits():
    item = [f"a{i}" for i in range(40)]
    none = [False] * 100
    assert stretch(item, item, none) == 40
    assert stretch(item, item[:25], none) == 25
    assert stretch(item, item[:24], none) == 0
    assert stretch(item, ["x", *item[3:22], "y", *item[30:]], none) == 0  # 19 words, then a gap
    changed = [w if k % 11 else "z" for k, w in enumerate(item)]
    assert stretch(item, changed, none) >= 25
    often = [w if k % 5 else "z" for k, w in enumerate(item)]
    assert stretch(item, often, none) == 0
    assert stretch(item, list(reversed(item)), none) == 0


def test_line_numbers_are_no_words():
    w, head = text_words("1. one two\n > 22) three 4 four\n- 5 five")
    assert [x for x, h in zip(w, head) if not h] == ["one", "two", "three", "4", "four", "five"]


def make(seed):
    rng = random.Random(seed)
    opening = "Read this and say what is wrong with it."
    items = [(k, f"{opening} " + " ".join(rng.choice(WORDS) + rng.choice(["", "x", "y"]) for _ in range(rng.randint(10, 70)))) for k in range(25)]
    docs = []
    for d in range(120):
        body = [rng.choice(WORDS) + rng.choice(["", "x", "y"]) for _ in range(rng.randint(0, 120))]
        if d % 3 == 0:
            w = item_words(rng.choice(items)[1])
            a = rng.randint(0, max(0, len(w) - 30))
            part = w[a : a + rng.choice([12, 20, 25, 30, 60])]
            part = [x if rng.random() > 0.04 else "changed" for x in part]
            body[10:10] = part
        text = ""
        for k, x in enumerate(body):
            text += (f"\n{k // 7 + 1}. " if d % 2 and k % 7 == 0 else " ") + (x.upper() if rng.random() < 0.2 else x) + rng.choice(["", ",", ".", " -"])
        docs.append((d, text))
    return items, docs


def test_index_equals_brute_force(spark):
    items, docs = make(4)
    docs += [(500, None), (501, ""), (502, " \n"), docs[0], (None, items[3][1]), (503, items[5][1] * 200)]
    items += [(90, None), (91, ""), (92, "short"), items[2], (None, items[1][1])]
    want = set()
    for d, t in docs:
        for k, x in items:
            if d is not None and k is not None and t and x and stretch(item_words(x), *text_words(t)):
                want.add((d, k))
    dd = spark.createDataFrame([(d, t, 1, "e") for d, t in docs], "doc_id long, text string, item_id int, words string").repartition(3)
    ii = spark.createDataFrame([(k, t, "s", "a") for k, t in items], "item_id long, text string, suite string, doc_id string")
    got = leaked(dd, ii).collect()
    assert len({(r.doc_id, r.item_id) for r in got}) == len(got)
    assert {(r.doc_id, r.item_id) for r in got} == want
    small = {(r.doc_id, r.item_id) for r in leaked(dd, ii, items_per_block=7).collect()}
    assert small == want


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    i = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a " * 60)], "doc_id long, text string")
    assert leaked(d, i).count() == 0 and leaked(one, i).count() == 0
    assert leaked(d, spark.createDataFrame([(1, " ".join(WORDS))], "item_id long, text string")).count() == 0


def edited(rng, words, kind, where, n):
    """``words`` with ``n`` edits of a kind inside, in one place or all over."""
    w = list(words)
    mid = len(w) // 2 - n // 2
    at = list(range(mid, mid + n)) if where == "clustered" else sorted(rng.sample(range(1, len(w) - 1), n))
    for p in reversed(at):
        if kind == "changed":
            w[p] = "otherword"
        elif kind == "lost":
            del w[p]
        else:
            w.insert(p, "otherword")
    return w


@pytest.mark.parametrize("seed", [1, 2])
def test_no_stretch_is_lost(spark, seed):
    """Planted stretches of every length, kind and place of edits are all found, those with one edit too many aren't."""
    rng = random.Random(seed)
    items, docs, want = [], [], set()
    noise = [f"n{i}" for i in range(300)]
    for size in (25, 29, 30, 35, 40, 49, 50, 60, 75):
        for kind in ("changed", "added", "lost"):
            for where in ("clustered", "spread"):
                for extra in (0, 1):
                    k = len(items)
                    words = [rng.choice(noise) + rng.choice("abcdefgh") for _ in range(size)]
                    items.append((k, " ".join(words)))
                    part = edited(rng, words, kind, where, size // 10 + extra)
                    fill = [rng.choice(noise) for _ in range(60)]
                    docs.append((k, " ".join(fill[:30] + part + fill[30:])))
                    if not extra:
                        want.add((k, k))
    dd = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    ii = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaked(dd, ii).collect()}
    assert want <= got
    texts, of_items = dict(docs), dict(items)
    brute = {(d, k) for d in texts for k in of_items if leakage._by_cells(item_words(of_items[k]), item_words(texts[d]), 25, 10)}
    assert got == brute


def plain(item, words, least, edits_in):
    """Whether any stretch holds, by the textbook recurrence from every start."""
    for i0 in range(len(item)):
        for p0 in range(len(words)):
            if item[i0] != words[p0]:
                continue
            best = {(i0, p0): 0}
            for i in range(i0, len(item)):
                for p in range(p0, len(words)):
                    options = [best[i0, p0]] if (i, p) == (i0, p0) else []
                    for di, dp in ((1, 1), (1, 0), (0, 1)):
                        if (i - di, p - dp) in best:
                            options.append(best[i - di, p - dp] + (0 if di and dp and item[i] == words[p] else 1))
                    if not options:
                        continue
                    best[i, p] = min(options)
                    n = i - i0 + 1
                    if item[i] == words[p] and n >= least and best[i, p] * edits_in <= n:
                        return True
    return False


def test_alignment_is_exact():
    rng = random.Random(9)
    found = 0
    for _ in range(400):
        item = [rng.choice("abcdef") for _ in range(rng.randint(6, 14))]
        words = list(item)
        for _ in range(rng.randint(0, 5)):
            p = rng.randrange(len(words))
            words[p : p + rng.randint(0, 1)] = [rng.choice("abcdefx")] * rng.randint(0, 2)
            words = words or ["x"]
        got = best_stretch(item, words, [False] * len(words), 6, 3)
        assert bool(got) == plain(item, words, 6, 3), (item, words)
        found += bool(got)
    assert 50 < found < 390


def test_bounds():
    assert clean_run(25, 10) == 7 and window_edits(25, 10) == 4
    costs = [random.Random(3).randint(1, 50) for _ in range(40)]
    chosen = leakage._seeds(costs, 7)
    assert all(set(chosen) & set(range(k, k + 7)) for k in range(34))
    assert leakage._seeds([1] * 7, 7) and len(leakage._seeds([1] * 8, 7)) == 1


def test_one_index_for_several_item_sets(spark, tmp_path):
    items, docs = make(11)
    dd = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    at = build_index(dd, str(tmp_path / "index"))
    halves = [spark.createDataFrame(x, "item_id long, text string") for x in (items[:12], items[12:])]
    apart = [r for h in halves for r in search(spark, at, dd, h).collect()]
    assert sorted(apart) == sorted(leaked(dd, spark.createDataFrame(items, "item_id long, text string")).collect())
    texts = dict(docs)
    for r in apart:
        assert (r.kind == "phrase") == (r.edits == 0) and r.edits * 10 <= r.words
        assert text_words(texts[r.doc_id])[0][r.doc_from - 1] == item_words(dict(items)[r.item_id])[r.item_from - 1]


def test_hot_terms_are_taken_in_parts(spark, monkeypatch):
    items, docs = make(5)
    dd, ii = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(leaked(dd, ii).collect())
    monkeypatch.setattr(leakage, "HELD", 50)
    monkeypatch.setattr(leakage, "SEGMENT", 300)
    assert sorted(leaked(dd, ii).collect()) == want


def test_readers_of_the_index_hold_few_segments(spark, monkeypatch, tmp_path):
    """However many segments a file of the index has, a row group and a batch handed to Python hold few of them."""
    from pyarrow.parquet import ParquetFile

    monkeypatch.setattr(leakage, "SEGMENT", 300)
    monkeypatch.setattr(leakage, "ROW_GROUP", 50_000, raising=False)
    rng = random.Random(8)
    docs = [(d, " ".join(rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(320))) for d in range(60)]
    dd = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    at = build_index(dd, str(tmp_path / "index"))
    files = [ParquetFile(f).metadata for f in (tmp_path / "index").glob("*.parquet")]
    assert sum(m.num_rows for m in files) == 60
    assert max(m.row_group(k).num_rows for m in files for k in range(m.num_row_groups)) <= 30

    def watched(make):
        def made(*args):
            kernel = make(*args)

            def few(batches):
                def each():
                    for b in batches:
                        if b.num_rows > 8:
                            raise ValueError(f"{b.num_rows} segments at once")
                        yield b

                return kernel(each())

            return few

        return made

    for name in ("_frequencies", "_intersected"):
        monkeypatch.setattr(leakage, name, watched(getattr(leakage, name)))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    items = spark.createDataFrame([(k, " ".join(docs[k][1].split()[:40])) for k in range(5)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in search(spark, at, dd, items).collect()} >= {(k, k) for k in range(5)}
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == size
