"""Near-duplicate records against brute force."""

import random
import re

import pytest

from tallyloom.llm.near_duplicates import near_duplicates

SCHEMA = "id long, file_path string, line_start int, message string, rep string, key string"


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def norm(p):
    p = re.sub(r"/{2,}", "/", re.sub(r"/(\./)+", "/", p.strip().replace("\\", "/")))
    return re.sub(r"^(\./|/)+", "", p)


def brute(rows, t=0.6, gap=3):
    ok = [(i, norm(p), ln, frozenset(re.findall(r"\w+", m.lower()))) for i, p, ln, m, *_ in rows if None not in (i, p, ln, m)]
    ok = [r for r in ok if r[1] and r[3]]
    return {(min(a[0], b[0]), max(a[0], b[0])) for k, a in enumerate(ok) for b in ok[:k] if a[0] != b[0] and a[1] == b[1] and abs(a[2] - b[2]) <= gap and jaccard(a[3], b[3]) >= t - 1e-9}


def made(n, seed, lines, paths, vocab=40):
    rng = random.Random(seed)
    texts = [" ".join(f"w{rng.randrange(vocab)}" for _ in range(9)) for _ in range(max(3, n // 8))]

    def text():
        w = rng.choice(texts).split()
        if rng.random() < 0.6:
            w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
        return " ".join(w)

    spell = [lambda p: p, lambda p: "./" + p, lambda p: p.replace("/", "\\"), lambda p: p + " ", lambda p: p.replace("/", "//")]
    return [(i, rng.choice(spell)(f"a/b{rng.randrange(paths)}.py"), rng.randrange(lines), text(), "r", "k") for i in range(n)]


@pytest.mark.parametrize("heavy", [2048, 6])
@pytest.mark.parametrize("every", [True, False])
def test_operator_equals_brute_force(spark, heavy, every):
    rows = made(240, 3, 12, 2) + made(60, 4, 3000, 1)
    rows = [(k, *r[1:]) for k, r in enumerate(rows)]
    rows += [rows[5], rows[9], (900, None, 3, "w1 w2", "r", "k"), (901, " ", 3, "w1 w2", "r", "k"), (902, "a/b0.py", None, "w1", "r", "k"), (903, "a/b0.py", 3, None, "r", "k"), (904, "a/b0.py", 3, " - ", "r", "k"), (905, "a/b0.py", 3, "", "r", "k")]
    rows += [(1000 + k, "hot.ts", 7, "same words here", "r", "k") for k in range(40)]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA), "id", "file_path", "line_start", "message", heavy=heavy, every=every).collect()
    pairs = {(r.id_a, r.id_b) for r in got}
    want = brute(rows)
    assert len(pairs) == len(got)
    if every:
        assert pairs == want
    else:
        assert pairs <= want
        assert groups(pairs) == groups(want)


def groups(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    out = {}
    for x in list(root):
        out.setdefault(find(x), set()).add(x)
    return {frozenset(g) for g in out.values()}


def test_empty_and_long(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA), "id", "file_path", "line_start", "message").count() == 0
    long = " ".join(f"t{i}" for i in range(60_000))
    rows = [(1, "a.py", 1, long, "", ""), (2, "a.py", 4, long + " more", "", ""), (3, "a.py", 5, long, "", "")]
    assert {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA), "id", "file_path", "line_start", "message").collect()} == {(1, 2), (2, 3)}
