"""Chunks, diffs, retrieval and graph against hand-made cases and plain Python."""

import math
import random
import re
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import chunks as ch
from tallyloom.operators import graph as gr
from tallyloom.operators import relational as rel
from tallyloom.operators import retrieval as rt
from tallyloom.operators.ranking import distributed_last, previous

PATCH = "\n".join(["@@ -10,6 +10,8 @@", " unchanged_line", "+added_line_1", "+added_line_2", " unchanged_line_2", "-removed_line", " unchanged_line_3", "@@ -40,2 +42,3 @@ def f():", " ctx", "+added_3", "\\ No newline at end of file"])


def test_diff_lines(spark):
    df = spark.createDataFrame([(1, PATCH), (2, None), (3, ""), (4, "no hunk\n+x")], "id int, patch string")
    got = [(r.id, r.line) for r in ch.diff_lines(df, ["id"], "patch").filter("kind = '+'").collect()]
    assert sorted(got) == [(1, 11), (1, 12), (1, 43)]
    assert ch.diff_lines(df.limit(0), ["id"], "patch").count() == 0
    plus, minus = ch.diff_counts(F.col("patch"))
    assert tuple(df.filter("id = 1").select(plus, minus).first()) == (3, 1)
    places = spark.createDataFrame([(1, 11), (1, 13), (2, 11)], "id int, line_start int")
    assert [(r.id, r.line_start) for r in ch.valid_lines(places, ch.diff_lines(df, ["id"], "patch"), ["id"]).collect()] == [(1, 11)]


def test_windows(spark):
    text = "\n".join(f"l{i}" for i in range(1, 101))
    df = spark.createDataFrame([(1, text), (2, "\n".join("x" for _ in range(80))), (3, ""), (4, None), (5, " \n ")], "id int, t string")
    pairs = lambda d, i: [(r.start_line, r.end_line) for r in d.filter(F.col("id") == i).orderBy("start_line").collect()]
    assert pairs(ch.sliding_chunks(df, "t"), 1) == [(1, 80), (79, 100)]
    s = ch.split_chunks(df, "t")
    assert pairs(s, 1) == [(1, 80), (65, 100)] and pairs(s, 2) == [(1, 80), (65, 80)]
    assert s.filter("id > 2").count() == 0 and ch.sliding_chunks(df, "t").filter("id > 2").count() == 0


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 40), min_size=1, max_size=8), st.integers(3, 9), st.integers(0, 2))
def test_windows_equal_a_loop(spark, sizes, size, overlap):
    texts = ["\n".join(f"a{k}" for k in range(n)) for n in sizes]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = sorted((r.id, r.start_line, r.content) for r in ch.split_chunks(df, "t", size, overlap).collect())
    want = sorted((i, s + 1, "\n".join(ls[s : s + size])) for i, t in enumerate(texts) if t for ls in [t.split("\n")] for s in range(0, len(ls), size - overlap))
    assert got == want


def test_boundaries(spark):
    go = "package p\n\nfunc A() {\n}\n\nfunc B() {\n}\n"
    df = spark.createDataFrame([(1, go, "go"), (2, "a\nb", "text"), (3, "   ", "go")], "id int, t string, lang string")
    got = sorted((r.id, r.start_line, r.end_line) for r in ch.boundary_chunks(df.filter("lang = 'go'"), "id", "t", F.lit("go")).collect())
    assert got == [(1, 1, 2), (1, 3, 5), (1, 6, 7)]
    assert [(r.start_line, r.end_line) for r in ch.boundary_chunks(df.filter("id = 2"), "id", "t", F.lit("text")).collect()] == [(1, 2)]


@pytest.mark.parametrize("cells", [1_000_000, 7])
def test_dense_top_equals_a_loop(spark, monkeypatch, cells):
    monkeypatch.setattr(rt, "SCORE_CELLS", cells)
    rng = random.Random(6)
    rows = [(i, [1000.0 + rng.choice([0.0, 0.5, rng.random()]) for _ in range(4)]) for i in range(60)] + [(90, None), (91, [1.0]), (92, []), (93, [1000.0] * 4), (94, [1000.0] * 4)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    got = {}
    for r in rt.dense_top(df, df.filter("id % 10 = 0 or id = 91"), "id", "v", "id", "v", 5).collect():
        got.setdefault(r["query"], []).append((r["rank"], r.distance, r.id))
    want = {}
    for q, a in rows:
        if a and (q % 10 == 0 or q == 91):
            near = sorted((round(math.dist(a, b), 6), i) for i, b in rows if b and len(a) == len(b))[:5]
            want[q] = [(n + 1, d, i) for n, (d, i) in enumerate(near)]
    assert {q: sorted(v) for q, v in got.items()} == want
    assert rt.dense_top(df.limit(0), df, "id", "v", "id", "v").count() == 0 and rt.dense_top(df, df.limit(0), "id", "v", "id", "v").count() == 0


def test_rrf(spark):
    a = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query int, doc string, rank int")
    got = {r.doc: r for r in rt.fuse({"dense": a, "bm25": a}, ["doc"], final_k=2).collect()}
    assert math.isclose(got["a"].score, 2 / 61, abs_tol=1e-8) and math.isclose(got["b"].score, 2 / 62, abs_tol=1e-8)
    assert got["a"].place == 1 and got["b"].place == 2
    only = rt.fuse({"dense": a, "bm25": a.limit(0)}, ["doc"]).filter("doc = 'a'").first()
    assert only.bm25_rank == 0 and math.isclose(only.score, 1 / 61, abs_tol=1e-8)


def test_bm25_equals_a_loop(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "gammaRay", "x_1", "the", "the"]) for _ in range(rng.randint(0, 12)))) for i in range(40)] + [(90, None), (91, "")]
    df = spark.createDataFrame(docs, "id int, t string").repartition(3)
    queries = spark.createDataFrame([(1, "alpha gammaRay alpha"), (2, "unknown"), (3, "the beta")], "q int, qt string")
    full = df.filter("t is not null")
    got = {(r["query"], r.id): r.score for r in rt.bm25(rt.postings(full, "id", "t"), rt.document_stats(full, "t"), queries, "id", "q", "qt", 5).collect()}

    for cells in (2_000_000, 9):  # whole partitions, and three documents at a time
        rt.SCORE_CELLS = cells
        scan = rt.search_texts(df, queries, "id", "t", "q", "qt", 5).collect()
        assert {(r["query"], r.id): r.score for r in scan} == got and {r["rank"] for r in scan} == {1, 2, 3, 4, 5}
    rt.SCORE_CELLS = 1_000_000
    assert rt.search_texts(df.limit(0), queries, "id", "t", "q", "qt").count() == 0 and rt.search_texts(df, queries.limit(0), "id", "t", "q", "qt").count() == 0
    named = rt.search_texts(df.selectExpr("concat('d', id) as id", "t"), queries.selectExpr("concat('q', q) as q", "qt"), "id", "t", "q", "qt", 5).collect()
    assert {(r["query"], r["score"]) for r in named} == {(f"q{q}", s) for (q, _), s in got.items()}

    def toks(t):
        out = []
        for part in re.split(r"[^a-zA-Z0-9_]+", t):
            out += [w.lower() for w in re.sub(r"([a-z])([A-Z])", r"\1 \2", part).split() if len(w) > 1]
        return out

    corpus = {i: toks(t) for i, t in docs if t is not None}
    n, avg = len(corpus), sum(map(len, corpus.values())) / len(corpus)
    dfreq = Counter(w for ws in corpus.values() for w in set(ws))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in dfreq.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * mean if x < 0 else x for w, x in idf.items()}
    want = {}
    for q, t in [(1, "alpha gammaRay alpha"), (2, "unknown"), (3, "the beta")]:
        scores = {}
        for i, ws in corpus.items():
            tf = Counter(ws)
            scores[i] = round(sum(idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(ws) / avg)) for w in toks(t) if tf[w]), 6)
        hits = [x for x in scores.items() if any(w in corpus[x[0]] for w in toks(t))]
        for i, s in sorted(hits, key=lambda x: (-x[1], x[0]))[:5]:
            if s > 0:
                want[q, i] = s
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=2e-6) for k in want)


def test_dense(spark):
    v = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(6)], "id int, v array<float>")
    got = [(r.id, r.distance) for r in rt.dense_top(v, v.filter("id = 2"), "id", "v", "id", "v", 3).orderBy("rank").collect()]
    assert got == [(2, 0.0), (1, 1.0), (3, 1.0)]


def test_history(spark):
    s = "pr_number int, repo string, ord int, title string"
    old = spark.createDataFrame([(1, "r", 1, "a"), (2, "r", 2, "b")], s)
    new = spark.createDataFrame([(1, "r", 3, "c"), (3, "r", 4, "d"), (4, "r", 5, "e")], s)
    assert sorted((r.pr_number, r.title) for r in rt.keep_history(old, new, 3).collect()) == [(1, "c"), (3, "d"), (4, "e")]


def edges_of(spark, pairs):
    return spark.createDataFrame([(a, b, "call", f"{a}.py", 1) for a, b in pairs], "source string, target string, kind string, file_path string, line int")


def test_reach_with_cycles(spark):
    e = edges_of(spark, [("b", "a"), ("c", "b"), ("a", "c"), ("d", "c"), ("x", "d"), ("y", "x")])
    got = {(r.name, r.depth) for r in gr.reach(e, spark.createDataFrame([("a",)], "name string"), 3).collect()}
    assert got == {("b", 1), ("c", 2), ("d", 3)}


def test_impact(spark):
    e = edges_of(spark, [("fa", "crit"), ("fb", "crit"), ("fb", "crit"), ("crit", "crit")])
    syms = spark.createDataFrame([(q, f"{q}.py", True) for q in ("fa", "fb", "crit", "lone")], "qualified_name string, file_path string, is_exported boolean")
    got = {r.name: r for r in gr.impact(e, syms, syms.filter("qualified_name in ('crit', 'lone')")).collect()}
    c = got["crit"]
    assert (c.n_edges, c.n_direct, c.n_all, c.level, c.breaking) == (4, 3, 3, "MEDIUM", True)  # a symbol that calls itself counts
    assert c.files == ["crit.py", "fa.py", "fb.py"] and got["lone"].level == "LOW" and not got["lone"].breaking
    levels = spark.createDataFrame([(n,) for n in (0, 1, 5, 6, 20, 21)], "n int").select(gr.level_of(F.col("n")).alias("l")).collect()
    assert [r.l for r in levels] == ["LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH", "CRITICAL"]
    d = gr.dependants(e, syms).collect()
    assert sorted((r.file_path, r.used_by) for r in d) == [("crit.py", "fa.py"), ("crit.py", "fb.py")]


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, 1001 + k) for k in range(60)] + [(2000 + k, 2001 + k) for k in range(60)]
    got = {r.id: r.component for r in gr.components(spark.createDataFrame(pairs, "id_a long, id_b long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root}
    assert gr.components(spark.createDataFrame([], "id_a long, id_b long")).count() == 0


def test_ranked_neighbours(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["hot", "hot", "a", None]), i, rng.choice([None, f"v{i}"])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, o int, v string").repartition(4)
    want, last, prev = {}, {}, {}
    for k, o, val in sorted(rows, key=lambda r: r[1]):
        last[k] = val if val is not None else last.get(k)
        want[o] = (last[k], prev.get(k))
        prev[k] = val
    got = {r.o: r.l for r in distributed_last(df, ["k"], ["o"], "v", "l", parts=5).collect()}
    before = {r.o: r.before_v for r in previous(df, ["k"], ["o"], ["v"], parts=5).collect()}
    assert got == {o: w[0] for o, w in want.items()} and before == {o: w[1] for o, w in want.items()}


def test_analytics_golden(spark):
    r = spark.createDataFrame([(1, 1, "completed", 12.5, 3, 0.1)], "id int, pull_request_id int, status string, duration double, total_findings int, cost double").withColumn("created_at", F.lit("2025-05-05 10:00:00").cast("timestamp"))
    f = spark.createDataFrame([(i, 1, s, False) for i, s in enumerate(["error", "warning", "note"])] + [(9, 1, "error", True)], "id int, review_id int, severity string, suppressed boolean")
    repos = spark.createDataFrame([(1, "r"), (2, "empty")], "id int, full_name string")
    p = spark.createDataFrame([(1, 1)], "id int, repository_id int")
    trend = rel.daily_trend(r, f, "2025-05-20").collect()
    assert len(trend) == 30 and [(t.critical, t.high, t.other) for t in trend if t.critical] == [(1, 1, 1)]
    o = {x.full_name: x for x in rel.repository_overview(repos, p, r, f).collect()}
    assert (o["r"].reviews_count, o["r"].success_rate, o["r"].open_issues) == (1, 100, 3)
    assert (o["empty"].reviews_count, o["empty"].success_rate, o["empty"].open_issues) == (0, 100, 0)
    c = rel.severity_counts(f.filter("not suppressed")).first()
    assert (c.errors, c.warnings, c.notes, c.total) == (1, 1, 1, 3)
