"""Queries that take whole tables, against brute force on rows that a cut would lose."""

import hashlib
import random
import re
from collections import Counter

import __spark_entry__ as entry
from tallyloom.operators.chunks import BOUNDARIES


def run(spark, tmp_path, name, **tables):
    """Rows of a query over small tables, given as (rows, schema)."""
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{t}.parquet"))
    return entry.queries()[name](spark, str(tmp_path)).collect()


FINDINGS = "id long, review_id long, file_path string, line_start int, line_end int, severity string, category string, rule_id string, tool_source string, message string, confidence double, is_suppressed boolean, suppression_reason string"


def finding(i, review, path, severity="error", tool="llm"):
    return (i, review, path, 1, 1, severity, "style", "", tool, "m", 0.5, False, None)


def test_names_of_all_reviews(spark, tmp_path):
    paths = {1: (1, "src/a.py"), 2: (301, "lib/deep/b.py"), 3: (90_000, "x/lib/deep/b.py"), 4: (5, "b.py"), 5: (700, None), 6: (2, "lib/xdeep/b.py")}
    got = run(spark, tmp_path, "j16_by_suffix", findings=([finding(i, r, p) for i, (r, p) in paths.items()], FINDINGS))
    names = {"/".join(p.split("/")[-2:]) for _, p in paths.values() if p and "/" in p}
    want = {(i, n) for i, (_, p) in paths.items() if p for n in names if p == n or p.endswith("/" + n)}
    assert Counter((r.id, r.name) for r in got) == Counter(want) and (2, "deep/b.py") in want


DOCUMENTS = "doc_id long, text string, kind string"


def test_places_on_every_line(spark, tmp_path):
    patch = "@@ -1,2 +1,4 @@\n a\n+b\n-c\n+d\n e\n@@ -20,1 +29,3 @@\n+f\n+g\n h"
    rows = [(1, patch, "diff"), (2, patch, "note"), (3, None, "diff"), (4, "@@ -0,0 +1,9 @@\n" + "\n".join(["+x"] * 9), "diff")]
    got = run(spark, tmp_path, "p24_on_added_lines", documents=(rows, DOCUMENTS))
    want = {(1, k) for k in (2, 3, 29, 30)} | {(4, k) for k in range(1, 10)}
    assert Counter((r.doc_id, r.line_start) for r in got) == Counter(want)


SOURCES = "file_id long, file_path string, content string"


def test_boundary_chunks_of_all_languages(spark, tmp_path):
    rng = random.Random(9)
    heads = {"js": "function f(x) {", "ts": "class K {", "java": "    public static int go(int x) {", "go": "func A() {", "py": "def f():"}
    names = {"js": "javascript", "ts": "typescript", "java": "java", "go": "go"}
    rows, want = [], Counter()
    for i, (ext, head) in enumerate(sorted(heads.items()) * 3):
        lengths = [(200,), (3, 80, 81, 30), (5, 300)][i // len(heads)]
        if lengths == (200,):
            ls = [f"x{k}" for k in range(200)]  # no boundary at all
        else:
            ls = [x for n in lengths for x in [head, *(rng.choice([f"y{k}", ""]) for k in range(n - 1))]]
            ls = ["// top", *ls, "end"]
        rows.append((i, f"src/f{i}.{ext}", "\n".join(ls) + "\n"))
        if ext in names:
            at = [0] + [k for k in range(1, len(ls)) if re.match(BOUNDARIES[names[ext]], ls[k])]
            cuts = [(a, s) for a, b in zip(at, [*at[1:], len(ls)]) for s in range(a, b, 64)]
            ends = {a: b for a, b in zip(at, [*at[1:], len(ls)])}
            parts = [(s, min(s + 80, ends[a])) for a, s in cuts]
        else:
            parts = [(s, min(s + 80, len(ls))) for s in range(0, len(ls), 78) if s == 0 or s - 78 + 80 < len(ls)]
        want.update((i, s + 1, e, hashlib.md5("\n".join(ls[s:e]).encode()).hexdigest()) for s, e in parts)
    got = run(spark, tmp_path, "w09_boundary_chunks", source_files=(rows, SOURCES))
    assert Counter((r.file_id, r.start_line, r.end_line, r["sum"]) for r in got) == want
    assert max(r.end_line - r.start_line + 1 for r in got) == 80


def test_hits_with_whole_texts(spark, tmp_path):
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    texts = {i: " ".join([words[i % 5], *(f"w{i}x{k}" for k in range(60)), words[i % 3], f"end{i}"]) for i in range(100, 112)}
    documents = ([(i, t, "note") for i, t in texts.items()], DOCUMENTS)
    embeddings = ([(i, [float(i), 0.0]) for i in texts], "vec_id long, embedding array<float>")
    hits = run(spark, tmp_path, "j13_hits_with_text", documents=documents, embeddings=embeddings)
    assert hits and all(r.text == texts[r.doc_id] and len(r.text) > 100 for r in hits)
    places = {r.doc_id: r.place for r in entry.queries()["a20_rrf"](spark, str(tmp_path)).collect()}
    want = hashlib.md5("\n\n".join(f"### {i}\n{texts[i]}" for i in sorted(places, key=places.get)).encode()).hexdigest()
    assert [(r["query"], r["sum"]) for r in entry.queries()["f12_context_text"](spark, str(tmp_path)).collect()] == [(100, want)]


def test_written_rows_are_read_from_tables(spark, tmp_path):
    props = [(1, '["a", "b c"]'), (2, "run  --fast x"), (3, None), (4, "[broken")]
    got = run(spark, tmp_path, "f24_json_or_words", events=(props, "event_id long, props string"))
    assert {r.event_id: r.parts for r in got} == {1: "a|b c", 2: "run|--fast|x", 3: "", 4: "[broken"}
    fenced = '```mermaid\ngraph TD\nA[x y] --> B["z"]\n```'
    got = run(spark, tmp_path, "f08_diagram", stage_results=([(1, fenced), (2, None)], "id long, raw_output string"), documents=([(1, "no diagram", "note"), (7, fenced, "note")], DOCUMENTS))
    want = 'graph TD\nA["x y"] --> B["z"]'
    assert {(r.source, r.id): r.d for r in got} == {("stage", 1): want, ("stage", 2): None, ("document", 1): None, ("document", 7): want}
    rows = [finding(1, 1, "a", "HIGH", "bandit"), finding(2, 1, "a", "medium ", "bandit"), finding(3, 1, "a", "INFO", "semgrep"), finding(4, 1, "a", None, "ruff")]
    got = run(spark, tmp_path, "p29_tool_severity", findings=(rows, FINDINGS))
    assert {r.id: r.severity for r in got} == {1: "error", 2: "warning", 3: "note", 4: "warning"}
