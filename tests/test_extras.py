"""Clamps, character chunks, line-wise symbols."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.operators import clamps as cl
from tallyloom.operators.char_chunks import char_chunks, split_characters
from tallyloom.operators.code_symbols import code_symbols, parse_code


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n", max_size=300), st.sampled_from([(10, 3), (40, 8), (5, 0)]))
def test_char_chunks(text, shape):
    size, overlap = shape
    got = char_chunks(text, size, overlap)
    assert all(0 < len(c) <= size for c in got)
    at = 0
    for c in got:  # each chunk stands in the text, not before the one before it
        at = text.find(c, max(0, at - size))
        assert at >= 0
    assert set("".join(text.split())) == set("".join("".join(got).split()))


def test_split_characters(spark):
    df = spark.createDataFrame([(1, "word " * 300, "x"), (2, None, "x"), (3, " ", "x")], "id long, t string, chunk string")
    rows = split_characters(df, "id", "t").collect()
    assert {r.id for r in rows} == {1} and [r.chunk for r in rows] == list(range(1, len(rows) + 1))


CODE = {
    "a/x.ts": "import { a } from './a';\n// class No {}\nexport class K<T> extends Base<T> implements I, J {\n  constructor(x: number) { super(x); }\n  async run(a: string): Promise<void> {\n    await this.v.go(a);\n    foo(`bar(${1})`);\n  }\n}\nexport const f = async (x: number) => { return g(x); };\nfunction h(a) { if (a) { i(); } }\n",
    "J.java": 'package p;\nimport java.util.List;\npublic class J extends B implements C, D<E> {\n  @Override public static <T> List<T> go(int x) throws E { return helper(x).map(y); }\n  abstract void no();\n  /* fake() */ String s = "call()";\n}\n',
    "g.go": 'package m\nimport "fmt"\ntype S struct {\n\tx int\n}\nfunc (s *S) Run(x int) error {\n\tfmt.Println("hi()")\n\treturn s.again(x)\n}\nfunc plain() {}\n',
    "r.rs": "use std::io::Read;\npub struct T;\nimpl Read for T {\n  fn act(&self) -> u8 { helper(1) }\n}\npub async fn free() {}\n",
    "c.cpp": "#include <vector>\nclass A : public B, C<int> {\n  int m() const { return f(1); }\n};\nint A::n(int x) { return m(); }\nstatic int top(void) { A a; a.m(); if (x) y->z(); }\n",
    "cut.java": "class Z { void go() { one(); two(",
    "e.txt": "class No {}",
}
SYMBOLS_OF = {
    "a/x.ts": [("import { a } from './a';", "import", 1, 1), ("K", "class", 3, 9), ("constructor", "method", 4, 4), ("run", "method", 5, 8), ("f", "function", 10, 10), ("h", "function", 11, 11)],
    "J.java": [("import java.util.List;", "import", 2, 2), ("J", "class", 3, 7), ("go", "method", 4, 4)],
    "g.go": [('import "fmt"', "import", 2, 2), ("S", "class", 3, 5), ("Run", "method", 6, 9), ("plain", "function", 10, 10)],
    "r.rs": [("use std::io::Read;", "import", 1, 1), ("T", "class", 2, 2), ("act", "method", 4, 4), ("free", "function", 6, 6)],
    "c.cpp": [("#include <vector>", "import", 1, 1), ("A", "class", 2, 4), ("m", "method", 3, 3), ("n", "method", 5, 5), ("top", "function", 6, 6)],
    "cut.java": [("Z", "class", 1, 1), ("go", "method", 1, 1)],
}
CALLS_OF = {"a/x.ts": {"super", "this.v.go", "foo", "g", "i"}, "J.java": {"helper", "map"}, "g.go": {"fmt.Println", "s.again"}, "r.rs": {"helper"}, "c.cpp": {"f", "m", "a.m", "y->z"}, "cut.java": {"one", "two"}}
BASES_OF = {"a/x.ts": {"Base", "I", "J"}, "J.java": {"B", "C", "D"}, "r.rs": {"Read"}, "c.cpp": {"B", "C"}}


def test_code_symbols_and_edges(spark):
    df = spark.createDataFrame([(p, t, "x") for p, t in CODE.items()] + [("n.go", None, "x"), (None, "func a() {}", "x"), ("m.go", "", "x")], "file_path string, content string, name string")
    got = {}
    for r in code_symbols(df).collect():
        got.setdefault(r.file_path, []).append((r.name, r.kind, r.line_start, r.line_end))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in SYMBOLS_OF.items()}
    edges = code_symbols(df, "edges").collect()
    for kind, want in (("call", CALLS_OF), ("inherit", BASES_OF)):
        of = {}
        for r in edges:
            if r.kind == kind:
                of.setdefault(r.file_path, set()).add(r.target)
        assert {k: v - {"super"} for k, v in of.items()} == {k: v - {"super"} for k, v in want.items()}
    assert {(r.source, r.target, r.line) for r in edges if r.kind == "import"} >= {("a.x", "import { a } from './a';", 1), ("c", "#include <vector>", 1)}
    assert code_symbols(spark.createDataFrame([], "file_path string, content string")).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["class A", "{", "}", "(", ")", "func f", "fn g", "x.y(", '"', "'", "`", "//", "/*", "*/", "\n", "import a", "=>", "const z = ", "extends B", ";", "impl T for U", "#include", "<", ">", "::", "ü"]), max_size=40).map(" ".join), st.sampled_from(["a.js", "a.ts", "a.java", "a.go", "a.rs", "a.c", "a.hpp"]))
def test_code_parser_never_fails(text, path):
    symbols, edges = parse_code(path, text)
    assert all(1 <= s[3] <= s[4] for s in symbols) and all(e[4] >= 1 for e in edges)


def test_clamps(spark):
    df = spark.createDataFrame([(["Security", "odd", " style "], "srv__do__it")], "a array<string>, n string")
    r = df.select(cl.clamped_list(F.col("a"), ("security", "style"), 5).alias("a"), *[c.alias(x) for c, x in zip(cl.namespaced(F.col("n")), "xy")]).first()
    assert r.a == ["security", "style"] and (r.x, r.y) == ("srv", "do__it")
