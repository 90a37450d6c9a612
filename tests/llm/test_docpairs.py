"""Functions with documentation: parsers of five languages, trivial documentation, inheritance."""

import ast
import inspect
import textwrap

import pytest

from tallyloom.llm.docpairs import documented_functions, module_of, substance
from tallyloom.llm.sourceparse import parse


def docs(text, lang):
    return {(f.cls, f.name): f.doc for f in parse(textwrap.dedent(text), lang).functions}


def test_python_equals_ast():
    import tallyloom.llm.packing as m1
    import tallyloom.llm.sourceparse as m2
    import tallyloom.operators.ranking as m3

    for m in (m1, m2, m3, textwrap, inspect, ast):
        src = inspect.getsource(m)
        got = sorted((f.name, (f.doc or "").strip()) for f in parse(src, "python").functions)
        want = sorted((n.name, (ast.get_docstring(n) or "").strip()) for n in ast.walk(ast.parse(src)) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)))
        assert got == want


def test_python_broken_and_misleading():
    got = docs(
        '''
        X = """
        def not_code():
            "no doc"
        """
        # def comment(): "no"
        class A(Base, metaclass=M):
            @deco(1)
            async def m(self, a: dict[str, int] = {"x": 1}, *args) -> "T":
                # first
                r"""Doc of m."""
            def late(self):
                x = 1
                """not doc"""
            def f_string(self):
                f"""not doc"""
        def one(): "One liner."
        def open_bracket(
            a, b
        def after(x):
            """Doc after."""
        def unfinished(
        ''',
        "python",
    )
    assert got[("A", "m")] == "Doc of m." and got[("A", "late")] is None and got[("A", "f_string")] is None
    assert got[("", "one")] == "One liner." and got[("", "after")] == "Doc after."
    assert not {n for _, n in got} & {"not_code", "comment"}
    assert docs('def f():\n    """never closed', "python") == {("", "f"): None}


def test_javascript_and_typescript():
    got = docs(
        """
        /** Of the file. */

        import x from './x';
        /**
         * Doc a.
         * @param {number} p how many
         */
        export default async function a(p, {q, r} = {}) { return `/** no */ function t() {}`; }
        /** Far. */

        function far() {}
        // /** Commented. */
        // function commented() {}
        /** Doc arrow. */
        export const arrow = async (p: Map<string, number>): Promise<void> => { call(1); };
        /** Doc short. */
        const short = x => x / 2;
        const re = /["'`{]/.test(s);
        /** Doc C. */
        @Component({a: 1})
        class C<T> extends B.D<T> {
          /** Doc m. */
          // eslint-disable-next-line
          static async m<K>(a: K, b?: string): { x: number } { if (a) { foo(b); } }
          field = 3;
          /** Doc h. */
          handler = (e: Event): void => { };
          /* Not doc. */
          n() {}
          get v() { return 1; }
        }
        /** Doc last. */
        function last(
        """,
        "typescript",
    )
    assert got[("", "a")].startswith("Doc a.") and got[("", "far")] is None
    assert got[("", "arrow")] == "Doc arrow." and got[("", "short")] == "Doc short."
    assert got[("C", "m")] == "Doc m." and got[("C", "handler")] == "Doc h." and got[("C", "n")] is None and ("C", "v") in got
    assert not {n for _, n in got} & {"t", "commented", "if", "foo", "last", "call"}
    assert parse("class A extends B { }", "javascript").classes == [("A", ["B"])]


def test_java():
    got = docs(
        '''
        package a.b;
        /** Doc K. */
        public class K extends Base<String> implements I, J {
            private final Map<String, Integer> m = new HashMap<>();
            /** Doc f. */
            @Override
            @SuppressWarnings({"a", "b"})
            public static <T> List<T> f(final Map<String, int[]> a, T... b) throws IOException { String s = "/** x */ int g() {}"; call(s); return null; }
            /** {@inheritDoc} */
            public int h(int x) { return x; }
            /** Far. */

            int far() { return 1; }
            // /** C. */
            // int c() { return 1; }
            /** Doc abs. */
            abstract void abs(int a);
        }
        ''',
        "java",
    )
    assert got[("K", "f")] == "Doc f." and got[("K", "h")] == "{@inheritDoc}" and got[("K", "far")] is None and got[("K", "abs")] == "Doc abs."
    assert not {n for _, n in got} & {"g", "c", "call"}
    f = parse("class K { /** D. */ int f(final List<String> a, int... b) { } }", "java").functions[0]
    assert f.params == ["a", "b"]


def test_go():
    got = docs(
        """
        package p
        // Doc A is.
        //
        //go:noinline
        func A(x int, f func(int) error) (int, error) {
        	s := `
        // Raw.
        func raw() {}
        `
        	return 0, nil
        }
        // Far.

        func Far() {}
        /*
        // In.
        func in() {}
        */
        //nolint:all
        func Only() {}
        // Doc M.
        func (r *Recv[T]) M() error { return nil }
        type S struct {
        	Base
        	n int
        }
        """,
        "go",
    )
    assert got[("", "A")] == "Doc A is." and got[("", "Far")] is None and got[("", "Only")] is None and got[("Recv", "M")] == "Doc M."
    assert not {n for _, n in got} & {"raw", "in"}


@pytest.mark.parametrize("doc", ["", "...", "-----", "TODO", "TODO: describe what it returns", "FIXME", "N/A", "tbd.", "_summary_", "description", "Add description here", "Auto-generated method stub", "This comment is intentionally left blank", "The load user function.", "loadUser", "load_user x", ":param name:\n:return:", "@param name the name\n@returns", "Please document me before the next release", "{@inheritDoc}", "Loads the user."])
def test_trivial(doc):
    assert not substance(doc, "loadUser", ["name"])


@pytest.mark.parametrize("doc", ["Loads the user from disk.", "Not safe across forks.", "O(n) in the number of rows.", "TODO: tidy up\n\nReads lines until the marker.", "@param name must not be blank", "Liest alle Einträge.", "loadUser is used as follows: close it."])
def test_substance(doc):
    assert substance(doc, "loadUser", ["name"])


def test_module():
    assert module_of("./a/b/c.test.ts") == "a.b.c.test" and module_of("x.py") == "x" and module_of("a\\b.go") == "a.b"


F_SCHEMA = "file_id long, repository_id long, file_path string, lang string, content string, docstring string, cls string"


def test_operator_with_inheritance(spark):
    base = "class A:\n    def run(self):\n        '''Runs until the queue is drained.'''\n    def stop(self): pass\n"
    mid = "class B(A):\n    def other(self): pass\n"
    low = "class C(B):\n    def run(self): pass\n    def stop(self):\n        '''TODO'''\n"
    loop = "class X(Y):\n    def f(self): pass\nclass Y(X):\n    pass\n"
    rows = [(1, 9, "./p/a.py", "python", base, "", ""), (2, 9, "p/b.py", None, mid, "", ""), (3, 9, "p/c.py", "unknown", low, "", ""), (4, 8, "p/c.py", "PYTHON", low, "", ""), (5, 9, "p/l.py", "", loop, "", "")]
    rows += [rows[0], (6, 9, "p/a.py", "python", base, "", ""), (7, 9, None, "python", base, "", ""), (8, 9, "x.py", "python", None, "", ""), (9, 9, "x.py", "python", "", "", ""), (10, 9, "x.rb", "ruby", "def x; end", "", ""), (11, 9, "y.py", "python", "x = 1\n" * 100_000, "", "")]
    got = {(r.file_id, r.qualified_name): (r.docstring, r.doc_from) for r in documented_functions(spark.createDataFrame(rows, F_SCHEMA).repartition(2)).collect()}
    doc = "Runs until the queue is drained."
    assert got == {(1, "p.a.A.run"): (doc, "own"), (6, "p.a.A.run"): (doc, "own"), (3, "p.c.C.run"): (doc, "A")}
    assert documented_functions(spark.createDataFrame([], F_SCHEMA)).count() == 0


def test_bases_are_resolved_by_place_and_order(spark):
    deep = "class K0:\n    def run(self):\n        '''Runs until the queue is drained.'''\n" + "".join(f"class K{k}(K{k - 1}):\n    def run(self): pass\n" for k in range(1, 45))
    one = "class Base:\n    def go(self):\n        '''Goes through every shard once.'''\n"
    two = "class Base:\n    def go(self):\n        '''Walks over the other table.'''\n"
    first = "class L:\n    def act(self):\n        '''Acts on the left replica.'''\n"
    second = "class R:\n    def act(self):\n        '''Acts on the right replica.'''\n"
    user = "class C(Base):\n    def go(self): pass\n"
    both = "class D(R, L):\n    def act(self): pass\n"
    rows = [(1, 1, "d/deep.py", deep), (2, 1, "a/base.py", one), (3, 1, "b/base.py", two), (4, 1, "a/user.py", user), (5, 1, "b/user.py", user), (6, 1, "c/user.py", user), (7, 1, "m/l.py", first), (8, 1, "n/r.py", second), (9, 1, "o/d.py", both), (10, None, "a/user.py", user), (11, None, "a/base.py", one)]
    df = spark.createDataFrame([(i, r, p, "python", t, "", "") for i, r, p, t in rows], F_SCHEMA)
    got = {(r.file_id, r.qualified_name): (r.docstring, r.doc_from, r.depth) for r in documented_functions(df).collect()}
    assert got[1, "d.deep.K44.run"] == ("Runs until the queue is drained.", "K0", 44)
    assert got[4, "a.user.C.go"] == ("Goes through every shard once.", "Base", 1)
    assert got[5, "b.user.C.go"] == ("Walks over the other table.", "Base", 1)
    assert (6, "c.user.C.go") not in got and (10, "a.user.C.go") not in got  # two classes of that name; no repository
    assert got[9, "o.d.D.act"] == ("Acts on the right replica.", "R", 1)


def test_equal_bases_take_no_side(spark):
    """A cycle of classes without documentation ends."""
    loop = "class X(Y):\n    def f(self): pass\nclass Y(Z):\n    pass\nclass Z(X):\n    def f(self): pass\n"
    assert documented_functions(spark.createDataFrame([(1, 1, "l.py", "python", loop, "", "")], F_SCHEMA)).count() == 0
