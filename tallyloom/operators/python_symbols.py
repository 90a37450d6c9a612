"""Symbols and dependency edges of Python sources, and function-wise chunks, by the standard parser in Arrow batches."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = "file_path string, name string, kind string, line_start int, line_end int, qualified_name string, signature string, docstring string, is_exported boolean"
EDGES = "source string, target string, kind string, file_path string, line int"
CHUNKS = "content string, file_path string, start_line int, end_line int, chunk_type string, symbol_name string"


def _module(path: str) -> str:
    p = re.sub(r"^[./]+", "", path.replace("\\", "/"))
    return re.sub(r"\.py$", "", p).replace("/", ".")


def _signature(f: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    out = f"({ast.unparse(f.args)})"
    return f"{out} -> {ast.unparse(f.returns)}" if f.returns else out


def _constant(name: str) -> bool:
    return name.isupper() and ("_" in name or len(name) > 2)


def python_symbols(path: str, source: str) -> list[tuple]:
    """Classes, functions, methods and constants; nested classes are entered, nested functions aren't. Nothing for a file that doesn't parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    out: list[tuple] = []
    module = _module(path)

    def visit(body: list[ast.stmt], owner: list[str]) -> None:
        for n in body:
            if isinstance(n, ast.ClassDef):
                q = ".".join([module, *owner, n.name])
                out.append((path, n.name, "class", n.lineno, n.end_lineno, q, "", ast.get_docstring(n) or "", not n.name.startswith("_")))
                visit(n.body, [*owner, n.name])
            elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                q = ".".join([module, *owner, n.name])
                out.append((path, n.name, "method" if owner else "function", n.lineno, n.end_lineno, q, _signature(n), ast.get_docstring(n) or "", not n.name.startswith("_")))
            elif isinstance(n, ast.Assign) and not owner:
                for t in n.targets:
                    if isinstance(t, ast.Name) and _constant(t.id):
                        out.append((path, t.id, "constant", n.lineno, n.end_lineno, f"{module}.{t.id}", None, None, not t.id.startswith("_")))

    visit(tree.body, [])
    return out


def python_edges(path: str, source: str) -> list[tuple]:
    """Imports, calls (targets as written) and base classes, each with the innermost function or class it stands in.

    A base class stands with its class as named in the module; the dots of relative imports are dropped.
    """
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    out: list[tuple] = []
    module = _module(path)

    def visit(node: ast.AST, scope: str) -> None:
        for n in ast.iter_child_nodes(node):
            inner = scope
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                inner = f"{scope}.{n.name}"
            if isinstance(n, ast.ClassDef):
                out.extend((f"{module}.{n.name}", ast.unparse(b), "inherit", path, n.lineno) for b in n.bases)
            elif isinstance(n, ast.Import):
                out.extend((scope, a.name, "import", path, n.lineno) for a in n.names)
            elif isinstance(n, ast.ImportFrom):
                base = n.module or ""
                out.extend((scope, f"{base}.{a.name}" if base else a.name, "import", path, n.lineno) for a in n.names)
            elif isinstance(n, ast.Call):
                out.append((scope, ast.unparse(n.func), "call", path, n.lineno))
            visit(n, inner)

    visit(tree, module)
    return out


def python_chunks(path: str, source: str, size: int = 80, overlap: int = 16) -> list[tuple]:
    """Top-level functions and classes as chunks (long ones in overlapping windows), what stands between them as module chunks."""
    lines = source.splitlines()
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        tree = None
    out: list[tuple] = []

    def add(a: int, b: int, kind: str, name: str) -> None:
        step = size - overlap
        for s in range(a, b, step):
            part = lines[s : min(s + size, b)]
            if any(x.strip() for x in part):
                out.append(("\n".join(part), path, s + 1, min(s + size, b), kind, name))
            if s + size >= b:
                break

    at = 0
    for n in tree.body if tree else []:
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            first = min([n.lineno, *(d.lineno for d in n.decorator_list)]) - 1
            if first > at:
                add(at, first, "module", "")
            add(first, n.end_lineno or n.lineno, "class" if isinstance(n, ast.ClassDef) else "function", n.name)
            at = n.end_lineno or n.lineno
    if at < len(lines):
        add(at, len(lines), "module" if tree else "block", "")
    return out


def _map(fn, schema: str):
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[c.split()[1]] for c in schema.split(", ")]

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for p, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in fn(p, s)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names=names)

    return kernel


def parse_python(files: DataFrame, what: str = "symbols") -> DataFrame:
    """Symbols, edges or chunks of files (file_path, content); null paths or contents give nothing. Map-only."""
    fn, schema = {"symbols": (python_symbols, SYMBOLS), "edges": (python_edges, EDGES), "chunks": (python_chunks, CHUNKS)}[what]
    return files.select("file_path", "content").filter(F.col("file_path").isNotNull() & F.col("content").isNotNull()).mapInArrow(_map(fn, schema), schema)
