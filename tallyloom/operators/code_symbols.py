"""Symbols and dependency edges of JavaScript, TypeScript, Java, Go, Rust, C and C++ sources.

No parser generator is needed: comments and literals are blanked out, the rest is a line of tokens,
and one pass with a stack of open braces tells declarations (functions, methods, classes) from
calls. Files that don't parse give what stands before and after the fault. Each file is one row of
an Arrow batch; there is no shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Language by extension.
LANGUAGES = {".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".go": "go", ".rs": "rust", ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp"}
#: Words before a bracket that call nothing and declare nothing.
_NO_CALL = frozenset("if for while switch catch return sizeof typeof await new throw else do in of instanceof delete void yield case match loop unsafe where impl fn func function class super synchronized try using alignof decltype defined elif and or not go defer select range chan map interface struct async".split())
_MEMBER = (".", "?.", "->", "::")
_BLANK = {
    "javascript": r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?|(?<=[=(,:;!&|?{}\n])\s*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*",
    "java": r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"\"\".*?(?:\"\"\"|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?",
    "go": r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`[^`]*`?",
    "rust": r"//[^\n]*|/\*.*?(?:\*/|\Z)|b?r#+\".*?\"#+|b?\"(?:\\.|[^\"\\])*\"?|b?'(?:\\[^\n]+?|[^'\\\n])'",
    "c": r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?",
}
_BLANK["typescript"], _BLANK["cpp"] = _BLANK["javascript"], _BLANK["c"]
_BLANKS = {k: re.compile(v, re.S) for k, v in _BLANK.items()}
_TOKEN = re.compile(r"[^\W\d][\w$]*|\$[\w$]*|\d[\w.]*|=>|->|::|\?\.|[^\w\s]")
_IMPORTS = {
    "javascript": r"(?m)^[ \t]*import\b[^;\n]*(?:\{[^}]*\}[^;\n]*)?;?",
    "java": r"(?m)^[ \t]*import\s[^;\n]*;?",
    "go": r"(?m)^import[ \t]+(?:\([^)]*\)?|[^\n]*)",
    "rust": r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?use\s[^;]*;?",
    "c": r"(?m)^[ \t]*#[ \t]*include[^\n]*",
}
_IMPORTS["typescript"], _IMPORTS["cpp"] = _IMPORTS["javascript"], _IMPORTS["c"]
_IMPORT = {k: re.compile(v) for k, v in _IMPORTS.items()}
_OPEN = {"(": ")", "[": "]", "{": "}"}

SYMBOLS = "file_path string, name string, kind string, line_start int, line_end int, qualified_name string, is_exported boolean"
EDGES = "file_path string, source string, target string, kind string, line int"


def language_of(path: str) -> str | None:
    base = path.replace("\\", "/").rsplit("/", 1)[-1].lower()
    return LANGUAGES.get(base[base.rfind(".") :]) if "." in base.lstrip(".") else None


def module_of(path: str) -> str:
    """Dotted path without extension and leading dots or slashes."""
    p = re.sub(r"^[./]+", "", path.replace("\\", "/"))
    return re.sub(r"\.[^./]*$", "", p).replace("/", ".")


def _pairs(words: list[str]) -> dict[int, int]:
    """Closing token of each opening bracket; what is never closed ends with the file."""
    out: dict[int, int] = {}
    stack: list[int] = []
    for k, w in enumerate(words):
        if w in _OPEN:
            stack.append(k)
        elif w in (")", "]", "}"):
            while stack and _OPEN[words[stack[-1]]] != w:
                out[stack.pop()] = k
            if stack:
                out[stack.pop()] = k
    for k in stack:
        out[k] = len(words) - 1
    return out


def parse_code(path: str, text: str) -> tuple[list[tuple], list[tuple]]:
    """(symbols, edges) of one file as rows of ``SYMBOLS`` and ``EDGES``; nothing for other languages."""
    lang = language_of(path)
    if not lang or not text:
        return [], []
    clean = _BLANKS[lang].sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    module = module_of(path)
    ends = [m.start() for m in re.finditer(r"\n", text)]

    def line(at: int) -> int:
        return bisect_right(ends, at - 1) + 1 if at else 1

    symbols: list[tuple] = []
    edges: list[tuple] = []
    bare = re.sub(r"//[^\n]*|/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m.group()), text, flags=re.S) if lang != "rust" else clean
    for m in _IMPORT[lang].finditer(bare):
        begin = m.start() + len(m.group()) - len(m.group().lstrip())
        if clean[begin : begin + 1].strip():  # not inside a literal
            edges.append((path, module, m.group().strip(), "import", line(begin)))
            symbols.append((path, m.group().strip(), "import", line(begin), line(m.end() - 1), f"{module}.{m.group().strip()}", True))
    code = _IMPORT[lang].sub(lambda m: re.sub(r"[^\n]", " ", m.group()), clean)
    code = re.sub(r"(?m)^[ \t]*#[^\n]*", lambda m: " " * len(m.group()), code) if lang in ("c", "cpp") else code
    tokens = [(m.group(), m.start()) for m in _TOKEN.finditer(code)]
    words = [w for w, _ in tokens]
    close = _pairs(words)
    n = len(words)
    bodies: dict[int, str] = {}  # opening brace -> class or function
    scope: list[tuple[int, str]] = []  # (closing token, kind)

    def declare(name: str, kind: str, k: int, last: int) -> None:
        symbols.append((path, name, kind, line(tokens[k][1]), line(tokens[min(last, n - 1)][1]), f"{module}.{name}", not name.startswith("_")))

    def brace_after(k: int) -> int | None:
        """The opening brace of a body that follows, before any semicolon or line of another kind."""
        while k < n and words[k] not in ("{", ";", "}"):
            k = close.get(k, k) + 1 if words[k] in ("(", "[") else k + 1
        return k if k < n and words[k] == "{" else None

    def is_name(w: str) -> bool:
        return w[0].isalpha() or w[0] in "_$"

    k = 0
    while k < n:
        w = words[k]
        while scope and k > scope[-1][0]:
            scope.pop()
        inside = scope[-1][1] if scope else "file"
        if w == "{":
            scope.append((close[k], bodies.get(k, "block")))
        elif w in ("class", "interface", "enum", "struct", "trait", "record", "type", "union") and k + 1 < n and is_name(words[k + 1]) and (k == 0 or words[k - 1] not in (".", "::")):
            name, body = words[k + 1], brace_after(k + 2)
            real = body is not None and not (lang in ("c", "cpp") and ("(" in words[k + 2 : body] or "=" in words[k + 2 : body])) and not (w == "type" and (lang != "go" or words[k + 2 : k + 3] not in (["struct"], ["interface"])))
            if real or lang == "rust" and w == "struct":
                last = close[body] if body is not None else k + 1
                declare(name, "class", k, last)
                if body is not None:
                    bodies[body] = "class"
                    head = words[k + 2 : body]
                    if lang == "cpp" and ":" in head:
                        heads = [head[head.index(":") + 1 :]]
                    else:
                        at = [i for i, x in enumerate(head) if x in ("extends", "implements")]
                        heads = [head[i + 1 : j] for i, j in zip(at, [*at[1:], len(head)])]
                    for part in heads:
                        base, depth = "", 0
                        for x in [*part, ","]:
                            depth += (x in "<(") - (x in ">)")
                            if x == "," and depth <= 0:
                                if base:
                                    edges.append((path, module, base, "inherit", line(tokens[k][1])))
                                base = ""
                            elif depth == 0 and x not in ("public", "private", "protected", "virtual", ">", ")"):
                                base += x
                    k = body
                    continue
        elif lang == "rust" and w == "impl":
            body = brace_after(k + 1)
            if body is not None:
                head = words[k + 1 : body]
                if "for" in head:
                    trait = [x for x in head[: head.index("for")] if is_name(x)]
                    if trait:
                        edges.append((path, module, trait[-1], "inherit", line(tokens[k][1])))
                bodies[body] = "class"
                k = body
                continue
        elif w == "function" and lang in ("javascript", "typescript") or w == "fn" and lang == "rust" or w == "func" and lang == "go":
            j = k + 1
            method = inside == "class"
            if lang == "go" and j < n and words[j] == "(":
                j, method = close[j] + 1, True
            j += j < n and words[j] == "*"
            if j < n and is_name(words[j]):
                body = brace_after(j + 1)
                declare(words[j], "method" if method else "function", k, close[body] if body is not None else j)
                if body is not None:
                    bodies[body] = "function"
                k = j + 1
                continue
        elif lang in ("javascript", "typescript") and is_name(w) and k + 2 < n and words[k + 1] == "=" and words[k - 1] in ("const", "let", "var"):
            j = k + 2 + (words[k + 2] == "async")
            j = close[j] + 1 if j < n and words[j] == "(" else j + 1
            while j < n and j < k + 40 and words[j] not in ("=>", ";", "{", "="):
                j = close.get(j, j) + 1
            if j < n and words[j] == "=>":
                body = j + 1 if j + 1 < n and words[j + 1] == "{" else None
                declare(w, "function", k, close[body] if body is not None else j + 1)
                if body is not None:
                    bodies[body] = "function"
        elif is_name(w) and k + 1 < n and words[k + 1] == "(" and (w not in _NO_CALL or k and words[k - 1] in _MEMBER or inside == "class" and lang in ("java", "javascript", "typescript") and w in ("go", "map", "select", "range", "match", "delete", "loop", "fn", "func", "defer")):
            after = close[k + 1] + 1
            before = words[k - 1] if k else ""
            may_declare = {"java": inside == "class", "javascript": inside == "class", "typescript": inside == "class", "c": inside in ("file", "class", "block") and not any(s[1] == "function" for s in scope), "cpp": not any(s[1] == "function" for s in scope)}.get(lang, False)
            body = None
            if may_declare and before not in (".", "new", "=", "return", "(", ",", "?."):
                j = after
                while j < n and words[j] not in ("{", ";", "}", "(", "=") and (is_name(words[j]) or words[j] in (":", "<", ">", "[", "]", "|", ",", ".", "->", "&", "*", "?", "::")):
                    j += 1
                body = j if j < n and words[j] == "{" else None
            if body is not None:
                declare(w, "method" if inside == "class" or before == "::" else "function", k, close[body])
                bodies[body] = "function"
            elif not (may_declare and lang in ("java", "typescript", "c", "cpp") and before and (is_name(before) and before not in ("return", "else", "throw", "await", "new") or before in (">", "]", "*", "&")) and after < n and words[after] in (";", ":", "throws")) and before != "@":
                callee, j = w, k
                while j >= 2 and words[j - 1] in _MEMBER and is_name(words[j - 2]):
                    callee = words[j - 2] + words[j - 1] + callee
                    j -= 2
                edges.append((path, module, callee, "call", line(tokens[k][1])))
        k += 1
    return symbols, edges


def _kernel(what: str):
    columns = SYMBOLS if what == "symbols" else EDGES
    names, kinds = zip(*[c.split() for c in columns.split(", ")])
    types = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in parse_code(p, t)[what == "edges"]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, types[k]) for v, k in zip(zip(*rows), kinds)], names=list(names))

    return run


def code_symbols(files: DataFrame, what: str = "symbols") -> DataFrame:
    """Symbols (name, kind, lines, qualified name) or edges (import, call, inherit) of files (file_path, content).

    Files without path or content, and of other languages, give nothing. Map-only; further columns are ignored.
    """
    if what not in ("symbols", "edges"):
        raise ValueError("what is symbols or edges")
    ends = "|".join(re.escape(e) for e in LANGUAGES)
    f = files.select("file_path", "content").filter(F.col("file_path").rlike(f"(?i)(?:{ends})$") & (F.length("content") > 0))
    return f.mapInArrow(_kernel(what), SYMBOLS if what == "symbols" else EDGES)
